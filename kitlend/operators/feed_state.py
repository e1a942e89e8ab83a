"""Feeds and badges kept up by deltas.

A batch of new notifications and readings becomes a partial state of its own size:
the newest rows per viewer, unread counts, the newest audience notices, counts of
audience notices by instant (whose sum from a staff member's joining on is what that
member has been sent), and counts of those read. Partial states merge by union and one
more aggregate, in any grouping, so neither a feed nor a badge reads the history of
notifications again: they merge the base with the batches after it (``sources.deltas``).
A base is as large as the viewers' newest rows.

A batch takes the day's new rows (own ones read already count as read), the own
rows newly read (id, user_id, read_at: what ``mark_read`` changed), and the audience
notices newly read (notification_id, user_id, read_at: what ``read_audience`` added,
each once). ``gone`` names deleted members, whose rows leave with them; a member's id
is not given again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kitlend.operators import notify as N
from kitlend.sources.deltas import Kept, State
from kitlend.sources.fixtures import Lending

PIECES = ("newest", "unread", "shared", "marks", "reads", "seen", "shared_reads", "gone")


def partial(notes: DataFrame, reads: DataFrame, audience_reads: DataFrame, gone: DataFrame) -> State:
    """The state of one batch alone."""
    own = notes.where(F.col("audience").isNull() & F.col("user_id").isNotNull())
    fewer = reads.select("user_id", F.lit(-1).cast("long").alias("unread"))
    more = own.select("user_id", F.when(F.col("read_at").isNull(), 1).otherwise(0).cast("long").alias("unread"))
    return {
        "newest": _newest(own.select(*N.FEED_COLUMNS)),
        "unread": _sums(more.unionByName(fewer), "user_id", "unread"),
        "shared": N.newest_shared(notes, N.FEED_MAX).select(*N.FEED_COLUMNS, "audience"),
        "marks": N.audience_marks(notes),
        "reads": reads.select("id", "user_id", "read_at"),
        "seen": audience_reads.groupBy("user_id").agg(F.count(F.lit(1)).alias("n")),
        "shared_reads": audience_reads.select("notification_id", "user_id", "read_at"),
        "gone": gone.select("user_id").distinct(),
    }


def _newest(rows: DataFrame) -> DataFrame:
    return (rows.withColumn("_pos", F.row_number().over(N.newest_first())).where(F.col("_pos") <= N.FEED_MAX).drop("_pos"))


def _sums(rows: DataFrame, key: str, value: str) -> DataFrame:
    return rows.groupBy(key).agg(F.sum(value).alias(value))


def merged(s: State) -> State:
    """One state of the united pieces of several. Its own reads are empty: each has
    met its row, or the row is behind the newest ones for good."""
    here = s["gone"].select(F.col("user_id").alias("_gone"))

    def stay(df: DataFrame) -> DataFrame:
        return df.join(here, F.col("user_id") == F.col("_gone"), "left_anti")
    first = s["reads"].groupBy(F.col("id").alias("_rid"), F.col("user_id").alias("_ru")).agg(F.min("read_at").alias("_at"))
    newest = (_newest(stay(s["newest"])).join(first, (F.col("id") == F.col("_rid")) & (F.col("user_id") == F.col("_ru")), "left")
              .withColumn("read_at", F.coalesce("read_at", "_at")).select(*N.FEED_COLUMNS))
    shared = N.newest_shared(s["shared"], N.FEED_MAX)
    ids = shared.select(F.col("id").alias("_id"))
    return {
        "newest": newest, "unread": _sums(stay(s["unread"]), "user_id", "unread"), "shared": shared,
        "marks": _sums(s["marks"], "at", "n"), "reads": s["reads"].where(F.lit(False)),
        "seen": _sums(stay(s["seen"]), "user_id", "n"),
        "shared_reads": stay(s["shared_reads"]).join(ids, F.col("notification_id") == F.col("_id"), "left_semi"),
        "gone": s["gone"].distinct(),
    }


def kept(spark: SparkSession, path: str) -> Kept:
    return Kept(spark, path, PIECES, merged)


def fold_batch(spark: SparkSession, path: str, batch: int, notes: DataFrame, reads: DataFrame | None = None,
               audience_reads: DataFrame | None = None, gone: DataFrame | None = None) -> bool:
    """Store the partial state of a batch (from 1); False if the base holds it already."""
    def state() -> State:
        nobody = notes.where(F.lit(False))
        own = reads if reads is not None else nobody.select("id", "user_id", "read_at")
        heard = audience_reads if audience_reads is not None else nobody.select(
            F.col("id").alias("notification_id"), "user_id", "read_at")
        return partial(notes, own, heard, gone if gone is not None else nobody.select("user_id"))
    return kept(spark, path).fold(batch, state)


def badges(state: State, l: Lending) -> DataFrame:
    """A9 from a state; of ``l`` only the staff roster is read."""
    return N.badges_of(N.staff_roster(l)[0], state["unread"], state["marks"], state["seen"])


def feed(state: State, l: Lending, n: int = 20) -> DataFrame:
    """K2 from a state; of ``l`` only the staff roster is read."""
    viewers = N.staff_roster(l)[0].select("staff_id", "joined")
    return N.feed_of(viewers, state["newest"], state["shared"], state["shared_reads"], min(n, N.FEED_MAX))
