"""Ordered capacity fold per key, exact and skew-safe.

Admission and return settlement are sequential per key: a refused request
uses nothing, so a running sum is wrong and the state after each request
depends on every earlier decision of that key. Everything runs as Spark
expressions; no Python sees a row.

* Keys of at most ``RUN_ROWS`` rows are gathered into one array each and
  replayed with ``aggregate``.
* Longer keys are range-partitioned on (key, order), so that a key with a third
  of all rows spans many partitions; the partition count follows the counted
  rows. There they are cut into runs of at most ``RUN_ROWS`` rows, whose start
  states are found without replaying them all (``run_starts``); each run is then
  replayed like a short key.

The transfer function of a run is kept piece by piece. A state in [2^k, 2^(k+1)) is on
level k. Rows that need less than 2^k are accepted there and only subtract; rows that
need more decide something, and so does falling below 2^k. On the breakpoints
[lo, hi) of a level, with lo = 2^k plus the sum of the small needs and hi the least
need of a large row plus the small ones before it, the run therefore subtracts just that
sum; outside, it must be replayed, which leaves a state of a lower level. So a run has
one (sum, lo, hi) a level, at most 63 whatever the stock; neighbouring runs compose
by sums, maxima and minima; and a key replays at most one run a level to find
all its starts, in that many rounds over a row a run.

A step is a pair of column expressions: the refusal code of a row at a state,
and the state after it.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kitlend.session import stored

#: Rows replayed as one array.
RUN_ROWS = 512
#: Rows of long keys that one range partition is meant to hold.
RANGE_ROWS = 200_000
#: Long keys (a row each) up to which a round's states are broadcast.
BROADCAST_KEYS = 100_000
_FAR = 1 << 62


@dataclass(frozen=True)
class FoldSpec:
    """A per-key sequential step over rows with the ``inputs`` columns.

    ``code(state, row)`` is NULL for an accepted row, else the refusal reason;
    ``used(state, row)`` is the state after an accepted row. ``need(row)`` says the
    same for states above 0: a row is accepted from its need upwards and uses just
    that, a need of 0 uses all that is left, and NULL never uses anything. States
    of 0 and below stay as they are.
    """
    inputs: tuple[str, ...]
    need: Callable[[Column], Column]
    code: Callable[[Column, Column], Column]
    used: Callable[[Column, Column], Column]

    def after(self, state: Column, row: Column) -> Column:
        return F.when(self.code(state, row).isNull(), self.used(state, row)).otherwise(state)


def range_partitions(rows: int) -> int:
    """Range partitions for so many counted rows."""
    return max(1, -(-rows // RANGE_ROWS))


def _replayed(runs: DataFrame, start: str, spec: FoldSpec, columns: list[str]) -> DataFrame:
    """One row per element of ``_rows`` with state_before, state_after, code."""
    none = F.array().cast("array<struct<b:bigint,a:bigint,c:string>>")

    def move(acc: Column, row: Column) -> Column:
        s = acc["s"]
        now = F.struct(s.alias("b"), spec.after(s, row).cast("long").alias("a"), spec.code(s, row).alias("c"))
        return F.struct(now["a"].alias("s"), F.concat(acc["out"], F.array(now)).alias("out"))

    steps = F.aggregate("_rows", F.struct(F.col(start).cast("long").alias("s"), none.alias("out")), move)["out"]
    return (runs.select(F.explode(F.arrays_zip(F.col("_rows").alias("r"), steps.alias("s"))).alias("e"))
            .select(*[F.col(f"e.r.{c}").alias(c) for c in columns], F.col("e.s.b").alias("state_before"),
                    F.col("e.s.a").alias("state_after"), F.col("e.s.c").alias("code")))


def _level(state: Column) -> Column:
    """k for a state in [2^k, 2^(k+1))."""
    return F.length(F.bin(state)) - 1


def _pieces(needs: Column, start: Column) -> Column:
    """(t, lo, hi) of a run for each level up to that of ``start``."""
    def piece(k: Column) -> Column:
        least = F.pow(F.lit(2.0), k).cast("long")

        def add(acc: Column, n: Column) -> Column:
            small = (n > 0) & (n < least)
            return F.struct(F.when(small, acc["t"] + n).otherwise(acc["t"]).alias("t"),
                            F.when(small, acc["hi"]).otherwise(F.least(acc["hi"], acc["t"] + n)).alias("hi"))
        sums = F.aggregate(needs, F.struct(F.lit(0).cast("long").alias("t"), F.lit(_FAR).cast("long").alias("hi")), add)
        return F.struct(sums["t"].alias("t"), (sums["t"] + least).alias("lo"), sums["hi"].alias("hi"))
    return F.when(start > 0, F.transform(F.sequence(F.lit(0), _level(start)), piece))


def _before(*keys: str, order: str):
    return Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)


def _sized(df: DataFrame, n: int) -> DataFrame:
    """A table of a row a key, broadcast if its counted rows are few."""
    return F.broadcast(df) if n <= BROADCAST_KEYS else df


def run_starts(runs: DataFrame, spec: FoldSpec) -> DataFrame:
    """_key, _part, _blk, _state: the start state of each run, from runs (_key,
    _part, _blk, _start, _rows) in the order of (_part, _blk).

    A segment is a stretch of a key's runs that only subtract. Each round finds, for
    all keys at once, the first run that its segment's pieces don't cover, by
    prefix sums inside range partitions and then over them (a row a partition);
    that run is replayed, and the next segment starts behind it on a lower level.
    """
    needs = F.filter(F.transform("_rows", lambda r: spec.need(r).cast("long")), lambda n: n.isNotNull())
    maps = (runs.select("_key", "_part", "_blk", "_start", needs.alias("_needs"))
            .select("_key", "_part", "_blk", _pieces(F.col("_needs"), F.col("_start").cast("long")).alias("_pieces"))
            .checkpoint(eager=True))
    heads = runs.groupBy("_key").agg(F.min("_start").cast("long").alias("_s")).select(
        "_key", F.lit(-1).alias("_part"), F.lit(-1).cast("long").alias("_blk"), "_s").checkpoint(eager=True)
    segments, last = heads, heads
    while n := last.where(F.col("_s") > 0).count():
        now = last.where(F.col("_s") > 0).select(F.col("_key").alias("_of"), F.struct("_part", "_blk").alias("_from"), "_s")
        rest = (maps.join(_sized(now, n), F.col("_key") == F.col("_of"))
                .where(F.struct("_part", "_blk") > F.col("_from"))
                .select("_key", "_part", "_blk", "_s", F.get("_pieces", _level(F.col("_s"))).alias("_p"))
                .withColumn("_gone", F.coalesce(F.sum("_p.t").over(_before("_key", "_part", order="_blk")), F.lit(0))))
        parts = rest.groupBy("_key", "_part").agg(
            F.min("_s").alias("_s"), F.sum(F.col("_p.t").cast("decimal(38,0)")).alias("_t"),
            F.max(F.col("_p.lo") + F.col("_gone")).alias("_lo"), F.min(F.col("_p.hi") + F.col("_gone")).alias("_hi"))
        at = F.col("_s") - F.coalesce(F.sum("_t").over(_before("_key", order="_part")), F.lit(0))
        stop = (parts.withColumn("_at", at).where((F.col("_at") < F.col("_lo")) | (F.col("_at") >= F.col("_hi")))
                .groupBy("_key").agg(F.min(F.struct("_part", F.col("_at").cast("long").alias("at"))).alias("_e"))
                .select(F.col("_key").alias("_of"), F.col("_e._part").alias("_ofpart"), F.col("_e.at").alias("_at")))
        inside = (rest.join(stop, (F.col("_key") == F.col("_of")) & (F.col("_part") == F.col("_ofpart")))
                  .withColumn("_state", F.col("_at") - F.col("_gone"))
                  .where((F.col("_state") < F.col("_p.lo")) | (F.col("_state") >= F.col("_p.hi")))
                  .groupBy("_key", "_part").agg(F.min(F.struct("_blk", "_state")).alias("_e"))
                  .select(F.col("_key").alias("_of"), F.col("_part").alias("_ofpart"), F.col("_e._blk").alias("_ofblk"),
                          F.col("_e._state").alias("_state")))
        here = ((F.col("_key") == F.col("_of")) & (F.col("_part") == F.col("_ofpart")) & (F.col("_blk") == F.col("_ofblk")))
        last = runs.join(_sized(inside, n), here).select("_key", "_part", "_blk", F.aggregate(
            "_rows", F.col("_state"), lambda s, row: spec.after(s, row).cast("long")).alias("_s")).checkpoint(eager=True)
        segments = segments.unionByName(last)
    own = segments.groupBy(F.col("_key").alias("_of")).agg(  # at most one a level
        F.collect_list(F.struct("_part", "_blk", "_s")).alias("_segments"))
    seg = F.array_max(F.filter("_segments", lambda x: F.struct(x["_part"], x["_blk"]) < F.struct("_part", "_blk")))
    placed = (maps.join(_sized(own, heads.count()), F.col("_key") == F.col("_of")).withColumn("_g", seg)
              .select("_key", "_part", "_blk", F.col("_g._s").alias("_s"), F.col("_g._part").alias("_gpart"),
                      F.col("_g._blk").alias("_gblk"),
                      F.when(F.col("_g._s") > 0, F.get("_pieces", _level(F.col("_g._s")))["t"]).otherwise(0).alias("_t")))
    group = ("_key", "_part", "_gpart", "_gblk")
    inner = F.coalesce(F.sum("_t").over(_before(*group, order="_blk")), F.lit(0))
    totals = placed.groupBy(*group).agg(F.sum(F.col("_t").cast("decimal(38,0)")).alias("_t"))
    outer = F.coalesce(F.sum("_t").over(_before("_key", "_gpart", "_gblk", order="_part")), F.lit(0))
    offsets = totals.select(*[F.col(c).alias(f"_o{c}") for c in group], outer.alias("_gone"))
    same = [F.col(c) == F.col(f"_o{c}") for c in group]
    return (placed.withColumn("_in", inner).join(offsets, same[0] & same[1] & same[2] & same[3])
            .select("_key", "_part", "_blk", (F.col("_s") - F.col("_in") - F.col("_gone")).cast("long").alias("_state")))


def _long_keys(events: DataFrame, key: str, run_rows: int) -> DataFrame | None:
    """_k, _n of the keys of more than ``run_rows`` rows; None without any. Counted by the
    hash of the key first, of which no fewer rows than of the key are found."""
    of = F.xxhash64(key)
    many = (events.groupBy(of.alias("_h")).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > run_rows)
            .select("_h").checkpoint(eager=True))
    if many.isEmpty():
        return None
    return (events.withColumn("_of", of).join(many, F.col("_of") == F.col("_h"), "left_semi")
            .groupBy(F.col(key).alias("_k")).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > run_rows)
            .checkpoint(eager=True))


def ordered_fold(events: DataFrame, key: str, order: list[str], start_col: str,
                 spec: FoldSpec, partitions: int | None = None, run_rows: int = RUN_ROWS,
                 counted: DataFrame | None = None) -> DataFrame:
    """Decide every row of ``events`` in (key, order) order.

    ``events`` must carry ``start_col``, the key's start state, and unique
    ``order`` values within a key; pass it checkpointed or cheap to read, since it
    is counted first. Where ``events`` is a join on the key, pass the stored rows that
    it was joined from as ``counted``: short keys are then gathered where the join dealt
    them, and only with long keys is the join stored. Adds ``state_before``,
    ``state_after`` (long; null from a null start) and ``code`` (string) and drops ``start_col``.
    """
    columns = [c for c in events.columns if c != start_col]
    rows = F.array_sort(F.collect_list(F.struct(*order, *[c for c in columns if c not in order])))
    sizes = _long_keys(events if counted is None else counted, key, run_rows)
    long_rows = sizes.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0] if sizes is not None else 0
    if not long_rows:
        # dealt by key before they are gathered: arrays of few rows gathered on both sides only cost sorts
        dealt = events.repartition(key) if counted is None else events
        runs = dealt.groupBy(key).agg(F.min(start_col).alias("_start"), rows.alias("_rows"))
        return _replayed(runs, "_start", spec, columns)

    if counted is not None:
        events = stored(events, "fold")
    short = events.join(sizes, F.col(key) == F.col("_k"), "left_anti")
    short = short.repartition(key).groupBy(key).agg(F.min(start_col).alias("_start"), rows.alias("_rows"))
    n = partitions or range_partitions(long_rows)
    ranged = (events.join(sizes, F.col(key) == F.col("_k"), "left_semi")
              .repartitionByRange(n, F.col(key), *[F.col(c) for c in order])
              .withColumn("_part", F.spark_partition_id()))
    place = F.row_number().over(Window.partitionBy("_part", key).orderBy(*order)) - 1
    runs = (ranged.withColumn("_blk", F.floor(place / run_rows))
            .groupBy(F.col(key).alias("_key"), "_part", "_blk")
            .agg(F.min(start_col).alias("_start"), rows.alias("_rows"))
            .checkpoint(eager=True))
    starts = run_starts(runs, spec).select(*[F.col(c).alias(f"_s{c}") for c in ("_key", "_part", "_blk")], "_state")
    long = runs.join(starts, (F.col("_key") == F.col("_s_key")) & (F.col("_part") == F.col("_s_part"))
                     & (F.col("_blk") == F.col("_s_blk")))
    return _replayed(short, "_start", spec, columns).unionByName(_replayed(long, "_state", spec, columns))


# ---------------------------------------------------------------- steps

def _admit_code(s: Column, r: Column) -> Column:
    return F.when(r["qty"] > s, "stock").when(~r["user_known"], "user")


ADMISSION = FoldSpec(inputs=("qty", "user_known"), need=lambda r: F.when(r["user_known"], r["qty"]),
                     code=_admit_code, used=lambda s, r: s - r["qty"])

CLOSED = -1


def _take(s: Column, r: Column) -> Column:
    """A missing, zero or negative quantity means all that is left."""
    return F.when(r["return_qty"] > 0, r["return_qty"].cast("long")).otherwise(s)


def _settle_code(s: Column, r: Column) -> Column:
    return F.when(s == CLOSED, "closed").when(s <= 0, "fully_returned").when(_take(s, r) > s, "over")


def _settle_used(s: Column, r: Column) -> Column:
    left = s - _take(s, r)
    return F.when(left == 0, F.lit(CLOSED).cast("long")).otherwise(left)


SETTLEMENT = FoldSpec(inputs=("return_qty",), need=lambda r: F.when(r["return_qty"] > 0, r["return_qty"]).otherwise(0),
                      code=_settle_code, used=_settle_used)
