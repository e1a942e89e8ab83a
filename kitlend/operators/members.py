"""Member resolution from scanned codes.

The reference matches a code against four columns with an OR predicate, then
falls back to a hash column. An OR join plans as a nested loop, so here each
member's keys are unpivoted to (key, rank, user) rows and every scan probes
with its code and its SHA-256: one equi-join on the key, then the lowest rank
(then the lowest id) per scan through a map-side-combined ``min``. A code
scanned very often only skews the probe side, which AQE's skew join splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kitlend.functions.codes import with_code

# Fixed match order: the four direct keys, then the hash fallback.
MATCH_RANKS = (("id", 1), ("qr_code_value", 2), ("student_id", 3), ("citizen_id", 4),
               ("student_id_hash", 5))


def _rank_names():
    return F.create_map(*[F.lit(x) for r in MATCH_RANKS for x in (r[1], r[0])])


def member_keys(users: DataFrame) -> DataFrame:
    """(key, rank, user_id) for every non-empty key of every member."""
    entries = F.array(*[F.struct(F.col(c).cast("string").alias("key"), F.lit(r).alias("rank"))
                        for c, r in MATCH_RANKS])
    return (users.select(F.col("id").alias("user_id"), F.explode(entries).alias("e"))
            .select(F.col("e.key").alias("key"), F.col("e.rank").alias("rank"), "user_id")
            .where(F.col("key").isNotNull() & (F.col("key") != "")))


def resolve_members(scans: DataFrame, users: DataFrame) -> DataFrame:
    """Per scan: normalised code, matched member (or NULL) and the key that matched.
    Empty codes match nothing (a deliberate difference from ``COALESCE(col,'') = ''``)."""
    s = with_code(scans.select("scan_id", "raw"), "raw", "code")
    # The empty-code filter sits above the generator on purpose: pushed below
    # the staged projections it would inline the whole normaliser into it.
    probes = (s.select("scan_id", F.explode(F.array(
                  F.struct(F.col("code").alias("probe"), F.lit(False).alias("hashed"),
                           F.col("code").alias("src")),
                  F.struct(F.sha2(F.col("code"), 256).alias("probe"), F.lit(True).alias("hashed"),
                           F.col("code").alias("src"))
              )).alias("p"))
              .where(F.col("p.src") != "")
              .select("scan_id", "p.probe", "p.hashed"))
    keys = member_keys(users).withColumn("k_hashed", F.col("rank") == 5)
    m = probes.join(keys, (probes["probe"] == keys["key"]) & (probes["hashed"] == keys["k_hashed"]))
    best = (m.groupBy("scan_id")
            .agg(F.min(F.struct("rank", "user_id")).alias("b"))
            .select(F.col("scan_id").alias("_sid"), F.col("b.rank").alias("_rank"),
                    F.col("b.user_id").alias("user_id")))
    u = users.select(F.col("id").alias("_uid"), "full_name", "member_type")
    j = (s.join(best, s["scan_id"] == best["_sid"], "left")
         .join(u, F.col("user_id") == u["_uid"], "left"))
    return j.select("scan_id", "raw", "code", "user_id",
                    _rank_names()[F.col("_rank")].alias("matched_by"), "full_name", "member_type")
