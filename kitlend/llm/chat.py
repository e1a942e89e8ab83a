"""Chat formatting by minimum-cost role repair (operator 1).

A legal conversation is an optional system turn, then user and assistant turns
in alternation, the user first; it may end on either. Given turns are repaired
at least cost over the automaton of the last written role (nothing, system,
user, assistant): a turn is written under its own role, relabelled, merged into
the turn before it, or preceded by an empty turn that makes it legal.

The dynamic programme is a product of (min, +) matrices, so a conversation of
any length is worked in pieces of at most ``PIECE_TURNS`` turns:

1. rows are range-partitioned by conversation and order and numbered there;
2. every piece gives its 4 x 4 matrix; where a conversation has several pieces,
   one small row each, they are multiplied from the end, which gives each piece
   the least cost to go from each of its end states;
3. with that, every piece walks forward from each start state, taking at each
   turn the first option of least cost; the pieces' maps of start to end state,
   chained from the front, give each its start state, and its walk is the
   repair. The walk depends on costs to go alone, not on where pieces end.

One row a given turn comes back, so no conversation is ever one value: its
``fragment`` fields in ``position`` order, joined, are the rendered text.

Order: turn (null first), then role, then the text's first 64 characters, then a hash
of the text; on any number of partitions. Roles are trimmed and made
small, with common other names; any other role, or null, is unknown and is cheap
to label. Null text is empty. Rows with a null conv_id are one conversation.
Repeated rows are turns of their own. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kitlend.llm.common import own_columns, prepare, stored

PIECE_TURNS = 4096
STATES = ("", "system", "user", "assistant")
OTHER_NAMES = {"human": "user", "prompter": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant",
               "ai": "assistant", "developer": "system"}
MERGE, INSERT = 1, 2
#: Cost of writing a turn of role code (row; 0 is unknown) as state (column).
LABEL = ((9, 1, 1, 1), (9, 0, 2, 4), (9, 3, 0, 3), (9, 3, 3, 0))
LEGAL = {0: (1, 2), 1: (2,), 2: (3,), 3: (2,)}
FAR = 1 << 50


def _options() -> list[list[list[tuple[int, int, str]]]]:
    """For each role code and state: (cost, next state, how), in order of choice."""
    out = []
    for role in range(4):
        per = []
        for s in range(4):
            found = {}
            for x in (1, 2, 3):
                ways = []
                if x in LEGAL[s]:
                    ways.append((LABEL[role][x], 0, "keep"))
                if x == s:
                    ways.append((LABEL[role][x] + MERGE, 1, "merge"))
                if any(y in LEGAL[s] and x in LEGAL[y] for y in (2, 3)):
                    ways.append((LABEL[role][x] + INSERT, 2, "insert"))
                if ways:
                    found[x] = min(ways)
            per.append([(c, x, how) for x, (c, _, how) in sorted(found.items(), key=lambda f: (f[1], f[0]))])
        out.append(per)
    return out


OPTIONS = _options()


def cost_to_go(roles: list[int], after: list[int]) -> list[list[int]]:
    """Least cost from each state before each turn (and after the last) on."""
    out = [list(after)]
    for role in reversed(roles):
        nxt = out[-1]
        out.append([min((c + nxt[x] for c, x, _ in OPTIONS[role][s]), default=FAR) for s in range(4)])
    return out[::-1]


def matrix(roles: list[int]) -> list[int]:
    """The piece's least costs, row by start state, column by end state."""
    cols = [cost_to_go(roles, [0 if s == end else FAR for s in range(4)])[0] for end in range(4)]
    return [min(cols[e][s], FAR) for s in range(4) for e in range(4)]


def walk(roles: list[int], after: list[int], start: int) -> list[tuple[int, str, int]]:
    """(state, how, cost) of each turn on the least-cost walk from ``start``."""
    togo, s, out = cost_to_go(roles, after), start, []
    for i, role in enumerate(roles):
        c, x, how = min(OPTIONS[role][s], key=lambda o: o[0] + togo[i + 1][o[1]])
        out.append((x, how, c))
        s = x
    return out


def _matrices(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for p in batches:
        yield pd.DataFrame({"conv": p["conv"], "part": p["part"], "blk": p["blk"],
                            "m": [matrix(list(r)) for r in p["roles"]]})


def _suffixes(pdf: pd.DataFrame) -> pd.DataFrame:
    """Costs to go after each piece of one conversation."""
    pdf = pdf.sort_values(["part", "blk"])
    after, out = np.zeros(4, np.int64), []
    for m in pdf["m"].iloc[::-1]:
        out.append(after.tolist())
        after = np.minimum((np.array(m).reshape(4, 4) + after).min(1), FAR)
    return pd.DataFrame({"conv": pdf["conv"], "part": pdf["part"], "blk": pdf["blk"], "after": out[::-1]})


def _ends(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for p in batches:
        yield pd.DataFrame({
            "conv": p["conv"], "part": p["part"], "blk": p["blk"], "n": [len(r) for r in p["roles"]],
            "ends": [[walk(list(r), list(a), s)[-1][0] for s in range(4)] for r, a in zip(p["roles"], p["after"], strict=True)]})


def _starts(pdf: pd.DataFrame) -> pd.DataFrame:
    """Start state and rank of the first turn of each piece of one conversation."""
    pdf = pdf.sort_values(["part", "blk"])
    s, n, out = 0, 0, []
    for ends, size in zip(pdf["ends"], pdf["n"], strict=True):
        out.append((s, n))
        s, n = ends[s], n + size
    last = [False] * (len(out) - 1) + [True]
    return pd.DataFrame({"conv": pdf["conv"], "part": pdf["part"], "blk": pdf["blk"],
                         "start": [a for a, _ in out], "before": [b for _, b in out], "last": last})


def _walks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for p in batches:
        rows = []
        for r, a, s in zip(p["roles"], p["after"], p["start"], strict=True):
            w = walk(list(r), list(a), int(s))
            rows.append([{"state": x, "how": how, "cost": c, "from": f}
                         for (x, how, c), f in zip(w, [int(s), *(x for x, _, _ in w[:-1])], strict=True)])
        yield pd.DataFrame({"conv": p["conv"], "part": p["part"], "blk": p["blk"], "before": p["before"],
                            "last": p["last"], "walk": rows})


def role_code(role):
    """Code of a role column: its index in STATES, 0 for unknown."""
    name = F.lower(F.trim(role))
    for other, own in OTHER_NAMES.items():
        name = F.when(name == other, own).otherwise(name)
    return F.coalesce(*[F.when(name == s, i) for i, s in enumerate(STATES) if s], F.lit(0))


def format_chats(turns: DataFrame, piece_turns: int = PIECE_TURNS) -> DataFrame:
    """conv_id, position, turn, role, new_role, action, relabelled, cost,
    fragment: one row a given turn."""
    prepare(turns.sparkSession)
    own = own_columns(turns, "conv_id", "turn", "role", "text").withColumn("text", F.coalesce("text", F.lit("")))
    own = own.withColumn("copy", F.monotonically_increasing_id())  # equal rows needn't meet in one partition
    order = ["turn", "role", F.substring("text", 1, 64), F.xxhash64("text"), "copy"]
    rows = stored(own.repartitionByRange("conv_id", *order).withColumn("part", F.spark_partition_id()), "chat-turns")
    inside = Window.partitionBy("part", "conv_id").orderBy(*order)
    rows = stored(rows.withColumn("rn", F.row_number().over(inside) - 1).withColumn("code", role_code(F.col("role")))
                  .withColumn("blk", F.floor(F.col("rn") / piece_turns).cast("int")), "chat-rows")
    by_rank = F.array_sort(F.collect_list(F.struct("rn", "code")))
    pieces = stored(rows.groupBy(F.col("conv_id").alias("conv"), "part", "blk")
                    .agg(F.transform(by_rank, lambda x: x["code"]).alias("roles")), "chat-pieces")
    many = pieces.groupBy(F.col("conv").alias("of")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
    long = pieces.join(many, F.col("conv").eqNullSafe(F.col("of")), "left_semi")
    single = pieces.join(many, F.col("conv").eqNullSafe(F.col("of")), "left_anti")
    ctype = turns.schema["conv_id"].dataType.simpleString()
    key = f"conv {ctype}, part int, blk int"
    after = stored(long.mapInPandas(_matrices, f"{key}, m array<long>").groupBy("conv")
                   .applyInPandas(_suffixes, f"{key}, after array<long>"), "chat-after")

    def with_pieces(extra: DataFrame, *cols: str) -> DataFrame:
        e = extra.select(F.col("conv").alias("ec"), F.col("part").alias("ep"), F.col("blk").alias("eb"), *cols)
        return long.join(e, F.col("conv").eqNullSafe(F.col("ec")) & (F.col("part") == F.col("ep"))
                         & (F.col("blk") == F.col("eb"))).drop("ec", "ep", "eb")

    starts = stored(with_pieces(after, "after").mapInPandas(_ends, f"{key}, n long, ends array<int>").groupBy("conv")
                    .applyInPandas(_starts, f"{key}, start int, before long, last boolean"), "chat-starts")
    e = after.select(F.col("conv").alias("ac"), F.col("part").alias("ap"), F.col("blk").alias("ab"), "after")
    placed = with_pieces(starts, "start", "before", "last").join(
        e, F.col("conv").eqNullSafe(F.col("ac")) & (F.col("part") == F.col("ap")) & (F.col("blk") == F.col("ab"))).drop(
        "ac", "ap", "ab")
    alone = single.select("*", F.lit(0).alias("start"), F.lit(0).cast("long").alias("before"),
                          F.lit(True).alias("last"), F.array(*[F.lit(0).cast("long")] * 4).alias("after"))
    step = "array<struct<state:int,how:string,cost:int,from:int>>"
    done = (alone.unionByName(placed).mapInPandas(_walks, f"{key}, before long, last boolean, walk {step}")
            .select("conv", F.col("part").alias("wp"), "blk", "before", F.col("last").alias("in_last"),
                    F.size("walk").alias("n"), F.posexplode("walk").alias("i", "w"))
            .select("conv", "wp", (F.col("blk").cast("long") * piece_turns + F.col("i")).alias("wrn"),
                    (F.col("before") + F.col("i")).alias("position"), "w",
                    (F.col("in_last") & (F.col("i") == F.col("n") - 1)).alias("closes")))
    both = rows.join(done, F.col("conv_id").eqNullSafe(F.col("conv")) & (F.col("part") == F.col("wp"))
                     & (F.col("rn") == F.col("wrn")))
    name = lambda c: F.element_at(F.array(*[F.lit(s) for s in STATES]), c + 1)
    head = lambda r: F.concat(F.lit("<|"), r, F.lit("|>\n"))
    end = F.lit("\n<|end|>\n")
    how, state = F.col("w.how"), F.col("w.state")
    empty = F.when(state == 2, F.lit("assistant")).otherwise(F.lit("user"))
    closing = F.when(F.col("w.from") == 0, F.lit("")).otherwise(end)
    opening = F.when(how == "insert", F.concat(closing, head(empty), end, head(name(state)))).otherwise(
        F.concat(closing, head(name(state))))
    fragment = F.concat(F.when(how == "merge", F.lit("\n")).otherwise(opening), F.col("text"),
                        F.when(F.col("closes"), end).otherwise(F.lit("")))
    return both.select("conv_id", "position", "turn", "role", name(state).alias("new_role"), how.alias("action"),
                       (F.col("code") != state).alias("relabelled"), F.col("w.cost").alias("cost"),
                       fragment.alias("fragment"))
