"""Operators 11 to 13 against brute-force versions."""
import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from kitlend.llm import bitplanes, codes, linebits
from kitlend.llm.common import stored

VECTORS = "vec_id long, embedding array<float>, label int"


def usable(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


def nearest(x, books):
    """Index and squared distance by trying every entry; the lower index on ties."""
    d = [sum((a - b) ** 2 for a, b in zip(x, c)) for c in books]
    return d.index(min(d)), min(d)


def lloyd(rows, books, rounds):
    for r in range(rounds + 1):
        found = [nearest(x, books) for x in rows]
        if r < rounds:
            for e in range(len(books)):
                own = [x for x, (i, _) in zip(rows, found) if i == e]
                if own:
                    books[e] = [sum(c) // len(own) for c in zip(*own)]
    return found, books


def odd_vectors(seed, n, width=64):
    rnd = random.Random(seed)
    rows = [(i, [rnd.choice((-1, 1)) * rnd.random() ** 2 for _ in range(width)], rnd.choice((1, 2, 2, 2, None)))
            for i in range(n)]
    same = rows[7][1]
    rows += [(1000 + i, list(same), 3) for i in range(n // 2)]  # a third are copies
    rows += [(7, list(same), 1), (9, list(rows[3][1]), 1), (2000, None, 1), (2001, [], 1), (2002, [None] * width, 1),
             (2003, [float("nan")] * width, 1), (2004, [float("inf")] * width, 2), (2005, [0.5] * (width - 1), 2)]
    return rows


# --- vector codes ----------------------------------------------------------------

def brute_codes(rows, scale=4096, parts=8):
    kept = [(i, [math.floor(scale * np.float32(x).item()) for x in v], lab) for i, v, lab in rows if usable(v)]
    w = -(-max(len(q) for _, q, _ in kept) // parts)
    kept = [(i, q, q + [0] * (parts * w - len(q)), lab) for i, q, lab in kept]
    start = [q for _, _, q in sorted((i, o, q) for i, o, q, _ in kept)[:16]]
    code, error, books = [""] * len(kept), [0] * len(kept), []
    for p in range(0, parts * w, w):
        found, book = lloyd([q[p:p + w] for _, _, q, _ in kept], [q[p:p + w] for q in start], 6)
        books += [str(x) for e in book for x in e]
        for r, (e, d) in enumerate(found):
            code[r] += f"{e:02x}"
            error[r] += d
    per = defaultdict(int)
    for (_, _, _, lab), d in zip(kept, error):
        per[lab] += d
    sha = hashlib.sha256(",".join(books).encode()).hexdigest()
    return Counter((i, c, d, per[lab], sha) for (i, _, _, lab), c, d in zip(kept, code, error))


def test_codes_equal_brute_force(spark):
    rows = odd_vectors(1, 60)
    df = spark.createDataFrame(rows, VECTORS).repartition(5).withColumn("code", F.lit("clash")).withColumn("far", F.lit(1))
    got = codes.coded_vectors(df).select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect()
    assert Counter(map(tuple, got)) == brute_codes(rows)


def test_codes_of_few_empty_and_large_vectors(spark):
    few = [(1, [1.0, -2.0, 0.5], 1), (1, [1.0, -2.0, 0.5], 1), (None, [3.0], None)]
    got = codes.coded_vectors(spark.createDataFrame(few, VECTORS))
    assert sorted((r.vec_id or -1, r.error) for r in got.collect()) == [(-1, 0), (1, 0), (1, 0)]
    assert codes.coded_vectors(spark.createDataFrame([], VECTORS)).collect() == []
    with pytest.raises(ValueError, match="64 bits"):
        codes.coded_vectors(spark.createDataFrame([(1, [4e5] * 64, 1)], VECTORS))


def test_bounds_never_exceed_distances_and_prune():
    rng = np.random.default_rng(3)
    rows = rng.integers(-2000, 2000, (3000, 8)) // rng.integers(1, 40, (3000, 1))
    book = rows[:16].copy()
    pivots = codes.pivots_of(book)
    far = codes.distances(rows, pivots).astype(np.float32)
    between = codes.distances(book, pivots).T
    exact = ((rows[:, None] - book[None]) ** 2).sum(2)
    assert (codes.lower_bounds(far, between) ** 2 * (1 - codes.SLACK) <= exact).all()
    index, best, tried = codes.nearest(rows, far, book, between)
    assert (index == exact.argmin(1)).all() and (best == exact.min(1)).all()
    assert tried < 0.7 * exact.size


# --- bit planes --------------------------------------------------------------------

def test_popcount_dots_are_exact():
    rng = np.random.default_rng(4)
    for top in (1, 5, 300, 100_000):
        x, c = rng.integers(-top, top + 1, (50, 64)), rng.integers(-top, top + 1, (7, 64))
        x[0], c[0] = -top, top
        bits = bitplanes.bits_for(top)
        assert (bitplanes.dots(bitplanes.planes_of(x, bits), bitplanes.planes_of(c, bits)) == x @ c.T).all()


def brute_clusters(rows):
    kept = [(i, [math.floor(256 * np.float32(x).item()) for x in v]) for i, v, _ in rows if usable(v) and len(v) == 64]
    def order(r):
        return (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest(), r[1])
    found, books = lloyd([q for _, q in kept], [q for _, q in sorted(kept, key=order)[:40]], 5)
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in books]
    per = defaultdict(int)
    for c, d in found:
        per[c] += d
    whole = sum(per.values())
    return Counter((i, c, d, per[c], whole, sha[c]) for (i, _), (c, d) in zip(kept, found))


def test_clusters_equal_brute_force(spark):
    rows = odd_vectors(5, 90) + [(None, [0.25] * 64, None)]
    df = spark.createDataFrame(rows, VECTORS).repartition(5).withColumn("cluster", F.lit("clash")).withColumn("of", F.lit(1))
    got = bitplanes.clustered_vectors(df).select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
    assert Counter(map(tuple, got.collect())) == brute_clusters(rows)


def test_few_and_no_vectors_cluster(spark):
    few = [(1, [1.0] * 64, 1), (2, [-1.0] * 64, 1), (2, [-1.0] * 64, 1)]
    got = bitplanes.clustered_vectors(spark.createDataFrame(few, VECTORS)).collect()
    assert len(got) == 3 and all(r.distance == 0 and r.inertia == 0 for r in got)
    assert bitplanes.clustered_vectors(spark.createDataFrame([], VECTORS)).collect() == []


# --- lines -------------------------------------------------------------------------

def key(line):
    return re.sub("[A-Z]", lambda m: m.group().lower(), line.strip(" \t\n\x0b\x0c\r"))


def brute_lines(rows, min_docs=10, keep_first=False):
    """doc_id, n_lines, n_dropped, text of each row."""
    split = [(i, (t or "").split("\n")) for i, t in rows]
    held, first = Counter(), {}
    for i, lines in sorted(split, key=lambda r: (r[0] is not None, r[0] or 0)):
        held.update({key(x) for x in lines})
        for n, x in enumerate(lines):
            first.setdefault(key(x), (i, tuple(lines), n))
    out = []
    for i, lines in split:
        kept = [x for n, x in enumerate(lines) if not key(x) or held[key(x)] < min_docs
                or keep_first and first[key(x)] == (i, tuple(lines), n)]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return Counter(out)


@pytest.fixture(scope="module")
def line_rows():
    rnd = random.Random(6)
    words = ["Alpha beta", " ALPHA BETA\t", "x", "", " ", "Été", "été", "tail\r", "own", " nbsp"]
    rows = [(i, "\n".join(rnd.choice(words) + rnd.choice(["", "", str(rnd.randrange(30))]) for _ in range(rnd.randrange(9))))
            for i in range(90)]
    rows += [(200, None), (201, ""), (202, "\n\n"), (203, "x\n" * 5000 + "own long\nx"), (204, "hot\n" * 3),
             *[(300 + i, "hot\nline %d\nhot" % (i % 4)) for i in range(60)],
             *[(400, "copied row\nkeep")] * 12, (None, "hot\nnull id"), (None, None)]
    return rows


@pytest.mark.parametrize("keep_first", [False, True])
def test_lines_equal_brute_force(make_docs, line_rows, keep_first):
    docs = make_docs(line_rows, clash=True).withColumn("hash", F.lit("clash")).withColumn("pos", F.lit(1)).repartition(7)
    got = linebits.without_common_lines(docs, keep_first=keep_first).collect()
    assert Counter(map(tuple, got)) == brute_lines(line_rows, keep_first=keep_first)


def test_bitmaps_are_runs(make_docs):
    rows = [(i, "a\na\nown %d\na\nb" % i) for i in range(10)]
    maps = linebits.keep_bitmaps(make_docs(rows)).collect()
    assert len(maps) == 10
    assert all([tuple(r) for r in m.drop_runs] == [(0, 2), (3, 5)] for m in maps)
    assert linebits.without_common_lines(make_docs([])).collect() == []


def test_line_plan_has_no_python_and_one_exchange_a_purpose(make_docs, line_rows):
    """The range partitioning serves the stream that marks first occurrences."""
    lines = stored(linebits.line_hashes(make_docs(line_rows)), "test-lines")
    plan = linebits.common_hashes(lines)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange rangepartitioning") == 1 and plan.count("Exchange hashpartitioning") == 1
    whole = linebits.cleaned_documents(make_docs(line_rows).limit(5))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan + whole)
