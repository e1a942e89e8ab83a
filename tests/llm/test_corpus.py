"""Operators 4, 5, 6 and 9 against brute-force versions."""
import itertools
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from kitlend.llm import common, mixing, neardup, quality, toxicity
from kitlend.llm.components import components

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def corpus(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


# --- mixing ------------------------------------------------------------------

def brute_targets(sizes, weights, most=3):
    """Clamp, reshare by weight, again until none is above."""
    total, fixed = sum(sizes.values()), {}
    while True:
        free = {s: weights[s] for s in sizes if s not in fixed}
        if not free:
            return fixed
        rest = total - sum(fixed.values())
        want = {s: rest * w / sum(free.values()) for s, w in free.items()}
        over = {s: most * sizes[s] for s in free if want[s] > most * sizes[s]}
        if not over:
            return fixed | want
        fixed |= over


def test_targets_and_repeats(make_docs):
    rows = [(i, "w " * (1 + i % 7), "en", s) for s, n in (("a", 40), ("b", 3), ("c", 500), ("d", 30), (None, 9))
            for i in range(1000 * ord((s or "z")[0]), 1000 * ord((s or "z")[0]) + n)]
    rows += [(9, None, "en", "a"), (10, "", "en", None)]
    got = mixing.mix_sources(make_docs(rows, clash=True)).collect()
    sizes = defaultdict(int)
    for _, t, _, s in rows:
        sizes[s] += len(WORD.findall(t or ""))
    order = sorted((s for s in sizes if s is not None), key=lambda s: s) + [None]
    want = brute_targets(sizes, {s: i % 3 + 1 for i, s in enumerate(order)})
    taken = defaultdict(int)
    assert len(got) == len(rows)
    for r in got:
        assert r.target == pytest.approx(want[r.source], rel=1e-12) and r.source_size == sizes[r.source]
        assert 0 <= r.copies <= 3
        taken[r.source] += r.size * r.copies
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 7
    again = mixing.mix_sources(make_docs(rows)).collect()
    key = lambda r: repr((r.doc_id, r.source, r.size))
    assert sorted(map(key, got)) == sorted(map(key, again))
    assert {key(r): r.copies for r in got} == {key(r): r.copies for r in again}


def test_mix_of_rows(make_docs):
    docs = make_docs([(i, "w " * 5, "en", "ab"[i % 10 == 0]) for i in range(200)])
    plan = {r.doc_id: r.copies for r in mixing.mix_sources(docs).collect()}
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    assert Counter(r.doc_id for r in mixed.collect()) == Counter({i: n for i, n in plan.items() if n})
    assert mixing.mix_sources(make_docs([])).collect() == []


# --- near duplicates -----------------------------------------------------------

def brute_classes(texts, threshold=0.8):
    """Classes by all pairs of texts; plain weights."""
    names, bags = {}, []
    for t in texts:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
        bag = Counter(tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))) if w else Counter()
        found = sorted((names.setdefault(x, len(names)), n) for x, n in bag.items())
        bags.append((np.array([i for i, _ in found], np.int64), np.array([n for _, n in found], np.int64)))
    sizes = [int(n.sum()) for _, n in bags]
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for a, b in itertools.combinations(range(len(texts)), 2):
        if (texts[a] or "") == (texts[b] or ""):
            parent[find(a)] = find(b)
        elif sizes[a] and min(sizes[a], sizes[b]) >= threshold * max(sizes[a], sizes[b]):
            _, i, j = np.intersect1d(bags[a][0], bags[b][0], assume_unique=True, return_indices=True)
            low = int(np.minimum(bags[a][1][i], bags[b][1][j]).sum())
            if low >= threshold * (sizes[a] + sizes[b] - low):
                parent[find(a)] = find(b)
    out = defaultdict(list)
    for i in range(len(texts)):
        out[find(i)].append(i)
    return sorted(map(tuple, out.values()))


def classes_of(rows):
    out = defaultdict(list)
    for r in rows:
        out[r.component].append(r.doc_id)
    return sorted(tuple(sorted(v)) for v in out.values())


def test_classes_equal_brute_force(spark, corpus):
    docs = corpus.select("doc_id", "text").collect()
    got = neardup.near_duplicate_classes(corpus).collect()
    ids = [r.doc_id for r in docs]
    want = [tuple(sorted(ids[i] for i in c)) for c in brute_classes([r.text for r in docs])]
    assert classes_of(got) == sorted(want)
    for r in got:
        assert r.kept == (r.doc_id == r.class_id)


def test_large_group_of_near_copies(make_docs):
    rng = np.random.default_rng(4)
    words = [f"w{i}" for i in rng.integers(0, 5000, 200)]
    rows = []
    for i in range(300):  # each changes one place of the same text
        w = list(words)
        w[int(rng.integers(0, 200))] = f"new{i}"
        rows.append((i, " ".join(w)))
    rows += [(1000 + i, " ".join(f"u{i}x{k}" for k in range(120))) for i in range(60)]
    got = neardup.near_duplicate_classes(make_docs(rows)).collect()
    assert classes_of(got) == sorted([tuple(range(300)), *((1000 + i,) for i in range(60))])


def test_pairs_in_large_buckets_of_other_texts(make_docs):
    """Near pairs among hundreds of texts that share a long passage and so their buckets."""
    rng = np.random.default_rng(5)
    words = lambda n: [f"w{x}" for x in rng.integers(0, 10**9, n)]
    passage, rows = words(150), []
    for i in range(120):
        both = words(16)
        rows += [(2 * i + k, " ".join(passage + both + words(14))) for k in range(2)]
    got = neardup.near_duplicate_classes(make_docs(rows)).collect()
    assert classes_of(got) == [(2 * i, 2 * i + 1) for i in range(120)]


def test_recall_by_class_size(spark):
    """On sf0.01 (1,000 texts with classes of two to hundreds): of the pairs of
    documents of one brute-force class, 0.9 or more share a class, at every size
    of class; and none that brute force keeps apart."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = docs.select("doc_id", "text").collect()
    got = {r.doc_id: r.component for r in neardup.near_duplicate_classes(docs).collect()}
    kept, whole = Counter(), Counter()
    brute_of = {}
    for c in brute_classes([r.text for r in rows]):
        size = min(len(c), 10)
        for i in c:
            brute_of[rows[i].doc_id] = c
        for i, j in itertools.combinations(c, 2):
            whole[size] += 1
            kept[size] += got[rows[i].doc_id] == got[rows[j].doc_id]
    assert {n: kept[n] / whole[n] for n in whole if kept[n] < 0.9 * whole[n]} == {} and whole
    found = defaultdict(set)
    for i, c in got.items():
        found[c].add(brute_of[i])
    assert all(len(x) == 1 for x in found.values())


def test_no_pair_of_a_large_bucket_is_left_out(make_docs, spark):
    """Every pair of one bucket is compared: the blocks join just what brute force joins."""
    rng = np.random.default_rng(11)
    words = lambda n: [f"w{x}" for x in rng.integers(0, 10**9, n)]
    passage, texts = words(100), []
    for _ in range(70):  # groups of three, the passage in all of them
        both = words(30)
        texts += [" ".join(passage + both + words(4)) for _ in range(3)]
    many = spark.createDataFrame([(7, f"n{i:03}", f"n{i:03}") for i in range(len(texts))], "bucket long, node string, component string")
    frames = (spark.createDataFrame([(f"n{i:03}", t) for i, t in enumerate(texts)], "node string, text string")
              .mapInArrow(neardup._frames, "node string, frame binary, size long"))
    none = neardup.Weights(np.zeros(0, np.uint64), np.zeros(0))
    links = neardup._block_links(many, frames, none, neardup.THRESHOLD).collect()
    group = {f"n{i:03}": f"n{i:03}" for i in range(len(texts))}
    for r in links:
        group = {k: group[r.a] if v == group[r.b] else v for k, v in group.items()}
    got = defaultdict(list)
    for k, v in group.items():
        got[v].append(int(k[1:]))
    assert sorted(map(tuple, got.values())) == sorted(map(tuple, brute_classes(texts)))
    assert len(links) == len(texts) - len(got)


def test_overlaps_equal_similarities():
    rng = np.random.default_rng(1)
    raw = [" ".join(f"w{x}" for x in rng.integers(0, 3, rng.integers(0, 60))).encode() for _ in range(60)] + [b"a " * 5000] * 2
    ids, times, bounds = neardup.elements(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    idf = np.where(ids % np.uint64(3) == 0, 0.9, 1.0)
    left, right = np.arange(40), np.arange(40, 62)
    low = neardup.overlaps(ids, times, idf, bounds, left, right).ravel()
    whole = np.bincount(np.repeat(np.arange(62), np.diff(bounds)), times * idf, 62)
    a, b = np.repeat(left, len(right)), np.tile(right, len(left))
    got = low / np.maximum(whole[a] + whole[b] - low, 1e-300)
    assert np.allclose(got, neardup.similarities(ids, times * idf, bounds, a, b)) and got.max() > 0


def test_a_full_block_keeps_its_last_row():
    raw = [f"x{i} a b c d e f".encode() for i in range(neardup.BLOCK_ROWS)]
    _, _, bounds = neardup.elements(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    assert (np.diff(bounds) == 3).all()


def test_copies_with_three_changed_words_and_their_original(make_docs):
    """600 copies differ from the original by three words, from each other by six."""
    rng = np.random.default_rng(9)
    words = [f"w{i}" for i in rng.integers(0, 10**9, 150)]
    rows = [(0, " ".join(words))]
    for i in range(1, 601):
        w = list(words)
        for k in rng.choice(150, 3, replace=False):
            w[k] = f"c{i}x{k}"
        rows.append((i, " ".join(w)))
    got = neardup.near_duplicate_classes(make_docs(rows)).collect()
    assert max(len(c) for c in classes_of(got)) >= 0.99 * len(brute_classes([t for _, t in rows])[0])


def test_near_duplicate_edges(make_docs, spark):
    rows = [(5, None), (3, ""), (None, "a b c"), (7, "a b c"), (7, "a b c"), (8, "  "), (9, "A  b\nc"), (10, "x " * 30_000),
            (11, "x " * 30_000 + "y")]
    docs = make_docs(rows, clash=True)
    got = neardup.near_duplicate_classes(docs).collect()
    assert {(r.doc_id, r.class_id, r.class_size) for r in got} == {
        (5, 3, 2), (3, 3, 2), (None, 7, 4), (7, 7, 4), (9, 7, 4), (8, 8, 1), (10, 10, 2), (11, 10, 2)}
    kept = neardup.one_row_each(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id, r.text) for r in kept.select("doc_id", "text").collect()) == [
        (3, ""), (7, "a b c"), (8, "  "), (10, "x " * 30_000)]
    assert neardup.near_duplicate_classes(make_docs([])).collect() == []


def test_common_elements_weigh_less(make_docs):
    line = "one two three four five six seven eight nine ten"
    docs = make_docs([(i, line + " " + " ".join(f"d{i}w{k}" for k in range(40))) for i in range(400)])
    w = neardup.common_weights(docs.select("text"))
    assert len(w.ids) == 6 and np.allclose(w.weights, neardup.IDF_FLOOR)


def test_common_elements_of_blocks_of_one_text(spark, monkeypatch):
    """No text shares a block with another one: the weights are still those of all texts."""
    line = "one two three four five six seven eight nine ten"
    own = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(40)), lambda k: F.concat(F.lit("d"), F.col("id"), F.lit("w"), k)), " ")
    docs = spark.range(0, 60, 1, 60).select(F.concat_ws(" ", F.lit(line), own).alias("text"))
    w = neardup.common_weights(docs)
    assert len(w.ids) == 6 and np.allclose(w.weights, neardup.IDF_FLOOR)

    rng = np.random.default_rng(4)
    texts = [" ".join(f"w{x}" for x in rng.zipf(1.3, 12)) + " a b c d e" * (i % 9 == 0) for i in range(500)]
    batches = [pa.record_batch([pa.array(t, pa.string())], ["text"]) for t in np.split(np.array(texts, object), [1, 2, 3, 40, 400])]
    ids = neardup.elements(np.frombuffer("".join(texts).encode(), np.uint8), np.cumsum([0, *map(len, texts)]))[0]
    often, df = np.unique(ids, return_counts=True)
    for elements in (neardup.RUN_ELEMENTS, 1, 1000):
        monkeypatch.setattr(neardup, "RUN_ELEMENTS", elements)
        runs = [dict(zip(*(c.to_pylist() for c in r.columns), strict=True)) for r in neardup._proposed(iter(batches))]
        assert sum(r.pop(-1) for r in runs) == len(texts)
        total = Counter()
        for r in runs:
            total.update(r)
        wanted = set(often[df > neardup.COMMON_SHARE * len(texts)].tolist())
        assert wanted and wanted <= {i for i, n in total.items() if n >= neardup.COMMON_SHARE / 2 * len(texts)}


def test_similarities_of_blocks_equal_pairs_one_by_one():
    """Pairs of a block, among them equal texts, texts without a common element and
    empty ones, against the sums of minima and maxima."""
    rng = np.random.default_rng(8)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 3, n)) for n in (0, 0, 1, 3, 5, 9, 40, 41, 200)] + ["other words"]
    raw = [t.encode() for t in texts]
    ids, times, bounds = neardup.elements(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    weights = times * rng.choice([0.9, 1.0], len(times))
    left, right = (x.ravel() for x in np.meshgrid(np.arange(len(texts)), np.arange(len(texts))))
    got = neardup.similarities(ids, weights, bounds, left, right)
    bags = [dict(zip(ids[a:b].tolist(), weights[a:b], strict=True)) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    for i, j, s in zip(left, right, got, strict=True):
        keys = bags[i].keys() | bags[j].keys()
        low, high = (sum(f(bags[i].get(k, 0), bags[j].get(k, 0)) for k in keys) for f in (min, max))
        assert s == pytest.approx(low / high if high else 0)


def test_consistent_samples_estimate_weighted_jaccard():
    rng = np.random.default_rng(0)
    ids = rng.integers(1, 1 << 53, 400).astype(np.uint64)
    a, b = rng.integers(1, 4, 400).astype(float), rng.integers(1, 4, 400).astype(float)
    a[:60], b[60:120] = 0, 0
    rates = []
    for k in range(30):
        shift = (ids + np.uint64(k * 7919)) & np.uint64((1 << 53) - 1)
        rows = [(shift[v > 0], v[v > 0]) for v in (a, b)]
        s = [neardup.samples(i, v, np.array([0, len(i)])) for i, v in rows]
        rates.append((s[0] == s[1]).mean())
    assert np.mean(rates) == pytest.approx(np.minimum(a, b).sum() / np.maximum(a, b).sum(), abs=0.03)


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(f"n{i:04}", f"n{i + 1:04}") for i in range(300)] + [("x", "y"), ("y", "x")], "a string, b string")
    got = {r.node: r.component for r in components(links).collect()}
    assert got == {f"n{i:04}": "n0000" for i in range(301)} | {"x": "x", "y": "x"}


def test_files_by_rows_not_by_partitions(spark, make_docs, monkeypatch):
    """Small tables between the steps and the rounds of components are a few files each,
    however many partitions a shuffle has."""
    files, write = {}, common.stored

    def parts(df):
        return len(df.inputFiles())

    def stored(df, name, *most):
        out = write(df, name, *most)
        files[name] = max(parts(out), files.get(name, 0))
        return out

    def keep(shelf, df, name, kept=common.Shelf.keep):
        out = kept(shelf, df, name)
        files["rounds"] = max(parts(out), files.get("rounds", 0))
        return out
    monkeypatch.setattr(neardup, "stored", stored)
    monkeypatch.setattr(common.Shelf, "keep", keep)
    held = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {k: spark.conf.get(k) for k in held}
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in rng.integers(0, 10**9, 120)]
    rows = [(3 * i + k, " ".join(words[:90] + [f"u{i}x{j}" for j in range(30)] + [f"v{k}"])) for i in range(40) for k in range(3)]
    for k, v in held.items():
        spark.conf.set(k, v)
    try:
        got = classes_of(neardup.near_duplicate_classes(make_docs(rows)).collect())
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert got == sorted((3 * i, 3 * i + 1, 3 * i + 2) for i in range(40))
    dealt = {"neardup-proposed", "neardup-signed", "neardup-block-links"}  # by rows unknown before, or work a pair
    assert {k: n for k, n in files.items() if k not in dealt and n > common.LEAST_FILES} == {}
    assert {"rounds", "neardup-names", "neardup-links", "neardup-texts"} <= set(files)


# --- quality -------------------------------------------------------------------

def brute_quality(text):
    words = WORD.findall(text or "")
    at = defaultdict(list)
    for i in range(len(words) - 7):
        at[tuple(words[i:i + 8])].append(i)
    inside = {k for v in at.values() if len(v) > 1 for i in v for k in range(i, i + 8)}
    seen, dups = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            dups += line in seen
            seen.add(line)
    n, rep = len(words), len(inside)
    return (n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dups, rep,
            n < 20 or 100 * rep > 30 * n)


COLUMNS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def test_base_counts_equal_brute_force(corpus, make_docs):
    for docs in (corpus, make_docs([
            (1, None), (2, ""), (3, "\n\n"), (4, "a\nb\na\na"), (5, "x y " * 2000), (6, "é漢 " * 30 + "\x1c  "), (6, "dup"),
            (6, "dup"), (None, "one two three four five six seven eight " * 3), (8, "same line\n same line\nsame line")],
            clash=True)):
        texts = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
        got = Counter((r.doc_id, *(r[c] for c in COLUMNS)) for r in quality.quality(docs).collect())
        assert got == Counter((i, *brute_quality(t)) for i, t in texts)
    assert quality.quality(make_docs([])).collect() == []


def test_distance_is_jensen_shannon():
    p, q = np.array([[3.0, 1, 0, 4]]), np.array([1.0, 1, 2, 4])
    a, b = p[0] / 8, q / 8
    m = (a + b) / 2
    kl = lambda x: sum(v * np.log2(v / w) for v, w in zip(x, m, strict=True) if v)
    assert quality.distance(p, q)[0] == pytest.approx(np.sqrt((kl(a) + kl(b)) / 2))
    assert quality.distance(q[None, :], q)[0] == 0


def test_junk_goes_and_prose_stays(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    got = [(r, labels[r.doc_id]) for r in quality.quality(docs).collect() if r.doc_id in labels]
    assert all(r.kept for r, q in got if q == 1 and not r.base_failed)
    junk = [r.kept for r, q in got if q == 0]
    assert sum(junk) <= 0.15 * len(junk)
    kept = quality.kept_rows(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in quality.quality(docs).where("kept").collect()}


def test_common_words_alone_reject_word_runs(spark):
    """Word runs go by the word distance with the character limit off, and good prose stays."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    runs = [[w for w in words.split() for _ in range(7)] for words in [
        "Oneaen ening the ndonan thnt that ingstre is"]]
    junk = spark.createDataFrame([(-1 - i, " ".join(w), "en", "s", 0) for i, w in enumerate(runs)], docs.schema)
    got = quality.quality(docs.unionByName(junk), max_char=10.0).collect()
    assert [(r.base_failed, r.kept) for r in got if r.doc_id is not None and r.doc_id < 0] == [(False, False)] * len(runs)
    labels = {r.doc_id: r.quality for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    assert all(r.kept for r in got if labels.get(r.doc_id) == 1 and not r.base_failed)


# --- toxicity ------------------------------------------------------------------

def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    rows = [r for r in toxicity.toxicity(docs, labels).collect()]
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
        assert r.predicted == (r.score >= 0.7) and 0 <= r.score <= 1
    own = [r for r in rows if r.held_out and r.doc_id in truth]
    hits = [r.predicted for r in own if truth[r.doc_id] == 1]
    false = [r.predicted for r in own if truth[r.doc_id] == 0]
    assert sum(hits) >= 0.8 * len(hits) and sum(false) <= 0.02 * len(false)


def test_toxicity_edges(spark, make_docs):
    labels = spark.createDataFrame([(i, 1, int(i < 90)) for i in range(300)] + [(1000, 1, None), (None, 1, 1), (3, 1, 0)],
                                   "doc_id long, quality int, toxic int")
    rows = [(i, ("you horrid grobble " if i < 90 else "a pleasant lantern ") + f"w{i}") for i in range(300)]
    rows += [(400, None), (401, ""), (402, "a horrid grobble"), (402, "a horrid grobble"), (None, "a lantern " * 3000)]
    docs = make_docs(rows, clash=True)
    got = toxicity.toxicity(docs, labels).collect()
    assert len(got) == len(rows)
    score = {r.doc_id: r.score for r in got}
    assert score[402] > score[None] and score[400] == score[401]
    assert {r.score for r in toxicity.toxicity(docs, labels.where("toxic = 0")).collect()} == {0.0}
    assert toxicity.toxicity(make_docs([]), labels).collect() == []
    model = toxicity.train(docs, labels)
    kept = toxicity.kept_rows(docs, model, threshold=0.5)
    assert kept.columns == docs.columns
    assert kept.count() == sum(r.score < 0.5 for r in got)
