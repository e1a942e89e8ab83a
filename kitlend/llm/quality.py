"""Quality rules: divergence from language references (operator 9).

Base rules fail a document with fewer than ``MIN_WORDS`` words, or with more
than 30 % of its words in 8-word windows that the text holds twice or more.

Two histograms of a document are held against references of its language by
the Jensen-Shannon distance (base 2, so from 0 to 1):

* character classes: the bytes of a text by class (small letter or digit, so
  that numbers and keys in good prose don't count against it, capital, space, line end, sentence mark, exclamation or question mark, bracket
  or quote, bar, sign, other symbol, other byte, first byte of a longer
  character);
* common words: the words of a text that are among its language's ``COMMON``
  most frequent short words, each by itself, and all others together. Words are
  taken small and without ASCII marks at their ends; short means at most
  eight bytes, so that a word is its own 64-bit key.

The references are sums over all documents of the language (null is a language
of its own) that pass the base rules, counted in the scan's tasks and summed by
(language, class or word) before the shuffle. A document is kept if it passes
the base rules and neither distance is beyond its limit. Distances of short
texts are noise, so a text below ``GUARD_CHARS`` bytes is held only against the
character limit widened by ``sqrt(guard / length)``. The word distance of good
prose falls with its length all along: its limit is ``MAX_WORD_DISTANCE`` at
``GUARD_WORDS`` words and follows the largest distances that were measured on
documents labelled good (see ``word_limits``).

Null text: no words, so base_failed. A language with fewer than ``MIN_REFERENCE``
words in all has no reference and its documents face the base rules alone.
Repeated rows each give a row; an empty table gives none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kitlend.llm.common import (LOWER, blocks, mix, own_columns, prepare, span_hashes, stored, text_buffers,
                                window_hashes, word_spans)

MIN_WORDS = 20
REPEAT_PERCENT = 30
WINDOW = 8
COMMON = 64
GUARD_CHARS = 500
GUARD_WORDS = 150
MIN_REFERENCE = 2000
#: Limits of the two Jensen-Shannon distances.
MAX_CHAR_DISTANCE = 0.21
MAX_WORD_DISTANCE = 0.42
#: Powers of GUARD_WORDS / words by which the word limit rises below GUARD_WORDS
#: and falls beyond, and the share of it that is left to long texts.
SHORT_POWER, LONG_POWER, LEAST_SHARE = 1 / 5, 1 / 3, 0.36

#: Symbols of the base counts.
SYMBOLS = b"#*$%&|<>"

_CLASSES = [b"abcdefghijklmnopqrstuvwxyz0123456789", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b" \t\v\f", b"\n\r", b".,;:",
            b"!?", b"()[]{}'\"`-", b"|", b"#*$%&", b"<>@^~_=+/\\"]
N_CLASSES = len(_CLASSES) + 2  # other bytes, and first bytes of longer characters
_CLASS = np.full(256, N_CLASSES - 2, np.uint8)
for _k, _chars in enumerate(_CLASSES):
    _CLASS[list(_chars)] = _k
_CLASS[0x80:0xC0] = N_CLASSES  # inner bytes of characters
_CLASS[0xC0:] = N_CLASSES - 1
_LETTER = np.zeros(256, bool)
_LETTER[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(SYMBOLS)] = True


def _sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of values[offsets[i]:offsets[i+1]] for each i."""
    total = np.concatenate(([0], np.cumsum(values, dtype=np.int64)))
    return total[offsets[1:]] - total[offsets[:-1]]


def base_counts(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """The five counts of each row, and the word spans they rest on."""
    n = len(offsets) - 1
    starts, ends = word_spans(data, offsets)
    at = np.searchsorted(starts, offsets)
    row = np.repeat(np.arange(n), np.diff(at))
    words = np.diff(at)
    chars = _sums(ends - starts, at) - np.diff(np.searchsorted(np.flatnonzero((data & 0xC0) == 0x80), offsets))
    symbols = np.diff(np.searchsorted(np.flatnonzero(_SYMBOL[data]), offsets))
    # words inside repeated windows
    h = span_hashes(data, starts, ends)
    win = window_hashes(h, WINDOW)
    first = np.arange(len(win))
    inside = row[:len(win)] == row[WINDOW - 1:] if len(win) else np.zeros(0, bool)
    first, key = first[inside], mix(win[inside] + row[:len(win)][inside].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    ordered = np.sort(key)
    often = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    if len(often):
        spot = np.minimum(np.searchsorted(often, key), len(often) - 1)
        begin = first[often[spot] == key]
        m = len(starts) + 1
        cover = np.bincount(begin, minlength=m) - np.bincount(begin + WINDOW, minlength=m)
        repeated = _sums(np.cumsum(cover[:-1]) > 0, at)
    else:
        repeated = np.zeros(n, np.int64)
    # lines with a word that equal an earlier line of the row
    breaks = np.flatnonzero(data == 10)
    begin = np.unique(np.concatenate((offsets[:-1], breaks + 1)))
    begin = begin[begin < len(data)]
    line_row = np.searchsorted(offsets, begin, "right") - 1
    finish = np.minimum(np.concatenate((begin[1:], [len(data)])), offsets[line_row + 1]) if len(begin) else begin
    finish = finish - ((finish > begin) & (data[np.maximum(finish - 1, 0)] == 10)) if len(begin) else finish
    holds = np.searchsorted(starts, begin) < np.searchsorted(starts, finish)
    begin, finish, line_row = begin[holds], finish[holds], line_row[holds]
    lh = mix(span_hashes(data, begin, finish) + line_row.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    _, earliest = np.unique(lh, return_index=True)
    later = np.ones(len(lh), bool)
    later[earliest] = False
    dups = np.bincount(line_row[later], minlength=n)
    failed = (words < MIN_WORDS) | (100 * repeated > REPEAT_PERCENT * words)
    return {"n_words": words, "word_chars": chars, "n_symbols": symbols, "n_dup_lines": dups,
            "n_repeat_words": repeated, "base_failed": failed, "starts": starts, "ends": ends, "at": at}


def class_counts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Bytes by character class of each row; inner bytes of characters don't count."""
    n, width = len(offsets) - 1, N_CLASSES + 1
    slot = np.repeat(np.arange(n, dtype=np.int32) * width, np.diff(offsets)) + _CLASS[data]
    return np.bincount(slot, minlength=n * width).reshape(n, width)[:, :N_CLASSES]


def short_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Each word's 64-bit key: its small bytes without ASCII marks at the ends,
    if they are one to eight; else 0."""
    s, e = starts.copy(), ends.copy()
    at = np.flatnonzero(~_LETTER[data[s]])
    while len(at):
        s[at] += 1
        at = at[s[at] < e[at]]
        at = at[~_LETTER[data[s[at]]]]
    at = np.flatnonzero((s < e) & ~_LETTER[data[e - 1]])
    while len(at):
        e[at] -= 1
        at = at[~_LETTER[data[e[at] - 1]]]
    out = np.zeros(len(s), np.uint64)
    short = np.flatnonzero((e > s) & (e - s <= 8))
    s, n = s[short], (e - s)[short]
    key = np.zeros(len(short), np.uint64)
    for k in range(8):
        has = n > k
        byte = LOWER[data[np.minimum(s + k, len(data) - 1)]].astype(np.uint64)
        key = np.where(has, (key << np.uint64(8)) | byte, key)
    out[short] = key
    return out


def _reference_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, kind ('c' class, 'w' word), key, n of the documents that pass the
    base rules."""
    for batch in batches:
        data, offsets = text_buffers(batch.column(1))
        langs = batch.column(0).dictionary_encode()
        codes, names = langs.indices.fill_null(len(langs.dictionary)).to_numpy(), [*langs.dictionary.to_pylist(), None]
        for a, b in blocks(offsets):
            lo = offsets[a]
            part, off = data[lo:offsets[b]], offsets[a:b + 1] - lo
            base, classes = base_counts(part, off), class_counts(part, off)
            words = short_words(part, base["starts"], base["ends"])
            good, code = ~base["base_failed"], codes[a:b]
            row_of = np.repeat(np.arange(b - a), np.diff(base["at"]))
            for c in np.unique(code[good]):
                rows = good & (code == c)
                k, n = np.unique(words[rows[row_of]], return_counts=True)
                m = classes[rows].sum(0)
                size = len(k) + N_CLASSES
                yield pa.RecordBatch.from_arrays(
                    [pa.array([names[c]] * size, pa.string()), pa.array(["w"] * len(k) + ["c"] * N_CLASSES),
                     pa.array([*k.view(np.int64).tolist(), *range(N_CLASSES)], pa.int64()),
                     pa.array([*n.tolist(), *m.tolist()], pa.int64())], ["lang", "kind", "key", "n"])


def references(docs: DataFrame, common: int = COMMON) -> DataFrame:
    """lang, classes (counts by class), words (keys, most frequent first), counts
    (theirs, then that of all other words): one bounded row a language."""
    prepare(docs.sparkSession)
    counted = stored(own_columns(docs, "lang", "text").select(F.col("lang").cast("string"), "text")
                     .mapInArrow(_reference_counts, "lang string, kind string, key long, n long")
                     .groupBy("lang", "kind", "key").agg(F.sum("n").alias("n")), "quality-counts")
    classes = (counted.where(F.col("kind") == "c").groupBy("lang")
               .agg(F.transform(F.array_sort(F.collect_list(F.struct("key", "n"))), lambda x: x["n"]).alias("classes")))
    words = counted.where(F.col("kind") == "w")
    every = words.groupBy("lang").agg(F.sum("n").alias("all_words"))
    best = Window.partitionBy("lang").orderBy(F.col("n").desc(), "key")
    top = (words.where(F.col("key") != 0).withColumn("rank", F.row_number().over(best))
           .where(F.col("rank") <= common).groupBy("lang")
           .agg(F.array_sort(F.collect_list(F.struct("rank", "key", "n"))).alias("top")))
    on = lambda x: F.col("lang").eqNullSafe(F.col(x))
    t = top.withColumnRenamed("lang", "t_lang")
    e = every.withColumnRenamed("lang", "e_lang")
    rest = F.col("all_words") - F.aggregate("top", F.lit(0).cast("long"), lambda s, x: s + x["n"])
    return stored(classes.join(e, on("e_lang")).join(t, on("t_lang"))
                  .where(F.col("all_words") >= MIN_REFERENCE)
                  .select("lang", "classes", F.transform("top", lambda x: x["key"]).alias("words"),
                          F.concat(F.transform("top", lambda x: x["n"]), F.array(rest)).alias("counts")),
                  "quality-references")


def distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance of each row of counts p to the counts q."""
    p = p / np.maximum(p.sum(1, keepdims=True), 1)
    q = np.broadcast_to(q / max(q.sum(), 1), p.shape)
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        kl = lambda a: np.where(a > 0, a * np.log2(a / m), 0).sum(1)
        return np.sqrt(np.maximum((kl(p) + kl(q)) / 2, 0))


def word_limits(words: np.ndarray, limit: float) -> np.ndarray:
    """The word distance that a text of so many words may have.

    The largest distances of documents labelled good that pass the base rules in
    sf0.1: 0.54 at 20 to 30 words, 0.47 to 45, 0.42 to 150, 0.33 to 300, 0.25 to
    600, 0.18 to 1,200, 0.13 to 2,500 and 0.09 beyond.
    """
    ratio = GUARD_WORDS / np.maximum(words, 1)
    return limit * np.where(ratio > 1, ratio ** SHORT_POWER, np.maximum(ratio ** LONG_POWER, LEAST_SHARE))


def _judged(batches: Iterator[pa.RecordBatch], limits: tuple[float, float]) -> Iterator[pa.RecordBatch]:
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    for batch in batches:
        data, offsets = text_buffers(batch.column(1))
        refs = batch.column(2)
        for a, b in blocks(offsets):
            lo = offsets[a]
            part, off = data[lo:offsets[b]], offsets[a:b + 1] - lo
            base, classes = base_counts(part, off), class_counts(part, off)
            words, at = short_words(part, base["starts"], base["ends"]), base["at"]
            far_c, far_w = np.zeros(b - a), np.zeros(b - a)
            known: dict[tuple, tuple] = {}
            for i in range(b - a):
                ref = refs[a + i]
                if not ref.is_valid or base["base_failed"][i]:
                    continue
                name = ref["lang"].as_py()
                if name not in known:
                    keys = np.array(ref["words"].as_py(), np.int64).view(np.uint64)
                    order = np.argsort(keys)
                    counts = np.array(ref["counts"].as_py(), float)
                    known[name] = (keys[order], np.concatenate((counts[:-1][order], counts[-1:])),
                                   np.array(ref["classes"].as_py(), float))
                keys, counts, shape = known[name]
                own = words[at[i]:at[i + 1]]
                slot = np.searchsorted(keys, own)
                slot[(slot >= len(keys)) | (keys[np.minimum(slot, len(keys) - 1)] != own)] = len(keys)
                mine = np.bincount(slot, minlength=len(keys) + 1)
                far_c[i] = distance(classes[i:i + 1], shape)[0]
                far_w[i] = distance(mine[None, :], counts)[0]
            n_bytes = np.diff(off)
            wide_c = np.sqrt(np.maximum(GUARD_CHARS / np.maximum(n_bytes, 1), 1))
            kept = (~base["base_failed"] & (far_c <= limits[0] * wide_c)
                    & (far_w <= word_limits(base["n_words"], limits[1])))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0)[a:b], *(pa.array(base[n], pa.int64()) for n in names),
                 pa.array(base["base_failed"]), pa.array(kept), pa.array(np.round(far_c, 6)), pa.array(np.round(far_w, 6))],
                ["doc_id", *names, "base_failed", "kept", "char_distance", "word_distance"])


def _with_references(docs: DataFrame, refs: DataFrame) -> DataFrame:
    r = refs.select(F.col("lang").alias("_ref_of"), F.struct("lang", "classes", "words", "counts").alias("_ref"))
    return docs.join(r, F.col("lang").cast("string").eqNullSafe(F.col("_ref_of")), "left").drop("_ref_of")


def _passing(batches: Iterator[pa.RecordBatch], limits: tuple[float, float], id_at: int,
             text: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        own = pa.RecordBatch.from_arrays([batch.column(id_at), batch.column(text), batch.columns[-1]],
                                         ["doc_id", "text", "_ref"])
        at = 0
        for part in _judged(iter([own]), limits):
            n = part.num_rows
            rows = batch.slice(at, n).select(range(batch.num_columns - 1))
            yield rows.filter(part.column(part.schema.get_field_index("kept")))
            at += n


def kept_rows(docs: DataFrame, max_char: float = MAX_CHAR_DISTANCE, max_word: float = MAX_WORD_DISTANCE) -> DataFrame:
    """The rows of docs, all columns, that the rules keep."""
    id_at, text = docs.columns.index("doc_id"), docs.columns.index("text")
    both = _with_references(docs, references(docs))
    return both.mapInArrow(lambda b: _passing(b, (max_char, max_word), id_at, text), docs.schema)


def quality(docs: DataFrame, max_char: float = MAX_CHAR_DISTANCE, max_word: float = MAX_WORD_DISTANCE) -> DataFrame:
    """The counts, base_failed, kept and both distances of every document."""
    both = _with_references(own_columns(docs, "doc_id", "text", "lang"), references(docs)).select(
        "doc_id", "text", "_ref")
    kind = docs.schema["doc_id"].dataType.simpleString()
    return both.mapInArrow(
        lambda b: _judged(b, (max_char, max_word)),
        f"doc_id {kind}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
        "base_failed boolean, kept boolean, char_distance double, word_distance double")
