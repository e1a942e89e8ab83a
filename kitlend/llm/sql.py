"""DuckDB SQL of the operators that SQL can express, written from their
contracts and methods, not from the Spark plans."""

from __future__ import annotations

_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"

#: Base32 of a SHA-1: 8 groups of 5 hex digits, 4 letters each.
_BASE32 = " || ".join(
    f"substr('{_LETTERS}', 1 + ((('0x' || substr(sha1(p), {5 * g + 1}, 5))::INTEGER >> {s}) & 31), 1)"
    for g in range(8) for s in (15, 10, 5, 0))

WARC = f"""
WITH d AS (SELECT page_id, url, p, {_BASE32} AS digest
           FROM (SELECT page_id, url, coalesce(html, '') AS p FROM pages)),
placed AS (SELECT *, max(page_id) OVER (PARTITION BY digest) AS top,
                  row_number() OVER (PARTITION BY digest ORDER BY page_id DESC NULLS LAST, url DESC NULLS LAST) AS place FROM d)
SELECT page_id, strlen(p)::BIGINT AS payload_bytes, digest AS payload_digest,
       CASE WHEN place = 1 THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN place > 1 THEN top END AS refers_to
FROM placed
"""

TOP_K = """
WITH v AS (SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS q FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.rid, a.vec_id AS query_id, b.vec_id,
             list_sum(list_transform(list_zip(a.q, b.q), lambda z: coalesce(z[1], 0) * coalesce(z[2], 0)))::BIGINT AS score
      FROM v a JOIN v b ON a.vec_id % 20 = 0 AND a.rid <> b.rid)
SELECT query_id, rank::INTEGER AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 20
"""


def _mix(classes: int = 48, buckets: int = 256) -> str:
    """Water-filling by its closed form: sources in order of cap over weight,
    clamped while the level of all others lies above them; then the classes of
    document sizes, the largest first, one step each."""
    steps, last = [], "st0"
    for k in range(classes, -1, -1):
        steps.append(f"""
c{k} AS (SELECT s.source, bucket, sum(words) OVER (PARTITION BY s.source ORDER BY bucket) AS got,
                due_all * (seen + sum(words) OVER (PARTITION BY s.source)) // greatest(source_size, 1) - taken AS due
         FROM {last} s JOIN hist h ON h.source IS NOT DISTINCT FROM s.source AND cls = {k}),
b{k} AS (SELECT source, arg_min(bucket + 1, (abs(got - due), bucket)) AS cut, arg_min(got, (abs(got - due), bucket)) AS best,
                max(got) AS all_words
         FROM (SELECT source, bucket, got, due FROM c{k} UNION ALL SELECT DISTINCT source, -1, 0, due FROM c{k})
         GROUP BY source),
st{classes - k + 1} AS MATERIALIZED (
  SELECT s.source, source_size, due_all, seen + coalesce(all_words, 0) AS seen, taken + coalesce(best, 0) AS taken,
         list_append(cuts, coalesce(cut, 0)) AS cuts
  FROM {last} s LEFT JOIN b{k} b ON b.source IS NOT DISTINCT FROM s.source)""")
        last = f"st{classes - k + 1}"
    return f"""
WITH d AS (SELECT doc_id, source, size, CASE WHEN size = 0 THEN -1 ELSE length(bin(size)) - 1 END AS cls,
                  ('0x' || substr(md5('mix-1:' || coalesce(doc_id::VARCHAR, 'null')), 1, 7))::INTEGER % {buckets} AS bucket
           FROM (SELECT doc_id, source,
                        len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size FROM documents)),
src AS (SELECT source, source_size, (row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 + 1 AS weight
        FROM (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source)),
lv AS (SELECT *, sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER o, 0) AS rest,
              sum(weight) OVER () - coalesce(sum(weight) OVER o, 0) AS free
       FROM src WINDOW o AS (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
cl AS (SELECT *, weight * rest > 3 * source_size * free AS over FROM lv),
fin AS (SELECT arg_min(rest, source_size / weight) FILTER (NOT over) AS rest, arg_min(free, source_size / weight) FILTER (NOT over) AS free
        FROM cl),
tgt AS (SELECT source, source_size, CASE WHEN over THEN (3 * source_size)::DOUBLE
               ELSE weight::DOUBLE * fin.rest::DOUBLE / fin.free::DOUBLE END AS target FROM cl, fin),
pl AS (SELECT *, floor(target / greatest(source_size, 1))::BIGINT AS whole FROM tgt),
hist AS (SELECT source, cls, bucket, sum(size)::HUGEINT AS words FROM d GROUP BY ALL),
st0 AS (SELECT source, source_size, floor(target + 0.5)::HUGEINT - whole * source_size AS due_all,
               0::HUGEINT AS seen, 0::HUGEINT AS taken, []::BIGINT[] AS cuts FROM pl),{','.join(steps)}
SELECT doc_id, size, pl.source_size, target,
       size * (whole + CASE WHEN size > 0 AND bucket < cuts[{classes + 1} - cls] THEN 1 ELSE 0 END)::BIGINT AS taken
FROM d JOIN pl ON pl.source IS NOT DISTINCT FROM d.source JOIN {last} f ON f.source IS NOT DISTINCT FROM d.source
"""


MIX = _mix(classes=24)


_FINITE = "embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"


def _moved(books: str, assigned: str, key: str) -> str:
    """The entries after a round: the floor of their members' mean, or as before."""
    on = f"{key}, entry, pos"
    return f"""
SELECT {', '.join(f'b.{c}' for c in on.split(', '))}, coalesce((s - ((s % n) + n) % n) // n, v)::BIGINT AS v
FROM {books} b LEFT JOIN (SELECT {on}, sum(x.v)::HUGEINT AS s, count(*)::HUGEINT AS n
                          FROM {assigned} JOIN x USING (rid, {key}) GROUP BY ALL) USING ({on})"""


def _nearest(books: str, key: str) -> str:
    return f"""
SELECT rid, {key}, arg_min(entry, (d, entry)) AS entry, min(d) AS d
FROM (SELECT rid, {key}, entry, sum((x.v - b.v) * (x.v - b.v))::BIGINT AS d
      FROM x JOIN {books} b USING ({key}, pos) GROUP BY rid, {key}, entry) GROUP BY rid, {key}"""


def _lloyd(key: str, rounds: int) -> str:
    steps = [f"a0 AS MATERIALIZED ({_nearest('b0', key)})"]
    for r in range(1, rounds + 1):
        steps.append(f"b{r} AS MATERIALIZED ({_moved(f'b{r - 1}', f'a{r - 1}', key)})")
        steps.append(f"a{r} AS MATERIALIZED ({_nearest(f'b{r}', key)})")
    return ",\n".join(steps)


#: Rounds of plain assignments in long form: one row a vector and component.
CODES = f"""
WITH kept AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id, embedding) AS rid, vec_id, label,
       list_transform(embedding, lambda x: floor(4096 * x::DOUBLE)::BIGINT) AS q FROM embeddings WHERE {_FINITE}),
x AS MATERIALIZED (SELECT rid, (i - 1) // (len(q) // 8) AS part, (i - 1) % (len(q) // 8) AS pos, v
     FROM (SELECT rid, q, unnest(q) AS v, generate_subscripts(q, 1) AS i FROM kept)),
b0 AS (SELECT part, rid - 1 AS entry, pos, v FROM x WHERE rid <= 16),
{_lloyd('part', 6)},
found AS (SELECT rid, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM a6 GROUP BY rid)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
       (SELECT sha256(string_agg(v::VARCHAR, ',' ORDER BY part, entry, pos)) FROM b6) AS codebooks_sha256
FROM found JOIN kept USING (rid)
"""

CLUSTERS = f"""
WITH kept AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id::VARCHAR), embedding) AS rid, vec_id,
       list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS q
     FROM embeddings WHERE len(embedding) = 64 AND {_FINITE}),
x AS MATERIALIZED (SELECT rid, 0 AS one, unnest(q) AS v, generate_subscripts(q, 1) AS pos FROM kept),
b0 AS (SELECT one, rid - 1 AS entry, pos, v FROM x WHERE rid <= 40),
{_lloyd('one', 5)},
names AS (SELECT entry, sha256(string_agg(v::VARCHAR, ',' ORDER BY pos)) AS sha FROM b5 GROUP BY entry)
SELECT vec_id, entry::INTEGER AS cluster, d AS distance, (sum(d) OVER (PARTITION BY entry))::BIGINT AS cluster_inertia,
       (sum(d) OVER ())::BIGINT AS inertia, sha AS centroid_sha256
FROM a5 JOIN kept USING (rid) JOIN names USING (entry)
"""

LINES = """
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
s AS (SELECT rid, string_split(text, chr(10)) AS lines FROM d),
l AS (SELECT rid, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM s),
k AS (SELECT rid, pos, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
             'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
common AS (SELECT key AS of FROM k WHERE key <> '' GROUP BY key HAVING count(DISTINCT rid) >= 10)
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(of) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (of IS NULL), '')) AS kept_sha256
FROM k JOIN d USING (rid) LEFT JOIN common ON key = of GROUP BY rid
"""
