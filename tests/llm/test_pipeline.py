"""The pipeline against brute-force versions of its stages, each over the
stage's own input, and its registration."""
import hashlib
from collections import Counter

import corpus_pipeline
from kitlend.llm import mixing, quality, toxicity
from kitlend.llm.queries import vocabulary

from .test_corpus import brute_classes, brute_quality

SF = "/root/testdata/sf0.001"


def test_stages_equal_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, first = docs.columns, docs
    steps = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        assert name == "bpe" or out.columns == columns
        out.write.parquet(str(tmp_path / name))
        steps[name] = (docs, spark.read.parquet(str(tmp_path / name)))
        docs = steps[name][1]
    ids = lambda df: Counter(r.doc_id for r in df.select("doc_id").collect())

    before, after = steps["toxicity"]
    model = toxicity.train(before, spark.read.parquet(f"{SF}/labels.parquet"))
    assert ids(after) == Counter(r.doc_id for r in toxicity.scored(before, model).collect() if r.score < 0.7)

    before, after = steps["quality"]
    verdicts = {r.doc_id: r for r in quality.quality(before).collect()}
    for r in before.collect():
        assert verdicts[r.doc_id].base_failed == brute_quality(r.text)[-1]
    assert ids(after) == Counter(i for i, r in verdicts.items() if r.kept)

    before, after = steps["near-duplicates"]
    rows = sorted(before.collect(), key=lambda r: r.doc_id)
    want = [rows[c[0]].doc_id for c in brute_classes([r.text for r in rows])]
    assert ids(after) == Counter(want)

    before, after = steps["mix"]
    plan = {r.doc_id: r.copies for r in mixing.mix_sources(before).collect()}
    assert ids(after) == Counter({i: n for i, n in plan.items() if n})

    from tokenizers import Tokenizer
    lib = Tokenizer.from_file(vocabulary())
    before, after = steps["bpe"]
    want = Counter()
    for r in before.collect():
        e = lib.encode(r.text, add_special_tokens=False).ids
        want[r.doc_id, len(e), hashlib.sha256(" ".join(map(str, e)).encode()).hexdigest()] += 1
    assert want == Counter((r.doc_id, r.n_tokens, r.ids_sha256) for r in after.collect())
    run = corpus_pipeline.run(spark, SF)
    assert Counter(map(repr, run.collect())) == Counter(map(repr, after.collect()))
    assert first.count() > run.select("doc_id").distinct().count()


def test_odd_rows_pass_every_stage(spark, make_docs, tmp_path):
    text = " ".join(f"word{i}" for i in range(60)) + "."
    rows = [(1, text, "en", "a"), (1, text, "en", "a"), (2, text + " more", "en", None), (3, None, None, None), (None, "", "xx", "b"),
            (4, "long " + " ".join(f"piece{i % 977}x{i}" for i in range(40_000)), None, "b")]
    for df in (make_docs(rows, clash=True), make_docs([])):
        docs = df
        for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, docs, SF)
            path = str(tmp_path / f"{df.count()}-{k}")
            out.write.parquet(path)
            docs = spark.read.parquet(path)
        kept = Counter(r.doc_id for r in docs.collect())
        assert set(kept) <= {1, 4} and (kept[4] >= 1 or not df.head(1))


def test_registered():
    import __spark_entry__ as E
    names = set(E.queries())
    assert "pipeline" in names
    for n in range(1, 11):
        assert sum(x.startswith(f"op{n}_") for x in names) == 1
