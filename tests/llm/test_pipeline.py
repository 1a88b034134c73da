"""The pipeline's stages, each against a brute-force version of its decisions on its own input."""

from pyspark.sql import functions as F

import corpus_pipeline
from strandflow.llm import common

from .test_operators import near, removed


def test_stages(spark, data):
    docs = common.table(spark, data, "documents")
    columns = docs.columns
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r for r in docs.collect()}
        docs = common.staged(stage(spark, docs, data), name)
        after = docs.collect()
        if name != "packing":
            assert docs.columns == columns
        seen[name] = (before, {r.doc_id: r for r in after})
    before, after = seen["near_duplicates"]
    ids = sorted(before)
    kept = {ids[i] for i, _, c, _ in near([before[i].text for i in ids]) if c == i}
    assert set(after) == kept
    before, after = seen["repeated_passages"]
    ids = sorted(before)
    for i, words, gone, _ in removed([before[i].text for i in ids]):
        if gone == 0:
            assert after[ids[i]] == before[ids[i]]
        elif gone == words:
            assert ids[i] not in after
        else:
            assert len(after[ids[i]].text.split()) == words - gone and after[ids[i]].n_chars == len(after[ids[i]].text)
    before, after = seen["packing"]
    assert set(after) == set(before)


def test_run(spark, data):
    assert corpus_pipeline.run(spark, data).count() > 0


def test_odd_documents(spark, data):
    """Nulls, empty and repeated rows, and columns named like the operators' own: each stage's exact rows."""
    t = " ".join(f"w{k}" for k in range(40))
    rows = [(1, None, "en", "s", None), (2, "", None, None, 0), (3, "a b", "en", "s", 3), (3, "a b", "en", "s", 3), (4, t, "en", "s", 9), (4, t, "en", "s", 9), (None, t, "en", "s", 9), (5, t, "en", "s", 9), (6, f"x y {t}", "en", "s", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    clash = {c: F.lit(k) for k, c in enumerate(("n_words", "n_removed", "kept_text", "score", "_score", "_text", "kept", "_0", "spans", "shard", "run", "c1"))}
    docs = docs.withColumns(clash)
    near, passages, leaks = (stage(spark, docs, data) for _, stage in corpus_pipeline.STAGES[1:4])
    for out in (near, passages, leaks, corpus_pipeline.keep_quality(spark, docs, data)):
        assert out.columns == docs.columns and out.schema == docs.schema
    key = lambda out: sorted(((r.doc_id, r.text) for r in out.collect()), key=repr)
    assert key(near) == sorted([(1, None), (2, ""), (3, "a b"), (4, t), (None, t)], key=repr)
    assert key(passages) == sorted([(1, None), (2, ""), (3, "a b"), (3, "a b"), (4, t), (4, t), (None, t), (6, "x y")], key=repr)
    assert key(leaks) == sorted(((r[0], r[1]) for r in rows), key=repr)
    assert corpus_pipeline.pack_sequences(spark, docs, data).count() == len(rows)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), data).count() == 0
