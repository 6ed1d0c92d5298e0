from collections import Counter

import corpus_pipeline as P
from tilewright.llm import queries


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    names = docs.columns
    before = docs
    for i, (name, stage) in enumerate(P.STAGES):
        after = P.cut(stage(spark, before, sf_dir), f"test-{i}")
        if i < 4:
            assert after.columns == names, name
        if i < 3:
            ids = {r.doc_id for r in before.select("doc_id").collect()}
            kept = [r.doc_id for r in after.select("doc_id").collect()]
            assert set(kept) <= ids and 0 < len(kept) <= before.count() and len(kept) == len(set(kept))
        before = after
    ran = P.run(spark, sf_dir)
    rows = lambda df: Counter(tuple(r) for r in df.collect())
    assert rows(ran) == rows(before)


def test_exact_copies_go(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = P.dedup_stage(spark, docs, sf_dir)
    assert kept.count() == kept.select("text").distinct().count()
    assert {r.text for r in docs.select("text").distinct().collect()} >= {r.text for r in kept.select("text").collect()}


def test_all_are_registered():
    got = queries.queries()
    assert [k.split("_")[0] for k in got] == [f"op{n}" for n in range(1, 11)] + ["pipeline"]


def test_odd_tables(spark, sf_dir):
    """Null ids, an empty and a very long text, repeated rows, names that stages use themselves, no rows at all."""
    clash = ["id", "y", "held", "_id", "_y", "_first", "component", "node", "key", "mark", "copies", "row", "nth", "bins", "words", "score", "target", "size"]
    docs = spark.createDataFrame(
        [(i, t, "en", s, 5, *range(len(clash))) for i, t, s in [(None, "one text without id", "a"), (None, "another one of those", None), (3, "", "a"), (3, None, "b"), (4, "same text twice here", "a"), (4, "same text twice here", "a"), (5, "word " * 30_000, "b")]],
        "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} int" for c in clash),
    )
    for rows in (docs, docs.limit(0)):
        for name, stage in P.STAGES[:4]:
            after = stage(spark, rows, sf_dir)
            assert after.columns == docs.columns and after.count() <= 3 * rows.count(), name
        assert P.encode_stage(spark, rows, sf_dir).count() == rows.count()


def test_rows_remain_at_a_larger_size(spark):
    """Clean documents get through the first two stages, whose decisions are those of the queries of their own."""
    d = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    clean = P.toxic_stage(spark, docs, d)
    scored = queries.op1_toxicity(spark, d)
    assert {r.doc_id for r in clean.select("doc_id").collect()} == {r.doc_id for r in scored.where("predicted = 0").select("doc_id").collect()}
    good = P.quality_stage(spark, docs, d)
    judged = queries.op10_quality(spark, d)
    assert {r.doc_id for r in good.select("doc_id").collect()} == {r.doc_id for r in judged.where("predicted = 1").select("doc_id").collect()}
    assert clean.count() > 800 and good.count() > 700
