"""The pipeline's stages, each held against what it was given."""

import corpus_pipeline
from pyspark.sql import functions as F

from tests.llm.helpers import components, shingles, words
from thicket.llm import merge_dropout, queries

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF).cache()
        if name != "encode":
            assert out.columns == docs.columns
        seen.append((name, {r.doc_id: r for r in docs.collect()}, out.collect()))
        docs = out
    (_, start, good), (_, _, one), (_, _, cut), (_, before, mixed), (_, _, ids) = seen
    verdict = {r.doc_id for r in queries.op5_quality_rules(spark, SF).where("kept").collect()}
    assert {r.doc_id for r in good} == verdict and 0 < len(good) < len(start)
    want = components({r.doc_id: shingles(r.text, 5) for r in good}, 80)
    assert sorted(r.doc_id for r in one) == sorted(i for i, c in want.items() if i == c)
    assert {r.doc_id for r in cut} <= {r.doc_id for r in one} and all(words(r.text) for r in cut)
    total = sum(len(words(r.text)) for r in cut)
    assert abs(sum(len(words(r.text)) for r in mixed) - 1.5 * total) < 0.2 * total
    assert {r.doc_id for r in mixed} <= set(before)
    assert len(ids) == len(mixed)
    back = merge_dropout.decoded(spark.createDataFrame([(r.doc_id, r.ids) for r in ids], "doc_id long, ids array<int>"), ["doc_id"]).collect()
    assert sorted((r.doc_id, r.text) for r in back) == sorted((r.doc_id, r.text) for r in mixed)


def test_run_is_the_stages(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.columns == ["doc_id", "source", "ids"] and out.where(F.size("ids") < 1).count() == 0 and out.count() > 50


def test_odd_rows(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows and a column of a clashing name go through every stage."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    long = " ".join(f"w{i % 7000} and{',' if i % 9 == 0 else ''}" for i in range(20000))
    odd = [(None, None, None, None, None), (10**6, "", "en", None, 0), (10**6, "", "en", None, 0), (10**6 + 1, long, None, "s", None), (10**6 + 1, long, None, "s", None), (None, long + " more", "en", "s", 5)]
    docs = docs.unionByName(spark.createDataFrame(odd, docs.schema)).withColumn("_copy", F.lit("x")).withColumn("n_removed", F.lit(1))
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF).cache()
        assert out.count() > 50
        if name != "encode":
            assert out.columns == docs.columns
            docs = out
    assert out.columns == ["doc_id", "source", "ids"] and out.count() == docs.count()


def test_copies_of_the_mix_are_cut_in_their_own_ways_and_stay_in_order(spark):
    text = "internationalization of documentation and standardization " * 8
    docs = spark.createDataFrame([(i, text, "en", "s", len(text)) for i in (3, 1, 3, 2, 3)], "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.encode(spark, docs.coalesce(1), SF).collect()
    assert [r.doc_id for r in got] == [3, 1, 3, 2, 3] and len({tuple(r.ids) for r in got}) == 5


def test_empty(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.count() == 0


def test_names():
    names = set(queries.QUERIES)
    assert sorted(n.split("_")[0] for n in names if n.startswith("op")) == sorted(f"op{i}" for i in range(1, 11)) and set(queries.ORACLES) <= names
