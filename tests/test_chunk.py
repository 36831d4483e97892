import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from thicket.functions.text import context, flat_context, one_line, prompt, sentences, split_text, subsentences, token_count
from thicket.operators.chunk import chunks, split, word_chunks

words = lambda s: s.split()


def test_golden_cases(spark):
    cases = [("a b. c d e f, g. h.", 3, ["c d e f", "g", "a b  h"]), ("", 3, []), (None, 3, []), (" \t\n", 3, []), ("a b c", 3, ["a b c"]), ("a b c. d", 3, ["a b c", " d"]), ("a b,c d;e", 1, ["a b", "c d", "e"])]
    for text, most, want in cases:
        df = spark.createDataFrame([(text,)], "t string")
        assert df.select(split_text(F.col("t"), most)).first()[0] == want, text
        assert split(text, most, 0, words) == want


def test_words_cut_by_workers_are_cut_as_by_columns(spark):
    texts = ["a b. c d e f, g. h.", "", None, " \t\n", "a b,c d;e", "a\u00a0b\u3000c. \x1c d: ,;e f g h i j,k. l\u2028m\u0085n!", "x " * 9 + ". y,,z ; " + "w " * 7, "é ü. \u200b ß\x0bq?"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "tree_id long, text string")
    for most in (1, 3, 5, 100):
        assert sorted(map(tuple, word_chunks(docs, most).collect())) == sorted(map(tuple, chunks(docs, most).collect())), most


def test_overlap_keeps_last_sentences(spark):
    df = spark.createDataFrame([("a. b. c. d.",)], "t string")
    assert df.select(split_text(F.col("t"), 2, 1)).first()[0] == split("a. b. c. d.", 2, 1, words) == ["a  b", " b  c", " c  d"]


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab .!?\n,;:\t é", max_size=60), st.integers(1, 5))
def test_python_cut_keeps_words_and_limit(text, most):
    got = split(text, most, 0, words)
    for c in got:
        assert len(words(c)) <= most or not re.search("[,;:]", c)
    plain = lambda s: sorted(re.sub("[.!?\n,;:]", " ", s).split())
    assert plain(" ".join(got)) == plain(text)


def test_native_cut_equals_python(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select(F.col("doc_id").alias("tree_id"), "text")
    native = {(r.tree_id, r.chunk_index): (r.text, r.n_tokens) for r in chunks(docs, 40).collect()}
    python = {(r.tree_id, r.chunk_index): (r.text, r.n_tokens) for r in chunks(docs, 40, encode=words).collect()}
    assert native == python and native


def test_pieces(spark):
    df = spark.createDataFrame([("A b.  ! c, d;;e\nf\x1c",)], "t string")
    row = df.select(sentences(F.col("t")), subsentences(F.lit(" c, d;;e")), token_count(F.col("t"))).first()
    assert row[0] == ["A b", " c, d;;e", "f\x1c"]
    assert row[1] == ["c", "d", "e"]
    assert row[2] == len("A b.  ! c, d;;e\nf\x1c".split())


def test_contexts(spark):
    rows = spark.createDataFrame([(2, "z"), (1, "x\ny"), (3, None)], "o int, t string")
    assert rows.agg(context(F.col("t"), F.col("o"))).first()[0] == "x y\n\nz\n\n\n\n"
    assert rows.where("o < 3").agg(flat_context(F.col("t"), F.col("o"))).first()[0] == "x\nyz"
    assert rows.where("o > 9").agg(context(F.col("t"), F.col("o"))).first()[0] == ""
    for t in ("a\r\nb\n", "a\x0bb ", "\n", "a\n\nb"):
        got = spark.createDataFrame([(t,)], "t string").select(one_line(F.col("t"))).first()[0]
        assert got == " ".join(t.splitlines())


def test_prompt(spark):
    assert spark.range(1).select(prompt("a {x} b {y}", x=F.lit("1"), y=F.lit("{2}"))).first()[0] == "a 1 b {2}"


@pytest.mark.parametrize("bad", [0])
def test_empty_table(spark, bad):
    assert chunks(spark.createDataFrame([], "tree_id long, text string")).count() == bad
