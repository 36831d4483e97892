import numpy as np
import pytest
from pyspark.sql import functions as F

from thicket.functions.vectors import distance
from thicket.operators.search import beyond, block_scores, scored, top_k, within_budget
from thicket.operators.traverse import traverse


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(60, 5)).round(3)
    x[10] = x[3]
    x[20] = 0
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "node_index long, embedding array<double>")
    queries = rows.where("node_index in (1, 3, 7)").select(F.col("node_index").alias("query_id"), F.col("embedding").alias("query"))
    return x, rows, queries


@pytest.mark.parametrize("metric", ["cosine", "L1", "L2", "Linf", "inner_product"])
def test_top_k_equals_numpy(data, metric):
    x, rows, queries = data
    got = sorted((r.query_id, r.rk, r.node_index) for r in top_k(queries, rows, 7, metric).collect())
    q = x[[1, 3, 7]]
    s = np.nan_to_num(np.round(block_scores(q, x, metric), 12), nan=np.inf)
    want = [(i, k + 1, int(j)) for i, row in zip((1, 3, 7), s, strict=True) for k, j in enumerate(np.lexsort((np.arange(60), row))[:7])]
    assert got == want
    native = {(r.query_id, r.node_index): r.score for r in scored(queries, rows, metric).collect()}
    for i, row in zip((1, 3, 7), block_scores(q, x, metric), strict=True):
        for j in range(60):
            assert native[i, j] == pytest.approx(row[j], abs=1e-9, nan_ok=True)


def test_more_than_there_are_and_none(data, spark):
    _, rows, queries = data
    assert top_k(queries, rows, 100).count() == 180
    assert top_k(queries.where("false"), rows, 5).count() == 0
    assert top_k(queries, rows.where("false"), 5).count() == 0


def test_threshold_keeps_the_far_nearest_first(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [-1.0, 0.0])], "node_index long, embedding array<double>")
    q = spark.createDataFrame([(0, [1.0, 0.0])], "query_id long, query array<double>")
    assert [r.node_index for r in beyond(q, rows, 0.5).orderBy("rk").collect()] == [2, 3]


@pytest.mark.parametrize("most", [1 << 20, 7])
def test_threshold_selection_equals_plain_version(data, spark, monkeypatch, most):
    from thicket.operators import search

    x, rows, _ = data
    monkeypatch.setattr(search, "RANKED", most)
    odd = spark.createDataFrame([(100, None), (101, [1.0, 2.0]), (102, [])], "node_index long, embedding array<double>")
    queries = rows.where("node_index in (1, 3, 20)").selectExpr("node_index AS query_id", "embedding AS query").union(odd.where("node_index < 102"))
    got = sorted((r.query_id, r.rk, r.node_index, r.score) for r in beyond(queries, rows.union(odd), 0.9).collect())
    s = np.full((62, 62), np.nan)
    s[:60, :60] = np.round(block_scores(x, x, "cosine"), 12)
    s[60, 60] = 0.0
    want = []
    for i in (1, 3, 20, 60):
        far = [j for j in np.lexsort((np.arange(62), s[i])) if not s[i, j] <= 0.9]
        want += [(i if i < 60 else 101, k + 1, int(j if j < 60 else j + 41), s[i, j]) for k, j in enumerate(far)]
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert [g[3] for g in got] == pytest.approx([w[3] for w in want], abs=1e-11, nan_ok=True)


def test_threshold_selection_is_scored_in_blocks(data):
    _, rows, queries = data
    plan = beyond(queries, rows, 0.9)._jdf.queryExecution().toString()
    assert "MapInArrow" in plan and "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_unknown_metric_names_the_known(data):
    with pytest.raises(ValueError, match="cosine, L1, L2, Linf"):
        distance(F.lit(1), F.lit(2), "L3")
    with pytest.raises(ValueError, match="L3"):
        top_k(data[2], data[1], 3, "L3")


@pytest.mark.parametrize(("tokens", "flat", "want"), [([40, 50, 20], False, 2), ([200, 10], False, 0), ([40, 50, 20, 5], True, 3), ([100], False, 1), ([101], True, 1)])
def test_budgets(spark, tokens, flat, want):
    rows = spark.createDataFrame([(0, i + 1, t) for i, t in enumerate(tokens)], "query_id long, rk int, n_tokens int")
    assert within_budget(rows, 100, flat).count() == want
    assert within_budget(rows, None, flat).count() == len(tokens)


def test_shared_child_once(spark):
    nodes = spark.createDataFrame([(1, 10, [1.0, 0.0]), (1, 11, [0.9, 0.1]), (0, 3, [1.0, 1.0]), (0, 4, [0.0, 1.0])], "layer int, node_index long, embedding array<double>")
    edges = spark.createDataFrame([(10, 3), (11, 3), (11, 4)], "parent_index long, child_index long")
    q = spark.createDataFrame([(0, [1.0, 0.0])], "query_id long, query array<double>")
    got = [(r.step, r.rk, r.node_index) for r in traverse(q, nodes, edges, 1, 2).orderBy("step", "rk").collect()]
    assert got == [(0, 1, 10), (0, 2, 11), (1, 1, 3), (1, 2, 4)]


def test_numbered_goes_on_from_part_to_part(spark):
    from thicket.operators.number import numbered

    rows = [(g, v) for g, k in ((1, 300), (2, 1), (None, 5), (7, 40)) for v in range(k)]
    df = spark.createDataFrame(rows, "g long, v long").repartition(5)
    got = [tuple(r) for r in numbered(df, "g", ["v"], "no").collect()]
    assert sorted(got, key=str) == sorted(((g, v, v + 1) for g, v in rows), key=str)
    assert numbered(df.where("false"), "g", ["v"], "no").count() == 0
