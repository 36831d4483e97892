import numpy as np
import pytest
from pyspark.sql import functions as F

from thicket.config import ClusterConfig, EngineConfig, FlatConfig, RetrieverConfig, TreeConfig
from thicket.models import CompletionAnswer, EmbeddingModel, HashedEmbedding, HostedEmbedding, LeadSummary, OverlapAnswer, QAModel, SummarizationModel, retried
from thicket.operators.cluster import ClusteringAlgorithm, cluster_nodes, reduced, soft_cluster, value_backmap
from thicket.operators.mixture import best_mixture, best_mixtures, mixture_fit, soft_labels
from thicket.plans.build import BUILDERS, TreeBuilder, build_tree, neighbours
from thicket.plans.engine import Engine
from thicket.plans.flat import FlatRetriever
from thicket.plans.retrieve import BaseRetriever, Retriever
from thicket.sources.store import load_tree, read_texts, save_tree
from thicket.streaming.ingest import write_leaves

TOPICS = [["river", "boat", "fish", "water"], ["star", "moon", "orbit", "planet"], ["bread", "oven", "flour", "yeast"]]


def story(n=60):
    rng = np.random.default_rng(4)
    return " ".join(" ".join(rng.choice(TOPICS[i % 3], 8)).capitalize() + f" number {i}." for i in range(n))


@pytest.fixture(scope="module")
def cfg():
    return ClusterConfig(max_tokens=12, num_layers=2, reduction_dimension=3, max_clusters=6, summarization_length=20)


@pytest.fixture(scope="module")
def tree(spark, cfg):
    docs = spark.createDataFrame([(0, story()), (1, "Too short. To cluster."), (2, None)], "tree_id long, text string")
    return build_tree(docs, cfg)


def test_tree_invariants(tree):
    nodes = {(r.tree_id, r.node_index): r for r in tree.nodes.collect()}
    edges = tree.edges.collect()
    assert {t for t, _ in nodes} == {0, 1}
    for t in (0, 1):
        own = sorted(i for u, i in nodes if u == t)
        assert own == list(range(len(own)))
    assert max(r.layer for r in nodes.values() if r.tree_id == 0) >= 1
    assert [r.layer for r in nodes.values() if r.tree_id == 1] == [0]
    for e in edges:
        assert nodes[e.tree_id, e.parent_index].layer == nodes[e.tree_id, e.child_index].layer + 1
    parents = {(e.tree_id, e.parent_index) for e in edges}
    assert parents == {k for k, r in nodes.items() if r.layer > 0}
    assert len({(e.tree_id, e.parent_index, e.child_index) for e in edges}) == len(edges)


def test_build_is_repeatable(spark, cfg, tree):
    docs = spark.createDataFrame([(0, story())], "tree_id long, text string")
    key = lambda t: sorted((r.layer, r.node_index, r.text) for r in t.nodes.where("tree_id = 0").collect())
    assert key(build_tree(docs, cfg)) == key(tree)


def test_save_load_retrieve(spark, tree, tmp_path):
    one = tree.only(0)
    before = Retriever(one).retrieve("bread and yeast in the oven", return_layer_information=True)
    save_tree(one, str(tmp_path / "t"))
    after = Retriever(load_tree(spark, str(tmp_path / "t"))).retrieve("bread and yeast in the oven", return_layer_information=True)
    assert before == after and "bread" in before[0].lower() and len(before[1]) == 10
    with pytest.raises(ValueError, match="no part of a saved tree"):
        load_tree(spark, str(tmp_path / "none"))


def test_traversal_and_checks(tree):
    r = Retriever(tree.only(0), RetrieverConfig(top_k=2))
    text, info = r.retrieve("moon orbit", collapse_tree=False, return_layer_information=True)
    assert text and [x["layer_number"] for x in info] == sorted((x["layer_number"] for x in info), reverse=True)
    assert len(info) <= 2 * (r.height + 1)
    for bad in ({"start_layer": 99}, {"num_layers": 0}, {"max_tokens": 0}, {"collapse_tree": 1}, {"start_layer": 0}):
        with pytest.raises(ValueError):
            r.retrieve("x", **bad)
    with pytest.raises(ValueError):
        r.retrieve(5)
    with pytest.raises(ValueError):
        Retriever("no tree")
    with pytest.raises(ValueError):
        Retriever(tree.only(0), RetrieverConfig(num_layers=9))


def test_engine(spark, cfg, tmp_path):
    e = Engine(spark, EngineConfig(tree=cfg))
    with pytest.raises(ValueError, match="no tree"):
        e.retrieve("x")
    with pytest.raises(ValueError):
        e.save(str(tmp_path / "x"))
    e.add_documents(story(24))
    with pytest.raises(ValueError, match="overwrite"):
        e.add_documents("again")
    context, info = e.retrieve("bread oven")
    assert context and info
    said = e.answer_question("bread oven flour")
    assert any(w in said.lower() for w in TOPICS[2])
    e.save(str(tmp_path / "tree"))
    again = Engine(spark, EngineConfig(tree=cfg), str(tmp_path / "tree"))
    assert again.answer_question("bread oven flour") == said
    asked = spark.createDataFrame([(1, "bread oven flour"), (2, "moon orbit")], "query_id long, question string")
    got = {r.query_id: r.answer for r in again.answer_questions(asked).collect()}
    assert got[1] == said and "moon" in got[2].lower()
    e.add_documents("Something else entirely.", mode="overwrite")
    assert e.tree.nodes.count() == 1


FOREST = [(10, "Rockets burn fuel. They fly to the moon."), (11, "Bread wants flour and yeast."), (12, "Fish swim in the river."), (13, None)]


def test_forest_is_searched_as_a_whole(spark):
    e = Engine(spark)
    e.add_documents(spark.createDataFrame(FOREST, "tree_id long, text string"))
    context, info = e.retrieve("what do rockets burn?", top_k=1)
    assert info == [{"tree_id": 10, "node_index": 0, "layer_number": 0}] and context == "Rockets burn fuel  They fly to the moon\n\n"
    context, info = e.retrieve("flour", top_k=3)
    assert info[0]["tree_id"] == 11 and {x["tree_id"] for x in info} == {10, 11, 12} and context.count("\n\n") == 3
    walked, info = e.retrieve("fish in the river", collapse_tree=False)
    assert [x["tree_id"] for x in info][0] == 12 and len(info) == 3
    asked = spark.createDataFrame([(1, "who burns fuel"), (2, "yeast")], "query_id long, question string")
    got = {r.query_id: (r.answer, r.layer_information) for r in e.answer_questions(asked, top_k=1).collect()}
    assert got[1][0] == "Rockets burn fuel  They fly to the moon" and got[2][1][0].tree_id == 11
    with pytest.raises(ValueError, match="several have the tree_id 10"):
        Engine(spark).add_documents(spark.createDataFrame([FOREST[0], FOREST[0]], "tree_id long, text string"))


def test_forest_of_unlike_heights_is_walked_from_each_top(tree):
    r = Retriever(tree, RetrieverConfig(top_k=3))
    _, info = r.retrieve("short cluster moon", collapse_tree=False, return_layer_information=True)
    assert {x["tree_id"] for x in info[:3]} == {0, 1} or {x["tree_id"] for x in info[:3]} == {0}
    keys = {(x.tree_id, x.node_index): x.layer for x in tree.nodes.collect()}
    assert all(keys[x["tree_id"], x["node_index"]] == x["layer_number"] for x in info)
    _, info = r.retrieve("too short to cluster", collapse_tree=False, return_layer_information=True)
    assert info[0] == {"tree_id": 1, "node_index": 0, "layer_number": 0}


def test_flat_over_a_forest_and_own_retrievers(spark):
    docs = spark.createDataFrame(FOREST, "tree_id long, text string")
    e = Engine(spark, EngineConfig(retriever=FlatConfig(use_top_k=True, top_k=1)))
    e.add_documents(docs)
    assert e.retrieve("fish swim in the river") == ("Fish swim in the river", [{"tree_id": 12, "node_index": 0, "layer_number": 0}])

    class Fixed(BaseRetriever):
        def batch(self, questions, **how):
            return questions.select("query_id", F.lit("Always this.").alias("context"), F.array().cast("array<struct<tree_id:bigint,node_index:int,layer_number:int>>").alias("layer_information"))

        def retrieve(self, query, **how):
            return "Always this."

    own = Engine(spark, retriever=Fixed())
    assert own.answer_question("anything at all") == "Always this" and own.retrieve("x") == ("Always this.", [])


def test_many_questions_go_in_blocks(spark, monkeypatch):
    from thicket.operators import search

    rows = spark.createDataFrame([(i % 3, i, [float(i % 7), 1.0]) for i in range(40)], "tree_id long, node_index int, embedding array<double>")
    asked = spark.createDataFrame([(i, [float(i), 2.0]) for i in range(11)], "query_id long, query array<double>")
    key = lambda d: sorted(tuple(r) for r in d.collect())
    whole = key(search.top_k(asked, rows, 4))
    monkeypatch.setattr(search, "BLOCK", 3)
    assert key(search.top_k(asked, rows, 4)) == whole and len(whole) == 44
    assert search.top_k(asked.where("false"), rows, 4).count() == 0


def test_own_clustering_and_builder(spark):
    class Pairs(ClusteringAlgorithm):
        def perform_clustering(self, nodes, cfg, size=2):
            return nodes.select("tree_id", F.floor(F.col("node_index") / size).cast("int").alias("cluster_id"), "node_index")

    cfg = ClusterConfig(max_tokens=3, num_layers=1, reduction_dimension=2, clustering_algorithm=Pairs(), clustering_params={"size": 3})
    docs = spark.createDataFrame([(0, "A b c. D e f. G h i. J k l. M n o. P q r. S t u.")], "tree_id long, text string")
    built = build_tree(docs, cfg)
    assert {r.node_index: r.children for r in built.children().collect()} == {7: [0, 1, 2], 8: [3, 4, 5], 9: [6]}
    assert [r.node_index for r in built.node_list().collect()] == list(range(10))

    class OneLeaf(TreeBuilder):
        def build(self, docs):
            return build_tree(docs.limit(1), self.cfg)

    BUILDERS["one"] = OneLeaf
    try:
        e = Engine(spark, EngineConfig(tree=cfg, tree_builder_type="one"))
        e.add_documents(docs)
        assert e.tree.nodes.where("layer = 0").count() == 7
    finally:
        del BUILDERS["one"]
    with pytest.raises(ValueError):
        ClusterConfig(clustering_algorithm=3)


def test_tree_of_neighbours(spark):
    from thicket.operators.search import tree_neighbours

    rng = np.random.default_rng(1)
    x = rng.normal(size=(30, 5))
    rows = spark.createDataFrame([(t, i, v.tolist()) for t in (0, 1) for i, v in enumerate(x[: 30 - 20 * t])], "tree_id long, node_index int, embedding array<double>")
    got = {}
    for r in tree_neighbours(rows, 3, block=7).collect():
        got[r.tree_id, r.node_index, r.rk] = r.neighbour
    for t, n in ((0, 30), (1, 10)):
        u = x[:n] / np.linalg.norm(x[:n], axis=1, keepdims=True)
        want = np.argsort(np.round(1 - u @ u.T, 12), axis=1, kind="stable")[:, :3]
        assert all(got[t, i, k + 1] == want[i, k] for i in range(n) for k in range(3))
    e = Engine(spark, EngineConfig(tree=ClusterConfig(max_tokens=8, num_layers=2, top_k=2), tree_builder_type="neighbours"))
    e.add_documents(story(6))
    n = e.tree.nodes.where("layer = 0").count()
    assert e.tree.nodes.count() == 3 * n and e.tree.edges.count() == 4 * n and e.tree.num_layers() == 2
    assert "bread" in e.answer_question("bread oven flour").lower()


def test_flat(spark):
    docs = spark.createDataFrame([(0, story(30))], "tree_id long, text string")
    f = FlatRetriever(FlatConfig(max_tokens=10, max_context_tokens=30))
    with pytest.raises(ValueError):
        f.retrieve("x")
    f.build_from_text(docs).sanity_check()
    assert len(f.retrieve("bread oven").split()) in range(30, 50)
    top = FlatRetriever(FlatConfig(max_tokens=10, use_top_k=True, top_k=500))
    plain = lambda t: sorted(t.replace(".", "").replace(" ", ""))
    assert plain(top.build_from_text(docs).retrieve("bread")) == plain(story(30))


def test_flat_from_leaves(tree):
    f = FlatRetriever(FlatConfig(max_tokens=12, use_top_k=True, top_k=1)).build_from_leaf_nodes(tree.only(0))
    assert "moon" in f.retrieve("moon moon moon orbit").lower()
    with pytest.raises(KeyError):
        tree.vectors("none")


def test_blobs_and_budget(spark):
    rng = np.random.default_rng(2)
    x = np.vstack([rng.normal(size=(30, 6)) * 0.05 + 3 * np.eye(6)[i] for i in range(3)])
    x[5] = x[4]
    rows = spark.createDataFrame([(0, i, 100, v.tolist()) for i, v in enumerate(x)], "tree_id long, node_index int, n_tokens int, embedding array<double>")
    cfg = ClusterConfig(reduction_dimension=3, max_clusters=8, max_length_in_cluster=1200)
    got = cluster_nodes(rows, cfg).collect()
    by = {}
    for r in got:
        by.setdefault(r.node_index, set()).add(r.cluster_id)
    assert set(by) == set(range(90)) and by[4] == by[5]
    size = {}
    for r in got:
        size[r.cluster_id] = size.get(r.cluster_id, 0) + 100
    assert max(size.values()) <= 1200 and sorted(size) == list(range(len(size)))
    blob = {}
    for r in got:
        blob.setdefault(r.cluster_id, set()).add(r.node_index // 30)
    assert sum(len(b) == 1 for b in blob.values()) >= 0.8 * len(blob)


def test_structureless_vectors_still_end(spark):
    rng = np.random.default_rng(3)
    rows = spark.createDataFrame([(7, i, 500, v.tolist()) for i, v in enumerate(rng.normal(size=(40, 8)))], "tree_id long, node_index int, n_tokens int, embedding array<double>")
    got = cluster_nodes(rows, ClusterConfig(reduction_dimension=4, max_clusters=4, max_length_in_cluster=1000)).groupBy("cluster_id").count()
    assert got.agg(F.max("count")).first()[0] <= 2


def test_large_group_is_fitted_in_parts_as_it_is_whole(spark):
    rng = np.random.default_rng(5)
    x = np.vstack([rng.normal(size=(60, 4)) * 0.05 + 3 * np.eye(4)[i] for i in range(3)])
    rows = spark.createDataFrame([("g", i, v.tolist()) for i, v in enumerate(x)], "group string, node_index int, embedding array<double>")
    got = []
    for part_rows in (1000, 50):
        cfg = ClusterConfig(reduction_dimension=2, max_clusters=6, part_rows=part_rows)
        sets = {}
        for r in soft_cluster(rows, cfg, True).collect():
            sets.setdefault(r.label, set()).add(r.node_index)
        got.append(sorted(sorted(s) for s in sets.values()))
    assert got[0] == got[1] == [list(range(60)), list(range(60, 120)), list(range(120, 180))]
    a, b = ({r.node_index: r.reduced for r in reduced(rows, ClusterConfig(reduction_dimension=2, part_rows=p)).collect()} for p in (1000, 50))
    assert all(np.allclose(a[i], b[i]) for i in a) and len(a) == len(b) == 180


def _planted(spark, sizes, tokens):
    rng = np.random.default_rng(8)
    x = np.vstack([rng.normal(size=(n, 6)) * 0.03 + 3 * np.eye(6)[i] for i, n in enumerate(sizes)])
    return spark.createDataFrame([(0, i, tokens, v.tolist()) for i, v in enumerate(x)], "tree_id long, node_index int, n_tokens int, embedding array<double>")


def test_a_tree_of_a_tasks_size_is_split_in_one_task(spark, monkeypatch):
    from thicket.operators import cluster

    tables, stored = [], cluster.stored
    monkeypatch.setattr(cluster, "stored", lambda df: tables.append(1) or stored(df))
    got = cluster_nodes(_planted(spark, (40, 40, 40), 100), ClusterConfig(reduction_dimension=3, max_clusters=6, max_length_in_cluster=400)).groupBy("cluster_id").count()
    assert got.agg(F.max("count")).first()[0] <= 4 and len(tables) <= 3


def test_small_groups_are_fitted_at_once_as_each_alone(monkeypatch):
    from thicket.operators import mixture

    rng, steps, model = np.random.default_rng(6), [], mixture._model
    monkeypatch.setattr(mixture, "_model", lambda *a: steps.append(1) or model(*a))
    near = [rng.normal(size=(int(k), 3))[rng.integers(0, k, int(n))] + rng.normal(scale=0.05, size=(int(n), 3)) for k, n in zip(rng.integers(1, 6, 80), rng.integers(1, 90, 80), strict=True)]
    groups = [*near, np.zeros((7, 3)), np.repeat(near[0][:1], 20, 0), np.repeat(rng.normal(size=(4, 3)), 5, 0), rng.normal(size=(300, 3))]
    for most in (8, 50):
        got = best_mixtures(groups, most)
        for x, m in zip(groups, got, strict=True):
            alone = best_mixture(x, most)
            assert m.k == alone.k and soft_labels(m.posterior(x), 0.1) == soft_labels(alone.posterior(x), 0.1), len(x)
    few = len(steps)
    best_mixtures([*groups, *near * 9], 50)
    assert len(steps) - few <= 2 * few  # many more groups take hardly more steps


def test_a_task_clusters_many_trees_at_once(spark, monkeypatch):
    from thicket.operators import cluster

    rows = _planted(spark, (15, 15), 400).selectExpr("explode(sequence(1L, 40L)) AS tree_id", "node_index", "n_tokens", "embedding")
    cfg = ClusterConfig(reduction_dimension=3, max_clusters=4, max_length_in_cluster=2000)
    sets = []
    for held in (1 << 14, 50):
        monkeypatch.setattr(cluster, "HELD", held)
        by = {}
        for r in cluster_nodes(rows, cfg).collect():
            by.setdefault(r.tree_id, []).append((r.cluster_id, r.node_index))
        sets += [sorted(v) for v in by.values()]
    assert len(sets) == 80 and all(s == sets[0] for s in sets) and {i for _, i in sets[0]} == set(range(30))


def test_a_layer_of_many_trees_is_clustered_at_once(spark, monkeypatch):
    from thicket.operators import cluster

    tables, stored = [], cluster.stored
    monkeypatch.setattr(cluster, "stored", lambda df: tables.append(1) or stored(df))
    rows = _planted(spark, (15, 15), 400).selectExpr("explode(array(1L, 2L, 3L)) AS tree_id", "node_index", "n_tokens", "embedding")
    got = cluster_nodes(rows, ClusterConfig(reduction_dimension=3, max_clusters=4, max_length_in_cluster=2000)).collect()
    sets = [sorted((r.cluster_id, r.node_index) for r in got if r.tree_id == t) for t in (1, 2, 3)]
    assert sets[0] == sets[1] == sets[2] and {i for _, i in sets[0]} == set(range(30)) and len(tables) <= 3


def test_a_group_is_clustered_alike_wherever_it_is_fitted(spark, monkeypatch):
    from thicket.operators import cluster

    rows, got = _planted(spark, (60, 50, 40), 100), []
    for part_rows in (1000, 80):
        sets = {}
        for r in cluster_nodes(rows, ClusterConfig(reduction_dimension=2, max_clusters=6, max_length_in_cluster=6000, part_rows=part_rows)).collect():
            sets.setdefault(r.cluster_id, set()).add(r.node_index)
        got.append([sorted(s) for _, s in sorted(sets.items())])
    assert got[0] == got[1] and sorted(i for s in got[0] for i in s) == list(range(150))
    monkeypatch.setattr(cluster, "FITTED", 0)  # by passes
    by = {}
    for r in soft_cluster(rows.selectExpr("'g' AS group", "node_index", "embedding"), ClusterConfig(reduction_dimension=2, max_clusters=4, part_rows=80), True).collect():
        by.setdefault(r.label, set()).add(r.node_index)
    assert sorted(map(sorted, by.values())) == [list(range(60)), list(range(60, 110)), list(range(110, 150))]


def test_numbers_that_cannot_win_are_left_out_and_no_others(monkeypatch):
    from thicket.operators import mixture

    rng, sweep = np.random.default_rng(4), mixture.bic_sweep
    for n, d in ((12, 10), (30, 10), (40, 4), (25, 2)):
        x = rng.normal(size=(n, d)) * 0.1
        ks = list(mixture.numbers(n, 50))
        every, tried = sweep(x, ks, 224), []
        monkeypatch.setattr(mixture, "bic_sweep", lambda x, ks, seed: tried.extend(ks) or sweep(x, ks, seed))
        assert best_mixture(x).k == mixture.best_number(ks, every)
        assert all(mixture.least_bic(n, k, d) <= b for k, b in zip(ks, every, strict=True))
        assert tried == ks[: len(tried)] and (len(tried) < len(ks) or d < 10)


def test_numbers_of_larger_groups_begin_from_the_number_before(monkeypatch):
    from thicket.operators import mixture

    rng, evaluated, moments = np.random.default_rng(9), [], mixture.moments
    monkeypatch.setattr(mixture, "moments", lambda x, runs, *of: evaluated.append(sum(r.k for r in runs if not r.done)) or moments(x, runs, *of))
    x = np.vstack([rng.normal(size=(n, 3)) + 3 * rng.normal(size=3) for n in (300, 200, 150, 90, 60)])
    ks = list(mixture.numbers(len(x), 30))
    alone, cost = mixture.bic_sweep(x, ks), sum(evaluated)
    evaluated.clear()
    best = best_mixture(x, 30)
    assert 2 * sum(evaluated) < cost
    swept = {m.k: bic for bic, m in mixture.sweep_down(x, ks, 224)}
    assert sorted(swept) == ks and best.k == mixture.best_number(ks, [swept[k] for k in ks])
    assert abs(best.bic(x) - swept[best.k]) < 1e-5 * abs(swept[best.k]) and swept[best.k] <= min(alone) + 1e-4 * abs(min(alone))


def test_equal_rows_are_looked_at_once_and_count_as_often_as_they_are_there(monkeypatch):
    from thicket.operators import mixture

    rng, looked, moments = np.random.default_rng(12), [], mixture.moments
    x = np.vstack([rng.normal(size=(n, 2)) * 0.2 + c for n, c in ((80, [0, 0]), (60, [3, 0]), (40, [0, 3]))])
    often = np.repeat(x, rng.integers(1, 9, len(x)), 0)
    low, n = mixture.distinct(often)
    assert np.array_equal(np.repeat(low, n.astype(int), 0), often) and len(low) == len(x)
    assert np.allclose(mixture.moments(often, [mixture.Run(3, x[[0, 80, 140]])])[0], mixture.moments(low, [mixture.Run(3, x[[0, 80, 140]])], weight=n)[0])
    monkeypatch.setattr(mixture, "moments", lambda x, *a: looked.append(len(x)) or moments(x, *a))
    best = best_mixture(often, 6)
    assert set(looked) == {len(x)}
    swept = list(mixture.sweep_down(often, [1, 2, 3, 4, 5], 224))
    assert best.k == min((bic, m.k) for bic, m in swept)[1] and all(abs(m.bic(often) - bic) < 1e-4 * abs(bic) for bic, m in swept)


def test_what_was_fitted_is_not_fitted_again_within_one_label(monkeypatch):
    from thicket.operators import cluster

    fitted, fit = [], cluster.best_mixtures
    monkeypatch.setattr(cluster, "best_mixtures", lambda xs, *a: fitted.append(len(xs)) or fit(xs, *a))
    x = 1 + 0.02 * np.random.default_rng(3).normal(size=(300, 4))
    ((label, rows),) = cluster._two_level([x], ClusterConfig(reduction_dimension=2, max_clusters=6))[0]
    assert label == 0 and rows.tolist() == list(range(300)) and sum(fitted) == 1


def test_splitting_ends_within_the_limit(spark):
    rng = np.random.default_rng(6)
    rows = spark.createDataFrame([(0, i, int(t), v.tolist()) for i, (t, v) in enumerate(zip(rng.integers(1, 700, 60), rng.normal(size=(60, 5)), strict=True))], "tree_id long, node_index int, n_tokens int, embedding array<double>")
    got = cluster_nodes(rows, ClusterConfig(reduction_dimension=3, max_clusters=3, max_length_in_cluster=1000, max_splits=1))
    size = got.join(rows, "node_index").groupBy("cluster_id").agg(F.sum("n_tokens").alias("t"), F.count("*").alias("n"))
    assert size.where("n > 1 and t > 1000").count() == 0 and got.select("node_index").distinct().count() == 60


def test_mixture_picks_planted_number():
    rng = np.random.default_rng(0)
    x = np.vstack([rng.normal(size=(60, 2)) + 12 * np.array(c) for c in ((0, 0), (1, 0), (0, 1))])
    m = best_mixture(x, 8)
    assert m.k == 3 and m.posterior(x).max(1).min() > 0.9
    assert mixture_fit(x[:1], 1, 0).k == 1 and best_mixture(x[:1]).k == 1
    assert soft_labels(np.array([[0.5, 0.45, 0.05]]), 0.1) == [[0, 1]]
    assert soft_labels(np.array([[0.05, 0.06]]), 0.1) == [[1]]


def test_backmap_and_neighbours(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 1.0])], "node_index long, embedding array<double>")
    labels = spark.createDataFrame([(1, 5), (3, 6)], "node_index long, label int")
    assert sorted(tuple(r) for r in value_backmap(rows, labels).collect()) == [(1, 5), (2, 5), (3, 6)]
    near = {(r.node_index, r.rk): r.neighbour for r in neighbours(rows, k=2).collect()}
    assert near[1, 1] == 1 and near[2, 1] == 1 and near[3, 1] == 3


@pytest.mark.parametrize(("kind", "bad"), [(TreeConfig, {"max_tokens": 0}), (TreeConfig, {"threshold": 2}), (TreeConfig, {"selection_mode": "x"}), (TreeConfig, {"embedding_models": {}}), (TreeConfig, {"cluster_embedding_model": "x"}), (TreeConfig, {"summarization_model": 1}), (RetrieverConfig, {"threshold": 1}), (RetrieverConfig, {"top_k": 0}), (RetrieverConfig, {"num_layers": -1}), (RetrieverConfig, {"embedding_model": 3}), (FlatConfig, {"max_context_tokens": 0}), (FlatConfig, {"embedding_model": 3}), (EngineConfig, {"tree_builder_type": "x"}), (EngineConfig, {"qa_model": 1})])
def test_settings_are_checked(kind, bad):
    with pytest.raises(ValueError):
        kind(**bad)


def test_shortcuts():
    e = EngineConfig(embedding_model=HashedEmbedding(8), summarization_model=LeadSummary())
    tree, retriever, qa = e.resolved()
    assert tree.embedding_models["EMB"].dim == retriever.embedding_model.dim == 8 and isinstance(qa, OverlapAnswer)
    with pytest.raises(ValueError):
        EngineConfig(embedding_model=HashedEmbedding(8), tree=ClusterConfig(embedding_models={"A": HashedEmbedding()}, cluster_embedding_model="A"))


class Fake:
    """A stand-in for a hosted client."""

    def __init__(self):
        self.seen, self.embeddings, self.completions = [], self, self

    def create(self, **how):
        self.seen.append(how)
        if len(self.seen) < 2:
            raise OSError("busy")
        return type("R", (), {"data": [type("D", (), {"embedding": [1.0]})], "choices": [type("C", (), {"text": " yes "})]})


def test_adapters_retry_then_give_the_result(monkeypatch):
    monkeypatch.setattr("thicket.models.time.sleep", lambda s: None)
    c = Fake()
    assert HostedEmbedding(client=lambda: c).create_embedding("a\nb") == [1.0] and c.seen[-1]["input"] == ["a b"]
    c = Fake()
    assert CompletionAnswer(client=lambda: c).answer_question("ctx", "q") == "yes"
    with pytest.raises(OSError):
        retried(lambda: (_ for _ in ()).throw(OSError()), attempts=2)


def test_custom_models(spark, cfg):
    class Ones(EmbeddingModel):
        def create_embedding(self, text):
            return [1.0, float(len(text))]

    class Short(SummarizationModel):
        def summarize(self, context, max_tokens=150):
            return context[:10]

    class Yes(QAModel):
        def answer_question(self, context, question):
            return "yes"

    e = Engine(spark, EngineConfig(embedding_model=Ones(), summarization_model=Short(), qa_model=Yes()))
    e.add_documents("One. Two. Three.")
    assert e.answer_question("anything") == "yes"


def test_texts_and_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("One two. Three.\nFour")
    texts = read_texts(spark, str(tmp_path / "in"))
    assert texts.first().text == "One two. Three.\nFour"
    texts.select("tree_id", "text").write.parquet(str(tmp_path / "docs"))
    stream = spark.readStream.schema("tree_id long, text string").parquet(str(tmp_path / "docs"))
    q = write_leaves(stream, str(tmp_path / "out"), str(tmp_path / "cp"), ClusterConfig(max_tokens=2))
    q.awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2
