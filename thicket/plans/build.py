"""Building trees: chunks become leaves; clusters of a layer become the nodes above it."""

from __future__ import annotations

from abc import ABC, abstractmethod
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thicket.config import ClusterConfig, TreeConfig
from thicket.functions.text import context, token_count
from thicket.models import embed, summarize
from thicket.operators.chunk import chunks, word_chunks
from thicket.operators.cluster import MixtureClustering
from thicket.operators.number import numbered
from thicket.operators.search import beyond, top_k, tree_neighbours
from thicket.plans.tree import Tree
from thicket.scratch import stored


def _counted(nodes: DataFrame, cfg: ClusterConfig) -> DataFrame:
    if cfg.encode is None:
        return nodes.withColumn("n_tokens", token_count(F.col("text")))
    encode = cfg.encode

    def count(text):  # noqa: ANN001, ANN202
        return text.map(lambda t: len(encode(t or ""))).astype("int32")

    import pandas as pd

    count.__annotations__ = {"text": pd.Series, "return": pd.Series}
    return nodes.withColumn("n_tokens", F.pandas_udf(count, "int")(F.col("text")))


def _embedded(nodes: DataFrame, cfg: ClusterConfig) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes, a row for each node and configured model, and nodes with the vector that they are clustered by; all written at once."""
    at = {name: f"_vector{i}" for i, name in enumerate(cfg.embedding_models)}
    made = stored(nodes.select("*", *[embed(cfg.embedding_models[name], F.col("text")).alias(c) for name, c in at.items()]))
    vectors = [made.select("tree_id", "layer", "node_index", F.lit(name).alias("model"), F.col(c).alias("embedding")) for name, c in at.items()]
    return made.select(nodes.columns), reduce(DataFrame.unionByName, vectors), made.select("tree_id", "node_index", "n_tokens", F.col(at[cfg.cluster_embedding_model]).alias("embedding"))


def leaves(docs: DataFrame, cfg: ClusterConfig) -> DataFrame:
    """Layer 0 of each docs(tree_id, text); each row is a tree."""
    cut = word_chunks(docs, cfg.max_tokens) if cfg.encode is None else chunks(docs, cfg.max_tokens, 0, cfg.encode)
    return cut.select("tree_id", F.lit(0).alias("layer"), F.col("chunk_index").alias("node_index"), "text", "n_tokens")


def number_parents(clusters: DataFrame, base: DataFrame) -> DataFrame:
    """(tree_id, cluster_id, node_index): dense numbers from each tree's base on, in cluster order."""
    ids = numbered(clusters.select("tree_id", "cluster_id").distinct(), "tree_id", ["cluster_id"], "number")
    return ids.join(base, "tree_id").select("tree_id", "cluster_id", (F.col("base") + F.col("number") - 1).cast("int").alias("node_index"))


def build_tree(docs: DataFrame, cfg: ClusterConfig | None = None) -> Tree:
    """Trees of docs(tree_id, text), all at once.

    Layer by layer, trees that still have over reduction_dimension + 1 nodes in
    their top layer are clustered, each cluster's texts, in node order, become
    one context, its summary the parent's text.  A layer is written to the
    shared folder before the next begins; the driver sees one count a layer.
    """
    cfg = cfg or ClusterConfig()
    clustering = cfg.clustering_algorithm or MixtureClustering()
    twice = docs.groupBy("tree_id").agg(F.count("*").alias("n")).where("n > 1").select("tree_id").limit(5).collect()
    if twice:
        raise ValueError(f"each row of docs is a tree, but several have the tree_id {', '.join(str(r[0]) for r in twice)}")
    live, vectors, work = _embedded(leaves(docs, cfg), cfg)
    all_nodes, all_vectors, all_edges = [live], [vectors], []
    for layer in range(1, cfg.num_layers + 1):
        tall = stored(live.groupBy("tree_id").agg(F.count("*").alias("n")).where(F.col("n") > cfg.reduction_dimension + 1).select("tree_id"))
        if not tall.limit(1).count():
            break
        found = stored(clustering.perform_clustering(work.join(tall, "tree_id", "left_semi"), cfg, **cfg.clustering_params))
        base = reduce(DataFrame.unionByName, all_nodes).groupBy("tree_id").agg(F.count("*").alias("base"))
        numbers = stored(number_parents(found, base))
        below = live.join(tall, "tree_id", "left_semi").select("tree_id", "node_index", "text")  # most trees end here, so that their texts need not be joined
        texts = found.join(below, ["tree_id", "node_index"]).groupBy("tree_id", "cluster_id").agg(context(F.col("text"), F.col("node_index")).alias("context"))
        said = texts.join(numbers, ["tree_id", "cluster_id"]).select("tree_id", F.lit(layer).alias("layer"), "node_index", summarize(cfg.summarization_model, F.col("context"), cfg.summarization_length).alias("text"))
        live, vectors, work = _embedded(_counted(said, cfg).select("tree_id", "layer", "node_index", "text", "n_tokens"), cfg)
        edges = stored(found.join(numbers.withColumnRenamed("node_index", "parent_index"), ["tree_id", "cluster_id"]).select("tree_id", "parent_index", F.col("node_index").alias("child_index")).distinct())
        all_nodes.append(live)
        all_vectors.append(vectors)
        all_edges.append(edges)
    nodes = reduce(DataFrame.unionByName, all_nodes)
    edges = reduce(DataFrame.unionByName, all_edges) if all_edges else nodes.sparkSession.createDataFrame([], "tree_id long, parent_index int, child_index int")
    meta = nodes.groupBy("tree_id").agg(F.max("layer").alias("num_layers"))
    return Tree(nodes, reduce(DataFrame.unionByName, all_vectors), edges, meta)


def neighbours(nodes: DataFrame, mode: str = "top_k", k: int = 5, threshold: float = 0.5) -> DataFrame:
    """(node_index, neighbour, score, rk): for each of nodes(node_index, embedding) its neighbours among all of them, itself included."""
    queries = nodes.select(F.col("node_index").alias("query_id"), F.col("embedding").alias("query"))
    rows = nodes.select("node_index", "embedding")
    out = top_k(queries, rows, k) if mode == "top_k" else beyond(queries, rows, threshold)
    return out.select(F.col("query_id").alias("node_index"), F.col("node_index").alias("neighbour"), "score", "rk")


class TreeBuilder(ABC):
    """What an engine builds trees with; users' own builders derive from it and are named in BUILDERS."""

    def __init__(self, cfg: TreeConfig):
        self.cfg = cfg

    @abstractmethod
    def build(self, docs: DataFrame) -> Tree:
        """The trees of docs(tree_id, text)."""


class ClusterTreeBuilder(TreeBuilder):
    def build(self, docs: DataFrame) -> Tree:
        return build_tree(docs, self.cfg)


class NeighbourTreeBuilder(TreeBuilder):
    """Every node of a layer has a parent of its own, the summary of its top_k nearest nodes in the layer, itself included, nearest first; num_layers layers above the leaves."""

    def build(self, docs: DataFrame) -> Tree:
        cfg = self.cfg
        live, vectors, _ = _embedded(leaves(docs, cfg), cfg)
        nodes, embeddings, edges = [live], [vectors], []
        for layer in range(1, cfg.num_layers + 1):
            size = live.groupBy("tree_id").agg(F.count("*").cast("int").alias("n"))
            near = tree_neighbours(vectors.where(F.col("model") == cfg.cluster_embedding_model), cfg.top_k).join(size, "tree_id")
            found = stored(near.select("tree_id", (F.col("node_index") + F.col("n")).alias("parent_index"), F.col("neighbour").alias("child_index"), "rk"))
            texts = found.join(live.select("tree_id", F.col("node_index").alias("child_index"), "text"), ["tree_id", "child_index"]).groupBy("tree_id", F.col("parent_index").alias("node_index")).agg(context(F.col("text"), F.col("rk")).alias("context"))
            said = texts.select("tree_id", F.lit(layer).alias("layer"), "node_index", summarize(cfg.summarization_model, F.col("context"), cfg.summarization_length).alias("text"))
            live, vectors, _ = _embedded(_counted(said, cfg).select("tree_id", "layer", "node_index", "text", "n_tokens"), cfg)
            nodes.append(live)
            embeddings.append(vectors)
            edges.append(found.select("tree_id", "parent_index", "child_index"))
        whole = reduce(DataFrame.unionByName, nodes)
        return Tree(whole, reduce(DataFrame.unionByName, embeddings), reduce(DataFrame.unionByName, edges), whole.groupBy("tree_id").agg(F.max("layer").alias("num_layers")))


#: Builders by name.
BUILDERS: dict[str, type[TreeBuilder]] = {"cluster": ClusterTreeBuilder, "neighbours": NeighbourTreeBuilder}
