"""Layer-by-layer retrieval through parent-child links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thicket.functions.vectors import cosine_distance
from thicket.operators.search import key_of, ranked, scored


def select(pairs: DataFrame, mode: str, k: int, threshold: float) -> DataFrame:
    """Of (query_id, key, score): the k nearest, or those farther than the threshold."""
    return ranked(pairs, k) if mode == "top_k" else ranked(pairs.where(F.col("score") > threshold))


def traverse(queries: DataFrame, nodes: DataFrame, edges: DataFrame, start_layer: int, num_layers: int, mode: str = "top_k", k: int = 5, threshold: float = 0.5, heights: DataFrame | None = None) -> DataFrame:
    """(query_id, step, rk, key, score): per layer the candidates are ranked and some selected; the next candidates are the distinct children of these.

    queries(query_id, query), nodes(layer, key, embedding), edges(parent_index, child_index).
    Where nodes and edges have a tree_id, a walk goes through all trees at once and
    ranks their candidates together.  With heights(tree_id, num_layers), a tree
    lower than start_layer is entered at its own top.  The number of layers is
    known, so all steps are one lazy plan without a driver action between them.
    """
    key = key_of(nodes)
    tree = key[:-1]
    entry = nodes.where(F.col("layer") == start_layer) if heights is None else nodes.join(heights.select("tree_id", F.least("num_layers", F.lit(start_layer)).alias("layer")), ["tree_id", "layer"])
    first = select(scored(queries, entry.select(*key, "embedding")), mode, k, threshold)
    down = edges.select(*tree, F.col("parent_index").alias("node_index"), F.col("child_index").alias("child"))
    out, last = first.withColumn("step", F.lit(0)), first
    for step in range(1, num_layers):
        children = last.select("query_id", *key).join(down, list(key)).select("query_id", *tree, F.col("child").alias("node_index")).distinct()
        rows = children.join(nodes.select(*key, "embedding"), list(key)).join(queries, "query_id")
        pairs = rows.select("query_id", *key, cosine_distance(F.col("query"), F.col("embedding")).alias("score"))
        last = select(pairs, mode, k, threshold)
        out = out.unionByName(last.withColumn("step", F.lit(step)))
    return out.select("query_id", "step", "rk", *key, "score")
