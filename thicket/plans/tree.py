"""A tree, or a forest of them, as DataFrames."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NODES = "tree_id long, layer int, node_index int, text string, n_tokens int"
EMBEDDINGS = "tree_id long, layer int, node_index int, model string, embedding array<float>"
EDGES = "tree_id long, parent_index int, child_index int"
META = "tree_id long, num_layers int"
PARTS = {"nodes": NODES, "node_embeddings": EMBEDDINGS, "edges": EDGES, "tree_meta": META}


@dataclass(frozen=True)
class Tree:
    """nodes, node_embeddings, edges and tree_meta; several trees are told apart by tree_id.  Leaves are layer 0, numbered in chunk order; parents are numbered on from there, layer by layer."""

    nodes: DataFrame
    node_embeddings: DataFrame
    edges: DataFrame
    tree_meta: DataFrame

    @classmethod
    def of(cls, source: Tree | str | None, spark: SparkSession) -> Tree | None:
        """A tree given as such, as the folder of a saved one, or as None for none."""
        from thicket.config import kind_of
        from thicket.sources.store import load_tree

        found = kind_of("tree", source, cls, str, type(None))
        return load_tree(spark, found) if isinstance(found, str) else found

    def only(self, tree_id: int) -> Tree:
        return Tree(*(getattr(self, p).where(F.col("tree_id") == tree_id) for p in PARTS))

    def vectors(self, model: str) -> DataFrame:
        """Every node with its vector of one model; raises KeyError if no node has one."""
        v = self.embeddings(model)
        if not v.limit(1).count():
            raise KeyError(model)
        return self.nodes.join(v, ["tree_id", "node_index"])

    def node_list(self) -> DataFrame:
        """Every node, in order of tree and number."""
        return self.nodes.orderBy("tree_id", "node_index")

    def embeddings(self, model: str) -> DataFrame:
        """(tree_id, node_index, embedding) of one model, of every node that has one."""
        return self.node_embeddings.where(F.col("model") == model).select("tree_id", "node_index", "embedding")

    def children(self) -> DataFrame:
        """(tree_id, node_index, children): each parent's sorted child indices."""
        return self.edges.groupBy("tree_id", F.col("parent_index").alias("node_index")).agg(F.sort_array(F.collect_set("child_index")).alias("children"))

    def num_layers(self) -> int:
        """Of the tallest tree."""
        return self.tree_meta.agg(F.max("num_layers")).first()[0] or 0
