"""Flat retrieval: exact inner-product search over leaf chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thicket.config import FlatConfig
from thicket.functions.text import flat_context
from thicket.models import embed
from thicket.operators.chunk import chunks
from thicket.operators.search import top_k, within_budget
from thicket.plans.retrieve import BaseRetriever
from thicket.plans.tree import Tree
from thicket.scratch import stored


def flat_select(queries: DataFrame, rows: DataFrame, k: int, max_tokens: int | None = None) -> DataFrame:
    """The k rows of the largest inner product; with a budget, up to and with the row that overflows it.  Only real rows: fewer than k if there are fewer."""
    return within_budget(top_k(queries, rows, k, "inner_product", carry=("n_tokens",)), max_tokens, include_overflow=True)


class FlatRetriever(BaseRetriever):
    """Over the chunks of any number of texts, each named by its tree_id and number there."""

    def __init__(self, cfg: FlatConfig | None = None):
        self.cfg = cfg or FlatConfig()
        self.rows: DataFrame | None = None

    def build_from_text(self, docs: DataFrame) -> FlatRetriever:
        """Indexes the chunks of docs(tree_id, text)."""
        cut = chunks(docs.select(F.col("tree_id").cast("long").alias("tree_id"), "text"), self.cfg.max_tokens, 0, self.cfg.encode)
        self.rows = stored(cut.select("tree_id", F.col("chunk_index").alias("node_index"), "text", "n_tokens", embed(self.cfg.embedder, F.col("text")).alias("embedding")))
        return self

    def build_from_leaf_nodes(self, tree: Tree) -> FlatRetriever:
        """Indexes a tree's leaves with the vectors they have."""
        self.rows = tree.vectors(self.cfg.embedding_model_string).where("layer = 0").select("tree_id", "node_index", "text", "n_tokens", "embedding")
        return self

    def sanity_check(self, num_samples: int = 4, seed: int = 0) -> None:
        """Embeds some chunks again; raises AssertionError if a vector differs."""
        some = self._built().orderBy(F.xxhash64("tree_id", "node_index", F.lit(seed))).limit(num_samples)
        close = F.forall(F.zip_with("embedding", embed(self.cfg.embedder, F.col("text")), lambda a, b: F.abs(a - b) <= 1e-8 + 1e-5 * F.abs(b)), lambda x: x)
        if some.select(close.alias("ok")).where("not ok").limit(1).count():
            raise AssertionError("an indexed vector differs from its text's")

    def _built(self) -> DataFrame:
        if self.rows is None:
            raise ValueError("build the index first")
        return self.rows

    def batch(self, questions: DataFrame) -> DataFrame:
        """(query_id, context, layer_information): chunks by rank, nothing between."""
        c, rows = self.cfg, self._built()
        queries = questions.select("query_id", embed(c.question_embedder, F.col("question")).alias("query"))
        if c.use_top_k:
            got = flat_select(queries, rows, c.top_k)
        elif c.max_context_tokens is None:
            got = flat_select(queries, rows, 2**31 - 1)
        else:
            got = flat_select(queries, rows, c.max_context_tokens // c.max_tokens, c.max_context_tokens)
        key = ["tree_id", "node_index"]
        said = got.join(rows.select(*key, "text"), key).groupBy("query_id")
        where = F.transform(F.array_sort(F.collect_list(F.struct("rk", *key))), lambda x: F.struct(x["tree_id"].alias("tree_id"), x["node_index"].alias("node_index"), F.lit(0).alias("layer_number")))
        said = said.agg(flat_context(F.col("text"), F.col("rk")).alias("context"), where.alias("layer_information"))
        none = F.array().cast(said.schema["layer_information"].dataType)
        return questions.select("query_id").join(said, "query_id", "left").select("query_id", F.coalesce("context", F.lit("")).alias("context"), F.coalesce("layer_information", none).alias("layer_information"))

    def retrieve(self, query: str) -> str:
        one = self._built().sparkSession.createDataFrame([(0, query)], "query_id long, question string")
        return self.batch(one).first().context
