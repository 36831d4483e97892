"""Registered queries of the retrieval engine, by name, and their DuckDB SQL.

Searches take as queries every row whose id is divisible by 50, against all rows.
"""

from __future__ import annotations

import functools
import re
import uuid
from collections.abc import Callable
from types import SimpleNamespace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from thicket.config import ClusterConfig, EngineConfig, FlatConfig
from thicket.functions.text import ANSWER_PROMPT, ANSWER_SYSTEM, CHAT_ANSWER_PROMPT, SEQ2SEQ_PROMPT, SUMMARY_PROMPT, SUMMARY_SYSTEM, context, counted_chunks, flat_context, prompt, sentences, spaced, subsentences, token_count
from thicket.functions.vectors import square
from thicket.models import ChatAnswer, ChatSummary, CompletionAnswer, CompletionSummary, HashedEmbedding, HostedEmbedding, LargeChatAnswer, LeadSummary, OverlapAnswer, SentenceEmbedding, Seq2SeqAnswer, answer, embed, summarize
from thicket.operators.chunk import chunks
from thicket.operators.cluster import MixtureClustering, orphans, reduced, soft_cluster, two_level, value_backmap
from thicket.operators.mixture import bic_sweep
from thicket.operators.search import beyond, top_k
from thicket.operators.traverse import traverse
from thicket.plans.build import BUILDERS, build_tree, neighbours, number_parents
from thicket.plans.engine import Engine
from thicket.plans.flat import FlatRetriever, flat_select
from thicket.plans.retrieve import collapsed, contexts
from thicket.plans.tree import Tree
from thicket.scratch import folder, stored
from thicket.sources.store import load_tree, read_texts, save_tree
from thicket.sources.tables import read_table, spread
from thicket.streaming.ingest import write_leaves

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
MODEL = HashedEmbedding(64)


def _query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    df = read_table(spark, d, name)
    return spread(df) if name == "documents" else df


def _round(c: Column) -> Column:
    return F.round(c, 6) + F.lit(0.0)


def _vectors(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    rows = _table(spark, d, "embeddings").select(F.col("vec_id").alias("node_index"), "embedding", "label")
    return rows.where("node_index % 50 = 0").select(F.col("node_index").alias("query_id"), F.col("embedding").alias("query")), rows


def _near(found: DataFrame) -> DataFrame:
    return found.select("query_id", "node_index", "rk", _round(F.col("score")).alias("dist"))


_Q = "q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id % 50 = 0)"
_COS = "round(1 - list_inner_product({a}, {b}) / sqrt(list_inner_product({a}, {a}) * list_inner_product({b}, {b})), 12)"
_DIST = {
    "cosine": _COS.format(a="q.v", b="e.v"),
    "L1": "round(list_sum(list_transform(list_zip(q.v, e.v), lambda z: abs(z[1] - z[2]))), 12)",
    "L2": "round(list_distance(q.v, e.v), 12)",
    "Linf": "list_max(list_transform(list_zip(q.v, e.v), lambda z: abs(z[1] - z[2])))",
    "inner_product": "round(-list_inner_product(q.v, e.v), 12)",
}


def _search_sql(metric: str, keep: str, where: str = "TRUE") -> str:
    return f"""WITH {_Q}, e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings),
p AS (SELECT query_id, vec_id AS node_index, {_DIST[metric]} AS d FROM q, e),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, node_index) AS rk FROM p WHERE {where})
SELECT query_id, node_index, CAST(rk AS INTEGER) AS rk, round(d, 6) + 0.0 AS dist FROM r WHERE {keep}"""


def _metric_query(name: str, metric: str) -> None:
    def run(spark: SparkSession, d: str) -> DataFrame:
        q, rows = _vectors(spark, d)
        return _near(top_k(q, rows, 10, metric))

    run.__name__ = name
    _query(_search_sql(metric, "rk <= 10"))(run)


for _name, _metric in (("cosine_topk", "cosine"), ("l1_topk", "L1"), ("l2_topk", "L2"), ("linf_topk", "Linf"), ("inner_product_topk", "inner_product")):
    _metric_query(_name, _metric)


@_query(_search_sql("cosine", "TRUE", "d > 1.0"))
def threshold_select(spark: SparkSession, d: str) -> DataFrame:
    return _near(beyond(*_vectors(spark, d), 1.0))


@_query(_search_sql("cosine", "rk <= 5").replace("query_id, node_index, CAST", "query_id AS node_index, node_index AS neighbour, CAST"))
def knn_graph(spark: SparkSession, d: str) -> DataFrame:
    q, rows = _vectors(spark, d)
    found = top_k(q, rows, 5)
    return found.select(F.col("query_id").alias("node_index"), F.col("node_index").alias("neighbour"), "rk", _round(F.col("score")).alias("dist"))


# Fixed values, as in functions.text: the white space of Python's str.strip().
_BLANK = r"\t\n\x0B\x0C\r\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
_SENTENCES = f"list_filter(regexp_split_to_array(coalesce(text, ''), '[.!?\\n]'), lambda s: regexp_matches(s, '[^{_BLANK}]'))"


def _clauses(s: str) -> str:
    return f"list_filter(list_transform(regexp_split_to_array({s}, '[,;:]'), lambda x: regexp_replace(x, '^[{_BLANK}]+|[{_BLANK}]+$', '', 'g')), lambda x: x <> '')"


def _count(s: str) -> str:
    return f"len(regexp_extract_all({s}, '[^{_BLANK}]+'))"


@_query(f"SELECT doc_id, CAST(i - 1 AS INTEGER) AS sentence_index, md5(xs[i]) AS sentence FROM (SELECT doc_id, xs, unnest(range(1, len(xs) + 1)) AS i FROM (SELECT doc_id, {_SENTENCES} AS xs FROM documents))")
def sentence_split(spark: SparkSession, d: str) -> DataFrame:
    out = _table(spark, d, "documents").select("doc_id", F.posexplode(sentences(F.col("text"))).alias("sentence_index", "s"))
    return out.select("doc_id", "sentence_index", F.md5("s").alias("sentence"))


@_query(f"SELECT doc_id, CAST(i - 1 AS INTEGER) AS sentence_index, CAST({_count('xs[i]')} AS INTEGER) AS n_tokens FROM (SELECT doc_id, xs, unnest(range(1, len(xs) + 1)) AS i FROM (SELECT doc_id, {_SENTENCES} AS xs FROM documents))")
def sentence_tokens(spark: SparkSession, d: str) -> DataFrame:
    out = _table(spark, d, "documents").select("doc_id", F.posexplode(sentences(F.col("text"))).alias("sentence_index", "s"))
    return out.select("doc_id", "sentence_index", token_count(F.col("s")).alias("n_tokens"))


@_query(f"SELECT doc_id, CAST(i AS INTEGER) AS sentence_index, CAST(generate_subscripts(ys, 1) - 1 AS INTEGER) AS part, md5(unnest(ys)) AS said FROM (SELECT doc_id, i - 1 AS i, {_clauses('xs[i]')} AS ys FROM (SELECT doc_id, xs, unnest(range(1, len(xs) + 1)) AS i FROM (SELECT doc_id, {_SENTENCES} AS xs FROM documents)))")
def subsentence_split(spark: SparkSession, d: str) -> DataFrame:
    out = _table(spark, d, "documents").select("doc_id", F.posexplode(sentences(F.col("text"))).alias("sentence_index", "s"))
    return out.select("doc_id", "sentence_index", F.posexplode(subsentences(F.col("s"))).alias("part", "c")).select("doc_id", "sentence_index", "part", F.md5("c").alias("said"))


def _fold(pieces: str, most: int = 100) -> str:
    """Chunks of a list of structs (s text, c tokens, own chunks or NULL) in DuckDB: a fold over structs of one type."""
    zero = "{'chunks': []::VARCHAR[], 'buf': '', 'k': 0, 'n': 0, 's': '', 'c': 0, 'own': NULL::VARCHAR[]}"
    item = "{'chunks': []::VARCHAR[], 'buf': '', 'k': 0, 'n': 0, 's': x.s, 'c': x.c, 'own': x.own}"
    step = f"""CASE WHEN x.own IS NOT NULL THEN {{'chunks': list_concat(a.chunks, x.own), 'buf': a.buf, 'k': a.k, 'n': a.n, 's': '', 'c': 0, 'own': NULL::VARCHAR[]}}
WHEN a.k > 0 AND a.n + x.c > {most} THEN {{'chunks': list_append(a.chunks, a.buf), 'buf': x.s, 'k': 1, 'n': x.c, 's': '', 'c': 0, 'own': NULL::VARCHAR[]}}
ELSE {{'chunks': a.chunks, 'buf': CASE WHEN a.k > 0 THEN a.buf || ' ' || x.s ELSE x.s END, 'k': a.k + 1, 'n': a.n + x.c, 's': '', 'c': 0, 'own': NULL::VARCHAR[]}} END"""
    return f"list_reduce(list_prepend({zero}, list_transform({pieces}, lambda x: {item})), lambda a, x: {step})"


def _chunks_sql(table: str = "documents", key: str = "doc_id", most: int = 100, size: Callable[[str], str] = _count) -> str:
    """CTEs up to chunks(key, chunk_index, chunk, n_tokens)."""
    clause = f"list_transform({_clauses('s')}, lambda y: {{'s': y, 'c': CAST({size('y')} AS INTEGER), 'own': NULL::VARCHAR[]}})"
    return f"""s AS (SELECT {key}, i, s, CAST({size('s')} AS INTEGER) AS c FROM (SELECT {key}, i, xs[i] AS s FROM (SELECT {key}, xs, unnest(range(1, len(xs) + 1)) AS i FROM (SELECT {key}, {_SENTENCES} AS xs FROM {table})))),
t AS (SELECT {key}, i, s, c, CASE WHEN c > {most} THEN {_fold(clause, most)} END AS f FROM s),
u AS (SELECT {key}, list({{'s': s, 'c': c, 'own': CASE WHEN c > {most} THEN CASE WHEN f.k > 0 THEN list_append(f.chunks, f.buf) ELSE f.chunks END END}} ORDER BY i) AS xs FROM t GROUP BY {key}),
v AS (SELECT {key}, {_fold('xs', most)} AS f FROM u),
w AS (SELECT {key}, CASE WHEN f.k > 0 THEN list_append(f.chunks, f.buf) ELSE f.chunks END AS cs FROM v),
chunks AS (SELECT {key}, i - 1 AS chunk_index, cs[i] AS chunk, {_count('cs[i]')} AS n_tokens FROM (SELECT {key}, cs, unnest(range(1, len(cs) + 1)) AS i FROM w))"""


def _chunked(spark: SparkSession, d: str) -> DataFrame:
    return chunks(_table(spark, d, "documents").select(F.col("doc_id").alias("tree_id"), "text"), 100)


@_query(f"WITH {_chunks_sql()} SELECT doc_id, CAST(chunk_index AS INTEGER) AS chunk_index, md5(chunk) AS chunk, CAST(n_tokens AS INTEGER) AS n_tokens FROM chunks")
def chunk_text(spark: SparkSession, d: str) -> DataFrame:
    return _chunked(spark, d).select(F.col("tree_id").alias("doc_id"), "chunk_index", F.md5("text").alias("chunk"), "n_tokens")


@_query(f"WITH {_chunks_sql()} SELECT lang, count(*) AS n_chunks, CAST(sum(n_tokens) AS BIGINT) AS n_tokens, CAST(max(n_tokens) AS INTEGER) AS most FROM chunks JOIN documents USING (doc_id) GROUP BY lang")
def chunk_stats(spark: SparkSession, d: str) -> DataFrame:
    docs = _table(spark, d, "documents")
    out = docs.select("lang", F.col("doc_id").alias("tree_id"), "text")
    each = out.select("lang", F.explode(counted_chunks(F.col("text"), 100)).alias("c")).select("lang", F.col("c.n_tokens").alias("n"))
    return each.groupBy("lang").agg(F.count("*").alias("n_chunks"), F.sum("n").cast("long").alias("n_tokens"), F.max("n").alias("most"))


_LINE = r"regexp_replace(regexp_replace(chunk, '(?:\r\n|[\n\x0B\x0C\r\x1C-\x1E\x{85}\x{2028}\x{2029}])$', ''), '\r\n|[\n\x0B\x0C\r\x1C-\x1E\x{85}\x{2028}\x{2029}]', ' ', 'g')"


@_query(f"WITH {_chunks_sql()} SELECT doc_id, md5(string_agg({_LINE} || chr(10) || chr(10), '' ORDER BY chunk_index)) AS context FROM chunks GROUP BY doc_id")
def context_concat(spark: SparkSession, d: str) -> DataFrame:
    return _chunked(spark, d).groupBy(F.col("tree_id").alias("doc_id")).agg(F.md5(context(F.col("text"), F.col("chunk_index"))).alias("context"))


@_query(f"WITH {_chunks_sql()} SELECT doc_id, md5(string_agg(chunk, '' ORDER BY chunk_index)) AS context FROM chunks GROUP BY doc_id")
def flat_concat(spark: SparkSession, d: str) -> DataFrame:
    return _chunked(spark, d).groupBy(F.col("tree_id").alias("doc_id")).agg(F.md5(flat_context(F.col("text"), F.col("chunk_index"))).alias("context"))


@_query("SELECT doc_id, md5(replace(text, chr(10), ' ')) AS text FROM documents")
def newline_normalize(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "documents").select("doc_id", F.md5(spaced(F.col("text"))).alias("text"))


def _hashed_sql(table: str, key: str) -> str:
    return f"""(SELECT {key}, list(coalesce(n, 0)::DOUBLE ORDER BY b) AS v FROM (SELECT {key}, b FROM {table}, (SELECT unnest(range(64)) AS b)) g
LEFT JOIN (SELECT {key}, b, count(*) AS n FROM (SELECT {key}, ('0x' || substr(md5(w), 1, 8))::BIGINT % 64 AS b FROM (SELECT {key}, unnest(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+')) AS w FROM {table})) GROUP BY ALL) USING ({key}, b) GROUP BY {key})"""


def _hashed(df: DataFrame) -> Column:
    return embed(MODEL, F.col("text"))


@_query(f"SELECT doc_id, array_to_string(list_transform(v, lambda x: x::BIGINT), ',') AS embedding FROM {_hashed_sql('documents', 'doc_id')}")
def hashed_embedding(spark: SparkSession, d: str) -> DataFrame:
    docs = _table(spark, d, "documents")
    return docs.select("doc_id", F.array_join(F.transform(_hashed(docs), lambda x: x.cast("long").cast("string")), ",").alias("embedding"))


def _asked(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    asked, docs = _table(spark, d, "benchmark"), _table(spark, d, "documents")
    return asked.select(F.col("item_id").alias("query_id"), _hashed(asked).alias("query")), docs.select(F.col("doc_id").alias("node_index"), F.lit(0).alias("layer"), token_count(F.coalesce("text", F.lit(""))).alias("n_tokens"), _hashed(docs).alias("embedding"))


def _asked_sql(score: str, k: int, keep: str) -> str:
    return f"""WITH q AS {_hashed_sql('benchmark', 'item_id')}, e AS {_hashed_sql('documents', 'doc_id')},
p AS (SELECT item_id AS query_id, doc_id AS node_index, {score} AS d FROM q, e),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, node_index) AS rk FROM p QUALIFY rk <= {k}),
t AS (SELECT r.*, {_count("coalesce(text, '')")} AS n_tokens FROM r JOIN documents ON doc_id = node_index),
u AS (SELECT *, sum(n_tokens) OVER (PARTITION BY query_id ORDER BY rk) AS run FROM t)
SELECT query_id, CAST(rk AS INTEGER) AS rk, node_index, CAST(n_tokens AS INTEGER) AS n_tokens, round(d, 6) + 0.0 AS dist FROM u WHERE {keep}"""


@_query(_asked_sql("CASE WHEN list_inner_product(q.v, q.v) * list_inner_product(e.v, e.v) > 0 THEN " + _DIST["cosine"] + " ELSE 'NaN'::DOUBLE END", 10, "run <= 3500"))
def collapsed_budget(spark: SparkSession, d: str) -> DataFrame:
    q, rows = _asked(spark, d)
    return collapsed(q, rows, 10, 3500).select("query_id", "rk", "node_index", "n_tokens", _round(F.col("score")).alias("dist"))


def _flat(found: DataFrame) -> DataFrame:
    return found.select("query_id", "rk", "node_index", "n_tokens", _round(F.col("score")).alias("dist"))


@_query(_asked_sql(_DIST["inner_product"], 35, "run - n_tokens <= 3500"))
def flat_budget(spark: SparkSession, d: str) -> DataFrame:
    return _flat(flat_select(*_asked(spark, d), 35, 3500))


@_query(_asked_sql(_DIST["inner_product"], 5, "TRUE"))
def flat_topk(spark: SparkSession, d: str) -> DataFrame:
    return _flat(flat_select(*_asked(spark, d), 5))


#: A tree of known shape: layer 1 has a node for each label, layer 2 one for each label % 3; each has the vector of its least row.
_L1, _L2 = 1_000_000_000, 2_000_000_000


def _known_tree(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    q, rows = _vectors(spark, d)
    rows = rows.where("label is not null")
    up = lambda key, base, layer: rows.groupBy(key.alias("g")).agg(F.min_by("embedding", "node_index").alias("embedding")).select(F.lit(layer).alias("layer"), (F.col("g") + base).cast("long").alias("node_index"), "embedding")
    nodes = rows.select(F.lit(0).alias("layer"), "node_index", "embedding").union(up(F.col("label"), _L1, 1)).union(up(F.col("label") % 3, _L2, 2))
    edges = rows.select((F.col("label") + _L1).cast("long").alias("parent_index"), F.col("node_index").alias("child_index"))
    edges = edges.union(rows.select((F.col("label") % 3 + _L2).cast("long"), (F.col("label") + _L1).cast("long")).distinct())
    return q, nodes.withColumn("n_tokens", (1 + F.col("node_index") % 50).cast("int")), edges


_TREE_SQL = f"""{_Q}, l0 AS (SELECT 0 AS layer, vec_id AS node_index, embedding::DOUBLE[] AS v, label FROM embeddings WHERE label IS NOT NULL),
nodes AS (SELECT layer, node_index, v FROM l0 UNION ALL SELECT 1, label + {_L1}, arg_min(v, node_index) FROM l0 GROUP BY label UNION ALL SELECT 2, label % 3 + {_L2}, arg_min(v, node_index) FROM l0 GROUP BY label % 3),
edges AS (SELECT label + {_L1} AS parent, node_index AS child FROM l0 UNION ALL SELECT DISTINCT label % 3 + {_L2}, label + {_L1} FROM l0),
s0 AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, node_index) AS rk FROM (SELECT query_id, node_index, {_COS.format(a='q.v', b='e.v')} AS d FROM q, nodes e WHERE layer = 2) QUALIFY rk <= 2),
s1 AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, node_index) AS rk FROM (SELECT c.query_id, e.node_index, {_COS.format(a='q.v', b='e.v')} AS d FROM (SELECT DISTINCT query_id, child FROM s0 JOIN edges ON parent = node_index) c JOIN q USING (query_id) JOIN nodes e ON e.node_index = child) QUALIFY rk <= 2),
s2 AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, node_index) AS rk FROM (SELECT c.query_id, e.node_index, {_COS.format(a='q.v', b='e.v')} AS d FROM (SELECT DISTINCT query_id, child FROM s1 JOIN edges ON parent = node_index) c JOIN q USING (query_id) JOIN nodes e ON e.node_index = child) QUALIFY rk <= 2),
walk AS (SELECT 0 AS step, * FROM s0 UNION ALL SELECT 1, * FROM s1 UNION ALL SELECT 2, * FROM s2)"""


@_query(f"WITH {_TREE_SQL} SELECT query_id, step, CAST(rk AS INTEGER) AS rk, node_index, round(d, 6) + 0.0 AS dist FROM walk")
def tree_traverse(spark: SparkSession, d: str) -> DataFrame:
    q, nodes, edges = _known_tree(spark, d)
    return traverse(q, nodes, edges, 2, 3, "top_k", 2).select("query_id", "step", "rk", "node_index", _round(F.col("score")).alias("dist"))


@_query(f"WITH {_TREE_SQL} SELECT query_id, string_agg(node_index || ':' || layer, ',' ORDER BY step, rk) AS layers FROM walk JOIN nodes USING (node_index) GROUP BY query_id")
def layer_information(spark: SparkSession, d: str) -> DataFrame:
    q, nodes, edges = _known_tree(spark, d)
    walked = traverse(q, nodes, edges, 2, 3, "top_k", 2).withColumn("at", F.struct("step", "rk"))
    got = contexts(q, walked, nodes.withColumn("text", F.lit("")), order="at")
    return got.select("query_id", F.array_join(F.transform("layer_information", lambda x: F.concat_ws(":", x["node_index"], x["layer_number"])), ",").alias("layers"))


@_query(f"""WITH {_TREE_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, node_index) AS rk FROM (SELECT query_id, node_index, layer, 1 + node_index % 50 AS n_tokens, {_COS.format(a='q.v', b='e.v')} AS d FROM q, nodes e) QUALIFY rk <= 10),
u AS (SELECT *, sum(n_tokens) OVER (PARTITION BY query_id ORDER BY rk) AS run FROM r)
SELECT query_id, CAST(rk AS INTEGER) AS rk, node_index, layer, round(d, 6) + 0.0 AS dist FROM u WHERE run <= 200""")
def collapsed_layers(spark: SparkSession, d: str) -> DataFrame:
    q, nodes, _ = _known_tree(spark, d)
    return collapsed(q, nodes, 10, 200).select("query_id", "rk", "node_index", "layer", _round(F.col("score")).alias("dist"))


@_query("SELECT label AS cluster_id, CAST((SELECT count(*) FROM embeddings) + row_number() OVER (ORDER BY label) - 1 AS INTEGER) AS node_index FROM (SELECT DISTINCT label FROM embeddings WHERE label IS NOT NULL)")
def parent_numbering(spark: SparkSession, d: str) -> DataFrame:
    rows = _table(spark, d, "embeddings")
    found = rows.where("label is not null").select(F.lit(0).cast("long").alias("tree_id"), F.col("label").alias("cluster_id"))
    return number_parents(found, rows.agg(F.count("*").alias("base")).withColumn("tree_id", F.lit(0).cast("long"))).select("cluster_id", "node_index")


@_query("SELECT DISTINCT a.vec_id AS node_index, CAST(b.vec_id % 7 AS INTEGER) AS label FROM embeddings a JOIN embeddings b ON a.embedding = b.embedding WHERE b.vec_id % 2 = 0")
def value_backmap_of_vectors(spark: SparkSession, d: str) -> DataFrame:
    rows = _table(spark, d, "embeddings").select(F.col("vec_id").alias("node_index"), "embedding")
    return value_backmap(rows, rows.where("node_index % 2 = 0").select("node_index", (F.col("node_index") % 7).cast("int").alias("label")))


@_query("SELECT vec_id AS node_index FROM embeddings WHERE label IS NOT NULL AND vec_id % 5 = 0")
def orphan_nodes(spark: SparkSession, d: str) -> DataFrame:
    _, nodes, edges = _known_tree(spark, d)
    tree = F.lit(0).cast("long").alias("tree_id")
    return orphans(nodes.select("*", tree), edges.where(f"child_index % 5 != 0 or child_index >= {_L1}").select("*", tree)).select("node_index")


@_query("SELECT conv_id, turn, md5('" + ANSWER_PROMPT.replace("{context}", "' || role || '").replace("{question}", "' || text || '") + "') AS prompt FROM conversations WHERE role = 'user'")
def prompt_format(spark: SparkSession, d: str) -> DataFrame:
    rows = _table(spark, d, "conversations").where("role = 'user'")
    return rows.select("conv_id", "turn", F.md5(prompt(ANSWER_PROMPT, context=F.col("role"), question=F.col("text"))).alias("prompt"))


_PARTS = f"list_filter(list_transform(regexp_split_to_array(coalesce(CONTEXT, ''), '[.!?\n]'), lambda x: regexp_replace(x, '^[{_BLANK}]+|[{_BLANK}]+$', '', 'g')), lambda x: x <> '')"
_WORDS_OF = "list_distinct(regexp_extract_all(lower({x}), '[a-z0-9]+'))"


def _best_sentence(context: str, question: str) -> str:
    """The sentence of a context that shares most distinct words with a question, the first that does."""
    shared = f"list_transform({_PARTS.replace('CONTEXT', context)}, lambda x: len(list_intersect({_WORDS_OF.format(x='x')}, {_WORDS_OF.format(x=question)})))"
    return f"coalesce({_PARTS.replace('CONTEXT', context)}[list_position({shared}, list_max({shared}))], '')"


@_query(f"SELECT doc_id, md5({_best_sentence('d.text', 'b.text')}) AS answer FROM documents d JOIN benchmark b ON d.doc_id % (SELECT count(*) FROM benchmark) = b.item_id")
def qa_overlap(spark: SparkSession, d: str) -> DataFrame:
    """Each document as the context of one question."""
    docs, asked = _table(spark, d, "documents"), _table(spark, d, "benchmark")
    pairs = docs.join(asked.select("item_id", F.col("text").alias("question")), F.col("doc_id") % F.lit(asked.count()) == F.col("item_id"))
    return pairs.select("doc_id", F.md5(answer(OverlapAnswer(), F.col("text"), F.col("question"))).alias("answer"))


_LINES = rf"list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_extract_all(x, '[^{_BLANK}]+')), lambda x: len(x) > 0)"


@_query(f"""SELECT doc_id, md5(array_to_string(flatten(list_transform(xs, lambda x, i: x[1:20 // len(xs) + CASE WHEN i <= 20 % len(xs) THEN 1 ELSE 0 END])), ' ')) AS summary
FROM (SELECT doc_id, {_LINES} AS xs FROM documents) WHERE len(xs) > 0 UNION ALL SELECT doc_id, md5('') FROM (SELECT doc_id, {_LINES} AS xs FROM documents) WHERE len(xs) = 0""")
def lead_summary(spark: SparkSession, d: str) -> DataFrame:
    docs = _table(spark, d, "documents")
    return docs.select("doc_id", F.md5(summarize(LeadSummary(), F.col("text"), 20)).alias("summary"))


# Vectors about four axes by vec_id, 0.02 times a row's own first eight components off: planted groups.
_BLOB = "list_transform(range(0, 8), lambda k: CASE WHEN k = vec_id % 4 THEN 1.0 ELSE 0.0 END + 0.02 * embedding[k + 1])"


def _blobs(spark: SparkSession, d: str) -> DataFrame:
    rows = _table(spark, d, "embeddings")
    near = F.array(*[F.when(F.col("vec_id") % 4 == k, 1.0).otherwise(0.0) + 0.02 * F.col("embedding")[k] for k in range(8)])
    return rows.select(F.lit("0").alias("group"), F.col("vec_id").cast("int").alias("node_index"), near.alias("embedding"))


@_query("SELECT CAST(vec_id AS INTEGER) AS node_index, CAST(vec_id % 4 AS INTEGER) AS least FROM embeddings")
def planted_soft_cluster(spark: SparkSession, d: str) -> DataFrame:
    """Both levels of clustering over planted groups; a label is named by its least row."""
    found = stored(two_level(_blobs(spark, d), ClusterConfig()))
    names = found.groupBy("label").agg(F.min("node_index").alias("least"))
    return found.join(names, "label").select("node_index", "least")


@_query("SELECT 4 AS components")
def number_of_components(spark: SparkSession, d: str) -> DataFrame:
    """The number of components with the least BIC, of all that are tried, for planted groups."""
    return soft_cluster(_blobs(spark, d), ClusterConfig(), shrink=True).select(F.col("n_labels").alias("components")).distinct()


_UNIT = "list_transform(v, lambda x: x / sqrt(list_inner_product(v, v)))"


@_query(f"""WITH u AS (SELECT vec_id, {_UNIT} AS u FROM (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings)),
m AS (SELECT list(a ORDER BY k) AS m FROM (SELECT k, avg(u[k]) AS a FROM (SELECT u, unnest(range(1, len(u) + 1)) AS k FROM u) GROUP BY k))
SELECT CAST(vec_id AS INTEGER) AS node_index, round(list_sum(list_transform(list_zip(u, m), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), 6) + 0.0 AS size FROM u, m""")
def pca_reduce(spark: SparkSession, d: str) -> DataFrame:
    """Squared lengths on all principal axes, which are those of the centred unit vectors."""
    rows = _table(spark, d, "embeddings").select(F.lit("0").alias("group"), F.col("vec_id").cast("int").alias("node_index"), "embedding")
    out = reduced(rows, ClusterConfig(reduction_dimension=64))
    return out.select("node_index", _round(square(F.col("reduced"))).alias("size"))


_BIC = """WITH x AS (SELECT embedding[1]::DOUBLE AS a, embedding[2]::DOUBLE AS b FROM embeddings),
s AS (SELECT count(*) AS n, avg(a) AS ma, avg(b) AS mb, var_pop(a) + 1e-6 AS va, var_pop(b) + 1e-6 AS vb, covar_pop(a, b) AS c FROM x),
l AS (SELECT n, -0.5 * sum(2 * ln(2 * pi()) + ln(va * vb - c * c) + (vb * (a - ma) * (a - ma) - 2 * c * (a - ma) * (b - mb) + va * (b - mb) * (b - mb)) / (va * vb - c * c)) AS like_ FROM x, s GROUP BY n)
SELECT round(-2 * like_ + 5 * ln(n), 4) AS bic FROM l"""


@_query(_BIC)
def bic_of_one(spark: SparkSession, d: str) -> DataFrame:
    """The BIC of a single component, which has a closed form, over two dimensions of all vectors."""
    import numpy as np
    import pandas as pd

    def fit(part: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"bic": bic_sweep(part[["a", "b"]].to_numpy(np.float64), [1])})

    rows = _table(spark, d, "embeddings").select(F.col("embedding")[0].cast("double").alias("a"), F.col("embedding")[1].cast("double").alias("b"))
    return rows.withColumn("all", F.lit(0)).groupBy("all").applyInPandas(fit, "bic double").select(F.round("bic", 4).alias("bic"))


@_query("SELECT CAST(doc_id AS INTEGER) AS node_index, TRUE AS covered, FALSE AS over FROM documents")
def cluster_split(spark: SparkSession, d: str) -> DataFrame:
    """Documents clustered by their vectors and split until each cluster of several is within the limit: for each document whether it is in a cluster, and in one over the limit."""
    docs = _table(spark, d, "documents")
    nodes = stored(docs.select(F.lit(0).cast("long").alias("tree_id"), F.col("doc_id").cast("int").alias("node_index"), token_count(F.coalesce("text", F.lit(""))).alias("n_tokens"), _hashed(docs).alias("embedding")))
    cfg = ClusterConfig()
    found = stored(MixtureClustering().perform_clustering(nodes, cfg))
    size = found.join(nodes, "node_index").groupBy("cluster_id").agg((F.count("*") > 1).alias("several"), (F.sum("n_tokens") > cfg.max_length_in_cluster).alias("long"))
    each = found.join(size, "cluster_id").groupBy("node_index").agg(F.max(F.col("several") & F.col("long")).alias("over"))
    return nodes.join(each, "node_index", "left").select("node_index", F.col("over").isNotNull().alias("covered"), F.coalesce("over", F.lit(False)).alias("over"))


@_query(f"""WITH {_chunks_sql()}, l AS (SELECT doc_id, count(*) AS n, sum(n_tokens) AS t FROM chunks GROUP BY doc_id)
SELECT doc_id, n AS n_leaves, CAST(t AS BIGINT) AS n_tokens, n > 11 AS has_layers, TRUE AS dense, TRUE AS linked, TRUE AS summed_up, TRUE AS ends_low FROM l""")
def tree_build(spark: SparkSession, d: str) -> DataFrame:
    """Trees of all documents with default settings, and what must hold of each: numbers without gaps, all nodes but the top ones under a parent one layer up, parents' texts the summary of their children's, and a top of at most 11 nodes or in the last layer."""
    cfg = ClusterConfig()
    tree = build_tree(_table(spark, d, "documents").select(F.col("doc_id").alias("tree_id"), "text"), cfg)
    nodes = tree.nodes
    size = stored(nodes.groupBy("tree_id").agg(F.count_if(F.col("layer") == 0).alias("n_leaves"), F.sum(F.when(F.col("layer") == 0, F.col("n_tokens"))).alias("n_tokens"), F.max("layer").alias("top"), (F.max("node_index") + 1 == F.count("*")).alias("dense")))
    tops = nodes.join(size.select("tree_id", "top"), "tree_id").where("layer = top").groupBy("tree_id").agg(F.count("*").alias("n_top"))
    lost = orphans(nodes, tree.edges).groupBy("tree_id").agg(F.count("*").alias("lost"))
    tied = tree.edges.select("tree_id").distinct()
    low = nodes.join(tied, "tree_id", "left_semi").select("tree_id", F.col("node_index").alias("child_index"), F.col("layer").alias("below"), F.col("text").alias("said"))
    under = tree.edges.join(low, ["tree_id", "child_index"]).groupBy("tree_id", F.col("parent_index").alias("node_index")).agg(context(F.col("said"), F.col("child_index")).alias("context"), F.min("below").alias("b0"), F.max("below").alias("b1"))
    above = nodes.where("layer > 0").join(under, ["tree_id", "node_index"], "left")
    bad = above.select("tree_id", (F.coalesce(F.col("b0") != F.col("layer") - 1, F.lit(True)) | F.coalesce(F.col("b1") != F.col("layer") - 1, F.lit(True))).alias("astray"), (~F.col("text").eqNullSafe(summarize(cfg.summarization_model, F.col("context"), cfg.summarization_length))).alias("other"))
    bad = bad.groupBy("tree_id").agg(F.count_if(F.col("astray")).alias("astray"), F.count_if(F.col("other")).alias("other"))
    none = F.lit(0)
    out = size.join(tops, "tree_id").join(lost, "tree_id", "left").join(bad, "tree_id", "left")
    return out.select(F.col("tree_id").alias("doc_id"), "n_leaves", "n_tokens", (F.col("top") > 0).alias("has_layers"), "dense", ((F.coalesce("lost", none) == 0) & (F.coalesce("astray", none) == 0)).alias("linked"), (F.coalesce("other", none) == 0).alias("summed_up"), ((F.col("n_top") <= cfg.reduction_dimension + 1) | (F.col("top") == cfg.num_layers)).alias("ends_low"))


def _tree(spark: SparkSession, d: str) -> Tree:
    """The tree of known shape with a second one beside it, lower by a layer: tree 0 has the even labels, tree 1 the odd ones."""
    _, nodes, edges = _known_tree(spark, d)
    rows = nodes.select("*", F.when(F.col("layer") == 0, None).otherwise(F.col("node_index") % 1_000_000_000).alias("g"))
    labels = _table(spark, d, "embeddings").where("label is not null").select(F.col("vec_id").alias("node_index"), "label")
    low = rows.where("layer = 0").join(labels, "node_index").select((F.col("label") % 2).cast("long").alias("tree_id"), "layer", F.col("node_index").cast("int").alias("node_index"), "n_tokens", "embedding")
    mid = rows.where("layer = 1").select((F.col("g") % 2).cast("long").alias("tree_id"), "layer", F.col("node_index").cast("int").alias("node_index"), "n_tokens", "embedding")
    top = mid.where("tree_id = 0").groupBy("tree_id").agg(F.min_by("embedding", "node_index").alias("embedding")).select("tree_id", F.lit(2).alias("layer"), F.lit(_L2).alias("node_index"), F.lit(9).alias("n_tokens"), "embedding")
    both = stored(low.union(mid).union(top).withColumn("text", F.concat_ws(" ", F.lit("node"), "node_index")))
    down = labels.select((F.col("label") % 2).cast("long").alias("tree_id"), (F.col("label") + _L1).cast("int").alias("parent_index"), F.col("node_index").cast("int").alias("child_index"))
    down = down.union(mid.where("tree_id = 0").select("tree_id", F.lit(_L2), "node_index"))
    return Tree(both.select("tree_id", "layer", "node_index", "text", "n_tokens"), both.select("tree_id", "layer", "node_index", F.lit("EMB").alias("model"), F.col("embedding").cast("array<float>").alias("embedding")), down, both.groupBy("tree_id").agg(F.max("layer").cast("int").alias("num_layers")))


_FOREST = f"""{_Q}, l0 AS (SELECT label % 2 AS tree_id, 0 AS layer, vec_id AS node_index, 1 + vec_id % 50 AS n_tokens, embedding::DOUBLE[] AS v, label FROM embeddings WHERE label IS NOT NULL),
l1 AS (SELECT label % 2 AS tree_id, 1 AS layer, label + {_L1} AS node_index, 1 + (label + {_L1}) % 50 AS n_tokens, arg_min(v, node_index) AS v FROM l0 GROUP BY label),
l2 AS (SELECT 0 AS tree_id, 2 AS layer, {_L2} AS node_index, 9 AS n_tokens, arg_min(v, node_index) AS v FROM l1 WHERE tree_id = 0),
nodes AS (SELECT tree_id, layer, node_index, n_tokens, v FROM l0 UNION ALL SELECT * FROM l1 UNION ALL SELECT * FROM l2),
edges AS (SELECT tree_id, label + {_L1} AS parent, node_index AS child FROM l0 UNION ALL SELECT 0, {_L2}, node_index FROM l1 WHERE tree_id = 0)"""


def _rank_step(source: str) -> str:
    return f"(SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, tree_id, node_index) AS rk FROM (SELECT query_id, e.tree_id, e.node_index, {_COS.format(a='q.v', b='e.v')} AS d FROM {source}) QUALIFY rk <= 2)"


_BELOW = "(SELECT DISTINCT query_id, x.tree_id, child FROM {s} x JOIN edges ON x.tree_id = edges.tree_id AND parent = node_index) c JOIN q USING (query_id) JOIN nodes e ON e.tree_id = c.tree_id AND e.node_index = child"


@_query(f"""WITH {_FOREST}, s0 AS {_rank_step("q, (SELECT * FROM nodes WHERE layer = CASE WHEN tree_id = 0 THEN 2 ELSE 1 END) e")},
s1 AS {_rank_step(_BELOW.format(s="s0"))}, s2 AS {_rank_step(_BELOW.format(s="s1"))}
SELECT query_id, step, CAST(rk AS INTEGER) AS rk, tree_id, CAST(node_index AS INTEGER) AS node_index, round(d, 6) + 0.0 AS dist FROM (SELECT 0 AS step, * FROM s0 UNION ALL SELECT 1, * FROM s1 UNION ALL SELECT 2, * FROM s2)""")
def forest_traverse(spark: SparkSession, d: str) -> DataFrame:
    """A walk through two trees of unlike height at once, each from its own top."""
    q, _ = _vectors(spark, d)
    tree = _tree(spark, d)
    walked = traverse(q, tree.vectors("EMB"), tree.edges, 2, 3, "top_k", 2, heights=tree.tree_meta)
    return walked.select("query_id", "step", "rk", F.col("tree_id").cast("int").alias("tree_id"), "node_index", _round(F.col("score")).alias("dist"))


@_query(f"WITH {_FOREST} SELECT CAST(tree_id AS BIGINT) AS tree_id, layer, CAST(node_index AS INTEGER) AS node_index, CAST(n_tokens AS INTEGER) AS n_tokens, md5('node ' || node_index) AS text, round(v[1], 6) + 0.0 AS first FROM nodes")
def tree_saved(spark: SparkSession, d: str) -> DataFrame:
    """A forest, saved and loaded again: its nodes in order, with their vectors."""
    path = f"{folder(spark)}/thicket-saved-{uuid.uuid4().hex}"
    save_tree(_tree(spark, d), path)
    tree = load_tree(spark, path)
    first = tree.embeddings("EMB").select("tree_id", "node_index", _round(F.col("embedding")[0].cast("double")).alias("first"))
    return tree.node_list().join(first, ["tree_id", "node_index"]).select("tree_id", "layer", "node_index", "n_tokens", F.md5("text").alias("text"), "first")


@_query(f"WITH {_FOREST} SELECT CAST(tree_id AS BIGINT) AS tree_id, CAST(parent AS INTEGER) AS node_index, string_agg(child, ',' ORDER BY child) AS children FROM edges GROUP BY tree_id, parent")
def child_lists(spark: SparkSession, d: str) -> DataFrame:
    return _tree(spark, d).children().select("tree_id", "node_index", F.array_join(F.col("children").cast("array<string>"), ",").alias("children"))


@_query(f"WITH {_FOREST} SELECT layer, count(*) AS n_nodes, CAST(sum(n_tokens) AS BIGINT) AS n_tokens FROM nodes GROUP BY layer")
def layer_map(spark: SparkSession, d: str) -> DataFrame:
    return _tree(spark, d).nodes.groupBy("layer").agg(F.count("*").alias("n_nodes"), F.sum("n_tokens").alias("n_tokens"))


# The engine and flat retrieval over a forest: every benchmark text is a tree; the questions are the documents whose id is divisible by 50.
def _forest_sql(score: str, k: int, keep: str, most: int = 100) -> str:
    return f"""qd AS (SELECT doc_id AS query_id, text FROM documents WHERE doc_id % 50 = 0), q AS {_hashed_sql('qd', 'query_id')},
{_chunks_sql('benchmark', 'item_id', most)}, n AS (SELECT row_number() OVER () AS id, item_id, chunk_index, chunk, n_tokens FROM chunks), nt AS (SELECT id, chunk AS text FROM n), ev AS {_hashed_sql('nt', 'id')},
e AS (SELECT item_id, chunk_index, chunk, n_tokens, v FROM n JOIN ev USING (id)),
p AS (SELECT query_id, item_id, chunk_index, chunk, n_tokens, {score} AS d FROM q, e),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, item_id, chunk_index) AS rk FROM p QUALIFY rk <= {k}),
b AS (SELECT *, sum(n_tokens) OVER (PARTITION BY query_id ORDER BY rk) AS run FROM r), took AS (SELECT * FROM b WHERE {keep})"""


_SAFE = "CASE WHEN list_inner_product(q.v, q.v) * list_inner_product(e.v, e.v) > 0 THEN " + _DIST["cosine"] + " ELSE 'NaN'::DOUBLE END"
_PLACES = "string_agg(item_id || ':' || chunk_index || ':0', ',' ORDER BY rk) AS places"


def _forest(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    docs = _table(spark, d, "documents").where("doc_id % 50 = 0").select(F.col("doc_id").alias("query_id"), F.col("text").alias("question"))
    return _table(spark, d, "benchmark").select(F.col("item_id").alias("tree_id"), "text"), docs


def _places(got: DataFrame) -> DataFrame:
    at = F.transform("layer_information", lambda x: F.concat_ws(":", x["tree_id"], x["node_index"], x["layer_number"]))
    return got.where(F.size("layer_information") > 0).withColumn("places", F.array_join(at, ","))


@_query(f"WITH {_forest_sql(_SAFE, 10, 'run <= 200')} SELECT query_id, md5(string_agg({_LINE} || chr(10) || chr(10), '' ORDER BY rk)) AS context, {_PLACES} FROM took GROUP BY query_id")
def engine_retrieve(spark: SparkSession, d: str) -> DataFrame:
    """Contexts from an engine over all benchmark texts."""
    trees, asked = _forest(spark, d)
    engine = Engine(spark)
    engine.add_documents(trees)
    return _places(engine.retriever.batch(asked, top_k=10, max_tokens=200)).select("query_id", F.md5("context").alias("context"), "places")


@_query(f"""WITH {_forest_sql(_SAFE, 3, 'run <= 3500')}, c AS (SELECT query_id, string_agg({_LINE} || chr(10) || chr(10), '' ORDER BY rk) AS context, {_PLACES} FROM took GROUP BY query_id)
SELECT query_id, md5({_best_sentence('context', 'text')}) AS answer, places FROM c JOIN qd USING (query_id)""")
def answer_questions(spark: SparkSession, d: str) -> DataFrame:
    """Answers from an engine with shortcuts for its models, built, saved and loaded again."""
    trees, asked = _forest(spark, d)
    cfg = EngineConfig(embedding_model=MODEL, summarization_model=LeadSummary())
    built = Engine(spark, cfg)
    built.add_documents(trees)
    path = f"{folder(spark)}/thicket-saved-{uuid.uuid4().hex}"
    built.save(path)
    return _places(Engine(spark, cfg, path).answer_questions(asked, top_k=3)).select("query_id", F.md5("answer").alias("answer"), "places")


_FLAT_OUT = f"SELECT query_id, md5(string_agg(chunk, '' ORDER BY rk)) AS context, {_PLACES} FROM took GROUP BY query_id"


@_query(f"WITH {_forest_sql(_DIST['inner_product'], 4, 'run - n_tokens <= 120', 30)} {_FLAT_OUT}")
def flat_retriever(spark: SparkSession, d: str) -> DataFrame:
    """Flat retrieval over the chunks of all benchmark texts, with a model of its own for questions."""
    trees, asked = _forest(spark, d)
    flat = FlatRetriever(FlatConfig(max_tokens=30, max_context_tokens=120, embedding_model=MODEL, question_embedding_model=HashedEmbedding(64)))
    flat.build_from_text(trees)
    return _places(flat.batch(asked)).select("query_id", F.md5("context").alias("context"), "places")


@_query(f"WITH {_forest_sql(_DIST['inner_product'], 5, 'TRUE')} {_FLAT_OUT}")
def flat_from_leaves(spark: SparkSession, d: str) -> DataFrame:
    """Flat retrieval over the leaves of trees, through an engine."""
    trees, asked = _forest(spark, d)
    engine = Engine(spark, EngineConfig(retriever=FlatConfig(use_top_k=True, top_k=5)))
    engine.add_documents(trees)
    return _places(engine.retriever.batch(asked)).select("query_id", F.md5("context").alias("context"), "places")


_NEAR = f"""{_chunks_sql('benchmark', 'item_id', 12)}, n AS (SELECT row_number() OVER () AS id, item_id, chunk_index, chunk FROM chunks), nt AS (SELECT id, chunk AS text FROM n), ev AS {_hashed_sql('nt', 'id')},
e AS (SELECT item_id, chunk_index, v, count(*) OVER (PARTITION BY item_id) AS size FROM n JOIN ev USING (id))"""


@_query(f"""WITH {_NEAR} SELECT item_id, CAST(q.chunk_index + q.size AS INTEGER) AS parent_index, CAST(e.chunk_index AS INTEGER) AS child_index FROM e q JOIN e USING (item_id)
QUALIFY row_number() OVER (PARTITION BY item_id, q.chunk_index ORDER BY {_SAFE}, e.chunk_index) <= 2""")
def neighbour_tree(spark: SparkSession, d: str) -> DataFrame:
    """The links of trees whose nodes each have a parent over their two nearest nodes."""
    built = BUILDERS["neighbours"](ClusterConfig(max_tokens=12, num_layers=1, top_k=2)).build(_forest(spark, d)[0])
    return built.edges.select(F.col("tree_id").alias("item_id"), "parent_index", "child_index")


@_query("SELECT * FROM (VALUES ('as indexed', TRUE), ('with other vectors', FALSE)) AS t(vectors, sane)")
def sanity_check(spark: SparkSession, d: str) -> DataFrame:
    """An index as it was built, and one whose vectors were changed."""
    flat = FlatRetriever().build_from_text(_forest(spark, d)[0])
    said = []
    for name in ("as indexed", "with other vectors"):
        try:
            flat.sanity_check(100)
            said.append((name, True))
        except AssertionError:
            said.append((name, False))
        flat.rows = flat.rows.withColumn("embedding", F.transform("embedding", lambda x: x + 1))
    return spark.createDataFrame(said, "vectors string, sane boolean")


@_query("SELECT item_id, md5(text || chr(10)) AS text FROM benchmark")
def text_ingest(spark: SparkSession, d: str) -> DataFrame:
    """Texts from a folder of text files, one each."""
    path = f"{folder(spark)}/thicket-texts-{uuid.uuid4().hex}"
    _table(spark, d, "benchmark").select("item_id", "text").write.partitionBy("item_id").text(path)
    texts = read_texts(spark, f"{path}/*")
    return texts.select(F.regexp_extract("path", "item_id=([0-9]+)", 1).cast("long").alias("item_id"), F.md5("text").alias("text"))


@_query(f"WITH {_chunks_sql('benchmark', 'item_id', 12)} SELECT item_id, CAST(chunk_index AS INTEGER) AS chunk_index, md5(chunk) AS chunk, CAST(n_tokens AS INTEGER) AS n_tokens FROM chunks")
def stream_leaves(spark: SparkSession, d: str) -> DataFrame:
    """Leaves of texts that arrive as a stream."""
    path = f"{folder(spark)}/thicket-stream-{uuid.uuid4().hex}"
    _table(spark, d, "benchmark").select(F.col("item_id").alias("tree_id"), "text").write.parquet(f"{path}/in")
    stream = spark.readStream.schema("tree_id long, text string").parquet(f"{path}/in")
    write_leaves(stream, f"{path}/out", f"{path}/checkpoint", ClusterConfig(max_tokens=12)).awaitTermination()
    out = spark.read.parquet(f"{path}/out")
    return out.select(F.col("tree_id").alias("item_id"), F.col("node_index").alias("chunk_index"), F.md5("text").alias("chunk"), "n_tokens")


@_query(f"WITH {_chunks_sql('benchmark', 'item_id', 60, lambda x: f'length({x}) + 1')} SELECT item_id, CAST(chunk_index AS INTEGER) AS chunk_index, md5(chunk) AS chunk, CAST(length(chunk) AS INTEGER) AS n_tokens FROM chunks")
def custom_tokenizer(spark: SparkSession, d: str) -> DataFrame:
    """Chunks by a tokenizer of Python's: characters."""
    out = chunks(_table(spark, d, "benchmark").select(F.col("item_id").alias("tree_id"), "text"), 60, encode=list)
    return out.select(F.col("tree_id").alias("item_id"), "chunk_index", F.md5("text").alias("chunk"), "n_tokens")


class _Echo:
    """A stand-in for a service's client: replies with what it was sent."""

    def __init__(self) -> None:
        self.embeddings = self.completions = self.chat = self

    def create(self, **sent: object) -> object:
        if "input" in sent:
            return SimpleNamespace(data=[SimpleNamespace(embedding=[float(len(x)), float(x.count(" ")), float("\n" in x)]) for x in sent["input"]])
        said = "|".join(f"{k}={v}" for k, v in sorted(sent.items()) if k != "messages") + "".join(f"|{m['role']}: {m['content']}" for m in sent.get("messages", []))
        return SimpleNamespace(choices=[SimpleNamespace(text=said, message=SimpleNamespace(content=said))])


class _Local:
    """Stand-ins for local models: an encoder, and a sequence-to-sequence model that replies with its prompt."""

    def encode(self, said: object, return_tensors: str | None = None) -> object:
        import numpy as np

        if return_tensors:
            return SimpleNamespace(to=lambda device: said)
        return np.array([[len(x), x.count(" "), 0] for x in said]) if isinstance(said, list) else np.array([len(said), said.count(" "), 0])

    def generate(self, ids: str) -> str:
        return ids

    def batch_decode(self, ids: str, skip_special_tokens: bool = False) -> list[str]:
        return [ids]


def _hosted_sql() -> str:
    def said(template: str, **names: str) -> str:
        parts = re.split(r"\{(\w+)\}", template)
        return " || ".join(names[p] if i % 2 else "'" + p.replace("'", "''").replace("\\n", "' || chr(92) || 'n") + "'" for i, p in enumerate(parts))

    prompt_, chat, asked = (said(t, context="text", question="'what?'") for t in (ANSWER_PROMPT, CHAT_ANSWER_PROMPT, SUMMARY_PROMPT))
    rows = {
        "ChatSummary": f"'max_tokens=9|model=gpt-3.5-turbo|system: {SUMMARY_SYSTEM}|user: ' || {asked}",
        "CompletionSummary": f"'max_tokens=9|model=text-davinci-003|system: {SUMMARY_SYSTEM}|user: ' || {asked}",
        "CompletionAnswer": f"'max_tokens=150|model=text-davinci-003|prompt=' || {prompt_} || '|temperature=0'",
        "ChatAnswer": f"'model=gpt-3.5-turbo|temperature=0|system: {ANSWER_SYSTEM}|user: ' || {chat}",
        "LargeChatAnswer": f"'model=gpt-4|temperature=0|system: {ANSWER_SYSTEM}|user: ' || {chat}",
        "Seq2SeqAnswer": said(SEQ2SEQ_PROMPT, context="text", question="'what?'"),
    }
    size = "length(text) || ',' || (length(text) - length(replace(replace(text, chr(10), ' '), ' ', ''))) || ',0'"
    local = "length(text) || ',' || (length(text) - length(replace(text, ' ', ''))) || ',0'"
    union = [f"SELECT item_id, '{k}' AS model, md5({v}) AS said FROM benchmark" for k, v in rows.items()]
    return " UNION ALL ".join([*union, f"SELECT item_id, 'HostedEmbedding', {size} FROM benchmark", f"SELECT item_id, 'SentenceEmbedding', {local} FROM benchmark"])


@_query(_hosted_sql())
def model_adapters(spark: SparkSession, d: str) -> DataFrame:
    """What each adapter of a hosted or local model sends for every benchmark text, told by stand-ins that reply with it."""
    rows = _table(spark, d, "benchmark")
    text, what = F.col("text"), F.lit("what?")
    said = {type(m).__name__: F.md5(summarize(m, text, 9)) for m in (ChatSummary(client=_Echo), CompletionSummary(client=_Echo))}
    said |= {type(m).__name__: F.md5(answer(m, text, what)) for m in (CompletionAnswer(client=_Echo), ChatAnswer(client=_Echo), LargeChatAnswer(client=_Echo), Seq2SeqAnswer(load=lambda name: ("cpu", _Local(), _Local())))}
    said |= {type(m).__name__: F.array_join(F.transform(embed(m, text), lambda x: x.cast("int").cast("string")), ",") for m in (HostedEmbedding(client=_Echo), SentenceEmbedding(load=lambda name: _Local()))}
    parts = [rows.select("item_id", F.lit(name).alias("model"), c.alias("said")) for name, c in said.items()]
    return functools.reduce(DataFrame.unionByName, parts)


_SETTINGS = {"max_tokens": "100", "num_layers": "5", "threshold": "0.5", "top_k": "5", "selection_mode": "top_k", "summarization_length": "100", "cluster_embedding_model": "EMB", "reduction_dimension": "10", "max_length_in_cluster": "3500", "cluster_threshold": "0.1", "max_clusters": "50", "seed": "224"}
_REFUSED = {"max_tokens": 0, "num_layers": 0, "threshold": 2, "top_k": 0, "selection_mode": "x", "summarization_model": 1, "embedding_models": {}, "cluster_embedding_model": "x", "reduction_dimension": 0, "max_length_in_cluster": 0, "clustering_algorithm": 1}


@_query("SELECT * FROM (VALUES " + ", ".join([*(f"('{k}', '{v}')" for k, v in _SETTINGS.items()), *(f"('{k} of {v}', 'refused')" for k, v in _REFUSED.items())]) + ") AS t(setting, says)")
def settings(spark: SparkSession, d: str) -> DataFrame:
    """The defaults of the tree's settings, and settings that are refused."""
    cfg = ClusterConfig()
    rows = [(k, str(getattr(cfg, k))) for k in _SETTINGS]
    for k, v in _REFUSED.items():
        try:
            ClusterConfig(**{k: v})
            rows.append((f"{k} of {v}", "taken"))
        except ValueError:
            rows.append((f"{k} of {v}", "refused"))
    return spark.createDataFrame(rows, "setting string, says string")


__all__ = ["neighbours", "oracle_sql", "queries"]
