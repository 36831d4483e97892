"""Exact nearest-neighbour search of a set of queries against all rows."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from thicket.functions.vectors import METRICS, cosine_distance, distance, dot, square
from thicket.operators.number import numbered
from thicket.scratch import stored
from thicket.sources.tables import spread

#: Queries are broadcast in blocks of so many, so that what is broadcast has a bound.
BLOCK = 4096
#: Scores are ranked with so many decimals: sums of the same products in another order then tie, and ties go by node_index.
DIGITS = 12
#: Threshold selection ranks a query's rows in one task if these are at most so many.
RANKED = 1 << 20


def key_of(rows: DataFrame) -> tuple[str, ...]:
    """What names a node: its tree and its number there, or the number alone in tables without tree_id."""
    return ("tree_id", "node_index") if "tree_id" in rows.columns else ("node_index",)


def _against(queries: DataFrame, rows: DataFrame, score: Column) -> DataFrame:
    """Every query with every row, and its score: the stated queries go to the rows in blocks of a bounded size, rows stay where they are."""
    n = queries.count()
    if n <= BLOCK:
        return rows.join(F.broadcast(queries), how="cross").withColumn("score", score)
    blocks = -(-n // BLOCK)
    numbered = stored(queries.withColumn("_block", F.pmod(F.xxhash64("query_id"), F.lit(blocks))))
    parts = [rows.join(F.broadcast(numbered.where(F.col("_block") == b).drop("_block")), how="cross").withColumn("score", score) for b in range(blocks)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def scored(queries: DataFrame, rows: DataFrame, metric: str = "cosine") -> DataFrame:
    """(query_id, the node's key, score) for queries(query_id, query) and rows(key, embedding): a distance, or the inner product, negated, so that less is nearer."""
    key = key_of(rows)
    q, e = F.col("query"), F.col("embedding")
    if metric == "cosine":
        queries, rows = queries.withColumn("_nq", square(q)), rows.withColumn("_ne", square(e))
        score = cosine_distance(q, e, F.col("_nq"), F.col("_ne"))
    else:
        score = -dot(q, e) if metric == "inner_product" else distance(q, e, metric)
    return _against(queries, rows, F.round(score, DIGITS)).select("query_id", *key, "score")


def ranked(pairs: DataFrame, k: int | None = None) -> DataFrame:
    """pairs with rk, 1 for the nearest of a query, ties by key; only the first k, which Spark cuts before the shuffle."""
    out = pairs.withColumn("rk", F.row_number().over(Window.partitionBy("query_id").orderBy("score", *key_of(pairs))))
    return out if k is None else out.where(F.col("rk") <= k)


def _matrix(lists: pa.Array) -> np.ndarray:
    """Rows of a list column, of one length, without nulls."""
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(lists), -1)


def block_scores(q: np.ndarray, x: np.ndarray, metric: str) -> np.ndarray:
    """Scores of all rows of x for each of q, less being nearer."""
    if metric == "inner_product":
        return -(q @ x.T)
    if metric == "cosine":
        size = np.sqrt((q * q).sum(1)[:, None] * (x * x).sum(1)[None])
        return np.where(size > 0, 1.0 - (q @ x.T) / np.where(size > 0, size, 1), np.nan)
    apart = np.abs(q[:, None, :] - x[None, :, :])
    return apart.sum(2) if metric == "L1" else apart.max(2) if metric == "Linf" else np.sqrt((apart * apart).sum(2))


def _best(s: np.ndarray, keys: list[np.ndarray], k: int) -> tuple[np.ndarray, np.ndarray]:
    """(query, row) numbers of the k least scores of each query, ties by the rows' keys."""
    if s.shape[1] <= k:
        return np.divmod(np.arange(s.size), s.shape[1])
    edge = np.partition(np.nan_to_num(s, nan=np.inf), k - 1, axis=1)[:, k - 1]
    i, j = np.nonzero(~(s > edge[:, None]))
    order = np.lexsort((*(x[j] for x in reversed(keys)), s[i, j], i))
    i, j = i[order], j[order]
    near = np.arange(len(i)) - np.searchsorted(i, np.arange(len(s)))[i] < k
    return i[near], j[near]


def _blocks(queries: DataFrame) -> Iterator[pa.Table]:
    """queries(query_id, query) in blocks of a bounded size."""
    first = queries.limit(BLOCK + 1).toArrow()  # most often these are all
    blocks = 1
    if first.num_rows > BLOCK:  # embedded once, then read block by block
        queries = stored(queries)
        blocks = -(-queries.count() // BLOCK)
    for b in range(blocks):
        took = first if blocks == 1 else queries.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b).toArrow()
        if took.num_rows:
            yield took.combine_chunks()


def top_k(queries: DataFrame, rows: DataFrame, k: int, metric: str = "cosine", carry: tuple[str, ...] = ()) -> DataFrame:
    """(query_id, the node's key, score, rk): the k nearest rows of each query, ties by key; with the rows' columns ``carry``.

    A row's key is (tree_id, node_index), or node_index where rows have no
    tree_id.  Queries, in blocks of a bounded size, go to the rows.  Every Arrow
    batch of rows is scored as one matrix product and gives its own k best; only
    these are shuffled, by query.  Rows and queries without a vector are left out.
    """
    if metric not in (*METRICS, "inner_product"):
        raise ValueError(f"unknown metric {metric!r}; supported are {', '.join(METRICS)} and inner_product")
    key = key_of(rows)
    queries = queries.where("query is not null").select("query_id", "query")
    own = rows.select(*key, "embedding", *carry)
    kinds = ", ".join([f"query_id {queries.schema['query_id'].dataType.simpleString()}", *(f"{c} {own.schema[c].dataType.simpleString()}" for c in key), "score double", *(f"{c} {own.schema[c].dataType.simpleString()}" for c in carry)])
    parts = []
    for took in _blocks(queries):
        shared = rows.sparkSession.sparkContext.broadcast((took.column("query_id").combine_chunks(), _matrix(took.column("query").combine_chunks())))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
            ids, q = shared.value
            wide = metric in ("L1", "L2", "Linf")
            step = max(1, (1 << 22) // max(1, len(q) * (q.shape[1] if wide else 1)))
            for batch in batches:
                batch = batch.filter(batch.column(len(key)).is_valid())
                for lo in range(0, batch.num_rows, step):
                    part = batch.slice(lo, step)
                    keys = [part.column(c).fill_null(-1).to_numpy(zero_copy_only=False) for c in range(len(key))]
                    s = np.round(block_scores(q, _matrix(part.column(len(key))), metric), DIGITS)
                    i, j = _best(s, keys, k)
                    at = pa.array(j)
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(i)), *(part.column(c).take(at) for c in range(len(key))), pa.array(s[i, j]), *(part.column(len(key) + 1 + c).take(at) for c in range(len(carry)))], ["query_id", *key, "score", *carry])

        parts.append(own.mapInArrow(run, kinds))
    if not parts:
        return ranked(rows.sparkSession.createDataFrame([], kinds), k)
    return ranked(reduce(DataFrame.unionByName, parts), k)


def _by_length(lists: pa.Array) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Places and vectors of each length in a list column without nulls."""
    size = lists.value_lengths().to_numpy(zero_copy_only=False)
    return {int(d): (at := np.flatnonzero(size == d), _matrix(lists.take(pa.array(at)))) for d in np.unique(size) if d}


def _cosines(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Cosine distances of all rows of q and of x, summed in the order of components, so that equal vectors have equal scores wherever they stand."""
    columns = np.ascontiguousarray(x.T)
    out, one = np.zeros((len(q), len(x))), np.empty((len(q), len(x)))
    for c in range(q.shape[1]):
        np.multiply(q[:, c, None], columns[c], out=one)
        out += one
    square = lambda v: np.add.reduce([np.zeros(len(v)), *(v[:, c] * v[:, c] for c in range(v.shape[1]))])
    with np.errstate(divide="ignore", invalid="ignore"):
        out /= np.sqrt(square(q)[:, None] * square(x))
    np.subtract(1.0, out, out=out)
    out *= 10.0**DIGITS
    out += np.copysign(0.5, out)
    np.trunc(out, out=out)
    out /= 10.0**DIGITS
    return out


def _far(queries: DataFrame, rows: DataFrame, threshold: float) -> DataFrame:
    """(query_id, the key, score) as arrays: a row for each query and some rows, of those that are farther than the threshold by cosine distance.  Vectors without a length, and of unlike lengths, have NaN for a distance, which is farther than any."""
    key = key_of(rows)
    own = spread(rows.select(*key, "embedding").where("embedding is not null"))
    of = lambda df, c: df.schema[c].dataType.simpleString()
    kinds = ", ".join([f"query_id {of(queries, 'query_id')}", *(f"{c} array<{of(own, c)}>" for c in key), "score array<double>"])
    parts = []
    for took in _blocks(queries.where("query is not null").select("query_id", "query")):
        shared = rows.sparkSession.sparkContext.broadcast((took.column("query_id").combine_chunks(), took.column("query").combine_chunks()))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
            ids, vectors = shared.value
            asked = _by_length(vectors)
            for batch in batches:
                n = batch.num_rows
                have = _by_length(batch.column(len(key))) if n else {}
                step = max(1, (1 << 17) // max(1, n))
                for lo in range(0, len(ids) if n else 0, step):
                    s = np.full((min(step, len(ids) - lo), n), np.nan)
                    for d, (at, q) in asked.items():
                        first, last = np.searchsorted(at, (lo, lo + step))
                        if d in have and first < last:
                            s[np.ix_(at[first:last] - lo, have[d][0])] = _cosines(q[first:last], have[d][1])
                    i, j = np.nonzero(~(s <= threshold))
                    offsets = pa.array(np.searchsorted(i, np.arange(len(s) + 1)).astype(np.int32))
                    values = [*(batch.column(c).take(pa.array(j)) for c in range(len(key))), pa.array(s[i, j])]
                    yield pa.RecordBatch.from_arrays([ids.slice(lo, len(s)), *(pa.ListArray.from_arrays(offsets, v) for v in values)], ["query_id", *key, "score"])

        parts.append(own.mapInArrow(run, kinds))
    return reduce(DataFrame.unionByName, parts) if parts else rows.sparkSession.createDataFrame([], kinds)


def beyond(queries: DataFrame, rows: DataFrame, threshold: float, metric: str = "cosine") -> DataFrame:
    """(query_id, the node's key, score, rk): the rows *farther* than a threshold, nearest first, as threshold selection is defined.

    Cosine distances are taken in blocks; rows and queries without a vector are
    left out.  A query's rows are ranked in a task of its own, or, where there
    are more than RANKED, in many tasks, as these can be most of all rows.
    """
    key = key_of(rows)
    if metric != "cosine":
        return numbered(scored(queries, rows, metric).where(F.col("score") > threshold), "query_id", ["score", *key], "rk")
    far = _far(queries, rows, threshold)
    if rows.count() > RANKED:
        pairs = far.select("query_id", F.explode(F.arrays_zip(*key, "score")).alias("p")).select("query_id", *(F.col(f"p.{c}").alias(c) for c in (*key, "score")))
        return numbered(stored(pairs), "query_id", ["score", *key], "rk")

    def rank(part: pa.Table) -> pa.Table:
        lists = part.combine_chunks()
        flat = [lists.column(c).combine_chunks().flatten() for c in (*key, "score")]
        order = pa.array(np.lexsort([*(x.fill_null(-1).to_numpy(zero_copy_only=False) for x in reversed(flat[:-1])), flat[-1].to_numpy(zero_copy_only=False)]))
        again = pa.DictionaryArray.from_arrays(pa.array(np.zeros(len(order), np.int32)), lists.column("query_id").combine_chunks().slice(0, 1)).dictionary_decode()
        return pa.table([again, *(x.take(order) for x in flat), pa.array(np.arange(1, len(order) + 1, dtype=np.int32))], ["query_id", *key, "score", "rk"])

    kinds = ", ".join(f"{c} {far.schema[c].dataType.simpleString()}" for c in ("query_id", *key, "score")).replace("array<", "").replace(">", "")
    return far.groupBy("query_id").applyInArrow(rank, f"{kinds}, rk int")


def tree_neighbours(nodes: DataFrame, k: int, block: int = 2048) -> DataFrame:
    """(tree_id, node_index, neighbour, score, rk): of nodes(tree_id, node_index, embedding) the k nearest of the same tree by cosine distance, itself included, ties by number.

    A tree is dealt into blocks, each met with each; every meeting gives only
    the k best of its rows, so a large tree is compared in many tasks.
    """
    own = nodes.select("tree_id", "node_index", "embedding")
    sized = own.join(own.groupBy("tree_id").agg(F.ceil(F.count("*") / block).cast("int").alias("b")), "tree_id").withColumn("i", F.pmod(F.xxhash64("node_index"), F.col("b")).cast("int"))
    met = F.explode(F.sequence(F.lit(0), F.col("b") - 1))
    left = sized.withColumn("j", met).select("tree_id", "i", "j", "node_index", "embedding")
    right = sized.withColumn("j", met).select(F.col("tree_id").alias("of_tree"), F.col("j").alias("of_i"), F.col("i").alias("of_j"), F.col("node_index").alias("neighbour"), F.col("embedding").alias("vector"))

    def near(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"tree_id": [], "node_index": [], "neighbour": [], "score": []})
        q, x = (np.stack(v.to_numpy()).astype(np.float64) for v in (a.embedding, b.vector))
        others = b.neighbour.to_numpy()
        s = np.round(block_scores(q, x, "cosine"), DIGITS)
        i, j = _best(s, [others], k)
        return pd.DataFrame({"tree_id": a.tree_id.to_numpy()[i], "node_index": a.node_index.to_numpy()[i], "neighbour": others[j], "score": s[i, j]})

    pairs = left.groupBy("tree_id", "i", "j").cogroup(right.groupBy("of_tree", "of_i", "of_j")).applyInPandas(near, "tree_id long, node_index int, neighbour int, score double")
    rank = F.row_number().over(Window.partitionBy("tree_id", "node_index").orderBy("score", "neighbour"))
    return pairs.withColumn("rk", rank).where(F.col("rk") <= k)


def within_budget(selected: DataFrame, max_tokens: int | None, include_overflow: bool = False) -> DataFrame:
    """The first rows of each query, by rk, that a token budget admits.

    The collapsed rule stops before the row that would overflow; the flat rule
    (include_overflow) takes that row and stops.  None admits all.
    """
    if max_tokens is None:
        return selected
    before = Window.partitionBy("query_id").orderBy("rk").rowsBetween(Window.unboundedPreceding, -1)
    spent = F.coalesce(F.sum("n_tokens").over(before), F.lit(0))
    fits = spent <= max_tokens if include_overflow else spent + F.col("n_tokens") <= max_tokens
    return selected.withColumn("_fits", fits).where("_fits").drop("_fits")
