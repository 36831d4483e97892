"""Soft two-level clustering of nodes, split until clusters fit a token limit.

Every group (a tree, a cluster to be split, a global cluster within it) is a
unit of work, and is fitted on all its rows.  A group of at most part_rows rows is
split to the end in one task, one of BESIDE times as many if others have come of its
tree.  A larger one is reduced and labelled in salted
parts; what is fitted is its reduced rows, in one task, or, of more than FITTED
parts, by passes over these.  Equal vectors get
equal labels, as labels are a function of the vector.
"""

from __future__ import annotations

import pickle
from abc import ABC, abstractmethod
from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from thicket.config import ClusterConfig
from thicket.operators.mixture import Run, advance, axes_of, best_mixture, best_mixtures, best_number, bic_of, centres_of, moments, numbers, reduce_fit, scatter, soft_labels
from thicket.operators.number import numbered
from thicket.scratch import drop, stored

#: The reduced rows of a group of at most so many parts go to one task.
FITTED = 256
#: Rows of groups of a task's size that a task clusters at once, about.
HELD = 1 << 14
#: From the second turn on a group of so many parts is split to the end in one task, too.
BESIDE = 4


class ClusteringAlgorithm(ABC):
    """What a tree's layers are clustered with; users' own algorithms derive from it."""

    @abstractmethod
    def perform_clustering(self, nodes: DataFrame, cfg: ClusterConfig, **params: object) -> DataFrame:
        """(tree_id, cluster_id, node_index), a row for each cluster that a node is in, for nodes(tree_id, node_index, n_tokens, embedding)."""


class MixtureClustering(ClusteringAlgorithm):
    """Two levels of soft Gaussian mixtures; params are settings of ClusterConfig."""

    def perform_clustering(self, nodes: DataFrame, cfg: ClusterConfig, **params: object) -> DataFrame:
        return cluster_nodes(nodes, replace(cfg, **params))


def _vectors(part: pd.DataFrame) -> np.ndarray:
    return np.stack(part.sort_values("node_index").embedding.to_numpy()).astype(float)


def matrix(vectors: pa.ChunkedArray) -> np.ndarray:
    """The rows of a list column, which are of one length."""
    size = vectors.chunk(0).value_lengths()[0].as_py()
    if vectors.null_count or any((c.value_lengths().to_numpy(zero_copy_only=False) != size).any() for c in vectors.chunks):
        raise ValueError("a layer's vectors are not of one length")
    return np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in vectors.chunks]).astype(float).reshape(-1, size)


def _dims(n: int, cfg: ClusterConfig, shrink: bool) -> int:
    """To how many dimensions a group of n rows is reduced; 0: it is one cluster as it is."""
    if n < 2 or (not shrink and n <= cfg.reduction_dimension + 1):
        return 0
    return max(1, min(cfg.reduction_dimension, n - 2)) if shrink else cfg.reduction_dimension


def _dealt(rows: DataFrame, *by: str) -> DataFrame:
    """rows in a few parts for each core: by bytes, which is how Spark would merge them, they are few, but each is much work."""
    spark = rows.sparkSession
    return rows.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism), *by)


def _labels(xs: list[np.ndarray], cfg: ClusterConfig, shrink: bool) -> list[tuple[list[list[int]], int]]:
    """Of each group the labels of its rows, and their number.  Rows that are all equal are no likelier under more components than one."""
    dims = [0 if (x == x[:1]).all() else _dims(len(x), cfg, shrink) for x in xs]
    lows = [reduce_fit(x, dim)(x) for x, dim in zip(xs, dims, strict=True) if dim]
    fitted = iter(zip(lows, best_mixtures(lows, cfg.max_clusters, cfg.seed), strict=True))
    out: list[tuple[list[list[int]], int]] = []
    for x, dim in zip(xs, dims, strict=True):
        if dim:
            low, model = next(fitted)
            out.append((soft_labels(model.posterior(low), cfg.cluster_threshold), model.k))
        else:
            out.append(([[0]] * len(x), 1))
    return out


def _members(labels: list[list[int]]) -> list[tuple[int, np.ndarray]]:
    """(label, rows), in order."""
    by: dict[int, list[int]] = {}
    for i, js in enumerate(labels):
        for j in js:
            by.setdefault(j, []).append(i)
    return [(j, np.array(by[j])) for j in sorted(by)]


def _two_level(xs: list[np.ndarray], cfg: ClusterConfig) -> list[list[tuple[int, np.ndarray]]]:
    """(label, rows) of each of the groups, which are in one place, as two_level numbers them."""
    outer = _labels(xs, cfg, True)
    tops = [[rows for _, rows in _members(labels)] for labels, _ in outer]
    # what would be fitted within all rows of a group is what was fitted already
    same = [_dims(len(x), cfg, True) == _dims(len(x), cfg, False) or k == 1 for x, (_, k) in zip(xs, outer, strict=True)]
    known = [[o if s and len(rows) == len(x) else None for rows in top] for x, top, o, s in zip(xs, tops, outer, same, strict=True)]
    inner = iter(_labels([x[rows] for x, top, have in zip(xs, tops, known, strict=True) for rows, h in zip(top, have, strict=True) if h is None], cfg, False))
    out = []
    for top, have in zip(tops, known, strict=True):
        found, offset = [], 0
        for rows, h in zip(top, have, strict=True):
            local, k = h or next(inner)
            found += [(offset + j, rows[at]) for j, at in _members(local)]
            offset += k
        out.append(found)
    return out


def _ranges(number: np.ndarray, parts: int) -> list[tuple[int, np.ndarray]]:
    """(label, rows) of ranges of node_index, so many at most."""
    label = np.minimum(parts - 1, (number - number.min()) * parts // (number.max() - number.min() + 1))
    return [(int(j), np.flatnonzero(label == j)) for j in np.unique(label)]


@dataclass
class _Group:
    name: str
    number: np.ndarray
    tokens: np.ndarray
    x: np.ndarray
    stuck: bool

    def part(self, name: str, rows: np.ndarray) -> _Group:
        return _Group(name, self.number[rows], self.tokens[rows], self.x[rows], len(rows) == len(self.x))


def _split_up(work: list[_Group], cfg: ClusterConfig, turn: int) -> list[tuple[str, np.ndarray]]:
    """(name, node_index) of the clusters that groups end in: what the turns of cluster_nodes give, in one place."""
    most, out = cfg.max_length_in_cluster, []
    while work and turn < cfg.max_splits:
        flat = [bool(turn) and (g.stuck or len(g.x) <= cfg.reduction_dimension + 1) for g in work]
        apart = iter(_two_level([g.x for g, f in zip(work, flat, strict=True) if not f], cfg))
        children = []
        for g, f in zip(work, flat, strict=True):
            for label, rows in _ranges(g.number, max(2, -(-int(g.tokens.sum()) // most))) if f else next(apart):
                name = f"{g.name}/{label:06d}"
                if len(rows) > 1 and g.tokens[rows].sum() > most:
                    children.append(g.part(name, rows))
                else:
                    out.append((name, g.number[rows]))
        work, turn = children, turn + 1
    return out + [(f"{g.name}/{run}", g.number[rows]) for g in work for run, rows in _runs(g.number, g.tokens, most)]


def _runs(number: np.ndarray, tokens: np.ndarray, most: int) -> list[tuple[str, np.ndarray]]:
    """(run, rows), as _cut names them."""
    alone = tokens * 2 > most
    spent = np.where(alone, 0, tokens)
    names = [f"n{i:010d}" if a else f"r{(c - t) * 2 // most:010d}" for i, a, c, t in zip(number.tolist(), alone, np.cumsum(spent).tolist(), spent.tolist(), strict=True)]
    by: dict[str, list[int]] = {}
    for i, run in enumerate(names):
        by.setdefault(run, []).append(i)
    return [(run, np.array(by[run])) for run in by]


def _split_whole(work: DataFrame, rows: int, cfg: ClusterConfig, turn: int) -> DataFrame:
    """(group, node_index): the final clusters of work(group, node_index, n_tokens, embedding, stuck), whose groups are of a task's size and have so many rows in all."""
    spark = work.sparkSession
    parts = max((8 if turn else 2) * spark.sparkContext.defaultParallelism, min(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // HELD)))

    def groups(table: pa.Table) -> Iterator[_Group]:
        names = table.column("group").to_pylist()
        begin = [i for i, name in enumerate(names) if not i or name != names[i - 1]]
        number, tokens = (table.column(c).to_numpy() for c in ("node_index", "n_tokens"))
        x = matrix(table.column("embedding"))
        stuck = table.column("stuck").to_pylist()
        for lo, hi in zip(begin, [*begin[1:], len(names)], strict=True):
            yield _Group(names[lo], number[lo:hi], tokens[lo:hi].astype(np.int64), x[lo:hi], stuck[lo])

    def split(table: pa.Table) -> pa.RecordBatch:
        got = _split_up(list(groups(table)), cfg, turn)
        name = pa.array([name for name, _ in got], pa.string()).take(pa.array(np.repeat(np.arange(len(got)), [len(i) for _, i in got])))
        return pa.RecordBatch.from_arrays([name, pa.array(np.concatenate([i for _, i in got]).astype(np.int32))], names=["group", "node_index"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Small groups are fitted faster the more of them are at hand, so rows of many batches are held back, and those of the last group in any case."""
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) < HELD:
                continue
            table = pa.Table.from_batches(held)
            names = table.column("group").to_pylist()
            if at := names.index(names[-1]):
                yield split(table.slice(0, at))
            held = table.slice(at).to_batches()
        if any(b.num_rows for b in held):
            yield split(pa.Table.from_batches(held))

    sorted_rows = work.select("group", F.col("node_index").cast("int").alias("node_index"), F.col("n_tokens").cast("long").alias("n_tokens"), "embedding", "stuck").repartition(parts, "group").sortWithinPartitions("group", "node_index")
    return sorted_rows.mapInArrow(run, "group string, node_index int")


def _label_whole(rows: DataFrame, cfg: ClusterConfig, shrink: bool) -> DataFrame:
    """(group, node_index, label, n_labels) of groups of a task's size."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("node_index")
        ((labels, k),) = _labels([np.stack(part.embedding.to_numpy()).astype(float)], cfg, shrink)
        each = np.repeat(np.arange(len(part)), [len(js) for js in labels])
        return pd.DataFrame({"group": part.group.to_numpy()[each], "node_index": part.node_index.to_numpy()[each], "label": np.array([j for js in labels for j in js], np.int32), "n_labels": np.full(len(each), k, np.int32)})

    return _dealt(rows.select("group", "node_index", "embedding"), "group").groupBy("group").applyInPandas(run, "group string, node_index int, label int, n_labels int")


def _fit_whole(rows: DataFrame, cfg: ClusterConfig, shrink: bool) -> DataFrame:
    """(group, model, n_labels) of groups in several parts, the reduced rows of which fit a task; a task for each group, the largest first."""
    sums, points = _points(rows, cfg, shrink)
    whole = points.groupBy("group").agg(F.max("n").alias("n"), F.collect_list(F.struct("x", "at")).alias("parts"))
    sizes = sorted(points.groupBy("group").agg(F.max("n")).collect(), key=lambda r: (-r[1], r[0]))
    order = rows.sparkSession.createDataFrame([(r[0], i) for i, r in enumerate(sizes)], "group string, at int")

    def rows_of(parts) -> np.ndarray:  # noqa: ANN001
        """In order of node_index, as a group in one place has them."""
        return np.vstack([pickle.loads(p["x"]) for p in parts])[np.argsort(np.concatenate([pickle.loads(p["at"]) for p in parts]), kind="stable")]

    def fit(frames):  # noqa: ANN001, ANN202
        for f in frames:
            for r in f.itertuples():
                model = best_mixture(rows_of(r.parts), cfg.max_clusters, cfg.seed)
                yield pd.DataFrame({"group": [r.group], "model": [pickle.dumps((axes_of(pickle.loads(r.total)[0], _dims(int(r.n), cfg, shrink)), model))], "n_labels": [model.k]})

    dealt = whole.join(F.broadcast(order), "group").join(sums, "group").repartitionById(max(1, len(sizes)), F.col("at"))
    return dealt.select("group", "n", "parts", "total").mapInPandas(fit, "group string, model binary, n_labels int")


def _totals(parts: DataFrame) -> DataFrame:
    """Sums of arrays pickled in parts(group, salt, total), first in about the square root of a group's number of parts."""

    def add(part: pd.DataFrame) -> pd.DataFrame:
        each = [pickle.loads(t) for t in part.total]
        total = [sum(xs) for xs in zip(*each, strict=True)]
        return pd.DataFrame({"group": [part.group.iloc[0]], "total": [pickle.dumps(total)]})

    return parts.groupBy("group", F.floor(F.sqrt("salt")).alias("s")).applyInPandas(add, "group string, total binary").groupBy("group").applyInPandas(add, "group string, total binary")


def _points(rows: DataFrame, cfg: ClusterConfig, shrink: bool) -> tuple[DataFrame, DataFrame]:
    """(group, total), the scatter of each group, and (group, salt, n, x, at), the reduced rows of each part, by node_index, and these."""

    def scattered(part: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"group": [part.group.iloc[0]], "salt": [int(part.salt.iloc[0])], "total": [pickle.dumps([scatter(_vectors(part))])]})

    sums = stored(_totals(rows.groupBy("group", "salt").applyInPandas(scattered, "group string, salt int, total binary")))
    salts = rows.select("group", "salt").distinct().join(sums, "group").select(F.col("group").alias("for_group"), F.col("salt").alias("for_salt"), "total")

    def reduced(part: pd.DataFrame, total: pd.DataFrame) -> pd.DataFrame:
        n = int(part.n.iloc[0])
        (t,) = pickle.loads(total.total.iloc[0])
        return pd.DataFrame({"group": [part.group.iloc[0]], "salt": [int(part.salt.iloc[0])], "n": [n], "x": [pickle.dumps(axes_of(t, _dims(n, cfg, shrink))(_vectors(part)))], "at": [pickle.dumps(np.sort(part.node_index.to_numpy()))]})

    return sums, stored(rows.groupBy("group", "salt").cogroup(salts.groupBy("for_group", "for_salt")).applyInPandas(reduced, "group string, salt int, n long, x binary, at binary"))


def _fit_parts(rows: DataFrame, cfg: ClusterConfig, shrink: bool) -> DataFrame:
    """(group, model, n_labels) of groups in several parts: the same sums, taken by passes over the parts."""
    sums, points = _points(rows, cfg, shrink)

    def settled(ks_of, seed: int) -> DataFrame:  # noqa: ANN001
        """(group, n, runs, live) after all rounds; runs begin from centres of part 0, which is dealt by a hash."""

        def begin(part: pd.DataFrame) -> pd.DataFrame:
            x, n = pickle.loads(part.x.iloc[0]), int(part.n.iloc[0])
            ks = list(ks_of(part, n))
            return pd.DataFrame({"group": [part.group.iloc[0]], "n": [n], "runs": [pickle.dumps([Run(k, c) for k, c in zip(ks, centres_of(x, ks, seed), strict=True)])], "live": [True]})

        schema = "group string, n long, runs binary, live boolean"

        def look(batches):  # noqa: ANN001, ANN202
            for part in batches:
                totals = [pickle.dumps(moments(pickle.loads(x), pickle.loads(r))) for x, r in zip(part.x, part.runs, strict=True)]
                yield pd.DataFrame({"group": part.group, "salt": part.salt, "total": totals})

        def step(state: pd.DataFrame, total: pd.DataFrame) -> pd.DataFrame:
            out = []
            for s in state.itertuples():
                runs, got = pickle.loads(s.runs), pickle.loads(total.total.iloc[0]) if len(total) else []
                d = (np.sqrt(8 * (got[0].shape[1] - 1) + 9) - 3) / 2 if got else 0
                advance([r for r in runs if not r.done], got, round(d))
                out.append((s.group, s.n, pickle.dumps(runs), not all(r.done for r in runs)))
            return pd.DataFrame(out, columns=["group", "n", "runs", "live"])

        first = points.where("salt = 0")
        state = stored((first.join(best, "group") if best is not None else first.withColumn("k", F.lit(0))).groupBy("group").applyInPandas(begin, schema))
        while state.where("live").limit(1).count():
            seen = _dealt(points.select("group", "salt", "x"), "group", "salt").join(state.where("live").select("group", "runs"), "group").mapInPandas(look, "group string, salt int, total binary")
            after = stored(state.groupBy("group").cogroup(_totals(seen).groupBy("group")).applyInPandas(step, schema))
            drop(state)
            state = after
        return state

    best = None
    swept = settled(lambda part, n: numbers(n, cfg.max_clusters), cfg.seed)

    def choose(frames):  # noqa: ANN001, ANN202
        for f in frames:
            ks = []
            for n, runs in zip(f.n, map(pickle.loads, f.runs), strict=True):
                ks.append(best_number([r.k for r in runs], [bic_of(r.likelihood, n, r.k, r.model.mean.shape[1]) for r in runs]))
            yield pd.DataFrame({"group": f.group, "k": np.array(ks, np.int32)})

    best = stored(swept.mapInPandas(choose, "group string, k int"))
    fitted = settled(lambda part, n: [int(part.k.iloc[0])], 0)

    def model(frames):  # noqa: ANN001, ANN202
        for f in frames:
            both = [(axes_of(pickle.loads(t)[0], _dims(int(n), cfg, shrink)), pickle.loads(r)[0].model) for n, r, t in zip(f.n, f.runs, f.total, strict=True)]
            yield pd.DataFrame({"group": f.group, "model": [pickle.dumps(b) for b in both], "n_labels": np.array([b[1].k for b in both], np.int32)})

    return fitted.join(sums, "group").mapInPandas(model, "group string, model binary, n_labels int")


def _salted(rows: DataFrame, cfg: ClusterConfig) -> DataFrame:
    """rows with their group's size and the part they are dealt to."""
    sized = rows.join(rows.groupBy("group").agg(F.count("*").alias("n")), "group")
    return sized.withColumn("salt", F.pmod(F.xxhash64("node_index", F.lit(cfg.seed)), F.ceil(F.col("n") / cfg.part_rows)).cast("int"))


def reduced(rows: DataFrame, cfg: ClusterConfig) -> DataFrame:
    """(group, node_index, reduced): rows(group, node_index, embedding) on their group's principal axes, which are fitted on all of its rows."""
    salted = stored(_salted(rows, cfg))
    sums, _ = _points(salted, cfg, True)

    def project(part: pd.DataFrame, total: pd.DataFrame) -> pd.DataFrame:
        (t,) = pickle.loads(total.total.iloc[0])
        x = axes_of(t, max(1, _dims(int(part.n.iloc[0]), cfg, True)))(np.stack(part.embedding.to_numpy()).astype(float))
        return pd.DataFrame({"group": part.group, "node_index": part.node_index, "reduced": list(x)})

    salts = salted.select("group", "salt").distinct().join(sums, "group").select(F.col("group").alias("for_group"), F.col("salt").alias("for_salt"), "total")
    return salted.groupBy("group", "salt").cogroup(salts.groupBy("for_group", "for_salt")).applyInPandas(project, "group string, node_index int, reduced array<double>")


def soft_cluster(rows: DataFrame, cfg: ClusterConfig, shrink: bool) -> DataFrame:
    """(group, node_index, label, n_labels) for rows(group string, node_index, embedding): a row for each label a node has.

    shrink: reduce to min(dim, n - 2) dimensions, as the global level does, and
    leave no group whole; else groups of at most dim + 1 rows are one cluster.
    """
    salted = stored(_salted(rows, cfg))

    columns = ["group", "node_index", "label", "n_labels", "sure"]

    def assign(part: pd.DataFrame, models: pd.DataFrame) -> pd.DataFrame:
        if not len(part):
            return pd.DataFrame({c: [] for c in columns})
        model, k = pickle.loads(models.model.iloc[0]), int(models.n_labels.iloc[0])
        labels, sure = [[0]] * len(part), True
        if model is not None:
            p = model[1].posterior(model[0](np.stack(part.embedding.to_numpy()).astype(float)))
            labels, sure = soft_labels(p, cfg.cluster_threshold), bool((p > cfg.cluster_threshold).any())
        out = [(str(g), i, int(j), k, sure) for g, i, js in zip(part.group, part.node_index, labels, strict=True) for j in js]
        return pd.DataFrame(out, columns=columns)

    # the models are pickled by this job's own tasks and read by them alone
    small, fitted = F.col("n") <= cfg.part_rows, F.col("n") <= FITTED * cfg.part_rows
    whole = _label_whole(salted.where(small), cfg, shrink)
    models = [fit(salted.where(these), cfg, shrink) for fit, these in ((_fit_whole, ~small & fitted), (_fit_parts, ~fitted)) if salted.where(these).limit(1).count()]
    if not models:
        return whole
    salted = salted.where(~small)
    models = stored(reduce(DataFrame.unionByName, models))
    salts = salted.select("group", "salt").distinct().join(models, "group").select(F.col("group").alias("for_group"), F.col("salt").alias("for_salt"), "model", "n_labels")
    said = stored(salted.groupBy("group", "salt").cogroup(salts.groupBy("for_group", "for_salt")).applyInPandas(assign, "group string, node_index int, label int, n_labels int, sure boolean"))
    # a part whose rows have their likeliest label for want of any counts only if the whole group is so
    return whole.unionByName(said.join(said.groupBy("group").agg(F.max("sure").alias("any")), "group").where("sure = any").select(*columns[:-1]))


def two_level(rows: DataFrame, cfg: ClusterConfig) -> DataFrame:
    """(group, node_index, label): global labels, then labels within each, numbered on over global labels in order."""
    top = stored(soft_cluster(rows, cfg, shrink=True))
    name = F.concat_ws("/", "group", F.lpad(F.col("label").cast("string"), 4, "0"))
    # what would be fitted within a single label is what was fitted already
    one = top.where("n_labels = 1").select(name.alias("group"), "node_index", "label", "n_labels")
    inner = rows.join(top.where("n_labels > 1").select("group", "node_index", "label"), ["group", "node_index"]).select(name.alias("group"), "node_index", "embedding")
    local = stored(soft_cluster(inner, cfg, shrink=False).unionByName(one))
    each = local.groupBy("group").agg(F.max("n_labels").alias("k")).select(F.regexp_extract("group", "^(.*)/([0-9]+)$", 1).alias("outer"), F.col("group").alias("inner"), "k")
    later = each.groupBy("outer").agg(F.array_sort(F.collect_list(F.struct("inner", "k"))).alias("xs"))  # at most max_clusters - 1 of them
    offset = later.select(F.posexplode("xs").alias("i", "x"), "xs", "outer").select("outer", F.col("x.inner").alias("group"), F.aggregate(F.slice("xs", F.lit(1), F.col("i")), F.lit(0), lambda a, x: a + x["k"]).alias("offset"))
    return local.join(offset, "group").select(F.col("outer").alias("group"), "node_index", (F.col("label") + F.col("offset")).alias("label")).distinct()


def _cut(work: DataFrame, most: int) -> DataFrame:
    """(group, node_index): groups cut into runs of node_index within the limit.  A node of over half the limit is alone; of all others a run begins with each half of the limit."""
    alone = F.col("n_tokens") * 2 > most
    before = F.sum(F.when(alone, 0).otherwise(F.col("n_tokens"))).over(Window.partitionBy("group").orderBy("node_index").rowsBetween(Window.unboundedPreceding, -1))
    run = F.when(alone, F.format_string("n%010d", "node_index")).otherwise(F.format_string("r%010d", F.floor(F.coalesce(before, F.lit(0)) * 2 / most).cast("int")))
    return work.select(F.concat_ws("/", "group", run).alias("group"), "node_index")


def cluster_nodes(nodes: DataFrame, cfg: ClusterConfig) -> DataFrame:
    """(tree_id, cluster_id, node_index) for nodes(tree_id, node_index, n_tokens, embedding).

    A cluster of several nodes whose tokens exceed max_length_in_cluster is
    clustered again; one that does not come apart, or has at most dim + 1 nodes,
    is cut into ranges of node_index instead.  What is over the limit still after
    max_splits turns is cut by its running number of tokens, so that splitting
    ends and no cluster of several nodes is over the limit.
    cluster_id numbers a tree's clusters in order of their labels.
    """
    work = stored(nodes.select(F.format_string("%020d", "tree_id").alias("group"), "node_index", "n_tokens", "embedding", F.lit(False).alias("stuck")))
    done: list[DataFrame] = []
    for turn in range(cfg.max_splits):
        size = work.groupBy("group").agg(F.count("*").alias("n"), F.sum("n_tokens").alias("t"), F.min("node_index").alias("lo"), F.max("node_index").alias("hi"), F.max("stuck").alias("stuck"))
        # a group that others stand beside need not be spread over tasks as early
        whole = F.col("n") <= cfg.part_rows * (BESIDE if turn else 1)
        rows, large = size.agg(F.sum(F.when(whole, F.col("n"))), F.count_if(~whole)).first()
        if not large:
            done.append(_split_whole(work, rows or 0, cfg, turn))
            break
        size = stored(size.withColumn("whole", whole))
        if rows:
            done.append(_split_whole(work.join(size.where("whole").select("group"), "group", "left_semi"), rows, cfg, turn))
        work = work.join(size.where("not whole").select("group"), "group", "left_semi")
        size = size.where("not whole")
        if turn == 0:
            new = two_level(work.drop("stuck"), cfg)
        else:
            flat = F.col("stuck") | (F.col("n") <= cfg.reduction_dimension + 1)
            parts = F.greatest(F.lit(2), F.ceil(F.col("t") / cfg.max_length_in_cluster))
            cut = work.join(size.where(flat).drop("stuck"), "group").select("group", "node_index", F.least(parts - 1, F.floor((F.col("node_index") - F.col("lo")) * parts / (F.col("hi") - F.col("lo") + 1))).cast("int").alias("label"))
            again = work.join(size.where(~flat).select("group"), "group", "left_semi").select("group", "node_index", "n_tokens", "embedding")
            new = two_level(again, cfg).unionByName(cut)
        named = stored(new.select(F.col("group").alias("before"), F.concat_ws("/", "group", F.lpad(F.col("label").cast("string"), 6, "0")).alias("group"), "node_index").join(work.select(F.col("group").alias("before"), "node_index", "n_tokens", "embedding"), ["before", "node_index"]))
        size = named.groupBy("before", "group").agg(F.count("*").alias("n"), F.sum("n_tokens").alias("t"))
        was = work.groupBy("group").agg(F.count("*").alias("was")).withColumnRenamed("group", "before")
        state = stored(size.join(was, "before").select("group", ((F.col("n") > 1) & (F.col("t") > cfg.max_length_in_cluster)).alias("split"), (F.col("n") == F.col("was")).alias("stuck")))
        done.append(named.join(state.where("not split").select("group"), "group", "left_semi").select("group", "node_index"))
        if not state.where("split").limit(1).count():
            break
        work = stored(named.join(state.where("split").select("group", "stuck"), "group").select("group", "node_index", "n_tokens", "embedding", "stuck"))
    else:
        done.append(_cut(work, cfg.max_length_in_cluster))
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    out = stored(out)
    tree = F.split_part(F.col("group"), F.lit("/"), F.lit(1)).cast("long")
    ids = numbered(out.select("group").distinct().withColumn("tree_id", tree), "tree_id", ["group"], "number")
    return out.join(ids, "group").select("tree_id", (F.col("number") - 1).alias("cluster_id"), "node_index")


def value_backmap(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """(node_index, label): every row gets the labels of any row of equal embedding; rows(node_index, embedding), labels(node_index, label)."""
    key = F.xxhash64("embedding")
    have = rows.join(labels, "node_index").select(key.alias("h"), F.col("embedding").alias("e"), "label").distinct()
    return rows.withColumn("h", key).join(have, "h").where(F.col("embedding") == F.col("e")).select("node_index", "label").distinct()


def orphans(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes without a parent, below the top layer."""
    top = nodes.groupBy("tree_id").agg(F.max("layer").alias("top"))
    return nodes.join(edges, (nodes["tree_id"] == edges["tree_id"]) & (nodes["node_index"] == edges["child_index"]), "left_anti").join(top, "tree_id").where("layer < top").drop("top")
