"""Quality classifier by co-training.

Two logistic classifiers see a document apart: one its words, one its metadata
(language, source, length).  Over some rounds each scores all unlabelled documents
and labels those it is surest of for the other to learn from; then both are
calibrated on labelled rows that neither has seen, combined, and score every document.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from thicket.operators.number import numbered
from thicket.scratch import drop, small_batches, stored
from thicket.llm.wordgrid import Texts, buffers, chunks, code_points, column, give_back, keyed, mix, ngrams

_U = np.uint64
#: Sizes of the two views' weight tables; the last place is the constant.
WORDS, META = 1 << 16, 1 << 12


@dataclass(frozen=True)
class CoTraining:
    """The classifiers are fitted on the ``labelled`` labelled documents least in
    a keyed hash of their id (or all, if fewer), and on what they give each other.
    A ``calibrate``-th of the labelled sample is set apart for calibration.  In
    each of ``rounds`` rounds a view hands on ``give`` of all unlabelled documents,
    in the shares of the labelled classes, in turn the surest of each source, if
    it is at least ``sure`` of them.  The cut is
    the highest, up to 0.5, that loses a share of ``lose`` of the good
    calibration rows."""

    labelled: int = 8000
    calibrate: int = 4
    rounds: int = 3
    give: int = 800
    sure: float = 0.9
    lose: float = 0.005
    steps: int = 40
    seed: int = 17


@dataclass
class Sparse:
    """Rows of (place, value) features."""

    place: np.ndarray
    value: np.ndarray
    bounds: np.ndarray
    width: int

    def take(self, rows: np.ndarray) -> Sparse:
        size = np.diff(self.bounds)[rows]
        ends = np.cumsum(size)
        at = np.repeat(self.bounds[:-1][rows] - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)
        return Sparse(self.place[at], self.value[at], np.concatenate(([0], ends)), self.width)

    def blocks(self, rows: int = 512) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
        """(first row, end row, places, values, row of each) of blocks, so that what is worked out for each feature stays small."""
        size = np.diff(self.bounds)
        for lo in range(0, len(size), rows):
            hi = min(len(size), lo + rows)
            a, b = self.bounds[lo], self.bounds[hi]
            yield lo, hi, self.place[a:b], self.value[a:b], np.repeat(np.arange(hi - lo), size[lo:hi])

    def dot(self, w: np.ndarray) -> np.ndarray:
        out = np.full(len(self.bounds) - 1, float(w[-1]))
        for lo, hi, place, value, row in self.blocks():
            out[lo:hi] += np.bincount(row, w[place] * value, hi - lo)
        return out


def word_view(t: Texts) -> Sparse:
    """Words and word pairs of each text, A-Z lower-cased, each weighed 1 + ln count, rows scaled to length 1."""
    h, doc = t.word_hashes(), t.doc
    pairs, at = ngrams(h, doc, 2)
    key = np.concatenate((h, pairs)) % _U(WORDS - 1)
    owner = np.concatenate((doc, doc[at]))
    cell, n = np.unique(owner * WORDS + key.astype(np.int64), return_counts=True)
    owner, place = cell // WORDS, cell % WORDS
    value = 1 + np.log(n)
    norm = np.sqrt(np.bincount(owner, value * value, len(t)))
    return Sparse(place.astype(np.int32), (value / np.maximum(norm[owner], 1e-12)).astype(np.float32), np.searchsorted(owner, np.arange(len(t) + 1)), WORDS)


def _values(col: pa.Array, key: int) -> np.ndarray:
    """A hash of each value of a string column, worked out once for each distinct one; null is a value of its own."""
    coded = col.dictionary_encode()
    kinds = buffers(coded.dictionary)
    t = Texts(*kinds)
    hashes = keyed(t.hash_ranges(kinds[1][:-1], kinds[1][1:]) + np.diff(kinds[1]).astype(_U), key)
    at = coded.indices.fill_null(len(hashes)).to_numpy(zero_copy_only=False)
    return np.append(hashes, keyed(np.zeros(1, _U), key + 100))[at]


def meta_view(lang: pa.Array, source: pa.Array, size: np.ndarray) -> Sparse:
    """Language, source, half binary orders of length (-1: none), and pairs of language and length."""
    order = np.where(size < 0, -1, (2 * np.log2(np.maximum(size, 0) + 1)).astype(np.int64))
    length = keyed(order.astype(_U), 63)
    said = _values(lang, 61)
    place = np.stack((said, _values(source, 62), length, keyed(said + mix(length), 64)), 1) % _U(META - 1)
    return Sparse(place.ravel().astype(np.int32), np.full(place.size, 0.5, np.float32), np.arange(len(size) + 1) * 4, META)


def fit(x: Sparse, y: np.ndarray, weight: np.ndarray, start: np.ndarray | None, steps: int, decay: float = 1e-5) -> np.ndarray:
    """Logistic weights by adaptive gradient steps over all rows."""
    w = np.zeros(x.width) if start is None else start.copy()
    squares = np.full(x.width, 1e-4)
    total = weight.sum()
    for _ in range(steps):
        g = decay * w
        g[-1] = 0
        for lo, hi, place, value, row in x.blocks():
            z = w[-1] + np.bincount(row, w[place] * value, hi - lo)
            err = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[lo:hi]) * weight[lo:hi] / total
            g += np.bincount(place, err[row] * value, x.width)
            g[-1] += err.sum()
        squares += (g * 100) ** 2
        w -= 0.5 * (g * 100) / np.sqrt(squares)
    return w


def _calibrated(z: np.ndarray, y: np.ndarray, steps: int = 200) -> tuple[np.ndarray, float]:
    """Slopes and intercept of a logistic of columns z."""
    if not len(y) or y.min() == y.max():
        return np.ones(z.shape[1]), 0.0
    scale = np.maximum(z.std(0), 1e-9)
    a, b, sq = np.ones(z.shape[1]), 0.0, np.full(z.shape[1] + 1, 1e-6)
    x = z / scale
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ a + b, -30, 30)))
        g = np.append(x.T @ (p - y), (p - y).sum()) / len(y)
        sq += g * g
        step = 0.3 * g / np.sqrt(sq)
        a, b = np.maximum(a - step[:-1], 0), b - step[-1]
    return a / scale, b


@dataclass
class Model:
    words: np.ndarray
    meta: np.ndarray
    each: list[tuple[float, float]]  # calibration of each view
    both: tuple[np.ndarray, float]
    cut: float

    def probability(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each view, calibrated, and of both."""
        z = np.stack([k * v + c for (k, c), v in zip(self.each, (a, b), strict=True)], 1)
        p = lambda x: 1 / (1 + np.exp(-np.clip(x, -30, 30)))
        return p(z[:, 0]), p(z[:, 1]), p(z @ self.both[0] + self.both[1])


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


@dataclass
class Sample:
    """Documents with both views, by id."""

    ids: np.ndarray
    views: list[Sparse]

    def take(self, rows: np.ndarray) -> Sample:
        return Sample(self.ids[rows], [v.take(rows) for v in self.views])


def calibrated(weights: list[np.ndarray], sample: Sample, y: np.ndarray, how: CoTraining) -> Model:
    """Both views calibrated on rows that neither has seen, combined, and cut."""
    z = np.stack([sample.views[v].dot(weights[v]) for v in (0, 1)], 1)
    each = []
    for v in (0, 1):
        a, b = _calibrated(z[:, v : v + 1], y)
        each.append((float(a[0]), float(b)))
    both = _calibrated(np.stack([k * z[:, v] + c for v, (k, c) in enumerate(each)], 1), y)
    model = Model(weights[0].astype(np.float32), weights[1].astype(np.float32), each, both, 0.5)
    if len(y) and y.min() < y.max():
        p = model.probability(z[:, 0], z[:, 1])[2]
        good_p, bad_p = np.sort(p[y == 1]), np.sort(p[y == 0])
        lose = int(len(good_p) * how.lose)
        # between the last good row that may go and the bad row below it
        below = bad_p[bad_p < good_p[lose]]
        model.cut = float(min(0.5, (good_p[lose] + (below[-1] if len(below) else 0.0)) / 2))
    return model


def _join(parts: list[Sparse], width: int) -> Sparse:
    if len(parts) == 1:
        return parts[0]
    if not parts:
        return Sparse(np.zeros(0, np.int32), np.zeros(0, np.float32), np.zeros(1, np.int64), width)
    off = np.cumsum([0] + [p.bounds[-1] for p in parts])
    return Sparse(np.concatenate([p.place for p in parts]), np.concatenate([p.value for p in parts]), np.concatenate([[0]] + [p.bounds[1:] + o for p, o in zip(parts, off, strict=False)]).astype(np.int64), width)


def _read(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"))


def _views(batch: pa.RecordBatch) -> Iterator[tuple[int, int, Sparse, Sparse]]:
    """(first row, end row, both views) of the texts of a batch, chunk by chunk."""
    null = column(batch, "text").is_null().to_numpy(zero_copy_only=False)
    for lo, hi, t in chunks(column(batch, "text"), lower=True):
        size = np.where(null[lo:hi], -1, t.per_doc(code_points(t.data)))
        yield lo, hi, word_view(t), meta_view(column(batch, "lang").slice(lo, hi - lo), column(batch, "source").slice(lo, hi - lo), size)


def _gathered(docs: DataFrame, ids: DataFrame) -> Sample:
    """The documents of so many ids as the driver can hold, their number being a parameter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, *views in _views(batch):
                lists = [pa.ListArray.from_arrays(pa.array(v.bounds.astype(np.int32)), pa.array(x)) for v in views for x in (v.place, v.value.astype(np.float32))]
                yield pa.RecordBatch.from_arrays([column(batch, "doc_id").slice(lo, hi - lo), *lists], ["doc_id", "p0", "v0", "p1", "v1"])

    rows = _read(docs).join(F.broadcast(ids.select("doc_id")), "doc_id").mapInArrow(run, "doc_id long, p0 array<int>, v0 array<float>, p1 array<int>, v1 array<float>")
    # rows that repeat an id are told apart by their views, so that the order of equal ids is always the same
    got = rows.toArrow()
    keys = [list(zip(*(got.column(c).combine_chunks().value_lengths().to_pylist() for c in ("p0", "p1")), strict=True)), got.column("doc_id").to_pylist()]
    order = np.array(sorted(range(got.num_rows), key=lambda i: (keys[1][i], keys[0][i])), np.int64)
    views = []
    for v, width in ((0, WORDS), (1, META)):
        parts = zip(got.column(f"p{v}").chunks, got.column(f"v{v}").chunks, strict=True)
        views.append(_join([Sparse(p.flatten().to_numpy(zero_copy_only=False), x.flatten().to_numpy(zero_copy_only=False), np.concatenate(([0], np.cumsum(p.value_lengths().to_numpy(zero_copy_only=False)))), width) for p, x in parts], width))
    ids = got.column("doc_id").to_numpy()
    del got
    out = Sample(ids, views).take(order)
    del views
    give_back()
    return out


def scored(docs: DataFrame, weights: list[np.ndarray]) -> DataFrame:
    """(doc_id, source, z0, z1): each document's scores by both views."""
    shared = docs.sparkSession.sparkContext.broadcast([w.astype(np.float32) for w in weights])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = [x.astype(float) for x in shared.value]
        for batch in batches:
            for lo, hi, *views in _views(batch):
                yield pa.RecordBatch.from_arrays([column(batch, "doc_id").slice(lo, hi - lo), column(batch, "source").slice(lo, hi - lo), *(pa.array(v.dot(x)) for v, x in zip(views, w, strict=True))], ["doc_id", "source", "z0", "z1"])

    return _read(docs).mapInArrow(run, "doc_id long, source string, z0 double, z1 double")


def surest(rows: DataFrame, view: int, good: float, how: CoTraining) -> list[tuple[int, int]]:
    """(doc_id, label) of the documents that a view hands on, of rows(doc_id, source, z0, z1)."""
    bad_n = round(how.give * (1 - good))
    edge = float(np.log(how.sure / (1 - how.sure)))
    z, tie = F.round(f"z{view}", 9), F.xxhash64(F.lit(how.seed + 2), "doc_id")
    out = []
    for label, n, keep, order in ((0, bad_n, z <= -edge, z), (1, how.give - bad_n, z >= edge, -z)):
        able = rows.where(keep).select("doc_id", "source", order.alias("order"), tie.alias("tie"), F.pmod(F.xxhash64("doc_id"), F.lit(64)).alias("salt"))
        # a source that has most of all rows is cut in parts, each to its surest, and these are ranked over many tasks
        part = F.row_number().over(Window.partitionBy("source", "salt").orderBy("order", "tie", "doc_id"))
        able = able.withColumn("turn", part).where(F.col("turn") <= n).drop("turn", "salt")
        first = numbered(able, "source", ["order", "tie", "doc_id"], "turn").where(F.col("turn") <= n)
        out += [(r.doc_id, label) for r in first.orderBy("turn", "order", "tie", "doc_id").limit(n).select("doc_id").collect()]
    return out


def train(docs: DataFrame, labels: DataFrame, how: CoTraining) -> Model:
    """Co-trains both views.  A document is good if a label row says quality 1 and no row of it says quality 0 or toxic 1; a null quality is no label, a null toxic is 0."""
    spark = docs.sparkSession
    said = stored(labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min((F.col("quality") > 0) & (F.coalesce("toxic", F.lit(0)) == 0)).cast("int").alias("y")))
    there = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    labelled = stored(there.join(said, "doc_id").orderBy(F.xxhash64(F.lit(how.seed), "doc_id"), "doc_id").limit(how.labelled))
    sample = _gathered(docs, labelled)
    label_of = {r.doc_id: r.y for r in labelled.collect()}
    y = np.array([label_of[i] for i in sample.ids.tolist()], float)
    apart = keyed(sample.ids.astype(_U), how.seed + 1) % _U(how.calibrate) == 0
    own, cal = np.flatnonzero(~apart), np.flatnonzero(apart)
    known, kept_apart, y_apart = sample.take(own), sample.take(cal), y[cal]
    del sample
    give_back()
    learned: list[list[tuple[Sparse, np.ndarray]]] = [[(known.views[v], y[own])] for v in (0, 1)]
    weights: list[np.ndarray | None] = [None, None]
    given: list[set[int]] = [set(), set()]
    two_kinds = len(own) > 0 and y[own].min() < y[own].max()
    for turn in range(how.rounds + 1):
        for v in (0, 1):
            x, t = _join([p for p, _ in learned[v]], known.views[v].width), np.concatenate([t for _, t in learned[v]])
            weight = np.where(np.arange(len(t)) < len(own), 1.0, 0.5)
            weights[v] = fit(x, t, weight, weights[v], how.steps) if len(t) else np.zeros(known.views[v].width)
        if turn == how.rounds or not two_kinds:
            break
        every = scored(docs, weights).where("doc_id is not null").groupBy("doc_id").agg(F.min("source").alias("source"), F.max("z0").alias("z0"), F.max("z1").alias("z1"))
        rest = stored(every.join(said, "doc_id", "left_anti"))
        handed = []
        for v in (0, 1):
            before = spark.createDataFrame([(i,) for i in sorted(given[1 - v])], "doc_id long")
            handed.append(dict(surest(rest.join(F.broadcast(before), "doc_id", "left_anti"), v, float(y[own].mean()), how)))
        new = sorted(set(handed[0]) | set(handed[1]))
        if not new:
            break
        got = _gathered(docs, spark.createDataFrame([(i,) for i in new], "doc_id long"))
        for v in (0, 1):
            mine = np.array([k for k, i in enumerate(got.ids.tolist()) if i in handed[v]], np.int64)
            if len(mine):
                learned[1 - v].append((got.views[1 - v].take(mine), np.array([handed[v][i] for i in got.ids[mine].tolist()], float)))
            given[1 - v] |= set(handed[v])
        drop(rest)
    return calibrated(weights, kept_apart, y_apart, how)


def classify(docs: DataFrame, labels: DataFrame, how: CoTraining = CoTraining()) -> DataFrame:
    """(doc_id, p_text, p_meta, p_good, kept), a row for each row of docs(doc_id, text, lang, source).

    labels(doc_id, quality, toxic) may cover any part of docs.  Null and empty
    texts have no words and get the text view's constant; null metadata is a
    value of its own, a length is that of the text.  Repeated rows each get a
    row and are scored alike.  Ties between equally sure documents go by a keyed
    hash of the id.  Without labels every probability is 0.5, and kept.  An
    empty table gives an empty result.  Other columns are not read.
    """
    docs = small_batches(docs)
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels, how))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        words, meta = m.words.astype(float), m.meta.astype(float)
        for batch in batches:
            for lo, hi, x, y in _views(batch):
                a, b, p = m.probability(x.dot(words), y.dot(meta))
                yield pa.RecordBatch.from_arrays([column(batch, "doc_id").slice(lo, hi - lo), pa.array(a), pa.array(b), pa.array(p), pa.array(p >= m.cut)], ["doc_id", "p_text", "p_meta", "p_good", "kept"])

    return _read(docs).mapInArrow(run, "doc_id long, p_text double, p_meta double, p_good double, kept boolean")
