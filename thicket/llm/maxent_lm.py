"""LM scoring with a hashed maximum-entropy model.

P(word | history) = P(class | history) * P(word | class).  The class factor is a
softmax over a few dozen word classes, with hashed n-gram and skip features of
the words before; its weights are trained by distributed gradient updates: texts
are dealt into slices by a hash, each slice descends from the shared weights, and
the weights are averaged, round by round, so that what is learned hangs on the
texts alone and not on cores or files.  The word factor is the share of its count
in its class, taken by Spark over the whole training part.  Scoring runs in sparse
numpy batches.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thicket.scratch import drop, small_batches, stored
from thicket.llm.wordgrid import Held, Texts, chunks, column, keyed

ALPHA = 0.1
#: Weights are summed in so many parts.
SLICES = 64


def _power(x: float, least: int = 1) -> int:
    """The least power of two from x, and from ``least``, on."""
    return max(least, 1 << max(0, math.ceil(math.log2(max(x, 1)))))


@dataclass(frozen=True)
class MaxEnt:
    """own: the most frequent words, each a class of its own; groups: classes
    of all other words, by the words they follow.  table: rows of hashed weights,
    and known: frequent words whose counts every task holds in sorted hash arrays,
    both for each square root of distinct words, to the next power of two; the
    counts of all other words are joined.  rounds: averaged passes, each over a
    different ``rounds``-th of the training texts, so that all are used once.
    slice: tokens of a slice, for each row of the table."""

    own: int = 31
    groups: int = 32
    table: int = 16
    known: int = 64
    slice: int = 64
    anchors: int = 64
    clustered: int = 1 << 13
    rounds: int = 3
    step: float = 0.2
    batch: int = 2048
    held_out: int = 10

    def rows(self, words: int) -> int:
        return _power(self.table * math.sqrt(max(1, words)), SLICES)

    @property
    def classes(self) -> int:
        return self.own + self.groups + 1  # and the end of a text


@dataclass
class Vocabulary:
    """Sorted hash arrays of the known words, and rules for all others."""

    words: np.ndarray
    counts: np.ndarray
    classes: np.ndarray
    endings: np.ndarray  # class by hashed ending
    mass: np.ndarray  # tokens of each class
    kinds: np.ndarray  # distinct words of each class

    def place(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.words):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.words, hashes), len(self.words) - 1)
        return np.where(self.words[at] == hashes, at, -1)

    def classify(self, t: Texts, place: np.ndarray) -> np.ndarray:
        by_ending = self.endings[endings(t)]
        return np.where(place >= 0, self.classes[place] if len(self.classes) else 0, by_ending)


def endings(t: Texts) -> np.ndarray:
    """16 bits of each word's last three bytes, punctuation included."""
    last = t.data[t.end - 1].astype(np.uint64)
    two = np.where(t.end - t.start > 1, t.data[np.maximum(t.end - 2, 0)], 0).astype(np.uint64)
    three = np.where(t.end - t.start > 2, t.data[np.maximum(t.end - 3, 0)], 0).astype(np.uint64)
    return (keyed(last | two << np.uint64(8) | three << np.uint64(16), 31) & np.uint64(0xFFFF)).astype(np.int64)


def _rows(docs: DataFrame, how: MaxEnt) -> DataFrame:
    part = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % how.held_out
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", (part == 0).alias("held_out"))


def word_counts(train: DataFrame) -> DataFrame:
    """(h, n, e): hash, count and ending of every distinct word of all training texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Held()

        def flush() -> Iterator[pa.RecordBatch]:
            if held.n:
                words, ends = held.take()
                h, first, n = np.unique(words, return_index=True, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n.astype(np.int64)), pa.array(ends[first].astype(np.int32))], ["h", "n", "e"])

        for batch in batches:
            for _, _, t in chunks(batch.column(0), lower=True):
                if held.add(t.word_hashes(), endings(t).astype(np.uint16)):
                    yield from flush()
        yield from flush()

    return train.select("text").mapInArrow(run, "h long, n long, e int").groupBy("h").agg(F.sum("n").alias("n"), F.min("e").alias("e"))


def _ordered_counts(train: DataFrame, words: np.ndarray, column_of: np.ndarray, shape: tuple[int, int]) -> np.ndarray:
    """How often each clustered word stands behind each anchor, over all training texts: a table of fixed size, summed slice by slice."""
    slices = 32
    size = -(-shape[0] * shape[1] // slices)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(size * slices, np.int64)
        for batch in batches:
            for _, _, t in chunks(batch.column(0), lower=True):
                h = t.word_hashes()
                at = np.minimum(np.searchsorted(words, h), len(words) - 1)
                at = np.where(words[at] == h, at, -1)
                anchor = np.where(at >= 0, column_of[at], -1)
                # the nearest anchor before each word, in its text
                last = np.maximum.accumulate(np.where(anchor >= 0, np.arange(len(h)), -1)) if len(h) else np.zeros(0, np.int64)
                prev = np.concatenate(([-1], last[:-1])) if len(h) else last
                ok = (prev >= t.bounds[t.doc]) & (at >= 0) if len(h) else np.zeros(0, bool)
                np.add.at(held, at[ok] * shape[1] + anchor[prev[ok]], 1)
        live = np.flatnonzero(held.reshape(slices, size).any(1))
        yield pa.RecordBatch.from_arrays([pa.array(live.astype(np.int32)), pa.array([held[i * size : (i + 1) * size].astype(np.float32).tobytes() for i in live], pa.binary())], ["slice", "counts"])

    out = np.zeros(size * slices)
    for i, c in _summed(train.select("text").mapInArrow(run, "slice int, counts binary"), slices):
        out[i * size : (i + 1) * size] = c
    return out[: shape[0] * shape[1]].reshape(shape)


def _summed(parts: DataFrame, slices: int) -> list[tuple[int, np.ndarray]]:
    """Sums of binary float32 slices, as they stream in; from many tasks, first in 16 parts a slice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, c in zip(column(batch, "slice").to_pylist(), column(batch, "counts"), strict=True):
                sums[i] = sums.get(i, 0) + np.frombuffer(c.as_buffer(), np.float32).astype(np.float64)
        for i, c in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([c.astype(np.float32).tobytes()], pa.binary())], ["slice", "counts"])

    schema = "slice int, counts binary"
    if parts.rdd.getNumPartitions() > 256:
        parts = parts.repartition("slice", F.pmod(F.spark_partition_id(), F.lit(16))).mapInArrow(run, schema)
    done = parts.repartition(slices, "slice").mapInArrow(run, schema)
    return [(r["slice"], np.frombuffer(r["counts"], np.float32)) for r in done.toArrow().to_pylist()]


def _cluster(profile: np.ndarray, weight: np.ndarray, k: int, rounds: int = 15) -> np.ndarray:
    """Spherical k-means of words by what they follow, heavy words counting more."""
    x = np.sqrt(profile + 1e-3)
    x -= (x * weight[:, None]).sum(0) / weight.sum()
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    rng = np.random.default_rng(3)
    c = x[np.argsort(-weight, kind="stable")[rng.choice(min(len(x), 8 * k), min(k, len(x)), replace=False)]]
    home = np.zeros(len(x), np.int64)
    for _ in range(rounds):
        home = (x @ c.T).argmax(1)
        total = np.zeros_like(c)
        np.add.at(total, home, x * np.sqrt(weight)[:, None])
        norm = np.linalg.norm(total, axis=1, keepdims=True)
        c = np.where(norm > 0, total / np.maximum(norm, 1e-12), c)
    return home


def _frequent(counted: DataFrame, most: int) -> pa.Table:
    """The words over the least count that leaves ``most`` of them at most, by falling count, then hash.

    The count comes from a histogram, exact below 2**16 and in fine logarithmic
    steps above, so that no task sorts candidates of all partitions.
    """
    step = F.when(F.col("n") < 1 << 16, F.col("n")).otherwise((1 << 16) + F.floor(512 * (F.log2("n") - 16))).cast("long")
    kinds = sorted(counted.groupBy(step.alias("s")).agg(F.count("*").alias("k"), F.min("n").alias("least")).collect(), key=lambda r: -r.s)
    total, least = 0, None
    for r in kinds:
        total += r.k
        if total > most:
            break
        least = r.least
    took = counted.where(F.col("n") >= least) if least is not None else counted.where("false")
    return took.select("h", "n", "e").toArrow().sort_by([("n", "descending"), ("h", "ascending")])


def vocabulary(train: DataFrame, counted: DataFrame, how: MaxEnt) -> Vocabulary:
    top = _frequent(counted, _power(how.known * math.sqrt(counted.count())))
    h, n, e = top.column("h").to_numpy().view(np.uint64), top.column("n").to_numpy(), top.column("e").to_numpy()
    cls = np.full(len(h), how.own, np.int64)
    own = min(how.own, len(h))
    cls[:own] = np.arange(own)
    k = min(how.clustered, len(h))
    by_ending = np.full(1 << 16, how.own, np.int64)
    if k > own:
        order = np.argsort(h[:k])
        column_of = np.full(k, -1, np.int64)
        column_of[np.argsort(order)[: min(how.anchors, k)]] = np.arange(min(how.anchors, k))
        profile = _ordered_counts(train, h[:k][order], column_of, (k, how.anchors))[np.argsort(order)]
        share = profile / np.maximum(profile.sum(1, keepdims=True), 1)
        group = _cluster(share, n[:k].astype(float), how.groups)
        cls[own:k] = how.own + group[own:]
        # other words go where clustered words with their ending mostly are
        votes = np.zeros((1 << 16, how.groups))
        np.add.at(votes, (e[own:k], group[own:]), n[own:k])
        fallback = np.bincount(group[own:], n[own:k], how.groups).argmax()
        by_ending = how.own + np.where(votes.any(1), votes.argmax(1), fallback)
        cls[k:] = by_ending[e[k:]]
    order = np.argsort(h)
    mass, kinds = np.zeros(how.classes), np.zeros(how.classes)
    rest = counted.select("h", "n", "e")
    known = train.sparkSession.sparkContext.broadcast((h[order], cls[order], by_ending))

    def per_class(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, classes, other = known.value
        held = np.zeros((2, how.classes))
        for batch in batches:
            hh, nn, ee = column(batch, "h").to_numpy().view(np.uint64), column(batch, "n").to_numpy(), column(batch, "e").to_numpy()
            at = np.minimum(np.searchsorted(words, hh), max(0, len(words) - 1))
            c = np.where(words[at] == hh, classes[at], other[ee]) if len(words) else other[ee]
            held[0] += np.bincount(c, nn, how.classes)
            held[1] += np.bincount(c, minlength=how.classes)
        live = np.flatnonzero(held[1])
        yield pa.RecordBatch.from_arrays([pa.array(live.astype(np.int32)), pa.array(held[0][live].astype(np.int64)), pa.array(held[1][live].astype(np.int64))], ["c", "mass", "kinds"])

    # the last class, that of text ends, has no words
    for c, m, d in rest.mapInArrow(per_class, "c int, mass long, kinds long").groupBy("c").agg(F.sum("mass"), F.sum("kinds")).collect():
        mass[c], kinds[c] = m, d
    return Vocabulary(h[order], n[order], cls[order], by_ending, mass, kinds)


def features(t: Texts, hashes: np.ndarray, cls: np.ndarray, how: MaxEnt, table: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(feature rows by token, target class, document) for each word and each text's end: the word before, the two before, and skips to the second and third before by class and word."""
    n = t.n_words
    docs = np.arange(len(t))
    size = n + 1
    doc = np.repeat(docs, size)
    ends = np.cumsum(size)
    target = np.full(len(doc), how.classes - 1)
    is_word = np.ones(len(doc), bool)
    is_word[ends - 1] = False
    target[is_word] = cls
    seq = np.zeros(len(doc), np.uint64)
    seq[is_word] = hashes
    kind = np.where(is_word, target, how.classes - 1).astype(np.uint64)
    place = np.arange(len(doc)) - np.repeat(ends - size, size)

    def back(x: np.ndarray, k: int) -> np.ndarray:
        out = np.zeros(len(x), np.uint64)
        out[k:] = x[: len(x) - k]
        out[place < k] = np.uint64(k)
        return out

    one, two, three = back(seq, 1), back(seq, 2), back(kind + np.uint64(1), 3)
    c1, c2 = back(kind + np.uint64(1), 1), back(kind + np.uint64(1), 2)
    mask = np.uint64(table - 1)
    rows = np.stack([keyed(one, 41) & mask, keyed(c1 * np.uint64(1009) + c2, 42) & mask, keyed(two, 43) & mask, keyed(c1 * np.uint64(1000003) + c2 * np.uint64(1009) + three, 44) & mask], 1)
    return rows.astype(np.int32), target, doc


def _logits(weights: np.ndarray, bias: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Class scores, held where their exponentials stay finite."""
    z = weights[rows[:, 0]]
    for k in range(1, rows.shape[1]):
        z += weights[rows[:, k]]
    z += bias
    return np.clip(z, -60, 60, out=z)


def target_logs(weights: np.ndarray, bias: np.ndarray, rows: np.ndarray, target: np.ndarray) -> np.ndarray:
    """ln P(class | features) of each token's class."""
    z = _logits(weights, bias, rows)
    own = z[np.arange(len(target)), target].astype(np.float64)
    return own - np.log(np.exp(z, out=z).sum(1, dtype=np.float64))


def _run_sums(x: np.ndarray, order: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Sums of x's rows over runs of order.  Most runs are short: they are added place by place; only long ones are reduced."""
    out = x[order[first]]
    for k in range(1, 4):
        more = np.flatnonzero(size > k)
        if not len(more):
            return out
        out[more] += x[order[first[more] + k]]
    long = np.flatnonzero(size > 4)
    if len(long):
        n = size[long] - 4
        ends = np.cumsum(n)
        at = np.repeat(first[long] + 4 - (ends - n), n) + np.arange(ends[-1])
        out[long] += np.add.reduceat(x[order[at]], ends - n)
    return out


def _descend(weights: np.ndarray, bias: np.ndarray, squares: np.ndarray, rows: np.ndarray, target: np.ndarray, step: float) -> None:
    """One adaptive gradient step over some tokens, in place: sparse rows are summed first, then scaled by each row's own past.  squares has one more place than weights has rows, for the bias."""
    grad = _logits(weights, bias, rows)
    np.exp(grad, out=grad)
    grad /= grad.sum(1, keepdims=True)
    grad[np.arange(len(target)), target] -= 1
    small = rows.astype(np.uint16) if len(weights) <= 1 << 16 else rows
    for k in range(rows.shape[1]):
        order = np.argsort(small[:, k], kind="stable")
        run = small[order, k]
        first = np.flatnonzero(np.concatenate(([True], run[1:] != run[:-1])))
        total = _run_sums(grad, order, first, np.diff(np.append(first, len(run))))
        live = run[first].astype(np.int64)
        past = squares[live] + np.einsum("ij,ij->i", total, total) / total.shape[1]
        squares[live] = past
        total *= (step / np.sqrt(past + 1.0))[:, None]
        weights[live] -= total
    total = grad.sum(0)
    squares[-1] += total @ total / len(total)
    bias -= (step / np.sqrt(squares[-1] + 1.0)) * total


def train_weights(train: DataFrame, vocab: Vocabulary, how: MaxEnt, n_ends: int) -> tuple[np.ndarray, np.ndarray]:
    """(weights, bias) by averaged rounds: in each, every slice of that round's texts descends from the shared weights; means are weighted by how many tokens touched a row.

    A text's round and slice, and its place there, are told by a hash of it; a
    slice is cut into gradient steps by number of tokens.
    """
    table = how.rows(int(vocab.kinds.sum()))
    share = vocab.mass + ALPHA
    share[-1] = n_ends + ALPHA
    bias = np.log(share / share.sum()).astype(np.float32)
    weights = np.zeros((table, how.classes), np.float32)
    squares = np.zeros(table + 1, np.float32)
    spark = train.sparkSession
    per = table // SLICES
    n_slices = max(1, math.ceil((vocab.mass.sum() + n_ends) / how.rounds / (how.slice * table)))
    key = F.xxhash64(F.lit(51), F.col("doc_id"), F.col("text"), F.col("doc_id").isNull())
    dealt = train.select("text", key.alias("key")).withColumn("round", F.pmod("key", F.lit(how.rounds))).withColumn("part", F.pmod(F.floor(F.pmod("key", F.lit(1 << 40)) / how.rounds), F.lit(n_slices)).cast("int"))
    for turn in range(how.rounds):
        shared = spark.sparkContext.broadcast((vocab, weights, bias, squares))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
            v, w0, b0, s0 = shared.value
            now: int | None = None
            w = b = s = seen = None
            left: list[tuple[np.ndarray, np.ndarray]] = []

            def step(rows: np.ndarray, target: np.ndarray) -> None:
                _descend(w, b, s, rows, target, how.step)
                for k in range(rows.shape[1]):
                    np.add.at(seen, rows[:, k], np.float32(1))
                seen[-1] += len(rows)

            def steps(all_: bool) -> None:
                rows, target = (np.concatenate(x) for x in zip(*left, strict=True))
                whole = len(rows) if all_ else len(rows) - len(rows) % how.batch
                for lo in range(0, whole, how.batch):
                    step(rows[lo : lo + how.batch], target[lo : lo + how.batch])
                left[:] = [(rows[whole:], target[whole:])] if whole < len(rows) else []

            def close() -> Iterator[pa.RecordBatch]:
                if now is None:
                    return
                if left:
                    steps(True)
                both = np.concatenate(((w - w0) * seen[:-1, None], seen[:-1, None], (s - s0)[:-1, None]), 1).astype(np.float32)
                for i in np.flatnonzero((seen[:-1] > 0).reshape(SLICES, per).any(1)).tolist():
                    yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([both[i * per : (i + 1) * per].tobytes()], pa.binary())], ["slice", "counts"])
                own = np.concatenate(((b - b0) * seen[-1], seen[-1:], (s - s0)[-1:])).astype(np.float32)
                yield pa.RecordBatch.from_arrays([pa.array([SLICES], pa.int32()), pa.array([own.tobytes()], pa.binary())], ["slice", "counts"])

            for batch in batches:
                parts = column(batch, "part").to_numpy()
                cuts = np.concatenate(([0], np.flatnonzero(parts[1:] != parts[:-1]) + 1, [len(parts)])) if len(parts) else [0]
                for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                    if parts[lo] != now:
                        yield from close()
                        now, w, b, s, seen = int(parts[lo]), w0.copy(), b0.copy(), s0.copy(), np.zeros(table + 1, np.float32)
                    for _, _, t in chunks(column(batch, "text").slice(lo, hi - lo), lower=True, size=1 << 18):
                        h = t.word_hashes()
                        rows, target, _ = features(t, h, v.classify(t, v.place(h)), how, table)
                        left.append((rows, target))
                        if sum(len(r) for r, _ in left) >= 16 * how.batch:
                            steps(False)
            yield from close()

        mine = dealt.where(F.col("round") == turn).select("part", "key", "text").repartitionById(n_slices, F.col("part")).sortWithinPartitions("part", "key")
        for i, c in _summed(mine.mapInArrow(run, "slice int, counts binary"), SLICES):
            if i == SLICES:
                bias = bias + c[: how.classes] / max(float(c[how.classes]), 1e-9)
                squares[-1] += c[-1]
                continue
            c = c.reshape(per, how.classes + 2)
            at = slice(i * per, (i + 1) * per)
            weights[at] += c[:, : how.classes] / np.maximum(c[:, how.classes : how.classes + 1], 1e-9)
            squares[:-1][at] += c[:, how.classes + 1]
        shared.unpersist()
    return weights, bias.astype(np.float32)


def score(docs: DataFrame, how: MaxEnt = MaxEnt()) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score), a row for each row of docs.

    Tokens are words outside [\\x20\\x09-\\x0D], A-Z lower-cased, and one end a
    text; null and empty texts have the end alone.  Learned from are the texts
    whose crc32(doc_id as text) mod held_out is not 0 (a null id counts as empty
    text).  base_score is the add-0.1 unigram's log10 probability; score the
    model's.  A word that training lacks has its class's share of an unseen one,
    so the model's probabilities sum to 1 over the known words and one unseen
    word a class.  With nothing to learn from, counts are 0.  An empty table gives an empty
    result.  Other columns are not read.

    Repeated rows each get a row and count each time.  Counts of frequent words
    lie in sorted arrays in every task; all other words are joined to their
    counts, summed first by text.
    """
    rows = _rows(small_batches(docs), how)
    train = rows.where("not held_out")
    counted = stored(word_counts(train))
    vocab = vocabulary(train, counted, how)
    n_words, v_words = int(vocab.mass.sum()), int(vocab.kinds.sum())
    n_ends = train.count()
    n, v = n_words + n_ends, v_words + (n_ends > 0)
    weights, bias = train_weights(train, vocab, how, n_ends) if n_ends else (np.zeros((SLICES, how.classes), np.float32), np.zeros(how.classes, np.float32))
    # a class's unseen word has ALPHA as well; own classes have no unseen one
    unseen = np.r_[np.zeros(how.own), np.ones(how.groups), 0]
    inside = np.log10(np.maximum(vocab.mass + ALPHA * (vocab.kinds + unseen), 1e-300))
    shared = docs.sparkSession.sparkContext.broadcast((vocab, weights.astype(np.float32), bias, inside))
    names = ["row", "doc_id", "held_out", "n_tokens", "n_known", "known_sum", "class_sum", "rare", "times"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vo, w, b, ins = shared.value
        for batch in batches:
            for lo, hi, t in chunks(column(batch, "text"), lower=True, size=1 << 18):
                h = t.word_hashes()
                at = vo.place(h)
                cls = vo.classify(t, at)
                feats, target, doc = features(t, h, cls, how, len(w))
                total = np.zeros(len(t))
                for a in range(0, len(feats), how.batch):
                    logs = target_logs(w, b, feats[a : a + how.batch], target[a : a + how.batch])
                    total += np.bincount(doc[a : a + how.batch], logs / np.log(10), len(t))
                total -= t.per_doc_words(ins[cls])
                seen = at >= 0
                logs = np.where(seen, np.log10(vo.counts[at] + ALPHA), 0.0) if len(vo.counts) else np.zeros(len(h))
                # the rest, once for each text and word
                owner = t.doc[~seen]
                rest = h[~seen]
                order = np.lexsort((rest, owner))
                rest, owner = rest[order], owner[order]
                new = np.ones(len(rest), bool)
                new[1:] = (rest[1:] != rest[:-1]) | (owner[1:] != owner[:-1])
                first = np.flatnonzero(new)
                times = np.diff(np.append(first, len(rest)))
                off = np.searchsorted(owner[first], np.arange(len(t) + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([column(batch, "row").slice(lo, hi - lo), column(batch, "doc_id").slice(lo, hi - lo), column(batch, "held_out").slice(lo, hi - lo), pa.array((t.n_words + 1).astype(np.int64)), pa.array(t.per_doc_words(seen.astype(np.int64))), pa.array(t.per_doc_words(logs)), pa.array(total), pa.ListArray.from_arrays(pa.array(off), pa.array(rest[first].view(np.int64))), pa.ListArray.from_arrays(pa.array(off), pa.array(times.astype(np.int32)))], names)

    schema = "row long, doc_id long, held_out boolean, n_tokens long, n_known long, known_sum double, class_sum double, rare array<long>, times array<int>"
    scored = stored(rows.withColumn("row", F.monotonically_increasing_id()).select("row", "doc_id", "held_out", "text").mapInArrow(run, schema))
    pairs = scored.select("row", F.explode(F.arrays_zip("rare", "times")).alias("p")).select("row", F.col("p.rare").alias("h"), F.col("p.times").alias("times"))
    rest = pairs.join(counted.select("h", "n"), "h").groupBy("row").agg(F.sum("times").alias("k"), F.sum(F.col("times") * (F.log10(F.col("n") + ALPHA) - float(np.log10(ALPHA)))).alias("more"))
    out = scored.select("row", "doc_id", "held_out", "n_tokens", "n_known", "known_sum", "class_sum").join(rest, "row", "left")
    known = F.col("n_known") + F.coalesce("k", F.lit(0))
    # what is in no count has log10(ALPHA)
    words = F.col("known_sum") + (F.col("n_tokens") - 1 - F.col("n_known")) * float(np.log10(ALPHA)) + F.coalesce("more", F.lit(0.0))
    base = words + float(np.log10(n_ends + ALPHA)) - F.col("n_tokens") * float(np.log10(n + ALPHA * (v + 1)))
    return out.select("doc_id", "held_out", "n_tokens", (known + int(n_ends > 0)).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"), base.alias("base_score"), (words + F.col("class_sum")).alias("score"))
