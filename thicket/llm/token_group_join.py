"""N-gram Jaccard join by a token-group matrix.

Equal shingle sets are one class.  Classes fall into groups of similar ones; a
matrix keeps, for each group, the union of its members' tokens, as a bitmap.  No
two sets can be similar unless each overlaps the other's group union enough, so
overlaps with unions bound similarity, and only groups that qualify for a set are
opened and compared set by set.  Links are exact; of each opened pair of groups
only a spanning forest of links is kept.  Groups are first opened for themselves
and for one other of their hub's; then only what is not connected yet is compared,
so that a cluster of near copies expands neither into all pairs nor into all
pairs of groups.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thicket.llm.components import components, forest
from thicket.scratch import drop, small_batches, stored
from thicket.llm.wordgrid import Texts, chunks, column, keyed, mix, ngrams

_U = np.uint64
#: With so few sets in candidate groups, their places are broadcast (some 60 MB at most); with more, they meet the texts in a shuffled join.
BROADCAST_ROWS = 500_000


@dataclass(frozen=True)
class Similarity:
    """Sets of n-word shingles link at percent * union <= 100 * intersection.
    sketch: counters (a power of two) of the fixed-size frequency sketch that
    puts rare tokens first; group: about the most members a group has."""

    n: int = 3
    percent: int = 90
    sketch: int = 1 << 20
    group: int = 256

    @property
    def least(self) -> int:
        """The size of the smallest set that can link with another set."""
        return max(1, -(-self.percent // max(1, 100 - self.percent)))

    @property
    def shared(self) -> int:
        """How many tokens of their prefixes similar sets share at least."""
        return min(3, self.least)

    def prefix(self, size: np.ndarray) -> np.ndarray:
        """Similar sets share ``shared`` of their first so many tokens, in any order that all sets agree on."""
        return np.minimum(size, size - -(-self.percent * size // 100) + self.shared)


EXACT90 = Similarity()
NEAR = Similarity(n=5, percent=80)


def shingle_sets(t: Texts, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, one after the other, and their bounds.  A text with fewer words is one shingle; without words, none."""
    words, doc, size = t.word_hashes(), t.doc, t.n_words
    grams, at = ngrams(words, doc, n)
    owner = doc[at]
    few = np.flatnonzero((size > 0) & (size < n))
    if len(few):
        whole = np.zeros(len(few), _U)
        for k in range(n - 1):
            has = size[few] > k
            whole[has] = (whole[has] + words[t.bounds[few[has]] + k]) * _U(0xA0761D6478BD642F + 2 * k)
        grams, owner = np.concatenate((grams, keyed(whole, 77))), np.concatenate((owner, few))
    order = np.lexsort((grams, owner))
    grams, owner = grams[order], owner[order]
    new = np.ones(len(grams), bool)
    new[1:] = (grams[1:] != grams[:-1]) | (owner[1:] != owner[:-1])
    grams, owner = grams[new], owner[new]
    return grams, np.searchsorted(owner, np.arange(len(t) + 1))


def sketch(docs: DataFrame, sim: Similarity) -> np.ndarray:
    """Of each hash bucket, a logarithmic count of all shingles of all texts: sim.sketch bytes whatever the input.  Partial counts are summed slice by slice as they stream in, so memory doesn't grow with the number of tasks."""
    slices = 64
    width = sim.sketch // slices

    def counts(batches):  # noqa: ANN001, ANN202
        held = np.zeros(sim.sketch, np.int64)
        for batch in batches:
            for _, _, t in chunks(batch.column(0), lower=True):
                grams, _ = shingle_sets(t, sim.n)
                np.add.at(held, (grams & _U(sim.sketch - 1)).astype(np.int64), 1)
        yield rows(held)

    def rows(held: np.ndarray) -> pa.RecordBatch:
        at = np.flatnonzero(held.reshape(slices, width).any(1))
        return pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array([held[i * width : (i + 1) * width].astype(np.uint32).tobytes() for i in at], pa.binary())], ["slice", "counts"])

    def total(batches):  # noqa: ANN001, ANN202
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, c in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                sums[i] = sums.get(i, 0) + np.frombuffer(c.as_buffer(), np.uint32).astype(np.int64)
        for i, c in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([np.minimum(c, (1 << 32) - 1).astype(np.uint32).tobytes()], pa.binary())], ["slice", "counts"])

    schema = "slice int, counts binary"
    part = small_batches(docs).select("text").mapInArrow(counts, schema).repartition("slice", F.pmod(F.spark_partition_id(), F.lit(16))).mapInArrow(total, schema).repartition(slices, "slice").mapInArrow(total, schema)
    out = np.zeros(sim.sketch, np.uint32)
    for r in part.toArrow().to_pylist():
        out[r["slice"] * width : (r["slice"] + 1) * width] = np.frombuffer(r["counts"], np.uint32)
    return np.minimum(255, 8 * np.log2(out + 1.0)).astype(np.uint8)


def digests(sets: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits that name a set: sums of two keyed hashes of its members."""
    out = []
    for key in (11, 12):
        total = np.zeros(len(sets) + 1, _U)
        np.cumsum(keyed(sets, key), out=total[1:])
        out.append(mix(total[bounds[1:]] - total[bounds[:-1]] + np.diff(bounds).astype(_U)).view(np.int64))
    return out[0], out[1]


def bitmaps(sets: np.ndarray, bounds: np.ndarray) -> list[bytes]:
    """Of each set, the hashes of its members in a bitmap of 2 to 4 times as many bits: a power of two, so that a large one folds onto a small one's size."""
    n = np.diff(bounds)
    width = np.maximum(64, 1 << (np.ceil(np.log2(np.maximum(n, 1))).astype(np.int64) + 1))
    ends = np.cumsum(width)
    bits = np.zeros(int(ends[-1]) if len(ends) else 0, bool)
    bits[np.repeat(ends - width, n) + (keyed(sets, 13) & np.repeat(width - 1, n).astype(_U)).astype(np.int64)] = True
    packed = np.packbits(bits).tobytes()
    return [packed[(e - w) // 8 : e // 8] for e, w in zip(ends.tolist(), width.tolist(), strict=True)]


def folded(bits: np.ndarray, width: int) -> np.ndarray:
    """Rows of bitmaps, folded onto ``width`` bytes."""
    return np.bitwise_or.reduce(bits.reshape(len(bits), -1, width), axis=1) if bits.shape[1] > width else bits


def signatures(docs: DataFrame, sim: Similarity, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, n, da, db, prefix, bits) and columns ``keep``: the size and name of each row's set, and, if it can link with another set, its rarest tokens and its bitmap."""
    order_of = docs.sparkSession.sparkContext.broadcast(sketch(docs, sim))
    names = ["doc_id", "n", "da", "db", "prefix", "bits", *keep]

    def run(batches):  # noqa: ANN001, ANN202
        rare = order_of.value
        for batch in batches:
            for lo, hi, t in chunks(column(batch, "text"), lower=True):
                sets, bounds = shingle_sets(t, sim.n)
                size = np.diff(bounds)
                owner = np.repeat(np.arange(len(t)), size)
                order = np.lexsort((sets, rare[(sets & _U(sim.sketch - 1)).astype(np.int64)], owner))
                rank = np.arange(len(sets)) - bounds[:-1][owner]
                take = np.where(size >= sim.least, sim.prefix(size), 0)
                tokens = sets[order][rank < take[owner]].view(np.int64)
                da, db = digests(sets, bounds)
                offsets = np.concatenate(([0], np.cumsum(take))).astype(np.int32)
                yield pa.RecordBatch.from_arrays([column(batch, "doc_id").slice(lo, hi - lo), pa.array(size.astype(np.int64)), pa.array(da), pa.array(db), pa.ListArray.from_arrays(pa.array(offsets), pa.array(tokens)), pa.array([h if k else None for h, k in zip(bitmaps(sets, bounds), take, strict=True)], pa.binary()), *(column(batch, c).slice(lo, hi - lo) for c in keep)], names)

    schema = ", ".join(["doc_id long, n long, da long, db long, prefix array<long>, bits binary", *(f"{c} {docs.schema[c].dataType.simpleString()}" for c in keep)])
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *keep).mapInArrow(run, schema)


def opened(sets_a: list[np.ndarray], sets_b: list[np.ndarray], sim: Similarity, own: bool = False) -> list[tuple[int, int]]:
    """A spanning forest of the links between two groups, and if own within the first, members numbered on through both.

    A set stays only if its overlap with the token union of what it is compared
    with, which no overlap with a member can exceed, reaches what a link needs.
    """
    both, k = sets_a + sets_b, len(sets_a)
    size = np.array([len(s) for s in both])
    alive = np.ones(len(both), bool)
    for mine, other in ((range(0 if own else k), sets_b), (range(k, len(both)), sets_a)):
        if len(mine) and other:
            union = np.unique(np.concatenate(other))
            flat = np.concatenate([both[i] for i in mine])
            at = np.minimum(np.searchsorted(union, flat), len(union) - 1)
            hit = np.add.reduceat((union[at] == flat).astype(np.int64), np.concatenate(([0], np.cumsum(size[list(mine)])[:-1])))
            alive[list(mine)] = 100 * hit >= sim.percent * size[list(mine)]
    left, right = np.flatnonzero(alive[:k]), k + np.flatnonzero(alive[k:])
    if own:
        right = np.concatenate((left, right))
    if not len(left) or not len(right):
        return []
    kept = np.unique(np.concatenate((left, right)))
    flat = np.concatenate([both[i] for i in kept])
    token, code, count = np.unique(flat, return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(kept)), size[kept])
    dense = count > 1  # a token of one set adds to no intersection
    number = np.cumsum(dense) - 1
    sel = dense[code]
    code, row = number[code[sel]], row[sel]
    li, ri = np.searchsorted(kept, left), np.searchsorted(kept, right)
    inter = np.zeros((len(left), len(right)), np.float32)
    step, width = 8192, int(dense.sum())
    for at in range(0, width, step):
        block = np.zeros((len(kept), min(step, width - at)), np.float32)
        here = (code >= at) & (code < at + step)
        block[row[here], code[here] - at] = 1
        inter += block[li] @ block[ri].T
    union = size[left][:, None] + size[right][None, :] - inter
    a, b = np.nonzero(100 * inter >= sim.percent * union)
    a, b = left[a], right[b]
    a, b = a[a < b], b[a < b]
    return [(int(a[i]), int(b[i])) for i in forest(len(both), a, b)]


def links(docs: DataFrame, classes: DataFrame, sim: Similarity) -> DataFrame:
    """(id, component_id) of classes that links connect with others, by number; classes(cid, rep, n, da, prefix, bits).

    Groups are classes of one size of bitmap whose most shared rare token is the
    same, in parts of about sim.group.  Pairs of groups that share enough prefix tokens are
    candidates, as no two sets link that don't.
    """
    tokens = classes.select("cid", F.explode("prefix").alias("token"))
    common = tokens.groupBy("token").agg(F.count("*").alias("df")).where("df > 1")
    shared = stored(tokens.join(common, "token"))
    hubs = shared.groupBy("cid").agg(F.max(F.struct("df", "token")).alias("hub"), F.count("*").alias("k")).where(f"k >= {sim.shared}")
    alike = hubs.select("cid", "hub").join(classes.select("cid", "rep", "n", "da", "bits"), "cid")
    gid = lambda part: F.xxhash64("hub.token", F.octet_length("bits"), part)
    part = F.pmod(F.xxhash64("cid"), F.ceil(F.col("hub.df") / sim.group))
    members = stored(alike.select("cid", "rep", "n", "da", "bits", gid(part).alias("gid"), gid(F.lit(0).cast("bigint")).alias("first")))
    matrix = stored(shared.join(members.select("cid", "n", "gid"), "cid").groupBy("token", "gid").agg(F.min("n").alias("low"), F.max("n").alias("high")))
    a, b = matrix.alias("a"), matrix.alias("b")
    fit = f"a.token = b.token and a.gid < b.gid and 100 * a.high >= {sim.percent} * b.low and 100 * b.high >= {sim.percent} * a.low"
    pairs = stored(a.join(b, F.expr(fit)).groupBy(F.col("a.gid").alias("ga"), F.col("b.gid").alias("gb")).agg(F.count("*").alias("overlap")).where(f"overlap >= {sim.shared}").select("ga", "gb"))
    unions = stored(members.select("gid", "first", "n", "bits").repartition("gid").sortWithinPartitions("gid").mapInArrow(_unions, "gid long, first long, members long, low long, bits binary"))
    # first each group within itself and with the first group of its token; then, of all pairs, what is in different components still
    near = unions.select("gid", "first").join(pairs, F.least("gid", "first").eqNullSafe(F.col("ga")) & F.greatest("gid", "first").eqNullSafe(F.col("gb")), "left_semi")
    alone = unions.where("members > 1").select("gid", "first").join(near, ["gid"], "left_anti").select("gid", F.col("gid").alias("first"))
    tiles = stored(near.union(alone).select(F.col("gid").alias("ga"), F.col("first").alias("gb")))
    begun = _compared(docs, members, unions, tiles, sim, own=True)
    joined = stored(components(begun))
    placed = stored(members.join(joined, F.col("cid") == F.col("id"), "left").select(*members.columns, F.coalesce("component_id", "cid").alias("comp")))
    # two groups that are of one component as a whole, or have been compared, give no new link
    whole = stored(placed.groupBy("gid").agg(F.min("comp").alias("least"), F.max("comp").alias("most")))
    ends = [whole.select(F.col("gid").alias(g), F.col("least").alias(f"{g}0"), F.col("most").alias(f"{g}1")) for g in ("ga", "gb")]
    met = tiles.select(F.least("ga", "gb").alias("ga"), F.greatest("ga", "gb").alias("gb"))
    apart = pairs.join(met, ["ga", "gb"], "left_anti").join(ends[0], "ga").join(ends[1], "gb").where("not (ga0 = ga1 and gb0 = gb1 and ga0 = gb0)")
    rest = _compared(docs, placed, unions.join(whole, "gid"), apart.select("ga", "gb"), sim)
    more = rest.limit(1).count() > 0
    for df in (shared, members, unions, matrix, pairs, tiles, begun, placed, whole):
        drop(df)
    return components(joined.select(F.col("id").alias("a"), F.col("component_id").alias("b")).union(rest)) if more else joined


def _compared(docs: DataFrame, members: DataFrame, unions: DataFrame, pairs: DataFrame, sim: Similarity, own: bool = False) -> DataFrame:
    """(a, b): links between classes of the pairs of groups, a spanning forest for each pair that is opened.  own: links within the first of each pair too, which may be paired with itself; else members have a component, and those that are of the other group's only one are left out."""
    tiles = stored(pairs.withColumn("tile", F.xxhash64("ga", "gb")))
    sides = tiles.select("tile", F.col("ga").alias("gid"), F.col("gb").alias("other"), F.lit(0).alias("side")).union(tiles.where("ga != gb").select("tile", F.col("gb").alias("gid"), F.col("ga").alias("other"), F.lit(1).alias("side")))
    against = sides.join(members, "gid").join(unions.select(F.col("gid").alias("other"), "low", F.col("bits").alias("union"), *(() if own else ("least", "most"))), "other")
    if not own:
        against = against.where("not (least = most and least = comp)")
    qualified = stored(against.select("tile", "side", "cid", "rep", "da", "n", "low", "bits", "union").mapInArrow(_qualify(sim, own), "tile long, side int, cid long, rep long, da long"))
    both = qualified.groupBy("tile").agg(F.count("*").alias("k"), F.min("side").alias("s0"), F.max("side").alias("s1"))
    met = both.where("k > 1 and s0 = 0" + ("" if own else " and s1 = 1")).select("tile")
    places = stored(qualified.join(met, "tile").groupBy("cid", "rep", "da").agg(F.collect_list(F.struct("tile", "side")).alias("places")))
    few = places.count() <= BROADCAST_ROWS and qualified.count() <= 8 * BROADCAST_ROWS
    texts = docs.select(F.col("doc_id").cast("long").alias("rep"), "text").join(F.broadcast(places) if few else places, "rep").select("cid", "da", "text", F.explode("places").alias("p")).select("p.tile", "p.side", "cid", "da", "text")
    found = stored(texts.repartition("tile").sortWithinPartitions("tile", "side", "cid").mapInArrow(_open_tiles(sim, own), "a long, b long"))
    for df in (tiles, qualified, places):
        drop(df)
    return found


def _unions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each group's number of members, least size and token union; members come sorted by group, whose bitmaps are of one size."""
    names = ["gid", "first", "members", "low", "bits"]
    held: list | None = None  # the last group, which the next batch may go on with

    def batch_of(rows: list[list]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (*[pa.int64()] * 4, pa.binary()), strict=True)], names)

    for batch in batches:
        if not batch.num_rows:
            continue
        gid, first, n = (column(batch, c).to_numpy() for c in ("gid", "first", "n"))
        bits = column(batch, "bits")
        start = np.flatnonzero(np.concatenate(([True], gid[1:] != gid[:-1])))
        run = np.repeat(np.arange(len(start)), np.diff(np.append(start, len(gid))))
        width = pc.binary_length(bits).to_numpy(zero_copy_only=False)
        union: list[bytes] = [b""] * len(start)
        for w in np.unique(width).tolist():
            rows = np.flatnonzero(width == w)
            heads = np.flatnonzero(np.concatenate(([True], run[rows[1:]] != run[rows[:-1]])))
            both = np.bitwise_or.reduceat(np.frombuffer(b"".join(bits.take(pa.array(rows)).to_pylist()), np.uint8).reshape(len(rows), w), heads, axis=0)
            for k, x in zip(run[rows[heads]].tolist(), both, strict=True):
                union[k] = x.tobytes()
        out = [list(r) for r in zip(gid[start].tolist(), first[start].tolist(), np.bincount(run).tolist(), np.minimum.reduceat(n, start).tolist(), union, strict=True)]
        if held is not None and held[0] == out[0][0]:
            same = np.frombuffer(held[4], np.uint8) | np.frombuffer(out[0][4], np.uint8)
            out[0] = [held[0], held[1], held[2] + out[0][2], min(held[3], out[0][3]), same.tobytes()]
        elif held is not None:
            out.insert(0, held)
        held = out.pop()
        if out:
            yield batch_of(out)
    if held is not None:
        yield batch_of([held])


def _qualify(sim: Similarity, own: bool = False):  # noqa: ANN202
    """Keeps, besides the first group's if it is compared within itself, the sets whose overlap with the other group's token union can reach what a link with any of its members needs: a set has at least as many members outside of the union as its bitmap has bits outside of the union's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, other = column(batch, "bits"), column(batch, "union")
            shape = np.stack([pc.binary_length(x).to_numpy(zero_copy_only=False) for x in (own, other)], 1)
            n, low = (column(batch, c).to_numpy(zero_copy_only=False) for c in ("n", "low"))
            outside = np.zeros(batch.num_rows, np.int64)
            for a, b in np.unique(shape, axis=0).tolist():
                rows = np.flatnonzero((shape[:, 0] == a) & (shape[:, 1] == b))
                at, width = pa.array(rows), min(a, b)
                q, u = (folded(np.frombuffer(b"".join(x.take(at).to_pylist()), np.uint8).reshape(len(rows), -1), width) for x in (own, other))
                outside[rows] = np.bitwise_count(q & ~u).sum(1)
            ok = 100 * (n - outside) >= sim.percent * np.maximum(n, low)
            if own:
                ok |= column(batch, "side").to_numpy() == 0
            yield batch.select(["tile", "side", "cid", "rep", "da"]).filter(pa.array(ok))

    return run


def _open_tiles(sim: Similarity, own: bool = False):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: int | None = None
        held: dict[tuple[int, int], np.ndarray] = {}
        out: tuple[list[int], list[int]] = ([], [])

        def close() -> None:
            ids = sorted(held)
            sides = [[held[i] for i in ids if i[0] == s] for s in (0, 1)]
            for x, y in opened(sides[0], sides[1], sim, own) if sides[0] else []:
                out[0].append(ids[x][1])
                out[1].append(ids[y][1])
            held.clear()

        def flush() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], ["a", "b"])
            out[0].clear()
            out[1].clear()
            return batch

        for batch in batches:
            tile, side, cid, da = (column(batch, c).to_numpy(zero_copy_only=False) for c in ("tile", "side", "cid", "da"))
            for lo, hi, t in chunks(column(batch, "text"), lower=True):
                sets, bounds = shingle_sets(t, sim.n)
                name, _ = digests(sets, bounds)
                for i in range(lo, hi):
                    if tile[i] != now:
                        close()
                        now = tile[i]
                    if name[i - lo] == da[i]:  # another row of the same id may have another text
                        held[int(side[i]), int(cid[i])] = sets[bounds[i - lo] : bounds[i - lo + 1]].copy()
                if len(out[0]) > 10000:
                    yield flush()
        close()
        yield flush()

    return run


def classify(docs: DataFrame, sim: Similarity = EXACT90) -> DataFrame:
    """(doc_id, n_shingles, component_id), a row for each row of docs.

    Words are runs outside [\\x20\\x09-\\x0D], A-Z lower-cased; a set is the
    distinct n-word shingles, of a text with fewer words its whole sequence.
    component_id is the least doc_id reachable over links, itself included.
    Null and word-less texts have no shingles and link with nothing.  Equal sets
    link whatever their number; a row that repeats an id with another text has
    its own class.  A null id has its class's component, null if it has none.  An empty table
    gives an empty result.  Other columns are not read.
    """
    signed, named = _named(docs, sim)
    out = signed.where("n > 0").select("doc_id", "n", "da", "db").join(named, ["da", "db"], "left").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return out.union(signed.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))


def _named(docs: DataFrame, sim: Similarity, keep: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """The signatures of docs, and (da, db, comp, component_id): the component of each class that has an id, by number and by least id."""
    signed = stored(signatures(docs, sim, keep))
    sets = signed.where("n > 0 and doc_id is not null").groupBy("da", "db").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("prefix").alias("prefix"), F.first("bits").alias("bits"))
    # a class is named by a number of its own, as rows of one id may be of several classes
    classes = stored(sets.withColumn("cid", F.monotonically_increasing_id()))
    by_class = stored(classes.select("da", "db", "rep", "cid").join(links(docs, classes, sim), F.col("cid") == F.col("id"), "left").select("da", "db", "rep", F.coalesce("component_id", "cid").alias("comp")))
    least = stored(by_class.groupBy("comp").agg(F.min("rep").alias("component_id")))
    return signed, stored(by_class.join(least, "comp").select("da", "db", "comp", "component_id"))


def keep_one(docs: DataFrame, sim: Similarity = NEAR) -> DataFrame:
    """Of each component of docs the row with the least id, and of those the least in a hash of the whole row; all columns.

    Rows that are equal in every column are one row.  Rows of one id with texts
    that don't link all stay.  Rows without an id belong to their class's
    component; rows without words link with nothing and stay.  The result hangs
    on the rows alone, not on their order.  An empty table stays empty.
    """
    names = [f"`{c.replace('`', '``')}`" for c in docs.columns]
    # maps can't be hashed or compared
    whole = [F.col(n) for n, f in zip(names, docs.schema, strict=True) if "map<" not in f.dataType.simpleString()]
    nulls = F.array(*[c.isNull() for c in whole])
    rows = docs.select("doc_id", "text", F.struct(*names).alias("_row"), F.xxhash64(F.lit(1), nulls, *whole).alias("_a"), F.xxhash64(F.lit(2), nulls, *whole).alias("_b"))
    signed, named = _named(small_batches(rows), sim, ("_a", "_b"))
    wordless, has = F.col("n") == 0, F.col("comp").isNotNull()
    pick = lambda x, y, z: F.when(wordless, x).when(has, y).otherwise(z)
    of = [pick(F.lit(0), F.lit(1), F.lit(2)).alias("k0"), pick(F.col("_a"), F.col("comp"), F.col("da")).alias("k1"), pick(F.col("_b"), F.lit(0).cast("bigint"), F.col("db")).alias("k2")]
    order = F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("d"), F.col("_a").alias("_a"), F.col("_b").alias("_b"))
    kept = signed.join(named, ["da", "db"], "left").groupBy(*of).agg(F.min(order).alias("k")).select("k._a", "k._b")
    once = rows.groupBy("_a", "_b").agg(F.first("_row").alias("_row"))
    return once.join(stored(kept), ["_a", "_b"], "left_semi").select(*[F.col(f"_row.{n}") for n in names])
