"""Embedding near-dedup: spherical k-means cells, blocked cosine products in each, one representative a group.

Cells are exact, not approximate: two unit vectors of cosine c are sqrt(2 - 2c)
apart, so a vector visits every cell whose border with its own is no farther.
A pair is then met in the lower-numbered of its two home cells, and only there.
Cells begin as labels and are cut, level by level, by centres fitted on their own
vectors, for as long as that lessens the products: their number grows with the
input, and a cell that has no structure to cut along stays whole, in blocks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thicket.llm.components import components, forest
from thicket.scratch import drop, stored
from thicket.llm.wordgrid import column


@dataclass(frozen=True)
class Cells:
    """A cell of over ``members`` distinct vectors is cut by k-means, into one cell
    for each so many, ``branch`` at most at a level.  Centres are fitted on about
    ``sample`` of its vectors, those least in a keyed hash; every vector is
    assigned and compared.  A cut stands if it leaves at most ``gain`` of the
    cell's products.  block: vectors on a side of a product."""

    cosine: float = 0.98
    sample: int = 4096
    members: int = 2000
    branch: int = 64
    gain: float = 0.7
    rounds: int = 10
    block: int = 2048


def spherical_kmeans(x: np.ndarray, k: int, rounds: int, seed: int = 5) -> np.ndarray:
    """Unit centres of the unit rows x; empty cells are dealt the rows farthest from their centre."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), k, replace=False)]
    for _ in range(rounds):
        dots = x @ c.T
        home = dots.argmax(1)
        total = np.zeros_like(c)
        np.add.at(total, home, x)
        empty = np.flatnonzero(np.bincount(home, minlength=k) == 0)
        if len(empty):
            total[empty] = x[np.argsort(dots.max(1))[: len(empty)]]
        norm = np.linalg.norm(total, axis=1, keepdims=True)
        c = np.where(norm > 1e-12, total / np.maximum(norm, 1e-12), c)
    return c


def _matrix(col: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    """Rows of a binary column that all hold dim doubles."""
    chunks = col.chunks if isinstance(col, pa.ChunkedArray) else [col]
    out = []
    for c in chunks:
        if len(c):
            _, off, data = c.buffers()
            at = np.frombuffer(off, np.int32, len(c) + 1, c.offset * 4)
            out.append(np.frombuffer(data, np.float64, (int(at[-1]) - int(at[0])) // 8, int(at[0])).reshape(-1, dim))
    return np.concatenate(out) if out else np.zeros((0, dim))


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _signed(vectors: DataFrame) -> DataFrame:
    """(vec_id, label, dim, vec binary), a row for each row; vec is null where it can't link.

    A vector is scaled by the power of two that brings its largest component to
    between a half and one: that is exact and leaves cosines as they are, but
    squares neither overflow nor vanish.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = column(batch, "v")
            n = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            flat = lists.flatten()
            x = flat.to_numpy(zero_copy_only=False).astype(np.float64) + 0.0  # null as NaN, -0 as 0
            ends = np.cumsum(n)
            good = (n > 0) & column(batch, "vec_id").is_valid().to_numpy(zero_copy_only=False) & column(batch, "label").is_valid().to_numpy(zero_copy_only=False)
            has = np.flatnonzero(n > 0)
            top = np.zeros(len(n))
            if len(has):
                top[has] = np.maximum.reduceat(np.abs(x), (ends - n)[has])  # NaN stays
            good &= np.isfinite(top) & (top > 0)
            shift = np.zeros(len(n), np.int64)
            shift[good] = -np.frexp(top[good])[1]
            owner = np.repeat(np.arange(len(n)), n)
            keep = good[owner]
            # in two steps, as 2 ** 1074 is no double
            half = shift[owner[keep]] // 2
            x = np.ldexp(np.ldexp(x[keep], half), shift[owner[keep]] - half)
            size = np.where(good, n, 0)
            offsets = pa.py_buffer(np.concatenate(([0], np.cumsum(size) * 8)).astype(np.int32).tobytes())
            mask = pa.array(good).buffers()[1]
            vec = pa.Array.from_buffers(pa.binary(), len(n), [mask, offsets, pa.py_buffer(np.ascontiguousarray(x).tobytes())])
            yield pa.RecordBatch.from_arrays([column(batch, "vec_id"), column(batch, "label"), pa.array(size.astype(np.int32)), vec], ["vec_id", "label", "dim", "vec"])

    return vectors.mapInArrow(run, "vec_id long, label long, dim int, vec binary")


_PLACED = "cell string, side int, rep long, dim int, vec binary, copies long"


def _salted(rows: DataFrame, size: DataFrame, part: int = 16384) -> DataFrame:
    """rows of the cells in size(cell, n), in parts of about ``part`` rows."""
    return rows.join(size, "cell").withColumn("salt", F.pmod(F.xxhash64("rep"), F.ceil(F.col("n") / part)).cast("int")).drop("n")


def _cut(rows: DataFrame, counts: DataFrame, how: Cells) -> DataFrame:
    """Placements in the cells below those of rows: a home row's home and the lower-numbered cells it visits, a visitor's every cell within reach."""
    low = F.pmod(F.xxhash64(F.lit(7), "vec"), F.lit(1 << 30)) * F.col("h0") <= F.lit(float(1 << 30)) * how.sample
    sample = rows.where("side = 0").join(counts.select("cell", F.col("h").alias("h0")), "cell").where(low).select("cell", "dim", "h0", "vec")

    def fit(part: pa.Table) -> pa.Table:
        dim, h = part.column("dim")[0].as_py(), part.column("h0")[0].as_py()
        x = _unit(_matrix(part.column("vec"), dim))
        x = x[np.lexsort(x.T[::-1])]  # in an order of their own, whatever order they came in
        c = spherical_kmeans(x, max(1, min(how.branch, -(-h // how.members), len(x))), how.rounds)
        return pa.table({"for_cell": part.column("cell").slice(0, 1), "centres": pa.array([c.tobytes()], pa.binary())})

    centres = stored(sample.groupBy("cell").applyInArrow(fit, "for_cell string, centres binary"))
    reach = float(np.sqrt(2 - 2 * how.cosine)) * (1 + 1e-9) + 1e-9

    def place(part: pa.Table, own: pa.Table) -> pa.Table:
        names = ["cell", "side", "rep", "dim", "vec", "copies"]
        if not part.num_rows:
            return part.select(names)
        dim = part.column("dim")[0].as_py()
        c = np.frombuffer(own.column("centres")[0].as_py(), np.float64).reshape(-1, dim) if own.num_rows else None
        x, side = _unit(_matrix(part.column("vec"), dim)), part.column("side").to_numpy()
        if c is None:
            c = np.ones((1, dim))
        gap = np.linalg.norm(c[:, None] - c[None], axis=2)
        dots = x @ c.T
        home = dots.argmax(1)
        at = np.arange(len(x))
        near = dots[at, home][:, None] - dots <= reach * gap[home]
        near &= (np.arange(len(c))[None] <= home[:, None]) | (side == 1)[:, None]
        near[at, home] = True
        row, cell = np.nonzero(near)
        took = part.take(pa.array(row))
        paths = pa.array([f"{p}/{k}" for p, k in zip(took.column("cell").to_pylist(), cell.tolist(), strict=True)], pa.string())
        sides = np.where((side[row] == 1) | (cell != home[row]), 1, 0).astype(np.int32)
        return pa.table({"cell": paths, "side": pa.array(sides), **{n: took.column(n) for n in names[2:]}})

    salted = _salted(rows, counts.select("cell", (F.col("h") + F.col("v")).alias("n")))
    parts = salted.select("cell", "salt").distinct().join(centres, F.col("cell") == F.col("for_cell")).select("for_cell", F.col("salt").alias("for_salt"), "centres")
    return salted.groupBy("cell", "salt").cogroup(parts.groupBy("for_cell", "for_salt")).applyInArrow(place, _PLACED)


def _counts(rows: DataFrame) -> DataFrame:
    """(cell, h, v, work): home rows, visitors and products of each cell."""
    h, v = F.sum(1 - F.col("side")), F.sum("side")
    return rows.groupBy("cell").agg(h.alias("h"), v.alias("v"), (h * (h / 2 + v)).alias("work"))


def _cells(classes: DataFrame, how: Cells) -> DataFrame:
    """Each class in the cells where it is compared: its home (side 0) and those it visits (side 1)."""
    rows = stored(classes.select(F.concat_ws(":", "label", "dim").alias("cell"), F.lit(0).alias("side"), "rep", "dim", "vec", "copies"))
    done: list[DataFrame] = []
    while True:
        counts = stored(_counts(rows))
        large = counts.where(F.col("h") > how.members)
        if not large.limit(1).count():
            return _union([*done, rows])
        done.append(rows.join(large.select("cell"), "cell", "left_anti"))
        work = rows.join(large.select("cell"), "cell", "left_semi")
        below = stored(_cut(work, large, how))
        up = F.expr("left(cell, length(cell) - length(substring_index(cell, '/', -1)) - 1)")
        after = _counts(below).groupBy(up.alias("cell")).agg(F.sum("work").alias("after"))
        stands = stored(large.join(after, "cell").where(F.col("after") <= F.col("work") * how.gain).select("cell"))
        done.append(work.join(stands, "cell", "left_anti"))
        rows = below.withColumn("up", up).join(stands.withColumnRenamed("cell", "up"), "up", "left_semi").drop("up")


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _products(how: Cells):  # noqa: ANN202
    """Links in each tile of rows that come sorted by tile and side: how many each class has (kind 0), and a spanning forest (kind 1)."""

    def linked(held: list[pa.RecordBatch]) -> pa.RecordBatch | None:
        t = pa.Table.from_batches(held)
        side, dim = t.column("side").to_numpy(), t.column("dim")[0].as_py()
        alone = t.column("tile")[0].as_py().startswith("own:")
        k = int((side == 0).sum())
        if not k or (not alone and k == len(side)):
            return None
        x, rep, copies = _matrix(t.column("vec"), dim), t.column("rep").to_numpy(), t.column("copies").to_numpy()
        norm = np.linalg.norm(x, axis=1)
        lo = 0 if alone else k
        cos = (x[:k] @ x[lo:].T) / (norm[:k, None] * norm[None, lo:])
        i, j = np.nonzero(cos >= how.cosine)
        j = j + lo
        i, j = (i[i < j], j[i < j]) if alone else (i, j)
        n = (np.bincount(i, copies[j], len(x)) + np.bincount(j, copies[i], len(x))).astype(np.int64)
        trees = forest(len(x), i, j)
        i, j, has = i[trees], j[trees], np.flatnonzero(n)
        kind = np.repeat(np.array([0, 1], np.int32), [len(has), len(i)])
        return pa.RecordBatch.from_arrays([pa.array(kind), pa.array(np.concatenate((rep[has], rep[i]))), pa.array(np.concatenate((n[has], rep[j])))], ["kind", "a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            tiles = column(batch, "tile").dictionary_encode()
            code = tiles.indices.to_numpy()
            cuts = np.concatenate(([0], np.flatnonzero(code[1:] != code[:-1]) + 1, [len(code)])) if len(code) else [0]
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                part = batch.slice(lo, hi - lo)
                if held and column(held[0], "tile")[0].as_py() != column(part, "tile")[0].as_py():
                    got = linked(held)
                    held = []
                    if got is not None:
                        yield got
                held.append(part)
        if held:
            got = linked(held)
            if got is not None:
                yield got

    return run


def deduplicate(vectors: DataFrame, how: Cells = Cells()) -> DataFrame:
    """(vec_id, n_links, component_id, kept), a row for each row of vectors(vec_id, embedding, label).

    Two rows link if labels are equal, lengths are equal and the cosine in
    double precision is at least how.cosine.  Null, empty and zero vectors, and
    such with null or non-finite components, a null label or a null id, link
    with nothing: n_links 0, component_id their own id, kept.  Vectors of
    a label that are equal but for a power of two are compared once and counted
    with their number.  A group's representative is its least id.  Rows that
    repeat an id count as other vectors, each valid or not on its own.  An empty
    table gives an empty result.  Other columns are not read.
    """
    own = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("v"))
    signed = stored(_signed(own))
    valid = signed.where("vec is not null")
    classes = stored(valid.groupBy("label", "dim", "vec").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies")).select("rep", "label", "dim", "vec", "copies"))
    rows = _cells(classes, how)
    counts = _counts(rows).select("cell", *[F.ceil(F.col(c) / how.block).cast("int").alias(b) for c, b in (("h", "b0"), ("v", "b1"))])
    rows = stored(rows.join(counts, "cell"))
    home = rows.where("side = 0").withColumn("i", F.pmod(F.xxhash64("rep"), F.col("b0")).cast("int"))
    visit = rows.where("side = 1 and b0 > 0").withColumn("j", F.pmod(F.xxhash64("rep"), F.col("b1")).cast("int"))
    tile = lambda kind, i, j: F.concat_ws(":", F.lit(kind), "cell", i, j)
    cols = ["tile", "side", "rep", "vec", "dim", "copies"]
    zero, one = F.lit(0), F.lit(1)
    own_tile = home.withColumn("tile", tile("own", F.col("i"), F.col("i"))).withColumn("side", zero)
    upper = home.withColumn("k", F.explode(F.when(F.col("i") + 1 <= F.col("b0") - 1, F.sequence(F.col("i") + 1, F.col("b0") - 1)))).withColumn("tile", tile("h", F.col("i"), F.col("k"))).withColumn("side", zero)
    lower = home.withColumn("k", F.explode(F.when(F.col("i") >= 1, F.sequence(zero, F.col("i") - 1)))).withColumn("tile", tile("h", F.col("k"), F.col("i"))).withColumn("side", one)
    met = home.where("b1 > 0").withColumn("k", F.explode(F.sequence(zero, F.col("b1") - 1))).withColumn("tile", tile("v", F.col("i"), F.col("k"))).withColumn("side", zero)
    guest = visit.withColumn("k", F.explode(F.sequence(zero, F.col("b0") - 1))).withColumn("tile", tile("v", F.col("k"), F.col("j"))).withColumn("side", one)
    tiles = own_tile.select(*cols).union(upper.select(*cols)).union(lower.select(*cols)).union(met.select(*cols)).union(guest.select(*cols))
    found = stored(tiles.repartition("tile").sortWithinPartitions("tile", "side").mapInArrow(_products(how), "kind int, a long, b long"))
    links = found.where("kind = 0").groupBy("a").agg(F.sum("b").alias("n"))
    comp = components(found.where("kind = 1").select("a", "b"))
    by_class = classes.join(links, F.col("rep") == F.col("a"), "left").join(comp, F.col("rep") == F.col("id"), "left").select("label", "dim", "vec", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component_id", "rep").alias("component_id"))
    good = valid.join(by_class, ["label", "dim", "vec"]).select("vec_id", "n_links", "component_id")
    bad = signed.where("vec is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    drop(rows)
    return good.union(bad).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
