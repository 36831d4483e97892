"""Jaccard join and embedding near-dedup against all pairs."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.llm.helpers import DOCS, components, near_copies, shingles
from thicket.llm import token_group_join
from thicket.llm.cell_dedup import Cells, deduplicate
from thicket.llm.components import components as stars, forest
from thicket.llm.token_group_join import NEAR, Similarity, bitmaps, classify, folded, keep_one, opened


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], DOCS)


@pytest.mark.parametrize("sim", [Similarity(), NEAR, Similarity(n=2, percent=60), Similarity(n=3, percent=90, sketch=1 << 10, group=4)])
def test_join_equals_all_pairs(spark, sim):
    rows = near_copies()
    sets = {i: shingles(t, sim.n) for i, t in rows}
    want = components(sets, sim.percent)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in classify(frame(spark, rows), sim).collect()}
    assert got == {i: (len(sets[i]), want[i]) for i in sets}
    assert len(set(want.values())) < len(rows) - 10


def test_join_edges(spark):
    assert classify(frame(spark, [])).count() == 0
    df = frame(spark, [(None, "a b c d e"), (4, "a b c d e"), (4, "a b c d e"), (None, "q"), (5, None)]).withColumn("N", F.lit(1)).withColumn("component_id", F.lit(9))
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in classify(df).collect()), key=str)
    assert got == sorted([(None, 3, 4), (4, 3, 4), (4, 3, 4), (None, 1, None), (5, 0, 5)], key=str)


def test_keep_one(spark):
    rows = near_copies()
    want = components({i: shingles(t, 5) for i, t in rows}, 80)
    df = frame(spark, rows + rows[:3])
    kept = keep_one(df.withColumn("extra", F.lit("x")))
    assert kept.columns == [*df.columns, "extra"]
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, c in want.items() if i == c)


def test_keep_one_hangs_on_the_rows_alone(spark):
    a, b, c = "one two three four five six seven", "some other text of a few words more", "yet another one that nobody else has"
    rows = [(1, a), (1, b), (2, b), (2, c), (1, a), (None, c), (None, "no id and no like of it here at all"), (3, None), (3, None), (4, ""), (None, None)]
    want = sorted([(1, a), (1, b), (2, c), (None, "no id and no like of it here at all"), (3, None), (4, ""), (None, None)], key=str)
    df = frame(spark, rows).withColumn("_a", F.lit("clash")).withColumn("n", F.lit(1))
    for parts in (1, 3):
        assert sorted(((r.doc_id, r.text) for r in keep_one(df.repartition(parts)).collect()), key=str) == want
    assert keep_one(frame(spark, [])).count() == 0


def test_long_and_hot_texts(spark):
    long = " ".join(f"w{i % 5000}x{i}" for i in range(30000))
    near = [long + f" tail{i}" for i in range(40)] + ["the very same line"] * 60
    got = classify(frame(spark, list(enumerate(near))), Similarity(group=4)).collect()
    assert {r.component_id for r in got} == {0, 40} and max(r.n_shingles for r in got) == 29999


def test_bitmaps_never_overrate_what_is_outside():
    rng = np.random.default_rng(4)
    for n, m in ((5, 900), (900, 5), (60, 60), (1, 1)):
        a, b = (np.unique(rng.integers(0, 1 << 62, k, dtype=np.uint64)) for k in (n, m))
        b = np.unique(np.concatenate((b, a[: len(a) // 2])))
        x, y = (np.frombuffer(bitmaps(s, np.array([0, len(s)]))[0], np.uint8)[None] for s in (a, b))
        w = min(x.shape[1], y.shape[1])
        outside = np.bitwise_count(folded(x, w) & ~folded(y, w)).sum()
        assert 8 * x.shape[1] >= 2 * len(a) and outside <= len(set(a.tolist()) - set(b.tolist()))


def test_unions_over_batches():
    rng = np.random.default_rng(2)
    gid = np.sort(rng.integers(0, 40, 300))
    rows = [{"gid": int(g), "first": int(g) % 3, "n": int(rng.integers(1, 99)), "bits": rng.integers(0, 256, 8 << (int(g) % 3), dtype=np.uint8).tobytes()} for g in gid]
    cuts = [0, 1, 7, 7, 120, 300]
    schema = pa.schema([("gid", pa.int64()), ("first", pa.int64()), ("n", pa.int64()), ("bits", pa.binary())])
    got = [r for b in token_group_join._unions(iter([pa.RecordBatch.from_pylist(rows[a:z], schema) for a, z in zip(cuts, cuts[1:], strict=False)])) for r in b.to_pylist()]
    assert [r["gid"] for r in got] == sorted(set(gid.tolist()))
    for r in got:
        own = [x for x in rows if x["gid"] == r["gid"]]
        want = np.bitwise_or.reduce([np.frombuffer(x["bits"], np.uint8) for x in own])
        assert (r["members"], r["low"], r["bits"], r["first"]) == (len(own), min(x["n"] for x in own), want.tobytes(), own[0]["first"])


def test_union_bound_loses_nothing():
    rng = np.random.default_rng(0)
    sim = Similarity(n=1, percent=80)
    base = np.unique(rng.integers(0, 1 << 60, 50, dtype=np.uint64))
    make = lambda: np.unique(np.concatenate((rng.choice(base, 46, replace=False), rng.integers(0, 1 << 60, 3, dtype=np.uint64))))
    a, b = [make() for _ in range(20)], [make() for _ in range(20)] + [np.unique(rng.integers(0, 1 << 60, 40, dtype=np.uint64))]
    both = [frozenset(x.tolist()) for x in a + b]
    cross = {(i, j) for i in range(20) for j in range(20, 41) if 100 * len(both[i] & both[j]) >= 80 * len(both[i] | both[j])}
    got = opened(a, b, sim)
    assert set(got) <= cross
    parent = list(range(41))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for x, y in got:
        parent[root(x)] = root(y)
    assert all(root(x) == root(y) for x, y in cross)


def test_stars(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 90), (90, 95), (7, 7), (None, 3)] + [(200, x) for x in range(201, 260)]
    got = {r.id: r.component_id for r in stars(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 90: 90, 95: 90, 100: 90, **{x: 200 for x in range(200, 260)}}
    assert stars(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("how", [Cells(), Cells(members=20, block=16, sample=100), Cells(members=10, branch=3, gain=9.0, block=7, sample=40)])
def test_cells_equal_all_pairs(spark, how):
    rng = np.random.default_rng(1)
    centre = rng.normal(size=(12, 16))
    x = [centre[i % 12] + rng.normal(size=16) * rng.choice([0.02, 0.1, 0.5]) for i in range(300)]
    x += [x[0]] * 30 + [x[1] * 2]
    rows = [(i, v.tolist(), i % 2) for i, v in enumerate(x)]
    n = len(rows)
    rows += [(n, None, 0), (n + 1, [0.0] * 16, 0), (n + 2, [float("nan")] * 16, 0), (n + 3, [1.0, None], 1), (n + 4, x[0].tolist(), None), (n + 5, [], 0), (n + 6, [1.0] * 3, 0), (n + 7, [float("inf")] + [1.0] * 15, 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    m = np.array(x)
    size = np.linalg.norm(m, axis=1)
    cos = (m @ m.T) / np.outer(size, size)
    label = np.arange(n) % 2
    link = (cos >= 0.98) & (label[:, None] == label[None])
    np.fill_diagonal(link, False)
    want = {i: i for i in range(n)}
    for _ in range(n):
        new = {i: min([want[i], *(want[j] for j in np.flatnonzero(link[i]))]) for i in range(n)}
        if new == want:
            break
        want = new
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in deduplicate(df, how).collect()}
    assert len(got) == len(rows)
    for i in range(n):
        assert got[i] == (int(link[i].sum()), want[i], want[i] == i)
    for i in range(n, n + 8):
        assert got[i] == (0, i, True)


def test_cells_edges(spark):
    schema = "vec_id long, embedding array<float>, label int, cell int"
    assert deduplicate(spark.createDataFrame([], schema)).count() == 0
    got = deduplicate(spark.createDataFrame([(1, [1.0], 0, 5), (1, [1.0], 0, 5), (None, [1.0], 0, 5)], schema)).collect()
    assert sorted((r.vec_id or -1, r.n_links) for r in got) == [(-1, 0), (1, 1), (1, 1)]


def test_cells_give_a_row_for_each_vector(spark):
    x = [float(i % 5) + 1 for i in range(8)]
    rows = [(1, x, 0), (1, None, 0), (1, x, None), (2, [0.0] * 8, 0), (2, [v * 1e200 for v in x], 0), (3, [v * 1e-200 for v in x], 0), (4, [v * 5e-324 for v in x], 0), (None, x, 0), (5, [1e308] * 8, 1), (6, [1e308] * 7 + [0.0], 1)]
    got = sorted(((-1 if r.vec_id is None else r.vec_id, r.n_links, r.component_id) for r in deduplicate(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()), key=str)
    assert len(got) == len(rows)
    assert [r for r in got if r[0] in (1, 2, 3, 4)] == [(1, 0, 1), (1, 0, 1), (1, 3, 1), (2, 0, 2), (2, 3, 1), (3, 3, 1), (4, 3, 1)]
    assert (5, 0, 5) in got and (6, 0, 6) in got and (-1, 0, None) in got


def test_forest_is_that_of_links_taken_in_order():
    rng = np.random.default_rng(8)
    for n, m in ((1, 0), (5, 3), (40, 30), (40, 400), (300, 280)):
        a, b = rng.integers(0, n, m), rng.integers(0, n, m)
        parent, want = list(range(n)), []
        for i, (x, y) in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
            while parent[x] != x:
                x = parent[x]
            while parent[y] != y:
                y = parent[y]
            if x != y:
                parent[max(x, y)] = min(x, y)
                want.append(i)
        assert forest(n, a, b).tolist() == want
