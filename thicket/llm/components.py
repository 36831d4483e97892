"""Connected components of links between ids, by alternating star contractions."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thicket.scratch import drop, stored


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Numbers of the links (a[i], b[i]) that join two trees, of n nodes, when taken in order.

    All trees at once, round by round, take the first link that leaves them; as
    links differ by number, these are the ones that taking all in order would keep.
    """
    home, keep = np.arange(n), np.zeros(len(a), bool)
    left = np.arange(len(a))
    while True:
        x, y = home[a[left]], home[b[left]]
        out = x != y
        left, x, y = left[out], x[out], y[out]
        if not len(left):
            return np.flatnonzero(keep)
        first = np.full(n, len(a))
        np.minimum.at(first, x, left)
        np.minimum.at(first, y, left)
        took = np.unique(first[first < len(a)])
        keep[took] = True
        x, y = home[a[took]], home[b[took]]
        while True:  # trees that meet get the least number among them
            low = np.minimum(home[x], home[y])
            was = home.copy()
            np.minimum.at(home, home[x], low)
            np.minimum.at(home, home[y], low)
            while (home != home[home]).any():
                home = home[home]
            if (home == was).all():
                break


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(id, component_id) for every id in links(a, b); component_id is the smallest id reachable.

    Each round joins every node's larger neighbours to its least neighbour, then
    its smaller ones (large star, small star): joins and map-side combined
    minima only, so that a node with a third of all links needs no list of them.
    Minima are tables of their own, as only joins of tables can be split where a
    node is hot.  The rounds, logarithmic in practice, end when every node hangs
    on one that hangs on none.  Null ids and self links are ignored; no links
    give an empty table.
    """
    edges = stored(links.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    for _ in range(rounds):
        n, t = edges.select(F.count("*"), F.count_distinct("u")).first()
        if n == t and not edges.join(edges.select(F.col("u").alias("w")), F.col("v") == F.col("w"), "left_semi").limit(1).count():
            return edges.select(F.col("u").alias("id"), F.col("v").alias("component_id")).union(edges.select(F.col("v"), F.col("v")).distinct())
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = stored(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = stored(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        low = stored(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").where("u != v").distinct()
        after = stored(small)
        for df in (edges, least, large, low):
            drop(df)
        edges = after
    raise RuntimeError(f"components did not settle in {rounds} rounds")
