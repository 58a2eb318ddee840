"""Connected components of a table of links."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from tidemark.plans.checkpoints import drop_stable, stable


def tree(close: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """(row or column, smallest number that the links in ``close`` reach) for the numbered rows and columns with a link: a tree instead of all links."""
    high = np.iinfo(np.int64).max
    a, b = left.copy(), right.copy()
    while True:
        b2 = np.minimum(b, np.where(close, a[:, None], high).min(axis=0))
        a2 = np.minimum(a, np.where(close, b2[None, :], high).min(axis=1))
        if (a2 == a).all() and (b2 == b).all():
            both = np.stack([np.concatenate([left, right]), np.concatenate([a, b])], axis=1)
            return both[both[:, 0] != both[:, 1]]
        a, b = a2, b2


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def connected(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root) for every node of a link: ``root`` is the smallest node that links reach.

    Large-star and small-star rounds: first every larger neighbour, then every smaller one is hung on the smallest known
    neighbour, until nothing changes; the number of rounds grows with the logarithm of the longest chain. Minima are combined
    before they are shuffled and joined back, so a node with very many links is no task of its own. Each round is a table
    in the shared folder; only its row count and checksum reach the driver.
    """
    edges = stable(links.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).filter("a <> b").distinct())
    mark = _mark(edges)
    while mark[0]:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        hung = large.join(low, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        after = stable(hung.unionByName(low.select("a", F.col("m").alias("b"))).filter("a <> b").distinct())
        seen, mark = mark, _mark(after)
        drop_stable(edges)
        edges = after
        if mark == seen:
            break
    roots = edges.groupBy("a").agg(F.min("b").alias("b"))
    return roots.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        roots.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
