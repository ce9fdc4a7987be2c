"""Connected components of links, as rounds of joins (large star, small star)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, written


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, component: for every node of a link that isn't the smallest of its component, that smallest node.

    Each round hangs the larger neighbours of a node, then the node itself, on its smallest neighbour, and is written
    to the shared folder, where it replaces the one before; it ends when a round changes nothing. Every step is a grouping with partial minima and
    an equi-join, so that a node with very many links is split like any other skewed key. Links from a node to itself
    and repeated links are dropped, links with a null end too; no links give no rows.
    """
    star = written(links.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).distinct())
    seen = None
    while (now := star.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()) != seen:
        seen = now
        both = star.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionAll(star.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        root = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(root, "hi").where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo")).unionAll(root.select("hi", F.col("m").alias("lo")))
        star, before = written(small.distinct()), star
        discard(before)
    return star.select(F.col("hi").alias("node"), F.col("lo").alias("component"))


class Forest:
    """Smallest member by component of the items 0..n-1 as links come in, in whole arrays."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def link(self, i: np.ndarray, j: np.ndarray) -> None:
        while True:
            a, b = self.root[i], self.root[j]
            apart = a != b
            if not apart.any():
                return
            i, j = i[apart], j[apart]
            np.minimum.at(self.root, np.maximum(a[apart], b[apart]), np.minimum(a[apart], b[apart]))
            while ((up := self.root[self.root]) != self.root).any():
                self.root = up
