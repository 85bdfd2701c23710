"""Consolidating pairwise matches into groups: hierarchical union-find over bounded partitions.

Level k holds a graph of links. Its links are range-partitioned into partitions of about ``bound`` links; a union-find within
each partition keeps only the spanning forest, as one (node, local root) row per node. A node that occurs in several
partitions links their local roots; these root-to-root links are the smaller graph of level k + 1. The last level fits one
bounded partition. A chain of equi-joins carries the roots down to all nodes.

So that every level shrinks whatever the links look like, a node's links to the neighbour of the least priority (a hash of the
node, drawn anew for every level) lie together: each link is sorted by the node that one of its ends points at, and only
the stars at the edges of partitions are cut. A chain loses a third of its links in expectation this way even if every link had a
partition of its own; where names follow the chain, neighbours lie in one partition anyway and it collapses at once. Range
partitions also cut a node with a third of all links into several bounded tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.session import materialize

#: Links that one task's union-find holds, about; some 500 bytes each.
BOUND = 50_000
#: Levels after which something must be wrong: each leaves four fifths of its links at most, in expectation.
LEVELS = 120


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union-find over links of strings: every node with the smallest node (in byte order) of its local component."""
    names, codes = np.unique(np.concatenate([a, b]).astype(object), return_inverse=True)
    order = np.array(sorted(range(len(names)), key=lambda i: names[i].encode("utf-8", "surrogatepass")), np.int64)
    rank = np.empty(len(names), np.int64)
    rank[order] = np.arange(len(names))
    codes = rank[codes]
    parent = list(range(len(names)))
    for x, y in zip(codes[: len(a)].tolist(), codes[len(a) :].tolist()):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        while parent[y] != y:
            parent[y] = parent[parent[y]]
            y = parent[y]
        if x < y:
            parent[y] = x
        elif y < x:
            parent[x] = y
    for i in range(len(parent)):  # a parent is smaller than its child, so one ascending pass reaches every root
        parent[i] = parent[parent[i]]
    names = names[order]
    return names, names[np.array(parent, np.int64)] if len(names) else names


def _forests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    parts = [pdf for pdf in batches if len(pdf)]
    if parts:
        links = pd.concat(parts, ignore_index=True)
        node, root = forest(links["a"].to_numpy(object), links["b"].to_numpy(object))
        yield pd.DataFrame({"node": node, "root": root})


def _keyed(links: DataFrame, level: int) -> DataFrame:
    """The links with ``key``: the node that one end points at, its neighbour of the least priority at this level."""
    both = links.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(links.select(F.col("b").alias("u"), F.col("a").alias("v")))
    priority = lambda c: F.struct(F.xxhash64(c, F.lit(level)).alias("h"), F.col(c).alias("n"))
    least = both.groupBy("u").agg(F.min(priority("v")).alias("p"))
    least = least.select("u", F.least(F.col("p"), priority("u").alias("p"))["n"].alias("m"))
    ends = links.join(least.select(F.col("u").alias("a"), F.col("m").alias("ma")), "a").join(least.select(F.col("u").alias("b"), F.col("m").alias("mb")), "b")
    return ends.select("a", "b", F.when(F.col("ma") == F.col("b"), F.col("b")).when(F.col("mb") == F.col("a"), F.col("a")).otherwise(F.col("ma")).alias("key"))


def connected_components(pairs: DataFrame, a: Column, b: Column, bound: int = BOUND, sizes: list[int] | None = None) -> DataFrame:
    """``node, group``: each node with at least one link and the smallest node of its component.

    Links with a null side and links of a node with itself link nothing; repeated links and either order count once. Nodes
    are strings. An empty input gives an empty result. Other columns of ``pairs`` are ignored. ``sizes``, where given, gets the
    number of links of every level.
    """
    a, b = a.cast("string"), b.cast("string")
    links = pairs.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).where(a.isNotNull() & b.isNotNull() & (a != b)).distinct()
    least_parts = pairs.sparkSession.sparkContext.defaultParallelism  # of the first level: every input has its forests merged
    levels: list[DataFrame] = []
    while True:
        links = materialize(links)
        n = links.count()
        if levels and not n:
            break
        if sizes is not None:
            sizes.append(n)
        if len(levels) >= LEVELS:
            raise RuntimeError(f"no end of the levels: {n} links are left")
        parts = max(-(-n // bound), 1 if levels else least_parts)
        if parts == 1:
            levels.append(links.coalesce(1).mapInPandas(_forests, "node string, root string"))
            break
        keyed = materialize(_keyed(links, len(levels)))  # the sampling for the ranges and the exchange read it
        stars = materialize(keyed.repartitionByRange(parts, "key", "a", "b").select("a", "b").mapInPandas(_forests, "node string, root string"))
        nearest = stars.groupBy("node").agg(F.min("root").alias("root"), F.max("root").alias("other"))
        levels.append(nearest.select("node", "root"))
        shared = nearest.where("root != other").select("node", F.col("root").alias("least_root"))
        links = stars.join(shared, "node").where("root != least_root").select(F.col("least_root").alias("a"), F.col("root").alias("b")).distinct()
    out = levels[0].select("node", F.col("root").alias("group"))
    for level in levels[1:]:
        up = level.select(F.col("node").alias("group"), F.col("root").alias("higher"))
        out = out.join(up, "group", "left").select("node", F.coalesce("higher", "group").alias("group"))
    return out
