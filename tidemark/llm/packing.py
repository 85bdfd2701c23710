"""Filling of fixed-capacity containers: conflict-constrained best fit over residual-ordered bins.

Items are spread by a hash of their key over groups of a bounded size, so that neither a source nor a group of copies gathers in one task;
each group is packed on its own, largest items first, and wastes at most about its last container. Open bins are ordered by
their residual room (one bucket per residual and a bitmap of the buckets in use); the successor search starts at the
item's size and goes on to larger residuals until it meets the tightest compatible bin. A bin carries a bitmap of its
sources and the set of its duplicate clusters: a bin that holds a copy of the item is never compatible; among equally tight
bins one without the item's source is preferred.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.tokens import count_tokens

CAPACITY = 2048
#: Items of one group; at about 300 tokens each it fills some 3,000 containers.
GROUP = 20_000


def pack(sizes: list[int], sources: list[int], clusters: list[int], capacity: int = CAPACITY) -> tuple[list[int], list[int]]:
    """Bin of every item (given largest first, copies next to each other) and the bins' residual rooms.

    Sizes are at most ``capacity``; items of size 0 are placed too.
    """
    buckets: list[list[int]] = [[] for _ in range(capacity + 1)]
    used = 0  # bit r: some open bin has the residual r
    room: list[int] = []
    bits: list[int] = []  # bitmap of a bin's sources
    held: list[set[int]] = []  # a bin's duplicate clusters
    source_bit: dict[int, int] = {}
    aside: list[int] = []  # bins with the cluster now being placed; none of its next copies may use them
    now: int | None = None
    out: list[int] = []

    def put(b: int) -> None:
        nonlocal used
        buckets[room[b]].append(b)
        used |= 1 << room[b]

    for size, source, cluster in zip(sizes, sources, clusters):
        if cluster != now:
            for b in aside:
                put(b)
            aside, now = [], cluster
        bit = source_bit.setdefault(source, 1 << len(source_bit))
        chosen, r = -1, size
        while chosen < 0:
            rest = used >> r
            if not rest:
                break
            r += (rest & -rest).bit_length() - 1
            second = -1
            for k in range(len(buckets[r]) - 1, -1, -1):
                b = buckets[r][k]
                if cluster not in held[b]:
                    if not bits[b] & bit:
                        chosen = k
                        break
                    second = k if second < 0 else second
            if chosen < 0:
                chosen = second
            if chosen < 0:
                r += 1
        if chosen < 0:
            room.append(capacity)
            bits.append(0)
            held.append(set())
            b = len(room) - 1
        else:
            bucket = buckets[r]
            bucket[chosen], bucket[-1] = bucket[-1], bucket[chosen]
            b = bucket.pop()
            if not bucket:
                used &= ~(1 << r)
        room[b] -= size
        bits[b] |= bit
        if size:
            held[b].add(cluster)
            aside.append(b)
        else:
            put(b)
        out.append(b)
    return out, room


def pack_items(items: DataFrame, capacity: int = CAPACITY, group: int = GROUP, n: int | None = None) -> DataFrame:
    """``key, piece, tok_start, size, container_id, container_used`` for items ``key, size, source bigint, cluster bigint``.

    An item of more than ``capacity`` becomes full pieces and a last, shorter one; every other item is one piece. Copies (one
    cluster) never share a container, unless they are empty. Null sizes count as 0. ``n``: the number of items where
    it is known more cheaply than by counting them. An empty input gives an empty result.
    """
    n = items.count() if n is None else n
    groups = max(1, -(-n // group))
    spread = items.withColumn("g", F.pmod(F.xxhash64("key"), F.lit(groups)).cast("int")).repartition(groups, "g")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = [p for p in batches if len(p)]
        if not parts:
            return
        for g, pdf in pd.concat(parts, ignore_index=True).groupby("g"):
            rows = []
            for key, size, source, cluster in zip(pdf["key"], pdf["size"].fillna(0).astype(int), pdf["source"].fillna(0), pdf["cluster"].fillna(0)):
                pieces = max(1, -(-size // capacity))
                for p in range(pieces):
                    # Pieces of one text are no copies of each other.
                    rows.append((key, p, p * capacity, min(capacity, size - p * capacity), int(source), int(cluster) if p == pieces - 1 else -1 - len(rows)))
            rows.sort(key=lambda x: (-x[3], x[5], x[0], x[1]))
            bins, room = pack([x[3] for x in rows], [x[4] for x in rows], [x[5] for x in rows], capacity)
            out = pd.DataFrame([x[:4] for x in rows], columns=["key", "piece", "tok_start", "size"])
            out["container_id"] = int(g) * (1 << 32) + np.array(bins, np.int64)
            out["container_used"] = capacity - np.array(room, np.int64)[bins]
            yield out

    kind = items.schema["key"].dataType.simpleString()
    return spread.mapInPandas(run, f"key {kind}, piece int, tok_start int, size int, container_id bigint, container_used int")


def pack_documents(docs: DataFrame, key: str, text: str, source: str, capacity: int = CAPACITY, group: int = GROUP) -> DataFrame:
    """Documents in containers of ``capacity`` tokens; a copy is a document with the same text. Null and empty texts have size 0."""
    keep = [F.col(key).alias("key"), F.xxhash64(F.col(source)).alias("source"), F.xxhash64(F.col(text)).alias("cluster")]
    sized = count_tokens(docs, keep, F.col(text))
    return pack_items(sized, capacity, group, docs.count()).withColumnRenamed("key", key)
