"""Greedy first-fit clustering by cosine in key order, with at most ``most`` representatives, or any number.

The order is the semantics, yet only unmatched vectors need it: of the vectors that no known representative matches, the
``chunk`` smallest keys come to the driver, are folded in order and give new representatives, against which the others are
then matched in parallel; and so on. Only one round's representatives, at most ``chunk``, are held at a time, for what is
left has been compared with all before. Every round settles the ``chunk`` smallest keys at least.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import materialize


def first_fit(vectors: DataFrame, threshold: float, most: int | None = 512, chunk: int = 4096) -> DataFrame:
    """``key, leader`` for (key, vec array<double>, or bytes of doubles): the first representative in order of creation within the threshold, else itself.

    Keys are unique; a zero vector leads itself. Beyond ``most`` representatives an unmatched vector leads itself; None: no bound.
    """
    kind = vectors.schema["key"].dataType.simpleString()

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Vectors as bytes of doubles, once for all rounds; a zero vector leads itself."""
        for pdf in batches:
            vecs = [np.asarray(v, np.float64) if not isinstance(v, (bytes, bytearray)) else np.frombuffer(v, np.float64) for v in pdf["vec"]]
            yield pd.DataFrame({"key": pdf["key"], "vec": [v.tobytes() for v in vecs], "zero": [not v.any() for v in vecs]})

    def stack(vecs: pd.Series) -> np.ndarray:
        return np.frombuffer(b"".join(vecs), np.float64).reshape(len(vecs), -1)

    n, names, known = 0, [], np.zeros((0, 0))  # all representatives' number; keys and unit vectors of the last round's

    def unit(m: np.ndarray) -> np.ndarray:
        n = np.linalg.norm(m, axis=1, keepdims=True)
        return np.divide(m, n, out=np.zeros_like(m), where=n > 0)

    def match(names: list, known: np.ndarray):
        def leaders(vecs: np.ndarray) -> list:
            hit = unit(vecs) @ known.T >= threshold - 1e-12 if len(names) else np.zeros((len(vecs), 1), bool)
            return [names[i] if ok else None for i, ok in zip(hit.argmax(1), hit.any(1))]

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for at in range(0, len(pdf), 1024):
                    part = pdf.iloc[at : at + 1024]
                    yield part.assign(leader=pd.Series(leaders(stack(part["vec"])), part.index, object))

        return run

    packed = materialize(vectors.select("key", "vec").mapInPandas(pack, f"key {kind}, vec binary, zero boolean"))
    rest = packed.where("not zero").select("key", "vec")
    done: list[DataFrame] = [packed.where("zero").selectExpr("key", "key as leader")]
    while True:
        labelled = materialize(rest.mapInPandas(match(names, known), f"key {kind}, vec binary, leader {kind}"))
        done.append(labelled.where("leader is not null").select("key", "leader"))
        rest = labelled.where("leader is null").select("key", "vec")
        head = rest.orderBy("key").limit(chunk).toPandas()
        if not len(head) or (most is not None and n >= most):
            done.append(rest.selectExpr("key", "key as leader"))
            break
        found = unit(stack(head["vec"]))
        new: list[int] = []
        for i in range(len(found)):
            if most is not None and n + len(new) >= most:
                break
            if not new or not (found[new] @ found[i] >= threshold - 1e-12).any():
                new.append(i)
        n, names, known = n + len(new), head["key"].iloc[new].tolist(), found[new]
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out


def first_fit_pairs(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """``key, leader`` of greedy first fit in order of keys where the similar pairs (a < b) are known: each key joins the first leader it resembles.

    Round by round every key without an undecided smaller neighbour is settled: it joins its smallest leader, or leads. Chains of undecided
    keys get shorter by one at least; on names a few rounds do.
    """
    both = materialize(pairs.select("a", "b").distinct())
    state = materialize(nodes.select("key").distinct().select("key", F.lit(None).cast(nodes.schema["key"].dataType).alias("leader")))
    while True:
        lower = both.join(state.select(F.col("key").alias("a"), F.col("leader").alias("la")), "a").groupBy(F.col("b").alias("key"))
        seen = lower.agg(F.count_if(F.col("la").isNull()).alias("open"), F.min(F.when(F.col("la") == F.col("a"), F.col("a"))).alias("first"))
        ready = state.join(seen, "key", "left")
        new = F.when(F.col("leader").isNotNull(), F.col("leader")).when(F.coalesce("open", F.lit(0)) == 0, F.coalesce("first", "key"))
        state = materialize(ready.select("key", new.alias("leader")))
        if state.where("leader is null").isEmpty():
            return state
