"""k most similar vectors of every vector: a hash-prefix forest (LSH forest) over range-partitioned sorted arrays of hash strings.

Every tree hashes each distinct vector, centred on the mean of all, to a string of hyperplane signs. The strings of a tree form
a sorted array, cut into ranges that one task holds each, with halo rows of the ranges beside it. The vectors that share a
prefix with a vector's string are an interval around it in the array.

Descent: in every tree, the number of vectors that share a prefix of each length with a vector, from the whole string down to
the length at which there are enough, is read off the sorted array. Synchronous ascent: these numbers are added up over the trees,
and the greatest prefix length at which all trees together hold ``candidates`` vectors is the vector's level; it differs from
vector to vector with the density around it. Scan: the intervals of that prefix length are scored where they lie, and each
vector's best few of every tree are merged.

Equal vectors are one point of the forest, so that a vector shared by a third of all rows is handled once; its events are
merged in by their smallest ids afterwards. Points with equal strings are spread by a hash of their keys in the string's
last places, so that many near-equal points can't fill one range.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tidemark.session import materialize

#: Trees, length of a hash string, candidates of a vector in all trees together, seed of the hyperplanes.
TREES, BITS, CANDIDATES, SEED = 10, 48, 4096, 7
#: Points of a sorted array that one task holds, about.
TASK_ROWS = 100_000
#: Points by whose hash strings the ranges are set, at most about twice as many (a sample by a hash of the key).
SAMPLE = 200_000
_TIE = 64 - BITS
#: Stands for a cosine where there is no candidate.
NONE = -2.0


def usable(vector: Column, dim: int) -> Column:
    """True for arrays of ``dim`` finite values that are not all zero."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & (F.size(vector) == dim) & F.coalesce(~bad, F.lit(False)) & F.exists(vector, lambda x: x != 0)


def _units(raw: pd.Series) -> np.ndarray:
    x = np.frombuffer(b"".join(raw), np.float32).reshape(len(raw), -1).astype(np.float64)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _strings(unit: np.ndarray, ids: np.ndarray, mean: np.ndarray, planes: np.ndarray) -> np.ndarray:
    """Sortable 64-bit keys: BITS signs, then a hash of the id that spreads equal strings."""
    bits = ((unit - mean) @ planes > 0).astype(np.uint64)
    weights = np.left_shift(np.uint64(1), np.arange(63, _TIE - 1, -1, dtype=np.uint64))
    tie = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - _TIE)
    return ((bits * weights).sum(axis=1, dtype=np.uint64) | tie) ^ np.uint64(1 << 63)


def _levels(keys: np.ndarray, own: slice, most: int) -> np.ndarray:
    """For the own rows of a sorted array, the number of rows that share a prefix of each length 0..BITS, at most ``most``."""
    n = len(keys)
    out = np.full((own.stop - own.start, BITS + 1), min(most, n), np.uint16)
    for x in range(BITS, -1, -1):
        group = np.zeros(n, np.int64)
        if x:
            at = keys >> np.uint64(64 - x)
            np.cumsum(at[1:] != at[:-1], out=group[1:])
        out[:, x] = np.minimum(np.bincount(group)[group[own]], most)
        if out[:, x].min(initial=most) >= most:
            out[:, :x] = most
            break
    return out


def _interval(keys: np.ndarray, level: np.ndarray, own: slice, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last (exclusive) row of the interval that shares the first ``level`` places with each own row, at most ``reach`` rows away."""
    at = np.arange(own.start, own.stop)
    low, high = np.zeros(len(at), np.int64), np.full(len(at), len(keys), np.int64)
    for x in np.unique(level):
        mine = np.flatnonzero(level == x)
        if x:
            cut = np.uint64(64 - int(x))
            prefix = keys[at[mine]] >> cut
            low[mine] = np.searchsorted(keys, prefix << cut, "left")
            high[mine] = np.searchsorted(keys, (prefix << cut) | ((np.uint64(1) << cut) - np.uint64(1)), "right")
    return np.maximum(low, at - reach), np.minimum(high, at + reach + 1)


def _scan(keys: np.ndarray, ids: np.ndarray, unit: np.ndarray, own: slice, low: np.ndarray, high: np.ndarray, k: int, block: int = 128):
    """The k greatest cosines of every own row within its interval, block by block; single precision preselects, double decides."""
    small = unit.astype(np.float32)
    for a in range(own.start, own.stop, block):
        b = min(a + block, own.stop)
        lo, hi = low[a - own.start : b - own.start], high[a - own.start : b - own.start]
        left, right = int(lo.min()), int(hi.max())
        column = np.arange(left, right)
        scores = small[a:b] @ small[left:right].T
        scores[(column < lo[:, None]) | (column >= hi[:, None]) | (column == np.arange(a, b)[:, None])] = NONE
        m = min(k + 3, right - left)
        top = np.argpartition(scores, right - left - m, axis=1)[:, right - left - m :] if m < right - left else np.tile(np.arange(m), (b - a, 1))
        real = np.take_along_axis(scores, top, 1) > NONE + 0.5
        exact = np.where(real, np.einsum("ij,ikj->ik", unit[a:b], unit[left + top]), NONE)
        order = np.argsort(-exact, axis=1, kind="stable")[:, :k]
        others = np.full((b - a, k), 0, np.int64)
        cosines = np.full((b - a, k), NONE)
        others[:, : order.shape[1]] = ids[np.take_along_axis(top, order, 1) + left]
        cosines[:, : order.shape[1]] = np.take_along_axis(exact, order, 1)
        yield pd.DataFrame({"point": ids[a:b], "others": [r.tobytes() for r in others], "cosines": [r.tobytes() for r in cosines]})


class _Forest:
    """The trees over ``points`` (point, raw, ...): rows sent to their ranges, with halo copies beside the ranges' edges."""

    def __init__(self, points: DataFrame, n: int, mean: np.ndarray, trees: int, candidates: int, task_rows: int):
        self.mean, self.planes = mean, np.random.default_rng(SEED).standard_normal((trees, len(mean), BITS))
        self.trees, self.ranges = trees, max(1, -(-n // task_rows))
        edges = np.zeros((3, trees, 0), np.uint64)  # the ranges' first keys, and where the halo before and behind each ends
        if self.ranges > 1:
            share = max(1, n // SAMPLE)
            halo = max(candidates, 4 * share) / n
            inner = np.arange(1, self.ranges) / self.ranges
            wanted = np.clip(np.concatenate([inner, inner - halo, inner + halo]), 0, 1).tolist()
            hashed = self.rows(points.where(F.pmod(F.xxhash64("point"), F.lit(share)) == 0).select("point", "raw"), [], sample=True)
            got = hashed.groupBy("tree").agg(F.percentile_approx("key", wanted, 100_000).alias("q")).collect()  # a row for each tree
            edges = np.zeros((3, trees, self.ranges - 1), np.uint64)
            for r in got:
                edges[:, r["tree"]] = np.array(r["q"], np.int64).view(np.uint64).reshape(3, -1) ^ np.uint64(1 << 63)
        self.edges = points.sparkSession.sparkContext.broadcast(edges)  # 24 bytes for each range of TASK_ROWS points

    def rows(self, points: DataFrame, more: list[str], sample: bool = False) -> DataFrame:
        """``tree, part, key, own, point`` and the columns ``more`` of every point in every tree."""
        mean, planes, ranges = self.mean, self.planes, self.ranges
        edges = None if sample else self.edges
        schema = "tree int, part int, key bigint, own boolean, point bigint" + "".join(f", {c} {points.schema[c].dataType.simpleString()}" for c in more)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                if not len(pdf):
                    continue
                unit, ids = _units(pdf["raw"]), pdf["point"].to_numpy(np.int64)
                for t in range(len(planes)):
                    key = _strings(unit, ids, mean, planes[t])
                    sent = [(np.arange(len(ids)), np.zeros(len(ids), np.int64), True)]
                    if edges is not None and ranges > 1:
                        first, before, behind = (edges.value[i][t] for i in range(3))
                        mine = np.searchsorted(first, key ^ np.uint64(1 << 63), "right")
                        sent = [(sent[0][0], mine, True)]
                        k = key ^ np.uint64(1 << 63)
                        up = np.flatnonzero((mine < ranges - 1) & (k >= before[np.minimum(mine, ranges - 2)]))
                        down = np.flatnonzero((mine > 0) & (k <= behind[np.maximum(mine - 1, 0)]))
                        sent += [(up, mine[up] + 1, False), (down, mine[down] - 1, False)]
                    for at, where, own in sent:
                        if len(at):
                            yield pd.DataFrame({"tree": np.int32(t), "part": (t * ranges + where).astype(np.int32), "key": key[at].view(np.int64), "own": own, "point": ids[at], **{c: pdf[c].to_numpy()[at] for c in more}})

        return points.mapInPandas(run, schema)

    def arrays(self, points: DataFrame, more: list[str]) -> DataFrame:
        """The rows of every range in one task."""
        return self.rows(points, more).drop("tree").repartitionById(self.trees * self.ranges, F.col("part"))


def _sorted(batches: Iterator[pd.DataFrame]) -> pd.DataFrame | None:
    """The rows of a task's range in order of their strings, with unsigned keys."""
    parts = [p for p in batches if len(p)]
    if not parts:
        return None
    pdf = pd.concat(parts, ignore_index=True)
    pdf["key"] = pdf["key"].to_numpy(np.int64).view(np.uint64) ^ np.uint64(1 << 63)
    return pdf.sort_values(["part", "key", "point"], ignore_index=True)


def _own(pdf: pd.DataFrame) -> slice:
    at = np.flatnonzero(pdf["own"].to_numpy(bool))
    return slice(int(at[0]), int(at[-1]) + 1) if len(at) else slice(0, 0)


def _descend(candidates: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pdf = _sorted(batches)
        for _, part in pdf.groupby("part") if pdf is not None else ():
            own = _own(part)
            counts = _levels(part["key"].to_numpy(np.uint64), own, candidates)
            yield pd.DataFrame({"point": part["point"].to_numpy()[own], "counts": [c.tobytes() for c in counts]})

    return run


def _by_point(trees: int, use):
    """Applies ``use`` to the rows of a sorted partition in whole points, each of which has one row from every tree."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for pdf in batches:
            pdf = pdf if rest is None else pd.concat([rest, pdf], ignore_index=True)
            whole = len(pdf) // trees * trees
            rest = pdf.iloc[whole:]
            if whole:
                yield use(pdf.iloc[:whole])

    return run


def _ascend(trees: int, candidates: int):
    """A point's level: its trees' counts added up, the greatest length with enough."""

    def level(pdf: pd.DataFrame) -> pd.DataFrame:
        c = np.frombuffer(b"".join(pdf["counts"]), np.uint16).reshape(-1, trees, BITS + 1).sum(1, dtype=np.int64) - trees
        enough = c[:, ::-1] >= candidates
        return pd.DataFrame({"point": pdf["point"].to_numpy()[::trees], "level": np.where(enough.any(1), BITS - enough.argmax(1), 0).astype(np.int32)})

    return _by_point(trees, level)


def _merge(trees: int, k: int):
    """A point's best k of all trees, each once; of equal cosines the smaller key."""

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        others = np.frombuffer(b"".join(pdf["others"]), np.int64).reshape(-1, trees * k)
        cosines = np.frombuffer(b"".join(pdf["cosines"]), np.float64).reshape(-1, trees * k)
        order = np.lexsort((-cosines, others), axis=1)
        others, cosines = np.take_along_axis(others, order, 1), np.take_along_axis(cosines, order, 1).copy()
        cosines[:, 1:][(others[:, 1:] == others[:, :-1]) & (cosines[:, :-1] > NONE)] = NONE
        order = np.argsort(-cosines, axis=1, kind="stable")[:, :k]
        others, cosines = np.take_along_axis(others, order, 1), np.take_along_axis(cosines, order, 1)
        keep = cosines > NONE
        return pd.DataFrame({"point": np.repeat(pdf["point"].to_numpy()[::trees], keep.sum(1)), "other": others[keep], "cosine": cosines[keep]})

    return _by_point(trees, merge)


def _search(k: int, reach: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pdf = _sorted(batches)
        for _, part in pdf.groupby("part") if pdf is not None else ():
            own, keys = _own(part), part["key"].to_numpy(np.uint64)
            low, high = _interval(keys, part["level"].to_numpy(np.int64)[own], own, reach)
            yield from _scan(keys, part["point"].to_numpy(np.int64), _units(part["raw"]), own, low, high, k)

    return run


def similar_vectors(df: DataFrame, key: str, vector: str, k: int = 5, dim: int = 64, trees: int = TREES, candidates: int = CANDIDATES, task_rows: int = TASK_ROWS) -> DataFrame:
    """``key, neighbor, cosine``: for every usable vector the k others with the greatest cosine; of equal cosines the smaller key.

    ``key`` is a bigint; repeated rows of a key count once. Null, wrongly sized, non-finite and all-zero vectors are left out.
    Fewer than k others give fewer rows; an empty input gives none. Other columns are ignored. The mean of all vectors is
    taken over all rows; only the ranges of the arrays are set by a sample. Neighbours are approximate (see the measured
    recall in the README), cosines are exact for the values rounded to single precision. The result does not depend on the
    session's partitions.
    """
    spark = df.sparkSession
    v = F.col(vector)
    rows = df.select(F.col(key).alias("id"), v.cast("array<double>").alias("v")).where(F.col("id").isNotNull() & usable(F.col("v"), dim))

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                x = np.stack(pdf["v"].to_numpy()).astype(np.float32)
                yield pd.DataFrame({"id": pdf["id"], "raw": [r.tobytes() for r in x]})

    packed = materialize(rows.mapInPandas(pack, "id bigint, raw binary").dropDuplicates(["id"]))
    # A third of all rows may carry one vector: every map task keeps its k + 1 smallest ids, before the exchange.
    smallest = Window.partitionBy("raw").orderBy("id")
    firsts = packed.withColumn("r", F.row_number().over(smallest)).where(F.col("r") <= k + 1)
    points = materialize(firsts.groupBy("raw").agg(F.min("id").alias("point"), F.array_sort(F.collect_list("id")).alias("firsts")))
    moments = points.mapInPandas(_sums(dim), "at int, total double, n bigint").groupBy("at").agg(F.sum("total").alias("s"), F.sum("n").alias("n")).collect()
    if not moments:
        return spark.createDataFrame([], T.StructType([T.StructField(key, T.LongType()), T.StructField("neighbor", T.LongType()), T.StructField("cosine", T.DoubleType())]))
    mean, n = np.zeros(dim), moments[0]["n"]
    for r in moments:  # one row per dimension
        mean[r["at"]] = r["s"] / r["n"]

    forest = _Forest(points, n, mean, trees, candidates, task_rows)
    counts = forest.arrays(points.select("point", "raw"), []).mapInPandas(_descend(candidates), "point bigint, counts binary")
    levels = counts.repartition("point").sortWithinPartitions("point").mapInPandas(_ascend(trees, candidates), "point bigint, level int")
    levelled = points.select("point", "raw").join(levels, "point")
    found = forest.arrays(levelled, ["raw", "level"]).mapInPandas(_search(k, candidates), "point bigint, others binary, cosines binary")
    ranked = found.repartition("point").sortWithinPartitions("point").mapInPandas(_merge(trees, k), "point bigint, other bigint, cosine double")
    # Neighbouring points bring their smallest ids; the point itself brings its own equals with cosine 1.
    others = points.select(F.col("point").alias("other"), F.col("firsts").alias("ids"))
    candidates_ = ranked.join(others, "other").select("point", "cosine", F.explode("ids").alias("neighbor"))
    own = points.where(F.size("firsts") > 1).select("point", F.lit(1.0).alias("cosine"), F.explode("firsts").alias("neighbor"))
    # The k + 1 best ids of each point suffice for all its events, for an event drops at most itself.
    w = Window.partitionBy("point").orderBy(F.desc("cosine"), "neighbor")
    short = candidates_.unionByName(own).withColumn("r", F.row_number().over(w)).where(F.col("r") <= k + 1)
    lists = short.groupBy("point").agg(F.array_sort(F.collect_list(F.struct("r", "neighbor", "cosine"))).alias("best"))
    # Events meet their point by 128 bits of hash instead of the vector; a point with very many events is split by AQE's skew join.
    hashes = [F.xxhash64("raw").alias("h1"), F.xxhash64("raw", F.lit(1)).alias("h2")]
    by_hash = points.select("point", *hashes).join(lists, "point").select("h1", "h2", "best")
    mine = packed.select("id", *hashes).join(by_hash, ["h1", "h2"]).select("id", F.filter("best", lambda x: x["neighbor"] != F.col("id")).alias("best"))
    top = mine.select("id", F.explode(F.slice("best", 1, k)).alias("b"))
    return top.select(F.col("id").alias(key), F.col("b.neighbor").alias("neighbor"), F.col("b.cosine").alias("cosine"))


def _sums(dim: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, n = np.zeros(dim), 0
        for pdf in batches:
            if len(pdf):
                total += _units(pdf["raw"]).sum(axis=0)
                n += len(pdf)
        if n:
            yield pd.DataFrame({"at": np.arange(dim, dtype=np.int32), "total": total, "n": n})

    return run
