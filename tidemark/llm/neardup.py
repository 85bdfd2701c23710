"""Near-duplicate records: deletion-variant signatures over minimum-hash vectors, equality join, exact verification.

A record is the set of its distinct pairs of adjacent words. Its signature is a vector of SEGMENTS x WIDTH minimum-hash
symbols. The vector is cut into segments, few and wide enough that records over the threshold agree, but for at most one
symbol, in at least one segment. Every segment is indexed by its WIDTH one-wildcard variants (the segment with one symbol
deleted), so that two segments that differ in at most one symbol share a variant, and an equality join of the variants finds
the candidate pairs. The sets of every candidate pair are then compared exactly.

Word pairs that occur in many records weigh less in the minimum hashes, in inverse proportion to their frequency; their
frequencies come from a count of all texts into a table of fixed size (a hash count, SLOTS entries), which is the
only thing broadcast. A text's copies count once in every task, so that copies can't make a text's own word pairs frequent. A
record that loses a good part of its weight this way (it keeps HEAVY of it at most) has a second signature in which all word
pairs weigh the same, so that links which rest on frequent word pairs are found too: the members of a family of near
duplicates so large that it makes its own word pairs frequent lose most of theirs. For the others the weights change little.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.session import materialize, spread

#: Segments of a signature, symbols of a segment. At a similarity of 0.5 a segment agrees but for one symbol at
#: 5/16, so that 8 segments miss 5 % of such pairs; at 0.6 they miss 0.6 %, at 0.7 0.02 %.
SEGMENTS, WIDTH = 8, 4
#: Entries of the frequency table; a word pair is common beyond this share of the records.
SLOTS, COMMON = 1 << 18, 1 / 300
#: Records that a word pair may always occur in without weighing less.
FLOOR = 50.0
#: Share of its weight up to which a record has the second signature.
HEAVY = 2 / 3
SEED = 11
#: Texts that a task remembers to pass over their copies, at most.
SEEN = 200_000
#: Items of a group that are paired in one place.
BLOCK = 250
WORD = re.compile(r"[^\W_]+")
TWO_WORDS = r"[\p{L}\p{N}][^\p{L}\p{N}]+[\p{L}\p{N}]"
MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def words(text: str) -> list[str]:
    """The longest runs of letters and digits, lower-cased."""
    return WORD.findall(text.lower())


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: equal inputs give equal, well-spread outputs on every machine."""
    x = (x ^ (x >> np.uint64(30))) * MIX[1]
    x = (x ^ (x >> np.uint64(27))) * MIX[2]
    return x ^ (x >> np.uint64(31))


class Hasher:
    """Hashes of the distinct pairs of adjacent words of texts; the words' own hashes are remembered, within a bound."""

    def __init__(self, most: int = 500_000):
        self.known: dict[str, int] = {}
        self.most = most

    def pairs(self, texts: list) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all texts' sets, one after the other, and the number of each text."""
        known, flat, sizes = self.known, [], []
        for text in texts:
            found = words(text) if text else []
            if len(known) > self.most:
                known.clear()
            for w in found:
                h = known.get(w)
                if h is None:
                    known[w] = h = xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass"))
                flat.append(h)
            sizes.append(len(found))
        sizes = np.array(sizes, np.int64)
        h = np.array(flat, np.uint64)
        owner = np.repeat(np.arange(len(sizes)), sizes)
        if len(h) < 2:
            return np.empty(0, np.uint64), np.zeros(len(sizes), np.int64)
        within = owner[1:] == owner[:-1]
        pair = mix(h[:-1][within] * MIX[0] + mix(h[1:][within]))
        owner = owner[1:][within]
        order = np.lexsort((pair, owner))
        pair, owner = pair[order], owner[order]
        fresh = np.ones(len(pair), bool)
        fresh[1:] = (pair[1:] != pair[:-1]) | (owner[1:] != owner[:-1])
        return pair[fresh], np.bincount(owner[fresh], minlength=len(sizes))


def fresh_rows(pdf: pd.DataFrame, seen: set[int]) -> pd.DataFrame:
    """The rows of a batch whose ``rid`` the task doesn't remember; ``seen`` is emptied beyond SEEN, which costs time only."""
    if len(seen) > SEEN:
        seen.clear()
    pdf = pdf.drop_duplicates("rid")
    pdf = pdf[[r not in seen for r in pdf["rid"].tolist()]]
    seen.update(pdf["rid"].tolist())
    return pdf


def _texts(rows: DataFrame) -> DataFrame:
    """Frequencies: of every slot the number of texts with a word pair in it."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hasher, counts, n, seen = Hasher(), np.zeros(SLOTS, np.int64), 0, set()
        for pdf in batches:
            pdf = fresh_rows(pdf, seen)
            pair, sizes = hasher.pairs(pdf["text"].tolist())
            counts += np.bincount((pair & np.uint64(SLOTS - 1)).astype(np.int64), minlength=SLOTS)
            n += int((sizes > 0).sum())
        at = np.flatnonzero(counts)
        yield pd.DataFrame({"slot": np.append(at, -1).astype(np.int32), "n": np.append(counts[at], n)})

    return rows.mapInPandas(run, "slot int, n bigint").groupBy("slot").agg(F.sum("n").alias("n"))


def slot_weights(rows: DataFrame, common: float = COMMON) -> np.ndarray:
    """The weight of every slot of the frequency table: 1 up to the share ``common`` of all rows, beyond it the inverse."""
    counted = _texts(rows).where((F.col("slot") < 0) | (F.col("n") > 1)).toPandas()  # at most SLOTS + 1 rows
    n = int(counted.loc[counted["slot"] < 0, "n"].sum())
    weights = np.ones(SLOTS, np.float32)
    use = counted[counted["slot"] >= 0]
    weights[use["slot"].to_numpy()] = np.minimum(1.0, max(FLOOR, n * common) / use["n"].to_numpy())
    return weights


def symbols(pair: np.ndarray, sizes: np.ndarray, weights: np.ndarray, k: int) -> np.ndarray:
    """k weighted minimum-hash symbols of every non-empty set, as an array (sets, k) of 64-bit values."""
    starts = np.cumsum(sizes) - sizes
    starts = starts[sizes > 0]
    slow = (1.0 / weights[(pair & np.uint64(SLOTS - 1)).astype(np.int64)]).astype(np.float64)
    out = np.empty((len(starts), k), np.uint64)
    seeds = np.random.default_rng(SEED).integers(1, 1 << 63, k, dtype=np.uint64) | np.uint64(1)
    for j in range(k):
        x = (pair ^ seeds[j]) * MIX[1]
        x = (x ^ (x >> np.uint64(32))) * MIX[2]
        u = (x >> np.uint64(11)).astype(np.float64) + 1.0
        out[:, j] = np.minimum.reduceat(u * slow, starts).view(np.uint64)
    return out


def variants(symbol: np.ndarray, segments: int, width: int) -> np.ndarray:
    """The one-wildcard variants of every segment, as keys (sets, segments * width)."""
    out = np.empty((len(symbol), segments * width), np.uint64)
    for s in range(segments):
        part = [mix(symbol[:, s * width + j] + np.uint64((j + 1) * int(MIX[0]) % (1 << 64))) for j in range(width)]
        whole = np.bitwise_xor.reduce(part)
        for j in range(width):
            out[:, s * width + j] = mix((whole ^ part[j]) + np.uint64((s * width + j + 1) * int(MIX[2]) % (1 << 64)))
    return out


def _signatures(weights, segments: int, width: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hasher, plain, seen = Hasher(), np.ones(SLOTS, np.float32), set()
        for pdf in batches:
            pdf = fresh_rows(pdf, seen)
            for at in range(0, len(pdf), 2000):
                part = pdf.iloc[at : at + 2000]
                pair, sizes = hasher.pairs(part["text"].tolist())
                if not len(pair):
                    continue
                rid, sizes = part["rid"].to_numpy()[sizes > 0], sizes[sizes > 0]
                keys = variants(symbols(pair, sizes, weights.value, segments * width), segments, width)
                yield pd.DataFrame({"key": keys.view(np.int64).ravel(), "rid": np.repeat(rid, segments * width)})
                kept = np.add.reduceat(weights.value[(pair & np.uint64(SLOTS - 1)).astype(np.int64)], np.cumsum(sizes) - sizes)
                some = kept <= HEAVY * sizes
                if some.any():
                    more = variants(symbols(pair[np.repeat(some, sizes)], sizes[some], plain, segments * width), segments, width)
                    new = more != keys[some]  # keys are of a place, so only those of the same place can be equal
                    yield pd.DataFrame({"key": more[new].view(np.int64), "rid": np.repeat(rid[some], new.sum(1))})

    return run


def jaccard(a: str, b: str) -> tuple[int, int]:
    """Sizes of intersection and union of two texts' sets of pairs of adjacent words."""
    x, y = words(a), words(b)
    x, y = set(zip(x, x[1:])), set(zip(y, y[1:]))
    both = len(x & y)
    return both, len(x) + len(y) - both


def _verify(num: int, den: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            keep = []
            for a, b in zip(pdf["text_a"], pdf["text_b"]):
                both, union = jaccard(a, b)
                keep.append(union > 0 and both * den >= union * num)
            yield pdf.loc[keep, ["a", "b"]]

    return run


def pairs_within(rows: DataFrame, group: str, item: str, block: int = BLOCK) -> DataFrame:
    """``x, y`` (x < y): the pairs of the distinct items of every group.

    ``rows`` has every (group, item) once. A group is cut into blocks of ``block`` items in their order, and every two blocks meet in a place of
    their own, so that a large group's pairs are spread over many tasks. Groups of one item go no further.
    """
    whole = Window.partitionBy(group)
    at = F.floor((F.row_number().over(whole.orderBy(item)) - 1) / block).cast("int")
    many = rows.select(group, item, at.alias("p"), F.count(F.lit(1)).over(whole).alias("n")).where("n > 1")
    last = F.floor((F.col("n") - 1) / block).cast("int")
    # An item stands on the left of its own and all later blocks, and on the right of all earlier ones; a place holds two blocks at most.
    left = F.transform(F.sequence("p", last), lambda q: F.struct(F.lit(True).alias("left"), F.col("p").alias("p"), q.alias("q")))
    right = F.transform(F.filter(F.sequence(F.lit(0), F.col("p")), lambda p: p < F.col("p")), lambda p: F.struct(F.lit(False).alias("left"), p.alias("p"), F.col("p").alias("q")))
    placed = many.select(group, item, F.explode(F.concat(left, right)).alias("at"))
    side = lambda c: F.collect_list(F.when(c, F.col(item)))
    met = placed.groupBy(group, "at.p", "at.q").agg(side(F.col("at.left")).alias("x"), side(~F.col("at.left")).alias("y"))
    others = F.when(F.col("p") == F.col("q"), F.col("x")).otherwise(F.col("y"))
    pairs = F.flatten(F.transform("x", lambda x: F.transform(F.filter(others, lambda y: y > x), lambda y: F.struct(x.alias("x"), y.alias("y")))))
    return met.select(F.explode(pairs).alias("pair")).select("pair.*")


def near_duplicate_links(base: DataFrame, num: int = 1, den: int = 2, segments: int = SEGMENTS, width: int = WIDTH) -> DataFrame:
    """``a, b`` (a < b): the pairs of text classes whose sets have at least num/den of their union in common.

    ``base``: ``rid`` bigint, the class of the ``text``; a class may have many rows. Texts of fewer than two words belong to no pair.
    """
    spark = base.sparkSession
    weights = spark.sparkContext.broadcast(slot_weights(base))  # SLOTS numbers, whatever the input
    # One exchange by variant serves the removal of what several tasks' copies of a text have given and the search for variants of two texts.
    index = base.mapInPandas(_signatures(weights, segments, width), "key bigint, rid bigint").repartition(F.col("key")).dropDuplicates(["key", "rid"])
    candidates = materialize(pairs_within(index, "key", "rid").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct())
    needed = candidates.select(F.explode(F.array("a", "b")).alias("rid")).distinct()
    texts = base.repartition(F.col("rid")).join(needed, "rid", "left_semi").dropDuplicates(["rid"])
    one = candidates.join(texts.select(F.col("rid").alias("a"), F.col("text").alias("text_a")), "a")
    two = one.join(texts.select(F.col("rid").alias("b"), F.col("text").alias("text_b")), "b")
    return two.mapInPandas(_verify(num, den), "a bigint, b bigint")


def near_duplicates(records: DataFrame, key: str, text: str) -> tuple[DataFrame, DataFrame]:
    """Membership (``key, rid``: the class of exact copies of every record) and links (``a, b`` of classes, a < b).

    Repeated rows of a key count once. Records with a null text or fewer than two words are in no class. Classes are held by
    a 64-bit hash of the text, so that a text shared by a third of all rows is compared once. Other columns are ignored.
    """
    base = spread(records.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")))
    base = base.where(F.col("key").isNotNull() & F.col("text").rlike(TWO_WORDS)).withColumn("rid", F.xxhash64("text"))
    return base.select("key", "rid").distinct(), near_duplicate_links(base.select("rid", "text"))


def expand_links(members: DataFrame, links: DataFrame) -> DataFrame:
    """``record_a, record_b`` (record_a < record_b in byte order): linked classes' records, and the records of one class with each other."""
    a = members.select(F.col("rid").alias("a"), F.col("key").alias("x"))
    b = members.select(F.col("rid").alias("b"), F.col("key").alias("y"))
    across = links.join(a, "a").join(b, "b").select("x", "y")
    within = pairs_within(members, "rid", "key")
    return across.unionByName(within).select(F.least("x", "y").alias("record_a"), F.greatest("x", "y").alias("record_b"))
