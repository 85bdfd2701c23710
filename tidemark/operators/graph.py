"""The knowledge graph: edge upserts, neighbours, bounded breadth-first expansion, equivalence groups, version chains."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import materialize


def upsert_edges(old: DataFrame, new: DataFrame) -> DataFrame:
    """Insert-ignore on (src, rel, dst, video_id); the old row wins; rows with a null video_id are all kept."""
    key = ["src", "rel", "dst", "video_id"]
    fresh = new.dropDuplicates(key).where("video_id is not null").join(old.select(*key).where("video_id is not null"), key, "left_anti")
    return old.unionByName(fresh).unionByName(new.where("video_id is null"))


def neighbours(edges: DataFrame) -> DataFrame:
    """Both directions of every edge: node, other."""
    return edges.select(F.col("src").alias("node"), F.col("dst").alias("other")).unionByName(edges.select(F.col("dst").alias("node"), F.col("src").alias("other"))).distinct()


def claim_edges(edges: DataFrame, claims: DataFrame, rels: list[str], video_id: str | None = None) -> DataFrame:
    """Edges (src, dst) of the given relations between committed claims, of one video where ``video_id`` is given."""
    ok = claims.where("status = 'committed'")
    ok = (ok if video_id is None else ok.where(F.substring_index("moment_id", "#", 1) == video_id)).select("claim_id").distinct()
    e = edges.where(F.col("rel").isin(rels) & (F.col("src") != F.col("dst"))).select("src", "dst").distinct()
    return e.join(ok.withColumnRenamed("claim_id", "src"), "src", "left_semi").join(ok.withColumnRenamed("claim_id", "dst"), "dst", "left_semi")


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows that only one of two graphs has, with ``side`` ('left' or 'right'); empty for equal ones."""
    return a.exceptAll(b).withColumn("side", F.lit("left")).unionByName(b.exceptAll(a).withColumn("side", F.lit("right")))


def history(chain: DataFrame, seeds: DataFrame, node: str = "claim_id", to: str = "superseded_by") -> DataFrame:
    """``seed, node, step``: every version before (negative steps) and after a seed, the seed itself at 0; a cycle is gone around once."""
    links = chain.select(F.col(node).alias("n"), F.col(to).alias("t")).where("n is not null and t is not null and n <> t").distinct()
    known = materialize(seeds.select(F.col(seeds.columns[0]).alias("seed")).distinct().withColumn("node", F.col("seed")).withColumn("step", F.lit(0)))
    for sign, near, far in ((1, "n", "t"), (-1, "t", "n")):
        frontier, step = known.where("step = 0"), 0
        while True:
            step += sign
            reached = frontier.join(links.select(F.col(near).alias("node"), F.col(far).alias("next")), "node").select("seed", F.col("next").alias("node")).distinct()
            frontier = materialize(reached.join(known.select("seed", "node"), ["seed", "node"], "left_anti").withColumn("step", F.lit(step)))
            if frontier.isEmpty():
                break
            known = known.unionByName(frontier)
    return known


def with_singletons(nodes: DataFrame, groups: DataFrame, key: str = "claim_id") -> DataFrame:
    """``node, group`` of every node: a node without links is its own group."""
    every = nodes.select(F.col(key).alias("node")).distinct()
    return every.join(groups.select("node", "group"), "node", "left").select("node", F.coalesce("group", "node").alias("group"))


def expand(seeds: DataFrame, edges: DataFrame, hops: int) -> DataFrame:
    """``seed, node, hop`` of every node within ``hops`` of a seed, its first hop only; the seed itself is left out.

    Frontier by frontier: an equi-join with the neighbours, then an anti-join with what is known.
    """
    both = neighbours(edges)
    known = seeds.select("seed", F.col("seed").alias("node"), F.lit(0).alias("hop"))
    frontier = known
    for h in range(1, hops + 1):
        reached = frontier.join(both, "node").select("seed", F.col("other").alias("node")).distinct()
        frontier = materialize(reached.join(known, ["seed", "node"], "left_anti").withColumn("hop", F.lit(h)))
        known = known.unionByName(frontier)
    return known.where("hop > 0")


def equivalence_groups(pairs: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, group`` (the smallest node) of every linked node: alternating large-star and small-star steps to a fixed point.

    Each step is a grouped minimum and a join; edges shrink to one star per group. Every round is checkpointed.
    """
    edges = pairs.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    edges = materialize(edges)
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        up = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(up, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        edges = materialize(small)
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    return edges.select(F.col("u").alias("node"), F.col("v").alias("group")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("group"))).distinct()


def follow(chain: DataFrame, node: str, to: str, rounds: int = 40) -> DataFrame:
    """``node, last, steps``: the end of every node's chain of links ``node -> to`` by pointer doubling; cycles end at their smallest member reached.

    2 ** ``rounds`` links are followed at most, far more than any table has rows; a cycle stops when nothing changes or it has gone around.
    """
    jumps = materialize(chain.select(F.col(node).alias("n"), F.col(to).alias("t"), F.lit(1).cast("bigint").alias("k")).where("n is not null and t is not null and n <> t").dropDuplicates(["n"]))
    total = jumps.count()
    for _ in range(rounds):
        nxt = jumps.select(F.col("n").alias("t"), F.col("t").alias("t2"), F.col("k").alias("k2"))
        joined = jumps.join(nxt, "t", "left")
        step = joined.select("n", F.coalesce("t2", "t").alias("t"), (F.col("k") + F.coalesce("k2", F.lit(0))).alias("k"))
        moved = materialize(step)
        more = moved.join(jumps.select("n", F.col("t").alias("old")), "n").where("t <> old").limit(1).count()
        jumps = moved
        if not more or moved.agg(F.max("k")).first()[0] > 2 * total:
            break
    return jumps.select(F.col("n").alias("node"), F.col("t").alias("last"), F.col("k").alias("steps"))
