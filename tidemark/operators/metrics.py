"""Evaluation and order statistics."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.intervals import range_sorted


def nearest_rank(df: DataFrame, column: str, share: float) -> DataFrame:
    """The element at min(n - 1, int(share n)) of the sorted column, without interpolation: one row, or none if empty.

    The rows are range-sorted; the partitions' counts, one number each, tell in which partition and at which place it lies.
    """
    values = df.select(F.col(column).cast("double").alias("value")).where("value is not null")
    ranged = range_sorted(values, ["value"])
    sizes = {r["pid"]: r["count"] for r in ranged.groupBy("pid").count().collect()}
    n = sum(sizes.values())
    at, place = min(n - 1, int(share * n)), None
    for pid in sorted(sizes):
        if at < sizes[pid]:
            place = (pid, at)
            break
        at -= sizes[pid]

    def pick(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = 0
        for pdf in batches:
            if place and len(pdf) and pdf["pid"].iloc[0] == place[0] and seen <= place[1] < seen + len(pdf):
                yield pdf.iloc[[place[1] - seen]][["value"]]
            seen += len(pdf)

    return ranged.mapInPandas(pick, "value double")


def cluster_scores(rows: DataFrame, found: str, gold: str) -> DataFrame:
    """Pairwise precision, recall and F1 of a clustering from the cell counts, without forming pairs."""
    two = lambda c: F.sum(F.col(c) * (F.col(c) - 1) / 2)
    cells = rows.groupBy(found, gold).agg(F.count(F.lit(1)).alias("n"))
    both = cells.agg(two("n").alias("both"))
    pred = cells.groupBy(found).agg(F.sum("n").alias("n")).agg(two("n").alias("pred"))
    real = cells.groupBy(gold).agg(F.sum("n").alias("n")).agg(two("n").alias("real"))
    x = both.crossJoin(pred).crossJoin(real)  # one row each
    p, r = F.when(F.col("pred") > 0, F.col("both") / F.col("pred")).otherwise(0.0), F.when(F.col("real") > 0, F.col("both") / F.col("real")).otherwise(0.0)
    return x.select(p.alias("precision"), r.alias("recall"), F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0).alias("f1"))


def iou(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """Intersection over the hull of two intervals; 0 for an empty hull."""
    hull = F.greatest(a1, b1) - F.least(a0, b0)
    return F.when(hull > 0, F.greatest(F.lit(0.0), F.least(a1, b1) - F.greatest(a0, b0)) / hull).otherwise(0.0)


def pair_scores(found: DataFrame, gold: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Precision, recall and F1 of found pairs against gold pairs; the order within a pair and repeated pairs don't matter."""
    tidy = lambda df: df.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct()
    both = tidy(found).withColumn("f", F.lit(1)).join(tidy(gold).withColumn("g", F.lit(1)), ["a", "b"], "full")
    n = both.agg(F.count_if(F.col("f").isNotNull() & F.col("g").isNotNull()).alias("hit"), F.count("f").alias("f"), F.count("g").alias("g"))
    p, r = F.when(F.col("f") > 0, F.col("hit") / F.col("f")).otherwise(0.0), F.when(F.col("g") > 0, F.col("hit") / F.col("g")).otherwise(0.0)
    return n.select(p.alias("precision"), r.alias("recall"), F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0).alias("f1"))


def recall_at(found: DataFrame, exact: DataFrame, k: int) -> DataFrame:
    """Per qid the share of the exact k neighbours (qid, key) that an approximate search (qid, key) has found."""
    hits = exact.join(found.select("qid", "key").distinct().withColumn("hit", F.lit(1)), ["qid", "key"], "left")
    return hits.groupBy("qid").agg((F.coalesce(F.sum("hit"), F.lit(0)) / F.lit(float(k))).alias("recall"))


def grounded_share(answers: DataFrame, claims: DataFrame) -> DataFrame:
    """Share of cited moments (qid, moment_id) that have a committed claim: one row."""
    ok = claims.where("status = 'committed'").select("moment_id").distinct().withColumn("ok", F.lit(1.0))
    return answers.join(ok, "moment_id", "left").agg(F.avg(F.coalesce("ok", F.lit(0.0))).alias("grounded"), F.count(F.lit(1)).alias("n"))


def clip_coverage(clips: DataFrame, gold: DataFrame) -> DataFrame:
    """Per gold span (qid, video_id, g0, g1) the greatest IoU with a clip (qid, video_id, t_start_s, t_end_s); 0 without one."""
    pairs = gold.join(clips, ["qid", "video_id"], "left")
    return pairs.groupBy("qid", "video_id", "g0", "g1").agg(F.coalesce(F.max(iou(F.col("t_start_s"), F.col("t_end_s"), F.col("g0"), F.col("g1"))), F.lit(0.0)).alias("iou"))


def subquery_recall(found: DataFrame, wanted: DataFrame) -> DataFrame:
    """Per qid the share of its parts (qid, part, key: any of the keys will do) of which a key was found (qid, key)."""
    hits = wanted.join(found.select("qid", "key").distinct().withColumn("hit", F.lit(1)), ["qid", "key"], "left")
    parts = hits.groupBy("qid", "part").agg(F.max(F.coalesce("hit", F.lit(0))).alias("hit"))
    return parts.groupBy("qid").agg(F.avg("hit").alias("recall"))


def answer_buckets(rows: DataFrame) -> DataFrame:
    """Refusal, confabulation and accuracy rates of (condition, modality, expects in ('present', 'absent'), refused, correct), and the lift.

    An answer to an absent thing is confabulated unless refused; lift is a condition's accuracy less that of 'none' in the same modality.
    """
    present, absent = F.col("expects") == "present", F.col("expects") == "absent"
    rate = lambda of, what: F.coalesce(F.sum(F.when(of & what, 1.0)) / F.nullif(F.sum(F.when(of, 1.0)), F.lit(0.0)), F.lit(0.0))
    g = rows.groupBy("condition", "modality").agg(F.count(F.lit(1)).alias("n"), rate(F.lit(True), F.col("refused")).alias("refusal"), rate(absent, ~F.col("refused")).alias("confabulation"), rate(present, F.col("correct") & ~F.col("refused")).alias("accuracy"))
    base = g.where("condition = 'none'").select("modality", F.col("accuracy").alias("base"))
    return g.join(base, "modality", "left").withColumn("lift", F.col("accuracy") - F.col("base")).drop("base")
