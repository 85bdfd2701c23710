"""The visual track: usable frames, event ends, scene cuts, keyframes, frame classes, mean vectors."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.vectors import frame_distance, usable, variance
from tidemark.operators.ordered import Ordered

CUT, GAIN, PER_SCENE = 0.3, 0.12, 8


def frames(events: DataFrame, dim: int = 64) -> DataFrame:
    """Frames with a video, a finite start and a usable vector, one row per event_id."""
    ok = F.col("video_id").isNotNull() & F.col("t_start_s").isNotNull() & ~F.isnan("t_start_s") & (F.abs("t_start_s") < 1e7) & usable(F.col("embedding"), dim)
    return events.where(ok).select("event_id", "video_id", "t_start_s", "embedding").dropDuplicates(["event_id"])


def scene_cuts(f: DataFrame, cut: float = CUT) -> DataFrame:
    """``scene``: the number of preceding frames of the video whose mean absolute difference to their predecessor is above ``cut``."""
    rows = Ordered(f, "video_id", ["t_start_s", "event_id"]).lag("before", F.col("embedding"))
    new = F.when(F.col("before").isNotNull() & (frame_distance(F.col("before"), F.col("embedding")) > cut), 1).otherwise(0)
    return rows.with_column("new", new).running_sum("scene", F.col("new")).rows("new", "before")


def keyframes(scenes: DataFrame, gain: float = GAIN, cap: int = PER_SCENE) -> DataFrame:
    """Frames that differ from the last kept frame of their scene by at least ``gain``, at most ``cap`` a scene: an ordered fold."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["t_start_s", "event_id"])
        last, kept = None, []
        for i, v in enumerate(pdf["embedding"]):
            v = np.asarray(v)
            if last is None or (len(kept) < cap and sum(abs(a - b) for a, b in zip(last, v)) / len(v) >= gain):
                kept.append(i)
                last = v
            if len(kept) >= cap:
                break
        return pdf.iloc[kept][["event_id", "video_id", "scene"]]

    return scenes.groupBy("video_id", "scene").applyInPandas(run, "event_id bigint, video_id string, scene bigint")


def frame_class(embedding, ocr) -> F.Column:
    """document (30 words or more), slide (8 or more), diagram (variance of at least 0.05), else talking_head."""
    n = F.size(F.filter(F.split(F.trim(F.coalesce(ocr, F.lit(""))), r"\s+"), lambda w: w != ""))
    return F.when(n >= 30, "document").when(n >= 8, "slide").when(variance(embedding) >= 0.05, "diagram").otherwise("talking_head")


def mean_vector(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """Element-wise mean of every key's vectors of its most frequent size (the smaller of equal ones): ``key, at, mean`` per element."""
    sizes = rows.groupBy(key, F.size(vector).alias("dim")).agg(F.count(F.lit(1)).alias("n"))
    modal = sizes.groupBy(key).agg(F.min_by("dim", F.struct(-F.col("n"), "dim")).alias("dim"))
    same = rows.join(modal, key).where(F.size(vector) == F.col("dim"))
    return same.select(key, F.posexplode(vector).alias("at", "x")).groupBy(key, "at").agg(F.avg("x").alias("mean"))
