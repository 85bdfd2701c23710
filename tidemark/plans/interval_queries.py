"""Problem 3: continuous periods of every video's moments, and the gaps between them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.intervals import merge_intervals
from tidemark.session import table


def finite(name: str):
    """True where the double column is neither null, NaN nor infinite."""
    c = F.col(name)
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periods and gaps in milliseconds. Moments without a video, a finite start or a later finite end are unusable."""
    usable = table(spark, sf_dir, "moments").where(finite("t_start_s") & finite("t_end_s") & (F.col("t_end_s") > F.col("t_start_s")))
    ms = lambda c: F.round(F.col(c) * 1000).cast("bigint")
    out = merge_intervals(usable, F.col("video_id"), ms("t_start_s"), ms("t_end_s"))
    return out.select(F.col("entity").alias("video_id"), "kind", F.col("start_at").alias("start_ms"), F.col("end_at").alias("end_ms"))


QUERIES = {"p3_found": p3_found}

SQL = {
    "p3_found": """
with u as (select distinct video_id, cast(round(t_start_s * 1000) as bigint) s, cast(round(t_end_s * 1000) as bigint) e
           from moments where isfinite(t_start_s) and isfinite(t_end_s) and t_end_s > t_start_s and video_id is not null),
o as (select * from u where e > s),
w as (select *, max(e) over (partition by video_id order by s, e rows between unbounded preceding and 1 preceding) p from o),
g as (select *, sum(case when p is null or s > p then 1 else 0 end) over (partition by video_id order by s, e rows unbounded preceding) k from w),
p as (select video_id, k, min(s) s, max(e) e from g group by all)
select video_id, 'period' as kind, s as start_ms, e as end_ms from p
union all
select video_id, 'gap', e, n from (select *, lead(s) over (partition by video_id order by k) n from p) where n is not null
""",
}
