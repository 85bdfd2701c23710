"""Queries of the remaining scans, filters and label rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import retrieval as R
from tidemark.operators.names import fuzzy_names
from tidemark.plans import sqltext as Q
from tidemark.plans.retrieval_queries import _BASE, corpus, questions
from tidemark.plans.text_queries import once
from tidemark.session import table

LABEL = r"^(?:>> |- )?(?:<v ([^>]+)>|\[([A-Z][A-Za-z]+ [A-Z][A-Za-z]+)\]|([A-Z][A-Za-z.]*(?: [A-Z][A-Za-z]+)?):)"


def speaker_labels(spark: SparkSession, d: str) -> DataFrame:
    """Labels at the head of cues that occur at least twice in their video."""
    s = once(table(spark, d, "segments").where("video_id is not null and text is not null").select("seg_id", "video_id", "text"), "seg_id")
    part = lambda i: F.regexp_extract("text", LABEL, i)
    label = F.lower(F.trim(F.concat(part(1), part(2), part(3))))
    return s.select("video_id", label.alias("label")).where("label <> ''").groupBy("video_id", "label").agg(F.count(F.lit(1)).alias("n")).where("n >= 2")


def music_lines(spark: SparkSession, d: str) -> DataFrame:
    s = once(table(spark, d, "segments").where("text is not null").select("seg_id", "text"), "seg_id")
    return s.where(F.col("text").rlike(r"^\s*♪[^♪]*♪?\s*$")).select("seg_id")


def like_fallback(spark: SparkSession, d: str) -> DataFrame:
    """Moments with the term as it stands, apart from case; wildcard signs have no meaning."""
    m = once(table(spark, d, "moments").where("transcript is not null").select("moment_id", "transcript"), "moment_id")
    return m.where(F.contains(F.lower("transcript"), F.lit("trellis"))).select("moment_id")


def video_scope(spark: SparkSession, d: str) -> DataFrame:
    """Claims by the exact video part of their moment id."""
    c = once(table(spark, d, "claims").select("claim_id", "moment_id"), "claim_id")
    return c.groupBy(F.substring_index("moment_id", "#", 1).alias("scope")).agg(F.count(F.lit(1)).alias("n"))


def id_set_append(spark: SparkSession, d: str) -> DataFrame:
    """The sorted set of ids of every channel after a second batch is appended to it."""
    v = table(spark, d, "videos").select(F.coalesce("channel", F.lit("-")).alias("channel"), "video_id", F.coalesce("pipeline_version", F.lit("")).alias("v")).distinct()
    both = lambda x: v.where(x).groupBy("channel").agg(F.collect_set("video_id").alias("ids"))
    old, new = both(F.col("v") == "1.0.0"), both(F.col("v") != "1.0.0").withColumnRenamed("ids", "more")
    none = F.array().cast("array<string>")
    joined = old.join(new, "channel", "full").select("channel", F.array_sort(F.array_union(F.coalesce("ids", none), F.coalesce("more", none))).alias("ids"))
    return joined.select("channel", F.array_join("ids", ",").alias("ids"))


def lexical_prefilter(spark: SparkSession, d: str) -> DataFrame:
    """Dense search among the moments with a term that starts with a term of the question, of whatever length."""
    return R.prefiltered(questions(spark, d), corpus(spark, d), 10).select("qid", F.col("key").alias("moment_id"), "score")


def vector_topk_scoped(spark: SparkSession, d: str) -> DataFrame:
    """The five most similar embeddings of the same label for the questions (ids divisible by 100)."""
    e = table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("vec"), F.col("label").cast("string").alias("video_id"))
    near = R.vector_search(e.where("vec_id % 100 = 0").withColumnRenamed("vec_id", "qid"), e.withColumnRenamed("vec_id", "key"), 6).where("key <> qid").drop("rank")
    return R.ranked(near, 5).select("qid", F.col("key").alias("vec_id"), "score")


def speaker_fuzzy(spark: SparkSession, d: str) -> DataFrame:
    """Speaker names of the cues, each with its group's first name: greedy first fit by a ratio of 0.9."""
    s = table(spark, d, "segments").where("speaker is not null").select(F.lower(F.trim(F.regexp_replace("speaker", r"[>:]+|\([a-z]+\)", " "))).alias("name"))
    return fuzzy_names(s, "name")


QUERIES = {f.__name__: f for f in (speaker_labels, music_lines, like_fallback, video_scope, id_set_append, lexical_prefilter, vector_topk_scoped, speaker_fuzzy)}

SQL = {
    "speaker_labels": f"""select video_id, label, count(*) as n from (select video_id, lower(trim(regexp_extract(text, '{LABEL}', 1) || regexp_extract(text, '{LABEL}', 2) || regexp_extract(text, '{LABEL}', 3), ' ')) as label
 from {Q.unique('segments', 'seg_id', 'video_id text')} where video_id is not null and text is not null) where label <> '' group by 1, 2 having count(*) >= 2""",
    "music_lines": f"select seg_id from {Q.unique('segments', 'seg_id', 'text')} where regexp_matches(text, '^\\s*♪[^♪]*♪?\\s*$')",
    "like_fallback": f"select moment_id from {Q.unique('moments', 'moment_id', 'transcript')} where contains(lower(transcript), 'trellis')",
    "video_scope": f"select split_part(moment_id, '#', 1) as scope, count(*) as n from {Q.unique('claims', 'claim_id', 'moment_id')} group by 1",
    "id_set_append": "select channel, string_agg(video_id, ',' order by video_id) as ids from (select distinct coalesce(channel, '-') as channel, video_id from videos) group by 1",
    "lexical_prefilter": f"""with {_BASE}, al as (select distinct qid, mid from qt join (select distinct mid, t from dt) on starts_with(t, qterm))
select qid, mid as moment_id, score from (select *, row_number() over (partition by qid order by score desc, mid) r from de join al using (qid, mid)) where r <= 10""",
    "vector_topk_scoped": f"""with e as (select vec_id, embedding::double[] v, label from embeddings), s as (select q.vec_id qid, e.vec_id, {Q.six('list_cosine_similarity(q.v, e.v)')} score from e join e q on q.vec_id % 100 = 0 and q.vec_id <> e.vec_id and q.label = e.label)
select qid, vec_id, score from (select *, row_number() over (partition by qid order by score desc, vec_id) r from s) where r <= 5""",
}
