"""Queries of sources, sinks, the store, metrics and the streaming extensions."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions import text as X
from tidemark.operators import metrics as M
from tidemark.operators import segmentation as S
from tidemark.plans import sqltext as Q
from tidemark.plans.text_queries import once
from tidemark.sources import captions, store
from tidemark.session import shared_dir, table
from tidemark.streaming import windows as W


def captions_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """The segments written as WebVTT, one file for every 5 minutes of a video, and parsed again."""
    s = S.speech_segments(table(spark, d, "segments")).where("t0 >= 0 and t1 >= t0")
    body = F.trim(F.regexp_replace(F.regexp_replace("text", "[<>&]", ""), r"\s+", " "))
    who = F.nullif(F.trim(F.regexp_replace("speaker", "[<>]", "")), F.lit(""))
    files = captions.to_vtt(s.select(F.concat_ws("-", "video_id", F.floor(F.col("t0") / 300).cast("string")).alias("path"), "t0", "t1", who.alias("speaker"), body.alias("text")).where("text <> '' and not text like '%-->%'"))
    back = captions.load_transcripts(files.withColumn("path", F.concat("path", F.lit(".vtt"))))
    return back.groupBy("path").agg(F.count(F.lit(1)).alias("n"), F.sum(F.floor(F.col("t0") * 1000 + 0.5)).alias("starts"), F.sum(F.length("text")).alias("chars"), F.count("speaker").alias("named"))


def upsert_latest(spark: SparkSession, d: str) -> DataFrame:
    """Newest arrival of every segment from an old and a new half of the table."""
    s = table(spark, d, "segments").select("seg_id", "video_id", "ingested_at")
    old, new = s.where("ingested_at < timestamp_ntz '2025-04-01'"), s.where("ingested_at >= timestamp_ntz '2025-04-01' or ingested_at is null")
    return store.upsert_latest(old, new, ["seg_id"], "ingested_at").select("seg_id", "video_id", F.date_format("ingested_at", "yyyy-MM-dd HH:mm:ss").alias("at"))


def ingest_changes(spark: SparkSession, d: str) -> DataFrame:
    """Videos an idempotent ingest has to do, where only those with an even hash are known."""
    v = table(spark, d, "videos").select("video_id", "content_hash", "pipeline_version").distinct()
    known = v.where(F.conv(F.substring(F.md5("video_id"), 1, 1), 16, 10).cast("int") % 2 == 0)
    return store.changed(v.na.fill("-"), known.na.fill("-"), ["video_id", "content_hash", "pipeline_version"])


def forget_video(spark: SparkSession, d: str) -> DataFrame:
    """Rows that are left of every table after the video with the smallest id is forgotten."""
    names = ["videos", "moments", "claims", "segments", "visual_events", "contradiction_pairs"]
    tables = {n: table(spark, d, n) for n in names}
    left = store.forget(tables, tables["videos"].agg(F.min("video_id").alias("video_id")))
    out = None
    for n in names:
        one = left[n].agg(F.count(F.lit(1)).alias("n")).select(F.lit(n).alias("name"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def ledger_merge(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "segments").select(F.concat(F.lit("cues:"), F.coalesce(F.lower("kind"), F.lit("-"))).alias("metric"), F.lit(1.0).alias("value"))
    m = table(spark, d, "moments").select(F.lit("cues:event").alias("metric"), F.lit(-1.0).alias("value"))
    return store.merge_ledger(s, m)


def digest(spark: SparkSession, d: str) -> DataFrame:
    """A Markdown digest of every video: its title and its five most salient committed claims."""
    ok = F.when(F.isnan("salience"), 0.0).otherwise(F.coalesce("salience", F.lit(0.0)))
    c = once(table(spark, d, "claims").where("status = 'committed' and text is not null").select("claim_id", "video_id", "text", ok.alias("s")), "claim_id")
    top = c.withColumn("r", F.row_number().over(Window.partitionBy("video_id").orderBy(F.desc("s"), "claim_id"))).where("r <= 5")
    lines = top.groupBy("video_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", X.markdown_escape(X.truncate(F.col("text"), 120)).alias("t")))), lambda x: F.concat(F.lit("- "), x["t"])), "\n").alias("body"))
    v = table(spark, d, "videos").select("video_id", "title").distinct()
    return v.join(lines, "video_id").select("video_id", F.concat(F.lit("# "), X.markdown_escape(F.coalesce("title", "video_id")), F.lit("\n\n"), F.col("body")).alias("markdown"))


def json_export(spark: SparkSession, d: str) -> DataFrame:
    """Every claim as a JSON document, and the fields read back from it."""
    names = ["claim_id", "moment_id", "video_id", "text", "subject", "predicate", "obj", "claim_type", "status", "speaker_id"]
    c = once(table(spark, d, "claims").select(*names), "claim_id").select(F.to_json(F.struct(*names)).alias("doc"))
    return c.select(*[F.get_json_object("doc", f"$.{n}").alias(n) for n in names])


def p95_nearest_rank(spark: SparkSession, d: str) -> DataFrame:
    return M.nearest_rank(table(spark, d, "lineitem"), "l_extendedprice", 0.95)


def cluster_f1(spark: SparkSession, d: str) -> DataFrame:
    """Documents grouped by source, against their language."""
    rows = table(spark, d, "documents").select(F.coalesce("source", F.lit("-")).alias("found"), F.lower(F.coalesce("lang", F.lit("-"))).alias("gold"))
    r = M.cluster_scores(rows, "found", "gold")
    return r.select(*[X.six(F.col(c)).alias(c) for c in r.columns])


def refusal_rates(spark: SparkSession, d: str) -> DataFrame:
    """Share of low-evidence answers and mean citations by number of cited videos."""
    p = once(table(spark, d, "iterm_probes").select("probe_id", "low_evidence", "n_citations", F.coalesce(F.size("cite_videos"), F.lit(-1)).alias("videos")), "probe_id")
    return p.groupBy(F.col("videos").cast("bigint").alias("videos")).agg(F.count(F.lit(1)).alias("n"), X.six(F.avg(F.when(F.col("low_evidence"), 1.0).otherwise(0.0))).alias("refused"), X.six(F.avg("n_citations")).alias("citations"))


def span_iou(spark: SparkSession, d: str) -> DataFrame:
    """Mean overlap of every video's claims with their moments."""
    c, m = table(spark, d, "claims"), table(spark, d, "moments")
    c = once(c.where(S.finite_span(c, "t_start_s", "t_end_s")).select("claim_id", "moment_id", F.col("t_start_s").alias("a0"), F.col("t_end_s").alias("a1")), "claim_id")
    m = once(m.where(S.finite_span(m, "t_start_s", "t_end_s")).select("moment_id", "video_id", F.col("t_start_s").alias("b0"), F.col("t_end_s").alias("b1")), "moment_id")
    return c.join(m, "moment_id").groupBy("video_id").agg(F.count(F.lit(1)).alias("n"), X.six(F.avg(M.iou(F.col("a0"), F.col("a1"), F.col("b0"), F.col("b1")))).alias("iou"))


def claims_per_moment(spark: SparkSession, d: str) -> DataFrame:
    """Claims and committed claims of every video's moments, and the mean salience of its claims that have one."""
    sane = F.when(~F.isnan("salience"), F.col("salience"))
    c = once(table(spark, d, "claims").select("claim_id", "moment_id", "status", sane.alias("s")), "claim_id")
    m = once(table(spark, d, "moments").select("moment_id", "video_id"), "moment_id")
    per = m.join(c.groupBy("moment_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("status") == "committed").alias("ok"), F.sum("s").alias("s"), F.count("s").alias("k")), "moment_id", "left")
    return per.groupBy("video_id").agg(F.count(F.lit(1)).alias("moments"), F.sum(F.coalesce("n", F.lit(0))).alias("claims"), F.sum(F.coalesce("ok", F.lit(0))).alias("committed"), F.round(F.sum("s") / F.sum("k"), 4).alias("salience"))


def relation_scores(spark: SparkSession, d: str) -> DataFrame:
    """Precision, recall and F1 of the pairs with a score of at least 0.7 against those that contradict."""
    p = table(spark, d, "contradiction_pairs").where("claim_a is not null and claim_b is not null").select(F.col("claim_a").alias("a"), F.col("claim_b").alias("b"), F.upper(F.trim("relation")).alias("rel"), "score")
    r = M.pair_scores(p.where("score >= 0.7 and not isnan(score)"), p.where("rel = 'CONTRADICTS'"))
    return r.select(*[X.six(F.col(c)).alias(c) for c in r.columns])


def clip_coverage(spark: SparkSession, d: str) -> DataFrame:
    """How well each claim's span is covered by its moment's."""
    c, m = table(spark, d, "claims"), table(spark, d, "moments")
    gold = once(c.where(S.finite_span(c, "t_start_s", "t_end_s") & F.col("moment_id").isNotNull()).select("claim_id", F.col("moment_id").alias("qid"), "video_id", F.col("t_start_s").alias("g0"), F.col("t_end_s").alias("g1")), "claim_id").drop("claim_id")
    clips = once(m.where(S.finite_span(m, "t_start_s", "t_end_s")).select(F.col("moment_id").alias("qid"), "video_id", "t_start_s", "t_end_s"), "qid")
    return M.clip_coverage(clips, gold).groupBy("qid").agg(F.count(F.lit(1)).alias("n"), X.six(F.avg("iou")).alias("iou")).withColumnRenamed("qid", "moment_id")


def grounded_share(spark: SparkSession, d: str) -> DataFrame:
    """Share of the moments that have a committed claim."""
    m = table(spark, d, "moments").select("moment_id").distinct()
    return M.grounded_share(m, table(spark, d, "claims")).select(X.six(F.col("grounded")).alias("grounded"), "n")


def answer_buckets(spark: SparkSession, d: str) -> DataFrame:
    """Refusals, confabulations and accuracy of the probes by number of cited videos (one or more, or none) and first question word."""
    p = once(table(spark, d, "iterm_probes").where("q is not null").select("probe_id", "q", "low_evidence", "n_citations", "cite_videos"), "probe_id")
    rows = p.select(F.when(F.size("cite_videos") > 1, "several").otherwise("none").alias("condition"), F.coalesce(F.get(X.tokens(F.col("q")), 0), F.lit("-")).alias("modality"), F.when(F.coalesce("n_citations", F.lit(0)) > 0, "present").otherwise("absent").alias("expects"), F.coalesce("low_evidence", F.lit(False)).alias("refused"), (F.coalesce(F.size("cite_videos"), F.lit(0)) > 0).alias("correct"))
    r = M.answer_buckets(rows)
    return r.select("condition", "modality", "n", *[X.six(F.col(c)).alias(c) for c in ("refusal", "confabulation", "accuracy", "lift")])


def _stream(spark: SparkSession, d: str) -> DataFrame:
    return W.read_stream(spark, f"{d}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))


def stream_tumbling(spark: SparkSession, d: str) -> DataFrame:
    """Counts per hour and type from a stream, appended batch by batch to one table and merged: late rows of any age are counted."""
    folder = f"{shared_dir(spark).rstrip('/')}/tumbling-{uuid.uuid4().hex}"

    def each(batch: DataFrame, _: int) -> None:
        w = batch.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"))
        w.select(F.date_format("w.start", "yyyy-MM-dd HH:mm").alias("hour"), "event_type", "n").write.mode("append").parquet(folder)

    W.run_batches(_stream(spark, d), each)
    return spark.read.parquet(folder).groupBy("hour", "event_type").agg(F.sum("n").alias("n"))


def stream_dedup(spark: SparkSession, d: str) -> DataFrame:
    """Stateful removal of repeated event ids, written by a streaming sink."""
    out = W.run_to_table(W.distinct_within(_stream(spark, d), ["event_id"], "60 days"))
    return out.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("event_id").alias("ids"))


def batch_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Session windows with a gap of one hour per user."""
    e = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return e.groupBy(F.session_window("ts", "1 hour").alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n")).select("user_id", F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("started"), "n")


def sliding_counts(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    w = e.groupBy(F.window("ts", "2 hours", "1 hour").alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return w.select(F.date_format("w.start", "yyyy-MM-dd HH:mm").alias("start"), "n")


def revenue_by_nation(spark: SparkSession, d: str) -> DataFrame:
    """Extension: a star join with a rollup; small sides are left to the size-checked automatic broadcast."""
    t = lambda n: table(spark, d, n)
    li = t("lineitem").groupBy("l_orderkey").agg(F.sum(F.expr("cast(l_extendedprice * (1 - l_discount) as decimal(18,4))")).alias("rev"))
    j = li.join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return j.rollup("n_name", "o_orderstatus").agg(F.count(F.lit(1)).alias("n"), F.sum("rev").cast("double").alias("revenue")).select(F.coalesce("n_name", F.lit("*")).alias("n_name"), F.coalesce("o_orderstatus", F.lit("*")).alias("o_orderstatus"), "n", F.floor(F.col("revenue")).alias("revenue"))


QUERIES = {f.__name__: f for f in (captions_roundtrip, upsert_latest, ingest_changes, forget_video, ledger_merge, digest, json_export, p95_nearest_rank, cluster_f1, refusal_rates, span_iou, claims_per_moment, relation_scores, clip_coverage, grounded_share, answer_buckets, stream_tumbling, stream_dedup, batch_sessions, sliding_counts, revenue_by_nation)}

_SPAN = "isfinite({0}) and isfinite({1}) and abs({0}) < 1e7 and abs({1}) < 1e7 and {0} >= 0 and {1} >= {0}"
_MD = lambda c: f"regexp_replace({c}, '([\\\\`*_{{}}\\[\\]()#+!|<>-])', '\\\\\\1', 'g')"
_CUT = "case when length(o) > 120 then rtrim(substring(o, 1, 119), ' ') || '…' else o end"

SQL = {
    "captions_roundtrip": """select video_id || '-' || floor(t0 / 300)::bigint || '.vtt' as path, count(*) as n, sum(floor(t0 * 1000 + 0.5)::bigint)::bigint as starts, sum(length(b))::bigint as chars, count(nullif(trim(regexp_replace(speaker, '[<>]', '', 'g'), ' '), '')) as named from (
 select video_id, t0, speaker, trim(regexp_replace(regexp_replace(text, '[<>&]', '', 'g'), '\\s+', ' ', 'g'), ' ') b from (select seg_id, any_value(video_id) video_id, any_value(start_s) t0, any_value(end_s) t1, any_value(speaker) speaker, any_value(text) text from segments
 where lower(kind) = 'speech' and trim(text, ' ') <> '' and video_id is not null and isfinite(start_s) and isfinite(end_s) group by seg_id) where t0 >= 0 and t1 >= t0) where b <> '' and b not like '%-->%' group by 1""",
    "upsert_latest": "select seg_id, video_id, strftime(ingested_at, '%Y-%m-%d %H:%M:%S') as at from (select *, row_number() over (partition by seg_id order by ingested_at desc nulls last) r from segments) where r = 1",
    "ingest_changes": "select distinct video_id, coalesce(content_hash, '-') as content_hash, coalesce(pipeline_version, '-') as pipeline_version from videos where cast('0x' || substring(md5(video_id), 1, 1) as int) % 2 = 1",
    "forget_video": "with g as (select min(video_id) v from videos) "
    + " union all ".join(f"select '{n}' as name, count(*) as n from {n} where video_id is null or video_id <> (select v from g)" for n in ("videos", "moments", "claims", "segments", "visual_events"))
    + " union all select 'contradiction_pairs', count(*) from contradiction_pairs where coalesce(split_part(claim_a, '#', 1), '') <> (select v from g) and coalesce(split_part(claim_b, '#', 1), '') <> (select v from g)",
    "ledger_merge": "select metric, greatest(0, sum(value))::double as value from (select 'cues:' || coalesce(lower(kind), '-') metric, 1.0 value from segments union all select 'cues:event', -1.0 from moments) group by 1",
    "digest": f"""with c as (select claim_id, any_value(video_id) video_id, any_value(text) txt, any_value(case when isnan(salience) then 0 else coalesce(salience, 0) end) s from claims where status = 'committed' and text is not null group by 1),
t as (select video_id, trim(regexp_replace(txt, '[\\r\\n]', ' ', 'g'), ' ') o, row_number() over (partition by video_id order by s desc, claim_id) r from c)
select video_id, '# ' || {_MD('coalesce(title, video_id)')} || chr(10) || chr(10) || b as markdown from (select distinct video_id, title from videos) join (select video_id, string_agg('- ' || {_MD(_CUT)}, chr(10) order by r) b from t where r <= 5 group by 1) using (video_id)""",
    "json_export": "select claim_id, " + ", ".join(f"any_value({n}) as {n}" for n in ("moment_id", "video_id", "text", "subject", "predicate", "obj", "claim_type", "status", "speaker_id")) + " from claims group by 1",
    "p95_nearest_rank": "select l_extendedprice::double as value from (select l_extendedprice, row_number() over (order by l_extendedprice) - 1 i, count(*) over () n from lineitem) where i = least(n - 1, floor(0.95::double * n)::bigint)",
    "cluster_f1": f"""with c as (select coalesce(source, '-') f, lower(coalesce(lang, '-')) g, count(*)::double n from documents group by 1, 2), x as (select (select sum(n * (n - 1) / 2) from c) b, (select sum(n * (n - 1) / 2) from (select sum(n) n from c group by f)) p, (select sum(n * (n - 1) / 2) from (select sum(n) n from c group by g)) r)
select {Q.six('b / p')} as precision, {Q.six('b / r')} as recall, {Q.six('2 * (b / p) * (b / r) / (b / p + b / r)')} as f1 from x""",
    "refusal_rates": f"select videos::bigint as videos, count(*) as n, {Q.six('avg(case when low_evidence then 1.0::double else 0 end)')} as refused, {Q.six('avg(n_citations)')} as citations from (select probe_id, any_value(low_evidence) low_evidence, any_value(n_citations) n_citations, coalesce(any_value(len(cite_videos)), -1) videos from iterm_probes group by 1) group by 1",
    "span_iou": f"""with c as (select claim_id, any_value(moment_id) moment_id, any_value(t_start_s) a0, any_value(t_end_s) a1 from claims where {_SPAN.format('t_start_s', 't_end_s')} group by 1), m as (select moment_id, any_value(video_id) video_id, any_value(t_start_s) b0, any_value(t_end_s) b1 from moments where {_SPAN.format('t_start_s', 't_end_s')} group by 1)
select video_id, count(*) as n, {Q.six('avg(case when greatest(a1, b1) - least(a0, b0) > 0 then greatest(0, least(a1, b1) - greatest(a0, b0)) / (greatest(a1, b1) - least(a0, b0)) else 0 end)')} as iou from c join m using (moment_id) group by 1""",
    "claims_per_moment": """with c as (select claim_id, any_value(moment_id) moment_id, any_value(status) status, any_value(case when not isnan(salience) then salience end) s from claims group by 1), k as (select moment_id, count(*) n, count(*) filter (where status = 'committed') ok, sum(s) s, count(s) k from c group by 1)
select video_id, count(*) as moments, sum(coalesce(n, 0))::bigint as claims, sum(coalesce(ok, 0))::bigint as committed, round(sum(s) / sum(k), 4) as salience from (select moment_id, any_value(video_id) video_id from moments group by 1) left join k using (moment_id) group by 1""",
    "relation_scores": f"""with p as (select least(claim_a, claim_b) a, greatest(claim_a, claim_b) b, upper(trim(relation)) rel, score from contradiction_pairs where claim_a is not null and claim_b is not null),
f as (select distinct a, b from p where score >= 0.7 and not isnan(score)), g as (select distinct a, b from p where rel = 'CONTRADICTS'), x as (select (select count(*) from f join g using (a, b))::double h, (select count(*) from f)::double f, (select count(*) from g)::double g)
select {Q.six('h / f')} as precision, {Q.six('h / g')} as recall, {Q.six('2 * (h / f) * (h / g) / (h / f + h / g)')} as f1 from x""",
    "clip_coverage": f"""with g as (select claim_id, any_value(moment_id) qid, any_value(video_id) video_id, any_value(t_start_s) g0, any_value(t_end_s) g1 from claims where {_SPAN.format('t_start_s', 't_end_s')} and moment_id is not null group by 1), m as (select moment_id qid, any_value(video_id) video_id, any_value(t_start_s) a, any_value(t_end_s) b from moments where {_SPAN.format('t_start_s', 't_end_s')} group by 1),
p as (select qid, video_id, g0, g1, coalesce(max(case when greatest(b, g1) - least(a, g0) > 0 then greatest(0, least(b, g1) - greatest(a, g0)) / (greatest(b, g1) - least(a, g0)) else 0 end) filter (where a is not null), 0) iou from g left join m using (qid, video_id) group by all)
select qid as moment_id, count(*) as n, {Q.six('avg(iou)')} as iou from p group by 1""",
    "grounded_share": f"select {Q.six('avg(case when exists (select 1 from claims c where c.moment_id = m.moment_id and status = ' + chr(39) + 'committed' + chr(39) + ') then 1.0::double else 0 end)')} as grounded, count(*) as n from (select distinct moment_id from moments) m",
    "answer_buckets": f"""with p as (select probe_id, any_value(q) q, any_value(low_evidence) le, any_value(n_citations) nc, any_value(len(cite_videos)) cv from iterm_probes where q is not null group by 1),
r as (select case when cv > 1 then 'several' else 'none' end condition, coalesce({Q.tokens('q')}[1], '-') modality, coalesce(nc, 0) > 0 present, coalesce(le, false) refused, coalesce(cv, 0) > 0 correct from p),
g as (select condition, modality, count(*) n, avg(refused::int) refusal, coalesce(avg((not refused)::int) filter (where not present), 0) confabulation, coalesce(avg((correct and not refused)::int) filter (where present), 0) accuracy from r group by 1, 2)
select g.condition, g.modality, g.n, {Q.six('g.refusal')} as refusal, {Q.six('g.confabulation')} as confabulation, {Q.six('g.accuracy')} as accuracy, {Q.six('g.accuracy - b.accuracy')} as lift from g left join g b on b.condition = 'none' and b.modality = g.modality""",
    "stream_tumbling": "select strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') as hour, event_type, count(*) as n from events group by 1, 2",
    "stream_dedup": "select event_type, count(*) as n, count(distinct event_id) as ids from (select event_id, any_value(event_type) event_type from events group by 1) group by 1",
    "batch_sessions": """with g as (select *, case when ts < lag(ts) over (partition by user_id order by ts) + interval 1 hour then 0 else 1 end c from events), s as (select *, sum(c) over (partition by user_id order by ts rows unbounded preceding) k from g)
select user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') as started, count(*) as n from s group by user_id, k""",
    "sliding_counts": "select strftime(h, '%Y-%m-%d %H:%M') as start, count(*) as n from (select unnest([date_trunc('hour', ts), date_trunc('hour', ts) - interval 1 hour]) h from events) group by 1",
    "revenue_by_nation": """with l as (select l_orderkey, sum(cast(l_extendedprice * (1 - l_discount) as decimal(18,4))) rev from lineitem group by 1)
select coalesce(n_name, '*') as n_name, coalesce(o_orderstatus, '*') as o_orderstatus, count(*) as n, floor(sum(rev)::double)::bigint as revenue from l join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey group by rollup (n_name, o_orderstatus)""",
}
