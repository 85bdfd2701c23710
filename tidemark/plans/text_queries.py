"""Queries of the text scalars, scans and simple aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions import text as X
from tidemark.plans import sqltext as Q
from tidemark.session import table


def once(df: DataFrame, key: str) -> DataFrame:
    """Repeated rows of a key carry the same content; one is kept."""
    return df.dropDuplicates([key])


def tokenize_counts(spark: SparkSession, d: str) -> DataFrame:
    t = X.tokens(F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.size(t).cast("bigint").alias("n_tokens"), F.size(F.array_distinct(t)).cast("bigint").alias("n_distinct"))


def sentence_split(spark: SparkSession, d: str) -> DataFrame:
    s = X.sentences(F.col("transcript"))
    m = once(table(spark, d, "moments").select("moment_id", "transcript"), "moment_id")
    return m.select("moment_id", F.size(s).cast("bigint").alias("n_sentences"), F.coalesce(F.array_max(F.transform(s, F.length)), F.lit(0)).cast("bigint").alias("longest"))


def doc_freq(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select(F.explode(F.array_distinct(X.tokens(F.col("text")))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def topic_label_top3(spark: SparkSession, d: str) -> DataFrame:
    m = once(table(spark, d, "moments").where("topic_id is not null").select("moment_id", "topic_id", "transcript"), "moment_id")
    counts = m.select("topic_id", F.explode(X.content_tokens(F.col("transcript"))).alias("t")).groupBy("topic_id", "t").agg(F.count(F.lit(1)).alias("n"))
    top = counts.withColumn("r", F.row_number().over(Window.partitionBy("topic_id").orderBy(F.desc("n"), "t"))).where("r <= 3")
    return top.groupBy("topic_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "t"))), lambda x: x["t"]), " ").alias("label"))


def slug_ids(spark: SparkSession, d: str) -> DataFrame:
    slug = X.slugify(F.col("title"))
    return table(spark, d, "videos").select("video_id", slug.alias("slug"), F.concat(F.lit("ent:"), slug).alias("entity_id"), F.format_string("%s#m%04d", F.col("video_id"), F.lit(7)).alias("moment_id")).distinct()


def content_hash_ids(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "videos").select("video_id", "source_url", "content_hash").distinct()
    key = F.when(F.coalesce(F.col("content_hash"), F.lit("")) != "", F.concat(F.lit("vid:"), F.substring("content_hash", 1, 16))).otherwise(F.concat(F.lit("vid:"), F.substring(F.sha1(F.coalesce("source_url", F.lit(""))), 1, 16)))
    return v.select("video_id", key.alias("made_id"), F.sha1(F.coalesce("source_url", F.lit(""))).alias("url_sha1"), F.sha2(F.coalesce("source_url", F.lit("")), 256).alias("url_sha256"), F.substring(F.md5(F.coalesce("source_url", F.lit(""))), 1, 8).alias("short"))


def _urls(df: DataFrame) -> DataFrame:
    """URLs of several sites' forms, made from the ids."""
    code = F.substring(F.sha1("video_id"), 1, 11)
    k = F.pmod(F.conv(F.substring(F.sha1("video_id"), 1, 4), 16, 10).cast("bigint"), F.lit(5))
    url = (
        F.when(k == 0, F.concat(F.lit("https://www.youtube.com/watch?v="), code)).when(k == 1, F.concat(F.lit("https://youtu.be/"), code)).when(k == 2, F.concat(F.lit("https://www.youtube.com/shorts/"), code, F.lit("?feature=share"))).when(k == 3, F.concat(F.lit("https://www.youtube.com/watch?app=desktop&v="), code)).otherwise(F.col("source_url"))
    )
    return df.withColumn("url", url)


def video_site_ids(spark: SparkSession, d: str) -> DataFrame:
    v = _urls(table(spark, d, "videos").select("video_id", "source_url").distinct())
    return v.select("video_id", "url", F.coalesce(F.concat(F.lit("yt:"), X.video_key(F.col("url"))), F.lit("-")).alias("site_id"))


def deep_links(spark: SparkSession, d: str) -> DataFrame:
    v = _urls(table(spark, d, "videos").select("video_id", "source_url").distinct())
    m = once(table(spark, d, "moments").select("moment_id", "video_id", "t_start_s", "t_end_s"), "moment_id").where(~F.isnan("t_start_s") & (F.abs("t_start_s") < 1e9))
    return m.join(v, "video_id").select("moment_id", X.deep_link(F.col("url"), F.col("t_start_s")).alias("link"), X.ranged_link(F.col("url"), F.col("t_start_s"), F.col("t_end_s")).alias("range_link"))


def hms_format(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "segments").where("start_s is not null").select("seg_id", X.hms(F.floor("start_s")).alias("at")).distinct()


def published_dates(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "videos").select("video_id", "published_at").distinct()
    return v.select("video_id", F.date_format(X.iso_timestamp(F.col("published_at")), "yyyy-MM-dd").alias("published"))


def snippets(spark: SparkSession, d: str) -> DataFrame:
    return once(table(spark, d, "moments").select("moment_id", "transcript"), "moment_id").select("moment_id", X.truncate(F.col("transcript"), 240).alias("snippet"))


def caption_clean(spark: SparkSession, d: str) -> DataFrame:
    return once(table(spark, d, "segments").select("seg_id", "text"), "seg_id").select("seg_id", X.clean_caption(F.col("text")).alias("clean"))


def event_extract(spark: SparkSession, d: str) -> DataFrame:
    s = once(table(spark, d, "segments").select("seg_id", "text"), "seg_id")
    return s.select("seg_id", F.posexplode(X.events_in(F.col("text")))).select("seg_id", F.col("pos").cast("bigint").alias("pos"), F.col("col").alias("event"))


def claim_features(spark: SparkSession, d: str) -> DataFrame:
    c = once(table(spark, d, "claims").where("text is not null").select("claim_id", "text"), "claim_id")
    return c.select("claim_id", X.epistemic_type(F.col("text")).alias("kind"), X.six(X.salience(F.col("text"))).alias("score"), X.low_value(F.col("text")).alias("low_value"), X.normalized(F.col("text")).alias("norm"))


def spo_split(spark: SparkSession, d: str) -> DataFrame:
    c = once(table(spark, d, "claims").where("text is not null").select("claim_id", "text"), "claim_id")
    s, p, o = X.subject_object(F.col("text"))
    return c.select("claim_id", s.alias("subj"), p.alias("pred"), o.alias("ob"))


def mentions_extract(spark: SparkSession, d: str) -> DataFrame:
    """Mentions of text, subject and object of every claim."""
    c = once(table(spark, d, "claims").where("text is not null").select("claim_id", "text", "subject", "obj"), "claim_id")
    return c.select("claim_id", F.explode(X.mentions_of(*map(F.col, ("text", "subject", "obj")))).alias("mention"))


def qualifier_fields(spark: SparkSession, d: str) -> DataFrame:
    c = once(table(spark, d, "claims").where("qualifiers is not null").select("claim_id", "qualifiers"), "claim_id")
    return c.select("claim_id", X.json_field(F.col("qualifiers"), "hedge").alias("hedge"))


def counts_by_status(spark: SparkSession, d: str) -> DataFrame:
    c = once(table(spark, d, "claims").select("claim_id", "status", "claim_type", "salience"), "claim_id")
    return c.groupBy(F.coalesce("status", F.lit("-")).alias("status")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.upper(F.trim("claim_type")) == "FACT").alias("n_fact"), F.count("salience").alias("n_scored"))


def recency_weight(spark: SparkSession, d: str) -> DataFrame:
    """0.5 ^ (age / half life of 365 days) against the newest date."""
    v = table(spark, d, "videos").select("video_id", F.to_date(X.iso_timestamp(F.col("published_at"))).alias("day")).distinct().where("day is not null")
    newest = v.agg(F.max("day").alias("newest"))
    age = F.datediff("newest", "day")
    return v.crossJoin(F.broadcast(newest)).select("video_id", X.six(F.pow(F.lit(0.5), age / F.lit(365.0))).alias("weight"))  # one row, a scalar


QUERIES = {f.__name__: f for f in (tokenize_counts, sentence_split, doc_freq, topic_label_top3, slug_ids, content_hash_ids, video_site_ids, deep_links, hms_format, published_dates, snippets, caption_clean, event_extract, claim_features, spo_split, mentions_extract, qualifier_fields, counts_by_status, recency_weight)}

_M = Q.unique("moments", "moment_id", "video_id transcript topic_id t_start_s t_end_s")
_C = Q.unique("claims", "claim_id", "text subject obj status claim_type salience qualifiers")
_S = Q.unique("segments", "seg_id", "text")
_URL = """(select distinct video_id, case k when 0 then 'https://www.youtube.com/watch?v=' || code when 1 then 'https://youtu.be/' || code when 2 then 'https://www.youtube.com/shorts/' || code || '?feature=share'
 when 3 then 'https://www.youtube.com/watch?app=desktop&v=' || code else source_url end url
 from (select video_id, source_url, substring(sha1(video_id), 1, 11) code, cast('0x' || substring(sha1(video_id), 1, 4) as bigint) % 5 k from videos))"""
_KEY = Q.site_key("url")
_DAY = r"""case when regexp_matches(p, '^\d{8}$') then try_strptime(p, '%Y%m%d') when regexp_matches(p, '^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?)?(Z|[+-]\d{2}:?\d{2})?$') then try_cast(try_cast(regexp_replace(p, '([+-]\d{2})(\d{2})$', '\1:\2') as timestamptz) at time zone 'UTC' as timestamp) end"""

SQL = {
    "tokenize_counts": f"select doc_id, len({Q.tokens('text')})::bigint as n_tokens, len(list_distinct({Q.tokens('text')}))::bigint as n_distinct from documents",
    "sentence_split": f"select moment_id, len(s)::bigint as n_sentences, coalesce(list_max(list_transform(s, lambda x: length(x))), 0)::bigint as longest from (select moment_id, {Q.sentences('transcript')} s from {_M})",
    "doc_freq": f"select term, count(*) as df from (select unnest(list_distinct({Q.tokens('text')})) term from documents) group by term",
    "topic_label_top3": f"""select topic_id, string_agg(t, ' ' order by r) as label from (select *, row_number() over (partition by topic_id order by n desc, t) r from
 (select topic_id, t, count(*) n from (select topic_id, unnest({Q.content_tokens('transcript')}) t from {_M} where topic_id is not null) group by 1, 2)) where r <= 3 group by 1""",
    "slug_ids": f"select distinct video_id, {Q.slugify('title')} as slug, 'ent:' || {Q.slugify('title')} as entity_id, video_id || '#m0007' as moment_id from videos",
    "content_hash_ids": """select distinct video_id, case when coalesce(content_hash, '') <> '' then 'vid:' || substring(content_hash, 1, 16) else 'vid:' || substring(sha1(coalesce(source_url, '')), 1, 16) end as made_id,
 sha1(coalesce(source_url, '')) as url_sha1, sha256(coalesce(source_url, '')) as url_sha256, substring(md5(coalesce(source_url, '')), 1, 8) as short from videos""",
    "video_site_ids": f"select video_id, url, coalesce('yt:' || {_KEY}, '-') as site_id from {_URL}",
    "deep_links": f"""select moment_id, case when key is not null then 'https://youtu.be/' || key || '?t=' || t else url || case when instr(url, '?') > 0 then '&' else '#' end || 't=' || t end as link,
 case when key is not null then 'https://www.youtube.com/watch?v=' || key || '&start=' || t || '&end=' || e else url || case when instr(url, '?') > 0 then '&' else '#' end || 't=' || t end as range_link
 from (select *, {_KEY} key, trunc(t_start_s)::bigint t, case when isfinite(t_end_s) and abs(t_end_s) < 1e15 then trunc(t_end_s) else 0 end::bigint e from {_M} join {_URL} using (video_id) where not isnan(t_start_s) and abs(t_start_s) < 1e9)""",
    "hms_format": """select distinct seg_id, case when h > 0 then h || ':' || lpad(m::varchar, 2, '0') || ':' || lpad(x::varchar, 2, '0') else m || ':' || lpad(x::varchar, 2, '0') end as at
 from (select seg_id, s // 3600 h, (s // 60) % 60 m, s % 60 x from (select seg_id, greatest(0, floor(start_s)::bigint) s from segments where start_s is not null))""",
    "published_dates": f"select distinct video_id, strftime({_DAY}, '%Y-%m-%d') as published from (select video_id, trim(published_at) p from videos)",
    "snippets": f"select moment_id, case when length(s) > 240 then rtrim(substring(s, 1, 239), ' ') || '…' else s end as snippet from (select moment_id, trim(regexp_replace(coalesce(transcript, ''), '[\\r\\n]', ' ', 'g'), ' ') s from {_M})",
    "caption_clean": f"select seg_id, {Q.clean_caption('text')} as clean from {_S}",
    "event_extract": f"select seg_id, unnest(range(len(e)))::bigint as pos, unnest(e) as event from (select seg_id, {Q.events_in('text')} e from {_S})",
    "claim_features": f"select claim_id, {Q.epistemic_type('text')} as kind, {Q.six(Q.salience('text'))} as score, {Q.low_value('text')} as low_value, {Q.normalized('text')} as norm from {_C} where text is not null",
    "spo_split": f"""select claim_id, case when cue = '' then regexp_replace(trim(text), '[.!]+$', '') else trim(substring(text, 1, loc - 1)) end as subj, cue as pred, case when cue = '' then '' else regexp_replace(trim(substring(text, loc + length(cue) + 2)), '[.!]+$', '') end as ob
 from (select *, case when cue = '' then 0 else instr(lower(text), ' ' || cue || ' ') end loc from (select claim_id, text, {Q.predicate_of('text')} cue from {_C} where text is not null))""",
    "mentions_extract": f"select distinct claim_id, unnest(list_concat({Q.mentions('text')}, {Q.mentions('subject')}, {Q.mentions('obj')})) as mention from {_C} where text is not null",
    "qualifier_fields": f"select claim_id, json_extract_string(qualifiers, '$.hedge') as hedge from {_C} where qualifiers is not null",
    "counts_by_status": f"select coalesce(status, '-') as status, count(*) as n, count(*) filter (where upper(trim(claim_type)) = 'FACT') as n_fact, count(salience) as n_scored from {_C} group by 1",
    "recency_weight": f"select video_id, {Q.six('pow(0.5::double, (max(day) over () - day) / 365.0::double)')} as weight from (select distinct video_id, ({_DAY})::date as day from (select video_id, trim(published_at) p from videos)) where day is not null",
}
