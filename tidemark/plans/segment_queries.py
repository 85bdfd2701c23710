"""Queries of segmentation, windows, interval joins and the visual track."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions import text as X
from tidemark.functions import vectors as V
from tidemark.operators import claims as C
from tidemark.operators import segmentation as S
from tidemark.operators import visual as I
from tidemark.operators.ordered import Ordered
from tidemark.plans import sqltext as Q
from tidemark.plans.text_queries import once
from tidemark.session import table

ms = lambda c: F.floor(F.col(c) * 1000 + 0.5) if isinstance(c, str) else F.floor(c * 1000 + 0.5)


def _speech(spark: SparkSession, d: str) -> DataFrame:
    return S.speech_segments(table(spark, d, "segments"))


def _events(spark: SparkSession, d: str) -> DataFrame:
    return S.audio_events(table(spark, d, "segments"))


def segments_lag_gap(spark: SparkSession, d: str) -> DataFrame:
    return S.with_gaps(_speech(spark, d)).where("before is not null").select("seg_id", ms(F.col("t0") - F.col("before")).alias("gap_ms"))


def event_in_gap(spark: SparkSession, d: str) -> DataFrame:
    return S.event_in_gap(_speech(spark, d), _events(spark, d)).select("seg_id", "heard")


def moments_islands(spark: SparkSession, d: str) -> DataFrame:
    parts = S.speaker_islands(_speech(spark, d), _events(spark, d))
    return parts.groupBy("video_id", "part").agg(F.count(F.lit(1)).alias("n_cues"), F.min("seg_id").alias("least_seg"), ms(F.min("t0")).alias("start_ms"), ms(F.max("t1")).alias("end_ms"))


def _folded(spark: SparkSession, d: str, max_s: float) -> DataFrame:
    rows = S.islands(_speech(spark, d), _events(spark, d)).select("video_id", "island", "seg_id", "t0", "t1", "speaker", "text")
    return S.fold(rows, max_s=max_s).groupBy("video_id", "island", F.col("grp").cast("bigint").alias("grp")).agg(F.count(F.lit(1)).alias("n_cues"), F.min("seg_id").alias("least_seg"))


def moments_fold(spark: SparkSession, d: str) -> DataFrame:
    """Moments by the first four rules, with a length of 20 s, so that the rule of length is met often; the fold runs inside the islands."""
    return _folded(spark, d, 20.0)


def moments_fold_90(spark: SparkSession, d: str) -> DataFrame:
    """Moments by the first four rules, with the length of 90 s."""
    return _folded(spark, d, S.MAX_S)


def moments_text(spark: SparkSession, d: str) -> DataFrame:
    parts = S.speaker_islands(_speech(spark, d), _events(spark, d))
    keys = ["video_id", "part"]
    g = S.group_rows(parts, keys).join(S.dominant(parts, keys), keys, "left")
    return g.select("video_id", "part", F.sha1("transcript").alias("text_sha1"), "n_cues", "speaker_id")


def merge_small(spark: SparkSession, d: str) -> DataFrame:
    parts = S.speaker_islands(_speech(spark, d), _events(spark, d))
    keys = ["video_id", "part"]
    g = S.group_rows(parts, keys).join(S.dominant(parts, keys), keys, "left").withColumnRenamed("part", "no")
    return S.merge_small(g).select("video_id", "no", "merged")


def speaker_carry(spark: SparkSession, d: str) -> DataFrame:
    """The last named speaker and the number of the turn of every segment."""
    rows = Ordered(_speech(spark, d), "video_id", ["t0", "seg_id"]).last_known("who", F.col("speaker"), F.col("speaker").isNotNull()).lag("prior", F.col("who"))
    return rows.with_column("new", F.when(F.col("who").eqNullSafe(F.col("prior")), 0).otherwise(1)).running_sum("turn", F.col("new")).rows().select("seg_id", "who", "turn")


def canonical_spelling(spark: SparkSession, d: str) -> DataFrame:
    """The first spelling in order of time of every speaker label, apart from case."""
    rows = _speech(spark, d).where("speaker is not null")
    return rows.groupBy(F.lower(F.trim("speaker")).alias("label")).agg(F.min_by(F.trim("speaker"), F.struct("t0", "seg_id")).alias("spelling"), F.count(F.lit(1)).alias("n"))


def longest_segment(spark: SparkSession, d: str) -> DataFrame:
    rows = _speech(spark, d).where("speaker is not null")
    return rows.groupBy("video_id", "speaker").agg(F.max_by("seg_id", F.struct(ms(F.col("t1") - F.col("t0")), -F.col("t0"), -F.col("seg_id"))).alias("seg_id"))


def precedes_edges(spark: SparkSession, d: str) -> DataFrame:
    m = once(table(spark, d, "moments").where("video_id is not null and idx is not null").select("moment_id", "video_id", "idx"), "moment_id")
    return Ordered(m, "video_id", ["idx", "moment_id"], F.floor(F.col("idx") / 1000)).lead("dst", F.col("moment_id")).rows().where("dst is not null").select(F.col("moment_id").alias("src"), "dst")


def _committed(spark: SparkSession, d: str, *more: str) -> DataFrame:
    return once(table(spark, d, "claims").where("status = 'committed'").select("claim_id", "moment_id", "video_id", "speaker_id", "claim_type", "subject", "text", *more), "claim_id")


def elaborates_edges(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("moment_id").orderBy("claim_id")
    rows = _committed(spark, d).where("moment_id is not null")
    nxt = rows.withColumn("dst", F.lead("claim_id").over(w)).withColumn("who", F.lead("speaker_id").over(w))
    return nxt.where(F.col("dst").isNotNull() & F.col("speaker_id").eqNullSafe(F.col("who"))).select(F.col("claim_id").alias("src"), "dst")


def corrects_asof(spark: SparkSession, d: str) -> DataFrame:
    """Every correction and the nearest earlier claim of its video that shares a content token of the subject or a mention."""
    names = X.mentions_of(*map(F.col, ("text", "subject", "obj")))
    tagged = lambda tag, x: F.transform(F.coalesce(x, F.array().cast("array<string>")), lambda t: F.concat(F.lit(tag), t))
    keys = F.array_union(tagged("subject:", X.content_tokens(F.col("subject"))), tagged("mention:", names))
    has_time = "t_start_s" in table(spark, d, "claims").columns
    at = F.when(F.isnan("t_start_s") | (F.abs("t_start_s") > 1e7), 0.0).otherwise(F.coalesce("t_start_s", F.lit(0.0))) if has_time else F.lit(0.0)
    rows = _committed(spark, d, "obj", at.alias("at")).where("video_id is not null").select("claim_id", "video_id", "at", F.upper(F.trim("claim_type")).alias("kind"), F.explode(keys).alias("t"))
    # The claim before in order of time is the latest with the same key.
    before = F.lag(F.struct("at", "claim_id")).over(Window.partitionBy("video_id", "t").orderBy("at", "claim_id"))
    return rows.withColumn("dst", before).where("kind = 'CORRECTION' and dst is not null").groupBy(F.col("claim_id").alias("src")).agg(F.max("dst")["claim_id"].alias("dst"))


def _spans(spark: SparkSession, d: str, name: str, key: str, start: str, end: str, a: str) -> DataFrame:
    df = table(spark, d, name)
    return once(df.where(S.finite_span(df, start, end) & F.col("video_id").isNotNull()).select("video_id", F.col(key).alias(f"{a}_id"), F.col(start).alias(f"{a}0"), F.col(end).alias(f"{a}1")), f"{a}_id")


def visual_overlap_join(spark: SparkSession, d: str) -> DataFrame:
    pairs = S.overlap_join(_spans(spark, d, "moments", "moment_id", "t_start_s", "t_end_s", "a"), _spans(spark, d, "visual_events", "event_id", "t_start_s", "t_end_s", "b"), 60.0)
    return pairs.select(F.col("a_id").alias("moment_id"), F.col("b_id").alias("event_id"))


def claim_segments(spark: SparkSession, d: str) -> DataFrame:
    """The segments that overlap every claim's span strictly."""
    pairs = S.overlap_join(_spans(spark, d, "claims", "claim_id", "t_start_s", "t_end_s", "a"), _spans(spark, d, "segments", "seg_id", "start_s", "end_s", "b"), 30.0, strict=True)
    return pairs.groupBy(F.col("a_id").alias("claim_id")).agg(F.count(F.lit(1)).alias("n_segments"), F.min("b_id").alias("least_seg"))


def clip_window(spark: SparkSession, d: str) -> DataFrame:
    m = _spans(spark, d, "moments", "moment_id", "t_start_s", "t_end_s", "a")
    return m.where("a0 <= 120 and a1 >= 60").select("video_id", F.col("a_id").alias("moment_id"))


def locate_span(spark: SparkSession, d: str) -> DataFrame:
    """Every claim's best segment among those its moment overlaps: the greatest token coverage of at least a half, first in time among equals."""
    c = once(table(spark, d, "claims").where("text is not null and moment_id is not null").select("claim_id", "moment_id", "text"), "claim_id")
    m = _spans(spark, d, "moments", "moment_id", "t_start_s", "t_end_s", "a").withColumnRenamed("a_id", "moment_id")
    seg = table(spark, d, "segments")
    cues = once(seg.where(S.finite_span(seg, "start_s", "end_s") & F.col("video_id").isNotNull() & F.col("text").isNotNull()).select("video_id", "seg_id", F.col("start_s").alias("b0"), F.col("end_s").alias("b1"), "text"), "seg_id")
    return C.locate(c.join(m, "moment_id"), cues).select("claim_id", "seg_id", "shared")


def event_ends(spark: SparkSession, d: str) -> DataFrame:
    f = I.frames(table(spark, d, "visual_events")).drop("embedding")
    return Ordered(f, "video_id", ["t_start_s", "event_id"]).lead("next", F.col("t_start_s")).rows().select("event_id", ms(F.coalesce("next", "t_start_s")).alias("end_ms"))


def scene_cuts(spark: SparkSession, d: str) -> DataFrame:
    return I.scene_cuts(I.frames(table(spark, d, "visual_events"))).select("event_id", "scene")


def keyframes(spark: SparkSession, d: str) -> DataFrame:
    return I.keyframes(I.scene_cuts(I.frames(table(spark, d, "visual_events")), cut=0.35), gain=0.05).select("event_id", "scene")


def keyframes_default(spark: SparkSession, d: str) -> DataFrame:
    """Keyframes with the cut, gain and cap of the defaults."""
    return I.keyframes(I.scene_cuts(I.frames(table(spark, d, "visual_events")))).select("event_id", "scene")


def frame_class(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "visual_events").where(V.usable(F.col("embedding"), 64))
    return once(e.select("event_id", "embedding", "ocr_text"), "event_id").select("event_id", I.frame_class(F.col("embedding"), F.col("ocr_text")).alias("kind"))


def mean_vector(spark: SparkSession, d: str) -> DataFrame:
    f = I.frames(table(spark, d, "visual_events"))
    return I.mean_vector(f, "video_id", "embedding").select("video_id", F.col("at").cast("bigint").alias("pos"), X.six(F.col("mean")).alias("mean"))


def ocr_fusion(spark: SparkSession, d: str) -> DataFrame:
    """The distinct on-screen texts of the events that overlap every moment, in order of time."""
    e = table(spark, d, "visual_events")
    b = once(e.where(S.finite_span(e, "t_start_s", "t_end_s") & F.col("video_id").isNotNull() & (F.trim("ocr_text") != "")).select("video_id", F.col("event_id").alias("b_id"), F.col("t_start_s").alias("b0"), F.col("t_end_s").alias("b1"), F.trim("ocr_text").alias("ocr")), "b_id")
    pairs = S.overlap_join(_spans(spark, d, "moments", "moment_id", "t_start_s", "t_end_s", "a"), b, 60.0)
    first = pairs.groupBy("a_id", "ocr").agg(F.min(F.struct("b0", "b_id")).alias("k"))
    return first.groupBy(F.col("a_id").alias("moment_id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "ocr"))), lambda x: x["ocr"]), " ").alias("ocr"))


QUERIES = {f.__name__: f for f in (segments_lag_gap, event_in_gap, moments_islands, moments_fold, moments_fold_90, moments_text, merge_small, speaker_carry, canonical_spelling, longest_segment, precedes_edges, elaborates_edges, corrects_asof, visual_overlap_join, claim_segments, clip_window, locate_span, event_ends, scene_cuts, keyframes, keyframes_default, frame_class, mean_vector, ocr_fusion)}

_SP = """sp as (select seg_id, any_value(video_id) video_id, any_value(start_s) t0, any_value(end_s) t1, any_value(speaker) speaker, any_value(text) text from segments
 where lower(kind) = 'speech' and trim(text, ' ') <> '' and video_id is not null and isfinite(start_s) and isfinite(end_s) group by seg_id),
gp as (select *, lag(t1) over (partition by video_id order by t0, seg_id) before from sp)"""
_EV = _SP + """,
ev as (select distinct video_id, start_s at_s from segments where lower(kind) = 'event' and video_id is not null and start_s is not null and not isnan(start_s)),
gh as (select g.*, exists (select 1 from ev where ev.video_id = g.video_id and at_s >= g.before and at_s <= g.t0) heard from gp g),
il as (select *, sum(case when before is null or t0 - before > 2.5 or heard then 1 else 0 end) over (partition by video_id order by t0, seg_id) - 1 island from gh)"""
_PT = _EV + """,
kn as (select *, last_value(speaker ignore nulls) over (partition by video_id, island order by t0, seg_id rows between unbounded preceding and 1 preceding) known, row_number() over (partition by video_id, island order by t0, seg_id) rn from il),
pt as (select *, (sum(case when rn = 1 or speaker <> known then 1 else 0 end) over (partition by video_id order by t0, seg_id) - 1)::bigint part from kn)"""
_DOM = """,
ct as (select video_id, part, speaker, count(*) n, min((t0, seg_id)) f from pt where speaker is not null group by all),
dm as (select video_id, part, arg_min(speaker, (-n, f)) speaker_id from ct group by all)"""
_MS = lambda c: f"floor(({c}) * 1000 + 0.5)::bigint"


def _span_sql(name: str, key: str, start: str, end: str, more: str = "", where: str = "") -> str:
    return f"(select {key}, any_value(video_id) video_id, any_value({start}) s, any_value({end}) e{more} from {name} where video_id is not null and not isnan({start}) and not isnan({end}) and abs({start}) < 1e7 and abs({end}) < 1e7 and {start} >= 0 and {end} >= {start}{where} group by {key})"


_MOM = _span_sql("moments", "moment_id", "t_start_s", "t_end_s")
_FR = """fr as (select event_id, any_value(video_id) video_id, any_value(t_start_s) t, any_value(embedding) v from visual_events where video_id is not null and not isnan(t_start_s) and abs(t_start_s) < 1e7
 and len(embedding) = 64 and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = 64 group by event_id)"""
_DIST = lambda a, b: f"(list_reduce(list_prepend(0.0::double, list_transform(list_zip({a}, {b}), lambda z: abs(z[1] - z[2]))), lambda p, q: p + q) / 64)"

SQL = {
    "segments_lag_gap": f"with {_SP} select seg_id, {_MS('t0 - before')} as gap_ms from gp where before is not null",
    "event_in_gap": f"with {_EV} select seg_id, heard from gh",
    "moments_islands": f"with {_PT} select video_id, part, count(*) as n_cues, min(seg_id) as least_seg, {_MS('min(t0)')} as start_ms, {_MS('max(t1)')} as end_ms from pt group by 1, 2",
    **{name: f"""with recursive {_EV},
o as (select *, row_number() over (partition by video_id, island order by t0, seg_id) rn from il),
f as (select video_id, island, rn, seg_id, 0::bigint grp, t0 g0, t1 g1, speaker who from o where rn = 1
 union all select o.video_id, o.island, o.rn, o.seg_id, grp + c, case when c = 1 then o.t0 else g0 end, o.t1, case when c = 1 then o.speaker else coalesce(nullif(who, ''), o.speaker) end
 from (select f.*, o.rn nrn, case when (o.speaker <> '' and who <> '' and o.speaker <> who) or g1 - g0 >= {most} then 1 else 0 end c from f join o on o.video_id = f.video_id and o.island = f.island and o.rn = f.rn + 1) f
 join o on o.video_id = f.video_id and o.island = f.island and o.rn = f.nrn)
select video_id, island::bigint as island, grp, count(*) as n_cues, min(seg_id) as least_seg from f group by all""" for name, most in (("moments_fold", 20), ("moments_fold_90", 90))},
    "moments_text": f"""with {_PT}{_DOM} select g.video_id, g.part, text_sha1, n_cues, speaker_id from (select video_id, part, sha1(string_agg(trim(text, ' '), ' ' order by t0, seg_id)) as text_sha1, count(*)::int as n_cues from pt group by 1, 2) g
 left join dm using (video_id, part)""",
    "merge_small": f"""with {_PT}{_DOM}, g as (select video_id, part no, min(t0) t_start, arg_max(t1, (t0, seg_id)) last_end from pt group by 1, 2),
j as (select g.*, speaker_id from g left join dm on dm.video_id = g.video_id and dm.part = g.no)
select video_id, no, (sum(case when short and same then 0 else 1 end) over (partition by video_id order by no) - 1)::bigint as merged from (select *, last_end - t_start < 8 short,
 speaker_id is not distinct from lag(speaker_id) over (partition by video_id order by no) and lag(no) over (partition by video_id order by no) is not null same from j)""",
    "speaker_carry": f"""with {_SP}, w as (select *, last_value(speaker ignore nulls) over (partition by video_id order by t0, seg_id rows between unbounded preceding and current row) who from sp),
c as (select *, case when row_number() over o > 1 and who is not distinct from lag(who) over o then 0 when who is null and row_number() over o = 1 then 0 else 1 end c from w window o as (partition by video_id order by t0, seg_id))
select seg_id, who, sum(c) over (partition by video_id order by t0, seg_id)::bigint as turn from c""",
    "canonical_spelling": f"with {_SP} select lower(trim(speaker, ' ')) as label, arg_min(trim(speaker, ' '), (t0, seg_id)) as spelling, count(*) as n from sp where speaker is not null group by 1",
    "longest_segment": f"with {_SP} select video_id, speaker, arg_max(seg_id, ({_MS('t1 - t0')}, -t0, -seg_id)) as seg_id from sp where speaker is not null group by 1, 2",
    "precedes_edges": f"select src, dst from (select moment_id as src, lead(moment_id) over (partition by video_id order by idx, moment_id) as dst from {Q.unique('moments', 'moment_id', 'video_id idx')} where video_id is not null and idx is not null) where dst is not null",
    "elaborates_edges": f"""select src, dst from (select claim_id as src, lead(claim_id) over w as dst, speaker_id, lead(speaker_id) over w who from {Q.unique('claims', 'claim_id', 'moment_id speaker_id status')} where status = 'committed' and moment_id is not null
 window w as (partition by moment_id order by claim_id)) where dst is not null and speaker_id is not distinct from who""",
    "corrects_asof": f"""with r as (select claim_id, video_id, upper(trim(claim_type)) kind, case when isnan(t_start_s) or abs(t_start_s) > 1e7 then 0 else coalesce(t_start_s, 0) end ct,
 unnest(list_distinct(list_concat(list_transform({Q.content_tokens('subject')}, lambda x: 'subject:' || x), list_transform(list_concat({Q.mentions('text')}, {Q.mentions('subject')}, {Q.mentions('obj')}), lambda x: 'mention:' || x)))) t
 from {Q.unique('claims', 'claim_id', 'video_id claim_type subject text obj status t_start_s')} where status = 'committed' and video_id is not null)
 select a.claim_id as src, arg_max(b.claim_id, (b.ct, b.claim_id)) as dst from r a join r b on a.video_id = b.video_id and a.t = b.t and (b.ct, b.claim_id) < (a.ct, a.claim_id) where a.kind = 'CORRECTION' group by 1""",
    "visual_overlap_join": f"select moment_id, event_id from {_MOM} m join {_span_sql('visual_events', 'event_id', 't_start_s', 't_end_s')} v on m.video_id = v.video_id and m.s <= v.e and m.e >= v.s",
    "claim_segments": f"select claim_id, count(*) as n_segments, min(seg_id) as least_seg from {_span_sql('claims', 'claim_id', 't_start_s', 't_end_s')} c join {_span_sql('segments', 'seg_id', 'start_s', 'end_s')} g on c.video_id = g.video_id and c.s < g.e and c.e > g.s group by 1",
    "clip_window": f"select video_id, moment_id from {_MOM} where s <= 120 and e >= 60",
    "locate_span": f"""with c as (select claim_id, moment_id, list_distinct({Q.tokens('text')}) ct from {Q.unique('claims', 'claim_id', 'moment_id text')} where text is not null and moment_id is not null),
g as (select seg_id, video_id, s, e, list_distinct({Q.tokens('text')}) st from {_span_sql('segments', 'seg_id', 'start_s', 'end_s', ', any_value(text) text', ' and text is not null')}),
p as (select claim_id, seg_id, g.s, len(list_intersect(st, ct)) n, len(ct) k from c join {_MOM} m using (moment_id) join g on g.video_id = m.video_id and m.s <= g.e and m.e >= g.s)
select claim_id, arg_min(seg_id, (-n, s, seg_id)) as seg_id, max(n)::bigint as shared from p where 2 * n >= k and n > 0 group by 1""",
    "event_ends": f"with {_FR} select event_id, {_MS('coalesce(lead(t) over (partition by video_id order by t, event_id), t)')} as end_ms from fr",
    "scene_cuts": f"""with {_FR}, l as (select *, lag(v) over (partition by video_id order by t, event_id) b from fr)
select event_id, sum(case when b is not null and {_DIST('b', 'v')} > 0.3 then 1 else 0 end) over (partition by video_id order by t, event_id)::bigint as scene from l""",
    **{name: f"""with recursive {_FR}, l as (select *, lag(v) over (partition by video_id order by t, event_id) b from fr),
sc as (select *, sum(case when b is not null and {_DIST('b', 'v')} > {cut} then 1 else 0 end) over (partition by video_id order by t, event_id)::bigint scene from l),
o as (select *, row_number() over (partition by video_id, scene order by t, event_id) rn from sc),
f as (select video_id, scene, rn, event_id, v kept, 1 n, true keep from o where rn = 1
 union all select video_id, scene, rn, event_id, case when k then v else kept end, n + k::int, k from (select o.*, f.kept, f.n, f.n < 8 and {_DIST('f.kept', 'o.v')} >= {gain} k from f join o on o.video_id = f.video_id and o.scene = f.scene and o.rn = f.rn + 1))
select event_id, scene from f where keep""" for name, cut, gain in (("keyframes", 0.35, 0.05), ("keyframes_default", 0.3, 0.12))},
    "frame_class": f"""select event_id, case when n >= 30 then 'document' when n >= 8 then 'slide' when list_reduce(list_prepend(0.0::double, list_transform(v, lambda x: (x - m) * (x - m))), lambda p, q: p + q) / 64 >= 0.05 then 'diagram' else 'talking_head' end as kind
 from (select *, list_reduce(list_prepend(0.0::double, v), lambda p, q: p + q) / 64 m from (select event_id, any_value(embedding) v, any_value(len(list_filter(regexp_split_to_array(trim(coalesce(ocr_text, '')), '\\s+'), lambda w: w <> ''))) n from visual_events
 where len(embedding) = 64 and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = 64 group by event_id))""",
    "mean_vector": f"with {_FR} select video_id, pos::bigint as pos, {Q.six('avg(x)')} as mean from (select video_id, unnest(range(64)) pos, unnest(v) x from fr) group by 1, 2",
    "ocr_fusion": f"""select moment_id, string_agg(ocr, ' ' order by k) as ocr from (select moment_id, ocr, min((v.s, event_id)) k from {_MOM} m join {_span_sql('visual_events', 'event_id', 't_start_s', 't_end_s', ", any_value(trim(ocr_text, ' ')) ocr", " and trim(ocr_text, ' ') <> ''")} v
 on m.video_id = v.video_id and m.s <= v.e and m.e >= v.s group by 1, 2) group by 1""",
}
