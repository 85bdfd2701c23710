"""Queries of retrieval: the questions are the probes whose id is divisible by 100, against all moments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions import text as X
from tidemark.functions import vectors as V
from tidemark.functions import fixed as W
from tidemark.operators import retrieval as R
from tidemark.operators import visual as I
from tidemark.plans import sqltext as Q
from tidemark.plans.text_queries import _DAY, once
from tidemark.session import materialize, table


def questions(spark: SparkSession, d: str) -> DataFrame:
    return once(table(spark, d, "iterm_probes").where("probe_id % 100 = 0 and q is not null").select(F.col("probe_id").alias("qid"), F.col("q").alias("question")), "qid")


def corpus(spark: SparkSession, d: str) -> DataFrame:
    return once(table(spark, d, "moments").where("transcript is not null").select(F.col("moment_id").alias("key"), F.col("transcript").alias("text")), "key")


def hash_embed(spark: SparkSession, d: str) -> DataFrame:
    return V.hash_cells(corpus(spark, d), "key", "text").select(F.col("key").alias("moment_id"), F.col("cell").cast("bigint").alias("cell"), "weight")


def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    return R.bm25(questions(spark, d), corpus(spark, d), 24).select("qid", F.col("key").alias("moment_id"), "score")


def dense_topk(spark: SparkSession, d: str) -> DataFrame:
    return R.dense(questions(spark, d), corpus(spark, d), 24).select("qid", F.col("key").alias("moment_id"), "score")


def _hybrid(spark: SparkSession, d: str) -> DataFrame:
    return R.hybrid(questions(spark, d), corpus(spark, d), 8)


def rrf_hybrid(spark: SparkSession, d: str) -> DataFrame:
    return _hybrid(spark, d).select("qid", F.col("key").alias("moment_id"), F.col("rank").cast("bigint").alias("rank"), X.six(F.col("score")).alias("score"))


def round_robin_merge(spark: SparkSession, d: str) -> DataFrame:
    found = R.search(questions(spark, d), corpus(spark, d), 24)
    legs = [R.ranked(found.where(F.col("leg") == leg), 24) for leg in ("lexical", "dense")]
    return R.round_robin(legs, 8).select("qid", F.col("key").alias("moment_id"), F.col("rank").cast("bigint").alias("rank"))


def decay_rerank(spark: SparkSession, d: str) -> DataFrame:
    m = once(table(spark, d, "moments").select("moment_id", "video_id"), "moment_id")
    v = table(spark, d, "videos").select("video_id", F.to_date(X.iso_timestamp(F.col("published_at"))).alias("day")).distinct()
    dates = m.join(v, "video_id").select(F.col("moment_id").alias("key"), "day")
    claims = table(spark, d, "claims").select(F.col("moment_id").alias("key"), "status")
    return R.decay(_hybrid(spark, d), dates, claims).select("qid", F.col("key").alias("moment_id"), X.six(F.col("score")).alias("score"))


def _cited(spark: SparkSession, d: str) -> DataFrame:
    sane = lambda c: F.when(F.isnan(c) | (F.abs(c) > 1e7), None).otherwise(F.col(c)).alias(c)
    m = once(table(spark, d, "moments").select("moment_id", "video_id", "transcript", "ocr_text", "visual_caption", sane("t_start_s"), sane("t_end_s")), "moment_id")
    v = table(spark, d, "videos").select("video_id", "source_url", "title").distinct()
    return R.citations(_hybrid(spark, d), questions(spark, d), m, v)


def citation_rows(spark: SparkSession, d: str) -> DataFrame:
    return _cited(spark, d).select("qid", F.col("idx").cast("bigint").alias("idx"), "moment_id", "snippet", "link", X.six(F.col("confidence")).alias("confidence"), "modality", "ocr_unverified")


def _common(spark: SparkSession, d: str) -> list[str]:
    """The common words of English, a fixed table."""
    return sorted({r[0] for r in table(spark, d, "common_words").where("lang = 'en' and word is not null").select(F.lower("word")).limit(10_000).collect()})


def relevance_gate(spark: SparkSession, d: str) -> DataFrame:
    return R.relevance(materialize(_cited(spark, d)), corpus(spark, d), _common(spark, d)).select("qid", X.six(F.col("relevance")).alias("relevance"))


def ask_answers(spark: SparkSession, d: str) -> DataFrame:
    """The whole question flow: retrieve, cite, gate, answer."""
    cited = materialize(_cited(spark, d))
    return R.answers(cited, R.relevance(cited, corpus(spark, d), _common(spark, d)))


def stitch_clips(spark: SparkSession, d: str) -> DataFrame:
    spans = _cited(spark, d).where("t_start_s is not null and t_end_s is not null")
    return R.stitch(spans.select("qid", "video_id", "t_start_s", "t_end_s", "idx"), 60.0).select("qid", "video_id", F.col("clip").cast("bigint").alias("clip"), F.floor(F.col("t_start_s") * 1000 + 0.5).alias("start_ms"), "n")


def temporal_order(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "videos").select("video_id", F.to_date(X.iso_timestamp(F.col("published_at"))).alias("day")).distinct()
    w = Window.partitionBy("qid").orderBy(F.col("day").isNull(), "day", "idx")
    return _cited(spark, d).select("qid", "idx", "moment_id", "video_id").join(v, "video_id", "left").select("qid", "moment_id", F.row_number().over(w).cast("bigint").alias("idx"))


def question_plans(spark: SparkSession, d: str) -> DataFrame:
    p = once(table(spark, d, "iterm_probes").where("q is not null").select("probe_id", "q"), "probe_id")
    both = F.concat(F.regexp_replace(F.trim("q"), r"\?\s*$", ""), F.lit(", and "), F.lower(F.trim("q")))
    return p.select("probe_id", R.strategy(F.col("q")).alias("strategy"), F.size(R.decompose(both)).cast("bigint").alias("n_parts"))


def retrieval_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Hit rate, mean reciprocal rank and nDCG of the fused list against the cited videos."""
    gold = once(table(spark, d, "iterm_probes").select(F.col("probe_id").alias("qid"), "cite_videos"), "qid")
    m = once(table(spark, d, "moments").select(F.col("moment_id").alias("key"), "video_id"), "key")
    rows = _hybrid(spark, d).join(m, "key").join(gold, "qid").withColumn("hit", F.coalesce(F.array_contains("cite_videos", F.col("video_id")), F.lit(False)).cast("int"))
    per = rows.groupBy("qid").agg(F.max("hit").alias("hit"), F.coalesce(F.max(F.when(F.col("hit") == 1, 1.0 / (F.col("rank") + 1))), F.lit(0.0)).alias("rr"), F.sum(F.col("hit") / F.log2(F.col("rank") + 2.0)).alias("dcg"), F.sum("hit").alias("n_hit"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.greatest(F.col("n_hit"), F.lit(1)).cast("int")), F.lit(0.0), lambda s, i: s + 1.0 / F.log2(i + 1.0))
    return per.agg(F.count(F.lit(1)).alias("n"), X.six(F.avg("hit")).alias("hit_rate"), X.six(F.avg("rr")).alias("mrr"), X.six(F.avg(F.when(F.col("n_hit") > 0, F.col("dcg") / ideal).otherwise(0.0))).alias("ndcg"))


def graph_leg(spark: SparkSession, d: str) -> DataFrame:
    """What the relations of the pairs' table reach in one hop from the fused moments of every question."""
    claims = once(table(spark, d, "claims").select("claim_id", "moment_id", "status"), "claim_id")
    p = table(spark, d, "contradiction_pairs").where("claim_a is not null and claim_b is not null")
    edges = p.select(F.col("claim_a").alias("src"), F.upper(F.trim(F.coalesce("relation", F.lit("")))).alias("rel"), F.col("claim_b").alias("dst"))
    return R.graph_leg(_hybrid(spark, d), claims, edges, ["CONTRADICTS", "SUPPORTS"]).select("qid", F.col("key").alias("moment_id"), "score")


def scoped_search(spark: SparkSession, d: str) -> DataFrame:
    """The five best moments of every question within the first video that its probe cites, by the dense leg."""
    first = once(table(spark, d, "iterm_probes").select(F.col("probe_id").alias("qid"), F.get("cite_videos", 0).alias("video_id")), "qid")
    q = questions(spark, d).join(first.where("video_id is not null"), "qid")
    c = once(table(spark, d, "moments").where("transcript is not null").select(F.col("moment_id").alias("key"), "video_id", F.col("transcript").alias("text")), "key")
    return R.ranked(R.search(q, c, 5, ("dense",)), 5).select("qid", F.col("key").alias("moment_id"), "score")


def visual_topk(spark: SparkSession, d: str) -> DataFrame:
    """The five videos whose mean frame is most similar to the frame of every event whose id is divisible by 100."""
    f = I.frames(table(spark, d, "visual_events"))
    mean = I.mean_vector(f, "video_id", "embedding").groupBy("video_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "mean"))), lambda x: x["mean"]).alias("vec"))
    q = f.where("event_id % 100 = 0").select(F.col("event_id").alias("qid"), F.col("embedding").alias("vec"))
    return R.vector_search(q, mean.withColumnRenamed("video_id", "key"), 5).select("qid", F.col("key").alias("video_id"), "score")


def vector_topk(spark: SparkSession, d: str) -> DataFrame:
    """The ten most similar embeddings of every embedding whose id is divisible by 100, by exact cosine against all."""
    e = table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("vec"))
    q = e.where("vec_id % 100 = 0").withColumnRenamed("vec_id", "qid")
    near = R.vector_search(q, e.withColumnRenamed("vec_id", "key"), 11).where("key <> qid").drop("rank")
    return R.ranked(near, 10).select("qid", F.col("key").alias("vec_id"), F.col("rank").cast("bigint").alias("rank"), "score")


def recall_at_k(spark: SparkSession, d: str) -> DataFrame:
    """Share of the exact ten neighbours that a search within the question's own label finds."""
    top = vector_topk(spark, d)
    labels = table(spark, d, "embeddings").select("vec_id", "label")
    rows = top.join(labels, "vec_id").join(labels.select(F.col("vec_id").alias("qid"), F.col("label").alias("ql")), "qid")
    return rows.groupBy("qid").agg(X.six(F.sum(F.when(F.col("label") == F.col("ql"), 1).otherwise(0)) / 10.0).alias("recall"))


QUERIES = {f.__name__: f for f in (hash_embed, bm25_topk, dense_topk, rrf_hybrid, round_robin_merge, decay_rerank, citation_rows, relevance_gate, ask_answers, stitch_clips, temporal_order, question_plans, graph_leg, scoped_search, visual_topk, retrieval_metrics, vector_topk, recall_at_k)}

_P = Q.unique("iterm_probes", "probe_id", "q cite_videos")
_GRAMS = lambda t: f"list_concat({t}, list_transform(range(1, len({t})), lambda i: {t}[i] || '_' || {t}[i + 1]))"
_CELLS = lambda key, source: f"(select {key}, cell, sum(s)::bigint w from (select {key}, cast('0x' || substring(md5(g), 7, 2) as bigint) cell, case when cast('0x' || substring(md5(g), 10, 1) as int) % 2 = 1 then 1 else -1 end s from (select {key}, unnest({_GRAMS('ts')}) g from {source})) group by all having sum(s) <> 0)"
_BASE = f"""qs as (select probe_id qid, q question, {Q.tokens('q')} ts from {_P} where probe_id % 100 = 0 and q is not null),
co as (select moment_id mid, transcript txt, {Q.tokens('transcript')} ts from {Q.unique('moments', 'moment_id', 'transcript')} where transcript is not null),
qt as (select qid, unnest(list_distinct(ts)) qterm from qs), dl as (select mid, len(ts) n from co where len(ts) > 0), dt as (select mid, unnest(ts) t from co),
tf as (select qterm, mid, count(*)::double tf from (select distinct qterm from qt) join dt on starts_with(t, qterm) group by all), fq as (select qterm, count(*)::double df from tf group by all),
bm as (select qid, mid, {Q.six("sum(greatest(ln(((select count(*) from dl) - df + 0.5::double) / (df + 0.5::double)), 1e-6::double) * tf * 2.2::double / (tf + 1.2::double * (0.25::double + 0.75::double * n / (select avg(n) from dl))))")} score
 from qt join tf using (qterm) join fq using (qterm) join dl using (mid) group by all),
b1 as (select *, row_number() over (partition by qid order by score desc, mid) - 1 rnk from bm),
qc as (select * from {_CELLS('qid', 'qs')}), dc as (select * from {_CELLS('mid', 'co')}),
de as (select qid, mid, {Q.six('sum(qc.w * dc.w) / (any_value(dn) * any_value(qn))')} score from qc join dc using (cell) join (select mid, sqrt(sum(w * w)::double) dn from dc group by 1) using (mid) join (select qid, sqrt(sum(w * w)::double) qn from qc group by 1) using (qid) group by all),
d1 as (select *, row_number() over (partition by qid order by score desc, mid) - 1 rnk from de),
fu as (select qid, mid, sum(1.0::double / (61 + rnk)) score from (select qid, mid, rnk from d1 where rnk < 24 union all select qid, mid, rnk from b1 where rnk < 24) group by all),
f1 as (select * from (select *, row_number() over (partition by qid order by score desc, mid) - 1 rnk from fu) where rnk < 8)"""
_BEST = f"list_transform(s, lambda x, i: struct_pack(n := -len(list_filter({Q.tokens('x')}, lambda t: list_contains(qtok, t))), i := i, s := x))"
_CITED = f"""{_BASE},
mm as (select moment_id mid, any_value(video_id) video_id, any_value(transcript) txt, any_value(ocr_text) ocr, any_value(visual_caption) cap, any_value(case when isnan(t_start_s) or abs(t_start_s) > 1e7 then null else t_start_s end) t0, any_value(case when isnan(t_end_s) or abs(t_end_s) > 1e7 then null else t_end_s end) t1 from moments group by 1),
vv as (select distinct video_id, source_url, title from videos),
cb as (select f1.*, question, qs.ts qtok, t0, t1, mm.video_id, title, source_url, {Q.strip("coalesce(mm.txt, '')")} said, {Q.strip("coalesce(ocr, '')")} shown, {Q.strip("coalesce(cap, '')")} drawn,
 {Q.strip("case when concat_ws(chr(10), nullif(mm.txt, ''), nullif(ocr, '')) <> '' then concat_ws(chr(10), nullif(mm.txt, ''), nullif(ocr, '')) else coalesce(cap, '') end")} whole from f1 join qs using (qid) join mm on mm.mid = f1.mid left join vv on vv.video_id = mm.video_id),
c0 as (select *, case when len({Q.sentences('basis')}) > 0 then {Q.sentences('basis')} else [coalesce(basis, '')] end s from (select *, case when said <> '' then said else whole end basis from cb)),
c1 as (select *, list_min({_BEST}).s bs from c0),
ci as (select qid, question, said, shown, drawn, rnk + 1 idx, mid, video_id, t0, t1, title, source_url, score, case when length(o) > 240 then rtrim(substring(o, 1, 239), ' ') || '…' else o end snippet, case when length(x) > 600 then rtrim(substring(x, 1, 599), ' ') || '…' else x end src
 from (select *, trim(regexp_replace(trim(bs, ' '), '[\\r\\n]', ' ', 'g'), ' ') o, trim(regexp_replace(whole, '[\\r\\n]', ' ', 'g'), ' ') x from c1))"""
_NAMES = lambda c: f"list_distinct(list_filter({Q.tokens(c)}, lambda t: length(t) > 2 and t not in ({Q.quoted(W.RELEVANCE_STOP)}) and not list_contains(cw, t)))"
_CONTEXT = lambda c: f"list_distinct(list_filter({Q.tokens(c)}, lambda t: length(t) > 2 and t not in ({Q.quoted([*W.RELEVANCE_STOP, *W.COVERAGE_FILLER])})))"
_GATE = f"""{_CITED}, cm as (select list(distinct lower(word)) cw from common_words where lang = 'en' and word is not null),
q2 as (select qid, question, {_NAMES('question')} topic, {_CONTEXT('question')} context from (select distinct qid, question from ci), cm),
td as (select qid, max(df) top_df from (select qid, unnest(topic) t from q2) join (select t, count(distinct mid) df from dt group by 1) using (t) group by 1),
ch as (select qid, {_NAMES('title')} named, {_CONTEXT("concat_ws(' ', case when src <> '' then src else snippet end, title)")} has from ci, cm),
be as (select qid, max(case when list_has_any(topic, has) then len(list_intersect(context, has))::double / len(context) else 0 end) best, bool_or(list_has_any(topic, named)) in_title from ch join q2 using (qid) group by 1),
ga as (select qid, case when nn < 50 then 1.0 when len(context) = 0 then 0.0 when not (coalesce(in_title, false) or coalesce(top_df, 0) >= greatest(2, round_even(0.0009 * nn, 0))) then 0.0 else coalesce(best, 0.0) end rel from q2 left join td using (qid) left join be using (qid), (select count(*) nn from co))"""
_EVD = f"vd as (select distinct video_id, ({_DAY})::date as day from (select video_id, trim(published_at) p from videos))"

SQL = {
    "hash_embed": f"with {_BASE} select mid as moment_id, cell, w as weight from dc",
    "bm25_topk": f"with {_BASE} select qid, mid as moment_id, score from b1 where rnk < 24",
    "dense_topk": f"with {_BASE} select qid, mid as moment_id, score from d1 where rnk < 24",
    "rrf_hybrid": f"with {_BASE} select qid, mid as moment_id, rnk as rank, {Q.six('score')} as score from f1",
    "round_robin_merge": f"with {_BASE}, u as (select qid, mid, min((rnk, leg)) k from (select qid, mid, rnk, 0 leg from b1 where rnk < 24 union all select qid, mid, rnk, 1 from d1 where rnk < 24) group by all), r as (select *, row_number() over (partition by qid order by k) - 1 rank from u) select qid, mid as moment_id, rank from r where rank < 8",
    "decay_rerank": f"""with {_BASE}, {_EVD}, st as (select moment_id, max(case when status = 'committed' then 1 else 0 end) live from claims group by 1), mo as (select moment_id, any_value(video_id) video_id from moments group by 1),
x as (select f1.*, day from f1 join mo on mo.moment_id = mid left join vd using (video_id) left join st on st.moment_id = mid where live is null or live = 1)
select qid, mid as moment_id, {Q.six('score * coalesce(pow(0.5::double, (max(day) over (partition by qid) - day) / 365.0::double), 1.0::double)')} as score from x""",
    "citation_rows": f"with {_CITED} select qid, idx, mid as moment_id, snippet, case when key is not null then 'https://youtu.be/' || key || '?t=' else source_url || case when instr(source_url, '?') > 0 then '&t=' else '#t=' end end || trunc(coalesce(t0, 0))::bigint as link, {Q.six('least(1.0::double, score * 30)')} as confidence, case when said <> '' and (shown <> '' or drawn <> '') then 'both' when said <> '' then 'speech' when shown <> '' or drawn <> '' then 'visual' else 'none' end as modality, shown <> '' or (said = '' and drawn <> '') as ocr_unverified from (select *, {Q.site_key('source_url')} key from ci)",
    "relevance_gate": f"with {_GATE} select qid, {Q.six('rel')} as relevance from ga",
    "ask_answers": f"""with {_GATE}, an as (select qid, string_agg(trim(snippet, ' ') || case when regexp_matches(trim(snippet, ' '), '[.!?]$') then '' else '.' end || ' [' || idx || ']', ' ' order by idx) answer from ci where idx <= 4 and trim(snippet, ' ') <> '' group by 1)
select qid, answer is null or rel < 0.55 as low_evidence, case when answer is null or rel < 0.55 then 'Not enough evidence.' else answer end as answer from ga left join an using (qid)""",
    "stitch_clips": f"""with {_CITED}, w as (select *, max(t1) over (partition by qid, video_id order by t0, t1, idx rows between unbounded preceding and 1 preceding) b from ci where t0 is not null and t1 is not null),
c as (select *, sum(case when b is null or t0 > b + 60 then 1 else 0 end) over (partition by qid, video_id order by t0, t1, idx) - 1 clip from w)
select qid, video_id, clip::bigint as clip, floor(min(t0) * 1000 + 0.5)::bigint as start_ms, count(*) as n from c group by 1, 2, 3""",
    "temporal_order": f"with {_CITED}, {_EVD} select qid, mid as moment_id, row_number() over (partition by qid order by day is null, day, ci.idx) as idx from ci left join vd using (video_id)",
    "question_plans": "select probe_id, case "
    + " ".join(f"when {' or '.join(f'contains(lower(q), {Q.quoted([c])})' for c in cues)} then '{name}'" for name, cues in W.PLANS)
    + f""" else 'hybrid' end as strategy, case when len(p) between 2 and 16 and len(list_filter(p, lambda s: list_has_any(regexp_split_to_array(lower(s), '\\s+'), [{Q.quoted(W.QUESTION_WORDS)}]) or regexp_split_to_array(lower(s), '\\s+')[1] in ({Q.quoted(W.REQUESTS)}))) = len(p) then len(p) else 1 end::bigint as n_parts
 from (select *, list_filter(list_transform(string_split(regexp_replace(regexp_replace(b, ',\\s+(and|or)\\s+|;\\s*', chr(1), 'g'), '([?.])\\s+(\\w)', '\\1' || chr(1) || '\\2', 'g'), chr(1)), lambda s: regexp_replace(trim(s, ' '), '^[ ?.,]+|[ ?.,]+$', '', 'g')), lambda s: s <> '') p
 from (select probe_id, q, trim(regexp_replace(trim(q, ' '), '\\?\\s*$', '') || ', and ' || lower(trim(q, ' ')), ' ') b from {_P} where q is not null))""",
    "retrieval_metrics": f"""with {_BASE}, mo as (select moment_id mid, any_value(video_id) video_id from moments group by 1),
h as (select qid, rnk, case when list_contains(cite_videos, video_id) then 1 else 0 end hit from f1 join mo using (mid) join {_P} p on p.probe_id = qid),
p as (select qid, max(hit) hit, coalesce(max(case when hit = 1 then 1.0::double / (rnk + 1) end), 0) rr, sum(hit / log2(rnk + 2.0::double)) dcg, sum(hit) nh from h group by 1)
select count(*) as n, {Q.six('avg(hit)')} as hit_rate, {Q.six('avg(rr)')} as mrr, {Q.six('avg(case when nh > 0 then dcg / list_sum(list_transform(range(1, (nh + 1)::bigint), lambda i: 1.0::double / log2(i + 1.0::double))) else 0 end)')} as ndcg from p""",
    "graph_leg": f"""with {_BASE}, st as (select claim_id, any_value(moment_id) m from claims where status = 'committed' and moment_id is not null group by 1),
e0 as (select claim_a a, claim_b b from contradiction_pairs where claim_a <> claim_b and upper(trim(coalesce(relation, ''), ' ')) in ('CONTRADICTS', 'SUPPORTS')),
e as (select x.m s, y.m t from e0 join st x on x.claim_id = a join st y on y.claim_id = b where x.m <> y.m), u as (select s, t from e union select t, s from e)
select distinct qid, t as moment_id, 0.5::double as score from f1 join u on u.s = f1.mid where not exists (select 1 from f1 f where f.qid = f1.qid and f.mid = t)""",
    "scoped_search": f"""with {_BASE}, pv as (select probe_id qid, any_value(cite_videos[1]) video_id from iterm_probes group by 1), mo as (select moment_id mid, any_value(video_id) video_id from moments group by 1)
select qid, mid as moment_id, score from (select de.*, row_number() over (partition by qid order by score desc, mid) r from de join pv using (qid) join mo using (mid) where pv.video_id = mo.video_id) where r <= 5""",
    "visual_topk": f"""with fr as (select event_id, any_value(video_id) video_id, any_value(embedding) v from visual_events where video_id is not null and not isnan(t_start_s) and abs(t_start_s) < 1e7 and len(embedding) = 64 and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = 64 group by event_id),
mv as (select video_id, list(m order by p) v from (select video_id, p, avg(x) m from (select video_id, unnest(range(64)) p, unnest(v) x from fr) group by 1, 2) group by 1),
s as (select event_id qid, mv.video_id, {Q.six('coalesce(case when list_sum(list_transform(fr.v, lambda x: x * x)) > 0 and list_sum(list_transform(mv.v, lambda x: x * x)) > 0 then list_cosine_similarity(fr.v, mv.v) end, 0)')} score from fr, mv where event_id % 100 = 0)
select qid, video_id, score from (select *, row_number() over (partition by qid order by score desc, video_id) r from s) where r <= 5""",
    "vector_topk": f"""with e as (select vec_id, embedding::double[] v from embeddings), s as (select q.vec_id qid, e.vec_id, {Q.six('list_cosine_similarity(q.v, e.v)')} score from e join e q on q.vec_id % 100 = 0 and q.vec_id <> e.vec_id)
select qid, vec_id, rank, score from (select *, row_number() over (partition by qid order by score desc, vec_id) - 1 as rank from s) where rank < 10""",
    "recall_at_k": f"""with e as (select vec_id, embedding::double[] v, label from embeddings), s as (select q.vec_id qid, e.vec_id, e.label = q.label same, {Q.six('list_cosine_similarity(q.v, e.v)')} score from e join e q on q.vec_id % 100 = 0 and q.vec_id <> e.vec_id)
select qid, {Q.six('sum(case when same then 1 else 0 end) / 10.0::double')} as recall from (select *, row_number() over (partition by qid order by score desc, vec_id) rk from s) where rk <= 10 group by 1""",
}
