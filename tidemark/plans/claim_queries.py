"""Queries of claims, entities, contradictions, consensus, versions and the graph."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions import fixed as W
from tidemark.functions import text as X
from tidemark.operators import claims as C
from tidemark.operators import graph as G
from tidemark.operators import retrieval as R
from tidemark.operators import segmentation as S
from tidemark.operators.clustering import first_fit
from tidemark.plans import sqltext as Q
from tidemark.plans.text_queries import _DAY, once
from tidemark.session import table


def _claims(spark: SparkSession, d: str, *more: str) -> DataFrame:
    return once(table(spark, d, "claims").where("text is not null").select("claim_id", "moment_id", "video_id", "text", *more), "claim_id")


def _moments(spark: SparkSession, d: str) -> DataFrame:
    return once(table(spark, d, "moments").where("transcript is not null").select("moment_id", "video_id", "transcript"), "moment_id")


def claims_extract(spark: SparkSession, d: str) -> DataFrame:
    return C.extract(_moments(spark, d)).select("claim_id", "subject", "predicate", "claim_type", X.six(F.col("salience")).alias("salience"))


def nli_classify(spark: SparkSession, d: str) -> DataFrame:
    """Every claim against its moment's transcript."""
    pairs = _claims(spark, d).join(_moments(spark, d).select("moment_id", "transcript"), "moment_id")
    r = C.nli(F.col("transcript"), F.col("text"))
    return pairs.select("claim_id", r["label"].alias("label"), X.six(r["overlap"]).alias("overlap"))


def premise_cover(spark: SparkSession, d: str) -> DataFrame:
    pairs = _claims(spark, d).join(_moments(spark, d).select("moment_id", "transcript"), "moment_id")
    return pairs.select("claim_id", C.covers(F.col("transcript"), F.col("text")).alias("covered"), C.contiguous(F.col("text"), F.col("transcript")).alias("run"))


def verify_gate(spark: SparkSession, d: str) -> DataFrame:
    """Claims verified against the speech of their own span, widened to the whole transcript where they are a run of it.

    Speech that is no run of the transcript is not the moment's. Claims without a span, or with no speech of the moment in
    it, are verified against the whole transcript.
    """
    c = _claims(spark, d, "t_start_s", "t_end_s").join(_moments(spark, d).select("moment_id", "transcript"), "moment_id")
    return C.gate(C.own_premise(c, S.speech_segments(table(spark, d, "segments")))).select("claim_id", "status", X.six(F.col("entailment")).alias("entailment"))


def candidate_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Pairs that share a token of at most BUCKET_CAP claims."""
    return C.candidate_pairs(C.token_sets(_claims(spark, d)))


def near_mirror_pairs(spark: SparkSession, d: str) -> DataFrame:
    return C.mirrors(C.token_sets(_claims(spark, d)))


def contradictions(spark: SparkSession, d: str) -> DataFrame:
    c = _claims(spark, d)
    r = C.relations(c, C.mirrors(C.token_sets(c)))
    return r.select("a", "b", "relation", X.six(F.col("score")).alias("score"))


def _fresh(spark: SparkSession, d: str) -> DataFrame:
    """The claims past the mark: here those whose hash is 0 mod 3."""
    return _claims(spark, d).where(F.conv(F.substring(F.md5("claim_id"), 1, 2), 16, 10).cast("int") % 3 == 0)


def incremental_pairs(spark: SparkSession, d: str) -> DataFrame:
    """The relations that need a claim past the mark: new x all, without ever joining old x old; equal to that part of a full pass."""
    c = _claims(spark, d)
    return C.relations(c, C.mirrors(C.token_sets(c), scope=_fresh(spark, d))).select("a", "b", "relation")


def topic_contradictions(spark: SparkSession, d: str) -> DataFrame:
    """Relations among the claims of a topic, the first 400 of them by id."""
    found, dropped = C.find_contradictions(_claims(spark, d), topic="the harbour furnace and the old trellis", cap=400)
    return found.select("a", "b", "relation", X.six(F.col("score")).alias("score"), F.lit(dropped).cast("bigint").alias("dropped"))


def clusters_with_singletons(spark: SparkSession, d: str) -> DataFrame:
    """Sizes of the equivalence groups, claims without a group included."""
    c = _claims(spark, d)
    g = G.with_singletons(c, G.equivalence_groups(C.mirrors(C.token_sets(c))))
    return g.groupBy("group").agg(F.count(F.lit(1)).alias("n")).groupBy("n").agg(F.count(F.lit(1)).alias("groups"))


def equivalence_components(spark: SparkSession, d: str) -> DataFrame:
    return G.equivalence_groups(C.mirrors(C.token_sets(_claims(spark, d)))).select(F.col("node").alias("claim_id"), "group")


def consensus_score(spark: SparkSession, d: str) -> DataFrame:
    c = _claims(spark, d, "salience")
    groups = G.equivalence_groups(C.mirrors(C.token_sets(c)))
    v = table(spark, d, "videos").select("video_id", F.to_date(X.iso_timestamp(F.col("published_at"))).alias("day")).distinct()
    ok = F.when(F.isnan("salience"), None).otherwise(F.col("salience"))
    members = groups.join(c.select(F.col("claim_id").alias("node"), "claim_id", "video_id", ok.alias("salience")), "node").join(v, "video_id", "left")
    return C.consensus(members).select("group", "n_claims", "support", "representative", X.six(F.col("score")).alias("score"))


def dedup_supersede(spark: SparkSession, d: str) -> DataFrame:
    return C.supersede_duplicates(_claims(spark, d, "status", "t_start_s"))


def claim_history(spark: SparkSession, d: str) -> DataFrame:
    """The newest version of every superseded claim."""
    chain = once(table(spark, d, "claims").where("superseded_by is not null").select("claim_id", "superseded_by"), "claim_id")
    return G.follow(chain, "claim_id", "superseded_by").select(F.col("node").alias("claim_id"), F.col("last").alias("newest"), "steps")


def _mentions(spark: SparkSession, d: str) -> DataFrame:
    c = _claims(spark, d, "status", "subject", "obj").where("status = 'committed'")
    return c.select("claim_id", "video_id", F.explode(X.mentions_of(*map(F.col, ("text", "subject", "obj")))).alias("surface")).withColumn("entity_id", F.concat(F.lit("ent:"), X.slugify(F.col("surface"))))


def entity_resolution(spark: SparkSession, d: str) -> DataFrame:
    """Entities of committed claims: first spelling in order of claims, number of claims and of spellings."""
    return _mentions(spark, d).groupBy("entity_id").agg(F.min_by("surface", F.struct("claim_id", "surface")).alias("name"), F.count_distinct("claim_id").alias("n_claims"), F.count_distinct("surface").alias("n_spellings"))


def entity_upsert_merge(spark: SparkSession, d: str) -> DataFrame:
    """Aliases of every entity, each once, in order of the claim that first had them."""
    first = _mentions(spark, d).groupBy("entity_id", "surface").agg(F.min("claim_id").alias("at"))
    return first.groupBy("entity_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "surface"))), lambda x: x["surface"]), "|").alias("aliases"))


def speaker_resolution(spark: SparkSession, d: str) -> DataFrame:
    """Speaker labels with one normalized name are one speaker: spk:<slug>."""
    s = table(spark, d, "segments").where("speaker is not null").select("seg_id", "speaker").distinct()
    slug = X.slugify(F.regexp_replace(F.regexp_replace("speaker", r"\((host|guest)\)", ""), r"^\s*(Dr\.|Prof\.|Ms|Mr)\s", ""), default="unknown")
    return s.groupBy(F.concat(F.lit("spk:"), slug).alias("speaker_id")).agg(F.count(F.lit(1)).alias("n"), F.min("speaker").alias("label"))


def _edges(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "contradiction_pairs").where("claim_a is not null and claim_b is not null")
    return p.select(F.col("claim_a").alias("src"), F.upper(F.trim(F.coalesce("relation", F.lit("")))).alias("rel"), F.col("claim_b").alias("dst"))


def edges_upsert(spark: SparkSession, d: str) -> DataFrame:
    """Old edges (detected before 2025-05) and the new ones that no old one equals."""
    p = table(spark, d, "contradiction_pairs").where("claim_a is not null and claim_b is not null").withColumn("video_id", F.substring_index("claim_a", "#", 1))
    p = p.select(F.col("claim_a").alias("src"), F.upper(F.trim(F.coalesce("relation", F.lit("")))).alias("rel"), F.col("claim_b").alias("dst"), "video_id", "detected_at")
    key = ["src", "rel", "dst", "video_id"]
    old = p.where("detected_at < timestamp_ntz '2025-05-01'").select(*key, F.lit("old").alias("origin")).dropDuplicates(key)
    new = p.where("detected_at >= timestamp_ntz '2025-05-01'").select(*key, F.lit("new").alias("origin"))
    return G.upsert_edges(old, new).groupBy("rel", "origin").agg(F.count(F.lit(1)).alias("n"))


def graph_neighbors(spark: SparkSession, d: str) -> DataFrame:
    return G.neighbours(_edges(spark, d).where("rel in ('SUPPORTS', 'CONTRADICTS') and src <> dst")).groupBy("node").agg(F.count(F.lit(1)).alias("degree"), F.min("other").alias("least"))


def graph_bfs2(spark: SparkSession, d: str) -> DataFrame:
    """Every linked claim's claims within two hops, with score 1 / (hop + 1)."""
    e = _edges(spark, d).where("rel = 'CONTRADICTS' and src <> dst")
    seeds = e.select(F.col("src").alias("seed")).distinct()
    return G.expand(seeds, e, 2).groupBy("seed", "hop").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("least")).select("seed", F.col("hop").cast("bigint").alias("hop"), "n", "least", X.six(1 / (F.col("hop") + 1)).alias("score"))


def claim_evolution(spark: SparkSession, d: str) -> DataFrame:
    """The committed and superseded steps of every entity in order of date, undated ones last, each with the relation to the step before."""
    sane = F.when(F.isnan("t_start_s") | (F.abs("t_start_s") > 1e7), 0.0).otherwise(F.coalesce("t_start_s", F.lit(0.0)))
    c = _claims(spark, d, "status", "subject", "obj", sane.alias("t")).where("status in ('committed', 'superseded')")
    m = c.select("claim_id", "video_id", "t", F.explode(X.mentions_of(*map(F.col, ("text", "subject", "obj")))).alias("surface")).withColumn("subject", F.concat(F.lit("ent:"), X.slugify(F.col("surface")))).select("subject", "claim_id", "video_id", "t").distinct()
    v = table(spark, d, "videos").select("video_id", F.to_date(X.iso_timestamp(F.col("published_at"))).alias("day")).distinct()
    return C.evolution(m.join(v, "video_id", "left"), _edges(spark, d)).select(F.col("subject").alias("entity_id"), "claim_id", F.col("step").cast("bigint").alias("step"), "rel")


def dedup_corrected(spark: SparkSession, d: str) -> DataFrame:
    """Repeated and corrected claims with what supersedes them; every third CONTRADICTS pair of committed claims stands for a correction."""
    c = _claims(spark, d, "status", "t_start_s")
    e = _edges(spark, d).where("rel = 'CONTRADICTS' and src <> dst").select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")).distinct()
    e = e.where(F.conv(F.substring(F.md5(F.concat("src", "dst")), 1, 2), 16, 10).cast("int") % 3 == 0).withColumn("rel", F.lit("CORRECTS"))
    return C.dedup(c, e)


def versions(spark: SparkSession, d: str) -> DataFrame:
    """Every version before and after the superseded claims of the first superseding claims' videos, with its distance."""
    chain = once(table(spark, d, "claims").where("superseded_by is not null").select("claim_id", "superseded_by"), "claim_id")
    return G.history(chain, chain.select("claim_id")).select(F.col("seed").alias("claim_id"), F.col("node").alias("version"), F.col("step").cast("bigint").alias("step"))


def graph_difference(spark: SparkSession, d: str) -> DataFrame:
    """Edges that only one of two passes over the pairs has: all, and those without repeated ones."""
    e = _edges(spark, d)
    return G.difference(e, e.distinct()).groupBy("side", "rel").agg(F.count(F.lit(1)).alias("n"))


def topic_filter_cap(spark: SparkSession, d: str) -> DataFrame:
    """Claims that share a content token with the topic, the first 50 by id, and the number left out (filter before cap)."""
    topic = X.content_tokens(F.lit("the harbour furnace and the old trellis"))
    hits = _claims(spark, d).where(F.arrays_overlap(X.content_tokens(F.col("text")), topic))
    ranked = hits.select("claim_id").orderBy("claim_id").limit(50)
    return ranked.crossJoin(F.broadcast(hits.agg(F.greatest(F.lit(0), F.count(F.lit(1)) - 50).alias("dropped"))))  # one row


def provenance_lookup(spark: SparkSession, d: str) -> DataFrame:
    c = _claims(spark, d, "status", "t_start_s")
    v = table(spark, d, "videos").select("video_id", "source_url").distinct()
    sane = F.when(F.isnan("t_start_s") | (F.abs("t_start_s") > 1e7), None).otherwise(F.col("t_start_s"))
    return c.join(v, "video_id", "left").select("claim_id", (F.coalesce("status", F.lit("")) == "committed").alias("trusted"), F.when(F.col("status") == "committed", X.deep_link(F.col("source_url"), sane)).alias("link"))


def voiceprint_cluster(spark: SparkSession, d: str) -> DataFrame:
    """Greedy first-fit of the embeddings by cosine from 0.75 on, in order of vec_id, with any number of leaders."""
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("key"), F.col("embedding").cast("array<double>").alias("vec"))
    return first_fit(v, 0.75, most=None).select(F.col("key").alias("vec_id"), "leader")


def topics_greedy(spark: SparkSession, d: str) -> DataFrame:
    """Moments by cosine of their hashed texts from 0.5 on, with at most 512 representatives; clusters of two or more."""
    def doubles(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"key": pdf["key"], "vec": [np.frombuffer(v, np.int32).astype(np.float64).tobytes() for v in pdf["vec"]]})

    index = R.build_index(_moments(spark, d).select(F.col("moment_id").alias("key"), F.col("transcript").alias("text"))).where("len > 0")
    out = first_fit(index.select("key", "vec").mapInPandas(doubles, "key string, vec binary"), 0.5)
    return out.groupBy("leader").agg(F.count(F.lit(1)).alias("n")).where("n >= 2")


QUERIES = {f.__name__: f for f in (claims_extract, nli_classify, premise_cover, verify_gate, candidate_pairs, near_mirror_pairs, contradictions, incremental_pairs, topic_contradictions, clusters_with_singletons, dedup_corrected, versions, graph_difference, equivalence_components, consensus_score, dedup_supersede, claim_history, entity_resolution, entity_upsert_merge, speaker_resolution, edges_upsert, graph_neighbors, graph_bfs2, claim_evolution, topic_filter_cap, provenance_lookup, voiceprint_cluster, topics_greedy)}

_C = f"(select * from {Q.unique('claims', 'claim_id', 'moment_id video_id text subject obj status t_start_s t_end_s salience')} where text is not null)"
_M = f"(select * from {Q.unique('moments', 'moment_id', 'video_id transcript')} where transcript is not null)"
_EXTRACT = f"""ex as (select moment_id, text, moment_id || '.c' || format('{{:02d}}', row_number() over (partition by moment_id order by pos) - 1) claim_id
 from (select moment_id, unnest(range(len(s))) pos, unnest(s) as text from (select moment_id, {Q.sentences('transcript')} s from {_M})) where not ends_with(text, '?') and len({Q.tokens('text')}) >= 4)"""
_NEG = lambda t: f"len(list_filter({t}, lambda x: x in ({Q.quoted(W.NEGATIONS)}))) > 0"
_CONTENT = lambda c, stop=W.NLI_STOP: f"list_filter({Q.tokens(c)}, lambda x: length(x) > 1 and x not in ({Q.quoted(stop)}))"


def _nli(p: str, h: str, source: str, keep: str) -> str:
    """Rows of ``keep`` with label and overlap."""
    return f"""(select {keep}, case when k = 0 then 'neutral' when n / k < 0.5 then 'neutral' when ({_NEG('pt')}) <> ({_NEG('ht')}) then 'contradiction' else 'entailment' end as label, case when k = 0 then 0.33 else n / k end as overlap
 from (select *, len(hc)::double k, len(list_filter(hc, lambda x: list_contains(pt, x)))::double n from (select *, {Q.tokens(p)} pt, {Q.tokens(h)} ht, {_CONTENT(h)} hc from {source})))"""


_SETS = f"ss as (select * from (select claim_id, video_id, text, {Q.content_tokens('text')} ts from {_C}) where len(ts) > 0), tk as (select claim_id, unnest(ts) t from ss), fq as (select t, count(*) df from tk group by t)"
_MIRRORS = f"""{_SETS},
rr as (select claim_id, t from tk join fq using (t) where df between 2 and 200),
cp as (select distinct x.claim_id a, y.claim_id b from rr x join rr y on x.t = y.t and x.claim_id < y.claim_id),
mi as (select a, b, len(i)::bigint shared, (len(ta) + len(tb) - len(i))::bigint together from (select a, b, x.ts ta, y.ts tb, list_intersect(x.ts, y.ts) i from cp join ss x on x.claim_id = a join ss y on y.claim_id = b)
 where len(i) >= 3 and 2 * len(i) >= len(ta) + len(tb) - len(i) and len(list_filter(i, lambda q: q not in ({Q.quoted(W.FILLER)}))) > 0)"""
_REL = f"""{_MIRRORS},
rl as (select a, b, case when label = 'contradiction' then 'CONTRADICTS' else 'SUPPORTS' end relation, overlap from {_nli('xa', 'xb', '(select a, b, x.text xa, y.text xb from mi join ss x on x.claim_id = a join ss y on y.claim_id = b where x.video_id <> y.video_id)', 'a, b')}
 where label <> 'neutral' and floor(overlap * 1e4::double + 0.5::double) / 1e4::double >= 0.55)"""
_GROUPS = f"""{_MIRRORS}, ed as (select a, b from mi union select b, a from mi), re as (select a n, a m from ed union select r.n, e.b from re r join ed e on r.m = e.a), gr as (select n, min(m) g from re group by n)"""
_PAIRS = f"(select c.claim_id, c.text, transcript from {_C} c join {_M} m using (moment_id))"
_MENT = f"""me as (select distinct claim_id, video_id, unnest(list_concat({Q.mentions('text')}, {Q.mentions('subject')}, {Q.mentions('obj')})) surface from ax),
en as (select *, 'ent:' || {Q.slugify('surface')} entity_id from me)"""
_AX = f"ax as (select claim_id, video_id, text, subject, obj from {_C} where status = 'committed')"
_COVER = lambda p, h: f"len(list_filter({_CONTENT(h, W.COVER_STOP)}, lambda x: list_contains({Q.tokens(p)}, x))) >= 0.8 * len({_CONTENT(h, W.COVER_STOP)})"
_RUN = lambda h, s: f"({Q.normalized(h)} <> '' and contains(' ' || {Q.normalized(s)} || ' ', ' ' || {Q.normalized(h)} || ' '))"
_PEDGE = "(select claim_a src, upper(trim(coalesce(relation, ''), ' ')) rel, claim_b dst, split_part(claim_a, '#', 1) video_id, detected_at from contradiction_pairs where claim_a is not null and claim_b is not null)"

SQL = {
    "claims_extract": f"""with {_EXTRACT}, q as (select *, {Q.predicate_of('text')} cue from ex), z as (select *, case when cue = '' then 0 else instr(lower(text), ' ' || cue || ' ') end loc from q)
select claim_id, case when cue = '' then regexp_replace(trim(text, ' '), '[.!]+$', '') else trim(substring(text, 1, loc - 1), ' ') end as subject, cue as predicate, {Q.epistemic_type('text')} as claim_type, {Q.six(Q.salience('text'))} as salience from z""",
    "nli_classify": f"select claim_id, label, {Q.six('overlap')} as overlap from {_nli('transcript', 'text', _PAIRS, 'claim_id')}",
    "premise_cover": f"select claim_id, {_COVER('transcript', 'text')} as covered, {_RUN('text', 'transcript')} as run from {_PAIRS}",
    "verify_gate": f"""with cl as (select c.claim_id, c.video_id, c.text, t_start_s a0, t_end_s a1, transcript from {_C} c join {_M} m using (moment_id)),
sg as (select seg_id, any_value(video_id) video_id, any_value(start_s) b0, any_value(end_s) b1, any_value(trim(text, ' ')) cue from segments where lower(kind) = 'speech' and trim(text, ' ') <> '' and video_id is not null
 and isfinite(start_s) and isfinite(end_s) and abs(start_s) < 1e7 and abs(end_s) < 1e7 and start_s >= 0 and end_s >= start_s group by seg_id),
hd as (select claim_id, string_agg(cue, ' ' order by b0, b1, seg_id) own from cl join sg on cl.video_id = sg.video_id and a0 < b1 and a1 > b0 where isfinite(a0) and isfinite(a1) and abs(a0) < 1e7 and abs(a1) < 1e7 and a0 >= 0 and a1 >= a0
 and contains(' ' || {Q.normalized('transcript')} || ' ', ' ' || {Q.normalized('cue')} || ' ') group by 1),
p as (select cl.*, coalesce(nullif(own, ''), transcript) pr from cl left join hd using (claim_id)),
w as (select claim_id, text, transcript, case when not ({_COVER('pr', 'text')}) and {_RUN('text', 'transcript')} then transcript else pr end pm from p)
select claim_id, case when label = 'entailment' and not {Q.low_value('text')} and not ({Q.punctuated('transcript')} and {Q.fragment('text')}) then 'committed' else 'unsupported' end as status,
 {Q.six("case when label = 'contradiction' then 1 - overlap else overlap end")} as entailment from {_nli('pm', 'text', 'w', 'claim_id, text, transcript')}""",
    "candidate_pairs": f"with {_SETS}, rr as (select claim_id, t from tk join fq using (t) where df between 2 and {C.BUCKET_CAP}) select x.claim_id as a, y.claim_id as b, count(*) as shared from rr x join rr y on x.t = y.t and x.claim_id < y.claim_id group by 1, 2",
    "near_mirror_pairs": f"with {_MIRRORS} select a, b, shared, together from mi",
    "contradictions": f"with {_REL} select a, b, relation, {Q.six('overlap')} as score from rl",
    "incremental_pairs": f"with {_REL} select a, b, relation from rl where cast('0x' || substring(md5(a), 1, 2) as int) % 3 = 0 or cast('0x' || substring(md5(b), 1, 2) as int) % 3 = 0",
    "equivalence_components": f'with recursive {_GROUPS} select n as claim_id, g as "group" from gr',
    "consensus_score": f"""with recursive {_GROUPS}, vd as (select distinct video_id, ({_DAY})::date as day from (select video_id, trim(published_at) p from videos)),
mb as (select g, c.claim_id, c.video_id, case when isnan(salience) then 0 else coalesce(salience, 0) end sal, day from gr join {_C} c on c.claim_id = n left join vd on vd.video_id = c.video_id where c.video_id is not null),
ag as (select g, count(distinct claim_id) n_claims, count(distinct video_id) support, max(sal) au, max(day) as day, arg_max(claim_id, (sal, claim_id)) rep from mb group by g)
select g as "group", n_claims, support, rep as representative, {Q.six('least(1.0::double, greatest(0.0::double, 0.5::double * least(1.0::double, support / 3.0::double) + 0.25::double * au + 0.25::double * coalesce(pow(0.5::double, (max(day) over () - day) / 365.0::double), 0.5::double)))')} as score from ag""",
    "dedup_supersede": f"""select claim_id, keeper as superseded_by from (select claim_id, first_value(claim_id) over (partition by video_id, norm order by coalesce(t_start_s, 0), claim_id) keeper from (select *, {Q.normalized('text')} norm from {_C} where status = 'committed' and video_id is not null) where norm <> '') where keeper <> claim_id""",
    "claim_history": """with recursive c as (select claim_id n, any_value(superseded_by) t from claims where superseded_by is not null group by 1), l as (select * from c where n <> t),
w as (select n, t, 1::bigint k from l union all select w.n, l.t, k + 1 from w join l on l.n = w.t where k < 1000)
select n as claim_id, arg_max(t, k) as newest, max(k) as steps from w group by 1""",
    "entity_resolution": f"with {_AX}, {_MENT} select entity_id, arg_min(surface, (claim_id, surface)) as name, count(distinct claim_id) as n_claims, count(distinct surface) as n_spellings from en group by 1",
    "entity_upsert_merge": f"with {_AX}, {_MENT} select entity_id, string_agg(surface, '|' order by at_c, surface) as aliases from (select entity_id, surface, min(claim_id) at_c from en group by 1, 2) group by 1",
    "speaker_resolution": f"select 'spk:' || {Q.slugify('bare', 'unknown')} as speaker_id, count(*) as n, min(speaker) as label from (select speaker, regexp_replace(regexp_replace(speaker, '\\((host|guest)\\)', '', 'g'), '^\\s*(Dr\\.|Prof\\.|Ms|Mr)\\s', '') bare from (select distinct seg_id, speaker from segments where speaker is not null)) group by 1",
    "edges_upsert": f"""with o as (select distinct src, rel, dst, video_id from {_PEDGE} where detected_at < timestamp '2025-05-01'), n as (select distinct src, rel, dst, video_id from {_PEDGE} where detected_at >= timestamp '2025-05-01' except select * from o)
select rel, 'old' as origin, count(*) as n from o group by rel union all select rel, 'new', count(*) from n group by rel""",
    "graph_neighbors": f"with e as (select src a, dst b from {_PEDGE} where rel in ('SUPPORTS', 'CONTRADICTS') and src <> dst union select dst, src from {_PEDGE} where rel in ('SUPPORTS', 'CONTRADICTS') and src <> dst) select a as node, count(*) as degree, min(b) as least from e group by 1",
    "graph_bfs2": f"""with e as (select src a, dst b from {_PEDGE} where rel = 'CONTRADICTS' and src <> dst union select dst, src from {_PEDGE} where rel = 'CONTRADICTS' and src <> dst),
s as (select distinct src seed from {_PEDGE} where rel = 'CONTRADICTS' and src <> dst), h1 as (select distinct seed, b node from s join e on a = seed where b <> seed),
h2 as (select distinct seed, b node from h1 join e on a = node where b <> seed except select seed, node from h1), u as (select *, 1 hop from h1 union all select *, 2 from h2)
select seed, hop::bigint as hop, count(*) as n, min(node) as least, {Q.six('1.0::double / (hop + 1)')} as score from u group by seed, hop""",
    "claim_evolution": f"""with ax as (select claim_id, video_id, text, subject, obj, case when isnan(t_start_s) or abs(t_start_s) > 1e7 then 0 else coalesce(t_start_s, 0) end t from {_C} where status in ('committed', 'superseded')), {_MENT},
vd as (select distinct video_id, ({_DAY})::date as day from (select video_id, trim(published_at) p from videos)),
st as (select entity_id, claim_id, row_number() over w as step, lag(claim_id) over w before from (select distinct entity_id, claim_id, video_id, t from en join ax using (claim_id, video_id)) left join vd using (video_id) window w as (partition by entity_id order by day is null, day, t, claim_id)),
e as (select src, dst, case rel when 'CONTRADICTS' then 0 when 'CORRECTS' then 1 when 'SUPPORTS' then 2 end k from {_PEDGE} where rel in ('SUPPORTS', 'CONTRADICTS', 'CORRECTS')), b as (select x, y, min(k) k from (select src x, dst y, k from e union all select dst, src, k from e) group by 1, 2)
select entity_id, claim_id, step, coalesce(['CONTRADICTS', 'CORRECTS', 'SUPPORTS'][k + 1], '-') as rel from st left join b on x = before and y = claim_id""",
    "topic_contradictions": f"""with t0 as (select * from {_C} where list_has_any({Q.content_tokens('text')}, ['harbour', 'furnace', 'old', 'trellis'])), t1 as (select * from t0 order by claim_id limit 400), {_REL.replace(_C, 't1')}
select a, b, relation, {Q.six('overlap')} as score, (select greatest(0, count(*) - 400) from t0) as dropped from rl""",
    "clusters_with_singletons": f"with recursive {_GROUPS} select n, count(*) as groups from (select coalesce(g, claim_id) k, count(*) n from {_C} c left join gr on gr.n = c.claim_id group by 1) group by n",
    "dedup_corrected": f"""with cm as (select *, {Q.normalized('text')} norm from {_C} where status = 'committed'), r as (select claim_id, keeper from (select claim_id, first_value(claim_id) over (partition by video_id, norm order by coalesce(t_start_s, 0), claim_id) keeper from cm where video_id is not null and norm <> '') where keeper <> claim_id),
ok as (select claim_id from cm where claim_id not in (select claim_id from r)), e as (select distinct greatest(src, dst) s, least(src, dst) t from {_PEDGE} where rel = 'CONTRADICTS' and src <> dst)
select claim_id, keeper as superseded_by from r union all select t, min(s) from e where cast('0x' || substring(md5(s || t), 1, 2) as int) % 3 = 0 and s in (select * from ok) and t in (select * from ok) group by 1""",
    "versions": """with recursive c as (select claim_id n, any_value(superseded_by) t from claims where superseded_by is not null group by 1), l as (select * from c where n <> t),
f as (select n seed, n node, 0::bigint step from c union select f.seed, l.t, step + 1 from f join l on l.n = f.node where step < 100), b as (select n seed, n node, 0::bigint step from c union select b.seed, l.n, step - 1 from b join l on l.t = b.node where step > -100)
select seed as claim_id, node as version, step from f union select seed, node, step from b""",
    "graph_difference": f"select 'left' as side, rel, (count(*) - count(distinct (src, dst)))::bigint as n from {_PEDGE} group by rel having count(*) > count(distinct (src, dst))",
    "topic_filter_cap": f"with h as (select claim_id from {_C} where list_has_any({Q.content_tokens('text')}, ['harbour', 'furnace', 'old', 'trellis'])) select claim_id, (select greatest(0, count(*) - 50) from h) as dropped from (select claim_id from h order by claim_id limit 50)",
    "provenance_lookup": f"""select claim_id, coalesce(status, '') = 'committed' as trusted, case when status = 'committed' then source_url || '#t=' || floor(greatest(0, coalesce(case when isnan(t_start_s) or abs(t_start_s) > 1e7 then null else t_start_s end, 0)))::bigint end as link
 from {_C} c left join (select distinct video_id, source_url from videos) v using (video_id)""",
}
