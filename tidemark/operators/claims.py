"""Claims: extraction from moments, lexical entailment, the verification gate, near mirrors, contradictions, consensus, dedup."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions import text as X
from tidemark.functions.vectors import cosine
from tidemark.functions.fixed import COVER_STOP, FILLER, NEGATIONS, NLI_STOP
from tidemark.operators.segmentation import finite_span, overlap_join
from tidemark.session import materialize

ENTAIL, CONTRADICT, MIN_SHARED, BUCKET_CAP = 0.5, 0.55, 3, 200


def extract(moments: DataFrame, min_words: int = 4) -> DataFrame:
    """Claims of moments (moment_id, video_id, transcript): sentences that are no question and have ``min_words`` tokens, numbered per moment."""
    s = moments.select("moment_id", "video_id", F.posexplode(X.sentences(F.col("transcript"))).alias("pos", "text"))
    kept = s.where(~F.col("text").endswith("?") & (F.size(X.tokens(F.col("text"))) >= min_words))
    n = F.row_number().over(Window.partitionBy("moment_id").orderBy("pos")) - 1
    subject, predicate, obj = X.subject_object(F.col("text"))
    return kept.select(F.format_string("%s.c%02d", F.col("moment_id"), n).alias("claim_id"), "moment_id", "video_id", "text", subject.alias("subject"), predicate.alias("predicate"), obj.alias("obj"), X.epistemic_type(F.col("text")).alias("claim_type"), X.salience(F.col("text")).alias("salience"))


def let(values: dict[str, Column], use) -> Column:
    """Binds values once for ``use`` (a function of a struct), so that an inner lambda does not compute them for every element."""
    return F.transform(F.array(F.struct(*[v.alias(k) for k, v in values.items()])), use)[0]


def nli(premise: Column, hypothesis: Column, stop: list[str] = NLI_STOP, negations: list[str] = NEGATIONS) -> Column:
    """Lexical entailment as a struct (label, overlap): the share of the hypothesis' content tokens, counted with multiplicity, in the premise.

    From an overlap of a half on it is a contradiction if exactly one side has a negation, else an entailment; below it is neutral. A
    hypothesis without content is neutral with overlap 0.33. Premise and hypothesis are not interchangeable.
    """
    neg = lambda t: F.arrays_overlap(t, X.words_array(negations))

    def judged(x: Column) -> Column:
        content = F.filter(x["h"], lambda t: (F.length(t) > 1) & ~t.isin(stop))
        return let({"p": x["p"], "c": content, "differ": neg(x["p"]) != neg(x["h"])}, lambda y: weighed(y))

    def weighed(y: Column) -> Column:
        overlap = F.size(F.filter(y["c"], lambda t: F.array_contains(y["p"], t))) / F.size(y["c"])
        label = F.when(overlap < 0.5, "neutral").when(y["differ"], "contradiction").otherwise("entailment")
        return F.when(F.size(y["c"]) == 0, F.struct(F.lit("neutral").alias("label"), F.lit(0.33).alias("overlap"))).otherwise(F.struct(label.alias("label"), overlap.alias("overlap")))

    return let({"p": X.tokens(premise), "h": X.tokens(hypothesis)}, judged)


def covers(premise: Column, hypothesis: Column, floor: float = 0.8, stop: list[str] = COVER_STOP) -> Column:
    """Whether the premise holds at least ``floor`` of the hypothesis' content tokens; true without any."""
    h = F.filter(X.tokens(hypothesis), lambda t: (F.length(t) > 1) & ~t.isin(stop))
    return let({"p": X.tokens(premise), "h": h}, lambda x: F.size(F.filter(x["h"], lambda t: F.array_contains(x["p"], t))) >= floor * F.size(x["h"]))


def contiguous(hypothesis: Column, source: Column) -> Column:
    """Whether the hypothesis' tokens are one run of the source's tokens; false without tokens."""
    h = X.normalized(hypothesis)
    return (h != "") & F.contains(F.concat(F.lit(" "), X.normalized(source), F.lit(" ")), F.concat(F.lit(" "), h, F.lit(" ")))


def own_premise(claims: DataFrame, cues: DataFrame) -> DataFrame:
    """Adds ``premise``: the speech of a claim's own span that is part of its moment's transcript, else the whole ``transcript``.

    ``claims``: claim_id, video_id, t_start_s, t_end_s, transcript; ``cues``: video_id, seg_id, t0, t1, text. Cues that touch the span only
    at an end are not of it.
    """
    spans = claims.where(finite_span(claims, "t_start_s", "t_end_s") & F.col("video_id").isNotNull()).select("video_id", "claim_id", F.col("t_start_s").alias("a0"), F.col("t_end_s").alias("a1"))
    said = cues.where(finite_span(cues, "t0", "t1") & F.col("video_id").isNotNull()).select("video_id", "seg_id", F.col("t0").alias("b0"), F.col("t1").alias("b1"), F.trim("text").alias("cue"))
    heard = overlap_join(spans, said, 30.0, strict=True).groupBy("claim_id").agg(F.array_sort(F.collect_list(F.struct("b0", "b1", "seg_id", "cue"))).alias("cues"))
    known = {"s": F.concat(F.lit(" "), X.normalized(F.col("transcript")), F.lit(" ")), "cues": F.transform("cues", lambda x: x["cue"])}
    run = lambda s, cue: F.contains(s, F.concat(F.lit(" "), X.normalized(cue), F.lit(" ")))
    own = F.array_join(let(known, lambda x: F.filter(x["cues"], lambda cue: run(x["s"], cue))), " ")
    rows = claims.join(heard, "claim_id", "left").withColumn("own", own)
    return rows.withColumn("premise", F.when(F.col("own") != "", F.col("own")).otherwise(F.col("transcript"))).drop("own", "cues")


def gate(claims: DataFrame, salience_floor: float | None = None, judge=None) -> DataFrame:
    """Status of claims with a ``premise`` and a ``transcript``: the premise is widened to the transcript where it doesn't cover a contiguous claim.

    Entailed claims are committed, all others unsupported; so are claims of low value, fragments of a punctuated transcript, and, where
    ``salience_floor`` is given, claims with less ``salience``. None is dropped. ``judge``: a function that adds ``label`` and ``overlap`` to rows
    with ``premise`` and ``text``, in place of the lexical entailment.
    """
    # The cheap containment comes first.
    widen = ~covers(F.col("premise"), F.col("text")) & contiguous(F.col("text"), F.col("transcript"))
    premise = F.when(widen, F.col("transcript")).otherwise(F.col("premise"))
    if judge is None:
        claims = claims.withColumn("r", nli(premise, F.col("text")))
    else:
        claims = judge(claims.withColumn("premise", premise)).withColumn("r", F.struct("label", "overlap")).drop("label", "overlap")
    good = (F.col("r.label") == "entailment") & ~X.low_value(F.col("text")) & ~(X.punctuated(F.col("transcript")) & X.fragment(F.col("text")))
    if salience_floor is not None:
        good = good & (F.coalesce("salience", F.lit(0.0)) >= salience_floor)
    return claims.withColumn("status", F.when(good, "committed").otherwise("unsupported")).withColumn("entailment", F.when(F.col("r.label") == "contradiction", 1 - F.col("r.overlap")).otherwise(F.col("r.overlap"))).drop("r")


def locate(claims: DataFrame, cues: DataFrame, floor: float = 0.5) -> DataFrame:
    """``claim_id, seg_id, shared, t_start_s, t_end_s``: the cue of the moment that covers most of a claim's distinct tokens, from ``floor`` on.

    ``claims``: claim_id, video_id, text and their moment's span a0, a1; ``cues``: video_id, seg_id, b0, b1, text and, where known,
    ``words`` (array of t0, t1, word). Of equal cues the first in time. With words the span is narrowed to those that the claim has.
    """
    c = claims.select("video_id", "claim_id", "a0", "a1", F.array_distinct(X.tokens(F.col("text"))).alias("ct")).where(F.size("ct") > 0)
    words = "words" in cues.columns
    s = cues.select("video_id", "seg_id", "b0", "b1", F.array_distinct(X.tokens(F.col("text"))).alias("st"), *(["words"] if words else []))
    shared = F.size(F.array_intersect("st", "ct"))
    pairs = overlap_join(c, s, 60.0).where((shared > 0) & (shared >= floor * F.size("ct")))
    value = F.struct("seg_id", "b0", "b1", shared.cast("bigint").alias("shared"), "ct", *(["words"] if words else []))
    best = pairs.groupBy("claim_id").agg(F.min_by(value, F.struct(-shared, "b0", "seg_id")).alias("x"))
    start, end = F.col("x.b0"), F.col("x.b1")
    if words:
        own = F.filter("x.words", lambda w: F.array_contains("x.ct", F.get(X.tokens(w["word"]), 0)))
        first, last = F.array_min(F.transform(own, lambda w: w["t0"])), F.array_max(F.transform(own, lambda w: w["t1"]))
        start, end = F.greatest(start, first), F.least(end, last)  # null where no word fits, which greatest and least pass over
    return best.select("claim_id", "x.seg_id", "x.shared", start.alias("t_start_s"), end.alias("t_end_s"))


def token_sets(claims: DataFrame) -> DataFrame:
    """``claim_id, video_id, text, ts`` with the content tokens, for claims that have any."""
    return claims.select("claim_id", "video_id", "text", X.content_tokens(F.col("text")).alias("ts")).where(F.size("ts") > 0)


def candidate_pairs(sets: DataFrame, cap: int = BUCKET_CAP) -> DataFrame:
    """``a, b, shared`` (a < b): pairs that share a token of at most ``cap`` claims; shared counts these tokens only."""
    rows = sets.select("claim_id", F.explode("ts").alias("t"))
    rare = rows.groupBy("t").agg(F.count(F.lit(1)).alias("df")).where(F.col("df").between(2, cap)).select("t")
    kept = rows.join(rare, "t")
    return kept.select("t", F.col("claim_id").alias("a")).join(kept.select("t", F.col("claim_id").alias("b")), "t").where("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared"))


def mirrors(sets: DataFrame, min_shared: int = MIN_SHARED, cap: int = BUCKET_CAP, scope: DataFrame | None = None) -> DataFrame:
    """Pairs ``a, b`` with at least ``min_shared`` tokens and half of their union in common, one of them distinctive and one of at most ``cap`` claims.

    Two sets that share half of their union have their rarest shared token among the rarest n - ceil(n / 2) + 1 of either; as a
    token of at most ``cap`` claims must be shared, that rarest one is such a token. So only these tokens of the prefixes are
    joined, and the whole sets are compared afterwards. This loses no pair and needs no join on common tokens.

    ``scope`` (claim_id), where given: only pairs with a claim in it; the claims in it meet all others, and the rest never meets itself.
    """
    # Tokens travel as 64-bit hashes, a fifth of their size.
    rows = sets.select("claim_id", F.explode(F.transform("ts", lambda t: F.xxhash64(t))).alias("t"))
    freq = rows.groupBy("t").agg(F.count(F.lit(1)).alias("df"))
    ranked = rows.join(freq, "t").groupBy("claim_id").agg(F.array_sort(F.collect_list(F.struct("df", "t"))).alias("o"))
    half = lambda n: F.ceil(n / 2).cast("int")
    ranked = ranked.select("claim_id", F.transform("o", lambda x: x["t"]).alias("ts"), F.transform(F.filter("o", lambda x: x["df"] <= cap), lambda x: x["t"]).alias("rare"))
    if scope is not None:
        ranked = ranked.join(scope.select("claim_id", F.lit(True).alias("fresh")).dropDuplicates(["claim_id"]), "claim_id", "left").withColumn("fresh", F.coalesce("fresh", F.lit(False)))
    else:
        ranked = ranked.withColumn("fresh", F.lit(True))
    ranked = materialize(ranked)  # read by both sides of two joins
    prefix = ranked.select("claim_id", "fresh", F.size("ts").alias("n"), F.explode(F.slice("rare", F.lit(1), F.size("ts") - half(F.size("ts")) + 1)).alias("t"))
    side = lambda name: [F.col("claim_id").alias(name), F.col("n").alias(f"n{name}")]
    # Sets that share half of their union differ in size by a factor of two at most.
    fits = "na <= 2 * nb and nb <= 2 * na"
    fresh = prefix.where("fresh").select("t", *side("a"))
    if scope is None:
        pairs = fresh.join(prefix.select("t", *side("b")), "t").where(f"a < b and {fits}").select("a", "b").distinct()
    else:
        pairs = fresh.join(prefix.select("t", *side("b")), "t").where(f"a <> b and {fits}").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    x = ranked.select(F.col("claim_id").alias("a"), F.col("ts").alias("ta"), F.col("rare").alias("ra"))
    y = ranked.select(F.col("claim_id").alias("b"), F.col("ts").alias("tb"), F.col("rare").alias("rb"))
    full = pairs.join(x, "a").join(y, "b")
    common = F.array_intersect("ta", "tb")
    n = F.size(common)
    ok = (n >= min_shared) & (2 * n >= F.size("ta") + F.size("tb") - n) & (F.size(F.array_except(common, F.transform(X.words_array(FILLER), lambda t: F.xxhash64(t)))) > 0) & F.arrays_overlap("ra", "rb")
    return full.where(ok).select("a", "b", n.cast("bigint").alias("shared"), (F.size("ta") + F.size("tb") - n).cast("bigint").alias("together"))


def cosine_pairs(sets: DataFrame, vectors: DataFrame, floor: float, cap: int = BUCKET_CAP) -> DataFrame:
    """Candidate pairs whose vectors (claim_id, vec) have a cosine of at least ``floor``: a second kind of equivalence."""
    p = candidate_pairs(sets, cap).select("a", "b")
    full = p.join(vectors.select(F.col("claim_id").alias("a"), F.col("vec").alias("va")), "a").join(vectors.select(F.col("claim_id").alias("b"), F.col("vec").alias("vb")), "b")
    return full.where(cosine(F.col("va"), F.col("vb")) >= floor).select("a", "b")


def on_topic(claims: DataFrame, topic: str | None) -> DataFrame:
    """Claims that share a content token with the topic; all without one."""
    return claims if not topic else claims.where(F.arrays_overlap(X.content_tokens(F.col("text")), X.content_tokens(F.lit(topic))))


def capped(claims: DataFrame, order: str, cap: int, scope: DataFrame | None = None) -> tuple[DataFrame, int]:
    """The first ``cap`` claims by ``order`` (a unique column) and all in ``scope`` (claim_id), each once, and how many were left out."""
    total = claims.count()
    if total <= cap:
        return claims, 0
    last = claims.select(order).orderBy(order).limit(cap).agg(F.max(order)).first()[0]  # one row
    keep = F.col(order) <= last
    if scope is not None:
        claims = claims.join(scope.select("claim_id", F.lit(True).alias("_in")).dropDuplicates(["claim_id"]), "claim_id", "left")
        keep = keep | F.coalesce("_in", F.lit(False))
    kept = claims.where(keep).drop("_in")
    return kept, total - kept.count()


def find_contradictions(claims: DataFrame, topic: str | None = None, threshold: float = CONTRADICT, cap: int = 50_000, bucket_cap: int = BUCKET_CAP, supports: bool = True, scope: DataFrame | None = None, order: str = "claim_id") -> tuple[DataFrame, int]:
    """Relations between claims of different videos, best first by (score, a, b), and the number of claims beyond the cap.

    Topic filter, then cap, then near mirrors (with a claim in ``scope``, where given), then entailment with a as the premise.
    """
    rows, dropped = capped(on_topic(claims, topic), order, cap, scope)
    found = relations(rows, mirrors(token_sets(rows), cap=bucket_cap, scope=scope), threshold)
    return (found if supports else found.where("relation = 'CONTRADICTS'")).orderBy(F.desc("score"), "a", "b"), dropped


def related(claims: DataFrame, pairs: DataFrame, across: bool = True) -> DataFrame:
    """NLI of every pair with the smaller id as premise: ``a, b, label, overlap``; with ``across`` only pairs of two videos."""
    a = claims.select(F.col("claim_id").alias("a"), F.col("video_id").alias("va"), F.col("text").alias("xa"))
    b = claims.select(F.col("claim_id").alias("b"), F.col("video_id").alias("vb"), F.col("text").alias("xb"))
    full = pairs.join(a, "a").join(b, "b")
    full = full.where("va <> vb") if across else full
    return full.withColumn("r", nli(F.col("xa"), F.col("xb"))).select("a", "b", "r.label", "r.overlap")


def relations(claims: DataFrame, pairs: DataFrame, threshold: float = CONTRADICT) -> DataFrame:
    """CONTRADICTS and SUPPORTS edges of mirrors of two videos from the threshold on: ``a, b, relation, score``."""
    r = related(claims, pairs).where((F.floor(F.col("overlap") * 1e4 + 0.5) / 1e4 >= threshold) & (F.col("label") != "neutral"))
    return r.select("a", "b", F.when(F.col("label") == "contradiction", "CONTRADICTS").otherwise("SUPPORTS").alias("relation"), F.col("overlap").alias("score"))


def supersede_duplicates(claims: DataFrame) -> DataFrame:
    """Committed claims of one video with equal normalized text: all but the earliest are superseded by it: ``claim_id, superseded_by``."""
    rows = claims.where("status = 'committed' and video_id is not null").withColumn("norm", X.normalized(F.col("text"))).where("norm <> ''")
    w = Window.partitionBy("video_id", "norm").orderBy(F.coalesce("t_start_s", F.lit(0.0)), "claim_id")
    return rows.withColumn("keeper", F.first("claim_id").over(w)).where("keeper <> claim_id").select("claim_id", F.col("keeper").alias("superseded_by"))


def supersede_corrected(claims: DataFrame, edges: DataFrame) -> DataFrame:
    """``claim_id, superseded_by``: committed claims that a committed claim CORRECTS; of several corrections the first.

    A correction points at an earlier claim, so that in order of the corrections every one is still committed when its turn comes.
    """
    ok = claims.where("status = 'committed'").select("claim_id")
    e = edges.where("rel = 'CORRECTS' and src <> dst").select("src", "dst").distinct()
    e = e.join(ok.withColumnRenamed("claim_id", "src"), "src", "left_semi").join(ok.withColumnRenamed("claim_id", "dst"), "dst", "left_semi")
    return e.groupBy(F.col("dst").alias("claim_id")).agg(F.min("src").alias("superseded_by"))


def dedup(claims: DataFrame, edges: DataFrame) -> DataFrame:
    """``claim_id, superseded_by``: repeated claims first, then, of what is still committed, corrected ones."""
    repeated = materialize(supersede_duplicates(claims))
    left = claims.join(repeated, "claim_id", "left_anti")
    return repeated.unionByName(supersede_corrected(left, edges))


def evolution(steps: DataFrame, edges: DataFrame) -> DataFrame:
    """The steps (subject, claim_id, day, t) of every subject in order of day, undated ones last, each with its relation to the step before.

    ``subject, claim_id, step, before, rel``: the relation is CONTRADICTS, else CORRECTS, else SUPPORTS, in either direction, else '-'.
    """
    w = Window.partitionBy("subject").orderBy(F.col("day").isNull(), "day", "t", "claim_id")
    rows = steps.select("subject", "claim_id", F.row_number().over(w).alias("step"), F.lag("claim_id").over(w).alias("before"))
    rank = F.when(F.col("rel") == "CONTRADICTS", 0).when(F.col("rel") == "CORRECTS", 1).when(F.col("rel") == "SUPPORTS", 2)
    e = edges.select("src", "dst", rank.alias("k")).where("k is not null")
    both = e.select(F.col("src").alias("before"), F.col("dst").alias("claim_id"), "k").unionByName(e.select(F.col("dst").alias("before"), F.col("src").alias("claim_id"), "k"))
    both = both.groupBy("before", "claim_id").agg(F.element_at(F.array(*map(F.lit, ("CONTRADICTS", "CORRECTS", "SUPPORTS"))), F.min("k") + 1).alias("rel"))
    return rows.join(both, ["before", "claim_id"], "left").withColumn("rel", F.coalesce("rel", F.lit("-")))


def consensus(members: DataFrame, halflife: float = 365.0) -> DataFrame:
    """Score per group of (group, claim_id, video_id, salience, day): half the sources (3 are full), a quarter the best salience, a quarter recency.

    Recency halves in ``halflife`` days against the newest day of all groups; without a day it is 0.5.
    """
    g = members.groupBy("group").agg(F.count_distinct("claim_id").alias("n_claims"), F.count_distinct("video_id").alias("support"), F.max(F.coalesce("salience", F.lit(0.0))).alias("authority"), F.max("day").alias("day"), F.max_by("claim_id", F.struct(F.coalesce("salience", F.lit(0.0)), "claim_id")).alias("representative"))
    newest = g.agg(F.max("day").alias("newest"))  # one row
    recency = F.coalesce(F.pow(F.lit(0.5), F.datediff("newest", "day") / F.lit(halflife)), F.lit(0.5))
    score = 0.5 * F.least(F.lit(1.0), F.col("support") / 3.0) + 0.25 * F.col("authority") + 0.25 * recency
    return g.crossJoin(F.broadcast(newest)).select("group", "n_claims", "support", "representative", F.least(F.lit(1.0), F.greatest(F.lit(0.0), score)).alias("score"))
