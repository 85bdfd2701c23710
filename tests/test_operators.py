import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import text as X
from tidemark.functions import vectors as V
from tidemark.operators import claims as C
from tidemark.operators import graph as G
from tidemark.operators import metrics as M
from tidemark.operators import retrieval as R
from tidemark.operators import segmentation as S
from tidemark.operators.clustering import first_fit
from tidemark.operators.intervals import merge_intervals
from tidemark.plans.claim_queries import candidate_pairs, verify_gate, voiceprint_cluster
from tidemark.plans.misc_queries import lexical_prefilter
from tidemark.plans.segment_queries import corrects_asof


def merged(rows):
    out = []
    by = {}
    for e, s, t in rows:
        if e is not None and s is not None and t is not None and t > s:
            by.setdefault(e, []).append((s, t))
    for e, spans in by.items():
        spans.sort()
        cur = list(spans[0])
        for s, t in spans[1:]:
            if s <= cur[1]:
                cur[1] = max(cur[1], t)
            else:
                out += [(e, "period", *cur), (e, "gap", cur[1], s)]
                cur = [s, t]
        out.append((e, "period", *cur))
    return sorted(out)


@pytest.mark.parametrize("parts", [1, 3, 40])
def test_intervals_against_brute_force(spark, parts):
    rng = random.Random(parts)
    rows = []
    for _ in range(600):
        e = "hot" if rng.random() < 0.4 else rng.choice(["a", "b", "c", None])
        s = rng.randint(0, 3000)
        rows.append((e, None if rng.random() < 0.03 else s, s + rng.choice([0, 1, 3, 8, 40, -2])))
    rows += rows[:30]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "e string, s long, t long, pid int, kind string")
    got = merge_intervals(df, F.col("e"), F.col("s"), F.col("t"), parts)
    assert sorted(map(tuple, got.collect())) == merged(rows)


def test_intervals_empty_and_nested(spark):
    empty = spark.createDataFrame([], "e string, s long, t long")
    assert merge_intervals(empty, F.col("e"), F.col("s"), F.col("t")).count() == 0
    one = spark.createDataFrame([("a", 0, 100), ("a", 5, 6), ("a", 100, 110), ("a", 120, 130)], "e string, s long, t long")
    assert sorted(map(tuple, merge_intervals(one, F.col("e"), F.col("s"), F.col("t"), 4).collect())) == [("a", "gap", 110, 120), ("a", "period", 0, 110), ("a", "period", 120, 130)]


def test_text_expressions(spark):
    df = spark.createDataFrame([("One is a test. Two? Yes (it) is.", 3725.5), (None, None), ("", -1.0)], "t string, s double")
    r = df.select(X.tokens(F.col("t")), X.sentences(F.col("t")), X.hms(F.col("s")), X.slugify(F.col("t")), X.predicate_of(F.coalesce("t", F.lit("")))).collect()
    assert r[0][0] == ["one", "is", "a", "test", "two", "yes", "it", "is"] and r[0][1] == ["One is a test.", "Two?", "Yes (it) is."]
    assert r[0][2] == "1:02:06" and r[0][3] == "one-is-a-test-two-yes-it-is" and r[0][4] == "is a"
    assert r[1][0] == [] and r[1][1] == [] and r[1][2] == "0:00" and r[2][3] == "untitled"


def test_links_and_dates(spark):
    df = spark.createDataFrame([("https://youtu.be/abcdefghijk", "20240102"), ("https://x.example/a", "2024-01-02T03:04:05Z"), (None, "soon")], "u string, d string")
    r = df.select(X.video_key(F.col("u")), X.deep_link(F.col("u"), F.lit(61.9)), X.iso_timestamp(F.col("d")).cast("string")).collect()
    assert r[0][0] == "abcdefghijk" and r[0][1] == "https://youtu.be/abcdefghijk?t=61" and r[1][1].endswith("#t=61") and r[2][1] is None
    assert r[0][2].startswith("2024-01-02") and r[1][2] == "2024-01-02 03:04:05" and r[2][2] is None


def test_entailment_is_asymmetric(spark):
    df = spark.createDataFrame([("scaling laws will hold beyond budgets", "scaling laws will not hold beyond budgets"), ("cats sleep", "dogs bark loudly"), ("", "the of")], "p string, h string")
    r = [x[0] for x in df.select(C.nli(F.col("p"), F.col("h"))).collect()]
    assert r[0].label == "contradiction" and r[1].label == "neutral" and r[2].label == "neutral" and r[2].overlap == 0.33


def test_mirrors_against_brute_force(spark):
    rng = random.Random(4)
    words = [f"w{i:03d}" for i in range(150)]
    texts = {f"c{i:03d}": rng.sample(words, 12) for i in range(120)}
    for i in range(60):
        base = list(texts[f"c{i:03d}"])
        for _ in range(rng.randint(0, 6)):
            base[rng.randrange(12)] = rng.choice(words)
        texts[f"d{i:03d}"] = base
    df = spark.createDataFrame([(k, "v", " ".join(v)) for k, v in texts.items()], "claim_id string, video_id string, text string")
    got = {(r.a, r.b) for r in C.mirrors(C.token_sets(df)).collect()}
    want = set()
    keys = sorted(texts)
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            x, y = set(texts[a]), set(texts[b])
            if len(x & y) >= 3 and 2 * len(x & y) >= len(x | y):
                want.add((a, b))
    assert got == want and want


def test_groups_chains_and_cycles(spark):
    pairs = spark.createDataFrame([("b", "a"), ("b", "c"), ("d", "e"), ("f", "f"), ("c", "g"), ("a", "b")], "a string, b string")
    assert {(r.node, r.group) for r in G.equivalence_groups(pairs).collect()} == {("a", "a"), ("b", "a"), ("c", "a"), ("g", "a"), ("d", "d"), ("e", "d")}
    chain = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("x", "y"), ("n", None)], "n string, t string")
    assert {(r.node, r.last, r.steps) for r in G.follow(chain, "n", "t").collect()} == {("a", "d", 3), ("b", "d", 2), ("c", "d", 1), ("x", "y", 1)}
    ring = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a")], "n string, t string")
    assert G.follow(ring, "n", "t").count() == 3
    seeds = spark.createDataFrame([("a",)], "seed string")
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d")], "src string, dst string")
    assert {(r.node, r.hop) for r in G.expand(seeds, edges, 2).collect()} == {("b", 1), ("c", 2)}
    assert G.equivalence_groups(pairs.limit(0)).count() == 0


def test_first_fit_against_the_sequential_fold(spark):
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((12, 16))
    vecs = [(i, (centres[rng.integers(12)] + 0.4 * rng.standard_normal(16)).tolist()) for i in range(300)] + [(900, [0.0] * 16)]
    got = {r.key: r.leader for r in first_fit(spark.createDataFrame(vecs, "key long, vec array<double>"), 0.75, chunk=20).collect()}
    leaders, want = [], {}
    for k, v in vecs:
        u = np.array(v) / (np.linalg.norm(v) or 1)
        hit = next((name for name, x in leaders if x @ u >= 0.75 - 1e-12), None) if k != 900 else None
        want[k] = hit if hit is not None else k
        if hit is None and k != 900:
            leaders.append((k, u))
    assert got == want


def test_candidate_pairs_of_tokens_in_up_to_200_claims(spark, tmp_path):
    texts = [" ".join(w for w, n in (("harbour", 21), ("furnace", 200), ("trellis", 201), ("lantern", 2)) if i < n) + f" own{i}" for i in range(201)]
    rows = [(f"c{i:03d}", "m", "v", t) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "claim_id string, moment_id string, video_id string, text string").write.parquet(f"{tmp_path}/claims.parquet")
    sets = [set(t.split()) - {"trellis"} for t in texts]
    want = {(f"c{i:03d}", f"c{j:03d}", len(sets[i] & sets[j])) for i in range(201) for j in range(i + 1, 201) if sets[i] & sets[j]}
    assert {tuple(r) for r in candidate_pairs(spark, str(tmp_path)).select("a", "b", "shared").collect()} == want


def test_verify_gate_takes_the_claims_own_span(spark, tmp_path):
    cues = [(i, f"Filler sentence number {i} speaks about granite quarries and wooden bridges.") for i in range(8)] + [(8, "The harbour furnace melted forty lanterns.")]
    seg = [(i, "v", 10.0 * i, 10.0 * i + 9, t, None, "speech") for i, t in cues]
    seg += [(9, "v", 200.0, 209.0, "Speech of another moment.", None, "speech")]
    claims = [("strange", "Forty lanterns melted in the harbour furnace.", 200.0, 209.0), ("paraphrase", "Forty lanterns melted in the harbour furnace.", 80.0, 89.0), ("elsewhere", "Forty lanterns melted in the harbour furnace.", 0.0, 9.0), ("nospan", "Forty lanterns melted in the harbour furnace.", None, None), ("run", cues[8][1], 0.0, 9.0)]
    spark.createDataFrame([(c, "m", "v", t, a, b) for c, t, a, b in claims], "claim_id string, moment_id string, video_id string, text string, t_start_s double, t_end_s double").write.parquet(f"{tmp_path}/claims.parquet")
    spark.createDataFrame([("m", "v", " ".join(t for _, t in cues))], "moment_id string, video_id string, transcript string").write.parquet(f"{tmp_path}/moments.parquet")
    spark.createDataFrame(seg, "seg_id long, video_id string, start_s double, end_s double, text string, speaker string, kind string").write.parquet(f"{tmp_path}/segments.parquet")
    got = {r.claim_id: (r.status, r.entailment) for r in verify_gate(spark, str(tmp_path)).collect()}
    assert got == {"strange": ("committed", 1.0), "paraphrase": ("committed", 1.0), "elsewhere": ("unsupported", 0.0), "nospan": ("committed", 1.0), "run": ("committed", 1.0)}


def test_corrects_asof_by_subject_or_mention(spark, tmp_path):
    rows = [("c1", "v", "FACT", "the old furnace", "The old furnace burned.", None), ("c2", "v", "FACT", "a dock", "A dock was built by Ada Brimley.", None), ("c3", "v", "FACT", "brimley", "Lanterns were lit.", None)]
    rows += [("c4", "v", "CORRECTION", "the furnace", "The furnace was sold to Ada Brimley.", None), ("c5", "w", "CORRECTION", "nothing", "It was sold to Ada Brimley.", None), ("c6", "v", "CORRECTION", "rails", "Rails were bent.", "by NASA"), ("c7", "v", "CORRECTION", "ropes", "Ropes of NASA.", None)]
    df = spark.createDataFrame([(c, "m", v, "s", k, s, t, o, "committed") for c, v, k, s, t, o in rows], "claim_id string, moment_id string, video_id string, speaker_id string, claim_type string, subject string, text string, obj string, status string")
    df.write.parquet(f"{tmp_path}/claims.parquet")
    # c3 has the word brimley as a subject, which is no mention of Ada Brimley.
    assert {(r.src, r.dst) for r in corrects_asof(spark, str(tmp_path)).collect()} == {("c4", "c2"), ("c7", "c6")}


def test_lexical_prefilter_with_short_terms(spark, tmp_path):
    spark.createDataFrame([(100, "red kiln"), (200, "kilns of granite")], "probe_id long, q string").write.parquet(f"{tmp_path}/iterm_probes.parquet")
    spark.createDataFrame([("m1", "a red door"), ("m2", "two kilns burn"), ("m3", "granite walls"), ("m4", "blue sky")], "moment_id string, transcript string").write.parquet(f"{tmp_path}/moments.parquet")
    allowed = {(100, "m1"), (100, "m2"), (200, "m2"), (200, "m3")}
    dense = {(r.qid, r.key) for r in R.dense(spark.createDataFrame([(100, "red kiln"), (200, "kilns of granite")], "qid long, question string"), spark.read.parquet(f"{tmp_path}/moments.parquet").selectExpr("moment_id as key", "transcript as text")).collect()}
    got = {(r.qid, r.moment_id) for r in lexical_prefilter(spark, str(tmp_path)).collect()}
    assert got == allowed & dense and (100, "m1") in got


def test_lexical_prefilter_lists_no_pairs(spark, tmp_path):
    rng = random.Random(6)
    words = [a + b for a in ("kil", "gran", "har", "tre", "lan", "fur") for b in ("n", "ite", "bour", "llis", "tern", "nace")]
    moments = [(f"m{i:03d}", " ".join(["the", *rng.choices(words, k=8)])) for i in range(398)] + [("m398", "zebra"), ("m399", "zebra2 owl owl"), (None, "the kiln")]
    probes = [(100 * i, f"the {rng.choice(words)[:3]} {rng.choice(words)}") for i in range(1, 101)]
    probes += [(20000, " ".join([f"w{i}" for i in range(250)] + ["zebra"])), (20100, "..."), (20200, None), (20300, "quite unknown"), (20400, "zebra")]
    spark.createDataFrame(moments, "moment_id string, transcript string").write.parquet(f"{tmp_path}/moments.parquet")
    spark.createDataFrame(probes, "probe_id long, q string").write.parquet(f"{tmp_path}/iterm_probes.parquet")
    grams, want, pairs = R._Grams(), set(), 0
    vec = lambda t: grams.vector(t).astype(float)
    corpus = [(key, ts, vec(ts)) for key, text in moments if key and (ts := R.TOKEN.findall(text))]
    for qid, text in probes:
        asked = R.TOKEN.findall(text or "")
        q, found = vec(asked), []
        for key, ts, d in corpus:
            if any(t.startswith(a) for t in ts for a in asked):
                pairs += 1
                if ((q != 0) & (d != 0)).any():
                    found.append((-np.floor(q @ d / (np.sqrt(d @ d) * np.sqrt(q @ q)) * 1e6 + 0.5) / 1e6, key))
        want |= {(qid, key, -s) for s, key in sorted(found)[:10]}
    store, listed, none = spark._jsc.sc().statusStore(), spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava, spark.sparkContext._gateway.new_array(spark._jvm.double, 0)
    stages = lambda: {(x.stageId(), x.attemptId()): x.shuffleWriteRecords() for x in listed(store.stageList(None, False, False, none, None))}
    before = stages()
    got = lexical_prefilter(spark, str(tmp_path)).collect()
    spark._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    assert {tuple(r) for r in got} == want and len(got) == len(want)
    assert (20000, "m398") in {(r.qid, r.moment_id) for r in got}
    # Moments and probes once, and at most ten rows of a question from each of the four tasks.
    assert pairs > 39_000 and sum(n for k, n in stages().items() if k not in before) < 6_000


def test_voiceprint_cluster_compares_with_leaders_beyond_512(spark, tmp_path):
    rng = np.random.default_rng(8)
    vecs = rng.standard_normal((700, 64))
    vecs = np.concatenate([vecs, vecs[600:] + 0.05 * rng.standard_normal((100, 64))])
    df = spark.createDataFrame([(i, v.tolist(), "x") for i, v in enumerate(vecs)], "vec_id long, embedding array<double>, label string")
    df.write.parquet(f"{tmp_path}/embeddings.parquet")
    want = {i: i if i < 700 else i - 100 for i in range(800)}
    assert {r.vec_id: r.leader for r in voiceprint_cluster(spark, str(tmp_path)).collect()} == want
    small = df.selectExpr("vec_id as key", "embedding as vec").where("key >= 580")
    assert {r.key: r.leader for r in first_fit(small, 0.75, most=None, chunk=30).collect()} == {i: want[i] for i in range(580, 800)}


def test_fold_and_overlap(spark):
    rng = random.Random(2)
    rows, t = [], 0.0
    for i in range(200):
        t += rng.choice([0.5, 1.0, 4.0])
        rows.append(("v", i, t, t + 0.4, rng.choice(["a", "b", None]), "speech", f"word {i}"))
    seg = spark.createDataFrame(rows, "video_id string, seg_id long, start_s double, end_s double, speaker string, kind string, text string")
    isl = S.islands(S.speech_segments(seg), S.audio_events(seg)).select("video_id", "island", "seg_id", "t0", "t1", "speaker", "text")
    got = {r.seg_id: (r.island, r.grp) for r in S.fold(isl, max_s=3.0).collect()}
    want, group, start, who, end, prev = {}, 0, None, None, None, None
    marks = {}
    for _, i, t0, t1, sp, _, _ in rows:
        if start is None or t0 - end > 2.5 or (sp and who and sp != who) or end - start >= 3.0:
            group, start, who = group + 1, t0, None
        who, end = who or sp, t1
        want[i] = group
    for i in sorted(want):
        marks.setdefault(want[i], set()).add(got[i])
    assert all(len(x) == 1 for x in marks.values()) and len({next(iter(x)) for x in marks.values()}) == len(marks)
    a = spark.createDataFrame([("v", i, float(i), i + rng.random() * 50) for i in range(80)], "video_id string, a_id long, a0 double, a1 double")
    b = spark.createDataFrame([("v", i, i * 1.5, i * 1.5 + rng.random() * 90) for i in range(60)], "video_id string, b_id long, b0 double, b1 double")
    pairs = [(r.a_id, r.b_id) for r in S.overlap_join(a, b, 10.0).collect()]
    brute = [(x.a_id, y.b_id) for x in a.collect() for y in b.collect() if x.a0 <= y.b1 and x.a1 >= y.b0]
    assert sorted(pairs) == sorted(brute)


def test_vectors_and_metrics(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0]), ([0.0, 0.0], [1.0, 1.0])], "a array<double>, b array<double>")
    r = df.select(V.cosine(F.col("a"), F.col("b")), V.frame_distance(F.col("a"), F.col("b")), V.normalize(F.col("a"))).collect()
    assert abs(r[0][0] - 0.5**0.5) < 1e-12 and r[1][0] == 0 and r[0][1] == 0.5 and r[1][2] == [0.0, 0.0]
    v = spark.createDataFrame([(float(i),) for i in random.Random(1).sample(range(1000), 137)], "x double")
    s = sorted(r.x for r in v.collect())
    assert M.nearest_rank(v, "x", 0.95).collect()[0][0] == s[min(136, int(0.95 * 137))]
    assert M.nearest_rank(v.limit(0), "x", 0.95).count() == 0


def test_fuzzy_names_against_the_sequential_fold(spark):
    from difflib import SequenceMatcher

    from tidemark.operators.names import fuzzy_names

    rng = random.Random(6)
    names = ["ada brimley", "ada brimely", "adda brimley", "ada brimleyy", "paul calder", "paula x", " ", None, "ada brimley", "al", "bo", "x"]
    for base in ("eleanora winterbourne of calderdale", "maximilian oltanworth", "jo park", "dr fenumrin halvik"):
        for _ in range(25):
            w = list(base)
            for _ in range(rng.randint(0, 3)):
                i = rng.randrange(len(w))
                w[i : i + rng.randint(0, 1)] = rng.choice(["", "a", "e", "zz"])
            names.append("".join(w).strip())
    want, leaders = {}, []
    for n in sorted({n.strip() for n in names if n and n.strip()}):
        want[n] = next((x for x in leaders if SequenceMatcher(None, x, n).ratio() >= 0.9), n)
        if want[n] == n:
            leaders.append(n)
    got = {r.name: r.canonical for r in fuzzy_names(spark.createDataFrame([(n, 1) for n in names], "who string, name int"), "who").collect()}
    assert got == want and len(leaders) < len(want)
    assert fuzzy_names(spark.createDataFrame([], "who string"), "who").count() == 0


def test_captions_links_and_labels(spark):
    """Expected values worked out by hand from the rules."""
    rows = [
        ("<v Ann>Well &amp; good [applause] [door creaks] a[i] = b[i,j]", "Well & good a[i] = b[i,j]", ["applause", "door creaks"]),
        ("see [our notes](https://x.example/a) now >> BOB :so um what [ __ ] then", "see our notes now so what then", []),
        ("Rob Wiblin: hello there", "hello there", []),
        ("But caveat: it rains", "But caveat: it rains", []),
        ("Note: it rains", "Note: it rains", []),
        ("[Music playing softly]&#91;laughter&#93; Uh, hmm", "", ["music", "laugh"]),  # the list of sounds decides, in its order
        (None, "", []),
    ]
    df = spark.createDataFrame([(i, r[0]) for i, r in enumerate(rows)], "i int, t string")
    got = {r[0]: (r[1], r[2]) for r in df.select("i", X.clean_caption(F.col("t")), X.events_in(F.col("t"))).collect()}
    assert [got[i] for i in range(len(rows))] == [(r[1], r[2]) for r in rows]
    said = spark.createDataFrame([("The end. ADDIS So we go. Addis: right", ["addis"])], "t string, who array<string>")
    assert said.select(X.clean_caption(F.col("t"), F.col("who"))).first()[0] == "The end. So we go. right"
    urls = [("https://www.youtube.com/embed/abc123?x=1", "abc123"), ("https://music.youtube.com/watch?list=3&v=Zz_-9&v=no", "Zz_-9"), ("https://other.example/embed/abc123", None), ("youtu.be/abc", None), ("https://youtu.be/q1#t=3", "q1")]
    u = spark.createDataFrame(urls, "u string, k string")
    assert all(r[0] == r[1] for r in u.select(X.video_key(F.col("u")), "k").collect())
    one = spark.createDataFrame([("https://youtu.be/q1", 5.9, float("nan"))], "u string, a double, b double")
    assert one.select(X.ranged_link(F.col("u"), F.col("a"), F.col("b"))).first()[0] == "https://www.youtube.com/watch?v=q1&start=5&end=0"
    assert one.select(X.span_label(F.col("a"), F.col("b"))).first()[0] == "0:06–?"
    slugs = spark.createDataFrame([("Ünïted Straße № 5 — ﬁne",)], "t string").select(X.slugify(F.col("t"))).first()[0]
    assert slugs == "united-strae-no-5-fine"


def test_claim_rules(spark):
    """Expected values worked out by hand from the cue lists."""
    rows = [
        ("I feel the pump is old.", "OPINION", "is", False),
        ("Support for this show comes from a bank.", "FACT", "", True),
        ("Hello everyone, today the mill, the dam and the old canal are shown.", "FACT", "are", False),
        ("Hey, it works.", "FACT", "", True),
        ("Sign up now.", "FACT", "", True),
        ("Check out our page at www.x.example for more.", "FACT", "", True),
        ("The crew recommends two coats.", "FACT", "recommends", False),
        ("I misspoke, it was red.", "CORRECTION", "was", False),
    ]
    df = spark.createDataFrame([(r[0],) for r in rows], "t string")
    got = df.select(X.epistemic_type(F.col("t")), X.predicate_of(F.col("t")), X.low_value(F.col("t"))).collect()
    assert [tuple(g) for g in got] == [r[1:] for r in rows]
    m = spark.createDataFrame([("The Transformer by Ada Brimley beats LLMs.", "In New York", "GPT-4 and BERT")], "a string, b string, c string")
    assert m.select(X.mentions_of(F.col("a"), F.col("b"), F.col("c"))).first()[0] == ["LLM", "Transformer", "Ada Brimley", "New York", "GPT-4", "BERT"]


def test_scoped_mirrors_equal_that_part_of_a_full_pass(spark):
    rng = random.Random(14)
    words = [f"w{i:02d}" for i in range(60)]
    base = [rng.sample(words, 8) for _ in range(40)]
    texts = {f"c{i:03d}": [*rng.choice(base)[:6], *rng.sample(words, 2)] for i in range(150)}
    df = spark.createDataFrame([(k, "v", " ".join(v)) for k, v in texts.items()], "claim_id string, video_id string, text string")
    sets, new = C.token_sets(df), {k for k in texts if rng.random() < 0.2}
    full = {(r.a, r.b) for r in C.mirrors(sets).collect()}
    part = {(r.a, r.b) for r in C.mirrors(sets, scope=spark.createDataFrame([(k,) for k in new], "claim_id string")).collect()}
    assert part == {p for p in full if p[0] in new or p[1] in new} and part != full and part


def test_history_dedup_and_evolution(spark):
    chain = spark.createDataFrame([("a", "b"), ("b", "c"), ("x", "y"), ("y", "x"), ("n", None)], "claim_id string, superseded_by string")
    seeds = spark.createDataFrame([("b",), ("x",)], "claim_id string")
    assert {(r.seed, r.node, r.step) for r in G.history(chain, seeds).collect()} == {("b", "b", 0), ("b", "c", 1), ("b", "a", -1), ("x", "x", 0), ("x", "y", 1)}
    rows = [("c1", "v", "The kiln is hot.", "committed", 1.0), ("c2", "v", "the kiln is HOT", "committed", 2.0), ("c3", "v", "It is cold.", "committed", 3.0), ("c4", "v", "No, it is mild.", "committed", 4.0), ("c5", "v", "gone", "superseded", 0.0)]
    claims = spark.createDataFrame(rows, "claim_id string, video_id string, text string, status string, t_start_s double")
    edges = spark.createDataFrame([("c4", "CORRECTS", "c3"), ("c3", "CORRECTS", "c1"), ("c4", "CORRECTS", "c2"), ("c3", "CORRECTS", "c5")], "src string, rel string, dst string")
    assert {tuple(r) for r in C.dedup(claims, edges).collect()} == {("c2", "c1"), ("c3", "c4"), ("c1", "c3")}
    steps = spark.createDataFrame([("e", "c1", "2024-01-02", 1.0), ("e", "c3", "2024-01-02", 0.5), ("e", "c4", None, 0.0)], "subject string, claim_id string, day string, t double")
    rel = spark.createDataFrame([("c1", "SUPPORTS", "c3"), ("c3", "CORRECTS", "c1")], "src string, rel string, dst string")
    assert {(r.claim_id, r.step, r.rel) for r in C.evolution(steps, rel).collect()} == {("c3", 1, "-"), ("c1", 2, "CORRECTS"), ("c4", 3, "-")}


def test_search_legs_and_scope(spark):
    texts = {"v1#m0": "the red kiln by the harbour", "v1#m1": "kilns and kilns of granite", "v2#m0": "a kiln in the snow", "v2#m1": "nothing here", "v2#m2": ""}
    corpus = spark.createDataFrame([(k, k.split("#")[0], t) for k, t in texts.items()], "key string, video_id string, text string")
    index = R.build_index(corpus, ["video_id"])
    q = spark.createDataFrame([(1, "red kiln", None), (2, "red kiln", "v2"), (3, "", None)], "qid int, question string, video_id string")
    got = {}
    for r in R.ranked(R.search(q, index, 3, ("lexical",)), 3).orderBy("qid", "rank").collect():
        got.setdefault(r.qid, []).append(r.key)
    assert got == {1: ["v1#m0", "v1#m1", "v2#m0"], 2: ["v2#m0"]}
    claims = spark.createDataFrame([("a", "v1#m0", "committed"), ("b", "v2#m1", "committed"), ("c", "v2#m0", "superseded")], "claim_id string, moment_id string, status string")
    edges = spark.createDataFrame([("a", "CONTRADICTS", "b"), ("a", "SUPPORTS", "c"), ("a", "ELABORATES", "c")], "src string, rel string, dst string")
    fused = spark.createDataFrame([(1, "v1#m0", 0.1)], "qid int, key string, score double")
    assert [(r.key, r.score) for r in R.graph_leg(fused, claims, edges, ["CONTRADICTS", "SUPPORTS"]).collect()] == [("v2#m1", 0.5)]
    vecs = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [1.0, 1.0]), ("c", [1.0]), ("d", [None, 1.0]), ("e", [float("inf"), 0.0])], "key string, vec array<double>")
    near = R.vector_search(spark.createDataFrame([(7, [2.0, 0.0])], "qid int, vec array<double>"), vecs, 5).orderBy("rank").collect()
    assert [(r.key, r.score) for r in near] == [("a", 1.0), ("b", 0.707107)]


def test_grounding():
    ok = ["The mill closed [1].", "It closed. [1] It opened again [2].", "Dr. Lee said 3.5 metres [1].", "One [1]\nTwo [2]."]
    bad = ["The mill closed.", "It closed [3].", "It closed [1]. It opened.", "One [1]\nTwo.", "", None, "It closed [1] and then"]
    assert all(R.grounded(t, 2) for t in ok) and not any(R.grounded(t, 2) for t in bad[:-1])


def test_overlap_with_long_spans(spark):
    rng = random.Random(21)
    span = lambda: (s := rng.random() * 5000, s + rng.choice([1, 3, 30, 700, 90_000, 9e6]) * rng.random())
    a = [("v", i, *span()) for i in range(120)]
    b = [("v", i, *span()) for i in range(120)]
    x = spark.createDataFrame(a, "video_id string, a_id long, a0 double, a1 double")
    y = spark.createDataFrame(b, "video_id string, b_id long, b0 double, b1 double")
    got = [(r.a_id, r.b_id) for r in S.overlap_join(x, y, 10.0).collect()]
    assert sorted(got) == sorted((p[1], q[1]) for p in a for q in b if p[2] <= q[3] and p[3] >= q[2])
    assert S.overlap_join(x.limit(0), y, 10.0).count() == 0


def test_locate_narrows_to_words(spark):
    claims = spark.createDataFrame([("c", "v", "The kiln melted forty lanterns", 0.0, 50.0), ("d", "v", "nothing of it", 0.0, 50.0)], "claim_id string, video_id string, text string, a0 double, a1 double")
    cues = [("v", 1, 0.0, 9.0, "the kiln was old", None), ("v", 2, 10.0, 20.0, "well the kiln melted forty lanterns then", [(10.0, 11.0, "well"), (12.0, 13.0, "kiln"), (14.0, 16.5, "Lanterns,")]), ("v", 3, 60.0, 70.0, "the kiln melted forty lanterns", None)]
    seg = spark.createDataFrame(cues, "video_id string, seg_id long, b0 double, b1 double, text string, words array<struct<t0:double,t1:double,word:string>>")
    assert [tuple(r) for r in C.locate(claims, seg).collect()] == [("c", 2, 5, 12.0, 16.5)]
    assert [(r.t_start_s, r.t_end_s) for r in C.locate(claims, seg.drop("words")).collect()] == [(10.0, 20.0)]
