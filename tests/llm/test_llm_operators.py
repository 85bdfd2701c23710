import os
import random
import sys
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(__file__))

from tidemark.llm import components, defects, neardup, packing, quality, splitting, tokens, turns, vectors
from tidemark.llm.holdout import CHECKED
from tidemark.session import table


# --- 1: similar vectors -------------------------------------------------------------------------------------------------
def brute_neighbours(rows, k):
    keys = sorted(rows)
    m = np.array([rows[i] for i in keys])
    m = m / np.linalg.norm(m, axis=1, keepdims=True)
    out = {}
    for a, i in enumerate(keys):
        s = m @ m[a]
        order = sorted((j for j in range(len(keys)) if j != a), key=lambda j: (-round(float(s[j]), 9), keys[j]))
        out[i] = [keys[j] for j in order[:k]]
    return out


def test_vectors_against_brute_force(spark):
    rng = np.random.default_rng(5)
    centres = rng.random((40, 64))
    rows = {i: np.clip(centres[i % 40] + 0.05 * rng.standard_normal(64), 0, 1).astype(np.float32).astype(float) for i in range(900)}
    hot = rows[0]
    rows.update({2000 + i: hot for i in range(450)})  # a third of all rows carry one vector
    bad = [(1, None), (2, []), (3, [0.0] * 64), (4, [1.0] * 63), (5, [float("nan")] + [1.0] * 63), (6, [None] + [1.0] * 63)]
    data = [(k, v.tolist(), 7) for k, v in rows.items()] + [(10_000 + k, v, 7) for k, v in bad] + [(5, rows[5].tolist(), 8)]
    df = spark.createDataFrame(data, "event_id long, embedding array<double>, point int")
    got = {}
    for r in vectors.similar_vectors(df, "event_id", "embedding").collect():
        got.setdefault(r.event_id, []).append(r.neighbor)
    want = brute_neighbours(rows, 5)
    assert set(got) == set(want) and all(len(v) == 5 and len(set(v)) == 5 for v in got.values())
    assert sum(len(set(got[k]) & set(want[k])) for k in want) / (5 * len(want)) >= 0.98
    assert sorted(got[2100]) == [0, 2000, 2001, 2002, 2003] and sorted(got[0]) == [2000, 2001, 2002, 2003, 2004]


def test_vectors_do_not_depend_on_shuffle_partitions(spark):
    rng = np.random.default_rng(12)
    rows = {i: rng.standard_normal(64).astype(np.float32).astype(float) for i in range(900)}
    df = spark.createDataFrame([(i, v.tolist()) for i, v in rows.items()], "event_id long, embedding array<double>")
    known = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "200")
    try:
        got = {(r.event_id, r.neighbor) for r in vectors.similar_vectors(df, "event_id", "embedding").collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", known)
    want = {(i, j) for i, found in brute_neighbours(rows, 5).items() for j in found}
    assert len(got & want) >= 0.999 * len(want)


def test_vectors_do_not_depend_on_ranges(spark):
    """Halo rows make many small ranges as good as one."""
    rng = np.random.default_rng(3)
    rows = {i: (rng.standard_normal(8) @ np.random.default_rng(1).standard_normal((8, 64)) + 0.3 * rng.standard_normal(64)).astype(np.float32).astype(float) for i in range(5000)}
    df = spark.createDataFrame([(i, v.tolist()) for i, v in rows.items()], "event_id long, embedding array<double>")
    want = {(i, j) for i, found in brute_neighbours(rows, 5).items() for j in found}
    share = []
    for task_rows in (5000, 1000):
        got = {(r.event_id, r.neighbor) for r in vectors.similar_vectors(df, "event_id", "embedding", candidates=700, task_rows=task_rows).collect()}
        share.append(len(got & want) / len(want))
    assert min(share) >= 0.95 and abs(share[0] - share[1]) < 0.003, share


def test_vectors_few_and_none(spark):
    schema = "event_id long, embedding array<double>"
    assert vectors.similar_vectors(spark.createDataFrame([], schema), "event_id", "embedding").count() == 0
    assert vectors.similar_vectors(spark.createDataFrame([(1, [1.0] * 64)], schema), "event_id", "embedding").count() == 0
    two = vectors.similar_vectors(spark.createDataFrame([(1, [1.0] * 64), (2, [2.0] * 64)], schema), "event_id", "embedding").collect()
    assert {(r.event_id, r.neighbor) for r in two} == {(1, 2), (2, 1)}


# --- 2: defects ---------------------------------------------------------------------------------------------------------
COMMON = {"en": {"the", "of", "and", "in", "was", "at", "to", "for"}, "de": {"der", "die", "das", "und", "in", "war", "von", "hat"}, "fr": {"le", "la", "de", "et", "un", "dans", "a", "pour"}, "es": {"el", "la", "de", "y", "un", "en", "ha", "por"}}
EN = ["The mill at the harbour was closed in the spring and the wheel was taken to the yard. [1] The crew of the boat was at the gate. [2]", "A lamp in the tower was lit for the pilots of the harbour and for the fishermen. [1]", "The rope at the end of the pier was cut in the storm and nobody was hurt. [1]"]
DE = ["Der alte Müller hat das Rad im Herbst repariert und die Mühle war in der Woche offen. [1]", "Die Werkstatt von der Küste hat den Kutter und das Netz in der Nacht verkauft. [1]"]


def test_defects(spark):
    languages = defects.Languages(EN * 8 + DE * 8, COMMON)
    ends = defects.Ends(EN * 20 + DE * 20)
    judge = lambda q, a: defects.judge(q, a, languages, ends)
    q = "What was at the end of the pier in the harbour?"
    for empty in (None, "", "  ", "​", "...", "[1] [2]", "N/A", "null", "—"):
        assert judge(q, empty) == "empty"
    for copy in (q, q.upper(), "You asked: " + q, f"Q: {q}\nA: {q}", q + " [1]", q.replace("harbour", "harbor")):
        assert judge(q, copy) == "copy"
    for refusal in ("I do not know.", "Sorry, none of the videos cover this.", "Tut mir leid, dazu weiß ich nichts über das Netz.", "Lo siento, no encuentro nada sobre eso.", "Désolé, je n’ai rien trouvé sur ce sujet."):
        assert judge(q, refusal) == "refusal"
    asked = "What happened to the harbour in 1998?"
    assert judge(asked, "I cannot answer what happened in 1998.") == "refusal"
    assert judge(asked, "I don't know was the reply of Ada, and Brimley measured 98 metres in 1998.") != "refusal"
    assert judge(q, "I don't know was the reply of Ada, and Brimley measured 12 metres instead.") != "refusal"
    assert judge(q, DE[0]) == "other_language" and judge("Was hat der Müller in der Mühle und von der Küste verkauft?", EN[1]) == "other_language"
    assert judge(q, "The mill at the harbour was closed in the spri") == "truncated" and judge(q, "The mill at the harbour was closed in the spring and the wheel [1") == "truncated"
    assert judge(q, EN[0]) is None and judge(q, "12 barrels") is None and judge(q, "Brimley") is None and judge(None, EN[1]) is None
    rows = [(1, q, EN[0], 1), (1, q, EN[0], 2), (2, q, None, 1), (3, None, None, 1), (4, q, q, 1), (None, q, None, 1)]
    pairs = spark.createDataFrame(rows, "probe_id long, q string, answer string, key int")
    words = spark.createDataFrame([(k, w) for k, v in COMMON.items() for w in v], "lang string, word string")
    assert {(r.probe_id, r.defect) for r in defects.broken_pairs(pairs, words).collect()} == {(2, "empty"), (3, "empty"), (4, "copy")}
    assert defects.broken_pairs(pairs.limit(0), words).count() == 0


# --- 4: components ------------------------------------------------------------------------------------------------------
@pytest.mark.parametrize("bound", [40, 150, 10_000])
def test_components_against_union_find(spark, bound):
    rng = random.Random(2)
    names = [f"c{i:04d}" for i in range(500)] + ["é", "Z", "ß"]
    pairs = [(rng.choice(names), rng.choice(names)) for _ in range(350)]
    pairs += [(f"z{i:03d}", f"z{i + 1:03d}") for i in range(150)] + [("hub", f"h{i}") for i in range(200)] + [(None, "c1"), ("c1", None), ("c1", "c1")]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        if a and b and a != b:
            a, b = sorted((find(a), find(b)), key=lambda s: s.encode())
            parent[b] = a
    df = spark.createDataFrame([(a, b, "x") for a, b in pairs], "a string, b string, node string").repartition(5)
    got = {r.node: r.group for r in components.connected_components(df, F.col("a"), F.col("b"), bound).collect()}
    assert got == {x: find(x) for x in parent}


@pytest.mark.parametrize("names", ["in order", "at random"])
def test_components_of_a_long_chain(spark, names):
    n = 20_000
    rng = random.Random(2)
    label = [f"c{i:06d}" for i in range(n)] if names == "in order" else [f"{rng.getrandbits(60):015x}" for _ in range(n)]
    df = spark.createDataFrame([(x, y) for x, y in zip(label, label[1:])], "x string, y string")
    sizes = []
    got = components.connected_components(df, F.col("x"), F.col("y"), bound=500, sizes=sizes)
    assert got.count() == n and {r[0] for r in got.select("group").distinct().collect()} == {min(label)}
    assert len(sizes) <= (4 if names == "in order" else 14) and all(y <= 0.85 * x for x, y in zip(sizes, sizes[1:])), sizes


def test_components_of_a_hub(spark):
    """A node with all links is cut into bounded tasks."""
    df = spark.createDataFrame([("hub", f"n{i}") for i in range(3000)], "x string, y string")
    got = components.connected_components(df, F.col("x"), F.col("y"), bound=300)
    assert got.count() == 3001 and got.where("group <> 'hub'").count() == 0


def test_components_empty(spark):
    df = spark.createDataFrame([], "a string, b string")
    assert components.connected_components(df, F.col("a"), F.col("b")).count() == 0


# --- 5: splitting -------------------------------------------------------------------------------------------------------
def is_natural(text, limit=1000):
    """Whether no stretch between two sentence ends (or the ends of the text) is longer than ``limit``."""
    ends = [0, *splitting.sentence_ends(text)]
    return all(b - a <= limit for a, b in zip(ends, ends[1:]))


def test_splitting_invariants(spark):
    rng = random.Random(7)
    texts = []
    for _ in range(60):
        t = ""
        while len(t) < rng.choice([1001, 1500, 4000, 9000]):
            t += "".join(rng.choice("abcdefghij") for _ in range(rng.choice([2, 5, 9]))) + rng.choice([" ", " ", " ", ", ", ". ", "\n", "? ", "… "])
        texts.append(t)
    texts += ["x" * 2500, "word " * 400, "Sentence one is short. " * 80, "a" * 999 + ". " + "b" * 1200 + "."]
    for t in texts:
        pieces = splitting.split_text(t)
        assert pieces[0][0] == 0 and pieces[-1][1] == len(t)
        assert all(a[1] == b[0] for a, b in zip(pieces, pieces[1:]))
        assert all(b - h <= 1000 and 0 <= a - h <= 120 and h <= a < b for a, b, h in pieces)
        if is_natural(t):
            ends = set(splitting.sentence_ends(t))
            assert all(b in ends for _, b, _ in pieces)
    for t in ("Short. " * 300, "x" * 1001, "a b " * 300 + ". " + "Short. " * 200):
        assert splitting.cut_kind(t, splitting.split_text(t)) == ("natural" if is_natural(t) else "forced")
    assert is_natural("Short. " * 300) and not is_natural("x" * 1001)


def test_splitting_table(spark):
    t = "One two three four. " * 100
    rows = [("m1", t, 0.0, 100.0), ("m1", t, 0.0, 100.0), ("m2", t, None, 3.0), ("m3", "short", 0.0, 1.0), ("m4", None, 0.0, 1.0), ("m5", t, float("nan"), 1.0), ("m6", "é" * 1000, 0.0, 1.0)]
    df = spark.createDataFrame([(*r, 9, "k") for r in rows], "moment_id string, transcript string, t_start_s double, t_end_s double, piece int, key string")
    out = splitting.split_oversized(df, "moment_id", "transcript", "t_start_s", "t_end_s").orderBy("moment_id", "piece").collect()
    assert {r.moment_id for r in out} == {"m1", "m2", "m5"} and all(r.cut == "natural" for r in out)
    m1 = [r for r in out if r.moment_id == "m1"]
    assert m1[0].t_start_s == 0 and abs(m1[-1].t_end_s - 100) < 1e-9 and all(abs(a.t_end_s - b.t_start_s) < 1e-9 for a, b in zip(m1, m1[1:]))
    assert all(r.t_start_s is None for r in out if r.moment_id != "m1")
    assert splitting.split_oversized(df.limit(0), "moment_id", "transcript", "t_start_s", "t_end_s").count() == 0


# --- 6: turns -----------------------------------------------------------------------------------------------------------
PEOPLE = [("spk:ada-brimley", "Ada Brimley", "Ada"), ("spk:paul-calder", "Paul Calder", "Paul Calder"), ("spk:eva-calden", "Eva Calden", "Eva")]


def test_labels_and_cleaning():
    p = turns.People(PEOPLE)
    for label, who in (("Ada Brimley", "ada"), (">> ADA", "ada"), ("Brimley, Ada", "ada"), ("A. Brimley", "ada"), ("Dr. Brimley", "ada"), ("AdaBrimley", "ada"), ("ada_brimley", "ada"), ("Ada Brimely", "ada"), ("Paul Calder (host)", "paul"), ("Pual Calder:", "paul"), ("CALDER", "paul")):
        assert [s.split(":")[1].split("-")[0] for s, _ in p.read(label)] == [who], label
    assert p.read("Audience") == [] and p.read(None) == [] and p.read("[music]") == []
    clean = lambda t: turns.clean_cue(t, p)
    assert clean("<v Ada>Hello <00:00:01.000><c>there</c>")[1] == "Hello there" and clean("<v Ada>x")[0][0][0] == "spk:ada-brimley"
    assert clean(">> Paul Calder: [00:01:02] um, the boat (applause) left")[1] == "the boat left"
    for nothing in ("♪ la la ♪", "[music]", "uh, um", "00:00:12", "&#91;wind&#93;", "...", "(laughter)", "Ada: erm", ">>"):
        assert clean(nothing)[1] == "", nothing
    assert clean("yeah")[1] == "yeah" and clean("♪ la la ♪ The boat left.")[1] == "The boat left." and clean("hat den Mast um 5 Prozent gehoben")[1].count("um") == 1


@pytest.mark.parametrize("parts", [1, 4, 33])
def test_turns_against_a_sequential_pass(spark, parts):
    rng = random.Random(parts)
    rows = []
    for i in range(600):
        video = "hot" if rng.random() < 0.4 else rng.choice(["a", "b", None])
        label = rng.choice([None, None, "Ada", "PAUL CALDER", "Eva C.", "Unknown"])
        rows.append((i, video, rng.choice([None, float(rng.randint(0, 90)), float(i)]), i + 1.0, rng.choice(["words here", "um", "[music]", "Paul Calder: yes it is", None]), label, rng.choice(["speech", "event", None]), 3))
    rows += rows[:40]
    known = turns.People(PEOPLE)
    want, state = {}, None
    for seg, video, start, _, text, label, *_ in sorted({r for r in rows if r[1] and r[2] is not None and r[4]}, key=lambda r: (r[1], r[2], r[0])):
        head, speech = turns.clean_cue(text, known)
        if speech:
            got = known.read(label) or head
            who = got[0][0] if got else None
            if state is None or state[0] != video:
                state = (video, who, seg)
            elif who and who != state[1]:
                state = (video, who, seg)
            want[seg] = (state[2], state[1])
    seg = spark.createDataFrame(rows, "seg_id long, video_id string, start_s double, end_s double, text string, speaker string, kind string, pid int")
    people = spark.createDataFrame(PEOPLE, "speaker_id string, resolved_name string, label string")
    out = turns.turn_cases(seg, people, partitions=parts).collect()
    assert {r.seg_id: (r.turn_seg_id, r.speaker_id) for r in out} == want and len(out) == len(want)
    assert turns.turn_cases(seg.limit(0), people).count() == 0


def test_ambiguous_labels_are_settled_by_the_turn():
    r = lambda *xs: [{"s": s, "x": x} for s, x in xs]
    readings = [r(("a", 4.0)), r(("a", 1.0), ("b", 1.0)), r(), r(("b", 4.0)), r(("a", 1.0), ("b", 1.0))]
    assert turns.choose_readings(readings, np.zeros(5), np.zeros(5, bool)) == ["a", "a", None, "b", "b"]


@pytest.mark.parametrize("parts", [1, 3, 16])
def test_ambiguous_labels_are_settled_across_partitions(spark, parts):
    """Two people share a first name; whom a bare first name means is settled by the whole sequence, wherever it is cut."""
    people = [("spk:ada-brimley", "Ada Brimley", "Ada"), ("spk:ada-calder", "Ada Calder", "AC"), ("spk:eva", "Eva Crane", "EC")]
    rng = random.Random(4)
    rows, who = [], None
    for i in range(240):
        who = rng.choice(["Ada Brimley", "Ada Calder", "Eva Crane"]) if who is None or rng.random() < 0.15 else who
        label = who if rng.random() < 0.3 else rng.choice([None, who.split()[0]])
        rows.append((i, "v", float(i), i + 0.9, rng.choice(["and then it went on", "It went on.", "so we left."]), label, "speech"))
    seg = spark.createDataFrame(rows, "seg_id long, video_id string, start_s double, end_s double, text string, speaker string, kind string")
    names = spark.createDataFrame(people, "speaker_id string, resolved_name string, label string")
    known = turns.People(people)
    readings = [[{"s": s, "x": 5.0 if len(known.read(r[5])) == 1 else x} for s, x in known.read(r[5])] for r in rows]
    assert sum(len(r) > 1 for r in readings) > 30
    got = {r.seg_id: r.speaker_id for r in turns.turn_cases(seg, names, partitions=parts).collect()}
    assert all(got[i] in [x["s"] for x in r] for i, r in enumerate(readings) if r)
    if parts > 1:
        whole = {r.seg_id: r.speaker_id for r in turns.turn_cases(seg, names, partitions=1).collect()}
        assert sum(got[i] == whole[i] for i in got) >= 0.99 * len(got)


def test_changes_are_fitted():
    rng = np.random.default_rng(1)
    x = np.column_stack([rng.random(4000) * 2, rng.random(4000) < 0.5, np.log1p(rng.integers(0, 9, 4000))]).astype(float)
    y = (rng.random(4000) < 1 / (1 + np.exp(2 - 1.5 * x[:, 0] - x[:, 1] + 0.3 * x[:, 2]))).astype(float)
    assert np.abs(turns.fit_changes(x, y) - np.array([-2, 1.5, 1, -0.3])).max() < 0.35
    assert np.allclose(turns.fit_changes(np.zeros((0, 3)), np.zeros(0)), turns.PRIOR)


def test_turn_texts(spark):
    seg = spark.createDataFrame([(1, "v", 0.0, 1.0, "Ada: hello", None, "speech"), (2, "v", 1.0, 2.0, "[music]", None, "event"), (3, "v", 2.0, 3.0, "again", None, None), (4, "v", 3.0, 4.0, "bye", "Paul", "speech")], "seg_id long, video_id string, start_s double, end_s double, text string, speaker string, kind string")
    people = spark.createDataFrame(PEOPLE, "speaker_id string, resolved_name string, label string")
    assert [(r.turn_seg_id, r.text, r.n_cases) for r in turns.speaker_turns(seg, people).orderBy("turn_seg_id").collect()] == [(1, "hello again", 2), (4, "bye", 1)]


def test_turns_hold_every_case_once(spark):
    rng = random.Random(8)
    rows = [(i, rng.choice(["v", "w"]), float(rng.randint(0, 300)), None, rng.choice(["so it was", "um", "Ada: yes"]), rng.choice([None, "Paul Calder", None]), "speech") for i in range(400)]
    seg = spark.createDataFrame(rows, "seg_id long, video_id string, start_s double, end_s double, text string, speaker string, kind string")
    people = spark.createDataFrame(PEOPLE, "speaker_id string, resolved_name string, label string")
    cases, turns_ = turns.turn_cases(seg, people, with_text=True).collect(), turns.speaker_turns(seg, people).collect()
    assert sum(t.n_cases for t in turns_) == len(cases) == len({c.seg_id for c in cases})
    by = {}
    for c in sorted(cases, key=lambda c: (c.start_s, c.seg_id)):
        by.setdefault((c.video_id, c.turn_seg_id), []).append(c.speech)
    assert {(t.video_id, t.turn_seg_id): t.text for t in turns_} == {k: " ".join(v) for k, v in by.items()}
    order = {v: [t.speaker_id for t in sorted(turns_, key=lambda t: (t.start_s, t.turn_seg_id)) if t.video_id == v] for v in ("v", "w")}
    assert all(a != b for o in order.values() for a, b in zip(o, o[1:]))  # neighbouring turns have other speakers


# --- 7: near duplicates -------------------------------------------------------------------------------------------------
def test_neardup_against_brute_force(spark):
    rng = random.Random(9)
    vocabulary = [f"word{i}" for i in range(900)]
    texts = {}
    for i in range(300):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([8, 25, 60]))]
        texts[f"r{i:03d}"] = base
        for j in range(rng.choice([0, 0, 1, 2])):
            other = list(base)
            for _ in range(rng.randint(0, 4)):
                other[rng.randrange(len(other))] = rng.choice(vocabulary)
            texts[f"r{i:03d}-{j}"] = other
    rows = [(k, " ".join(v)) for k, v in texts.items()] + [(f"hot{i:02d}", "the same text again and again") for i in range(30)]
    rows += [("null", None), ("empty", ""), ("one", "word"), ("one2", "word"), ("two", "two words"), ("two2", "Two, words!")] + rows[:20]
    df = spark.createDataFrame([(*r, 5) for r in rows], "claim_id string, text string, rid int")
    got = {(r.record_a, r.record_b) for r in neardup.expand_links(*neardup.near_duplicates(df, "claim_id", "text")).collect()}
    want = set()
    unique = sorted(dict(rows).items())
    for i, (a, x) in enumerate(unique):
        for b, y in unique[i + 1 :]:
            both, union = neardup.jaccard(x or "", y or "")
            if union and 2 * both >= union:
                want.add((a, b))
    assert got <= want and len(got) >= 0.98 * len(want) and ("two", "two2") in got and ("hot00", "hot29") in got
    members, links = neardup.near_duplicates(df.limit(0), "claim_id", "text")
    assert members.count() == 0 and links.count() == 0


def test_pairs_within_blocks(spark):
    rows = [(g, f"{g}{i:03d}") for g, n in (("a", 1), ("b", 2), ("c", 23), ("d", 10)) for i in range(n)]
    df = spark.createDataFrame(rows, "g string, item string")
    want = {(p, q) for g, p in rows for h, q in rows if g == h and p < q}
    for block in (5, 10, 100):
        got = [tuple(r) for r in neardup.pairs_within(df, "g", "item", block).collect()]
        assert len(got) == len(want) and set(got) == want


def linked_share(spark, texts, copies):
    """Share of the true links that are found among distinct texts, each with so many rows."""
    rows = [(f"{i:04d}-{j}", t) for i, t in enumerate(texts) for j in range(copies.get(i, 1))]
    members, links = neardup.near_duplicates(spark.createDataFrame(rows, "claim_id string, text string"), "claim_id", "text")
    first = {r.rid: int(r.key[:4]) for r in members.collect()}
    got = {tuple(sorted((first[r.a], first[r.b]))) for r in links.collect()}
    sets = [set(zip(w, w[1:])) for w in map(neardup.words, texts)]
    want = {(i, j) for i, x in enumerate(sets) for j in range(i + 1, len(sets)) if 2 * len(x & sets[j]) >= len(x | sets[j])}
    assert got <= want
    return len(got) / len(want)


def test_neardup_of_a_text_copied_in_a_third_of_all_rows(spark):
    rng = random.Random(4)
    vocabulary = [f"word{i}" for i in range(900)]
    base = [rng.choice(vocabulary) for _ in range(30)]
    edited = [[rng.choice(vocabulary) if k in (5, 14, 23) and rng.random() < 0.9 else w for k, w in enumerate(base)] for _ in range(25)]
    others = [[rng.choice(vocabulary) for _ in range(30)] for _ in range(975)]
    assert linked_share(spark, [" ".join(x) for x in [base, *edited, *others]], {0: 500}) >= 0.98


def test_neardup_links_that_rest_on_frequent_word_pairs(spark):
    rng = random.Random(6)
    opening = [f"opening{i}" for i in range(16)]
    texts = [" ".join([*opening, *(f"own{rng.randrange(10**6)}" for _ in range(4))]) for _ in range(300)]
    assert linked_share(spark, texts, {}) >= 0.98


# --- 8: tokens ----------------------------------------------------------------------------------------------------------
def test_tokens_against_the_public_encoder(spark):
    tiktoken = pytest.importorskip("tiktoken")
    auto, find = tokens.load(), tokens.splitter().findall
    public = tiktoken.Encoding("own", pat_str=tokens.PATTERN, mergeable_ranks=auto.ids, special_tokens={})
    rng = random.Random(1)
    texts = ["".join(rng.choice("aaabbcd e\n\t zé€😀1'.") for _ in range(rng.randint(0, 200))) for _ in range(400)]
    texts += ["<|endoftext|> is text", "a" * 3000, "don't we'll I'd", "日本の窯 كوخ", "\x00\x07�", "  spaces   here  ", "".join(chr(rng.randint(33, 0x2FFF)) for _ in range(2000))]
    for t in texts:
        ids = auto.encode(find(t))
        assert ids == public.encode_ordinary(t) and auto.decode(ids) == t
    df = spark.createDataFrame([(1, "hello world", 0), (2, "", 0), (3, None, 0)], "doc_id long, text string, ids int")
    out = {r.key: list(r.ids) for r in tokens.encode_texts(df, F.col("doc_id"), F.col("text")).collect()}
    assert out == {1: public.encode_ordinary("hello world"), 2: [], 3: []}
    back = tokens.decode_ids(tokens.encode_texts(df, F.col("doc_id"), F.col("text")), F.col("key"), F.col("ids"))
    assert {(r.key, r.text) for r in back.collect()} == {(1, "hello world"), (2, ""), (3, "")}
    assert tokens.encode_texts(df.limit(0), F.col("doc_id"), F.col("text")).count() == 0


# --- 9: packing ---------------------------------------------------------------------------------------------------------
def test_packing(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice([0, 5, 100, 300, 700, 1500, 2048, 5000]), rng.randrange(9) if i % 3 else 0, i) for i in range(3000)]
    rows += [(10_000 + i, 400, 0, -7) for i in range(600)] + [(20_000, None, None, None)]
    df = spark.createDataFrame(rows, "key long, size int, source long, cluster long")
    out = packing.pack_items(df, group=1500).toPandas()
    sums = out.groupby("container_id")["size"].sum()
    assert sums.max() <= 2048 and set(out["key"]) == {r[0] for r in rows}
    assert out.groupby("key")["size"].sum().to_dict() == {r[0]: r[1] or 0 for r in rows}
    assert all(out[out["key"] == r[0]].shape[0] == max(1, -(-(r[1] or 0) // 2048)) for r in rows[:50])
    copies = out[(out["key"] >= 10_000) & (out["key"] < 20_000)]
    assert copies.groupby("container_id").size().max() == 1  # copies of one text never share a container
    assert sums.sum() / (len(sums) * 2048) > 0.9
    assert packing.pack_items(df.limit(0)).count() == 0
    free = [(i, rng.randint(20, 900), i % 7, i) for i in range(2000)]  # sizes that can fill containers
    alone = packing.pack_items(spark.createDataFrame(free, "key long, size int, source long, cluster long")).toPandas()
    assert alone["size"].sum() / (alone["container_id"].nunique() * 2048) > 0.995


# --- 10: quality --------------------------------------------------------------------------------------------------------
def test_quality(spark):
    common = {"the", "a", "we", "in", "and", "of", "it", "was", "der", "die", "le", "la", "el", "for", "that", "to"}
    x = np.array([quality.statistics(t, common) for _, t in CHECKED])
    model = quality.train(x, common)
    right = [quality.KINDS[k] == kind for k, (kind, _) in zip(model.proba(quality._inputs(x)).argmax(1), CHECKED)]
    assert sum(right) >= 0.85 * len(right)
    for t in ("", " ", "\n\n", "\x00", "a" * 100_000, "😀" * 50):
        s = quality.statistics(t, common)
        assert len(s) == len(quality.NAMES) and np.isfinite(s).all()
    docs = [(i, t, "x") for i, (_, t) in enumerate(CHECKED)] + [(900, None, "x"), (901, "  \n", "x"), (902, "", "x")]
    df = spark.createDataFrame(docs, "doc_id long, text string, kind string")
    words = spark.createDataFrame([("en", w) for w in common], "lang string, word string")
    out = {r.doc_id: r.kind for r in quality.classify_documents(df, words).collect()}
    assert set(out) == set(range(len(CHECKED))) and Counter(out.values())["prose"] >= 5
    stats = {r.doc_id: r for r in quality.document_statistics(df, words).collect()}
    assert stats[900].n_words == 0 and stats[0].n_words > 20 and len(stats) == len(docs)
    assert quality.classify_documents(df.limit(0), words).count() == 0


@pytest.mark.skipif(not os.path.exists("/root/testdata/sf0.1/documents.parquet"), reason="needs the test tables")
def test_quality_on_a_hand_checked_holdout(spark):
    """Accuracy and calibration error on 205 documents that a reader judged, disjoint from the training sample."""
    from checked_documents import HOLDOUT

    docs, words = (table(spark, "/root/testdata/sf0.1", n) for n in ("documents", "common_words"))
    truth = {i: kind for kind, ids in HOLDOUT.items() for i in ids}
    n = docs.count()
    taught = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(n // quality.SAMPLE)) == 0).select("doc_id")
    assert len(truth) >= 200 and not {r[0] for r in taught.collect()} & set(truth)
    got = {r.doc_id: (r.kind, r.probability) for r in quality.classify_documents(docs, words).collect() if r.doc_id in truth}
    right = np.array([got[i][0] == truth[i] for i in truth])
    sure = np.array([got[i][1] for i in truth])
    cells = np.minimum((sure * 10).astype(int), 9)
    error = sum(abs(right[cells == c].mean() - sure[cells == c].mean()) * (cells == c).mean() for c in np.unique(cells))
    assert right.mean() >= 0.98 and error <= 0.02, (right.mean(), error)


def test_statistics_as_columns(spark):
    texts = ["We saw it.\nThe end", "", None, "  \n", "a-b c’d 12 ½ é\u00a0x", "1) one\r\n2) two: \n\n- three;", "日本語 テキスト。"]
    words = spark.createDataFrame([("en", "The"), ("en", "it"), ("en", None)], "lang string, word string")
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, w int")
    got = {r.doc_id: r for r in quality.document_statistics(df, words).collect()}
    assert len(got) == len(texts) and all(got[i][1:] == (0, 0.0, 0.0, 0.0, 0.0) for i in (1, 2, 3))
    assert (got[0].n_words, got[0].common_share, got[0].punct_line_share) == (5, 0.4, 0.5) and abs(got[0].mean_word_len - 13 / 5) < 1e-12 and abs(got[0].symbol_ratio - 1 / 14) < 1e-12
    assert got[4].n_words == 5 and got[5].punct_line_share == 2 / 3 and got[5].n_words == 3
