import json

import pytest

from pyspark.sql import functions as F

from tidemark.sources import captions, store
from tidemark.streaming import windows as W

VTT = "WEBVTT\n\n1\n00:00:01.000 --> 00:00:02.500\n<v Ada>Hello there\nfriend\n\n00:00:03,000 --> 00:00:04,000\nplain line\n\nNOTE nothing\n\nbad --> worse\nskipped\n"
ROLLING = "WEBVTT\n\n00:00:01.000 --> 00:00:02.000\nold line\nnew<00:00:01.500><c> words</c>\n\n00:00:02.000 --> 00:00:03.000\nnew words\nmore<00:00:02.500><c> text</c>\n"


def files(spark, rows):
    return spark.createDataFrame(rows, "path string, content string")


def test_captions(spark):
    j = json.dumps({"segments": [{"start": 1, "end": 2, "text": "hi", "speaker": "B"}, {"t_start": 5, "t_end": 1e9, "text": "yo"}, {"start": 3, "text": " "}]})
    df = files(spark, [("a.vtt", VTT), ("r.vtt", ROLLING), ("b.json", j), ("c.txt", "One thing. Two things."), ("d.txt", ""), ("e.txt", None)])
    got = {}
    for r in captions.load_transcripts(df).orderBy("path", "pos").collect():
        got.setdefault(r.path, []).append((r.t0, r.t1, r.speaker, r.text))
    assert got["a.vtt"] == [(1.0, 2.5, "Ada", "Hello there friend"), (3.0, 4.0, None, "plain line")]
    assert [x[3] for x in got["r.vtt"]] == ["new words", "more text"]
    assert got["b.json"] == [(1.0, 2.0, "B", "hi"), (5.0, 0.0, None, "yo")]
    assert got["c.txt"] == [(0.0, 3.0, None, "One thing."), (3.0, 6.0, None, "Two things.")] and set(got) == {"a.vtt", "r.vtt", "b.json", "c.txt"}


def test_read_files(spark, tmp_path):
    (tmp_path / "x.srt").write_bytes(b"1\n00:00:01,000 --> 00:00:02,000\nhey \xff\n")
    rows = captions.load_transcripts(captions.read_files(spark, str(tmp_path))).collect()
    assert len(rows) == 1 and rows[0].text.startswith("hey")


def test_store_versions(spark, tmp_path):
    s = store.Store(spark, str(tmp_path / "s"))
    assert s.read("t") is None
    s.upsert("t", spark.createDataFrame([(1, "a", 1), (2, "b", 1), (None, "z", 9)], "k int, v string, seq int"), ["k"], "seq")
    before = s.read("t")
    s.upsert("t", spark.createDataFrame([(2, "c", 2), (1, "old", 0), (3, "d", None)], "k int, v string, seq int"), ["k"], "seq")
    assert {(r.k, r.v) for r in s.read("t").where("k is not null").collect()} == {(1, "a"), (2, "c"), (3, "d")}
    assert before.count() == 2  # the old version can still be read; a row without a key is never stored
    again = store.Store(spark, str(tmp_path / "s"))
    m = again.manifest("t")
    s.remove("t", spark.createDataFrame([(3,)], "k int"), "k")
    assert {r.k for r in s.read("t").collect()} == {1, 2} and len(s.manifest("t")["parts"]) < len(m["parts"])
    with pytest.raises(store.Conflict):  # a writer that started from the older version
        again._commit("t", m, s.read("t"), "k", None)
    assert s.vacuum("t") >= 1 and {r.k for r in s.read("t").collect()} == {1, 2}
    s.write("e", spark.createDataFrame([], "k int, v string"))
    assert s.read("e").count() == 0 and s.read("e").columns == ["k", "v"]


def test_entities_and_orphans(spark):
    shape = "entity_id string, canonical_name string, type string, qid string, aliases array<string>"
    old = spark.createDataFrame([("e", "Ada", None, "Q1", ["Ada", "A."]), ("f", "Bo", "x", None, ["Bo"])], shape)
    new = spark.createDataFrame([("e", "ADA", "person", None, ["ADA", "Ada"]), ("g", "Cy", None, None, ["Cy"])], shape)
    assert {tuple(map(str, r)) for r in store.merge_entities(old, new).collect()} == {("e", "Ada", "person", "Q1", "['Ada', 'A.', 'ADA']"), ("f", "Bo", "x", "None", "['Bo']"), ("g", "Cy", "None", "None", "['Cy']")}
    edges = spark.createDataFrame([("c", "e"), (None, "x")], "src string, dst string")
    assert {r.entity_id for r in store.orphans(old, "entity_id", edges).collect()} == {"f"}


def test_words_plain_durations_and_lists(spark, tmp_path):
    j = json.dumps([{"start": 0, "end": 2, "text": "so it is", "words": [{"word": "so", "start": 0, "end": 0.5}, {"word": "it", "start": None, "end": 1}]}])
    rows = captions.load_transcripts(files(spark, [("w.json", j)]), words=True).collect()
    assert [(w.t0, w.t1, w.word) for w in rows[0].words] == [(0.0, 0.5, "so")]
    plain = spark.createDataFrame([("c.txt", "One thing. Two things.", 10.0), ("d.txt", "One thing.", None)], "path string, content string, duration_s double")
    assert sorted((r.path, r.t0, r.t1) for r in captions.load_transcripts(plain).collect()) == [("c.txt", 0.0, 5.0), ("c.txt", 5.0, 10.0), ("d.txt", 0.0, 3.0)]
    spaced = "WEBVTT\n\n00:00:01.000 --> 00:00:02.000\nold\n \nnew<00:00:01.500><c> words</c>\n\n00:00:02.000 --> 00:00:03.000\nmore<00:00:02.500><c> text</c>\n"
    assert [r.text for r in captions.load_transcripts(files(spark, [("r.vtt", spaced)])).orderBy("pos").collect()] == ["new words", "more text"]
    (tmp_path / "subs.json").write_text('["https://a.example/x", {"url": "https://b.example"}, {"name": "none"}, " ", "https://a.example/x"]')
    assert {r.url for r in captions.subscriptions(spark, str(tmp_path / "subs.json")).collect()} == {"https://a.example/x", "https://b.example"}
    (tmp_path / "list.json").write_text('{"entries": [{"id": "1", "url": "u1", "title": "t"}, {"id": "2", "webpage_url": "u2"}, {"id": "3"}]}')
    (tmp_path / "lines.json").write_text('{"id": "1", "url": "u1"}\n{"id": "2", "url": "u3"}\n')
    assert {r.url for r in captions.enumerated(spark, str(tmp_path / "list.json")).collect()} == {"u1", "u2"}
    assert {r.url for r in captions.enumerated(spark, str(tmp_path / "lines.json")).collect()} == {"u1", "u3"}


def test_turn_speakers(spark):
    from tidemark.operators import segmentation as S

    cues = [("v", 0, 0.0, 1.0, None, ">> hello there"), ("v", 1, 1.0, 2.0, None, "and more"), ("v", 2, 2.0, 3.0, None, ">> a new voice"), ("v", 3, 3.0, 4.0, "YANA", "it is me"), ("v", 4, 4.0, 5.0, None, "Yana: again"), ("v", 5, 5.0, 6.0, None, "♪ la ♪"), ("v", 6, 6.0, 7.0, None, "&gt;&gt; third [applause]"), ("w", 0, 0.0, 1.0, None, "plain")]
    rows = S.clean_segments(spark.createDataFrame(cues, "video_id string, pos int, t0 double, t1 double, speaker string, text string")).collect()
    assert {(r.video_id, r.pos): (r.speaker, r.text) for r in rows if r.kind == "speech"} == {("v", 0): ("spk_0", "hello there"), ("v", 1): ("spk_0", "and more"), ("v", 2): ("spk_1", "a new voice"), ("v", 3): ("YANA", "it is me"), ("v", 4): ("YANA", "again"), ("v", 6): ("spk_2", "third"), ("w", 0): (None, "plain")}
    assert {(r.pos, r.text) for r in rows if r.kind == "event"} == {(5, "[music]"), (6, "[applause]")}


def test_store_plans(spark):
    t = {"moments": spark.createDataFrame([("v1", 1), ("v2", 2)], "video_id string, x int"), "pairs": spark.createDataFrame([("v1#m.c", "v2#m.c"), ("v2#a", "v2#b"), (None, "v2#b")], "claim_a string, claim_b string")}
    left = store.forget(t, spark.createDataFrame([("v1",)], "video_id string"))
    assert left["moments"].count() == 1 and left["pairs"].count() == 2
    led = store.merge_ledger(spark.createDataFrame([("a", 2.0)], "metric string, value double"), spark.createDataFrame([("a", -5.0), ("b", 1.0)], "metric string, value double"))
    assert {(r.metric, r.value) for r in led.collect()} == {("a", 0.0), ("b", 1.0)}
    old = spark.createDataFrame([("a", "R", "b", "v")], "src string, rel string, dst string, video_id string")
    assert store.insert_ignore(old, old.unionByName(old), ["src", "rel", "dst", "video_id"]).count() == 1


def test_streams(spark, tmp_path):
    rows = [(i, f"2024-01-01 {h:02d}:10:00", "k" if i % 2 else "l", float(i)) for i, h in enumerate([0, 0, 1, 5, 9, 9])]
    df = spark.createDataFrame(rows, "event_id long, ts string, kind string, value double").withColumn("ts", F.to_timestamp("ts"))
    df.unionByName(df).coalesce(1).write.parquet(str(tmp_path / "e"))
    stream = W.read_stream(spark, str(tmp_path / "e"))
    assert W.run_to_table(W.distinct_within(stream, ["event_id"])).count() == 6
    closed = W.run_to_table(W.complete_counts(W.read_stream(spark, str(tmp_path / "e")), [F.col("kind")], late="1 hour"))
    assert closed.where("n > 0").count() >= 2
    seen = []
    W.run_batches(W.read_stream(spark, str(tmp_path / "e")), lambda b, i: seen.append(b.count()))
    assert sum(seen) == 12
    assert W.run_to_table(W.sessions(W.read_stream(spark, str(tmp_path / "e")), "kind", "30 minutes", "1 hour")).count() >= 1
