import json
import shutil

import pytest
from pyspark.sql import functions as F

from tidemark.api import Engine
from tidemark.config import Settings
from tidemark.jobs import Jobs
from tidemark.sources.store import Store


def vtt(*cues):
    stamp = lambda s: f"{int(s // 3600):02d}:{int(s // 60 % 60):02d}:{s % 60:06.3f}"
    return "WEBVTT\n\n" + "\n\n".join(f"{stamp(a)} --> {stamp(b)}\n{text}" for a, b, text in cues) + "\n"


HARBOUR = vtt((0, 6, "<v Ines>The granite harbour wall will survive the winter floods."), (6.5, 14, "<v Ines>The Meridian survey measured every lock gate by hand."), (20, 30, "<v Otto>The old ferry engine was rebuilt by three apprentices."))
RIVER = vtt((0, 6, "<v Otto>The granite harbour wall will not survive the winter floods."), (6.5, 14, ">> The old ferry engine was rebuilt by three apprentices."), (14.5, 20, "Actually the Meridian survey missed one lock gate."))


@pytest.fixture(scope="module")
def base(spark, tmp_path_factory):
    """Two videos, ingested and consolidated once; tests that change something work on a copy of the store."""
    root = tmp_path_factory.mktemp("engine")
    src = root / "src"
    src.mkdir()
    (src / "harbour.vtt").write_text(HARBOUR)
    (src / "harbour.txt").write_text("A sibling in a format of less preference. It is passed over.")
    (src / "river.en.vtt").write_text(RIVER)
    (src / "harbour.meta.json").write_text('{"upload_date": "20230512", "title": "Harbour day"}')
    (src / "notes.pdf").write_text("no captions")
    e = Engine(spark, str(root / "store"))
    return e, src, e.ingest(str(src)), e.consolidate()


def copied(spark, base, tmp_path):
    shutil.copytree(base[0].store.root, tmp_path / "store")
    return Engine(spark, str(tmp_path / "store"))


def test_engine_end_to_end(spark, base):
    e, src, first, report = base
    assert first["videos"] == 2 and first["claims"] == 6
    assert e.ingest(str(src)) == {"videos": 0, "segments": 0, "moments": 0, "claims": 0}
    rels = {r.rel for r in e.table("edges").select("rel").distinct().collect()}
    assert {"STATES", "ATTRIBUTED_TO", "MENTIONS", "SAME_AS", "PRECEDES"} <= rels
    assert {r.relation for r in e.contradictions().collect()} == {"CONTRADICTS", "SUPPORTS"}
    assert report["contradictions"] == 1 and report["supports"] >= 1 and report["claims_scanned"] == 6
    again = e.consolidate()
    assert again["claims_scanned"] == 0 and again["relations"] == report["relations"]  # nothing past the mark
    q = spark.createDataFrame([(1, "Who rebuilt the ferry engine?"), (2, "Which sources contradict each other about the harbour wall?")], "qid long, question string")
    got = {r.qid: r for r in e.ask(q).collect()}
    assert "ferry engine" in got[1].answer and not got[1].low_evidence and got[1].n_citations >= 1 and got[2].strategy == "contradiction"
    assert e.clips(q).count() >= 1
    out = e.synthesize("old ferry engine")
    assert not out["low_evidence"] and out["text"].startswith("The old ferry engine was rebuilt by three apprentices. [") and out["consensus"].first().support == 2
    wall = e.synthesize("granite harbour wall")
    assert wall["contradictions"].count() == 1 and wall["consensus"].count() == 0
    assert e.synthesize("volcano insurance")["low_evidence"]
    assert e.list_videos().where("published_at = '20230512' and title = 'Harbour day'").count() == 1
    assert e.provenance().where("trusted").count() >= 5 and e.claim_history().count() == 0
    doc = json.loads(e.export().first().document)
    assert {"claim_id", "status", "obj"} <= set(doc)
    assert e.evolution("ent:meridian").count() == 2 and e.table("entities").where("entity_id = 'ent:meridian'").first().canonical_name == "Meridian"
    speakers = {r.speaker_id.split(":")[-1]: r.canonical_id for r in e.table("speakers").collect()}
    assert speakers["Otto"] == "spk:otto" and e.table("speakers").where("canonical_id = 'spk:otto'").count() == 2
    ids = [r.moment_id for r in e.table("moments").select("moment_id").collect()][::-1]
    assert [r.moment_id for r in e.lookup("moments", "moment_id", ids).collect()] == ids
    video = e.list_videos().where("title = 'Harbour day'").first().video_id
    assert e.clip(video, 21, 22).count() == 1 and e.moments(video).count() == e.table("moments").where(F.col("video_id") == video).count()


def test_deletion_and_sync(spark, base, tmp_path):
    e, src = copied(spark, base, tmp_path), base[1]
    before = {r.metric: r.value for r in e.metrics().collect()}
    gone = e.list_videos().where("title = 'Harbour day'").first().video_id
    e.delete_video(gone)
    assert e.list_videos().count() == 1 and e.table("claims").where(F.col("video_id") == gone).count() == 0
    assert e.table("edges").where(F.col("src").startswith(gone) | F.col("dst").startswith(gone)).count() == 0
    assert e.table("edges").where("rel in ('CONTRADICTS', 'SUPPORTS')").count() == 0 and e.meta("consolidated") == "0"
    after = {r.metric: r.value for r in e.metrics().collect()}
    assert after["videos"] == before["videos"] - 1 and after["claims"] == before["claims"] - 3
    out = e.sync(spark.createDataFrame([(str(src),), ("/no/such/folder",)], "url string"))
    assert out["/no/such/folder"].startswith("failed") and out[str(src)]["videos"] == 1
    assert e.list_videos().count() == 2 and e.table("edges").where("rel = 'CONTRADICTS'").count() == 1
    assert {r.name: r.n for r in e.stats().collect()}["videos"] == 2
    with pytest.raises(FileNotFoundError):
        e.ingest("/no/such/folder")


def test_incremental_equals_a_full_pass(spark, base, tmp_path):
    e = copied(spark, base, tmp_path)
    (tmp_path / "canal.vtt").write_text(vtt((0, 6, "The granite harbour wall will never survive the winter floods."), (7, 13, "Nobody counts the herons.")))
    e.ingest(str(tmp_path / "canal.vtt"))
    assert e.consolidate()["claims_scanned"] <= 2
    found = {(r.src, r.rel, r.dst) for r in e.table("edges").where("rel in ('CONTRADICTS', 'SUPPORTS')").collect()}
    assert found == {(r.a, r.relation, r.b) for r in e.contradictions().collect()} and len(found) >= base[3]["relations"] + 2


def test_slots_and_settings(spark, base, tmp_path):
    e = base[0]
    with pytest.raises(ValueError):
        Engine(spark, str(tmp_path / "x"), slots={"telepathy": lambda df: df})
    q = spark.createDataFrame([(1, "Who rebuilt the ferry engine?")], "qid long, question string")
    say = lambda text: lambda cited: cited.select("qid").distinct().withColumn("answer", F.lit(text))
    good = Engine(spark, e.store.root, slots={"generator": [(lambda: False, None), (lambda: True, say("Three apprentices did [1]."))]})
    assert good.ask(q).first().answer == "Three apprentices did [1]."
    bad = Engine(spark, e.store.root, slots={"generator": say("Nobody knows who did it.")})
    assert "Nobody" not in bad.ask(q).first().answer
    s = Settings.of({"top_k": "5", "decay": "yes", "halflife_days": "nan?"}, environment={"TIDEMARK_MAX_CLAIMS": "77"})
    assert (s.top_k, s.decay, s.halflife_days, s.max_claims) == (5, True, 365.0, 77)
    with pytest.raises(ValueError):
        Settings.of({"no_such": 1})


def test_visual_events(spark, base, tmp_path):
    e = copied(spark, base, tmp_path)
    m = e.table("moments").orderBy("moment_id").first()
    events = spark.createDataFrame([(1, m.video_id, m.t_start_s, m.t_end_s, "a chart", "TIDE TABLE", [0.0, 1.0]), (2, m.video_id, m.t_start_s, m.t_end_s, None, "TIDE TABLE", [1.0, 1.0])], "event_id long, video_id string, t_start_s double, t_end_s double, caption string, ocr_text string, embedding array<double>")
    e.add_visual_events(events)
    assert e.lookup("moments", "moment_id", [m.moment_id]).first().ocr_text == "TIDE TABLE"
    assert e.visual_search(spark.createDataFrame([(1, [0.5, 1.0])], "qid int, vec array<double>")).first().key == m.moment_id


def test_jobs(spark, tmp_path):
    now = [100.0]
    q = Jobs(Store(spark, str(tmp_path / "q")), lambda: now[0])
    a = q.enqueue("x", {"n": 1})
    assert q.enqueue("x", {"n": 1}) == a and q.enqueue("x", {"n": 2}) != a
    calls = []

    def x(n):
        calls.append(n)
        if n == 1:
            raise RuntimeError("no")
        return n

    assert q.work({"x": x}) == 2 and q.status(a)["state"] == "queued" and q.status(a)["next_run_at"] == 102.0
    now[0] = 102.0
    q.work({"x": x})
    assert q.status(a)["next_run_at"] == 106.0
    now[0] = 106.0
    q.work({"x": x})
    assert q.status(a)["state"] == "failed" and "no" in q.status(a)["error"] and calls.count(1) == 3
    b = q.enqueue("x", {"n": 3})
    assert q.claim()["job_id"] == b and q.claim() is None and q.recover() == 1 and q.status(b)["state"] == "queued"
