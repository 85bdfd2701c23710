"""Grouping of timed speech segments into moments: gaps and islands, and the ordered fold where a rule needs the group's start.

Rules in order of priority: another speaker than the group's, a gap over 2.5 s, a group of 90 s or more, an audio event in
the gap, and (optionally) a change of subject after at least 8 s. Gaps and events alone cut a video into islands by windows over
chunks of time (see ``ordered``); everything that depends on the group's state is folded inside one island, so that no task has to hold a whole video.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions import text as X
from tidemark.operators.ordered import Ordered
from tidemark.session import materialize

GAP_S, MAX_S, MIN_S, SIMILAR = 2.5, 90.0, 8.0, 0.45


def order(*keys: str) -> Window:
    return Window.partitionBy("video_id").orderBy(*keys)


def speech_segments(segments: DataFrame) -> DataFrame:
    """Speech with text and finite times, one row per seg_id: video_id, seg_id, t0, t1, speaker, text."""
    ok = (F.lower("kind") == "speech") & (F.trim("text") != "") & F.col("video_id").isNotNull()
    for c in ("start_s", "end_s"):
        ok = ok & F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    return segments.where(ok).select("video_id", "seg_id", F.col("start_s").alias("t0"), F.col("end_s").alias("t1"), "speaker", "text").dropDuplicates(["seg_id"])


def audio_events(segments: DataFrame) -> DataFrame:
    """The times of non-speech events: video_id, at."""
    ok = (F.lower("kind") == "event") & F.col("video_id").isNotNull() & F.col("start_s").isNotNull() & ~F.isnan("start_s")
    return segments.where(ok).select("video_id", F.col("start_s").alias("at")).distinct()


def _in_time(speech: DataFrame) -> Ordered:
    return Ordered(speech, "video_id", ["t0", "seg_id"])


def with_gaps(speech: DataFrame) -> DataFrame:
    """The previous segment's end (``before``), in order of t0, seg_id."""
    return _in_time(speech).lag("before", F.col("t1")).rows()


def event_in_gap(speech: DataFrame, events: DataFrame) -> DataFrame:
    """``with_gaps`` plus ``heard``: whether an event lies in the closed gap before the segment (as-of: the last event up to t0).

    Speech and events are one ordered sequence, events first at the same time, so that one pass carries both the last end and the last event.
    """
    talk = speech.withColumn("at", F.lit(None).cast("double"))
    marks = events.where(F.abs("at") < float("inf")).select("video_id", F.col("at").alias("t0"), "at")
    both = Ordered(talk.unionByName(marks, allowMissingColumns=True).withColumn("talks", F.col("at").isNull()), "video_id", ["t0", "talks", "seg_id"])
    inside, among = both._inside(), both._among().rowsBetween(Window.unboundedPreceding, -1)
    end = F.when(F.col("talks"), F.struct(F.col("t1").alias("v")))
    both.with_carried(
        {"_end": F.max_by(end, F.when(F.col("talks"), F.struct("t0", "seg_id"))), "_at": F.max("at")},
        {"_before": F.last("_end", ignorenulls=True).over(among), "_heard": F.max("_at").over(among)},
        {"before": F.coalesce(F.last(end, ignorenulls=True).over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.col("_before"))["v"], "last": F.greatest(F.max("at").over(inside.rowsBetween(Window.unboundedPreceding, 0)), F.col("_heard"))},
    )
    return both.where("talks").rows().select(*speech.columns, "before", F.coalesce(F.col("last") >= F.col("before"), F.lit(False)).alias("heard"))


def _islands(speech: DataFrame, events: DataFrame) -> Ordered:
    """Islands with ``cut``, 1 where one begins, and ``prior``, the island and name of the last named speaker before each row."""
    cut = F.when(F.col("before").isNull() | (F.col("t0") - F.col("before") > GAP_S) | F.col("heard"), 1).otherwise(0)
    rows = _in_time(materialize(event_in_gap(speech, events).withColumn("cut", cut)))
    inside = rows._inside()
    rows.with_column("local", F.sum("cut").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    named = F.when(F.col("speaker").isNotNull(), F.struct("local", "speaker"))
    among = rows._among().rowsBetween(Window.unboundedPreceding, -1)
    far = F.when(F.col("_named").isNotNull(), F.struct((F.col("_named.local") + F.col("_offset")).alias("local"), F.col("_named.speaker").alias("speaker")))
    rows.with_carried(
        {"_cuts": F.sum("cut"), "_named": F.max_by(named, F.when(F.col("speaker").isNotNull(), F.struct("t0", "seg_id")))},
        {"_offset": F.coalesce(F.sum("_cuts").over(among), F.lit(0)), "_far": F.last(far, ignorenulls=True).over(among)},
        {"near": F.last(named, ignorenulls=True).over(inside.rowsBetween(Window.unboundedPreceding, -1)), "island": F.col("local") + F.col("_offset"), "prior": F.coalesce(F.when(F.col("near").isNotNull(), F.struct((F.col("near.local") + F.col("_offset")).alias("local"), F.col("near.speaker").alias("speaker"))), F.col("_far"))},
    )
    return rows


def islands(speech: DataFrame, events: DataFrame) -> DataFrame:
    """Islands between gaps over 2.5 s and events: adds ``island`` (per video from 0)."""
    return _islands(speech, events).with_column("island", F.col("island") - 1).rows("cut", "local", "near", "prior")


def speaker_islands(speech: DataFrame, events: DataFrame) -> DataFrame:
    """Islands cut further where a named speaker follows another: adds ``part`` (per video from 0)."""
    rows = _islands(speech, events)
    other = F.coalesce((F.col("prior.local") == F.col("island")) & (F.col("speaker") != F.col("prior.speaker")), F.lit(False))
    rows.with_column("cut", F.when((F.col("cut") == 1) | other, 1).otherwise(0)).running_sum("part", F.col("cut"))
    return rows.with_column("part", F.col("part") - 1).with_column("island", F.col("island") - 1).rows("cut", "local", "near", "prior")


def clean_segments(cues: DataFrame) -> DataFrame:
    """Raw cues (video_id, pos, t0, t1, speaker, text) as speech and events with the speakers that persist: video_id, pos, t0, t1, kind, speaker, text.

    A line with a music sign is an event. A named speaker (first spelling of a video) stays until the next; ``>>`` without a name opens an
    anonymous turn spk_1, spk_2 and so on, or spk_0 where nobody has spoken before. Without any name or mark the speaker is null.
    """
    w = Window.partitionBy("video_id").orderBy("t0", "pos")
    named = F.coalesce(F.nullif(X.strip(F.coalesce("speaker", F.lit(""))), F.lit("")), F.nullif(X.name_prefix(F.coalesce("text", F.lit(""))), F.lit("")))
    rows = cues.withColumn("music", X.unescape(F.coalesce("text", F.lit(""))).rlike("[♪♫♬🎵🎶]")).withColumn("named", F.when(~F.col("music"), named))
    spelling = F.first("named", ignorenulls=True).over(Window.partitionBy("video_id", F.lower("named")).orderBy("t0", "pos"))
    rows = rows.withColumn("named", F.when(F.col("named").isNotNull(), spelling))
    rows = rows.withColumn("anonymous", ~F.col("music") & F.col("named").isNull() & F.coalesce("text", F.lit("")).rlike(r"^\s*(?:>|&gt;){2,}"))
    marker = F.when(F.col("named").isNotNull(), "named").when(F.col("anonymous"), "anonymous")
    first = F.first(marker, ignorenulls=True).over(Window.partitionBy("video_id").orderBy("t0", "pos").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    number = F.sum(F.col("anonymous").cast("int")).over(w) - F.when(first == "anonymous", 1).otherwise(0)
    who = F.coalesce("named", F.when(F.col("anonymous"), F.concat(F.lit("spk_"), number.cast("string"))))
    rows = rows.withColumn("who", F.last(who, ignorenulls=True).over(w))
    known = F.collect_set(F.lower("named")).over(Window.partitionBy("video_id"))
    rows = rows.withColumn("known", known)
    speech = rows.where("not music").select("video_id", "pos", "t0", F.greatest("t0", "t1").alias("t1"), F.lit("speech").alias("kind"), F.col("who").alias("speaker"), X.clean_caption(F.col("text"), F.col("known")).alias("text")).where("text <> ''")
    heard = F.when(F.col("music"), F.array(F.lit("music"))).otherwise(X.events_in(F.col("text")))
    events = rows.select("video_id", "pos", "t0", F.col("t0").alias("t1"), F.lit("event").alias("kind"), F.lit(None).cast("string").alias("speaker"), F.explode(heard).alias("e"))
    return speech.unionByName(events.withColumn("text", F.format_string("[%s]", "e")).drop("e"))


def hashed_cosine(a: str, b: str) -> float:
    """Cosine of the hashed vectors of two texts; 0 where one has none."""
    from tidemark.operators.retrieval import TOKEN, _Grams

    x, y = (_Grams().vector(TOKEN.findall(t.lower())).astype(float) for t in (a, b))
    n = float((x @ x) * (y @ y)) ** 0.5
    return float(x @ y) / n if n else 0.0


def fold(rows: DataFrame, similarity: Callable[[str, str], float] | None = None, max_s: float = MAX_S) -> DataFrame:
    """All rules inside the islands: adds ``grp`` (per island from 0). ``similarity`` of two texts turns the subject rule on."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["t0", "seg_id"])
        out, n, start, speaker, end, recent = [], 0, None, None, None, []
        for t0, t1, who, text in zip(pdf["t0"], pdf["t1"], pdf["speaker"], pdf["text"]):
            if start is not None:
                other = who and speaker and who != speaker
                if other or end - start >= max_s or (similarity and end - start >= MIN_S and similarity(" ".join(recent[-3:]), text) < SIMILAR):
                    n, start, speaker, recent = n + 1, None, None, []
            start = t0 if start is None else start
            speaker, end = speaker or who, t1
            recent.append(text)
            out.append(n)
        return pdf.assign(grp=out)[["video_id", "island", "grp", "seg_id", "t0", "t1", "speaker", "text"]]

    schema = "video_id string, island bigint, grp int, seg_id bigint, t0 double, t1 double, speaker string, text string"
    return rows.groupBy("video_id", "island").applyInPandas(run, schema)


def group_rows(parts: DataFrame, keys: list[str]) -> DataFrame:
    """One row per group: start of the first, greatest end, transcript in order, dominant speaker (most cues, then first seen)."""
    item = F.struct("t0", "seg_id", "t1", "text", "speaker")
    g = parts.groupBy(*keys).agg(F.array_sort(F.collect_list(item)).alias("cues"), F.max("t1").alias("t_end"))
    return g.select(*keys, F.col("cues")[0]["t0"].alias("t_start"), "t_end", F.array_join(F.transform("cues", lambda c: F.trim(c["text"])), " ").alias("transcript"), F.size("cues").alias("n_cues"), F.element_at("cues", -1)["t1"].alias("last_end"))


def dominant(parts: DataFrame, keys: list[str]) -> DataFrame:
    """The most frequent speaker of every group, first seen among equals; groups without a speaker are left out."""
    counts = parts.where("speaker is not null").groupBy(*keys, "speaker").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("t0", "seg_id")).alias("first"))
    return counts.groupBy(*keys).agg(F.min_by("speaker", F.struct(-F.col("n"), "first")).alias("speaker_id"))


def merge_small(groups: DataFrame, min_s: float = MIN_S) -> DataFrame:
    """Groups (video_id, no, t_start, last_end, speaker_id) shorter than ``min_s`` join the output group before them of the same speaker: adds ``merged``."""
    short = F.col("last_end") - F.col("t_start") < min_s
    same = F.col("speaker_id").eqNullSafe(F.lag("speaker_id").over(order("no"))) & F.lag("no").over(order("no")).isNotNull()
    return groups.withColumn("new", F.when(short & same, 0).otherwise(1)).withColumn("merged", F.sum("new").over(order("no")) - 1).drop("new")


def overlap_join(left: DataFrame, right: DataFrame, bucket_s: float, strict: bool = False) -> DataFrame:
    """Interval join of (video_id, a0, a1, ...) with (video_id, b0, b1, ...): an equi-join on video, level and time bucket, each pair once.

    A span lies on the lowest level, whose buckets grow by 16 from one to the next, on which it touches two buckets at most, so that a long
    span is two rows and not thousands. Each side is also placed on the higher levels that spans of the other side are on (a count of
    levels, six numbers at most, tells which: usually none). ``strict``: touching intervals don't overlap.
    """
    top_level = 5
    width = lambda k: bucket_s * 16.0**k
    own = lambda a, b: F.coalesce(*[F.when(F.floor(F.col(b) / width(k)) - F.floor(F.col(a) / width(k)) <= 1, k) for k in range(top_level)], F.lit(top_level))
    x, y = left.withColumn("_la", own("a0", "a1")), right.withColumn("_lb", own("b0", "b1"))
    on_x, on_y = ([r[0] for r in df.select(c).distinct().collect()] for df, c in ((x, "_la"), (y, "_lb")))

    def placed(df: DataFrame, a: str, b: str, level: str, others: list[int]) -> DataFrame:
        def cells(k: int) -> Column:
            here = F.transform(F.sequence(F.floor(F.col(a) / width(k)), F.floor(F.col(b) / width(k))), lambda c: F.struct(F.lit(k).alias("k"), c.alias("c")))
            wanted = (F.col(level) == k) | ((F.col(level) < k) & F.lit(k in others))
            return F.when(wanted, here).otherwise(F.array().cast("array<struct<k:int,c:bigint>>"))

        return df.withColumn("cell", F.explode(F.concat(*[cells(k) for k in sorted({*on_x, *on_y}) or [0]])))

    meet = (F.col("a0") < F.col("b1")) & (F.col("a1") > F.col("b0")) if strict else (F.col("a0") <= F.col("b1")) & (F.col("a1") >= F.col("b0"))
    top = F.greatest("_la", "_lb")
    later = F.coalesce(*[F.when(top == k, F.floor(F.greatest("a0", "b0") / width(k))) for k in range(top_level + 1)])
    pairs = placed(x, "a0", "a1", "_la", on_y).join(placed(y, "b0", "b1", "_lb", on_x), ["video_id", "cell"])
    return pairs.where(meet & (F.col("cell.k") == top) & (F.col("cell.c") == later)).drop("cell", "_la", "_lb")


def finite_span(df: DataFrame, start: str, end: str) -> Column:
    ok = F.lit(True)
    for c in (start, end):
        ok = ok & F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < 1e7)
    return ok & (F.col(start) >= 0) & (F.col(end) >= F.col(start))
