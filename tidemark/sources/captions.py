"""Transcript sources: WebVTT, SubRip, JSON and plain text as rows of cues. Expressions only; one input row per file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TIME = r"(?:(\d{1,3}):)?(\d{1,2}):(\d{1,2})[.,](\d{1,3})"
TIMING = rf"^\s*((?:\d{{1,3}}:)?\d{{1,2}}:\d{{1,2}}[.,]\d{{1,3}})\s*-->\s*((?:\d{{1,3}}:)?\d{{1,2}}:\d{{1,2}}[.,]\d{{1,3}})"
INLINE = r"<\d{1,2}:\d{2}:\d{2}[.,]\d{3}>"
CUES = "path, pos, t0, t1, speaker, text"
WORDS = "array<struct<t0:double,t1:double,word:string>>"
JSON_CUE = "struct<start:double,t_start:double,end:double,t_end:double,speaker:string,text:string,words:array<struct<word:string,start:double,end:double>>>"
#: Latest time that counts, in seconds.
MOST = 1e7


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """Every file under ``path`` as one row: path, content (UTF-8, malformed bytes replaced)."""
    return spark.read.format("binaryFile").load(path).select("path", F.make_valid_utf8(F.col("content").cast("string")).alias("content"), F.sha1("content").alias("content_hash"))


def seconds(c: Column) -> Column:
    """Seconds of [h:]m:s.ms; malformed, not finite or later than MOST gives 0."""
    part = lambda i: F.expr("0.0") + F.coalesce(F.try_to_number(F.nullif(F.regexp_extract(c, TIME, i), F.lit("")), F.lit("999")).cast("double"), F.lit(0.0))
    ms = F.rpad(F.regexp_extract(c, TIME, 4), 3, "0")
    s = part(1) * 3600 + part(2) * 60 + part(3) + F.coalesce(F.try_to_number(F.nullif(ms, F.lit("")), F.lit("999")).cast("double"), F.lit(0.0)) / 1000
    return F.when(c.rlike(TIME) & (s <= MOST), s).otherwise(0.0)


def kind(path: Column, content: Column) -> Column:
    """vtt, srt, json, or plain, by extension and else by content."""
    p = F.lower(path)
    return F.when(p.endswith(".json"), "json").when(p.endswith(".vtt") | content.rlike(r"^﻿?\s*WEBVTT"), "vtt").when(p.endswith(".srt") | F.contains(content, F.lit("-->")), "srt").otherwise("plain")


def cues(files: DataFrame) -> DataFrame:
    """Cues of VTT and SRT files: blocks between blank lines, the first valid timing line, the lines after it joined.

    In a file with at least two cues of inline word times (rolling captions) only lines with such times are kept, so that
    carried-over lines don't repeat, and only truly blank lines part cues. A ``<v Name>`` names the speaker.
    """
    texts = files.where(kind(F.col("path"), F.col("content")).isin("vtt", "srt")).select("path", F.regexp_replace("content", r"\r\n?", "\n").alias("c"))
    loose, strict = F.split("c", r"\n[ \t]*\n"), F.split("c", r"\n\n+")
    tagged = F.size(F.filter(loose, lambda b: b.rlike(INLINE))) >= 2
    blocks = texts.select("path", tagged.alias("rolling"), F.posexplode(F.when(tagged, strict).otherwise(loose)).alias("pos", "block"))
    lines = F.split("block", "\n")
    at = F.array_position(F.transform(lines, lambda x: x.rlike(TIMING)), True)
    rows = blocks.withColumn("lines", lines).withColumn("at", at).where("at > 0").withColumn("timing", F.expr("lines[int(at) - 1]")).withColumn("body", F.expr("slice(lines, int(at) + 1, size(lines))"))
    body = F.when(F.col("rolling"), F.filter("body", lambda x: x.rlike(INLINE))).otherwise(F.col("body"))
    text = F.trim(F.array_join(F.filter(F.transform(body, lambda x: F.trim(x)), lambda x: x != ""), " "))
    out = rows.select("path", "pos", seconds(F.regexp_extract("timing", TIMING, 1)).alias("t0"), seconds(F.regexp_extract("timing", TIMING, 2)).alias("t1"), text.alias("raw"))
    return out.select("path", "pos", "t0", "t1", F.nullif(F.trim(F.regexp_extract("raw", r"<v(?:\.[\w.]+)?\s+([^>]+)>", 1)), F.lit("")).alias("speaker"), F.trim(F.regexp_replace("raw", r"<[^<>]*>", "")).alias("text")).where("text <> ''")


def _words(c: Column) -> Column:
    """Word times, without words that lack one."""
    sound = F.filter(c, lambda w: w["word"].isNotNull() & w["start"].between(0, MOST) & w["end"].between(0, MOST))
    return F.transform(sound, lambda w: F.struct(w["start"].alias("t0"), w["end"].alias("t1"), w["word"].alias("word"))).cast(WORDS)


def json_cues(files: DataFrame) -> DataFrame:
    """Cues of JSON transcripts: a list, or an object with ``segments``; start/t_start, end/t_end; rows without text are skipped."""
    rows = files.where(kind(F.col("path"), F.col("content")) == "json")
    body = F.coalesce(F.from_json("content", f"struct<segments:array<{JSON_CUE}>>")["segments"], F.from_json("content", f"array<{JSON_CUE}>"))
    sane = lambda a, b: F.when(F.coalesce(a, b).between(0, MOST), F.coalesce(a, b)).otherwise(0.0)
    x = rows.select("path", F.posexplode(body).alias("pos", "c")).where("trim(c.text) <> ''")
    return x.select("path", "pos", sane(F.col("c.start"), F.col("c.t_start")).alias("t0"), sane(F.col("c.end"), F.col("c.t_end")).alias("t1"), "c.speaker", F.trim("c.text").alias("text"), _words(F.col("c.words")).alias("words"))


def plain_cues(files: DataFrame, per: float = 3.0) -> DataFrame:
    """Sentences of plain text with made-up spans: equal shares of ``duration_s`` where the files have one, else ``per`` seconds each."""
    from tidemark.functions.text import sentences

    rows = files.where(kind(F.col("path"), F.col("content")) == "plain").withColumn("s", sentences(F.col("content")))
    share = F.lit(per)
    if "duration_s" in files.columns:
        share = F.when((F.col("duration_s") > 0) & (F.col("duration_s") <= MOST), F.col("duration_s") / F.size("s")).otherwise(per)
    x = rows.select("path", share.alias("per"), F.posexplode("s").alias("pos", "text"))
    return x.select("path", "pos", (F.col("pos") * F.col("per")).alias("t0"), ((F.col("pos") + 1) * F.col("per")).alias("t1"), F.lit(None).cast("string").alias("speaker"), "text")


def load_transcripts(files: DataFrame, words: bool = False) -> DataFrame:
    """Cues of all files, whatever their kind: path, pos, t0, t1, speaker, text (and ``words``). A null or empty content gives no cue."""
    files = files.where(F.coalesce("content", F.lit("")) != "")
    out = cues(files).unionByName(json_cues(files), allowMissingColumns=True).unionByName(plain_cues(files), allowMissingColumns=True)
    return out if words else out.drop("words")


def enumerated(spark: SparkSession, path: str) -> DataFrame:
    """``id, url, title`` of an enumeration dump: one JSON object with ``entries``, or one entry a line; entries without a url are skipped."""
    entry = "struct<id:string,url:string,webpage_url:string,title:string>"
    rows = spark.read.text(path, wholetext=True).select(F.coalesce(F.from_json("value", f"struct<entries:array<{entry}>>")["entries"], F.from_json(F.concat(F.lit("["), F.regexp_replace(F.trim("value"), r"\}\s*\n\s*\{", "},{"), F.lit("]")), f"array<{entry}>")).alias("e"))
    return rows.select(F.explode("e").alias("e")).select("e.id", F.coalesce("e.url", "e.webpage_url").alias("url"), "e.title").where("url is not null").dropDuplicates(["url"])


def subscriptions(spark: SparkSession, path: str) -> DataFrame:
    """``url`` of a subscription list: a JSON list of strings or of objects with a ``url``; blank ones are skipped, each once."""
    text = spark.read.text(path, wholetext=True)
    items = text.select(F.explode(F.from_json("value", "array<string>")).alias("x"))
    return items.select(F.trim(F.coalesce(F.get_json_object("x", "$.url"), F.when(~F.col("x").rlike(r"^\s*[\[{]"), F.col("x")))).alias("url")).where("url <> ''").distinct()


def to_vtt(cues_: DataFrame) -> DataFrame:
    """The inverse for (path, t0, t1, speaker, text): one WebVTT content per path."""
    ms = lambda c: F.concat(F.lpad(F.floor(c / 3600).cast("string"), 2, "0"), F.lit(":"), F.lpad((F.floor(c / 60) % 60).cast("string"), 2, "0"), F.lit(":"), F.lpad((F.floor(c) % 60).cast("string"), 2, "0"), F.lit("."), F.lpad((F.floor(c * 1000 + 0.5) % 1000).cast("string"), 3, "0"))
    voice = F.when(F.col("speaker").isNotNull(), F.concat(F.lit("<v "), F.col("speaker"), F.lit(">"))).otherwise("")
    block = F.concat(ms(F.col("t0")), F.lit(" --> "), ms(F.col("t1")), F.lit("\n"), voice, F.col("text"))
    g = cues_.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("t0", block.alias("b")))).alias("bs"))
    return g.select("path", F.concat(F.lit("WEBVTT\n\n"), F.array_join(F.transform("bs", lambda x: x["b"]), "\n\n"), F.lit("\n")).alias("content"))
