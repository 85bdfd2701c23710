"""The library's surface: an engine over a store of Parquet tables. Every question method returns a DataFrame.

Model-backed plug-ins are slots: functions between DataFrames (usually a ``mapInPandas``), given by name, or a list of (available, function)
of which the first available one is taken; without one the rule-based path is.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.config import Settings
from tidemark.functions import text as X
from tidemark.jobs import Jobs
from tidemark.operators import claims as C
from tidemark.operators import graph as G
from tidemark.operators import retrieval as R
from tidemark.operators import segmentation as S
from tidemark.operators.clustering import first_fit
from tidemark.operators.names import fuzzy_names
from tidemark.session import materialize, ship_package
from tidemark.sources import captions
from tidemark.sources.store import Store, changed, merge_entities, merge_ledger, orphans, upsert_latest

#: asr: files without captions -> cues; nli: (premise, text) -> label, overlap; reranker: fused rows -> fused rows; entity_linker: entities -> qid;
#: generator: citations -> (qid, answer).
SLOTS = ("asr", "nli", "reranker", "entity_linker", "generator")
TABLES = ("videos", "segments", "moments", "claims", "mentions", "entities", "speakers", "edges", "topics", "index", "stages", "ledger", "meta")
VERSION = "2"
#: Caption formats in order of preference among siblings of one stem.
FORMATS = ["vtt", "srt", "json", "txt"]
EXPORTED = ["claim_id", "moment_id", "video_id", "text", "subject", "predicate", "obj", "claim_type", "status", "salience", "entailment"]


class Engine:
    """Ingest of transcript files and the questions over what was ingested."""

    def __init__(self, spark: SparkSession, root: str, slots: dict | None = None, settings: Settings | dict | None = None):
        ship_package(spark)
        unknown = set(slots or {}) - set(SLOTS)
        if unknown:
            raise ValueError(f"no such slots: {sorted(unknown)}")
        self.spark, self.store = spark, Store(spark, root)
        self.settings = settings if isinstance(settings, Settings) else Settings.of(settings)
        self.slots = {name: fn for name, given in (slots or {}).items() if (fn := self._resolved(given))}
        self.jobs = Jobs(self.store)

    @staticmethod
    def _resolved(given) -> Callable | None:
        """A function as it is; of (available, function) candidates the first available one, or None."""
        return given if callable(given) else next((fn for ok, fn in given if ok()), None)

    # -- ingest ----------------------------------------------------------------------------------------------------------
    def sources(self, path: str) -> DataFrame:
        """One transcript file per stem (of siblings the preferred format) with its id and, from ``<stem>.meta.json`` beside it, its date.

        A path that isn't there raises; files of other kinds are left to the asr slot, or passed over.
        """
        where = self.store._path(path)
        if not where.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(where):
            raise FileNotFoundError(path)
        files = captions.read_files(self.spark, path).withColumn("kind", F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1)))
        files = files.withColumn("stem", F.regexp_replace("path", r"\.meta\.json$|(\.[a-z]{2})?\.[A-Za-z0-9]+$", ""))
        meta = F.col("path").endswith(".meta.json")
        day = F.coalesce(F.get_json_object("content", "$.published_at"), F.get_json_object("content", "$.upload_date"))
        side = files.where(meta).select("stem", day.alias("published_at"), F.get_json_object("content", "$.duration").cast("double").alias("duration_s"), F.get_json_object("content", "$.title").alias("title")).dropDuplicates(["stem"])
        rank = F.array_position(F.array(*map(F.lit, FORMATS)), F.col("kind"))
        rows = files.where(~meta & ((rank > 0) | F.lit("asr" in self.slots))).withColumn("rank", F.when(rank > 0, rank).otherwise(99))
        best = rows.withColumn("r", F.row_number().over(Window.partitionBy("stem").orderBy("rank", "path"))).where("r = 1")
        return best.join(side, "stem", "left").select("path", "content", "kind", "published_at", "duration_s", F.coalesce("title", F.regexp_extract("stem", r"([^/]+)$", 1)).alias("title"), "content_hash", F.concat(F.lit("vid:"), F.substring("content_hash", 1, 16)).alias("video_id"), F.lit(VERSION).alias("pipeline_version"))

    def ingest(self, path: str) -> dict[str, int]:
        """Files that are new or changed become videos, segments, moments and claims; known ones are left alone. Idempotent."""
        return self.ingest_files(self.sources(path))

    def ingest_files(self, files: DataFrame) -> dict[str, int]:
        known = self.store.read("videos")
        if known is not None:
            files = changed(files, known, ["video_id", "content_hash", "pipeline_version"])
        todo = materialize(files.dropDuplicates(["video_id"]))
        if todo.isEmpty():
            return {"videos": 0, "segments": 0, "moments": 0, "claims": 0}
        if known is not None:  # another content or version of a known video takes its place
            again = todo.select("video_id").join(known.select("video_id"), "video_id", "left_semi")
            if not again.isEmpty():
                self._forget(again)
        cues = captions.load_transcripts(todo.where(F.col("kind").isin(FORMATS)), words=True)
        if "asr" in self.slots:
            cues = cues.unionByName(self.slots["asr"](todo.where(~F.col("kind").isin(FORMATS))), allowMissingColumns=True)
        cues = cues.join(todo.select("path", "video_id"), "path")
        clean = S.clean_segments(cues).join(cues.select("video_id", "pos", "words"), ["video_id", "pos"], "left")
        segments = materialize(clean.select("video_id", F.xxhash64("video_id", "pos", "kind", "text").alias("seg_id"), F.col("t0").alias("start_s"), F.col("t1").alias("end_s"), "text", F.when(F.col("kind") == "speech", F.coalesce("speaker", F.lit("spk_0"))).alias("speaker"), "kind", "words").dropDuplicates(["seg_id"]))
        moments = materialize(self.build_moments(segments))
        batch = self._batch() + 1
        claims = materialize(self.build_claims(moments, segments).withColumn("batch", F.lit(batch).cast("bigint")))
        mentions = materialize(self.build_mentions(claims))
        now = F.current_timestamp()
        put = lambda name, df, key, by="video_id": self.store.upsert(name, df.withColumn("ingested_at", now), key, "ingested_at", by)
        put("segments", segments, ["seg_id"])
        put("moments", moments, ["moment_id"])
        put("index", R.build_index(moments.select(F.col("moment_id").alias("key"), "video_id", F.col("transcript").alias("text")), ["video_id"]), ["key"])
        put("claims", claims, ["claim_id"])
        put("mentions", mentions, ["claim_id", "entity_id"])
        self._put_entities(mentions)
        put("edges", self.build_edges(moments, claims, mentions), ["src", "rel", "dst", "video_id"])
        counts = {"videos": todo.count(), "segments": segments.count(), "moments": moments.count(), "claims": claims.count()}
        stages = moments.groupBy("video_id").agg(F.count(F.lit(1)).cast("double").alias("value")).select("video_id", F.lit("moments").alias("stage"), "value")
        put("stages", stages.unionByName(claims.groupBy("video_id").agg(F.count(F.lit(1)).cast("double").alias("value")).select("video_id", F.lit("claims").alias("stage"), "value")), ["video_id", "stage"])
        self._count({k: float(v) for k, v in counts.items()})
        # The video row, which marks completion, comes last.
        put("videos", todo.select("video_id", F.col("path").alias("source_url"), "title", "published_at", "duration_s", "content_hash", "pipeline_version"), ["video_id"])
        self.resolve_speakers()
        return counts

    def build_moments(self, segments: DataFrame) -> DataFrame:
        """Moments by all rules: speaker, gap, length, event in the gap, change of subject; short ones join the one before of the same speaker."""
        s = self.settings
        speech, keys = S.speech_segments(segments), ["video_id", "part"]
        rows = S.islands(speech, S.audio_events(segments)).select("video_id", "island", "seg_id", "t0", "t1", "speaker", "text")
        parts = S.fold(rows, S.hashed_cosine if s.subject_rule else None, s.max_moment_s)
        parts = parts.withColumn("part", F.struct("island", "grp"))
        g = S.group_rows(parts, keys).join(S.dominant(parts, keys), keys, "left")
        g = g.withColumn("no", F.row_number().over(Window.partitionBy("video_id").orderBy("part")) - 1)
        merged = S.merge_small(g, s.min_moment_s)
        m = merged.groupBy("video_id", "merged").agg(F.min("t_start").alias("t_start_s"), F.max("t_end").alias("t_end_s"), F.first("speaker_id", ignorenulls=True).alias("label"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("no", "transcript"))), lambda x: x["transcript"]), " ").alias("transcript"))
        who = F.when(F.col("label").isNotNull(), F.concat_ws(":", "video_id", "label"))
        return m.select(F.format_string("%s#m%04d", "video_id", "merged").alias("moment_id"), "video_id", F.col("merged").cast("int").alias("idx"), F.round("t_start_s", 3).alias("t_start_s"), F.round("t_end_s", 3).alias("t_end_s"), "transcript", who.alias("speaker_id"), F.lit(None).cast("string").alias("visual_caption"), F.lit(None).cast("string").alias("ocr_text"), F.lit(None).cast("string").alias("topic_id"))

    def build_claims(self, moments: DataFrame, segments: DataFrame) -> DataFrame:
        """Claims with the span of their own cue or words (else the moment's), verified against the speech of that span."""
        m = moments.select("moment_id", "transcript", "speaker_id", F.col("t_start_s").alias("a0"), F.col("t_end_s").alias("a1"))
        rows = materialize(C.extract(moments.select("moment_id", "video_id", "transcript")).join(m, "moment_id"))
        cues = segments.where("kind = 'speech'").select("video_id", "seg_id", F.col("start_s").alias("b0"), F.col("end_s").alias("b1"), "text", "words")
        rows = rows.join(C.locate(rows, cues).select("claim_id", "t_start_s", "t_end_s"), "claim_id", "left")
        rows = rows.withColumn("t_start_s", F.coalesce("t_start_s", "a0")).withColumn("t_end_s", F.coalesce("t_end_s", "a1")).drop("a0", "a1")
        said = segments.where("kind = 'speech'").select("video_id", "seg_id", F.col("start_s").alias("t0"), F.col("end_s").alias("t1"), "text")
        checked = C.gate(C.own_premise(rows, said), self.settings.salience_floor or None, self.slots.get("nli"))
        return checked.drop("premise", "transcript").withColumn("superseded_by", F.lit(None).cast("string"))

    def build_mentions(self, claims: DataFrame) -> DataFrame:
        """Entities of committed claims, one row per claim and entity."""
        m = claims.where("status = 'committed'").select("claim_id", "video_id", "t_start_s", "t_end_s", F.posexplode(X.mentions_of(*map(F.col, ("text", "subject", "obj")))).alias("pos", "surface"))
        m = m.withColumn("entity_id", F.concat(F.lit("ent:"), X.slugify(F.col("surface"), default="item")))
        return m.groupBy("claim_id", "video_id", "entity_id", "t_start_s", "t_end_s").agg(F.min_by("surface", "pos").alias("surface"))

    def _put_entities(self, mentions: DataFrame) -> None:
        first = mentions.groupBy("entity_id", "surface").agg(F.min("claim_id").alias("at"))
        new = first.groupBy("entity_id").agg(F.min_by("surface", F.struct("at", "surface")).alias("canonical_name"), F.transform(F.array_sort(F.collect_list(F.struct("at", "surface"))), lambda x: x["surface"]).alias("aliases"))
        new = new.select("entity_id", "canonical_name", F.lit(None).cast("string").alias("type"), F.lit(None).cast("string").alias("qid"), "aliases")
        if "entity_linker" in self.slots:
            new = new.drop("qid").join(self.slots["entity_linker"](new.drop("qid")).select("entity_id", "qid"), "entity_id", "left").select("entity_id", "canonical_name", "type", "qid", "aliases")
        old = self.store.read("entities")
        self.store.write("entities", new if old is None else merge_entities(old, new))

    def build_edges(self, moments: DataFrame, claims: DataFrame, mentions: DataFrame) -> DataFrame:
        """PRECEDES, STATES, ATTRIBUTED_TO, MENTIONS, ELABORATES and CORRECTS edges with their spans and confidence."""
        edge = lambda src, rel, dst, t0, t1, conf=1.0: [src.alias("src"), F.lit(rel).alias("rel"), dst.alias("dst"), F.col("video_id"), t0.alias("t_start_s"), t1.alias("t_end_s"), (conf if isinstance(conf, Column) else F.lit(conf)).cast("double").alias("confidence")]
        c = F.col
        w = Window.partitionBy("video_id").orderBy("idx")
        precedes = moments.withColumn("next", F.lead(F.struct("moment_id", "t_end_s")).over(w)).where("next is not null").select(*edge(c("moment_id"), "PRECEDES", c("next.moment_id"), c("t_start_s"), c("next.t_end_s")))
        ok = claims.where("status = 'committed'")
        named = ok.where("speaker_id is not null")
        states = named.select(*edge(c("speaker_id"), "STATES", c("claim_id"), c("t_start_s"), c("t_end_s"), c("entailment")))
        attributed = named.select(*edge(c("claim_id"), "ATTRIBUTED_TO", c("speaker_id"), c("t_start_s"), c("t_end_s")))
        about = mentions.select(*edge(c("claim_id"), "MENTIONS", c("entity_id"), c("t_start_s"), c("t_end_s")))
        w = Window.partitionBy("moment_id").orderBy("claim_id")
        after = ok.withColumn("next", F.lead(F.struct("claim_id", "speaker_id", "t_end_s")).over(w)).where("next is not null and speaker_id <=> next.speaker_id")
        elaborates = after.select(*edge(c("claim_id"), "ELABORATES", c("next.claim_id"), c("t_start_s"), c("next.t_end_s")))
        keys = F.concat(F.transform(X.content_tokens(c("subject")), lambda t: F.concat(F.lit("subject:"), t)), F.transform(X.mentions_of(*map(F.col, ("text", "subject", "obj"))), lambda t: F.concat(F.lit("mention:"), t)))
        k = ok.withColumn("key", F.explode(F.array_distinct(keys)))
        k = k.withColumn("prior", F.lag(F.struct("t_start_s", "claim_id")).over(Window.partitionBy("video_id", "key").orderBy("t_start_s", "claim_id"))).where("claim_type = 'CORRECTION' and prior is not null")
        corrects = k.groupBy("claim_id", "video_id", "t_start_s", "t_end_s").agg(F.max("prior").alias("prior")).select(*edge(c("claim_id"), "CORRECTS", c("prior.claim_id"), c("t_start_s"), c("t_end_s")))
        out = precedes
        for part in (states, attributed, about, elaborates, corrects):
            out = out.unionByName(part)
        return out.dropDuplicates(["src", "rel", "dst", "video_id"])

    def resolve_speakers(self) -> None:
        """Named speakers of all videos as canonical ones: greedy first fit of their normalized names, SAME_AS edges, spk:<slug>."""
        m = self.table("moments").where("speaker_id is not null").select("video_id", "speaker_id").distinct()
        label = F.regexp_replace("speaker_id", r"^.*:", "")
        named = m.withColumn("label", label).where(~F.col("label").rlike(r"^spk_\d+$")).withColumn("name", X.normalized(F.col("label"))).where("name <> ''")
        groups = materialize(fuzzy_names(named, "name"))
        first = F.concat(F.lit("spk:"), X.slugify(F.col("canonical"), default="unknown"))
        rows = named.join(groups, "name").select("video_id", "speaker_id", "label", first.alias("canonical_id"), F.col("canonical").alias("resolved_name"))
        self.store.write("speakers", rows.dropDuplicates(["speaker_id"]), "video_id")
        same = rows.select(F.col("speaker_id").alias("src"), F.lit("SAME_AS").alias("rel"), F.col("canonical_id").alias("dst"), "video_id", F.lit(None).cast("double").alias("t_start_s"), F.lit(None).cast("double").alias("t_end_s"), F.lit(1.0).alias("confidence"))
        self._replace_edges(["SAME_AS"], same)

    def _replace_edges(self, rels: list[str], new: DataFrame) -> None:
        left = self.table("edges").where(~F.col("rel").isin(rels))
        self.store.write("edges", left.unionByName(new.withColumn("ingested_at", F.current_timestamp())), "video_id")

    # -- small tables ----------------------------------------------------------------------------------------------------
    def meta(self, key: str, default: str | None = None) -> str | None:
        df = self.store.read("meta")
        row = None if df is None else df.where(F.col("key") == key).first()
        return row["value"] if row else default

    def set_meta(self, key: str, value: str) -> None:
        self.store.upsert("meta", self.spark.createDataFrame([(key, value)], "key string, value string").withColumn("at", F.current_timestamp()), ["key"], "at")

    def _count(self, delta: dict[str, float]) -> None:
        new = self.spark.createDataFrame(list(delta.items()), "metric string, value double")
        ledger = self.store.read("ledger")
        self.store.write("ledger", new if ledger is None else merge_ledger(ledger, new))

    def _batch(self) -> int:
        """The greatest ingest batch of any claim, 0 without one: the high-water mark."""
        claims = self.store.read("claims")
        return 0 if claims is None else claims.agg(F.coalesce(F.max("batch"), F.lit(0))).first()[0]

    # -- questions -------------------------------------------------------------------------------------------------------
    def table(self, name: str) -> DataFrame:
        df = self.store.read(name)
        if df is None:
            raise LookupError(f"nothing has been ingested into {name}")
        return df

    def list_videos(self) -> DataFrame:
        return self.table("videos").orderBy(F.desc("ingested_at"), "video_id")

    def moments(self, video_id: str) -> DataFrame:
        return self.table("moments").where(F.col("video_id") == video_id).orderBy("idx", "moment_id")

    def claims(self, video_id: str | None = None, moment_id: str | None = None, status: str | None = "committed") -> DataFrame:
        c = self.table("claims")
        for column, value in (("video_id", video_id), ("moment_id", moment_id), ("status", status)):
            c = c if value is None else c.where(F.col(column) == value)
        return c.orderBy("t_start_s", "claim_id")

    def lookup(self, name: str, key: str, ids: Iterable[str]) -> DataFrame:
        """Rows of a table by a list of ids, in the order of the list; unknown ids have no row, a repeated id counts once."""
        asked = self.spark.createDataFrame([(x, i) for i, x in enumerate(dict.fromkeys(ids))], f"{key} string, ord int")
        return self.table(name).join(asked, key).orderBy("ord").drop("ord")

    def retrieve(self, questions: DataFrame, k: int | None = None, visual: DataFrame | None = None) -> DataFrame:
        """Fused rows of (qid, question[, video_id]): each clause on its own, then in turns; see ``retrieval.retrieve``."""
        k = k or self.settings.top_k
        scope = ["video_id"] if "video_id" in questions.columns else []
        parts = questions.select("qid", *scope, F.posexplode(R.decompose(F.col("question"))).alias("part", "sub"))
        parts = materialize(parts.select(F.to_json(F.struct("qid", "part")).alias("id"), "qid", "part", *scope, F.col("sub").alias("question"), R.strategy(F.col("sub")).alias("strategy")))
        graph = None
        if not parts.where("strategy = 'contradiction'").isEmpty():
            graph = (self.table("claims"), self.table("edges"))
        looks = None
        if visual is not None and (vectors := self.store.read("visual_vectors")) is not None:
            looks = (visual.join(parts.select("qid", "id"), "qid").select(F.col("id").alias("qid"), "vec"), vectors.select(F.col("moment_id").alias("key"), "vec"))
        asked = parts.select(F.col("id").alias("qid"), "question", "strategy", *scope)
        fused = R.retrieve(asked, self.table("index"), k, graph, looks)
        if "reranker" in self.slots:
            fused = self.slots["reranker"](fused)
        merged = R.merge_parts(fused.withColumnRenamed("qid", "id").join(parts.select("id", "qid", "part"), "id"), k)
        if self.settings.decay:
            merged = R.ranked(R.decay(merged, self.days().select(F.col("moment_id").alias("key"), "day"), self.table("claims").select(F.col("moment_id").alias("key"), "status"), self.settings.halflife_days), k)
        return merged

    def days(self) -> DataFrame:
        """The day of every moment's video."""
        v = self.table("videos").select("video_id", F.to_date(X.iso_timestamp(F.col("published_at"))).alias("day"))
        return self.table("moments").select("moment_id", "video_id").join(v, "video_id", "left")

    def cite(self, questions: DataFrame, k: int | None = None, visual: DataFrame | None = None) -> DataFrame:
        """Citations of the questions, in order of time for temporal ones."""
        m = self.table("moments").select("moment_id", "video_id", "transcript", "ocr_text", "visual_caption", "speaker_id", "t_start_s", "t_end_s")
        cited = R.citations(self.retrieve(questions, k, visual), questions.select("qid", "question"), m, self.table("videos").select("video_id", "source_url", "title"))
        return R.by_time(cited, self.days().select("video_id", "day").distinct())

    def ask(self, questions: DataFrame, k: int | None = None, visual: DataFrame | None = None) -> DataFrame:
        """``qid, low_evidence, answer, strategy, n_citations`` of (qid, question[, video_id]): plan, retrieve, cite, gate, answer.

        A generated answer is taken only where every sentence carries a citation. A refused question has no citations.
        """
        cited = materialize(self.cite(questions, k, visual))
        m = self.table("moments").select(F.col("moment_id").alias("key"), F.col("transcript").alias("text"))
        relevant = R.relevance(cited, m, list(self.settings.common_words), self.settings.relevance_min_moments)
        out = R.answers(cited, relevant, self.settings.relevance_floor).join(cited.groupBy("qid").agg(F.count(F.lit(1)).cast("int").alias("n_citations")), "qid", "left")
        if "generator" in self.slots:
            out = out.drop("answer").join(R.valid_answers(self.slots["generator"](cited), out.where("not low_evidence")), "qid", "left").withColumn("answer", F.coalesce("answer", F.lit(R.REFUSAL)))
        rows = questions.select("qid", R.strategy(F.col("question")).alias("strategy")).join(out, "qid", "left")
        low = F.coalesce("low_evidence", F.lit(True))
        return rows.select("qid", low.alias("low_evidence"), F.coalesce("answer", F.lit(R.REFUSAL)).alias("answer"), "strategy", F.when(low, 0).otherwise(F.col("n_citations")).alias("n_citations"))

    def clips(self, questions: DataFrame, k: int | None = None) -> DataFrame:
        """Watch windows over the cited spans, with a ranged link."""
        cited = materialize(self.cite(questions, k))
        spans = cited.where("t_start_s is not null and t_end_s is not null").select("qid", "video_id", "t_start_s", "t_end_s", "idx")
        v = self.table("videos").select("video_id", "source_url")
        return R.stitch(spans, self.settings.clip_gap_s).join(v, "video_id", "left").withColumn("link", X.ranged_link(F.col("source_url"), F.col("t_start_s"), F.col("t_end_s")))

    def clip(self, video_id: str, start_s: float, end_s: float) -> DataFrame:
        """Moments of a video that touch a window."""
        return self.moments(video_id).where((F.col("t_start_s") <= end_s) & (F.col("t_end_s") >= start_s))

    def visual_search(self, queries: DataFrame, k: int | None = None) -> DataFrame:
        """``qid, key, score, rank``: moments by cosine of their frames' mean with (qid, vec)."""
        return R.vector_search(queries, self.table("visual_vectors").select(F.col("moment_id").alias("key"), "video_id", "vec"), k or self.settings.top_k)

    def add_visual_events(self, events: DataFrame) -> None:
        """Frames (event_id, video_id, t_start_s, t_end_s, caption, ocr_text, embedding) become on-screen text and mean vectors of the moments they overlap."""
        from tidemark.operators.visual import mean_vector

        m = self.table("moments")
        spans = m.where(S.finite_span(m, "t_start_s", "t_end_s")).select("video_id", F.col("moment_id").alias("a_id"), F.col("t_start_s").alias("a0"), F.col("t_end_s").alias("a1"))
        seen = events.where(S.finite_span(events, "t_start_s", "t_end_s")).select("video_id", "event_id", F.col("t_start_s").alias("b0"), F.col("t_end_s").alias("b1"), "caption", "ocr_text", "embedding")
        pairs = materialize(S.overlap_join(spans, seen, 60.0))
        joined = lambda c: F.array_join(F.array_distinct(F.filter(F.transform(F.array_sort(F.collect_list(F.struct("b0", "event_id", c))), lambda x: F.trim(x[c])), lambda t: t != "")), " ")
        texts = pairs.groupBy(F.col("a_id").alias("moment_id")).agg(joined("ocr_text").alias("o"), joined("caption").alias("v"))
        shown = m.drop("ocr_text", "visual_caption").join(texts, "moment_id", "left").withColumn("ocr_text", F.nullif("o", F.lit(""))).withColumn("visual_caption", F.nullif("v", F.lit(""))).select(*m.columns)
        self.store.write("moments", shown, "video_id")
        mean = mean_vector(pairs.where("embedding is not null and size(embedding) > 0"), "a_id", "embedding").groupBy(F.col("a_id").alias("moment_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "mean"))), lambda x: x["mean"]).alias("vec"))
        self.store.write("visual_vectors", mean.withColumn("video_id", F.substring_index("moment_id", "#", 1)), "video_id")

    # -- consolidation ---------------------------------------------------------------------------------------------------
    def contradictions(self, topic: str | None = None, scope: DataFrame | None = None, supports: bool = True) -> DataFrame:
        s = self.settings
        return C.find_contradictions(self.table("claims").where("status = 'committed'"), topic, s.contradiction_threshold, s.max_claims, s.bucket_cap, supports, scope)[0]

    def groups(self) -> DataFrame:
        """``node, group`` of all committed claims, claims alone included; by shared words and, if set, by cosine of their hashed texts."""
        c = self.table("claims").where("status = 'committed'")
        sets = C.token_sets(c)
        pairs = C.mirrors(sets, cap=self.settings.bucket_cap).select("a", "b")
        if self.settings.consensus_cosine > 0:
            vec = R.build_index(c.select(F.col("claim_id").alias("key"), "text")).select(F.col("key").alias("claim_id"), F.col("vec").alias("raw"))
            cells = F.udf(lambda raw: [float(x) for x in memoryview(raw).cast("i")], "array<double>")  # only where cosine equivalence is on
            pairs = pairs.unionByName(C.cosine_pairs(sets, vec.select("claim_id", cells("raw").alias("vec")), self.settings.consensus_cosine, self.settings.bucket_cap)).distinct()
        return G.with_singletons(c, G.equivalence_groups(pairs))

    def clusters(self) -> DataFrame:
        """Consensus of every group, singletons included, best first."""
        c = self.table("claims").where("status = 'committed'").join(self.groups().withColumnRenamed("node", "claim_id"), "claim_id")
        v = self.table("videos").select("video_id", F.to_date(X.iso_timestamp(F.col("published_at"))).alias("day"))
        return C.consensus(c.join(v, "video_id", "left").select("group", "claim_id", "video_id", "salience", "day"), self.settings.halflife_days).orderBy(F.desc("support"), F.desc("score"), "group")

    def consolidate(self, full: bool = False) -> dict[str, int]:
        """Topics, relations of claims past the mark with all others, consensus, duplicates and corrections; then the mark moves on.

        Returns totals of the whole graph, so that a second run without new claims reports the same.
        """
        mark = 0 if full else int(self.meta("consolidated", "0"))
        high = self._batch()
        topics = self.induce_topics()
        ok = self.table("claims").where("status = 'committed'")
        fresh = ok.where(F.col("batch") > mark).select("claim_id")
        s = self.settings
        dropped = 0
        if not fresh.isEmpty():
            found, dropped = C.find_contradictions(ok, None, s.contradiction_threshold, s.max_claims, s.bucket_cap, True, None if mark == 0 else fresh)
            found = materialize(found)
            edges = found.join(ok.select(F.col("claim_id").alias("a"), "video_id", "t_start_s", "t_end_s"), "a").select(F.col("a").alias("src"), F.col("relation").alias("rel"), F.col("b").alias("dst"), "video_id", "t_start_s", "t_end_s", F.col("score").alias("confidence"))
            self.store.upsert("edges", edges.withColumn("ingested_at", F.current_timestamp()), ["src", "rel", "dst", "video_id"], "ingested_at")
        rels = {r["rel"]: r["n"] for r in self.table("edges").groupBy("rel").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row for each relation
        agreed = self.clusters().where("support >= 2").count()
        gone = materialize(C.dedup(self.table("claims"), self.table("edges")))
        claims = self.table("claims")
        if not gone.isEmpty():
            rows = claims.join(gone.withColumnRenamed("superseded_by", "by"), "claim_id", "left")
            rows = rows.withColumn("superseded_by", F.coalesce("by", "superseded_by")).withColumn("status", F.when(F.col("by").isNotNull(), "superseded").otherwise(F.col("status")))
            self.store.write("claims", rows.select(*claims.columns), "video_id")
        self.set_meta("consolidated", str(high))
        both = rels.get("CONTRADICTS", 0) + rels.get("SUPPORTS", 0)
        return {"relations": both, "contradictions": rels.get("CONTRADICTS", 0), "supports": rels.get("SUPPORTS", 0), "clusters": agreed, "superseded": gone.count(), "topics": topics, "claims_scanned": fresh.count(), "claims_skipped": dropped}

    def induce_topics(self) -> int:
        """Topics with labels, sizes and ABOUT edges; moments carry their topic. Returns the number of topics."""
        s = self.settings
        m = self.table("moments")
        cells = F.udf(lambda raw: [float(x) for x in memoryview(raw).cast("i")], "array<double>")
        vec = self.table("index").select("key", cells("vec").alias("vec"))
        members = materialize(first_fit(vec, s.topic_threshold, s.topic_representatives).select(F.col("key").alias("moment_id"), "leader"))
        sizes = members.groupBy("leader").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= s.topic_min_size)
        rows = members.join(sizes, "leader").join(m.select("moment_id", "transcript"), "moment_id")
        counts = rows.select("leader", F.explode(X.content_tokens(F.col("transcript"))).alias("t")).groupBy("leader", "t").agg(F.count(F.lit(1)).alias("c"))
        top = counts.withColumn("r", F.row_number().over(Window.partitionBy("leader").orderBy(F.desc("c"), "t"))).where("r <= 3")
        labels = top.groupBy("leader").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "t"))), lambda x: x["t"]), " ").alias("label"))
        named = sizes.join(labels, "leader", "left").withColumn("topic_id", F.concat(F.lit("topic:"), F.coalesce(X.slugify(F.col("label"), default="topic"), F.substring(F.sha1("leader"), 1, 16)))).withColumn("label", F.coalesce("label", "topic_id"))
        # Two clusters with one label share a topic; the last one's size counts.
        self.store.write("topics", named.groupBy("topic_id").agg(F.max("label").alias("label"), F.max_by("n", "leader").alias("moment_count")))
        at = materialize(members.join(named.select("leader", "topic_id"), "leader").select("moment_id", F.col("topic_id").alias("_topic")))
        moved = m.join(at, "moment_id", "left").withColumn("topic_id", F.coalesce("_topic", "topic_id")).select(*m.columns)
        self.store.write("moments", moved, "video_id")
        about = at.join(self.table("moments").select("moment_id", "video_id", "t_start_s", "t_end_s"), "moment_id").select(F.col("moment_id").alias("src"), F.lit("ABOUT").alias("rel"), F.col("_topic").alias("dst"), "video_id", "t_start_s", "t_end_s", F.lit(1.0).alias("confidence"))
        self._replace_edges(["ABOUT"], about)
        return self.table("topics").count()

    def topics(self) -> DataFrame:
        return self.table("topics").orderBy("topic_id")

    def synthesize(self, topic: str) -> dict:
        """What the corpus says about a topic: consensus and disagreement of the claims that cover it, each sentence cited, else salient claims.

        ``text, low_evidence, citations, consensus, contradictions`` (the last three DataFrames). Low evidence without two covering videos
        or where the topic is none of the corpus. Groups are checked by entailment on their first 200 members, as a bound of the feature.
        """
        s, none = self.settings, {"text": R.REFUSAL, "low_evidence": True, "citations": None, "consensus": None, "contradictions": None}
        want = F.lit(topic)
        context = R.coverage_tokens(want)
        c = C.on_topic(self.table("claims").where("status = 'committed'"), topic)
        share = F.size(F.array_intersect(R.coverage_tokens(F.col("text")), context)) / F.size(context)
        c = materialize(c.where((F.size(context) == 0) | (share >= s.relevance_floor)))
        if c.select("video_id").distinct().limit(2).count() < 2:
            return none
        cited = c.groupBy("moment_id", "video_id").agg(F.min(F.struct("t_start_s", "claim_id")).alias("at")).withColumn("idx", F.row_number().over(Window.orderBy("video_id", "at")))
        m = self.table("moments").select("moment_id", "transcript", "ocr_text", "visual_caption", "t_start_s", "t_end_s")
        v = self.table("videos").select("video_id", "source_url", "title", "published_at")
        full = cited.join(m, "moment_id").join(v, "video_id", "left")
        text = R.content({x: F.coalesce(x, F.lit("")) for x in ("transcript", "ocr_text", "visual_caption")})
        citations = materialize(full.select(F.lit(0).alias("qid"), want.alias("question"), "idx", "moment_id", "video_id", "title", X.truncate(F.when(X.strip(F.coalesce("transcript", F.lit(""))) != "", X.strip(F.col("transcript"))).otherwise(text), 240).alias("snippet"), F.lit("").alias("source_text"), X.deep_link(F.col("source_url"), F.col("t_start_s")).alias("link")))
        corpus = self.table("moments").select(F.col("moment_id").alias("key"), F.col("transcript").alias("text"))
        if R.relevance(citations, corpus, list(s.common_words), s.relevance_min_moments).first()["relevance"] < s.relevance_floor:  # one row
            return none
        sets = C.token_sets(c)
        pairs = materialize(C.mirrors(sets, cap=s.bucket_cap))
        groups = materialize(G.equivalence_groups(pairs).withColumnRenamed("node", "claim_id"))
        small = groups.withColumn("r", F.row_number().over(Window.partitionBy("group").orderBy("claim_id"))).where("r <= 200").drop("r")
        inside = small.select("group", F.col("claim_id").alias("a")).join(small.select("group", F.col("claim_id").alias("b")), "group").where("a <> b")
        both = C.related(c, inside.select("a", "b")).join(small.select(F.col("claim_id").alias("a"), "group"), "a")
        verdict = both.groupBy("group").agg(F.max(F.when((F.col("label") == "contradiction") & (F.col("a") < F.col("b")), F.col("overlap"))).alias("against"), F.max(F.when(F.col("label") == "entailment", F.col("overlap"))).alias("with"))
        good = verdict.where((F.coalesce("against", F.lit(0.0)) < s.contradiction_threshold) & (F.col("with") >= C.ENTAIL)).select("group")
        members = c.join(groups, "claim_id").join(good, "group", "left_semi").join(v.select("video_id", F.to_date(X.iso_timestamp(F.col("published_at"))).alias("day")), "video_id", "left")
        agreed = C.consensus(members.select("group", "claim_id", "video_id", "salience", "day"), s.halflife_days).where("support >= 2")
        at = c.join(citations.select("moment_id", "idx"), "moment_id").select("claim_id", "text", "idx", "moment_id", "salience", "video_id", "t_start_s")
        agreed = materialize(agreed.join(at.select(F.col("claim_id").alias("representative"), "text", "idx"), "representative").orderBy(F.desc("support"), F.desc("score"), "group"))
        against = materialize(C.relations(c, pairs, s.contradiction_threshold).where("relation = 'CONTRADICTS'"))
        sides = against.select(F.posexplode(F.array("a", "b")).alias("side", "claim_id"), F.col("score"), "a", "b")
        sides = sides.groupBy("claim_id").agg(F.min(F.struct(-F.col("score"), "a", "b", "side")).alias("k")).join(agreed.select(F.col("representative").alias("claim_id")), "claim_id", "left_anti").join(at, "claim_id")
        lines = agreed.select(F.struct(F.lit(0).alias("kind"), (-F.col("support")).alias("x"), (-F.col("score")).alias("y"), F.col("group").alias("z"), F.lit(0).alias("w")).alias("k"), "text", "idx").unionByName(sides.select(F.struct(F.lit(1).alias("kind"), F.lit(0).cast("bigint").alias("x"), F.col("k.col1").alias("y"), F.concat("k.a", "k.b").alias("z"), F.col("k.side").alias("w")).alias("k"), "text", "idx"))
        if lines.isEmpty():
            best = at.groupBy("moment_id").agg(F.min(F.struct(-F.coalesce("salience", F.lit(0.0)), "video_id", "t_start_s", "claim_id", "text", "idx")).alias("b")).orderBy("b").limit(4)
            lines = best.select(F.struct(F.lit(2).alias("kind"), F.lit(0).alias("x"), F.col("b.col1").alias("y"), F.col("b.claim_id").alias("z"), F.lit(0).alias("w")).alias("k"), "b.text", "b.idx")
        said = X.strip(F.col("text"))
        sentence = F.concat(said, F.when(said.rlike(r"[.!?]$"), "").otherwise("."), F.lit(" ["), F.col("idx").cast("string"), F.lit("]"))
        row = lines.select("k", sentence.alias("s")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "s"))), lambda x: x["s"]), " ").alias("text")).first()  # the text of one report
        return {"text": row["text"], "low_evidence": False, "citations": citations.select("idx", "moment_id", "video_id", "title", "snippet", "link"), "consensus": agreed, "contradictions": against}

    def evolution(self, entity_id: str | None = None, topic: str | None = None) -> DataFrame:
        """The committed and superseded claims of an entity or a topic in order of date, each with its relation to the one before."""
        c = self.table("claims").where("status in ('committed', 'superseded')")
        if entity_id is not None:
            c = c.join(self.table("mentions").where(F.col("entity_id") == entity_id).select("claim_id").distinct(), "claim_id", "left_semi")
        c = C.on_topic(c, topic)
        v = self.table("videos").select("video_id", F.to_date(X.iso_timestamp(F.col("published_at"))).alias("day"))
        steps = c.join(v, "video_id", "left").select(F.lit(entity_id or topic or "").alias("subject"), "claim_id", "day", F.coalesce("t_start_s", F.lit(0.0)).alias("t"))
        return C.evolution(steps, self.table("edges"))

    def claim_history(self, claim_id: str | None = None) -> DataFrame:
        """The versions before and after a claim, or the last version of every superseded one."""
        if claim_id is None:
            return G.follow(self.table("claims"), "claim_id", "superseded_by")
        return G.history(self.table("claims"), self.spark.createDataFrame([(claim_id,)], "claim_id string"))

    def supersede(self, old: str, new: str) -> None:
        """Marks one claim as superseded by another."""
        c = self.table("claims")
        row = c.where(F.col("claim_id") == old).withColumn("status", F.lit("superseded")).withColumn("superseded_by", F.lit(new)).withColumn("ingested_at", F.current_timestamp())
        self.store.upsert("claims", row, ["claim_id"], "ingested_at")

    def provenance(self, claim_id: str | None = None) -> DataFrame:
        c = self.table("claims").join(self.table("videos").select("video_id", "source_url"), "video_id", "left")
        c = c if claim_id is None else c.where(F.col("claim_id") == claim_id)
        return c.select("claim_id", (F.col("status") == "committed").alias("trusted"), F.when(F.col("status") == "committed", X.deep_link(F.col("source_url"), F.col("t_start_s"))).alias("link"))

    def export(self) -> DataFrame:
        """Claims as JSON documents of one shape; a table that lacks a field of it is refused."""
        c = self.table("claims")
        if missing := [f for f in EXPORTED if f not in c.columns]:
            raise ValueError(f"claims lack {missing}")
        return c.select("claim_id", F.to_json(F.struct(*EXPORTED, "t_start_s", "t_end_s"), {"ignoreNullFields": "false"}).alias("document"))

    # -- deletion --------------------------------------------------------------------------------------------------------
    def _forget(self, gone: DataFrame) -> None:
        """Everything of the given videos: their rows, edges to them, entities, topics and speakers nobody refers to any more, their counts."""
        gone = materialize(gone.select("video_id").distinct())
        lost = {}
        nodes = None
        for name, key in (("moments", "moment_id"), ("claims", "claim_id")):
            df = self.store.read(name)
            if df is not None:
                part = df.join(gone, "video_id", "left_semi").select(F.col(key).alias("node"))
                nodes = part if nodes is None else nodes.unionByName(part)
        nodes = materialize(nodes) if nodes is not None else None
        for name in ("videos", "segments", "moments", "claims"):
            df = self.store.read(name)
            lost[name] = -float(df.join(gone, "video_id", "left_semi").count()) if df is not None else 0.0
        for name in ("index", "mentions", "claims", "segments", "moments", "stages", "speakers", "edges", "visual_vectors", "videos"):
            self.store.remove(name, gone, "video_id")
        edges = self.store.read("edges")
        if edges is not None:
            if nodes is not None:
                for end in ("src", "dst"):
                    edges = edges.join(nodes.withColumnRenamed("node", end), end, "left_anti")
                self.store.write("edges", edges.select(*self.table("edges").columns), "video_id")
                edges = self.table("edges")
            for name, key in (("entities", "entity_id"), ("topics", "topic_id")):
                if (df := self.store.read(name)) is not None:
                    self.store.remove(name, orphans(df, key, edges), key)
        self.set_meta("consolidated", "0")
        self._count(lost)

    def delete_video(self, video_id: str) -> None:
        self._forget(self.spark.createDataFrame([(video_id,)], "video_id string"))

    # -- reports, subscriptions, jobs ------------------------------------------------------------------------------------
    def stats(self) -> DataFrame:
        out = None
        for n in TABLES:
            df = self.store.read(n)
            one = self.spark.range(1).select(F.lit(n).alias("name"), F.lit(0).cast("bigint").alias("n")) if df is None else df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(n).alias("name"), "n")
            out = one if out is None else out.unionByName(one)
        return out

    def metrics(self) -> DataFrame:
        return self.table("ledger")

    def sync(self, subscriptions: DataFrame) -> dict[str, dict | str]:
        """Ingests the subscribed folders (url) in one batch and consolidates once; a failing one is reported and does not stop the others."""
        out: dict[str, dict | str] = {}
        files = None
        for (url,) in subscriptions.select("url").distinct().orderBy("url").toLocalIterator():
            try:
                one = materialize(self.sources(url))
                known = self.store.read("videos")
                new = one if known is None else changed(one, known, ["video_id", "content_hash", "pipeline_version"])
                out[url] = {"videos": new.select("video_id").distinct().count()}
                files = one if files is None else files.unionByName(one)
            except Exception as e:  # noqa: BLE001 - isolated per source
                out[url] = f"failed: {str(e)[:200]}"
        if files is not None and self.ingest_files(files)["videos"]:
            self.consolidate()
        return out

    def enqueue(self, kind: str, **args) -> str:
        """A job for ``work``: ingest (path), sync (path of a subscription list) or consolidate."""
        return self.jobs.enqueue(kind, args)

    def work(self, most: int = 100) -> int:
        return self.jobs.work({"ingest": self.ingest, "consolidate": self.consolidate, "sync": lambda path: self.sync(captions.subscriptions(self.spark, path))}, most)


__all__ = ["SLOTS", "TABLES", "Engine", "Settings", "upsert_latest"]
