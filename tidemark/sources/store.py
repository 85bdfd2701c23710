"""A store of Parquet tables. A table's rows lie in buckets by their first key; a version is a manifest that names each bucket's folder.

An upsert or a deletion reads and writes the buckets it touches only. The manifest of version n is one file that is created if absent,
so that of two writers of one version the second fails and may try again. Readers of older versions are not disturbed until ``vacuum``.
Upserts, insert-ignores, deletions and the ledger are plans over DataFrames as well, for use without a store.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

#: Buckets of a table; their number is bounded, so that manifests are small.
BUCKETS = 64


def upsert_latest(old: DataFrame, new: DataFrame, key: list[str], seq: str) -> DataFrame:
    """One row per key: the one with the greatest ``seq``; of equal ones the new row. Null keys are dropped."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    w = Window.partitionBy(*key).orderBy(F.col(seq).desc_nulls_last(), F.desc("_new"))
    for k in key:
        both = both.where(F.col(k).isNotNull())
    return both.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r", "_new")


def insert_ignore(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    return old.unionByName(new.dropDuplicates(key).join(old.select(*key), key, "left_anti"))


def changed(incoming: DataFrame, known: DataFrame, key: list[str]) -> DataFrame:
    """Rows whose key (id, content hash, version) is not known yet: what an idempotent ingest has to do."""
    return incoming.join(known.select(*key), key, "left_anti")


def forget(tables: dict[str, DataFrame], video_ids: DataFrame) -> dict[str, DataFrame]:
    """Every table without the rows of the given videos (video_id); pair tables lose pairs with an end in them."""
    gone = video_ids.select("video_id").distinct()
    out = {}
    for name, df in tables.items():
        if "video_id" in df.columns:
            out[name] = df.join(gone, "video_id", "left_anti")
        elif {"claim_a", "claim_b"} <= set(df.columns):
            for side in ("claim_a", "claim_b"):
                df = df.withColumn("_v", F.substring_index(side, "#", 1)).join(gone.withColumnRenamed("video_id", "_v"), "_v", "left_anti").drop("_v")
            out[name] = df
        else:
            out[name] = df
    return out


def merge_ledger(ledger: DataFrame, delta: DataFrame) -> DataFrame:
    """Sums of (metric, value), never below 0."""
    return ledger.unionByName(delta).groupBy("metric").agg(F.greatest(F.lit(0.0), F.sum("value")).alias("value"))


def merge_entities(old: DataFrame, new: DataFrame) -> DataFrame:
    """One row per entity_id: the first name stays, type and qid prefer the new, aliases (arrays) are appended where new, first seen first."""
    both = old.select("entity_id", "canonical_name", "type", "qid", "aliases", F.lit(0).alias("age")).unionByName(new.select("entity_id", "canonical_name", "type", "qid", "aliases", F.lit(1).alias("age")))
    pick = lambda c, order: F.expr(f"{order}({c}, age) filter (where {c} is not null)")
    aliases = F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("age", "aliases"))), lambda x: x["aliases"])))
    return both.groupBy("entity_id").agg(pick("canonical_name", "min_by").alias("canonical_name"), pick("type", "max_by").alias("type"), pick("qid", "max_by").alias("qid"), aliases.alias("aliases"))


def orphans(nodes: DataFrame, key: str, edges: DataFrame) -> DataFrame:
    """Nodes that no edge has at either end (a null end refers to nothing)."""
    used = edges.select(F.col("src").alias(key)).unionByName(edges.select(F.col("dst").alias(key))).where(F.col(key).isNotNull())
    return nodes.join(used, key, "left_anti")


class Conflict(RuntimeError):
    """Another writer has made this version of a table first."""


class Store:
    """Tables under one folder of any Hadoop file system."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, text: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(text)

    def _fs(self):
        return self._path(self.root).getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _versions(self, name: str) -> list[int]:
        found = self._fs().globStatus(self._path(f"{self.root}/{name}/VERSION-*"))
        return sorted(int(p.getPath().getName().split("-")[1]) for p in found or [])

    def manifest(self, name: str, version: int | None = None) -> dict | None:
        """Schema, first key and the buckets' folders of a version, the last one by default."""
        known = self._versions(name)
        if not known:
            return None
        stream = self._fs().open(self._path(f"{self.root}/{name}/VERSION-{version or known[-1]:08d}"))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")) | {"version": version or known[-1]}
        finally:
            stream.close()

    def _load(self, name: str, manifest: dict, buckets: list[int] | None = None) -> DataFrame:
        schema = T.StructType.fromJson(manifest["schema"])
        paths = [f"{self.root}/{name}/{p}" for b, p in manifest["parts"].items() if buckets is None or int(b) in buckets]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def read(self, name: str) -> DataFrame | None:
        m = self.manifest(name)
        return None if m is None else self._load(name, m)

    @staticmethod
    def _bucket(key: str) -> Column:
        return F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(BUCKETS)).cast("int")

    def _commit(self, name: str, base: dict | None, df: DataFrame, key: str, touched: list[int] | None) -> int:
        """Writes the rows of the touched buckets (all, if None) and a manifest that names them beside the untouched ones."""
        version, folder = (base["version"] if base else 0) + 1, f"v{uuid.uuid4().hex}"
        schema = df.schema
        df.withColumn("_bucket", self._bucket(key)).repartition("_bucket").write.partitionBy("_bucket").parquet(f"{self.root}/{name}/{folder}")
        made = self._fs().globStatus(self._path(f"{self.root}/{name}/{folder}/_bucket=*"))
        parts = {} if base is None or touched is None else {b: p for b, p in base["parts"].items() if int(b) not in touched}
        parts |= {p.getPath().getName().split("=")[1]: f"{folder}/{p.getPath().getName()}" for p in made or []}
        try:
            out = self._fs().create(self._path(f"{self.root}/{name}/VERSION-{version:08d}"), False)
        except Exception as e:  # noqa: BLE001 - the file system's own kind of exception
            raise Conflict(f"{name} has a version {version} already") from e
        out.write(bytearray(json.dumps({"schema": schema.jsonValue(), "key": key, "parts": parts}).encode()))
        out.close()
        return version

    def write(self, name: str, df: DataFrame, key: str | None = None) -> int:
        """The whole table anew."""
        return self._commit(name, self.manifest(name), df, key or df.columns[0], None)

    def upsert(self, name: str, new: DataFrame, key: list[str], seq: str, bucket: str | None = None) -> None:
        """Merges rows into the buckets they fall into; ``bucket``: the column that sets them, ``key``'s first by default."""
        base = self.manifest(name)
        by = base["key"] if base else bucket or key[0]
        new = new.where(F.col(by).isNotNull())
        touched = [r[0] for r in new.select(self._bucket(by)).distinct().collect()]  # at most BUCKETS numbers
        if not touched and base:
            return
        old = self._load(name, base, touched) if base else None
        none = new.where(F.lit(False))
        self._commit(name, base, upsert_latest(none if old is None else old, new, key, seq), by, touched)

    def remove(self, name: str, gone: DataFrame, column: str) -> None:
        """Deletes the rows whose ``column`` is among the values of ``gone``; reads only their buckets where the column sets them."""
        base = self.manifest(name)
        if base is None:
            return
        touched = [r[0] for r in gone.select(self._bucket(column)).distinct().collect()] if base["key"] == column else None
        old = self._load(name, base, touched)
        self._commit(name, base, old.join(gone.select(column).distinct(), column, "left_anti").select(*old.columns), base["key"], touched)

    def vacuum(self, name: str, keep: int = 1) -> int:
        """Deletes the folders that none of the last ``keep`` versions names, and the older manifests; returns the number of folders."""
        fs, versions = self._fs(), self._versions(name)
        used = {p.split("/")[0] for v in versions[-keep:] for p in self.manifest(name, v)["parts"].values()}
        gone = [p.getPath() for p in fs.globStatus(self._path(f"{self.root}/{name}/v*")) or [] if p.getPath().getName() not in used]
        for v in versions[:-keep]:
            fs.delete(self._path(f"{self.root}/{name}/VERSION-{v:08d}"), False)
        for p in gone:
            fs.delete(p, True)
        return len(gone)
