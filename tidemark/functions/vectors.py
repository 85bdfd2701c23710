"""Vector expressions on arrays: dot product, norm, cosine, normalization, frame distance, the hashing embedder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.text import tokens


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    n = norm(a) * norm(b)
    return F.when(n > 0, dot(a, b) / n).otherwise(0.0)


def normalize(a: Column) -> Column:
    """Unit length; the zero vector is unchanged."""
    n = norm(a)
    return F.when(n > 0, F.transform(a, lambda x: x / n)).otherwise(a)


def usable(a: Column, dim: int) -> Column:
    return F.coalesce((F.size(a) == dim) & F.forall(a, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def frame_distance(a: Column, b: Column) -> Column:
    """Mean absolute difference over the common prefix; 0 without one."""
    n = F.least(F.size(a), F.size(b))
    total = F.aggregate(F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n), lambda x, y: F.abs(x - y)), F.lit(0.0), lambda s, x: s + x)
    return F.when(n > 0, total / n).otherwise(0.0)


def variance(a: Column) -> Column:
    m = F.aggregate(a, F.lit(0.0), lambda s, x: s + x) / F.size(a)
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + (x - m) * (x - m)) / F.size(a)


def hash_cells(df: DataFrame, key: str, text: str) -> DataFrame:
    """Signed feature hashing of unigrams and bigrams into 256 cells: ``key, cell, weight`` of the non-zero cells.

    The cell is the byte of md5 hex digits 7-8, the sign is + where digit 10 is odd.
    """
    t = tokens(F.col(text))
    pairs = F.when(F.size(t) > 1, F.zip_with(F.slice(t, F.lit(1), F.size(t) - 1), F.slice(t, F.lit(2), F.size(t) - 1), lambda a, b: F.concat(a, F.lit("_"), b))).otherwise(F.array().cast("array<string>"))
    grams = df.select(key, F.explode(F.concat(t, pairs)).alias("gram"))
    h = F.md5("gram")
    cell = F.conv(F.substring(h, 7, 2), 16, 10).cast("int")
    sign = F.when(F.conv(F.substring(h, 10, 1), 16, 10).cast("int") % 2 == 1, 1).otherwise(-1)
    return grams.groupBy(key, cell.alias("cell")).agg(F.sum(sign).alias("weight")).where("weight <> 0")
