"""Fuzzy grouping of names: candidates by pieces they must share and an equality join, an exact ratio on the candidates, greedy first fit."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from tidemark.operators.clustering import first_fit_pairs


@F.pandas_udf(DoubleType())
def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Twice the matching characters over all characters, as sequence matching finds them."""
    return pd.Series([SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b)])


def _pieces(name: str, floor: float) -> tuple[list[str], list[str]]:
    """Pieces of which a similar longer or equal name has one intact, and the pieces of all lengths that shorter names may ask for."""
    n = len(name)
    # A ratio of at least ``floor`` with a name of up to n / floor * (2 - floor) letters leaves so many unmatched letters.
    slips = int((1 - floor) * (n + n * (2 - floor) / floor) + 1e-9)
    parts = min(slips + 1, n)
    cuts = [round(i * n / parts) for i in range(parts + 1)]
    own = [name[a:b] for a, b in zip(cuts, cuts[1:])]
    # Names that are shorter or equal, down to n * floor / (2 - floor) letters, have pieces of these lengths.
    sizes = set()
    for m in range(max(1, int(n * floor / (2 - floor))), n + 1):
        p = min(int((1 - floor) * (m + m * (2 - floor) / floor) + 1e-9) + 1, m)
        sizes |= {m // p, -(-m // p)}
    return own, sorted({name[i : i + k] for k in sizes for i in range(n - k + 1)})


def fuzzy_names(names: DataFrame, column: str, floor: float = 0.9) -> DataFrame:
    """``name, canonical``: every distinct non-blank name with its group's first name, in order of names.

    Greedy first fit: a name joins the first group whose first name it resembles with a ratio of at least ``floor``, else it opens one.
    No similar pair is lost: of the pieces of the shorter name, one more than letters can be unmatched, one stands intact in the longer.
    """
    d = names.select(F.trim(column).alias("name")).where("name <> ''").distinct()
    both = "array<string>"

    @F.pandas_udf(f"struct<own:{both},all:{both}>")
    def pieces(s: pd.Series) -> pd.DataFrame:
        got = [_pieces(x, floor) for x in s]
        return pd.DataFrame({"own": [g[0] for g in got], "all": [g[1] for g in got]})

    p = d.withColumn("p", pieces("name"))
    short = p.select(F.col("name").alias("a"), F.explode(F.array_distinct("p.own")).alias("piece"))
    long = p.select(F.col("name").alias("b"), F.explode("p.all").alias("piece"))
    pairs = short.join(long, "piece").where((F.col("a") != F.col("b")) & (F.length("a") <= F.length("b"))).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    similar = pairs.where(ratio("a", "b") >= floor)
    return first_fit_pairs(d.withColumnRenamed("name", "key"), similar).select(F.col("key").alias("name"), F.col("leader").alias("canonical"))
