"""Values of the rows before and behind, in order within a group, without a task that holds a whole group.

A group's rows are cut into chunks that follow the order (by time, or by number); windows run within a chunk, and a summary of one row per
chunk carries what crosses its edges: the last value, the next one, a running sum or maximum. The windows, and the join with the
summaries, share one exchange by group and chunk.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Seconds of a chunk in time.
CHUNK_S = 900.0


class Ordered:
    """Rows of ``group`` (not null) in the order of ``order``; ``chunk``: a non-decreasing function of the order, not null."""

    def __init__(self, df: DataFrame, group: str, order: list[str], chunk: Column | None = None):
        self.group, self.order = group, order
        self.df = df.withColumn("_c", F.floor(F.col(order[0]) / CHUNK_S) if chunk is None else chunk)

    def _inside(self):
        return Window.partitionBy(self.group, "_c").orderBy(*self.order)

    def _among(self):
        return Window.partitionBy(self.group).orderBy("_c")

    def with_carried(self, summaries: dict[str, Column], carried: dict[str, Column], values: dict[str, Column]) -> "Ordered":
        """Several values by one join: ``summaries`` of a chunk, what of them is ``carried`` into the next ones, ``values`` that use it."""
        s = self.df.groupBy(self.group, "_c").agg(*[v.alias(k) for k, v in summaries.items()])
        for name, value in carried.items():
            s = s.withColumn(name, value)
        self.df = self.df.join(s.select(self.group, "_c", *carried), [self.group, "_c"])
        for name, value in values.items():
            self.df = self.df.withColumn(name, value)
        self.df = self.df.drop(*carried)
        return self

    def _with(self, summary: Column, carried: Column, name: str, value: Column) -> "Ordered":
        """Adds ``name``: ``value``, which may use ``_in``, what is carried into the row's chunk."""
        return self.with_carried({"_s": summary}, {"_in": carried}, {name: value})

    def lag(self, name: str, value: Column) -> "Ordered":
        v = F.struct(value.alias("v"))
        return self._with(F.max_by(v, F.struct(*self.order)), F.lag("_s").over(self._among()), name, F.coalesce(F.lag(v).over(self._inside()), F.col("_in"))["v"])

    def lead(self, name: str, value: Column) -> "Ordered":
        v = F.struct(value.alias("v"))
        return self._with(F.min_by(v, F.struct(*self.order)), F.lead("_s").over(self._among()), name, F.coalesce(F.lead(v).over(self._inside()), F.col("_in"))["v"])

    def running_sum(self, name: str, value: Column) -> "Ordered":
        before = F.sum("_s").over(self._among().rowsBetween(Window.unboundedPreceding, -1))
        own = F.sum(value).over(self._inside().rowsBetween(Window.unboundedPreceding, 0))
        return self._with(F.sum(value), F.coalesce(before, F.lit(0)), name, own + F.col("_in"))

    def running_max(self, name: str, value: Column) -> "Ordered":
        """Of all rows up to this one, those with the same first order column included."""
        before = F.max("_s").over(self._among().rowsBetween(Window.unboundedPreceding, -1))
        own = F.max(value).over(Window.partitionBy(self.group, "_c").orderBy(self.order[0]).rangeBetween(Window.unboundedPreceding, 0))
        return self._with(F.max(value), before, name, F.greatest(own, F.col("_in")))

    def last_known(self, name: str, value: Column, known: Column, until: int = 0) -> "Ordered":
        """The last ``value`` of a row for which ``known`` holds, up to this row (``until`` 0) or the one before it (-1)."""
        v = F.when(known, F.struct(value.alias("v")))
        own = F.last(v, ignorenulls=True).over(self._inside().rowsBetween(Window.unboundedPreceding, until))
        before = F.last("_s", ignorenulls=True).over(self._among().rowsBetween(Window.unboundedPreceding, -1))
        return self._with(F.max_by(v, F.when(known, F.struct(*self.order))), before, name, F.coalesce(own, F.col("_in"))["v"])

    def where(self, condition) -> "Ordered":
        self.df = self.df.where(condition)
        return self

    def with_column(self, name: str, value: Column) -> "Ordered":
        self.df = self.df.withColumn(name, value)
        return self

    def rows(self, *gone: str) -> DataFrame:
        return self.df.drop("_c", *gone)
