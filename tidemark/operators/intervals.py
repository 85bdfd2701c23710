"""Merging of overlapping intervals per entity, with the gaps between them.

The rows are range-sorted over the whole cluster by entity and start, so one entity with a third of all rows is spread over
many partitions. Each partition yields one bounded summary (its first row, its last entity's running maximum of ends and the
start of that entity's last island); the summaries, one per partition, are combined in partition order; a second scan of
the partitions starts from the carried state. No entity is ever gathered in one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.session import materialize, shuffle_partitions

SCHEMA = "entity string, kind string, start_at bigint, end_at bigint"


#: Rows of a range partition, about; its summary and rescan hold them in one task.
ROWS = 200_000


def range_sorted(df: DataFrame, keys: list[str], partitions: int | None = None, rows: int = 0) -> DataFrame:
    """``df`` range-partitioned and sorted by ``keys`` over all partitions, checkpointed, with its partition number ``pid``.

    ``rows``: about how many there are, where that is known cheaply; there are then enough partitions to bound each.
    The checkpoint fixes rows and order of every partition, so that two scans see the same ones even if executors are lost.
    """
    n = partitions or shuffle_partitions(df.sparkSession, -(-rows // ROWS))
    return materialize(df.repartitionByRange(n, *keys).sortWithinPartitions(*keys).withColumn("pid", F.spark_partition_id()))


def _islands(e: np.ndarray, s: np.ndarray, t: np.ndarray, state: tuple | None):
    """Splits sorted rows into islands, going on from ``state`` = (entity, maximum end, island start).

    Returns closed periods, gaps (both as entity/start/end arrays) and the new state, whose island is still open.
    """
    head = np.ones(len(e), bool)
    head[1:] = e[1:] != e[:-1]
    carried = state is not None and state[0] == e[0]
    group = np.cumsum(head)
    top = pd.Series(t).groupby(group).cummax().to_numpy()
    if carried:
        top = np.where(group == 1, np.maximum(top, state[1]), top)
    before = np.empty(len(t), np.int64)
    before[1:] = top[:-1]
    known = ~head
    if carried:
        before[0], known[0] = state[1], True
    apart = known & (s > np.where(known, before, 0))
    new = apart | ~known
    gaps = (e[apart], before[apart], s[apart])
    at = np.flatnonzero(new)
    last = np.append(at[1:] - 1, len(e) - 1)
    pe, ps, pt = e[at], s[at], top[last]
    if state is not None:
        if carried and not new[0]:
            k = (at[0] - 1) if len(at) else len(e) - 1
            pe, ps, pt = np.append([state[0]], pe), np.append([state[2]], ps), np.append([top[k]], pt)
        else:
            pe, ps, pt = np.append([state[0]], pe), np.append([state[2]], ps), np.append([state[1]], pt)
    now = (pe[-1], int(pt[-1]), int(ps[-1]))
    return (pe[:-1], ps[:-1], pt[:-1]), gaps, now


def _columns(pdf: pd.DataFrame):
    return pdf["entity"].to_numpy(object), pdf["start_at"].to_numpy(np.int64), pdf["end_at"].to_numpy(np.int64)


def _summarize(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    state, first = None, None
    for pdf in batches:
        if len(pdf):
            e, s, t = _columns(pdf)
            first = first or (int(pdf["pid"].iloc[0]), e[0], int(s[0]), e[-1])
            state = _islands(e, s, t, state)[2]
    if first:
        yield pd.DataFrame([(first[0], first[1], first[2], *state)], columns=["pid", "first_entity", "first_start", "entity", "end_at", "start_at"])


def combine(summaries: list[tuple]) -> dict[int, tuple]:
    """Prefix-combination of the partitions' summaries: pid -> (carried-in state or None, the next partition's first row)."""
    out, state = {}, None
    rows = sorted(summaries)
    for k, (pid, first_entity, _first_start, entity, end, start) in enumerate(rows):
        after = (rows[k + 1][1], rows[k + 1][2]) if k + 1 < len(rows) else None
        out[pid] = (state if state is not None and state[0] == first_entity else None, after)
        if state is not None and state[0] == entity:  # one entity fills the partition: its carried island may cover all of it
            state = (entity, max(end, state[1]), state[2] if state[1] >= start else start)
        else:
            state = (entity, end, start)
    return out


def merge_intervals(df: DataFrame, entity: Column, start: Column, end: Column, partitions: int | None = None) -> DataFrame:
    """Continuous periods and the gaps between them: ``entity, kind ('period'|'gap'), start_at, end_at``.

    ``start`` and ``end`` are integers. Intervals that overlap or touch form one period. Rows with a null entity, start or
    end, or with end <= start, belong to no period. Repeated rows change nothing. An empty input gives an empty result.
    Other columns of ``df`` are ignored, whatever their names.
    """
    rows = df.select(entity.cast("string").alias("entity"), start.cast("bigint").alias("start_at"), end.cast("bigint").alias("end_at"))
    rows = rows.where("entity is not null and end_at > start_at")
    ranged = range_sorted(rows, ["entity", "start_at", "end_at"], partitions, rows.count())
    schema = "pid int, first_entity string, first_start bigint, entity string, end_at bigint, start_at bigint"
    carry = combine([tuple(r) for r in ranged.mapInPandas(_summarize, schema).collect()])  # one row per partition

    def rescan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state, after, begun = None, None, False
        for pdf in batches:
            if not len(pdf):
                continue
            e, s, t = _columns(pdf)
            closed = False
            if not begun:
                state, after = carry[int(pdf["pid"].iloc[0])]
                begun, closed = True, state is not None and s[0] > state[1]
            periods, gaps, state = _islands(e, s, t, state)
            if closed:  # the partition before has given this period
                periods = tuple(x[1:] for x in periods)
            for kind, (e, s, t) in (("period", periods), ("gap", gaps)):
                if len(e):
                    yield pd.DataFrame({"entity": e, "kind": kind, "start_at": s, "end_at": t})
        if state is not None and not (after is not None and after[0] == state[0] and after[1] <= state[1]):
            yield pd.DataFrame({"entity": [state[0]], "kind": "period", "start_at": [state[2]], "end_at": [state[1]]})

    return ranged.mapInPandas(rescan, SCHEMA)
