"""Overlapping and gapped intervals: continuous periods and the gaps between them.

Method: rows are range-sorted over the whole table by entity and start, so one entity may span
many partitions; each partition is summed up in one row (its first key and start, its last key
and the span of that key's last island); the summaries, one per partition, are combined in
order on the driver; each partition is then scanned once with the state carried in from its
left.  No entity is ever gathered in one task, whatever its share of the rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspan.session import cut, partitions

#: Days lie within a few million of day 0, so an entity's days, shifted by this, stay apart.
_APART = 1 << 24

State = tuple[tuple, int, int]  # entity, first and last day of the open island


def _scan(batches: Iterator[pd.DataFrame], names: list[str], state: State | None, found: list | None) -> Iterator[tuple[pd.DataFrame, State | None]]:
    """Yield (closed periods and gaps, state) batch by batch.  Rows come sorted by entity, start."""
    for pdf in batches:
        n = len(pdf)
        if not n:
            continue
        keys = [pdf[c].to_numpy() for c in names]
        s, e = pdf["__s"].to_numpy().astype(np.int64), pdf["__e"].to_numpy().astype(np.int64)
        fresh = np.zeros(n, bool)
        for k in keys:
            fresh[1:] |= k[1:] != k[:-1]
        follows = state is not None and all(k[0] == v for k, v in zip(keys, state[0], strict=True))
        fresh[0] = not follows
        group = np.cumsum(fresh)
        reach = np.maximum.accumulate(e + group * _APART) - group * _APART
        if follows:
            reach[group == 0] = np.maximum(reach[group == 0], state[2])
        before = np.empty(n, np.int64)
        before[1:] = reach[:-1]
        before[0] = state[2] if state else 0
        opens = fresh | (s > before + 1)
        at = np.flatnonzero(opens)
        rows: list[tuple] = []
        if state and len(at):  # the island open on the left closes at the first opening
            rows.append((state[0], "period", state[1], int(reach[at[0] - 1]) if at[0] else state[2]))
        ends = np.append(at[1:] - 1, n - 1)
        entity = lambda i: tuple(k[i] for k in keys)
        for j, i in enumerate(at):
            if not fresh[i]:
                rows.append((entity(i), "gap", int(before[i]) + 1, int(s[i]) - 1))
            if j < len(at) - 1:
                rows.append((entity(i), "period", int(s[i]), int(reach[ends[j]])))
        if len(at):
            state = (entity(at[-1]), int(s[at[-1]]), int(reach[-1]))
        elif state:
            state = (state[0], state[1], int(reach[-1]))
        if found is not None and not found:
            found.append((entity(0), int(s[0])))
        cols = {c: [r[0][i] for r in rows] for i, c in enumerate(names)}
        yield pd.DataFrame(cols | {"span_kind": [r[1] for r in rows], "__s": [r[2] for r in rows], "__e": [r[3] for r in rows]}), state


def merge_intervals(rows: DataFrame, entity: list[str], start: str = "from_day", end: str = "to_day", width: int | None = None) -> DataFrame:
    """Continuous periods and gaps per entity.

    Input: the ``entity`` columns (text; null counts as ``''``) and two DATE columns; both days
    belong to an interval.  Rows that lack a day or end before they start are left out; repeated
    rows change nothing; adjoining days make one period.  Other columns are ignored.
    Output: ``entity..., span_kind`` (``period`` or ``gap``), ``from_date, to_date`` as DATE.
    """
    spark = rows.sparkSession
    width = width or partitions(spark)
    ready = rows.select(
        *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in entity],
        F.unix_date(F.col(start)).alias("__s"),
        F.unix_date(F.col(end)).alias("__e"),
    ).filter("__s is not null and __e is not null and __s <= __e")
    # repeated rows and equal starts go before the sort: a range never divides equal sort keys
    ready = ready.groupBy(*entity, "__s").agg(F.max("__e").alias("__e"))
    ordered = cut(ready.repartitionByRange(width, *entity, "__s").sortWithinPartitions(*entity, "__s"))
    names = list(entity)

    def summed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        first: list = []
        state: State | None = None
        for _, state in _scan(batches, names, None, first):
            pass
        if state:
            (key, day), (last, s, e) = first[0], state
            yield pd.DataFrame([{"pid": TaskContext.get().partitionId(), "first": list(key), "day": day, "last": list(last), "s": s, "e": e}])

    summaries = sorted(
        ordered.mapInPandas(summed, "pid int, first array<string>, day int, last array<string>, s int, e int").collect(),  # one row per partition
        key=lambda r: r.pid,
    )
    carried: dict[int, State | None] = {}
    hands_on: dict[int, bool] = {}
    state: State | None = None
    for i, r in enumerate(summaries):
        carried[r.pid] = state if state and list(state[0]) == r.first else None
        last = tuple(r.last)
        if carried[r.pid] and state[0] == last:  # the partition holds nothing but the carried entity
            state = (last, state[1] if state[2] + 1 >= r.s else r.s, max(state[2], r.e))
        else:
            state = (last, r.s, r.e)
        hands_on[r.pid] = i + 1 < len(summaries) and summaries[i + 1].first == r.last

    def rescanned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pid = TaskContext.get().partitionId()
        state = carried.get(pid)
        for out, state in _scan(batches, names, state, None):  # noqa: B020
            if len(out):
                yield out
        if state and not hands_on.get(pid, False):
            yield pd.DataFrame({c: [v] for c, v in zip(names, state[0], strict=True)} | {"span_kind": ["period"], "__s": [state[1]], "__e": [state[2]]})

    schema = ", ".join([f"`{c}` string" for c in names] + ["span_kind string", "__s int", "__e int"])
    return ordered.mapInPandas(rescanned, schema).select(*names, "span_kind", F.date_from_unix_date("__s").alias("from_date"), F.date_from_unix_date("__e").alias("to_date"))
