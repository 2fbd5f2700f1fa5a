"""Most frequent items with bounded memory: Misra-Gries summaries.

Each task keeps at most ``k`` counters per field.  When there are more, the
``k + 1``-th largest count is subtracted from all and what is not positive goes;
two summaries merge the same way.  Every subtraction of ``c`` takes at least
``(k + 1) * c`` of the total weight, so no count is too low by more than
``n / (k + 1)``, and every item above that frequency has a counter in the end.
Summaries merge in a tree, so no task ever holds more than ``fan_in * k``
counters.

Defined results: null items are not counted (filter empties before); fields with
no item give no rows; repeated rows count each time; ties at the subtracted count
are all dropped and stay within the error, which is part of the result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from decimal import Decimal

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lockstep.session import cut

_STATE = "bucket bigint, field string, item string, count bigint, n bigint, error bigint"
_NAMES = ["bucket", "field", "item", "count", "n", "error"]
_KINDS = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64()]


def reduce_counters(counters: Counter, k: int) -> int:
    """Bring ``counters`` to ``k`` entries; returns what was subtracted from each."""
    if len(counters) <= k:
        return 0
    cutoff = sorted(counters.values(), reverse=True)[k]
    kept = {item: n - cutoff for item, n in counters.items() if n > cutoff}
    counters.clear()
    counters.update(kept)
    return cutoff


def _rows(bucket: int, states: dict[str, tuple[Counter, int, int]]) -> pa.RecordBatch:
    out = []
    for field, (counters, n, error) in states.items():
        out.append((bucket, field, None, 0, n, error))
        out += [(bucket, field, item, count, 0, 0) for item, count in counters.items()]
    columns = list(zip(*out)) if out else [[] for _ in _NAMES]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _KINDS)], names=_NAMES)


def _summarise(k: int):
    slack = 8 * k  # counters between two reductions; the bound of the summary does not hang on it

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        states: dict[str, list] = {}
        for batch in batches:
            fields, items = batch.column(0), batch.column(1)
            for field in pc.unique(fields).to_pylist():
                own = items.filter(pc.equal(fields, field))
                state = states.setdefault(field, [Counter(), 0, 0])
                counted = pc.value_counts(own)
                counters = state[0]
                for item, count in zip(counted.field("values").to_pylist(), counted.field("counts").to_pylist()):
                    counters[item] += count
                state[1] += len(own)
                if len(counters) > slack:
                    state[2] += reduce_counters(counters, k)
        for state in states.values():
            state[2] += reduce_counters(state[0], k)
        yield _rows(TaskContext.get().partitionId(), {f: tuple(s) for f, s in states.items()})

    return run


def _merge(k: int):
    def run(key: tuple, states: pa.Table) -> pa.Table:
        bucket, field = key[0].as_py(), key[1].as_py()
        counters: Counter = Counter()
        for item, count in zip(states.column("item").to_pylist(), states.column("count").to_pylist()):
            if item is not None:
                counters[item] += count
        n, error = pc.sum(states.column("n")).as_py(), pc.sum(states.column("error")).as_py()
        error += reduce_counters(counters, k)
        return pa.Table.from_batches([_rows(bucket, {field: (counters, n, error)})])

    return run


def misra_gries(items: DataFrame, k: int = 1000, fan_in: int = 32, tasks: int | None = None) -> DataFrame:
    """Summaries of ``items(field, item)``: rows ``(field, item, count, upper, n)``.

    ``count`` never exceeds the true count and ``upper`` never falls below it;
    ``upper - count <= n / (k + 1)``.  ``tasks`` bounds the tasks of ``items`` (by
    default it is read off its plan); it sets the number of merge rounds.
    """
    tasks = tasks or items.rdd.getNumPartitions()
    width = 1
    while width * fan_in < tasks:
        width *= fan_in
    states = items.select("field", "item").filter("field is not null and item is not null").mapInArrow(_summarise(k), _STATE)
    while True:
        states = states.withColumn("bucket", F.pmod("bucket", F.lit(width)))
        states = states.groupBy("bucket", "field").applyInArrow(_merge(k), _STATE)
        if width == 1:
            break
        width //= fan_in
    head = states.filter("item is null").select("field", F.col("n"), F.col("error"))
    # one row per field: the fields are columns of a table, a handful
    rows = states.filter("item is not null").select("field", "item", "count").join(head, "field")
    return rows.select("field", "item", "count", (F.col("count") + F.col("error")).alias("upper"), "n")


def frequent_items(items: DataFrame, support: float = 0.01, k: int = 1000, fan_in: int = 32) -> DataFrame:
    """All items with at least ``support`` of their field's items: ``(field, item, count, upper, n, exact)``.

    The summary gives the candidates; it misses none, as ``k`` must exceed
    ``1 / support``.  A second scan counts them exactly.  At most
    ``1 / (support - 1 / (k + 1))`` candidates per field exist; they are written, so
    that the engine knows their size and broadcasts them unless fields are very many.
    """
    if k * support <= 1:
        raise ValueError("k must exceed 1 / support")
    share = F.lit(Decimal(str(support)))
    summary = misra_gries(items, k, fan_in)
    candidates = cut(summary.filter(F.col("upper") >= F.col("n") * share), "candidates")
    counted = items.join(candidates, ["field", "item"]).groupBy("field", "item", "count", "upper", "n").agg(F.count("*").alias("exact"))
    return counted.filter(F.col("exact") >= F.col("n") * share)
