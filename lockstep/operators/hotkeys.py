"""Per-key results whose time does not hang on the largest key.

States are combined in a tree.  The chunk of a task is folded before anything is
sent (map-side aggregation); then rounds with a fixed fan-in merge states of one
key from ``fan_in`` neighbouring buckets, until one bucket is left.  A reducer
thus never gets more than ``fan_in`` buckets of a key from a round, however many
rows the key has and however many tasks hold a part of it.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def rounds_for(chunks: int, fan_in: int) -> int:
    """Rounds with ``fan_in`` that bring ``chunks`` states to one."""
    if fan_in < 2:
        raise ValueError("fan_in must be 2 or more")
    return max(1, math.ceil(math.log(max(chunks, 2), fan_in) - 1e-9))


def tree_aggregate(df: DataFrame, keys: list[str], merge: dict[str, Column], chunks: int, fan_in: int = 64) -> DataFrame:
    """Merge rows per ``keys`` in rounds of ``fan_in``.

    ``merge`` maps a column to an aggregate over the same column, which must be
    associative and commutative.  The task number is the bucket; ``chunks`` is a
    bound on the tasks of ``df``.  Empty input gives no rows.
    """
    at = df.withColumn("_bucket", F.spark_partition_id())
    for left in range(rounds_for(chunks, fan_in) - 1, 0, -1):
        at = at.withColumn("_bucket", F.pmod(F.col("_bucket"), F.lit(fan_in**left)))
        at = at.groupBy(*keys, "_bucket").agg(*[c.alias(n) for n, c in merge.items()])
    return at.groupBy(*keys).agg(*[c.alias(n) for n, c in merge.items()])


def object_activity(posts: DataFrame, keys: list[str], account: str, time: str, row_id: str, chunks: int, fan_in: int = 64, accounts: bool = True) -> DataFrame:
    """Rows, accounts and first row of each object.

    ``posts`` has the key columns, ``account``, ``time`` (any ordered type, null
    allowed) and ``row_id``; ``chunks`` bounds its tasks.  Result: the keys,
    ``n_rows``, ``n_timed`` (rows of known time), ``n_accounts`` (distinct, null
    accounts left out) and ``first_row_id``: the row of the earliest known time,
    on a tie the smallest id; null if no time is known.  Null keys form a group,
    as in any grouping; callers filter them first.  Further columns are ignored.

    Distinct accounts are exact: rows are first folded per object and account
    (itself a tree, as one account may repeat itself without end), which leaves
    each account of an object in one task; then objects are folded over tasks,
    where each account counts once.  Without ``accounts`` that fold and the column
    are left out, and rows are folded per object at once.
    """
    first = F.when(F.col(time).isNotNull(), F.struct(F.col(time).alias("t"), F.col(row_id).alias("r")))
    rows = posts.select(
        *keys,
        *([F.col(account).alias("_account")] if accounts else []),
        F.lit(1).cast("long").alias("n_rows"),
        F.col(time).isNotNull().cast("long").alias("n_timed"),
        first.alias("_first"),
    )
    fold = {"n_rows": F.sum("n_rows"), "n_timed": F.sum("n_timed"), "_first": F.min("_first")}
    if accounts:
        rows = tree_aggregate(rows, [*keys, "_account"], fold, chunks, fan_in)
        rows = rows.withColumn("n_accounts", F.col("_account").isNotNull().cast("long"))
        fold["n_accounts"] = F.sum("n_accounts")
        chunks = int(posts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    states = tree_aggregate(rows, keys, fold, chunks, fan_in)
    counts = ["n_rows", "n_timed", *(["n_accounts"] if accounts else [])]
    return states.select(*keys, *counts, F.col("_first.r").alias("first_row_id"))
