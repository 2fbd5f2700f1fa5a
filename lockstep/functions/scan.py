"""Global order without a single task: running numbers and sums over range partitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lockstep.session import cut


def prefix_scan(df: DataFrame, order: list[Column], number: str = "row", sums: dict[str, str] | None = None) -> DataFrame:
    """``df`` with its 1-based place in ``order`` and running sums.

    ``sums`` maps new columns to the columns they add up, the row itself included.
    Rows are range-partitioned and written once, as range bounds come from a
    sample; each range is numbered by itself and shifted by the totals of the
    ranges before, one row per range.  ``order`` should be total; ties get any
    order.
    """
    sums = sums or {}
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = cut(df.repartitionByRange(parts, *order).withColumn("_range", F.spark_partition_id()), "ranged")
    totals = ranged.groupBy("_range").agg(F.count("*").alias("_n"), *[F.sum(c).alias(f"_s_{n}") for n, c in sums.items()])
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    shift = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0))
    offsets = totals.select("_range", shift("_n").alias("_o_row"), *[shift(f"_s_{n}").alias(f"_o_{n}") for n in sums])
    inside = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    place = (F.row_number().over(Window.partitionBy("_range").orderBy(*order)) + F.col("_o_row")).cast("long")
    # as many offsets as ranges
    joined = ranged.join(F.broadcast(offsets), "_range")
    out = joined.select("*", place.alias(number), *[(F.sum(c).over(inside) + F.col(f"_o_{n}")).alias(n) for n, c in sums.items()])
    return out.select(*df.columns, number, *sums)


def dense_index(values: DataFrame, column: str, index: str = "idx", descending: bool = False) -> DataFrame:
    """Distinct ``column`` values with their 0-based place."""
    order = F.col(column).desc() if descending else F.col(column).asc()
    return prefix_scan(values.select(column).distinct(), [order], index).withColumn(index, F.col(index) - 1)


def rank_scan(df: DataFrame, key: Column, tie: str) -> DataFrame:
    """``df`` with ``grp``, the 0-based place of ``key`` among its distinct values, and ``pos``, the 1-based place by key and ``tie``.

    One scan over ranges: each is ranked by itself, and shifted by the rows and
    distinct keys of the ranges before; a key that runs on from the range before
    counts once.  ``key`` is not null.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed = df.withColumn("_k", key)
    ranged = cut(keyed.repartitionByRange(parts, "_k", tie).withColumn("_range", F.spark_partition_id()), "ranked")
    per = ranged.groupBy("_range").agg(F.count("*").alias("_n"), F.count_distinct("_k").alias("_d"), F.min("_k").alias("_lo"), F.max("_k").alias("_hi"))
    in_order = Window.orderBy("_range")
    runs_on = F.coalesce((F.lag("_hi").over(in_order) == F.col("_lo")).cast("long"), F.lit(0))
    before = in_order.rowsBetween(Window.unboundedPreceding, -1)
    total = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0))
    per = per.withColumn("_on", runs_on)
    offsets = per.select("_range", total("_n").alias("_rows"), (total(F.col("_d") - F.col("_on")) - F.col("_on")).alias("_keys"))
    place = F.row_number().over(Window.partitionBy("_range").orderBy("_k", tie)) + F.col("_rows")
    group = F.dense_rank().over(Window.partitionBy("_range").orderBy("_k")) - 1 + F.col("_keys")
    # as many offsets as ranges
    joined = ranged.join(F.broadcast(offsets), "_range")
    return joined.select(*df.columns, group.cast("long").alias("grp"), place.cast("long").alias("pos"))
