"""Activity statistics of datasets, by label."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lockstep.operators.coaction import coaction_counts, pair_members
from lockstep.session import cut


def activity(events: DataFrame, io: DataFrame) -> DataFrame:
    """``(is_io, account, n_posts, n_days)``."""
    flags = io.select("account").distinct().withColumn("f", F.lit(True))
    days = events.select("account", F.to_date("ts").alias("day")).groupBy("account", "day").agg(F.count("*").alias("n"))
    per = days.groupBy("account").agg(F.sum("n").alias("n_posts"), F.count("*").alias("n_days"))
    return per.join(flags, "account", "left").select(F.coalesce("f", F.lit(False)).alias("is_io"), "account", "n_posts", "n_days")


def statistics(values: DataFrame, by: list[str], column: str) -> DataFrame:
    """Count, mean, median, population deviation and total per group."""
    r = lambda c: F.round(F.coalesce(c, F.lit(0.0)), 9)
    v = F.col(column).cast("double")
    return values.groupBy(*by).agg(
        F.count(column).alias("count"), r(F.avg(v)).alias("mean"), r(F.percentile(v, F.lit(0.5))).alias("median"), r(F.stddev_pop(v)).alias("std"), r(F.sum(v)).alias("total")
    )


def across_datasets(stats: DataFrame) -> DataFrame:
    """Rows of ``stats(dataset, count, mean, ...)`` plus the mean and deviation of the datasets' means."""
    overall = stats.agg(F.count("*").alias("count"), F.round(F.avg("mean"), 9).alias("mean"), F.round(F.stddev_pop("mean"), 9).alias("std"))
    row = overall.select(F.lit("Across datasets").alias("dataset"), "count", "mean", "std")
    return stats.select("dataset", "count", "mean", "std").unionByName(row)


def counts_by_filter(events: DataFrame, io: DataFrame, window_sec: float = 60) -> DataFrame:
    """Users, IO users and pairs without filter, with one co-action and with two: ``(filter, n_users, n_io, n_pairs)``."""
    flags = io.select("account").distinct().withColumn("f", F.lit(1))

    def row(name: str, users: DataFrame, pairs: DataFrame | None) -> DataFrame:
        seen = users.select("account").distinct().join(flags, "account", "left").agg(F.count("account").alias("n_users"), F.count("f").alias("n_io"))
        n = pairs.agg(F.count("*").alias("n_pairs")) if pairs is not None else events.sparkSession.range(1).select(F.lit(0).cast("long").alias("n_pairs"))
        return seen.crossJoin(n).select(F.lit(name).alias("filter"), "n_users", "n_io", "n_pairs")  # two one-row tables

    out, counts = row("none", events, None), cut(coaction_counts(events, window_sec), "counts")
    for k in (1, 2):
        pairs = counts.filter(F.col("score") >= k)
        out = out.unionByName(row(f"min{k}", pair_members(pairs), pairs))
    return out


def best_mode(scores: DataFrame) -> DataFrame:
    """Mean and population deviation per ranking mode over datasets: ``(mode, place, mean, std, best)``.

    ``place`` orders modes by power, ``Linf`` last and ``max`` after it.
    """
    power = F.coalesce(F.regexp_extract("mode", r"^L(\d+)$", 1).try_cast("double"), F.when(F.col("mode") == "Linf", F.lit(1e9)).otherwise(F.lit(2e9)))
    per = scores.groupBy("mode").agg(F.round(F.avg("score"), 9).alias("mean"), F.round(F.stddev_pop("score"), 9).alias("std"))
    top = per.agg(F.max_by("mode", F.struct("mean", "mode")).alias("top"))
    return per.crossJoin(F.broadcast(top)).select("mode", power.alias("place"), "mean", "std", (F.col("mode") == F.col("top")).alias("best"))  # one-row table
