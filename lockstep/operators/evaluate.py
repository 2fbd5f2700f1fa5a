"""Rankings against labels: curves, areas, AUC, average precision, NDCG and counts.

Everything is computed from tie groups ``(grp, n, ios, before, ios_before)``, one
row per group, whose running sums are made in blocks of places.  Metrics are one-row
tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Places of a ranking that are summed in one task.
BLOCK = 1 << 16


def labelled(ranking: DataFrame, io: DataFrame) -> DataFrame:
    """``ranking`` with ``is_io``; accounts without label are not IO."""
    flags = io.select("account").distinct().withColumn("is_io", F.lit(True))
    return ranking.join(flags, "account", "left").withColumn("is_io", F.coalesce("is_io", F.lit(False)))


def groups(ranked: DataFrame, x_max: int | None = None) -> DataFrame:
    """Tie groups of a labelled ranking, cut to the first ``x_max`` users, with sums of the groups before."""
    rows = ranked if x_max is None else ranked.filter(F.col("pos") <= x_max)
    per = rows.groupBy("grp").agg(F.count("*").alias("n"), F.count_if("is_io").alias("ios"), (F.min("pos") - 1).alias("before"))
    # sums run inside blocks of places; the blocks before, a few rows, shift them
    per = per.withColumn("block", F.floor(F.col("before") / BLOCK))
    earlier = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    shift = F.coalesce(F.sum("s").over(earlier(Window.orderBy("block"))), F.lit(0))
    blocks = per.groupBy("block").agg(F.sum("ios").alias("s")).select("block", shift.alias("shift"))
    inside = F.coalesce(F.sum("ios").over(earlier(Window.partitionBy("block").orderBy("grp"))), F.lit(0))
    joined = per.join(F.broadcast(blocks), "block")  # one row per 65,536 users
    return joined.select("grp", "n", "ios", "before", (inside + F.col("shift")).alias("ios_before"))


def detection_curve(ranked: DataFrame) -> DataFrame:
    """``(x, y)``: IO accounts found after x users, linear inside tie groups, from (0, 0)."""
    steps = groups(ranked).select("n", "ios", "before", "ios_before", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("i"))
    points = steps.select((F.col("before") + F.col("i")).alias("x"), F.round(F.col("ios_before") + F.col("ios") * F.col("i") / F.col("n"), 9).alias("y"))
    start = ranked.sparkSession.range(1).select(F.lit(0).cast("long").alias("x"), F.lit(0.0).alias("y"))
    return points.unionByName(start)


def curve_difference(first: DataFrame, second: DataFrame) -> DataFrame:
    """One row: sum of ``y1 - y2`` over common x, and of its negative part; the longer curve is cut."""
    gap = first.alias("a").join(second.alias("b"), "x").select((F.col("a.y") - F.col("b.y")).alias("d"))
    total = lambda c: F.round(F.coalesce(F.sum(c), F.lit(0.0)), 6)
    return gap.agg(total(F.col("d")).alias("area"), total(F.least(F.lit(0.0), F.col("d"))).alias("negative_area"))


def ideal_curve(curve: DataFrame, n_io: int | Column) -> DataFrame:
    """The curve of a ranking with all IO accounts first."""
    top = n_io if isinstance(n_io, Column) else F.lit(n_io)
    return curve.select("x", F.least(F.col("x"), top).cast("double").alias("y"))


def io_until_first_other(ranked: DataFrame) -> DataFrame:
    """One row: users in the leading groups that are IO throughout."""
    per = ranked.groupBy("grp").agg(F.count("*").alias("n"), F.count_if(~F.col("is_io")).alias("others"))
    first = per.filter("others > 0").agg(F.min("grp").alias("stop"))
    kept = per.crossJoin(F.broadcast(first)).filter(F.col("stop").isNull() | (F.col("grp") < F.col("stop")))  # one-row table
    return kept.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("value"))


def users_to_fraction(ranked: DataFrame, fraction: float = 0.9) -> DataFrame:
    """One row: users to study until ``ceil(fraction * IO in the ranking)`` are found; 0 without IO accounts."""
    per = groups(ranked)
    total = per.agg(F.ceil(F.sum("ios") * F.lit(float(fraction)) - 1e-9).alias("target"))
    crossing = per.crossJoin(F.broadcast(total)).filter((F.col("ios_before") < F.col("target")) & (F.col("ios_before") + F.col("ios") >= F.col("target")))  # one-row table
    inside = F.ceil((F.col("target") - F.col("ios_before")) * F.col("n") / F.col("ios") - 1e-9)
    return crossing.agg(F.coalesce(F.min(F.col("before") + inside), F.lit(0)).cast("long").alias("value"))


def precision_at(ranked: DataFrame, k: int = 100) -> DataFrame:
    """One row: IO accounts among the first ``k`` users over ``k``; 0 for ``k`` below 1."""
    found = F.count_if(F.col("is_io") & (F.col("pos") <= k))
    return ranked.agg((found / F.lit(float(k)) if k > 0 else F.lit(0.0)).alias("value"))


def total_accounts(ranked: DataFrame) -> DataFrame:
    return ranked.select("account").distinct().agg(F.count("account").alias("value"))


def total_io(ranked: DataFrame) -> DataFrame:
    return total_accounts(ranked.filter("is_io"))


def roc_auc(ranked: DataFrame, x_max: int | None = None) -> DataFrame:
    """One row: area under the ROC curve with ties; 0 unless both classes occur."""
    per = groups(ranked, x_max)
    others = F.col("n") - F.col("ios")
    below = F.sum(F.col("ios") * (F.col("before") - F.col("ios_before") + others / 2.0))
    sums = per.agg(below.alias("lost"), F.sum("ios").alias("p"), F.sum(others).alias("q"))
    return sums.select(F.when((F.col("p") > 0) & (F.col("q") > 0), F.round(1 - F.col("lost") / (F.col("p") * F.col("q")), 9)).otherwise(0.0).alias("value"))


def average_precision(ranked: DataFrame, x_max: int | None = None) -> DataFrame:
    """One row: step-wise average precision, each tie group one threshold; 0 without IO accounts."""
    per = groups(ranked, x_max)
    step = F.col("ios") * (F.col("ios_before") + F.col("ios")) / (F.col("before") + F.col("n"))
    return per.agg(F.round(F.coalesce(F.sum(step) / F.expr("nullif(sum(ios), 0)"), F.lit(0.0)), 9).alias("value"))


def ndcg(ranked: DataFrame, x_max: int | None = None) -> DataFrame:
    """One row: NDCG with gains averaged over ties; 0 for fewer than two users or no IO account."""
    rows = ranked if x_max is None else ranked.filter(F.col("pos") <= x_max)
    discount = 1 / F.log2(F.col("pos") + 1.0)
    per = rows.groupBy("grp").agg(F.count("*").alias("n"), F.count_if("is_io").alias("ios"), F.sum(discount).alias("d"))
    gained = per.agg(F.sum(F.col("ios") * F.col("d") / F.col("n")).alias("dcg"), F.sum("ios").alias("p"), F.sum("n").alias("users"))
    # the ideal gain needs the discounts of the first p places only
    best = rows.crossJoin(F.broadcast(gained.select("p"))).filter(F.col("pos") <= F.col("p")).agg(F.sum(discount).alias("best"))  # one-row table
    both = gained.crossJoin(best)
    return both.select(F.when((F.col("users") >= 2) & (F.col("p") > 0), F.round(F.col("dcg") / F.col("best"), 9)).otherwise(0.0).alias("value"))


METRICS: dict[str, Callable[..., DataFrame]] = {"auc": roc_auc, "ap": average_precision, "ndcg": ndcg}


def metric(name: str, ranked: DataFrame, x_max: int | None = None) -> DataFrame:
    """Metric by name, case ignored."""
    if name.lower() not in METRICS:
        raise ValueError(f"unknown metric {name!r}; one of {sorted(METRICS)}")
    return METRICS[name.lower()](ranked, x_max)


def common_x_max(*rankings: DataFrame) -> int:
    """The least number of ranked users over methods."""
    return min(r.select("account").distinct().count() for r in rankings)


def method_ranks(scores: DataFrame) -> DataFrame:
    """Competition ranks (1, 2, 2, 4) of methods per dataset and metric, best score first.

    ``scores(dataset, metric, method, score)``; scores equal to 10 decimals tie.
    The window holds the methods of one dataset.
    """
    by = Window.partitionBy("dataset", "metric").orderBy(F.round("score", 10).desc())
    return scores.withColumn("rank", F.rank().over(by).cast("long"))
