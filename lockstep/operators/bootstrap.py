"""User bootstrap with the replicate as a column: one job instead of one per replicate."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lockstep.functions.columns import once
from lockstep.functions.scan import dense_index
from lockstep.operators.ranking import end_scores
from lockstep.session import cut

_M = 2_147_483_647


def _drawn(draws: DataFrame, seed: int, n: int) -> DataFrame:
    """``draws(iter, draw)`` with ``idx``, a pseudo-random place below ``n``; integer arithmetic only, so any engine gives the same.

    Each step is one projection, which the optimizer must not write out at every use.
    """
    x = (F.col("iter") * 1_000_003 + F.col("draw") * 7_919 + F.lit(seed) * 104_729 + 12_345) % _M
    steps = draws.select("iter", once(x).alias("x"))
    for multiplier in (48_271, 69_621, 39_373):
        x = F.col("x")
        steps = steps.select("iter", once(((x * x) % _M * multiplier + x + 11) % _M).alias("x"))  # the square keeps draws from being spread evenly
    return steps.select("iter", once(F.col("x") % n).alias("idx"))


#: Replicates in a word of bits.
_WORD = 64


def inclusion_bits(spark: SparkSession, n: int, iterations: int, seed: int = 42, only: DataFrame | None = None) -> DataFrame:
    """``(idx, word, bits)``: the replicates, as bits of words of 64, in which ``n`` draws of ``n`` with replacement hit a place.

    Draws of a replicate lie together, so tasks combine theirs first and send a few
    words per place.  ``only(idx)`` are the places asked for.
    """
    draws = spark.range(iterations * n).select(F.expr(f"id div {max(n, 1)}").alias("iter"), (F.col("id") % max(n, 1)).alias("draw"))
    drawn = _drawn(draws, seed, max(n, 1))
    bit = F.expr(f"shiftleft(1L, cast(iter % {_WORD} as int))")
    words = drawn.groupBy("idx", F.expr(f"cast(iter div {_WORD} as int)").alias("word")).agg(F.bit_or(bit).alias("bits"))
    return words if only is None else words.join(only, "idx", "left_semi")


def unpack(bits: DataFrame) -> DataFrame:
    """``iter`` in place of ``word`` and ``bits``, a row per replicate."""
    places = F.explode(F.array(*[F.lit(i) for i in range(_WORD)])).alias("_i")
    rows = bits.select("*", places).filter(F.expr("shiftright(bits, _i) & 1L") == 1)
    return rows.withColumn("iter", (F.col("word") * _WORD + F.col("_i")).cast("long")).drop("word", "bits", "_i")


def inclusion(accounts: DataFrame, iterations: int, seed: int = 42) -> DataFrame:
    """``(iter, account)``: the distinct accounts of ``n`` draws of ``n`` with replacement, per replicate."""
    places = dense_index(accounts.select("account"), "account")
    drawn = unpack(inclusion_bits(accounts.sparkSession, places.count(), iterations, seed))
    return drawn.join(places, "idx").select("iter", "account")


def replicate_scores(counts: DataFrame, bits: DataFrame, mode: str) -> DataFrame:
    """``(account, score)`` of every replicate, ``account`` as ``(iter, id)``, of ``counts(u1, u2, score)`` between places.

    Right for scores that do not hang on other accounts: a pair belongs to a
    replicate exactly if both members do, so their words are intersected.  Midrange
    and maximum ask only whether a score occurs, so equal scores of an account are
    joined before replicates are told apart.
    """
    word = lambda u: bits.select(F.col("idx").alias(u), "word", F.col("bits").alias(f"bits_{u}"))
    both = counts.join(word("u1"), "u1").join(word("u2"), ["u2", "word"])
    both = both.withColumn("bits", F.col("bits_u1").bitwiseAND(F.col("bits_u2"))).filter("bits <> 0")
    ends = both.select(F.explode(F.array("u1", "u2")).alias("id"), F.col("score").cast("double").alias("score"), "word", "bits").filter("score <> 0")
    if mode not in ("max", "Linf"):
        return end_scores(unpack(ends).select(F.struct("iter", "id").alias("account"), "score"), mode)
    ends = cut(ends.groupBy("id", "score", "word").agg(F.bit_or("bits").alias("bits")), "ends")
    # unpacked only where an account's rows lie together, so replicates are never shuffled
    least = F.min("score") if mode == "Linf" else F.max("score")
    scores = unpack(ends.repartition("id")).groupBy("id", "iter").agg(F.round((least + F.max("score")) / 2, 9).alias("score"))
    return scores.select(F.struct("iter", "id").alias("account"), "score")


def replicate_events(events: DataFrame, included: DataFrame) -> DataFrame:
    """Events of every replicate's accounts; ``account`` and ``object`` become ``(iter, id)``.

    Replicates so have no key in common, and whatever is counted per account,
    pair or object is counted within its replicate.
    """
    known = events.filter("account is not null and object is not null and ts is not null").join(included, "account")
    key = lambda c: F.struct("iter", F.col(c).alias("id")).alias(c)
    return known.select(key("account"), key("object"), "ts")


def _places_gain(places: pd.Series) -> pd.Series:
    """Sum of the NDCG discounts of the first so many places."""
    gains = np.concatenate([[0.0], np.cumsum(1 / np.log2(np.arange(int(places.max() if len(places) else 0)) + 2.0))])
    return pd.Series(gains[places.to_numpy(int)])


def replicate_metrics(rankings: DataFrame, io: DataFrame, iterations: int, methods: list[str], stripe: Column | None = None) -> DataFrame:
    """``(metric, method, iter, score)`` of ``rankings(method, iter, account, key)``: AUC, AP and NDCG, the greatest key first.

    Every replicate is cut to the least number of users that a method ranks there;
    a replicate in which some method ranks nobody scores 0.  Tie groups are windowed.
    Of the one group that the cut divides, ids ascending, users are counted by
    ``stripe``, which rises with the id, and windowed only in the stripe that is divided.
    ``rankings`` is read more than once.
    """
    flags = cut(io.select("account").distinct().withColumn("is_io", F.lit(1)), "flags")
    users = rankings.join(flags, "account", "left").withColumn("stripe", F.lit(0).cast("long") if stripe is None else stripe)
    per = cut(users.groupBy("method", "iter", "key").agg(F.count("*").alias("n"), F.count("is_io").alias("ios")), "replicate_groups")
    every = rankings.sparkSession.range(iterations).select(F.col("id").alias("iter"), F.explode(F.array(*[F.lit(m) for m in methods])).alias("method"))
    sizes = every.join(per.groupBy("method", "iter").agg(F.sum("n").alias("users")), ["method", "iter"], "left")
    x_max = sizes.groupBy("iter").agg(F.min(F.coalesce("users", F.lit(0))).alias("x_max"))
    above = Window.partitionBy("method", "iter").orderBy(F.desc("key")).rowsBetween(Window.unboundedPreceding, -1)
    before = lambda c: F.coalesce(F.sum(c).over(above), F.lit(0))
    per = per.withColumns({"before": before("n"), "ios_before": before("ios")}).join(x_max, "iter").filter("before < x_max")
    per = cut(per.withColumn("taken", F.least("n", F.col("x_max") - F.col("before"))), "replicate_cut")
    groups = cut(per.filter("taken < n").select("method", "iter", "key", "taken"), "divided")
    divided = users.join(groups, ["method", "iter", "key"])
    stripes = divided.groupBy("method", "iter", "stripe").agg(F.max("taken").alias("taken"), F.count("*").alias("k"), F.count("is_io").alias("ios"))
    upto = Window.partitionBy("method", "iter").orderBy("stripe").rowsBetween(Window.unboundedPreceding, -1)
    sums = {"left": F.col("taken") - F.coalesce(F.sum("k").over(upto), F.lit(0)), "part": F.coalesce(F.sum("ios").over(upto), F.lit(0))}
    edge = cut(stripes.withColumns(sums).filter("left between 0 and k").groupBy("method", "iter").agg(F.min_by(F.struct("stripe", "left", "part"), "stripe").alias("e")).select("method", "iter", "e.*"), "edge")
    place = F.row_number().over(Window.partitionBy("method", "iter").orderBy("account"))
    at_edge = divided.join(edge, ["method", "iter", "stripe"]).withColumn("place", place).filter("place <= left").groupBy("method", "iter").agg(F.count("is_io").alias("more"))
    inside = edge.join(at_edge, ["method", "iter"], "left").select("method", "iter", (F.col("part") + F.coalesce("more", F.lit(0))).alias("part"))
    per = per.join(inside, ["method", "iter"], "left").withColumn("ios", F.when(F.col("taken") < F.col("n"), F.col("part")).otherwise(F.col("ios")))
    gain = F.pandas_udf(_places_gain, "double")
    end, others = F.col("before") + F.col("taken"), F.col("taken") - F.col("ios")
    per = per.withColumns({"to": gain(end), "from": gain(F.col("before"))})
    sums = per.groupBy("method", "iter").agg(
        F.sum("ios").alias("p"),
        F.sum(others).alias("q"),
        F.sum(F.col("ios") * (F.col("before") - F.col("ios_before") + others / 2.0)).alias("lost"),
        F.sum(F.col("ios") * (F.col("ios_before") + F.col("ios")) / end).alias("steps"),
        F.sum(F.col("ios") * (F.col("to") - F.col("from")) / F.col("taken")).alias("dcg"),
    )
    p, q = F.col("p"), F.col("q")
    auc = F.when((p > 0) & (q > 0), 1 - F.col("lost") / (p * q))
    ndcg = F.when((p > 0) & (p + q >= 2), F.col("dcg") / F.col("best"))
    scored = sums.withColumn("best", gain(p)).select("method", "iter", auc.alias("auc"), F.when(p > 0, F.col("steps") / p).alias("ap"), ndcg.alias("ndcg"))
    scored = every.join(scored, ["method", "iter"], "left")
    rows = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.round(F.coalesce(m, F.lit(0.0)), 9).alias("score")) for m in ("auc", "ap", "ndcg")]))
    return scored.select("method", "iter", rows.alias("r")).select("r.metric", "method", "iter", "r.score")


def percentile_ci(samples: DataFrame, by: list[str], value: str = "score", level: float = 95.0) -> DataFrame:
    """Mean and linearly interpolated percentile interval per group."""
    tail = (100.0 - level) / 200.0
    bounds = F.percentile(value, F.array(F.lit(tail), F.lit(1 - tail)))
    out = samples.groupBy(*by).agg(F.round(F.avg(value), 9).alias("mean"), bounds.alias("b"))
    return out.select(*by, "mean", F.round(F.col("b")[0], 9).alias("lower"), F.round(F.col("b")[1], 9).alias("upper"))


def _quantile(values: str, share: Column) -> Column:
    """Linearly interpolated quantile of a sorted array."""
    place = share * (F.size(values) - 1)
    low = F.floor(place).cast("int")
    return F.get(values, low) + (place - low) * (F.coalesce(F.get(values, low + 1), F.get(values, low)) - F.get(values, low))


def paired_differences(samples: DataFrame, level: float = 95.0) -> DataFrame:
    """Bonferroni intervals of differences between methods: ``(dataset, metric, method_a, method_b, mean, lower, upper, significant)``.

    ``samples(dataset, metric, method, iter, score)``; the level is divided by the
    number of methods of the dataset and metric.
    """
    keys = ["dataset", "metric", "iter"]
    a = samples.select(*keys, F.col("method").alias("method_a"), F.col("score").alias("sa"))
    b = samples.select(*keys, F.col("method").alias("method_b"), F.col("score").alias("sb"))
    methods = samples.groupBy("dataset", "metric").agg(F.countDistinct("method").alias("m"))
    gaps = a.join(b, keys).filter("method_a < method_b").join(methods, ["dataset", "metric"])
    gaps = gaps.withColumn("d", F.col("sa") - F.col("sb"))
    by = ["dataset", "metric", "method_a", "method_b", "m"]
    sorted_gaps = gaps.groupBy(*by).agg(F.round(F.avg("d"), 9).alias("mean"), F.array_sort(F.collect_list("d")).alias("v"))
    tail = F.lit((100.0 - level) / 200.0) / F.col("m")
    out = sorted_gaps.select(*by, "mean", F.round(_quantile("v", tail), 9).alias("lower"), F.round(_quantile("v", 1 - tail), 9).alias("upper"))
    return out.withColumn("significant", (F.col("lower") > 0) | (F.col("upper") < 0)).drop("m")


def difference_whiskers(samples: DataFrame, level: float = 95.0) -> DataFrame:
    """``(dataset, metric, method_a, method_b, low, q1, median, q3, high)``: boxes of the paired differences of all pairs of methods.

    The whiskers are the percentiles of the Bonferroni level of
    :func:`paired_differences`, so a pair differs if zero lies outside them.
    """
    keys = ["dataset", "metric", "iter"]
    side = lambda x: samples.select(*keys, F.col("method").alias(f"method_{x}"), F.col("score").alias(f"s{x}"))
    gaps = side("a").join(side("b"), keys).filter("method_a < method_b").withColumn("d", F.col("sa") - F.col("sb"))
    by = ["dataset", "metric", "method_a", "method_b"]
    methods = samples.groupBy("dataset", "metric").agg(F.count_distinct("method").alias("m"))
    sorted_gaps = gaps.groupBy(*by).agg(F.array_sort(F.collect_list("d")).alias("v")).join(methods, ["dataset", "metric"])
    tail = F.lit((100.0 - level) / 200.0) / F.col("m")
    at = {"low": tail, "q1": F.lit(0.25), "median": F.lit(0.5), "q3": F.lit(0.75), "high": 1 - tail}
    return sorted_gaps.select(*by, *[F.round(_quantile("v", share), 9).alias(name) for name, share in at.items()])
