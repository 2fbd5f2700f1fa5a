"""Concentration weights of pairs: how much of an object's activity falls into the pair's buckets.

One rule serves all variants; a variant is a bucket expression, plus whether the
bucket of the next day counts too.  Popularity is counted only in buckets and on
objects that are synchronised for some pair, which is part of the definition.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lockstep.functions.columns import day_bucket, half_day_bucket
from lockstep.operators.coaction import coactions
from lockstep.session import cut


@dataclass(frozen=True)
class Buckets:
    """A variant of the weights."""

    of: Callable[[Column], Column]
    next_day: bool = False


VARIANTS = {"1day": Buckets(day_bucket), "2days": Buckets(day_bucket, next_day=True), "12h": Buckets(half_day_bucket)}


def weighted_pairs(events: DataFrame, variant: str = "1day", window_sec: float = 60, min_coactions: int = 1) -> DataFrame:
    """``(u1, u2, score)``: sum over a pair's buckets and objects of the share of the object's events in the bucket.

    A co-action over two buckets takes the mean of both.  ``min_coactions`` bounds
    the pair's distinct (buckets, object) combinations.  Weights of 0 are dropped.
    Bootstrap replicates (objects that are ``(iter, id)``) have their own buckets each.
    """
    rule = VARIANTS[variant]
    bucketed = events.select("account", "object", "ts").withColumn("b", rule.of(F.col("ts")))
    support = cut(coactions(events, window_sec, rule.of(F.col("ts"))).select("u1", "u2", "object", "b0", "b1").distinct(), "support")
    if min_coactions > 1:
        enough = support.groupBy("u1", "u2").count().filter(F.col("count") >= min_coactions)
        support = support.join(enough.select("u1", "u2"), ["u1", "u2"], "left_semi")
    part = (F.col("object.iter") if isinstance(events.schema["object"].dataType, StructType) else F.lit(0)).alias("part")
    buckets = support.select(part, F.explode(F.array("b0", "b1")).alias("b")).distinct()
    objects = support.select("object").distinct()
    counted = bucketed.join(objects, "object", "left_semi")
    totals = counted.groupBy("object").agg(F.count("*").alias("total"))
    popularity = counted.groupBy("object", "b").agg(F.count("*").alias("n")).select("*", part).join(buckets, ["part", "b"], "left_semi")
    popularity = popularity.select("object", "b", "n")
    looked = support.join(totals, "object")
    probes = {"p0": F.col("b0"), "p1": F.col("b1")}
    if rule.next_day:
        probes |= {"q0": F.col("b0") + F.expr("interval 1 day"), "q1": F.col("b1") + F.expr("interval 1 day")}
    for name, at in probes.items():
        looked = looked.withColumn("_b", at).join(popularity.select("object", F.col("b").alias("_b"), F.col("n").alias(name)), ["object", "_b"], "left").drop("_b")
    share = sum((F.coalesce(F.col(n), F.lit(0)) for n in probes), F.lit(0)) / (F.lit(2.0) * F.col("total"))
    scored = looked.groupBy("u1", "u2").agg(F.round(F.sum(share), 9).alias("score"))
    return scored.filter(F.col("score") > 0)
