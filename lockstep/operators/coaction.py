"""Pairs of accounts that act on one object within a time window.

The band join is an equi-join on object and time cell: the earlier event has its
own cell, the later one also offers itself to the cell before.  A viral object is
thus spread over its cells, and adaptive execution can split a cell that is still
too large.  The output is what the definition asks for, one row per close pair of
events; scores combine it before anything is shuffled again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lockstep.functions.columns import MICROS, micros

_PAIR = ["u1", "u2"]


def coactions(events: DataFrame, window_sec: float = 60, bucket: Column | None = None) -> DataFrame:
    """``(u1, u2, object, b0, b1, us_later)`` with ``u1 < u2`` for every close pair of events.

    ``events(account, object, ts)``; the window is inclusive and exact to the
    microsecond.  ``bucket`` is an expression over ``ts``; ``b0`` is that of the
    earlier event.  Events of one account never pair; null accounts, objects and
    times pair with nothing; other columns are ignored.
    """
    width = max(1, round(window_sec * MICROS))
    at = events.select("account", "object", micros(F.col("ts")).alias("us"), (bucket if bucket is not None else F.lit(None).cast("timestamp")).alias("b"))
    at = at.filter("account is not null and object is not null and us is not null")
    cell = F.floor(F.col("us") / F.lit(width))
    early = at.select("object", cell.alias("cell"), F.col("account").alias("a"), F.col("us").alias("us_a"), F.col("b").alias("b0"))
    late = at.select("object", F.explode(F.array(cell, cell - 1)).alias("cell"), F.col("account").alias("c"), F.col("us").alias("us_c"), F.col("b").alias("b1"))
    gap = F.col("us_c") - F.col("us_a")
    close = (F.col("a") != F.col("c")) & ((gap > 0) | ((gap == 0) & (F.col("a") < F.col("c")))) & (gap <= round(window_sec * MICROS))
    met = early.join(late, ["object", "cell"]).filter(close)
    return met.select(F.least("a", "c").alias("u1"), F.greatest("a", "c").alias("u2"), "object", "b0", "b1", F.col("us_c").alias("us_later"))


def coaction_counts(events: DataFrame, window_sec: float = 60, min_coactions: int = 1, unique: bool = False) -> DataFrame:
    """``(u1, u2, score)``: distinct objects of each pair, those with at least ``min_coactions``.

    ``unique`` says that events have one row per account and object, so that a pair
    meets once per object and is counted before anything is shuffled.  Otherwise
    pairs are shuffled once, and their objects told apart where they are counted.
    """
    met = coactions(events, window_sec).select(*_PAIR, "object")
    if not unique:
        met = met.repartition(*_PAIR).distinct()
    return met.groupBy(*_PAIR).agg(F.count("*").alias("score")).filter(F.col("score") >= min_coactions)


def pair_members(pairs: DataFrame) -> DataFrame:
    """Distinct accounts of pairs."""
    return pairs.select(F.explode(F.array("u1", "u2")).alias("account")).distinct()


def top_pairs(pairs: DataFrame, k: int = 5) -> DataFrame:
    """The ``k`` pairs with the greatest score, on a tie those of the smaller accounts; heaps per task, no full sort."""
    return pairs.orderBy(F.desc("score"), "u1", "u2").limit(k)


def pair_difference(first: DataFrame, second: DataFrame) -> DataFrame:
    """``(side, u1, u2, score)``: rows of ``first`` that ``second`` lacks and the reverse, repeated rows counted; empty if both agree."""
    columns = [*_PAIR, "score"]
    one, two = first.select(*columns), second.select(*columns)
    side = lambda df, name: df.select(F.lit(name).alias("side"), "*")
    return side(one.exceptAll(two), "first").unionByName(side(two.exceptAll(one), "second"))


def synchronous_events(events: DataFrame, window_sec: float = 60, min_coactions: int = 1) -> DataFrame:
    """Events of accounts in at least one pair; empty if there is no pair."""
    return events.join(pair_members(coaction_counts(events, window_sec, min_coactions)), "account", "left_semi")


def same_object_days(events: DataFrame, window_sec: float = 60) -> DataFrame:
    """``(u1, u2, n_days)``: distinct days, by the later event, on which a pair acted on one object."""
    day = F.to_date(F.timestamp_micros("us_later"))
    met = coactions(events, window_sec).select("u1", "u2", day.alias("day")).repartition(*_PAIR).distinct()
    return met.groupBy(*_PAIR).agg(F.count("*").alias("n_days"))
