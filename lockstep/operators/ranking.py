"""Pair scores to user scores, and user scores to tie-aware rankings.

A ranking is flat: ``(account, score, grp, pos)``; ``grp`` counts tie groups from
0, best first, ``pos`` counts users from 1, ids ascending inside a group.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lockstep.functions.scan import rank_scan

_POWER = re.compile(r"L(\d+)")


def ranking_power(mode: str) -> int | None:
    """X of a mode ``LX`` with X of 3 or more, else None."""
    found = _POWER.fullmatch(mode)
    return int(found[1]) if found and int(found[1]) >= 3 else None


def valid_mode(mode: object) -> bool:
    return isinstance(mode, str) and (mode in ("max", "L1", "L2", "Linf") or ranking_power(mode) is not None)


def power_centre(values: np.ndarray, power: int, counts: np.ndarray | None = None) -> float:
    """The point with the least sum of ``power``-th powers of distances, to 2 decimals.

    ``counts`` says how often each value occurs.

    The derivative of that sum grows monotonically, so its zero is found by
    bisection; values are scaled to keep high powers finite.
    """
    lo, hi = float(values.min()), float(values.max())
    width = hi - lo
    if width == 0:
        return round(lo, 2)
    unit = (values - lo) / width
    a, b = 0.0, 1.0
    for _ in range(200):
        mid = (a + b) / 2
        gap = mid - unit
        slope = np.sign(gap) * np.abs(gap) ** (power - 1)
        if (slope if counts is None else slope * counts).sum() < 0:
            a = mid
        else:
            b = mid
    return round(lo + width * (a + b) / 2, 2)


def _aggregate(mode: str) -> Column:
    s = F.col("score")
    if mode == "max":
        return F.max(s)
    if mode == "L1":
        return F.percentile(s, F.lit(0.5))
    if mode == "L2":
        return F.avg(s)
    return (F.min(s) + F.max(s)) / 2


def user_scores(pairs: DataFrame, mode: str = "Linf") -> DataFrame:
    """``(account, score)`` over the non-zero scores of a user's pairs.

    Modes: ``max``, ``L1`` median, ``L2`` mean, ``Linf`` midrange, ``LX`` the
    centre of the X-th power (to 2 decimals, but a single pair's score as it is).
    Rounded to 9 decimals so that ties do not hang on the order of addition.
    """
    return end_scores(pairs.select(F.explode(F.array("u1", "u2")).alias("account"), "score"), mode)


def end_scores(ends: DataFrame, mode: str) -> DataFrame:
    """As :func:`user_scores`, of ``ends(account, score)``, a row per account and pair."""
    if not valid_mode(mode):
        raise ValueError(f"unknown ranking mode {mode!r}")
    ends = ends.filter(F.col("score") != 0).select("account", F.col("score").cast("double").alias("score"))
    power = ranking_power(mode)
    if power is None:
        return ends.groupBy("account").agg(F.round(_aggregate(mode), 9).alias("score"))
    # equal scores are folded first, so a hub with many pairs sends few rows
    folded = ends.groupBy("account", "score").agg(F.count("*").alias("n"))

    def centre(scores: pd.Series, counts: pd.Series) -> float:
        if counts.sum() == 1:
            return float(scores.iloc[0])
        return power_centre(scores.to_numpy(float), power, counts.to_numpy(float))

    udf = F.pandas_udf(centre, "double")
    return folded.groupBy("account").agg(udf(F.col("score"), F.col("n")).alias("score"))


def rank_users(scores: DataFrame) -> DataFrame:
    """Ranking of ``(account, score)``, best score first."""
    return rank_scan(scores.select("account", "score"), F.lit(0.0) - F.col("score"), "account")


def legacy_ranking(pairs: DataFrame) -> DataFrame:
    """Ranking by a user's best pair, zero scores included."""
    ends = pairs.select(F.explode(F.array("u1", "u2")).alias("account"), "score")
    return rank_users(ends.groupBy("account").agg(F.max("score").cast("double").alias("score")))


def refine(primary: DataFrame, *refiners: DataFrame) -> DataFrame:
    """Lexicographic refinement: groups of ``primary`` split by the groups of each refiner in turn.

    Users a refiner does not rank come last; an empty refiner changes nothing; an
    empty primary gives an empty ranking.
    """
    joined = primary.select("account", F.col("grp").alias("g0"))
    for i, other in enumerate(refiners, 1):
        joined = joined.join(other.select("account", F.col("grp").alias(f"g{i}")), "account", "left")
    last = F.lit((1 << 63) - 1)
    key = F.struct(*[F.coalesce(F.col(f"g{i}").cast("long"), last).alias(f"g{i}") for i in range(len(refiners) + 1)])
    return rank_scan(joined, key, "account").select("account", "grp", "pos")
