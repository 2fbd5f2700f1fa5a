"""Days on which two accounts act at about the same time, whatever they act on.

A moment of one account is paired with the oldest moment of the other that is still
waiting; a moment waits as long as the window, and a pair uses up both.  The day of
a pair is that of its later moment.

Only moments that lie within the window of some moment of the other account can
pair, so these are all that is looked at: they come from a band join spread over
time cells, one row per close pair of moments, which is what the question is about.
Per pair of accounts they are put in order and cut wherever nothing happened for
longer than a window, as nothing waits across such a gap.  What is held at once is
one stretch of moments without a gap, and within it what still waits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lockstep.functions.columns import MICROS, micros

_DAY = 86_400 * MICROS
_PAIR = ["u1", "u2"]


def _moments(events: DataFrame) -> DataFrame:
    """``(account, object, us)`` of events with account and time."""
    return events.select("account", "object", micros(F.col("ts")).alias("us")).filter("account is not null and us is not null")


def _close(moments: DataFrame, window: int) -> DataFrame:
    """``(u1, us1, o1, u2, us2, o2)`` with ``u1 < u2`` of moments at most ``window`` apart."""
    cell = F.floor(F.col("us") / max(1, window))
    early = moments.select(cell.alias("cell"), F.col("account").alias("a"), F.col("us").alias("us_a"), F.col("object").alias("o_a"))
    late = moments.select(F.explode(F.array(cell, cell - 1)).alias("cell"), F.col("account").alias("b"), F.col("us").alias("us_b"), F.col("object").alias("o_b"))
    gap = F.col("us_b") - F.col("us_a")
    met = early.join(late, "cell").filter((F.col("a") != F.col("b")) & (gap <= window) & ((gap > 0) | ((gap == 0) & (F.col("a") < F.col("b")))))
    first = F.col("a") < F.col("b")
    side = lambda c, x, y: [F.when(first, F.col(f"{c}_a" if c else "a")).otherwise(F.col(f"{c}_b" if c else "b")).alias(x), F.when(first, F.col(f"{c}_b" if c else "b")).otherwise(F.col(f"{c}_a" if c else "a")).alias(y)]
    return met.select(*side("", "u1", "u2"), *side("us", "us1", "us2"), *side("o", "o1", "o2"))


def paired_days(moments: Column, window: int) -> Column:
    """Days of pairs in an array of ``(us, side)`` in order of time."""
    none = F.array().cast("array<bigint>")
    start = F.struct(none.alias("waiting"), F.lit(-1).alias("side"), none.alias("days"))

    def step(state: Column, one: Column) -> Column:
        waiting = F.filter(state["waiting"], lambda us: one["us"] - us <= window)
        meets = (F.size(waiting) > 0) & (state["side"] != one["side"])
        joined = F.struct(
            F.slice(waiting, 2, F.greatest(F.size(waiting) - 1, F.lit(0))).alias("waiting"),
            state["side"].alias("side"),
            F.array_union(state["days"], F.array(F.floor(one["us"] / _DAY))).alias("days"),
        )
        left = F.struct(F.concat(waiting, F.array(one["us"])).alias("waiting"), one["side"].alias("side"), state["days"].alias("days"))
        return F.when(meets, joined).otherwise(left)

    return F.aggregate(moments, start, step, lambda state: state["days"])


def _count_days(close: DataFrame, window: int) -> DataFrame:
    """``(u1, u2, n_days)`` of close moments."""
    both = F.array(*[F.struct(F.lit(i).alias("side"), F.col(f"us{i + 1}").alias("us"), F.xxhash64(f"o{i + 1}").alias("o")) for i in (0, 1)])
    rows = close.repartition(*_PAIR).select(*_PAIR, F.explode(both).alias("m")).select(*_PAIR, "m.*")
    in_order = Window.partitionBy(*_PAIR).orderBy("us", "side", "o")
    before = F.lag(F.struct("us", "side", "o")).over(in_order)
    rows = rows.withColumn("before", before).filter(F.col("before").isNull() | (F.col("before") != F.struct("us", "side", "o")))
    fresh = F.col("before").isNull() | (F.col("us") - F.col("before.us") > window)
    rows = rows.withColumn("stretch", F.sum(fresh.cast("long")).over(in_order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    stretches = rows.groupBy(*_PAIR, "stretch").agg(F.array_sort(F.collect_list(F.struct("us", "side"))).alias("moments"))
    days = stretches.select(*_PAIR, F.explode(paired_days(F.col("moments"), window)).alias("day"))
    return days.groupBy(*_PAIR).agg(F.count_distinct("day").alias("n_days"))


def coincide_any_object(events: DataFrame, window_sec: float = 60) -> DataFrame:
    """``(u1, u2, n_days)`` over all actions of both accounts; pairs without a day are left out.

    Null accounts and times are ignored; the same event twice counts once; an
    empty table gives no rows; other columns are ignored.
    """
    window = round(window_sec * MICROS)
    return _count_days(_close(_moments(events), window), window)


def coincide_shared_objects(events: DataFrame, window_sec: float = 60) -> DataFrame:
    """As :func:`coincide_any_object`, but only actions on objects both accounts touched count."""
    window = round(window_sec * MICROS)
    moments = _moments(events).filter("object is not null")
    close = _close(moments, window)
    touched = moments.select("account", "object").distinct()
    for user, thing in (("u2", "o1"), ("u1", "o2")):
        close = close.join(touched.select(F.col("account").alias(user), F.col("object").alias(thing)), [user, thing], "left_semi")
    return _count_days(close.select("u1", "us1", "o1", "u2", "us2", "o2"), window)
