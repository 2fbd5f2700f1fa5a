"""Co-actions as they happen: an interval join of the event stream with itself.

Watermarks bound the state: an event is kept until no partner within the window
can arrive any more.  Counts per pair over tumbling windows follow from it.
Weighted scores need popularity over all buckets that are synchronised anywhere,
which later events can change, so they stay in batch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def live_coactions(events: DataFrame, window_sec: int = 60, lateness: str = "10 minutes") -> DataFrame:
    """``(u1, u2, object, ts)`` of a streaming ``events(account, object, ts)``, ``ts`` the later time.

    Events later than ``lateness`` are dropped; events of one account never pair.
    """
    one = events.select(F.col("account").alias("a"), F.col("object").alias("oa"), F.col("ts").alias("ta")).withWatermark("ta", lateness)
    two = events.select(F.col("account").alias("b"), F.col("object").alias("ob"), F.col("ts").alias("tb")).withWatermark("tb", lateness)
    gap = F.expr(f"tb between ta - interval {int(window_sec)} seconds and ta + interval {int(window_sec)} seconds")
    met = one.join(two, (F.col("oa") == F.col("ob")) & gap & (F.col("a") < F.col("b")))
    return met.select(F.col("a").alias("u1"), F.col("b").alias("u2"), F.col("oa").alias("object"), F.greatest("ta", "tb").alias("ts"))


def live_activity(events: DataFrame, width: str = "1 hour", lateness: str = "10 minutes") -> DataFrame:
    """Events per object and tumbling window: ``(start, object, n)``."""
    counted = events.withWatermark("ts", lateness).groupBy(F.window("ts", width), "object").agg(F.count("*").alias("n"))
    return counted.select(F.col("window.start").alias("start"), "object", "n")
