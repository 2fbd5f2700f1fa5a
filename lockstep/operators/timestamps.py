"""Normalising a column of timestamps, with the unusable ones set apart."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lockstep.functions.timeparse import parsed


def normalise_times(df: DataFrame, text: str, zone: str | None = None, out: str = "utc_us") -> DataFrame:
    """``df`` with ``out``: microseconds since 1970 UTC, null where ``text`` names no instant.

    ``zone`` is the column with the zone of the capturing host.  Other columns
    pass through, also those whose names this operator uses inside; a column
    named ``out`` is replaced.
    """
    host = F.col(zone) if zone else F.lit(None)
    packed = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), F.col(text).alias("text"), host.cast("string").alias("host"))
    done = parsed(packed, "text", "host")
    keep = [F.col("row").getField(c).alias(c) for c in df.columns if c != out]
    return done.select(*keep, F.col("us").alias(out))


def split_times(df: DataFrame, text: str, zone: str | None = None) -> tuple[DataFrame, DataFrame]:
    """The rows with an instant (column ``utc_us``), and the rest."""
    both = normalise_times(df, text, zone)
    return both.filter(F.col("utc_us").isNotNull()), both.filter(F.col("utc_us").isNull()).drop("utc_us")
