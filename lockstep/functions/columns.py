"""Column expressions shared by the extractors and the approaches."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MICROS = 1_000_000


def normalise_text(text: Column) -> Column:
    """Lower case, mentions removed, white space collapsed and trimmed; null gives an empty text.

    ``(?U)`` makes word and space characters those of Unicode.
    """
    plain = F.regexp_replace(F.lower(text), r"(?U)@\w+", "")
    return F.coalesce(F.trim(F.regexp_replace(plain, r"(?U)\s+", " ")), F.lit(""))


def iso_fraction_time(text: Column) -> Column:
    """ISO time with a fraction of 1 to 6 digits and ``Z``; anything else is null."""
    shaped = F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}\.\d{1,6}Z$"), text)
    return F.try_to_timestamp(shaped, F.lit("yyyy-MM-dd'T'HH:mm:ss.[SSSSSS][SSSSS][SSSS][SSS][SS][S]X"))


def epoch_ms_time(ms: Column) -> Column:
    return F.timestamp_millis(ms)


def tag_text(tag: Column) -> Column:
    """The first non-empty of ``tag``, ``text`` and ``name`` of a tag object."""
    return F.coalesce(*[F.when(tag[c] != "", tag[c]) for c in ("tag", "text", "name")])


def day_bucket(ts: Column) -> Column:
    return F.date_trunc("day", ts)


def half_day_bucket(ts: Column) -> Column:
    """05:00 to 16:59 falls to 05:00, all else to 17:00 of its own date.

    The hours before 05:00 thus join the evening of the same calendar date, as
    the published scores have it, not of the date before.
    """
    return F.date_trunc("day", ts) + F.when(F.hour(ts).between(5, 16), F.expr("interval 5 hours")).otherwise(F.expr("interval 17 hours"))


def micros(ts: Column) -> Column:
    """Microseconds of a timestamp with or without zone."""
    return F.unix_micros(ts.cast("timestamp"))


def once(value: Column) -> Column:
    """``value``, tied to the task number so that the optimizer computes it where it stands.

    Otherwise it would write the whole expression out again at every use, which
    for this many steps grows beyond what can be compiled.
    """
    return F.when(F.spark_partition_id() >= 0, value)
