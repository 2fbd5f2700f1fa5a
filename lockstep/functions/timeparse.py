"""Timestamps of many notations to one UTC instant.

All notations are one regular expression with named groups.  A single
``regexp_replace`` writes the groups of whichever branch matched into a fixed
record of components; the calendar is then checked and the instant assembled with
integer arithmetic on days.  Everything stays inside generated JVM code; only
zone rules of the capturing host go through the JVM's zone database.

Defined results: null, empty and unreadable texts, dates that are not in the
calendar, hours above 23, zones nobody knows and local times that a clock change
skips give null.  A local time that occurs twice is the earlier instant.  Years
1 to 9999 are valid; digits finer than a microsecond are cut off.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lockstep.functions.columns import once

# Zone abbreviations and their offset from UTC in minutes.
ABBREVIATIONS = {
    "UTC": 0,
    "GMT": 0,
    "UT": 0,
    "Z": 0,
    "WET": 0,
    "WEST": 60,
    "BST": 60,
    "CET": 60,
    "CEST": 120,
    "EET": 120,
    "EEST": 180,
    "MSK": 180,
    "IST": 330,
    "JST": 540,
    "KST": 540,
    "AEST": 600,
    "AEDT": 660,
    "NZST": 720,
    "NZDT": 780,
    "EST": -300,
    "EDT": -240,
    "CST": -360,
    "CDT": -300,
    "MST": -420,
    "MDT": -360,
    "PST": -480,
    "PDT": -420,
    "AKST": -540,
    "AKDT": -480,
    "HST": -600,
}
# English month abbreviations.
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")

_SEP = "\u0001"
_DAY = r"(?:mon|tue|wed|thu|fri|sat|sun)[a-z]*"
_MON = "(?:" + "|".join(MONTHS) + ")"
_ZONE = r"(?:z|[+-]\d{2}(?::?\d{2})?|[a-z]{1,5})"


def _clock(tag: str) -> str:
    return rf"(?<h{tag}>\d{{1,2}}):(?<i{tag}>\d{{2}})(?::(?<s{tag}>\d{{2}})(?:[.,](?<f{tag}>\d{{1,12}}))?)?"


#: One branch per notation; a component's group name ends in the letter of its branch.
_BRANCHES = {
    # 2022-01-02T03:04:05.678+01:00, 2022-01-02 03:04 CET
    "a": rf"(?<ya>\d{{4}})-(?<ma>\d{{2}})-(?<da>\d{{2}})[t ]{_clock('a')}(?: ?(?<za>{_ZONE}))?",
    # 20220102T030405Z
    "b": rf"(?<yb>\d{{4}})(?<mb>\d{{2}})(?<db>\d{{2}})t(?<hb>\d{{2}})(?<ib>\d{{2}})(?:(?<sb>\d{{2}})(?:[.,](?<fb>\d{{1,12}}))?)?(?: ?(?<zb>{_ZONE}))?",
    # 02.01.2022, 03:04
    "c": rf"(?<dc>\d{{1,2}})\.(?<mc>\d{{1,2}})\.(?<yc>\d{{4}}),? {_clock('c')}(?: (?<zc>{_ZONE}))?",
    # 1/2/2022 3:04 pm
    "d": rf"(?<md>\d{{1,2}})/(?<dd>\d{{1,2}})/(?<yd>\d{{4}}),? {_clock('d')}(?: ?(?<pd>[ap])\.?m\.?)?(?: (?<zd>{_ZONE}))?",
    # Sun Jan 02 03:04:05 +0000 2022
    "e": rf"{_DAY} (?<me>{_MON})[a-z]* +(?<de>\d{{1,2}}) {_clock('e')}(?: (?<ze>{_ZONE}))? (?<ye>\d{{4}})",
    # Sun, 2 Jan 2022 03:04:05 GMT
    "g": rf"(?:{_DAY},? )?(?<dg>\d{{1,2}}) (?<mg>{_MON})[a-z]* (?<yg>\d{{4}}) {_clock('g')}(?: (?<zg>{_ZONE}))?",
    # 1641100000, 1641100000.123, 1.641E12
    "n": r"(?<nn>[+-]?\d{1,25}(?:\.\d{1,15})?(?:e[+]?\d{1,2})?)",
}

PATTERN = "^(?:" + "|".join(_BRANCHES.values()) + ")$"

_COMPONENTS = {
    "y": "abcdeg",
    "m": "abcdeg",
    "d": "abcdeg",
    "h": "abcdeg",
    "i": "abcdeg",
    "s": "abcdeg",
    "f": "abcdeg",
    "p": "d",
    "z": "abcdeg",
    "n": "n",
}
_ORDER = list(_COMPONENTS)
_RECORD = _SEP + _SEP.join("".join(f"${{{c}{b}}}" for b in _COMPONENTS[c]) for c in _ORDER)


def components(text: Column) -> Column:
    """Array of the components of a timestamp text in a fixed order, or null where no notation matches."""
    tidy = F.lower(F.regexp_replace(text, r"^\s+|\s+$", ""))
    record = F.regexp_replace(tidy, F.lit(PATTERN), F.lit(_RECORD))
    return F.when(record.startswith(_SEP), F.split(record, _SEP))


def days_from_civil(year: Column, month: Column, day: Column) -> Column:
    """Days since 1970-01-01 of a proleptic Gregorian date, by integer arithmetic."""
    y = year - F.when(month <= 2, 1).otherwise(0)
    era = F.floor(y / 400)
    yoe = y - era * 400
    shifted = F.when(month > 2, month - 3).otherwise(month + 9)
    doy = F.floor((shifted * 153 + 2) / 5) + day - 1
    doe = yoe * 365 + F.floor(yoe / 4) - F.floor(yoe / 100) + doy
    return (era * 146097 + doe - 719468).cast("long")


def month_length(year: Column, month: Column) -> Column:
    leap = ((year % 4 == 0) & (year % 100 != 0)) | (year % 400 == 0)
    return F.when(month == 2, F.when(leap, 29).otherwise(28)).when(month.isin(4, 6, 9, 11), 30).otherwise(31)


def _offset_minutes(zone: Column) -> Column:
    """Minutes east of UTC for ``z``, ``+hh``, ``+hhmm``, ``+hh:mm`` and known abbreviations, else null."""
    digits = F.regexp_replace(zone, "[^0-9]", "")
    hours = F.substring(digits, 1, 2).try_cast("int")
    minutes = F.when(F.length(digits) >= 4, F.substring(digits, 3, 2).try_cast("int")).otherwise(0)
    sign = F.when(zone.startswith("-"), -1).otherwise(1)
    numeric = F.when((hours <= 18) & (minutes < 60), sign * (hours * 60 + minutes))
    table = F.create_map(*[F.lit(x) for pair in ABBREVIATIONS.items() for x in (pair[0].lower(), pair[1])])
    return F.when(zone.rlike(r"^[+-]\d"), numeric).otherwise(table[zone])


def _epoch_us(number: Column) -> Column:
    """Microseconds of a bare number; its size tells seconds, milli-, micro- or nanoseconds."""
    value = number.try_cast("decimal(38,12)")
    size = F.abs(value)
    us = (
        F.when(size < 10**11, value * 1_000_000)
        .when(size < 10**14, value * 1_000)
        .when(size < 10**17, value)
        .when(size < F.lit(10**18).cast("decimal(38,0)") * 100, value / 1_000)
    )
    return F.floor(us).cast("long")


def zone_names(spark: SparkSession) -> list[str]:
    """Zones whose rules the JVM knows; others' names would fail where they are used."""
    jvm = spark.sparkContext._jvm
    return sorted(jvm.java.lang.String.join(",", jvm.java.time.ZoneId.getAvailableZoneIds()).split(","))


def parsed(df: DataFrame, text: str, host: str) -> DataFrame:
    """``df`` with ``us``: microseconds since 1970 UTC of ``text``, or null.

    The text's own offset or abbreviation decides, then ``host`` (an offset, an
    abbreviation or a zone name), else null.  ``df`` has few columns, none named
    like the steps below.  Each step is one projection.
    """
    own = df.columns
    steps = df.select(*own, once(components(F.col(text))).alias("rec"))
    raw = {c: F.col("rec").getItem(i + 1) for i, c in enumerate(_ORDER)}
    steps = steps.select(*own, once(F.struct(*[F.when(v != "", v).alias(c) for c, v in raw.items()])).alias("t"))
    named = F.create_map(*[F.lit(x) for i, m in enumerate(MONTHS) for x in (m, i + 1)])[F.col("t.m")]
    number = lambda c: F.col(f"t.{c}").try_cast("int")
    half = F.col("t.p")
    hour = number("h")
    clock = F.when(half.isNull(), hour).when(hour.between(1, 12), hour % 12 + F.when(half == "p", 12).otherwise(0))
    host_zone = F.regexp_replace(F.col(host), r"^\s+|\s+$", "")
    known = zone_names(df.sparkSession)
    fields = {
        "y": number("y"),
        "m": F.coalesce(number("m"), named),
        "d": number("d"),
        "clock": clock,
        "i": number("i"),
        "s": F.coalesce(number("s"), F.lit(0)),
        "micro": F.coalesce(F.rpad(F.substring("t.f", 1, 6), 6, "0").try_cast("int"), F.lit(0)),
        "n": F.col("t.n"),
        "own_zone": F.col("t.z").isNotNull(),
        "own_min": _offset_minutes(F.col("t.z")),
        "host_min": _offset_minutes(F.lower(host_zone)),
        "zone": F.when(host_zone.isin(known), host_zone),
    }
    steps = steps.select(*own, once(F.struct(*[c.alias(n) for n, c in fields.items()])).alias("q"))
    q = {n: F.col(f"q.{n}") for n in fields}
    valid = (q["y"] >= 1) & q["m"].between(1, 12) & (q["d"] >= 1) & (q["d"] <= month_length(q["y"], q["m"]))
    valid = valid & q["clock"].between(0, 23) & (q["i"] < 60) & (q["s"] < 60)
    seconds = days_from_civil(q["y"], q["m"], q["d"]) * 86400 + q["clock"] * 3600 + q["i"] * 60 + q["s"]
    steps = steps.select(*own, "q", once(F.when(valid, seconds * 1_000_000 + q["micro"])).alias("local"))
    safe, local = F.coalesce(q["zone"], F.lit("UTC")), F.col("local")
    steps = steps.select(*own, "q", "local", once(F.to_utc_timestamp(F.timestamp_micros(local), safe)).alias("instant"))
    # a skipped local time does not come back from UTC as itself
    back = F.unix_micros(F.from_utc_timestamp(F.col("instant"), safe))
    by_name = F.when(q["zone"].isNotNull() & (back == local), F.unix_micros("instant"))
    by_zone = (
        F.when(q["own_zone"], local - q["own_min"].cast("long") * 60_000_000)
        .when(q["host_min"].isNotNull(), local - q["host_min"].cast("long") * 60_000_000)
        .otherwise(by_name)
    )
    return steps.select(*own, once(F.when(q["n"].isNotNull(), _epoch_us(q["n"])).otherwise(by_zone)).alias("us"))
