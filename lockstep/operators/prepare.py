"""Triples to events: earliest action per object, dictionaries, labels, participation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lockstep.functions.scan import dense_index


def earliest(triples: DataFrame) -> DataFrame:
    """The earliest event per account and object; map-side combined, so busy keys shrink before the shuffle."""
    return triples.groupBy("account", "object").agg(F.min("ts").alias("ts"))


def dictionary(triples: DataFrame, column: str) -> DataFrame:
    """``(column, idx)``: ids in the order of their text, from 0."""
    return dense_index(triples.select(F.col(column).cast("string").alias(column)), column)


def encode(triples: DataFrame, accounts: DataFrame, objects: DataFrame) -> DataFrame:
    """Events ``(user_id, object_id, ts)`` through two dictionaries."""
    users = accounts.select("account", F.col("idx").alias("user_id"))
    things = objects.select("object", F.col("idx").alias("object_id"))
    return triples.join(users, "account").join(things, "object").select("user_id", "object_id", "ts")


def first_labels(triples: DataFrame, order: Column, known_only: bool = False) -> DataFrame:
    """``(account, label)``: the label of each account's first row in ``order``.

    Null labels are included, unless ``known_only``: then the first row with a label
    counts, and accounts without one are left out.
    """
    if known_only:
        triples = triples.filter("label is not null")
    return triples.groupBy("account").agg(F.min_by(F.struct("label"), order).alias("l")).select("account", F.col("l.label").alias("label"))


def io_accounts(labels: DataFrame) -> DataFrame:
    """Accounts with a falsy label: null, empty or zero (null counts as IO, as published); accounts without a row are not IO."""
    falsy = F.col("label").isNull() | F.col("label").isin("", "0", "0.0", "false")
    return labels.filter(falsy).select("account")


def min_participation(events: DataFrame, account: str = "account", least: int = 2) -> DataFrame:
    """Events of accounts with at least ``least`` of them.

    Counting first and joining the survivors keeps a busy account from being
    sorted in one task, as a window would.
    """
    enough = events.groupBy(account).count().filter(F.col("count") >= least).select(account)
    return events.join(enough, account, "left_semi")


def dataset_counts(events: DataFrame, account: str = "account", obj: str = "object") -> DataFrame:
    """One row: distinct objects, distinct accounts, events."""
    objects = events.select(obj).distinct().agg(F.count(obj).alias("n_objects"))
    accounts = events.select(account).distinct().agg(F.count(account).alias("n_accounts"))
    return objects.crossJoin(accounts).crossJoin(events.agg(F.count("*").alias("n_events")))  # three one-row tables


def object_popularity(events: DataFrame, obj: str = "object") -> DataFrame:
    """One row: number of objects, mean and largest count of events per object."""
    per = events.groupBy(obj).agg(F.count("*").alias("n"))
    return per.agg(F.count("*").alias("n_objects"), F.round(F.avg("n"), 9).alias("avg_events"), F.max("n").alias("max_events"))


def grouped_events(events: DataFrame, key: str, other: str) -> DataFrame:
    """Events clustered by ``key`` and sorted by time inside; nothing is collected."""
    return events.repartition(key).sortWithinPartitions(key, "ts", other)
