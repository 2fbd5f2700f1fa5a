"""Raw posts of three layouts to ``(account, object, ts)`` triples.

Extractors are column expressions over the raw rows.  Rows without account or
time give nothing; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lockstep.functions.columns import epoch_ms_time, iso_fraction_time, normalise_text, tag_text

_REFERENCE = "array<struct<type:string,id:string,hashtags:array<struct<tag:string,text:string,name:string>>>>"
SCHEMAS = {
    "CimaIO": "userid string, tweet_time bigint, retweet_tweetid string, hashtags array<string>, tweet_text string, good int",
    "anonymized": "accountid string, reposted_postid string, post_time timestamp, is_repost boolean, hashtags array<string>, post_text string, is_control int",
    "twitter": f"author_id string, created_at string, text string, user struct<username:string>, referenced_tweets {_REFERENCE}",
}


def _layout(kind: str) -> dict[str, Column]:
    """Expressions of a layout: account, ts, label, text, tags, repost test and reposted object."""
    if kind == "CimaIO":
        repost = F.col("retweet_tweetid")
        return {
            "account": F.col("userid"),
            "ts": epoch_ms_time(F.col("tweet_time")),
            "label": F.col("good").cast("string"),
            "text": F.col("tweet_text"),
            "tags": F.col("hashtags"),
            "object": repost,
            "reposts": repost.isNotNull(),
            # tags and texts take an empty id for no repost
            "original": F.coalesce(repost, F.lit("")) == "",
        }
    if kind == "anonymized":
        repost = F.coalesce(F.col("is_repost"), F.lit(False))
        return {
            "account": F.col("accountid"),
            "ts": F.col("post_time").cast("timestamp"),
            "label": F.col("is_control").cast("string"),
            "text": F.col("post_text"),
            "tags": F.col("hashtags"),
            "object": F.col("reposted_postid"),
            "reposts": repost,
            "original": ~repost,
        }
    if kind == "twitter":
        first = F.get("referenced_tweets", F.lit(0))
        retweeted = F.coalesce(first["type"] == "retweeted", F.lit(False))
        return {
            "account": F.col("author_id"),
            "ts": iso_fraction_time(F.col("created_at")),
            "label": F.col("user.username"),
            "text": F.col("text"),
            # tags are those of the first reference, so posts without one have none
            "tags": F.transform(first["hashtags"], tag_text),
            "object": first["id"],
            "reposts": retweeted,
            "original": ~retweeted,
        }
    raise ValueError(f"unknown dataset type {kind!r}; one of {sorted(SCHEMAS)}")


def _triples(raw: DataFrame, at: dict[str, Column], keep: Column, obj: Column, label: bool) -> DataFrame:
    columns = [at["account"].cast("string").alias("account"), obj.alias("object"), at["ts"].alias("ts")]
    rows = raw.filter(keep).select(*columns, *([at["label"].alias("label")] if label else []))
    return rows.filter("account is not null and object is not null and ts is not null")


def retweets(raw: DataFrame, kind: str, label: bool = False) -> DataFrame:
    """Reposts with the reposted object."""
    at = _layout(kind)
    return _triples(raw, at, at["reposts"], at["object"].cast("string"), label)


def hashtags(raw: DataFrame, kind: str, label: bool = False) -> DataFrame:
    """One row per non-empty tag of posts that are no reposts."""
    at = _layout(kind)
    tags = F.filter(at["tags"], lambda t: t.isNotNull() & (t != ""))
    return _triples(raw, at, at["original"], F.explode(tags), label)


def same_content(raw: DataFrame, kind: str, label: bool = False) -> DataFrame:
    """Posts that are no reposts, the object being their normalised text if any is left."""
    at = _layout(kind)
    text = normalise_text(at["text"])
    return _triples(raw, at, at["original"] & (text != ""), text, label)


EXTRACTORS: dict[str, Callable[..., DataFrame]] = {"retweets": retweets, "hashtags": hashtags, "same_content": same_content}


def register_extractor(name: str, extractor: Callable[..., DataFrame]) -> None:
    """Add an extractor ``(raw, kind, label=False) -> triples`` under a new name."""
    if name in EXTRACTORS:
        raise ValueError(f"there is an extractor {name!r} already")
    EXTRACTORS[name] = extractor


def raw_schema(kind: str) -> T.StructType:
    if kind not in SCHEMAS:
        raise ValueError(f"unknown dataset type {kind!r}; one of {sorted(SCHEMAS)}")
    return T.StructType.fromDDL(SCHEMAS[kind])
