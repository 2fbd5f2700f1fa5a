"""Queries of the general record problems: nested records, mixed times, hot keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lockstep.operators.hotkeys import object_activity
from lockstep.operators.nested import first_filled, plan_inlining, relation, schema_graph, shred_json, shred_typed
from lockstep.operators.timestamps import normalise_times
from lockstep.tables import table

_REF, _TAG = "referenced_tweets", "hashtags"
#: Tables that are read below; in any data they repeat, which a plan finds by itself.
_SEPARATE = {_REF, _TAG}


def _posts(spark: SparkSession, d: str, element: str, attributes: list[str], typed: list[str]) -> DataFrame:
    """Rows of one element of both tables of posts: the link columns, ``src`` and the attributes."""
    raw = table(spark, d, "twitter_raw").select("row_id", "payload")
    plan = plan_inlining(schema_graph(raw, "payload", "post", "author_id"), "post", _SEPARATE)
    elements = {element, *[a for a in attributes if a in plan.tables]}
    found = relation(shred_json(raw, "row_id", "payload", plan, "author_id", elements), plan, element, attributes)
    tables, _ = shred_typed(table(spark, d, "twitter_posts").select("row_id", *typed), "row_id", typed, "post", _SEPARATE)
    both = found.withColumn("src", F.lit("twitter_raw")).unionByName(tables[element].withColumn("src", F.lit("twitter_posts")), True)
    return both.withColumn("row_id", F.col("record"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Tags of references with the link to their post and reference."""
    tags = _posts(spark, d, _TAG, ["tag", "text", "name", "value"], [_REF]).filter(F.col("lineage").rlike(f"^({_REF}/)+{_TAG}$"))
    tag = first_filled(F.col("a_tag"), F.col("a_text"), F.col("a_name"), F.col("a_value"))
    return tags.select("src", "row_id", F.col("parent_path").alias("ref_path"), F.col("pos").alias("tag_pos"), tag.alias("tag")).filter(F.col("tag").isNotNull())


def p1_references(spark: SparkSession, d: str) -> DataFrame:
    """The table of references: path, path of the parent reference (null below the post), type and id."""
    refs = _posts(spark, d, _REF, ["type", "id"], [_REF]).filter(F.col("lineage").rlike(f"^{_REF}(/{_REF})*$"))
    parent = F.when(F.col("parent_path") != "", F.col("parent_path"))
    path = F.concat_ws(".", parent, F.col("pos").cast("string"))
    return refs.select("src", "row_id", path.alias("ref_path"), parent.alias("parent_path"), F.col("a_type").alias("type"), F.col("a_id").alias("ref_id"))


def p1_posts(spark: SparkSession, d: str) -> DataFrame:
    """The root table of the posts."""
    posts = _posts(spark, d, "post", ["author_id", "created_at", "text", "user/username"], ["author_id", "created_at", "text", "user_info"])
    username = F.coalesce("a_user_username", "a_user_info_username")
    return posts.select("src", "row_id", F.col("a_author_id").alias("author_id"), F.col("a_created_at").alias("created_at"), F.col("a_text").alias("text"), username.alias("username"))


def p1_schema_graph(spark: SparkSession, d: str) -> DataFrame:
    """Edges of the element graph of the raw posts."""
    return schema_graph(table(spark, d, "twitter_raw"), "payload", "post", "author_id")


def _times(spark: SparkSession, d: str) -> DataFrame:
    landing = table(spark, d, "post_landing").select(
        F.lit("post_landing").alias("src"), "row_id", F.coalesce("created_at", "tweet_time", "post_time").alias("written"), "capture_zone"
    )
    posts = table(spark, d, "twitter_posts").select(
        F.lit("twitter_posts").alias("src"), "row_id", F.col("created_at").alias("written"), F.lit(None).cast("string").alias("capture_zone")
    )
    return normalise_times(landing.unionByName(posts), "written", "capture_zone")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Rows whose time names an instant, in microseconds since 1970 UTC."""
    return _times(spark, d).filter(F.col("utc_us").isNotNull()).select("src", "row_id", "utc_us")


def p3_set_apart(spark: SparkSession, d: str) -> DataFrame:
    """Rows whose time names no instant, with the text as it was written."""
    return _times(spark, d).filter(F.col("utc_us").isNull()).select("src", "row_id", "written", "capture_zone")


def _objects(spark: SparkSession, d: str, accounts: bool = True) -> DataFrame:
    trim = lambda c: F.regexp_replace(F.col(c), r"^\s+|\s+$", "")
    retweets = table(spark, d, "cimaio_posts").select(
        F.lit("cimaio_posts").alias("src"), trim("retweet_tweetid").alias("object_id"), F.col("userid").alias("account"), F.col("tweet_time").cast("long").alias("at"), "row_id"
    )
    reposts = (
        table(spark, d, "anon_posts")
        .filter(F.col("is_repost"))
        .select(F.lit("anon_posts").alias("src"), trim("reposted_postid").alias("object_id"), F.col("accountid").alias("account"), F.unix_micros(F.col("post_time").cast("timestamp")).alias("at"), "row_id")
    )
    posts = retweets.unionByName(reposts).filter(F.col("object_id") != "")
    return object_activity(posts, ["src", "object_id"], "account", "at", "row_id", chunks=posts.rdd.getNumPartitions(), accounts=accounts)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """First row of each object with two or more rows of known time."""
    return _objects(spark, d, accounts=False).filter(F.col("n_timed") >= 2).select("src", "object_id", "first_row_id")


def p5_activity(spark: SparkSession, d: str) -> DataFrame:
    """Rows, accounts and first row of every object."""
    return _objects(spark, d)


QUERIES = {f.__name__: f for f in (p1_found, p1_references, p1_posts, p1_schema_graph, p3_found, p3_set_apart, p5_found, p5_activity)}

_OBJECTS_SQL = """
WITH posts AS (
  SELECT 'cimaio_posts' AS src, trim(retweet_tweetid, E' \\t\\n\\r') AS object_id, userid AS account, tweet_time AS "at", row_id FROM cimaio_posts
  UNION ALL
  SELECT 'anon_posts', trim(reposted_postid, E' \\t\\n\\r'), accountid, epoch_us(post_time), row_id FROM anon_posts WHERE is_repost
), objects AS (
  SELECT src, object_id, count(*) AS n_rows, count("at") AS n_timed, count(DISTINCT account) AS n_accounts,
         (min({'t': "at", 'r': row_id}) FILTER (WHERE "at" IS NOT NULL)).r AS first_row_id
  FROM posts WHERE object_id <> '' GROUP BY src, object_id
)
"""
_REFS_SQL = r"""
WITH RECURSIVE docs AS (SELECT row_id, CASE WHEN json_valid(payload) THEN payload::JSON END AS j FROM twitter_raw),
posts AS (
  SELECT row_id, CASE WHEN json_exists(j, '$.author_id') THEN j ELSE list_filter(json_extract(j, '$.*'), lambda x: json_exists(x, '$.author_id'))[1] END AS post
  FROM docs WHERE json_type(j) = 'OBJECT'
),
raw_lists AS (SELECT row_id, '' AS up, post -> '$.referenced_tweets' AS r FROM posts),
refs AS (
  SELECT row_id, (k - 1)::VARCHAR AS ref_path, x[k] AS ref
  FROM (SELECT *, unnest(range(1, len(x) + 1)) AS k FROM (SELECT row_id, CASE json_type(r) WHEN 'ARRAY' THEN json_extract(r, '$[*]') WHEN 'NULL' THEN [] ELSE [r] END AS x FROM raw_lists WHERE r IS NOT NULL))
  UNION ALL
  SELECT row_id, ref_path || '.' || (k - 1), x[k]
  FROM (SELECT *, unnest(range(1, len(x) + 1)) AS k FROM (SELECT row_id, ref_path, CASE json_type(r) WHEN 'ARRAY' THEN json_extract(r, '$[*]') WHEN 'NULL' THEN [] ELSE [r] END AS x FROM (SELECT row_id, ref_path, ref -> '$.referenced_tweets' AS r FROM refs) WHERE r IS NOT NULL))
)
"""
_TAGS_SQL = _REFS_SQL + r""",
tags AS (
  SELECT row_id, ref_path, k - 1 AS tag_pos, x[k] AS t
  FROM (SELECT *, unnest(range(1, len(x) + 1)) AS k FROM (SELECT row_id, ref_path, CASE json_type(h) WHEN 'ARRAY' THEN json_extract(h, '$[*]') WHEN 'NULL' THEN [] ELSE [h] END AS x FROM (SELECT row_id, ref_path, ref -> '$.hashtags' AS h FROM refs) WHERE h IS NOT NULL))
),
found AS (
  SELECT 'twitter_raw' AS src, row_id, ref_path, tag_pos,
    CASE WHEN json_type(t) = 'OBJECT' THEN coalesce(nullif(t ->> '$.tag', ''), nullif(t ->> '$.text', ''), nullif(t ->> '$.name', '')) WHEN json_type(t) IN ('VARCHAR', 'BIGINT', 'UBIGINT', 'DOUBLE') THEN t ->> '$' END AS tag FROM tags
  UNION ALL
  SELECT 'twitter_posts', row_id, (i - 1)::VARCHAR, k - 1, coalesce(nullif(h[k].tag, ''), nullif(h[k]."text", ''), nullif(h[k]."name", ''))
  FROM (SELECT *, unnest(range(1, len(h) + 1)) AS k FROM (SELECT row_id, i, r[i].hashtags AS h FROM (SELECT row_id, referenced_tweets AS r, unnest(range(1, len(referenced_tweets) + 1)) AS i FROM twitter_posts)))
)
SELECT src, row_id, ref_path, tag_pos::BIGINT AS tag_pos, tag FROM found WHERE tag <> ''
"""
_REFERENCES_SQL = _REFS_SQL + r""",
found AS (
  SELECT 'twitter_raw' AS src, row_id, ref_path, CASE WHEN json_type(ref) = 'OBJECT' THEN ref ->> '$.type' END AS "type", CASE WHEN json_type(ref) = 'OBJECT' THEN ref ->> '$.id' END AS ref_id
  FROM refs WHERE json_type(ref) <> 'NULL'
  UNION ALL
  SELECT 'twitter_posts', row_id, (i - 1)::VARCHAR, r[i]."type", r[i].id
  FROM (SELECT row_id, referenced_tweets AS r, unnest(range(1, len(referenced_tweets) + 1)) AS i FROM twitter_posts) WHERE r[i] IS NOT NULL
)
SELECT src, row_id, ref_path, CASE WHEN ref_path LIKE '%.%' THEN regexp_replace(ref_path, '\.[0-9]+$', '') END AS parent_path, "type", ref_id FROM found
"""
_POSTS_SQL = _REFS_SQL + r"""
SELECT 'twitter_raw' AS src, row_id, post ->> '$.author_id' AS author_id, post ->> '$.created_at' AS created_at, post ->> '$.text' AS "text", post ->> '$.user.username' AS username FROM posts WHERE post IS NOT NULL
UNION ALL SELECT 'twitter_posts', row_id, author_id, created_at, "text", user_info.username FROM twitter_posts
"""
_EDGES_SQL = _REFS_SQL + r""",
nodes AS (SELECT regexp_replace(n.fullkey, '\[[0-9]+\]', '', 'g') AS path, n.fullkey LIKE '%]' AS repeated, n."type" FROM posts, json_tree(posts.post) n WHERE post IS NOT NULL AND n."type" NOT IN ('ARRAY', 'NULL') AND n.fullkey <> '$')
SELECT CASE WHEN path LIKE '$.%.%' THEN split_part(path, '.', -2) ELSE 'post' END AS parent, split_part(path, '.', -1) AS child, CASE "type" WHEN 'OBJECT' THEN 'object' ELSE 'scalar' END AS shape, repeated, count(*) AS n
FROM nodes GROUP BY ALL
"""
_TIMES_SQL = r"""
WITH w AS (
  SELECT 'post_landing' AS src, row_id, coalesce(created_at, tweet_time, post_time) AS written, capture_zone FROM post_landing
  UNION ALL SELECT 'twitter_posts', row_id, created_at, NULL FROM twitter_posts
), a AS (SELECT *, upper(regexp_replace(written, '^\s+|\s+$', '', 'g')) AS t, regexp_replace(capture_zone, '^\s+|\s+$', '', 'g') AS host FROM w),
b AS (
  SELECT *, CASE WHEN regexp_full_match(t, '[0-9]+(\.[0-9]+)?(E[0-9]+)?') THEN t END AS number,
    coalesce(nullif(regexp_extract(t, ':[0-9]{2}(\.[0-9]+)? ?([+-][0-9]{2}(:?[0-9]{2})?)( [0-9]{4})?$', 2), ''), nullif(regexp_extract(t, ' ?(Z|GMT|UTC|EST|EDT|CST|CDT|MST|MDT|PST|PDT|CET|CEST|EET|EEST|BST)$', 1), '')) AS z,
    regexp_extract(t, ':[0-9]{2}\.([0-9]+)', 1) AS frac FROM a
), c AS (
  SELECT *, regexp_replace(regexp_replace(CASE WHEN z IS NULL THEN t ELSE regexp_replace(t, ' ?' || replace(z, '+', '\+') || '( [0-9]{4})?$', '\1') END, '(:[0-9]{2})\.[0-9]+', '\1'), '^[A-Z]{3},? ', '') AS bare FROM b
), l AS (
  SELECT *, try_strptime(bare, ['%Y-%m-%dT%H:%M:%S', '%Y-%m-%d %H:%M:%S', '%Y-%m-%dT%H:%M', '%Y-%m-%d %H:%M', '%d.%m.%Y %H:%M:%S', '%d.%m.%Y, %H:%M', '%m/%d/%Y %I:%M:%S %p', '%m/%d/%Y %I:%M %p', '%Y%m%dT%H%M%S', '%b %d %H:%M:%S %Y', '%d %b %Y %H:%M:%S']) AS wall,
    CASE WHEN z[1] IN ('+', '-') THEN (CASE z[1] WHEN '-' THEN -1 ELSE 1 END) * (z[2:3]::INT * 60 + coalesce(nullif(replace(z, ':', '')[4:5], ''), '0')::INT)
      ELSE map {'Z': 0, 'GMT': 0, 'UTC': 0, 'EST': -300, 'EDT': -240, 'CST': -360, 'CDT': -300, 'MST': -420, 'MDT': -360, 'PST': -480, 'PDT': -420, 'CET': 60, 'CEST': 120, 'EET': 120, 'EEST': 180, 'BST': 60}[z] END AS own_min,
    CASE WHEN regexp_full_match(host, '[+-][0-9]{2}:[0-9]{2}') THEN (CASE host[1] WHEN '-' THEN -1 ELSE 1 END) * (host[2:3]::INT * 60 + host[5:6]::INT) END AS host_min FROM c
), i AS (
  SELECT *, epoch_us(wall) + coalesce(nullif(rpad(frac[1:6], 6, '0'), '000000'), '0')::BIGINT AS wall_us,
    CASE WHEN number IS NULL AND z IS NULL AND host_min IS NULL AND host IS NOT NULL AND wall IS NOT NULL THEN timezone(host, wall) END AS late FROM l
), k AS (
  SELECT *, CASE WHEN timezone(host, late - INTERVAL 1 HOUR) = wall THEN late - INTERVAL 1 HOUR WHEN timezone(host, late) = wall THEN late END AS instant FROM i
), n AS (SELECT *, try_cast(number AS DOUBLE) AS size, CASE WHEN number LIKE '%E%' THEN round(try_cast(split_part(number, 'E', 1) AS DOUBLE) * pow(10, try_cast(split_part(number, 'E', 2) AS DOUBLE)) * 1000)::BIGINT::DECIMAL(20, 0) * 0.001::DECIMAL(4, 3) ELSE try_cast(number AS DECIMAL(38, 6)) END AS v FROM k),
u AS (
  SELECT src, row_id, CASE WHEN number IS NOT NULL THEN floor(CASE WHEN size < 1e11 THEN v * 1000000 WHEN size < 1e14 THEN v * 1000 WHEN size < 1e17 THEN v ELSE v::HUGEINT // 1000 END)::BIGINT
    WHEN z IS NOT NULL THEN wall_us - own_min::BIGINT * 60000000 WHEN host_min IS NOT NULL THEN wall_us - host_min::BIGINT * 60000000
    ELSE epoch_us(instant) + wall_us - epoch_us(wall) END AS utc_us FROM n
)
"""
ORACLE = {
    "p1_found": _TAGS_SQL,
    "p1_references": _REFERENCES_SQL,
    "p1_posts": _POSTS_SQL,
    "p1_schema_graph": _EDGES_SQL,
    "p3_found": _TIMES_SQL + "SELECT src, row_id, utc_us FROM u WHERE utc_us IS NOT NULL",
    "p3_set_apart": _TIMES_SQL + "SELECT src, row_id, written, capture_zone FROM u JOIN w USING (src, row_id) WHERE utc_us IS NULL",
    "p5_found": _OBJECTS_SQL + "SELECT src, object_id, first_row_id FROM objects WHERE n_timed >= 2",
    "p5_activity": _OBJECTS_SQL + "SELECT * FROM objects",
}
