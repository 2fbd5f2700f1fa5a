"""Queries of the training-data problems on the test tables, and their SQL."""

from __future__ import annotations

from collections import Counter, defaultdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lockstep.llm.cooccurrence import cooccurring_pairs
from lockstep.llm.heavy_hitters import frequent_items, misra_gries
from lockstep.llm.leak_index import leaks, phrase_matches
from lockstep.llm.mixing import MAX_LEAVES, TOKENIZER, Node, budget_tree, leaf_sizes, leaves_of, select_mixture, token_sizes, totals
from lockstep.llm.setjoin import similar_classes, similar_pairs
from lockstep.llm.spam import redundancy, stuffed_documents
from lockstep.session import cut
from lockstep.tables import table

WINDOW_MS = 60_000


def _trim(column):
    return F.regexp_replace(column, r"^\s+|\s+$", "")


def _posts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "cimaio_posts").withColumn("retweet", _trim(F.col("retweet_tweetid")))


def _items(spark: SparkSession, d: str) -> DataFrame:
    """``(field, userid, item)``: retweeted tweets, and tags of posts that are no retweets, in one scan."""
    tag = lambda t: F.lower(F.regexp_replace(t, r"^\s*#*\s*|\s+$", ""))
    retweet = F.array(F.struct(F.lit("retweet_tweetid").alias("field"), F.col("retweet").alias("item")))
    tags = F.transform("hashtags", lambda t: F.struct(F.lit("hashtags").alias("field"), tag(t).alias("item")))
    rows = _posts(spark, d).select("userid", F.explode(F.when(F.col("retweet") != "", retweet).otherwise(tags)).alias("i"))
    return rows.select("i.field", "userid", "i.item").filter("item <> ''")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Items that make up at least one per cent of their field."""
    return frequent_items(_items(spark, d).select("field", "item"), support=0.01).select("field", "item")


def p2_counts(spark: SparkSession, d: str) -> DataFrame:
    """The frequent items with their approximate count and its error bound, and the exact count."""
    return frequent_items(_items(spark, d).select("field", "item"), support=0.01)


def p2_bounds(spark: SparkSession, d: str) -> DataFrame:
    """The frequent items with their exact count, the items of their field, and whether the summary keeps its bounds."""
    found = frequent_items(_items(spark, d).select("field", "item"), support=0.01)
    kept = (F.col("count") <= F.col("exact")) & (F.col("exact") <= F.col("upper")) & ((F.col("upper") - F.col("count")) * 1001 <= F.col("n"))
    return found.select("field", "item", "exact", "n", kept.alias("bounds_hold"))


def p2_summary(spark: SparkSession, d: str) -> DataFrame:
    """The whole summary of a thousand counters per field."""
    return misra_gries(_items(spark, d).select("field", "item"))


def _retweets(spark: SparkSession, d: str) -> DataFrame:
    posts = _posts(spark, d).filter("userid is not null and tweet_time is not null and retweet <> ''")
    return posts.select(F.col("userid").alias("account"), F.col("retweet").alias("item"), F.col("tweet_time").alias("t"))


def p4_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Accounts that retweet the same tweets within a minute, with counts, lift and conviction."""
    pairs = cooccurring_pairs(_retweets(spark, d), WINDOW_MS, min_count=3, min_lift=5.0)
    pairs = pairs.withColumns({c: F.round(c, 9) for c in ("lift", "conviction")})
    return pairs.withColumnsRenamed({"a": "userid_a", "b": "userid_b"})


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs with three common retweets or more and a ratio to chance of five or more."""
    return p4_pairs(spark, d).select("userid_a", "userid_b")


def _sets(spark: SparkSession, d: str) -> DataFrame:
    return _items(spark, d).select("field", F.col("userid").alias("owner"), F.col("item").alias("value"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of accounts whose sets of five or more values overlap by half or more."""
    pairs = similar_pairs(_sets(spark, d), threshold=0.5, min_size=5)
    return pairs.withColumnsRenamed({"a": "userid_a", "b": "userid_b"})


def p6_classes(spark: SparkSession, d: str) -> DataFrame:
    """One row per account with a partner: its class, named by the smallest account with that set, and the number of similar classes."""
    pairs, members = similar_classes(_sets(spark, d), threshold=0.5, min_size=5)
    members = cut(members, "members")
    ends = pairs.select("field", F.explode(F.array("a", "b")).alias("rep"))
    links = ends.groupBy("field", "rep").agg(F.count("*").alias("n_links"))
    sizes = members.groupBy("field", "rep").agg(F.count("*").alias("n_copies"), F.min("owner").alias("class_id"))
    rows = members.join(sizes, ["field", "rep"]).join(links, ["field", "rep"], "left").fillna(0, ["n_links"])
    return rows.filter("n_links > 0 or n_copies > 1").select("field", F.col("owner").alias("userid"), "class_id", "n_copies", "n_links")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents that share twelve consecutive words or more with a test item."""
    hits = phrase_matches(table(spark, d, "documents"), table(spark, d, "eval_items"), min_words=12)
    return hits.select("doc_id", "item_id").distinct()


def p7_phrases(spark: SparkSession, d: str) -> DataFrame:
    """Where the phrases stand: maximal runs of twelve common words or more, positions from 0."""
    return phrase_matches(table(spark, d, "documents"), table(spark, d, "eval_items"), min_words=12)


def p7_matches(spark: SparkSession, d: str) -> DataFrame:
    """Phrase and proximity matches with the longest common phrase and the words covered."""
    return leaks(table(spark, d, "documents"), table(spark, d, "eval_items"), min_words=12, part_words=6)


def _source(column):
    return F.regexp_replace(F.lower(_trim(column)), "-", "_")


#: Where sources come from; sources of one domain take each other's shortages first.
DOMAINS = {"forge_mirror": "hosting", "campus_git": "hosting", "bitbarn": "hosting", "mail_patches": "lists", "kernel_archive": "lists", "tarball_crawl": "archives", "legacy_cvs": "archives", "docs_wiki": "archives"}
LEVELS = ["domain", "lang", "name"]


def _tree(leaves: list[tuple], targets: list) -> Node:
    """The tree of domains, languages and sources.

    A target is given per source; in each language the source has the part of it
    that its tokens have there, and inner nodes the sum of what is below.  A source
    without tokens stands below the language ``und``.
    """
    shares = {t["name"]: t["target_share"] for t in targets}
    if len(shares) < len(targets):
        raise ValueError("several targets name one source")
    repeats = {t["name"]: t["max_repeats"] for t in targets}
    sizes = Counter()
    for *_, name, size in leaves:
        sizes[name] += size
    weights, caps = Counter(), {}
    ghosts = [(DOMAINS.get(name, "other"), "und", name, 0) for name in shares if not sizes[name]]
    for *path, size in [*leaves, *ghosts]:
        name = path[-1]
        own = shares.get(name, 0.0) * (size / sizes[name] if sizes[name] else 1.0)
        for depth in range(1, len(path) + 1):
            weights[tuple(path[:depth])] += own
        caps[tuple(path)] = repeats.get(name, 0)
    return budget_tree([*leaves, *ghosts], weights, caps)


def _budgets(spark: SparkSession, d: str, tokenizer: str = TOKENIZER):
    """Sized documents, the rows of the targets, the filled tree, and its leaves by source."""
    lang = F.coalesce(F.nullif(F.lower(F.trim("lang")), F.lit("")), F.lit("und"))
    name = _source(F.col("source"))
    domain = F.coalesce(F.create_map(*[F.lit(x) for kv in DOMAINS.items() for x in kv])[name], F.lit("other"))
    documents = table(spark, d, "documents").select("doc_id", domain.alias("domain"), lang.alias("lang"), name.alias("name"), "text")
    sized = cut(token_sizes(documents, ["doc_id", *LEVELS], tokenizer), "sized")
    # one row per source of a mixture, which people write by hand; checked as leaves are
    targets = table(spark, d, "mix_targets").select("source", _source(F.col("source")).alias("name"), "target_share", "max_repeats").limit(MAX_LEAVES + 1).collect()
    if len(targets) > MAX_LEAVES:
        raise ValueError(f"more than {MAX_LEAVES} targets")
    root = _tree(leaf_sizes(sized, LEVELS), targets)
    by_source = defaultdict(list)
    for *path, node in leaves_of(root, len(LEVELS)):
        by_source[path[-1]].append(node)
    return sized, targets, root, by_source


def _short(nodes: list[Node]) -> bool:
    return sum(n.wanted for n in nodes) > sum(n.capacity for n in nodes)


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """Sources that fall short in a mixture as large as all documents."""
    _, targets, _, leaves = _budgets(spark, d)
    return spark.createDataFrame([(t["source"],) for t in targets if _short(leaves[t["name"]])], "source string")


def p8_mixture(spark: SparkSession, d: str) -> DataFrame:
    """How often each document is used in the mixture."""
    sized, _, root, _ = _budgets(spark, d)
    return select_mixture(sized, "doc_id", LEVELS, root, seed=7).withColumnRenamed("name", "source")


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    """Target, size, budget and share reached of each source."""
    sized, targets, root, leaves = _budgets(spark, d)
    reached = totals(select_mixture(sized, "doc_id", LEVELS, root, seed=7), "name")
    whole = sum(reached.values()) or 1
    rows = []
    for t in targets:
        nodes, got = leaves[t["name"]], reached.get(t["name"], 0)
        size, wanted, budget = sum(n.size for n in nodes), sum(n.wanted for n in nodes), sum(n.budget for n in nodes)
        rows.append((t["source"], t["target_share"], t["max_repeats"], size, wanted, budget, got, got / whole, _short(nodes)))
    return spark.createDataFrame(rows, "source string, target_share double, max_repeats int, size bigint, wanted double, budget double, tokens bigint, share double, short boolean")


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents of repeated keywords, lists of links or product tags."""
    return stuffed_documents(table(spark, d, "documents")).select("doc_id")


def p9_redundancy(spark: SparkSession, d: str) -> DataFrame:
    """Compression ratio of every document with content, what its language would have, and its sentence punctuation."""
    return redundancy(table(spark, d, "documents"))


QUERIES = {f.__name__: f for f in (p2_found, p2_counts, p2_bounds, p2_summary, p4_found, p4_pairs, p6_found, p6_classes, p7_found, p7_phrases, p7_matches, p8_found, p8_mixture, p8_shares, p9_found, p9_redundancy)}

_ITEMS_SQL = r"""
WITH posts AS (SELECT *, regexp_replace(retweet_tweetid, '^\s+|\s+$', '', 'g') AS retweet FROM cimaio_posts),
items AS (
  SELECT 'retweet_tweetid' AS field, userid, retweet AS item FROM posts WHERE retweet <> ''
  UNION ALL
  SELECT 'hashtags', userid, lower(regexp_replace(t, '^\s*#*\s*|\s+$', '', 'g'))
  FROM (SELECT userid, unnest(hashtags) AS t FROM posts WHERE retweet IS NULL OR retweet = '')
), filled AS (SELECT * FROM items WHERE item <> '')
"""
_PAIRS_SQL = r"""
WITH e AS (
  SELECT userid AS u, regexp_replace(retweet_tweetid, '^\s+|\s+$', '', 'g') AS i, min(tweet_time) AS t FROM cimaio_posts
  WHERE userid IS NOT NULL AND tweet_time IS NOT NULL AND regexp_replace(retweet_tweetid, '^\s+|\s+$', '', 'g') <> '' GROUP BY 1, 2
), s AS (SELECT u, count(*) AS k FROM e GROUP BY u), n AS (SELECT count(DISTINCT i) AS n FROM e),
p AS (SELECT a.u AS ua, b.u AS ub, count(*) AS n_ab FROM e a JOIN e b ON a.i = b.i AND a.u < b.u AND abs(a.t - b.t) <= 60000 GROUP BY 1, 2 HAVING count(*) >= 3),
r AS (
  SELECT ua AS userid_a, ub AS userid_b, n_ab, x.k AS n_a, y.k AS n_b, n, n_ab * n::DOUBLE / (x.k * y.k) AS lift,
         (1 - y.k / n::DOUBLE) / nullif(1 - n_ab / x.k::DOUBLE, 0) AS conviction
  FROM p JOIN s x ON x.u = ua JOIN s y ON y.u = ub, n WHERE n_ab * n >= 5 * x.k * y.k
)
"""
_LIKE_SQL = (
    _ITEMS_SQL
    + """, sets AS (SELECT DISTINCT field, userid AS u, item FROM filled WHERE userid IS NOT NULL),
sizes AS (SELECT field, u, count(*) AS k FROM sets GROUP BY 1, 2 HAVING count(*) >= 5),
own AS (SELECT sets.*, k FROM sets JOIN sizes USING (field, u)),
alike AS (SELECT a.field, a.u AS userid_a, b.u AS userid_b FROM own a JOIN own b ON a.field = b.field AND a.item = b.item AND a.u < b.u
  GROUP BY 1, 2, 3, a.k, b.k HAVING 2 * count(*) >= a.k + b.k - count(*))
"""
)
_RUNS_SQL = r"""
WITH docs AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents),
items AS (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM eval_items),
item_runs AS (SELECT item_id, i - 1 AS i, array_to_string(w[i:i + 11], ' ') AS run FROM (SELECT item_id, w, unnest(range(1, len(w) - 10)) AS i FROM items)),
doc_runs AS (SELECT doc_id, i - 1 AS d, array_to_string(w[i:i + 11], ' ') AS run FROM (SELECT doc_id, w, unnest(range(1, len(w) - 10)) AS i FROM docs)),
met AS (SELECT doc_id, item_id, d, i FROM doc_runs JOIN item_runs USING (run))
"""
ORACLE = {
    "p2_found": _ITEMS_SQL + "SELECT field, item FROM filled GROUP BY field, item HAVING count(*) * 100 >= (SELECT count(*) FROM filled f WHERE f.field = filled.field)",
    "p2_bounds": _ITEMS_SQL + "SELECT field, item, count(*) AS exact, (SELECT count(*) FROM filled f WHERE f.field = filled.field) AS n, true AS bounds_hold FROM filled GROUP BY field, item HAVING count(*) * 100 >= (SELECT count(*) FROM filled f WHERE f.field = filled.field)",
    "p4_found": _PAIRS_SQL + "SELECT userid_a, userid_b FROM r",
    "p4_pairs": _PAIRS_SQL + "SELECT userid_a, userid_b, n_ab, n_a, n_b, n, round(lift, 9) AS lift, round(conviction, 9) AS conviction FROM r",
    "p6_found": _LIKE_SQL + "SELECT * FROM alike",
    "p6_classes": _LIKE_SQL
    + """, named AS (SELECT field, u, min(u) OVER same AS class_id, count(*) OVER same AS n_copies FROM (SELECT field, u, list_sort(list(item)) AS items FROM own GROUP BY 1, 2) WINDOW same AS (PARTITION BY field, items)),
ends AS (SELECT field, userid_a AS u, userid_b AS v FROM alike UNION ALL SELECT field, userid_b, userid_a FROM alike),
links AS (SELECT x.field, x.class_id, count(DISTINCT y.class_id) AS n FROM ends JOIN named x ON x.field = ends.field AND x.u = ends.u JOIN named y ON y.field = ends.field AND y.u = ends.v WHERE x.class_id <> y.class_id GROUP BY 1, 2)
SELECT field, u AS userid, class_id, n_copies, coalesce(n, 0) AS n_links FROM named LEFT JOIN links USING (field, class_id) WHERE n_copies > 1 OR n > 0""",
    "p7_found": _RUNS_SQL + "SELECT DISTINCT doc_id, item_id FROM met",
    "p7_phrases": _RUNS_SQL
    + """SELECT doc_id, item_id, min(d)::BIGINT AS doc_pos, min(i)::BIGINT AS item_pos, count(*) + 11 AS n_words
FROM (SELECT *, d - row_number() OVER (PARTITION BY doc_id, item_id, d - i ORDER BY d) AS island FROM met) GROUP BY doc_id, item_id, d - i, island""",
}
