"""Queries of the coordinated-activity operators over the post tables, and their SQL.

Accounts are those of ``cimaio_posts``; a null or zero ``good`` marks IO accounts.
The window is a minute unless the name says otherwise.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lockstep.functions import stats
from lockstep.operators import bootstrap, coaction, daily, evaluate, extract, prepare, profile, ranking, weighted
from lockstep.plans.approaches import Lexicographic, create
from lockstep.plans.experiment import bootstrap_samples
from lockstep.session import cut
from lockstep.sources.readers import Dataset
from lockstep.sources.reports import critical_difference, score_matrix
from lockstep.tables import table

WINDOW = 60
_KINDS = {"cimaio": ("cimaio_posts", "CimaIO"), "anon": ("anon_posts", "anonymized"), "twitter": ("twitter_posts", "twitter")}


def _extract(layout: str, what: str):
    name, kind = _KINDS[layout]
    return lambda spark, d: extract.EXTRACTORS[what](table(spark, d, name).withColumnRenamed("user_info", "user"), kind)


def _triples(spark: SparkSession, d: str, label: bool = False) -> DataFrame:
    return extract.retweets(table(spark, d, "cimaio_posts"), "CimaIO", label)


def _events(spark: SparkSession, d: str) -> DataFrame:
    return prepare.earliest(_triples(spark, d))


def _kept(spark: SparkSession, d: str) -> DataFrame:
    return cut(_events(spark, d), "events")


def _labels(spark: SparkSession, d: str) -> DataFrame:
    raw = extract.retweets(table(spark, d, "cimaio_posts").withColumn("tweet_text", F.lit(None).cast("string")), "CimaIO", True)
    return prepare.first_labels(raw, F.struct("ts", "object", F.coalesce("label", F.lit(""))))


def _io(spark: SparkSession, d: str) -> DataFrame:
    return prepare.io_accounts(_labels(spark, d))


def _pairs(spark: SparkSession, d: str, least: int = 1) -> DataFrame:
    return coaction.coaction_counts(_events(spark, d), WINDOW, least, unique=True)


def _weighted(variant: str, least: int = 1):
    return lambda spark, d: weighted.weighted_pairs(_kept(spark, d), variant, WINDOW, least)


def _scores(mode: str):
    return lambda spark, d: ranking.user_scores(weighted.weighted_pairs(_kept(spark, d), "12h", WINDOW), mode)


def _ranking(spark: SparkSession, d: str) -> DataFrame:
    return ranking.rank_users(ranking.user_scores(_pairs(spark, d), "Linf"))


def _ranked(spark: SparkSession, d: str) -> DataFrame:
    return cut(evaluate.labelled(_ranking(spark, d), _io(spark, d)), "ranked")


def _of_ranked(measure):
    return lambda spark, d: measure(_ranked(spark, d))


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Accounts ranked by co-retweets, with labels."""
    return evaluate.labelled(_ranking(spark, d), _io(spark, d)).select("account", "score", "grp", "pos", "is_io")


def _lexicographic(spark: SparkSession, d: str) -> DataFrame:
    spec = {"name": "lexicographic", "approaches": ["coretweets", "coretweets_weighted_12h"], "ranking_modes": ["max", "Linf"], "need_filtering": False}
    approach = create(spec, WINDOW)
    assert isinstance(approach, Lexicographic)
    return approach.rank(_kept(spark, d))


def _curves(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, int]:
    io = _io(spark, d)
    pairs = cut(_pairs(spark, d), "pairs")
    plain = cut(evaluate.labelled(ranking.rank_users(ranking.user_scores(pairs, "Linf")), io), "plain")
    other = ranking.rank_users(ranking.user_scores(pairs, "max"))
    one, two = evaluate.detection_curve(plain), evaluate.detection_curve(evaluate.labelled(other, io))
    return one, two, io.count()


def _area(spark: SparkSession, d: str) -> DataFrame:
    one, two, _ = _curves(spark, d)
    return evaluate.curve_difference(one, two)


def _ideal(spark: SparkSession, d: str) -> DataFrame:
    one, _, n_io = _curves(spark, d)
    return evaluate.curve_difference(one, evaluate.ideal_curve(one, n_io))


#: Ranking modes that are compared, and those of the rank tests.
_MODES, _TESTED = ("max", "L1", "L2", "Linf"), ("max", "L2", "Linf")


def _dataset(spark: SparkSession, d: str, layout: str) -> Dataset:
    """Co-retweets of one table of posts, accounts marked with its name."""
    name, kind = _KINDS[layout]
    posts = table(spark, d, name).withColumnRenamed("user_info", "user")
    triples = extract.retweets(posts, kind, True).withColumn("account", F.concat(F.lit(f"{layout}:"), "account"))
    labels = prepare.first_labels(triples, F.struct("ts", "object", F.coalesce("label", F.lit(""))), known_only=kind == "twitter")
    return Dataset(prepare.earliest(triples), prepare.io_accounts(labels))


def _method_scores(spark: SparkSession, d: str) -> DataFrame:
    """``(dataset, metric, method, score)``: AUC, AP and NDCG of the ranking modes over the three tables of posts, each cut to what all modes rank."""
    ranked, io = [], []
    for i, layout in enumerate(_KINDS):
        data = _dataset(spark, d, layout)
        pairs = cut(coaction.coaction_counts(data.events, WINDOW, unique=True), "pairs")
        io.append(data.io)
        ranked += [ranking.user_scores(pairs, m).select(F.lit(m).alias("method"), F.lit(i).cast("long").alias("iter"), "account", F.col("score").alias("key")) for m in _MODES]
    found = bootstrap.replicate_metrics(reduce(DataFrame.unionByName, ranked), reduce(DataFrame.unionByName, io), len(_KINDS), list(_MODES))
    name = F.element_at(F.array(*[F.lit(k) for k in _KINDS]), (F.col("iter") + 1).cast("int"))
    return found.select(name.alias("dataset"), "metric", "method", F.round("score", 6).alias("score"))


def _best_mode(spark: SparkSession, d: str) -> DataFrame:
    return profile.best_mode(_method_scores(spark, d).filter("metric = 'auc'").select("dataset", F.col("method").alias("mode"), "score"))


def _rank_tests(spark: SparkSession, d: str, test: str) -> DataFrame:
    """Rank tests of the modes over the three datasets, by AUC; signed ranks over all metrics too."""
    scores = cut(_method_scores(spark, d).filter(F.col("method").isin(list(_TESTED))), "method_scores")
    if test == "wilcoxon":
        _, methods, matrix = score_matrix(scores.filter("method <> 'L2'").withColumn("dataset", F.concat_ws("/", "dataset", "metric")))
        w = stats.wilcoxon(np.round(matrix[:, methods.index("max")] - matrix[:, methods.index("Linf")], 6), np.zeros(len(matrix)))
        return spark.createDataFrame([(w.statistic, round(w.median_difference, 6))], "statistic double, median_difference double")
    if test == "critical_difference":
        rows = [(m, round(r, 6), groups) for m, r, groups in critical_difference(scores, "auc")]
        return spark.createDataFrame(rows, "method string, average_rank double, groups array<int>")
    _, methods, matrix = score_matrix(scores.filter("metric = 'auc'"))
    placed = np.array([stats.competition_ranks(row) for row in matrix], float)
    if test == "friedman":
        statistic, p = stats.friedman(placed)
        return spark.createDataFrame([(round(statistic, 6), round(p, 6))], "statistic double, p_value double")
    found = stats.nemenyi(placed)
    rows = [(methods[i], methods[j], round(float(found.p_values[i, j]), 4), round(found.cd, 4), round(found.cd_textbook, 4)) for i in range(len(methods)) for j in range(i)]
    return spark.createDataFrame(rows, "a string, b string, p_value double, cd double, cd_textbook double")


def _truncated(name: str):
    """A metric of the ranking by all pairs, cut to the users that the ranking by two co-actions has too."""

    def query(spark: SparkSession, d: str) -> DataFrame:
        pairs = cut(_pairs(spark, d), "pairs")
        ranked, fewer = (cut(ranking.rank_users(ranking.user_scores(pairs.filter(F.col("score") >= k), "Linf")), "ranked") for k in (1, 2))
        return evaluate.metric(name, cut(evaluate.labelled(ranked, _io(spark, d)), "labelled"), evaluate.common_x_max(ranked, fewer))

    return query


def _all_curves(spark: SparkSession, d: str) -> DataFrame:
    """Detection curves of the ranking modes together."""
    pairs, io = cut(_pairs(spark, d), "pairs"), cut(_io(spark, d), "io")
    of = lambda m: evaluate.detection_curve(cut(evaluate.labelled(ranking.rank_users(ranking.user_scores(pairs, m)), io), m))
    return reduce(DataFrame.unionByName, [of(m).select(F.lit(m).alias("method"), "x", "y") for m in _MODES])


def _difference(spark: SparkSession, d: str) -> DataFrame:
    """Where the pairs with two co-actions differ from all."""
    pairs = cut(_pairs(spark, d), "pairs")
    return coaction.pair_difference(pairs, pairs.filter("score >= 2"))


def _samples(spark: SparkSession, d: str) -> DataFrame:
    """AUC, AP and NDCG of the plain count with one and with two co-actions, in the operator's 1000 replicates, cut to the users both rank."""
    methods = {least: create("coretweets", WINDOW, least) for least in (1, 2)}
    samples = bootstrap_samples(Dataset(_events(spark, d), cut(_io(spark, d), "io")), list(methods.values()))
    least = F.element_at(F.create_map(*[F.lit(x) for k, a in methods.items() for x in (a.name, f"min{k}")]), F.col("method"))
    return samples.select(F.lit("cimaio").alias("dataset"), "metric", least.alias("method"), "iter", "score")


#: Replicates of approaches whose weights are counted anew in each; intervals take the operator's 1000.
REPLICATES = 20
_LEX = {"name": "lexicographic", "approaches": ["coretweets", "coretweets_weighted_12h"], "ranking_modes": ["max", "Linf"]}


def _approach_samples(spark: SparkSession, d: str) -> DataFrame:
    """AUC, AP and NDCG of three approaches in the same replicates, cut to the users all of them rank."""
    methods = {"coretweets": create("coretweets", WINDOW), "weighted_12h": create("coretweets_weighted_12h", WINDOW), "lexicographic": create(_LEX, WINDOW)}
    samples = bootstrap_samples(Dataset(_events(spark, d), cut(_io(spark, d), "io")), list(methods.values()), REPLICATES)
    short = F.create_map(*[F.lit(x) for k, a in methods.items() for x in (a.name, k)])[F.col("method")]
    return samples.select("metric", short.alias("method"), "iter", "score")


QUERIES = {
    "flagship_ranking": flagship,
    "dedup_earliest": _events,
    "index_accounts": lambda s, d: prepare.dictionary(_triples(s, d), "account"),
    "encoded_events": lambda s, d: prepare.encode(_events(s, d), prepare.dictionary(_triples(s, d), "account"), prepare.dictionary(_triples(s, d), "object")),
    "first_labels": _labels,
    "io_accounts": _io,
    "min_participation": lambda s, d: prepare.min_participation(_triples(s, d)),
    "dataset_counts": lambda s, d: prepare.dataset_counts(_triples(s, d)),
    "object_popularity_stats": lambda s, d: prepare.object_popularity(_triples(s, d)),
    "coaction_pairs": _pairs,
    "coaction_pairs_min2": lambda s, d: _pairs(s, d, 2),
    "filter_events_semi": lambda s, d: coaction.synchronous_events(_kept(s, d), WINDOW, 2),
    "same_object_days": lambda s, d: coaction.same_object_days(_events(s, d), WINDOW),
    "ignoring_object_days": lambda s, d: daily.coincide_any_object(_events(s, d), WINDOW),
    "shared_object_days": lambda s, d: daily.coincide_shared_objects(_events(s, d), WINDOW),
    "weighted_1day": _weighted("1day"),
    "weighted_2days": _weighted("2days"),
    "weighted_12h": _weighted("12h"),
    "weighted_12h_min2": _weighted("12h", 2),
    "user_scores_max": _scores("max"),
    "user_scores_l1": _scores("L1"),
    "user_scores_l2": _scores("L2"),
    "user_scores_linf": _scores("Linf"),
    "user_scores_l3": _scores("L3"),
    "ranking_groups": _ranking,
    "legacy_ranking": lambda s, d: ranking.legacy_ranking(_pairs(s, d)),
    "lexicographic": _lexicographic,
    "detection_curve": _of_ranked(evaluate.detection_curve),
    "curve_area_diff": _area,
    "ideal_area": _ideal,
    "io_until_first_other": _of_ranked(evaluate.io_until_first_other),
    "users_to_90pct": _of_ranked(evaluate.users_to_fraction),
    "precision_at_100": _of_ranked(evaluate.precision_at),
    "precision_at_500": _of_ranked(lambda r: evaluate.precision_at(r, 500)),
    "total_io": _of_ranked(evaluate.total_io),
    "total_accounts": _of_ranked(evaluate.total_accounts),
    "auc": _of_ranked(evaluate.roc_auc),
    "average_precision": _of_ranked(evaluate.average_precision),
    "ndcg": _of_ranked(evaluate.ndcg),
    "method_rankings": lambda s, d: evaluate.method_ranks(_method_scores(s, d)),
    "best_ranking_mode": _best_mode,
    "critical_difference": lambda s, d: _rank_tests(s, d, "critical_difference"),
    "auc_truncated": _truncated("auc"),
    "ap_truncated": _truncated("ap"),
    "ndcg_truncated": _truncated("ndcg"),
    "all_curves": _all_curves,
    "top_pairs": lambda s, d: coaction.top_pairs(_pairs(s, d), 5),
    "pair_difference": _difference,
    "grouped_by_object": lambda s, d: prepare.grouped_events(_events(s, d), "object", "account"),
    "grouped_by_account": lambda s, d: prepare.grouped_events(_events(s, d), "account", "object"),
    "activity_stats": lambda s, d: profile.statistics(profile.activity(_triples(s, d), _io(s, d)), ["is_io"], "n_posts"),
    "active_day_stats": lambda s, d: profile.statistics(profile.activity(_triples(s, d), _io(s, d)), ["is_io"], "n_days"),
    "across_datasets": lambda s, d: profile.across_datasets(
        profile.statistics(
            extract.retweets(table(s, d, "cimaio_posts"), "CimaIO").withColumn("dataset", F.lit("cimaio")).unionByName(extract.retweets(table(s, d, "anon_posts"), "anonymized").withColumn("dataset", F.lit("anon"))).groupBy("dataset", "account").agg(F.count("*").alias("n")),
            ["dataset"],
            "n",
        )
    ),
    "user_counts_by_filter": lambda s, d: profile.counts_by_filter(_kept(s, d), _io(s, d), WINDOW),
    "bootstrap_inclusion": lambda s, d: bootstrap.inclusion(_triples(s, d).select("account").distinct(), 3, 42),
    "bootstrap_ci": lambda s, d: bootstrap.percentile_ci(_samples(s, d), ["dataset", "metric", "method"]),
    "paired_diff_ci": lambda s, d: bootstrap.paired_differences(_samples(s, d)),
    "bootstrap_approaches": _approach_samples,
    "weighted_12h_min2_filtered": lambda s, d: create("coretweets_weighted_12h", WINDOW, 2).pairs(_kept(s, d)),
    "bootstrap_whiskers": lambda s, d: bootstrap.difference_whiskers(_samples(s, d)),
    "friedman": lambda s, d: _rank_tests(s, d, "friedman"),
    "nemenyi": lambda s, d: _rank_tests(s, d, "nemenyi"),
    "wilcoxon": lambda s, d: _rank_tests(s, d, "wilcoxon"),
    **{f"extract_{what}_{layout}": _extract(layout, what) for layout in _KINDS for what in extract.EXTRACTORS},
}

_NORMAL = r"trim(regexp_replace(regexp_replace(lower({}), '@[\p{{L}}\p{{N}}_]+', '', 'g'), '[\s\x{{A0}}]+', ' ', 'g'))"
_T = "t AS (SELECT userid AS account, retweet_tweetid AS object, make_timestamp(tweet_time * 1000) AS ts, good FROM cimaio_posts WHERE retweet_tweetid IS NOT NULL AND userid IS NOT NULL AND tweet_time IS NOT NULL)"
_E = _T + ", e AS (SELECT account, object, min(ts) AS ts FROM t GROUP BY 1, 2)"
_MET = _E + ", met AS (SELECT DISTINCT a.account AS u1, b.account AS u2, a.object, a.ts AS ta, b.ts AS tb FROM e a JOIN e b ON a.object = b.object AND a.account < b.account AND abs(epoch_us(a.ts) - epoch_us(b.ts)) <= 60000000)"
_P = _MET + ", pairs AS (SELECT u1, u2, count(DISTINCT object) AS score FROM met GROUP BY 1, 2)"
_IO = "lab AS (SELECT account, (min(ROW(ts, object, coalesce(good::VARCHAR, ''), good))) AS r FROM t GROUP BY 1), labels AS (SELECT account, CASE WHEN struct_extract(r, 3) = '' THEN NULL ELSE struct_extract(r, 3) END AS label FROM lab), io AS (SELECT account FROM labels WHERE label IS NULL OR label = '0')"


def _ends(pairs: str) -> str:
    return f"ends AS (SELECT u1 AS account, score::DOUBLE AS score FROM {pairs} WHERE score <> 0 UNION ALL SELECT u2, score FROM {pairs} WHERE score <> 0)"


_SCORE = {"max": "max(score)", "l1": "median(score)", "l2": "avg(score)", "linf": "(min(score) + max(score)) / 2"}
_R = _P + ", " + _IO + ", " + _ends("pairs")


def _rank(aggregate: str, name: str) -> str:
    return (
        f"{name}_s AS (SELECT account, round({aggregate}, 9) AS score FROM ends GROUP BY 1), {name} AS (SELECT account, score, dense_rank() OVER (ORDER BY score DESC) - 1 AS grp, "
        f"row_number() OVER (ORDER BY score DESC, account) AS pos, account IN (SELECT account FROM io) AS is_io FROM {name}_s)"
    )


def _groups(name: str, out: str) -> str:
    return (
        f"{out} AS (SELECT grp, n, ios, coalesce(sum(n) OVER w, 0) AS before, coalesce(sum(ios) OVER w, 0) AS ios_before FROM (SELECT grp, count(*) AS n, count(*) FILTER (WHERE is_io) AS ios FROM {name} GROUP BY 1) "
        "WINDOW w AS (ORDER BY grp ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"
    )


def _curve(name: str, out: str) -> str:
    return f"{out} AS (SELECT 0::BIGINT AS x, 0::DOUBLE AS y UNION ALL SELECT (before + i)::BIGINT, round(ios_before + ios * i::DOUBLE / n, 9) FROM (SELECT *, unnest(range(1, n + 1)) AS i FROM {name}))"


_RANKED = f"WITH {_R}, {_rank(_SCORE['linf'], 'r')}, {_groups('r', 'g')} "
_CUT = f"WITH {_R}, {_rank(_SCORE['linf'], 'r')}, rc AS (SELECT * FROM r WHERE pos <= (SELECT count(DISTINCT u) FROM (SELECT unnest([u1, u2]) AS u FROM pairs WHERE score >= 2))), {_groups('rc', 'g')} "
_AUC = "CASE WHEN sum(ios) > 0 AND sum(n - ios) > 0 THEN round(1 - sum(ios * (before - ios_before + (n - ios) / 2.0)) / (sum(ios) * sum(n - ios)), 9) ELSE 0 END::DOUBLE"
def _weights(variant: str, least: int = 1) -> str:
    bucket = {"12h": "date_trunc('day', {0}) + CASE WHEN hour({0}) BETWEEN 5 AND 16 THEN INTERVAL 5 HOUR ELSE INTERVAL 17 HOUR END"}.get(variant, "date_trunc('day', {0})")
    b = lambda c: "(" + bucket.format(c) + ")"
    following = " + coalesce(q0.n, 0) + coalesce(q1.n, 0)" if variant == "2days" else ""
    joins = " LEFT JOIN pop q0 ON q0.object = s.object AND q0.b = s.b0 + INTERVAL 1 DAY LEFT JOIN pop q1 ON q1.object = s.object AND q1.b = s.b1 + INTERVAL 1 DAY" if following else ""
    return (
        f"{_MET}, all_s AS (SELECT DISTINCT u1, u2, object, CASE WHEN ta <= tb THEN {b('ta')} ELSE {b('tb')} END::TIMESTAMP AS b0, CASE WHEN ta <= tb THEN {b('tb')} ELSE {b('ta')} END::TIMESTAMP AS b1 FROM met), "
        f"s AS (SELECT * FROM all_s QUALIFY count(*) OVER (PARTITION BY u1, u2) >= {least}), bs AS (SELECT b0 AS b FROM s UNION SELECT b1 FROM s), "
        f"pop AS (SELECT object, {b('ts')}::TIMESTAMP AS b, count(*) AS n FROM e WHERE object IN (SELECT object FROM s) AND {b('ts')}::TIMESTAMP IN (SELECT b FROM bs) GROUP BY 1, 2), "
        "tot AS (SELECT object, count(*) AS total FROM e GROUP BY 1), "
        f"w AS (SELECT u1, u2, round(sum((coalesce(p0.n, 0) + coalesce(p1.n, 0){following}) / (2.0::DOUBLE * total)), 9) AS score FROM s JOIN tot USING (object) "
        f"LEFT JOIN pop p0 ON p0.object = s.object AND p0.b = s.b0 LEFT JOIN pop p1 ON p1.object = s.object AND p1.b = s.b1{joins} GROUP BY 1, 2 HAVING score > 0)"
    )


def _stats_sql(column: str) -> str:
    r = lambda c: f"round(coalesce({c}, 0)::DOUBLE, 9)"
    v = f"{column}::DOUBLE"
    return (
        f"WITH {_T}, {_IO}, a AS (SELECT account, account IN (SELECT account FROM io) AS is_io, count(*) AS n_posts, count(DISTINCT ts::DATE) AS n_days FROM t GROUP BY 1) "
        f"SELECT is_io, count({column}) AS count, {r(f'avg({v})')} AS mean, {r(f'median({v})')} AS median, {r(f'stddev_pop({v})')} AS std, {r(f'sum({v})')} AS total FROM a GROUP BY 1"
    )


def _extract_sql(layout: str, what: str) -> str:
    table_, account, ts, tags, text, obj, repost, original = {
        "cimaio": ("cimaio_posts", "userid", "make_timestamp(tweet_time * 1000)", "hashtags", "tweet_text", "retweet_tweetid", "retweet_tweetid IS NOT NULL", "coalesce(retweet_tweetid, '') = ''"),
        "anon": ("anon_posts", "accountid", "post_time::TIMESTAMP", "hashtags", "post_text", "reposted_postid", "coalesce(is_repost, false)", "NOT coalesce(is_repost, false)"),
        "twitter": (
            "twitter_posts", "author_id", r"CASE WHEN regexp_full_match(created_at, '\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}\.\d{1,6}Z') THEN try_cast(replace(replace(created_at, 'T', ' '), 'Z', '') AS TIMESTAMP) END",
            "list_transform(referenced_tweets[1].hashtags, lambda h: coalesce(nullif(h.tag, ''), nullif(h.\"text\", ''), nullif(h.\"name\", '')))", '"text"', "referenced_tweets[1].id",
            "coalesce(referenced_tweets[1].\"type\" = 'retweeted', false)", "NOT coalesce(referenced_tweets[1].\"type\" = 'retweeted', false)",
        ),
    }[layout]
    object_, keep = {"retweets": (obj, repost), "hashtags": (f"unnest({tags})", original), "same_content": (f"coalesce({_NORMAL.format(text)}, '')", original)}[what]
    inner = f"SELECT {account} AS account, {object_} AS object, {ts} AS ts FROM {table_} WHERE {keep}"
    return f"SELECT * FROM ({inner}) WHERE account IS NOT NULL AND object IS NOT NULL AND ts IS NOT NULL" + ("" if what == "retweets" else " AND object <> ''")


def _inclusion_sql(iterations: int) -> str:
    step = lambda m: f"((x * x) % 2147483647 * {m} + x + 11) % 2147483647"
    return (
        "acc AS (SELECT account, row_number() OVER (ORDER BY account) - 1 AS idx FROM (SELECT DISTINCT account FROM t)), k AS (SELECT count(*) AS n FROM acc), "
        f"d0 AS (SELECT iter, ((iter * 1000003 + draw * 7919 + 42 * 104729 + 12345) % 2147483647) AS x FROM (SELECT unnest(range({iterations})) AS iter), (SELECT unnest(range(n)) AS draw FROM k)), "
        f"d1 AS (SELECT iter, {step(48271)} AS x FROM d0), d2 AS (SELECT iter, {step(69621)} AS x FROM d1), d3 AS (SELECT iter, {step(39373)} AS x FROM d2), "
        "d AS (SELECT DISTINCT iter, x % n AS idx FROM d3, k), inc AS (SELECT iter, account FROM d JOIN acc USING (idx))"
    )


_INC = f"WITH {_T}, {_inclusion_sql(3)} SELECT iter, account FROM inc"


def _measures_sql(users: str, iterations: int, methods: list[str]) -> str:
    """``samples(metric, method, iter, score)`` of ``users(method, iter, account, key)``, cut to the users that all methods rank."""
    names = ", ".join(f"'{m}'" for m in methods)
    gain = "1 / log2(pos + 1)"
    return (
        f"every AS (SELECT iter, method FROM (SELECT unnest(range({iterations})) AS iter), (SELECT unnest([{names}]) AS method)), "
        f"sizes AS (SELECT every.iter, every.method, count(account) AS users FROM every LEFT JOIN {users} USING (method, iter) GROUP BY 1, 2), x_max AS (SELECT iter, min(users) AS x_max FROM sizes GROUP BY 1), "
        f"placed AS (SELECT method, iter, key, row_number() OVER (PARTITION BY method, iter ORDER BY key DESC, account) AS pos, account IN (SELECT account FROM io) AS is_io FROM {users}), "
        f"bg AS (SELECT method, iter, key, count(*) AS n, count(*) FILTER (WHERE is_io) AS ios, min(pos) - 1 AS before, sum({gain}) AS d FROM placed JOIN x_max USING (iter) WHERE pos <= x_max GROUP BY 1, 2, 3), "
        "bs AS (SELECT *, coalesce(sum(ios) OVER (PARTITION BY method, iter ORDER BY before ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ios_before FROM bg), "
        "bm AS (SELECT method, iter, sum(ios) AS p, sum(n - ios) AS q, sum(ios * (before - ios_before + (n - ios) / 2.0::DOUBLE)) AS lost, sum(ios * (ios_before + ios)::DOUBLE / (before + n)) AS steps, sum(ios * d / n) AS dcg FROM bs GROUP BY 1, 2), "
        "best AS (SELECT p, (SELECT sum(1 / log2(i + 1)) FROM unnest(range(1, p::BIGINT + 1)) AS u(i)) AS best FROM (SELECT DISTINCT p FROM bm WHERE p > 0)), "
        "bv AS (SELECT method, iter, CASE WHEN p > 0 AND q > 0 THEN 1 - lost / (p * q) END AS auc, CASE WHEN p > 0 THEN steps / p END AS ap, CASE WHEN p > 0 AND p + q >= 2 THEN dcg / best END AS ndcg FROM bm LEFT JOIN best USING (p)), "
        + "samples AS ("
        + " UNION ALL ".join(f"SELECT '{m}' AS metric, method, iter, round(coalesce({m}, 0), 9) AS score FROM every LEFT JOIN bv USING (method, iter)" for m in ("auc", "ap", "ndcg"))
        + ")"
    )


_KEYS_OF_PAIRS = "JOIN inc a ON a.account = u1 JOIN inc b ON b.account = u2 AND b.iter = a.iter"
_SAMPLES = (
    f"WITH {_R}, {_inclusion_sql(1000)}, "
    f"bends AS (SELECT 'min' || least_ AS method, a.iter, unnest([u1, u2]) AS account, score FROM pairs JOIN (SELECT unnest([1, 2]) AS least_) ON score >= least_ {_KEYS_OF_PAIRS}), "
    "busers AS (SELECT method, iter, account, round((min(score) + max(score)) / 2, 9) AS key FROM bends GROUP BY 1, 2, 3), " + _measures_sql("busers", 1000, ["min1", "min2"])
)
_HALF = "(date_trunc('day', {0}) + CASE WHEN hour({0}) BETWEEN 5 AND 16 THEN INTERVAL 5 HOUR ELSE INTERVAL 17 HOUR END)::TIMESTAMP"
_APPROACHES = (
    f"WITH {_MET}, {_IO}, {_inclusion_sql(REPLICATES)}, bmet AS (SELECT a.iter, u1, u2, object, ta, tb FROM met {_KEYS_OF_PAIRS}), "
    "bpairs AS (SELECT iter, u1, u2, count(DISTINCT object) AS score FROM bmet GROUP BY 1, 2, 3), "
    "bin AS (SELECT DISTINCT iter, unnest([u1, u2]) AS account FROM bmet), be AS (SELECT iter, account, object, ts FROM e JOIN bin USING (account)), "
    f"bsup AS (SELECT DISTINCT iter, u1, u2, object, {_HALF.format('least(ta, tb)')} AS b0, {_HALF.format('greatest(ta, tb)')} AS b1 FROM bmet), "
    f"bbuck AS (SELECT DISTINCT iter, unnest([b0, b1]) AS b FROM bsup), bpop AS (SELECT iter, object, {_HALF.format('ts')} AS b, count(*) AS n FROM be GROUP BY 1, 2, 3), "
    "bpop2 AS (SELECT iter, object, b, n FROM bpop JOIN bbuck USING (iter, b)), btot AS (SELECT iter, object, count(*) AS total FROM be GROUP BY 1, 2), "
    "bw AS (SELECT s.iter, u1, u2, round(sum((coalesce(p0.n, 0) + coalesce(p1.n, 0)) / (2.0::DOUBLE * total)), 9) AS score FROM bsup s JOIN btot USING (iter, object) "
    "LEFT JOIN bpop2 p0 ON p0.iter = s.iter AND p0.object = s.object AND p0.b = s.b0 LEFT JOIN bpop2 p1 ON p1.iter = s.iter AND p1.object = s.object AND p1.b = s.b1 GROUP BY 1, 2, 3), "
    "cu AS (SELECT iter, account, max(score)::DOUBLE AS top, round((min(score) + max(score)) / 2, 9) AS mid FROM (SELECT iter, unnest([u1, u2]) AS account, score FROM bpairs) GROUP BY 1, 2), "
    "wu AS (SELECT iter, account, round((min(score) + max(score)) / 2, 9) AS mid FROM (SELECT iter, unnest([u1, u2]) AS account, score FROM bw WHERE score > 0) GROUP BY 1, 2), "
    "ausers AS (SELECT 'coretweets' AS method, iter, account, [mid] AS key FROM cu UNION ALL SELECT 'weighted_12h', iter, account, [mid] FROM wu "
    "UNION ALL SELECT 'lexicographic', iter, account, [top, coalesce(wu.mid, '-inf'::DOUBLE)] FROM cu LEFT JOIN wu USING (iter, account)), " + _measures_sql("ausers", REPLICATES, ["coretweets", "weighted_12h", "lexicographic"])
)
_LAYOUTS = (
    "lt AS (SELECT 'cimaio:' || userid AS account, retweet_tweetid AS object, make_timestamp(tweet_time * 1000) AS ts, good::VARCHAR AS label, 0 AS iter FROM cimaio_posts WHERE retweet_tweetid IS NOT NULL AND userid IS NOT NULL AND tweet_time IS NOT NULL "
    "UNION ALL SELECT 'anon:' || accountid, reposted_postid, post_time::TIMESTAMP, is_control::VARCHAR, 1 FROM anon_posts WHERE is_repost AND accountid IS NOT NULL AND reposted_postid IS NOT NULL AND post_time IS NOT NULL "
    "UNION ALL SELECT * FROM (SELECT 'twitter:' || author_id AS account, referenced_tweets[1].id AS object, CASE WHEN regexp_full_match(created_at, '\\d{4}-\\d{2}-\\d{2}T\\d{2}:\\d{2}:\\d{2}\\.\\d{1,6}Z') THEN try_cast(replace(replace(created_at, 'T', ' '), 'Z', '') AS TIMESTAMP) END AS ts, user_info.username, 2 FROM twitter_posts WHERE referenced_tweets[1].\"type\" = 'retweeted') WHERE account IS NOT NULL AND object IS NOT NULL AND ts IS NOT NULL), "
    "le AS (SELECT iter, account, object, min(ts) AS ts FROM lt GROUP BY 1, 2, 3), "
    "lfirst AS (SELECT account, min(ROW(ts, object, coalesce(label, ''))) AS r FROM lt WHERE iter < 2 OR label IS NOT NULL GROUP BY 1), io AS (SELECT account FROM lfirst WHERE struct_extract(r, 3) IN ('', '0')), "
    "lp AS (SELECT a.iter, a.account AS u1, b.account AS u2, count(DISTINCT a.object) AS score FROM le a JOIN le b ON a.iter = b.iter AND a.object = b.object AND a.account < b.account AND abs(epoch_us(a.ts) - epoch_us(b.ts)) <= 60000000 GROUP BY 1, 2, 3), "
    "lends AS (SELECT iter, unnest([u1, u2]) AS account, score::DOUBLE AS score FROM lp), musers AS ("
    + " UNION ALL ".join(f"SELECT '{n}' AS method, iter, account, round({_SCORE[m]}, 9) AS key FROM lends GROUP BY 2, 3" for n, m in (("max", "max"), ("L1", "l1"), ("L2", "l2"), ("Linf", "linf")))
    + "), "
    + _measures_sql("musers", 3, ["max", "L1", "L2", "Linf"])
    + ", ms AS (SELECT ['cimaio', 'anon', 'twitter'][iter + 1] AS dataset, metric, method, round(score, 6) AS score FROM samples)"
)
_TESTED_SQL = (
    f"WITH {_LAYOUTS}, f AS (SELECT dataset, method, rank() OVER w + (count(*) OVER (PARTITION BY dataset, score) - 1) / 2.0::DOUBLE AS r, count(*) OVER (PARTITION BY dataset, score) AS t "
    "FROM ms WHERE metric = 'auc' AND method <> 'L1' WINDOW w AS (PARTITION BY dataset ORDER BY score DESC)) "
)
_GAPS = _SAMPLES + ", gaps AS (SELECT a.metric, a.method AS method_a, b.method AS method_b, a.score - b.score AS d FROM samples a JOIN samples b ON a.metric = b.metric AND a.iter = b.iter AND a.method < b.method) "


def _days_sql(shared: bool) -> str:
    """Moments of both accounts folded in order of time: each takes the oldest of the other side that still waits."""
    own = "object IN (SELECT object FROM e x WHERE x.account = u1 INTERSECT SELECT object FROM e y WHERE y.account = u2)" if shared else "true"
    waits = "list_filter(s.waiting, lambda x: m.us - x <= 60000000)"
    return (
        f"WITH {_E}, c AS (SELECT account, object, epoch_us(ts) AS us, us // 60000000 AS cell FROM e), "
        "near AS (SELECT DISTINCT least(a.account, b.account) AS u1, greatest(a.account, b.account) AS u2 FROM c a JOIN (SELECT *, unnest([cell, cell - 1]) AS at FROM c) b ON a.cell = b.at AND a.account <> b.account AND b.us - a.us BETWEEN 0 AND 60000000), "
        f"m AS (SELECT u1, u2, us, CASE WHEN account = u1 THEN 0 ELSE 1 END AS side FROM near JOIN c ON account IN (u1, u2) WHERE {own}), "
        "l AS (SELECT u1, u2, list({'us': us, 'side': side, 'waiting': []::BIGINT[], 'days': []::BIGINT[]} ORDER BY us, side) AS l FROM m GROUP BY 1, 2), "
        f"r AS (SELECT u1, u2, list_reduce(list_prepend({{'us': 0::BIGINT, 'side': -1, 'waiting': []::BIGINT[], 'days': []::BIGINT[]}}, l), lambda s, m: CASE WHEN len({waits}) > 0 AND s.side <> m.side "
        f"THEN {{'us': m.us, 'side': s.side, 'waiting': ({waits})[2:], 'days': list_append(s.days, m.us // 86400000000)}} ELSE {{'us': m.us, 'side': m.side, 'waiting': list_append({waits}, m.us), 'days': s.days}} END) AS r FROM l) "
        "SELECT u1, u2, len(list_distinct(r.days))::BIGINT AS n_days FROM r WHERE len(r.days) > 0"
    )


ORACLE = {
    "flagship_ranking": _RANKED + "SELECT account, score, grp, pos, is_io FROM r",
    "dedup_earliest": f"WITH {_E} SELECT * FROM e",
    "index_accounts": f"WITH {_T} SELECT account, row_number() OVER (ORDER BY account) - 1 AS idx FROM (SELECT DISTINCT account FROM t)",
    "encoded_events": f"WITH {_E}, u AS (SELECT account, row_number() OVER (ORDER BY account) - 1 AS user_id FROM (SELECT DISTINCT account FROM t)), o AS (SELECT object, row_number() OVER (ORDER BY object) - 1 AS object_id FROM (SELECT DISTINCT object FROM t)) SELECT user_id, object_id, ts FROM e JOIN u USING (account) JOIN o USING (object)",
    "first_labels": f"WITH {_T}, {_IO} SELECT account, label FROM labels",
    "io_accounts": f"WITH {_T}, {_IO} SELECT account FROM io",
    "min_participation": f"WITH {_T} SELECT account, object, ts FROM t QUALIFY count(*) OVER (PARTITION BY account) >= 2",
    "dataset_counts": f"WITH {_T} SELECT count(DISTINCT object) AS n_objects, count(DISTINCT account) AS n_accounts, count(*) AS n_events FROM t",
    "object_popularity_stats": f"WITH {_T} SELECT count(*) AS n_objects, round(avg(n), 9) AS avg_events, max(n) AS max_events FROM (SELECT object, count(*) AS n FROM t GROUP BY 1)",
    "coaction_pairs": f"WITH {_P} SELECT * FROM pairs",
    "coaction_pairs_min2": f"WITH {_P} SELECT * FROM pairs WHERE score >= 2",
    "filter_events_semi": f"WITH {_P} SELECT account, object, ts FROM e WHERE account IN (SELECT u1 FROM pairs WHERE score >= 2 UNION SELECT u2 FROM pairs WHERE score >= 2)",
    "same_object_days": f"WITH {_MET} SELECT u1, u2, count(DISTINCT greatest(ta, tb)::DATE) AS n_days FROM met GROUP BY 1, 2",
    "ignoring_object_days": _days_sql(False),
    "shared_object_days": _days_sql(True),
    "weighted_1day": f"WITH {_weights('1day')} SELECT * FROM w",
    "weighted_2days": f"WITH {_weights('2days')} SELECT * FROM w",
    "weighted_12h": f"WITH {_weights('12h')} SELECT * FROM w",
    "weighted_12h_min2": f"WITH {_weights('12h', 2)} SELECT * FROM w",
    **{f"user_scores_{m}": f"WITH {_weights('12h')}, {_ends('w')} SELECT account, round({a}, 9) AS score FROM ends GROUP BY 1" for m, a in _SCORE.items()},
    "user_scores_l3": f"WITH {_weights('12h')}, {_ends('w')}, v AS (SELECT account, list(score) AS v, min(score) AS lo, max(score) AS hi FROM ends GROUP BY 1), "
    "b AS (SELECT account, v, lo, hi, list_reduce(list_transform(range(101), lambda i: {'a': 0.0::DOUBLE, 'b': 1.0::DOUBLE}), lambda s, m: CASE WHEN list_sum(list_transform(v, lambda x: sign((s.a + s.b) / 2 - (x - lo) / (hi - lo)) * pow((s.a + s.b) / 2 - (x - lo) / (hi - lo), 2))) < 0 "
    "THEN {'a': (s.a + s.b) / 2, 'b': s.b} ELSE {'a': s.a, 'b': (s.a + s.b) / 2} END) AS z FROM v WHERE hi > lo) "
    "SELECT account, CASE WHEN len(v) = 1 THEN lo ELSE round(lo, 2) END AS score FROM v WHERE hi = lo UNION ALL SELECT account, round(lo + (hi - lo) * (z.a + z.b) / 2, 2) FROM b",
    "ranking_groups": _RANKED + "SELECT account, score, grp, pos FROM r",
    "legacy_ranking": f"WITH {_R}, {_rank('max(score)', 'r')} SELECT account, score, grp, pos FROM r",
    "lexicographic": f"WITH {_weights('12h')}, pairs AS (SELECT u1, u2, count(DISTINCT object) AS score FROM met GROUP BY 1, 2), "
    + "c AS (SELECT account, max(score)::DOUBLE AS score FROM (SELECT u1 AS account, score FROM pairs UNION ALL SELECT u2, score FROM pairs) GROUP BY 1), "
    + "v AS (SELECT account, round((min(score) + max(score)) / 2, 9) AS score FROM (SELECT u1 AS account, score FROM w UNION ALL SELECT u2, score FROM w) GROUP BY 1) "
    + "SELECT account, dense_rank() OVER (ORDER BY c.score DESC, v.score DESC NULLS LAST) - 1 AS grp, row_number() OVER (ORDER BY c.score DESC, v.score DESC NULLS LAST, account) AS pos FROM c LEFT JOIN v USING (account)",
    "detection_curve": _RANKED + ", " + _curve("g", "c") + " SELECT x, y FROM c",
    "curve_area_diff": _RANKED + f", {_rank('max(score)', 'r2')}, {_groups('r2', 'g2')}, {_curve('g', 'c')}, {_curve('g2', 'c2')} SELECT round(sum(c.y - c2.y), 6) AS area, round(sum(least(0, c.y - c2.y)), 6) AS negative_area FROM c JOIN c2 USING (x)",
    "ideal_area": _RANKED + f", {_curve('g', 'c')}, k AS (SELECT count(*) AS n FROM io) SELECT round(sum(y - least(x, n)), 6) AS area, round(sum(least(0, y - least(x, n))), 6) AS negative_area FROM c, k",
    "io_until_first_other": _RANKED + "SELECT coalesce(sum(n), 0)::BIGINT AS value FROM g WHERE grp < coalesce((SELECT min(grp) FROM g WHERE ios < n), 9223372036854775807)",
    "users_to_90pct": _RANKED + ", " + _curve("g", "c") + " SELECT coalesce(min(x), 0)::BIGINT AS value FROM c WHERE x > 0 AND y >= (SELECT nullif(ceil(sum(ios) * 0.9), 0) FROM g)",
    "precision_at_100": _RANKED + "SELECT count(*) FILTER (WHERE is_io AND pos <= 100) / 100.0::DOUBLE AS value FROM r",
    "precision_at_500": _RANKED + "SELECT count(*) FILTER (WHERE is_io AND pos <= 500) / 500.0::DOUBLE AS value FROM r",
    "total_io": _RANKED + "SELECT count(*) AS value FROM r WHERE is_io",
    "total_accounts": _RANKED + "SELECT count(*) AS value FROM r",
    "auc": _RANKED + f"SELECT {_AUC} AS value FROM g",
    "average_precision": _RANKED + "SELECT round(sum(ios * (ios_before + ios)::DOUBLE / (before + n)) / sum(ios), 9) AS value FROM g",
    "ndcg": _RANKED + ", d AS (SELECT grp, count(*) AS n, count(*) FILTER (WHERE is_io) AS ios, sum(1 / log2(pos + 1)) AS d FROM r GROUP BY 1), p AS (SELECT sum(ios) AS p FROM d) SELECT round((SELECT sum(ios * d / n) FROM d) / (SELECT sum(1 / log2(pos + 1)) FROM r, p WHERE pos <= p), 9) AS value",
    "method_rankings": f"WITH {_LAYOUTS} SELECT dataset, metric, method, score, rank() OVER (PARTITION BY dataset, metric ORDER BY score DESC) AS rank FROM ms",
    "best_ranking_mode": f"WITH {_LAYOUTS}, b AS (SELECT method AS mode, round(avg(score), 9) AS mean, round(stddev_pop(score), 9) AS std FROM ms WHERE metric = 'auc' GROUP BY 1) SELECT mode, CASE mode WHEN 'max' THEN 2e9 WHEN 'Linf' THEN 1e9 WHEN 'L1' THEN 1 ELSE 2 END::DOUBLE AS place, mean, std, row_number() OVER (ORDER BY mean DESC, mode DESC) = 1 AS best FROM b",
    "auc_truncated": _CUT + f"SELECT {_AUC} AS value FROM g",
    "ap_truncated": _CUT + "SELECT round(sum(ios * (ios_before + ios)::DOUBLE / (before + n)) / sum(ios), 9) AS value FROM g",
    "ndcg_truncated": _CUT + ", d AS (SELECT grp, count(*) AS n, count(*) FILTER (WHERE is_io) AS ios, sum(1 / log2(pos + 1)) AS d FROM rc GROUP BY 1), p AS (SELECT sum(ios) AS p FROM d) SELECT round((SELECT sum(ios * d / n) FROM d) / (SELECT sum(1 / log2(pos + 1)) FROM rc, p WHERE pos <= p), 9) AS value",
    "all_curves": f"WITH {_R}, " + ", ".join(f"{_rank(_SCORE[m], f'r_{m}')}, {_groups(f'r_{m}', f'g_{m}')}, {_curve(f'g_{m}', f'c_{m}')}" for m in _SCORE) + " " + " UNION ALL ".join(f"SELECT '{n}' AS method, x, y FROM c_{m}" for n, m in (("max", "max"), ("L1", "l1"), ("L2", "l2"), ("Linf", "linf"))),
    "top_pairs": f"WITH {_P} SELECT * FROM pairs ORDER BY score DESC, u1, u2 LIMIT 5",
    "pair_difference": f"WITH {_P}, two AS (SELECT * FROM pairs WHERE score >= 2) SELECT 'first' AS side, * FROM (SELECT * FROM pairs EXCEPT ALL SELECT * FROM two) UNION ALL SELECT 'second', * FROM (SELECT * FROM two EXCEPT ALL SELECT * FROM pairs)",
    "grouped_by_object": f"WITH {_E} SELECT * FROM e",
    "grouped_by_account": f"WITH {_E} SELECT * FROM e",
    "activity_stats": _stats_sql("n_posts"),
    "active_day_stats": _stats_sql("n_days"),
    "across_datasets": f"WITH {_T}, a AS (SELECT 'cimaio' AS dataset, account, count(*) AS n FROM t GROUP BY 2 UNION ALL SELECT 'anon', accountid, count(*) FROM anon_posts WHERE is_repost AND accountid IS NOT NULL AND reposted_postid IS NOT NULL AND post_time IS NOT NULL GROUP BY 2), s AS (SELECT dataset, count(*) AS count, round(avg(n), 9) AS mean, round(stddev_pop(n), 9) AS std FROM a GROUP BY 1) SELECT * FROM s UNION ALL SELECT 'Across datasets', count(*), round(avg(mean), 9), round(stddev_pop(mean), 9) FROM s",
    "user_counts_by_filter": f"WITH {_P}, {_IO}, k AS (SELECT 1 AS k UNION ALL SELECT 2), m AS (SELECT k, u FROM (SELECT k, unnest([u1, u2]) AS u FROM pairs JOIN k ON score >= k)) "
    + "SELECT 'none' AS filter, count(DISTINCT account) AS n_users, count(DISTINCT account) FILTER (WHERE account IN (SELECT account FROM io)) AS n_io, 0::BIGINT AS n_pairs FROM e "
    + "UNION ALL SELECT 'min' || k.k, count(DISTINCT u), count(DISTINCT u) FILTER (WHERE u IN (SELECT account FROM io)), (SELECT count(*) FROM pairs WHERE score >= k.k) FROM k LEFT JOIN m ON m.k = k.k GROUP BY k.k",
    "bootstrap_inclusion": _INC,
    "bootstrap_approaches": _APPROACHES + " SELECT metric, method, iter, score FROM samples",
    # events of accounts with a pair only
    "weighted_12h_min2_filtered": f"WITH {_T}, e0 AS (SELECT account, object, min(ts) AS ts FROM t GROUP BY 1, 2), with_pair AS (SELECT DISTINCT a.account FROM e0 a JOIN e0 b ON a.object = b.object AND a.account <> b.account AND abs(epoch_us(a.ts) - epoch_us(b.ts)) <= 60000000), "
    + _weights("12h", 2).replace(_E, "e AS (SELECT * FROM e0 WHERE account IN (SELECT account FROM with_pair))")
    + " SELECT * FROM w",
    "bootstrap_ci": _SAMPLES + " SELECT 'cimaio' AS dataset, metric, method, round(avg(score), 9) AS mean, round(quantile_cont(score, 0.025), 9) AS lower, round(quantile_cont(score, 0.975), 9) AS upper FROM samples GROUP BY metric, method",
    "paired_diff_ci": _GAPS + "SELECT 'cimaio' AS dataset, metric, method_a, method_b, round(avg(d), 9) AS mean, round(quantile_cont(d, 0.0125), 9) AS lower, round(quantile_cont(d, 0.9875), 9) AS upper, quantile_cont(d, 0.0125) > 0 OR quantile_cont(d, 0.9875) < 0 AS significant FROM gaps GROUP BY metric, method_a, method_b",
    "bootstrap_whiskers": _GAPS + "SELECT 'cimaio' AS dataset, metric, method_a, method_b, " + ", ".join(f"round(quantile_cont(d, {q}), 9) AS {n}" for n, q in (("low", 0.0125), ("q1", 0.25), ("median", 0.5), ("q3", 0.75), ("high", 0.9875))) + " FROM gaps GROUP BY metric, method_a, method_b",
    "friedman": _TESTED_SQL
    + ", m AS (SELECT method, sum(r) AS s FROM f GROUP BY 1), c AS (SELECT 1 - sum(t * t - 1)::DOUBLE / (3 * 3 * 8) AS c FROM f), x AS (SELECT CASE WHEN c = 0 THEN 0 ELSE (12.0::DOUBLE / (3 * 3 * 4) * sum(s * s) - 3 * 3 * 4) / c END AS x FROM m, c GROUP BY c) SELECT round(x, 6) AS statistic, round(exp(-x / 2), 6) AS p_value FROM x",
    "wilcoxon": f"WITH {_LAYOUTS}, w AS (SELECT round(a.score - b.score, 6) AS d FROM ms a JOIN ms b USING (dataset, metric) WHERE a.method = 'max' AND b.method = 'Linf'), "
    "r AS (SELECT d, rank() OVER (ORDER BY abs(d)) + (count(*) OVER (PARTITION BY abs(d)) - 1) / 2.0::DOUBLE AS r FROM w WHERE d <> 0) "
    "SELECT least(coalesce(sum(r) FILTER (WHERE d > 0), 0), coalesce(sum(r) FILTER (WHERE d < 0), 0))::DOUBLE AS statistic, (SELECT round(median(d), 6) FROM w) AS median_difference FROM r",
    **{f"extract_{what}_{layout}": _extract_sql(layout, what) for layout in _KINDS for what in extract.EXTRACTORS},
}
