"""Operators of coordinated activity: hand-computed cases, brute force, and the API around them."""

import os
import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from lockstep.functions import stats
from lockstep.functions.columns import half_day_bucket, normalise_text
from lockstep.functions.scan import prefix_scan
from lockstep.operators import bootstrap, coaction, daily, evaluate, extract, prepare, profile, ranking, weighted
from lockstep.plans import approaches, reference_queries
from lockstep.plans.experiment import analyse, approaches_of, bootstrap_intervals, bootstrap_samples, compare, convert, curve_areas, curves, main, measure, pnorm_benchmark, prepare as prepare_dataset, report, run, significance
from lockstep.session import cut, scope
from lockstep.sources import readers, reports, writers
from lockstep.streaming.live import live_activity, live_coactions

T0 = datetime(2024, 1, 1, 12)


def events(spark, rows, start=T0):
    return spark.createDataFrame([(str(u), str(o), start + timedelta(seconds=s), "x") for u, o, s in rows], "account string, object string, ts timestamp, cell string")


def at(spark, rows):
    return spark.createDataFrame([(u, o, datetime.fromisoformat(t)) for u, o, t in rows], "account string, object string, ts timestamp")


def counts(spark, rows, **kw):
    return {(r.u1, r.u2): r.score for r in coaction.coaction_counts(events(spark, rows), **kw).collect()}


F1 = [
    ([], {}, {}),
    ([(0, 0, 0)], {}, {}),
    ([(0, 0, 0), (1, 0, 30)], {}, {("0", "1"): 1}),
    ([(0, 0, 0), (1, 0, 120)], {}, {}),
    ([(0, 0, 0), (0, 0, 30)], {}, {}),
    ([(0, 0, 0), (1, 0, 30), (0, 1, 100), (1, 1, 130)], {}, {("0", "1"): 2}),
    ([(0, 0, 0), (1, 0, 30), (2, 1, 100), (3, 1, 130), (2, 2, 200), (3, 2, 230)], {"min_coactions": 2}, {("2", "3"): 2}),
    ([(0, 0, 0), (1, 0, 59.9), (2, 0, 60.1)], {}, {("0", "1"): 1, ("1", "2"): 1}),
    ([(0, 0, 0), (1, 0, 60)], {}, {("0", "1"): 1}),
    ([(0, 0, 0), (1, 0, 10), (0, 0, 20)], {}, {("0", "1"): 1}),
    ([(0, 0, 5), (1, 0, 5)], {"window_sec": 0}, {("0", "1"): 1}),
]


@pytest.mark.parametrize("rows,options,want", F1)
def test_coaction_cases(spark, rows, options, want):
    assert counts(spark, rows, **options) == want


@pytest.mark.parametrize("seed,users,objects,n", [(42, 10, 5, 100), (123, 50, 20, 1000)])
def test_coactions_against_brute_force(spark, seed, users, objects, n):
    rng = random.Random(seed)
    rows = [(rng.randrange(users), rng.randrange(objects), rng.randrange(0, 1200)) for _ in range(n)]  # tenths of a second
    want: dict = {}
    for i, (u, o, s) in enumerate(rows):
        for v, p, t in rows[i + 1 :]:
            if o == p and u != v and abs(s - t) <= 600:
                want.setdefault(tuple(sorted((str(u), str(v)))), set()).add(o)
    rows = [(u, o, s / 10) for u, o, s in rows]
    got = counts(spark, rows)
    assert got == {k: len(v) for k, v in want.items()}
    assert counts(spark, rows, min_coactions=2) == {k: n for k, n in got.items() if n >= 2}


def test_hot_object_gives_all_pairs(spark):
    assert len(counts(spark, [(u, 0, u / 2) for u in range(60)])) == 60 * 59 // 2


def test_nulls_pair_with_nothing(spark):
    df = spark.createDataFrame([(None, "o", T0), ("a", None, T0), ("a", "o", None), ("a", "o", T0), ("b", "o", T0)], "account string, object string, ts timestamp")
    assert coaction.coaction_counts(df).count() == 1


F2 = [("A", "10", "2024-01-01T12:00:00"), ("B", "10", "2024-01-01T12:00:30"), ("C", "10", "2024-01-02T09:00:00"), ("D", "11", "2024-01-02T10:00:00"), ("E", "11", "2024-01-02T10:00:20"), ("F", "12", "2024-01-01T23:59:50"), ("G", "12", "2024-01-02T00:00:20"), ("H", "12", "2024-01-01T08:00:00")]


@pytest.mark.parametrize("variant,rows,want", [("1day", F2, {"AB": 2 / 3, "DE": 1, "FG": 1 / 2}), ("12h", F2, {"AB": 2 / 3, "DE": 1, "FG": 1 / 3}), ("2days", F2, {"AB": 1, "DE": 1, "FG": 2 / 3}), ("2days", F2[:3], {"AB": 2 / 3})])
def test_weights(spark, variant, rows, want):
    got = {r.u1 + r.u2: r.score for r in weighted.weighted_pairs(at(spark, rows), variant).collect()}
    assert got == pytest.approx(want)


def test_half_day_buckets(spark):
    hours = spark.createDataFrame([(f"2024-01-02 {h:02}:30:00",) for h in (0, 4, 5, 16, 17, 23)], "t string").select(half_day_bucket(F.col("t").cast("timestamp")).alias("b"))
    assert [r.b.hour for r in hours.collect()] == [17, 17, 5, 5, 17, 17] and {r.b.day for r in hours.collect()} == {2}


PAIRS = [("1", "2", 3), ("1", "3", 1), ("2", "3", 0), ("4", "5", 3)]


@pytest.fixture(scope="module")
def pairs(spark):
    return spark.createDataFrame(PAIRS, "u1 string, u2 string, score long")


@pytest.fixture(scope="module")
def ranked(spark, pairs):
    io = spark.createDataFrame([("2",), ("3",), ("4",), ("2",)], "account string")
    return evaluate.labelled(ranking.rank_users(ranking.user_scores(pairs)), io).cache()


def listed(ranking_df):
    groups: dict = {}
    for r in sorted(ranking_df.collect(), key=lambda r: r.pos):
        groups.setdefault(r.grp, []).append(r.account)
    assert [r.pos for r in sorted(ranking_df.collect(), key=lambda r: r.pos)] == list(range(1, sum(map(len, groups.values())) + 1))
    return [groups[g] for g in sorted(groups)]


def value(df):
    return df.first()["value"]


def test_user_scores_and_rankings(pairs):
    by = lambda mode: {r.account: r.score for r in ranking.user_scores(pairs, mode).collect()}
    assert by("max") == {"1": 3, "2": 3, "3": 1, "4": 3, "5": 3}
    for mode in ("L1", "L2", "Linf"):
        assert by(mode) == {"1": 2, "2": 3, "3": 1, "4": 3, "5": 3}
    assert by("L3") == {"1": 2.0, "2": 3, "3": 1, "4": 3, "5": 3}
    assert listed(ranking.rank_users(ranking.user_scores(pairs))) == [["2", "4", "5"], ["1"], ["3"]]
    assert listed(ranking.legacy_ranking(pairs)) == [["1", "2", "4", "5"], ["3"]]
    with pytest.raises(ValueError):
        ranking.user_scores(pairs, "L0")
    assert [m for m in ("max", "L1", "L2", "L3", "L12", "Linf", "L", "linf", "L-3", 3) if ranking.valid_mode(m)] == ["max", "L1", "L2", "L3", "L12", "Linf"]


def test_power_centre():
    assert ranking.power_centre(np.array([0.0, 1.0]), 3) == 0.5
    values = np.array([0.0, 0.0, 0.0, 10.0])
    grid = np.arange(0, 10, 0.001)
    for power in (3, 4, 7):
        best = grid[(np.abs(grid[:, None] - values) ** power).sum(axis=1).argmin()]
        assert abs(ranking.power_centre(values, power) - best) < 0.011


def test_metrics(spark, ranked):
    curve = sorted((r.x, round(r.y, 6)) for r in evaluate.detection_curve(ranked).collect())
    assert curve == [(0, 0), (1, 0.666667), (2, 1.333333), (3, 2), (4, 2), (5, 3)]
    assert value(evaluate.io_until_first_other(ranked)) == 0
    assert value(evaluate.users_to_fraction(ranked)) == 5
    assert value(evaluate.precision_at(ranked, 2)) == 1 and value(evaluate.precision_at(ranked, 100)) == 0.03 and value(evaluate.precision_at(ranked, 0)) == 0
    assert value(evaluate.roc_auc(ranked, 5)) == 0.5
    assert value(evaluate.average_precision(ranked)) == pytest.approx(4 / 9 + 1 / 5)
    assert value(evaluate.ndcg(ranked)) == pytest.approx(0.848208, abs=1e-6)
    assert value(evaluate.total_io(ranked)) == 3 and value(evaluate.total_accounts(ranked)) == 5
    assert value(evaluate.metric("NDCG", ranked, 1)) == 0
    with pytest.raises(ValueError):
        evaluate.metric("f1", ranked)
    assert {r.metric for r in measure(ranked, 5).collect()} >= {"auc", "precision_500", "total_accounts"}
    none = ranked.limit(0)
    assert [value(m(none)) for m in (evaluate.roc_auc, evaluate.average_precision, evaluate.ndcg, evaluate.users_to_fraction, evaluate.io_until_first_other)] == [0] * 5
    ideal = evaluate.ideal_curve(evaluate.detection_curve(ranked), 3)
    assert evaluate.curve_difference(evaluate.detection_curve(ranked), ideal).first().negative_area == pytest.approx(-3.0)


def test_reversed_ranking_mirrors_auc(spark):
    rng = random.Random(1)
    rows = [(f"u{i}", float(rng.randrange(6))) for i in range(60)]
    io = spark.createDataFrame([(f"u{i}",) for i in range(0, 60, 4)], "account string")
    auc = lambda sign: value(evaluate.roc_auc(evaluate.labelled(ranking.rank_users(spark.createDataFrame([(a, sign * s) for a, s in rows], "account string, score double")), io)))
    assert auc(1) == pytest.approx(1 - auc(-1))


def test_lexicographic_refinement(spark):
    table = lambda rows: spark.createDataFrame(rows, "account string, grp long")
    primary = table([("1", 0), ("2", 0), ("3", 0), ("4", 0), ("5", 1)])
    assert listed(ranking.refine(primary, table([("2", 0), ("1", 1), ("3", 1)]))) == [["2"], ["1", "3"], ["4"], ["5"]]
    assert listed(ranking.refine(primary, table([]))) == [["1", "2", "3", "4"], ["5"]]
    assert listed(ranking.refine(table([]), primary)) == []


def test_scope_frees_its_tables(spark):
    outer = cut(spark.range(3).toDF("a"), "outer")
    with scope(spark):
        with scope(spark):
            inner = cut(outer, "inner")
            assert inner.count() == 3
        assert not os.path.exists(inner.inputFiles()[0].removeprefix("file://"))
    assert outer.count() == 3


def test_prefix_scan(spark):
    df = spark.createDataFrame([(i * 7 % 101, i) for i in range(101)], "k int, row int").repartition(5)
    got = {r.k: (r.place, r.total) for r in prefix_scan(df, [F.col("k").asc()], "place", {"total": "k"}).collect()}
    assert got == {k: (k + 1, k * (k + 1) // 2) for k in range(101)}


def test_rank_scan_over_ranges(spark):
    rng = random.Random(2)
    rows = [(f"u{i:04}", float(rng.choice([1, 2, 2, 2, 3, rng.randrange(50)]))) for i in range(800)]
    got = {r.account: (r.grp, r.pos) for r in ranking.rank_users(spark.createDataFrame(rows, "account string, score double").repartition(7)).collect()}
    levels = sorted({s for _, s in rows}, reverse=True)
    order = sorted(rows, key=lambda r: (-r[1], r[0]))
    assert got == {a: (levels.index(s), i + 1) for i, (a, s) in enumerate(order)}


def test_groups_over_blocks(spark, ranked, monkeypatch):
    want = sorted(tuple(r) for r in evaluate.groups(ranked).collect())
    monkeypatch.setattr(evaluate, "BLOCK", 2)
    assert sorted(tuple(r) for r in evaluate.groups(ranked).collect()) == want == [(0, 3, 2, 0, 0), (1, 1, 0, 3, 2), (2, 1, 1, 4, 2)]


def test_preparation(spark):
    triples = at(spark, [("a", "x", "2024-01-01T10:05:00"), ("a", "x", "2024-01-01T10:01:00"), ("a", "y", "2024-01-01T10:03:00"), ("b", "y", "2024-01-01T10:04:00")])
    assert sorted((r.account, r.object, r.ts.minute) for r in prepare.earliest(triples).collect()) == [("a", "x", 1), ("a", "y", 3), ("b", "y", 4)]
    ids = prepare.dictionary(spark.createDataFrame([(2,), (10,), (9,), (9,)], "account long"), "account")
    assert {r.account: r.idx for r in ids.collect()} == {"10": 0, "2": 1, "9": 2}
    coded = prepare.encode(triples, prepare.dictionary(triples, "account"), prepare.dictionary(triples, "object"))
    assert sorted((r.user_id, r.object_id) for r in coded.collect()) == [(0, 0), (0, 0), (0, 1), (1, 1)]
    assert {r.account for r in prepare.min_participation(triples, least=2).collect()} == {"a"}
    assert prepare.dataset_counts(triples).first() == (2, 2, 4)
    labelled = spark.createDataFrame([("a", 2, "1"), ("a", 1, None), ("b", 1, "1"), ("c", 1, "0")], "account string, n int, label string")
    assert {r.account for r in prepare.io_accounts(prepare.first_labels(labelled, F.col("n"))).collect()} == {"a", "c"}
    assert prepare.grouped_events(triples, "object", "account").count() == 4


def test_text_normalisation(spark):
    texts = ["  Hello @User_1\n WORLD  ", "@only", None, "a\u00a0@\u00e9tion_x b", ""]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(normalise_text(F.col("t")).alias("n"))
    assert [r.n for r in df.collect()] == ["hello world", "", "", "a b", ""]


def test_extractors(spark):
    twitter = "author_id string, created_at string, text string, user struct<username:string>, referenced_tweets array<struct<type:string,id:string,hashtags:array<struct<tag:string,text:string,name:string>>>>, extra int"
    rows = [
        ("u", "2024-01-01T00:00:00.123456Z", "RT", ("n",), [("retweeted", "9", [("t", None, None)]), ("quoted", "8", None)], 1),
        ("u", "2024-01-01T00:00:00.5Z", "Text @x", ("n",), [("quoted", "9", [("", "b", None), (None, None, ""), None])], 1),
        ("u", "2024-01-01T00:00:00Z", "no fraction", ("n",), [("retweeted", "9", None)], 1),
        ("u", None, None, None, None, None),
        (None, "2024-01-01T00:00:00.5Z", "x", None, [], None),
    ]
    raw = spark.createDataFrame(rows, twitter)
    assert [(r.object, r.ts.microsecond) for r in extract.retweets(raw, "twitter").collect()] == [("9", 123456)]
    assert [r.object for r in extract.hashtags(raw, "twitter").collect()] == ["b"]
    assert [r.object for r in extract.same_content(raw, "twitter").collect()] == ["text"]
    with pytest.raises(ValueError):
        extract.retweets(raw, "mastodon")
    with pytest.raises(ValueError):
        extract.register_extractor("retweets", extract.retweets)


def days_by_hand(a, b, w):
    """Every moment, in order of time, takes the oldest one of the other side that waits."""
    waiting, days = {0: [], 1: []}, set()
    for t, side in sorted([(t, 0) for t in a] + [(t, 1) for t in b]):
        others = [x for x in waiting[1 - side] if x >= t - w]
        if others:
            waiting[1 - side].remove(others[0])
            days.add(t // 86400)
        else:
            waiting[side].append(t)
    return len(days)


def test_daily_coincidences(spark):
    # the moment before midnight is used up by the first match
    lone = spark.createDataFrame([("a", "x", "2024-01-01 23:59:30"), ("b", "y", "2024-01-01 23:59:00"), ("b", "z", "2024-01-02 00:00:10"), (None, "x", "2024-01-01 23:59:30"), ("c", "x", None)], "account string, object string, ts string").withColumn("ts", F.to_timestamp("ts"))
    assert [tuple(r) for r in daily.coincide_any_object(lone, 60).collect()] == [("a", "b", 1)]
    assert daily.coincide_shared_objects(lone, 60).count() == 0 and daily.coincide_any_object(lone.limit(0), 60).count() == 0
    rng = random.Random(4)
    rows = [(rng.randrange(6), rng.randrange(4), rng.randrange(0, 300_000)) for _ in range(300)]
    start = datetime(1970, 1, 1)
    df = events(spark, rows, start)
    want, shared = {}, {}
    for u in range(6):
        for v in range(u + 1, 6):
            mine = [[(o, s) for w, o, s in rows if w == x] for x in (u, v)]
            both = {o for o, _ in mine[0]} & {o for o, _ in mine[1]}
            if n := days_by_hand(*[sorted(s for _, s in m) for m in mine], 300):
                want[str(u), str(v)] = n
            if n := days_by_hand(*[sorted(s for o, s in m if o in both) for m in mine], 300):
                shared[str(u), str(v)] = n
    assert {(r.u1, r.u2): r.n_days for r in daily.coincide_any_object(df, 300).collect()} == want and want
    assert {(r.u1, r.u2): r.n_days for r in daily.coincide_shared_objects(df, 300).collect()} == shared
    days = coaction.same_object_days(events(spark, [(0, 0, 0), (1, 0, 30), (0, 1, 86400), (1, 1, 86420)]), 60)
    assert [tuple(r) for r in days.collect()] == [("0", "1", 2)]


def test_statistics():
    placed = np.array([[3, 1, 2], [3, 1, 2]])
    assert stats.friedman(placed) == pytest.approx((4.0, 0.135335), abs=1e-6)
    found = stats.nemenyi(placed)
    assert (found.cd, found.cd_textbook) == pytest.approx((3.3145, 2.3437), abs=1e-4)
    assert found.p_values[0, 2] == pytest.approx(0.5768, abs=1e-4) and found.p_values[0, 1] == pytest.approx(0.1122, abs=1e-4)
    assert list(stats.competition_ranks(np.array([0.9, 0.9 + 1e-12, 0.5]))) == [1, 1, 3]
    assert stats.wilcoxon(np.array([3.0, 5, 1, 9, 4, 8]), np.array([1.0, 2, 2, 4, 0, 2])).p_value == pytest.approx(0.0625)
    assert stats.wilcoxon(np.zeros(3), np.zeros(3)).p_value == 1
    assert stats.fisher_pitman(np.array([1.0, 2, 3]), np.zeros(3)) == 0.25
    lo, hi = stats.paired_bootstrap_ci(np.arange(20.0), np.arange(20.0) - 1)
    assert lo == hi == 1
    assert set(stats.choose_tests(np.random.default_rng(1).random((4, 3)))) == {"friedman", "nemenyi"}
    assert stats.chi2_tail(3.841458820694124, 1) == pytest.approx(0.05) and stats.chi2_tail(0.1, 4) == pytest.approx(0.998791, abs=1e-6)


def test_intervals(spark):
    df = spark.createDataFrame([("d", "auc", m, i, s * f) for m, f in (("A", 1.0), ("B", 0.5)) for i, s in enumerate((1.0, 2.0, 4.0, 9.0))], "dataset string, metric string, method string, iter long, score double")
    rows = {r.method: r for r in bootstrap.percentile_ci(df, ["dataset", "metric", "method"]).collect()}
    assert (rows["A"].lower, rows["A"].upper) == pytest.approx((1.075, 8.625))
    gap = bootstrap.paired_differences(df).first()
    assert gap.significant and gap["mean"] == 2.0 and gap.lower == pytest.approx(np.percentile([0.5, 1, 2, 4.5], 1.25))
    report = reports.ci_report(bootstrap.percentile_ci(df, ["dataset", "metric", "method"]), "d", "auc")
    assert "A:" in report and "CI: [1.0750, 8.6250]" in report


def test_inclusion_keeps_about_two_thirds(spark):
    accounts = spark.createDataFrame([(f"u{i}",) for i in range(500)], "account string")
    sizes = [r["count"] for r in bootstrap.inclusion(accounts, 8).groupBy("iter").count().collect()]
    assert len(sizes) == 8 and all(270 < n < 360 for n in sizes)
    assert bootstrap.inclusion(accounts.limit(0), 3).count() == 0


def test_profiles(spark):
    df = at(spark, [("a", "x", "2024-01-01T10:00:00"), ("a", "y", "2024-01-02T10:00:00"), ("b", "x", "2024-01-01T10:00:10")])
    io = spark.createDataFrame([("a",)], "account string")
    assert sorted(tuple(r) for r in profile.activity(df, io).collect()) == [(False, "b", 1, 1), (True, "a", 2, 2)]
    assert sorted(tuple(r) for r in profile.counts_by_filter(df, io).collect()) == [("min1", 2, 1, 1), ("min2", 0, 0, 0), ("none", 2, 1, 0)]
    modes = spark.createDataFrame([("L2", 0.5), ("Linf", 0.9), ("max", 0.1), ("L10", 0.2)], "mode string, score double")
    assert [r.mode for r in profile.best_mode(modes).orderBy("place").collect()] == ["L2", "L10", "Linf", "max"]


def test_specs():
    a = approaches.create("coretweets_weighted_12h[L2]", min_coactions=2)
    assert a.storage_key == "coretweets_weighted_12h_min2_L2" and a.filtering and a.name.endswith("min2 [L2]")
    assert approaches.create("coretweets").storage_key == "coretweets_Linf_nofilter"
    lex = approaches.create({"name": "lexicographic", "approaches": ["coretweets", "coretweets_weighted_12h"], "ranking_modes": "Linf", "min_coactions": [2, 1], "need_filtering": False})
    assert lex.storage_key == "lexicographic_coretweets_min2_Linf_nofilter_coretweets_weighted_12h_Linf_nofilter"
    assert len(approaches.all_approaches()) == 4 and lex.metadata["sub_min_coactions"] == [2, 1]
    bad = ["nope", "coretweets[L0]", {}, {"name": "coretweets", "min_coactions": 0}, {"name": "coretweets", "min_coactions": True}, {"name": "coretweets", "need_filtering": 1}, {"name": "lexicographic", "approaches": ["coretweets"]}, {"name": "lexicographic", "approaches": ["coretweets", "lexicographic"]}, {"name": "lexicographic", "approaches": ["coretweets", "coretweets"], "ranking_modes": ["L2"]}, 5]
    for spec in bad:
        with pytest.raises(ValueError):
            approaches.validate(spec)
    near, far = approaches.create("coretweets", window_sec=60), approaches.create("coretweets", window_sec=600)
    assert near.storage_key == far.storage_key and writers.result_key(near) != writers.result_key(far)
    approaches.register_approach("test_counts", "Test", coaction.coaction_counts)
    assert approaches.create("test_counts").filtering
    with pytest.raises(ValueError):
        approaches.register_approach("test_counts", "Test", coaction.coaction_counts)
    del approaches.KINDS["test_counts"]


def test_experiment_from_raw_files_to_tests(spark, tmp_path, capsys):
    rng = random.Random(9)
    lines = []
    for i in range(300):
        bot = i % 3 == 0
        t = 1_704_100_000_000 + (i // 30) * 3_600_000 + (rng.randrange(20_000) if bot else rng.randrange(3_000_000))
        lines.append(f'{{"userid": "{"b" if bot else "u"}{rng.randrange(6 if bot else 40)}", "tweet_time": {t}, "retweet_tweetid": "{i // 30}", "good": {0 if bot else 1}}}')
    (tmp_path / "raw.json").write_text("\n".join(lines[:150]) + "\n\n")
    (tmp_path / "more.json").write_text("\n".join(lines[150:]))
    data = prepare_dataset(spark, "CimaIO", [str(tmp_path / "raw.json"), str(tmp_path / "more.json")], str(tmp_path / "data/X"))
    assert data.io.count() == 6
    config = tmp_path / "c.json"
    config.write_text(f'{{"name": "e", "data_dir": "{tmp_path}/data", "output_dir": "{tmp_path}/out", "datasets": ["X"], "unknown": 1, "approaches": ["coretweets", "coretweets_weighted_1day[max]", {{"name": "lexicographic", "approaches": ["coretweets", "coretweets_weighted_1day"]}}]}}')
    experiment = readers.read_experiment(str(config))
    assert experiment.output_dir == f"{tmp_path}/out/e" and experiment.filter_min_coactions is None
    assert analyse(spark, experiment).count() == 0 and curves(spark, experiment).count() == 0
    assert set(run(spark, experiment).values()) == {True} and set(run(spark, experiment).values()) == {False}
    scores = analyse(spark, experiment).cache()
    auc = {r.method: r.score for r in scores.filter("metric = 'auc'").collect()}
    assert len(auc) == 3 and min(auc.values()) > 0.7
    assert set(significance(scores, "auc")) == {"methods", "friedman", "nemenyi"}
    assert "Average" in reports.matrix_report(scores.filter("metric = 'auc'"), "AUC")
    interval = bootstrap_intervals(data, "X", approaches.create("coretweets"), 5).first()
    assert interval.lower <= interval["mean"] <= interval.upper
    assert writers.load_result(spark, str(tmp_path / "out"), "Y", approaches.create("coretweets")) is None
    texts = report(spark, experiment, ["auc", "ap"])
    assert set(texts) == {"auc", "ap", "summary"} and "Ranks" in texts["auc"] and "Friedman" in texts["auc"] and "Critical difference" in texts["ap"]
    assert "Precision at 500" in texts["summary"] and "coretweets_Linf_nofilter" in texts["summary"]
    whole, cut_, with_ideal = curves(spark, experiment, truncated=False), curves(spark, experiment), curves(spark, experiment, ideal=True)
    x_max = cut_.groupBy("method").agg(F.max("x").alias("x"))
    assert x_max.select("x").distinct().count() == 1 and whole.count() >= cut_.count()
    assert {r.method for r in with_ideal.select("method").distinct().collect()} == {*auc, "ideal"}
    areas = {r.method: (r.area, r.negative_area) for r in curve_areas(with_ideal, "ideal").collect()}
    assert areas.keys() == auc.keys() and all(a <= 0 and a == n for a, n in areas.values())
    config.write_text(f'{{"name": "e", "data_dir": "{tmp_path}/data", "datasets": null, "approaches": ["coretweets[max]", "coretweets[L2]", "coretweets[Linf]"]}}')
    modes = readers.read_experiment(str(config))
    assert modes.output_dir == f"{tmp_path}/e" and set(run(spark, modes).values()) == {True}
    found = pnorm_benchmark(spark, modes).orderBy("place").collect()
    assert [r["mode"] for r in found] == ["L2", "Linf", "max"] and sum(r.best for r in found) == 1 and {r.std for r in found} == {0.0}
    main(["analyse", str(config), "--metric", "auc", "--ideal"])
    main(["analyse", str(config), "--notruncation"])
    main(["pnorm", str(config), "--metric", "ap"])
    main(["list", str(config)])
    printed = capsys.readouterr().out
    assert "Metric: auc" in printed and "ap L2" in printed and "stored" in printed and "missing" not in printed
    assert (tmp_path / "e/analysis/summary.txt").exists() and spark.read.parquet(str(tmp_path / "e/analysis/no_truncation")).count() and spark.read.parquet(str(tmp_path / "e/analysis/areas")).count() == 3
    config.write_text(f'{{"name": "e", "data_dir": "{tmp_path}/data", "approaches": null}}')
    assert {a.mode for a in approaches_of(readers.read_experiment(str(config)))} == {"L2"}
    speed = compare(lambda: coaction.coaction_counts(data.events), lambda: coaction.coaction_counts(data.events, unique=True), 1)
    assert speed["equal"] and speed["different_rows"] == 0
    assert not compare(lambda: coaction.coaction_counts(data.events), lambda: coaction.coaction_counts(data.events, 60, 2), 1)["equal"]
    (tmp_path / "bad.json").write_text("{}")
    with pytest.raises(ValueError):
        readers.read_experiment(str(tmp_path / "bad.json"))
    (tmp_path / "broken.json").write_text('{"userid": ')
    with pytest.raises(Exception):  # noqa: B017
        readers.read_raw(spark, "CimaIO", str(tmp_path / "broken.json")).collect()


def test_raw_posts_with_scalar_tags_and_users(spark, tmp_path):
    at = '"created_at": "2024-01-01T00:00:0{}.5Z"'
    lines = [
        '{"author_id": "a", ' + at.format(1) + ', "referenced_tweets": [{"type": "quoted", "id": 7, "hashtags": [{"name": "x"}, "y", 5, null, "", {"tag": "", "text": "z"}]}]}',
        '{"author_id": "a", ' + at.format(2) + ', "user": {"username": ""}, "referenced_tweets": [{"type": "quoted", "id": "8", "hashtags": "one"}, null]}',
        '{"author_id": "b", ' + at.format(3) + ', "user": {"username": "bob", "more": 1}, "referenced_tweets": [{"type": "quoted", "id": "8", "hashtags": {"tag": "own"}}]}',
        '{"author_id": "c", ' + at.format(4) + ', "user": null, "referenced_tweets": [{"type": "quoted", "id": "8", "hashtags": null}]}',
        '{"author_id": "d", ' + at.format(5) + ', "referenced_tweets": [{"type": "quoted", "id": "8", "hashtags": "["}]}',
    ]
    (tmp_path / "posts.json").write_text("\n".join(lines))
    raw = readers.read_raw(spark, "twitter", str(tmp_path / "posts.json"))
    assert sorted((r.account, r.object) for r in extract.hashtags(raw, "twitter").collect()) == [("a", "5"), ("a", "one"), ("a", "x"), ("a", "y"), ("a", "z"), ("b", "own"), ("d", "[")]
    # an account without a user has no label and is not IO; an empty name is one
    data = prepare_dataset(spark, "twitter", str(tmp_path / "posts.json"), str(tmp_path / "out"), "hashtags")
    assert [r.account for r in data.io.collect()] == ["a"] and data.events.count() == 7


def test_older_text_files(spark, tmp_path):
    (tmp_path / "index_to_accountid.txt").write_text("index_to_accountid={0: 'ann', 1: 17}\n")
    (tmp_path / "io_users.txt").write_text("17\n")
    (tmp_path / "RTs.txt").write_text("RTs=[(0, 5, datetime.datetime(2024, 1, 2, 3, 4, 5, 600000)), (1, 5, datetime.datetime(2024, 1, 2, 3, 4, tzinfo=datetime.timezone.utc))]\n")
    data = readers.read_text_dataset(spark, str(tmp_path))
    assert sorted((r.account, r.object, r.ts) for r in data.events.collect()) == [("17", "5", datetime(2024, 1, 2, 3, 4)), ("ann", "5", datetime(2024, 1, 2, 3, 4, 5, 600000))]
    assert [r.account for r in data.io.collect()] == ["17"]
    (tmp_path / "io_users.txt").write_text("nobody\n")
    with pytest.raises(KeyError):
        readers.read_text_dataset(spark, str(tmp_path))
    assert readers.is_fresh(spark, str(tmp_path / "io_users.txt"), [str(tmp_path / "RTs.txt")])
    assert not readers.is_fresh(spark, str(tmp_path / "none"), [str(tmp_path / "RTs.txt")])
    (tmp_path / "io_users.txt").write_text("+017\n\n")
    assert [r.account for r in readers.read_text_dataset(spark, str(tmp_path)).io.collect()] == ["17"]
    (tmp_path / "index_to_accountid.txt").write_text("index_to_accountid={0: 'a\\\\b', 1: \"it's\", 2: [3]}\n")
    with pytest.raises(ValueError):
        readers.read_text_dataset(spark, str(tmp_path))


def write_texts(folder, n):
    folder.mkdir(parents=True)
    (folder / "index_to_accountid.txt").write_text("index_to_accountid=" + str({i: f"u{i}" for i in range(9)}) + "\n")
    (folder / "io_users.txt").write_text("u1\nu2\n")
    (folder / "RTs.txt").write_text("RTs=" + str([(i % 9, i, datetime(2024, 1, 1) + timedelta(seconds=i, microseconds=7)) for i in range(n)]).replace("datetime.datetime", "datetime"))


def test_cached_load_and_conversion(spark, tmp_path):
    folder = tmp_path / "X"
    write_texts(folder, 5000)
    first = readers.load_dataset(spark, str(folder))
    assert first.events.count() == 5000 and first.events.agg(F.max("ts")).first()[0] == datetime(2024, 1, 1, 1, 23, 19, 7) and first.io.count() == 2
    (folder / "cache/io").rename(folder / "cache/gone")
    assert readers.load_dataset(spark, str(folder)).io.count() == 2
    # an older copy is not used, a fresh one is, unless told
    write_texts(tmp_path / "Y", 10)
    for name in readers.TEXT_FILES:
        (folder / name).write_text((tmp_path / "Y" / name).read_text())
        os.utime(folder / name, (2e9, 2e9))
    assert readers.load_dataset(spark, str(folder)).events.count() == 10
    for name in readers.TEXT_FILES:
        os.utime(folder / name, (1e9, 1e9))
    (folder / "RTs.txt").write_text("RTs=[]")
    os.utime(folder / "RTs.txt", (1e9, 1e9))
    assert readers.load_dataset(spark, str(folder)).events.count() == 10
    assert readers.load_dataset(spark, str(folder), force_reload=True).events.count() == 0
    assert readers.load_dataset(spark, str(folder), use_cache=False).events.count() == 0
    (tmp_path / "Z").mkdir()
    states = {name: state for name, state, *_ in convert(spark, str(tmp_path))}
    assert states["X"] == "stored before" and states["Y"] == "converted" and "Z" in states and states["Z"] not in ("converted", "stored before")
    assert {s for _, s, *_ in convert(spark, str(tmp_path), ["X", "Y"], force=True)} == {"converted"}


def test_samples_and_reports(spark, tmp_path):
    (tmp_path / "UAE_auc_replacement.csv").write_text("A,B\n0.5,0.25\n0.75,\n")
    rows = sorted((r.dataset, r.metric, r.method, r.score) for r in readers.read_samples(spark, str(tmp_path / "UAE_auc_replacement.csv")).collect())
    assert rows == [("UAE", "auc", "A", 0.5), ("UAE", "auc", "A", 0.75), ("UAE", "auc", "B", 0.25)]
    (tmp_path / "ci.txt").write_text("Title\n\nA-B:\n  Mean: -0.5\n  CI: [-1.25, 0.5]\n")
    assert [(r.method, r["mean"], r.lower, r.upper) for r in readers.read_ci_reports(spark, str(tmp_path / "ci.txt")).collect()] == [("A-B", -0.5, -1.25, 0.5)]


def test_live_coactions(spark, tmp_path):
    events(spark, [("a", "o", 0), ("b", "o", 30), ("c", "o", 200), ("a", "p", 10)]).drop("cell").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("account string, object string, ts timestamp").parquet(str(tmp_path / "in"))
    for name, df in (("met", live_coactions(stream)), ("act", live_activity(stream))):
        query = df.writeStream.format("memory").queryName(name).outputMode("append" if name == "met" else "update").start()
        query.processAllAvailable()
        query.stop()
    assert [(r.u1, r.u2, r.object) for r in spark.table("met").collect()] == [("a", "b", "o")]
    assert {(r.object, r.n) for r in spark.table("act").collect()} == {("o", 3), ("p", 1)}


def test_bootstrap_of_every_approach_against_single_replicates(spark):
    rng = random.Random(4)
    rows = {(f"u{rng.randrange(14)}", f"o{rng.randrange(5)}"): (rng.randrange(3) * 86_400 + rng.randrange(150)) for _ in range(110)}
    seen = spark.createDataFrame([(a, o, T0 + timedelta(seconds=t)) for (a, o), t in rows.items()], "account string, object string, ts timestamp").cache()
    data = readers.Dataset(seen, spark.createDataFrame([(f"u{i}",) for i in range(0, 14, 3)], "account string"))
    lex = approaches.create({"name": "lexicographic", "approaches": ["coretweets", "coretweets_weighted_1day"], "ranking_modes": ["max", "L2"]})
    methods = [approaches.create("coretweets"), approaches.create("coretweets[L1]", min_coactions=2), approaches.create("coretweets_weighted_2days[L2]"), lex]
    got = {(r.metric, r.method, r.iter): r.score for r in bootstrap_samples(data, methods, 3).collect()}
    included = bootstrap.inclusion(seen.select("account").distinct(), 3, 42).cache()
    want = {}
    for i in range(3):
        mine = seen.join(included.filter(F.col("iter") == i), "account", "left_semi").cache()
        ranks = {a.name: a.rank(mine).cache() for a in methods}
        x_max = evaluate.common_x_max(*ranks.values())
        for name, r in ranks.items():
            for m in evaluate.METRICS:
                want[m, name, i] = value(evaluate.metric(m, evaluate.labelled(r, data.io), x_max))
    assert got.keys() == want.keys() and got == pytest.approx(want, abs=1e-8)
    assert len({tuple(got["auc", a.name, i] for i in range(3)) for a in methods}) > 1
    intervals = bootstrap_intervals(data, "X", methods, 3).collect()
    assert {(r.metric, r.method) for r in intervals} == {(m, a.name) for m in evaluate.METRICS for a in methods}


@pytest.mark.parametrize("name", ["ignoring_object_days", "shared_object_days"])
def test_registered_day_queries_use_the_minute(spark, tmp_path, name):
    rows = [("a", 0, "x"), ("b", 45, "x"), ("c", 106, "x")]
    posts = [(u, 1_704_100_000_000 + s * 1000, o, [], "", "1") for u, s, o in rows]
    spark.createDataFrame(posts, "userid string, tweet_time bigint, retweet_tweetid string, hashtags array<string>, tweet_text string, good string").write.parquet(str(tmp_path / "cimaio_posts.parquet"))
    assert [tuple(r) for r in reference_queries.QUERIES[name](spark, str(tmp_path)).collect()] == [("a", "b", 1)]


def test_registered_bootstrap_has_all_replicates_and_metrics(spark, tmp_path):
    rng = random.Random(2)
    posts = [(f"u{rng.randrange(9)}", 1_704_100_000_000 + rng.randrange(200_000), f"o{rng.randrange(4)}", [], "", str(rng.randrange(2))) for _ in range(60)]
    spark.createDataFrame(posts, "userid string, tweet_time bigint, retweet_tweetid string, hashtags array<string>, tweet_text string, good string").write.parquet(str(tmp_path / "cimaio_posts.parquet"))
    per = reference_queries._samples(spark, str(tmp_path)).groupBy("metric", "method").agg(F.count_distinct("iter").alias("n")).collect()
    assert {(r.metric, r.method): r.n for r in per} == {(m, k): 1000 for m in evaluate.METRICS for k in ("min1", "min2")}


def test_filter_has_its_own_threshold(spark, tmp_path):
    # c meets a only once, so it stays for the totals of x, of which a and b have two pairs
    df = events(spark, [("a", "x", 0), ("b", "x", 10), ("c", "x", 86_400), ("a", "y", 500), ("b", "y", 510), ("c", "z", 0), ("a", "z", 20)])
    spec = {"name": "coretweets_weighted_1day", "min_coactions": 2}
    score = lambda a: {(r.u1, r.u2): r.score for r in a.pairs(df).collect()}
    assert score(approaches.create(spec)) == {("a", "b"): pytest.approx(2 / 3 + 1)}
    assert score(approaches.create(spec, filter_min_coactions=2)) == {("a", "b"): pytest.approx(2.0)}
    assert writers.result_key(approaches.create(spec)) != writers.result_key(approaches.create(spec, filter_min_coactions=2))
    (tmp_path / "c.json").write_text('{"name": "e", "filter_min_coactions": 3, "approaches": ["coretweets_weighted_12h", {"name": "lexicographic", "approaches": ["coretweets", "coretweets_weighted_1day"]}]}')
    one, lex = approaches_of(readers.read_experiment(str(tmp_path / "c.json")))
    assert [p.filter_min_coactions for p in (one, *lex.parts)] == [3, 3, 3]
    with pytest.raises(ValueError):
        approaches.create(spec, filter_min_coactions=0)
