"""Experiments: prepare datasets, run approaches over them, analyse rankings, bootstrap, time.

``python -m lockstep.plans.experiment run|list|analyse|bootstrap|pnorm CONFIG`` and
``python -m lockstep.plans.experiment convert FOLDER``
"""

from __future__ import annotations

import argparse
import time
from collections.abc import Callable
from functools import reduce

import numpy as np
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lockstep.functions.scan import dense_index
from lockstep.functions.stats import choose_tests
from lockstep.operators import bootstrap, evaluate
from lockstep.operators.coaction import coaction_counts, pair_difference
from lockstep.operators.extract import EXTRACTORS
from lockstep.operators.prepare import earliest, first_labels, io_accounts
from lockstep.operators.ranking import user_scores
from lockstep.plans.approaches import PLAIN, Approach, Lexicographic, all_approaches, create
from lockstep.operators.profile import best_mode
from lockstep.session import build_session, cut, scope
from lockstep.sources.readers import Dataset, Experiment, folders_of, load_dataset, read_dataset, read_experiment, read_raw
from lockstep.sources.reports import ci_report, critical_difference, general_report, metric_report, save_text, score_matrix
from lockstep.sources.writers import load_result, read_results, save_result, write_dataset


def prepare(spark: SparkSession, kind: str, paths: str | list[str], folder: str, extractor: str = "retweets", order: Column | None = None) -> Dataset:
    """Raw files to a prepared dataset on disk.

    Reposts keep the earliest event per account and object, other extractors all
    rows; labels come from the first row in ``order`` (by default the earliest), in
    the layout ``twitter``, whose posts may lack the user, from the first that has one.
    """
    triples = EXTRACTORS[extractor](read_raw(spark, kind, paths), kind, label=True)
    events = earliest(triples) if extractor == "retweets" else triples.select("account", "object", "ts")
    labels = first_labels(triples, F.col("ts") if order is None else order, known_only=kind == "twitter")
    write_dataset(events, io_accounts(labels), folder, extractor)
    return read_dataset(spark, folder, extractor)


def approaches_of(config: Experiment) -> list[Approach | Lexicographic]:
    """Approaches of an experiment; where none are given all registered ones, ranking by the mean."""
    if config.approaches is None:
        return list(all_approaches(config.window_sec, mode="L2", filter_min_coactions=config.filter_min_coactions))
    return [create(spec, config.window_sec, filter_min_coactions=config.filter_min_coactions) for spec in config.approaches]


def datasets_of(spark: SparkSession, config: Experiment) -> list[str]:
    """Datasets of an experiment; all folders of its data where none are given."""
    return folders_of(spark, config.data_dir) if config.datasets is None else config.datasets


def process(data: Dataset, root: str, dataset: str, approach: Approach | Lexicographic, force: bool = False) -> bool | None:
    """Rank and store; False if the result was there, None if there are no events."""
    spark = data.events.sparkSession
    if not force and load_result(spark, root, dataset, approach) is not None:
        return False
    if data.events.isEmpty():
        return None
    with scope(spark):
        save_result(approach.rank(data.events), root, dataset, approach)
    return True


def run(spark: SparkSession, config: Experiment) -> dict[tuple[str, str], bool | None]:
    """All approaches over all datasets; what :func:`process` said of each."""
    done = {}
    for dataset in datasets_of(spark, config):
        data = read_dataset(spark, f"{config.data_dir}/{dataset}")
        for approach in approaches_of(config):
            done[dataset, approach.storage_key] = process(data, config.output_dir, dataset, approach, config.force)
    return done


def measure(ranked: DataFrame, x_max: int) -> DataFrame:
    """``(metric, value)`` of one labelled ranking."""
    tables = {name: evaluate.metric(name, ranked, x_max) for name in evaluate.METRICS}
    tables |= {"io_until_first_other": evaluate.io_until_first_other(ranked), "users_to_90": evaluate.users_to_fraction(ranked)}
    tables |= {f"precision_{k}": evaluate.precision_at(ranked, k) for k in (100, 500)}
    tables |= {"total_io": evaluate.total_io(ranked), "total_accounts": evaluate.total_accounts(ranked)}
    out = None
    for name, one in tables.items():
        row = one.select(F.lit(name).alias("metric"), F.col("value").cast("double").alias("value"))
        out = row if out is None else out.unionByName(row)
    return out


def stored_rankings(spark: SparkSession, config: Experiment) -> dict[str, dict[str, DataFrame]]:
    """Labelled rankings by dataset and method, from one scan of the store; datasets with a missing result are left out."""
    methods = [a.name for a in approaches_of(config)]
    datasets = datasets_of(spark, config)
    stored = read_results(spark, config.output_dir, approaches_of(config), datasets)
    there = {(r[0], r[1]) for r in stored.select("dataset", "approach").distinct().collect()}  # a row per result
    out: dict[str, dict[str, DataFrame]] = {}
    for dataset in datasets:
        if methods and all((dataset, m) in there for m in methods):
            io = read_dataset(spark, f"{config.data_dir}/{dataset}").io
            of = lambda m, d=dataset: stored.filter((F.col("dataset") == d) & (F.col("approach") == m)).select("account", "grp", "pos")
            out[dataset] = {m: cut(evaluate.labelled(of(m), io), "ranked") for m in methods}
    return out


def _union(parts: list[DataFrame], spark: SparkSession, schema: str) -> DataFrame:
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], schema)


def analyse(spark: SparkSession, config: Experiment) -> DataFrame:
    """``(dataset, method, metric, score)`` of all stored rankings; datasets with a missing result are left out."""
    parts = []
    for dataset, rankings in stored_rankings(spark, config).items():
        x_max = evaluate.common_x_max(*rankings.values())
        for name, ranked in rankings.items():
            parts.append(measure(ranked, x_max).select(F.lit(dataset).alias("dataset"), F.lit(name).alias("method"), "metric", F.col("value").alias("score")))
    return _union(parts, spark, "dataset string, method string, metric string, score double")


def curves(spark: SparkSession, config: Experiment, truncated: bool = True, ideal: bool = False) -> DataFrame:
    """``(dataset, method, x, y)``: the detection curves of all methods of a dataset together.

    ``truncated`` cuts them to the users that all methods rank; ``ideal`` adds, as
    method ``ideal``, the curve with all IO accounts first.
    """
    parts = []
    for dataset, rankings in stored_rankings(spark, config).items():
        x_max = evaluate.common_x_max(*rankings.values())
        found = {m: evaluate.detection_curve(r) for m, r in rankings.items()}
        if ideal:
            n_io = read_dataset(spark, f"{config.data_dir}/{dataset}").io.count()
            longest = max(rankings, key=lambda m: rankings[m].count())
            found["ideal"] = evaluate.ideal_curve(found[longest], n_io)
        for method, curve in found.items():
            kept = curve.filter(F.col("x") <= x_max) if truncated else curve
            parts.append(kept.select(F.lit(dataset).alias("dataset"), F.lit(method).alias("method"), "x", "y"))
    return _union(parts, spark, "dataset string, method string, x bigint, y double")


def curve_areas(found: DataFrame, baseline: str) -> DataFrame:
    """``(dataset, method, area, negative_area)`` of curves against those of ``baseline``, over common x."""
    base = found.filter(F.col("method") == baseline).select("dataset", "x", F.col("y").alias("y0"))
    gap = found.filter(F.col("method") != baseline).join(base, ["dataset", "x"]).withColumn("d", F.col("y") - F.col("y0"))
    return gap.groupBy("dataset", "method").agg(F.round(F.sum("d"), 6).alias("area"), F.round(F.sum(F.least(F.lit(0.0), "d")), 6).alias("negative_area"))


def significance(scores: DataFrame, metric: str) -> dict[str, object]:
    """Rank tests of one metric over the datasets with all methods, names in order."""
    _, methods, matrix = score_matrix(scores.filter(F.col("metric") == metric))
    return {"methods": methods, **choose_tests(matrix[~np.isnan(matrix).any(axis=1)])}


def pnorm_benchmark(spark: SparkSession, config: Experiment, metric: str = "auc") -> DataFrame:
    """``(mode, place, mean, std, best)``: a metric per ranking mode over datasets, each ranking in full.

    Approaches that differ in more than the mode are told apart by nothing, so an
    experiment should hold one in several modes; a lexicographic one has no mode.
    Results that are missing are left out.
    """
    parts = []
    modes = {a.name: a.mode for a in approaches_of(config) if isinstance(a, Approach)}
    for dataset in datasets_of(spark, config):
        io = read_dataset(spark, f"{config.data_dir}/{dataset}").io
        for a in approaches_of(config):
            stored = load_result(spark, config.output_dir, dataset, a) if a.name in modes else None
            if stored is not None:
                value = evaluate.metric(metric, cut(evaluate.labelled(stored, io), "ranked"))
                parts.append(value.select(F.lit(dataset).alias("dataset"), F.lit(modes[a.name]).alias("mode"), F.col("value").alias("score")))
    return best_mode(_union(parts, spark, "dataset string, mode string, score double"))


def convert(spark: SparkSession, root: str, datasets: list[str] | None = None, force: bool = False) -> list[tuple[str, str, float, float]]:
    """Parquet copies of datasets in text form below ``root``: ``(dataset, state, seconds from text, seconds from the copy)``.

    ``state`` is ``converted``, ``stored before`` or what went wrong; one dataset that
    fails does not stop the others.
    """
    out = []
    for name in folders_of(spark, root) if datasets is None else datasets:
        folder = f"{root}/{name}/Processed" if "Processed" in folders_of(spark, f"{root}/{name}") else f"{root}/{name}"
        if not force and "cache" in folders_of(spark, folder):
            out.append((name, "stored before", 0.0, 0.0))
            continue
        try:
            text, _ = time_it(lambda f=folder: load_dataset(spark, f, use_cache=False).events, 1)
            load_dataset(spark, folder, force_reload=True)
            copy, _ = time_it(lambda f=folder: load_dataset(spark, f).events, 1)
            out.append((name, "converted", text, copy))
        except (AnalysisException, KeyError, ValueError) as error:
            out.append((name, str(error).splitlines()[0], 0.0, 0.0))
    return out


def compare(first: Callable[[], DataFrame], second: Callable[[], DataFrame], repeats: int = 3) -> dict[str, object]:
    """Mean seconds of two ways to the same pairs, whether their results are equal, and how much faster the second is."""
    one, _ = time_it(first, repeats)
    two, _ = time_it(second, repeats)
    differ = pair_difference(first(), second()).count()
    return {"first": one, "second": two, "equal": differ == 0, "different_rows": differ, "speed_up": one / two if two else float("inf")}


def _replicate_keys(approach: Approach | Lexicographic, score: Callable[[Approach], DataFrame]) -> DataFrame:
    """``(iter, account, key)`` of one approach; users that a later part does not rank come last."""
    first, *rest = approach.parts if isinstance(approach, Lexicographic) else (approach,)
    users = score(first).select("account", F.array("score").alias("key"))
    for part in rest:
        users = users.join(score(part), "account", "left").select("account", F.concat("key", F.array(F.coalesce("score", F.lit(float("-inf"))))).alias("key"))
    return users.select("account.iter", F.col("account.id").alias("account"), "key")


def bootstrap_samples(data: Dataset, approaches: list[Approach | Lexicographic], iterations: int = 1000, seed: int = 42) -> DataFrame:
    """``(metric, method, iter, score)`` of every approach over the same replicates, cut to the users all of them rank.

    Each approach scores, weighs and ranks within the replicate.  The plain count of
    a pair does not hang on the other accounts, so its pairs are joined only once, and
    only the draws of accounts in a pair are kept.  Accounts go by their place.
    """
    spark = data.events.sparkSession
    places = cut(dense_index(data.events.select("account"), "account"), "places")
    placed = lambda df: df.join(places, "account").drop("account").withColumnRenamed("idx", "account")
    events, n = cut(placed(data.events.select("account", "object", "ts")), "events"), places.count()
    sampled, found, plain = [], {}, {}

    def counts(window: float) -> tuple[DataFrame, DataFrame]:
        if window not in plain:
            pairs = cut(coaction_counts(events, window), "counts")
            ends = cut(pairs.select(F.explode(F.array("u1", "u2")).alias("idx")).distinct(), "ends")
            plain[window] = pairs, cut(bootstrap.inclusion_bits(spark, n, iterations, seed, ends), "bits")
        return plain[window]

    def score(a: Approach) -> DataFrame:
        if a not in found:
            if a.key == PLAIN:
                pairs, bits = counts(a.window_sec)
                # not written: it is made again from small tables where it is read
                found[a] = bootstrap.replicate_scores(pairs.filter(F.col("score") >= a.min_coactions), bits, a.mode)
            else:
                if not sampled:
                    included = bootstrap.unpack(bootstrap.inclusion_bits(spark, n, iterations, seed)).withColumnRenamed("idx", "account")
                    sampled.append(cut(bootstrap.replicate_events(events, included), "sampled"))
                found[a] = cut(user_scores(a.pairs(sampled[0]), a.mode), "scores")
        return found[a]

    out = None
    for a in {a.name: a for a in approaches}.values():
        part = _replicate_keys(a, score).select(F.lit(a.name).alias("method"), "iter", "account", "key")
        out = part if out is None else out.unionByName(part)
    return bootstrap.replicate_metrics(out, placed(data.io.select("account").distinct()), iterations, sorted({a.name for a in approaches}), F.floor(F.col("account") / max(1, n // 256)))


def bootstrap_intervals(data: Dataset, dataset: str, approaches: Approach | Lexicographic | list[Approach | Lexicographic], iterations: int = 1000, seed: int = 42, level: float = 95.0) -> DataFrame:
    """AUC, AP and NDCG intervals over user bootstraps, one per approach and metric."""
    approaches = approaches if isinstance(approaches, list) else [approaches]
    samples = bootstrap_samples(data, approaches, iterations, seed).withColumn("dataset", F.lit(dataset))
    return bootstrap.percentile_ci(samples, ["dataset", "metric", "method"], level=level)


def time_it(action: Callable[[], DataFrame], repeats: int = 3) -> tuple[float, int]:
    """Mean seconds of running a query in full, and its rows."""
    seconds, rows = [], 0
    for _ in range(repeats):
        began = time.perf_counter()
        rows = action().count()
        seconds.append(time.perf_counter() - began)
    return sum(seconds) / len(seconds), rows


def report(spark: SparkSession, config: Experiment, metrics: list[str]) -> dict[str, str]:
    """Texts of an analysis by name: one per metric with ranks and tests, and the general one."""
    scores = cut(analyse(spark, config), "scores")
    names = {a.name: a.storage_key for a in approaches_of(config)}
    out = {name: metric_report(scores, name) for name in metrics}
    for name in metrics:
        places = critical_difference(scores, name)
        out[name] += "\n\nCritical difference\n" + "\n".join(f"  {rank:.2f}  {m}  {' '.join(f'group {g + 1}' for g in groups)}".rstrip() for m, rank, groups in places)
    return {**out, "summary": general_report(scores, config.name, names)}


def main(arguments: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    parser.add_argument("command", choices=["run", "list", "analyse", "bootstrap", "pnorm", "convert"])
    parser.add_argument("config", help="experiment file, or for convert a folder of datasets")
    parser.add_argument("--metric", default="all", choices=[*evaluate.METRICS, "all"])
    parser.add_argument("--no-curves", action="store_true", help="analyse: reports only")
    parser.add_argument("--notruncation", action="store_true", help="analyse: whole curves, and nothing else")
    parser.add_argument("--ideal", action="store_true", help="analyse: with the ideal curve, and areas against it")
    parser.add_argument("--iterations", type=int, default=1000)
    parser.add_argument("--seed", type=int, default=42)
    parser.add_argument("--ci", type=float, default=95.0)
    parser.add_argument("--force", action="store_true", help="convert: anew")
    options = parser.parse_args(arguments)
    spark = build_session("experiment")
    if options.command == "convert":
        for name, state, text, copy in convert(spark, options.config, force=options.force):
            print(name, state, f"{text:.2f} s from text, {copy:.2f} s from the copy" if text else "")
        return
    config = read_experiment(options.config)
    wanted = list(evaluate.METRICS) if options.metric == "all" else [options.metric]
    if options.command == "run":
        for (dataset, key), state in run(spark, config).items():
            print(dataset, key, {True: "computed", False: "stored before", None: "no events"}[state])
    elif options.command == "list":
        for dataset in datasets_of(spark, config):
            for a in approaches_of(config):
                print(dataset, a.storage_key, "stored" if load_result(spark, config.output_dir, dataset, a) is not None else "missing")
    elif options.command == "pnorm":
        for name in wanted:
            for r in pnorm_benchmark(spark, config, name).orderBy("place").collect():
                print(name, r["mode"], f"{r['mean']:.4f} +- {r['std']:.4f}", "best" if r["best"] else "")
    elif options.command == "analyse":
        folder = f"{config.output_dir}/analysis"
        if not options.notruncation:
            for name, text in report(spark, config, wanted).items():
                print(text, end="\n\n")
                save_text(text, f"{folder}/{name}.txt")
        if not options.no_curves:
            found = cut(curves(spark, config, not options.notruncation, options.ideal), "curves")
            found.write.mode("overwrite").parquet(f"{folder}/{'no_truncation' if options.notruncation else 'curves'}")
            if not options.notruncation and approaches_of(config):
                base = "ideal" if options.ideal else approaches_of(config)[0].name
                curve_areas(found, base).write.mode("overwrite").parquet(f"{folder}/areas")
    else:
        for dataset in datasets_of(spark, config):
            with scope(spark):
                data = read_dataset(spark, f"{config.data_dir}/{dataset}")
                intervals = cut(bootstrap_intervals(data, dataset, approaches_of(config), options.iterations, options.seed, options.ci), "intervals")
                for name in evaluate.METRICS:
                    print(ci_report(intervals, dataset, name, options.ci))


if __name__ == "__main__":
    main()
