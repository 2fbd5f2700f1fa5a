"""Writers: prepared datasets and the result store."""

from __future__ import annotations

import hashlib
import json

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lockstep.plans.approaches import Approach, Lexicographic
from lockstep.sources.readers import folders_of


def write_dataset(events: DataFrame, io: DataFrame, folder: str, extractor: str = "retweets") -> None:
    """Events by extractor and IO accounts, as Parquet."""
    events.write.mode("overwrite").parquet(f"{folder}/events/extractor={extractor}")
    io.write.mode("overwrite").parquet(f"{folder}/io")


def write_dictionaries(accounts: DataFrame, objects: DataFrame, folder: str) -> None:
    accounts.write.mode("overwrite").parquet(f"{folder}/accounts")
    objects.write.mode("overwrite").parquet(f"{folder}/objects")


def result_key(approach: Approach | Lexicographic) -> str:
    """Storage key with a hash of every parameter, so that no setting can hit another's result."""
    parts = approach.parts if isinstance(approach, Lexicographic) else (approach,)
    said = json.dumps([[p.key, p.window_sec, p.min_coactions, p.mode, p.filtering, p.filter_min_coactions] for p in parts])
    return f"{approach.storage_key}-{hashlib.sha256(said.encode()).hexdigest()[:12]}"


def _place(root: str, dataset: str, approach: Approach | Lexicographic) -> str:
    return f"{root}/results/dataset={dataset}/approach={result_key(approach)}"


def save_result(ranking: DataFrame, root: str, dataset: str, approach: Approach | Lexicographic) -> None:
    ranking.write.mode("overwrite").parquet(_place(root, dataset, approach))


def load_result(spark: SparkSession, root: str, dataset: str, approach: Approach | Lexicographic) -> DataFrame | None:
    """The stored ranking, or None."""
    try:
        return spark.read.parquet(_place(root, dataset, approach))
    except AnalysisException:
        return None


def read_results(spark: SparkSession, root: str, approaches: list[Approach | Lexicographic], datasets: list[str] | None = None) -> DataFrame:
    """``(dataset, approach, account, grp, pos)`` of all stored rankings of the approaches, in one scan.

    ``approach`` is the name; partitions of other approaches and datasets are not
    read, results that are missing give no rows.
    """
    schema = "account string, grp bigint, pos bigint, dataset string, approach string"
    if not folders_of(spark, f"{root}/results"):
        return spark.createDataFrame([], schema).select("dataset", "approach", "account", "grp", "pos")
    names = {result_key(a): a.name for a in approaches}
    # a fixed schema, as rankings of several parts have no score
    stored = spark.read.schema(schema).parquet(f"{root}/results").filter(F.col("approach").isin(list(names)))
    if datasets is not None:
        stored = stored.filter(F.col("dataset").isin(datasets))
    name = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])[F.col("approach")]
    return stored.select("dataset", name.alias("approach"), F.col("account"), "grp", "pos")
