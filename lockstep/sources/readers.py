"""Readers: raw posts, prepared datasets, older text files, bootstrap samples, CI reports, configs."""

from __future__ import annotations

import json
import warnings
from dataclasses import dataclass
from pathlib import Path

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lockstep.operators.extract import raw_schema

_FORMATS = {"CimaIO": "json", "twitter": "json", "anonymized": "parquet"}


def read_raw(spark: SparkSession, kind: str, paths: str | list[str]) -> DataFrame:
    """Raw posts of a dataset type from one or several files, as one relation.

    JSON lines are read with a fixed schema; a malformed line fails the read.
    Blank lines are skipped.  Tags of references may be objects or scalars, and one
    may stand in place of the list; they come out as a list of objects.
    """
    schema = raw_schema(kind)
    paths = [paths] if isinstance(paths, str) else list(paths)
    if _FORMATS[kind] == "parquet":
        return spark.read.parquet(*paths)
    if kind != "twitter":
        return spark.read.schema(schema).option("mode", "FAILFAST").json(paths)
    kept = T.StructType([f if f.name != "referenced_tweets" else T.StructField(f.name, T.ArrayType(T.StructType.fromDDL("type string, id string, hashtags string"))) for f in schema])
    raw = spark.read.schema(kept).option("mode", "FAILFAST").json(paths)
    reference = lambda r: F.struct(r["type"].alias("type"), r["id"].alias("id"), _tags(r["hashtags"]).alias("hashtags"))
    return raw.withColumn("referenced_tweets", F.transform("referenced_tweets", lambda r: F.when(r.isNotNull(), reference(r))))


def _tags(text: Column) -> Column:
    """Tag objects of the JSON text of a list, an object or a scalar; a scalar is its own tag."""
    kind = "struct<tag:string,text:string,name:string>"
    listed = F.when(text.startswith("["), F.coalesce(F.from_json(text, "array<string>"), F.array(text))).otherwise(F.array(text))
    own = lambda t: F.struct(t.alias("tag"), F.lit(None).cast("string").alias("text"), F.lit(None).cast("string").alias("name"))
    return F.when(text.isNotNull(), F.transform(listed, lambda t: F.coalesce(F.when(t.startswith("{"), F.from_json(t, kind)), own(t))))


@dataclass(frozen=True)
class Dataset:
    """A prepared dataset: ``events(account, object, ts)``, ``io(account)``."""

    events: DataFrame
    io: DataFrame


def read_dataset(spark: SparkSession, folder: str, extractor: str = "retweets") -> Dataset:
    """What :func:`lockstep.sources.writers.write_dataset` wrote; a missing part is an error."""
    return Dataset(spark.read.parquet(f"{folder}/events/extractor={extractor}"), spark.read.parquet(f"{folder}/io"))


def _literals(spark: SparkSession, path: str, separator: str) -> DataFrame:
    """``value``: parts of a literal on one line, which Spark reads in splits like lines."""
    return spark.read.option("lineSep", separator).text(path)


def read_text_dataset(spark: SparkSession, folder: str) -> Dataset:
    """Datasets in the older text form: ``index_to_accountid.txt``, ``io_users.txt`` and ``RTs.txt``.

    Dictionary and events are ``name=literal`` on one line, however long; they are
    read in parts and by patterns, and nothing is evaluated.  An IO account that the
    dictionary lacks as a text is looked up as a whole number; one it lacks
    altogether raises KeyError, a dictionary in another form ValueError.
    """
    entry = r"""^\s*(?:\w+\s*=\s*)?\{?(\d+): (?:(-?\d+)|'(.*)'|"(.*)")\}?\s*$"""
    part = lambda i: F.regexp_extract("value", entry, i)
    rows = _literals(spark, f"{folder}/index_to_accountid.txt", ", ").filter(~F.col("value").rlike(r"^\s*(\w+\s*=\s*)?\{?\}?\s*$"))
    if odd := rows.filter(~F.col("value").rlike(entry)).limit(1).collect():
        raise ValueError(f"not an entry of a dictionary of accounts: {odd[0][0][:80]!r}")
    quoted = F.regexp_replace(F.concat(part(3), part(4)), r"\\(.)", "$1")
    names = rows.select(part(1).cast("long").alias("user_id"), F.when(part(2) != "", part(2)).otherwise(quoted).alias("account"), (part(2) != "").alias("number"))
    lines = spark.read.text(f"{folder}/io_users.txt").select(F.trim("value").alias("line")).filter("line <> ''").distinct()
    exact = lines.join(names, lines["line"] == names["account"]).select("line", "account")
    left = lines.join(exact, "line", "left_anti").withColumn("whole", F.when(F.col("line").rlike(r"^[+-]?\d+$"), F.col("line").try_cast("decimal(38,0)").cast("string")))
    whole = left.join(names.filter("number"), F.col("whole") == F.col("account")).select("line", "account")
    io = exact.unionByName(whole)
    if missing := lines.join(io, "line", "left_anti").limit(5).collect():
        raise KeyError(f"accounts without index: {sorted(r[0] for r in missing)}")
    triple = r"^\s*(?:\w+\s*=\s*\[)?\(?(\d+), (\d+), datetime(?:\.datetime)?\(((?:\d+(?:, )?)+)"
    found = _literals(spark, f"{folder}/RTs.txt", "), (").filter(F.col("value").rlike(triple))
    of = lambda i: F.regexp_extract("value", triple, i)
    clock = F.split(F.regexp_replace(of(3), r"[,\s]+$", ""), r",\s*")
    number = lambda i: F.coalesce(F.get(clock, F.lit(i)).cast("int"), F.lit(0))
    seconds = number(5) + number(6) / F.lit(1_000_000).cast("decimal(18,6)")
    ts = F.make_timestamp(number(0), number(1), number(2), number(3), number(4), seconds.cast("decimal(16,6)"))
    events = found.select(of(1).cast("long").alias("user_id"), of(2).alias("object"), ts.alias("ts")).join(names, "user_id")
    return Dataset(events.select("account", "object", "ts"), io.select("account").distinct())


def _modified(spark: SparkSession, path: str) -> int | None:
    """When a file, or the newest file of a folder, was written; None if there is none.  Any file system Spark can read."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    files = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(at):
        return None
    inner = [f.getModificationTime() for f in files.listStatus(at)]
    return max(inner, default=files.getFileStatus(at).getModificationTime())


def is_fresh(spark: SparkSession, target: str, sources: list[str]) -> bool:
    """Whether ``target`` and all ``sources`` exist and the target is no older than any of them."""
    made, told = _modified(spark, target), [_modified(spark, s) for s in sources]
    return made is not None and None not in told and made >= max(told, default=made)


def folders_of(spark: SparkSession, root: str) -> list[str]:
    """Names of the folders in ``root``, none if it does not exist."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    files = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(at):
        return []
    return sorted(f.getPath().getName() for f in files.listStatus(at) if f.isDirectory() and not f.getPath().getName().startswith(("_", ".")))


TEXT_FILES = ("index_to_accountid.txt", "io_users.txt", "RTs.txt")


def load_dataset(spark: SparkSession, folder: str, use_cache: bool = True, force_reload: bool = False) -> Dataset:
    """A dataset in the older text form through its Parquet copy in ``folder/cache``.

    The copy is used while it is no older than the texts, unless ``force_reload``;
    otherwise the texts are read and the copy is made.  A copy that cannot be read
    is made again; one that cannot be written only warns.
    """
    cache = f"{folder}/cache"
    sources = [f"{folder}/{name}" for name in TEXT_FILES]
    if use_cache and not force_reload and is_fresh(spark, f"{cache}/events/extractor=retweets", sources) and is_fresh(spark, f"{cache}/io", sources):
        try:
            return read_dataset(spark, cache)
        except AnalysisException:
            pass
    data = read_text_dataset(spark, folder)
    if not use_cache:
        return data
    try:
        data.events.write.mode("overwrite").parquet(f"{cache}/events/extractor=retweets")
        data.io.write.mode("overwrite").parquet(f"{cache}/io")
    except (AnalysisException, Py4JJavaError) as error:
        warnings.warn(f"no copy of {folder}: {error}", stacklevel=2)
        return data
    return read_dataset(spark, cache)


def read_samples(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Bootstrap samples ``(dataset, metric, method, iter, score)`` from CSV files.

    Files are named ``<dataset>_<metric>...csv`` with the metric one of auc, ap and
    ndcg, and have a column per method; an empty cell is a missing score.
    """
    paths = [paths] if isinstance(paths, str) else list(paths)
    wide = spark.read.option("header", "true").csv(paths)
    methods = wide.columns
    named = wide.withColumn("_file", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)).withColumn("iter", F.monotonically_increasing_id())
    pattern = r"^(.*)_(auc|ap|ndcg)(?:_|\.)"
    cells = F.explode(F.array(*[F.struct(F.lit(m).alias("method"), F.col(f"`{m}`").try_cast("double").alias("score")) for m in methods]))
    rows = named.select(F.regexp_extract("_file", pattern, 1).alias("dataset"), F.regexp_extract("_file", pattern, 2).alias("metric"), "iter", cells.alias("c"))
    return rows.select("dataset", "metric", "c.method", "iter", "c.score").filter("score is not null")


def read_ci_reports(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """``(file, method, mean, lower, upper)`` of CI text reports; signs are kept."""
    paths = [paths] if isinstance(paths, str) else list(paths)
    text = spark.read.text(paths, wholetext=True).select(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("file"), "value")
    number = r"(-?\d+(?:\.\d+)?)"
    block = rf"([^\n:]+):\s*\n\s*Mean:\s*{number}\s*\n\s*CI:\s*\[{number},\s*{number}\]"
    found = text.select("file", F.explode(F.regexp_extract_all("value", F.lit(f"({block})"), F.lit(1))).alias("b"))
    part = lambda i: F.regexp_extract("b", block, i)
    return found.select("file", F.trim(part(1)).alias("method"), *[part(i + 2).cast("double").alias(n) for i, n in enumerate(("mean", "lower", "upper"))])


@dataclass
class Experiment:
    """An experiment file.  No datasets means all in ``data_dir``, no approaches all that are registered."""

    name: str
    data_dir: str = "data"
    output_dir: str | None = None
    window_sec: float = 60
    approaches: list | None = None
    datasets: list[str] | None = None
    force: bool = False
    filter_min_coactions: int | None = None


def read_experiment(path: str) -> Experiment:
    """An experiment from JSON; ``name`` is required, unknown keys are ignored, approaches are checked.

    Results go to a folder of the experiment's name in ``output_dir``, or beside the file.
    """
    raw = json.loads(Path(path).read_text())
    if not isinstance(raw, dict) or not raw.get("name"):
        raise ValueError("an experiment needs a name")
    config = Experiment(**{k: v for k, v in raw.items() if k in Experiment.__dataclass_fields__})
    config.output_dir = f"{config.output_dir or Path(path).resolve().parent}/{config.name}"
    return config
