"""Session construction and the shared scratch folder.

Intermediate tables that are read more than once are written as Parquet below
the folder named by ``spark.checkpoint.dir``.  All executors see that folder, so
a lost executor costs a re-read and never a lost result.
"""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_LOCAL_SCRATCH: dict[str, str] = {}
_SHIPPED: set[str] = set()
_FOLDERS: set[str] = set()
_SCOPES: list[list[str]] = []


def build_session(app: str = "lockstep", master: str = "local[*]", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A UTC session with adaptive execution, for tests, the bench and the CLI."""
    builder = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    ship(spark)
    return spark


def ship(spark: SparkSession) -> None:
    """Send the package to the executors, once per application, so that Python workers can import it."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    package = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="lockstep-code-")
    atexit.register(shutil.rmtree, folder, True)
    archive = os.path.join(folder, f"{package.name}.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for source in sorted(package.rglob("*.py")):
            out.write(source, source.relative_to(package.parent))
    spark.sparkContext.addPyFile(archive)
    _SHIPPED.add(app)


def scratch_dir(spark: SparkSession) -> str:
    """Folder for intermediate tables, from ``spark.checkpoint.dir``.

    Only where that setting is absent (single-machine tests) a temporary folder
    is made and remembered for the life of the application.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if shared:
        return shared.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_SCRATCH:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        _LOCAL_SCRATCH[app] = tempfile.mkdtemp(prefix="lockstep-")
        atexit.register(shutil.rmtree, _LOCAL_SCRATCH[app], True)
    return _LOCAL_SCRATCH[app]


def cut(df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
    """Write ``df`` once below the scratch folder and return a scan of it.

    Used where a relation is read several times or where a loop would let the
    lineage grow.
    """
    spark = df.sparkSession
    folder = f"{scratch_dir(spark)}/lockstep-{spark.sparkContext.applicationId}"
    if folder not in _FOLDERS:
        _FOLDERS.add(folder)
        local = folder.removeprefix("file://")
        if local.startswith("/"):  # elsewhere the cluster clears its checkpoint folder
            atexit.register(shutil.rmtree, local, True)
    path = f"{folder}/{uuid.uuid4().hex}-{name}"
    df.write.parquet(path, compression=compression)
    for held in _SCOPES:
        held.append(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """Free the intermediate tables made inside once it ends.

    Results that read them must be written, collected or counted before; scopes may
    lie in one another.  Without a scope tables stay until the application ends.
    """
    held: list[str] = []
    _SCOPES.append(held)
    try:
        yield
    finally:
        _SCOPES[:] = [h for h in _SCOPES if h is not held]
        for path in held:
            at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
