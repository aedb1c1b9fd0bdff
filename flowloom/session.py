"""Session set-up and the shared folder for intermediate tables."""

from __future__ import annotations

import math
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

FOLDER_SETTING = "spark.checkpoint.dir"
#: Rows a task gets at most when a table is spread for work that holds its rows in memory.
SPREAD_ROWS = 500_000
_own_folders: dict[str, str] = {}


def local_session(cores: int | str = "*", **settings: str) -> SparkSession:
    """A session for tests and benchmarks; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("flowloom")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", "8")
    )
    if FOLDER_SETTING not in settings:
        settings = settings | {FOLDER_SETTING: tempfile.mkdtemp(prefix="flowloom-")}
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors can reach, as the cluster names it.

    A session that one machine runs and that names none gets one of its own, as in tests.
    """
    folder = spark.conf.get(FOLDER_SETTING, None) or _own_folders.get(spark.sparkContext.applicationId)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"set {FOLDER_SETTING} to a folder that every executor can reach")
    return _own_folders.setdefault(spark.sparkContext.applicationId, tempfile.mkdtemp(prefix="flowloom-"))


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{shared_folder(spark)}/flowloom/{label}-{uuid.uuid4().hex}"


def remove_scratch(spark: SparkSession) -> None:
    """Delete all intermediate tables of this library in the shared folder, once nothing reads them any more."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark)}/flowloom")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def write_table(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` into the shared folder and return it as a table.

    This computes it once, cuts its lineage and gives the planner its true size, so a later join
    broadcasts it exactly when it is below ``spark.sql.autoBroadcastJoinThreshold``.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(table: DataFrame, rows: int = SPREAD_ROWS) -> DataFrame:
    """The rows of a written table dealt evenly over all cores, at most ``rows`` to a partition."""
    cores = table.sparkSession.sparkContext.defaultParallelism
    return table.repartition(max(cores, math.ceil(table.count() / rows)))


@contextmanager
def short_methods(spark: SparkSession) -> Iterator[None]:
    """Plans that run in here are compiled operator by operator.

    The many columns of a wide plan compiled as one stage make a method that Java only interprets, as it is longer than
    what it compiles. The setting is the session's own again afterwards, so a plan that is run later is not concerned.
    """
    setting = "spark.sql.codegen.wholeStage"
    before = spark.conf.get(setting, None)
    spark.conf.set(setting, "false")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(setting)
        else:
            spark.conf.set(setting, before)


def ship_package(spark: SparkSession) -> None:
    """Give this package to the session's Python workers, which may not have it installed."""
    context = spark.sparkContext
    if getattr(context, "_flowloom_shipped", False):
        return
    root = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="flowloom-package-")) / "flowloom-package.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for source in sorted(root.rglob("*.py")):
            out.write(source, source.relative_to(root.parent))
    context.addPyFile(str(archive))
    context._flowloom_shipped = True
