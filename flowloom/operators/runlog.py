"""Run metadata: one row per run and step."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from flowloom.schema import RUN_LOG

FAILED = "error"


def stamped(message: Column, at: Column) -> Column:
    """A message with its time of day in front, as errors and warnings are logged."""
    return F.concat(F.lit("["), F.date_format(at, "HH:mm:ss"), F.lit("] "), message)


def log_steps(steps: DataFrame) -> DataFrame:
    """Rows of the run log; a step with errors has failed, whatever its status says."""
    status = F.when(F.size("errors") > 0, FAILED).otherwise(F.col("status"))
    return steps.withColumn("status", status).select(
        *[F.col(f.name).cast(f.dataType).alias(f.name) for f in RUN_LOG.fields]
    )


def append_log(steps: DataFrame, path: str, batch: str | None = None) -> bool:
    """Append rows to the log at ``path`` once: a repeated append of the same batch writes nothing.

    A batch is named by ``batch`` or, by default, by an order-free digest of its rows (the sum of a 64-bit hash of each
    row, computed by Spark). Its rows are written to an attempt folder of their own and then committed by renaming it to
    ``committed/<batch>``; a batch already committed is left as it is, and an attempt that failed before its commit is
    never read (``read_log`` reads committed batches only). Returns whether this call committed the batch.
    """
    rows = log_steps(steps)
    if batch is None:
        digest = rows.select(F.sum(F.xxhash64(*rows.columns).cast("decimal(38,0)")).alias("d"), F.count("*").alias("n"))
        found = digest.first()
        batch = f"rows{found['n']}-digest{found['d'] or 0}"
    spark = steps.sparkSession
    jvm = spark.sparkContext._jvm
    committed = jvm.org.apache.hadoop.fs.Path(f"{path}/committed/{batch}")
    fs = committed.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(committed):
        return False
    attempt = f"{path}/attempts/{batch}.{uuid.uuid4().hex}"
    rows.write.parquet(attempt)
    fs.mkdirs(committed.getParent())
    if fs.exists(committed) or not fs.rename(jvm.org.apache.hadoop.fs.Path(attempt), committed):
        fs.delete(jvm.org.apache.hadoop.fs.Path(attempt), True)  # another attempt committed first
        return False
    return True


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """The committed rows of a log written by ``append_log``; an empty log has none."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/committed")
    if not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        return spark.createDataFrame([], RUN_LOG)
    return spark.read.schema(RUN_LOG).option("recursiveFileLookup", "true").parquet(f"{path}/committed")


def _order() -> Column:
    return F.struct("end_time", "step")


def run_summary(log: DataFrame) -> DataFrame:
    """Per run its last step, status, error and warning counts, seconds per step and last metrics."""
    metrics = ("accuracy", "precision", "recall", "f1_score")
    per_step = log.groupBy("run_id", "step").agg(
        F.max_by("dataset_name", _order()).alias("dataset_name"),
        F.sum("seconds").alias("seconds"),
        F.sum(F.size("errors")).alias("errors"),
        F.sum(F.size("warnings")).alias("warnings"),
        F.count_if(F.col("status") == FAILED).alias("failed"),
        F.max_by("status", _order()).alias("status"),
        *[F.max_by(m, F.when(F.col(m).isNotNull(), _order())).alias(m) for m in metrics],
        F.max("end_time").alias("end_time"),
    )
    # One row per run and step is left, so the map is as large as the list of step names.
    return per_step.groupBy("run_id").agg(
        F.max_by("dataset_name", _order()).alias("dataset"),
        F.max_by("step", _order()).alias("current_step"),
        F.when(F.sum("failed") > 0, FAILED).otherwise(F.max_by("status", _order())).alias("workflow_status"),
        F.sum("errors").alias("error_count"),
        F.sum("warnings").alias("warning_count"),
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("step", "seconds")))).alias("processing_time"),
        *[F.max_by(m, F.when(F.col(m).isNotNull(), _order())).alias(m) for m in metrics],
    )


def ready_runs(log: DataFrame) -> DataFrame:
    """Runs that name their dataset and have neither errors nor a failed step."""
    named = F.coalesce(F.length("dataset_name"), F.lit(0)) > 0
    return (
        log.groupBy("run_id")
        .agg(
            F.max(named).alias("named"),
            F.sum(F.size("errors")).alias("errors"),
            F.count_if(F.col("status") == FAILED).alias("failed"),
        )
        .filter("named and errors = 0 and failed = 0")
        .select("run_id")
    )



def run_duration(log: DataFrame) -> DataFrame:
    """Seconds from the first start to the last end of each run."""
    first, last = F.min("start_time"), F.max("end_time")
    return (
        log.groupBy("run_id")
        .agg(first.alias("start_time"), last.alias("end_time"))
        .withColumn("total_seconds", F.expr("timestampdiff(MICROSECOND, start_time, end_time)") / 1e6)
    )


def last_errors(log: DataFrame, n: int = 3) -> DataFrame:
    """The last n errors of each run, newest first.

    The rank filter lets Spark cut each run to n rows before the shuffle.
    """
    rows = log.select("run_id", "end_time", "step", F.posexplode("errors").alias("pos", "error"))
    order = Window.partitionBy("run_id").orderBy(F.desc("end_time"), F.desc("step"), F.desc("pos"))
    return rows.withColumn("recency", F.row_number().over(order)).filter(F.col("recency") <= n)
