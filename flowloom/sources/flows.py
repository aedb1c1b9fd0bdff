"""Flow tables from CSV and parquet."""

from __future__ import annotations

import csv
from collections import defaultdict
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowloom.schema import CANONICAL, flow_table
from flowloom.session import write_table

#: Column with the text of a line that has a value of another kind than its column; else null.
MALFORMED = "_malformed"
_FIRST_BYTES = 1 << 16  # bytes read at a time while looking for the end of a file's first line


def _first_lines(batches):
    """For each file path, its first line (without the line break), read through pyarrow's filesystems.

    Only the bytes up to the first line break are read; a ``.gz`` file is decompressed as a stream. An empty file has
    an empty first line.
    """
    from urllib.parse import quote

    import pandas as pd
    from pyarrow import fs

    for batch in batches:
        lines = []
        for uri in batch["path"]:
            # Spark gives paths decoded (a space stays a space); pyarrow wants them percent-encoded and decodes them.
            filesystem, inner = fs.FileSystem.from_uri(quote(uri, safe=":/"))
            head = b""
            with filesystem.open_input_stream(inner, compression="detect") as stream:
                while b"\n" not in head:
                    chunk = stream.read(_FIRST_BYTES)
                    if not chunk:
                        break
                    head += chunk
            lines.append(head.split(b"\n", 1)[0].rstrip(b"\r").decode("utf-8", errors="replace"))
        yield pd.DataFrame({"path": batch["path"], "line": lines})


def _headers(spark: SparkSession, path: str | Sequence[str]) -> dict[tuple[str, ...], list[str]]:
    """The files of each header, found by one Spark job however many files there are.

    The files are listed as Spark lists them for any read (a scan of ``binaryFile`` that reads no content); the tasks
    read the first line of each of their files, nothing more.
    """
    paths = [path] if isinstance(path, str) else list(path)
    files = spark.read.format("binaryFile").load(paths).select("path")
    found = files.mapInPandas(_first_lines, "path string, line string").collect()
    by_header = defaultdict(list)
    for row in sorted(found):
        names = tuple(n.strip() for n in next(csv.reader([row.line]))) if row.line else ()
        if names:
            by_header[names].append(row.path)
    return dict(by_header)


def read_csv(
    spark: SparkSession,
    path: str | Sequence[str],
    schema: T.StructType | None = None,
    partitions: int | None = None,
    keep_malformed: bool = False,
) -> DataFrame:
    """Flow CSV with headers, plain or gzip, with the columns of an explicit schema.

    Columns are found by their names in the header of each file, so files may order them differently; a
    column that a file lacks is null, further ones are left out. A value that doesn't fit its column is
    null, and ``keep_malformed`` adds ``MALFORMED`` with the text of such lines. A gzip file is read by one task;
    ``partitions`` spreads its rows for the work that follows.
    """
    schema = schema or flow_table(CANONICAL)
    kinds = {f.name: f.dataType for f in schema.fields}
    parts = []
    for names, files in _headers(spark, path).items():
        fields, seen = [], set()
        for i, name in enumerate(names):
            known = name in kinds and name not in seen
            fields.append(T.StructField(name if known else f"_other_{i}", kinds[name] if known else T.StringType()))
            seen.add(name)
        fields.append(T.StructField(MALFORMED, T.StringType()))
        reader = spark.read.schema(T.StructType(fields)).option("header", True)
        rows = reader.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", MALFORMED).csv(files)
        columns = [F.col(n) if n in seen else F.lit(None).cast(k).alias(n) for n, k in kinds.items()]
        parts.append(rows.select(*columns, MALFORMED))
    whole = T.StructType([*schema.fields, T.StructField(MALFORMED, T.StringType())])
    df = reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], whole)
    df = df if keep_malformed else df.drop(MALFORMED)
    return df.repartition(partitions) if partitions else df


def ingest_csv(
    spark: SparkSession,
    source: str | Sequence[str],
    target: str,
    schema: T.StructType | None = None,
    quarantine: str | None = None,
    partition_by: Sequence[str] = (),
) -> DataFrame:
    """Turn flow CSV into parquet, the layout all further work should read, with row identities.

    Lines with a value of another kind go to the parquet table ``quarantine``, if one is named, instead: what could be
    read of them and, as ``MALFORMED``, their text.
    """
    rows = read_csv(spark, source, schema, keep_malformed=True)
    if quarantine:
        # All columns are written: the reader only checks those that are asked for.
        rows.filter(F.col(MALFORMED).isNotNull()).write.mode("errorifexists").parquet(quarantine)
        rows = rows.filter(F.col(MALFORMED).isNull())
    rows.drop(MALFORMED).write.mode("errorifexists").partitionBy(*partition_by).parquet(target)
    return with_row_identity(spark.read.parquet(target), target)


def with_row_identity(table: DataFrame, root: str, name: str = "flow_id") -> DataFrame:
    """Add an identity per row of the parquet table in ``root`` from its file's path below it and its place there.

    Copies of a row get different identities, also in tables partitioned into folders, and the same row
    always gets the same one.
    """
    file, folder = F.col("_metadata.file_path"), root.split(":", 1)[-1].strip("/").rsplit("/", 1)[-1]
    # What follows the last folder of the root; folders of partitions don't repeat its name.
    below = F.substring_index(file, f"/{folder}/", -1)
    place = F.concat_ws(":", below, F.col("_metadata.row_index").cast("string"))
    return table.withColumn(name, F.md5(place))


def first_rows(spark: SparkSession, path: str, n: int) -> DataFrame:
    """The first n rows of a parquet table in file order.

    Counts rows per file, then keeps whole files and a part of the last one: no sort, and files
    beyond the last are not read.
    """
    table = spark.read.parquet(path)
    place = table.select(F.col("_metadata.file_path").alias("_file"))
    sizes = place.groupBy("_file").agg(F.count("*").alias("rows"))
    # One small row per file.
    before = F.sum("rows").over(Window.partitionBy(F.lit(0)).orderBy("_file")) - F.col("rows")
    wanted = sizes.withColumn("take", F.least(F.col("rows"), F.lit(n) - before)).filter("take > 0")
    wanted = write_table(wanted.select("_file", "take"), "first-rows")
    last = wanted.agg(F.max("_file")).first()[0]
    columns = table.columns
    marked = table.filter(F.col("_metadata.file_path") <= F.lit(last or "")).select(
        "*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row")
    )
    return marked.join(wanted, "_file").filter("_row < take").select(*columns)
