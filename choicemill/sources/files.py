"""CSV and JSON in and out, and an idempotent append.

CSV with line breaks inside quotes cannot be split, so such a file is one task: land it once as
Parquet (``land``) and run everything on the landed table.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from choicemill.session import checkpoint_root

CSV_OPTIONS = {"header": "true", "multiLine": "true", "quote": '"', "escape": '"', "maxCharsPerColumn": "-1",
               "encoding": "UTF-8", "mode": "FAILFAST"}

QUESTION_BANK = T.StructType([T.StructField(c, T.StringType()) for c in
                              ("dataset", "category", "question", "ground_truth")])
RAW_OBSERVATIONS = T.StructType(
    [T.StructField(c, T.StringType()) for c in
     ("dataset", "category", "question", "ground_truth", "model", "answer")]
    + [T.StructField(c, T.IntegerType()) for c in ("prompt_tokens", "completion_tokens", "total_tokens")]
    + [T.StructField(c, T.DoubleType()) for c in ("latency", "cost")])


def scratch(spark: SparkSession, name: str) -> str:
    """A folder of its own below the shared folder."""
    return f"{checkpoint_root(spark)}/{name}/{uuid.uuid4().hex}"


def read_csv(spark: SparkSession, paths: str | Sequence[str], schema: T.StructType) -> DataFrame:
    """One or several CSV files with a declared schema; bad rows fail the job."""
    paths = [paths] if isinstance(paths, str) else list(paths)
    return spark.read.schema(schema).options(**CSV_OPTIONS).csv(paths)


def land(rows: DataFrame, path: str, partition_by: Sequence[str] = ()) -> DataFrame:
    """Write once as Parquet and return the landed table."""
    writer = rows.write.mode("errorifexists")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def for_report(rows: DataFrame, columns: Sequence[str] | None = None, digits: int = 8) -> DataFrame:
    """Fixed column order, floating-point columns rounded."""
    columns = list(columns or rows.columns)
    kinds = dict(rows.dtypes)
    return rows.select(*[F.round(c, digits).alias(c) if kinds[c] in ("double", "float") else F.col(c)
                         for c in columns])


def union_of_columns(frames: Sequence[DataFrame]) -> DataFrame:
    """Rows of all frames over the union of their columns, in first-seen order."""
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame, allowMissingColumns=True)
    return out


def write_csv(rows: DataFrame, path: str, columns: Sequence[str] | None = None, digits: int = 8) -> None:
    for_report(rows, columns, digits).write.mode("errorifexists").options(
        header="true", quote='"', escape='"', quoteAll="true", emptyValue="").csv(path)


def write_json(rows: DataFrame, path: str) -> None:
    """Parameter tables as JSON lines."""
    rows.write.mode("errorifexists").json(path)


def keyed_map(rows: DataFrame, key: str) -> DataFrame:
    """A small parameter table as one row holding a map from key to the whole row.

    The table has one row per value of a parameter grid, so its size is that of the grid.
    """
    fields = F.struct(*[F.col(c) for c in rows.columns])
    entries = F.collect_list(F.struct(F.col(key).cast("string"), fields))
    return rows.agg(F.map_from_entries(entries).alias("entries"))


def read_keyed_map(spark: SparkSession, path: str, value: T.StructType) -> DataFrame:
    """Rows of a stored keyed map, with the key as text in ``key``."""
    schema = T.StructType([T.StructField("entries", T.MapType(T.StringType(), value))])
    return spark.read.schema(schema).json(path).select(F.explode("entries")).select("key", "value.*")


BUCKET = "key_bucket"  # partition column of a keyed sink: a hash of the key
SINK_BUCKETS = 64


def append_new(spark: SparkSession, rows: DataFrame, path: str, keys: Sequence[str], order: Sequence[str] = (),
               buckets: int = SINK_BUCKETS) -> None:
    """Append only rows whose key is not stored yet; a repeated run adds nothing.

    Of several rows of a key in the batch the first by ``order`` is taken (then by all columns). The sink is
    partitioned by a hash of the key: a batch reads the key columns of the partitions it touches and no others.
    """
    bucket = F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")
    others = [c for c in rows.columns if c not in keys]
    ordered = [F.col(c) for c in [*order, *[c for c in others if c not in order]]]
    first = rows.groupBy(*keys).agg(F.min_by(F.struct(*others), F.struct(*ordered)).alias("r")).select(*keys, "r.*") if others \
        else rows.select(*keys).distinct()
    first = first.withColumn(BUCKET, bucket)
    if _exists(spark, path):
        touched = [r[0] for r in rows.select(bucket).distinct().collect()]  # at most ``buckets`` numbers
        stored = read_sink(spark, path, rows.schema, touched).select(*keys)
        first = first.join(stored, list(keys), "left_anti")
    first.select(*rows.columns, BUCKET).write.mode("append").partitionBy(BUCKET).parquet(path)


def read_sink(spark: SparkSession, path: str, schema: T.StructType, touched: Sequence[int] | None = None) -> DataFrame:
    """Rows of a keyed sink, of the given partitions only if they are named."""
    whole = T.StructType([*schema.fields, T.StructField(BUCKET, T.IntegerType())])
    stored = spark.read.schema(whole).parquet(path)
    if touched is not None:
        stored = stored.filter(F.col(BUCKET).isin(list(touched)))
    return stored.drop(BUCKET)


def numbered(spark: SparkSession, path: str, prefix: str, complete: bool = False) -> list[int]:
    """Numbers n of the folders ``prefix=n`` below a path; if asked for, only of those whose write was completed."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    root = hadoop.Path(path)
    system = root.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(root):
        return []
    names = [s.getPath().getName() for s in system.listStatus(root)]
    found = [int(n.split("=")[1]) for n in names if n.startswith(f"{prefix}=")]
    return sorted(n for n in found if not complete or system.exists(hadoop.Path(f"{path}/{prefix}={n}/_SUCCESS")))


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder that this library wrote."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def _exists(spark: SparkSession, path: str) -> bool:
    """Whether a path holds a table, on whatever file system it lies."""
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop_path)
