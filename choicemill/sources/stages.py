"""Written stages: tables that cut lineage and serve as size-checked inputs of later joins."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from choicemill.session import checkpoint_root

_paths: dict[tuple[str, str], str] = {}
_schemas: dict[str, StructType] = {}
_rows: dict[str, int] = {}


def written(spark: SparkSession, key: str, build: Callable[[], DataFrame],
            partition_by: list[str] | None = None) -> DataFrame:
    """Build a stage once per application, write it to the shared folder and read it back.

    A lost executor then costs a re-read of its files and never a rebuild of the chain. Every
    write goes to a folder of its own, so a failed attempt leaves nothing that could be read. The
    rows are counted while they are written, so size checks on a stage need no job.
    """
    memo = (spark.sparkContext.applicationId, key)
    if memo not in _paths:
        path = f"{checkpoint_root(spark)}/stages/{memo[0]}/{uuid.uuid4().hex}"
        df = build()
        counted = Observation()
        writer = df.observe(counted, F.count(F.lit(1)).alias("rows")).write.mode("errorifexists")
        if partition_by:
            writer = writer.partitionBy(*partition_by)
        writer.parquet(path)
        _schemas[path], _rows[path] = df.schema, counted.get["rows"]
        _paths[memo] = path
    path = _paths[memo]
    # The known schema keeps partition columns typed and spares the schema inference job.
    return with_row_bound(spark.read.schema(_schemas[path]).parquet(path), _rows[path])


def with_row_bound(df: DataFrame, rows: int | None) -> DataFrame:
    """Remember that a frame has at most this many rows."""
    df.__dict__["_row_bound"] = rows
    return df


def row_bound(df: DataFrame) -> int | None:
    return df.__dict__.get("_row_bound")


def stage_path(spark: SparkSession, key: str) -> str:
    """Folder of a stage that has been written."""
    return _paths[(spark.sparkContext.applicationId, key)]


def fits(df: DataFrame, rows: int) -> bool:
    """Whether a table has at most this many rows: by its recorded bound, else by counting."""
    bound = row_bound(df)
    if bound is not None and bound <= rows:
        return True
    return df.count() <= rows


def broadcast_if_small(df: DataFrame, rows: int) -> DataFrame:
    """Broadcast hint for a table of checked size; beyond it the join shuffles, with skew
    handling by adaptive execution."""
    return F.broadcast(df) if fits(df, rows) else df
