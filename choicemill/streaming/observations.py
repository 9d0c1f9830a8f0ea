"""Streams of observations: idempotent ingestion, running scorecards and completeness.

Every operator is declared on a streaming DataFrame; ``run_available`` drives a query over the data
present now, with a checkpoint, so a restart continues where it stopped.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from choicemill.functions.numeric import mean_of, rounded
from choicemill.params import DEFAULT, Params
from choicemill.sources.files import append_new, numbered, remove, scratch


def read_stream(spark: SparkSession, path: str, schema: StructType, files: str = "*.parquet") -> DataFrame:
    """Parquet files arriving in a folder, limited to names that match a pattern."""
    return spark.readStream.schema(schema).option("pathGlobFilter", files).parquet(path)


def run_available(stream: DataFrame, path: str | None = None, checkpoint: str | None = None,
                  mode: str = "append") -> DataFrame:
    """Process what is available into a Parquet sink and return the sink as a table."""
    spark = stream.sparkSession
    path = path or scratch(spark, "sink")
    writer = stream.writeStream.format("parquet").outputMode(mode).option("path", path).option(
        "checkpointLocation", checkpoint or scratch(spark, "progress"))
    writer.trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


def latest_results(stream: DataFrame, keys: Sequence[str], path: str | None = None,
                   checkpoint: str | None = None) -> DataFrame:
    """Process what is available in update mode: the newest row per key, open windows included.

    Each batch writes the keys it changed to a folder named by its number, so a batch replayed after a
    failure overwrites itself. After the run the batches are folded into a base with one row per key, so
    neither storage nor reading grows with the number of batches.
    """
    spark = stream.sparkSession
    path = path or scratch(spark, "sink")

    def store(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    writer = stream.writeStream.outputMode("update").foreachBatch(store).option(
        "checkpointLocation", checkpoint or scratch(spark, "progress"))
    writer.trigger(availableNow=True).start().awaitTermination()
    return fold(spark, stream.schema, keys, path)


def fold(spark: SparkSession, schema: StructType, keys: Sequence[str], path: str) -> DataFrame:
    """Fold finished batches into the base and return it.

    The new base is complete before anything older is removed. A failure in between leaves folders that
    the next run ignores, being older than the base, and removes.
    """
    bases = numbered(spark, path, "base", complete=True)
    base = bases[-1] if bases else -1
    epochs = numbered(spark, path, "epoch")
    fresh = [e for e in epochs if e > base]
    if fresh:
        parts = [(f"{path}/base={base}", base)] if bases else []
        rows = None
        for folder, number in [*parts, *[(f"{path}/epoch={e}", e) for e in fresh]]:
            part = spark.read.schema(schema).parquet(folder).withColumn("__epoch", F.lit(number))
            rows = part if rows is None else rows.unionByName(part)
        others = [c for c in schema.names if c not in keys]
        newest = rows.groupBy(*keys).agg(F.max_by(F.struct(*others), "__epoch").alias("r")).select(*keys, "r.*")
        newest.select(*schema.names).write.mode("overwrite").parquet(f"{path}/base={fresh[-1]}")
        base = fresh[-1]
    for number in epochs:
        if number <= base:
            remove(spark, f"{path}/epoch={number}")
    for number in numbered(spark, path, "base"):
        if number != base:
            remove(spark, f"{path}/base={number}")
    if base < 0:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{path}/base={base}")


def event_observations(events: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """Observations carried by an event stream."""
    names = F.array(*[F.lit(m) for m in params.candidates])
    return events.select(
        "event_id", F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").alias("query"),
        names[F.pmod("event_id", F.lit(params.k)).cast("int")].alias("model"),
        (F.col("event_type") != "error").cast("int").alias("correct"), F.col("value").alias("cost"),
        F.get_json_object("props", "$.k").cast("long").alias("tokens"))


def ingested(stream: DataFrame, keys: Sequence[str], delay: str) -> DataFrame:
    """First arrival per key; state is dropped once the watermark passes it."""
    return stream.withWatermark("ts", delay).dropDuplicatesWithinWatermark(list(keys))


def ingest_across_runs(stream: DataFrame, path: str, keys: Sequence[str], checkpoint: str,
                       arrival: Sequence[str] = ("ts",)) -> None:
    """Append only keys the sink does not hold, whatever the watermark; survives restarts.

    A batch that is replayed after a failure finds its own rows in the sink and adds nothing. Within a batch
    the first arrival of a key counts.
    """
    def store(batch: DataFrame, _epoch: int) -> None:
        append_new(batch.sparkSession, batch, path, keys, arrival)

    query = stream.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint)
    query.trigger(availableNow=True).start().awaitTermination()


def scorecard(stream: DataFrame, width: str, slide: str | None = None, delay: str = "1 day") -> DataFrame:
    """Count, accuracy and mean cost per (window, candidate)."""
    window = F.window("ts", width, slide) if slide else F.window("ts", width)
    grouped = stream.withWatermark("ts", delay).groupBy(window.alias("w"), "model").agg(
        F.count(F.lit(1)).alias("n"), mean_of("correct").alias("accuracy"), mean_of("cost").alias("mean_cost"),
        rounded(F.sum("cost"), 6).alias("total_cost"))
    return grouped.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "model", "n",
                          "accuracy", "mean_cost", "total_cost")


def queries_by_window(stream: DataFrame, width: str = "7 days", delay: str = "1 day",
                       params: Params = DEFAULT) -> DataFrame:
    """Rows and missing candidates per (window, query); ``incomplete`` picks those that lack some.

    The choice comes after the newest row per key is known: a later batch may complete a query.
    """
    flags = [F.max((F.col("model") == m).cast("int")).alias(f"__f{i}") for i, m in enumerate(params.candidates)]
    grouped = stream.withWatermark("ts", delay).groupBy(F.window("ts", width).alias("w"), "query").agg(
        F.count(F.lit(1)).alias("n"), *flags)
    missing = F.concat_ws(",", *[F.when(F.col(f"__f{i}") == 0, F.lit(m)) for i, m in enumerate(params.candidates)])
    return grouped.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "query", "n",
                          missing.alias("missing"))


def incomplete(queries: DataFrame) -> DataFrame:
    return queries.filter("missing <> ''")
