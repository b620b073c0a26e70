"""Incremental run of the sales transform: the batch functions on a file stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadastrum.operators.histograms import HistogramStore
from cadastrum.plans.sales import quality_funnel, to_silver
from cadastrum.session import scratch_path, setting

STATE_PARTITIONS = 2  # of the funnel's state, a row per year

def sales_stream(spark: SparkSession, source: str, max_files: int | None = None) -> DataFrame:
    """Bronze-shaped Parquet files as a stream; ``max_files`` bounds one micro-batch."""
    reader = spark.readStream.schema(spark.read.parquet(source).schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(source)


def run_silver_stream(
    spark: SparkSession, source: str, target: str, checkpoint: str | None = None, max_files: int | None = None
) -> str:
    """Append the kept sales of all new files to ``target``, by year.

    Stateless; the file sink with its checkpoint writes every input row once,
    also across restarts and lost executors.
    """
    query = (
        to_silver(sales_stream(spark, source, max_files))
        .writeStream.format("parquet")
        .outputMode("append")
        .partitionBy("year")
        .option("path", target)
        .option("checkpointLocation", checkpoint or scratch_path(spark, "stream-checkpoint"))
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return target


def run_funnel_stream(
    spark: SparkSession, source: str, target: str, checkpoint: str | None = None, max_files: int | None = None
) -> str:
    """Running funnel totals per year; the state holds one row per year.

    Every batch has a folder of its own, which a repeated batch writes anew; readers take the
    last complete one, so neither a batch at work nor a crash leaves them without totals.
    """

    def publish(totals: DataFrame, batch_id: int) -> None:
        # A row per year, so one file, which is renamed into place whole.
        totals.coalesce(1).write.mode("overwrite").parquet(f"{target}/batch={batch_id}")

    writer = (
        quality_funnel(sales_stream(spark, source, max_files), ["year"])
        .writeStream.outputMode("complete")
        .foreachBatch(publish)
        .option("checkpointLocation", checkpoint or scratch_path(spark, "funnel-checkpoint"))
        .trigger(availableNow=True)
    )
    # Every batch commits every state partition, empty or not; the stream takes its settings when it starts.
    with setting(spark, "spark.sql.shuffle.partitions", STATE_PARTITIONS):
        query = writer.start()
    query.awaitTermination()
    return target


def read_latest_totals(spark: SparkSession, target: str) -> DataFrame:
    """Totals of the last batch whose writing was committed (a row per year and batch is read)."""
    batches = spark.read.parquet(target)
    return batches.where(F.col("batch") == batches.agg(F.max("batch")).scalar()).drop("batch")


def price_store(path: str) -> HistogramStore:
    """Prices per square metre by department and year."""
    return HistogramStore(path, ("code_departement", "year"), ("price_m2",), by="year")


def run_price_stream(
    spark: SparkSession, source: str, store: HistogramStore, checkpoint: str | None = None, max_files: int | None = None
) -> HistogramStore:
    """Adds the kept sales of all new files to the store, a batch at a time; a repeated batch replaces itself.

    Medians of all files so far then cost the store's small tables and the values near the medians, not
    the files.
    """
    query = (
        to_silver(sales_stream(spark, source, max_files))
        .writeStream.foreachBatch(lambda rows, batch: store.append(rows, batch))
        .option("checkpointLocation", checkpoint or scratch_path(spark, "price-checkpoint"))
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return store
