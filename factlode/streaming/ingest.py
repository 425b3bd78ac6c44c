"""Continuous ingest: files that arrive become revisions; late ones are new revisions like any other."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import text as tx

FILES = "path string, text string, observed timestamp"


def arrivals(spark: SparkSession, folder: str, per_trigger: int = 100) -> DataFrame:
    """A stream of files described as JSON lines (path, text, observed) in a folder, with the content hash."""
    rows = spark.readStream.schema(FILES).option("maxFilesPerTrigger", per_trigger).json(folder)
    return rows.withColumn("content_hash", tx.sha1_text(F.col("text")))


def commit_batch(ledger: str) -> Callable[[DataFrame, int], None]:
    """A batch writer that appends the revisions of one batch under its batch id, so a repeated batch overwrites itself.

    Within the batch each change of a path's content in order of observation is a revision; the first is one only if it
    differs from the path's latest in the ledger.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        from pyspark.sql import Window

        spark = batch.sparkSession
        known = read_ledger(spark, ledger).filter(F.col("batch") < batch_id)
        paths = batch.select("path").distinct()
        last = known.join(paths, "path", "left_semi").groupBy("path").agg(F.max("sequence").alias("last_sequence"), F.max_by("content_hash", "sequence").alias("last_hash"))
        w = Window.partitionBy("path").orderBy("observed", "content_hash")
        rows = batch.join(last, "path", "left").withColumn("before", F.coalesce(F.lag("content_hash").over(w), "last_hash"))
        fresh = rows.filter(~F.col("before").eqNullSafe(F.col("content_hash")))
        fresh = fresh.withColumn("sequence", F.coalesce("last_sequence", F.lit(0)) + F.row_number().over(w))
        fresh.select("path", "sequence", "content_hash", "text", "observed").write.mode("overwrite").parquet(f"{ledger}/batch={batch_id}")

    return write


def read_ledger(spark: SparkSession, ledger: str) -> DataFrame:
    """All revisions; an empty frame before the first batch."""
    schema = "path string, sequence long, content_hash string, text string, observed timestamp, batch long"
    try:
        return spark.read.schema(schema).option("basePath", ledger).parquet(ledger)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def run(spark: SparkSession, folder: str, ledger: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Start the ingest; with available_now it ends when all that is there has been read."""
    writer = arrivals(spark, folder).writeStream.foreachBatch(commit_batch(ledger)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def activity(events: DataFrame, width: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """Events (ts, event_type, value) in tumbling windows with a watermark: n and total of each type, for append or update mode."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
