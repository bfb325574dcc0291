"""Landed fetches as an available-now stream: each micro-batch is one crawl over what came since the last.

The stream's checkpoint tells which files were read; snapshots stored so far are the state.  A batch that is
run again after a failure overwrites its own folders, so every fact is written once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from revtrail.operators import classify, state
from revtrail.plans import crawl
from revtrail.schemas import schema


def stored(spark: SparkSession, path: str, before: int | None = None) -> DataFrame | None:
    """What batches (before a number) have written, or None."""
    try:
        df = spark.read.parquet(path)
    except AnalysisException:
        return None
    return df if before is None else df.where(F.col("batch") < before)


def process(batch: DataFrame, number: int, documents: DataFrame, out: str, summarize: classify.Summarizer = classify.summarize_heuristically) -> None:
    """Appends a batch's outcomes, snapshots and changes under ``out``, each in the batch's own partition."""
    spark = batch.sparkSession
    previous = stored(spark, f"{out}/snapshots", number)
    if previous is not None:  # of the documents that this batch has; only keys and hashes are sorted
        previous = previous.join(batch.select("document_id").distinct(), "document_id", "left_semi")
        newest = state.latest_per(previous.select("document_id", "fetched_at", "id"), "document_id", "fetched_at", "id")
        previous = previous.join(newest.select("document_id", "id"), ["document_id", "id"], "left_semi")
    done = crawl.run(documents, batch, summarize, previous)
    for name in ("outcomes", "changes", "snapshots"):
        getattr(done, name).write.mode("overwrite").parquet(f"{out}/{name}/batch={number}")


def crawl_available(spark: SparkSession, fetches: str, documents: DataFrame, out: str, checkpoint: str, files_per_batch: int | None = None) -> None:
    """Reads all fetch files not read so far, and stops."""
    reader = spark.readStream.schema(schema("fetches"))
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    query = reader.parquet(fetches).writeStream.foreachBatch(lambda df, n: process(df, n, documents, out)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def notify(changes: DataFrame, ledger_path: str, recipients, number: int) -> DataFrame:
    """Recipients of changes that no earlier batch claimed; the claim is written before they are returned, so a
    change is announced at most once."""
    spark = changes.sparkSession
    ledger = stored(spark, ledger_path, number)
    due = changes.where(F.col("published")) if ledger is None else state.claim_notifications(changes, ledger)
    due.select(F.col("id").alias("change_id")).distinct().write.mode("overwrite").parquet(f"{ledger_path}/batch={number}")
    claimed = spark.read.parquet(f"{ledger_path}/batch={number}").select(F.col("change_id").alias("id"))
    return recipients(changes.join(claimed, "id", "left_semi"))
