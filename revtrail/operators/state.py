"""Revision status by window, and current state folded from append-only facts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def revision_status(fetches: DataFrame, key: str = "document_id", at: str = "fetched_at", digest: str = "content_hash") -> DataFrame:
    """Adds previous_hash and status (baseline, unchanged, changed).

    A version is compared with the latest one stored, which - as an unchanged one equals it - is the one before:
    a lag per document.  Failed and too short fetches must be gone before.  Only narrow columns should be in
    ``fetches``: texts are joined back for changed rows (``with_texts``)."""
    before = F.lag(digest).over(Window.partitionBy(key).orderBy(at))
    status = F.when(F.col("previous_hash").isNull(), "baseline").when(F.col("previous_hash") == F.col(digest), "unchanged").otherwise("changed")
    return fetches.withColumn("previous_hash", before).withColumn("status", status)


def latest_per(df: DataFrame, key: str, at: str, tie: str) -> DataFrame:
    place = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(at), F.desc(tie)))
    return df.withColumn("_place", place).where("_place = 1").drop("_place")


def snapshots_to_store(status: DataFrame) -> DataFrame:
    """Baselines and changes; unchanged fetches are not stored."""
    return status.where(F.col("status") != "unchanged")


def document_clocks(documents: DataFrame, outcomes: DataFrame) -> DataFrame:
    """documents after a run's outcomes (document_id, status, detail, at): a check moves the clock and clears
    the error, an error moves both, a skip moves nothing."""
    seen = outcomes.where(F.col("status") != "skipped").groupBy("document_id").agg(F.max("at").alias("_at"), F.max_by("status", "at").alias("_status"), F.max_by("detail", "at").alias("_detail")).withColumnRenamed("document_id", "_id")
    failed = F.col("_status") == "error"
    joined = documents.join(seen, documents["id"] == F.col("_id"), "left")
    fresh = F.col("_at").isNotNull()
    return joined.withColumns(
        {
            "last_checked_at": F.coalesce("_at", "last_checked_at"),
            "last_error_at": F.when(fresh, F.when(failed, F.col("_at"))).otherwise(F.col("last_error_at")),
            "last_error": F.when(fresh, F.when(failed, F.col("_detail"))).otherwise(F.col("last_error")),
        }
    ).select(*documents.columns)


def company_clocks(companies: DataFrame, documents: DataFrame, outcomes: DataFrame) -> DataFrame:
    """companies.last_checked_at: the latest successful check of any of their documents."""
    good = outcomes.where(~F.col("status").isin("skipped", "error")).join(documents.select(F.col("id").alias("document_id"), "company_id"), "document_id")
    latest = good.groupBy(F.col("company_id").alias("_id")).agg(F.max("at").alias("_at"))
    return companies.join(latest, companies["id"] == F.col("_id"), "left").withColumn("last_checked_at", F.coalesce("_at", "last_checked_at")).select(*companies.columns)


def upsert(current: DataFrame, incoming: DataFrame, keys: list[str], update: list[str]) -> DataFrame:
    """current with rows of incoming: new keys are inserted, known ones get only the ``update`` columns."""
    cols = current.columns
    new = incoming.select(*[F.col(c).alias(f"_n_{c}") if c in incoming.columns else F.lit(None).alias(f"_n_{c}") for c in cols])
    on = [F.col(k).eqNullSafe(F.col(f"_n_{k}")) for k in keys]
    joined = current.withColumn("_known", F.lit(True)).join(new.withColumn("_given", F.lit(True)), on, "full_outer")
    known, given = F.col("_known").isNotNull(), F.col("_given").isNotNull()
    pick = lambda c: F.when(~known, F.col(f"_n_{c}")).when(given & F.lit(c in update), F.col(f"_n_{c}")).otherwise(F.col(c))
    return joined.select(*[pick(c).cast(current.schema[c].dataType).alias(c) for c in cols])


def subscriptions_from(events: DataFrame) -> DataFrame:
    """One row per (company_id, email): token and creation from the first subscribe, state from the last event.
    events: company_id, email, action (subscribe or unsubscribe), token, at."""
    sub = F.col("action") == "subscribe"
    folded = events.groupBy("company_id", "email").agg(
        F.min_by(F.when(sub, F.col("token")), F.when(sub, F.col("at"))).alias("unsubscribe_token"),
        F.min(F.when(sub, F.col("at"))).alias("created_at"),
        F.max(F.when(sub, F.col("at"))).alias("_in"),
        F.max(F.when(~sub, F.col("at"))).alias("_out"),
    )
    return folded.where(F.col("created_at").isNotNull()).select(F.sha2(F.concat_ws("|", F.col("company_id").cast("string"), "email"), 256).alias("id"), "company_id", "email", "unsubscribe_token", F.when(F.col("_out") > F.col("_in"), F.col("_out")).alias("unsubscribed_at"), "created_at")


def unsubscribe(subscriptions: DataFrame, requests: DataFrame) -> DataFrame:
    """subscriptions after requests (token, at); repeated requests rewrite the time."""
    latest = requests.groupBy(F.col("token").alias("_token")).agg(F.max("at").alias("_at"))
    return subscriptions.join(latest, F.col("unsubscribe_token") == F.col("_token"), "left").withColumn("unsubscribed_at", F.coalesce("_at", "unsubscribed_at")).select(*subscriptions.columns)


def publish(changes: DataFrame, ids: DataFrame) -> DataFrame:
    """changes with those named in ids (id) published by hand; cosmetic ones cannot be."""
    named = ids.select(F.col("id").alias("_id")).distinct()
    joined = changes.join(named, changes["id"] == F.col("_id"), "left")
    hit = F.col("_id").isNotNull() & ~F.col("cosmetic")
    return joined.withColumns({"published": F.col("published") | hit, "needs_review": F.col("needs_review") & ~hit}).select(*changes.columns)


def claim_notifications(changes: DataFrame, ledger: DataFrame) -> DataFrame:
    """Published changes that no earlier batch has claimed (ledger: change_id): a compare-and-set as an anti-join."""
    return changes.where(F.col("published") & F.col("notified_at").isNull()).join(ledger.select(F.col("change_id").alias("id")), "id", "left_anti")
