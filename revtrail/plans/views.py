"""Read queries over companies, documents, snapshots, changes and subscriptions.

Each takes a ``Tables`` of DataFrames and returns one.  Where the order has ties, the id is the last sort key.
Dimension tables are joined by plain equi-joins: whether one is small enough to broadcast is left to the
optimizer's size estimate.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revtrail.functions import formatting as fmt
from revtrail.operators import policy, state


@dataclass
class Tables:
    companies: DataFrame
    documents: DataFrame
    snapshots: DataFrame
    changes: DataFrame
    subscriptions: DataFrame


def _cdc(t: Tables) -> DataFrame:
    """changes (c), documents (d), companies (o)."""
    c, d, o = t.changes.alias("c"), t.documents.alias("d"), t.companies.alias("o")
    return c.join(d, F.col("c.document_id") == F.col("d.id")).join(o, F.col("d.company_id") == F.col("o.id"))


def _feed_columns() -> list[Column]:
    return [
        F.col("c.id").alias("id"),
        F.coalesce("c.headline", F.lit("Change detected")).alias("headline"),
        F.coalesce("c.summary", F.lit("")).alias("summary"),
        F.coalesce("c.user_impact", F.lit("")).alias("user_impact"),
        F.coalesce("c.severity", F.lit(3)).alias("severity"),
        F.array_join("c.tags", ",").alias("tags"),
        F.col("c.confidence").alias("confidence"),
        F.col("c.detected_at").alias("detected_at"),
        F.col("d.type").alias("document_type"),
        F.col("o.slug").alias("company_slug"),
        F.col("o.name").alias("company_name"),
        F.col("o.logo_url").alias("logo_url"),
    ]


def feed(t: Tables, limit: int = 50) -> DataFrame:
    return _cdc(t).where("c.published").orderBy(F.desc("c.detected_at"), F.desc("c.id")).limit(limit).select(*_feed_columns())


def companies_rollup(t: Tables) -> DataFrame:
    """Every company with its number of published changes, by name."""
    o, d, c = t.companies.alias("o"), t.documents.alias("d"), t.changes.alias("c")
    cols = ["id", "slug", "name", "logo_url", "tos_url", "privacy_url", "last_checked_at"]
    joined = o.join(d, F.col("d.company_id") == F.col("o.id"), "left").join(c, F.col("c.document_id") == F.col("d.id"), "left")
    counted = joined.groupBy(*[F.col(f"o.{x}").alias(x) for x in cols]).agg(F.count(F.when(F.col("c.published"), F.col("c.id"))).cast("int").alias("published_changes"))
    return counted.orderBy("name", "id")


def company_slugs(t: Tables) -> DataFrame:
    return t.companies.select("slug")


def timeline(t: Tables, slug: str, cosmetic_limit: int = 20) -> DataFrame:
    """All published and the latest cosmetic changes of a company (none if the slug is unknown)."""
    own = _cdc(t).where(F.col("o.slug") == slug)
    published = own.where("c.published").select(*_feed_columns(), F.lit("published").alias("section"))
    cosmetic = own.where("c.cosmetic").orderBy(F.desc("c.detected_at"), F.desc("c.id")).limit(cosmetic_limit).select(*_feed_columns(), F.lit("cosmetic").alias("section"))
    return published.unionByName(cosmetic).orderBy("section", F.desc("detected_at"), F.desc("id"))


def published_count(t: Tables, slug: str) -> DataFrame:
    return _cdc(t).where((F.col("o.slug") == slug) & F.col("c.published")).agg(F.count(F.lit(1)).cast("int").alias("published_changes"))


def change_detail(t: Tables, change_id: str) -> DataFrame:
    """One change with both snapshots; readable whether published or not."""
    old, new = t.snapshots.alias("old"), t.snapshots.alias("new")
    one = _cdc(t).where(F.col("c.id") == change_id)
    joined = one.join(old, F.col("c.from_snapshot_id") == F.col("old.id")).join(new, F.col("c.to_snapshot_id") == F.col("new.id"))
    extra = [F.col("d.source_url").alias("source_url"), F.col("c.cosmetic").alias("cosmetic"), F.col("c.needs_review").alias("needs_review"), F.col("c.published").alias("published"), F.col("c.change_ratio").alias("change_ratio"), F.col("old.fetched_at").alias("from_fetched_at"), F.col("new.fetched_at").alias("to_fetched_at"), F.col("old.content_hash").alias("from_hash"), F.col("new.content_hash").alias("to_hash")]
    return joined.select(*_feed_columns(), *extra)


def change_diff(t: Tables, change_id: str) -> DataFrame:
    return t.changes.where(F.col("id") == change_id).select("diff_json")


def change_ids(t: Tables, limit: int = 200) -> DataFrame:
    return t.changes.where("published").orderBy(F.desc("detected_at"), F.desc("id")).limit(limit).select("id")


def due_batch(t: Tables, limit: int = 10, document_id: str | None = None) -> DataFrame:
    """Documents longest unchecked, never checked first.  The limit comes before any policy."""
    d, o = t.documents.alias("d"), t.companies.alias("o")
    due = d.join(o, F.col("d.company_id") == F.col("o.id"))
    if document_id is not None:
        due = due.where(F.col("d.id") == document_id)
    picked = due.orderBy(F.col("d.last_checked_at").asc_nulls_first(), "d.id").limit(limit)
    return picked.select(F.col("d.id").alias("id"), F.col("d.type").alias("type"), F.col("d.source_url").alias("source_url"), F.col("d.last_checked_at").alias("last_checked_at"), F.col("o.id").alias("company_id"), F.col("o.slug").alias("company_slug"), F.col("o.name").alias("company_name"))


def inspect(t: Tables, slug: str, hunks: int = 8) -> DataFrame:
    rows = _cdc(t).where(F.col("o.slug") == slug).orderBy(F.desc("c.detected_at"), F.desc("c.id"))
    cols = [F.col("c.id").alias("id"), F.col("d.type").alias("document_type"), fmt.change_state(F.col("c.cosmetic"), F.col("c.published")).alias("state"), F.col("c.severity").alias("severity"), fmt.severity_label(F.col("c.severity")).alias("severity_label"), F.col("c.detected_at").alias("detected_at")]
    if "diff_json" in t.changes.columns:
        cols.append(F.slice("c.diff_json.hunks", 1, hunks).alias("hunks"))
    return rows.select(*cols)


def subscriptions(t: Tables) -> DataFrame:
    s, o = t.subscriptions.alias("s"), t.companies.alias("o")
    return s.join(o, F.col("s.company_id") == F.col("o.id")).orderBy("s.created_at", "s.id").select(F.col("s.id").alias("id"), F.col("s.email").alias("email"), F.col("o.slug").alias("company_slug"), fmt.subscription_state(F.col("s.unsubscribed_at")).alias("state"), F.col("s.created_at").alias("created_at"))


#: Rows of a side that meet in one place (``crossed``).
BLOCK = 1000


def crossed(left: DataFrame, right: DataFrame, key: str, block: int = BLOCK) -> DataFrame:
    """The join of two tables on a column of both, where few keys have many rows on both sides: each key's rows are
    cut into blocks, and every pair of blocks is joined in a place of its own.  What is sent grows by the number of
    blocks of the other side, what a place holds and makes does not grow."""
    n = max(4 * left.sparkSession.sparkContext.defaultParallelism, int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    sizes = [df.groupBy(F.col(key).alias("_key")).agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias(name)) for df, name in ((left, "_l"), (right, "_r"))]
    blocks = sizes[0].join(sizes[1], "_key")
    every = lambda count: F.explode(F.sequence(F.lit(0), F.col(count) - 1))
    own = lambda df, count: F.pmod(F.xxhash64(*df.columns), F.col(count)).cast("int")
    known = lambda df: df.join(blocks, F.col(key) == F.col("_key"))
    on = ["_key", "_i", "_j"]
    a = known(left).withColumn("_i", own(left, "_l")).withColumn("_j", every("_r")).drop("_l", "_r").repartition(n, *on)
    b = known(right).withColumn("_j", own(right, "_r")).withColumn("_i", every("_l")).drop("_l", "_r", key).repartition(n, *on)
    return a.join(b, on).drop(*on)


def due_notifications(t: Tables, ledger: DataFrame | None = None, change_id: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Published changes not yet notified or claimed, and active subscriptions, both with company_id."""
    changes = t.changes if ledger is None else state.claim_notifications(t.changes, ledger)
    due = changes.where(F.col("published") & F.col("notified_at").isNull())
    if change_id is not None:
        due = due.where(F.col("id") == change_id)
    cdc = _cdc(Tables(t.companies, t.documents, t.snapshots, due, t.subscriptions))
    said = cdc.select(F.col("d.company_id").alias("company_id"), F.col("c.id").alias("change_id"), F.col("o.name").alias("company_name"), F.col("d.type").alias("document_type"), fmt.escape_html(F.coalesce("c.headline", F.lit("A change was detected"))).alias("headline"), fmt.escape_html(F.coalesce("c.summary", F.lit(""))).alias("summary"))
    return said, t.subscriptions.where(F.col("unsubscribed_at").isNull()).select("company_id", "email", "unsubscribe_token")


def recipients(t: Tables, ledger: DataFrame | None = None, change_id: str | None = None) -> DataFrame:
    """(change, active subscription) to notify: published changes not yet notified or claimed."""
    changes, active = due_notifications(t, ledger, change_id)
    return crossed(changes, active, "company_id").select("change_id", "email", "unsubscribe_token", "company_name", "document_type", "headline", "summary")


def company_of_document(t: Tables, document_id: str) -> DataFrame:
    d, o = t.documents.alias("d"), t.companies.alias("o")
    return d.join(o, F.col("d.company_id") == F.col("o.id")).where(F.col("d.id") == document_id).select(F.col("o.slug").alias("slug"))


def documents_with_latest(t: Tables) -> DataFrame:
    """Every document with its latest snapshot, if any."""
    s = state.latest_per(t.snapshots.select("id", "document_id", "content_hash", "fetched_at"), "document_id", "fetched_at", "id").alias("s")
    d = t.documents.alias("d")
    return d.join(s, F.col("s.document_id") == F.col("d.id"), "left").select(F.col("d.id").alias("document_id"), F.col("s.id").alias("snapshot_id"), F.col("s.content_hash").alias("content_hash"), F.col("s.fetched_at").alias("fetched_at"))


def table_counts(t: Tables) -> DataFrame:
    count = lambda df, name: df.agg(F.count(F.lit(1)).cast("int").alias("rows")).select(F.lit(name).alias("table_name"), "rows")
    return count(t.companies, "companies").unionByName(count(t.documents, "documents"))


def gate(t: Tables, limit: int = 10) -> DataFrame:
    """The due batch with the verdict of host guard and one-fetch-per-host gate."""
    due = due_batch(t, limit).withColumn("block", policy.host_block(F.col("source_url")))
    gated = policy.domain_gate(due, "source_url", [F.col("last_checked_at").asc_nulls_first(), F.col("id")], F.col("block").isNull())
    reason = F.when(F.col("block").isNotNull(), "blocked-host").when(~F.col("gate_open"), "domain-already-fetched")
    return gated.select("id", "source_url", policy.url_host(F.col("source_url")).alias("host"), reason.alias("skip_reason"))
