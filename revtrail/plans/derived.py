"""The engine's tables derived from the standard test tables, by SQL that Spark and DuckDB read alike.

The test tables hold no revisions.  A document's first version is its text and a fixed clause; the second
changes the clause in one of six ways by id; the third is the first again.  A company is a source.  Unlike in
production one company has many documents of a type.  Times are numbers: seconds of an abstract clock.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from revtrail.plans.views import Tables
from revtrail.sources.landed import spread

CLAUSE = 'These terms apply to every visitor. They replace all earlier ones. Your records are never handed to advertisers. Backups are retained and stored for 90 days before deletion. Reports reach auditors, insurers, couriers. The "Portal" is offered as a courtesy. Effective 7 June 2025.'
#: What the second version replaces, by id modulo 6 (0: nothing).
EDITS = {1: ("7 June 2025", "19 August 2025"), 2: ('"Portal"', "“Portal”"), 3: ("are never handed", "are handed"), 4: ("auditors, insurers, couriers", "couriers, insurers, auditors"), 5: ("90 days", "45 days")}
COMPANY = "src3"
CHANGE = "113-2"

DOCS = "SELECT doc_id, text, source FROM documents WHERE text IS NOT NULL"


def _revision(k: int) -> str:
    base = f"concat(text, ' ', '{CLAUSE}')"
    cases = " ".join(f"WHEN {m} THEN replace({base}, '{a}', '{b}')" for m, (a, b) in EDITS.items())
    body = f"CASE doc_id % 6 {cases} ELSE {base} END" if k == 2 else base
    return f"SELECT CAST(doc_id AS VARCHAR(20)) AS document_id, {k} AS rev, 1000000 * {k} + doc_id AS fetched_at, {body} AS extracted_text FROM base"


REVISIONS = " UNION ALL ".join(_revision(k) for k in (1, 2, 3))
DOCUMENTS = "SELECT CAST(doc_id AS VARCHAR(20)) AS id, source AS company_id, CASE WHEN CAST(floor(doc_id / 20) AS BIGINT) % 2 = 0 THEN 'tos' ELSE 'privacy' END AS type, concat('https://', source, CASE WHEN doc_id % 3 = 0 THEN '.example.com:8443/' ELSE '.example.com/' END, CAST(doc_id AS VARCHAR(20))) AS source_url, CASE WHEN doc_id % 7 = 0 THEN NULL ELSE doc_id * 37 % 1009 END AS last_checked_at FROM base"
COMPANIES = "SELECT source AS id, source AS slug, concat('Company ', upper(source)) AS name, CASE WHEN count(*) % 2 = 0 THEN NULL ELSE concat('https://logo.example/', source) END AS logo_url, concat('https://', source, '.example.com/terms') AS tos_url, concat('https://', source, '.example.com/privacy') AS privacy_url, max(doc_id) AS last_checked_at FROM base GROUP BY source"


def _changes(array: str) -> str:
    one = lambda k: f"""SELECT concat(CAST(doc_id AS VARCHAR(20)), '-{k}') AS id, CAST(doc_id AS VARCHAR(20)) AS document_id, concat(CAST(doc_id AS VARCHAR(20)), ':{k - 1}') AS from_snapshot_id, concat(CAST(doc_id AS VARCHAR(20)), ':{k}') AS to_snapshot_id,
      doc_id % 6 IN (1, 2, 4) AS cosmetic, doc_id % 6 NOT IN (1, 2, 4) AND (doc_id + {k}) % 4 <> 1 AS published, doc_id % 6 NOT IN (1, 2, 4) AND (doc_id + {k}) % 4 = 1 AS needs_review,
      CASE WHEN doc_id % 6 IN (1, 2, 4) THEN NULL WHEN doc_id % 5 = 0 THEN NULL ELSE concat('Change <', CAST(doc_id AS VARCHAR(20)), '> & more') END AS headline, CASE WHEN doc_id % 6 IN (1, 2, 4) THEN NULL ELSE 'Wording changed.' END AS summary, CAST(NULL AS VARCHAR(20)) AS user_impact,
      CASE WHEN doc_id % 6 IN (1, 2, 4) THEN NULL ELSE CAST(doc_id % 5 + 1 AS INT) END AS severity, {array}('pricing', CASE WHEN doc_id % 2 = 0 THEN 'tracking' ELSE 'legacy' END) AS tags, CASE WHEN doc_id % 6 IN (1, 2, 4) THEN NULL WHEN (doc_id + {k}) % 4 = 1 THEN 'low' ELSE 'medium' END AS confidence,
      CAST(doc_id % 100 AS DOUBLE) / 1000 AS change_ratio, CASE WHEN doc_id % 11 = 0 THEN 5000000 ELSE NULL END AS notified_at, 1000000 * {k} + doc_id AS detected_at FROM base WHERE doc_id % 6 <> 0"""  # noqa: E731
    return f"{one(2)} UNION ALL {one(3)}"


#: A subscription event per event row; an error unsubscribes.
SUBSCRIPTION_EVENTS = "SELECT concat('src', CAST(user_id % 20 AS VARCHAR(20))) AS company_id, concat('user', CAST(user_id AS VARCHAR(20)), '@example.com') AS email, CASE WHEN event_type = 'error' THEN 'unsubscribe' ELSE 'subscribe' END AS action, concat('token-', CAST(event_id AS VARCHAR(20))) AS token, event_id AS happened FROM events"
CTE = {
    "spark": f"WITH base AS ({DOCS}), revisions AS ({REVISIONS}), docs AS ({DOCUMENTS}), companies AS ({COMPANIES}), changes AS ({_changes('array')}), sub_events AS ({SUBSCRIPTION_EVENTS})",
    "duckdb": f"WITH base AS ({DOCS}), revisions AS ({REVISIONS}), docs AS ({DOCUMENTS}), companies AS ({COMPANIES}), changes AS ({_changes('list_value')}), sub_events AS ({SUBSCRIPTION_EVENTS})",
}


def relation(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """revisions, docs, companies, changes or sub_events."""
    source = "events" if name == "sub_events" else "documents"
    table = spark.read.parquet(f"{sf_dir}/{source}.parquet")
    sql = {"revisions": REVISIONS, "docs": DOCUMENTS, "companies": COMPANIES, "changes": _changes("array"), "sub_events": SUBSCRIPTION_EVENTS}[name]
    if source == "events":
        return spark.sql(sql.replace("FROM events", "FROM {events}"), events=table).withColumnRenamed("happened", "at")
    base = table.where(F.col("text").isNotNull()).select("doc_id", "text", "source")
    if name == "revisions":
        base = spread(base)
    return spark.sql(sql.replace("FROM base", "FROM {base}"), base=base)


def tables(spark: SparkSession, sf_dir: str) -> Tables:
    from revtrail.functions.text import content_hash
    from revtrail.operators.state import subscriptions_from

    revisions = relation(spark, sf_dir, "revisions")
    snapshots = revisions.select(F.concat_ws(":", "document_id", F.col("rev").cast("string")).alias("id"), "document_id", "extracted_text", content_hash(F.col("extracted_text")).alias("content_hash"), "fetched_at")
    return Tables(relation(spark, sf_dir, "companies"), relation(spark, sf_dir, "docs"), snapshots, relation(spark, sf_dir, "changes"), subscriptions_from(relation(spark, sf_dir, "sub_events")))
