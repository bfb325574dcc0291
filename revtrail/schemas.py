"""Table schemas and closed vocabularies."""

from __future__ import annotations

from pyspark.sql import types as T

# Vocabularies that stored rows and summaries may use.
DOCUMENT_TYPES = ("tos", "privacy")
CONFIDENCES = ("low", "medium", "high")
TAGS = ("data-retention", "third-party-sharing", "arbitration", "pricing", "content-licensing", "account-termination", "tracking", "jurisdiction")
TAG_LABELS = {
    "data-retention": "Data retention",
    "third-party-sharing": "Third-party sharing",
    "arbitration": "Arbitration",
    "pricing": "Pricing",
    "content-licensing": "Content licensing",
    "account-termination": "Account termination",
    "tracking": "Tracking",
    "jurisdiction": "Jurisdiction",
}
SEVERITY_LABELS = {1: "Editorial", 2: "Minor", 3: "Notable", 4: "Significant", 5: "Major"}
STATUSES = ("skipped", "error", "unchanged", "baseline", "cosmetic", "published", "held-for-review")
SKIP_REASONS = ("robots-disallowed", "domain-already-fetched", "blocked-host")

PART = "struct<op:string,value:string>"
HUNK = "struct<index:int,removed:string,added:string,contextBefore:string,contextAfter:string>"
STATS = "struct<addedWords:int,removedWords:int,totalWords:int,ratio:double>"
DIFF = f"struct<version:int,parts:array<{PART}>,hunks:array<{HUNK}>,stats:{STATS}>"


PARTS_TYPE = T.ArrayType(T.StructType([T.StructField("op", T.StringType()), T.StructField("value", T.StringType())]))
HUNKS_TYPE = T.ArrayType(T.StructType([T.StructField("index", T.IntegerType()), *[T.StructField(n, T.StringType()) for n in ("removed", "added", "contextBefore", "contextAfter")]]))
BETWEEN_TYPE = T.StructType([T.StructField(n, T.StringType()) for n in ("before", "after")])
INNER_TYPE = T.StructType([*[T.StructField(n, T.IntegerType()) for n in ("head", "tail")], T.StructField("parts", PARTS_TYPE)])
EDITS_TYPE = T.StructType([T.StructField("inner", INNER_TYPE), T.StructField("hunks", HUNKS_TYPE), *[T.StructField(n, T.IntegerType()) for n in ("addedWords", "removedWords", "totalWords")], *BETWEEN_TYPE.fields])
EXTRACT_TYPE = T.StructType([T.StructField("title", T.StringType()), T.StructField("extracted_text", T.StringType()), T.StructField("used_fallback", T.BooleanType())])
ROBOTS_TYPE = T.StructType(
    [
        T.StructField("rules", T.ArrayType(T.StructType([T.StructField("allow", T.BooleanType()), T.StructField("pattern", T.StringType())]))),
        T.StructField("crawl_delay", T.DoubleType()),
        T.StructField("unavailable", T.BooleanType()),
    ]
)

COMPANIES = "id string not null, slug string not null, name string not null, logo_url string, tos_url string, privacy_url string, last_checked_at timestamp, created_at timestamp not null"
DOCUMENTS = "id string not null, company_id string not null, type string not null, source_url string not null, last_checked_at timestamp, last_error_at timestamp, last_error string, created_at timestamp not null"
SNAPSHOTS = "id string not null, document_id string not null, raw_html string not null, extracted_text string not null, content_hash string not null, fetched_at timestamp not null"
CHANGES = f"id string not null, document_id string not null, from_snapshot_id string not null, to_snapshot_id string not null, diff_json {DIFF} not null, headline string, summary string, user_impact string, severity int, tags array<string> not null, confidence string, change_ratio float not null, cosmetic boolean not null, needs_review boolean not null, published boolean not null, notified_at timestamp, detected_at timestamp not null"
SUBSCRIPTIONS = "id string not null, company_id string not null, email string not null, unsubscribe_token string not null, unsubscribed_at timestamp, created_at timestamp not null"
#: What a crawler lands: the engine starts from these rows and never goes to the network.
FETCHES = "document_id string, url string, http_status int, status_text string, content_type string, error string, html string, fetched_at timestamp"
ROBOTS = "origin string, http_status int, error string, body string"
SUBSCRIPTION_EVENTS = "company_id string, email string, action string, token string, at timestamp"

TABLES = {"companies": COMPANIES, "documents": DOCUMENTS, "snapshots": SNAPSHOTS, "changes": CHANGES, "subscriptions": SUBSCRIPTIONS, "fetches": FETCHES, "robots": ROBOTS, "subscription_events": SUBSCRIPTION_EVENTS}


def schema(table: str) -> T.StructType:
    """The table's schema (needs a running session to read the DDL)."""
    return T.StructType.fromDDL(TABLES[table])
