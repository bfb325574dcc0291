"""Queries over texts, revision state, views and policy, with their SQL counterparts."""

from __future__ import annotations

from pyspark.sql import functions as F

from revtrail import schemas
from revtrail.functions import formatting as fmt
from revtrail.functions import text as X
from revtrail.functions import whole
from revtrail.operators import classify, policy, state
from revtrail.plans import crawl, derived, views
from revtrail.plans.registry import ORACLES, QUERIES, TRIM, WS, B, base, query, revisions, sql_words
from revtrail.sources import landed, sinks

__all__ = ["ORACLES", "QUERIES"]

# ---- scalar functions over texts -------------------------------------------------------------------------

def _sql_punctuation(c: str) -> str:
    fold = X.SINGLE_QUOTES + X.DOUBLE_QUOTES + X.DASHES + X.BULLETS + X.SPACES
    to = "''" * len(X.SINGLE_QUOTES) + '"' * len(X.DOUBLE_QUOTES) + "-" * len(X.DASHES) + "*" * len(X.BULLETS) + " " * len(X.SPACES)
    c = f"replace(translate({c}, '{fold}{X.INVISIBLE}', '{to}'), '…', '...')"
    c = rf"regexp_replace({c}, '{WS}+([,;:.])', '\1', 'g')"
    return TRIM % f"regexp_replace({c}, '{WS}+', ' ', 'g')"


_NEG = "CASE regexp_replace(lower(x), '[^a-z]', '', 'g') " + " ".join(f"WHEN '{w}' THEN '{k}'" for w, k in X.NEGATIONS.items()) + " END"


@query("SELECT doc_id, sha256(text) AS content_hash FROM documents WHERE text IS NOT NULL", derive=False)
def content_hash(spark, d):
    return base(spark, d).select("doc_id", X.content_hash(F.col("text")).alias("content_hash"))


@query(f"SELECT doc_id, CAST(len({sql_words('text')}) AS INTEGER) AS n_words FROM documents WHERE text IS NOT NULL", derive=False)
def word_count(spark, d):
    return base(spark, d).select("doc_id", X.count_words(F.col("text")).alias("n_words"))


@query(f"SELECT document_id, rev, sha256({_sql_punctuation('extracted_text')}) AS normal_hash FROM revisions")
def punct_normalize(spark, d):
    return revisions(spark, d).select("document_id", "rev", X.content_hash(whole.punctuation_normalize(F.col("extracted_text"))).alias("normal_hash"))


_FORMS = ["2025-06-07", "7/6/2025", "June 7, 2025", "7 June 2025", "JUNE 2025", "7th jun. 2025", "7.6.25", "v1.7.6.25x", "May 2025 and Sept. 3rd 2024"]
_FORM = "CASE CAST(document_id AS BIGINT) % 9 " + " ".join(f"WHEN {i} THEN '{x}'" for i, x in enumerate(_FORMS)) + " END"
_DATED = f"concat(extracted_text, ' Dated ', {_FORM}, '.')"
for _pattern in X.DATE_PATTERNS:
    _DATED = f"regexp_replace({_DATED}, '{_pattern.replace(X.START, chr(92) + 'b').replace(X.END, chr(92) + 'b').replace(X.WS, WS)}', '@date', 'g')"


@query(f"SELECT document_id, rev, sha256({_DATED}) AS dated_hash FROM revisions")
def date_normalize(spark, d):
    dated = F.expr(f"concat(extracted_text, ' Dated ', {_FORM}, '.')")
    return revisions(spark, d).select("document_id", "rev", X.content_hash(whole.date_normalize(dated)).alias("dated_hash"))


@query(f"SELECT document_id, rev, array_to_string(list_sort(list_filter(list_transform({sql_words('extracted_text')}, lambda x: {_NEG}), lambda y: y IS NOT NULL)), ',') AS negations FROM revisions")
def negation_counts(spark, d):
    return revisions(spark, d).select("document_id", "rev", F.array_join(whole.negations(F.col("extracted_text")), ",").alias("negations"))


_SCORES = ", ".join(f"CAST({' + '.join('CAST(regexp_matches(text, %r) AS INTEGER)' % ('(?i)' + (B if p.startswith(chr(92) + 'b') else '') + p.removeprefix(chr(92) + 'b').removesuffix(chr(92) + 'b') + ('([^A-Za-z0-9_]|$)' if p.endswith(chr(92) + 'b') else '')) for p in patterns)} AS INTEGER) AS \"{tag}\"" for tag, _, patterns in classify.TAG_RULES).replace("\\\\", "\\")


@query(f"SELECT document_id, rev, {_SCORES} FROM (SELECT document_id, rev, extracted_text AS text FROM revisions)")
def tag_scores(spark, d):
    scored = revisions(spark, d).withColumn("s", classify.whole_tag_scores(F.col("extracted_text")))
    score = lambda tag: F.coalesce(F.get(F.filter("s", lambda t: t["tag"] == tag), F.lit(0))["score"], F.lit(0)).alias(tag)
    return scored.select("document_id", "rev", *[score(tag) for tag, _, _ in classify.TAG_RULES])


_FIGURES = "concat('Pay ', n, '%x or US$', n % 90, '.50 and ', n % 13, ' weeks, ', n % 7, '% off and $5; a€', n, ' then ', n % 28, ' Percent or ', n, 'days')"


@query("SELECT document_id, rev, concat(n, '%|$', n % 90, '.50|', n % 13, ' weeks|€', n, '|', n % 28, ' Percent|', n, 'days') AS quantities FROM (SELECT document_id, rev, CAST(document_id AS BIGINT) AS n FROM revisions)")
def quantities(spark, d):
    numbered = revisions(spark, d).select("document_id", "rev", F.col("document_id").cast("long").alias("n"))
    return numbered.select("document_id", "rev", F.array_join(classify.quantities(F.expr(_FIGURES)), "|").alias("quantities"))


@query("SELECT doc_id, CASE WHEN r = 0 THEN '0%' WHEN r < 0.001 THEN '<0.1%' WHEN r < 0.01 THEN concat(CAST(CAST(round(r * 100, 1) AS DECIMAL(9, 1)) AS VARCHAR), '%') ELSE concat(CAST(CAST(floor(r * 100 + 0.5) AS BIGINT) AS VARCHAR), '%') END AS percent, concat(CAST(doc_id % 3 AS VARCHAR), CASE WHEN doc_id % 3 = 1 THEN ' change' ELSE ' changes' END) AS counted, upper(substr(source, 1, 1)) AS monogram, CASE doc_id % 7 WHEN 1 THEN 'Editorial' WHEN 2 THEN 'Minor' WHEN 3 THEN 'Notable' WHEN 4 THEN 'Significant' WHEN 5 THEN 'Major' ELSE 'Unrated' END AS label FROM (SELECT doc_id, source, CAST(doc_id % 4000 AS DOUBLE) / 8192 / (1 + 31 * (doc_id % 2)) AS r FROM documents)", derive=False)
def format_values(spark, d):
    r = (F.col("doc_id") % 4000).cast("double") / 8192 / (1 + 31 * (F.col("doc_id") % 2))
    docs = spark.read.parquet(f"{d}/documents.parquet")
    return docs.select("doc_id", fmt.format_percent(r).alias("percent"), fmt.pluralize(F.col("doc_id") % 3, "change").alias("counted"), fmt.monogram(F.col("source")).alias("monogram"), fmt.severity_label(F.col("doc_id") % 7).alias("label"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%-d %b %Y') AS day, concat(strftime(o_orderdate, '%-d %b %Y, %H:%M'), ' UTC') AS moment FROM orders", derive=False)
def format_dates(spark, d):
    return spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", fmt.format_date(F.col("o_orderdate")).alias("day"), fmt.format_date_time(F.col("o_orderdate")).alias("moment"))


#: An address by id modulo 9, and whether it is well formed.
_ADDRESSES = [("user%s@@example.com", False), ("  User%s@Example.COM ", True), ("a.b+c'd_%s@sub.example.co", True), (".lead%s@example.com", False), ("two words%s@example.com", False), ("x%s@localhost", False), ("x%s@ex-ample.io", True), ("x%s@-example.com", False), ("dots..%s@example.com", False)]
_ADDRESS = "CASE event_id % 9 " + " ".join("WHEN {} THEN concat('{}', user_id, '{}')".format(i, *a.replace("'", "''").split("%s")) for i, (a, _) in enumerate(_ADDRESSES)) + " END"


@query(f"SELECT event_id, CASE WHEN event_id % 9 IN ({', '.join(str(i) for i, (_, ok) in enumerate(_ADDRESSES) if ok)}) THEN lower(trim({_ADDRESS})) END AS email FROM events", derive=False)
def email_validation(spark, d):
    return spark.read.parquet(f"{d}/events.parquet").select("event_id", fmt.clean_email(F.expr(_ADDRESS.replace("''", "\\'"))).alias("email"))


@query("SELECT event_id, event_id % 4 < 2 AS token_ok, length(repeat('s', event_id % 100)) BETWEEN 1 AND 80 AS slug_ok FROM events", derive=False)
def token_and_slug(spark, d):
    n = F.lpad(F.col("event_id").cast("string"), 12, "0")
    token = F.when(F.col("event_id") % 4 < 2, F.concat(F.lit("0a1B2c3d-0000-4000-8000-"), n)).when(F.col("event_id") % 4 == 2, F.concat(F.lit("0a1B2c3d-0000-4000-800g-"), n)).otherwise(F.concat(F.lit("0a1B2c3d000040008000"), n))
    return spark.read.parquet(f"{d}/events.parquet").select("event_id", fmt.valid_token(token).alias("token_ok"), fmt.valid_slug(F.repeat(F.lit("s"), (F.col("event_id") % 100).cast("int"))).alias("slug_ok"))


@query("SELECT event_id, CAST(CASE WHEN r > 0 AND r <= 50 THEN floor(r) ELSE 10 END AS INTEGER) AS run_limit, CAST(CASE WHEN event_id % 5 = 0 THEN 0 WHEN r > 10 THEN 10 ELSE greatest(r, 0) END AS DOUBLE) AS pause FROM (SELECT event_id, CAST(event_id % 130 AS DOUBLE) / 2 - 5 AS r FROM events)", derive=False)
def run_limits(spark, d):
    r = (F.col("event_id") % 130).cast("double") / 2 - 5
    delay = F.when(F.col("event_id") % 5 != 0, F.greatest(r, F.lit(0.0)))
    return spark.read.parquet(f"{d}/events.parquet").select("event_id", policy.run_limits(r).alias("run_limit"), policy.crawl_pause(delay).alias("pause"))


_OUTCOME = "CASE WHEN k = 0 THEN 'timeout' WHEN k = 1 THEN 'no response' WHEN k = 2 THEN 'HTTP 404 Not Found' WHEN k = 3 THEN 'HTTP 301 ' WHEN k = 4 THEN 'unsupported content-type application/pdf' WHEN k = 5 THEN 'unsupported content-type image/png' END"


@query(f"SELECT event_id, {_OUTCOME} AS failure FROM (SELECT event_id, event_id % 10 AS k FROM events)", derive=False)
def http_outcomes(spark, d):
    k = F.col("event_id") % 10
    pick = lambda **by: F.element_at(F.create_map(*[x for i, v in by.items() for x in (F.lit(int(i[1:])).cast("long"), F.lit(v))]), k)
    status, words = F.coalesce(F.when(k == 1, None).otherwise(F.coalesce(pick(_2=404, _3=301, _6=204), F.lit(200)))), pick(_2="Not Found")
    kind = F.when(k == 9, None).otherwise(F.coalesce(pick(_4="application/pdf", _5="image/png", _6="TEXT/HTML; charset=x", _7="application/xhtml+xml", _8=""), F.lit("text/plain")))
    return spark.read.parquet(f"{d}/events.parquet").select("event_id", policy.http_error(status, words, kind, F.when(k == 0, "timeout")).alias("failure"))


@query("SELECT id, CASE type WHEN 'tos' THEN 'Terms of Service' ELSE 'Privacy Policy' END AS label, CASE WHEN n > 110 THEN 46 WHEN n > 70 THEN 54 ELSE 64 END AS size, CASE WHEN n % 2 = 0 THEN 'Pricing' ELSE NULL END AS tag FROM (SELECT id, type, CAST(id AS BIGINT) % 150 AS n FROM docs)")
def card_labels(spark, d):
    n = (F.col("id").cast("long") % 150).cast("int")
    return derived.relation(spark, d, "docs").select("id", fmt.document_label(F.col("type")).alias("label"), fmt.headline_size(F.repeat(F.lit("é"), n)).alias("size"), fmt.tag_label(F.when(n % 2 == 0, "pricing").otherwise("legacy")).alias("tag"))


# ---- revision state --------------------------------------------------------------------------------------

_STATUS = "SELECT document_id, rev, CASE WHEN before IS NULL THEN 'baseline' WHEN before = h THEN 'unchanged' ELSE 'changed' END AS status FROM (SELECT document_id, rev, h, lag(h) OVER (PARTITION BY document_id ORDER BY fetched_at) AS before FROM (SELECT document_id, rev, fetched_at, sha256(extracted_text) AS h FROM revisions))"


@query(f"SELECT company_id, status, count(*) AS versions FROM ({_STATUS}) s JOIN docs ON docs.id = s.document_id GROUP BY ALL")
def change_status(spark, d):
    narrow = revisions(spark, d).select("document_id", "fetched_at", X.content_hash(F.col("extracted_text")).alias("content_hash"))
    docs = derived.relation(spark, d, "docs").select(F.col("id").alias("document_id"), "company_id")
    return state.revision_status(narrow).join(docs, "document_id").groupBy("company_id", "status").agg(F.count(F.lit(1)).alias("versions"))


@query("SELECT document_id, arg_max(concat(document_id, ':', rev), fetched_at) AS snapshot_id, arg_max(sha256(extracted_text), fetched_at) AS content_hash, max(fetched_at) AS fetched_at FROM revisions GROUP BY document_id")
def latest_snapshot(spark, d):
    return views.documents_with_latest(derived.tables(spark, d))


@query("SELECT docs.id, type, source_url, docs.last_checked_at, companies.id AS company_id, slug AS company_slug, name AS company_name FROM docs JOIN companies ON company_id = companies.id ORDER BY docs.last_checked_at NULLS FIRST, docs.id LIMIT 10")
def due_batch(spark, d):
    return views.due_batch(derived.tables(spark, d))


# ---- read queries ----------------------------------------------------------------------------------------

_FEED = "c.id, coalesce(c.headline, 'Change detected') AS headline, coalesce(c.summary, '') AS summary, coalesce(c.user_impact, '') AS user_impact, coalesce(c.severity, 3) AS severity, array_to_string(c.tags, ',') AS tags, c.confidence, c.detected_at, d.type AS document_type, o.slug AS company_slug, o.name AS company_name, o.logo_url"
_CDO = "changes c JOIN docs d ON c.document_id = d.id JOIN companies o ON d.company_id = o.id"
_NEWEST = "ORDER BY c.detected_at DESC, c.id DESC"


@query(f"SELECT {_FEED} FROM {_CDO} WHERE c.published {_NEWEST} LIMIT 50")
def feed(spark, d):
    return views.feed(derived.tables(spark, d))


@query("SELECT o.*, CAST(count(c.id) FILTER (WHERE c.published) AS INTEGER) AS published_changes FROM companies o LEFT JOIN docs d ON d.company_id = o.id LEFT JOIN changes c ON c.document_id = d.id GROUP BY ALL")
def companies_rollup(spark, d):
    return views.companies_rollup(derived.tables(spark, d))


@query("SELECT slug FROM companies")
def company_slugs(spark, d):
    return views.company_slugs(derived.tables(spark, d))


@query(f"SELECT {_FEED}, 'published' AS section FROM {_CDO} WHERE c.published AND o.slug = '{derived.COMPANY}' UNION ALL (SELECT {_FEED}, 'cosmetic' FROM {_CDO} WHERE c.cosmetic AND o.slug = '{derived.COMPANY}' {_NEWEST} LIMIT 20)")
def timeline(spark, d):
    return views.timeline(derived.tables(spark, d), derived.COMPANY)


@query(f"SELECT CAST(count(*) AS INTEGER) AS published_changes FROM {_CDO} WHERE c.published AND o.slug = '{derived.COMPANY}'")
def timeline_count(spark, d):
    return views.published_count(derived.tables(spark, d), derived.COMPANY)


_SNAPS = "(SELECT concat(document_id, ':', rev) AS id, fetched_at, sha256(extracted_text) AS content_hash FROM revisions)"


@query(f"SELECT {_FEED}, d.source_url, c.cosmetic, c.needs_review, c.published, c.change_ratio, a.fetched_at AS from_fetched_at, b.fetched_at AS to_fetched_at, a.content_hash AS from_hash, b.content_hash AS to_hash FROM {_CDO} JOIN {_SNAPS} a ON a.id = from_snapshot_id JOIN {_SNAPS} b ON b.id = to_snapshot_id WHERE c.id = '{derived.CHANGE}'")
def change_detail(spark, d):
    return views.change_detail(derived.tables(spark, d), derived.CHANGE)


@query("SELECT id FROM changes WHERE published ORDER BY detected_at DESC, id DESC LIMIT 200")
def change_ids(spark, d):
    return views.change_ids(derived.tables(spark, d))


@query(f"SELECT c.id, d.type AS document_type, CASE WHEN c.cosmetic THEN 'cosmetic' WHEN c.published THEN 'published' ELSE 'held for review' END AS state, c.severity, CASE c.severity WHEN 1 THEN 'Editorial' WHEN 2 THEN 'Minor' WHEN 3 THEN 'Notable' WHEN 4 THEN 'Significant' WHEN 5 THEN 'Major' ELSE 'Unrated' END AS severity_label, c.detected_at FROM {_CDO} WHERE o.slug = '{derived.COMPANY}'")
def inspect_company(spark, d):
    return views.inspect(derived.tables(spark, d), derived.COMPANY)


_SUBS = "(SELECT sha256(concat(company_id, '|', email)) AS id, company_id, email, arg_min(token, happened) FILTER (WHERE action = 'subscribe') AS unsubscribe_token, min(happened) FILTER (WHERE action = 'subscribe') AS created_at, CASE WHEN max(happened) FILTER (WHERE action <> 'subscribe') > max(happened) FILTER (WHERE action = 'subscribe') THEN max(happened) FILTER (WHERE action <> 'subscribe') END AS unsubscribed_at FROM sub_events GROUP BY company_id, email HAVING created_at IS NOT NULL)"


@query(f"SELECT s.id, s.email, o.slug AS company_slug, CASE WHEN s.unsubscribed_at IS NULL THEN 'active' ELSE 'unsubscribed' END AS state, s.created_at FROM {_SUBS} s JOIN companies o ON s.company_id = o.id")
def subscriptions(spark, d):
    return views.subscriptions(derived.tables(spark, d))


@query(f"SELECT * FROM {_SUBS}")
def subscription_fold(spark, d):
    return state.subscriptions_from(derived.relation(spark, d, "sub_events"))


@query(f"SELECT s.id, CASE WHEN s.created_at % 3 = 0 THEN 9000000 + s.created_at ELSE s.unsubscribed_at END AS unsubscribed_at FROM {_SUBS} s")
def unsubscribe_by_token(spark, d):
    subs = state.subscriptions_from(derived.relation(spark, d, "sub_events"))
    requests = subs.where("created_at % 3 = 0").select(F.col("unsubscribe_token").alias("token"), (F.col("created_at") + 9000000).alias("at"))
    return state.unsubscribe(subs, requests).select("id", "unsubscribed_at")


@query(f"SELECT c.id AS change_id, s.email, s.unsubscribe_token, o.name AS company_name, d.type AS document_type, replace(replace(replace(coalesce(c.headline, 'A change was detected'), '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS headline, coalesce(c.summary, '') AS summary FROM {_CDO} JOIN {_SUBS} s ON s.company_id = d.company_id WHERE c.published AND c.notified_at IS NULL AND s.unsubscribed_at IS NULL AND c.detected_at % 17 <> 0")
def recipients(spark, d):
    t = derived.tables(spark, d)
    ledger = t.changes.where("detected_at % 17 = 0").select(F.col("id").alias("change_id"))
    return views.recipients(t, ledger)


@query("SELECT id, published OR (NOT cosmetic AND detected_at % 5 = 0) AS published, needs_review AND NOT (NOT cosmetic AND detected_at % 5 = 0) AS needs_review FROM changes")
def publish_by_hand(spark, d):
    changes = derived.relation(spark, d, "changes")
    return state.publish(changes, changes.where("detected_at % 5 = 0").select("id")).select("id", "published", "needs_review")


@query("SELECT id, slug, CASE WHEN length(slug) = 4 THEN concat(name, ' Ltd') ELSE name END AS name, last_checked_at FROM companies UNION ALL SELECT 'new', 'new', 'New', NULL")
def upsert_companies(spark, d):
    companies = derived.relation(spark, d, "companies").select("id", "slug", "name", "last_checked_at")
    incoming = companies.where("length(slug) = 4").select(F.lit("ignored").alias("id"), "slug", F.concat("name", F.lit(" Ltd")).alias("name")).unionByName(spark.range(1).select(F.lit("new").alias("id"), F.lit("new").alias("slug"), F.lit("New").alias("name")))
    return state.upsert(companies, incoming, ["slug"], ["name"])


@query("SELECT id, CASE WHEN n % 3 = 0 THEN last_checked_at ELSE 2000000 + n END AS last_checked_at, CASE WHEN n % 3 = 1 THEN 2000000 + n END AS last_error_at, CASE WHEN n % 3 = 1 THEN 'HTTP 500 ' END AS last_error FROM (SELECT *, CAST(id AS BIGINT) AS n FROM docs)")
def document_clocks(spark, d):
    docs = derived.relation(spark, d, "docs").withColumn("last_error_at", F.lit(None).cast("long")).withColumn("last_error", F.lit(None).cast("string"))
    n = F.col("id").cast("long")
    outcomes = docs.select(F.col("id").alias("document_id"), F.when(n % 3 == 0, "skipped").when(n % 3 == 1, "error").otherwise("unchanged").alias("status"), F.when(n % 3 == 1, "HTTP 500 ").alias("detail"), (n + 2000000).alias("at"))
    return state.document_clocks(docs, outcomes).select("id", "last_checked_at", "last_error_at", "last_error")


@query("SELECT 'companies' AS table_name, CAST(count(*) AS INTEGER) AS rows FROM companies UNION ALL SELECT 'documents', CAST(count(*) AS INTEGER) FROM docs")
def table_counts(spark, d):
    return views.table_counts(derived.tables(spark, d))


# ---- policy ----------------------------------------------------------------------------------------------


@query("SELECT id, source_url, host, CASE WHEN k > 1 THEN 'domain-already-fetched' END AS skip_reason FROM (SELECT *, row_number() OVER (PARTITION BY host ORDER BY last_checked_at NULLS FIRST, id) AS k FROM (SELECT id, source_url, last_checked_at, regexp_extract(source_url, '^https://([^/]*)', 1) AS host FROM docs ORDER BY last_checked_at NULLS FIRST, id LIMIT 50))")
def domain_gate(spark, d):
    return views.gate(derived.tables(spark, d), 50)


_PROBES = "CASE page_id % 6 WHEN 0 THEN url WHEN 1 THEN concat('http://10.0.0.', CAST(page_id % 250 AS VARCHAR(20)), '/x') WHEN 2 THEN concat('ftp://files.example/', CAST(page_id AS VARCHAR(20))) WHEN 3 THEN 'http://localhost:8080/a' WHEN 4 THEN concat('https://172.', CAST(10 + page_id % 30 AS VARCHAR(20)), '.0.1/') ELSE concat('https://192.168.0.1:443/', CAST(page_id AS VARCHAR(20))) END"


@query(f"SELECT page_id, CASE WHEN page_id % 6 = 2 THEN 'unsupported protocol ftp:' WHEN page_id % 6 = 3 THEN 'localhost is not crawlable' WHEN page_id % 6 IN (1, 5) THEN 'private address' WHEN page_id % 6 = 4 AND 10 + page_id % 30 BETWEEN 16 AND 31 THEN 'private address' END AS block, CASE page_id % 6 WHEN 5 THEN '192.168.0.1' WHEN 3 THEN 'localhost:8080' ELSE regexp_extract(u, '://([^/?#]*)', 1) END AS host FROM (SELECT page_id, {_PROBES} AS u FROM pages)", derive=False)
def host_guard(spark, d):
    pages = spark.read.parquet(f"{d}/pages.parquet").select("page_id", F.expr(_PROBES).alias("u"))
    return pages.select("page_id", policy.host_block(F.col("u")).alias("block"), policy.url_host(F.col("u")).alias("host"))


ROBOTS = "User-agent: *\nDisallow: /en/1\nAllow: /en/12\nDisallow: /*.html$\nCrawl-delay: 2.5\n\nUser-agent: other\nDisallow: /"


@query(r"SELECT page_id, CASE WHEN starts_with(p, '/en/12') AND NOT ends_with(p, '.html') THEN true WHEN ends_with(p, '.html') AND NOT starts_with(p, '/en/12') THEN false WHEN ends_with(p, '.html') THEN false ELSE NOT starts_with(p, '/en/1') END AS allowed FROM (SELECT page_id, regexp_extract(url, '^https?://[^/?#]*([^#]*)', 1) AS p FROM pages)", derive=False)
def robots_allowed(spark, d):
    rules = F.array(*[F.struct(F.lit(r["allow"]).alias("allow"), F.lit(r["pattern"]).alias("pattern")) for r in policy.parse_robots(ROBOTS)["rules"]])
    return spark.read.parquet(f"{d}/pages.parquet").select("page_id", policy.is_allowed(rules, F.col("url")).alias("allowed"))




#: A robots file by page id modulo 6.
_ROBOTS = [
    "User-agent: *\nDisallow: /en/\nAllow: /en/2\nCrawl-delay: 3",
    "User-agent: other\nDisallow: /\n\nUser-agent: REVTRAIL # us\nUser-agent: third\nDisallow: /fr/\nCrawl-delay: 12\n\nUser-agent: *\nDisallow: /",
    "User-agent: revtrail\nDisallow:\n\nUser-agent: *\nDisallow: /de",
    "# nothing binds\nDisallow: /\nUser-agent: other\nDisallow: /",
    "User-agent: *\nDisallow: /*?page=\nDisallow: /es/*1$\nCrawl-delay: soon",
    "",
]
_FITS = {"0": "starts_with(p, '/en/2') OR NOT starts_with(p, '/en/')", "1": "NOT starts_with(p, '/fr/')", "2": "NOT starts_with(p, '/de')", "4": "NOT (contains(p, '?page=') OR (starts_with(p, '/es/') AND ends_with(p, '1')))"}


@query(f"SELECT page_id, CASE page_id % 6 {' '.join(f'WHEN {k} THEN {v}' for k, v in _FITS.items())} ELSE true END AS allowed, CAST(CASE page_id % 6 WHEN 0 THEN 3 WHEN 1 THEN 12 END AS DOUBLE) AS crawl_delay FROM (SELECT page_id, regexp_extract(url, '^https?://[^/?#]*([^#]*)', 1) AS p FROM pages)", derive=False)
def robots_files(spark, d):
    body = F.element_at(F.array(*map(F.lit, _ROBOTS)), (F.col("page_id") % 6 + 1).cast("int"))
    parsed = spark.read.parquet(f"{d}/pages.parquet").select("page_id", "url", policy.robots_rules(body).alias("r"))
    return parsed.select("page_id", policy.is_allowed(F.col("r.rules"), F.col("url")).alias("allowed"), F.col("r.crawl_delay").cast("double").alias("crawl_delay"))


@query("SELECT page_id, CASE page_id % 4 WHEN 0 THEN true WHEN 3 THEN NOT starts_with(p, '/fr/') ELSE false END AS allowed, page_id % 4 IN (1, 2) AS unavailable FROM (SELECT page_id, regexp_extract(url, '^https?://[^/?#]*([^#]*)', 1) AS p FROM pages)", derive=False)
def robots_sources(spark, d):
    """What a robots file means by how it was answered: not found, failed, no answer, found."""
    k = F.col("page_id") % 4
    status = F.when(k == 0, 404).when(k == 1, 503).when(k == 3, 200)
    pages = spark.read.parquet(f"{d}/pages.parquet").select("page_id", "url", policy.robots_for(status, F.when(k == 2, "timeout"), F.lit("User-agent: *\nDisallow: /fr/")).alias("r"))
    return pages.select("page_id", policy.is_allowed(F.col("r.rules"), F.col("url")).alias("allowed"), F.col("r.unavailable").alias("unavailable"))


@query("SELECT doc_id, CAST(list_max(list_filter(range(0, least(64, len(text)) + 1), lambda k: strlen(text[:k]) <= 64)) AS INTEGER) AS kept FROM documents WHERE text IS NOT NULL", derive=False)
def capped_bodies(spark, d):
    """Characters left of a body cut at 64 bytes; half a character is no character."""
    cut = policy.capped_body(F.encode("text", "UTF-8"), 64)
    return base(spark, d).select("doc_id", F.char_length(F.regexp_replace(cut, "\ufffd+$", "")).alias("kept"))


_HOST = "regexp_extract(source_url, '^https://([^/]*)', 1)"


@query(f"""SELECT id, CASE WHEN n % 10 = 1 THEN 'blocked-host' WHEN n % 10 = 2 THEN 'error' WHEN k > 1 THEN 'domain-already-fetched' WHEN ends_with(host, ':8443') OR n % 2 = 1 THEN 'robots-disallowed' END AS skip_reason
FROM (SELECT *, row_number() OVER (PARTITION BY host, n % 10 IN (1, 2) ORDER BY last_checked_at NULLS FIRST, id) AS k FROM (SELECT id, last_checked_at, CAST(id AS BIGINT) AS n, {_HOST} AS host FROM docs))""")
def admitted(spark, d):
    docs = derived.relation(spark, d, "docs")
    n = F.col("id").cast("long")
    due = docs.withColumn("source_url", F.when(n % 10 == 1, F.concat(F.lit("http://10.0.0.1/"), "id")).when(n % 10 == 2, F.concat(F.lit("no url "), "id")).otherwise(F.concat("source_url", F.when(n % 2 == 1, "/odd").otherwise(""))))
    hosts = docs.select(F.regexp_extract("source_url", "^(https://[^/]*)", 1).alias("origin")).distinct()
    robots = hosts.select("origin", F.when(F.col("origin").endswith(":8443"), 503).otherwise(200).alias("http_status"), F.lit(None).cast("string").alias("error"), F.lit("User-agent: *\nDisallow: /*/odd$").alias("body"))
    return crawl.admit(due, robots).select("id", "skip_reason")


# ---- state and sinks -------------------------------------------------------------------------------------


@query(f"SELECT slug FROM docs d JOIN companies o ON d.company_id = o.id WHERE d.id = '{derived.CHANGE.split('-')[0]}'")
def company_of_document(spark, d):
    return views.company_of_document(derived.tables(spark, d), derived.CHANGE.split("-")[0])


@query(f"SELECT d.id, type, source_url, d.last_checked_at, o.id AS company_id, slug AS company_slug, name AS company_name FROM docs d JOIN companies o ON company_id = o.id WHERE d.id = '{derived.CHANGE.split('-')[0]}'")
def due_document(spark, d):
    return views.due_batch(derived.tables(spark, d), document_id=derived.CHANGE.split("-")[0])


@query("SELECT id, company_id, type, CASE WHEN type = 'tos' AND length(company_id) = 4 THEN concat('https://new.example/', company_id) ELSE source_url END AS source_url FROM (SELECT min(id) AS id, company_id, type, min(source_url) AS source_url FROM docs GROUP BY company_id, type) UNION ALL SELECT 'new', 'newco', 'privacy', 'https://new.example/p'")
def upsert_documents(spark, d):
    current = derived.relation(spark, d, "docs").groupBy("company_id", "type").agg(F.min("id").alias("id"), F.min("source_url").alias("source_url")).select("id", "company_id", "type", "source_url")
    some = current.where("type = 'tos' and length(company_id) = 4").select(F.lit("ignored").alias("id"), "company_id", "type", F.concat(F.lit("https://new.example/"), "company_id").alias("source_url"))
    new = spark.range(1).select(F.lit("new").alias("id"), F.lit("newco").alias("company_id"), F.lit("privacy").alias("type"), F.lit("https://new.example/p").alias("source_url"))
    return state.upsert(current, some.unionByName(new), ["company_id", "type"], ["source_url"])


@query("SELECT o.id, coalesce(max(2000000 + CAST(d.id AS BIGINT)) FILTER (WHERE CAST(d.id AS BIGINT) % 3 = 2), any_value(o.last_checked_at)) AS last_checked_at FROM companies o LEFT JOIN docs d ON d.company_id = o.id GROUP BY o.id")
def company_clocks(spark, d):
    docs = derived.relation(spark, d, "docs")
    n = F.col("id").cast("long")
    outcomes = docs.select(F.col("id").alias("document_id"), F.when(n % 3 == 0, "skipped").when(n % 3 == 1, "error").otherwise("unchanged").alias("status"), (n + 2000000).alias("at"))
    return state.company_clocks(derived.relation(spark, d, "companies"), docs, outcomes).select("id", "last_checked_at")


_VOCABULARY = ", ".join(f"'{t}'" for t in schemas.TAGS)


@query(f"SELECT id FROM changes WHERE (severity IS NULL OR severity * 2 - 3 BETWEEN 1 AND 5) AND len(list_filter(tags, lambda t: t NOT IN ({_VOCABULARY}))) = 0")
def valid_changes(spark, d):
    return sinks.valid_changes(derived.relation(spark, d, "changes").withColumn("severity", F.col("severity") * 2 - 3)).select("id")


@query(f"SELECT id, array_to_string(list_filter(tags, lambda t: t IN ({_VOCABULARY})), ',') AS known, array_to_string(list_filter(list_concat(tags, ['arbitration', 'x', 'jurisdiction']), lambda t: t IN ({_VOCABULARY}))[1:3], ',') AS first_three FROM changes")
def known_tags(spark, d):
    more = F.concat("tags", F.array(F.lit("arbitration"), F.lit("x"), F.lit("jurisdiction")))
    return derived.relation(spark, d, "changes").select("id", F.array_join(fmt.known_tags(F.col("tags")), ",").alias("known"), F.array_join(fmt.known_tags(more, 3), ",").alias("first_three"))


@query("SELECT DISTINCT company_id AS company_slug FROM changes c JOIN docs d ON c.document_id = d.id WHERE c.published")
def to_revalidate(spark, d):
    docs = derived.relation(spark, d, "docs").select(F.col("id").alias("document_id"), F.col("company_id").alias("company_slug"))
    return crawl.to_revalidate(derived.relation(spark, d, "changes").join(docs, "document_id"))


_RAW = "coalesce(c.headline, 'A change was detected')"
_ESCAPED = "replace(replace(replace(%s, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"


@query(f"""SELECT change_id, "to", concat(company_name, ': ', headline) AS subject, concat('<h2>', {_ESCAPED % 'headline'}, '</h2><p>', {_ESCAPED % 'summary'}, '</p><p><a href="https://x.example/change/', change_id, '">See the change</a></p><p><a href="https://x.example/unsubscribe/', token, '">Stop these mails about ', company_name, '</a></p>') AS html,
  concat(headline, chr(10), chr(10), summary, chr(10), chr(10), 'Change: https://x.example/change/', change_id, chr(10), 'Unsubscribe: https://x.example/unsubscribe/', token) AS text
FROM (SELECT c.id AS change_id, s.email AS "to", s.unsubscribe_token AS token, o.name AS company_name, {_RAW} AS headline, coalesce(c.summary, '') AS summary FROM {_CDO} JOIN {_SUBS} s ON s.company_id = d.company_id WHERE c.published AND c.notified_at IS NULL AND s.unsubscribed_at IS NULL AND c.detected_at % 17 <> 0)""")
def mails(spark, d):
    t = derived.tables(spark, d)
    changes, active = views.due_notifications(t, t.changes.where("detected_at % 17 = 0").select(F.col("id").alias("change_id")))
    return sinks.addressed(views.crossed(sinks.drafts(changes, "https://x.example/"), active, "company_id"), "https://x.example/")


@query(f"""SELECT s.id AS subscription_id, s.email AS "to", concat('Watching ', o.name) AS subject, concat('<p>A mail will follow whenever <strong>', o.name, '</strong> changes its terms or its privacy policy.</p><p><a href="https://x.example/company/', o.slug, '">What changed so far</a></p><p><a href="https://x.example/unsubscribe/', unsubscribe_token, '">Unsubscribe</a></p>') AS html,
  concat('A mail will follow whenever ', o.name, ' changes its terms or its privacy policy.', chr(10), chr(10), 'Timeline: https://x.example/company/', o.slug, chr(10), 'Unsubscribe: https://x.example/unsubscribe/', unsubscribe_token) AS text FROM {_SUBS} s JOIN companies o ON s.company_id = o.id""")
def confirmation_mails(spark, d):
    t = derived.tables(spark, d)
    return sinks.confirmations(t.subscriptions, t.companies, "https://x.example")


_SEED = ", ".join("(" + ", ".join(f"'{x}'" for x in row) + ")" for row in landed.SEED)


@query(f"SELECT slug, name, concat('https://www.google.com/s2/favicons?domain=', domain, '&sz=128') AS logo_url, type, CASE type WHEN 'tos' THEN tos ELSE privacy END AS source_url FROM (VALUES {_SEED}) s(slug, name, domain, tos, privacy), (VALUES ('tos'), ('privacy')) k(type)", derive=False)
def seed_list(spark, d):
    companies, documents = landed.seed(spark)
    return documents.join(companies.select(F.col("id").alias("company_id"), "slug", "name", "logo_url"), "company_id").select("slug", "name", "logo_url", "type", "source_url")


from revtrail.plans import catalog_changes as _changes  # noqa: E402, F401  registers its queries
