"""Queries over diffs of revisions and over whole crawls.

The second version of a derived document changes its clause in a way known by the id (``derived.EDITS``), so what
a diff, a verdict or a summary must say is written out below, by reasoning, and put into SQL as constants.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from revtrail import schemas
from revtrail.functions import formatting as fmt
from revtrail.functions import text as X
from revtrail.operators import classify, diff, extract
from revtrail.plans import crawl, derived, views
from revtrail.plans.registry import B, TRIM, WS, base, query, revisions, sql_text, sql_words
from revtrail.sources.landed import spread

#: By id modulo 6: (removed, added, context before, context after) of each hunk of the second version.
HUNKS = {
    1: [("7 June", "19 August", 'The "Portal" is offered as a courtesy. Effective', "2025.")],
    2: [('"', "“", "Reports reach auditors, insurers, couriers. The", "Portal"), ('"', "”", "Portal", "is offered as a courtesy. Effective 7 June 2025.")],
    3: [("never", "", "They replace all earlier ones. Your records are", "handed to advertisers. Backups are retained and stored for 90 days before deletion.")],
    4: [("auditors", "couriers", "Backups are retained and stored for 90 days before deletion. Reports reach", ", insurers,"), ("couriers", "auditors", ", insurers,", '. The "Portal" is offered as a courtesy.')],
    5: [("90", "45", "Your records are never handed to advertisers. Backups are retained and stored for", "days before deletion. Reports reach auditors, insurers, couriers.")],
}
#: Words that one side of the change has: (first version, second version).
WORDS = {1: (2, 2), 2: (2, 2), 3: (1, 0), 4: (2, 2), 5: (1, 1)}
#: Why the change is cosmetic where little enough changed; 3 flips a negation, 5 changes a figure.
REASONS = {1: "date-only", 2: "punctuation-only", 4: "reordering-only"}
#: What the first version has before the first difference and after the last, and its parts between.
BETWEEN = {
    1: [("delete", "7 June "), ("insert", "19 August ")],
    2: [("delete", '"'), ("insert", "“"), ("equal", "Portal"), ("delete", '" '), ("insert", "” ")],
    3: [("delete", "never ")],
    4: [("delete", "auditors"), ("insert", "couriers"), ("equal", ", insurers, "), ("delete", "couriers"), ("insert", "auditors")],
    5: [("delete", "90 "), ("insert", "45 ")],
}
_HEAD = {m: derived.CLAUSE[: derived.CLAUSE.index("".join(v for op, v in parts if op != "insert"))] for m, parts in BETWEEN.items()}
_TAIL = {m: derived.CLAUSE[len(_HEAD[m]) + sum(len(v) for op, v in parts if op != "insert") :] for m, parts in BETWEEN.items()}
#: (tags, topic) of the passages; the scores decide whether one topic dominates.
TOPICS = {1: ("", "Policy wording"), 2: ("", "Policy wording"), 3: ("data-retention,tracking", "Data retention"), 4: ("data-retention", "Data retention"), 5: ("data-retention,tracking", "Data retention")}


def _both(m: int, k: int, pair):
    """A (first, second) pair as (before, after): the third version undoes the second."""
    return pair if k == 2 else pair[::-1]


def _values(rows: list[tuple]) -> str:
    put = lambda v: sql_text(v) if isinstance(v, str) else "NULL" if v is None else str(v)
    return "(VALUES " + ", ".join("(" + ", ".join(map(put, r)) + ")" for r in rows) + ")"


_HUNK_ROWS = _values([(m, k, i, *_both(m, k, (r, a)), b, c) for m, hunks in HUNKS.items() for k in (2, 3) for i, (r, a, b, c) in enumerate(hunks)]) + ' h(m, k, i, removed, added, "contextBefore", "contextAfter")'
_FACT_ROWS = _values([(m, k, *_both(m, k, WORDS[m]), REASONS.get(m), len(HUNKS[m])) for m in HUNKS for k in (2, 3)]) + " f(m, k, gone, came, reason, n_hunks)"
_N_WORDS = f"len({sql_words('extracted_text')})"
#: Every changed version with its figures.
_JUDGED = f"""(SELECT document_id, rev, m, CAST(came AS INTEGER) AS "addedWords", CAST(gone AS INTEGER) AS "removedWords", CAST(total AS INTEGER) AS "totalWords", CAST(came + gone AS DOUBLE) / total AS ratio,
  CASE WHEN CAST(came + gone AS DOUBLE) / total < 0.005 THEN reason END AS reason, CAST(n_hunks AS INTEGER) AS n_hunks
  FROM (SELECT document_id, rev, CAST(document_id AS BIGINT) % 6 AS m, greatest(n, lag(n) OVER (PARTITION BY document_id ORDER BY rev)) AS total FROM (SELECT document_id, rev, {_N_WORDS} AS n FROM revisions)) JOIN {_FACT_ROWS} USING (m) WHERE rev = k)"""


def _pairs(spark: SparkSession, d: str, **more) -> DataFrame:
    """Every revision whose text differs from its predecessor's: one shuffle, by document."""
    before = F.lag("extracted_text").over(Window.partitionBy("document_id").orderBy("rev"))
    return revisions(spark, d).select("document_id", "rev", before.alias("before"), F.col("extracted_text").alias("after")).where("before <> after")


def _diffs(spark: SparkSession, d: str) -> DataFrame:
    return diff.with_diff(_pairs(spark, d), "before", "after")


_FRAGMENTS = f"string_split(regexp_replace({TRIM % 'text'}, '([.!?;]){WS}+', '\\1' || chr(1), 'g'), chr(1))"
_OPEN = f"regexp_matches(x, '(?i){B}(?:{X.ABBREVIATIONS}|[a-z]|[0-9]+)[.]$')"


@query(f"""SELECT doc_id, CAST(CASE WHEN t = '' THEN 0 ELSE len(ends) + CASE WHEN len(ends) > 0 AND ends[-1] = len(f) THEN 0 ELSE 1 END END AS INTEGER) AS n_sentences,
  array_to_string(f[1 : CASE WHEN len(ends) >= 2 THEN ends[2] ELSE len(f) END], ' ') AS lead, array_to_string(f[CASE WHEN len(ends) > 0 AND ends[-1] = len(f) THEN CASE WHEN len(ends) > 1 THEN ends[-2] + 1 ELSE 1 END ELSE CASE WHEN len(ends) > 0 THEN ends[-1] + 1 ELSE 1 END END :], ' ') AS last_one
FROM (SELECT doc_id, t, f, list_filter(range(1, len(f) + 1), lambda i: NOT list_transform(f, lambda x: {_OPEN})[i]) AS ends FROM (SELECT doc_id, {TRIM % 'text'} AS t, {_FRAGMENTS} AS f FROM documents WHERE text IS NOT NULL))""", derive=False)
def sentences(spark, d):
    text = F.col("text")
    return base(spark, d).select("doc_id", F.size(X.split_sentences(text)).alias("n_sentences"), X.first_sentences(text, 2).alias("lead"), X.last_sentences(text, 1).alias("last_one"))


@query("SELECT document_id, rev, CAST(document_id AS BIGINT) % 6 = 3 AS negation_changed, CAST(document_id AS BIGINT) % 6 IN (1, 2, 4) AS same_words FROM revisions WHERE rev > 1 AND CAST(document_id AS BIGINT) % 6 <> 0")
def passage_checks(spark, d):
    """Whether a negation changed, and whether the words but for dates and punctuation are the same multiset."""
    bare = lambda c: X.words(F.regexp_replace(X.date_normalize(X.punctuation_normalize(F.col(c))), "[\",.]", ""))
    cut = _pairs(spark, d).select("document_id", "rev", diff.text_between(F.col("before"), F.col("after")).alias("t")).select("document_id", "rev", "t.*")
    return cut.select("document_id", "rev", X.negation_changed(F.col("before"), F.col("after")).alias("negation_changed"), X.multiset_equal(bare("before"), bare("after")).alias("same_words"))


@query(f'SELECT CAST(doc_id AS VARCHAR) AS document_id, CAST(k AS INTEGER) AS rev, CAST(i AS INTEGER) AS index, removed, added, "contextBefore", "contextAfter" FROM base JOIN {_HUNK_ROWS} ON doc_id % 6 = m')
def diff_hunks(spark, d):
    return _diffs(spark, d).select("document_id", "rev", F.explode("hunks").alias("h")).select("document_id", "rev", "h.*")


@query(f'SELECT document_id, rev, "addedWords", "removedWords", "totalWords", ratio, reason IS NOT NULL AS cosmetic, reason AS cosmetic_reason, n_hunks FROM {_JUDGED}')
def cosmetic_verdict(spark, d):
    return _diffs(spark, d).select("document_id", "rev", "stats.*", "cosmetic", "cosmetic_reason", F.size("hunks").alias("n_hunks"))


def _change_table(spark: SparkSession, d: str) -> views.Tables:
    """The tables with changes that hold their diffs."""
    t = derived.tables(spark, d)
    found = _pairs(spark, d).withColumn("_change", F.concat_ws("-", "document_id", F.col("rev").cast("string")))
    diffs = diff.with_diff(found, "before", "after").select("_change", diff.diff_json().alias("diff_json"))
    return views.Tables(t.companies, t.documents, t.snapshots, t.changes.join(diffs, F.col("id") == F.col("_change")).drop("_change"), t.subscriptions)


_CHANGE_M, _CHANGE_K = int(derived.CHANGE.split("-")[0]) % 6, int(derived.CHANGE.split("-")[1])


@query(f"SELECT 1 AS version, CAST(i AS INTEGER) AS index, removed, added FROM {_HUNK_ROWS} WHERE m = {_CHANGE_M} AND k = {_CHANGE_K} AND EXISTS (FROM base WHERE doc_id = {derived.CHANGE.split('-')[0]})")
def change_diff(spark, d):
    return views.change_diff(_change_table(spark, d), derived.CHANGE).select("diff_json.version", F.explode("diff_json.hunks").alias("h")).select("version", "h.index", "h.removed", "h.added")


@query(f"SELECT c.id, CASE WHEN c.cosmetic THEN 'cosmetic' WHEN c.published THEN 'published' ELSE 'held for review' END AS state, CAST(i AS INTEGER) AS index, removed, added FROM changes c JOIN docs d ON c.document_id = d.id JOIN {_HUNK_ROWS} ON CAST(d.id AS BIGINT) % 6 = m AND c.id = concat(d.id, '-', k) WHERE d.company_id = '{derived.COMPANY}' AND i < 8")
def inspect_hunks(spark, d):
    return views.inspect(_change_table(spark, d), derived.COMPANY).select("id", "state", F.explode("hunks").alias("h")).select("id", "state", "h.index", "h.removed", "h.added")


def _sentence(m: int, k: int) -> tuple:
    """headline, summary (of '@'), user_impact, severity, tags, confidence."""
    (removed, added, *_), n = HUNKS[m][0], len(HUNKS[m])
    removed, added = _both(m, k, (removed, added))
    tags, topic = TOPICS[m]
    impact = "Impact not assessed — this summary was produced without a language model and needs review."
    said = " and ".join([f"it removed “{removed}”"] * (removed != "") + [f"it added “{added}”"] * (added != ""))
    summary = f"{n} passage{'s' * (n > 1)} of the @ changed. In the largest, {said}." + " 1 other passage also changed." * (n > 1)
    headline, severity, confidence = f"{topic} reworded in {n} place{'s' * (n > 1)}", 3, "low"
    if m == 3:
        headline = f"{topic}: wording removed from 1 place" if k == 2 else f"{topic}: new wording added in 1 place"
    if m == 5:
        headline, severity, confidence = f"{topic} changed from {removed} days to {added} days", 4, "medium"
        impact = f"The figure that applies to you changed from {removed} days to {added} days."
    return headline, summary, impact, severity, tags, confidence


_SAID_ROWS = _values([(m, k, *_sentence(m, k)) for m in HUNKS for k in (2, 3)]) + " s(m, k, headline, summary, user_impact, severity, tags, confidence)"


def _summaries(spark: SparkSession, d: str) -> DataFrame:
    about = derived.relation(spark, d, "docs").select(F.col("id").alias("document_id"), F.col("type").alias("document_type"), F.col("company_id").alias("company_name"))
    named = _diffs(spark, d).where("not cosmetic").join(about, "document_id").withColumn("document_title", F.lit(None).cast("string"))
    return classify.summarize_heuristically(named.drop("before", "after", "parts"))


@query(f"SELECT document_id, rev, headline, replace(summary, '@', CASE type WHEN 'tos' THEN 'terms of service' ELSE 'privacy policy' END) AS summary, user_impact, CAST(severity AS INTEGER) AS severity, tags, confidence, confidence <> 'low' AS publish, true AS valid FROM {_JUDGED} j JOIN docs ON docs.id = document_id JOIN {_SAID_ROWS} USING (m) WHERE s.k = j.rev AND reason IS NULL")
def heuristic_summary(spark, d):
    return _summaries(spark, d).select("document_id", "rev", "headline", "summary", "user_impact", "severity", F.array_join("tags", ",").alias("tags"), "confidence", classify.should_publish(F.col("confidence")).alias("publish"), classify.valid_summary().alias("valid"))


def _passage(i: int, removed: str, added: str, before: str, after: str) -> str:
    fields = [("context-before", before), ("removed", removed), ("added", added), ("context-after", after)]
    return "\n".join([f'<passage index="{i + 1}">', *[f"<{tag}>{x}</{tag}>" for tag, x in fields if x], "</passage>"])


def _passages(m: int, k: int) -> str:
    return "\n\n".join(_passage(i, *_both(m, k, (r, a)), b, c) for i, (r, a, b, c) in enumerate(HUNKS[m]))


_TAG_LINE = "Available tags: " + ", ".join(schemas.TAGS)
_PASSAGE_ROWS = _values([(m, k, _passages(m, k)) for m in HUNKS for k in (2, 3)]) + " p(m, k, passages)"


@query(f"""SELECT document_id, rev, concat('Document: ', company_id, ' — ', CASE type WHEN 'tos' THEN 'Terms of Service' ELSE 'Privacy Policy' END, chr(10), "addedWords" + "removedWords", ' of roughly ', "totalWords", ' words in the document changed.', chr(10), chr(10), {sql_text(classify.PROMPT_NOTE)}, chr(10), chr(10), passages, chr(10), chr(10), 'Describe these changes.', chr(10), chr(10), {sql_text(_TAG_LINE)}) AS prompt
FROM {_JUDGED} j JOIN docs ON docs.id = document_id JOIN {_PASSAGE_ROWS} USING (m) WHERE p.k = j.rev AND reason IS NULL""")
def summary_prompt(spark, d):
    s = _summaries(spark, d)
    return s.select("document_id", "rev", classify.user_prompt(s).alias("prompt"))


def _parts(m: int, k: int) -> list[tuple[str, str]]:
    """The parts between head and tail as the k-th version's diff has them: deletions first, the newer text's
    white space in equal ones."""
    if k == 2:
        return BETWEEN[m]
    turned = [({"delete": "insert", "insert": "delete"}.get(op, op), v) for op, v in BETWEEN[m]]
    out: list[tuple[str, str]] = []
    for i, (op, v) in enumerate(turned):
        if op == "delete" and i and turned[i - 1][0] == "insert":
            out.insert(len(out) - 1, (op, v))
        else:
            out.append((op, v))
    return out


_PART_ROWS = _values([(m, k, i + 1, op, v) for m in HUNKS for k in (2, 3) for i, (op, v) in enumerate([*_parts(m, k), ("equal", _TAIL[m])])]) + " q(m, k, i, op, value)"
_HEAD_ROWS = _values([(m, _HEAD[m]) for m in HUNKS]) + " g(m, clause)"


@query(f"SELECT CAST(doc_id AS VARCHAR) AS document_id, CAST(k AS INTEGER) AS rev, CAST(i AS INTEGER) AS i, op, sha256(value) AS value_hash FROM base JOIN (SELECT m, k, 0 AS i, 'equal' AS op, clause AS value FROM {_HEAD_ROWS}, (VALUES (2), (3)) t(k) UNION ALL SELECT * FROM {_PART_ROWS}) ON doc_id % 6 = m WHERE i > 0 UNION ALL SELECT CAST(doc_id AS VARCHAR), CAST(k AS INTEGER), 0, 'equal', sha256(concat(text, ' ', clause)) FROM base JOIN {_HEAD_ROWS} ON doc_id % 6 = m, (VALUES (2), (3)) t(k)")
def word_diff(spark, d):
    parts = diff.word_diff(F.col("before"), F.col("after"))
    return _pairs(spark, d).select("document_id", "rev", F.posexplode(parts).alias("i", "p")).select("document_id", "rev", "i", "p.op", X.content_hash(F.col("p.value")).alias("value_hash"))


_UNITS = "len(v) + len(regexp_replace(v, '[^\\x{10000}-\\x{10FFFF}]', '', 'g'))"


@query(f"""SELECT document_id, rev, kind, value FROM (
  SELECT CAST(doc_id AS VARCHAR) AS document_id, CAST(k AS INTEGER) AS rev, unnest(CASE WHEN {_UNITS} <= 700 THEN [{{'kind': 'equal', 'value': v}}] ELSE [{{'kind': 'gap', 'value': concat(len({sql_words('v[:len(v) - 260]')}), ' unchanged words')}}, {{'kind': 'equal', 'value': v[len(v) - 259:]}}] END, recursive := true)
  FROM (SELECT doc_id, k, concat(text, ' ', clause) AS v FROM base JOIN {_HEAD_ROWS} ON doc_id % 6 = m, (VALUES (2), (3)) t(k)))
UNION ALL SELECT CAST(doc_id AS VARCHAR), CAST(k AS INTEGER), CASE op WHEN 'insert' THEN 'changed' ELSE op END, value FROM base JOIN {_PART_ROWS} ON doc_id % 6 = m WHERE op <> 'delete'""")
def diff_segments(spark, d):
    out = _pairs(spark, d).withColumn("parts", diff.word_diff(F.col("before"), F.col("after")))
    return out.select("document_id", "rev", F.explode(diff.view_segments(F.col("parts"), "after")).alias("s")).select("document_id", "rev", "s.*")


_MODEL_SAYS = "CAST(document_id AS BIGINT) % 4"


@query(f"SELECT document_id, rev, CASE {_MODEL_SAYS} WHEN 0 THEN 'Said by a model' ELSE s.headline END AS headline, CASE {_MODEL_SAYS} WHEN 0 THEN 'high' ELSE 'low' END AS confidence, {_MODEL_SAYS} = 0 AS publish, 'high' AS fake_confidence FROM {_JUDGED} j JOIN {_SAID_ROWS} USING (m) WHERE s.k = j.rev AND reason IS NULL")
def summaries_by_model(spark, d):
    """A model that fails for three rows of four - no headline, no known severity, no known tag - next to the fake."""
    n = F.col("document_id").cast("long") % 4

    def model(df):
        said = classify.summarize_heuristically(df)
        return said.withColumns({"headline": F.when(n != 1, "Said by a model"), "severity": F.when(n == 2, 6).otherwise(5), "tags": F.when(n == 3, F.array(F.lit("legacy"))).otherwise(F.array(F.lit("pricing"))), "confidence": F.lit("high")})

    about = _diffs(spark, d).where("not cosmetic").select("document_id", "rev", "hunks", "stats", F.lit("tos").alias("document_type"), F.lit("Co").alias("company_name"), F.lit(None).cast("string").alias("document_title"))
    both = classify.summarizer("model", model)(about).select("document_id", "rev", "headline", "confidence", classify.should_publish(F.col("confidence")).alias("publish"), "hunks", "stats", "document_type", "company_name", "document_title")
    return classify.summarizer("fake")(both.withColumnsRenamed({"headline": "_h", "confidence": "_c"})).select("document_id", "rev", F.col("_h").alias("headline"), F.col("_c").alias("confidence"), "publish", F.col("confidence").alias("fake_confidence"))


# ---- whole crawls ----------------------------------------------------------------------------------------


#: The test pages in SQL: an article of h1, p, br and b, a notice before it, menus and a footer around.  The body
#: wins where the article is too short, or where nothing in it but the notice is long enough to be scored.
_PIECES = f"list_filter(list_transform(string_split(nfc_normalize(%s), chr(1)), lambda x: trim(regexp_replace(x, '{WS}+', ' ', 'g'))), lambda x: x <> '')"
_DECODED = "regexp_replace(replace(replace(replace(regexp_replace(regexp_replace(%s, '</?(?:h1|p|br|div)[^>]*>', chr(1), 'g'), '<[^>]*>', '', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&amp;?', '&', 'g')"


@query(f"""SELECT page_id, nullif(title, '') AS title, extracted_text, sha256(extracted_text) AS content_hash, used_fallback FROM (
  SELECT page_id, title, CASE WHEN found AND n >= 250 AND len(array_to_string(own, chr(10))) >= 200 THEN array_to_string(own, chr(10)) ELSE array_to_string(whole, chr(10)) END AS extracted_text,
    NOT CASE WHEN found THEN n >= 250 AND len(array_to_string(own, chr(10))) >= 200 ELSE n + noted >= 250 AND noted >= 25 AND len(array_to_string(whole, chr(10))) >= 200 END AS used_fallback
  FROM (SELECT page_id, title, {_PIECES % 'article'} AS own, {_PIECES % 'concat(notice, chr(1), article)'} AS whole, len(replace(article, chr(1), '')) AS n, len(notice) AS noted,
      len(list_filter(string_split(article, chr(1)), lambda x: len(regexp_replace(x, '{WS}+', ' ', 'g')) >= 25)) > 0 AS found
    FROM (SELECT page_id, {TRIM % ("replace(" + _DECODED % "regexp_extract(html, '(?s)<title>(.*?)</title>', 1)" + ", chr(1), '')")} AS title, {_DECODED % "regexp_extract(html, '(?s)<article>(.*)</article>', 1)"} AS article, {_DECODED % "regexp_extract(html, '(?s)<div class=.ad.>(.*?)</div>', 1)"} AS notice FROM pages)))""", derive=False)
def html_text(spark, d):
    pages = spread(spark.read.parquet(f"{d}/pages.parquet").select("page_id", "html")).select("page_id", extract.extract_content(F.col("html")).alias("x"))
    return pages.select("page_id", "x.title", F.col("x.extracted_text").alias("extracted_text"), X.content_hash(F.col("x.extracted_text")).alias("content_hash"), F.col("x.used_fallback").alias("used_fallback"))


def _crawl(spark: SparkSession, d: str) -> crawl.Crawl:
    """A run over all versions, each as a page.  A tenth of the documents fail at their second fetch, another tenth
    live at a private address."""
    r = revisions(spark, d)
    page = F.concat(F.lit("<html><head><title>T</title></head><body><nav>menu</nav><article><p>"), F.replace(fmt.escape_html(F.col("extracted_text")), F.lit("\n"), F.lit("</p><p>")), F.lit("</p></article></body></html>"))
    n = F.col("document_id").cast("long")
    status = F.when((F.col("rev") == 2) & (n % 10 == 0), 500).otherwise(200)
    fetches = r.select("document_id", F.lit("https://x.example/").alias("url"), status.alias("http_status"), F.lit("").alias("status_text"), F.lit("text/html").alias("content_type"), F.lit(None).cast("string").alias("error"), page.alias("html"), "fetched_at")
    own = F.concat(F.when(F.col("id").cast("long") % 10 == 1, F.lit("https://10.0.0.1/")).otherwise(F.concat(F.lit("https://h"), "id", F.lit(".example/"))))
    docs = derived.relation(spark, d, "docs").select("id", "type", F.col("company_id").alias("company_slug"), F.col("company_id").alias("company_name"), own.alias("source_url"), "last_checked_at")
    robots = docs.select(F.regexp_extract("source_url", "^(https://[^/]*)", 1).alias("origin"), F.lit(404).alias("http_status"), F.lit(None).cast("string").alias("error"), F.lit(None).cast("string").alias("body"))
    return crawl.run(docs, fetches, robots=robots)


#: What becomes of each version: the third of a document whose second failed is the first again.
_FATES = f"""(SELECT r.document_id, r.rev, CASE WHEN n % 10 = 0 AND r.rev = 2 THEN 'error' WHEN r.rev = 1 THEN 'baseline' WHEN r.m = 0 OR n % 10 = 0 THEN 'unchanged' WHEN j.reason IS NOT NULL THEN 'cosmetic' WHEN r.m = 5 THEN 'published' ELSE 'held-for-review' END AS status
  FROM (SELECT document_id, rev, CAST(document_id AS BIGINT) AS n, CAST(document_id AS BIGINT) % 6 AS m FROM revisions) r LEFT JOIN {_JUDGED} j ON j.document_id = r.document_id AND j.rev = r.rev WHERE n % 10 <> 1)"""


@query(f"SELECT status, count(*) AS documents FROM {_FATES} GROUP BY status UNION ALL SELECT 'skipped', count(*) FROM base WHERE doc_id % 10 = 1 HAVING count(*) > 0")
def crawl_report(spark, d):
    return crawl.report(_crawl(spark, d).outcomes)


@query(f"SELECT document_id, 1000000 * rev + CAST(document_id AS BIGINT) AS fetched_at FROM {_FATES} WHERE status NOT IN ('error', 'unchanged')")
def crawl_snapshots(spark, d):
    return _crawl(spark, d).snapshots.select("document_id", "fetched_at")


@query(f"SELECT f.document_id, 1000000 * f.rev + CAST(f.document_id AS BIGINT) AS detected_at, status = 'cosmetic' AS cosmetic, status = 'published' AS published, status = 'held-for-review' AS needs_review, CASE WHEN status <> 'cosmetic' THEN s.headline END AS headline FROM {_FATES} f JOIN {_SAID_ROWS} ON s.m = CAST(f.document_id AS BIGINT) % 6 AND s.k = f.rev WHERE status IN ('cosmetic', 'published', 'held-for-review')")
def crawl_changes(spark, d):
    return _crawl(spark, d).changes.select("document_id", "detected_at", "cosmetic", "published", "needs_review", "headline")
