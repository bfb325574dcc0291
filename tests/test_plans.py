"""Revision status, crawl plan, stream and catalog."""

import os

import pytest
from pyspark.sql import functions as F

from revtrail.operators import state
from revtrail.plans import catalog, crawl
from revtrail.streaming import stream

FETCH = "document_id string, url string, http_status int, status_text string, content_type string, error string, html string, fetched_at timestamp"


def page(text):
    return f"<html><body><p>{'Filler words of a document. ' * 400}{text}</p></body></html>"


def fetches(spark, rows):
    return spark.createDataFrame(rows, "document_id string, html string, http_status int, fetched_at string").select("document_id", F.lit("https://x.test/").alias("url"), "http_status", F.lit("").alias("status_text"), F.lit("text/html").alias("content_type"), F.lit(None).cast("string").alias("error"), "html", F.to_timestamp("fetched_at").alias("fetched_at"))


ROWS = [
    ("a", page("We keep it for 12 months."), 200, "2026-01-01"),
    ("a", page("We keep it for 36 months."), 200, "2026-01-02"),
    ("a", None, 500, "2026-01-03"),
    ("a", page("We keep it for 12 months."), 200, "2026-01-04"),
    ("b", page("Updated 4 February 2026."), 200, "2026-01-01"),
    ("b", page("Updated 4 February 2026."), 200, "2026-01-02"),
    ("b", page("Updated 11 March 2026."), 200, "2026-01-03"),
    ("c", "<p>short</p>", 200, "2026-01-01"),
]
EXPECTED = {("a", "baseline"): 1, ("a", "held-for-review"): 2, ("a", "error"): 1, ("b", "baseline"): 1, ("b", "unchanged"): 1, ("b", "cosmetic"): 1, ("c", "error"): 1}


@pytest.fixture
def documents(spark):
    return spark.createDataFrame([(x, "tos", "co", "Co") for x in "abc"], "id string, type string, company_slug string, company_name string")


def statuses(outcomes):
    return {(r[0], r[1]): r[2] for r in outcomes.groupBy("document_id", "status").count().collect()}


def test_crawl(spark, documents):
    done = crawl.run(documents, fetches(spark, ROWS))
    assert statuses(done.outcomes) == EXPECTED
    assert done.snapshots.count() == 5 and done.changes.count() == 3


def test_crawl_asks_policy_first(spark, documents):
    urls = {"a": "https://a.test/x", "b": "https://b.test/private/y", "c": "https://a.test/z"}
    due = documents.select("*", F.element_at(F.create_map(*[F.lit(x) for kv in urls.items() for x in kv]), F.col("id")).alias("source_url"), F.when(F.col("id") == "a", 1).otherwise(2).alias("last_checked_at"))
    robots = spark.createDataFrame([("https://a.test", 404, None, None), ("https://b.test", 200, None, "User-agent: *\nDisallow: /private")], "origin string, http_status int, error string, body string")
    done = crawl.run(due, fetches(spark, ROWS), robots=robots)
    assert statuses(done.outcomes) == {k: n for k, n in EXPECTED.items() if k[0] == "a"} | {("b", "skipped"): 1, ("c", "skipped"): 1}
    assert {r["document_id"] for r in done.snapshots.collect()} == {"a"}
    reasons = {r["document_id"]: r["detail"] for r in done.outcomes.where("status = 'skipped'").collect()}
    assert reasons == {"b": "robots.txt disallows /private/y", "c": "a.test was already contacted this run"}


def test_stream_equals_batch(spark, documents, tmp_path):
    for day in ("2026-01-01", "2026-01-02", "2026-01-03", "2026-01-04"):
        fetches(spark, [r for r in ROWS if r[3] == day]).coalesce(1).write.parquet(str(tmp_path / "landed" / day))
        os.makedirs(tmp_path / "in", exist_ok=True)
        for f in (tmp_path / "landed" / day).glob("part-*"):
            f.rename(tmp_path / "in" / f"{day}.parquet")
        stream.crawl_available(spark, str(tmp_path / "in"), documents, str(tmp_path / "out"), str(tmp_path / "check"))
    assert statuses(spark.read.parquet(str(tmp_path / "out/outcomes"))) == EXPECTED
    assert spark.read.parquet(str(tmp_path / "out/snapshots")).count() == 5


def test_notify_once(spark, tmp_path):
    changes = spark.createDataFrame([("x", True, None), ("y", False, None)], "id string, published boolean, notified_at timestamp")
    ledger = str(tmp_path / "ledger")
    assert [r.id for r in stream.notify(changes, ledger, lambda c: c, 0).collect()] == ["x"]
    assert stream.notify(changes, ledger, lambda c: c, 1).count() == 0


def test_admit_order(spark):
    due = spark.createDataFrame([("1", "https://h.test/a", 1), ("2", "https://h.test/b", 2), ("3", "http://127.0.0.1/", None), ("4", "https://other.test/x", 3), ("5", "nonsense", None)], "id string, source_url string, last_checked_at long")
    robots = spark.createDataFrame([("https://h.test", 200, None, "User-agent: *\nDisallow: /a"), ("https://other.test", 503, None, None)], "origin string, http_status int, error string, body string")
    got = {r["id"]: r["skip_reason"] for r in crawl.admit(due, robots).collect()}
    assert got == {"1": "robots-disallowed", "2": "domain-already-fetched", "3": "blocked-host", "4": "robots-disallowed", "5": "error"}


def test_revision_status_empty_and_back(spark):
    df = spark.createDataFrame([("d", i, h) for i, h in enumerate("ABBA")], "document_id string, fetched_at int, content_hash string")
    assert [r["status"] for r in state.revision_status(df).orderBy("fetched_at").collect()] == ["baseline", "changed", "unchanged", "changed"]
    assert state.revision_status(df.limit(0)).count() == 0


SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_catalog_against_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "events", "orders", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = catalog.QUERIES[name](spark, SF)
    want = con.execute(catalog.ORACLES[name])
    cols = [c[0] for c in want.description]
    assert sorted(cols) == sorted(got.columns)
    plain = lambda rows: sorted(repr([float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else v for v in r]) for r in rows)
    assert plain([tuple(r[c] for c in cols) for r in got.collect()]) == plain(want.fetchall())
