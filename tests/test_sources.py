"""Landed tables, files and sinks."""

import datetime

import pytest
from pyspark.sql import functions as F

from revtrail import schemas
from revtrail.operators import policy
from revtrail.sources import landed, sinks


def test_tables_keep_their_declared_schema(spark, tmp_path):
    path = str(tmp_path / "companies")
    row = ("1", "a", "A", None, None, None, None, datetime.datetime(2026, 1, 2))
    sinks.append(spark.createDataFrame([row], schemas.schema("companies")), path)
    sinks.append(spark.createDataFrame([("2", "b", "B", *row[3:])], schemas.schema("companies")), path)
    got = landed.read_table(spark, path, "companies")
    assert [f.simpleString() for f in got.schema] == [f.simpleString() for f in schemas.schema("companies")] and sorted(r["slug"] for r in got.collect()) == ["a", "b"]
    with pytest.raises(PermissionError):
        sinks.truncate(spark, path, "companies", production=True)
    assert landed.read_table(spark, path, "companies").count() == 2
    sinks.truncate(spark, path, "companies", production=False)
    assert landed.read_table(spark, path, "companies").count() == 0
    for name in schemas.TABLES:
        assert spark.createDataFrame([], schemas.schema(name)).count() == 0


def test_partitioned_append(spark, tmp_path):
    sinks.append(spark.createDataFrame([("a", 1), ("b", 2)], "id string, day int"), str(tmp_path / "t"), "day")
    assert (tmp_path / "t" / "day=1").is_dir() and spark.read.parquet(str(tmp_path / "t")).where("day = 2").first()["id"] == "b"


def test_pages_from_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.html").write_text("<p>é</p>\n<p>b</p>", encoding="utf-8")
    assert landed.read_page_texts(spark, str(tmp_path / "in")).first()["html"] == "<p>é</p>\n<p>b</p>"
    row = landed.read_pages(spark, str(tmp_path / "in"), cap=4).first()
    assert row["url"].endswith("a.html") and row["html"] == "<p>�"


def test_spread_only_where_cores_would_idle(spark):
    cores = spark.sparkContext.defaultParallelism
    few, many = spark.range(100).coalesce(1), spark.range(0, 100, 1, 4 * cores)
    assert landed.spread(few).rdd.getNumPartitions() == cores and landed.spread(few).count() == 100
    assert landed.spread(many).rdd.getNumPartitions() == 4 * cores


def test_user_agent():
    assert policy.user_agent() == "revtrail/1.0" and policy.user_agent("x", "2", "mailto:a@b.c") == "x/2 (+mailto:a@b.c)"
    assert policy.AGENT == policy.user_agent().split("/")[0].lower()


def test_seed_upserts_once(spark):
    companies, documents = landed.seed(spark)
    assert companies.count() == 15 and documents.count() == 30 and documents.select("company_id", "type").distinct().count() == 30
    assert companies.where(F.col("slug") == "zoom").first()["logo_url"].endswith("domain=zoom.com&sz=128")
