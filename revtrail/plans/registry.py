"""The registry of queries and of their SQL counterparts, and pieces of DuckDB SQL that several of them use."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from revtrail.plans import derived
from revtrail.sources.landed import spread

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None, derive: bool = True):
    """Registers a query under its name; ``oracle`` selects from the derived tables if ``derive``."""

    def add(f):
        QUERIES[f.__name__] = f
        if oracle is not None:
            ORACLES[f.__name__] = f"{derived.CTE['duckdb']} {oracle}" if derive else oracle
        return f

    return add


def base(spark: SparkSession, d: str) -> DataFrame:
    return spread(spark.read.parquet(f"{d}/documents.parquet").where(F.col("text").isNotNull()).select("doc_id", "text"))


def revisions(spark: SparkSession, d: str) -> DataFrame:
    return derived.relation(spark, d, "revisions")


WS = r"[\t\n\x0B\f\r \x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
TRIM = rf"regexp_replace(%s, '^{WS}+|{WS}+$', '', 'g')"
B = "(^|[^A-Za-z0-9_])"


def sql_words(c: str) -> str:
    t = TRIM % c
    return f"CASE WHEN {t} = '' THEN []::VARCHAR[] ELSE string_split_regex({t}, '{WS}+') END"


def sql_text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"
