"""Sources: what a crawler landed, files as pages, seed lists.  The engine itself never goes to the network."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from revtrail.operators import policy
from revtrail.schemas import schema


# The list to start with (slug, name, domain, terms, privacy policy) and where logos are found.
SEED = [
    ("spotify", "Spotify", "spotify.com", "https://www.spotify.com/us/legal/end-user-agreement/", "https://www.spotify.com/us/legal/privacy-policy/"),
    ("discord", "Discord", "discord.com", "https://discord.com/terms", "https://discord.com/privacy"),
    ("reddit", "Reddit", "reddit.com", "https://www.redditinc.com/policies/user-agreement", "https://www.reddit.com/policies/privacy-policy"),
    ("linkedin", "LinkedIn", "linkedin.com", "https://www.linkedin.com/legal/user-agreement", "https://www.linkedin.com/legal/privacy-policy"),
    ("zoom", "Zoom", "zoom.com", "https://www.zoom.com/en/trust/terms/", "https://www.zoom.com/en/trust/privacy/"),
    ("dropbox", "Dropbox", "dropbox.com", "https://www.dropbox.com/terms", "https://www.dropbox.com/privacy"),
    ("notion", "Notion", "notion.com", "https://www.notion.com/terms", "https://www.notion.com/privacy"),
    ("strava", "Strava", "strava.com", "https://www.strava.com/legal/terms", "https://www.strava.com/legal/privacy"),
    ("duolingo", "Duolingo", "duolingo.com", "https://www.duolingo.com/terms", "https://www.duolingo.com/privacy"),
    ("substack", "Substack", "substack.com", "https://substack.com/tos", "https://substack.com/privacy"),
    ("patreon", "Patreon", "patreon.com", "https://www.patreon.com/policy/legal", "https://privacy.patreon.com/policies"),
    ("steam", "Steam", "steampowered.com", "https://store.steampowered.com/subscriber_agreement/", "https://store.steampowered.com/privacy_agreement/"),
    ("twitch", "Twitch", "twitch.tv", "https://www.twitch.tv/p/legal/terms-of-service/", "https://www.twitch.tv/p/legal/privacy-notice/"),
    ("airbnb", "Airbnb", "airbnb.com", "https://www.airbnb.com/help/article/2908", "https://www.airbnb.com/help/article/2855"),
    ("uber", "Uber", "uber.com", "https://www.uber.com/legal/en/document/?name=general-terms-of-use", "https://www.uber.com/legal/en/document/?name=privacy-notice"),
]
LOGO_URL = ("https://www.google.com/s2/favicons?domain=", "&sz=128")


def spread(df: DataFrame) -> DataFrame:
    """A scan's rows over all cores where the files give fewer splits than there are (a table of many files is
    left as it is): for expressions that cost far more than moving a row."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def read_table(spark: SparkSession, path: str, table: str) -> DataFrame:
    """A table of the engine from Parquet with its declared schema; nothing is inferred."""
    return spark.read.schema(schema(table)).parquet(path)


def read_jdbc(spark: SparkSession, url: str, table: str, key: str, bounds: tuple[int, int], partitions: int, **options: str) -> DataFrame:
    """A table from a database, read in ``partitions`` ranges of a numeric key."""
    return spark.read.jdbc(url, table, column=key, lowerBound=bounds[0], upperBound=bounds[1], numPartitions=partitions, properties=options)


def read_pages(spark: SparkSession, path: str, cap: int = policy.BODY_CAP) -> DataFrame:
    """(url, html, fetched_at) from files, one page each, cut at ``cap`` bytes."""
    files = spark.read.format("binaryFile").load(path)
    return files.select(F.col("path").alias("url"), policy.capped_body(F.col("content"), cap).alias("html"), F.col("modificationTime").alias("fetched_at"))


def read_page_texts(spark: SparkSession, path: str) -> DataFrame:
    """(html) of whole text files, for fixtures."""
    return spark.read.text(path, wholetext=True).select(F.col("value").alias("html"))


def seed(spark: SparkSession, entries: list[tuple[str, str, str, str, str]] = SEED) -> tuple[DataFrame, DataFrame]:
    """companies and documents to upsert from (slug, name, domain, tos_url, privacy_url) entries."""
    rows = spark.createDataFrame(entries, "slug string, name string, domain string, tos_url string, privacy_url string")
    ident = F.sha2("slug", 256)
    companies = rows.select(ident.alias("id"), "slug", "name", F.concat(F.lit(LOGO_URL[0]), "domain", F.lit(LOGO_URL[1])).alias("logo_url"), "tos_url", "privacy_url")
    urls = rows.select(ident.alias("company_id"), F.explode(F.array(*[F.struct(F.lit(k).alias("type"), F.col(f"{k}_url").alias("source_url")) for k in ("tos", "privacy")])).alias("u"))
    documents = urls.select(F.sha2(F.concat_ws("|", "company_id", "u.type"), 256).alias("id"), "company_id", "u.type", "u.source_url")
    return companies, documents
