"""A cleaning pipeline over ``documents`` made of the corpus operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality model accepts (a score of 0.7 or more).  Null texts score as empty ones; repeated
    rows stay repeated; without labels nothing is accepted, for every score is 0.5.  No documents: none."""
    from revtrail.llm.quality import score_quality, train

    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = score_quality(docs, model, keep=COLUMNS, score_col="_score", predicted_col="_predicted")
    return scored.where("_predicted = 1").select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: five-word shingles, similarity 0.8 or more.  Fingerprints are
    linked by vantage-point trees, pairs further apart than their bound are added by rare shingles, and whole sets
    decide.  The smallest id stays; of repeated rows one; null, empty and wordless texts are one group; rows of a group
    without any id all stay.  No documents: none."""
    from revtrail.llm.simhash import drop_near_duplicates

    return drop_near_duplicates(docs).select(*COLUMNS)


def passage_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages of over 50 words that occur elsewhere (found by the 256-byte strings that they are
    made of: 51 words have some 320 bytes); a text of which nothing but white
    space is left goes, all of repeated rows that are long enough included.  Null, empty and shorter texts stay as
    they are.  No documents: none."""
    from revtrail.llm.suffix_dedup import remove_repeats

    cut = remove_repeats(docs, keep=COLUMNS, window=256, min_words=51, with_text=True)
    changed = F.col("n_removed") > 0
    text = F.when(changed, F.col("kept_text")).otherwise(F.col("text"))
    kept = cut.where(~changed | F.col("kept_text").rlike(r"[^\x00-\x20]"))
    return kept.select("doc_id", text.alias("text"), "lang", "source", F.when(changed, F.length("kept_text").cast("long")).otherwise(F.col("n_chars")).alias("n_chars"))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without contaminated documents (windows of two or more items); windows of a single item are cut out.  Null
    texts and texts without words stay as they are, and so do all texts if the benchmark is empty; repeated rows
    stay repeated.  No documents: none."""
    from revtrail.llm.decontam import find_contamination

    found = find_contamination(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), spans=True)
    pieces = F.aggregate(
        "hit_spans",
        F.struct(F.lit("").alias("text"), F.lit(0).alias("at")),
        lambda s, x: F.struct(F.concat(s["text"], F.substring(F.col("text"), s["at"] + 1, x[0] - s["at"])).alias("text"), x[1].alias("at")),
        lambda s: F.concat(s["text"], F.substring(F.col("text"), s["at"] + 1, F.length("text"))),
    )
    hit = F.size("hit_spans") > 0
    clean = found.where(~F.col("contaminated")).withColumn("clean", F.when(hit, pieces).otherwise(F.col("text")))
    return clean.select("doc_id", F.col("clean").alias("text"), "lang", "source", F.when(hit, F.length("clean").cast("long")).otherwise(F.col("n_chars")).alias("n_chars"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 2048 tokens: one row per piece of a document.  Null and empty texts are the end id alone;
    repeated rows and null ids are rows of their own.  No documents: none."""
    import public_tokenizers

    from revtrail.llm.packing import pack_documents

    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("passage_dedup", passage_dedup), ("decontaminate", decontaminate), ("packing", packing)]

#: Model scores, fingerprints and packing are not SQL: tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order; what passes between them goes through the shared checkpoint folder."""
    from revtrail.llm.common import checkpoint, table

    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = checkpoint(docs)
    return docs
