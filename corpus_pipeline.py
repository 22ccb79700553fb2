"""The training-data pipeline: documents through the stages below, one table after another."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reldrift.llm import bpe, decontam, oddsketch, secret_scan, toxicity
from reldrift.llm.common import table
from reldrift.session import materialize


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the classifier finds toxic go; it learns from the labels of the documents given."""
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    scored = toxicity.score(docs, toxicity.fit(docs, labels), out="_toxicity")
    return scored.where(F.col("_toxicity") < 0.5).select(*docs.columns)


def near_duplicate_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return oddsketch.drop_near_duplicates(docs)


def benchmark_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark text go."""
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def secret_redaction(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by their kind in brackets; every document stays."""
    done = secret_scan.redact_secrets(docs)
    return done.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), "n_chars")).select(*docs.columns)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every text, and whether they decode to it.

    The ids are written before they are decoded, so a task has one Python worker at a time.
    """
    decoded = bpe.decode(materialize(bpe.encode(docs), "pipeline-ids"))
    return decoded.select(
        "doc_id", "lang", "source", "n_chars", bpe.token_count().alias("n_tokens"), "token_ids",
        (F.col("decoded") == F.coalesce("text", F.lit("")).cast("binary")).alias("round_trip"),
    )


STAGES = [
    ("toxicity", toxicity_filter),
    ("near_duplicates", near_duplicate_filter),
    ("decontamination", benchmark_filter),
    ("secrets", secret_redaction),
    ("byte_bpe", tokenize),
]

#: A classifier, groups of near copies and merges by rank are beyond SQL; the tests hold the result against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
