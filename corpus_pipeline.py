"""The corpus pipeline: language ID, near-dedup, substring dedup, mixing, BPE encoding.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. All but the last
return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meibo.llm import bpe, language, mixing, simhash, substring
from meibo.llm.common import row_values

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
_TYPES = {"doc_id": "long", "text": "string", "lang": "string", "source": "string", "n_chars": "long"}


def _columns(df: DataFrame) -> DataFrame:
    return df.select(*[F.col(c).cast(_TYPES[c]).alias(c) for c in COLUMNS])


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops what the classifier rejects: texts without letters and those of no clear language.

    The language is learned from the labelled documents given; ``lang`` stays as it is.
    """
    model = language.fit(docs.where(F.col("doc_id").isNotNull() & ~language.held_out()))
    return _columns(language.classify(docs.select(*COLUMNS), model).where("NOT rejected"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each near-duplicate group the row of the smallest doc_id and text hash, once.

    Rows are told apart by all they hold, so unlike texts of one doc_id all stay. A document without
    doc_id goes by its text's hash.
    """
    row = F.struct(
        F.coalesce("doc_id", F.xxhash64("text")).alias("id"), F.xxhash64("text").alias("text"), F.xxhash64(F.lit("row"), *row_values(list(COLUMNS))).alias("row")
    )
    named = docs.select(*COLUMNS).withColumn("k", row)
    found = simhash.near_duplicates(named, key="k")
    keep = found.where("k = component").select("k").distinct()
    return _columns(named.join(keep, "k", "left_semi").dropDuplicates(["k"]))


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes repeated passages out of the texts; a document that has no word left goes."""
    out = substring.remove_repeats(docs.select(*COLUMNS)).where("n_words > n_removed")
    text = F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("text"))
    out = out.select("doc_id", text.alias("text"), "lang", "source")
    return _columns(out.withColumn("n_chars", F.char_length("text")))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: documents as often as their source's target takes them, in shards and shuffled."""
    return _columns(mixing.Mix(docs.select(*COLUMNS)).rows())


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document of the mix."""
    return bpe.encode_column(docs, keep=["doc_id", "lang", "source"]).withColumn("n_tokens", F.size("ids"))


STAGES = [
    ("language", identify_language),
    ("near_dedup", drop_near_duplicates),
    ("substring_dedup", drop_repeated_passages),
    ("mixing", mix_sources),
    ("bpe", encode),
]
#: Compression, relative parsing and random draws are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet in the shared folder and read again."""
    from uuid import uuid4

    from meibo.llm.common import shared_dir

    shared_dir(spark)
    base = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{k}")
        docs = spark.read.parquet(f"{base}/{k}")
    return docs
