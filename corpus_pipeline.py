"""A corpus pipeline: documents pass through five stages, each written and read again."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradelake.llm import bpe, langid, mixing, near_copies, site_lines
from gradelake.session import shared_folder, table

#: A document stays if its language is known with at least this score.
LEAST_SCORE = 0.4


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents in which no language is found: no letters, or no language that clearly leads.

    The network learns from the labelled documents that the stage receives; without labels nothing is dropped.
    """
    net = langid.learn(docs, F.lit(True))
    if not net.languages:
        return docs
    found = langid.predict(docs, net, out="__language").where((F.col("__language.lang") != langid.UNKNOWN) & (F.col("__language.score") >= LEAST_SCORE))
    return found.select(*docs.columns)


def drop_site_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops lines that many documents of a source share; a document that would lose more than half of its text stays whole.

    So near copies by the thousand, whose common lines are shared as well, reach near-dedup whole.

    Texts that lose a line are joined anew and counted again; the others, null ones too, stay as they are.
    """
    found = site_lines.drop_lines(docs, F.col("source"), site_lines.text_lines(F.col("text")), out="__lines_kept", spare_whole=True)
    lost = F.col("__lines_kept_dropped") > 0
    text = F.when(lost, F.array_join("__lines_kept", "\n")).otherwise(F.col("text"))
    found = found.withColumn("text", text).withColumn("n_chars", F.when(lost, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return found.select(*docs.columns)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near-duplicate documents (five words, similarity 0.8) keeps the one with the smallest doc_id."""
    return near_copies.keep_one(docs, shingle=5, similarity=0.8)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes each document as often as the mix of sources to target weights asks, at most three times."""
    return mixing.mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, source, n_tokens, ids`` (four bytes each), and whether decoding gives the text back."""
    tokenizer = bpe.Tokenizer(spark, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    text = F.coalesce("text", F.lit(""))
    both = docs.select("doc_id", "source", text.alias("text"), tokenizer.round_trip(text).alias("both")).select("doc_id", "source", "text", "both.*")
    same = F.col("decoded") == F.col("text").cast("binary")
    return both.select("doc_id", "source", bpe.count(F.col("ids")).alias("n_tokens"), "ids", same.alias("decodes"))


STAGES = [
    ("language ID", identify_language),
    ("line dedup", drop_site_lines),
    ("SimHash near-dedup", keep_one_of_each_group),
    ("mixing sources", mix_sources),
    ("byte-level BPE", encode),
]

#: SQL has no expression for the network, SimHash or the encoder; tests compare with brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each result is a Parquet table in the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        path = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}/{number}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
