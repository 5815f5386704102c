"""Queries of these operators on the given tables, and their DuckDB twins."""

from __future__ import annotations

import uuid

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradelake.llm import bpe, embedding_links, fixity, langid, lm_scoring, mixing, orc_ids, personal, prefix_trie, simhash
from gradelake.llm import site_lines, whitening, winnowing
from gradelake.session import shared_folder, staged, table

QUERIES = {}
ORACLES: dict[str, str] = {}


def _query(sql: str | None = None):
    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLES[fn.__name__] = sql
        return fn

    return register


@_query(site_lines.site_relative_sql())
def op2_site_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of every page without those that many pages of its host share."""
    pages = table(spark, sf_dir, "pages")
    found = site_lines.drop_lines(pages, site_lines.host(F.col("url")), site_lines.html_lines(F.col("html")))
    dropped = F.col("lines_dropped")
    return found.select(
        "page_id", site_lines.host(F.col("url")).alias("host"), (F.size("lines") + dropped).cast("long").alias("n_lines"), dropped.cast("long").alias("n_dropped"),
        F.array_join("lines", "\n").alias("kept_text"),
    )


@_query()
def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document by the 50k vocabulary, and their decoded bytes, as digests."""
    tokenizer = bpe.Tokenizer(spark, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    both = table(spark, sf_dir, "documents").select("doc_id", tokenizer.round_trip(F.col("text")).alias("both")).select("doc_id", "both.*")
    return both.select("doc_id", bpe.count(F.col("ids")).alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@_query()
def op6_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and group of every document at two differing bits or less."""
    found = simhash.groups(table(spark, sf_dir, "documents"), shingle=3)
    return found.select("doc_id", simhash.hexadecimal(F.col("fingerprint")).alias("fingerprint"), "component_id")


@_query()
def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document by a network trained on those whose key hash isn't 0 modulo 5."""
    documents = table(spark, sf_dir, "documents")
    held = langid.held_out(F.col("doc_id"))
    net = langid.learn(documents, ~held)
    found = langid.predict(documents.select("doc_id", "text"), net)
    return found.select("doc_id", held.alias("held_out"), F.col("language.lang").alias("lang_pred"), "language.score")


@_query()
def op10_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words of each document the mix of all sources takes."""
    found = mixing.taken(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "size", "source_size", "target", "taken")


@_query(corpus_pipeline.ORACLE_SQL)
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages of the corpus pipeline."""
    return corpus_pipeline.run(spark, sf_dir)


@_query()
def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and its edited text, and their likeness."""
    found = winnowing.with_next(table(spark, sf_dir, "documents"))
    found = found.withColumn("edited", winnowing.edited(F.col("text"), F.col("next_text")))
    found = found.withColumn("edited_marks", winnowing.marks(F.col("edited")))
    return found.select(
        F.col("key").alias("doc_id"), F.length("text").cast("long").alias("n_chars"), F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        winnowing.digest(F.col("marks")).alias("fingerprint"), winnowing.digest(F.col("edited_marks")).alias("edited_fingerprint"),
        winnowing.likeness(F.col("marks"), F.col("edited_marks")).alias("near_edited"), winnowing.likeness(F.col("marks"), F.col("next_marks")).alias("near_next"),
        F.size("marks").cast("long").alias("n_marks"),
    )


@_query()
def op8_embedding_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and component of every embedding at cosine 0.98 within its label."""
    return embedding_links.links(table(spark, sf_dir, "embeddings"))


@_query(fixity.DAMAGE_SQL)
def op7_fixity_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records in which a damaged replica of the pages' archive differs from the archive."""
    pages = fixity.damaged(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    content = fixity.record(F.col("url"), F.col("html"))
    whole = staged(fixity.manifest(pages, "page_id", content), "manifest")
    other = F.when(F.col("damage") == "changed", F.reverse(content)).otherwise(F.expr("substring(content, 1, octet_length(content) - 1)"))
    changed = pages.where("damage <> 'gone' or damage is null").withColumn("content", content)
    seen = changed.select("page_id", F.when(F.col("damage").isNull(), F.sha2("content", 256)).otherwise(F.sha2(other, 256)).alias("digest"),
                          (F.octet_length("content") - F.when(F.col("damage") == "cut", 1).otherwise(0)).cast("long").alias("length"))
    replica = seen.join(whole.select("page_id", "file", "offset"), "page_id")
    found = fixity.audit(whole, replica)
    return found.join(whole.select("page_id", "file", "offset"), ["file", "offset"], "left").select("page_id", "file", "offset", "length", "state")


@_query()
def op4_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document, by fixed patterns and by induced contexts."""
    found = personal.find(table(spark, sf_dir, "documents"))
    base = F.col("base")
    return found.select(
        "doc_id", *(personal.number(base, kind).alias(f"n_{kind}") for kind in personal.KINDS), F.sha2(personal.written(base), 256).alias("base_sha256"),
        personal.written(F.col("spans")).alias("spans"),
    )


@_query()
def op3_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probability of every document by unigram counts and by the maximum-entropy model."""
    return lm_scoring.score(table(spark, sf_dir, "documents"))


@_query()
def op11_orc_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document as its place, number and checksum, read back from the ORC files."""
    path = f"{shared_folder(spark)}/ids-{uuid.uuid4().hex}"
    orc_ids.write(table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"))
    return orc_ids.digests(orc_ids.read(spark, path))


@_query()
def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector's whitened components."""
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


@_query(prefix_trie.TRIE_SQL)
def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of the trie of rebuilt conversations."""
    return prefix_trie.trie(table(spark, sf_dir, "conversations"))
