"""The registered queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tessera.llm.common import shared_folder, table
from tessera.llm.decontaminate import contaminated
from tessera.llm.html_mincut import extract
from tessera.llm.lm_backoff import backoff_scores
from tessera.llm.oracles import ORACLES  # noqa: F401
from tessera.llm.packing import pack
from tessera.llm.pii_feistel import pseudonymised
from tessera.llm.quality_rules import quality_report
from tessera.llm.rlz_dedup import substring_dedup
from tessera.llm.sharding import shard_documents
from tessera.llm.simhash import simhash_groups
from tessera.llm.spelling import spelling_groups
from tessera.llm.url_lm import filter_urls
from tessera.llm.warc_zstd import read_archives, write_archives
from tessera.llm.whitening import whiten


def op1_html_mincut(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page by minimum-cut labelling."""
    return extract(table(spark, sf_dir, "pages"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, ratios and verdict of every document."""
    return quality_report(table(spark, sf_dir, "documents")).withColumn("broken", F.array_join("broken", "; "))


def op3_rlz_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that repeat a 50-word window of a smaller document."""
    return substring_dedup(table(spark, sf_dir, "documents"))


def op4_pii_feistel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's text with personal data replaced by pseudonyms, and their counts."""
    return pseudonymised(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "text", "pii_counts.*")


def op5_warc_zstd(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written as archives and read back."""
    folder = shared_folder(spark, "warc")
    write_archives(table(spark, sf_dir, "pages"), folder)
    return read_archives(spark, folder)


def op6_spaced_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that overlap a benchmark item, with the best overlap."""
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    return simhash_groups(table(spark, sf_dir, "documents"))


def op8_url_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, rule and verdict of every page's URL."""
    return filter_urls(table(spark, sf_dir, "pages"))


def op9_stupid_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language-model score of every document under the counts of the whole corpus."""
    return backoff_scores(table(spark, sf_dir, "documents")).select("doc_id", "n_words", F.round("score", 3).alias("score"), F.round("mean_score", 6).alias("mean_score"))


def op10_bfd_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of every document in sequences of at most 4096 tokens."""
    return pack(table(spark, sf_dir, "documents"))


def op11_hypergeometric_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and slot of every document under a uniform shuffle with equal counts."""
    return shard_documents(table(spark, sf_dir, "documents"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word of at least two occurrences with the frequent word it is a variant of."""
    return spelling_groups(table(spark, sf_dir, "documents"))


def op13_feast_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The four leading whitened components of every embedding."""
    return whiten(table(spark, sf_dir, "embeddings"))


QUERIES = {f.__name__: f for f in (op1_html_mincut, op2_quality_rules, op3_rlz_dedup, op4_pii_feistel, op5_warc_zstd, op6_spaced_seeds, op7_simhash, op8_url_lm, op9_stupid_backoff, op10_bfd_packing, op11_hypergeometric_shards, op12_spelling_variants, op13_feast_whitening)}
