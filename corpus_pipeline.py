"""The training-data pipeline: documents in, packed token sequences out.

Each stage works on all that its predecessor kept; every stage's output is written as Parquet
and read again as the next one's input. All stages but the last return the columns of
``documents`` (and any extra ones) unchanged but for ``text`` and ``n_chars`` where a stage rewrites the text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tessera.llm.common import materialize, table
from tessera.llm.decontaminate import drop_contaminated
from tessera.llm.packing import pack
from tessera.llm.pii_feistel import pseudonymised
from tessera.llm.quality_rules import keep_quality
from tessera.llm.simhash import drop_near_copies


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go: null, empty and blank texts among them. Rows are
    judged one by one (repeated rows alike, null ids too); an empty table stays empty."""
    return keep_quality(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest doc_id stays. Rows without a doc_id
    stay, rows that repeat one stay or go together; null and empty texts are copies of each other."""
    return drop_near_copies(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap a benchmark item go. Rows without a doc_id stay, null and empty texts
    overlap nothing, rows that repeat a doc_id go together; an empty benchmark removes nothing."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the texts becomes pseudonyms; ``n_chars`` follows the text. Null and empty texts
    stay; all other columns, whatever their names, pass through in one struct."""
    others = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("row")
    out = pseudonymised(docs.select(others, "text"))

    def column(c: str) -> Column:
        if c == "text":
            return F.col("text")
        kept = F.col("row").getField(c)
        if c == "n_chars":
            kept = F.coalesce(F.length("text"), kept).cast(docs.schema[c].dataType)
        return kept.alias(c)
    return out.select(*[column(c) for c in docs.columns])


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of at most 4096 tokens; null and empty texts are one
    end token, repeated rows are packed each, an empty table has no piece."""
    return pack(docs)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("pii", pii), ("packing", packing)]

#: Packing's token ids and the pseudonyms are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
