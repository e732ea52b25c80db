"""Label encoding, decoding, collapsing and naming."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import concat_key
from tessera.operators.indexing import dense_index

# ---------------------------------------------------------------------------------------
# Class codes of the six-class target and its collapses.
TARGET_NAMES = {0: "GENERAL_0", 1: "GENERAL_1", 2: "PROFANITY_0", 3: "PROFANITY_1",
                4: "VIOLENCE_0", 5: "VIOLENCE_1"}
SENTIMENT_OF_TARGET = {0: "GENERAL", 1: "GENERAL", 2: "PROFANITY", 3: "PROFANITY",
                       4: "VIOLENCE", 5: "VIOLENCE"}
COLLAPSE_3 = {0: 0, 1: 0, 2: 1, 3: 1, 4: 2, 5: 2}           # GENERAL, PROFANITY, VIOLENCE
COLLAPSE_4 = {0: 0, 1: 0, 2: 1, 3: 2, 4: 3, 5: 3}           # GENERAL, PROFANITY_0, PROFANITY_1, VIOLENCE
COLLAPSE_4_NAMES = {0: "GENERAL", 1: "PROFANITY_0", 2: "PROFANITY_1", 3: "VIOLENCE"}
STRING_LABELS = {"General_0": 0, "General_1": 1, "Profanity_0": 2, "Profanity_1": 3,
                 "Violence_0": 4, "Violence_1": 5}
# ---------------------------------------------------------------------------------------


def map_literal(mapping: dict):
    return F.create_map(*[F.lit(x) for x in chain.from_iterable(mapping.items())])


# L1 + L2
def class_table(df: DataFrame, key_col: str, code_col: str = "code") -> DataFrame:
    """Distinct class names with codes in sorted-name order (label encoding)."""
    return dense_index(df.select(key_col).where(F.col(key_col).isNotNull()).distinct(), [key_col], code_col)


def create_target(df: DataFrame, sentiment: str, polarity: str, target: str = "Target",
                  key: str = "class_name") -> tuple[DataFrame, DataFrame]:
    """Target = code of ``sentiment + '_' + polarity`` in sorted order; inputs dropped.

    Returns (encoded frame, class table). The class table is joined without a hint: AQE
    broadcasts it once its measured size is small (a label set), and falls back to a
    shuffle join otherwise.
    """
    keyed = df.withColumn(key, concat_key([sentiment, polarity]))
    classes = class_table(keyed, key, target)
    out = keyed.join(classes, key, "left").drop(sentiment, polarity, key)
    return out, classes.select(F.col(key).alias("class_name"), F.col(target).cast("int").alias("code"))


# L3
def decode_target(df: DataFrame, col: str, sentiment: str = "sentiment", polarity: str = "polarity") -> DataFrame:
    """0-5 -> sentiment name (null when unmapped) and polarity bit (even -> 0, else 1)."""
    return (df.withColumn(sentiment, F.try_element_at(map_literal(SENTIMENT_OF_TARGET), F.col(col)))
              .withColumn(polarity, F.when(F.col(col).isin(0, 2, 4), 0).otherwise(1).cast("int")))


# L4
def collapse_labels(df: DataFrame, col: str, mapping: dict, on_missing: str = "null",
                    out: str | None = None) -> DataFrame:
    """Map class codes through ``mapping``; on_missing: null | passthrough | error."""
    out = out or col
    mapped = F.try_element_at(map_literal(mapping), F.col(col))
    if on_missing == "passthrough":
        mapped = F.coalesce(mapped, F.col(col))
    elif on_missing == "error":
        mapped = F.when(F.col(col).isNull() | mapped.isNotNull(), mapped).otherwise(
            F.raise_error(F.concat(F.lit("unmapped label: "), F.col(col).cast("string"))))
    elif on_missing != "null":
        raise ValueError(on_missing)
    return df.withColumn(out, mapped.cast("int"))


# L5
def map_string_labels(df: DataFrame, cols, mapping: dict) -> DataFrame:
    """Strict mapping of string labels to codes; an unmapped value fails the job."""
    for c in cols:
        df = collapse_labels(df, c, mapping, "error")
    return df


# L6
def label_names(df: DataFrame, col: str, names: dict, out: str = "label_name") -> DataFrame:
    return df.withColumn(out, F.try_element_at(map_literal(names), F.col(col)))
