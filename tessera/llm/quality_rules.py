"""Quality rules: a threshold table compiled into one Spark projection.

Every measure is a built-in expression over one row (no shuffle, no user function), so the
whole verdict runs in the scan's tasks.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

from tessera.llm.common import SPACE_CHARS, SPACE_RE

#: Frequent function words of the corpus languages (English, German, French, Spanish).
STOP_WORDS = tuple("the be to of and that have with in is it for was on are as by at this from or an "
                   "der die das und ist nicht mit ein eine zu den von sich auf für im dem "
                   "le la les de et des un une que qui dans pour est pas sur au avec du en "
                   "el los las y por con se no para es".split())
REPEAT_WORDS = 8


class Rule(NamedTuple):
    """Reject a text of at least ``from_words`` words whose ``measure`` lies outside [low, high]."""
    name: str
    measure: str
    low: float | None
    high: float | None
    from_words: int = 0


#: Ratios are per word unless the measure says otherwise.
RULES = (
    Rule("word length", "mean_word_chars", 2.0, 15.0),
    Rule("symbols", "symbol_ratio", None, 0.1),
    Rule("exclamation marks", "exclamation_ratio", None, 0.5),
    Rule("capitals", "capital_ratio", None, 0.4),
    Rule("stop words", "stop_word_ratio", 0.02, None, 50),
    Rule("repeated lines", "dup_line_ratio", None, 0.4),
    Rule("repeated words", "repeat_ratio", None, 0.3),
)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once, whatever the optimizer makes of it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words_of(text: Column) -> Column:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a text; null has none."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE_CHARS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE_RE, -1))


def repeat_words(words: Column, size: int = REPEAT_WORDS) -> Column:
    """Words covered by windows of ``size`` words that occur twice or more in the text.

    Windows are compared by a 64-bit hash of word hashes. Positions of repeated windows,
    sorted, each cover the words up to the next one, ``size`` at most.
    """
    def covered(windows: Column) -> Column:
        def spread(pairs: Column) -> Column:
            n = F.size(pairs)
            again = F.filter(F.sequence(F.lit(0), n - 1), lambda i: (F.get(pairs, i)["w"] == F.get(pairs, i - 1)["w"]) | (F.get(pairs, i)["w"] == F.get(pairs, i + 1)["w"]))
            at = F.array_sort(F.transform(again, lambda i: F.get(pairs, i)["p"]))
            return let(at, lambda p: F.aggregate(F.sequence(F.lit(0), F.size(p) - 1), F.lit(0), lambda a, i: a + F.least(F.lit(size), F.coalesce(F.get(p, i + 1) - F.get(p, i), F.lit(size)))))
        pairs = F.array_sort(F.transform(windows, lambda w, p: F.struct(w.alias("w"), p.alias("p"))))
        return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0)).otherwise(let(pairs, spread))

    hashes = F.transform(words, lambda w: F.xxhash64(w))
    windows = let(hashes, lambda h: F.transform(F.sequence(F.lit(1), F.size(h) - (size - 1)), lambda i: F.xxhash64(F.slice(h, i, size))))
    return F.when(F.size(words) < size + 1, F.lit(0)).otherwise(let(windows, covered))


def measures(text: Column, stop_words=STOP_WORDS) -> Column:
    """A struct of counts and ratios of one text; every count of a null or empty text is 0."""
    text = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.btrim(x, F.lit(SPACE_CHARS)) != "")

    def of(words: Column) -> Column:
        return let(F.struct(
            F.size(words).cast("long").alias("n_words"),
            F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
            F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
            let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup"))).alias("lines"),
            repeat_words(words).cast("long").alias("n_repeat_words"),
            F.regexp_count(text, F.lit(r"\p{Lu}")).cast("long").alias("n_capitals"),
            (F.length(text) - F.length(F.replace(text, F.lit("!"), F.lit("")))).cast("long").alias("n_exclamations"),
            F.size(F.filter(words, lambda w: F.lower(w).isin(*stop_words))).cast("long").alias("n_stop_words"),
        ), ratios)

    def ratios(m: Column) -> Column:
        def over(a: Column, b: Column) -> Column:
            return F.when(b == 0, F.lit(0.0)).otherwise(a.cast("double") / b)
        n = m["n_words"]
        return F.struct(
            n.alias("n_words"), m["word_chars"].alias("word_chars"), m["n_symbols"].alias("n_symbols"), m["lines"]["dup"].alias("n_dup_lines"),
            m["n_repeat_words"].alias("n_repeat_words"), over(m["word_chars"], n).alias("mean_word_chars"), over(m["n_symbols"], n).alias("symbol_ratio"),
            over(m["n_exclamations"], n).alias("exclamation_ratio"), over(m["n_capitals"], m["word_chars"]).alias("capital_ratio"),
            over(m["n_stop_words"], n).alias("stop_word_ratio"), over(m["lines"]["dup"], m["lines"]["n"]).alias("dup_line_ratio"), over(m["n_repeat_words"], n).alias("repeat_ratio"))

    return let(words_of(text), of)


def broken(m: Column, rules=RULES) -> Column:
    """The names of the rules that a struct of measures breaks, in the table's order."""
    def check(r: Rule) -> Column:
        out = F.lit(False)
        if r.low is not None:
            out = out | (m[r.measure] < r.low)
        if r.high is not None:
            out = out | (m[r.measure] > r.high)
        return F.when(out & (m["n_words"] >= r.from_words), F.lit(r.name))
    return F.array_compact(F.array(*map(check, rules)))


def judged(docs: DataFrame, rules=RULES, prefix: str = "quality_") -> DataFrame:
    """``docs`` with one struct column ``<prefix>m``: the measures, ``base_failed``, ``broken``, ``kept``.

    ``base_failed``: under 20 words, or over 30 % of the words lie in repeated 8-word windows.
    ``kept``: base not failed and no rule broken. Null and empty texts have no words, so they
    fail. Rows are judged one by one, so repeated rows get equal verdicts.
    """
    def verdict(m: Column) -> Column:
        base = (m["n_words"] < 20) | (100 * m["n_repeat_words"] > 30 * m["n_words"])
        fields = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "mean_word_chars", "symbol_ratio", "exclamation_ratio", "capital_ratio", "stop_word_ratio", "dup_line_ratio", "repeat_ratio")
        return let(broken(m, rules), lambda b: F.struct(*[m[x].alias(x) for x in fields], base.alias("base_failed"), b.alias("broken"), (~base & (F.size(b) == 0)).alias("kept")))
    return docs.withColumn(f"{prefix}m", let(measures(F.col("text").cast("string")), verdict))


def quality_report(docs: DataFrame, rules=RULES) -> DataFrame:
    """doc_id, the counts and ratios, base_failed, kept and the broken rules of every row."""
    d = judged(docs.select("doc_id", "text"), rules)
    return d.select(F.col("doc_id").cast("long").alias("doc_id"), "quality_m.*")


def keep_quality(docs: DataFrame, rules=RULES) -> DataFrame:
    """The rows of ``docs`` that pass, with their columns unchanged (extra ones included)."""
    name = "quality_"
    while f"{name}m" in docs.columns:
        name = "_" + name
    return judged(docs, rules, name).filter(F.col(f"{name}m")["kept"]).select([F.col(f"`{c}`") for c in docs.columns])
