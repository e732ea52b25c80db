"""URL filters: host and path rules, and a character language-model ratio for the rest.

Two variable-order Markov models, of accepted and of rejected URLs, give each URL two
log-likelihoods; their difference per character, against a threshold calibrated on URLs the
models have not seen, accepts or rejects it. The models back off from the longest context by
interpolation (Witten-Bell): unseen contexts hand over to shorter ones, down to uniform.

All labelled URLs take part: every second one (in the order of their hashes) fits the models, the
others calibrate. Counts and probabilities stay tables; URLs are scored in blocks that fetch the
probabilities of their distinct characters in context. ``Markov`` is the same model in memory.
"""

from __future__ import annotations

import math
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from tessera.operators.indexing import cumulative, dense_index, materialize

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class Rule(NamedTuple):
    """A verdict for a host with all its subdomains, where the path starts so."""
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


RULES = (Rule("allow", "com", "/"), Rule("block", "example.com", "/en/"), Rule("allow", "www.example.com", "/en/"), Rule("block", "net", "/es/"), Rule("block", "net", "/fr/"))
ORDER = 5
#: About so many URLs are scored at once.
BLOCK_URLS = 20_000
#: The uniform distribution at the bottom is over so many characters.
ALPHABET = 256


def parts(url: Column) -> tuple[Column, Column]:
    """(host, path) as literal parts of the URL; both empty if it is null or has no ``://``."""
    url = F.coalesce(url, F.lit(""))
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"\A([^/?#]*)", 1)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"\A([^?#]*)", 1)
    return F.translate(host, UPPER, LOWER), path


def matching_rule(host: Column, path: Column, rules=RULES) -> Column:
    """The index of the longest rule that fits, or null."""
    out = F.lit(None).cast("int")
    for r in sorted(rules, key=lambda r: (len(r.name), r.name)):  # the longest wraps the others
        fits = ((host == r.host) | F.endswith(host, F.lit("." + r.host))) & F.startswith(path, F.lit(r.path))
        out = F.when(fits, F.lit(rules.index(r))).otherwise(out)
    return out


class Markov:
    """Character counts after every context of up to ``order`` characters."""

    def __init__(self, order: int = ORDER):
        self.order = order
        self.counts: dict[str, dict[str, int]] = {}

    def add(self, url: str) -> None:
        text = "\x02" * self.order + url + "\x03"
        for i in range(self.order, len(text)):
            for k in range(self.order + 1):
                after = self.counts.setdefault(text[i - k:i], {})
                after[text[i]] = after.get(text[i], 0) + 1

    def finish(self) -> Markov:
        self.totals = {c: (sum(a.values()), len(a)) for c, a in self.counts.items()}
        self.cache: dict[tuple[str, str], float] = {}
        return self

    def probability(self, context: str, char: str) -> float:
        p = 1.0 / ALPHABET
        for k in range(len(context) + 1):
            c = context[len(context) - k:]
            if c not in self.totals:
                break
            total, kinds = self.totals[c]
            p = (self.counts[c].get(char, 0) + kinds * p) / (total + kinds)
        return p

    def score(self, url: str) -> float:
        """Log-likelihood of the URL with its end."""
        text, out = "\x02" * self.order + url + "\x03", 0.0
        for i in range(self.order, len(text)):
            key = (text[i - self.order:i], text[i])
            s = self.cache.get(key)
            if s is None:
                s = math.log(self.probability(*key))
                if len(self.cache) < 200_000:
                    self.cache[key] = s
            out += s
        return out


def ratio(good: Markov, bad: Markov, url: str) -> float:
    """Log-likelihood difference per character."""
    return (good.score(url) - bad.score(url)) / (len(url) + 1)


def threshold(accepted: list[float], rejected: list[float]) -> float:
    """The cut between two sets of ratios with the highest mean of both hit rates.

    Of equally good cuts the middle of the widest; without one of the sets the other's
    smallest or largest ratio is beyond the cut; without both it is 0.
    """
    if not accepted or not rejected:
        return min(accepted) if accepted else max(rejected) + 1e-9 if rejected else 0.0
    points = sorted([(x, 1) for x in accepted] + [(x, 0) for x in rejected])
    best, cut, below_good, below_bad = -1.0, 0.0, 0, 0
    for i, (x, good) in enumerate(points):
        rate = below_bad / len(rejected) + 1 - below_good / len(accepted)
        left = points[i - 1][0] if i else x
        if (not i or left < x) and (rate, x - left) > (best, width if best >= 0 else -1.0):
            best, cut, width = rate, (x + left) / 2, x - left
        below_good, below_bad = below_good + good, below_bad + 1 - good
    if below_bad / len(rejected) > best:
        cut = points[-1][0] + 1e-9
    return cut


def model_text(url: str | None, rules_host: bool = False) -> str:
    """What the models read: the whole URL in lower case (null: empty)."""
    return (url or "").lower()


def model_texts(url: str) -> Column:
    """``model_text`` of a column."""
    @F.pandas_udf("string")
    def texts(urls: pd.Series) -> pd.Series:
        return urls.map(lambda u: model_text(None if pd.isna(u) else u))
    return texts(F.col(url))


def _occurrences(texts: DataFrame, keep: list[str], order: int) -> DataFrame:
    """(keep..., context, char): every character of ``text`` and its end, with the ``order`` before it."""
    padded = texts.select(*keep, F.concat(F.lit("\x02" * order), F.col("text"), F.lit("\x03")).alias("_t"))
    at = F.explode(F.sequence(F.lit(1), F.length("_t") - order)).alias("_i")
    return padded.select(*keep, "_t", at).select(*keep, F.expr(f"substring(_t, _i, {order})").alias("context"), F.expr(f"substring(_t, _i + {order}, 1)").alias("char"))


def _suffixes(order: int) -> Column:
    """The ends of ``context``, from none of it to all."""
    return F.array(*[F.expr(f"substring(context, {order - k + 1}, {k})") for k in range(order + 1)])


def fit(labelled: DataFrame, order: int = ORDER) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(counts, totals, calibration) from rows (url, verdict): how often each char follows each context of
    up to ``order`` in the accepted (``good``) and rejected (``bad``) URLs, how often and with how many
    kinds of chars each context stands, and the (text, verdict) that only calibrate."""
    urls = labelled.where("verdict in ('allow', 'block') and url is not null").select("verdict", "url", F.xxhash64("url").alias("h")).distinct()
    urls = materialize(dense_index(urls, ["h", "url"], "i", ["verdict"]).select("verdict", "i", model_texts("url").alias("text")))
    whole = _occurrences(urls.where("i % 2 = 0"), ["verdict"], order).groupBy("verdict", "context", "char").agg(F.count(F.lit(1)).alias("n"))
    good, bad = (F.when(F.col("verdict") == v, F.col("n")).otherwise(0) for v in ("allow", "block"))
    counts = materialize(whole.select("char", good.alias("good"), bad.alias("bad"), F.explode(_suffixes(order)).alias("context"))
                         .groupBy("context", "char").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad")))
    totals = counts.groupBy("context").agg(F.sum("good").alias("good_total"), F.sum("bad").alias("bad_total"),
                                           F.count_if(F.col("good") > 0).alias("good_kinds"), F.count_if(F.col("bad") > 0).alias("bad_kinds"))
    return counts, totals, urls.where("i % 2 = 1").select("text", "verdict")


def probabilities(asked: DataFrame, counts: DataFrame, totals: DataFrame) -> DataFrame:
    """``asked`` (distinct context, char) with ``good`` and ``bad``: the models' probabilities, mixed from no context upwards."""
    order = asked.select(F.max(F.length("context"))).first()[0] or 0
    ends = asked.select("context", "char", F.posexplode(_suffixes(order)).alias("k", "end"))
    ends = ends.join(totals.withColumnRenamed("context", "end"), "end").join(counts.withColumnRenamed("context", "end"), ["end", "char"], "left")
    steps = F.array_sort(F.collect_list(F.struct("k", *[F.coalesce(c, F.lit(0)).cast("double").alias(c) for c in ("good", "good_total", "good_kinds", "bad", "bad_total", "bad_kinds")])))

    def mixed(m: str) -> Column:
        return F.aggregate("_s", F.lit(1.0 / ALPHABET), lambda p, s: F.when(s[m + "_total"] > 0, (s[m] + s[m + "_kinds"] * p) / (s[m + "_total"] + s[m + "_kinds"])).otherwise(p))
    known = ends.groupBy("context", "char").agg(steps.alias("_s")).select("context", "char", mixed("good").alias("good"), mixed("bad").alias("bad"))
    if not totals.head(1):  # no labelled URL at all
        return asked.select("context", "char", F.lit(1.0 / ALPHABET).alias("good"), F.lit(1.0 / ALPHABET).alias("bad"))
    return known


def score_texts(texts: DataFrame, counts: DataFrame, totals: DataFrame, order: int = ORDER) -> DataFrame:
    """(text, score) of distinct texts: the log-likelihood difference per character."""
    blocks = max(1, math.ceil(texts.count() / BLOCK_URLS))
    cut = texts.select(F.pmod(F.xxhash64("text"), F.lit(blocks)).alias("block"), "text")
    grams = materialize(_occurrences(cut, ["block"], order).distinct())
    known = probabilities(grams.select("context", "char").distinct(), counts, totals)

    def score(block: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        logs = {(c, x): (math.log(g), math.log(b)) for c, x, g, b in zip(held["context"], held["char"], held["good"], held["bad"])}
        out = []
        for url in block["text"]:
            text, good, bad = "\x02" * order + url + "\x03", 0.0, 0.0
            for i in range(order, len(text)):
                g, b = logs[text[i - order:i], text[i]]
                good, bad = good + g, bad + b
            out.append((good - bad) / (len(url) + 1))
        return pd.DataFrame({"text": block["text"], "score": pd.Series(out, index=block.index, dtype=float)})

    held = grams.join(known, ["context", "char"])
    return materialize(cut.groupBy("block").cogroup(held.groupBy("block")).applyInPandas(score, "text string, score double"))


def calibrate(scored: DataFrame) -> float:
    """``threshold`` of rows (score, verdict), over sorted running counts."""
    good, bad = ((F.col("verdict") == v).cast("long") for v in ("allow", "block"))
    by = scored.groupBy("score").agg(F.sum(good).alias("g"), F.sum(bad).alias("b"))
    every = by.agg(F.sum("g"), F.sum("b"), F.min("score"), F.max("score")).first()
    if not every[0] or not every[1]:
        return every[2] if every[0] else every[3] + 1e-9 if every[1] else 0.0
    run = cumulative(by, [], ["score"], ["g", "b"], before=True)
    run = cumulative(run.select("score", *[F.coalesce(c + "_before", F.lit(0.0)).alias(c) for c in ("g", "b")]), [], ["score"], ["score"], op="max", before=True)
    left = F.coalesce("score_before", "score")
    rate = F.col("b") / every[1] + 1 - F.col("g") / every[0]
    best = run.agg(F.max(F.struct(rate.alias("rate"), (F.col("score") - left).alias("width"), (-F.col("score")).alias("x"), left.alias("left"))).alias("m")).first()["m"]
    return every[3] + 1e-9 if 1.0 > best.rate else (best.left - best.x) / 2


def filter_urls(pages: DataFrame, rules=RULES, order: int = ORDER) -> DataFrame:
    """page_id, host, path, rule, verdict, score of every row of ``pages``, by page_id.

    ``rule`` is the longest rule that fits (host and all subdomains, prefix of the path) and
    gives the verdict; without one ``score`` (the log-likelihood difference per character) is
    compared to the calibrated threshold. All URLs that a rule accepts or rejects train and calibrate
    the models. A null URL has empty host and path and is scored as the empty URL. Rows are judged one
    by one, so repeated rows repeat their verdict. Extra columns are ignored.
    """
    host, path = parts(F.col("url"))
    known = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url")).select("page_id", "url", host.alias("host"), path.alias("path"))
    known = known.select("*", matching_rule(F.col("host"), F.col("path"), rules).alias("hit"))
    names = F.array(*[F.lit(r.name) for r in rules])
    verdicts = F.array(*[F.lit(r.verdict) for r in rules])
    known = known.select("page_id", "url", "host", "path", F.get(names, "hit").alias("rule"), F.get(verdicts, "hit").alias("verdict"))
    counts, totals, calibration = fit(known.filter("verdict is not null"), order)
    ruled = known.select("page_id", "host", "path", "rule", "verdict", F.when(F.col("verdict").isNull(), model_texts("url")).alias("text"))
    scores = score_texts(ruled.where("text is not null").select("text").unionByName(calibration.select("text")).distinct(), counts, totals, order)
    cut = calibrate(calibration.join(scores, "text"))
    out = ruled.join(scores, "text", "left")
    verdict = F.coalesce("verdict", F.when(F.col("score") >= cut, "allow").otherwise("block"))
    return out.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "score").orderBy("page_id")
