"""DuckDB SQL for the queries that SQL can express.

Not here: html labelling (a minimum cut), pseudonyms (keyed hashes), fingerprints (XXH64 and
graph components), URL models (a calibrated classifier) and packing (a tokenizer's ids);
tests hold those against brute force, round trips or planted truth.
"""

from __future__ import annotations

from tessera.llm.decontaminate import MASKS, SUBSTITUTIONS, TOKENS, WINDOW
from tessera.llm.lm_backoff import BACKOFF, LEAST
from tessera.llm.quality_rules import RULES, STOP_WORDS
from tessera.llm.url_lm import LOWER, UPPER
from tessera.llm.warc_zstd import LEAST_REVISIT

_WORD = r"[^\x20\x09-\x0D]+"


def _ratio(a: str, b: str) -> str:
    return f"CASE WHEN {b} = 0 THEN 0.0::DOUBLE ELSE {a}::DOUBLE / {b}::DOUBLE END"


def _broken() -> str:
    cases = []
    for r in RULES:
        out = [f"{r.measure} < {r.low!r}"] * (r.low is not None) + [f"{r.measure} > {r.high!r}"] * (r.high is not None)
        cases.append(f"CASE WHEN ({' OR '.join(out)}) AND n_words >= {r.from_words} THEN '{r.name}' END")
    return f"array_to_string(list_filter([{', '.join(cases)}], lambda x: x IS NOT NULL), '; ')"


OP2 = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w FROM documents),
win AS (SELECT doc_id, i, list_slice(w, i, i + 7) AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM d)),
dup AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) AS c FROM win) WHERE c > 1),
cov AS (SELECT doc_id, sum(least(8, coalesce(nx - i, 8)))::BIGINT AS r FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nx FROM dup) GROUP BY doc_id),
ln AS (SELECT doc_id, len(l)::BIGINT AS lines, (len(l) - len(list_distinct(l)))::BIGINT AS dups FROM (SELECT doc_id, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l FROM d)),
m AS (SELECT d.doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols, dups AS n_dup_lines, lines,
  coalesce(r, 0)::BIGINT AS n_repeat_words, len(regexp_extract_all(t, '\\p{{Lu}}'))::BIGINT AS caps, len(regexp_extract_all(t, '!'))::BIGINT AS excl,
  len(list_filter(w, lambda x: lower(x) IN ({', '.join(f"'{x}'" for x in STOP_WORDS)})))::BIGINT AS stops FROM d JOIN ln USING (doc_id) LEFT JOIN cov USING (doc_id)),
q AS (SELECT *, {_ratio('word_chars', 'n_words')} AS mean_word_chars, {_ratio('n_symbols', 'n_words')} AS symbol_ratio, {_ratio('excl', 'n_words')} AS exclamation_ratio,
  {_ratio('caps', 'word_chars')} AS capital_ratio, {_ratio('stops', 'n_words')} AS stop_word_ratio, {_ratio('n_dup_lines', 'lines')} AS dup_line_ratio, {_ratio('n_repeat_words', 'n_words')} AS repeat_ratio,
  n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m),
b AS (SELECT *, {_broken()} AS broken FROM q)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, mean_word_chars, symbol_ratio, exclamation_ratio, capital_ratio, stop_word_ratio, dup_line_ratio, repeat_ratio,
  base_failed, broken, NOT base_failed AND broken = '' AS kept FROM b
"""

OP3 = f"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w FROM documents),
win AS (SELECT doc_id, i, sha256(array_to_string(list_slice(w, i, i + 49), ' ')) AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d)),
dup AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY k) AS first FROM win) WHERE first < doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS p FROM dup),
word AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM d),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY p) AS t FROM word ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id),
n AS (SELECT doc_id, count(*) AS r FROM gone GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(r, 0)::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id) LEFT JOIN n USING (doc_id)
"""

OP5 = f"""
WITH p AS (SELECT page_id, url, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, CASE WHEN payload_bytes >= {LEAST_REVISIT} THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS first FROM p)
SELECT page_id, url, payload_bytes, payload_digest, CASE WHEN first < page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN first < page_id THEN first END AS refers_to FROM f
"""

# Another way to the same pairs: of WINDOW tokens of which SUBSTITUTIONS differ some run of
# RUN_TOKENS is equal, so equal runs give every alignment, which is then compared in full.
RUN_TOKENS = -(-(WINDOW - SUBSTITUTIONS) // (SUBSTITUTIONS + 1))
OP6 = f"""
WITH d AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '{TOKENS}') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(lower(coalesce(text, '')), '{TOKENS}') AS v FROM benchmark),
b9 AS (SELECT *, least(len(v), {RUN_TOKENS}) AS r FROM b WHERE len(v) > 0),
lens AS (SELECT DISTINCT r FROM b9),
dr AS (SELECT doc_id, i, r, array_to_string(list_slice(w, i, i + r - 1), ' ') AS k FROM (SELECT doc_id, w, r, unnest(range(1, len(w) - r + 2)) AS i FROM d, lens WHERE len(w) >= r)),
br AS (SELECT item_id, j, r, array_to_string(list_slice(v, j, j + r - 1), ' ') AS k FROM (SELECT item_id, v, r, unnest(range(1, len(v) - r + 2)) AS j FROM b9)),
al AS (SELECT DISTINCT doc_id, item_id, i - j AS shift FROM dr JOIN br USING (r, k)),
eq AS (SELECT doc_id, item_id, shift, len(v) AS n, list_transform(range(1, len(v) + 1), lambda p: CASE WHEN p + shift BETWEEN 1 AND len(w) AND w[p + shift] = v[p] THEN 1 ELSE 0 END) AS e FROM al JOIN d USING (doc_id) JOIN b9 USING (item_id)),
s AS (SELECT doc_id, item_id, n, list_sum(e)::BIGINT AS n_matched, list_max(list_transform(range(1, n - least(n, {WINDOW}) + 2), lambda p: list_sum(list_slice(e, p, p + least(n, {WINDOW}) - 1))))::BIGINT AS n_window FROM eq)
SELECT doc_id, item_id, max(n_matched) AS n_matched, max(n_window) AS n_window, max(n)::BIGINT AS n_tokens FROM s
WHERE n_window >= CASE WHEN n < {WINDOW} THEN n ELSE {WINDOW - SUBSTITUTIONS} END GROUP BY doc_id, item_id
"""

OP9 = f"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{_WORD}') AS w FROM documents),
t AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS x FROM d),
g AS (SELECT doc_id, i, x, lag(x) OVER o AS y, lag(x, 2) OVER o AS z FROM t WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
c AS (SELECT *, count(*) OVER () AS n, count(*) OVER (PARTITION BY x) AS c1, count(*) OVER (PARTITION BY x, y, y IS NULL) AS c2, count(*) OVER (PARTITION BY x, y, z, z IS NULL) AS c3 FROM g),
b AS (SELECT *, lag(c1) OVER o AS p1, lag(c2) OVER o AS p2 FROM c WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
s1 AS (SELECT *, ln(c1::DOUBLE / n) AS s FROM b),
s2 AS (SELECT * REPLACE (CASE WHEN y IS NULL THEN s WHEN c2 >= {LEAST} THEN ln(c2::DOUBLE / p1) ELSE ln({BACKOFF}) + s END AS s) FROM s1),
s3 AS (SELECT * REPLACE (CASE WHEN z IS NULL THEN s WHEN c3 >= {LEAST} THEN ln(c3::DOUBLE / p2) ELSE ln({BACKOFF}) + s END AS s) FROM s2),
a AS (SELECT doc_id, sum(s) AS s FROM s3 GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, round(coalesce(s, 0.0), 3) AS score, CASE WHEN len(w) > 0 THEN round(s / len(w), 6) END AS mean_score FROM d LEFT JOIN a USING (doc_id)
"""

ORACLES = {"op2_quality_rules": OP2.strip(), "op3_rlz_dedup": OP3.strip(), "op5_warc_zstd": OP5.strip(), "op6_spaced_seeds": OP6.strip(), "op9_stupid_backoff": OP9.strip()}


#: CRC-32 of a string column, bit by bit (reflected polynomial 0xEDB88320).
def _crc32(text: str) -> str:
    byte = f"list_transform(range(1, strlen({text}) + 1), lambda i: CAST('0x' || substr(hex(encode({text})), 2 * i - 1, 2) AS BIGINT))"
    step = "list_reduce(list_prepend(xor(c, b), range(8)), lambda x, i: xor(x >> 1, (x & 1) * 3988292384))"
    return f"xor(list_reduce(list_prepend(4294967295, {byte}), lambda c, b: {step}), 4294967295)"


#: Two words of one length are near if the same letter taken out leaves the same rest; two of
#: lengths one apart if taking a letter out of the longer leaves the shorter.
ORACLES["op12_spelling_variants"] = f"""WITH RECURSIVE runs AS (
  SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS d, unnest(regexp_extract_all(text, '[A-Za-z\u00C0-\u00FF]+')) AS run FROM documents),
low AS (SELECT d, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM runs WHERE length(run) >= 7),
per AS (SELECT d, run, d || ':' || run AS k, count(*) AS c FROM low GROUP BY d, run),
hashed AS (SELECT run, c, {_crc32('k')} AS h FROM per),
damaged AS (SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, CAST(h % length(run) AS BIGINT)) || substr(run, CAST(h % length(run) AS BIGINT) + 2) ELSE run END AS word, c FROM hashed),
words AS (SELECT word, CAST(sum(c) AS BIGINT) AS n FROM damaged WHERE length(word) >= 7 GROUP BY word HAVING sum(c) >= 2),
cut AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)),
pairs AS (
  SELECT a.word, a.n, b.word AS near, b.n AS near_n FROM cut a JOIN cut b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT w.word, w.n, c.word, c.n FROM words w JOIN cut c ON c.rest = w.word
  UNION SELECT c.word, c.n, w.word, w.n FROM words w JOIN cut c ON c.rest = w.word),
best AS (SELECT word, count(*) AS n_near, min({{'m': -near_n, 'w': near}}) AS b FROM pairs GROUP BY word),
forms AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN -b.m >= 10 * w.n THEN b.w END AS form, CASE WHEN -b.m >= 10 * w.n THEN -b.m END AS form_n
  FROM words w LEFT JOIN best USING (word)),
chain AS (SELECT word, word AS root FROM forms UNION ALL SELECT c.word, f.form FROM chain c JOIN forms f ON f.word = c.root WHERE f.form IS NOT NULL)
SELECT f.word, f.form, c.root, f.n, CAST(f.n_near AS BIGINT) AS n_near, CAST(f.form_n AS BIGINT) AS form_n
FROM forms f JOIN chain c ON c.word = f.word JOIN forms r ON r.word = c.root AND r.form IS NULL"""
