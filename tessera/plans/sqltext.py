"""DuckDB SQL twins of the text functions, used only to write oracle queries."""

from __future__ import annotations

from tessera.functions import text as T


def q(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


def str_list(values) -> str:
    return "[" + ", ".join(q(v) for v in values) + "]::VARCHAR[]"


# written out here, so that a slip in the Spark side's pattern shows
_SPACES = "[\\t\\n\\x0b\\f\\r \\x1c\\x1d\\x1e\\x1f\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]+"


def tokenize_whitespace(e: str) -> str:
    return f"list_filter(string_split_regex(coalesce({e}, ''), {q(_SPACES)}), lambda t: t <> '')"


def remove_stopwords(e: str, stopwords) -> str:
    return (f"array_to_string(list_filter({tokenize_whitespace(e)}, "
            f"lambda t: NOT list_contains({str_list(stopwords)}, t)), ' ')")


def strip_suffixes_tokens(tokens: str, suffixes, min_stem: int = 2) -> str:
    pat = T.suffix_pattern(suffixes, min_stem)
    return f"list_transform({tokens}, lambda t: regexp_replace(t, {q(pat)}, '\\1'))"


def strip_suffixes(e: str, suffixes, min_stem: int = 2) -> str:
    return f"array_to_string({strip_suffixes_tokens(tokenize_whitespace(e), suffixes, min_stem)}, ' ')"


def strip_punctuation(e: str, mode: str = "space") -> str:
    if mode == "none":
        return e
    rep = "' '" if mode == "space" else "''"
    return f"regexp_replace({e}, {q(T.PUNCT_CLASS)}, {rep}, 'g')"


def clean_text(e: str, stopwords=(), suffixes=(), min_stem: int = 2, punct_mode: str = "space") -> str:
    x = f"coalesce({e}, '')"
    if suffixes:
        x = strip_suffixes(x, suffixes, min_stem)
    x = f"lower({x})"
    x = f"regexp_replace({x}, {q(T.DANDA)}, ' |', 'g')"
    x = strip_punctuation(x, punct_mode)
    x = f"regexp_replace({x}, {q(T.DOT_DASH_CLASS)}, ' ', 'g')"
    return remove_stopwords(x, list(stopwords))


def tokenize_default(e: str) -> str:
    return f"regexp_extract_all(lower(coalesce({e}, '')), {q(T.WORD_CHARS + '{2,}')})"


def tokenize_words(e: str) -> str:
    return f"regexp_extract_all(coalesce({e}, ''), {q(T.WORD_CHARS + '+|[^\\s\\p{L}\\p{N}_]')})"


def tokens_no_punct(e: str) -> str:
    return f"list_filter({tokenize_words(f'lower({e})')}, lambda t: strpos({q(T.PUNCTUATION)}, t) = 0)"


def tokenize_script(e: str) -> str:
    lo, hi = T.DEVANAGARI_RANGE
    return f"regexp_extract_all(coalesce({e}, ''), {q('[' + lo + '-' + hi + ']+')})"


def ngrams(tokens: str, n: int) -> str:
    return (f"CASE WHEN len({tokens}) < {n} THEN []::VARCHAR[] ELSE "
            f"list_transform(range(1, len({tokens}) - {n} + 2), "
            f"lambda i: array_to_string({tokens}[i:i + {n - 1}], ' ')) END")


def pad_truncate(tokens: str, max_len: int = 100, pad: str = T.PAD) -> str:
    return f"list_concat(coalesce({tokens}, []::VARCHAR[]), list_transform(range({max_len}), lambda i: {q(pad)}))[1:{max_len}]"


def transliterate(e: str, one_to_one: dict, one_to_many: dict | None = None) -> str:
    x = e
    for src, dst in (one_to_many or {}).items():
        x = f"replace({x}, {q(src)}, {q(dst)})"
    if one_to_one:
        x = f"translate({x}, {q(''.join(one_to_one))}, {q(''.join(one_to_one.values()))})"
    return x
