"""Spelling variants: words, gram decomposition, bounds and the whole query against brute force."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tessera.llm import spelling
from tessera.llm.spelling import gram_dictionary, near_words, signature, slices, spelling_groups, variable_grams, word_counts


def lower(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


def brute_words(rows):
    counts = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = lower(run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{w}".encode())
            if h % 31 == 0:
                w = w[:h % len(w)] + w[h % len(w) + 1:]
            counts[w] += 1
    return {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}


def is_near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute_groups(counts):
    out = {}
    for w, n in counts.items():
        near = [v for v in counts if v != w and is_near(w, v)]
        best = min(near, key=lambda v: (-counts[v], v), default=None)
        out[w] = [best if best and counts[best] >= 10 * n else None, n, len(near)]
    for w in out:
        root = w
        while out[root][0]:
            root = out[root][0]
        out[w].append(root)
    return {w: (form, root, n, near, counts[form] if form else None) for w, (form, n, near, root) in out.items()}


def edited(rng, w):
    i, c = rng.randrange(len(w)), rng.choice("abcé")
    return rng.choice([w[:i] + w[i + 1:], w[:i] + c + w[i:], w[:i] + c + w[i + 1:], w + c])


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(4)
    base = ["".join(rng.choice(["an", "der", "tion", "é", "of", "th", "x"]) for _ in range(rng.randint(4, 6))) for _ in range(60)]
    rows = [(1, None), (2, ""), (None, "Straßenbahn straßenbahn ÉCOLEAB École×÷abc "), (3, "a" * 50 + " " + "a" * 51 + " " + "a" * 50 + " " + "a" * 51), (3, "repeated repeated"), (3, "repeated repeated")]
    rows.append((6, "chainword " * 400 + "chainwordx " * 30 + "chainwordxy " * 2))
    for d in range(10, 60):
        words = [rng.choice(base) for _ in range(120)]
        words = [edited(rng, w) if rng.random() < .15 else w for w in words]
        words = [edited(rng, w) if rng.random() < .03 else w for w in words]
        rows.append((d, rng.choice([" ", "\n", ", ", "1"]).join(w.upper() if rng.random() < .2 else w for w in words)))
    return rows


def test_slices_keep_runs_whole():
    text = ("abc déf " * 50 + "x" * 200 + " ü ").encode()
    assert "".join(slices(text, 16)) == text.decode()
    assert [w for part in slices(text, 16) for w in re.findall("[a-zÀ-ÿ]+", part)] == re.findall("[a-zÀ-ÿ]+", text.decode())


def test_word_counts(spark, texts):
    df = spark.createDataFrame([(t, d, 5) for d, t in texts], "text string, doc_id long, word int")
    assert {r.word: r.n for r in word_counts(df).collect()} == brute_words(texts)


def test_untouched_grams_stay():
    """After one edit every gram that the edit does not touch is a gram of the new word, shifted or not."""
    rng = random.Random(2)
    words = ["".join(rng.choice("abc") for _ in range(rng.randint(7, 12))) for _ in range(300)]
    known = {}
    for q in range(3, 7):  # frequent: grams in more than 20 words
        n = Counter(g for w in words for g in {f"^{w}$"[i:i + q] for i in range(len(w) + 3 - q)})
        raw = np.frombuffer("".join(g for g, k in n.items() if k > 20).encode("utf-32-le"), np.uint32).reshape(-1, q).astype(np.uint64)
        h = np.zeros(len(raw), np.uint64)
        for j in range(q):
            h = h * spelling._MUL + raw[:, j] + np.uint64(1)
        keys = np.sort(spelling.splitmix(h + np.uint64(q)))
        known[q] = (keys, np.full(len(keys), 21, np.int32))
    for w in words:
        v = edited(rng, w)
        if len(v) < 7 or v == w:
            continue
        p, size, hashes, cost = variable_grams([w, v], known, limit=20)
        grams = [{(int(hashes[i]), int(p.at[i])) for i in range(p.starts[k], p.starts[k] + p.lengths[k]) if size[i]} for k in (0, 1)]
        a, b = signature(p, size, cost)
        for k in (0, 1):
            assert p.at[a[k]] + size[a[k]] <= p.at[b[k]]
            shifts = {0, len((v, w)[k]) - len((w, v)[k])}
            shared = [any((int(hashes[g[k]]), int(p.at[g[k]]) + s) in grams[1 - k] for s in shifts) for g in (a, b)]
            assert any(shared)


@pytest.mark.parametrize("limit, most", [(1, 1 << 19), (8, 4), (10 ** 6, 1 << 19)])
def test_pairs_do_not_depend_on_the_dictionary(spark, texts, limit, most, monkeypatch):
    counts = brute_words(texts)
    words = spark.createDataFrame(list(counts.items()), "word string, n long")
    monkeypatch.setattr(spelling, "MAX_FREQUENT", most)
    got = {frozenset((r.word, r.near)) for r in near_words(words, limit).collect()}
    assert got == {frozenset((a, b)) for a in counts for b in counts if a < b and is_near(a, b)}
    assert all(len(k) <= most for k, _ in gram_dictionary(words, limit=limit, most=most).values())


def test_query_matches_brute_force(spark, texts):
    df = spark.createDataFrame([(d, t, "x") for d, t in texts], "doc_id long, text string, near string").repartition(3)
    got = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in spelling_groups(df).collect()}
    want = brute_groups(brute_words(texts))
    assert got == want
    assert any(v[0] for v in want.values()) and any(v[0] and v[0] != v[1] for v in want.values())


def test_empty_table_and_no_words(spark):
    for rows in ([], [(1, None), (2, "short words only")]):
        out = spelling_groups(spark.createDataFrame(rows, "doc_id long, text string"))
        assert out.count() == 0 and out.columns == ["word", "form", "root", "n", "n_near", "form_n"]


def test_long_text_is_read_whole(spark):
    text = "beginning " + "z " * 2_000_000 + "beginning conclusion " + "conclusion"
    assert {r.word: r.n for r in word_counts(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()} == brute_words([(1, text)])
