"""Greedy factors of the substring operator: against a brute-force parse, and word by word against the references."""

import random

import numpy as np
import pytest

from tessera.llm import rlz_dedup


def brute_parse(ref, pos, known, window):
    """The same parse by extending every window at every word."""
    out, p, n = [], 0, len(known) + window - 1
    while p < n:
        best = None
        for w in range(max(0, p - window + 1), min(p, len(known) - 1) + 1):
            e = w
            if not known[w]:
                continue
            while e + 1 < len(known) and known[e + 1] and (ref[e + 1], pos[e + 1]) == (ref[e], pos[e] + 1):
                e += 1
            if best is None or e + window > best[0]:
                best = (e + window, int(ref[w]), int(pos[w]) + p - w)
        if best is None:
            p += 1
            continue
        out.append((p, best[0] - p, best[1], best[2]))
        p = best[0]
    return out


@pytest.mark.parametrize("seed", range(60))
def test_parse_equals_brute_force(seed):
    rng = np.random.default_rng(seed)
    n, window = int(rng.integers(0, 60)), int(rng.integers(1, 9))
    known = rng.random(n) < rng.choice([0.2, 0.7, 1.0])
    jump = rng.random(n) < 0.2
    ref, pos = np.cumsum(jump) % 3, np.arange(n) + 5 * np.cumsum(jump)
    assert rlz_dedup.parse(ref, pos, known, window) == brute_parse(ref, pos, known, window)


@pytest.mark.parametrize("window", [50, 6])
def test_factors_are_words_of_earlier_documents(spark, window):
    rng = random.Random(window)
    word = lambda: rng.choice("abcdefghijklmnopqrstuvw") * rng.randint(1, 3)
    pool = [[word() for _ in range(160)] for _ in range(4)]
    texts = {}
    for d in range(50):
        parts = []
        for _ in range(rng.randint(1, 4)):
            a = rng.randint(0, 80)
            parts += rng.choice(pool)[a:a + rng.randint(20, 80)] if rng.random() < 0.8 else [word() for _ in range(rng.randint(1, 60))]
        texts[d] = parts
    texts[60], texts[61], texts[62], texts[63] = texts[3], texts[7], [], ["x"] * 200
    texts[64] = ["x"] * 150
    rows = [(d, " ".join(w)) for d, w in texts.items()] + [(None, " ".join(texts[3])), (70, None)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r.doc_id: r for r in rlz_dedup.substring_dedup(df, window, texts=True, factors=True).collect()}
    assert not got[None].factors and not got[62].factors and not got[70].factors
    for d, words in texts.items():
        gone = []
        for f in got[d].factors:
            there = texts[f.ref_doc][f.ref_start:f.ref_start + f.length]
            assert f.ref_doc < d and f.length > 0 and there == words[f.start:f.start + f.length]
            assert not gone or f.start > gone[-1]  # left to right, no word twice
            gone += range(f.start, f.start + f.length)
            a, b, q = f.start, f.start + f.length, f.ref_start  # the match is long enough
            while a and q and words[a - 1] == texts[f.ref_doc][q - 1]:
                a, q = a - 1, q - 1
            assert b - a >= window
        assert len(gone) == got[d].n_removed
        assert got[d].kept_text.split() == [w for p, w in enumerate(words) if p not in set(gone)]
    assert [tuple(f) for f in got[60].factors] == [(0, len(texts[3]), got[60].factors[0].ref_doc, 0)] if len(texts[3]) >= window else True
    assert sum(len(r.factors) for r in got.values()) > 30


def test_texts_of_one_doc_id_keep_their_own_factors(spark):
    rng = random.Random(1)
    a, b = ([rng.choice("abcdefgh") * rng.randint(1, 4) for _ in range(120)] for _ in range(2))
    other = [rng.choice("stuvwxyz") for _ in range(40)]
    rows = [(1, a), (2, b), (5, other + a[20:100]), (5, b[:70] + other), (5, b[:70] + other)]
    df = spark.createDataFrame([(d, " ".join(w)) for d, w in rows], "doc_id long, text string")
    got = rlz_dedup.substring_dedup(df, factors=True).collect()
    assert sorted((r.doc_id, r.n_removed, [tuple(f) for f in r.factors]) for r in got) == [
        (1, 0, []), (2, 0, []), (5, 70, [(0, 70, 2, 0)]), (5, 70, [(0, 70, 2, 0)]), (5, 80, [(40, 80, 1, 20)])]
