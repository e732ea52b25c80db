"""Each operator against brute force, planted truth or a round trip, and on odd tables."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
import xxhash

from tessera.llm import decontaminate, html_mincut, lm_backoff, packing, pii_feistel, quality_rules, rlz_dedup, simhash, url_lm, warc_zstd
from tessera.llm.common import range_hashes, string_buffers, word_hashes, word_spans

WORDS = [f"w{i}" for i in range(300)] + ["the", "of", "and", "é", "ß"]


def frame(spark, rows, schema="doc_id long, text string, lang string, source string, n_chars long"):
    width = schema.count(",") + 1
    return spark.createDataFrame([tuple(r) + (None,) * (width - len(r)) for r in rows], schema)


def text(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="module")
def odd():
    """Nulls, empty and blank texts, ties, repeated rows, one long text, odd white space."""
    rng = random.Random(3)
    base = text(rng, 200)
    rows = [(1, base), (2, base), (3, base.upper()), (4, None), (5, ""), (6, " \t\n\x0b\f\r "), (7, "one"), (8, text(rng, 40000)), (9, base.replace(" ", "\n\t ")), (10, "nbsp\u00a0here \u2003x\x00y"),
            (11, "a " * 500), (12, "a " * 500 + "b"), (None, base), (None, None), (1, base), (13, base[:400] + " new " + base[400:])]
    return rows


# ---- words and hashes

def test_word_spans_match_split():
    import pyarrow as pa
    texts = ["a b", None, "", "  x\ty\x0bz\f\r\n", "éß\u00a0q", "end", "start"]
    raw, offsets = string_buffers(pa.array(texts))
    starts, ends, first = word_spans(raw, offsets)
    got = [[raw[s:e].tobytes() for s, e in zip(starts[a:b], ends[a:b])] for a, b in zip(first[:-1], first[1:])]
    assert got == [(t or "").encode().split() for t in texts]
    h = word_hashes(raw, starts, ends)
    seen = {}
    for words, a in zip(got, first[:-1]):
        for k, w in enumerate(words):
            assert seen.setdefault(w, h[a + k]) == h[a + k]
    assert len(set(seen.values())) == len(seen)


def test_range_hashes_depend_on_content_only():
    v = np.array([1, 2, 3, 1, 2, 3, 4], np.uint64)
    h = range_hashes(v, np.array([0, 3, 1, 0]), np.array([3, 6, 4, 2]))
    assert h[0] == h[1] and len(set(h.tolist())) == 3


# ---- 1 html

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p>";</script></head><body>
<header><a href="/">Home</a></header><nav><ul><li><a href=x>One</a><li><a href=y>Two</a></ul></nav><!-- <p>no</p> -->
<div class="cookie-notice">We use cookies. Accept all of them now.</div><div class="ad">Buy this now, a long sentence to sell a thing to you.</div>
<article><h1>A title &amp; more</h1><p>First <b>paragraph</b> of the article,&nbsp;with   words and an end.<p>Second one: 1 &lt; 2 &#233;t&eacute;.
<aside class="sidebar"><p>Related things that are not of the article.</p></aside><p>Third paragraph of some length goes here.</p>
<form><label>Mail</label><input name=m><button>Send</button></form><section id="comments"><p>I am a reader and I do comment on this.</p></section></article>
<footer>&copy; us &middot; all rights reserved.</footer>"""


def test_html_article_only():
    assert html_mincut.main_text(PAGE) == ("A title & more\nFirst paragraph of the article, with words and an end.\nSecond one: 1 < 2 été.\nThird paragraph of some length goes here.")


@pytest.mark.parametrize("page", [None, "", "   ", "<", "<p", "<!-- open", "<script>x", "</p></div>", "<p>" * 3000, "<a href='x", "<" * 500, "<b><p></b>x</p>"])
def test_html_odd_pages(page):
    assert isinstance(html_mincut.main_text(page), str)


def test_html_comments_that_end_early():
    p = "<p>First paragraph of the article, with words and an end.</p>{}<p>Second paragraph of the article, with words and an end.</p>"
    whole = html_mincut.main_text(p.format(""))
    for comment in ("<!-->", "<!--->", "<!-- x --!>", "<!-- > -> -->", "<!---->"):
        assert html_mincut.main_text(p.format(comment)) == whole, comment


def test_html_plain_text_without_tags():
    assert html_mincut.main_text("Just a text that is long enough to be the main one.") == "Just a text that is long enough to be the main one."


def test_min_cut_is_minimal():
    rng = random.Random(5)
    for _ in range(60):
        n = rng.randint(1, 9)
        gain = [rng.uniform(-2, 2) for _ in range(n)]
        edges = [(i, j, rng.uniform(0, 1.5)) for i in range(n) for j in range(i) if rng.random() < 0.5]

        def cost(label):
            return sum(abs(g) for g, s in zip(gain, label) if s != (g > 0)) + sum(w for a, b, w in edges if label[a] != label[b])
        best = min(cost([m >> i & 1 == 1 for i in range(n)]) for m in range(1 << n))
        assert cost(html_mincut.min_cut(gain, edges)) == pytest.approx(best, abs=0.02)


def test_min_cut_of_a_large_page_ends():
    import time
    rng = random.Random(6)
    n = 20000
    gain = [rng.uniform(-2, 2) for _ in range(n)]
    begin = time.time()
    html_mincut.min_cut(gain, [(i - 1, i, 0.8) for i in range(1, n)] + [(i - 2, i, 1.0) for i in range(2, n)])
    page = "".join("<p>Some words of a paragraph.</p>" if i % 2 else "<aside>An advert here</aside>" for i in range(n))
    assert html_mincut.main_text(page).count("paragraph") == n // 2
    assert time.time() - begin < 20  # a search from all sources for each path took minutes


def article_of(page):
    """The text of a page's one article element, by the simplest means."""
    import html
    import re
    inner = re.sub(r"<!--.*?-->", "", re.search(r"<article>(.*?)</article>", page, re.S)[1], flags=re.S)
    inner = re.sub(r"<br[^>]*>", " ", re.sub(r"</?(?:p|h\d|div|ul|li)\b[^>]*>", "\0", inner))
    return [b for b in (" ".join(html.unescape(re.sub(r"</?[a-zA-Z][^>]*>", "", b)).split()) for b in inner.split("\0")) if b]


def test_html_without_telling_names_and_with_broken_tags(spark):
    """Pages keep their article without names and with unclosed tags, and there the cut mends labels."""
    import re
    pages = [r.html for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").orderBy("page_id").collect()]

    def nameless(p):
        return re.sub(r"<(/?)(?:article|nav|footer)>", r"<\1div>", p.replace(' class="ad"', ""))

    def unclosed(p):
        return re.sub(r"</(?:p|li|b|h1)>", "", nameless(p))
    model = html_mincut.fit(spark.read.parquet("/root/testdata/sf0.01/pages.parquet"))
    for change, mends in ((str, 0), (nameless, 0), (unclosed, len(pages) // 10)):
        mended = 0
        for p in pages:
            want, judged = article_of(p), html_mincut.judge(change(p), model)
            assert [s for s, _, good in judged if good] == want
            mended += [s for s, gain, _ in judged if gain > 0] != want
        assert mended >= mends


def test_html_blocks_of_one_parent_are_joined_across_others():
    nodes = [n for _, n, _ in html_mincut.page_blocks("<div><p>A</p><section><p>B</p></section><p>C</p><aside>D</aside></div>")]
    assert sorted(html_mincut.edges_of(nodes)) == [(0, 1, 0), (0, 2, 1), (1, 2, 0), (2, 3, 0)]
    long = "A paragraph with a good number of words in it, more than the advert has, and an end."
    inside = f"<article><p>{long}</p><div class='ad'>{long[2:]}</div><p>{long}</p><aside><p>{long[3:]}</p></aside><p>Short.</p></article>"
    assert html_mincut.main_text(inside) == f"{long}\n{long}\nShort."
    page = "<p>{0}</p><div class='ads'>Buy now</div><h2>A short heading</h2><div class='ads'>Buy now</div><p>{0}</p>".format("A paragraph with a good number of words in it, and an end.")
    assert "A short heading" in html_mincut.main_text(page) and "Buy" not in html_mincut.main_text(page)


def test_html_fit(spark):
    rows = np.array([[1.0, x / 100, *[0.0] * 8, float(x + random.Random(x).randint(-20, 20) > 50)] for x in range(100)] * 2)
    model = html_mincut.fit_model(rows, np.array([0, 0, 90, 10, 0, 0, 0, 0.0]))
    assert model.shape[1] > 1 and abs(model.shape[0] + model.shape[1] / 2) < 1 and model.smooth[1] > model.smooth[0]
    assert html_mincut.fit_model(rows[:20], np.zeros(8)) is None
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    copies = spark.createDataFrame([(1, "u", PAGE)] * 300, "page_id long, url string, html string")
    assert html_mincut.fit(empty) == html_mincut.fit(copies) == html_mincut.DEFAULT


def test_html_query_keeps_all_rows(spark):
    pages = spark.createDataFrame([(1, "u", PAGE, 1), (2, None, None, 2), (None, "v", "", 3), (1, "u", PAGE, 1)], "page_id long, url string, html string, text int")
    got = [(r.page_id, r.url, r.n_chars == len(r.text)) for r in html_mincut.extract(pages).collect()]
    assert got == [(1, "u", True), (2, None, True), (None, "v", True), (1, "u", True)]
    assert html_mincut.extract(pages.limit(0)).count() == 0


# ---- 2 quality

def brute_repeat(words, k=8):
    at = defaultdict(list)
    for i in range(len(words) - k + 1):
        at[tuple(words[i:i + k])].append(i)
    return len({p for v in at.values() if len(v) > 1 for i in v for p in range(i, i + k)})


def test_quality_counts(spark, odd):
    rng = random.Random(1)
    rows = odd + [(20 + k, text(rng, rng.randint(1, 60)) + "\n" + " ".join(rng.choice("ab") for _ in range(rng.randint(0, 60))) + "\nsame line\nsame line\n \n \n#*$%&|<>") for k in range(30)]
    got = quality_rules.quality_report(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    for r, (doc, t) in zip(got, rows):
        words = [w.decode() for w in (t or "").encode().split()]
        lines = [x for x in (t or "").split("\n") if x.encode().strip()]
        rep = brute_repeat(words)
        want = (doc, len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), rep)
        assert (r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (len(words) < 20 or 100 * rep > 30 * len(words))
        assert r.kept == (not r.base_failed and not r.broken)


def test_quality_keeps_clean_and_extra_columns(spark):
    clean = "The house of the man is on the hill, and it was sold to a woman from the town with the old mill by the river."
    rows = [(1, clean + f" Number {i}." , i) for i in range(3)] + [(2, "### " + "a$$$ b%%% " * 30, 9), (3, "STOP!! " * 40, 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, quality_m int")
    assert [tuple(r) for r in quality_rules.keep_quality(df).collect()] == rows[:3]
    assert quality_rules.keep_quality(df.limit(0)).columns == df.columns


# ---- 3 substring dedup

def brute_dedup(rows, window):
    first = {}
    for doc, t in rows:
        w = (t or "").encode().split()
        if doc is not None:
            for i in range(len(w) - window + 1):
                k = tuple(w[i:i + window])
                first[k] = min(first.get(k, doc), doc)
    out = []
    for doc, t in rows:
        w = (t or "").encode().split()
        gone = {p for i in range(len(w) - window + 1) if doc is not None and first[tuple(w[i:i + window])] < doc for p in range(i, i + window)}
        out.append((doc, len(w), len(gone), hashlib.sha256(b" ".join(x for p, x in enumerate(w) if p not in gone)).hexdigest()))
    return out


def order(rows):
    return sorted(rows, key=lambda r: tuple((x is not None, x) for x in r))


@pytest.mark.parametrize("window", [50, 12, 3])
def test_rlz_equals_brute_force(spark, odd, window):
    rng = random.Random(window)
    pool = [text(rng, 90) for _ in range(6)]
    rows = [r for r in odd if r[0] != 8]
    for d in range(100, 160):
        parts = []
        for _ in range(rng.randint(1, 4)):
            words = rng.choice(pool).split()
            a = rng.randint(0, 40)
            parts.append(" ".join(words[a:a + rng.randint(10, 70)]) if rng.random() < 0.7 else text(rng, rng.randint(1, 80)))
        rows.append((d, " ".join(parts)))
    rng.shuffle(rows)
    got = rlz_dedup.substring_dedup(frame(spark, rows), window)
    assert order([tuple(r) for r in got.collect()]) == order(brute_dedup(rows, window))


def test_rlz_periodic_and_kept_text(spark):
    rows = [(5, "x y " * 60), (2, "y x " * 40), (9, "x " * 70), (1, "x " * 60)]
    got = {r.doc_id: r for r in rlz_dedup.substring_dedup(frame(spark, rows), texts=True).collect()}
    for doc, n, gone, sha in brute_dedup(rows, 50):
        assert (got[doc].n_removed, got[doc].kept_sha256) == (gone, sha)
        assert hashlib.sha256(got[doc].kept_text.encode()).hexdigest() == sha
    assert rlz_dedup.substring_dedup(frame(spark, rows).limit(0)).count() == 0


# ---- 4 pii

KEY = b"k1"


@pytest.mark.parametrize("size", [2, 10, 97, 1000])
def test_feistel_is_a_permutation(size):
    assert sorted(pii_feistel.permute(x, size, KEY, b"t") for x in range(size)) == list(range(size))


def test_pii_formats_and_links():
    import datetime
    import re
    src = ("Card 4111 1111 1111 1111 and 4111111111111111, not 4111111111111112. Mail ana.smith42@mail.example.com, call +1 (017) 555-7713 or (212) 555-0147. "
           "IP 10.20.30.240 not 300.1.1.1. Born 1984-02-29, not 1985-02-29; 31/12/1999. SSN 123-45-6789 not 000-45-6789. IBAN GB82 WEST 1234 5698 7654 32. Version 4.0 of 2024 has 12 parts. "
           "token = \"9233a8ecf7c5b09fe5949719b6b82bc439e9329b\"")
    out, n = pii_feistel.pseudonymise(src, KEY)
    assert n == {"email": 1, "phone": 2, "ipv4": 1, "card": 2, "iban": 1, "ssn": 1, "date": 2, "secret": 1}
    for gone in ("4111 1111", "4111111111111111,", "ana.smith42", "555-7713", "555-0147", "10.20.30.240", "1984-02-29", "31/12/1999", "123-45-6789", "9233a8ec", "WEST 1234"):
        assert gone not in out
    for kept in ("4111111111111112", "300.1.1.1", "1985-02-29", "000-45-6789", "Version 4.0 of 2024 has 12 parts.", "@mail.example.com", "+1 ("):
        assert kept in out
    spaced, plain = re.search(r"Card ([\d ]{19}) and (\d{16}),", out).groups()
    assert spaced.replace(" ", "") == plain and pii_feistel.luhn_digit(plain[:-1]) == plain[-1]
    iban = re.search(r"GB\d\d [A-Z]{4} \d{4} \d{4} \d{4} \d\d", out)[0].replace(" ", "")
    assert pii_feistel.iban_rest(iban[:2], iban[2:4], iban[4:]) == 1
    assert all(int(x) < 256 for x in re.search(r"IP ([\d.]+\d) ", out)[1].split("."))
    datetime.date.fromisoformat(re.search(r"Born (\S+),", out)[1])
    assert pii_feistel.pseudonymise(src, KEY)[0] == out != pii_feistel.pseudonymise(src, b"k2")[0]


@pytest.mark.parametrize("src,counts", [
    ("Des +1 (826) 555-4081 190.137.223.204 du", {"phone": 1, "ipv4": 1}), ("+44 20 7946 0958 190.137.223.204", {"phone": 1, "ipv4": 1}), ("7536784127813050 4111111111111111 +33 6 12 34 56 78.", {"card": 1, "phone": 1}),
    ("3782 822463 10005, 5555-5555-5555-4444 12", {"card": 2}), ("8111111111111119 1234 5678 9012", {}), ("é.b.9@x.org!! a@b.c@d.ef", {"email": 2}), ("9" * 5000 + ".1.2.3.4 +", {}), ("1.2.3.4.5 v1.2.3.4", {})])
def test_pii_neighbours(src, counts):
    out, n = pii_feistel.pseudonymise(src, KEY)
    assert {k: v for k, v in n.items() if v} == counts
    assert (out == src) == (not counts) and len(out.split()) == len(src.split())


@pytest.mark.parametrize("value,kind", [
    ("ES9121000418450200051332", "iban"), ("ES91 2100 0418 4502 0005 1332", "iban"), ("PL61109010140000071219812874", "iban"), ("SE45 5000 0000 0583 9825 7466", "iban"),
    ("CZ6508000000192000145399", "iban"), ("BE68539007547034", "iban"), ("DE89370400440532013000", "iban"), ("GB82 WEST 1234 5698 7654 32", "iban"),
    ("+49 30 1234 5678", "phone"), ("+44 (20) 7946 0958", "phone"), ("+33 6 12 34 56 78", "phone")])
@pytest.mark.parametrize("tail", ["", " 2024", " BIC", " EUR 2024", " 2024 2025 A1", " 2024-01-02x", " AB12", ", 7", " 2024 2025 2026 2027"])
def test_pii_value_before_numbers_and_capitals(value, kind, tail):
    alone, _ = pii_feistel.pseudonymise(value, KEY)
    out, n = pii_feistel.pseudonymise(f"to {value}{tail}", KEY)
    assert {k: v for k, v in n.items() if v} == {kind: 1} and value not in out
    if kind == "iban":  # a phone number has no fixed length: up to 15 digits, what follows may belong to it
        assert out == f"to {alone}{tail}"


def test_pii_long_phone_drops_groups():
    out, n = pii_feistel.pseudonymise("+49 30 1234 5678 2024 and +44 20 7946 0958 2024-01-02", KEY)
    a, b = pii_feistel.phone("+49 30 1234 5678", KEY), pii_feistel.phone("+44 20 7946 0958", KEY)
    assert out == f"{a} 2024 and {b} {pii_feistel.date('2024-01-02', KEY)}" and (n["phone"], n["date"]) == (2, 1)
    for kept in ("+49301234567890123456", "+49.30.1234.5678.2024.1", "ES9121000418450200051333 2024"):
        assert pii_feistel.pseudonymise(kept, KEY)[0] == kept


def test_pii_dates_do_not_collide():
    import datetime
    days = [datetime.date.fromordinal(n) for n in range(pii_feistel.FIRST_DAY, pii_feistel.LAST_DAY + 1)]
    for layout in ("%d/%m/%Y", "%m/%d/%Y", "%Y-%m-%d"):
        assert len({pii_feistel.date(d.strftime(layout), KEY) for d in days[::7]}) == len(days[::7])
    written = {d.strftime(layout) for d in days for layout in ("%d/%m/%Y", "%m/%d/%Y")}
    assert {pii_feistel.date(w, KEY) for w in written} == written


def test_pii_links_layouts():
    def same(values, make, plain):
        assert len({plain(make(v, KEY)) for v in values}) == 1

    def number(s):
        return "".join(c for c in s.replace("(0)", "") if c.isdigit())
    same(["+49 30 12345678", "+493012345678", "+49 (0)30 1234 5678", "+49-30-12345678"], pii_feistel.phone, number)
    same(["(555) 123-4567", "+1 555 123 4567", "555-123-4567", "+15551234567"], pii_feistel.phone, lambda s: number(s)[-10:])
    same(["+353 1 234 5678", "+35312345678"], pii_feistel.phone, number)
    same(["Bob.Q1@x.com", "bob.q1@x.com", "BOB.Q1@X.com"], pii_feistel.email, str.lower)
    same(["28/05/2020", "05/28/2020", "2020-05-28"], pii_feistel.date, lambda s: "/".join(sorted(s.replace("-", "/").split("/"))))


def unpermute(x, size, key, tweak):
    """The inverse of pii_feistel.permute: the rounds from the last to the first."""
    from hashlib import blake2b
    if size < 2:
        return x
    half = max(1, ((size - 1).bit_length() + 1) // 2)
    mask, width = (1 << half) - 1, (half + 7) // 8
    while True:
        left, right = x >> half, x & mask
        for r in reversed(range(pii_feistel.ROUNDS)):
            digest = blake2b(tweak + b"|" + bytes([r]) + b"|" + left.to_bytes(width, "big"), key=key[:64], digest_size=min(64, width + 8)).digest()
            left, right = right ^ (int.from_bytes(digest, "big") & mask), left
        x = left << half | right
        if x < size:
            return x


def test_pii_query_round_trip(spark, monkeypatch):
    """Every text of the query comes back when its result is permuted backwards."""
    from tessera.llm.queries import op4_pii_feistel
    sf = "/root/testdata/sf0.001"
    src = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = {r.doc_id: r for r in op4_pii_feistel(spark, sf).collect()}
    assert got.keys() == src.keys()
    changed = {i for i in src if src[i] != got[i].text}
    assert len(changed) > 5 and all((sum(got[i][k] for k in pii_feistel.KINDS) > 0) == (i in changed) for i in src)
    monkeypatch.setattr(pii_feistel, "permute", unpermute)
    for i in changed:
        assert pii_feistel.pseudonymise(got[i].text, pii_feistel.DEMO_KEY)[0] == src[i], i


def test_pipeline_pii_counts_the_new_characters(spark):
    from corpus_pipeline import pii
    src = [f"Host 1.2.3.{i} is up, नमस्ते" for i in range(8)] + ["no data", "", None]
    df = frame(spark, list(enumerate(src)))
    df = df.withColumn("n_chars", __import__("pyspark").sql.functions.length("text").cast("long"))
    got = pii(spark, df, "")
    assert got.columns == df.columns and got.schema["n_chars"].dataType == df.schema["n_chars"].dataType
    rows = got.collect()
    assert [r.n_chars for r in rows] == [None if r.text is None else len(r.text) for r in rows]
    assert any(r.n_chars != len(t) for r, t in zip(rows, src) if t)


def test_pii_table(spark, odd):
    df = frame(spark, [(d, t if t is None else t + " a.b7@x.org") for d, t in odd]).withColumn("pii", __import__("pyspark").sql.functions.lit(1))
    got = pii_feistel.pseudonymised(df, KEY)
    assert got.columns == ["doc_id", "lang", "source", "n_chars", "pii", "text", "pii_counts"]
    for r, (d, t) in zip(got.collect(), odd):
        assert r.doc_id == d and (r.text is None) == (t is None)
        assert t is None or (r.pii_counts.email == 1 and r.text.startswith(t) and r.text.endswith("@x.org") and "a.b7@" not in r.text)


# ---- 5 warc

def test_warc_round_trip(spark):
    from tessera.llm.common import shared_folder
    big, small = "<p>é" + "x" * 200, "tiny"
    rows = [(3, "http://a/%20b", big), (1, "http://a/\r\nX: y", big), (2, None, big), (7, "u", small), (8, "u", small), (None, "n", big), (9, "e", None), (10, "e", ""), (11, "crlf", "a\r\n\r\nb" * 60)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    folder = shared_folder(spark, "warc")
    warc_zstd.write_archives(df, folder)
    got = {(r.page_id, r.url): r for r in warc_zstd.read_archives(spark, folder, payloads=True).collect()}
    assert len(got) == len(rows)
    for page, url, html in rows:
        r, data = got[page, url], (html or "").encode()
        refers = 1 if page in (2, 3) else None
        assert (r.payload_bytes, r.payload_digest, r.refers_to) == (len(data), hashlib.sha256(data).hexdigest(), refers)
        assert r.record_type == ("revisit" if refers else "response") and (r.payload is None if refers else bytes(r.payload) == data)
    empty = shared_folder(spark, "warc")
    warc_zstd.write_archives(df.limit(0), empty)
    assert warc_zstd.read_archives(spark, empty).count() == 0


def archive(records, dictionary=b""):
    import struct
    import zstandard
    coder = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(dictionary)) if dictionary else zstandard.ZstdCompressor()
    sep = warc_zstd.SEPARATOR.encode()
    return sep.join([struct.pack("<II", warc_zstd.DICTIONARY_FRAME, len(dictionary)) + dictionary, *map(coder.compress, records)]) + sep


def test_warc_rejects_damage():
    record = warc_zstd.make_record(5, "u", b"hello", hashlib.sha256(b"hello").hexdigest(), None)
    good = archive([record, record], b"hello world, a dictionary of raw content")
    assert [r["payload"] for r in warc_zstd.read_archive(good)] == [b"hello"] * 2
    bad = [good[:-20], good[8:], good[:40], archive([record.replace(b"hello", b"hellx")]), archive([record.replace(b"WARC/1.1", b"WARC/9.9")]), archive([record[:-1]]),
           archive([record.replace(b"WARC-Date", b"X-Date")]), archive([record]) + b"garbage!"]
    for data in bad:
        with pytest.raises(Exception):
            list(warc_zstd.read_archive(data))


# ---- 6 decontamination

def test_masks_miss_nothing():
    assert decontaminate.lossless()
    assert not decontaminate.lossless(((0, 1, 2, 3, 4, 5),), 13, 2)


def brute_leaks(docs, items, window=decontaminate.WINDOW, subs=decontaminate.SUBSTITUTIONS):
    import regex
    tok = lambda t: regex.findall(r"[\p{L}\p{N}]+", (t or "").lower())
    out = {}
    for d, t in docs:
        w = tok(t)
        for i, s in items:
            v = tok(s)
            if not v:
                continue
            width = min(window, len(v))
            for shift in range(-len(v), len(w)):
                e = [0 <= p + shift < len(w) and w[p + shift] == v[p] for p in range(len(v))]
                best = max(sum(e[p:p + width]) for p in range(len(v) - width + 1))
                if best >= (len(v) if len(v) < window else window - subs):
                    a = out.get((d, i), (0, 0))
                    out[d, i] = (max(a[0], sum(e)), max(a[1], best))
    return {(d, i, *v) for (d, i), v in out.items()}


@pytest.mark.parametrize("broadcast_rows", [0, 10**6])
def test_leaks_equal_brute_force(spark, broadcast_rows):
    rng = random.Random(11)
    items = [(i, text(rng, n)) for i, n in enumerate([30, 13, 12, 9, 8, 25, 40])] + [(7, None), (8, ""), (0, None)]
    items += [(20, text(rng, 7)), (21, text(rng, 6)), (22, text(rng, 3)), (23, "w17"), (24, "unheard")]
    docs = [(1, None), (2, ""), (3, text(rng, 50)), (None, items[0][1])]
    for d in range(10, 60):
        words = items[rng.randrange(7)][1].split()
        for _ in range(rng.randint(0, 4)):
            words[rng.randrange(len(words))] = "changed"
        a = rng.randint(0, 8)
        docs.append((d, f"{text(rng, rng.randint(0, 9))} {'; '.join(words[a:]).upper()} {text(rng, rng.randint(0, 9))}"))
    docs += [docs[-1], (70, f"so {items[-5][1]} it"), (71, items[-4][1]), (72, items[-4][1][:-1]), (73, f"{items[-3][1]} w1")]
    got = decontaminate.contaminated(frame(spark, docs), frame(spark, items, "item_id long, text string, doc_id int"), broadcast_rows=broadcast_rows)
    assert {(r.doc_id, r.item_id, r.n_matched, r.n_window) for r in got.collect()} == brute_leaks(docs, items)
    left = decontaminate.drop_contaminated(frame(spark, docs), frame(spark, items, "item_id long, text string"))
    bad = {d for d, *_ in brute_leaks(docs, items)} - {None}
    assert sorted(str(r.doc_id) for r in left.collect()) == sorted(str(d) for d, _ in docs if d not in bad)


# ---- 7 simhash

def brute_fingerprint(t):
    words = (t or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(ids, near):
    label = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for a, b in near:
            m = min(label[a], label[b])
            changed |= label[a] != m or label[b] != m
            label[a] = label[b] = m
    return label


def test_simhash_equals_brute_force(spark, odd):
    rng = random.Random(2)
    rows = list(odd)
    for d in range(100, 220):
        words = text(random.Random(d % 7), 150).split()
        for _ in range(rng.randint(0, 3)):
            words[rng.randrange(150)] = rng.choice(WORDS)
        rows.append((d, " ".join(words)))
    fp = [brute_fingerprint(t) for _, t in rows]
    ids = sorted({d for d, _ in rows if d is not None})
    known = [(d, f) for (d, _), f in zip(rows, fp) if d is not None]
    near = [(a, b) for a, f in known for b, g in known if a < b and bin(f ^ g).count("1") <= 3]
    label = brute_components(ids, near)
    got = simhash.simhash_groups(frame(spark, rows)).collect()
    by_fp = {f: label[d] for d, f in known}
    assert order([(r.doc_id, r.fingerprint, r.component_id) for r in got]) == order([(d, f"{f:016x}", by_fp.get(f)) for (d, _), f in zip(rows, fp)])
    kept = sorted(str(r.doc_id) for r in simhash.drop_near_copies(frame(spark, rows)).collect())
    assert kept == sorted(str(d) for d, _ in rows if d is None or label[d] == d)


def test_links_by_segments(spark):
    rng = random.Random(9)
    centre = [rng.getrandbits(64) for _ in range(5)]
    fps = sorted({c ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4))) for c in centre for _ in range(40)})
    nodes = spark.createDataFrame([(i, f - (1 << 64) if f >> 63 else f) for i, f in enumerate(fps)], "id long, fp long")
    want = {(a, b) for b in range(len(fps)) for a in range(b) if bin(fps[a] ^ fps[b]).count("1") <= 3}
    for segments in (1, 2, 3, 4):
        if segments > 1:
            assert {tuple(r) for r in simhash.links(nodes, 3, segments).collect()} == want


def test_long_chain_is_one_component(spark):
    n = 300
    edges = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(1000, 1001), (1000, 1002)], "u long, v long")
    got = {r.node: r.component for r in simhash.components(edges).collect()}
    assert got == {i: 0 for i in range(n + 1)} | {1000: 1000, 1001: 1000, 1002: 1000}
    assert simhash.components(edges.limit(0)).count() == 0


# ---- 8 urls

def test_url_rules(spark):
    urls = ["http://a.com/x", "https://B.Example.COM/en/1?q=/a#b", "http://www.example.com/en/", "http://x.net/es/1", "http://x.net/de/1", "http://net/fr/1", "http://com", "ftp://u@h:80", "no scheme", "", None,
            "http://xcom/", "HTTP://é.ORG/Ä?x", "a://b://c/d", "http://h?x=/en/", "http://www.example.com/enx"]
    got = url_lm.filter_urls(spark.createDataFrame([(i, u, 0) for i, u in enumerate(urls)], "page_id long, url string, host int")).collect()
    assert [r.page_id for r in got] == list(range(len(urls)))
    want = [("a.com", "/x", "com/"), ("b.example.com", "/en/1", "example.com/en/"), ("www.example.com", "/en/", "www.example.com/en/"), ("x.net", "/es/1", "net/es/"), ("x.net", "/de/1", None), ("net", "/fr/1", "net/fr/"),
            ("com", "", None), ("u@h:80", "", None), ("", "", None), ("", "", None), ("", "", None), ("xcom", "/", None), ("é.org", "/Ä", None), ("b:", "//c/d", None), ("h", "", None), ("www.example.com", "/enx", "com/")]
    assert [(r.host, r.path, r.rule) for r in got] == want
    kinds = {r.name: r.verdict for r in url_lm.RULES}
    assert all(r.verdict == kinds[r.rule] if r.rule else r.verdict in ("allow", "block") for r in got)


def test_url_model_separates(spark):
    rng = random.Random(4)
    good = [f"http://news{rng.randint(1, 99)}.com/story/{rng.randint(1, 9999)}" for _ in range(300)]
    bad = [f"http://casino{rng.randint(1, 99)}.net/es/win-{rng.randint(1, 9999)}" for _ in range(300)]
    probe = [(10000 + i, u.replace(".com", ".org").replace(".net/es", ".org")) for i, u in enumerate(good[:100] + bad[:100])]
    got = {r.page_id: r.verdict for r in url_lm.filter_urls(spark.createDataFrame(list(enumerate(good + bad)) + probe, "page_id long, url string")).collect()}
    right = sum(got[10000 + i] == ("allow" if i < 100 else "block") for i in range(200))
    assert right >= 190


def test_url_model_takes_every_labelled_url(spark):
    """More labelled URLs than the 8,000 a class once fitted on: scores and cut are those of the models in memory over all."""
    rng = random.Random(8)
    good = [f"http://a{rng.randint(1, 9)}.com/s/{i}" for i in range(8300)]
    bad = [f"http://c{rng.randint(1, 9)}.net/es/{i:x}" for i in range(300)]
    rows = spark.createDataFrame(list(enumerate(good + bad)) + [(90000, "http://a1.org/s/7"), (90001, "http://c.org/es/ff"), (90002, None)], "page_id long, url string")
    got = {r.page_id: r for r in url_lm.filter_urls(rows).where("page_id >= 90000").collect()}
    halves = {}
    for v, urls in (("allow", good), ("block", bad)):
        ordered = [r.url for r in spark.createDataFrame([(u,) for u in urls], "url string").selectExpr("url", "xxhash64(url) h").orderBy("h", "url").collect()]
        halves[v] = ordered[::2], ordered[1::2]
    models = [url_lm.Markov(), url_lm.Markov()]
    for m, v in zip(models, ("allow", "block")):
        for u in halves[v][0]:
            m.add(u)
        m.finish()
    cut = url_lm.threshold(*[[url_lm.ratio(*models, u) for u in halves[v][1]] for v in ("allow", "block")])
    for i, u in ((90000, "http://a1.org/s/7"), (90001, "http://c.org/es/ff"), (90002, "")):
        want = url_lm.ratio(*models, u)
        assert got[i].score == pytest.approx(want, rel=1e-9) and got[i].verdict == ("allow" if want >= cut else "block")
    scored = [(url_lm.ratio(*models, u), v) for v in ("allow", "block") for u in halves[v][1]]
    assert url_lm.calibrate(spark.createDataFrame(scored, "score double, verdict string")) == pytest.approx(cut, rel=1e-9)


def test_url_cut_equals_the_threshold_in_memory(spark):
    rng = random.Random(2)
    cases = [([], []), ([1.0, 2.0], []), ([], [1.0, 3.0]), ([1.0, 2.0], [3.0, 4.0]), ([3.0], [1.0]), ([1.0, 1.0, 2.0], [1.0, 0.5]), ([rng.randint(0, 9) / 4 for _ in range(30)], [rng.randint(-4, 6) / 4 for _ in range(20)])]
    for a, b in cases:
        rows = spark.createDataFrame([(x, "allow") for x in a] + [(x, "block") for x in b], "score double, verdict string")
        assert url_lm.calibrate(rows) == pytest.approx(url_lm.threshold(a, b))


def test_markov_sums_to_one():
    m = url_lm.Markov(3)
    for u in ("abc", "abd", "xbc"):
        m.add(u)
    m.finish()
    seen = "abcdx\x03"
    for context in ("", "a", "ab", "zz", "\x02\x02a"):
        rest = m.probability(context, "q")
        assert sum(m.probability(context, c) for c in seen) + rest * (url_lm.ALPHABET - len(seen)) == pytest.approx(1.0)


# ---- 9 language model

def brute_scores(rows, backoff=lm_backoff.BACKOFF, least=lm_backoff.LEAST):
    import math
    from collections import Counter
    docs = [bytes((t or "").encode()).lower().split() for _, t in rows]
    c = Counter(tuple(w[i:i + k]) for w in docs for k in (1, 2, 3) for i in range(len(w) - k + 1))
    n = sum(map(len, docs))
    out = []
    for (d, _), w in zip(rows, docs):
        s = 0.0
        for i in range(len(w)):
            p, f = None, 1.0
            for k in range(min(3, i + 1), 1, -1):
                g = tuple(w[i - k + 1:i + 1])
                if c[g] >= least:
                    p = c[g] / c[g[:-1]]
                    break
                f *= backoff
            s += math.log(f * (p if p is not None else c[w[i],] / n))
        out.append((d, len(w), round(s, 4), round(s / len(w), 6) if w else None))
    return out


@pytest.mark.parametrize("chunk_bytes", [4000, 1 << 23])
def test_backoff_equals_brute_force(spark, odd, chunk_bytes):
    rows = [(d, t if d != 8 else t[:9000]) for d, t in odd]
    got = lm_backoff.backoff_scores(frame(spark, rows), chunk_bytes=chunk_bytes)
    assert order([(r.doc_id, r.n_words, round(r.score, 4), None if r.mean_score is None else round(r.mean_score, 6)) for r in got.collect()]) == order(brute_scores(rows))


def test_backoff_without_words(spark):
    got = lm_backoff.backoff_scores(frame(spark, [(1, None), (2, " ")])).collect()
    assert sorted((r.doc_id, r.n_words, r.score, r.mean_score) for r in got) == [(1, 0, 0.0, None), (2, 0, 0.0, None)]
    assert lm_backoff.backoff_scores(frame(spark, [(1, None)]).limit(0)).count() == 0


# ---- 10 packing

def test_packing_holds_every_id_once(spark, odd):
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(packing.tokenizer_path())
    rows = odd + [(30 + i, text(random.Random(i), 20 + 37 * i) + " It's <|endoftext|> 3rd\u00a0x e\u0301. (NO), «quoted», x<|startoftext|>y, a'', b'!! 'S. $$$ é!! ×, ÷. J\u030c, <|ENDOFTEXT|> end.") for i in range(40)]
    got = packing.pack(frame(spark, rows), group_pieces=20).collect()
    want = []
    for d, t in rows:
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 2]
        want += [(d, s, len(ids[s:s + 4096]), zlib.crc32(np.array(ids[s:s + 4096], "<u4").tobytes()), len(ids)) for s in range(0, len(ids), 4096)]
    assert order([tuple(r)[:5] for r in got]) == order(want)
    by = defaultdict(list)
    for r in got:
        by[r.sequence_id].append((r.offset, r.length))
    for pieces in by.values():
        at = 0
        for o, n in sorted(pieces):
            assert o == at
            at += n
        assert at <= 4096
    assert packing.pack(frame(spark, rows).limit(0)).count() == 0


def test_best_fit_decreasing_takes_the_tightest():
    rng = random.Random(6)
    lengths = sorted((rng.randint(1, 100) for _ in range(500)), reverse=True)
    seq, off = packing.best_fit_decreasing(lengths, 100)
    room = {}
    for n, s, o in zip(lengths, seq, off):
        fits = [r for r in room.values() if r >= n]
        assert (min(fits) if fits else 100) == room.get(s, 100) and o == 100 - room.get(s, 100)
        room[s] = room.get(s, 100) - n


# ---- pipeline

def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline
    clean = "The house of the man is on the hill, and it was sold to a woman from the town with the old mill by the river near here."
    rng = random.Random(8)
    item = text(rng, 30)
    docs = [(1, f"{clean} {text(rng, 60)} mail ana.b7@x.org"), (3, f"{clean} {text(rng, 60)} {item} end"), (4, "### $$$ " * 40), (5, None), (6, f"{clean} {text(rng, 90)}")]
    docs += [(2, docs[0][1])]
    frame(spark, docs).write.parquet(f"{tmp_path}/documents.parquet")
    frame(spark, [(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    df, ids = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        df = stage(spark, df, str(tmp_path))
        assert df.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        ids.append(sorted(r.doc_id for r in df.collect()))
    assert ids == [[1, 2, 3, 6], [1, 3, 6], [1, 6], [1, 6]]
    assert "ana.b7" not in df.filter("doc_id = 1").first().text
    assert {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == {1, 6}


def test_pipeline_stages_on_odd_tables(spark, odd, tmp_path):
    """Nulls in every column, repeated rows, clashing and awkward names, empty tables."""
    import corpus_pipeline
    clean = "The house of the man is on the hill, and it was sold to a woman from the town with the old mill by the river near here."
    rows = [(d, t) for d, t in odd] + [(None, clean), (50, clean + " one two three"), (50, clean + " one two three"), (51, clean.replace("hill", "roof") + " 1.2.3.4 said so")]
    names = ["pii_counts", "a.b", "row", "h", "quality_m", "component_id", "item_id", "doc_key"]
    from pyspark.sql import functions as F
    df = frame(spark, rows).withColumns({n: F.lit(k) for k, n in enumerate(names)}).withColumn("nil", F.lit(None).cast("int"))
    spark.createDataFrame([(None, clean[:30]), (2, None), (3, "unheard of here")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for name, stage in corpus_pipeline.STAGES:
        last = name == "packing"
        out, none = stage(spark, df, str(tmp_path)), stage(spark, df.limit(0), str(tmp_path))
        assert none.count() == 0 and (last or none.columns == df.columns)
        assert last or out.columns == df.columns
        assert out.count() >= 2
        if not last:
            assert {r["a.b"] for r in out.collect()} == {1}


def test_registered():
    import __spark_entry__ as E
    names = set(E.queries())
    assert {f"op{n}" for n in range(1, 14)} <= {x.split("_")[0] for x in names} and "pipeline" in names
    assert set(E.oracle_sql()) <= names
