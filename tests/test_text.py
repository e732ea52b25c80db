"""Cleaning, tokenizers and n-grams on literal frames (FIXTURES C3, C4)."""


from tessera.functions import text as T
from tessera.operators import vocab as V


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_clean_text_edge_cases(spark):
    data = [(1, None), (2, "राम। श्याम"), (3, "Wait… what--now"), (4, "a\\b"), (5, "the and of"), (6, "MiXeD CaSe")]
    df = spark.createDataFrame(data, "id int, text string")
    out = dict(rows(df.select("id", T.clean_text("text", stopwords=["the", "and", "of"]).alias("c"))))
    assert out[1] == ""                      # null -> ""
    assert out[2] == "राम श्याम"             # danda -> " |" -> bar removed by punctuation
    assert out[3] == "wait what now"         # ellipsis and dash runs collapse
    assert out[4] == "a b"                   # backslash is punctuation
    assert out[5] == ""                      # only stopwords
    assert out[6] == "mixed case"


def test_punctuation_modes(spark):
    df = spark.createDataFrame([("a,b.c",)], "t string")
    r = df.select(T.strip_punctuation("t", "space").alias("s"), T.strip_punctuation("t", "delete").alias("d"),
                  T.strip_punctuation("t", "none").alias("n")).first()
    assert (r.s, r.d, r.n) == ("a b c", "abc", "a,b.c")


def test_suffix_strip_longest_and_min_stem(spark):
    df = spark.createDataFrame([("walking ment cats",)], "t string")
    r = df.select(T.strip_suffixes("t", ["s", "ing", "ment"], min_stem=2).alias("s")).first().s
    assert r == "walk ment cat"   # "ment" keeps: stem would be empty


def test_tokenizers(spark):
    df = spark.createDataFrame([("Hello, world! a bb",)], "t string")
    r = df.select(T.tokenize_whitespace("t").alias("ws"), T.tokenize_words("t").alias("w"),
                  T.tokenize_default("t").alias("d"), T.tokens_no_punct("t").alias("np")).first()
    assert r.ws == ["Hello,", "world!", "a", "bb"]
    assert r.w == ["Hello", ",", "world", "!", "a", "bb"]
    assert r.d == ["hello", "world", "bb"]
    assert r.np == ["hello", "world", "a", "bb"]


def test_ngrams_short_exact_null(spark):
    df = spark.createDataFrame([(1, ["a"]), (2, ["a", "b"]), (3, None), (4, ["a", "b", "c"])], "id int, tokens array<string>")
    out = dict(rows(df.select("id", T.ngrams("tokens", 2).alias("g"))))
    assert out == {1: [], 2: ["a b"], 3: [], 4: ["a b", "b c"]}


def test_pad_and_mask(spark):
    df = spark.createDataFrame([(["x", "y"],)], "t array<string>")
    r = df.select(T.pad_truncate("t", 4).alias("p")).select("p", T.pad_mask("p").alias("m")).first()
    assert r.p == ["x", "y", "<pad>", "<pad>"] and r.m == [True, True, False, False]


def test_top_and_bottom_words_ties(spark):
    df = spark.createDataFrame([(0, ["b", "a", "c"]), (1, ["a", "b", "d"])], "doc_id int, tokens array<string>")
    top = rows(V.top_words(df, 3))
    assert top == [("b", 2), ("a", 2), ("c", 1)]      # ties by first appearance
    bottom = rows(V.bottom_words(df, 2))
    assert bottom == [("d", 1), ("c", 1)]             # least common, later-seen first


def test_clean_tokens_equals_split_of_clean_text(spark):
    df = spark.createDataFrame([(1, "The  walking\\ndogs, and cats!"), (2, None), (3, "a … b -- the")], "id int, text string")
    r = df.select(T.clean_tokens("text", ["the", "and"], ["s", "ing"]).alias("a"),
                  T.tokenize_whitespace(T.clean_text("text", ["the", "and"], ["s", "ing"])).alias("b")).collect()
    assert all(x.a == x.b for x in r)


def test_script_tokenizer_and_transliteration(spark):
    df = spark.createDataFrame([("नमस्ते world, राम।",)], "t string")
    # the danda is inside the Devanagari block, so it stays attached (as with the block regex)
    assert df.select(T.tokenize_script("t").alias("s")).first().s == ["नमस्ते", "राम।"]
    tr = spark.createDataFrame([("Größe café",)], "t string")
    out = tr.select(T.transliterate("t", {"ö": "o", "é": "e"}, {"ß": "ss"}).alias("x")).first().x
    assert out == "Grosse cafe"


def test_whitespace_is_pythons(spark):
    from tessera.functions.text import concat_key, tokenize_whitespace
    text = "a b c d\x1ce　f​g \x85h"
    df = spark.createDataFrame([(text, "A", None), (None, None, 1)], "t string, s string, p int")
    rows = df.select(tokenize_whitespace("t").alias("w"), concat_key(["s", "p"]).alias("k")).collect()
    assert rows[0].w == text.split() and [r.k for r in rows] == ["A_nan", "nan_1"]


def test_original_texts_are_read_beside_the_odd_ones(spark, tmp_path):
    from tessera.plans import source_queries as S
    from tessera.plans import text_queries as Q
    docs = [(i, f"Real text number{i} here.", "en", "web", 20) for i in range(22)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    d = str(tmp_path)
    odd = {r.doc_id: r.clean_chars for r in Q.clean_text(spark, d).collect()}
    assert sorted(i for i in odd if not odd[i]) == [4, 5, 15, 16]
    assert len({r.clean_md5 for r in Q.clean_text_original(spark, d).collect()}) == 22
    assert all(r.n_ws == 4 for r in Q.tokenizers_original(spark, d).collect())
    steps = Q.cleaning_steps_original(spark, d).collect()
    assert len(steps) == 22 and len({r.lower_md5 for r in steps}) == 22
    assert {r.key for r in Q.concat_key_original(spark, d).collect()} == {"en_0", "en_1"}
    import hashlib
    csv = {r.doc_id: r.text_md5 for r in S.read_corpus_csv_original(spark, d).collect()}
    assert csv == {i: hashlib.md5(t.encode()).hexdigest() for i, t, *_ in docs}
