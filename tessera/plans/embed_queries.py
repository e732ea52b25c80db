"""Registered queries: word-vector lookups and document pooling.

Word vectors: the cleaned corpus vocabulary ranked by frequency (ties by term) takes the
``embeddings`` row whose vec_id equals the rank, so the most frequent words have vectors
and the rest of the vocabulary is out-of-vocabulary. A second table ranks alphabetically
(the "pretrained" side of the merge).
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import embed as EM
from tessera.operators import tfidf as TF
from tessera.operators.indexing import dense_index, materialize
from tessera.operators.vocab import word_counts
from tessera.plans.params import DIGITS
from tessera.plans.registry import query
from tessera.plans.tfidf_queries import CLEAN_TOKENS_SQL, TFIDF_SQL, clean_tokens, tokens_once
from tessera.session import scratch_path
from tessera.sources.tables import table


def counts_once(spark, sf_dir, docs=None):
    """Word counts written once: ranking them reads them twice (range sampling, then the sort), and
    each reading would clean the corpus again."""
    return materialize(word_counts(clean_tokens(spark, sf_dir) if docs is None else docs))


def word_vectors(spark, sf_dir, order: str = "frequency", docs=None, counts=None):
    """``docs``: the corpus's tokens, ``counts``: its word counts, if the query has them already."""
    wc = counts_once(spark, sf_dir, docs) if counts is None else counts
    keys = [F.col("count").desc(), F.col("term")] if order == "frequency" else [F.col("term")]
    ranked = dense_index(wc, keys, "rank")
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return ranked.join(e, ranked["rank"] == e["vec_id"]).select(F.col("term").alias("word"), F.col("embedding").alias("vector"))


_WV_SQL = f"""{CLEAN_TOKENS_SQL},
wc AS (SELECT term, count(*) AS count FROM (SELECT unnest(tokens) AS term FROM docs) GROUP BY term),
wv AS (SELECT w.term AS word, e.embedding AS vector FROM
       (SELECT term, row_number() OVER (ORDER BY count DESC, term) - 1 AS rk FROM wc) w JOIN embeddings e ON e.vec_id = w.rk),
pv AS (SELECT w.term AS word, e.embedding AS vector FROM
       (SELECT term, row_number() OVER (ORDER BY term) - 1 AS rk FROM wc) w JOIN embeddings e ON e.vec_id = w.rk)"""


def _vsum(c="embedding"):
    return F.round(F.aggregate(F.col(c).cast("array<double>"), F.lit(0.0), lambda a, x: a + x), DIGITS)


_POOL_TAIL = """dims AS (SELECT doc_id, unnest(range(len(vector))) AS i, unnest(vector) AS x, w FROM ov),
mp AS (SELECT doc_id, i, sum(CAST(x AS DOUBLE) * w) / sum(w) AS m FROM dims GROUP BY doc_id, i),
pooled AS (SELECT doc_id, sum(m) AS vsum, max(CASE WHEN i = 0 THEN m END) AS v0 FROM mp GROUP BY doc_id)"""


@query("lookup_vectors", sql=f"""WITH {_WV_SQL},
occ AS (SELECT doc_id, unnest(tokens) AS word FROM docs)
SELECT o.doc_id, count(*) AS n_in_vocab FROM occ o JOIN wv USING (word) GROUP BY o.doc_id""")
def lookup_vectors(spark, sf_dir):
    """Token -> vector lookup; in-vocabulary occurrences per document."""
    docs = tokens_once(spark, sf_dir)
    lv = EM.lookup_vectors(docs, word_vectors(spark, sf_dir, docs=docs))
    return lv.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_in_vocab"))


@query("mean_pool", sql=f"""WITH {_WV_SQL},
ov AS (SELECT o.doc_id, w.vector, 1.0 AS w FROM (SELECT doc_id, unnest(tokens) AS word FROM docs) o JOIN wv w USING (word)),
{_POOL_TAIL}
SELECT d.doc_id, round(coalesce(vsum, 0.0), {DIGITS}) AS vsum, round(coalesce(v0, 0.0), {DIGITS}) AS v0
FROM docs d LEFT JOIN pooled USING (doc_id)""")
def mean_pool(spark, sf_dir):
    """E5: mean of in-vocabulary token vectors per document (zeros if none)."""
    docs = tokens_once(spark, sf_dir)
    p = EM.mean_pool(docs, word_vectors(spark, sf_dir, docs=docs), dim=64)
    return p.select("doc_id", _vsum().alias("vsum"), F.round(F.col("embedding")[0], DIGITS).alias("v0"))


@query("tfidf_weighted_pool", sql=f"""WITH {_WV_SQL}, {TFIDF_SQL},
ov AS (SELECT o.doc_id, w.vector, t.tfidf AS w FROM (SELECT doc_id, unnest(tokens) AS word FROM docs) o
       JOIN wv w USING (word) JOIN tfidf t ON t.doc_id = o.doc_id AND t.term = o.word WHERE t.tfidf > 0),
{_POOL_TAIL}
SELECT d.doc_id, round(coalesce(vsum, 0.0), {DIGITS}) AS vsum, round(coalesce(v0, 0.0), {DIGITS}) AS v0
FROM docs d LEFT JOIN pooled USING (doc_id)""")
def tfidf_weighted_pool(spark, sf_dir):
    """J5 + E6: tf-idf-weighted mean of token vectors."""
    docs = tokens_once(spark, sf_dir)
    tfidf = TF.tfidf_transform(docs, TF.tfidf_fit(docs, with_index=False))
    p = EM.tfidf_weighted_pool(docs, word_vectors(spark, sf_dir, docs=docs), tfidf, dim=64)
    return p.select("doc_id", _vsum().alias("vsum"), F.round(F.col("embedding")[0], DIGITS).alias("v0"))


_POS_SQL = """pos AS (SELECT doc_id, unnest(padded) AS word, unnest(range(100)) AS pos FROM
   (SELECT doc_id, list_concat(tokens, list_transform(range(100), lambda i: '<pad>'))[1:100] AS padded FROM docs))"""


@query("masked_mean_pool", sql=f"""WITH {_WV_SQL}, {_POS_SQL},
ov AS (SELECT p.doc_id, coalesce(w.vector, list_transform(range(64), lambda i: CAST(0.0 AS FLOAT))) AS vector, 1.0 AS w
       FROM pos p LEFT JOIN wv w USING (word) WHERE p.word <> '<pad>'),
{_POOL_TAIL}
SELECT d.doc_id, round(vsum, {DIGITS}) AS vsum FROM docs d LEFT JOIN pooled USING (doc_id)""")
def masked_mean_pool(spark, sf_dir):
    """Mean over unmasked positions of the 100-padded sequence (OOV = zeros; all padding -> null)."""
    docs = tokens_once(spark, sf_dir)
    p = EM.masked_mean_pool(docs, word_vectors(spark, sf_dir, docs=docs), max_len=100, dim=64)
    return p.select("doc_id", _vsum().alias("vsum"))


@query("sequence_embed", sql=f"""WITH {_WV_SQL}, {_POS_SQL},
v AS (SELECT p.doc_id, p.pos, p.word <> '<pad>' AS mask,
             list_sum(list_transform(coalesce(w.vector, list_transform(range(64), lambda i: CAST(0.0 AS FLOAT))),
                      lambda x: CAST(x AS DOUBLE))) AS s
      FROM pos p LEFT JOIN wv w USING (word))
SELECT doc_id, CAST(count(*) AS INTEGER) AS n_positions, CAST(count_if(mask) AS INTEGER) AS n_unmasked,
       round(sum(s), {DIGITS}) AS vsum, round(arg_min(s, pos), {DIGITS}) AS first_sum FROM v GROUP BY doc_id""")
def sequence_embed(spark, sf_dir):
    """Padded sequences of vectors + mask (max_len 100, pad vector zeros)."""
    docs = tokens_once(spark, sf_dir)
    s = EM.sequence_embed(docs, word_vectors(spark, sf_dir, docs=docs), max_len=100, dim=64)
    sums = F.transform("sequence", lambda v: F.aggregate(v.cast("array<double>"), F.lit(0.0), lambda a, x: a + x))
    return s.select("doc_id", F.size("sequence").alias("n_positions"), F.size(F.filter("mask", lambda m: m)).alias("n_unmasked"),
                    F.round(F.aggregate(sums, F.lit(0.0), lambda a, x: a + x), DIGITS).alias("vsum"),
                    F.round(sums[0], DIGITS).alias("first_sum"))


@query("add_pad_vector", sql=f"""WITH {_WV_SQL}
SELECT word, round(list_sum(list_transform(vector, lambda x: CAST(x AS DOUBLE))), {DIGITS}) AS vsum FROM wv
UNION ALL SELECT '<pad>', 0.0""")
def add_pad_vector(spark, sf_dir):
    """The vector table plus a zero vector for '<pad>'."""
    return EM.add_pad_vector(word_vectors(spark, sf_dir), dim=64).select("word", _vsum("vector").alias("vsum"))


_NGRAMS = ("flatten(list_transform(range(3, 7), lambda k: CASE WHEN length('<' || {w} || '>') >= k THEN "
           "list_transform(range(1, length('<' || {w} || '>') - k + 2), lambda i: substr('<' || {w} || '>', i, k)) "
           "ELSE []::VARCHAR[] END))")


@query("subword_vectors", sql=f"""WITH {_WV_SQL},
g AS (SELECT DISTINCT word, unnest({_NGRAMS.format(w='word')}) AS ngram FROM wv),
gv AS (SELECT g.ngram, w.vector FROM g JOIN wv w USING (word)),
sub AS (SELECT ngram, i, avg(CAST(x AS DOUBLE)) AS m FROM (SELECT ngram, unnest(range(len(vector))) AS i, unnest(vector) AS x FROM gv) GROUP BY ngram, i),
unk AS (SELECT term AS word FROM wc WHERE term NOT IN (SELECT word FROM wv)),
ug AS (SELECT word, unnest({_NGRAMS.format(w='word')}) AS ngram FROM unk),
hit AS (SELECT ug.word, sub.i, sub.m FROM ug JOIN sub USING (ngram)),
nn AS (SELECT word, count(*) // 64 AS n_ngrams FROM hit GROUP BY word),
wvec AS (SELECT word, i, avg(m) AS m FROM hit GROUP BY word, i),
res AS (SELECT word, sum(m) AS vsum FROM wvec GROUP BY word)
SELECT word, CAST(0 AS BIGINT) AS n_ngrams, round(list_sum(list_transform(vector, lambda x: CAST(x AS DOUBLE))), {DIGITS}) AS vsum FROM wv
UNION ALL
SELECT u.word, CAST(coalesce(nn.n_ngrams, 0) AS BIGINT), round(res.vsum, {DIGITS}) FROM unk u LEFT JOIN nn USING (word) LEFT JOIN res USING (word)""")
def subword_vectors(spark, sf_dir):
    """Character 3-6-gram vectors give every corpus word a vector (known words keep theirs)."""
    docs = tokens_once(spark, sf_dir)
    words = word_counts(docs).select(F.col("term").alias("word"))
    s = EM.subword_vectors(words, word_vectors(spark, sf_dir, docs=docs), 3, 6)
    return s.select("word", "n_ngrams", _vsum("vector").alias("vsum"))


@query("explode_to_columns", sql="SELECT vec_id, " + ", ".join(f"embedding[{i + 1}] AS f{i}" for i in range(64))
       + ", label FROM embeddings")
def explode_to_columns(spark, sf_dir):
    """Vector -> 64 columns with the target last."""
    e = table(spark, sf_dir, "embeddings")
    return EM.explode_to_columns(e, "embedding", 64, "label")


@query("assemble_columns", sql="""SELECT vec_id, label, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))), 6) AS vsum
FROM embeddings""")
def assemble_columns(spark, sf_dir):
    """E9 inverse: 64 columns assembled back into one vector."""
    wide = EM.explode_to_columns(table(spark, sf_dir, "embeddings"), "embedding", 64, "label")
    a = EM.assemble(wide, [f"f{i}" for i in range(64)])
    return a.select("vec_id", "label", _vsum("features").alias("vsum"))


_COS = ("list_sum(list_transform(range(1, len({a}) + 1), lambda i: CAST({a}[i] AS DOUBLE) * CAST({b}[i] AS DOUBLE))) / "
        "(sqrt(list_sum(list_transform({a}, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))) * "
        "sqrt(list_sum(list_transform({b}, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))))")


@query("most_similar", sql=f"""WITH {_WV_SQL},
top AS (SELECT term AS word FROM wc ORDER BY count DESC, term LIMIT 1),
q AS (SELECT wv.vector AS qv, wv.word AS qw FROM wv JOIN top USING (word))
SELECT word, round({_COS.format(a='vector', b='qv')}, {DIGITS}) AS similarity FROM wv, q WHERE word <> qw
ORDER BY {_COS.format(a='vector', b='qv')} DESC, word LIMIT 10""")
def most_similar(spark, sf_dir):
    """The 10 words closest (cosine) to the corpus's most frequent word."""
    wc = counts_once(spark, sf_dir)
    wv = word_vectors(spark, sf_dir, counts=wc)
    top = wc.orderBy(F.col("count").desc(), "term").first()["term"]
    m = EM.most_similar(wv, top, 10)
    return m.select("word", F.round("similarity", DIGITS).alias("similarity"))


@query("word_similarity", sql=f"""WITH {_WV_SQL},
r AS (SELECT w.word, w.vector, row_number() OVER (ORDER BY c.count DESC, c.term) AS rk FROM wv w JOIN wc c ON c.term = w.word)
SELECT a.word AS word, b.word AS next_word, round({_COS.format(a='a.vector', b='b.vector')}, {DIGITS}) AS similarity
FROM r a JOIN r b ON b.rk = a.rk + 1""")
def word_similarity(spark, sf_dir):
    """Cosine similarity of each word with the next word in frequency order."""
    wc = counts_once(spark, sf_dir)
    r = dense_index(word_vectors(spark, sf_dir, counts=wc).join(wc.withColumnRenamed("term", "word"), "word"),
                    [F.col("count").desc(), F.col("word")], "rk")
    a = r.select("word", "vector", "rk")
    b = r.select(F.col("word").alias("next_word"), F.col("vector").alias("v2"), (F.col("rk") - 1).alias("rk"))
    j = a.join(b, "rk")
    return j.select("word", "next_word", F.round(EM.similarity("vector", "v2"), DIGITS).alias("similarity"))


@query("merge_pretrained", sql=f"""WITH {_WV_SQL}
SELECT coalesce(p.word, s.word) AS word, CASE WHEN p.word IS NOT NULL THEN 'pretrained' ELSE 'scratch' END AS source,
       round(list_sum(list_transform(coalesce(p.vector, s.vector), lambda x: CAST(x AS DOUBLE))), {DIGITS}) AS vsum
FROM wv s FULL OUTER JOIN pv p ON s.word = p.word""")
def merge_pretrained(spark, sf_dir):
    """Frequency-ranked vectors merged with alphabetically-ranked 'pretrained' ones."""
    wc = counts_once(spark, sf_dir)
    m = EM.merge_pretrained(word_vectors(spark, sf_dir, counts=wc), word_vectors(spark, sf_dir, "alphabetical", counts=wc))
    return m.select("word", "source", _vsum("vector").alias("vsum"))


@query("vocab_coverage", sql=f"""WITH {_WV_SQL},
j AS (SELECT c.term, c.count, w.word IS NOT NULL AS has FROM wc c LEFT JOIN wv w ON w.word = c.term)
SELECT CAST(sum(count) AS BIGINT) AS n_tokens, CAST(sum(CASE WHEN has THEN count ELSE 0 END) AS BIGINT) AS n_covered,
       count(*) AS n_words, CAST(count_if(NOT has) AS BIGINT) AS n_missing_words, round(sum(CASE WHEN has THEN count ELSE 0 END) / sum(count), {DIGITS}) AS token_share FROM j""")
def vocab_coverage(spark, sf_dir):
    """Token and word coverage of the vector table."""
    docs = tokens_once(spark, sf_dir)
    c = EM.vocab_coverage(docs, word_vectors(spark, sf_dir, docs=docs))
    return c.select("n_tokens", "n_covered", "n_words", "n_missing_words", F.round("token_share", DIGITS).alias("token_share"))


@query("build_embeddings", sql=f"""WITH {_WV_SQL},
ov AS (SELECT o.doc_id, w.vector, 1.0 AS w FROM (SELECT doc_id, unnest(tokens) AS word FROM docs) o JOIN wv w USING (word)),
{_POOL_TAIL}
SELECT d.doc_id, round(coalesce(vsum, 0.0), {DIGITS}) AS vsum FROM docs d LEFT JOIN pooled USING (doc_id)""")
def build_embeddings(spark, sf_dir):
    """Corpus -> pooled document vectors written to Parquet and read back."""
    docs = tokens_once(spark, sf_dir)
    path = EM.build_embeddings(docs, word_vectors(spark, sf_dir, docs=docs), scratch_path(spark, "doc_vectors"))
    return spark.read.parquet(path).select("doc_id", _vsum().alias("vsum"))
