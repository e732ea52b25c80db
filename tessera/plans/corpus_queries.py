"""Registered queries: projection / filters / profiling, labels, joins, de-duplication and
conflicts, aggregates (P1-P10, L1-L6, J1-J3, J6, D1-D9, A1-A8, A11)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import aggregates as A
from tessera.operators import dedup as D
from tessera.operators import labels as L
from tessera.operators import profile as P
from tessera.plans.params import DIGITS, SEED
from tessera.plans.registry import query
from tessera.sources.tables import (ANNOTATED_SQL, IMBALANCED_SQL, LABELLED_SQL, RATERS_SQL, annotated,
                                    imbalanced, labelled, raters, second_corpus, table)

# drop rules of the conflict resolution, re-keyed from sentiment names to languages:
# (sentiment, polarity) pairs removed inside conflict groups
DROP_RULES = (("en", 1), ("fr", 0), ("de", 1), ("es", 0))
RULES_SQL = "(VALUES ('en', 1), ('fr', 0), ('de', 1), ('es', 0)) AS r(sentiment, polarity)"
# cross-class passes over the 8 (language, polarity) codes: (sets, codes dropped)
CROSS_PASSES = (([{0, 1}, {2, 3}], [0, 2]), ([{4, 5}, {6, 7}], [5, 7]))
TARGET_NAMES_4 = {"0_0": "LOW_SAFE", "0_1": "LOW_TOXIC", "1_0": "HIGH_SAFE", "1_1": "HIGH_TOXIC"}
TARGET_CODES_4 = {"0_0": 0, "0_1": 1, "1_0": 2, "1_1": 3}


def _case(expr: str, mapping: dict, default: str = "NULL") -> str:
    def lit(v):
        return f"'{v}'" if isinstance(v, str) else str(v)
    whens = " ".join(f"WHEN {expr} = {lit(k)} THEN {lit(v)}" for k, v in mapping.items())
    return f"CASE {whens} ELSE {default} END"


# ---------------------------------------------------------------- P1-P10
@query("select_rename_range", sql="SELECT doc_id, text, lang AS sentiment, source FROM documents")
def select_rename_range(spark, sf_dir):
    d = P.rename_columns(table(spark, sf_dir, "documents"), {"lang": "sentiment"})
    return d.select("doc_id", *P.column_range(d, "text", "source").columns)


@query("move_last", sql="SELECT doc_id, toxic, quality FROM labels")
def move_last(spark, sf_dir):
    return P.move_last(table(spark, sf_dir, "labels"), "quality")


@query("drop_class", sql=f"""WITH {ANNOTATED_SQL}
SELECT doc_id, sentiment, polarity FROM annotated WHERE sentiment IS DISTINCT FROM 'en'""")
def drop_class(spark, sf_dir):
    return P.drop_class(annotated(spark, sf_dir), "sentiment", "en").select("doc_id", "sentiment", "polarity")


@query("filter_isin_range", sql="""SELECT doc_id, lang, n_chars FROM documents
WHERE lang IN ('de', 'fr') AND n_chars > 80""")
def filter_isin_range(spark, sf_dir):
    d = P.filter_isin(table(spark, sf_dir, "documents"), "lang", ["de", "fr"])
    return P.filter_greater(d, "n_chars", 80).select("doc_id", "lang", "n_chars")


@query("filter_rules", sql=f"""WITH {ANNOTATED_SQL}
SELECT a.doc_id, a.sentiment, a.polarity FROM annotated a
WHERE EXISTS (SELECT 1 FROM {RULES_SQL} WHERE r.sentiment = a.sentiment AND r.polarity = a.polarity)""")
def filter_rules(spark, sf_dir):
    return P.filter_disjunction_rules(annotated(spark, sf_dir), DROP_RULES).select("doc_id", "sentiment", "polarity")


@query("null_count", sql="SELECT lang, CAST(count_if(text IS NULL) AS BIGINT) AS n_null FROM documents GROUP BY lang")
def null_count(spark, sf_dir):
    return P.null_count(table(spark, sf_dir, "documents"), "text", "lang")


_PROFILE_COLS = [("doc_id", "bigint"), ("text", "string"), ("lang", "string"), ("source", "string"),
                 ("n_chars", "bigint")]


@query("profile", sql=" UNION ALL ".join(
    f"SELECT '{c}' AS column_name, '{t}' AS dtype, count({c}) AS non_null, count(*) AS n_rows FROM documents"
    for c, t in _PROFILE_COLS))
def profile(spark, sf_dir):
    return P.profile(table(spark, sf_dir, "documents"))


@query("sample_distinct", sql=f"""WITH {LABELLED_SQL}
SELECT doc_id, target, {_case('target', TARGET_NAMES_4)} AS target_name FROM labelled
ORDER BY md5('{SEED}:' || CAST(doc_id AS VARCHAR)), doc_id LIMIT 25""")
def sample_distinct(spark, sf_dir):
    lab = labelled(spark, sf_dir)
    P.assert_sample_size(lab, 25)  # n <= rows, as the reference asserts
    s = P.sample_distinct(lab, 25, SEED, "doc_id")
    return L.label_names(s, "target", TARGET_NAMES_4, "target_name").select("doc_id", "target", "target_name")


@query("head", sql="SELECT doc_id, lang, n_chars FROM documents ORDER BY doc_id LIMIT 10")
def head(spark, sf_dir):
    return P.head(table(spark, sf_dir, "documents"), 10, "doc_id").select("doc_id", "lang", "n_chars")


@query("validate_columns", sql="SELECT doc_id, quality, toxic FROM labels")
def validate_columns(spark, sf_dir):
    return P.validate_columns(table(spark, sf_dir, "labels"), ["doc_id", "quality", "toxic"])


# ---------------------------------------------------------------- L1-L6
_CODES_SQL = f"""{ANNOTATED_SQL},
keyed AS (SELECT doc_id, sentiment || '_' || CAST(polarity AS VARCHAR) AS class_name FROM annotated),
classes AS (SELECT class_name, CAST(row_number() OVER (ORDER BY class_name) - 1 AS BIGINT) AS code
            FROM (SELECT DISTINCT class_name FROM keyed))"""


@query("create_target", sql=f"""WITH {_CODES_SQL}
SELECT k.doc_id, c.code AS Target FROM keyed k JOIN classes c USING (class_name)""")
def create_target(spark, sf_dir):
    out, _ = L.create_target(annotated(spark, sf_dir).drop("text"), "sentiment", "polarity")
    return out.select("doc_id", "Target")


@query("class_mapping", sql=f"""WITH {_CODES_SQL}
SELECT class_name, CAST(code AS INTEGER) AS code FROM classes""")
def class_mapping(spark, sf_dir):
    _, classes = L.create_target(annotated(spark, sf_dir).drop("text"), "sentiment", "polarity")
    return classes


@query("decode_target", sql=f"""SELECT vec_id, label,
  {_case('label', L.SENTIMENT_OF_TARGET)} AS sentiment,
  CAST(CASE WHEN label IN (0, 2, 4) THEN 0 ELSE 1 END AS INTEGER) AS polarity
FROM embeddings""")
def decode_target(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label")
    return L.decode_target(e, "label")


@query("collapse_labels", sql=f"""SELECT vec_id, label,
  CAST({_case('label', L.COLLAPSE_3)} AS INTEGER) AS target3,
  CAST({_case('label', L.COLLAPSE_4, 'label')} AS INTEGER) AS target4
FROM embeddings""")
def collapse_labels(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label")
    e = L.collapse_labels(e, "label", L.COLLAPSE_3, "null", out="target3")
    return L.collapse_labels(e, "label", L.COLLAPSE_4, "passthrough", out="target4")


@query("map_string_labels", sql=f"""WITH {LABELLED_SQL}
SELECT doc_id, CAST({_case('target', TARGET_CODES_4)} AS INTEGER) AS target FROM labelled""")
def map_string_labels(spark, sf_dir):
    return L.map_string_labels(labelled(spark, sf_dir).select("doc_id", "target"), ["target"], TARGET_CODES_4)


@query("label_names", sql=f"""WITH {IMBALANCED_SQL}
SELECT vec_id, label, {_case('label', L.COLLAPSE_4_NAMES)} AS label_name FROM imbalanced""")
def label_names(spark, sf_dir):
    return L.label_names(imbalanced(spark, sf_dir).select("vec_id", "label"), "label", L.COLLAPSE_4_NAMES)


# ---------------------------------------------------------------- J1-J3, D1-D9
_CONFLICTS_SQL = f"""{ANNOTATED_SQL},
conflicts AS (SELECT text, sentiment FROM annotated WHERE text IS NOT NULL AND sentiment IS NOT NULL
              GROUP BY text, sentiment
              HAVING count_if(polarity = 0) > 0 AND count_if(polarity = 1) > 0
                 AND count_if(polarity IS NULL OR polarity NOT IN (0, 1)) = 0)"""


@query("duplicates_full", sql=f"""WITH {_CONFLICTS_SQL}
SELECT a.doc_id, a.sentiment, a.polarity FROM annotated a JOIN conflicts d ON a.text = d.text AND a.sentiment = d.sentiment""")
def duplicates_full(spark, sf_dir):
    """Detail rows of the polarity-conflict groups."""
    a = annotated(spark, sf_dir)
    return D.duplicates_full(a, D.find_polarity_conflicts(a)).select("doc_id", "sentiment", "polarity")


@query("repeated_groups", sql=f"""WITH {ANNOTATED_SQL},
dup AS (SELECT text, sentiment FROM annotated GROUP BY text, sentiment HAVING count(*) > 1)
SELECT a.doc_id, a.sentiment, a.polarity FROM annotated a JOIN dup d ON a.text = d.text AND a.sentiment = d.sentiment""")
def repeated_groups(spark, sf_dir):
    """J1 without a group table: detail rows of every (text, sentiment) occurring twice or more."""
    return D.duplicates_full(annotated(spark, sf_dir)).select("doc_id", "sentiment", "polarity")


@query("members_of", sql=f"""WITH {_CONFLICTS_SQL}
SELECT a.doc_id FROM annotated a WHERE EXISTS
  (SELECT 1 FROM conflicts c WHERE c.text = a.text AND c.sentiment = a.sentiment)""")
def members_of(spark, sf_dir):
    a = annotated(spark, sf_dir)
    return D.members_of(a, D.find_polarity_conflicts(a), ["text", "sentiment"]).select("doc_id")


@query("remove_rows", sql=f"""WITH {_CONFLICTS_SQL},
doomed AS (SELECT DISTINCT a.text, a.sentiment, a.polarity FROM annotated a
           JOIN conflicts c ON a.text = c.text AND a.sentiment = c.sentiment
           WHERE (a.sentiment, a.polarity) IN (SELECT (sentiment, polarity) FROM {RULES_SQL}))
SELECT a.doc_id FROM annotated a WHERE NOT EXISTS
  (SELECT 1 FROM doomed d WHERE d.text = a.text AND d.sentiment = a.sentiment AND d.polarity = a.polarity)""")
def remove_rows(spark, sf_dir):
    a = annotated(spark, sf_dir)
    in_conflict = D.members_of(a, D.find_polarity_conflicts(a), ["text", "sentiment"])
    doomed = P.filter_disjunction_rules(in_conflict, DROP_RULES)
    return D.remove_rows(a, doomed, ["text", "sentiment", "polarity"]).select("doc_id")


@query("polarity_conflicts", sql=f"""WITH {_CONFLICTS_SQL}
SELECT md5(text) AS text_md5, sentiment FROM conflicts""")
def polarity_conflicts(spark, sf_dir):
    c = D.find_polarity_conflicts(annotated(spark, sf_dir))
    return c.select(F.md5("text").alias("text_md5"), "sentiment")


_RESOLVED_SQL = f"""{_CONFLICTS_SQL},
resolved AS (SELECT a.* FROM annotated a LEFT JOIN conflicts c ON a.text = c.text AND a.sentiment = c.sentiment
             WHERE NOT (c.text IS NOT NULL AND
                        (a.sentiment, a.polarity) IN (SELECT (sentiment, polarity) FROM {RULES_SQL})))"""


@query("resolve_polarity_conflicts", sql=f"""WITH {_RESOLVED_SQL}
SELECT doc_id, sentiment, polarity FROM resolved""")
def resolve_polarity_conflicts(spark, sf_dir):
    return D.resolve_polarity_conflicts(annotated(spark, sf_dir), DROP_RULES).select("doc_id", "sentiment", "polarity")


@query("dedup_keep_first", sql=f"""WITH {ANNOTATED_SQL}
SELECT doc_id, sentiment, polarity FROM annotated
QUALIFY row_number() OVER (PARTITION BY text, sentiment ORDER BY doc_id) = 1""")
def dedup_keep_first(spark, sf_dir):
    return D.dedup_keep_first(annotated(spark, sf_dir)).select("doc_id", "sentiment", "polarity")


@query("clean_labels_chain", sql=f"""WITH {_RESOLVED_SQL}
SELECT doc_id, sentiment, polarity FROM resolved
QUALIFY row_number() OVER (PARTITION BY text, sentiment ORDER BY doc_id) = 1""")
def clean_labels_chain(spark, sf_dir):
    """Quirk Q2 read as intended: conflict resolution, then keep-first de-duplication."""
    r = D.resolve_polarity_conflicts(annotated(spark, sf_dir), DROP_RULES)
    return D.dedup_keep_first(r).select("doc_id", "sentiment", "polarity")


def _coded(spark, sf_dir):
    out, _ = L.create_target(annotated(spark, sf_dir), "sentiment", "polarity", target="target")
    return out.select("doc_id", "text", F.col("target").cast("int").alias("target"))


_CODED_SQL = f"""{_CODES_SQL},
coded AS (SELECT a.doc_id, a.text, CAST(c.code AS INTEGER) AS target FROM annotated a
          JOIN classes c ON a.sentiment || '_' || CAST(a.polarity AS VARCHAR) = c.class_name)"""


def _sets_sql(sets):
    return "(" + ", ".join("[" + ", ".join(str(v) for v in sorted(s)) + "]" for s in sets) + ")"


@query("cross_class_conflicts", sql=f"""WITH {_CODED_SQL}
SELECT md5(text) AS text_md5, array_to_string(label_set, ',') AS label_set FROM
 (SELECT text, list_sort(list_distinct(list(target))) AS label_set FROM coded WHERE text IS NOT NULL
  GROUP BY text HAVING count_if(target IS NULL) = 0)
WHERE label_set IN {_sets_sql(CROSS_PASSES[0][0] + CROSS_PASSES[1][0])}""")
def cross_class_conflicts(spark, sf_dir):
    sets = CROSS_PASSES[0][0] + CROSS_PASSES[1][0]
    c = D.find_cross_class_conflicts(_coded(spark, sf_dir), sets)
    return c.select(F.md5("text").alias("text_md5"), F.array_join(F.col("label_set").cast("array<string>"), ",").alias("label_set"))


def _pass_sql(src, dst, sets, drop):
    return f"""{dst} AS (SELECT s.* FROM {src} s WHERE NOT (s.target IN ({', '.join(map(str, drop))}) AND s.text IN
  (SELECT text FROM {src} WHERE text IS NOT NULL GROUP BY text
   HAVING count_if(target IS NULL) = 0 AND list_sort(list_distinct(list(target))) IN {_sets_sql(sets)})))"""


_CROSS_RESOLVED_SQL = (f"{_CODED_SQL},\n{_pass_sql('coded', 'pass1', *CROSS_PASSES[0])},\n"
                       f"{_pass_sql('pass1', 'pass2', *CROSS_PASSES[1])}")


@query("resolve_cross_class", sql=f"""WITH {_CROSS_RESOLVED_SQL}
SELECT doc_id, target FROM pass2""")
def resolve_cross_class(spark, sf_dir):
    return D.resolve_cross_class_conflicts(_coded(spark, sf_dir), CROSS_PASSES).select("doc_id", "target")


@query("assert_no_conflicts", sql=f"""WITH {_CROSS_RESOLVED_SQL},
found AS (SELECT array_to_string(list_sort(list_distinct(list(target))), ',') AS set_name FROM pass2 GROUP BY text),
expected AS (SELECT * FROM (VALUES ('0,1'), ('2,3'), ('4,5'), ('6,7')) AS e(set_name))
SELECT e.set_name, CAST(count(f.set_name) AS BIGINT) AS n_groups FROM expected e
LEFT JOIN found f ON e.set_name = f.set_name GROUP BY e.set_name""")
def assert_no_conflicts(spark, sf_dir):
    r = D.resolve_cross_class_conflicts(_coded(spark, sf_dir), CROSS_PASSES)
    return D.assert_no_conflicts(r, CROSS_PASSES[0][0] + CROSS_PASSES[1][0])


@query("union_corpora", sql="""SELECT row_number() OVER (ORDER BY src, doc_id) - 1 AS idx, doc_id, lang, md5(text) AS text_md5
FROM (SELECT 0 AS src, doc_id, text, lang FROM documents
      UNION ALL SELECT 1 AS src, item_id AS doc_id, text, NULL AS lang FROM benchmark)""")
def union_corpora(spark, sf_dir):
    a = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    u = D.union_corpora(a, second_corpus(spark, sf_dir))
    return u.select("idx", "doc_id", "lang", F.md5("text").alias("text_md5"))


@query("dedup_report", sql=f"""WITH {ANNOTATED_SQL},
kept AS (SELECT * FROM annotated QUALIFY row_number() OVER (PARTITION BY text, sentiment ORDER BY doc_id) = 1),
b AS (SELECT sentiment, count(*) AS n_before FROM annotated GROUP BY sentiment),
k AS (SELECT sentiment, count(*) AS n_after FROM kept GROUP BY sentiment)
SELECT coalesce(b.sentiment, k.sentiment) AS sentiment, coalesce(n_before, 0) AS n_before, coalesce(n_after, 0) AS n_after
FROM b FULL OUTER JOIN k ON b.sentiment = k.sentiment""")
def dedup_report(spark, sf_dir):
    a = annotated(spark, sf_dir)
    return D.dedup_report(a, D.dedup_keep_first(a), "sentiment")


@query("set_predicates", sql="""SELECT source, array_to_string(s, ',') AS lang_set, s = ['en'] AS en_only,
  s IN (['de', 'en'], ['en', 'fr'], ['en', 'es']) AS en_pair
FROM (SELECT source, list_sort(list_distinct(list(lang))) AS s FROM documents GROUP BY source)""")
def set_predicates(spark, sf_dir):
    g = table(spark, sf_dir, "documents").groupBy("source").agg(F.collect_set("lang").alias("s"))
    return g.select("source", F.array_join(F.array_sort("s"), ",").alias("lang_set"),
                    D.set_equals("s", ["en"]).alias("en_only"),
                    D.set_in("s", [["de", "en"], ["en", "fr"], ["en", "es"]]).alias("en_pair"))


# ---------------------------------------------------------------- A1-A8, A11, J6
@query("value_counts", sql="SELECT lang, count(*) AS count FROM documents WHERE lang IS NOT NULL GROUP BY lang")
def value_counts(spark, sf_dir):
    return A.value_counts(table(spark, sf_dir, "documents"), "lang")


@query("value_counts_pairs", sql=f"""WITH {ANNOTATED_SQL}
SELECT sentiment, polarity, count(*) AS count FROM annotated
WHERE sentiment IS NOT NULL AND polarity IS NOT NULL GROUP BY sentiment, polarity""")
def value_counts_pairs(spark, sf_dir):
    return A.value_counts(annotated(spark, sf_dir), ["sentiment", "polarity"])


@query("group_size", sql="SELECT source, count(*) AS size FROM documents WHERE source IS NOT NULL GROUP BY source")
def group_size(spark, sf_dir):
    return A.group_size(table(spark, sf_dir, "documents"), "source")


@query("class_share", sql=f"""WITH {ANNOTATED_SQL}
SELECT sentiment, polarity, count(*) AS count, round(100.0 * count(*) / sum(count(*)) OVER (), {DIGITS}) AS percent
FROM annotated GROUP BY sentiment, polarity""")
def class_share(spark, sf_dir):
    s = A.class_share(annotated(spark, sf_dir), ["sentiment", "polarity"])
    return s.withColumn("percent", F.round("percent", DIGITS))


@query("contribution_counts", sql="""WITH j AS (SELECT d.source, l.quality FROM labels l JOIN documents d USING (doc_id))
SELECT 'collector' AS kind, source AS value, count(*) AS count FROM j WHERE source IS NOT NULL GROUP BY source
UNION ALL
SELECT 'annotation' AS kind, CAST(quality AS VARCHAR) AS value, count(*) AS count FROM j WHERE quality IS NOT NULL GROUP BY quality""")
def contribution_counts(spark, sf_dir):
    j = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id")
    by_collector = A.value_counts(j, "source").select(F.lit("collector").alias("kind"), F.col("source").alias("value"), "count")
    by_annotation = A.value_counts(j, "quality").select(F.lit("annotation").alias("kind"),
                                                        F.col("quality").cast("string").alias("value"), "count")
    return by_collector.unionByName(by_annotation)


_WEIGHTS_SQL = f"""{IMBALANCED_SQL},
cls AS (SELECT label, count(*) AS n_c FROM imbalanced GROUP BY label),
w AS (SELECT label, n_c, sum(n_c) OVER () / (count(*) OVER () * n_c) AS weight FROM cls)"""


@query("balanced_class_weights", sql=f"""WITH {_WEIGHTS_SQL}
SELECT label, n_c, round(weight, {DIGITS}) AS weight, round(weight / sum(weight) OVER (), {DIGITS}) AS weight_normalized FROM w""")
def balanced_class_weights(spark, sf_dir):
    im = imbalanced(spark, sf_dir)
    w = A.balanced_class_weights(im)
    wn = A.balanced_class_weights(im, normalize=True).select("label", F.col("weight").alias("weight_normalized"))
    return w.join(wn, "label").select("label", "n_c", F.round("weight", DIGITS).alias("weight"),
                                      F.round("weight_normalized", DIGITS).alias("weight_normalized"))


@query("sample_weights", sql=f"""WITH {_WEIGHTS_SQL}
SELECT i.vec_id, i.label, round(w.weight, {DIGITS}) AS weight FROM imbalanced i JOIN w USING (label)""")
def sample_weights(spark, sf_dir):
    im = imbalanced(spark, sf_dir).select("vec_id", "label")
    out = A.sample_weights(im, A.balanced_class_weights(im))
    return out.select("vec_id", "label", F.round("weight", DIGITS).alias("weight"))


@query("histogram", sql=f"""WITH mm AS (SELECT CAST(min(n_chars) AS DOUBLE) AS lo, CAST(max(n_chars) AS DOUBLE) AS hi FROM documents),
b AS (SELECT CAST(CASE WHEN hi = lo THEN 0 ELSE least(floor((n_chars - lo) / ((hi - lo) / 50)), 49) END AS INTEGER) AS bin
      FROM documents, mm WHERE n_chars IS NOT NULL),
c AS (SELECT bin, count(*) AS count FROM b GROUP BY bin)
SELECT CAST(g.bin AS INTEGER) AS bin, round(lo + g.bin * (hi - lo) / 50, {DIGITS}) AS lo,
       round(lo + (g.bin + 1) * (hi - lo) / 50, {DIGITS}) AS hi, coalesce(c.count, 0) AS count
FROM (SELECT range AS bin FROM range(50)) g CROSS JOIN mm LEFT JOIN c ON c.bin = g.bin""")
def histogram(spark, sf_dir):
    h = A.histogram(table(spark, sf_dir, "documents"), "n_chars", 50)
    return h.select("bin", F.round("lo", DIGITS).alias("lo"), F.round("hi", DIGITS).alias("hi"), "count")


@query("kde", sql="""WITH st AS (SELECT count(n_chars) AS n, stddev_samp(n_chars) AS sd,
                  CAST(min(n_chars) AS DOUBLE) AS lo, CAST(max(n_chars) AS DOUBLE) AS hi FROM documents),
p AS (SELECT n, lo, hi, sd * pow(CAST(n AS DOUBLE), -0.2) AS h, (hi - lo) / 99 AS step FROM st),
g AS (SELECT range AS i FROM range(100))
SELECT CAST(g.i AS INTEGER) AS point, round(lo + g.i * step, 6) AS x,
       round(sum(exp(-0.5 * pow((lo + g.i * step - d.n_chars) / h, 2))) / (n * h * sqrt(2 * pi())), 12) AS density
FROM g CROSS JOIN p CROSS JOIN (SELECT n_chars FROM documents WHERE n_chars IS NOT NULL) d
GROUP BY g.i, lo, step, n, h""")
def kde(spark, sf_dir):
    k = A.kde(table(spark, sf_dir, "documents"), "n_chars", 100)
    return k.select(F.col("point").cast("int").alias("point"), F.round("x", 6).alias("x"),
                    F.round("density", 12).alias("density"))


@query("annotator_alpha", sql=f"""WITH {RATERS_SQL},
long AS (SELECT doc_id, rater_a AS value FROM raters WHERE rater_a IS NOT NULL
         UNION ALL SELECT doc_id, rater_b FROM raters WHERE rater_b IS NOT NULL),
uc AS (SELECT doc_id, value, CAST(count(*) AS DOUBLE) AS n_uc FROM long GROUP BY doc_id, value),
u AS (SELECT doc_id, sum(n_uc) AS m_u, sum(n_uc * n_uc) AS sq_u FROM uc GROUP BY doc_id HAVING sum(n_uc) >= 2),
dd AS (SELECT sum((m_u * m_u - sq_u) / (m_u - 1)) AS d_o, sum(m_u) AS n FROM u),
nc AS (SELECT value, sum(n_uc) AS n_c FROM uc WHERE doc_id IN (SELECT doc_id FROM u) GROUP BY value),
de AS (SELECT sum(n_c * n_c) AS sq_c FROM nc)
SELECT round(1 - (n - 1) * d_o / (n * n - sq_c), {DIGITS}) AS alpha, CAST(n AS BIGINT) AS n_pairable_values FROM dd, de""")
def annotator_alpha(spark, sf_dir):
    a = A.krippendorff_alpha_nominal(raters(spark, sf_dir), "doc_id", ["rater_a", "rater_b"])
    return a.select(F.round("alpha", DIGITS).alias("alpha"), "n_pairable_values")
