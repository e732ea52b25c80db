"""Registered queries: SMOTE, ADASYN, neighbourhood cleaning, condensed NN, the balancing
composition and the leak audit (X5-X10) on the imbalanced vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import resample as RS
from tessera.operators import split as X
from tessera.operators.indexing import unit_uniform_sql
from tessera.plans.params import DIGITS, SEED
from tessera.plans.registry import query
from tessera.plans.sample_queries import knn_sql, split_sql
from tessera.sources.tables import IMBALANCED_SQL, imbalanced

_E_SQL = f"""{IMBALANCED_SQL},
e AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM imbalanced)"""


def _vector_facts():
    return (F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x), DIGITS).alias("vsum"),
            F.round(F.element_at("embedding", 1), DIGITS).alias("v0"))


def _syn_out(df):
    return df.where(F.col("source_id").isNotNull()).select("label", "syn_index", "source_id", *_vector_facts())


def smote_ctes(src: str, p: str, k: int = 5, seed: int = SEED) -> str:
    """SQL twin of ``smote`` over CTE ``src`` (vec_id, label, v); CTE names prefixed ``p``;
    the synthetic rows end in ``{p}syn`` (label, syn_index, source_id, nn_id, x)."""
    key = "(CAST(label AS VARCHAR) || ':' || CAST(syn_index AS VARCHAR))"
    return f"""{p}cnt AS (SELECT label, count(*) AS n_c FROM {src} GROUP BY label),
{p}need AS (SELECT label, n_c, (SELECT max(n_c) FROM {p}cnt) - n_c AS need FROM {p}cnt WHERE n_c < (SELECT max(n_c) FROM {p}cnt)),
{knn_sql(src, src, k, True, same=True, prefix=p)},
{p}keff AS (SELECT vec_id, max(nn_rank) AS k_eff FROM {p}knn GROUP BY vec_id),
{p}par AS (SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY md5('{seed}:' || CAST(vec_id AS VARCHAR)), vec_id) - 1 AS r FROM {src}),
{p}jobs0 AS (SELECT q.vec_id, q.label, q.r, n.n_c,
                 unnest(range(CAST(greatest(0, ceil((n.need - q.r) / n.n_c)) AS BIGINT))) AS t FROM {p}par q JOIN {p}need n USING (label)),
{p}jobs AS (SELECT j.vec_id, j.label, j.r + j.t * j.n_c AS syn_index, k.k_eff FROM {p}jobs0 j JOIN {p}keff k USING (vec_id)),
{p}pick AS (SELECT *, CAST(floor({unit_uniform_sql(key, seed, 'nn')} * k_eff) + 1 AS BIGINT) AS nn_rank,
                {unit_uniform_sql(key, seed, 'gap')} AS u FROM {p}jobs),
{p}syn AS (SELECT q.label, q.syn_index, q.vec_id AS source_id, k.nn_id,
               list_transform(range(1, len(a.v) + 1), lambda i: a.v[i] + q.u * (b.v[i] - a.v[i])) AS x
        FROM {p}pick q JOIN {p}knn k ON k.vec_id = q.vec_id AND k.nn_rank = q.nn_rank
        JOIN {src} a ON a.vec_id = q.vec_id JOIN {src} b ON b.vec_id = k.nn_id)"""


_SMOTE_SQL = f"""WITH {_E_SQL}, {smote_ctes('e', '')}
SELECT label, syn_index, source_id, round(list_sum(x), {DIGITS}) AS vsum, round(x[1], {DIGITS}) AS v0 FROM syn"""


@query("smote", sql=_SMOTE_SQL)
def smote(spark, sf_dir):
    """Every class below the largest is synthesised up to its size (k=5, same class)."""
    out = RS.smote(imbalanced(spark, sf_dir).select("vec_id", "label", "embedding"), "label", "vec_id", "embedding", 5, SEED)
    return _syn_out(out)


@query("adasyn", sql=f"""WITH {_E_SQL},
cnt AS (SELECT label, count(*) AS n_c FROM e GROUP BY label),
tg AS (SELECT label, (SELECT max(n_c) FROM cnt) - n_c AS G FROM cnt WHERE n_c = (SELECT min(n_c) FROM cnt) AND n_c < (SELECT max(n_c) FROM cnt)),
mi AS (SELECT e.* FROM e JOIN tg USING (label)),
{knn_sql('mi', 'e', 5, True)},
ratio AS (SELECT k.vec_id, mi.label, count_if(e.label <> mi.label) / 5.0 AS r
          FROM knn k JOIN e ON e.vec_id = k.nn_id JOIN mi ON mi.vec_id = k.vec_id GROUP BY k.vec_id, mi.label),
q AS (SELECT ratio.vec_id, CAST(CASE WHEN sum(r) OVER (PARTITION BY ratio.label) > 0
             THEN round_even(r / sum(r) OVER (PARTITION BY ratio.label) * G, 0) ELSE 0 END AS INTEGER) AS n_new
      FROM ratio JOIN tg USING (label))
SELECT vec_id AS source_id, CAST(n_new AS BIGINT) AS n_generated FROM q WHERE n_new > 0""")
def adasyn(spark, sf_dir):
    """Synthetic rows generated per minority parent (ADASYN quotas)."""
    out = RS.adasyn(imbalanced(spark, sf_dir).select("vec_id", "label", "embedding"), "label", "vec_id", "embedding", 5, SEED)
    return (out.where(F.col("source_id").isNotNull()).groupBy("source_id")
               .agg(F.count(F.lit(1)).alias("n_generated")))


def ncr_ctes(src: str, p: str, k: int = 3) -> str:
    """SQL twin of ``neighbourhood_cleaning``; the kept rows end in ``{p}kept``."""
    return f"""{p}cnt AS (SELECT label, count(*) AS n_c FROM {src} GROUP BY label),
{p}mn AS (SELECT label AS _min FROM {p}cnt ORDER BY n_c, label LIMIT 1),
{knn_sql(src, src, k, True, prefix=p)},
{p}votes AS (SELECT k.vec_id, b.label AS nl, count(*) AS c FROM {p}knn k JOIN {src} b ON b.vec_id = k.nn_id GROUP BY 1, 2),
{p}pred AS (SELECT v.vec_id, arg_max(nl, (c, -nl)) AS prediction FROM {p}votes v GROUP BY v.vec_id),
{p}lab AS (SELECT q.vec_id, q.prediction, s.label FROM {p}pred q JOIN {src} s USING (vec_id)),
{p}edited AS (SELECT vec_id FROM {p}lab, {p}mn WHERE label <> _min AND prediction <> label),
{p}bad_min AS (SELECT vec_id FROM {p}lab, {p}mn WHERE label = _min AND prediction <> label),
{p}neigh AS (SELECT k.nn_id AS vec_id FROM {p}knn k JOIN {p}bad_min USING (vec_id) JOIN {src} s ON s.vec_id = k.nn_id, {p}mn
             WHERE s.label <> _min AND s.label IN (SELECT label FROM {p}cnt
                   WHERE n_c > 0.5 * (SELECT min(n_c) FROM {p}cnt))),
{p}kept AS (SELECT * FROM {src} WHERE vec_id NOT IN (SELECT vec_id FROM {p}edited UNION SELECT vec_id FROM {p}neigh))"""


@query("neighbourhood_cleaning", sql=f"""WITH {_E_SQL}, {ncr_ctes('e', '')}
SELECT vec_id, label FROM kept""")
def neighbourhood_cleaning(spark, sf_dir):
    """Neighbourhood cleaning rule with k=3."""
    df = imbalanced(spark, sf_dir).select("vec_id", "label", "embedding")
    return RS.neighbourhood_cleaning(df, "label", "vec_id", "embedding", 3, SEED).select("vec_id", "label")


def cnn_sql(rounds: int = 10, seed: int = SEED) -> str:
    """SQL twin of ``condensed_nn`` with the loop unrolled: once a round adds nothing, later
    rounds add nothing either, so the store after ``rounds`` rounds equals the early stop."""
    dist = "sqrt(list_sum(list_transform(range(1, len(a.v) + 1), lambda i: (a.v[i] - b.v[i]) * (a.v[i] - b.v[i]))))"
    ctes = [_E_SQL,
            "cnt AS (SELECT label, count(*) AS n_c FROM e GROUP BY label)",
            "mn AS (SELECT label AS _min FROM cnt ORDER BY n_c, label LIMIT 1)",
            f"""seed AS (SELECT vec_id FROM e, mn WHERE label = _min UNION
              SELECT vec_id FROM (SELECT vec_id, row_number() OVER (PARTITION BY label
                ORDER BY md5('{seed}:' || CAST(vec_id AS VARCHAR)), vec_id) - 1 AS r FROM e) WHERE r = 0)""",
            "st0 AS (SELECT * FROM e WHERE vec_id IN (SELECT vec_id FROM seed))"]
    for i in range(1, rounds + 1):
        ctes.append(f"""rest{i} AS (SELECT * FROM e WHERE vec_id NOT IN (SELECT vec_id FROM st{i - 1})),
nn{i} AS (SELECT a.vec_id, a.label, arg_min(b.label, ({dist}, b.vec_id)) AS nl
          FROM rest{i} a JOIN st{i - 1} b ON TRUE GROUP BY a.vec_id, a.label),
st{i} AS (SELECT * FROM st{i - 1} UNION ALL
          SELECT * FROM rest{i} WHERE vec_id IN (SELECT vec_id FROM nn{i} WHERE nl <> label))""")
    return "WITH " + ",\n".join(ctes) + f"\nSELECT vec_id, label FROM st{rounds}"


@query("condensed_nn", sql=cnn_sql())
def condensed_nn(spark, sf_dir):
    """Condensed nearest-neighbour subset (iterative rounds; the SQL unrolls ten)."""
    df = imbalanced(spark, sf_dir).select("vec_id", "label", "embedding")
    return RS.condensed_nn(df, "label", "vec_id", "embedding", SEED).select("vec_id", "label")


@query("balance_classes", sql=f"""WITH {_E_SQL},
sub AS (SELECT * FROM e WHERE label IN (0, 1)),
{ncr_ctes('sub', 'c_')},
rus AS (SELECT vec_id, label, v FROM (SELECT *, row_number() OVER (PARTITION BY label
          ORDER BY md5('{SEED}:' || CAST(vec_id AS VARCHAR)), vec_id) - 1 AS rk FROM c_kept) WHERE label <> 0 OR rk < 150),
merged AS (SELECT vec_id, label, v FROM rus UNION ALL SELECT vec_id, label, v FROM e WHERE label NOT IN (0, 1)),
{smote_ctes('merged', 's_')},
allr AS (SELECT label, vec_id, CAST(NULL AS BIGINT) AS syn_index, CAST(NULL AS BIGINT) AS source_id, v AS x FROM merged
         UNION ALL SELECT label, NULL, syn_index, source_id, x FROM s_syn)
SELECT label, vec_id, syn_index, source_id, round(list_sum(x), {DIGITS}) AS vsum, round(x[1], {DIGITS}) AS v0 FROM allr""")
def balance_classes(spark, sf_dir):
    """Classes 0 and 1 cleaned against each other, class 0 under-sampled to 150, classes 2 and 3 untouched, then SMOTE; all rows."""
    df = imbalanced(spark, sf_dir).select("vec_id", "label", "embedding")
    out = RS.balance_classes(df, "label", "vec_id", "embedding", [0, 1], {0: 150}, "smote", SEED)
    return out.select("label", "vec_id", "syn_index", "source_id", *_vector_facts())


@query("leak_audit", sql=f"""WITH {_E_SQL},
{split_sql('e', 'sp', 'vec_id', 0.2, SEED)},
tr AS (SELECT vec_id, label, v FROM sp WHERE split = 'train'),
te AS (SELECT vec_id FROM sp WHERE split = 'test'),
{smote_ctes('tr', 'a_')},
a_all AS (SELECT vec_id AS src FROM tr UNION ALL SELECT source_id FROM a_syn),
after AS (SELECT 'after_split' AS mode, count(*) AS n_leaked_rows, count(DISTINCT src) AS n_test_sources
          FROM a_all WHERE src IN (SELECT vec_id FROM te)),
{smote_ctes('e', 'b_')},
b_rows AS (SELECT vec_id, label, CAST(NULL AS BIGINT) AS source_id, vec_id AS _row FROM e
           UNION ALL SELECT NULL, label, source_id, -(syn_index * 10 + label + 1) FROM b_syn),
{split_sql('b_rows', 'sp2', '_row', 0.2, SEED)},
b_src AS (SELECT coalesce(source_id, vec_id) AS src FROM sp2 WHERE split = 'train'),
before AS (SELECT 'before_split' AS mode, count(*) AS n_leaked_rows, count(DISTINCT src) AS n_test_sources
           FROM b_src WHERE src IN (SELECT vec_id FROM sp2 WHERE split = 'test' AND source_id IS NULL))
SELECT * FROM after UNION ALL SELECT * FROM before""")
def leak_audit(spark, sf_dir):
    """Over-sampling before the split leaks test parents into train; after, it does not."""
    df = imbalanced(spark, sf_dir).select("vec_id", "label", "embedding")
    # after: split first, over-sample the train side only
    s = X.stratified_split(df, "label", 0.2, SEED, "vec_id")
    train = RS.smote(s.where("split = 'train'").drop("split"), "label", "vec_id", "embedding", 5, SEED)
    after = X.leak_audit(train, s.where("split = 'test'"), "vec_id").withColumn("mode", F.lit("after_split"))
    # before: over-sample everything, then split (synthetic rows get a derived row key)
    allsyn = RS.smote(df, "label", "vec_id", "embedding", 5, SEED)
    allsyn = allsyn.withColumn("_row", F.coalesce(F.col("vec_id"), -(F.col("syn_index") * 10 + F.col("label") + 1)))
    s2 = X.stratified_split(allsyn, "label", 0.2, SEED, "_row")
    test_orig = s2.where("split = 'test' AND source_id IS NULL")
    before = X.leak_audit(s2.where("split = 'train'"), test_orig, "vec_id").withColumn("mode", F.lit("before_split"))
    return after.unionByName(before)
