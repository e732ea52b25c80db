"""Registered queries: classifiers trained on the train split of the imbalanced vectors and
scored on the test split (M1-M16, S8), word-vector training (E1, E2), PCA (E14) and batch
encoding (E15). SQL cannot repeat a fit: those queries return their predictions and scores, and
tests hold them against planted data; Gaussian naive Bayes, MLlib's and in aggregates, has a full SQL twin."""

from __future__ import annotations

from pyspark.ml.classification import LinearSVC, LogisticRegression, OneVsRest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from tessera.operators import knn as KN
from tessera.operators import models as MD
from tessera.operators import split as X
from tessera.operators.indexing import materialize
from tessera.plans.params import DIGITS, MIN_STEM, SEED, STOPWORDS, SUFFIXES
from tessera.plans.registry import query
from tessera.plans.sample_queries import _SPLIT_SQL, _split
from tessera.plans.tfidf_queries import CLEAN_TOKENS_SQL, clean_tokens, tokens_once
from tessera.session import scratch_path
from tessera.sources import files
from tessera.sources.tables import table


def _train_test(spark, sf_dir, weighted=False):
    s = MD.with_features(_split(spark, sf_dir), "embedding")
    if weighted:
        s = MD.with_class_weights(s)
    return s.where(F.col("split") == "train"), s.where(F.col("split") == "test")


def _checked(train_scored, scored, key="vec_id"):
    """The scored test rows (prediction and, where the model has one, probability) with facts about the
    fit on the whole train split: every prediction is a class of it, probabilities are a distribution,
    and its mean recall over the classes is above that of a constant or random guess."""
    per = train_scored.groupBy("label").agg(F.avg((F.col("prediction") == F.col("label")).cast("double")).alias("r"))
    mean, classes = per.agg(F.avg("r"), F.collect_set(F.col("label").cast("int"))).first()  # k rows
    proper = F.lit(True)
    if "probability" in scored.columns:
        total = F.aggregate("probability", F.lit(0.0), lambda a, x: a + x)
        proper = (F.abs(total - 1) < 1e-6) & F.forall("probability", lambda x: (x >= 0) & (x <= 1))
    facts = {"known_class": F.col("prediction").cast("int").isin(*classes), "proper_probability": proper,
             "above_chance": F.lit(mean is not None and mean > 1.0 / len(classes))}
    kept = [key, "label", F.col("prediction").cast("int").alias("prediction")] + (["probability"] if "probability" in scored.columns else [])
    return scored.select(*kept, *[c.alias(n) for n, c in facts.items()])


def _scored(model, tr, te, key="vec_id"):
    return _checked(MD.predict(model, tr, keep=(key, "label")), MD.predict(model, te, keep=(key, "label")), key)


@query("train_logreg")
def train_logreg(spark, sf_dir):
    """M1: class-weighted multinomial logistic regression."""
    tr, te = _train_test(spark, sf_dir, weighted=True)
    return _scored(MD.train_logreg(tr, weight="weight"), tr, te)


@query("train_gaussian_nb", sql=f"""WITH {_SPLIT_SQL},
w AS (SELECT label, (SELECT count(*) FROM sp) / ((SELECT count(DISTINCT label) FROM sp) * count(*)::DOUBLE) AS weight FROM sp GROUP BY label),
v AS (SELECT sp.vec_id, sp.label, sp.split, weight, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v
      FROM sp JOIN embeddings USING (vec_id) JOIN w ON w.label = sp.label),
d AS (SELECT vec_id, label, split, weight, unnest(range(len(v))) AS i, unnest(v) AS x FROM v),
st AS (SELECT label AS c, i, sum(weight) AS sw, sum(weight * x) / sum(weight) AS mu, sum(weight * x * x) AS sq FROM d WHERE split = 'train' GROUP BY label, i),
eps AS (SELECT 1e-9 * max(g) AS e FROM (SELECT sum(sq) / sum(sw) - pow(sum(mu * sw) / sum(sw), 2) AS g FROM st GROUP BY i)),
pri AS (SELECT label AS c, ln(sum(weight) / (SELECT sum(weight) FROM v WHERE split = 'train')) AS lp FROM v WHERE split = 'train' GROUP BY label),
nb AS (SELECT c, i, mu, sq / sw - mu * mu + e AS var FROM st, eps),
ll AS (SELECT d.vec_id, d.label, d.split, nb.c, any_value(lp) - sum(0.5 * ln(var) + (x - mu) * (x - mu) / (2 * var)) AS s
       FROM d JOIN nb USING (i) JOIN pri ON pri.c = nb.c GROUP BY ALL),
pr AS (SELECT *, exp(s - m) / sum(exp(s - m)) OVER (PARTITION BY vec_id) AS p FROM (SELECT *, max(s) OVER (PARTITION BY vec_id) AS m FROM ll)),
scored AS (SELECT vec_id, label, split, CAST(arg_max(c, (p, -c)) AS INTEGER) AS prediction, list(p ORDER BY c) AS probability FROM pr GROUP BY ALL),
recall AS (SELECT avg(r) AS mean, count(*) AS k FROM (SELECT avg((prediction = label)::INTEGER) AS r FROM scored WHERE split = 'train' GROUP BY label))
SELECT vec_id, label, prediction, probability, prediction IN (SELECT c FROM pri) AS known_class,
       abs(list_sum(probability) - 1) < 1e-6 AND list_min(probability) >= 0 AND list_max(probability) <= 1 AS proper_probability, mean > 1.0 / k AS above_chance
FROM scored, recall WHERE split = 'test'""")
def train_gaussian_nb(spark, sf_dir):
    """M2: MLlib Gaussian naive Bayes with sample weights."""
    tr, te = _train_test(spark, sf_dir, weighted=True)
    return _scored(MD.train_gaussian_nb(tr, weight="weight"), tr, te)


@query("gaussian_nb_aggregates", sql=f"""WITH {_SPLIT_SQL},
tr AS (SELECT s.vec_id, s.label, list_transform(e.embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM sp s JOIN embeddings e USING (vec_id) WHERE split = 'train'),
te AS (SELECT s.vec_id, s.label, list_transform(e.embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM sp s JOIN embeddings e USING (vec_id) WHERE split = 'test'),
d AS (SELECT label, unnest(range(len(v))) AS i, unnest(v) AS x FROM tr),
st AS (SELECT label, i, avg(x) AS mu, var_pop(x) AS var FROM d GROUP BY label, i),
eps AS (SELECT 1e-9 * max(var) AS e FROM (SELECT i, var_pop(x) AS var FROM d GROUP BY i)),
pri AS (SELECT label, ln(count(*) / (SELECT count(*) FROM tr)) AS lp FROM tr GROUP BY label),
td AS (SELECT vec_id, unnest(range(len(v))) AS i, unnest(v) AS x FROM te),
ll AS (SELECT td.vec_id, st.label, sum(-0.5 * ln(2 * pi() * (st.var + e)) - (td.x - st.mu) * (td.x - st.mu) / (2 * (st.var + e))) AS s
       FROM td JOIN st ON td.i = st.i CROSS JOIN eps GROUP BY td.vec_id, st.label),
pred AS (SELECT ll.vec_id, arg_max(ll.label, ll.s + pri.lp) AS prediction FROM ll JOIN pri ON ll.label = pri.label GROUP BY ll.vec_id)
SELECT te.vec_id, te.label, CAST(pred.prediction AS INTEGER) AS prediction FROM te JOIN pred USING (vec_id)""")
def gaussian_nb_aggregates(spark, sf_dir):
    """M2 as plain aggregates: class means / variances fitted with one grouped pass, scored
    with one array expression per row."""
    s = _split(spark, sf_dir)
    tr, te = s.where(F.col("split") == "train"), s.where(F.col("split") == "test")
    m = MD.gaussian_nb_fit(tr, "embedding")
    return MD.gaussian_nb_predict(m, te, "embedding").select("vec_id", "label", F.col("prediction").cast("int"))


@query("train_tree")
def train_tree(spark, sf_dir):
    """M3: decision tree."""
    tr, te = _train_test(spark, sf_dir)
    return _scored(MD.train_tree(tr, max_depth=5, seed=SEED), tr, te)


@query("train_forest")
def train_forest(spark, sf_dir):
    """M4: random forest, 100 trees."""
    tr, te = _train_test(spark, sf_dir)
    return _scored(MD.train_forest(tr, n_trees=100, seed=SEED), tr, te)


@query("train_boosted")
def train_boosted(spark, sf_dir):
    """M5: class-weighted one-vs-rest gradient-boosted trees, 100 rounds at depth 6."""
    tr, te = _train_test(spark, sf_dir, weighted=True)
    return _scored(MD.train_boosted(tr, weight="weight", seed=SEED), tr, te)


@query("train_adaboost")
def train_adaboost(spark, sf_dir):
    """M6: SAMME AdaBoost, depth-2 trees, class-weighted start (rounds stop early when a
    round's error reaches chance level)."""
    tr, te = _train_test(spark, sf_dir, weighted=True)
    m = MD.train_adaboost(tr, weight="weight", rounds=100, depth=2, seed=SEED)
    return _checked(*[m.transform(part.withColumn("_row", F.col("vec_id"))).select("vec_id", "label", "prediction") for part in (tr, te)])


@query("train_linear_svm")
def train_linear_svm(spark, sf_dir):
    """M7: linear SVM (one-vs-rest) on the TF-IDF of the labelled corpus (sparse vectors)."""
    from tessera.operators import tfidf as TF
    from tessera.sources.tables import labelled
    from tessera.functions import text as T
    lab = TF.in_blocks(labelled(spark, sf_dir).select("doc_id", "target",
                                                      T.clean_tokens("text", STOPWORDS, SUFFIXES, MIN_STEM).alias("tokens")))
    model = TF.tfidf_fit(lab)
    size = model.agg(F.max("term_index")).first()[0] + 1
    vec = TF.to_ml_vector(TF.tfidf_transform(lab, model), size)
    from tessera.operators.labels import class_table
    codes = class_table(lab, "target", "label")  # one row per distinct target
    d = vec.join(lab.select("doc_id", "target"), "doc_id").join(codes, "target")
    d = X.stratified_split(d.select("doc_id", "features", F.col("label").cast("int")), "label", 0.2, SEED, "doc_id")
    d = materialize(d)  # the optimiser makes one pass per iteration: read the vectors, not the text
    tr, te = d.where("split = 'train'"), d.where("split = 'test'")
    return _scored(MD.train_linear_svm(tr), tr, te, "doc_id")


@query("train_rff_svm")
def train_rff_svm(spark, sf_dir):
    """M8: RBF-kernel SVM approximated by random Fourier features + linear SVM."""
    s = MD.rff_features(_split(spark, sf_dir), "embedding", 64, 256, gamma=0.5, seed=SEED)
    tr, te = s.where(F.col("split") == "train"), s.where(F.col("split") == "test")
    return _scored(MD.train_rff_svm(tr), tr, te)


@query("one_vs_one")
def one_vs_one(spark, sf_dir):
    """M9: one-vs-one logistic regressions with majority vote."""
    tr, te = _train_test(spark, sf_dir)
    m = MD.one_vs_one(tr, lambda: LogisticRegression(maxIter=50))
    return _checked(*[m.transform(part).select("vec_id", "label", "prediction") for part in (tr, te)])


@query("train_mlp")
def train_mlp(spark, sf_dir):
    """M11 + M12: feed-forward net [64, 64, 32, 4]; cost-sensitive by weight-proportional
    replication of rows (the MLP has no weight column)."""
    tr, te = _train_test(spark, sf_dir, weighted=True)
    tr = MD.replicate_by_weight(tr)
    return _scored(MD.train_mlp(tr, [64, 64, 32, 4], seed=SEED), tr, te)


@query("class_weighted_rows", sql=f"""WITH {_SPLIT_SQL},
tr AS (SELECT vec_id, label FROM sp WHERE split = 'train'),
n AS (SELECT label, count(*) AS n_c FROM sp GROUP BY label)
SELECT tr.vec_id, tr.label, round((SELECT count(*) FROM sp) / ((SELECT count(*) FROM n) * n_c::DOUBLE), {DIGITS}) AS weight FROM tr JOIN n USING (label)""")
def class_weighted_rows(spark, sf_dir):
    """Per-row balanced class weights (they average to 1 over the rows)."""
    tr, _ = _train_test(spark, sf_dir, weighted=True)
    return tr.select("vec_id", "label", F.round("weight", DIGITS).alias("weight"))


def _params(grid: dict) -> str:
    return str(sorted(grid.items()))


_GRID = {"regParam": [0.0, 0.01, 0.1], "elasticNetParam": [0.0, 0.5]}
_LONG_GRID = {"regParam": [0.001, 0.01, 0.1], "maxIter": [20, 50, 100]}


def _search_rows(spark, cv):
    return spark.createDataFrame([(_params(p), m) for p, m in MD.search_results(cv)], "params string, mean_f1 double")


@query("grid_search")
def grid_search(spark, sf_dir):
    """Grid over regParam x elasticNetParam, 5-fold CV on a stratified fold column: the mean F1 of each."""
    tr, _ = _train_test(spark, sf_dir)
    tr = X.stratified_kfold(tr, "label", 5, SEED, "vec_id")
    lr = LogisticRegression(maxIter=50)
    cv = MD.search(tr, lr, {getattr(lr, k): v for k, v in _GRID.items()}, fold_col="fold")
    return _search_rows(spark, cv)


@query("random_search_long")
@query("random_search")
def random_search(spark, sf_dir):
    """Seeded random subset (4 of 9) of a one-vs-rest linear-SVM grid over all classes with 20, 50
    or 100 iterations a fit, 5-fold CV: the mean F1 of each."""
    tr, _ = _train_test(spark, sf_dir)
    tr = X.stratified_kfold(tr, "label", 5, SEED, "vec_id").select("vec_id", "label", "features", "fold")
    tr = materialize(tr)  # 20 fits read the vectors and folds, not the split and its sorts again
    svc = LinearSVC(maxIter=50)
    cv = MD.search(tr, OneVsRest(classifier=svc, parallelism=4), {getattr(svc, k): v for k, v in _LONG_GRID.items()}, fold_col="fold",
                   n_iter=4, seed=SEED)
    return _search_rows(spark, cv)


@query("cross_val_score")
def cross_val_score(spark, sf_dir):
    """Macro-F1 of a logistic regression on each of 5 stratified folds."""
    tr, _ = _train_test(spark, sf_dir)
    folds = X.stratified_kfold(tr, "label", 5, SEED, "vec_id")
    scores = MD.cross_val_score(folds, lambda d: MD.train_logreg(d, max_iter=50))
    return scores.select(F.col("fold").cast("int").alias("fold"), "macro_f1")


_ESTIMATORS = {
    "logreg": lambda d: MD.train_logreg(d, max_iter=50),
    "tree": lambda d: MD.train_tree(d, max_depth=5),
    "forest": lambda d: MD.train_forest(d),
    "naive_bayes": lambda d: MD.train_gaussian_nb(d)}


def _fit_knn(tr):
    return lambda part: KN.knn_predict(tr, part, "vec_id", "embedding", "label", 5)


def _fit_rbf_svm(tr):
    def features(d):
        return MD.rff_features(d.drop("features"), "embedding", 64, 256, gamma=0.5, seed=SEED)
    model = MD.train_rff_svm(features(tr))
    return lambda part: MD.predict(model, features(part))


@query("compare_all_estimators")
@query("compare_estimators")
def compare_estimators(spark, sf_dir):
    """Train / test accuracy, macro precision, recall, F1 and AUC (null without probabilities), and
    kappa of the reference's six estimators; the RBF SVM is ``train_rff_svm`` (M8)."""
    tr, te = _train_test(spark, sf_dir)
    return MD.compare_estimators(tr, te, _ESTIMATORS | {"knn": _fit_knn, "svm": _fit_rbf_svm})


@query("score_texts")
def score_texts(spark, sf_dir):
    """Batch scoring of raw texts into the four target codes: clean -> tokens -> mean-pooled vectors -> model."""
    from tessera.operators.embed import mean_pool
    from tessera.plans.embed_queries import word_vectors
    from tessera.sources.tables import labelled
    every = tokens_once(spark, sf_dir)
    wv = word_vectors(spark, sf_dir, docs=every)
    lab = labelled(spark, sf_dir)
    toks = every.join(lab.select("doc_id", "target"), "doc_id")
    d = MD.with_features(mean_pool(toks, wv, dim=64), "embedding").join(
        toks.select("doc_id", (2 * F.substring("target", 1, 1).cast("int") + F.substring("target", 3, 1).cast("int")).alias("label")), "doc_id")
    model = MD.train_logreg(d, max_iter=50)
    docs = table(spark, sf_dir, "documents")
    return MD.score_texts(docs, "text", wv, model, STOPWORDS, SUFFIXES, MIN_STEM, dim=64)


@query("save_load_model", sql=f"""WITH {_SPLIT_SQL}
SELECT vec_id, label, TRUE AS same_prediction FROM sp WHERE split = 'test'""")
def save_load_model(spark, sf_dir):
    """Fit a pipeline (assembler-free: features given), save it, load it, score."""
    tr, te = _train_test(spark, sf_dir)
    pm = MD.fit_pipeline(tr, [LogisticRegression(maxIter=50)])
    path = scratch_path(spark, "model")
    files.save_model(pm, path)
    a, b = MD.predict(pm, te), MD.predict(files.load_model(path), te)
    b = b.select("vec_id", F.col("prediction").alias("again"), F.col("probability").alias("probability_again"))
    same = (F.col("prediction") == F.col("again")) & (F.col("probability") == F.col("probability_again"))
    return a.join(b, "vec_id").select("vec_id", "label", same.alias("same_prediction"))


@query("train_word2vec", sql=f"""WITH {CLEAN_TOKENS_SQL}
SELECT term AS word, 100 AS dim FROM (SELECT unnest(tokens) AS term FROM docs) GROUP BY term HAVING count(*) >= 1""")
def train_word2vec(spark, sf_dir):
    """Skip-gram on the cleaned corpus (100-d, window 6, every word)."""
    v = MD.train_word2vec(materialize(clean_tokens(spark, sf_dir)), size=100, window=6, min_count=1, epochs=1, seed=SEED)
    return v.select("word", F.size("vector").alias("dim"))


@query("train_glove_like", sql=f"""WITH {CLEAN_TOKENS_SQL}
SELECT term AS word, 300 AS dim FROM (SELECT unnest(tokens) AS term FROM docs) GROUP BY term HAVING count(*) >= 3""")
def train_glove_like(spark, sf_dir):
    """E2's 300-d variant: skip-gram, window 5, min count 3, 15 epochs. The reference's own 300-d
    model runs window 15 and 200 epochs; E2 as surveyed is ``train_glove_surveyed``."""
    v = MD.train_word2vec(materialize(clean_tokens(spark, sf_dir)), size=300, window=5, min_count=3, epochs=15, seed=SEED)
    return v.select("word", F.size("vector").alias("dim"))


@query("train_glove_surveyed", sql=f"""WITH {CLEAN_TOKENS_SQL}
SELECT term AS word, 100 AS dim FROM (SELECT unnest(tokens) AS term FROM docs) GROUP BY term""")
def train_glove_surveyed(spark, sf_dir):
    """E2 as surveyed: 100-d, window 5, every word, 15 epochs (skip-gram for the reference's CBOW; ``train_cbow_negative`` has that)."""
    v = MD.train_glove_like(materialize(clean_tokens(spark, sf_dir)), seed=SEED)
    return v.select("word", F.size("vector").alias("dim"))


@query("pca")
def pca(spark, sf_dir):
    """Centred PCA to 50 components fitted on the train split, applied to the test split: each row's
    squared norm in the components, and the share of the train split's variance that they explain."""
    tr, te = _train_test(spark, sf_dir)
    _, out, model = MD.pca(tr, te, k=50)
    v = vector_to_array("pca")
    return out.select("vec_id", F.size(v).alias("k"), F.round(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x), 4).alias("squared_norm"),
                      F.lit(round(float(sum(model.stages[-1].explainedVariance)), 6)).alias("explained"))


@query("encode_batches", sql="SELECT doc_id, 256 AS dim, 1.0::DOUBLE AS norm FROM documents")
def encode_batches(spark, sf_dir):
    """Pluggable batch sentence encoder over every document, cached to Parquet."""
    docs = table(spark, sf_dir, "documents")
    emb = MD.encode_batches(docs, "text", "doc_id", dim=256)
    path = scratch_path(spark, "encoded")
    emb.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path).select(
        "doc_id", F.size("embedding").alias("dim"),
        F.round(F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x)), 4).alias("norm"))
