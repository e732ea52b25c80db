"""Classifiers as Spark ML jobs (M1-M16), word-vector training (E1, E2), PCA (E14) and a
pluggable batch encoder (E15).

Inputs are DataFrames with an ML ``Vector`` features column (``with_features`` converts
array<float> columns) and an integer label. Fitting is MLlib's distributed optimisers;
the driver only coordinates iterations. Where the reference uses an estimator MLlib lacks,
the closest published method is composed from MLlib pieces (noted per function).
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (DecisionTreeClassifier, GBTClassifier, LinearSVC, LogisticRegression,
                                       MultilayerPerceptronClassifier, NaiveBayes, OneVsRest,
                                       RandomForestClassifier)
from pyspark.ml.feature import PCA, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as Ty

from tessera.functions.arrays import argmax
from tessera.operators.aggregates import balanced_class_weights, sample_weights
from tessera.operators import wide_svm
from tessera.operators.indexing import materialize

WIDE_CLASS = 1 << 19  # columns of the classes fitted at a time
WIDE = 1 << 20        # columns


def with_features(df: DataFrame, vec: str, out: str = "features") -> DataFrame:
    return df.withColumn(out, array_to_vector(F.col(vec).cast("array<double>")))


def predict(model, df: DataFrame, keep=("vec_id", "label")) -> DataFrame:
    """(keep..., prediction int, probability array<double> when the model has one)."""
    out = model.transform(df)
    cols = [c for c in keep if c in out.columns] + [F.col("prediction").cast("int").alias("prediction")]
    if "probability" in out.columns:
        cols.append(vector_to_array("probability").alias("probability"))
    return out.select(*cols)


# M12
def with_class_weights(df: DataFrame, label: str = "label", normalize: bool = False, out: str = "weight") -> DataFrame:
    """Balanced class weights (A6) attached per row (J6); the mean weight over rows is 1."""
    return sample_weights(df, balanced_class_weights(df, label, normalize), label, out)


def replicate_by_weight(df: DataFrame, weight: str = "weight") -> DataFrame:
    """For estimators without weightCol (MLP): repeat each row round(w / min w) times."""
    mn = df.agg(F.min(weight)).first()[0]  # one scalar
    reps = F.greatest(F.lit(1), F.round(F.col(weight) / F.lit(mn)).cast("int"))
    return df.withColumn("_rep", F.explode(F.array_repeat(F.lit(1), reps))).drop("_rep")


# M1
def train_logreg(df, features="features", label="label", weight=None, reg=0.0, max_iter=100):
    lr = LogisticRegression(featuresCol=features, labelCol=label, regParam=reg, maxIter=max_iter, family="multinomial")
    if weight:
        lr.setWeightCol(weight)
    return lr.fit(df)


# M2
def train_gaussian_nb(df, features="features", label="label", weight=None):
    nb = NaiveBayes(featuresCol=features, labelCol=label, modelType="gaussian")
    if weight:
        nb.setWeightCol(weight)
    return nb.fit(df)


def gaussian_nb_fit(df: DataFrame, vec: str, label: str = "label", var_smoothing: float = 1e-9) -> dict:
    """Gaussian naive Bayes as aggregates: class priors, per-class means and population
    variances (+ var_smoothing * the largest overall variance). The fitted model is k x d
    numbers, returned to the driver."""
    from pyspark.ml.stat import Summarizer
    v = with_features(df, vec, "_f")
    per = v.groupBy(label).agg(Summarizer.metrics("mean", "variance", "count").summary(F.col("_f")).alias("s"))
    allv = v.agg(Summarizer.metrics("variance", "count").summary(F.col("_f")).alias("s")).first()["s"]
    n_all = allv["count"]
    eps = var_smoothing * float(np.max(allv["variance"].toArray() * (n_all - 1) / n_all))
    rows = sorted(per.collect(), key=lambda r: r[label])
    classes = [r[label] for r in rows]
    counts = np.array([r["s"]["count"] for r in rows], dtype=float)
    means = np.array([r["s"]["mean"].toArray() for r in rows])
    var = np.array([r["s"]["variance"].toArray() * (c - 1) / c if c > 1 else np.zeros(means.shape[1])
                    for r, c in zip(rows, counts)]) + eps
    return {"classes": classes, "log_prior": np.log(counts / counts.sum()), "means": means, "var": var}


def gaussian_nb_predict(model: dict, df: DataFrame, vec: str, out: str = "prediction") -> DataFrame:
    """Joint log-likelihood of every class as one array expression (no join), argmax."""
    x = F.col(vec).cast("array<double>")
    lls = []
    for c, lp, mu, var in zip(model["classes"], model["log_prior"], model["means"], model["var"]):
        const = float(lp - 0.5 * np.sum(np.log(2.0 * np.pi * var)))
        mu_l = F.array(*[F.lit(float(m)) for m in mu])
        iv_l = F.array(*[F.lit(float(1.0 / (2.0 * s))) for s in var])
        quad = F.aggregate(F.zip_with(F.zip_with(x, mu_l, lambda a, b: (a - b) * (a - b)), iv_l, lambda a, b: a * b),
                           F.lit(0.0), lambda acc, t: acc + t)
        lls.append(F.lit(const) - quad)
    classes = F.array(*[F.lit(int(c)) for c in model["classes"]])
    return df.withColumn("_ll", F.array(*lls)).withColumn(out, F.element_at(classes, argmax("_ll") + 1)).drop("_ll")


# M3
def train_tree(df, features="features", label="label", max_depth=5, seed=42, weight=None):
    t = DecisionTreeClassifier(featuresCol=features, labelCol=label, maxDepth=max_depth, seed=seed)
    if weight:
        t.setWeightCol(weight)
    return t.fit(df)


# M4
def train_forest(df, features="features", label="label", n_trees=100, seed=42):
    return RandomForestClassifier(featuresCol=features, labelCol=label, numTrees=n_trees, seed=seed).fit(df)


# M5
def train_boosted(df, features="features", label="label", weight=None, seed=42, max_iter=100, max_depth=6):
    """Boosted trees: one-vs-rest gradient-boosted trees (MLlib GBT is binary), with the rounds and
    depth that XGBClassifier has by default."""
    gbt = GBTClassifier(maxIter=max_iter, maxDepth=max_depth, seed=seed)
    ovr = OneVsRest(classifier=gbt, featuresCol=features, labelCol=label, parallelism=4)
    if weight:
        ovr.setWeightCol(weight)
    return ovr.fit(df)


# M6
class SammeModel:
    def __init__(self, trees, alphas, classes):
        self.trees, self.alphas, self.classes = trees, alphas, classes

    def transform(self, df: DataFrame, features="features") -> DataFrame:
        """Each tree adds its own prediction column (no joins); the alpha-weighted votes
        are summed per class and the top class wins."""
        out = df
        for i, t in enumerate(self.trees):
            m = t.copy().setFeaturesCol(features).setPredictionCol(f"_p{i}") \
                 .setRawPredictionCol(f"_raw{i}").setProbabilityCol(f"_prob{i}")
            out = m.transform(out).drop(f"_raw{i}", f"_prob{i}")
        score = F.array(*[sum((F.when(F.col(f"_p{i}") == c, F.lit(a)).otherwise(F.lit(0.0))
                               for i, a in enumerate(self.alphas)), F.lit(0.0)) for c in self.classes])
        classes = F.array(*[F.lit(int(c)) for c in self.classes])
        return out.withColumn("prediction", F.element_at(classes, argmax(score) + 1)) \
                  .drop(*[f"_p{i}" for i in range(len(self.trees))])


def train_adaboost(df, features="features", label="label", weight=None, rounds=100, depth=2, seed=42,
                   id_col="vec_id"):
    """SAMME: each round fits a depth-``depth`` tree with the current sample weights,
    alpha = ln((1 - err) / err) + ln(K - 1), weights of misclassified rows times e^alpha,
    renormalised. The weighted table is checkpointed every tenth round (short lineage, and it
    survives executor loss). Fails if no tree beats chance."""
    classes = sorted(r[0] for r in df.select(label).distinct().collect())  # the label set: k values
    K = len(classes)
    w0 = F.col(weight) if weight else F.lit(1.0)
    cur = materialize(df.select(F.col(id_col).alias("_row"), features, label, w0.cast("double").alias("_w")))
    tot = cur.agg(F.sum("_w")).first()[0]
    cur = cur.withColumn("_w", F.col("_w") / F.lit(tot))
    trees, alphas = [], []
    for r in range(rounds):
        t = DecisionTreeClassifier(featuresCol=features, labelCol=label, maxDepth=depth, seed=seed + r,
                                   weightCol="_w").fit(cur)
        p = t.transform(cur).withColumn("_miss", (F.col("prediction") != F.col(label)).cast("double"))
        err = p.agg((F.sum(F.col("_w") * F.col("_miss")) / F.sum("_w")).alias("e")).first()["e"]
        if err >= 1.0 - 1.0 / K:
            break
        err = max(err, 1e-10)
        alpha = math.log((1 - err) / err) + math.log(K - 1)
        trees.append(t)
        alphas.append(alpha)
        if err <= 1e-10:
            break
        # weights sum to 1, so the new total is (1 - err) + e^alpha * err: no extra job
        norm = (1.0 - err) + math.exp(alpha) * err
        cur = p.select("_row", features, label,
                       (F.col("_w") * F.exp(F.lit(alpha) * F.col("_miss")) / F.lit(norm)).alias("_w"))
        if (r + 1) % 10 == 0:
            cur = materialize(cur)  # cut lineage every 10 rounds
    if not trees:
        raise ValueError("no tree is better than chance, so there is nothing to vote")
    return SammeModel(trees, alphas, classes)


# M7
def train_linear_svm(df, features="features", label="label", c=1.0, max_iter=50, weight=None):
    """Linear SVM one-vs-rest (binary fits run concurrently); C maps to regParam = 1 / (C * n).
    ``weight``: row weights of the hinge loss (class weights by M12). MLlib keeps some thirty vectors as long
    as a row per class in the driver: wide rows are fitted with fewer classes at a time (four up to ``WIDE_CLASS / 4``
    columns), and from ``WIDE`` columns on the same loss is minimised in blocks of columns, whose every step is many jobs."""
    n = df.count()
    one = df.select(features).first()
    columns = 0 if one is None else len(one[0])
    if columns >= WIDE:
        return wide_svm.fit(df, features, label, 1.0 / (c * n), max_iter, weight)
    svc = LinearSVC(regParam=1.0 / (c * n), maxIter=max_iter)
    ovr = OneVsRest(classifier=svc, featuresCol=features, labelCol=label, parallelism=max(1, min(4, WIDE_CLASS // max(1, columns))))
    if weight:
        ovr.setWeightCol(weight)
    return ovr.fit(df)


# M8
def rff_features(df: DataFrame, vec: str, dim_in: int, n_features: int = 256, gamma: float = 0.1, seed: int = 42,
                 out: str = "features") -> DataFrame:
    """Random Fourier features for an RBF kernel exp(-gamma |x - y|^2): z = sqrt(2/D) cos(Wx + b),
    W ~ N(0, 2 gamma), b ~ U(0, 2 pi). Vectorised per Arrow batch with ``mapInPandas``
    (one matrix product per batch); W (D x d) is a fixed parameter shipped with the task."""
    import pandas as pd
    rng = np.random.default_rng(seed)
    W = rng.normal(0.0, math.sqrt(2.0 * gamma), size=(n_features, dim_in))
    b = rng.uniform(0.0, 2 * math.pi, size=n_features)
    scale = math.sqrt(2.0 / n_features)
    schema = Ty.StructType(list(df.schema.fields) + [Ty.StructField("_rff", Ty.ArrayType(Ty.DoubleType()))])

    def run(batches):
        for pdf in batches:
            if pdf.empty:
                yield pdf.assign(_rff=pd.Series(dtype=object))
                continue
            X = np.stack(pdf[vec].to_numpy()).astype(np.float64)
            Z = scale * np.cos(X @ W.T + b)
            yield pdf.assign(_rff=list(Z))

    return df.mapInPandas(run, schema).withColumn(out, array_to_vector("_rff")).drop("_rff")


def train_rff_svm(df, features="features", label="label", c=1.0, weight=None):
    return train_linear_svm(df, features, label, c, weight=weight)


def tensor_sketch(dim_in: int, degree: int, n_features: int, gamma: float, coef0: float, seed: int = 42):
    """Function (n, dim_in) -> (n, n_features) whose inner products estimate (gamma x.y + coef0)**degree
    (TensorSketch): ``degree`` count sketches of [sqrt(gamma) x, sqrt(coef0)] are multiplied in the
    frequency domain. Unbiased; the variance of an estimate is at most
    (3**degree - 1) / n_features * (gamma |x|^2 + coef0)**degree * (gamma |y|^2 + coef0)**degree."""
    if gamma < 0 or coef0 < 0 or degree < 1:
        raise ValueError("gamma and coef0 must not be negative, degree at least 1")
    rng = np.random.default_rng(seed)
    bucket = rng.integers(0, n_features, (degree, dim_in + 1))
    sign = rng.choice([-1.0, 1.0], (degree, dim_in + 1))

    def sketch(x: np.ndarray) -> np.ndarray:
        x = np.concatenate([math.sqrt(gamma) * x, np.full((len(x), 1), math.sqrt(coef0))], axis=1)
        product = 1.0
        for h, s in zip(bucket, sign):
            one = np.zeros((len(x), n_features))
            for i, b in enumerate(h):
                one[:, b] += s[i] * x[:, i]
            product = product * np.fft.rfft(one, axis=1)
        return np.fft.irfft(product, n_features, axis=1)

    return sketch


def poly_features(df: DataFrame, vec: str, dim_in: int, degree: int = 5, n_features: int = 1024, gamma: float = 1.0, coef0: float = 0.0,
                  seed: int = 42, out: str = "features") -> DataFrame:
    """Adds the TensorSketch of a polynomial kernel as an ML vector, one Arrow batch at a time. The hash
    tables (degree x dim_in) are the only parameters shipped. Rows without a vector get null."""
    sketch = tensor_sketch(dim_in, degree, n_features, gamma, coef0, seed)

    @F.pandas_udf("array<double>")
    def features(v: pd.Series) -> pd.Series:
        made = pd.Series([None] * len(v), index=v.index, dtype=object)
        there = v.notna()
        for lo in range(0, int(there.sum()), 512):  # one block's sketches at a time
            at = v.index[there][lo:lo + 512]
            for i, row in zip(at, sketch(np.stack(v[at].to_numpy()).astype(np.float64))):
                made[i] = row
        return made

    return df.withColumn("_ts", features(F.col(vec).cast("array<double>"))).withColumn(
        out, F.when(F.col("_ts").isNotNull(), array_to_vector("_ts"))).drop("_ts")


def train_poly_svm(df, features="features", label="label", c=1.0, weight=None, max_iter=50):
    """Polynomial-kernel SVM: a linear one on ``poly_features``."""
    return train_linear_svm(df, features, label, c, max_iter, weight)


# M9
class OneVsOneModel:
    def __init__(self, models):
        self.models = models  # (a, b, model) with label 1.0 meaning b

    def transform(self, df: DataFrame, features: str = "features") -> DataFrame:
        """Every pair's model adds its vote as a column (one pass, no joins); the class with
        the most votes wins, ties go to the smaller one."""
        out, extra = df, []
        for i, (a, b, m) in enumerate(self.models):
            m = m.copy().setFeaturesCol(features).setPredictionCol(f"_p{i}")
            for col in ("rawPrediction", "probability"):
                if m.hasParam(f"{col}Col"):
                    m.set(m.getParam(f"{col}Col"), f"_{col}{i}")
                    extra.append(f"_{col}{i}")
            out = m.transform(out)
        classes = sorted({c for a, b, _ in self.models for c in (a, b)})
        votes = F.array(*[sum((F.when(F.col(f"_p{i}") == (1.0 if c == b else 0.0), F.lit(1.0)).otherwise(F.lit(0.0))
                               for i, (a, b, _) in enumerate(self.models) if c in (a, b)), F.lit(0.0)) for c in classes])
        best = F.element_at(F.array(*[F.lit(c) for c in classes]), argmax(votes) + 1)
        return out.withColumn("prediction", best).drop(*extra, *[f"_p{i}" for i in range(len(self.models))])


def one_vs_one(df, estimator_factory, features="features", label="label"):
    """K(K-1)/2 binary fits on the rows of each class pair; prediction = most votes
    (ties -> smallest label)."""
    classes = sorted(r[0] for r in df.select(label).distinct().collect())  # the label set
    models = []
    for a, b in itertools.combinations(classes, 2):
        pair = df.where(F.col(label).isin(a, b)).withColumn("_y", (F.col(label) == b).cast("double"))
        est = estimator_factory().setFeaturesCol(features).setLabelCol("_y")
        models.append((a, b, est.fit(pair)))
    return OneVsOneModel(models)


# M11
def train_mlp(df, layers, features="features", label="label", seed=42, max_iter=100):
    return MultilayerPerceptronClassifier(featuresCol=features, labelCol=label, layers=list(layers), seed=seed,
                                          maxIter=max_iter).fit(df)


# M13
def search(df, estimator, grid: dict, fold_col=None, k=5, metric="f1", n_iter=None, seed=42, parallelism=4):
    """Grid or seeded random search with k-fold cross-validation (``CrossValidator``).
    ``grid`` maps Param objects to value lists. The evaluator's ``f1`` is support-weighted."""
    from pyspark.ml.evaluation import MulticlassClassificationEvaluator
    b = ParamGridBuilder()
    for p, vals in grid.items():
        b = b.addGrid(p, list(vals))
    maps = b.build()
    if n_iter and n_iter < len(maps):
        rng = np.random.default_rng(seed)
        maps = [maps[i] for i in sorted(rng.choice(len(maps), size=n_iter, replace=False))]
    ev = MulticlassClassificationEvaluator(labelCol=estimator.getLabelCol(), metricName=metric)
    cv = CrossValidator(estimator=estimator, estimatorParamMaps=maps, evaluator=ev, parallelism=parallelism, seed=seed)
    if fold_col:
        cv.setFoldCol(fold_col).setNumFolds(k)
    else:
        cv.setNumFolds(k)
    return cv.fit(df)


def search_results(cv_model) -> list[tuple[dict, float]]:
    return [({p.name: v for p, v in m.items()}, float(s))
            for m, s in zip(cv_model.getEstimatorParamMaps(), cv_model.avgMetrics)]


# M14
def cross_val_score(df: DataFrame, fit_fn, fold_col="fold", label="label", id_col="vec_id") -> DataFrame:
    """Fit on all folds but one, macro-F1 on the held-out fold; one row per fold."""
    from tessera.operators.metrics import per_class_scores
    folds = sorted(r[0] for r in df.select(fold_col).distinct().collect())  # k fold ids
    out = None
    for f in folds:
        m = fit_fn(df.where(F.col(fold_col) != f))
        p = predict(m, df.where(F.col(fold_col) == f), keep=(id_col, label))
        s = per_class_scores(p, label, "prediction").agg(F.avg("f1").alias("macro_f1")).select(
            F.lit(f).alias(fold_col), "macro_f1")
        out = s if out is None else out.unionByName(s)
    return out


# M15
def compare_estimators(train: DataFrame, test: DataFrame, estimators: dict, label="label", id_col="vec_id") -> DataFrame:
    """(model, split, accuracy, macro_precision, macro_recall, macro_f1, kappa, macro_auc) for each
    named fit function. A fit function returns a model, or a function from a part to its predictions
    where the model is a join. The AUC is null where there are no probabilities."""
    from tessera.operators.metrics import accuracy, cohen_kappa, per_class_scores, roc_auc
    rows = []
    for name, fit_fn in estimators.items():
        m = fit_fn(train)
        for split, part in (("train", train), ("test", test)):
            p = materialize(m(part) if callable(m) else predict(m, part, keep=(id_col, label)))
            acc = accuracy(p).first()[0]
            macro = per_class_scores(p).agg(F.avg("precision"), F.avg("recall"), F.avg("f1")).first()
            kappa = cohen_kappa(p).first()[0]
            auc = float(roc_auc(p).where("class = -1").first()["auc"]) if "probability" in p.columns else None
            rows.append((name, split, float(acc), *map(float, macro), float(kappa), auc))
    return train.sparkSession.createDataFrame(rows, "model string, split string, accuracy double, macro_precision double, macro_recall double, "
                                                    "macro_f1 double, kappa double, macro_auc double")


# M16
def score_texts(df: DataFrame, text_col: str, vectors: DataFrame, model, stopwords=(), suffixes=(),
                min_stem=2, doc_col="doc_id", dim=None) -> DataFrame:
    """clean -> tokens -> mean-pooled vector -> model: (doc, prediction, probability)."""
    from tessera.functions.text import clean_tokens
    from tessera.operators.embed import mean_pool
    toks = df.select(doc_col, clean_tokens(text_col, stopwords, suffixes, min_stem).alias("tokens"))
    emb = with_features(mean_pool(toks, vectors, doc_col, "tokens", dim), "embedding")
    return predict(model, emb, keep=(doc_col,))


# S8
def fit_pipeline(df: DataFrame, stages) -> PipelineModel:
    return Pipeline(stages=list(stages)).fit(df)


# E1 / E2
def train_word2vec(tokens_df: DataFrame, tokens="tokens", size=100, window=6, min_count=1, epochs=1, seed=42,
                   step=0.025, id_col="doc_id") -> DataFrame:
    """Skip-gram with 5 noise words (``word_vectors.train_vectors``): MLlib's Word2Vec holds the
    vocabulary and both its matrices in the driver. Returns the vector table (word, vector array<float>)."""
    from tessera.operators.word_vectors import train_vectors
    params = train_vectors(tokens_df, tokens, id_col, size=size, window=window, min_count=min_count, epochs=epochs,
                           sg=True, rate=step, sample=0, seed=seed)
    return params.where("kind = 'i'").select(F.col("unit").alias("word"), "vector")


def train_glove_like(tokens_df: DataFrame, tokens="tokens", size=100, window=5, epochs=15, seed=42) -> DataFrame:
    """E2 with the reference's settings: every word gets a vector, trained over ``epochs`` passes."""
    return train_word2vec(tokens_df, tokens, size=size, window=window, min_count=1, epochs=epochs, seed=seed)


# E14
def pca(train: DataFrame, others: DataFrame, features="features", k=50):
    """Centred PCA fitted on ``train`` only and applied to both (Spark's PCA does not centre,
    so a mean-only StandardScaler comes first). Returns (train_out, others_out, model)."""
    model = Pipeline(stages=[StandardScaler(inputCol=features, outputCol="_c", withMean=True, withStd=False),
                             PCA(k=k, inputCol="_c", outputCol="pca")]).fit(train)
    return model.transform(train).drop("_c"), model.transform(others).drop("_c"), model


# E15
def hashed_trigram_encoder(dim: int = 256):
    """Default pluggable sentence encoder: L2-normalised bag of hashed byte trigrams of the
    lower-cased UTF-8 text (a few numpy operations per text)."""
    def encode(texts):
        out = np.zeros((len(texts), dim), dtype=np.float32)
        for i, t in enumerate(texts):
            a = np.frombuffer(f"  {t or ''}  ".lower().encode("utf-8"), dtype=np.uint8).astype(np.int64)
            if a.size >= 3:
                h = (a[:-2] * 1000003 + a[1:-1] * 10007 + a[2:]) % dim
                v = np.bincount(h, minlength=dim).astype(np.float32)
                n = float(np.linalg.norm(v))
                out[i] = v / n if n > 0 else v
        return out
    return encode


def encode_batches(df: DataFrame, text_col: str, id_col: str, fn=None, dim: int = 256) -> DataFrame:
    """Apply a batch encoder (texts -> float matrix) with ``mapInPandas``: Arrow batches per
    partition, no driver round trip. (id, embedding array<float>)."""
    import pandas as pd
    fn = fn or hashed_trigram_encoder(dim)
    schema = Ty.StructType([Ty.StructField(id_col, df.schema[id_col].dataType),
                            Ty.StructField("embedding", Ty.ArrayType(Ty.FloatType()))])

    def run(batches):
        for pdf in batches:
            emb = fn(pdf[text_col].tolist())
            yield pd.DataFrame({id_col: pdf[id_col], "embedding": list(emb)})

    return df.select(id_col, text_col).mapInPandas(run, schema)


__all__ = [n for n in dir() if not n.startswith("_")]
