"""Classifiers over dense vectors, PCA and the embedding interface (Spark MLlib)."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, LinearSVC, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import PCA, HashingTF, Normalizer, RegexTokenizer, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SEED = 42


def with_vector(rows: DataFrame, array: str) -> DataFrame:
    return rows.withColumn("features", array_to_vector(F.col(array).cast("array<double>")))


def stages(name: str, n_train: int) -> list:
    """LightGBM and XGBoost are stood in for by Spark's own gradient-boosted trees."""
    scale = StandardScaler(withMean=True, inputCol="features", outputCol="scaled")
    return {
        "RandomForest": [RandomForestClassifier(numTrees=100, maxDepth=10, seed=SEED)],
        "LogisticRegression": [scale, LogisticRegression(featuresCol="scaled", maxIter=1000, regParam=1.0 / max(1, n_train))],
        "SVM": [scale, LinearSVC(featuresCol="scaled", maxIter=100)],
        "XGBoost": [GBTClassifier(maxIter=100, maxDepth=6, stepSize=0.3, seed=SEED)],
        "LightGBM": [GBTClassifier(maxIter=100, maxDepth=5, stepSize=0.1, seed=SEED)],
    }[name]


def margin(df: DataFrame) -> DataFrame:
    return df.withColumn("margin", array_to_vector(F.array(vector_to_array("rawPrediction")[1])))


class Calibrated:
    """A margin classifier with probabilities: a logistic curve fitted on out-of-fold margins."""

    def __init__(self, train: DataFrame, folds: int = 5):
        fold = train.withColumn("__fold", F.pmod(F.xxhash64("row_id"), F.lit(folds)))
        n = train.count()
        parts = None
        for k in range(folds):
            model = Pipeline(stages=stages("SVM", n)).fit(fold.where(F.col("__fold") != k))
            part = margin(model.transform(fold.where(F.col("__fold") == k))).select("margin", "label")
            parts = part if parts is None else parts.unionByName(part)
        self.curve = LogisticRegression(featuresCol="margin").fit(parts)
        self.model = Pipeline(stages=stages("SVM", n)).fit(train)

    def transform(self, rows: DataFrame) -> DataFrame:
        scored = margin(self.model.transform(rows)).drop("rawPrediction", "prediction")
        return self.curve.transform(scored)


def fit(train: DataFrame, name: str):
    """train: row_id, features, label (double)."""
    return Calibrated(train) if name == "SVM" else Pipeline(stages=stages(name, train.count())).fit(train)


def scores(model, rows: DataFrame, threshold: float = 0.5) -> DataFrame:
    """row_id, y_true, y_prob, y_pred."""
    p = vector_to_array(F.col("probability"))[1]
    return model.transform(rows).select("row_id", F.col("label").cast("int").alias("y_true"), p.cast("float").alias("y_prob"), (p >= threshold).cast("int").alias("y_pred"))


def _pca(rows: DataFrame):
    """Mean-centred vectors and the model of their first two components."""
    centred = StandardScaler(withMean=True, withStd=False, inputCol="features", outputCol="c").fit(rows).transform(rows)
    return centred, PCA(k=2, inputCol="c", outputCol="p").fit(centred)


def pca_2d(rows: DataFrame) -> DataFrame:
    """row_id, x, y of mean-centred vectors. Of either sign of a component the one whose largest weight by size is positive."""
    centred, model = _pca(rows)
    weights = model.pc.toArray()
    sign = [1.0 if w[abs(w).argmax()] >= 0 else -1.0 for w in weights.T]
    out = model.transform(centred).withColumn("a", vector_to_array("p"))
    return out.select("row_id", F.round(F.col("a")[0] * sign[0], 6).alias("x"), F.round(F.col("a")[1] * sign[1], 6).alias("y"))


def pca_variance(rows: DataFrame) -> DataFrame:
    """component, share: the explained share of the variance of either component."""
    shares = _pca(rows)[1].explainedVariance.toArray()
    return rows.sparkSession.createDataFrame([(i + 1, round(float(v), 9)) for i, v in enumerate(shares)], "component int, share double")


def hashed_embedding(rows: DataFrame, text: str, dim: int = 256) -> DataFrame:
    """The deterministic embedder behind the embedding interface: hashed word counts of unit length, as array vec."""
    words = RegexTokenizer(inputCol="__t", outputCol="__w", pattern=r"\W+")
    model = Pipeline(stages=[words, HashingTF(numFeatures=dim, inputCol="__w", outputCol="__h"), Normalizer(inputCol="__h", outputCol="__v")])
    base = rows.withColumn("__t", F.coalesce(F.col(text), F.lit(" ")))
    return model.fit(base).transform(base).withColumn("vec", vector_to_array("__v", "float32")).drop("__t", "__w", "__h", "__v")
