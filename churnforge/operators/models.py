"""Churn classifiers: class-weighted logistic regression (production
model), decision tree, random forest, gradient-boosted trees, a positive-weight
boosted variant, and their unweighted baselines.

Fits are distributed jobs (gradient / histogram aggregation) of MLlib, those of boosted trees of ``boosting``; the loop
over models runs on the driver but every fit and every metric is a Spark job.
Predictions of all models are stacked and scored in one aggregation pass.
"""

from __future__ import annotations

import math
import time
from dataclasses import dataclass, field

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import DecisionTreeClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnforge.functions import constants as K
from churnforge.operators import evaluate as E
from churnforge.operators import features as FE
from churnforge.operators import newton
from churnforge.operators.boosting import BoostedTrees
from churnforge.operators.forest import BaggedTrees
from churnforge.operators.stats import union_all

LABEL = "Churn"
KEY = "customerID"


@dataclass
class TrainingData:
    encoding: FE.ChurnEncoding
    scaling: FE.Scaling
    train: DataFrame       # key, features (scaled), label, weight, pos_weight
    test: DataFrame
    all_rows: DataFrame    # every row, scaled, with is_test
    n_train: int
    scale_pos_weight: float

    @property
    def feature_columns(self) -> list[str]:
        return self.encoding.feature_columns


def prepare_training(df: DataFrame, key: str = KEY) -> TrainingData:
    """Features → 80/20 hash split → scaling fitted on train → balanced and positive weights.

    An ``is_test`` column that is there already is the split. The features are checkpointed (shared checkpoint folder); scaling, fits
    and metrics then read them instead of recomputing the feature plan. They are stored in even parts, as many as there are cores or
    more, if they get ``LEAST_ROWS`` each: a small file is one split, and its fits, hundreds of passes, would run in one task.
    """
    feats, enc = FE.churn_features(df, key=key, passthrough=("is_test",))
    split = feats if "is_test" in feats.columns else FE.split_80_20(feats, key)
    split = split.checkpoint(eager=True)
    counts, largest = _counts_and_largest_part(split.filter(F.col("is_test") == 0))
    n_train = sum(counts.values())
    parts = max(min(df.sparkSession.sparkContext.defaultParallelism, n_train // LEAST_ROWS), math.ceil(n_train / PART_ROWS))
    if largest * parts > UNEVEN * n_train:
        split = split.repartition(parts).checkpoint(eager=True)
    scale_cols = [c for c in K.NUM_COLS if c in enc.feature_columns]
    scaling = FE.fit_scaling(split.filter(F.col("is_test") == 0), scale_cols)
    pos, neg = counts.get(1, 0), counts.get(0, 0)
    spw = max(1.0, neg / max(pos, 1))
    k = len(counts)
    wexpr = F.lit(0.0)
    for cls, n in counts.items():
        wexpr = F.when(F.col(LABEL) == cls, F.lit(n_train / (k * n))).otherwise(wexpr)
    scaled = (scaling.apply(split).withColumn("weight", wexpr)
              .withColumn("pos_weight", F.when(F.col(LABEL) == 1, F.lit(spw)).otherwise(F.lit(1.0))))
    return TrainingData(enc, scaling, scaled.filter(F.col("is_test") == 0), scaled.filter(F.col("is_test") == 1),
                        scaled, n_train, spw)


LEAST_ROWS = 20_000  # train rows that are worth a task of their own
PART_ROWS = 1_000_000  # train rows in a part, where there are more parts than cores
UNEVEN = 1.5  # the largest part's rows over an even share, above which the rows are dealt out again


def _counts_and_largest_part(train: DataFrame) -> tuple[dict[int, int], int]:
    """Rows of every class, and of the largest partition, from one aggregate."""
    classes: dict[int, int] = {}
    parts: dict[int, int] = {}
    for r in train.groupBy(LABEL, F.spark_partition_id().alias("part")).count().collect():
        classes[r[LABEL]] = classes.get(r[LABEL], 0) + r["count"]
        parts[r["part"]] = parts.get(r["part"], 0) + r["count"]
    return classes, max(parts.values(), default=0)


@dataclass
class ModelSpec:
    name: str
    estimator: object
    weighted: bool = True


def model_specs(n_train: int, weighted: bool = True, seed: int = 42) -> list[ModelSpec]:
    """The reference's model line-up re-expressed with MLlib estimators."""
    w = "weight"
    if weighted:
        return [
            ModelSpec("Logistic Regression", LogisticRegression(
                labelCol=LABEL, weightCol=w, regParam=1.0 / n_train, elasticNetParam=0.0,
                standardization=False, maxIter=1000, tol=1e-8)),
            ModelSpec("Decision Tree", DecisionTreeClassifier(labelCol=LABEL, weightCol=w, maxDepth=30, seed=seed)),
            ModelSpec("Random Forest", BaggedTrees(
                labelCol=LABEL, weightCol=w, numTrees=200, maxDepth=10, minInstancesPerNode=2,
                featureSubsetStrategy="sqrt", seed=seed)),
            ModelSpec("Gradient Boosting", BoostedTrees(
                labelCol=LABEL, weightCol=w, maxIter=150, stepSize=0.05, maxDepth=5, subsamplingRate=0.8, seed=seed)),
            ModelSpec("Boosted (pos-weight)", BoostedTrees(
                labelCol=LABEL, weightCol="pos_weight", maxIter=200, stepSize=0.05, maxDepth=6,
                subsamplingRate=0.8, featureSubsetStrategy="0.8", seed=seed)),
        ]
    return [
        ModelSpec("Logistic Regression", LogisticRegression(labelCol=LABEL, regParam=1.0 / n_train,
                                                            standardization=False, maxIter=100), False),
        ModelSpec("Random Forest", RandomForestClassifier(labelCol=LABEL, numTrees=100, maxDepth=30, maxMemoryInMB=512, seed=seed), False),
        ModelSpec("Gradient Boosting", BoostedTrees(labelCol=LABEL, maxIter=100, stepSize=0.1, maxDepth=3,
                                                     seed=seed), False),
        ModelSpec("Boosted", BoostedTrees(labelCol=LABEL, maxIter=100, stepSize=0.3, maxDepth=6, seed=seed), False),
    ]


def fit_model(data: TrainingData, spec: ModelSpec) -> tuple[PipelineModel, float]:
    """Assemble features and fit; returns the pipeline model and the fit time in seconds."""
    assembler = VectorAssembler(inputCols=data.feature_columns, outputCol="features")
    pipe = Pipeline(stages=[assembler, spec.estimator])
    t0 = time.perf_counter()
    model = pipe.fit(data.train)
    return model, time.perf_counter() - t0


def convergence(model: PipelineModel) -> str | None:
    """How an iterative linear fit ended; None for models that do not iterate to a tolerance."""
    est = model.stages[-1]
    if not hasattr(est, "coefficients") or not est.hasSummary:
        return None
    history, most = list(est.summary.objectiveHistory), est.getMaxIter()
    steps = len(history) - 1
    last = abs(history[-2] - history[-1]) / max(abs(history[-1]), 1e-12) if steps > 0 else 0.0
    state = "converged" if steps < most and last <= STILL else "not converged"
    return f"{state} after {steps} iterations, last relative change {last:.1e}"


STILL = 1e-4  # a fit that stops with a larger change of its objective gave up


def predict(model: PipelineModel, df: DataFrame, name: str | None = None, threshold: float = 0.5,
            keep: tuple = (KEY, LABEL)) -> DataFrame:
    """Class (p > threshold) and probability of churn for every row."""
    out = model.transform(df).select(
        *[F.col(c) for c in keep if c in df.columns],
        vector_to_array("probability")[1].alias("Churn_Probability"))
    out = out.withColumn("Predicted_Churn", (F.col("Churn_Probability") > threshold).cast("int"))
    return out.withColumn("Model", F.lit(name)) if name else out


@dataclass
class ComparisonResult:
    models: dict[str, PipelineModel] = field(default_factory=dict)
    times: dict[str, float] = field(default_factory=dict)
    errors: dict[str, str] = field(default_factory=dict)
    convergence: dict[str, str | None] = field(default_factory=dict)
    metrics: DataFrame | None = None
    test_predictions: DataFrame | None = None


def compare_models(data: TrainingData, specs: list[ModelSpec]) -> ComparisonResult:
    """Fit each spec; score all test predictions stacked, in one metrics pass.

    Fits of many short jobs run side by side first, then the forests and single trees: a job of the first kind would
    wait at every pass for slots that the long tasks of the second hold.
    A failed fit is reported as a row with its error text, not silently skipped.
    """
    from churnforge.plans.concurrency import parallel_map
    res = ComparisonResult()
    preds = []

    def run(spec):
        try:
            return spec, fit_model(data, spec), None
        except Exception as exc:  # reported in the table
            return spec, None, f"{type(exc).__name__}: {exc}"[:300]
    short = [isinstance(s.estimator, (LogisticRegression, BoostedTrees)) for s in specs]
    ran = [out for kind in (True, False) for out in parallel_map(run, [s for s, k in zip(specs, short) if k == kind])]
    for spec, fitted, err in sorted(ran, key=lambda out: specs.index(out[0])):
        if err is not None:
            res.errors[spec.name] = err
            continue
        model, secs = fitted
        res.models[spec.name], res.times[spec.name] = model, secs
        res.convergence[spec.name] = convergence(model)
        preds.append(predict(model, data.test, spec.name))
    spark = data.train.sparkSession
    if preds:
        stacked = union_all(preds).checkpoint(eager=True)  # scored once for the metrics, the AUC and later readers
        m = E.classification_metrics(stacked, group=["Model"])
        auc = E.roc_auc(stacked, group=["Model"])
        times = spark.createDataFrame([(k, float(v), res.convergence[k]) for k, v in res.times.items()],
                                      "Model string, Training_Time double, Convergence string")
        res.metrics = m.join(auc, "Model").join(times, "Model").withColumn("Error", F.lit(None).cast("string"))
        res.test_predictions = stacked
    if res.errors:
        err = spark.createDataFrame([(k, v) for k, v in res.errors.items()], "Model string, Error string")
        for c in ["Accuracy", "Precision", "Recall", "F1_Score", "ROC_AUC", "Training_Time"]:
            err = err.withColumn(c, F.lit(None).cast("double"))
        err = err.withColumn("Convergence", F.lit(None).cast("string"))
        res.metrics = err if res.metrics is None else res.metrics.unionByName(err)
    if res.metrics is not None:
        res.metrics = res.metrics.orderBy(F.col("F1_Score").desc_nulls_last(), "Model")
    return res


def best_model(metrics: DataFrame) -> DataFrame:
    """Top model by accuracy and by F1 (one row)."""
    return metrics.agg(F.max_by("Model", F.struct("Accuracy", F.col("Model"))).alias("Best_By_Accuracy"),
                       F.max("Accuracy").alias("Best_Accuracy"),
                       F.max_by("Model", F.struct("F1_Score", F.col("Model"))).alias("Best_By_F1"),
                       F.max("F1_Score").alias("Best_F1"))


def curves(predictions: DataFrame) -> DataFrame:
    """(Model, Curve, x, y): ROC and precision-recall points of all models in stacked predictions."""
    roc, pr = E.roc_curve(predictions, group=["Model"]), E.pr_curve(predictions, group=["Model"])
    return roc.select("Model", F.lit("ROC").alias("Curve"), F.col("FPR").alias("x"), F.col("TPR").alias("y")).unionByName(
        pr.select("Model", F.lit("PR").alias("Curve"), F.col("Recall").alias("x"), F.col("Precision").alias("y")))


def feature_importance(model: PipelineModel, feature_columns: list[str], top: int = 20) -> DataFrame:
    """|coefficient| for linear models, impurity importance for trees; top n."""
    est = model.stages[-1]
    if hasattr(est, "coefficients"):
        values = [abs(float(v)) for v in est.coefficients.toArray()]
    elif hasattr(est, "featureImportances"):
        values = [float(v) for v in est.featureImportances.toArray()]
    else:
        values = [0.0] * len(feature_columns)
    from pyspark.sql import SparkSession
    spark = SparkSession.getActiveSession()
    rows = list(zip(feature_columns, values))
    df = spark.createDataFrame(rows, "Feature string, Importance double")
    return df.orderBy(F.col("Importance").desc(), "Feature").limit(top)


def learning_curve(data: TrainingData, folds: int = 3, sizes: tuple = (0.2, 0.4, 0.6, 0.8, 1.0), key: str = KEY) -> DataFrame:
    """Mean train / validation F1 of the balanced LR over stratified folds and growing train sizes (see ``newton``).

    A subset with a single class cannot be fitted: ``Error`` says how many folds of a size that befell, and
    the means are over the others. ``Passes`` is the most Newton passes that a fit of the size took.
    """
    return newton.learning_curve(data.train, data.feature_columns, LABEL, key, folds, sizes)


@dataclass
class ChurnModel:
    """All that scoring needs: the fitted vocabulary and feature order, the scaling, and the pipeline model."""
    encoding: FE.ChurnEncoding
    scaling: FE.Scaling
    model: PipelineModel

    def score(self, raw: DataFrame, key: str = KEY, threshold: float = 0.5) -> DataFrame:
        """Probability and class for every raw row; a table without the target column gets no target either."""
        has_target = LABEL in raw.columns
        rows = raw if has_target else raw.withColumn(LABEL, F.lit(None).cast("string"))
        feats, _ = FE.churn_features(rows, self.encoding, key=key)
        return predict(self.model, self.scaling.apply(feats), threshold=threshold, keep=(key, LABEL) if has_target else (key,))

    def save(self, path: str) -> None:
        """One folder: the pipeline, and a table each for vocabulary, feature order and scaling."""
        from pyspark.sql import SparkSession
        spark = SparkSession.getActiveSession()
        self.model.write().overwrite().save(f"{path}/model")
        words = [(c, i, v) for c, vs in self.encoding.vocabulary.items() for i, v in enumerate(vs or [None])]
        tables = {"vocabulary": (words, "column string, place int, value string"),
                  "features": (list(enumerate(self.encoding.feature_columns)), "place int, feature string"),
                  "scaling": ([(c, self.scaling.mean[c], self.scaling.std[c]) for c in self.scaling.mean], "column string, mean double, std double")}
        for name, (rows, schema) in tables.items():
            spark.createDataFrame(rows, schema).write.mode("overwrite").parquet(f"{path}/{name}")

    @staticmethod
    def load(path: str) -> "ChurnModel":
        from pyspark.sql import SparkSession
        spark = SparkSession.getActiveSession()
        vocabulary: dict[str, list[str]] = {}
        for r in spark.read.parquet(f"{path}/vocabulary").orderBy("column", "place").collect():  # as many rows as there are features
            vocabulary.setdefault(r["column"], []).extend([r["value"]] if r["value"] is not None else [])
        features = [r["feature"] for r in spark.read.parquet(f"{path}/features").orderBy("place").collect()]
        scaling = {r["column"]: (r["mean"], r["std"]) for r in spark.read.parquet(f"{path}/scaling").collect()}
        return ChurnModel(FE.ChurnEncoding(vocabulary, features), FE.Scaling({c: m for c, (m, _) in scaling.items()}, {c: s for c, (_, s) in scaling.items()}),
                          PipelineModel.load(f"{path}/model"))
