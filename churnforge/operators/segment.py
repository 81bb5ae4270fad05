"""Customer segmentation: standardise → PCA(2) → k-means, cluster-quality
indices, elbow curve, loadings and covariance.

PCA is an MLlib fit (distributed covariance), k-means the shared passes of ``kmeans``;
the fitted components and centres are parameter-sized, so projection and
nearest-centre assignment are plain column expressions (dot products with
literals) inside whole-stage codegen — no UDF, no per-row Python.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.ml.stat import Correlation
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnforge.operators import features as FE
from churnforge.operators.kmeans import fit_runs
from churnforge.operators.stats import with_params


def _q(c: str) -> F.Column:
    return F.col(f"`{c}`")


@dataclass
class PcaFit:
    feature_columns: list[str]
    components: np.ndarray          # (2, d), sign-fixed: largest |loading| positive
    explained: np.ndarray

    def project(self, df: DataFrame, keep: tuple = ()) -> DataFrame:
        cols = []
        for j in range(self.components.shape[0]):
            expr = None
            for c, w in zip(self.feature_columns, self.components[j]):
                term = _q(c).cast("double") * F.lit(float(w))
                expr = term if expr is None else expr + term
            cols.append(expr.alias(f"PC{j + 1}"))
        return df.select(*[_q(c) for c in keep], *cols)


def fit_pca(scaled: DataFrame, cols: list[str], k: int = 2) -> PcaFit:
    """MLlib PCA on already-centred columns (MLlib does not centre in transform)."""
    vec = VectorAssembler(inputCols=cols, outputCol="_v").transform(scaled.select(*[_q(c) for c in cols]))
    model = PCA(k=k, inputCol="_v", outputCol="_p").fit(vec)
    comps = model.pc.toArray().T.copy()      # (k, d)
    for j in range(comps.shape[0]):
        if comps[j, np.argmax(np.abs(comps[j]))] < 0:
            comps[j] = -comps[j]
    return PcaFit(list(cols), comps, model.explainedVariance.toArray())


def pca_loadings(fit: PcaFit, top: int = 18) -> DataFrame:
    from pyspark.sql import SparkSession
    spark = SparkSession.getActiveSession()
    rows = [(c, float(fit.components[0, i]), float(fit.components[1, i]),
             float(abs(fit.components[0, i]) + abs(fit.components[1, i])))
            for i, c in enumerate(fit.feature_columns)]
    df = spark.createDataFrame(rows, "Feature string, PCA_1_Contribution double, PCA_2_Contribution double, "
                                     "Total_Contribution double")
    return df.orderBy(F.col("Total_Contribution").desc(), "Feature").limit(top)


def covariance_matrix(df: DataFrame, cols: list[str]) -> DataFrame:
    """Sample covariance of every pair (i ≤ j), long form (a, b, cov).

    One MLlib correlation pass (a distributed Gram matrix in the JVM) and one aggregate of
    standard deviations; a constant column has covariance 0 with all.
    """
    row = df.agg(*[F.stddev_samp(_q(c).cast("double")).alias(f"s{i}") for i, c in enumerate(cols)]).first()
    sd = np.array([row[f"s{i}"] or 0.0 for i in range(len(cols))])
    vec = VectorAssembler(inputCols=cols, outputCol="_v").transform(df.select(*[_q(c).cast("double").alias(c) for c in cols]))
    r = np.nan_to_num(Correlation.corr(vec.select("_v"), "_v").first()[0].toArray())
    rows = [(a, b, float(r[i, j] * sd[i] * sd[j])) for i, a in enumerate(cols) for j, b in enumerate(cols) if i <= j]
    return df.sparkSession.createDataFrame(rows, "a string, b string, cov double")


# ---------------------------------------------------------------------------------------
# k-means
# ---------------------------------------------------------------------------------------
@dataclass
class KMeansFit:
    centres: np.ndarray     # (k, dims), relabelled: 0 = largest cluster
    cost: float
    cols: list[str]


def assign_expr(centres: np.ndarray, cols: list[str]) -> F.Column:
    """Index of the nearest centre (squared Euclidean); ties → smaller index.

    Centre j wins when it is strictly nearer than every earlier centre and no
    farther than every later one (common sub-expressions are shared by codegen).
    """
    d = []
    for c in centres:
        expr = None
        for col, v in zip(cols, c):
            term = F.pow(_q(col).cast("double") - F.lit(float(v)), 2)
            expr = term if expr is None else expr + term
        d.append(expr)
    chain = None
    for j in range(len(d)):
        cond = F.lit(True)
        for i in range(len(d)):
            if i != j:
                cond = cond & ((d[j] < d[i]) if i < j else (d[j] <= d[i]))
        chain = F.when(cond, F.lit(j)) if chain is None else chain.when(cond, F.lit(j))
    return chain.cast("int")


def kmeans_assign(df: DataFrame, centres: np.ndarray, cols: list[str], out: str = "Cluster") -> DataFrame:
    return df.withColumn(out, assign_expr(centres, cols))


def fit_kmeans(points: DataFrame, cols: list[str], k: int = 3, n_init: int = 10, seed: int = 42,
               max_iter: int = 300) -> KMeansFit:
    """Best of ``n_init`` starts by cost, all advanced by the same passes; ids relabelled by cluster size."""
    runs = fit_runs(points, cols, [(k, seed + i) for i in range(n_init)], max_iter)
    if not runs:
        raise ValueError("no row has all coordinates")
    best = min(runs, key=lambda r: r.cost)
    order = sorted(range(k), key=lambda j: (-best.sizes[j], tuple(best.centres[j])))
    return KMeansFit(best.centres[order], best.cost, list(cols))


def elbow(points: DataFrame, cols: list[str], ks=range(1, 10), seed: int = 42, n_init: int = 1) -> DataFrame:
    """Inertia per k, the best of ``n_init`` starts; all k and starts share their passes."""
    runs = fit_runs(points, cols, [(k, seed + i) for k in ks for i in range(n_init if k > 1 else 1)])
    rows = [(k, min(r.cost for r in runs if r.k == k)) for k in ks] if runs else []
    return points.sparkSession.createDataFrame(rows, "k int, Inertia double")


def inertia_k1(points: DataFrame, cols: list[str]) -> DataFrame:
    return points.agg((F.count(F.lit(1)) * sum(F.var_pop(_q(c)) for c in cols)).alias("Inertia"))


# ---------------------------------------------------------------------------------------
# cluster-quality indices
# ---------------------------------------------------------------------------------------
def label_guard(df: DataFrame, label: str) -> DataFrame:
    """One row: number of labels and whether indices are defined (1 < labels < rows)."""
    return df.agg(F.count_distinct(_q(label)).alias("Number_of_Clusters"), F.count(F.lit(1)).alias("_n")) \
        .select("Number_of_Clusters", ((F.col("Number_of_Clusters") > 1) & (F.col("Number_of_Clusters") < F.col("_n")))
                .alias("Defined"))


def silhouette_squared(df: DataFrame, cols: list[str], label: str) -> DataFrame:
    """Silhouette with squared Euclidean distance (MLlib, O(n·k), whole table); null when undefined."""
    from pyspark.sql import SparkSession
    spark = SparkSession.getActiveSession()
    g = label_guard(df, label).first()
    value = None
    if g["Defined"]:
        vec = VectorAssembler(inputCols=cols, outputCol="_v").transform(
            df.select(*[_q(c) for c in cols], _q(label).cast("double").alias("_l")))
        value = float(ClusteringEvaluator(featuresCol="_v", predictionCol="_l", metricName="silhouette",
                                          distanceMeasure="squaredEuclidean").evaluate(vec))
    return spark.createDataFrame([(value,)], "Silhouette_Squared_Euclidean double")


def _dist(cols: list[str], other: str) -> F.Column:
    expr = None
    for c in cols:
        term = F.pow(_q(c) - F.col(f"{other}{c}"), 2)
        expr = term if expr is None else expr + term
    return F.sqrt(expr)


def _centroids(df: DataFrame, cols: list[str], label: str) -> DataFrame:
    return df.groupBy(_q(label).alias("_l")).agg(F.count(F.lit(1)).alias("_n"),
                                                 *[F.avg(_q(c)).alias(f"c_{c}") for c in cols])


def davies_bouldin(df: DataFrame, cols: list[str], label: str) -> DataFrame:
    """Mean over clusters of max_j (s_i + s_j) / d(c_i, c_j); null when undefined.

    Centroids are a k-row table (broadcast); the k×k step runs on that table as arrays.
    """
    cent = _centroids(df, cols, label)
    scat = (df.select(_q(label).alias("_l"), *[_q(c) for c in cols]).join(F.broadcast(cent), "_l")
            .groupBy("_l").agg(F.avg(_dist(cols, "c_")).alias("_s")))
    c = cent.join(scat, "_l")
    # the k centroids (parameter-sized) as one array; each centroid row scans it for its worst partner
    allc = c.agg(F.collect_list(F.struct(*[F.col(f"`{x}`") for x in c.columns])).alias("_all")).select("_all").scalar()

    def ratio(o):
        d = None
        for col in cols:
            t = F.pow(F.col(f"`c_{col}`") - o[f"c_{col}"], 2)
            d = t if d is None else d + t
        return F.try_divide(F.col("_s") + o["_s"], F.sqrt(d))
    worst = c.select("*", allc.alias("_all")).select(
        F.array_max(F.transform(F.filter("_all", lambda o: o["_l"] != F.col("_l")), ratio)).alias("_r"))
    g = label_guard(df, label)
    return with_params(worst.agg(F.avg("_r").alias("_db")), g).select(
        F.when(F.col("Defined"), F.col("_db")).alias("Davies_Bouldin_Index"))


def calinski_harabasz(df: DataFrame, cols: list[str], label: str) -> DataFrame:
    """[B/(k−1)] / [W/(n−k)]; 1.0 when W = 0; null when undefined."""
    cent = _centroids(df, cols, label)
    overall = df.agg(F.count(F.lit(1)).alias("_total"), *[F.avg(_q(c)).alias(f"m_{c}") for c in cols])
    within = (df.select(_q(label).alias("_l"), *[_q(c) for c in cols]).join(F.broadcast(cent), "_l")
              .agg(F.sum(F.pow(_dist(cols, "c_"), 2)).alias("_W")))
    bd = None
    for c in cols:
        t = F.pow(F.col(f"c_{c}") - F.col(f"m_{c}"), 2)
        bd = t if bd is None else bd + t
    between = with_params(cent, overall).agg(F.sum(F.col("_n") * bd).alias("_B"),
                                                        F.count(F.lit(1)).alias("_k"), F.first("_total").alias("_total"))
    g = label_guard(df, label)
    ch = F.when(F.col("_W") == 0, F.lit(1.0)).otherwise(
        F.col("_B") * (F.col("_total") - F.col("_k")) / (F.col("_W") * (F.col("_k") - 1)))
    return with_params(with_params(between, within), g).select(F.when(F.col("Defined"), ch).alias("Calinski_Harabasz_Score"))


# ---------------------------------------------------------------------------------------
# composite
# ---------------------------------------------------------------------------------------
@dataclass
class SegmentationFit:
    vocab: dict
    scaling: FE.Scaling
    pca: PcaFit
    kmeans: KMeansFit
    points: DataFrame        # key, PC1, PC2, Cluster


def plane(df: DataFrame, key: str = "customerID") -> tuple[DataFrame, dict, FE.Scaling, PcaFit]:
    """Segment features → standardise (population std) → PCA(2): (key, PC1, PC2) and what was fitted.

    Only the two points of every row are stored; the wide encoded columns are
    made anew from the narrow input for each pass.
    """
    feats, vocab, cols = FE.segment_features(df, key=key)
    scaling = FE.fit_scaling(feats, cols)
    scaled = scaling.apply(feats)
    pca = fit_pca(scaled, cols)
    return pca.project(scaled, keep=(key,)).checkpoint(eager=True), vocab, scaling, pca


def segment(df: DataFrame, key: str = "customerID", k: int = 3, n_init: int = 10, seed: int = 42) -> SegmentationFit:
    """``plane`` and k-means(k) on its points."""
    pts, vocab, scaling, pca = plane(df, key)
    km = fit_kmeans(pts, ["PC1", "PC2"], k, n_init, seed)
    labelled = kmeans_assign(pts, km.centres, ["PC1", "PC2"])
    return SegmentationFit(vocab, scaling, pca, km, labelled)


def segmentation_metrics(points: DataFrame, cols: tuple[str, ...] = ("PC1", "PC2"), label: str = "Cluster") -> DataFrame:
    """One row: number of clusters and the quality indices of the k-means and the DBSCAN labels."""
    from churnforge.operators.dbscan import dbscan
    from churnforge.operators.stats import with_params
    cols = list(cols)
    out = label_guard(points, label).select("Number_of_Clusters")
    dense = silhouette_squared(dbscan(points, key=next(c for c in points.columns if c not in (*cols, label))), cols, "DBSCAN_Cluster")
    for one_row in (silhouette_squared(points, cols, label), davies_bouldin(points, cols, label), calinski_harabasz(points, cols, label),
                    dense.withColumnRenamed("Silhouette_Squared_Euclidean", "DBSCAN_Silhouette_Squared_Euclidean")):
        out = with_params(out, one_row)
    return out
