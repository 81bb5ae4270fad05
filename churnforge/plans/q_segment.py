"""Queries for segmentation (§2.8): PCA, k-means, indices, DBSCAN."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from churnforge.operators import business as B
from churnforge.operators import dbscan as DB
from churnforge.operators import features as FE
from churnforge.operators import segment as SG
from churnforge.operators import silhouette as SIL
from churnforge.plans.catalog import query
from churnforge.sources import fixtures

PTS = ["PC1", "PC2"]


def _fit(spark, sf, n_init=10):
    return SG.segment(fixtures.subscribers(spark, sf), n_init=n_init)


def _points(spark, sf):
    return SG.plane(fixtures.subscribers(spark, sf))[0]


def _scored_points(spark, sf):
    """Fixed-cluster fixture: (tenure, MonthlyCharges) points labelled by the fixture's Cluster."""
    an = B.analysis_frame(fixtures.scored(spark, sf))
    return an.select("customerID", F.col("tenure").cast("double").alias("tenure"), "MonthlyCharges", "Cluster")


@query("pca_2d")
def q_pca_2d(spark, sf):
    feats, _, cols = FE.segment_features(fixtures.subscribers(spark, sf))
    scaled = FE.fit_scaling(feats, cols).apply(feats)
    return SG.fit_pca(scaled, cols).project(scaled, keep=("customerID",))


@query("covariance_matrix")
def q_covariance(spark, sf):
    feats, _, cols = FE.segment_features(fixtures.subscribers(spark, sf))
    return SG.covariance_matrix(FE.fit_scaling(feats, cols).apply(feats), cols)


@query("pca_loadings")
def q_pca_loadings(spark, sf):
    feats, _, cols = FE.segment_features(fixtures.subscribers(spark, sf))
    scaled = FE.fit_scaling(feats, cols).apply(feats)
    return SG.pca_loadings(SG.fit_pca(scaled, cols), 18)


@query("kmeans_3")
def q_kmeans(spark, sf):
    return _fit(spark, sf).points


@query("kmeans_assign")
def q_kmeans_assign(spark, sf):
    """One assignment step: nearest of the fixture's per-cluster centres."""
    p = _scored_points(spark, sf)
    rows = p.groupBy("Cluster").agg(F.avg("tenure").alias("t"), F.avg("MonthlyCharges").alias("m")) \
        .orderBy("Cluster").collect()
    centres = np.array([[r["t"], r["m"]] for r in rows])
    return SG.kmeans_assign(p.drop("Cluster"), centres, ["tenure", "MonthlyCharges"], "Nearest_Centre") \
        .select("customerID", "Nearest_Centre")


@query("elbow")
def q_elbow(spark, sf):
    return SG.elbow(_points(spark, sf), PTS)


@query("elbow_k1")
def q_elbow_k1(spark, sf):
    return SG.inertia_k1(_scored_points(spark, sf), ["tenure", "MonthlyCharges"])


@query("silhouette")
def q_silhouette(spark, sf):
    return SG.silhouette_squared(_scored_points(spark, sf), ["tenure", "MonthlyCharges"], "Cluster")


@query("silhouette_kmeans")
def q_silhouette_kmeans(spark, sf):
    return SG.silhouette_squared(_fit(spark, sf).points, PTS, "Cluster")


def _euclidean(points, cols, label):
    """The silhouette to three digits and whether its proven bound meets the tolerance."""
    found = SIL.silhouette_euclidean(points, cols, label, tolerance=1e-4)
    return found.select(F.round("Silhouette_Euclidean", 3).alias("Silhouette_Euclidean"), (F.col("Error_Bound") <= 1e-4).alias("Bound_Holds"))


@query("silhouette_euclidean")
def q_silhouette_euclidean(spark, sf):
    return _euclidean(_scored_points(spark, sf), ["tenure", "MonthlyCharges"], "Cluster")


@query("silhouette_kmeans_euclidean")
def q_silhouette_kmeans_euclidean(spark, sf):
    return _euclidean(_fit(spark, sf).points, PTS, "Cluster")


@query("dbscan_silhouette_euclidean")
def q_dbscan_silhouette_euclidean(spark, sf):
    return _euclidean(DB.dbscan(_points(spark, sf)), PTS, "DBSCAN_Cluster")


@query("davies_bouldin")
def q_davies_bouldin(spark, sf):
    return SG.davies_bouldin(_scored_points(spark, sf), ["tenure", "MonthlyCharges"], "Cluster")


@query("calinski_harabasz")
def q_calinski_harabasz(spark, sf):
    return SG.calinski_harabasz(_scored_points(spark, sf), ["tenure", "MonthlyCharges"], "Cluster")


@query("cluster_metrics_guard")
def q_guard(spark, sf):
    return SG.label_guard(_scored_points(spark, sf), "Cluster")


@query("cluster_count")
def q_cluster_count(spark, sf):
    return _scored_points(spark, sf).agg(F.count_distinct("Cluster").alias("Number_of_Clusters"))


@query("dbscan")
def q_dbscan(spark, sf):
    return DB.dbscan(_points(spark, sf))


@query("dbscan_silhouette")
def q_dbscan_silhouette(spark, sf):
    return SG.silhouette_squared(DB.dbscan(_points(spark, sf)), PTS, "DBSCAN_Cluster")


@query("pca_points")
def q_pca_points(spark, sf):
    return _fit(spark, sf).points.select("customerID", "PC1", "PC2", F.col("Cluster").cast("string").alias("Cluster"))


@query("segmentation_metrics")
def q_segmentation_metrics(spark, sf):
    return SG.segmentation_metrics(_fit(spark, sf).points)


@query("loading_top15")
def q_loading_top15(spark, sf):
    feats, _, cols = FE.segment_features(fixtures.subscribers(spark, sf))
    scaled = FE.fit_scaling(feats, cols).apply(feats)
    return SG.pca_loadings(SG.fit_pca(scaled, cols), 15)
