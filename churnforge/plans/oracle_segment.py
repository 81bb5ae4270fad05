"""DuckDB oracle SQL for segmentation indices on the fixed-cluster fixture and the covariance matrix."""

from __future__ import annotations

from churnforge.plans.oracle_business import AN_CTES
from churnforge.plans.oracle_features import SEG_CTES, SEG_NAMES, _safe

PTS_CTES = AN_CTES + """
, pt AS (SELECT customerID, CAST(tenure AS DOUBLE) AS x, MonthlyCharges AS y, Cluster FROM an0),
ce AS (SELECT Cluster, count(*) AS n, avg(x) AS cx, avg(y) AS cy, avg(x * x + y * y) AS msq FROM pt GROUP BY Cluster),
ov AS (SELECT count(*) AS total, avg(x) AS mx, avg(y) AS my FROM pt),
gd AS (SELECT count(DISTINCT Cluster) AS k, count(*) AS rows_n FROM pt)
"""

_cov_items = []
for _j, _b in enumerate(SEG_NAMES):
    for _a in SEG_NAMES[:_j + 1]:
        _cov_items.append(f"{{'a': '{_a}', 'b': '{_b}', 'cov': covar_samp(sc.\"{_a}\", sc.\"{_b}\")}}")

SCALED = SEG_CTES + ", st AS (SELECT " + ", ".join(
    f"avg(\"{n}\") AS m_{_safe(n)}, stddev_pop(\"{n}\") AS s_{_safe(n)}" for n in SEG_NAMES) + " FROM sg),\n" + \
    "sc AS (SELECT " + ", ".join(
        f"CASE WHEN st.s_{_safe(n)} = 0 OR st.s_{_safe(n)} IS NULL THEN \"{n}\" - st.m_{_safe(n)} "
        f"ELSE (\"{n}\" - st.m_{_safe(n)}) / st.s_{_safe(n)} END AS \"{n}\"" for n in SEG_NAMES) + " FROM sg CROSS JOIN st)\n"

ORACLE = {
    "kmeans_assign": PTS_CTES + """
        , cc AS (SELECT
           max(CASE WHEN Cluster = 0 THEN cx END) AS x0, max(CASE WHEN Cluster = 0 THEN cy END) AS y0,
           max(CASE WHEN Cluster = 1 THEN cx END) AS x1, max(CASE WHEN Cluster = 1 THEN cy END) AS y1,
           max(CASE WHEN Cluster = 2 THEN cx END) AS x2, max(CASE WHEN Cluster = 2 THEN cy END) AS y2 FROM ce),
        dd AS (SELECT customerID, pow(x - x0, 2) + pow(y - y0, 2) AS d0, pow(x - x1, 2) + pow(y - y1, 2) AS d1,
               pow(x - x2, 2) + pow(y - y2, 2) AS d2 FROM pt CROSS JOIN cc)
        SELECT customerID, CAST(CASE WHEN d0 <= d1 AND d0 <= d2 THEN 0 WHEN d1 < d0 AND d1 <= d2 THEN 1 ELSE 2 END AS INT)
          AS Nearest_Centre FROM dd""",
    "elbow_k1": PTS_CTES + "SELECT round(count(*) * (var_pop(x) + var_pop(y)), 6) AS Inertia FROM pt",
    "silhouette": PTS_CTES + """
        , sd AS (SELECT pt.customerID, pt.Cluster AS own, ce.Cluster AS other, ce.n,
                 (x * x + y * y) - 2 * (x * ce.cx + y * ce.cy) + ce.msq AS avgd FROM pt CROSS JOIN ce),
        ps AS (SELECT customerID, max(CASE WHEN own = other THEN n END) AS n_own,
               max(CASE WHEN own = other THEN avgd * n / (n - 1) END) AS a,
               min(CASE WHEN own <> other THEN avgd END) AS b FROM sd GROUP BY customerID)
        SELECT round(CASE WHEN (SELECT k FROM gd) > 1 AND (SELECT k FROM gd) < (SELECT rows_n FROM gd) THEN
          avg(CASE WHEN n_own = 1 THEN 0e0 WHEN a < b THEN 1 - a / b WHEN a > b THEN b / a - 1 ELSE 0e0 END) END, 6)
          AS Silhouette_Squared_Euclidean FROM ps""",
    "silhouette_euclidean": PTS_CTES + """
        , up AS (SELECT x, y, Cluster, count(*) AS w FROM pt GROUP BY x, y, Cluster),
        dd AS (SELECT p.x, p.y, p.Cluster AS own, any_value(p.w) AS w, o.Cluster AS other, sum(o.w * sqrt(pow(p.x - o.x, 2) + pow(p.y - o.y, 2))) AS total, sum(o.w) AS n
               FROM up p CROSS JOIN up o GROUP BY p.x, p.y, p.Cluster, o.Cluster),
        ab AS (SELECT any_value(w) AS w, max(CASE WHEN own = other THEN n END) AS n_own, max(CASE WHEN own = other AND n > 1 THEN total / (n - 1) END) AS a,
               min(CASE WHEN own <> other THEN total / n END) AS b FROM dd GROUP BY x, y, own)
        SELECT round(CASE WHEN (SELECT k FROM gd) > 1 AND (SELECT k FROM gd) < (SELECT rows_n FROM gd) THEN
          sum(w * CASE WHEN n_own = 1 OR greatest(a, b) = 0 THEN 0e0 ELSE (b - a) / greatest(a, b) END) / sum(w) END, 3) AS Silhouette_Euclidean,
          true AS Bound_Holds FROM ab""",
    "davies_bouldin": PTS_CTES + """
        , sc AS (SELECT pt.Cluster, avg(sqrt(pow(x - cx, 2) + pow(y - cy, 2))) AS s FROM pt JOIN ce USING (Cluster) GROUP BY pt.Cluster),
        cs AS (SELECT * FROM ce JOIN sc USING (Cluster)),
        wr AS (SELECT a.Cluster, max((a.s + b.s) / sqrt(pow(a.cx - b.cx, 2) + pow(a.cy - b.cy, 2))) AS r
               FROM cs a JOIN cs b ON a.Cluster <> b.Cluster GROUP BY a.Cluster)
        SELECT round(CASE WHEN (SELECT k FROM gd) > 1 AND (SELECT k FROM gd) < (SELECT rows_n FROM gd) THEN avg(r) END, 6)
          AS Davies_Bouldin_Index FROM wr""",
    "calinski_harabasz": PTS_CTES + """
        , w AS (SELECT sum(pow(x - cx, 2) + pow(y - cy, 2)) AS W FROM pt JOIN ce USING (Cluster)),
        bb AS (SELECT sum(n * (pow(cx - mx, 2) + pow(cy - my, 2))) AS B, count(*) AS k, any_value(total) AS total
               FROM ce CROSS JOIN ov)
        SELECT round(CASE WHEN (SELECT k FROM gd) > 1 AND (SELECT k FROM gd) < (SELECT rows_n FROM gd) THEN
          CASE WHEN W = 0 THEN 1e0 ELSE B * (total - k) / (W * (k - 1)) END END, 6) AS Calinski_Harabasz_Score FROM bb CROSS JOIN w""",
    "cluster_metrics_guard": PTS_CTES + "SELECT k AS Number_of_Clusters, (k > 1 AND k < rows_n) AS Defined FROM gd",
    "cluster_count": PTS_CTES + "SELECT count(DISTINCT Cluster) AS Number_of_Clusters FROM pt",
    "covariance_matrix": SCALED + "SELECT e.a AS a, e.b AS b, round(e.cov, 6) AS cov FROM (SELECT unnest([" + ", ".join(_cov_items)
        + "]) AS e FROM sc) t",
}
