"""DuckDB oracle SQL for evaluation operators (§2.7) on the fixed-score fixture's test split."""

from __future__ import annotations

from churnforge.plans.oracle_business import AN_CTES
from churnforge.plans.oracle_features import SPLIT

TEST_CTES = AN_CTES + f", te AS (SELECT * FROM an0 WHERE {SPLIT} = 1)\n"
RANKED = TEST_CTES + """
, sc AS (SELECT Churn_Probability AS score, CAST(count_if(Churn = 1) AS BIGINT) AS pos, CAST(count_if(Churn <> 1) AS BIGINT) AS neg
         FROM te GROUP BY Churn_Probability),
rk AS (SELECT *, sum(pos) OVER (ORDER BY score DESC) AS cum_pos, sum(neg) OVER (ORDER BY score DESC) AS cum_neg,
       row_number() OVER (ORDER BY score DESC) AS pt,
       lead(pos) OVER (ORDER BY score DESC) AS np, lead(neg) OVER (ORDER BY score DESC) AS nn FROM sc),
tot AS (SELECT sum(pos) AS P, sum(neg) AS N FROM sc)
"""

ORACLE = {
    "confusion": TEST_CTES + """
        , g(Actual, Predicted) AS (VALUES (0, 0), (0, 1), (1, 0), (1, 1)),
        c AS (SELECT Churn AS Actual, Predicted_Churn AS Predicted, count(*) AS n FROM te GROUP BY ALL)
        SELECT CAST(g.Actual AS INT) AS Actual, CAST(g.Predicted AS INT) AS Predicted, COALESCE(c.n, 0) AS Customers
        FROM g LEFT JOIN c USING (Actual, Predicted)""",
    "acc_prec_rec_f1": TEST_CTES + """
        , m AS (SELECT count(*) AS n, count_if(Churn = Predicted_Churn) AS ok, count_if(Churn = 1 AND Predicted_Churn = 1) AS tp,
                count_if(Churn = 0 AND Predicted_Churn = 1) AS fp, count_if(Churn = 1 AND Predicted_Churn = 0) AS fn FROM te)
        SELECT round(ok / n, 6) AS Accuracy, round(COALESCE(tp / NULLIF(tp + fp, 0), 0), 6) AS Precision,
               round(COALESCE(tp / NULLIF(tp + fn, 0), 0), 6) AS Recall,
               round(COALESCE(2 * tp / NULLIF(2 * tp + fp + fn, 0), 0), 6) AS F1_Score FROM m""",
    "roc_auc": RANKED + """SELECT round(sum(neg * (cum_pos - pos + pos / 2.0e0)) / (any_value(P) * any_value(N)), 6) AS ROC_AUC
        FROM rk CROSS JOIN tot""",
    "roc_curve": RANKED + """SELECT pt AS point, round(score, 6) AS threshold, round(cum_neg / N, 6) AS fpr, round(cum_pos / P, 6) AS tpr
        FROM rk CROSS JOIN tot WHERE pt = 1 OR np IS NULL OR np <> pos OR nn <> neg
        UNION ALL SELECT 0, CAST('inf' AS DOUBLE), 0e0, 0e0""",
    "pr_curve": RANKED + """SELECT round(score, 6) AS threshold,
        round(CASE WHEN cum_pos + cum_neg <> 0 THEN cum_pos / (cum_pos + cum_neg) ELSE 0e0 END, 6) AS precision,
        round(CASE WHEN P = 0 THEN 1e0 ELSE cum_pos / P END, 6) AS recall FROM rk CROSS JOIN tot
        UNION ALL SELECT CAST(NULL AS DOUBLE), 1e0, 0e0""",
    "actual_vs_predicted": TEST_CTES + """
        , c AS (SELECT Churn AS Actual, Predicted_Churn AS Predicted, count(*) AS n FROM te GROUP BY ALL),
        a AS (SELECT DISTINCT Actual FROM c), p AS (SELECT DISTINCT Predicted FROM c)
        SELECT CAST(a.Actual AS INT) AS Actual, CAST(p.Predicted AS INT) AS Predicted, COALESCE(c.n, 0) AS Customers
        FROM a CROSS JOIN p LEFT JOIN c ON c.Actual = a.Actual AND c.Predicted = p.Predicted""",
}
