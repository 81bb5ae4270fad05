"""DuckDB oracle SQL for the business / dashboard queries (over the ``scored`` fixture)."""

from __future__ import annotations

from churnforge.plans.oracle_base import SCORED_CTES, SUBSCRIBERS_CTES

NUM_RE = r"^\s*[+-]?((\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|(?i:inf|infinity))\s*$"


def parse_sql(col: str) -> str:
    return f"(CASE WHEN regexp_matches(CAST({col} AS VARCHAR), '{NUM_RE}') THEN TRY_CAST(trim(CAST({col} AS VARCHAR)) AS DOUBLE) END)"


TARGET_SQL = ("CAST(CASE Churn WHEN 'Yes' THEN 1 WHEN 'No' THEN 0 WHEN 'yes' THEN 1 WHEN 'no' THEN 0 "
              "WHEN 'Y' THEN 1 WHEN 'N' THEN 0 ELSE 0 END AS INT)")

RISK_SQL = ("CASE WHEN Churn_Probability >= 0.8e0 THEN 'Critical' WHEN Churn_Probability >= 0.6e0 THEN 'High' "
            "WHEN Churn_Probability >= 0.4e0 THEN 'Medium' ELSE 'Low' END")

RISK_ORDER_SQL = ("CASE Risk_Level WHEN 'Low' THEN 0 WHEN 'Medium' THEN 1 WHEN 'High' THEN 2 "
                  "WHEN 'Critical' THEN 3 END")


def offer_sql(monthly: str = "MonthlyCharges") -> str:
    return (f"CASE WHEN Risk_Level = 'Critical' AND {monthly} >= 300 THEN '25% discount for 6 months + Premium Support' "
            "WHEN Risk_Level = 'High' THEN '15% discount + Free service upgrade' "
            "WHEN Risk_Level = 'Medium' THEN 'Loyalty points or bonus data' "
            "ELSE 'No offer - Continue regular engagement' END")


def mode_ctes(src: str, key: str, col: str, alias: str, name: str) -> str:
    return f"""
, {name}_c AS (SELECT {key}, {col} AS v, count(*) AS n FROM {src} WHERE {col} IS NOT NULL GROUP BY {key}, {col}),
{name} AS (SELECT {key}, v AS {alias} FROM (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY n DESC, v) AS rn
            FROM {name}_c) WHERE rn = 1)"""


AN_CTES = SCORED_CTES + f"""
, an0 AS (SELECT * REPLACE (COALESCE({parse_sql('TotalCharges')}, 0e0) AS TotalCharges, {TARGET_SQL} AS Churn)
          FROM scored),
prof0 AS (SELECT Cluster, count(*) AS Customer_Count, avg(TotalCharges) AS Avg_Spending,
          avg(MonthlyCharges) AS Avg_Monthly_Charges, avg(tenure) AS Avg_Tenure, avg(Churn_Probability) AS Churn_Risk
          FROM an0 GROUP BY Cluster)
{mode_ctes('an0', 'Cluster', 'Contract', 'Preferred_Contract', 'm_contract')}
{mode_ctes('an0', 'Cluster', 'PaymentMethod', 'Preferred_Payment_Method', 'm_pay')}
, prof AS (SELECT prof0.*, COALESCE(Preferred_Contract, 'Unknown') AS Preferred_Contract,
           COALESCE(Preferred_Payment_Method, 'Unknown') AS Preferred_Payment_Method
           FROM prof0 LEFT JOIN m_contract USING (Cluster) LEFT JOIN m_pay USING (Cluster)),
nm0 AS (SELECT *, row_number() OVER (ORDER BY Churn_Risk DESC, Cluster) AS r1,
        quantile_cont(Avg_Tenure, 0.5) OVER () AS med FROM prof),
nm1 AS (SELECT *, CASE WHEN r1 <> 1 THEN row_number() OVER (PARTITION BY r1 = 1
        ORDER BY Avg_Spending DESC, Avg_Monthly_Charges DESC, Cluster) END AS r2 FROM nm0),
nm2 AS (SELECT *, CASE WHEN r1 <> 1 AND r2 <> 1 THEN row_number() OVER (PARTITION BY (r1 <> 1 AND r2 <> 1)
        ORDER BY Avg_Tenure DESC, Cluster) END AS r3 FROM nm1),
nm AS (SELECT * EXCLUDE (r1, r2, r3, med), CASE WHEN r1 = 1 THEN 'High-Risk Customers' WHEN r2 = 1 THEN 'Premium Customers'
       WHEN r3 = 1 AND Avg_Tenure >= med THEN 'Loyal Customers' WHEN r3 = 1 THEN 'New Customers'
       ELSE concat('Segment ', CAST(Cluster + 1 AS VARCHAR)) END AS Cluster_Name FROM nm2),
mx AS (SELECT greatest(max(MonthlyCharges), 1e0) AS mm, greatest(CAST(max(tenure) AS DOUBLE), 1e0) AS mt FROM an0),
an1 AS (SELECT an0.*, nm.Cluster_Name, {RISK_SQL} AS Risk_Level,
        Predicted_Churn * 50 + (MonthlyCharges / mm) * 30 + (1 - tenure / mt) * 20 AS Priority_Score
        FROM an0 LEFT JOIN nm USING (Cluster) CROSS JOIN mx),
an AS (SELECT *, {offer_sql()} AS Retention_Offer FROM an1)
"""


def money_sum(expr: str = "MonthlyCharges") -> str:
    return f"CAST(COALESCE(sum(CAST({expr} AS DECIMAL(18,2))), 0) AS DOUBLE)"


def R(expr: str, alias: str) -> str:
    return f"round({expr}, 6) AS {alias}"


def fixed1(expr: str) -> str:
    return f"printf('%.1f', floor(({expr}) * 10 + 0.5) / 10)"


def pct1(expr: str) -> str:
    return f"concat({fixed1(f'({expr}) * 100')}, '%')"


def money0(expr: str, sym: str = "ر.س") -> str:
    return f"concat('{sym} ', format('{{:,}}', CAST(floor({expr} + 0.5) AS BIGINT)))"


KPI_SQL = f"""
, kpi0 AS (SELECT count(*) AS Total_Customers, CAST(sum(Churn) AS BIGINT) AS Actual_Churned_Customers,
           CAST(sum(Predicted_Churn) AS BIGINT) AS Predicted_Churn_Customers, avg(Churn) AS Churn_Rate,
           {money_sum("CASE WHEN Predicted_Churn = 1 THEN MonthlyCharges END")} AS Revenue_at_Risk,
           count(CASE WHEN Risk_Level IN ('High', 'Critical') THEN 1 END) AS High_Risk_Customers,
           {money_sum()} AS revenue_total, CAST(count(DISTINCT Cluster) AS INT) AS Number_of_Customer_Segments,
           avg(tenure) AS Average_Customer_Lifetime, avg(MonthlyCharges) AS Average_Monthly_Charges,
           avg(TotalCharges) AS Average_Customer_Value FROM an),
kpi1 AS (SELECT *, 1 - Churn_Rate AS Retention_Rate, Revenue_at_Risk * 12 AS Annual_Revenue_Loss,
         CASE WHEN revenue_total <> 0 THEN Revenue_at_Risk / revenue_total ELSE 0e0 END AS Revenue_Risk_Ratio,
         CASE WHEN Total_Customers > 0 THEN High_Risk_Customers / Total_Customers ELSE 0e0 END AS high_ratio FROM kpi0),
kpi2 AS (SELECT *, CAST(trunc(least(greatest(100 - Churn_Rate * 85 - high_ratio * 30 - Revenue_Risk_Ratio * 20, 1e0), 100e0)) AS INT)
         AS Business_Health_Score FROM kpi1),
kpi AS (SELECT * EXCLUDE (revenue_total, high_ratio), CASE WHEN Business_Health_Score >= 90 THEN 'Excellent'
        WHEN Business_Health_Score >= 78 THEN 'Strong' WHEN Business_Health_Score >= 65 THEN 'Watch' ELSE 'At Risk' END
        AS Business_Health_Label FROM kpi2)
"""

KPI_DOUBLES = ["Churn_Rate", "Revenue_at_Risk", "Average_Customer_Lifetime", "Average_Monthly_Charges",
               "Average_Customer_Value", "Retention_Rate", "Annual_Revenue_Loss", "Revenue_Risk_Ratio"]
KPI_OTHER = ["Total_Customers", "Actual_Churned_Customers", "Predicted_Churn_Customers", "High_Risk_Customers",
             "Number_of_Customer_Segments", "Business_Health_Score", "Business_Health_Label"]


def _kpi_select() -> str:
    return ", ".join([R(c, c) for c in KPI_DOUBLES] + KPI_OTHER)


PROFILE_SELECT = ("Cluster, Customer_Count, round(Avg_Spending, 6) AS Avg_Spending, "
                  "round(Avg_Monthly_Charges, 6) AS Avg_Monthly_Charges, round(Avg_Tenure, 6) AS Avg_Tenure, "
                  "round(Churn_Risk, 6) AS Churn_Risk, Preferred_Contract, Preferred_Payment_Method")

SAR = 3.75


def _minmax(cols: list[str], src: str) -> str:
    parts = []
    for c in cols:
        parts.append(f"(({c}) - min({c}) OVER ()) / CASE WHEN max({c}) OVER () - min({c}) OVER () = 0 THEN 1e0 "
                     f"ELSE max({c}) OVER () - min({c}) OVER () END AS {c}")
    return f"SELECT Cluster_Name, {', '.join(parts)} FROM {src}"


ORACLE = {
    "subscribers": SUBSCRIBERS_CTES + "SELECT * EXCLUDE (MonthlyCharges), round(MonthlyCharges, 6) AS MonthlyCharges FROM f",
    "risk_level": AN_CTES + f"SELECT customerID, round(Churn_Probability, 6) AS Churn_Probability, {RISK_SQL} AS Risk_Level FROM an0",
    "priority_score": AN_CTES + "SELECT customerID, round(Priority_Score, 6) AS Priority_Score FROM an",
    "retention_offer": AN_CTES + f"SELECT customerID, Risk_Level, Retention_Offer FROM an",
    "retention_offer_sar": AN_CTES + f"""
        , sar AS (SELECT customerID, MonthlyCharges * {SAR} AS MonthlyCharges, {RISK_SQL} AS Risk_Level FROM an0)
        SELECT customerID, round(MonthlyCharges, 6) AS MonthlyCharges, Risk_Level, {offer_sql()} AS Retention_Offer FROM sar""",
    "scored_table": AN_CTES + """SELECT * REPLACE (round(MonthlyCharges, 6) AS MonthlyCharges, round(TotalCharges, 6) AS TotalCharges,
        round(z, 6) AS z, round(Churn_Probability, 6) AS Churn_Probability, round(Priority_Score, 6) AS Priority_Score) FROM an""",
    "cluster_profile": AN_CTES + f"SELECT {PROFILE_SELECT} FROM prof",
    "cluster_names": AN_CTES + "SELECT Cluster, Cluster_Name FROM nm",
    "cluster_summary": AN_CTES + f"""SELECT Cluster, Cluster_Name, count(*) AS Customers, round(avg(tenure), 6) AS Avg_Tenure,
        round(avg(MonthlyCharges), 6) AS Avg_MonthlyCharges, round(avg(Churn) * 100, 6) AS Actual_Churn_Rate,
        round(avg(Predicted_Churn) * 100, 6) AS Predicted_Churn_Rate,
        round({money_sum("CASE WHEN Predicted_Churn = 1 THEN MonthlyCharges END")}, 6) AS Revenue_At_Risk
        FROM an GROUP BY Cluster, Cluster_Name""",
    "risk_summary": AN_CTES + f"""SELECT Risk_Level, count(customerID) AS Customers,
        round(avg(MonthlyCharges), 6) AS Avg_Monthly_Charges, round({money_sum()}, 6) AS Revenue_At_Risk,
        round(avg(Churn_Probability), 6) AS Avg_Probability, {RISK_ORDER_SQL} AS Risk_Order
        FROM an GROUP BY Risk_Level""",
    "risk_by_cluster": AN_CTES + f"""SELECT Cluster, count(*) AS At_Risk_Customers, round({money_sum()}, 6) AS Revenue_At_Risk
        FROM an WHERE Predicted_Churn = 1 GROUP BY Cluster""",
    "tier_counts": AN_CTES + f"SELECT Risk_Level, count(*) AS Customers, {RISK_ORDER_SQL} AS Risk_Order FROM an GROUP BY Risk_Level",
    "tier_revenue": AN_CTES + f"""SELECT Risk_Level, round({money_sum()} * {SAR}, 6) AS Revenue, {RISK_ORDER_SQL} AS Risk_Order
        FROM an GROUP BY Risk_Level""",
    "tier_priority": AN_CTES + f"""SELECT Risk_Level, round(avg(Priority_Score), 6) AS Avg_Priority_Score, {RISK_ORDER_SQL} AS Risk_Order
        FROM an GROUP BY Risk_Level""",
    "cluster_probability": AN_CTES + "SELECT Cluster, round(avg(Churn_Probability), 6) AS Avg_Churn_Probability FROM an GROUP BY Cluster",
    "top_customers": AN_CTES + """SELECT customerID, Cluster_Name, round(Churn_Probability, 6) AS Churn_Probability, Risk_Level,
        round(Priority_Score, 6) AS Priority_Score, Retention_Offer FROM an ORDER BY Priority_Score DESC, customerID LIMIT 20""",
    "churn_totals": AN_CTES + """SELECT count(*) AS Total_Customers, CAST(sum(Churn) AS BIGINT) AS Actual_Churned,
        CAST(sum(Predicted_Churn) AS BIGINT) AS Predicted_Churners, round(avg(Churn) * 100, 6) AS Churn_Rate_Pct FROM an""",
    "revenue_at_risk": AN_CTES + f"""SELECT round({money_sum("CASE WHEN Predicted_Churn = 1 THEN MonthlyCharges END")}, 6) AS Monthly_Revenue_At_Risk,
        round(CAST(COALESCE(sum(CASE WHEN Predicted_Churn = 1 THEN CAST(MonthlyCharges AS DECIMAL(18,2)) END), 0) * 12 AS DOUBLE), 6)
        AS Annual_Revenue_At_Risk FROM an""",
    "business_metrics": AN_CTES + KPI_SQL + f"SELECT {_kpi_select()} FROM kpi",
    "health_score": AN_CTES + KPI_SQL + "SELECT Business_Health_Score, Business_Health_Label FROM kpi",
    "insights": AN_CTES + f"""
        , pc AS (SELECT Contract, count(*) AS n FROM an WHERE Predicted_Churn = 1 AND Contract IS NOT NULL GROUP BY Contract),
        topc AS (SELECT (SELECT Contract FROM pc ORDER BY n DESC, Contract LIMIT 1) AS top_contract),
        bn AS (SELECT Cluster_Name, avg(Churn_Probability) AS p, avg(TotalCharges) AS v FROM an GROUP BY Cluster_Name),
        pick AS (SELECT (SELECT Cluster_Name FROM bn ORDER BY p DESC, Cluster_Name LIMIT 1) AS riskiest,
                        (SELECT Cluster_Name FROM bn ORDER BY v DESC, Cluster_Name LIMIT 1) AS richest),
        k AS (SELECT avg(Churn) * 100 AS churn_pct,
              CAST(COALESCE(sum(CASE WHEN Predicted_Churn = 1 THEN CAST(MonthlyCharges AS DECIMAL(18,2)) END), 0) AS DOUBLE)
              / CAST(sum(CAST(MonthlyCharges AS DECIMAL(18,2))) AS DOUBLE) * 100 AS risk_pct FROM an)
        SELECT 1 AS Insight_No, concat({fixed1('churn_pct')}, '% of customers have churned historically, creating a clear retention priority.') AS Executive_Insight FROM k
        UNION ALL SELECT 2, concat('Predicted churn customers represent ', {fixed1('risk_pct')}, '% of current monthly revenue exposure.') FROM k
        UNION ALL SELECT 3, concat(COALESCE(top_contract, 'Month-to-month'), ' contracts are the strongest commercial signal to inspect for churn prevention.') FROM topc
        UNION ALL SELECT 4, concat(riskiest, ' should receive the earliest retention campaign focus.') FROM pick
        UNION ALL SELECT 5, concat(richest, ' contains the strongest customer value pool and should receive loyalty protection.') FROM pick""",
    "cluster_recommendation": AN_CTES + """SELECT DISTINCT Cluster_Name, CASE
        WHEN contains(Cluster_Name, 'Premium') THEN 'Offer loyalty rewards, premium service bundles, and proactive account management.'
        WHEN contains(Cluster_Name, 'High-Risk') THEN 'Launch targeted retention campaigns with contract migration and service recovery offers.'
        WHEN contains(Cluster_Name, 'New') THEN 'Improve onboarding experience and guide customers toward value-creating service adoption.'
        ELSE 'Maintain regular engagement and reinforce long-term loyalty benefits.' END AS Recommendation FROM an""",
    "convert_currency": AN_CTES + f"""SELECT customerID, round(MonthlyCharges * {SAR}, 6) AS MonthlyCharges,
        round(TotalCharges * {SAR}, 6) AS TotalCharges FROM an""",
    "report_metric_rows": AN_CTES + KPI_SQL + f"""
        SELECT 1 AS Row_No, 'Total Customers' AS Metric, format('{{:,}}', Total_Customers) AS Value FROM kpi
        UNION ALL SELECT 2, 'Churn Rate', {pct1('Churn_Rate')} FROM kpi
        UNION ALL SELECT 3, 'Retention Rate', {pct1('Retention_Rate')} FROM kpi
        UNION ALL SELECT 4, 'Revenue at Risk', {money0(f'Revenue_at_Risk * {SAR}')} FROM kpi
        UNION ALL SELECT 5, 'Annual Revenue Loss', {money0(f'Annual_Revenue_Loss * {SAR}')} FROM kpi
        UNION ALL SELECT 6, 'High-Risk Customers', format('{{:,}}', High_Risk_Customers) FROM kpi
        UNION ALL SELECT 7, 'Customer Segments', format('{{:,}}', Number_of_Customer_Segments) FROM kpi
        UNION ALL SELECT 8, 'Business Health', concat(CAST(Business_Health_Score AS VARCHAR), ' / 100 - ', Business_Health_Label) FROM kpi""",
    "report_segment_rows": AN_CTES + f"""SELECT Cluster_Name AS Segment, format('{{:,}}', Customer_Count) AS Customers,
        {money0(f'Avg_Monthly_Charges * {SAR}')} AS Monthly_Charges, concat({fixed1('Avg_Tenure')}, ' months') AS Tenure,
        {pct1('Churn_Risk')} AS Churn_Risk FROM nm""",
    "predictions_extract": AN_CTES + f"""SELECT customerID, round(Churn_Probability, 6) AS Churn_Probability, Risk_Level, Cluster_Name,
        round(MonthlyCharges * {SAR}, 6) AS MonthlyCharges, round(TotalCharges * {SAR}, 6) AS TotalCharges, Predicted_Churn,
        Retention_Offer FROM an""",
    "cluster_assignments": AN_CTES + "SELECT customerID, Cluster, Cluster_Name FROM an",
    "customer_search": AN_CTES + """SELECT customerID, round(Churn_Probability, 6) AS Churn_Probability, Risk_Level, Cluster_Name,
        round(MonthlyCharges, 6) AS MonthlyCharges, round(TotalCharges, 6) AS TotalCharges,
        round(MonthlyCharges * 12, 6) AS Annual_Revenue, Retention_Offer
        FROM an WHERE regexp_matches(customerID, '(?i)c0+1234') ORDER BY customerID LIMIT 1""",
    "cluster_sizes": AN_CTES + """SELECT Cluster, count(*) AS Customers,
        round(round(count(*) * 100.0e0 / (SELECT count(*) FROM an), 2), 6) AS Share_Pct FROM an GROUP BY Cluster""",
    "cluster_means": AN_CTES + f"""SELECT Cluster, round(round(avg(tenure), 2), 6) AS Avg_Tenure,
        round(round(avg(MonthlyCharges * {SAR}), 2), 6) AS Avg_MonthlyCharges,
        round(round(avg(TotalCharges * {SAR}), 2), 6) AS Avg_TotalCharges FROM an GROUP BY Cluster""",
    "cluster_shares": AN_CTES + """
        , st AS (SELECT Cluster, Feature, Value FROM an UNPIVOT INCLUDE NULLS (Value FOR Feature IN
           (OnlineSecurity, OnlineBackup, DeviceProtection, StreamingTV, StreamingMovies, TechSupport, InternetService, Contract))),
        sz AS (SELECT Cluster, count(*) AS size FROM an GROUP BY Cluster)
        SELECT st.Cluster, Feature, Value, round(round(count(*) * 100.0e0 / any_value(size), 1), 6) AS Share_Pct
        FROM st JOIN sz USING (Cluster) GROUP BY st.Cluster, Feature, Value""",
    "cluster_heatmap": AN_CTES + f"""
        , hp AS (SELECT Cluster_Name, CAST(Customer_Count AS DOUBLE) AS Customer_Count, Avg_Spending, Avg_Monthly_Charges,
                 Avg_Tenure, Churn_Risk FROM nm),
        hm AS ({_minmax(['Customer_Count', 'Avg_Spending', 'Avg_Monthly_Charges', 'Avg_Tenure', 'Churn_Risk'], 'hp')})
        SELECT Cluster_Name, round(Customer_Count, 6) AS Customer_Count, round(Avg_Spending, 6) AS Avg_Spending,
        round(Avg_Monthly_Charges, 6) AS Avg_Monthly_Charges, round(Avg_Tenure, 6) AS Avg_Tenure,
        round(Churn_Risk, 6) AS Churn_Risk FROM hm""",
    "cluster_radar": AN_CTES + f"""
        , rm AS ({_minmax(['Avg_Spending', 'Avg_Monthly_Charges', 'Avg_Tenure', 'Churn_Risk'], 'nm')})
        SELECT Cluster_Name, 'Avg Spending' AS Axis, round(Avg_Spending, 6) AS Value FROM rm
        UNION ALL SELECT Cluster_Name, 'Monthly Charges', round(Avg_Monthly_Charges, 6) FROM rm
        UNION ALL SELECT Cluster_Name, 'Tenure', round(Avg_Tenure, 6) FROM rm
        UNION ALL SELECT Cluster_Name, 'Churn Risk', round(Churn_Risk, 6) FROM rm""",
    "revenue_by_segment": AN_CTES + f"SELECT Cluster_Name, round({money_sum()} * {SAR}, 6) AS Revenue FROM an GROUP BY Cluster_Name",
    "clv_by_segment": AN_CTES + "SELECT Cluster_Name, round(avg(TotalCharges), 6) AS CLV FROM an GROUP BY Cluster_Name",
    "revenue_by_tenure": AN_CTES + f"""
        , g(Bucket_Order, Tenure_Bucket, lo, hi) AS (VALUES (0, '0-6', -1, 6), (1, '7-12', 6, 12), (2, '13-24', 12, 24),
           (3, '25-36', 24, 36), (4, '37-48', 36, 48), (5, '49-60', 48, 60), (6, '61-72', 60, 72)),
        tb AS (SELECT g.Bucket_Order, {money_sum('an.MonthlyCharges')} AS usd FROM an JOIN g ON an.tenure > g.lo AND an.tenure <= g.hi
              GROUP BY g.Bucket_Order)
        SELECT CAST(g.Bucket_Order AS INT) AS Bucket_Order, g.Tenure_Bucket, round(COALESCE(tb.usd, 0e0) * {SAR}, 6) AS MonthlyRevenue
        FROM g LEFT JOIN tb USING (Bucket_Order)""",
}


def histogram_sql(prefix: str, src: str, col: str, bins: int) -> str:
    return prefix + f"""
        , hx AS (SELECT CAST({col} AS DOUBLE) AS x FROM {src} WHERE {col} IS NOT NULL AND NOT isnan(CAST({col} AS DOUBLE))),
        hr AS (SELECT min(x) AS lo, max(x) AS hi FROM hx),
        hb AS (SELECT CAST(CASE WHEN hi - lo = 0 THEN 0 ELSE least(floor((x - lo) * {bins} / (hi - lo)), {bins - 1}) END AS INT) AS Bin,
               lo, hi FROM hx CROSS JOIN hr)
        SELECT Bin, round(any_value(lo) + Bin * (any_value(hi) - any_value(lo)) / {bins}, 6) AS Bin_Start,
               round(any_value(lo) + (Bin + 1) * (any_value(hi) - any_value(lo)) / {bins}, 6) AS Bin_End, count(*) AS Count
        FROM hb GROUP BY Bin"""


ORACLE["revenue_histogram"] = histogram_sql(AN_CTES, "an", "MonthlyCharges", 36)
ORACLE["prediction_histogram"] = histogram_sql(AN_CTES, "an", "Churn_Probability", 30)

ORACLE["risk_factors"] = SUBSCRIBERS_CTES + """
    , rf AS (SELECT customerID, list_filter([
        CASE WHEN Contract = 'Month-to-month' THEN 'Month-to-month contract' END,
        CASE WHEN MonthlyCharges >= 75 THEN 'High monthly charges' END,
        CASE WHEN InternetService = 'Fiber optic' THEN 'Fiber internet' END,
        CASE WHEN tenure <= 12 THEN 'Short tenure' END,
        CASE WHEN PaymentMethod = 'Electronic check' THEN 'Electronic check payment method' END], lambda x: x IS NOT NULL) AS l FROM f)
    SELECT customerID, CASE WHEN len(l) > 0 THEN array_to_string(l, '; ') ELSE 'Balanced customer profile' END AS Top_Factors FROM rf"""


ORACLE["sink_csv"] = AN_CTES + "SELECT customerID, Cluster, Cluster_Name FROM an"
ORACLE["report_risk_table"] = ORACLE["risk_summary"]


def _fmt_kpi(label: str, expr: str, kind: str) -> str:
    if kind == "money":
        return f"SELECT '{label}' AS Metric, {money0(expr + ' * 3.75')} AS Value FROM kpi"
    if kind == "pct":
        return f"SELECT '{label}' AS Metric, {pct1(expr)} AS Value FROM kpi"
    if kind == "double":
        return f"SELECT '{label}' AS Metric, format('{{:,.2f}}', floor({expr} * 100 + 0.5) / 100) AS Value FROM kpi"
    if kind == "int":
        return f"SELECT '{label}' AS Metric, format('{{:,}}', {expr}) AS Value FROM kpi"
    return f"SELECT '{label}' AS Metric, CAST({expr} AS VARCHAR) AS Value FROM kpi"


_KPI_KINDS = [("Total_Customers", "int"), ("Actual_Churned_Customers", "int"), ("Predicted_Churn_Customers", "int"),
              ("Churn_Rate", "pct"), ("Revenue_at_Risk", "money"), ("High_Risk_Customers", "int"),
              ("Number_of_Customer_Segments", "int"), ("Average_Customer_Lifetime", "double"),
              ("Average_Monthly_Charges", "money"), ("Average_Customer_Value", "money"), ("Retention_Rate", "pct"),
              ("Annual_Revenue_Loss", "money"), ("Revenue_Risk_Ratio", "money"), ("Business_Health_Score", "int"),
              ("Business_Health_Label", "text")]
ORACLE["format_money_percent"] = AN_CTES + KPI_SQL + " UNION ALL ".join(
    _fmt_kpi(c.replace("_", " "), c, k) for c, k in _KPI_KINDS)
