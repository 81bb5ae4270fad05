"""DuckDB oracle SQL for feature engineering (§2.5)."""

from __future__ import annotations

from churnforge.plans.oracle_base import RAW_CTES, SUBSCRIBERS_CTES
from churnforge.plans.oracle_business import TARGET_SQL, parse_sql
from churnforge.plans.oracle_clean import CLEAN_CTES

SAR = 3.75
SERVICES = ["OnlineSecurity", "OnlineBackup", "DeviceProtection", "StreamingTV", "StreamingMovies"]
HAS_SERVICE = "CAST(CASE WHEN " + " OR ".join(f"{c} = 'Yes'" for c in SERVICES) + " THEN 1 ELSE 0 END AS INT)"
BIN = {
    "TechSupport": "CASE TechSupport WHEN 'Yes' THEN 1 ELSE 0 END",
    "MultipleLines": "CASE MultipleLines WHEN 'Yes' THEN 1 ELSE 0 END",
    "PhoneService": "CASE PhoneService WHEN 'Yes' THEN 1 ELSE 0 END",
    "Partner": "CASE Partner WHEN 'Yes' THEN 1 ELSE 0 END",
    "Dependents": "CASE Dependents WHEN 'Yes' THEN 1 ELSE 0 END",
}
SEG_BIN = {c: f"CAST(CASE {c} WHEN 'Yes' THEN 1 WHEN 'Male' THEN 1 ELSE 0 END AS DOUBLE)"
           for c in ["gender", "Partner", "Dependents", "PhoneService"]}
# fitted vocabularies on the subscriber fixture (sorted text values)
VOCAB = {
    "gender": ["Female", "Male"],
    "InternetService": ["DSL", "Fiber optic", "No"],
    "Contract": ["Month-to-month", "One year", "Two year"],
    "MultipleLines": ["No", "No phone service", "Yes"],
}
for _c in ["OnlineSecurity", "OnlineBackup", "DeviceProtection", "TechSupport", "StreamingTV", "StreamingMovies"]:
    VOCAB[_c] = ["No", "No internet service", "Yes"]
SEG_DUMMIES = ["MultipleLines", "InternetService", "OnlineSecurity", "OnlineBackup", "DeviceProtection",
               "TechSupport", "StreamingTV", "StreamingMovies", "Contract"]


def dummies(cols: list[str], drop_first: bool, as_double: bool = False) -> list[str]:
    out = []
    for c in cols:
        vals = VOCAB[c][1:] if drop_first else VOCAB[c]
        for v in vals:
            e = f"CASE WHEN {c} = '{v}' THEN 1 ELSE 0 END"
            out.append(f"{'CAST(' + e + ' AS DOUBLE)' if as_double else e} AS \"{c}_{v}\"")
    return out


TOTAL = f"COALESCE({parse_sql('TotalCharges')}, 0e0)"


def churn_feature_sql(drop: tuple = ()) -> str:
    cols = ["customerID", "CAST(SeniorCitizen AS DOUBLE) AS SeniorCitizen"]
    for c in ["Partner", "Dependents"]:
        cols.append(f"CAST({'0' if c in drop else BIN[c]} AS DOUBLE) AS {c}")
    cols.append("CAST(tenure AS DOUBLE) AS tenure")
    for c in ["PhoneService", "MultipleLines", "TechSupport"]:
        cols.append(f"CAST({'0' if c in drop else BIN[c]} AS DOUBLE) AS {c}")
    cols += [f"round(MonthlyCharges * {SAR}, 6) AS MonthlyCharges", f"round({TOTAL} * {SAR}, 6) AS TotalCharges",
             f"{TARGET_SQL} AS Churn", f"CAST({HAS_SERVICE} AS DOUBLE) AS HasService"]
    cols += dummies(["gender", "InternetService", "Contract"], True, True)
    return ", ".join(cols)


def seg_feature_exprs() -> list[tuple[str, str]]:
    items = [("gender", SEG_BIN["gender"]), ("SeniorCitizen", "CAST(SeniorCitizen AS DOUBLE)"),
             ("Partner", SEG_BIN["Partner"]), ("Dependents", SEG_BIN["Dependents"]),
             ("tenure", "CAST(tenure AS DOUBLE)"), ("PhoneService", SEG_BIN["PhoneService"]),
             ("MonthlyCharges", f"MonthlyCharges * {SAR}"), ("TotalCharges", f"{TOTAL} * {SAR}")]
    for c in SEG_DUMMIES:
        for v in VOCAB[c]:
            items.append((f"{c}_{v}", f"CAST(CASE WHEN {c} = '{v}' THEN 1 ELSE 0 END AS DOUBLE)"))
    return items


SPLIT = "CAST(CAST('0x' || substr(md5(concat('42:', customerID)), 1, 8) AS BIGINT) % 100 < 20 AS INT)"
CF_CTES = SUBSCRIBERS_CTES + f", cf AS (SELECT {churn_feature_sql()} FROM f), sp AS (SELECT *, {SPLIT} AS is_test FROM cf)\n"
SEG_CTES = SUBSCRIBERS_CTES + ", sg AS (SELECT customerID, " + ", ".join(
    f"{e} AS \"{n}\"" for n, e in seg_feature_exprs()) + " FROM f)\n"


def _scaled(name: str, src: str, stats: str) -> str:
    return (f"round(CASE WHEN {stats}.s_{_safe(name)} = 0 OR {stats}.s_{_safe(name)} IS NULL "
            f"THEN \"{name}\" - {stats}.m_{_safe(name)} ELSE (\"{name}\" - {stats}.m_{_safe(name)}) / {stats}.s_{_safe(name)} END, 6) AS \"{name}\"")


def _safe(name: str) -> str:
    return "".join(ch if ch.isalnum() else "_" for ch in name)


SEG_NAMES = [n for n, _ in seg_feature_exprs()]
SCALE_THREE = ["tenure", "MonthlyCharges", "TotalCharges"]

ORACLE = {
    "has_service": SUBSCRIBERS_CTES + f"SELECT customerID, {HAS_SERVICE} AS HasService FROM f",
    "map_target": SUBSCRIBERS_CTES + f"SELECT customerID, {TARGET_SQL} AS Churn FROM f",
    "map_binary": SUBSCRIBERS_CTES + "SELECT customerID, " + ", ".join(f"CAST({e} AS INT) AS {c}" for c, e in BIN.items()) + " FROM f",
    "map_binary_segment": SUBSCRIBERS_CTES + "SELECT customerID, " + ", ".join(f"{e} AS {c}" for c, e in SEG_BIN.items()) + " FROM f",
    "to_sar": SUBSCRIBERS_CTES + f"SELECT customerID, round(MonthlyCharges * {SAR}, 6) AS MonthlyCharges, round({TOTAL} * {SAR}, 6) AS TotalCharges FROM f",
    "one_hot_drop_first": SUBSCRIBERS_CTES + "SELECT customerID, " + ", ".join(dummies(["gender", "InternetService", "Contract"], True)) + " FROM f",
    "one_hot_full": SUBSCRIBERS_CTES + "SELECT customerID, " + ", ".join(dummies(SEG_DUMMIES, False)) + " FROM f",
    "coerce_all_numeric": RAW_CTES + "SELECT customerID, " + ", ".join(
        f"round(COALESCE({parse_sql(c)}, 0e0), 6) AS {c}" for c in
        ["gender", "SeniorCitizen", "Partner", "tenure", "Contract", "MonthlyCharges", "TotalCharges", "Source", "Churn"]) + " FROM raw",
    "churn_features": CF_CTES + "SELECT * FROM cf",
    "segment_features": SEG_CTES + "SELECT customerID, " + ", ".join(f"round(\"{n}\", 6) AS \"{n}\"" for n in SEG_NAMES) + " FROM sg",
    "split_80_20": SUBSCRIBERS_CTES + f"SELECT customerID, {SPLIT} AS is_test FROM f",
    "scale_three": CF_CTES + ", st AS (SELECT " + ", ".join(
        f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in SCALE_THREE) + " FROM sp WHERE is_test = 0)\n"
        + "SELECT customerID, is_test, " + ", ".join(_scaled(c, "sp", "st") for c in SCALE_THREE) + " FROM sp CROSS JOIN st",
    "scale_all": SEG_CTES + ", st AS (SELECT " + ", ".join(
        f"avg(\"{n}\") AS m_{_safe(n)}, stddev_pop(\"{n}\") AS s_{_safe(n)}" for n in SEG_NAMES) + " FROM sg)\n"
        + "SELECT customerID, " + ", ".join(_scaled(n, "sg", "st") for n in SEG_NAMES) + " FROM sg CROSS JOIN st",
    "balanced_weights": CF_CTES + """, tr AS (SELECT * FROM sp WHERE is_test = 0),
        cc AS (SELECT Churn, count(*) AS nc FROM tr GROUP BY Churn)
        SELECT customerID, Churn, round((SELECT count(*) FROM tr) / ((SELECT count(*) FROM cc) * nc), 6) AS weight
        FROM tr JOIN cc USING (Churn)""",
    "scale_pos_weight": CF_CTES + """SELECT round(greatest(1e0, count_if(Churn = 0) / greatest(count_if(Churn = 1), 1)), 6)
        AS scale_pos_weight FROM sp WHERE is_test = 0""",
    "encoded_feature_count": CLEAN_CTES + """SELECT CAST(4 + count(DISTINCT gender) + count(DISTINCT Partner)
        + count(DISTINCT Contract) AS INT) AS Encoded_ML_Features FROM cl""",
    "align_features": SUBSCRIBERS_CTES + f"SELECT {churn_feature_sql(('Dependents', 'MultipleLines'))} FROM f",
    "prepare_new_customers": SUBSCRIBERS_CTES + ", nc AS (SELECT * REPLACE ("
        "CASE WHEN right(customerID, 1) IN ('0', '1', '2') THEN 1 ELSE tenure END AS tenure, "
        "CASE WHEN right(customerID, 1) IN ('2', '3', '4') THEN 'Month-to-month' ELSE Contract END AS Contract, "
        "CASE WHEN right(customerID, 1) IN ('4', '5', '6') THEN 'Electronic check' ELSE PaymentMethod END AS PaymentMethod, "
        "'No' AS Churn) FROM f)\n"
        + f"SELECT {churn_feature_sql()} FROM nc",
}
