"""DuckDB oracle SQL for profiling / EDA (§2.4)."""

from __future__ import annotations

from churnforge.plans.oracle_base import RAW_CTES, SUBSCRIBERS_CTES, measure_columns, measures_ctes
from churnforge.plans.oracle_business import TARGET_SQL, parse_sql
from churnforge.plans.oracle_clean import LINEITEM_KINDS, ORDERS_KINDS, RAW_KINDS, blank

CUSTOMER_KINDS = [("c_custkey", "int"), ("c_name", "text"), ("c_nationkey", "int"), ("c_acctbal", "double"),
                  ("c_mktsegment", "text")]
EVENTS_KINDS = [("event_id", "int"), ("ts", "other"), ("user_id", "int"), ("event_type", "text"),
                ("value", "double"), ("props", "text")]
LINEITEM_NUM = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
                "l_discount", "l_tax"]
ORDERS_NUM = ["o_orderkey", "o_custkey", "o_totalprice"]


def _miss(c: str, kind: str) -> str:
    if kind == "text":
        return f"({blank(c)}) IS NULL"
    if kind == "double":
        return f"({c} IS NULL OR isnan({c}))"
    return f"{c} IS NULL"


def summary_sql(prefix: str, src: str, kinds) -> str:
    nums = [c for c, k in kinds if k in ("int", "double")]
    miss = " + ".join(f"count_if({_miss(c, k)})" for c, k in kinds)
    return prefix + f"""SELECT count(*) AS Number_of_Rows, {len(kinds)} AS Number_of_Columns, {len(nums)} AS Numerical_Features,
        {len(kinds) - len(nums)} AS Categorical_Features, CAST({miss} AS BIGINT) AS Missing_Values,
        count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM {src})) AS Duplicate_Rows FROM {src}"""


def missing_sql(prefix: str, src: str, kinds) -> str:
    parts = [f"SELECT {i} AS position, '{c}' AS \"column\", CAST(count_if({_miss(c, k)}) AS BIGINT) AS missing FROM {src}"
             for i, (c, k) in enumerate(kinds)]
    return prefix + " UNION ALL ".join(parts)


def exact_mean(v: str, src: str) -> str:
    """Mean from five integer digits of 20 bits of every value, so that the order of addition has no part in it."""
    unit = [f"(top * {2.0 ** (-20 * (k + 1))!r})" for k in range(5)]
    inner, digits = f"SELECT {v} AS r0, top FROM {src}, (SELECT pow(2, floor(log2(max(abs({v})))) + 1) AS top FROM {src})", []
    for k in range(5):
        inner = f"SELECT *, r{k} - d{k} * {unit[k]} AS r{k + 1} FROM (SELECT *, CAST(trunc(r{k} / {unit[k]}) AS BIGINT) AS d{k} FROM ({inner}))"
        digits.append(f"CAST(sum(d{k}) AS DOUBLE) * any_value({unit[k]})")
    total = digits[4]
    for d in reversed(digits[:4]):
        total = f"({d} + ({total}))"
    return f"(SELECT CASE WHEN max(abs(r0)) = 0 THEN 0e0 ELSE {total} / count(r0) END FROM ({inner}))"


def describe_sql(prefix: str, src: str, kinds) -> str:
    parts = []
    for c, k in kinds:
        if k in ("int", "double"):
            v = f"CASE WHEN isnan(CAST({c} AS DOUBLE)) THEN NULL ELSE CAST({c} AS DOUBLE) END"
            parts.append(
                f"SELECT '{c}' AS \"column\", count({v}) AS count, CAST(NULL AS BIGINT) AS \"unique\", CAST(NULL AS VARCHAR) AS top, "
                f"CAST(NULL AS BIGINT) AS freq, CAST(NULL AS VARCHAR) AS \"least\", CAST(NULL AS VARCHAR) AS \"greatest\", {exact_mean(v, src)} AS mean, round(stddev_samp({v}), 6) AS std, "
                f"round(min({v}), 6) AS min, round(quantile_cont({v}, 0.25), 6) AS q1, round(quantile_cont({v}, 0.5), 6) AS median, "
                f"round(quantile_cont({v}, 0.75), 6) AS q3, round(max({v}), 6) AS max FROM {src}")
        else:
            t = c if k == "text" else f"CAST({c} AS VARCHAR)"
            commonest = f"FROM {src} WHERE {c} IS NOT NULL GROUP BY {t} ORDER BY count(*) DESC, {t} LIMIT 1"
            numbers = ", ".join(f"CAST(NULL AS DOUBLE) AS {n}" for n in ("mean", "std", "min", "q1", "median", "q3", "max"))
            parts.append(
                f"SELECT '{c}' AS \"column\", count({c}) AS count, count(DISTINCT {c}) AS \"unique\", (SELECT {t} {commonest}) AS top, "
                f"(SELECT count(*) {commonest}) AS freq, min({t}) AS \"least\", max({t}) AS \"greatest\", {numbers} FROM {src}")
    return prefix + " UNION ALL ".join(parts)


def corr_sql(prefix: str, src: str, cols: list[tuple[str, str]]) -> str:
    parts = []
    for j, (b, eb) in enumerate(cols):
        for a, ea in cols[:j]:
            x, y = f"CAST({ea} AS DOUBLE)", f"CAST({eb} AS DOUBLE)"
            both = f"{x} IS NOT NULL AND {y} IS NOT NULL"
            xa, ya = f"CASE WHEN {both} THEN {x} END", f"CASE WHEN {both} THEN {y} END"
            r = (f"CASE WHEN sqrt(var_pop({xa}) * var_pop({ya})) = 0 THEN NULL ELSE "
                 f"covar_pop({xa}, {ya}) / sqrt(var_pop({xa}) * var_pop({ya})) END")
            parts.append(f"SELECT '{a}' AS a, '{b}' AS b, round({r}, 6) AS r FROM {src}")
    return prefix + " UNION ALL ".join(parts)


def corr_wide_sql(prefix: str, src: str, cols: list[str]) -> str:
    """All pairs in one scan."""
    structs, stats = [], []
    for j, b in enumerate(cols):
        for i, a in enumerate(cols[:j]):
            xa, ya = f"CASE WHEN {b} IS NOT NULL THEN {a} END", f"CASE WHEN {a} IS NOT NULL THEN {b} END"
            stats.append(f"covar_pop({xa}, {ya}) AS c{i}_{j}, sqrt(var_pop({xa}) * var_pop({ya})) AS s{i}_{j}")
            structs.append(f"{{'a': '{a}', 'b': '{b}', 'r': CASE WHEN s{i}_{j} = 0 THEN NULL ELSE round(c{i}_{j} / s{i}_{j}, 6) END}}")
    return prefix + f", cs AS (SELECT {', '.join(stats)} FROM {src}), cl AS (SELECT unnest([{', '.join(structs)}]) AS p FROM cs) SELECT p.a AS a, p.b AS b, p.r AS r FROM cl"


def hist_sql(prefix: str, src: str, cols: list[str], bins: int) -> str:
    parts = []
    for c in cols:
        parts.append(f"""SELECT '{c}' AS "column", Bin, round(any_value(lo) + Bin * (any_value(hi) - any_value(lo)) / {bins}, 6) AS Bin_Start,
            round(any_value(lo) + (Bin + 1) * (any_value(hi) - any_value(lo)) / {bins}, 6) AS Bin_End, count(*) AS Count
            FROM (SELECT CAST(CASE WHEN hi - lo = 0 THEN 0 ELSE least(floor((x - lo) * {bins} / (hi - lo)), {bins - 1}) END AS INT) AS Bin, lo, hi
                  FROM (SELECT CAST({c} AS DOUBLE) AS x FROM {src} WHERE {c} IS NOT NULL AND NOT isnan(CAST({c} AS DOUBLE))) hx
                  CROSS JOIN (SELECT min(CAST({c} AS DOUBLE)) AS lo, max(CAST({c} AS DOUBLE)) AS hi FROM {src}
                              WHERE {c} IS NOT NULL AND NOT isnan(CAST({c} AS DOUBLE))) hr) hb GROUP BY Bin""")
    return prefix + " UNION ALL ".join(parts)


def box_sql(prefix: str, src: str, cols: list[str]) -> str:
    parts = []
    for c in cols:
        v = f"CAST({c} AS DOUBLE)"
        parts.append(f"""SELECT '{c}' AS "column", round(any_value(q1), 6) AS q1, round(any_value(md), 6) AS median, round(any_value(q3), 6) AS q3,
            round(min(CASE WHEN v >= q1 - 1.5 * (q3 - q1) THEN v END), 6) AS lower_whisker,
            round(max(CASE WHEN v <= q3 + 1.5 * (q3 - q1) THEN v END), 6) AS upper_whisker,
            CAST(count_if(v < q1 - 1.5 * (q3 - q1) OR v > q3 + 1.5 * (q3 - q1)) AS BIGINT) AS outliers
            FROM (SELECT {v} AS v FROM {src} WHERE {c} IS NOT NULL AND NOT isnan({v})) bv
            CROSS JOIN (SELECT quantile_cont({v}, 0.25) AS q1, quantile_cont({v}, 0.5) AS md, quantile_cont({v}, 0.75) AS q3
                        FROM {src} WHERE {c} IS NOT NULL AND NOT isnan({v})) bq""")
    return prefix + " UNION ALL ".join(parts)


def kde_sql(col: str, grid: int = 200, cut: float = 3.0) -> str:
    return SUBSCRIBERS_CTES + f"""
        , p AS (SELECT {TARGET_SQL} AS cls, CAST({col} AS DOUBLE) AS v FROM f WHERE {col} IS NOT NULL),
        cnt AS (SELECT cls, v, count(*) AS n FROM p GROUP BY cls, v),
        par AS (SELECT cls, count(*) AS cnt_all, stddev_samp(v) * pow(CAST(count(*) AS DOUBLE), -0.2) AS h,
                min(v) AS lo, max(v) AS hi FROM p GROUP BY cls),
        rng AS (SELECT min(lo - {cut} * h) AS g0, max(hi + {cut} * h) AS g1 FROM par),
        g AS (SELECT range AS k, g0 + (g1 - g0) * range / {grid - 1} AS x FROM range({grid}) CROSS JOIN rng)
        SELECT cnt.cls AS Churn, '{col}' AS "column", g.k, round(any_value(g.x), 6) AS x,
          round(sum(n * exp(-0.5 * pow((g.x - v) / par.h, 2))) / (any_value(par.cnt_all) * any_value(par.h) * sqrt(2 * pi())), 6) AS density
        FROM cnt JOIN par USING (cls) CROSS JOIN g GROUP BY cnt.cls, g.k"""


SUB_CORR = [("SeniorCitizen", "SeniorCitizen"), ("tenure", "tenure"), ("MonthlyCharges", "MonthlyCharges"),
            ("TotalCharges", parse_sql(blank("TotalCharges")))]
CUST = "WITH cu AS (SELECT * FROM customer) "

ORACLE = {
    "dataset_summary": summary_sql(RAW_CTES, "raw", RAW_KINDS),
    "dataset_summary_customer": summary_sql(CUST, "cu", CUSTOMER_KINDS),
    "preview": SUBSCRIBERS_CTES + "SELECT * REPLACE (round(MonthlyCharges, 6) AS MonthlyCharges) FROM f ORDER BY customerID LIMIT 100",
    "describe_all": describe_sql(CUST, "cu", CUSTOMER_KINDS),
    "describe_all_subscribers": describe_sql(RAW_CTES, "raw", RAW_KINDS),
    "describe_all_orders": describe_sql("WITH od AS (SELECT * FROM orders) ", "od", ORDERS_KINDS),
    "describe_all_lineitem": describe_sql("WITH li AS (SELECT * FROM lineitem) ", "li", LINEITEM_KINDS),
    "schema_table": RAW_CTES + " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", '{'string' if k == 'text' else k}' AS type, count({c}) AS non_null FROM raw" for c, k in RAW_KINDS),
    "missing_patterns": RAW_CTES + "SELECT " + ", ".join(f"CAST(({_miss(c, k)}) AS INT) AS {c}" for c, k in RAW_KINDS)
        + ", count(*) AS Rows FROM raw GROUP BY ALL",
    "missing_by_column": missing_sql(RAW_CTES, "raw", RAW_KINDS),
    "missing_by_column_events": missing_sql("WITH ev AS (SELECT * FROM events) ", "ev", EVENTS_KINDS),
    "corr_matrix": corr_sql(SUBSCRIBERS_CTES, "f", SUB_CORR),
    "corr_matrix_lineitem": corr_sql("WITH li AS (SELECT * FROM lineitem) ", "li", [(c, c) for c in LINEITEM_NUM]),
    "corr_matrix_measures": corr_wide_sql(measures_ctes("RAN"), "lm", measure_columns("RAN")),
    "histograms": hist_sql(RAW_CTES, "raw", ["SeniorCitizen", "tenure", "MonthlyCharges"], 30),
    "histograms_orders": hist_sql("WITH od AS (SELECT * FROM orders) ", "od", ORDERS_NUM, 30),
    "box_stats": box_sql(RAW_CTES, "raw", ["SeniorCitizen", "tenure", "MonthlyCharges"]),
    "box_stats_lineitem": box_sql("WITH li AS (SELECT * FROM lineitem) ", "li", LINEITEM_NUM),
    "class_distribution": SUBSCRIBERS_CTES + "SELECT Churn, count(*) AS Customers FROM f GROUP BY Churn",
    "churn_rate_by_category": SUBSCRIBERS_CTES + f"""
        SELECT 'Contract' AS Feature, Contract AS Value, round(avg({TARGET_SQL}), 6) AS Churn_Rate, count(*) AS Customers FROM f GROUP BY Contract
        UNION ALL SELECT 'TechSupport', TechSupport, round(avg({TARGET_SQL}), 6), count(*) FROM f GROUP BY TechSupport""",
    "kde_by_class": kde_sql("tenure"),
    "kde_by_class_monthly": kde_sql("MonthlyCharges"),
}
