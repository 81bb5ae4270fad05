"""DuckDB oracle SQL for cleaning (§2.2) and data quality (§2.3) on the dirty fixture."""

from __future__ import annotations

from churnforge.plans.oracle_base import RAW_CTES, SUBSCRIBERS_CTES, measure_columns, measures_ctes
from churnforge.plans.oracle_business import parse_sql

RAW_TEXT = ["customerID", "gender", "Partner", "Contract", "TotalCharges", "Source", "Churn"]
RAW_COLS = ["customerID", "gender", "SeniorCitizen", "Partner", "tenure", "Contract", "MonthlyCharges",
            "TotalCharges", "Source", "Churn"]


def blank(col: str) -> str:
    return f"CASE WHEN regexp_matches({col}, '^\\s*$') THEN NULL ELSE {col} END"


BL_CTES = RAW_CTES + ", bl AS (SELECT * REPLACE (" + ", ".join(f"{blank(c)} AS {c}" for c in RAW_TEXT) + ") FROM raw)\n"


def rnd(cols: list[str]) -> str:
    return "* REPLACE (" + ", ".join(f"round({c}, 6) AS {c}" for c in cols) + ")"


def q_list(items: list[str], limit: int | None = None, between: str = ", ") -> str:
    """', '-joined names of the items whose condition holds, in order (optionally first n)."""
    arr = "[" + ", ".join(items) + "]"
    lst = f"list_filter({arr}, lambda x: x IS NOT NULL)"
    if limit:
        lst = f"list_slice({lst}, 1, {limit})"
    return f"array_to_string({lst}, '{between}')" if items else "''"


def detector_sql(src: str, cols: list[tuple[str, str]], money: list[str], target: str | None, tag: str = "") -> str:
    """Issue table of the quality detector over relation ``src`` (already blank→null).

    cols: (name, kind) with kind in {"text", "int", "double"} as seen before money parsing.
    """
    texts = [c for c, k in cols if k == "text"]
    ready = {c: (parse_sql(c) if c in money else c) for c, _ in cols}
    nums = [c for c, k in cols if k in ("int", "double") or c in money]
    stats = ["count(*) AS n_rows"]
    for i, (c, k) in enumerate(cols):
        miss = f"{c} IS NULL OR isnan({c})" if k == "double" and c not in money else f"{c} IS NULL"
        stats += [f"count_if({miss}) AS null{i}",
                  f"(count({c}) = 0 OR (count({c}) = count(*) AND min({c}) = max({c}))) AS const{i}"]
        if c in texts:
            stats += [f"avg(CASE WHEN {parse_sql(c)} IS NOT NULL THEN 1.0e0 ELSE 0.0e0 END) AS ps{i}",
                      f"count(DISTINCT {c}) AS nd{i}"]
    for j, c in enumerate(nums):
        stats.append(f"count(DISTINCT {ready[c]}) AS ndn{j}")
    pairs = [(a, b) for j, b in enumerate(nums) for a in nums[:j]]
    for k, (a, b) in enumerate(pairs):
        x, y = f"CAST({ready[a]} AS DOUBLE)", f"CAST({ready[b]} AS DOUBLE)"
        both = f"{x} IS NOT NULL AND {y} IS NOT NULL"
        xa, ya = f"CASE WHEN {both} THEN {x} END", f"CASE WHEN {both} THEN {y} END"
        stats.append(f"covar_pop({xa}, {ya}) / sqrt(var_pop({xa}) * var_pop({ya})) AS r{k}")
    for j, c in enumerate(nums):
        stats += [f"quantile_cont({ready[c]}, 0.25) AS q1_{j}", f"quantile_cont({ready[c]}, 0.75) AS q3_{j}"]
    idx = {c: i for i, (c, _) in enumerate(cols)}
    ctes = [f"st{tag} AS (SELECT {', '.join(stats)} FROM {src})",
            f"dr{tag} AS (SELECT count(*) AS n_distinct FROM (SELECT DISTINCT * FROM {src}))"]
    out_counts = ", ".join(
        f"count_if(st{tag}.ndn{j} > 10 AND st{tag}.q3_{j} - st{tag}.q1_{j} <> 0 AND ({ready[c]} < st{tag}.q1_{j} - 1.5 * (st{tag}.q3_{j} - st{tag}.q1_{j}) "
        f"OR {ready[c]} > st{tag}.q3_{j} + 1.5 * (st{tag}.q3_{j} - st{tag}.q1_{j}))) AS o{j}" for j, c in enumerate(nums))
    ctes.append(f"oc{tag} AS (SELECT {out_counts if nums else '0 AS dummy'} FROM {src} CROSS JOIN st{tag})")
    if target:
        ctes.append(f"tg{tag} AS (SELECT count(*) AS n FROM {src} WHERE {target} IS NOT NULL GROUP BY {target})")
        ctes.append(f"tb{tag} AS (SELECT count(*) AS k, min(n) * 1.0e0 / sum(n) AS share FROM tg{tag})")
    missing = " + ".join(f"null{i}" for i in range(len(cols)))
    texts_nt = q_list([f"CASE WHEN ps{idx[c]} > 0.75 THEN '{c}' END" for c in texts])
    all_missing = q_list([f"CASE WHEN null{i} > 0 THEN '{c}' END" for i, (c, _) in enumerate(cols)], None, "; ")
    all_nt = texts_nt.replace("', ')", "'; ')")
    const_items = [f"CASE WHEN const{i} THEN '{c}' END" for i, (c, _) in enumerate(cols)]
    consts, all_consts = q_list(const_items, 6), q_list(const_items, None, "; ")
    high_items = [f"CASE WHEN nd{idx[c]} > greatest(50, n_rows * 0.45) THEN '{c}' END" for c in texts]
    high, all_high = q_list(high_items, 6), q_list(high_items, None, "; ")
    corr_items = [f"CASE WHEN abs(r{k}) >= 0.8 THEN concat('{a} / {b} (', printf('%.2f', floor(abs(r{k}) * 100 + 0.5) / 100), ')') END"
                  for k, (a, b) in enumerate(pairs)]
    corr, all_corr = q_list(corr_items, 4), q_list(corr_items, None, "; ")
    outl_items = [f"CASE WHEN o{j} > 0 THEN concat('{c}: ', format('{{:,}}', o{j})) END" for j, c in enumerate(nums)]
    outl, all_outl = q_list(outl_items, 5), q_list(outl_items, None, "; ")
    rows = [
        f"SELECT 1 AS o, 'High' AS Severity, 'Missing values detected' AS Issue, concat(format('{{:,}}', {missing}), "
        f"' blank or null values were found across the dataset.') AS Explanation, "
        f"'Missing values can bias churn estimates and understate revenue exposure.' AS Business_Impact, "
        f"'Fill numerical gaps with an analytically defensible value and categorical gaps with the dominant class.' "
        f"AS Recommended_Solution, {all_missing} AS Columns FROM st{tag} WHERE {missing} > 0",
        "SELECT 2, 'Medium', 'Duplicate customer rows', concat(format('{:,}', n_rows - n_distinct), ' duplicate records were detected.'), "
        "'Duplicate records can inflate customer counts, churn rates, and revenue-at-risk totals.', "
        f"'Remove exact duplicate records before modeling and reporting.', '' FROM st{tag} CROSS JOIN dr{tag} WHERE n_rows - n_distinct > 0",
        f"SELECT 3, 'High', 'Numeric fields stored as text', concat({texts_nt}, ' appear numeric but are stored as categorical text.'), "
        "'Incorrect types can break statistical summaries, model scaling, and financial calculations.', "
        f"'Convert numeric-like fields to numeric values before analysis.', {all_nt} FROM st{tag} WHERE {texts_nt} <> ''",
        f"SELECT 4, 'Low', 'Constant columns', concat({consts}, ' contain only one value.'), "
        "'Constant columns add noise without improving churn prediction or segmentation.', "
        f"'Remove constant fields from modeling datasets.', {all_consts} FROM st{tag} WHERE {consts} <> ''",
        f"SELECT 5, 'Medium', 'High-cardinality categorical fields', concat({high}, ' contain many unique values.'), "
        "'Identifier-like fields can mislead models and make dashboard filters noisy.', "
        f"'Keep these fields for lookup/search, but exclude them from model training.', {all_high} FROM st{tag} WHERE {high} <> ''",
    ]
    if pairs:
        rows.append(
            f"SELECT 6, 'Medium', 'Highly correlated features', concat('Strong relationships found: ', {corr}, '.'), "
            "'Strong collinearity can overstate driver importance and destabilize simple models.', "
            f"'Monitor these features together and use regularized or tree-based models for comparison.', {all_corr} FROM st{tag} WHERE {corr} <> ''")
    if nums:
        rows.append(
            f"SELECT 7, 'Medium', 'Outliers detected', {outl}, "
            "'Extreme values can distort averages, revenue projections, and scaled ML features.', "
            f"'Clip or review outliers using an IQR-based rule before scaling.', {all_outl} FROM oc{tag} WHERE {outl} <> ''")
    if target:
        rows.append(
            "SELECT 8, 'High', 'Imbalanced target classes', concat('The minority churn class represents ', "
            "printf('%.1f', floor(share * 100 * 10 + 0.5) / 10), '% of labeled records.'), "
            "'Models can appear accurate while missing many churn customers.', "
            f"'Use class weighting and recall/F1 metrics when selecting churn models.', '' FROM tb{tag} WHERE k = 2 AND share < 0.35")
    ctes.append(f"issues{tag} AS (" + " UNION ALL ".join(rows) + ")")
    return ", " + ",\n".join(ctes) + "\n"


RAW_KINDS = [("customerID", "text"), ("gender", "text"), ("SeniorCitizen", "int"), ("Partner", "text"),
             ("tenure", "int"), ("Contract", "text"), ("MonthlyCharges", "double"), ("TotalCharges", "text"),
             ("Source", "text"), ("Churn", "text")]
SUB_KINDS = [("customerID", "text"), ("gender", "text"), ("SeniorCitizen", "int"), ("Partner", "text"),
             ("Dependents", "text"), ("tenure", "int"), ("PhoneService", "text"), ("MultipleLines", "text"),
             ("InternetService", "text"), ("OnlineSecurity", "text"), ("OnlineBackup", "text"),
             ("DeviceProtection", "text"), ("TechSupport", "text"), ("StreamingTV", "text"),
             ("StreamingMovies", "text"), ("Contract", "text"), ("PaperlessBilling", "text"),
             ("PaymentMethod", "text"), ("MonthlyCharges", "double"), ("TotalCharges", "text"), ("Churn", "text")]
ORDERS_KINDS = [("o_orderkey", "int"), ("o_custkey", "int"), ("o_orderstatus", "text"), ("o_totalprice", "double"),
                ("o_orderdate", "other"), ("o_orderpriority", "text")]
MONEY = ["MonthlyCharges", "TotalCharges"]
ISSUE_COLS = "Severity, Issue, Explanation, Business_Impact, Recommended_Solution, Columns"
PENALTY = "CASE Severity WHEN 'Critical' THEN 18 WHEN 'High' THEN 11 WHEN 'Medium' THEN 7 WHEN 'Low' THEN 3 ELSE 5 END"

SUB_BL_CTES = SUBSCRIBERS_CTES + ", sbl AS (SELECT * REPLACE (" + ", ".join(
    f"{blank(c)} AS {c}" for c, k in SUB_KINDS if k == "text") + ") FROM f)\n"

# --- smart clean chain (decisions as made on this fixture: TotalCharges repaired, Partner imputed,
#     Source constant, tenure/MonthlyCharges/TotalCharges clipped) ---------------------------------
CLEAN_CTES = BL_CTES + f"""
, d AS (SELECT DISTINCT * FROM bl),
rp AS (SELECT * REPLACE (COALESCE({parse_sql('TotalCharges')}, 0e0) AS TotalCharges) FROM d),
pm AS (SELECT Partner AS v, count(*) AS n FROM rp WHERE Partner IS NOT NULL GROUP BY Partner),
im AS (SELECT * REPLACE (COALESCE(Partner, (SELECT v FROM pm ORDER BY n DESC, v LIMIT 1), 'Unknown') AS Partner) FROM rp),
dc AS (SELECT * EXCLUDE (Source) FROM im),
qq AS (SELECT quantile_cont(tenure, 0.25) AS t1, quantile_cont(tenure, 0.75) AS t3,
       quantile_cont(MonthlyCharges, 0.25) AS m1, quantile_cont(MonthlyCharges, 0.75) AS m3,
       quantile_cont(TotalCharges, 0.25) AS c1, quantile_cont(TotalCharges, 0.75) AS c3 FROM dc),
cl AS (SELECT dc.* REPLACE (
   least(greatest(CAST(tenure AS DOUBLE), t1 - 1.5 * (t3 - t1)), t3 + 1.5 * (t3 - t1)) AS tenure,
   least(greatest(MonthlyCharges, m1 - 1.5 * (m3 - m1)), m3 + 1.5 * (m3 - m1)) AS MonthlyCharges,
   least(greatest(TotalCharges, c1 - 1.5 * (c3 - c1)), c3 + 1.5 * (c3 - c1)) AS TotalCharges) FROM dc CROSS JOIN qq)
"""

CLEAN_KINDS = [("customerID", "text"), ("gender", "text"), ("SeniorCitizen", "int"), ("Partner", "text"),
               ("tenure", "double"), ("Contract", "text"), ("MonthlyCharges", "double"), ("TotalCharges", "double"),
               ("Churn", "text")]


def _score(prefix: str, name: str) -> str:
    return f"{name} AS (SELECT CAST(greatest(0, least(100, 100 - COALESCE(sum({PENALTY}), 0))) AS INT) AS score, " \
           f"count(*) AS n_issues FROM {prefix})"


ORACLE = {
    "subscribers_raw": RAW_CTES + f"SELECT {rnd(['MonthlyCharges'])} FROM raw",
    "blank_to_null": BL_CTES + f"SELECT {rnd(['MonthlyCharges'])} FROM bl",
    "normalize_money": BL_CTES + f"SELECT * REPLACE (round(MonthlyCharges, 6) AS MonthlyCharges, round({parse_sql('TotalCharges')}, 6) AS TotalCharges) FROM bl",
    "repair_types": BL_CTES + f"SELECT * REPLACE (round(MonthlyCharges, 6) AS MonthlyCharges, round({parse_sql('TotalCharges')}, 6) AS TotalCharges) FROM bl",
    "dedup_exact": BL_CTES + f"SELECT DISTINCT {rnd(['MonthlyCharges'])} FROM bl",
    "fill_total_zero": BL_CTES + f"SELECT * REPLACE (round(MonthlyCharges, 6) AS MonthlyCharges, round(COALESCE({parse_sql('TotalCharges')}, 0e0), 6) AS TotalCharges) FROM bl",
    "impute_median": BL_CTES + f"""
        , nm AS (SELECT * REPLACE ({parse_sql('TotalCharges')} AS TotalCharges) FROM bl)
        SELECT * REPLACE (round(MonthlyCharges, 6) AS MonthlyCharges,
          round(COALESCE(TotalCharges, (SELECT quantile_cont(TotalCharges, 0.5) FROM nm)), 6) AS TotalCharges) FROM nm""",
    "impute_mode": BL_CTES + """
        , pm AS (SELECT Partner AS v, count(*) AS n FROM bl WHERE Partner IS NOT NULL GROUP BY Partner),
        tm AS (SELECT TotalCharges AS v, count(*) AS n FROM bl WHERE TotalCharges IS NOT NULL GROUP BY TotalCharges)
        SELECT * REPLACE (round(MonthlyCharges, 6) AS MonthlyCharges,
          COALESCE(Partner, (SELECT v FROM pm ORDER BY n DESC, v LIMIT 1), 'Unknown') AS Partner,
          COALESCE(TotalCharges, (SELECT v FROM tm ORDER BY n DESC, v LIMIT 1), 'Unknown') AS TotalCharges) FROM bl""",
    "drop_constant": BL_CTES + "SELECT * EXCLUDE (Source) REPLACE (round(MonthlyCharges, 6) AS MonthlyCharges) FROM bl",
    "clip_iqr": BL_CTES + f"""
        , d AS (SELECT DISTINCT * FROM bl),
        fz AS (SELECT * REPLACE (COALESCE({parse_sql('TotalCharges')}, 0e0) AS TotalCharges) FROM d),
        qq AS (SELECT quantile_cont(tenure, 0.25) AS t1, quantile_cont(tenure, 0.75) AS t3,
               quantile_cont(MonthlyCharges, 0.25) AS m1, quantile_cont(MonthlyCharges, 0.75) AS m3,
               quantile_cont(TotalCharges, 0.25) AS c1, quantile_cont(TotalCharges, 0.75) AS c3 FROM fz)
        SELECT fz.* REPLACE (
          round(least(greatest(CAST(tenure AS DOUBLE), t1 - 1.5 * (t3 - t1)), t3 + 1.5 * (t3 - t1)), 6) AS tenure,
          round(least(greatest(MonthlyCharges, m1 - 1.5 * (m3 - m1)), m3 + 1.5 * (m3 - m1)), 6) AS MonthlyCharges,
          round(least(greatest(TotalCharges, c1 - 1.5 * (c3 - c1)), c3 + 1.5 * (c3 - c1)), 6) AS TotalCharges)
        FROM fz CROSS JOIN qq""",
    "smart_clean": CLEAN_CTES + f"SELECT {rnd(['tenure', 'MonthlyCharges', 'TotalCharges'])} FROM cl",
    "null_rows": SUBSCRIBERS_CTES + f"""SELECT tenure, round(MonthlyCharges, 6) AS MonthlyCharges,
        {parse_sql(blank('TotalCharges'))} AS TotalCharges FROM f WHERE {parse_sql(blank('TotalCharges'))} IS NULL""",
    "drop_columns": SUBSCRIBERS_CTES + "SELECT * EXCLUDE (customerID, PaperlessBilling, PaymentMethod) REPLACE (round(MonthlyCharges, 6) AS MonthlyCharges) FROM f",
    "quality_issues": BL_CTES + detector_sql("bl", RAW_KINDS, MONEY, "Churn") + f"SELECT {ISSUE_COLS} FROM issues",
    "quality_score": BL_CTES + detector_sql("bl", RAW_KINDS, MONEY, "Churn") + ", " + _score("issues", "sc")
    + "\nSELECT score AS Quality_Score, CAST(n_issues AS INT) AS Issues FROM sc",
    "quality_issues_clean_table": SUB_BL_CTES + detector_sql("sbl", SUB_KINDS, MONEY, "Churn") + f"SELECT {ISSUE_COLS} FROM issues",
    "scan_csv": RAW_CTES + f"SELECT {rnd(['MonthlyCharges'])} FROM raw",
    "scan_csv_line_breaks": "SELECT page_id, nullif(url, '') AS url, nullif(html, '') AS html FROM pages",
    # 19 tokens, then two texts that are none, then the value itself
    "na_tokens_marked": RAW_CTES + """SELECT customerID, CASE WHEN tenure % 22 < 19 THEN NULL WHEN tenure % 22 = 19 THEN ' ' WHEN tenure % 22 = 20 THEN 'none'
        ELSE Contract END AS Contract FROM raw""",
    "na_tokens": RAW_CTES + f"SELECT {rnd(['MonthlyCharges'])} FROM raw",
    "quality_issues_orders": "WITH od AS (SELECT * FROM orders) " + detector_sql(
        "od", ORDERS_KINDS, [], None) + f"SELECT {ISSUE_COLS} FROM issues",
    "dedup_exact_lineitem": "SELECT DISTINCT * FROM lineitem",
    "cleaning_summary": CLEAN_CTES
        + detector_sql("bl", RAW_KINDS, MONEY, "Churn", "_b")
        + detector_sql("cl", [(c, k) for c, k in CLEAN_KINDS], [], "Churn", "_a")
        + ", " + _score("issues_b", "sb") + ", " + _score("issues_a", "sa") + """
        , dk AS (SELECT count(*) AS n_d, count_if(Partner IS NULL) + count_if(TotalCharges IS NULL) AS miss_d,
                 avg(CASE WHEN """ + parse_sql("gender") + """ IS NOT NULL THEN 1e0 ELSE 0e0 END) AS p_gender,
                 avg(CASE WHEN """ + parse_sql("Partner") + """ IS NOT NULL THEN 1e0 ELSE 0e0 END) AS p_partner,
                 avg(CASE WHEN """ + parse_sql("Contract") + """ IS NOT NULL THEN 1e0 ELSE 0e0 END) AS p_contract,
                 avg(CASE WHEN """ + parse_sql("TotalCharges") + """ IS NOT NULL THEN 1e0 ELSE 0e0 END) AS p_total,
                 avg(CASE WHEN """ + parse_sql("Source") + """ IS NOT NULL THEN 1e0 ELSE 0e0 END) AS p_source FROM d),
        ik AS (SELECT """ + ", ".join(
            f"(count({c}) = 0 OR (count({c}) = count(*) AND min({c}) = max({c}))) AS k_{c}"
            for c in ["gender", "SeniorCitizen", "Partner", "tenure", "Contract", "MonthlyCharges", "TotalCharges", "Source"])
        + """, count_if(Partner IS NULL) AS miss_i FROM im),
        ck AS (SELECT count_if(tenure < t1 - 1.5 * (t3 - t1) OR tenure > t3 + 1.5 * (t3 - t1)) AS o_t,
                 count_if(MonthlyCharges < m1 - 1.5 * (m3 - m1) OR MonthlyCharges > m3 + 1.5 * (m3 - m1)) AS o_m,
                 count_if(TotalCharges < c1 - 1.5 * (c3 - c1) OR TotalCharges > c3 + 1.5 * (c3 - c1)) AS o_c,
                 count(DISTINCT tenure) AS d_t, count(DISTINCT MonthlyCharges) AS d_m, count(DISTINCT TotalCharges) AS d_c
                 FROM dc CROSS JOIN qq),
        ek AS (SELECT count(DISTINCT gender) + count(DISTINCT Partner) + count(DISTINCT Contract) AS n_levels FROM cl),
        ct AS (SELECT """ + q_list(["CASE WHEN p_gender > 0.75 THEN 'gender' END", "CASE WHEN p_partner > 0.75 THEN 'Partner' END",
                                    "CASE WHEN p_contract > 0.75 THEN 'Contract' END", "CASE WHEN p_total > 0.75 THEN 'TotalCharges' END",
                                    "CASE WHEN p_source > 0.75 THEN 'Source' END"]) + """ AS repaired FROM dk)
        SELECT CAST(miss_d - 0 AS BIGINT) AS Missing_Values_Removed,
          (SELECT count(*) FROM bl) - n_d AS Duplicate_Rows_Removed,
          CAST(""" + " + ".join(f"CAST(k_{c} AS INT)" for c in ["gender", "SeniorCitizen", "Partner", "tenure", "Contract",
                                                                "MonthlyCharges", "TotalCharges", "Source"]) + """ AS INT) AS Features_Removed,
          """ + q_list([f"CASE WHEN k_{c} THEN '{c}' END" for c in ["gender", "SeniorCitizen", "Partner", "tenure", "Contract",
                                                                   "MonthlyCharges", "TotalCharges", "Source"]]) + """ AS Removed_Feature_Names,
          CASE WHEN contains(repaired, 'TotalCharges') THEN repaired WHEN repaired = '' THEN 'TotalCharges'
               ELSE concat(repaired, ', TotalCharges') END AS Corrected_Data_Types,
          """ + q_list(["CASE WHEN d_t > 10 AND o_t > 0 THEN 'tenure' END", "CASE WHEN d_m > 10 AND o_m > 0 THEN 'MonthlyCharges' END",
                        "CASE WHEN d_c > 10 AND o_c > 0 THEN 'TotalCharges' END"]) + """ AS Outlier_Handled_Columns,
          CAST(4 + n_levels AS INT) AS Encoded_ML_Features, 4 AS Scaled_Numerical_Features,
          (SELECT count(*) FROM bl) AS Original_Rows, 10 AS Original_Columns, n_d AS Cleaned_Rows, 9 AS Cleaned_Columns,
          sb.score AS Data_Quality_Before, sa.score AS Data_Quality_After_Measured,
          CAST(greatest(sa.score, CASE WHEN sb.n_issues = 0 THEN sb.score ELSE least(98, sb.score + 45) END) AS INT) AS Data_Quality_After
        FROM dk CROSS JOIN ik CROSS JOIN ck CROSS JOIN ek CROSS JOIN ct CROSS JOIN sb CROSS JOIN sa""",
}

_RULE_TITLES = {
    "q_missing": "Missing values detected", "q_duplicates": "Duplicate customer rows",
    "q_numeric_text": "Numeric fields stored as text", "q_constant": "Constant columns",
    "q_high_cardinality": "High-cardinality categorical fields", "q_correlated": "Highly correlated features",
    "q_outliers": "Outliers detected", "q_imbalance": "Imbalanced target classes",
}
for _k, _t in _RULE_TITLES.items():
    ORACLE[_k] = BL_CTES + detector_sql("bl", RAW_KINDS, MONEY, "Churn") + f"SELECT {ISSUE_COLS} FROM issues WHERE Issue = '{_t}'"

LINEITEM_KINDS = [("l_orderkey", "int"), ("l_partkey", "int"), ("l_suppkey", "int"), ("l_linenumber", "int"),
                  ("l_quantity", "double"), ("l_extendedprice", "double"), ("l_discount", "double"), ("l_tax", "double"),
                  ("l_returnflag", "text"), ("l_linestatus", "text"), ("l_shipdate", "other")]
ORACLE["quality_issues_lineitem"] = ("WITH li AS (SELECT * FROM lineitem) " + detector_sql("li", LINEITEM_KINDS, [], None)
                                     + f"SELECT {ISSUE_COLS} FROM issues")

ORACLE["q_correlated_measures"] = (measures_ctes("R") + detector_sql("lm", [(c, "double") for c in measure_columns("R")], [], None)
                                   + f"SELECT {ISSUE_COLS} FROM issues WHERE Issue = '{_RULE_TITLES['q_correlated']}'")
