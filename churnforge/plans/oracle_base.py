"""SQL text of the fixture tables (ANSI, runs on DuckDB and Spark alike).

Each oracle query appends its own CTEs to one of these prefixes.
"""

SUBSCRIBERS_CTES = """
WITH b AS (
 SELECT o.o_orderkey AS k, o.o_orderstatus AS st, o.o_orderpriority AS pr, c.c_mktsegment AS seg, c.c_nationkey AS nk,
  CAST(1825 + CAST(floor(o.o_totalprice) AS BIGINT) % 10051 AS BIGINT) AS cents,
  CAST(greatest(least((2001 - year(o.o_orderdate))*12 + (7 - month(o.o_orderdate)), 72), 0) AS INT) AS tenure,
  md5(CAST(o.o_orderkey AS STRING)) AS h
 FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey),
n AS (SELECT *, CAST(ascii(substr(h,1,1)) + 3*ascii(substr(h,2,1)) + 7*ascii(substr(h,3,1)) AS BIGINT) % 100 AS u FROM b),
f AS (SELECT
  concat('C', lpad(CAST(k AS STRING), 9, '0')) AS customerID,
  CASE WHEN k % 2 = 0 THEN 'Female' ELSE 'Male' END AS gender,
  CAST(CASE WHEN k % 6 = 0 THEN 1 ELSE 0 END AS INT) AS SeniorCitizen,
  CASE WHEN nk % 2 = 0 THEN 'Yes' ELSE 'No' END AS Partner,
  CASE WHEN nk % 10 < 3 THEN 'Yes' ELSE 'No' END AS Dependents,
  tenure,
  CASE WHEN k % 10 = 0 THEN 'No' ELSE 'Yes' END AS PhoneService,
  CASE WHEN k % 10 = 0 THEN 'No phone service' WHEN k % 7 < 3 THEN 'Yes' ELSE 'No' END AS MultipleLines,
  CASE WHEN seg IN ('AUTOMOBILE','MACHINERY') THEN 'Fiber optic' WHEN seg = 'HOUSEHOLD' THEN 'No' ELSE 'DSL' END AS InternetService,
  CASE WHEN seg = 'HOUSEHOLD' THEN 'No internet service' WHEN k % 3 = 0 THEN 'Yes' ELSE 'No' END AS OnlineSecurity,
  CASE WHEN seg = 'HOUSEHOLD' THEN 'No internet service' WHEN k % 5 < 2 THEN 'Yes' ELSE 'No' END AS OnlineBackup,
  CASE WHEN seg = 'HOUSEHOLD' THEN 'No internet service' WHEN k % 11 < 4 THEN 'Yes' ELSE 'No' END AS DeviceProtection,
  CASE WHEN seg = 'HOUSEHOLD' THEN 'No internet service' WHEN k % 13 < 4 THEN 'Yes' ELSE 'No' END AS TechSupport,
  CASE WHEN seg = 'HOUSEHOLD' THEN 'No internet service' WHEN k % 17 < 7 THEN 'Yes' ELSE 'No' END AS StreamingTV,
  CASE WHEN seg = 'HOUSEHOLD' THEN 'No internet service' WHEN k % 19 < 8 THEN 'Yes' ELSE 'No' END AS StreamingMovies,
  CASE st WHEN 'F' THEN 'Month-to-month' WHEN 'O' THEN 'One year' ELSE 'Two year' END AS Contract,
  CASE WHEN k % 5 < 3 THEN 'Yes' ELSE 'No' END AS PaperlessBilling,
  CASE substr(pr,1,1) WHEN '1' THEN 'Electronic check' WHEN '2' THEN 'Mailed check' WHEN '3' THEN 'Bank transfer (automatic)' WHEN '4' THEN 'Credit card (automatic)' ELSE 'Electronic check' END AS PaymentMethod,
  CAST(cents AS DOUBLE) / CAST(100 AS DOUBLE) AS MonthlyCharges,
  CASE WHEN tenure = 0 THEN ' ' ELSE concat(CAST(CAST(floor(CAST(cents*tenure AS DOUBLE)/CAST(100 AS DOUBLE)) AS BIGINT) AS STRING), '.', lpad(CAST((cents*tenure) % 100 AS STRING),2,'0')) END AS TotalCharges,
  CASE WHEN u < 8 + CASE st WHEN 'F' THEN 38 WHEN 'O' THEN 8 ELSE 0 END + CASE WHEN tenure <= 12 THEN 22 ELSE 0 END + CASE WHEN cents >= 7500 THEN 10 ELSE 0 END - CASE WHEN tenure > 48 THEN 8 ELSE 0 END THEN 'Yes' ELSE 'No' END AS Churn
 FROM n)
"""

RAW_CTES = SUBSCRIBERS_CTES + """
, r AS (SELECT customerID, gender, SeniorCitizen,
  CASE WHEN SeniorCitizen = 1 AND tenure % 10 = 3 THEN CAST(NULL AS STRING) ELSE Partner END AS Partner,
  tenure, Contract,
  CASE WHEN tenure = 71 THEN MonthlyCharges * 10 ELSE MonthlyCharges END AS MonthlyCharges,
  TotalCharges, 'telco' AS Source, Churn FROM f),
raw AS (SELECT * FROM r UNION ALL SELECT * FROM r WHERE customerID LIKE '%77')
"""

SCORED_CTES = SUBSCRIBERS_CTES + """
, s AS (SELECT f.*, 0.9e0 - 0.024e0*(tenure-38) + 0.010e0*(MonthlyCharges-68)
        - CASE Contract WHEN 'One year' THEN 1.3e0 WHEN 'Two year' THEN 2.0e0 ELSE 0e0 END
        + 0.08e0*SeniorCitizen AS z FROM f),
scored0 AS (SELECT s.*, round(1e0/(1e0+exp(-z)),6) AS Churn_Probability,
  CASE WHEN InternetService='No' THEN 0 WHEN tenure<36 THEN 1 ELSE 2 END AS Cluster FROM s),
scored AS (SELECT *, CASE WHEN Churn_Probability > 0.5e0 THEN 1 ELSE 0 END AS Predicted_Churn FROM scored0)
"""

MEASURES = {"quantity": "CAST(l_quantity AS DOUBLE)", "price": "price", "discount": "discount", "tax": "tax", "net": "net",
            "gross": "net * (1e0 + tax)", "saved": "price * discount", "duty": "net * tax"}


def measure_columns(flags: str) -> list[str]:
    return list(MEASURES) + [f"{m}_{f}" for f in flags for m in MEASURES]


def measures_ctes(flags: str) -> str:
    columns = [f"{e} AS {m}" for m, e in MEASURES.items()] + [
        f"CASE WHEN l_returnflag = '{f}' THEN {e} END AS {m}_{f}" for f in flags for m, e in MEASURES.items()]
    return ("WITH lp AS (SELECT *, CAST(l_extendedprice AS DOUBLE) AS price, CAST(l_discount AS DOUBLE) AS discount, CAST(l_tax AS DOUBLE) AS tax, "
            "CAST(l_extendedprice AS DOUBLE) * (1e0 - CAST(l_discount AS DOUBLE)) AS net FROM lineitem), "
            f"lm AS (SELECT {', '.join(columns)} FROM lp) ")


def subscribers_sql() -> str:
    return SUBSCRIBERS_CTES + "SELECT * FROM f"


def raw_sql() -> str:
    return RAW_CTES + "SELECT * FROM raw"


def scored_sql() -> str:
    return SCORED_CTES + "SELECT * FROM scored"
