"""Data-quality detector: issue table + 0..100 score.

The decisions need only per-column numbers, gathered in a handful of passes:
one wide aggregate (rows, nulls, parse shares, min/max, pairwise moments for
correlation), one distinct-row count (shuffle with map-side combine), exact
distinct counts of all columns,
distributed quartiles for the outlier rule, and the target's class counts.
Correlation uses population moments over pairwise-complete rows with
``try_divide``, so a constant column gives null (never a divide-by-zero).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnforge.functions import constants as K
from churnforge.functions import exprs as X
from churnforge.operators import clean as C
from churnforge.operators.gram import correlations, pair_moments

ISSUE_SCHEMA = ("Severity string, Issue string, Explanation string, Business_Impact string, "
                "Recommended_Solution string, Columns array<string>")


# Up to so many numeric columns, moments of all pairs ride in one aggregate of the whole table. The code that Spark makes
# for an aggregate grows with the pairs; beyond a few the JVM no longer compiles it, and every row is interpreted.
FEW_COLUMNS = 3


def _fmt_int(n: int) -> str:
    return f"{n:,}"


def _fmt2(v: float) -> str:
    # half-up at 2 decimals on the IEEE value, like the SQL twin
    import math
    return f"{math.floor(v * 100 + 0.5) / 100:.2f}"


def _fmt_pct1(v: float) -> str:
    import math
    return f"{math.floor(v * 100 * 10 + 0.5) / 10:.1f}%"


def pairwise_correlations(df: DataFrame, cols: list[str]) -> list[tuple[str, str, float | None]]:
    """Pearson r for every pair i<j (column order), pairwise-complete rows; null if undefined."""
    place = {c: k for k, c in enumerate(cols)}
    rows = [(r["a"], r["b"], r["r"]) for r in correlation_frame(df, cols).collect()]
    return sorted(rows, key=lambda r: (place[r[1]], place[r[0]]))


def correlation_frame(df: DataFrame, cols: list[str]) -> DataFrame:
    """Long (a, b, r) for all pairs, null r when undefined: one aggregate of moments for few columns, one Gram pass for many."""
    spark = df.sparkSession
    if len(cols) < 2:
        return spark.createDataFrame([], "a string, b string, r double")
    if len(cols) > FEW_COLUMNS:
        return correlations(df, cols)
    aggs = []
    for a, b in _pairs(cols):
        cov, vx, vy = pair_moments(*(X.nan_to_null(F.col(f"`{c}`").cast("double")) for c in (a, b)))
        aggs.append(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.try_divide(cov, F.sqrt(vx * vy)).alias("r")))
    return df.agg(F.array(*aggs).alias("_p")).select(F.inline("_p"))


def _pairs(cols: list[str]) -> list[tuple[str, str]]:
    return [(a, b) for j, b in enumerate(cols) for a in cols[:j]]


def detect_quality(df: DataFrame, target: str = "Churn") -> tuple[list[dict], int]:
    """Issues (list of dicts, reference order) and the score."""
    return _detect(C.blank_to_null(df), target)


def _detect(inspected: DataFrame, target: str) -> tuple[list[dict], int]:
    ready = C.normalize_money(inspected)
    texts = C.string_columns(inspected)
    nums = C.numeric_columns(ready)
    cols = inspected.columns
    issues: list[dict] = []

    def add(kind: str, found: list[str] | None = None, **fmt):
        sev, title, expl, impact, fix = K.QUALITY_TEXTS[kind]
        issues.append({"Severity": sev, "Issue": title, "Explanation": expl.format(**fmt),
                       "Business_Impact": impact, "Recommended_Solution": fix, "Columns": found or []})

    # one wide aggregate: rows, nulls, parse shares, min/max/count, pair moments
    itypes = {f.name: f.dataType for f in inspected.schema.fields}
    rtypes = {f.name: f.dataType for f in ready.schema.fields}
    ready_expr = {c: X.to_number(F.col(f"`{c}`"), itypes[c]) if c in K.MONEY_COLUMNS else F.col(f"`{c}`")
                  for c in cols}
    aggs = [F.count(F.lit(1)).alias("_rows")]
    for i, c in enumerate(cols):
        v = F.col(f"`{c}`")
        miss = v.isNull() | F.isnan(v) if rtypes[c].typeName() in ("double", "float") and c not in K.MONEY_COLUMNS \
            else v.isNull()
        aggs += [F.count_if(miss).alias(f"null{i}"), F.count(v).alias(f"n{i}"),
                 F.min(v).alias(f"lo{i}"), F.max(v).alias(f"hi{i}")]
        if c in texts:
            aggs.append(F.avg(F.when(X.parse_number(v).isNotNull(), 1.0).otherwise(0.0)).alias(f"ps{i}"))
    pairs = _pairs(nums) if len(nums) <= FEW_COLUMNS else []
    for k, (a, b) in enumerate(pairs):
        moments = pair_moments(*(X.nan_to_null(ready_expr[c].cast("double")) for c in (a, b)))
        aggs += [m.alias(f"{name}{k}") for name, m in zip(("c", "vx", "vy"), moments)]
    row = inspected.agg(*aggs).first()
    n_rows = row["_rows"]

    # the remaining passes are independent jobs over the input: run them side by side
    from churnforge.plans.concurrency import parallel_map
    idx = {c: i for i, c in enumerate(cols)}

    def outliers_job():
        many = C.more_distinct(ready, nums, K.OUTLIER_MIN_DISTINCT)
        return outlier_counts(ready, [c for c in nums if c in many])
    jobs = {
        "distinct_rows": lambda: C.distinct_rows(inspected),
        "dc_text": lambda: C.distinct_counts(inspected, texts),
        "outliers": outliers_job,
        "share": lambda: minority_share(inspected, target) if target in cols else None,
        "correlations": lambda: [] if pairs else pairwise_correlations(ready.select(*[F.col(f"`{c}`") for c in nums]), nums),
    }
    names = list(jobs)
    got = dict(zip(names, parallel_map(lambda k: jobs[k](), names)))

    missing = sum(row[f"null{i}"] for i in range(len(cols)))
    if missing:
        add("missing", [c for i, c in enumerate(cols) if row[f"null{i}"]], n=_fmt_int(missing))
    distinct_rows = got["distinct_rows"]
    if n_rows - distinct_rows:
        add("duplicates", n=_fmt_int(n_rows - distinct_rows))
    numeric_text = [c for c in texts if (row[f"ps{idx[c]}"] or 0.0) > K.NUMERIC_TEXT_SHARE]
    if numeric_text:
        add("numeric_text", numeric_text, cols=", ".join(numeric_text))
    const = [c for c in cols if row[f"n{idx[c]}"] == 0
             or (row[f"n{idx[c]}"] == n_rows and row[f"lo{idx[c]}"] == row[f"hi{idx[c]}"])]
    if const:
        add("constant", const, cols=", ".join(const[:6]))
    dc_text = got["dc_text"]
    limit = max(K.HIGH_CARDINALITY_MIN, n_rows * K.HIGH_CARDINALITY_SHARE)
    high = [c for c in texts if dc_text[c] > limit]
    if high:
        add("high_cardinality", high, cols=", ".join(high[:6]))
    related = list(got["correlations"])
    for k, (a, b) in enumerate(pairs):
        c, vx, vy = row[f"c{k}"], row[f"vx{k}"], row[f"vy{k}"]
        related.append((a, b, c / (vx * vy) ** 0.5 if c is not None and vx and vy and vx > 0 and vy > 0 else None))
    strong = [f"{a} / {b} ({_fmt2(abs(r))})" for a, b, r in related if r is not None and abs(r) >= K.CORRELATION_LIMIT]
    if strong:
        add("correlated", strong, pairs=", ".join(strong[:4]))
    counts = got["outliers"]
    if counts:
        add("outliers", [f"{k}: {_fmt_int(v)}" for k, v in counts.items()], detail=", ".join(f"{k}: {_fmt_int(v)}" for k, v in list(counts.items())[:5]))
    share = got["share"]
    if share is not None and share < K.IMBALANCE_SHARE:
        add("imbalance", share=_fmt_pct1(share))
    score = 100 - sum(K.SEVERITY_PENALTY.get(i["Severity"], 5) for i in issues)
    return issues, max(0, min(100, score))


def outlier_counts(df: DataFrame, candidates: list[str]) -> dict[str, int]:
    """Rows outside 1.5·iqr per candidate column (> 10 distinct values); non-zero only."""
    bounds = {}
    for c, (q1, q3) in C.quartiles(df, candidates).items():
        iqr = q3 - q1
        if iqr != 0 and iqr == iqr:
            bounds[c] = (q1 - 1.5 * iqr, q3 + 1.5 * iqr)
    bounds = {c: bounds[c] for c in candidates if c in bounds}
    if not bounds:
        return {}
    row = df.agg(*[F.count_if((F.col(f"`{c}`") < lo) | (F.col(f"`{c}`") > hi)).alias(c)
                   for c, (lo, hi) in bounds.items()]).first()
    return {c: int(row[c]) for c in bounds if row[c]}


def minority_share(df: DataFrame, target: str) -> float | None:
    """Minority class share when the (non-null) target has exactly two values."""
    counts = df.filter(F.col(target).isNotNull()).groupBy(target).agg(F.count(F.lit(1)).alias("n"))
    row = counts.agg(F.count(F.lit(1)).alias("k"), F.min("n").alias("lo"), F.sum("n").alias("total")).first()
    if row["k"] != 2:
        return None
    return row["lo"] / row["total"]


def quality_issues(df: DataFrame, target: str = "Churn") -> DataFrame:
    issues, _ = detect_quality(df, target)
    rows = [(i["Severity"], i["Issue"], i["Explanation"], i["Business_Impact"], i["Recommended_Solution"], i["Columns"])
            for i in issues]
    return df.sparkSession.createDataFrame(rows, ISSUE_SCHEMA)


def quality_score(df: DataFrame, target: str = "Churn") -> DataFrame:
    issues, score = detect_quality(df, target)
    return df.sparkSession.createDataFrame([(score, len(issues))], "Quality_Score int, Issues int")


def quality_score_of(df: DataFrame, target: str = "Churn") -> tuple[list[dict], int, bool]:
    issues, score = detect_quality(df, target)
    return issues, score, bool(issues)
