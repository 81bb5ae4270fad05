"""Scoring of new customers as a batch (or streaming) job.

The fitted artefacts — one-hot vocabulary, scaling row and model — are applied
with ``transform`` to any table of new customers; nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnforge.functions import constants as K
from churnforge.functions import exprs as X


def prepare_new_customers(df: DataFrame, currency: str = "USD", rate: float = K.USD_TO_SAR) -> DataFrame:
    """Fill missing inputs with the form defaults and bring money back to USD; a missing id stays null."""
    types = {f.name: f.dataType for f in df.schema.fields}
    cols = []
    for name in K.TELCO_COLUMNS:
        default = K.NEW_CUSTOMER_DEFAULTS[name]
        present = name in df.columns
        if name == "customerID":
            # no default here: one shared id for all rows without one would be a single hot key
            cols.append((X.blank_to_null(F.col(name).cast("string")) if present else F.lit(None).cast("string")).alias(name))
            continue
        if name in K.MONEY_COLUMNS:
            c = X.to_number(F.col(name), types[name]) if present else F.lit(None).cast("double")
            c = F.coalesce(c, F.lit(float(default)))
            if currency == "SAR":
                c = c / F.lit(rate)
        elif name in ("SeniorCitizen", "tenure"):
            c = F.coalesce(F.col(name).cast("int"), F.lit(default)) if present else F.lit(default)
        else:
            c = F.coalesce(X.blank_to_null(F.col(name).cast("string")), F.lit(default)) if present else F.lit(default)
        cols.append(c.alias(name))
    return df.select(*cols)


def risk_factors(df: DataFrame, currency: str = "USD", rate: float = K.USD_TO_SAR) -> DataFrame:
    """Up to five text reasons per customer; none → "Balanced customer profile"."""
    monthly = F.col("MonthlyCharges").cast("double")
    if currency == "SAR":
        monthly = monthly / F.lit(rate)
    checks = [
        F.col("Contract") == "Month-to-month",
        monthly >= K.HIGH_MONTHLY_USD,
        F.col("InternetService") == "Fiber optic",
        F.col("tenure") <= K.SHORT_TENURE_MONTHS,
        F.col("PaymentMethod") == "Electronic check",
    ]
    found = F.filter(F.array(*[F.when(c, F.lit(t)) for c, t in zip(checks, K.RISK_FACTORS)]),
                     lambda x: x.isNotNull())
    found = F.slice(found, 1, 5)
    return df.withColumn("Top_Factors", F.when(F.size(found) > 0, found)
                         .otherwise(F.array(F.lit(K.RISK_FACTOR_NONE))))


def verdict(df: DataFrame, prob_col: str = "Probability") -> DataFrame:
    """p ≥ .5 → churn verdict, tier, and the advice text."""
    p = F.col(prob_col)
    out = df.withColumn("Prediction", F.when(p >= 0.5, K.VERDICT_CHURN).otherwise(K.VERDICT_STAY))
    out = out.withColumn("Risk", X.risk_level(p))
    return out.withColumn("Recommendation", F.when(F.col("Risk").isin("High", "Critical"), K.ADVICE_HIGH)
                          .otherwise(K.ADVICE_LOW))
