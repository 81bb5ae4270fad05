"""Column-expression builders shared by the operators.

All rules are native Catalyst expressions (no Python UDF), so they stay inside
whole-stage codegen.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType, StringType

from churnforge.functions import constants as K

BLANK_PATTERN = r"^\s*$"
# Text that a pandas-style numeric parse accepts: optional sign, digits with an
# optional fraction and exponent, or inf/infinity; surrounding spaces allowed.
# Spark's own cast also takes suffixes like '1d' and '1f', hence the guard.
NUMBER_PATTERN = r"^\s*[+-]?((\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|(?i:inf|infinity))\s*$"


def col_(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def is_blank(c) -> Column:
    return col_(c).rlike(BLANK_PATTERN)


def blank_to_null(c) -> Column:
    c = col_(c)
    return F.when(c.rlike(BLANK_PATTERN), F.lit(None).cast("string")).otherwise(c)


def parse_number(c) -> Column:
    """Text → double like a coercing numeric parse; anything else → null."""
    c = col_(c).cast("string")
    return F.when(c.rlike(NUMBER_PATTERN), F.trim(c).try_cast("double"))


def to_number(c, dtype) -> Column:
    """Numeric columns pass through as double, text goes through ``parse_number``."""
    if isinstance(dtype, NumericType):
        return nan_to_null(col_(c).cast("double"))
    return parse_number(c)


def nan_to_null(c) -> Column:
    c = col_(c)
    return F.when(F.isnan(c), F.lit(None).cast("double")).otherwise(c)


def risk_level(p) -> Column:
    """Probability → tier; null/NaN fall to Low."""
    p = nan_to_null(col_(p))
    expr = None
    for cut, label in K.RISK_CUTS:
        expr = F.when(p >= cut, label) if expr is None else expr.when(p >= cut, label)
    return expr.otherwise(K.RISK_ORDER[0])


def risk_order(tier) -> Column:
    expr = None
    for i, label in enumerate(K.RISK_ORDER):
        expr = F.when(col_(tier) == label, i) if expr is None else expr.when(col_(tier) == label, i)
    return expr


def retention_offer(tier, monthly, threshold: float = K.OFFER_CRITICAL_MIN_MONTHLY) -> Column:
    tier, monthly = col_(tier), col_(monthly)
    return (F.when((tier == "Critical") & (monthly >= threshold), K.OFFER_CRITICAL)
            .when(tier == "High", K.OFFER_HIGH)
            .when(tier == "Medium", K.OFFER_MEDIUM)
            .otherwise(K.OFFER_NONE))


def map_target(c, dtype) -> Column:
    """Yes/yes/Y → 1, No/no/N → 0, other → 0; numeric passes as int."""
    c = col_(c)
    if isinstance(dtype, NumericType):
        return F.coalesce(nan_to_null(c.cast("double")).cast("int"), F.lit(0))
    expr = None
    for text, value in K.TARGET_MAP.items():
        expr = F.when(c == text, value) if expr is None else expr.when(c == text, value)
    return expr.otherwise(0).cast("int")


def map_values(c, mapping: dict, default=0) -> Column:
    c = col_(c)
    expr = None
    for text, value in mapping.items():
        expr = F.when(c == text, value) if expr is None else expr.when(c == text, value)
    return expr.otherwise(default)


def convert_currency(c, currency: str = "USD", rate: float = K.USD_TO_SAR) -> Column:
    return col_(c) * F.lit(rate) if currency == "SAR" else col_(c)


def currency_symbol(currency: str) -> str:
    return K.CURRENCY_SYMBOLS["SAR"] if currency == "SAR" else K.CURRENCY_SYMBOLS["USD"]


def round_half_up(c, decimals: int = 0) -> Column:
    """floor(x·10^d + ½)/10^d: the same IEEE steps on every engine, so texts agree."""
    scale = 10 ** decimals
    return F.floor(col_(c) * scale + 0.5) / scale if decimals else F.floor(col_(c) + 0.5)


def format_money(c, currency: str = "USD", rate: float = K.USD_TO_SAR, decimals: int = 0) -> Column:
    """"$ 1,234" style text."""
    return F.concat(F.lit(currency_symbol(currency) + " "),
                    F.format_number(round_half_up(convert_currency(c, currency, rate), decimals), decimals))


def format_fixed(c, decimals: int = 1) -> Column:
    return F.format_string(f"%.{decimals}f", round_half_up(c, decimals))


def format_percent(c, decimals: int = 1) -> Column:
    """0.1234 → "12.3%"."""
    return F.concat(format_fixed(col_(c) * 100, decimals), F.lit("%"))


def dec_money(c) -> Column:
    """Money as DECIMAL(18,2) so sums do not depend on row order."""
    return col_(c).cast("decimal(18,2)")


def is_string(dtype) -> bool:
    return isinstance(dtype, StringType)


def is_numeric(dtype) -> bool:
    return isinstance(dtype, NumericType)
