"""The normal distribution as Column expressions; Spark has no erf."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Acklam's rational approximation of the inverse (abs. error about 3e-9).
CENTRE_TOP = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
CENTRE_BOTTOM = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01, 1.0)
TAIL_TOP = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
TAIL_BOTTOM = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00, 1.0)
TAIL = 0.02425
# Abramowitz and Stegun 26.2.17 (abs. error about 7e-8).
CDF_P, CDF_B, CDF_SCALE = 0.2316419, (0.319381530, -0.356563782, 1.781477937, -1.821255978, 1.330274429), 0.3989422804014327


def poly_sql(coefficients: tuple[float, ...], x: str) -> str:
    """Horner's scheme as SQL, highest power first."""
    out = f"CAST({coefficients[0]!r} AS DOUBLE)"
    for c in coefficients[1:]:
        out = f"({out} * {x} + CAST({c!r} AS DOUBLE))"
    return out


def ppf_sql(p: str) -> str:
    """Inverse of the standard normal distribution function, as SQL that Spark and DuckDB share; NULL outside (0, 1)."""
    q, low, high = f"(({p}) - 0.5)", f"sqrt(-2 * ln({p}))", f"sqrt(-2 * ln(1 - ({p})))"
    tail = lambda x: f"({poly_sql(TAIL_TOP, x)}) / ({poly_sql(TAIL_BOTTOM, x)})"
    return (
        f"CASE WHEN ({p}) <= 0 OR ({p}) >= 1 THEN NULL WHEN ({p}) < {TAIL} THEN {tail(low)} WHEN ({p}) > {1 - TAIL} THEN -({tail(high)}) "
        f"ELSE {q} * ({poly_sql(CENTRE_TOP, f'({q} * {q})')}) / ({poly_sql(CENTRE_BOTTOM, f'({q} * {q})')}) END"
    )


def cdf_sql(x: str) -> str:
    """The standard normal distribution function, as SQL that Spark and DuckDB share."""
    t = f"(1 / (1 + CAST({CDF_P} AS DOUBLE) * abs({x})))"
    upper = f"CAST({CDF_SCALE} AS DOUBLE) * exp(-({x}) * ({x}) / 2) * {t} * {poly_sql(CDF_B[::-1], t)}"
    return f"CASE WHEN ({x}) >= 0 THEN 1 - {upper} ELSE {upper} END"


def normal_ppf(p: str) -> Column:
    """Of a column named p."""
    return F.expr(ppf_sql(p))


def normal_cdf(x: str) -> Column:
    """Of a column named x."""
    return F.expr(cdf_sql(x))
