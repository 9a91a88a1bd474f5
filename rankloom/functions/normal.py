"""Normal distribution and its inverse as column expressions, and the same formulas as DuckDB SQL for the checks.

The distribution is Hart's rational approximation with a continued fraction in the tail (absolute error about 1e-15), the
inverse is Acklam's with one step of Halley's rule (about 1e-14). NULL gives NULL.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Hart's coefficients, highest power first.
HART_NUMERATOR = (0.0352624965998911, 0.700383064443688, 6.37396220353165, 33.912866078383, 112.079291497871, 221.213596169931, 220.206867912376)
HART_DENOMINATOR = (0.0883883476483184, 1.75566716318264, 16.064177579207, 86.7807322029461, 296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752)
HART_LIMIT, FAR, ROOT_TWO_PI = 7.07106781186547, 37.0, 2.506628274631
# Acklam's coefficients, highest power first, and the end of the lower tail.
CENTRE_NUMERATOR = (-39.69683028665376, 220.9460984245205, -275.9285104469687, 138.357751867269, -30.66479806614716, 2.506628277459239)
CENTRE_DENOMINATOR = (-54.47609879822406, 161.5858368580409, -155.6989798598866, 66.80131188771972, -13.28068155288572, 1.0)
TAIL_NUMERATOR = (-0.007784894002430293, -0.3223964580411365, -2.400758277161838, -2.549732539343734, 4.374664141464968, 2.938163982698783)
TAIL_DENOMINATOR = (0.007784695709041462, 0.3224671290700398, 2.445134137142996, 3.754408661907416, 1.0)
TAIL = 0.02425


def _polynomial(coefficients: Sequence[float], x: Column) -> Column:
    out = F.lit(coefficients[0])
    for c in coefficients[1:]:
        out = out * x + c
    return out


def _bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def _above(z: Column) -> Column:
    """The probability above z, which is not negative."""
    bell, deep = F.exp(-z * z / 2), z + 0.65
    for k in (4, 3, 2, 1):
        deep = z + k / deep
    near = bell * _polynomial(HART_NUMERATOR, z) / _polynomial(HART_DENOMINATOR, z)
    return F.when(z > FAR, 0.0).when(z < HART_LIMIT, near).otherwise(bell / (ROOT_TWO_PI * deep))


def norm_cdf(x: Column) -> Column:
    return _bind(x.cast("double"), lambda v: _bind(_above(F.abs(v)), lambda tail: F.when(v > 0, 1 - tail).otherwise(tail)))


def norm_ppf(p: Column) -> Column:
    """NULL outside of (0, 1)."""

    def lower(h: Column) -> Column:
        q, t = h - 0.5, F.sqrt(-2 * F.ln(h))
        tail = _polynomial(TAIL_NUMERATOR, t) / _polynomial(TAIL_DENOMINATOR, t)
        first = F.when(h < TAIL, tail).otherwise(_polynomial(CENTRE_NUMERATOR, q * q) * q / _polynomial(CENTRE_DENOMINATOR, q * q))
        slip = lambda x: (_above(-x) - h) * ROOT_TWO_PI * F.exp(x * x / 2)
        return _bind(first, lambda x: _bind(slip(x), lambda u: x - u / (1 + x * u / 2)))

    inside = lambda v: F.when((v > 0) & (v < 1), _bind(lower(F.least(v, 1 - v)), lambda x: F.when(v <= 0.5, x).otherwise(-x)))
    return _bind(p.cast("double"), inside)


def _polynomial_sql(coefficients: Sequence[float], x: str) -> str:
    out = f"{coefficients[0]!r}::DOUBLE"
    for c in coefficients[1:]:
        out = f"({out} * {x} + ({c!r}::DOUBLE))"
    return out


def _bind_sql(value: str, name: str, body: str) -> str:
    return f"list_transform([{value}], lambda {name}: {body})[1]"


def _above_sql(z: str) -> str:
    deep = f"({z} + 0.65)"
    for k in (4, 3, 2, 1):
        deep = f"({z} + {k} / {deep})"
    bell = f"exp(-{z} * {z} / 2)"
    near = f"{bell} * {_polynomial_sql(HART_NUMERATOR, z)} / {_polynomial_sql(HART_DENOMINATOR, z)}"
    return f"(CASE WHEN {z} > {FAR} THEN 0 WHEN {z} < {HART_LIMIT} THEN {near} ELSE {bell} / ({ROOT_TWO_PI} * {deep}) END)"


def cdf_sql(x: str) -> str:
    """DuckDB SQL for ``norm_cdf`` of a column or an expression in brackets."""
    tail = _above_sql(f"abs({x})")
    return f"(CASE WHEN {x} > 0 THEN 1 - {tail} ELSE {tail} END)"


def ppf_sql(p: str) -> str:
    """DuckDB SQL for ``norm_ppf`` of a column."""
    h = f"least({p}, 1 - {p})"
    q, t = f"({h} - 0.5)", f"sqrt(-2 * ln({h}))"
    tail = f"{_polynomial_sql(TAIL_NUMERATOR, t)} / {_polynomial_sql(TAIL_DENOMINATOR, t)}"
    centre = f"{_polynomial_sql(CENTRE_NUMERATOR, f'({q} * {q})')} * {q} / {_polynomial_sql(CENTRE_DENOMINATOR, f'({q} * {q})')}"
    first = f"(CASE WHEN {h} < {TAIL} THEN {tail} ELSE {centre} END)"
    slip = f"({_above_sql('(-x)')} - {h}) * {ROOT_TWO_PI} * exp(x * x / 2)"
    lower = _bind_sql(first, "x", _bind_sql(slip, "u", "x - u / (1 + x * u / 2)"))
    return f"(CASE WHEN {p} > 0 AND {p} < 1 THEN CASE WHEN {p} <= 0.5 THEN {lower} ELSE -{lower} END END)"
