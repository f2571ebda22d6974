"""Density, distribution function and quantiles of the normal distribution as column expressions, and the same as SQL text."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

# W. J. Cody's rational approximations of erf (|x| <= 0.46875) and of erfc (to 4, and beyond), published 1969.
_ERF_P = (3.209377589138469472562e03, 3.774852376853020208137e02, 1.138641541510501556495e02, 3.161123743870565596947e00, 1.857777061846031526730e-01)
_ERF_Q = (2.844236833439170622273e03, 1.282616526077372275645e03, 2.440246379344441733056e02, 2.360129095234412093499e01, 1.0)
_MID_P = (
    1.23033935479799725272e03, 2.05107837782607146532e03, 1.71204761263407058314e03, 8.81952221241769090411e02, 2.98635138197400131132e02,
    6.61191906371416294775e01, 8.88314979438837594118e00, 5.64188496988670089180e-01, 2.15311535474403846343e-08,
)
_MID_Q = (
    1.23033935480374942043e03, 3.43936767414372163696e03, 4.36261909014324715820e03, 3.29079923573345962678e03, 1.62138957456669018874e03,
    5.37181101862009857509e02, 1.17693950891312499305e02, 1.57449261107098347253e01, 1.0,
)
_FAR_P = (-6.58749161529837803157e-04, -1.60837851487422766278e-02, -1.25781726111229246204e-01, -3.60344899949804439429e-01, -3.05326634961232344035e-01, -1.63153871373020978498e-02)
_FAR_Q = (2.33520497626869185443e-03, 6.05183413124413191178e-02, 5.27905102951428412248e-01, 1.87295284992346047209e00, 2.56852019228982242072e00, 1.0)
# P. J. Acklam's rational approximation of the quantiles, inside and in the tails, and where the tails begin.
_IN_P = (2.506628277459239e00, -3.066479806614716e01, 1.383577518672690e02, -2.759285104469687e02, 2.209460984245205e02, -3.969683028665376e01)
_IN_Q = (1.0, -1.328068155288572e01, 6.680131188771972e01, -1.556989798598866e02, 1.615858368580409e02, -5.447609879822406e01)
_OUT_P = (2.938163982698783e00, 4.374664141464968e00, -2.549732539343734e00, -2.400758277161838e00, -3.223964580411365e-01, -7.784894002430293e-03)
_OUT_Q = (1.0, 3.754408661907416e00, 2.445134137142996e00, 3.224671290700398e-01, 7.784695709041462e-03)
_TAIL = 0.02425


def _let(value: Column, use) -> Column:
    """use(value), with the value worked out once however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _polynomial(x: Column, low_first: tuple[float, ...]) -> Column:
    out = F.lit(low_first[-1])
    for c in low_first[-2::-1]:
        out = out * x + F.lit(c)
    return out


def _ratio(x: Column, p, q) -> Column:
    return _polynomial(x, p) / _polynomial(x, q)


def density(x: Column, mean: Column | float = 0.0, sd: Column | float = 1.0) -> Column:
    sd = sd if isinstance(sd, Column) else F.lit(sd)
    z = (x - mean) / sd
    return F.exp(-z * z / 2) / (sd * math.sqrt(2 * math.pi))


def _erfc(x: Column) -> Column:
    """erfc of x >= 0."""
    near = 1 - x * _ratio(x * x, _ERF_P, _ERF_Q)
    middle = F.exp(-x * x) * _ratio(x, _MID_P, _MID_Q)
    s = 1 / (x * x)
    far = F.exp(-x * x) / x * (1 / math.sqrt(math.pi) + s * _ratio(s, _FAR_P, _FAR_Q))
    return F.when(x <= 0.46875, near).when(x <= 4, middle).when(x > 26.5, 0.0).otherwise(far)


def erf(x: Column) -> Column:
    a = F.abs(x)
    return F.when(a <= 0.46875, x * _ratio(x * x, _ERF_P, _ERF_Q)).otherwise(F.signum(x) * (1 - _erfc(a)))


def cdf(x: Column) -> Column:
    """Share of the standard normal distribution at or below x."""
    half = _let(F.abs(x) / math.sqrt(2), lambda a: _erfc(a) / 2)
    return F.when(x < 0, half).otherwise(1 - half)


def quantile(p: Column) -> Column:
    """x of which cdf(x) = p, for p between 0 and 1; missing elsewhere. The approximation is good to 1e-9 of its size; one step
    of Halley's method makes it as good as `cdf` is."""

    def rough(p: Column) -> Column:
        inside = _let(p - 0.5, lambda q: q * _ratio(q * q, _IN_P, _IN_Q))
        r = F.least(p, 1 - p)
        outside = _let(F.sqrt(-2 * F.ln(r)), lambda t: _ratio(t, _OUT_P, _OUT_Q))
        return F.when(r > _TAIL, inside).otherwise(F.signum(0.5 - p) * outside)

    def step(x: Column, p: Column) -> Column:
        off = (cdf(x) - p) * math.sqrt(2 * math.pi) * F.exp(x * x / 2)
        return _let(off, lambda u: x - u / (1 + x * u / 2))

    return _let(F.when((p > 0) & (p < 1), p), lambda p: _let(rough(p), lambda x: step(x, p)))


def _polynomial_sql(x: str, c: tuple[float, ...]) -> str:
    return "(" + " + ".join(f"({v!r}) * pow({x}, {i})" for i, v in enumerate(c)) + ")"


def _ratio_sql(x: str, p, q) -> str:
    return f"{_polynomial_sql(x, p)} / {_polynomial_sql(x, q)}"


def cdf_sql(x: str) -> str:
    a, s = f"(abs({x}) / sqrt(2))", f"(2 / ({x} * {x}))"
    near, middle = f"1 - {a} * {_ratio_sql(f'({a} * {a})', _ERF_P, _ERF_Q)}", f"exp(-{a} * {a}) * {_ratio_sql(a, _MID_P, _MID_Q)}"
    far = f"exp(-{a} * {a}) / {a} * (1 / sqrt(pi()) + {s} * {_ratio_sql(s, _FAR_P, _FAR_Q)})"
    half = f"((CASE WHEN {a} <= 0.46875 THEN {near} WHEN {a} <= 4 THEN {middle} ELSE {far} END) / 2)"
    return f"CASE WHEN {x} < 0 THEN {half} ELSE 1 - {half} END"


def quantile_sql(source: str, p: str, out: str) -> str:
    """Common table expressions over `source`, of which the last, q3, has its columns and the quantile of column p as `out`."""
    r, q = f"least({p}, 1 - {p})", f"({p} - 0.5)"
    tail = f"sqrt(-2 * ln({r}))"
    rough = f"CASE WHEN {r} > {_TAIL} THEN {q} * {_ratio_sql(f'({q} * {q})', _IN_P, _IN_Q)} ELSE sign(-{q}) * {_ratio_sql(tail, _OUT_P, _OUT_Q)} END"
    return f"""q1 AS (SELECT *, {rough} AS _x FROM {source}), q2 AS (SELECT *, (({cdf_sql("_x")}) - {p}) * sqrt(2 * pi()) * exp(_x * _x / 2) AS _off FROM q1),
q3 AS (SELECT *, _x - _off / (1 + _x * _off / 2) AS {out} FROM q2)"""
