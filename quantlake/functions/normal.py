"""The normal distribution as expressions that Spark and DuckDB read alike: Hart's rational forms and Acklam's inverse."""

from __future__ import annotations

# Published coefficients, highest power first.
_TOP = (3.52624965998911e-2, 0.700383064443688, 6.37396220353165, 33.912866078383, 112.079291497871, 221.213596169931, 220.206867912376)
_BELOW = (8.83883476483184e-2, 1.75566716318264, 16.064177579207, 86.7807322029461, 296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752)
_A = (-3.969683028665376e1, 2.209460984245205e2, -2.759285104469687e2, 1.383577518672690e2, -3.066479806614716e1, 2.506628277459239)
_B = (-5.447609879822406e1, 1.615858368580409e2, -1.556989798598866e2, 6.680131188771972e1, -1.328068155288572e1, 1.0)
_C = (-7.784894002430293e-3, -3.223964580411365e-1, -2.400758277161838, -2.549732539343734, 4.374664141464968, 2.938163982698783)
_D = (7.784695709041462e-3, 3.224671290700398e-1, 2.445134137142996, 3.754408661907416, 1.0)
_TAIL = 0.02425


def number(x: float) -> str:
    """A double in both dialects."""
    return f"{x!r}" if "e" in repr(x) else f"{x!r}e0"


def polynomial(x: str, coefficients: tuple[float, ...]) -> str:
    out = number(coefficients[0])
    for c in coefficients[1:]:
        out = f"({out} * {x} + {number(c)})"
    return out


def cdf(x: str) -> str:
    """P(Z <= x) for a column or expression ``x`` within some 37 of 0, to 15 digits."""
    a = f"abs({x})"
    far = f"{a} + 0.65e0"
    for k in (4, 3, 2, 1):
        far = f"{a} + {k} / ({far})"
    upper = f"exp(-({x}) * ({x}) / 2) * CASE WHEN {a} < 7.07106781186547e0 THEN {polynomial(a, _TOP)} / {polynomial(a, _BELOW)} ELSE 1 / (({far}) * 2.506628274631e0) END"
    return f"CASE WHEN {x} > 0 THEN 1 - {upper} ELSE {upper} END"


def inverse(p: str) -> str:
    """The x with cdf(x) = p, to nine digits; null at or beyond 0 and 1."""
    tail = lambda q: f"{polynomial(q, _C)} / {polynomial(q, _D)}"
    low, high, mid = f"sqrt(-2 * ln({p}))", f"sqrt(-2 * ln(1 - {p}))", f"({p} - 0.5e0)"
    r = f"({mid} * {mid})"
    return f"CASE WHEN {p} <= 0 OR {p} >= 1 THEN NULL WHEN {p} < {_TAIL}e0 THEN {tail(low)} WHEN {p} > 1 - {_TAIL}e0 THEN -({tail(high)}) ELSE {polynomial(r, _A)} * {mid} / {polynomial(r, _B)} END"
