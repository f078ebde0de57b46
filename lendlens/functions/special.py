"""Special functions for p-values and normal scores, all column expressions.

* ``erfc``, ``norm_cdf``, ``norm_ppf``: short rational forms for values needed
  per data row (K-S against the normal, normal scores);
* tails of the normal, chi-square, F(1, n) and Kolmogorov laws, needed once
  per summary row: series, finite sums and asymptotic expansions with a fixed
  number of terms.  None of them has an iteration that can stop early
  unconverged, and upper tails are computed as tails, so they keep their
  relative accuracy where ``1 - cdf`` would cancel to zero.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# --------------------------------------------------------------------------
# Column expressions
# --------------------------------------------------------------------------

# Chebyshev fit of erfc (fractional error < 1.2e-7 everywhere).
_ERFC_COEF = [-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806,
              0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277]

# Rational approximation of the normal quantile
# (relative error < 1.15e-9), central region bound 0.02425.
_PPF_A = [-3.969683028665376e+01, 2.209460984245205e+02, -2.759285104469687e+02,
          1.383577518672690e+02, -3.066479806614716e+01, 2.506628277459239e+00]
_PPF_B = [-5.447609879822406e+01, 1.615858368580409e+02, -1.556989798598866e+02,
          6.680131188771972e+01, -1.328068155288572e+01]
_PPF_C = [-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e+00,
          -2.549732539343734e+00, 4.374664141464968e+00, 2.938163982698783e+00]
_PPF_D = [7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e+00,
          3.754408661907416e+00]
_PPF_LOW = 0.02425


def _horner(x: Column, coefs) -> Column:
    acc = F.lit(coefs[-1])
    for c in reversed(coefs[:-1]):
        acc = acc * x + F.lit(c)
    return acc


def erfc(x: Column) -> Column:
    z = F.abs(x)
    t = F.lit(1.0) / (F.lit(1.0) + F.lit(0.5) * z)
    poly = _horner(t, _ERFC_COEF)
    ans = t * F.exp(-z * z + poly)
    return F.when(x >= 0, ans).otherwise(F.lit(2.0) - ans)


def norm_cdf(z: Column) -> Column:
    """Standard normal CDF as a JVM expression."""
    return F.lit(0.5) * erfc(-z / F.lit(math.sqrt(2.0)))


def norm_ppf(p: Column) -> Column:
    """Standard normal quantile for 0 < p < 1 (relative error below 1.2e-9)."""
    q = p - F.lit(0.5)
    r = q * q
    central = (_horner(r, list(reversed(_PPF_A))) * q) / (_horner(r, list(reversed(_PPF_B))) * r + F.lit(1.0))
    ql = F.sqrt(F.lit(-2.0) * F.log(p))
    lower = _horner(ql, list(reversed(_PPF_C))) / (_horner(ql, list(reversed(_PPF_D))) * ql + F.lit(1.0))
    qu = F.sqrt(F.lit(-2.0) * F.log(F.lit(1.0) - p))
    upper = -_horner(qu, list(reversed(_PPF_C))) / (_horner(qu, list(reversed(_PPF_D))) * qu + F.lit(1.0))
    return (F.when(p < _PPF_LOW, lower)
            .when(p > 1 - _PPF_LOW, upper)
            .otherwise(central))


def _let(value: Column, body) -> Column:
    """Evaluate ``value`` once and pass it to ``body`` (a lambda over a
    one-element array), so a large sub-expression is not copied into every
    place it is used."""
    return F.element_at(F.transform(F.array(value), body), 1)


# --------------------------------------------------------------------------
# Tails (summary rows)
# --------------------------------------------------------------------------

_TERMS = 60
_FINITE_DOF = 200  # chi-square and t: finite sums up to here, expansions beyond


def _fold(terms: int, start: Column, step, finish=None) -> Column:
    return F.aggregate(F.sequence(F.lit(1), F.lit(terms)), start, step, finish)


def _pair(term: Column, total: Column) -> Column:
    return F.struct(term.alias("term"), total.alias("total"))


def upper_erfc(x: Column) -> Column:
    """erfc to about 1e-13: the power series of erf up to 2.5, the continued
    fraction beyond (relative accuracy kept far into the tail)."""
    def series(z: Column) -> Column:
        total = _fold(_TERMS, _pair(z, z), lambda acc, k: F.struct(
            (-acc["term"] * z * z / k).alias("term"),
            (acc["total"] - acc["term"] * z * z / k / (2 * k + 1)).alias("total")), lambda acc: acc["total"])
        return 1 - total * F.lit(2 / math.sqrt(math.pi))

    def fraction(z: Column) -> Column:
        below = _fold(_TERMS, z, lambda acc, k: z + (F.lit(_TERMS + 1) - k) / F.lit(2.0) / acc)
        return F.exp(-z * z) / (below * F.lit(math.sqrt(math.pi)))

    at = _let(F.abs(x.cast("double")), lambda z: F.when(z < 2.5, series(z)).otherwise(fraction(z)))
    return F.when(x >= 0, at).otherwise(2.0 - at)


def norm_sf(z: Column) -> Column:
    return F.lit(0.5) * upper_erfc(z / F.lit(math.sqrt(2.0)))


def norm_two_sided(z: Column) -> Column:
    """P(|Z| > z), at most 1 (also for a continuity-corrected z below 0)."""
    return F.least(F.lit(1.0), upper_erfc(z / F.lit(math.sqrt(2.0))))


def _chi2_finite(h: Column, dof: Column) -> Column:
    """Q(dof / 2, h) as the finite sum for whole dof (Abramowitz and Stegun 26.4.4-5)."""
    odd = dof % 2 == 1
    half = F.when(odd, 0.5).otherwise(0.0)
    many = F.floor(dof / 2)
    start = F.exp(-h) * F.when(odd, 2 * F.sqrt(h / F.lit(math.pi))).otherwise(1.0)
    total = _fold(_FINITE_DOF // 2, _pair(start, F.lit(0.0)), lambda acc, j: F.struct(
        (acc["term"] * h / (j + half)).alias("term"),
        (acc["total"] + F.when(j <= many, acc["term"]).otherwise(0.0)).alias("total")), lambda acc: acc["total"])
    return total + F.when(odd, upper_erfc(F.sqrt(h))).otherwise(0.0)


# First coefficients of Temme's uniform expansion around x = a.
_C0 = [-1 / 3, 1 / 12, -2 / 135, 1 / 864, 1 / 2835]
_C1 = [-1 / 540, -1 / 288, 25 / 12096, -223 / 1088640, -89 / 1088640]


def _chi2_large(h: Column, dof: Column) -> Column:
    """Q(dof / 2, h) by Temme's uniform expansion, good to 1e-8 beyond 200 dof."""
    a = dof / 2

    def tail(mu: Column, eta: Column) -> Column:
        near = F.abs(eta) < 0.1
        c0 = F.when(near, _horner(eta, _C0)).otherwise(F.try_divide(F.lit(1.0), mu) - F.try_divide(F.lit(1.0), eta))
        c1 = F.when(near, _horner(eta, _C1)).otherwise(
            F.try_divide(F.lit(1.0), F.pow(eta, 3)) - F.try_divide(F.lit(1.0), F.pow(mu, 3))
            - F.try_divide(F.lit(1.0), mu * mu) - F.try_divide(F.lit(1.0), 12 * mu))
        rest = F.exp(-a * eta * eta / 2) / F.sqrt(2 * math.pi * a) * (c0 + c1 / a)
        return F.lit(0.5) * upper_erfc(eta * F.sqrt(a / 2)) + rest

    def with_eta(mu: Column) -> Column:
        small = mu * mu * (1 - 2 * mu / 3 + mu * mu / 2 - 2 * F.pow(mu, 3) / 5 + F.pow(mu, 4) / 3)
        square = F.when(F.abs(mu) < 0.003, small).otherwise(2 * (mu - F.log1p(mu)))
        return _let(F.signum(mu) * F.sqrt(F.greatest(square, F.lit(0.0))), lambda eta: tail(mu, eta))

    return _let(h / a - 1, with_eta)


def chi2_sf(x: Column, dof: Column) -> Column:
    """Upper tail of the chi-square law; NULL without degrees of freedom."""
    h, d = x.cast("double") / 2, dof.cast("double")
    return (F.when((d < 1) | x.isNull() | d.isNull(), F.lit(None).cast("double"))
            .when(x <= 0, 1.0)
            .when(d <= _FINITE_DOF, _chi2_finite(h, d))
            .otherwise(_chi2_large(h, d)))


def chi2_critical(upper: float, dof: Column) -> Column:
    """The value with upper tail ``upper``, by 60 halvings of an interval."""
    d = dof.cast("double")
    span = F.struct(F.lit(0.0).alias("low"), (d + 20 * F.sqrt(2 * d) + 40).alias("high"))

    def halve(acc: Column, _: Column) -> Column:
        return _let((acc["low"] + acc["high"]) / 2, lambda mid: _let(chi2_sf(mid, d) > upper, lambda above: F.struct(
            F.when(above, mid).otherwise(acc["low"]).alias("low"),
            F.when(above, acc["high"]).otherwise(mid).alias("high"))))

    return F.when(d >= 1, _fold(60, span, halve, lambda acc: (acc["low"] + acc["high"]) / 2))


def _t_finite(t: Column, n: Column) -> Column:
    """P(|T| > t) for whole n as a finite sum (Abramowitz and Stegun 26.7.3-4)."""
    odd = n % 2 == 1
    theta = F.atan(t / F.sqrt(n))
    c = n / (n + t * t)
    many = F.when(odd, (n - 1) / 2).otherwise(n / 2)
    step = lambda acc, i: F.struct(
        (acc["term"] * c * F.when(odd, 2 * i / (2 * i + 1)).otherwise((2 * i - 1) / (2 * i))).alias("term"),
        (acc["total"] + F.when(i <= many, acc["term"]).otherwise(0.0)).alias("total"))
    total = _fold(_FINITE_DOF // 2, _pair(F.lit(1.0), F.lit(0.0)), step, lambda acc: acc["total"])
    inside = F.when(odd, F.lit(2 / math.pi) * (theta + F.sin(theta) * F.cos(theta) * total)).otherwise(F.sin(theta) * total)
    return F.greatest(F.lit(0.0), 1 - inside)


def _t_large(t: Column, n: Column) -> Column:
    """P(|T| > t) through Hill's normalising transformation (Algorithm 395)."""
    a = n - 0.5
    b = 48 * a * a
    return _let(a * F.log1p(t * t / n), lambda y: upper_erfc(
        (((((-0.4 * y - 3.3) * y - 24) * y - 85.5) / (0.8 * y * y + 100 + b) + y + 3) / b + 1) * F.sqrt(y / 2)))


def f_sf(f: Column, n: Column) -> Column:
    """Upper tail of the F(1, n) law: P(|T_n| > sqrt(f))."""
    d, t = n.cast("double"), F.sqrt(f.cast("double"))
    return (F.when(f.isNull() | (d < 1) | d.isNull(), F.lit(None).cast("double"))
            .when(d <= _FINITE_DOF, _t_finite(t, d)).otherwise(_t_large(t, d)))


def kolmogorov_sf(d: Column, n: Column) -> Column:
    """Asymptotic tail of the one-sample K-S distance, with the usual
    small-sample correction of the argument."""
    root = F.sqrt(n.cast("double"))
    lam = (root + 0.12 + F.try_divide(F.lit(0.11), root)) * d
    total = _let(lam, lambda x: F.when(x < 0.2, 1.0).otherwise(_fold(
        100, F.lit(0.0), lambda acc, k: acc + F.when(k % 2 == 1, 2.0).otherwise(-2.0) * F.exp(-2.0 * k * k * x * x))))
    return F.when(d.isNotNull() & (n > 0), F.least(F.lit(1.0), F.greatest(F.lit(0.0), total)))
