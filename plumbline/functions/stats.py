"""Distribution functions as column expressions, so tests run on aggregated rows without Python."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# above this many degrees of freedom the finite t series gives way to a normal transform
SERIES_LIMIT = 1000


def normal_two_sided_p(z: Column) -> Column:
    """P(|Z| >= |z|): a positive series near the centre, a continued fraction in the tails."""
    a = F.abs(z.cast("double"))
    density = F.exp(-a * a / 2) / F.lit(math.sqrt(2 * math.pi))
    series = F.aggregate(
        F.sequence(F.lit(1), F.lit(160)),
        F.struct(a.alias("term"), a.alias("total")),
        lambda s, n: F.struct(
            (s["term"] * a * a / (2 * n + 1)).alias("term"),
            (s["total"] + s["term"] * a * a / (2 * n + 1)).alias("total"),
        ),
        lambda s: s["total"],
    )
    fraction = F.aggregate(
        F.sequence(F.lit(80), F.lit(1), F.lit(-1)), a, lambda acc, n: a + n.cast("double") / acc
    )
    return F.when(a < 6, F.greatest(F.lit(0.0), 1 - 2 * density * series)).otherwise(
        2 * density / fraction
    )


def _t_area(cos2: Column, sin: Column, theta: Column, nu: Column) -> Column:
    """P(|T| < t) for integer nu from the angle atan(t / sqrt(nu)); finite series (A&S 26.7.3-4)."""
    even = nu % 2 == 0
    steps = F.when(even, (nu - 2) / 2).otherwise((nu - 3) / 2).cast("int")
    start = F.when(even, F.lit(1.0)).otherwise(F.sqrt(cos2))

    def grow(s: Column, j: Column) -> Column:
        ratio = F.when(even, (2 * j - 1) / (2 * j)).otherwise((2 * j) / (2 * j + 1))
        term = F.when(j == 0, s["term"]).otherwise(s["term"] * cos2 * ratio)
        return F.struct(
            term.alias("term"),
            F.when(j == 0, s["total"]).otherwise(s["total"] + term).alias("total"),
        )

    total = F.aggregate(
        F.sequence(F.lit(0), F.greatest(steps, F.lit(0))),
        F.struct(start.alias("term"), start.alias("total")),
        grow,
        lambda s: s["total"],
    )
    return (
        F.when(nu == 1, 2 * theta / F.lit(math.pi))
        .when(even, sin * total)
        .otherwise(F.lit(2 / math.pi) * (theta + sin * total))
    )


def t_two_sided_p(t: Column, nu: Column) -> Column:
    """P(|T_nu| >= |t|); null for a null statistic or nu < 1."""
    a, n = F.abs(t.cast("double")), nu.cast("int")
    cos2 = n / (n + a * a)
    exact = 1 - _t_area(cos2, a / F.sqrt(n + a * a), F.atan(a / F.sqrt(n)), n)
    # Hill's normal transform for large nu
    b = 48 * (n - 0.5) * (n - 0.5)
    y = (n - 0.5) * F.log1p(a * a / n)
    z = (
        ((((-0.4 * y - 3.3) * y - 24.0) * y - 85.5) / (0.8 * y * y + 100.0 + b) + y + 3.0) / b + 1.0
    ) * F.sqrt(y)
    return F.when(n >= 1, F.when(n <= SERIES_LIMIT, F.greatest(F.lit(0.0), exact)).otherwise(
        normal_two_sided_p(z)
    ))


def t_critical(ci: float, nu: Column) -> Column:
    """Two-sided critical value: P(|T_nu| < t) = ci, by bisection; null for nu < 1."""
    n = nu.cast("int")

    def halve(s: Column, _: Column, inside) -> Column:
        mid = (s["lo"] + s["hi"]) / 2
        below = inside(mid) < ci
        return F.struct(
            F.when(below, mid).otherwise(s["lo"]).alias("lo"),
            F.when(below, s["hi"]).otherwise(mid).alias("hi"),
        )

    def search(hi: float, inside) -> Column:
        return F.aggregate(
            F.sequence(F.lit(1), F.lit(60)),
            F.struct(F.lit(0.0).alias("lo"), F.lit(hi).alias("hi")),
            lambda s, i: halve(s, i, inside),
            lambda s: (s["lo"] + s["hi"]) / 2,
        )

    angle = search(
        math.pi / 2,
        lambda th: _t_area(F.cos(th) * F.cos(th), F.sin(th), th, n),
    )
    tail = search(60.0, lambda v: 1 - t_two_sided_p(v, n))
    return F.when(n >= 1, F.when(n <= SERIES_LIMIT, F.sqrt(n) * F.tan(angle)).otherwise(tail))


# below this many pairs the signed-rank null distribution is counted exactly
EXACT_PAIRS = 50


def signed_rank_p(n: Column, w_plus: Column, tie_term: Column, zeros: Column) -> Column:
    """Two-sided signed-rank p from n non-zero differences.

    Exact without ties and zeros up to 50 pairs, else the normal approximation with tie
    correction. ``tie_term`` is the sum of c**3 - c over groups of equal magnitude.
    """
    n = n.cast("int")
    total = n * (n + 1) / 2
    smaller = F.least(w_plus, total - w_plus)
    top = F.least(n, F.lit(EXACT_PAIRS))
    sums = (top * (top + 1) / 2).cast("int")
    ways = F.aggregate(
        F.sequence(F.lit(1), F.greatest(top, F.lit(1))),
        F.transform(F.sequence(F.lit(0), sums), lambda s: F.when(s == 0, 1.0).otherwise(0.0)),
        lambda acc, i: F.transform(
            acc, lambda w, s: w + F.when(s >= i, F.get(acc, s - i)).otherwise(0.0)
        ),
    )
    tail = F.aggregate(
        F.slice(ways, 1, F.greatest(smaller, F.lit(0)).cast("int") + 1),
        F.lit(0.0),
        lambda a, w: a + w,
    )
    exact = F.least(F.lit(1.0), 2 * tail / F.pow(F.lit(2.0), top))
    variance = n * (n + 1.0) * (2.0 * n + 1.0) / 24 - tie_term / 48
    approx = normal_two_sided_p((smaller - n * (n + 1.0) / 4) / F.sqrt(variance))
    plain = (n <= EXACT_PAIRS) & (tie_term == 0) & (zeros == 0)
    return F.when(n >= 1, F.when(plain, exact).otherwise(approx))


# Acklam's rational approximation of the normal quantile.
_QA = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02,
       1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
_QB = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02,
       6.680131188771972e01, -1.328068155288572e01)
_QC = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00,
       -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
_QD = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00)


def _poly(coefs, x: Column) -> Column:
    acc = F.lit(coefs[0])
    for c in coefs[1:]:
        acc = acc * x + c
    return acc


def normal_quantile(p: Column, clip: float = 1e-7) -> Column:
    """Inverse normal CDF with p clipped to [clip, 1 - clip]."""
    p = F.greatest(F.lit(clip), F.least(F.lit(1 - clip), p))
    q = p - 0.5
    r = q * q
    centre = _poly(_QA, r) * q / (_poly(_QB, r) * r + 1)
    low = F.sqrt(-2 * F.log(p))
    high = F.sqrt(-2 * F.log1p(-p))
    return (
        F.when(p < 0.02425, _poly(_QC, low) / (_poly(_QD, low) * low + 1))
        .when(p > 1 - 0.02425, -_poly(_QC, high) / (_poly(_QD, high) * high + 1))
        .otherwise(centre)
    )
