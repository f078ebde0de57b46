"""Special functions against table values, closed forms and quadrature."""
import math
from statistics import NormalDist

import numpy as np
import pytest
from pyspark.sql import functions as F

from lendlens.functions import special as S


def at(spark, expr, **values):
    names = list(values)
    rows = list(zip(*values.values(), strict=True))
    df = spark.createDataFrame([tuple(float(x) for x in r) for r in rows], ", ".join(f"{n} double" for n in names))
    return [r[0] for r in df.select(expr(*[F.col(n) for n in names])).collect()]


def test_chi_square_tails_and_critical_values(spark):
    dof = [1, 2, 5, 10, 34]
    q95 = [3.841459, 5.991465, 11.070498, 18.307038, 48.602367]
    assert at(spark, lambda d: S.chi2_critical(0.05, d), d=dof) == pytest.approx(q95, abs=1e-5)
    assert at(spark, S.chi2_sf, x=q95, d=dof) == pytest.approx([0.05] * 5, abs=1e-6)
    xs = [0.1, 1.0, 5.0, 30.0, 200.0]
    assert at(spark, S.chi2_sf, x=xs, d=[2] * 5) == pytest.approx([math.exp(-x / 2) for x in xs], rel=1e-12)
    assert at(spark, S.chi2_sf, x=[3.0, 0.0], d=[0, 4]) == [None, 1.0]


def test_chi_square_tail_meets_itself_and_its_limit(spark):
    # finite sums and the expansion, side by side at the change-over
    for x in (150.0, 199.0, 201.0, 230.0, 260.0):
        small, = at(spark, lambda a, d: S._chi2_finite(a / 2, d), a=[x], d=[200])
        large, = at(spark, lambda a, d: S._chi2_large(a / 2, d), a=[x], d=[200])
        assert small == pytest.approx(large, abs=1e-7)
    dofs = [1e3, 1e5, 1e7, 1e9]
    limit = [0.5 - 1 / (3 * math.sqrt(math.pi * d)) for d in dofs]
    assert at(spark, S.chi2_sf, x=dofs, d=dofs) == pytest.approx(limit, abs=1e-6)


def test_f_tail(spark):
    def quadrature(f, n):
        t = np.linspace(0, math.sqrt(f), 20001)
        density = np.exp(math.lgamma((n + 1) / 2) - math.lgamma(n / 2)) / math.sqrt(n * math.pi) * (1 + t * t / n) ** (-(n + 1) / 2)
        return 1 - 2 * np.trapezoid(density, t)
    cases = [(4.0, 10), (0.5, 1), (3.0, 2), (2.2, 7), (10.0, 200), (10.0, 201), (3.9, 15000), (0.0, 30)]
    got = at(spark, S.f_sf, f=[f for f, _ in cases], n=[n for _, n in cases])
    assert got == pytest.approx([quadrature(f, n) for f, n in cases], abs=1e-7)
    assert at(spark, S.f_sf, f=[1.0], n=[0]) == [None]


def test_normal_tails_keep_their_digits(spark):
    zs = [-3.0, 0.0, 0.3, 1.0, 2.4, 3.6, 6.0, 9.0, 20.0, 37.0]
    assert at(spark, S.norm_sf, z=zs) == pytest.approx([0.5 * math.erfc(z / math.sqrt(2)) for z in zs], rel=1e-10)
    assert at(spark, S.norm_two_sided, z=[9.0, -0.2]) == pytest.approx([2.2571768119076845e-19, 1.0], rel=1e-10)


def test_norm_expressions(spark):
    nd = NormalDist()
    zs = [-6.0, -2.5, -1.0, -0.1, 0.0, 0.3, 1.96, 4.0]
    ps = [1e-6, 0.001, 0.02, 0.3, 0.5, 0.77, 0.975, 0.9999]
    assert at(spark, S.norm_cdf, z=zs) == pytest.approx([nd.cdf(z) for z in zs], abs=2e-7)
    assert at(spark, S.norm_ppf, p=ps) == pytest.approx([nd.inv_cdf(p) for p in ps], rel=1e-8, abs=1e-8)


def test_kolmogorov_tail(spark):
    # 1.3581 is the 5 % point of the limit law
    assert at(spark, S.kolmogorov_sf, d=[1.3581e-3, 1e-9, 0.9], n=[1e6, 1e6, 1e4]) == pytest.approx([0.05, 1.0, 0.0], abs=1e-4)
