"""Robust statistics and normality tests against NumPy brute force."""
from statistics import NormalDist

import numpy as np
import pandas as pd
import pytest

from lendlens.operators import distribution as D
from lendlens.operators import rankstats as RK


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(11)
    n = 2000
    y = (rng.random(n) < 0.3).astype(int)
    x = np.round(rng.gamma(2.0, 2.0 + y, n), 2)
    x[:5] = [80.0, 95.0, 120.0, 150.0, 150.0]
    t = rng.integers(0, 5, n).astype(float)
    pdf = pd.DataFrame({"default": y, "x": x, "t": t})
    return spark.createDataFrame(pdf), pdf


def test_median_mad_and_outliers(spark, data):
    df, pdf = data
    mm = D.median_mad(RK.value_counts(df, ["x"])).first()
    med = np.median(pdf.x)
    mad = np.median(np.abs(pdf.x - med))
    assert mm["median"] == pytest.approx(med) and mm["mad"] == pytest.approx(mad)
    out = D.robust_outliers(df, "x", 3.5, None).toPandas()
    z = 0.6745 * (pdf.x - med) / mad
    expected = pdf.x[np.abs(z) > 3.5]
    assert set(out.x) == set(expected)
    assert out.frequency.sum() == len(expected)


def test_mad_zero_gives_empty(spark):
    df = spark.createDataFrame([(1.0,)] * 10 + [(5.0,)], "x double")
    assert D.robust_outliers(df, "x").count() == 0


def test_brown_forsythe(spark, data):
    df, pdf = data
    got = D.contrast_stats(df, ["x"], "default").first()
    groups = [pdf.x[pdf.default == c].to_numpy() for c in (0, 1)]
    z = [np.abs(g - np.median(g)) for g in groups]
    n = sum(len(g) for g in z)
    zbar = np.concatenate(z).mean()
    ssb = sum(len(g) * (g.mean() - zbar) ** 2 for g in z)
    ssw = sum(((g - g.mean()) ** 2).sum() for g in z)
    f = (n - 2) * ssb / ssw
    assert got["bf_f"] == pytest.approx(f, rel=1e-6)
    assert got["median_0"] == pytest.approx(np.median(groups[0]))
    q1, q3 = np.percentile(groups[1], [25, 75])
    assert got["iqr_1"] == pytest.approx(q3 - q1)


def test_shape_and_jarque_bera(spark, data):
    df, pdf = data
    r = D.shape(df, ["x"]).first()
    x = pdf.x.to_numpy()
    m = x - x.mean()
    m2, m3, m4 = (m ** 2).mean(), (m ** 3).mean(), (m ** 4).mean()
    s, k = m3 / m2 ** 1.5, m4 / m2 ** 2 - 3
    assert r["skewness"] == pytest.approx(s, abs=1e-6)
    assert r["kurtosis"] == pytest.approx(k, abs=1e-6)
    assert r["jarque_bera"] == pytest.approx(len(x) / 6 * (s * s + k * k / 4), abs=1e-3)


def test_ks_normal(spark, data):
    df, pdf = data
    r = RK.ks_normal(df, ["x"]).first()
    x = np.sort(pdf.x.to_numpy())
    zs = (x - x.mean()) / x.std(ddof=1)
    nd = NormalDist()
    cdf = np.array([nd.cdf(v) for v in zs])
    n = len(x)
    # with ties the ECDF jumps once per distinct value
    vals, counts = np.unique(x, return_counts=True)
    cum = np.cumsum(counts)
    phi = np.array([nd.cdf((v - x.mean()) / x.std(ddof=1)) for v in vals])
    d = max(np.max(cum / n - phi), np.max(phi - (cum - counts) / n))
    assert r["ks_normal"] == pytest.approx(d, abs=1e-6)
    assert cdf.shape[0] == n


@pytest.mark.parametrize("ties", [False, True])
def test_shapiro_francia(spark, ties):
    rng = np.random.default_rng(5)
    x = rng.normal(0, 1, 1500) ** 2
    if ties:
        x = np.round(x, 1)
    df = spark.createDataFrame(pd.DataFrame({"x": x}))
    got = D.shapiro_francia(df, ["x"]).first()["sf_w"]
    n = len(x)
    nd = NormalDist()
    m = np.array([nd.inv_cdf((i - 0.375) / (n + 0.25)) for i in range(1, n + 1)])
    w = np.corrcoef(np.sort(x), m)[0, 1] ** 2
    assert got == pytest.approx(w, abs=2e-4 if ties else 1e-6)


def test_box_stats(spark, data):
    df, pdf = data
    rows = {r["default"]: r for r in D.box_stats(df, ["x"], "default").collect()}
    g = pdf.x[pdf.default == 0].to_numpy()
    q1, q3 = np.percentile(g, [25, 75])
    lo, hi = q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)
    assert rows[0]["whisker_hi"] == pytest.approx(g[g <= hi].max())
    assert rows[0]["whisker_lo"] == pytest.approx(g[g >= lo].min())
    assert rows[0]["n_outside"] == int(((g < lo) | (g > hi)).sum())
