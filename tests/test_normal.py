"""Normal distribution against the standard library; tiled covariances against plain ones."""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tapeloom.functions import normal
from tapeloom.plans import portfolio


def test_quantiles_and_shares(spark):
    p = [1e-300, 1e-15, 1e-6, 0.02425, 0.0243, 0.3, 0.5, 0.9, 0.999, 1 - 1e-9]
    got = [r.q for r in spark.createDataFrame([(x,) for x in [*p, 0.0, 1.0, -0.1, None]], "p double").coalesce(1).select(normal.quantile(F.col("p")).alias("q")).collect()]
    assert got[len(p) :] == [None] * 4 and all(abs(a - NormalDist().inv_cdf(x)) < 1e-9 for a, x in zip(got, p))
    x = [-37.0, -8.0, -5.7, -3.0, -0.6, 0.0, 0.2, 1.0, 4.0, 9.0]
    got = spark.createDataFrame([(v,) for v in x], "x double").coalesce(1).select("x", normal.cdf(F.col("x")).alias("c"), normal.erf(F.col("x")).alias("e"), normal.density(F.col("x"), F.lit(1.0), F.lit(2.0)).alias("d")).collect()
    for r in got:
        assert math.isclose(r.c, math.erfc(-r.x / math.sqrt(2)) / 2, rel_tol=1e-12) and abs(r.e - math.erf(r.x)) < 1e-14
        assert math.isclose(r.d, NormalDist(1, 2).pdf(r.x), rel_tol=1e-12)


@pytest.mark.parametrize(("tile", "dates"), [(256, 2048), (7, 13)])
def test_tiled_covariances(spark, tile, dates):
    """Pairs with gaps, one common date, none, and values far from 0, in many tiles and blocks."""
    rng = np.random.default_rng(2)
    wide = pd.DataFrame(rng.normal(size=(60, 30)) + 1e4, columns=[f"s{k:02}" for k in range(30)], index=pd.date_range("2020-01-01", periods=60))
    wide = wide.mask(rng.random(wide.shape) < 0.4)
    wide.loc[wide.index[1:], "s03"] = np.nan
    long = wide.stack().rename("r").reset_index().set_axis(["date", "symbol", "r"], axis=1)
    long["date"] = long["date"].dt.date
    got = {(r.i, r.j): r for r in portfolio.covariances(spark.createDataFrame(long), tile, dates).collect()}
    for a in wide:
        for b in wide:
            if a <= b:
                both = wide[[a, b]].dropna() if a != b else wide[[a, a]].dropna().set_axis([a, "again"], axis=1)
                if not len(both):
                    assert (a, b) not in got
                    continue
                r, x = got[a, b], both.to_numpy()
                assert r.n == len(x) and (r.cov is None) == (len(x) == 1)
                if len(x) > 2:
                    assert math.isclose(r.cov, np.cov(x.T)[0, 1], rel_tol=1e-7, abs_tol=1e-9) and abs(r["corr"] - np.corrcoef(x.T)[0, 1]) < 1e-7
    assert len(got) == sum(1 for a in wide for b in wide if a <= b and len(wide[[a]].join(wide[[b]], rsuffix="2").dropna()))
