"""Exact quantiles by rounds of histograms."""

from __future__ import annotations

import numpy as np
import pytest

from pagemill.operators import vectors


@pytest.mark.parametrize("few", [3, 10_000])
def test_percentiles_are_exact(spark, monkeypatch, few):
    monkeypatch.setattr(vectors, "FEW", few)
    monkeypatch.setattr(vectors, "HISTOGRAM", 8)
    rng = np.random.default_rng(1)
    cases = {
        "normal": rng.normal(size=700), "ties": np.repeat([1.0, 2.0, 2.0, 5.0], 60), "one": np.array([4.0]), "equal": np.full(90, -3.0), "few": np.array([2.0, 1.0]),
        "far apart": np.array([-1e308, -1.0, 0.0, 1e-300, 2e-300, 1.0, 1e308]), "mostly zero": np.append(np.zeros(500), rng.exponential(size=20)), "scales": 10.0 ** rng.uniform(-200, 200, 300),
    }
    for name, x in cases.items():
        df = spark.createDataFrame([(float(v),) for v in x], "x double").repartition(3).cache()
        for share in (0.37, 0.99):
            assert vectors.percentile(df, share) == pytest.approx(float(np.quantile(x, share)), rel=1e-12), (name, share)
        for k in (0, len(x) - 1) if few == 3 else ():
            assert vectors.kth_smallest(df, k) == np.sort(x)[k], (name, k)
        df.unpersist()


def test_percentile_of_nothing(spark):
    df = spark.createDataFrame([(None,), (float("nan"),)], "x double")
    assert vectors.percentile(df, 0.5) is None and vectors.percentile(df.limit(0), 0.5) is None
