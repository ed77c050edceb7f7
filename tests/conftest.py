from __future__ import annotations

import sys
from pathlib import Path

import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from wavetable.session import get_spark  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    return get_spark("tests")


@pytest.fixture(scope="session")
def scans(spark):
    """48 spectra of three absorption bands on a drifting baseline; the label is the second band's height."""
    rng = np.random.default_rng(90210)
    grid = np.arange(151) / 150
    centres, widths = np.array([0.2, 0.55, 0.8]), np.array([0.05, 0.12, 0.08])
    heights = rng.uniform(0.3, 1.2, size=(48, 3))
    bands = np.exp(-(((grid[:, None] - centres) / widths) ** 2))
    drift = rng.uniform(0.8, 1.4, size=(48, 1)) + rng.uniform(-0.3, 0.3, size=(48, 1)) * grid
    x = heights @ bands.T + drift + 0.01 * rng.normal(size=(48, 151))
    y = heights[:, 1] + 0.02 * rng.normal(size=48)
    return x, y, table(spark, x, y)


@pytest.fixture(scope="session")
def informative(spark):
    """200 x 30, label driven by the first five channels."""
    rng = np.random.default_rng(7)
    x = rng.normal(size=(200, 30))
    y = 2 * x[:, :5].mean(axis=1) + 0.05 * rng.normal(size=200)
    return x, y, table(spark, x, y)


def table(spark, x, y):
    rows = [(i, r.tolist(), float(v)) for i, (r, v) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, "row_id long, spectrum array<double>, label double").repartition(3)


def matrix(df, column="spectrum"):
    rows = df.select("row_id", column).orderBy("row_id").collect()
    return np.array([r[column] for r in rows], dtype=float)
