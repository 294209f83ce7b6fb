"""Rank-selection quantiles and the maintenance thresholds that use them."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from millwright.operators import fleet, ordered

PROBS = [0.0, 0.05, 0.5, 0.8, 0.95, 1.0]


def _df(spark, values):
    return spark.createDataFrame([(None if v is None else float(v),) for v in values], "tool_wear_min double")


@pytest.mark.parametrize("n,kinds", [(1, 1), (2, 2), (97, 97), (1000, 7), (3000, 2500)])
def test_forced_buckets_equal_brute_force(spark, n, kinds):
    r = random.Random(n)
    pool = [r.uniform(-50, 250) for _ in range(kinds)]
    values = [r.choice(pool) for _ in range(n)]
    want = np.quantile(values, PROBS)
    for rows_per_bucket in (3, 100, 10**6):
        got = ordered.exact_quantiles(_df(spark, [*values, None]), "tool_wear_min", PROBS, rows_per_bucket)
        assert np.allclose(got, want, rtol=0, atol=1e-9), rows_per_bucket


def test_hot_value(spark):
    values = [7.0] * 5000 + [float(v) for v in range(100)]
    got = ordered.exact_quantiles(_df(spark, values), "tool_wear_min", PROBS, 10)
    assert got == list(np.quantile(values, PROBS))


def test_no_value(spark):
    assert ordered.exact_quantiles(_df(spark, [None, None]), "tool_wear_min", PROBS) is None


@settings(max_examples=15, deadline=None)
@given(st.lists(st.integers(0, 30), min_size=1, max_size=40))
def test_thresholds(spark, values):
    th = fleet.thresholds_row(_df(spark, values), rows_per_bucket=5)
    high, urgent = np.quantile(values, [0.8, 0.95])
    assert th == {"high": round(float(high), 2), "urgent": round(float(urgent if urgent > high else high + 1), 2), "method": "quantile"}
