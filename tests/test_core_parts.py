import itertools
import math

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from penumbra.functions import membership as mb
from penumbra.functions.assign import min_cost_assignment
from penumbra.functions.optimise import lbfgs
from penumbra.plans.ordered import range_blocks, running_sum


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 4), st.integers(1, 4), st.integers(0, 10**6))
def test_assignment_is_optimal(n, m, seed):
    c = np.random.default_rng(seed).normal(size=(n, m))
    a = min_cost_assignment(c)
    k = min(n, m)
    best = min(sum(c[i, j] for i, j in zip(r, q)) for r in itertools.permutations(range(n), k) for q in itertools.combinations(range(m), k))
    assert len(a) == k and sum(c[i, j] for i, j in a) <= best + 1e-9


def test_special_functions():
    x = np.array([0.1, 1.0, 2.5, 30.0])
    h = 1e-5
    slope = (mb.lgamma(x + h) - mb.lgamma(x - h)) / (2 * h)
    assert np.allclose(mb.digamma(x), slope, atol=1e-6)
    assert math.isclose(float(mb.betaln(np.array(2.0), np.array(3.0))), math.log(1 / 12), rel_tol=1e-12)


def test_ratio_does_not_overflow():
    u = mb.ratio(np.array([[1e-300, 1.0], [1e300, 1e299]]), 2.0)
    assert np.allclose(u.sum(1), 1) and np.isfinite(u).all()


def test_uniforms_depend_on_id_only():
    ids = np.arange(100)
    a = mb.uniform(ids, 3, 5)
    assert (a[::-1] == mb.uniform(ids[::-1], 3, 5)).all() and 0.4 < a.mean() < 0.6 and np.allclose(mb.dirichlet(ids, 4, 1).sum(1), 1)


def test_lbfgs_minimises():
    x, v, _ = lbfgs(lambda x: (float(((x - 3) ** 2 * [1, 100]).sum()), 2 * (x - 3) * [1, 100]), np.zeros(2), ftol=1e-14)
    assert np.allclose(x, 3, atol=1e-4) and v < 1e-6


def test_running_sums_over_blocks_with_a_hot_group_and_null_keys(spark):
    df = spark.range(1000).select(F.when(F.col("id") % 3 == 0, F.lit(None)).otherwise(F.when(F.col("id") % 10 == 1, F.col("id") % 7).otherwise(0)).alias("g"), F.col("id").alias("o"), F.lit(2).alias("v"))
    order = [F.col("o")]
    got = running_sum(range_blocks(df, ["g"], order, 7), ["g"], order, "v", "cum", "total").collect()
    want: dict = {}
    for r in sorted(df.collect(), key=lambda r: r["o"]):
        want.setdefault(r["g"], []).append(r["o"])
    assert len(got) == 1000
    for r in got:
        assert r["cum"] == 2 * (want[r["g"]].index(r["o"]) + 1) and r["total"] == 2 * len(want[r["g"]])
