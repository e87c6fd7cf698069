"""Randomized properties (hypothesis) of the scalar rules."""

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vacfleet import params as P
from vacfleet.functions import exprs as X
from vacfleet.operators import experiment as XP


def _snap_ref(x):
    return min(P.SF_GRID, key=lambda g: (abs(g - x), g))


@settings(max_examples=5, deadline=None)
@given(st.lists(st.floats(min_value=-2.0, max_value=2.0, allow_nan=False), min_size=1, max_size=200))
def test_snap_matches_reference(spark, xs):
    xs = xs + [0.015, 0.035, 0.075, 0.15, 0.25, 0.4]       # the midpoints
    df = spark.createDataFrame([(x,) for x in xs], "x double").select(
        "x", X.snap_to_grid("x").alias("s"))
    for r in df.collect():
        assert r.s == _snap_ref(r.x)


@settings(max_examples=5, deadline=None)
@given(st.lists(st.integers(min_value=1, max_value=2_000_000), min_size=1, max_size=300))
def test_nearest_rank_integer_form_equals_float_rule(spark, ns):
    df = spark.createDataFrame([(n,) for n in ns], "n long").select(
        "n", XP.nearest_rank_index(F.col("n"), 19, 20).alias("k"))
    for r in df.collect():
        assert r.k == min(max(int(0.95 * r.n + 0.5), 1), r.n)


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(st.floats(-1e6, 1e6), st.floats(-1e6, 1e6), st.floats(0.0, 1.0)),
                min_size=1, max_size=200))
def test_ewma_between_prior_and_sample(spark, rows):
    df = spark.createDataFrame(rows, "p double, s double, a double").select(
        "p", "s", X.ewma("p", "s", "a").alias("e"))
    for r in df.collect():
        lo, hi = min(r.p, r.s), max(r.p, r.s)
        assert lo - 1e-6 * (1 + abs(lo)) <= r.e <= hi + 1e-6 * (1 + abs(hi))
