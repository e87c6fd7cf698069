"""Edge cases: counter reset, empty input, ties, extension membership by anti join."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from frames import T0, sample, snap
from vacfleet.operators import asof, estimate, sparse


def test_counter_reset_suppresses_churn_not_growth(spark, samples_df, snaps_df):
    s = samples_df([sample(snapshot_id=1, n_tup_ins=1000, n_tup_upd=500, reltuples=1000.0),
                    sample(snapshot_id=2, n_tup_ins=10, n_tup_upd=5, reltuples=1060.0)])
    snaps = snaps_df([snap(snapshot_id=1, collected_at=T0),
                      snap(snapshot_id=2, collected_at=T0 + dt.timedelta(seconds=60))])
    prior = spark.createDataFrame([("c0", 1, 7.0, 3.0, 1.0, None, None, None, None, None, 0)],
                                  estimate.empty_prior(spark).schema)
    e = estimate.estimate_calc(s, snaps, prior, 2).collect()[0]
    assert e.reset is True
    assert e.churn_rate == 7.0 and e.dead_accum_rate == 3.0          # prior kept
    assert e.growth_rate == pytest.approx(e.alpha * 1.0 + (1 - e.alpha) * 1.0)


def test_empty_inputs(spark, samples_df, snaps_df):
    s = samples_df([]).limit(0)
    assert asof.state_as_of(s, snaps_df([snap()])).count() == 0
    assert sparse.sparse_log(s.drop("relfrozenxid_age", "relminmxid_age")).count() == 0


def test_equal_snapshot_rows_pick_deterministically(spark, samples_df, snaps_df):
    """Two relations, one sample each at the same snapshot: both are current."""
    s = samples_df([sample(relid=1, snapshot_id=3), sample(relid=2, snapshot_id=3)])
    rows = asof.state_as_of(s, snaps_df([snap(snapshot_id=3)])).collect()
    assert sorted(r.relid for r in rows) == [1, 2]


def test_extension_members_anti_join(spark, samples_df):
    dense = (samples_df([sample(relid=1), sample(relid=2)])
             .drop("relfrozenxid_age", "relminmxid_age")
             .withColumn("relkind", F.lit("r")).withColumn("relpersistence", F.lit("p"))
             .withColumn("relispartition", F.lit(False)).withColumn("extension_owned", F.lit(False)))
    pol = spark.createDataFrame([("c0", True, False, 0, [])],
                                "cluster_id string, exclude_temp boolean, include_extension_owned boolean, "
                                "min_partition_size_bytes bigint, excluded_schemas array<string>")
    ext = spark.createDataFrame([("c0", 2)], "cluster_id string, relid bigint")
    kept = sparse.collection_filter(dense, pol, extension_members=ext)
    assert [r.relid for r in kept.collect()] == [1]


def test_state_as_of_live_filter(spark, samples_df, snaps_df):
    s = samples_df([sample(relid=1, snapshot_id=1), sample(relid=2, snapshot_id=1)])
    live = spark.createDataFrame([("c0", 2)], "cluster_id string, relid bigint")
    snaps = snaps_df([snap(snapshot_id=1)])
    assert asof.state_as_of(s, snaps).count() == 2                      # never tombstoned
    assert [r.relid for r in asof.state_as_of(s, snaps, live=live).collect()] == [2]
