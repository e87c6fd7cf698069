"""Properties: round trips, associativity, order independence, skew-safe helpers."""

import math
import random

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vacfleet import params as P
from vacfleet.operators import experiment as XP
from vacfleet.operators import rollup as R
from vacfleet.operators import sparse
from vacfleet.operators.sequence import previous_row
from vacfleet.plans.inputs import inputs
from vacfleet.sources import derive as D

SF = "/root/testdata/sf0.001"


def _same(a, b):
    ca = sorted(a.columns)
    assert ca == sorted(b.columns)
    assert a.select(*ca).exceptAll(b.select(*ca)).count() == 0
    assert b.select(*ca).exceptAll(a.select(*ca)).count() == 0


def test_sparse_log_round_trip(spark):
    """Sparse logging of the dense catalog history gives the stored samples back."""
    i = inputs(spark, SF)
    ages = ["relfrozenxid_age", "relminmxid_age"]
    flags = ["relkind", "relpersistence", "relispartition", "extension_owned"]
    _same(sparse.sparse_log(i.dense.drop(*flags)).drop("slot"), i.samples.drop(*ages, "slot"))


def test_rollup_associative(spark):
    """1d straight from the 1m tier equals 1d from 1h (up to float order)."""
    i = inputs(spark, SF)
    r1m, r1h, r1d = R.rollup(i.samples, i.snapshots)
    direct = R.coarsen(r1m, "day")
    cols = [c for c in r1d.columns if not c.startswith("avg_")]
    _same(direct.select(*cols), r1d.select(*cols))
    j = direct.alias("a").join(r1d.alias("b"), ["cluster_id", "relid", "bucket_start"])
    assert j.filter(F.abs(F.col("a.avg_dead_tup") - F.col("b.avg_dead_tup")) > 1e-9).count() == 0


def test_order_independent_under_repartition(spark):
    i = inputs(spark, SF)
    a = R.rollup(i.samples, i.snapshots)[1]
    b = R.rollup(i.samples.repartition(7, "snapshot_id"), i.snapshots.repartition(3))[1]
    _same(a.select("relid", "bucket_start", "sample_count", "max_dead_tup"),
          b.select("relid", "bucket_start", "sample_count", "max_dead_tup"))


def test_previous_row_equals_lag(spark):
    rnd = random.Random(7)
    rows = [("k%d" % rnd.randint(0, 3), rnd.randint(0, 500), rnd.random()) for _ in range(400)]
    rows = list({(k, t): (k, t, v) for k, t, v in rows}.values())
    df = spark.createDataFrame(rows, "k string, t long, v double")
    got = previous_row(df, ["k"], ["t"], F.floor(F.col("t") / 37), ["v"])
    want = df.withColumn("prev_v", F.lag("v").over(W.partitionBy("k").orderBy("t")))
    _same(got.select("k", "t", "prev_v"), want.select("k", "t", "prev_v"))


@pytest.mark.parametrize("num,den", [(19, 20), (1, 2), (99, 100)])
def test_two_level_rank_equals_sort(spark, num, den):
    rnd = random.Random(num)
    rows = [("g%d" % rnd.randint(0, 4), rnd.choice([rnd.randint(0, 5000), rnd.randint(0, 50)]))
            for _ in range(2000)]
    df = spark.createDataFrame(rows, "g string, latency_us long")
    counts = df.groupBy("g").agg(F.count("*").alias("n"))
    tg = counts.select("g", F.lit("p").alias("name"),
                       XP.nearest_rank_index(F.col("n"), num, den).alias("tgt"))
    picked, _ = XP.first_reaching(df, ["g"], "latency_us", F.lit(1), tg, 64.0)
    got = {r.g: r.latency_us for r in picked.collect()}
    by = {}
    for g, v in rows:
        by.setdefault(g, []).append(v)
    for g, vs in by.items():
        vs.sort()
        k = min(max(int(num / den * len(vs) + 0.5), 1), len(vs))
        assert got[g] == vs[k - 1]


def test_derivation_is_sparse_already(spark):
    i = inputs(spark, SF)
    n_rel = i.samples.select("relid").distinct().count()
    n_snap = i.snapshots.count()
    assert i.samples.count() < n_rel * n_snap


def test_tolerance_join_catches_cell_edges(spark):
    left = spark.createDataFrame([(0.1 + 4e-10,), (0.3,)], "a double")
    right = spark.createDataFrame([(0.1,), (0.3 + 2e-9,)], "b double")
    got = XP.tolerance_join(left, right, "a", "b").collect()
    assert len(got) == 1 and abs(got[0].a - 0.1) < 1e-9


def test_stand_in_inputs_are_deterministic(spark):
    ev = D.read(spark, SF, "events")
    a, b = D.relation_samples(ev), D.relation_samples(ev.repartition(5))
    _same(a, b)


def _short_history(i):
    """The stored rows and headers of eight snapshots around a midnight, as two clusters
    that share every relation and snapshot id."""
    day = i.snapshots.agg(F.max("collected_day")).first()[0]
    first = i.snapshots.filter(F.col("collected_day") == day).agg(F.min("snapshot_id")).first()[0]
    near = F.col("snapshot_id").between(first - 4, first + 3) & (F.col("cluster_id") == "n0")
    both = F.explode(F.array(F.lit("n1"), F.lit("n2")))
    samples = i.samples.filter(near).withColumn("cluster_id", both)
    samples = samples.filter((F.col("cluster_id") == "n1") | (F.col("relid") % 2 == 0))
    return samples, i.snapshots.filter(near).withColumn("cluster_id", both)


def test_backfill_equals_repeated_ticks(spark):
    """The fold over a history in one-day chunks equals one estimate and classify tick after
    the other, each from full reconstruction and with its own snapshot's debt, for clusters
    that share all ids and have a policy."""
    from vacfleet.operators import asof, backfill, classify, debt, estimate
    i = inputs(spark, SF)
    samples, snaps = (x.cache() for x in _short_history(i))
    e = c = None
    ids = sorted(r[0] for r in snaps.select("snapshot_id").distinct().collect())
    for sid in ids:
        tgt = asof.target_snapshot(snaps, sid)
        md = debt.maintenance_debt(samples, snaps, tgt)
        e = _fixed(spark, estimate.estimate_tick(samples, snaps, e, tgt, md=md))
        c = _fixed(spark, classify.classify_tick(samples, snaps, c, i.policy, tgt))
    want = e.join(c, ["cluster_id", "relid"])
    for days in (1, 30):
        got = backfill.control_state(samples, snaps, i.policy, chunk_days=days)
        _same(got, want.select(got.columns))


def _fixed(spark, df):
    return spark.createDataFrame(df.collect(), df.schema)


def test_backfill_folds_stored_rows_not_snapshots(spark):
    """A quiet fleet: the folded ticks follow the stored rows, however many snapshots pass, and the
    state equals one tick after the other (``test_backfill_equals_repeated_ticks`` has the rest)."""
    import datetime as dt

    from frames import SAMPLE_COLS, SNAP_COLS, T0, frame, sample, snap
    from vacfleet.operators import backfill
    rows = [sample(relid=r, snapshot_id=p, n_tup_ins=100 * p + r, n_tup_upd=0, n_tup_del=0, n_dead_tup=3 * p,
                   last_autovacuum=T0 + dt.timedelta(minutes=3) if p >= 4 else None, autovacuum_count=int(p >= 4))
            for r in (1, 2, 3) for p in (1, 4, 90 + r)]
    heads = []
    for p in range(1, 201):
        at = T0 + dt.timedelta(minutes=p) if p != 120 else T0 + dt.timedelta(minutes=50)      # a clock set back once
        heads.append(snap(snapshot_id=p, collected_at=at, def_vac_threshold=50 if p < 150 else 5,  # debt rises at 150
                          collected_day=19723 + p // 100))
    rows = [dict(r, collected_day=19723 + r["snapshot_id"] // 100) for r in rows]
    samples, snaps = frame(spark, SAMPLE_COLS, rows), frame(spark, SNAP_COLS, heads)
    numbered = backfill.numbered_headers(snaps)
    stored = backfill.stored_rows(samples, numbered)
    ticks = backfill.moving_ticks(numbered, stored)
    running_ = 60                                # headers within an hour of the maintenance run
    assert ticks.count() <= stored.count() * (1 + running_) + 2 * 3 < 200 * 3
    assert ticks.filter("snapshot_id > 100").groupBy("snapshot_id").count().count() == 2       # the set clock, the new default
    got = {r["relid"]: r for r in backfill.control_state(samples, snaps, None, chunk_days=1).collect()}
    for relid in (1, 2, 3):
        want = _ticked([r for r in rows if r["relid"] == relid], heads)
        for name, value in want.items():
            assert got[relid][name] == (pytest.approx(value, rel=1e-9) if isinstance(value, float) else value), (relid, name)


def _ticked(rows, heads, tau=P.DEFAULT.ewma_tau, window=P.DEFAULT.av_window_s):
    """One relation's rates, peak and streak, tick by tick, straight from their definitions."""
    at = {h["snapshot_id"]: h["collected_at"] for h in heads}
    stored = {r["snapshot_id"]: r for r in rows}
    churn = dead = peak = cand = None
    streak, cur = 0, None
    for h in heads:
        prev, new = cur, stored.get(h["snapshot_id"])
        cur = new or cur
        fraction = cur["n_dead_tup"] / cur["reltuples"]
        boundary = False
        if prev is not None:
            dt_s = (h["collected_at"] - at[prev["snapshot_id"]]).total_seconds()
            boundary = cur["autovacuum_count"] > prev["autovacuum_count"]
            if dt_s > 0:
                alpha = 1 - math.exp(-dt_s / tau)
                for name, now in (("churn", (cur["n_tup_ins"] - prev["n_tup_ins"]) / dt_s), ("dead", (cur["n_dead_tup"] - prev["n_dead_tup"]) / dt_s)):
                    old = churn if name == "churn" else dead
                    value = now if old is None else alpha * now + (1 - alpha) * old
                    churn, dead = (value, dead) if name == "churn" else (churn, value)
        peak = fraction if boundary or peak is None else max(peak, fraction)
        debt_high = cur["n_dead_tup"] / (h["def_vac_threshold"] + h["def_vac_scale_factor"] * cur["reltuples"]) > 1
        run = cur.get("last_autovacuum")
        running_now = run is not None and (h["collected_at"] - run).total_seconds() < window
        now = None if not debt_high else "io_limited" if running_now else "config"
        streak = 0 if now is None else streak + 1 if now == cand else 1
        cand = now
    return {"churn_rate": churn, "dead_accum_rate": dead, "f_peak_current": peak, "saturation_candidate": cand, "saturation_streak": streak}


@pytest.mark.parametrize("size", [3, 1000])
def test_running_totals_equal_plain_windows(spark, size):
    """Buckets of any size, ties between buckets excluded, NULL values and NULL keys."""
    from vacfleet.operators.sequence import first_within, running
    rows = [(None if k == 2 else k, t, (t * 7 + k) % 11 if t % 4 else None) for k in range(4) for t in range(60)]
    df = spark.createDataFrame(rows, "k int, t long, v long")
    w = W.partitionBy("k").orderBy("t").rowsBetween(W.unboundedPreceding, W.currentRow)
    want = df.select("*", F.coalesce(F.sum("v").over(w), F.lit(0)).alias("s"), F.min("v").over(w).alias("lo"), F.max("v").over(w).alias("hi"))
    got = running(df, ["k"], ["t"], F.floor(F.col("t") / size), {"s": ("sum", F.col("v")), "lo": ("min", F.col("v")), "hi": ("max", F.col("v"))})
    _same(got, want)
    keyed = df.filter("k is not null and (t < 20 or t % 9 = 0)")
    r = W.partitionBy("k").orderBy("t").rangeBetween(-size, 0)
    _same(first_within(keyed, ["k"], "t", "t", size, ["t", "v"]).select("k", "t", "first_t"),
          keyed.select("k", "t", F.min("t").over(r).alias("first_t")))


def test_backfill_of_an_empty_history(spark):
    from vacfleet.operators import backfill
    i = inputs(spark, SF)
    assert backfill.control_state(i.samples.limit(0), i.snapshots.limit(0), None).count() == 0


def test_incremental_tick_equals_full_history(spark):
    """The cache-based tick (cache + rows at p) equals reconstructing from all history."""
    from vacfleet.operators import estimate
    from vacfleet.plans import catalog as C
    i = inputs(spark, SF)
    full = estimate.estimate_tick(i.samples, i.snapshots, i.carried_state)
    inc = C._estimate_chain(spark, SF).select(*estimate.ESTIMATE_COLS)
    _same(inc, full)


def test_weighted_median_fractional_weights(spark):
    import random
    from fractions import Fraction

    from vacfleet.operators.experiment import weighted_median
    rng = random.Random(4)
    rows = [(g, rng.randint(1, 9), rng.choice([0.1, 0.2, 0.3, 0.7])) for g in range(300)
            for _ in range(rng.randint(1, 8))]
    got = [(r.g, r.weighted_median) for r in weighted_median(
        spark.createDataFrame(rows, "g int, v int, w double"), ["g"], "v", "w", 3.0).collect()]
    want = {}
    for g in range(300):
        own = sorted((v, Fraction(str(w))) for k, v, w in rows if k == g)
        total, run = sum(w for _, w in own), Fraction(0)
        for v, w in own:
            run += w
            if 2 * run >= total:
                want[g] = v
                break
    assert len(got) == 300 and dict(got) == want


def test_window_percentiles_hold_buckets_not_rows(spark, monkeypatch):
    from vacfleet.operators import experiment as XP
    made = {}
    keep = XP.store
    monkeypatch.setattr(XP, "store", lambda df, name: made.setdefault(name, keep(df, name)))
    n = 20000                                   # every latency is distinct
    rows = [("a", "f", "s", 1, None, (k * 7919) % n * 9 + 5, k % 2) for k in range(n)]
    tx = spark.createDataFrame(rows, "arm string, fixture string, scenario string, seed int, probe_sf double, "
                                     "latency_us long, epoch_s long")
    got = {r.win: (r.p95_us, r.tx_count) for r in XP.window_p95(tx, 1).collect()}
    want = {}
    for w in (0, 1):
        own = sorted(r[5] for r in rows if r[6] == w)
        want[w] = (own[(19 * len(own) + 10) // 20 - 1], len(own))
    assert got == want
    assert made["rank_wide"].count() <= 2 * (9 * n // (1024 * XP.WIDE) + 1) and made["rank_targets"].count() == 2


def test_quiet_headers_sort_whole_rows_once(spark):
    from vacfleet.operators import backfill as BF
    i = inputs(spark, SF)
    heads = BF.store(BF.numbered_headers(i.snapshots), "test_heads")
    ticks = BF.moving_ticks(heads, BF.stored_rows(i.samples, heads))
    plan = ticks._jdf.queryExecution().sparkPlan().toString()
    assert heads.filter("_moves").isEmpty()
    assert plan.count("Window [") == 2 and plan.count("lag(_row") == 1
    assert ticks.count() >= i.samples.count()


def test_admission_keeps_clusters_apart_and_honours_long_intervals(spark):
    import datetime as dt

    from vacfleet.operators import admit
    now = dt.datetime(2024, 1, 2)
    sf = admit.VAC_SF
    decisions = spark.createDataFrame(
        [(c, 1, 1, 7, sf, "adjust", "0.05") for c in ("c0", "c1")],
        "cluster_id string, tick_id long, decision_id long, relid long, actuator string, decision string, proposed_value string")
    live = spark.createDataFrame([(c, 7, []) for c in ("c0", "c1")], "cluster_id string, relid long, reloptions array<string>")
    state = spark.createDataFrame([], "cluster_id string, relid long, actuator string, baseline_explicit boolean, current_value string")
    actions = spark.createDataFrame([("c1", 7, 0, "applied", now - dt.timedelta(minutes=30))],
                                    "cluster_id string, relid long, decision_id long, status string, applied_at timestamp_ntz")
    gov = spark.createDataFrame([("c0", "HEALTHY"), ("c1", "HEALTHY")], "cluster_id string, state string")
    out = admit.admit_actions(decisions, live, state, actions, gov, None, clock=F.lit(now)).collect()
    assert sorted((r.cluster_id, r.refusal_reason) for r in out) == [("c0", None), ("c1", "min_interval")]
