"""Hidden-state estimation per control tick (D11 and its parts D11a-e, A21, W8).

One tick joins, per relation, the current state, the previous stored sample, the prior
estimate and the current debt, all keyed by (cluster_id, relid). Current and previous
rows come from one aggregation over the stored samples, or, in the incremental form,
from the cache joined with the rows stored at p (``asof.tick_state``); the header is one
row per cluster (broadcast).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vacfleet import params as P
from vacfleet.functions import exprs as X
from vacfleet.operators import asof, debt
from vacfleet.operators.sequence import previous_row, running

KEY = ["cluster_id", "relid"]
PREV_COLS = ["n_tup_ins", "n_tup_upd", "n_tup_del", "n_dead_tup", "autovacuum_count",
             "reltuples", "relfrozenxid_age"]
PRIOR_COLS = ["churn_rate", "dead_accum_rate", "growth_rate", "f_peak_current",
              "f_trigger_ewma", "effectiveness", "freeze_progressing",
              "saturation_candidate", "saturation_streak"]
ESTIMATE_COLS = [
    "cluster_id", "relid", "snapshot_id", "f_trigger_ewma", "f_peak_current",
    "vacuum_debt_ratio", "analyze_debt_ratio", "freeze_debt", "mxid_freeze_debt",
    "churn_rate", "dead_accum_rate", "growth_rate", "cleanup_per_run", "effectiveness",
    "freeze_progressing", "saturation_cause", "saturation_candidate", "saturation_streak",
]


def empty_prior(spark) -> DataFrame:
    return spark.createDataFrame(
        [], "cluster_id string, relid bigint, churn_rate double, dead_accum_rate double, "
            "growth_rate double, f_peak_current double, f_trigger_ewma double, "
            "effectiveness double, freeze_progressing boolean, "
            "saturation_candidate string, saturation_streak int")


def estimate_calc(samples: DataFrame, snapshots: DataFrame, prior: DataFrame | None,
                  as_of=None, params: P.Params = P.DEFAULT, state: DataFrame | None = None,
                  md: DataFrame | None = None) -> DataFrame:
    """Every intermediate column of one estimate() tick at snapshot p (per cluster).

    ``state`` may carry precomputed current/previous rows (``asof.tick_state`` from the
    cache: the incremental form); by default they come from the stored history. ``md``
    may carry the newest snapshot's debt when the caller computed it once for many ticks.
    """
    tgt = asof.target_snapshot(snapshots, as_of)
    hdr = asof.header_at(snapshots, tgt)
    st = (state if state is not None
          else asof.state_and_previous(samples, snapshots, tgt, prev_cols=PREV_COLS))
    cur = asof.with_live_ages(st, hdr).join(
        F.broadcast(hdr.select("cluster_id", "snapshot_id", "collected_at",
                               "def_mxid_freeze_max_age", "oldest_xmin_owner",
                               "oldest_xmin_age")), ["cluster_id", "snapshot_id"])
    # previous sample's own collection time (its snapshot, not p)
    if "prev_collected_at" not in cur.columns:
        prev_hdr = snapshots.select("cluster_id", F.col("snapshot_id").alias("prev_snapshot_id"),
                                    F.col("collected_at").alias("prev_collected_at"))
        cur = cur.join(prev_hdr, ["cluster_id", "prev_snapshot_id"], "left")
    # debt indicators always come from the newest snapshot (trap 5)
    if md is None:
        md = debt.maintenance_debt(samples, snapshots)
    md = md.select(*KEY, "dead_tuple_fraction", "vacuum_debt_ratio", "analyze_debt_ratio",
                   "freeze_debt")
    pe = (prior if prior is not None else empty_prior(samples.sparkSession)).select(
        *KEY, *[F.col(c).alias(f"pe_{c}") for c in PRIOR_COLS])
    c = cur.join(pe, KEY, "left").join(md, KEY, "left")

    c = tick_inputs(c, params)
    for name, value in advance(F.col, lambda n: F.col(f"pe_{n}"), params):
        c = c.withColumn(name, value)
    return c


def tick_inputs(c: DataFrame, params: P.Params = P.DEFAULT) -> DataFrame:
    """What a tick computes from its current and previous row, header and debt alone (D11a,
    D11b and the samples of D11c-e): nothing here depends on the prior estimate."""
    c = (c.withColumn("boot", F.col("prev_snapshot_id").isNull())
          .withColumn("dt", X.seconds_between("collected_at", "prev_collected_at"))
          .withColumn("d_ins", F.col("n_tup_ins") - F.col("prev_n_tup_ins"))
          .withColumn("d_upd", F.col("n_tup_upd") - F.col("prev_n_tup_upd"))
          .withColumn("d_del", F.col("n_tup_del") - F.col("prev_n_tup_del"))
          .withColumn("d_dead", F.col("n_dead_tup") - F.col("prev_n_dead_tup"))
          .withColumn("d_reltup", F.col("reltuples") - F.col("prev_reltuples")))
    # flags
    c = (c.withColumn("alpha", X.time_alpha("dt", params.ewma_tau))
          .withColumn("reset", ~F.col("boot") & ((F.col("d_ins") < 0) | (F.col("d_upd") < 0)
                                                 | (F.col("d_del") < 0)))
          .withColumn("cycle_boundary", ~F.col("boot") & (F.col("autovacuum_count")
                                                          > F.col("prev_autovacuum_count"))))
    no_rate = F.col("boot") | F.col("reset") | (F.col("dt") <= 0)
    writes = F.col("d_ins") + F.col("d_upd") + F.col("d_del")
    cleaned = F.greatest(F.col("prev_n_dead_tup") - F.col("n_dead_tup"), F.lit(0))
    return (c.withColumn("churn_sample", F.when(~no_rate, writes / F.col("dt")))
             .withColumn("dead_sample", F.when(~no_rate, F.col("d_dead") / F.col("dt")))
             .withColumn("growth_sample", F.when(
                 ~(F.col("boot") | (F.col("dt") <= 0) | (F.col("reltuples") < 0)
                   | (F.col("d_reltup") < 0)), F.col("d_reltup") / F.col("dt")))
             .withColumn("cleanup_per_run", F.when(F.col("cycle_boundary"), cleaned))
             .withColumn("freeze_sample",
                         F.col("relfrozenxid_age") < F.col("prev_relfrozenxid_age"))
             .withColumn("mxid_freeze_debt",
                         X.safe_div("relminmxid_age", "def_mxid_freeze_max_age"))
             .withColumn("av_running", F.col("last_autovacuum").isNotNull()
                         & (F.col("last_autovacuum")
                            > X.minus_seconds("collected_at", params.av_window_s)))
             .withColumn("debt_high", F.coalesce(F.col("vacuum_debt_ratio"), F.lit(0.0)) > 1)
             .withColumn("horizon_pinned", F.col("oldest_xmin_owner").isNotNull()
                         & (F.col("oldest_xmin_owner") != "none")))


#: The columns of ``tick_inputs`` that ``advance`` reads.
STEP_INPUTS = ["alpha", "cycle_boundary", "churn_sample", "dead_sample", "growth_sample",
               "cleanup_per_run", "freeze_sample", "dead_tuple_fraction", "av_running",
               "debt_high", "horizon_pinned"]


def advance(now, prior, params: P.Params = P.DEFAULT) -> list[tuple[str, Column]]:
    """One step of the state machine (D11c-e) as (name, value) pairs: ``now(name)`` gives a
    column of ``tick_inputs``, ``prior(name)`` one of the prior estimate. The same step
    serves a single tick (columns) and the backfill's fold (struct fields)."""
    cb, effa = now("cycle_boundary"), F.lit(params.ewma_effa)
    eff = F.when(cb, X.ewma(prior("effectiveness"),
                            F.when(now("cleanup_per_run") > 0, F.lit(1.0)).otherwise(F.lit(0.0)),
                            effa)).otherwise(prior("effectiveness"))
    eff_low = F.coalesce(eff, F.lit(1.0)) < params.eff_low
    dh, avr = now("debt_high"), now("av_running")
    cand = (F.when(dh & ~avr, F.lit("config"))
            .when(dh & avr & eff_low & now("horizon_pinned"), F.lit("inhibited"))
            .when(dh & avr, F.lit("io_limited")))
    streak = (F.when(cand.isNull(), F.lit(0))
              .when(cand.eqNullSafe(prior("saturation_candidate")),
                    prior("saturation_streak") + 1)
              .otherwise(F.lit(1))).cast("int")
    peak, fraction = prior("f_peak_current"), now("dead_tuple_fraction")
    return [
        ("churn_rate", X.ewma(prior("churn_rate"), now("churn_sample"), now("alpha"))),
        ("dead_accum_rate", X.ewma(prior("dead_accum_rate"), now("dead_sample"), now("alpha"))),
        ("growth_rate", X.ewma(prior("growth_rate"), now("growth_sample"), now("alpha"))),
        ("f_peak_current", F.when(cb | peak.isNull(), fraction)
         .otherwise(F.greatest(peak, fraction))),
        ("f_trigger_ewma", F.when(cb, X.ewma(prior("f_trigger_ewma"), peak, effa))
         .otherwise(prior("f_trigger_ewma"))),
        ("effectiveness", eff),
        ("freeze_progressing", F.when(cb, now("freeze_sample"))
         .otherwise(prior("freeze_progressing"))),
        ("eff_low", eff_low),
        ("saturation_candidate", cand),
        ("saturation_streak", streak),
        ("saturation_cause", F.when(streak >= params.saturation_k, cand)),
    ]


def estimate_tick(samples: DataFrame, snapshots: DataFrame, prior: DataFrame | None,
                  as_of=None, params: P.Params = P.DEFAULT, state: DataFrame | None = None,
                  md: DataFrame | None = None) -> DataFrame:
    """The new relation_estimate rows (one per relation in the snapshot)."""
    return estimate_calc(samples, snapshots, prior, as_of, params, state, md).select(*ESTIMATE_COLS)


def burstiness(samples: DataFrame) -> DataFrame:
    """Stddev / mean of the gaps between consecutive maintenance runs per relation
    (distinct last_autovacuum instants in time order), found month by month with a carry."""
    runs = samples.filter(F.col("last_autovacuum").isNotNull()).select(
        *KEY, "last_autovacuum").distinct()
    gaps = previous_row(runs, KEY, ["last_autovacuum"], X.epoch_month("last_autovacuum"), ["last_autovacuum"])
    gaps = gaps.withColumn("gap", X.seconds_between(
        "last_autovacuum", "prev_last_autovacuum")).filter(F.col("gap").isNotNull())
    g = gaps.groupBy(*KEY).agg(F.count("*").alias("n_gaps"),
                               F.avg("gap").alias("mean_gap_s"),
                               F.stddev_samp("gap").alias("sd_gap_s"))
    return g.withColumn("burstiness", X.safe_div("sd_gap_s", "mean_gap_s"))


def maintenance_lag(debt_series: DataFrame) -> DataFrame:
    """Per relation and snapshot, seconds since the vacuum debt ratio first crossed 1
    after the most recent maintenance run (gaps and islands over the debt series).

    ``debt_series`` has KEY, snapshot_id, collected_day, collected_at, vacuum_debt_ratio,
    last_autovacuum. The first crossing is a running minimum carried from day to day, so a
    task holds one relation's day.
    """
    over = F.col("vacuum_debt_ratio") > 1
    d = running(debt_series, [*KEY, "last_autovacuum"], ["snapshot_id"], F.col("collected_day"),
                {"_first_cross": ("min", F.when(over, F.col("collected_at")))})
    return d.select(
        *KEY, "snapshot_id", "vacuum_debt_ratio",
        F.when(over, X.seconds_between("collected_at", "_first_cross")).alias("maintenance_lag_s"))
