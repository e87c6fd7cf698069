"""Workload classification with a signal floor and N-cycle hysteresis."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vacfleet import params as P
from vacfleet.functions import exprs as X
from vacfleet.operators import asof
from vacfleet.operators.sequence import first_within

KEY = ["cluster_id", "relid"]
CLASS_COLS = ["cluster_id", "relid", "schemaname", "relname", "kind", "source", "candidate",
              "candidate_streak"]


def active_policy(policy: DataFrame) -> DataFrame:
    """Per cluster the first enabled policy by name (one row per cluster)."""
    cols = [c for c in policy.columns if c != "cluster_id"]
    g = (policy.filter(F.col("enabled")).groupBy("cluster_id")
         .agg(F.min_by(F.struct(*cols), "policy_name").alias("_p")))
    return g.select("cluster_id", *[F.col("_p").getField(c).alias(c) for c in cols])


def empty_classes(spark) -> DataFrame:
    return spark.createDataFrame(
        [], "cluster_id string, relid bigint, schemaname string, relname string, "
            "kind string, source string, candidate string, candidate_streak int")


def rule_kind(din: Column, dupd: Column, ddel: Column, params: P.Params = P.DEFAULT) -> Column:
    """Class from the write mix, NULL below the signal floor (>= max(floor, 1))."""
    total = din + dupd + ddel
    fi, fu, fd = (din.cast("double") / total, dupd.cast("double") / total,
                  ddel.cast("double") / total)
    floor = max(params.classify_floor, 1)
    return F.when(total >= floor,
                  F.when((fi > params.ins_frac) & (fd < params.aodel_frac), F.lit("append_only"))
                  .when((fd > params.del_frac) & (F.abs(fd - fi) < params.bal_frac), F.lit("queue"))
                  .when(fd > params.del_frac, F.lit("delete_heavy"))
                  .when(fu > params.del_frac, F.lit("oltp"))
                  .otherwise(F.lit("mixed")))


PREV_COLS = ["n_tup_ins", "n_tup_upd", "n_tup_del"]


def classify_calc(samples: DataFrame, snapshots: DataFrame, prior: DataFrame | None,
                  policy: DataFrame | None, as_of=None, params: P.Params = P.DEFAULT,
                  state: DataFrame | None = None) -> DataFrame:
    """All columns of one classify() tick; ``state`` as in ``estimate_calc``."""
    tgt = asof.target_snapshot(snapshots, as_of)
    st = (state if state is not None
          else asof.state_and_previous(samples, snapshots, tgt, prev_cols=PREV_COLS))
    rcp = (prior if prior is not None else empty_classes(samples.sparkSession)).select(
        *KEY, F.col("kind").alias("cur_kind"), F.col("source").alias("cur_source"),
        F.col("candidate").alias("cur_cand"), F.col("candidate_streak").alias("cur_streak"))
    c = st.join(rcp, KEY, "left")
    if policy is not None:
        pol = active_policy(policy).select("cluster_id", "n_sustain")
        c = c.join(F.broadcast(pol), "cluster_id", "left")
    else:
        c = c.withColumn("n_sustain", F.lit(None).cast("int"))
    c = tick_inputs(c.withColumn("nsus", F.coalesce(F.col("n_sustain"), F.lit(params.n_sustain))),
                    params)
    prior_name = {"kind": "cur_kind", "source": "cur_source", "candidate": "cur_cand",
                  "candidate_streak": "cur_streak"}
    for name, value in advance(F.col, lambda n: F.col(prior_name[n])):
        c = c.withColumn(name, value)
    return c


def tick_inputs(c: DataFrame, params: P.Params = P.DEFAULT) -> DataFrame:
    """What a tick computes from its current and previous row alone: the write mix, the
    class it shows (NULL below the floor) and the class of a relation that never wrote."""
    c = (c.withColumn("din", F.greatest(F.col("n_tup_ins") - F.col("prev_n_tup_ins"), F.lit(0)))
          .withColumn("dupd", F.greatest(F.col("n_tup_upd") - F.col("prev_n_tup_upd"), F.lit(0)))
          .withColumn("ddel", F.greatest(F.col("n_tup_del") - F.col("prev_n_tup_del"), F.lit(0)))
          .withColumn("total", F.col("din") + F.col("dupd") + F.col("ddel")))
    return (c.withColumn("rule_kind", rule_kind(F.col("din"), F.col("dupd"), F.col("ddel"), params))
             .withColumn("idle_kind", F.when(F.col("reltuples") > params.classify_large,
                                             F.lit("archive")).otherwise(F.lit("mixed"))))


#: The columns that ``advance`` reads.
STEP_INPUTS = ["rule_kind", "idle_kind", "nsus"]


def advance(now, prior) -> list[tuple[str, Column]]:
    """One step of the hysteresis as (name, value) pairs; ``now`` and ``prior`` as in the
    estimate's ``advance``."""
    cur_kind, cur_cand, cur_streak = prior("kind"), prior("candidate"), prior("candidate_streak")
    target = F.coalesce(now("rule_kind"), cur_kind, now("idle_kind"))
    new, manual = cur_kind.isNull(), prior("source") == "manual"
    agrees = target == cur_kind
    same_cand = target.eqNullSafe(cur_cand)
    commit = same_cand & (cur_streak + 1 >= now("nsus"))
    kind = (F.when(new, target).when(manual, cur_kind).when(agrees, cur_kind)
            .when(commit, target).otherwise(cur_kind))
    cand = (F.when(new, F.lit(None)).when(manual, cur_cand).when(agrees, F.lit(None))
            .when(commit, F.lit(None)).otherwise(target))
    streak = (F.when(new, F.lit(0)).when(manual, cur_streak).when(agrees, F.lit(0))
              .when(commit, F.lit(0)).when(same_cand, cur_streak + 1).otherwise(F.lit(1)))
    return [("kind", kind), ("source", F.coalesce(prior("source"), F.lit("auto"))),
            ("candidate", cand.cast("string")), ("candidate_streak", streak.cast("int"))]


def classify_tick(samples, snapshots, prior, policy, as_of=None, params=P.DEFAULT,
                  state=None) -> DataFrame:
    """The new relation_class rows."""
    return classify_calc(samples, snapshots, prior, policy, as_of, params, state).select(*CLASS_COLS)


def write_mix(calc: DataFrame) -> DataFrame:
    """Write-mix deltas and fractions behind the rule (fractions only above the floor)."""
    t = F.col("total")
    above = F.col("rule_kind").isNotNull()
    return calc.select(*KEY, "din", "dupd", "ddel", "total",
                       F.when(above, F.col("din") / t).alias("ins_frac"),
                       F.when(above, F.col("dupd") / t).alias("upd_frac"),
                       F.when(above, F.col("ddel") / t).alias("del_frac"), "rule_kind")


def classify_trailing(samples: DataFrame, snapshots: DataFrame, window_s: int,
                      min_rate: float = 0.0, params: P.Params = P.DEFAULT) -> DataFrame:
    """Per sample, the write mix over a trailing time window (a range frame over
    collection time) classified by the same rule, plus the window's write rate.

    Counters are cumulative, so the window's writes are the difference between the
    current sample and the oldest sample inside the window (``sequence.first_within``: a task
    sorts two windows of a relation, not its history).
    """
    hdr = snapshots.select("cluster_id", "snapshot_id", "collected_at")
    s = (samples.select(*KEY, "snapshot_id", *PREV_COLS).join(hdr, ["cluster_id", "snapshot_id"])
         .withColumn("_t", F.floor(X.epoch_seconds("collected_at")).cast("long")).drop("collected_at"))
    s = first_within(s, KEY, "_t", "snapshot_id", int(window_s), PREV_COLS)
    din = F.greatest(F.col("n_tup_ins") - F.col("first_n_tup_ins"), F.lit(0))
    dupd = F.greatest(F.col("n_tup_upd") - F.col("first_n_tup_upd"), F.lit(0))
    ddel = F.greatest(F.col("n_tup_del") - F.col("first_n_tup_del"), F.lit(0))
    out = s.select(*KEY, "snapshot_id", din.alias("din"), dupd.alias("dupd"), ddel.alias("ddel"))
    out = out.withColumn("write_rate", (F.col("din") + F.col("dupd") + F.col("ddel"))
                         / F.lit(float(window_s)))
    return out.withColumn(
        "trailing_kind",
        F.when(F.col("write_rate") >= min_rate,
               rule_kind(F.col("din"), F.col("dupd"), F.col("ddel"), params)))
