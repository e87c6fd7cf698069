"""The control state over a whole history: estimate (D11) and classify (D12) as one fold.

A control loop runs one tick a snapshot and carries each relation's state from tick to tick since the
relation was first stored. Most of these ticks are quiet: the relation has no new row, so its current
and previous row are the same stored one and every delta is 0. A run of quiet ticks has a closed form:

* A rate with sample 0 is multiplied by exp(-dt / tau) at each tick, dt being the time since the stored
  row. Over the m ticks between two headers that is one factor, exp(-(S - m t) / tau), with S the sum
  of the headers' times (a prefix sum over the cluster's headers) and t the stored row's time.
* Nothing else of the estimate moves but the saturation streak, which grows by m while its candidate
  stays; a class candidate is given up, as a quiet tick agrees with the class.

So only *moving* ticks are folded one by one: those at stored rows; those within the window in which
the row's maintenance run counts as running (its end changes the candidate); those at headers whose
default thresholds differ from the header's before (debt may cross 1); and those at headers whose clock
runs behind an earlier one. Their number follows the stored rows, not relations times snapshots.

The fold goes through the history in chunks of ``chunk_days`` days, so that no task holds more of a
relation than one chunk's moving ticks. The state says at which header it stands; a relation without a
moving tick in a chunk is carried over untouched, and settled to the last header at the end.

Debt is that of each tick's own snapshot, as a live loop sees it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vacfleet import params as P
from vacfleet.functions import exprs as X
from vacfleet.operators import classify as CL
from vacfleet.operators import debt
from vacfleet.operators import estimate as EST
from vacfleet.operators.sequence import previous_row, running
from vacfleet.session import store

KEY = ["cluster_id", "relid"]
#: Columns of a stored row that a tick reads.
ROW_COLS = ["schemaname", "relname", "n_dead_tup", "n_mod_since_analyze", "n_tup_ins",
            "n_tup_upd", "n_tup_del", "last_autovacuum", "autovacuum_count", "reltuples",
            "relfrozenxid_age", "relminmxid_age", "relfrozenxid", "relminmxid", "reloptions"]
#: Columns of a header that a tick reads.
HEADER_COLS = ["collected_at", "current_xid", "current_mxid",
               "def_vac_threshold", "def_vac_scale_factor", "def_ana_threshold",
               "def_ana_scale_factor", "def_freeze_max_age", "def_mxid_freeze_max_age",
               "oldest_xmin_owner", "oldest_xmin_owner_detail", "oldest_xmin_age"]
#: Header defaults on which the vacuum debt depends.
DEBT_DEFAULTS = ["def_vac_threshold", "def_vac_scale_factor"]
#: What a tick carries to the next: the estimate's part, then the class's.
FIELDS = [("churn_rate", "double"), ("dead_accum_rate", "double"), ("growth_rate", "double"),
          ("f_peak_current", "double"), ("f_trigger_ewma", "double"), ("effectiveness", "double"),
          ("freeze_progressing", "boolean"), ("saturation_candidate", "string"),
          ("saturation_streak", "int"), ("kind", "string"), ("source", "string"),
          ("candidate", "string"), ("candidate_streak", "int")]
_SUM = "decimal(38,0)"
#: Where the state stands: its tick's header number and the headers' times up to it (microseconds),
#: the stored row's time, which rates a quiet tick samples, and whether debt is high.
PLACE = [("_n", "bigint"), ("_sum", _SUM), ("_row_us", "bigint"), ("_writes", "boolean"),
         ("_dead", "boolean"), ("_grows", "boolean"), ("_debt_high", "boolean")]
#: Where a cluster's headers end.
CARRY = [("_last", "bigint"), ("_n", "bigint"), ("_sum", _SUM), ("_latest", "bigint"),
         ("_def_vac_threshold", "bigint"), ("_def_vac_scale_factor", "double")]
STATE_SCHEMA = ("cluster_id string, relid bigint, schemaname string, relname string, "
                f"_state struct<{', '.join(f'{n}: {t}' for n, t in FIELDS + PLACE)}>")


def numbered_headers(snapshots: DataFrame, carry: DataFrame | None = None) -> DataFrame:
    """Headers with their number in the cluster (``_n``), the sum of times up to each (``_sum``, and
    ``_before`` without its own), and whether every relation moves there (``_moves``). ``carry``
    (``header_carry``) says where each cluster's earlier headers ended; headers not beyond them, which
    came late or again, are left out."""
    us = F.unix_micros(X.as_ts("collected_at"))
    h = snapshots.select("cluster_id", "snapshot_id", "collected_day", *HEADER_COLS, us.alias("_us"))
    old = [F.lit(None).cast(t).alias(f"_o{n}") for n, t in CARRY]
    if carry is None:
        h = h.select("*", *old)
    else:    # one row per cluster
        names = carry.select("cluster_id", *[F.col(n).alias(f"_o{n}") for n, _ in CARRY])
        h = h.join(F.broadcast(names), "cluster_id", "left").filter(
            F.col("_o_last").isNull() | (F.col("snapshot_id") > F.col("_o_last")))
    day, order = F.col("collected_day"), ["snapshot_id"]
    h = running(h, ["cluster_id"], order, day, {
        "_n": ("sum", F.lit(1).cast("bigint")), "_sum": ("sum", F.col("_us").cast(_SUM)), "_latest": ("max", F.col("_us"))})
    h = previous_row(h, ["cluster_id"], order, day, DEBT_DEFAULTS)
    new = F.lit(False)
    for c in DEBT_DEFAULTS:
        new = new | ~F.col(c).eqNullSafe(F.when(F.col("prev_exists"), F.col(f"prev_{c}")).otherwise(F.col(f"_o_{c}")))
    known = F.col("prev_exists") | F.col("_o_last").isNotNull()
    latest = F.greatest("_latest", "_o_latest")
    return (h.withColumn("_n", F.col("_n") + F.coalesce("_o_n", F.lit(0)))
            .withColumn("_sum", (F.col("_sum") + F.coalesce("_o_sum", F.lit(0))).cast(_SUM))
            .withColumn("_before", (F.col("_sum") - F.col("_us")).cast(_SUM))
            .withColumn("_moves", (known & new) | (F.col("_us") < latest)).withColumn("_latest", latest)
            .drop("prev_exists", *[f"prev_{c}" for c in DEBT_DEFAULTS], *[f"_o{n}" for n, _ in CARRY]))


def header_carry(heads: DataFrame, carry: DataFrame | None = None) -> DataFrame:
    """Where each cluster's numbered headers end; clusters without one keep their ``carry``."""
    end = heads.groupBy("cluster_id").agg(
        F.max("snapshot_id").alias("_last"), F.max("_n").alias("_n"), F.max("_sum").alias("_sum"), F.max("_latest").alias("_latest"),
        *[F.max_by(c, "_n").alias(f"_{c}") for c in DEBT_DEFAULTS])
    if carry is None:
        return end
    return end.unionByName(carry.join(end.select("cluster_id"), "cluster_id", "left_anti"))


def moving_ticks(heads: DataFrame, rows: DataFrame, params: P.Params = P.DEFAULT) -> DataFrame:
    """The ticks of a chunk that are folded one by one.

    ``heads`` are the chunk's numbered headers. ``rows`` (KEY, _n, _row) are the rows stored in it and
    each relation's newest row from before it, whose ``_n`` is below the chunk's. One row a tick: KEY,
    the header's columns, ``_cur`` and ``_prev`` (null at a relation's first row).
    """
    w = W.partitionBy(*KEY).orderBy("_n")        # one chunk's stored rows of a relation
    at_rows = (rows.withColumn("_prev", F.lag("_row").over(w))
               .select(*KEY, "_n", F.col("_row").alias("_cur"), "_prev").join(heads, ["cluster_id", "_n"]))
    # after a row, while its maintenance run counts as running: buckets of that window's length.
    # Whole rows are sorted only where the window reaches beyond the row
    span = int(params.av_window_s) * 1_000_000
    run_us = F.unix_micros(X.as_ts(F.col("_row.last_autovacuum")))
    from_us = F.unix_micros(X.as_ts(F.col("_row.collected_at")))
    bucket = lambda us: F.floor(us / span)
    running_rows = (rows.select(*KEY, "_n", F.when(run_us + span > from_us, F.col("_row")).alias("_row"))
                    .withColumn("_next", F.lead("_n").over(w)).filter(F.col("_row").isNotNull())
                    .withColumn("_b", F.explode(F.sequence(bucket(from_us), bucket(run_us + span)))))
    after = F.col("h._n") > F.col("s._n")
    before_next = F.col("s._next").isNull() | (F.col("h._n") < F.col("s._next"))
    alive = running_rows.alias("s").join(
        heads.withColumn("_b", bucket(F.col("_us"))).alias("h"),
        (F.col("s.cluster_id") == F.col("h.cluster_id")) & (F.col("s._b") == F.col("h._b")) & after & before_next
        & ~F.col("h._moves") & (F.col("s._row.last_autovacuum") > X.minus_seconds(F.col("h.collected_at"), params.av_window_s)))
    out = [F.col(f"s.{k}") for k in KEY] + [F.col(f"h.{c}") for c in heads.columns if c != "cluster_id"]
    quiet = [F.col("s._row").alias("_cur"), F.col("s._row").alias("_prev")]
    ticks = at_rows.unionByName(alive.select(*out, *quiet))
    # headers at which every relation moves: few, or the settings would change all the time
    moves = heads.filter("_moves")
    if moves.isEmpty():
        return ticks
    moved = rows.withColumn("_next", F.lead("_n").over(w)).alias("s").join(
        moves.alias("h"), (F.col("s.cluster_id") == F.col("h.cluster_id")) & after & before_next)
    return ticks.unionByName(moved.select(*out, *quiet))


def control_state(samples: DataFrame, snapshots: DataFrame, policy: DataFrame | None,
                  before: DataFrame | None = None, params: P.Params = P.DEFAULT,
                  chunk_days: int = 7) -> DataFrame:
    """The state after the last tick, or after the last one before each cluster's snapshot
    in ``before`` (cluster_id, _p): one row per relation with the columns of ``FIELDS``.
    Rows stored without a snapshot header are at no tick. An empty history gives an empty
    state. ``chunk_days`` bounds what one task holds of a relation."""
    spark = samples.sparkSession
    if before is not None:
        snapshots = snapshots.join(F.broadcast(before), "cluster_id").filter(
            F.col("snapshot_id") < F.col("_p")).drop("_p")
    heads = store(numbered_headers(snapshots), "control_headers")
    lo, hi = heads.agg(F.min("collected_day"), F.max("collected_day")).first()
    state, cache = spark.createDataFrame([], STATE_SCHEMA), None
    for day in range(lo, hi + 1, chunk_days) if lo is not None else ():
        in_chunk = F.col("collected_day").between(day, min(hi, day + chunk_days - 1))
        now = heads.filter(in_chunk)
        rows = stored_rows(samples.filter(in_chunk), now)
        rows = rows if cache is None else store(cache.unionByName(rows), "control_rows")
        ticks = tick_table(moving_ticks(now, rows, params), policy, params)
        state = store(advance(ticks, state, params), "control_state")
        cache = store(newest_rows(rows), "control_cache")
    return settled(state, header_carry(heads), params).select(
        *KEY, "schemaname", "relname", *[F.col("_state").getField(n).alias(n) for n, _ in FIELDS])


def stored_rows(samples: DataFrame, heads: DataFrame) -> DataFrame:
    """The rows (KEY, _n, _row) stored at some numbered headers."""
    ids = heads.select("cluster_id", "snapshot_id", "_n", "collected_at")
    return (samples.join(ids, ["cluster_id", "snapshot_id"])
            .select(*KEY, "_n", F.struct("collected_at", *ROW_COLS).alias("_row")))


def newest_rows(rows: DataFrame) -> DataFrame:
    """Each relation's newest row."""
    return (rows.groupBy(*KEY).agg(F.max_by("_row", "_n").alias("_row"), F.max("_n").alias("_n"))
            .select(*KEY, "_n", "_row"))


def tick_table(ticks: DataFrame, policy: DataFrame | None, params: P.Params = P.DEFAULT) -> DataFrame:
    """What ticks compute from their rows, header and policy alone."""
    t = ticks.select(*KEY, "_n", "_sum", "_before", "snapshot_id", *HEADER_COLS, *[F.col("_cur").getField(c).alias(c) for c in ROW_COLS],
                     F.unix_micros(X.as_ts(F.col("_cur.collected_at"))).alias("_row_us"),
                     F.when(F.col("_prev").isNotNull(), F.lit(0)).alias("prev_snapshot_id"),
                     F.col("_prev").getField("collected_at").alias("prev_collected_at"),
                     *[F.col("_prev").getField(c).alias(f"prev_{c}") for c in EST.PREV_COLS])
    t = (t.withColumn("relfrozenxid_age",
                      X.live_xid_age("relfrozenxid", "current_xid", "relfrozenxid_age"))
          .withColumn("relminmxid_age",
                      X.live_xid_age("relminmxid", "current_mxid", "relminmxid_age")))
    if policy is not None:
        t = t.join(F.broadcast(CL.active_policy(policy).select("cluster_id", "n_sustain")),
                   "cluster_id", "left")
    else:
        t = t.withColumn("n_sustain", F.lit(None).cast("int"))
    t = t.withColumn("nsus", F.coalesce(F.col("n_sustain"), F.lit(params.n_sustain)))
    t = CL.tick_inputs(EST.tick_inputs(debt.debt_columns(t), params), params)
    writes = F.col("n_tup_ins").isNotNull() & F.col("n_tup_upd").isNotNull() & F.col("n_tup_del").isNotNull()
    return (t.withColumn("_writes", writes).withColumn("_dead", writes & F.col("n_dead_tup").isNotNull())
            .withColumn("_grows", F.coalesce(F.col("reltuples") >= 0, F.lit(False))))


def advance(ticks: DataFrame, state: DataFrame, params: P.Params = P.DEFAULT) -> DataFrame:
    """The state after some ticks (``tick_table``); relations without one keep theirs."""
    per = ticks.groupBy(*KEY).agg(
        F.max_by("schemaname", "_n").alias("_schema"), F.max_by("relname", "_n").alias("_name"),
        F.array_sort(F.collect_list(F.struct("_n", "_sum", "_before", "_row_us", "_writes", "_dead", "_grows",
                                             *EST.STEP_INPUTS, *CL.STEP_INPUTS))).alias("_ticks"))
    j = state.withColumnRenamed("_state", "_old").join(per, KEY, "full_outer")
    return j.select(*KEY, F.coalesce("_schema", "schemaname").alias("schemaname"), F.coalesce("_name", "relname").alias("relname"),
                    F.when(F.col("_ticks").isNull(), F.col("_old")).otherwise(_fold(params)).alias("_state"))


def settled(state: DataFrame, carry: DataFrame, params: P.Params = P.DEFAULT) -> DataFrame:
    """The state after each cluster's last header (``carry``: one row per cluster)."""
    end = F.broadcast(carry.select("cluster_id", F.col("_n").alias("_end"), F.col("_sum").alias("_end_sum")))
    return state.join(end, "cluster_id").select(
        *KEY, "schemaname", "relname", settle(F.col("_state"), F.col("_end"), F.col("_end_sum"), params).alias("_state"))


def estimates(ticks: DataFrame, state: DataFrame, params: P.Params = P.DEFAULT) -> DataFrame:
    """The estimate rows (D11) of ticks at one header a cluster, from the state before them."""
    t = ticks.join(state.select(*KEY, F.col("_state").alias("_old")), KEY, "left")
    t = t.withColumn("_old", settle(F.col("_old"), F.col("_n") - 1, F.col("_before"), params))
    for name, value in EST.advance(F.col, F.col("_old").getField, params):
        t = t.withColumn(name, value)
    return t.select(*EST.ESTIMATE_COLS)


def _struct(values: dict[str, Column]) -> Column:
    return F.struct(*[values[n].cast(t).alias(n) for n, t in FIELDS + PLACE])


def _wait(get, n: Column, total: Column) -> tuple[Column, Column]:
    """The quiet ticks up to header ``n`` that follow a state standing at ``get``, and the seconds that
    they wait in all since the stored row; ``total`` is the sum of times up to that header."""
    m = n - get("_n")
    return m, (total - get("_sum") - (m.cast("decimal(18,0)") * get("_row_us").cast("decimal(19,0)"))).cast("double") / 1e6


def _after_quiet(get, m: Column, waits: Column, keep: Column) -> dict[str, Column]:
    """The fields of ``FIELDS`` after ``m`` quiet ticks: rates are multiplied by ``keep`` if time passes."""
    def decayed(rate: str, sampled: str) -> Column:
        # a rate without a value takes the first sample, 0
        return F.when(get(sampled) & waits, F.coalesce(get(rate) * keep, F.lit(0.0))).otherwise(get(rate))

    cand = F.when(get("_debt_high"), F.lit("config"))    # nothing runs in a quiet tick
    streak = (F.when(cand.isNull(), F.lit(0)).when(cand.eqNullSafe(get("saturation_candidate")), get("saturation_streak") + m)
              .otherwise(m))
    manual = F.coalesce(get("source") == "manual", F.lit(False))
    return {name: get(name) for name, _ in FIELDS} | {
        "churn_rate": decayed("churn_rate", "_writes"), "dead_accum_rate": decayed("dead_accum_rate", "_dead"),
        "growth_rate": decayed("growth_rate", "_grows"), "saturation_candidate": cand, "saturation_streak": streak,
        "candidate": F.when(manual, get("candidate")),
        "candidate_streak": F.when(manual, get("candidate_streak")).otherwise(F.lit(0))}


def _keep(waited: Column, params: P.Params) -> Column:
    return F.exp(-waited / F.lit(float(params.ewma_tau)))


def settle(state: Column, n: Column, total: Column, params: P.Params = P.DEFAULT) -> Column:
    """The state after the quiet ticks that follow it, up to header ``n``; ``total`` is the sum of
    times up to that header. No quiet tick (or no state): as it was."""
    get = state.getField
    m, waited = _wait(get, n, total)
    after = {name: get(name) for name, _ in PLACE} | _after_quiet(get, m, waited > 0, _keep(waited, params)) | {"_n": n, "_sum": total}
    return F.when(m > 0, _struct(after)).otherwise(state)


def _fold(params: P.Params) -> Column:
    """The state after ``_ticks``, from ``_old`` (null: a relation without a state): before each
    moving tick the quiet ones between are settled. A state stands where its last tick stood, so
    the wait before each tick is found once from its neighbour and not in the fold."""
    old = {n: F.col("_old").getField(n) for n, _ in FIELDS + PLACE}

    def placed(tick: Column, i: Column) -> Column:
        earlier = F.get("_ticks", i - 1)
        m, waited = _wait(lambda n: F.when(i > 0, earlier.getField(n)).otherwise(old[n]),
                          tick.getField("_n") - 1, tick.getField("_before"))
        return F.struct(tick.alias("tick"), m.alias("m"), waited.alias("waited"))

    def step(state, at):
        # two steps in one: a lambda has no names, so the settled fields pass through a small array
        tick, m, get = at.getField("tick"), at.getField("m"), state.getField
        quiet = _after_quiet(get, m, at.getField("waits"), at.getField("keep"))
        fields = F.when(m > 0, F.struct(*[quiet[n].cast(t).alias(n) for n, t in FIELDS])).otherwise(
            F.struct(*[get(n).alias(n) for n, _ in FIELDS]))
        return F.element_at(F.transform(F.array(fields), lambda now: _struct(
            dict(EST.advance(tick.getField, now.getField, params) + CL.advance(tick.getField, now.getField))
            | {n: tick.getField(n) for n, _ in PLACE if n != "_debt_high"}
            | {"_debt_high": tick.getField("debt_high")})), 1)

    waits = F.transform(F.transform("_ticks", placed), lambda x: F.struct(
        x.getField("tick").alias("tick"), x.getField("m").alias("m"), (x.getField("waited") > 0).alias("waits"),
        _keep(x.getField("waited"), params).alias("keep")))
    return F.aggregate(waits, _struct(old), step)
