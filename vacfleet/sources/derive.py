"""Stand-in inputs: map the driver's test tables onto the telemetry shapes.

These functions only produce rows in the schemas the operators expect (FIXTURES.md
section 6). They do none of the operators' work; every operator is written for any
data of its input schema.

Aggregations here are keyed by (entity, hour) and pre-combined map-side, so the
derivation itself scales with the event table without a per-entity sort of raw rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vacfleet import params as P
from vacfleet.functions import exprs as X

#: The stand-in fleet: rows of a table go to a cluster by the remainder of their key, so that the same
#: relation ids stand in all of them. The supplier-derived policies have clusters of these names.
CLUSTERS = 3
HOUR_US = 3_600_000_000
#: First days of the order dates and of the events, in microseconds.
_ORDERS_FROM_US, _EVENTS_FROM_US = 694_224_000_000_000, 1_704_067_200_000_000

# FIXED VALUES of the stand-in cluster's settings (PostgreSQL defaults).
DEFAULTS = {
    "server_version_num": 170000,
    "def_vac_scale_factor": 0.2,
    "def_vac_threshold": 50,
    "def_ana_scale_factor": 0.1,
    "def_ana_threshold": 50,
    "def_vac_cost_limit": 200,
    "def_vac_cost_delay": 2.0,
    "def_freeze_max_age": 200000000,
    "def_mxid_freeze_max_age": 400000000,
    "autovacuum_max_workers": 3,
    "max_connections": 100,
}
GRID_TEXT = ["0.005", "0.01", "0.02", "0.05", "0.1", "0.2", "0.3", "0.5"]


def cluster_of(key: str):
    return F.concat(F.lit("n"), F.pmod(F.col(key), F.lit(CLUSTERS)).cast("string"))


def on_telemetry_clock(df: DataFrame, column: str, *after: str) -> DataFrame:
    """Map a time of the order-derived tables (from 1992 on) onto the telemetry's month (from 2024 on):
    80 days become one. Times in ``after`` keep their distance from it."""
    us = X.epoch_micros(column) - F.lit(_ORDERS_FROM_US)
    at = X.as_ntz(F.timestamp_micros(F.lit(_EVENTS_FROM_US) + F.floor(us / 80).cast("long")))
    moved = {c: at + (F.col(c) - F.col(column)) for c in after}
    return df.withColumns({**moved, column: at})


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _hour_ts(snapshot_id):
    """End of the hour ``snapshot_id`` (hours since 1970) as TIMESTAMP_NTZ."""
    return X.as_ntz(F.timestamp_micros((snapshot_id + 1) * F.lit(HOUR_US)))


def relation_samples(events: DataFrame) -> DataFrame:
    """Sparse per-relation samples: one row per (user, hour) in which the user had events.

    Counters are cumulative to the end of the hour: purchase -> inserts, view/click ->
    updates, signup -> deletes, error -> an autovacuum run (its time -> last_autovacuum);
    dead tuples are the updates+deletes since the last autovacuum.
    """
    e = events.select(
        cluster_of("event_id").alias("cluster_id"), F.col("user_id").alias("relid"), "ts", "event_type",
        F.floor(X.epoch_micros("ts") / F.lit(HOUR_US)).cast("long").alias("snapshot_id"))
    is_ud = F.col("event_type").isin("view", "click", "signup")
    # the hour's last error first, then one counting pass keyed by (relation, hour):
    # both sides are partitioned on that key, so the join adds no shuffle to the count
    last_err = (e.filter(F.col("event_type") == "error").groupBy("cluster_id", "relid", "snapshot_id")
                .agg(F.max("ts").alias("h_last_err")))
    per_hour = e.join(last_err, ["cluster_id", "relid", "snapshot_id"], "left").groupBy("cluster_id", "relid", "snapshot_id").agg(
        F.count_if(F.col("event_type") == "purchase").alias("h_ins"),
        F.count_if(F.col("event_type").isin("view", "click")).alias("h_upd"),
        F.count_if(F.col("event_type") == "signup").alias("h_del"),
        F.count_if(F.col("event_type") == "error").alias("h_err"),
        F.max("h_last_err").alias("h_last_err"),
        # updates/deletes after the hour's last error (all of them if the hour had none)
        F.count_if(is_ud & (F.col("h_last_err").isNull() | (F.col("ts") > F.col("h_last_err"))))
         .alias("h_ud_after"))
    w = (W.partitionBy("cluster_id", "relid").orderBy("snapshot_id")
         .rowsBetween(W.unboundedPreceding, W.currentRow))
    c = (per_hour
         .withColumn("ins", F.sum("h_ins").over(w))
         .withColumn("upd", F.sum("h_upd").over(w))
         .withColumn("del", F.sum("h_del").over(w))
         .withColumn("avc", F.sum("h_err").over(w))
         .withColumn("last_av", F.max("h_last_err").over(w))
         .withColumn("ud", F.col("upd") + F.col("del"))
         # cumulative upd+del at the moment of the hour's last error (non-decreasing)
         .withColumn("base", F.when(F.col("h_err") > 0, F.col("ud") - F.col("h_ud_after")))
         .withColumn("dead", F.col("ud") - F.coalesce(F.max("base").over(w), F.lit(0))))
    live = F.lit(1000) + F.col("ins") - F.col("del")
    relpages = F.floor(live / 10).cast("int")
    collected_at = _hour_ts(F.col("snapshot_id"))
    day = X.epoch_day(collected_at)
    rid = F.col("relid")
    reloptions = (F.when(F.pmod(rid, F.lit(5)) == 0,
                         F.array(F.lit("autovacuum_vacuum_scale_factor=0.05"),
                                 F.lit("fillfactor=90")))
                  .when(F.pmod(rid, F.lit(7)) == 0,
                        F.array(F.lit("autovacuum_vacuum_threshold=100")))
                  .otherwise(F.lit(None).cast("array<string>")))
    return c.select(
        "cluster_id",
        F.col("snapshot_id"),
        X.ring_slot(day).alias("slot"),
        day.alias("collected_day"),
        rid.alias("relid"),
        F.when(F.pmod(rid, F.lit(9)) == 0, F.lit("staging")).otherwise(F.lit("public"))
         .alias("schemaname"),
        F.concat(F.lit("rel_"), rid.cast("string")).alias("relname"),
        live.cast("long").alias("n_live_tup"),
        F.col("dead").cast("long").alias("n_dead_tup"),
        F.col("dead").cast("long").alias("n_mod_since_analyze"),
        F.col("ins").cast("long").alias("n_ins_since_vacuum"),
        F.col("ins").cast("long").alias("n_tup_ins"),
        F.col("upd").cast("long").alias("n_tup_upd"),
        F.col("del").cast("long").alias("n_tup_del"),
        F.lit(0).cast("long").alias("n_tup_hot_upd"),
        F.col("last_av").alias("last_autovacuum"),
        F.col("last_av").alias("last_autoanalyze"),
        F.lit(0).cast("long").alias("vacuum_count"),
        F.col("avc").cast("long").alias("autovacuum_count"),
        F.lit(0).cast("long").alias("analyze_count"),
        F.col("avc").cast("long").alias("autoanalyze_count"),
        (F.col("avc") * 1.5).cast("double").alias("total_autovacuum_time"),
        live.cast("float").alias("reltuples"),
        relpages.alias("relpages"),
        F.lit(0).alias("relallvisible"),
        (F.col("dead") * 10000000).cast("long").alias("relfrozenxid_age"),
        (F.col("dead") * 1000000).cast("long").alias("relminmxid_age"),
        (F.col("avc") * 1000 + 1000).cast("long").alias("relfrozenxid"),
        F.lit(None).cast("long").alias("relminmxid"),
        (relpages.cast("long") * 8192).alias("relation_size_bytes"),
        (relpages.cast("long") * 8192 + 16384).alias("total_size_bytes"),
        reloptions.alias("reloptions"),
    )


def snapshots(events: DataFrame) -> DataFrame:
    """One header row per cluster and hour that has events; collected at the end of the hour."""
    e = events.select(
        cluster_of("event_id").alias("cluster_id"), "ts", "user_id", "event_type",
        F.floor(X.epoch_micros("ts") / F.lit(HOUR_US)).cast("long").alias("snapshot_id"))
    h = e.groupBy("cluster_id", "snapshot_id").agg(
        F.count("*").alias("n"),
        F.count_if(F.col("event_type") == "error").alias("n_err"),
        F.count_if(F.col("event_type") == "signup").alias("n_del"),
        F.max(F.when(F.col("event_type") == "error", F.col("user_id"))).alias("err_user"))
    collected_at = _hour_ts(F.col("snapshot_id"))
    day = X.epoch_day(collected_at)
    d = DEFAULTS
    pinned = F.col("n_err") > 0
    return h.select(
        "cluster_id",
        "snapshot_id",
        X.ring_slot(day).alias("slot"),
        day.alias("collected_day"),
        collected_at.alias("collected_at"),
        F.lit("db0").alias("datname"),
        F.lit(d["server_version_num"]).alias("server_version_num"),
        F.lit(d["def_vac_scale_factor"]).alias("def_vac_scale_factor"),
        F.lit(d["def_vac_threshold"]).cast("long").alias("def_vac_threshold"),
        F.lit(d["def_ana_scale_factor"]).alias("def_ana_scale_factor"),
        F.lit(d["def_ana_threshold"]).cast("long").alias("def_ana_threshold"),
        F.lit(d["def_vac_cost_limit"]).alias("def_vac_cost_limit"),
        F.lit(d["def_vac_cost_delay"]).alias("def_vac_cost_delay"),
        F.lit(d["def_freeze_max_age"]).cast("long").alias("def_freeze_max_age"),
        F.lit(d["def_mxid_freeze_max_age"]).cast("long").alias("def_mxid_freeze_max_age"),
        F.lit(d["autovacuum_max_workers"]).alias("autovacuum_max_workers"),
        (F.col("n") * 8192).cast("decimal(38,0)").alias("wal_bytes"),
        F.col("n").cast("long").alias("client_backends"),
        F.lit(d["max_connections"]).alias("max_connections"),
        F.lit(1048576).cast("long").alias("pg_class_size_bytes"),
        F.col("n_del").cast("long").alias("pg_class_n_dead_tup"),
        F.lit(1000).cast("long").alias("pg_class_n_live_tup"),
        F.lit(None).cast("timestamp_ntz").alias("pg_class_last_autovacuum"),
        F.when(pinned, F.col("n") * 1000).cast("long").alias("oldest_xmin_age"),
        F.when(pinned, F.lit("long_running_txn")).otherwise(F.lit("none"))
         .alias("oldest_xmin_owner"),
        F.when(pinned, F.col("err_user").cast("string")).alias("oldest_xmin_owner_detail"),
        F.lit(None).cast("long").alias("oldest_catalog_xmin_age"),
        F.lit("none").alias("oldest_catalog_xmin_owner"),
        F.lit(None).cast("long").alias("current_xid"),
        F.lit(None).cast("long").alias("current_mxid"),
    )


def dense_samples(samples: DataFrame, snaps: DataFrame) -> DataFrame:
    """What an unfiltered catalog scan would return every hour: each relation's latest
    state carried forward to every later snapshot, plus catalog flags, without ages.

    Built by expanding each sample over the hour range until the relation's next sample
    (a range expansion, never an entity x snapshot cross join), then keeping hours that
    have a snapshot header.
    """
    w = W.partitionBy("cluster_id", "relid").orderBy("snapshot_id")
    last = snaps.groupBy("cluster_id").agg(F.max("snapshot_id").alias("_last"))
    s = (samples.join(F.broadcast(last), "cluster_id")
         .withColumn("_next", F.lead("snapshot_id").over(w))
         .withColumn("_end", F.coalesce(F.col("_next") - 1, F.col("_last")))
         .withColumn("_sid", F.explode(F.sequence("snapshot_id", "_end"))))
    rid = F.col("relid")
    keep = [c for c in samples.columns
            if c not in ("snapshot_id", "slot", "collected_day",
                         "relfrozenxid_age", "relminmxid_age")]
    g = (s.select(F.col("_sid").alias("snapshot_id"), *keep)
         .join(snaps.select("cluster_id", "snapshot_id", "collected_day", "slot"),
               ["cluster_id", "snapshot_id"], "inner"))
    return g.select(
        "cluster_id", "snapshot_id", "slot", "collected_day", *[c for c in keep if c != "cluster_id"],
        F.lit("r").alias("relkind"),
        F.when(F.pmod(rid, F.lit(13)) == 0, F.lit("t")).otherwise(F.lit("p")).alias("relpersistence"),
        (F.pmod(rid, F.lit(4)) == 0).alias("relispartition"),
        (F.pmod(rid, F.lit(17)) == 0).alias("extension_owned"),
    )


def collection_policy(spark: SparkSession) -> DataFrame:
    """Two clusters have a policy; the third reads the safe defaults."""
    return spark.createDataFrame(
        [("n0", True, False, 10 * 8192, ["staging"]), ("n1", False, True, 0, [])],
        "cluster_id string, exclude_temp boolean, include_extension_owned boolean, "
        "min_partition_size_bytes bigint, excluded_schemas array<string>")


def horizon_class_sources(events: DataFrame) -> dict[str, DataFrame]:
    """Snapshot-holding sources per class (the five catalog views): each event is one
    source, its type names the class."""
    kind_owner = {"view": "long_running_txn", "click": "replication_slot",
                  "signup": "standby_feedback", "purchase": "prepared_xact",
                  "error": "logical_slot"}
    return {owner: events.filter(F.col("event_type") == et).select(
                cluster_of("event_id").alias("cluster_id"),
                F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("detail"),
                F.round(F.col("value") * 1000).cast("long").alias("xmin_age"))
            for et, owner in kind_owner.items()}


def horizon_sources(events: DataFrame) -> DataFrame:
    """Snapshot-holding sources: each event is one source of one of five classes."""
    kind_owner = {"view": "long_running_txn", "click": "replication_slot",
                  "signup": "standby_feedback", "purchase": "prepared_xact",
                  "error": "logical_slot"}
    m = F.create_map(*[e for k, v in kind_owner.items() for e in (F.lit(k), F.lit(v))])
    return events.select(
        cluster_of("event_id").alias("cluster_id"),
        F.try_element_at(m, F.col("event_type")).alias("owner"),
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("detail"),
        F.round(F.col("value") * 1000).cast("long").alias("xmin_age"),
        F.when(F.col("event_type") == "error", F.lit("catalog")).otherwise(F.lit("data"))
         .alias("kind"))


def _grid_text(idx):
    return F.element_at(F.array(*[F.lit(v) for v in GRID_TEXT]), idx.cast("int") + 1)


def action_history(orders: DataFrame) -> DataFrame:
    """One actuation attempt per order: the customer is the relation, the order date
    the time, status failed for pending orders."""
    failed = F.col("o_orderstatus") == "P"
    reason = F.when(failed, F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"),
                                   F.lit("lock_timeout"))
                    .otherwise(F.lit("insufficient_privilege")))
    return orders.select(
        cluster_of("o_orderkey").alias("cluster_id"),
        F.col("o_orderkey").alias("action_id"),
        F.col("o_orderkey").alias("batch_id"),
        F.col("o_orderkey").alias("decision_id"),
        F.col("o_custkey").alias("relid"),
        F.concat(F.lit("rel_"), F.col("o_custkey").cast("string")).alias("relname"),
        F.lit(P.ACTUATOR_SF).alias("actuator"),
        _grid_text(F.pmod(F.col("o_orderkey") + 3, F.lit(8))).alias("old_value"),
        _grid_text(F.pmod(F.col("o_orderkey"), F.lit(8))).alias("new_value"),
        F.when(failed, F.lit("failed")).otherwise(F.lit("applied")).alias("status"),
        reason.alias("failure_reason"),
        X.failure_class(reason).alias("failure_class"),
        X.as_ntz("o_orderdate").alias("applied_at"),
    )


def decision_log(orders: DataFrame) -> DataFrame:
    pri = F.col("o_orderpriority")
    decision = (F.when(pri.isin("1-URGENT", "2-HIGH"), F.lit("adjust"))
                .when(pri == "3-MEDIUM", F.lit("hold"))
                .when(pri == "4-NOT SPECIFIED", F.lit("suppressed:user_owned"))
                .otherwise(F.lit("escalate:io_limited")))
    return orders.select(
        cluster_of("o_orderkey").alias("cluster_id"),
        F.col("o_orderkey").alias("decision_id"),
        X.epoch_month("o_orderdate").cast("long").alias("tick_id"),
        F.col("o_custkey").alias("relid"),
        F.lit(P.ACTUATOR_SF).alias("actuator"),
        decision.alias("decision"),
        _grid_text(F.pmod(F.col("o_orderkey"), F.lit(8))).alias("proposed_value"),
        (F.col("o_orderstatus") == "F").alias("applied"),
        X.as_ntz("o_orderdate").alias("created_at"),
    )


def tick_log(orders: DataFrame) -> DataFrame:
    """One control cycle per order: it starts at the order date and runs o_totalprice ms."""
    start = X.as_ntz("o_orderdate")
    err = (F.col("o_orderstatus") == "P") & (F.col("o_orderpriority") == "1-URGENT")
    return orders.select(
        cluster_of("o_orderkey").alias("cluster_id"),
        F.col("o_orderkey").alias("tick_id"),
        F.col("o_orderkey").alias("snapshot_id"),
        start.alias("started_at"),
        (start + F.make_dt_interval(secs=F.round(F.col("o_totalprice") / 1000.0, 3)))
         .alias("finished_at"),
        F.when(err, F.lit("statement timeout")).alias("error"),
    )


def diagnostics(orders: DataFrame) -> DataFrame:
    pri = F.col("o_orderpriority")
    cls = (F.when(pri == "1-URGENT", F.lit("long_running_txn"))
           .when(pri == "2-HIGH", F.lit("io_limited"))
           .when(pri == "3-MEDIUM", F.lit("autovacuum_not_running"))
           .when(pri == "4-NOT SPECIFIED", F.lit("control_oscillation"))
           .otherwise(F.lit("replication_slot")))
    start = X.as_ntz("o_orderdate")
    return orders.select(
        cluster_of("o_orderkey").alias("cluster_id"),
        F.col("o_orderkey").alias("diagnostic_id"),
        F.col("o_custkey").alias("relid"),
        start.alias("detected_at"),
        F.when(pri.isin("1-URGENT", "4-NOT SPECIFIED"), F.lit("critical"))
         .otherwise(F.lit("warning")).alias("severity"),
        cls.alias("inhibitor_class"),
        F.when(F.col("o_orderstatus") == "F", start + F.expr("INTERVAL 1 DAY"))
         .alias("resolved_at"),
    )


def storage_inventory(lineitem: DataFrame) -> DataFrame:
    """Monthly partitions of four logical tables, sized by the line items they hold."""
    month = X.epoch_month("l_shipdate")
    rel = (F.when(F.col("l_linestatus") == "O", F.lit("relation_samples"))
           .otherwise(F.lit("rollup_1h")))
    schema = (F.when(F.col("l_returnflag") == "R", F.lit("govern"))
              .otherwise(F.lit("observe")))
    li = lineitem.select(cluster_of("l_orderkey").alias("cluster_id"), schema.alias("schema_name"), rel.alias("relation"),
                         month.alias("m"), "l_discount")
    g = li.groupBy("cluster_id", "schema_name", "relation", "m").agg(
        F.count("*").alias("approx_rows"),
        F.count_if(F.col("l_discount") > 0.08).alias("dead_tuples"))
    start = X.month_start("m")
    return g.select(
        "cluster_id", "schema_name", "relation",
        F.concat(F.col("relation"), F.lit("_"), X.partition_suffix(start, "month"))
         .alias("partition"),
        F.lit("month").alias("span"),
        start.alias("range_start"),
        X.month_start(F.col("m") + 1).alias("range_end"),
        F.col("approx_rows").cast("long").alias("approx_rows"),
        (F.col("approx_rows") * 100).cast("long").alias("bytes"),
        F.col("dead_tuples").cast("long").alias("dead_tuples"),
    )


def _policy_rows(df: DataFrame, key: str, name: str, cluster: str) -> DataFrame:
    """Policy rows with attributes assigned by fixed rules on the row key."""
    k = F.col(key)
    return df.select(
        F.concat(F.lit("n"), F.col(cluster).cast("string")).alias("cluster_id"),
        F.lower(F.col(name)).alias("policy_name"),
        F.concat(F.lit("policy of "), F.col(name)).alias("description"),
        ((F.pmod(k, F.lit(5)) - 1) * 0.5).alias("aggressiveness"),
        (F.pmod(k, F.lit(4)) * 0.1).alias("io_budget_fraction"),
        F.when(F.pmod(k, F.lit(2)) == 0, F.lit("standard")).otherwise(F.lit("conservative"))
         .alias("freeze_posture"),
        F.make_dt_interval(secs=(F.pmod(k, F.lit(3)) * 1800).cast("double")).alias("min_interval"),
        (F.pmod(k, F.lit(6)) * 20).cast("int").alias("global_max_changes_per_cycle"),
        (F.pmod(k, F.lit(7)) * 150).cast("int").alias("daily_mutation_budget"),
        (F.pmod(k, F.lit(5)) + 1).cast("int").alias("n_sustain"),
        (F.pmod(k, F.lit(3)) == 1).alias("manage_user_owned"),
        (F.pmod(k, F.lit(4)) != 3).alias("enabled"),
        (F.pmod(k, F.lit(2)) == 0).alias("advisory_only"),
    )


def policy(supplier: DataFrame) -> DataFrame:
    """One policy per supplier; the supplier's nation is the cluster it governs (so the
    fleet's policy table grows with the data)."""
    return _policy_rows(supplier, "s_suppkey", "s_name", "s_nationkey")


def policy_next(supplier: DataFrame, nation: DataFrame) -> DataFrame:
    """A later version of the policy table: aggressiveness rises with the cluster number,
    cluster n24's policies are removed, and one policy per nation is added."""
    base = policy(supplier).withColumn(
        "aggressiveness",
        F.col("aggressiveness") + F.substr("cluster_id", F.lit(2)).cast("int") * F.lit(0.25))
    kept = base.filter(F.col("cluster_id") != "n24")
    added = _policy_rows(nation, "n_nationkey", "n_name", "n_nationkey")
    return kept.unionByName(added)


def tx_log(events: DataFrame) -> DataFrame:
    """Per-transaction latency log: each event is a transaction of the arm named by its
    type; signup events are the oracle sweep's probes at a grid scale factor."""
    us = X.epoch_micros("ts")
    grid = F.array(*[F.lit(float(v)) for v in P.SF_GRID])
    return events.select(
        F.col("event_type").alias("arm"),
        F.lit("events").alias("fixture"),
        F.lit("steady").alias("scenario"),
        F.pmod(F.col("user_id"), F.lit(3)).cast("int").alias("seed"),
        F.when(F.col("event_type") == "signup",
               F.element_at(grid, F.pmod(F.col("user_id"), F.lit(8)).cast("int") + 1))
         .alias("probe_sf"),
        F.col("user_id").cast("int").alias("client"),
        F.col("event_id").alias("tx_no"),
        F.round(F.col("value") * 1000).cast("long").alias("latency_us"),
        F.lit(0).alias("script"),
        F.floor(us / 1_000_000).cast("long").alias("epoch_s"),
        F.pmod(us, F.lit(1_000_000)).cast("int").alias("epoch_us"),
        F.lit(0).cast("long").alias("schedule_lag"),
    )


def tx_log_lineitem(lineitem: DataFrame) -> DataFrame:
    """Bench-scale latency log: one transaction per line item, arm = return flag."""
    us = X.epoch_micros("l_shipdate")
    return lineitem.select(
        F.col("l_returnflag").alias("arm"),
        F.lit("lineitem").alias("fixture"),
        F.col("l_linestatus").alias("scenario"),
        F.lit(1).alias("seed"),
        F.lit(None).cast("double").alias("probe_sf"),
        F.col("l_suppkey").cast("int").alias("client"),
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("tx_no"),
        F.round(F.col("l_extendedprice") * 100).cast("long").alias("latency_us"),
        F.lit(0).alias("script"),
        F.floor(us / 1_000_000).cast("long").alias("epoch_s"),
        F.lit(0).alias("epoch_us"),
        F.lit(0).cast("long").alias("schedule_lag"),
    )


def efficacy_metrics(events: DataFrame) -> DataFrame:
    """Sampler rows: one per event, attributed to the event's arm and seed."""
    v = F.col("value")
    return events.select(
        F.col("event_id").alias("sample_id"),
        F.col("ts").alias("sampled_at"),
        F.col("event_type").alias("arm"),
        F.lit("events").alias("fixture"),
        F.lit("steady").alias("scenario"),
        F.pmod(F.col("user_id"), F.lit(3)).cast("int").alias("seed"),
        F.concat(F.lit("rel_"), F.col("user_id").cast("string")).alias("relname"),
        (v / 100.0).alias("dead_frac"),
        F.round(v * 1000).cast("long").alias("rel_size"),
        F.round(v * 1000000).cast("long").alias("xid_age"),
        F.round(v * 1000).cast("long").alias("mxid_age"),
        F.round(v).cast("long").alias("av_count"),
        F.col("ts").alias("av_last"),
        F.round(v * 5).cast("long").alias("candidate_applied"),
    )


def run_meta(events: DataFrame) -> DataFrame:
    """One run per (arm, seed) seen in the events; the 'error' arm lost its freeze setting."""
    t = tx_log(events)
    return t.groupBy("arm", "fixture", "scenario", "seed", "probe_sf").agg(
        F.min("epoch_s").alias("first_s")).select(
        F.concat_ws("-", "arm", "fixture", "scenario", F.concat(F.lit("s"), F.col("seed").cast("string")),
                    F.col("probe_sf").cast("string")).alias("run_id"),
        "arm", "fixture", "scenario", "seed", F.col("probe_sf").alias("oracle_sf"),
        F.lit(86400).alias("sample_interval_s"),
        F.when(F.col("arm") != "error", F.lit(200000000).cast("long"))
         .alias("autovacuum_freeze_max_age"),
        X.as_ntz(F.timestamp_seconds("first_s")).alias("started_at"))


def override_events(region: DataFrame) -> DataFrame:
    """Operator force/clear events: one per region, on consecutive days; even regions
    force a state, odd ones clear it."""
    k = F.col("r_regionkey")
    state = (F.when(k == 0, F.lit("degraded")).when(k == 2, F.lit("diagnostic"))
             .when(k == 4, F.lit("emergency")))
    return region.select(
        cluster_of("r_regionkey").alias("cluster_id"),
        X.as_ntz(F.make_timestamp(F.lit(2001), F.lit(7), k + 1, F.lit(0), F.lit(0), F.lit(0)))
         .alias("event_at"),
        F.when(F.pmod(k, F.lit(2)) == 0, F.lit("force")).otherwise(F.lit("clear")).alias("action"),
        state.alias("forced_state"),
        F.concat(F.lit("maintenance window "), F.lower(F.col("r_name"))).alias("forced_reason"))
