"""Rows and frames of the telemetry tables that the tests share."""

import datetime as dt

SAMPLE_COLS = [
    ("cluster_id", "string"), ("snapshot_id", "bigint"), ("slot", "smallint"),
    ("collected_day", "int"), ("relid", "bigint"), ("schemaname", "string"),
    ("relname", "string"), ("n_live_tup", "bigint"), ("n_dead_tup", "bigint"),
    ("n_mod_since_analyze", "bigint"), ("n_ins_since_vacuum", "bigint"),
    ("n_tup_ins", "bigint"), ("n_tup_upd", "bigint"), ("n_tup_del", "bigint"),
    ("n_tup_hot_upd", "bigint"), ("last_autovacuum", "timestamp_ntz"),
    ("last_autoanalyze", "timestamp_ntz"), ("vacuum_count", "bigint"),
    ("autovacuum_count", "bigint"), ("analyze_count", "bigint"),
    ("autoanalyze_count", "bigint"), ("total_autovacuum_time", "double"),
    ("reltuples", "float"), ("relpages", "int"), ("relallvisible", "int"),
    ("relfrozenxid_age", "bigint"), ("relminmxid_age", "bigint"), ("relfrozenxid", "bigint"),
    ("relminmxid", "bigint"), ("relation_size_bytes", "bigint"),
    ("total_size_bytes", "bigint"), ("reloptions", "array<string>"),
]
SNAP_COLS = [
    ("cluster_id", "string"), ("snapshot_id", "bigint"), ("collected_day", "int"),
    ("collected_at", "timestamp_ntz"), ("def_vac_scale_factor", "double"),
    ("def_vac_threshold", "bigint"), ("def_ana_scale_factor", "double"),
    ("def_ana_threshold", "bigint"), ("def_freeze_max_age", "bigint"),
    ("def_mxid_freeze_max_age", "bigint"), ("client_backends", "bigint"),
    ("max_connections", "int"), ("oldest_xmin_age", "bigint"), ("oldest_xmin_owner", "string"),
    ("oldest_xmin_owner_detail", "string"), ("current_xid", "bigint"), ("current_mxid", "bigint"),
    ("pg_class_size_bytes", "bigint"), ("pg_class_n_dead_tup", "bigint"),
    ("pg_class_n_live_tup", "bigint"), ("pg_class_last_autovacuum", "timestamp_ntz"),
]
T0 = dt.datetime(2024, 1, 1, 0, 0, 0)


def frame(spark, cols, rows):
    schema = ", ".join(f"{n} {t}" for n, t in cols)
    names = [n for n, _ in cols]
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], schema)


def sample(**kw):
    base = dict(cluster_id="c0", snapshot_id=1, slot=0, collected_day=19723, relid=1,
                schemaname="public", relname="t", n_live_tup=1000, n_dead_tup=0,
                n_mod_since_analyze=0, n_ins_since_vacuum=0, n_tup_ins=0, n_tup_upd=0,
                n_tup_del=0, n_tup_hot_upd=0, vacuum_count=0, autovacuum_count=0,
                analyze_count=0, autoanalyze_count=0, reltuples=1000.0, relpages=10,
                relallvisible=0, relfrozenxid_age=0, relminmxid_age=0,
                relation_size_bytes=81920, total_size_bytes=98304)
    base.update(kw)
    return base


def snap(**kw):
    sid = kw.get("snapshot_id", 1)
    base = dict(cluster_id="c0", snapshot_id=sid, collected_day=19723,
                collected_at=T0 + dt.timedelta(minutes=sid), def_vac_scale_factor=0.2,
                def_vac_threshold=50, def_ana_scale_factor=0.1, def_ana_threshold=50,
                def_freeze_max_age=200000000, def_mxid_freeze_max_age=400000000,
                client_backends=10, max_connections=100, oldest_xmin_owner="none")
    base.update(kw)
    return base
