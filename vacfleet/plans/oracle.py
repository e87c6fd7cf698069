"""Independent DuckDB formulations of the registered queries (the correctness oracle).

The stand-in inputs are re-derived here in plain SQL from the driver tables, at
event level (running windows), so they also cross-check the Spark derivation, which
pre-aggregates per (entity, hour) instead. Every query rounds DOUBLE output to 6
places, like ``catalog.finish``.
"""

from __future__ import annotations

ORACLE: dict[str, str] = {}

# ---- derived inputs -------------------------------------------------------------
CTE: dict[str, tuple[list[str], str]] = {}


def cte(name: str, deps: list[str], body: str) -> None:
    CTE[name] = (deps, body)


def opt(col: str, key: str) -> str:
    """DuckDB: value of key in a key=value list, NULL if absent."""
    return (f"substr(list_filter({col}, lambda x: starts_with(x, '{key}='))[1], "
            f"{len(key) + 2})")


cte("_ev_c", [], """
SELECT 'n' || CAST(event_id % 3 AS VARCHAR) AS cluster_id, user_id AS relid, ts, event_id, us,
  SUM(CASE WHEN event_type='purchase' THEN 1 ELSE 0 END) OVER w AS ins,
  SUM(CASE WHEN event_type IN ('view','click') THEN 1 ELSE 0 END) OVER w AS upd,
  SUM(CASE WHEN event_type='signup' THEN 1 ELSE 0 END) OVER w AS del,
  SUM(CASE WHEN event_type='error' THEN 1 ELSE 0 END) OVER w AS avc,
  MAX(CASE WHEN event_type='error' THEN ts END) OVER w AS last_av
FROM (SELECT *, epoch_us(ts) AS us FROM events)
WINDOW w AS (PARTITION BY event_id % 3, user_id ORDER BY us, event_id
             ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")

cte("_ev_d", ["_ev_c"], """
SELECT *, us // 3600000000 AS sid,
  upd + del - CASE WHEN avc > 0 THEN MIN(upd + del) OVER (PARTITION BY cluster_id, relid, avc)
                   ELSE 0 END AS dead,
  ROW_NUMBER() OVER (PARTITION BY cluster_id, relid, us // 3600000000
                     ORDER BY us DESC, event_id DESC) AS rn
FROM _ev_c""")

cte("samples", ["_ev_d"], """
SELECT cluster_id, CAST(sid AS BIGINT) AS snapshot_id,
  CAST(((sid + 1) * 3600 // 86400) % 8 AS SMALLINT) AS slot,
  CAST((sid + 1) * 3600 // 86400 AS INTEGER) AS collected_day,
  relid,
  CASE WHEN relid % 9 = 0 THEN 'staging' ELSE 'public' END AS schemaname,
  'rel_' || CAST(relid AS VARCHAR) AS relname,
  CAST(1000 + ins - del AS BIGINT) AS n_live_tup,
  CAST(dead AS BIGINT) AS n_dead_tup,
  CAST(dead AS BIGINT) AS n_mod_since_analyze,
  CAST(ins AS BIGINT) AS n_ins_since_vacuum,
  CAST(ins AS BIGINT) AS n_tup_ins, CAST(upd AS BIGINT) AS n_tup_upd,
  CAST(del AS BIGINT) AS n_tup_del, CAST(0 AS BIGINT) AS n_tup_hot_upd,
  last_av AS last_autovacuum, last_av AS last_autoanalyze,
  CAST(0 AS BIGINT) AS vacuum_count, CAST(avc AS BIGINT) AS autovacuum_count,
  CAST(0 AS BIGINT) AS analyze_count, CAST(avc AS BIGINT) AS autoanalyze_count,
  CAST(avc * 1.5 AS DOUBLE) AS total_autovacuum_time,
  CAST(1000 + ins - del AS REAL) AS reltuples,
  CAST(floor((1000 + ins - del) / 10) AS INTEGER) AS relpages,
  CAST(0 AS INTEGER) AS relallvisible,
  CAST(dead * 10000000 AS BIGINT) AS relfrozenxid_age,
  CAST(dead * 1000000 AS BIGINT) AS relminmxid_age,
  CAST(avc * 1000 + 1000 AS BIGINT) AS relfrozenxid, CAST(NULL AS BIGINT) AS relminmxid,
  CAST(floor((1000 + ins - del) / 10) AS BIGINT) * 8192 AS relation_size_bytes,
  CAST(floor((1000 + ins - del) / 10) AS BIGINT) * 8192 + 16384 AS total_size_bytes,
  CASE WHEN relid % 5 = 0 THEN ['autovacuum_vacuum_scale_factor=0.05', 'fillfactor=90']
       WHEN relid % 7 = 0 THEN ['autovacuum_vacuum_threshold=100'] END AS reloptions
FROM _ev_d WHERE rn = 1""")

cte("snapshots", [], """
SELECT cluster_id, CAST(sid AS BIGINT) AS snapshot_id,
  CAST(((sid + 1) * 3600 // 86400) % 8 AS SMALLINT) AS slot,
  CAST((sid + 1) * 3600 // 86400 AS INTEGER) AS collected_day,
  make_timestamp((sid + 1) * 3600000000) AS collected_at,
  'db0' AS datname, 170000 AS server_version_num,
  CAST(0.2 AS DOUBLE) AS def_vac_scale_factor, CAST(50 AS BIGINT) AS def_vac_threshold,
  CAST(0.1 AS DOUBLE) AS def_ana_scale_factor, CAST(50 AS BIGINT) AS def_ana_threshold,
  200 AS def_vac_cost_limit, CAST(2.0 AS DOUBLE) AS def_vac_cost_delay,
  CAST(200000000 AS BIGINT) AS def_freeze_max_age,
  CAST(400000000 AS BIGINT) AS def_mxid_freeze_max_age,
  3 AS autovacuum_max_workers,
  CAST(count(*) * 8192 AS DOUBLE) AS wal_bytes,
  CAST(count(*) AS BIGINT) AS client_backends, 100 AS max_connections,
  CAST(1048576 AS BIGINT) AS pg_class_size_bytes,
  CAST(count(*) FILTER (WHERE event_type = 'signup') AS BIGINT) AS pg_class_n_dead_tup,
  CAST(1000 AS BIGINT) AS pg_class_n_live_tup,
  CAST(NULL AS TIMESTAMP) AS pg_class_last_autovacuum,
  CASE WHEN count(*) FILTER (WHERE event_type = 'error') > 0
       THEN CAST(count(*) * 1000 AS BIGINT) END AS oldest_xmin_age,
  CASE WHEN count(*) FILTER (WHERE event_type = 'error') > 0
       THEN 'long_running_txn' ELSE 'none' END AS oldest_xmin_owner,
  CAST(max(CASE WHEN event_type = 'error' THEN user_id END) AS VARCHAR)
       AS oldest_xmin_owner_detail,
  CAST(NULL AS BIGINT) AS oldest_catalog_xmin_age, 'none' AS oldest_catalog_xmin_owner,
  CAST(NULL AS BIGINT) AS current_xid, CAST(NULL AS BIGINT) AS current_mxid
FROM (SELECT *, epoch_us(ts) // 3600000000 AS sid, 'n' || CAST(event_id % 3 AS VARCHAR) AS cluster_id FROM events)
GROUP BY cluster_id, sid""")

# newest snapshot per cluster and the state of every relation as of it
cte("tgt", ["snapshots"], """
SELECT cluster_id, max(snapshot_id) AS p FROM snapshots GROUP BY cluster_id""")

cte("hdr", ["snapshots", "tgt"], """
SELECT s.* FROM snapshots s JOIN tgt t ON s.cluster_id = t.cluster_id AND s.snapshot_id = t.p""")

cte("cur", ["samples", "tgt"], """
SELECT s.* EXCLUDE (snapshot_id), t.p AS snapshot_id
FROM samples s JOIN tgt t ON s.cluster_id = t.cluster_id
WHERE s.snapshot_id <= t.p
QUALIFY row_number() OVER (PARTITION BY s.cluster_id, s.relid ORDER BY s.snapshot_id DESC) = 1""")

cte("prev", ["samples", "tgt"], """
SELECT s.* FROM samples s JOIN tgt t ON s.cluster_id = t.cluster_id
WHERE s.snapshot_id < t.p
QUALIFY row_number() OVER (PARTITION BY s.cluster_id, s.relid ORDER BY s.snapshot_id DESC) = 1""")

cte("debt", ["cur", "hdr"], f"""
SELECT c.cluster_id, c.relid, c.schemaname, c.relname, c.n_dead_tup, c.n_mod_since_analyze,
  c.reltuples, vacuum_threshold, analyze_threshold,
  c.n_dead_tup::DOUBLE / NULLIF(rt, 0) AS dead_tuple_fraction,
  c.n_mod_since_analyze::DOUBLE / NULLIF(rt, 0) AS mod_fraction,
  c.n_dead_tup::DOUBLE / NULLIF(vacuum_threshold, 0) AS vacuum_debt_ratio,
  c.n_mod_since_analyze::DOUBLE / NULLIF(analyze_threshold, 0) AS analyze_debt_ratio,
  c.relfrozenxid_age::DOUBLE / NULLIF(h.def_freeze_max_age, 0) AS freeze_debt
FROM cur c JOIN hdr h ON c.cluster_id = h.cluster_id,
LATERAL (SELECT greatest(c.reltuples, 0) AS rt) r,
LATERAL (SELECT
  COALESCE(TRY_CAST({opt('c.reloptions', 'autovacuum_vacuum_threshold')} AS BIGINT),
           h.def_vac_threshold)
  + COALESCE(TRY_CAST({opt('c.reloptions', 'autovacuum_vacuum_scale_factor')} AS DOUBLE),
             h.def_vac_scale_factor) * r.rt AS vacuum_threshold,
  COALESCE(TRY_CAST({opt('c.reloptions', 'autovacuum_analyze_threshold')} AS BIGINT),
           h.def_ana_threshold)
  + COALESCE(TRY_CAST({opt('c.reloptions', 'autovacuum_analyze_scale_factor')} AS DOUBLE),
             h.def_ana_scale_factor) * r.rt AS analyze_threshold) t""")


def with_ctes(names: list[str], final: str) -> str:
    order: list[str] = []

    def visit(n):
        if n in order:
            return
        for dep in CTE[n][0]:
            visit(dep)
        order.append(n)

    for n in names:
        visit(n)
    parts = [f"{n} AS ({CTE[n][1].strip()})" for n in order]
    final = final.strip()
    if not parts:
        return final
    if final[:5].upper() == "WITH ":
        return "WITH " + ",\n".join(parts) + ",\n" + final[5:]
    return "WITH " + ",\n".join(parts) + "\n" + final


def q(name: str, ctes: list[str], final: str) -> None:
    ORACLE[name] = with_ctes(ctes, final)


def r6(expr: str, alias: str) -> str:
    return f"round({expr}, 6) AS {alias}"


STATE_SELECT = """cluster_id, snapshot_id, relid, collected_day, schemaname, relname,
  n_live_tup, n_dead_tup, n_mod_since_analyze, n_ins_since_vacuum,
  n_tup_ins, n_tup_upd, n_tup_del, n_tup_hot_upd, last_autovacuum, last_autoanalyze,
  vacuum_count, autovacuum_count, analyze_count, autoanalyze_count,
  round(total_autovacuum_time, 6) AS total_autovacuum_time, reltuples, relpages,
  relallvisible, relfrozenxid_age, relminmxid_age, relation_size_bytes,
  total_size_bytes, array_to_string(reloptions, ',') AS reloptions"""

# ---- state and debt ---------------------------------------------------------------
q("state_as_of", ["cur"], f"SELECT {STATE_SELECT} FROM cur")

q("previous_sample", ["prev"], """
SELECT cluster_id, relid, snapshot_id, n_tup_ins, n_tup_upd, n_tup_del, n_dead_tup,
       autovacuum_count, reltuples, relfrozenxid_age FROM prev""")

q("relation_health", ["cur", "hdr"], """
SELECT c.cluster_id, c.relid, c.schemaname, c.relname, c.n_dead_tup, c.n_live_tup,
       c.reltuples, c.relfrozenxid_age, c.relminmxid_age, c.last_autovacuum,
       c.autovacuum_count, h.collected_at
FROM cur c JOIN hdr h ON c.cluster_id = h.cluster_id""")

q("maintenance_debt", ["debt"], """
SELECT cluster_id, relid, schemaname, relname, n_dead_tup, n_mod_since_analyze, reltuples,
  round(vacuum_threshold, 6) AS vacuum_threshold,
  round(analyze_threshold, 6) AS analyze_threshold,
  round(dead_tuple_fraction, 6) AS dead_tuple_fraction,
  round(mod_fraction, 6) AS mod_fraction,
  round(vacuum_debt_ratio, 6) AS vacuum_debt_ratio,
  round(analyze_debt_ratio, 6) AS analyze_debt_ratio,
  round(freeze_debt, 6) AS freeze_debt
FROM debt""")

cte("horizon_sources", [], """
SELECT 'n' || CAST(event_id % 3 AS VARCHAR) AS cluster_id,
  CASE event_type WHEN 'view' THEN 'long_running_txn' WHEN 'click' THEN 'replication_slot'
       WHEN 'signup' THEN 'standby_feedback' WHEN 'purchase' THEN 'prepared_xact'
       WHEN 'error' THEN 'logical_slot' END AS owner,
  'u' || CAST(user_id AS VARCHAR) AS detail,
  CAST(round(value * 1000) AS BIGINT) AS xmin_age,
  CASE WHEN event_type = 'error' THEN 'catalog' ELSE 'data' END AS kind
FROM events""")

q("horizons", ["horizon_sources"], """
WITH d AS (SELECT cluster_id, xmin_age, owner, detail FROM horizon_sources
           WHERE kind = 'data' AND xmin_age IS NOT NULL
           QUALIFY row_number() OVER (PARTITION BY cluster_id
                                      ORDER BY xmin_age DESC, owner, detail) = 1),
     c AS (SELECT cluster_id, xmin_age, detail FROM horizon_sources
           WHERE kind = 'catalog' AND xmin_age IS NOT NULL
           QUALIFY row_number() OVER (PARTITION BY cluster_id
                                      ORDER BY xmin_age DESC, detail) = 1),
     k AS (SELECT DISTINCT cluster_id FROM horizon_sources)
SELECT k.cluster_id, d.xmin_age AS oldest_xmin_age,
       COALESCE(d.owner, 'none') AS oldest_xmin_owner, d.detail AS oldest_xmin_owner_detail,
       c.xmin_age AS oldest_catalog_xmin_age,
       COALESCE(c.detail, 'none') AS oldest_catalog_xmin_owner
FROM k LEFT JOIN d USING (cluster_id) LEFT JOIN c USING (cluster_id)""")

q("effective_setting", ["cur", "hdr"], f"""
SELECT c.cluster_id, c.relid,
  {opt('c.reloptions', 'autovacuum_vacuum_scale_factor')} AS explicit_vac_sf,
  round(COALESCE(TRY_CAST({opt('c.reloptions', 'autovacuum_vacuum_scale_factor')} AS DOUBLE),
                 h.def_vac_scale_factor), 6) AS vac_sf,
  COALESCE(TRY_CAST({opt('c.reloptions', 'autovacuum_vacuum_threshold')} AS BIGINT),
           h.def_vac_threshold) AS vac_threshold
FROM cur c JOIN hdr h ON c.cluster_id = h.cluster_id""")

# ---- sparse logging and rollups -----------------------------------------------------
cte("dense", ["samples", "snapshots"], """
SELECT n.* EXCLUDE (snapshot_id, slot, collected_day, nxt, relfrozenxid_age, relminmxid_age),
  h.snapshot_id, h.slot, h.collected_day,
  'r' AS relkind, CASE WHEN n.relid % 13 = 0 THEN 't' ELSE 'p' END AS relpersistence,
  n.relid % 4 = 0 AS relispartition, n.relid % 17 = 0 AS extension_owned
FROM (SELECT *, lead(snapshot_id) OVER (PARTITION BY cluster_id, relid ORDER BY snapshot_id) AS nxt
      FROM samples) n
JOIN snapshots h ON h.cluster_id = n.cluster_id AND h.snapshot_id >= n.snapshot_id
                AND (n.nxt IS NULL OR h.snapshot_id < n.nxt)""")

cte("collection_policy", [], """
SELECT 'n0' AS cluster_id, true AS exclude_temp, false AS include_extension_owned,
       CAST(81920 AS BIGINT) AS min_partition_size_bytes, ['staging'] AS excluded_schemas
UNION ALL SELECT 'n1', false, true, CAST(0 AS BIGINT), CAST([] AS VARCHAR[])""")

cte("collected", ["dense", "collection_policy"], """
SELECT d.* EXCLUDE (relkind, relpersistence, relispartition, extension_owned)
FROM dense d LEFT JOIN collection_policy p ON p.cluster_id = d.cluster_id
WHERE d.schemaname NOT IN ('pg_catalog', 'information_schema')
  AND d.relkind IN ('r', 'm', 'p')
  AND (NOT COALESCE(p.exclude_temp, true) OR d.relpersistence <> 't')
  AND NOT list_contains(COALESCE(p.excluded_schemas, []), d.schemaname)
  AND (COALESCE(p.include_extension_owned, false) OR NOT d.extension_owned)
  AND (COALESCE(p.min_partition_size_bytes, 0) = 0 OR NOT d.relispartition
       OR d.total_size_bytes >= p.min_partition_size_bytes)""")

_SIG = """schemaname, relname, n_live_tup, n_dead_tup, n_mod_since_analyze, n_ins_since_vacuum,
  n_tup_ins, n_tup_upd, n_tup_del, n_tup_hot_upd, last_autovacuum, last_autoanalyze,
  vacuum_count, autovacuum_count, analyze_count, autoanalyze_count, total_autovacuum_time,
  reltuples, relpages, relallvisible, relfrozenxid, relminmxid, relation_size_bytes,
  total_size_bytes, reloptions"""

q("collection_filter", ["collected"], """
SELECT * REPLACE (array_to_string(reloptions, ',') AS reloptions,
                  round(total_autovacuum_time, 6) AS total_autovacuum_time) FROM collected""")

q("sparse_log", ["collected"], f"""
SELECT * EXCLUDE (_prev) REPLACE (array_to_string(reloptions, ',') AS reloptions,
                  round(total_autovacuum_time, 6) AS total_autovacuum_time)
FROM (SELECT *, lag(struct_pack({_SIG})) OVER (PARTITION BY cluster_id, relid
                                               ORDER BY snapshot_id) AS _prev
      FROM collected)
WHERE _prev IS NULL OR _prev IS DISTINCT FROM struct_pack({_SIG})""")

cte("r1m", ["samples", "snapshots"], """
SELECT s.cluster_id,
  CAST(epoch_us(date_trunc('minute', h.collected_at)) // 86400000000 AS INTEGER) AS bucket_part,
  CAST(date_trunc('minute', h.collected_at) AS TIMESTAMP) AS bucket_start, s.relid,
  max(s.schemaname) AS schemaname, max(s.relname) AS relname,
  CAST(count(*) AS INTEGER) AS sample_count,
  avg(s.n_dead_tup) AS avg_dead_tup, max(s.n_dead_tup) AS max_dead_tup,
  avg(s.n_live_tup) AS avg_live_tup, max(s.n_live_tup) AS max_live_tup,
  avg(s.n_mod_since_analyze) AS avg_mod_since_analyze,
  max(s.n_mod_since_analyze) AS max_mod_since_analyze,
  CAST(avg(greatest(s.reltuples, 0)) AS DOUBLE) AS avg_reltuples,
  CAST(max(greatest(s.reltuples, 0)) AS BIGINT) AS max_reltuples,
  max(s.relfrozenxid_age) AS max_relfrozenxid_age,
  max(s.relminmxid_age) AS max_relminmxid_age,
  max(s.n_tup_ins) AS max_n_tup_ins, max(s.n_tup_upd) AS max_n_tup_upd,
  max(s.n_tup_del) AS max_n_tup_del, max(s.vacuum_count) AS max_vacuum_count,
  max(s.autovacuum_count) AS max_autovacuum_count, max(s.analyze_count) AS max_analyze_count,
  max(s.autoanalyze_count) AS max_autoanalyze_count,
  avg(s.total_size_bytes) AS avg_total_size_bytes,
  max(s.total_size_bytes) AS max_total_size_bytes
FROM samples s JOIN snapshots h ON h.cluster_id = s.cluster_id AND h.snapshot_id = s.snapshot_id
GROUP BY s.cluster_id, date_trunc('minute', h.collected_at), s.relid""")


def _coarsen_sql(src: str, unit: str) -> str:
    w = "sum({c} * sample_count) / NULLIF(sum(sample_count), 0) AS {c}"
    avgs = ",\n  ".join(w.format(c=f"avg_{m}") for m in
                        ["dead_tup", "live_tup", "mod_since_analyze", "reltuples",
                         "total_size_bytes"])
    maxes = ",\n  ".join(f"max({c}) AS {c}" for c in
                         ["max_dead_tup", "max_live_tup", "max_mod_since_analyze",
                          "max_reltuples", "max_total_size_bytes", "max_relfrozenxid_age",
                          "max_relminmxid_age", "max_n_tup_ins", "max_n_tup_upd",
                          "max_n_tup_del", "max_vacuum_count", "max_autovacuum_count",
                          "max_analyze_count", "max_autoanalyze_count"])
    b = f"date_trunc('{unit}', bucket_start)"
    return f"""
SELECT cluster_id,
  CAST((year({b}) - 1970) * 12 + month({b}) - 1 AS INTEGER) AS bucket_part,
  CAST({b} AS TIMESTAMP) AS bucket_start, relid,
  max(schemaname) AS schemaname, max(relname) AS relname,
  CAST(sum(sample_count) AS INTEGER) AS sample_count,
  {avgs},
  {maxes}
FROM {src} GROUP BY cluster_id, {b}, relid"""


cte("r1h", ["r1m"], _coarsen_sql("r1m", "hour"))
cte("r1d", ["r1h"], _coarsen_sql("r1h", "day"))

_TIER_ROUND = """* REPLACE (round(avg_dead_tup, 6) AS avg_dead_tup, round(avg_live_tup, 6) AS avg_live_tup,
  round(avg_mod_since_analyze, 6) AS avg_mod_since_analyze,
  round(avg_reltuples, 6) AS avg_reltuples,
  round(avg_total_size_bytes, 6) AS avg_total_size_bytes)"""
q("rollup_1m", ["r1m"], f"SELECT {_TIER_ROUND} FROM r1m")
q("rollup_1h", ["r1h"], f"SELECT {_TIER_ROUND} FROM r1h")
q("rollup_1d", ["r1d"], f"SELECT {_TIER_ROUND} FROM r1d")
q("rollup_incremental", ["r1m", "r1h", "r1d"], f"""
SELECT {_TIER_ROUND} FROM (SELECT *, '1m' AS tier FROM r1m UNION ALL BY NAME
  SELECT *, '1h' AS tier FROM r1h UNION ALL BY NAME SELECT *, '1d' AS tier FROM r1d)""")
q("raw_sink_roundtrip", ["samples"], """
SELECT cluster_id, snapshot_id, collected_day, slot, relid, n_dead_tup, n_tup_ins, n_tup_upd,
  autovacuum_count FROM samples""")
q("rollup_as_of", ["r1h", "snapshots"], f"""
SELECT {_TIER_ROUND} FROM (SELECT * EXCLUDE (bucket_part) FROM r1h)
WHERE bucket_start <= (SELECT max(collected_at) - INTERVAL 1 DAY FROM snapshots)
QUALIFY row_number() OVER (PARTITION BY cluster_id, relid ORDER BY bucket_start DESC) = 1""")

cte("inventory", [], """
SELECT cluster_id, schema_name, relation,
  relation || '_' || strftime(m, '%Y%m') AS partition, 'month' AS span,
  CAST(m AS TIMESTAMP) AS range_start, CAST(m + INTERVAL 1 MONTH AS TIMESTAMP) AS range_end,
  CAST(n AS BIGINT) AS approx_rows, CAST(n * 100 AS BIGINT) AS bytes,
  CAST(dead AS BIGINT) AS dead_tuples
FROM (SELECT 'n' || CAST(l_orderkey % 3 AS VARCHAR) AS cluster_id, CASE WHEN l_returnflag = 'R' THEN 'govern' ELSE 'observe' END AS schema_name,
             CASE WHEN l_linestatus = 'O' THEN 'relation_samples' ELSE 'rollup_1h' END AS relation,
             date_trunc('month', l_shipdate) AS m, count(*) AS n,
             count(*) FILTER (WHERE l_discount > 0.08) AS dead
      FROM lineitem GROUP BY ALL)""")

q("rollup_retention", ["inventory"], """
SELECT cluster_id, schema_name, relation, partition, range_start, range_end, approx_rows, bytes
FROM inventory
WHERE relation IN ('rollup_1m', 'rollup_1h', 'rollup_1d')
  AND range_end <= (SELECT max(range_end) FROM inventory)
      - to_days(CASE relation WHEN 'rollup_1m' THEN 7 WHEN 'rollup_1h' THEN 90 ELSE 365 END)""")

q("raw_retention", ["samples"], """
SELECT cluster_id, collected_day, slot, count(*) AS rows,
  CASE WHEN collected_day >= max(max(collected_day)) OVER (PARTITION BY cluster_id) - 7
       THEN 'keep' ELSE 'drop' END AS action
FROM samples GROUP BY cluster_id, collected_day, slot""")

q("partition_inventory", ["inventory"], r"""
SELECT cluster_id, schema_name, relation, partition,
  CASE WHEN length(k) = 8 THEN 'day' ELSE 'month' END AS decoded_span,
  CAST(CASE WHEN length(k) = 8 THEN epoch_us(strptime(k, '%Y%m%d')) // 86400000000
            ELSE (CAST(substr(k, 1, 4) AS INTEGER) - 1970) * 12 + CAST(substr(k, 5, 2) AS INTEGER) - 1
       END AS INTEGER) AS part_key,
  CAST(strptime(CASE WHEN length(k) = 8 THEN k ELSE k || '01' END, '%Y%m%d') AS TIMESTAMP) AS decoded_start,
  CAST(strptime(CASE WHEN length(k) = 8 THEN k ELSE k || '01' END, '%Y%m%d')
       + CASE WHEN length(k) = 8 THEN INTERVAL 1 DAY ELSE INTERVAL 1 MONTH END AS TIMESTAMP) AS decoded_end,
  approx_rows, bytes
FROM (SELECT *, regexp_extract(partition, '_(\d{6,8})$', 1) AS k FROM inventory)""")

# ---- experiment analytics ------------------------------------------------------------
_RUN = "arm, fixture, scenario, seed, probe_sf"
_CELL = "fixture, scenario, seed"
_GRID = "[" + ", ".join(f"CAST({g} AS DOUBLE)" for g in
                        ("0.005", "0.01", "0.02", "0.05", "0.10", "0.20", "0.30", "0.50")) + "]"

cte("tx_log", [], f"""
SELECT event_type AS arm, 'events' AS fixture, 'steady' AS scenario,
  CAST(user_id % 3 AS INTEGER) AS seed,
  CASE WHEN event_type = 'signup' THEN {_GRID}[user_id % 8 + 1] END AS probe_sf,
  CAST(user_id AS INTEGER) AS client, event_id AS tx_no,
  CAST(round(value * 1000) AS BIGINT) AS latency_us, 0 AS script,
  epoch_us(ts) // 1000000 AS epoch_s, epoch_us(ts) % 1000000 AS us_part
FROM events""")

cte("tx_w", ["tx_log"], f"""
SELECT *, (epoch_s - min(epoch_s) OVER (PARTITION BY {_RUN})) // 86400 AS win FROM tx_log""")

# nearest rank the way the awk script does it: sort, idx = int(0.95 n + 0.5) clamped
cte("p95", ["tx_w"], f"""
SELECT {_RUN}, win, max(CASE WHEN rn = k THEN latency_us END) AS p95_us,
       CAST(max(n) AS BIGINT) AS tx_count
FROM (SELECT *, least(greatest(CAST(floor(CAST(0.95 AS DOUBLE) * n + 0.5) AS BIGINT), 1), n) AS k
      FROM (SELECT *, row_number() OVER (PARTITION BY {_RUN}, win ORDER BY latency_us) AS rn,
                   count(*) OVER (PARTITION BY {_RUN}, win) AS n FROM tx_w))
GROUP BY {_RUN}, win""")

cte("best", ["p95"], f"""
SELECT {_CELL}, win, probe_sf AS best_sf, p95_us AS best_p95_us FROM p95 WHERE arm = 'signup'
QUALIFY row_number() OVER (PARTITION BY {_CELL}, win ORDER BY p95_us, probe_sf) = 1""")

cte("gaps", ["p95", "best"], f"""
WITH e AS (SELECT {_CELL}, win, p95_us AS expert_p95 FROM p95 WHERE arm = 'click'),
     c AS (SELECT {_CELL}, win, p95_us AS candidate_p95 FROM p95 WHERE arm = 'purchase'),
     o AS (SELECT {_CELL}, win, best_p95_us AS oracle_p95 FROM best),
     r AS (SELECT *, count(*) OVER (PARTITION BY {_CELL}) AS n,
                  row_number() OVER (PARTITION BY {_CELL} ORDER BY win) AS rk
           FROM e JOIN c USING ({_CELL}, win) JOIN o USING ({_CELL}, win)),
     r2 AS (SELECT *, greatest(1, CAST(floor(n * CAST(0.2 AS DOUBLE)) AS BIGINT)) AS warm FROM r)
SELECT {_CELL}, win, expert_p95, candidate_p95, oracle_p95, rk <= warm AS warmup,
  n AS total_windows, warm AS warmup_discarded,
  CASE WHEN rk > warm AND expert_p95 - oracle_p95 > 0
       THEN (expert_p95 - candidate_p95)::DOUBLE / (expert_p95 - oracle_p95) END AS gap_closed,
  CASE WHEN rk > warm THEN expert_p95 - oracle_p95 <= 0 END AS dropped,
  CASE WHEN rk > warm AND expert_p95 - oracle_p95 <= 0 THEN 'denom_le_zero' END AS drop_reason
FROM r2""")

cte("metrics", [], """
SELECT event_id AS sample_id, ts AS sampled_at, event_type AS arm, 'events' AS fixture,
  'steady' AS scenario, CAST(user_id % 3 AS INTEGER) AS seed,
  'rel_' || CAST(user_id AS VARCHAR) AS relname, value / CAST(100 AS DOUBLE) AS dead_frac,
  CAST(round(value * 1000) AS BIGINT) AS rel_size,
  CAST(round(value * 1000000) AS BIGINT) AS xid_age,
  CAST(round(value * 1000) AS BIGINT) AS mxid_age, CAST(round(value) AS BIGINT) AS av_count,
  ts AS av_last, CAST(round(value * 5) AS BIGINT) AS candidate_applied
FROM events""")

cte("run_meta", ["tx_log"], """
SELECT concat_ws('-', arm, fixture, scenario, 's' || CAST(seed AS VARCHAR),
                 CAST(probe_sf AS VARCHAR)) AS run_id,
  arm, fixture, scenario, seed, probe_sf AS oracle_sf, 86400 AS sample_interval_s,
  CASE WHEN arm <> 'error' THEN CAST(200000000 AS BIGINT) END AS autovacuum_freeze_max_age,
  make_timestamp(min(epoch_s) * 1000000) AS started_at
FROM tx_log GROUP BY arm, fixture, scenario, seed, probe_sf""")

cte("gates", ["metrics"], f"""
SELECT {_CELL}, d AS defaults_av_count, p AS candidate_av_count, a AS candidate_applied,
  (d > 0 AND p > 2 * d) AS av_ceiling_breach, a > 500 AS mutation_ceiling_breach,
  ((d > 0 AND p > 2 * d) OR a > 500) AS cost_ceiling_breach
FROM (SELECT {_CELL},
        COALESCE(max(av_count) FILTER (WHERE arm = 'view'), 0) AS d,
        COALESCE(max(av_count) FILTER (WHERE arm = 'purchase'), 0) AS p,
        COALESCE(max(candidate_applied) FILTER (WHERE arm = 'purchase'), 0) AS a
      FROM metrics GROUP BY {_CELL})""")

cte("safety", ["metrics", "run_meta"], f"""
WITH w AS (SELECT {_CELL}, max(xid_age) AS w FROM metrics
           WHERE arm IN ('view', 'purchase') GROUP BY {_CELL}),
     l AS (SELECT {_CELL}, COALESCE(max(autovacuum_freeze_max_age) FILTER (WHERE arm = 'view'),
                                    max(autovacuum_freeze_max_age) FILTER (WHERE arm = 'purchase'))
                  AS fma
           FROM run_meta WHERE arm IN ('view', 'purchase') GROUP BY {_CELL}),
     k AS (SELECT {_CELL} FROM metrics UNION SELECT {_CELL} FROM run_meta)
SELECT k.fixture, k.scenario, k.seed, l.fma AS freeze_max_age,
  CAST(COALESCE(w.w, 0) AS BIGINT) AS worst_xid_age,
  l.fma IS NOT NULL AS safety_floor_evaluated,
  CASE WHEN l.fma IS NOT NULL THEN COALESCE(w.w, 0) < l.fma END AS safety_floor_holds
FROM k LEFT JOIN w USING ({_CELL}) LEFT JOIN l USING ({_CELL})""")


def _ladder(med: str, safety_fail: str, cost: str) -> str:
    return (f"CASE WHEN {med} IS NULL THEN 'inconclusive' WHEN {safety_fail} THEN 'fail' "
            f"WHEN {cost} AND {med} > 0 THEN 'fail' WHEN {med} < 0 THEN 'fail' "
            f"WHEN {med} >= 0.25 THEN 'strong_pass' ELSE 'pass' END")


cte("verdicts", ["gaps", "gates", "safety"], f"""
SELECT s.fixture, s.scenario, s.seed,
  {_ladder('s.med', 'COALESCE(f.safety_floor_evaluated AND NOT f.safety_floor_holds, false)',
           'COALESCE(g.cost_ceiling_breach, false)')} AS verdict,
  round(s.med, 6) + 0.0 AS median_gap_closed, s.total_windows, s.warmup_discarded,
  s.graded_windows, s.windows_dropped_denom, s.windows_scored, g.cost_ceiling_breach,
  g.av_ceiling_breach, g.mutation_ceiling_breach, g.defaults_av_count, g.candidate_av_count,
  g.candidate_applied, f.safety_floor_evaluated, f.safety_floor_holds, f.freeze_max_age,
  f.worst_xid_age
FROM (SELECT {_CELL}, max(total_windows) AS total_windows,
             max(warmup_discarded) AS warmup_discarded,
             CAST(count(*) FILTER (WHERE NOT warmup) AS BIGINT) AS graded_windows,
             CAST(count(*) FILTER (WHERE dropped) AS BIGINT) AS windows_dropped_denom,
             CAST(count(gap_closed) AS BIGINT) AS windows_scored,
             quantile_cont(gap_closed, 0.5) AS med
      FROM gaps GROUP BY {_CELL}) s
LEFT JOIN gates g USING ({_CELL}) LEFT JOIN safety f USING ({_CELL})""")

q("window_p95", ["p95"], "SELECT * FROM p95")
q("tx_log_roundtrip", ["tx_log"], """
SELECT arm, fixture, scenario, seed, epoch_s // 86400 AS day, count(*) AS n,
  CAST(sum(latency_us) AS BIGINT) AS latency_us, CAST(sum(us_part) AS BIGINT) AS epoch_us,
  max(tx_no) AS last_tx FROM tx_log GROUP BY ALL""")
q("metrics_roundtrip", ["metrics"], """
SELECT sample_id, sampled_at, arm, scenario, seed, relname, round(dead_frac, 6) AS dead_frac, rel_size
FROM metrics""")
q("run_meta_roundtrip", ["run_meta"], """
SELECT run_id, arm, fixture, scenario, seed, sample_interval_s, autovacuum_freeze_max_age,
  round(oracle_sf, 6) AS oracle_sf FROM run_meta""")
q("sweep_roundtrip", ["p95", "best"], """
SELECT p.win, round(p.probe_sf, 6) AS sf, count(*) AS n, sum(p95_us) AS p95_sum, sum(tx_count) AS tx_count,
  max(n_best) AS n_best, max(best_sum) AS best_sum
FROM p95 p LEFT JOIN (SELECT win, count(*) AS n_best, sum(best_p95_us) AS best_sum FROM best GROUP BY 1) b USING (win)
WHERE arm = 'signup' GROUP BY p.win, p.probe_sf""")
q("verdict_sink", ["verdicts", "gaps"], """
SELECT g.fixture, g.scenario, g.seed, v.verdict, g.win AS "window", round(g.gap_closed, 6) AS gap_closed, g.dropped
FROM gaps g JOIN verdicts v USING (fixture, scenario, seed)""")
q("best_of_sweep", ["best"], "SELECT * FROM best")
q("gap_closed", ["gaps"], "SELECT * REPLACE (round(gap_closed, 6) AS gap_closed) FROM gaps")
q("cost_gates", ["gates"], "SELECT * FROM gates")
q("safety_floor", ["safety"], "SELECT * FROM safety")
q("verdict", ["verdicts"], "SELECT * FROM verdicts")
q("cell_verdict", ["verdicts"], f"""
SELECT fixture, scenario,
  {_ladder('m', 'any_safety_floor_violation', 'any_cost_ceiling_breach')} AS cell_verdict,
  round(m, 6) + 0.0 AS median_gap_closed, round(lo, 6) + 0.0 AS iqr_low,
  round(hi, 6) + 0.0 AS iqr_high, n_seeds, any_cost_ceiling_breach, any_av_ceiling_breach,
  any_mutation_ceiling_breach, any_safety_floor_violation,
  any_cost_ceiling_breach OR any_safety_floor_violation AS any_gate_failure
FROM (SELECT fixture, scenario, count(*) AS n_seeds,
        quantile_cont(median_gap_closed, 0.5) AS m, quantile_cont(median_gap_closed, 0.25) AS lo,
        quantile_cont(median_gap_closed, 0.75) AS hi,
        bool_or(COALESCE(cost_ceiling_breach, false)) AS any_cost_ceiling_breach,
        bool_or(COALESCE(av_ceiling_breach, false)) AS any_av_ceiling_breach,
        bool_or(COALESCE(mutation_ceiling_breach, false)) AS any_mutation_ceiling_breach,
        bool_or(COALESCE(safety_floor_evaluated AND NOT safety_floor_holds, false))
          AS any_safety_floor_violation
      FROM verdicts GROUP BY fixture, scenario)""")

q("interval_check", ["run_meta"], f"""
SELECT {_CELL}, count(*) AS n_runs, count(DISTINCT sample_interval_s) AS n_intervals,
  CASE WHEN count(DISTINCT sample_interval_s) = 1 THEN min(sample_interval_s) END AS window_s,
  count(DISTINCT sample_interval_s) = 1 AS consistent
FROM run_meta GROUP BY {_CELL}""")

cte("complete_runs", ["run_meta"], "SELECT * FROM run_meta WHERE arm <> 'signup' OR oracle_sf < 0.5")
cte("trials", [], """
SELECT arm, 'events' AS fixture, scenario, CAST(seed AS INTEGER) AS seed
FROM (VALUES ('view'), ('click'), ('purchase'), ('signup')) a(arm), (VALUES ('steady'), ('surge')) b(scenario),
     (VALUES (0), (1), (2), (3)) c(seed)""")
q("coverage", ["trials", "complete_runs"], f"""
WITH t AS (SELECT *, EXISTS (SELECT 1 FROM complete_runs r WHERE r.arm = t.arm AND r.fixture = t.fixture
             AND r.scenario = t.scenario AND r.seed = t.seed) AS done FROM trials t)
SELECT {_CELL}, CASE WHEN count(*) FILTER (done) = 0 THEN 'missing' WHEN count(*) FILTER (NOT done) > 0 THEN 'incomplete'
                     ELSE 'complete' END AS status,
  COALESCE(string_agg(arm, ',' ORDER BY arm) FILTER (NOT done), '') AS missing_arms
FROM t GROUP BY {_CELL}""")

q("pending_trials", ["trials", "complete_runs"], """
SELECT * FROM trials t WHERE NOT EXISTS (SELECT 1 FROM complete_runs r WHERE r.arm = t.arm
  AND r.fixture = t.fixture AND r.scenario = t.scenario AND r.seed = t.seed)""")

q("newest_run", ["complete_runs"], f"""
SELECT arm, {_CELL}, max(run_id) AS run_id, count(*) AS n_runs FROM complete_runs
GROUP BY arm, {_CELL}""")

q("tolerance_join", ["best", "run_meta"], f"""
SELECT b.fixture, b.scenario, b.seed, b.win, b.best_sf, b.best_p95_us, r.run_id
FROM best b JOIN run_meta r ON b.fixture = r.fixture AND b.scenario = r.scenario
  AND b.seed = r.seed AND abs(b.best_sf - r.oracle_sf) < 1e-9""")

q("weighted_median", ["metrics"], """
SELECT arm, seed, round(min(dead_frac), 6) AS weighted_median
FROM (SELECT arm, seed, dead_frac,
        sum(rel_size) OVER (PARTITION BY arm, seed ORDER BY dead_frac
                            RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cw,
        sum(rel_size) OVER (PARTITION BY arm, seed) AS tot
      FROM metrics)
WHERE cw >= tot / 2.0 GROUP BY arm, seed""")

q("percentiles_tps", ["tx_w"], f"""
SELECT {_RUN}, win, CAST(max(n) AS BIGINT) AS tx_count,
  max(CASE WHEN rn = least(greatest((n + 1) // 2, 1), n) THEN latency_us END) AS p50_us,
  max(CASE WHEN rn = least(greatest(CAST(floor(CAST(0.95 AS DOUBLE) * n + 0.5) AS BIGINT), 1), n)
           THEN latency_us END) AS p95_us,
  max(CASE WHEN rn = least(greatest((99 * n + 50) // 100, 1), n) THEN latency_us END) AS p99_us,
  round(max(n) / CAST(86400 AS DOUBLE), 6) AS tps
FROM (SELECT *, row_number() OVER (PARTITION BY {_RUN}, win ORDER BY latency_us) AS rn,
             count(*) OVER (PARTITION BY {_RUN}, win) AS n FROM tx_w)
GROUP BY {_RUN}, win""")

_KEYS4 = "arm, fixture, scenario, seed"
cte("arm_p95", ["p95"], f"SELECT {_KEYS4}, win, p95_us, tx_count FROM p95 WHERE arm <> 'signup'")

q("steady_state", ["arm_p95"], f"""
SELECT {_KEYS4}, win, p95_us,
  CASE WHEN c = 5 THEN round(sd / NULLIF(av, 0), 6) END AS cv,
  CASE WHEN c = 5 THEN sd / NULLIF(av, 0) < 0.10 END AS steady
FROM (SELECT *, stddev_samp(p95_us) OVER w AS sd, avg(p95_us) OVER w AS av, count(p95_us) OVER w AS c
      FROM arm_p95
      WINDOW w AS (PARTITION BY {_KEYS4} ORDER BY win ROWS BETWEEN 4 PRECEDING AND CURRENT ROW))""")

q("band_grading", ["arm_p95"], f"""
SELECT {_KEYS4}, win, p95_us, t0 AS t0_value, round(p95_us / NULLIF(t0, 0)::DOUBLE, 6) AS ratio,
  CASE WHEN p95_us / NULLIF(t0, 0)::DOUBLE IS NULL THEN NULL
       WHEN p95_us / NULLIF(t0, 0)::DOUBLE <= 1 + 0.10 THEN 'healthy'
       WHEN p95_us / NULLIF(t0, 0)::DOUBLE > 1 + 0.25 THEN 'unhealthy' ELSE 'between' END AS band
FROM (SELECT *, arg_min(p95_us, win) OVER (PARTITION BY {_KEYS4}) AS t0 FROM arm_p95)""")

q("phase_split", ["gaps"], f"""
SELECT {_CELL}, win, CASE WHEN win * 86400 >= 15 * 86400 THEN 'B' ELSE 'A' END AS phase,
       round(gap_closed, 6) AS gap_closed FROM gaps""")

q("safety_monotone", ["samples"], """
SELECT cluster_id, relid, count(*) AS checkpoints,
  count(*) FILTER (WHERE relfrozenxid < prev) AS regressions,
  count(*) FILTER (WHERE relfrozenxid < prev) = 0 AS monotone
FROM (SELECT *, lag(relfrozenxid) OVER (PARTITION BY cluster_id, relid ORDER BY snapshot_id) AS prev
      FROM samples)
GROUP BY cluster_id, relid""")

q("proxy_outcome_corr", ["metrics", "tx_log", "arm_p95"], f"""
WITH b AS (SELECT {_KEYS4}, min(epoch_s) AS t0 FROM tx_log WHERE arm <> 'signup' GROUP BY {_KEYS4}),
     px AS (SELECT m.arm, m.fixture, m.scenario, m.seed,
                   (epoch_us(m.sampled_at) // 1000000 - b.t0) // 86400 AS win,
                   avg(m.dead_frac) AS proxy
            FROM metrics m JOIN b USING ({_KEYS4}) GROUP BY ALL),
     j AS (SELECT px.*, CAST(o.p95_us AS DOUBLE) AS outcome FROM px JOIN arm_p95 o USING ({_KEYS4}, win)),
     d AS (SELECT *, proxy - lag(proxy) OVER w AS dp, outcome - lag(outcome) OVER w AS dout
           FROM j WINDOW w AS (PARTITION BY {_KEYS4} ORDER BY win)),
     r AS (SELECT *,
             rank() OVER (PARTITION BY {_KEYS4} ORDER BY dp)
               + (count(*) OVER (PARTITION BY {_KEYS4}, dp) - 1) / 2.0 AS rp,
             rank() OVER (PARTITION BY {_KEYS4} ORDER BY dout)
               + (count(*) OVER (PARTITION BY {_KEYS4}, dout) - 1) / 2.0 AS ro
           FROM d WHERE dp IS NOT NULL AND dout IS NOT NULL)
SELECT {_KEYS4}, count(*) AS n_deltas, round(corr(rp, ro), 6) AS spearman FROM r GROUP BY {_KEYS4}""")

# ---- estimate --------------------------------------------------------------------------
def ewma_sql(prior: str, sample: str, alpha: str) -> str:
    return (f"(CASE WHEN ({sample}) IS NULL THEN {prior} WHEN {prior} IS NULL OR ({alpha}) IS NULL "
            f"THEN {sample} ELSE ({alpha}) * ({sample}) + (1 - ({alpha})) * {prior} END)")


def _tick_sql(tgt: str, prior: str | None) -> str:
    pe = (f"SELECT * FROM {prior}" if prior else
          "SELECT CAST(NULL AS VARCHAR) AS cluster_id, CAST(NULL AS BIGINT) AS relid, "
          "CAST(NULL AS DOUBLE) AS churn_rate, CAST(NULL AS DOUBLE) AS dead_accum_rate, "
          "CAST(NULL AS DOUBLE) AS growth_rate, CAST(NULL AS DOUBLE) AS f_peak_current, "
          "CAST(NULL AS DOUBLE) AS f_trigger_ewma, CAST(NULL AS DOUBLE) AS effectiveness, "
          "CAST(NULL AS BOOLEAN) AS freeze_progressing, "
          "CAST(NULL AS VARCHAR) AS saturation_candidate, CAST(NULL AS INTEGER) AS saturation_streak "
          "WHERE false")
    return f"""
WITH c0 AS (SELECT s.* EXCLUDE (snapshot_id), t.p AS snapshot_id
            FROM samples s JOIN {tgt} t USING (cluster_id) WHERE s.snapshot_id <= t.p
            QUALIFY row_number() OVER (PARTITION BY s.cluster_id, s.relid ORDER BY s.snapshot_id DESC) = 1),
     pv AS (SELECT s.cluster_id, s.relid, s.n_tup_ins, s.n_tup_upd, s.n_tup_del, s.n_dead_tup,
                   s.autovacuum_count, s.reltuples, s.relfrozenxid_age, h.collected_at
            FROM samples s JOIN {tgt} t USING (cluster_id)
            JOIN snapshots h ON h.cluster_id = s.cluster_id AND h.snapshot_id = s.snapshot_id
            WHERE s.snapshot_id < t.p
            QUALIFY row_number() OVER (PARTITION BY s.cluster_id, s.relid ORDER BY s.snapshot_id DESC) = 1),
     pe AS ({pe}),
     calc AS (
       SELECT c.cluster_id, c.relid, c.snapshot_id, h.collected_at, c.last_autovacuum,
         c.autovacuum_count, c.n_dead_tup, c.reltuples, c.relfrozenxid_age, c.relminmxid_age,
         h.def_mxid_freeze_max_age, h.oldest_xmin_owner,
         md.dead_tuple_fraction, md.vacuum_debt_ratio, md.analyze_debt_ratio, md.freeze_debt,
         p.relid IS NULL AS boot,
         (epoch_us(h.collected_at) - epoch_us(p.collected_at)) / 1000000.0 AS dt,
         c.n_tup_ins - p.n_tup_ins AS d_ins, c.n_tup_upd - p.n_tup_upd AS d_upd,
         c.n_tup_del - p.n_tup_del AS d_del, c.n_dead_tup - p.n_dead_tup AS d_dead,
         c.reltuples - p.reltuples AS d_reltup,
         p.n_dead_tup AS prev_dead, p.autovacuum_count AS prev_avc, p.relfrozenxid_age AS prev_frzage,
         pe.churn_rate AS pe_churn, pe.dead_accum_rate AS pe_dead_rate, pe.growth_rate AS pe_growth,
         pe.f_peak_current AS pe_fpeak, pe.f_trigger_ewma AS pe_ftrig, pe.effectiveness AS pe_eff,
         pe.freeze_progressing AS pe_frzprog, pe.saturation_candidate AS pe_cand,
         pe.saturation_streak AS pe_streak
       FROM c0 c JOIN snapshots h ON h.cluster_id = c.cluster_id AND h.snapshot_id = c.snapshot_id
       LEFT JOIN pv p ON p.cluster_id = c.cluster_id AND p.relid = c.relid
       LEFT JOIN pe ON pe.cluster_id = c.cluster_id AND pe.relid = c.relid
       LEFT JOIN debt md ON md.cluster_id = c.cluster_id AND md.relid = c.relid),
     der AS (SELECT *, CASE WHEN dt > 0 THEN 1 - exp(-dt / 3600.0) END AS alpha,
                  (NOT boot AND (d_ins < 0 OR d_upd < 0 OR d_del < 0)) AS reset,
                  (NOT boot AND autovacuum_count > prev_avc) AS cycle_boundary FROM calc),
     ds AS (SELECT *,
       {ewma_sql('pe_churn', 'CASE WHEN boot OR reset OR dt <= 0 THEN NULL ELSE (d_ins + d_upd + d_del) / dt END', 'alpha')} AS churn_rate,
       {ewma_sql('pe_dead_rate', 'CASE WHEN boot OR reset OR dt <= 0 THEN NULL ELSE d_dead / dt END', 'alpha')} AS dead_accum_rate,
       {ewma_sql('pe_growth', 'CASE WHEN boot OR dt <= 0 OR reltuples < 0 OR d_reltup < 0 THEN NULL ELSE d_reltup / dt END', 'alpha')} AS growth_rate,
       CASE WHEN cycle_boundary THEN greatest(prev_dead - n_dead_tup, 0) END AS cleanup_per_run,
       CASE WHEN cycle_boundary OR pe_fpeak IS NULL THEN dead_tuple_fraction
            ELSE greatest(pe_fpeak, dead_tuple_fraction) END AS f_peak_current,
       CASE WHEN cycle_boundary THEN {ewma_sql('pe_ftrig', 'pe_fpeak', '0.5')} ELSE pe_ftrig END AS f_trigger_ewma,
       CASE WHEN cycle_boundary THEN {ewma_sql('pe_eff', 'CASE WHEN greatest(prev_dead - n_dead_tup, 0) > 0 THEN 1.0 ELSE 0.0 END', '0.5')}
            ELSE pe_eff END AS effectiveness,
       CASE WHEN cycle_boundary THEN relfrozenxid_age < prev_frzage ELSE pe_frzprog END AS freeze_progressing,
       relminmxid_age::DOUBLE / NULLIF(def_mxid_freeze_max_age, 0) AS mxid_freeze_debt
       FROM der),
     sat AS (SELECT *,
       (last_autovacuum IS NOT NULL AND last_autovacuum > collected_at - INTERVAL 3600 SECOND) AS av_running,
       COALESCE(vacuum_debt_ratio, 0) > 1 AS debt_high,
       COALESCE(effectiveness, 1) < 0.5 AS eff_low,
       (oldest_xmin_owner IS NOT NULL AND oldest_xmin_owner <> 'none') AS horizon_pinned FROM ds),
     fin AS (SELECT *, CASE WHEN debt_high AND NOT av_running THEN 'config'
                            WHEN debt_high AND av_running AND eff_low AND horizon_pinned THEN 'inhibited'
                            WHEN debt_high AND av_running THEN 'io_limited' END AS saturation_candidate
             FROM sat),
     st AS (SELECT *, CAST(CASE WHEN saturation_candidate IS NULL THEN 0
                                WHEN saturation_candidate IS NOT DISTINCT FROM pe_cand THEN pe_streak + 1
                                ELSE 1 END AS INTEGER) AS saturation_streak FROM fin)
SELECT *, CASE WHEN saturation_streak >= 3 THEN saturation_candidate END AS saturation_cause FROM st"""


# Every tick of every relation since its first row, in order, as a recursion over the ticks.
cte("relation_ticks", ["samples", "snapshots"], f"""
SELECT g.*, row_number() OVER (PARTITION BY cluster_id, relid ORDER BY snapshot_id) AS k,
  n_dead_tup::DOUBLE / NULLIF(rt, 0) AS dead_tuple_fraction,
  n_dead_tup::DOUBLE / NULLIF(
    COALESCE(TRY_CAST({opt('reloptions', 'autovacuum_vacuum_threshold')} AS BIGINT), def_vac_threshold)
    + COALESCE(TRY_CAST({opt('reloptions', 'autovacuum_vacuum_scale_factor')} AS DOUBLE),
               def_vac_scale_factor) * rt, 0) AS vacuum_debt_ratio
FROM (
  SELECT h.cluster_id, h.snapshot_id, h.collected_at, h.oldest_xmin_owner, h.def_vac_threshold,
    h.def_vac_scale_factor, f.relid, c.schemaname, c.relname, c.reloptions, c.n_dead_tup,
    c.reltuples, greatest(c.reltuples, 0) AS rt, c.last_autovacuum, c.autovacuum_count,
    c.relfrozenxid_age, p.relid IS NULL AS boot,
    (epoch_us(h.collected_at) - epoch_us(ph.collected_at)) / 1000000.0 AS dt,
    c.n_tup_ins - p.n_tup_ins AS d_ins, c.n_tup_upd - p.n_tup_upd AS d_upd,
    c.n_tup_del - p.n_tup_del AS d_del, c.n_dead_tup - p.n_dead_tup AS d_dead,
    c.reltuples - p.reltuples AS d_reltup, p.n_dead_tup AS prev_dead,
    p.autovacuum_count AS prev_avc, p.relfrozenxid_age AS prev_frzage
  FROM snapshots h
  JOIN (SELECT cluster_id, relid, min(snapshot_id) AS born FROM samples GROUP BY ALL) f
    ON f.cluster_id = h.cluster_id AND h.snapshot_id >= f.born
  ASOF JOIN samples c ON c.cluster_id = h.cluster_id AND c.relid = f.relid AND h.snapshot_id >= c.snapshot_id
  ASOF LEFT JOIN samples p ON p.cluster_id = h.cluster_id AND p.relid = f.relid AND h.snapshot_id > p.snapshot_id
  LEFT JOIN snapshots ph ON ph.cluster_id = p.cluster_id AND ph.snapshot_id = p.snapshot_id) g""")

_ESTATE = ("churn_rate, dead_accum_rate, growth_rate, f_peak_current, f_trigger_ewma, effectiveness, "
           "freeze_progressing, saturation_candidate, saturation_streak")


def _estimate_step(source: str) -> str:
    """One estimate step over rows that carry a tick's inputs and the prior state as pe_*."""
    boundary = "(NOT boot AND autovacuum_count > prev_avc)"
    reset = "(NOT boot AND (d_ins < 0 OR d_upd < 0 OR d_del < 0))"
    alpha = "CASE WHEN dt > 0 THEN 1 - exp(-dt / 3600.0) END"
    cleaned = "CASE WHEN greatest(prev_dead - n_dead_tup, 0) > 0 THEN 1.0 ELSE 0.0 END"
    rate = f"CASE WHEN boot OR {reset} OR dt <= 0 THEN NULL ELSE {{x}} / dt END"
    grow = "CASE WHEN boot OR dt <= 0 OR reltuples < 0 OR d_reltup < 0 THEN NULL ELSE d_reltup / dt END"
    return f"""
SELECT cluster_id, relid, k, snapshot_id, {_ESTATE.replace(", saturation_streak", "")},
  CAST(CASE WHEN saturation_candidate IS NULL THEN 0
            WHEN saturation_candidate IS NOT DISTINCT FROM pe_cand THEN pe_streak + 1
            ELSE 1 END AS INTEGER) AS saturation_streak
FROM (SELECT *, CASE WHEN COALESCE(vacuum_debt_ratio, 0) > 1 THEN
        CASE WHEN NOT COALESCE(last_autovacuum > collected_at - INTERVAL 3600 SECOND, false) THEN 'config'
             WHEN COALESCE(effectiveness, 1) < 0.5 AND COALESCE(oldest_xmin_owner, 'none') <> 'none'
             THEN 'inhibited' ELSE 'io_limited' END END AS saturation_candidate
      FROM (SELECT *,
        {ewma_sql('pe_churn', rate.format(x='(d_ins + d_upd + d_del)'), alpha)} AS churn_rate,
        {ewma_sql('pe_dead_rate', rate.format(x='d_dead'), alpha)} AS dead_accum_rate,
        {ewma_sql('pe_growth', grow, alpha)} AS growth_rate,
        CASE WHEN {boundary} OR pe_fpeak IS NULL THEN dead_tuple_fraction
             ELSE greatest(pe_fpeak, dead_tuple_fraction) END AS f_peak_current,
        CASE WHEN {boundary} THEN {ewma_sql('pe_ftrig', 'pe_fpeak', '0.5')} ELSE pe_ftrig END AS f_trigger_ewma,
        CASE WHEN {boundary} THEN {ewma_sql('pe_eff', cleaned, '0.5')} ELSE pe_eff END AS effectiveness,
        CASE WHEN {boundary} THEN relfrozenxid_age < prev_frzage ELSE pe_frzprog END AS freeze_progressing
      FROM ({source})))"""


_PE = [("DOUBLE", "churn_rate", "pe_churn"), ("DOUBLE", "dead_accum_rate", "pe_dead_rate"),
       ("DOUBLE", "growth_rate", "pe_growth"), ("DOUBLE", "f_peak_current", "pe_fpeak"),
       ("DOUBLE", "f_trigger_ewma", "pe_ftrig"), ("DOUBLE", "effectiveness", "pe_eff"),
       ("BOOLEAN", "freeze_progressing", "pe_frzprog"), ("VARCHAR", "saturation_candidate", "pe_cand"),
       ("INTEGER", "saturation_streak", "pe_streak")]
_first = ", ".join(f"CAST(NULL AS {t}) AS {pe}" for t, _, pe in _PE)
_next = ", ".join(f"r.{c} AS {pe}" for _, c, pe in _PE)
cte("e_all", ["relation_ticks"], f"""
WITH RECURSIVE t AS MATERIALIZED (SELECT * FROM relation_ticks),
rec AS ({_estimate_step(f"SELECT t.*, {_first} FROM t WHERE k = 1")}
  UNION ALL {_estimate_step(f"SELECT t.*, {_next} FROM rec r JOIN t ON t.cluster_id = r.cluster_id AND t.relid = r.relid AND t.k = r.k + 1")})
SELECT * FROM rec""")
cte("e_b1", ["e_all", "tgt"], """
SELECT e.* FROM e_all e JOIN tgt USING (cluster_id) WHERE e.snapshot_id < tgt.p
QUALIFY row_number() OVER (PARTITION BY e.cluster_id, e.relid ORDER BY e.k DESC) = 1""")
cte("e_b0", ["samples", "snapshots", "tgt", "debt", "e_b1"], _tick_sql("tgt", "e_b1"))


def _rcols(cols: list[str], doubles: set[str]) -> str:
    return ", ".join(f"round({c}, 6) AS {c}" if c in doubles else c for c in cols)


_EDBL = {"f_trigger_ewma", "f_peak_current", "vacuum_debt_ratio", "analyze_debt_ratio",
         "freeze_debt", "mxid_freeze_debt", "churn_rate", "dead_accum_rate", "growth_rate",
         "effectiveness", "dt", "alpha"}
q("estimate_tick", ["e_b0"], "SELECT " + _rcols(
    ["cluster_id", "relid", "snapshot_id", "f_trigger_ewma", "f_peak_current",
     "vacuum_debt_ratio", "analyze_debt_ratio", "freeze_debt", "mxid_freeze_debt",
     "churn_rate", "dead_accum_rate", "growth_rate", "cleanup_per_run", "effectiveness",
     "freeze_progressing", "saturation_cause", "saturation_candidate", "saturation_streak"],
    _EDBL) + " FROM e_b0")
q("counter_deltas", ["e_b0"], "SELECT " + _rcols(
    ["cluster_id", "relid", "snapshot_id", "boot", "dt", "d_ins", "d_upd", "d_del", "d_dead",
     "d_reltup"], _EDBL) + " FROM e_b0")
q("cycle_flags", ["e_b0"], "SELECT " + _rcols(
    ["cluster_id", "relid", "alpha", "reset", "cycle_boundary"], _EDBL) + " FROM e_b0")
q("ewma_rates", ["e_b0"], "SELECT " + _rcols(
    ["cluster_id", "relid", "churn_rate", "dead_accum_rate", "growth_rate"], _EDBL) + " FROM e_b0")
q("cycle_stats", ["e_b0"], "SELECT " + _rcols(
    ["cluster_id", "relid", "cleanup_per_run", "f_peak_current", "f_trigger_ewma",
     "effectiveness", "freeze_progressing", "mxid_freeze_debt"], _EDBL) + " FROM e_b0")
q("saturation", ["e_b0"], """SELECT cluster_id, relid, av_running, debt_high, eff_low,
  horizon_pinned, saturation_candidate, saturation_streak, saturation_cause FROM e_b0""")

q("burstiness", ["samples"], """
WITH r AS (SELECT DISTINCT cluster_id, relid, last_autovacuum FROM samples
           WHERE last_autovacuum IS NOT NULL),
     g AS (SELECT *, (epoch_us(last_autovacuum) - epoch_us(lag(last_autovacuum) OVER
                     (PARTITION BY cluster_id, relid ORDER BY last_autovacuum))) / 1000000.0 AS gap
           FROM r)
SELECT cluster_id, relid, count(*) AS n_gaps, round(avg(gap), 6) AS mean_gap_s,
       round(stddev_samp(gap), 6) AS sd_gap_s,
       round(stddev_samp(gap) / NULLIF(avg(gap), 0), 6) AS burstiness
FROM g WHERE gap IS NOT NULL GROUP BY cluster_id, relid""")

q("maintenance_lag", ["samples", "snapshots"], f"""
WITH j AS (SELECT s.*, h.collected_at,
             s.n_dead_tup::DOUBLE / NULLIF(
               COALESCE(TRY_CAST({opt('s.reloptions', 'autovacuum_vacuum_threshold')} AS BIGINT), h.def_vac_threshold)
               + COALESCE(TRY_CAST({opt('s.reloptions', 'autovacuum_vacuum_scale_factor')} AS DOUBLE), h.def_vac_scale_factor)
                 * greatest(s.reltuples, 0), 0) AS vacuum_debt_ratio
           FROM samples s JOIN snapshots h USING (cluster_id, snapshot_id))
SELECT cluster_id, relid, snapshot_id, round(vacuum_debt_ratio, 6) AS vacuum_debt_ratio,
  round(CASE WHEN vacuum_debt_ratio > 1 THEN (epoch_us(collected_at) - epoch_us(
    min(CASE WHEN vacuum_debt_ratio > 1 THEN collected_at END) OVER (
      PARTITION BY cluster_id, relid, last_autovacuum ORDER BY snapshot_id
      ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))) / 1000000.0 END, 6) AS maintenance_lag_s
FROM j""")

# ---- audit-table stand-ins ------------------------------------------------------------
_GRID_TXT = "['0.005', '0.01', '0.02', '0.05', '0.1', '0.2', '0.3', '0.5']"
_SF = "'autovacuum_vacuum_scale_factor'"

cte("actions", [], f"""
SELECT 'n' || CAST(o_orderkey % 3 AS VARCHAR) AS cluster_id, o_orderkey AS action_id, o_orderkey AS batch_id,
  o_orderkey AS decision_id, o_custkey AS relid, 'rel_' || CAST(o_custkey AS VARCHAR) AS relname,
  {_SF} AS actuator, {_GRID_TXT}[(o_orderkey + 3) % 8 + 1] AS old_value,
  {_GRID_TXT}[o_orderkey % 8 + 1] AS new_value,
  CASE WHEN o_orderstatus = 'P' THEN 'failed' ELSE 'applied' END AS status,
  CASE WHEN o_orderstatus = 'P' THEN CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH')
       THEN 'lock_timeout' ELSE 'insufficient_privilege' END END AS failure_reason,
  CASE WHEN o_orderstatus = 'P' THEN 'actuation' END AS failure_class,
  o_orderdate AS applied_at
FROM orders""")

cte("decisions", [], f"""
SELECT 'n' || CAST(o_orderkey % 3 AS VARCHAR) AS cluster_id, o_orderkey AS decision_id,
  CAST((year(o_orderdate) - 1970) * 12 + month(o_orderdate) - 1 AS BIGINT) AS tick_id,
  o_custkey AS relid, {_SF} AS actuator,
  CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'adjust'
       WHEN o_orderpriority = '3-MEDIUM' THEN 'hold'
       WHEN o_orderpriority = '4-NOT SPECIFIED' THEN 'suppressed:user_owned'
       ELSE 'escalate:io_limited' END AS decision,
  {_GRID_TXT}[o_orderkey % 8 + 1] AS proposed_value, o_orderstatus = 'F' AS applied,
  o_orderdate AS created_at
FROM orders""")

cte("ticks", [], """
SELECT 'n' || CAST(o_orderkey % 3 AS VARCHAR) AS cluster_id, o_orderkey AS tick_id, o_orderkey AS snapshot_id,
  o_orderdate AS started_at,
  o_orderdate + to_microseconds(CAST(round(round(o_totalprice / 1000.0, 3) * 1000000) AS BIGINT))
    AS finished_at,
  CASE WHEN o_orderstatus = 'P' AND o_orderpriority = '1-URGENT' THEN 'statement timeout' END AS error
FROM orders""")

cte("diagnostics", [], """
SELECT 'n' || CAST(o_orderkey % 3 AS VARCHAR) AS cluster_id, o_orderkey AS diagnostic_id, o_custkey AS relid,
  o_orderdate AS detected_at,
  CASE WHEN o_orderpriority IN ('1-URGENT', '4-NOT SPECIFIED') THEN 'critical' ELSE 'warning' END
    AS severity,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'long_running_txn' WHEN '2-HIGH' THEN 'io_limited'
       WHEN '3-MEDIUM' THEN 'autovacuum_not_running' WHEN '4-NOT SPECIFIED' THEN 'control_oscillation'
       ELSE 'replication_slot' END AS inhibitor_class,
  CASE WHEN o_orderstatus = 'F' THEN o_orderdate + INTERVAL 1 DAY END AS resolved_at
FROM orders""")


def _policy_sql(src: str, key: str, name: str, cluster: str) -> str:
    return f"""
SELECT 'n' || CAST({cluster} AS VARCHAR) AS cluster_id, lower({name}) AS policy_name,
  'policy of ' || {name} AS description,
  (({key} % 5) - 1) * CAST(0.5 AS DOUBLE) AS aggressiveness,
  ({key} % 4) * CAST(0.1 AS DOUBLE) AS io_budget_fraction,
  CASE WHEN {key} % 2 = 0 THEN 'standard' ELSE 'conservative' END AS freeze_posture,
  to_seconds(CAST(({key} % 3) * 1800 AS BIGINT)) AS min_interval,
  CAST(({key} % 6) * 20 AS INTEGER) AS global_max_changes_per_cycle,
  CAST(({key} % 7) * 150 AS INTEGER) AS daily_mutation_budget,
  CAST({key} % 5 + 1 AS INTEGER) AS n_sustain, {key} % 3 = 1 AS manage_user_owned,
  {key} % 4 <> 3 AS enabled, {key} % 2 = 0 AS advisory_only
FROM {src}"""


cte("policy", [], _policy_sql("supplier", "s_suppkey", "s_name", "s_nationkey"))
cte("policy_next", ["policy"], f"""
SELECT * REPLACE (aggressiveness + CAST(substr(cluster_id, 2) AS INTEGER) * CAST(0.25 AS DOUBLE)
                  AS aggressiveness) FROM policy WHERE cluster_id <> 'n24'
UNION ALL {_policy_sql("nation", "n_nationkey", "n_name", "n_nationkey")}""")

cte("active_policy", ["policy"], """
SELECT * FROM policy WHERE enabled
QUALIFY row_number() OVER (PARTITION BY cluster_id ORDER BY policy_name) = 1""")

cte("override_events", [], """
SELECT 'n' || CAST(r_regionkey % 3 AS VARCHAR) AS cluster_id, make_timestamp(2001, 7, r_regionkey + 1, 0, 0, 0) AS event_at,
  CASE WHEN r_regionkey % 2 = 0 THEN 'force' ELSE 'clear' END AS action,
  CASE r_regionkey WHEN 0 THEN 'degraded' WHEN 2 THEN 'diagnostic' WHEN 4 THEN 'emergency' END
    AS forced_state,
  'maintenance window ' || lower(r_name) AS forced_reason
FROM region""")

cte("clock", ["actions"], "SELECT max(applied_at) AS now FROM actions")

# ---- classify --------------------------------------------------------------


def _classify_sql(tgt: str, prior: str | None) -> str:
    rcp = (f"SELECT * FROM {prior}" if prior else
           "SELECT CAST(NULL AS VARCHAR) AS cluster_id, CAST(NULL AS BIGINT) AS relid, "
           "CAST(NULL AS VARCHAR) AS kind, CAST(NULL AS VARCHAR) AS source, "
           "CAST(NULL AS VARCHAR) AS candidate, CAST(NULL AS INTEGER) AS candidate_streak WHERE false")
    frac = "CAST({x} AS DOUBLE) / (din + dupd + ddel)"
    fi, fu, fd = (frac.format(x="din"), frac.format(x="dupd"), frac.format(x="ddel"))
    sustained = "target_kind IS NOT DISTINCT FROM cur_cand AND cur_streak + 1 >= nsus"
    return f"""
WITH c0 AS (SELECT s.cluster_id, s.relid, s.schemaname, s.relname, s.n_tup_ins, s.n_tup_upd,
                   s.n_tup_del, s.reltuples
            FROM samples s JOIN {tgt} t USING (cluster_id) WHERE s.snapshot_id <= t.p
            QUALIFY row_number() OVER (PARTITION BY s.cluster_id, s.relid ORDER BY s.snapshot_id DESC) = 1),
     pv AS (SELECT s.cluster_id, s.relid, s.n_tup_ins, s.n_tup_upd, s.n_tup_del
            FROM samples s JOIN {tgt} t USING (cluster_id) WHERE s.snapshot_id < t.p
            QUALIFY row_number() OVER (PARTITION BY s.cluster_id, s.relid ORDER BY s.snapshot_id DESC) = 1),
     rcp AS ({rcp}),
     calc AS (SELECT c.*, greatest(c.n_tup_ins - p.n_tup_ins, 0) AS din,
                     greatest(c.n_tup_upd - p.n_tup_upd, 0) AS dupd,
                     greatest(c.n_tup_del - p.n_tup_del, 0) AS ddel,
                     r.kind AS cur_kind, r.source AS cur_source, r.candidate AS cur_cand,
                     r.candidate_streak AS cur_streak, COALESCE(ap.n_sustain, 3) AS nsus
              FROM c0 c LEFT JOIN pv p USING (cluster_id, relid)
              LEFT JOIN rcp r USING (cluster_id, relid) LEFT JOIN active_policy ap USING (cluster_id)),
     cls AS (SELECT *, din + dupd + ddel AS total,
               CASE WHEN din + dupd + ddel >= 50 THEN
                 CASE WHEN {fi} > 0.95 AND {fd} < 0.01 THEN 'append_only'
                      WHEN {fd} > 0.30 AND abs({fd} - {fi}) < 0.10 THEN 'queue'
                      WHEN {fd} > 0.30 THEN 'delete_heavy'
                      WHEN {fu} > 0.30 THEN 'oltp' ELSE 'mixed' END END AS rule_kind
             FROM calc),
     dec AS (SELECT *, COALESCE(rule_kind, cur_kind,
                       CASE WHEN reltuples > 100000 THEN 'archive' ELSE 'mixed' END) AS target_kind
             FROM cls)
SELECT cluster_id, relid, schemaname, relname,
  CASE WHEN cur_kind IS NULL THEN target_kind WHEN cur_source = 'manual' THEN cur_kind
       WHEN target_kind = cur_kind THEN cur_kind WHEN {sustained} THEN target_kind
       ELSE cur_kind END AS kind,
  COALESCE(cur_source, 'auto') AS source,
  CASE WHEN cur_kind IS NULL THEN NULL WHEN cur_source = 'manual' THEN cur_cand
       WHEN target_kind = cur_kind THEN NULL WHEN {sustained} THEN NULL
       ELSE target_kind END AS candidate,
  CAST(CASE WHEN cur_kind IS NULL THEN 0 WHEN cur_source = 'manual' THEN cur_streak
       WHEN target_kind = cur_kind THEN 0 WHEN {sustained} THEN 0
       WHEN target_kind IS NOT DISTINCT FROM cur_cand THEN cur_streak + 1 ELSE 1 END AS INTEGER)
    AS candidate_streak,
  din, dupd, ddel, total, rule_kind
FROM dec"""




def _hysteresis_step(source: str) -> str:
    """One classify step over rows with a tick's write mix and the prior class as o_*."""
    done = "target IS NOT DISTINCT FROM o_cand AND o_streak + 1 >= nsus"
    return f"""
SELECT cluster_id, relid, k, snapshot_id,
  CASE WHEN o_kind IS NULL OR {done} THEN target ELSE o_kind END AS kind, 'auto' AS source,
  CASE WHEN o_kind IS NULL OR target = o_kind OR ({done}) THEN NULL ELSE target END AS candidate,
  CAST(CASE WHEN o_kind IS NULL OR target = o_kind OR ({done}) THEN 0
            WHEN target IS NOT DISTINCT FROM o_cand THEN o_streak + 1 ELSE 1 END AS INTEGER)
    AS candidate_streak
FROM (SELECT *, COALESCE(shown, o_kind, CASE WHEN reltuples > 100000 THEN 'archive' ELSE 'mixed' END)
             AS target FROM ({source}))"""


cte("mixes", ["relation_ticks", "active_policy"], """
SELECT cluster_id, relid, k, snapshot_id, reltuples, nsus,
  CASE WHEN w >= 50 THEN CASE WHEN i / w > 0.95 AND d / w < 0.01 THEN 'append_only'
    WHEN d / w > 0.30 AND abs(d / w - i / w) < 0.10 THEN 'queue' WHEN d / w > 0.30 THEN 'delete_heavy'
    WHEN u / w > 0.30 THEN 'oltp' ELSE 'mixed' END END AS shown
FROM (SELECT *, i + u + d AS w
      FROM (SELECT t.*, COALESCE(ap.n_sustain, 3) AS nsus, greatest(d_ins, 0)::DOUBLE AS i,
              greatest(d_upd, 0)::DOUBLE AS u, greatest(d_del, 0)::DOUBLE AS d
            FROM relation_ticks t LEFT JOIN active_policy ap USING (cluster_id)))""")
cte("c_all", ["mixes"], f"""
WITH RECURSIVE m AS MATERIALIZED (SELECT * FROM mixes),
rec AS ({_hysteresis_step("SELECT m.*, CAST(NULL AS VARCHAR) AS o_kind, CAST(NULL AS VARCHAR) AS o_cand, CAST(NULL AS INTEGER) AS o_streak FROM m WHERE k = 1")}
  UNION ALL {_hysteresis_step("SELECT m.*, r.kind AS o_kind, r.candidate AS o_cand, r.candidate_streak AS o_streak FROM rec r JOIN m ON m.cluster_id = r.cluster_id AND m.relid = r.relid AND m.k = r.k + 1")})
SELECT * FROM rec""")
cte("c_b1", ["c_all", "tgt"], """
SELECT c.* FROM c_all c JOIN tgt USING (cluster_id) WHERE c.snapshot_id < tgt.p
QUALIFY row_number() OVER (PARTITION BY c.cluster_id, c.relid ORDER BY c.k DESC) = 1""")
for _name in ("control_state", "stream_control_state"):
    q(_name, ["e_all", "c_all", "cur"], """
SELECT e.cluster_id, e.relid, s.schemaname, s.relname, round(churn_rate, 6) AS churn_rate,
  round(dead_accum_rate, 6) AS dead_accum_rate, round(growth_rate, 6) AS growth_rate,
  round(f_peak_current, 6) AS f_peak_current, round(f_trigger_ewma, 6) AS f_trigger_ewma,
  round(effectiveness, 6) AS effectiveness, freeze_progressing, saturation_candidate,
  saturation_streak, kind, source, candidate, candidate_streak
FROM e_all e JOIN c_all c USING (cluster_id, relid, k) JOIN cur s USING (cluster_id, relid)
QUALIFY row_number() OVER (PARTITION BY e.cluster_id, e.relid ORDER BY k DESC) = 1""")
cte("c_b0", ["samples", "tgt", "active_policy", "c_b1"], _classify_sql("tgt", "c_b1"))

q("classify_tick", ["c_b0"], """SELECT cluster_id, relid, schemaname, relname, kind, source,
  candidate, candidate_streak FROM c_b0""")
q("write_mix", ["c_b0"], """
SELECT cluster_id, relid, din, dupd, ddel, total,
  round(CASE WHEN rule_kind IS NOT NULL THEN din / total END, 6) AS ins_frac,
  round(CASE WHEN rule_kind IS NOT NULL THEN dupd / total END, 6) AS upd_frac,
  round(CASE WHEN rule_kind IS NOT NULL THEN ddel / total END, 6) AS del_frac, rule_kind
FROM c_b0""")

q("classify_trailing", ["samples", "snapshots"], """
WITH s AS (SELECT s.*, epoch_us(h.collected_at) // 1000000 AS t
           FROM samples s JOIN snapshots h USING (cluster_id, snapshot_id)),
     f AS (SELECT *,
             arg_min(n_tup_ins, t) OVER w AS f_ins, arg_min(n_tup_upd, t) OVER w AS f_upd,
             arg_min(n_tup_del, t) OVER w AS f_del
           FROM s WINDOW w AS (PARTITION BY cluster_id, relid ORDER BY t
                               RANGE BETWEEN 21600 PRECEDING AND CURRENT ROW)),
     d AS (SELECT cluster_id, relid, snapshot_id, greatest(n_tup_ins - f_ins, 0) AS din,
             greatest(n_tup_upd - f_upd, 0) AS dupd, greatest(n_tup_del - f_del, 0) AS ddel FROM f)
SELECT *, round((din + dupd + ddel) / 21600.0, 6) AS write_rate,
  CASE WHEN (din + dupd + ddel) / 21600.0 >= 0 AND din + dupd + ddel >= 50 THEN
    CASE WHEN din / (din + dupd + ddel) > 0.95 AND ddel / (din + dupd + ddel) < 0.01 THEN 'append_only'
         WHEN ddel / (din + dupd + ddel) > 0.30
              AND abs(ddel / (din + dupd + ddel) - din / (din + dupd + ddel)) < 0.10 THEN 'queue'
         WHEN ddel / (din + dupd + ddel) > 0.30 THEN 'delete_heavy'
         WHEN dupd / (din + dupd + ddel) > 0.30 THEN 'oltp' ELSE 'mixed' END END AS trailing_kind
FROM d""")

_GRIDD = "[0.005::DOUBLE, 0.01::DOUBLE, 0.02::DOUBLE, 0.05::DOUBLE, 0.10::DOUBLE, 0.20::DOUBLE, 0.30::DOUBLE, 0.50::DOUBLE]"


def snap_sql(x: str) -> str:
    return f"(SELECT g FROM unnest({_GRIDD}) u(g) ORDER BY abs(g - ({x})), g LIMIT 1)"


q("snap_grid", [], f"""
SELECT round(x, 6) AS x, round({snap_sql('x')}, 6) AS snapped
FROM (SELECT DISTINCT l_discount * 4 + l_tax AS x FROM lineitem)""")

# ---- plan ------------------------------------------------------------------------------------
cte("fold", ["actions"], """
WITH a AS (SELECT * FROM actions WHERE status = 'applied'),
     f AS (SELECT cluster_id, relid, actuator, old_value AS baseline_value FROM a
           QUALIFY row_number() OVER (PARTITION BY cluster_id, relid, actuator
                                      ORDER BY applied_at, action_id) = 1),
     l AS (SELECT cluster_id, relid, actuator, new_value AS current_value FROM a
           QUALIFY row_number() OVER (PARTITION BY cluster_id, relid, actuator
                                      ORDER BY applied_at DESC, action_id DESC) = 1),
     g AS (SELECT cluster_id, relid, actuator, count(*) AS n_applied, max(applied_at) AS set_at
           FROM a GROUP BY ALL)
SELECT g.cluster_id, g.relid, g.actuator, l.current_value,
  f.baseline_value IS NOT NULL AS baseline_explicit, f.baseline_value, g.n_applied, g.set_at,
  CASE WHEN f.baseline_value IS NOT NULL THEN 'SET' ELSE 'RESET' END AS revert_kind
FROM g JOIN f USING (cluster_id, relid, actuator) JOIN l USING (cluster_id, relid, actuator)""")

_CT = ("CASE kind WHEN 'queue' THEN 0.02::DOUBLE WHEN 'delete_heavy' THEN 0.02::DOUBLE "
       "WHEN 'oltp' THEN 0.02::DOUBLE WHEN 'mixed' THEN 0.05::DOUBLE "
       "WHEN 'append_only' THEN 0.20::DOUBLE WHEN 'archive' THEN 0.20::DOUBLE END")
_XSF = opt("s.reloptions", "autovacuum_vacuum_scale_factor")

cte("plan", ["c_b0", "e_b0", "cur", "hdr", "fold", "active_policy"], f"""
WITH base AS (
  SELECT c.cluster_id, c.relid, c.kind, s.reltuples, s.reloptions, {_XSF} AS explicit_value,
    h.def_vac_scale_factor, h.def_vac_threshold, h.oldest_xmin_owner,
    e.saturation_cause, e.freeze_debt, e.mxid_freeze_debt, e.vacuum_debt_ratio, e.effectiveness,
    a.baseline_explicit AS ast_baseline_explicit, a.current_value AS ast_current_value,
    CASE WHEN ap.aggressiveness > 0 THEN ap.aggressiveness ELSE 1.0::DOUBLE END AS aggr,
    COALESCE(ap.manage_user_owned, false) AS manage
  FROM c_b0 c JOIN e_b0 e USING (cluster_id, relid) JOIN cur s USING (cluster_id, relid)
  JOIN hdr h ON h.cluster_id = c.cluster_id
  LEFT JOIN (SELECT * FROM fold WHERE actuator = {_SF}) a USING (cluster_id, relid)
  LEFT JOIN active_policy ap ON ap.cluster_id = c.cluster_id),
t AS (SELECT *, {_CT} AS f_template,
        COALESCE(TRY_CAST(explicit_value AS DOUBLE), def_vac_scale_factor) AS cur_sf,
        COALESCE(TRY_CAST({opt('reloptions', 'autovacuum_vacuum_threshold')} AS BIGINT),
                 def_vac_threshold) AS cur_base,
        (explicit_value IS NOT NULL AND NOT (ast_baseline_explicit IS NOT NULL
           AND NOT ast_baseline_explicit AND explicit_value IS NOT DISTINCT FROM ast_current_value))
          AS sf_user_set,
        (freeze_debt > 0.6 OR COALESCE(mxid_freeze_debt, 0) > 0.6) AS freeze_stress,
        (oldest_xmin_owner IS NOT NULL AND oldest_xmin_owner <> 'none') AS horizon_pinned
      FROM base),
d AS (SELECT *, CASE WHEN freeze_stress THEN 0.005::DOUBLE
                     ELSE least(greatest(f_template / aggr, 0.005::DOUBLE), 0.5::DOUBLE) END AS eff_f
      FROM t),
q AS (SELECT *, {snap_sql('least(greatest(eff_f - CAST(cur_base AS DOUBLE) / greatest(CAST(reltuples AS DOUBLE), 1.0), 0.005), 0.5)')}
               AS sf_target FROM d)
SELECT *, CASE
    WHEN freeze_stress AND horizon_pinned THEN 'escalate:inhibited:' || COALESCE(oldest_xmin_owner, 'unknown')
    WHEN freeze_stress AND sf_target = cur_sf THEN 'hold'
    WHEN freeze_stress THEN 'adjust'
    WHEN saturation_cause = 'inhibited' THEN 'escalate:inhibited:' || COALESCE(oldest_xmin_owner, 'unknown')
    WHEN saturation_cause = 'io_limited' THEN 'escalate:io_limited'
    WHEN saturation_cause = 'config' THEN 'suppressed:not_firing'
    WHEN NOT manage AND sf_user_set THEN 'suppressed:user_owned'
    WHEN sf_target = cur_sf THEN 'hold' ELSE 'adjust' END AS decision
FROM q""")

q("plan_decisions", ["plan"], f"""
SELECT cluster_id, CAST(1 AS BIGINT) AS tick_id, relid, {_SF} AS actuator, decision,
  CAST(sf_target AS VARCHAR) AS proposed_value,
  'class=' || kind || ' f*=' || CAST(f_template AS VARCHAR) AS policy_rule,
  round(CASE WHEN decision = 'adjust' THEN cur_sf - sf_target END, 6) AS estimated_benefit
FROM plan""")

q("ownership", ["plan"], """SELECT cluster_id, relid, explicit_value, ast_baseline_explicit,
  ast_current_value, sf_user_set FROM plan""")

_FRZ = "(e.freeze_debt > 0.6 OR COALESCE(e.mxid_freeze_debt, 0) > 0.6)"
cte("found", ["e_b0", "hdr", "cur"], f"""
SELECT e.cluster_id, e.relid,
  CASE WHEN e.saturation_cause = 'io_limited' THEN 'io_limited'
       WHEN e.saturation_cause = 'config' THEN 'autovacuum_not_running'
       ELSE h.oldest_xmin_owner END AS inhibitor_class,
  CASE WHEN {_FRZ} AND h.oldest_xmin_owner <> 'none' THEN 'critical'
       WHEN e.saturation_cause = 'inhibited' THEN 'critical' ELSE 'warning' END AS severity,
  CASE WHEN e.saturation_cause = 'io_limited'
       THEN 'Vacuum runs but cannot keep up (I/O-bound). More aggressive settings will not help; consider cost limits / more workers (Phase 3).'
       WHEN e.saturation_cause = 'config'
       THEN 'Debt is high but autovacuum has not run. Check that autovacuum is enabled and keeping up; lowering thresholds will not help an already-overdue table.'
       ELSE 'Cleanup blocked by ' || h.oldest_xmin_owner || ' (' || COALESCE(h.oldest_xmin_owner_detail, '?')
            || '); clear it -- more vacuuming cannot advance past a pinned xmin horizon.' END
    AS recommendation
FROM e_b0 e JOIN hdr h ON h.cluster_id = e.cluster_id
WHERE (e.cluster_id, e.relid) IN (SELECT (cluster_id, relid) FROM cur)
  AND (e.saturation_cause IN ('inhibited', 'io_limited', 'config')
       OR ({_FRZ} AND h.oldest_xmin_owner <> 'none'))""")

q("findings", ["found"], "SELECT * FROM found")

q("reconcile", ["found", "diagnostics", "cur"], """
WITH d AS (SELECT * FROM diagnostics WHERE resolved_at IS NULL),
     j AS (SELECT f.cluster_id AS fc, f.relid AS fr, f.inhibitor_class AS fcls,
                  d.cluster_id AS dc, d.relid AS dr, d.inhibitor_class AS dcls, d.diagnostic_id
           FROM found f FULL OUTER JOIN d ON f.cluster_id = d.cluster_id AND f.relid = d.relid
             AND f.inhibitor_class IS NOT DISTINCT FROM d.inhibitor_class),
     a AS (SELECT j.*, CASE WHEN dr IS NULL THEN 'open' WHEN fr IS NOT NULL THEN 'keep'
                    WHEN c.relid IS NOT NULL AND dcls IS DISTINCT FROM 'control_oscillation'
                    THEN 'resolve' END AS action
           FROM j LEFT JOIN (SELECT DISTINCT cluster_id, relid FROM cur) c
             ON c.cluster_id = j.dc AND c.relid = j.dr)
SELECT COALESCE(fc, dc) AS cluster_id, COALESCE(fr, dr) AS relid,
  CASE WHEN fr IS NOT NULL THEN fcls ELSE dcls END AS inhibitor_class, diagnostic_id, action
FROM a WHERE action IS NOT NULL""")

cte("osc", ["actions", "clock"], f"""
WITH seq AS (SELECT cluster_id, relid, relname, action_id, applied_at,
                    TRY_CAST(new_value AS DOUBLE) AS v
             FROM actions, clock
             WHERE status = 'applied' AND actuator = {_SF} AND relid <> 0
               AND applied_at > clock.now - INTERVAL 3650 DAY),
     dir AS (SELECT *, sign(v - lag(v) OVER w) AS d FROM seq
             WINDOW w AS (PARTITION BY cluster_id, relid ORDER BY applied_at, action_id)),
     rev AS (SELECT *, lag(d) OVER w AS prev_d FROM dir
             WINDOW w AS (PARTITION BY cluster_id, relid ORDER BY applied_at, action_id))
SELECT cluster_id, relid, max(relname) AS relname,
  count(*) FILTER (WHERE d <> 0 AND prev_d <> 0 AND d <> prev_d) AS reversals,
  count(*) AS n_changes, min(applied_at) AS first_at, max(applied_at) AS last_at,
  array_to_string(list(CAST(v AS VARCHAR) ORDER BY applied_at, action_id), ',') AS recent_values
FROM rev GROUP BY cluster_id, relid
HAVING count(*) FILTER (WHERE d <> 0 AND prev_d <> 0 AND d <> prev_d) >= 2""")

q("oscillation", ["osc"], "SELECT * FROM osc")

q("oscillation_reconcile", ["osc", "diagnostics"], """
WITH d AS (SELECT cluster_id, relid, diagnostic_id FROM diagnostics
           WHERE resolved_at IS NULL AND inhibitor_class = 'control_oscillation')
SELECT o.cluster_id, o.relid, 'control_oscillation' AS inhibitor_class, 'critical' AS severity,
  d.diagnostic_id, o.reversals, o.n_changes, o.first_at, o.last_at,
  CASE WHEN d.diagnostic_id IS NULL THEN 'open' ELSE 'keep' END AS action
FROM osc o LEFT JOIN d USING (cluster_id, relid)
UNION ALL
SELECT cluster_id, relid, 'control_oscillation', 'critical', diagnostic_id, NULL, NULL, NULL, NULL,
  'resolve' FROM d WHERE NOT EXISTS (SELECT 1 FROM osc o WHERE o.cluster_id = d.cluster_id AND o.relid = d.relid)""")

q("tick_summary", ["decisions"], """
SELECT cluster_id, tick_id, count(*) AS n_decisions, count(DISTINCT relid) AS n_relations,
  count(*) FILTER (WHERE applied) AS n_applied,
  count(*) FILTER (WHERE decision = 'adjust') AS n_adjust
FROM decisions GROUP BY cluster_id, tick_id""")

q("static_settings", ["c_b0", "cur"], """
SELECT c.cluster_id, c.relid, c.kind,
  CASE c.kind WHEN 'oltp' THEN 0.02::DOUBLE WHEN 'queue' THEN 0.005::DOUBLE
       WHEN 'delete_heavy' THEN 0.01::DOUBLE WHEN 'mixed' THEN 0.05::DOUBLE
       WHEN 'append_only' THEN 0.20::DOUBLE WHEN 'archive' THEN 0.20::DOUBLE END AS static_sf,
  CASE WHEN s.reltuples >= 1e8 THEN CAST(100000 AS BIGINT) END AS static_threshold
FROM c_b0 c JOIN cur s USING (cluster_id, relid)""")

q("sustained_deviation", ["decisions"], f"""
WITH d AS (SELECT cluster_id, relid, tick_id, decision_id,
             CAST(list_position({_GRIDD}, TRY_CAST(proposed_value AS DOUBLE)) AS INTEGER) AS level
           FROM decisions),
     n AS (SELECT *, COALESCE(level <> lag(level) OVER w, true) AS isnew FROM d
           WINDOW w AS (PARTITION BY cluster_id, relid ORDER BY tick_id, decision_id)),
     r AS (SELECT *, sum(CAST(isnew AS INTEGER)) OVER (PARTITION BY cluster_id, relid
             ORDER BY tick_id, decision_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run_id
           FROM n),
     r2 AS (SELECT *, row_number() OVER (PARTITION BY cluster_id, relid, run_id
                                         ORDER BY tick_id, decision_id) AS run_len FROM r),
     runs AS (SELECT cluster_id, relid, run_id, any_value(level) AS run_level FROM r GROUP BY ALL),
     runs2 AS (SELECT *, lag(run_level) OVER w AS prev_level,
                 sign(lag(run_level) OVER w - lag(run_level, 2) OVER w) AS prev_dir
               FROM runs WINDOW w AS (PARTITION BY cluster_id, relid ORDER BY run_id)),
     j AS (SELECT r2.*, runs2.prev_level, runs2.prev_dir, r2.level - runs2.prev_level AS step
           FROM r2 JOIN runs2 USING (cluster_id, relid, run_id))
SELECT cluster_id, relid, tick_id, decision_id, level, CAST(run_len AS INTEGER) AS run_len,
  abs(step) AS level_distance,
  COALESCE(sign(step) * prev_dir < 0, false) AS reversal,
  run_len >= 3 AND COALESCE(abs(step) >= CASE WHEN COALESCE(sign(step) * prev_dir < 0, false)
                                              THEN 2 ELSE 1 END, true) AS eligible
FROM j""")

q("fold_actions", ["fold"], "SELECT * FROM fold")

# ---- health ---------------------------------------------------------------------------------
cte("self_health", ["inventory"], """
SELECT cluster_id, CAST(sum(bytes) AS BIGINT) AS total_bytes,
  CAST(sum(dead_tuples) AS BIGINT) AS total_dead_tuples,
  count(*) FILTER (WHERE relation = 'relation_samples') AS raw_partitions,
  count(*) FILTER (WHERE relation IN ('rollup_1m', 'rollup_1h', 'rollup_1d')) AS rollup_partitions,
  min(CASE WHEN relation = 'relation_samples' THEN range_start END) AS oldest_raw_partition,
  CAST(4000000 AS BIGINT) AS budget_bytes,
  CAST(4000000 - sum(bytes) AS BIGINT) AS bytes_under_budget,
  sum(bytes) > 4000000 AS over_budget
FROM inventory GROUP BY cluster_id""")

_H = "INTERVAL 3600 SECOND"
_D = "INTERVAL 86400 SECOND"
cte("gmetrics", ["actions", "snapshots", "ticks", "self_health", "osc", "clock"], f"""
WITH k AS (SELECT cluster_id FROM actions UNION SELECT cluster_id FROM snapshots
           UNION SELECT cluster_id FROM ticks),
     a AS (SELECT cluster_id,
       count(*) FILTER (WHERE status = 'applied' AND applied_at > now - {_H}) AS applied_actions_last_hour,
       count(*) FILTER (WHERE status = 'applied' AND applied_at > now - {_D}) AS applied_actions_last_day,
       count(*) FILTER (WHERE status = 'failed' AND applied_at > now - {_H}) AS failed_actions_last_hour,
       count(*) FILTER (WHERE status = 'failed' AND applied_at > now - {_D}) AS failed_actions_last_day,
       count(*) FILTER (WHERE failure_reason = 'lock_timeout' AND applied_at > now - {_H}) AS lock_timeouts_last_hour,
       count(*) FILTER (WHERE failure_reason = 'lock_timeout' AND applied_at > now - {_D}) AS lock_timeouts_last_day,
       min(applied_at) AS oldest_action_at
       FROM actions, clock GROUP BY cluster_id),
     s AS (SELECT cluster_id, max(collected_at) AS newest_snapshot_at,
                  arg_max(client_backends, snapshot_id) AS client_backends,
                  arg_max(max_connections, snapshot_id) AS max_connections
           FROM snapshots GROUP BY cluster_id),
     t AS (SELECT cluster_id, arg_max(started_at, tick_id) AS last_tick_started_at,
                  arg_max(finished_at, tick_id) AS last_tick_finished_at,
                  arg_max(dur, tick_id) AS last_tick_duration_s,
                  max(dur) FILTER (WHERE started_at > now - {_D}) AS max_tick_duration_last_day_s,
                  count(*) FILTER (WHERE error IS NOT NULL AND started_at > now - {_D}) AS tick_errors_last_day,
                  max(finished_at) AS last_successful_tick_at
           FROM (SELECT *, (epoch_us(finished_at) - epoch_us(started_at)) / 1000000.0 AS dur FROM ticks), clock
           GROUP BY cluster_id),
     o AS (SELECT cluster_id, count(*) AS c FROM osc GROUP BY cluster_id)
SELECT k.cluster_id, sh.total_bytes AS storage_bytes, sh.over_budget,
  COALESCE(a.applied_actions_last_hour, 0) AS applied_actions_last_hour,
  COALESCE(a.applied_actions_last_day, 0) AS applied_actions_last_day,
  COALESCE(a.failed_actions_last_hour, 0) AS failed_actions_last_hour,
  COALESCE(a.failed_actions_last_day, 0) AS failed_actions_last_day,
  COALESCE(a.lock_timeouts_last_hour, 0) AS lock_timeouts_last_hour,
  COALESCE(a.lock_timeouts_last_day, 0) AS lock_timeouts_last_day,
  a.oldest_action_at, s.newest_snapshot_at, s.client_backends, s.max_connections,
  s.client_backends::DOUBLE / NULLIF(s.max_connections, 0) AS connection_pressure,
  round(100.0 * s.client_backends::DOUBLE / NULLIF(s.max_connections, 0)) AS connection_pressure_pct,
  t.last_tick_started_at, t.last_tick_finished_at, t.last_tick_duration_s,
  t.max_tick_duration_last_day_s, COALESCE(t.tick_errors_last_day, 0) AS tick_errors_last_day,
  t.last_successful_tick_at, COALESCE(o.c, 0) AS oscillating_relations,
  (epoch_us(clock.now) - epoch_us(s.newest_snapshot_at)) / 1000000.0 AS observation_lag_s,
  (epoch_us(clock.now) - epoch_us(t.last_successful_tick_at)) / 1000000.0 AS control_loop_lag_s
FROM k CROSS JOIN clock LEFT JOIN self_health sh USING (cluster_id) LEFT JOIN a USING (cluster_id)
LEFT JOIN s USING (cluster_id) LEFT JOIN t USING (cluster_id) LEFT JOIN o USING (cluster_id)""")

_ORD = ("CASE {s} WHEN 'normal' THEN 0 WHEN 'degraded' THEN 1 WHEN 'diagnostic' THEN 2 "
        "WHEN 'emergency' THEN 3 WHEN 'disabled' THEN 4 END")

def _health_sql(source: str, key: str) -> str:
    return ("""
WITH m AS (SELECT g.*, COALESCE(ap.daily_mutation_budget, 500) AS budget
           FROM {source} g LEFT JOIN active_policy ap USING (cluster_id)),
 c AS (
  SELECT {key}, 'normal' AS state, 'all self-monitoring signals within bounds' AS reason, 0 AS sig FROM m
  UNION ALL SELECT {key},
    CASE WHEN observation_lag_s > 3600 THEN 'emergency' WHEN observation_lag_s > 600 THEN 'degraded' ELSE 'normal' END,
    CASE WHEN observation_lag_s > 600 THEN format('observation lag {}s — telemetry is stale', CAST(round(observation_lag_s) AS BIGINT)) END, 1 FROM m
  UNION ALL SELECT {key},
    CASE WHEN control_loop_lag_s > 3600 THEN 'emergency' WHEN control_loop_lag_s > 1200 THEN 'degraded' ELSE 'normal' END,
    CASE WHEN control_loop_lag_s > 1200 THEN format('control loop lag {}s — no successful control cycle', CAST(round(control_loop_lag_s) AS BIGINT)) END, 2 FROM m
  UNION ALL SELECT {key},
    CASE WHEN failed_actions_last_hour > 10 THEN 'diagnostic' WHEN failed_actions_last_hour > 3 THEN 'degraded' ELSE 'normal' END,
    CASE WHEN failed_actions_last_hour > 3 THEN format('{} failed actions in the last hour', failed_actions_last_hour) END, 3 FROM m
  UNION ALL SELECT {key},
    CASE WHEN lock_timeouts_last_hour > 10 THEN 'diagnostic' ELSE 'normal' END,
    CASE WHEN lock_timeouts_last_hour > 10 THEN format('{} lock timeouts in the last hour', lock_timeouts_last_hour) END, 4 FROM m
  UNION ALL SELECT {key}, CASE WHEN over_budget THEN 'degraded' ELSE 'normal' END,
    CASE WHEN over_budget THEN 'governor storage footprint over budget' END, 5 FROM m
  UNION ALL SELECT {key}, CASE WHEN applied_actions_last_day >= budget THEN 'degraded' ELSE 'normal' END,
    CASE WHEN applied_actions_last_day >= budget THEN format('daily mutation budget spent ({} applied in the last day)', applied_actions_last_day) END, 6 FROM m
  UNION ALL SELECT {key}, CASE WHEN oscillating_relations > 0 THEN 'diagnostic' ELSE 'normal' END,
    CASE WHEN oscillating_relations > 0 THEN format('{} relation(s) oscillating — control is flapping', oscillating_relations) END, 7 FROM m
  UNION ALL SELECT {key}, CASE WHEN connection_pressure >= 0.9 THEN 'diagnostic' ELSE 'normal' END,
    CASE WHEN connection_pressure >= 0.9 THEN format('connection pressure {}% ({}/{} client backends) — shedding load, actuation suspended',
      CAST(connection_pressure_pct AS BIGINT), client_backends, max_connections) END, 8 FROM m)
SELECT {key}, state, reason FROM c
QUALIFY row_number() OVER (PARTITION BY {key} ORDER BY """ + _ORD.format(s="state") + """ DESC,
                                        (reason IS NOT NULL) DESC, sig) = 1""").replace("{source}", source).replace("{key}", key)


cte("health", ["gmetrics", "active_policy"], _health_sql("gmetrics", "cluster_id"))

cte("gov_state", ["health", "override_events"], f"""
WITH ev AS (SELECT cluster_id, arg_max(action, event_at) AS action,
                   arg_max(forced_state, event_at) AS forced_state,
                   arg_max(forced_reason, event_at) AS forced_reason
            FROM override_events GROUP BY cluster_id),
     j AS (SELECT h.*, CASE WHEN ev.action = 'force' AND ev.forced_state <> 'normal'
                            THEN ev.forced_state END AS forced, ev.forced_reason
           FROM health h LEFT JOIN ev USING (cluster_id))
SELECT cluster_id, state AS computed_state, forced,
  CASE WHEN forced IS NOT NULL AND {_ORD.format(s='forced')} >= {_ORD.format(s='state')}
       THEN forced ELSE state END AS state,
  CASE WHEN forced IS NOT NULL AND {_ORD.format(s='forced')} >= {_ORD.format(s='state')}
       THEN format('operator-forced {{}}: {{}}', forced, COALESCE(forced_reason, '(no reason given)'))
       ELSE reason END AS reason
FROM j""")

_GM_ROUND = ("* REPLACE (round(connection_pressure, 6) AS connection_pressure, "
             "round(connection_pressure_pct, 6) AS connection_pressure_pct, "
             "round(last_tick_duration_s, 6) AS last_tick_duration_s, "
             "round(max_tick_duration_last_day_s, 6) AS max_tick_duration_last_day_s, "
             "round(observation_lag_s, 6) AS observation_lag_s, "
             "round(control_loop_lag_s, 6) AS control_loop_lag_s)")
q("governor_metrics", ["gmetrics"], f"SELECT {_GM_ROUND} FROM gmetrics")
q("health_state", ["health"], "SELECT * FROM health")
q("override_floor", ["gov_state"], "SELECT * FROM gov_state")

def _moved(col: str) -> str:
    return (f"make_timestamp(1704067200000000 + CAST(floor((epoch_us(CAST({col} AS TIMESTAMP)) - 694224000000000) / 80) AS BIGINT))")


cte("t_actions", ["actions"], f"SELECT * REPLACE ({_moved('applied_at')} AS applied_at) FROM actions")
cte("t_ticks", ["ticks"], f"""SELECT cluster_id, tick_id, {_moved('started_at')} AS started_at,
  {_moved('started_at')} + (finished_at - started_at) AS finished_at FROM ticks""")
cte("t_inventory", ["inventory"], f"SELECT cluster_id, bytes, {_moved('range_start')} AS range_start FROM inventory")
cte("t_events", ["override_events"], f"SELECT * REPLACE ({_moved('event_at')} AS event_at) FROM override_events")
cte("evals", ["snapshots", "t_ticks", "t_events"], """
SELECT cluster_id, collected_at AS t FROM snapshots UNION SELECT cluster_id, started_at FROM t_ticks
UNION SELECT cluster_id, event_at FROM t_events""")
cte("t_counts", ["evals", "t_actions"], """
SELECT e.cluster_id, e.t,
  count(*) FILTER (status = 'failed' AND applied_at > e.t - INTERVAL 1 HOUR) AS failed_actions_last_hour,
  count(*) FILTER (failure_reason = 'lock_timeout' AND applied_at > e.t - INTERVAL 1 HOUR) AS lock_timeouts_last_hour,
  count(*) FILTER (status = 'applied') AS applied_actions_last_day
FROM evals e JOIN t_actions a ON a.cluster_id = e.cluster_id AND a.applied_at <= e.t
  AND a.applied_at > e.t - INTERVAL 1 DAY GROUP BY ALL""")
cte("t_osc", ["evals", "t_actions"], f"""
WITH s AS (SELECT cluster_id, relid, applied_at AS x, action_id, TRY_CAST(new_value AS DOUBLE) AS v FROM t_actions
           WHERE status = 'applied' AND actuator = {_SF} AND relid <> 0),
 d AS (SELECT *, sign(v - lag(v) OVER w) AS d, lag(x, 2) OVER w AS since FROM s
       WINDOW w AS (PARTITION BY cluster_id, relid ORDER BY x, action_id)),
 r AS (SELECT *, lag(d) OVER (PARTITION BY cluster_id, relid ORDER BY x, action_id) AS p FROM d),
 n AS (SELECT e.cluster_id, e.t, r.relid FROM evals e JOIN r ON r.cluster_id = e.cluster_id AND r.x <= e.t
         AND r.since > e.t - INTERVAL 1 DAY AND r.d <> 0 AND r.p <> 0 AND r.d <> r.p
       GROUP BY ALL HAVING count(*) >= 2)
SELECT cluster_id, t, count(*) AS oscillating_relations FROM n GROUP BY ALL""")
cte("t_seen", ["evals", "snapshots"], """
SELECT e.cluster_id, e.t, max(s.collected_at) AS seen, arg_max(s.client_backends, s.snapshot_id) AS client_backends,
  arg_max(s.max_connections, s.snapshot_id) AS max_connections
FROM evals e JOIN snapshots s ON s.cluster_id = e.cluster_id AND s.collected_at <= e.t GROUP BY ALL""")
cte("t_done", ["evals", "t_ticks"], """
SELECT e.cluster_id, e.t, max(k.finished_at) AS done
FROM evals e JOIN t_ticks k ON k.cluster_id = e.cluster_id AND k.finished_at <= e.t GROUP BY ALL""")
cte("t_bytes", ["evals", "t_inventory"], """
SELECT e.cluster_id, e.t, sum(i.bytes) AS bytes
FROM evals e JOIN t_inventory i ON i.cluster_id = e.cluster_id AND i.range_start <= e.t GROUP BY ALL""")
cte("t_metrics", ["evals", "t_counts", "t_osc", "t_seen", "t_done", "t_bytes"], """
SELECT e.cluster_id, e.t AS evaluated_at, (epoch_us(e.t) - epoch_us(seen)) / 1000000.0 AS observation_lag_s,
  (epoch_us(e.t) - epoch_us(done)) / 1000000.0 AS control_loop_lag_s,
  COALESCE(failed_actions_last_hour, 0) AS failed_actions_last_hour,
  COALESCE(lock_timeouts_last_hour, 0) AS lock_timeouts_last_hour,
  COALESCE(applied_actions_last_day, 0) AS applied_actions_last_day,
  COALESCE(oscillating_relations, 0) AS oscillating_relations, COALESCE(bytes, 0) > 4000000 AS over_budget,
  client_backends::DOUBLE / NULLIF(max_connections, 0) AS connection_pressure,
  round(100 * client_backends::DOUBLE / NULLIF(max_connections, 0)) AS connection_pressure_pct, client_backends, max_connections
FROM evals e LEFT JOIN t_counts USING (cluster_id, t) LEFT JOIN t_osc USING (cluster_id, t)
  LEFT JOIN t_seen USING (cluster_id, t) LEFT JOIN t_done USING (cluster_id, t) LEFT JOIN t_bytes USING (cluster_id, t)""")
cte("t_health", ["t_metrics", "active_policy"], _health_sql("t_metrics", "cluster_id, evaluated_at"))
cte("t_forced", ["t_health", "t_events"], """
SELECT h.cluster_id, h.evaluated_at, arg_max(v.action, v.event_at) AS action,
  arg_max(v.forced_state, v.event_at) AS forced_state, arg_max(v.forced_reason, v.event_at) AS forced_reason
FROM t_health h JOIN t_events v ON v.cluster_id = h.cluster_id AND v.event_at <= h.evaluated_at GROUP BY ALL""")
cte("transitions", ["t_health", "t_forced"], f"""
WITH j AS (SELECT h.*, CASE WHEN action = 'force' AND forced_state <> 'normal' THEN forced_state END AS forced, forced_reason
           FROM t_health h LEFT JOIN t_forced USING (cluster_id, evaluated_at)),
 b AS (SELECT *, forced IS NOT NULL AND {_ORD.format(s='forced')} >= {_ORD.format(s='state')} AS binds FROM j),
 l AS (SELECT cluster_id, evaluated_at, CASE WHEN binds THEN forced ELSE state END AS to_state,
         CASE WHEN binds THEN format('operator-forced {{}}: {{}}', forced, COALESCE(forced_reason, '(no reason given)'))
              ELSE reason END AS reason FROM b),
 m AS (SELECT *, lag(to_state) OVER (PARTITION BY cluster_id ORDER BY evaluated_at) AS from_state FROM l)
SELECT cluster_id, from_state, to_state, reason, evaluated_at AS transitioned_at
FROM m WHERE to_state IS DISTINCT FROM from_state""")
q("state_transitions", ["transitions"], "SELECT * FROM transitions")

q("failure_taxonomy", ["gmetrics", "actions", "clock"], f"""
WITH m AS (SELECT * FROM gmetrics),
 rec AS (SELECT cluster_id, failure_class, count(*) AS n FROM actions, clock
         WHERE status = 'failed' AND failure_class IS NOT NULL AND applied_at > now - {_D}
         GROUP BY ALL),
 c AS (
  SELECT cluster_id, 'observation' AS failure_class, COALESCE(observation_lag_s > 600, false) AS condition_present,
    CASE WHEN COALESCE(observation_lag_s > 600, false)
         THEN format('observation lag {{}}s — telemetry is stale', CAST(round(observation_lag_s) AS BIGINT))
         ELSE 'telemetry fresh' END AS detail FROM m
  UNION ALL SELECT cluster_id, 'decision',
    tick_errors_last_day > 0 OR COALESCE(control_loop_lag_s > 1200, false),
    CASE WHEN tick_errors_last_day > 0 THEN format('{{}} control cycle(s) errored in the last day', tick_errors_last_day)
         WHEN COALESCE(control_loop_lag_s > 1200, false)
         THEN format('no successful control cycle in {{}}s — the control loop is stalled', CAST(round(control_loop_lag_s) AS BIGINT))
         ELSE 'no cycle errors' END FROM m
  UNION ALL SELECT cluster_id, 'actuation', failed_actions_last_hour > 0,
    CASE WHEN failed_actions_last_day > 0
         THEN format('{{}} failed action(s) in the last hour, {{}} in the last day', failed_actions_last_hour, failed_actions_last_day)
         ELSE 'no failed actions' END FROM m
  UNION ALL SELECT cluster_id, 'resource', COALESCE(over_budget, false),
    CASE WHEN COALESCE(over_budget, false) THEN format('governor storage footprint over budget ({{}} bytes)', storage_bytes)
         ELSE 'within storage budget' END FROM m
  UNION ALL SELECT cluster_id, 'safety', oscillating_relations > 0,
    CASE WHEN oscillating_relations > 0 THEN format('{{}} relation(s) oscillating — control is flapping', oscillating_relations)
         ELSE 'no safety-class failures' END FROM m)
SELECT c.cluster_id, c.failure_class, c.condition_present,
  COALESCE(rec.n, 0) AS recorded_failures_last_day, c.detail
FROM c LEFT JOIN rec USING (cluster_id, failure_class)""")

q("catalog_health", ["actions", "snapshots", "clock"], f"""
WITH a AS (SELECT cluster_id,
             count(*) FILTER (WHERE status = 'applied' AND applied_at > now - {_H}) AS mutations_last_hour,
             count(*) FILTER (WHERE status = 'applied' AND applied_at > now - {_D}) AS mutations_last_day,
             count(*) FILTER (WHERE status = 'failed' AND applied_at > now - {_D}) AS failed_last_day,
             count(DISTINCT relid) FILTER (WHERE status = 'applied' AND applied_at > now - {_D})
               AS relations_changed_last_day
           FROM actions, clock GROUP BY cluster_id),
     s AS (SELECT * FROM snapshots QUALIFY row_number() OVER (PARTITION BY cluster_id ORDER BY snapshot_id DESC) = 1)
SELECT s.cluster_id, COALESCE(a.mutations_last_hour, 0) AS mutations_last_hour,
  COALESCE(a.mutations_last_day, 0) AS mutations_last_day,
  COALESCE(a.failed_last_day, 0) AS failed_last_day,
  COALESCE(a.relations_changed_last_day, 0) AS relations_changed_last_day,
  s.pg_class_size_bytes, s.pg_class_n_dead_tup, s.pg_class_n_live_tup,
  s.pg_class_last_autovacuum, s.collected_at
FROM s LEFT JOIN a USING (cluster_id)""")

q("active_diagnostics", ["diagnostics"], """
SELECT cluster_id, diagnostic_id, detected_at, severity, relid, inhibitor_class
FROM diagnostics WHERE resolved_at IS NULL""")

q("governor_status", ["c_b0", "e_b0", "decisions", "fold", "active_policy"], f"""
WITH last AS (SELECT * FROM decisions
              QUALIFY row_number() OVER (PARTITION BY cluster_id, relid ORDER BY decision_id DESC) = 1)
SELECT c.cluster_id, c.relid, c.schemaname, c.relname, c.kind,
  round(e.f_trigger_ewma, 6) AS observed_dead_fraction,
  round(least(greatest({_CT.replace('kind', 'c.kind')} /
        CASE WHEN ap.aggressiveness > 0 THEN ap.aggressiveness ELSE 1.0::DOUBLE END, 0.005), 0.5), 6)
    AS target_dead_fraction,
  round(e.vacuum_debt_ratio, 6) AS vacuum_debt_ratio, round(e.freeze_debt, 6) AS freeze_debt,
  e.saturation_cause, l.decision, l.proposed_value, l.applied, l.created_at AS last_decision_at,
  f.current_value AS current_scale_factor
FROM c_b0 c LEFT JOIN active_policy ap ON ap.cluster_id = c.cluster_id
LEFT JOIN e_b0 e ON e.cluster_id = c.cluster_id AND e.relid = c.relid
LEFT JOIN last l ON l.cluster_id = c.cluster_id AND l.relid = c.relid
LEFT JOIN (SELECT * FROM fold WHERE actuator = {_SF}) f ON f.cluster_id = c.cluster_id AND f.relid = c.relid""")

# ---- retention and governance -------------------------------------------------------------------
q("storage_budget", ["inventory"], """
SELECT * FROM (
  SELECT cluster_id, schema_name, relation,
    CASE WHEN relation IS NOT NULL THEN 'relation' WHEN schema_name IS NOT NULL THEN 'schema'
         ELSE 'cluster' END AS level,
    CAST(COALESCE(sum(bytes), 0) AS BIGINT) AS bytes,
    CAST(COALESCE(sum(dead_tuples), 0) AS BIGINT) AS dead_tuples, count(*) AS partitions
  FROM inventory GROUP BY ROLLUP (cluster_id, schema_name, relation))
WHERE cluster_id IS NOT NULL""")

q("self_health", ["self_health"], "SELECT * FROM self_health")

q("audit_retention", ["actions", "decisions", "ticks", "diagnostics", "clock", "transitions"], """
WITH a AS (SELECT a.*, a.applied_at < clock.now - INTERVAL 180 DAY AS dr FROM actions a, clock),
 kept AS (SELECT DISTINCT cluster_id, decision_id FROM a WHERE NOT dr),
 d AS (SELECT d.*, d.created_at < clock.now - INTERVAL 180 DAY AND k.decision_id IS NULL AS dr
       FROM decisions d CROSS JOIN clock
       LEFT JOIN kept k ON k.cluster_id = d.cluster_id AND k.decision_id = d.decision_id),
 t AS (SELECT t.*, t.started_at < clock.now - INTERVAL 180 DAY AS dr FROM ticks t, clock),
 g AS (SELECT g.*, g.resolved_at IS NOT NULL AND g.detected_at < clock.now - INTERVAL 365 DAY AS dr
       FROM diagnostics g, clock)
SELECT cluster_id, 'action_history' AS relation, count(*) FILTER (WHERE dr) AS deleted,
       count(*) FILTER (WHERE NOT dr) AS kept FROM a GROUP BY cluster_id
UNION ALL SELECT cluster_id, 'decision_log', count(*) FILTER (WHERE dr), count(*) FILTER (WHERE NOT dr) FROM d GROUP BY cluster_id
UNION ALL SELECT cluster_id, 'tick_log', count(*) FILTER (WHERE dr), count(*) FILTER (WHERE NOT dr) FROM t GROUP BY cluster_id
UNION ALL SELECT cluster_id, 'diagnostics', count(*) FILTER (WHERE dr), count(*) FILTER (WHERE NOT dr) FROM g GROUP BY cluster_id
UNION ALL SELECT cluster_id, 'state_transitions', count(*) FILTER (WHERE transitioned_at < now - INTERVAL 180 DAY),
  count(*) FILTER (WHERE NOT transitioned_at < now - INTERVAL 180 DAY) FROM transitions, clock GROUP BY cluster_id""")

q("shedding_plan", ["inventory", "diagnostics", "actions", "decisions", "ticks", "clock"], """
WITH inv AS (SELECT cluster_id, sum(bytes) AS inv_total,
               sum(bytes) FILTER (WHERE relation = 'relation_samples' AND range_end <= now - INTERVAL 7 DAY) AS raw,
               sum(bytes) FILTER (WHERE relation = 'rollup_1m' AND range_end <= now - INTERVAL 2 DAY) AS fine,
               sum(bytes) FILTER (WHERE relation IN ('rollup_1h', 'rollup_1d') AND range_end <= now - INTERVAL 30 DAY) AS coarse
             FROM inventory, clock GROUP BY cluster_id),
 dg AS (SELECT cluster_id, count(*) * 200 AS diag_total,
          count(*) FILTER (WHERE resolved_at IS NOT NULL AND detected_at <= now - INTERVAL 30 DAY) * 200 AS diag
        FROM diagnostics, clock GROUP BY cluster_id),
 log AS (SELECT cluster_id, applied_at <= now - INTERVAL 30 DAY AS old FROM actions, clock
   UNION ALL SELECT cluster_id, started_at <= now - INTERVAL 30 DAY FROM ticks, clock
   UNION ALL SELECT cluster_id, created_at <= now - INTERVAL 30 DAY AND NOT EXISTS (
     SELECT 1 FROM actions a WHERE a.cluster_id = x.cluster_id AND a.decision_id = x.decision_id
       AND NOT a.applied_at <= (SELECT now FROM clock) - INTERVAL 30 DAY) FROM decisions x, clock),
 ac AS (SELECT cluster_id, count(*) * 200 AS act_total, count(*) FILTER (WHERE old) * 200 AS act
        FROM log GROUP BY cluster_id),
 j AS (SELECT COALESCE(inv.cluster_id, dg.cluster_id, ac.cluster_id) AS cluster_id,
          COALESCE(inv_total, 0) + COALESCE(diag_total, 0) + COALESCE(act_total, 0) AS total,
          raw, fine, coarse, diag, act
       FROM inv FULL OUTER JOIN dg USING (cluster_id) FULL OUTER JOIN ac USING (cluster_id)),
 steps AS (SELECT cluster_id, total, 1 AS step, 'raw' AS level, COALESCE(raw, 0) AS reclaim FROM j
   UNION ALL SELECT cluster_id, total, 2, 'rollups_fine', COALESCE(fine, 0) FROM j
   UNION ALL SELECT cluster_id, total, 3, 'rollups_coarse', COALESCE(coarse, 0) FROM j
   UNION ALL SELECT cluster_id, total, 4, 'diagnostics', COALESCE(diag, 0) FROM j
   UNION ALL SELECT cluster_id, total, 5, 'actions', COALESCE(act, 0) FROM j
   UNION ALL SELECT cluster_id, total, 6, 'policy', 0 FROM j),
 b AS (SELECT *, total - COALESCE(sum(reclaim) OVER (PARTITION BY cluster_id ORDER BY step
                   ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM steps),
 e AS (SELECT *, level <> 'policy' AND before > 4000000 AS executed FROM b)
SELECT cluster_id, step, level,
  CASE WHEN level = 'policy' THEN 'preserved' WHEN executed AND level = 'raw' THEN 'swept'
       WHEN executed THEN 'pruned' ELSE 'skipped:under_budget' END AS action,
  CAST(total - sum(CASE WHEN executed THEN reclaim ELSE 0 END) OVER (PARTITION BY cluster_id
       ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS bytes_after
FROM e""")

q("validate_parameters", ["policy", "active_policy"], """
WITH k AS (SELECT cluster_id, bool_or(enabled) AS anyen FROM policy GROUP BY cluster_id),
 j AS (SELECT k.cluster_id, k.anyen, ap.* EXCLUDE (cluster_id), ap.policy_name IS NOT NULL AS present,
         CAST(epoch(ap.min_interval) AS BIGINT) AS mi
       FROM k LEFT JOIN active_policy ap USING (cluster_id)),
 c AS (
  SELECT cluster_id, true AS present, 'enabled_policy' AS parameter,
    CASE WHEN anyen THEN 'OK' ELSE 'WARNING' END AS status,
    CASE WHEN anyen THEN 'an enabled policy drives the loop'
         ELSE 'no enabled policy — the governor plans and applies nothing' END AS message FROM j
  UNION ALL SELECT cluster_id, present, 'aggressiveness',
    CASE WHEN aggressiveness IS NULL OR aggressiveness <= 0 THEN 'CRITICAL' ELSE 'OK' END,
    format('aggressiveness = {}; must be > 0 (targets are class_template / aggressiveness, clamped to [{}, {}])',
           printf('%.3f', aggressiveness), '0.005', '0.50') FROM j
  UNION ALL SELECT cluster_id, present, 'daily_mutation_budget',
    CASE WHEN daily_mutation_budget < 0 THEN 'CRITICAL' WHEN daily_mutation_budget = 0 THEN 'WARNING' ELSE 'OK' END,
    format('daily_mutation_budget = {} (0 means the governor can never apply a change)', daily_mutation_budget) FROM j
  UNION ALL SELECT cluster_id, present, 'global_max_changes_per_cycle',
    CASE WHEN global_max_changes_per_cycle < 0 THEN 'CRITICAL' WHEN global_max_changes_per_cycle = 0 THEN 'WARNING' ELSE 'OK' END,
    format('global_max_changes_per_cycle = {} (0 means no change is ever applied per cycle)', global_max_changes_per_cycle) FROM j
  UNION ALL SELECT cluster_id, present, 'min_interval',
    CASE WHEN mi < 0 THEN 'CRITICAL' WHEN mi = 0 THEN 'WARNING' ELSE 'OK' END,
    format('min_interval = {}s (0 removes the per-relation rate limit)', mi) FROM j
  UNION ALL SELECT cluster_id, present, 'n_sustain', CASE WHEN n_sustain < 1 THEN 'WARNING' ELSE 'OK' END,
    format('n_sustain = {} (below 1 disables classification hysteresis — risks flapping)', n_sustain) FROM j
  UNION ALL SELECT cluster_id, present, 'manage_user_owned', CASE WHEN manage_user_owned THEN 'WARNING' ELSE 'OK' END,
    format('manage_user_owned = {} (true lets the governor overwrite user/other-system reloptions)',
           lower(CAST(manage_user_owned AS VARCHAR))) FROM j
  UNION ALL SELECT cluster_id, present, 'advisory_only', CASE WHEN advisory_only THEN 'OK' ELSE 'WARNING' END,
    format('advisory_only = {} (false: the governor actively applies changes under the health-state gate; true: plans only)',
           lower(CAST(advisory_only AS VARCHAR))) FROM j
  UNION ALL SELECT cluster_id, true, 'storage_budget_bytes', 'OK',
    'budget_bytes = 4000000 (NULL = no storage cap, degrade() disabled)' FROM j)
SELECT cluster_id, parameter, status, message FROM c WHERE present""")

_PF = ["description", "aggressiveness", "io_budget_fraction", "freeze_posture", "min_interval",
       "global_max_changes_per_cycle", "daily_mutation_budget", "n_sustain", "manage_user_owned",
       "enabled", "advisory_only"]
_CHANGED = ("array_to_string(list_filter([" + ", ".join(
    f"CASE WHEN o.{f} IS DISTINCT FROM n.{f} THEN '{f}' END" for f in _PF) + "], lambda x: x IS NOT NULL), ',')")
q("policy_history", ["policy", "policy_next"], f"""
WITH j AS (
  SELECT o.cluster_id AS oc, n.cluster_id AS nc, o.policy_name AS on_, n.policy_name AS nn_,
    o.aggressiveness AS oa, n.aggressiveness AS na, {_CHANGED} AS ch,
    CASE WHEN o.policy_name IS NULL THEN 'insert' WHEN n.policy_name IS NULL THEN 'delete'
         WHEN {" OR ".join(f"o.{f} IS DISTINCT FROM n.{f}" for f in _PF)} THEN 'update' END AS op
  FROM policy o FULL OUTER JOIN policy_next n
    ON o.cluster_id = n.cluster_id AND o.policy_name = n.policy_name)
SELECT COALESCE(oc, nc) AS cluster_id, COALESCE(on_, nn_) AS policy_name, op AS operation,
  CASE WHEN op = 'update' THEN ch END AS changed_fields,
  round(oa, 6) AS old_aggressiveness, round(na, 6) AS new_aggressiveness
FROM j WHERE op IS NOT NULL""")

q("literal_audit", [], r"""
WITH t AS (SELECT doc_id AS text_id, regexp_replace(text, '--[^\n]*', '', 'g') AS b FROM documents),
 u AS (SELECT text_id, 'quoted' AS kind, unnest(regexp_extract_all(b, '(''[0-9][^'']*'')', 1)) AS literal FROM t
       UNION ALL
       SELECT text_id, 'bare', unnest(regexp_extract_all(regexp_replace(b, '''[^'']*''', '', 'g'),
                                                         '\b([0-9]+\.?[0-9]*)\b', 1)) FROM t)
SELECT text_id, kind, literal, count(*) AS n FROM u
WHERE literal NOT IN ('0', '1', '0.0', '1.0') GROUP BY ALL""")

cte("tx_log_li", [], """
SELECT l_returnflag AS arm, 'lineitem' AS fixture, l_linestatus AS scenario, 1 AS seed,
  CAST(NULL AS DOUBLE) AS probe_sf, CAST(round(l_extendedprice * 100) AS BIGINT) AS latency_us,
  epoch_us(l_shipdate) // 1000000 AS epoch_s
FROM lineitem""")

q("window_p95_lineitem", ["tx_log_li"], f"""
WITH w AS (SELECT *, (epoch_s - min(epoch_s) OVER (PARTITION BY {_RUN})) // 604800 AS win FROM tx_log_li)
SELECT {_RUN}, win, max(CASE WHEN rn = k THEN latency_us END) AS p95_us, CAST(max(n) AS BIGINT) AS tx_count
FROM (SELECT *, least(greatest(CAST(floor(CAST(0.95 AS DOUBLE) * n + 0.5) AS BIGINT), 1), n) AS k
      FROM (SELECT *, row_number() OVER (PARTITION BY {_RUN}, win ORDER BY latency_us) AS rn,
                   count(*) OVER (PARTITION BY {_RUN}, win) AS n FROM w))
GROUP BY {_RUN}, win""")

q("experiment_sampler", ["cur", "actions"], """
WITH ap AS (SELECT cluster_id, relid, count(*) AS candidate_applied FROM actions
            WHERE status = 'applied' GROUP BY ALL)
SELECT c.cluster_id, c.relid, c.relname,
  round(c.n_dead_tup::DOUBLE / NULLIF(c.n_live_tup + c.n_dead_tup, 0), 6) AS dead_frac,
  c.total_size_bytes AS rel_size, c.relfrozenxid_age AS xid_age, c.relminmxid_age AS mxid_age,
  c.autovacuum_count AS av_count, c.last_autovacuum AS av_last,
  COALESCE(ap.candidate_applied, 0) AS candidate_applied
FROM cur c LEFT JOIN ap USING (cluster_id, relid)""")

cte("tick_split", ["collected", "dense", "tgt"], f"""
SELECT c.*, c.snapshot_id = t.p AS is_cur FROM collected c JOIN tgt t USING (cluster_id)""")

_SIGF = [c.strip() for c in _SIG.split(",")]


def _sig(alias: str) -> str:
    return "struct_pack(" + ", ".join(f"{f} := {alias}.{f}" for f in _SIGF) + ")"


q("change_join", ["tick_split"], f"""
WITH cur AS (SELECT * FROM tick_split WHERE is_cur),
     ls AS (SELECT * FROM tick_split WHERE NOT is_cur
            QUALIFY row_number() OVER (PARTITION BY cluster_id, relid ORDER BY snapshot_id DESC) = 1)
SELECT c.cluster_id, c.relid, c.snapshot_id, c.n_dead_tup, c.n_tup_ins, c.autovacuum_count
FROM cur c LEFT JOIN ls l ON l.cluster_id = c.cluster_id AND l.relid = c.relid
WHERE l.relid IS NULL OR {_sig('c')} IS DISTINCT FROM {_sig('l')}""")

q("last_state", ["tick_split", "dense", "tgt"], """
WITH cur AS (SELECT * FROM tick_split WHERE is_cur),
     ls AS (SELECT * FROM tick_split WHERE NOT is_cur
            QUALIFY row_number() OVER (PARTITION BY cluster_id, relid ORDER BY snapshot_id DESC) = 1),
     live AS (SELECT DISTINCT d.cluster_id, d.relid FROM dense d JOIN tgt t
              ON d.cluster_id = t.cluster_id AND d.snapshot_id = t.p),
     kept AS (SELECT * FROM ls WHERE (cluster_id, relid) IN (SELECT (cluster_id, relid) FROM live)
                AND (cluster_id, relid) NOT IN (SELECT (cluster_id, relid) FROM cur))
SELECT cluster_id, relid, snapshot_id, n_dead_tup, n_tup_ins, autovacuum_count FROM kept
UNION ALL SELECT cluster_id, relid, snapshot_id, n_dead_tup, n_tup_ins, autovacuum_count FROM cur""")

q("top_debt", ["debt"], """
SELECT cluster_id, relid, schemaname, relname, n_dead_tup, n_mod_since_analyze, reltuples,
  round(vacuum_threshold, 6) AS vacuum_threshold, round(analyze_threshold, 6) AS analyze_threshold,
  round(dead_tuple_fraction, 6) AS dead_tuple_fraction, round(mod_fraction, 6) AS mod_fraction,
  round(vacuum_debt_ratio, 6) AS vacuum_debt_ratio, round(analyze_debt_ratio, 6) AS analyze_debt_ratio,
  round(freeze_debt, 6) AS freeze_debt
FROM debt ORDER BY vacuum_debt_ratio DESC NULLS LAST, cluster_id, relid LIMIT 20""")

q("failures_by_class", ["actions", "clock"], """
SELECT cluster_id, failure_class, count(*) AS failures FROM actions, clock
WHERE status = 'failed' AND applied_at > now - INTERVAL 86400 SECOND
GROUP BY cluster_id, failure_class""")

q("plannable_snapshot", ["e_b0"], """
SELECT cluster_id, max(snapshot_id) AS plan_snapshot_id, count(*) AS estimated_relations
FROM e_b0 GROUP BY cluster_id""")

cte("tree_sizes", ["inventory"], """
WITH RECURSIVE i AS MATERIALIZED (SELECT *, relation || '_y' || strftime(range_start, '%Y') AS y FROM inventory),
     sizes AS (SELECT cluster_id, partition AS name, bytes, dead_tuples FROM i
               UNION ALL SELECT DISTINCT cluster_id, relation, CAST(8192 AS BIGINT), CAST(0 AS BIGINT) FROM i
               UNION ALL SELECT DISTINCT cluster_id, y, CAST(8192 AS BIGINT), CAST(0 AS BIGINT) FROM i),
     tree AS (SELECT DISTINCT cluster_id, relation AS parent, y AS child FROM i
              UNION SELECT cluster_id, y, partition FROM i),
     members(cluster_id, top, member) AS (
       SELECT DISTINCT s.cluster_id, s.name, s.name FROM sizes s
       WHERE NOT EXISTS (SELECT 1 FROM tree t WHERE t.cluster_id = s.cluster_id AND t.child = s.name)
       UNION SELECT m.cluster_id, m.top, t.child FROM members m JOIN tree t ON t.cluster_id = m.cluster_id AND t.parent = m.member)
SELECT m.cluster_id, m.top, m.member, s.bytes, s.dead_tuples
FROM members m LEFT JOIN sizes s ON s.cluster_id = m.cluster_id AND s.name = m.member""")
q("storage_by_parent", ["tree_sizes"], """
SELECT cluster_id, top AS relation, CAST(COALESCE(sum(bytes), 0) AS BIGINT) AS bytes,
       CAST(COALESCE(sum(dead_tuples), 0) AS BIGINT) AS dead_tuples, count(*) AS members
FROM tree_sizes GROUP BY cluster_id, top""")

q("stream_change_detection", ["collected"], f"""
SELECT cluster_id, relid, snapshot_id
FROM (SELECT *, lag(struct_pack({_SIG})) OVER (PARTITION BY cluster_id, relid
                                               ORDER BY snapshot_id) AS _prev
      FROM collected)
WHERE _prev IS NULL OR _prev IS DISTINCT FROM struct_pack({_SIG})""")

ORACLE["stream_rollup_1m"] = ORACLE["rollup_1m"]
ORACLE["stream_rollup_1d"] = ORACLE["rollup_1d"]
ORACLE["colocated_tick"] = ORACLE["estimate_tick"]
q("distinct_sketches", ["decisions"], """
SELECT cluster_id, CAST((year(created_at) - 1970) * 12 + month(created_at) - 1 AS INTEGER) AS month,
  count(DISTINCT relid) AS n_relations, true AS within_error
FROM decisions GROUP BY 1, 2""")
_TIER_COUNTS = " UNION ALL ".join(f"""
SELECT cluster_id, '{tier}' AS relation, '{span}' AS span, CAST(date_trunc('{span}', bucket_start) AS TIMESTAMP) AS range_start,
  count(*) AS approx_rows FROM ({ORACLE[tier]}) GROUP BY ALL""" for tier, span in (("rollup_1m", "day"), ("rollup_1h", "month"), ("rollup_1d", "month")))
ORACLE["stored_inventory"] = f"""
SELECT cluster_id, relation, relation || '_' || CASE span WHEN 'day' THEN strftime(range_start, '%Y%m%d') ELSE strftime(range_start, '%Y%m') END AS partition,
  span, range_start, CAST(CASE span WHEN 'day' THEN range_start + INTERVAL 1 DAY ELSE range_start + INTERVAL 1 MONTH END AS TIMESTAMP) AS range_end,
  approx_rows, true AS has_bytes
FROM ({_TIER_COUNTS})"""
ORACLE["stream_tier_upsert"] = ORACLE["rollup_1d"]
ORACLE["stream_control_tick"] = ORACLE["estimate_tick"]

for _name, _state, _needs in (("admit_over_ticks", "CAST(NULL AS VARCHAR)", []), ("admit_actions", "g.state", ["gov_state"])):
    _join = "LEFT JOIN gov_state g ON g.cluster_id = d.cluster_id" if _needs else ""
    q(_name, ["decisions", "cur", "fold", "actions", "active_policy", *_needs], f"""
WITH dec AS (SELECT *, max(created_at) OVER (PARTITION BY cluster_id, tick_id) AS tick_now
             FROM decisions WHERE actuator = {_SF}
             QUALIFY row_number() OVER (PARTITION BY cluster_id, tick_id, relid ORDER BY decision_id DESC) = 1),
 d AS (SELECT * FROM dec WHERE decision = 'adjust'),
 applied AS (SELECT * FROM actions WHERE status = 'applied'),
 tick_used AS (SELECT a.cluster_id, dd.tick_id, count(*) AS tick_used
               FROM applied a JOIN decisions dd ON dd.decision_id = a.decision_id AND dd.cluster_id = a.cluster_id GROUP BY ALL),
 j AS (SELECT d.cluster_id, d.tick_id, d.decision_id, d.relid, d.proposed_value, d.tick_now,
         {_state} AS gov_state, c.relid IS NOT NULL AS is_live,
         {opt('c.reloptions', 'autovacuum_vacuum_scale_factor')} AS live_value,
         f.relid IS NOT NULL AS have_state, f.baseline_explicit AS bexp, f.current_value AS gov_value,
         COALESCE(epoch(ap.min_interval), 3600) AS min_int_s,
         COALESCE(ap.global_max_changes_per_cycle, 50) AS cap,
         COALESCE(ap.daily_mutation_budget, 500) AS budget,
         COALESCE(ap.manage_user_owned, false) AS manage,
         COALESCE(tu.tick_used, 0) AS tick_used
       FROM d {_join}
       LEFT JOIN cur c ON c.cluster_id = d.cluster_id AND c.relid = d.relid
       LEFT JOIN (SELECT * FROM fold WHERE actuator = {_SF}) f ON f.cluster_id = d.cluster_id AND f.relid = d.relid
       LEFT JOIN active_policy ap ON ap.cluster_id = d.cluster_id
       LEFT JOIN tick_used tu ON tu.cluster_id = d.cluster_id AND tu.tick_id = d.tick_id),
 j2 AS (SELECT j.*,
          EXISTS (SELECT 1 FROM applied a WHERE a.cluster_id = j.cluster_id AND a.relid = j.relid
                  AND a.applied_at > j.tick_now - to_microseconds(CAST(j.min_int_s * 1000000 AS BIGINT))
                  AND a.applied_at <= j.tick_now) AS interval_hit,
          (SELECT count(*) FROM applied a WHERE a.cluster_id = j.cluster_id
             AND a.applied_at > j.tick_now - INTERVAL 86400 SECOND AND a.applied_at <= j.tick_now) AS day_used
        FROM j),
 p AS (SELECT *, CASE
         WHEN gov_state IN ('diagnostic', 'emergency', 'disabled') THEN 'authority'
         WHEN NOT is_live THEN 'vanished'
         WHEN live_value IS NOT DISTINCT FROM proposed_value THEN 'noop'
         WHEN NOT COALESCE(TRY_CAST(proposed_value AS DOUBLE) BETWEEN 0.005 AND 0.5
                           AND NOT isnan(TRY_CAST(proposed_value AS DOUBLE)), false) THEN 'invalid_value'
         WHEN NOT manage AND live_value IS NOT NULL
              AND NOT COALESCE(have_state AND NOT bexp AND live_value IS NOT DISTINCT FROM gov_value, false)
              THEN 'user_owned'
         WHEN interval_hit THEN 'min_interval' END AS pre
       FROM j2),
 rk AS (SELECT *, CASE WHEN pre IS NULL THEN sum(CASE WHEN pre IS NULL THEN 1 ELSE 0 END) OVER
                 (PARTITION BY cluster_id, tick_id ORDER BY decision_id
                  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) END AS rnk FROM p)
SELECT cluster_id, tick_id, decision_id, relid, proposed_value,
  reason IS NULL AS admitted, reason AS refusal_reason
FROM (SELECT *, CASE WHEN pre IS NOT NULL THEN pre WHEN tick_used + rnk > cap THEN 'cycle_cap'
                     WHEN day_used + rnk > budget THEN 'daily_budget' END AS reason FROM rk)""")
