"""Policy validation, policy change log and the literal audit."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vacfleet import params as P
from vacfleet.functions import exprs as X
from vacfleet.operators.classify import active_policy

POLICY_FIELDS = ["description", "aggressiveness", "io_budget_fraction", "freeze_posture",
                 "min_interval", "global_max_changes_per_cycle", "daily_mutation_budget",
                 "n_sustain", "manage_user_owned", "enabled", "advisory_only"]


def validate_parameters(policy: DataFrame, budget_bytes: int | None = None) -> DataFrame:
    """D27 (U5): nine graded checks per cluster over the whole fleet's policy table, built
    with one ``inline`` over one row per cluster (a single scan of the policy table)."""
    has_enabled = policy.groupBy("cluster_id").agg(F.bool_or("enabled").alias("_any"))
    act = active_policy(policy)
    j = has_enabled.join(act, "cluster_id", "left")
    mi = F.unix_micros(F.lit("1970-01-01 00:00:00").cast("timestamp") + F.col("min_interval")) / 1e6
    ap = F.col("policy_name").isNotNull()      # an enabled policy exists

    def chk(name, status, message, present=ap):
        return F.when(present, F.struct(F.lit(name).alias("parameter"), status.alias("status"),
                                        message.alias("message")))

    def grade(v, crit, warn):
        return F.when(crit, F.lit("CRITICAL")).when(warn, F.lit("WARNING")).otherwise(F.lit("OK"))

    b = F.lit(budget_bytes).cast("long")
    checks = F.array(
        F.struct(F.lit("enabled_policy").alias("parameter"),
                 F.when(F.col("_any"), F.lit("OK")).otherwise(F.lit("WARNING")).alias("status"),
                 F.when(F.col("_any"), F.lit("an enabled policy drives the loop"))
                  .otherwise(F.lit("no enabled policy — the governor plans and applies nothing"))
                  .alias("message")),
        chk("aggressiveness",
            F.when(F.col("aggressiveness").isNull() | (F.col("aggressiveness") <= 0),
                   F.lit("CRITICAL")).otherwise(F.lit("OK")),
            F.format_string("aggressiveness = %s; must be > 0 (targets are class_template / "
                            "aggressiveness, clamped to [%s, %s])",
                            F.format_number("aggressiveness", 3), F.lit(str(P.SF_MIN)),
                            F.lit("0.50"))),
        chk("daily_mutation_budget",
            grade("daily_mutation_budget", F.col("daily_mutation_budget") < 0,
                  F.col("daily_mutation_budget") == 0),
            F.format_string("daily_mutation_budget = %s (0 means the governor can never apply "
                            "a change)", F.col("daily_mutation_budget"))),
        chk("global_max_changes_per_cycle",
            grade("global_max_changes_per_cycle", F.col("global_max_changes_per_cycle") < 0,
                  F.col("global_max_changes_per_cycle") == 0),
            F.format_string("global_max_changes_per_cycle = %s (0 means no change is ever "
                            "applied per cycle)", F.col("global_max_changes_per_cycle"))),
        chk("min_interval", grade(mi, mi < 0, mi == 0),
            F.format_string("min_interval = %ss (0 removes the per-relation rate limit)",
                            mi.cast("long"))),
        chk("n_sustain",
            F.when(F.col("n_sustain") < 1, F.lit("WARNING")).otherwise(F.lit("OK")),
            F.format_string("n_sustain = %s (below 1 disables classification hysteresis — "
                            "risks flapping)", F.col("n_sustain"))),
        chk("manage_user_owned",
            F.when(F.col("manage_user_owned"), F.lit("WARNING")).otherwise(F.lit("OK")),
            F.format_string("manage_user_owned = %s (true lets the governor overwrite "
                            "user/other-system reloptions)",
                            F.lower(F.col("manage_user_owned").cast("string")))),
        chk("advisory_only",
            F.when(F.col("advisory_only"), F.lit("OK")).otherwise(F.lit("WARNING")),
            F.format_string("advisory_only = %s (false: the governor actively applies changes "
                            "under the health-state gate; true: plans only)",
                            F.lower(F.col("advisory_only").cast("string")))),
        F.struct(F.lit("storage_budget_bytes").alias("parameter"),
                 F.when(b.isNotNull() & (b < 0), F.lit("CRITICAL")).otherwise(F.lit("OK"))
                  .alias("status"),
                 F.format_string("budget_bytes = %s (NULL = no storage cap, degrade() disabled)",
                                 F.coalesce(b.cast("string"), F.lit("NULL"))).alias("message")))
    rows = j.select("cluster_id", F.explode(checks).alias("c")).filter(F.col("c").isNotNull())
    return rows.select("cluster_id", "c.parameter", "c.status", "c.message")


def policy_history(old: DataFrame, new: DataFrame, changed_at=None) -> DataFrame:
    """The change log between two versions of the policy table: insert, update or
    delete per (cluster, policy) with the old and new rows as JSON and the changed fields."""
    key = ["cluster_id", "policy_name"]
    o = old.select(*key, F.struct(*POLICY_FIELDS).alias("o"))
    n = new.select(*key, F.struct(*POLICY_FIELDS).alias("n"))
    j = o.join(n, key, "full_outer")
    op = (F.when(F.col("o").isNull(), F.lit("insert")).when(F.col("n").isNull(), F.lit("delete"))
          .when(~F.col("o").eqNullSafe(F.col("n")), F.lit("update")))
    changed = F.filter(F.array(*[F.when(~F.col(f"o.{f}").eqNullSafe(F.col(f"n.{f}")), F.lit(f))
                                 for f in POLICY_FIELDS]), lambda x: x.isNotNull())
    opts = {"ignoreNullFields": "false"}
    return j.withColumn("operation", op).filter(F.col("operation").isNotNull()).select(
        *key, "operation",
        F.when(F.col("operation") == "update", F.array_join(changed, ",")).alias("changed_fields"),
        F.to_json(F.col("o"), opts).alias("old_row"), F.to_json(F.col("n"), opts).alias("new_row"),
        F.col("o.aggressiveness").alias("old_aggressiveness"),
        F.col("n.aggressiveness").alias("new_aggressiveness"))


# FIXED VALUES: the structural allowlist of the literal audit.
ALLOWED_LITERALS = ("0", "1", "0.0", "1.0")
QUOTED = r"('[0-9][^']*')"
BARE = r"\b([0-9]+\.?[0-9]*)\b"


def literal_audit(texts: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """D30 (P25, U4): numeric literals in each whole text outside the allowlist, with line
    comments stripped: quoted quantities starting with a digit, and bare numbers once every
    quoted string is removed. One row per (text, literal, kind) with its count."""
    body = F.regexp_replace(F.col(text_col), r"--[^\n]*", "")
    t = texts.select(F.col(id_col).alias("text_id"), body.alias("_b"))

    def found(kind, where, pattern):
        return F.transform(F.regexp_extract_all(where, F.lit(pattern), 1),
                           lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("literal")))

    both = F.concat(found("quoted", F.col("_b"), QUOTED),
                    found("bare", F.regexp_replace("_b", r"'[^']*'", ""), BARE))
    u = (t.select("text_id", F.inline(both))  # one scan for both kinds
         .filter(~F.col("literal").isin(*ALLOWED_LITERALS)))
    return u.groupBy("text_id", "kind", "literal").agg(F.count("*").alias("n"))
