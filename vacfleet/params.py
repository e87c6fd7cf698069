"""Governed constants.

FIXED VALUES: the numbers below must equal the reference controller's parameter
registry for results to match; they are stated once, plainly, in natural order.
Operators take a ``Params`` so a caller can override any of them per run.
"""

from __future__ import annotations

from dataclasses import dataclass, field

# ---- FIXED VALUES (reference parameter registry) ----------------------------------
SF_MIN = 0.005
SF_MAX = 0.50
FREEZE_THR = 0.6
DAILY_MUTATION_BUDGET = 500
GLOBAL_MAX_CHANGES_PER_CYCLE = 50
MIN_INTERVAL_SECONDS = 3600            # '1 hour'
EWMA_TAU_SECONDS = 3600.0
EWMA_EFFA = 0.5
SATURATION_PERSISTENCE_K = 3
CLASS_PERSISTENCE_N_SUSTAIN = 3
CLASSIFY_FLOOR = 50
CLASSIFY_LARGE = 100000.0
CLASSIFY_APPEND_ONLY_INS_FRAC = 0.95
CLASSIFY_DELETE_FRAC = 0.30
CLASSIFY_QUEUE_BALANCE_FRAC = 0.10
CLASSIFY_APPEND_ONLY_DEL_FRAC = 0.01
EFF_LOW = 0.5
AV_RUNNING_WINDOW_SECONDS = 3600       # '1 hour'
CLASS_TARGETS = {
    "queue": 0.02,
    "delete_heavy": 0.02,
    "oltp": 0.02,
    "mixed": 0.05,
    "append_only": 0.20,
    "archive": 0.20,
}
SF_GRID = (0.005, 0.01, 0.02, 0.05, 0.10, 0.20, 0.30, 0.50)
AGGRESSIVENESS = 1.0
MANAGE_USER_OWNED = False
ADVISORY_ONLY = True
KEEP_DECISIONS_DAYS = 180
KEEP_ACTIONS_DAYS = 180
KEEP_TICKS_DAYS = 180
KEEP_DIAGNOSTICS_DAYS = 365
KEEP_TRANSITIONS_DAYS = 180
HEALTH_LAG_DEGRADED_SECS = 600
HEALTH_LAG_EMERGENCY_SECS = 3600
HEALTH_CONTROL_LAG_DEGRADED_SECS = 1200
HEALTH_CONTROL_LAG_EMERGENCY_SECS = 3600
HEALTH_FAILED_DEGRADED = 3
HEALTH_FAILED_DIAGNOSTIC = 10
HEALTH_LOCK_TIMEOUTS_DIAGNOSTIC = 10
OSCILLATION_WINDOW_SECONDS = 86400     # '1 day'
OSCILLATION_MIN_REVERSALS = 2
LOAD_SHED_CONNECTION_PCT = 0.9
RING_SLOTS = 8
RAW_KEEP_DAYS = 7
ROLLUP_KEEP_DAYS = {"1m": 7, "1h": 90, "1d": 365}
ROLLUP_LOOKBACK_SECONDS = 3 * 86400    # rollup() default lookback '3 days'
STATIC_LARGE_TABLE_ROWS = 1e8          # expert-static arm: very large tables
STATIC_LARGE_TABLE_THRESHOLD = 100000
# experiment analysis
WARMUP_FRACTION = 0.20
STRONG_PASS_GAP = 0.25
AV_CEILING_FACTOR = 2
STEADY_STATE_CV = 0.10
STEADY_STATE_WINDOWS = 5
PROXY_BAND_HEALTHY = 0.10
PROXY_BAND_UNHEALTHY = 0.25
# health states in severity order (ordinal = position)
HEALTH_STATES = ("normal", "degraded", "diagnostic", "emergency", "disabled")
ACTUATION_FAILURES = ("lock_timeout", "insufficient_privilege", "conflicting_ddl")
ACTUATOR_SF = "autovacuum_vacuum_scale_factor"
# ------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Params:
    """One run's parameters (defaults = the fixed values above)."""

    sf_min: float = SF_MIN
    sf_max: float = SF_MAX
    freeze_thr: float = FREEZE_THR
    daily_mutation_budget: int = DAILY_MUTATION_BUDGET
    max_changes_per_cycle: int = GLOBAL_MAX_CHANGES_PER_CYCLE
    min_interval_s: int = MIN_INTERVAL_SECONDS
    ewma_tau: float = EWMA_TAU_SECONDS
    ewma_effa: float = EWMA_EFFA
    saturation_k: int = SATURATION_PERSISTENCE_K
    n_sustain: int = CLASS_PERSISTENCE_N_SUSTAIN
    classify_floor: int = CLASSIFY_FLOOR
    classify_large: float = CLASSIFY_LARGE
    ins_frac: float = CLASSIFY_APPEND_ONLY_INS_FRAC
    del_frac: float = CLASSIFY_DELETE_FRAC
    bal_frac: float = CLASSIFY_QUEUE_BALANCE_FRAC
    aodel_frac: float = CLASSIFY_APPEND_ONLY_DEL_FRAC
    eff_low: float = EFF_LOW
    av_window_s: int = AV_RUNNING_WINDOW_SECONDS
    class_targets: dict = field(default_factory=lambda: dict(CLASS_TARGETS))
    sf_grid: tuple = SF_GRID
    aggressiveness: float = AGGRESSIVENESS
    manage_user_owned: bool = MANAGE_USER_OWNED
    oscillation_window_s: int = OSCILLATION_WINDOW_SECONDS
    oscillation_min_reversals: int = OSCILLATION_MIN_REVERSALS
    load_shed_pct: float = LOAD_SHED_CONNECTION_PCT
    ring_slots: int = RING_SLOTS


DEFAULT = Params()
