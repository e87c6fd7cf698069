"""Scalar column functions (survey P1-P28).

All are pure ``Column -> Column`` builders over Spark built-ins, so they stay inside
whole-stage codegen; none is a Python UDF.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from vacfleet import params as P

ColumnOrName = Column | str

# PostgreSQL reports age() of the permanent transaction ids (1 bootstrap, 2 frozen)
# as INT_MAX; 0 means "no id".
INT32_MAX = 2147483647
XID_MODULUS = 4294967296


def col(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


def as_ts(c: ColumnOrName) -> Column:
    """TIMESTAMP view of a TIMESTAMP or TIMESTAMP_NTZ column (session zone is UTC)."""
    return col(c).cast("timestamp")


def as_ntz(c: ColumnOrName) -> Column:
    return col(c).cast("timestamp_ntz")


def epoch_seconds(c: ColumnOrName) -> Column:
    """Whole and fractional seconds since 1970 as DOUBLE."""
    return F.unix_micros(as_ts(c)) / F.lit(1_000_000.0)


def epoch_micros(c: ColumnOrName) -> Column:
    return F.unix_micros(as_ts(c))


def seconds_between(later: ColumnOrName, earlier: ColumnOrName) -> Column:
    """EXTRACT(epoch FROM later - earlier) as DOUBLE."""
    return (epoch_micros(later) - epoch_micros(earlier)) / F.lit(1_000_000.0)


def minus_seconds(ts: ColumnOrName, seconds: int | float) -> Column:
    return col(ts) - F.make_dt_interval(secs=F.lit(float(seconds)))


# P1 / P2 / P3 / P4 --------------------------------------------------------------------
def epoch_day(ts: ColumnOrName) -> Column:
    """Whole UTC days since 1970-01-01."""
    return F.unix_date(F.to_date(col(ts)))


def epoch_month(ts: ColumnOrName) -> Column:
    """Months since 1970-01."""
    return (F.year(col(ts)) - 1970) * 12 + F.month(col(ts)) - 1


def month_start(k: ColumnOrName) -> Column:
    """Inverse of epoch_month: first instant of month k (TIMESTAMP_NTZ)."""
    k = col(k)
    return F.make_timestamp_ntz(F.lit(1970) + F.floor(k / 12).cast("int"),
                                F.pmod(k, F.lit(12)).cast("int") + 1,
                                F.lit(1), F.lit(0), F.lit(0), F.lit(0))


def day_start(d: ColumnOrName) -> Column:
    return as_ntz(F.date_from_unix_date(col(d).cast("int")))


def ring_slot(day: ColumnOrName, slots: int = P.RING_SLOTS) -> Column:
    return F.pmod(col(day), F.lit(slots)).cast("smallint")


# P5 / P5b ------------------------------------------------------------------------------
def reloption(opts: ColumnOrName, key: str) -> Column:
    """Value of ``key`` in a ``key=value`` array; NULL if the array or the key is absent."""
    prefix = key + "="
    hit = F.try_element_at(F.filter(col(opts), lambda x: x.startswith(prefix)), F.lit(1))
    return F.substr(hit, F.lit(len(prefix) + 1))


def effective_setting(opts: ColumnOrName, key: str, default: ColumnOrName,
                      dtype: str = "double") -> Column:
    """Explicit per-relation option, else the snapshot default (cast to ``dtype``)."""
    return F.coalesce(reloption(opts, key).try_cast(dtype), col(default).cast(dtype))


# P6 / P6b ------------------------------------------------------------------------------
def ewma(prior: ColumnOrName, sample: ColumnOrName, alpha: ColumnOrName) -> Column:
    """NULL-aware EWMA: no sample keeps the prior; no prior (or alpha) seeds with the sample."""
    prior, sample, alpha = col(prior), col(sample), col(alpha)
    return (F.when(sample.isNull(), prior)
            .when(prior.isNull() | alpha.isNull(), sample)
            .otherwise(alpha * sample + (F.lit(1.0) - alpha) * prior))


def time_alpha(dt: ColumnOrName, tau: float) -> Column:
    """1 - exp(-dt/tau), defined only when dt > 0."""
    dt = col(dt)
    return F.when(dt > 0, F.lit(1.0) - F.exp(-dt / F.lit(float(tau))))


# P7 / P8 / P9 / P10 --------------------------------------------------------------------
def snap_to_grid(x: ColumnOrName, grid: Sequence[float] = P.SF_GRID) -> Column:
    """Nearest grid member; equal float distances resolve to the smaller member."""
    g = F.array(*[F.lit(float(v)) for v in grid])
    best = F.array_min(F.transform(g, lambda v: F.struct(F.abs(v - col(x)).alias("d"),
                                                         v.alias("g"))))
    return F.when(col(x).isNotNull(), best.getField("g"))


def clamp(x: ColumnOrName, lo: ColumnOrName, hi: ColumnOrName) -> Column:
    return F.least(F.greatest(col(x), col(lo)), col(hi))


def guarded_positive(x: ColumnOrName, default: float) -> Column:
    x = col(x)
    return F.when(x > 0, x).otherwise(F.lit(float(default)))


def class_target(kind: ColumnOrName, targets: dict | None = None) -> Column:
    targets = targets or P.CLASS_TARGETS
    m = F.create_map(*[e for k, v in targets.items() for e in (F.lit(k), F.lit(float(v)))])
    return F.try_element_at(m, col(kind))


# P12 / P13 / P14 -------------------------------------------------------------------------
def safe_div(a: ColumnOrName, b: ColumnOrName) -> Column:
    """a / nullif(b, 0) in DOUBLE."""
    return F.try_divide(col(a).cast("double"), col(b).cast("double"))


def unknown_as_zero(x: ColumnOrName) -> Column:
    return F.greatest(col(x), F.lit(0))


def live_xid_age(raw_xid: ColumnOrName, current_xid: ColumnOrName,
                 stored_age: ColumnOrName) -> Column:
    """Modular age of a raw 32-bit id against the cluster's current id, else the stored age."""
    x, cur = col(raw_xid), col(current_xid)
    live = (F.when(x.isNull() | (x == 0) | cur.isNull(), F.lit(None).cast("long"))
            .when(x.isin(1, 2), F.lit(INT32_MAX).cast("long"))
            .otherwise(F.pmod(cur - x, F.lit(XID_MODULUS))))
    return F.coalesce(live, col(stored_age).cast("long"))


# P15 / P16 --------------------------------------------------------------------------------
def failure_class(reason: ColumnOrName) -> Column:
    r = col(reason)
    return (F.when(r.isin(*P.ACTUATION_FAILURES),
                   F.lit("actuation")))


def parse_in_range(text: ColumnOrName, lo: float, hi: float) -> Column:
    """try_cast to DOUBLE and range check; NaN and infinities fail the bounds."""
    v = col(text).try_cast("double")
    return F.coalesce(v.between(F.lit(lo), F.lit(hi)) & ~F.isnan(v), F.lit(False))


# P18 / P19 / P20 / P21 ----------------------------------------------------------------------
def evidence_json(**fields: ColumnOrName) -> Column:
    return F.to_json(F.struct(*[col(v).alias(k) for k, v in fields.items()]),
                     {"ignoreNullFields": "false"})


def changed(a_cols: Sequence[ColumnOrName], b_cols: Sequence[ColumnOrName]) -> Column:
    """Row signature differs (NULLs compare equal, arrays included)."""
    return ~F.struct(*[col(c) for c in a_cols]).eqNullSafe(F.struct(*[col(c) for c in b_cols]))


# P22-P28 ------------------------------------------------------------------------------------
def within_last(ts: ColumnOrName, as_of: ColumnOrName, seconds: int | float) -> Column:
    return col(ts) > minus_seconds(as_of, seconds)


def percent(ratio: ColumnOrName) -> Column:
    return F.round(F.lit(100.0) * col(ratio), 0)


def partition_suffix(ts: ColumnOrName, span: str) -> Column:
    return F.date_format(col(ts), "yyyyMMdd" if span == "day" else "yyyyMM")


def health_ordinal(state: ColumnOrName) -> Column:
    m = F.create_map(*[e for i, s in enumerate(P.HEALTH_STATES) for e in (F.lit(s), F.lit(i))])
    return F.try_element_at(m, col(state))
