"""Operator 2: conversations formatted in budgeted windows of whole turns.

Each turn costs its words plus the template's fixed cost. Prefix sums of the costs lay the
turns of a conversation end to end on a line that is cut every ``budget - system - history``
tokens: the turns that lie within one cut form a window, a turn that crosses a cut is a
window of its own. So no window exceeds the budget unless one turn alone does, and none is
shortened. Each window starts with the conversation's system turn (its first turn, if the
role says so), then repeats the last turns that end before it, up to ``history`` tokens.
Repeated turns carry no loss: each assistant text is a target in exactly one window.

The template puts control strings around turns; inside texts and roles they are escaped
reversibly. DataFrame functions only. A prefix sum never needs a whole conversation in one
task: it is built from blocks of consecutive turn numbers and their offsets.

Null roles and texts are empty. Rows with a null conv_id form one conversation. Rows with a
null turn come first; rows with the same turn follow role, then text; repeated rows are
turns of their own. Extra columns are left out. An empty table gives no window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
#: Words the template itself costs for each turn.
TURN_COST = 4
#: Consecutive turn numbers that one task sums.
BLOCK_TURNS = 256


def escape_text(text: Column) -> Column:
    """Put one more backslash into each ``<``, backslashes, ``|``."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape_text(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def escape_role(role: Column) -> Column:
    """No new line, bar or bare backslash is left."""
    out = F.replace(role, F.lit("\\"), F.lit("\\s"))
    out = F.replace(out, F.lit("\n"), F.lit("\\n"))
    return F.replace(out, F.lit("|"), F.lit("\\p"))


def unescape_role(role: Column) -> Column:
    out = F.replace(role, F.lit("\\p"), F.lit("|"))
    out = F.replace(out, F.lit("\\n"), F.lit("\n"))
    return F.replace(out, F.lit("\\s"), F.lit("\\"))


def words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"[^ \t\n\r]+")).cast("long")


def windows(turns: DataFrame, budget: int = 512, history: int = 128) -> DataFrame:
    """One row per window: ``conv_id, span, n_turns, n_repeated, n_tokens, formatted, loss``.

    ``span`` orders the windows of a conversation; the first ``n_repeated`` turns of
    ``formatted`` repeat earlier ones; ``loss`` lists the target texts as ``start`` (from 0)
    and ``length`` in code points of ``formatted``.
    """
    rows = turns.select(
        "conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
        F.coalesce(F.floor(F.col("turn") / BLOCK_TURNS), F.lit(-(1 << 62))).alias("block"),
    ).withColumn("cost", words(F.col("text")) + TURN_COST)
    inside = Window.partitionBy("conv_id", "block").orderBy("turn", "role", "text")
    rows = rows.select("*", F.row_number().over(inside).alias("at"),
                       F.sum("cost").over(inside.rowsBetween(Window.unboundedPreceding, 0)).alias("ends"))
    before = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    blocks = (rows.groupBy("conv_id", "block")
              .agg(F.sum("cost").alias("total"), F.count("*").alias("n"),
                   F.min(F.when(F.col("at") == 1, F.struct("role", "text", "cost"))).alias("head"))
              .select("conv_id", "block",
                      F.coalesce(F.sum("total").over(before), F.lit(0)).alias("cost_before"),
                      F.coalesce(F.sum("n").over(before), F.lit(0)).alias("turns_before"),
                      F.first("head").over(whole).alias("head"))
              .select("conv_id", "block", "cost_before", "turns_before",
                      F.when(F.col("head.role") == "system", F.col("head.text")).alias("system"),
                      F.when(F.col("head.role") == "system", F.col("head.cost")).otherwise(0).alias("system_cost"))
              .withColumnsRenamed({"conv_id": "b_conv", "block": "b_block"}))
    rows = rows.join(blocks, F.col("conv_id").eqNullSafe(F.col("b_conv"))
                     & (F.col("block") == F.col("b_block"))).drop("b_conv", "b_block")
    rows = rows.withColumn("pos", F.col("turns_before") + F.col("at"))
    head = F.col("system").isNotNull() & (F.col("pos") == 1)
    start = F.col("cost_before") + F.col("ends") - F.col("cost")
    room = F.greatest(budget - history - F.col("system_cost"), F.lit(1))
    rows = rows.withColumn("is_system", head).withColumn(
        "start", F.when(head, F.lit(0)).otherwise(start - F.col("system_cost")))
    cut, last = F.floor(F.col("start") / room), F.floor((F.col("start") + F.col("cost") - 1) / room)
    rows = rows.withColumn("span", F.when(F.col("is_system"), F.lit(0))
                           .otherwise(2 * cut + (cut != last).cast("long")).cast("long"))

    spans = (rows.groupBy("conv_id", "span")
             .agg(F.min(F.when(~F.col("is_system"), F.col("start"))).alias("first"),
                  F.max("is_system").alias("own_system"), F.max("system").alias("system"),
                  F.max("system_cost").alias("system_cost")))
    member = ["conv_id", "span", "pos", "role", "text", "cost", "repeated"]
    own = rows.withColumn("repeated", F.lit(False)).select(member)
    system = (spans.where(F.col("system").isNotNull() & ~F.col("own_system"))
              .select("conv_id", "span", F.lit(1).cast("long").alias("pos"), F.lit("system").alias("role"),
                      F.col("system").alias("text"), F.col("system_cost").alias("cost"),
                      F.lit(True).alias("repeated")))
    members = own.unionByName(system)
    if history > 0:
        near = F.floor(F.col("first") / history)
        ask = (spans.where(F.col("first").isNotNull())
               .select(F.col("conv_id").alias("s_conv"), "span", "first",
                       F.explode(F.array(near, near - 1)).alias("mark")))
        told = (rows.where(~F.col("is_system"))
                .select("conv_id", "pos", "role", "text", "cost", "start",
                        F.floor(F.col("start") / history).alias("t_mark")))
        again = (told.join(ask, F.col("conv_id").eqNullSafe(F.col("s_conv"))
                           & (F.col("t_mark") == F.col("mark"))
                           & (F.col("start") < F.col("first"))
                           & (F.col("start") >= F.col("first") - history))
                 .withColumn("repeated", F.lit(True)).select(member))
        members = members.unionByName(again)
    # a window holds at most the budget, or one longer turn and its history
    return (members.groupBy("conv_id", "span")
            .agg(F.array_sort(F.collect_list(F.struct(
                "pos", "repeated", escape_role(F.col("role")).alias("role"),
                escape_text(F.col("text")).alias("text"),
                (F.col("role") == "assistant").alias("target"), "cost"))).alias("m"))
            .select("conv_id", "span", F.size("m").cast("long").alias("n_turns"),
                    F.size(F.filter("m", lambda x: x["repeated"])).cast("long").alias("n_repeated"),
                    F.aggregate("m", F.lit(0).cast("long"), lambda s, x: s + x["cost"]).alias("n_tokens"),
                    F.array_join(F.transform("m", lambda x: F.concat(
                        F.lit(START), x["role"], F.lit("\n"), x["text"], F.lit(END + "\n"))), "").alias("formatted"),
                    _loss("m").alias("loss")))


def _loss(turns: str) -> Column:
    """Where the target texts stand: a fold that carries the place in the formatted text."""
    kind = "array<struct<start:int,length:int>>"

    def step(s: Column, x: Column) -> Column:
        text = s["at"] + len(START) + F.length(x["role"]) + 1
        spot = F.struct(text.cast("int").alias("start"), F.length(x["text"]).alias("length"))
        spans = F.when(x["target"] & ~x["repeated"], F.concat(s["spans"], F.array(spot))).otherwise(s["spans"])
        return F.struct((text + F.length(x["text"]) + len(END) + 1).cast("int").alias("at"),
                        spans.cast(kind).alias("spans"))

    zero = F.struct(F.lit(0).cast("int").alias("at"), F.array().cast(kind).alias("spans"))
    return F.aggregate(turns, zero, step, lambda s: s["spans"])


def read_back(formatted: DataFrame) -> DataFrame:
    """Parse windows: ``conv_id, span, turns`` (role and text of those not repeated), and
    ``targets`` (the texts under the loss mask), all unescaped."""
    pieces = F.split("formatted", r"<\|im_start\|>", -1)
    new = F.slice(pieces, (F.col("n_repeated") + 2).cast("int"), F.size(pieces))

    def turn(x: Column) -> Column:
        role = F.substring_index(x, "\n", 1)
        text = F.substr(x, F.length(role) + 2, F.length(x) - F.length(role) - F.lit(len(END) + 2))
        return F.struct(unescape_role(role).alias("role"), unescape_text(text).alias("text"))

    return formatted.select(
        "conv_id", "span", "n_repeated", F.transform(new, turn).alias("turns"),
        F.transform("loss", lambda x: unescape_text(
            F.substr(F.col("formatted"), x["start"] + 1, x["length"]))).alias("targets"),
        F.length("formatted").cast("long").alias("chars"))


def digests(formatted: DataFrame) -> DataFrame:
    """One row per conversation, read back from its windows (see the contract of op2)."""
    back = read_back(formatted).select(
        "conv_id", "span", F.size("turns").alias("n"), "chars",
        F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "").alias("turns"),
        F.array_join("targets", "").alias("loss"))
    return (back.groupBy("conv_id")
            .agg(F.array_sort(F.collect_list(F.struct("span", "turns", "loss"))).alias("w"),
                 F.sum("n").cast("long").alias("n_turns"), F.sum("chars").cast("long").alias("formatted_chars"),
                 F.count("*").alias("n_windows"))
            .select("conv_id", "n_turns", F.sha2(F.array_join("w.turns", ""), 256).alias("turns_sha256"),
                    F.length(F.array_join("w.loss", "")).cast("long").alias("loss_chars"),
                    F.sha2(F.array_join("w.loss", ""), 256).alias("loss_sha256"),
                    "formatted_chars", "n_windows"))


def oracle(budget: int = 512, history: int = 128) -> str:
    """The digests in SQL, from the plain rows (windows by direct comparison of turns)."""
    esc = r"regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g')"
    return rf"""
with t as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  union all select -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
c as (
  select *, len(regexp_extract_all(text, '[^ \t\n\r]+')) + {TURN_COST} as cost,
    row_number() over (partition by conv_id order by turn nulls first, role, text) as pos from t),
s as (select *, max(case when pos = 1 and role = 'system' then cost else 0 end) over (partition by conv_id) as sys_cost,
    max(case when pos = 1 and role = 'system' then length(role) + length({esc}) end) over (partition by conv_id) as sys_len,
    pos = 1 and role = 'system' as is_sys,
    sum(cost) over (partition by conv_id order by pos) - cost as raw from c),
b as (select *, case when is_sys then 0 else raw - sys_cost end as start, length(role) + length({esc}) + 24 as chars,
    greatest({budget - history} - sys_cost, 1) as room from s),
p as (select *, case when is_sys then 0 else 2 * (start // room)
    + case when start // room <> (start + cost - 1) // room then 1 else 0 end end as span from b),
w as (select conv_id, span, min(case when not is_sys then start end) as first, max(is_sys::int) as own, max(sys_len) as sys_len,
    sum(chars) as chars from p group by 1, 2),
h as (select w.conv_id, w.span, sum(p.chars) as chars from w join p on p.conv_id = w.conv_id and not p.is_sys
    and p.start < w.first and p.start >= w.first - {history} group by 1, 2),
f as (select w.conv_id, count(*) as n_windows, sum(w.chars + coalesce(h.chars, 0)
    + case when w.own = 0 and w.sys_len is not null then w.sys_len + 24 else 0 end) as formatted_chars
  from w left join h on h.conv_id = w.conv_id and h.span = w.span group by 1),
d as (select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by pos)) as turns_sha256,
    coalesce(sum(case when role = 'assistant' then length(text) end), 0) as loss_chars,
    sha256(coalesce(string_agg(case when role = 'assistant' then text end, '' order by pos), '')) as loss_sha256
  from c group by 1)
select d.conv_id, n_turns::bigint as n_turns, turns_sha256, loss_chars::bigint as loss_chars, loss_sha256,
  formatted_chars::bigint as formatted_chars, n_windows::bigint as n_windows
from d join f on f.conv_id = d.conv_id"""
