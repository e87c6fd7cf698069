"""Operator 8: mixing sources to target weights by iterative proportional fitting.

The tokens of all documents (words: runs of characters that are no white space) are counted
by cell (source, language, topic). The cells' weights are raked: for each of the three columns in
turn they are scaled so that their sums meet the column's target shares, and so on until every sum
is within ``CLOSE`` of its target (at most ``ROUNDS`` rounds). A cell's raked weight over its share
of the tokens, times ``keep``, is the rate at which its documents are sampled: how many copies of
each the mix holds in expectation. A document gets the whole part of the rate, and one copy more
with the rest as probability, drawn by a hash of its id, so the draw is repeatable. So the targets
and ``keep`` (the mix's tokens over the corpus's) both hold in expectation, however rare a cell is: it
is repeated instead of thinning all others. DataFrame functions only.

Targets: each value's share is its share of tokens to the power ``temper``, scaled to 1. The topic
is any column, by default the form of the text (``topic``).
Only the counting pass and the draw touch documents; the cells are a small table, and Spark
broadcasts it only while its size is below the session's limit. The driver sees one number a round.

A null source, language or topic, or an empty one, is the value ''. Null and empty texts have no
tokens; a cell without tokens is not sampled. A null id draws like the empty id. Repeated rows
are drawn alike. Extra columns pass through; columns named like an added one are replaced.
An empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vacfleet.llm.common import without
from vacfleet.session import store

TEMPER, KEEP, ROUNDS = 0.7, 0.8, 30
#: Raking ends when every share is so close to its target.
CLOSE = 1e-6
DIMS = ("source", "lang", "topic")

# Topics by form, the first pattern that a text has; else "prose".
PATTERNS = (
    ("table", r" \| "),
    ("license", r"[Ll]icen[sc]e|[Cc]opyright"),
    ("contact", r"[a-z0-9]@[a-z0-9]|https?://"),
    ("symbols", r"[#$%&*]{3}"),
    ("shout", r"[A-Z]{2,}!!"),
)
WORD = r"[^ \t\n\r]+"


def topic(text: Column) -> Column:
    out = F.lit("prose")
    for name, pattern in reversed(PATTERNS):
        out = F.when(text.rlike(pattern), F.lit(name)).otherwise(out)
    return out


def described(docs: DataFrame, by: Column | None = None) -> DataFrame:
    """Add the cell's columns and the tokens of each row; ``by`` is the topic."""
    text = F.coalesce("text", F.lit(""))
    by = topic(text) if by is None else F.coalesce(by.cast("string"), F.lit(""))
    base = docs.withColumn("_mix_topic", by)
    return without(base, ["topic", "n_tokens", "rate", "copies", "kept", "mix_source", "mix_lang"]).withColumns({
        "mix_source": F.coalesce("source", F.lit("")), "mix_lang": F.coalesce("lang", F.lit("")),
        "n_tokens": F.regexp_count(text, F.lit(WORD)).cast("long")}).withColumnRenamed("_mix_topic", "topic")


def sums(cells: DataFrame, dim: str) -> DataFrame:
    """Now and target share of each value of a column, from cells that have the target (``share_<dim>``)."""
    return cells.groupBy(dim).agg(F.sum("weight").alias("now"), F.max(f"share_{dim}").alias("share"))


def distance(cells: DataFrame) -> float:
    """The largest gap between a column's share and its target (one number to the driver): one
    aggregation of all columns' values."""
    values = cells.select("weight", F.posexplode(F.array(*[
        F.struct(F.col(d).alias("value"), F.col(f"share_{d}").alias("share")) for d in DIMS])).alias("dim", "_of"))
    now = values.groupBy("dim", "_of.value").agg(F.sum("weight").alias("now"), F.max("_of.share").alias("share"))
    return now.agg(F.max(F.abs(F.col("now") - F.col("share")))).first()[0] or 0.0


def rake(cells: DataFrame, targets: dict[str, DataFrame], rounds: int = ROUNDS, close: float = CLOSE) -> DataFrame:
    """Scale ``weight`` of the cells to each column's target shares (``value, share``) in turn, a
    stored table a round, until all are met. The cells take their targets along, so a round joins
    nothing but its own factors: each join is a broadcast that the driver builds."""
    names = cells.columns
    for dim in DIMS:
        cells = cells.join(targets[dim].select(F.col("value").alias(dim), F.col("share").alias(f"share_{dim}")), dim)
    cells = store(cells, "mix_cells")
    for _ in range(rounds):
        if distance(cells) <= close:
            break
        for dim in DIMS:
            factor = sums(cells, dim).select(
                dim, F.when(F.col("now") > 0, F.col("share") / F.col("now")).otherwise(F.lit(0.0)).alias("factor"))
            cells = cells.join(factor, dim).withColumn("weight", F.col("weight") * F.col("factor")).drop("factor")
        cells = store(cells, "mix_cells")
    return cells.select(names)


def tempered(cells: DataFrame, dim: str, temper: float = TEMPER) -> DataFrame:
    """Target shares of one column: its shares of tokens to the power ``temper``."""
    per = cells.groupBy(F.col(dim).alias("value")).agg(F.pow(F.sum("tokens").cast("double"), F.lit(temper)).alias("p"))
    return store(per.crossJoin(F.broadcast(per.agg(F.sum("p").alias("all"))))
                 .select("value", F.when(F.col("all") > 0, F.col("p") / F.col("all")).otherwise(F.lit(0.0)).alias("share")), "mix_target")


def draw(key: Column, seed: str) -> Column:
    """A number in [0, 1) from the key."""
    text = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))))
    return F.conv(F.substring(text, 1, 13), 16, 10).cast("double") / float(1 << 52)


def mix(docs: DataFrame, keep: float = KEEP, temper: float = TEMPER, rounds: int = ROUNDS, seed: str = "mix",
        by: Column | None = None) -> DataFrame:
    """Add ``topic, n_tokens, rate, copies, kept`` to each row: the expected copies, the drawn ones, and
    whether there is any."""
    rows = described(docs, by)
    cells = store(rows.groupBy(F.col("mix_source").alias("source"), F.col("mix_lang").alias("lang"), "topic")
                  .agg(F.sum("n_tokens").alias("tokens")), "mix_counts")
    total = F.broadcast(cells.agg(F.sum("tokens").alias("total")))
    start = cells.crossJoin(total).withColumn("weight", F.when(F.col("total") > 0, F.col("tokens") / F.col("total")).otherwise(F.lit(0.0)))
    fitted = rake(start, {d: tempered(cells, d, temper) for d in DIMS}, rounds)
    ratio = F.when(F.col("tokens") > 0, F.col("weight") * F.col("total") / F.col("tokens")).otherwise(F.lit(0.0))
    rate = fitted.select(F.col("source").alias("mix_source"), F.col("lang").alias("mix_lang"), "topic",
                         F.round(F.lit(keep) * ratio, 9).alias("rate"))
    out = rows.join(rate, ["mix_source", "mix_lang", "topic"])
    whole = F.floor("rate")
    return (out.select([F.col(f"`{c}`") for c in rows.columns if c not in ("mix_source", "mix_lang")] + [F.col("rate")])
            .withColumn("copies", (whole + (draw(F.col("doc_id"), seed) < F.col("rate") - whole).cast("int")).cast("int"))
            .withColumn("kept", F.col("copies") > 0))


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: each document as often as it was drawn, with the columns of ``docs``."""
    out = mix(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_mix_row"), "*"), **options)
    return out.where("kept").select("_mix_row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("_mix_row.*")


def oracle(keep: float = KEEP, temper: float = TEMPER, rounds: int = ROUNDS, seed: str = "mix", close: float = CLOSE) -> str:
    """The sampled table in SQL: the rounds written out one after the other; a round that begins
    with all targets met changes nothing."""
    cases = " ".join(f"when regexp_matches(t, '{p}') then '{n}'" for n, p in PATTERNS)
    ctes = [
        f"""d as (select *, case {cases} else 'prose' end as topic, len(regexp_extract_all(t, '{WORD}')) as n_tokens
  from (select doc_id, coalesce(source, '') as source, coalesce(lang, '') as lang, coalesce(text, '') as t from documents))""",
        "c as materialized (select source, lang, topic, sum(n_tokens)::double as tokens from d group by all)",
        "w0 as materialized (select *, case when sum(tokens) over () > 0 then tokens / sum(tokens) over () else 0 end as weight from c)"]
    for dim in DIMS:
        ctes.append(f"t_{dim} as materialized (select {dim}, pow(sum(tokens), {temper}) / sum(pow(sum(tokens), {temper})) over () as share from c group by 1)")
    k = 0
    for r in range(rounds):
        gaps = " union all ".join(f"select abs(s.now - t.share) as gap from (select {dim}, sum(weight) as now from w{k} group by 1) s join t_{dim} t using ({dim})"
                                  for dim in DIMS)
        ctes.append(f"g{r} as materialized (select coalesce(max(gap), 0) > {close} as apart from ({gaps}))")
        for dim in DIMS:
            ctes.append(f"w{k + 1} as materialized (select w.* exclude (weight), case when not apart then weight when s.now > 0 then weight * t.share / s.now else 0 end as weight "
                        f"from w{k} w join (select {dim}, sum(weight) as now from w{k} group by 1) s using ({dim}) join t_{dim} t using ({dim}), g{r})")
            k += 1
    ctes.append(f"""p as (select source, lang, topic, round(case when tokens > 0
  then {keep} * weight * (select sum(tokens) from c) / tokens else 0 end, 9) as rate from w{k})""")
    ctes.append(f"""r as (select d.*, rate, ('0x' || substr(md5('{seed}:' || coalesce(doc_id::varchar, '')), 1, 13))::bigint / {float(1 << 52)} as draw
  from d join p using (source, lang, topic))""")
    return "with " + ",\n".join(ctes) + """
select doc_id, source, lang, topic, n_tokens::bigint as n_tokens, rate,
  (floor(rate) + (draw < rate - floor(rate))::int)::int as copies, floor(rate) + (draw < rate - floor(rate))::int > 0 as kept
from r"""
