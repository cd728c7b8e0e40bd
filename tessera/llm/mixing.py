"""Mixing sources to target weights: temperature mixing with a bisected exponent, realised as block permutations."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import fresh, stored, table

#: The entropy of the weights aimed at, as a share of that of equal weights.
TARGET_ENTROPY = 0.97
#: No source is repeated more often than this, counted against the source repeated least.
MAX_REPEATS = 4.0
BLOCKS = 256
STEPS = 40
#: Halvings that one aggregate over the sources decides.
AT_ONCE = 5
#: A plan of more blocks than this is joined, not broadcast.
BROADCAST_BLOCKS = 1 << 18


def n_tokens(text: Column) -> Column:
    """Tokens of a text as weighed here: its runs of characters other than ASCII white space."""
    return F.regexp_count(F.coalesce(text.cast("string"), F.lit("")), F.lit(r"[^ \t\n\x0B\f\r]+")).cast("long")


def block_of(doc_id: Column) -> Column:
    """One of BLOCKS blocks, by the document's id."""
    return (F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit(""))), 1, 8), 16, 10).cast("long") % BLOCKS).cast("int")


def bisect_exponent(sources: DataFrame, target_entropy: float = TARGET_ENTROPY, max_repeats: float = MAX_REPEATS, steps: int = STEPS) -> float:
    """The exponent of the token shares: the largest in [0, 1] with the target entropy, or, where that repeats a source too often, the smallest that doesn't.

    sources has a column tokens (1 at least). Entropy and repetition both fall as the exponent
    grows. One aggregate over the sources gives the entropies of all points that the next AT_ONCE
    halvings can come to, so that few sums and few jobs are needed.
    """
    n, low, high = sources.agg(F.count("*"), F.min("tokens"), F.max("tokens")).first()
    if n < 2 or low == high:
        return 1.0

    known: dict[float, bool] = {}

    def look(points: list[float]) -> None:
        """Whether the weights with these exponents are even enough."""
        w = [F.pow(F.col("tokens").cast("double") / F.lit(float(high)), F.lit(a)) for a in points]
        sums = sources.agg(*[s for x in w for s in (F.sum(x), F.sum(x * F.ln(x)))]).first()
        for k, a in enumerate(points):
            total, weighted = sums[2 * k], sums[2 * k + 1]
            known[a] = (math.log(total) - weighted / total) / math.log(n) >= target_entropy

    def even_enough(a: float, left: float = 0.0, right: float = 1.0) -> bool:
        if a not in known:
            width = (right - left) / 2**AT_ONCE
            look([left + k * width for k in range(1, 2**AT_ONCE + 1)])
        return known[a]

    def repeats_too_often(a: float, left: float = 0.0, right: float = 1.0) -> bool:
        return (high / low) ** (1 - a) > max_repeats

    def bisect(below) -> tuple[float, float]:
        """The last point where below holds and the first where it doesn't, 2^-steps apart."""
        left, right = 0.0, 1.0
        for _ in range(steps):
            middle = (left + right) / 2
            left, right = (middle, right) if below(middle, left, right) else (left, middle)
        return left, right

    by_entropy = 1.0 if even_enough(1.0) else bisect(even_enough)[0]
    return bisect(repeats_too_often)[1] if repeats_too_often(by_entropy) else by_entropy


def mixing_plan(docs: DataFrame, target_entropy: float = TARGET_ENTROPY, max_repeats: float = MAX_REPEATS, budget: int | None = None) -> DataFrame:
    """The schedule (source, block, epoch, turn, source_start, weight) of the mix.

    A source's weight is its token share to the power of bisect_exponent(), normalised. Its quota
    is that part of the budget in tokens; without a budget the quotas are the smallest with which
    every source is used whole at least once, so no document is lost. The quota is filled by epochs
    over the source's blocks, each epoch in an order of its own; of the last one those blocks come
    in whose middle lies within the quota. turn numbers a source's blocks in that order and
    source_start is the tokens of the source before the block.
    """
    weighed = docs.select(F.col("source"), n_tokens(F.col("text")).alias("tokens"), block_of(F.col("doc_id")).alias("block"))
    blocks = stored(weighed.groupBy("source", "block").agg(F.sum("tokens").alias("tokens")), "mix-blocks")
    sources = stored(blocks.groupBy("source").agg(F.greatest(F.sum("tokens"), F.lit(1)).alias("tokens")), "mix-sources")
    a = bisect_exponent(sources, target_entropy, max_repeats)
    low, high, total = sources.agg(F.min("tokens"), F.max("tokens"), F.sum(F.pow(F.col("tokens").cast("double"), F.lit(a)))).first()
    if low is None:
        low, high, total = 1, 1, 1.0
    weight = F.pow(F.col("tokens").cast("double"), F.lit(a)) / F.lit(total)
    quota = F.col("tokens") * F.pow(F.lit(float(high)) / F.col("tokens"), F.lit(1 - a)) if budget is None else weight * F.lit(float(budget))
    plan = sources.select("source", F.col("tokens").alias("all"), F.round(quota).cast("long").alias("quota"), F.round(weight, 9).alias("weight"))
    plan = plan.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.floor(F.col("quota") / F.col("all")).cast("int"))))
    plan = plan.withColumnRenamed("source", "s")
    rows = blocks.join(plan, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    label = F.concat_ws("|", F.coalesce(F.col("source").cast("string"), F.lit("")), F.col("block"), F.col("epoch"))
    order = Window.partitionBy("source", "epoch").orderBy(F.md5(label), "block")
    rows = rows.withColumns({"before": F.sum("tokens").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("tokens"), "nth": F.row_number().over(order) - 1})
    rest = F.col("quota") - F.col("epoch") * F.col("all")
    rows = rows.filter((rest >= F.col("all")) | ((rest > 0) & (2 * F.col("before") + F.col("tokens") <= 2 * rest)))
    return rows.select("source", "block", "epoch", (F.col("epoch") * BLOCKS + F.col("nth")).cast("long").alias("turn"), (F.col("epoch") * F.col("all") + F.col("before")).alias("source_start"), "weight")


def mix(docs: DataFrame, target_entropy: float = TARGET_ENTROPY, max_repeats: float = MAX_REPEATS, budget: int | None = None) -> DataFrame:
    """(doc_id, source, tokens, block, epoch, turn, source_start, weight): a row for each time a row of docs (doc_id, source, text) is used.

    A null source is a source of its own; null texts have no tokens and go where their block goes;
    repeated rows are used as often as they are there; a source without tokens counts as one of one
    token; a single source is used once; an empty table gives an empty one; further columns are
    ignored. Sums are combined before they are shuffled, and a source with a third of all rows is
    spread over its blocks.
    """
    plan = mixing_plan(docs, target_entropy, max_repeats, budget)
    plan = plan.select(F.col("source").alias("s"), F.col("block").alias("b"), "epoch", "turn", "source_start", "weight")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", n_tokens(F.col("text")).alias("tokens"), block_of(F.col("doc_id")).alias("block"))
    joined = rows.join(plan, F.col("source").eqNullSafe(F.col("s")) & (F.col("block") == F.col("b")))
    return joined.select("doc_id", "source", "tokens", "block", "epoch", "turn", "source_start", "weight")


def mixed_rows(docs: DataFrame, target_entropy: float = TARGET_ENTROPY, max_repeats: float = MAX_REPEATS) -> DataFrame:
    """docs with every row as often as the mix uses it (once at least), with the columns of docs.

    Null sources, null and empty texts, repeated rows and rows without a doc_id are used as mix()
    has it; an empty table gives an empty one; no column of docs clashes. The table of blocks is
    broadcast if it has at most BROADCAST_BLOCKS rows, so that texts are not shuffled.
    """
    plan = mixing_plan(docs, target_entropy, max_repeats)
    times = stored(plan.groupBy("source", "block").agg(F.count("*").cast("int").alias("times")), "mix-times")
    times = F.broadcast(times) if times.count() <= BROADCAST_BLOCKS else times
    nth = fresh(docs, "nth")
    joined = docs.join(times, docs["source"].eqNullSafe(times["source"]) & (block_of(docs["doc_id"]) == times["block"]))
    return joined.select(*[docs[c] for c in docs.columns], F.explode(F.sequence(F.lit(1), times["times"])).alias(nth)).drop(nth)


def op3_temperature_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of the sources of the table documents: a row for each time that a document is used."""
    return mix(table(spark, sf_dir, "documents"))


OP3_SQL = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^ \\t\\n\\x0B\\f\\r]+')) AS tokens,
    ('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8))::BIGINT % {BLOCKS} AS block FROM documents),
b AS (SELECT source, block, CAST(sum(tokens) AS BIGINT) AS tokens FROM d GROUP BY ALL),
s AS (SELECT source, greatest(CAST(sum(tokens) AS BIGINT), 1) AS t FROM b GROUP BY source),
g AS (SELECT count(*) AS n, min(t) AS low, max(t) AS high, list(t::DOUBLE / (SELECT max(t) FROM s)) AS x FROM s),
e(i, lo, hi) AS (
  SELECT 0, 0.0::DOUBLE, 1.0::DOUBLE
  UNION ALL
  SELECT i + 1, CASE WHEN even THEN (lo + hi) / 2 ELSE lo END, CASE WHEN even THEN hi ELSE (lo + hi) / 2 END
  FROM (SELECT e.*, (ln(list_sum(list_transform(x, lambda v: pow(v, (lo + hi) / 2))))
      - list_sum(list_transform(x, lambda v: pow(v, (lo + hi) / 2) * ln(pow(v, (lo + hi) / 2)))) / list_sum(list_transform(x, lambda v: pow(v, (lo + hi) / 2))))
      / ln(n) >= {TARGET_ENTROPY} AS even FROM e, g WHERE i < {STEPS})),
r(i, lo, hi) AS (
  SELECT 0, 0.0::DOUBLE, 1.0::DOUBLE
  UNION ALL
  SELECT i + 1, CASE WHEN often THEN (lo + hi) / 2 ELSE lo END, CASE WHEN often THEN hi ELSE (lo + hi) / 2 END
  FROM (SELECT r.*, pow(high::DOUBLE / low, 1 - (lo + hi) / 2) > {MAX_REPEATS} AS often FROM r, g WHERE i < {STEPS})),
ae AS (
  SELECT CASE WHEN n < 2 OR low = high OR (ln(list_sum(x)) - list_sum(list_transform(x, lambda v: v * ln(v))) / list_sum(x)) / ln(n) >= {TARGET_ENTROPY}
    THEN 1.0 ELSE (SELECT lo FROM e WHERE i = {STEPS}) END AS a FROM g),
al AS (SELECT CASE WHEN pow(high::DOUBLE / low, 1 - a) > {MAX_REPEATS} THEN (SELECT hi FROM r WHERE i = {STEPS}) ELSE a END AS a FROM ae, g),
p AS (
  SELECT source, t, CAST(round(t * pow(high::DOUBLE / t, 1 - a)) AS BIGINT) AS quota, round(pow(t::DOUBLE, a) / (SELECT sum(pow(t::DOUBLE, a)) FROM s), 9) AS weight FROM s, al, g),
o AS (SELECT *, unnest(range(quota // t + 1)) AS epoch FROM p),
w AS (
  SELECT b.source, b.block, b.tokens, o.* EXCLUDE (source),
    sum(b.tokens) OVER (PARTITION BY b.source, epoch ORDER BY md5(concat_ws('|', coalesce(b.source, ''), b.block, epoch)), b.block ROWS UNBOUNDED PRECEDING) - b.tokens AS before,
    row_number() OVER (PARTITION BY b.source, epoch ORDER BY md5(concat_ws('|', coalesce(b.source, ''), b.block, epoch)), b.block) - 1 AS nth
  FROM b JOIN o ON b.source IS NOT DISTINCT FROM o.source),
plan AS (
  SELECT * FROM w WHERE quota - epoch * t >= t OR (quota - epoch * t > 0 AND 2 * before + tokens <= 2 * (quota - epoch * t)))
SELECT d.doc_id, d.source, CAST(d.tokens AS BIGINT) AS tokens, CAST(d.block AS INTEGER) AS block, CAST(epoch AS INTEGER) AS epoch,
  CAST(epoch * {BLOCKS} + nth AS BIGINT) AS turn, CAST(epoch * t + before AS BIGINT) AS source_start, weight
FROM d JOIN plan ON d.source IS NOT DISTINCT FROM plan.source AND d.block = plan.block
"""
