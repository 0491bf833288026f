"""Mixing of sources to target weights: temperature, and whole or partial passes over permuted blocks of documents."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from reconlake.llm.shared import stored

DOCS_PER_BLOCK = 4096
#: Decisions are one row of under 1 KB per source; up to so many are broadcast, more are joined by shuffle.
MOST_BROADCAST_SOURCES = 50_000
LEVELS, ROUNDS = 7, 5


def word_count(text: Column) -> Column:
    """Words between ASCII white space; null: 0."""
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), "[ \\t-\\r]+"), lambda w: w != "")).cast("long")


def _bisect(low: float, high: float, holds) -> float:
    """The largest x in [low, high] up to which `holds` is true, by bisection; LEVELS halvings are asked at once.

    `holds` takes a list of points and gives a truth value for each; it is true at first and false from some
    point on. If it is true at `high`, that is the answer; if it is false at `low`, then `low`.
    """
    for _ in range(ROUNDS):
        points = [low + (high - low) * i / 2**LEVELS for i in range(1, 2**LEVELS + 1)]
        true = holds(points)
        kept = next((i for i, x in enumerate(true) if not x), len(true))
        if kept == len(true):
            return high
        low, high = (points[kept - 1] if kept else low), points[kept]
    return low


def temperature(shares: DataFrame, target_entropy: float | None, max_repetition: float | None, budget_share: float | None) -> float:
    """The exponent for source weights share**x / sum(share**x), x in [0, 1].

    It is the largest x whose weights have at least `target_entropy` of the greatest possible entropy (the log of
    the number of sources), but not so small that any source would be read more than `max_repetition` times.
    `budget_share` is the budget over all tokens; None means that the largest source is read once. Each question
    is one small aggregation over the sources, so the sources themselves never reach the driver.
    """
    least, most, sources = shares.agg(F.min("share"), F.max("share"), F.count("*")).first()

    def sums(points: list[float]) -> list[tuple[float, float]]:
        asked = shares.select("share", F.explode(F.array(*[F.lit(x) for x in points])).alias("x"))
        power = F.pow("share", "x")
        got = {r["x"]: (r["z"], r["e"]) for r in asked.groupBy("x").agg(F.sum(power).alias("z"), F.sum(power * F.log("share")).alias("e")).collect()}
        return [got[x] for x in points]

    x = 1.0
    if target_entropy is not None and sources > 1:
        x = _bisect(0.0, 1.0, lambda points: [math.log(z) - p * e / z >= target_entropy * math.log(sources) for p, (z, e) in zip(points, sums(points), strict=True)])
    if max_repetition is not None:

        def too_often(points: list[float]) -> list[bool]:
            if budget_share is None:
                return [(least / most) ** (p - 1) > max_repetition for p in points]
            return [budget_share * least ** (p - 1) / z > max_repetition for p, (z, _) in zip(points, sums(points), strict=True)]

        x = max(x, _bisect(0.0, 1.0, too_often))
    return x


def mix_sources(
    docs: DataFrame,
    target_entropy: float | None = 0.9,
    max_repetition: float | None = 4.0,
    budget_tokens: int | None = None,
    seed: int = 17,
    docs_per_block: int = DOCS_PER_BLOCK,
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
    placed: bool = True,
) -> DataFrame:
    """The documents, each as often as the mixture reads it, with the columns of `docs` and (if `placed`) those below.

    Source token counts (words) give shares; `temperature` bisects the exponent; a source's quota is its weight
    times `budget_tokens` (None: such that the source with the greatest share is read once and no document is
    lost). A source is read in whole passes and one partial pass: its documents, permuted by a hash of id and
    text and cut into blocks of about `docs_per_block`, are taken block by block until the next would exceed the
    quota, then document by document in that block. Where a pass ends is a (block, hash) pair for each source,
    found from block sums, so texts are neither sorted nor shuffled, and a hot source is spread over all tasks.

    A null source is a source of its own. Texts without words (null too) weigh nothing; a source that has only
    such texts is read once. Rows that agree in id and text go together. Extra columns are kept; new columns
    replace any of the same names (none are added, and so none replaced, without `placed`). An empty table gives an
    empty result.

    New columns: n_words long, weight double (of the source), epoch int (from 1), block int, block_order long
    (sorting by it, then by doc_order, gives the permuted blocks), doc_order long.
    """
    drawn = F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col))
    rows = stored(docs.select(F.col(source_col).alias("mix_source"), drawn.alias("draw"), word_count(F.col(text_col)).alias("words")), "mix-rows")
    totals = stored(rows.groupBy("mix_source").agg(F.sum("words").alias("tokens"), F.count("*").alias("docs")), "mix-sources")
    total, sources, most = totals.agg(F.sum("tokens"), F.count("*"), F.max("tokens")).first()
    shares = totals.where("tokens > 0").select((F.col("tokens") / F.lit(float(total or 1))).alias("share"))
    new = ["n_words", "weight", "epoch", "block", "block_order", "doc_order"] if placed else []
    if not total:
        x, scale, power_sum = 1.0, 0.0, 1.0
    else:
        x = temperature(shares, target_entropy, max_repetition, None if budget_tokens is None else budget_tokens / total)
        power_sum = shares.agg(F.sum(F.pow("share", F.lit(x)))).first()[0]
        scale = budget_tokens / power_sum if budget_tokens is not None else most / (most / total) ** x
    raised = F.when(F.col("tokens") > 0, F.pow(F.col("tokens") / F.lit(float(total or 1)), F.lit(x))).otherwise(0.0)
    repeats = F.when(F.col("tokens") > 0, raised * scale / F.col("tokens")).otherwise(1.0)
    # a repetition that is whole but for rounding is whole
    repeats = F.when(F.abs(repeats - F.round(repeats)) < 1e-9, F.round(repeats)).otherwise(repeats)
    plan = totals.select("mix_source", (raised / power_sum).alias("weight"), F.floor(repeats).cast("int").alias("whole"), F.ceil(F.col("docs") / docs_per_block).cast("int").alias("blocks"), F.floor((repeats - F.floor(repeats)) * F.col("tokens")).cast("long").alias("quota"))
    plan = stored(plan, "mix-plan")
    few = sources <= MOST_BROADCAST_SOURCES
    fit = F.broadcast if few else (lambda df: df)
    block = F.pmod(F.col("draw"), F.col("blocks")).cast("int")

    dealt = rows.join(fit(plan.where("quota > 0")), rows["mix_source"].eqNullSafe(plan["mix_source"])).select(plan["mix_source"], "quota", block.alias("at"), "draw", "words")
    ahead = Window.partitionBy("mix_source").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    sums = dealt.groupBy("mix_source", "quota", "at").agg(F.sum("words").alias("words"))
    sums = sums.withColumn("before", F.coalesce(F.sum("words").over(ahead), F.lit(0)))
    last = stored(sums.where("before <= quota and before + words > quota").select("mix_source", "at", "before"), "mix-last-blocks")
    tail = dealt.join(fit(last.withColumnRenamed("mix_source", "last_source")), dealt["mix_source"].eqNullSafe(F.col("last_source")) & (dealt["at"] == last["at"])).select("mix_source", dealt["at"], "draw", "words", "quota", "before")
    so_far = Window.partitionBy("mix_source", "at").orderBy("draw").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    tail = tail.withColumn("reached", F.col("before") + F.sum("words").over(so_far))
    cuts = tail.groupBy("mix_source", "at").agg(F.max(F.when(F.col("reached") <= F.col("quota"), F.col("draw"))).alias("cut")).select(F.col("mix_source").alias("cut_source"), "at", "cut")
    decided = plan.join(cuts, plan["mix_source"].eqNullSafe(F.col("cut_source")), "left").select("mix_source", "weight", "whole", "blocks", "quota", "at", "cut")
    decided = stored(decided, "mix-decisions")

    # the documents' own columns stay apart from those of the plan, whatever their names
    wide = docs.select(F.struct(*[F.col(c) for c in docs.columns if c not in new]).alias("mix_row"), F.col(source_col).alias("own_source"), drawn.alias("draw"))
    wide = wide.join(fit(decided), F.col("own_source").eqNullSafe(F.col("mix_source"))).withColumn("own_block", block)
    partial = (F.col("quota") > 0) & ((F.col("own_block") < F.col("at")) | ((F.col("own_block") == F.col("at")) & (F.col("draw") <= F.col("cut"))))
    copies = F.col("whole") + F.when(partial, 1).otherwise(0)
    wide = wide.withColumn("copies", copies).where("copies > 0").withColumn("pass", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    if not placed:
        return wide.select("mix_row.*")
    order = F.xxhash64(F.lit(seed), F.col("pass"), F.col("mix_source"), F.col("own_block"))
    return wide.select(
        "mix_row.*", word_count(F.col(f"mix_row.{text_col}")).alias("n_words"), "weight", F.col("pass").cast(T.IntegerType()).alias("epoch"),
        F.col("own_block").alias("block"), order.alias("block_order"), F.col("draw").alias("doc_order"),
    )
