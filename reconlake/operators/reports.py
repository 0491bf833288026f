"""Totals, balances, flows and pivots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def in_out(df: DataFrame, keys: list[str], amount: str = "amount") -> DataFrame:
    """Money in, money out (as a magnitude), net and rows for each key, all in one aggregation."""
    a = F.col(amount)
    return df.groupBy(*keys).agg(
        F.coalesce(F.sum(F.when(a > 0, a)), F.lit(0)).alias("total_in"), F.coalesce(F.sum(F.when(a < 0, -a)), F.lit(0)).alias("total_out"),
        F.coalesce(F.sum(a), F.lit(0)).alias("net"), F.count("*").alias("n"),
    )


def daily_flows(movements: DataFrame, day: str, amount: str, first: str, last: str, opening: Column) -> DataFrame:
    """Each day of a range with money in, money out and the running balance; days without movements too.

    Movements are reduced to one row per day before the running sum, so the only unpartitioned window runs over
    as many rows as the range has days.
    """
    spine = movements.sparkSession.range(1).select(F.explode(F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"))).alias("day"))
    totals = in_out(movements.where(F.col(day).between(F.lit(first).cast("date"), F.lit(last).cast("date"))).withColumnRenamed(day, "day"), ["day"], amount)
    flows = spine.join(totals, "day", "left").select("day", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("total_in", "total_out", "net")])
    return flows.select("day", "total_in", "total_out", (opening + F.sum("net").over(Window.orderBy("day"))).alias("balance"))


def latest_value(df: DataFrame, keys: list[str], value: str, order: list[str]) -> DataFrame:
    """The non-null value of the latest row of each key, by a partial aggregation instead of a window."""
    there = df.where(F.col(value).isNotNull())
    return there.groupBy(*keys).agg(F.max_by(value, F.struct(*order)).alias(value))


def pivot_with_margins(df: DataFrame, row: str, column: str, amount: str, flag: str) -> DataFrame:
    """Cells, row totals, column totals and the grand total in one pass; `level` tells them apart."""
    return df.cube(row, column).agg(F.count("*").alias("n"), F.sum(amount).alias("total"), F.sum(F.col(flag).cast("int")).alias("flagged"), F.grouping_id().cast("int").alias("level"))


def mode_by(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The most frequent value of each key, ties to the least value."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("n"))
    return counts.groupBy(*keys).agg(F.min_by(value, F.struct((-F.col("n")).alias("o"), F.col(value).alias("v"))).alias(value), F.max("n").alias("n"))


def dominant(counts: DataFrame, keys: list[str], value: str, n: str, least: int, share: float) -> DataFrame:
    """The top value of each key if it has `least` hits and `share` of those of the two best."""
    order = Window.partitionBy(*keys).orderBy(F.col(n).desc(), F.col(value))
    ranked = counts.withColumn("_rank", F.row_number().over(order)).withColumn("_second", F.coalesce(F.lead(n).over(order), F.lit(0)))
    return ranked.where((F.col("_rank") == 1) & (F.col(n) >= least) & (F.col(n) >= share * (F.col(n) + F.col("_second")))).drop("_rank", "_second")
