"""Closing of card settlements: matched pairs become legs, legs a balanced entry per branch, branches a consolidation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from reconlake.operators.journal import line, split_side

#: The codes of sales, treasury, commission and difference.
SALES, TREASURY, COMMISSION, DIFFERENCE = 17, 200, 708, 1403


def settlement_legs(pairs: DataFrame, pos: DataFrame, settlements: DataFrame, consumed: DataFrame | None = None) -> DataFrame:
    """One leg per matched settlement, without the sales and settlements that stand in `consumed` (pos_id, settlement_id).

    The legs of a sale add up to its amount: each has its settlement's gross, and the first (least settlement_id) the
    rest, so a sale with one settlement has its own amount there. The sale's own fee counts on its first leg alone.
    `pos`: pos_id, branch_id, sale_date, amount, api_fee (null: none); `settlements`: settlement_id, gross, fee, fee_tax.

    Returns: pos_id, settlement_id, leg (from 0), branch_id, sale_date, pos_amount, net, fee, api_fee.
    """
    if consumed is not None:
        for side in ("pos_id", "settlement_id"):
            pairs = pairs.join(consumed.select(side).where(F.col(side).isNotNull()).distinct(), side, "left_anti")
    p = pos.select("pos_id", "branch_id", "sale_date", F.abs("amount").alias("amount"), F.coalesce("api_fee", F.lit(0)).alias("api"))
    s = settlements.select("settlement_id", "gross", (F.coalesce("fee", F.lit(0)) + F.coalesce("fee_tax", F.lit(0))).alias("fee"))
    met = pairs.select("pos_id", "settlement_id").join(p, "pos_id").join(s, "settlement_id")
    own = Window.partitionBy("pos_id")
    met = met.withColumn("leg", F.row_number().over(own.orderBy("settlement_id")) - 1).withColumn("whole", F.sum("gross").over(own))
    first = F.col("leg") == 0
    amount = F.when(first, F.col("amount") - (F.col("whole") - F.col("gross"))).otherwise(F.col("gross"))
    return met.select("pos_id", "settlement_id", "leg", "branch_id", "sale_date", amount.alias("pos_amount"), (F.col("gross") - F.col("fee")).alias("net"), "fee", F.when(first, F.col("api")).otherwise(0).alias("api_fee"))


def _sums(legs: DataFrame) -> DataFrame:
    """Of each branch: sales at gross, net, what exceeds the sales' amounts, and the fees that are booked and charged."""
    c = F.col
    booked = F.when(c("api_fee") > 0, c("api_fee")).otherwise(c("fee"))
    sums = legs.groupBy("branch_id").agg(F.sum("net").alias("net"), F.sum("fee").alias("fee"), F.sum("pos_amount").alias("pos"), F.sum(booked).alias("booked"), F.count("*").alias("legs"))
    return sums.withColumn("sales", c("net") + c("fee")).withColumn("surcharge", c("sales") - c("pos"))


def branch_entries(legs: DataFrame) -> DataFrame:
    """The entry of each branch: (branch_id, line_no, code, debit, credit, detail); debits equal credits.

    Sales at gross against treasury at net and the surcharge as commission; booked fees beyond the surcharge are a difference,
    those beyond the charged fees a difference in favour (or against). The last two are left out where they are nothing.
    """
    c, none = F.col, F.lit(None).cast("long")
    rest, favour = c("booked") - c("surcharge"), c("booked") - c("fee")
    more = split_side(rest)
    gained = split_side(favour)
    lines = [
        line(SALES, none, c("sales"), F.lit("sales")), line(TREASURY, c("net"), none, F.lit("treasury")), line(COMMISSION, c("surcharge"), none, F.lit("commission")),
        F.when(rest != 0, line(DIFFERENCE, more[0], more[1], F.lit("difference"))),
        F.when(favour != 0, line(DIFFERENCE, gained[1], gained[0], F.when(favour > 0, "difference in favour").otherwise("difference against"))),
    ]
    return _sums(legs).select("branch_id", F.posexplode(F.array(*lines)).alias("line_no", "line")).where("line IS NOT NULL").select("branch_id", "line_no", "line.*")


def consolidation_entry(legs: DataFrame, branches: DataFrame) -> DataFrame:
    """(code, debit, credit, detail): the net of all branches in one account, against each branch's code.

    `branches`: branch_id, branch, code (null: the branch's own number). Totals come from the branches' sums.
    """
    known = branches.select("branch_id", "branch", F.col("code").alias("own_code"))
    each = _sums(legs).select("branch_id", "net").join(known, "branch_id", "left")
    name = F.coalesce("branch", F.concat(F.lit("#"), F.col("branch_id").cast("string")))
    none = F.lit(None).cast("long")
    credits = each.select(line(F.coalesce("own_code", "branch_id"), none, F.col("net"), name).alias("line"))
    total = each.agg(F.sum("net").alias("net")).where("net IS NOT NULL").select(line(SALES, F.col("net"), none, F.lit("consolidated treasury")).alias("line"))
    return total.unionByName(credits).select("line.*")


def entry_lines(entries: DataFrame, key: str) -> DataFrame:
    """(`key`, lines) of entries given line by line: as a document for the register of emissions."""
    return entries.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("line_no", "code", "debit", "credit", "detail"))).alias("lines"))


def balance_of(lines: Column | str) -> Column:
    """Debits less credits of an array of lines."""
    array = F.col(lines) if isinstance(lines, str) else lines
    return F.aggregate(array, F.lit(0).cast("long"), lambda n, x: n + F.coalesce(x["debit"], F.lit(0)) - F.coalesce(x["credit"], F.lit(0)))
