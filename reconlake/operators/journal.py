"""Balanced journal lines and exact apportionment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from reconlake.operators.settings import MOST_ROWS, bounded

def apportion(entries: DataFrame, keys: list[str], amount: str, weight: str, order: str) -> DataFrame:
    """Split each entry's whole amount by weights so that parts add up: shares rounded down, then largest remainders.

    Integer arithmetic in wide decimals throughout; ties of remainders go to the greater weight, then `order`.
    Entries whose weights add up to nothing give their whole amount to the first row.
    """
    group = Window.partitionBy(*keys)
    wide = lambda c: c.cast("decimal(38,0)")
    total = F.sum(weight).over(group)
    df = entries.withColumn("_w", wide(F.col(weight))).withColumn("_t", wide(total))
    product = wide(F.abs(amount)) * F.col("_w")
    df = df.withColumn("_p", F.when(F.col("_t") > 0, product.cast("decimal(38,0)")).otherwise(F.lit(0).cast("decimal(38,0)")))
    df = df.withColumn("_part", F.when(F.col("_t") > 0, F.floor(F.expr("_p div greatest(_t, 1)"))).otherwise(0).cast("long"))
    df = df.withColumn("_rem", F.when(F.col("_t") > 0, F.expr("_p % greatest(_t, CAST(1 AS decimal(38,0)))")).otherwise(0).cast("decimal(38,0)"))
    left = F.abs(F.col(amount)) - F.sum("_part").over(group)
    rank = F.row_number().over(group.orderBy(F.col("_rem").desc(), F.col(weight).desc(), F.col(order)))
    df = df.withColumn("_left", left).withColumn("_rank", rank)
    extra = F.when(F.col("_t") > 0, F.when(F.col("_rank") <= F.col("_left"), 1).otherwise(0)).otherwise(F.when(F.col("_rank") == 1, F.col("_left")).otherwise(0))
    return df.withColumn("part", (F.signum(F.col(amount).cast("double")).cast("long") * (F.col("_part") + extra)).cast("long")).drop("_w", "_t", "_p", "_part", "_rem", "_left", "_rank")


def apportion_each(entries: DataFrame, weights: DataFrame, amount: str, weight: str, order: str, most_rows: int = MOST_ROWS) -> DataFrame:
    """`apportion` where every entry is split by the same `weights`, `most_rows` at most: each entry with their columns and `part`.

    The weights are a constant array in the plan and a row works out its own parts, so nothing is shuffled or sorted but that array.
    """
    known = bounded(weights, most_rows)
    fields = {f.name: f.dataType for f in weights.schema.fields}
    total = sum(r[weight] or 0 for r in known)
    if total * max((r[weight] or 0 for r in known), default=0) >= 2**63:
        raise ValueError("weights are too large for whole numbers of 64 bits")
    # of an amount's whole multiples of the total each weight has its own; only what is left over is multiplied by weights
    size, whole = F.abs(amount), F.lit(max(total, 1)).cast("long")
    over, times = size % whole, F.call_function("div", size, whole)

    def share(r) -> Column:
        own = F.lit(r[weight]).cast("long")
        base, rest = (F.col("_times") * own + F.call_function("div", F.col("_over") * own, whole), F.col("_over") * own % whole) if total > 0 else (F.lit(0), F.lit(0))
        return F.struct((-rest).cast("long").alias("rest"), (-own).alias("own"), F.lit(r[order]).cast(fields[order]).alias("order"), base.cast("long").alias("base"), F.struct(*[F.lit(r[c]).cast(t).alias(c) for c, t in fields.items()]).alias("of"))

    if not known:
        return entries.select("*", *[F.lit(None).cast(t).alias(c) for c, t in fields.items()], F.lit(None).cast("long").alias("part")).limit(0)
    # the greatest remainders first, of these the greatest weights
    dealt = entries.withColumn("_over", over).withColumn("_times", times).withColumn("_shares", F.sort_array(F.array(*[share(r) for r in known])))
    left = F.abs(amount) - F.aggregate("_shares", F.lit(0).cast("long"), lambda so_far, x: so_far + x["base"])
    rows = dealt.withColumn("_left", left).select(*entries.columns, "_left", F.posexplode("_shares").alias("_at", "_share"))
    extra = F.when(F.col("_at") < F.col("_left"), 1).otherwise(0) if total > 0 else F.when(F.col("_at") == 0, F.col("_left")).otherwise(0)
    part = F.signum(F.col(amount).cast("double")).cast("long") * (F.col("_share.base") + extra)
    return rows.select(*entries.columns, "_share.of.*", part.cast("long").alias("part"))


def line(code: Column | int, debit: Column, credit: Column, detail: Column) -> Column:
    as_column = F.lit(code) if isinstance(code, int) else code
    zero = F.lit(0).cast("long")
    return F.struct(as_column.cast("long").alias("code"), F.coalesce(debit, zero).cast("long").alias("debit"), F.coalesce(credit, zero).cast("long").alias("credit"), detail.alias("detail"))


def explode_lines(entries: DataFrame, keys: list[str], lines: list[Column]) -> DataFrame:
    """One row per line of each entry; lines without an amount are left out."""
    out = entries.select(*keys, F.posexplode(F.array(*lines)).alias("line_no", "line")).select(*keys, "line_no", "line.*")
    return out.where((F.col("debit") != 0) | (F.col("credit") != 0))


def split_side(amount: Column) -> tuple[Column, Column]:
    """Debit of a positive amount, credit of a negative one."""
    return F.when(amount > 0, amount), F.when(amount < 0, -amount)
