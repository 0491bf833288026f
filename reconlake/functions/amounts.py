"""Money as whole numbers from the texts that statements and settlements hold."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_amount(text: Column) -> Column:
    """Whole amount of a text with either separator; decimals are cut off, junk is null.

    With both separators the later one is decimal; a single one is decimal before one or two digits at the end.
    A leading `-` or `(` makes the amount negative.
    """
    trimmed = F.trim(text)
    bare = F.regexp_replace(F.regexp_replace(trimmed, r"[()$\s]", ""), r"^-?\+?", "")
    both = bare.contains(".") & bare.contains(",")
    cut = F.when(both, F.regexp_replace(bare, r"[.,][^.,]*$", "")).otherwise(F.regexp_replace(bare, r"^([^.,]*)[.,]\d{1,2}$", "$1"))
    digits = F.regexp_replace(F.regexp_replace(cut, r"[.,]", ""), r"^0+(?=\d)", "")
    value = F.when(digits.rlike(r"^\d{1,18}$"), digits).cast("long")
    return F.when(trimmed.startswith("-") | trimmed.startswith("("), -value).otherwise(value)


def parse_gross(text: Column) -> Column:
    """Whole amount of a settlement cell: a final separator with one or two digits is decimal and rounds; junk is 0."""
    kept = F.regexp_replace(F.coalesce(text, F.lit("")), r"[^0-9.,-]", "")
    decimal = kept.rlike(r"[.,]\d{1,2}$")
    whole = F.regexp_replace(F.when(decimal, F.regexp_replace(kept, r"[.,]\d{1,2}$", "")).otherwise(kept), r"[.,]", "")
    number = F.when(decimal, F.concat(whole, F.lit("."), F.regexp_extract(kept, r"[.,](\d{1,2})$", 1))).otherwise(whole)
    return F.coalesce(F.round(number.try_cast("decimal(20,2)")).cast("long"), F.lit(0).cast("long"))


def gross_up(net: Column, rate_bp: int) -> tuple[Column, Column]:
    """Gross amount and retention for a net amount at a rate in hundredths of a percent, rounded half up."""
    divisor = 10_000 - rate_bp
    wide = net.cast("decimal(38,0)")
    gross = F.floor((wide * 10_000 + divisor // 2) / F.lit(divisor).cast("decimal(10,0)")).cast("long")
    return gross, gross - net


def prefix_ranges(amount: Column, prefix: int, digits: int = 13) -> Column:
    """Whether the amount, without its sign, begins with the digits of `prefix`: a union of ranges that scans can use."""
    size = F.abs(amount)
    hits = [(size >= prefix * 10**k) & (size < (prefix + 1) * 10**k) for k in range(digits - len(str(prefix)) + 1)]
    out = hits[0]
    for hit in hits[1:]:
        out = out | hit
    return out
