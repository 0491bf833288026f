"""The expense run: which outgoing bank row paid which expense."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reconlake.functions.names import plain_upper, recipient_tokens, same_tax_id, tax_ids_in
from reconlake.operators.assign import greedy_assign
from reconlake.operators.candidates import window_join
from reconlake.operators.scoring import expense_score, status_of

DAYS = 7


def expense_pool(bank: DataFrame, *taken: DataFrame) -> DataFrame:
    """Outgoing bank rows that none of `taken` (bank_id: linked, mirrored, settled by hand, partly used) holds."""
    pool = bank.where("direction = 'OUT'")
    for some in taken:
        pool = pool.join(some.select("bank_id").distinct(), "bank_id", "left_anti")
    return pool


def expense_run(expenses: DataFrame, pool: DataFrame) -> DataFrame:
    """(treasury_id, bank_id, score, status): equal amounts within a week, scored, one bank row to an expense.

    A word of the expense's recipient in the counterparty's name and a tax id of the memo that is the counterparty's add to
    the score; what would only be under review is left out.
    """
    e = expenses.select("treasury_id", F.abs("amount").alias("size"), "doc_date", F.col("memo").alias("expense_memo"))
    b = pool.select("bank_id", F.abs("amount").alias("size"), "post_date", "counterparty", "counterparty_tax_id")
    met = window_join(e, b, ["size"], "doc_date", "post_date", DAYS)
    named = F.exists(recipient_tokens(F.col("expense_memo")), lambda w: plain_upper(F.coalesce("counterparty", F.lit(""))).contains(w))
    same = F.exists(tax_ids_in(F.col("expense_memo")), lambda t: same_tax_id(t, F.col("counterparty_tax_id")))
    scored = met.select("treasury_id", "bank_id", expense_score(F.col("delta"), named, F.coalesce(same, F.lit(False))).alias("score"), F.abs("delta").alias("days"))
    won = greedy_assign(scored, "treasury_id", "bank_id", [-F.col("score"), F.col("days"), F.col("treasury_id"), F.col("bank_id")])
    return won.select("treasury_id", "bank_id", "score", status_of(F.col("score"), 50, 30, None).alias("status")).where("status IS NOT NULL")
