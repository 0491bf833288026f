"""Closing of card settlements and the register of emitted documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from reconlake.operators.assign import shared_folder
from reconlake.operators.closing import branch_entries, consolidation_entry, entry_lines, settlement_legs
from reconlake.operators.emissions import EmissionRegister
from reconlake.plans.catalog import query

LEGS_SQL = """
    SELECT pos_id, settlement_id, CAST(n - 1 AS integer) AS leg, branch_id, CAST(CASE WHEN n = 1 THEN amount - (whole - gross) ELSE gross END AS bigint) AS pos_amount,
      CAST(gross - fees AS bigint) AS net, CAST(fees AS bigint) AS fee, CAST(CASE WHEN n = 1 THEN api ELSE 0 END AS bigint) AS api_fee
    FROM (SELECT r.pos_id, r.settlement_id, p.branch_id, abs(p.amount) AS amount, coalesce(p.api_fee, 0) AS api, s.gross, s.fee + s.fee_tax AS fees,
        row_number() OVER (PARTITION BY r.pos_id ORDER BY r.settlement_id) AS n, sum(s.gross) OVER (PARTITION BY r.pos_id) AS whole
      FROM card_pairs r JOIN card_sales p ON p.pos_id = r.pos_id JOIN card_settlements s ON s.settlement_id = r.settlement_id
      WHERE r.pos_id NOT IN (SELECT pos_id FROM card_consumed WHERE pos_id IS NOT NULL) AND r.settlement_id NOT IN (SELECT settlement_id FROM card_consumed WHERE settlement_id IS NOT NULL)) AS x"""
SUMS_SQL = f"""
    SELECT branch_id, sum(net) AS net, sum(fee) AS fee, sum(pos_amount) AS pos, sum(CASE WHEN api_fee > 0 THEN api_fee ELSE fee END) AS booked FROM ({LEGS_SQL}) AS l GROUP BY branch_id"""


def legs(v):
    return settlement_legs(v.card_pairs, v.card_sales, v.card_settlements, v.card_consumed)


@query("L07_pending_legs", LEGS_SQL)
def pending_legs(v):
    return legs(v).drop("sale_date")


@query("L06_branch_entries", f"""
    WITH s AS ({SUMS_SQL}), d AS (SELECT *, net + fee AS sales, net + fee - pos AS surcharge, booked - (net + fee - pos) AS rest, booked - fee AS favour FROM s), l AS (
      SELECT branch_id, 0 AS line_no, 17 AS code, 0 AS debit, sales AS credit, 'sales' AS detail FROM d
      UNION ALL SELECT branch_id, 1, 200, net, 0, 'treasury' FROM d UNION ALL SELECT branch_id, 2, 708, surcharge, 0, 'commission' FROM d
      UNION ALL SELECT branch_id, 3, 1403, greatest(rest, 0), greatest(-rest, 0), 'difference' FROM d WHERE rest <> 0
      UNION ALL SELECT branch_id, 4, 1403, greatest(-favour, 0), greatest(favour, 0), CASE WHEN favour > 0 THEN 'difference in favour' ELSE 'difference against' END FROM d WHERE favour <> 0)
    SELECT branch_id, line_no, CAST(code AS bigint) AS code, CAST(debit AS bigint) AS debit, CAST(credit AS bigint) AS credit, detail FROM l""")
def entries(v):
    return branch_entries(legs(v))


@query("L06_consolidation", f"""
    WITH s AS ({SUMS_SQL}), n AS (SELECT s.branch_id, s.net, b.branch, CASE WHEN s.branch_id % 2 = 0 THEN 700 + s.branch_id END AS own FROM s LEFT JOIN branch b ON b.branch_id = s.branch_id AND b.branch_id <> 5)
    SELECT CAST(17 AS bigint) AS code, CAST(sum(net) AS bigint) AS debit, CAST(0 AS bigint) AS credit, 'consolidated treasury' AS detail FROM n
    UNION ALL SELECT CAST(coalesce(CASE WHEN branch IS NOT NULL THEN own END, branch_id) AS bigint), 0, CAST(net AS bigint), coalesce(branch, '#' || CAST(branch_id AS string)) FROM n""")
def consolidated(v):
    """Branch 5 isn't in the register of branches, odd ones have no code of their own."""
    branches = v.branch.where("branch_id <> 5").select("branch_id", "branch", F.when(F.col("branch_id") % 2 == 0, 700 + F.col("branch_id")).alias("code"))
    return consolidation_entry(legs(v), branches)


def _documents(rows, key, off=None):
    """A document per key of bank rows: their ids as references, an expense and a bank line."""
    size, none = F.sum(F.abs("amount")), F.lit(0).cast("long")
    lines = F.array(F.struct((size + (F.lit(0) if off is None else F.max(off))).alias("debit"), none.alias("credit")), F.struct(none.alias("debit"), size.alias("credit")))
    return rows.groupBy(key.alias("key")).agg(F.collect_set("bank_id").alias("refs"), lines.alias("lines"))


@query("L11_emission_register", """
    WITH b AS (SELECT DISTINCT bank_id, account_id, abs(amount) AS size, month(post_date) AS m FROM bank WHERE direction = 'OUT' AND post_date >= DATE '1997-01-01' AND post_date < DATE '1998-01-01')
    SELECT '0-' || CAST(account_id AS string) || '/' || CAST(m AS string) AS folio, 'monthly' AS origin, CAST(count(DISTINCT bank_id) AS integer) AS n, CAST(sum(size) AS bigint) AS total FROM b WHERE account_id <> 2 AND m <> 3 GROUP BY account_id, m
    UNION ALL
    SELECT '2-' || CAST(account_id AS string) || '/' || CAST((m - 1) // 3 AS string), 'quarterly', CAST(count(DISTINCT bank_id) AS integer), CAST(sum(size) AS bigint) FROM b WHERE account_id = 2 GROUP BY account_id, (m - 1) // 3""")
def register(v):
    """Months of all accounts (March is off by one and refused), account 2 undone, then quarters: only those of account 2 are free."""
    book = EmissionRegister(v.spark, shared_folder(v.spark, "register"))
    rows = v.bank.where("direction = 'OUT' AND post_date >= DATE '1997-01-01' AND post_date < DATE '1998-01-01'").select("bank_id", "account_id", "amount", F.month("post_date").alias("m")).distinct()
    account = F.col("account_id").cast("string")
    months = _documents(rows, F.concat_ws("/", account, F.col("m").cast("string")), F.when(F.col("m") == 3, 1).otherwise(0))
    first = book.emit(0, "monthly", months)
    book.undo(1, first.where("key LIKE '2/%' AND folio IS NOT NULL"))
    book.emit(2, "quarterly", _documents(rows, F.concat_ws("/", account, F.floor((F.col("m") - 1) / 3).cast("string"))))
    total = F.aggregate("lines", F.lit(0).cast("long"), lambda n, x: n + x["debit"])
    return book.open_emissions().select("folio", "origin", F.size("refs").alias("n"), total.alias("total"))


@query("L13_close_undo_trash", f"""
    WITH l AS ({LEGS_SQL})
    SELECT settlement_id, CASE WHEN settlement_id % 7 = 1 THEN 'trash' WHEN branch_id = 1 THEN 'open' ELSE 'closing' END AS state FROM l""")
def close_undo_trash(v):
    """Some settlements are set aside, all branches closed, branch 1 undone; its settlements are open again, those set aside are not."""
    book, own = EmissionRegister(v.spark, shared_folder(v.spark, "closing")), legs(v)
    nothing = F.array().cast("array<struct<debit:long,credit:long>>")
    aside = own.where("settlement_id % 7 = 1").select(F.col("settlement_id").cast("string").alias("key"), F.array(F.concat(F.lit("s"), F.col("settlement_id").cast("string"))).alias("refs"), nothing.alias("lines"))
    book.emit(0, "trash", aside)
    left = own.where("settlement_id % 7 <> 1")
    refs = left.groupBy("branch_id").agg(F.collect_set(F.concat(F.lit("s"), F.col("settlement_id").cast("string"))).alias("refs"))
    closed = book.emit(1, "closing", entry_lines(branch_entries(left), "branch_id").join(refs, "branch_id").withColumnRenamed("branch_id", "key"))
    book.undo(2, closed.where("key = 1"))
    held = book.consumed().select(F.substring("ref", 2, 30).cast("long").alias("settlement_id"), F.col("origin").alias("state"))
    return own.select("settlement_id").join(held, "settlement_id", "left").select("settlement_id", F.coalesce("state", F.lit("open")).alias("state"))
