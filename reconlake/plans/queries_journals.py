"""Journals by their own rules, and what is learned or told about those who book."""

from __future__ import annotations

from pyspark.sql import functions as F

from reconlake.functions.names import memo_clues
from reconlake.operators.entities import ledger_codes
from reconlake.operators.journals import card_deposit_journal, difference_journal, expense_journal, transfer_lines, transfer_sides
from reconlake.operators.reports import mode_by
from reconlake.plans.catalog import query

#: Accounts with names and numbers, their codes, and labels of some codes.
ACCOUNTS_SQL = "a AS (SELECT account_id, 'Bank ' || CAST(bank_code AS string) AS bank, holder, '00-' || CAST(account_id AS string) AS number, account_id = 6 AS partial_use, 'Bank ' || CAST(bank_code AS string) || ' · ' || holder || ' · 00-' || CAST(account_id AS string) AS name, CASE WHEN account_id % 4 < 3 THEN 500 + account_id END AS code FROM account)"
LABELS = [(500, "First bank"), (501, "Second bank"), (2050, "Small differences"), (3002, "Rent")]
LABELS_SQL = "n(code, name) AS (VALUES (500, 'First bank'), (501, 'Second bank'), (2050, 'Small differences'), (3002, 'Rent'))"


def _accounts(v):
    return v.account.select("account_id", F.concat(F.lit("Bank "), F.col("bank_code").cast("string")).alias("bank"), "holder", F.concat(F.lit("00-"), F.col("account_id").cast("string")).alias("number"), (F.col("account_id") == 6).alias("partial_use"))


def _codes(v):
    return v.account.where("account_id % 4 < 3").select("account_id", (500 + F.col("account_id")).cast("long").alias("code"))


def _labels(v):
    return v.spark.createDataFrame(LABELS, "code long, name string")


_DOCUMENTS_SQL = """d AS (SELECT treasury_id, amount, client, 'PAGO ' || CAST(branch_id AS string) AS memo, branch_id, CASE WHEN branch_id % 3 = 0 THEN NULL ELSE 'Branch no ' || CAST(branch_id AS string) END AS branch,
      CASE WHEN treasury_id % 5 = 0 THEN NULL ELSE 3000 + branch_id END AS branch_code, CASE WHEN treasury_id % 2 = 0 THEN 900 END AS bank_code, CASE WHEN treasury_id % 11 = 0 THEN 77 END AS override_code FROM treasury WHERE direction = 'OUT'),
    l AS (SELECT DISTINCT treasury_id, bank_id, CASE WHEN bank_amount % 3 = 0 THEN bank_amount // 2 END AS allocated FROM links), b AS (SELECT DISTINCT bank_id, account_id, amount, nullif(trim(coalesce(counterparty, '')), '') AS counterparty, memo FROM bank)"""


@query("L02_expense_documents", f"""
    WITH {ACCOUNTS_SQL}, {LABELS_SQL}, {_DOCUMENTS_SQL}, m AS (SELECT d.*, l.bank_id, l.allocated, b.amount AS row_amount, b.counterparty, b.memo AS row_memo, a.bank, a.holder, a.code AS account_code FROM l JOIN d ON d.treasury_id = l.treasury_id JOIN b ON b.bank_id = l.bank_id JOIN a ON a.account_id = b.account_id)
    SELECT treasury_id AS group_id, 'bank' AS side, CAST(coalesce(override_code, account_code, bank_code) AS bigint) AS code, bank || ' ' || holder AS detail, coalesce(counterparty, client) AS party, coalesce(counterparty, row_memo) AS memo, CAST(NULL AS bigint) AS debit, CAST(abs(coalesce(allocated, row_amount)) AS bigint) AS credit FROM m
    UNION ALL
    SELECT d.treasury_id, 'expense', CAST(coalesce(branch_code, bank_code) AS bigint), coalesce(n.name, branch, 'Branch ' || CAST(branch_id AS string)), client, memo, CAST(abs(amount) AS bigint), NULL
    FROM d LEFT JOIN n ON n.code = coalesce(branch_code, bank_code) WHERE treasury_id IN (SELECT treasury_id FROM m)""")
def expenses(v):
    c = F.col
    t = v.treasury.where("direction = 'OUT'").select(
        "treasury_id", "amount", "client", F.concat(F.lit("PAGO "), c("branch_id").cast("string")).alias("memo"), "branch_id", F.when(c("branch_id") % 3 != 0, F.concat(F.lit("Branch no "), c("branch_id").cast("string"))).alias("branch"),
        F.when(c("treasury_id") % 5 != 0, 3000 + c("branch_id")).alias("branch_code"), F.when(c("treasury_id") % 2 == 0, 900).alias("bank_code"), F.when(c("treasury_id") % 11 == 0, 77).alias("override_code"),
    )
    links = v.links.select("treasury_id", "bank_id", F.when(c("bank_amount") % 3 == 0, F.expr("bank_amount div 2")).alias("allocated")).distinct()
    bank = v.bank.select("bank_id", "account_id", "amount", "counterparty", "memo").distinct()
    return expense_journal(links, t, bank, _accounts(v), _codes(v), _labels(v))


@query("L03_card_deposits", f"""
    WITH {ACCOUNTS_SQL}, r AS (SELECT bank_id, a.name, coalesce(counterparty, 'Transbank') AS party, trim(memo) AS memo, abs(amount) AS size FROM bank b JOIN a ON a.account_id = b.account_id WHERE direction = 'IN' AND memo LIKE 'ABN CRD TRANSBANK%')
    SELECT bank_id AS group_id, 'bank' AS side, CAST(230 AS bigint) AS code, name AS detail, party, memo, CAST(size AS bigint) AS debit, CAST(NULL AS bigint) AS credit FROM r
    UNION ALL SELECT bank_id, 'card', 17, 'Transbank', party, memo, NULL, CAST(size AS bigint) FROM r""")
def card_deposits(v):
    return card_deposit_journal(v.bank, _accounts(v))


def _difference_sql(mode: str) -> str:
    fee = "(memo LIKE '%Comision mantencion%' AND counterparty IS NULL AND counterparty_tax_id IS NULL)"
    wanted = {"in": "direction = 'IN' AND amount <= 3000000", "out": f"direction = 'OUT' AND amount >= -3000000 AND NOT {fee}", "fee": f"direction = 'OUT' AND {fee}"}[mode]
    code, name = (1503, "'Bank fees'") if mode == "fee" else (2050, "'Small differences'")
    size, none = "CAST(size AS bigint)", "CAST(NULL AS bigint)"
    own, other = (f"{size} AS debit, {none} AS credit", f"{none}, {size}") if mode == "in" else (f"{none} AS debit, {size} AS credit", f"{size}, {none}")
    return f"""
    WITH {ACCOUNTS_SQL}, {LABELS_SQL}, r AS (SELECT bank_id, CAST(a.code AS bigint) AS code, coalesce(n.name, a.bank) AS detail, coalesce(counterparty, '—') AS party, trim(memo) AS memo, abs(amount) AS size
      FROM bank b JOIN a ON a.account_id = b.account_id AND NOT a.partial_use LEFT JOIN n ON n.code = a.code WHERE {wanted} AND NOT (direction = 'IN' AND memo LIKE 'ABN CRD TRANSBANK%') AND amount <> 0
      AND bank_id NOT IN (SELECT bank_id FROM bank WHERE part_id % 19 = 0))
    SELECT bank_id AS group_id, 'bank' AS side, code, detail, party, memo, {own} FROM r
    UNION ALL SELECT bank_id, 'difference', {code}, {name}, party, memo, {other} FROM r"""


def _differences(v, mode):
    return difference_journal(v.bank, _accounts(v), _codes(v), _labels(v), mode, 3_000_000, v.bank.where("part_id % 19 = 0"))


@query("L04_small_income", _difference_sql("in"))
def small_income(v):
    return _differences(v, "in")


@query("L04_small_outgoings", _difference_sql("out"))
def small_outgoings(v):
    return _differences(v, "out")


@query("L04_bank_fees", _difference_sql("fee"))
def bank_fees(v):
    return _differences(v, "fee")


@query("L05_transfers_between_owners", f"""
    WITH {ACCOUNTS_SQL}, b AS (SELECT DISTINCT bank_id, account_id, amount, counterparty, counterparty_tax_id, memo, post_date, direction, amount_key FROM bank),
      o AS (SELECT * FROM b WHERE direction = 'OUT'), i AS (SELECT * FROM b WHERE direction = 'IN'),
      p AS (SELECT o.bank_id AS out_id, i.bank_id AS in_id, o.account_id % 5 = i.account_id % 5 AS intra FROM o JOIN i ON i.amount_key = o.amount_key AND i.post_date = o.post_date AND i.account_id <> o.account_id),
      x AS (SELECT p.*, abs(o.amount) AS size, ao.name AS out_name, ao.code AS out_code, ai.name AS in_name, ai.code AS in_code, coalesce(o.counterparty, o.counterparty_tax_id) AS out_party, coalesce(i.counterparty, i.counterparty_tax_id) AS in_party, o.memo AS out_memo, i.memo AS in_memo
        FROM p JOIN b o ON o.bank_id = p.out_id JOIN b i ON i.bank_id = p.in_id JOIN a ao ON ao.account_id = o.account_id JOIN a ai ON ai.account_id = i.account_id WHERE NOT p.intra)
    SELECT out_id AS group_id, 'debit' AS side, CAST(in_code AS bigint) AS code, out_name AS detail, in_party AS party, in_memo AS memo, CAST(size AS bigint) AS debit, CAST(NULL AS bigint) AS credit FROM x
    UNION ALL SELECT out_id, 'credit', CAST(out_code AS bigint), in_name, out_party, out_memo, NULL, CAST(size AS bigint) FROM x""")
def transfers(v):
    """Pairs of one day and size bucket on two accounts, without those of one owner; they meet with all that their lines need and move no more."""
    b = v.bank.select("bank_id", "account_id", "amount", "counterparty", "counterparty_tax_id", "memo", "post_date", "direction", "amount_key").distinct()
    rows = [b.where(f"direction = '{way}'").select(F.col("bank_id").alias(f"{side}_id"), F.col("account_id").alias(f"{side}_account"), "amount_key", "post_date") for way, side in (("OUT", "out"), ("IN", "in"))]
    out, into = (some.join(whole, f"{side}_id") for some, whole, side in zip(rows, transfer_sides(b, _accounts(v), _codes(v)), ("out", "in")))
    met = out.join(into, ["amount_key", "post_date"])
    return transfer_lines(met.where("out_account <> in_account AND out_account % 5 <> in_account % 5"))


@query("E20_learned_or_inferred_code", """
    WITH o AS (SELECT account_id, 700 + branch_id AS code, count(*) AS n FROM treasury WHERE is_exception AND account_id % 2 = 0 GROUP BY 1, 2),
      m AS (SELECT account_id, code FROM (SELECT *, row_number() OVER (PARTITION BY account_id ORDER BY n DESC, code) AS r FROM o) WHERE r = 1)
    SELECT a.account_id, CAST(coalesce(m.code, CASE WHEN a.account_id % 4 = 1 THEN 500 + a.account_id END) AS bigint) AS code, m.code IS NOT NULL AS learned FROM account a LEFT JOIN m ON m.account_id = a.account_id""")
def learned_or_inferred(v):
    """The code that was put in by hand most often for the account, else the one whose name fits."""
    overrides = v.treasury.where("is_exception AND account_id % 2 = 0").select("account_id", (700 + F.col("branch_id")).alias("code"))
    learned = mode_by(overrides, ["account_id"], "code").select("account_id", F.col("code").cast("long").alias("learned_code"))
    accounts = v.account.select("account_id", F.concat(F.lit("Bank "), F.col("bank_code").cast("string")).alias("bank"), "holder", F.lit(None).cast("string").alias("holder_tax_id"))
    codes = v.account.select((500 + F.col("account_id")).alias("code"), F.when(F.col("account_id") % 4 == 1, F.col("holder")).otherwise("zz").alias("name"), F.lit(None).cast("long").alias("account_id"))
    inferred = ledger_codes(accounts, codes, explicit=False, least=3)
    return inferred.join(learned, "account_id", "left").select("account_id", F.coalesce("learned_code", F.col("code").cast("long")).alias("code"), F.col("learned_code").isNotNull().alias("learned"))


@query("G08_cashier_memos", """
    WITH t AS (SELECT *, CASE treasury_id % 4 WHEN 0 THEN 'EXCELLENT' WHEN 1 THEN 'FAIR' WHEN 2 THEN 'POOR' ELSE 'GOOD' END AS q FROM treasury WHERE coalesce(state, '') <> 'ANU' AND kind <> 'TBK' AND kind IS NOT NULL),
      g AS (SELECT cashier_id, min(CASE WHEN treasury_id % 3 = 0 THEN 'Cashier ' || CAST(cashier_id AS string) END) AS cashier, count(*) AS n, sum(CASE WHEN tax_id IS NULL THEN 1 ELSE 0 END) AS nameless, sum(CASE WHEN tax_id IS NULL THEN amount ELSE 0 END) AS nameless_total,
        sum(CASE WHEN branch_id % 5 <> 0 THEN 1 ELSE 0 END) AS sales, sum(CASE WHEN branch_id % 5 <> 0 THEN amount ELSE 0 END) AS total, sum(CASE WHEN branch_id % 5 <> 0 AND q = 'EXCELLENT' THEN 1 ELSE 0 END) AS excellent, sum(CASE WHEN branch_id % 5 <> 0 AND q = 'GOOD' THEN 1 ELSE 0 END) AS good,
        sum(CASE WHEN branch_id % 5 <> 0 AND q = 'FAIR' THEN 1 ELSE 0 END) AS fair, sum(CASE WHEN branch_id % 5 <> 0 AND q = 'POOR' THEN 1 ELSE 0 END) AS poor FROM t GROUP BY cashier_id)
    SELECT cashier_id, cashier, CAST(n AS bigint) AS n, CAST(nameless AS bigint) AS nameless, CAST(nameless_total AS bigint) AS nameless_total, CAST(sales AS bigint) AS sales, CAST(total AS bigint) AS total, CAST(excellent AS bigint) AS excellent, CAST(good AS bigint) AS good,
      CAST(fair AS bigint) AS fair, CAST(poor AS bigint) AS poor, CAST(CASE WHEN sales > 0 THEN floor((200 * excellent + 150 * good + 80 * fair + sales) / (2 * sales)) ELSE 0 END AS bigint) AS score FROM g ORDER BY total DESC, cashier_id LIMIT 10""")
def cashier_memos(v):
    """The ten cashiers with the highest sales, with how well their memos name bank, holder and client; card sales and annulled rows don't count."""
    c = F.col
    rows = v.treasury.where("coalesce(state, '') <> 'ANU' AND kind <> 'TBK'")
    forms = F.array(*[F.lit(x) for x in ("DEP BCI ME SPA 12.345.678-9", "GIRO APP 12345", "99", "DEP BCI MG SPA")])
    items = F.array(F.struct(F.when(c("branch_id") % 5 == 0, "Deposito").otherwise("VENTA oro").alias("name")))
    rows = rows.withColumn("quality", memo_clues(F.element_at(forms, (c("treasury_id") % 4 + 1).cast("int")))["quality"]).withColumn("items", items)
    sale = F.exists("items", lambda i: F.lower(i["name"]).startswith("venta"))
    nameless = c("tax_id").isNull()
    count = lambda when: F.sum(F.when(when, 1).otherwise(0))
    total = lambda when: F.sum(F.when(when, c("amount")).otherwise(0))
    grades = [count(sale & (c("quality") == q.upper())).alias(q) for q in ("excellent", "good", "fair", "poor")]
    sums = rows.groupBy("cashier_id").agg(F.min(F.when(c("treasury_id") % 3 == 0, F.concat(F.lit("Cashier "), c("cashier_id").cast("string")))).alias("cashier"), F.count("*").alias("n"), count(nameless).alias("nameless"), total(nameless).alias("nameless_total"), count(sale).alias("sales"), total(sale).alias("total"), *grades)
    score = F.when(c("sales") > 0, F.expr("(200 * excellent + 150 * good + 80 * fair + sales) div (2 * sales)")).otherwise(F.lit(0))
    return sums.withColumn("score", score.cast("long")).orderBy(F.desc("total"), "cashier_id").limit(10)
