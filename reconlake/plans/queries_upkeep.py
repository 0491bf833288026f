"""Rebuilds, merges, backfills, diagnostics and the scalar functions that the other modules leave out."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from reconlake.functions.amounts import gross_up, parse_gross
from reconlake.functions.dates import MONTHS, aging_bucket, parse_spanish_date, sheet_serial
from reconlake.functions.names import account_digits, line_detail, same_tax_id, short_hash, tokens
from reconlake.operators.dedup import latest_by
from reconlake.operators.journal import apportion_each, explode_lines, line
from reconlake.operators.scoring import status_of
from reconlake.plans.catalog import REGISTRY, query
from reconlake.plans.queries_match import pair_scores
from reconlake.plans.queries_report import TODAY
from reconlake.plans.queries_rules import _two_sided, _two_sided_sql
from reconlake.plans.queries_text import FORMS, TEXTS, _lines

SPANISH = [name for name, number in MONTHS.items() if name != "setiembre"]


@query("A02_parametrised_scan", "SELECT bank_id, amount FROM bank WHERE account_id = 3 AND abs(amount) >= 1000000")
def parametrised(v):
    return v.spark.sql("SELECT bank_id, amount FROM {bank} WHERE account_id = :account AND abs(amount) >= :least", args={"account": 3, "least": 1_000_000}, bank=v.bank)


@query("B03_rebuild", """
    SELECT treasury_id, status FROM matches WHERE status = 'MANUAL'
    UNION ALL SELECT DISTINCT t.treasury_id, 'AUTO' FROM treasury t JOIN links l ON l.treasury_id = t.treasury_id WHERE NOT EXISTS (SELECT 1 FROM matches m WHERE m.treasury_id = t.treasury_id AND m.status = 'MANUAL')""")
def rebuilt(v):
    manual = v.matches.where("status = 'MANUAL'")
    again = v.treasury.select("treasury_id").join(v.links, "treasury_id", "left_semi").join(manual, "treasury_id", "left_anti").distinct()
    return manual.select("treasury_id", "status").unionByName(again.withColumn("status", F.lit("AUTO")))


@query("C01_pruned_columns", "SELECT l_orderkey, l_linenumber, length(l_returnflag) AS flag_length FROM lineitem WHERE l_quantity >= 45")
def pruned(v):
    return v.table("lineitem").where("l_quantity >= 45").select("l_orderkey", "l_linenumber", F.length("l_returnflag").cast("long").alias("flag_length"))


@query("C17_queue", f"""
    SELECT 'treasury' AS side, CAST(treasury_id AS string) AS id FROM treasury WHERE kind = 'TBK' AND doc_date >= DATE '{TODAY}' - INTERVAL 365 DAY
    UNION ALL SELECT 'bank', bank_id FROM bank WHERE post_date >= DATE '{TODAY}' - INTERVAL 425 DAY""")
def queue(v):
    since = F.lit(TODAY).cast("date")
    own = v.treasury.where((F.col("kind") == "TBK") & (F.col("doc_date") >= F.date_sub(since, 365))).select(F.lit("treasury").alias("side"), F.col("treasury_id").cast("string").alias("id"))
    return own.unionByName(v.bank.where(F.col("post_date") >= F.date_sub(since, 425)).select(F.lit("bank").alias("side"), F.col("bank_id").alias("id")))


@query("E04_statuses", f"SELECT treasury_id, bank_id, CASE WHEN score >= 50 THEN 'AUTO' WHEN score >= 35 THEN 'SUGGESTED' ELSE 'REVIEW' END AS status FROM ({REGISTRY['E03_pair_scores'][1]})")
def statuses(v):
    return pair_scores(v).select("treasury_id", "bank_id", status_of(F.col("score")).alias("status"))


@query("E18_ledger_codes", """
    SELECT a.account_id, CAST(coalesce(CASE WHEN a.account_id % 3 = 0 THEN 100 + a.account_id END, 200 + n.n_nationkey, 300 + c.code, 999) AS bigint) AS code FROM account a
    LEFT JOIN nation n ON n.n_nationkey = a.bank_code AND n.n_nationkey % 2 = 0
    LEFT JOIN (SELECT n_nationkey AS code FROM nation WHERE n_nationkey % 3 = 0) AS c ON c.code = a.bank_code""")
def ledger_codes(v):
    nation = v.table("nation").select(F.col("n_nationkey").alias("bank_code"))
    named, entity = nation.where("bank_code % 2 = 0").withColumn("named", 200 + F.col("bank_code")), nation.where("bank_code % 3 = 0").withColumn("entity", 300 + F.col("bank_code"))
    found = v.account.join(named, "bank_code", "left").join(entity, "bank_code", "left")
    explicit = F.when(F.col("account_id") % 3 == 0, 100 + F.col("account_id"))
    return found.select("account_id", F.coalesce(explicit, "named", "entity", F.lit(999)).cast("long").alias("code"))


@query("F06_merged_links", """
    WITH g AS (SELECT account_id, post_date, min(bank_id) AS winner, count(*) AS n FROM bank GROUP BY 1, 2 HAVING count(*) > 1)
    SELECT g.winner, CAST(max(g.n) AS bigint) AS n, count(DISTINCT l.treasury_id) > 1 AS conflict, CAST(count(CASE WHEN l.bank_id <> g.winner THEN 1 END) AS bigint) AS moved
    FROM g JOIN bank b ON b.account_id = g.account_id AND b.post_date = g.post_date LEFT JOIN links l ON l.bank_id = b.bank_id GROUP BY g.winner""")
def merged(v):
    group = Window.partitionBy("account_id", "post_date")
    rows = v.bank.select("account_id", "post_date", "bank_id", F.min("bank_id").over(group).alias("winner"), F.count("*").over(group).alias("n")).where("n > 1")
    met = rows.join(v.links.select("bank_id", "treasury_id", F.lit(True).alias("is_link")), "bank_id", "left")
    return met.groupBy("winner").agg(F.max("n").alias("n"), (F.countDistinct("treasury_id") > 1).alias("conflict"), F.count(F.when(F.col("is_link") & (F.col("bank_id") != F.col("winner")), 1)).alias("moved"))


@query("I01_latest_first", "SELECT account_id, bank_id, CAST(n AS bigint) AS place FROM (SELECT account_id, bank_id, row_number() OVER (PARTITION BY account_id ORDER BY post_date DESC, bank_id DESC) AS n FROM bank) WHERE n <= 5")
def latest_first(v):
    place = F.row_number().over(Window.partitionBy("account_id").orderBy(F.desc("post_date"), F.desc("bank_id")))
    return v.bank.withColumn("place", place).where("place <= 5").select("account_id", "bank_id", F.col("place").cast("long").alias("place"))


@query("J06_shared_tokens", "SELECT bank_id, CAST(CASE WHEN counterparty IS NOT NULL AND contains(memo, 'Customer') THEN 1 ELSE 0 END AS bigint) AS shared FROM bank")
def shared_tokens(v):
    return v.bank.select("bank_id", F.size(F.array_intersect(tokens(F.col("counterparty")), tokens(F.col("memo")))).cast("long").alias("shared"))


@query("K02_parse_gross", f"SELECT l_orderkey, l_linenumber, cents, CAST(CASE form WHEN 5 THEN 0 WHEN 2 THEN -cents WHEN 3 THEN cents + 1 WHEN 4 THEN cents + 1 ELSE cents END AS bigint) AS gross FROM ({TEXTS})")
def gross(v):
    return _lines(v, f"l_orderkey, l_linenumber, cents, {FORMS} AS written").select("l_orderkey", "l_linenumber", "cents", parse_gross(F.col("written")).alias("gross"))


@query("K04_spanish_dates", "SELECT treasury_id, CAST(doc_date AS string) AS parsed FROM treasury")
def spanish(v):
    month = F.element_at(F.array(*[F.lit(m) for m in SPANISH]), F.month("doc_date"))
    written = F.concat_ws(" ", F.date_format("doc_date", "dd"), month, F.year("doc_date").cast("string"))
    return v.treasury.select("treasury_id", parse_spanish_date(written, 2000).cast("string").alias("parsed"))


@query("K09_same_tax_id", "SELECT bank_id, coalesce(counterparty_tax_id = CAST(10000000 + part_id % 40 AS string) || '-K', FALSE) AS same FROM bank")
def same_ids(v):
    other = F.concat(F.lit("000"), (10_000_000 + F.col("part_id") % 40).cast("string"), F.lit("-k"))
    return v.bank.select("bank_id", F.coalesce(same_tax_id(F.col("counterparty_tax_id"), other), F.lit(False)).alias("same"))


@query("K16_short_hash", "SELECT treasury_id, substr(sha256(CAST(treasury_id AS string) || '|' || client), 1, 32) AS hash, ltrim(CAST(treasury_id AS string), '0') AS digits FROM treasury")
def hashes(v):
    number = F.col("treasury_id").cast("string")
    return v.treasury.select("treasury_id", short_hash(number, F.col("client")).alias("hash"), account_digits(F.concat(F.lit("N 00-"), number)).alias("digits"))


@query("K27_age_and_serial", f"""
    SELECT treasury_id, CAST(date_diff('day', DATE '1970-01-01', doc_date) + 25569 AS bigint) AS serial, CAST(date_diff('day', doc_date, DATE '{TODAY}') AS bigint) AS delta,
      CASE WHEN greatest(date_diff('day', doc_date, DATE '{TODAY}'), 0) <= 7 THEN '0-7' WHEN date_diff('day', doc_date, DATE '{TODAY}') <= 30 THEN '8-30' WHEN date_diff('day', doc_date, DATE '{TODAY}') <= 60 THEN '31-60' ELSE '60+' END AS age FROM treasury""")
def ages(v):
    today = F.lit(TODAY).cast("date")
    return v.treasury.select("treasury_id", sheet_serial(F.col("doc_date")).cast("long").alias("serial"), F.datediff(today, "doc_date").cast("long").alias("delta"), aging_bucket(F.col("doc_date"), today).alias("age"))


@query("K29_line_detail", "SELECT bank_id, left(concat_ws(' - ', nullif(trim(memo), ''), counterparty, counterparty_tax_id), 50) AS detail FROM bank")
def details(v):
    return v.bank.select("bank_id", line_detail(F.col("memo"), F.lit("  "), F.col("counterparty"), F.col("counterparty_tax_id")).alias("detail"))


@query("K32_direction", "SELECT treasury_id, CASE WHEN state = 'CAJ' THEN 'IN' WHEN kind = 'TBK' THEN 'OUT' WHEN amount < 0 THEN 'OUT' ELSE 'IN' END AS derived FROM treasury")
def directions(v):
    by_sign = F.when(F.col("amount") < 0, "OUT").otherwise("IN")
    return v.treasury.select("treasury_id", F.coalesce(F.when(F.col("state") == "CAJ", "IN"), F.when(F.col("kind") == "TBK", "OUT"), by_sign).alias("derived"))


@query("L05_transfer_journal", _two_sided_sql("SELECT bank_id, account_id, amount FROM bank WHERE part_id % 13 = 0", 1900))
def transfer_journal(v):
    return _two_sided(v.bank.where("part_id % 13 = 0"), 1000 + F.col("account_id"), 1900, F.col("amount") > 0)


@query("L09_supplier_journal", """
    WITH e AS (SELECT treasury_id, account_id, abs(amount) AS net, CAST((CAST(abs(amount) AS hugeint) * 10000 + 4237) // 8475 AS bigint) AS gross FROM treasury WHERE direction = 'OUT' AND kind = 'NORMAL'),
    w AS (SELECT branch_id, CAST(headcount AS bigint) AS w FROM branch), s AS (SELECT e.*, branch_id, w, sum(w) OVER (PARTITION BY treasury_id) AS tot FROM e JOIN w ON TRUE),
    r AS (SELECT *, gross * w // tot AS base, gross * w % tot AS rem FROM s),
    k AS (SELECT *, gross - sum(base) OVER (PARTITION BY treasury_id) AS leftover, row_number() OVER (PARTITION BY treasury_id ORDER BY rem DESC, w DESC, branch_id) AS n FROM r)
    SELECT treasury_id, CAST(code AS bigint) AS code, CAST(debit AS bigint) AS debit, CAST(credit AS bigint) AS credit FROM (
      SELECT treasury_id, 100 + branch_id AS code, base + CASE WHEN n <= leftover THEN 1 ELSE 0 END AS debit, 0 AS credit FROM k
      UNION ALL SELECT treasury_id, 2108, 0, gross - net FROM e UNION ALL SELECT treasury_id, 1000 + account_id, 0, net FROM e) WHERE debit <> 0 OR credit <> 0""")
def supplier_journal(v):
    whole, kept = gross_up(F.abs("amount"), 1525)
    # supplier entries: outgoing rows of the normal kind
    entries = v.treasury.where("direction = 'OUT' AND kind = 'NORMAL'").select("treasury_id", "account_id", F.abs("amount").alias("net"), whole.alias("gross"), kept.alias("retention"))
    parts = apportion_each(entries, v.branch.select("branch_id", F.col("headcount").cast("long").alias("w")), "gross", "w", "branch_id")
    none, detail = F.lit(None), F.lit("supplier")
    costs = explode_lines(parts, ["treasury_id"], [line(100 + F.col("branch_id"), F.col("part"), none, detail)])
    paid = explode_lines(entries, ["treasury_id"], [line(2108, none, F.col("retention"), detail), line(1000 + F.col("account_id"), none, F.col("net"), detail)])
    return costs.unionByName(paid).select("treasury_id", "code", "debit", "credit")


@query("M06_tombstones", "SELECT bank_id FROM bank WHERE NOT (account_id = 1 AND part_id % 4 = 0)")
def tombstones(v):
    gone = v.bank.where("account_id = 1 AND part_id % 4 = 0").select("bank_id")
    return v.bank.select("bank_id").join(gone, "bank_id", "left_anti")


@query("M07_sliding_windows", """
    SELECT user_id % 7 AS branch_id, CAST(time_bucket(INTERVAL 5 MINUTE, CAST(ts AS timestamp)) - to_minutes(CAST(5 * i AS integer)) AS string) AS since, CAST(count(*) AS bigint) AS n
    FROM events, (SELECT unnest([0, 1, 2]) AS i) AS w GROUP BY 1, 2""")
def sliding(v):
    counts = v.table("events").groupBy((F.col("user_id") % 7).alias("branch_id"), F.window("ts", "15 minutes", "5 minutes").alias("w")).agg(F.count("*").alias("n"))
    return counts.select("branch_id", F.col("w.start").cast("string").alias("since"), "n")


@query("X06_rules_with_labels", "SELECT b.branch_id, b.branch, a.holder FROM branch b LEFT JOIN account a ON a.account_id = b.branch_id")
def rules_with_labels(v):
    return v.branch.join(v.account.select(F.col("account_id").alias("branch_id"), "holder"), "branch_id", "left").select("branch_id", "branch", "holder")


@query("X10_direction_backfill", "SELECT treasury_id, CASE WHEN amount < 0 THEN 'EGRESO' ELSE 'INGRESO' END AS operation FROM treasury")
def direction_backfill(v):
    return v.treasury.select("treasury_id", F.when(F.col("amount") < 0, "EGRESO").otherwise("INGRESO").alias("operation"))


@query("X13_fee_groups", "SELECT branch_id, fee = 0 AS no_fee, CAST(count(*) AS bigint) AS n, CAST(sum(gross) AS bigint) AS gross FROM settlement GROUP BY 1, 2")
def fee_groups(v):
    return v.settlement.groupBy("branch_id", (F.col("fee") == 0).alias("no_fee")).agg(F.count("*").alias("n"), F.sum("gross").alias("gross"))


@query("X14_last_imports", """
    SELECT account_id, order_id, CAST(n AS bigint) AS n FROM (SELECT account_id, order_id, count(*) OVER (PARTITION BY account_id) AS n, row_number() OVER (PARTITION BY account_id ORDER BY post_date DESC, bank_id DESC) AS k FROM bank) WHERE k = 1""")
def last_imports(v):
    counted = v.bank.groupBy("account_id").agg(F.count("*").alias("n"))
    return latest_by(v.bank, ["account_id"], [F.desc("post_date"), F.desc("bank_id")]).select("account_id", "order_id").join(counted, "account_id")
