"""Scans, filters, aggregations, windows, paging and set operations over the movement views."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from reconlake.functions.amounts import prefix_ranges
from reconlake.functions.dates import aging_bucket, sheet_serial
from reconlake.functions.names import counterparty_quality, is_bank_fee, is_card_deposit, is_small
from reconlake.operators.candidates import as_of
from reconlake.operators.dedup import latest_by
from reconlake.operators.reports import daily_flows, dominant, in_out, latest_value, mode_by, pivot_with_margins
from reconlake.operators.settings import settings
from reconlake.plans.catalog import query

TODAY = "2001-01-01"
SMALL = 300_000
CARD_SQL = "direction = 'IN' AND lower(memo) LIKE '%abn crd%' AND lower(memo) LIKE '%transba%'"
FEE_SQL = "direction = 'OUT' AND trim(coalesce(counterparty, '')) = '' AND trim(coalesce(counterparty_tax_id, '')) = '' AND lower(memo) LIKE '%comision%'"
AGING_SQL = "CASE WHEN d <= 7 THEN '0-7' WHEN d <= 30 THEN '8-30' WHEN d <= 60 THEN '31-60' ELSE '60+' END"


@query("H02_running_balance", """
    WITH opening AS (SELECT coalesce(CAST(sum(amount) AS bigint), 0) AS o FROM bank WHERE post_date < DATE '1998-01-01'),
    days AS (SELECT CAST(d AS date) AS day FROM (SELECT unnest(generate_series(DATE '1998-01-01', DATE '1998-12-31', INTERVAL 1 DAY)) AS d)),
    t AS (SELECT post_date AS day, sum(CASE WHEN amount > 0 THEN amount ELSE 0 END) AS total_in, sum(CASE WHEN amount < 0 THEN -amount ELSE 0 END) AS total_out, sum(amount) AS net
          FROM bank GROUP BY post_date)
    SELECT days.day, CAST(coalesce(total_in, 0) AS bigint) AS total_in, CAST(coalesce(total_out, 0) AS bigint) AS total_out,
      CAST((SELECT o FROM opening) + sum(coalesce(net, 0)) OVER (ORDER BY days.day) AS bigint) AS balance
    FROM days LEFT JOIN t ON t.day = days.day""", dates=("day",))  # fmt: skip
def running_balance(v):
    opening = v.bank.where("post_date < DATE '1998-01-01'").agg(F.coalesce(F.sum("amount"), F.lit(0)).alias("o"))
    flows = daily_flows(v.bank, "post_date", "amount", "1998-01-01", "1998-12-31", F.lit(0))
    # the opening balance is one row
    return flows.select("day", "total_in", "total_out", (F.col("balance") + F.lit(opening.first()["o"])).alias("balance"))


@query("A01_scan_page", "SELECT bank_id, account_id, amount, post_date FROM bank WHERE account_id = 3 AND post_date >= DATE '1998-01-01' ORDER BY post_date DESC, bank_id LIMIT 50 OFFSET 100", dates=("post_date",))
def scan_page(v):
    return v.bank.where("account_id = 3 AND post_date >= DATE '1998-01-01'").select("bank_id", "account_id", "amount", "post_date").orderBy(F.desc("post_date"), "bank_id").offset(100).limit(50)


@query("C02_date_range", "SELECT CAST(count(*) AS bigint) AS n, CAST(sum(amount) AS bigint) AS total FROM bank WHERE post_date >= DATE '1999-03-01' AND post_date < DATE '1999-04-01'")
def date_range(v):
    return v.bank.where("post_date >= DATE '1999-03-01' AND post_date < DATE_ADD(DATE '1999-03-31', 1)").agg(F.count("*").alias("n"), F.sum("amount").alias("total"))


@query("C03_text_search", "SELECT bank_id FROM bank WHERE memo ILIKE '%comision%' OR counterparty ILIKE '%customer 7%' OR counterparty_tax_id ILIKE '%007-k%'")
def text_search(v):
    return v.bank.where(F.col("memo").ilike("%comision%") | F.col("counterparty").ilike("%customer 7%") | F.col("counterparty_tax_id").ilike("%007-k%")).select("bank_id")


@query("C04_amount_prefix", "SELECT bank_id, amount FROM bank WHERE CAST(abs(amount) AS string) LIKE '123%'")
def amount_prefix(v):
    return v.bank.where(prefix_ranges(F.col("amount"), 123)).select("bank_id", "amount")


@query("C05_loose_search", "SELECT bank_id FROM bank WHERE regexp_replace(lower(concat_ws(' ', memo, counterparty, counterparty_tax_id)), '[^a-z0-9]', '', 'g') LIKE '%customer2410000024k%'")
def loose_search(v):
    bare = F.regexp_replace(F.lower(F.concat_ws(" ", "memo", "counterparty", "counterparty_tax_id")), "[^a-z0-9]", "")
    return v.bank.where(bare.contains("customer2410000024k")).select("bank_id")


@query("C06_card_deposits", f"SELECT account_id, CAST(count(*) AS bigint) AS n, CAST(sum(amount) AS bigint) AS total FROM bank WHERE {CARD_SQL} GROUP BY account_id")
def card_deposits(v):
    return v.bank.where(is_card_deposit(F.col("direction"), F.col("memo"))).groupBy("account_id").agg(F.count("*").alias("n"), F.sum("amount").alias("total"))


@query("C07_small_differences", f"SELECT bank_id, amount FROM bank WHERE abs(amount) > 0 AND abs(amount) <= {SMALL}")
def small_differences(v):
    return v.bank.where(is_small(F.col("amount"), SMALL)).select("bank_id", "amount")


@query("C08_bank_fees", f"SELECT bank_id, memo FROM bank WHERE {FEE_SQL}")
def bank_fees(v):
    return v.bank.where(is_bank_fee(F.col("direction"), F.col("memo"), F.col("counterparty"), F.col("counterparty_tax_id"))).select("bank_id", "memo")


@query("C10_memo_prefix_scope", "SELECT CAST(count(*) AS bigint) AS n FROM bank WHERE NOT (upper(memo) LIKE 'PAGO%' OR upper(memo) LIKE 'DEP (1)%')")
def memo_prefix_scope(v):
    memo = F.upper("memo")
    return v.bank.where(~(memo.startswith("PAGO") | memo.startswith("DEP (1)"))).agg(F.count("*").alias("n"))


@query("C12_null_safe_exclusion", "SELECT kind, CAST(count(*) AS bigint) AS n FROM treasury WHERE kind IS DISTINCT FROM 'TBK' AND state IS DISTINCT FROM 'ANU' GROUP BY kind")
def null_safe_exclusion(v):
    return v.treasury.where(~F.col("kind").eqNullSafe("TBK") & ~F.col("state").eqNullSafe("ANU")).groupBy("kind").agg(F.count("*").alias("n"))


RULES_SQL = "(VALUES (1, NULL, 'mantencion'), (2, 3, 'GIRO'), (3, NULL, 'PAGO 12')) AS rules(rule_no, rule_account, pattern)"


@query("C13_discard_rules", f"SELECT bank_id, CAST(min(rule_no) AS integer) AS rule_no FROM bank JOIN {RULES_SQL} ON contains(memo, pattern) AND (rule_account IS NULL OR rule_account = account_id) GROUP BY bank_id")
def discard_rules(v):
    rules = v.spark.sql(f"SELECT CAST(rule_no AS int) AS rule_no, CAST(rule_account AS bigint) AS rule_account, pattern FROM {RULES_SQL}")
    hit = F.contains("memo", "pattern") & (F.col("rule_account").isNull() | (F.col("rule_account") == F.col("account_id")))
    return v.bank.join(settings(rules), hit).groupBy("bank_id").agg(F.min("rule_no").alias("rule_no"))


@query("C16_counterparty_quality", """
    SELECT CASE WHEN coalesce(counterparty_tax_id, '') <> '' THEN 'with_id' WHEN coalesce(counterparty, '') <> '' THEN 'name_only' ELSE 'nothing' END AS quality, CAST(count(*) AS bigint) AS n FROM bank GROUP BY 1""")
def quality(v):
    return v.bank.groupBy(counterparty_quality(F.col("counterparty"), F.col("counterparty_tax_id")).alias("quality")).agg(F.count("*").alias("n"))


@query("C18_status_filter", "SELECT t.treasury_id, coalesce(m.status, 'UNPROCESSED') AS status FROM treasury t LEFT JOIN matches m ON m.treasury_id = t.treasury_id WHERE m.status IS NULL OR m.status IN ('REVIEW', 'NO_MATCH')")
def status_filter(v):
    return v.treasury.join(v.matches, "treasury_id", "left").where("status IS NULL OR status IN ('REVIEW', 'NO_MATCH')").select("treasury_id", F.coalesce("status", F.lit("UNPROCESSED")).alias("status"))


@query("D01_account_join", "SELECT a.holder, b.direction, CAST(count(*) AS bigint) AS n, CAST(sum(b.amount) AS bigint) AS total FROM bank b JOIN account a ON a.account_id = b.account_id GROUP BY a.holder, b.direction")
def account_join(v):
    return v.bank.join(v.account, "account_id").groupBy("holder", "direction").agg(F.count("*").alias("n"), F.sum("amount").alias("total"))


@query("D02_left_status", "SELECT coalesce(m.status, 'none') AS status, CAST(count(*) AS bigint) AS n, CAST(sum(t.amount) AS bigint) AS total FROM treasury t LEFT JOIN matches m ON m.treasury_id = t.treasury_id WHERE t.kind IS DISTINCT FROM 'TBK' GROUP BY 1")
def left_status(v):
    return v.treasury.where(~F.col("kind").eqNullSafe("TBK")).join(v.matches, "treasury_id", "left").groupBy(F.coalesce("status", F.lit("none")).alias("status")).agg(F.count("*").alias("n"), F.sum("amount").alias("total"))


LINKED_SQL = "SELECT DISTINCT bank_id FROM links JOIN matches ON matches.treasury_id = links.treasury_id WHERE status IN ('AUTO', 'MANUAL')"


def linked(v):
    return v.links.join(v.matches.where("status IN ('AUTO', 'MANUAL')"), "treasury_id").select("bank_id").distinct()


@query("D03_linked_sums", f"""
    SELECT account_id, CAST(sum(CASE WHEN l.bank_id IS NOT NULL THEN abs(amount) ELSE 0 END) AS bigint) AS linked, CAST(sum(abs(amount)) AS bigint) AS total
    FROM bank LEFT JOIN ({LINKED_SQL}) AS l ON l.bank_id = bank.bank_id GROUP BY account_id""")
def linked_sums(v):
    flagged = v.bank.join(linked(v).withColumn("hit", F.lit(True)), "bank_id", "left")
    return flagged.groupBy("account_id").agg(F.sum(F.when(F.col("hit"), F.abs("amount")).otherwise(0)).alias("linked"), F.sum(F.abs("amount")).alias("total"))


@query("D04_unlinked", f"SELECT bank_id FROM bank WHERE bank_id NOT IN ({LINKED_SQL})")
def unlinked(v):
    return v.bank.join(linked(v), "bank_id", "left_anti").select("bank_id")


@query("D05_not_in_status", "SELECT treasury_id FROM treasury t WHERE NOT EXISTS (SELECT 1 FROM matches m WHERE m.treasury_id = t.treasury_id AND m.status IN ('AUTO', 'MANUAL', 'OUT_OF_SCOPE'))")
def not_in_status(v):
    return v.treasury.join(v.matches.where("status IN ('AUTO', 'MANUAL', 'OUT_OF_SCOPE')"), "treasury_id", "left_anti").select("treasury_id")


@query("D06_consumed_or_trashed", """
    SELECT settlement_id FROM settlement WHERE settlement_id NOT IN (SELECT settlement_id FROM settlement WHERE gross % 5 = 0 UNION SELECT settlement_id FROM settlement WHERE branch_id = 2)""")
def consumed_or_trashed(v):
    s = v.settlement
    gone = s.where("gross % 5 = 0").select("settlement_id").union(s.where("branch_id = 2").select("settlement_id")).distinct()
    return s.join(gone, "settlement_id", "left_anti").select("settlement_id")


@query("D07_match_tree", """
    SELECT m.treasury_id, m.status, CAST(count(l.bank_id) AS bigint) AS n_links, string_agg(l.bank_id, '|' ORDER BY l.bank_id) AS bank_ids
    FROM matches m LEFT JOIN links l ON l.treasury_id = m.treasury_id WHERE m.status = 'AUTO' GROUP BY m.treasury_id, m.status""")
def match_tree(v):
    tree = v.matches.where("status = 'AUTO'").join(v.links, "treasury_id", "left").groupBy("treasury_id", "status")
    ids = F.array_sort(F.collect_list("bank_id"))
    return tree.agg(F.count("bank_id").alias("n_links"), F.when(F.count("bank_id") > 0, F.array_join(ids, "|")).alias("bank_ids"))


@query("D21_as_of_balance", """
    WITH points AS (SELECT account_id, CAST(d AS date) AS as_of_day FROM account, (SELECT unnest(generate_series(DATE '1996-01-01', DATE '2000-12-01', INTERVAL 1 MONTH)) AS d))
    SELECT p.account_id, p.as_of_day, (SELECT arg_max(b.balance_after, b.post_date || b.bank_id) FROM bank b WHERE b.account_id = p.account_id AND b.post_date < p.as_of_day AND b.balance_after IS NOT NULL) AS as_of_balance_after
    FROM points p""", dates=("as_of_day",))
def as_of_balance(v):
    points = v.account.select("account_id", F.explode(F.expr("sequence(DATE '1996-01-01', DATE '2000-12-01', INTERVAL 1 MONTH)")).alias("as_of_day"))
    return as_of(points, v.bank, ["account_id"], "as_of_day", "post_date", ["bank_id"], "balance_after")


@query("G01_in_out", "SELECT account_id, CAST(sum(CASE WHEN amount > 0 THEN amount ELSE 0 END) AS bigint) AS total_in, CAST(sum(CASE WHEN amount < 0 THEN -amount ELSE 0 END) AS bigint) AS total_out, CAST(sum(amount) AS bigint) AS net, CAST(count(*) AS bigint) AS n FROM bank GROUP BY account_id")
def in_and_out(v):
    return in_out(v.bank, ["account_id"])


STATES = ("AUTO", "MANUAL", "SUGGESTED", "REVIEW", "NO_MATCH", "OUT_OF_SCOPE", "ANNULLED", "UNPROCESSED")


@query("G02_status_counts", f"""
    SELECT s.status, CAST(count(t.treasury_id) AS bigint) AS n FROM (VALUES {", ".join(f"('{s}')" for s in STATES)}) AS s(status)
    LEFT JOIN (SELECT t.treasury_id, coalesce(m.status, 'UNPROCESSED') AS status FROM treasury t LEFT JOIN matches m ON m.treasury_id = t.treasury_id) AS t ON t.status = s.status GROUP BY s.status""")
def status_counts(v):
    counts = v.treasury.join(v.matches, "treasury_id", "left").groupBy(F.coalesce("status", F.lit("UNPROCESSED")).alias("status")).agg(F.count("*").alias("n"))
    names = v.spark.createDataFrame([(s,) for s in STATES], "status string")
    return names.join(counts, "status", "left").select("status", F.coalesce("n", F.lit(0)).alias("n"))


@query("G03_total_balance", "SELECT CAST(sum(b) AS bigint) AS balance FROM (SELECT account_id, arg_max(balance_after, post_date || bank_id) AS b FROM bank WHERE balance_after IS NOT NULL AND post_date < DATE '2000-01-01' GROUP BY account_id)")
def total_balance(v):
    return latest_value(v.bank.where("post_date < DATE '2000-01-01'"), ["account_id"], "balance_after", ["post_date", "bank_id"]).agg(F.sum("balance_after").alias("balance"))


@query("G04_kpis", """
    SELECT CASE WHEN post_date >= DATE '1999-07-01' THEN 'current' ELSE 'previous' END AS period, CAST(count(*) AS bigint) AS n,
      CAST(sum(CASE WHEN amount > 0 THEN amount ELSE 0 END) AS bigint) AS total_in, CAST(sum(CASE WHEN line_no <= 3 THEN 1 ELSE 0 END) * 10000 // count(*) AS bigint) AS link_rate_bp
    FROM bank WHERE post_date >= DATE '1999-06-01' AND post_date < DATE '1999-08-01' GROUP BY 1""")
def kpis(v):
    period = F.when(F.col("post_date") >= "1999-07-01", "current").otherwise("previous")
    rows = v.bank.where("post_date >= DATE '1999-06-01' AND post_date < DATE '1999-08-01'").groupBy(period.alias("period"))
    return rows.agg(F.count("*").alias("n"), F.sum(F.when(F.col("amount") > 0, F.col("amount")).otherwise(0)).alias("total_in"), F.expr("sum(CASE WHEN line_no <= 3 THEN 1 ELSE 0 END) * 10000 div count(*)").alias("link_rate_bp"))


@query("G05_account_balances", """
    SELECT account_id, arg_max(balance_after, post_date || bank_id) FILTER (WHERE balance_after IS NOT NULL) AS balance, max(post_date) AS last_day, CAST(count(*) AS bigint) AS n,
      CAST(count(DISTINCT post_date) AS bigint) AS days FROM bank GROUP BY account_id""", dates=("last_day",))
def account_balances(v):
    order = F.when(F.col("balance_after").isNotNull(), F.struct("post_date", "bank_id"))
    return v.bank.groupBy("account_id").agg(F.max_by("balance_after", order).alias("balance"), F.max("post_date").alias("last_day"), F.count("*").alias("n"), F.countDistinct("post_date").alias("days"))


@query("G06_backlog", f"SELECT m.status, CAST(count(*) AS bigint) AS n, CAST(sum(CASE WHEN date_diff('day', t.doc_date, DATE '{TODAY}') > 7 THEN 1 ELSE 0 END) AS bigint) AS backlog FROM matches m JOIN treasury t ON t.treasury_id = m.treasury_id GROUP BY m.status")
def backlog(v):
    late = F.datediff(F.lit(TODAY).cast("date"), "doc_date") > 7
    return v.matches.join(v.treasury, "treasury_id").groupBy("status").agg(F.count("*").alias("n"), F.sum(F.when(late, 1).otherwise(0)).alias("backlog"))


@query("G07_top_branches", """
    SELECT b.branch, CAST(sum(t.amount) AS bigint) AS total, CAST(count(*) AS bigint) AS n FROM treasury t JOIN branch b ON b.branch_id = t.branch_id
    WHERE t.direction = 'IN' GROUP BY b.branch ORDER BY total DESC, b.branch LIMIT 10""")
def top_branches(v):
    sums = v.treasury.where("direction = 'IN'").groupBy("branch_id").agg(F.sum("amount").alias("total"), F.count("*").alias("n"))
    return sums.join(v.branch, "branch_id").select("branch", "total", "n").orderBy(F.desc("total"), "branch").limit(10)


@query("G08_cashier_scores", """
    SELECT cashier_id, CAST(count(*) AS bigint) AS n, CAST(sum(p) AS bigint) AS points, CAST(sum(p) // count(*) AS bigint) AS score FROM (
      SELECT cashier_id, CASE WHEN tax_id IS NOT NULL AND state IS NOT NULL THEN 100 WHEN tax_id IS NOT NULL THEN 75 WHEN state IS NOT NULL THEN 40 ELSE 0 END AS p FROM treasury)
    GROUP BY cashier_id ORDER BY points DESC, cashier_id LIMIT 10""")
def cashier_scores(v):
    points = F.when(F.col("tax_id").isNotNull() & F.col("state").isNotNull(), 100).when(F.col("tax_id").isNotNull(), 75).when(F.col("state").isNotNull(), 40).otherwise(0)
    sums = v.treasury.groupBy("cashier_id").agg(F.count("*").alias("n"), F.sum(points).alias("points"))
    return sums.withColumn("score", F.expr("points div n")).orderBy(F.desc("points"), "cashier_id").limit(10)


CASCADE_SQL = f"""
    SELECT bank.bank_id, account_id, direction, amount, post_date, CASE WHEN l.bank_id IS NOT NULL THEN 'linked' WHEN {CARD_SQL} THEN 'card' WHEN part_id % 13 = 0 THEN 'transfer'
      WHEN account_id = 9 THEN 'partial_use' WHEN direction = 'OUT' AND part_id % 7 = 0 THEN 'expense' WHEN {FEE_SQL} THEN 'fee' WHEN abs(amount) > 0 AND abs(amount) <= {SMALL} THEN 'small'
      WHEN part_id % 17 = 0 THEN 'manual_journal' ELSE 'gap' END AS channel
    FROM bank LEFT JOIN ({LINKED_SQL}) AS l ON l.bank_id = bank.bank_id"""


def cascade(v):
    """What resolves a bank movement: the first that holds, in this order."""
    c = F.col
    flagged = v.bank.join(linked(v).withColumn("hit", F.lit(True)), "bank_id", "left")
    steps = [
        ("linked", c("hit")), ("card", is_card_deposit(c("direction"), c("memo"))), ("transfer", c("part_id") % 13 == 0), ("partial_use", c("account_id") == 9),
        ("expense", (c("direction") == "OUT") & (c("part_id") % 7 == 0)), ("fee", is_bank_fee(c("direction"), c("memo"), c("counterparty"), c("counterparty_tax_id"))),
        ("small", is_small(c("amount"), SMALL)), ("manual_journal", c("part_id") % 17 == 0),
    ]
    channel = F.when(steps[0][1], steps[0][0])
    for name, holds in steps[1:]:
        channel = channel.when(holds, name)
    return flagged.withColumn("channel", channel.otherwise("gap")).select("bank_id", "account_id", "direction", "amount", "post_date", "channel")


query("E12_cascade", CASCADE_SQL, dates=("post_date",))(cascade)


@query("G09_statement_footer", f"SELECT account_id, channel, CAST(count(*) AS bigint) AS n, CAST(sum(abs(amount)) AS bigint) AS total FROM ({CASCADE_SQL}) GROUP BY account_id, channel")
def statement_footer(v):
    return cascade(v).groupBy("account_id", "channel").agg(F.count("*").alias("n"), F.sum(F.abs("amount")).alias("total"))


@query("G10_gap_report", f"""
    SELECT account_id, direction, {AGING_SQL} AS age, CAST(count(*) AS bigint) AS n, CAST(sum(amount) AS bigint) AS total FROM (
      SELECT *, greatest(date_diff('day', post_date, DATE '{TODAY}'), 0) AS d FROM ({CASCADE_SQL}) WHERE channel = 'gap') GROUP BY 1, 2, 3""")
def gap_report(v):
    age = aging_bucket(F.col("post_date"), F.lit(TODAY).cast("date"))
    return cascade(v).where("channel = 'gap'").groupBy("account_id", "direction", age.alias("age")).agg(F.count("*").alias("n"), F.sum("amount").alias("total"))


REASON_SQL = "CASE WHEN m.status IS NULL THEN 'unprocessed' WHEN m.status = 'SUGGESTED' THEN 'suggested' WHEN m.status = 'REVIEW' AND t.is_exception THEN 'exception' WHEN m.status = 'REVIEW' THEN 'review' WHEN m.status = 'NO_MATCH' THEN 'no_match' WHEN m.status = 'OUT_OF_SCOPE' THEN 'out_of_scope' ELSE 'unprocessed' END"


@query("E13_gap_reasons", f"SELECT {REASON_SQL} AS reason, CAST(count(*) AS bigint) AS n, CAST(sum(t.amount) AS bigint) AS total FROM treasury t LEFT JOIN matches m ON m.treasury_id = t.treasury_id WHERE m.status IS NULL OR m.status NOT IN ('AUTO', 'MANUAL') GROUP BY 1")
def gap_reasons(v):
    s = F.col("status")
    reason = F.when(s.isNull(), "unprocessed").when(s == "SUGGESTED", "suggested").when((s == "REVIEW") & F.col("is_exception"), "exception").when(s == "REVIEW", "review").when(s == "NO_MATCH", "no_match").when(s == "OUT_OF_SCOPE", "out_of_scope").otherwise("unprocessed")
    rows = v.treasury.join(v.matches, "treasury_id", "left").where("status IS NULL OR status NOT IN ('AUTO', 'MANUAL')")
    return rows.groupBy(reason.alias("reason")).agg(F.count("*").alias("n"), F.sum("amount").alias("total"))


@query("G12_cross_report", f"""
    WITH b AS (SELECT account_id, count(*) AS n, sum(amount) AS total FROM ({CASCADE_SQL}) WHERE channel = 'gap' GROUP BY account_id),
    t AS (SELECT t.account_id, count(*) AS n, sum(t.amount) AS total FROM treasury t LEFT JOIN matches m ON m.treasury_id = t.treasury_id WHERE m.status IS NULL OR m.status NOT IN ('AUTO', 'MANUAL') GROUP BY t.account_id)
    SELECT a.account_id, CAST(coalesce(b.n, 0) AS bigint) AS bank_n, CAST(coalesce(b.total, 0) AS bigint) AS bank_total, CAST(coalesce(t.n, 0) AS bigint) AS treasury_n, CAST(coalesce(t.total, 0) AS bigint) AS treasury_total
    FROM account a LEFT JOIN b ON b.account_id = a.account_id LEFT JOIN t ON t.account_id = a.account_id""")
def cross_report(v):
    b = cascade(v).where("channel = 'gap'").groupBy("account_id").agg(F.count("*").alias("bank_n"), F.sum("amount").alias("bank_total"))
    t = v.treasury.join(v.matches.where("status IN ('AUTO', 'MANUAL')"), "treasury_id", "left_anti").groupBy("account_id").agg(F.count("*").alias("treasury_n"), F.sum("amount").alias("treasury_total"))
    joined = v.account.select("account_id").join(b, "account_id", "left").join(t, "account_id", "left")
    return joined.select("account_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("bank_n", "bank_total", "treasury_n", "treasury_total")])


@query("G13_aging", f"SELECT direction, {AGING_SQL} AS age, CAST(count(*) AS bigint) AS n, CAST(sum(amount) AS bigint) AS net FROM (SELECT *, greatest(date_diff('day', doc_date, DATE '{TODAY}'), 0) AS d FROM treasury) GROUP BY 1, 2")
def aging(v):
    return v.treasury.groupBy("direction", aging_bucket(F.col("doc_date"), F.lit(TODAY).cast("date")).alias("age")).agg(F.count("*").alias("n"), F.sum("amount").alias("net"))


@query("G14_balance_audit", f"""
    WITH s AS (SELECT account_id, arg_max(balance_after, post_date || bank_id) AS system_balance FROM bank WHERE balance_after IS NOT NULL AND post_date < DATE '2000-01-01' GROUP BY account_id),
    p AS (SELECT account_id, sum(amount) AS net FROM ({CASCADE_SQL}) WHERE channel = 'gap' AND post_date < DATE '2000-01-01' GROUP BY account_id)
    SELECT a.account_id, a.manual_balance, s.system_balance, CAST(coalesce(p.net, 0) AS bigint) AS net, abs(a.manual_balance - s.system_balance - coalesce(p.net, 0)) <= 10 AS agrees
    FROM account a LEFT JOIN s ON s.account_id = a.account_id LEFT JOIN p ON p.account_id = a.account_id""")
def balance_audit(v):
    s = latest_value(v.bank.where("post_date < DATE '2000-01-01'"), ["account_id"], "balance_after", ["post_date", "bank_id"]).withColumnRenamed("balance_after", "system_balance")
    p = cascade(v).where("channel = 'gap' AND post_date < DATE '2000-01-01'").groupBy("account_id").agg(F.sum("amount").alias("net"))
    joined = v.account.select("account_id", "manual_balance").join(s, "account_id", "left").join(p, "account_id", "left").withColumn("net", F.coalesce("net", F.lit(0)))
    return joined.withColumn("agrees", F.abs(F.col("manual_balance") - F.col("system_balance") - F.col("net")) <= 10)


@query("G15_pivot_margins", """
    SELECT branch_id, account_id, CAST(count(*) AS bigint) AS n, CAST(sum(amount) AS bigint) AS total, CAST(sum(CASE WHEN is_exception THEN 1 ELSE 0 END) AS bigint) AS flagged,
      CAST(grouping(branch_id) * 2 + grouping(account_id) AS integer) AS level FROM treasury GROUP BY CUBE (branch_id, account_id)""")
def pivot_margins(v):
    return pivot_with_margins(v.treasury, "branch_id", "account_id", "amount", "is_exception")


@query("C19_exception_matrix", """
    WITH r AS (SELECT branch_id FROM treasury GROUP BY branch_id HAVING sum(CASE WHEN is_exception THEN 1 ELSE 0 END) > 40), c AS (SELECT account_id FROM treasury GROUP BY account_id HAVING sum(CASE WHEN is_exception THEN 1 ELSE 0 END) > 60)
    SELECT branch_id, account_id, CAST(sum(amount) AS bigint) AS total FROM treasury WHERE branch_id IN (SELECT branch_id FROM r) AND account_id IN (SELECT account_id FROM c) GROUP BY 1, 2""")
def exception_matrix(v):
    t, flags = v.treasury, F.sum(F.col("is_exception").cast("int"))
    rows = t.groupBy("branch_id").agg(flags.alias("e")).where("e > 40").select("branch_id")
    columns = t.groupBy("account_id").agg(flags.alias("e")).where("e > 60").select("account_id")
    return t.join(rows, "branch_id", "left_semi").join(columns, "account_id", "left_semi").groupBy("branch_id", "account_id").agg(F.sum("amount").alias("total"))


@query("G16_mode", """
    SELECT branch_id, account_id, n FROM (SELECT branch_id, account_id, CAST(count(*) AS bigint) AS n, row_number() OVER (PARTITION BY branch_id ORDER BY count(*) DESC, account_id) AS r FROM treasury GROUP BY 1, 2) WHERE r = 1""")
def mode(v):
    return mode_by(v.treasury, ["branch_id"], "account_id")


@query("G17_facets", "SELECT 'kind' AS facet, coalesce(kind, '-') AS value, CAST(count(*) AS bigint) AS n FROM treasury GROUP BY 2 UNION ALL SELECT 'state', coalesce(state, '-'), CAST(count(*) AS bigint) FROM treasury GROUP BY 2 UNION ALL SELECT 'direction', direction, CAST(count(*) AS bigint) FROM treasury GROUP BY 2")
def facets(v):
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("facet"), F.coalesce(c, F.lit("-")).alias("value")) for c in ("kind", "state", "direction")]))
    return v.treasury.select(pairs.alias("x")).groupBy("x.facet", "x.value").agg(F.count("*").alias("n"))


@query("G19_distinct", "SELECT DISTINCT account_id, branch_id FROM treasury WHERE state = 'CAJ'")
def distinct(v):
    return v.treasury.where("state = 'CAJ'").select("account_id", "branch_id").distinct()


@query("G20_sync_status", "SELECT 'bank' AS feed, min(post_date) AS first_day, max(post_date) AS last_day, CAST(count(*) AS bigint) AS n FROM bank UNION ALL SELECT 'treasury', min(doc_date), max(doc_date), CAST(count(*) AS bigint) FROM treasury UNION ALL SELECT 'pos', min(sale_date), max(sale_date), CAST(count(*) AS bigint) FROM pos", dates=("first_day", "last_day"))
def sync_status(v):
    feeds = [("bank", v.bank, "post_date"), ("treasury", v.treasury, "doc_date"), ("pos", v.pos, "sale_date")]
    parts = [df.agg(F.min(d).alias("first_day"), F.max(d).alias("last_day"), F.count("*").alias("n")).select(F.lit(name).alias("feed"), "first_day", "last_day", "n") for name, df, d in feeds]
    return parts[0].union(parts[1]).union(parts[2])


@query("G21_account_counts", "SELECT a.account_id, CAST(count(b.bank_id) AS bigint) AS n FROM account a LEFT JOIN bank b ON b.account_id = a.account_id AND b.post_date >= DATE '2001-01-01' GROUP BY a.account_id")
def account_counts(v):
    counts = v.bank.where("post_date >= DATE '2001-01-01'").groupBy("account_id").agg(F.count("*").alias("n"))
    return v.account.select("account_id").join(counts, "account_id", "left").select("account_id", F.coalesce("n", F.lit(0)).alias("n"))


@query("G24_card_kpis", "SELECT branch_id, CAST(count(*) AS bigint) AS n, CAST(sum(gross) AS bigint) AS gross, CAST(sum(fee) AS bigint) AS fee, CAST(sum(gross - fee) AS bigint) AS net, CAST(sum(CASE WHEN fee = 0 THEN 1 ELSE 0 END) AS bigint) AS without_fee FROM settlement GROUP BY branch_id")
def card_kpis(v):
    return v.settlement.groupBy("branch_id").agg(F.count("*").alias("n"), F.sum("gross").alias("gross"), F.sum("fee").alias("fee"), F.sum(F.col("gross") - F.col("fee")).alias("net"), F.sum(F.when(F.col("fee") == 0, 1).otherwise(0)).alias("without_fee"))


@query("G26_no_client", "SELECT treasury_id, amount FROM treasury WHERE tax_id IS NULL AND state IS NULL")
def no_client(v):
    return v.treasury.where("tax_id IS NULL AND state IS NULL").select("treasury_id", "amount")


@query("G27_alerts", f"""
    SELECT 'backlog' AS alert, CAST(account_id AS string) AS subject, CAST(count(*) AS bigint) AS n, CASE WHEN count(*) > 200 THEN 'high' ELSE 'medium' END AS severity FROM treasury t WHERE date_diff('day', doc_date, DATE '{TODAY}') > 7 AND state IS NULL GROUP BY account_id
    UNION ALL SELECT 'stale_account', CAST(account_id AS string), CAST(date_diff('day', max(post_date), DATE '2002-01-01') AS bigint), 'high' FROM bank GROUP BY account_id HAVING date_diff('day', max(post_date), DATE '2002-01-01') > 5""")
def alerts(v):
    late = v.treasury.where(f"datediff(DATE '{TODAY}', doc_date) > 7 AND state IS NULL").groupBy("account_id").agg(F.count("*").alias("n"))
    late = late.select(F.lit("backlog").alias("alert"), F.col("account_id").cast("string").alias("subject"), "n", F.when(F.col("n") > 200, "high").otherwise("medium").alias("severity"))
    stale = v.bank.groupBy("account_id").agg(F.datediff(F.lit("2002-01-01").cast("date"), F.max("post_date")).cast("long").alias("n")).where("n > 5")
    return late.union(stale.select(F.lit("stale_account"), F.col("account_id").cast("string"), "n", F.lit("high")))


@query("G28_coverage_audit", f"SELECT CAST(count(*) AS bigint) AS n, CAST(count(DISTINCT bank_id) AS bigint) AS movements, CAST(sum(CASE WHEN channel = 'gap' THEN 1 ELSE 0 END) AS bigint) AS gaps FROM ({CASCADE_SQL})")
def coverage_audit(v):
    return cascade(v).agg(F.count("*").alias("n"), F.countDistinct("bank_id").alias("movements"), F.sum(F.when(F.col("channel") == "gap", 1).otherwise(0)).alias("gaps"))


@query("H01_latest_balance", "SELECT account_id, bank_id, balance_after FROM (SELECT *, row_number() OVER (PARTITION BY account_id ORDER BY post_date DESC, bank_id DESC) AS r FROM bank WHERE balance_after IS NOT NULL) WHERE r = 1")
def latest_balance(v):
    return latest_by(v.bank.where("balance_after IS NOT NULL"), ["account_id"], [F.desc("post_date"), F.desc("bank_id")]).select("account_id", "bank_id", "balance_after")


@query("H03_daily_series", """
    WITH days AS (SELECT CAST(d AS date) AS day FROM (SELECT unnest(generate_series(DATE '2000-01-01', DATE '2000-12-31', INTERVAL 1 DAY)) AS d))
    SELECT x.account_id, x.day, CAST(coalesce(c.n, 0) AS bigint) AS n FROM (SELECT a.account_id, days.day FROM account a, days) AS x
    LEFT JOIN (SELECT account_id, post_date AS day, count(*) AS n FROM bank GROUP BY 1, 2) AS c ON c.account_id = x.account_id AND c.day = x.day""", dates=("day",))
def daily_series(v):
    spine = v.account.select("account_id", F.explode(F.expr("sequence(DATE '2000-01-01', DATE '2000-12-31')")).alias("day"))
    counts = v.bank.groupBy("account_id", F.col("post_date").alias("day")).agg(F.count("*").alias("n"))
    return spine.join(counts, ["account_id", "day"], "left").select("account_id", "day", F.coalesce("n", F.lit(0)).alias("n"))


@query("H05_dominance", """
    SELECT client, account_id, n FROM (SELECT client, account_id, CAST(count(*) AS bigint) AS n, row_number() OVER (PARTITION BY client ORDER BY count(*) DESC, account_id) AS r,
      coalesce(lead(count(*)) OVER (PARTITION BY client ORDER BY count(*) DESC, account_id), 0) AS second FROM treasury GROUP BY 1, 2) WHERE r = 1 AND n >= 3 AND n >= 0.5 * (n + second)""")
def dominance(v):
    return dominant(v.treasury.groupBy("client", "account_id").agg(F.count("*").alias("n")), ["client"], "account_id", "n", 3, 0.5)


@query("H08_previous_period", """
    SELECT m, total, CAST(lag(total) OVER (ORDER BY m) AS bigint) AS previous FROM (SELECT CAST(year(post_date) * 12 + month(post_date) AS bigint) AS m, CAST(sum(amount) AS bigint) AS total FROM bank GROUP BY 1)""")
def previous_period(v):
    months = v.bank.groupBy((F.year("post_date") * 12 + F.month("post_date")).cast("long").alias("m")).agg(F.sum("amount").alias("total"))
    return months.withColumn("previous", F.lag("total").over(Window.orderBy("m")))


@query("H11_line_numbers", "SELECT account_id, bank_id, CAST(row_number() OVER (PARTITION BY account_id ORDER BY post_date, bank_id) AS integer) AS line_no, CAST(date_diff('day', DATE '1970-01-01', post_date) + 25569 AS integer) AS serial FROM bank")
def line_numbers(v):
    return v.bank.select("account_id", "bank_id", F.row_number().over(Window.partitionBy("account_id").orderBy("post_date", "bank_id")).alias("line_no"), sheet_serial(F.col("post_date")).alias("serial"))


@query("I04_top_amounts", "SELECT bank_id, amount FROM bank ORDER BY abs(amount) DESC, bank_id LIMIT 10")
def top_amounts(v):
    return v.bank.select("bank_id", "amount").orderBy(F.abs("amount").desc(), "bank_id").limit(10)


@query("J01_union_of_kinds", "SELECT 'pos' AS kind, pos_id AS id, amount FROM pos UNION ALL SELECT 'settlement', settlement_id, gross FROM settlement")
def union_of_kinds(v):
    return v.pos.select(F.lit("pos").alias("kind"), F.col("pos_id").alias("id"), "amount").unionByName(v.settlement.select(F.lit("settlement").alias("kind"), F.col("settlement_id").alias("id"), F.col("gross").alias("amount")))


@query("J02_difference", "SELECT receipt, branch_id, sale_date FROM pos EXCEPT SELECT receipt, branch_id, sale_date FROM settlement WHERE gross > 1000", dates=("sale_date",))
def difference(v):
    key = ["receipt", "branch_id", "sale_date"]
    return v.pos.select(key).subtract(v.settlement.where("gross > 1000").select(key))


@query("J05_missing_aliases", "SELECT DISTINCT client FROM treasury WHERE client NOT IN (SELECT 'Customer ' || CAST(account_id * 5 AS string) FROM account)")
def missing_aliases(v):
    known = v.account.select(F.concat(F.lit("Customer "), (F.col("account_id") * 5).cast("string")).alias("client"))
    return v.treasury.select("client").subtract(known)


@query("X12_monthly_histogram", "SELECT CAST(year(post_date) AS integer) AS y, CAST(month(post_date) AS integer) AS m, CAST(count(*) AS bigint) AS n, min(bank_id) AS least FROM bank WHERE direction = 'OUT' GROUP BY 1, 2")
def monthly_histogram(v):
    return v.bank.where("direction = 'OUT'").groupBy(F.year("post_date").alias("y"), F.month("post_date").alias("m")).agg(F.count("*").alias("n"), F.min("bank_id").alias("least"))
