"""Routing rules, labels, paging, set operations and the remaining journals over the movement views."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from reconlake.functions.dates import aging_bucket, with_time
from reconlake.functions.names import is_card_deposit, is_small, names_agree
from reconlake.operators.candidates import near_counts, pair_splits, window_join
from reconlake.operators.dedup import reassigned
from reconlake.operators.journal import explode_lines, line
from reconlake.operators.reports import latest_value
from reconlake.operators.routing import capped_status, first_rule, gap_tag, match_type, memo_route, resolved_account
from reconlake.operators.assign import shared_folder
from reconlake.plans.catalog import query
from reconlake.streaming import imports
from reconlake.plans.queries_match import PAIRS_SQL, pairs, sides
from reconlake.plans.queries_report import TODAY
from reconlake.sources.sinks import insert_new, upserted

ROUTES = [("GIRO", 3, None), ("PAGO 1", 4, "Customer 1"), ("PAGO", 5, None)]
CARD_SQL = "direction = 'IN' AND lower(memo) LIKE '%abn crd%' AND lower(memo) LIKE '%transba%'"


@query("B01_upsert", """
    SELECT coalesce(i.treasury_id, m.treasury_id) AS treasury_id, coalesce(i.status, m.status) AS status FROM matches m
    FULL JOIN (SELECT treasury_id, 'MANUAL' AS status FROM treasury WHERE branch_id = 1) AS i ON i.treasury_id = m.treasury_id""")
def upsert(v):
    incoming = v.treasury.where("branch_id = 1").select("treasury_id", F.lit("MANUAL").alias("status"))
    return upserted(v.matches, incoming, ["treasury_id"], ["status"])


@query("B02_insert_ignore", """
    SELECT treasury_id, status FROM matches UNION ALL SELECT treasury_id, 'NEW' FROM treasury t WHERE branch_id = 1 AND NOT EXISTS (SELECT 1 FROM matches m WHERE m.treasury_id = t.treasury_id)""")
def insert_ignore(v):
    return insert_new(v.matches, v.treasury.where("branch_id = 1").select("treasury_id", F.lit("NEW").alias("status")), ["treasury_id"])


@query("C09_partial_use", "SELECT bank_id FROM bank WHERE account_id IN (SELECT account_id FROM account WHERE account_id % 4 = 1)")
def partial_use(v):
    return v.bank.join(v.account.where("account_id % 4 = 1").select("account_id"), "account_id", "left_semi").select("bank_id")


@query("C11_memo_route", """
    SELECT bank_id, CASE WHEN lower(memo) LIKE '%giro%' THEN 3 WHEN lower(memo) LIKE '%pago 1%' AND lower(counterparty) LIKE '%customer 1%' THEN 4 WHEN lower(memo) LIKE '%pago%' THEN 5 END AS routed FROM bank""")
def routed(v):
    return v.bank.select("bank_id", memo_route(F.col("memo"), F.col("counterparty"), ROUTES).alias("routed"))


@query("C14_placeholder_names", "SELECT bank_id FROM bank WHERE counterparty NOT LIKE '_ustomer 1%'")
def placeholders(v):
    return v.bank.where(~F.col("counterparty").like("_ustomer 1%")).select("bank_id")


@query("C15_any_item", "SELECT bank_id FROM bank WHERE len(list_filter(string_split(memo, ' '), lambda x: lower(x) LIKE 'comision%')) > 0")
def any_item(v):
    return v.bank.where(F.exists(F.split("memo", " "), lambda x: F.lower(x).startswith("comision"))).select("bank_id")


@query("D13_inverse_splits", """
    SELECT b.bank_id, x.treasury_id AS part_1, y.treasury_id AS part_2 FROM bank b
    JOIN treasury x ON x.account_id = b.account_id AND x.direction = b.direction AND x.client = b.counterparty AND abs(date_diff('day', b.post_date, x.doc_date)) <= 7 AND x.amount_key < b.amount_key
    JOIN treasury y ON y.account_id = b.account_id AND y.direction = b.direction AND y.client = b.counterparty AND y.amount_key = b.amount_key - x.amount_key AND abs(date_diff('day', b.post_date, y.doc_date)) <= 7 AND x.treasury_id < y.treasury_id""")
def inverse_splits(v):
    b = v.bank.withColumnRenamed("counterparty", "client")
    return pair_splits(b, v.treasury, ["account_id", "direction", "client"], "bank_id", "amount_key", "post_date", "treasury_id", "amount_key", "doc_date", 7).select("bank_id", "part_1", "part_2")


@query("D22_candidate_listing", f"""
    SELECT treasury_id, bank_id, delta FROM (SELECT p.*, row_number() OVER (PARTITION BY p.treasury_id, delta, b.memo ORDER BY p.bank_id) AS n FROM ({PAIRS_SQL}) AS p JOIN (SELECT DISTINCT bank_id, memo FROM bank) AS b ON b.bank_id = p.bank_id) WHERE n = 1""")
def candidate_listing(v):
    """Of bank rows that look alike to a treasury row, the least: told before they meet, so only what is listed is made."""
    treasury, bank, keys, *window = sides(v)
    least = bank.groupBy(*keys, "post_date", "memo").agg(F.min("bank_id").alias("bank_id"))
    counted = treasury.withColumn("n", F.count("*").over(Window.partitionBy("treasury_id")))
    once, again = (window_join(counted.where(which), least, keys, *window).select("treasury_id", "bank_id", F.col("delta").cast("long").alias("delta"), "memo") for which in ("n = 1", "n > 1"))
    # rows that repeat an id have their listing in common
    again = again.groupBy("treasury_id", "delta", "memo").agg(F.min("bank_id").alias("bank_id"))
    return once.unionByName(again).drop("memo")


@query("D26_branch_of_shop", """
    WITH shop AS (SELECT settlement_id, unnest(list_distinct(string_split('LOCAL NATION_' || CAST(branch_id AS string) || ' CENTRO', ' '))) AS word FROM settlement)
    SELECT settlement_id, branch_id, hits FROM (SELECT s.settlement_id, b.branch_id, CAST(count(*) AS bigint) AS hits, row_number() OVER (PARTITION BY s.settlement_id ORDER BY count(*) DESC, b.branch_id) AS n
      FROM shop s JOIN branch b ON b.branch = s.word GROUP BY 1, 2) WHERE n = 1""")
def branch_of_shop(v):
    words = v.settlement.select("settlement_id", F.explode(F.array_distinct(F.split(F.concat(F.lit("LOCAL NATION_"), F.col("branch_id").cast("string"), F.lit(" CENTRO")), " "))).alias("word"))
    known = v.branch.select("branch_id", F.explode(F.array_distinct(F.split("branch", " "))).alias("word"))
    hits = words.join(known, "word").groupBy("settlement_id", "branch_id").agg(F.count("*").alias("hits"))
    best = Window.partitionBy("settlement_id").orderBy(F.desc("hits"), "branch_id")
    return hits.withColumn("n", F.row_number().over(best)).where("n = 1").select("settlement_id", "branch_id", "hits")


@query("E05_match_types", f"""
    SELECT treasury_id, bank_id, CASE WHEN n > 1 THEN CASE WHEN delta = 0 THEN 'SPLIT_SAME_DAY' ELSE 'SPLIT_PM3' END WHEN delta = 0 THEN 'EXACT_SAME_DAY' WHEN abs(delta) <= 3 THEN 'EXACT_PM3' ELSE 'EXACT_PM7' END AS match_type
    FROM (SELECT *, count(*) OVER (PARTITION BY treasury_id) AS n FROM ({PAIRS_SQL}))""")
def match_types(v):
    treasury, *others = sides(v)
    met = window_join(near_counts(treasury, *others, "treasury_id"), *others)
    return met.select("treasury_id", "bank_id", match_type(F.col("delta"), F.col("n")).alias("match_type"))


@query("E08_capped_status", "SELECT m.treasury_id, CASE WHEN m.status = 'AUTO' AND (t.is_exception OR t.branch_id = 2) THEN 'SUGGESTED' ELSE m.status END AS status FROM matches m JOIN treasury t ON t.treasury_id = m.treasury_id")
def capped(v):
    met = v.matches.join(v.treasury.select("treasury_id", "is_exception", "branch_id"), "treasury_id")
    return met.select("treasury_id", capped_status(F.col("status"), F.col("is_exception"), F.col("branch_id") == 2).alias("status"))


@query("E14_gap_tags", """
    SELECT bank_id, CASE WHEN counterparty IN ('Customer 1', 'Customer 2') THEN 'internal' WHEN regexp_matches(memo, '(?i)\\b(transbank|redbank|t\\.?b\\.?k)\\b') THEN 'card'
      WHEN regexp_matches(memo, '(?i)(comisi[oó]n|mantenci[oó]n|impuesto|iva\\b|cargo\\b|gasto\\s+banc|cobro\\b)') THEN 'fee' ELSE 'unclassified' END AS tag FROM bank""")
def gap_tags(v):
    return v.bank.select("bank_id", gap_tag(F.col("counterparty").isin("Customer 1", "Customer 2"), F.col("memo")).alias("tag"))


@query("E21_resolved_account", """
    SELECT bank_id, CAST(CASE WHEN part_id % 13 = 0 THEN 77 WHEN line_no % 3 = 0 THEN account_id WHEN part_id % 5 = 0 THEN account_id + 100 ELSE -1 END AS bigint) AS account FROM bank""")
def resolved(v):
    c = F.col
    chain = resolved_account(F.when(c("part_id") % 13 == 0, 77), F.when(c("line_no") % 3 == 0, c("account_id")), F.when(c("part_id") % 5 == 0, c("account_id") + 100), F.lit(None), F.lit(-1))
    return v.bank.select("bank_id", chain.cast("long").alias("account"))


@query("F03_import_with_discards", """
    WITH i AS (SELECT bank_id, account_id, CASE WHEN part_id % 101 = 0 THEN NULL ELSE bank_id END AS dedup_key, amount,
        lower(coalesce(counterparty, '') || ' ' || coalesce(memo, '')) AS said FROM bank WHERE post_date >= DATE '1998-01-01'),
      p AS (SELECT DISTINCT account_id, bank_id FROM bank WHERE post_date < DATE '1999-01-01'), g AS (SELECT DISTINCT account_id, bank_id FROM bank WHERE amount % 97 = 0),
      m AS (SELECT i.*, CASE WHEN i.dedup_key IS NULL THEN 'ERROR' WHEN p.bank_id IS NOT NULL THEN 'DUPLICATE' ELSE 'NEW' END AS status, g.bank_id IS NOT NULL AS gone,
        CASE WHEN i.account_id = 3 AND said LIKE '%customer 7%' THEN 'Customer 7' WHEN said LIKE '%mantencion%' THEN 'MANTENCION' END AS found
        FROM i LEFT JOIN p ON p.account_id = i.account_id AND p.bank_id = i.dedup_key LEFT JOIN g ON g.account_id = i.account_id AND g.bank_id = i.dedup_key)
    SELECT bank_id, status, CASE WHEN status = 'NEW' THEN found END AS pattern, status = 'NEW' AND (gone OR found IS NOT NULL) AS discarded FROM m""")
def preview_with_discards(v):
    keyed = v.bank.withColumn("dedup_key", F.when(F.col("part_id") % 101 != 0, F.col("bank_id")))
    register = v.bank.where("amount % 97 = 0").select("account_id", F.col("bank_id").alias("dedup_key"))
    present = v.bank.where("post_date < DATE '1999-01-01'").select("account_id", F.col("bank_id").alias("dedup_key"))
    told = imports.import_preview(keyed.where("post_date >= DATE '1998-01-01'"), present, register, [(3, "Customer 7"), (None, "MANTENCION")])
    return told.select("bank_id", "status", "pattern", "discarded")


#: The most rows of one of the files that `M03_import_by_content` takes in.
FILE_ROWS = 20_000


@query("M03_import_by_content", "SELECT DISTINCT bank_id, account_id, amount, post_date, counterparty, CAST(CASE WHEN post_date < DATE '1997-01-01' THEN 0 ELSE 2 END AS integer) AS first_import, amount % 97 = 0 AS discarded FROM bank", dates=("post_date",))
def by_content(v):
    """Files of part of the rows without counterparties, the same files under other names, and whole ones.

    A file is one value while it is read, so more rows make more files and no larger ones.
    """
    spark, folder = v.spark, shared_folder(v.spark, "imports")
    columns = ["bank_id", "account_id", "amount", "post_date", "counterparty"]
    rows = v.bank.select(*columns).distinct()
    early = rows.where("post_date < DATE '1997-01-01'").withColumn("counterparty", F.lit(None).cast("string"))
    kinds = rows.schema.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " ")

    def parsed(files):
        lines = files.select("file_hash", F.explode(F.split(F.decode("content", "utf-8"), "\n")).alias("line")).where("line <> ''")
        return lines.select("file_hash", F.from_csv("line", kinds).alias("row")).select("file_hash", "row.*")

    for name, some in (("first", early), ("renamed", early), ("whole", rows)):
        some.repartition(8, "account_id").sortWithinPartitions(*columns).write.option("maxRecordsPerFile", FILE_ROWS).csv(f"{folder}/in/{name}")
        imports.import_files(spark, f"{folder}/in", f"{folder}/log", f"{folder}/progress", parsed, "*.csv").awaitTermination()
    register = v.bank.where("amount % 97 = 0").select("bank_id")
    return imports.imported(spark, f"{folder}/log", "bank_id", register).select(*columns, "first_import", "discarded")


@query("F03_import_preview", """
    WITH i AS (SELECT account_id, amount_key, memo FROM bank WHERE post_date >= DATE '2001-01-01'), p AS (SELECT DISTINCT account_id, amount_key FROM bank WHERE post_date < DATE '2001-01-01')
    SELECT i.account_id, CASE WHEN i.memo LIKE '%mantencion%' THEN 'discarded' WHEN p.account_id IS NOT NULL THEN 'present' ELSE 'new' END AS outcome, CAST(count(*) AS bigint) AS n
    FROM i LEFT JOIN p ON p.account_id = i.account_id AND p.amount_key = i.amount_key GROUP BY 1, 2""")
def import_preview(v):
    present = v.bank.where("post_date < DATE '2001-01-01'").select("account_id", "amount_key").distinct().withColumn("there", F.lit(True))
    incoming = v.bank.where("post_date >= DATE '2001-01-01'").select("account_id", "amount_key", "memo")
    outcome = first_rule([(F.col("memo").contains("mantencion"), "discarded"), (F.col("there"), "present"), (F.lit(True), "new")])
    return incoming.join(present, ["account_id", "amount_key"], "left").groupBy("account_id", outcome.alias("outcome")).agg(F.count("*").alias("n"))


@query("F05_name_compatibility", f"""
    SELECT p.treasury_id, p.bank_id, CASE WHEN t.tax_id IS NOT NULL AND b.counterparty_tax_id IS NOT NULL THEN t.tax_id = b.counterparty_tax_id ELSE TRUE END AS agree
    FROM ({PAIRS_SQL}) AS p JOIN treasury t ON t.treasury_id = p.treasury_id JOIN (SELECT DISTINCT bank_id, counterparty_tax_id FROM bank) AS b ON b.bank_id = p.bank_id""")
def compatible(v):
    return pairs(v).select("treasury_id", "bank_id", names_agree(F.col("client"), F.col("tax_id"), F.col("counterparty"), F.col("counterparty_tax_id")).alias("agree"))


@query("F09_reassigned", "SELECT b.bank_id, CAST(8 AS bigint) AS account_id FROM bank b WHERE account_id = 9 AND NOT EXISTS (SELECT 1 FROM bank o WHERE o.account_id = 8 AND o.post_date = b.post_date AND o.direction = b.direction)")
def moved(v):
    return reassigned(v.bank, "account_id", 9, 8, ["post_date", "direction"]).select("bank_id", F.col("account_id").cast("long").alias("account_id"))


@query("G11_treasury_gap", f"""
    SELECT direction, coalesce(kind, '-') AS kind, CASE WHEN d <= 7 THEN '0-7' WHEN d <= 30 THEN '8-30' WHEN d <= 60 THEN '31-60' ELSE '60+' END AS age, CAST(count(*) AS bigint) AS n, CAST(sum(abs(amount)) AS bigint) AS total
    FROM (SELECT *, greatest(date_diff('day', doc_date, DATE '{TODAY}'), 0) AS d FROM treasury t WHERE NOT EXISTS (SELECT 1 FROM matches m WHERE m.treasury_id = t.treasury_id AND m.status IN ('AUTO', 'MANUAL'))) GROUP BY 1, 2, 3""")
def treasury_gap(v):
    still_open = v.treasury.join(v.matches.where("status IN ('AUTO', 'MANUAL')"), "treasury_id", "left_anti")
    age = aging_bucket(F.col("doc_date"), F.lit(TODAY).cast("date"))
    return still_open.groupBy("direction", F.coalesce("kind", F.lit("-")).alias("kind"), age.alias("age")).agg(F.count("*").alias("n"), F.sum(F.abs("amount")).alias("total"))


@query("G18_filter_totals", "SELECT CAST(count(*) AS bigint) AS n, CAST(sum(amount) AS bigint) AS total FROM treasury WHERE state = 'CAJ'")
def filter_totals(v):
    return v.treasury.where("state = 'CAJ'").agg(F.count("*").alias("n"), F.sum("amount").alias("total"))


@query("G22_state_summary", "SELECT state, CAST(count(*) AS bigint) AS n, CAST(sum(amount) AS bigint) AS total FROM treasury GROUP BY state")
def state_summary(v):
    return v.treasury.groupBy("state").agg(F.count("*").alias("n"), F.sum("amount").alias("total"))


@query("G23_real_sales", "SELECT branch_id, CAST(sum(amount) AS bigint) AS total FROM pos WHERE pos_id % 6 <> 0 GROUP BY branch_id")
def real_sales(v):
    return v.pos.where("pos_id % 6 <> 0").groupBy("branch_id").agg(F.sum("amount").alias("total"))


@query("G25_settlement_sums", """
    SELECT branch_id, CAST(count(*) AS bigint) AS n, CAST(sum(gross) AS bigint) AS gross, CAST(sum(CASE WHEN receipt IN (SELECT receipt FROM pos) THEN 1 ELSE 0 END) AS bigint) AS sold FROM settlement GROUP BY branch_id""")
def settlement_sums(v):
    sold = v.pos.select("receipt").distinct().withColumn("sold", F.lit(1))
    return v.settlement.join(sold, "receipt", "left").groupBy("branch_id").agg(F.count("*").alias("n"), F.sum("gross").alias("gross"), F.sum(F.coalesce("sold", F.lit(0))).alias("sold"))


@query("G29_statement_period", "SELECT account_id, min(post_date) AS first_day, max(post_date) AS last_day FROM bank GROUP BY account_id", dates=("first_day", "last_day"))
def statement_period(v):
    return v.bank.groupBy("account_id").agg(F.min("post_date").alias("first_day"), F.max("post_date").alias("last_day"))


@query("H04_ordinals", "SELECT bank_id, CAST(row_number() OVER (PARTITION BY account_id, amount_key, post_date ORDER BY bank_id) AS integer) AS ordinal FROM bank")
def ordinals(v):
    return v.bank.select("bank_id", F.row_number().over(Window.partitionBy("account_id", "amount_key", "post_date").orderBy("bank_id")).alias("ordinal"))


@query("H07_snapshot_at", "SELECT account_id, balance_after FROM (SELECT *, row_number() OVER (PARTITION BY account_id ORDER BY post_date DESC, bank_id DESC) AS n FROM bank WHERE balance_after IS NOT NULL AND post_date < DATE '2000-07-01') WHERE n = 1")
def snapshot_at(v):
    return latest_value(v.bank.where("post_date < DATE '2000-07-01'"), ["account_id"], "balance_after", ["post_date", "bank_id"]).select("account_id", "balance_after")


@query("H10_residual_to_first", """
    SELECT treasury_id, bank_id, CAST(abs(bank_amount) + CASE WHEN row_number() OVER (PARTITION BY treasury_id ORDER BY post_date, bank_id) = 1 THEN abs(amount) - sum(abs(bank_amount)) OVER (PARTITION BY treasury_id) ELSE 0 END AS bigint) AS leg
    FROM (SELECT l.*, t.amount FROM links l JOIN treasury t ON t.treasury_id = l.treasury_id)""")
def residual(v):
    group = Window.partitionBy("treasury_id")
    first = F.row_number().over(group.orderBy("post_date", "bank_id")) == 1
    owed = F.abs("amount") - F.sum(F.abs("bank_amount")).over(group)
    met = v.links.join(v.treasury.select("treasury_id", "amount"), "treasury_id")
    return met.select("treasury_id", "bank_id", (F.abs("bank_amount") + F.when(first, owed).otherwise(0)).alias("leg"))


@query("I02_page", "SELECT bank_id, amount FROM bank ORDER BY post_date DESC, bank_id LIMIT 50 OFFSET 100")
def page(v):
    return v.bank.orderBy(F.desc("post_date"), "bank_id").offset(100).limit(50).select("bank_id", "amount")


@query("I06_by_total", "SELECT account_id, CAST(sum(abs(amount)) AS bigint) AS total FROM bank GROUP BY account_id ORDER BY total DESC, account_id LIMIT 5")
def by_total(v):
    return v.bank.groupBy("account_id").agg(F.sum(F.abs("amount")).alias("total")).orderBy(F.desc("total"), "account_id").limit(5)


@query("J03_exclusions", "SELECT treasury_id FROM matches WHERE status = 'MANUAL' UNION SELECT treasury_id FROM treasury WHERE state = 'ANU'")
def exclusions(v):
    return v.matches.where("status = 'MANUAL'").select("treasury_id").union(v.treasury.where("state = 'ANU'").select("treasury_id")).distinct()


@query("J04_two_queues", "SELECT treasury_id, CASE WHEN amount < 0 AND tax_id IS NOT NULL THEN 'creditors' ELSE 'general' END AS queue FROM treasury WHERE state IS DISTINCT FROM 'ANU'")
def two_queues(v):
    return v.treasury.where("NOT state <=> 'ANU'").select("treasury_id", F.when((F.col("amount") < 0) & F.col("tax_id").isNotNull(), "creditors").otherwise("general").alias("queue"))


@query("K05_day_and_clock", "SELECT bank_id, strftime(post_date, '%Y-%m-%d') || CASE WHEN line_no = 1 THEN ' 08:30:00' ELSE ' 00:00:00' END AS at FROM bank")
def day_and_clock(v):
    return v.bank.select("bank_id", F.date_format(with_time(F.col("post_date"), F.when(F.col("line_no") == 1, "08:30").otherwise("noon")), "yyyy-MM-dd HH:mm:ss").alias("at"))


@query("K10_whole_word", "SELECT bank_id FROM bank WHERE regexp_matches(memo, '(^|\\W)GIRO(\\W|$)')")
def whole_word(v):
    return v.bank.where(F.col("memo").rlike(r"(^|\W)GIRO(\W|$)")).select("bank_id")


@query("K18_group_key", "SELECT treasury_id, CASE WHEN tax_id IS NULL THEN '' ELSE tax_id || '|' END || CAST(account_id AS string) AS group_key FROM treasury")
def group_key(v):
    return v.treasury.select("treasury_id", F.concat_ws("|", "tax_id", F.col("account_id").cast("string")).alias("group_key"))


@query("K20_numbers_in_memo", "SELECT bank_id, CAST(len(list_distinct(regexp_extract_all(memo, '[0-9]{8,9}'))) AS bigint) AS n FROM bank")
def numbers_in_memo(v):
    return v.bank.select("bank_id", F.size(F.array_distinct(F.regexp_extract_all("memo", F.lit("([0-9]{8,9})"), 1))).cast("long").alias("n"))


def _two_sided(df, own, other, incoming, keys=("bank_id",)):
    """Bank on one side and another code on the other; money that goes out turns the sides."""
    amount = F.abs("amount")
    sides = [line(own, F.when(incoming, amount), F.when(~incoming, amount), F.lit("bank")), line(other, F.when(~incoming, amount), F.when(incoming, amount), F.lit("other"))]
    return explode_lines(df, list(keys), sides).select(*keys, "code", "debit", "credit")


def _two_sided_sql(rows: str, other: int) -> str:
    return f"""SELECT bank_id, CAST(code AS bigint) AS code, CAST(debit AS bigint) AS debit, CAST(credit AS bigint) AS credit FROM (
      SELECT bank_id, 1000 + account_id AS code, greatest(amount, 0) AS debit, greatest(-amount, 0) AS credit FROM ({rows}) UNION ALL SELECT bank_id, {other}, greatest(-amount, 0), greatest(amount, 0) FROM ({rows}))
      WHERE debit <> 0 OR credit <> 0"""


@query("L02_expense_journal", _two_sided_sql("SELECT bank_id, account_id, amount FROM bank WHERE direction = 'OUT' AND counterparty IS NOT NULL", 3000))
def expense_journal(v):
    return _two_sided(v.bank.where("direction = 'OUT' AND counterparty IS NOT NULL"), 1000 + F.col("account_id"), 3000, F.col("amount") > 0)


@query("L03_card_journal", _two_sided_sql(f"SELECT bank_id, account_id, amount FROM bank WHERE {CARD_SQL}", 17))
def card_journal(v):
    return _two_sided(v.bank.where(is_card_deposit(F.col("direction"), F.col("memo"))), 1000 + F.col("account_id"), 17, F.col("amount") > 0)


@query("L04_small_difference_journal", _two_sided_sql("SELECT bank_id, account_id, amount FROM bank WHERE abs(amount) > 0 AND abs(amount) <= 500000", 2050))
def small_difference_journal(v):
    return _two_sided(v.bank.where(is_small(F.col("amount"), 500_000)), 1000 + F.col("account_id"), 2050, F.col("amount") > 0)


@query("L08_card_net", f"SELECT account_id, CAST(sum(amount) AS bigint) AS net, CAST(greatest(sum(amount), 0) AS bigint) AS debit, CAST(greatest(-sum(amount), 0) AS bigint) AS credit FROM bank WHERE {CARD_SQL} GROUP BY account_id")
def card_net(v):
    net = v.bank.where(is_card_deposit(F.col("direction"), F.col("memo"))).groupBy("account_id").agg(F.sum("amount").alias("net"))
    return net.select("account_id", "net", F.greatest("net", F.lit(0)).alias("debit"), F.greatest(-F.col("net"), F.lit(0)).alias("credit"))
