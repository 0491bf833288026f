"""Who is behind a movement: names and tax ids in memos, entities, suppliers, ledger codes, the expense run; listings and repairs."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from reconlake.functions.amounts import parse_gross
from reconlake.functions.names import client_label, memo_clues, name_after_transfer_word, name_before_tax_id, name_in_transfer, recipient_tokens, tax_ids_in
from reconlake.operators.candidates import window_join
from reconlake.operators.containment import containing
from reconlake.operators.dedup import latest_by
from reconlake.operators.entities import detect, ledger_codes
from reconlake.operators.expenses import expense_pool, expense_run
from reconlake.operators.journal import apportion_each
from reconlake.operators.scoring import firm_identity, memo_identity
from reconlake.plans.catalog import query


@query("K13_recipient_tokens", """
    SELECT treasury_id, CASE WHEN client = 'CLIENTE GENERICO' THEN client WHEN treasury_id % 2 = 0 THEN upper(split_part(client, ',', 1)) ELSE 'SUECIA ' || upper(split_part(client, ',', 1)) END AS words FROM ledger
    WHERE NOT (client = 'CLIENTE GENERICO' AND treasury_id % 2 = 1) UNION ALL
    SELECT treasury_id, 'SUECIA ' || client FROM ledger WHERE client = 'CLIENTE GENERICO' AND treasury_id % 2 = 1""")
def recipients(v):
    memo = F.concat(F.lit("Pago arriendo SUECIA"), F.when(F.col("treasury_id") % 2 == 0, "/").otherwise(" "), F.col("client"), F.lit(" JUN-26"))
    return v.ledger.select("treasury_id", F.array_join(recipient_tokens(memo), " ").alias("words"))


CLUE_FORMS = ("DEP BCI ME SPA {}", "GIRO APP 12345, {}", "deposito en Bco. Chile 12.345.678-9", "{} MORE GIROS NRO. 778899 MG", "99", "DEP MORECAPITAL 76.810.587-K Santnader")


@query("K19_memo_clues")
def clues(v):
    """No SQL: its regular expressions have no lookahead."""
    forms = F.array(*[F.lit(f) for f in CLUE_FORMS])
    memo = F.replace(F.element_at(forms, (F.col("treasury_id") % len(CLUE_FORMS) + 1).cast("int")), F.lit("{}"), F.col("client"))
    return v.ledger.select("treasury_id", memo.alias("memo"), memo_clues(memo).alias("c")).select("treasury_id", "memo", "c.*")


@query("K20_tax_ids_in_text", """
    SELECT bank_id, array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(text, '(\\d{1,2}[.,]?\\d{3}[.,]?\\d{3}-?[\\dkK])', 1), lambda x: regexp_replace(x, '^(\\d+)-?([0-9K])$', '\\1-\\2')))), ' ') AS tax_ids
    FROM (SELECT bank_id, memo || ' ' || coalesce(counterparty_tax_id, '') AS text FROM bank) AS b""")
def tax_ids(v):
    text = F.concat("memo", F.lit(" "), F.coalesce("counterparty_tax_id", F.lit("")))
    return v.bank.select("bank_id", F.array_join(F.array_sort(tax_ids_in(text)), " ").alias("tax_ids"))


@query("K24_identity_gates", """
    SELECT t.treasury_id, b.bank_id, coalesce(t.tax_id = b.counterparty_tax_id, FALSE) OR coalesce(t.client <> 'CLIENTE GENERICO' AND contains(upper(b.counterparty), upper(split_part(t.client, ',', 1))), FALSE) AS firm,
      coalesce(contains(upper(b.counterparty), regexp_extract(t.memo, 'PEREZ[0-9]*')), FALSE) AS by_memo
    FROM ledger t JOIN ledger_bank b ON b.direction = t.direction AND b.amount = t.amount AND abs(date_diff('day', t.doc_date, b.post_date)) <= 7""")
def gates(v):
    c = F.col
    met = window_join(v.ledger, v.ledger_bank.select("bank_id", "direction", "amount", "post_date", "counterparty", "counterparty_tax_id", F.col("memo").alias("description")), ["direction", "amount"], "doc_date", "post_date", 7)
    firm = firm_identity(c("tax_id"), c("counterparty_tax_id"), c("client"), c("counterparty"))
    return met.select("treasury_id", "bank_id", firm.alias("firm"), memo_identity(c("memo"), c("counterparty_tax_id"), c("counterparty"), c("description")).alias("by_memo"))


@query("K25_names_in_memos", """
    SELECT bank_id, CASE WHEN line_no % 4 = 2 AND memo NOT LIKE 'ABN%' THEN 'Customer' ELSE memo END AS by_code, CASE WHEN line_no % 2 = 0 THEN coalesce(counterparty, 'Me Spa') END AS by_word,
      'Vector ' || coalesce(counterparty, 'capital') AS before_id FROM bank""")
def names_in_memos(v):
    word = F.when(F.col("line_no") % 2 == 0, F.concat(F.when(F.col("line_no") % 4 == 0, "Traspaso A: ").otherwise("TRASPASO DE "), F.coalesce("counterparty", F.lit("Me Spa")))).otherwise("Comision Traspaso")
    sent = F.concat(F.when(F.col("line_no") % 2 == 0, "TRANSF. PARA ").otherwise("Transferencia de otro banco "), F.lit("Vector "), F.coalesce("counterparty", F.lit("capital")), F.lit(" 77333096-4"))
    return v.bank.select("bank_id", name_in_transfer(F.col("memo")).alias("by_code"), name_after_transfer_word(word).alias("by_word"), name_before_tax_id(sent).alias("before_id"))


@query("K30_client_labels", """
    SELECT treasury_id, CASE treasury_id % 4 WHEN 0 THEN 'CUSTOMER / x' WHEN 1 THEN upper(client) WHEN 2 THEN client ELSE '—' END AS label FROM treasury""")
def labels(v):
    k = F.col("treasury_id") % 4
    bank = F.when(k == 0, " CUSTOMER").when(k == 1, F.upper("client")).when(k == 3, "  ")
    own = F.when(k == 0, "x").when(k < 3, F.col("client"))
    return v.treasury.select("treasury_id", client_label(bank, own).alias("label"))


ENTITIES_SQL = "SELECT branch_id AS entity_id, '1000000' || CAST(branch_id AS string) || '-K' AS tax_id, 'Customer ' || CAST(branch_id AS string) AS alias FROM branch"


@query("E15_entity_cascade", f"""
    WITH e AS ({ENTITIES_SQL}), h AS (
      SELECT b.bank_id, 0 AS step, e.entity_id FROM bank b JOIN e ON e.tax_id = b.counterparty_tax_id
      UNION ALL SELECT b.bank_id, 2, e.entity_id FROM bank b JOIN e ON starts_with(e.tax_id, CAST(10000000 + b.order_id AS string)) WHERE b.line_no % 4 = 2
      UNION ALL SELECT b.bank_id, 3, e.entity_id FROM bank b JOIN e ON e.alias = b.counterparty),
    r AS (SELECT *, row_number() OVER (PARTITION BY bank_id ORDER BY step, entity_id) AS n FROM h)
    SELECT bank_id, CAST(entity_id AS bigint) AS entity_id, CASE step WHEN 0 THEN 'tax_id' WHEN 2 THEN 'tax_id_in_memo' ELSE 'pattern' END AS via FROM r WHERE n = 1""")
def entities(v):
    b = F.col("branch_id").cast("string")
    known = v.branch.select(F.col("branch_id").cast("long").alias("entity_id"), F.concat(F.lit("1000000"), b, F.lit("-K")).alias("tax_id"), F.array(F.concat(F.lit("Customer "), b)).alias("patterns"))
    return detect(v.bank, known)


SUPPLIERS = [(1, "10000024-K", ["mantencion"]), (2, None, ["GIRO", "ab"]), (3, None, ["PA"])]


@query("E16_suppliers", """
    SELECT bank_id, CAST(CASE WHEN counterparty_tax_id = '10000024-K' THEN 1 WHEN contains(lower(memo), 'mantencion') THEN 1 WHEN contains(lower(memo), 'giro') THEN 2 END AS bigint) AS entity_id,
      CASE WHEN counterparty_tax_id = '10000024-K' THEN 'tax_id' WHEN NOT contains(lower(memo), 'mantencion') AND order_id = 24 AND line_no % 4 = 2 THEN 'tax_id_in_memo' ELSE 'pattern' END AS via
    FROM bank WHERE counterparty_tax_id = '10000024-K' OR contains(lower(memo), 'mantencion') OR contains(lower(memo), 'giro')
    UNION ALL SELECT bank_id, 1, 'tax_id_in_memo' FROM bank WHERE coalesce(counterparty_tax_id, '') <> '10000024-K' AND order_id = 24 AND line_no % 4 = 2""")
def suppliers(v):
    return detect(v.bank, v.spark.createDataFrame(SUPPLIERS, "entity_id long, tax_id string, patterns array<string>"), by_word=False)


ACCOUNTS_SQL = "SELECT account_id, 'Bank ' || CAST(bank_code AS string) AS bank, holder, '7000000' || CAST(account_id AS string) || '-1' AS holder_tax_id FROM account"
CODES_SQL = """SELECT 500 + account_id AS code, CASE account_id % 4 WHEN 0 THEN ' bank ' || CAST(bank_code AS string) || '   ' || upper(holder) WHEN 1 THEN holder WHEN 2 THEN 'other' ELSE 'zz' END AS name,
    CASE WHEN account_id % 4 = 2 THEN account_id END AS account_id FROM account"""


def _accounts(v):
    text = F.col("account_id").cast("string")
    bank = F.col("bank_code").cast("string")
    kind = F.col("account_id") % 4
    name = F.when(kind == 0, F.concat(F.lit(" bank "), bank, F.lit("   "), F.upper("holder"))).when(kind == 1, F.col("holder")).when(kind == 2, "other").otherwise("zz")
    accounts = v.account.select("account_id", F.concat(F.lit("Bank "), bank).alias("bank"), "holder", F.concat(F.lit("7000000"), text, F.lit("-1")).alias("holder_tax_id"))
    return accounts, v.account.select((500 + F.col("account_id")).alias("code"), name.alias("name"), F.when(kind == 2, F.col("account_id")).alias("account_id"))


@query("E18_ledger_code_cascade", "SELECT account_id, CAST(CASE WHEN account_id % 4 < 3 THEN 500 + account_id WHEN account_id = 3 THEN 903 END AS bigint) AS code FROM account")
def code_cascade(v):
    accounts, codes = _accounts(v)
    held = v.spark.createDataFrame([("70000003-1", 903), ("70000007-1", None)], "tax_id string, code long")
    return ledger_codes(accounts, codes, held)


@query("E19_inferred_codes", "SELECT account_id, CAST(CASE WHEN account_id % 4 < 2 THEN 500 + account_id END AS bigint) AS code FROM account")
def inferred_codes(v):
    accounts, codes = _accounts(v)
    return ledger_codes(accounts, codes, explicit=False, least=3)


@query("E09_expense_run")
def expenses(v):
    """Outgoing ledger rows against outgoing bank rows that no income link and no own account holds."""
    linked = v.ledger_bank.where("account_id = 3").select("bank_id")
    return expense_run(v.ledger.where("direction = 'OUT'"), expense_pool(v.ledger_bank, linked))


SNAPSHOTS_SQL = "SELECT account_id, DATE '2024-01-01' AS day, manual_balance AS balance, 1 AS entry FROM account UNION ALL SELECT account_id, DATE '2024-02-01', manual_balance + 100, 2 FROM account WHERE account_id % 2 = 0 UNION ALL SELECT account_id, DATE '2024-02-01', 7, 3 FROM account WHERE account_id = 4"


@query("X03_balance_snapshots", f"SELECT account_id, day, balance, CAST(count(*) OVER (PARTITION BY account_id) AS bigint) AS n FROM ({SNAPSHOTS_SQL}) AS s WHERE entry <> 3 QUALIFY row_number() OVER (PARTITION BY account_id ORDER BY day DESC, entry DESC) = 1", dates=("day",))
def snapshots(v):
    """Appended snapshots without a deleted one: the latest of each account and how many it has."""
    rows = v.spark.sql(SNAPSHOTS_SQL.replace("FROM account", "FROM {account}"), account=v.account)
    kept = rows.join(rows.where("entry = 3").select("account_id", "entry"), ["account_id", "entry"], "left_anti")
    counts = kept.groupBy("account_id").agg(F.count("*").alias("n"))
    return latest_by(kept, ["account_id"], [F.desc("day"), F.desc("entry")]).join(counts, "account_id").select("account_id", "day", "balance", "n")


@query("X04_code_catalogue", f"SELECT c.code, c.name, a.holder || ' ' || CAST(a.bank_code AS string) AS account_label, CAST(b.branch_id AS string) || ' · ' || b.branch AS branch_label FROM ({CODES_SQL}) AS c LEFT JOIN account a ON a.account_id = c.account_id LEFT JOIN branch b ON b.branch_id + 500 = c.code")
def catalogue(v):
    _, codes = _accounts(v)
    account = v.account.select("account_id", F.concat_ws(" ", "holder", F.col("bank_code").cast("string")).alias("account_label"))
    branch = v.branch.select((500 + F.col("branch_id")).alias("code"), F.concat_ws(" · ", F.col("branch_id").cast("string"), "branch").alias("branch_label"))
    return codes.join(account, "account_id", "left").join(branch, "code", "left").select("code", "name", "account_label", "branch_label")


@query("X05_branch_listing", "SELECT CAST(row_number() OVER (ORDER BY region_id, branch) AS integer) AS place, branch_id, branch, CAST(headcount AS bigint) AS headcount FROM branch")
def branch_listing(v):
    """Branches in their order, numbered: places within a region, and how many branches come before it."""
    regions = v.branch.groupBy("region_id").agg(F.count("*").alias("n"))
    so_far = Window.orderBy("region_id").rowsBetween(Window.unboundedPreceding, -1)  # a row per region
    before = regions.select("region_id", F.coalesce(F.sum("n").over(so_far), F.lit(0)).alias("before"))
    own = F.row_number().over(Window.partitionBy("region_id").orderBy("branch"))
    rows = v.branch.withColumn("own", own).join(before, "region_id")
    return rows.select((F.col("own") + F.col("before")).cast("int").alias("place"), F.col("branch_id").cast("int").alias("branch_id"), "branch", F.col("headcount").cast("long").alias("headcount"))


@query("X07_journal_detail", """
    WITH e AS (SELECT t.treasury_id, abs(t.amount) AS gross, t.client FROM treasury t JOIN matches m ON m.treasury_id = t.treasury_id WHERE m.status = 'MANUAL' AND t.kind = 'NORMAL'), w AS (SELECT branch_id, branch, CAST(headcount AS bigint) AS w FROM branch),
    s AS (SELECT e.*, branch, branch_id, w, sum(w) OVER (PARTITION BY treasury_id) AS tot FROM e JOIN w ON TRUE), r AS (SELECT *, gross * w // tot AS base, gross * w % tot AS rem FROM s),
    k AS (SELECT *, gross - sum(base) OVER (PARTITION BY treasury_id) AS leftover, row_number() OVER (PARTITION BY treasury_id ORDER BY rem DESC, w DESC, branch_id) AS n FROM r)
    SELECT treasury_id, client, branch, CAST(base + CASE WHEN n <= leftover THEN 1 ELSE 0 END AS bigint) AS part, CAST(w * 10000 // tot AS bigint) AS share_bp FROM k""")
def journal_detail(v):
    """Manual journals with their branch lines."""
    entries = v.treasury.where("kind = 'NORMAL'").join(v.matches.where("status = 'MANUAL'"), "treasury_id").select("treasury_id", "client", F.abs("amount").alias("gross"))
    weights = v.branch.select("branch_id", "branch", F.col("headcount").cast("long").alias("w"))
    total = weights.agg(F.sum("w")).first()[0] or 1
    lines = apportion_each(entries, weights, "gross", "w", "branch_id")
    return lines.select("treasury_id", "client", "branch", "part", F.floor(F.col("w") * 10_000 / total).cast("long").alias("share_bp"))


@query("X08_holder_repair", """
    WITH c AS (SELECT c_custkey, c_name, c_nationkey FROM customer), e AS (SELECT branch_id, 'r#00000000' || CAST(branch_id AS string) AS needle FROM branch UNION ALL SELECT 99, 'r#000000001' ),
    h AS (SELECT c_custkey, count(branch_id) AS n, min(branch_id) AS least FROM c LEFT JOIN e ON contains(lower(c_name), needle) GROUP BY 1)
    SELECT c_custkey AS holder_id, CAST(CASE WHEN n = 1 THEN least END AS bigint) AS entity_id, CASE WHEN n = 0 THEN 'none' WHEN n = 1 THEN 'set' ELSE 'ambiguous' END AS outcome FROM h""")
def holder_repair(v):
    """A holder gets the entity whose name it holds, unless several fit."""
    names = v.branch.select(F.col("branch_id").cast("long").alias("entity_id"), F.concat(F.lit("r#00000000"), F.col("branch_id").cast("string")).alias("needle"))
    known = names.unionByName(v.spark.createDataFrame([(99, "r#000000001")], "entity_id long, needle string"))
    holders = v.table("customer").select(F.col("c_custkey").alias("holder_id"), F.lower("c_name").alias("name"))
    found = containing(holders, "name", known, "needle").groupBy("holder_id").agg(F.count("entity_id").alias("n"), F.min("entity_id").alias("least"))
    hits = holders.select("holder_id").join(found, "holder_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return hits.select("holder_id", F.when(F.col("n") == 1, F.col("least")).alias("entity_id"), F.when(F.col("n") == 0, "none").when(F.col("n") == 1, "set").otherwise("ambiguous").alias("outcome"))


@query("X09_gross_backfill", "SELECT event_id, CASE WHEN event_id % 4 = 0 THEN CAST(regexp_extract(props, '\"k\": ([0-9]+)', 1) AS bigint) ELSE CAST(round(value * 100) AS bigint) END AS gross, event_id % 4 = 0 AND regexp_extract(props, '\"k\": ([0-9]+)', 1) <> '0' AS filled FROM events")
def gross_backfill(v):
    """A gross of nothing is taken from the row's own JSON text."""
    told = parse_gross(F.get_json_object("props", "$.k"))
    rows = v.table("events").select("event_id", F.when(F.col("event_id") % 4 == 0, 0).otherwise(F.round(F.col("value") * 100).cast("long")).alias("kept"), F.coalesce(told, F.lit(0)).cast("long").alias("told"))
    fill = (F.col("event_id") % 4 == 0) & (F.col("told") > 0)
    return rows.select("event_id", F.when(fill, F.col("told")).otherwise(F.col("kept")).alias("gross"), fill.alias("filled"))


@query("X11_match_dump", """
    SELECT m.treasury_id, m.status, t.client, t.amount, l.bank_id, l.bank_amount, b.memo, a.holder FROM matches m JOIN treasury t ON t.treasury_id = m.treasury_id
    LEFT JOIN links l ON l.treasury_id = m.treasury_id LEFT JOIN bank b ON b.bank_id = l.bank_id LEFT JOIN account a ON a.account_id = b.account_id WHERE m.status IN ('AUTO', 'MANUAL')""")
def match_dump(v):
    flat = v.matches.where("status IN ('AUTO', 'MANUAL')").join(v.treasury.select("treasury_id", "client", "amount"), "treasury_id").join(v.links.select("treasury_id", "bank_id", "bank_amount"), "treasury_id", "left")
    flat = flat.join(v.bank.select("bank_id", "memo", "account_id"), "bank_id", "left").join(v.account.select("account_id", "holder"), "account_id", "left")
    return flat.select("treasury_id", "status", "client", "amount", "bank_id", "bank_amount", "memo", "holder")


@query("X11_unmatched_dump", "SELECT t.treasury_id, t.client, t.amount FROM treasury t LEFT JOIN matches m ON m.treasury_id = t.treasury_id WHERE m.treasury_id IS NULL OR m.status IN ('NO_MATCH', 'REVIEW')")
def unmatched_dump(v):
    done = v.matches.where("status NOT IN ('NO_MATCH', 'REVIEW')")
    return v.treasury.join(done, "treasury_id", "left_anti").select("treasury_id", "client", "amount")


@query("L10_serialised_journals", f"""
    WITH c AS (SELECT account_id, CAST(CASE WHEN account_id % 4 < 3 THEN 500 + account_id WHEN account_id = 3 THEN 903 END AS bigint) AS code FROM account)
    SELECT b.bank_id, c.code AS bank_code, coalesce(CASE WHEN n.branch_id % 2 = 0 THEN 700 + n.branch_id END, n.branch_id) AS branch_code, abs(b.amount) AS net FROM bank b JOIN account a ON a.account_id = b.account_id LEFT JOIN c ON c.account_id = b.account_id
    JOIN branch n ON n.branch_id = b.part_id % 13 WHERE b.direction = 'OUT'""")
def serialised(v):
    """Journals with resolved codes: the account's by the cascade, the branch's linked one or else its own number."""
    linked = v.branch.select("branch_id", F.coalesce(F.when(F.col("branch_id") % 2 == 0, 700 + F.col("branch_id")), F.col("branch_id")).cast("long").alias("branch_code"))
    rows = v.bank.where("direction = 'OUT'").withColumn("branch_id", F.col("part_id") % 13)
    return rows.join(code_cascade(v), "account_id").join(linked, "branch_id").select("bank_id", F.col("code").alias("bank_code"), "branch_code", F.abs("amount").alias("net"))


@query("L12_manual_emission", """
    SELECT account_id, CAST(count(*) AS bigint) AS n, CAST(sum(abs(amount)) AS bigint) AS net, CAST(sum(CASE WHEN account_id = 2 THEN 0 ELSE 1 END) AS bigint) AS emitted
    FROM bank WHERE direction = 'OUT' AND post_date >= DATE '1998-01-01' AND post_date < DATE '1998-07-01' AND part_id % 5 <> 0 GROUP BY account_id""")
def manual_emission(v):
    """Generated journals of a period become batches by account; the batch of account 2 is undone: its journals are generated again."""
    journals = v.bank.where("direction = 'OUT' AND post_date >= DATE '1998-01-01' AND post_date < DATE '1998-07-01'")
    journals = journals.withColumn("state", F.when(F.col("part_id") % 5 == 0, "DRAFT").otherwise("GENERATED"))
    batch = journals.where("state = 'GENERATED'").select("bank_id", F.col("account_id").alias("batch"))
    undone = batch.where("batch = 2")
    kept = batch.join(undone, "bank_id", "left_anti").select("bank_id", F.lit("EMITTED").alias("emitted"))
    rows = journals.where("state = 'GENERATED'").join(kept, "bank_id", "left")
    return rows.groupBy("account_id").agg(F.count("*").alias("n"), F.sum(F.abs("amount")).alias("net"), F.count("emitted").alias("emitted"))


@query("L13_settlement_close_and_trash", """
    SELECT settlement_id, CASE WHEN settlement_id % 10 = 1 THEN 'trashed' WHEN branch_id = 1 AND settlement_id % 4 = 1 THEN 'open again' WHEN branch_id <= 1 THEN 'closed' ELSE 'open' END AS state FROM settlement""")
def close_and_trash(v):
    """Closed settlements are consumed; an undone close frees its own; those in the trash are neither."""
    s = v.settlement.select("settlement_id", "branch_id")
    trash = s.where("settlement_id % 10 = 1").select("settlement_id", F.lit(True).alias("trashed"))
    closed = s.where("branch_id <= 1").join(trash, "settlement_id", "left_anti")
    undone = closed.where("branch_id = 1 AND settlement_id % 4 = 1").select("settlement_id", F.lit(True).alias("undone"))
    done = closed.select("settlement_id", F.lit(True).alias("closed"))
    rows = s.join(trash, "settlement_id", "left").join(done, "settlement_id", "left").join(undone, "settlement_id", "left")
    return rows.select("settlement_id", F.when(F.col("trashed"), "trashed").when(F.col("undone"), "open again").when(F.col("closed"), "closed").otherwise("open").alias("state"))
