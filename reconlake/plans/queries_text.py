"""Scalar functions over texts built from the tables, and the streaming ingest as a query."""

from __future__ import annotations


from pyspark.sql import functions as F

from reconlake.functions.amounts import gross_up, parse_amount
from reconlake.functions.dates import parse_date
from reconlake.functions.names import account_digits, compact_tax_id, dashed_tax_id, memo_parts, normal_text, plain_upper, receipt_list, tax_id_in
from reconlake.operators.assign import shared_folder
from reconlake.plans.catalog import query
from reconlake.streaming.ingest import current, file_stream, ingest_stream

CENTS = "CAST(round(l_extendedprice * 100) AS bigint)"
TEXTS = f"""
    SELECT CAST({CENTS} AS string) AS digits, l_partkey % 6 AS form, l_orderkey, l_linenumber, l_partkey, l_suppkey, {CENTS} AS cents, CAST(l_shipdate AS date) AS day FROM lineitem"""
FORMS = """CASE form WHEN 0 THEN digits WHEN 1 THEN '$' || substr(digits, 1, length(digits) - 3) || '.' || substr(digits, length(digits) - 2, 3)
    WHEN 2 THEN '-' || substr(digits, 1, length(digits) - 3) || ',' || substr(digits, length(digits) - 2, 3) WHEN 3 THEN '(' || digits || ',50)' WHEN 4 THEN digits || '.5' ELSE 'n/a' END"""


def _lines(v, columns: str):
    return v.spark.sql(f"SELECT {columns} FROM ({TEXTS.replace('FROM lineitem', 'FROM {lineitem}')})", lineitem=v.table("lineitem"))


@query("K01_parse_amount", f"SELECT l_orderkey, l_linenumber, cents, CAST(CASE form WHEN 5 THEN NULL WHEN 2 THEN -cents WHEN 3 THEN -cents ELSE cents END AS bigint) AS amount FROM ({TEXTS})")
def amounts(v):
    return _lines(v, f"l_orderkey, l_linenumber, cents, {FORMS} AS written").select("l_orderkey", "l_linenumber", "cents", parse_amount(F.col("written")).alias("amount"))


@query("K03_parse_date", f"SELECT l_orderkey, l_linenumber, cents, CASE WHEN form = 5 THEN NULL ELSE CAST(day AS string) END AS parsed FROM ({TEXTS})")
def dates(v):
    day = F.col("day")
    written = F.when(F.col("form") == 0, day.cast("string")).when(F.col("form") < 3, F.date_format(day, "dd/MM/yyyy")).when(F.col("form") < 5, F.date_format(day, "d-M-yyyy")).otherwise("pronto")
    return _lines(v, "l_orderkey, l_linenumber, cents, day, form").select("l_orderkey", "l_linenumber", "cents", parse_date(written).cast("string").alias("parsed"))


TAX_IDS_SQL = """
    SELECT bank_id, counterparty_tax_id AS dashed, coalesce(replace(counterparty_tax_id, '-', ''), '') AS compact, regexp_extract(memo, '^(ABN CRD TRANSBANK )?([0-9]{8,11})', 2) AS in_memo FROM bank"""


@query("K06_tax_ids_all", TAX_IDS_SQL)
@query("K06_tax_ids", TAX_IDS_SQL)
def tax_ids(v):
    loose = F.lower(F.concat(F.substring("counterparty_tax_id", 1, 2), F.lit("."), F.substring("counterparty_tax_id", 3, 3), F.lit("."), F.substring("counterparty_tax_id", 6, 10)))
    return v.bank.select("bank_id", dashed_tax_id(loose).alias("dashed"), compact_tax_id(loose).alias("compact"), tax_id_in(F.col("memo")).alias("in_memo"))


@query("K11_whole_texts")
@query("K11_plain_text")
def plain_texts(v):
    """Every row's whole text; no SQL, as DuckDB's upper leaves some letters that Spark's changes."""
    return v.table("documents").select("doc_id", plain_upper(F.col("text")).alias("plain"))


@query("K14_normal_text", "SELECT bank_id, lower(memo) AS memo, CAST(ltrim(CAST(order_id AS string), '0') AS string) AS digits FROM bank")
def normal(v):
    return v.bank.select("bank_id", normal_text(F.concat(F.lit("  "), F.regexp_replace("memo", " ", "   "), F.lit(" "))).alias("memo"), account_digits(F.concat(F.lit("00-"), F.col("order_id").cast("string"))).alias("digits"))


MEMO_PARTS_SQL = "SELECT bank_id, memo LIKE 'DEP (%' AS is_multipart, CASE WHEN memo LIKE 'DEP (%' THEN CAST(line_no AS integer) END AS part_number FROM bank"


@query("K17_memo_parts_all", MEMO_PARTS_SQL)
@query("K17_memo_parts", MEMO_PARTS_SQL)
def memos(v):
    return v.bank.select("bank_id", memo_parts(F.col("memo")).alias("p")).select("bank_id", "p.*")


RECEIPTS_SQL = """
    SELECT bank_id, CASE WHEN line_no % 5 <> 0 THEN CAST(1000 + part_id % 8000 AS bigint) END AS first_receipt, CASE WHEN line_no % 5 <> 0 THEN CAST(1 + line_no % 5 AS bigint) END AS n FROM bank"""


@query("K22_receipts_all", RECEIPTS_SQL)
@query("K22_receipts", RECEIPTS_SQL)
def receipts(v):
    """Two equal receipts are no list and give nulls; receipts have three or four digits."""
    a = 1000 + F.col("part_id") % 8000
    found = receipt_list(F.concat(F.lit("N OPE "), a.cast("string"), F.lit("/"), (a + F.col("line_no") % 5).cast("string")))
    told = F.transform(F.array(found), lambda x: F.struct(F.element_at(x, 1).cast("long").alias("first_receipt"), F.when(x.isNotNull(), F.size(x)).cast("long").alias("n")))
    return v.bank.select("bank_id", F.explode(told).alias("told")).select("bank_id", "told.*")


@query("K31_gross_up", "SELECT treasury_id, CAST((CAST(abs(amount) AS hugeint) * 10000 + 4237) // 8475 AS bigint) AS gross, CAST((CAST(abs(amount) AS hugeint) * 10000 + 4237) // 8475 - abs(amount) AS bigint) AS retention FROM treasury")
def grossed(v):
    gross, kept = gross_up(F.abs("amount"), 1525)
    return v.treasury.select("treasury_id", gross.alias("gross"), kept.alias("retention"))


@query("M02_stream_latest_wins", "SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(event_type, (ts, event_id)) AS event_type FROM events WHERE user_id % 10 <> 0 GROUP BY user_id")
def stream_latest(v):
    spark = v.spark
    folder = shared_folder(spark, "ingest")
    events = v.table("events")
    ingest_stream(file_stream(spark, v.sf_dir, events.schema, "events.parquet"), f"{folder}/log", f"{folder}/progress").awaitTermination()
    gone = events.where("user_id % 10 = 0").select("user_id")
    return current(spark, f"{folder}/log", ["user_id"], ["ts", "event_id"], gone).select("user_id", "event_id", "event_type")
