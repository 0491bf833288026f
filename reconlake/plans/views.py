"""Movement views over the star-schema tables, as SQL that both Spark and a plain SQL engine understand."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

_CENTS = "CAST(round({0} * 100) AS bigint)"
_PRICE, _TOTAL, _VALUE = (_CENTS.format(c) for c in ("l_extendedprice", "o_totalprice", "value"))

#: View name -> SELECT over {table} names. Money is whole cents; the sign of a bank amount is its direction.
VIEWS: dict[str, str] = {
    "bank": f"""
        SELECT concat_ws('-', CAST(l_orderkey AS string), CAST(l_linenumber AS string), CAST(l_partkey AS string), CAST(l_suppkey AS string),
                 CAST(CAST(l_shipdate AS date) AS string), CAST({_PRICE} AS string)) AS bank_id,
          l_suppkey % 10 AS account_id,
          CASE WHEN l_returnflag = 'R' THEN 'OUT' ELSE 'IN' END AS direction,
          CASE WHEN l_returnflag = 'R' THEN -{_PRICE} ELSE {_PRICE} END AS amount,
          {_PRICE} % 199 + 1 AS amount_key,
          CAST(l_shipdate AS date) AS post_date,
          l_orderkey AS order_id, l_partkey AS part_id, l_linenumber AS line_no,
          CASE WHEN l_partkey % 11 = 0 THEN 'ABN CRD TRANSBANK ' ELSE '' END ||
            CASE l_linenumber % 4 WHEN 0 THEN 'Comision mantencion' WHEN 1 THEN 'DEP (' || CAST(l_linenumber AS string) || ') GIRO'
              WHEN 2 THEN '0' || CAST(10000000 + l_orderkey AS string) || ' Transf a Customer' ELSE 'PAGO ' || CAST(l_partkey AS string) END AS memo,
          CASE WHEN l_partkey % 3 = 0 THEN NULL ELSE 'Customer ' || CAST(l_partkey % 50 AS string) END AS counterparty,
          CASE WHEN l_partkey % 4 = 0 THEN CAST(10000000 + l_partkey % 50 AS string) || '-K' ELSE NULL END AS counterparty_tax_id,
          CASE WHEN l_partkey % 5 = 0 THEN NULL ELSE CAST(round(l_tax * l_extendedprice * 100) AS bigint) END AS balance_after
        FROM {{lineitem}}""",
    "treasury": f"""
        SELECT o_orderkey AS treasury_id, o_custkey AS client_id, o_custkey % 10 AS account_id, o_custkey % 13 AS branch_id, o_orderkey % 29 AS cashier_id,
          CASE WHEN o_custkey % 4 = 0 THEN 'OUT' ELSE 'IN' END AS direction,
          CASE WHEN o_custkey % 4 = 0 THEN -{_TOTAL} ELSE {_TOTAL} END AS amount,
          {_TOTAL} % 199 + 1 AS amount_key,
          CAST(o_orderdate AS date) AS doc_date,
          CASE o_orderstatus WHEN 'P' THEN 'ANU' WHEN 'F' THEN 'CAJ' ELSE NULL END AS state,
          CASE o_orderpriority WHEN '1-URGENT' THEN 'TBK' WHEN '5-LOW' THEN NULL ELSE 'NORMAL' END AS kind,
          o_orderkey % 17 = 0 AS is_exception,
          'Customer ' || CAST(o_custkey % 50 AS string) AS client,
          CASE WHEN o_custkey % 3 = 0 THEN CAST(10000000 + o_custkey % 50 AS string) || '-K' ELSE NULL END AS tax_id
        FROM {{orders}}""",
    "matches": """
        SELECT o_orderkey AS treasury_id,
          CASE o_orderkey % 6 WHEN 0 THEN 'AUTO' WHEN 1 THEN 'MANUAL' WHEN 2 THEN 'SUGGESTED' WHEN 3 THEN 'REVIEW' WHEN 4 THEN 'NO_MATCH' ELSE 'OUT_OF_SCOPE' END AS status
        FROM {orders} WHERE o_orderkey % 7 <> 0""",
    "account": """
        SELECT s_suppkey AS account_id, s_name AS holder, s_nationkey AS bank_code, CAST(round(s_acctbal * 100) AS bigint) AS manual_balance
        FROM {supplier} WHERE s_suppkey < 10""",
    "branch": "SELECT n_nationkey AS branch_id, n_name AS branch, n_regionkey AS region_id, 1 + n_nationkey % 4 AS headcount FROM {nation} WHERE n_nationkey < 13",
    "pos": f"""
        SELECT event_id AS pos_id, user_id % 7 AS branch_id, CAST(ts AS date) AS sale_date, {_VALUE} AS amount, regexp_extract(props, '[0-9]+', 0) AS receipt
        FROM {{events}} WHERE event_id % 2 = 0""",
    "settlement": f"""
        SELECT event_id AS settlement_id, user_id % 7 AS branch_id, CAST(ts AS date) AS sale_date, {_VALUE} AS gross, {_VALUE} * 2 // 100 AS fee, regexp_extract(props, '[0-9]+', 0) AS receipt
        FROM {{events}} WHERE event_id % 2 = 1""",
    # card sales whose settlements carry a surcharge, name no receipt, come in two, lack a branch or are linked by hand
    "card_sales": f"""
        SELECT event_id AS pos_id, user_id % 7 AS branch_id, CAST(ts AS date) AS sale_date, {_VALUE} + 100 AS amount,
          CASE WHEN event_id % 5 = 0 THEN NULL WHEN event_id % 5 = 1 THEN '' ELSE '0' || CAST(1000 + event_id % 700 AS string) END AS receipt,
          CASE WHEN event_id % 6 = 0 THEN 'GIRO N OPE ' || CAST(1000 + event_id * 3 % 8000 AS string) || '/' || CAST(1001 + event_id * 3 % 8000 AS string) ELSE 'GIRO' END AS memo,
          CASE WHEN event_id % 7 < 4 THEN NULL ELSE CAST(floor(({_VALUE} + 100) / 50.0) AS bigint) END AS api_fee
        FROM {{events}} WHERE event_id % 2 = 0""",
    "card_settlements": f"""
        SELECT event_id * 10 AS settlement_id, CASE WHEN event_id % 11 = 0 THEN NULL ELSE user_id % 7 END AS branch_id, date_add(CAST(ts AS date), CAST(event_id % 3 AS int)) AS sale_date,
          CASE WHEN event_id % 7 < 4 THEN {_VALUE} + 100 ELSE {_VALUE} + 100 + CAST(floor(({_VALUE} + 100) / 50.0) AS bigint) END AS gross,
          CASE WHEN event_id % 5 = 0 THEN NULL ELSE CAST(1000 + event_id % 700 AS string) END AS receipt,
          CAST(floor(({_VALUE} + 100) / 80.0) AS bigint) AS fee, CAST(floor(({_VALUE} + 100) / 420.0) AS bigint) AS fee_tax
        FROM {{events}} WHERE event_id % 2 = 0 AND event_id % 6 <> 0
        UNION ALL
        SELECT event_id * 10 + 1, user_id % 7, CAST(ts AS date), CAST(floor(({_VALUE} + 100) / 3.0) AS bigint), CAST(1000 + event_id * 3 % 8000 AS string), event_id % 90, event_id % 17 FROM {{events}} WHERE event_id % 6 = 0
        UNION ALL
        SELECT event_id * 10 + 2, user_id % 7, CAST(ts AS date), {_VALUE} + 100 - CAST(floor(({_VALUE} + 100) / 3.0) AS bigint), '0' || CAST(1001 + event_id * 3 % 8000 AS string), event_id % 80, event_id % 15 FROM {{events}} WHERE event_id % 6 = 0""",
    "card_pairs": """
        SELECT event_id AS pos_id, event_id * 10 AS settlement_id FROM {events} WHERE event_id % 2 = 0 AND event_id % 6 <> 0
        UNION ALL SELECT event_id, event_id * 10 + 1 FROM {events} WHERE event_id % 6 = 0 UNION ALL SELECT event_id, event_id * 10 + 2 FROM {events} WHERE event_id % 6 = 0""",
    "card_links": "SELECT event_id AS pos_id, (event_id + 2) * 10 AS settlement_id FROM {events} WHERE event_id % 94 = 0",
    # a ledger whose rows are paid by one to three bank rows: true amounts, some on another account, some voided
    "ledger_bank": f"""
        SELECT CAST(l_orderkey AS string) || '-' || CAST(l_linenumber AS string) || '-' || CAST(l_partkey AS string) || '-' || CAST({_PRICE} AS string) AS bank_id,
          CASE WHEN l_orderkey % 23 = 0 THEN (l_orderkey + 1) % 10 ELSE l_orderkey % 10 END AS account_id,
          CASE WHEN l_orderkey % 4 = 0 THEN 'OUT' ELSE 'IN' END AS direction,
          CASE WHEN l_orderkey % 4 = 0 THEN -{_PRICE} ELSE {_PRICE} END AS amount,
          date_add(DATE '1995-01-01', CAST(l_orderkey * 7 % 2000 + l_orderkey % 5 * ((l_linenumber + 1) % 3) AS int)) AS post_date,
          CASE WHEN l_orderkey % 3 = 0 THEN NULL ELSE 'Transf de Perez' || CAST(l_orderkey % 50 AS string) || ' Ana' END AS counterparty,
          CASE WHEN l_orderkey % 7 = 0 THEN CAST(10000000 + l_orderkey % 50 AS string) || '-K' ELSE NULL END AS counterparty_tax_id,
          'GIRO ' || CAST(l_partkey AS string) AS memo
        FROM {{lineitem}}""",
    "ledger": f"""
        SELECT o_orderkey AS treasury_id,
          CASE WHEN o_orderkey % 37 = 0 THEN NULL ELSE o_orderkey % 10 END AS account_id,
          CASE WHEN o_orderkey % 4 = 0 THEN 'OUT' ELSE 'IN' END AS direction,
          CAST(sum(CASE WHEN o_orderkey % 4 = 0 THEN -{_PRICE} ELSE {_PRICE} END) AS bigint) AS amount,
          date_add(DATE '1995-01-01', CAST(o_orderkey * 7 % 2000 AS int)) AS doc_date,
          CASE WHEN o_orderkey % 31 = 0 THEN 'ANU' ELSE NULL END AS state, o_orderkey % 17 = 0 AS is_exception,
          CASE WHEN o_orderkey % 11 = 0 THEN 'CLIENTE GENERICO' ELSE 'Perez' || CAST(o_orderkey % 50 AS string) || ', Ana' END AS client,
          CASE WHEN o_orderkey % 14 = 0 THEN CAST(10000000 + o_orderkey % 50 AS string) || '-K' ELSE NULL END AS tax_id,
          CASE WHEN o_orderkey % 41 = 0 THEN 'DEP (2) PEREZ' ELSE 'DEP PEREZ' || CAST(o_orderkey % 50 AS string) END AS memo
        FROM {{orders}} JOIN {{lineitem}} ON l_orderkey = o_orderkey WHERE l_linenumber <= 1 + o_orderkey % 3 GROUP BY o_orderkey""",
}
VIEWS["links"] = f"SELECT order_id AS treasury_id, bank_id, amount AS bank_amount, post_date FROM ({VIEWS['bank']}) AS b WHERE line_no <= 3"
# the same ledger with bank names instead of accounts, links made by hand, and rows that had links before
VIEWS["ledger_named"] = f"SELECT treasury_id, CASE WHEN account_id IS NULL THEN NULL ELSE 'Banco ' || CAST(account_id AS string) END AS bank_name, direction, amount, doc_date, state, is_exception, client, tax_id, memo FROM ({VIEWS['ledger']}) AS l"
VIEWS["ledger_alias"] = "SELECT 'Banco ' || CAST(s_suppkey AS string) AS alias, s_suppkey AS account_id FROM {supplier} WHERE s_suppkey < 9"
VIEWS["ledger_account"] = "SELECT s_suppkey AS account_id, s_suppkey % 4 AS bank_code, s_suppkey = 6 AS partial_use FROM {supplier} WHERE s_suppkey < 10"
VIEWS["ledger_manual"] = f"""
    SELECT l_orderkey AS treasury_id, min(CAST(l_orderkey AS string) || '-' || CAST(l_linenumber AS string) || '-' || CAST(l_partkey AS string) || '-' || CAST({_PRICE} AS string)) AS bank_id
    FROM {{lineitem}} WHERE l_orderkey % 29 = 0 GROUP BY l_orderkey"""
VIEWS["ledger_linked"] = "SELECT o_orderkey AS treasury_id FROM {orders} WHERE o_orderkey % 62 = 0"
VIEWS["card_consumed"] = "SELECT event_id AS pos_id, CAST(NULL AS bigint) AS settlement_id FROM {events} WHERE event_id % 16 = 0 UNION ALL SELECT NULL, event_id * 10 + 1 FROM {events} WHERE event_id % 30 = 0"
VIEWS["settlement"] = VIEWS["settlement"].replace(f"{_VALUE} * 2 // 100", f"CAST(floor({_VALUE} * 2 / 100.0) AS bigint)")

_NAMES = re.compile(r"\{(\w+)\}")


class Views:
    """The views as DataFrames over one data folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def __getattr__(self, name: str) -> DataFrame:
        if name not in VIEWS:
            raise AttributeError(name)
        return self.spark.sql(VIEWS[name], **{t: self.table(t) for t in set(_NAMES.findall(VIEWS[name]))})


def with_views(sql: str) -> str:
    """The same views in front of a plain SQL query: those that it names."""
    used = [name for name in VIEWS if re.search(rf"\b{name}\b", sql)]
    defined = ", ".join(f"{name} AS ({_NAMES.sub(lambda m: m[1], VIEWS[name])})" for name in used)
    if not defined:
        return sql
    own = sql.strip()
    return f"WITH {defined}, {own[4:].lstrip()}" if own[:5].upper() == "WITH " else f"WITH {defined} {own}"
