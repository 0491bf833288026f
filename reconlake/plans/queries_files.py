"""Statements written as workbooks of every layout and read back."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from reconlake.plans.catalog import query
from reconlake.sources.sheets import workbook_bytes
from reconlake.sources.workbooks import LAYOUTS, read_workbooks

#: Header lines for the layouts that are known by their headers.
_HEADERS = {
    "BCI_DETALLADO": ["Fecha de transacción", "Hora transacción", "Fecha contable", "Código de transacción", "Código Transferencia", "Tipo de transacción", "Numero serie", "Glosa detalle", "Ingreso (+)", "Egreso (-)", "Saldo contable"],
    "CHILE_MOVIMIENTOS": ["Fecha", "Detalle Movimiento", "Cheque o Cargo", "Deposito o Abono", "Saldo", "Docto. Nro.", "Trn", "Caja", "Sucursal"],
    "CHILE_CARTOLA": ["Fecha", "Descripcion", "Canal o Sucursal", "Nro. Docto.", "Cargos (CLP)", "Abonos (CLP)", "Saldo (CLP)"],
}
_CARTOLA = {"day": 0, "memo": 1, "reference": 3, "paid_out": 4, "paid_in": 5, "balance": 6}


def _workbook(name: str, rows: pd.DataFrame) -> bytes:
    """The rows (post_date, amount, memo, reference, balance_after) as a workbook of the layout."""
    layout = LAYOUTS[name]
    places = _CARTOLA if name == "CHILE_CARTOLA" else layout.places
    top: list[list] = [[] for _ in range({"BCI_DETALLADO": 2, "CHILE_MOVIMIENTOS": 1, "CHILE_CARTOLA": 12}.get(name) or layout.header)]
    if layout.title:
        top[0] = [layout.title]
    if name == "CHILE_MOVIMIENTOS":
        top[0] = ["ME SPA (77333096-4) cta:000051541406"]
    if name == "CHILE_CARTOLA":
        top[8], top[10] = [None, "Nombre Empresa:", None, "ME SPA"], [None, "Cuenta N°:", None, "00-005-15414-06"]
    lines = []
    for r in rows.itertuples():
        size, paid_in = abs(int(r.amount)), r.amount >= 0
        own = {"day": r.post_date, "memo": r.memo, "reference": r.reference, "balance": None if pd.isna(r.balance_after) else int(r.balance_after), "amount": size, "flag": "A" if paid_in else "C"}
        own |= {"paid_in": size if paid_in else None, "paid_out": None if paid_in else size}
        cells = [None] * (1 + max(places.values()))
        for role, place in places.items():
            cells[place] = own.get(role)
        lines.append(cells)
    return workbook_bytes({layout.sheet or "Hoja1": [*top, _HEADERS.get(name, ["header"]), *lines]})


@query("A05_statement_workbooks", """
    WITH n AS (SELECT *, CAST(account_id % 9 AS integer) AS k FROM bank)
    SELECT CAST(account_id AS string) || '/' || substr(CAST(post_date AS string), 1, 7) AS file, list_extract(['BCI_DETALLADO', 'SANTANDER_HISTORICA', 'SANTANDER_PROVISORIA', 'SANTANDER_MOVIMIENTO', 'INTERNACIONAL_HISTORICA', 'INTERNACIONAL_PROVISORIA', 'INTERNACIONAL_MENSUAL', 'CHILE_MOVIMIENTOS', 'CHILE_CARTOLA'], k + 1) AS layout,
      post_date, amount, direction, memo, CASE WHEN k NOT IN (1, 2) THEN balance_after END AS balance_after, CASE WHEN k = 0 OR order_id <> 0 THEN CAST(order_id AS string) END AS reference FROM n""", dates=("post_date",))
def statement_workbooks(v):
    """Bank rows as a workbook for each account and month, accounts by turns in the nine layouts, and what is read from them."""
    names = list(LAYOUTS)

    def made(key, rows):
        return pd.DataFrame({"path": [f"{key[0]}/{key[1]}"], "content": [_workbook(names[int(key[0]) % len(names)], rows)]})

    rows = v.bank.select("account_id", F.substring(F.col("post_date").cast("string"), 1, 7).alias("month"), "post_date", "amount", "memo", F.col("order_id").cast("string").alias("reference"), "balance_after")
    files = rows.groupBy("account_id", "month").applyInPandas(made, "path string, content binary")
    return read_workbooks(files).movements.select("file", "layout", "post_date", "amount", "direction", "memo", "balance_after", "reference")
