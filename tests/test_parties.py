"""Memo clues, entities and the expense run against plain Python."""

import re

from pyspark.sql import functions as F

from reconlake.functions import names
from reconlake.operators.entities import detect, whole_word
from reconlake.plans import catalog
from reconlake.plans.views import Views

SF = "/root/testdata/sf0.001"


def test_memo_clues(spark):
    rows = [
        ("DEP BCI ME SPA Juan Perez", "BCI", None, "ME SPA", None, None, "JUAN PEREZ", "EXCELLENT"), ("GIRO APP 12345, Ana", None, None, None, None, "12345", None, "FAIR"),
        ("deposito en Bco. Chile 12.345.678-9", None, "CHILE", None, "12345678-9", None, None, "FAIR"), ("Ana Rojas MORE GIROS NRO. 778899 MG", None, None, "MG SPA", None, "778899", "ANA ROJAS", "EXCELLENT"),
        ("99", None, None, None, None, None, None, "POOR"), (None, None, None, None, None, None, None, "POOR"), ("DEP MORECAPITAL 76.810.587-K Santnader", "SANTANDER", None, "MORECAPITAL", "76810587-K", None, None, "EXCELLENT"),
        ("ITAU me dijo Luis", None, "ITAU", None, None, None, "DIJO LUIS", "FAIR"), ("DEP ITAU ME Luis Soto", None, "ITAU", "ME SPA", None, None, "LUIS SOTO", "GOOD"), ("MORE CAPITAL pago", "INTERNACIONAL", None, "MORECAPITAL", None, None, "MORE CAPITAL PAGO", "EXCELLENT"),
        ("visita Chile BCI HSBC", "BCI", None, None, None, None, "VISITA", "GOOD"), ("MORE GIRO de Ana, op 4455", None, None, None, None, "4455", "MORE GIRO DE ANA OP", "GOOD"), ("por depositar cuenta bancaria BACO SPA Ana María", None, None, "BACO SPA", None, None, "ANA MARÍA", "GOOD"),
    ]
    df = spark.createDataFrame([(r[0],) for r in rows], "memo string").select("memo", names.memo_clues(F.col("memo")).alias("c")).select("memo", "c.*")
    assert {tuple(r) for r in df.collect()} == set(rows)


def test_names_and_whole_words(spark):
    df = spark.createDataFrame([("0085668013 Transf. ROHDIS TABILO", "Traspaso De: Me Spa", "TRANSF. PARA Vector 77333096-4"), ("Transf.Internet a 76", "Comision", "ab 1234567-8"), ("1234567-8", "traspaso a x", None)], "a string, b string, c string")
    got = df.select(names.name_in_transfer(F.col("a")), names.name_after_transfer_word(F.col("b")), names.name_before_tax_id(F.col("c"))).collect()
    assert [tuple(r) for r in got] == [("ROHDIS TABILO", "Me Spa", "Vector"), ("Internet a 76", None, None), (None, None, None)]
    words = spark.createDataFrame([("Pago a M.G. (x)", "m.g."), ("PagoMG", "MG"), ("a  More   Capital b", "MORE CAPITAL"), ("A+B", "a+b"), ("AAB", "a+b")], "t string, w string")
    assert [r[0] for r in words.select(whole_word(F.col("t"), F.col("w"))).collect()] == [True, False, True, True, False]


def test_evidence_comes_in_order(spark):
    known = spark.createDataFrame([(1, "76815928-9", ["More Capital"]), (2, "99000111-2", ["ME"])], "entity_id int, tax_id string, patterns array<string>")
    rows = [("a", "More Capital", "99.000.111-2", None), ("b", "Internet a 76.815.928-9", None, "ME"), ("c", "x", None, "0768159289 Transf a ME"), ("d", "pago ME sa", None, None), ("e", "MEX", None, None)]
    got = detect(spark.createDataFrame(rows, "bank_id string, counterparty string, counterparty_tax_id string, memo string"), known).collect()
    assert sorted(map(tuple, got)) == [("a", 2, "tax_id"), ("b", 1, "tax_id_in_name"), ("c", 1, "tax_id_in_memo"), ("d", 2, "pattern")]


def test_expense_run_like_one_after_the_other(spark):
    v = Views(spark, SF)
    pool = [b for b in v.ledger_bank.where("direction = 'OUT' AND account_id <> 3").collect()]
    edges = []
    for t in v.ledger.where("direction = 'OUT'").collect():
        words = [w for w in re.split("[^A-Z0-9]+", t.memo.upper()) if len(w) >= 4 and not w.isdigit() and w not in names.EXPENSE_WORDS]
        for b in pool:
            days = abs((b.post_date - t.doc_date).days)
            if abs(b.amount) == abs(t.amount) and days <= 7:
                score = 30 + {0: 25, 1: 18, 2: 12, 3: 8}.get(days, 4) + 25 * any(w in (b.counterparty or "").upper() for w in words)
                edges.append((-score, days, t.treasury_id, b.bank_id))
    used, want = set(), []
    for s, _, t, b in sorted(edges):
        if t not in used and b not in used:
            used |= {t, b}
            want.append((t, b, -s, "AUTO" if -s >= 50 else "SUGGESTED"))
    got = catalog.queries()["E09_expense_run"](spark, SF).collect()
    assert sorted(map(tuple, got)) == sorted(want) and len(want) > 50
