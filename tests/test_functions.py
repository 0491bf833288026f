from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from reconlake.functions import amounts, dates, names


def one(spark, value, kind, build):
    return spark.createDataFrame([(value,)], f"x {kind}").select(build(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize(("text", "value"), [("$213,600", 213600), ("-47,600", -47600), ("1.979.839", 1979839), ("2.300.000,00", 2300000), ("", None), (None, None), ("(1.200)", -1200), ("12,5", 12), ("1,234", 1234), ("abc", None), ("1,234.56", 1234), ("+7", 7)])
def test_parse_amount(spark, text, value):
    assert one(spark, text, "string", amounts.parse_amount) == value


@pytest.mark.parametrize(("text", "value"), [("$350.000", 350000), ("$350,000", 350000), ("n/a", 0), ("12,50", 13), (None, 0), ("-1.000", -1000)])
def test_parse_gross(spark, text, value):
    assert one(spark, text, "string", amounts.parse_gross) == value


def test_gross_up(spark):
    assert one(spark, 100000, "long", lambda x: F.struct(*amounts.gross_up(x, 1525))) == (117994, 17994)


@pytest.mark.parametrize(("text", "value"), [("2024-03-05T10:00", date(2024, 3, 5)), ("5/3/24", date(2024, 3, 5)), ("05-03-2024", date(2024, 3, 5)), ("31/02/2024", None), ("x", None)])
def test_parse_date(spark, text, value):
    assert one(spark, text, "string", dates.parse_date) == value


@pytest.mark.parametrize(("text", "value"), [("05 junio 2026", date(2026, 6, 5)), ("08 Setiembre", date(2025, 9, 8)), ("05/06/2026", date(2026, 6, 5)), ("05 foo 2026", None), ("n/a", None)])
def test_spanish_date(spark, text, value):
    assert one(spark, text, "string", lambda x: dates.parse_spanish_date(x, 2025)) == value


def test_with_time_aging_and_serial(spark):
    day = date(2024, 1, 31)
    assert one(spark, day, "date", lambda x: dates.with_time(x, F.lit("9:05"))) == datetime(2024, 1, 31, 9, 5)
    assert [one(spark, n, "int", lambda x: dates.aging_bucket(F.date_sub(F.lit(day), x), F.lit(day))) for n in (-3, 7, 8, 30, 31, 60, 61)] == ["0-7", "0-7", "8-30", "8-30", "31-60", "31-60", "60+"]
    assert one(spark, date(1970, 1, 1), "date", dates.sheet_serial) == 25569


@pytest.mark.parametrize(("memo", "number"), [("OP3958", "3958"), ("VTA. TBK. DBTO. OP. 3922", "3922"), ("GIRO 13370 N OPE 3932", "3932"), ("NO 003919", "3919"), ("sin numero", None), ("pago 77", "77")])
def test_operation_number(spark, memo, number):
    assert one(spark, memo, "string", names.operation_number) == number


@pytest.mark.parametrize(("memo", "found"), [("N OPE 4047/4048", [4047, 4048]), ("OP.0515-516", [515, 516]), ("515-518", [515, 516, 517, 518]), ("518-515", [518, 515]), ("29-05-26", None), ("400/400", None), (None, None)])
def test_receipts(spark, memo, found):
    assert one(spark, memo, "string", names.receipt_list) == found


@pytest.mark.parametrize(("text", "found"), [("pago 12.345.678-k hoy", "12345678K"), ("0768159289 Transf a X", "0768159289"), ("nada", ""), ("x 123456789 y", "123456789"), (None, "")])
def test_tax_id_in(spark, text, found):
    assert one(spark, text, "string", names.tax_id_in) == found


def test_names_and_memos(spark):
    assert one(spark, "12.345.678k", "string", names.dashed_tax_id) == "12345678-K"
    assert one(spark, "acme", "string", names.dashed_tax_id) == "acme"
    assert one(spark, "Peña y Cía 123 Ltda", "string", lambda x: names.tokens(x, 3, ("LTDA",))) == ["PENA", "CIA"]
    assert one(spark, "DEP (2) 1 x", "string", names.memo_parts) == (True, 2) and one(spark, "DEP 1166751 SANT", "string", names.memo_parts) == (False, None)
    same = lambda a, b: one(spark, a, "string", lambda x: names.same_tax_id(x, F.lit(b)))
    assert same("0768159289", "76815928-9") and same("76815928", "76815928-9") and not same("7681", "76815928-9") and not same("", "")
    agree = lambda a, b, i=None, j=None: one(spark, a, "string", lambda x: names.names_agree(x, F.lit(i), F.lit(b), F.lit(j)))
    assert agree("Juan Perez Soto", "PEREZ SOTO MARIA JUAN") and agree("", "x") and not agree("Ana Rojas", "Luis Diaz") and not agree("Ana", "Ana", "1-9", "2-7")
