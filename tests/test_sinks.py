from pyspark.sql import functions as F

from reconlake.operators.dedup import reassigned
from reconlake.operators.routing import capped_status, memo_route
from reconlake.sources.sinks import dump_tables, insert_new, journal_sheets, restore_tables, unique_names, upserted, write_matrix, write_report, write_sheets


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_upsert_last_write_wins_and_keeps_columns(spark):
    present = spark.createDataFrame([(1, "old", "linked"), (2, "old", None), (None, "old", "x")], "id int, name string, link string")
    incoming = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (3, "c", 1), (None, "d", 1)], "id int, name string, at int")
    got = rows(upserted(present, incoming, ["id"], ["at"], kept=["link"]))
    assert got == sorted([(1, "b", "linked"), (2, "old", None), (3, "c", None), (None, "d", "x")], key=str)
    assert rows(upserted(present.limit(0), incoming.limit(0), ["id"], ["at"])) == []


def test_insert_ignores_present_and_repeated_keys(spark):
    present = spark.createDataFrame([(1, "old")], "id int, name string")
    incoming = spark.createDataFrame([(1, "new"), (2, "b"), (2, "a")], "id int, name string")
    assert rows(insert_new(present, incoming, ["id"])) == [(1, "old"), (2, "a")]


def test_sheets_matrix_and_dump_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(i, i % 3, f"x{i}", None if i % 2 else i * 10) for i in range(20)], "id long, branch int, name string, amount long")
    write_sheets(df, f"{tmp_path}/sheets", "branch", ["id"])
    back = spark.read.option("header", True).schema("id long, name string, amount long").csv(f"{tmp_path}/sheets")
    assert rows(back.select("id", F.col("branch").cast("int"), "name", "amount")) == rows(df)
    write_matrix(df.groupBy("branch").agg(F.count("*").alias("n")), f"{tmp_path}/matrix")
    assert spark.read.option("header", True).csv(f"{tmp_path}/matrix").count() == 3
    schemas = dump_tables({"a": df, "none": df.limit(0)}, f"{tmp_path}/dump")
    again = restore_tables(spark, f"{tmp_path}/dump", schemas)
    assert rows(again["a"]) == rows(df) and again["none"].count() == 0


def test_journal_sheets_and_reports(spark, tmp_path):
    lines = spark.createDataFrame([(1, 200, 50, 0, "bank", 1), (1, 100, 0, 50, "branch", 2), (2, 17, 0, 9, "x", 1)], "entry int, code long, debit long, credit long, detail string, n int")
    cells = {(r.entry, r.row_no): r for r in journal_sheets(lines, ["entry"], ["n"], F.lit("2024-01-31").cast("date"), F.concat(F.lit("Entry "), F.col("entry"))).collect()}
    assert {k for k in cells if k[0] == 1} == {(1, r) for r in (1, 2, 4, 10, 11, 12)} and {k for k in cells if k[0] == 2} == {(2, r) for r in (1, 2, 4, 10, 11)}
    assert (cells[1, 2].C, cells[1, 4].E, cells[1, 10].G, cells[1, 1].J) == ("45322", "Entry 1", "Debe ME", "10")
    assert tuple(cells[1, 12])[2:] == ("2", "100", "0", "branch", None, "1", "0", "50", "0", "50")
    named = unique_names(spark.createDataFrame([(1, "a"), (2, "a"), (3, "a" * 40), (4, "a" * 35)], "id int, name string"), "name", ["id"])
    assert [r.sheet for r in named.orderBy("id").collect()] == ["a", "a (2)", "a" * 31, "a" * 27 + " (2)"]
    write_report(lines.groupBy("entry").agg(F.sum("debit").alias("debit")), lines, f"{tmp_path}/report")
    assert spark.read.option("header", True).csv(f"{tmp_path}/report/detail").count() == 3 and spark.read.option("header", True).csv(f"{tmp_path}/report/summary").count() == 2


def test_reassign_and_rules(spark):
    df = spark.createDataFrame([(1, 9, "k"), (2, 9, "l"), (3, 8, "k")], "id int, account int, key string")
    assert rows(reassigned(df, "account", 9, 8, ["key"]).select("id", "account")) == [(2, 8)]
    seen = spark.createDataFrame([("Giro 1", None, "AUTO", None), (None, None, "AUTO", True)], "memo string, party string, status string, odd boolean")
    got = seen.select(memo_route(F.col("memo"), F.col("party"), [("GIRO", 5, "x"), ("giro", 7, None)]), capped_status(F.col("status"), F.col("odd"), F.lit(None).cast("boolean")))
    assert rows(got) == sorted([(7, "AUTO"), (None, "SUGGESTED")], key=str)
