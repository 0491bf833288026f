import json
from datetime import datetime

from pyspark.sql import functions as F

from reconlake.sources.feeds import PagedFeed, cash_movements, read_feed, signed_direction
from reconlake.sources.statements import closing_balance, file_kinds, read_dump, read_settlements, read_statements, statement_accounts, statement_lines, wallet_lines
from reconlake.streaming.ingest import current, file_stream, ingest_stream, windowed_counts


def test_statements_by_their_headers(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Banco X\n\nFecha;Glosa;Documento;Ingreso;Egreso;Saldo\n01/02/2024;Uno;7;1.000;;5.000\n02/02/2024;Dos;8;;$300;4.700\nTotal;;;;;\n")
    (tmp_path / "b.csv").write_text("x\n" * 9 + "MONTO;DESCRIPCION;FECHA;SALDO;N DOC;C/A\n1,500;Pago;03-02-2024;9;1;C\n700;Abono;03-02-2024;10;2;A\n")
    (tmp_path / "c.csv").write_text("nothing;here\n")
    rows = read_statements(spark, str(tmp_path)).collect()
    got = sorted((r.layout, str(r.post_date), r.amount, r.memo, r.reference, r.balance_after) for r in rows)
    assert got == [("flagged_amount", "2024-02-03", -1500, "Pago", "1", 9), ("flagged_amount", "2024-02-03", 700, "Abono", "2", 10), ("split_columns", "2024-02-01", 1000, "Uno", "7", 5000), ("split_columns", "2024-02-02", -300, "Dos", "8", 4700)]
    df = read_statements(spark, str(tmp_path))
    closed = closing_balance(df, df.select("file").distinct().withColumn("closing", F.lit(1).cast("long")))
    assert sorted((r.memo, r.balance_after) for r in closed.collect()) == [("Abono", 1), ("Dos", 1), ("Pago", 9), ("Uno", 5000)]


def test_wallet_and_settlements(spark, tmp_path):
    (tmp_path / "w").mkdir()
    (tmp_path / "w" / "w.txt").write_text("Resumen\n05-01-2024 10:20:30 Abono Transferencia recibida 123456789 CLP 1.500 0\n06-01-2024  23:00:01 Cargo Retiro  1234567 CLP 500 -3\n06-01-2024 Cargo x 1 CLP 1 1\n07-01-2024 10:00:00 Abono x 123456 CLP 0 0\n")
    got = wallet_lines(statement_lines(spark, str(tmp_path / "w"))).orderBy("line_no").collect()
    assert [(str(r.post_time), r.amount, r.memo, r.reference, r.second_amount) for r in got] == [("2024-01-05 10:20:30", 1500, "Transferencia recibida", "123456789", 0), ("2024-01-06 23:00:01", -500, "Retiro", "1234567", 3)]
    (tmp_path / "s").mkdir()
    (tmp_path / "s" / "s.csv").write_text("Fecha venta;Monto\nignored;1\nFecha venta;Boleta;Monto venta;Comision;Monto abono\n05 junio;00123;$350.000;1,50;9\n06 junio 2023;124;0;n/a;$80.000\n")
    rows = read_settlements(statement_lines(spark, str(tmp_path / "s")), 2024).orderBy("line_no").collect()
    assert [(str(r.sale_date), r.gross, r.fee, r.receipt) for r in rows] == [("2024-06-05", 350000, 2, "00123"), ("2023-06-06", 80000, 0, "124")]


def test_kinds_accounts_and_dumps(spark, tmp_path):
    for name, body in (("a.pdf", b"%PDF-1.7"), ("b.xlsx", b"PK\x03\x04xx"), ("c.xls", b"\xd0\xcf\x11\xe0x"), ("d.csv", b"x;y\nCta: 001-23 4\n"), ("e.txt", b"z")):
        (tmp_path / name).write_bytes(body)
    kinds = {r.file.rsplit("/", 1)[-1]: r.kind for r in file_kinds(spark, str(tmp_path)).collect()}
    assert kinds == {"a.pdf": "pdf", "b.xlsx": "sheet", "c.xls": "old_sheet", "d.csv": "text", "e.txt": "text"}
    assert [r.account for r in statement_accounts(statement_lines(spark, f"{tmp_path}/*.csv")).collect()] == ["00123"]
    (tmp_path / "dump").mkdir()
    (tmp_path / "dump" / "m.csv").write_text("id,v\n1,x\n")
    (tmp_path / "dump" / "t.json").write_text('[{"id": 2, "v": "y"},\n {"id": 3}]')
    tables = read_dump(spark, str(tmp_path / "dump"), {"m": "id int, v string", "t": "id int, v string"})
    assert sorted(map(tuple, tables["m"].collect())) == [(1, "x")] and sorted(map(str, map(tuple, tables["t"].collect()))) == ["(2, 'y')", "(3, None)"]
    assert cash_movements(spark.createDataFrame([(-5,), (7,)], "monto long")).agg({"monto": "sum"}).first()[0] == 12


def test_feeds(spark, tmp_path):
    (tmp_path / "f").mkdir()
    (tmp_path / "f" / "1.json").write_text(json.dumps([{"id": 1, "monto": -5, "items": [{"nombre": "Venta x", "monto": 1.0}]}, {"monto": 3}]))
    (tmp_path / "f" / "2.json").write_text(json.dumps({"data": [{"id": 2, "monto": 7, "naturaleza": "EGRESO"}]}))
    good, bad = read_feed(spark, str(tmp_path / "f"))
    assert sorted((r.id, r.d) for r in good.select("id", signed_direction("naturaleza", "clase", "monto").alias("d")).collect()) == [(1, "OUT"), (2, "OUT")] and bad.count() == 1
    for cursor, told in (("0", {"has_more": True, "next_after_id": 2}), ("2", {"has_more": True, "next_after_id": 0})):  # the loop ends
        (tmp_path / f"{cursor}.json").write_text(json.dumps({"data": [{"id": int(cursor) + 1, "v": "x"}], "pagination": told}))
    spark.dataSource.register(PagedFeed)
    rows = spark.read.format("paged_feed").schema("id long, v string").option("template", f"{tmp_path}/{{cursor}}.json").option("first", "0").load()
    assert sorted(r.id for r in rows.collect()) == [1, 3]


def test_stream_keeps_the_latest_and_repeats_do_no_harm(spark, tmp_path):
    source, log, progress = tmp_path / "in", str(tmp_path / "log"), str(tmp_path / "progress")
    schema = "k int, v int, at int"
    spark.createDataFrame([(1, 10, 1), (2, 20, 1)], schema).coalesce(1).write.parquet(str(source))
    run = lambda: ingest_stream(file_stream(spark, str(source), spark.createDataFrame([], schema).schema, "*.parquet"), log, progress).awaitTermination()
    run()
    spark.createDataFrame([(1, 11, 2), (3, 30, 1)], schema).coalesce(1).write.mode("append").parquet(str(source))
    run()
    run()
    gone = spark.createDataFrame([(2,)], "k int")
    assert sorted((r.k, r.v) for r in current(spark, log, ["k"], ["at"], gone).collect()) == [(1, 11), (3, 30)]


def test_windows_with_a_watermark(spark, tmp_path):
    rows = [(datetime(2024, 1, 1, 0, m), "a", 1.0) for m in (0, 5, 20)]
    spark.createDataFrame(rows, "ts timestamp, kind string, value double").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = file_stream(spark, str(tmp_path / "in"), spark.read.parquet(str(tmp_path / "in")).schema, "*.parquet")
    q = windowed_counts(stream, "ts", ["kind"], "value").writeStream.outputMode("complete").format("memory").queryName("w").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted((r.window_start.minute, r.n) for r in spark.table("w").collect()) == [(0, 2), (15, 1)]
