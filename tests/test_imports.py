import json
from collections import Counter

import pytest

from reconlake.sources.feeds import PagedFeed, _PageStream
from reconlake.streaming.imports import import_files, import_preview, imported


def test_files_count_by_their_content(spark, tmp_path):
    def parsed(files):
        return files.selectExpr("file_hash", "explode(split(decode(content, 'utf-8'), '\n')) AS line").where("line <> ''").selectExpr("file_hash", "from_csv(line, 'k string, a string, b int') AS r").select("file_hash", "r.*")

    folder, log = tmp_path / "in", str(tmp_path / "log")
    folder.mkdir()
    run = lambda: import_files(spark, str(folder), log, str(tmp_path / "progress"), parsed).awaitTermination()
    (folder / "one.csv").write_text("x,,1\ny,Y,\n")
    (folder / "same.csv").write_text("x,,1\ny,Y,\n")
    run()
    rows = lambda: sorted((r.k, r.a, r.b, r.first_import, r.discarded) for r in imported(spark, log, "k", spark.createDataFrame([("z",)], "k string")).collect())
    assert rows() == [("x", None, 1, 0, False), ("y", "Y", None, 0, False)] and spark.read.parquet(f"{log}/rows").count() == 2
    (folder / "renamed.csv").write_text("x,,1\ny,Y,\n")
    run()
    assert spark.read.parquet(f"{log}/rows").count() == 2
    # an enlarged file adds its new row and fills what was missing; what was there stays
    (folder / "larger.csv").write_text("x,X,9\ny,other,2\nz,Z,3\n")
    run()
    assert rows() == [("x", "X", 1, 0, False), ("y", "Y", 2, 0, False), ("z", "Z", 3, 2, True)]
    assert spark.read.parquet(f"{log}/files").count() == 2


def test_preview(spark):
    kind = "id int, account_id int, dedup_key string, counterparty string, memo string"
    rows = [(1, 1, "a", None, None), (2, 2, "a", None, None), (3, 1, "b", "Fondo MOTALE spa", None), (4, 1, "c", None, "x"), (5, 1, None, "motale", None), (6, 2, "d", None, "pago uno"), (7, 1, "e", None, "pago uno")]
    present, gone = spark.createDataFrame([(1, "a")], "account_id int, dedup_key string"), spark.createDataFrame([(1, "c"), (1, "a")], "account_id int, dedup_key string")
    got = import_preview(spark.createDataFrame(rows, kind), present, gone, [(2, "PAGO"), (None, " motale "), (None, " ")]).orderBy("id").collect()
    assert [(r.status, r.pattern, r.discarded) for r in got] == [("DUPLICATE", None, False), ("NEW", None, False), ("NEW", "motale", True), ("NEW", None, True), ("ERROR", None, False), ("NEW", "PAGO", True), ("NEW", None, False)]


def page(folder, cursor, ids, after, more=False, tail=""):
    body = {"data": [{"id": i, "v": f"row {i} \"pagination\" {tail}"} for i in ids], "pagination": {"has_more": more, "next_after_id": after}}
    (folder / f"{cursor}.json").write_text(json.dumps(body))


def test_feed_goes_on_at_its_cursor(spark, tmp_path):
    pages = tmp_path / "pages"
    pages.mkdir()
    page(pages, 0, range(1, 4), 3, True)
    page(pages, 3, range(4, 6), 5)
    spark.dataSource.register(PagedFeed)

    def run():
        feed = spark.readStream.format("paged_feed").schema("id long, v string").option("template", f"{pages}/{{cursor}}.json").option("first", "0").load()
        feed.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
        return Counter(r.id for r in spark.read.schema("id long, v string").parquet(str(tmp_path / "out")).collect())

    assert run() == Counter(range(1, 6))
    page(pages, 5, range(6, 9), 8, True)
    page(pages, 8, [9], None)
    assert run() == Counter(range(1, 10))
    assert run() == Counter(range(1, 10))
    batch = spark.read.format("paged_feed").schema("id long, v string").option("template", f"{pages}/{{cursor}}.json").option("first", "0").load()
    assert sorted(r.id for r in batch.collect()) == list(range(1, 10))


@pytest.mark.parametrize("first", [True, False])
def test_the_cursor_of_a_large_page_is_found_without_its_rows(spark, tmp_path, first):
    rows = json.dumps([{"id": i, "v": "x" * 100} for i in range(3000)])
    told = '"pagination": {"has_more": false, "next_after_id": 77}'
    (tmp_path / "0.json").write_text(f'{{{told}, "data": {rows}}}' if first else f'{{"data": {rows}, {told}, "more": "{"y" * 60_000}"}}')
    schema = spark.createDataFrame([], "id long").schema
    stream = _PageStream({"first": "0", "template": f"{tmp_path}/{{cursor}}.json"}, schema)
    assert stream.next_of("0") == (True, "77") and stream.next_of("77") == (False, None)
    assert stream.latestOffset() == {"cursor": "77", "past": None}


def test_a_circle_of_cursors_ends(spark, tmp_path):
    page(tmp_path, 0, [1], 1, True)
    page(tmp_path, 1, [2], 0, True)
    stream = _PageStream({"first": "0", "template": f"{tmp_path}/{{cursor}}.json"}, spark.createDataFrame([], "id long").schema)
    end = stream.latestOffset()
    assert [p.path for p in stream.partitions(stream.initialOffset(), end)] == ["0", "1"] and stream.partitions(end, stream.latestOffset()) == []
