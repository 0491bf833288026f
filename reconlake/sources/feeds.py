"""JSON feeds: whole envelopes, and pages with a cursor as a data source."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

TREASURY_SCHEMA = "id bigint, monto bigint, fecha string, glosa string, naturaleza string, clase string, items array<struct<nombre:string,cantidad:double,precioUnitario:double,monto:double>>"


def read_feed(spark: SparkSession, path: str, schema: str = TREASURY_SCHEMA) -> tuple[DataFrame, DataFrame]:
    """Valid rows and rejected ones of JSON files that hold `[...]` or `{"data": [...]}`; a row needs an id."""
    texts = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    bare = F.when(F.trim("value").startswith("["), F.col("value")).otherwise(F.get_json_object("value", "$.data"))
    rows = texts.select("file", F.explode(F.from_json(bare, "array<string>")).alias("raw"))
    parsed = rows.select("file", "raw", F.from_json("raw", schema).alias("row"))
    fine = F.col("row.id").isNotNull()
    return parsed.where(fine).select("file", "row.*"), parsed.where(~fine).select("file", "raw")


def signed_direction(nature: str, kind: str, amount: str) -> Column:
    """IN or OUT of a feed row: its nature if given, else its class, else the sign of its amount."""
    given = F.upper(F.coalesce(F.col(nature), F.col(kind), F.lit("")))
    return F.when(given.isin("EGRESO", "OUT"), "OUT").when(given.isin("INGRESO", "IN"), "IN").otherwise(F.when(F.col(amount) < 0, "OUT").otherwise("IN"))


class _Page(InputPartition):
    def __init__(self, path: str):
        self.path = path


#: How much of a page the driver reads at a time while it looks for the cursor, and how much of it it keeps.
PEEK_BYTES = 1 << 14
_PAGING = re.compile(rb'"pagination"\s*:\s*(\{[^{}]*\})')


class _Pages:
    """Pages are documents under a path or URI that Arrow's file systems know, named by their cursor."""

    def __init__(self, options: dict, schema):
        self.first, self.template, self.names = options["first"], options["template"], schema.fieldNames()

    def _open(self, cursor: str):
        from pyarrow import fs

        files, own = fs.FileSystem.from_uri(self.template.format(cursor=cursor))
        return files.open_input_file(own) if files.get_file_info(own).type == fs.FileType.File else None

    def next_of(self, cursor: str) -> tuple[bool, str | None]:
        """Is there a page, and where does the next one begin? Its end is looked at first, then the rest piece by piece; no row is parsed."""
        page = self._open(cursor)
        if page is None:
            return False, None
        with page:
            size = page.size()
            found, at, kept = _PAGING.search(page.read_at(min(size, PEEK_BYTES), max(0, size - PEEK_BYTES))), 0, b""
            while found is None and at < size:
                kept = kept[-PEEK_BYTES:] + page.read_at(PEEK_BYTES, at)
                found, at = _PAGING.search(kept), at + PEEK_BYTES
        told = json.loads(found[1]) if found else {}
        after = told.get("next_after_id")
        return True, str(after) if after is not None else None

    def walk(self, cursor: str, until: str | None = None):
        """(cursor, next cursor) of the pages that are there, up to the page `until`; a circle ends it."""
        seen = set()
        while cursor not in seen and cursor != until:
            seen.add(cursor)
            there, after = self.next_of(cursor)
            if not there:
                return
            yield cursor, after
            if after is None:
                return
            cursor = after

    def read(self, partition: _Page):
        """Runs in a task."""
        with self._open(partition.path) as page:
            for row in json.loads(page.readall())["data"]:
                yield tuple(row.get(n) for n in self.names)


class _PageReader(_Pages, DataSourceReader):
    """Follows the cursors once to list the pages; each page is a partition, read by whichever task gets it."""

    def partitions(self) -> list[InputPartition]:
        return [_Page(cursor) for cursor, _ in self.walk(self.first)]


class _PageStream(_Pages, DataSourceStreamReader):
    """The offset is the cursor of the first page that hasn't been read; `past` that of a last page that names no next one.

    The driver holds cursors only. The checkpoint keeps the offset, so a restarted query goes on where it was.
    """

    def initialOffset(self) -> dict:
        return {"cursor": self.first, "past": None}

    def latestOffset(self) -> dict:
        at = getattr(self, "at", None) or self.initialOffset()
        seen = set()
        for cursor, after in [] if at["past"] else self.walk(at["cursor"]):
            seen.add(cursor)
            ends = after is None or after in seen
            at = {"cursor": cursor if ends else after, "past": cursor if ends else None}
        self.at = at
        return at

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        if start["past"] is not None:
            return []
        self.at = end
        until = None if end["past"] else end["cursor"]
        return [_Page(cursor) for cursor, _ in self.walk(start["cursor"], until)]

    def commit(self, end: dict) -> None:
        self.at = end


class PagedFeed(DataSource):
    """`spark.read.format("paged_feed")`, or `spark.readStream`: `.schema(...).option("template", "/pages/{cursor}.json").option("first", "0")`."""

    @classmethod
    def name(cls) -> str:
        return "paged_feed"

    def reader(self, schema) -> DataSourceReader:
        return _PageReader(self.options, schema)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _PageStream(self.options, schema)


def cash_movements(rows: DataFrame, amount: str = "monto") -> DataFrame:
    """Rows of the cash feed, whose amounts are sizes: the sign goes."""
    return rows.withColumn(amount, F.abs(F.col(amount)))
