"""Bank statements and settlement reports: delimited text with a header somewhere near the top."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from reconlake.functions.amounts import parse_amount, parse_gross
from reconlake.functions.dates import parse_date, parse_spanish_date


@dataclass(frozen=True)
class Layout:
    """Where a kind of statement keeps things: labels of its header, as they stand there.

    Either `amount` (signed, or with `flag` saying which way: its `out_flag` means out), or `paid_in` and `paid_out`.
    `last_header` takes the last line that looks like the header instead of the first.
    """

    day: str
    memo: str
    amount: str | None = None
    paid_in: str | None = None
    paid_out: str | None = None
    flag: str | None = None
    out_flag: str = "C"
    balance: str | None = None
    reference: str | None = None
    scan_lines: int = 30
    separator: str = ";"
    last_header: bool = False
    labels: tuple[str, ...] = field(default=(), compare=False)

    @property
    def needed(self) -> list[str]:
        return [x for x in (self.day, self.memo, self.amount, self.paid_in, self.paid_out) if x]


#: The layouts, in the order in which they are tried.
LAYOUTS: dict[str, Layout] = {
    "split_columns": Layout("Fecha", "Glosa", paid_in="Ingreso", paid_out="Egreso", balance="Saldo", reference="Documento", scan_lines=5),
    "flagged_amount": Layout("FECHA", "DESCRIPCION", amount="MONTO", flag="C/A", balance="SALDO", reference="N DOC", scan_lines=12),
    "debit_credit": Layout("Fecha", "Detalle", paid_in="Abono", paid_out="Cargo", balance="Saldo", scan_lines=17),
    "signed_amount": Layout("Fecha", "Descripcion", amount="Monto", balance="Saldo"),
}


def statement_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_no, line) of text files; a file is read whole, so its lines keep their order."""
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.split("value", "\r?\n").alias("lines"))
    return whole.select("file", F.posexplode("lines").alias("line_no", "line"))


def _cells(line: Column, separator: str) -> Column:
    return F.transform(F.split(line, f"[{separator}]"), lambda c: F.trim(c))


def read_statement(lines: DataFrame, layout: Layout) -> DataFrame:
    """Movements of all files whose header the layout knows: file, line_no, post_date, amount, memo, reference, balance_after.

    Amounts are signed, in positive. Lines without a date, or with no amount or one of nothing, are left out. A file whose header isn't
    found within `scan_lines` gives nothing.
    """
    rows = lines.withColumn("cells", _cells(F.col("line"), layout.separator))
    is_header = F.lit(True)
    for label in layout.needed:
        is_header = is_header & F.array_contains("cells", label)
    place = F.col("line_no") if not layout.last_header else -F.col("line_no")
    heads = rows.where((F.col("line_no") < layout.scan_lines) & is_header).groupBy("file").agg(F.min_by("cells", place).alias("header"), F.min_by("line_no", place).alias("header_line"))
    rows = rows.join(heads, "file").where("line_no > header_line")

    def cell(label: str | None) -> Column:
        if label is None:
            return F.lit(None).cast("string")
        at = F.array_position("header", label)
        return F.when(at > 0, F.try_element_at("cells", at.cast("int")))

    if layout.amount:
        value = parse_amount(cell(layout.amount))
        amount = F.when(cell(layout.flag) == layout.out_flag, -F.abs(value)).otherwise(value) if layout.flag else value
    else:
        amount = F.coalesce(parse_amount(cell(layout.paid_in)), F.lit(0)) - F.abs(F.coalesce(parse_amount(cell(layout.paid_out)), F.lit(0)))
    made = rows.select("file", "line_no", parse_date(cell(layout.day)).alias("post_date"), amount.alias("amount"), cell(layout.memo).alias("memo"), cell(layout.reference).alias("reference"), parse_amount(cell(layout.balance)).alias("balance_after"))
    return made.where("post_date IS NOT NULL AND amount IS NOT NULL AND amount <> 0")


def read_statements(spark: SparkSession, path: str, layouts: dict[str, Layout] | None = None) -> DataFrame:
    """Movements of all files, each under the first layout that fits it, with the layout's name."""
    lines = statement_lines(spark, path)
    parts = [read_statement(lines, layout).withColumn("layout", F.lit(name)).withColumn("_try", F.lit(i)) for i, (name, layout) in enumerate((layouts or LAYOUTS).items())]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    first = out.groupBy("file").agg(F.min("_try").alias("_first"))
    return out.join(first, "file").where("_try = _first").drop("_try", "_first")


def closing_balance(movements: DataFrame, closing: DataFrame) -> DataFrame:
    """Put a file's closing balance on its latest movement (of one day the last line)."""
    latest = Window.partitionBy("file").orderBy(F.desc("post_date"), F.desc("line_no"))
    ranked = movements.withColumn("_n", F.row_number().over(latest)).join(closing.select("file", "closing"), "file", "left")
    return ranked.withColumn("balance_after", F.when(F.col("_n") == 1, F.coalesce("closing", "balance_after")).otherwise(F.col("balance_after"))).drop("_n", "closing")


#: Fixed value: a wallet's line: day, clock, word, what it was, number, CLP, amount, second amount.
WALLET_LINE = r"(?i)^(\d{2}-\d{2}-\d{4})\s+(\d{2}:\d{2}:\d{2})\s+(Abono|Cargo)\s+(.+?)\s+(\d{6,})\s+CLP\s+(-?[\d.,]+)\s+(-?[\d.,]+)\s*$"


def wallet_lines(lines: DataFrame) -> DataFrame:
    """Movements of a wallet's text export, one line each; the word gives the sign. Lines without a day or amount are left out."""
    part = lambda i: F.regexp_extract("line", WALLET_LINE, i)
    size = F.abs(parse_amount(part(6)))
    day = parse_date(part(1))
    made = lines.where(F.col("line").rlike(WALLET_LINE)).select(
        "file", "line_no", day.alias("post_date"), F.to_timestamp(F.concat_ws(" ", day.cast("string"), part(2))).alias("post_time"), F.when(F.lower(part(3)) == "cargo", -size).otherwise(size).alias("amount"),
        part(4).alias("memo"), part(5).alias("reference"), F.abs(parse_amount(part(7))).alias("second_amount"),
    )
    return made.where("post_date IS NOT NULL AND amount IS NOT NULL AND amount <> 0")


#: How files of a kind begin.
MAGIC = {"pdf": b"%PDF", "sheet": b"PK\x03\x04", "old_sheet": b"\xd0\xcf\x11\xe0"}


def file_kinds(spark: SparkSession, path: str) -> DataFrame:
    """(file, kind) by the first bytes: pdf, sheet, old_sheet, else text. Empty files are not listed."""
    head = F.substring("content", 1, 4)
    kind = F.lit("text")
    for name, mark in MAGIC.items():
        kind = F.when(head == F.lit(mark), name).otherwise(kind)
    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), kind.alias("kind"))


def statement_accounts(lines: DataFrame, scan_lines: int = 30) -> DataFrame:
    """(file, account): the digits after `cta:` in the first lines, from the first line that has them."""
    pattern = r"(?i)\bcta\s*[:.]\s*([0-9-]+)"
    told = lines.where((F.col("line_no") < scan_lines) & F.col("line").rlike(pattern))
    return told.groupBy("file").agg(F.min_by(F.regexp_replace(F.regexp_extract("line", pattern, 1), "[^0-9]", ""), "line_no").alias("account"))


def read_dump(spark: SparkSession, folder: str, schemas: dict[str, str]) -> dict[str, DataFrame]:
    """Tables of a dump: `<name>.csv` with a header or `<name>.json` of one JSON array, under the given schemas."""
    known = {r.file.rsplit("/", 1)[-1]: r.file for r in spark.read.format("binaryFile").load(folder).select(F.col("path").alias("file")).collect()}
    read = lambda name, schema: spark.read.schema(schema).option("multiLine", True).json(known[f"{name}.json"]) if f"{name}.json" in known else spark.read.schema(schema).option("header", True).csv(known[f"{name}.csv"])
    return {name: read(name, schema) for name, schema in schemas.items()}


def read_settlements(lines: DataFrame, year: int, separator: str = ";") -> DataFrame:
    """Rows of a card settlement report: columns by parts of their labels; credit rows take a second gross where the first is 0."""
    rows = lines.withColumn("cells", _cells(F.col("line"), separator))
    has = lambda part: F.exists("cells", lambda c: F.lower(c).contains(part))
    heads = rows.where(has("fecha venta") & has("monto")).groupBy("file").agg(F.max_by("cells", "line_no").alias("header"), F.max("line_no").alias("header_line"))
    rows = rows.join(heads, "file").where("line_no > header_line")

    def cell(part: str, nth: int = 1) -> Column:
        places = F.filter(F.transform("header", lambda c, i: F.when(F.lower(c).contains(part), i + 1)), lambda p: p.isNotNull())
        return F.try_element_at("cells", F.coalesce(F.try_element_at(places, F.lit(nth)), F.lit(1_000_000)))

    gross = F.coalesce(F.nullif(parse_gross(cell("monto")), F.lit(0).cast("long")), parse_gross(cell("monto", 2)))
    made = rows.select("file", "line_no", parse_spanish_date(cell("fecha venta"), year).alias("sale_date"), gross.alias("gross"), parse_gross(cell("comisi")).alias("fee"), cell("boleta").alias("receipt"))
    return made.where("sale_date IS NOT NULL")
