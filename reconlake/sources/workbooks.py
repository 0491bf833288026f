"""Bank statements as workbooks: nine layouts in the order in which they are tried, read by places and labels."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reconlake.functions.amounts import parse_amount
from reconlake.functions.dates import MONTHS, parse_date, with_time
from reconlake.functions.names import account_digits, dashed_tax_id, name_after_transfer_word, name_before_tax_id, name_in_transfer
from reconlake.sources.sheets import workbook_rows
from reconlake.sources.statements import closing_balance


@dataclass(frozen=True)
class Layout:
    """How a kind of workbook is known and where it keeps things.

    `sheet` (None: the first) and a text in its first cell, `title`; `header` is the header's row or the name of a fact that
    says which (`_facts`). `places` are columns by role, or labels of the header. `way` says what amounts look like: `flag`
    (signed, with A or C beside), `first` (paid in, else paid out) or `larger` (either column; of two the larger).
    """

    bank: str
    way: str
    header: int | str
    places: dict[str, int | tuple[str, ...]]
    sheet: str | None = None
    title: str | None = None
    period_row: int | None = None
    name: str | None = None
    ends: bool = field(default=False)


_FLAGGED = {"amount": 0, "memo": 1, "day": 3, "reference": 4, "branch": 5, "flag": 7}
_TWO = {"day": 0, "memo": 1, "reference": 2, "paid_out": 3, "paid_in": 4, "balance": 5}
#: sheets' names, titles and places of the layouts, in their order.
LAYOUTS: dict[str, Layout] = {
    "BCI_DETALLADO": Layout("BCI", "first", "detailed_header", {"done_day": 0, "clock": 1, "day": 2, "reference": 4, "kind": 5, "memo": 7, "paid_in": 8, "paid_out": 9, "balance": 10, "party": 11, "party_tax_id": 12, "party_account": 13, "party_bank": 15}),
    "SANTANDER_HISTORICA": Layout("SANTANDER", "flag", 15, _FLAGGED, "Cartola Historica CtaCte", period_row=7, name="code", ends=True),
    "SANTANDER_PROVISORIA": Layout("SANTANDER", "flag", 12, _FLAGGED, "CartolaProvisoria", "cartola provisoria", period_row=7, name="code", ends=True),
    "SANTANDER_MOVIMIENTO": Layout("SANTANDER", "flag", 11, {"amount": 0, "memo": 1, "day": 2, "balance": 3, "reference": 4, "branch": 5, "flag": 6}, "Movimientos CtaCte", "consulta de movimientos", period_row=10, name="code"),
    "INTERNACIONAL_HISTORICA": Layout("INTERNACIONAL", "larger", 16, _TWO, "Cartola Historica", "cartola historica", name="before_id"),
    "INTERNACIONAL_PROVISORIA": Layout("INTERNACIONAL", "larger", 16, _TWO, "Movimientos entre Fechas", "movimientos entre fechas", name="before_id"),
    "INTERNACIONAL_MENSUAL": Layout("INTERNACIONAL", "larger", 16, _TWO, "Movimientos del Mes", "movimientos del mes", name="before_id"),
    "CHILE_MOVIMIENTOS": Layout("CHILE", "larger", "second_header", {"day": 0, "memo": 1, "paid_out": 2, "paid_in": 3, "balance": 4, "reference": 5, "branch": 8}, name="word"),
    "CHILE_CARTOLA": Layout("CHILE", "larger", "labelled_header", {"day": ("fecha",), "memo": ("descripci",), "branch": ("canal", "sucursal"), "reference": ("docto",), "paid_out": ("cargos (clp)",), "paid_in": ("abonos (clp)",), "balance": ("saldo (clp)", "saldo")}, name="word"),
}
_TAX_ID = r"(\d{1,2}\.\d{3}\.\d{3}-[\dKk]|\d{7,9}-[\dKk])"


def _at(cells: Column | str, place: int) -> Column:
    return F.trim(F.coalesce(F.try_element_at(F.col(cells) if isinstance(cells, str) else cells, F.lit(place + 1)), F.lit("")))


def _has(text: str) -> Column:
    return F.exists("cells", lambda c: F.lower(F.coalesce(c, F.lit(""))).contains(text))


def _row_where(condition: Column) -> Column:
    return F.min(F.when(condition, F.col("row_no")))


def _cell_of(row: int, place: int) -> Column:
    return F.max(F.when(F.col("row_no") == row, _at("cells", place)))


def _facts(rows: DataFrame) -> DataFrame:
    """What layouts and accounts are known by, of every sheet: one aggregate over its rows."""
    low = lambda i: F.lower(_at("cells", i))
    early = F.col("row_no") < 25
    begins = lambda text: early & F.exists("cells", lambda c: F.lower(F.trim(F.coalesce(c, F.lit("")))).startswith(text))
    after = F.coalesce(F.element_at(F.filter(F.slice("cells", 3, 10_000), lambda c: F.trim(F.coalesce(c, F.lit(""))) != ""), 1), F.lit(""))
    labelled = lambda text: F.min_by(F.when(early & low(1).startswith(text), F.trim(after)), F.when(early & low(1).startswith(text), F.col("row_no")))
    two = (F.col("row_no") == 1) & (low(0) == "fecha") & low(1).contains("detalle") & low(2).contains("cargo") & low(3).contains("abono") & (low(4) == "saldo")
    final = F.filter(F.transform("cells", lambda c, i: F.when(F.upper(F.coalesce(c, F.lit(""))).contains("SALDO FINAL"), i)), lambda i: i.isNotNull())
    told = [
        _cell_of(0, 0).alias("title"), _row_where((F.col("row_no") < 5) & _has("código transferencia") & _has("glosa detalle") & _has("ingreso")).alias("detailed_header"),
        _row_where(two).alias("second_header"), _row_where((F.col("row_no") < 30) & _has("cargos (clp)") & _has("abonos (clp)")).alias("labelled_header"),
        F.coalesce(F.max(begins("nombre empresa")), F.lit(False)).alias("names_company"), F.coalesce(F.max(begins("cuenta n")), F.lit(False)).alias("names_account"),
        F.min(F.when(F.lower(_at("cells", 0)).contains("saldos diarios") & (F.col("row_no") > 12), F.col("row_no"))).alias("end_row"),
        labelled("nombre empresa").alias("company"), labelled("rut").alias("company_id"), labelled("cuenta").alias("company_account"),
        _cell_of(3, 1).alias("holder"), _cell_of(4, 1).alias("holder_id"), _cell_of(6, 0).alias("account_line"), _cell_of(7, 2).alias("account_cell"),
        F.max(F.when(F.col("row_no") == 9, F.try_element_at(final, F.lit(1)))).alias("final_place"), F.max(F.when(F.col("row_no") == 10, F.col("cells"))).alias("final_values"),
        *[F.max(F.when(F.col("row_no") == r, F.array_join("cells", " "))).alias(f"line_{r}") for r in (7, 10)],
        *[_cell_of(r, c).alias(f"cell_{r}_{c}") for r in (9, 10) for c in (0, 2)],
    ]
    return rows.groupBy("file", "sheet_no", "sheet").agg(*told)


def _fits(layout: Layout, name: str) -> Column:
    first = F.col("sheet") == layout.sheet if layout.sheet else F.col("sheet_no") == 0
    fits = first & (F.lower(F.coalesce("title", F.lit(""))).contains(layout.title) if layout.title else F.lit(True))
    old = F.coalesce(F.col("title"), F.lit("")).rlike(r"(?i)cta\s*:\s*\d+")
    if name == "CHILE_MOVIMIENTOS":
        fits = fits & old
    if name == "CHILE_CARTOLA":
        fits = fits & ~old & F.col("names_company") & F.col("names_account")
    return fits & F.col(layout.header).isNotNull() if isinstance(layout.header, str) else fits


def _first_label(parts: tuple[str, ...]) -> Column:
    """The place, from 1, of the header's first label that holds one of the parts."""

    def held(label: Column) -> Column:
        return reduce(or_, [label.contains(p) for p in parts])

    return F.try_element_at(F.filter(F.transform("labels", lambda c, i: F.when(held(c), i + 1)), lambda i: i.isNotNull()), F.lit(1))


def _by_layout(values: dict[str, Column]) -> Column:
    return F.coalesce(*[F.when(F.col("layout") == name, value) for name, value in values.items()])


def _statements(facts: DataFrame) -> DataFrame:
    """A file's first layout that fits, with its sheet, its header's row and what it tells of account and period."""
    rank = F.coalesce(*[F.when(_fits(layout, name), F.lit(i)) for i, (name, layout) in enumerate(LAYOUTS.items())])
    fitting = facts.withColumn("rank", rank).where("rank IS NOT NULL")
    best = fitting.groupBy("file").agg(F.min(F.struct("rank", "sheet_no")).alias("best"))
    one = fitting.join(best, "file").where("rank = best.rank AND sheet_no = best.sheet_no")
    s = one.withColumn("layout", F.element_at(F.array(*[F.lit(n) for n in LAYOUTS]), F.col("rank") + 1))
    part = lambda c, pattern, i=1: F.nullif(F.regexp_extract(F.coalesce(F.col(c), F.lit("")), pattern, i), F.lit(""))
    banks = lambda bank: [n for n, x in LAYOUTS.items() if x.bank == bank]
    santander, other = F.col("layout").isin(banks("SANTANDER")), F.col("layout").isin(banks("INTERNACIONAL"))
    written = F.coalesce(part("account_line", r"(?i)N°[:\s]+([\d-]+)"), part("account_line", r"(?i)cuenta(?:\s+corriente)?\s+(\d[\d-]*\d)"))
    shown = F.when(santander, written).when(other, F.nullif("account_cell", F.lit(""))).when(F.col("layout") == "CHILE_MOVIMIENTOS", part("title", r"(?i)cta\s*:\s*(\d+)")).when(F.col("layout") == "CHILE_CARTOLA", F.col("company_account"))
    in_title = part("title", r"\((\d{1,2}\.?\d{3}\.?\d{3}-?[\dKk])\)")
    holder = F.when(santander, F.col("holder")).when(F.col("layout") == "CHILE_MOVIMIENTOS", F.when(in_title.isNotNull(), F.trim(F.regexp_extract("title", r"^(.*?)\(\d", 1)))).when(F.col("layout") == "CHILE_CARTOLA", F.col("company"))
    holder_id = F.when(santander, F.col("holder_id")).when(F.col("layout") == "CHILE_MOVIMIENTOS", in_title).when(F.col("layout") == "CHILE_CARTOLA", F.col("company_id"))
    told = lambda word: parse_date(F.coalesce(*[F.when(F.col("layout").isin([n for n, x in LAYOUTS.items() if x.period_row == r]), part(f"line_{r}", rf"(?i){word}[:\s]+(\d{{1,2}}/\d{{1,2}}/\d{{2,4}})")) for r in (7, 10)]))
    months = F.create_map(*[F.lit(x) for pair in MONTHS.items() for x in pair])
    month = F.try_element_at(months, F.lower(F.regexp_extract("cell_9_2", r"(\p{L}+)\s+(\d{4})", 1)))
    begin = F.make_date(F.regexp_extract("cell_9_2", r"(\p{L}+)\s+(\d{4})", 2).try_cast("int"), month, F.lit(1))
    whole_month = other & (F.lower("cell_9_0") == "periodo")
    since = F.when(other & (F.lower("cell_9_0") == "desde"), parse_date(F.col("cell_9_2"))).when(whole_month, begin).otherwise(told("desde"))
    until = F.when(other & (F.lower("cell_10_0") == "hasta"), parse_date(F.col("cell_10_2"))).when(whole_month, F.last_day(begin)).otherwise(told("hasta"))
    closing = F.when(F.col("layout").isin([n for n, x in LAYOUTS.items() if x.ends]), parse_amount(F.try_element_at("final_values", F.col("final_place") + 1)))
    header = _by_layout({n: (F.col(x.header) if isinstance(x.header, str) else F.lit(x.header)).cast("int") for n, x in LAYOUTS.items()})
    blank = lambda c: F.nullif(F.coalesce(c, F.lit("")), F.lit(""))
    return s.select(
        "file", "layout", _by_layout({n: F.lit(x.bank) for n, x in LAYOUTS.items()}).alias("bank"), "sheet_no", header.alias("header_row"), F.when(F.col("layout").isin([n for n, x in LAYOUTS.items() if x.ends]), F.col("end_row")).alias("end_row"),
        blank(shown).alias("account_shown"), blank(account_digits(blank(shown))).alias("account_number"), blank(holder).alias("holder"), F.when(blank(holder_id).isNotNull(), dashed_tax_id(holder_id)).alias("holder_tax_id"),
        since.alias("period_from"), until.alias("period_to"), closing.alias("closing"),
    )


@dataclass
class Workbooks:
    """What the files hold: `statements` (a row each), `movements`, `errors` (rows that should be movements and why not), `unknown` files."""

    statements: DataFrame
    movements: DataFrame
    errors: DataFrame
    unknown: DataFrame


def read_workbooks(files: DataFrame) -> Workbooks:
    """Read statements from `files` (path, content), as `binaryFile` gives them.

    Every file is parsed once and its rows are kept (`checkpoint`): one pass finds layouts and accounts, the other the movements. A
    file without a layout, or that is no workbook, is `unknown`. Periods that a file doesn't tell are those of its movements.
    """
    every = workbook_rows(files).checkpoint()
    rows = every.where("problem IS NULL")
    found = _statements(_facts(rows)).checkpoint()
    heads = rows.join(found, ["file", "sheet_no"]).where("row_no = header_row").select("file", F.transform("cells", lambda c: F.lower(F.trim(F.coalesce(c, F.lit(""))))).alias("labels"))
    body = rows.join(found.drop("sheet"), ["file", "sheet_no"]).join(heads, "file", "left").where("row_no > header_row AND (end_row IS NULL OR row_no < end_row)")

    def cell(role: str) -> Column:
        by = {}
        for name, layout in LAYOUTS.items():
            place = layout.places.get(role)
            if isinstance(place, int):
                by[name] = _at("cells", place)
            elif place:
                by[name] = F.trim(F.coalesce(F.try_element_at("cells", _first_label(place)), F.lit("")))
        return F.nullif(_by_layout(by), F.lit("")) if by else F.lit(None).cast("string")

    roles = ["day", "done_day", "clock", "memo", "amount", "flag", "paid_in", "paid_out", "balance", "reference", "branch", "kind", "party", "party_tax_id", "party_account", "party_bank"]
    r = body.select("file", "layout", F.col("row_no").alias("line_no"), _at("cells", 0).alias("c0"), _at("cells", 1).alias("c1"), *[cell(x).alias(x) for x in roles])
    ways = lambda way: F.col("layout").isin([n for n, x in LAYOUTS.items() if x.way == way])
    money = {x: parse_amount(F.col(x)) for x in ("amount", "paid_in", "paid_out", "balance")}
    r = r.withColumns({f"n_{x}": v for x, v in money.items()})
    paid_in, paid_out, signed = F.coalesce("n_paid_in", F.lit(0)), F.coalesce("n_paid_out", F.lit(0)), F.col("n_amount")
    flag = F.upper(F.coalesce("flag", F.lit("")))
    size = (
        F.when(ways("flag"), F.when((flag == "C") & (signed > 0), -signed).when((flag == "A") & (signed < 0), -signed).otherwise(signed))
        .when(ways("first"), F.when(paid_in != 0, paid_in).when(paid_out != 0, -F.abs(paid_out)))
        .otherwise(F.when((paid_in == 0) & (paid_out == 0), None).when((paid_in > 0) & (paid_out == 0), paid_in).when((paid_out > 0) & (paid_in == 0), -paid_out).when(paid_in > paid_out, paid_in).otherwise(-paid_out))
    )
    day = F.coalesce(parse_date(F.col("day")), parse_date(F.col("done_day")))
    ends = F.col("layout").isin([n for n, x in LAYOUTS.items() if x.ends])
    low = F.lower("c0")
    title = ends & ((low == "") | (low == "monto") | low.contains("resumen") | (low == "saldo")) & (F.lower("c1").rlike("descripci[oó]n") | (low != ""))
    between = title | (ends & day.isNull() & signed.isNull())
    r = r.withColumn("post_date", day).withColumn("value", size).where(~between)
    reason = F.when(F.col("post_date").isNull(), "no date").when(F.col("value").isNull(), "no amount")
    digits = F.regexp_replace("reference", r"\D", "")
    reference = F.when(F.col("layout") == "BCI_DETALLADO", F.col("reference")).when(F.col("reference").rlike("^0+$") | (digits == ""), None).otherwise(F.regexp_replace("reference", r"^0+(?=\d)", ""))
    names = {"code": name_in_transfer, "before_id": name_before_tax_id, "word": name_after_transfer_word}
    party = F.coalesce("party", _by_layout({n: names[x.name](F.col("memo")) for n, x in LAYOUTS.items() if x.name}))
    in_memo = F.nullif(F.regexp_extract(F.coalesce("memo", F.lit("")), _TAX_ID, 1), F.lit(""))
    tax_id = F.when(F.col("party_tax_id").isNotNull(), dashed_tax_id(F.col("party_tax_id"))).when(F.col("layout").isin([n for n, x in LAYOUTS.items() if x.bank in ("SANTANDER", "INTERNACIONAL")]) & in_memo.isNotNull(), dashed_tax_id(in_memo))
    kind = F.when(ways("flag"), F.when(flag == "A", "ABONO").when(flag == "C", "CARGO")).when(F.col("layout").startswith("CHILE"), F.when(F.col("value") >= 0, "ABONO").otherwise("CARGO")).otherwise(F.col("kind"))
    made = r.where(reason.isNull()).select(
        "file", "layout", "line_no", "post_date", F.when(F.col("clock").isNotNull() | F.col("done_day").isNotNull(), with_time(parse_date(F.col("done_day")), F.col("clock"))).alias("done_at"), F.col("value").alias("amount"),
        F.when(F.col("value") >= 0, "IN").otherwise("OUT").alias("direction"), "memo", reference.alias("reference"), F.col("n_balance").alias("balance_after"), party.alias("counterparty"), tax_id.alias("counterparty_tax_id"),
        F.when(F.col("party_account").isNotNull(), account_digits(F.col("party_account"))).alias("counterparty_account"), F.col("party_bank").alias("counterparty_bank"), "branch", kind.alias("kind"),
    )
    movements = closing_balance(made, found.select("file", "closing"))
    spans = movements.groupBy("file").agg(F.min("post_date").alias("first_day"), F.max("post_date").alias("last_day"))
    statements = found.drop("sheet_no", "header_row", "end_row").join(spans, "file", "left")
    statements = statements.withColumn("period_from", F.coalesce("period_from", "first_day")).withColumn("period_to", F.coalesce("period_to", "last_day")).drop("first_day", "last_day")
    errors = r.where(reason.isNotNull()).select("file", "layout", "line_no", reason.alias("reason"))
    unknown = every.groupBy("file").agg(F.max("problem").alias("problem")).join(found, "file", "left_anti")
    return Workbooks(statements, movements, errors, unknown)


def workbook_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "content")
