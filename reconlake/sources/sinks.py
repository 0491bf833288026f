"""Writers: upserts by key, sheets by group, matrices with a header, and whole-database dumps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from reconlake.functions.dates import sheet_serial
from reconlake.operators.dedup import latest_by, new_rows


def upserted(present: DataFrame, incoming: DataFrame, keys: list[str], order: list[str], kept: list[str] = ()) -> DataFrame:
    """`present` with `incoming` written over it: the last write of a key wins, but columns `kept` stay as they were.

    Equal `order` values go to the greatest row. Keys that are null are one key, as in grouping.
    """
    rest = [c for c in incoming.columns if c not in keys]
    ranking: list[Column] = [*[F.desc(c) for c in order], *[F.col(c).cast("string").desc() for c in rest if c not in order]]
    last = latest_by(incoming, keys, ranking)
    old = present.select(*[F.col(k).alias(f"old_{k}") for k in keys], F.struct(*present.columns).alias("was"))
    same = [F.col(k).eqNullSafe(F.col(f"old_{k}")) for k in keys]
    new = last.select(F.struct(*last.columns).alias("now"), *keys)
    met = new.join(old, same, "full")
    there = F.col("now").isNotNull()
    values = [F.when(there & (F.lit(c not in kept) | F.col("was").isNull()), F.col(f"now.{c}") if c in last.columns else F.lit(None)).otherwise(F.col(f"was.{c}")).alias(c) for c in present.columns]
    return met.select(*values)


def insert_new(present: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """`present` and those rows of `incoming` whose key isn't there; of equal new keys the least row goes in."""
    fresh = latest_by(incoming, keys, [F.col(c).cast("string").asc() for c in incoming.columns])
    return present.unionByName(new_rows(fresh, present, keys), allowMissingColumns=True)


def write_sheets(df: DataFrame, folder: str, by: str, order: list[str]) -> None:
    """One folder of CSV per value of `by`, lines in `order` within each file; a large group is split over several files."""
    spread = df.repartition(F.col(by), F.pmod(F.xxhash64(*order), F.lit(4)))
    spread.sortWithinPartitions(by, *order).write.mode("errorifexists").partitionBy(by).option("header", True).csv(folder)


def unique_names(df: DataFrame, name: str, order: list[str], most: int = 31) -> DataFrame:
    """`df` with `sheet`: the name cut to `most` characters, and ` (2)`, ` (3)` ... where rows before had the same."""
    short = F.substring(F.col(name), 1, most)
    place = F.row_number().over(Window.partitionBy(short).orderBy(*order))
    mark = F.concat(F.lit(" ("), place.cast("string"), F.lit(")"))
    return df.withColumn("sheet", F.when(place == 1, short).otherwise(F.concat(F.substring(short, F.lit(1), most - F.length(mark)), mark)))


SHEET_COLUMNS = "ABCDEFGHIJ"
#: The cells of a journal sheet's head, and the labels of its detail in row 10.
SHEET_HEAD = {2: {"B": "FECHA:", "F": "Tipo de Asiento", "I": "Sucursal:"}, 4: {"B": "Descripcion del asiento", "I": "Estado"}, 10: {"A": "Linea", "B": "Rubro de gestion", "C": "cliente", "D": "Descripción", "F": "Cotización", "G": "Debe ME", "H": "Haber ME", "I": "Debe MN", "J": "Haber MN"}}


def journal_sheets(lines: DataFrame, keys: list[str], order: list[str], day: Column, title: Column, branch: int = 1, kind: int = 0, state: str = "CON") -> DataFrame:
    """The cells of a journal sheet for each entry: `keys`, row_no and columns A to J as text.

    Row 1 numbers the columns, row 2 has the day as a serial number, row 4 the title, row 10 the labels; details (code,
    debit, credit, detail) follow from row 11, numbered, each amount twice: in foreign and in own money at a rate of 1.
    """
    text = lambda c: c.cast("string")
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    own = {"A": place, "B": F.col("code"), "C": F.lit(0), "D": F.col("detail"), "F": F.lit(1), "G": F.col("debit"), "H": F.col("credit"), "I": F.col("debit"), "J": F.col("credit")}
    blank = F.lit(None).cast("string")
    details = lines.select(*keys, (place + 10).alias("row_no"), *[text(own[c]).alias(c) if c in own else blank.alias(c) for c in SHEET_COLUMNS])
    facts = {(2, "C"): text(sheet_serial(day)), (2, "G"): F.lit(str(kind)), (2, "J"): F.lit(str(branch)), (4, "E"): title, (4, "J"): F.lit(state)}
    entries = lines.groupBy(*keys).agg(F.min(F.struct(facts[2, "C"].alias("day"), title.alias("title"))).alias("told"))
    facts |= {(2, "C"): F.col("told.day"), (4, "E"): F.col("told.title")}

    def head(row: int) -> Column:
        cell = lambda i, c: F.lit(str(i)) if row == 1 else facts.get((row, c), F.lit(SHEET_HEAD[row].get(c)).cast("string"))
        return F.struct(F.lit(row).alias("row_no"), *[cell(i, c).alias(c) for i, c in enumerate(SHEET_COLUMNS, 1)])

    heads = entries.select(*keys, F.explode(F.array(*[head(r) for r in (1, 2, 4, 10)])).alias("r")).select(*keys, "r.*")
    return heads.unionByName(details)


def write_report(summary: DataFrame, detail: DataFrame, folder: str) -> None:
    """A report as two folders of CSV with headers: `summary`, of few rows, as one file, and `detail` as it is spread."""
    write_matrix(summary, f"{folder}/summary")
    detail.write.mode("errorifexists").option("header", True).csv(f"{folder}/detail")


def write_matrix(df: DataFrame, folder: str) -> None:
    """A report of few rows as one CSV file with a header. `df` is an aggregate; its writer gets its rows only."""
    df.coalesce(1).write.mode("errorifexists").option("header", True).csv(folder)


def dump_tables(tables: dict[str, DataFrame], folder: str) -> dict[str, str]:
    """Every table as JSON lines under its name; gives the schemas that `restore_tables` needs."""
    for name, df in tables.items():
        df.write.mode("errorifexists").option("ignoreNullFields", False).json(f"{folder}/{name}")
    return {name: df.schema.json() for name, df in tables.items()}


def restore_tables(spark: SparkSession, folder: str, schemas: dict[str, str]) -> dict[str, DataFrame]:
    import json

    from pyspark.sql.types import StructType

    return {name: spark.read.schema(StructType.fromJson(json.loads(s))).json(f"{folder}/{name}") for name, s in schemas.items()}
