"""Files taken in once by their content: a log of hashes, rows that only fill what is missing, discards that last."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def _log(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def import_files(spark: SparkSession, folder: str, log: str, checkpoint: str, parse: Callable[[DataFrame], DataFrame], glob: str = "*", interval: str | None = None) -> StreamingQuery:
    """Parse the files that arrive in `folder` whose content hasn't been taken in before.

    Each micro-batch hashes its files in the tasks that read them and drops those whose SHA-256 stands in the log already,
    under whatever name; of equal files in one batch the least path counts. `parse` gets (path, file_hash, content) and gives
    rows with file_hash. The batch's hashes and rows become folders of the log named by its number, so a batch that runs
    again overwrites itself and looks only at the hashes before it. Without an interval it takes what is there.
    """

    def take(batch: DataFrame, number: int) -> None:
        files = batch.select("path", F.sha2("content", 256).alias("file_hash"), "content")
        firsts = files.groupBy("file_hash").agg(F.min("path").alias("path"))
        known = _log(spark, f"{log}/files")
        if known is not None:
            firsts = firsts.join(known.where(F.col("import") < number).select("file_hash"), "file_hash", "left_anti")
        firsts.write.mode("overwrite").parquet(f"{log}/files/import={number}")
        new = files.join(spark.read.schema(firsts.schema).parquet(f"{log}/files/import={number}"), ["file_hash", "path"], "left_semi")
        parse(new).write.mode("overwrite").parquet(f"{log}/rows/import={number}")

    stream = spark.readStream.schema("path string, modificationTime timestamp, length bigint, content binary").format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(folder)
    writer = stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()


def imported(spark: SparkSession, log: str, key: str, discards: DataFrame | None = None) -> DataFrame:
    """One row per key: every column has the value of the first import that had one, so later imports fill gaps and change nothing.

    Two files of one import that differ in a column give the least value. `first_import` is where the key came from;
    `discarded` says whether it stands among `discards` (a register of keys that outlives the rows).
    """
    rows = spark.read.parquet(f"{log}/rows")
    others = [c for c in rows.columns if c not in (key, "import", "file_hash")]

    def first_value(c: str) -> Column:
        return F.min(F.when(F.col(c).isNotNull(), F.struct(F.col("import"), F.col(c)))).getField(c).alias(c)

    merged = rows.groupBy(key).agg(*[first_value(c) for c in others], F.min("import").cast("int").alias("first_import"))
    if discards is None:
        return merged.withColumn("discarded", F.lit(False))
    gone = discards.select(key).distinct().withColumn("discarded", F.lit(True))
    return merged.join(gone, key, "left").withColumn("discarded", F.coalesce("discarded", F.lit(False)))


def import_preview(incoming: DataFrame, present: DataFrame, discards: DataFrame, rules: list[tuple[int | None, str]], key: str = "dedup_key", account: str = "account_id") -> DataFrame:
    """What an import would do with each row: `status`, the `pattern` that discards it, and `discarded`.

    A key that the account holds already is DUPLICATE; a row without a key couldn't be read and is an ERROR; the others are
    NEW. A NEW row arrives discarded if its key was discarded before, or if the first rule (account or all, pattern) of its
    account stands in its counterparty or memo, whatever the case.
    """
    there = present.select(account, key).distinct().withColumn("there", F.lit(True))
    gone = discards.select(account, key).distinct().withColumn("gone", F.lit(True))
    said = F.lower(F.concat_ws(" ", F.coalesce("counterparty", F.lit("")), F.coalesce("memo", F.lit(""))))
    active = [(a, p.strip()) for a, p in rules if p.strip()]
    found = F.coalesce(*[F.when(said.contains(p.lower()) & (F.lit(a is None) | (F.col(account) == F.lit(a))), F.lit(p)) for a, p in active], F.lit(None).cast("string"))
    met = incoming.join(there, [account, key], "left").join(gone, [account, key], "left")
    status = F.when(F.col(key).isNull(), "ERROR").when(F.col("there"), "DUPLICATE").otherwise("NEW")
    met = met.withColumn("status", status).withColumn("pattern", F.when(F.col("status") == "NEW", found))
    return met.withColumn("discarded", (F.col("status") == "NEW") & (F.coalesce("gone", F.lit(False)) | F.col("pattern").isNotNull())).drop("there", "gone")
