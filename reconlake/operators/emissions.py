"""A register of emitted documents as a log of events: what is consumed, by which emission, as of any event."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reconlake.operators.assign import greedy_assign
from reconlake.operators.closing import balance_of


class EmissionRegister:
    """Events are folders of one log, numbered in order and never changed; an event that runs again overwrites itself.

    An emission freezes its lines and consumes its references; a later event may undo it, which frees them. A reference
    belongs to one open emission at most, whatever its origin. Setting rows aside is an emission without lines.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def _events(self, kind: str, before: int | None) -> DataFrame | None:
        try:
            rows = self.spark.read.parquet(f"{self.folder}/{kind}")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return None
        return rows if before is None else rows.where(F.col("event") < before)

    def open_emissions(self, before: int | None = None) -> DataFrame | None:
        """The emissions, with their frozen lines, that weren't undone by then; None before the first one.

        An emission may be undone and a document of the same key emitted anew: that is another folio.
        """
        emitted, undone = self._events("emitted", before), self._events("undone", before)
        return emitted if emitted is None or undone is None else emitted.join(undone.select("folio"), "folio", "left_anti")

    def consumed(self, before: int | None = None) -> DataFrame | None:
        """(ref, folio, origin) of all that open emissions hold."""
        there = self.open_emissions(before)
        return None if there is None else there.select(F.explode("refs").alias("ref"), "folio", "origin")

    def emit(self, event: int, origin: str, documents: DataFrame) -> DataFrame:
        """(key, folio, refused) of the `documents` (key, refs array<string>, lines array), in the order of their keys.

        Refused are documents that are `unbalanced`, those with a reference that an open emission holds (`consumed by`
        the least such folio), and those whose references an earlier document of this event took (`taken`). Keys must differ.
        """
        docs = documents.select("key", F.array_distinct(F.array_compact("refs")).alias("refs"), "lines").withColumn("off", F.coalesce(balance_of("lines"), F.lit(0))).checkpoint()
        held = self.consumed(event)
        claims = docs.select("key", F.explode("refs").alias("ref"))
        nothing = docs.select("key").limit(0).withColumn("holder", F.lit(None).cast("string"))
        clash = nothing if held is None else claims.join(held, "ref").groupBy("key").agg(F.min("folio").alias("holder"))
        judged = docs.join(clash, "key", "left").withColumn("refused", F.when(F.col("off") != 0, "unbalanced").when(F.col("holder").isNotNull(), F.concat(F.lit("consumed by "), "holder")))
        free = judged.where("refused IS NULL").checkpoint()
        # a document needs all its references; one without any needs nothing
        won = greedy_assign(free.where("size(refs) > 0").select("key", "refs"), "key", "refs", [F.col("key")]).select("key")
        won = won.unionByName(free.where("size(refs) = 0").select("key"))
        accepted = free.join(won, "key", "left_semi").select("key", F.concat(F.lit(f"{event}-"), F.col("key").cast("string")).alias("folio"), F.lit(origin).alias("origin"), "refs", "lines")
        accepted.write.mode("overwrite").parquet(f"{self.folder}/emitted/event={event}")
        done = self.spark.read.schema(accepted.schema).parquet(f"{self.folder}/emitted/event={event}").select("key", "folio")
        told = judged.select("key", "refused").join(done, "key", "left")
        return told.select("key", "folio", F.when(F.col("folio").isNull(), F.coalesce("refused", F.lit("taken"))).alias("refused"))

    def undo(self, event: int, folios: DataFrame) -> DataFrame:
        """(folio, undone) of the `folios`: undone where the emission was open."""
        asked = folios.select("folio").distinct()
        there = self.open_emissions(event)
        found = asked.limit(0) if there is None else asked.join(there.select("folio"), "folio", "left_semi")
        found.write.mode("overwrite").parquet(f"{self.folder}/undone/event={event}")
        done = self.spark.read.schema(found.schema).parquet(f"{self.folder}/undone/event={event}").withColumn("undone", F.lit(True))
        return asked.join(done, "folio", "left").select("folio", F.coalesce("undone", F.lit(False)).alias("undone"))
