"""Which texts hold which needles: rare q-grams bring them together by equi-joins, the texts themselves decide."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters of a q-gram; shorter needles are looked up whole.
Q = 3


def _grams(text: Column, q: int) -> Column:
    places = F.when(F.length(text) >= q, F.sequence(F.lit(1), F.length(text) - q + 1)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(places, lambda i: F.substring(text, i, F.lit(q))))


def containing(texts: DataFrame, text: str, needles: DataFrame, needle: str) -> DataFrame:
    """All pairs of a text and a needle that it holds, with the columns of both; null and empty needles are in no text.

    Every needle is known by one of its q-grams: the one that the fewest texts have. Texts meet needles under that gram, so
    a needle meets about as many texts as its rarest gram, and neither side is broadcast unless Spark finds it small. Different
    texts are indexed once each. Column names of the two sides must differ.
    """
    known = needles.where(F.length(needle) > 0)
    size = F.least(F.length(needle), F.lit(Q))
    by_gram = known.select(F.col(needle).alias("_needle"), F.explode(F.when(size == 1, _grams(F.col(needle), 1)).when(size == 2, _grams(F.col(needle), 2)).otherwise(_grams(F.col(needle), Q))).alias("_gram")).distinct()
    own = texts.where(F.length(text) > 0).select(F.col(text).alias("_text")).distinct()
    every = own.select("_text", F.explode(F.array_distinct(F.flatten(F.array(*[_grams(F.col("_text"), q) for q in range(1, Q + 1)])))).alias("_gram"))
    asked = every.join(by_gram.select("_gram").distinct(), "_gram")
    counts = asked.groupBy("_gram").agg(F.count("*").alias("_texts"))
    # a needle with a gram that no text has is in none: it has no count there
    lengths = by_gram.groupBy("_needle").agg(F.count("*").alias("_grams"))
    seen = by_gram.join(counts, "_gram").groupBy("_needle").agg(F.min(F.struct("_texts", "_gram")).alias("_rarest"), F.count("*").alias("_seen"))
    keys = seen.join(lengths, "_needle").where("_seen = _grams").select("_needle", F.col("_rarest._gram").alias("_gram"))
    found = asked.join(keys, "_gram").where(F.contains("_text", "_needle")).select("_text", "_needle")
    return texts.join(found, F.col(text) == F.col("_text")).join(known, F.col(needle) == F.col("_needle")).drop("_text", "_needle")
