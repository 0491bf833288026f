"""A training corpus from `documents`: toxic texts go, near duplicates go, sources are mixed, the rest is packed.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame, which is written as Parquet and read again as the
next stage's docs. All but the last give the columns of `documents`, whatever their names. A null text counts as an
empty one, null ids and nulls in other columns stay as they are, and an empty table passes all stages as one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from reconlake.llm.mixing import mix_sources
from reconlake.llm.packing import pack_documents
from reconlake.llm.shared import table, work_dir
from reconlake.llm.simhash import keep_one_each
from reconlake.llm.toxicity import keep_clean, train


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier calls toxic go; it is trained on the labelled ones among `docs`.

    Repeated rows are judged alike; without usable labels all documents stay.
    """
    return keep_clean(docs, train(docs, table(spark, sf_dir, "labels")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (5-word shingles, Jaccard 0.8 or more) the document with the least id stays.

    Near SimHashes bring texts together and their sets decide; keys of the sets find what SimHashes miss.
    Texts without words are one group; rows that repeat an id are one document; rows without an id stay.
    """
    return keep_one_each(docs, words=5, similarity=0.8)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of small sources are repeated until sources have nine tenths of the greatest entropy; none is lost.

    A null source is one of its own; repeated rows are read as often as each other.
    """
    return mix_sources(docs, placed=False)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of 2048 tokens, as a row per piece; repeated rows are documents of their own.

    The executors' JVMs have grown by now, so the tokenizer gets little room.
    """
    return pack_documents(docs, room=0.25)


STAGES = [("toxicity", drop_toxic), ("simhash near-dedup", drop_near_copies), ("source mixing", mix), ("packing", pack)]

#: A trained model, hashes and a tokenizer decide here; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after the other, over the whole `documents` table."""
    docs = table(spark, sf_dir, "documents")
    folder = work_dir(spark, "corpus")
    for number, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        out.write.parquet(f"{folder}/{number}")
        docs = spark.read.parquet(f"{folder}/{number}")
    return docs
