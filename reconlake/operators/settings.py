"""Settings: tables of a few rows that every row of another table meets, with a checked bound on their size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MOST_ROWS = 1000


def bounded(rows: DataFrame, most_rows: int) -> list:
    found = rows.limit(most_rows + 1).collect()
    if len(found) > most_rows:
        raise ValueError(f"a settings table has over {most_rows} rows; join it by a key")
    return found


def settings(rows: DataFrame, most_rows: int = MOST_ROWS) -> DataFrame:
    """`rows`, marked for broadcast; more than `most_rows` are refused. For conditions that no key can express."""
    return F.broadcast(rows.sparkSession.createDataFrame(bounded(rows, most_rows), rows.schema))


def for_each(entries: DataFrame, weights: DataFrame, most_rows: int = MOST_ROWS) -> DataFrame:
    """Every entry once with the columns of each of the weights' rows, of which there are `most_rows` at most.

    The weights are a constant array in the plan that each entry is exploded over: no join, no shuffle.
    """
    known = bounded(weights, most_rows)
    kinds = {f.name: f.dataType for f in weights.schema.fields}
    if not known:
        return entries.select("*", *[F.lit(None).cast(t).alias(c) for c, t in kinds.items()]).limit(0)
    array = F.array(*[F.struct(*[F.lit(r[c]).cast(t).alias(c) for c, t in kinds.items()]) for r in known])
    return entries.withColumn("_weight", F.explode(array)).select(*entries.columns, "_weight.*")
