"""Clusters of probable duplicates: equal keys, several imports, and names that may be one party's."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reconlake.functions.names import facts_agree, party_facts
from reconlake.operators.assign import share_checkpoints

#: From so many members on a cluster may be several true transfers and is never sure.
MANY = 4

#: Keys with more different parties are clustered by rounds over a table of links, the others each within its row.
MOST_PARTIES = 64


def _agree(a: Column, b: Column) -> Column:
    return F.coalesce(facts_agree(a, b), F.lit(True))


def _confidence() -> Column:
    whole = F.coalesce("links", F.lit(0)) == F.col("parties") * (F.col("parties") - 1) / 2
    return F.when((F.col("members") < MANY) & whole, "HIGH").otherwise("MEDIUM").alias("confidence")


def _within_rows(keyed: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, party, cluster, members, confidence) of rows that hold all the `nodes` of a key: no node leaves its row."""
    n = F.size("nodes")
    pairs = F.flatten(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.transform(F.filter(F.sequence(F.lit(0), n - 1), lambda j: (i < j) & _agree(F.get("nodes", i)["facts"], F.get("nodes", j)["facts"])), lambda j: F.struct(i.alias("a"), j.alias("b")))))
    linked = keyed.withColumn("pairs", pairs)

    def tied(labels: Column, pair: Column) -> Column:
        a, b = F.get(labels, pair["a"]), F.get(labels, pair["b"])
        return F.transform(labels, lambda x: F.when(x == F.greatest(a, b), F.least(a, b)).otherwise(x))

    linked = linked.withColumn("labels", F.aggregate("pairs", F.sequence(F.lit(0), n - 1), tied))
    each = linked.select(*keys, F.explode(F.array_distinct("labels")).alias("label"), "nodes", "pairs", "labels")
    own = F.filter("nodes", lambda x, i: F.get("labels", i) == F.col("label"))
    links = F.size(F.filter("pairs", lambda x: F.get("labels", x["a"]) == F.col("label")))
    each = each.select(*keys, own.alias("own"), links.alias("links"))
    each = each.where(F.array_min("own.lo") < F.array_max("own.hi")).withColumn("parties", F.size("own")).withColumn("members", F.aggregate("own.n", F.lit(0).cast("long"), lambda x, y: x + y))
    return each.select(*keys, F.explode("own.party").alias("party"), F.array_min("own.least").alias("cluster"), "members", _confidence())


def _by_rounds(keyed: DataFrame, keys: list[str]) -> DataFrame:
    """The same for keys of many parties: these meet by a join, and the least id spreads over links until none changes."""
    nodes = keyed.select(*keys, F.explode("nodes").alias("node")).select(*keys, "node.*").checkpoint()
    a, b = (nodes.select(*keys, F.col("party").alias(f"p_{i}"), F.col("facts").alias(f"f_{i}")) for i in "ab")
    links = a.join(b, keys).where("p_a < p_b").where(_agree(F.col("f_a"), F.col("f_b"))).select("p_a", "p_b").checkpoint()
    both = links.union(links.select("p_b", "p_a")).toDF("party", "other")
    labels = nodes.select("party", F.col("least").alias("cluster"))
    while True:
        seen = both.join(labels.withColumnRenamed("party", "other"), "other").groupBy("party").agg(F.min("cluster").alias("near"))
        spread = labels.join(seen, "party", "left").select("party", F.least("cluster", F.coalesce("near", "cluster")).alias("cluster"), F.coalesce(F.col("near") < F.col("cluster"), F.lit(False)).alias("moved")).checkpoint()
        labels = spread.select("party", "cluster")
        if not spread.where("moved").limit(1).count():
            break
    named = nodes.join(labels, "party")
    direct = links.join(labels.toDF("p_a", "cluster"), "p_a").groupBy("cluster").agg(F.count("*").alias("links"))
    facts = named.groupBy("cluster").agg(F.sum("n").alias("members"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.count("*").alias("parties")).where("lo < hi").join(direct, "cluster", "left")
    return named.join(facts.select("cluster", "members", _confidence()), "cluster").select(*keys, "party", "cluster", "members", "confidence")


def duplicate_clusters(rows: DataFrame, keys: list[str], import_col: str = "import_id", id_col: str = "bank_id", most_parties: int = MOST_PARTIES) -> DataFrame:
    """(`id_col`, cluster, members, confidence) of the rows in clusters of more than one import.

    Rows agree in `keys`; parties (name, tax id) of a key that `names_agree` says may be one are linked, and links carry
    on. Rows of one party are one node, so only the different parties of a key meet, up to `most_parties` of them within one row. `cluster` is the
    least id in it; confidence is HIGH where under four members all agree directly, else MEDIUM.
    """
    share_checkpoints(rows)
    marked = rows.where(" AND ".join(f"`{k}` IS NOT NULL" for k in keys)).withColumn("party", F.xxhash64(*keys, "counterparty", "counterparty_tax_id"))
    nodes = marked.groupBy(*keys, "party").agg(F.first("counterparty").alias("name"), F.first("counterparty_tax_id").alias("tax_id"), F.min(id_col).alias("least"), F.count("*").alias("n"), F.min(import_col).alias("lo"), F.max(import_col).alias("hi"))
    nodes = nodes.select(*keys, F.struct("party", party_facts(F.col("name"), F.col("tax_id")).alias("facts"), "least", "n", "lo", "hi").alias("node"))
    keyed = nodes.groupBy(*keys).agg(F.collect_list("node").alias("nodes")).where(F.array_min("nodes.lo") < F.array_max("nodes.hi")).checkpoint()
    told = _within_rows(keyed.where(F.size("nodes") <= most_parties), keys)
    many = keyed.where(F.size("nodes") > most_parties)
    if many.limit(1).count():
        told = told.unionByName(_by_rounds(many, keys))
    return marked.select(id_col, *keys, "party").join(told, [*keys, "party"]).select(id_col, "cluster", "members", "confidence")
