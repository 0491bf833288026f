"""Consistent weighted sampling: document fingerprints that agree as often as term weights overlap.

DataFrame functions only. A term is a word between ASCII white space, its weight the number of times it occurs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from reconlake.llm.shared import blocks_for, stored

SAMPLES = 32
#: Samples worked out side by side; as many rows go through as it takes to make up SAMPLES. With more, the
#: generated code outgrows what the JVM compiles.
WIDTH = 2
DOCS_PER_CELL = 512
OUTER, INNER = 128, 128
LOWEST = -(1 << 63)


def _uniform(bits: Column, low: int) -> Column:
    """A number in (0, 1) from 21 bits of a hash, from bit `low` on."""
    return (F.shiftrightunsigned(bits, low).bitwiseAND(F.lit((1 << 21) - 1)) + 0.5) * (2.0**-21)


def sample_terms(terms: DataFrame, keys: list[str], term: str, weights: list[str], samples: int = SAMPLES) -> DataFrame:
    """Signatures of the groups `keys` under each of the weight columns.

    For sample d and term k, r and c are draws from the gamma distribution with shape 2 and b is uniform, all by
    hashes of (k, d). With t = floor(ln w / r + b), the value is ln c - r (t - b + 1); the term with the least value
    gives the sample (k, t). Two weightings give the same sample with the probability of their generalised
    Jaccard similarity, sum of least weights over sum of greatest. A term with equal weights in several columns
    is worked out once. A value (31 bits) and 32 bits of (k, t), a hash of k and d with t added bitwise, are one
    64-bit number, so that a plain minimum finds the sample; its lower half is kept.

    Returns: `keys`, and for each weight column an array of `samples` hexadecimal strings (null: no term).
    """
    turns = -(-samples // WIDTH)
    rows = terms.withColumn("turn", F.explode(F.sequence(F.lit(0), F.lit(turns - 1))))
    held = [*keys, "turn", term, *weights]
    logs = {w: F.log(F.col(w).cast("double")).alias(f"ln_{w}") for w in weights}
    rows = rows.select(*held, *logs.values())
    held += [f"ln_{w}" for w in weights]
    bits = [(F.xxhash64(term, F.col("turn") * WIDTH + d, F.lit(1)).alias(f"p{d}"), F.xxhash64(term, F.col("turn") * WIDTH + d, F.lit(2)).alias(f"q{d}")) for d in range(WIDTH)]
    rows = rows.select(*held, *[x for pair in bits for x in pair])
    draws = []
    for d in range(WIDTH):
        p, q = F.col(f"p{d}"), F.col(f"q{d}")
        draws.append((-F.log(_uniform(p, 0) * _uniform(p, 21))).alias(f"r{d}"))
        draws.append(F.log(-F.log(_uniform(p, 42) * _uniform(q, 0))).alias(f"c{d}"))
        draws.append(_uniform(q, 21).alias(f"b{d}"))
        draws.append(p.bitwiseAND(F.lit((1 << 32) - 1)).alias(f"k{d}"))
    rows = rows.select(*held, *draws)

    def code(d: int, w: str) -> Column:
        r, c, b = F.col(f"r{d}"), F.col(f"c{d}"), F.col(f"b{d}")
        t = F.floor(F.col(f"ln_{w}") / r + b)
        value = ((c - r * (t - b + 1) + 128.0) * float(1 << 23)).cast("long")
        return F.when(F.col(w) > 0, F.shiftleft(value, 32).bitwiseOR(F.col(f"k{d}").bitwiseXOR(t.bitwiseAND(F.lit((1 << 32) - 1)))))

    first, *others = weights
    rows = rows.select(*held, *[code(d, first).alias(f"{first}_{d}") for d in range(WIDTH)], *[F.col(f"{x}{d}") for d in range(WIDTH) for x in "rcbk"])
    shown = [f"{first}_{d}" for d in range(WIDTH)]
    for w in others:
        same = F.col(w) == F.col(first)
        rows = rows.select(*held, *shown, *[F.when(same, F.col(f"{first}_{d}")).otherwise(code(d, w)).alias(f"{w}_{d}") for d in range(WIDTH)], *[F.col(f"{x}{d}") for d in range(WIDTH) for x in "rcbk"])
        shown += [f"{w}_{d}" for d in range(WIDTH)]
    least = rows.groupBy(*keys, "turn").agg(*[F.min(c).alias(c) for c in shown])
    hexed = lambda c: F.lower(F.lpad(F.hex(F.col(c).bitwiseAND(F.lit((1 << 32) - 1))), 8, "0"))
    parts = least.select(*keys, "turn", *[F.concat(*[hexed(f"{w}_{d}") for d in range(WIDTH)]).alias(w) for w in weights])
    gathered = parts.groupBy(*keys).agg(*[F.sort_array(F.collect_list(F.struct("turn", w))).alias(w) for w in weights])
    return gathered.select(*keys, *[F.concat_ws("", F.col(f"{w}.{w}")).alias(w) for w in weights])


def likeness(a: Column, b: Column, samples: int = SAMPLES) -> Column:
    """The share of equal samples of two fingerprints; two empty ones are alike, an empty and another are not."""
    at = F.sequence(F.lit(0), F.lit(samples - 1))
    equal = F.size(F.filter(at, lambda i: F.substring(a, i * 8 + 1, F.lit(8)) == F.substring(b, i * 8 + 1, F.lit(8))))
    return F.when((a == "") & (b == ""), 1.0).when((a == "") | (b == ""), 0.0).otherwise(equal / F.lit(float(samples)))


def _words(text: Column) -> Column:
    return F.split(text, "[ \\t-\\r]+")


def fingerprint_documents(docs: DataFrame, samples: int = SAMPLES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`id_col` and the fingerprint of every text (null: empty; no words: an empty string). Repeated ids give rows each."""
    rows = docs.select(F.col(id_col), F.coalesce(text_col, F.lit("")).alias("text"), F.monotonically_increasing_id().alias("row"))
    terms = rows.select("row", F.col(id_col).alias("own"), F.explode(_words(F.col("text"))).alias("word"))
    counted = terms.where("word <> ''").groupBy("row", F.xxhash64("word").alias("term")).agg(F.count("*").alias("weight"))
    prints = sample_terms(counted, ["row"], "term", ["weight"], samples)
    return rows.select("row", id_col).join(prints, "row", "left").select(id_col, F.coalesce("weight", F.lit("")).alias("fingerprint"))


def _cells(docs: DataFrame, key: Column, tie: Column, docs_per_cell: int) -> Column:
    """The cell of a row: ranges of (key, tie) with about equal numbers of rows, OUTER x INNER at most, in order.

    Bounds are percentiles of the key column; the driver gets them only. A key that several of them fall on has as
    many cells of its own, ranges of `tie`, a hash; its rows lie there, in that order.
    """
    cells = min(OUTER * INNER, blocks_for(docs.count(), docs_per_cell))
    if cells == 1:
        return F.lit(0)
    shares = [i / cells for i in range(1, cells)]
    found = docs.agg(F.percentile_approx(key, shares, 100_000).alias("b")).first()["b"] or []
    bounds = sorted(set(found))
    inner = [bounds[i : i + INNER] for i in range(0, len(bounds), INNER)]
    tops = F.array(*[F.lit(x[-1]).cast("long") for x in inner])
    table = F.array(*[F.array(*[F.lit(b).cast("long") for b in x]) for x in inner])
    outer = F.size(F.filter(tops, lambda b: b < key))
    within = F.size(F.filter(F.coalesce(F.get(table, outer), F.array().cast("array<bigint>")), lambda b: b < key))
    cell = outer * INNER + within
    hot = {b: found.count(b) for b in bounds if found.count(b) > 1}
    if not hot:
        return cell.cast("int")
    # cells are numbered with room for the most own cells of a key: its other neighbours come before them
    room = 1 + max(hot.values())
    share = (tie.cast("double") + 2.0**63) / 2.0**64
    own = F.lit(0)
    for b, n in hot.items():
        own = F.when(key == b, 1 + F.least(F.floor(share * n), F.lit(n - 1))).otherwise(own)
    return (cell * room + own).cast("int")


def edited_fingerprints(docs: DataFrame, samples: int = SAMPLES, docs_per_cell: int = DOCS_PER_CELL, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited text, whose last quarter is the start of the next document.

    Documents are ordered by `id_col` (null before all; equal ids by a hash of the text); the last one's next is
    the first. Rows are dealt once to ranges of ids; each range's first document goes to the range before it as
    well, so that every document stands beside its next. Terms are counted and sampled for both texts together
    where they lie, and only fingerprints travel on, to the document before.

    Null texts are empty; a lone document is its own next; repeated rows follow each other; extra columns are
    ignored; an empty table gives an empty result.

    Returns: `id_col`, n_chars long, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.
    """
    spark: SparkSession = docs.sparkSession
    order = F.coalesce(F.col(id_col).cast("long"), F.lit(LOWEST))
    rows = docs.select(F.col(id_col), F.coalesce(text_col, F.lit("")).alias("text"), order.alias("k"))
    ids = docs.select(order.alias("k"))
    rows = rows.withColumn("tie", F.xxhash64("text")).withColumn("cell", _cells(ids, F.col("k"), F.col("tie"), docs_per_cell))
    first = F.min(F.struct("k", "tie"))
    firsts = [tuple(r) for r in rows.groupBy("cell").agg(first.alias("f")).select("cell", "f.k", "f.tie").orderBy("cell").collect()]
    heads = spark.createDataFrame([(k, tie, firsts[i - 1][0], cell) for i, (cell, k, tie) in enumerate(firsts)], "head long, head_tie long, before int, head_cell int")
    rows = rows.join(F.broadcast(heads), (F.col("k") == F.col("head")) & (F.col("tie") == F.col("head_tie")), "left")
    own, sent = F.struct(F.col("cell").alias("to"), F.lit(0).alias("late")), F.struct(F.col("before").alias("to"), F.lit(1).alias("late"))
    rows = rows.select(id_col, "k", "text", "cell", "tie", F.explode(F.when(F.col("before").isNull(), F.array(own)).otherwise(F.array(own, sent))).alias("x"))
    rows = rows.select(id_col, "k", "text", F.col("cell").alias("home"), F.col("x.to").alias("to"), F.col("x.late").alias("late"), "tie").where("to is not null")

    beside = Window.partitionBy("to").orderBy("late", "k", "tie")
    cut = F.length("text") - F.floor(F.length("text") / 4)
    following = F.lead(F.struct("text", "home", "late")).over(beside)
    rows = rows.withColumn("at", F.row_number().over(beside)).withColumn("following", following).where("late = 0")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), cut), F.substring(F.col("following.text"), F.lit(1), F.length("text") - cut))
    rows = rows.select("to", "at", id_col, "text", edited.alias("edited"), F.col("following.home").alias("next_to"), F.when(F.col("following.late") == 1, 1).otherwise(F.col("at") + 1).alias("next_at"))

    counts = [F.sum(F.when(F.col("late") == late, 1).otherwise(0)).alias(name) for late, name in ((0, "own"), (1, "new"))]
    sides = F.explode(F.array(F.struct(F.lit(0).alias("late"), F.col("text").alias("body")), F.struct(F.lit(1).alias("late"), F.col("edited").alias("body"))))
    # always true; since both branches read the same columns, the texts' one shuffle serves both
    terms = rows.where(F.col(id_col).isNotNull() | F.col("next_to").isNotNull()).select("to", "at", sides.alias("x")).select("to", "at", "x.late", F.explode(_words(F.col("x.body"))).alias("word"))
    counted = terms.where("word <> ''").groupBy("to", "at", F.xxhash64("word").alias("term")).agg(*counts)
    prints = sample_terms(counted, ["to", "at"], "term", ["own", "new"], samples)
    prints = prints.select("to", "at", "own", "new")
    facts = rows.select("to", "at", id_col, F.length("text").cast("long").alias("n_chars"), F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), "next_to", "next_at")
    empty = F.lit("")
    whole = facts.join(prints, ["to", "at"], "left").select("to", "at", id_col, "n_chars", "edited_sha256", "next_to", "next_at", F.coalesce("own", empty).alias("own"), F.coalesce("new", empty).alias("new"))
    whole = stored(whole, "fingerprints")
    nexts = whole.select(F.col("to").alias("next_to"), F.col("at").alias("next_at"), F.col("own").alias("next_own"))
    met = whole.join(nexts, ["next_to", "next_at"])
    return met.select(id_col, "n_chars", "edited_sha256", F.col("own").alias("fingerprint"), F.col("new").alias("edited_fingerprint"), likeness(F.col("own"), F.col("new"), samples).alias("near_edited"), likeness(F.col("own"), F.col("next_own"), samples).alias("near_next"))
