"""SimHash fingerprints of whole texts, exact links within a Hamming radius, and their components."""

from __future__ import annotations

from itertools import combinations
from math import log2

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reconlake.llm.components import components
from reconlake.llm.jaccard import similar_texts
from reconlake.llm.shared import frugal, stored

ROWS_PER_GROUP = 512
MOST_ROWS_PER_GROUP = 4096
TILE = 512
HASHES_AT_ONCE = 1 << 18
#: Bits by which the fingerprints of texts may differ that are then compared by their sets.
RADIUS_TO_CHECK = 8


def majority(hashes: np.ndarray) -> int:
    """The SimHash of 64-bit hashes as a signed integer: a bit is 1 if over half of them have it; none: 0."""
    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashes), HASHES_AT_ONCE):
        counts += np.unpackbits(hashes[i : i + HASHES_AT_ONCE].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(hashes), bitorder="little").tobytes(), "little", signed=True)


def simhash(text: bytes, words_per_shingle: int = 4, seed: int = 42) -> int:
    """64-bit SimHash: a bit is 1 if over half of the shingles' XXH64 have it; no words: 0.

    Words are separated by ASCII white space and A-Z are lower-cased; repeated shingles count repeatedly.
    """
    import xxhash

    words = text.lower().split()
    if not words:
        return 0
    line, digest = b" ".join(words), xxhash.xxh64_intdigest
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    k = min(words_per_shingle, len(words))
    starts, ends = starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist()
    counts = np.zeros(64, np.int64)
    for i in range(0, len(starts), HASHES_AT_ONCE):
        found = np.array([digest(line[a:z], seed) for a, z in zip(starts[i : i + HASHES_AT_ONCE], ends[i : i + HASHES_AT_ONCE], strict=True)], "<u8")
        counts += np.unpackbits(found.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(starts), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4) -> DataFrame:
    """`id_col` and `bits`, the SimHash as a signed 64-bit integer, of every text (null: empty)."""

    def hashed(batches):
        for batch in batches:
            bits = [simhash(x.as_buffer().to_pybytes() if x.is_valid else b"", words) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(bits, np.uint64).view(np.int64))], names=[id_col, "bits"])

    return docs.select(id_col, text_col).mapInArrow(frugal(hashed), f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, bits long")


def band_masks(rows: int, radius: int, rows_per_group: int = ROWS_PER_GROUP) -> list[int]:
    """Bit masks such that two fingerprints within `radius` bits agree under one of them at least.

    The 64 bits are cut into parts; any `radius` differing bits leave all parts but `radius` untouched, so one
    mask for each choice of that many parts suffices. The more rows, the more parts, and the longer the keys.
    Of a mask, only so many bits are kept as leave about `rows_per_group` rows to a key.
    """
    want = max(0, round(log2(max(1, rows) / rows_per_group)))
    parts = radius + 1
    while parts < 2 * radius and (64 * (parts - radius)) // parts + 4 < want:
        parts += 1
    edges = [64 * i // parts for i in range(parts + 1)]
    masks = []
    for chosen in combinations(range(parts), parts - radius):
        bits = [b for p in chosen for b in range(edges[p], edges[p + 1])]
        masks.append(sum(1 << b for b in bits[:want]))
    return masks


def linked(bits: np.ndarray, radius: int, tile: int = TILE) -> np.ndarray:
    """For each fingerprint, the least index linked to it through the array's own links.

    Fingerprints are compared tile by tile with exclusive-or and bit counts, in the order of their population
    counts; a pair of tiles whose counts differ by more than the radius is skipped.
    """
    ones = np.bitwise_count(bits)
    order = np.argsort(ones, kind="stable")
    bits, ones = bits[order], ones[order].astype(np.int64)
    label = np.arange(len(bits))
    for i in range(0, len(bits), tile):
        a = bits[i : i + tile]
        for j in range(i, len(bits), tile):
            if ones[j] - ones[min(i + tile, len(bits)) - 1] > radius:
                break
            near = np.bitwise_count(a[:, None] ^ bits[None, j : j + tile]) <= radius
            for row in np.flatnonzero(near.sum(axis=1) > (i == j)):
                joined = label[j + np.flatnonzero(near[row])]
                low = min(joined.min(), label[i + row])
                if joined.max() != low or label[i + row] != low:
                    label[np.isin(label, np.append(joined, label[i + row]))] = low
    root = order[label]
    out = np.empty(len(bits), np.int64)
    out[order] = root
    return out


def near_links(prints: DataFrame, radius: int = 4, rows_per_group: int = ROWS_PER_GROUP, most_rows: int = MOST_ROWS_PER_GROUP) -> DataFrame:
    """Edges (a, b) that connect all fingerprints `bits` (distinct rows) within `radius` bits, through chains of links.

    Rows meet under band masks (see `band_masks`), so nothing is lost and no row meets all others. A key with
    more than `most_rows` rows is dealt to tiles by a hash and each pair of tiles is compared in a task of its
    own. A group gives a spanning forest of its links, never all pairs.
    """
    masks = band_masks(prints.count(), radius, rows_per_group)
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    keys = F.array(*[F.struct(F.lit(t).alias("t"), F.col("bits").bitwiseAND(F.lit(m).cast("long")).alias("key")) for t, m in enumerate(signed)])
    rows = prints.select("bits", F.explode(keys).alias("k")).select("bits", "k.t", "k.key")
    large = rows.groupBy("t", "key").agg(F.count("*").alias("n")).where(F.col("n") > most_rows).select("t", "key", F.ceil(2 * F.col("n") / most_rows).cast("int").alias("tiles"))
    dealt = rows.join(large, ["t", "key"], "left").withColumn("tiles", F.coalesce("tiles", F.lit(1)))
    dealt = dealt.withColumn("u", F.pmod(F.xxhash64("bits"), F.col("tiles")).cast("int")).withColumn("v", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    dealt = dealt.select("t", "key", F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"), "bits")

    def compared(key, rows):
        bits = np.sort(rows["bits"].to_numpy())
        root = linked(bits.view(np.uint64), radius)
        own = np.flatnonzero(root != np.arange(len(bits)))
        return pa.table({"a": bits[own], "b": bits[root[own]]})

    return dealt.groupBy("t", "key", "u", "v").applyInArrow(compared, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, radius: int = 4, id_col: str = "doc_id", text_col: str = "text", words: int = 4) -> DataFrame:
    """Every document with its fingerprint and the least document id of its near-duplicate component.

    Fingerprints are worked out once and stored in the shared folder; equal ones are one node; links of different
    ones come from `near_links`, their components from star contractions. The copies of a text rejoin their node
    by an equi-join whose skewed keys Spark splits at run time.

    Texts without words (null too) have fingerprint zero and link like any other. A repeated row gives a row each.
    A row with a null id takes part in links but names no component; a component of such rows alone has a null
    id. Extra columns are ignored. An empty table gives an empty result.

    Returns: `id_col`, bits long, fingerprint (16 lower-case hexadecimal digits), component_id.
    """
    prints = stored(fingerprints(docs, id_col, text_col, words), "simhash-bits")
    nodes = stored(prints.groupBy("bits").agg(F.min(id_col).alias("least_id")), "simhash-nodes")
    roots = components(near_links(nodes.select("bits"), radius))
    rooted = nodes.join(roots, nodes["bits"] == roots["node"], "left").select("bits", "least_id", F.coalesce("root", "bits").alias("root"))
    named = rooted.groupBy("root").agg(F.min("least_id").alias("component_id"))
    classes = stored(rooted.join(named, "root").select("bits", "component_id"), "simhash-classes")
    return prints.join(classes, "bits").select(id_col, "bits", F.lpad(F.lower(F.hex("bits")), 16, "0").alias("fingerprint"), "component_id")


def keep_one_each(docs: DataFrame, radius: int = 4, id_col: str = "doc_id", text_col: str = "text", words: int = 4, similarity: float | None = None) -> DataFrame:
    """The documents without near duplicates: of each component the one with the least id stays.

    With a `similarity`, texts are linked by the exact Jaccard similarity of their shingles of `words` words (see
    `similar_texts`): SimHashes of their sets within RADIUS_TO_CHECK bits bring candidates, whose sets decide, and the radius is
    not used. Many such pairs differ in more bits than masks can cover; these are found by keys of the sets.

    Rows that repeat an id are one document, of which the least text stays. Rows with a null id can't be told
    apart by id: they all stay.
    """
    found = near_duplicates(docs, radius, id_col, text_col, words) if similarity is None else similar_texts(docs, words, similarity, id_col, text_col, fingerprint=majority, linked=lambda bits: near_links(bits, RADIUS_TO_CHECK))
    kept = stored(found.where(F.col(id_col) == F.col("component_id")).groupBy(F.col(id_col).alias("kept_id")).agg(F.count("*").alias("rows")), "simhash-kept")
    named = docs.join(kept, docs[id_col] == F.col("kept_id"))
    single = named.where("rows = 1").select(docs.columns)
    if kept.where("rows > 1").limit(1).count():
        repeated = named.where("rows > 1").select(docs.columns)
        rest = [c for c in docs.columns if c not in (id_col, text_col)]
        first = repeated.groupBy(id_col).agg(F.min_by(F.struct(*docs.columns), F.struct(text_col, *[F.col(c).cast("string") for c in rest])).alias("row"))
        single = single.unionByName(first.select("row.*"))
    return single.unionByName(docs.where(F.col(id_col).isNull()))
