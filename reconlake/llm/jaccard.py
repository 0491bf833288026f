"""Links of texts by the Jaccard similarity of their word shingles: keys bring candidates together, bit tiles decide."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reconlake.llm.components import components
from reconlake.llm.shared import frugal, stored, text_slices

#: A set's keys: one for each part of the hash space, of the least hashes in it. At a similarity of 0.8 a part's keys agree
#: with a chance of 0.8**4 = 0.41 at least, so that of 32 none does once in 2e7 times, and more seldom for small or more similar sets.
PARTS, LEAST = 32, 4
#: Groups with more sets are compared in tiles.
SMALL_GROUP = 32
#: Large groups are first looked at under one key in so many.
KEYS_TO_CONNECT = 4
#: Sets in a tile of a large group.
TILE_SETS = 2048
#: Bits of a set's sketch.
SKETCH = 2048
#: A pair is near without a look at the sets if a less similar one would seem so with a deviation of so many sigmas, and bits.
SIGMAS, SPARE_BITS = 6, 8
#: Bytes of texts whose sets are held together.
SLICE_BYTES = 2 << 20
#: Slots of the bit set of ids whose texts are needed once more.
SLOTS = 1 << 23

_MIX = np.uint64(0x9E3779B97F4A7C15)


def shingle_set(text: bytes, words_per_shingle: int) -> np.ndarray:
    """The distinct XXH64 hashes of a text's shingles, ascending; a text of fewer words is one shingle, no words: none."""
    import xxhash

    words = text.lower().split()
    if not words:
        return np.empty(0, np.int64)
    line, digest = b" ".join(words), xxhash.xxh64_intdigest
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    k = min(words_per_shingle, len(words))
    spans = zip(starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True)
    return np.unique(np.fromiter((digest(line[a:z], 42) for a, z in spans), np.uint64, len(words) - k + 1).view(np.int64))


def part_keys(shingles: np.ndarray) -> np.ndarray:
    """A key for each part of the hash space that the set has a hash in: of its LEAST least hashes there."""
    if not len(shingles):
        return shingles
    starts = np.searchsorted(shingles, np.linspace(-(2.0**63), 2.0**63, PARTS + 1)[:-1].astype(np.int64))
    ends = np.append(starts[1:], len(shingles))
    at = starts[:, None] + np.arange(LEAST)
    least = np.where(at < ends[:, None], shingles[np.minimum(at, len(shingles) - 1)].view(np.uint64), np.uint64(0))
    key = np.arange(PARTS, dtype=np.uint64)
    for i in range(LEAST):
        key = (key ^ least[:, i]) * _MIX
        key ^= key >> np.uint64(31)
    return key.view(np.int64)[ends > starts]


def sketch(shingles: np.ndarray) -> bytes:
    """A bit for each value of the hashes' last bits: is the number of them odd? Sets differ in as many shingles as bits, or more."""
    return np.packbits(np.bincount(shingles & (SKETCH - 1), minlength=SKETCH).astype(np.uint8) & 1).tobytes()


def most_apart(total: np.ndarray, similarity: float) -> np.ndarray:
    """In how many shingles sets with `total` shingles together can differ at most if they are as similar."""
    return total * (1 - similarity) / (1 + similarity) + 1e-6


def sure_bits(total: np.ndarray, similarity: float) -> np.ndarray:
    """Up to how many differing bits of their sketches sets with `total` shingles together are as similar for certain.

    If they differed in more shingles than `most_apart`, each further one would turn a bit drawn anew, and so few bits
    would be less likely than SIGMAS and SPARE_BITS allow. Small sets are never certain.
    """
    d = np.floor(most_apart(total, similarity)) + 1
    one, two = (1 - 2 / SKETCH) ** d, (1 - 4 / SKETCH) ** d
    spread = SKETCH / 4 * (1 - one**2) + SKETCH * (SKETCH - 1) / 4 * (two - one**2)
    return SKETCH / 2 * (1 - one) - SIGMAS * np.sqrt(np.maximum(spread, 0)) - SPARE_BITS


def judged(differing: np.ndarray, total: np.ndarray, similarity: float) -> np.ndarray:
    """2: as similar, 0: not, 1: only the sets can tell."""
    return np.where(differing > most_apart(total, similarity), 0, np.where(differing <= sure_bits(total, similarity), 2, 1))


def _hashed(batches, words: int):
    """For (key, text) batches the keys, the nodes (a hash of the set) and the sets."""
    import xxhash

    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False)
        for first, past in text_slices(np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)]), SLICE_BYTES):
            part = batch.slice(first, past - first)
            sets = [shingle_set(x.as_buffer().to_pybytes() if x.is_valid else b"", words) for x in part.column(1)]
            node = [xxhash.xxh64_intdigest(s.tobytes(), 7) for s in sets]
            yield part.column(0), np.array(node, np.uint64).view(np.int64), sets


def _bits(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(-1, SKETCH // 64)


def _screened(pairs: DataFrame, sketches: DataFrame, similarity: float) -> DataFrame:
    """(a, b, verdict) of the pairs that aren't ruled out, by exclusive-or and bit counts of their sketches."""
    both = pairs.join(sketches.toDF("a", "n_a", "of_a"), "a").join(sketches.toDF("b", "n_b", "of_b"), "b")

    def compared(batches):
        for batch in batches:
            differing = np.bitwise_count(_bits(batch.column("of_a")) ^ _bits(batch.column("of_b"))).sum(axis=1, dtype=np.int64)
            verdict = judged(differing, batch.column("n_a").to_numpy() + batch.column("n_b").to_numpy(), similarity)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(verdict, pa.int32())], names=["a", "b", "verdict"]).filter(pa.array(verdict > 0))

    return both.mapInArrow(frugal(compared), "a long, b long, verdict int")


def _cover(verdict: np.ndarray) -> np.ndarray:
    """Places of some candidates, one for a row at most: a row without one yet becomes the centre of all its others without one."""
    covered, kept = np.zeros(len(verdict), bool), []
    both = np.maximum(verdict, verdict.T) > 0
    for i in np.flatnonzero(both.any(axis=1)):
        if not covered[i]:
            near = np.flatnonzero(both[i] & ~covered)
            covered[near] = covered[i] = True
            kept.append(np.stack([np.full(len(near), i), near], axis=1))
    return np.concatenate(kept) if kept else np.zeros((0, 2), np.int64)


def _tiled(rows: DataFrame, similarity: float, tile_sets: int, cover: bool) -> DataFrame:
    """The same for the sets (key, node, n, root, of) of each key that have different roots.

    A key's sets are dealt to tiles by a hash, and each pair of tiles is compared in a task of its own, a block of
    rows at a time, without the blocks whose sizes rule each other out. With `cover`, only so many pairs are given
    as connect each set to a centre; without, all that aren't ruled out, but of near ones one for each two roots.
    """
    sizes = rows.groupBy("key").agg(F.ceil(2 * F.count("*") / tile_sets).cast("int").alias("tiles"))
    dealt = rows.join(sizes, "key").withColumn("u", F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int")).withColumn("v", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    dealt = dealt.select("key", F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"), "node", "n", "root", "of")

    def compared(key, rows):
        rows = rows.sort_by([("n", "ascending"), ("node", "ascending")])
        node, n, root, bits = rows["node"].to_numpy(), rows["n"].to_numpy(), rows["root"].to_numpy(), _bits(rows["of"])
        found, block = np.zeros((len(n), len(n)), np.int8), max(1, (1 << 22) // max(1, len(n) * SKETCH // 64))
        for i in range(0, len(n), block):
            past = int(np.searchsorted(n, n[min(i + block, len(n)) - 1] / similarity + 1e-6, side="right"))
            differing = np.bitwise_count(bits[i : i + block, None] ^ bits[None, i:past]).sum(axis=2, dtype=np.int64)
            verdict = judged(differing, n[i : i + block, None] + n[None, i:past], similarity)
            verdict[root[i : i + block, None] == root[None, i:past]] = 0
            verdict[np.tril_indices(len(verdict), m=verdict.shape[1])] = 0
            found[i : i + block, i:past] = verdict
        x, y = _cover(found).T if cover else np.nonzero(found)
        verdict = np.maximum(found[x, y], found[y, x]).astype(np.int32)
        out = pa.table({"a": np.minimum(node[x], node[y]), "b": np.maximum(node[x], node[y]), "verdict": verdict})
        if cover:
            return out
        low, high = np.minimum(root[x], root[y]), np.maximum(root[x], root[y])
        first = np.unique(np.stack([low, high, np.where(verdict == 2, 0, np.arange(1, len(x) + 1))]), axis=1, return_index=True)[1]
        return out.take(pa.array(first))

    return dealt.groupBy("key", "u", "v").applyInArrow(compared, "a long, b long, verdict int").distinct()


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Those of the pairs (a, b) whose sets are as similar."""
    both = pairs.join(sets.toDF("a", "of_a"), "a").join(sets.toDF("b", "of_b"), "b")

    def compared(batches):
        for batch in batches:
            near = []
            for x, y in zip(batch.column("of_a"), batch.column("of_b"), strict=True):
                x, y = (s.values.to_numpy(zero_copy_only=False) for s in (x, y))
                common = len(np.intersect1d(x, y, assume_unique=True))
                near.append(common >= similarity * (len(x) + len(y) - common) - 1e-9)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(near, pa.bool_()))

    return both.mapInArrow(frugal(compared), "a long, b long")


def fingerprint_pairs(nodes: DataFrame, linked: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Pairs (x, y) of the nodes (node, n, bits), as structs (n, node), that connect equal fingerprints and those that `linked` finds near."""
    least = stored(nodes.groupBy("bits").agg(F.min(F.struct("n", "node")).alias("x")), "simhash-nodes")
    equal = nodes.join(least, "bits").where(F.col("node") != F.col("x.node")).select("x", F.struct("n", "node").alias("y"))
    other = least.select(F.col("bits").alias("b"), F.col("x").alias("y"))
    return equal.unionByName(linked(least.select("bits")).join(least.withColumnRenamed("bits", "a"), "a").join(other, "b").select("x", "y"))


def similar_texts(docs: DataFrame, words: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text", small: int = SMALL_GROUP, tile_sets: int = TILE_SETS, fingerprint: Callable[[np.ndarray], int] | None = None, linked: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Every document with the least document id of its component of texts with a Jaccard similarity of `similarity` or more.

    Texts with equal sets are one node. Nodes with an equal key (see `part_keys`) are candidates; at 0.8 or more a pair
    without one is less likely than one in ten million. Candidates are compared by sketches of 2,048 bits, with
    exclusive-or and bit counts: many differing bits rule a pair out for certain, few make it near, and whatever lies
    between is decided by the whole sets, so no link depends on an estimate. First one set of a key meets the
    key's others, which connects copies of a text; then those of a key that are still in different components meet,
    pair by pair in groups of up to `small` nodes, in tiles in larger ones: there first as many pairs as connect each
    set to a centre are looked at, under one key in four, and then all that are left under any key.

    With a `fingerprint` of a set's hashes and a function that gives the edges (a, b) of near fingerprints (`linked`), those are
    candidates of the first round, checked like the others; the keys find the pairs whose fingerprints lie farther apart.

    Nulls and empty texts are alike; ids are treated as in `near_duplicates`. Returns: `id_col`, component_id.
    """
    if not 0.5 <= similarity <= 1:
        raise ValueError("the keys are made for similarities from 0.5 to 1")
    kind = docs.schema[id_col].dataType.simpleString()

    def printed(batches):
        for ids, node, sets in _hashed(batches, words):
            out = [ids, pa.array(node), pa.array([len(s) for s in sets], pa.int64()), pa.array([sketch(s) for s in sets], pa.binary()), pa.array([part_keys(s) for s in sets], pa.list_(pa.int64())), pa.array([fingerprint(s) if fingerprint else 0 for s in sets], pa.int64())]
            yield pa.RecordBatch.from_arrays(out, names=[id_col, "node", "n", "of", "keys", "bits"])

    prints = stored(docs.select(id_col, text_col).mapInArrow(frugal(printed), f"`{id_col}` {kind}, node long, n long, of binary, keys array<long>, bits long"), "jaccard-prints")
    nodes = stored(prints.groupBy("node", "n").agg(F.min(id_col).alias("least_id"), F.first("keys").alias("keys"), F.first("bits").alias("bits")), "jaccard-nodes")
    rows = nodes.select("node", "n", F.explode("keys").alias("key"))
    shared = rows.groupBy("key").agg(F.count("*").alias("size"), F.min(F.struct(F.xxhash64("node").alias("drawn"), "n", "node")).alias("first")).where("size > 1")
    met = stored(rows.join(shared, "key"), "jaccard-groups")
    fits = F.least("x.n", "y.n") >= F.lit(similarity) * F.greatest("x.n", "y.n") - 1e-9
    ends = [F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")]
    stars = met.select(F.struct("first.n", "first.node").alias("x"), F.struct("n", "node").alias("y"))
    stars = stars.unionByName(fingerprint_pairs(nodes.select("node", "n", "bits"), linked)) if linked else stars
    stars = stars.where(fits & (F.col("x.node") != F.col("y.node"))).select(*ends)
    slot = F.pmod(F.xxhash64(id_col), F.lit(SLOTS)).cast("int")

    def sketches_of(wanted: DataFrame) -> DataFrame:
        return stored(prints.select("node", "n", "of").join(wanted, "node", "left_semi").groupBy("node", "n").agg(F.first("of").alias("of")), "jaccard-sketches")

    def links(found: DataFrame) -> DataFrame:
        """The pairs that are near: the sure ones, and of the others those whose sets say so."""
        found = stored(found, "jaccard-pairs")
        unsure = found.where("verdict = 1").select("a", "b")
        needed = nodes.join(unsure.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "node", "left_semi")
        # a bit set of hashed ids instead of a join: the texts aren't shuffled, and some sets too many cost little
        named = needed.where(F.col("least_id").isNotNull()).select(F.col("least_id").alias(id_col)).select(slot.alias("slot")).distinct().toArrow()
        wanted = np.zeros(SLOTS, np.uint8)
        wanted[named.column("slot").to_numpy()] = 1
        wanted = np.packbits(wanted)

        def whole(batches):
            for batch in batches:
                at = batch.column(2).to_numpy(zero_copy_only=False)
                asked = (wanted[at >> 3] >> (7 - (at & 7)) & 1).astype(bool) | batch.column(0).is_null().to_numpy(zero_copy_only=False)
                for _, node, sets in _hashed([batch.filter(pa.array(asked, pa.bool_()))], words):
                    yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(sets, pa.list_(pa.int64()))], names=["node", "shingles"])

        sets = docs.select(id_col, text_col, slot.alias("slot")).mapInArrow(frugal(whole), "node long, shingles array<long>")
        sets = stored(sets.groupBy("node").agg(F.first("shingles").alias("shingles")), "jaccard-sets")
        return stored(found.where("verdict = 2").select("a", "b").unionByName(_verified(unsure, sets, similarity)), "jaccard-edges")

    def screened(pairs: DataFrame) -> DataFrame:
        return _screened(pairs, sketches_of(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()), similarity)

    stars = stored(stars.distinct(), "jaccard-stars")
    edges = links(screened(stars))
    roots = components(edges)

    def still_open(roots: DataFrame) -> DataFrame:
        """The rows, with their roots, of keys whose sets are in several components."""
        rooted = stored(met.select("key", "size", "node", "n").join(roots, "node", "left").select("key", "size", "node", "n", F.coalesce("root", "node").alias("root")), "jaccard-rooted")
        several = rooted.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("key")
        return stored(rooted.join(several, "key", "left_semi"), "jaccard-open")

    def tiled(left: DataFrame, cover: bool) -> DataFrame:
        of = sketches_of(left.select("node").distinct())
        return _tiled(left.join(of.select("node", "of"), "node").select("key", "node", "n", "root", "of"), similarity, tile_sets, cover)

    left = still_open(roots)
    few = left.where(F.col("size") <= small).groupBy("key").agg(F.array_sort(F.collect_list(F.struct("n", "node", "root"))).alias("members"))
    few = few.groupBy(F.xxhash64("members").alias("group")).agg(F.first("members").alias("members"))
    dealt = few.select("members", F.posexplode("members").alias("at", "x"))
    within = dealt.select("x", F.explode(F.slice("members", F.col("at") + 2, F.lit(small))).alias("y")).where(fits & (F.col("x.root") != F.col("y.root"))).select(*ends)
    # pairs of the first round were compared then
    found = screened(stored(within.distinct().join(stars, ["a", "b"], "left_anti"), "jaccard-within"))
    many = left.where(F.col("size") > small)
    more = many.limit(1).count() > 0
    # similar sets share many keys: a part of them is enough to connect most
    some = many.where(F.pmod(F.xxhash64("key"), F.lit(KEYS_TO_CONNECT)) == 0)
    edges = edges.unionByName(links(found.unionByName(tiled(some, True)).distinct() if more else found))
    roots = components(edges)
    if more:
        left = still_open(roots).where(F.col("size") > small)
        edges = edges.unionByName(links(tiled(left, False)))
        roots = components(edges)
    rooted = nodes.select("node", "least_id").join(roots, "node", "left").select("node", "least_id", F.coalesce("root", "node").alias("root"))
    named = rooted.groupBy("root").agg(F.min("least_id").alias("component_id"))
    classes = stored(rooted.join(named, "root").select("node", "component_id"), "jaccard-classes")
    return prints.select(id_col, "node").join(classes, "node").select(id_col, "component_id")
