"""Byte strings that occur twice anywhere in a corpus, by merging shards' Burrows-Wheeler transforms.

Every string of `length` bytes has an anchor, the substring of a third of it with the least hash. Consecutive strings with one
anchor make a segment, and equal strings have equal anchors, so only segments under one anchor need comparing. Segments
whose anchor occurs twice meet by an equi-join; equal ones are one segment with a count. A bucket of anchors is cut into
shards, each shard's suffixes are sorted and turned into a transform once, and the transforms are merged.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reconlake.llm.shared import blocks_for, frugal, ragged_take, stored

LENGTH = 200
#: Bytes of a text that are looked at together.
PIECE = 1 << 19
#: Bytes of a letter at most: the greatest divisor of the length up to this.
MOST_STEP = 24
#: Bytes of segments in a bucket of anchors (one task's group), positions merged at once, positions of a shard.
BUCKET_BYTES, MERGE, SHARD = 4 << 20, 1 << 16, 1 << 14
#: An anchor with more different segments is dealt to tiles; their strings meet by hashes.
MOST_SEGMENTS = 2048

_BASE = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


_BYTES = _mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))


def _powers(base: int, n: int) -> np.ndarray:
    found = np.full(n, base, np.uint64)
    found[0] = 1
    return np.multiply.accumulate(found)


class Segments:
    """Cuts texts into segments: stretches of strings of `length` bytes that have one anchor."""

    def __init__(self, length: int = LENGTH, piece: int = PIECE):
        self.length, self.anchor, self.piece = length, max(1, length // 3), max(piece, length)
        self.up, self.down = _powers(_BASE, self.piece + length), _powers(pow(_BASE, -1, 1 << 64), self.piece + length)

    def _piece(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first string, number of strings, anchor's hash) of the segments of at least `length` bytes."""
        a, wide = self.anchor, self.length - self.anchor + 1
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTES[data] * self.up[: len(data)], out=sums[1:])
        value = _mix((sums[a:] - sums[:-a]) * self.down[: len(data) - a + 1])
        # least hash, then leftmost: the place stands in the last bits
        bits = np.uint64(len(value).bit_length())
        least, have = (value >> bits << bits) | np.arange(len(value), dtype=np.uint64), 1
        while have < wide:
            more = min(have, wide - have)
            least = np.minimum(least[:-more], least[more:])
            have += more
        first = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
        place = least[first] & ((np.uint64(1) << bits) - np.uint64(1))
        return first, np.diff(first, append=len(least)), value[place.astype(np.int64)]

    def of(self, text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(first byte, number of strings, anchor's hash, hash of the segment's bytes) of a text's segments."""
        import xxhash

        found = []
        for begin in range(0, max(0, len(text) - self.length + 1), self.piece):
            first, run, value = self._piece(np.frombuffer(text, np.uint8, min(self.piece + self.length - 1, len(text) - begin), begin))
            found.append((first + begin, run, value))
        if not found:
            none = np.zeros(0, np.int64)
            return none, none, none, none
        first, run, value = (np.concatenate(x) for x in zip(*found, strict=True))
        whole, ends = xxhash.xxh3_64_intdigest, (first + run + (self.length - 1)).tolist()
        own = np.fromiter((whole(text[i:j], 1) for i, j in zip(first.tolist(), ends, strict=True)), np.uint64, len(ends))
        return first, run, value.view(np.int64), own.view(np.int64)


def stable_order(symbols: np.ndarray) -> np.ndarray:
    """A stable sorting permutation of small whole numbers; numpy sorts 16 bits by radix."""
    if symbols.dtype.itemsize <= 2:
        return np.argsort(symbols, kind="stable")
    low = np.argsort((symbols & 0xFFFF).astype(np.uint16), kind="stable")
    return low[np.argsort((symbols[low] >> 16).astype(np.uint16), kind="stable")]


class Collection:
    """Byte strings with their letters: blocks of `step` bytes at every place (2**32 places at most), named in their order.

    A suffix is read letter by letter, `step` bytes each. The last `step` places of a string, its end among them, have
    letters that no other place has, so all suffixes differ and end there.
    """

    def __init__(self, parts: list[bytes], step: int):
        self.step, self.sizes = step, np.array([len(p) for p in parts], np.int64)
        self.base = np.concatenate([[0], np.cumsum(self.sizes + 1)])
        n = int(self.base[-1])
        text = np.frombuffer(b"\0".join(parts) + bytes(1 + MOST_STEP), np.uint8)
        eights = np.ndarray(n + MOST_STEP - 7, np.dtype(">u8"), buffer=text, strides=(1,)) >> np.uint64(8 * max(0, 8 - step))
        self.part = np.repeat(np.arange(len(parts)), self.sizes + 1)
        self.offset = np.arange(n) - self.base[self.part]
        tail = self.offset > self.sizes[self.part] - step
        names = np.zeros(n, np.int64)
        whole = np.flatnonzero(~tail)
        if step > 8 and len(whole):
            # three blocks of eight bytes cover the letter; their names make a number, one after the other
            block = np.unique(eights, return_inverse=True)[1].astype(np.uint64)
            pair = np.unique(block[whole] << np.uint64(32) | block[whole + min(8, step - 8)], return_inverse=True)[1].astype(np.uint64)
            number = pair << np.uint64(32) | block[whole + step - 8]
        else:
            number = eights[whole]
        used, names[whole] = np.unique(number, return_inverse=True)
        names[tail] = len(used) + np.arange(tail.sum())
        self.letters = len(used) + int(tail.sum())
        self.names = names.astype(np.uint16 if self.letters <= 1 << 16 else np.uint32)

    def transform(self, first: int, past: int) -> tuple[np.ndarray, np.ndarray]:
        """Of the strings `first` to `past` - 1: their places in the order of suffixes, and the letter before each.

        Before a string's first letters stand its last ones. Suffixes are sorted by doubling the letters that ranks cover.
        """
        begin, end = int(self.base[first]), int(self.base[past])
        size, offset = self.sizes[self.part[begin:end]], self.offset[begin:end]
        at = np.arange(end - begin)
        rank, reach = self.names[begin:end].astype(np.uint64), self.step
        order = np.argsort(rank)
        while True:
            new = np.concatenate([[0], np.cumsum(rank[order[1:]] != rank[order[:-1]])])
            rank = np.empty(len(order), np.uint64)
            rank[order] = new
            if new[-1] == len(order) - 1:
                break
            further = offset + reach <= size
            key = rank << np.uint64(32)
            key[further] |= rank[at[further] + reach]
            rank, reach = key, 2 * reach
            order = np.argsort(rank)
        before = np.where(offset >= self.step, at - self.step, at + (size - offset) // self.step * self.step)
        return order + begin, self.names[begin:end][before[order]]


def merged(transforms: list[np.ndarray], rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """The merged order of the shards' suffixes by their first `rounds` letters, and their common prefixes.

    The interleave says which shard each place of the merged order takes its next suffix from; at first the shards stand one
    after the other. A round sorts the letters before the suffixes in the present order, stably: that is the order by one
    letter more. Within a shard the order never changes, so suffixes are never compared. Where a boundary appears in
    round h, the neighbours share h letters; two suffixes that no boundary has parted share `rounds` or more.

    Returns: indices into the shards' suffixes, one shard after the other; letters that each shares with the one before it.
    """
    letters = np.concatenate(transforms)
    n = len(letters)
    shard = np.repeat(np.arange(len(transforms)).astype(np.uint8 if len(transforms) <= 256 else np.uint32), [len(t) for t in transforms])
    taken, block = np.arange(n), np.zeros(n, np.int32)
    common = np.full(n, rounds, np.int32)
    common[:1] = 0
    for h in range(rounds):
        symbols = letters[taken]
        order = stable_order(symbols)
        symbols, block = symbols[order], block[order]
        parted = np.concatenate([[False], (symbols[1:] != symbols[:-1]) | (block[1:] != block[:-1])])
        common[parted & (common == rounds)] = h
        block = np.cumsum(parted, dtype=np.int32)
        shard = shard[order]
        taken[stable_order(shard)] = np.arange(n)
    return taken, common


def repeated_strings(parts: list[bytes], runs: np.ndarray, counts: np.ndarray, length: int = LENGTH, shard: int = SHARD) -> tuple[Collection, np.ndarray, np.ndarray]:
    """Which places of the parts begin a string of `length` bytes that occurs twice, and for each interval of equal strings a place.

    The first runs[i] places of part i count, counts[i] times. The parts are dealt to shards, whose transforms are merged;
    intervals of the merged order whose suffixes share `length` bytes hold equal strings.
    """
    step = next(s for s in range(MOST_STEP, 0, -1) if length % s == 0)
    held = Collection(parts, step)
    cuts = [0]
    while cuts[-1] < len(parts):
        cuts.append(max(cuts[-1] + 1, int(np.searchsorted(held.base, held.base[cuts[-1]] + shard, side="right")) - 1))
    shards = [held.transform(i, j) for i, j in zip(cuts[:-1], cuts[1:], strict=True)]
    taken, common = merged([t for _, t in shards], length // step)
    place = np.concatenate([order for order, _ in shards])[taken]
    interval = np.cumsum(common < length // step) - 1
    string = held.offset[place] < runs[held.part[place]]
    place, interval = place[string], interval[string]
    times = np.bincount(interval, weights=counts[held.part[place]])
    repeated = np.zeros(int(held.base[-1]), bool)
    repeated[place[times[interval] >= 2]] = True
    return held, repeated, place[np.unique(interval, return_index=True)[1]]


def _found(rows: pa.Table, length: int, merge: int, shard: int) -> pa.Table:
    """For a bucket's segments (m, s, n, run, hot, bytes) the stretches of repeated strings, and of hot anchors' tiles every different string once."""
    import xxhash

    rows = rows.sort_by([("m", "ascending"), ("s", "ascending")])
    m, s, n, run = (rows[c].to_numpy() for c in ("m", "s", "n", "run"))
    hot = bool(len(m)) and rows["hot"][0].as_py()
    parts = rows["bytes"].to_pylist()
    sizes = np.cumsum([len(p) + 1 for p in parts])
    groups = np.append(np.flatnonzero(np.diff(m, prepend=m[:1] - 1) != 0), len(m))
    out = {"m": [], "s": [], "first": [], "past": [], "w1": [], "w2": []}

    def tell(part, first, past, words=None):
        zero = np.zeros(len(part), np.int64)
        w = words if words is not None else (zero, zero)
        for name, values in zip(out, (m[part], s[part], first, past, *w), strict=True):
            out[name].append(np.asarray(values, np.int64))

    i = 0
    while i < len(groups) - 1:
        # whole groups of one anchor, as many as fit
        j = i + 1
        while j < len(groups) - 1 and sizes[groups[j + 1] - 1] - (sizes[groups[i] - 1] if groups[i] else 0) <= merge:
            j += 1
        low, high = int(groups[i]), int(groups[j])
        held, repeated, one_each = repeated_strings(parts[low:high], run[low:high], n[low:high].astype(np.float64), length, shard)
        edge = np.diff(repeated.astype(np.int8), prepend=0, append=0)
        starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        tell(low + held.part[starts], held.offset[starts], held.offset[starts] + ends - starts)
        if hot:
            words = [xxhash.xxh3_128_intdigest(parts[low + p][o : o + length]) for p, o in zip(held.part[one_each].tolist(), held.offset[one_each].tolist(), strict=True)]
            halves = tuple(np.array([w >> by & _MASK for w in words], np.uint64).view(np.int64) for by in (64, 0))
            tell(low + held.part[one_each], held.offset[one_each], held.offset[one_each] + 1, halves)
        i = j
    table = pa.table({k: pa.array(np.concatenate(v) if v else np.zeros(0, np.int64)) for k, v in out.items()})
    told = pa.array(np.concatenate([np.full(len(x), bool(k % 2) and hot) for k, x in enumerate(out["m"])]) if out["m"] else np.zeros(0, bool), pa.bool_())
    return table.append_column("across", told)


def _cut(docs: DataFrame, length: int, id_col: str, text_col: str, most_segments: int, merge: int, shard: int) -> tuple[DataFrame, DataFrame]:
    """(id, n_bytes, t1, t2, sha) of every row, and (t1, t2, spans, kept) of every different text that loses bytes."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    keyed = docs.select(F.col(id_col).alias("id"), text.alias("text"), F.xxhash64(F.lit(1), text).alias("t1"), F.xxhash64(F.lit(2), text).alias("t2"))
    rows = keyed.select("id", "text", "t1", "t2", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2(F.col("text").cast("binary"), 256).alias("sha"))

    def printed(batches):
        cut = Segments(length)
        kinds = {"first": pa.int64(), "run": pa.int32(), "m": pa.int64(), "s": pa.int64()}
        for batch in batches:
            own = [cut.of(x.as_buffer().to_pybytes()) for x in batch.column(1)]
            ends = pa.array(np.concatenate([[0], np.cumsum([len(x[0]) for x in own])]), pa.int32())
            lists = [pa.ListArray.from_arrays(ends, pa.array(np.concatenate([np.zeros(0, np.int64), *[x[k] for x in own]]), kind)) for k, kind in enumerate(kinds.values())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *batch.columns[2:], *lists], names=["id", "t1", "t2", "n_bytes", "sha", *kinds])

    kind = docs.schema[id_col].dataType.simpleString()
    prints = stored(rows.mapInArrow(frugal(printed), f"id {kind}, t1 long, t2 long, n_bytes long, sha string, first array<long>, run array<int>, m array<long>, s array<long>"), "suffix-prints")
    every = prints.select("t1", "t2", F.explode(F.arrays_zip("m", "s", "first", "run")).alias("x")).select("t1", "t2", "x.*")
    # stored, so that the join's sides are plain shuffles, whose skewed keys Spark splits
    again = stored(prints.select(F.explode("m").alias("m")).groupBy("m").agg(F.count("*").alias("times")).where("times > 1").select("m"), "suffix-again")
    met = stored(every.join(again, "m"), "suffix-met")

    # equal segments are one, with a count and one of its places
    segments = stored(met.groupBy("m", "s").agg(F.count("*").alias("n"), *[F.first(c).alias(c) for c in ("t1", "t2", "first", "run")]), "suffix-segments")
    texts = keyed.join(met.select("t1", "t2").distinct(), ["t1", "t2"], "left_semi").groupBy("t1", "t2").agg(F.first("text").alias("text"))
    texts = stored(texts, "suffix-texts")
    total = segments.agg(F.sum(F.col("run") + length)).first()[0] or 0
    large = stored(segments.groupBy("m").agg(F.ceil(F.count("*") / F.lit(most_segments)).cast("int").alias("tiles")).where("tiles > 1"), "suffix-hot")
    hot = F.col("tiles").isNotNull()
    dealt = segments.join(large, "m", "left").select(
        "m", "s", "n", "run", "t1", "t2", "first", hot.alias("hot"),
        F.when(hot, F.col("m")).otherwise(F.pmod(F.xxhash64("m"), F.lit(blocks_for(total, BUCKET_BYTES)))).alias("bucket"),
        F.when(hot, F.pmod(F.xxhash64("s"), F.col("tiles"))).otherwise(0).alias("tile"),
    )
    begun = F.substring(F.col("text").cast("binary"), (F.col("first") + 1).cast("int"), F.col("run") + (length - 1))
    whole = dealt.join(texts, ["t1", "t2"]).select("m", "s", "n", "run", "hot", "bucket", "tile", begun.alias("bytes"))

    def compared(key, rows):
        return _found(rows, length, merge, shard)

    found = stored(whole.groupBy("hot", "bucket", "tile").applyInArrow(compared, "m long, s long, first long, past long, w1 long, w2 long, across boolean"), "suffix-found")
    across = found.where("across")
    several = across.groupBy("w1", "w2").agg(F.count("*").alias("tiles")).where("tiles > 1").select("w1", "w2")
    repeated = found.where("NOT across").select("m", "s", "first", "past").unionByName(across.join(several, ["w1", "w2"], "left_semi").select("m", "s", "first", "past"))

    placed = met.join(repeated.toDF("m", "s", "from", "to"), ["m", "s"]).select("t1", "t2", (F.col("first") + F.col("from")).alias("start"), (F.col("first") + F.col("to") + (length - 1)).alias("past"))
    spans = placed.groupBy("t1", "t2").agg(F.collect_set(F.struct("start", "past")).alias("covered"))

    def kept(batches):
        for batch in batches:
            all_spans, all_kept = [], []
            for text, covered in zip(batch.column(2), batch.column(3), strict=True):
                data = np.frombuffer(text.as_buffer(), np.uint8) if len(text.as_buffer()) else np.zeros(0, np.uint8)
                start, past = (np.sort(covered.values.field(k).to_numpy()) for k in (0, 1))
                # sorted starts and ends of spans of whatever overlap: a run begins where as many have ended as begun
                open_at = np.concatenate([[True], start[1:] > past[:-1]])
                start, past = start[open_at], past[np.append(np.flatnonzero(open_at)[1:] - 1, len(past) - 1)]
                left = ragged_take(data, np.concatenate([[0], past]), np.append(start, len(data)) - np.concatenate([[0], past]))
                all_spans.append([{"start": i, "past": j} for i, j in zip(start.tolist(), past.tolist(), strict=True)])
                all_kept.append(left.tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(all_spans, pa.list_(pa.struct([("start", pa.int64()), ("past", pa.int64())]))), pa.array(all_kept, pa.binary())], names=["t1", "t2", "spans", "kept"])

    cut = texts.join(spans, ["t1", "t2"]).select("t1", "t2", "text", "covered").mapInArrow(frugal(kept), "t1 long, t2 long, spans array<struct<start:long,past:long>>, kept binary")
    return prints.select("id", "t1", "t2", "n_bytes", "sha"), cut


def repeated_spans(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text", most_segments: int = MOST_SEGMENTS, merge: int = MERGE, shard: int = SHARD) -> DataFrame:
    """For every document the spans of bytes that lie in a string of `length` bytes which begins anywhere else too.

    Strings never cross documents; the same document counts, so do overlapping places. Texts are read twice: once for
    anchors, once by an equi-join for those texts that share one. Of a segment that copies share, one travels.
    Segments with equal 64-bit hashes of anchor and of bytes are taken as equal, and texts with 128 equal bits.

    An anchor with more than `most_segments` different segments is dealt to tiles. Each is merged by itself, its different
    strings are told once each, and those that several tiles have are repeated as well: nothing is cut off or compared in pairs.

    A null text counts as empty. Null ids and repeated rows give a row each (rows that repeat are copies of each other); other
    columns are ignored; an empty table gives an empty result.

    Returns: `id_col`, n_bytes long, spans array of (start, past), kept_sha256 of what is left.
    """
    prints, cut = _cut(docs, length, id_col, text_col, most_segments, merge, shard)
    cut = cut.select("t1", "t2", "spans", F.sha2("kept", 256).alias("kept_sha"))
    none = F.array().cast("array<struct<start:long,past:long>>")
    return prints.join(cut, ["t1", "t2"], "left").select(F.col("id").alias(id_col), "n_bytes", F.coalesce("spans", none).alias("spans"), F.coalesce("kept_sha", "sha").alias("kept_sha256"))


def without_repeats(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`id_col` and kept, what `repeated_spans` leaves of every text, as bytes: a cut may part a character."""
    _, cut = _cut(docs, length, id_col, text_col, MOST_SEGMENTS, MERGE, SHARD)
    text = F.coalesce(F.col(text_col), F.lit(""))
    keyed = docs.select(F.col(id_col).alias("id"), text.cast("binary").alias("whole"), F.xxhash64(F.lit(1), text).alias("t1"), F.xxhash64(F.lit(2), text).alias("t2"))
    return keyed.join(cut, ["t1", "t2"], "left").select(F.col("id").alias(id_col), F.coalesce("kept", "whole").alias("kept"))
