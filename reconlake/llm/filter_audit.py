"""How the filters of a corpus interact: what each of them removes in every order, from one scan of the texts."""

from __future__ import annotations

from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reconlake.llm.shared import byte_buffer, frugal, stored, text_slices

#: Too short, too repetitive, too many capitals, symbols, copy of an earlier document: bits 0 to 4 of a mask.
FILTERS = "ABCDE"
SPACES, CAPITALS, SYMBOLS = b" \t\n\v\f\r", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"#$%&*|"
SLICE_BYTES = 4 << 20
#: Longer words are hashed one by one.
MOST_PARTS = 8

_MIX = np.uint64(0x9E3779B97F4A7C15)


def _members(of: bytes) -> np.ndarray:
    found = np.zeros(256, bool)
    found[list(of)] = True
    return found


_SPACE, _CAPITAL, _SYMBOL = _members(SPACES), _members(CAPITALS), _members(SYMBOLS)
#: UTF-8 bytes that begin a code point.
_FIRST = (np.arange(256) & 0xC0) != 0x80


def _sums(found: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many of `found` lie in each text, by prefix sums."""
    sums = np.concatenate([[0], np.cumsum(found)])
    return sums[offsets[1:]] - sums[offsets[:-1]]


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of the texts begin and end; no word crosses the end of its text."""
    inside = ~_SPACE[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    cuts = offsets[:-1][np.diff(offsets) > 0]
    first[cuts] = inside[cuts]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    last[cuts[1:] - 1] = inside[cuts[1:] - 1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def _eights(data: np.ndarray) -> np.ndarray:
    """For each byte the eight bytes from it on, as a number; zeros follow the last one."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    return np.ndarray(len(data) + 1, np.dtype("<u8"), buffer=padded, strides=(1,))


def _part(eights: np.ndarray, starts: np.ndarray, lengths: np.ndarray, i: int) -> np.ndarray:
    """Bytes 8 * i to 8 * i + 7 of the words, zeros behind their ends."""
    left = np.clip(lengths - 8 * i, 0, 8)
    some = eights[np.where(left > 0, starts + 8 * i, 0)]
    return np.where(left > 0, some & (np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(8) * (8 - np.maximum(left, 1)).astype(np.uint64))), np.uint64(0))


def distinct_words(data: np.ndarray, offsets: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """How many different words each text has, by sorted hashes of (text, word) whose equals are compared byte by byte.

    A text in which two different words have one hash is counted by its words themselves.
    """
    import xxhash

    n, lengths = len(offsets) - 1, ends - starts
    text = np.searchsorted(offsets[1:], starts, side="right")
    eights, parts = _eights(data), np.minimum((lengths + 7) // 8, MOST_PARTS)
    key = (text.astype(np.uint64) * _MIX) ^ lengths.astype(np.uint64)
    for i in range(int(parts.max(initial=0))):
        at = np.flatnonzero(parts > i) if i else slice(None)
        mixed = (key[at] ^ _part(eights, starts[at], lengths[at], i)) * _MIX
        key[at] = mixed ^ (mixed >> np.uint64(29))
    large = np.flatnonzero(lengths > 8 * MOST_PARTS)
    for i in large.tolist():
        key[i] = xxhash.xxh64_intdigest(data[starts[i] : ends[i]].tobytes(), int(text[i]))
    order = np.argsort(key)
    key = key[order]
    same = np.flatnonzero(key[1:] == key[:-1])
    a, b = order[same], order[same + 1]
    equal = (text[a] == text[b]) & (lengths[a] == lengths[b])
    for i in range(int(parts[a].max(initial=0))):
        at = np.flatnonzero(equal & (parts[a] > i))
        equal[at] = _part(eights, starts[a[at]], lengths[a[at]], i) == _part(eights, starts[b[at]], lengths[b[at]], i)
    for i in np.flatnonzero(equal & (lengths[a] > 8 * MOST_PARTS)).tolist():
        equal[i] = data[starts[a[i]] : ends[a[i]]].tobytes() == data[starts[b[i]] : ends[b[i]]].tobytes()
    found = np.bincount(text, minlength=n) - np.bincount(text[a[equal]], minlength=n)
    for i in np.unique(np.concatenate([text[a[~equal]], text[b[~equal]]])).tolist():
        found[i] = len(set(data[offsets[i] : offsets[i + 1]].tobytes().split()))
    return found


def text_masks(data: np.ndarray, offsets: np.ndarray, min_words: int = 200, distinct_percent: int = 50, capital_percent: int = 2) -> np.ndarray:
    """For each text the bits of the filters A to D that it fails."""
    starts, ends = word_bounds(data, offsets)
    words = np.searchsorted(starts, offsets[1:]) - np.searchsorted(starts, offsets[:-1])
    distinct = distinct_words(data, offsets, starts, ends)
    fails = [
        words < min_words,
        100 * distinct < distinct_percent * words,
        100 * _sums(_CAPITAL[data], offsets) > capital_percent * _sums(_FIRST[data], offsets),
        _sums(_SYMBOL[data], offsets) > 0,
    ]
    return sum(f.astype(np.int32) << i for i, f in enumerate(fails))


def failure_masks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source", **limits: int) -> DataFrame:
    """(doc_id, part, mask) of every document: one scan of the Arrow buffers for A to D, an equi-join of text hashes for E.

    Texts are taken as identical if 128 bits of hashes are equal. Only hashes that several rows have are joined
    back. The least id of such a text doesn't fail E, nor do rows that repeat it, nor rows without an id.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), F.xxhash64(F.lit(1), text).alias("t1"), F.xxhash64(F.lit(2), text).alias("t2"))

    def scanned(batches):
        for batch in batches:
            data, offsets = byte_buffer(batch.column(1))
            masks = [text_masks(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], **limits) for i, j in text_slices(offsets, SLICE_BYTES)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *batch.columns[2:], pa.array(np.concatenate([[], *masks]).astype(np.int32))], names=["doc_id", "part", "t1", "t2", "mask"])

    facts = stored(rows.mapInArrow(frugal(scanned), f"doc_id {docs.schema[id_col].dataType.simpleString()}, part string, t1 long, t2 long, mask int"), "filter-facts")
    several = facts.groupBy("t1", "t2").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")).where("n > 1").select("t1", "t2", "least")
    copy = F.coalesce(F.col("doc_id") > F.col("least"), F.lit(False)).cast("int")
    return facts.join(several, ["t1", "t2"], "left").select("doc_id", "part", F.col("mask").bitwiseOR(F.shiftleft(copy, FILTERS.index("E"))).alias("mask"))


def _grid(spark: SparkSession) -> DataFrame:
    """What each mask counts for at each step of each order: 120 * 5 * 32 rows, whatever the data."""
    rows = []
    for order in permutations(range(len(FILTERS))):
        name, before = "".join(FILTERS[f] for f in order), 0
        for step, f in enumerate(order, 1):
            own = 1 << f
            for m in range(1 << len(FILTERS)):
                fails, gone = bool(m & own), bool(m & before)
                rows.append((m, name, step, not fails and not gone, fails and not gone, fails and gone, m == own))
            before |= own
    return spark.createDataFrame(rows, "mask int, filter_order string, step int, stays boolean, goes boolean, again boolean, alone boolean")


def filter_audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source", **limits: int) -> DataFrame:
    """What five filters remove from each part of the corpus, for all 120 orders and each of their steps.

    A document is reduced to a mask of the filters that it fails, parts to counts of masks (32 a part at most); orders are
    worked out from these counts, so the texts are scanned once. A null text counts as empty, a null part as the
    empty one; repeated rows are documents of their own; a document is good or toxic if any of its labels says so;
    a null id has no label. Other columns are ignored. An empty table gives an empty result.

    Returns: part, filter_order, step int, and as long: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.
    """
    masks = failure_masks(docs, id_col, text_col, part_col, **limits)
    marked = labels.where("quality = 1 or toxic = 1").groupBy(F.col("doc_id").alias("labelled")).agg(F.max(F.expr("if(quality = 1, 1, 0)")).alias("good"), F.max(F.expr("if(toxic = 1, 1, 0)")).alias("toxic"))
    counts = masks.join(marked, masks["doc_id"] == marked["labelled"], "left").groupBy("part", "mask").agg(F.count("*").alias("n"), F.sum("good").alias("good"), F.sum("toxic").alias("toxic"))

    def total(of: str, when: str):
        return F.coalesce(F.sum(F.when(F.col(when), F.col(of))), F.lit(0)).cast("long")

    steps = counts.join(_grid(docs.sparkSession), "mask").groupBy("part", "filter_order", "step").agg(
        total("n", "stays").alias("kept"), total("n", "goes").alias("removed"), total("n", "again").alias("redundant"), total("n", "alone").alias("unique_fails"),
        total("good", "goes").alias("good_lost"), total("toxic", "goes").alias("toxic_lost"), F.substring("filter_order", F.col("step"), F.lit(1)).alias("filter"),
    )
    share = steps.groupBy("part", "filter").agg(F.sum("removed").alias("shapley"))
    return steps.join(share, ["part", "filter"]).select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
