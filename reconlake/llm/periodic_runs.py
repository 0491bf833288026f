"""Maximal periodic runs of words: aligned blocks found again at their scale's distances are seeds, extended exactly."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reconlake.llm.shared import frugal

#: A run has this many words at least, and two periods.
LEAST_WORDS = 12
#: Words of blocks in one automaton, where blocks are shorter.
CHUNK_WORDS = 1 << 16

_MIX = np.uint64(0x9E3779B97F4A7C15)


def numbered(words: list) -> np.ndarray:
    """The words as small numbers, equal ones alike."""
    known: dict = {}
    return np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))


def scales(ids: np.ndarray, least: int = LEAST_WORDS) -> list[int]:
    """The block lengths b for which a run with a period from 2 * b - 1 to 4 * b - 2 is possible at all.

    In a run of `least` words with two periods, `least` // 2 words in a row are met again one period later. So a period's
    scale needs such a row twice, not farther apart at the least, nor nearer at the most, than its distances.
    """
    row = least // 2
    n = len(ids) - row + 1
    if n < 2:
        return []
    key = np.zeros(n, np.uint64)
    for i in range(row):
        key = (key ^ ids[i : i + n].astype(np.uint64)) * _MIX
        key ^= key >> np.uint64(31)
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    if not same.any():
        return []
    first = np.concatenate([[True], ~same])
    starts = np.flatnonzero(first)
    ends = np.append(starts[1:], n) - 1
    nearest = int((order[1:] - order[:-1])[same].min())
    farthest = int((order[ends] - order[starts]).max())
    found, b = [], 1
    while 2 * b - 1 <= min(farthest, len(ids) // 2):
        if nearest <= 4 * b - 2:
            found.append(b)
        b *= 2
    return found


def block_seeds(ids: np.ndarray, b: int, chunk_words: int = CHUNK_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(x, d): the aligned block of b words at x is found again at x + d, d from 2 * b - 1 to 4 * b - 2.

    The blocks of a chunk are the keys of an automaton over number sequences; it reads the chunk and as far behind as
    the distances reach, so memory is bounded by the chunk, or by a few blocks where they are longer.
    """
    import ahocorasick

    low, high = 2 * b - 1, 4 * b - 2
    step = max(b, chunk_words // b * b)
    xs, ds = [], []
    for begin in range(0, len(ids) - b - low + 1, step):
        starts = range(begin, min(begin + step, len(ids) - b - low + 1), b)
        words = ids[begin : starts[-1] + high + b].tolist()
        automaton, places = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE), []
        number: dict = {}
        for x in starts:
            block = tuple(words[x - begin : x - begin + b])
            places.append(number.setdefault(block, len(number)))
        for block, i in number.items():
            automaton.add_word(block, i)
        automaton.make_automaton()
        met = np.array([(end, i) for end, i in automaton.iter(tuple(words))], np.int64).reshape(-1, 2)
        at, block = met[:, 0] - b + 1 + begin, met[:, 1]
        # blocks sorted by (content, place); of each occurrence those at a fitting distance before it
        width = len(ids) + high + 1
        own = np.sort(np.array(places, np.int64) * width + np.arange(starts[0], starts[-1] + 1, b))
        first = np.searchsorted(own, block * width + np.maximum(at - high, 0))
        past = np.searchsorted(own, block * width + np.maximum(at - low + 1, 0))
        n = np.maximum(past - first, 0)
        pairs = np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())
        x = own[pairs] % width
        xs.append(x)
        ds.append(np.repeat(at, n) - x)
    return (np.concatenate(xs), np.concatenate(ds)) if xs else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def extended(ids: np.ndarray, x: int, d: int, b: int) -> tuple[int, int]:
    """The longest stretch [start, past) around the words x to x + d + b in which words d apart are identical."""
    start, past, size = x, x + d + b, 16
    while start > 0:
        low = max(0, start - size)
        differ = np.flatnonzero(ids[low:start] != ids[low + d : start + d])
        if len(differ):
            start = low + int(differ[-1]) + 1
            break
        start, size = low, 2 * size
    size = 16
    while past < len(ids):
        high = min(len(ids), past + size)
        differ = np.flatnonzero(ids[past:high] != ids[past - d : high - d])
        if len(differ):
            past += int(differ[0])
            break
        past, size = high, 2 * size
    return start, past


def periodic_runs(ids: np.ndarray, least: int = LEAST_WORDS, chunk_words: int = CHUNK_WORDS) -> list[tuple[int, int, int]]:
    """(start, length, period) of every maximal run, by start, then period.

    A run is a stretch with smallest period q, of max(`least`, 2 * q) words or more, that no neighbouring word extends.
    If 2 * b - 1 <= q < 4 * b - 1, its first period holds a whole aligned block of b words, and the run holds it again q
    words later: a seed. Scales and distances are taken in ascending order, so a seed that lies in a run whose period divides
    its distance can only give that run again and is passed over; so is one in a stretch that was extended before.
    """
    runs: list[tuple[int, int, int]] = []
    for b in scales(ids, least):
        x, d = block_seeds(ids, b, chunk_words)
        order = np.lexsort((x, d))
        x, d = x[order], d[order]
        cuts = np.flatnonzero(np.diff(d, prepend=-1, append=-1))
        for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            q = int(d[i])
            seeds = x[i:j]
            for start, length, period in runs:
                if q % period == 0:
                    seeds = seeds[(seeds < start) | (seeds + q + b > start + length)]
            done = 0
            for seed in seeds.tolist():
                if seed + q + b <= done:
                    continue
                start, past = extended(ids, seed, q, b)
                done = past
                if past - start >= max(least, 2 * q) and not any(q % p == 0 and s <= start and past <= s + n for s, n, p in runs):
                    runs.append((start, past - start, q))
    return sorted(runs, key=lambda r: (r[0], r[2]))


def repeated_words(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Which of n words some run holds after its first period."""
    change = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    return np.cumsum(change[:-1]) > 0


def with_planted_run(words: list, doc_id) -> list:
    """The words, in one document of ten with a run put in whose place and period follow from its id; no id: none."""
    if doc_id is None or not words:
        return words
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if h % 10:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + i % p] for i in range(n - a)]


def find_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST_WORDS, planted: bool = False) -> DataFrame:
    """Every document's maximal periodic runs of words and its text without the repetitions.

    Words are parted by ASCII white space. Every document is worked on whole in the task that reads it: there is no shuffle,
    and nothing but its own words and runs is held. Texts in which no row of `least` // 2 words comes twice have no run and
    need no automaton. With `planted`, see `with_planted_run`.

    A null text counts as empty: no words, no runs, an empty collapsed text. Null ids and repeated rows each give
    their own row; other columns are ignored; an empty table gives an empty result.

    Returns: `id_col`, n_words long, runs array of (start, length, period) by start, then period, collapsed string.
    """

    def found(batches):
        for batch in batches:
            sizes, runs, collapsed = [], [], []
            for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                words = text.as_buffer().to_pybytes().split() if text.is_valid else []
                words = with_planted_run(words, doc_id.as_py()) if planted else words
                own = periodic_runs(numbered(words), least)
                gone = repeated_words(len(words), own)
                sizes.append(len(words))
                runs.append([dict(zip(("start", "length", "period"), r, strict=True)) for r in own])
                collapsed.append(b" ".join(w for w, g in zip(words, gone.tolist(), strict=True) if not g) if own else b" ".join(words))
            kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(runs, kind), pa.array(collapsed, pa.binary()).cast(pa.string())], names=[id_col, "n_words", "runs", "collapsed"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(frugal(found), f"`{id_col}` {kind}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")


def run_digests(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Of each document of `find_runs` the number of runs, the longest one, and hashes of its runs and collapsed text."""
    best = F.element_at(F.array_sort("runs", lambda x, y: F.when(x["length"] != y["length"], y["length"] - x["length"]).when(x["start"] != y["start"], x["start"] - y["start"]).otherwise(x["period"] - y["period"]).cast("int")), 1)
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    lines = F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise("")
    told = found.select(id_col, F.size("runs").cast("long").alias("n_runs"), F.when(F.size("runs") > 0, best).alias("best"), F.sha2(lines.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))
    return told.select(id_col, "n_runs", "best.start", "best.length", "best.period", F.expr("1000 * best.length div best.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
