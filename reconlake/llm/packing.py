"""Packing of tokenised documents into fixed-length training sequences by best-fit decreasing."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from reconlake.llm.shared import blocks_for, spread
from reconlake.llm.tokens import default_tokenizer_path, task_encoder, with_end

DOCS_PER_BLOCK = 4096
SEQUENCES_PER_BLOCK = 1 << 24


class OpenWindows:
    """Open windows by remaining capacity: a segment tree over capacities finds the tightest that still fits."""

    def __init__(self, size: int):
        self.leaves = 1 << size.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.windows: list[list[int]] = [[] for _ in range(size + 1)]

    def add(self, window: int, capacity: int) -> None:
        self.windows[capacity].append(window)
        self._change(capacity, 1)

    def _change(self, capacity: int, by: int) -> None:
        node = self.leaves + capacity
        while node:
            self.count[node] += by
            node >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """Remove and return (window, capacity) with the least capacity of `need` or more."""
        node = self.leaves + need
        if not self.count[node]:
            while node > 1 and not (node % 2 == 0 and self.count[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.leaves:
                node = 2 * node if self.count[2 * node] else 2 * node + 1
        capacity = node - self.leaves
        self._change(capacity, -1)
        return self.windows[capacity].pop(), capacity


def best_fit_decreasing(lengths: list[int], size: int) -> list[list[int]]:
    """Windows of at most `size`, as lists of item numbers; items come longest first, ties in the given order."""
    tree, windows = OpenWindows(size), []
    for item in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        found = tree.take(lengths[item])
        window, capacity = found or (len(windows), size)
        if not found:
            windows.append([])
        windows[window].append(item)
        if left := capacity - lengths[item]:
            tree.add(window, left)
    return windows


def top_up(windows: list[list[tuple[int, int, int]]], size: int, least_gap: int) -> list[list[tuple[int, int, int]]]:
    """Fill gaps of `least_gap` or more by cutting up the emptiest windows; the last one goes at powers of two.

    A window is a list of (item, start, length). What is left of one donor at the end is cut into sequences
    whose lengths are powers of two, so that they need no padding.
    """
    fill = lambda w: sum(x[2] for x in w)
    order = sorted(windows, key=lambda w: -fill(w))
    done = [w for w in order if size - fill(w) < least_gap]
    gapped = order[len(done) :]
    first, spare = 0, []
    while first < len(gapped):
        gap = size - fill(gapped[first])
        while gap and (spare or len(gapped) > first + 1):
            if not spare:
                spare = sorted(gapped.pop(), key=lambda x: x[2])
            item, start, length = spare.pop()
            part = min(gap, length)
            gapped[first].append((item, start, part))
            gap -= part
            if part < length:
                spare.append((item, start + part, length - part))
        if gap:
            spare = [*spare, *gapped.pop(first)]
            break
        done.append(gapped[first])
        first += 1
    left = sum(x[2] for x in spare)
    while left:
        room, window = 1 << (left.bit_length() - 1), []
        left -= room
        while room:
            item, start, length = spare.pop()
            part = min(room, length)
            window.append((item, start, part))
            room -= part
            if part < length:
                spare.append((item, start + part, length - part))
        done.append(window)
    return done


def pack_documents(
    docs: DataFrame,
    tokenizer: str | None = None,
    sequence_tokens: int = 2048,
    end_id: int = 1,
    least_gap: int = 48,
    docs_per_block: int = DOCS_PER_BLOCK,
    keep_ids: bool = False,
    room: float = 1,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Pack every document (its ids, then `end_id`) into sequences of at most `sequence_tokens`.

    Tokenising is a map over the documents, which at once cuts overlong ones into full windows. What goes on is a
    row per document with its length, the checksums of its full windows and the ids of what is left, fewer than a
    window (all ids if `keep_ids`). Documents are dealt to blocks of about `docs_per_block` and each block is packed
    alone: the rest goes best-fit-decreasing, gaps of `least_gap` tokens or more are filled by cutting, and only
    smaller gaps are padded. A block holds less than `docs_per_block` windows of ids, however long the texts; the
    loss from packing blocks apart is nil, because each block's last window is cut at powers of two, which need no
    padding. The block is a hash of id, length and checksum; rows that agree in all these within a batch are told
    apart by their place in the task, so that repeated rows spread as well.

    `room` bounds what a worker holds for the tokenizer (see `task_encoder`).

    Null texts are empty documents (their end id alone); null ids and repeated rows are packed as documents of
    their own; extra columns are ignored; an empty table gives an empty result.

    Returns a row per piece: `id_col`, start, length, ids_crc32, doc_tokens, sequence_id, offset, padding (of its
    sequence: tokens up to `sequence_tokens`, none at a power of two), and with `keep_ids` the piece's ids as
    little-endian unsigned 32-bit binary.
    """
    path = tokenizer or default_tokenizer_path()
    kind = docs.schema[id_col].dataType.simpleString()

    def tokenised(batches):
        task, row = TaskContext.get().partitionId(), 0
        with task_encoder(path, room) as known:
            for batch in batches:
                first = 0
                for flat, bounds in known.encode(batch.column(1)):
                    ids, bounds = with_end(flat, bounds, end_id)
                    tokens = np.diff(bounds)
                    names = batch.column(0).slice(first, len(tokens))
                    ends = bounds[1:] - tokens % sequence_tokens
                    sums = [[zlib.crc32(ids[at : at + sequence_tokens].astype("<u4")) for at in range(a, z, sequence_tokens)] for a, z in zip(bounds[:-1].tolist(), ends.tolist(), strict=True)]
                    held = [ids[a:z].tobytes() for a, z in zip((bounds[:-1] if keep_ids else ends).tolist(), bounds[1:].tolist(), strict=True)]
                    tie = np.array([zlib.crc32(np.array([n, *s], "<i8").tobytes() + h) for n, s, h in zip(tokens.tolist(), sums, held, strict=True)], np.int64)
                    number = names.dictionary_encode().indices.fill_null(-1).to_numpy().astype(np.int64)
                    turn = np.int64(task << 32) + row + np.arange(len(tokens))
                    turn[np.unique(number << 32 | tie, return_index=True)[1]] = 0
                    yield pa.RecordBatch.from_arrays(
                        [names, pa.array(tokens, pa.int64()), pa.array(tie), pa.array(turn), pa.array(sums, pa.list_(pa.int64())), pa.array(held, pa.binary())],
                        names=[id_col, "doc_tokens", "tie", "turn", "sums", "ids"],
                    )
                    first += len(tokens)
                    row += len(tokens)

    rows = docs.select(id_col, text_col).mapInArrow(tokenised, f"`{id_col}` {kind}, doc_tokens long, tie long, turn long, sums array<long>, ids binary")
    rows = rows.withColumn("block", spread([id_col, "doc_tokens", "tie", "turn"], blocks_for(docs.count(), docs_per_block)))

    def packed(key, rows):
        rows = rows.sort_by([(id_col, "ascending"), ("doc_tokens", "ascending"), ("tie", "ascending")])
        tokens = rows["doc_tokens"].to_numpy()
        held = [np.frombuffer(x.as_buffer(), np.uint8) for x in rows["ids"]]
        sums = rows["sums"].to_pylist()
        cut = tokens - tokens % sequence_tokens
        full = [[(doc, at * sequence_tokens, sequence_tokens)] for doc, known in enumerate(sums) for at in range(len(known))]
        rest = [(doc, c, n - c) for doc, (c, n) in enumerate(zip(cut.tolist(), tokens.tolist(), strict=True)) if n > c]
        windows = [[rest[i] for i in w] for w in best_fit_decreasing([x[2] for x in rest], sequence_tokens)]
        pieces = []
        for number, window in enumerate(full + top_up(windows, sequence_tokens, least_gap)):
            at = 0
            for doc, start, length in window:
                pieces.append((doc, start, length, number, at))
                at += length
        doc, start, length, number, at = np.array(pieces, np.int64).T
        filled = np.bincount(number, weights=length).astype(np.int64)[number]
        skipped = np.zeros_like(cut) if keep_ids else cut
        width = next((len(h) // int(n - s) for h, n, s in zip(held, tokens, skipped, strict=True) if n > s), 4)
        body = lambda d, s, n: held[d][width * (s - skipped[d]) : width * (s - skipped[d] + n)].view(f"<u{width}").astype("<u4")
        whole = start < cut[doc]
        out = {
            id_col: rows[id_col].take(pa.array(doc)),
            "start": start,
            "length": length,
            "ids_crc32": pa.array([sums[d][s // sequence_tokens] if w else zlib.crc32(body(d, s, n)) for d, s, n, w in zip(doc.tolist(), start.tolist(), length.tolist(), whole.tolist(), strict=True)], pa.int64()),
            "doc_tokens": tokens[doc],
            "sequence_id": key[0].as_py() * SEQUENCES_PER_BLOCK + number,
            "offset": at,
            "padding": np.where(filled & (filled - 1), sequence_tokens - filled, 0),
        }
        if keep_ids:
            out["ids"] = pa.array([body(d, s, n).tobytes() for d, s, n in zip(doc.tolist(), start.tolist(), length.tolist(), strict=True)], pa.binary())
        return pa.table(out)

    out_schema = f"`{id_col}` {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, padding long" + ", ids binary" * keep_ids
    return rows.groupBy("block").applyInArrow(packed, out_schema)
