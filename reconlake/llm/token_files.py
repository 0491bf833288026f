"""Token ids as flat binary files with 64-bit document offsets, in ascending document order, and their reader.

A folder holds, for each part, `part-N.ids` (unsigned little-endian integers of 2 or 4 bytes, nothing else) and
`part-N.idx` (64-bit offsets: for each document its first id's place in the part, then the part's length; the
document ids follow as 64-bit integers). The base of a part - the ids of all parts before it - is a prefix sum
over the parts' lengths, so parts are written in any order and by any executor.
"""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reconlake.llm.shared import blocks_for, work_dir
from reconlake.llm.tokens import default_tokenizer_path, encoder, task_encoder, with_end

DOCS_PER_FILE = 4096
MOST_FILES = 65_536
#: Stands for a null document id in the index files; a null sorts before all ids.
NO_ID = np.iinfo(np.int64).min


def _filesystem(path: str):
    """The Arrow file system of a path or URI, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


class _PartWriter:
    """Writes one part under names of its own and renames at the end, so a task that is run again does no harm."""

    def __init__(self, folder: str, part: int):
        self.files, self.base = _filesystem(folder)
        self.part, self.mark = part, uuid.uuid4().hex
        self.offsets, self.doc_ids, self.at = [], [], 0
        self.out = self.files.open_output_stream(self._path("ids", True))

    def _path(self, kind: str, draft: bool = False) -> str:
        return f"{self.base}/part-{self.part}.{kind}" + f".{self.mark}" * draft

    def add(self, doc_id: int, ids: np.ndarray) -> None:
        self.offsets.append(self.at)
        self.doc_ids.append(doc_id)
        self.at += len(ids)
        self.out.write(ids.data)

    def close(self) -> tuple[int, int, int]:
        self.out.close()
        with self.files.open_output_stream(self._path("idx", True)) as f:
            f.write(np.array([*self.offsets, self.at], "<i8").tobytes())
            f.write(np.array(self.doc_ids, "<i8").tobytes())
        for kind in ("ids", "idx"):
            self.files.move(self._path(kind, True), self._path(kind))
        return self.part, len(self.doc_ids), self.at


def write_token_files(
    docs: DataFrame, folder: str, tokenizer: str | None = None, end_id: int = 2, docs_per_file: int = DOCS_PER_FILE, id_col: str = "doc_id", text_col: str = "text"
) -> list[tuple[int, int, int, int]]:
    """Encode every document, add `end_id`, and write the ids in ascending order of `id_col`.

    Parts are ranges of document ids (percentiles of the id column alone, so no text is read for them); an id that
    several percentiles fall on has as many parts of its own, to which its rows are dealt in turn. Documents
    are encoded where they are read and travel once, as ids of 2 or 4 bytes, to the task of their part, which
    streams them to its file: no task holds a part in memory, and none has two. Rows with equal ids stand side by
    side, ordered within a part by their ids' bytes; null ids come first; null texts are empty documents.

    Returns the parts in order: (part, documents, ids, base). The driver gets these counts only, one row a file.
    """
    path = tokenizer or default_tokenizer_path()
    parts = min(MOST_FILES, blocks_for(docs.count(), docs_per_file))
    shares = [i / parts for i in range(1, parts)]
    key = F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID))
    bounds = np.array((docs.agg(F.percentile_approx(key, shares, max(10_000, 10 * parts)).alias("b")).first()["b"] if shares else None) or [], np.int64)
    bounds, times = np.unique(bounds, return_counts=True)
    own = np.where(times > 1, times, 0)
    first_part = np.arange(len(bounds) + 1) + np.concatenate([[0], np.cumsum(own)])

    def tokenised(batches):
        turn = TaskContext.get().partitionId()
        with task_encoder(path, room=2) as known:
            for batch in batches:
                first = 0
                doc_ids = batch.column(0).cast(pa.int64()).fill_null(NO_ID)
                at = np.searchsorted(bounds, values := doc_ids.to_numpy(), side="left")
                part = first_part[at]
                if own.any():
                    inside = np.minimum(at, len(bounds) - 1)
                    hot = (bounds[inside] == values) & (own[inside] > 0) & (at < len(bounds))
                    part[hot] += 1 + (turn + np.arange(hot.sum())) % own[inside][hot]
                    turn += int(hot.sum())
                part = part.astype(np.int32)
                for flat, ends in known.encode(batch.column(1)):
                    ids, ends = with_end(flat, ends, end_id)
                    n = len(ends) - 1
                    data = pa.LargeBinaryArray.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(ends * ids.itemsize), pa.py_buffer(ids)])
                    yield pa.RecordBatch.from_arrays([pa.array(part[first : first + n]), doc_ids.slice(first, n), data.cast(pa.binary())], names=["part", "doc", "ids"])
                    first += n

    def written(batches):
        writer, done = None, []
        dtype = encoder(path).dtype
        for batch in batches:
            for part, doc, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                if writer is None or writer.part != part:
                    if writer:
                        done.append(writer.close())
                    writer = _PartWriter(folder, part)
                writer.add(doc, np.frombuffer(ids.as_buffer(), dtype))
        if writer:
            done.append(writer.close())
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (zip(*done, strict=True) if done else ([], [], []))], names=["part", "docs", "n"])

    files, base = _filesystem(folder)
    files.create_dir(base, recursive=True)
    rows = docs.select(id_col, text_col).mapInArrow(tokenised, "part int, doc long, ids binary")
    dealt = rows.repartitionById(int(first_part[-1]) + 1, F.col("part")).sortWithinPartitions("part", "doc", "ids")
    counts = sorted(tuple(r) for r in dealt.mapInArrow(written, "part long, docs long, n long").collect())
    bases = np.cumsum([0, *[n for _, _, n in counts]])
    return [(part, n_docs, n, int(b)) for (part, n_docs, n), b in zip(counts, bases, strict=False)]


def read_token_files(spark: SparkSession, folder: str, parts: list[tuple[int, int, int, int]], dtype: str, id_col: str = "doc_id") -> DataFrame:
    """One row per document from the files: `id_col`, start, n_tokens, ids_crc32 (as unsigned 32-bit integers).

    Local files are memory-mapped; of files elsewhere the index and then one document's bytes at a time are read
    through Arrow's file systems. Either way a task holds one document's ids.
    """
    width = np.dtype(dtype).itemsize

    def rows(batches):
        files, base = _filesystem(folder)
        local = files.type_name == "local"
        for batch in batches:
            for part, n, total, before in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if local:
                    index = np.memmap(f"{base}/part-{part}.idx", "<i8", "r")
                    ids = np.memmap(f"{base}/part-{part}.ids", dtype, "r") if total else np.zeros(0, dtype)
                    body = lambda a, z, ids=ids: ids[a:z]
                else:
                    with files.open_input_file(f"{base}/part-{part}.idx") as f:
                        index = np.frombuffer(f.readall(), "<i8")
                    opened = files.open_input_file(f"{base}/part-{part}.ids")
                    body = lambda a, z, f=opened: np.frombuffer(f.read_at((z - a) * width, a * width), dtype)
                offsets, doc_ids = np.array(index[: n + 1]), np.array(index[n + 1 :])
                sums = [zlib.crc32(body(a, z).astype("<u4")) for a, z in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
                names = pa.array(doc_ids, pa.int64(), mask=doc_ids == NO_ID)
                yield pa.RecordBatch.from_arrays([names, pa.array(before + offsets[:-1]), pa.array(np.diff(offsets)), pa.array(sums, pa.int64())], names=[id_col, "start", "n_tokens", "ids_crc32"])

    listed = spark.createDataFrame(parts, "part long, docs long, n long, base long").repartition(max(1, min(len(parts), spark.sparkContext.defaultParallelism * 4)))
    return listed.mapInArrow(rows, f"`{id_col}` long, start long, n_tokens long, ids_crc32 long")


def token_files(docs: DataFrame, tokenizer: str | None = None, folder: str | None = None, **options) -> DataFrame:
    """Write the documents' token files (into the shared folder, if no other is named) and read them back."""
    spark = docs.sparkSession
    path, folder = tokenizer or default_tokenizer_path(), folder or work_dir(spark, "token-files")
    parts = write_token_files(docs, folder, path, **options)
    return read_token_files(spark, folder, parts, encoder(path).dtype.str, options.get("id_col", "doc_id"))
