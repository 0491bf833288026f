"""Token counts of whole texts from per-piece counts, without building any document's ids."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from reconlake.llm.tokens import default_tokenizer_path, task_encoder


def count_tokens(docs: DataFrame, tokenizer: str | None = None, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """UTF-8 bytes and token count of every text, as the tokenizer's library counts them.

    Each task keeps one table of distinct pre-tokens with their piece counts (for a tokenizer that drops white
    space, of runs between blanks, each a fixed row of pre-tokens). A slice of documents becomes frequencies, rows
    (document, pre-token, times), which are joined to that table and summed; no document's ids are built. Tasks
    need nothing from each other, so there is no shuffle; a join of all (document, pre-token) rows through one
    would move more bytes than the texts hold.

    Null texts count as empty (0 bytes, 0 tokens); null ids and repeated rows each give their own row; other
    columns are ignored, whatever their names; an empty table gives an empty result.

    Returns: `id_col`, n_bytes long, n_tokens long, over_limit boolean (more than `limit` tokens).
    """
    path = tokenizer or default_tokenizer_path()

    def counted(batches):
        with task_encoder(path) as known:
            for batch in batches:
                tokens = known.count(batch.column(1))
                size = pc.cast(pc.fill_null(pc.binary_length(batch.column(1)), 0), pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0), size, pa.array(tokens, pa.int64()), pa.array(tokens > limit)], names=[id_col, "n_bytes", "n_tokens", "over_limit"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(counted, f"`{id_col}` {kind}, n_bytes long, n_tokens long, over_limit boolean")
