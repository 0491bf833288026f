"""Exact top-k inner products by a three-phase uniform threshold over blocks of queries and candidates."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from reconlake.llm.shared import blocks_for, frugal, stored

ROWS_PER_BLOCK = 4096
QUERIES_PER_BLOCK = 512
#: Components are worked through in so many segments; candidates that can no longer reach the cutoff drop out between them.
SEGMENTS = 4
#: Scores must be smaller.
MOST_SCORE = 1 << 60


def integer_vectors(vectors: DataFrame, scale: int, id_col: str, vector_col: str) -> DataFrame:
    """(id, v): floor(scale * x) of each component; rows without an id or with a null or non-finite component go."""
    fine = F.forall(F.col(vector_col), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    whole = F.transform(F.col(vector_col), lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("long"))
    return vectors.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull() & fine & (F.size(vector_col) > 0)).select(F.col(id_col).cast("long").alias("id"), whole.alias("v"))


def _blocks(rows: DataFrame, blocks: int, distinct: bool) -> DataFrame:
    """One row per block: the vectors of a hash of ids as binary matrices. `distinct`: one row per id."""

    def packed(key, rows):
        n = key[0].as_py()
        ids = rows["id"].to_numpy()
        matrix = rows["v"].combine_chunks().flatten().to_numpy().reshape(-1, n)
        order = np.lexsort((*matrix.T[::-1], ids))
        if distinct:
            order = order[np.unique(ids[order], return_index=True)[1]]
        return pa.table({"dim": [n], "block": pa.array([key[1].as_py()], pa.int32()), "ids": [ids[order].astype("<i8").tobytes()], "data": [matrix[order].astype("<i8").tobytes()], "peak": [int(np.abs(matrix).max())]}).cast(
            pa.schema([("dim", pa.int32()), ("block", pa.int32()), ("ids", pa.binary()), ("data", pa.binary()), ("peak", pa.int64())])
        )

    keyed = rows.select(F.size("v").alias("dim"), F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block"), "id", "v")
    return keyed.groupBy("dim", "block").applyInArrow(packed, "dim int, block int, ids binary, data binary, peak long")


def _kind(dim: int, a: int, b: int):
    """The fastest type in which sums of `dim` products of such size are exact."""
    bound = dim * a * b
    if bound >= MOST_SCORE:
        raise ValueError(f"scores may reach {bound}; they must be under 2**60")
    return np.float32 if bound < 1 << 24 else np.float64 if bound < 1 << 53 else np.int64


def _matrices(row: dict) -> tuple[np.ndarray, np.ndarray]:
    kind = _kind(row["dim"], row["q_peak"], row["peak"])
    return tuple(np.frombuffer(x, "<i8").reshape(-1, row["dim"]).astype(kind) for x in (row["q_data"], row["data"]))


def _lengths(matrix: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """The length of each row's segments, rounded up."""
    squares = np.add.reduceat(matrix.astype(np.float64) ** 2, cuts[:-1], axis=1)
    return np.sqrt(squares) * (1 + 1e-9)


def reaching(q: np.ndarray, c: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, candidate, score) of the pairs whose inner product is `least` of the query or more.

    A product of segments is at most the product of their lengths. Candidates that can't reach any query's cutoff by
    that bound are never multiplied, and those that can't with the segments summed so far drop out before the next.
    """
    cuts = np.linspace(0, q.shape[1], min(SEGMENTS, q.shape[1]) + 1).astype(int)
    q_long, c_long = _lengths(q, cuts), _lengths(c, cuts)
    columns = np.flatnonzero((q_long @ c_long.T + 1e-3 >= least).any(axis=0))
    total = np.zeros((len(q), len(columns)), q.dtype)
    for i, (s, e) in enumerate(zip(cuts[:-1], cuts[1:], strict=True), 1):
        total += q[:, s:e] @ c[columns, s:e].T
        if i < len(cuts) - 1:
            open_ = (total + q_long[:, i:] @ c_long[columns, i:].T + 1e-3 >= least).any(axis=0)
            if open_.mean() < 0.8:
                columns, total = columns[open_], total[:, open_]
    asked, place = np.nonzero(total >= least)
    return asked, columns[place], total[asked, place].astype(np.int64)


def _pairs(queries: DataFrame, candidates: DataFrame, extra: tuple[str, ...] = (), one_each: bool = False) -> DataFrame:
    """Every query block beside every candidate block of its dimension (or beside one): query blocks are dealt by block number."""
    numbers = candidates.groupBy("dim").agg(F.sort_array(F.collect_list("block")).alias("numbers"))
    met = F.array(F.element_at("numbers", F.col("q_block") % F.size("numbers") + 1)) if one_each else F.col("numbers")
    dealt = queries.withColumnRenamed("block", "q_block").join(numbers, "dim").select("dim", "q_block", F.col("ids").alias("q_ids"), F.col("data").alias("q_data"), F.col("peak").alias("q_peak"), *extra, F.explode(met).alias("block"))
    return dealt.join(candidates, ["dim", "block"])


def exact_top_k(vectors: DataFrame, is_query: Column, k: int = 20, scale: int = 64, id_col: str = "vec_id", vector_col: str = "embedding", rows_per_block: int = ROWS_PER_BLOCK, queries_per_block: int = QUERIES_PER_BLOCK) -> DataFrame:
    """For each query row the `k` other rows with the highest integer inner product, ties to the smaller id.

    Phase 1: every query meets the candidates of one block; the k-th best of its scores there is a cutoff that no
    result can fall below. Phase 2: the cutoffs travel with the query blocks to all candidate blocks, where lengths
    of segments tell which candidates can reach them (see `reaching`); the others are not multiplied, or not to the
    end. Phase 3: what is left is summed exactly, and what reaches the cutoff (the best `k` of a block are enough) is
    ranked. Queries meet candidates block by block, each pair of blocks in bounded memory.

    Scores must be under 2**60 in size; where they might not be, the job fails. Rows with a null id, or a null, empty
    or non-finite vector take no part. Vectors meet those of their own
    length only. Rows that repeat a query's id are one query (that with the least vector) and no candidates of
    it; repeated candidates are ranked each. Extra columns are ignored; an empty table gives an empty result.

    Returns: query_id long, rank int (from 1), `id_col` long, score long.
    """
    rows = stored(integer_vectors(vectors, scale, id_col, vector_col), "topk-vectors")
    asking = stored(integer_vectors(vectors.where(is_query), scale, id_col, vector_col), "topk-queries")
    candidates = stored(_blocks(rows, blocks_for(rows.count(), rows_per_block), False), "topk-candidates")
    queries = stored(_blocks(asking, blocks_for(asking.count(), queries_per_block), True), "topk-query-blocks")

    def best(row: dict, asked: np.ndarray, place: np.ndarray, total: np.ndarray) -> pa.RecordBatch:
        """Each query's `k` best of the given pairs of a block, without itself."""
        q_ids, ids = np.frombuffer(row["q_ids"], "<i8"), np.frombuffer(row["ids"], "<i8")
        other = q_ids[asked] != ids[place]
        asked, place, total = asked[other], place[other], total[other]
        order = np.lexsort((ids[place], -total, asked))
        asked, place, total = asked[order], place[order], total[order]
        first = np.arange(len(asked)) - np.searchsorted(asked, asked, side="left") < k
        columns = [np.full(first.sum(), row["dim"], np.int32), np.full(first.sum(), row["q_block"], np.int32), q_ids[asked[first]], ids[place[first]], total[first]]
        return pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["dim", "block", "query_id", id_col, "score"])

    def first_lists(batches):
        for batch in batches:
            for row in batch.to_pylist():
                q, c = _matrices(row)
                scores = (q @ c.T).astype(np.int64)
                scores[np.frombuffer(row["q_ids"], "<i8")[:, None] == np.frombuffer(row["ids"], "<i8")] = -MOST_SCORE
                last = scores.shape[1] - min(k, scores.shape[1])
                asked, place = np.nonzero(scores >= np.partition(scores, last, axis=1)[:, last : last + 1])
                yield best(row, asked, place, scores[asked, place])

    def sufficient(batches):
        for batch in batches:
            for row in batch.to_pylist():
                known = {c["query_id"]: c["score"] for c in row["cutoffs"] or []}
                least = np.array([known.get(q, -MOST_SCORE) for q in np.frombuffer(row["q_ids"], "<i8").tolist()], np.int64)
                yield best(row, *reaching(*_matrices(row), least[:, None]))

    schema = f"dim int, block int, query_id long, `{id_col}` long, score long"
    lists = _pairs(queries, candidates, one_each=True).mapInArrow(frugal(first_lists), schema)
    by_score = Window.partitionBy("dim", "block", "query_id").orderBy(F.col("score").desc())
    cutoff = lists.withColumn("n", F.row_number().over(by_score)).where(F.col("n") == k)
    cutoffs = cutoff.groupBy("dim", "block").agg(F.collect_list(F.struct("query_id", "score")).alias("cutoffs"))
    told = stored(queries.join(cutoffs, ["dim", "block"], "left"), "topk-cutoffs")
    found = _pairs(told, candidates, ("cutoffs",)).mapInArrow(frugal(sufficient), schema).select("query_id", id_col, "score")
    ranked = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col(id_col))
    return found.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k).select("query_id", "rank", id_col, "score")
