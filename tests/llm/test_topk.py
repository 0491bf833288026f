import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from reconlake.llm.topk import exact_top_k, reaching


def slow(rows, k, is_query):
    whole = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    queries = {}
    for i, v in sorted(whole):
        if is_query(i):
            queries.setdefault((i, len(v)), v)
    for (i, n), q in queries.items():
        found = sorted((-sum(a * b for a, b in zip(q, v, strict=True)), j) for j, v in whole if j != i and len(v) == n)[:k]
        out += [(i, r, j, -s) for r, (s, j) in enumerate(found, 1)]
    return sorted(out)


@pytest.mark.parametrize(("size", "per_block", "per_query_block"), [(1.0, 16, 4), (1.0, 4096, 512), (2.0**18, 16, 4), (2.0**22, 16, 4)])
def test_top_k_like_all_pairs(spark, size, per_block, per_query_block):
    rng = random.Random(8)
    rows = [(i, [rng.uniform(-size, size) for _ in range(6)]) for i in range(150)]
    rows += [(200 + i, [0.25] * 6) for i in range(40)] + [(300, None), (301, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (302, [float("nan")] * 6), (303, [float("inf")] * 6), (None, [1.0] * 6), (304, [])]
    rows += [(5, rows[5][1]), (20, rows[20][1]), (305, [1.0, 2.0]), (320, [1.0, 3.0])]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, score int")
    got = exact_top_k(df, F.col("vec_id") % 20 == 0, 7, rows_per_block=per_block, queries_per_block=per_query_block)
    assert sorted(map(tuple, got.collect())) == slow(rows, 7, lambda i: i % 20 == 0)


def test_fewer_rows_than_k_and_none(spark):
    df = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id long, embedding array<float>")
    assert sorted(map(tuple, exact_top_k(df, F.col("vec_id") % 20 == 0).collect())) == [(0, 1, 1, 64 * 128)]
    assert exact_top_k(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_cutoffs_skip_products_and_lose_nothing():
    rng = np.random.default_rng(3)
    for kind in (np.float32, np.float64, np.int64):
        q, c = (rng.integers(-40, 40, (n, 16)) for n in (30, 400))
        c[::2] //= 20  # short vectors: no cutoff is within their reach
        scores = q @ c.T
        least = np.sort(scores, axis=1)[:, -10:-9]
        asked, place, total = reaching(q.astype(kind), c.astype(kind), least)
        want = np.nonzero(scores >= least)
        assert sorted(zip(asked.tolist(), place.tolist(), strict=True)) == sorted(zip(*(x.tolist() for x in want), strict=True))
        assert (total == scores[asked, place]).all()


def test_scores_that_might_overflow_are_refused(spark):
    df = spark.createDataFrame([(0, [2.0**30, 1.0]), (1, [2.0**30, 1.0])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="under 2"):
        exact_top_k(df, F.col("vec_id") % 20 == 0).collect()
