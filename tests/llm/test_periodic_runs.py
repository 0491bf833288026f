import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from reconlake.llm.periodic_runs import block_seeds, find_runs, numbered, periodic_runs, run_digests
from reconlake.llm.queries import op12_periodic_runs

SF = "/root/testdata/sf0.001"


def slow_runs(w, least=12):
    out = []
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            n = j + q - i
            if j > i and n >= max(least, 2 * q) and not any(all(w[k] == w[k + p] for k in range(i, i + n - p)) for p in range(1, q)):
                out.append((i, n, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def slow_row(doc_id, text):
    words = re.findall("[^\x20\x09-\x0d]+", text or "")
    n, h = len(words), zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = slow_runs(words)
    drop = {i for s, m, q in runs for i in range(s + q, s + m)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else None
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (doc_id, len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2], sha("".join(f"{s},{m},{q}\n" for s, m, q in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in drop)))


def rows_of(df):
    return sorted(map(tuple, df.select("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256").collect()), key=str)


def drawn(rng):
    letters = rng.choice(["a", "ab", "abc", "abcdefghijklmnop"])
    out = []
    while len(out) < rng.choice([5, 30, 120]):
        some = [rng.choice(letters) for _ in range(rng.choice([1, 2, 3, 7, 8, 15, 31]))]
        out += (some * rng.choice([1, 1, 2, 3, 9]))[: rng.randint(1, 90)]
    return out


@pytest.mark.parametrize("least", [2, 5, 12])
def test_runs_against_every_period(least):
    rng = random.Random(least)
    for _ in range(250):
        w = drawn(rng)
        assert periodic_runs(numbered(w), least, chunk_words=rng.choice([4, 16, 1 << 16])) == slow_runs(w, least), w


def test_seeds_are_all_blocks_found_again():
    rng = random.Random(9)
    for _ in range(60):
        w = numbered(drawn(rng))
        for b in (1, 2, 4, 8):
            x, d = block_seeds(w, b, chunk_words=16)
            want = {(i, q) for i in range(0, len(w), b) for q in range(2 * b - 1, 4 * b - 1) if i + q + b <= len(w) and (w[i : i + b] == w[i + q : i + q + b]).all()}
            assert set(zip(x.tolist(), d.tolist(), strict=True)) == want and len(x) == len(want)


def test_long_texts_end_soon():
    one = np.zeros(200_000, np.int64)
    assert periodic_runs(one) == [(0, 200_000, 1)]
    rng = random.Random(3)
    block = [rng.randrange(50) for _ in range(30_000)]
    assert (0, 90_000, 30_000) in periodic_runs(np.array(block * 3))
    fib = ["a", "b"]
    while len(fib[-1]) < 3000:
        fib.append(fib[-1] + fib[-2])
    got = periodic_runs(numbered(list(fib[-1])))
    assert len(got) == len(set(got)) > 500 and slow_runs(fib[-1][:300]) == periodic_runs(numbered(list(fib[-1][:300])))


def test_awkward_and_empty_tables(spark, awkward, empty):
    assert run_digests(find_runs(empty)).count() == 0
    # the text of 6,000 words has no run and would take brute force too long
    some = awkward.where("text IS NULL OR length(text) < 5000")
    assert rows_of(run_digests(find_runs(some, planted=True))) == sorted([slow_row(r.doc_id, r.text) for r in some.collect()], key=str)
    assert find_runs(awkward).count() == awkward.count()


def test_query_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("length(text) < 9000 OR text IS NULL").collect()
    want = [slow_row(r.doc_id, r.text) for r in docs]
    some = {w[0] for w in want}
    got = op12_periodic_runs(spark, SF)
    assert [r for r in rows_of(got) if r[0] in some] == sorted(want, key=str)
    assert sum(w[1] for w in want) > 10
