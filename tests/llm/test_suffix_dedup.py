import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from reconlake.llm.queries import op11_suffix_dedup
from reconlake.llm.suffix_dedup import Segments, merged, repeated_spans, repeated_strings, stable_order, without_repeats

SF = "/root/testdata/sf0.001"


def slow_spans(texts, length):
    """The spans of each text's bytes that a string of that length covers which is anywhere else too."""
    texts = [(t or "").encode() for t in texts]
    seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        covered = np.zeros(len(t), bool)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                covered[i : i + length] = True
        edge = np.diff(covered.astype(np.int8), prepend=0, append=0)
        spans = list(zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True))
        out.append((len(t), spans, hashlib.sha256(bytes(np.frombuffer(t, np.uint8)[~covered])).hexdigest()))
    return out


def told(df):
    return sorted(((r.doc_id, r.n_bytes, [tuple(x) for x in r.spans], r.kept_sha256) for r in df.collect()), key=str)


def wanted(rows, length):
    return sorted(((i, *x) for i, x in zip([r[0] for r in rows], slow_spans([r[1] for r in rows], length), strict=True)), key=str)


def drawn_texts(rng, n):
    letters = rng.choice(["ab", "abcdé", "abcdefghijklmnop "])
    passages = ["".join(rng.choice(letters) for _ in range(rng.randint(5, 90))) for _ in range(6)]
    out = [None, "", "x" * 7, "ab" * 40, "z" * 150]
    for _ in range(n):
        out.append("".join(rng.choice([rng.choice(passages), rng.choice(passages)[5:], "".join(rng.choice(letters) for _ in range(30))]) for _ in range(rng.randint(1, 5))))
    return out


def test_equal_strings_have_equal_anchors():
    rng = random.Random(2)
    for length in (1, 2, 5, 24):
        cut, own = Segments(length, piece=40), {}
        for text in drawn_texts(rng, 40):
            text = (text or "").encode()
            first, run, anchor, _ = cut.of(text)
            strings = [(text[i + k : i + k + length], a) for i, n, a in zip(first.tolist(), run.tolist(), anchor.tolist(), strict=True) for k in range(n)]
            assert [s for s, _ in strings] == [text[i : i + length] for i in range(len(text) - length + 1)]
            for s, a in strings:
                assert own.setdefault(s, a) == a


def test_merged_order_is_that_of_sorted_suffixes():
    rng = random.Random(4)
    for _ in range(60):
        length = rng.choice([1, 3, 8, 16, 40])
        parts = [t.encode() for t in drawn_texts(rng, 12) if t and len(t.encode()) >= length]
        runs = np.array([rng.randint(1, len(p) - length + 1) for p in parts])
        counts = np.array([rng.choice([1.0, 1.0, 2.0]) for _ in parts])
        held, repeated, one_each = repeated_strings(parts, runs, counts, length, shard=rng.choice([1, 60, 10_000]))
        times = Counter()
        for p, r, n in zip(parts, runs, counts, strict=True):
            for i in range(r):
                times[p[i : i + length]] += n
        assert [repeated[b : b + r].tolist() for b, r in zip(held.base, runs, strict=False)] == [[times[p[i : i + length]] >= 2 for i in range(r)] for p, r in zip(parts, runs, strict=True)]
        assert sorted(parts[held.part[i]][held.offset[i] :][:length] for i in one_each) == sorted(times)


def test_common_prefixes_of_neighbours():
    from reconlake.llm.suffix_dedup import Collection

    parts = [b"banana", b"ananas", b"bandana", b"an"]
    held = Collection(parts, 1)
    shards = [held.transform(i, i + 1) for i in range(len(parts))]
    taken, common = merged([t for _, t in shards], 4)
    place = np.concatenate([o for o, _ in shards])[taken]
    # a string's end is a letter of its own, after all others
    suffix = [tuple(parts[held.part[p]][held.offset[p] :]) + (1000 + int(held.part[p]),) for p in place]
    assert [s[:4] for s in suffix] == sorted(s[:4] for s in suffix)
    shared = [next((k for k in range(4) if a[k : k + 1] != b[k : k + 1]), 4) for a, b in zip(suffix, suffix[1:], strict=False)]
    assert common[1:].tolist() == shared


def test_stable_order_of_large_numbers():
    x = np.random.default_rng(1).integers(0, 300_000, 5000).astype(np.uint32)
    assert (stable_order(x) == np.argsort(x, kind="stable")).all()


@pytest.mark.parametrize("most", [2048, 2])
def test_spans_against_brute_force(spark, most):
    rng = random.Random(most)
    rows = list(enumerate(drawn_texts(rng, 80)))
    rows += [rows[9], rows[9], (None, rows[8][1]), (None, None), (11, "another text of an id")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS t1", "2 AS m", "3 AS first", "4 AS spans").repartition(3)
    for length in (24, 7):
        assert told(repeated_spans(docs, length, most_segments=most, merge=400, shard=90)) == wanted(rows, length)


def test_awkward_and_empty_tables(spark, awkward, empty):
    assert repeated_spans(empty).count() == 0 and without_repeats(empty).count() == 0
    rows = [(r.doc_id, r.text) for r in awkward.collect()]
    assert told(repeated_spans(awkward, 30)) == wanted(rows, 30)
    left = sorted((r.doc_id, hashlib.sha256(r.kept).hexdigest()) for r in without_repeats(awkward, 30).where("doc_id IS NOT NULL").collect())
    assert left == sorted((i, sha) for i, _, _, sha in wanted(rows, 30) if i is not None)


def test_query_against_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    want = [(i, n, sum(z - a for a, z in spans), len(spans), sha) for i, n, spans, sha in wanted(rows, 200)]
    got = op11_suffix_dedup(spark, SF).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert sorted(map(tuple, got.collect())) == sorted(want) and sum(w[2] for w in want) > 1000
