import random

import numpy as np
import pytest
from test_simhash import union

import corpus_pipeline
from reconlake.llm.jaccard import judged, part_keys, similar_texts, sketch


def slow_set(text, k=5):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def slow_components(rows):
    sets = [slow_set(t) for _, t in rows]
    near = [(i, j) for i in range(len(rows)) for j in range(i) if sets[i] == sets[j] or 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j])]
    want, least = union(len(rows), near), {}
    for w, (d, _) in zip(want, rows, strict=True):
        if d is not None:
            least[w] = min(least.get(w, d), d)
    return sorted((str(d), str(least.get(w))) for (d, _), w in zip(rows, want, strict=True))


def edited_texts(seed, n):
    rng = random.Random(seed)
    word = lambda: f"w{rng.randint(0, 999)}"
    base = [[word() for _ in range(rng.randint(3, 120))] for _ in range(8)]
    texts = [list(rng.choice(base)) for _ in range(n)]
    for t in texts:
        for _ in range(rng.randint(0, 3)):
            t[rng.randrange(len(t))] = word()
        if rng.random() < 0.3:
            t += ["one", "line", "that", "all", "of", "them", "have"]
    return [(i, " ".join(t)) for i, t in enumerate(texts)]


@pytest.mark.parametrize(("small", "tile"), [(32, 2048), (3, 2048), (2, 20)])
def test_components_like_all_pairs(spark, small, tile):
    rows = edited_texts(3, 150)
    got = similar_texts(spark.createDataFrame(rows, "doc_id long, text string"), small=small, tile_sets=tile).collect()
    assert sorted((str(r.doc_id), str(r.component_id)) for r in got) == slow_components(rows)


def test_sketches_rule_out_no_similar_pair_and_never_err_when_sure():
    rng = np.random.default_rng(5)
    seen = set()
    for _ in range(4000):
        n, apart = int(rng.integers(5, 1200)), rng.uniform(0.02, 0.3)
        common = rng.integers(-(2**62), 2**62, n)
        a, b = (np.unique(np.concatenate([common, rng.integers(-(2**62), 2**62, int(n * apart * rng.uniform(0, 1)))])) for _ in range(2))
        near = len(np.intersect1d(a, b)) >= 0.8 * len(np.union1d(a, b)) - 1e-9
        x, y = (np.frombuffer(sketch(s), np.uint64) for s in (a, b))
        verdict = int(judged(np.bitwise_count(x ^ y).sum(), np.int64(len(a) + len(b)), 0.8))
        seen.add((near, verdict))
        assert (near, verdict) not in {(True, 0), (False, 2)}
        if near:
            assert np.intersect1d(part_keys(a), part_keys(b)).size
    assert {(True, 2), (True, 1), (False, 0)} <= seen


def test_awkward_rows(awkward, empty):
    rows = [(r.doc_id, r.text) for r in awkward.collect()]
    assert sorted((str(r.doc_id), str(r.component_id)) for r in similar_texts(awkward).collect()) == slow_components(rows)
    assert similar_texts(empty).count() == 0


def test_stage_drops_every_similar_text(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").cache()
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    kept = corpus_pipeline.drop_near_copies(spark, docs, "").select("doc_id").collect()
    assert sorted(str(r.doc_id) for r in kept) == sorted({c for _, c in slow_components(rows)})
