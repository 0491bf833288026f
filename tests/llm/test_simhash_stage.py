"""The pipeline's near-dedup stage goes by SimHash, and loses nothing that SimHash misses."""

import random

import numpy as np

from reconlake.llm import simhash as simhash_module
from reconlake.llm.jaccard import shingle_set
from reconlake.llm.simhash import near_links


def test_simhashes_bring_the_candidates_of_the_pipelines_stage(spark, monkeypatch):
    """The stage asks for near fingerprints, gets them by brute force's links, and what they miss is found all the same."""
    rng, asked = random.Random(3), []
    texts = ["", "one", "one"] + [" ".join(rng.choices("abcdefghij", k=rng.choice([8, 60, 300]))) for _ in range(20)]
    texts += [" ".join("zz" if rng.random() < 0.01 else w for w in t.split()) for t in texts for _ in range(2)]
    monkeypatch.setattr(simhash_module, "near_links", lambda bits, radius: asked.append((sorted(r.bits for r in bits.collect()), radius)) or near_links(bits, radius))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = sorted(r.doc_id for r in simhash_module.keep_one_each(docs, words=5, similarity=0.8).collect())
    sets = [shingle_set(t.encode(), 5) for t in texts]
    (known, radius), = asked
    assert radius == 8 and known == sorted({simhash_module.majority(s) for s in sets})
    root = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            common = len(np.intersect1d(sets[a], sets[b]))
            if common >= 0.8 * (len(sets[a]) + len(sets[b]) - common):
                low, high = sorted((root[a], root[b]))
                root = [low if r == high else r for r in root]
    assert kept == sorted(set(root)) and 1 < len(kept) < len(texts)
