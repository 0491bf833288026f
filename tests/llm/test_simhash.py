import random
import re

import numpy as np
import pytest
import xxhash

from reconlake.llm.components import components
from reconlake.llm.simhash import band_masks, keep_one_each, linked, near_duplicates, near_links, simhash


def slow_simhash(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall("[^\x20\x09-\x0d]+", low)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] if len(words) >= 4 else [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def union(n, pairs):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def near_prints(rng, n, hot=0):
    prints = [rng.getrandbits(64) for _ in range(n)]
    prints += [rng.choice(prints[:20]) ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 5))) for _ in range(n)]
    centre = rng.getrandbits(64)
    return list(dict.fromkeys(prints + [centre ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 3))) for _ in range(hot)]))


def test_fingerprint_by_its_words():
    rng = random.Random(4)
    for text in ["", " \n", "A", "a b c", "AÉ b c d\x0be f\x1cg", *[" ".join(rng.choice("ab Cd é").strip() or "x" for _ in range(rng.randint(1, 40))) for _ in range(200)]]:
        assert simhash(text.encode()) == slow_simhash(text)


@pytest.mark.parametrize("rows", [10, 10_000, 10**7, 10**9, 10**11, 10**13])
def test_masks_miss_no_pair(rows):
    masks, rng = band_masks(rows, 4), random.Random(rows)
    for _ in range(2000):
        differing = sum(1 << b for b in rng.sample(range(64), 4))
        assert any(not differing & m for m in masks)


def test_tiles_link_like_all_pairs():
    rng = random.Random(6)
    for n in (3, 40, 300):
        bits = near_prints(rng, n)
        want = union(len(bits), [(i, j) for i in range(len(bits)) for j in range(i) if (bits[i] ^ bits[j]).bit_count() <= 4])
        root = linked(np.array(bits, np.uint64), 4, tile=16)
        assert union(len(bits), [(i, int(r)) for i, r in enumerate(root)]) == want


@pytest.mark.parametrize(("per_group", "most"), [(512, 4096), (8, 20)])
def test_links_and_components_like_all_pairs(spark, per_group, most):
    bits = near_prints(random.Random(7), 250, hot=150)
    signed = [b - (1 << 64) if b >> 63 else b for b in bits]
    edges = near_links(spark.createDataFrame([(b,) for b in signed], "bits long"), rows_per_group=per_group, most_rows=most)
    roots = {r.node: r.root for r in components(edges).collect()}
    want = union(len(bits), [(i, j) for i in range(len(bits)) for j in range(i) if (bits[i] ^ bits[j]).bit_count() <= 4])
    groups = {}
    for i, w in enumerate(want):
        groups.setdefault(w, set()).add(roots.get(signed[i], signed[i]))
    assert all(len(g) == 1 for g in groups.values()) and len(set().union(*groups.values())) == len(groups)


def test_components_of_a_chain_and_a_hub(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(1000, 1000 + i) for i in range(1, 200)] + [(5000, 5000)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[i] for i in range(1, 61)} == {0} and {got[1000 + i] for i in range(1, 200)} == {1000}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_near_duplicates_of_awkward_rows(awkward, empty):
    rows = awkward.collect()
    bits = [slow_simhash(r.text) for r in rows]
    want = union(len(rows), [(i, j) for i in range(len(rows)) for j in range(i) if (bits[i] ^ bits[j]).bit_count() <= 4])
    least = {}
    for w, r in zip(want, rows, strict=True):
        if r.doc_id is not None:
            least[w] = min(least.get(w, r.doc_id), r.doc_id)
    expected = sorted((str(r.doc_id), f"{b:016x}", str(least.get(w))) for r, b, w in zip(rows, bits, want, strict=True))
    got = near_duplicates(awkward)
    assert sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in got.collect()) == expected
    assert near_duplicates(empty).count() == 0
    kept = keep_one_each(awkward).collect()
    assert sorted(str(r.doc_id) for r in kept) == sorted({str(i) for i in least.values()} | {"None"})
    assert all(r in rows for r in kept)
    assert keep_one_each(empty).count() == 0
