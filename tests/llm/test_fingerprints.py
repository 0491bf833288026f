import hashlib
import math
import random
import re
import struct
from collections import Counter

import pytest
import xxhash
from pyspark.sql import functions as F

from reconlake.llm import fingerprints
from reconlake.llm.fingerprints import edited_fingerprints, fingerprint_documents


def chained(*parts):
    """Spark's xxhash64 of a long or text and then ints."""
    h = 42
    for p in parts:
        data = p.encode() if isinstance(p, str) else struct.pack("<i" if i32(p) else "<q", int(p))
        h = xxhash.xxh64_intdigest(data, h)
    return h


class I(int):  # noqa: E742  a 32-bit whole number
    pass


def i32(x):
    return isinstance(x, I)


def weights(text):
    return Counter(w for w in re.split("[ \t-\r]+", text or "") if w)


def slow_print(text, samples):
    out = []
    width = fingerprints.WIDTH
    for d in range(-(-samples // width) * width):
        best = None
        for word, n in weights(text).items():
            signed = chained(word)
            signed -= (1 << 64) * (signed >> 63)
            p, q = (chained(signed, I(d), I(i)) for i in (1, 2))
            u = lambda bits, low: ((bits >> low & (1 << 21) - 1) + 0.5) * 2.0**-21
            r, c, b = -math.log(u(p, 0) * u(p, 21)), math.log(-math.log(u(p, 42) * u(q, 0))), u(q, 21)
            t = math.floor(math.log(n) / r + b)
            value = (int((c - r * (t - b + 1) + 128.0) * (1 << 23)) << 32) | ((p & (1 << 32) - 1) ^ (t & (1 << 32) - 1))
            best = value if best is None else min(best, value)
        if best is not None:
            out.append(f"{best & (1 << 32) - 1:08x}")
    return "".join(out)


def alike(a, b, samples):
    if not a or not b:
        return float(a == b)
    return sum(a[8 * i : 8 * i + 8] == b[8 * i : 8 * i + 8] for i in range(samples)) / samples


@pytest.mark.parametrize(("per_cell", "hot"), [(512, False), (4, False), (4, True), (2, True)])
def test_edited_fingerprints_by_brute_force(awkward, per_cell, hot):
    samples = 8
    docs = awkward.where("doc_id IS NULL OR doc_id <> 34").select("doc_id", "text", "word")
    if hot:  # half of the rows without an id, and some with one and the same
        docs = docs.withColumn("doc_id", F.when(F.xxhash64("text") % 2 == 0, None).when(F.col("doc_id") % 3 == 0, 9).otherwise(F.col("doc_id"))).dropDuplicates(["doc_id", "text"]).cache()
    rows = [(r.doc_id, r.text or "") for r in docs.collect()]
    got = edited_fingerprints(docs, samples, per_cell).collect()

    def place(row):
        h = xxhash.xxh64_intdigest(row[1].encode(), 42)
        return (row[0] is not None, row[0] or 0, h - (1 << 64) * (h >> 63))

    rows.sort(key=place)
    want = []
    for (doc, text), (_, following) in zip(rows, rows[1:] + rows[:1], strict=True):
        q = len(text) // 4
        edited = text[: len(text) - q] + following[:q]
        own, new, nxt = (slow_print(x, samples) for x in (text, edited, following))
        want.append((str(doc), len(text), hashlib.sha256(edited.encode()).hexdigest(), own, new, alike(own, new, samples), alike(own, nxt, samples)))
    assert sorted((str(r[0]), *r[1:]) for r in got) == sorted(want)


def test_collisions_follow_generalised_jaccard(spark):
    rng = random.Random(9)
    words = [f"w{i}" for i in range(60)]
    texts = []
    for i in range(12):
        own = [rng.choice(words) for _ in range(150)]
        other = own[: 10 * i] + [rng.choice(words) for _ in range(150 - 10 * i)]
        texts.append((" ".join(own), " ".join(other)))
    df = spark.createDataFrame([(2 * i + j, t) for i, pair in enumerate(texts) for j, t in enumerate(pair)], "doc_id long, text string")
    prints = {r.doc_id: r.fingerprint for r in fingerprint_documents(df, 600).collect()}
    for i, (a, b) in enumerate(texts):
        x, y = weights(a), weights(b)
        true = sum((x & y).values()) / sum((x | y).values())
        assert abs(alike(prints[2 * i], prints[2 * i + 1], 600) - true) < 0.09


def test_equal_texts_and_no_texts(spark, empty, awkward):
    assert edited_fingerprints(empty).count() == 0 and fingerprint_documents(empty).count() == 0
    one = edited_fingerprints(spark.createDataFrame([(5, "a b c d")], "doc_id long, text string")).first()
    assert one.near_next == 1.0 and one.edited_sha256 == hashlib.sha256(b"a b c a").hexdigest()
    got = fingerprint_documents(awkward).where(F.col("doc_id").isin(3, 36, 37)).select("fingerprint").distinct()
    assert got.count() == 1 and fingerprint_documents(awkward).count() == awkward.count()
