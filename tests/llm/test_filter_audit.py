import random
import re
from itertools import permutations

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from reconlake.llm.filter_audit import failure_masks, filter_audit, text_masks
from reconlake.llm.queries import FILTER_SQL, op13_filter_audit
from reconlake.llm.shared import byte_buffer

SF = "/root/testdata/sf0.001"


def slow_mask(text):
    text = text or ""
    words = re.findall("[^\x20\x09-\x0d]+", text)
    fails = [len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * len(re.findall("[A-Z]", text)) > 2 * len(text), bool(re.search("[#$%&*|]", text))]
    return sum(1 << i for i, f in enumerate(fails) if f)


def slow_audit(docs, labels):
    """docs: (doc_id, text, source); labels: {doc_id: (quality, toxic)}."""
    rows = []
    for i, text, source in docs:
        copy = i is not None and any(j is not None and j < i and (t or "") == (text or "") for j, t, _ in docs)
        rows.append((source or "", slow_mask(text) | copy << 4, *labels.get(i, (0, 0))))
    out = {}
    for part in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == part]
        shapley = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = own
            for step, f in enumerate(order, 1):
                bit = 1 << "ABCDE".index(f)
                gone = [r for r in left if r[1] & bit]
                failing, left = [r for r in own if r[1] & bit], [r for r in left if not r[1] & bit]
                shapley[f] += len(gone)
                out[part, "".join(order), step] = [len(left), len(gone), len(failing) - len(gone), sum(r[1] == bit for r in own), sum(r[2] for r in gone), sum(r[3] for r in gone), f]
        for key in out:
            if key[0] == part:
                out[key][-1] = shapley[out[key][-1]]
    return {k: tuple(v) for k, v in out.items()}


def told(df):
    return {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in df.collect()}


def drawn_texts(rng, n):
    word = lambda: "".join(rng.choice("abÄ€AB#") for _ in range(rng.choice([1, 2, 7, 8, 9, 16, 17, 70])))
    out = [None, "", " ", "\t\n", "A", "a\x1cb", "\x85 \xa0", "x" * 500, "x" * 70 + "y " + "x" * 70 + "z", "aaaaaaaa aaaaaaaab aaaaaaaa"]
    for _ in range(n):
        pool = [word() for _ in range(rng.choice([3, 60, 150, 300]))]
        out.append(rng.choice(["", " ", "\n"]) + rng.choice([" ", "  ", "\n", " \r\n"]).join(rng.choice(pool) for _ in range(rng.choice([0, 5, 199, 200, 201, 400]))) + rng.choice(["", " "]))
    return out


def test_masks_of_texts():
    texts = drawn_texts(random.Random(1), 150)
    data, offsets = byte_buffer(pa.array(texts))
    assert text_masks(data, offsets).tolist() == [slow_mask(t) for t in texts]
    sliced = pa.array(["skipped", *texts])[1:]
    assert byte_buffer(sliced)[0].tolist() == data.tolist() and byte_buffer(sliced)[1].tolist() == offsets.tolist()


def test_words_of_one_hash_are_told_apart(monkeypatch):
    import reconlake.llm.filter_audit as module

    monkeypatch.setattr(module, "_MIX", np.uint64(0))  # every key is zero
    texts = drawn_texts(random.Random(2), 40)
    assert text_masks(*byte_buffer(pa.array(texts))).tolist() == [slow_mask(t) for t in texts]


def test_every_order_against_brute_force(spark):
    rng = random.Random(3)
    texts = drawn_texts(rng, 60)
    docs = [(i, rng.choice(texts), rng.choice([None, "", "hot", "hot", "b"])) for i in range(90)]
    docs += [docs[4], docs[4], (None, docs[5][1], "b"), (None, "no id", None), (7, "a second text", "hot")]
    labels = {i: (rng.randint(0, 1), rng.randint(0, 1)) for i in range(0, 90, 2)}
    frame = spark.createDataFrame(docs, "doc_id long, text string, source string").selectExpr("*", "1 AS mask", "2 AS part", "3 AS t1", "4 AS labelled").repartition(3)
    marks = spark.createDataFrame([(i, q, t) for i, (q, t) in labels.items()] + [(0, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    assert told(filter_audit(frame, marks)) == slow_audit(docs, labels)


def test_awkward_and_empty_tables(spark, awkward, empty):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit(empty, labels).count() == 0
    docs = [(r.doc_id, r.text, r.source) for r in awkward.collect()]
    assert told(filter_audit(awkward, labels)) == slow_audit(docs, {})
    assert failure_masks(awkward).count() == len(docs)


@pytest.mark.parametrize("sf", [SF])
def test_query_gives_the_rows_of_sql(spark, sf):
    con = duckdb.connect()
    for name in ("documents", "labels"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    got = op13_filter_audit(spark, sf)
    want = con.execute(FILTER_SQL).fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert len(want) == 600 * len({r[0] for r in want})
