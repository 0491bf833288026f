from collections import Counter, defaultdict

import pytest
from test_jaccard import slow_components
from test_simhash import union  # noqa: F401  used by slow_components

import corpus_pipeline
from reconlake.llm.toxicity import train, words_of

SF = "/root/testdata/sf0.001"


def test_stages_by_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = stage(spark, docs, SF).cache()
        kept[name] = docs.collect()
        assert name == "packing" or docs.columns == before.columns
    rows = spark.read.parquet(f"{SF}/documents.parquet").collect()
    model = train(spark.createDataFrame(rows), labels)
    clean = [r for r in rows if model.logit(words_of(r.text or "")) < 0]
    assert sorted(r.doc_id for r in kept["toxicity"]) == sorted(r.doc_id for r in clean)
    toxic = {r.doc_id for r in labels.where("toxic = 1").collect()}
    assert len(toxic & {r.doc_id for r in clean}) <= 0.2 * len(toxic)
    groups = {int(component) for _, component in slow_components([(r.doc_id, r.text) for r in clean])}
    assert sorted(r.doc_id for r in kept["simhash near-dedup"]) == sorted(groups)
    assert {r.doc_id for r in kept["source mixing"]} == groups
    pieces = kept["packing"]
    copies = Counter(r.doc_id for r in kept["source mixing"])
    total = defaultdict(int)
    for p in pieces:
        assert p.doc_tokens >= p.start + p.length
        total[p.doc_id] += p.length
    lengths = {p.doc_id: p.doc_tokens for p in pieces}
    assert all(total[d] == n * lengths[d] for d, n in copies.items())


def test_run_is_its_stages(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0


@pytest.mark.parametrize("number", range(4))
def test_stages_of_awkward_and_no_rows(spark, awkward, empty, number):
    _, stage = corpus_pipeline.STAGES[number]
    for extra in ({}, {"word": "weight", "row": "n_words", "draw": "epoch", "block": "block_order"}):
        renamed = [df.withColumnsRenamed(extra) for df in (awkward, empty)]
        got, none = (stage(spark, df, SF) for df in renamed)
        assert none.count() == 0
        if number == 3:
            assert {p.doc_id for p in got.collect()} == {r.doc_id for r in renamed[0].collect()}
            continue
        assert got.columns == renamed[0].columns and none.columns == renamed[0].columns
        rows, known = Counter(map(str, got.collect())), Counter(map(str, renamed[0].collect()))
        assert rows.keys() <= known.keys()
        if number == 0:
            model = train(renamed[0], spark.read.parquet(f"{SF}/labels.parquet"))
            assert rows == Counter(str(r) for r in renamed[0].collect() if model.logit(words_of(r.text or "")) < 0)
        if number == 1:
            want = {c for _, c in slow_components([(r.doc_id, r.text) for r in awkward.collect()])}
            assert {str(r.doc_id) for r in got.collect()} == want | {"None"}
        if number == 2:
            assert rows.keys() == known.keys()
