import random
import zlib

import numpy as np

from reconlake.llm.toxicity import _fit, counterfactuals, features_of, keep_clean, mention_gap, score, swaps, train, words_of
from reconlake.llm.toxicity_selection import cross_validated


def labelled(spark, n=400, biased=False):
    rng = random.Random(10)
    calm = [f"calm{i}" for i in range(40)]
    docs, labels = [], []
    for i in range(n):
        toxic = rng.random() < 0.3
        words = [rng.choice(calm) for _ in range(25)]
        if toxic:
            words[3] = rng.choice(["nastyone", "nastytwo", "vileword"])
        if biased and rng.random() < (0.7 if toxic else 0.1):
            words[7] = "muslim"
        docs.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_held_out_accuracy_and_folds(spark):
    docs, labels = labelled(spark)
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    rows = score(docs, train(docs, labels)).collect()
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == (r.score >= 0.5) and 0 <= r.score <= 1
    assert np.mean([r.predicted == truth[r.doc_id] for r in rows if r.held_out]) > 0.97
    assert {r.doc_id for r in keep_clean(docs, train(docs, labels)).collect()} == {r.doc_id for r in rows if not r.predicted}


def test_labels_of_held_out_rows_change_nothing(spark):
    docs, labels = labelled(spark, 120)
    turned = spark.createDataFrame([(r.doc_id, 1 - r.toxic if zlib.crc32(str(r.doc_id).encode()) % 5 == 0 else r.toxic) for r in labels.collect()], labels.schema)
    assert train(docs, labels) == train(docs, turned)


def test_naming_a_group_moves_no_score(spark):
    docs, labels = labelled(spark, biased=True)
    plain, fair = train(docs, labels, fairness=0.0), train(docs, labels, fairness=20.0)
    shift = lambda m: abs(m.logit(words_of("a muslim calm1")) - m.logit(words_of("a christian calm1")))
    assert shift(fair) < 0.3 * shift(plain)
    rows = [sorted({0, 1}), [1]]
    weight, _ = _fit(rows, [([0], [], 1)], np.array([1.0, 0.0]), 2, 50.0, 0.0, 300)
    assert abs(weight[0]) < 0.5


def test_the_penalty_lowers_the_gap_and_false_positives_on_mentions(spark):
    docs, labels = labelled(spark, biased=True)
    neutral = spark.createDataFrame([(i, f"calm{i} calm{i + 1} a muslim calm{i + 2}") for i in range(30)], "doc_id long, text string")
    off, on = train(docs, labels, fairness=0.0), train(docs, labels)
    gaps = {name: mention_gap(docs, m).first() for name, m in (("off", off), ("on", on))}
    assert gaps["on"].pairs == gaps["off"].pairs > 400 and gaps["on"].gap < 0.5 * gaps["off"].gap
    mentions = lambda m: score(neutral, m).agg({"score": "avg"}).first()[0]
    assert mentions(on) < mentions(off)


def test_every_text_with_words_has_pairs(spark):
    other = swaps()
    assert counterfactuals("", other) == [] and counterfactuals("12 !", other) == []
    named = counterfactuals("A woman sang. The sea was calm.", other)
    assert (words_of("A woman sang."), words_of("A man sang.")) in named and len(named) == 3
    assert all(a != b for a, b in named)
    for text in ("nur worte", "une femme parle", "un hombre y una mujer"):
        assert counterfactuals(text, other)
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    known = docs.join(labels, "doc_id").select("text")
    assert mention_gap(known, train(docs, labels)).first().pairs >= 2 * 0.9 * known.count()


def test_selection_never_reads_the_held_out_fold(spark):
    docs, labels = labelled(spark, 120)
    turned = spark.createDataFrame([(r.doc_id, 1 - r.toxic if zlib.crc32(str(r.doc_id).encode()) % 5 == 0 else r.toxic) for r in labels.collect()], labels.schema)
    found = cross_validated(docs, labels, {"most_features": 100}, folds=(1, 2))
    assert found == cross_validated(docs, turned, {"most_features": 100}, folds=(1, 2)) and found["documents"] > 10


def test_features():
    assert features_of(words_of("Große Hunde, 12 x")) == {"große", "hunde", "x", "groß*", "hund*"}
    assert all(swaps()[t] != t for t in swaps())


def test_awkward_rows_and_no_labels(spark, awkward, empty):
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 1), (3, None, 1), (None, 1, 1), (4, 1, 0), (5, 0, 0), (5, 0, 0), (31, 1, 1)], "doc_id long, toxic int, quality int")
    model = train(awkward, labels, least_docs=1)
    rows = score(awkward, model)
    assert rows.count() == awkward.count() and rows.where("score IS NULL OR predicted IS NULL OR held_out IS NULL").count() == 0
    for none in (labels.limit(0), labels.where("toxic = 1"), labels.where("toxic = 0")):
        model = train(awkward, none)
        assert not model.weights and score(awkward, model).select("score").distinct().count() == 1
    assert score(empty, model).count() == 0 and keep_clean(empty, model).count() == 0 and not train(empty, labels).weights
