import math
import re
from collections import defaultdict

import pytest

from reconlake.llm.mixing import mix_sources


def words(text):
    return len([w for w in re.split("[ \t-\r]+", text or "") if w])


def corpus(spark):
    rows = [(i, " ".join(["w"] * (1 + i % 9)), ["hot"] * 5 + ["b", None, "c"]) for i in range(800)]
    return spark.createDataFrame([(i, t, s[i % 8], 0.0) for i, t, s in rows] + [(900 + i, None, "blank", 0.0) for i in range(3)], "doc_id long, text string, source string, weight double")


def tally(rows):
    tokens, read = defaultdict(int), defaultdict(int)
    for r in rows:
        read[r.source] += words(r.text)
        if r.epoch == 1:
            tokens[r.source] += words(r.text)
    return tokens, read


def entropy(parts):
    total = sum(parts)
    return -sum(p / total * math.log(p / total) for p in parts if p)


def test_cover_budget_reads_everything_and_meets_the_entropy(spark):
    docs = corpus(spark)
    rows = mix_sources(docs, target_entropy=0.95, max_repetition=9.0, docs_per_block=16).collect()
    assert {r.doc_id for r in rows} == {r.doc_id for r in docs.collect()}
    tokens, read = tally(rows)
    assert read["hot"] == tokens["hot"] and read["b"] > tokens["b"]
    weights = {r.source: r.weight for r in rows}
    assert weights["blank"] == 0 and math.isclose(sum(weights.values()), 1, abs_tol=1e-9)
    assert 0 <= entropy(list(weights.values())) / math.log(4) - 0.95 < 1e-6
    scale = tokens["hot"] / weights["hot"]
    for s in ("b", "c", None):
        assert -10 < read[s] - weights[s] * scale <= 1


def test_repetition_limit_wins(spark):
    tokens, read = tally(mix_sources(corpus(spark), target_entropy=1.0, max_repetition=2.0, docs_per_block=16).collect())
    assert all(read[s] <= 2 * tokens[s] for s in tokens) and max(read[s] / tokens[s] for s in tokens if tokens[s]) > 1.9


@pytest.mark.parametrize("per_block", [4096, 16, 1])
def test_budget_is_read_in_whole_and_partial_passes(spark, per_block):
    docs = corpus(spark)
    everything = sum(words(r.text) for r in docs.collect())
    rows = mix_sources(docs, target_entropy=0.99, max_repetition=None, budget_tokens=everything // 2, docs_per_block=per_block).collect()
    assert everything // 2 - 40 < sum(words(r.text) for r in rows) <= everything // 2
    by = defaultdict(set)
    for r in rows:
        by[r.source, r.epoch].add(r.doc_id)
    for (source, epoch), ids in by.items():
        assert epoch == 1 or ids <= by[source, epoch - 1]
    cut = {r.source: max((x.block, x.doc_order) for x in rows if x.source == r.source and x.epoch == r.epoch) for r in rows}
    assert set(cut) == {"hot", "b", "c", None, "blank"}


def test_awkward_rows_and_no_rows(awkward, empty):
    got = mix_sources(awkward)
    assert [c for c in awkward.columns if c in got.columns] == awkward.columns
    keys = lambda rows: sorted(str((r.doc_id, r.text, r.source)) for r in rows)
    assert set(keys(got.collect())) == set(keys(awkward.collect()))
    assert mix_sources(empty).count() == 0


def test_a_lone_source_is_read_once(spark):
    docs = spark.createDataFrame([(i, "a b", "s") for i in range(20)], "doc_id long, text string, source string")
    assert mix_sources(docs).count() == 20
