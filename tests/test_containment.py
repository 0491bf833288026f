import random

from reconlake.operators.containment import containing
from reconlake.operators.entities import detect


def test_pairs_like_trying_all(spark):
    rng = random.Random(6)
    word = lambda most: "".join(rng.choice("abcé ") for _ in range(rng.randint(0, most)))
    texts = [(i, rng.choice([None, word(3), word(25), word(25), "aaaaaa"])) for i in range(150)]
    needles = [(i, rng.choice([None, word(2), word(5), word(5), "aaa", "zzz"])) for i in range(60)]
    got = containing(spark.createDataFrame(texts, "id int, text string"), "text", spark.createDataFrame(needles, "n int, needle string"), "needle")
    want = sorted((i, n) for i, t in texts for n, x in needles if t and x and x in t)
    assert sorted((r.id, r.n) for r in got.select("id", "n").collect()) == want and len(want) > 100
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_a_thousand_and_more_entities(spark):
    known = [(i, f"{10_000_000 + i}-{i % 10}", [f"Party{i} Spa"]) for i in range(3000)]
    moves = [(1, "PARTY7  spa ltda", None, None), (2, "xPARTY7 spa", None, None), (3, None, "10000012-2", "party9 spa"), (4, None, "010000013-3", None), (5, "de 10.000.014-4", "99", "x"), (6, None, None, "pago 10000015-5"), (7, None, "1000001", None)]
    frame = spark.createDataFrame(moves, "bank_id int, counterparty string, counterparty_tax_id string, memo string")
    got = sorted(map(tuple, detect(frame, spark.createDataFrame(known, "entity_id int, tax_id string, patterns array<string>")).collect()))
    # seven digits are the start of many ids: the least of them
    assert got == [(1, 7, "pattern"), (3, 12, "tax_id"), (4, 13, "tax_id"), (5, 14, "tax_id_in_name"), (6, 15, "tax_id_in_memo"), (7, 10, "tax_id")]
