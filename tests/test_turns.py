"""Rows that take sums of others in turn, against one after the other in plain Python, however many rows are near."""

import random
from datetime import date, timedelta
from itertools import combinations

from pyspark.sql import functions as F

from reconlake.operators import turns
from reconlake.operators.matching import inverse_split_run
from reconlake.operators.replay import ASK, OFFER
from reconlake.operators.turns import TurnsOfSums
from reconlake.plans import catalog
from reconlake.plans.views import Views

DAY = date(2024, 1, 1)


def one_after_the_other(bank, treasury, most=None):
    """(id, key, amount, day number) of both sides."""
    used, won, sizes = set(), [], set()
    for b in sorted(bank, key=lambda b: (b[3], b[0])):
        pool = sorted({t for t in treasury if t[1] == b[1] and abs(t[3] - b[3]) <= 7 and abs(t[2]) < abs(b[2])})
        sizes.add(len(pool))
        free = [t for t in pool if t[0] not in used]
        fits = (c for n in (2, 3) if n == 2 or most is None or len(pool) <= most for c in combinations(free, n) if sum(t[2] for t in c) == b[2] and (n == 2 or c[2][2] * b[2] > 0))
        if took := next(fits, None):
            used |= {t[0] for t in took}
            won.append((b[0], [t[0] for t in took]))
    return sorted(won), sizes


def test_sums_of_any_number_of_rows(monkeypatch):
    taken = set()
    for seed, signs, most, kept in ((1, [1], None, 1000), (2, [1, 1, -1], None, 1000), (3, [1], 12, 1000), (4, [1, -1], None, 0), (5, [1], None, 0)):
        monkeypatch.setattr(turns, "MOST_KEPT", kept)
        rng = random.Random(seed)
        treasury = [(f"t{i:03}", 1, rng.choice(signs) * rng.choice([1, 4, 6, 9, 30, 31, 55, 56, 80]), rng.randint(0, 30)) for i in range(90)]
        bank = [(f"b{i:03}", 1, rng.choice(signs) * rng.choice([8, 13, 40, 61, 92, 118, 141, 168]), rng.randint(0, 30)) for i in range(60)]
        rng.shuffle(treasury)
        shelf, got = TurnsOfSums(7, most), []
        rows = [(d - 7, OFFER, d, (i, amount, None)) for i, _, amount, d in treasury] + [(d, ASK, d, (None, amount, i)) for i, _, amount, d in bank]
        for _, kind, day, row in sorted(rows, key=lambda r: (*r[:3], r[3][0] or r[3][2])):
            got += shelf.meet(kind, day, row)
        want, sizes = one_after_the_other(bank, treasury, most)
        assert sorted(got) == want and max(sizes) > 20
        taken |= {len(ids) for _, ids in want}
    assert taken == {2, 3}


def test_the_run_has_no_cap_and_no_list_of_candidates(spark):
    """Nine smaller rows or more around a bank row were too many; and two bank rows of one sum take turns."""
    treasury = [(f"t{i:02}", "a", 1000 + 20 * i, DAY) for i in range(12)] + [("x", "a", 3, DAY), ("y", "a", 4, DAY), ("z", "a", 1006, DAY), ("z", "a", 1006, DAY), (None, "a", 3, DAY), ("n", "a", None, DAY)]
    bank = [("b1", "a", 1013, DAY), ("b0", "a", 1013, DAY + timedelta(1)), ("b2", "a", 2020, DAY), ("b3", None, 2010, DAY), ("b4", "a", None, DAY)]
    frames = spark.createDataFrame(bank, "bank_id string, k string, amount long, post_date date"), spark.createDataFrame(treasury, "treasury_id string, k string, amount long, doc_date date")
    got = inverse_split_run(*frames, ["k"], most_rows=None)
    assert sorted(map(tuple, got.collect())) == [("b1", ["x", "y", "z"]), ("b2", ["t00", "t01"])]
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_the_query_like_one_after_the_other(spark):
    sf = "/root/testdata/sf0.001"
    v = Views(spark, sf)
    number = F.unix_date
    bank = v.ledger.where("account_id IS NOT NULL").select(F.col("treasury_id").cast("string"), "account_id", F.abs("amount"), number("doc_date"))
    treasury = v.ledger_bank.select("bank_id", "account_id", F.abs("amount"), number("post_date"))
    want, _ = one_after_the_other(list(map(tuple, bank.collect())), list(map(tuple, treasury.collect())))
    got = catalog.queries()["D13_inverse_splits_run"](spark, sf)
    assert sorted((r.bank_id, r.treasury_ids.split("|")) for r in got.collect()) == want and {len(ids) for _, ids in want} == {2, 3}
