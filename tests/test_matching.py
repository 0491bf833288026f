"""The matching run against one pass in plain Python, and the assignment's rounds on chains and repeated edges."""

import random
import re
from collections import defaultdict
from datetime import date, timedelta
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from reconlake.functions.names import STOP_WORDS
from reconlake.operators.assign import greedy_assign
from reconlake.operators.candidates import allocate, window_join
from reconlake.operators.clusters import duplicate_clusters
from reconlake.operators.matching import inverse_split_run
from reconlake.plans import catalog
from reconlake.plans.views import Views

SF = "/root/testdata/sf0.001"


def words(text, least):
    return [w for w in re.split("[^A-Z0-9]+", (text or "").upper()) if len(w) >= least and not w.isdigit() and w not in STOP_WORDS]


def score(t, b, wrong=False):
    delta = (b.post_date - t.doc_date).days
    total = 30 + {0: 25, 1: 18, 2: 12, 3: 6}.get(abs(delta), 3) + (3 if delta > 0 else 0) - 15 * wrong
    total += 10 if t.tax_id and t.tax_id == b.counterparty_tax_id else 0
    there = (b.counterparty or "").upper()
    if there and t.client:
        surname = t.client.upper().split(",")[0].strip()
        named = "GENERICO" not in t.client.upper()
        if named and len(surname) >= 3 and surname in there:
            total += 25
        elif named and any(w in there for w in words(t.client, 3)):
            total += 12
        elif any(w in there for w in words(t.memo, 3)):
            total += 15
    return total, abs(delta)


def tied(t, b):
    there = (b.counterparty or "").upper()
    return bool(t.tax_id and t.tax_id == b.counterparty_tax_id) or ("GENERICO" not in t.client.upper() and any(w in there for w in words(t.client, 4))) or any(w in there for w in words(t.memo, 4))


def slow_candidates(ledger, bank, codes):
    by_account, by_amount = defaultdict(list), defaultdict(list)
    for b in bank:
        by_account[b.account_id, b.direction].append(b)
        by_amount[b.direction, b.amount].append(b)
    for t in ledger:
        marker = getattr(t, "marker", None)
        near = [b for b in by_account[t.account_id, t.direction] if abs((b.post_date - t.doc_date).days) <= 7 and (marker or "") in f"{b.counterparty or ''} {b.memo or ''}".upper()]
        for b in near:
            if b.amount == t.amount:
                s, days = score(t, b)
                yield t, [b.bank_id], s, days, False
        pool = [b for b in near if abs((b.post_date - t.doc_date).days) <= 3 and abs(b.amount) < abs(t.amount)]
        for n, penalty in ((2, -5), (3, -10)):
            for parts in combinations(pool, n) if n == 2 or len(pool) <= 20 else ():
                if sum(p.amount for p in parts) == t.amount and parts[-1].amount * t.amount > 0:
                    found = [score(t, p) for p in parts]
                    yield t, sorted(p.bank_id for p in parts), sum(s for s, _ in found) / n + penalty, max(d for _, d in found), False
        for b in by_amount[t.direction, t.amount]:
            if b.account_id != t.account_id and {t.account_id, b.account_id} <= codes.keys() and abs((b.post_date - t.doc_date).days) <= 7 and tied(t, b):
                s, days = score(t, b, True)
                yield t, [b.bank_id], s, days, codes.get(t.account_id) != codes.get(b.account_id)


def test_run_like_one_row_after_the_other(spark):
    v = Views(spark, SF)
    ledger, bank = v.ledger.collect(), v.ledger_bank.collect()
    codes = {r.account_id: r.bank_code for r in v.account.collect()}
    settled = {t.treasury_id: "ANNULLED" if t.state == "ANU" else "OUT_OF_SCOPE" if t.account_id is None else "REVIEW" for t in ledger if t.state == "ANU" or t.account_id is None or re.match(r"DEP \(\d+\) ", t.memo)}
    found = slow_candidates([t for t in ledger if t.treasury_id not in settled], bank, codes)
    used, won = set(), {}
    for t, ids, s, days, capped in sorted(found, key=lambda c: (-c[2], c[3], c[0].treasury_id, len(c[1]), c[1])):
        ends = {("t", t.treasury_id), *ids}
        if not ends & used:
            used |= ends
            won[t.treasury_id] = (ids, s, days, capped)
    want = {}
    for t in ledger:
        if t.treasury_id in settled:
            want[t.treasury_id] = (settled[t.treasury_id], None, None)
        elif t.treasury_id in won:
            ids, s, _, capped = won[t.treasury_id]
            status = "AUTO" if s >= 50 else "SUGGESTED" if s >= 35 else "REVIEW"
            want[t.treasury_id] = ("SUGGESTED" if status == "AUTO" and (capped or t.is_exception) else status, round(s, 6), "|".join(ids))
        else:
            want[t.treasury_id] = ("REVIEW" if t.is_exception else "NO_MATCH", None, None)
    rows = catalog.queries()["E07_outcomes"](spark, SF).collect()
    assert {r.treasury_id: (r.outcome, None if r.score is None else round(r.score, 6), r.bank_ids) for r in rows} == want
    kinds = defaultdict(int)
    for r in rows:
        kinds[r.outcome, r.match_type] += 1
    assert {o for o, _ in kinds} == {"ANNULLED", "OUT_OF_SCOPE", "REVIEW", "AUTO", "SUGGESTED", "NO_MATCH"}
    assert {m for _, m in kinds} >= {"EXACT_SAME_DAY", "SPLIT_PM3", "ACCOUNT_MISMATCH", None} and any(r.bank_ids and r.bank_ids.count("|") == 2 for r in rows)


@pytest.mark.parametrize(("n", "in_one_task"), [(150, 20_000), (24, 0), (24, 10)])
def test_a_long_chain_of_edges_is_followed_to_its_end(spark, n, in_one_task):
    falling = [(i, i + j, 1000 - 2 * i - j) for i in range(n) for j in (0, 1)]
    df = spark.createDataFrame(falling, "t int, b int, s int").repartition(2)
    got = greedy_assign(df, "t", "b", [-F.col("s")], in_one_task=in_one_task).collect()
    assert sorted((r.t, r.b) for r in got) == [(i, i) for i in range(n)]


def test_repeated_edges_are_one(spark):
    df = spark.createDataFrame([(1, 1, 5), (1, 1, 5), (2, 1, 4), (2, 2, 3)], "t int, b int, s int")
    for few in (0, 10):
        assert sorted(map(tuple, greedy_assign(df, "t", "b", [-F.col("s")], in_one_task=few).collect())) == [(1, 1, 5), (2, 2, 3)]


def test_windows_meet_by_key_and_block(spark):
    left = spark.sql("SELECT id AS l, id % 3 AS k, date_add(DATE '1969-12-01', CAST(id * 7 % 97 AS int)) AS d FROM range(60)")
    right = spark.sql("SELECT id AS r, id % 3 AS k, date_add(DATE '1969-12-01', CAST(id * 5 % 101 AS int)) AS e FROM range(80)")
    for days in (0, 3, 7):
        met = window_join(left, right, ["k"], "d", "e", days)
        want = left.join(right, "k").where(f"abs(datediff(d, e)) <= {days}")
        assert sorted((x.l, x.r) for x in met.collect()) == sorted((x.l, x.r) for x in want.collect()) and met.where("delta <> datediff(e, d)").count() == 0


def test_allocation_of_a_hot_client_with_empty_amounts(spark):
    left = [(1, f"l{i}", i * 7 % 5 * 10, i) for i in range(60)]
    right = [(1, f"r{i}", i * 3 % 4 * 15, i) for i in range(50)]

    def spans(rows):
        at = 0
        for _, name, amount, _ in rows:
            yield name, at, at + amount
            at += amount

    want = sorted((x, y, min(b, d) - max(a, c)) for x, a, b in spans(left) for y, c, d in spans(right) if a < d and c < b)
    got = allocate(spark.createDataFrame(left, "k int, t string, x long, o int"), spark.createDataFrame(right, "k int, b string, y long, o2 int"), ["k"], "t", "x", ["o"], "b", "y", ["o2"])
    assert sorted((r.t, r.b, r.allocated) for r in got.collect()) == want


def test_inverse_splits_like_one_after_the_other(spark):
    rng = random.Random(4)
    day = date(2024, 1, 1)
    treasury = [(f"t{i:03}", i % 2, rng.randint(1, 30), day + timedelta(rng.randint(0, 30))) for i in range(70)]
    bank = [(f"b{i:03}", i % 2, rng.randint(2, 60), day + timedelta(rng.randint(0, 30))) for i in range(25)]
    used, want = set(), []
    for b in sorted(bank, key=lambda b: (b[3], b[0])):
        pool = [t for t in treasury if t[1] == b[1] and abs((t[3] - b[3]).days) <= 7 and t[2] < b[2]]
        fits = [c for n in (2, 3) if n == 2 or len(pool) <= 8 for c in combinations(pool, n) if sum(t[2] for t in c) == b[2]]
        free = next((c for c in fits if not used & {t[0] for t in c}), None)
        if free:
            used |= {t[0] for t in free}
            want.append((b[0], [t[0] for t in free]))
    got = inverse_split_run(spark.createDataFrame(bank, "bank_id string, k int, amount long, post_date date"), spark.createDataFrame(treasury, "treasury_id string, k int, amount long, doc_date date"), ["k"])
    assert sorted((r.bank_id, r.treasury_ids) for r in got.collect()) == sorted(want) and {len(w[1]) for w in want} == {2, 3}


def test_duplicate_clusters(spark):
    rows = [
        (1, 1, "Juan Perez Soto", None, 1), (2, 1, "PEREZ SOTO JUAN", None, 2), (3, 1, "Maria Rojas", None, 3), (4, 1, "Juan", None, 2),
        (5, 2, "A", "1-9", 1), (6, 2, "A", "2-7", 2), (7, 3, "Same", None, 1), (8, 3, "Same", None, 1), (9, 4, "Ana Diaz", None, 1), (10, 4, "Ana Diaz", None, 2), (11, 4, None, "3-5", 3),
        (12, 5, "x", None, 1), (13, 5, None, None, 2), (14, 5, "y", None, 3),
    ]
    df = spark.createDataFrame(rows, "bank_id int, k int, counterparty string, counterparty_tax_id string, import_id int")
    got = {r.bank_id: (r.cluster, r.members, r.confidence) for r in duplicate_clusters(df, ["k"]).collect()}
    # 5: a row without a name links two that don't agree themselves
    assert got == {1: (1, 3, "HIGH"), 2: (1, 3, "HIGH"), 4: (1, 3, "HIGH"), 9: (9, 3, "HIGH"), 10: (9, 3, "HIGH"), 11: (9, 3, "HIGH"), 12: (12, 3, "MEDIUM"), 13: (12, 3, "MEDIUM"), 14: (12, 3, "MEDIUM")}
    assert duplicate_clusters(df.limit(0), ["k"]).count() == 0


def test_clusters_within_rows_and_by_rounds(spark):
    """Keys of few parties don't leave their rows, keys of many meet by joins: the same clusters."""
    rng = random.Random(12)
    names = [None, "Perez Ana", "Ana Perez Soto", "Soto Luz", "Luz", "Rojas", "Rojas Pia Mar", "Mar Sol", "Sol"]
    rows = [(f"b{i:04}", rng.choice([1, 2, 3, 4, 5, None]), rng.randint(1, 3), rng.choice([1, 1, 1, 2, None]), rng.choice(names), rng.choice([None, None, "1-9", "2-7", ""])) for i in range(260)]
    df = spark.createDataFrame(rows, "bank_id string, k int, day int, import_id int, counterparty string, counterparty_tax_id string")
    ways = [sorted(map(tuple, duplicate_clusters(df, ["k", "day"], most_parties=n).collect())) for n in (0, 5, 64)]
    assert ways[0] == ways[1] == ways[2] and ways[0] and {w[3] for w in ways[0]} == {"HIGH", "MEDIUM"}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    plan = duplicate_clusters(df, ["k", "day"])._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert sum("Join" in line for line in plan.splitlines()) == 1
