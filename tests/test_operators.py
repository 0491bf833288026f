import random
from datetime import date, timedelta

from pyspark.sql import functions as F

from reconlake.operators.assign import greedy_assign
from reconlake.operators.candidates import allocate, as_of
from reconlake.operators.journal import apportion, apportion_each
from reconlake.operators.settle import match_mirrors, match_settlements, mirror_orphans


def test_rounds_equal_one_greedy_pass(spark):
    rng = random.Random(1)
    for _ in range(3):
        edges = sorted({(rng.randint(0, 15), tuple(sorted(rng.sample(range(15), rng.randint(1, 3)))), rng.randint(0, 3)) for _ in range(60)}, key=lambda e: (-e[2], e[0], e[1]))
        used, want = set(), []
        for t, bs, s in edges:
            ends = {("l", t), *(("r", b) for b in bs)}
            if not ends & used:
                used |= ends
                want.append((t, bs, s))
        df = spark.createDataFrame([(t, list(bs), s) for t, bs, s in edges], "t int, bs array<int>, s int").repartition(4)
        for few in (0, 20, 20_000):
            got = greedy_assign(df, "t", "bs", [-F.col("s"), F.col("t"), F.col("bs")], in_one_task=few).collect()
            assert sorted((r.t, tuple(r.bs), r.s) for r in got) == sorted(want)
    assert greedy_assign(df.limit(0), "t", "bs", [F.col("s")]).count() == 0


def test_apportioned_parts_add_up(spark):
    rng = random.Random(2)
    rows = [(e, rng.choice([-1, 1]) * rng.randint(0, 10**12), rng.choice([0, 1, 2, 2, 7]) if e else 0, i) for e in range(20) for i in range(5)]
    amounts = {e: a for e, a, _, _ in rows}
    df = spark.createDataFrame([(e, amounts[e], w, i) for e, _, w, i in rows], "e int, amount long, w long, i int")
    parts = apportion(df, ["e"], "amount", "w", "i")
    assert {r.e: r.s for r in parts.groupBy("e").agg(F.sum("part").alias("s")).collect()} == amounts
    for r in parts.collect():
        total = sum(w for e, _, w, _ in rows if e == r.e)
        assert not total or abs(abs(r.part) - abs(r.amount) * r.w / total) < 1.001


def test_as_of_takes_the_last_value_before(spark):
    d = date(2024, 1, 1)
    events = spark.createDataFrame([(1, d, 1, 10), (1, d, 2, 20), (1, d + timedelta(1), 1, None), (1, d + timedelta(3), 1, 30)], "k int, day date, o int, v int")
    points = spark.createDataFrame([(1, d + timedelta(i)) for i in range(5)] + [(2, d)], "k int, at date")
    got = {(r.k, r.at): r.as_of_v for r in as_of(points, events, ["k"], "at", "day", ["o"], "v").collect()}
    assert [got[1, d + timedelta(i)] for i in range(5)] == [None, 20, 20, 20, 30] and got[2, d] is None


def test_allocation_is_a_waterfall(spark):
    left = spark.createDataFrame([(1, "a", 100, 1), (1, "b", 50, 2)], "k int, t string, x long, o int")
    right = spark.createDataFrame([(1, "p", -30, 1), (1, "q", -120, 2), (1, "r", -9, 3)], "k int, b string, y long, o2 int")
    got = sorted((r.t, r.b, r.allocated) for r in allocate(left, right, ["k"], "t", "x", ["o"], "b", "y", ["o2"]).collect())
    assert got == [("a", "p", 30), ("a", "q", 70), ("b", "q", 50)]


def test_settlement_passes(spark):
    d = date(2024, 5, 1)
    pos = spark.createDataFrame([(1, 7, d, 1000, "0012"), (2, 7, d, 500, "99"), (3, 8, d, 300, "5"), (4, 8, d, 310, "6"), (5, 7, d, 700, None)], "pos_id int, branch_id int, sale_date date, amount long, receipt string")
    sets = spark.createDataFrame([(11, 7, d + timedelta(3), 1050, "12"), (12, 9, d, 1000, "12"), (13, None, d + timedelta(1), 500, "77"), (14, 8, d, 305, "1"), (15, 7, d, 705, "x")], "settlement_id int, branch_id int, sale_date date, gross long, receipt string")
    got = sorted((r.pos_id, r.settlement_id, r.matched_by, r.difference) for r in match_settlements(pos, sets).collect())
    # 14 is the only one that fits 3, and is gone when 4 comes
    assert got == [(1, 11, "receipt", 50), (2, 13, "exact", 0), (3, 14, "tolerant", 5), (5, 15, "tolerant", 5)]


def test_manual_links_and_several_receipts(spark):
    d = date(2024, 5, 1)
    pos = [(1, 7, d, 1000, "900", "N OPE 4047/4048"), (2, 7, d, 500, None, "OP.0515-517"), (3, 7, d, 800, None, "N OPE 4047/4048"), (4, 7, d, 90, "1", None)]
    sets = [(11, 7, d, 600, "4047"), (12, None, d + timedelta(2), 410, "04048"), (13, 7, d, 200, "515"), (14, 7, d, 200, "516"), (15, 7, d, 100, "517"), (16, 8, d, 100, "517"), (17, 9, d, 1, "1")]
    links = spark.createDataFrame([(4, 17)], "pos_id int, settlement_id int")
    got = match_settlements(
        spark.createDataFrame(pos, "pos_id int, branch_id int, sale_date date, amount long, receipt string, memo string"),
        spark.createDataFrame(sets, "settlement_id int, branch_id int, sale_date date, gross long, receipt string"), links,
    )
    assert sorted((r.pos_id, r.settlement_id, r.matched_by, r.difference) for r in got.collect()) == [(1, 11, "several", 10), (1, 12, "several", 10), (2, 13, "several", 0), (2, 14, "several", 0), (2, 15, "several", 0), (4, 17, "manual", -89)]


def slow_mirrors(rows):
    """One OUT after the other: only or closing candidates first, the rest afterwards."""
    owners = {r[6] for r in rows}
    outs = sorted((r for r in rows if r[1] == "OUT" and r[5] is not None), key=lambda r: (r[3], r[0]))
    ins = [r for r in rows if r[1] == "IN" and (r[5] is not None or r[4] is None)]
    fits = {o[0]: [i for i in ins if i[6] == o[5] and abs(i[2]) == abs(o[2]) and abs((i[3] - o[3]).days) <= 2] for o in outs}
    used, found, later = set(), [], []
    for o in outs:
        back = [i for i in fits[o[0]] if i[0] not in used and i[5] == o[6]]
        only = fits[o[0]] if len(fits[o[0]]) == 1 and fits[o[0]][0][0] not in used else []
        pick, name = (only, "clean") if len(fits[o[0]]) == 1 else (back, "circle")
        if len(pick) == 1:
            used.add(pick[0][0])
            found.append((o[0], pick[0][0], name, o[5] == o[6]))
        else:
            later.append(o)
    for o in later:
        pool = sorted((i for i in fits[o[0]] if i[0] not in used), key=lambda i: (i[5] != o[6], i[3], i[0]))
        if pool:
            used.add(pool[0][0])
            found.append((o[0], pool[0][0], "block", o[5] == o[6]))
    done = {f[0] for f in found}
    left = [(o[0], "OUT", "no-dest-account" if o[5] not in owners else "no-candidate" if not fits[o[0]] else "ambiguous") for o in outs if o[0] not in done]
    return sorted(found), sorted(left + [(i[0], "IN", "no-out") for i in ins if i[5] is not None and i[0] not in used])


def test_mirrors_like_one_after_the_other(spark):
    rng, d = random.Random(9), date(2024, 5, 1)
    rows = [(f"m{i:03}", rng.choice(["IN", "OUT"]), rng.randint(1, 3) * rng.choice([-1, 1]), d + timedelta(rng.randint(0, 12)), rng.choice([None, "x"]), rng.choice([None, 1, 2, 3, 9]), rng.randint(1, 3)) for i in range(220)] + [("m999", "OUT", -99, d, None, 1, 2)]
    df = spark.createDataFrame(rows, "bank_id string, direction string, amount long, post_date date, counterparty string, names int, owner int")
    pairs = match_mirrors(df, "names", "owner")
    want, left = slow_mirrors(rows)
    assert sorted(map(tuple, pairs.collect())) == want and {w[2] for w in want} == {"clean", "circle", "block"}
    assert sorted(map(tuple, mirror_orphans(df, "names", "owner", pairs).collect())) == left and len({w[2] for w in left}) == 4


def test_mirrors(spark):
    d = date(2024, 5, 1)
    rows = [("o1", "OUT", -10, d, None, 2, 1), ("i1", "IN", 10, d + timedelta(2), None, None, 2), ("o2", "OUT", -20, d, None, 2, 1), ("i2", "IN", 20, d, None, 3, 2), ("i3", "IN", 20, d + timedelta(1), None, 1, 2), ("o3", "OUT", -30, d, None, 5, 1), ("i4", "IN", 10, d, "outsider", None, 2)]
    df = spark.createDataFrame(rows, "bank_id string, direction string, amount long, post_date date, counterparty string, names int, owner int")
    got = sorted((r.out_id, r.in_id, r.found_by) for r in match_mirrors(df, "names", "owner").collect())
    assert got == [("o1", "i1", "clean"), ("o2", "i3", "circle")]


def test_every_entry_by_the_same_weights_without_a_shuffle(spark):
    entries = spark.createDataFrame([(i, a) for i, a in enumerate([100, -100, 7, -1, 0, 9_007_199_254_740_993, None])], "e int, amount long")
    for headcounts in ([3, 3, 2, 0], [0, 0, 0, 0], [1, 5, 5, 2]):
        weights = spark.createDataFrame(list(enumerate(headcounts)), "b int, w long")
        got = apportion_each(entries, weights, "amount", "w", "b").select("e", "b", "part")
        want = apportion(entries.crossJoin(weights), ["e"], "amount", "w", "b").select("e", "b", "part")
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and got.count() == 28
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert not any(x in plan for x in ("Exchange", "Window", "Sort "))
