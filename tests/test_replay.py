"""Sequential matching replayed by components and rounds, against plain passes over all rows."""

import random
from collections import Counter, defaultdict
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from reconlake.operators.replay import components, replay
from reconlake.operators.settle import match_mirrors, match_settlements
from reconlake.plans import catalog
from reconlake.plans.views import Views

SF = "/root/testdata/sf0.001"
#: One task; components by grouped tasks; rounds alone.
WAYS = [{}, {"in_one_task": 0}, {"in_one_task": 0, "most_edges": 3}]


def plain(receipt):
    return (receipt.lstrip("0") or "0") if receipt else None


def several_receipts(memo):
    import re

    m = re.search(r"(?<!\d)(\d{3,4})\s*[/-]\s*0*(\d{3,4})(?!\d)", memo or "")
    if not m or int(m[1]) == int(m[2]):
        return None
    a, b = int(m[1]), int(m[2])
    return [str(x) for x in (range(a, b + 1) if 0 < b - a <= 4 else (a, b))]


def slow_settlements(pos, sets, links=()):
    """pos: (id, branch, day, amount, receipt, memo); sets: (id, branch, day, gross, receipt)."""
    pos, sets = sorted(pos, key=lambda p: (p[2], p[0])), sorted(sets, key=lambda s: (s[2], s[0]))
    used, done, out = set(), set(), []

    def take(p, chosen, how):
        done.add(p[0])
        used.update(s[0] for s in chosen)
        out.extend((p[0], s[0], how, sum(s[3] for s in chosen) - p[3]) for s in chosen)

    def free(p, days):
        return [s for s in sets if s[0] not in used and s[1] in (None, p[1]) and abs((s[2] - p[2]).days) <= days]

    for p in sorted(pos):
        own = [s for s in sets if (p[0], s[0]) in links and s[0] not in used]
        if own:
            take(p, own, "manual")
    for p in pos:
        fits = [s for s in free(p, 3) if plain(p[4]) and plain(s[4]) == plain(p[4]) and (p[3] == 0 or abs(s[3] - p[3]) * 20 <= abs(p[3]))] if p[0] not in done else []
        if fits:
            take(p, [min(fits, key=lambda s: (abs(s[3] - p[3]), s[2], s[0]))], "receipt")
    for p in pos:
        asked, picked = several_receipts(p[5]) if p[0] not in done and p[3] > 0 else None, []
        for r in asked or []:
            fits = [s for s in free(p, 3) if plain(s[4]) == r and s not in picked]
            picked = picked + fits if len(fits) == 1 else [None] * 99
        if asked and len(picked) == len(asked) and abs(sum(s[3] for s in picked) - p[3]) * 40 <= p[3]:
            take(p, picked, "several")
    for p in pos:
        if p[0] in done:
            continue
        near = free(p, 1)
        exact = [s for s in near if s[3] == p[3]]
        within = [s for s in near if abs(s[3] - p[3]) * 20 <= abs(p[3])]
        if exact:
            take(p, [exact[0]], "exact")
        elif p[3] and len(within) == 1:
            take(p, within, "tolerant")
    return sorted(out)


def told(df):
    return sorted((r.pos_id, r.settlement_id, r.matched_by, r.difference) for r in df.collect())


POS, SETS = "pos_id long, branch_id int, sale_date date, amount long, receipt string, memo string", "settlement_id long, branch_id int, sale_date date, gross long, receipt string"


@pytest.mark.parametrize("way", WAYS)
def test_settlements_like_one_sale_after_the_other(spark, way):
    rng, d = random.Random(8), date(2024, 5, 1)
    receipts = [None, "", "0", "000", "101", "0101", "102", "103", "104"]
    pos = [(i, rng.randint(1, 2), d + timedelta(rng.randint(0, 12)), rng.choice([0, -100, 100, 102, 200, 205, 210, 1000, 1030, 2000]), rng.choice(receipts), rng.choice([None, "N OPE 101/102", "OP.101-103", "0103/101"])) for i in range(120)]
    sets = [(i, rng.choice([None, 1, 1, 2]), d + timedelta(rng.randint(0, 12)), rng.choice([0, -101, 100, 103, 200, 204, 1000, 1010, 50, 998]), rng.choice(receipts)) for i in range(130)]
    # two receipts each; the later sale finds one of them taken
    pos += [(200, 1, d, 300, None, "N OPE 4047/4048"), (201, 1, d + timedelta(1), 300, None, "N OPE 4047/4048"), (202, 2, d, 301, "", "OP.515-517")]
    sets += [(200, 1, d, 100, "4047"), (201, None, d + timedelta(3), 204, "04048"), (202, 2, d, 100, "515"), (203, 2, d, 100, "516"), (204, 2, d, 101, "0517")]
    links = {(3, 4), (3, 5), (7, 5), (8, 9999), (9999, 9), (11, 9)}
    want = slow_settlements(pos, sets, links)
    got = match_settlements(spark.createDataFrame(pos, POS), spark.createDataFrame(sets, SETS), spark.createDataFrame(sorted(links), "pos_id long, settlement_id long"), **way)
    assert told(got) == want and {w[2] for w in want} == {"manual", "receipt", "several", "exact", "tolerant"}


def test_rows_without_receipts_share_none(spark):
    d = date(2024, 5, 1)
    pos = spark.createDataFrame([(1, 7, d, 1000, None, None), (2, 7, d, 3000, "", None), (3, 7, d, 100, None, None), (4, 7, d + timedelta(9), 100, None, None)], POS)
    sets = spark.createDataFrame([(5, 7, d + timedelta(3), 1040, None), (6, 7, d + timedelta(2), 3010, ""), (7, 7, d, 102, None), (8, 7, d, 98, None)], SETS)
    assert told(match_settlements(pos, sets)) == []  # two candidates of sale 3 are both free
    one = sets.where("settlement_id <> 8")
    assert told(match_settlements(pos, one)) == [(3, 7, "tolerant", 2)]


def test_the_tolerant_rule_asks_the_sale_alone(spark):
    d = date(2024, 5, 1)
    pos = spark.createDataFrame([(1, 7, d, 1000, None, None), (2, 7, d + timedelta(1), 1001, None, None)], POS)
    sets = spark.createDataFrame([(5, 7, d + timedelta(1), 1004, None)], SETS)
    assert told(match_settlements(pos, sets)) == [(1, 5, "tolerant", 4)]


def test_query_runs_every_pass(spark):
    v = Views(spark, SF)
    pos, sets = [tuple(r) for r in v.card_sales.collect()], [tuple(r) for r in v.card_settlements.collect()]
    want = slow_settlements(pos, sets, {tuple(r) for r in v.card_links.collect()})
    got = told(catalog.queries()["D15_card_settlements"](spark, SF))
    assert got == want and set(Counter(w[2] for w in want)) == {"manual", "receipt", "several", "exact", "tolerant"}
    assert told(catalog.queries()["D15_pos_settlement"](spark, SF)) == slow_settlements([(*tuple(r), None) for r in v.pos.collect()], [(r.settlement_id, r.branch_id, r.sale_date, r.gross, r.receipt) for r in v.settlement.collect()])


def slow_mirrors(rows):
    """rows: (id, direction, amount, day, counterparty, tax id, named entity, owner)."""
    outs = sorted((r for r in rows if r[1] == "OUT" and r[6] is not None), key=lambda r: (r[3], r[0]))
    ins = [r for r in rows if r[1] == "IN" and (r[6] is not None or not ((r[4] or "").strip() or (r[5] or "").strip()))]
    used, later, found = set(), [], []
    for o in outs:
        fits = [i for i in ins if i[7] == o[6] and abs(i[2]) == abs(o[2]) and abs((i[3] - o[3]).days) <= 2]
        back = [i for i in fits if i[0] not in used and i[6] is not None and i[6] == o[7]]
        if len(fits) == 1 and fits[0][0] not in used:
            found.append((o[0], fits[0][0], "clean", o[7] == fits[0][7]))
        elif len(fits) > 1 and len(back) == 1:
            found.append((o[0], back[0][0], "circle", o[7] == back[0][7]))
        else:
            later.append((o, fits))
            continue
        used.add(found[-1][1])
    for o, fits in later:
        fresh = [i for i in fits if i[0] not in used]
        if fresh:
            best = min(fresh, key=lambda i: (not (i[6] is not None and i[6] == o[7]), i[3], i[0]))
            used.add(best[0])
            found.append((o[0], best[0], "block", o[7] == best[7]))
    return sorted(found)


MOVES = "bank_id long, direction string, amount long, post_date date, counterparty string, counterparty_tax_id string, names int, owner int"


@pytest.mark.parametrize("way", WAYS)
def test_mirrors_like_one_movement_after_the_other(spark, way):
    rng, d = random.Random(3), date(2024, 1, 1)
    rows = []
    for i in range(260):
        named = rng.choice([None, 1, 2, 3])
        rows.append((i, rng.choice(["IN", "OUT"]), rng.choice([5, -5, 7, 70]), d + timedelta(rng.randint(0, 25)), rng.choice([None, "", " ", "Someone"]), rng.choice([None, None, "", "1-9"]), named, rng.choice([1, 2, 3, None])))
    # a block of four equal transfers each way
    rows += [(1000 + i, "OUT" if i < 4 else "IN", -900 if i < 4 else 900, d, None, None, 2 if i < 4 else None, 1 if i < 4 else 2) for i in range(8)]
    got = sorted((r.out_id, r.in_id, r.found_by, bool(r.intra)) for r in match_mirrors(spark.createDataFrame(rows, MOVES), "names", "owner", **way).collect())
    want = slow_mirrors(rows)
    assert got == want and {w[2] for w in want} == {"clean", "circle", "block"}
    assert sum(w[0] >= 1000 for w in want) == 4


def test_an_outsider_known_by_tax_id_is_no_mirror(spark):
    d = date(2024, 1, 1)
    rows = [(1, "OUT", -50, d, None, None, 2, 1), (2, "IN", 50, d, None, "1-9", None, 2)]
    assert match_mirrors(spark.createDataFrame(rows, MOVES), "names", "owner").count() == 0


def test_mirror_query_against_one_pass(spark):
    from reconlake.plans.queries_match import own_transfers

    rows = [(r.bank_id, r.direction, r.amount, r.post_date, r.counterparty, None, r.names, r.owner) for r in own_transfers(Views(spark, SF)).collect()]
    got = catalog.queries()["D14_mirror_transfers"](spark, SF).collect()
    assert sorted((r.out_id, r.in_id, r.found_by, bool(r.intra)) for r in got) == slow_mirrors(rows)


def test_components_of_shared_candidates(spark):
    rng = random.Random(5)
    edges = {(rng.randint(0, 80), rng.randint(0, 60)) for _ in range(75)} | {(100 + i, 100 + i + j) for i in range(40) for j in (0, 1)}
    root = {r: r for r, _ in edges}
    changed = True
    while changed:
        changed, least = False, defaultdict(lambda: 10**9)
        for r, c in edges:
            least[c] = min(least[c], root[r])
        for r, c in edges:
            if least[c] < root[r]:
                root[r], changed = least[c], True
    got = {r.row: r.component for r in components(spark.createDataFrame(sorted(edges), "row int, cand int"), "row", "cand").collect()}
    assert got == root


def test_replay_without_edges(spark):
    none = spark.createDataFrame([], "r int, c int, o int")
    assert replay(none, "r", "c", ["o"], lambda edges: []).where(F.col("found_by").isNotNull()).count() == 0


def test_cells_agree_on_what_they_share(spark, monkeypatch):
    """Cells of one day and of amounts of 15 %: most settlements are seen by several."""
    monkeypatch.setattr("reconlake.operators.settle.CELL_DAYS", 1)
    for seed in (1, 2):
        rng, d = random.Random(seed), date(2024, 5, 1)
        pos = [(i, rng.choice([1, 2, None]), d + timedelta(rng.randint(0, 14)), rng.choice([-1, 1, 1, 1, 1]) * rng.randint(80, 300), None, None) for i in range(200)]
        sets = [(i, rng.choice([None, 1, 2]), d + timedelta(rng.randint(0, 14)), rng.choice([-1, 1, 1, 1, 1]) * rng.randint(80, 300), None) for i in range(200)]
        pos += [(900, 1, d, 0, None, None)]
        sets += [(900, None, d, 0, None)]
        got = told(match_settlements(spark.createDataFrame(pos, POS), spark.createDataFrame(sets, SETS)))
        assert got == slow_settlements(pos, sets) and {g[2] for g in got} == {"exact", "tolerant"}


def test_sales_of_one_receipt_are_not_paired(spark):
    """As pairs these would be four hundred million rows."""
    pos = spark.range(20_000).selectExpr("id AS pos_id", "1 AS branch_id", "DATE '2024-05-01' AS sale_date", "10000 + id % 3 AS amount", "'101' AS receipt")
    sets = spark.range(20_000).selectExpr("id AS settlement_id", "1 AS branch_id", "DATE '2024-05-02' AS sale_date", "10000 + id % 3 AS gross", "'0101' AS receipt")
    won = match_settlements(pos, sets)
    assert won.where("matched_by = 'receipt' AND pos_id = settlement_id AND difference = 0").count() == 20_000
