"""Work that must grow with the rows, not with their pairs: results by brute force, and what the plans keep."""

import random
import re
from collections import Counter
from datetime import date, timedelta
from itertools import combinations_with_replacement, product

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from reconlake.functions.names import receipt_list
from reconlake.operators import candidates
from reconlake.operators.candidates import _Triples, mutual_unique, near_counts, pair_splits, smallest_near, triple_splits, triples_of
from reconlake.operators.nearest import nearest_free
from reconlake.operators.replay import ASK, OFFER
from reconlake.operators.settle import _Mirrors, match_mirrors, mirror_orphans
from reconlake.plans import catalog, queries_rules
from reconlake.plans.views import Views

DAY = date(2024, 5, 1)


def test_triples_are_found_among_the_least_rows(spark):
    rng = random.Random(5)
    targets = [(i % 60, rng.randint(1, 2), rng.choice([-1, 1]) * rng.randint(1, 40), DAY + timedelta(rng.randint(0, 12))) for i in range(66)]
    parts = [(f"p{i % 150:03}", rng.choice([1, 1, 2]), rng.choice([-1, 1, 1, None]) and rng.choice([-1, 1]) * rng.randint(0, 30), rng.choice([None, *[DAY + timedelta(d) for d in range(13)]])) for i in range(170)]
    t = spark.createDataFrame(targets, "t int, k int, amount long, day date")
    p = spark.createDataFrame(parts, "p string, k int, part long, part_day date")
    for most in (4, 9, 20):
        pools = {}
        for i, k, amount, day in targets:
            pools.setdefault(i, []).append((amount, [x for x in parts if x[1] == k and None not in x[2:] and abs((x[3] - day).days) <= 3 and abs(x[2]) < abs(amount)]))
        want = Counter()
        for i, rows in pools.items():
            whole = [x for _, pool in rows for x in pool]
            if len(whole) <= most:
                for amount, pool in rows:
                    for a, b, c in product(pool, whole, whole):
                        if a[0] < b[0] < c[0] and a[2] + b[2] + c[2] == amount and c[2] * amount > 0:
                            want[i, a[0], b[0], c[0]] += 1
        got = triple_splits(t, p, ["k"], "t", "amount", "day", "p", "part", "part_day", 3, most)
        assert Counter(map(tuple, got.select("t", "part_1", "part_2", "part_3").collect())) == want
    assert want


def test_triples_by_brute_force_however_many_rows_are_near(spark):
    """Over 20 smaller rows in a window, repeated ids on both sides, both signs, nulls."""
    rng = random.Random(15)
    targets = [(rng.choice([None, *range(40)]), rng.choice([1, 2, None]), rng.choice([None, *range(-40, 41)]), rng.choice([None, *[DAY + timedelta(d) for d in range(12)]])) for _ in range(50)]
    parts = [(rng.choice([None, *[f"p{i:03}" for i in range(150)]]), rng.choice([1, 1, 2, None]), rng.choice([None, *range(-30, 31)]), rng.choice([None, *[DAY + timedelta(d) for d in range(13)]])) for _ in range(230)]
    pools = {}
    for t in (t for t in targets if None not in t):
        pools.setdefault(t[0], []).append((t[2], [p for p in parts if None not in p and p[1] == t[1] and abs((p[3] - t[3]).days) <= 3 and abs(p[2]) < abs(t[2])]))
    want, sizes = Counter(), Counter()
    for i, rows in pools.items():
        whole = [p for _, pool in rows for p in pool]
        sizes[len(rows) > 1, len(whole) > 20] += 1
        by_id = {}
        for p in whole:
            by_id.setdefault(p[2], []).append(p)
        for amount, pool in rows:
            for a, b in product(pool, whole):
                for c in by_id.get(amount - a[2] - b[2], ()) if a[0] < b[0] else ():
                    if b[0] < c[0] and c[2] * amount > 0:
                        want[i, amount, *(x for p in (a, b, c) for x in (p[0], p[2], p[3]))] += 1
    assert {(False, False), (False, True), (True, True)} <= sizes.keys()
    rows = spark.createDataFrame(targets, "t int, k int, amount long, day date"), spark.createDataFrame(parts, "p string, k int, part long, other date")
    got = triple_splits(*rows, ["k"], "t", "amount", "day", "p", "part", "other", 3)
    assert Counter(map(tuple, got.collect())) == want and len(want) > 1000


def test_triples_in_small_blocks_and_of_rows_that_stand_for_several(monkeypatch):
    rng = random.Random(3)
    values = np.array(sorted(rng.sample(range(-30, 200), 40)))
    schema = pa.schema([("t", pa.int64()), ("total", pa.int64()), *[f for i in (1, 2, 3) for f in ((f"part_{i}", pa.string()), (f"amount_{i}", pa.int64()), (f"day_{i}", pa.date32()))]])
    rows = [(f"p{i // 2 if i < 4 else i:02}", rng.randint(1, 9), rng.choice([1, 1, 2, 3])) for i in range(14)]
    for at_once in (1 << 18, 7):
        monkeypatch.setattr(candidates, "AT_ONCE", at_once)
        for total in (0, 90, 91, 300, -20, 599):
            want = sorted(t for t in combinations_with_replacement(range(40), 3) if sum(values[i] for i in t) == total)
            for half in (1, 2):
                assert sorted(tuple(map(int, t)) for x in triples_of(values / half if half > 1 else values, total / half) for t in zip(*x)) == want
        shelf = _Triples(3, schema)
        for part, amount, times in rows:
            list(shelf.meet(OFFER, 5, (part, amount, times, None)))
        batches = [x for total in range(3, 27) for x in shelf.meet(ASK, 5, (None, total, None, total))] + list(shelf.end())
        got = Counter((r["total"], r["part_1"], r["part_2"], r["part_3"]) for x in batches for r in x.to_pylist())
        want = Counter()
        for three in combinations_with_replacement(range(14), 3):
            a, b, c = (rows[i] for i in sorted(three, key=lambda i: (rows[i], i)))
            fits = all(rows[i][2] >= n for i, n in Counter(three).items()) and all(three.count(i) == sum(rows[j][0] == rows[i][0] for j in three) for i in three)
            if fits and max(a[1], b[1], c[1]) < (total := a[1] + b[1] + c[1]):
                want[total, a[0], b[0], c[0]] += 1
        assert got == want and len(want) > 100


def test_a_day_keeps_no_more_rows_than_a_rule_can_use(spark):
    p = spark.range(5000).selectExpr("id", "1 AS k", "id % 7 AS part", "date_add(DATE '2024-05-01', CAST(id % 4 AS int)) AS day")
    near = smallest_near(p, ["k"], "part", "day", 3, 21).collect()
    assert len(near) == 10 and all(len(r._near) == 21 and {x.part for x in r._near} == {0} for r in near)


def test_mutual_and_listed_pairs_come_from_counts(spark):
    rng = random.Random(6)
    left = [(i % 70, rng.choice([1, 2, None]), rng.choice([None, *[DAY + timedelta(d) for d in range(60)]])) for i in range(80)]
    right = [(i % 75, rng.choice([1, 2, None]), rng.choice([None, *[DAY + timedelta(d) for d in range(60)]])) for i in range(80)]
    a, b = spark.createDataFrame(left, "a int, k int, day date"), spark.createDataFrame(right, "b int, k int, other date")
    pairs = [(x[0], y[0]) for x in left for y in right if None not in x + y and x[1] == y[1] and abs((x[2] - y[2]).days) <= 2]
    times, back = Counter(x for x, _ in pairs), Counter(y for _, y in pairs)
    got = mutual_unique(a, b, ["k"], "day", "other", 2, "a", "b").collect()
    assert sorted(map(tuple, got)) == sorted(p for p in pairs if times[p[0]] == back[p[1]] == 1) and got
    assert {(r.a, r.n) for r in near_counts(a, b, ["k"], "day", "other", 2, "a").collect()} == set(times.items())


def test_rows_of_one_day_are_counted_not_paired(spark):
    """As pairs these would be four thousand million rows."""
    a = spark.range(60_000).selectExpr("id AS a", "1 AS k", "DATE '2024-05-01' AS day")
    b = spark.range(70_000).selectExpr("id AS b", "1 AS k", "DATE '2024-05-02' AS other")
    assert near_counts(a, b, ["k"], "day", "other", 2, "a").agg({"n": "min"}).first()[0] == 70_000
    assert mutual_unique(a, b, ["k"], "day", "other", 2, "a", "b").count() == 0


def shuffled_rows(frame):
    """Rows that the exchanges of the executed plan wrote, the largest."""
    frame.collect()
    plan, most = frame._jdf.queryExecution().executedPlan(), 0
    todo = [plan.finalPhysicalPlan() if "AdaptiveSparkPlan" in plan.nodeName() else plan]
    while todo:
        node = todo.pop()
        if node.nodeName() == "Exchange":
            most = max(most, node.metrics().apply("shuffleRecordsWritten").value())
        todo += [node.plan()] if "QueryStage" in node.nodeName() else [node.children().apply(i) for i in range(node.children().size())]
    return most


class Crowded(Views):
    """Movements of one account, amount and day."""

    def __getattr__(self, name):
        if name == "treasury":
            return self.spark.range(400).selectExpr("id AS treasury_id", "'IN' AS direction", "1 AS account_id", "5 AS amount_key", "DATE '2024-05-01' AS doc_date", "'c' AS client", "'t' AS tax_id", "false AS is_exception")
        return self.spark.range(500).selectExpr("concat('b', id) AS bank_id", "'IN' AS direction", "1 AS account_id", "5 AS amount_key", "DATE '2024-05-01' AS post_date", "concat('m', id % 3) AS memo", "'c' AS counterparty", "'t' AS counterparty_tax_id")


def test_listing_shuffles_rows_not_pairs(spark):
    listed = queries_rules.candidate_listing(Crowded(spark, ""))
    assert shuffled_rows(listed) <= 1500 and {(r.bank_id, r.delta) for r in listed.collect()} == {("b0", 0), ("b1", 0), ("b101", 0)}
    assert listed.count() == 1200


def test_types_shuffle_rows_not_pairs(spark):
    types = queries_rules.match_types(Crowded(spark, ""))
    assert shuffled_rows(types) <= 1500 and types.count() == 200_000


def test_mirrors_of_one_day_and_size_are_not_listed(spark):
    """As candidates these would be nine hundred million rows."""
    moves = spark.range(60_000).selectExpr("id AS bank_id", "IF(id % 2 = 0, 'OUT', 'IN') AS direction", "7 AS amount", "DATE '2024-05-01' AS post_date", "CAST(NULL AS string) AS counterparty", "IF(id % 2 = 0, 2, NULL) AS names", "IF(id % 2 = 0, 1, 2) AS owner")
    pairs = match_mirrors(moves, "names", "owner")
    assert pairs.where("found_by = 'block' AND in_id = out_id + 1").count() == pairs.count() == 30_000
    assert [r.reason for r in mirror_orphans(moves, "names", "owner", pairs.where("out_id <> 6")).collect()] == ["ambiguous"]


def test_mirrors_forget_past_days():
    shelf, told = _Mirrors(), []
    for day in range(300):
        told += shelf.meet(OFFER, day + 2, (f"i{day:03}", None, None, None)) + shelf.meet(OFFER, day + 2, (f"j{day:03}", 1, None, None))
        told += shelf.meet(ASK, day, (None, 1, f"o{day:03}", False))
        assert len(shelf.free) <= 14 and len(shelf.left) <= 6
    assert len(told + shelf.end()) == 300


def test_nearest_rows_like_one_row_after_the_other(spark):
    rng = random.Random(8)
    left = [(i, rng.choice([1, 2, None]), rng.choice([None, -5, 0, *range(180, 230), *[400] * 9]), rng.choice([None, *[DAY + timedelta(d) for d in range(20)] * 2])) for i in range(160)]
    right = [(f"b{i:03}", rng.choice([1, 2]), rng.choice([None, -5, 0, *range(180, 230), *[400] * 9]), rng.choice([None, *[DAY + timedelta(d) for d in range(20)] * 2])) for i in range(140)]
    free, want = [b for b in right if None not in b], []
    for t in sorted((t for t in left if None not in t), key=lambda t: (t[3], t[0])):
        fits = [(b[2] != t[2], abs((b[3] - t[3]).days), abs(b[2] - t[2]), b[0], b) for b in free if b[1] == t[1] and min(t[2], b[2]) > 0 and abs((b[3] - t[3]).days) <= 5 and abs(b[2] - t[2]) * 100 <= t[2]]
        if fits:
            _, days, off, _, b = min(fits)
            free.remove(b)
            want.append((t[0], b[0], days, off))
    rows = spark.createDataFrame(left, "t int, k int, amount long, day date"), spark.createDataFrame(right, "b string, k int, part long, other date")
    assert sorted(map(tuple, nearest_free(*rows, ["k"], "t", "amount", "day", "b", "part", "other", 5, 100).collect())) == sorted(want)
    assert {w[3] for w in want} >= {0, 1, 2}


def test_nearest_rows_of_one_amount_are_not_listed(spark):
    """As candidates these would be nine hundred million rows."""
    rows = spark.range(30_000).selectExpr("id AS t", "id AS b", "1 AS k", "500 AS amount", "500 + id % 2 AS part", "DATE '2024-05-01' AS day")
    got = nearest_free(rows, rows, ["k"], "t", "amount", "day", "b", "part", "day", 5, 100)
    assert got.count() == 30_000 and got.where("off = 0 AND b = 2 * t").count() == 15_000


def test_pairs_by_brute_force_without_listing_first_parts(spark):
    rng = random.Random(9)
    targets = [(rng.choice([None, *range(50)]), rng.choice([1, 2, None]), rng.choice([None, *range(-30, 31)]), rng.choice([None, *[DAY + timedelta(d) for d in range(40)]])) for i in range(130)]
    parts = [(rng.choice([None, *[f"p{i:03}" for i in range(140)]]), rng.choice([1, 2, None]), rng.choice([None, *range(-25, 26)]), rng.choice([None, *[DAY + timedelta(d) for d in range(40)]])) for _ in range(300)]
    want = Counter()
    for t in targets:
        pool = [p for p in parts if None not in p + t[1:] and p[1] == t[1] and abs((p[3] - t[3]).days) <= 3 and abs(p[2]) < abs(t[2])]
        want.update((t[0], a[0], a[2], a[3], b[0], b[2], b[3]) for a, b in product(pool, pool) if a[0] < b[0] and a[2] + b[2] == t[2])
    rows = spark.createDataFrame(targets, "t int, k int, amount long, day date"), spark.createDataFrame(parts, "p string, k int, part long, other date")
    got = pair_splits(*rows, ["k"], "t", "amount", "day", "p", "part", "other", 3)
    assert Counter(map(tuple, got.drop("amount").collect())) == want and want
    # a target of each of 2,000 amounts and 2,000 parts: two million pairs of a target and its first part, no two of which add up
    many = spark.range(2000).selectExpr("id AS t", "id AS p", "1 AS k", "20000 + 4 * id AS amount", "10001 + 4 * id AS part", "DATE '2024-05-01' AS day")
    none = pair_splits(many, many, ["k"], "t", "amount", "day", "p", "part", "day", 3)
    assert none.count() == 0 and shuffled_rows(none) <= 6000


def test_pairs_of_transfers_meet_last(spark):
    """After the join that makes pairs none of them is joined, and so shuffled, again."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = catalog.queries()["L05_transfers_between_owners"](spark, "/root/testdata/sf0.001")
        plan = rows._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "amount_key" in next(line for line in plan.splitlines() if "Join" in line)


def test_imported_files_have_a_bounded_size(spark, monkeypatch, tmp_path):
    """A file is one value while it is read: more rows make more files."""
    monkeypatch.setattr(queries_rules, "FILE_ROWS", 100)
    monkeypatch.setattr(queries_rules, "shared_folder", lambda *_: str(tmp_path / "imports"))
    bank = Views(spark, "/root/testdata/sf0.001").bank
    rows = catalog.queries()["M03_import_by_content"](spark, "/root/testdata/sf0.001").collect()
    sizes = [len(f.read_text().splitlines()) for f in (tmp_path / "imports/in").rglob("*.csv")]
    assert max(sizes) <= 100 and sum(sizes) > 5000
    want = {(r.bank_id, 0 if r.post_date < date(1997, 1, 1) else 2, r.counterparty, r.amount % 97 == 0) for r in bank.collect()}
    assert {(r.bank_id, r.first_import, r.counterparty, r.discarded) for r in rows} == want and len(rows) == len(want)


def test_each_name_is_looked_for_once(spark):
    """The words that meet are those of different names, not of all parts."""
    found = catalog.queries()["D19_fuzzy_names"](spark, "/root/testdata/sf0.01")
    plan = found._jdf.queryExecution().optimizedPlan().toString().splitlines()
    assert found.count() == found.select("part_id").distinct().count() > 1000
    # the first words in the plan are those of rows that are distinct already
    words = next(i for i, line in enumerate(plan) if "Generate explode" in line)
    assert any(re.search(r"Aggregate \[\w+#\d+\]", line) for line in plan[words + 1 : words + 3]), plan


def test_receipts_are_looked_for_once(spark):
    memos = [None, "", "4047/4048", "515-516", "N OPE 0515 -\t00517", "12/13", "1000/1000", "1000/990", "x 1234/12345", "123/000", "4000-4010 777/778", "1/2345-2346"]
    pattern = re.compile(r"(?<!\d)(\d{3,4})\s*[/-]\s*0*(\d{3,4})(?!\d)")

    def listed(memo):
        a, b = map(int, found.groups()) if (found := pattern.search(memo or "")) else (0, 0)
        return None if a == b else list(range(a, b + 1)) if 0 < b - a <= 4 else [a, b]

    df = spark.createDataFrame([(m,) for m in memos], "memo string").select("memo", receipt_list(F.col("memo")).alias("found"))
    assert {r.memo: r.found for r in df.collect()} == {m: listed(m) for m in memos}
    plan = catalog.queries()["K22_receipts"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract") == 1


def test_other_accounts_meet_by_name_or_tax_id(spark):
    """Rows of an amount and week that share neither never meet."""
    plan = catalog.queries()["D12_other_accounts"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join Inner" in line]
    assert len(joins) == 2 and all(" client#" in line or "(client#" in line or "(tax_id#" in line for line in joins)
