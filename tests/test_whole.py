"""Queries over whole tables against plain Python."""

import json
import re

from reconlake.plans import catalog
from reconlake.plans.views import Views
from reconlake.sources.feeds import PagedFeed

SF = "/root/testdata/sf0.001"
PLAIN = str.maketrans("ÁÀÂÄÃÉÈÊËÍÌÎÏÓÒÔÖÕÚÙÛÜÑÇ", "AAAAAEEEEIIIIOOOOOUUUUNC")


def test_whole_texts(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    got = catalog.queries()["K11_whole_texts"](spark, SF).collect()
    assert sorted(map(tuple, got)) == sorted((r.doc_id, r.text.upper().translate(PLAIN)) for r in rows)


def test_nearest_like_one_row_after_the_other(spark):
    v = Views(spark, SF)
    bank = {}
    for r in v.bank.select("account_id", "direction", "bank_id", "amount_key", "post_date").collect():
        bank.setdefault((r.account_id, r.direction), []).append(r)
    used, want = set(), []
    for t in sorted(v.treasury.collect(), key=lambda r: (r.doc_date, r.treasury_id)):
        fits = []
        for b in bank.get((t.account_id, t.direction), []):
            days, off = abs((b.post_date - t.doc_date).days), abs(b.amount_key - t.amount_key)
            if b.bank_id not in used and days <= 5 and off * 100 <= t.amount_key:
                fits.append((off > 0, days, off, b.bank_id))
        if fits:
            inexact, days, _, bank_id = min(fits)
            used.add(bank_id)
            want.append((t.treasury_id, bank_id, max(40, 100 - 5 * days - 10 * inexact)))
    assert sorted(map(tuple, catalog.queries()["D18_nearest_within_tolerance"](spark, SF).collect())) == sorted(want)


def test_memo_parts_and_receipts_of_every_row(spark):
    rows = Views(spark, SF).bank.select("bank_id", "memo", "part_id", "line_no").collect()
    found = {r.bank_id: re.match(r"DEP \((\d{1,3})\) ", r.memo) for r in rows}
    want = {i: (m is not None, int(m[1]) if m else None) for i, m in found.items()}
    got = {r.bank_id: (r.is_multipart, r.part_number) for r in catalog.queries()["K17_memo_parts_all"](spark, SF).collect()}
    assert got == want and any(r.memo.startswith("ABN CRD") for r in rows)
    listed = {r.bank_id: (1000 + r.part_id % 8000, 1 + r.line_no % 5) if r.line_no % 5 else (None, None) for r in rows}
    assert {r.bank_id: (r.first_receipt, r.n) for r in catalog.queries()["K22_receipts_all"](spark, SF).collect()} == listed


def test_a_feed_of_many_pages_ends_with_its_cursor(spark, tmp_path):
    for i in range(205):
        told = {"has_more": i < 204, "next_after_id": i + 1}
        (tmp_path / f"{i}.json").write_text(json.dumps({"data": [{"id": i}], "pagination": told}))
    spark.dataSource.register(PagedFeed)
    rows = spark.read.format("paged_feed").schema("id long").option("template", f"{tmp_path}/{{cursor}}.json").option("first", "0").load()
    assert sorted(r.id for r in rows.collect()) == list(range(205))
