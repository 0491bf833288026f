"""Matching of point-of-sale rows with settlements and of transfers between own accounts, in passes."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import OrderedDict, deque
from functools import partial, reduce
from operator import or_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reconlake.functions.names import receipt_list
from reconlake.operators.assign import share_checkpoints
from reconlake.operators.candidates import near_counts
from reconlake.operators.replay import OFFER, components, sweep

#: Tolerances in hundredths of a percent, and windows in days.
BY_RECEIPT_BP, SEVERAL_BP, RECEIPT_DAYS, EXACT_DAYS, MIRROR_DAYS = 500, 250, 3, 1, 2

#: Days of a cell in the last settlement pass.
CELL_DAYS = 10


class _Shelf:
    """Free settlements of the days around the present one by day and branch, each list in order of amount and id."""

    def __init__(self, days: int) -> None:
        self.days = days
        self.free: dict[int, dict] = {}

    def put(self, day: int, key, gross, settlement_id) -> None:
        insort(self.free.setdefault(day, {}).setdefault(key, []), (gross, settlement_id))

    def near(self, day: int, *keys) -> list[tuple[int, list]]:
        """(day, list) of those within the window, which has no older days from now on."""
        for d in [d for d in self.free if d < day - self.days]:
            del self.free[d]
        found = [(d, self.free[d].get(key)) for d in range(day - self.days, day + self.days + 1) if d in self.free for key in dict.fromkeys(keys)]
        return [(d, rows) for d, rows in found if rows]

    def end(self) -> list[tuple]:
        return []


class _Nearest(_Shelf):
    """Of one receipt: the nearest amount within the tolerance, then the earliest day and least id."""

    def meet(self, kind: int, day: int, row: tuple) -> list[tuple]:
        settlement_id, s_branch, gross, pos_id, branch, amount = row
        if kind == OFFER:
            self.put(day, s_branch, gross, settlement_id)
            return []
        best = None
        for d, rows in self.near(day, branch, None):
            i = bisect_left(rows, (amount,))
            for at in ([i] if i < len(rows) else []) + ([bisect_left(rows, (rows[i - 1][0],))] if i else []):
                place = (abs(rows[at][0] - amount), d, rows[at][1])
                if best is None or place < best[0]:
                    best = place, rows, at
        if best is None or (amount != 0 and best[0][0] * 10_000 > abs(amount) * BY_RECEIPT_BP):
            return []
        return [(pos_id, best[1].pop(best[2])[1], "receipt")]


class _Several(_Shelf):
    """All receipts that the memo names, if each has a single free settlement and they add up."""

    def meet(self, kind: int, day: int, row: tuple) -> list[tuple]:
        settlement_id, s_branch, gross, receipt, pos_id, branch, amount, receipts = row
        if kind == OFFER:
            self.put(day, (receipt, s_branch), gross, settlement_id)
            return []
        picked = []
        for asked in receipts:
            free = [rows for _, rows in self.near(day, (asked, branch), (asked, None))]
            if len(free) != 1 or len(free[0]) != 1:
                return []
            picked.append(free[0])
        if len(picked) < 2 or abs(sum(rows[0][0] for rows in picked) - amount) * 10_000 > amount * SEVERAL_BP:
            return []
        return [(pos_id, rows.pop()[1], "several") for rows in picked]


class _ExactOrOnly(_Shelf):
    """The same amount, the earliest; else the only one within the tolerance. A row with `gone` is what a sale of another cell took in its turn."""

    def __init__(self, days: int) -> None:
        super().__init__(days)
        self.shared: dict = {}

    def meet(self, kind: int, day: int, row: tuple) -> list[tuple]:
        settlement_id, s_branch, gross, shared, pos_id, branch, amount, gone, cell = row
        if kind == OFFER:
            self.put(day, s_branch, gross, settlement_id)
            if shared:
                self.shared[settlement_id] = (day, s_branch, gross)
            return []
        if gone is not None:
            d, key, size = self.shared.get(gone, (None, None, None))
            rows = self.free.get(d, {}).get(key, [])
            i = bisect_left(rows, (size, gone)) if rows else 0
            if i < len(rows) and rows[i] == (size, gone):
                del rows[i]
            return []
        near, off, exact, within, only = self.near(day, branch, None), abs(amount) * BY_RECEIPT_BP // 10_000, None, 0, None
        for d, rows in near:
            i = bisect_left(rows, (amount,))
            if i < len(rows) and rows[i][0] == amount and (exact is None or (d, rows[i][1]) < exact[0]):
                exact = (d, rows[i][1]), rows, i
            first = bisect_left(rows, (amount - off,))
            here = bisect_left(rows, (amount + off + 1,)) - first
            within += here
            only = (rows, first) if here else only
        if exact:
            won, how = exact[1].pop(exact[2])[1], "exact"
        elif within == 1:
            won, how = only[0].pop(only[1])[1], "tolerant"
        else:
            return []
        return [(pos_id, won, how, cell, won in self.shared)]


def _in_cells(sales: DataFrame, settlements: DataFrame, schema: str) -> DataFrame:
    """(pos_id, settlement_id, matched_by) of `_ExactOrOnly` over all sales in order of day and id, told by cells at once.

    A sale lies in one cell of amounts and days, a settlement comes to every cell with a sale that could see it. Each cell goes through its
    sales in order and hears of what sales of other cells took in the round before, at the turns of those. Once what cells have in common is
    taken as in the round before, every sale has decided on what the sales before it left, which is what one pass over all would give. Each
    round makes at least the first wrong sale right, so it ends.
    """
    band = lambda x: F.when(x == 0, 0).otherwise(F.floor(F.log(F.abs(x).cast("double")) * (10_000 / BY_RECEIPT_BP) / 3)).cast("long")
    block = lambda day: F.floor(F.unix_date(day) / CELL_DAYS).cast("long")
    cell = lambda amount, b, days: F.concat_ws(":", F.signum(amount.cast("double")).cast("int"), b, days)
    size, part = F.abs("gross").cast("double"), BY_RECEIPT_BP / 10_000
    p = sales.where("amount IS NOT NULL").select(cell(F.col("amount"), band(F.col("amount")), block(F.col("p_day"))).alias("key"), F.col("p_day").alias("day"), "pos_id", "branch_id", "amount", F.lit(None).cast(settlements.schema["settlement_id"].dataType).alias("gone")).withColumn("cell", F.col("key"))
    bands = F.sequence(band(size / (1 + part) * (1 - 1e-9)), band(size / (1 - part) * (1 + 1e-9)))
    blocks = F.sequence(block(F.date_sub("s_day", EXACT_DAYS)), block(F.date_add("s_day", EXACT_DAYS)))
    cells = F.flatten(F.transform(F.col("bands"), lambda b: F.transform(F.col("blocks"), lambda d: cell(F.col("gross"), b, d))))
    s = settlements.where("gross IS NOT NULL AND s_day IS NOT NULL").withColumn("bands", bands).withColumn("blocks", blocks).withColumn("cells", cells)
    s = s.select(F.explode("cells").alias("key"), F.col("s_day").alias("day"), "settlement_id", "s_branch", "gross", (F.size("cells") > 1).alias("shared"))
    # most settlements that two cells could see have sales in one of them alone
    p, s = p.checkpoint(), s.join(p.select("key").distinct(), "key", "left_semi").checkpoint()
    told, before = None, 0
    while True:
        asks = p
        if told is not None:
            took = told.where("shared").join(p.select("pos_id", "day"), "pos_id").select("pos_id", "day", F.col("settlement_id").alias("gone"), "cell")
            heard = took.join(s.where("shared").select("key", F.col("settlement_id").alias("gone")), "gone").where("key <> cell")
            asks = p.unionByName(heard, allowMissingColumns=True)
        now = sweep(s, asks, ["key"], "day", EXACT_DAYS, "settlement_id", "pos_id", partial(_ExactOrOnly, EXACT_DAYS), f"{schema}, cell string, shared boolean").checkpoint()
        common = now.where("shared")
        n = common.count()
        same = n == before and (told is None or not common.join(told.where("shared"), ["pos_id", "settlement_id"], "left_anti").limit(1).count())
        if same:
            return now.drop("cell", "shared")
        told, before = now, n


def match_settlements(pos: DataFrame, settlements: DataFrame, links: DataFrame | None = None, **limits: int) -> DataFrame:
    """Rows (pos_id, settlement_id, matched_by, difference) of four passes, each over what the ones before left.

    In each pass the sales come by day and id, and see the settlements that are still free. Rows with a receipt in common come in order to one
    `sweep`, those of the last pass to cells (`_in_cells`), so no candidates are listed; the `limits` of a `replay` change nothing here.
    Manual: the (pos_id, settlement_id) of `links`, whatever the amounts; a settlement goes to the least pos_id there is.
    By receipt: of those with the same receipt and branch, at most three days apart and 5 % off, the nearest amount.
    Several: the memo of a sale (a column `memo`, if there is one) names two receipts or more, each has one settlement
    left, of the branch and within three days, and they add up to the amount but for 2.5 %. Last, same branch and at
    most a day apart: a settlement of the same amount, else the only one that is at most 5 % off. Rows without a
    receipt have none in common. A settlement without a branch fits any. `difference` is what all settlements of the sale exceed
    its amount by. Amounts are whole.
    """
    bare = lambda c: F.when(c != "", F.coalesce(F.nullif(F.regexp_replace(c, "^0+", ""), F.lit("")), F.lit("0")))
    s = settlements.select("settlement_id", F.col("branch_id").alias("s_branch"), F.col("sale_date").alias("s_day"), "gross", bare(F.col("receipt")).alias("receipt")).where("settlement_id IS NOT NULL")
    memo = F.col("memo") if "memo" in pos.columns else F.lit(None).cast("string")
    p = pos.select("pos_id", "branch_id", F.col("sale_date").alias("p_day"), "amount", bare(F.col("receipt")).alias("receipt"), memo.alias("memo"))
    kinds = ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for df, c in ((p, "pos_id"), (s, "settlement_id"))) + ", matched_by string"
    share_checkpoints(pos)
    found = []

    def settle(won: DataFrame) -> None:
        """`won`: pos_id, settlement_id, matched_by."""
        nonlocal p, s
        whole = won.join(p.select("pos_id", "amount"), "pos_id").join(s.select("settlement_id", "gross"), "settlement_id")
        sums = whole.groupBy("pos_id").agg((F.sum("gross") - F.max("amount")).alias("difference"))
        won = won.join(sums, "pos_id").select("pos_id", "settlement_id", "matched_by", "difference").checkpoint()
        found.append(won)
        p, s = p.join(won, "pos_id", "left_anti").checkpoint(), s.join(won, "settlement_id", "left_anti").checkpoint()

    if links is not None:
        known = links.join(p.select("pos_id"), "pos_id").join(s.select("settlement_id"), "settlement_id")
        settle(known.groupBy("settlement_id").agg(F.min("pos_id").alias("pos_id")).select("pos_id", "settlement_id", F.lit("manual").alias("matched_by")))

    offers = s.where("gross IS NOT NULL").select("receipt", F.col("s_day").alias("day"), "settlement_id", "s_branch", "gross")
    askers = p.where("amount IS NOT NULL").select("receipt", F.col("p_day").alias("day"), "pos_id", "branch_id", "amount")
    settle(sweep(offers, askers, ["receipt"], "day", RECEIPT_DAYS, "settlement_id", "pos_id", partial(_Nearest, RECEIPT_DAYS), kinds))

    # receipts that memos name together come to one place
    several = p.where("amount > 0").withColumn("receipts", receipt_list(F.col("memo")).cast("array<string>")).where("receipts IS NOT NULL").checkpoint()
    lists = several.select(F.array_join("receipts", "/").alias("list"), F.explode("receipts").alias("receipt")).distinct().checkpoint()
    together = components(lists, "list", "receipt").toDF("list", "key").checkpoint()
    places = lists.join(together, "list").select("receipt", "key").distinct()
    offers = s.where("gross IS NOT NULL").join(places, "receipt").select("key", F.col("s_day").alias("day"), "settlement_id", "s_branch", "gross", "receipt")
    askers = several.withColumn("list", F.array_join("receipts", "/")).join(together, "list").select("key", F.col("p_day").alias("day"), "pos_id", "branch_id", "amount", "receipts")
    settle(sweep(offers, askers, ["key"], "day", RECEIPT_DAYS, "settlement_id", "pos_id", partial(_Several, RECEIPT_DAYS), kinds))

    settle(_in_cells(p, s, kinds))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def _mirror_sides(movements: DataFrame, entity_of: str, owner_of: str) -> tuple[DataFrame, DataFrame]:
    size = F.abs(F.col("amount"))
    out = movements.where("direction = 'OUT'").where(F.col(entity_of).isNotNull())
    out = out.select(F.col("bank_id").alias("out_id"), size.alias("size"), F.col("post_date").alias("out_day"), F.col(entity_of).alias("owner"), F.col(owner_of).alias("out_owner"))
    known = [F.trim(F.coalesce(F.col(c), F.lit(""))) != "" for c in ("counterparty", "counterparty_tax_id") if c in movements.columns]
    outsider = F.col(entity_of).isNull() & reduce(or_, known, F.lit(False))
    into = movements.where("direction = 'IN'").where(~outsider)
    into = into.select(F.col("bank_id").alias("in_id"), size.alias("size"), F.col("post_date").alias("in_day"), F.col(owner_of).alias("owner"), F.col(entity_of).alias("in_names"))
    return out, into


class _Mirrors:
    """The two passes over the OUTs and INs of one size and owner, in order of their days (see `sweep`).

    An OUT of the second pass waits until the first is past every OUT that could want one of its INs.
    """

    def __init__(self) -> None:
        self.left: deque = deque()
        #: by day: how many INs there were; the free ones in order, with whom they name; those of a name
        self.counts: dict[int, int] = {}
        self.free: dict[int, OrderedDict] = {}
        self.naming: dict[int, dict] = {}

    def meet(self, kind: int, day: int, row: tuple) -> list[tuple]:
        in_id, party, out_id, intra = row
        if kind == OFFER:
            if day not in self.free:
                self.counts[day], self.free[day], self.naming[day] = 0, OrderedDict(), {}
            self.counts[day] += 1
            self.free[day][in_id] = party
            if party is not None:
                self.naming[day].setdefault(party, OrderedDict())[in_id] = None
            return []
        told = self.second(day - 2 * MIRROR_DAYS)
        won = self.first(day, party)
        if won:
            return [*told, (out_id, self.take(*won[:2]), won[2], intra)]
        self.left.append((day, out_id, party, intra))
        return told

    def end(self) -> list[tuple]:
        return self.second(None)

    def take(self, day: int, in_id):
        party = self.free[day].pop(in_id)
        if party is not None:
            del self.naming[day][party][in_id]
        return in_id

    def near(self, day: int) -> list[int]:
        return [d for d in range(day - MIRROR_DAYS, day + MIRROR_DAYS + 1) if d in self.free]

    def back(self, day: int, owner) -> list[tuple]:
        """(day, free INs) of those days near that have one which points back."""
        return [] if owner is None else [(d, found) for d in self.near(day) if (found := self.naming[d].get(owner))]

    def first(self, day: int, owner) -> tuple | None:
        """The only candidate there ever was, else the only free one that points back."""
        near = self.near(day)
        if sum(self.counts[d] for d in near) == 1:
            return next(((d, next(iter(self.free[d])), "clean") for d in near if self.free[d]), None)
        back = self.back(day, owner)
        return (back[0][0], next(iter(back[0][1])), "circle") if len(back) == 1 and len(back[0][1]) == 1 else None

    def second(self, before: int | None) -> list[tuple]:
        """What the OUTs left over from before that day take: a free one that points back rather than another, the earliest."""
        told = []
        while self.left and (before is None or self.left[0][0] < before):
            day, out_id, owner, intra = self.left.popleft()
            found = self.back(day, owner) or [(d, self.free[d]) for d in self.near(day) if self.free[d]]
            if found:
                told.append((out_id, self.take(found[0][0], next(iter(found[0][1]))), "block", intra))
        oldest = self.left[0][0] if self.left else before
        for d in [d for d in self.free if oldest is not None and d < oldest - MIRROR_DAYS]:
            del self.counts[d], self.free[d], self.naming[d]
        return told


def match_mirrors(movements: DataFrame, entity_of: str, owner_of: str, **limits: int) -> DataFrame:
    """(out_id, in_id, found_by, intra) of the outgoing and incoming movements that mirror each other.

    `entity_of` names the own entity that a movement's text points to, `owner_of` the entity that holds its account.
    Candidates of an OUT are INs on accounts of the entity it points to, of the same size, within two days, whose own text
    doesn't name an outsider, be it by name or tax id (columns counterparty and counterparty_tax_id, if there). OUTs come
    by day and id. First, one with a single candidate takes it (`clean`), any other takes the only free candidate that points
    back at its owner (`circle`); then those left over take a free candidate, one that points back rather than another, the
    earliest (`block`). `intra`: both accounts have the same owner. Rows of one size and owner come in order to one `sweep`,
    so candidates are counted and not listed; the `limits` of a `replay` change nothing here.
    """
    out, into = _mirror_sides(movements, entity_of, owner_of)
    askers = out.select("size", "owner", F.col("out_day").alias("day"), "out_id", F.col("out_owner").alias("party"), F.col("owner").eqNullSafe(F.col("out_owner")).alias("intra"))
    offers = into.select("size", "owner", F.col("in_day").alias("day"), "in_id", F.col("in_names").alias("party"))
    kind = movements.schema["bank_id"].dataType.simpleString()
    return sweep(offers, askers, ["size", "owner"], "day", MIRROR_DAYS, "in_id", "out_id", _Mirrors, f"out_id {kind}, in_id {kind}, found_by string, intra boolean")


def mirror_orphans(movements: DataFrame, entity_of: str, owner_of: str, pairs: DataFrame) -> DataFrame:
    """(bank_id, direction, reason) of the movements between own accounts that `pairs` leaves over.

    An OUT has `no-dest-account` if the entity it points to holds no account, `no-candidate` if nothing fits it, else
    `ambiguous`: others took its candidates. An IN that points to an own entity has `no-out`.
    """
    out, into = _mirror_sides(movements, entity_of, owner_of)
    owners = movements.select(F.col(owner_of).alias("owner")).where("owner IS NOT NULL").distinct().withColumn("held", F.lit(True))
    left = out.join(pairs, "out_id", "left_anti")
    fits = near_counts(left, into, ["size", "owner"], "out_day", "in_day", MIRROR_DAYS, "out_id").select("out_id").distinct().withColumn("fits", F.lit(True))
    left = left.join(owners, "owner", "left").join(fits, "out_id", "left")
    reason = F.when(F.col("held").isNull(), "no-dest-account").when(F.col("fits").isNull(), "no-candidate").otherwise("ambiguous")
    unused = into.where("in_names IS NOT NULL").join(pairs, "in_id", "left_anti")
    return left.select(F.col("out_id").alias("bank_id"), F.lit("OUT").alias("direction"), reason.alias("reason")).unionByName(unused.select(F.col("in_id").alias("bank_id"), F.lit("IN").alias("direction"), F.lit("no-out").alias("reason")))
