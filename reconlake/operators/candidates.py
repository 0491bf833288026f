"""Candidate joins between movement streams: equal keys first, then date windows, so nothing meets everything."""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.window import Window

from reconlake.operators.replay import MOST_TOLD, OFFER, sweep

#: So many sums of two amounts, or triples, are in memory at once.
AT_ONCE = 1 << 18


def within_days(a: Column, b: Column, days: int) -> Column:
    return F.abs(F.datediff(a, b)) <= days


def day_block(day: Column, days: int) -> Column:
    """The number of the day's block of `2 * days + 1` days: a window of `days` to both sides touches two at most."""
    return F.floor(F.datediff(day, F.lit("1970-01-01")) / (2 * days + 1)).cast("long")


def near_blocks(rows: DataFrame, day: str, days: int) -> DataFrame:
    """Each row once for every block of days, `_block`, that its window touches."""
    return rows.withColumn("_block", F.explode(F.sequence(day_block(F.date_sub(day, days), days), day_block(F.date_add(day, days), days))))


def window_join(left: DataFrame, right: DataFrame, keys: list[str], left_day: str, right_day: str, days: int) -> DataFrame:
    """Inner join on `keys` within a window of days; `delta` is right day minus left day.

    A right row lies in one block of days, a left row goes to the one or two that its window touches, and they meet
    by equal keys and block, so that the rows of a key don't all meet however long the history is.
    """
    met = near_blocks(left, left_day, days).join(right.withColumn("_block", day_block(F.col(right_day), days)), [*keys, "_block"])
    return met.where(within_days(F.col(left_day), F.col(right_day), days)).drop("_block").withColumn("delta", F.datediff(right_day, left_day))


def tolerance_join(left: DataFrame, right: DataFrame, keys: list[str], left_day: str, right_day: str, days: int, left_amount: str, right_amount: str, part: int) -> DataFrame:
    """`window_join` of positive amounts that differ by a `part`th of the left one at most.

    A right row lies in one band of amounts as well; a left row goes to the one or two that its tolerance touches.
    """
    band = lambda x: F.floor(F.log(x.cast("double")) / F.lit(3 / part)).cast("long")
    amount = F.col(left_amount)
    near = left.where(amount > 0).withColumn("_band", F.explode(F.sequence(band(amount * (1 - 1 / part - 1e-9)), band(amount * (1 + 1 / part + 1e-9)))))
    dealt = right.where(F.col(right_amount) > 0).withColumn("_band", band(F.col(right_amount)))
    met = window_join(near, dealt, [*keys, "_band"], left_day, right_day, days)
    return met.where(F.abs(F.col(right_amount) - amount) * part <= amount).drop("_band")


def near_counts(left: DataFrame, right: DataFrame, keys: list[str], left_day: str, right_day: str, days: int, name: str) -> DataFrame:
    """The left rows with `near`, how many right rows `window_join` would give each, and `n`, how many it would give rows of their `name`.

    Rows are counted by key and day and these counts are added up along the days, so no pair is listed. Rows without any stay away.
    """
    cells = left.select(*keys, F.col(left_day).alias("_day"), F.lit(0).alias("_n")).unionByName(right.select(*keys, F.col(right_day).alias("_day"), F.lit(1).alias("_n")))
    around = Window.partitionBy(*keys).orderBy(F.datediff("_day", F.lit("1970-01-01"))).rangeBetween(-days, days)
    counts = cells.where("_day IS NOT NULL").groupBy(*keys, "_day").agg(F.sum("_n").alias("_n")).withColumn("near", F.sum("_n").over(around)).where("near > 0").drop("_n")
    return left.withColumn("_day", F.col(left_day)).join(counts, [*keys, "_day"]).drop("_day").withColumn("n", F.sum("near").over(Window.partitionBy(name)))


def mutual_unique(left: DataFrame, right: DataFrame, keys: list[str], left_day: str, right_day: str, days: int, a: str, b: str) -> DataFrame:
    """The (`a`, `b`) of `window_join` whose both ends occur once: rows with one row near them are found by counts, and these meet."""
    lone = [near_counts(*sides, a_or_b).where("n = 1 AND near = 1").drop("n", "near") for sides, a_or_b in (((left, right, keys, left_day, right_day, days), a), ((right, left, keys, right_day, left_day, days), b))]
    return window_join(*lone, keys, left_day, right_day, days).select(a, b)


class _Pairs:
    """The parts of the days around the present one by amount, and the pairs of amounts that a target is the sum of (see `sweep`)."""

    def __init__(self, days: int) -> None:
        self.days = days
        self.parts: dict[int, list] = {}
        self.at: int | None = None

    def gather(self, day: int) -> None:
        self.at, self.near = day, {}
        for d in [d for d in self.parts if d < day - self.days]:
            del self.parts[d]
        for d, rows in self.parts.items():
            for part, amount in rows:
                ids, days = self.near.setdefault(amount, ([], []))
                ids.append(part)
                days.append(d)
        self.amounts = np.array(sorted(self.near))

    def meet(self, kind: int, day: int, row: tuple) -> list[tuple]:
        part, amount, target = row
        if kind == OFFER:
            self.parts.setdefault(day, []).append((part, amount))
            return []
        if self.at != day:
            self.gather(day)
        if not len(self.amounts):
            return []
        less = self.amounts[np.abs(self.amounts) < abs(amount)]
        rest = amount - less
        at = np.minimum(np.searchsorted(less, rest), max(len(less) - 1, 0))
        # each two amounts once; which part is the first is told by their ids
        hits = less[(less[at] == rest) & (less <= rest)] if len(less) else less
        return [(target, amount, a, amount - a, *self.near[a], *self.near[amount - a]) for a in hits.tolist()]

    def end(self) -> list[tuple]:
        return []


def pair_splits(targets: DataFrame, parts: DataFrame, keys: list[str], target: str, target_amount: str, target_day: str, part: str, part_amount: str, part_day: str, days: int) -> DataFrame:
    """Two parts of the same keys that add up to a target, each smaller than it, within `days` of it.

    Rows of the same keys and block of days come in order to one `sweep`, parts to the blocks that their window touches. A target looks
    for what is missing among the amounts of its window; only the rows of two amounts that add up to it are paired, where they are told.
    """
    askers = targets.select(*keys, F.col(target_day).alias("_on"), F.col(target_amount).alias("_amount"), F.col(target).alias("_target")).where("_amount IS NOT NULL")
    offers = parts.select(*keys, F.col(part_day).alias("_on"), F.col(part).alias("_part"), F.col(part_amount).alias("_amount")).where("_part IS NOT NULL AND _amount IS NOT NULL")
    name, size, of = (df.schema[c].dataType.simpleString() for df, c in ((askers, "_target"), (askers.select("_amount").union(offers.select("_amount")), "_amount"), (offers, "_part")))
    schema = f"_target {name}, _amount {size}, a {size}, b {size}, a_ids array<{of}>, a_days array<int>, b_ids array<{of}>, b_days array<int>"
    dealt = near_blocks(offers, "_on", days), askers.withColumn("_block", day_block(F.col("_on"), days))
    met = sweep(*dealt, [*keys, "_block"], "_on", days, "_part", "_target", partial(_Pairs, days), schema, once=False)

    def rows_of(x: str) -> Column:
        return F.transform(F.arrays_zip(F.col(f"{x}_ids").alias("part"), F.col(f"{x}_days").alias("day")), lambda r: F.struct(r["part"].alias("part"), r["day"].alias("day"), F.col(x).alias("amount")))

    both = met.select("_target", "_amount", F.explode(rows_of("a")).alias("one"), rows_of("b").alias("others")).select("_target", "_amount", "one", F.explode("others").alias("other"))
    both = both.where("IF(one.amount = other.amount, one.part < other.part, one.part <> other.part)")
    turned = F.col("one.part") < F.col("other.part")
    ordered = both.select("_target", "_amount", F.when(turned, F.col("one")).otherwise(F.col("other")).alias("first"), F.when(turned, F.col("other")).otherwise(F.col("one")).alias("second"))
    lines = [F.date_from_unix_date(f"{which}.day").alias(f"day_{i}") if c == "day" else F.col(f"{which}.{c}").alias(f"{c}_{i}") for i, which in enumerate(("first", "second"), 1) for c in ("part", "amount", "day")]
    return ordered.select(F.col("_target").alias(target), F.col("_amount").alias(target_amount), *lines)


def smallest_near(parts: DataFrame, keys: list[str], amount: str, day: str, days: int, most: int) -> DataFrame:
    """For each key and day, `_day`, the `most` rows of least magnitude within `days` of it, as an array `_near` of structs.

    Each day keeps so many of its own first, so that no more than these are copied to the days around it.
    """
    there = parts.where(F.col(amount).isNotNull() & F.col(day).isNotNull())
    for at, rows in ((day, lambda x: x), ("_day", lambda x: x.withColumn("_day", F.explode(F.sequence(F.date_sub(day, days), F.date_add(day, days)))))):
        order = Window.partitionBy(*keys, at).orderBy(F.abs(amount))
        there = rows(there).withColumn("_place", F.row_number().over(order)).where(F.col("_place") <= most).drop("_place")
    return there.groupBy(*keys, "_day").agg(F.collect_list(F.struct(*[c for c in parts.columns if c not in keys])).alias("_near"))


class _Triples:
    """The parts of the days around the present one in order of their ids, and the triples of them that a target is the sum of (see `sweep`)."""

    batches = True

    def __init__(self, days: int, schema: pa.Schema) -> None:
        self.days, self.schema = days, schema
        self.parts: dict[int, list] = {}
        self.at: int | None = None
        self.found: list[tuple] = []
        self.waiting = 0

    def gather(self, day: int) -> None:
        self.at = day
        for d in [d for d in self.parts if d < day - self.days]:
            del self.parts[d]
        rows = sorted((part, amount, times, d) for d, rows in self.parts.items() for part, amount, times in rows)
        self.ids = pa.array([r[0] for r in rows], self.schema.field("part_1").type)
        self.amounts, self.times, self.dates = np.array([r[1] for r in rows]), np.array([r[2] for r in rows]), np.array([r[3] for r in rows], np.int32)
        self.rank = np.cumsum([i > 0 and rows[i][0] != rows[i - 1][0] for i in range(len(rows))])
        self.order = np.argsort(self.amounts, kind="stable")
        self.values, self.first, self.counts = np.unique(self.amounts[self.order], return_index=True, return_counts=True)

    def meet(self, kind: int, day: int, row: tuple):
        part, amount, times, target = row
        if kind == OFFER:
            self.parts.setdefault(day, []).append((part, amount, times))
            return
        if self.at != day:
            yield from self.told()
            self.gather(day)
        low, high = np.searchsorted(self.values, -abs(amount), "right"), np.searchsorted(self.values, abs(amount), "left")
        for three in triples_of(self.values[low:high], amount):
            for places in self.of_rows(*(x + low for x in three), amount):
                self.found.append((target, amount, places))
                self.waiting += places.shape[1]
                if self.waiting > MOST_TOLD:
                    yield from self.told()

    def of_rows(self, a: np.ndarray, b: np.ndarray, c: np.ndarray, total):
        """The places of three rows each that have such amounts, each three once; a row stands as often as its `times` allow."""
        n = [self.counts[x] for x in (a, b, c)]
        size = n[0] * n[1] * n[2]
        ends = np.cumsum(size)
        for start in range(0, int(ends[-1]) if len(ends) else 0, AT_ONCE):
            number = np.arange(start, min(start + AT_ONCE, int(ends[-1])))
            hit = np.searchsorted(ends, number, "right")
            number = number - (ends - size)[hit]
            one, two, three = (self.order[self.first[x[hit]] + i] for x, i in ((a, number // (n[1] * n[2])[hit]), (b, number // n[2][hit] % n[1][hit]), (c, number % n[2][hit])))
            again = [(x == y) & (self.times[x] >= 2) for x, y in ((one, two), (two, three))]
            fit = ((a != b)[hit] | (one < two) | again[0]) & ((b != c)[hit] | (two < three) | again[1]) & ((one != three) | (self.times[one] >= 3))
            places = np.sort(np.stack([x[fit] for x in (one, two, three)]), axis=0)
            rank = self.rank[places]
            fit = ((rank[:-1] < rank[1:]) | (places[:-1] == places[1:])).all(axis=0) & ((self.amounts[places[2]] > 0) == (total > 0)) & (self.amounts[places[2]] != 0)
            if fit.any():
                yield places[:, fit]

    def told(self):
        if self.found:
            times = np.repeat(np.arange(len(self.found)), [f[2].shape[1] for f in self.found])
            own = [pa.array([f[i] for f in self.found], self.schema.field(i).type).take(pa.array(times)) for i in (0, 1)]
            lines = [x for places in np.concatenate([f[2] for f in self.found], axis=1) for x in (self.ids.take(pa.array(places)), pa.array(self.amounts[places], self.schema.field("amount_1").type), pa.array(self.dates[places]).cast(pa.date32()))]
            yield pa.RecordBatch.from_arrays([*own, *lines], schema=self.schema)
        self.found, self.waiting = [], 0

    def end(self):
        yield from self.told()


def triples_of(values: np.ndarray, total):
    """The places (arrays `a`, `b`, `c`, each a <= b <= c) of three of the rising different `values`, some maybe twice or thrice, that add up to `total`."""
    if not len(values):
        return
    rows, columns = int(np.count_nonzero(values * 3 <= total)), int(np.count_nonzero(values * 2 <= total - values[0]))
    begin = int(np.searchsorted(values, total - 2 * values[-1], "left"))
    whole = isinstance(total, int) and np.issubdtype(values.dtype, np.integer)
    if whole and begin < rows and columns:
        # most sums are told to be missing by some bits
        bits = (1 << (16 * len(values)).bit_length()) - 1
        there = np.zeros(bits + 1, bool)
        there[values & bits] = True
    step = max(1, AT_ONCE // max(columns, 1))
    for start in range(begin, rows, step) if columns else ():
        rest = (total - values[start : min(start + step, rows)])[:, None] - values[None, :columns]
        a, b = np.nonzero(there[rest & bits]) if whole else np.nonzero(np.ones(rest.shape, bool))
        rest, a = rest[a, b], a + start
        c = np.searchsorted(values, rest)
        fit = (a <= b) & (b <= c) & (values[np.minimum(c, len(values) - 1)] == rest)
        if fit.any():
            yield a[fit], b[fit], c[fit]


def triple_splits(targets: DataFrame, parts: DataFrame, keys: list[str], target: str, target_amount: str, target_day: str, part: str, part_amount: str, part_day: str, days: int, most_parts: int | None = None, part_times: str | None = None) -> DataFrame:
    """Three parts of the same keys that add up to a target, each smaller than it and the last of its sign, within `days` of it.

    Rows meet as in `pair_splits`: a target looks for what is missing of each two different amounts of its window, in blocks of bounded size, and only
    the rows of amounts that add up to it are told. A part may stand in a triple as often as its `part_times` says, else once. Targets that
    repeat an id have their parts in common. With `most_parts`, a target with more smaller parts in its window has none; no query asks for that.
    """
    if most_parts is not None:
        return _bounded_triples(targets, parts, keys, target, target_amount, target_day, part, part_amount, part_day, days, most_parts)
    times = F.lit(1) if part_times is None else F.col(part_times).cast("int")
    own = targets.select(*keys, F.col(target).alias("_target"), F.col(target_amount).alias("_amount"), F.col(target_day).alias("_on")).where("_target IS NOT NULL AND _amount IS NOT NULL")
    offers = parts.select(*keys, F.col(part).alias("_part"), F.col(part_amount).alias("_amount"), times.alias("_times"), F.col(part_day).alias("_on")).where("_part IS NOT NULL AND _amount IS NOT NULL")
    name, total, of, size = (df.schema[c].dataType.simpleString() for df, c in ((own, "_target"), (own, "_amount"), (offers, "_part"), (offers, "_amount")))
    schema = f"_target {name}, _total {total}, " + ", ".join(f"part_{i} {of}, amount_{i} {size}, day_{i} date" for i in (1, 2, 3))
    repeated = own.groupBy("_target").count().where("count > 1").select("_target")
    again = not repeated.isEmpty()
    askers = (own.join(repeated, "_target", "left_anti") if again else own).withColumn("_block", day_block(F.col("_on"), days))
    arrow = to_arrow_schema(own.sparkSession.createDataFrame([], schema).schema)
    met = sweep(near_blocks(offers, "_on", days), askers, [*keys, "_block"], "_on", days, "_part", "_target", partial(_Triples, days, arrow), schema, once=False)
    if again:
        pool = window_join(own.join(repeated, "_target", "left_semi").withColumnRenamed("_amount", "_total"), offers.withColumnRenamed("_on", "day"), keys, "_on", "day", days)
        pool = pool.where(F.abs("_amount") < F.abs("_total")).withColumn("time", F.explode(F.sequence(F.lit(1), "_times")))
        pool = pool.select("_target", "_total", "_amount", F.struct(F.col("_part").alias("part"), "time").alias("id"), "day")
        one, two, three = (pool.select("_target", *(["_total"] if i == 1 else []), *[F.col(c).alias(f"{c}_{i}") for c in ("id", "_amount", "day")]) for i in (1, 2, 3))
        rest = F.col("_total") - F.col("_amount_1") - F.col("_amount_2")
        ties = one.join(two, "_target").where("id_1 < id_2" if part_times else "id_1.part < id_2.part").withColumn("_amount_3", rest).where(F.signum(rest) == F.signum("_total"))
        ties = ties.join(three, ["_target", "_amount_3"]).where("id_2 < id_3" if part_times else "id_2.part < id_3.part")
        ties = ties.select("_target", "_total", *[x for i in (1, 2, 3) for x in (F.col(f"id_{i}.part").alias(f"part_{i}"), F.col(f"_amount_{i}").cast(size).alias(f"amount_{i}"), F.col(f"day_{i}").cast("date").alias(f"day_{i}"))])
        met = met.unionByName(ties.distinct() if part_times else ties)
    return met.withColumnsRenamed({"_target": target, "_total": target_amount})


def _bounded_triples(targets: DataFrame, parts: DataFrame, keys: list[str], target: str, target_amount: str, target_day: str, part: str, part_amount: str, part_day: str, days: int, most_parts: int) -> DataFrame:
    """`triple_splits` with `most_parts`. If a target has no more, they are among the `most_parts` least of its window, and one more of these tells the others."""
    own = targets.select(*keys, F.col(target).alias("_target"), F.col(target_amount).alias("_total"), F.col(target_day).alias("_day")).where("_target IS NOT NULL")
    named = parts.select(*keys, F.col(part).alias("part"), F.col(part_amount).alias("amount"), F.col(part_day).alias("day"))
    met = own.join(smallest_near(named, keys, "amount", "day", days, most_parts + 1), [*keys, "_day"])
    met = met.withColumn("_pool", F.filter("_near", lambda x: F.abs(x["amount"]) < F.abs(F.col("_total")))).withColumn("n", F.size("_pool")).where("n > 0")
    # rows that repeat a target's id have their parts in common
    met = met.select("_target", "n", F.struct("_total", F.when(F.col("n") <= most_parts, F.col("_pool")).alias("pool")).alias("row"))
    met = met.groupBy("_target").agg(F.sum("n").alias("n"), F.collect_list("row").alias("rows")).where(F.col("n").between(3, most_parts))
    met = met.select("_target", F.flatten("rows.pool").alias("pool"), F.explode("rows").alias("row")).select("_target", "pool", F.col("row._total").alias("_total"), F.explode("row.pool").alias("one"))
    met = met.select("*", F.explode(F.filter("pool", lambda x: F.col("one.part") < x["part"])).alias("two"))
    met = met.withColumn("rest", F.col("_total") - F.col("one.amount") - F.col("two.amount")).where(F.signum("rest") == F.signum("_total"))
    met = met.select("*", F.explode(F.filter("pool", lambda x: (x["amount"] == F.col("rest")) & (F.col("two.part") < x["part"]))).alias("three"))
    lines = [F.col(f"{which}.{c}").alias(f"{c}_{i}") for i, which in enumerate(("one", "two", "three"), 1) for c in ("part", "amount", "day")]
    return met.select(F.col("_target").alias(target), F.col("_total").alias(target_amount), *lines)


def as_of(points: DataFrame, events: DataFrame, keys: list[str], at: str, event_at: str, order: list[str], value: str, before: bool = True) -> DataFrame:
    """For each point the latest event's non-null `value` before (or at) its time: one pass over both, ordered together.

    Points and events are united and the last value is carried along the window; there is no range join.
    """
    kinds = F.lit(0 if before else 1)
    e = events.where(F.col(value).isNotNull()).select(*keys, F.col(event_at).alias("_at"), (F.lit(1) - kinds).alias("_kind"), *[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)], F.col(value).alias("_value"))
    p = points.withColumn("_point", F.struct(*points.columns)).select(*keys, F.col(at).alias("_at"), kinds.alias("_kind"), "_point")
    both = e.unionByName(p, allowMissingColumns=True)
    so_far = Window.partitionBy(*keys).orderBy("_at", "_kind", *[f"_o{i}" for i in range(len(order))]).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return both.withColumn(f"as_of_{value}", F.last("_value", ignorenulls=True).over(so_far)).where("_point IS NOT NULL").select("_point.*", f"as_of_{value}")


def allocate(left: DataFrame, right: DataFrame, keys: list[str], left_id: str, left_amount: str, left_order: list[str], right_id: str, right_amount: str, right_order: list[str]) -> DataFrame:
    """Greedy allocation of left amounts to right amounts, both in order: overlaps of cumulative intervals.

    Magnitudes are allocated, so signs don't matter. Of two overlapping intervals one begins inside the other, so
    each row only needs the interval of the other side that is open where its own begins: all rows of a group are
    ordered by their beginnings once and that interval is carried along. No group's rows are paired.
    """

    def intervals(df: DataFrame, name: str, amount: str, order: list[str], side: int) -> DataFrame:
        running = F.sum(F.abs(amount)).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
        span = F.struct((running - F.abs(amount)).alias("since"), running.alias("till"))
        ids = [F.col(name) if side == i else F.lit(None).cast(df_.schema[n].dataType) for i, (df_, n) in enumerate(((left, left_id), (right, right_id)))]
        return df.select(*keys, F.lit(side).alias("side"), ids[0].alias("l_id"), ids[1].alias("r_id"), span.alias("span")).withColumn("since", F.col("span.since"))

    both = intervals(left, left_id, left_amount, left_order, 0).unionByName(intervals(right, right_id, right_amount, right_order, 1))
    so_far = Window.partitionBy(*keys).orderBy("since", "side").rowsBetween(Window.unboundedPreceding, Window.currentRow)

    def open_one(side: int) -> Column:
        return F.last(F.when((F.col("side") == side) & (F.col("span.till") > F.col("span.since")), F.struct("l_id", "r_id", "span")), ignorenulls=True).over(so_far)

    other = F.when(F.col("side") == 0, F.col("open_1")).otherwise(F.col("open_0"))
    met = both.withColumn("open_0", open_one(0)).withColumn("open_1", open_one(1)).withColumn("other", other)
    met = met.where((F.col("other.span.since") < F.col("span.till")) & (F.col("span.since") < F.col("other.span.till")))
    own_left = F.col("side") == 0
    return met.select(
        *keys, F.when(own_left, F.col("l_id")).otherwise(F.col("other.l_id")).alias(left_id), F.when(own_left, F.col("other.r_id")).otherwise(F.col("r_id")).alias(right_id),
        (F.least("span.till", "other.span.till") - F.greatest("span.since", "other.span.since")).alias("allocated"),
    )
