"""Rules that route, label or cap a movement, as columns. Rule lists are settings of a few entries, so they become CASE branches, not joins."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from reconlake.functions.names import CARD_NETWORK, FEE


def first_rule(rules: list[tuple[Column, Column | str | int]]) -> Column:
    """The value of the first (condition, value) whose condition is true; else null."""
    if not rules:
        return F.lit(None)
    return F.coalesce(*[F.when(condition, value if isinstance(value, Column) else F.lit(value)) for condition, value in rules])


def memo_route(memo: Column, party: Column, routes: list[tuple[str, int, str | None]]) -> Column:
    """The account of the first route (marker, account, party marker) whose markers the memo and the party hold."""
    low, name = F.lower(F.coalesce(memo, F.lit(""))), F.lower(F.coalesce(party, F.lit("")))
    return first_rule([(low.contains(marker.lower()) & (F.lit(True) if who is None else name.contains(who.lower())), account) for marker, account, who in routes])


def gap_tag(is_internal: Column, memo: Column) -> Column:
    """Why a bank movement stands open: an internal party, the card network, a fee, or nothing known."""
    text = F.coalesce(memo, F.lit(""))
    return F.when(F.coalesce(is_internal, F.lit(False)), "internal").when(text.rlike(CARD_NETWORK), "card").when(text.rlike(FEE), "fee").otherwise("unclassified")


def capped_status(status: Column, is_exception: Column, is_routed: Column) -> Column:
    """Exceptions and movements routed by memo are suggested at most."""
    capped = F.coalesce(is_exception, F.lit(False)) | F.coalesce(is_routed, F.lit(False))
    return F.when((status == "AUTO") & capped, "SUGGESTED").otherwise(status)


def match_type(delta: Column, parts: Column) -> Column:
    """Label of a match by its days apart: one row or several on the other side."""
    days = F.abs(delta)
    single = F.when(days == 0, "EXACT_SAME_DAY").when(days <= 3, "EXACT_PM3").otherwise("EXACT_PM7")
    return F.when(parts > 1, F.when(days == 0, "SPLIT_SAME_DAY").otherwise("SPLIT_PM3")).otherwise(single)


def resolved_account(forced: Column, by_number: Column, by_file: Column, only: Column, placeholder: Column) -> Column:
    """The account of an imported file: given by hand, else by its number, its file's name, the only account there is, or a placeholder."""
    return F.coalesce(forced, by_number, by_file, only, placeholder)
