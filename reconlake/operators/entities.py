"""Whom a movement concerns, by a cascade of evidence, and which ledger code an account has."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reconlake.functions.names import bare_ids_agree, bare_tax_id, normal_text, tax_id_in
from reconlake.operators.containment import containing

STEPS = ("tax_id", "tax_id_in_name", "tax_id_in_memo", "pattern")


def whole_word(text: Column, word: Column) -> Column:
    """The word, whatever its signs, stands in the text by itself; case and the width of blanks don't matter."""
    quoted = F.regexp_replace(F.regexp_replace(F.trim(word), r"([.*+?^${}()|\[\]\\])", r"\\$1"), r"\s+", r"\\s+")
    return F.regexp_like(text, F.concat(F.lit(r"(?i)(^|\W)"), quoted, F.lit(r"(\W|$)")))


def _even(text: Column) -> Column:
    """Lower case, every stretch of white space one blank."""
    return F.regexp_replace(F.lower(text), r"\s+", " ")


def _id_key(bare: Column) -> Column:
    """What two bare ids that agree share: their first seven digits, or all of a shorter one."""
    return F.when(F.length(bare) >= 7, F.substring(bare, 1, 7)).otherwise(F.nullif(bare, F.lit("")))


def detect(movements: DataFrame, known: DataFrame, by_word: bool = True, id_col: str = "bank_id") -> DataFrame:
    """(`id_col`, entity_id, via) of the movements that concern one of `known` (entity_id, tax_id, patterns array).

    Evidence in this order: the counterparty's tax id, one in its name, one in the memo, a pattern. Patterns are whole
    words of the counterparty's name, or (not `by_word`) texts of three characters or more in name or memo. The best
    evidence wins, then the least entity_id. Ids meet under their first digits, patterns and texts under rare parts of
    the patterns (`containing`), so `known` may be as large as it likes.
    """
    c = F.col
    name, memo = F.coalesce("counterparty", F.lit("")), F.coalesce("memo", F.lit(""))
    hay = name if by_word else F.concat(name, F.lit(" "), memo)
    ids = F.array(bare_tax_id(c("counterparty_tax_id")), bare_tax_id(tax_id_in(c("counterparty"))), bare_tax_id(tax_id_in(c("memo"))))
    own = movements.select(id_col, F.posexplode(ids).alias("step", "own_id")).withColumn("key", _id_key(c("own_id")))
    held = known.select("entity_id", bare_tax_id(c("tax_id")).alias("known_id")).withColumn("key", _id_key(c("known_id")))
    by_id = own.join(held, "key").where(bare_ids_agree(c("own_id"), c("known_id"))).select(id_col, "entity_id", "step")
    words = known.select("entity_id", F.explode("patterns").alias("pattern")).where(F.length(F.trim("pattern")) >= (1 if by_word else 3))
    # whole words hold the pattern whatever the width of blanks; plain patterns must stand there as they are
    plain = _even if by_word else F.lower
    needles = words.select("entity_id", "pattern", plain(F.trim("pattern")).alias("needle"))
    texts = movements.select(id_col, hay.alias("hay"), plain(hay).alias("searched"))
    met = containing(texts, "searched", needles, "needle")
    hits = (met.where(whole_word(c("hay"), c("pattern"))) if by_word else met).select(id_col, "entity_id", F.lit(3).alias("step"))
    best = by_id.unionByName(hits).groupBy(id_col).agg(F.min(F.struct("step", "entity_id")).alias("best"))
    via = F.element_at(F.array(*[F.lit(s) for s in STEPS]), c("best.step") + 1)
    return best.select(id_col, c("best.entity_id").alias("entity_id"), via.alias("via"))


def ledger_codes(accounts: DataFrame, codes: DataFrame, entities: DataFrame | None = None, explicit: bool = True, least: int = 1) -> DataFrame:
    """(account_id, code) of all accounts; null where nothing fits.

    `codes` (code, name, account_id) give: the code that names the account itself (if `explicit`), else one whose name is
    the account's `bank holder`, else one whose name holds it or is held by it (`least` characters or more), else the
    code of the entity with the holder's tax id. Of several the least code. Accounts and codes meet by equal ids and names
    and by rare parts of names (`containing`).
    """
    c = F.col
    labels = accounts.select("account_id", "holder_tax_id", normal_text(F.concat_ws(" ", "bank", "holder")).alias("label"))
    named = codes.select("code", normal_text(F.coalesce("name", F.lit(""))).alias("name"), c("account_id").alias("linked"))
    steps = [labels.join(named, c("label") == c("name")).select("account_id", F.lit(1).alias("step"), "code")]
    if explicit:
        steps.append(labels.join(named, c("account_id") == c("linked")).select("account_id", F.lit(0).alias("step"), "code"))
    long = named.where(F.length("name") >= least)
    steps.append(containing(labels, "label", long, "name").select("account_id", F.lit(2).alias("step"), "code"))
    steps.append(containing(long, "name", labels, "label").select("account_id", F.lit(2).alias("step"), "code"))
    every = steps[0]
    for more in steps[1:]:
        every = every.unionByName(more)
    best = every.groupBy("account_id").agg(F.min(F.struct("step", "code")).alias("best")).select("account_id", c("best.code").alias("by_name"))
    found = accounts.join(best, "account_id", "left")
    if entities is None:
        return found.select("account_id", c("by_name").alias("code"))
    held = entities.where("code IS NOT NULL").select(bare_tax_id(c("tax_id")).alias("entity_id"), c("code").alias("entity_code")).withColumn("key", _id_key(c("entity_id")))
    owners = accounts.select("account_id", bare_tax_id(c("holder_tax_id")).alias("own_id")).withColumn("key", _id_key(c("own_id")))
    owned = owners.join(held, "key").where(bare_ids_agree(c("own_id"), c("entity_id"))).groupBy("account_id").agg(F.min("entity_code").alias("by_entity"))
    return found.join(owned, "account_id", "left").select("account_id", F.coalesce("by_name", "by_entity").alias("code"))
