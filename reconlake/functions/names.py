"""Tax ids, names, memos and receipts as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Accented letters and their plain forms.
ACCENTED, PLAIN = "ÁÀÂÄÃÉÈÊËÍÌÎÏÓÒÔÖÕÚÙÛÜÑÇ", "AAAAAEEEEIIIIOOOOOUUUUNC"
#: Fixed value: the tax id that stands for an unknown client.
GENERIC_TAX_ID = "55555555-5"
#: Memo patterns of operations, fees and card networks.
OPERATION = r"\b(?:N\s*OPE|OPE|OP|NO|TD\s*OP)[\s.:#]*0*(\d{2,7})"
FEE = r"(?i)(comisi[oó]n|mantenci[oó]n|impuesto|iva\b|cargo\b|gasto\s+banc|cobro\b)"
CARD_NETWORK = r"(?i)\b(transbank|redbank|t\.?b\.?k)\b"
CARD_MARKERS = ("abn crd", "transba")
#: Words of memos and company names that identify nobody.
STOP_WORDS = tuple(
    "DEP DEPOSITO DEPOSITOS BCI ME BAGO MG SANTANDER CHILE INTERNACIONAL BOL BOLETA BOLETAS FACT FACTURA TICKET TKT TCKT TKTS REF AUT OP ENVIO APP "
    "TRF TRANSF TRANSFERENCIA TRANSFIERE GIRO GIROS DE DEL LA EL Y EN POR CON SPA LTDA LIMITADA SA REG MOV MAS X".split()
)
#: Forms of a tax id in a text (written out, a number at the start, a number with its check digit) and of two receipts.
TAX_ID_FORMS = (r"(\d{1,2}\.?\d{3}\.?\d{3}-[\dkK])", r"^(\d{8,11})\b", r"\b(\d{8,9}[\dkK])\b")
TWO_RECEIPTS = r"(?<!\d)(\d{3,4})\s*[/-]\s*0*(\d{3,4})(?!\d)"


def dashed_tax_id(text: Column) -> Column:
    """Upper case without dots and blanks, digits then a dash and the check digit; other texts unchanged."""
    bare = F.regexp_replace(F.upper(F.trim(text)), r"[.\s]", "")
    return F.when(bare.rlike(r"^\d+-?[0-9K]$"), F.regexp_replace(bare, r"^(\d+)-?([0-9K])$", "$1-$2")).otherwise(text)


def compact_tax_id(text: Column) -> Column:
    """Digits and K only, upper case; null gives an empty text."""
    return F.upper(F.regexp_replace(F.coalesce(text, F.lit("")), "[^0-9kK]", ""))


def tax_id_in(text: Column) -> Column:
    """A tax id in a text: written out, else 8 to 11 digits at the start, else 8 or 9 digits with a check digit; else empty."""
    found = [F.regexp_extract(F.coalesce(text, F.lit("")), p, 1) for p in TAX_ID_FORMS]
    return compact_tax_id(F.coalesce(*[F.nullif(f, F.lit("")) for f in found], F.lit("")))


def bare_tax_id(text: Column) -> Column:
    """The compact form without leading zeros."""
    return F.regexp_replace(compact_tax_id(text), "^0+", "")


def bare_ids_agree(x: Column, y: Column, least: int = 7) -> Column:
    """Two bare tax ids are equal, or one is the start of the other with `least` digits or more."""
    return (x != "") & (y != "") & ((x == y) | ((F.length(x) >= least) & y.startswith(x)) | ((F.length(y) >= least) & x.startswith(y)))


def same_tax_id(a: Column, b: Column, least: int = 7) -> Column:
    """Equal but for leading zeros, or one the start of the other with `least` digits or more."""
    return bare_ids_agree(bare_tax_id(a), bare_tax_id(b), least)


def plain_upper(text: Column) -> Column:
    return F.translate(F.upper(text), ACCENTED, PLAIN)


def tokens(text: Column, least: int = 3, stop: tuple[str, ...] = ()) -> Column:
    """Distinct plain upper-case tokens of `least` characters or more that aren't numbers or stop words."""
    parts = F.split(plain_upper(F.coalesce(text, F.lit(""))), "[^A-Z0-9]+")
    kept = lambda t: (F.length(t) >= least) & ~t.rlike("^[0-9]+$")
    return F.array_distinct(F.filter(parts, lambda t: kept(t) & ~t.isin(*stop) if stop else kept(t)))


def normal_text(text: Column) -> Column:
    return F.lower(F.regexp_replace(F.trim(text), r"\s+", " "))


def account_digits(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, "[^0-9]", ""), "^0+", "")


def short_hash(*parts: Column) -> Column:
    """The first 32 hexadecimal digits of the SHA-256 of the parts joined by `|`."""
    return F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 32)


def operation_number(memo: Column) -> Column:
    """The last tagged operation number of a memo, else its last run of 2 to 7 digits, without leading zeros."""
    upper = F.upper(F.coalesce(memo, F.lit("")))
    last = lambda found: F.try_element_at(found, F.lit(-1))
    number = F.coalesce(last(F.regexp_extract_all(upper, F.lit(OPERATION), 1)), last(F.regexp_extract_all(upper, F.lit(r"(\d{2,7})"), 1)))
    return F.coalesce(F.nullif(F.regexp_replace(number, "^0+", ""), F.lit("")), number)


def receipt_list(memo: Column) -> Column:
    """Receipts of `4047/4048` or `515-516`; a rising range of five at most is filled; else null."""
    # the pattern is looked for once: what it found is one element of an array, and so are its numbers
    found = F.split(F.regexp_extract(memo, TWO_RECEIPTS, 0), "[/-]")

    def listed(two: Column) -> Column:
        a, b = F.get(two, F.lit(0)), F.get(two, F.lit(1))
        return F.when(a != b, F.when((b > a) & (b - a <= 4), F.sequence(a, b)).otherwise(F.array(a, b)))

    return F.get(F.transform(F.array(F.transform(found, lambda x: x.try_cast("int"))), listed), F.lit(0))


def is_card_deposit(direction: Column, memo: Column) -> Column:
    low = F.lower(F.coalesce(memo, F.lit("")))
    return (direction == "IN") & low.contains(CARD_MARKERS[0]) & low.contains(CARD_MARKERS[1])


def is_small(amount: Column, threshold: int) -> Column:
    return (F.abs(amount) > 0) & (F.abs(amount) <= threshold)


def is_bank_fee(direction: Column, memo: Column, name: Column, tax_id: Column) -> Column:
    nobody = (F.trim(F.coalesce(name, F.lit(""))) == "") & (F.trim(F.coalesce(tax_id, F.lit(""))) == "")
    return (direction == "OUT") & nobody & F.coalesce(memo, F.lit("")).rlike(FEE)


def counterparty_quality(name: Column, tax_id: Column) -> Column:
    return F.when(F.coalesce(tax_id, F.lit("")) != "", "with_id").when(F.coalesce(name, F.lit("")) != "", "name_only").otherwise("nothing")


def memo_parts(memo: Column) -> Column:
    """(is_multipart, part_number) of a deposit memo: `DEP (2) …` has one, `DEP 1166751 …` hasn't."""
    body = F.regexp_replace(F.trim(F.coalesce(memo, F.lit(""))), r"(?i)^\s*DEP(?:OSITO)?S?\s+", "")
    number = F.regexp_extract(body, r"^\((\d{1,3})\)\s+", 1)
    return F.struct((number != "").alias("is_multipart"), number.try_cast("int").alias("part_number"))


def party_facts(name: Column, tax_id: Column) -> Column:
    """What `facts_agree` looks at: the plain name, its tokens and the compact tax id."""
    return F.struct(normal_text(F.coalesce(name, F.lit(""))).alias("text"), tokens(name).alias("tokens"), compact_tax_id(tax_id).alias("tax_id"))


def facts_agree(a: Column, b: Column, least_overlap: float = 0.5) -> Column:
    overlap = F.size(F.array_intersect(a["tokens"], b["tokens"])) / F.greatest(F.size(F.array_union(a["tokens"], b["tokens"])), F.lit(1))
    by_id = (a["tax_id"] != "") & (b["tax_id"] != "")
    return F.when(by_id, a["tax_id"] == b["tax_id"]).otherwise((a["text"] == "") | (b["text"] == "") | a["text"].contains(b["text"]) | b["text"].contains(a["text"]) | (overlap >= least_overlap))


def names_agree(name_a: Column, id_a: Column, name_b: Column, id_b: Column, least_overlap: float = 0.5) -> Column:
    """Two parties may be one: by their tax ids if both have one; else an empty name, one in the other, or half their tokens."""
    return facts_agree(party_facts(name_a, id_a), party_facts(name_b, id_b), least_overlap)


def line_detail(*parts: Column, most: int = 50) -> Column:
    """The parts that aren't blank, joined by ` - ` and cut to `most` characters."""
    return F.substring(F.concat_ws(" - ", *[F.nullif(F.trim(p), F.lit("")) for p in parts]), 1, most)


#: Words of expense memos that name no recipient.
EXPENSE_WORDS = tuple(
    "PAGO PAGOS ARRIENDO ARRDO ARRENDAMIENTO BODEGA LOCAL DEPTO DEPARTAMENTO GASTOS COMUNES FINIQUITO FINIQUTO FINIQUITOS PRORRAT PRORRATEO SALDO HONORARIOS SERVICIOS "
    "SERVICIO PROVEEDORES PROVEEDOR ASESORIA FACT FACTURA TRANSF TRANSFERENCIA INTERNET ABONO DIF PDTE PENDIENTE MES ENE FEB MAR ABR MAY JUN JUL AGO SEP OCT NOV DIC "
    "SPA LTDA LIMITADA DE DEL LA EL Y".split()
)
#: Fixed value: a tax id anywhere in a memo.
MEMO_TAX_ID = r"(\d{1,2}[.,]?\d{3}[.,]?\d{3}-?[\dkK])"
#: What words of a deposit memo are, by kind and what they stand for. Banks and holders come in the order of their rank.
MEMO_BANKS = {"BCI": ("BCI",), "SANTANDER": ("SANTANDER", "SANTANER", "SANTANNER", "SANTNADER", "SANTADNER", "SANTNDER"), "INTERNACIONAL": ("INTERNACIONAL", "MORECAPITAL")}
MEMO_OTHER_BANKS = {
    "BICE": ("BICE",), "ITAU": ("ITAU", "ITAÚ"), "CHILE": ("CHILE",), "FALABELLA": ("FALABELLA",), "ESTADO": ("ESTADO",), "SCOTIABANK": ("SCOTIA", "SCOTIABANK"), "SECURITY": ("SECURITY",),
    "RIPLEY": ("RIPLEY",), "CONSORCIO": ("CONSORCIO",), "BTG": ("BTG",), "HSBC": ("HSBC",),
}
MEMO_HOLDERS = {"ME SPA": ("ME",), "MG SPA": ("MG",), "BACO SPA": ("BACO",), "MORECAPITAL": ("MORECAPITAL", "MORECAP")}
MEMO_FILLERS = ("DEP", "DEPOSITO", "BANCO", "BCO", "PENDIENTE", "CC", "CTA", "CUENTA BANCARIA", "POR DEPOSITAR")


def recipient_tokens(memo: Column) -> Column:
    """Words of four letters or more that may name whom an expense went to: those after the first slash, if there is one."""
    text = F.coalesce(memo, F.lit(""))
    at = F.instr(text, "/")
    return tokens(F.when(at > 0, F.translate(F.substring(text, at + 1, F.length(text)), "/", " ")).otherwise(text), 4, EXPENSE_WORDS)


def tax_ids_in(text: Column) -> Column:
    """All different tax ids of a text, dashed."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(MEMO_TAX_ID), 1)
    return F.array_distinct(F.transform(found, dashed_tax_id))


def name_in_transfer(memo: Column) -> Column:
    """`0085668013 Transf. ROHDIS TABILO` -> the name; a tax id alone, or under three characters: null."""
    rest = F.regexp_replace(memo, r"^0?\d{8,12}[A-Z]?\s+", "")
    name = F.trim(F.regexp_replace(rest, r"(?i)^Transf\.?\s*(?:de|a|para)?\s*", ""))
    return F.when((F.length(name) >= 3) & ~name.rlike(r"^\d{1,9}[-.]\d?[Kk]?$"), name)


def name_after_transfer_word(memo: Column) -> Column:
    """`Traspaso A: Sonia Munoz` -> the name; other memos: null."""
    name = F.trim(F.regexp_extract(memo, r"(?i)^Traspaso\s+(?:A|De)\s*:?\s*(.+?)$", 1))
    return F.when(F.length(name) >= 3, name)


def name_before_tax_id(memo: Column) -> Column:
    """`TRANSF. PARA Vector capital 77333096-4` -> the name between the words of a transfer and a tax id at the end."""
    rest = F.regexp_replace(F.trim(memo), r"(?i)^transf(?:erencia)?\.?\s*(?:para|a|de(?:\s+otro\s+banco)?)?\s*", "")
    name = F.trim(F.regexp_replace(rest, r"\s*\d{7,9}-?[\dKk]\s*$", ""))
    return F.when(F.length(name) >= 3, name)


def client_label(bank_name: Column, own_name: Column) -> Column:
    """The bank's name and the own one; one of them if they agree or the other is blank; else a dash."""
    b, t = (F.nullif(F.trim(c), F.lit("")) for c in (bank_name, own_name))
    return F.when(b.isNotNull() & t.isNotNull() & (F.lower(b) != F.lower(t)), F.concat(b, F.lit(" / "), t)).otherwise(F.coalesce(b, t, F.lit("—")))


def _word_map(table: dict[str, tuple[str, ...]]) -> Column:
    return F.create_map(*[F.lit(x) for name, words in table.items() for word in words for x in (word, name)])


def _highest(names: Column, rank: dict) -> Column:
    """The first of the rank's names that is among `names`."""
    return F.coalesce(*[F.when(F.array_contains(names, name), F.lit(name)) for name in rank])


def memo_clues(memo: Column) -> Column:
    """(bank, other_bank, holder, tax_id, transfer, hint, quality) of a deposit memo.

    The memo, without its first tax ids, is cut into words; each word is told by a table to be a bank, a holder, a filler, part of a
    transfer's number, or none of these. ME and MG stand for holders only where they can't be a pronoun or a name: before SPA,
    before no further word, or after DEP (ME also one word later). `other_bank` is a bank without own accounts, where
    no own one is named (CHILE only behind BANCO or BCO). The first five free words with letters are the hint, if all free
    words make four characters or more. The quality says how many of bank, holder, tax id, transfer and hint there are.
    """
    text = F.upper(F.trim(F.coalesce(memo, F.lit(""))))
    tax_id = F.nullif(F.regexp_extract(text, MEMO_TAX_ID, 1), F.lit(""))
    cut = F.filter(F.split(F.regexp_replace(text, MEMO_TAX_ID, " "), r"[\s.,;:!?_-]+"), lambda w: w != "")
    words = F.transform(cut, lambda w: F.regexp_replace(w, r"^[^A-Z0-9ÁÉÍÓÚÑ]+|[^A-Z0-9ÁÉÍÓÚÑ]+$", ""))
    # words and kinds are worked out once: they go through a lambda each
    found = F.element_at(F.transform(F.array(words), lambda ws: F.element_at(F.transform(F.array(_word_kinds(ws)), _clues), 1)), 1)
    pieces = sum((F.when(found[n].isNotNull(), 1).otherwise(0) for n in ("bank", "holder", "transfer", "hint")), F.when(tax_id.isNotNull(), 1).otherwise(0))
    quality = F.when(pieces >= 3, "EXCELLENT").when(pieces == 2, "GOOD").when(pieces == 1, "FAIR").otherwise("POOR")
    return F.struct(found["bank"].alias("bank"), found["other_bank"].alias("other_bank"), found["holder"].alias("holder"), dashed_tax_id(tax_id).alias("tax_id"), found["transfer"].alias("transfer"), found["hint"].alias("hint"), quality.alias("quality"))


def _clues(kinds: Column) -> Column:
    """What the words' kinds say of the whole memo."""
    column = lambda name: F.array_compact(F.transform(kinds, lambda k: k[name]))
    first = lambda name: F.try_element_at(column(name), F.lit(1))
    bank, rest = _highest(column("bank"), MEMO_BANKS), column("free")
    hint_words = F.slice(F.filter(rest, lambda w: (F.length(w) >= 2) & w.rlike("[A-ZÁÉÍÓÚÑ]")), 1, 5)
    return F.struct(
        bank.alias("bank"), F.when(bank.isNull(), _highest(column("other"), MEMO_OTHER_BANKS)).alias("other_bank"), _highest(column("holder"), MEMO_HOLDERS).alias("holder"),
        F.coalesce(first("sent"), first("by_app"), first("later")).alias("transfer"), F.when((F.length(F.array_join(rest, " ")) >= 4) & (F.size(hint_words) > 0), F.array_join(hint_words, " ")).alias("hint"),
    )


def _word_kinds(words: Column) -> Column:
    """What each of the words is, by the tables and its neighbours."""
    fillers = F.array(*[F.lit(w) for w in MEMO_FILLERS])

    def near(i: Column, by: int) -> Column:
        return F.coalesce(F.try_element_at(words, F.when(i + by > 0, i + by).otherwise(F.size(words) + 1)), F.lit(""))

    def number(word: Column) -> Column:
        return F.nullif(F.regexp_extract(word, r"^\d{3,8}", 0), F.lit(""))

    def told(word: Column, place: Column) -> Column:
        i = place + 1
        before, after = near(i, -1), near(i, 1)
        more_capital = ((word == "MORE") & after.startswith("CAPITAL")) | ((before == "MORE") & (word == "CAPITAL"))
        giros = lambda a, z: (a == "MORE") & z.isin("GIRO", "GIROS")
        app = lambda a, z: (a == "GIRO") & (z == "APP")
        counted = F.coalesce(number(after), F.when(after == "NRO", number(near(i, 2))))
        sent = F.when(giros(before, word), counted)
        by_app = F.when(app(before, word), number(after))
        own = (after == "SPA") | ~after.rlike("^[A-ZÁÉÍÓÚÑ]") | (before == "DEP") | ((word == "ME") & (near(i, -2) == "DEP"))
        holder = F.when(more_capital, F.lit("MORECAPITAL")).when(~word.isin("ME", "MG") | own, F.try_element_at(_word_map(MEMO_HOLDERS), word))
        bank = F.when(more_capital, F.lit("INTERNACIONAL")).otherwise(F.try_element_at(_word_map(MEMO_BANKS), word))
        behind_bank = before.isin("BANCO", "BCO") | ((before == "DE") & near(i, -2).isin("BANCO", "BCO"))
        other = F.when((word != "CHILE") | behind_bank, F.try_element_at(_word_map(MEMO_OTHER_BANKS), word))
        # a transfer's words and number: MORE GIROS [NRO] n anywhere, GIRO APP n at the start, APP MORE GIROS
        numbered = lambda at: giros(near(i, at), near(i, at + 1)) & ((near(i, at + 2) == "NRO") | number(near(i, at + 2)).isNotNull())
        of_transfer = numbered(0) | numbered(-1) | (numbered(-2) & ((word == "NRO") | number(word).isNotNull())) | (numbered(-3) & (before == "NRO") & number(word).isNotNull())
        at_start = lambda at: ((i + at == 1) | ((i + at == 2) & F.element_at(words, 1).isin("DEP", "DEPOSITO"))) & app(near(i, at), near(i, at + 1)) & number(near(i, at + 2)).isNotNull()
        of_transfer = of_transfer | at_start(0) | at_start(-1) | at_start(-2)
        of_app = ((word == "APP") & giros(after, near(i, 2))) | ((before == "APP") & giros(word, after)) | ((near(i, -2) == "APP") & giros(before, word))
        named = word.isin("ME", "MG", "BACO", "MORECAPITAL") | ((word == "SPA") & before.isin("ME", "MG", "BACO", "MORECAPITAL"))
        a_bank = F.try_element_at(_word_map(MEMO_BANKS), word).isNotNull() | F.try_element_at(_word_map(MEMO_OTHER_BANKS), word).isNotNull()
        filler = F.array_contains(fillers, word) | F.array_contains(fillers, F.concat(word, F.lit(" "), after)) | F.array_contains(fillers, F.concat(before, F.lit(" "), word))
        free = ~(filler | named | a_bank | of_transfer | of_app)
        later = F.when(number(word).isNotNull() & F.exists(F.sequence(F.lit(1), i), lambda j: giros(near(j, 0), near(j, 1)) & (j < i)), number(word))
        return F.struct(F.when(free, word).alias("free"), bank.alias("bank"), other.alias("other"), holder.alias("holder"), sent.alias("sent"), by_app.alias("by_app"), later.alias("later"))

    return F.transform(words, told)
