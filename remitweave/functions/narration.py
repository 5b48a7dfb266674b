"""Bank narrations, read word by word: rail, transfer number, settlement reference, counterparty."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that name a rail, and the rail each stands for.
RAILS = {"NEFT": "NEFT", "RTGS": "RTGS", "IMPS": "IMPS", "UPI": "UPI", "NACH": "NACH", "ACH": "NACH", "CHQ": "CHQ", "CLG": "CHQ"}
#: Forms of the numbers that banks give, as whole words. RTGS: bank, R, 17 more; NEFT: bank, N, H or digit, 11 more; retrieval
#: reference: 12 digits; branch code: bank, 0, 6 more.
RTGS_UTR, NEFT_UTR, RRN, IFSC = "[A-Z]{4}R[A-Z0-9]{17}", "[A-Z]{4}[NH0-9][A-Z0-9]{11}", "[0-9]{12}", "[A-Z]{4}0[A-Z0-9]{6}"
#: Beginnings of settlement references, and the characters that such a word has at least.
SETTLEMENT_PREFIXES, SETTLEMENT_LENGTH = ("SETL", "SETTLE"), 8
#: Last words of companies' names, and words of a narration that no name holds.
ENDINGS = ("LTD", "LIMITED", "LLP", "TRADERS", "ENTERPRISES", "PAYMENTS", "SOLUTIONS")
NO_NAMES = (*RAILS, "UTR", "CR", "DR", "BY", "TO", "FROM", "REF", "TRANSFER")


def _words(text: Column, apart: str) -> Column:
    return F.filter(F.split(F.upper(text), apart), lambda w: w != "")


def _first(words: Column, test) -> Column:
    return F.get(F.filter(words, test), 0)


def rail(text: Column) -> Column:
    names = F.create_map(*[F.lit(x) for pair in RAILS.items() for x in pair])
    return F.element_at(names, _first(_words(text, "[^A-Z0-9]+"), lambda w: w.isin(*RAILS)))


def utr(text: Column) -> Column:
    """The number after the word UTR, else one in the form of an RTGS or NEFT number, else 12 digits; never a branch code."""
    words = _words(text, "[^A-Z0-9]+")
    after = F.get(words, F.array_position(words, "UTR").cast("int"))  # positions count from 1
    named = F.when(F.array_contains(words, "UTR") & F.length(after).between(8, 22) & ~after.rlike(f"^{IFSC}$"), after)
    joined = F.substring(_first(words, lambda w: w.rlike("^UTR[A-Z0-9]{8,22}$")), 4, 22)
    return F.coalesce(named, joined, *[_formed(words, form) for form in (RTGS_UTR, NEFT_UTR, RRN)])


def transfer_number(text: Column) -> Column:
    """The first number in one of the banks' forms, by one pattern: for joins over many credits. Null if there is none."""
    forms = "|".join((RTGS_UTR, NEFT_UTR, RRN))
    return F.nullif(F.regexp_extract(F.upper(text), rf"(?<![A-Z0-9])(?:UTR[:\s-]*)?({forms})(?![A-Z0-9])", 1), F.lit(""))


def _formed(words: Column, form: str) -> Column:
    return _first(words, lambda w: w.rlike(f"^{form}$"))


def settlement_ref(text: Column) -> Column:
    """The first word with a settlement's prefix and a digit, as it is written."""
    words = F.split(text, "[^A-Za-z0-9_-]+")
    starts = lambda w: F.upper(w).startswith(SETTLEMENT_PREFIXES[0]) | F.upper(w).startswith(SETTLEMENT_PREFIXES[1])
    return _first(words, lambda w: starts(w) & (F.length(w) >= SETTLEMENT_LENGTH) & w.rlike("[0-9]"))


def counterparty(text: Column) -> Column:
    """A company's name: the words of letters before one that ends such names, back to the first that can't be in one."""
    words = _words(text, r"[\s/,;:-]+")
    bare = F.transform(words, lambda w: F.replace(w, F.lit("."), F.lit("")))
    end = F.coalesce(F.get(F.filter(F.transform(bare, lambda w, i: F.when(w.isin(*ENDINGS) & (i > 0), i + 1)), lambda k: k.isNotNull()), 0), F.lit(0))
    breaks = F.transform(F.slice(words, F.lit(1), F.greatest(end - 1, F.lit(0))), lambda w, i: F.when(w.rlike("^([A-Z][A-Z&.]+|&)$") & ~w.isin(*NO_NAMES), 0).otherwise(i + 1))
    last = F.coalesce(F.array_max(breaks), F.lit(0))
    return F.when(end - last >= 2, F.array_join(F.slice(words, last + 1, end - last), " "))
