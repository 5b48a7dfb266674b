"""References, parties, memos and identifiers as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Shortest token, shortest identifier that may anchor.
MIN_TOKEN, MIN_ANCHOR = 4, 6


def canonical(c: Column) -> Column:
    """ASCII letters and digits, upper case: references and counterparties."""
    return F.upper(F.regexp_replace(F.coalesce(c, F.lit("")), "[^A-Za-z0-9]", ""))


def canonical_unicode(c: Column) -> Column:
    return F.upper(F.regexp_replace(F.coalesce(c, F.lit("")), r"[^\p{L}\p{N}]", ""))


def memo(c: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(F.coalesce(c, F.lit("")))), r"\s+", " ")


def party(c: Column) -> Column:
    """Words of letters and digits, upper case, single-spaced."""
    return F.upper(F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), "[^A-Za-z0-9]+", " ")))


def merchant_key(c: Column) -> Column:
    return F.substring(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9_-]", ""), 1, 64)


def tokens(c: Column) -> Column:
    """Runs of letters or of digits of at least four characters, upper case, each once."""
    runs = F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit("[A-Za-z]+|[0-9]+"), F.lit(0))
    return F.array_distinct(F.filter(F.transform(runs, F.upper), lambda t: F.length(t) >= MIN_TOKEN))


def is_identifier(token: Column) -> Column:
    """A token with a digit may identify something; a word doesn't."""
    return F.coalesce(token.rlike("[0-9]"), F.lit(False))


def as_written(raw: Column, ref: Column) -> Column:
    """A reference as its source wrote it, while it still is the same reference; else empty."""
    return F.when(canonical(raw) == ref, F.coalesce(raw, F.lit(""))).otherwise("")


def date_like(token: Column) -> Column:
    """A year from 1900 to 2099, or eight digits that are a date in either order."""
    year = token.rlike("^(19|20)[0-9]{2}$")
    # most numbers have no such month or day, and a parser is dear where it fails
    month, day = "(0[1-9]|1[0-2])", "(0[1-9]|[12][0-9]|3[01])"
    year_first = token.rlike(f"^[0-9]{{4}}{month}{day}$") & F.try_to_date(token, "yyyyMMdd").isNotNull()
    day_first = token.rlike(f"^{day}{month}[0-9]{{4}}$") & F.try_to_date(token, "ddMMyyyy").isNotNull()
    return F.coalesce(year | year_first | day_first, F.lit(False))


def description_tokens(text: Column, amount_cents: Column) -> Column:
    """Digit runs of at least four in a memo, without dates and the payment's own amount."""
    runs = F.array_distinct(F.filter(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("[0-9]+"), F.lit(0)), lambda t: F.length(t) >= MIN_TOKEN))
    size = F.abs(amount_cents).cast("bigint")
    own = F.array(size.cast("string"), F.call_function("div", size, F.lit(100).cast("bigint")).cast("string"))
    return F.filter(runs, lambda t: ~date_like(t) & ~F.array_contains(own, t))


def contains_identifier(haystack: Column, needle: Column) -> Column:
    """``needle`` stands in ``haystack``, and no digit of the haystack continues a digit at either of its ends.

    The needle's characters are letters and digits, so that it can stand in a pattern as it is.
    """
    before = F.when(needle.rlike("^[0-9]"), "(?<![0-9])").otherwise("")
    after = F.when(needle.rlike("[0-9]$"), "(?![0-9])").otherwise("")
    found = F.rlike(haystack, F.concat(before, needle, after))
    return F.coalesce((F.length(needle) >= MIN_ANCHOR) & F.contains(haystack, needle) & found, F.lit(False))


def names(identifier: Column, ref: Column, text: Column) -> Column:
    """A payment names a settlement by its whole identifier, in its reference or memo."""
    needle = canonical(identifier)
    return contains_identifier(canonical(ref), needle) | contains_identifier(canonical(text), needle)


def names_by_separators(raw: Column, identifier: Column) -> Column:
    """Neighbouring pieces between separators make up the identifier."""
    pieces = F.filter(F.split(F.upper(F.coalesce(raw, F.lit(""))), "[^A-Z0-9]+"), lambda p: p != "")
    joined = F.concat(F.lit(" "), F.array_join(pieces, " "), F.lit(" "))
    spaced = F.regexp_replace(canonical(identifier), "(.)", "$1 ?")
    return F.coalesce(F.rlike(joined, F.concat(F.lit(" "), F.regexp_replace(spaced, r" \?$", ""), F.lit(" "))), F.lit(False))


def grounded(value: Column, text: Column) -> Column:
    v = canonical(value)
    return F.coalesce((v != "") & F.contains(canonical(text), v), F.lit(False))
