"""Text expressions. Every function takes and returns Columns; nothing here runs Python on the executors."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space of any script (fixed values: the characters of that Unicode property).
WHITE_SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` where ``value`` is computed once, however often ``body`` refers to it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(text: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.btrim(text, F.lit(WHITE_SPACE))


#: Cells that stand for "no value" (fixed values).
BLANK_TOKENS = ["", "-", "--", "---", "—", "–", "n/a", "na", "n.a.", "none"]


def is_blank(text: Column) -> Column:
    return text.isNull() | F.lower(strip(text)).isin(BLANK_TOKENS)


def slug(text: Column) -> Column:
    """Lower-case ASCII letters and digits, everything else one underscore; never empty."""
    low = F.regexp_replace(F.lower(strip(text)), "[^a-z0-9]+", "_")
    return F.coalesce(F.nullif(F.btrim(low, F.lit("_")), F.lit("")), F.lit("col"))


def mask_digits(text: Column) -> Column:
    """Every decimal digit of any script becomes #."""
    return F.regexp_replace(text, r"\p{Nd}", "#")


def fingerprint(text: Column) -> Column:
    """What a repeated header or footer has in common from page to page."""
    return mask_digits(F.lower(strip(text)))


_SYMBOL = r"\(([A-Z0-9./]{1,8})\)\s*$"


def symbol_of(text: Column) -> Column:
    """The ticker in brackets at the end, or null."""
    return F.nullif(F.regexp_extract(text, _SYMBOL, 1), F.lit(""))


def without_symbol(text: Column) -> Column:
    return strip(F.regexp_replace(text, _SYMBOL, ""))


def asset_id(symbol: Column, title: Column, description: Column) -> Column:
    """Stable identifier: the ticker, else a slug of the title or description (60 characters), else a fixed word."""
    name = F.coalesce(F.nullif(strip(title), F.lit("")), description, F.lit(""))
    made = F.substring(F.btrim(F.regexp_replace(F.upper(name), "[^A-Z0-9]+", "_"), F.lit("_")), 1, 60)
    return F.coalesce(F.upper(F.nullif(strip(symbol), F.lit(""))), F.nullif(made, F.lit("")), F.lit("SEM_IDENTIFICACAO"))


def item_id(given: Column, description: Column) -> Column:
    """Identifier of a fund's holding: the one given, else an untrimmed slug of its description."""
    return F.coalesce(F.nullif(given, F.lit("")), F.substring(F.regexp_replace(F.upper(description), "[^A-Z0-9]+", "_"), 1, 60))


def title_case(text: Column) -> Column:
    """Each run of letters capitalised."""
    pieces = F.regexp_extract_all(F.lower(text), F.lit(r"(\p{L}+|[^\p{L}]+)"), F.lit(1))
    return F.array_join(F.transform(pieces, lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.substring(p, 2, 1 << 20))), "")


#: Account numbers, as printed in page headers.
ACCOUNT_NUMBER = r"\b\d{3}-\d{6}-\d{3}\b"
_CAPS_RUN = r"\b[A-Z][A-Z&.'-]{2,}(?:\s+[A-Z][A-Z&.'-]{2,})+"


def account_number(text: Column) -> Column:
    return F.nullif(F.regexp_extract(text, f"({ACCOUNT_NUMBER})", 1), F.lit(""))


def account_label(text: Column) -> Column:
    """What a header line says of its account besides the number, or null when three characters or fewer are left."""
    rest = F.regexp_replace(text, ACCOUNT_NUMBER, "")
    cut = F.regexp_replace(rest, f"{_CAPS_RUN}.*$", "")
    plain = strip(F.regexp_replace(strip(cut), r"(?i)\b(Account\s+)?(Detail|Summary)\b", ""))
    return F.when(F.length(plain) > 3, plain)
