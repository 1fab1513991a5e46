"""Dates as printed in statements: a known format or an error, never a guess."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import is_blank, let, strip

#: What begins a record: also forms that need more context to be parsed.
DATE_PATTERN = r"^(\d{1,2}[/-]\d{1,2}([/-]\d{2,4})?|[A-Za-z]{3,9} \d{1,2}, \d{4}|\d{1,2}-[A-Za-z]{3}-\d{4}|\d{4}-\d{2}-\d{2})$"
_MONTHS = ["january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december"]


def looks_like_date(text: Column) -> Column:
    return F.rlike(text, F.lit(DATE_PATTERN))


def _month_number(name: Column, short: bool) -> Column:
    table = F.create_map(*[F.lit(x) for i, m in enumerate(_MONTHS) for x in (m[:3] if short else m, str(i + 1))])
    return F.try_element_at(table, F.lower(name))


def _ymd(y: Column, m: Column, d: Column) -> Column:
    return F.concat_ws("-", F.lpad(y, 4, "0"), F.lpad(m, 2, "0"), F.lpad(d, 2, "0")).try_cast("date")


def parse_date(text: Column, year: Column | None = None) -> Column:
    """DATE or null; ``month/day`` alone needs ``year``. Two-digit years from 69 on are of the last century."""

    def body(s: Column) -> Column:
        def part(pattern: str, i: int) -> Column:
            return F.regexp_extract(s, pattern, i)

        short, long, brief, dashed = r"^(\d{1,2})/(\d{1,2})$", r"^(\d{1,2})/(\d{1,2})/(\d{4})$", r"^(\d{1,2})/(\d{1,2})/(\d{2})$", r"^(\d{1,2})-(\d{1,2})-(\d{4})$"
        word, day_first, iso = r"^([A-Za-z]{3,9}) (\d{1,2}), (\d{4})$", r"^(\d{1,2})-([A-Za-z]{3})-(\d{4})$", r"^(\d{4})-(\d{2})-(\d{2})$"
        two = part(brief, 3)
        century = F.when(two >= "69", F.lit("19")).otherwise(F.lit("20"))
        named = F.coalesce(_month_number(part(word, 1), True), _month_number(part(word, 1), False))
        given = year.cast("string") if year is not None else F.lit(None).cast("string")
        return (
            F.when(F.rlike(s, F.lit(short)), F.when(given.isNotNull(), _ymd(given, part(short, 1), part(short, 2))))
            .when(F.rlike(s, F.lit(long)), _ymd(part(long, 3), part(long, 1), part(long, 2)))
            .when(F.rlike(s, F.lit(brief)), _ymd(F.concat(century, two), part(brief, 1), part(brief, 2)))
            .when(F.rlike(s, F.lit(dashed)), _ymd(part(dashed, 3), part(dashed, 1), part(dashed, 2)))
            .when(F.rlike(s, F.lit(word)), F.when(named.isNotNull(), _ymd(part(word, 3), named, part(word, 2))))
            .when(F.rlike(s, F.lit(day_first)), F.when(_month_number(part(day_first, 2), True).isNotNull(), _ymd(part(day_first, 3), _month_number(part(day_first, 2), True), part(day_first, 1))))
            .when(F.rlike(s, F.lit(iso)), _ymd(part(iso, 1), part(iso, 2), part(iso, 3)))
        )

    s = strip(text)
    return F.when(F.rlike(s, F.lit(r"\d")), body(s))


def split_dates(text: Column) -> Column:
    """STRUCT<rest, dates>: date tokens taken from the front, and from the back while another word is left."""

    def tokens(words: Column) -> Column:
        first_other = F.array_position(F.transform(words, lambda w: looks_like_date(w)), False)
        lead = F.when(first_other == 0, F.size(words)).otherwise(first_other.cast("int") - 1)
        return let(lead, lambda n: trailing(words, n))

    def trailing(words: Column, n: Column) -> Column:
        rest = F.slice(words, n + 1, F.greatest(F.size(words) - n, F.lit(0)))
        back = F.array_position(F.reverse(F.transform(rest, lambda w: looks_like_date(w))), False)
        count = F.when(F.size(rest) == 0, F.lit(0)).otherwise(F.least(F.when(back == 0, F.size(rest)).otherwise(back.cast("int") - 1), F.size(rest) - 1))
        keep = F.size(rest) - count
        return F.struct(F.array_join(F.slice(rest, F.lit(1), keep), " ").alias("rest"), F.concat(F.slice(words, F.lit(1), n), F.slice(rest, keep + 1, count)).alias("dates"))

    return let(F.filter(F.split(strip(text), r"(?U)\s+"), lambda w: w != ""), tokens)


PERIOD = r"(?i)(January|February|March|April|May|June|July|August|September|October|November|December)\s+(\d{1,2})\s*[-–]\s*(\d{1,2}),\s*(\d{4})"
YEAR = r"\b((?:19|20)\d{2})\b"


def period(text: Column) -> Column:
    """STRUCT<year, start, end> of ``Month d1-d2, yyyy``; start is null when the text has none."""
    m, y = _month_number(F.regexp_extract(text, PERIOD, 1), False), F.nullif(F.regexp_extract(text, PERIOD, 4), F.lit(""))
    return F.struct(y.cast("int").alias("year"), _ymd(y, m, F.regexp_extract(text, PERIOD, 2)).alias("start"), _ymd(y, m, F.regexp_extract(text, PERIOD, 3)).alias("end"))


def period_hint(start: Column) -> Column:
    """How column headers abbreviate the period's first day: 6_1_26."""
    return F.concat_ws("_", F.month(start).cast("string"), F.dayofmonth(start).cast("string"), F.substring(F.year(start).cast("string"), 3, 2))
