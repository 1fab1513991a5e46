"""Amounts, quantities and percentages as exact decimals. A parser never guesses: what it cannot read is an error.

Each parser returns STRUCT<ok, value, currency, err>; a blank is neither a value nor ok (err = 'blank').
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import is_blank, let, strip

DECIMAL = "decimal(28,8)"
#: Currency symbols and their codes, longest first (fixed values).
CURRENCY_SYMBOLS = [("US$", "USD"), ("CHF", "CHF"), ("$", "USD"), ("€", "EUR"), ("£", "GBP"), ("¥", "JPY")]
_BODY = r"^(\d{1,3}(,\d{3})*(\.\d+)?|\d+(\.\d+)?)$"
_MARKER = r"(?<=[\p{Nd})])\s*[A-Za-z]{1,2}$"
_DIGITS = r"(?:\d{1,3}(?:,\d{3}){0,5}|\d{1,18})(?:\.\d{1,8})?"
#: Amounts as nearly all statements print them, in dollars or without a currency: these are read by expressions that
#: compile; only other forms need the steps below, which are interpreted.
_USUAL = rf"(?:-?\$?{_DIGITS}|\$-{_DIGITS}|\$?\({_DIGITS}\)|\(\${_DIGITS}\))"


def strip_currency(text: Column) -> Column:
    """STRUCT<rest, currency>: one symbol or ISO code is taken from either end."""

    def cut(rest: Column, code: Column | str) -> Column:
        return F.struct(strip(rest).alias("rest"), (F.lit(code) if isinstance(code, str) else code).alias("currency"))

    def body(s: Column) -> Column:
        out = None
        for symbol, code in CURRENCY_SYMBOLS:
            n = len(symbol)
            front = F.startswith(s, F.lit(symbol))
            out = F.when(front, cut(F.substring(s, n + 1, 1 << 20), code)) if out is None else out.when(front, cut(F.substring(s, n + 1, 1 << 20), code))
            if symbol != "$":
                out = out.when(F.endswith(s, F.lit(symbol)), cut(F.substring(s, F.lit(1), F.length(s) - n), code))
        out = out.when(F.rlike(s, F.lit(r"(?s)^[A-Z]{3} .+$")), cut(F.substring(s, 4, 1 << 20), F.substring(s, 1, 3)))
        out = out.when(F.rlike(s, F.lit(r"(?s)^.+ [A-Z]{3}$")), cut(F.substring(s, F.lit(1), F.length(s) - 4), F.substring(s, -3, 3)))
        return out.otherwise(F.struct(s.alias("rest"), F.lit(None).cast("string").alias("currency")))

    return let(strip(text), body)


def _result(ok: Column, value: Column, currency: Column, err: Column) -> Column:
    return F.struct(ok.alias("ok"), value.cast(DECIMAL).alias("value"), currency.alias("currency"), err.alias("err"))


def _usual(text: Column) -> Column:
    """The amount in a stripped text of a usual form."""
    number = F.translate(text, "$,()-", "").cast(DECIMAL)
    negative = F.contains(text, F.lit("(")) | F.contains(text, F.lit("-"))
    return _result(F.lit(True), F.when(negative, F.negate(number).cast(DECIMAL)).otherwise(number), F.when(F.contains(text, F.lit("$")), "USD"), F.lit(None).cast("string"))


def amount(text: Column) -> Column:
    """Parse an amount: brackets or one minus sign mean negative, commas group by three, a currency may stand at either end."""
    s, none, no_value = strip(text), F.lit(None).cast("string"), F.lit(None).cast(DECIMAL)
    blank = _result(F.lit(False), no_value, none, F.lit("blank"))
    no_amount = _result(F.lit(False), no_value, none, F.lit("not an amount"))
    # words: neither a digit nor a sign
    return F.when(F.rlike(s, F.lit(f"^{_USUAL}$")), _usual(s)).when(is_blank(text), blank).when(~F.rlike(s, F.lit(r"[\d\-−()\[\]]")), no_amount).otherwise(_by_steps(text))


def _by_steps(text: Column) -> Column:
    """An amount of any form."""
    none, no_value = F.lit(None).cast("string"), F.lit(None).cast(DECIMAL)

    def again(state: Column) -> Column:
        """Try for a currency once more if none was found yet."""
        return F.when(state["currency"].isNotNull(), state).otherwise(
            let(strip_currency(state["rest"]), lambda c: F.struct(c["rest"].alias("rest"), c["currency"].alias("currency"), state["neg"].alias("neg"), state["bad"].alias("bad")))
        )

    def state(rest: Column, currency: Column, neg: Column, bad: Column) -> Column:
        return F.struct(rest.alias("rest"), currency.alias("currency"), neg.alias("neg"), bad.alias("bad"))

    def brackets(c: Column) -> Column:
        wrapped = F.rlike(c["rest"], F.lit(r"(?s)^(\(.*\)|\[.*\])$")) & (F.length(c["rest"]) > 1)
        inner = strip(F.substring(c["rest"], F.lit(2), F.length(c["rest"]) - 2))
        return state(F.when(wrapped, inner).otherwise(c["rest"]), c["currency"], wrapped, F.lit(False))

    def sign(s: Column) -> Column:
        r = s["rest"]
        front, back, plus = F.rlike(r, F.lit("^[-−]")), F.rlike(r, F.lit("(?s)^[^-−].*-$")), F.startswith(r, F.lit("+"))
        minus = front | back
        rest = F.when(front | plus, strip(F.substring(r, 2, 1 << 20))).when(back, strip(F.substring(r, F.lit(1), F.length(r) - 1))).otherwise(r)
        return state(rest, s["currency"], s["neg"] | minus, s["neg"] & minus)

    def value(s: Column) -> Column:
        plain = F.regexp_replace(s["rest"], ",", "")
        fits = F.rlike(plain, F.lit(r"^\d{1,20}(\.\d{1,8})?$"))
        read = F.rlike(s["rest"], F.lit(_BODY))
        number = plain.try_cast(DECIMAL)
        signed = F.when(s["neg"], F.negate(number).cast(DECIMAL)).otherwise(number)
        return (
            F.when(s["bad"], _result(F.lit(False), no_value, none, F.lit("sign given twice")))
            .when(~read, _result(F.lit(False), no_value, none, F.lit("not an amount")))
            .when(~fits, _result(F.lit(False), no_value, none, F.lit("more digits than the type holds")))
            .otherwise(_result(F.lit(True), signed, s["currency"], none))
        )

    return let(let(let(let(let(strip_currency(text), brackets), again), sign), again), value)


def quantity(text: Column) -> Column:
    """An amount without a currency."""
    return let(amount(text), lambda a: F.when(a["currency"].isNotNull(), _result(F.lit(False), F.lit(None), F.lit(None).cast("string"), F.lit("a quantity has no currency"))).otherwise(a))


def percent(text: Column) -> Column:
    """An amount before a percent sign, at its printed scale."""
    s = strip(text)
    bad = _result(F.lit(False), F.lit(None), F.lit(None).cast("string"), F.lit("no percent sign"))
    inside = F.regexp_replace(s, r"\s*%$", "")
    return F.when(is_blank(text), amount(text)).when(F.endswith(s, F.lit("%")), amount(inside)).otherwise(bad)


def marker(text: Column) -> Column:
    """STRUCT<body, marker>: one or two letters glued to the end of a number."""
    s = strip(text)
    found = F.nullif(strip(F.regexp_substr(s, F.lit(_MARKER))), F.lit(""))
    return F.struct(F.when(found.isNull(), text).otherwise(strip(F.regexp_replace(s, _MARKER, ""))).alias("body"), found.alias("marker"))


def amount_loose(text: Column) -> Column:
    """An amount, or one before a glued marker."""
    s = strip(text)
    marked = _usual(F.regexp_replace(s, r"\s*[A-Za-z]{1,2}$", ""))
    other = let(amount(text), lambda a: F.when(a["ok"] | is_blank(text), a).otherwise(let(marker(text), lambda m: F.when(m["marker"].isNotNull(), amount(m["body"])).otherwise(a))))
    usual = F.when(F.rlike(s, F.lit(f"^{_USUAL}$")), _usual(s)).when(F.rlike(s, F.lit(rf"^{_USUAL}\s*[A-Za-z]{{1,2}}$")), marked)
    return usual.when(is_blank(text) | ~F.rlike(s, F.lit(r"[\d\-−()\[\]]")), amount(text)).otherwise(other)


def looks_like_amount(text: Column) -> Column:
    return F.coalesce(amount(text)["ok"], F.lit(False))


def looks_like_amount_loose(text: Column) -> Column:
    return F.coalesce(amount_loose(text)["ok"], F.lit(False))


def is_tabular_number(text: Column) -> Column:
    """A number of a table always has punctuation; a bare integer in prose has none."""
    return F.rlike(text, F.lit(r"[.,()$]")) & looks_like_amount_loose(text)


def is_column_token(text: Column) -> Column:
    """What fills a cell of a numeric column: a number or the mark for none."""
    return is_tabular_number(text) | ((strip(text) != "") & is_blank(text))


def detect_currency(text: Column) -> Column:
    s = F.btrim(strip(text), F.lit("()"))
    exact = None
    for symbol, code in CURRENCY_SYMBOLS:
        hit = s == symbol
        exact = F.when(hit, F.lit(code)) if exact is None else exact.when(hit, F.lit(code))
    return F.when(is_blank(text), F.lit(None)).when(F.rlike(s, F.lit("^[A-Z]{3}$")), s).otherwise(F.coalesce(exact, strip_currency(s)["currency"]))


def half_even(value: Column, scale: int = 2) -> Column:
    return F.bround(value, scale)


def rounding_slack(count: Column) -> Column:
    """One cent for each printed value in a sum."""
    return (F.lit("0.01").cast("decimal(10,2)") * F.greatest(count.cast("decimal(18,0)"), F.lit(1).cast("decimal(18,0)"))).cast("decimal(28,2)")
