from datetime import date
from decimal import Decimal

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledgerloom.functions import amounts, dates, labels, text


def table(spark, values, *columns):
    df = spark.createDataFrame([(v,) for v in values], "t string")
    return df.select("t", *columns).collect()


def test_amounts(spark):
    want = {
        "(1,234.56)": "-1234.56", "$(1,234.56)": "-1234.56", "($1,234.56)": "-1234.56", "US$ 5": "5", "1,23.45": None, "(-5)": None, "5-": "-5", "+7.5": "7.5", "−3.2": "-3.2", "[12]": "-12",
        "USD 1,234.56": "1234.56", "1,234.56 EUR": "1234.56", "$5 CHF": None, "1234.123456789": None, "": None, "—": None, "--5": None, "1 000": None,
    }
    for r in table(spark, want, amounts.amount(F.col("t")).alias("a")):
        assert r["a"]["value"] == (None if want[r["t"]] is None else Decimal(want[r["t"]])), r
        assert r["a"]["ok"] == (want[r["t"]] is not None)


def test_quantity_percent_marker_and_currency(spark):
    t = F.col("t")
    got = {r["t"]: r for r in table(spark, ["$5", "5", "12.5%", "(0.25)%", "5,958.99ST", "(17.53) LT", "USD", "€", "x"], amounts.quantity(t)["ok"].alias("q"), amounts.percent(t)["value"].alias("p"), amounts.marker(t)["marker"].alias("m"), amounts.amount_loose(t)["value"].alias("l"), amounts.detect_currency(t).alias("c"))}
    assert not got["$5"]["q"] and got["5"]["q"]
    assert got["12.5%"]["p"] == Decimal("12.5") and got["(0.25)%"]["p"] == Decimal("-0.25") and got["5"]["p"] is None
    assert got["5,958.99ST"]["m"] == "ST" and got["(17.53) LT"]["l"] == Decimal("-17.53")
    assert got["USD"]["c"] == "USD" and got["€"]["c"] == "EUR" and got["x"]["c"] is None


def test_dates(spark):
    t = F.col("t")
    want = {"1/2/2024": date(2024, 1, 2), "12/8/68": date(2068, 12, 8), "12/8/69": date(1969, 12, 8), "12-8-2024": date(2024, 12, 8), "Jan 5, 2024": date(2024, 1, 5), "january 5, 2024": date(2024, 1, 5), "5-jan-2024": date(2024, 1, 5), "2024-02-30": None, "12/8": date(2016, 12, 8), "13/1/2024": None}
    for r in table(spark, want, dates.parse_date(t, F.lit(2016)).alias("d")):
        assert r["d"] == want[r["t"]], r
    split = {r["t"]: (r["s"]["rest"], r["s"]["dates"]) for r in table(spark, ["12/21/16 12/30/16", "12/1/16 foo bar 1/2/17", "foo", ""], dates.split_dates(t).alias("s"))}
    assert split == {"12/21/16 12/30/16": ("", ["12/21/16", "12/30/16"]), "12/1/16 foo bar 1/2/17": ("foo bar", ["12/1/16", "1/2/17"]), "foo": ("foo", []), "": ("", [])}


@pytest.mark.parametrize(("label", "kind"), [("Total Holdings", "total"), ("Total purchases vs x", "info"), ("purchases", "subtotal"), ("Purchases of x", "data"), ("NET CREDITS/(DEBITS)", "total"), ("", "data"), ("Long-term year to date", "info")])
def test_row_labels(spark, label, kind):
    assert table(spark, [label], labels.classify_row(F.col("t")).alias("k"))[0]["k"] == kind


def test_titles_and_names(spark):
    t = F.col("t")
    got = {r["t"]: r for r in table(spark, ["COMMON STOCKS", "OVERVIEW OF YOUR ACCOUNTS", "PURCHASES/SALES", "Variável (AAPL) "], labels.classify_domain(t).alias("d"), labels.label_matches_title(F.lit("Stocks"), t).alias("s"), labels.label_matches_title(F.lit("Accounts"), t).alias("a"), text.title_case(t).alias("c"), text.symbol_of(t).alias("y"), text.asset_id(F.lit(None).cast("string"), t, t).alias("i"))}
    assert got["COMMON STOCKS"]["d"] == "posicoes" and got["COMMON STOCKS"]["s"]
    assert not got["OVERVIEW OF YOUR ACCOUNTS"]["a"]
    assert got["PURCHASES/SALES"]["c"] == "Purchases/Sales"
    assert got["Variável (AAPL) "]["y"] == "AAPL" and got["Variável (AAPL) "]["i"] == "VARI_VEL_AAPL"


@settings(max_examples=5, deadline=None)
@given(st.lists(st.integers(-(10**12), 10**12), min_size=1, max_size=20))
def test_printed_amounts_come_back(spark, cents):
    shown = [(f"(${abs(c) / 100:,.2f})" if c < 0 else f"${c / 100:,.2f}", c) for c in cents]
    df = spark.createDataFrame(shown, "t string, c bigint")
    assert df.filter(F.coalesce((amounts.amount(F.col("t"))["value"] * 100).cast("bigint") != F.col("c"), F.lit(True))).count() == 0
