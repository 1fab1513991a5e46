"""Curated sections: columns declared by a layout, cells typed strictly, every unreadable value an error."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.amounts import amount, detect_currency, percent, quantity
from ledgerloom.functions.dates import looks_like_date, parse_date
from ledgerloom.functions.text import is_blank, strip

from .ordered import cell
from .reconcile import ERROR, check, matches


class SectionError(ValueError):
    """Rows of a section that cannot be read, with section and page."""


#: What the layout builder proposes for each section (fixed values).
HINTS = {
    "holdings": {"amount_column": "market_value", "row_start": {"kind": "numeric_in", "column": "market_value"}, "total_label_patterns": [r"^Total\s+(Holdings|Portfolio)", r"^Total\s+Market\s+Value"], "ignore_patterns": [r"^(Security|Description)\b.*\bMarket\s+Value\b", "continued"]},
    "activity": {"amount_column": "amount", "row_start": {"kind": "date"}, "total_label_patterns": [r"^Total\s+Activity", r"^Net\s+(Cash\s+)?Flows?"], "ignore_patterns": [r"^(Date|Settlement)\b.*\bAmount\b", "continued"]},
    "income": {"amount_column": "amount", "row_start": {"kind": "date"}, "total_label_patterns": [r"^Total\s+Income"], "ignore_patterns": [r"^(Date|Settlement)\b.*\bAmount\b", "continued"]},
    "fees": {"amount_column": "amount", "row_start": {"kind": "date"}, "total_label_patterns": [r"^Total\s+Fees"], "ignore_patterns": [r"^(Date|Settlement)\b.*\bAmount\b", "continued"]},
}


def typed_cell(kind: str, raw: Column, year: Column, optional: bool) -> Column:
    """STRUCT<text, num, dt, currency, err> of one cell by its declared type."""
    none, no_num, no_dt = F.lit(None).cast("string"), F.lit(None).cast("decimal(28,8)"), F.lit(None).cast("date")

    def make(text: Column = none, num: Column = no_num, dt: Column = no_dt, currency: Column = none, err: Column = none) -> Column:
        return F.struct(text.alias("text"), num.alias("num"), dt.alias("dt"), currency.alias("currency"), err.alias("err"))

    if kind == "text":
        return make(text=strip(raw))
    if kind == "currency":
        got = make(text=detect_currency(raw), currency=detect_currency(raw))
    elif kind == "date":
        got = make(dt=parse_date(raw, year), err=F.when(~is_blank(raw) & parse_date(raw, year).isNull(), F.lit("not a date")))
    elif kind in ("amount", "quantity", "percent"):
        parsed = {"amount": amount, "quantity": quantity, "percent": percent}[kind](raw)
        got = make(num=parsed["value"], currency=parsed["currency"], err=F.when(~is_blank(raw), parsed["err"]))
    else:
        raise SectionError(f"unknown column type {kind!r}")
    blank = make() if optional else make(err=F.lit("blank cell in a column that is not optional"))
    return F.when(is_blank(raw), blank).otherwise(got)


def row_start(spec: dict) -> Column:
    """Whether a line opens a record, by the layout's rule."""
    rule = spec.get("row_start") or {"kind": "date"}
    if rule["kind"] == "date":
        return F.coalesce(looks_like_date(F.get("words", F.lit(0))["text"]), F.lit(False))
    if rule["kind"] == "regex":
        return F.rlike("text", F.lit(f"(?i)^(?:{rule['pattern']})"))
    if rule["kind"] == "numeric_in":
        found = [c for c in spec["columns"] if c["name"] == rule["column"]]
        if not found:
            raise SectionError(f"row_start names no column: {rule['column']!r}")
        inside = cell(F.col("words"), F.lit(float(found[0]["x0"])), F.lit(float(found[0]["x1"])), spec.get("anchor", "center"))
        return (F.col("x0") <= found[0]["x0"]) & F.coalesce(amount(inside)["ok"], F.lit(False))
    raise SectionError(f"unknown row_start kind {rule['kind']!r}")


def _any(patterns: list[str]) -> Column:
    return F.rlike(strip(F.col("text")), F.lit("(?i)" + "|".join(f"(?:{p})" for p in patterns))) if patterns else F.lit(False)


def parse_section(name: str, lines: DataFrame, spec: dict, year: int | None = None, description: str = "description") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows (doc_id, record_no, page, cells by column name, currency, source_text), printed totals and errors of one section."""
    columns, anchor, amount_name = spec["columns"], spec.get("anchor", "center"), spec.get("amount_column")
    here = lines.filter(F.col("page").isin([int(p) for p in spec["pages"]]) & (strip(F.col("text")) != ""))
    total = _any(spec.get("total_label_patterns") or [])
    marked = here.filter(~_any(spec.get("ignore_patterns") or [])).withColumn("is_total", total)
    y = F.lit(year)
    raws = {c["name"]: cell(F.col("words"), F.lit(float(c["x0"])), F.lit(float(c["x1"])), anchor) for c in columns}

    printed = marked.filter("is_total")
    in_column = amount(raws[amount_name]) if amount_name in raws else amount(F.lit(None).cast("string"))
    tokens = F.filter(F.transform(F.reverse("words"), lambda w: amount(w["text"])), lambda a: a["ok"])
    value = F.coalesce(in_column["value"], F.get(tokens, F.lit(0))["value"])
    totals = printed.select("doc_id", F.lit(name).alias("section"), "page", "text", value.alias("value"))

    body = marked.filter(~F.col("is_total")).withColumn("_start", row_start(spec))
    order = Window.partitionBy("doc_id").orderBy("page", "top", "line_no")
    numbered = body.withColumn("record_no", F.sum(F.col("_start").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0))).filter("record_no > 0")
    cells = numbered.select("doc_id", "record_no", "page", "top", "line_no", "_start", "text", *(c.alias(f"c_{k}") for k, c in raws.items()))
    numeric = [c["name"] for c in columns if c["type"] in ("amount", "quantity", "percent")]
    filled = F.exists(F.array(*[F.col(f"c_{n}") != "" for n in numeric]), lambda x: x) if numeric else F.lit(False)
    stray = cells.filter(~F.col("_start") & filled).select("doc_id", F.lit(name).alias("section"), "page", F.lit("a continuation line holds a number").alias("err"), F.col("text").alias("raw"))
    extra = F.array_join(F.transform(F.sort_array(F.collect_list(F.when(~F.col("_start"), F.struct("page", "top", "line_no", strip(F.col(f"c_{description}") if description in raws else F.col("text")).alias("t"))))), lambda s: s["t"]), " ")
    source = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("page", "top", "line_no", "text"))), lambda s: s["text"]), " | ")
    heads = cells.groupBy("doc_id", "record_no").agg(F.min_by(F.struct("page", *(f"c_{k}" for k in raws)), F.struct("page", "top", "line_no")).alias("h"), extra.alias("extra"), source.alias("source_text"))
    typed = heads.select("doc_id", "record_no", F.col("h.page").alias("page"), "extra", "source_text", *(typed_cell(c["type"], F.col(f"h.c_{c['name']}"), y, bool(c.get("optional"))).alias(f"t_{c['name']}") for c in columns))
    faults = [F.when(F.col(f"t_{c['name']}.err").isNotNull(), F.concat(F.lit(f"{c['name']}: "), F.col(f"t_{c['name']}.err"))) for c in columns]
    if amount_name in raws:
        faults.append(F.when(F.col(f"t_{amount_name}.num").isNull() & F.col(f"t_{amount_name}.err").isNull(), F.lit("a record without an amount")))
    errors = typed.select("doc_id", F.lit(name).alias("section"), "page", F.explode(F.filter(F.array(*faults), lambda e: e.isNotNull())).alias("err"), F.col("source_text").alias("raw"))
    out = []
    for c in columns:
        at = {"text": "text", "currency": "currency", "date": "dt"}.get(c["type"], "num")
        out.append((F.concat_ws(" ", F.col(f"t_{c['name']}.text"), F.nullif("extra", F.lit(""))) if c["name"] == description else F.col(f"t_{c['name']}.{at}")).alias(c["name"]))
    declared = [F.col(f"t_{c['name']}.currency") for c in columns if c["type"] in ("currency", "amount")]
    rows = typed.select("doc_id", F.lit(name).alias("section"), "record_no", "page", *out, (F.coalesce(*declared) if declared else F.lit(None).cast("string")).alias("_currency"), "source_text")
    return rows, totals, errors.unionByName(stray)


def raise_errors(errors: DataFrame, most: int = 20) -> None:
    """Strict mode: fail with the first errors, each with section and page."""
    found = errors.orderBy("doc_id", "section", "page").limit(most).collect()
    if found:
        raise SectionError("; ".join(f"{e['doc_id']} {e['section']} p.{e['page']}: {e['err']} ({e['raw']!r})" for e in found))


def standard_checks(rows: DataFrame, totals: DataFrame, spec: dict, expected: dict | None = None) -> DataFrame:
    """Sums against the answer given and each printed total, row counts, and that there is one currency."""
    name = spec["amount_column"]
    facts = rows.groupBy("doc_id", "section").agg(F.coalesce(F.sum(name), F.lit(0)).alias("total"), F.count(F.lit(1)).alias("n"), F.collect_set("_currency").alias("currencies"))
    nothing, section = F.lit(None), F.col("section")
    parts = []
    if expected and expected.get("subtotal") is not None:
        want = F.lit(str(expected["subtotal"])).cast("decimal(28,8)")
        parts.append(facts.select(*check(F.lit("soma vs gabarito"), matches(F.col("total"), want), F.col("total"), want, nothing, F.lit(name), F.lit(ERROR), section, nothing)))
    if expected and expected.get("row_count") is not None:
        want = F.lit(int(expected["row_count"]))
        parts.append(facts.select(*check(F.lit("número de linhas"), F.col("n") == want, F.col("n"), want, nothing, F.lit(""), F.lit(ERROR), section, nothing)))
    joined = totals.join(facts, ["doc_id", "section"])
    parts.append(joined.select(*check(F.lit("soma vs total impresso"), matches(F.col("total"), F.col("value")), F.col("total"), F.col("value"), F.col("page"), F.col("text"), F.lit(ERROR), section, nothing)))
    parts.append(facts.filter(F.size("currencies") > 1).select(*check(F.lit("moeda única"), F.lit(False), F.array_join(F.array_sort("currencies"), ","), F.lit("1"), nothing, F.lit(""), F.lit(ERROR), section, nothing)))
    return reduce(DataFrame.unionByName, parts)


def internal_checks(rows: DataFrame, totals: DataFrame, spec: dict) -> DataFrame:
    """As above without answers; a section without a printed total fails."""
    facts = rows.select("doc_id", "section").distinct()
    silent = facts.join(totals.select("doc_id", "section").distinct(), ["doc_id", "section"], "left_anti")
    missing = silent.select(*check(F.lit("total impresso"), F.lit(False), F.lit(None), F.lit("—"), F.lit(None), F.lit("a secção não imprime total"), F.lit(ERROR), F.col("section"), F.lit(None)))
    return standard_checks(rows, totals, spec).unionByName(missing)


def rollforward(statement: dict) -> dict:
    """Beginning value, flows and market change against the ending value; missing parts fail."""
    from decimal import Decimal

    parts = [statement.get(k) for k in ("beginning_value", "net_flows", "market_change", "ending_value")]
    if any(p is None for p in parts):
        return {"name": "roll-forward", "passed": False, "extracted": None, "expected": None}
    got, want = sum((Decimal(str(p)) for p in parts[:3]), Decimal(0)), Decimal(str(parts[3]))
    return {"name": "roll-forward", "passed": got == want, "extracted": got, "expected": want}


def statement_checks(name: str, rows: DataFrame, spec: dict, statement: dict) -> DataFrame | None:
    """Checks against the statement's own figures: holdings against the portfolio total, activity against net flows."""
    wanted = {"holdings": statement.get("portfolio_total"), "activity": (statement.get("activity_rollforward") or {}).get("net_flows")}.get(name)
    if wanted is None or (name == "activity" and not spec.get("sum_is_net_flows", True)):
        return None
    value = F.lit(str(wanted)).cast("decimal(28,8)")
    facts = rows.groupBy("doc_id", "section").agg(F.coalesce(F.sum(spec["amount_column"]), F.lit(0)).alias("total"))
    label = {"holdings": "soma das posições vs total do portfólio", "activity": "soma dos movimentos vs fluxos líquidos"}[name]
    return facts.select(*check(F.lit(label), matches(F.col("total"), value), F.col("total"), value, F.lit(None), F.lit(""), F.lit(ERROR), F.col("section"), F.lit(None)))


def summary(rows: dict[str, DataFrame], checks: DataFrame, layout: dict) -> dict:
    """Per section: pages, rows, sum, currencies; reconciled only if there are checks and all of them passed."""
    out = {}
    for name, df in rows.items():
        spec = layout["sections"][name]
        facts = df.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(spec["amount_column"]), F.lit(0)).cast("decimal(38,2)").cast("string").alias("s"), F.array_sort(F.collect_set("_currency")).alias("c")).first()
        verdict = checks.filter(F.col("section") == name).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.min(F.col("passed")), F.lit(False)).alias("ok")).first()
        out[name] = {"pages": spec["pages"], "row_count": facts["n"], "sum": facts["s"], "currencies": facts["c"], "reconciled": bool(verdict["n"] and verdict["ok"])}
    return out
