"""Queries of the statement operators over the star-schema tables, and the DuckDB SQL that each must equal.

The tables are no statements, so each query renders what its operator needs (amounts, labels, groups) from
whole tables and sends it through the operator itself.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.functions import amounts, dates, labels, text
from ledgerloom.operators import canonical, export, layout, ordered, reconcile, sections
from ledgerloom.operators.tables import cell_value
from ledgerloom.plans.sweep import detect
from ledgerloom.sources import sinks
from ledgerloom.sources.words import text_layer

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _cents(c) -> F.Column:
    """A double of two decimals as a whole number of cents."""
    return F.round(F.col(c) * 100, 0).cast("bigint")


def _money(cents) -> F.Column:
    return (cents.cast("decimal(20,0)") / F.lit(100).cast("decimal(3,0)")).cast("decimal(28,2)")


def _floor(c) -> F.Column:
    """Floor of a double as a double: Spark's is a bigint, which has neither NaN nor infinity and ends at 2^63."""
    return F.when(F.abs(c) < 2.0**52, F.floor(c).cast("double")).otherwise(F.col(c))


def _printed(cents) -> F.Column:
    """$1,234.56, or ($1,234.56) if negative."""
    whole = F.format_number(F.abs(cents).cast("decimal(20,0)") / F.lit(100).cast("decimal(3,0)"), 2)
    return F.when(cents < 0, F.concat(F.lit("($"), whole, F.lit(")"))).otherwise(F.concat(F.lit("$"), whole))


@query("""
WITH t AS (SELECT l_returnflag, CASE WHEN l_returnflag = 'R' THEN -1 ELSE 1 END * round(l_extendedprice * 100)::BIGINT AS cents, l_partkey % 10 = 0 AS broken, CASE WHEN l_linenumber % 2 = 0 THEN 'USD' END AS currency FROM lineitem)
SELECT l_returnflag, CASE WHEN NOT broken THEN currency END AS currency, count(*)::BIGINT AS n, (sum(cents) FILTER (NOT broken))::BIGINT AS total_cents, count(*) FILTER (broken)::BIGINT AS errors FROM t GROUP BY ALL""")
def amount_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """Amounts with and without a dollar sign, some of them with a second decimal point."""
    cents = F.when(F.col("l_returnflag") == "R", -_cents("l_extendedprice")).otherwise(_cents("l_extendedprice"))
    shown = _printed(cents)
    shown = F.when(F.col("l_linenumber") % 2 == 0, shown).otherwise(F.translate(shown, "$", ""))
    raw = F.when(F.col("l_partkey") % 10 == 0, F.concat(shown, F.lit(".1"))).otherwise(shown)
    printed = _t(spark, sf, "lineitem").select("l_returnflag", raw.alias("raw"))
    parsed = printed.select("l_returnflag", amounts.amount(F.col("raw")).alias("a"))
    return parsed.groupBy("l_returnflag", "a.currency").agg(F.count(F.lit(1)).alias("n"), F.sum(F.round(F.col("a.value") * 100).cast("bigint")).alias("total_cents"), F.count_if(~F.col("a.ok")).alias("errors"))


LITERALS = ["(1,234.56)", "$(1,234.56)", "($1,234.56)", "US$ 5", "1,23.45", "1,234", "-5", "(-5)", "5-", "+7.5", "USD 1,234.56", "1,234.56 EUR", "€5", "5€", "", "—", "N/A", "[12]", "$", "abc", "12/8", "1 000", "--5", "1,234,567.891", "1.2.3", "12,34", "(12", "5 CHF"]
_LITERAL_ROWS = ", ".join(f"({i}, '{x}')" for i, x in enumerate(LITERALS))


@query(f"""
WITH lit(i, raw) AS (VALUES {_LITERAL_ROWS}),
plain AS (SELECT i, raw, regexp_replace(regexp_replace(raw, '^(US\\$|\\$|€|[A-Z]{{3}} )\\s*', ''), '\\s*(€| [A-Z]{{3}})$', '') AS a FROM lit),
inner_ AS (SELECT i, raw, CASE WHEN regexp_full_match(a, '\\(.*\\)|\\[.*\\]') THEN regexp_replace(substr(a, 2, length(a) - 2), '^(US\\$|\\$|€)', '') ELSE a END AS b, regexp_full_match(a, '\\(.*\\)|\\[.*\\]') AS neg FROM plain),
signed AS (SELECT i, raw, CASE WHEN b LIKE '-%' THEN substr(b, 2) WHEN b LIKE '%-' THEN left(b, length(b) - 1) WHEN b LIKE '+%' THEN substr(b, 2) ELSE b END AS c, neg AND (b LIKE '-%' OR b LIKE '%-') AS bad FROM inner_)
SELECT i AS seq, raw, raw NOT IN ('', '—', 'N/A') AND NOT bad AND regexp_full_match(c, '[0-9]{{1,3}}(,[0-9]{{3}})*(\\.[0-9]+)?|[0-9]+(\\.[0-9]+)?') AS ok, count(*)::BIGINT AS n FROM signed JOIN lineitem ON l_orderkey % {len(LITERALS)} = i GROUP BY ALL""")
def amount_reject(spark: SparkSession, sf: str) -> DataFrame:
    seq = (F.col("l_orderkey") % len(LITERALS)).cast("int")
    printed = _t(spark, sf, "lineitem").select(seq.alias("seq"), F.get(F.array(*[F.lit(x) for x in LITERALS]), seq).alias("raw"))
    return printed.withColumn("ok", amounts.looks_like_amount(F.col("raw"))).groupBy("seq", "raw", "ok").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_linenumber % 3 = 2 THEN NULL ELSE ['ST', 'LT'][l_linenumber % 3 + 1] END AS marker, round(l_extendedprice * 100)::BIGINT AS cents FROM lineitem""")
def marker_split(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("l_linenumber") % 3
    raw = F.concat(_printed(_cents("l_extendedprice")), F.when(k == 0, "ST").when(k == 1, "LT").otherwise(""))
    printed = _t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", raw.alias("raw"))
    return printed.select("l_orderkey", "l_linenumber", "l_partkey", amounts.marker(F.col("raw"))["marker"].alias("marker"), F.round(amounts.amount_loose(F.col("raw"))["value"] * 100).cast("bigint").alias("cents"))


@query("""SELECT l_linenumber, l_shipdate::DATE AS parsed, count(*)::BIGINT AS n FROM lineitem GROUP BY ALL""")
def date_parse_formats(spark: SparkSession, sf: str) -> DataFrame:
    d = F.col("l_shipdate").cast("date")
    forms = ["M/d/yyyy", "M/d/yy", "M-d-yyyy", "MMM d, yyyy", "MMMM d, yyyy", "d-MMM-yyyy", "yyyy-MM-dd"]
    raw = None
    for i, f in enumerate(forms):
        shown = F.date_format(d, f)
        raw = F.when(F.col("l_linenumber") % 7 == i, shown) if raw is None else raw.when(F.col("l_linenumber") % 7 == i, shown)
    printed = _t(spark, sf, "lineitem").select("l_linenumber", raw.alias("raw"))
    return printed.select("l_linenumber", dates.parse_date(F.col("raw")).alias("parsed")).groupBy("l_linenumber", "parsed").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT event_type, count(*)::BIGINT AS n, count(*) FILTER (event_id % 4 < 2)::BIGINT AS blanks FROM events GROUP BY event_type""")
def blank_tokens(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("event_id") % 4
    cell = F.when(k == 0, "\t— ").when(k == 1, " N/A").when(k == 2, "0").otherwise(F.col("event_type"))
    return _t(spark, sf, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count_if(text.is_blank(cell)).alias("blanks"))


@query("""SELECT p_partkey, coalesce(nullif(trim(regexp_replace(lower(trim(p_type)), '[^a-z0-9]+', '_', 'g'), '_'), ''), 'col') AS slug FROM part""")
def slug(spark: SparkSession, sf: str) -> DataFrame:
    return _t(spark, sf, "part").select("p_partkey", text.slug(F.col("p_type")).alias("slug"))


@query("""SELECT user_id, regexp_replace(props, '[0-9]', '#', 'g') AS masked, count(*)::BIGINT AS n FROM events GROUP BY ALL""")
def digit_mask(spark: SparkSession, sf: str) -> DataFrame:
    return _t(spark, sf, "events").select("user_id", text.mask_digits(F.col("props")).alias("masked")).groupBy("user_id", "masked").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT p_partkey, upper(replace(p_brand, '#', '.')) AS symbol, trim(p_name) AS plain FROM part""")
def symbol_split(spark: SparkSession, sf: str) -> DataFrame:
    label = F.concat(F.col("p_name"), F.lit(" ("), F.substring(F.upper(F.regexp_replace("p_brand", "#", ".")), 1, 8), F.lit(") "))
    return _t(spark, sf, "part").select("p_partkey", text.symbol_of(label).alias("symbol"), text.without_symbol(label).alias("plain"))


_KINDS = ["Dividend Reinvestment", "dividend", "INTEREST", "Sold", "Long Term Capital Gain", "Wire", "Fee", "Cash Transfer"]
_KIND_SQL = "[" + ", ".join(f"'{k}'" for k in _KINDS) + "][(event_id % 8 + 1)::INT]"


@query(f"""
WITH k AS (SELECT *, {_KIND_SQL} AS k FROM events), t AS (SELECT event_id, CASE lower(k) WHEN 'dividend' THEN 'Dividend' WHEN 'interest' THEN 'Interest' WHEN 'wire' THEN NULL ELSE k END AS kind, event_type, k FROM k)
SELECT event_id, kind, CASE WHEN kind IS NULL THEN k || ' ' || event_type ELSE event_type END AS rest,
  coalesce(kind IN ('Dividend', 'Interest', 'Long Term Capital Gain'), false) AS income,
  CASE kind WHEN 'Dividend Reinvestment' THEN 'A' WHEN 'Dividend' THEN 'DIV' WHEN 'Interest' THEN 'JUROS' WHEN 'Sold' THEN 'RP' WHEN 'Long Term Capital Gain' THEN 'DIV' WHEN 'Fee' THEN 'TX' WHEN 'Cash Transfer' THEN 'TRF' ELSE 'OUTROS' END AS code FROM t""")
def activity_type(spark: SparkSession, sf: str) -> DataFrame:
    k = F.get(F.array(*[F.lit(x) for x in _KINDS]), (F.col("event_id") % 8).cast("int"))
    described = F.concat(k, F.lit(" "), F.col("event_type"))
    kind = labels.activity_type(described)
    return _t(spark, sf, "events").select("event_id", kind.alias("kind"), labels.without_activity(described).alias("rest"), labels.is_income(kind).alias("income"), labels.movement_code(kind).alias("code"))


_TITLES = ["COMMON STOCKS", "REALIZED GAIN/(LOSS) DETAIL", "SECURITY TRANSFERS", "CASH FLOW ACTIVITY BY DATE", "ASSET ALLOCATION", "ACCOUNT SUMMARY", "MUTUAL FUNDS", "NOTES"]
_TITLE_SQL = "[" + ", ".join(f"'{t}'" for t in _TITLES) + "][(o_orderkey % 8 + 1)::INT]"


@query(f"""
WITH t AS (SELECT {_TITLE_SQL} AS title, o_totalprice FROM orders)
SELECT title, CASE WHEN title LIKE '%GAIN/%' THEN 'mais_valias' WHEN title LIKE '%TRANSFER%' THEN 'transferencias' WHEN title LIKE '%ACTIVITY%' THEN 'movimentos' WHEN title LIKE '%ALLOCATION%' THEN 'alocacao' WHEN title LIKE '%SUMMARY%' THEN 'sumario' WHEN title LIKE '%STOCKS%' OR title LIKE '%FUNDS%' THEN 'posicoes' ELSE 'outras' END AS domain,
  count(*)::BIGINT AS n FROM t GROUP BY title""")
def classify_domain(spark: SparkSession, sf: str) -> DataFrame:
    title = F.get(F.array(*[F.lit(x) for x in _TITLES]), (F.col("o_orderkey") % 8).cast("int"))
    return _t(spark, sf, "orders").select(title.alias("title")).withColumn("domain", labels.classify_domain(F.col("title"))).groupBy("title", "domain").agg(F.count(F.lit(1)).alias("n"))


_ROW_LABELS = ["Total Holdings", "total purchases vs x", "Purchases", "Purchases of funds", "Net credits/(debits)", "Long-term year to date", "Short term this period", "Subtotal A", "", "Asset class: equities"]
_ROW_TYPES = ["total", "info", "subtotal", "data", "total", "info", "total", "subtotal", "data", "info"]


@query(f"""WITH t AS (SELECT (l_orderkey % 10)::INT AS k FROM lineitem) SELECT [{", ".join(repr(x) for x in _ROW_LABELS)}][k + 1] AS label, [{", ".join(repr(x) for x in _ROW_TYPES)}][k + 1] AS row_type, count(*)::BIGINT AS n FROM t GROUP BY k""")
def classify_row(spark: SparkSession, sf: str) -> DataFrame:
    label = F.get(F.array(*[F.lit(x) for x in _ROW_LABELS]), (F.col("l_orderkey") % 10).cast("int"))
    return _t(spark, sf, "lineitem").select(label.alias("label")).withColumn("row_type", labels.classify_row(F.col("label"))).groupBy("label", "row_type").agg(F.count(F.lit(1)).alias("n"))


@query("""
WITH RECURSIVE o AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY value, event_id) AS i FROM events WHERE value IS NOT NULL),
g AS (SELECT user_id, i, value, value AS anchor, 0 AS g FROM o WHERE i = 1
  UNION ALL SELECT o.user_id, o.i, o.value, CASE WHEN o.value - g.anchor <= 2.5 THEN g.anchor ELSE o.value END, CASE WHEN o.value - g.anchor <= 2.5 THEN g.g ELSE g.g + 1 END FROM g JOIN o ON o.user_id = g.user_id AND o.i = g.i + 1)
SELECT user_id, g::INT AS line_no, min(value) AS low, count(*)::BIGINT AS n FROM g GROUP BY user_id, g""")
def line_grouping_anchored(spark: SparkSession, sf: str) -> DataFrame:
    items = _t(spark, sf, "events").filter("value is not null").groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("value", "event_id"))).alias("items"))
    return items.select("user_id", F.posexplode(ordered.anchored_groups(F.col("items"), "value", 2.5)).alias("line_no", "g")).select("user_id", "line_no", F.col("g.low").alias("low"), F.size("g.items").cast("bigint").alias("n"))


@query("""
WITH t AS (SELECT user_id, floor(value) AS x1, floor(value) - 5 AS x0 FROM events WHERE value IS NOT NULL),
f AS (SELECT *, coalesce(x1 - lag(x1) OVER (PARTITION BY user_id ORDER BY x1, x0) > 8, false)::INT AS brk FROM t),
c AS (SELECT *, sum(brk) OVER (PARTITION BY user_id ORDER BY x1, x0 ROWS UNBOUNDED PRECEDING) AS c FROM f),
b AS (SELECT user_id, c, min(x0) - 3 AS a, max(x1) + 3 AS b, count(*)::BIGINT AS n FROM c GROUP BY user_id, c HAVING count(*) >= 2),
w AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY a, b) - 1 AS band, lag(b) OVER (PARTITION BY user_id ORDER BY a, b) AS pb, lead(a) OVER (PARTITION BY user_id ORDER BY a, b) AS na FROM b)
SELECT user_id, band::INT AS band, round(coalesce((pb + a) / 2, a), 1) AS x0, round(coalesce((b + na) / 2, b), 1) AS x1, n FROM w""")
def column_clusters(spark: SparkSession, sf: str) -> DataFrame:
    tokens = _t(spark, sf, "events").filter("value is not null").select("user_id", (_floor("value") - F.lit(5.0)).alias("x0"), _floor("value").alias("x1"))
    return ordered.column_bands(tokens, ["user_id"]).select("user_id", "band", F.round("x0", 1).alias("x0"), F.round("x1", 1).alias("x1"), "n")


@query("""
WITH r AS (SELECT conv_id, turn, role, sum((role = 'user')::INT) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING)::BIGINT AS record_no FROM conversations)
SELECT conv_id, record_no, count(*)::BIGINT AS lines, string_agg(role, '|' ORDER BY turn) AS roles FROM r GROUP BY ALL""")
def record_grouping(spark: SparkSession, sf: str) -> DataFrame:
    rows = ordered.records(_t(spark, sf, "conversations").select("conv_id", "turn", "role"), F.col("role") == "user", ["conv_id"], ["turn"])
    roles = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", "role"))), lambda s: s["role"]), "|")
    return rows.groupBy("conv_id", "record_no").agg(F.count(F.lit(1)).alias("lines"), roles.alias("roles"))


@query("""SELECT event_id, last_value(CASE WHEN event_type = 'signup' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS opened_by FROM events""")
def group_forward_fill(spark: SparkSession, sf: str) -> DataFrame:
    opened = F.when(F.col("event_type") == "signup", F.col("event_id"))
    return _t(spark, sf, "events").select("event_id", ordered.forward_fill(opened, ["user_id"], ["ts", "event_id"]).alias("opened_by"))


_LINE_FLAGS = "length(line) % 2 = 0 AS numeric, length(line) % 7 = 3 AS heading, length(line) > 400 AS prose"


@query(f"""
WITH s AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i, unnest(string_split(text, chr(10))) AS line FROM documents),
f AS (SELECT doc_id, i, {_LINE_FLAGS} FROM s),
c AS (SELECT *, sum(((heading OR prose) AND NOT numeric)::INT) OVER (PARTITION BY doc_id ORDER BY i) AS stops, last_value(CASE WHEN numeric THEN i END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM f),
p AS (SELECT c.*, q.stops AS pstops FROM c LEFT JOIN c q ON q.doc_id = c.doc_id AND q.i = c.prev),
b AS (SELECT *, sum((numeric AND (prev IS NULL OR stops > pstops OR i - prev > 3))::INT) OVER (PARTITION BY doc_id ORDER BY i) AS block FROM p),
n AS (SELECT *, first_value(CASE WHEN numeric THEN block END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS nb FROM b)
SELECT doc_id, block::BIGINT AS block, count(*)::BIGINT AS lines, count(*) FILTER (numeric)::BIGINT AS numeric_lines FROM n WHERE numeric OR (block > 0 AND nb = block) GROUP BY doc_id, block""")
def block_split(spark: SparkSession, sf: str) -> DataFrame:
    lines = _t(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line"))
    n = F.length("line")
    flagged = lines.select("doc_id", "i", (n % 2 == 0).alias("numeric"), (n % 7 == 3).alias("heading"), (n > 400).alias("prose"))
    flagged = flagged.withColumn("heading", F.col("heading") & ~F.col("numeric"))
    found = ordered.blocks(flagged, ["doc_id"], "i").filter("member")
    return found.groupBy("doc_id", "block").agg(F.count(F.lit(1)).alias("lines"), F.count_if("numeric").alias("numeric_lines"))


@query("""
WITH h AS (SELECT user_id, event_id, CASE WHEN user_id % 3 = 0 THEN 'head ' || event_type ELSE 'head of #' END AS head FROM events),
p AS (SELECT user_id, count(*) AS pages FROM events GROUP BY user_id),
r AS (SELECT user_id, max(n) AS most FROM (SELECT user_id, head, count(*) AS n FROM h GROUP BY ALL) GROUP BY user_id)
SELECT user_id::VARCHAR AS doc_id, CASE WHEN most >= greatest(2, round_even(pages * 0.8, 0)) THEN 7.0::DOUBLE END AS band_top, CASE WHEN pages >= 2 THEN 94.0::DOUBLE END AS band_bottom FROM p JOIN r USING (user_id)""")
def repeated_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Users as documents, events as pages: a header that may repeat, a body line, and a numbered footer."""
    head = F.when(F.col("user_id") % 3 == 0, F.concat(F.lit("Head "), "event_type")).otherwise(F.concat(F.lit(" head of "), (F.col("event_id") % 10).cast("string")))
    printed = F.array(*[F.struct(F.lit(i).alias("line_no"), F.lit(top).alias("top"), F.lit(top + 4.0).alias("bottom"), text_.alias("text")) for i, (top, text_) in enumerate([(2.0, head), (50.0, F.col("event_type")), (95.0, F.concat(F.lit("Page "), F.lpad((F.col("event_id") % 1000).cast("string"), 3, "0")))])])
    pages = _t(spark, sf, "events").select(F.col("user_id").cast("string").alias("doc_id"), F.col("event_id").alias("page"), F.lit(100.0).alias("height"), F.explode(printed).alias("l"))
    return layout.body_band(pages.select("doc_id", "page", "l.*"), pages.select("doc_id", "page", "height").distinct())


@query("""SELECT source AS doc_id, count(*)::BIGINT AS page_count, count(*) FILTER (length(text) > 0)::BIGINT AS pages_with_text, sum(length(regexp_replace(text, '^\\s+|\\s+$', '', 'g')))::BIGINT AS chars_total, count(*) FILTER (length(text) > 0) / count(*) AS ratio FROM documents GROUP BY source""")
def text_layer_ratio(spark: SparkSession, sf: str) -> DataFrame:
    return text_layer(_t(spark, sf, "documents").select(F.col("source").alias("doc_id"), F.col("doc_id").alias("page"), "text"))


_LOTS_SQL = """
WITH lots AS (SELECT l_orderkey, count(*)::BIGINT AS lots, sum(round(l_extendedprice * 100)::BIGINT)::BIGINT AS cents FROM lineitem GROUP BY l_orderkey),
p AS (SELECT *, cents + CASE l_orderkey % 5 WHEN 0 THEN 1 WHEN 1 THEN 100 ELSE 0 END AS printed FROM lots)
SELECT l_orderkey, lots, cents AS extracted_cents, printed AS printed_cents, cents = printed AS passed, CASE WHEN abs(cents - printed) <= greatest(lots, 1) THEN 'aviso' ELSE 'erro' END AS severity FROM p"""


@query(_LOTS_SQL)
def lot_reconciliation(spark: SparkSession, sf: str) -> DataFrame:
    """Lots of an order against a printed total that is right, a cent off or a unit off."""
    lots = _t(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("lots"), F.sum(_cents("l_extendedprice")).alias("cents"))
    off = F.when(F.col("l_orderkey") % 5 == 0, 1).when(F.col("l_orderkey") % 5 == 1, 100).otherwise(0)
    got = lots.withColumn("printed", F.col("cents") + off)
    a, b = _money(F.col("cents")), _money(F.col("printed"))
    within = reconcile.matches(a, b, amounts.rounding_slack(F.col("lots")))
    return got.select("l_orderkey", "lots", F.col("cents").alias("extracted_cents"), F.col("printed").alias("printed_cents"), reconcile.matches(a, b).alias("passed"), F.when(within, reconcile.NOTICE).otherwise(reconcile.ERROR).alias("severity"))


def _cells(values: dict) -> F.Column:
    """Cells of a row from whole cents by column name."""
    return F.array(*[F.struct(F.lit(n).alias("name"), F.lit(i).alias("pos"), F.struct(F.lit("").alias("raw"), _money(v).cast("decimal(28,8)").alias("num"), F.lit(None).cast("date").alias("dt"), F.lit("amount").alias("kind")).alias("v")) for i, (n, v) in enumerate(values.items())])


def _statement_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as tables of one group: line items as data, and every second order closes with a bare total."""
    items = _t(spark, sf, "lineitem").select(F.col("l_orderkey").cast("string").alias("doc_id"), "l_linenumber", "l_partkey", "l_suppkey", _cents("l_extendedprice").alias("cents"), (F.col("l_orderkey") % 2 == 0).alias("closes"))
    nth = F.row_number().over(Window.partitionBy("doc_id").orderBy("l_linenumber", "l_partkey", "l_suppkey", "cents"))
    data = items.select("doc_id", nth.alias("row_no"), F.lit("data").alias("row_type"), F.concat(F.lit("lot "), nth.cast("string")).alias("label"), "cents")
    total = items.filter("closes").groupBy("doc_id").agg((F.count(F.lit(1)) + 1).cast("int").alias("row_no"), F.sum("cents").alias("cents")).select("doc_id", "row_no", F.lit("total").alias("row_type"), F.lit("Total").alias("label"), "cents")
    both = data.unionByName(total).withColumns({"table_no": F.lit(0), "group": F.concat(F.lit("order "), F.col("doc_id")), "description": F.col("label"), "page": F.lit(1)})
    cell = F.struct(F.lit("market_value").alias("name"), F.lit(0).alias("pos"), F.struct(F.lit("").alias("raw"), _money(F.col("cents")).cast("decimal(28,8)").alias("num"), F.lit(None).cast("date").alias("dt"), F.lit("amount").alias("kind")).alias("v"))
    return both.withColumns({"cells": F.array(cell), "dates": F.array().cast("array<struct<raw:string,dt:date>>")})


@query("""
WITH o AS (SELECT l_orderkey::VARCHAR AS doc_id, l_orderkey % 2 = 0 AS closes, round(l_extendedprice * 100)::BIGINT AS cents FROM lineitem)
SELECT doc_id, 'order ' || doc_id AS label, sum(cents)::BIGINT AS cents FROM o WHERE closes GROUP BY doc_id
UNION ALL SELECT doc_id, 'lots' AS label, cents FROM o WHERE NOT closes""")
def lot_collapse(spark: SparkSession, sf: str) -> DataFrame:
    got = canonical.collapse_lots(_statement_rows(spark, sf))
    label = F.when(F.startswith("label", F.lit("lot ")), "lots").otherwise(F.col("label"))
    return got.select("doc_id", label.alias("label"), "cents")


@query("""
WITH d AS (SELECT n_regionkey, n_name AS label, sum(round(c_acctbal * 100)::BIGINT)::BIGINT AS cents FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL),
r AS (SELECT n_regionkey, r_name AS label, sum(cents)::BIGINT AS cents FROM d JOIN region ON r_regionkey = n_regionkey GROUP BY ALL),
u AS (SELECT n_regionkey, label, cents, false AS cand FROM d UNION ALL SELECT n_regionkey, label, cents, true FROM r),
m AS (SELECT *, max(abs(cents)) FILTER (NOT cand) OVER (PARTITION BY n_regionkey) AS others FROM u)
SELECT n_regionkey, label, cents, CASE WHEN cand AND abs(cents) >= others THEN 'total' ELSE 'data' END AS row_type FROM m""")
def promote_totals(spark: SparkSession, sf: str) -> DataFrame:
    from ledgerloom.operators.tables import promote_totals as promote

    joined = _t(spark, sf, "customer").join(_t(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    detail = joined.groupBy("n_regionkey", F.col("n_name").alias("label")).agg(F.sum(_cents("c_acctbal")).alias("cents"))
    region = _t(spark, sf, "region")
    whole = detail.join(region, F.col("n_regionkey") == F.col("r_regionkey")).groupBy("n_regionkey", F.col("r_name").alias("label")).agg(F.sum("cents").alias("cents"))
    rows = detail.unionByName(whole).withColumns({"doc_id": F.lit("d"), "table_no": F.col("n_regionkey"), "row_type": F.lit("data")})
    cell = F.struct(F.lit("value").alias("name"), F.lit(0).alias("pos"), F.struct(F.lit("").alias("raw"), _money(F.col("cents")).cast("decimal(28,8)").alias("num"), F.lit(None).cast("date").alias("dt"), F.lit("amount").alias("kind")).alias("v"))
    tables = region.select(F.lit("d").alias("doc_id"), F.col("r_regionkey").alias("table_no"), F.array("r_name").alias("path"), F.lit("value").alias("amount_column"))
    return promote(rows.withColumn("cells", F.array(cell)), tables).select("n_regionkey", "label", "cents", "row_type")


@query("""
WITH s AS (SELECT l_returnflag, l_linestatus, count(*) AS n, sum(round(l_quantity * 100)::BIGINT) AS quantity, sum(round(l_extendedprice * 100)::BIGINT) AS price, sum(round(l_discount * 100)::BIGINT) AS discount, sum(round(l_tax * 100)::BIGINT) AS tax FROM lineitem GROUP BY ALL),
p AS (SELECT *, CASE l_returnflag || l_linestatus WHEN 'AF' THEN price WHEN 'RF' THEN discount WHEN 'NO' THEN quantity ELSE -5 END AS printed FROM s)
SELECT l_returnflag || l_linestatus AS part, CASE WHEN abs(quantity - printed) <= 1 THEN 'quantity' WHEN abs(price - printed) <= 1 THEN 'price' WHEN abs(discount - printed) <= 1 THEN 'discount' ELSE 'tax' END AS amount_column, printed::BIGINT AS cents FROM p""")
def refine_amount_column(spark: SparkSession, sf: str) -> DataFrame:
    """The column chosen by name is the last one; a printed total proves another, or none."""
    from ledgerloom.operators.tables import refine_amount

    names = {"quantity": "l_quantity", "price": "l_extendedprice", "discount": "l_discount", "tax": "l_tax"}
    sums = _t(spark, sf, "lineitem").groupBy(F.concat("l_returnflag", "l_linestatus").alias("doc_id")).agg(*[F.sum(_cents(c)).alias(n) for n, c in names.items()])
    printed = F.when(F.col("doc_id") == "AF", F.col("price")).when(F.col("doc_id") == "RF", F.col("discount")).when(F.col("doc_id") == "NO", F.col("quantity")).otherwise(F.lit(-5))
    keyed = sums.withColumns({"table_no": F.lit(0), "printed": printed})
    data = keyed.select("doc_id", "table_no", F.lit(1).alias("row_no"), F.lit("data").alias("row_type"), _cells({n: F.col(n) for n in names}).alias("cells"))
    total = keyed.select("doc_id", "table_no", F.lit(2).alias("row_no"), F.lit("total").alias("row_type"), _cells({n: F.col("printed") for n in names}).alias("cells"))
    tables = keyed.select("doc_id", "table_no", F.lit("T").alias("title"), F.lit("tax").alias("amount_column"), F.array(F.lit(1)).alias("pages"))
    got = refine_amount(tables, data.unionByName(total))
    return got.join(keyed.select("doc_id", F.col("printed").alias("cents")), "doc_id").select(F.col("doc_id").alias("part"), "amount_column", "cents")


@query("""
WITH s AS (SELECT n_nationkey, count(*) AS n, sum(round(c_acctbal * 100)::BIGINT)::BIGINT AS cents FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL)
SELECT n_nationkey AS target, cents AS extracted_cents, cents + CASE n_nationkey % 3 WHEN 0 THEN 0 WHEN 1 THEN 40 ELSE 1000000 END AS expected_cents, CASE n_nationkey % 3 WHEN 0 THEN 0 WHEN 1 THEN 40 ELSE 1000000 END <= n AS passed FROM s""")
def cross_checks(spark: SparkSession, sf: str) -> DataFrame:
    """Regions as accounts: an overview names each nation with its sum, right or not, and each nation has its table of customers."""
    who = _t(spark, sf, "customer").join(_t(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(_t(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    who = who.withColumn("code", F.concat(F.lit("GROUP "), F.repeat(F.substring(F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), F.col("n_nationkey") + 1, F.lit(1)), F.lit(3))))
    base = {"doc_id": F.lit("d"), "page": F.lit(1), "row_type": F.lit("data"), "row_no": F.col("c_custkey").cast("int"), "table_no": F.col("n_nationkey").cast("int"), "label": F.lit(""), "description": F.lit("a b"), "cells": _cells({"value": _cents("c_acctbal")})}
    detail = who.select(*(c.alias(n) for n, c in base.items()))
    off = F.when(F.col("n_nationkey") % 3 == 0, 0).when(F.col("n_nationkey") % 3 == 1, 40).otherwise(1_000_000)
    sums = who.groupBy("n_nationkey", "code", "r_regionkey", "r_name").agg(F.sum(_cents("c_acctbal")).alias("cents"))
    named = base | {"row_no": F.col("n_nationkey").cast("int"), "table_no": (100 + F.col("r_regionkey")).cast("int"), "label": F.lower("code"), "cells": _cells({"value": F.col("cents") + off})}
    rows = detail.unionByName(sums.select(*(c.alias(n) for n, c in named.items())))
    shape = {"account": F.col("r_name"), "amount_column": F.lit("value"), "pages": F.array(F.lit(1))}
    tables = sums.select(F.lit("d").alias("doc_id"), F.col("n_nationkey").cast("int").alias("table_no"), F.col("code").alias("title"), F.array("code").alias("path"), *(c.alias(n) for n, c in shape.items()))
    overviews = sums.select("r_regionkey", "r_name").distinct().select(F.lit("d").alias("doc_id"), (100 + F.col("r_regionkey")).cast("int").alias("table_no"), F.lit("OVERVIEW").alias("title"), F.array(F.lit("OVERVIEW")).alias("path"), *(c.alias(n) for n, c in shape.items()))
    got = reconcile.cross_checks(rows, tables.unionByName(overviews))
    cents = {f"{c}_cents": F.round(F.col(c).try_cast("decimal(28,8)") * 100).cast("bigint") for c in ("extracted", "expected")}
    return got.select(F.col("table_no").cast("bigint").alias("target"), *(c.alias(n) for n, c in cents.items()), "passed")


@query("""
WITH c AS (SELECT o_custkey, o_orderstatus = 'F' AS passed, CASE WHEN o_orderpriority LIKE '1%' THEN 'erro' ELSE 'aviso' END AS severity FROM orders),
f AS (SELECT o_custkey, count(*)::BIGINT AS n, count(*) FILTER (passed)::BIGINT AS n_passed, bool_or(NOT passed AND severity = 'erro') AS fatal FROM c GROUP BY o_custkey)
SELECT c_custkey AS table_no, coalesce(n, 0) AS n, coalesce(n_passed, 0) AS n_passed, CASE WHEN coalesce(fatal, false) THEN 'não conciliado' WHEN coalesce(n_passed, 0) = 0 THEN 'não verificável' WHEN n = n_passed THEN 'conciliado' ELSE 'parcial' END AS state FROM customer LEFT JOIN f ON c_custkey = o_custkey""")
def table_state(spark: SparkSession, sf: str) -> DataFrame:
    checks = _t(spark, sf, "orders").select(F.lit("d").alias("doc_id"), F.col("o_custkey").alias("table_no"), (F.col("o_orderstatus") == "F").alias("passed"), F.when(F.startswith("o_orderpriority", F.lit("1")), reconcile.ERROR).otherwise(reconcile.NOTICE).alias("severity"))
    tables = _t(spark, sf, "customer").select(F.lit("d").alias("doc_id"), F.col("c_custkey").alias("table_no"))
    return reconcile.table_states(tables, checks).select("table_no", "n", "n_passed", "state")


@query("""
WITH s AS (SELECT c_custkey, c_mktsegment, round(c_acctbal * 100)::BIGINT AS v FROM customer), t AS (SELECT *, sum(v) OVER (PARTITION BY c_mktsegment)::HUGEINT AS total FROM s),
q AS (SELECT *, abs(v)::HUGEINT * 10000 AS num, abs(total) AS den FROM t), d AS (SELECT *, num // den AS w, num % den AS r FROM q)
SELECT c_custkey, CASE WHEN (v < 0) <> (total < 0) THEN -1 ELSE 1 END * (w + CASE WHEN 2 * r > den OR (2 * r = den AND w % 2 = 1) THEN 1 ELSE 0 END)::BIGINT AS weight_bp FROM d""")
def position_weights(spark: SparkSession, sf: str) -> DataFrame:
    held = _t(spark, sf, "customer").select("c_custkey", "c_mktsegment", _money(_cents("c_acctbal")).alias("v"))
    total = F.sum("v").over(Window.partitionBy("c_mktsegment"))
    return held.select("c_custkey", (canonical.weight(F.col("v"), total) * 100).cast("bigint").alias("weight_bp"))


@query("""
WITH f AS (SELECT o_custkey, count(*) FILTER (o_orderstatus <> 'O')::BIGINT AS positions, coalesce(sum(round(o_totalprice * 100)::BIGINT) FILTER (o_orderstatus <> 'O'), 0)::BIGINT AS held, coalesce(sum(round(o_totalprice * 100)::BIGINT) FILTER (o_orderstatus = 'O'), 0)::BIGINT AS late FROM orders GROUP BY o_custkey),
p AS (SELECT *, CASE o_custkey % 4 WHEN 0 THEN held + late WHEN 1 THEN held + late + 1 WHEN 2 THEN held + late + 100000 END AS printed FROM f)
SELECT o_custkey::VARCHAR AS account, positions, held AS held_cents, late AS late_cents, printed::BIGINT AS printed_cents, abs(held + late - printed) <= greatest(positions, 1) AS reconciles FROM p""")
def account_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Customers as accounts: closed orders are held, open ones unsettled; three of four print a total, under two names and among other totals."""
    orders = _t(spark, sf, "orders").select(F.lit("d").alias("doc_id"), F.col("o_custkey").cast("string").alias("conta"), "o_custkey", (F.col("o_orderstatus") == "O").alias("open"), _cents("o_totalprice").alias("cents"))
    value = _money(F.col("cents")).cast("decimal(28,8)")
    datasets = {"posicoes": orders.filter("not open").select("doc_id", "conta", value.alias("valor_mercado")), "movimentos": orders.filter("open").select("doc_id", "conta", F.lit("UNSETTLED PURCHASES/SALES").alias("tabela"), value.alias("valor"))}
    whole = orders.groupBy("doc_id", "o_custkey", "conta").agg(F.sum("cents").alias("cents"))
    off = F.when(F.col("o_custkey") % 4 == 0, 0).when(F.col("o_custkey") % 4 == 1, 1).when(F.col("o_custkey") % 4 == 2, 100_000)
    printed = [("Total Valued Goods", F.lit(7)), ("Total  Market Value", F.when(F.col("o_custkey") % 4 == 2, F.col("cents") + off).otherwise(F.lit(3))), ("TOTAL\tVALUE of all", F.when(F.col("o_custkey") % 4 < 2, F.col("cents") + off)), ("Subtotal value", F.lit(9))]
    lines = whole.select("doc_id", F.col("o_custkey").cast("int").alias("table_no"), "o_custkey", F.explode(F.array(*[F.struct(F.lit(i).alias("row_no"), F.lit(name).alias("label"), cents.cast("bigint").alias("cents")) for i, (name, cents) in enumerate(printed)])).alias("x")).select("doc_id", "table_no", "o_custkey", "x.*")
    lines = lines.filter("o_custkey % 4 <> 3 or row_no in (0, 3)").withColumns({"row_type": F.lit("total"), "cells": _cells({"value": F.col("cents")})})
    tables = whole.select("doc_id", F.col("o_custkey").cast("int").alias("table_no"), F.col("conta").alias("account"), F.lit("value").alias("amount_column"))
    got = canonical.account_summaries(datasets, lines, tables, whole.select("doc_id", F.col("conta").alias("account"), F.lit("").alias("label")))
    cents = {n: F.round(F.col(c) * 100).cast("bigint") for n, c in (("held_cents", "market_value"), ("late_cents", "unsettled"), ("printed_cents", "printed_total"))}
    return got.select("account", F.col("positions").cast("bigint").alias("positions"), *(c.alias(n) for n, c in cents.items()), "reconciles")


@query("""
SELECT 'customer' AS origin, c_custkey AS id, c_name AS titulo, round(c_acctbal * 100)::BIGINT AS cents FROM customer
UNION ALL SELECT 'supplier', s_suppkey, s_name, round(s_acctbal * 100)::BIGINT FROM supplier UNION ALL SELECT 'part', p_partkey, p_name, round(p_retailprice * 100)::BIGINT FROM part""")
def canonical_union(spark: SparkSession, sf: str) -> DataFrame:
    """Three tables with their own column names in one schema: the value column is found by its name's pattern."""
    sources = {"valor": ["^acctbal$", "retailprice"]}
    out = None
    for origin, prefix in (("customer", "c_"), ("supplier", "s_"), ("part", "p_")):
        df = _t(spark, sf, origin)
        names = [c.removeprefix(prefix) for c in df.columns]
        values = F.create_map(*[x for n, c in zip(names, df.columns, strict=True) for x in (F.lit(n), F.col(c).try_cast("double") if dict(df.dtypes)[c] == "double" else F.lit(None).cast("double"))])
        found = F.try_element_at(values, canonical.source_column("valor", F.array(*[F.lit(n) for n in names]), sources))
        part = df.select(F.lit(origin).alias("origin"), F.col(df.columns[0]).alias("id"), F.col(f"{prefix}name").alias("titulo"), F.round(found * 100, 0).cast("bigint").alias("cents"))
        out = part if out is None else out.unionByName(part)
    return out


_DATASET_TITLES = {"posicoes": "MUTUAL FUNDS", "movimentos": "CASH FLOW ACTIVITY BY DATE", "mais_valias": "REALIZED GAIN/(LOSS) DETAIL - SHORT TERM", "sumario": "ACCOUNT SUMMARY", "alocacao": "ASSET ALLOCATION"}


@query("""
WITH l AS (SELECT l_orderkey, l_linenumber, l_orderkey % 5 AS k, round(l_extendedprice * 100)::BIGINT AS cents, round(l_quantity * 100)::BIGINT AS units, l_shipdate::DATE AS day,
  ['Dividend Reinvestment', 'Sold', 'Interest', 'Wire'][(l_linenumber % 4 + 1)::INT] AS kind FROM lineitem),
v AS (SELECT 'posicoes' AS domain, 'Fund K' || l_orderkey AS name, 'S' || l_linenumber AS symbol, NULL AS kind, cents, units FROM l WHERE k = 0
  UNION ALL SELECT 'movimentos', CASE WHEN kind = 'Wire' THEN 'Wire ' ELSE '' END || 'K' || l_orderkey || ' (S' || l_linenumber || ')', 'S' || l_linenumber, nullif(kind, 'Wire'), cents, units FROM l WHERE k = 1
  UNION ALL SELECT 'rendimento', 'K' || l_orderkey || ' (S' || l_linenumber || ')', 'S' || l_linenumber, kind, cents, units FROM l WHERE k = 1 AND kind = 'Interest'
  UNION ALL SELECT 'mais_valias', 'Fund K' || l_orderkey, 'S' || l_linenumber, 'Curto prazo', NULL, units FROM l WHERE k = 2
  UNION ALL SELECT 'sumario', 'Fund K' || l_orderkey || ' (S' || l_linenumber || ')', NULL, NULL, cents, NULL FROM l WHERE k = 3
  UNION ALL SELECT 'alocacao', 'Fund K' || l_orderkey || ' (S' || l_linenumber || ')', NULL, NULL, cents, NULL FROM l WHERE k = 4)
SELECT domain, name, symbol, kind, cents::BIGINT AS cents, units::BIGINT AS units, count(*)::BIGINT AS n FROM v GROUP BY ALL""")
def canonical_datasets(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as tables of five domains, their items as rows: every domain in its own schema, read back in one."""
    domains = list(_DATASET_TITLES)
    domain = F.get(F.array(*[F.lit(d) for d in domains]), (F.col("l_orderkey") % 5).cast("int"))
    title = F.get(F.array(*[F.lit(t) for t in _DATASET_TITLES.values()]), (F.col("l_orderkey") % 5).cast("int"))
    items = _t(spark, sf, "lineitem").withColumns({"domain": domain, "title": title, "doc_id": F.col("l_orderkey").cast("string"), "table_no": F.lit(0)})
    tail = F.concat(F.lit("K"), "doc_id", F.lit(" (S"), F.col("l_linenumber").cast("string"), F.lit(")"))
    kind = F.get(F.array(*[F.lit(k) for k in ("Dividend Reinvestment", "Sold", "Interest", "Wire")]), (F.col("l_linenumber") % 4).cast("int"))
    label = F.when(F.col("domain") == "movimentos", F.concat(kind, F.lit(" "), tail)).otherwise(F.concat(F.lit("Fund "), tail))
    date = F.array(F.struct(F.lit("").alias("raw"), F.col("l_shipdate").cast("date").alias("dt")))
    rows = items.select("doc_id", "table_no", F.col("l_linenumber").cast("int").alias("row_no"), F.lit("data").alias("row_type"), F.lit(1).alias("page"), label.alias("label"), label.alias("description"), label.alias("group"), date.alias("dates"), _cells({"quantity": _cents("l_quantity"), "market_value": _cents("l_extendedprice")}).alias("cells"))
    columns = F.array(*[F.struct(F.lit(n).alias("name")) for n in ("description", "quantity", "market_value")])
    tables = items.select("doc_id", "table_no", "title").distinct().withColumns({"account": F.lit("a"), "amount_column": F.lit("market_value"), "columns": columns})
    got = canonical.build_datasets(rows, tables)
    parts = {"posicoes": ("titulo", "simbolo", None, "valor_mercado", "quantidade"), "movimentos": ("descricao", "simbolo", "tipo", "valor", "quantidade"), "rendimento": ("descricao", "simbolo", "tipo", "valor", "quantidade"), "mais_valias": ("titulo", "simbolo", "prazo", "mais_valia_realizada", "quantidade"), "sumario": ("rubrica", None, None, "valor", None), "alocacao": ("rubrica", None, None, "valor", None)}
    out = None
    for name, (a, b, c, v, u) in parts.items():
        texts = [(F.col(x) if x else F.lit(None).cast("string")).alias(n) for x, n in ((a, "name"), (b, "symbol"), (c, "kind"))]
        sums = [(F.round(F.col(x) * 100).cast("bigint") if x else F.lit(None).cast("bigint")).alias(n) for x, n in ((v, "cents"), (u, "units"))]
        part = got[name].select(F.lit(name).alias("domain"), *texts, *sums)
        out = part if out is None else out.unionByName(part)
    return out.groupBy("domain", "name", "symbol", "kind", "cents", "units").agg(F.count(F.lit(1)).alias("n"))


def _positions(spark: SparkSession, sf: str) -> DataFrame:
    rows = _t(spark, sf, "orders").select(F.lit("d").alias("doc_id"), F.col("o_custkey").cast("string").alias("conta"), F.concat(F.lit("Order – "), F.col("o_orderkey").cast("string")).alias("titulo"), F.col("o_orderpriority").alias("classe_ativo"), _money(_cents("o_totalprice")).cast("decimal(28,8)").alias("valor_mercado"), F.col("o_orderdate").cast("date").alias("data_compra"))
    empty = {c: F.lit(None).cast("decimal(28,8)") for c in ("quantidade", "preco_unitario", "custo_unitario", "custo_total", "mais_valia_nao_realizada", "rendimento_anual_estimado", "yield_pct", "peso_pct")}
    return rows.withColumns(empty | {"simbolo": F.lit(None).cast("string"), "pagina": F.lit(1), "tabela_origem": F.lit("orders")})


@query("""SELECT o_custkey::VARCHAR AS "CONTA", CASE WHEN o_custkey % 3 = 0 THEN 'C' || o_custkey ELSE o_custkey::VARCHAR END AS "IDCLIENTE", 'ORDER_' || o_orderkey AS "IDATIVO", o_orderdate::DATE AS "DT_COMPRA", round(o_totalprice * 100)::BIGINT AS cents, 0::BIGINT AS taxes FROM orders""")
def export_positions(spark: SparkSession, sf: str) -> DataFrame:
    clients = _t(spark, sf, "customer").filter("c_custkey % 3 = 0").select(F.col("c_custkey").cast("string").alias("account"), F.concat(F.lit("C"), F.col("c_custkey").cast("string")).alias("idcliente"), F.col("c_name").alias("nome"))
    got = export.positions(_positions(spark, sf), F.lit("2026-01-31").cast("date"), clients)
    return got.select("CONTA", "IDCLIENTE", "IDATIVO", "DT_COMPRA", F.round(F.col("VLR_BRUTO_MOEDA_ORIGINAL") * 100).cast("bigint").alias("cents"), F.coalesce("VALOR_IR", "VALOR_IOF", "VALOR_LIQUIDO", F.lit(0)).cast("bigint").alias("taxes"))


@query(f"""
WITH k AS (SELECT o_custkey, o_orderkey, o_totalprice, {_KIND_SQL.replace("event_id", "o_orderkey")} AS k FROM orders), c AS (SELECT *, CASE lower(k) WHEN 'dividend reinvestment' THEN 'A' WHEN 'dividend' THEN 'DIV' WHEN 'interest' THEN 'JUROS' WHEN 'sold' THEN 'RP' WHEN 'long term capital gain' THEN 'DIV' WHEN 'fee' THEN 'TX' WHEN 'cash transfer' THEN 'TRF' ELSE 'OUTROS' END AS code FROM k)
SELECT o_custkey::VARCHAR AS "CONTA", code AS "TIPO_MOVIMENTO", count(*)::BIGINT AS n, sum(round(o_totalprice * 100)::BIGINT)::BIGINT AS cents FROM c WHERE code <> 'TRF' OR o_orderkey % 3 > 0 GROUP BY ALL""")
def export_movements(spark: SparkSession, sf: str) -> DataFrame:
    k = F.get(F.array(*[F.lit(x) for x in _KINDS]), (F.col("o_orderkey") % 8).cast("int"))
    described = F.concat(k, F.lit(" order"))
    rows = _t(spark, sf, "orders").select(F.lit("d").alias("doc_id"), F.col("o_custkey").cast("string").alias("conta"), F.col("o_orderdate").cast("date").alias("data"), labels.activity_type(described).alias("tipo"), labels.without_activity(described).alias("descricao"), F.lit(None).cast("string").alias("simbolo"), F.lit(None).cast("decimal(28,8)").alias("quantidade"), F.lit(None).cast("decimal(28,8)").alias("preco_unitario"), _money(_cents("o_totalprice")).cast("decimal(28,8)").alias("valor"), (F.col("o_orderkey") % 3).alias("third"), F.lit(1).alias("pagina"), F.lit("orders").alias("tabela_origem"))
    moves = rows.filter(F.coalesce(F.col("tipo") != "Cash Transfer", F.lit(True)))
    transfers = rows.filter("tipo = 'Cash Transfer'").withColumn("valor", F.when(F.col("third") > 0, F.col("valor")))
    got = export.movements(moves, transfers)
    return got.groupBy("CONTA", "TIPO_MOVIMENTO").agg(F.count(F.lit(1)).alias("n"), F.sum(F.round(F.col("VALOR") * 100).cast("bigint")).alias("cents"))


def _funds(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Nations of even key as exclusive funds that hold their customers; every nation is a position worth its customers' balances."""
    rows = _t(spark, sf, "customer").join(_t(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select("n_name", "n_nationkey", "c_custkey", "c_mktsegment", _cents("c_acctbal").alias("cents"))
    value = F.col("cents").cast("decimal(20,0)")
    per = rows.groupBy("n_name", "n_nationkey").agg(F.sum("cents").alias("cents"), F.collect_list(F.struct(F.col("c_custkey").cast("string").alias("idativo"), F.concat(F.lit("customer "), F.col("c_custkey").cast("string")).alias("descricao"), F.col("c_mktsegment").alias("classe"), (value / 100).cast("decimal(28,2)").cast("string").alias("valor"), F.lit(None).cast("string").alias("quantidade"), F.lit(None).cast("string").alias("pu"), F.lit(None).cast("string").alias("custo"))).alias("holdings"))
    empty = {c: F.lit(None).cast("decimal(28,8)") for c in ("quantidade", "preco_unitario", "custo_unitario", "custo_total", "mais_valia_nao_realizada", "rendimento_anual_estimado", "yield_pct", "peso_pct")}
    held = per.select(F.lit("d").alias("doc_id"), F.lit("1").alias("conta"), F.col("n_name").alias("titulo"), F.lit("Funds").alias("classe_ativo"), _money(F.col("cents")).cast("decimal(28,8)").alias("valor_mercado")).withColumns(empty | {"simbolo": F.lit(None).cast("string"), "data_compra": F.lit(None).cast("date"), "pagina": F.lit(1), "tabela_origem": F.lit("nation")})
    funds = per.filter("n_nationkey % 2 = 0").select(F.regexp_replace("n_name", "[^A-Z0-9]+", "_").alias("idativo"), F.col("n_name").alias("nome"), "holdings")
    return export.positions(held, F.lit(None).cast("date"), None, funds), funds


_FUND_SQL = """WITH c AS (SELECT n_nationkey, regexp_replace(n_name, '[^A-Z0-9]+', '_', 'g') AS fund, c_custkey, c_mktsegment, round(c_acctbal * 100)::BIGINT AS cents FROM customer JOIN nation ON c_nationkey = n_nationkey)"""


@query(_FUND_SQL + """
SELECT c_custkey::VARCHAR AS "IDATIVO", fund AS origin, cents FROM c WHERE n_nationkey % 2 = 0
UNION ALL SELECT fund, NULL, sum(cents)::BIGINT FROM c WHERE n_nationkey % 2 = 1 GROUP BY fund""")
def explosion_detailed(spark: SparkSession, sf: str) -> DataFrame:
    rows, funds = _funds(spark, sf)
    return export.explode_funds(rows, funds, "detalhado").select("IDATIVO", F.col("ORIGEM_EXPLOSAO").alias("origin"), F.round(F.col("VLR_BRUTO_MOEDA_ORIGINAL") * 100).cast("bigint").alias("cents"))


@query(_FUND_SQL + """
SELECT c_mktsegment AS "IDATIVO", fund AS origin, sum(cents)::BIGINT AS cents FROM c WHERE n_nationkey % 2 = 0 GROUP BY ALL
UNION ALL SELECT fund, NULL, sum(cents)::BIGINT FROM c WHERE n_nationkey % 2 = 1 GROUP BY fund""")
def explosion_consolidated(spark: SparkSession, sf: str) -> DataFrame:
    rows, funds = _funds(spark, sf)
    return export.explode_funds(rows, funds, "consolidado").select("IDATIVO", F.col("ORIGEM_EXPLOSAO").alias("origin"), F.round(F.col("VLR_BRUTO_MOEDA_ORIGINAL") * 100).cast("bigint").alias("cents"))


@query(_FUND_SQL + """,
v AS (SELECT sum(cents) AS base, coalesce(sum(cents) FILTER (n_nationkey % 2 = 1 OR c_custkey % 7 > 0), 0) AS short FROM c)
SELECT unnest(['explosão consolidado vs não explodida', 'explosão detalhado vs não explodida']) AS name, whole, (whole OR short = base) AS passed, (CASE WHEN whole THEN base ELSE short END)::BIGINT AS cents FROM v, (VALUES (true), (false)) AS t(whole)""")
def explosion_check(spark: SparkSession, sf: str) -> DataFrame:
    """Funds that are whole, and funds that lack some holdings."""
    rows, funds = _funds(spark, sf)
    short = funds.withColumn("holdings", F.filter("holdings", lambda h: h["idativo"].cast("bigint") % 7 > 0))
    out = None
    for whole, side in ((True, funds), (False, short)):
        got = export.explosion_checks({m: export.explode_funds(rows, side, m) for m in export.MODES})
        part = got.select("name", F.lit(whole).alias("whole"), "passed", F.round(F.col("extracted").cast("decimal(28,8)") * 100).cast("bigint").alias("cents"))
        out = part if out is None else out.unionByName(part)
    return out


@query("""
WITH h AS (SELECT conv_id, turn, role FROM conversations), r AS (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS p FROM h), k AS (SELECT * FROM r WHERE p IS DISTINCT FROM role),
n AS (SELECT *, lead(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS nx, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS rn FROM k)
SELECT conv_id, role AS section, turn AS first_page, greatest(turn, coalesce(nx - 1, 9)) AS last_page FROM n WHERE rn = 1""")
def section_ranges(spark: SparkSession, sf: str) -> DataFrame:
    hits = _t(spark, sf, "conversations").select(F.col("conv_id").alias("doc_id"), F.lit("").alias("account"), F.col("turn").alias("seq"), F.col("turn").alias("page"), F.col("role").alias("section"), F.lit(9).cast("bigint").alias("page_count"))
    return layout.section_ranges(hits).select(F.col("doc_id").alias("conv_id"), "section", "first_page", "last_page")


@query("""
WITH c AS (SELECT p_brand AS doc_id, p_partkey AS k, p_size::DOUBLE AS x0, p_size + (p_partkey % 7) - 1.0 AS x1 FROM part), f AS (SELECT *, lag(x1) OVER (PARTITION BY doc_id ORDER BY x0, x1, k::VARCHAR) AS prev FROM c)
SELECT doc_id, k::VARCHAR AS name, CASE WHEN x1 <= x0 THEN 'inverted' ELSE 'overlap' END AS fault FROM f WHERE x1 <= x0 OR x0 < prev - 0.01""")
def layout_validation(spark: SparkSession, sf: str) -> DataFrame:
    cols = _t(spark, sf, "part").select(F.col("p_brand").alias("doc_id"), F.lit("s").alias("section"), F.col("p_partkey").cast("string").alias("name"), F.col("p_size").cast("double").alias("x0"), (F.col("p_size") + F.col("p_partkey") % 7 - F.lit(1.0)).alias("x1"))
    return layout.column_faults(cols).select("doc_id", "name", "fault")


@query("""
WITH t AS (SELECT o_custkey, lpad((o_custkey % 1000)::VARCHAR, 3, '0') || '-' || lpad((o_orderkey % 1000000)::VARCHAR, 6, '0') || '-042' AS acc, strftime(o_orderdate, '%B') AS m, o_orderdate FROM orders)
SELECT acc AS account, year(o_orderdate)::INT AS year, date_trunc('month', o_orderdate)::DATE AS start, last_day(o_orderdate) AS "end", month(o_orderdate)::VARCHAR || '_1_' || strftime(o_orderdate, '%y') AS hint, count(*)::BIGINT AS n FROM t GROUP BY ALL""")
def period_detect(spark: SparkSession, sf: str) -> DataFrame:
    d = F.col("o_orderdate").cast("date")
    acc = F.concat(F.lpad((F.col("o_custkey") % 1000).cast("string"), 3, "0"), F.lit("-"), F.lpad((F.col("o_orderkey") % 1000000).cast("string"), 6, "0"), F.lit("-042"))
    line = F.concat(F.lit("Account "), acc, F.lit(" For the Period "), F.date_format(d, "MMMM"), F.lit(" 1-"), F.dayofmonth(F.last_day(d)).cast("string"), F.lit(", "), F.year(d).cast("string"))
    printed = _t(spark, sf, "orders").select(F.col("o_orderkey").cast("string").alias("doc_id"), F.lit(1).alias("page"), F.lit(0).alias("line_no"), line.alias("text"))
    found = layout.statement_period(printed).join(printed.select("doc_id", text.account_number(F.col("text")).alias("account")), "doc_id")
    return found.select("account", F.col("statement_year").alias("year"), F.col("period_start").alias("start"), F.col("period_end").alias("end"), dates.period_hint(F.col("period_start")).alias("hint")).groupBy("account", "year", "start", "end", "hint").agg(F.count(F.lit(1)).alias("n"))


@query("""
WITH t AS (SELECT o_custkey, o_orderkey, lpad((o_custkey % 1000)::VARCHAR, 3, '0') || '-' || lpad((o_orderkey % 3)::VARCHAR, 6, '0') || '-042' AS account, CASE WHEN o_orderpriority LIKE '4%' THEN 'Account' ELSE o_orderpriority END AS label FROM orders WHERE o_orderkey % 5 > 0)
SELECT o_custkey::VARCHAR AS doc_id, account, arg_min(label, o_orderkey) AS label, min(o_orderkey) AS first_page, count(*)::BIGINT AS n FROM t GROUP BY ALL""")
def account_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Customers as documents, orders as pages; a fifth of the pages print the account below the header zone."""
    number = F.concat(F.lpad((F.col("o_custkey") % 1000).cast("string"), 3, "0"), F.lit("-"), F.lpad((F.col("o_orderkey") % 3).cast("string"), 6, "0"), F.lit("-042"))
    top = F.when(F.col("o_orderkey") % 5 > 0, 10.0).otherwise(60.0)
    printed = F.array(F.struct(F.lit(0).alias("line_no"), F.lit(5.0).alias("top"), F.concat(F.lit(" "), "o_orderpriority", F.lit(" Account Detail")).alias("text")), F.struct(F.lit(1).alias("line_no"), top.alias("top"), F.concat(F.lit("Account "), number).alias("text")), F.struct(F.lit(2).alias("line_no"), F.lit(20.0).alias("top"), F.lit("no number").alias("text")))
    pages = _t(spark, sf, "orders").select(F.col("o_custkey").cast("string").alias("doc_id"), F.col("o_orderkey").alias("page"), F.lit(100.0).alias("height"), F.explode(printed).alias("l"))
    got = layout.accounts(pages.select("doc_id", "page", "l.*"), pages.select("doc_id", "page", "height").distinct())
    return got.select("doc_id", "account", "label", F.element_at("pages", 1).alias("first_page"), F.size("pages").cast("bigint").alias("n"))


_PAGES = 60


def _brand_tables(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Brands as documents of 60 pages, types as tables on the pages of their sizes."""
    part = _t(spark, sf, "part")
    pages = F.sort_array(F.collect_set(F.col("p_size").cast("int")))
    named = part.groupBy(F.col("p_brand").alias("doc_id"), F.col("p_type").alias("title")).agg(pages.alias("pages"), F.max("p_name").alias("amount_column"))
    tables = named.withColumn("columns", F.array_repeat(F.lit("c"), (F.length("title") % 4).cast("int")))
    return tables, tables.select("doc_id").distinct().withColumn("page_count", F.lit(_PAGES))


@query(f"""SELECT b.p_brand AS doc_id, i::INT AS page FROM (SELECT DISTINCT p_brand FROM part) b, range(1, {_PAGES + 1}) AS r(i) WHERE NOT EXISTS (SELECT 1 FROM part p WHERE p.p_brand = b.p_brand AND p.p_size = i)""")
def orphan_pages(spark: SparkSession, sf: str) -> DataFrame:
    return sinks.orphan_pages(*_brand_tables(spark, sf))


# Words of a statement that lists each customer's orders, forty to a page, closed by a total; (off) by a cent or a unit.
_ROWS_A_PAGE = 40


def _painted(spark: SparkSession, sf: str) -> DataFrame:
    orders = _t(spark, sf, "orders").select(F.col("o_custkey"), F.col("o_custkey").cast("string").alias("doc_id"), "o_orderkey", _cents("o_totalprice").alias("cents"))
    nth = F.row_number().over(Window.partitionBy("doc_id").orderBy("o_orderkey")) - 1
    off = F.when(F.col("o_custkey") % 3 == 0, 0).when(F.col("o_custkey") % 3 == 1, 1).otherwise(100)
    rows = orders.withColumn("i", nth)
    data = rows.select("doc_id", "i", F.array(F.lit("Order"), F.concat(F.lit("K"), F.col("o_orderkey").cast("string"))).alias("label"), _printed(F.col("cents")).alias("shown"), F.lit(9.0).alias("size"))
    totals = rows.groupBy("doc_id", "o_custkey").agg(F.count(F.lit(1)).cast("int").alias("i"), F.sum("cents").alias("cents"))
    total = totals.select("doc_id", "i", F.array(F.lit("Total"), F.lit("Orders"), F.lit("Held")).alias("label"), _printed(F.col("cents") + off).alias("shown"), F.lit(9.0).alias("size"))
    head = totals.select("doc_id", F.lit(-3).alias("i"), F.array(F.lit("ORDERS"), F.lit("HELD")).alias("label"), F.lit("").alias("shown"), F.lit(14.0).alias("size"))
    lines = data.unionByName(total).unionByName(head).withColumns({"page": (F.greatest(F.col("i"), F.lit(0)) / _ROWS_A_PAGE).cast("int") + 1, "bottom": 120.0 + 14.0 * F.when(F.col("i") < 0, F.col("i")).otherwise(F.col("i") % _ROWS_A_PAGE)})
    width = F.length("shown") * 4.5
    amount = F.when(F.col("shown") != "", F.array(F.struct(F.col("shown").alias("text"), (520.0 - width).alias("x0"), F.lit(520.0).alias("x1"))))
    spoken = F.transform("label", lambda w, i: F.struct(w.alias("text"), (40.0 + 70.0 * i).alias("x0"), (40.0 + 70.0 * i + F.length(w) * 4.5).alias("x1")))
    each = lines.select("doc_id", "page", F.explode(F.concat(spoken, F.coalesce(amount, F.slice(spoken, 1, 0)))).alias("w"), (F.col("bottom") - F.col("size")).alias("top"), "bottom", "size")
    return each.select("doc_id", "page", "w.text", "w.x0", "w.x1", "top", "bottom", "size", F.when(F.col("size") > 9, "Helvetica-Bold").otherwise("Helvetica").alias("fontname"), F.lit(True).alias("upright"))


_PAINTED_SQL = f"""
WITH f AS (SELECT o_custkey, count(*) AS n, sum(round(o_totalprice * 100)::BIGINT) AS cents, CASE o_custkey % 3 WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE 100 END AS off FROM orders GROUP BY o_custkey)
SELECT o_custkey::VARCHAR AS doc_id, 'ORDERS HELD' AS title, n::BIGINT AS data_rows, (n // {_ROWS_A_PAGE} + 1)::BIGINT AS pages, cents::BIGINT AS extracted_cents, (cents + off)::BIGINT AS printed_cents, off = 0 AS passed"""


@query(_PAINTED_SQL + """, CASE WHEN off = 0 THEN 'conciliado' WHEN off <= 1 THEN 'não verificável' ELSE 'não conciliado' END AS state FROM f""")
def painted_sweep(spark: SparkSession, sf: str) -> DataFrame:
    """Words to lines, blocks, a table over its pages, typed rows, totals, checks and states."""
    tables, rows, _ = detect(_painted(spark, sf), year=2026)
    checks = reconcile.table_checks(rows, tables)
    proofs = checks.filter("name like 'Σ%'").select("doc_id", "table_no", "passed", *(F.round(F.col(c).try_cast("decimal(28,8)") * 100).cast("bigint").alias(n) for c, n in (("extracted", "extracted_cents"), ("expected", "printed_cents"))))
    listed = sinks.table_index(reconcile.table_states(tables, checks), rows).select("doc_id", "table_no", "data_rows", "state")
    shape = tables.select("doc_id", "table_no", "title", F.size("pages").cast("bigint").alias("pages"))
    return shape.join(listed, ["doc_id", "table_no"]).join(proofs, ["doc_id", "table_no"]).drop("table_no")


_PAINTED_SPEC = {
    "pages": list(range(1, 100)), "amount_column": "amount", "row_start": {"kind": "numeric_in", "column": "amount"}, "total_label_patterns": [r"^Total\s+Orders"], "ignore_patterns": [r"^ORDERS HELD"],
    "columns": [{"name": "description", "x0": 37, "x1": 300, "type": "text"}, {"name": "amount", "x0": 300, "x1": 523, "type": "amount"}],
}


@query(_PAINTED_SQL.replace("'ORDERS HELD' AS title, ", "").replace(f"(n // {_ROWS_A_PAGE} + 1)::BIGINT AS pages, ", "") + " FROM f")
def painted_section(spark: SparkSession, sf: str) -> DataFrame:
    """The same words by a declared section: typed rows, the printed total and its check."""
    rows, totals, _ = sections.parse_section("orders", ordered.lines(_painted(spark, sf)), _PAINTED_SPEC, 2026)
    counts = rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("data_rows"))
    checks = sections.internal_checks(rows, totals, _PAINTED_SPEC)
    cents = (F.round(F.col(c).try_cast("decimal(28,8)") * 100).cast("bigint").alias(n) for c, n in (("extracted", "extracted_cents"), ("expected", "printed_cents")))
    return checks.select("doc_id", "passed", *cents).join(counts, "doc_id")


_CELLS = ["12.5%", "Activity $9.30", "Q3 2016 $5.00", "word", "x9y", "—", "12/8/16", "(1.00)"]
_CELL_KINDS = ["percent", "glued", "problem", "stray", "problem", "blank", "date", "amount"]


@query(f"""SELECT [{", ".join(f"'{c}'" for c in _CELLS)}][(l_orderkey % 8 + 1)::INT] AS raw, [{", ".join(f"'{c}'" for c in _CELL_KINDS)}][(l_orderkey % 8 + 1)::INT] AS kind, count(*)::BIGINT AS n FROM lineitem GROUP BY ALL""")
def cell_kinds(spark: SparkSession, sf: str) -> DataFrame:
    raw = F.get(F.array(*[F.lit(x) for x in _CELLS]), (F.col("l_orderkey") % 8).cast("int"))
    return _t(spark, sf, "lineitem").select(raw.alias("raw")).withColumn("kind", cell_value(F.col("raw"))["kind"]).groupBy("raw", "kind").agg(F.count(F.lit(1)).alias("n"))


@query("""
WITH u AS (SELECT o_custkey, count(*) FILTER (o_orderkey % 4 = 0)::BIGINT AS problems, count(*) FILTER (o_orderkey % 4 = 1)::BIGINT AS strays FROM orders GROUP BY o_custkey)
SELECT o_custkey AS table_no, (CASE WHEN strays > 0 THEN 1 ELSE 0 END + CASE WHEN problems >= 3 THEN 1 ELSE 0 END)::BIGINT AS notices, (CASE WHEN problems < 3 THEN problems ELSE 0 END)::BIGINT AS errors FROM u WHERE problems + strays > 0""")
def cell_problems(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("o_orderkey") % 4
    kind = F.when(k == 0, "problem").when(k == 1, "stray").otherwise("amount")
    cell = F.struct(F.lit("value").alias("name"), F.lit(0).alias("pos"), F.struct(F.lit("r").alias("raw"), F.lit(None).cast("decimal(28,8)").alias("num"), F.lit(None).cast("date").alias("dt"), kind.alias("kind")).alias("v"))
    rows = _t(spark, sf, "orders").select(F.lit("d").alias("doc_id"), F.col("o_custkey").cast("int").alias("table_no"), F.lit(1).alias("page"), F.array(cell).alias("cells"))
    tables = rows.select("doc_id", "table_no").distinct().withColumns({"title": F.lit("T"), "amount_column": F.lit("value"), "pages": F.array(F.lit(1))})
    got = reconcile.cell_checks(rows, tables)
    return got.groupBy(F.col("table_no").cast("bigint").alias("table_no")).agg(F.count_if(F.col("severity") == reconcile.NOTICE).alias("notices"), F.count_if(F.col("severity") == reconcile.ERROR).alias("errors"))


@query(f"""
WITH t AS (SELECT p_brand, p_type, list_sort(list(DISTINCT p_size)) AS pages, max(p_name) AS amount FROM part GROUP BY ALL),
k AS (SELECT p_brand, p_size % 3 = 0 AS passed, CASE WHEN p_partkey % 2 = 0 THEN 'erro' ELSE 'aviso' END AS severity, p_size, p_type, p_name FROM part),
l AS (SELECT p_brand AS doc_id, 1 AS part, pages[1]::INT AS seq, regexp_replace(p_type, '[0-9]', '#', 'g') || ' | ' || array_to_string(pages, ',') || ' | ' || (length(p_type) % 4) || ' | ' || regexp_replace(amount, '[0-9]', '#', 'g') AS line FROM t
  UNION ALL SELECT b.p_brand, 2, i::INT, 'sem tabela: p.' || i FROM (SELECT DISTINCT p_brand FROM part) b, range(1, {_PAGES + 1}) AS r(i) WHERE NOT EXISTS (SELECT 1 FROM part p WHERE p.p_brand = b.p_brand AND p.p_size = i)
  UNION ALL SELECT p_brand, 3, 0, s || ' ' || n FROM (SELECT p_brand, CASE WHEN passed THEN 'PASS' WHEN severity = 'erro' THEN 'FAIL' ELSE 'AVISO' END AS s, count(*) AS n FROM k GROUP BY ALL)
  UNION ALL SELECT p_brand, 4, p_size::INT, regexp_replace(p_type, '[0-9]', '#', 'g') || ' · ' || regexp_replace(p_name, '[0-9]', '#', 'g') FROM k WHERE NOT passed AND severity = 'erro')
SELECT doc_id, part, seq, line, row_number() OVER (PARTITION BY doc_id ORDER BY part, seq, line)::INT AS no FROM l""")
def structure_report(spark: SparkSession, sf: str) -> DataFrame:
    """Brands as documents: their tables, pages without one, and a check for each part."""
    tables, counts = _brand_tables(spark, sf)
    checks = _t(spark, sf, "part").select(F.col("p_brand").alias("doc_id"), (F.col("p_size") % 3 == 0).alias("passed"), F.when(F.col("p_partkey") % 2 == 0, reconcile.ERROR).otherwise(reconcile.NOTICE).alias("severity"), F.col("p_size").cast("int").alias("page"), F.col("p_type").alias("section"), F.col("p_name").alias("name"))
    return sinks.structure_report(tables, checks, counts)
