"""Checks: extracted sums against what the document prints. Not verifiable is neither right nor wrong."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.amounts import rounding_slack
from ledgerloom.functions.labels import PLAIN_TOTAL_LOOSE, label_matches_title, title_words
from ledgerloom.functions.text import strip

from .tables import dropped_tables, number_in

_TABLE = ["doc_id", "table_no"]
ERROR, NOTICE = "erro", "aviso"
CHECK_COLUMNS = ["doc_id", "table_no", "section", "name", "passed", "extracted", "expected", "page", "detail", "severity"]
MANY_PROBLEMS = 3


def matches(extracted: Column, expected: Column, tolerance: Column | None = None) -> Column:
    """Equal within the tolerance (none by default); a missing side never matches."""
    slack = tolerance if tolerance is not None else F.lit(0)
    return F.coalesce(F.abs(extracted - expected) <= slack, F.lit(False))


def check(name: Column, passed: Column, extracted: Column, expected: Column, page: Column, detail: Column, severity: Column, section: Column | None = None, table_no: Column | None = None) -> list[Column]:
    return [
        F.col("doc_id"), (table_no if table_no is not None else F.col("table_no")).cast("int").alias("table_no"), (section if section is not None else F.col("title")).alias("section"), name.alias("name"), passed.alias("passed"),
        extracted.cast("string").alias("extracted"), expected.cast("string").alias("expected"), page.cast("int").alias("page"), detail.alias("detail"), severity.alias("severity"),
    ]


def fatal() -> Column:
    return ~F.col("passed") & (F.col("severity") == ERROR)


def formatted() -> Column:
    """A check as one line of text."""
    state = F.when(F.col("passed"), "PASS").when(F.col("severity") == ERROR, "FAIL").otherwise("AVISO")
    delta = F.expr("try_cast(extracted as decimal(28,8)) - try_cast(expected as decimal(28,8))")
    shown = F.when(delta.isNotNull() & ~F.col("passed"), F.concat(F.lit(" (delta="), delta.cast("string"), F.lit(")"))).otherwise("")
    return F.concat(F.lit("["), state, F.lit("] "), "section", F.coalesce(F.concat(F.lit(" p."), F.col("page").cast("string")), F.lit("")), F.lit(" · "), "name", F.lit(": "), F.coalesce("extracted", F.lit("—")), F.lit(" vs "), F.coalesce("expected", F.lit("—")), shown)


def _valued(rows: DataFrame, tables: DataFrame) -> DataFrame:
    joined = rows.join(tables.select(*_TABLE, "title", "path", "amount_column", F.element_at("pages", 1).alias("first_page")), _TABLE)
    return joined.filter("amount_column is not null").withColumn("num", number_in(F.col("cells"), F.col("amount_column")))


def group_checks(valued: DataFrame) -> DataFrame:
    """Each bare total against the data rows of its group."""
    members = Window.partitionBy(*_TABLE, "group")
    is_data = F.col("row_type") == "data"
    summed = valued.withColumn("extracted", F.coalesce(F.sum(F.when(is_data, F.col("num"))).over(members), F.lit(0))).withColumn("members", F.sum(is_data.cast("int")).over(members))
    bare = summed.filter((F.col("row_type") == "total") & F.rlike(strip(F.col("label")), F.lit(PLAIN_TOTAL_LOOSE)) & F.col("num").isNotNull())
    within = F.abs(F.col("extracted") - F.col("num")) <= rounding_slack(F.col("members"))
    name = F.when(F.col("group") == "", "Σ grupo vs 'Total' impresso").otherwise(F.concat(F.lit("Σ "), F.substring("group", 1, 28), F.lit(" vs 'Total' impresso")))
    detail = F.format_string("%d linha(s) sob '%s'", F.col("members"), F.substring("group", 1, 44))
    return bare.select(*check(name, matches(F.col("extracted"), F.col("num")), F.col("extracted"), F.col("num"), F.col("page"), detail, F.when(within, NOTICE).otherwise(ERROR)))


def total_checks(valued: DataFrame) -> DataFrame:
    """The totals that name the table (all totals if none does) against all data rows."""
    totals = valued.filter((F.col("row_type") == "total") & ~F.rlike(strip(F.col("label")), F.lit(PLAIN_TOTAL_LOOSE)) & F.col("num").isNotNull())
    grand = totals.withColumn("grand", F.exists("path", lambda t: label_matches_title(F.col("label"), t))).withColumn("some", F.max("grand").over(Window.partitionBy(*_TABLE)))
    named = F.exists(title_words(F.col("title")), lambda w: F.contains(F.lower("label"), w))
    used = grand.filter("grand or not some").groupBy(*_TABLE, "title", "amount_column", "first_page").agg(F.sum("num").alias("printed"), F.count(F.lit(1)).alias("n"), F.min(named).alias("sum_shaped"))
    data = valued.filter("row_type = 'data'").groupBy(*_TABLE).agg(F.coalesce(F.sum("num"), F.lit(0)).alias("extracted"), F.count(F.lit(1)).alias("rows"))
    both = used.join(data, _TABLE, "left").fillna({"rows": 0}).withColumn("extracted", F.coalesce("extracted", F.lit(0)))
    within = F.abs(F.col("extracted") - F.col("printed")) <= rounding_slack(F.col("n"))
    name = F.concat(F.lit("Σ "), "amount_column", F.lit(" vs total impresso"))
    detail = F.format_string("%d linhas de dados, %d linha(s) de total", F.col("rows"), F.col("n"))
    return both.select(*check(name, matches(F.col("extracted"), F.col("printed")), F.col("extracted"), F.col("printed"), F.col("first_page"), detail, F.when(F.col("sum_shaped") & ~within, ERROR).otherwise(NOTICE)))


def cell_checks(rows: DataFrame, tables: DataFrame) -> DataFrame:
    """Cells of the value column that hold text: stray text is a notice, an unread number an error, many of them a notice about the table."""
    facts = rows.join(tables.select(*_TABLE, "title", "amount_column", F.element_at("pages", 1).alias("first_page")), _TABLE).select(*_TABLE, "title", "amount_column", "first_page", "page", F.explode("cells").alias("c")).filter("c.name = amount_column")
    stray = facts.filter("c.v.kind in ('stray', 'glued')").groupBy(*_TABLE, "title", "first_page", "amount_column").agg(F.count(F.lit(1)).alias("n"), F.min_by("c.v.raw", "page").alias("raw"))
    strays = stray.select(*check(F.lit("texto na coluna de valores"), F.lit(False), F.format_string("%d célula(s)", F.col("n")), F.lit("valores"), F.col("first_page"), F.format_string("a coluna '%s' apanha texto: '%s'", F.col("amount_column"), F.col("raw")), F.lit(NOTICE)))
    unread = facts.filter("c.v.kind = 'problem'").withColumn("n", F.count(F.lit(1)).over(Window.partitionBy(*_TABLE)))
    each = unread.filter(F.col("n") < MANY_PROBLEMS).select(*check(F.lit("célula não interpretada"), F.lit(False), F.format_string("p.%d: coluna de valor '%s' com célula não interpretável: '%s'", F.col("page"), F.col("amount_column"), F.col("c.v.raw")), F.lit("valor legível"), F.col("first_page"), F.lit("as somas ignoram esta célula"), F.lit(ERROR)))
    many = unread.filter(F.col("n") >= MANY_PROBLEMS).groupBy(*_TABLE, "title", "first_page", "n").agg(F.first("amount_column").alias("amount_column"))
    table = many.select(*check(F.lit("colunas desalinhadas"), F.lit(False), F.format_string("%d células ilegíveis", F.col("n")), F.lit("colunas alinhadas"), F.col("first_page"), F.format_string("a coluna '%s' mistura texto e valores", F.col("amount_column")), F.lit(NOTICE)))
    return strays.unionByName(each).unionByName(table)


def table_checks(rows: DataFrame, tables: DataFrame) -> DataFrame:
    """All checks of the tables: groups, totals, unread cells, and notices where nothing can be verified."""
    valued = _valued(rows, tables)
    facts = valued.groupBy(*_TABLE, "title", "first_page").agg(F.sum((F.col("row_type") == "data").cast("int")).alias("data"), F.sum(((F.col("row_type") == "data") & F.col("num").isNotNull()).cast("int")).alias("readable"), F.coalesce(F.sum(F.when(F.col("row_type") == "data", F.col("num"))), F.lit(0)).alias("total"))
    readable = valued.join(facts.filter("readable > 0").select(*_TABLE), _TABLE, "left_semi")
    proofs = group_checks(readable).unionByName(total_checks(readable))
    silent = facts.filter("readable = 0").select(*check(F.lit("soma verificável"), F.lit(False), F.format_string("%d linha(s) sem valor", F.col("data")), F.lit("≥1 valor legível"), F.col("first_page"), F.lit("nada para somar contra os totais"), F.lit(NOTICE)))
    alone = facts.filter("readable > 0").join(proofs.select(*_TABLE).distinct(), _TABLE, "left_anti")
    unproved = alone.select(*check(F.lit("total impresso"), F.lit(False), F.col("total"), F.lit("—"), F.col("first_page"), F.lit("a tabela não imprime nenhum total legível nesta coluna"), F.lit(NOTICE)))
    return reduce(DataFrame.unionByName, [proofs, silent, unproved, cell_checks(rows, tables)])


def cross_checks(rows: DataFrame, tables: DataFrame) -> DataFrame:
    """A summary row against the one table of its account whose title it names: a theta join among an account's tables."""
    valued = _valued(rows, tables)
    detail = valued.filter("row_type = 'data'").groupBy(*_TABLE).agg(F.coalesce(F.sum("num"), F.lit(0)).alias("extracted"), F.count(F.lit(1)).alias("n"))
    targets = tables.join(detail, _TABLE).select("doc_id", F.coalesce("account", F.lit("")).alias("acc"), F.col("table_no").alias("target"), F.col("title").alias("target_title"), F.col("amount_column").alias("target_column"), "extracted", "n")
    labels = valued.join(tables.select(*_TABLE, F.coalesce("account", F.lit("")).alias("acc")), _TABLE).select(*_TABLE, "acc", "row_no", "page", "title", "cells", strip(F.coalesce(F.nullif("label", F.lit("")), "description")).alias("lab")).filter("lab <> ''")
    hits = labels.join(targets, ["doc_id", "acc"]).filter(F.col("table_no") != F.col("target")).filter(label_matches_title(F.col("lab"), F.col("target_title")))
    single = hits.withColumn("k", F.count(F.lit(1)).over(Window.partitionBy(*_TABLE, "row_no"))).filter("k = 1").withColumn("num", number_in(F.col("cells"), F.col("target_column"))).filter("num is not null")
    text = F.format_string("resumo '%s' em '%s' p.%d vs %d linhas do detalhe", F.col("lab"), F.substring("title", 1, 34), F.col("page"), F.col("n"))
    return single.select(*check(F.lit("detalhe vs linha de resumo"), matches(F.col("extracted"), F.col("num"), rounding_slack(F.col("n"))), F.col("extracted"), F.col("num"), F.col("page"), text, F.lit(NOTICE), F.col("target_title"), F.col("target")))


def note_checks(assigned: DataFrame, tables: DataFrame) -> DataFrame:
    """Blocks that became no table, tables without a numeric column, and refined value columns: notices."""
    dropped = dropped_tables(assigned, tables).select(*check(F.lit("tabela ignorada"), F.lit(False), F.col("note"), F.lit("—"), F.col("page"), F.col("note"), F.lit(NOTICE), table_no=F.lit(None)))
    skipped = assigned.filter("note is not null").select(*check(F.lit("bloco ignorado"), F.lit(False), F.col("note"), F.lit("—"), F.col("page"), F.col("note"), F.lit(NOTICE), table_no=F.lit(None)))
    moved = tables.filter("refine_note is not null").select(*check(F.lit("coluna de valor"), F.lit(False), F.col("refine_note"), F.lit("—"), F.element_at("pages", 1), F.col("refine_note"), F.lit(NOTICE)))
    return skipped.unionByName(dropped).unionByName(moved)


def table_states(tables: DataFrame, checks: DataFrame) -> DataFrame:
    """Per table: passed and total checks and one of four states."""
    facts = checks.filter("table_no is not null").groupBy(*_TABLE).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("passed").cast("int")).alias("n_passed"), F.max(fatal()).alias("fatal"))
    joined = tables.join(facts, _TABLE, "left").fillna({"n": 0, "n_passed": 0, "fatal": False})
    state = F.when(F.col("fatal"), "não conciliado").when(F.col("n_passed") == 0, "não verificável").when(F.col("n_passed") == F.col("n"), "conciliado").otherwise("parcial")
    return joined.withColumn("state", state)


def counters(checks: DataFrame) -> DataFrame:
    """Per document: checks passed, fatal and warned."""
    return checks.groupBy("doc_id").agg(F.count_if("passed").alias("passed"), F.count_if(fatal()).alias("fatal"), F.count_if(~F.col("passed") & ~fatal()).alias("warnings"))
