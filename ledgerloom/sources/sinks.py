"""Outputs: sheets as DataFrames, CSV and JSON, a workbook without third-party libraries, the structure report, the commit protocol."""

from __future__ import annotations

import csv
import io
import re
import zipfile
from datetime import date
from decimal import Decimal
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.text import mask_digits
from ledgerloom.operators.export import MOVEMENT_COLUMNS, POSITION_COLUMNS, code_table, field_mapping
from ledgerloom.operators.reconcile import fatal, formatted
from ledgerloom.operators.tables import number_in

#: Rows of one sheet at most: a workbook's own limit. Larger sheets are written as CSV.
SHEET_ROWS = 1_048_575


def printed_totals(rows: DataFrame, tables: DataFrame) -> DataFrame:
    key = ["doc_id", "table_no"]
    joined = rows.filter("row_type = 'total'").join(tables.select(*key, "title", "account", "amount_column"), key).withColumn("value", number_in(F.col("cells"), F.col("amount_column")))
    return joined.filter("value is not null").select("doc_id", "title", "account", "page", F.coalesce(F.nullif("label", F.lit("")), "description").alias("label"), "value")


def table_index(states: DataFrame, rows: DataFrame) -> DataFrame:
    key = ["doc_id", "table_no"]
    valued = rows.join(states.select(*key, "amount_column"), key).withColumn("num", number_in(F.col("cells"), F.col("amount_column")))
    facts = valued.groupBy(*key).agg(F.count_if(F.col("row_type") == "data").alias("data_rows"), F.coalesce(F.sum(F.when(F.col("row_type") == "data", F.col("num"))), F.lit(0)).alias("sum"))
    pages = F.when(F.size("pages") > 1, F.concat_ws("-", F.element_at("pages", 1).cast("string"), F.element_at("pages", -1).cast("string"))).otherwise(F.element_at("pages", 1).cast("string"))
    return states.join(facts, key, "left").select(*key, "table_id", "title", "account", pages.alias("pages"), "data_rows", "amount_column", "sum", F.concat_ws("/", F.col("n_passed").cast("string"), F.col("n").cast("string")).alias("checks"), "state")


def raw_table(rows: DataFrame, table_id: int, doc_id: str) -> DataFrame:
    """One table in wide form."""
    one = rows.filter((F.col("doc_id") == doc_id) & (F.col("table_no") == table_id))
    long = one.select("row_no", "row_type", F.col("group").alias("grupo"), "description", "page", "source_text", F.explode("cells").alias("c")).select("row_no", "row_type", "grupo", "description", "page", "source_text", "c.name", F.coalesce(F.col("c.v.num").cast("string"), F.col("c.v.raw")).alias("v"))
    return long.groupBy("row_no", "row_type", "grupo", "description", "page", "source_text").pivot("name").agg(F.first("v")).orderBy("row_no")


def ordered_checks(checks: DataFrame) -> DataFrame:
    rank = F.when(fatal(), 0).when(~F.col("passed"), 1).otherwise(2)
    state = F.when(F.col("passed"), "PASS").when(F.col("severity") == "erro", "FAIL").otherwise("AVISO")
    return checks.withColumn("rank", rank).withColumn("state", state).withColumn("line", formatted()).orderBy("rank", "section", "name", "page")


def with_total(rows: DataFrame, fields: list[str]) -> DataFrame:
    """A TOTAL row before the others, summing ``fields``; ordered by the column _seq."""
    first = next(c for c in rows.columns if c not in fields)
    sums = rows.agg(*[F.sum(f).cast(dict(rows.dtypes)[f]).alias(f) for f in fields]).withColumn(first, F.lit("TOTAL")).withColumn("_seq", F.lit(0))
    return sums.unionByName(rows.withColumn("_seq", F.lit(1)).withColumn(first, F.col(first).cast("string")), allowMissingColumns=True).select("_seq", *rows.columns)


def sheets(run) -> dict[str, DataFrame]:
    """Every sheet of the workbook, in order."""
    out: dict[str, DataFrame] = {"Capa": run.cover()}
    for mode, rows in run.positions.items():
        out[f"POSICOES {mode}"] = with_total(rows.select(*POSITION_COLUMNS), ["VLR_BRUTO_MOEDA_ORIGINAL"])
    out["MOVIMENTOS"] = with_total(run.movements.select(*MOVEMENT_COLUMNS), ["VALOR"])
    spark = run.rows.sparkSession
    codes = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(code_table())], "seq int, tipo string, codigo string")
    out["De-para"] = field_mapping(run.positions["nao"], "POSICOES").unionByName(field_mapping(run.movements, "MOVIMENTOS"))
    out["Códigos"] = codes
    out |= {name: df.drop("doc_id", "table_no", "row_no") for name, df in run.datasets.items()}
    out["Reconciliação"] = ordered_checks(run.checks).select("state", "section", "name", "extracted", "expected", "page", "detail")
    out["Totais impressos"] = printed_totals(run.rows, run.tables)
    out["Tabelas do documento"] = table_index(run.states, run.rows)
    return out


def sheet_name(used: set[str], base: str) -> str:
    """A valid name of at most 31 characters that no other sheet has (regardless of case)."""
    plain = re.sub(r"[\[\]:*?/\\]", " ", base).strip()[:31] or "Folha"
    name, n = plain, 2
    while name.casefold() in used:
        tail = f" ({n})"
        name, n = plain[: 31 - len(tail)] + tail, n + 1
    used.add(name.casefold())
    return name


def _cell(value: object) -> str:
    if value is None:
        return "<c/>"
    if isinstance(value, bool):
        return f'<c t="b"><v>{int(value)}</v></c>'
    if isinstance(value, (int, float, Decimal)):
        return f"<c><v>{value}</v></c>"
    text = value.isoformat() if isinstance(value, date) else str(value)
    text = re.sub(r"[\x00-\x08\x0b\x0c\x0e-\x1f]", "", text)
    return f'<c t="inlineStr"><is><t xml:space="preserve">{escape(text)}</t></is></c>'


def write_workbook(path: str, content: dict[str, DataFrame]) -> None:
    """An .xlsx of the sheets (OOXML by the standard library); a workbook is for one statement or a small report."""
    used: set[str] = set()
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as book:
        names = []
        for i, (title, df) in enumerate(content.items(), start=1):
            names.append(sheet_name(used, title))
            rows = df.limit(SHEET_ROWS + 1).collect()
            if len(rows) > SHEET_ROWS:
                raise ValueError(f"{title}: more rows than a sheet holds; write it as CSV")
            body = ["<row>" + "".join(_cell(c) for c in df.columns) + "</row>", *("<row>" + "".join(_cell(v) for v in r) + "</row>" for r in rows)]
            book.writestr(f"xl/worksheets/sheet{i}.xml", f'<?xml version="1.0" encoding="UTF-8"?><worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>{"".join(body)}</sheetData></worksheet>')
        tags = "".join(f'<sheet name="{escape(n, {chr(34): "&quot;"})}" sheetId="{i}" r:id="rId{i}"/>' for i, n in enumerate(names, start=1))
        book.writestr("xl/workbook.xml", f'<?xml version="1.0" encoding="UTF-8"?><workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets>{tags}</sheets></workbook>')
        links = "".join(f'<Relationship Id="rId{i}" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(names) + 1))
        book.writestr("xl/_rels/workbook.xml.rels", f'<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{links}</Relationships>')
        book.writestr("_rels/.rels", '<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        kinds = "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for i in range(1, len(names) + 1))
        book.writestr("[Content_Types].xml", f'<?xml version="1.0" encoding="UTF-8"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>{kinds}</Types>')


def orphan_pages(tables: DataFrame, page_counts: DataFrame) -> DataFrame:
    """Pages of each document that no table touches."""
    every = page_counts.select("doc_id", F.explode(F.sequence(F.lit(1), F.col("page_count").cast("int"))).alias("page"))
    return every.join(tables.select("doc_id", F.explode("pages").alias("page")).distinct(), ["doc_id", "page"], "left_anti")


def structure_report(tables: DataFrame, checks: DataFrame, page_counts: DataFrame) -> DataFrame:
    """What a document looks like, without its numbers: lines in order."""
    line = F.concat_ws(" | ", mask_digits(F.col("title")), F.array_join(F.transform("pages", lambda p: p.cast("string")), ","), F.size("columns").cast("string"), mask_digits(F.coalesce("amount_column", F.lit("—"))))
    listed = tables.select("doc_id", F.lit(1).alias("part"), F.element_at("pages", 1).alias("seq"), line.alias("line"))
    lost = orphan_pages(tables, page_counts).select("doc_id", F.lit(2).alias("part"), F.col("page").alias("seq"), F.concat(F.lit("sem tabela: p."), F.col("page").cast("string")).alias("line"))
    state = F.when(F.col("passed"), "PASS").when(F.col("severity") == "erro", "FAIL").otherwise("AVISO")
    counts = checks.groupBy("doc_id", state.alias("s")).agg(F.count(F.lit(1)).alias("n")).select("doc_id", F.lit(3).alias("part"), F.lit(0).alias("seq"), F.concat_ws(" ", "s", F.col("n").cast("string")).alias("line"))
    failing = checks.filter(fatal()).select("doc_id", F.lit(4).alias("part"), F.coalesce("page", F.lit(0)).alias("seq"), F.concat_ws(" · ", mask_digits(F.col("section")), mask_digits(F.col("name"))).alias("line"))
    return listed.unionByName(lost).unionByName(counts).unionByName(failing).withColumn("no", F.row_number().over(Window.partitionBy("doc_id").orderBy("part", "seq", "line")))


def write_csv(df: DataFrame, path: str) -> None:
    """Distributed CSV with a header; arrays and structs become JSON."""
    flat = [F.to_json(c).alias(c) if t.startswith(("array", "struct", "map")) else F.col(c) for c, t in df.dtypes]
    df.select(*flat).write.mode("errorifexists").option("header", True).csv(path)


def to_csv_text(df: DataFrame) -> str:
    """A small DataFrame as CSV text."""
    out = io.StringIO()
    writer = csv.writer(out)
    writer.writerow(df.columns)
    writer.writerows(df.collect())
    return out.getvalue()


def commit_path(path: str, failed: int, strict: bool = False) -> str | None:
    """Where an output may go: nowhere if strict and something failed, else marked as partial."""
    if not failed:
        return path
    if strict:
        return None
    stem, dot, suffix = path.rpartition(".")
    return f"{stem}.PARTIAL.{suffix}" if dot and "/" not in suffix else f"{path}.PARTIAL"
