"""Where words come from. The engine starts at a table of positioned words; a PDF reader is optional."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_KINDS = {"doc_id": T.StringType(), "page": T.IntegerType(), "text": T.StringType(), "fontname": T.StringType(), "upright": T.BooleanType()}
WORDS = T.StructType([T.StructField(n, _KINDS.get(n, T.DoubleType())) for n in ("doc_id", "page", "text", "x0", "x1", "top", "bottom", "size", "fontname", "upright")])


class ScannedDocumentError(ValueError):
    """Too few pages have text: the document is a picture."""


def read_words(spark: SparkSession, path: str, fmt: str = "parquet", keep_rotated: bool = False, pages: list[int] | None = None) -> DataFrame:
    """The words table; filters on pages and rotated text reach the scan."""
    words = spark.read.schema(WORDS).format(fmt).load(path)
    return select_words(words, keep_rotated=keep_rotated, pages=pages)


def select_words(words: DataFrame, *, top: float | None = None, bottom: float | None = None, keep_rotated: bool = False, pages: list[int] | None = None) -> DataFrame:
    """Words inside a band, on some pages, without rotated ones."""
    out = words if keep_rotated else words.filter(F.coalesce("upright", F.lit(True)))
    out = out if top is None else out.filter(F.col("top") >= top)
    out = out if bottom is None else out.filter(F.col("bottom") <= bottom)
    return out if pages is None else out.filter(F.col("page").isin(pages))


def text_layer(pages: DataFrame) -> DataFrame:
    """Per document of ``pages`` (doc_id, page, text): page_count, pages_with_text, chars_total, ratio."""
    n = F.length(F.regexp_replace(F.coalesce("text", F.lit("")), r"(?U)^\s+|\s+$", ""))
    facts = pages.groupBy("doc_id").agg(F.count(F.lit(1)).alias("page_count"), F.sum((n > 0).cast("long")).alias("pages_with_text"), F.sum(n.cast("long")).alias("chars_total"))
    return facts.withColumn("ratio", F.when(F.col("page_count") > 0, F.col("pages_with_text") / F.col("page_count")).otherwise(0.0))


def page_texts(words: DataFrame) -> DataFrame:
    """Every page up to a document's last one with its text, which may be empty: doc_id, page, text."""
    every = words.groupBy("doc_id").agg(F.max("page").alias("last")).select("doc_id", F.explode(F.sequence(F.lit(1), "last")).alias("page"))
    texts = words.groupBy("doc_id", "page").agg(F.array_join(F.collect_list("text"), " ").alias("text"))
    return every.join(texts, ["doc_id", "page"], "left")


def assert_text_layer(report: DataFrame, least: float = 0.5) -> None:
    """Raise if a document has no text or text on too few pages."""
    bad = report.filter((F.col("pages_with_text") == 0) | (F.col("ratio") < least)).limit(20).collect()
    if bad:
        raise ScannedDocumentError("; ".join(f"{r['doc_id']}: {r['pages_with_text']} of {r['page_count']} pages have text" for r in bad))


def sample_words(words: DataFrame, page: int, limit: int = 60) -> DataFrame:
    """The first words of a page, rounded, to look at."""
    return words.filter(F.col("page") == page).orderBy("top", "x0").limit(limit).select("text", *(F.round(c, 1).alias(c) for c in ("x0", "x1", "top", "bottom", "size")))


def read_json(spark: SparkSession, path: str) -> dict:
    """A small side input (layout, clients, funds, answers) through Spark's own file systems."""
    rows = spark.read.text(path, wholetext=True).collect()
    return json.loads(rows[0][0]) if rows else {}


def clients_table(spark: SparkSession, clients: dict) -> DataFrame:
    """account, idcliente, nome; keys that begin with an underscore are comments."""
    rows = [(k, v.get("idcliente"), v.get("nome")) for k, v in clients.items() if not k.startswith("_")]
    return spark.createDataFrame(rows, "account string, idcliente string, nome string")


def funds_table(spark: SparkSession, funds: dict) -> DataFrame:
    """idativo, nome, holdings: the portfolios of exclusive funds."""
    fields = ("idativo", "descricao", "classe", "valor", "quantidade", "pu", "custo")
    rows = [(k, v.get("nome"), [tuple(None if h.get(f) is None else str(h[f]) for f in fields) for h in v.get("carteira") or []]) for k, v in funds.items() if not k.startswith("_")]
    return spark.createDataFrame(rows, "idativo string, nome string, holdings array<struct<idativo:string,descricao:string,classe:string,valor:string,quantidade:string,pu:string,custo:string>>")


def expected_for(answers: dict, document: str) -> dict:
    """The answers of the statement with the same file name."""
    statements = answers.get("statements") or {}
    if not statements:
        raise ValueError("no statements among the answers")
    base = document.replace("\\", "/").rpartition("/")[2]
    return next((v for k, v in statements.items() if k.rpartition("/")[2] == base), {})


def read_pdf_words(spark: SparkSession, path: str) -> DataFrame:
    """Words of PDF files, where an optional text extractor is installed on the executors."""

    def extract(batches):
        import io

        import pandas as pd
        import pdfplumber  # optional dependency

        for files in batches:
            for name, content in zip(files["path"], files["content"], strict=True):
                rows = []
                with pdfplumber.open(io.BytesIO(content)) as pdf:
                    for number, page in enumerate(pdf.pages, start=1):
                        for w in page.extract_words(extra_attrs=["size", "fontname"]):
                            rows.append((name, number, w["text"], w["x0"], w["x1"], w["top"], w["bottom"], w["size"], w["fontname"], bool(w.get("upright", True))))
                yield pd.DataFrame(rows, columns=WORDS.names)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(extract, WORDS)
