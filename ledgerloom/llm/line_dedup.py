"""Operator 1: line dedup by distinct-site spread, in DataFrame functions only.

A HyperLogLog sketch of the sites on which a line occurs is aggregated per line hash (sketches merge on
the map side, so a line that half the corpus shares costs a row per task). Lines whose estimate is near
the limit get an exact distinct count; lines that at least ``min_sites`` sites share are boilerplate and
go from every document, wherever they stand.

Defined results: lines are separated by \\n and compared without surrounding white space; blank lines are
never removed; a null text stays null and has no lines; a null site counts for no site; a null key is a key like
others; repeated rows are judged alike; extra columns stay as they are, of whatever name; a text of any length is split in
one row, and its lines travel as hashes; an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import free_name, free_prefix, materialise

#: Production parameters: sites that make a line boilerplate; sketch size (standard error 1.6 %); estimates
#: within this share of the limit are counted exactly (over ten standard errors).
MIN_SITES, LOG_K, MARGIN = 10, 12, 0.25
_SPACES = " \t\n\x0b\x0c\r"


def _line_key(line: Column) -> Column:
    """96 bits of hash."""
    return F.struct(F.xxhash64(line).alias("a"), F.hash(line).alias("b"))


def _trimmed(text: Column) -> Column:
    return F.transform(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(_SPACES)))


def _row_key(key: str, text: str) -> Column:
    """128 bits of hash."""
    return F.struct(F.xxhash64(F.col(key), F.col(text)).alias("a"), F.xxhash64(F.col(text), F.col(key), F.lit(1)).alias("b"))


def _keyed_lines(docs: DataFrame, key: str, text: str, site: str) -> DataFrame:
    line = docs.filter(F.col(text).isNotNull()).select(_row_key(key, text).alias("doc"), F.col(site).cast("string").alias("site"), F.posexplode(_trimmed(F.col(text))).alias("pos", "line"))
    return line.filter(F.col("line") != "").select("doc", "site", "pos", _line_key(F.col("line")).alias("k")).select("doc", "site", "pos", "k.a", "k.b")


def boilerplate(lines: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """Hashes (a, b) of the lines that at least ``min_sites`` sites share."""
    spread = lines.groupBy("a", "b").agg(F.hll_sketch_agg("site", F.lit(LOG_K)).alias("sketch"))
    rough = materialise(spread.withColumn("sites", F.hll_sketch_estimate("sketch")).filter(F.col("sites") >= (1 - MARGIN) * min_sites).drop("sketch"), "line-spread")
    sure = rough.filter(F.col("sites") > (1 + MARGIN) * min_sites).select("a", "b")
    near = rough.filter(F.col("sites") <= (1 + MARGIN) * min_sites).select("a", "b")
    exact = lines.select("a", "b", "site").join(near, ["a", "b"], "left_semi").distinct().groupBy("a", "b").agg(F.count("site").alias("n"))
    return sure.unionByName(exact.filter(F.col("n") >= min_sites).select("a", "b"))


def remove_boilerplate(docs: DataFrame, key: str = "doc_id", text: str = "text", site: str = "source", min_sites: int = MIN_SITES) -> DataFrame:
    """``docs`` without boilerplate lines in ``text``, and the columns n_lines and n_removed (blank lines not counted)."""
    lines = _keyed_lines(docs, key, text, site)
    gone = lines.select("doc", "pos", "a", "b").join(boilerplate(lines, min_sites), ["a", "b"], "left_semi")
    marks = gone.groupBy("doc").agg(F.collect_set("pos").alias("gone"))
    doc, (n_lines, n_removed) = free_prefix(docs.columns, "doc_key"), (free_name(docs.columns, c) for c in ("n_lines", "n_removed"))
    marks = marks.select(F.col("doc").alias(doc), F.col("gone").alias(f"{doc}_gone"))
    joined = docs.withColumn(doc, _row_key(key, text)).join(marks, doc, "left")
    none = F.col(f"{doc}_gone").isNull() | F.col(text).isNull()
    left = F.array_join(F.filter(F.split(text, "\n"), lambda x, i: ~F.array_contains(f"{doc}_gone", i)), "\n")
    full = F.size(F.filter(F.split(F.coalesce(F.col(text), F.lit("")), "\n"), lambda x: F.btrim(x, F.lit(_SPACES)) != ""))
    return joined.withColumns({text: F.when(none, F.col(text)).otherwise(left), n_lines: full.cast("long"), n_removed: F.when(none, F.lit(0)).otherwise(F.size(f"{doc}_gone")).cast("long")}).drop(doc, f"{doc}_gone")
