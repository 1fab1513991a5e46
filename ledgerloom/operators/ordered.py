"""Ordered dataflow: words to lines, lines to records, tokens to columns. Keys of every document stay in one window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.amounts import is_tabular_number
from ledgerloom.functions.text import is_blank, strip

Y_TOLERANCE, COLUMN_GAP, COLUMN_PAD = 2.5, 8.0, 3.0


def anchored_groups(items: Column, position: str, tolerance: float) -> Column:
    """Fold a sorted array of structs: an item joins the last group if it is within ``tolerance`` of the group's least position."""

    # the fold keeps where groups begin; the items are cut afterwards, so no item is copied twice
    def step(state: Column, item: Column) -> Column:
        joins = (state["at"] > 0) & (F.abs(item[position] - state["low"]) <= tolerance)
        low = F.when(joins, F.least(state["low"], item[position])).otherwise(item[position])
        return F.struct((state["at"] + 1).alias("at"), low.alias("low"), F.when(joins, state["starts"]).otherwise(F.concat(state["starts"], F.array(state["at"]))).alias("starts"))

    begin = F.struct(F.lit(0).alias("at"), F.lit(0.0).alias("low"), F.array().cast("array<int>").alias("starts"))
    starts = F.aggregate(items, begin, step, lambda s: s["starts"])

    def group(start: Column, end: Column) -> Column:
        mine = F.slice(items, start + 1, F.coalesce(end, F.size(items)) - start)
        return F.struct(F.array_min(F.transform(mine, lambda x: x[position])).alias("low"), mine.alias("items"))

    return F.get(F.transform(F.array(starts), lambda s: F.zip_with(s, F.slice(s, F.lit(2), F.greatest(F.size(s), F.lit(1))), group)), F.lit(0))


def lines(words: DataFrame, y_tolerance: float = Y_TOLERANCE) -> DataFrame:
    """Visual lines of each page: doc_id, page, line_no, top, bottom, x0, x1, text, words (by x0, with token flags)."""
    text = F.col("text")
    flagged = words.withColumn("tab", F.coalesce(is_tabular_number(text), F.lit(False)))
    flagged = flagged.withColumn("tok", F.col("tab") | F.coalesce((strip(text) != "") & is_blank(text), F.lit(False)))
    word = F.struct(F.bround("top", 2).alias("rt"), "x0", "x1", "top", "bottom", "text", "size", "fontname", "tab", "tok")
    pages = flagged.groupBy("doc_id", "page").agg(F.sort_array(F.collect_list(word)).alias("ws"))
    grouped = pages.select("doc_id", "page", F.posexplode(anchored_groups(F.col("ws"), "top", y_tolerance)).alias("line_no", "g"))
    by_x = F.transform(F.sort_array(F.transform("g.items", lambda w: F.struct(w["x0"].alias("x0"), w.alias("w")))), lambda s: s["w"])
    ordered = grouped.select("doc_id", "page", "line_no", F.col("g.low").alias("top"), by_x.alias("words"))
    return ordered.select(
        "doc_id", "page", "line_no", "top",
        F.array_max(F.transform("words", lambda w: w["bottom"])).alias("bottom"),
        F.array_min(F.transform("words", lambda w: w["x0"])).alias("x0"),
        F.array_max(F.transform("words", lambda w: w["x1"])).alias("x1"),
        F.array_join(F.transform("words", lambda w: w["text"]), " ").alias("text"), "words",
    )


def in_band(rows: DataFrame, top: Column | float | None = None, bottom: Column | float | None = None) -> DataFrame:
    """Lines inside a page's body; a null bound is open."""
    low, high = (x if isinstance(x, Column) else F.lit(x) for x in (top, bottom))
    return rows.filter((low.isNull() | (F.col("top") >= low)) & (high.isNull() | (F.col("bottom") <= high)))


def cell(words: Column, x0: Column, x1: Column, anchor: str = "center") -> Column:
    """Text of the words whose anchor lies in [x0, x1); ``words`` are ordered by x0."""

    def at(w: Column) -> Column:
        return {"center": (w["x0"] + w["x1"]) / 2, "left": w["x0"], "right": w["x1"]}[anchor]

    return F.array_join(F.transform(F.filter(words, lambda w: (at(w) >= x0) & (at(w) < x1)), lambda w: w["text"]), " ")


def records(rows: DataFrame, starts: Column, keys: list[str], order: list[str], name: str = "record_no") -> DataFrame:
    """Number records: each starting row opens one, rows before the first are orphans of record 0."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn(name, F.sum(F.coalesce(starts, F.lit(False)).cast("int")).over(window.rowsBetween(Window.unboundedPreceding, 0)))


def forward_fill(value: Column, keys: list[str], order: list[str]) -> Column:
    """The last value that is not null, up to the current row."""
    return F.last(value, ignorenulls=True).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))


def column_bands(tokens: DataFrame, keys: list[str], least: Column | int = 2, gap: float = COLUMN_GAP, pad: float = COLUMN_PAD) -> DataFrame:
    """Columns from the right edges of tokens (keys, x0, x1): clusters chained by gaps, padded, meeting half-way: keys, band, x0, x1, n."""
    by_edge = Window.partitionBy(*keys).orderBy("x1", "x0")
    apart = F.coalesce(F.col("x1") - F.lag("x1").over(by_edge) > gap, F.lit(False)).cast("int")
    chained = tokens.withColumn("_apart", apart).withColumn("_cluster", F.sum("_apart").over(by_edge.rowsBetween(Window.unboundedPreceding, 0)))
    clusters = chained.groupBy(*keys, "_cluster").agg(F.bround(F.min("x0") - pad, 2).alias("a"), F.bround(F.max("x1") + pad, 2).alias("b"), F.count(F.lit(1)).alias("n"), *([F.max(least).alias("_least")] if isinstance(least, Column) else []))
    kept = clusters.filter(F.col("n") >= (F.col("_least") if isinstance(least, Column) else F.lit(least)))
    order = Window.partitionBy(*keys).orderBy("a", "b")
    before, after = F.lag("b").over(order), F.lead("a").over(order)
    return kept.select(
        *keys, (F.row_number().over(order) - 1).alias("band"),
        F.when(before.isNull(), F.col("a")).otherwise(F.bround((before + F.col("a")) / 2, 2)).alias("x0"),
        F.when(after.isNull(), F.col("b")).otherwise(F.bround((F.col("b") + after) / 2, 2)).alias("x1"), "n",
    )


def blocks(rows: DataFrame, keys: list[str], order: str, longest_gap: int = 3) -> DataFrame:
    """Blocks of numeric lines (flags numeric, heading, prose): block, next_block, member, and what lies before the next numeric line.

    A numeric line opens a block if a heading, prose or ``longest_gap`` lines separate it from the one before;
    lines between two numeric lines of one block belong to it, lines after its last one to none.
    """
    upto = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy(*keys).orderBy(order).rowsBetween(1, Window.unboundedFollowing)
    stop = ((F.col("heading") | F.col("prose")) & ~F.col("numeric")).cast("int")
    counted = rows.withColumn("_stops", F.sum(stop).over(upto))
    last_at = F.last(F.when(F.col("numeric"), F.col(order)), ignorenulls=True).over(before)
    last_stops = F.last(F.when(F.col("numeric"), F.col("_stops")), ignorenulls=True).over(before)
    opens = F.col("numeric") & (last_at.isNull() | (F.col("_stops") > last_stops) | (F.col(order) - last_at > longest_gap))
    numbered = counted.withColumn("_opens", opens.cast("int")).withColumn("block", F.sum("_opens").over(upto))

    def ahead(value: Column) -> Column:
        return F.first(F.when(F.col("numeric"), value), ignorenulls=True).over(after)

    placed = numbered.withColumns({"next_block": ahead(F.col("block")), "next_at": ahead(F.col(order)), "next_top": ahead(F.col("top")) if "top" in rows.columns else F.lit(None).cast("double"), "next_stops": ahead(F.col("_stops"))})
    member = F.col("numeric") | F.coalesce((F.col("block") > 0) & (F.col("next_block") == F.col("block")), F.lit(False))
    between = F.coalesce(F.col("next_stops") - F.col("_stops"), F.lit(1))
    return placed.withColumn("member", member).withColumn("stops_ahead", between).drop("_opens", "_stops", "next_stops")
