"""Layout of a statement: body band, accounts, period, sections and their columns; and the validation of a layout given by hand."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.dates import PERIOD, YEAR, period
from ledgerloom.functions.text import account_label, account_number, fingerprint, slug, strip

from .ordered import cell, column_bands
from .tables import median_size

#: Titles of sections (fixed values; pass others to change them).
SECTION_TITLES = {
    "holdings": [r"^(Portfolio\s+)?Holdings\b", r"^Investment\s+Holdings\b", r"^Security\s+Holdings\b", r"^Asset\s+Detail\b"],
    "activity": [r"^(Account\s+)?Activity\b", r"^Cash\s+Flow\s+Activity\b", r"^Transaction\s+(Detail|History)\b"],
    "income": [r"^Income\b", r"^Dividends?\s+and\s+Interest\b", r"^Interest\s+and\s+Dividends?\b"],
    "fees": [r"^Fees\b", r"^Fees\s+and\s+Charges\b", r"^Charges\s+and\s+Expenses\b", r"^Advisory\s+Fees\b"],
}
REPEAT_RATIO, EDGE_ZONE, ACCOUNT_ZONE, TITLE_CHARS, TITLE_LEFT, HEADER_CHARS, HEADER_CELL = 0.8, 0.12, 0.25, 80, 60.0, 90, 22


class LayoutError(ValueError):
    """A layout that cannot be used, with everything that is wrong with it."""


def body_band(lines: DataFrame, heights: DataFrame) -> DataFrame:
    """Per document: top and bottom of the body: lines that most pages repeat at their edges, and account headers, are outside."""
    joined = lines.join(heights.select("doc_id", "page", "height"), ["doc_id", "page"]).withColumn("print", fingerprint(F.col("text")))
    pages = heights.groupBy("doc_id").agg(F.countDistinct("page").alias("pages"))
    repeated = joined.groupBy("doc_id", "print").agg(F.countDistinct("page").alias("n")).join(pages, "doc_id").filter(F.col("n") >= F.greatest(F.lit(2), F.bround(F.col("pages") * REPEAT_RATIO))).select("doc_id", "print", F.lit(True).alias("repeats"))
    marked = joined.join(repeated, ["doc_id", "print"], "left")
    head = (F.col("repeats") & (F.col("bottom") < F.col("height") * EDGE_ZONE)) | (account_number(F.col("text")).isNotNull() & (F.col("top") < F.col("height") * ACCOUNT_ZONE))
    foot = F.col("repeats") & (F.col("top") > F.col("height") * (1 - EDGE_ZONE))
    return marked.groupBy("doc_id").agg((F.max(F.when(head, F.col("bottom"))) + 1).alias("band_top"), (F.min(F.when(foot, F.col("top"))) - 1).alias("band_bottom"))


def accounts(lines: DataFrame, heights: DataFrame) -> DataFrame:
    """Per document and account: label and pages, by the first account number in each page's upper quarter."""
    joined = lines.join(heights.select("doc_id", "page", "height"), ["doc_id", "page"])
    before = F.lag("text").over(Window.partitionBy("doc_id", "page").orderBy("line_no"))
    hits = joined.withColumn("before", before).withColumn("account", account_number(F.col("text"))).filter(F.col("account").isNotNull() & (F.col("top") < F.col("height") * ACCOUNT_ZONE))
    first = hits.groupBy("doc_id", "page").agg(F.min_by(F.struct("account", "before", "text"), "line_no").alias("h"))
    named = first.select("doc_id", "page", "h.account", F.coalesce(account_label(F.coalesce("h.before", F.lit(""))), account_label(F.col("h.text")), F.lit("")).alias("label"))
    return named.groupBy("doc_id", "account").agg(F.min_by("label", "page").alias("label"), F.sort_array(F.collect_set("page")).alias("pages"))


def statement_period(lines: DataFrame) -> DataFrame:
    """Per document: year, start, end from the first lines of the first two pages."""
    page = F.dense_rank().over(Window.partitionBy("doc_id").orderBy("page"))
    early = lines.withColumn("_p", page).filter("_p <= 2 and line_no < 6")
    full, bare = F.rlike("text", F.lit(PERIOD)), F.regexp_extract("text", YEAR, 1)
    found = early.groupBy("doc_id").agg(F.min_by(F.when(full, period(F.col("text"))), F.when(full, F.struct("page", "line_no"))).alias("p"), F.min_by(F.when(bare != "", bare.try_cast("int")), F.when(bare != "", F.struct("page", "line_no"))).alias("y"))
    return found.select("doc_id", F.coalesce("p.year", "y").alias("statement_year"), F.col("p.start").alias("period_start"), F.col("p.end").alias("period_end"))


def section_ranges(hits: DataFrame, last_page: str = "page_count") -> DataFrame:
    """Pages of each section from title hits (doc_id, account, seq, page, section): up to the page before the next title."""
    order = Window.partitionBy("doc_id", "account").orderBy("seq")
    runs = hits.withColumn("_same", F.lag("section").over(order) == F.col("section")).filter("not coalesce(_same, false)")
    first = runs.withColumn("_n", F.row_number().over(Window.partitionBy("doc_id", "account", "section").orderBy("seq")))
    ended = first.withColumn("_next", F.lead("page").over(order)).filter("_n = 1")
    end = F.greatest(F.col("page"), F.coalesce(F.col("_next") - 1, F.col(last_page)))
    return ended.select("doc_id", "account", "section", F.col("page").alias("first_page"), end.alias("last_page"), F.sequence("page", end).alias("pages"))


def section_hits(lines: DataFrame, page_accounts: DataFrame, titles: dict[str, list[str]] = SECTION_TITLES) -> DataFrame:
    """Prominent short lines that a section's pattern matches: doc_id, account, seq, page, section, page_count."""
    shape = lines.groupBy("doc_id").agg(F.max("page").alias("page_count")).join(median_size(lines), "doc_id", "left").fillna({"median": 0.0})
    text = strip(F.col("text"))
    section = F.coalesce(*[F.when(F.exists(F.array(*[F.rlike(text, F.lit(f"(?i){p}")) for p in patterns]), lambda x: x), name) for name, patterns in titles.items()])
    joined = lines.join(shape, "doc_id").join(page_accounts, ["doc_id", "page"], "left").withColumn("section", section)
    bold = F.exists("words", lambda w: (w["size"] > F.col("median") + 0.5) | F.contains(F.lower(w["fontname"]), F.lit("bold")))
    shown = joined.filter(F.col("section").isNotNull() & (F.length(text) <= TITLE_CHARS) & (F.coalesce(bold, F.lit(False)) | (F.col("x0") < TITLE_LEFT)))
    order = Window.partitionBy("doc_id").orderBy("page", "line_no")
    return shown.select("doc_id", F.coalesce("account", F.lit("")).alias("account"), F.row_number().over(order).alias("seq"), "page", "section", "page_count")


def section_columns(lines: DataFrame, ranges: DataFrame) -> DataFrame:
    """Columns of each section from strict amounts in its lines, named by the line that covers most of them."""
    here = lines.join(ranges.select("doc_id", "section", F.explode("pages").alias("page")).distinct(), ["doc_id", "page"])
    tokens = here.select("doc_id", "section", F.explode(F.filter("words", lambda w: w["tab"])).alias("w")).select("doc_id", "section", "w.x0", "w.x1")
    bands = column_bands(tokens, ["doc_id", "section"]).groupBy("doc_id", "section").agg(F.sort_array(F.collect_list(F.struct("band", "x0", "x1"))).alias("bands"))
    plain = here.filter(~F.exists("words", lambda w: w["tab"]) & (F.length("text") <= HEADER_CHARS)).join(bands, ["doc_id", "section"])
    cells = plain.withColumn("cells", F.transform("bands", lambda b: cell(F.col("words"), b["x0"] - 12.0, b["x1"] + 12.0)))
    covered = F.size(F.filter("cells", lambda c: (c != "") & (F.length(c) <= HEADER_CELL)))
    best = cells.groupBy("doc_id", "section").agg(F.max_by("cells", F.struct(covered, -F.col("page"), -F.col("top"))).alias("cells"))
    left = here.groupBy("doc_id", "section").agg(F.min("x0").alias("left"))
    joined = bands.join(best, ["doc_id", "section"], "left").join(left, ["doc_id", "section"])

    def column(b, i):
        text = F.get(F.col("cells"), i)
        name = F.when(F.coalesce(text, F.lit("")) == "", F.concat(F.lit("col_"), (i + 1).cast("string"))).otherwise(slug(text))
        return F.struct(name.alias("name"), b["x0"].alias("x0"), b["x1"].alias("x1"), F.lit("amount").alias("type"), F.lit(True).alias("optional"))

    described = F.array(F.struct(F.lit("description").alias("name"), (F.col("left") - 3.0).alias("x0"), F.get("bands", F.lit(0))["x0"].alias("x1"), F.lit("text").alias("type"), F.lit(False).alias("optional")))
    return joined.select("doc_id", "section", F.concat(described, F.transform("bands", column)).alias("columns"))


def shared_pages(account_rows: DataFrame) -> DataFrame:
    """Pages that more than one account claims: doc_id, page, n."""
    return account_rows.select("doc_id", "account", F.explode("pages").alias("page")).groupBy("doc_id", "page").agg(F.countDistinct("account").alias("n")).filter("n > 1")


def column_faults(columns: DataFrame) -> DataFrame:
    """Columns (keys doc_id, section, name, x0, x1) that are inverted, repeat a name or overlap the one before."""
    order = Window.partitionBy("doc_id", "section").orderBy("x0", "x1", "name")
    same = Window.partitionBy("doc_id", "section", "name")
    flagged = columns.withColumn("prev", F.lag("x1").over(order)).withColumn("n", F.count(F.lit(1)).over(same))
    fault = F.when(F.col("x1") <= F.col("x0"), "inverted").when(F.col("n") > 1, "repeated").when(F.col("x0") < F.col("prev") - 0.01, "overlap")
    return flagged.withColumn("fault", fault).filter("fault is not null").select("doc_id", "section", "name", "fault")


def validate(layout: dict) -> dict:
    """Raise LayoutError unless the layout has version 2, sections with pages and columns, disjoint accounts and sound columns."""
    faults = []
    if layout.get("version") != 2:
        faults.append("version must be 2")
    if not isinstance(layout.get("sections"), dict):
        raise LayoutError("; ".join([*faults, "sections must be an object"]))
    pages: dict[int, str] = {}
    ids = [a.get("id") for a in layout.get("accounts") or []]
    if len(ids) != len(set(ids)):
        faults.append("an account id repeats")
    for account in layout.get("accounts") or []:
        for page in account.get("pages") or []:
            if pages.setdefault(page, account["id"]) != account["id"]:
                faults.append(f"page {page} belongs to two accounts")
    for name, spec in layout["sections"].items():
        if not spec.get("present", True):
            continue
        if not spec.get("pages") or not spec.get("columns"):
            faults.append(f"section {name}: pages and columns are needed")
            continue
        names = [c.get("name") for c in spec["columns"]]
        if len(names) != len(set(names)):
            faults.append(f"section {name}: a column repeats")
        if any(k not in c for c in spec["columns"] for k in ("name", "x0", "x1", "type")):
            faults.append(f"section {name}: columns need name, x0, x1, type")
            continue
        edge = None
        for c in sorted(spec["columns"], key=lambda c: c["x0"]):
            if c["x1"] <= c["x0"] or (edge is not None and c["x0"] < edge - 0.01):
                faults.append(f"section {name}: column {c['name']} is inverted or overlaps")
            edge = c["x1"]
    if faults:
        raise LayoutError("; ".join(faults))
    return layout


def build_layout(lines: DataFrame, heights: DataFrame, titles: dict[str, list[str]] = SECTION_TITLES) -> dict[str, DataFrame]:
    """Everything a layout holds, per document: band, accounts, period, sections with pages and columns."""
    account_rows = accounts(lines, heights)
    page_accounts = account_rows.select("doc_id", "account", F.explode("pages").alias("page"))
    ranges = section_ranges(section_hits(lines, page_accounts, titles))
    return {"band": body_band(lines, heights), "accounts": account_rows, "period": statement_period(lines), "sections": ranges, "columns": section_columns(lines, ranges)}
