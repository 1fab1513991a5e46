"""Whole runs: words in, tables, datasets, exports and checks out. Stages are tables of the shared folder, so plans stay small."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.operators import canonical, export, reconcile, sections
from ledgerloom.operators.layout import validate
from ledgerloom.operators.ordered import in_band, lines
from ledgerloom.operators.tables import assign_tables, describe_tables, extract_rows, find_blocks, promote_totals, refine_amount

from .stage import staged


@dataclass
class Run:
    """What a sweep found; failures are fatal checks, warnings the others that did not pass."""

    tables: DataFrame
    rows: DataFrame
    states: DataFrame
    checks: DataFrame
    datasets: dict[str, DataFrame]
    positions: dict[str, DataFrame]
    movements: DataFrame
    accounts: DataFrame
    summaries: DataFrame = field(repr=False)

    def failures(self) -> DataFrame:
        return self.checks.filter(reconcile.fatal())

    def warnings(self) -> DataFrame:
        return self.checks.filter(~F.col("passed") & ~reconcile.fatal())

    def cover(self) -> DataFrame:
        counts = reconcile.counters(self.checks)
        tables = self.tables.groupBy("doc_id").agg(F.count(F.lit(1)).alias("tables"))
        verdict = F.when(F.col("fatal") > 0, "PARTIAL").otherwise("OK")
        return tables.join(counts, "doc_id", "left").withColumn("verdict", verdict)


def detect(words: DataFrame, *, accounts: DataFrame | None = None, band: tuple[float | None, float | None] = (None, None), year: int | None = None, hint: str | None = None, y_tolerance: float = 2.5, layouts: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Tables, their rows and the assignment of blocks; ``accounts`` has doc_id, page, account.

    ``layouts`` gives each document its own band_top, band_bottom, statement_year and hint, in place of those for all.
    """
    rows = lines(words, y_tolerance)
    if layouts is not None:
        rows = in_band(rows.join(layouts.select("doc_id", "band_top", "band_bottom"), "doc_id", "left"), F.col("band_top"), F.col("band_bottom")).drop("band_top", "band_bottom")
    else:
        rows = in_band(rows, *band)
    placed = staged(find_blocks(rows, accounts), "blocks")
    assigned = staged(assign_tables(placed), "assigned")
    tables, body = describe_tables(placed, assigned, hint, layouts)
    tables = staged(tables, "tables")
    found = staged(promote_totals(extract_rows(tables, body, year, layouts), tables), "rows")
    return staged(refine_amount(tables, found), "refined"), found, assigned


def sweep(words: DataFrame, *, accounts: DataFrame | None = None, band: tuple[float | None, float | None] = (None, None), year: int | None = None, hint: str | None = None, collapse: bool = True, clients: DataFrame | None = None, funds: DataFrame | None = None, currency: str = "USD", period_end: str | None = None, layouts: DataFrame | None = None) -> Run:
    """Every table of every document, reconciled, canonical and exported.

    ``accounts`` has doc_id, account, label, pages; ``layouts`` is as for ``detect``, and may have period_end.
    """
    pages = accounts.select("doc_id", "account", F.explode("pages").alias("page")) if accounts is not None else None
    tables, rows, assigned = detect(words, accounts=pages, band=band, year=year, hint=hint, layouts=layouts)
    # without accounts there is no account to sum up
    known = accounts if accounts is not None else tables.select("doc_id", F.lit("").alias("account"), F.lit("").alias("label")).filter(F.lit(False))
    datasets = {k: staged(v, k) for k, v in canonical.build_datasets(rows, tables, known, collapse).items()}
    summaries = staged(canonical.account_summaries(datasets, rows, tables, known), "summaries")
    modes = export.MODES if funds is not None else ("nao",)
    held, until = datasets["posicoes"], F.lit(period_end).cast("date")
    if layouts is not None and "period_end" in layouts.columns:
        held, until = held.join(layouts.select("doc_id", F.col("period_end").cast("date").alias("_until")), "doc_id", "left"), F.col("_until")
    base = staged(export.positions(held, until, clients, funds, currency), "positions")
    positions = {m: staged(export.explode_funds(base, funds, m), m) if m != "nao" else base for m in modes}
    movements = export.movements(datasets["movimentos"], datasets["transferencias"], clients, currency)
    per_table = reduce(DataFrame.unionByName, [reconcile.table_checks(rows, tables), reconcile.cross_checks(rows, tables), reconcile.note_checks(assigned, tables)])
    others = [export.export_notes(base, funds), canonical.dataset_checks(datasets, rows, tables, collapse), canonical.portfolio_checks(summaries), export.explosion_checks(positions)]
    checks = staged(reduce(DataFrame.unionByName, [per_table, *others]), "checks")
    return Run(tables, rows, reconcile.table_states(tables, checks), checks, datasets, positions, movements, known, summaries)


def curated(words: DataFrame, layout: dict, wanted: list[str] | None = None, answers: dict | None = None) -> tuple[dict[str, DataFrame], DataFrame, DataFrame]:
    """Sections declared by a layout: rows by section, checks, errors."""
    validate(layout)
    band = layout.get("body_band") or {}
    rows = in_band(lines(words, layout.get("y_tolerance", 2.5)), band.get("top"), band.get("bottom"))
    present = [n for n, s in layout["sections"].items() if s.get("present", True)]
    missing = [n for n in wanted or [] if n not in present]
    if missing:
        raise sections.SectionError(f"sections not in the layout: {', '.join(missing)}")
    out, checks, errors = {}, [], []
    for name in wanted or present:
        spec = layout["sections"][name]
        got, totals, wrong = sections.parse_section(name, rows, spec, layout.get("statement_year"))
        expected = ((answers or {}).get("sections") or {}).get(name)
        checks.append(sections.standard_checks(got, totals, spec, expected) if expected else sections.internal_checks(got, totals, spec))
        out[name] = got
        errors.append(wrong)
    return out, reduce(DataFrame.unionByName, checks), reduce(DataFrame.unionByName, errors)
