"""Command line: ``python -m ledgerloom.cli words.parquet --out folder`` sweeps, ``--sections`` runs the curated mode, and with ``--expected`` compares it with answers.

Exit codes: 0 all proved, 1 something fatal failed (outputs are marked as partial), 2 the input cannot be used.
"""

from __future__ import annotations

import argparse
import json
import os
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ledgerloom.operators import layout as lay
from ledgerloom.operators import reconcile, sections
from ledgerloom.operators.export import MODES
from ledgerloom.operators.ordered import lines
from ledgerloom.plans.sweep import curated, sweep
from ledgerloom.sources import sinks
from ledgerloom.sources import words as src


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="ledgerloom")
    p.add_argument("words", help="a parquet table of positioned words")
    p.add_argument("--out", default="saida")
    p.add_argument("--layout", help="layout JSON; without it the layout of an earlier run or a new one")
    p.add_argument("--relayout", action="store_true")
    p.add_argument("--skip-precheck", action="store_true", help="do not ask for text on at least half of the pages")
    p.add_argument("--csv", action="store_true")
    p.add_argument("--strict", action="store_true", help="write nothing if a fatal check fails")
    p.add_argument("--no-diagnostics", action="store_true")
    p.add_argument("--diagnostico", action="store_true", help="write the structure report only")
    p.add_argument("--lotes", action="store_true", help="keep lots apart")
    p.add_argument("--clientes")
    p.add_argument("--fundos-exclusivos")
    p.add_argument("--explosao", action="append", choices=MODES)
    p.add_argument("--moeda", default="USD")
    p.add_argument("--sections", action="store_true")
    p.add_argument("--section", action="append")
    p.add_argument("--expected")
    p.add_argument("--force", action="store_true")
    return p


def resolve_layouts(spark: SparkSession, words, args: argparse.Namespace) -> dict[str, dict]:
    """The layout of each document: an explicit one for all, else those of an earlier run, else new proposals, which are kept."""
    documents = sorted(r[0] for r in words.select("doc_id").distinct().collect())  # a run of the command line is some statements
    if args.layout:
        given = lay.validate(src.read_json(spark, args.layout))
        return dict.fromkeys(documents, given)
    cache = os.path.join(args.out, ".layouts", f"{os.path.basename(args.words.rstrip('/'))}.json")
    if os.path.exists(cache) and not args.relayout:
        with open(cache, encoding="utf-8") as f:
            kept = json.load(f)
        if set(kept) >= set(documents):
            return {d: lay.validate(kept[d]) for d in documents}
    made = propose_layouts(words)
    os.makedirs(os.path.dirname(cache), exist_ok=True)
    with open(cache, "w", encoding="utf-8") as f:
        json.dump(made, f, indent=2, ensure_ascii=False)
    return made


def propose_layouts(words) -> dict[str, dict]:
    """A layout per document from its own lines."""
    rows = lines(words)
    heights = words.groupBy("doc_id", "page").agg((F.max("bottom") * 1.02).alias("height"))
    built = lay.build_layout(rows, heights)
    out = {r[0]: {"version": 2, "statement_year": None, "period_start": None, "period_end": None, "y_tolerance": 2.5, "body_band": {}, "accounts": [], "sections": {}} for r in words.select("doc_id").distinct().collect()}
    for r in built["band"].collect():
        out[r["doc_id"]]["body_band"] = {"top": r["band_top"], "bottom": r["band_bottom"]}
    for r in built["period"].collect():
        out[r["doc_id"]] |= {"statement_year": r["statement_year"], **{k: str(r[k]) if r[k] else None for k in ("period_start", "period_end")}}
    for r in built["accounts"].orderBy("doc_id", F.element_at("pages", 1)).collect():
        out[r["doc_id"]]["accounts"].append({"id": r["account"], "label": r["label"], "pages": r["pages"]})
    for r in built["sections"].join(built["columns"], ["doc_id", "section"]).orderBy("doc_id", "first_page").collect():
        out[r["doc_id"]]["sections"].setdefault(r["section"], {"present": True, "pages": r["pages"], "columns": [c.asDict() for c in r["columns"]], **sections.HINTS.get(r["section"], {})})
    return out


def run_sweep(spark: SparkSession, words, layouts: dict[str, dict], args: argparse.Namespace) -> int:
    accounts = [(d, a["id"], a.get("label") or "", a["pages"]) for d, x in layouts.items() for a in x.get("accounts") or []]
    facts = []
    for d, x in layouts.items():
        band, start = x.get("body_band") or {}, x.get("period_start")
        hint = f"{int(start[5:7])}_{int(start[8:10])}_{start[2:4]}" if start else None
        facts.append((d, *(None if band.get(k) is None else float(band[k]) for k in ("top", "bottom")), x.get("statement_year"), hint, x.get("period_end")))
    table = spark.createDataFrame(facts, "doc_id string, band_top double, band_bottom double, statement_year int, hint string, period_end string")
    clients = src.clients_table(spark, src.read_json(spark, args.clientes)) if args.clientes else None
    funds = src.funds_table(spark, src.read_json(spark, args.fundos_exclusivos)) if args.fundos_exclusivos else None
    known = spark.createDataFrame(accounts, "doc_id string, account string, label string, pages array<int>") if accounts else None
    run = sweep(words, accounts=known, layouts=table, collapse=not args.lotes, clients=clients, funds=funds, currency=args.moeda)
    failed = run.failures().count()
    if args.diagnostico:
        pages = words.groupBy("doc_id").agg(F.max("page").alias("page_count"))
        print("\n".join(r["line"] for r in sinks.structure_report(run.tables, run.checks, pages).orderBy("doc_id", "no").collect()))
        return int(failed > 0)
    for r in sinks.ordered_checks(run.checks.filter(~F.col("passed"))).select("line").collect():
        print(r["line"])
    path = sinks.commit_path(os.path.join(args.out, "extrato.xlsx"), failed, args.strict)
    if path:
        os.makedirs(args.out, exist_ok=True)
        content = sinks.sheets(run)
        for mode in [m for m in MODES if args.explosao and m not in args.explosao]:
            content.pop(f"POSICOES {mode}", None)
        if args.no_diagnostics:
            for name in ("Reconciliação", "Totais impressos", "Tabelas do documento"):
                content.pop(name, None)
        sinks.write_workbook(path, content)
        if args.csv:
            sinks.write_csv(run.rows, os.path.join(args.out, "tabelas.PARTIAL" if failed else "tabelas"))
    return int(failed > 0)


def run_sections(spark: SparkSession, words, layout: dict, args: argparse.Namespace, name: str = "") -> int:
    """The curated mode for one document; with several, each has a folder of its name."""
    folder = os.path.join(args.out, name)
    answers = src.expected_for(src.read_json(spark, args.expected), args.words) if args.expected else {}
    rows, checks, errors = curated(words, layout, args.section, answers)
    sections.raise_errors(errors)
    extra = [c for n, df in rows.items() if (c := sections.statement_checks(n, df, layout["sections"][n], answers)) is not None]
    for more in extra:
        checks = checks.unionByName(more)
    failed = checks.filter(reconcile.fatal()).count()
    print("\n".join(r["line"] for r in sinks.ordered_checks(checks).select("line").collect()))
    if answers.get("activity_rollforward"):
        failed += not sections.rollforward(answers["activity_rollforward"])["passed"]
    if not checks.limit(1).count():
        failed += 1  # no check is no proof
    if failed and not args.force:
        return 1
    os.makedirs(folder, exist_ok=True)
    for section, df in rows.items():
        sinks.write_csv(df.drop("source_text", "_currency"), os.path.join(folder, f"{section}.PARTIAL" if failed else section))
    with open(os.path.join(folder, "summary.json"), "w", encoding="utf-8") as f:
        json.dump(sections.summary(rows, checks, layout), f, indent=2, ensure_ascii=False)
    return int(failed > 0)


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.appName("ledgerloom").getOrCreate()
    try:
        words = src.read_words(spark, args.words)
        if not args.skip_precheck:
            src.assert_text_layer(src.text_layer(src.page_texts(words)))
        layouts = resolve_layouts(spark, words, args)
        if not (args.sections or args.section):
            return run_sweep(spark, words, layouts, args)
        codes = [run_sections(spark, words.filter(F.col("doc_id") == d), x, args, d if len(layouts) > 1 else "") for d, x in layouts.items()]
        return max(codes, default=0)
    except (lay.LayoutError, sections.SectionError, src.ScannedDocumentError, ValueError) as e:
        print(e, file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(main())
