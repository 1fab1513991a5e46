from decimal import Decimal

import pytest
from pyspark.sql import functions as F
from statements import Painter, layout, lots_statement, main_statement, words

from ledgerloom.operators import canonical, export
from ledgerloom.operators import layout as lay
from ledgerloom.operators.ordered import in_band, lines
from ledgerloom.operators.sections import SectionError, raise_errors
from ledgerloom.operators.tables import number_tables
from ledgerloom.plans.sweep import curated, detect, sweep
from ledgerloom.sources import sinks
from ledgerloom.sources.words import funds_table

BAND = (60.0, 740.0)


@pytest.fixture(scope="module")
def run(spark):
    w = words(spark, main_statement(), main_statement("F1x", "1,195,590.65"))
    return sweep(w, band=BAND, year=2026, period_end="2026-01-31")


def test_five_tables_with_their_rows(run):
    got = {r["title"]: r for r in run.tables.filter("doc_id = 'F1'").collect()}
    assert set(got) == {"ACCOUNT SUMMARY", "PORTFOLIO HOLDINGS", "ACCOUNT ACTIVITY", "INCOME", "FEES AND CHARGES"}
    assert got["PORTFOLIO HOLDINGS"]["pages"] == [2, 3]
    assert got["PORTFOLIO HOLDINGS"]["amount_column"] == "market_value"
    n = {r["table_no"]: r["n"] for r in run.rows.filter("doc_id = 'F1' and row_type = 'data'").groupBy("table_no").agg(F.count("*").alias("n")).collect()}
    assert [n[got[t]["table_no"]] for t in ("PORTFOLIO HOLDINGS", "ACCOUNT ACTIVITY", "INCOME", "FEES AND CHARGES")] == [6, 4, 3, 2]


def test_all_sums_are_proved_and_a_tampered_total_fails(run):
    checks = run.checks.filter("table_no is not null").collect()
    good = [c for c in checks if c["doc_id"] == "F1"]
    assert sum(c["passed"] for c in good) == 5 and all(c["passed"] for c in good)
    failed = run.failures().filter("doc_id = 'F1x'").collect()
    assert len(failed) == 1 and failed[0]["section"] == "PORTFOLIO HOLDINGS" and Decimal(failed[0]["extracted"]) == Decimal("1195590.55")
    assert run.failures().filter("doc_id = 'F1'").count() == 0
    states = {(r["doc_id"], r["title"]): r["state"] for r in run.states.collect()}
    assert states["F1", "PORTFOLIO HOLDINGS"] == "conciliado" and states["F1x", "PORTFOLIO HOLDINGS"] == "não conciliado"


def test_canonical_and_export(run, spark):
    held = run.datasets["posicoes"].filter("doc_id = 'F1'").collect()
    assert len(held) == 6 and sum(r["valor_mercado"] for r in held) == Decimal("1195590.55")
    assert abs(sum(r["peso_pct"] for r in held) - 100) <= Decimal("0.03")
    moves = {r["descricao"]: r for r in run.datasets["movimentos"].filter("doc_id = 'F1'").collect()}
    assert any(r["tipo"] == "Purchase" for r in moves.values())
    funds = {"XYZ_CORP_SHORT_POSITION": {"nome": "X", "carteira": [{"descricao": "a", "classe": "c1", "valor": -8000}, {"descricao": "b", "classe": "c1", "valor": -3000}, {"descricao": "c", "classe": None, "valor": -1500}]}, "_nota": {}}
    base = run.positions["nao"].filter("doc_id = 'F1'")
    full = {m: export.explode_funds(base, funds_table(spark, funds), m) for m in export.MODES}
    assert full["detalhado"].count() == 8 and full["consolidado"].count() == 7
    assert export.explosion_checks(full).filter("not passed").count() == 0
    funds["XYZ_CORP_SHORT_POSITION"]["carteira"][0]["valor"] = -9999.99
    bad = {m: export.explode_funds(base, funds_table(spark, funds), m) for m in export.MODES}
    assert export.explosion_checks(bad).filter("not passed").count() == 2
    assert run.positions["nao"].filter("VALOR_IR is not null").count() == 0
    assert run.movements.columns[1:] == export.MOVEMENT_COLUMNS


def test_two_documents_keep_their_own_layouts(spark):
    """The second one is printed 100 points lower, of another year, and has a header line inside the first one's band."""
    low = [(*r[:5], r[5] + 100, r[6] + 100, *r[7:]) for r in main_statement("F1low")]
    w = words(spark, main_statement(), low)
    layouts = spark.createDataFrame([("F1", 60.0, 740.0, 2026, None, "2026-01-31"), ("F1low", 160.0, 840.0, 2025, None, None)], "doc_id string, band_top double, band_bottom double, statement_year int, hint string, period_end string")
    run = sweep(w, layouts=layouts)
    states = {(r["doc_id"], r["title"]): r["state"] for r in run.states.collect()}
    assert len(states) == 10 and set(states.values()) == {"conciliado"}
    days = {r["doc_id"]: r["d"] for r in run.positions["nao"].groupBy("doc_id").agg(F.max("DT_POSICAO").alias("d")).collect()}
    assert str(days["F1"]) == "2026-01-31" and days["F1low"] is None
    notes = [(c["doc_id"], c["name"]) for c in run.warnings().collect() if c["name"] == "data da posição"]
    assert notes == [("F1low", "data da posição")] and run.summaries.count() == 0


def test_proposed_layouts_are_of_each_document(spark):
    from ledgerloom.cli import propose_layouts

    low = [(*r[:5], r[5] + 100, r[6] + 100, *r[7:]) for r in main_statement("F1low")]
    got = propose_layouts(words(spark, main_statement(), low))
    assert got["F1low"]["body_band"]["bottom"] - got["F1"]["body_band"]["bottom"] == pytest.approx(100, abs=2)
    assert got["F1"]["sections"]["income"]["pages"] == [5] == got["F1low"]["sections"]["income"]["pages"]


def test_a_table_that_is_dropped_leaves_a_note(spark):
    p = Painter("N1", 1)
    p.text(1, 90, 40, "ODD LIST", 13, True)
    for i in range(7):  # a column in which text outnumbers the numbers
        p.text(1, 120 + 14 * i, 40, f"row {chr(97 + i)}")
        p.right(1, 120 + 14 * i, 300, "1,000.00" if i in (0, 3, 6) else "see over")
    run = sweep(words(spark, p.rows), band=BAND, year=2026, period_end="2026-01-31")
    notes = run.warnings().filter("name in ('tabela ignorada', 'bloco ignorado')").collect()
    assert run.tables.count() == 0 and len(notes) == 1 and "ODD LIST" in notes[0]["detail"]


def test_wrong_field_sources_are_caught(spark):
    tables, rows, _ = detect(words(spark, lots_statement()), band=BAND, year=2016)
    good = canonical.dataset_checks(canonical.build_datasets(rows, tables), rows, tables)
    assert good.filter("not passed").count() == 0 and good.count() == 1
    wrong = canonical.FIELD_SOURCES | {"valor_mercado": ["^trade_date$"]}
    bad = canonical.dataset_checks(canonical.build_datasets(rows, tables, sources=wrong), rows, tables, sources=wrong)
    assert bad.filter("not passed").count() > 0
    lost = canonical.build_datasets(rows, tables)
    lost["posicoes"] = lost["posicoes"].limit(0)
    assert [c["severity"] for c in canonical.dataset_checks(lost, rows, tables).filter("not passed").collect()] == ["erro"]


def _tables_one_by_one(blocks):
    """The rules of ``number_tables``, block after block."""
    out, opened, before = {}, {}, {}
    for page, block, account, titles, n_bands, n_numeric in sorted(blocks, key=lambda b: b[:2]):
        last = before.get(account)
        path = [t for t in titles or [] if t] or (last[1] if last and page - last[0] <= 1 else ["SEM TÍTULO"])
        before[account] = (page, path)
        number = None
        if n_bands:
            same = [k for k in opened if k[:2] == (account, path[-1])]
            key = (account, path[-1], n_bands)
            if key not in opened and n_numeric < 3 and same:
                key = same[0]
            number = opened.setdefault(key, len(opened))
        out[page, block] = (number, path)
    return out


def test_blocks_become_tables(spark):
    import random

    rng = random.Random(3)
    docs = {f"d{i}": [(page, b, rng.choice(["x", "y", None]), rng.choice([None, [], ["A"], ["A", "B"], ["", "B"]]), rng.randrange(4), rng.randrange(1, 6)) for page in sorted(rng.sample(range(1, 9), 6)) for b in range(rng.randrange(1, 4))] for i in range(25)}
    df = spark.createDataFrame([(d, *b, "first") for d, bs in docs.items() for b in bs], "doc_id string, page int, block int, account string, titles array<string>, n_bands int, n_numeric int, first_text string")
    got = {}
    for r in number_tables(df).collect():
        got.setdefault(r["doc_id"], {})[r["page"], r["block"]] = (r["table_no"], r["path"])
        assert (r["note"] is None) == (r["table_no"] is not None) and r["title"] == r["path"][-1]
    assert got == {d: _tables_one_by_one(bs) for d, bs in docs.items()}


def test_words_without_text_are_refused(spark):
    from ledgerloom.sources.words import ScannedDocumentError, assert_text_layer, page_texts, text_layer

    rows = [r for r in main_statement() if r[1] in (1, 6)]
    report = text_layer(page_texts(words(spark, rows)))
    assert report.first()["pages_with_text"] == 2 and report.first()["page_count"] == 6
    with pytest.raises(ScannedDocumentError):
        assert_text_layer(report)
    assert_text_layer(text_layer(page_texts(words(spark, main_statement()))))


def test_lots_collapse_to_positions(spark):
    tables, rows, _ = detect(words(spark, lots_statement()), band=BAND, year=2016)
    one = tables.collect()
    assert len(one) == 1 and one[0]["amount_column"] == "market_value"
    by_type = {r["row_type"]: r["n"] for r in rows.groupBy("row_type").agg(F.count("*").alias("n")).collect()}
    assert by_type == {"data": 5, "subtotal": 2, "total": 3}
    got = canonical.build_datasets(rows, tables)["posicoes"].orderBy("row_no").collect()
    assert [(r["titulo"], r["simbolo"], r["valor_mercado"]) for r in got] == [("FUND A GROWTH", "AAAAX", Decimal(155000)), ("FUND B INCOME", "BBBBX", Decimal(225000))]
    lots = canonical.build_datasets(rows, tables, collapse=False)["posicoes"]
    assert lots.count() == 5 and lots.agg(F.sum("valor_mercado")).first()[0] == Decimal(380000)


def test_curated_sections_and_answers(spark):
    w = words(spark, main_statement())
    answers = {"sections": {"holdings": {"subtotal": "1195590.55", "row_count": 6}, "fees": {"subtotal": "1.00", "row_count": 2}}}
    rows, checks, errors = curated(w, layout(), answers=answers)
    raise_errors(errors)
    sums = {n: df.agg(F.sum(layout()["sections"][n]["amount_column"])).first()[0] for n, df in rows.items()}
    assert sums == {"holdings": Decimal("1195590.55"), "activity": Decimal("26754.60"), "income": Decimal("12255.00"), "fees": Decimal("2020.40")}
    assert [(c["section"], c["name"]) for c in checks.filter("not passed").collect()] == [("fees", "soma vs gabarito")]
    assert rows["holdings"].filter("description like '%DUE 11/15/2034'").count() == 1
    with pytest.raises(SectionError):
        curated(w, layout(), wanted=["loans"])


def test_strict_mode_reports_section_and_page(spark):
    rows = [r if r[2] != "329,800.00" else (*r[:2], "329,80x.00", *r[3:]) for r in main_statement()]
    spec = layout()
    spec["sections"] = {"holdings": spec["sections"]["holdings"] | {"row_start": {"kind": "regex", "pattern": "[A-Z]{2}"}}}
    _, _, errors = curated(words(spark, rows), spec)
    with pytest.raises(SectionError, match="holdings p.2"):
        raise_errors(errors)


@pytest.mark.parametrize("change", [{"version": 1}, {"sections": None}, {"accounts": [{"id": "a", "pages": [1]}, {"id": "b", "pages": [1]}]}, {"accounts": [{"id": "a", "pages": [1]}, {"id": "a", "pages": [2]}]}])
def test_layouts_that_are_refused(change):
    with pytest.raises(lay.LayoutError):
        lay.validate(layout() | change)


def test_overlapping_columns_are_refused():
    bad = layout()
    bad["sections"]["fees"]["columns"][1]["x0"] = 50
    with pytest.raises(lay.LayoutError):
        lay.validate(bad)


def test_layout_builder(spark):
    rows = lines(words(spark, main_statement()))
    heights = rows.select("doc_id", "page").distinct().withColumn("height", F.lit(792.0))
    got = lay.build_layout(rows, heights)
    band = got["band"].first()
    assert 30 < band["band_top"] < 60 and 700 < band["band_bottom"] < 762
    body = in_band(rows, band["band_top"], band["band_bottom"])
    found = lay.build_layout(body, heights)["sections"].collect()
    assert {r["section"]: (r["first_page"], r["last_page"]) for r in found}["income"] == (5, 5)


def test_sheets_workbook_and_commit(run, tmp_path):
    content = sinks.sheets(run)
    assert list(content)[0] == "Capa" and "Reconciliação" in content
    path = tmp_path / "book.xlsx"
    sinks.write_workbook(str(path), content)
    import zipfile

    with zipfile.ZipFile(path) as book:
        assert "Reconcilia" in book.read("xl/workbook.xml").decode()
    assert sinks.commit_path("/o/a.xlsx", 1) == "/o/a.PARTIAL.xlsx" and sinks.commit_path("/o/a.xlsx", 1, strict=True) is None
    report = sinks.structure_report(run.tables, run.checks, run.tables.select("doc_id").distinct().withColumn("page_count", F.lit(7)))
    text = [r["line"] for r in report.filter("doc_id = 'F1'").orderBy("no").collect()]
    assert any("sem tabela: p.7" in t for t in text) and not any("195" in t for t in text)
    assert sinks.sheet_name({"a"}, "A") == "A (2)"
