"""Canonical datasets: every table of every statement in one schema per domain, and the proof that none of the money is lost."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.labels import PLAIN_TOTAL_STRICT, activity_type, classify_domain, is_income, term_label, without_activity
from ledgerloom.functions.text import strip, symbol_of, title_case, without_symbol

from .reconcile import ERROR, NOTICE, check, matches
from .tables import number_in

_TABLE = ["doc_id", "table_no"]
#: Canonical fields and the column names of statements that stand for them, best first (fixed values).
FIELD_SOURCES = {
    "quantidade": ["^quantity$", "quantity"], "preco_unitario": ["^share_price", "price"], "custo_unitario": ["^unit_cost", "unit_cost"],
    "custo_total": ["^total_cost$", "orig_adj_total_cost", "total_cost"], "valor_mercado": ["^market_value$", "market_value"],
    "mais_valia_nao_realizada": ["^unrealized_gain_loss$", "unrealized_gain_loss"], "rendimento_anual_estimado": ["est_ann_income"], "yield_pct": ["^current_yield", "yield"],
    "juros_corridos": ["accrued_interest"], "valor": ["^amount$", "credits_debits", "^amount", "pending_credits_debits"], "receita_venda": ["sales_proceeds", "proceeds"], "mais_valia_realizada": ["realized_gain_loss"],
}
#: Fields of each domain in order (fixed values: an external contract).
DOMAIN_FIELDS = {
    "posicoes": ["conta", "designacao_conta", "classe_ativo", "titulo", "simbolo", "data_compra", "quantidade", "custo_unitario", "preco_unitario", "custo_total", "valor_mercado", "mais_valia_nao_realizada", "rendimento_anual_estimado", "yield_pct", "peso_pct", "pagina", "tabela_origem"],
    "movimentos": ["conta", "designacao_conta", "data", "tipo", "descricao", "simbolo", "quantidade", "preco_unitario", "valor", "tabela", "pagina", "tabela_origem"],
    "mais_valias": ["conta", "designacao_conta", "prazo", "titulo", "simbolo", "data_compra", "data_venda", "quantidade", "receita_venda", "custo_total", "mais_valia_realizada", "pagina", "tabela_origem"],
    "transferencias": ["conta", "designacao_conta", "data", "tipo", "descricao", "quantidade", "valor", "pagina", "tabela_origem"],
    "alocacao": ["conta", "designacao_conta", "rubrica", "valor", "peso_pct", "pagina", "tabela_origem"],
    "sumario": ["conta", "designacao_conta", "rubrica", "valor", "pagina", "tabela_origem"],
}
DOMAIN_TOTAL = {"posicoes": "valor_mercado", "movimentos": "valor", "rendimento": "valor", "mais_valias": "mais_valia_realizada", "transferencias": "valor", "alocacao": "valor", "sumario": "valor"}
#: Labels of an account's printed total, the better one first (fixed values).
ACCOUNT_TOTAL_LABELS = [r"^total\s+value\b", r"^total\s+market\s+value\b"]


def source_column(field: str, names: Column, sources: dict[str, list[str]] = FIELD_SOURCES) -> Column:
    """The first column of ``names`` that matches the field's best pattern."""

    def first(pattern: str) -> Column:
        return F.get(F.filter(names, lambda n: F.rlike(n, F.lit(pattern))), F.lit(0))

    return F.coalesce(*[first(p) for p in sources[field]])


def collapse_lots(rows: DataFrame) -> DataFrame:
    """One row per group that closes with a bare total (that total as data, named by its group), the data rows of the others."""
    group = F.coalesce(F.nullif("group", F.lit("")), "label", F.lit(""))
    known = rows.filter("row_type in ('data', 'total')").withColumn("_g", group)
    bare = (F.col("row_type") == "total") & F.rlike(strip(F.col("label")), F.lit(PLAIN_TOTAL_STRICT))
    every = Window.partitionBy(*_TABLE, "_g")
    first = F.min(F.when(bare, F.col("row_no"))).over(every)
    chosen = known.withColumn("_first", first).filter((F.col("row_no") == F.col("_first")) | (F.col("_first").isNull() & (F.col("row_type") == "data")))
    closed = F.col("_first").isNotNull()
    return chosen.withColumns({"row_type": F.lit("data"), "label": F.when(closed, F.col("_g")).otherwise(F.col("label")), "description": F.when(closed, F.col("_g")).otherwise(F.col("description")), "dates": F.when(closed, F.filter("dates", lambda _: F.lit(False))).otherwise(F.col("dates"))}).drop("_g", "_first")


def _base(rows: DataFrame, tables: DataFrame, accounts: DataFrame | None) -> DataFrame:
    joined = rows.join(tables.select(*_TABLE, "title", "account", "amount_column", F.transform(F.filter("columns", lambda c: c["name"] != "description"), lambda c: c["name"]).alias("names")), _TABLE)
    if accounts is not None:
        joined = joined.join(accounts.select("doc_id", "account", F.col("label").alias("_label")), ["doc_id", "account"], "left")
    else:
        joined = joined.withColumn("_label", F.lit(None).cast("string"))
    return joined.withColumns({"conta": F.col("account"), "designacao_conta": F.coalesce("_label", F.lit("")), "pagina": F.col("page"), "tabela_origem": F.col("title"), "domain": classify_domain(F.col("title"))})


def _day(i: int) -> Column:
    return F.element_at("dates", i)["dt"] if i < 0 else F.get("dates", F.lit(0))["dt"]


def build_datasets(rows: DataFrame, tables: DataFrame, accounts: DataFrame | None = None, collapse: bool = True, sources: dict[str, list[str]] = FIELD_SOURCES) -> dict[str, DataFrame]:
    """A DataFrame per domain (posicoes, movimentos, mais_valias, transferencias, alocacao, sumario) and rendimento."""
    def value(field: str, fallback: bool = False) -> Column:
        name = source_column(field, F.col("names"), sources)
        return number_in(F.col("cells"), F.coalesce(name, F.col("amount_column")) if fallback else name).alias(field)

    data = _base(rows.filter("row_type = 'data'"), tables, accounts)
    held = _base(collapse_lots(rows) if collapse else rows.filter("row_type = 'data'"), tables, accounts).filter("domain = 'posicoes'")
    title = F.coalesce(F.nullif("group", F.lit("")), "description", F.lit(""))
    key = [*_TABLE, "row_no"]
    numbers = {f: value(f, f == "valor_mercado") for f in ("quantidade", "custo_unitario", "preco_unitario", "custo_total", "valor_mercado", "mais_valia_nao_realizada", "rendimento_anual_estimado", "yield_pct")}
    positions = held.select(*key, "conta", "designacao_conta", F.col("title").alias("classe_ativo"), without_symbol(title).alias("titulo"), symbol_of(title).alias("simbolo"), _day(0).alias("data_compra"), *numbers.values(), "pagina", "tabela_origem")
    out = {"posicoes": add_weights(positions).select(*key, *DOMAIN_FIELDS["posicoes"])}
    moves = data.filter("domain = 'movimentos'").select(*key, "conta", "designacao_conta", _day(0).alias("data"), activity_type(F.col("description")).alias("tipo"), without_activity(F.col("description")).alias("descricao"), symbol_of(F.col("description")).alias("simbolo"), value("quantidade"), value("preco_unitario"), value("valor", True), F.col("title").alias("tabela"), "pagina", "tabela_origem")
    out["movimentos"] = moves
    out["rendimento"] = moves.filter(is_income(F.col("tipo")))
    out["mais_valias"] = data.filter("domain = 'mais_valias'").select(*key, "conta", "designacao_conta", term_label(F.col("title")).alias("prazo"), without_symbol(title).alias("titulo"), symbol_of(title).alias("simbolo"), _day(0).alias("data_compra"), F.get("dates", F.size("dates") - 1)["dt"].alias("data_venda"), value("quantidade"), value("receita_venda"), value("custo_total"), value("mais_valia_realizada"), "pagina", "tabela_origem")
    out["transferencias"] = data.filter("domain = 'transferencias'").select(*key, "conta", "designacao_conta", _day(0).alias("data"), F.coalesce(activity_type(F.col("description")), title_case(F.col("title"))).alias("tipo"), without_activity(F.col("description")).alias("descricao"), value("quantidade"), value("valor"), "pagina", "tabela_origem")
    for domain in ("alocacao", "sumario"):
        elected = F.coalesce(value("valor"), number_in(F.col("cells"), F.col("amount_column"))).alias("valor")
        extra = [F.lit(None).cast("decimal(28,8)").alias("peso_pct")] if domain == "alocacao" else []
        out[domain] = data.filter(F.col("domain") == domain).select(*key, "conta", "designacao_conta", F.col("description").alias("rubrica"), elected, *extra, "pagina", "tabela_origem")
    return out


def weight(value: Column, total: Column) -> Column:
    """Per cent of the total, half-even at two decimals; null where there is no total."""
    share = value.cast("decimal(16,2)") * F.lit(100).cast("decimal(3,0)") / F.when(total != 0, total.cast("decimal(18,2)"))
    return F.bround(share, 2).cast("decimal(28,8)")


def add_weights(positions: DataFrame) -> DataFrame:
    total = F.sum("valor_mercado").over(Window.partitionBy("doc_id", "conta"))
    return positions.withColumn("peso_pct", weight(F.col("valor_mercado"), total))


def dataset_checks(datasets: dict[str, DataFrame], rows: DataFrame, tables: DataFrame, collapsed: bool = True, sources: dict[str, list[str]] = FIELD_SOURCES) -> DataFrame:
    """Per document and domain: the canonical sum against the sum of the same column of the tables it came from."""
    out = []
    base = _base(rows.filter("row_type = 'data'"), tables, None)
    for domain in DOMAIN_FIELDS:
        field = DOMAIN_TOTAL[domain]
        mapped = source_column(field, F.col("names"), sources)
        column = F.col("amount_column") if domain in ("alocacao", "sumario") else mapped
        here = base.filter(F.col("domain") == domain).withColumn("_column", column)
        origin = here.groupBy("doc_id").agg(F.coalesce(F.sum(number_in(F.col("cells"), F.col("_column"))), F.lit(0)).alias("origin"), F.count(F.lit(1)).alias("n"))
        canonical = datasets[domain].groupBy("doc_id").agg(F.coalesce(F.sum(field), F.lit(0)).alias("canonical"))
        # a document whose view has lost all its rows is checked too
        both = canonical.join(origin, "doc_id", "full").fillna({"n": 0}).withColumns({"canonical": F.coalesce("canonical", F.lit(0).cast("decimal(38,8)")), "origin": F.coalesce("origin", F.lit(0).cast("decimal(38,8)"))})
        slack = F.greatest(F.col("n"), F.lit(1)) * F.lit("0.01").cast("decimal(4,2)") if domain == "posicoes" and collapsed else F.lit(0)
        out.append(both.select(*check(F.lit("vista canónica vs tabelas de origem"), matches(F.col("canonical"), F.coalesce("origin", F.lit(0)), slack), F.col("canonical"), F.coalesce("origin", F.lit(0)), F.lit(None), F.lit(f"coluna {field}"), F.lit(ERROR), F.lit(domain), F.lit(None))))
        missing = here.filter("_column is null").select("doc_id", "title").distinct()
        out.append(missing.select(*check(F.lit("coluna de valor sem equivalente"), F.lit(False), F.col("title"), F.lit(field), F.lit(None), F.lit("as linhas aparecem sem valor"), F.lit(NOTICE), F.lit(domain), F.lit(None))))
    return reduce(DataFrame.unionByName, out)


def account_summaries(datasets: dict[str, DataFrame], rows: DataFrame, tables: DataFrame, accounts: DataFrame) -> DataFrame:
    """Per account: positions, market value, what is unsettled, the printed total and whether they agree (null: not verifiable)."""
    held = datasets["posicoes"].groupBy("doc_id", F.col("conta").alias("account")).agg(F.count(F.lit(1)).alias("positions"), F.sum("valor_mercado").alias("market_value"))
    late = datasets["movimentos"].filter(F.contains(F.lower("tabela"), F.lit("unsettled"))).groupBy("doc_id", F.col("conta").alias("account")).agg(F.sum("valor").alias("unsettled"), F.count(F.lit(1)).alias("unsettled_rows"))
    label = F.lower(strip(F.col("label")))
    prio = F.coalesce(*[F.when(F.rlike(label, F.lit(p)), i) for i, p in enumerate(ACCOUNT_TOTAL_LABELS)])
    totals = rows.filter("row_type = 'total'").join(tables.select(*_TABLE, "account", "amount_column"), _TABLE).withColumn("num", number_in(F.col("cells"), F.col("amount_column"))).withColumn("prio", prio)
    printed = totals.filter("num is not null and prio is not null").groupBy("doc_id", "account").agg(F.min_by("num", F.struct("prio", "table_no", "row_no")).alias("printed_total"))
    key = ["doc_id", "account"]
    joined = accounts.join(held, key, "left").join(late, key, "left").join(printed, key, "left")
    zero = F.lit(0).cast("decimal(38,8)")
    filled = joined.withColumns({"positions": F.coalesce("positions", F.lit(0)), "market_value": F.coalesce("market_value", zero), "unsettled": F.coalesce("unsettled", zero), "unsettled_rows": F.coalesce("unsettled_rows", F.lit(0))})
    slack = F.greatest("positions", F.lit(1)) * F.lit("0.01").cast("decimal(4,2)")
    agrees = F.when(F.col("printed_total").isNotNull(), matches(F.col("market_value") + F.col("unsettled"), F.col("printed_total"), slack))
    return filled.withColumn("reconciles", agrees)


def account_totals(dataset: DataFrame, field: str) -> DataFrame:
    """Per document and account: rows and the sum of ``field``."""
    return dataset.groupBy("doc_id", F.col("conta").alias("account")).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(field), F.lit(0)).alias("total"))


def portfolio_checks(summaries: DataFrame) -> DataFrame:
    """Positions and unsettled movements against each account's printed total."""
    known = summaries.filter("printed_total is not null")
    return known.select(*check(F.concat(F.lit("conta "), "account", F.lit(": posições vs total impresso")), F.col("reconciles"), F.col("market_value") + F.col("unsettled"), F.col("printed_total"), F.lit(None), F.format_string("%d posições", F.col("positions")), F.lit(ERROR), F.lit("posicoes"), F.lit(None)))
