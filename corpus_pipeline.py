"""A corpus pipeline of five operators: each stage's rows are written as Parquet and reread by the next.

Stages take (spark, docs, sf_dir); all but the last return the columns of ``docs``, and the mix adds ``MIX``. ``docs`` has doc_id, text,
lang and source; n_chars is kept true if it is there, further columns of any name stay until the last stage. A row of null or empty text has no
letter and is rejected by the first stage; a null doc_id keeps its row; of rows that repeat an id one stays, the first by a
hash of all columns; an empty table passes through. Every decision is made on all rows that the stage before kept.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.llm import bpe, jaccard_join, langid, line_dedup, mixing
from ledgerloom.llm.queries import vocabulary_path
from ledgerloom.llm.shared import free_name, materialise, read_table

#: A document is rejected when no language explains this share of it (four languages: above a quarter).
LEAST_SCORE = 0.3

#: The mix's decision on each row, which the last stage hands on: sorted by slot and place, the rows are the mix.
MIX = ("slot", "place", "in_mix")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learn from the labelled rows outside the held-out fold; documents without a language go, the others get theirs."""
    model = langid.train(docs.filter(~langid.held_out(F.col("doc_id"))).select("text", "lang"))
    rest = tuple(c for c in docs.columns if c != "doc_id")
    found = langid.predict(docs.select("doc_id", *rest), model, keep=rest)
    kept = found.filter((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= LEAST_SCORE))
    return kept.withColumn("lang", F.col("lang_pred")).select(*docs.columns)


def drop_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Remove lines that many sources share; documents stay, their texts get shorter."""
    cleaned = line_dedup.remove_boilerplate(docs)
    if "n_chars" in docs.columns:
        cleaned = cleaned.withColumn("n_chars", F.length("text").cast("long"))
    return cleaned.select(*docs.columns)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that are linked, the one of least id stays, once; rows of null id stay."""
    groups = jaccard_join.link(docs)
    stay = groups.filter("doc_id = component_id").select("doc_id").distinct()
    known = docs.join(stay, "doc_id", "left_semi")
    once = Window.partitionBy("doc_id").orderBy(F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns]))
    nth = free_name(docs.columns, "nth")
    single = known.withColumn(nth, F.row_number().over(once)).filter(F.col(nth) == 1).select(*docs.columns)
    return single.unionByName(docs.filter("doc_id is null"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows with their slot and place in the mix; files hold ranges of slots and are sorted."""
    mixed = mixing.mix(docs.drop(*MIX))
    return mixed.repartitionByRange("slot", "place").sortWithinPartitions("slot", "place")


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, digests of the ids and of what they decode to, and each row's position in the mix."""
    return bpe.digest(docs, vocabulary_path(), keep=("lang", "source", *(c for c in MIX if c in docs.columns)), with_ids=True)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("line_dedup", drop_boilerplate),
    ("ngram_jaccard_join", one_of_each),
    ("mixing", mix_sources),
    ("byte_bpe", tokenise),
]

#: Language identification has no SQL form; tests hold the pipeline against a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
