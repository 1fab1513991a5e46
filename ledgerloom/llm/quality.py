"""Operator 6: quality rules by document and by host, in DataFrame functions only.

Base rules judge each document alone. Their failures are then counted by host, the hosts' failure rates
are shrunk towards an empirical beta prior (fitted to all hosts by moments), and a host whose shrunk rate
exceeds a limit is rejected as a whole; its verdict is joined back to its documents.

Texts are read once: the counts are written to the shared folder, and hosts are aggregated from them.

Defined results: a null text has no words and fails; a null host is the host ''; repeated rows count each;
a text of any length is one row's array of words; an empty table gives an empty one; extra columns are dropped. A host may
hold any share of the rows: its verdict goes to as many tasks as its documents are dealt to.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import SPACE_CLASS, join_groups, materialise

#: Production parameters.
WINDOW, LEAST_WORDS, MOST_REPEATED_PERCENT, MOST_HOST_FAILURES = 8, 20, 30, 0.5
SYMBOLS = "#*$%&|<>"
_SPACES = " \t\n\x0b\x0c\r"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, also where ``body`` uses it inside lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _beside(a: Column, f: Callable[[Column, Column], Column]) -> Column:
    """``f`` of each element and the next one (null after the last)."""
    return F.zip_with(a, F.slice(a, F.lit(2), F.greatest(F.size(a), F.lit(1))), f)


def repeated_words(words: Column, k: int = WINDOW) -> Column:
    """Words inside k-word windows that occur twice or more in the text, the first occurrence included.

    Windows are compared by 64-bit hashes. Only texts in which some hash repeats are sorted.
    """

    def windows(h: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(h) - k), lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(k)]))

    def covered(w: Column) -> Column:
        placed = F.sort_array(F.transform(w, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        pairs = _let(placed, lambda s: F.filter(_beside(s, lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"]))), lambda x: x.isNotNull()))
        starts = F.sort_array(F.array_distinct(F.flatten(pairs)))
        return _let(starts, lambda p: F.aggregate(_beside(p, lambda a, b: F.least(F.lit(k), F.coalesce(b - a, F.lit(k)))), F.lit(0), lambda x, y: x + y))

    hashes = F.transform(words, lambda w: F.xxhash64(w))
    found = _let(_let(hashes, windows), lambda w: F.when(F.size(F.array_distinct(w)) < F.size(w), covered(w)).otherwise(F.lit(0)))
    return F.when(F.size(words) >= k, found).otherwise(F.lit(0)).cast("long")


def document_counts(docs: DataFrame, key: str = "doc_id", text: str = "text", host: str = "source") -> DataFrame:
    """Per document: key, host, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    body = F.coalesce(F.col(text), F.lit(""))
    full_lines = F.filter(F.split(body, "\n"), lambda x: F.translate(x, _SPACES, "") != "")
    counted = docs.select(
        F.col(key).alias("key"),
        F.coalesce(F.col(host), F.lit("")).alias("host"),
        F.array_remove(F.split(body, f"{SPACE_CLASS}+"), "").alias("words"),
        F.length(F.translate(body, _SPACES, "")).cast("long").alias("word_chars"),
        (F.length(body) - F.length(F.translate(body, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        _let(full_lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
    ).select("key", "host", F.size("words").cast("long").alias("n_words"), "word_chars", "n_symbols", "n_dup_lines", repeated_words(F.col("words")).alias("n_repeat_words"))
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED_PERCENT * F.col("n_words"))
    return counted.withColumn("base_failed", failed)


def host_verdicts(counts: DataFrame, most: float = MOST_HOST_FAILURES) -> DataFrame:
    """Per host: n_docs, n_failed, the shrunk failure rate and whether it is rejected.

    The prior's two numbers, from the mean and variance of the hosts' rates, are all that goes to the driver.
    """
    hosts = counts.groupBy("host").agg(F.count(F.lit(1)).alias("n_docs"), F.sum(F.col("base_failed").cast("long")).alias("n_failed"))
    rate = F.col("n_failed") / F.col("n_docs")
    got = hosts.agg(F.avg(rate).alias("m"), F.var_pop(rate).alias("v")).first()
    m, v = (got["m"] or 0.0), (got["v"] or 0.0)
    # moments of a beta distribution; without spread the prior weighs as much as a thousand documents
    weight = min(max(m * (1 - m) / v - 1, 1.0), 1000.0) if v > 0 else 1000.0
    shrunk = (F.col("n_failed") + m * weight) / (F.col("n_docs") + weight)
    return hosts.withColumn("shrunk_rate", shrunk).withColumn("host_rejected", shrunk > most)


def judge(docs: DataFrame, key: str = "doc_id", text: str = "text", host: str = "source", most: float = MOST_HOST_FAILURES) -> DataFrame:
    """All counts, base_failed, the host's shrunk rate and kept, one row per document."""
    counts = materialise(document_counts(docs, key, text, host), "quality")
    hosts = host_verdicts(counts, most).select("host", "shrunk_rate", "host_rejected")
    judged = join_groups(counts, hosts, ["host"], F.xxhash64("key", "n_words", "word_chars"))
    return judged.select(
        F.col("key").alias(key), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & ~F.col("host_rejected")).alias("kept"), F.col("host").alias("host"), "shrunk_rate",
    )
