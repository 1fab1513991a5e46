"""Operator 9: chat formatting by prefix-target expansion, in DataFrame functions only.

Every assistant turn becomes an example of its own: all preceding turns and the turn's header are the
prompt, and only that reply is trainable (the loss mask is the completion's span of characters). Turns
after the last reply form one more example without a completion, so that no row is lost.

A turn is ``<s>[INST]role[/INST]text</s>``. Control strings inside roles and texts get a backslash after
their first character and backslashes are doubled, so a formatted text holds none but the template's.

Defined results: a null role or text is empty; rows of one conversation are ordered by turn (null first),
then role, then text, and repeated rows are turns of their own; a conversation of null id is one more
conversation; an empty table gives an empty one; extra columns are dropped. A conversation is one row and must fit
one (2 GB, Spark's own limit); texts below that may be of any length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The template's control strings (fixed values).
CONTROL = ("<s>", "</s>", "[INST]", "[/INST]")
_CONTROL_PATTERN = r"(<|\[)(s>|/s>|INST\]|/INST\])"


def escape(text: Column) -> Column:
    """Reversible: no control string is left in the result."""
    return F.regexp_replace(F.regexp_replace(text, r"\\", r"\\\\"), _CONTROL_PATTERN, r"$1\\$2")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _header(role: Column) -> Column:
    return F.concat(F.lit("<s>[INST]"), escape(role), F.lit("[/INST]"))


def expand(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Examples: conv, example (0, 1, ...), n_turns, prompt, completion (null in a last example without a reply).

    ``turns`` has a row for each turn. One shuffle, by conversation; prompts are built row by row after the
    explode, so a task holds one conversation and one prompt at a time.
    """
    rows = turns.select(
        F.col(conv).alias("conv"),
        F.struct(F.col(turn).alias("turn"), F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text")).alias("row"),
    )
    whole = rows.groupBy("conv").agg(F.sort_array(F.collect_list("row")).alias("rows"))
    turn_parts = whole.select("conv", F.transform("rows", lambda r: F.struct(_header(r["role"]).alias("header"), escape(r["text"]).alias("body"), (r["role"] == "assistant").alias("reply"))).alias("t"))
    pieces = turn_parts.withColumn("parts", F.transform("t", lambda x: F.concat(x["header"], x["body"], F.lit("</s>"))))
    # where each turn begins, in bytes of the conversation
    begins = F.aggregate("parts", F.array(F.lit(0)), lambda acc, p: F.concat(acc, F.array(F.element_at(acc, -1) + F.octet_length(p))))
    placed = pieces.select("conv", "t", F.array_join("parts", "").cast("binary").alias("formatted"), begins.alias("begins"))

    def target(x: Column, i: Column) -> Column:
        return F.when(x["reply"], F.struct((F.get("begins", i) + F.octet_length(x["header"])).alias("at"), x["body"].alias("completion")))

    rest = F.when(~F.element_at("t", -1)["reply"], F.struct(F.element_at("begins", -1).alias("at"), F.lit(None).cast("string").alias("completion")))
    found = F.filter(F.concat(F.transform("t", target), F.array(rest)), lambda x: x.isNotNull())
    targets = placed.select("conv", F.size("t").alias("n_turns"), "formatted", F.reverse(found).alias("targets")).withColumn("k", F.size("targets"))
    # the longest prompt comes first, and a row carries the conversation once; the outer form keeps the optimiser
    # from computing the targets a second time, in a filter for empty arrays (there is none)
    each = targets.select("conv", "n_turns", "formatted", "k", F.posexplode_outer("targets").alias("back", "x"))
    return each.select(
        F.col("conv").alias(conv),
        (F.col("k") - 1 - F.col("back")).alias("example"),
        "n_turns",
        F.substring("formatted", F.lit(1), F.col("x.at")).cast("string").alias("prompt"),
        F.col("x.completion").alias("completion"),
    )


def digest(examples: DataFrame, conv: str = "conv_id") -> DataFrame:
    """What is read back from formatted examples: turns from the longest example, losses from every one."""
    ends = F.when(F.col("last.completion").isNotNull(), F.concat("last.prompt", "last.completion", F.lit("</s>"))).otherwise(F.col("last.prompt"))
    back = examples.groupBy(conv).agg(
        F.max_by(F.struct("prompt", "completion"), "example").alias("last"),
        F.sort_array(F.collect_list(F.when(F.col("completion").isNotNull(), F.struct("example", "completion")))).alias("losses"),
    )
    back = back.select(conv, ends.alias("formatted"), "losses")
    pieces = F.filter(F.split("formatted", "</s>"), lambda p: p != "")
    pattern = r"(?s)^<s>\[INST\](.*?)\[/INST\](.*)$"
    read = F.transform(pieces, lambda p: F.concat(unescape(F.regexp_extract(p, pattern, 1)), F.lit("\n"), unescape(F.regexp_extract(p, pattern, 2)), F.lit("\n")))
    loss = F.array_join(F.transform("losses", lambda x: unescape(x["completion"])), "")
    return back.select(
        conv,
        F.size(pieces).cast("long").alias("n_turns"),
        F.sha2(F.array_join(read, ""), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
