"""Operator 4: mixing sources to target weights by Pfair scheduling; rows go through DataFrame functions only.

A source's rows form blocks, in an order that a hash fixes. With a weight w, of sum 1 over the sources, block i
of a source may not start before slot floor(i / w) and must end by slot ceil((i + 1) / w); in each slot the
released block of earliest deadline runs. This keeps every source within one block of its target at every slot.
The driver works this out for blocks (never for rows) in exact integers, whatever the number of sources, and
writes it in pieces; a row finds its slot by its rank.

Ranks need no task that holds a source: rows go to small hash ranges, ranges are counted, and running sums
of the counts place each range. Every row is returned once and whole; ``in_mix`` ends where the first source runs out,
the other sources go on without gaps.

Defined results: a null source is the source ''; sources of weight 0 or without a weight get null slots; a null key
comes first; rows of one key are ordered by a hash of all their columns, and only equal rows change places;
repeated rows are rows of their own; an empty table gives an empty one; extra columns stay, of whatever name; texts of any
length are carried along and not looked at.
"""

from __future__ import annotations

import heapq
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import free_name, free_prefix, materialise, new_path

#: Production parameters: rows of a block, exponent of the default weights, rows of a hash range. The driver takes about a
#: second for a million blocks: a corpus of more than 10**10 rows wants longer ones.
BLOCK_ROWS, ALPHA, RANGE_ROWS = 16, 0.5, 2048
_HASH_BITS = 30
#: Slots that the driver holds at a time.
_PIECE = 1 << 20


def _order_hash(key: Column) -> Column:
    """60 bits that fix a source's order; a null key comes first."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, 15), 16, 10).cast("bigint")


def targets(docs: DataFrame, source: str = "source", weights: dict[str, float] | None = None, alpha: float = ALPHA) -> DataFrame:
    """Per source: rows n and weight w, of any sum; default weights are sizes to the power ``alpha``."""
    sizes = docs.groupBy(F.coalesce(F.col(source), F.lit("")).alias("src")).agg(F.count(F.lit(1)).alias("n"))
    if weights is None and alpha == 0.5:
        return sizes.withColumn("w", F.sqrt("n"))  # rounded rightly everywhere, as a power need not be
    if weights is None:
        return sizes.withColumn("w", F.pow(F.col("n").cast("double"), F.lit(alpha)))
    table = F.create_map(*[F.lit(x) for s, w in weights.items() for x in (s, float(w))])
    return sizes.withColumn("w", F.coalesce(F.get(F.map_values(F.map_filter(table, lambda k, _: k == F.col("src"))), F.lit(0)), F.lit(0.0)))


def _turns(blocks: list[int], weights: list[float]) -> Iterator[tuple[int, int]]:
    """Slot by slot, the source that runs and the number of its block; earliest deadline first, ties by position."""
    ratios = [w.as_integer_ratio() for w in weights]
    scale = max((q for _, q in ratios), default=1)  # powers of two: all weights are integers over it
    whole = [p * (scale // q) for p, q in ratios]
    total = sum(whole)
    ready = [(-(-total // w), i, 0) for i, w in enumerate(whole)]
    heapq.heapify(ready)
    waiting: list[tuple[int, int, int, int]] = []
    now = 0
    while ready or waiting:
        if not ready:  # only after a source has run out
            now = max(now, waiting[0][0])
        while waiting and waiting[0][0] <= now:
            heapq.heappush(ready, heapq.heappop(waiting)[1:])
        _, i, block = heapq.heappop(ready)
        yield i, block
        now, block = now + 1, block + 1
        if block < blocks[i]:
            release, deadline = block * total // whole[i], -(-(block + 1) * total // whole[i])
            if release <= now:
                heapq.heappush(ready, (deadline, i, block))
            else:
                heapq.heappush(waiting, (release, deadline, i, block))


def exact_schedule(spark: SparkSession, sizes: DataFrame, block_rows: int = BLOCK_ROWS) -> tuple[DataFrame, int | None]:
    """Every block's src, block and slot, and the last slot up to which all sources last; ``sizes`` as of ``targets``."""
    rows = sorted((r["src"], r["n"], r["w"]) for r in sizes.filter("w > 0").collect())
    names, blocks = pa.array([r[0] for r in rows], pa.string()), [-(-r[1] // block_rows) for r in rows]
    path, horizon, at = new_path(spark, "mix-slots"), None, 0
    schema = "src string, block bigint, slot bigint"
    who, which = array("q"), array("q")

    def write() -> None:
        piece = pa.table([names.take(pa.array(who, pa.int64())), pa.array(which, pa.int64()), pa.array(range(at - len(who), at), pa.int64())], names=["src", "block", "slot"])
        spark.createDataFrame(piece, schema).write.mode("append").parquet(path)

    for i, block in _turns(blocks, [r[2] for r in rows]):
        who.append(i)
        which.append(block)
        if horizon is None and block == blocks[i] - 1:
            horizon = at
        at += 1
        if len(who) == _PIECE:
            write()
            del who[:], which[:]
    if len(who) or not at:
        write()
    return spark.read.schema(schema).parquet(path), horizon


def mix(docs: DataFrame, key: str = "doc_id", source: str = "source", weights: dict[str, float] | None = None, block_rows: int = BLOCK_ROWS, alpha: float = ALPHA) -> DataFrame:
    """``docs`` with slot (long), place in the block (long) and in_mix; order by slot, place is the mix."""
    names = {c: free_name(docs.columns, c) for c in ("slot", "place", "in_mix")}
    own = free_prefix(docs.columns, "mix_")
    src, h, rng, n_ranges, before, rank, slots = (f"{own}{c}" for c in ("src", "hash", "range", "ranges", "before", "rank", "slots"))
    sources = materialise(targets(docs, source, weights, alpha), "mix-targets")
    schedule, horizon = exact_schedule(docs.sparkSession, sources, block_rows)
    known = sources.select(F.col("src").alias(src), F.greatest(F.lit(1), F.expr(f"(n + {RANGE_ROWS - 1}) div {RANGE_ROWS}")).alias(n_ranges))
    placed = docs.withColumn(src, F.coalesce(F.col(source), F.lit(""))).withColumn(h, _order_hash(F.col(key)))
    placed = placed.join(known, src).withColumn(rng, F.shiftright(F.shiftright(F.col(h), 60 - _HASH_BITS) * F.col(n_ranges), _HASH_BITS))
    sizes = placed.groupBy(src, rng).agg(F.count(F.lit(1)).alias("n"))
    begins = sizes.withColumn(before, F.sum("n").over(Window.partitionBy(src).orderBy(rng)) - F.col("n"))
    # each range takes along the slots of its blocks, so rows are not shuffled again to find theirs
    first = F.expr(f"`{before}` div {block_rows}")
    spans = begins.withColumn("block", F.explode(F.sequence(first, F.expr(f"(`{before}` + n - 1) div {block_rows}"))))
    spans = spans.join(schedule.withColumnRenamed("src", src), [src, "block"], "left").groupBy(src, rng, before).agg(F.sort_array(F.collect_list(F.struct("block", "slot")))["slot"].alias(slots))
    inside = Window.partitionBy(src, rng).orderBy(h, key, F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns]))
    ranked = placed.withColumn(rank, F.row_number().over(inside) - 1).join(spans, [src, rng]).withColumn(rank, F.col(before) + F.col(rank))
    slot = F.get(slots, (F.expr(f"`{rank}` div {block_rows}") - first).cast("int"))
    return ranked.select(*docs.columns, slot.alias(names["slot"]), F.expr(f"`{rank}` % {block_rows}").cast("long").alias(names["place"]), F.coalesce(slot <= F.lit(horizon), F.lit(False)).alias(names["in_mix"]))
