"""Operator 2: substring dedup by super-k-mer partitioning.

A window is ``window`` consecutive words. Its minimiser is the least hash of the ``minimiser`` word grams in
it, so neighbouring windows mostly share one: such a run (a super-k-mer) travels as one packed string to the
bucket of its minimiser, where sorting the windows of all strings finds for each the least id of a document
that holds it. A word goes when some window over it is owned by a document of smaller id.

1. Texts are scanned once for runs (minimiser, place, fingerprint): small rows, written to the shared folder.
2. Minimisers that only one document has cannot repeat; only runs of the others go on, with their documents.
   Documents without such runs are finished here.
3. Packed strings, merged by fingerprint within a task, go to their buckets; a task sorts them minimiser by
   minimiser in bounded pieces. Minimisers whose runs hold more than ``hot_words`` words are not brought together: their
   windows are counted by a hash aggregation, which combines on the map side.
4. The owners come back by fingerprint and are joined to the documents that wait.

Defined results: a null or short text has no windows, nothing is removed; a row of null id owns nothing and
loses nothing; rows that repeat an id do not count against each other; a text of any length is judged whole, and a
worker holds some twenty times its size; an empty table gives an empty one; extra columns are dropped.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import materialise, small_batches
from .wordhash import GRAM_BASE, GRAM_BASE_2, buffers, chunks, grams, hash_slices, hash_spans, sliding_min, spans

#: Production parameters: words of a window and of a minimiser gram, windows of a run at most (longer runs are
#: cut, each part is judged), words of one minimiser's runs that are sorted together (some 60 bytes of arrays for each).
WINDOW, MINIMISER, LONGEST_RUN, HOT_WORDS = 50, 16, 256, 1 << 20
_PIECE = 8 << 20


def super_kmers(texts: pa.Array, window: int = WINDOW, minimiser: int = MINIMISER, longest: int = LONGEST_RUN) -> dict[str, np.ndarray]:
    """Runs of windows that share a minimiser: row of the text, first word, number of windows, minimiser, fingerprint."""
    raw, at = buffers(texts)
    starts, ends, of = spans(raw, at)
    h = hash_spans(raw, starts, ends)
    n = len(h) - window + 1
    if n <= 0:
        none = np.zeros(0, dtype=np.int64)
        return {"row": none, "start": none, "n": none, "mini": none, "print": none}
    least = sliding_min(grams(h, minimiser), window - minimiser + 1)
    row = np.repeat(np.arange(len(of) - 1), np.diff(of))
    ok = row[:n] == row[window - 1 :]
    new = ok.copy()
    new[1:] &= ~ok[:-1] | (least[1:] != least[:-1])
    first = np.flatnonzero(new)
    count = np.bincount(np.cumsum(new)[ok] - 1, minlength=len(first))
    parts = -(-count // longest)
    which = np.repeat(np.arange(len(first)), parts)
    step = np.arange(len(which)) - np.repeat(np.cumsum(parts) - parts, parts)
    begin = first[which] + step * longest
    size = np.minimum(longest, count[which] - step * longest)
    prints = hash_slices(h, begin, begin + size + window - 1)
    return {"row": row[begin], "start": begin - of[row[begin]], "n": size, "mini": least[begin].view(np.int64), "print": prints.view(np.int64)}


def scan(docs: DataFrame, window: int = WINDOW, minimiser: int = MINIMISER, longest: int = LONGEST_RUN) -> DataFrame:
    """Runs of ``docs`` (id, th, text): id, th, start, n, mini, print."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in chunks(batch.column(2)):
                part = batch.slice(a, b - a)
                got = super_kmers(part.column(2), window, minimiser, longest)
                rows = pa.array(got["row"])
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(rows), part.column(1).take(rows), pa.array(got["start"].astype(np.int32)), pa.array(got["n"].astype(np.int32)), pa.array(got["mini"]), pa.array(got["print"])],
                    names=["id", "th", "start", "n", "mini", "print"],
                )

    return docs.mapInArrow(run, "id bigint, th bigint, start int, n int, mini bigint, print bigint")


def _pack(waiting: DataFrame, window: int) -> DataFrame:
    """The packed strings of runs: mini, print, hot, packed, id (the least of a batch's equal strings)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["mini", "print", "hot", "packed", "id"]
        for batch in batches:
            seen: dict[int, list] = {}
            for doc, text, runs in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                words = text.encode("utf-8").split()
                for r in runs:
                    got = seen.get(r["print"])
                    if got is None:
                        seen[r["print"]] = [r["mini"], r["hot"], b" ".join(words[r["start"] : r["start"] + r["n"] + window - 1]), doc]
                    elif doc < got[3]:
                        got[3] = doc
            v = list(seen.values())
            yield pa.RecordBatch.from_arrays(
                [pa.array([x[0] for x in v], pa.int64()), pa.array(list(seen), pa.int64()), pa.array([x[1] for x in v], pa.bool_()), pa.array([x[2] for x in v], pa.binary()), pa.array([x[3] for x in v], pa.int64())],
                names=names,
            )

    return waiting.select("id", "text", "runs").mapInArrow(run, "mini bigint, print bigint, hot boolean, packed binary, id bigint")


def _windows(packed: pa.Array, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of every window in the packed strings: the string's row and 128 bits of hash."""
    raw, at = buffers(packed)
    starts, ends, of = spans(raw, at)
    h = hash_spans(raw, starts, ends)
    n = max(len(h) - window + 1, 0)
    row = np.repeat(np.arange(len(of) - 1), np.diff(of))
    ok = np.flatnonzero(row[:n] == row[window - 1 :][:n])
    return row[ok], grams(h, window, GRAM_BASE)[ok], grams(h, window, GRAM_BASE_2)[ok]


_OWNERS = "print bigint, lens array<int>, owners array<bigint>"


def _owner_lists(prints: np.ndarray, rows: np.ndarray, owner: np.ndarray) -> pa.RecordBatch:
    """Run lengths of the owners of each string's windows; ``rows`` ascends and has every string."""
    change = np.ones(len(rows), dtype=bool)
    change[1:] = (rows[1:] != rows[:-1]) | (owner[1:] != owner[:-1])
    at = np.flatnonzero(change)
    lens = np.diff(np.concatenate((at, [len(rows)])))
    offsets = pa.array(np.searchsorted(rows[at], np.arange(len(prints) + 1)).astype(np.int32))
    return pa.RecordBatch.from_arrays(
        [pa.array(prints), pa.ListArray.from_arrays(offsets, pa.array(lens.astype(np.int32))), pa.ListArray.from_arrays(offsets, pa.array(owner[at]))],
        names=["print", "lens", "owners"],
    )


def _sort_windows(table: pa.Table, window: int) -> pa.RecordBatch:
    """Owners of all windows of some minimisers' strings."""
    ids = table["id"].to_numpy()
    prints = table["print"].to_numpy()
    rows, a, b = _windows(table["packed"].combine_chunks(), window)
    order = np.lexsort((b, a))
    sa, sb = a[order], b[order]
    begin = np.ones(len(order), dtype=bool)
    begin[1:] = (sa[1:] != sa[:-1]) | (sb[1:] != sb[:-1])
    at = np.flatnonzero(begin)
    least = np.minimum.reduceat(ids[rows[order]], at) if len(at) else ids[:0]
    owner = np.empty(len(order), dtype=np.int64)
    owner[order] = least[np.cumsum(begin) - 1]
    _, one = np.unique(prints, return_index=True)  # tasks may have sent equal strings
    one.sort()
    keep = np.isin(rows, one)
    return _owner_lists(prints[one], np.searchsorted(one, rows[keep]), owner[keep])


def owners(packed: DataFrame, window: int = WINDOW) -> DataFrame:
    """Per fingerprint: run lengths and owners (least ids) of its windows."""
    cool = packed.filter(~F.col("hot")).repartition("mini").sortWithinPartitions("mini")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
            if sum(x.nbytes for x in held) >= _PIECE:
                table = pa.Table.from_batches(held)
                minis = table["mini"].to_numpy()
                cut = int(np.searchsorted(minis, minis[-1]))
                if cut:
                    yield _sort_windows(table.slice(0, cut), window)
                    held = table.slice(cut).to_batches()
        if held:
            yield _sort_windows(pa.Table.from_batches(held), window)

    sorted_out = cool.select("mini", "print", "packed", "id").mapInArrow(run, _OWNERS)

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, a, b = _windows(batch.column(1), window)
            prints, ids = batch.column(0).to_numpy()[rows], batch.column(2).to_numpy()[rows]
            at = np.arange(len(rows)) - np.searchsorted(rows, rows)
            yield pa.RecordBatch.from_arrays([pa.array(prints), pa.array(at.astype(np.int32)), pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), pa.array(ids)], names=["print", "i", "a", "b", "id"])

    hot = packed.filter("hot").select("print", "packed", "id").mapInArrow(explode, "print bigint, i int, a bigint, b bigint, id bigint")
    least = hot.groupBy("a", "b").agg(F.min("id").alias("owner"))
    placed = hot.select("print", "i", "a", "b").distinct().join(least, ["a", "b"]).groupBy("print").agg(F.sort_array(F.collect_list(F.struct("i", "owner"))).alias("w"))
    counted = placed.select("print", F.transform("w", lambda x: F.lit(1)).alias("lens"), F.transform("w", lambda x: x["owner"]).alias("owners"))
    return sorted_out.unionByName(counted)


def _finish(found: DataFrame, window: int) -> DataFrame:
    """Judge the words of documents (id, text, marks): marks are runs' first words with their windows' owners."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc, text, marks in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                words = (text or "").encode("utf-8").split()
                delta = np.zeros(len(words) + 1, dtype=np.int64)
                for m in marks or ():
                    at = m["start"]
                    for n, owner in zip(m["lens"], m["owners"], strict=True):
                        if owner < doc:
                            delta[at] += 1
                            delta[at + n + window - 1] -= 1
                        at += n
                gone = np.cumsum(delta[:-1]) > 0
                kept = b" ".join(w for w, g in zip(words, gone, strict=True) if not g) if marks else b" ".join(words)
                out.append((doc, len(words), int(gone.sum()), hashlib.sha256(kept).hexdigest()))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.string()))], names=["id", "n_words", "n_removed", "kept_sha256"])

    return found.select("id", "text", "marks").mapInArrow(run, "id bigint, n_words bigint, n_removed bigint, kept_sha256 string")


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW, minimiser: int = MINIMISER, longest: int = LONGEST_RUN, hot_words: int = HOT_WORDS) -> DataFrame:
    """Per row: key, n_words, n_removed, kept_sha256 of the words that stay, joined by one space."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(key).cast("long").alias("id"), F.xxhash64(text).alias("th"), F.col(text).alias("text"))
    runs = materialise(scan(rows.filter("id is not null and text is not null").select("id", "th", "text"), window, minimiser, longest), "runs")
    shared = runs.groupBy("mini").agg(F.min("id").alias("low"), F.max("id").alias("high"), F.sum(F.col("n").cast("long") + (window - 1)).alias("words")).filter("low < high")
    wanted = runs.join(shared.select("mini", (F.col("words") > hot_words).alias("hot")), "mini")
    by_doc = wanted.groupBy("id", "th").agg(F.collect_list(F.struct("start", "n", "mini", "print", "hot")).alias("runs"))
    joined = rows.join(by_doc, ["id", "th"], "left")
    state = materialise(_settle(joined), "settled")
    waiting = state.filter("runs is not null")
    packed = _pack(waiting, window)
    owned = owners(packed, window)
    each = waiting.select("id", "th", F.explode("runs").alias("r")).select("id", "th", "r.start", "r.print")
    marks = each.join(owned, "print").filter(F.array_min("owners") < F.col("id")).groupBy("id", "th").agg(F.collect_list(F.struct("start", "lens", "owners")).alias("marks"))
    finished = _finish(waiting.select("id", "th", "text").join(marks, ["id", "th"], "left"), window)
    done = state.filter("runs is null").select("id", "n_words", F.lit(0).cast("long").alias("n_removed"), "kept_sha256")
    return done.unionByName(finished).withColumnRenamed("id", key)


def _settle(joined: DataFrame) -> DataFrame:
    """Finish documents without shared runs; keep the text of the others."""
    run_type = joined.schema["runs"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            waits = batch.column(3).is_valid()
            done = [None if w else b" ".join((t or "").encode("utf-8").split()) for t, w in zip(batch.column(2).to_pylist(), waits.to_pylist(), strict=True)]
            counts = [None if x is None else x.count(b" ") + 1 if x else 0 for x in done]
            digests = [None if x is None else hashlib.sha256(x).hexdigest() for x in done]
            texts = pc.if_else(waits, batch.column(2), pa.scalar(None, batch.column(2).type))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), texts, batch.column(3), pa.array(counts, pa.int64()), pa.array(digests, pa.string())], names=["id", "th", "text", "runs", "n_words", "kept_sha256"])

    return joined.select("id", "th", "text", "runs").mapInArrow(run, f"id bigint, th bigint, text string, runs {run_type}, n_words bigint, kept_sha256 string")
