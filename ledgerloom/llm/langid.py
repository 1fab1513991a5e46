"""Operator 10: language identification by inference of a mixture.

Training counts hashed byte trigrams of lower-cased texts by language, over all labelled rows. A document is
a mixture of languages: expectation-maximisation estimates the proportions from the trigrams' likelihoods,
for each number of languages (the most likely ones first), and the set of languages is the one of largest
penalised likelihood. The prediction is the language of largest proportion, the score is that proportion.

Batches of documents are computed together in numpy; only the model goes to the driver, a table of
languages times ``BUCKETS``, whatever the corpus.

Defined results: a text that is null or has no letter is ``und`` with score 0; rows of null language are not
learned from; with no labelled row every document is ``und``; a text with a letter but without a trigram ("ab") has equal
proportions: the first language by name, with score 1 / languages; a null id is in the learned part; repeated rows count
each; a text of any length is counted whole; an empty table gives an empty one; extra columns of ``predict`` are
dropped but for ``keep``, and an output column whose name is taken gets a leading underscore.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import free_name, small_batches
from .wordhash import buffers, chunks

#: Production parameters: trigram buckets, languages learned at most, cost of one more language in nats (times
#: log of the number of trigrams), steps of EM, smoothing.
BUCKETS, MOST_LANGUAGES, PENALTY, STEPS, SMOOTHING = 1 << 14, 256, 4.0, 12, 0.25
UNKNOWN = "und"
_BLOCK = 1 << 10
# ASCII other than letters is one class, a space
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[:128] = 32
_FOLD[97:123] = np.arange(97, 123)


def held_out(key: Column) -> Column:
    return F.coalesce(F.crc32(key.cast("string")) % 4 == 2, F.lit(False))


def _trigrams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of each trigram of folded bytes, and each text's range; runs of spaces are not counted."""
    raw, at = buffers(pc.utf8_lower(texts))
    if len(raw) < 3:
        return np.zeros(0, dtype=np.uint32), np.zeros(len(at), dtype=np.int64)
    b = _FOLD[raw].astype(np.uint32)
    code = (b[:-2] << np.uint32(16)) | (b[1:-1] << np.uint32(8)) | b[2:]
    ok = ~((b[:-2] == 32) & (b[1:-1] == 32)) & ~((b[1:-1] == 32) & (b[2:] == 32))
    edge = at[(at > 0) & (at < len(raw))]
    for back in (1, 2):
        inside = edge - back
        ok[inside[(inside >= 0) & (inside < len(ok))]] = False
    where = np.flatnonzero(ok)
    return (code[where] * np.uint32(2654435761)) >> np.uint32(32 - 14), np.searchsorted(where, np.minimum(at, len(ok)))


def train(docs: DataFrame, text: str = "text", lang: str = "lang") -> tuple[list[str], np.ndarray]:
    """Languages in order, and log P(trigram | language); ``docs`` has the rows to learn from."""
    small_batches(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = batch.column(1)
            for name in langs.unique().to_pylist():
                if name not in table:
                    if len(table) >= MOST_LANGUAGES:
                        raise ValueError(f"more than {MOST_LANGUAGES} languages")
                    table[name] = np.zeros(BUCKETS, dtype=np.int64)
                rows = batch.column(0).filter(pc.equal(langs, name))
                for a, b in chunks(rows):
                    table[name] += np.bincount(_trigrams(rows.slice(a, b - a))[0], minlength=BUCKETS)
        rows = [(n, i, c[i * _BLOCK : (i + 1) * _BLOCK].tolist()) for n, c in table.items() for i in range(BUCKETS // _BLOCK)]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.list_(pa.int64()))], names=["lang", "block", "counts"])

    got = docs.filter(F.col(lang).isNotNull()).select(F.coalesce(text, F.lit("")), lang).mapInArrow(count, "lang string, block int, counts array<bigint>")
    cells = got.select("lang", "block", F.posexplode("counts").alias("i", "n")).groupBy("lang", "block", "i").agg(F.sum("n").alias("n")).filter("n > 0")
    rows = cells.groupBy("lang", "block").agg(F.sort_array(F.collect_list(F.struct("i", "n"))).alias("cells")).collect()  # languages times BUCKETS at most
    names = sorted({r["lang"] for r in rows})
    if len(names) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    counts = np.zeros((len(names), BUCKETS))
    for r in rows:
        counts[names.index(r["lang"]), r["block"] * _BLOCK + np.array([c["i"] for c in r["cells"]])] = [c["n"] for c in r["cells"]]
    smooth = counts + SMOOTHING
    return names, np.log(smooth / smooth.sum(axis=1, keepdims=True)).astype(np.float32)


def infer(texts: pa.Array, log_p: np.ndarray) -> np.ndarray:
    """Proportions of the languages, documents by languages (uniform where there is no trigram)."""
    n, langs = len(texts), len(log_p)
    bucket, at = _trigrams(texts)
    doc = np.repeat(np.arange(n, dtype=np.int64), np.diff(at))
    cell, times = np.unique(doc * BUCKETS + bucket, return_counts=True)
    doc, bucket, times = cell // BUCKETS, cell % BUCKETS, times.astype(np.float32)
    begin = np.searchsorted(doc, np.arange(n))
    full = np.flatnonzero(np.bincount(doc, minlength=n) > 0)
    out = np.full((n, langs), 1.0 / max(langs, 1))
    if not len(full) or langs == 0:
        return out
    likely = log_p.T[bucket]
    top = likely.max(axis=1)
    p = np.exp(likely - top[:, None])
    total = np.add.reduceat(times, begin[full])
    row = np.searchsorted(full, doc)

    def fit(allowed: np.ndarray, steps: int, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """EM over the documents ``rows`` with the languages allowed to each: proportions and log likelihood."""
        pick = np.zeros(len(full), dtype=bool)
        pick[rows] = True
        use = np.flatnonzero(pick[row]) if len(rows) < len(full) else slice(None)
        pp, tt, rr = p[use], times[use], row[use]
        new = np.cumsum(pick) - 1
        rr = new[rr]
        starts = np.searchsorted(rr, np.arange(len(rows)))
        w = allowed / allowed.sum(axis=1, keepdims=True)
        for _ in range(steps):
            joint = pp * w[rr]
            joint *= (tt / joint.sum(axis=1))[:, None]
            w = np.add.reduceat(joint, starts, axis=0) / total[rows][:, None]
            w = np.maximum(w, 1e-12 * allowed)
        fitness = np.add.reduceat(tt * np.log((pp * w[rr]).sum(axis=1)), starts)
        return w, fitness

    every = np.arange(len(full))
    alone = np.add.reduceat(times[:, None] * np.log(p + 1e-30), begin[full], axis=0)
    first = alone.argmax(axis=1)
    best_w = np.zeros((len(full), langs))
    best_w[every, first] = 1.0
    best = alone[every, first] - PENALTY * np.log(total + 1)
    if langs > 1:
        mixed, _ = fit(np.ones((len(full), langs), dtype=np.float32), STEPS, every)
        order = np.argsort(-mixed, axis=1)
        rest = every[np.sort(mixed, axis=1)[:, -2] > 0.02]
        for k in range(2, langs + 1):
            if not len(rest):
                break
            allowed = np.zeros((len(rest), langs), dtype=np.float32)
            np.put_along_axis(allowed, order[rest, :k], 1.0, axis=1)
            w, fitness = fit(allowed, STEPS, rest)
            score = fitness - k * PENALTY * np.log(total[rest] + 1)
            better = score > best[rest]
            best[rest[better]], best_w[rest[better]] = score[better], w[better]
            rest = rest[np.take_along_axis(mixed[rest], order[rest, k : k + 1], axis=1)[:, 0] > 0.02] if k < langs else rest[:0]
    out[full] = best_w
    return out


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray], key: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """key, further columns of ``keep``, lang_pred, score and lang_set (the languages chosen, in order of proportion)."""
    spark = docs.sparkSession
    small_batches(spark)
    names, log_p = model
    sent = spark.sparkContext.broadcast(log_p)  # MOST_LANGUAGES x BUCKETS floats at most: 16 MB
    n, made = 1 + len(keep), [free_name([key, *keep], c) for c in ("lang_pred", "score", "lang_set")]
    piece = max(1 << 16, (8 << 20) // max(len(names), 4))  # arrays of trigrams by languages stay small
    read = [key, *keep] if text in keep else [key, *keep, text]
    spot = read.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = sent.value
        for batch in batches:
            for a, b in chunks(batch.column(spot), piece):
                part = batch.slice(a, b - a)
                texts = pc.fill_null(part.column(spot), "")
                letters = pc.match_substring_regex(texts, r"\pL").to_numpy(zero_copy_only=False)
                known = letters & bool(names)
                w = infer(texts, table)
                best = w.argmax(axis=1) if names else np.zeros(len(w), dtype=np.int64)
                lang = [names[i] if ok else UNKNOWN for i, ok in zip(best, known, strict=True)]
                score = np.clip(np.where(known, w.max(axis=1) if names else 0.0, 0.0), 0.0, 1.0)
                sets = [[names[j] for j in np.argsort(-x) if x[j] > 1e-6] if ok else [] for x, ok in zip(w, known, strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns[:n], pa.array(lang, pa.string()), pa.array(score), pa.array(sets, pa.list_(pa.string()))], names=[*part.schema.names[:n], *made])

    kinds = dict(docs.dtypes)
    fields = ", ".join(f"`{c}` {kinds[c]}" for c in (key, *keep))
    return docs.select(*read).mapInArrow(run, f"{fields}, {made[0]} string, {made[1]} double, {made[2]} array<string>")


def crc_held_out(doc_id: int) -> bool:
    """The same split outside Spark."""
    return zlib.crc32(str(doc_id).encode()) % 4 == 2
