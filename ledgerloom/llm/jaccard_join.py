"""Operator 7: n-gram Jaccard self-join with rare-first prefix filtering, and the components of its links.

1. One scan reduces each text to its set of word shingles (64-bit hashes), with its size and a 128-bit signature.
   Shingles go, packed by chunks of documents, to buckets by hash, which count exactly in how many documents each
   stands; only those of two documents or more come back to their chunk. Texts move nowhere.
2. Shingles are ordered by frequency, rare ones first, then by hash. Two sets that are similar enough share a
   shingle among the first ``n - ceil(t n) + 1`` of each. Shingles that one document has alone come first and
   link nothing, so a document whose prefix holds no other is finished here.
3. Texts of equal sets form a class; its least id stands for it. Prefix shingles of these are joined. Near copies
   share most prefix shingles, so pairs are not made within a shingle's list at once: in each round the documents
   outside the list's largest component are verified against one member of it, and links merge components. Once
   what is left is in proportion to the lists, documents of different components that still share a
   prefix shingle and pass the length, positional and suffix filters are paired. Each pair is verified once.
   The suffix filter bounds the number of shingles that only one of two sets has: at first by parity bitmaps that
   postings carry, before any set moves, then by sizes on either side of split values, before each exact comparison.

Everything that grows with the data is a table: no broadcast, no sketch, no bound on a list.

Defined results: a text that is null or has no words has the empty set and no link; a text of fewer words than
a shingle has its whole sequence as its only one; ids are unique among rows of different texts (equal rows
give equal results); a null id keeps its row and has no link; extra columns are dropped; a text of any length is one
set, of which a worker holds about ten times the text's size; an empty table gives an empty one. A task of the scan
that runs again must see its rows in the same order, as tables give them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .components import components
from .shared import finished, join_groups, materialise, small_batches
from .wordhash import LOWER_VALUES, buffers, chunks, grams, hash_slices, hash_spans, mix, spans

#: Production parameters: words of a shingle, similarity in per cent, shingles of a bucket (about), bytes of text in a
#: chunk (about), members that one task verifies against a leader at most (about), rounds of leaders at most.
WORDS, PERCENT, BUCKET_ROWS, CHUNK, GROUP_ROWS, ROUNDS = 5, 75, 1_000_000, 4 << 20, 2048, 3
#: Postings of its document that a posting knows before it (a pair that these miss is made twice and merged).
BACK = 32
#: Documents of a chunk, so that 16 bits name one.
_CHUNK_DOCS = 60_000
_U = np.uint64


def shingle_sets(texts: pa.Array, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle hashes of each text, ascending, one text after another, and where each begins."""
    raw, at = buffers(texts)
    starts, ends, of = spans(raw, at)
    h = hash_spans(raw, starts, ends, LOWER_VALUES)
    count = np.diff(of)
    g = grams(h, words)
    row = np.repeat(np.arange(len(count)), count)
    inside = row[: len(g)] == row[words - 1 :][: len(g)] if len(g) else np.zeros(0, dtype=bool)
    short = np.flatnonzero((count > 0) & (count < words))
    flat = np.concatenate((g[inside], mix(hash_slices(h, of[short], of[short] + count[short]) + _U(words))))
    owner = np.concatenate((row[: len(g)][inside], short))
    if len(short):
        order = np.argsort(owner, kind="stable")
        flat, owner = flat[order], owner[order]
    edges = np.searchsorted(owner, np.arange(len(count) + 1))
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        flat[a:b].sort()
    keep = np.ones(len(flat), dtype=bool)
    keep[1:] = (flat[1:] != flat[:-1]) | (owner[1:] != owner[:-1])
    return flat[keep], np.concatenate(([0], np.cumsum(keep)))[edges]


def least_overlap(n: int, m: int, percent: int = PERCENT) -> int:
    """Shared shingles that sets of n and m need for the similarity."""
    return -(-percent * (n + m) // (100 + percent))


def suffix_bound(x: np.ndarray, y: np.ndarray, depth: int = 3) -> int:
    """At least as many as x and y share: sizes of the parts on either side of y's middle, again and again."""
    if depth == 0 or len(x) < 8 or len(y) < 8:
        return min(len(x), len(y))
    middle = len(y) // 2
    cut = int(np.searchsorted(x, y[middle]))
    return suffix_bound(x[:cut], y[:middle], depth - 1) + suffix_bound(x[cut:], y[middle:], depth - 1)


def similar(x: np.ndarray, y: np.ndarray, n: int, m: int, percent: int = PERCENT) -> bool:
    """Whether sets of n and m members have the similarity, exactly; x and y, sorted, hold all that the two may share."""
    need = least_overlap(n, m, percent)
    if min(len(x), len(y)) < need or suffix_bound(x, y) < need:
        return False
    small, large = (x, y) if len(x) <= len(y) else (y, x)
    spot = np.searchsorted(large, small)
    spot[spot == len(large)] = 0
    shared = int((large[spot] == small).sum())
    return 100 * shared >= percent * (n + m - shared)


def _packed(values: np.ndarray, at: np.ndarray) -> pa.Array:
    """Slices of ``values``, cut at ``at``, as byte strings."""
    return pa.BinaryArray.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer((at * values.itemsize).astype(np.int32).tobytes()), pa.py_buffer(values.tobytes())])


def _steps(keys: np.ndarray) -> bytes:
    """Ascending keys: the first one, and the steps to the next ones in as few bytes as the largest step needs."""
    step = np.diff(keys)
    width = (int(step.max(initial=0)).bit_length() + 7) // 8
    return keys[:1].tobytes() + step.view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def _unsteps(raw: bytes, n: int) -> np.ndarray:
    """The n keys of ``_steps``."""
    step = np.zeros((n, 8), dtype=np.uint8)
    step[0] = np.frombuffer(raw, dtype=np.uint8, count=8)
    if n > 1:
        step[1:, : (len(raw) - 8) // (n - 1)] = np.frombuffer(raw, dtype=np.uint8, offset=8).reshape(n - 1, -1)
    return np.cumsum(step.reshape(-1).view(np.uint64), dtype=np.uint64)


def _edges(x: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin, and the end."""
    return np.flatnonzero(np.concatenate(([True], x[1:] != x[:-1], [True]))) if len(x) else np.zeros(1, dtype=np.int64)


_SHINGLES = "bucket bigint, chunk bigint, keys binary, who binary, about binary"


def scan(docs: DataFrame, buckets: int, words: int = WORDS) -> DataFrame:
    """Of ``docs`` (id, text): a row per chunk and bucket (shingles, ascending, and whose they are), and one of the chunk's documents."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, held, size, rows, seq = TaskContext.get().partitionId() << 32, [], 0, 0, 0

        def close() -> pa.RecordBatch:
            sets = [shingle_sets(b.column(1).slice(i, j - i), words) for b in held for i, j in chunks(b.column(1))]
            flat = np.concatenate([s[0] for s in sets])
            n = np.concatenate([np.diff(s[1]) for s in sets])
            valid = np.concatenate([b.column(0).is_valid().to_numpy(zero_copy_only=False) for b in held])
            ids = np.concatenate([b.column(0).fill_null(0).to_numpy() for b in held])
            at = np.concatenate(([0], np.cumsum(n)))
            sums = [np.concatenate((np.zeros(1, dtype=_U), np.cumsum(mix(flat + _U(salt)), dtype=_U))) for salt in (1, 2**40 + 1)]
            about = np.stack((ids, valid, n, *((s[at[1:]] - s[at[:-1]]).view(np.int64) for s in sums))).astype(np.int64)
            who = np.repeat(np.arange(len(n), dtype=np.uint16), n)
            if not valid.all():
                used = np.repeat(valid, n)
                flat, who = flat[used], who[used]
            order = np.argsort(flat, kind="stable")
            flat, who = flat[order], who[order]
            bucket = ((flat >> _U(32)) * _U(buckets)) >> _U(32)
            cut, chunk = _edges(bucket), first + seq
            made = len(cut) - 1
            where = np.concatenate((bucket[cut[:-1]].astype(np.int64), [chunk * 0x9E3779B1 % buckets]))
            keys = [_steps(flat[x:y]) for x, y in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]
            return pa.RecordBatch.from_arrays(
                [pa.array(where), pa.array(np.full(made + 1, chunk)), pa.array([*keys, None], pa.binary()), pa.concat_arrays([_packed(who, cut), pa.nulls(1, pa.binary())]), pa.array([None] * made + [about.tobytes()], pa.binary())],
                names=["bucket", "chunk", "keys", "who", "about"],
            )

        for batch in batches:
            for i, j in chunks(batch.column(1), CHUNK):
                part = batch.slice(i, j - i)
                held.append(part)
                size, rows = size + len(buffers(part.column(1))[0]), rows + part.num_rows
                if size >= CHUNK or rows >= _CHUNK_DOCS - 512:
                    yield close()
                    held, size, rows, seq = [], 0, 0, seq + 1
        if held:
            yield close()

    return docs.mapInArrow(run, _SHINGLES)


def _binary(values: list[bytes | None]) -> pa.Array:
    return pa.array(values, pa.binary())


def frequencies(packed: DataFrame) -> DataFrame:
    """Per chunk and bucket: the shingles of two documents or more, whose they are, and of how many documents; rows about chunks pass."""
    names = ["chunk", "keys", "who", "freq", "about"]

    def count(rows: list[tuple]) -> pa.RecordBatch:
        who = np.concatenate([np.frombuffer(r[2], dtype=np.uint16) for r in rows])
        key = np.concatenate([_unsteps(r[1], len(r[2]) // 2) for r in rows])
        order = np.argsort(key, kind="stable")
        cut = _edges(key[order])
        freq = np.empty(len(key), dtype=np.uint32)
        freq[order] = np.repeat(np.diff(cut), np.diff(cut))
        keep = freq > 1
        row = np.repeat(np.arange(len(rows)), [len(r[2]) // 2 for r in rows])
        at = np.concatenate(([0], np.cumsum(np.bincount(row[keep], minlength=len(rows)))))
        out = pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), *(_packed(x[keep], at) for x in (key, who, freq)), pa.nulls(len(rows), pa.binary())], names=names)
        return out.filter(pa.array(np.diff(at) > 0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, now = [], None
        for batch in batches:
            for bucket, chunk, keys, who, about in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if about is not None:
                    yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int64()), *[pa.nulls(1, pa.binary())] * 3, _binary([about])], names=names)
                    continue
                if held and bucket != now:
                    yield count(held)
                    held = []
                now = bucket
                held.append((chunk, keys, who))
        if held:
            yield count(held)

    return packed.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, "chunk bigint, keys binary, who binary, freq binary, about binary")


_BITS = ["w0", "w1", "w2", "w3"]
_SETS = "id bigint, n int, s1 bigint, s2 bigint, prefix binary, list binary, w0 bigint, w1 bigint, w2 bigint, w3 bigint"


def sets(counted: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Per document: id, n, signature; if its prefix reaches shared shingles, these in order, all shared ones, ascending, and how often each of 256 classes of them occurs, modulo 2."""

    def judge(parts: list[tuple], about: bytes) -> pa.RecordBatch:
        ids, valid, n, s1, s2 = np.frombuffer(about, dtype=np.int64).reshape(5, -1)
        key, who, freq = (np.concatenate([np.zeros(0, dtype=k), *(np.frombuffer(p[i], dtype=k) for p in parts)]) for i, k in enumerate((np.uint64, np.uint16, np.uint32)))
        shared = np.bincount(who, minlength=len(ids))
        size = n - -(-percent * n // 100) + 1
        reaches = (shared > 0) & (n - shared < size)
        used = reaches[who]
        key, who, freq = key[used], who[used], freq[used]
        count = np.where(reaches, shared, 0)
        order = np.lexsort((key, who))
        lists = key[order]
        order = np.lexsort((key, freq, who))
        at = np.concatenate(([0], np.cumsum(count)))
        short = np.where(reaches, np.minimum(size - (n - shared), shared), 0)
        prefix_at = np.concatenate(([0], np.cumsum(short)))
        prefix = key[order][np.repeat(at[:-1] - prefix_at[:-1], short) + np.arange(prefix_at[-1])]
        none = pa.scalar(None, pa.binary())
        odd = (np.bincount(who.astype(np.int64) * 256 + (key >> _U(56)).astype(np.int64), minlength=len(ids) * 256) & 1).astype(np.uint8)
        bits = np.packbits(odd.reshape(-1, 256), axis=1).view(np.int64)
        cells = [pc.if_else(pa.array(reaches), _packed(x, cut), none) for x, cut in ((prefix, prefix_at), (lists, at))]
        return pa.RecordBatch.from_arrays([pa.array(ids, mask=valid == 0), pa.array(n.astype(np.int32)), pa.array(s1), pa.array(s2), *cells, *(pa.array(np.ascontiguousarray(bits[:, i])) for i in range(4))], names=["id", "n", "s1", "s2", "prefix", "list", *_BITS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, about, now = [], None, None
        for batch in batches:
            for chunk, *part, facts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if about is not None and chunk != now:
                    yield judge(parts, about)
                    parts, about = [], None
                now = chunk
                if facts is not None:
                    about = facts
                else:
                    parts.append(part)
        if about is not None:
            yield judge(parts, about)

    return counted.repartition("chunk").sortWithinPartitions("chunk").mapInArrow(run, _SETS)


_POSTING = ["token", "id", "n", "pos"]


def postings(prefixes: DataFrame) -> DataFrame:
    """Rows (token, id, n, pos) of ``prefixes`` (id, n, shared, prefix): pos counts the shingles of one document alone, which come first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, n, shared = (batch.column(i).to_numpy() for i in range(3))
            raw, at = buffers(batch.column(3))
            token, size = np.frombuffer(raw.tobytes(), dtype=np.int64), np.diff(at) // 8
            pos = np.arange(len(token)) - np.repeat(at[:-1] // 8, size) + np.repeat(n - shared, size)
            yield pa.RecordBatch.from_arrays([pa.array(token), pa.array(np.repeat(ids, size)), pa.array(np.repeat(n, size)), pa.array(pos.astype(np.int32))], names=_POSTING)

    return prefixes.select("id", "n", "shared", "prefix").mapInArrow(run, "token bigint, id bigint, n int, pos int")


def verify(pairs: DataFrame, lists: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Of ``pairs`` (a, b), those whose sets (id, n, list) are similar. Members of one leader b are dealt to several tasks."""
    sized = pairs.groupBy("b").agg(F.expr(f"(count(1) + {GROUP_ROWS - 1}) div {GROUP_ROWS}").alias("parts"))
    dealt = pairs.join(sized, "b").withColumn("part", F.pmod(F.xxhash64("a"), F.col("parts")).cast("int"))
    lists = lists.select("id", "n", "list")
    members = dealt.join(lists.withColumnRenamed("id", "a"), "a").select("b", "part", "a", "n", "list")
    leads = sized.select("b", F.explode(F.sequence(F.lit(0), (F.col("parts") - 1).cast("int"))).alias("part"), F.lit(None).cast("bigint").alias("a")).join(lists.withColumnRenamed("id", "b"), "b")
    both = members.unionByName(leads.select("b", "part", "a", "n", "list")).repartition("b", "part").sortWithinPartitions("b", "part", F.col("a").asc_nulls_first())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lead, leader, m = None, None, 0
        for batch in batches:
            hit = []
            for b, a, n, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own = np.frombuffer(raw, dtype=np.uint64)
                if a is None:
                    lead, leader, m = b, own, n
                elif b == lead and similar(own, leader, n, m, percent):
                    hit.append((a, b))
            if hit:
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in hit], pa.int64()), pa.array([x[1] for x in hit], pa.int64())], names=["a", "b"])

    return both.select("b", "a", "n", "list").mapInArrow(run, "a bigint, b bigint")


def may_link(x: str, y: str, percent: int) -> Column:
    """Length and positional filters on two postings (columns n and pos with these suffixes) of one shingle.

    Of the shingles that two sets share, the first one stands so early in both that enough are left after it;
    a pair is made there, and not where later shingles meet.
    """
    length = F.expr(f"100 * n{x} >= {percent} * n{y} and 100 * n{y} >= {percent} * n{x}")
    need = F.expr(f"(cast({percent} as bigint) * (n{x} + n{y}) + {99 + percent}) div {100 + percent}")
    return length & (F.least(F.expr(f"n{x} - pos{x}"), F.expr(f"n{y} - pos{y}")) >= need)


def several(postings: DataFrame) -> DataFrame:
    """Lists of two documents or more: each document is a component, the greatest id is the list's base."""
    facts = postings.groupBy("token").agg(F.max("id").alias("base"), F.count(F.lit(1)).alias("rows")).filter("rows > 1")
    return postings.withColumn("component", F.col("id")).join(facts, "token")


def mixed_lists(lists: DataFrame) -> DataFrame:
    """Of ``lists`` (token, id, n, pos, component), those of several components, with the list's size (rows) and its largest component (base)."""
    by_comp = lists.groupBy("token", "component").agg(F.count(F.lit(1)).alias("rows"))
    facts = by_comp.groupBy("token").agg(F.max_by("component", F.struct("rows", "component")).alias("base"), F.sum("rows").alias("rows"), F.count(F.lit(1)).alias("comps"))
    return lists.select(*_POSTING, "component").join(facts.filter("comps > 1").drop("comps"), "token")


def candidates(lists: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Pairs (a, b), a > b, of documents of different components that share a prefix shingle and pass the filters.

    ``lists`` is of ``mixed_lists``, ``sets`` has id, shared and the bitmaps. In each list the largest component is not joined with itself: only documents
    outside it look for partners in the list. A posting knows the ``BACK`` ones before it: where two documents share one of
    these, their pair is made there.
    """
    before = Window.partitionBy("id").orderBy("pos").rowsBetween(-BACK, -1)
    lists = lists.withColumn("back", F.collect_list("token").over(before)).join(sets.select("id", "shared", *_BITS), "id")
    carried = ("id", "n", "pos", "back", "component", "shared", *_BITS)
    x = lists.filter("component <> base").select("token", "base", *(F.col(c).alias(f"{c}_x") for c in carried))
    y = lists.select("token", *(F.col(c).alias(f"{c}_y") for c in carried))
    once = (F.col("component_y") == F.col("base")) | (F.col("id_x") > F.col("id_y"))
    first = ~F.arrays_overlap("back_x", "back_y")
    apart = " + ".join(f"bit_count({w}_x ^ {w}_y)" for w in _BITS)
    near = F.expr(f"(shared_x + shared_y - ({apart})) div 2 >= (cast({percent} as bigint) * (n_x + n_y) + {99 + percent}) div {100 + percent}")
    joined = x.join(y, (x["token"] == y["token"]) & (F.col("component_x") != F.col("component_y")) & may_link("_x", "_y", percent) & once & near & first)
    return joined.select(F.greatest("id_x", "id_y").alias("a"), F.least("id_x", "id_y").alias("b")).distinct()


def leader_pairs(lists: DataFrame, nth: int, percent: int = PERCENT) -> DataFrame:
    """Pairs (a, b) of documents a outside the largest component of a list and a member b of it that the round's hash picks; with their components, and in how many lists they met."""
    speaker = lists.filter("component = base").groupBy("token").agg(F.min_by(F.struct("id", "n", "pos"), F.struct(F.xxhash64("id", F.lit(nth)), "id")).alias("s"))
    speaker = speaker.select("token", F.col("s.id").alias("b"), F.col("s.n").alias("n_l"), F.col("s.pos").alias("pos_l"))
    met = lists.filter("component <> base").join(speaker, "token").filter(may_link("", "_l", percent))
    return met.groupBy(F.col("id").alias("a"), "b").agg(F.count(F.lit(1)).alias("shared"), F.first("component").alias("of_a"), F.first("base").alias("of_b"))


def relabelled(lists: DataFrame, hits: DataFrame) -> DataFrame:
    """``lists`` with components merged along links (of_a, of_b) of components: each takes the least name at two steps or fewer.

    So documents of one component are connected; not all that are connected are of one component yet.
    """
    steps = hits.select("of_a", "of_b").unionByName(hits.select(F.col("of_b").alias("of_a"), F.col("of_a").alias("of_b"))).distinct()
    first = steps.groupBy("of_a").agg(F.least("of_a", F.min("of_b")).alias("to"))
    second = steps.join(first.select(F.col("of_a").alias("of_b"), F.col("to").alias("then")), "of_b").groupBy(F.col("of_a").alias("component")).agg(F.least("of_a", F.min("of_b"), F.min("then")).alias("to"))
    return lists.select(*_POSTING, "component").join(second, "component", "left").select(*_POSTING, F.coalesce("to", "component").alias("component"))


def _prepared(docs: DataFrame, key: str, text: str, words: int, percent: int, bucket_rows: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows with their class, the postings of class representatives that stand in lists of several, and the sets of these."""
    rows = docs.select(F.col(key).cast("long").alias("id"), F.coalesce(text, F.lit("")).alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    found = materialise(sets(frequencies(scan(rows, max(64, total // (6 * bucket_rows)), words)), percent), "sets")
    narrow = found.select("id", "n", "s1", "s2")
    classes = narrow.filter("n > 0 and id is not null").groupBy("s1", "s2", "n").agg(F.min("id").alias("class_id"))
    members = join_groups(narrow, classes, ["s1", "s2", "n"], F.col("id")).select("id", "n", "class_id")
    members = materialise(members.withColumn("class_id", F.when(F.col("id").isNotNull(), F.coalesce("class_id", "id"))), "classes")
    reps = members.filter("id = class_id").select("id").distinct()
    lists = found.filter("list is not null and id is not null").select("id", "n", "prefix", "list", *_BITS).join(reps, "id", "left_semi").dropDuplicates(["id"])
    lists = materialise(lists.withColumn("shared", F.expr("octet_length(list) div 8").cast("int")), "lists")
    finished(found)
    return members, materialise(several(postings(lists)), "postings"), lists


def all_links(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS, percent: int = PERCENT, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """All links a, b (a > b) between representatives (least ids) of classes of equal sets: in a group as many as its pairs.

    Every candidate pair is verified, whether or not other links connect it already.
    """
    _, open_lists, lists = _prepared(docs, key, text, words, percent, bucket_rows)
    pairs = materialise(candidates(open_lists, lists, percent), "pairs")  # each on its own: no pair is skipped
    return verify(pairs, lists, percent)


def link(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS, percent: int = PERCENT, bucket_rows: int = BUCKET_ROWS, rounds: int = ROUNDS) -> DataFrame:
    """Per row: key, n_shingles, class_id (least id of the equal sets) and component_id (least id reachable by links)."""
    members, open_lists, lists = _prepared(docs, key, text, words, percent, bucket_rows)
    tried, links = None, None
    for nth in range(rounds):
        # what the join below may have to look at; it costs less than a round when in proportion to the lists
        left, rows = open_lists.agg(F.coalesce(F.sum(F.expr("if(component <> base, rows, 0)")), F.lit(0)), F.count(F.lit(1))).first()
        if nth and left <= 4 * rows:
            break
        met = leader_pairs(open_lists, nth, percent)
        fresh = met if tried is None else met.join(tried, ["a", "b"], "left_anti")
        best = fresh.groupBy("a").agg(F.max_by(F.struct("b", "of_a", "of_b"), F.struct("shared", "b")).alias("p"))
        pairs = materialise(best.select("a", "p.*"), "leader-pairs")
        hits = materialise(verify(pairs, lists, percent).join(pairs, ["a", "b"]), "links")
        both = pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        tried, links = (both, hits) if tried is None else (tried.unionByName(both), links.unionByName(hits))
        last, open_lists = open_lists, materialise(mixed_lists(relabelled(open_lists, hits)), "postings")
        finished(last)
    # what still differs
    pairs = materialise(candidates(open_lists, lists, percent).join(tried, ["a", "b"], "left_anti"), "pairs")
    comps = materialise(components(links.select("a", "b").unionByName(verify(pairs, lists, percent))), "components")
    named = members.join(comps.select(F.col("node").alias("class_id"), "component"), "class_id", "left")
    return named.select(F.col("id").alias(key), F.col("n").cast("long").alias("n_shingles"), "class_id", F.coalesce("component", "class_id").alias("component_id"))
