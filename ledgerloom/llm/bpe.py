"""Operator 8: byte-level BPE encoding and decoding with DuckDB recursive queries in each partition.

A task cuts its texts into words by the tokenizer's pattern (vectorised over code points), and gives the
distinct words to DuckDB as token-position rows. A recursive query joins each pair of neighbours with the
merge table and contracts the leftmost pair of least rank of each word until no pair is left. Decoding is
an ordered aggregation of the tokens' bytes, by word and then by text. No rows are shuffled.

A round contracts one pair of a word, so a long word would take rounds in proportion to its length, each over all of it.
It is cut into overlapping pieces instead, which are words of the same query. Contraction never looks beyond two
neighbouring tokens: a sequence is a word's encoding just if each two neighbours are the encoding of their bytes. So
where two pieces have a token in common, the first one's tokens up to it and the second one's after it are
the encoding of both. Pieces without a common token become one and are encoded again; one of more than
``LONGEST_PIECE`` bytes (as of a letter repeated a million times) is contracted with a heap, in the same order.

Defined results: a null or empty text has no ids and decodes to no bytes; repeated rows are encoded alike; a word may be
of any length, and a task holds some thirty times the size of one text; an empty table gives an empty one;
extra columns are kept, and an output column whose name is taken gets a leading underscore.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .shared import free_name, small_batches
from .wordhash import buffers, chunks, hash_spans

#: Distinct words whose ids a Python worker remembers between batches; beyond it the memory starts anew.
REMEMBERED_WORDS = 600_000
#: Bytes of a word from which it is cut, of a piece without its overlap, of the overlap, and of a piece that is contracted
#: by rounds at most; token rows of a recursive query at most (about), over all its rounds.
LONG_WORD, PIECE, OVERLAP, LONGEST_PIECE, QUERY_ROWS = 192, 64, 32, 2048, 4_000_000

_CONTRACT = """
WITH RECURSIVE step(w, it, pos, tok, npos, ntok) AS (
  SELECT w, 0, pos, tok, npos, ntok FROM letters
  UNION ALL
  SELECT s.w, s.it + 1, s.pos,
         CASE WHEN s.pos = c.at THEN c.made ELSE s.tok END,
         CASE WHEN s.pos = c.at THEN c.npos ELSE s.npos END,
         CASE WHEN s.pos = c.at THEN c.ntok WHEN s.npos = c.at THEN c.made ELSE s.ntok END
  FROM step s JOIN (
    SELECT b.w, (b.best & 4294967295)::INT AS at, (b.best >> 32)::INT AS made, b.gone, d.npos, d.ntok
    FROM (SELECT w, min((m.made::BIGINT << 32) | pos) AS best, arg_min(npos, (m.made::BIGINT << 32) | pos) AS gone
          FROM step JOIN merges m ON m.pair = (tok::BIGINT << 32) | ntok WHERE ntok >= 0 GROUP BY w) b
    JOIN step d ON d.pos = b.gone) c ON c.w = s.w
  WHERE s.pos <> c.gone
)
SELECT w, pos, tok FROM step JOIN (SELECT w AS last_w, max(it) AS last FROM step GROUP BY w) ON w = last_w AND it = last
ORDER BY pos
"""
_WORDS = "SELECT word, list(bytes ORDER BY pos) AS parts FROM tokens JOIN vocabulary USING (id) GROUP BY word ORDER BY word"
_TEXTS = "SELECT doc, list(word_bytes ORDER BY pos) AS parts FROM placed JOIN spelt USING (word) GROUP BY doc ORDER BY doc"


def load_ranks(path: str) -> dict[bytes, int]:
    """A rank file: a base64 token and its rank on each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}


def merge_rows(ranks: dict[bytes, int]) -> list[tuple[int, int, int]]:
    """Every way to make a token of two tokens: left id, right id, id made."""
    return [(ranks[t[:i]], ranks[t[i:]], r) for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]


# Classes of code points: 0 other, 1 letter, 2 number, 3 white space, 4 the space U+0020
def _classes() -> np.ndarray:
    """From the matches of tiktoken's own pattern engine, so that both follow one version of Unicode."""
    import tiktoken

    every = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    out = np.zeros(0x110000, dtype=np.uint8)
    for kind, pattern in ((1, r"\p{L}"), (2, r"\p{N}"), (3, r"\s")):
        engine = tiktoken.Encoding(f"class-{kind}", pat_str=pattern, mergeable_ranks={bytes([b]): b for b in range(256)}, special_tokens={})
        hit = bytes(engine.encode_ordinary(every)).decode("utf-8")
        out[np.frombuffer(hit.encode("utf-32-le"), dtype=np.uint32)] = kind
    out[32] = 4
    return out


class Memo:
    """Slices of one array of values by 64-bit key: what a worker has computed for the words it has seen."""

    def __init__(self, kind: type) -> None:
        self.kind = kind
        self.forget()

    def forget(self) -> None:
        self.known = np.zeros(0, dtype=np.uint64)
        self.place = np.zeros(0, dtype=np.int64)
        self.offsets = np.zeros(1, dtype=np.int64)
        self.values = np.zeros(0, dtype=self.kind)

    def fresh(self, keys: np.ndarray) -> np.ndarray:
        """Places in ``keys`` (sorted, distinct) of those not known; starts anew if there would be too many."""
        if len(self.known) + len(keys) > REMEMBERED_WORDS:
            self.forget()
        spot = np.searchsorted(self.known, keys)
        new = np.ones(len(keys), dtype=bool)
        inside = spot < len(self.known)
        new[inside] = self.known[spot[inside]] != keys[inside]
        return np.flatnonzero(new)

    def add(self, keys: np.ndarray, values: np.ndarray, at: np.ndarray) -> None:
        spot = np.searchsorted(self.known, keys)
        self.place = np.insert(self.place, spot, len(self.offsets) - 1 + np.arange(len(keys)))
        self.known = np.insert(self.known, spot, keys)
        self.offsets = np.concatenate((self.offsets, self.offsets[-1] + at[1:]))
        self.values = np.concatenate((self.values, values))

    def rows(self, keys: np.ndarray) -> np.ndarray:
        return self.place[np.searchsorted(self.known, keys)]

    def slices(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return _gather(self.values, self.offsets[rows], self.offsets[rows + 1] - self.offsets[rows])


class Splitter:
    """The words that the pattern ``'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+`` matches.

    Runs of one class are words; a run of white space gives its last character to what follows; a space
    joins the run after it; an apostrophe that begins a word may take a contraction's letters along.
    """

    def __init__(self) -> None:
        self.classes = _classes()

    def split(self, raw: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Byte offsets at which words begin (every text's begin is one, unless the text is empty)."""
        if not len(raw):
            return np.zeros(0, dtype=np.int64)
        byte_of = np.flatnonzero((raw & 0xC0) != 0x80)
        points = np.frombuffer(raw.tobytes().decode("utf-8").encode("utf-32-le"), dtype=np.uint32)
        kinds = self.classes[points]
        n = len(points)
        first = np.zeros(n + 1, dtype=bool)
        first[np.searchsorted(byte_of, at)] = True
        white = kinds >= 3
        group = np.where(white, 3, kinds)
        run = first[:-1].copy()
        run[1:] |= group[1:] != group[:-1]
        begin = run.copy()
        # the last white space before other characters of the same text stands apart or joins them
        before = np.zeros(n, dtype=bool)
        before[1:] = run[1:] & white[:-1] & ~white[1:] & ~first[1:-1]
        i = np.flatnonzero(before)
        begin[i - 1] = True
        begin[i[kinds[i - 1] == 4]] = False
        self._contractions(points, group, run, begin, first)
        return byte_of[np.flatnonzero(begin)]

    @staticmethod
    def _contractions(points: np.ndarray, group: np.ndarray, run: np.ndarray, begin: np.ndarray, first: np.ndarray) -> None:
        n = len(points)
        q = np.flatnonzero((points[:-1] == 39) & begin[:-1] & run[1:] & (group[1:] == 1) & ~first[1:-1]) if n > 1 else np.zeros(0, dtype=np.int64)
        if not len(q):
            return
        ends_text = np.flatnonzero(first)
        stop = ends_text[np.searchsorted(ends_text, q, "right")]
        one = points[q + 1]
        two = np.where(q + 2 < stop, points[np.minimum(q + 2, n - 1)], 0)
        single = np.isin(one, [ord(c) for c in "stmd"])
        double = ((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))
        for hit, more in ((q[single], 2), (q[double & ~single], 3)):
            begin[hit + 1] = False
            after = hit + more
            begin[after[after < n]] = True


class Codec:
    """Encodes and decodes in one Python worker: a DuckDB connection, a splitter and the words seen so far."""

    def __init__(self, path: str) -> None:
        import duckdb

        self.ranks = load_ranks(path)
        self.splitter = Splitter()
        self.db = duckdb.connect()
        # nothing is spilled to a worker's own disk: queries are cut so that they fit
        self.db.execute("SET threads = 1; SET memory_limit = '600MB'; SET temp_directory = ''; SET preserve_insertion_order = false")
        rows = np.array(merge_rows(self.ranks), dtype=np.int64).reshape(-1, 3)
        merges = pa.table({"pair": (rows[:, 0] << 32) | rows[:, 1], "made": rows[:, 2].astype(np.int32)})  # noqa: F841
        vocabulary = pa.table({"id": pa.array(list(self.ranks.values()), pa.int32()), "bytes": pa.array(list(self.ranks), pa.binary())})  # noqa: F841
        self.db.register("given", merges)
        self.db.execute("CREATE TABLE merges AS SELECT * FROM given")
        self.db.unregister("given")
        self.db.register("given", vocabulary)
        self.db.execute("CREATE TABLE vocabulary AS SELECT * FROM given")
        self.db.unregister("given")
        self.of_byte = np.array([self.ranks.get(bytes([b]), -1) for b in range(256)], dtype=np.int32)
        self.ids_of, self.bytes_of = Memo(np.int32), Memo(np.uint8)
        self.lengths = np.zeros(max(self.ranks.values()) + 1, dtype=np.int64)
        self.lengths[list(self.ranks.values())] = [len(t) for t in self.ranks]
        self.made_of: dict[tuple[int, int], int] | None = None

    def _query(self, sql: str, **tables: pa.Table) -> pa.Table:
        for name, table in tables.items():
            self.db.register(name, table)
        out = self.db.sql(sql).to_arrow_table()
        for name in tables:
            self.db.unregister(name)
        return out

    def encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words one after another, and where each word's begin."""
        whole = np.array([self.ranks.get(w, -1) for w in words], dtype=np.int64)
        lens = np.array([len(w) for w in words], dtype=np.int64)
        counts, parts = np.ones(len(words), dtype=np.int64), []
        short, long = np.flatnonzero((whole < 0) & (lens <= LONG_WORD)), np.flatnonzero((whole < 0) & (lens > LONG_WORD))
        flat, counts[short] = self._contract([words[i] for i in short])
        parts = [self._long(words[i]) for i in long]
        counts[long] = [len(x) for x in parts]
        at = np.concatenate(([0], np.cumsum(counts)))
        ids = np.empty(at[-1], dtype=np.int32)
        single = np.flatnonzero(whole >= 0)
        ids[at[single]] = whole[single]
        of_short = np.zeros(len(words), dtype=bool)
        of_short[short] = True
        ids[np.repeat(of_short, counts)] = flat
        for i, part in zip(long.tolist(), parts, strict=True):
            ids[at[i] : at[i + 1]] = part
        return ids, at

    def _contract(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words one after another and their numbers, by recursive queries over bounded numbers of rows."""
        done: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, dtype=np.int32), np.zeros(0, dtype=np.int64))]
        first, rows = 0, 0
        for i, word in enumerate(words):
            rows += len(word) * (len(word) + 8) // 4
            if rows >= QUERY_ROWS or i == len(words) - 1:
                done.append(self._rounds(words[first : i + 1]))
                first, rows = i + 1, 0
        return np.concatenate([d[0] for d in done]), np.concatenate([d[1] for d in done])

    def _rounds(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        raw = np.frombuffer(b"".join(words), dtype=np.uint8)
        w, pos, tok = np.repeat(np.arange(len(words)), [len(x) for x in words]), np.arange(len(raw)), self.of_byte[raw]
        if (tok < 0).any():
            raise ValueError("the rank file lacks some single bytes")
        inside = np.concatenate((w[1:] == w[:-1], [False]))
        npos, ntok = np.where(inside, pos + 1, -1), np.where(inside, np.concatenate((tok[1:], [0])), -1)
        letters = pa.table({k: v.astype(np.int32) for k, v in (("w", w), ("pos", pos), ("tok", tok), ("npos", npos), ("ntok", ntok))})
        got = self._query(_CONTRACT, letters=letters)
        return got["tok"].to_numpy(), np.bincount(got["w"].to_numpy(), minlength=len(words))

    def _long(self, word: bytes) -> np.ndarray:
        """The ids of a long word, by overlapping pieces."""
        ranges = [(a, min(a + PIECE + OVERLAP, len(word))) for a in range(0, max(len(word) - OVERLAP, 1), PIECE)]
        done: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
        while True:
            todo = [r for r in ranges if r not in done]
            rounds = [r for r in todo if r[1] - r[0] <= LONGEST_PIECE]
            flat, counts = self._contract([word[a:b] for a, b in rounds])
            for (a, b), ids in (*zip(rounds, np.split(flat, np.cumsum(counts)[:-1]), strict=False), *((r, self._heap(word[r[0] : r[1]])) for r in todo if r[1] - r[0] > LONGEST_PIECE)):
                done[a, b] = ids, a + np.concatenate(([0], np.cumsum(self.lengths[ids])))
            merged, taken, fits = [ranges[0]], [0], True
            for r in ranges[1:]:
                # the first token that both have: where it ends, the second goes on
                (_, x), (_, y) = done.get(merged[-1], (None, None)), done[r]
                cut = None
                if x is not None:
                    both = np.intersect1d(x[:-1] * (1 << 20) + np.diff(x), y[:-1] * (1 << 20) + np.diff(y), assume_unique=True)
                    cut = (both[0] >> 20) + (both[0] & ((1 << 20) - 1)) if len(both) else None
                if cut is None:
                    merged[-1], fits = (merged[-1][0], r[1]), False
                else:
                    merged.append(r)
                    taken.append(int(cut))
            if fits:
                parts = []
                for r, a, b in zip(ranges, taken, [*taken[1:], len(word)], strict=True):
                    ids, at = done[r]
                    parts.append(ids[np.searchsorted(at, a) : np.searchsorted(at, b)])
                return np.concatenate(parts)
            ranges = merged

    def _heap(self, word: bytes) -> np.ndarray:
        """The same contraction of one word, leftmost pair of least rank first, with a heap."""
        if self.made_of is None:
            self.made_of = {(a, b): r for a, b, r in merge_rows(self.ranks)}
        made_of, tok, n = self.made_of, self.of_byte[np.frombuffer(word, dtype=np.uint8)].tolist(), len(word)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        queue = [(r, i) for i in range(n - 1) if (r := made_of.get((tok[i], tok[i + 1]))) is not None]
        heapq.heapify(queue)
        while queue:
            rank, i = heapq.heappop(queue)
            j = after[i] if tok[i] >= 0 else n
            if j >= n or made_of.get((tok[i], tok[j])) != rank:
                continue  # one of the two is no more what it was
            tok[i], tok[j], after[i] = rank, -1, after[j]
            if after[i] < n:
                before[after[i]] = i
                if (r := made_of.get((rank, tok[after[i]]))) is not None:
                    heapq.heappush(queue, (r, i))
            if before[i] >= 0 and (r := made_of.get((tok[before[i]], rank))) is not None:
                heapq.heappush(queue, (r, before[i]))
        return np.array([t for t in tok if t >= 0], dtype=np.int32)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all texts, the range of ids of each text, and where words begin in the ids."""
        raw, at = buffers(texts)
        starts = self.splitter.split(raw, at)
        ends = np.concatenate((starts[1:], [len(raw)])) if len(starts) else starts
        keys, where, back = np.unique(hash_spans(raw, starts, ends), return_index=True, return_inverse=True)
        new = self.ids_of.fresh(keys)
        if len(new):
            blob = raw.tobytes()
            self.ids_of.add(keys[new], *self.encode_words([blob[starts[i] : ends[i]] for i in where[new]]))
        ids, word_at = self.ids_of.slices(self.ids_of.rows(keys)[back])
        return ids, word_at[np.searchsorted(starts, at)], word_at

    def decode(self, ids: np.ndarray, id_at: np.ndarray, word_at: np.ndarray) -> list[bytes]:
        """The bytes of each text: an ordered aggregation by word, of each distinct word once, and one by text.

        ``word_at`` cuts the ids anywhere, at the begins of texts too; words are told apart by their ids alone.
        """
        out, cuts = [b""] * (len(id_at) - 1), np.unique(np.concatenate((word_at, id_at)))
        if not len(ids):
            return out
        keys, where, word = np.unique(hash_spans(ids.astype("<u4").view(np.uint8), cuts[:-1] * 4, cuts[1:] * 4), return_index=True, return_inverse=True)
        new = self.bytes_of.fresh(keys)
        if len(new):
            sample, sample_at = _gather(ids, cuts[where[new]], cuts[where[new] + 1] - cuts[where[new]])
            tokens = pa.table({"word": np.repeat(np.arange(len(new), dtype=np.int32), np.diff(sample_at)), "pos": np.arange(len(sample), dtype=np.int32), "id": sample})
            if len(self._query("SELECT id FROM tokens ANTI JOIN vocabulary USING (id) LIMIT 1", tokens=tokens)):
                raise ValueError("an id is not in the vocabulary")
            self.bytes_of.add(keys[new], *buffers(_joined(self._query(_WORDS, tokens=tokens)["parts"].combine_chunks())))
        spelt = pa.table({"word": np.arange(len(keys), dtype=np.int32), "word_bytes": _binary(*self.bytes_of.slices(self.bytes_of.rows(keys)))})
        doc = np.searchsorted(id_at, cuts[:-1], "right") - 1
        placed = pa.table({"doc": doc.astype(np.int32), "pos": np.arange(len(word), dtype=np.int32), "word": word.astype(np.int32)})
        got = self._query(_TEXTS, placed=placed, spelt=spelt)
        for d, text in zip(got["doc"].to_pylist(), _joined(got["parts"].combine_chunks()).to_pylist(), strict=True):
            out[d] = text
        return out


def _gather(values: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Slices of ``values`` one after another, and where each begins."""
    at = np.concatenate(([0], np.cumsum(lens)))
    return values[np.repeat(starts - at[:-1], lens) + np.arange(at[-1])], at


def _binary(raw: np.ndarray, at: np.ndarray) -> pa.Array:
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(at.astype(np.int64).tobytes()), pa.py_buffer(raw.tobytes())])


def _joined(parts: pa.ListArray) -> pa.Array:
    """The lists' byte strings joined: their bytes already follow one another in memory."""
    raw, at = buffers(parts.flatten())
    return _binary(raw, at[parts.offsets.to_numpy() - parts.offsets[0].as_py()])


_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """This worker's codec for the rank file at ``path``."""
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def encode_column(df: DataFrame, path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """``df`` with a column of token ids (array of int) of the whole text."""
    small_batches(df.sparkSession)
    name = free_name(df.columns, ids)
    spot = df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in chunks(batch.column(spot)):
                part = batch.slice(a, b - a)
                flat, at, _ = codec(path).encode(part.column(spot))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(flat))], names=[*part.schema.names, name])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(name, T.ArrayType(T.IntegerType()))]))


def decode_column(df: DataFrame, path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``df`` with the bytes (binary) that the ids stand for; null ids decode to no bytes, unknown ids are an error."""
    small_batches(df.sparkSession)
    name = free_name(df.columns, out)
    spot = df.columns.index(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = [np.asarray(x or [], dtype=np.int32) for x in batch.column(spot).to_pylist()]
            flat = np.concatenate(lists) if lists else np.zeros(0, dtype=np.int32)
            at = np.concatenate(([0], np.cumsum([len(x) for x in lists]))).astype(np.int64)
            made = pa.array(codec(path).decode(flat, at, np.arange(len(flat) + 1)), pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, made], names=[*batch.schema.names, name])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(name, T.BinaryType())]))


def digest(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", keep: tuple[str, ...] = (), with_ids: bool = False) -> DataFrame:
    """Per row: key, columns of ``keep``, n_tokens, ids_sha256, decoded_sha256 and n_bytes of what the ids decode to; the ids if asked for."""
    small_batches(docs.sparkSession)
    front = [key, *keep]
    spot = len(front)
    added = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType()), T.StructField("n_bytes", T.LongType())]
    if with_ids:
        added.append(T.StructField("ids", T.ArrayType(T.IntegerType())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in chunks(batch.column(spot)):
                use, part = codec(path), batch.slice(a, b - a)
                flat, at, word_at = use.encode(part.column(spot))
                decoded, little = use.decode(flat, at, word_at), flat.astype("<u4")
                cells = [
                    *part.columns[:spot],
                    pa.array(np.diff(at)),
                    pa.array([hashlib.sha256(little[i:j]).hexdigest() for i, j in zip(at[:-1], at[1:], strict=True)], pa.string()),
                    pa.array([hashlib.sha256(x).hexdigest() for x in decoded], pa.string()),
                    pa.array([len(x) for x in decoded], pa.int64()),
                ]
                if with_ids:
                    cells.append(pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(flat)))
                yield pa.RecordBatch.from_arrays(cells, names=[*front, *(f.name for f in added)])

    added = [T.StructField(free_name(front, f.name), f.dataType) for f in added]
    rows = docs.select(*front, text)
    return rows.mapInArrow(run, T.StructType([*rows.schema.fields[:spot], *added]))
