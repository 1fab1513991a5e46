"""Substring dedup, Jaccard join, BPE and language ID against brute force on small fixtures."""

import hashlib
import os
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerloom.llm import bpe, components, jaccard_join, langid, substring_dedup, wordhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
tokenizers = pytest.importorskip("public_tokenizers")
PATH = tokenizers.path("byte_bpe_multi_50k.tiktoken")


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="aB \t\n é\x1c", max_size=20), max_size=6))
def test_words_are_the_words(texts):
    raw, at = wordhash.buffers(pa.array([*texts, None], pa.string()))
    starts, ends, of = wordhash.spans(raw, at)
    blob = raw.tobytes()
    got = [[blob[starts[i] : ends[i]].decode() for i in range(of[d], of[d + 1])] for d in range(len(texts) + 1)]
    assert got == [WORD.findall(t) for t in texts] + [[]]
    words = [w for d in got for w in d]
    h = wordhash.hash_spans(raw, starts, ends)
    assert all((h[i] == h[j]) == (words[i] == words[j]) for i in range(len(words)) for j in range(i))


def _brute_substrings(rows, k):
    words = {i: WORD.findall(t or "") for i, t in rows}
    own = {}
    for i in sorted(words):
        for p in range(len(words[i]) - k + 1):
            own.setdefault(tuple(words[i][p : p + k]), i)
    out = {}
    for i, w in words.items():
        gone = {q for p in range(len(w) - k + 1) if own[tuple(w[p : p + k])] < i for q in range(p, p + k)}
        out[i] = (len(w), len(gone), hashlib.sha256(" ".join(x for p, x in enumerate(w) if p not in gone).encode()).hexdigest())
    return out


@pytest.mark.parametrize("hot_words", [substring_dedup.HOT_WORDS, 100])
def test_substring_dedup(spark, hot_words):
    rng = random.Random(11)
    passage = [f"p{i}" for i in range(90)]
    rows = []
    for i in range(60):
        w = [f"w{rng.randrange(400)}" for _ in range(rng.randrange(0, 200))]
        if i % 3 == 0:
            cut = rng.randrange(0, 30)
            w[len(w) // 2 : len(w) // 2] = passage[cut : cut + 60]
        rows.append((i, " ".join(w)))
    rows += [(100, rows[5][1]), (101, rows[5][1].replace(" ", "\n ")), (102, None), (103, ""), (104, "x y " * 200), (105, "x y " * 150), (106, "same " * 120)]
    want = _brute_substrings(rows, 50)
    df = spark.createDataFrame([*rows, (None, " ".join(passage))], "doc_id bigint, text string")
    got = substring_dedup.dedup(df, longest=40, hot_words=hot_words).collect()
    assert len(got) == len(rows) + 1
    for r in got:
        if r["doc_id"] is None:
            assert r["n_removed"] == 0
        else:
            assert (r["n_words"], r["n_removed"], r["kept_sha256"]) == want[r["doc_id"]], r
    assert substring_dedup.dedup(df.limit(0)).count() == 0


def _shingles(text):
    w = WORD.findall((text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


@pytest.mark.parametrize("rounds", [jaccard_join.ROUNDS, 1])
def test_jaccard_join_loses_no_link(spark, rounds):
    rng = random.Random(13)
    base = [[f"w{rng.randrange(3000)}" for _ in range(rng.randrange(30, 80))] for _ in range(8)]
    rows = []
    for i in range(120):
        w = list(base[i % 8])
        for _ in range(rng.randrange(0, 4)):
            w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    rows += [(200, None), (201, ""), (202, "a b"), (203, "A B"), (204, "a b c d e"), (205, rows[0][1].upper()), (206, "x " * 50), (207, "x " * 80)]
    sets = {i: _shingles(t) for i, t in rows}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in sets:
        for j in sets:
            if j < i and sets[i] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    df = spark.createDataFrame([*rows, rows[3], (None, rows[3][1])], "doc_id bigint, text string")
    got = jaccard_join.link(df, rounds=rounds, bucket_rows=500).collect()
    assert len(got) == len(rows) + 2
    for r in got:
        if r["doc_id"] is None:
            assert r["component_id"] is None
        else:
            assert (r["n_shingles"], r["component_id"]) == (len(sets[r["doc_id"]]), find(r["doc_id"])), r
    assert jaccard_join.link(df.limit(0)).count() == 0


@pytest.mark.parametrize("bucket_rows", [10, 10**6])
def test_jaccard_join_gives_all_links(spark, bucket_rows):
    rng = random.Random(19)
    base = [[f"w{rng.randrange(3000)}" for _ in range(rng.randrange(90, 120))] for _ in range(3)]
    rows = []
    for i in range(90):
        w = list(base[i % 3])
        for _ in range(rng.randrange(0, 2)):
            w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    rows += [(100, None), (101, "a b"), (102, "A B"), (103, rows[0][1].upper())]
    least = {}
    for i, t in rows:
        least.setdefault(frozenset(_shingles(t)), i)
    want = {(j, i) for x, i in least.items() for y, j in least.items() if i < j and x and 100 * len(x & y) >= 75 * len(x | y)}
    df = spark.createDataFrame([*rows, rows[3], (None, rows[3][1])], "doc_id bigint, text string")
    got = [(r["a"], r["b"]) for r in jaccard_join.all_links(df, bucket_rows=bucket_rows).collect()]
    assert len(want) > 200 and len(got) == len(set(got)) and set(got) == want
    assert jaccard_join.all_links(df.limit(0)).count() == 0


@settings(max_examples=100, deadline=None)
@given(st.sets(st.integers(0, 60), min_size=1), st.sets(st.integers(0, 60), min_size=1))
def test_exact_verification_and_suffix_bound(x, y):
    a, b = (np.array(sorted(s), dtype=np.uint64) for s in (x, y))
    assert jaccard_join.suffix_bound(a, b) >= len(x & y)
    assert jaccard_join.similar(a, b, len(a), len(b)) == (100 * len(x & y) >= 75 * len(x | y))


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 130)] + [(7, 7), (None, 3)]
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 130)}}


@pytest.fixture(scope="module")
def reference():
    import tiktoken

    return tiktoken.Encoding("own", pat_str=tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(PATH), special_tokens={})


@settings(max_examples=40, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from("ab'std \n\t\r  lrve1²٣!?é中\x1c\x85​ \U0001f600"), st.characters(codec="utf-8")), max_size=40), min_size=1, max_size=20))
def test_bpe_equals_the_library(reference, texts):
    codec = bpe.codec(PATH)
    ids, at, words = codec.encode(pa.array(texts))
    assert [ids[at[i] : at[i + 1]].tolist() for i in range(len(texts))] == [reference.encode_ordinary(t) for t in texts]
    assert codec.decode(ids, at, words) == [t.encode() for t in texts]
    assert codec.decode(ids, at, np.arange(len(ids) + 1)) == [t.encode() for t in texts]


def test_bpe_columns(spark, reference):
    rows = [(1, "Hello world, it's"), (2, None), (3, ""), (1, "Hello world, it's"), (4, "x" * 300 + " é" * 50)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("doc_id", "text", "'taken' as ids")
    coded = bpe.encode_column(df, PATH)
    got = bpe.decode_column(coded, PATH, ids="_ids").collect()
    assert sorted((r["doc_id"], r["text"], r["ids"], r["_ids"], bytes(r["decoded"])) for r in got if r["text"]) == sorted((i, t, "taken", reference.encode_ordinary(t), t.encode()) for i, t in rows if t)
    assert all(r["_ids"] == [] and bytes(r["decoded"]) == b"" for r in got if not r["text"])
    assert bpe.digest(df.limit(0), PATH).count() == 0


def _letters(rng, n):
    return "".join(rng.choices("etaoinshrdlucmfwypvbgkjqxz", k=n))


def test_long_words_equal_the_library(reference):
    rng = random.Random(23)
    long = [_letters(rng, 20_000), "".join(chr(rng.randrange(0x4E00, 0x9FA5)) for _ in range(10_000)), "b" + "a" * 9_000, "ab" * 3_000, "=-" * 2_000 + "=" * 999, "".join(rng.choices(["the", "ing", "und", "ab"], k=5_000)), " " * 3_000 + "x"]
    texts = [*long, *(_letters(rng, n) for n in range(185, 200)), "x" * 193, long[0][:5_000] + " " + long[1]]
    codec = bpe.Codec(PATH)
    ids, at, words = codec.encode(pa.array(texts))
    assert [ids[at[i] : at[i + 1]].tolist() for i in range(len(texts))] == [reference.encode_ordinary(t) for t in texts]
    assert codec.decode(ids, at, words) == [t.encode() for t in texts]


@settings(max_examples=30, deadline=None)
@given(st.text(alphabet="aabhetin", min_size=100, max_size=400))
def test_pieces_and_the_heap_contract_alike(reference, word):
    codec, data = bpe.codec(PATH), word.encode()
    want = reference.encode_ordinary(word)
    assert codec._long(data).tolist() == want == codec._heap(data).tolist() == codec._rounds([data])[0].tolist()


def test_a_word_of_a_million_letters(reference):
    text = _letters(random.Random(29), 1_000_000)
    ids, at, words = bpe.codec(PATH).encode(pa.array([text]))
    assert ids.tolist() == reference.encode_ordinary(text)


def test_bpe_digest(spark, reference):
    rows = [(1, "Hello world, it's", "k"), (2, None, None), (3, "", "k"), (1, "Hello world, it's", "k"), (None, "x" * 300 + " é" * 50 + "中" * 700, "k")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, n_tokens string")
    got = bpe.digest(df, PATH, keep=("n_tokens",), with_ids=True)
    assert got.columns == ["doc_id", "n_tokens", "_n_tokens", "ids_sha256", "decoded_sha256", "n_bytes", "ids"]
    want = []
    for i, t, k in rows:
        ids, raw = reference.encode_ordinary(t or ""), (t or "").encode()
        want.append((i, k, len(ids), hashlib.sha256(b"".join(x.to_bytes(4, "little") for x in ids)).hexdigest(), hashlib.sha256(raw).hexdigest(), len(raw), ids))
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="the driver's tables are not here")
def test_language_id_on_held_out_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    from pyspark.sql import functions as F

    model = langid.train(docs.filter(~langid.held_out(F.col("doc_id"))))
    assert model[0] == ["de", "en", "es", "fr"]
    found = langid.predict(docs, model, keep=("lang", "text")).filter(langid.held_out(F.col("doc_id"))).collect()
    assert sum(r["lang_pred"] == r["lang"] for r in found) >= 0.95 * len(found)
    assert all(langid.crc_held_out(r["doc_id"]) and 0 <= r["score"] <= 1 for r in found)
    parts = {r["lang"]: r["text"] for r in found if len(r["text"]) > 500}
    names = sorted(parts)[:2]
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "123 !?"), (4, "\n".join(parts[n][:2000] for n in names)), (None, parts[names[0]])], "doc_id bigint, text string")
    got = {r["doc_id"]: r for r in langid.predict(odd, model).collect()}
    assert all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0 for i in (1, 2, 3))
    assert sorted(got[4]["lang_set"]) == names and got[None]["lang_pred"] == names[0]
    empty = langid.train(docs.limit(0))
    assert {r["lang_pred"] for r in langid.predict(odd, empty).collect()} == {"und"}


def _brute_em(text, log_p, steps):
    """Proportions of one text by plain EM over its trigrams, for every set of the most likely languages."""
    import math

    buckets, _ = langid._trigrams(pa.array([text]))
    n, langs = len(buckets), range(len(log_p))
    p = [[math.exp(log_p[k][b]) for k in langs] for b in buckets.tolist()]

    def fit(allowed):
        w = {k: 1 / len(allowed) for k in allowed}
        for _ in range(steps):
            new = dict.fromkeys(allowed, 0.0)
            for row in p:
                whole = sum(row[k] * w[k] for k in allowed)
                for k in allowed:
                    new[k] += row[k] * w[k] / whole / n
            w = new
        return w, sum(math.log(sum(row[k] * w[k] for k in allowed)) for row in p)

    mixed, _ = fit(list(langs))
    order = sorted(langs, key=lambda k: -mixed[k])
    alone = {k: sum(math.log(row[k]) for row in p) for k in langs}
    first = max(alone, key=alone.get)
    best, found = alone[first] - langid.PENALTY * math.log(n + 1), {first: 1.0}
    for k in range(2, len(order) + 1):
        if mixed[order[k - 1]] <= 0.02:
            break
        w, fitness = fit(order[:k])
        if fitness - k * langid.PENALTY * math.log(n + 1) > best:
            best, found = fitness - k * langid.PENALTY * math.log(n + 1), w
    return [found.get(k, 0.0) for k in langs]


def test_language_inference_equals_brute_force(spark):
    rng = random.Random(31)
    letters = {"aa": "abcde", "bb": "defgh", "cc": "hijkl"}

    def words(lang, n):
        return " ".join("".join(rng.choices(letters[lang], k=rng.randrange(2, 6))) for _ in range(n))

    learned = [(words(lang, 60), lang) for lang in letters for _ in range(5)]
    names, log_p = langid.train(spark.createDataFrame(learned, "text string, lang string"))
    texts = [words("aa", 40), words("aa", 30) + " " + words("cc", 30), words("bb", 12), " ".join(words(k, 25) for k in letters), "abc", words("cc", 400)]
    got = langid.infer(pa.array(texts), log_p)
    want = np.array([_brute_em(t, log_p, langid.STEPS) for t in texts])
    assert names == sorted(letters) and np.allclose(got, want, atol=2e-3)
    assert (got[1] > 0.2).tolist() == [True, False, True]


def test_language_of_odd_rows(spark):
    names, log_p = ["aa", "bb"], np.log(np.full((2, langid.BUCKETS), 1 / langid.BUCKETS)).astype(np.float32)
    rows = [(None, "ab", "x"), (1, "é" * 500_000, "x"), (1, "é" * 500_000, "x"), (2, "12", None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang_pred string")
    found = langid.predict(df, (names, log_p), keep=("lang_pred",))
    assert found.columns == ["doc_id", "lang_pred", "_lang_pred", "score", "lang_set"]
    got = {r["doc_id"]: (r["_lang_pred"], r["score"]) for r in found.collect()}
    assert got[None] == ("aa", 0.5) and got[1][0] == "aa" and got[2] == ("und", 0.0) and found.count() == 4
    assert df.filter(langid.held_out(df["doc_id"])).count() + df.filter(~langid.held_out(df["doc_id"])).count() == 4


def test_long_texts_join_and_lose_substrings(spark):
    rng = random.Random(37)
    words = [f"w{rng.randrange(10**6)}" for _ in range(30_000)]
    rows = [(1, " ".join(words)), (2, " ".join(words[5:])), (3, "x" * 400_000), (4, "X" * 400_000)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "1 as id", "2 as n", "3 as component")
    got = {r["doc_id"]: r for r in jaccard_join.link(df).collect()}
    assert {i: r["component_id"] for i, r in got.items()} == {1: 1, 2: 1, 3: 3, 4: 3} and got[1]["n_shingles"] == len(_shingles(rows[0][1]))
    want = _brute_substrings(rows, 50)
    assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substring_dedup.dedup(df).collect()} == want
