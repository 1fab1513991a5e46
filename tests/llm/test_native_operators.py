"""Line dedup, mixing, quality rules and chat formatting against brute force on small fixtures."""

import hashlib
import math
import random
import re
from collections import Counter

from pyspark.sql import functions as F

from ledgerloom.llm import chat, line_dedup, mixing, quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id bigint, text string, source string"


def test_line_dedup_removes_lines_of_many_sites_and_nothing_else(spark):
    rows = [(i, f"own {i}\n  Cookie notice \n\nshared {i % 3}", f"s{i % 12}") for i in range(24)] + [(100, None, "s1"), (101, "", None), (102, "Cookie notice", None), (0, rows0 := "own 0\n  Cookie notice \n\nshared 0", "s0")]
    df = spark.createDataFrame(rows, DOCS).withColumn("n_lines", F.lit("taken")).withColumn("doc_key", F.lit(1))
    got = line_dedup.remove_boilerplate(df)
    assert got.columns[:5] == df.columns and got.count() == len(rows)
    by = {r["doc_id"]: r for r in got.collect()}
    assert by[3]["text"] == "own 3\n\nshared 0" and by[3]["n_removed"] == 1 and by[3]["_n_lines"] == 3 and by[3]["n_lines"] == "taken"
    assert by[100]["text"] is None and by[100]["n_removed"] == 0 and by[102]["text"] == "" and by[101]["text"] == ""
    assert got.filter("doc_id = 0").count() == 2 and rows0 is not None
    assert line_dedup.remove_boilerplate(df.limit(0)).count() == 0


def test_line_dedup_of_clashing_columns_null_keys_and_long_texts(spark):
    long = "\n".join(f"line {i}" for i in range(20_000)) + "\nbanner\n" + "x" * 300_000
    rows = [(i, f"banner\nown {i}", f"s{i}") for i in range(12)] + [(None, "banner\nown x", "s1"), (None, "banner\nown x", "s1"), (50, long, None)]
    df = spark.createDataFrame(rows, DOCS).withColumns({c: F.lit(1) for c in ("doc_key", "doc_key_gone", "DOC_KEY_2")})
    got = line_dedup.remove_boilerplate(df)
    assert got.columns == [*df.columns, "n_lines", "n_removed"]
    by = got.collect()
    assert len(by) == len(rows) and all(r["n_removed"] == 1 and "banner" not in r["text"].split("\n") for r in by)
    assert next(r for r in by if r["doc_id"] == 50)["text"] == long.replace("\nbanner", "")


def test_near_limit_lines_are_counted_exactly(spark):
    rows = [(i * 100 + k, f"line{k}", f"s{i}") for k in range(8, 13) for i in range(k)]
    got = line_dedup.remove_boilerplate(spark.createDataFrame(rows, DOCS))
    removed = {r["doc_id"] % 100 for r in got.filter("n_removed > 0").collect()}
    assert removed == {10, 11, 12}


def test_mix_stays_within_a_block_of_its_weights(spark):
    rng = random.Random(3)
    rows = [(i, rng.choices(["a", "b", "c", None], [60, 25, 14, 1])[0]) for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id bigint, source string").withColumn("slot", F.lit("taken"))
    got = mixing.mix(df, block_rows=4).collect()
    assert len(got) == len(rows) and {r["slot"] for r in got} == {"taken"}
    sizes = Counter(s or "" for _, s in rows)
    total = sum(math.sqrt(n) for n in sizes.values())
    share = {s: max(1, math.floor(1024 * math.sqrt(n) / total + 0.5)) for s, n in sizes.items()}
    at = {}
    for r in got:
        assert at.setdefault(r["_slot"], r["source"] or "") == (r["source"] or "")
    full = Counter(r["_slot"] for r in got)
    assert max(full.values()) == 4 and sum(n < 4 for n in full.values()) <= 4
    done, period = Counter(), sum(share.values())
    for t in range(max(r["_slot"] for r in got if r["in_mix"]) + 1):
        done[at[t]] += 1
        assert all(abs(done[s] - (t + 1) * share[s] / period) < 1 for s in share)


def _within_a_block_of_targets(got, sizes, slot="slot"):
    """Counts after every slot of the mix against the unrounded weights, in whole numbers."""
    ratio = {s: math.sqrt(n).as_integer_ratio() for s, n in sizes.items()}
    scale = max(q for _, q in ratio.values())
    w = {s: p * (scale // q) for s, (p, q) in ratio.items()}
    total = sum(w.values())
    at = {}
    for r in got:
        assert at.setdefault(r[slot], r["source"]) == r["source"]
    done, end = Counter(), max(r[slot] for r in got if r["in_mix"])
    for t in range(end + 1):
        done[at[t]] += 1
        assert all(abs(done[s] * total - (t + 1) * w[s]) < total for s in w), t
    assert sorted(at) == list(range(len(at)))
    return end


def test_mix_stays_within_a_block_of_the_unrounded_weights_with_a_hot_source(spark):
    sizes = {"hot": 10000} | {f"s{i:02}": 1000 for i in range(19)}
    rows = [(i, s) for i, s in enumerate(s for s, n in sizes.items() for _ in range(n))]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id bigint, source string"), block_rows=1).collect()
    assert sorted(r["doc_id"] for r in got) == list(range(len(rows)))
    assert _within_a_block_of_targets(got, sizes) > 15000


def test_mix_of_thousands_of_sources(spark):
    sizes = {"hot": 3000} | {f"s{i:04}": 1 + i % 3 for i in range(4500)}
    rows = [(i, s) for i, s in enumerate(s for s, n in sizes.items() for _ in range(n))]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id bigint, source string"), block_rows=1).collect()
    assert sorted(r["doc_id"] for r in got) == list(range(len(rows)))
    assert _within_a_block_of_targets(got, sizes) > 1000


def test_mix_with_given_weights_and_no_rows(spark):
    df = spark.createDataFrame([(i, "ab"[i % 2]) for i in range(100)] + [(200, "z")], "doc_id bigint, source string")
    got = mixing.mix(df, weights={"a": 3, "b": 1}, block_rows=2)
    assert got.count() == 101 and got.filter("source = 'z' and slot is null and not in_mix").count() == 1
    first = [r["source"] for r in got.filter("slot < 8").select("slot", "source").distinct().orderBy("slot").collect()]
    assert Counter(first) == {"a": 6, "b": 2}
    assert mixing.mix(df.limit(0)).count() == 0


def test_mix_keeps_a_tiny_weight_over_ten_of_its_periods(spark):
    weights = {"a": 0.6, "b": 0.3, "c": 0.0999, "d": 0.0001}
    sizes = {"a": 66_000, "b": 33_000, "c": 11_000, "d": 11}
    docs = spark.range(sum(sizes.values())).selectExpr("id as doc_id", "case when id < 66000 then 'a' when id < 99000 then 'b' when id < 110000 then 'c' else 'd' end as source")
    got = sorted((r["slot"], r["source"]) for r in mixing.mix(docs, weights=weights, block_rows=1).collect())
    assert [s for s, _ in got] == list(range(len(got)))
    ratio = {s: x.as_integer_ratio() for s, x in weights.items()}
    scale = max(q for _, q in ratio.values())
    w = {s: p * (scale // q) for s, (p, q) in ratio.items()}
    total, done = sum(w.values()), Counter()
    for t, s in got[:100_001]:
        done[s] += 1
        assert all(abs(done[x] * total - (t + 1) * w[x]) < total for x in w), t
    assert done["d"] >= 10


def test_mix_keeps_clashing_columns_and_equal_ids_apart(spark):
    rows = [(i % 20, f"text {i}", "ab"[i % 2], i) for i in range(120)] + [(None, None, None, 7)] * 2
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string, mix_ranges int").withColumns({c: F.lit(1) for c in ("mix_src_share", "mix_range_rank", "MIX_hash", "n", "block", "src", "slot")})
    first, second = (sorted(map(repr, map(tuple, mixing.mix(df.repartition(n), block_rows=4).collect()))) for n in (1, 5))
    got = mixing.mix(df, block_rows=4)
    assert got.columns == [*df.columns, "_slot", "place", "in_mix"]
    assert first == second and len(first) == len(rows)


def _counts(text):
    words = WORD.findall(text or "")
    grams = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    covered = {i + k for i in range(len(words) - 7) if grams[tuple(words[i : i + 8])] > 1 for k in range(8)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


def test_quality_counts_and_host_verdicts(spark):
    rng = random.Random(5)
    good = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(40)) for _ in range(60)]
    texts = [*good, "a b c d e f g h i j " * 4, "x " * 9 + "#$%", None, "", " \t\n", "a\na\n b c\na", good[0] + "\n" + good[0], "é " * 30]
    rows = [(i, t, "good") for i, t in enumerate(texts)] + [(1000 + i, "bad", "farm") for i in range(50)] + [(2000, good[1], "farm"), (2001, good[2], None)]
    got = {r["doc_id"]: r for r in quality.judge(spark.createDataFrame(rows, DOCS).withColumn("host", F.lit(1))).collect()}
    assert len(got) == len(rows)
    for i, t, _ in rows:
        r = got[i]
        n, *rest = _counts(t)
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (n, *rest), (i, t)
        assert r["base_failed"] == (n < 20 or 100 * rest[-1] > 30 * n)
    assert not got[2000]["kept"] and not got[2000]["base_failed"] and got[2001]["kept"] and got[0]["kept"]
    assert quality.judge(spark.createDataFrame(rows, DOCS).limit(0)).count() == 0


def test_quality_of_a_long_text_and_a_hot_host(spark):
    long = " ".join(f"w{i % 9001}" for i in range(60_000))
    rows = [(0, long, "hot"), (1, "y" * 500_000, "hot")] + [(i, f"a{i} " * 25, "hot" if i % 3 else f"h{i}") for i in range(2, 400)]
    got = {r["doc_id"]: r for r in quality.judge(spark.createDataFrame(rows, DOCS).withColumns({"key": F.lit(1), "salt": F.lit(2)})).collect()}
    assert len(got) == len(rows) and len({r["shrunk_rate"] for r in got.values() if r["host"] == "hot"}) == 1
    for i in (0, 1):
        n, *rest = _counts(rows[i][1])
        assert (got[i]["n_words"], got[i]["word_chars"], got[i]["n_repeat_words"]) == (n, rest[0], rest[-1])


def test_chat_of_a_long_conversation(spark):
    rows = [(1, t, "assistant" if t % 2 else "user", f"{t} </s> " * (2_000 if t == 7 else 3)) for t in range(200)]
    examples = chat.expand(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string"))
    got = chat.digest(examples).first()
    loss = "".join(x for _, t, _, x in rows if t % 2)
    assert examples.count() == 100 and got["n_turns"] == 200 and got["loss_chars"] == len(loss) and got["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()


def test_chat_comes_back_and_each_reply_is_trained_once(spark):
    rng = random.Random(7)
    bits = ["</s>", "<s>", "[INST]", "[/INST]", "\\", "\n", "ok", " ", "é", "<\\/s>", "\\\\", "$1"]
    rows = [(c, t, rng.choice(["user", "assistant", "system", "</s>", "a\nb"]), "".join(rng.choices(bits, k=rng.randrange(6))) or None) for c in range(30) for t in range(rng.randrange(1, 7))]
    rows += [(500, 0, None, None), (501, 0, "assistant", "x"), (501, 0, "assistant", "x"), (None, 0, "user", "q")]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").withColumn("prompt", F.lit(1))
    examples = chat.expand(df)
    got = {r["conv_id"]: r for r in chat.digest(examples).collect()}
    by = {}
    for c, t, r, x in rows:
        by.setdefault(c, []).append((t, r or "", x or ""))
    assert set(got) == set(by)
    for c, turns in by.items():
        turns.sort()
        loss = "".join(x for _, r, x in turns if r == "assistant")
        r = got[c]
        assert r["n_turns"] == len(turns) and r["loss_chars"] == len(loss)
        assert r["turns_sha256"] == hashlib.sha256("".join(f"{a}\n{x}\n" for _, a, x in turns).encode()).hexdigest()
        assert r["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
    replies = examples.filter("completion is not null").count()
    assert replies == sum(r == "assistant" for _, _, r, _ in rows)
    assert chat.digest(chat.expand(df.limit(0))).count() == 0
