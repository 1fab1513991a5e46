"""The pipeline on a small fixture: what each stage decides, against brute force."""

import hashlib
import random
import re
from collections import Counter
from fractions import Fraction

import pytest

pytest.importorskip("public_tokenizers")
import corpus_pipeline  # noqa: E402

SYLLABLES = {"en": "the ing tion er and ow ith sh", "de": "sch ein ung ich zer pf au ver", "es": "cion ado que los ar illo ez ña"}
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def _words(rng, lang, n):
    return [("".join(rng.choices(SYLLABLES[lang].split(), k=rng.randrange(1, 4)))) for _ in range(n)]


def _fixture():
    rng, rows = random.Random(17), []
    for i in range(90):
        lang = ["en", "de", "es"][i % 3]
        lines = [" ".join(_words(rng, lang, 25)) for _ in range(3)]
        if i % 2:
            lines.insert(1, "  the shing tion banner ")  # on every other document, of many sources
        rows.append((i, "\n".join(lines), lang, "hot" if i % 3 == 0 else f"s{i % 28:02}"))
    near = rows[40][1].split()
    near[10] = "shiller"
    rows += [(200, rows[7][1], rows[7][2], "copy"), (201, " ".join(near), rows[40][2], "s01"), (202, rows[40][1].replace("\n", " "), rows[40][2], None), rows[12], (None, " ".join(_words(rng, "de", 30)), "de", "s02"), (None, rows[3][1], rows[3][2], None)]
    rows += [(300, None, "en", "s01"), (301, "", "en", "s01"), (302, "123 !? 45\n--", None, "hot"), (None, None, None, None)]
    return [(i, t, lang, s, None if t is None else len(t)) for i, t, lang, s in rows]


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(_fixture(), DOCS).write.parquet(f"{at}/documents.parquet")
    return at


def _mixed(sources):
    """Per slot the source, by earliest deadline in exact fractions, up to the last block of all."""
    sizes = Counter(sources)
    w = {s: Fraction(n**0.5) for s, n in sizes.items()}
    w = {s: x / sum(w.values()) for s, x in w.items()}
    blocks, done, out, now, end = {s: -(-n // 16) for s, n in sizes.items()}, Counter(), [], 0, None
    while any(done[s] < blocks[s] for s in w):
        left = [s for s in w if done[s] < blocks[s]]
        now = max(now, min(done[s] / w[s] // 1 for s in left))
        pick = min((s for s in left if done[s] / w[s] // 1 <= now), key=lambda s: (-(-(done[s] + 1) / w[s] // 1), s))
        done[pick], now = done[pick] + 1, now + 1
        out.append(pick)
        if end is None and done[pick] == blocks[pick]:
            end = len(out) - 1
    return out, end


def test_the_mix_reaches_the_result(spark, corpus, monkeypatch):
    got = corpus_pipeline.run(spark, corpus).collect()
    slots, end = _mixed([r["source"] or "" for r in got])
    assert len(slots) > 10
    assert [s for s, _ in sorted({(r["slot"], r["source"] or "") for r in got})] == list(range(len(slots)))
    assert [s for _, s in sorted({(r["slot"], r["source"] or "") for r in got})] == slots
    assert len({(r["slot"], r["place"]) for r in got}) == len(got) and all(r["in_mix"] == (r["slot"] <= end) for r in got)
    monkeypatch.setattr(corpus_pipeline, "STAGES", [x for x in corpus_pipeline.STAGES if x[0] != "mixing"])
    without = corpus_pipeline.run(spark, corpus)
    assert not set(corpus_pipeline.MIX) & set(without.columns) and without.count() == len(got)


WORD = re.compile(r"[^\x20\x09-\x0D]+")
SPACES = " \t\n\x0b\x0c\r"


def _shingles(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text))
    return {tuple(words[i : i + 5]) for i in range(max(len(words) - 4, 1))} if words else set()


def _brute(rows):
    """What is left: (doc_id, text, language, source); the fixture's languages are plain, so the right one is its label."""
    rows = [r for r in rows if r[1] and any(c.isalpha() for c in r[1])]
    sites = {}
    for _, text, _, source, _ in rows:
        for line in text.split("\n"):
            sites.setdefault(line.strip(SPACES), set()).update([source] if source is not None else [])
    rows = [(i, "\n".join(x for x in t.split("\n") if not x.strip(SPACES) or len(sites[x.strip(SPACES)]) < 10), lang, s) for i, t, lang, s, _ in rows]
    sets = {i: _shingles(t) for i, t, *_ in rows if i is not None}
    group = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for i in sets:
            for j in sets:
                if group[i] < group[j] and sets[i] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                    group[j], changed = group[i], True
    once = {r[0]: r for r in rows if r[0] is not None and group[r[0]] == r[0]}
    return [*once.values(), *(r for r in rows if r[0] is None)]


def test_the_pipeline_equals_brute_force(spark, corpus):
    from ledgerloom.llm import bpe

    rows = _fixture()
    want = _brute(rows)
    assert 80 < len(want) < len(rows) - 6 and any("banner" in r[1] for r in rows if r[1]) and not any("banner" in r[1] for r in want)
    got = corpus_pipeline.run(spark, corpus).withColumnRenamed("ids", "token_ids")
    back = bpe.decode_column(got, corpus_pipeline.vocabulary_path(), ids="token_ids").collect()

    def order(row):
        return tuple((x is not None, x) for x in row)

    assert sorted(((r["doc_id"], bytes(r["decoded"]).decode(), r["lang"], r["source"]) for r in back), key=order) == sorted(want, key=order)
    for r in back:
        text = bytes(r["decoded"])
        assert r["decoded_sha256"] == hashlib.sha256(text).hexdigest() and r["n_bytes"] == len(text) and r["n_tokens"] == len(r["token_ids"])
        assert r["ids_sha256"] == hashlib.sha256(b"".join(x.to_bytes(4, "little") for x in r["token_ids"])).hexdigest()
