"""WARC and media columns against brute force on small fixtures."""

import hashlib
import io
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import media, warc


def test_warc_round_trip_and_revisits(spark):
    big = "é<p>" * 400
    rows = [(i, f"http://h/{i}", f"<html>{i}" * (i % 7)) for i in range(40)] + [(100 + i, "http://c/", big) for i in range(5)] + [(200, None, None), (201, "u\r\nX: y", "short"), (202, "u", "short")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("digest", F.lit(1)).repartition(3)
    files = warc.write(pages, file_bytes=600)
    assert files.count() > 3 and files.agg(F.sum("records")).first()[0] == len(rows)
    whole, cut = (warc.read(files, n).collect() for n in (1 << 20, 37))
    assert sorted(map(repr, whole)) == sorted(map(repr, cut)) and len(whole) == len(rows)
    by = {r["page_id"]: r for r in whole}
    for i, _, html in rows:
        data = (html or "").encode()
        r = by[i]
        assert r["digest_ok"] and r["payload_bytes"] == len(data) and r["payload_digest"] == hashlib.sha1(data).hexdigest()
        again = 100 <= i < 104
        assert (r["record_type"], r["refers_to"]) == (("revisit", 104) if again else ("response", None))
        assert r["payload"] is None if again else bytes(r["payload"]) == data
    assert warc.read(warc.write(pages.limit(0))).count() == 0


def test_warc_of_null_ids_and_long_payloads(spark):
    big, long = "x" * 2000, "é" * 3_000_000
    rows = [(None, None, big), (None, "u", None), (1, "u", big), (2, "u", big), (3, "u", long)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    got = sorted(((r["page_id"], r["record_type"], r["refers_to"], r["payload_bytes"], r["digest_ok"]) for r in warc.read(warc.write(pages)).collect()), key=repr)
    want = [(None, "response", None, 2000, True), (None, "response", None, 0, True), (1, "revisit", 2, 2000, True), (2, "response", None, 2000, True), (3, "response", None, 6_000_000, True)]
    assert got == sorted(want, key=repr)


def test_warc_revisits_are_judged_by_the_response_read_back(spark, tmp_path):
    def sha(data):
        return hashlib.sha1(data).hexdigest()

    sound, other = b"sound" * 300, b"other" * 300
    records = [("response", 1, sound, sha(sound), None, 0), ("response", 2, other, sha(sound), None, 0), ("revisit", 3, b"", sha(sound), 1, len(sound)), ("revisit", 4, b"", sha(sound), 2, len(sound)), ("revisit", 5, b"", sha(sound), 9, len(sound)), ("revisit", 6, b"", sha(sound), 1, 7)]
    data = b"".join(warc.member(warc.record(kind, "u", key, payload, digest, to, n)) for kind, key, payload, digest, to, n in records)
    (tmp_path / "a.warc.gz").write_bytes(data)
    files = spark.createDataFrame([(f"file://{tmp_path}/a.warc.gz", len(data), len(records))], "path string, bytes bigint, records bigint")
    got = {r["page_id"]: (r["digest_ok"], r["payload_bytes"]) for r in warc.read(files).collect()}
    assert got == {1: (True, 1500), 2: (False, 1500), 3: (True, 1500), 4: (False, None), 5: (False, None), 6: (True, 1500)}


def test_reader_is_not_misled_by_the_magic_inside_members():
    rng = random.Random(1)
    packed = [warc.member(warc.record("response", "u", i, warc.GZIP_MAGIC * 50 + rng.randbytes(3000), "d", None, 0), level=0) for i in range(30)]
    data = b"".join(packed)
    assert data.count(warc.GZIP_MAGIC) > 300
    file = pa.BufferReader(data)
    for step in (100, 5000, len(data)):
        got = [f["warc-record-id"] for a in range(0, len(data), step) for f, _ in warc.members(file, len(data), a, min(a + step, len(data)), 64)]
        assert got == [f"<urn:page:{i}>" for i in range(30)]


@pytest.mark.parametrize("shape", [(1, 1), (7, 5), (24, 24), (48, 24)])
def test_images_round_trip(shape):
    grey = np.random.default_rng(1).integers(0, 256, shape, dtype=np.uint8)
    for encode in (media.encode_pgm, media.encode_bmp):
        assert (media.decode(encode(grey)) == grey).all()
    h, w = shape
    rgb = np.random.default_rng(2).integers(0, 256, (h, w, 3), dtype=np.uint8)
    assert (media.decode(b"P6 # c\n%d %d\n255\n" % (w, h) + rgb.tobytes()) == rgb).all()
    assert (media.decode(b"P2\n%d %d\n255\n" % (w, h) + b" ".join(b"%d" % v for v in grey.ravel())) == grey).all()
    bits = grey > 127
    assert (media.decode(b"P4\n%d %d\n" % (w, h) + np.packbits(bits, axis=1).tobytes()) == np.where(bits, 0, 255)).all()
    assert (media.decode(b"P1\n%d %d\n" % (w, h) + b" ".join(b"%d" % v for v in bits.ravel())) == np.where(bits, 0, 255)).all()
    with pytest.raises(media.MediaError):
        media.decode(media.encode_pgm(grey)[:-1])


def test_area_resize_keeps_the_mean_and_equals_block_means():
    image = np.random.default_rng(3).integers(0, 256, (30, 50), dtype=np.uint8)
    assert np.allclose(media.area_resize(image, 10, 10), image.reshape(10, 3, 10, 5).mean(axis=(1, 3)))
    assert np.isclose(media.area_resize(image, 7, 9).mean(), image.mean())
    assert media.difference_hash(np.tile(np.arange(90, dtype=np.uint8), (8, 1))) == "f" * 16


def test_text_media_and_tiles(spark):
    texts = ["a", None, "", "é" * 288, "x" * 577, "x" * 577]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").selectExpr("doc_id", "text", "1 as media")
    for form in ("pgm", "bmp"):
        stored = media.text_to_media(df, form=form)
        got = {r["doc_id"]: r for r in media.features(stored, media="_media").collect()}
        for i, t in enumerate(texts):
            raw = (t or "").encode()
            payload = raw + b"\xff" * (max(576, -(-len(raw) // 576) * 576) - len(raw))
            r = got[i]
            assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        assert got[4]["feature"] == got[5]["feature"] and got[4]["media_sha256"] == got[5]["media_sha256"]
    cells = media.tiles(stored, "doc_id", "_media").collect()
    assert len(cells) == 4 * len(texts) and np.load(io.BytesIO(cells[0]["npy"])).shape == (16, 16)
    bad = spark.createDataFrame([(1, None), (2, bytearray(b"P5\n9 9\n255\nx")), (3, bytearray(b""))], "doc_id bigint, media binary")
    assert media.tiles(bad, "doc_id").count() == 0
    assert [r["feature"] for r in media.features(bad, keep=("doc_id",)).collect()] == [None] * 3
    assert media.features(media.text_to_media(df.limit(0)), media="_media").count() == 0


BROKEN = [
    b"P2\n2 1\n255\n1 x", b"P2\n2 1\n255\n1 300", b"P2\n2 1\n255\n# c\n1 2", b"P2\n2 1\n255\n1 " + b"9" * 5000, b"P5\n" + b"9" * 5000 + b" 1\n255\nx", b"P5\n1 1\n15\n\xff",
    b"P7\n", b"P", b"BM", media.encode_bmp(np.zeros((2, 2), dtype=np.uint8))[:300], b"BM" + b"\xff" * 60,
]


@pytest.mark.parametrize("data", BROKEN, ids=range(len(BROKEN)))
def test_malformed_media_are_refused(data):
    with pytest.raises(media.MediaError):
        media.decode(data)


def test_samples_are_scaled_from_their_maximum():
    assert media.decode(b"P2\n4 1\n15\n0 1 7 15").tolist() == [[0, 17, 119, 255]]
    assert media.decode(b"P5\n3 1\n3\n\x00\x01\x03").tolist() == [[0, 85, 255]]
    assert media.decode(b"P6\n1 1\n1\n\x00\x01\x01").tolist() == [[[0, 255, 255]]]


def _brute_resize(image, height, width):
    """Mean of each output pixel's area, sample by sample, in fractions."""
    from fractions import Fraction

    h, w = image.shape
    out = np.zeros((height, width))
    for y in range(height):
        for x in range(width):
            top, bottom, left, right = Fraction(y * h, height), Fraction((y + 1) * h, height), Fraction(x * w, width), Fraction((x + 1) * w, width)
            total = Fraction(0)
            for i in range(int(top), -int(-bottom // 1)):
                for j in range(int(left), -int(-right // 1)):
                    total += int(image[i, j]) * (min(bottom, i + 1) - max(top, i)) * (min(right, j + 1) - max(left, j))
            out[y, x] = total / ((bottom - top) * (right - left))
    return out


def _brute_hash(image):
    small = _brute_resize(image, 8, 9)
    bits = "".join("1" if round(small[y, x], 6) < round(small[y, x + 1], 6) else "0" for y in range(8) for x in range(8))
    return f"{int(bits, 2):016x}"


def test_features_equal_brute_force(spark):
    texts = ["plain text", None, "é" * 700, "zebra " * 200, "\x00\x7f" * 300]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r["doc_id"]: r for r in media.features(media.text_to_media(df)).collect()}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        payload = raw + b"\xff" * (max(576, -(-len(raw) // 576) * 576) - len(raw))
        image = np.frombuffer(payload, dtype=np.uint8).reshape(-1, 24)
        stored = b"P5\n24 %d\n255\n" % len(image) + payload
        small = np.clip(np.round(_brute_resize(image, 32, 32)), 0, 255).astype(np.uint8)
        files, hashes = b"", [_brute_hash(image)]
        for y in (0, 16):
            for x in (0, 16):
                out = io.BytesIO()
                np.save(out, small[y : y + 16, x : x + 16])
                files += out.getvalue()
                hashes.append(_brute_hash(small[y : y + 16, x : x + 16]))
        r = got[i]
        assert (r["media_bytes"], r["media_sha256"]) == (len(stored), hashlib.sha256(stored).hexdigest())
        assert r["feature"] == "-".join(hashes) and (r["npy_bytes"], r["npy_sha256"]) == (len(files), hashlib.sha256(files).hexdigest())


def test_media_of_long_texts_and_clashing_names(spark):
    df = spark.createDataFrame([(1, "ab" * 2_000_000), (2, "x")], "doc_id bigint, text string").selectExpr("doc_id", "text", "7 as feature", "8 as n_bytes")
    stored = media.text_to_media(df)
    got = media.features(stored, keep=("doc_id", "feature", "n_bytes", "_n_bytes"))
    assert got.columns[:4] == ["doc_id", "feature", "n_bytes", "_n_bytes"] and "_feature" in got.columns
    assert {r["doc_id"]: (r["_n_bytes"], r["payload_bytes"], r["feature"]) for r in got.collect()} == {1: (4_000_000, 4_000_320, 7), 2: (1, 576, 7)}
