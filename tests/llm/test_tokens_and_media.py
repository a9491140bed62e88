"""BPE, packing and TIFF."""

import hashlib
import itertools
import random
import struct
import zlib

import numpy as np
import pyarrow as pa
import pytest
from support import DATA

from chronospark.llm import bpe, packing, tiff
from chronospark.llm.textnum import Words, alike, distinct, pieces, runs, utf8


@pytest.fixture(scope="module")
def path():
    return pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library(path):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


def odd_texts():
    rng = random.Random(1)
    made = ["".join(rng.choice("abct \n\t'sé½_1<|>endofx🙂 ß ") for _ in range(rng.randint(0, 60))) for _ in range(800)]
    return ["", " ", "a  b", " \n x", "foo\n \nbar", "x<|endoftext|>y  <|endoftext|>", "<|endoftext|>", "a" * 5000, "ab" * 3000, "it's we'll '  's", "½²③Ⅷ٣ x_y", "\x1c a\x1d b \x85c d  e 　g", "日本語 テスト", "\x00 \x01", *made]


def test_codec_equals_the_library(path, library):
    codec, texts = bpe.Codec(path), odd_texts()
    flat, borders = codec.encode(pa.array(texts))
    for i, t in enumerate(texts):
        ids = library.encode(t, add_special_tokens=False).ids
        assert flat[borders[i] : borders[i + 1]].tolist() == ids
        assert codec.decode(np.array(ids)) == library.decode(ids, skip_special_tokens=False)


def test_merging_short_and_long(path):
    codec = bpe.Codec(path)
    rng = random.Random(2)
    for _ in range(300):
        w = bytes(rng.choice(b"etaoin sh") for _ in range(rng.randint(1, 40)))
        assert codec.merged(w) == codec.merged_long(w)


def test_query_by_library(spark, library):
    out = bpe.op2_bpe(spark, DATA).toPandas()
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    for r in out.itertuples():
        ids = library.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_bpe_edges(edges, empty, path):
    out = bpe.encode_decode(edges, path).collect()
    assert len(out) == edges.count() and sorted(r["decoded"] for r in out) == sorted(r["text"] or "" for r in edges.collect())
    assert bpe.encode_decode(empty, path).count() == 0


def test_words_and_runs():
    texts = ["A b  c", None, "", "b c a B C A", "x"]
    w = Words(pa.array(texts))
    assert np.diff(w.first).tolist() == [3, 0, 0, 6, 1]
    assert w.hash[1] == w.hash[3] and w.hash[0] == w.hash[5]
    made, borders = runs(w, 3, short=True)
    assert np.diff(borders).tolist() == [1, 0, 0, 4, 1]
    kinds, at = distinct(made, borders)
    assert np.diff(at).tolist() == [1, 0, 0, 3, 1]


def test_groups_of_pieces():
    texts = ["aa bb aa", " aa", "bb aa bb", "y" * 200 + " " + "y" * 200]
    raw, borders = utf8(pa.array(texts))
    start, end = pieces(raw, borders)
    first, group = alike(raw, start, end)
    whole = raw.tobytes()
    assert [whole[start[first[g]] : end[first[g]]] for g in group] == [whole[a:b] for a, b in zip(start, end)]
    assert b"".join(whole[a:b] for a, b in zip(start, end)) == whole


def test_bounds_never_exceed_the_optimum():
    rng = random.Random(3)

    def optimum(items, capacity):
        for n in itertools.count(1):
            def fits(i, room):
                return i == len(items) or any(room[j] >= items[i] and fits(i + 1, room[:j] + [room[j] - items[i]] + room[j + 1 :]) for j in range(n))
            if fits(0, [capacity] * n):
                return n

    for _ in range(60):
        items = sorted((rng.randint(1, 20) for _ in range(rng.randint(1, 7))), reverse=True)
        best = optimum(items, 20)
        assert packing.bounds(np.array(items), 20)[0] <= best <= packing.best_fit_decreasing(np.array(items), 20).max() + 1


def check_packing(rows, ids_of, capacity):
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    for i, own in by_doc.items():
        ids, at = [*ids_of[i], 2], 0
        for n, r in enumerate(sorted(own, key=lambda r: r["piece"])):
            part = np.array(ids[r["start"] : r["start"] + r["length"]], "<u4")
            assert (r["piece"], r["start"], r["ids_crc32"]) == (n, at, zlib.crc32(part.tobytes())) and (n == 0 or r["length"] == capacity)
            at += r["length"]
        assert at == len(ids)
    for own in by_sequence.values():
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= capacity
    return len(by_sequence)


def test_packing_query(spark, library):
    rows = packing.op8_packing(spark, DATA).collect()
    ids = {r["doc_id"]: library.encode(r["text"] or "", add_special_tokens=False).ids for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    used = check_packing(rows, ids, 1024)
    assert {r["doc_id"] for r in rows} == set(ids)
    bound = packing.bounds(np.array([r["length"] for r in rows]), 1024)[0]
    assert bound <= used <= 1.03 * bound + 1


def test_packing_exchanges_between_groups(spark):
    items = spark.range(3000).select("id", (F_pmod(spark) * 0 + 300).cast("long").alias("length"))
    packed = packing.pack(items, 1024, group_rows=100)
    assert packed.count() == 3000 and packing.certificate(packed) == (1000, 1000)


def F_pmod(spark):
    from pyspark.sql import functions as F

    return F.col("id") % 7


def test_packing_edges(edges, empty, path, library):
    rows = packing.pack_documents(edges, path).collect()
    lengths = sum(r["length"] for r in rows)
    assert lengths == sum(len(library.encode(r["text"] or "", add_special_tokens=False).ids) + 1 for r in edges.collect())
    assert len({(r["sequence_id"], r["offset"]) for r in rows}) == len(rows)
    assert packing.pack_documents(empty, path).count() == 0


FORMS = list(itertools.product((tiff.NONE, tiff.LZW, tiff.DEFLATE, tiff.PACKBITS), (1, 2), (None, (16, 16)), (np.uint8, np.uint16)))


@pytest.mark.parametrize("compression,predictor,tile,kind", FORMS)
def test_tiff_round_trip(compression, predictor, tile, kind):
    rng = np.random.default_rng(4)
    pages = [rng.integers(0, 5, (37, 29), kind), np.full((3, 200), 7, kind), rng.integers(0, 255, (20, 18, 3)).astype(kind), np.zeros((70, 90), kind)]
    back = list(tiff.read(tiff.write(pages, compression, predictor, 8, tile)))
    assert len(back) == 4
    for page, p in zip(pages, back):
        assert (p.pixels == page.reshape(p.pixels.shape)).all() and p.tiled == bool(tile)


def test_lzw_over_many_codes():
    data = np.random.default_rng(5).integers(0, 256, 60_000, np.uint8).tobytes()
    assert tiff.lzw_decode(tiff.lzw_encode(data), len(data)) == data and tiff.lzw_decode(tiff.lzw_encode(b""), 0) == b""


def test_big_endian_page():
    data = b"MM\0*" + struct.pack(">I", 8 + 4) + bytes([1, 2, 3, 4]) + struct.pack(">H", 6)
    for tag, value in ((256, 2), (257, 2), (258, 8), (259, 1), (273, 8), (279, 4)):
        data += struct.pack(">HHII", tag, 4, 1, value)
    page, = tiff.read(data + b"\0\0\0\0")
    assert page.pixels.reshape(-1).tolist() == [1, 2, 3, 4]


def test_tiff_pages_and_faults(spark):
    good = tiff.write([np.zeros((2, 2), np.uint8), np.ones((2, 3), np.uint8)])
    rows = [(1, bytearray(good)), (2, None), (3, bytearray(b"no picture")), (4, bytearray(good[:-30])), (1, bytearray(good))]
    out = tiff.tiff_pages(spark.createDataFrame(rows, "doc_id long, media binary")).collect()
    assert sum(r["doc_id"] == 1 and r["error"] is None for r in out) == 4
    assert all(r["error"] for r in out if r["doc_id"] in (2, 3)) and any(r["error"] for r in out if r["doc_id"] == 4)
    with pytest.raises(ValueError):
        tiff.tiff_pages(spark.createDataFrame(rows, "page long, media binary"))


def test_tiff_query(spark, edges, empty):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    texts = {r["doc_id"]: (r["text"] or "").encode() for r in docs.collect()}
    for r in tiff.op7_tiff(spark, DATA).collect():
        raw = texts[r["doc_id"]]
        payload = raw + b"\xff" * (-len(raw) % 576 or 576 * (not raw))
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
    out = tiff.tiff_pages(tiff.as_tiff(edges)).collect()
    assert len(out) == edges.count() and not any(r["error"] for r in out)
    assert tiff.tiff_pages(tiff.as_tiff(empty)).count() == 0


def test_broken_media_never_end_a_job(spark):
    """Bytes changed or cut anywhere, huge sizes and bad codes give an error row or pages, nothing else."""
    rng = random.Random(11)
    good = [tiff.write([np.arange(40 * 30, dtype=np.uint16).astype(np.uint8).reshape(30, 40)], c) for c in (tiff.NONE, tiff.LZW, tiff.DEFLATE, tiff.PACKBITS)]
    media = []
    for data in good:
        for _ in range(80):
            odd = bytearray(data)
            for _ in range(rng.randint(1, 6)):
                odd[rng.randrange(len(odd))] = rng.randrange(256)
            media.append(bytes(odd[: rng.randint(8, len(odd))]))
        for tag in (tiff.WIDTH, tiff.HEIGHT, tiff.SAMPLES, tiff.ROWS_PER_STRIP):
            at = data.index(struct.pack("<H", tag), struct.unpack_from("<I", data, 4)[0])
            media += [data[: at + 8] + struct.pack("<I", n) + data[at + 12 :] for n in (0, 60_000, 0xFFFFFFF0)]
    rows = spark.createDataFrame([(i, m) for i, m in enumerate(media)], "id long, media binary")
    out = tiff.tiff_pages(rows).select("id", "page", "error").collect()
    assert {r["id"] for r in out} == set(range(len(media)))
    assert all((r["page"] is None) != (r["error"] is None) for r in out)


def test_lzw_refuses_codes_without_entry():
    bits = "".join(f"{c:09b}" for c in (256, 65, 400, 257))
    data = int(bits.ljust(40, "0"), 2).to_bytes(5, "big")
    with pytest.raises(ValueError):
        tiff.lzw_decode(data, 1 << 20)


@pytest.mark.parametrize("compression", [tiff.DEFLATE, tiff.LZW, tiff.PACKBITS, tiff.NONE])
def test_parts_that_are_too_long_or_short_are_errors(compression):
    """A strip that stands for far more than its page is stopped early; so is one that ends early."""
    import tracemalloc

    page = np.zeros((1, 1), np.uint8)
    long = np.zeros((1, 1 if compression == tiff.NONE else 3_000_000 if compression != tiff.DEFLATE else 100_000_000), np.uint8)
    bomb = tiff.write([long if long.size > 1 else np.zeros((1, 5000), np.uint8)], compression, 1)
    at = bomb.index(struct.pack("<HHI", tiff.WIDTH, 4, 1)) + 8
    bomb = bomb[:at] + struct.pack("<I", 1) + bomb[at + 4 :]
    tracemalloc.start()
    with pytest.raises(ValueError):
        list(tiff.read(bomb))
    assert tracemalloc.get_traced_memory()[1] < 2_000_000 + 2 * len(bomb)
    tracemalloc.stop()
    short = tiff.write([page], compression, 1)
    at = short.index(struct.pack("<HHI", tiff.HEIGHT, 4, 1)) + 8
    with pytest.raises(ValueError):
        list(tiff.read(short[:at] + struct.pack("<I", 2) + short[at + 4 :]))
    assert next(tiff.read(tiff.write([page], compression, 1))).pixels.tolist() == [[[0]]]


def test_large_pages_leave_in_batches_of_their_own(spark, monkeypatch):
    pages = [np.full((40, 50), i, np.uint8) for i in range(5)]
    df = spark.createDataFrame([(1, tiff.write(pages)), (2, b"no"), (3, tiff.write(pages[:1]))], "id long, media binary").coalesce(1)
    monkeypatch.setattr(tiff, "HELD", 3000)
    got = tiff.tiff_pages(df).orderBy("id", "page").collect()
    assert [(r["id"], r["page"]) for r in got] == [(1, k) for k in range(5)] + [(2, None), (3, 0)]
    assert all(bytes(r["pixels"]) == pages[r["page"]].tobytes() for r in got if r["page"] is not None)
