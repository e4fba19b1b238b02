from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pytest
from common import EDGES, docs_of

from barloom.llm import media


def padded(text):
    b = (text or "").encode()
    return b + bytes(-len(b) % 64 or (0 if b else 64))


def test_texts_come_back(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    rows = media.store_texts(docs, keep_media=True).collect()
    assert len(rows) == len(texts)
    for r in rows:
        p = padded(texts[r.doc_id])
        assert (r.n_bytes, r.payload_bytes) == (len((texts[r.doc_id] or "").encode()), len(p))
        assert r.payload_sha256 == hashlib.sha256(p).hexdigest() and r.tail_crc32 == zlib.crc32(p[-64:])
        assert r.media_bytes == len(r.media) and r.media_sha256 == hashlib.sha256(r.media).hexdigest()
        assert r.media[:2] == b"\xff\xd8" and r.media[-2:] == b"\xff\xd9"


def test_edges(spark):
    rows = media.store_texts(docs_of(spark, EDGES)).collect()
    assert len(rows) == len(EDGES)
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
    assert by[1][0].payload_sha256 == by[2][0].payload_sha256 == hashlib.sha256(bytes(64)).hexdigest()
    assert by[7][0].feature == by[8][0].feature and by[7][0].media_sha256 == by[8][1].media_sha256
    assert media.store_texts(docs_of(spark, [])).count() == 0


@pytest.mark.parametrize("n", [1, 2, 64, 8191, 8192, 9000])
def test_any_bytes_in_any_number_of_rows(n):
    data = np.random.default_rng(n).integers(0, 256, 64 * n, dtype=np.uint8).tobytes()
    pictures = media.decode(media.encode([data, bytes(64)]))
    assert b"".join(t.tobytes() for _, _, t in pictures[0]) == data
    assert pictures[1][0][2].tobytes() == bytes(64)
    assert len(pictures[0]) == -(-n // media.MAX_ROWS)


def write_colour_jpeg(blocks, wide, high, interval, quant=3):
    """A bit-by-bit writer of 4:2:0 pictures: blocks[mcu] is a list of six (dc, {place: ac})."""
    dc_table = (bytes([0, 0, 0, 12] + [0] * 12), bytes(range(12)))
    symbols = [0x00, 0xF0] + [r << 4 | s for r in range(16) for s in range(1, 11)]
    ac_table = (bytes([0] * 15 + [len(symbols)]), bytes(symbols))
    code = {s: format(k, "04b") for k, s in enumerate(dc_table[1])}, {s: format(k, "016b") for k, s in enumerate(symbols)}
    bits_of = lambda v: "" if v == 0 else format(v if v > 0 else v + (1 << abs(v).bit_length()) - 1, f"0{abs(v).bit_length()}b")
    out, bits, pred = bytearray(), "", [0, 0, 0]

    def flush():
        nonlocal bits
        bits += "1" * (-len(bits) % 8)
        for k in range(0, len(bits), 8):
            b = int(bits[k : k + 8], 2)
            out.append(b)
            if b == 255:
                out.append(0)
        bits = ""

    for m, mcu in enumerate(blocks):
        if interval and m and m % interval == 0:
            flush()
            out.extend((0xFF, 0xD0 + (m // interval - 1) % 8))
            pred = [0, 0, 0]
        for k, (dc, ac) in enumerate(mcu):
            part = max(0, k - 3)
            d = dc - pred[part]
            pred[part] = dc
            bits += code[0][abs(d).bit_length()] + bits_of(d)
            at = 1
            for place in sorted(ac):
                run = place - at
                while run > 15:
                    bits += code[1][0xF0]
                    run -= 16
                bits += code[1][run << 4 | abs(ac[place]).bit_length()] + bits_of(ac[place])
                at = place + 1
            if at < 64:
                bits += code[1][0]
    flush()
    seg = media._segment
    sof = bytes([8, high >> 8, high & 255, wide >> 8, wide & 255, 3, 1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0])
    head = b"\xff\xd8" + seg(0xE0, b"JFIF\0") + seg(0xDB, b"\0" + bytes([quant] * 64)) + seg(0xC0, sof)
    head += seg(0xC4, b"\x00" + dc_table[0] + dc_table[1]) + seg(0xC4, b"\x10" + ac_table[0] + ac_table[1])
    if interval:
        head += seg(0xDD, bytes([interval >> 8, interval & 255]))
    return head + seg(0xDA, bytes([3, 1, 0, 2, 0, 3, 0, 0, 63, 0])) + bytes(out) + b"\xff\xd9"


@pytest.mark.parametrize("interval", [0, 2])
def test_colour_picture_with_ac_coefficients(spark, interval):
    rng = np.random.default_rng(7)
    wide, high = 45, 30  # 3 x 2 MCUs of 16 x 16
    blocks = [[(int(rng.integers(-300, 300)), {int(p): int(rng.choice([-9, 1, 40])) for p in rng.choice(np.arange(1, 64), 5, replace=False)}) for _ in range(6)] for _ in range(6)]
    data = write_colour_jpeg(blocks, wide, high, interval)
    (w, h, plane), = media.decode([data])[0]
    want = np.zeros((4, 6), int)
    for m in range(6):
        for b in range(4):
            want[m // 3 * 2 + b // 2, m % 3 * 2 + b % 2] = np.clip((blocks[m][b][0] * 3 + 4) // 8 + 128, 0, 255)
    assert (w, h) == (wide, high) and (plane == want).all()
    df = spark.createDataFrame([(1, bytearray(data)), (2, bytearray(b"junk")), (3, None)], "id long, media binary")
    rows = {r.key: r for r in media.thumbnails(df, "id").collect()}
    assert rows[1].width == wide and bytes(rows[1].thumbnail) == plane.tobytes() and len(rows[1].average_hash) == 16
    assert rows[2].width is None and rows[2].error and rows[3].error
