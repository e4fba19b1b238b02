"""Baseline JPEG columns: a reader of DC-only luminance thumbnails, and a writer whose thumbnail is the payload.

Reader: parses markers (SOF0, DQT, DHT, DRI, SOS, RSTn), finds the scan's restart intervals and Huffman-decodes all
intervals of all pictures of a batch in step, in numpy: each lane holds its bit place, block and coefficient; AC
coefficients are skipped and only DC sums are kept.  A picture's luminance DC terms, dequantized and divided by
eight, are its thumbnail at an eighth of its size.

Writer: stores bytes without loss as 8-bit samples.  Every sample is one 8 x 8 block whose only coefficient is DC
with quantizer 8, so the decoded picture is flat in each block at exactly the sample's value and the DC thumbnail
is the payload.  Rows of 64 blocks are restart intervals.  A picture is at most 8,191 block rows high; longer
payloads are stored as several pictures one after another.

Defined results: a null text is an empty payload of 64 zero bytes; equal texts give equal values; repeated rows
are stored each; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROW, MAX_ROWS, GROUP_BYTES = 64, 8191, 1 << 20

# The coefficient order of the format.
ZIGZAG = np.array([
    0, 1, 8, 16, 9, 2, 3, 10, 17, 24, 32, 25, 18, 11, 4, 5, 12, 19, 26, 33, 40, 48, 41, 34, 27, 20, 13, 6, 7, 14, 21, 28,
    35, 42, 49, 56, 57, 50, 43, 36, 29, 22, 15, 23, 30, 37, 44, 51, 58, 59, 52, 45, 38, 31, 39, 46, 53, 60, 61, 54, 47, 55, 62, 63,
])

#: DC categories 0 to 8 with code lengths that suit text (small differences), and an AC table whose end-of-block is one bit.
DC_COUNTS, DC_SYMBOLS = bytes([0, 0, 6, 2, 1] + [0] * 11), bytes([6, 5, 7, 4, 3, 0, 2, 1, 8])
AC_COUNTS, AC_SYMBOLS = bytes([1, 1] + [0] * 14), bytes([0x00, 0x01])


def _codes(counts: bytes, symbols: bytes) -> list[tuple[int, int, int]]:
    """(symbol, code, length) in canonical order."""
    out, code, k = [], 0, 0
    for length, n in enumerate(counts, 1):
        for _ in range(n):
            out.append((symbols[k], code, length))
            code, k = code + 1, k + 1
        code <<= 1
    return out


def _lookup(counts: bytes, symbols: bytes) -> np.ndarray:
    """For each 16-bit look-ahead: length * 256 + symbol; 0 where no code fits."""
    table = np.zeros(65536, np.int32)
    for symbol, code, length in _codes(counts, symbols):
        table[code << (16 - length) : (code + 1) << (16 - length)] = length * 256 + symbol
    return table


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _header(rows: int) -> bytes:
    return b"".join((
        b"\xff\xd8", _segment(0xDB, b"\0" + bytes([8] + [1] * 63)), _segment(0xC0, struct.pack(">BHHB", 8, rows * 8, ROW * 8, 1) + b"\x01\x11\x00"),
        _segment(0xC4, b"\x00" + DC_COUNTS + DC_SYMBOLS), _segment(0xC4, b"\x10" + AC_COUNTS + AC_SYMBOLS),
        _segment(0xDD, struct.pack(">H", ROW)), _segment(0xDA, b"\x01\x01\x00\x00\x3f\x00"),
    ))


def _symbol_tables() -> tuple[np.ndarray, np.ndarray]:
    """For each difference + 255: bits of its DC code, its value and the end-of-block; and how many they are."""
    dc = {s: (code, length) for s, code, length in _codes(DC_COUNTS, DC_SYMBOLS)}
    bits, sizes = np.zeros(511, np.uint32), np.zeros(511, np.int64)
    for diff in range(-255, 256):
        size = abs(diff).bit_length()
        code, length = dc[size]
        value = diff if diff >= 0 else diff + (1 << size) - 1
        bits[diff + 255] = ((code << size | value) << 1) | 0  # the AC table's end-of-block is the code 0 of one bit
        sizes[diff + 255] = length + size + 1
    return bits, sizes


_BITS, _SIZES = _symbol_tables()


def encode_rows(samples: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entropy-coded restart intervals of (rows, 64) samples: their bytes, stuffed, and where each begins."""
    diff = np.diff(samples.astype(np.int16), axis=1, prepend=np.int16(128)) + 255
    bits, sizes = _BITS[diff], _SIZES[diff]
    ends = np.cumsum(sizes, axis=1)
    row_bytes = (ends[:, -1] + 7) // 8
    starts = np.concatenate(([0], np.cumsum(row_bytes)))
    at = (ends - sizes + 8 * starts[:-1, None]).ravel()
    out = np.zeros(int(starts[-1]) + 8, np.uint8)
    # a symbol has at most 21 bits: it lies in four bytes
    word = bits.ravel().astype(np.uint64) << (np.uint64(32) - (at & 7).astype(np.uint64) - sizes.ravel().astype(np.uint64))
    first = at >> 3
    for k in range(4):
        part = ((word >> np.uint64(24 - 8 * k)) & np.uint64(255)).astype(np.float64)
        out[: int(starts[-1])] |= np.bincount(first + k, part, int(starts[-1]) + 4)[: int(starts[-1])].astype(np.uint8)
    pad = (-ends[:, -1]) % 8  # intervals are filled up with ones
    out[starts[1:] - 1] |= ((1 << pad) - 1).astype(np.uint8)
    out = out[: int(starts[-1])]
    full = out == 255
    moved = np.arange(len(out)) + np.concatenate(([0], np.cumsum(full)))[:-1]
    stuffed = np.zeros(len(out) + int(full.sum()), np.uint8)
    stuffed[moved] = out
    begin = np.concatenate((moved[starts[:-1]], [len(stuffed)])) if len(samples) else np.zeros(1, np.int64)
    return stuffed, begin


def encode(payloads: list[bytes]) -> list[bytes]:
    """The stored form of each payload (whole rows of 64 bytes)."""
    rows = [len(p) // ROW for p in payloads]
    data, begin = encode_rows(np.frombuffer(b"".join(payloads), np.uint8).reshape(-1, ROW))
    data, out, r = data.tobytes(), [], 0
    for n in rows:
        parts = []
        for a in range(0, n, MAX_ROWS):
            height = min(MAX_ROWS, n - a)
            parts.append(_header(height))
            for k in range(height):
                parts.append(data[begin[r + a + k] : begin[r + a + k + 1]])
                parts.append(bytes((0xFF, 0xD0 + k % 8)) if k + 1 < height else b"\xff\xd9")
        r += n
        out.append(b"".join(parts))
    return out


class Picture:
    """What the markers of one picture say."""

    def __init__(self, data: bytes, at: int):
        if data[at : at + 2] != b"\xff\xd8":
            raise ValueError("no start of image")
        self.quant, self.huff, self.interval, at = {}, {}, 0, at + 2
        while True:
            while data[at + 1] == 0xFF:
                at += 1
            marker, n = data[at + 1], struct.unpack_from(">H", data, at + 2)[0]
            body, at = data[at + 4 : at + 2 + n], at + 2 + n
            if marker == 0xDB:
                k = 0
                while k < len(body):
                    wide = body[k] >> 4
                    table = np.frombuffer(body, ">u2" if wide else "u1", 64, k + 1)
                    self.quant[body[k] & 15] = np.zeros(64, np.int64)
                    self.quant[body[k] & 15][ZIGZAG] = table
                    k += 65 + 64 * wide
            elif marker == 0xC4:
                k = 0
                while k < len(body):
                    n = sum(body[k + 1 : k + 17])
                    self.huff[body[k]] = (body[k + 1 : k + 17], body[k + 17 : k + 17 + n])
                    k += 17 + n
            elif marker == 0xC0:
                precision, self.height, self.width, count = struct.unpack_from(">BHHB", body)
                if precision != 8:
                    raise ValueError("samples of 8 bits only")
                self.parts = [(body[6 + 3 * k], body[7 + 3 * k] >> 4, body[7 + 3 * k] & 15, body[8 + 3 * k]) for k in range(count)]
            elif 0xC1 <= marker <= 0xCF and marker not in (0xC8, 0xCC):
                raise ValueError("baseline pictures only")
            elif marker == 0xDD:
                self.interval = struct.unpack(">H", body)[0]
            elif marker == 0xDA:
                tables = {body[1 + 2 * k]: body[2 + 2 * k] for k in range(body[0])}
                if len(tables) != len(self.parts):
                    raise ValueError("one interleaved scan only")
                break
        self.scan = at
        hmax, vmax = max(p[1] for p in self.parts), max(p[2] for p in self.parts)
        if len(self.parts) == 1:
            self.parts = [(self.parts[0][0], 1, 1, self.parts[0][3])]
            hmax = vmax = 1
        self.wide, self.high = -(-self.width // (8 * hmax)), -(-self.height // (8 * vmax))
        self.h, self.v = self.parts[0][1], self.parts[0][2]
        #: The blocks of an MCU: component, and its DC and AC tables.
        self.blocks = [(k, self.huff[tables[p[0]] >> 4], self.huff[16 | (tables[p[0]] & 15)]) for k, p in enumerate(self.parts) for _ in range(p[1] * p[2])]


def _scan(raw: np.ndarray, at: int) -> tuple[np.ndarray, np.ndarray, int]:
    """The scan from ``at`` without stuffing, where its intervals begin in it, and the place after the end marker."""
    marks = np.flatnonzero(raw[at:-1] == 255)
    after = raw[at + 1 + marks]
    ends = marks[(after >= 0xC0) & ((after < 0xD0) | (after > 0xD7))]
    if not len(ends):
        raise ValueError("no end of scan")
    end = int(ends[0])
    marks, after = marks[marks < end], after[: int((marks < end).sum())]
    gone = np.zeros(end, bool)
    gone[marks[after == 0] + 1] = True
    restart = marks[(after >= 0xD0) & (after <= 0xD7)]
    gone[restart] = gone[restart + 1] = True
    kept = np.concatenate(([0], np.cumsum(~gone)))
    begins = np.concatenate(([0], kept[restart], [kept[end]]))
    return raw[at : at + end][~gone], begins, at + end + 2


def decode(files: list[bytes]) -> list[list[tuple[int, int, np.ndarray]]]:
    """For each file its pictures: width, height and DC-only luminance thumbnail (uint8, an eighth of the size)."""
    pictures: list[tuple[int, Picture, int, np.ndarray]] = []
    chunks, lanes, base = [], [], 0
    tables: dict[tuple, int] = {}
    for f, data in enumerate(files):
        raw, at = np.frombuffer(data, np.uint8), 0
        while at < len(data):
            p = Picture(data, at)
            scan, begins, at = _scan(raw, p.scan)
            total = p.wide * p.high
            step = p.interval or total
            if len(begins) - 1 != -(-total // step):
                raise ValueError("restart intervals are missing")
            pattern = tuple((k, tables.setdefault(dc, len(tables)), tables.setdefault(ac, len(tables))) for k, dc, ac in p.blocks)
            mcus = np.minimum(step, total - step * np.arange(len(begins) - 1))
            lanes.append((pattern, 8 * (begins[:-1] + base), mcus, len(pictures)))
            pictures.append((f, p, total, begins))
            chunks.append(scan)
            base += len(scan)
    luts = np.stack([_lookup(*t) for t in tables]) if tables else np.zeros((1, 65536), np.int32)
    stream = np.concatenate([*chunks, np.zeros(8, np.uint8)])
    window = stream[:-3].astype(np.uint32) << 24 | stream[1:-2].astype(np.uint32) << 16 | stream[2:-1].astype(np.uint32) << 8 | stream[3:]
    planes = [np.zeros((p.high * p.v, p.wide * p.h), np.int64) for _, p, _, _ in pictures]
    kinds: dict[tuple, list[int]] = {}
    for k, lane in enumerate(lanes):
        kinds.setdefault(lane[0], []).append(k)
    for pattern, own in kinds.items():
        bit = np.concatenate([lanes[k][1] for k in own])
        mcus = np.concatenate([lanes[k][2] for k in own])
        values = _lanes(window, luts, pattern, bit, mcus)
        row = 0
        for k in own:
            p, n = pictures[k][1], len(lanes[k][1])
            luma = sum(1 for c in pattern if c[0] == 0)
            got = values[row : row + n].reshape(-1, luma)[: pictures[k][2]] if n == 1 or (lanes[k][2][:-1] == values.shape[1]).all() else np.concatenate([values[row + i, : lanes[k][2][i]] for i in range(n)])
            planes[k][:] = got.reshape(p.high, p.wide, p.v, p.h).transpose(0, 2, 1, 3).reshape(p.high * p.v, p.wide * p.h)
            row += n
    out: list[list[tuple[int, int, np.ndarray]]] = [[] for _ in files]
    for (f, p, _, _), plane in zip(pictures, planes, strict=True):
        q = int(p.quant[p.parts[0][3]][0])
        scaled = (plane * q + 4) // 8 + 128 if q % 8 else plane * (q // 8) + 128
        out[f].append((p.width, p.height, np.clip(scaled, 0, 255).astype(np.uint8)[: -(-p.height // 8), : -(-p.width // 8)]))
    return out


def _peek(window: np.ndarray, bit: np.ndarray) -> np.ndarray:
    """The next 25 bits or more, at the top of 32."""
    return window[bit >> 3] << (bit & 7).astype(np.uint32)


def _lanes(window: np.ndarray, luts: np.ndarray, pattern: tuple, bit: np.ndarray, mcus: np.ndarray) -> np.ndarray:
    """DC sums of the luminance blocks, (lanes, MCUs, blocks an MCU); all lanes go forward in step."""
    order = np.argsort(-mcus, kind="stable")
    bit, sizes = bit[order].astype(np.int64), mcus[order]
    luma = [k for k, c in enumerate(pattern) if c[0] == 0]
    out = np.zeros((int(sizes[0]) if len(sizes) else 0, len(luma), len(bit)), np.int16)
    sums = {c[0]: np.zeros(len(bit), np.int32) for c in pattern}
    live = len(bit)
    for m in range(len(out)):
        while live and sizes[live - 1] <= m:
            live -= 1
        for b, (part, dc, ac) in enumerate(pattern):
            here = bit[:live]
            look = _peek(window, here)
            found = luts[dc][look >> 16]
            length, size = found >> 8, found & 255
            if not length.all():
                raise ValueError("a code that the table doesn't have")
            value = ((look << length.astype(np.uint32)) >> np.uint32(1) >> (31 - size).astype(np.uint32)).astype(np.int32)
            value -= np.where((value >> np.maximum(size - 1, 0)) == 0, (1 << size) - 1, 0) * (size > 0)
            sums[part][:live] += value
            here += length + size
            look = _peek(window, here)  # mostly the block ends here
            found = luts[ac][look >> 16]
            ended = (found & 255) == 0
            here += np.where(ended, found >> 8, 0)
            if not ended.all():
                _skip(window, luts[ac], bit, np.flatnonzero(~ended))
            if part == 0:
                out[m, luma.index(b), :live] = sums[0][:live]
    back = np.empty_like(order)
    back[order] = np.arange(len(order))
    return out.transpose(2, 0, 1)[back]


def _skip(window: np.ndarray, lut: np.ndarray, bit: np.ndarray, rows: np.ndarray) -> None:
    """Pass the AC coefficients of the blocks in ``rows``."""
    k = np.ones(len(rows), np.int64)
    while len(rows):
        found = lut[_peek(window, bit[rows]) >> 16]
        length, symbol = found >> 8, found & 255
        if not length.all():
            raise ValueError("a code that the table doesn't have")
        bit[rows] += length + (symbol & 15)
        k = np.where(symbol == 0, 64, k + (symbol >> 4) + 1)
        rows, k = rows[k < 64], k[k < 64]


def hashes(plane: np.ndarray) -> tuple[str, str]:
    """Average hash and difference hash of a thumbnail, 64 bits each, from cell means on an 8 x 8 and an 8 x 9 grid."""
    sums = np.zeros((plane.shape[0] + 1, plane.shape[1] + 1))
    sums[1:, 1:] = plane.cumsum(0, dtype=np.float64).cumsum(1)

    def cells(high: int, wide: int) -> np.ndarray:
        r, c = (np.arange(n + 1) * s / n for n, s in ((high, plane.shape[0]), (wide, plane.shape[1])))
        r0, c0 = np.floor(r[:-1]).astype(int), np.floor(c[:-1]).astype(int)
        r1, c1 = np.maximum(r0 + 1, np.ceil(r[1:]).astype(int)), np.maximum(c0 + 1, np.ceil(c[1:]).astype(int))
        box = sums[r1][:, c1] - sums[r0][:, c1] - sums[r1][:, c0] + sums[r0][:, c0]
        return box / ((r1 - r0)[:, None] * (c1 - c0)[None])

    mean, step = cells(8, 8), cells(8, 9)
    return tuple(np.packbits(x).tobytes().hex() for x in (mean > mean.mean(), step[:, 1:] > step[:, :-1]))


def feature(pictures: list[tuple[int, int, np.ndarray]]) -> str:
    """Dimensions and thumbnail hashes of the pictures together."""
    plane = np.concatenate([t for _, _, t in pictures]) if len({t.shape[1] for _, _, t in pictures}) == 1 else pictures[0][2]
    average, difference = hashes(plane)
    return ",".join(f"{w}x{h}" for w, h, _ in pictures) + f":a{average}:d{difference}"


def _groups(texts: pa.Array) -> Iterator[tuple[int, list[bytes]]]:
    """Raw payloads in groups of bounded size."""
    held, size, first = [], 0, 0
    for k, t in enumerate(texts):
        held.append((t.as_py() or "").encode())
        size += len(held[-1])
        if size >= GROUP_BYTES:
            yield first, held
            held, size, first = [], 0, k + 1
    if held:
        yield first, held


STORED = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def _store(keep_media: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in _groups(batch.column(1)):
                payloads = [t + bytes(-len(t) % ROW or (0 if t else ROW)) for t in texts]
                media, rows = encode(payloads), []
                for text, stored, pictures in zip(texts, media, decode(media), strict=True):
                    back = b"".join(t.tobytes() for _, _, t in pictures)
                    rows.append((len(text), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-ROW:]), len(stored), hashlib.sha256(stored).hexdigest(), feature(pictures)))
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
                cols = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
                ids = batch.column(0).slice(first, len(rows))
                names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
                yield pa.RecordBatch.from_arrays([ids, *cols, *([pa.array(media, pa.binary())] if keep_media else [])], names=names + ["media"] * keep_media)

    return run


def store_texts(docs: DataFrame, text: str = "text", keep_media: bool = False) -> DataFrame:
    """Store each text as pictures and read it back; ``keep_media`` adds the stored bytes."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(_store(keep_media), STORED + ", media binary" * keep_media)


def thumbnails(pictures: DataFrame, key: str, media: str = "media") -> DataFrame:
    """Any baseline JPEG column: ``key``, width, height, average_hash, difference_hash, thumbnail (bytes, row by row).

    A null picture, or one that can't be read, has nulls and says why in ``error``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for m in batch.column(1):
                try:
                    w, h, plane = decode([m.as_py()])[0][0]
                    rows.append((w, h, *hashes(plane), plane.tobytes(), None))
                except (ValueError, IndexError, KeyError, TypeError, struct.error) as e:
                    rows.append((None, None, None, None, None, str(e) or type(e).__name__))
            kinds = [pa.int32(), pa.int32(), pa.string(), pa.string(), pa.binary(), pa.string()]
            cols = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)] if rows else [pa.array([], k) for k in kinds]
            yield pa.RecordBatch.from_arrays([batch.column(0), *cols], names=["key", "width", "height", "average_hash", "difference_hash", "thumbnail", "error"])

    picked = pictures.select(F.col(key).alias("key"), F.col(media).alias("media"))
    kind = dict(picked.dtypes)["key"]
    return picked.mapInArrow(run, f"key {kind}, width int, height int, average_hash string, difference_hash string, thumbnail binary, error string")
