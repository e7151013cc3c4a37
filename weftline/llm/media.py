"""Media columns: bytes stored in baseline JPEGs and read back from their DC coefficients.

``store`` writes each text's payload (UTF-8, zero bytes up to a positive multiple of 64)
as the samples of a greyscale baseline JPEG: one flat 8x8 block for a byte, 64 blocks a
row. The DC quantiser is 8 and there is no AC energy, so the DC coefficient is exactly
the byte less 128 and any JPEG reader shows the payload, eight times enlarged. A restart
interval is one row of blocks. Texts beyond 8191 rows become several images in sequence.

``read`` is a baseline decoder for DC-only luminance thumbnails: it parses the markers,
undoes byte stuffing, Huffman-decodes the scans of all restart intervals of a batch in
lockstep (one lane an interval; AC coefficients are decoded and passed over) and
rebuilds the thumbnail. It reads any greyscale or YCbCr baseline file, not ours alone.

Defined results: a null or empty text is a payload of 64 zero bytes; equal texts give
equal media; ids may be null or repeated; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections import defaultdict
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import binaries, mapped, table
from .textkit import chunks

ROW = 64
#: Bytes handled at once, so that the arrays stay in the CPU's cache.
SLICE = 1 << 18
MOST_ROWS = 8191  # of 8-pixel blocks in an image; JPEG heights have 16 bits
_DC_SYMBOLS = bytes(range(12))
_AC_SYMBOLS = bytes([0x00, 0xF0, 0x01, 0x02, 0x03, 0x04, 0x05, 0x06, 0x07, 0x08, 0x11, 0x12, 0x21, 0x31])


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _huffman(kind: int, symbols: bytes) -> bytes:
    """All codes have four bits: with the category's bits and the end of block at least a byte a sample."""
    return _segment(0xC4, bytes([kind, 0, 0, 0, len(symbols)] + [0] * 12) + symbols)


def header(rows: int) -> bytes:
    frame = struct.pack(">BHHB", 8, rows * 8, ROW * 8, 1) + bytes([1, 0x11, 0])
    return b"".join([
        b"\xff\xd8",
        _segment(0xE0, b"JFIF\0\x01\x01\x00\x00\x01\x00\x01\x00\x00"),
        _segment(0xDB, bytes([0] + [8] + [1] * 63)),
        _segment(0xC0, frame),
        _huffman(0x00, _DC_SYMBOLS),
        _huffman(0x10, _AC_SYMBOLS),
        _segment(0xDD, struct.pack(">H", ROW)),
        _segment(0xDA, bytes([1, 1, 0x00, 0, 63, 0])),
    ])


_HEADER = np.frombuffer(header(1), np.uint8)
_HEIGHT_AT = header(0x1FFF).index(b"\xff\xf8")


def _code_table() -> tuple[np.ndarray, np.ndarray]:
    """For a difference + 255: its Huffman code, category bits and end of block, and their length."""
    d = np.arange(-255, 256)
    category = np.where(d == 0, 0, np.floor(np.log2(np.maximum(np.abs(d), 1))).astype(int) + 1)
    bits = np.where(d < 0, d + (1 << category) - 1, d)
    return (((category << category) + bits) << 4).astype(np.uint32), (8 + category).astype(np.int64)


_CODE, _LENGTH = _code_table()


def encode(payload: np.ndarray, rows_of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """JPEGs of payloads laid end to end; ``rows_of``: how many rows of 64 bytes each has.

    Returns all files' bytes and the size of each file.
    """
    x = payload.reshape(-1, ROW).astype(np.int32) - 128
    n = len(x)
    diff = np.diff(x, axis=1, prepend=0) + 255
    length = _LENGTH[diff]
    ends = np.cumsum(length, axis=1)
    row_bytes = (ends[:, -1] + 7) >> 3
    row_at = np.concatenate([[0], np.cumsum(row_bytes)])
    at = (row_at[:-1, None] * 8 + ends - length).ravel()
    value = _CODE[diff].ravel() << (24 - length.ravel() - (at & 7)).astype(np.uint32)
    raw = np.zeros(row_at[-1] + 3, np.uint8)
    to = at >> 3  # no two samples begin in one byte, so each of the three steps writes a byte once
    raw[to] = value >> np.uint32(16)
    for shift in (8, 0):
        to += 1
        raw[to] |= (value >> np.uint32(shift)).astype(np.uint8)
    spare = row_bytes * 8 - ends[:, -1]
    raw[row_at[1:] - 1] |= ((1 << spare) - 1).astype(np.uint8)
    raw = raw[: row_at[-1]]
    # where each image begins: at a file's first row and after each MOST_ROWS rows
    file_row = np.concatenate([[0], np.cumsum(rows_of)])
    inner = np.arange(n) - np.repeat(file_row[:-1], rows_of)
    first = inner % MOST_ROWS == 0
    image = np.cumsum(first)  # 1-based
    full = raw == 0xFF
    before = np.cumsum(full) - full
    row = np.repeat(np.arange(n), row_bytes)
    to = np.arange(len(raw)) + before + 2 * row + len(_HEADER) * image[row]
    stuffed = np.add.reduceat(full, row_at[:-1]) if n else np.zeros(0, int)
    size_row = row_bytes + stuffed + 2 + len(_HEADER) * first
    row_end = np.cumsum(size_row)
    out = np.zeros(row_end[-1], np.uint8)
    out[to] = raw
    last = np.append(first[1:], True)
    out[row_end - 2] = 0xFF
    out[row_end - 1] = np.where(last, 0xD9, 0xD0 + (inner % MOST_ROWS) % 8)
    begin = (row_end - size_row)[first]
    out[begin[:, None] + np.arange(len(_HEADER))] = _HEADER
    height = np.bincount(image - 1) * 8
    out[begin + _HEIGHT_AT], out[begin + _HEIGHT_AT + 1] = height >> 8, height & 255
    file_end = row_end[file_row[1:] - 1]
    return out, np.diff(file_end, prepend=0)


@dataclass
class Frame:
    """An image as its markers describe it; ``scan`` is the range of its entropy-coded bytes."""

    width: int = 0
    height: int = 0
    restart: int = 0
    components: list = field(default_factory=list)  # (id, h, v, quantiser)
    quantiser: dict = field(default_factory=dict)
    tables: dict = field(default_factory=dict)
    chosen: list = field(default_factory=list)  # (component's index, DC table, AC table)
    scan: tuple[int, int] = (0, 0)


def parse(data: bytes, markers: np.ndarray, base: int, end: int) -> list[Frame]:
    """Frames in ``data[base:end]``; ``markers``: places of an 0xFF that begins a marker other than RST."""
    found, at = [], base
    while at < end:
        if data[at : at + 2] != b"\xff\xd8":
            raise ValueError("not a JPEG: no start of image")
        f, at = Frame(), at + 2
        while True:
            marker = data[at + 1]
            if data[at] != 0xFF:
                raise ValueError("a marker was expected")
            size = struct.unpack_from(">H", data, at + 2)[0]
            body = data[at + 4 : at + 2 + size]
            at += 2 + size
            if marker == 0xDB:
                while body:
                    wide = body[0] >> 4
                    f.quantiser[body[0] & 15] = struct.unpack_from(">H", body, 1)[0] if wide else body[1]
                    body = body[1 + 64 * (1 + wide) :]
            elif marker == 0xC4:
                while body:
                    n = sum(body[1:17])
                    f.tables[body[0]] = bytes(body[1 : 17 + n])
                    body = body[17 + n :]
            elif marker == 0xC0:
                _, f.height, f.width, n = struct.unpack_from(">BHHB", body)
                f.components = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)]
            elif 0xC1 <= marker <= 0xCF:
                raise ValueError("only baseline JPEG is read")
            elif marker == 0xDD:
                f.restart = struct.unpack(">H", body)[0]
            elif marker == 0xDA:
                ids = [c[0] for c in f.components]
                f.chosen = [(ids.index(body[1 + 2 * i]), body[2 + 2 * i] >> 4, body[2 + 2 * i] & 15) for i in range(body[0])]
                if len(f.chosen) != len(f.components):
                    raise ValueError("only one scan with all components is read")
                stop = int(markers[np.searchsorted(markers, at)])
                f.scan = (at, stop)
                if data[stop + 1] != 0xD9:
                    raise ValueError("only one scan an image is read")
                at = stop + 2
                break
        found.append(f)
    return found


def lookup(table_bytes: bytes, width: int) -> np.ndarray:
    """For the next ``width`` bits: symbol + 256 * code length; 0 where no code fits."""
    out = np.zeros(1 << width, np.uint64)
    code, at = 0, 16
    for length in range(1, width + 1):
        for _ in range(table_bytes[length - 1]):
            out[code << (width - length) : (code + 1) << (width - length)] = table_bytes[at] + 256 * length
            code, at = code + 1, at + 1
        code <<= 1
    return out


def dc_planes(data: np.ndarray, frames: list[Frame]) -> list[np.ndarray]:
    """DC coefficients of the first component of each frame, as a blocks' grid. Frames share tables and shape of MCU."""
    f0 = frames[0]
    plan = [(i, f0.components[i][1] * f0.components[i][2] if len(f0.chosen) > 1 else 1, dc, ac) for i, dc, ac in f0.chosen]
    longest = max(n for v in f0.tables.values() for n in range(1, 17) if v[n - 1])
    codes, drop = {k: lookup(v, longest) for k, v in f0.tables.items()}, np.uint64(64 - longest)
    lanes, counts, sizes, raw_parts, at = [], [], [], [], 0
    grids = []
    for f in frames:
        h, v = (f.components[0][1], f.components[0][2]) if len(f.chosen) > 1 else (1, 1)
        top_h, top_v = (max(c[1] for c in f.components), max(c[2] for c in f.components)) if len(f.chosen) > 1 else (1, 1)
        wide, high = -(-f.width // (8 * top_h)), -(-f.height // (8 * top_v))
        mcus = wide * high
        part = data[f.scan[0] : f.scan[1]]
        follows = np.append(part[1:], 0)
        full = np.flatnonzero(part == 0xFF)
        rst = (follows[full] >= 0xD0) & (follows[full] <= 0xD7)
        cut = full[rst]
        gone = np.sort(np.concatenate([full[follows[full] == 0] + 1, cut, cut + 1]))
        begins = np.concatenate([[0], cut + 2 - np.searchsorted(gone, cut + 2)])
        step = f.restart or mcus
        n = -(-mcus // step)
        if n != len(begins):
            raise ValueError("restart markers don't match the image's size")
        lanes.append(begins + at)
        counts.append(np.minimum(step, mcus - step * np.arange(n)))
        clean = np.delete(part, gone)
        raw_parts.append(clean)
        at += len(clean)
        sizes.append(n)
        grids.append((wide, high, h, v, step))
    clean = np.concatenate([*raw_parts, np.full(16, 0xFF, np.uint8)])
    window = np.zeros(len(clean) - 8, np.uint64)
    for k in range(8):
        window = (window << np.uint64(8)) | clean[k : len(clean) - 8 + k].astype(np.uint64)
    pos, left = np.concatenate(lanes) * 8, np.concatenate(counts)
    limit = np.uint64((len(window) - 1) * 8)
    per, u8 = plan[0][1], np.uint64
    out = np.zeros((int(left.max()) * per, len(pos)), np.int32)
    all_of = int(left.min())
    last = {i: np.zeros(len(pos), np.int64) for i, *_ in plan}
    pos, worst = pos.astype(u8), np.uint64(1)
    for m in range(int(left.max())):
        on = slice(None) if all_of > m else np.flatnonzero(left > m)
        p = pos[on]
        for i, blocks, dc, ac in plan:
            for b in range(blocks):
                # one load holds the DC code, its bits and the first AC code: 43 bits at most
                bits = window.take((p >> u8(3)).view(np.int64)) << (p & u8(7))
                got = codes[dc].take((bits >> drop).view(np.int64))
                size, length = got & u8(255), got >> u8(8)
                bits <<= length
                value = (bits >> u8(1)) >> (u8(63) - size)
                value -= ((u8(1) << size) - u8(1)) * ((bits >> u8(63)) ^ u8(1))  # a first bit 0 means a negative value
                value = value.view(np.int64)
                bits <<= size
                now = last[i][on] + value
                last[i][on] = now
                if i == plan[0][0]:
                    out[m * per + b, on] = now
                first = codes[0x10 | ac].take((bits >> drop).view(np.int64))
                worst = min(worst, got.min(), first.min())
                p += length + size + (first >> u8(8)) + (first & u8(15))
                # further AC coefficients: passed over, to the end of each block
                symbol = first & u8(255)
                busy = np.flatnonzero(symbol)
                k = (symbol[busy] >> u8(4)) + u8(1)
                busy, k = busy[k < 63], k[k < 63]
                while len(busy):
                    q = np.minimum(p[busy], limit)
                    got = codes[0x10 | ac][((window[(q >> u8(3)).view(np.int64)] << (q & u8(7))) >> drop).view(np.int64)]
                    worst = min(worst, got.min())
                    p[busy] += (got >> u8(8)) + (got & u8(15))
                    symbol = got & u8(255)
                    k += (symbol >> u8(4)) + u8(1)
                    go = (symbol != 0) & (k < 63)
                    busy, k = busy[go], k[go]
        pos[on] = np.minimum(p, limit)
    if not worst:
        raise ValueError("a code that no Huffman table has")
    out = np.ascontiguousarray(out.T)
    planes, at = [], 0
    for n, count, (wide, high, h, v, _) in zip(sizes, counts, grids, strict=True):
        lane = out[at : at + n]
        flat = lane[np.arange(lane.shape[1])[None, :] < (count * per)[:, None]]
        planes.append(flat.reshape(high, wide, v, h).transpose(0, 2, 1, 3).reshape(high * v, wide * h))
        at += n
    return planes


def thumbnails(data: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> list[tuple[list[Frame], np.ndarray]]:
    """For each file: its frames, and the DC-only luminance thumbnail of all its frames, one below the other."""
    raw = data.tobytes()
    markers = np.flatnonzero(data == 0xFF)
    follows = np.append(data, 0)[markers + 1]
    markers = markers[(follows != 0) & ~((follows >= 0xD0) & (follows <= 0xD7))]
    files = [parse(raw, markers, int(a), int(b)) for a, b in zip(begins, ends, strict=True)]
    alike = defaultdict(list)
    for i, frames in enumerate(files):
        for j, f in enumerate(frames):
            alike[tuple(sorted(f.tables.items())), tuple(f.components), tuple(f.chosen)].append((i, j, f))
    parts: dict = defaultdict(dict)
    for same in alike.values():
        for (i, j, f), plane in zip(same, dc_planes(data, [f for *_, f in same]), strict=True):
            q = f.quantiser[f.components[0][3]]
            parts[i][j] = np.clip(plane * q / 8 + 128.5, 0, 255).astype(np.uint8)[: -(-f.height // 8), : -(-f.width // 8)]
    return [(frames, np.concatenate([parts[i][j] for j in range(len(frames))])) for i, frames in enumerate(files)]


def average_hash(thumb: np.ndarray) -> str:
    """64 bits, as hex: which cells of an 8x8 grid are brighter than all on average. Small sides repeat cells."""
    sides = [np.minimum(np.arange(8) * n // 8, n - 1) for n in thumb.shape]
    wide = [np.maximum(np.append(s[1:], n) - s, 1) for s, n in zip(sides, thumb.shape, strict=True)]
    sums = np.add.reduceat(np.add.reduceat(thumb, sides[0], 0, np.int64), sides[1], 1)
    cells = sums / (wide[0][:, None] * wide[1])
    return np.packbits(cells > cells.mean()).tobytes().hex()


def _store(batch: pa.RecordBatch):
    for c in chunks(batch.column(1), SLICE):
        size = (c.ends - c.begins).astype(np.int64)
        rows = np.maximum(1, -(-size // ROW))
        to = np.concatenate([[0], np.cumsum(rows)]) * ROW
        payload = np.zeros(to[-1], np.uint8)
        payload[np.arange(len(c.data)) + np.repeat(to[:-1] - c.begins, size)] = c.data
        media, sizes = encode(payload, rows)
        ends = np.cumsum(sizes)
        yield {"id": batch.column(0).slice(c.first, c.rows), "n_bytes": size, "media": binaries(media, ends - sizes, ends)}


def _read(batch: pa.RecordBatch):
    for c in chunks(batch.column(2), SLICE):
        rows = []
        for (frames, thumb), a, b in zip(thumbnails(c.data, c.begins, c.ends), c.begins, c.ends, strict=True):
            samples = thumb.tobytes()
            width, height = max(f.width for f in frames), sum(f.height for f in frames)
            code = average_hash(thumb)
            rows.append((len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-64:]), int(b - a), hashlib.sha256(c.data[a:b]).hexdigest(), f"{width}x{height}:{code}", width, height, code))
        names = ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "width", "height", "thumb_hash")
        yield {"doc_id": batch.column(0).slice(c.first, c.rows), "n_bytes": batch.column(1).slice(c.first, c.rows)} | dict(zip(names, map(list, zip(*rows, strict=True)), strict=True))


def store(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_bytes and the media column: a JPEG that holds the padded text."""
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return mapped(rows, _store, "id long, n_bytes long, media binary")


def read(media: DataFrame) -> DataFrame:
    """Dimensions, thumbnail hash and digests of what the media column's bytes decode to."""
    return mapped(
        media, _read,
        "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, width long, height long, thumb_hash string",
    )


def op1_media(spark, sf_dir: str) -> DataFrame:
    return read(store(table(spark, sf_dir, "documents")))


def media_payloads(spark, sf_dir: str) -> DataFrame:
    """The columns of op1_media that SQL can express."""
    return op1_media(spark, sf_dir).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256")


PAYLOADS_SQL = """
WITH b AS (SELECT doc_id, encode(coalesce(text, '')) AS raw FROM documents),
s AS (SELECT doc_id, raw, octet_length(raw) AS n, CASE WHEN octet_length(raw) = 0 THEN 64 ELSE (64 - octet_length(raw) % 64) % 64 END AS more FROM b)
SELECT doc_id, n::BIGINT AS n_bytes, (n + more)::BIGINT AS payload_bytes, sha256(raw || repeat(chr(0), more)::BLOB) AS payload_sha256 FROM s
"""
