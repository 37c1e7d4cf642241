"""Media columns as baseline JPEG files whose quantised coefficients hold a payload without loss.

Writing. A payload is padded to whole units of 192 bytes: one MCU of three 8x8 blocks (Y, Cb, Cr,
no subsampling). Byte b becomes the coefficient b - 128 for b < 128 and b - 127 otherwise, so no
coefficient is zero and no run lengths arise; quantisation tables are all ones. The two Huffman
tables give size s (1 to 8) a code of 9 - s bits, so each coefficient takes 9 bits with its extra
bits and an MCU takes 216 bytes. A restart marker follows each MCU.

Reading. Markers are parsed from the bytes; restart intervals of all images of a batch are decoded
side by side: one numpy step decodes one coefficient in every interval, by a table look-up on the
next 16 bits. The decoder takes any Huffman tables, runs and sampling-free baseline scan with one or
three components; it doesn't rely on the writer's fixed widths. A DC-only luminance thumbnail (one
pixel per block) is rebuilt from the Y blocks' DC terms and hashed.

Edge cases: null is taken as empty, and an empty payload is one unit of blanks; images wider than
one MCU arise where a column would exceed 65,535 lines, filled up with blank MCUs; the number of
payload bytes stands in a comment segment. Equal payloads give equal files. Repeated
rows and rows without an id each get a file; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidewright.llm.spark_io import id_and_text
from tidewright.llm.text import raw, slices

UNIT, SIDE, MAX_LINES = 192, 8, 8191
#: Restart intervals coded or decoded side by side, so that a long text needs few times its size of memory.
LANES = 1 << 14
#: Fixed values of the JPEG format: scan order of an 8x8 block.
ZIGZAG = np.array(sorted(range(64), key=lambda i: (i // 8 + i % 8, (i // 8) if (i // 8 + i % 8) % 2 else i % 8)), np.int64)
_TAG = b"payload "


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _huffman(kind: int) -> bytes:
    """Size 8 has a code of one bit, size 1 of eight bits; the code of all ones stays free."""
    return bytes([kind << 4]) + bytes([1] * 8 + [0] * 8) + bytes(range(8, 0, -1))


def _code_of_byte() -> np.ndarray:
    b = np.arange(256)
    v = np.where(b < 128, b - 128, b - 127)
    size = np.array([int(abs(x)).bit_length() for x in v])
    extra = np.where(v > 0, v, v + (1 << size) - 1)
    prefix = (1 << (8 - size)) - 1 << 1  # 8 - size ones, then a zero: 9 - size bits
    return ((prefix << size) | extra).astype(np.uint16)


_CODE = _code_of_byte()
_CODE_BITS = ((_CODE[:, None] >> np.arange(8, -1, -1)) & 1).astype(np.uint8)
_TABLES = b"".join(_segment(0xDB, bytes([k]) + bytes([1] * 64)) for k in (0, 1)) + _segment(0xC4, _huffman(0)) + _segment(0xC4, _huffman(1))
_SCAN = _segment(0xDA, bytes([3, 1, 0x00, 2, 0x00, 3, 0x00, 0, 63, 0]))


def grid(units: int) -> tuple[int, int]:
    across = -(-units // MAX_LINES)
    return across, -(-units // across)


def encode_batch(payloads: list[bytes | np.ndarray], real: list[int]) -> list[bytes]:
    """JPEG files of payloads, each a positive multiple of 192 bytes; real: bytes before padding."""
    out = []
    for p, n in zip(payloads, real, strict=True):
        own = np.frombuffer(p, np.uint8)
        across, down = grid(len(own) // UNIT)
        if (fill := across * down * UNIT - len(own)) > 0:
            own = np.concatenate([own, np.full(fill, 32, np.uint8)])
        units = own.reshape(-1, UNIT)
        mcus = np.concatenate([np.packbits(_CODE_BITS[units[lo : lo + LANES]].reshape(-1, UNIT * 9), axis=1) for lo in range(0, len(units), LANES)])
        restart = np.empty((len(mcus), 2), np.uint8)
        restart[:, 0] = 0xFF
        restart[:, 1] = 0xD0 + np.arange(len(mcus)) % 8
        stream = np.concatenate([mcus, restart], axis=1).ravel()[:-2]
        stuffed = stream == 0xFF
        stuffed[216::218] = False
        at = np.flatnonzero(stuffed)
        stream = np.insert(stream, at + 1, 0)
        frame = _segment(0xC0, struct.pack(">BHHB", 8, down * SIDE, across * SIDE, 3) + bytes([1, 0x11, 0, 2, 0x11, 1, 3, 0x11, 1]))
        head = b"\xff\xd8" + _segment(0xFE, _TAG + struct.pack(">QQ", n, len(p))) + _TABLES + frame + _segment(0xDD, struct.pack(">H", 1)) + _SCAN
        out.append(head + stream.tobytes() + b"\xff\xd9")
    return out


class Header:
    """What the markers of one file say."""

    def __init__(self, data: bytes):
        if data[:2] != b"\xff\xd8":
            raise ValueError("not a JPEG file")
        self.tables: dict[int, bytes] = {}
        self.quant: dict[int, np.ndarray] = {}
        self.interval, self.real, self.payload = 0, None, None
        at = 2
        while True:
            marker, size = data[at + 1], struct.unpack_from(">H", data, at + 2)[0]
            body = data[at + 4 : at + 2 + size]
            at += 2 + size
            if marker == 0xC0:
                self.height, self.width, n = struct.unpack_from(">xHHB", body)
                self.components = {body[6 + 3 * i]: (body[7 + 3 * i], body[8 + 3 * i]) for i in range(n)}
                if any(s != 0x11 for s, _ in self.components.values()):
                    raise ValueError("subsampled components are not read here")
            elif 0xC1 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
                raise ValueError("only baseline files are read")
            elif marker == 0xDB:
                while body:
                    wide = body[0] >> 4
                    self.quant[body[0] & 15] = np.frombuffer(body, ">u2" if wide else np.uint8, 64, 1).astype(np.int64)
                    body = body[1 + 64 * (1 + wide) :]
            elif marker == 0xC4:
                while body:
                    n = sum(body[1:17])
                    self.tables[body[0]] = body[1 : 17 + n]
                    body = body[17 + n :]
            elif marker == 0xDD:
                self.interval = struct.unpack(">H", body)[0]
            elif marker == 0xFE and body.startswith(_TAG):
                self.real, self.payload = struct.unpack_from(">QQ", body, len(_TAG))
            elif marker == 0xDA:
                self.order = [(body[1 + 2 * i], body[2 + 2 * i]) for i in range(body[0])]
                self.start = at
                break
        self.mcus = -(-self.width // SIDE) * -(-self.height // SIDE)

    def key(self) -> tuple:
        return tuple((self.tables[t >> 4], self.tables[0x10 | t & 15]) for _, t in self.order)


_lookups: dict[bytes, np.ndarray] = {}


def _lookup(table: bytes) -> np.ndarray:
    """For each 16 bits that begin with a code: (value + 32768) << 20 | run << 12 | size << 8 | bits.

    bits counts code and extra bits where both fit into the 16, and the code alone otherwise (then
    value is -32768 and the extra bits are still to be read). 0 where no code fits.
    """
    if table not in _lookups:
        out = np.zeros(1 << 16, np.int64)
        code, k = 0, 16
        for length in range(1, 17):
            for _ in range(table[length - 1]):
                run, size = table[k] >> 4, table[k] & 15
                here = np.arange(code << (16 - length), (code + 1) << (16 - length))
                if length + size <= 16:
                    v = (here >> (16 - length - size)) & ((1 << size) - 1)
                    v = np.where(v < (1 << size) >> 1, v - (1 << size) + 1, v)
                    out[here] = (v + 32768) << 20 | run << 12 | size << 8 | (length + size)
                else:
                    out[here] = run << 12 | size << 8 | length
                code, k = code + 1, k + 1
            code <<= 1
        _lookups[table] = out
    return _lookups[table]


def _lanes(data: np.ndarray, head: Header) -> list[np.ndarray]:
    """Restart intervals of the scan, without stuffed zeros."""
    own = data[head.start :]
    ff = np.flatnonzero(own[:-1] == 0xFF)
    after = own[ff + 1]
    end = ff[np.flatnonzero((after != 0) & ((after < 0xD0) | (after > 0xD7)))[0]]
    marks = ff[(after >= 0xD0) & (after <= 0xD7) & (ff < end)]
    zeros = ff[(after == 0) & (ff < end)] + 1
    keep = np.ones(end, bool)
    keep[zeros] = keep[marks] = keep[marks + 1] = False
    ends = np.append(marks, end)
    gone = np.cumsum(~keep)
    length = ends - gone[np.maximum(ends - 1, 0)]
    return np.split(own[:end][keep], length[:-1])


def decode_coefficients(stream: np.ndarray, starts: np.ndarray, mcus: np.ndarray, key: tuple) -> np.ndarray:
    """Coefficients in scan order, [lane, MCU, component, 64]; DC terms are undone.

    stream: bytes of all lanes, with room of at least 8 bytes after the last; starts: of each lane.
    """
    most = int(mcus.max())
    out = np.zeros((len(starts), most, len(key), 64), np.int16)
    bit = starts.astype(np.int64) * 8
    predicted = np.zeros((len(starts), len(key)), np.int64)
    flat = out.reshape(-1)
    quad = (stream[:-3].astype(np.int64) << 24) | (stream[1:-2].astype(np.int64) << 16) | (stream[2:-1].astype(np.int64) << 8) | stream[3:]

    def read(table: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Packed symbols at bit places b, their values, and the places after them."""
        got = table[(quad[b >> 3] >> (16 - (b & 7))) & 0xFFFF]
        b = b + (got & 255)
        v = (got >> 20) - 32768
        long = np.flatnonzero(v == -32768)
        if len(long):
            size, at = (got[long] >> 8) & 15, b[long]
            x = (quad[at >> 3] >> (32 - size - (at & 7))) & ((1 << size) - 1)
            v[long] = np.where(x < (1 << size) >> 1, x - (1 << size) + 1, x)
            b[long] += size
        return got, v, b

    for m in range(most):
        live = np.flatnonzero(mcus > m)
        for c, (dc, ac) in enumerate(key):
            base = ((live * most + m) * len(key) + c) * 64
            _, v, b = read(_lookup(dc), bit[live])
            predicted[live, c] += v
            flat[base] = predicted[live, c]
            table = _lookup(ac)
            lane, at, now = np.arange(len(live)), base + 1, b
            while len(lane):
                got, v, now = read(table, now)
                if (got & 0xF000).any():
                    at = at + ((got >> 12) & 15)
                some = (got & 0xF00) != 0
                if some.all():
                    flat[at] = v
                    done = (at & 63) == 63
                else:
                    flat[at[some]] = v[some]
                    done = ((at & 63) == 63) | ((got & 0xFF00) == 0)
                at = at + 1
                if done.any():
                    b[lane[done]] = now[done]
                    left = ~done
                    lane, at, now = lane[left], at[left], now[left]
            bit[live] = b
    return out


def decode_batch(files: list[bytes]) -> list[tuple[Header, np.ndarray]]:
    """Headers and coefficients [MCU, component, 64 in scan order] of files, decoded side by side."""
    heads = [Header(f) for f in files]
    out: list = [None] * len(files)
    for key in dict.fromkeys(h.key() for h in heads):
        own = [i for i, h in enumerate(heads) if h.key() == key]
        lanes, count, first = [], [], []
        for i in own:
            h, got = heads[i], _lanes(np.frombuffer(files[i], np.uint8), heads[i])
            first.append(len(lanes))
            lanes += got
            step = h.interval or h.mcus
            count += [min(step, h.mcus - j * step) for j in range(len(got))]
        got = np.zeros((len(lanes), max(count), len(key), 64), np.int16)
        for lo in range(0, len(lanes), LANES):
            some = lanes[lo : lo + LANES]
            sizes = np.array([len(x) for x in some], np.int64)
            stream = np.concatenate([*some, np.full(16, 255, np.uint8)])
            part = decode_coefficients(stream, np.cumsum(sizes) - sizes, np.array(count[lo : lo + LANES]), key)
            got[lo : lo + LANES, : part.shape[1]] = part
        for i, a, b in zip(own, first, [*first[1:], len(lanes)], strict=True):
            out[i] = (heads[i], got[a:b].reshape(-1, len(key), 64)[: heads[i].mcus] if got.shape[1] > 1 and b - a > 1 else got[a:b].reshape(-1, len(key), 64)[: heads[i].mcus])
    return out


def payload_of(head: Header, coefficients: np.ndarray) -> bytes:
    v = coefficients.reshape(-1)
    return np.where(v < 0, v + 128, v + 127).astype(np.uint8)[: head.payload].tobytes()


def thumbnail(head: Header, coefficients: np.ndarray) -> np.ndarray:
    """One luminance pixel per block, from DC terms alone."""
    q = int(head.quant[head.components[head.order[0][0]][1]][0])
    pixels = np.clip(np.round(coefficients[:, 0, 0] * (q / 8.0)) + 128, 0, 255).astype(np.uint8)
    return pixels.reshape(-(-head.height // SIDE), -(-head.width // SIDE))


def thumbnail_hash(pixels: np.ndarray) -> str:
    """64 bits: which of 64 equal stretches of the thumbnail, read in rows, are brighter than their mean."""
    flat = pixels.reshape(-1).astype(np.float64)
    edges = np.linspace(0, len(flat), 65)
    sums = np.append(0.0, np.cumsum(flat))
    means = np.diff(np.interp(edges, np.arange(len(sums)), sums)) / np.diff(edges)
    return f"{int(''.join('1' if x else '0' for x in means > means.mean()), 2):016x}"


def _write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text", 2 << 20):
            data, off = raw(part.column("text"))
            real = np.diff(off).tolist()
            padded = [data[off[r] : off[r + 1]].tobytes().ljust(max(1, -(-n // UNIT)) * UNIT, b" ") for r, n in enumerate(real)]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(encode_batch(padded, real), pa.binary())], ["doc_id", "media"])


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "media", 2 << 20):
            files = part.column("media").to_pylist()
            rows = {c: [] for c in ("n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")}
            for f, (head, got) in zip(files, decode_batch(files), strict=True):
                payload = payload_of(head, got)
                pixels = thumbnail(head, got)
                rows["n_bytes"].append(head.real)
                rows["payload_bytes"].append(len(payload))
                rows["payload_sha256"].append(hashlib.sha256(payload).hexdigest())
                rows["tail_crc32"].append(zlib.crc32(payload[-16:]))
                rows["media_bytes"].append(len(f))
                rows["media_sha256"].append(hashlib.sha256(f).hexdigest())
                rows["feature"].append(f"{head.width}x{head.height}:{thumbnail_hash(pixels)}")
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(v, pa.string() if isinstance(v[0], str) else pa.int64()) for v in rows.values())], ["doc_id", *rows])


def to_media(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and media: the text's bytes as a JPEG file."""
    return id_and_text(docs, id_col, text_col).mapInArrow(_write, "doc_id long, media binary")


def read_media(media: DataFrame) -> DataFrame:
    """Payload digests and features of the files in column media, read back from their bytes."""
    return media.select("doc_id", "media").mapInArrow(_read, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
