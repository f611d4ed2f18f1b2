"""Media columns of baseline JPEG: lossless payload storage, parsing, DC thumbnails, hashes.

Storage.  A JPEG's pixels are lossy but its quantised coefficients are not, so a
payload is kept as coefficients: 64 bytes make one 8x8 block in zigzag order.  A
block's first byte is its DC coefficient (byte - 128, with quantiser 8, so that the
block's mean luminance is the byte); the others are AC coefficients, byte + 1 below
128 and byte - 256 from there, which is never zero, so that no zero runs occur.  The
Huffman tables give size s a code of 9 - s bits, so code and magnitude always take 9
bits together and a block takes 72 bytes; a reader that finds such tables can decode
all blocks at once in numpy.  Any other baseline scan is decoded bit by bit.

Null and empty texts become one block of zeros.  Equal texts have equal files, hashes
and features.  Rows are independent; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: The zigzag order of ITU-T T.81, figure 5 (place in the block of each coefficient).
ZIGZAG = np.array([
    0, 1, 8, 16, 9, 2, 3, 10, 17, 24, 32, 25, 18, 11, 4, 5, 12, 19, 26, 33, 40, 48, 41, 34, 27, 20, 13, 6, 7, 14, 21, 28,
    35, 42, 49, 56, 57, 50, 43, 36, 29, 22, 15, 23, 30, 37, 44, 51, 58, 59, 52, 45, 38, 31, 39, 46, 53, 60, 61, 54, 47, 55, 62, 63,
])
WORD = 9
MOST_ROWS = 8191  # blocks; a JPEG is 65535 pixels high at most


def _word(value: int) -> int:
    """Code and magnitude bits of a coefficient, together nine bits."""
    size = abs(value).bit_length()
    ones = WORD - 1 - size
    prefix = ((1 << ones) - 1) << 1
    return prefix << size | (value if value >= 0 else value + (1 << size) - 1)


_AC_VALUE = np.where(np.arange(256) < 128, np.arange(256) + 1, np.arange(256) - 256)
_AC_WORD = np.array([_word(int(v)) for v in _AC_VALUE], np.uint16)
_DC_WORD = np.array([_word(d) for d in range(-255, 256)], np.uint16)
_VALUE = np.zeros(1 << WORD, np.int16)  # of a nine-bit word
for _d in range(-255, 256):
    _VALUE[_word(_d)] = _d


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _huffman_body(kind: int, sizes: list[int]) -> bytes:
    """A table in which size s has a code of nine minus s bits."""
    counts = bytearray(16)
    for s in sizes:
        counts[WORD - s - 1] += 1
    return bytes([kind << 4]) + bytes(counts) + bytes(sorted(sizes, reverse=True))


_HEAD = b"\xff\xd8" + _segment(0xE0, b"JFIF\0\1\1\0\0\1\0\1\0\0") + _segment(0xDB, b"\0" + bytes([8] + [1] * 63))
_TABLES = _segment(0xC4, _huffman_body(0, list(range(9)))) + _segment(0xC4, _huffman_body(1, list(range(1, 9))))
_SCAN = _segment(0xDA, b"\1\1\0\0\x3f\0")


def padded(text: str | None) -> tuple[int, bytes]:
    """Bytes of the text, and the payload: zeros up to a positive multiple of 64."""
    data = (text or "").encode("utf-8")
    return len(data), data + bytes(-len(data) % 64 if data else 64)


def store(payload: bytes) -> bytes:
    """The payload (a positive multiple of 64 bytes) as a baseline JPEG of one component."""
    n = len(payload) // 64
    columns = -(-n // MOST_ROWS)
    rows = -(-n // columns)
    block = np.zeros((columns * rows, 64), np.uint8)
    block.reshape(-1)[: len(payload)] = np.frombuffer(payload, np.uint8)
    words = _AC_WORD[block]
    words[:, 0] = _DC_WORD[np.diff(block[:, 0].astype(np.int16) - 128, prepend=np.int16(0)) + 255]
    eight = words.reshape(-1, 8)
    out = np.empty((len(eight), 9), np.uint8)
    for k in range(9):
        byte = eight[:, k] >> (k + 1) if k < 8 else np.zeros(len(eight), np.uint16)
        if k:
            byte = byte | eight[:, k - 1] << (8 - k)
        out[:, k] = byte & 0xFF
    frame = _segment(0xC0, struct.pack(">BHHB", 8, rows * 8, columns * 8, 1) + b"\1\x11\0")
    note = _segment(0xFE, b"blocks %d" % n)
    return _HEAD + note + frame + _TABLES + _SCAN + out.tobytes().replace(b"\xff", b"\xff\0") + b"\xff\xd9"


class Jpeg:
    """A parsed baseline JPEG; ``coefficients`` has an array (blocks, 64) per component, in zigzag order."""

    def __init__(self, data: bytes):
        if data[:2] != b"\xff\xd8":
            raise ValueError("no JPEG")
        self.width = self.height = self.restart = 0
        self.note = b""
        self.quantiser: dict[int, np.ndarray] = {}
        self.tables: dict[tuple[int, int], dict[tuple[int, int], int]] = {}
        self.components: list[list[int]] = []  # id, horizontal and vertical sampling, quantiser
        self.coefficients: dict[int, np.ndarray] = {}
        self.grid: dict[int, tuple[int, int]] = {}  # blocks down and across
        at = 2
        while at < len(data):
            if data[at] != 0xFF:
                raise ValueError("a marker is missing")
            marker, at = data[at + 1], at + 2
            if marker == 0xFF:
                at -= 1
                continue
            if marker == 0xD9:
                return
            if 0xD0 <= marker <= 0xD7 or marker == 0x01:
                continue
            length = struct.unpack_from(">H", data, at)[0]
            body, at = data[at + 2 : at + length], at + length
            if marker == 0xFE:
                self.note = body
            elif marker == 0xDB:
                self._quantisers(body)
            elif marker == 0xC4:
                self._huffman(body)
            elif marker == 0xC0:
                _, self.height, self.width, n = struct.unpack_from(">BHHB", body)
                self.components = [[body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]] for i in range(n)]
            elif 0xC1 <= marker <= 0xCF and marker not in (0xC8, 0xCC):
                raise ValueError("only baseline frames are read")
            elif marker == 0xDD:
                self.restart = struct.unpack(">H", body)[0]
            elif marker == 0xDA:
                end = self._scan_end(data, at)
                self._scan(body, data[at:end])
                at = end

    def _quantisers(self, body: bytes) -> None:
        while body:
            wide, number = body[0] >> 4, body[0] & 15
            size = 128 if wide else 64
            self.quantiser[number] = np.frombuffer(body[1 : 1 + size], ">u2" if wide else np.uint8).astype(np.int32)
            body = body[1 + size :]

    def _huffman(self, body: bytes) -> None:
        while body:
            counts, symbols, code, table = body[1:17], iter(body[17:]), 0, {}
            for length, count in enumerate(counts, 1):
                for _ in range(count):
                    table[length, code] = next(symbols)
                    code += 1
                code <<= 1
            self.tables[body[0] >> 4, body[0] & 15] = table
            body = body[17 + sum(counts) :]

    @staticmethod
    def _scan_end(data: bytes, at: int) -> int:
        while True:
            at = data.find(b"\xff", at)
            if at < 0 or at + 1 >= len(data):
                return len(data)
            if data[at + 1] == 0 or 0xD0 <= data[at + 1] <= 0xD7:
                at += 2
            else:
                return at

    def _scan(self, body: bytes, raw: bytes) -> None:
        chosen = [(body[1 + 2 * i], body[2 + 2 * i] >> 4, body[2 + 2 * i] & 15) for i in range(body[0])]
        most_h, most_v = max(c[1] for c in self.components), max(c[2] for c in self.components)
        by_id = {c[0]: c for c in self.components}
        if len(chosen) == 1:
            c = by_id[chosen[0][0]]
            across = -(-(-(-self.width * c[1] // most_h)) // 8)
            down = -(-(-(-self.height * c[2] // most_v)) // 8)
            units, layout = across * down, [(chosen[0], 1, 1)]
            self.grid[c[0]] = (down, across)
        else:
            wide, high = -(-self.width // (8 * most_h)), -(-self.height // (8 * most_v))
            units, layout = wide * high, [(x, by_id[x[0]][1], by_id[x[0]][2]) for x in chosen]
            for x, h, v in layout:
                self.grid[x[0]] = (high * v, wide * h)
        if len(chosen) == 1 and not self.restart and self._even(chosen[0]):
            words = raw.replace(b"\xff\0", b"\xff")
            if len(words) == units * 72:
                self.coefficients[chosen[0][0]] = self._all_at_once(words)
                return
        for x, _, _ in layout:
            down, across = self.grid[x[0]]
            self.coefficients[x[0]] = np.zeros((down * across, 64), np.int32)
        self._bit_by_bit(raw, units, layout)

    def _even(self, chosen: tuple[int, int, int]) -> bool:
        """Do code and magnitude take nine bits for each symbol, as ``store`` has them?"""
        dc, ac = self.tables[0, chosen[1]], self.tables[1, chosen[2]]
        return {(n, c): s for (n, c), s in dc.items()} == {(WORD - s, (1 << (WORD - s)) - 2): s for s in range(9)} and ac == {(WORD - s, (1 << (WORD - s)) - 2): s for s in range(1, 9)}

    @staticmethod
    def _all_at_once(words: bytes) -> np.ndarray:
        nine = np.frombuffer(words, np.uint8).reshape(-1, 9).astype(np.uint16)
        out = np.empty((len(nine), 8), np.int16)
        for k in range(8):
            out[:, k] = _VALUE[(nine[:, k] << (k + 1) | nine[:, k + 1] >> (7 - k)) & 0x1FF]
        block = out.reshape(-1, 64)
        block[:, 0] = np.cumsum(block[:, 0])
        return block

    def _bit_by_bit(self, raw: bytes, units: int, layout: list) -> None:
        parts, rest = [], raw
        while rest:  # restart markers cut the scan
            at = 0
            while (at := rest.find(b"\xff", at)) >= 0 and not (at + 1 < len(rest) and 0xD0 <= rest[at + 1] <= 0xD7):
                at += 2
            parts.append((rest if at < 0 else rest[:at]).replace(b"\xff\0", b"\xff"))
            rest = b"" if at < 0 else rest[at + 2 :]
        unit, across_mcu = 0, {}
        for x, h, _ in layout:
            across_mcu[x[0]] = self.grid[x[0]][1] // h
        for part in parts:
            bits, n_bits = int.from_bytes(part, "big"), len(part) * 8
            place, before = 0, dict.fromkeys((x[0] for x, _, _ in layout), 0)

            def take(n: int) -> int:
                nonlocal place
                place += n
                if place > n_bits:
                    raise ValueError("the scan ends early")
                return bits >> (n_bits - place) & ((1 << n) - 1)

            def symbol(table: dict[tuple[int, int], int]) -> int:
                code = 0
                for length in range(1, 17):
                    code = code << 1 | take(1)
                    if (length, code) in table:
                        return table[length, code]
                raise ValueError("no such code")

            def value(size: int) -> int:
                v = take(size) if size else 0
                return v if not size or v >> (size - 1) else v - (1 << size) + 1

            for _ in range(min(self.restart or units, units - unit)):
                for x, h, v in layout:
                    dc, ac, across = self.tables[0, x[1]], self.tables[1, x[2]], self.grid[x[0]][1]
                    wide = across_mcu[x[0]]
                    for i in range(v):
                        for j in range(h):
                            block = self.coefficients[x[0]][(unit // wide * v + i) * across + unit % wide * h + j]
                            before[x[0]] += value(symbol(dc))
                            block[0] = before[x[0]]
                            k = 1
                            while k < 64:
                                s = symbol(ac)
                                run, size = s >> 4, s & 15
                                if not size and run < 15:
                                    break
                                k += run
                                if size:
                                    block[k] = value(size)
                                k += 1
                unit += 1

    def thumbnail(self) -> np.ndarray:
        """Mean luminance of each block of the first component, from DC coefficients alone."""
        first = self.components[0]
        down, across = self.grid[first[0]]
        dc = self.coefficients[first[0]][:, 0].astype(np.float64) * self.quantiser[first[3]][0]
        return np.clip(np.rint(128 + dc / 8), 0, 255).astype(np.uint8).reshape(down, across)

    def payload(self) -> bytes:
        """What ``store`` kept."""
        if not self.note.startswith(b"blocks "):
            raise ValueError("no payload is stored in this file")
        n = int(self.note.split()[1])
        block = self.coefficients[self.components[0][0]][:n]
        out = np.where(block > 0, block - 1, block).astype(np.uint8)
        out[:, 0] = (block[:, 0] + 128).astype(np.uint8)
        return out.tobytes()


def thumbnail_hash(thumbnail: np.ndarray) -> str:
    """64 bits: of 64 equal stretches of the thumbnail, which are lighter than the mean of all."""
    flat = thumbnail.reshape(-1).astype(np.float64)
    sums = np.concatenate(([0.0], np.cumsum(flat)))
    edges = np.arange(65) * len(flat) / 64
    low = np.floor(edges[:-1]).astype(int)
    high = np.maximum(low + 1, np.ceil(edges[1:]).astype(int))
    means = (sums[high] - sums[low]) / (high - low)
    return np.packbits(means > flat.mean()).tobytes().hex()


def media_column(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and ``media``: each text stored as a JPEG."""

    def run(batches):
        for b in batches:
            pairs = [padded(x) for x in b.column(1).to_pylist()]
            yield pa.record_batch([b.column(0).cast(pa.int64()), pa.array([n for n, _ in pairs], pa.int64()), pa.array([store(p) for _, p in pairs], pa.binary())], ["doc_id", "n_bytes", "media"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_bytes long, media binary")


def media_features(media: DataFrame) -> DataFrame:
    """Read ``media`` back: digests of payload and file, dimensions and thumbnail hash.

    A file that is null, broken or not of the kind that ``store`` writes has nulls, and what is wrong with it in ``error``.
    """
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "width", "height", "error"]
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, width int, height int, error string"
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string()]

    def row(data: bytes | None) -> tuple:
        if data is None:
            return (*[None] * 8, "null")
        try:
            image = Jpeg(data)
            payload = image.payload()
            thumbnail = image.thumbnail()
        except (ValueError, IndexError, KeyError, StopIteration, struct.error) as error:
            return None, None, None, len(data), hashlib.sha256(data).hexdigest(), None, None, None, f"{type(error).__name__}: {error}"
        mark = f"{image.width}x{image.height}:{thumbnail_hash(thumbnail)}"
        return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(data), hashlib.sha256(data).hexdigest(), mark, image.width, image.height, None

    def run(batches):
        for b in batches:
            rows = list(zip(*[row(x) for x in b.column(2).to_pylist()], strict=True)) or [()] * 9
            columns = [b.column(0), b.column(1), *rows]
            yield pa.record_batch([pa.array(c, k) if isinstance(c, tuple) else c for c, k in zip(columns, kinds, strict=True)], names)

    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, schema)
