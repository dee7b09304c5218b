"""Media columns: baseline JPEG in numpy.

Reading is general for baseline (sequential, Huffman, 8 bits) files: markers are parsed, and the
restart intervals of many images are decoded side by side, one symbol of each at a time; a scan
without restarts is one such lane. From the first coefficient of each luminance block comes the
DC-only thumbnail, one pixel a block, and from it the hashes.

Writing stores bytes without loss: a byte is one quantized coefficient (the format's unit), in the
order of the scan, with quantizers of one and a restart interval for each row of blocks. Frequent
letters get small coefficients. A comment holds the number of bytes.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .hashing import texts_of

UNIT, FILL = 576, 255
#: Fixed values of this store: letters by how frequent they are in prose; all other bytes follow in order.
FREQUENT = b" etaoinsrhdlucmfpgwybv.,kxjqz\n"
#: Code lengths of the sizes of coefficients (zero runs are not used in writing, but the end of a block is).
DC_LENGTHS = {0: 3, 1: 3, 2: 3, 3: 3, 4: 3, 5: 4, 6: 5, 7: 6, 8: 7, 9: 8, 10: 9, 11: 10}
AC_LENGTHS = {1: 2, 2: 2, 3: 2, 4: 3, 5: 4, 6: 5, 7: 6, 8: 7, 0: 8, 0xF0: 9}
#: Restart intervals encoded or decoded at a time.
LANES = 2048


def _order() -> np.ndarray:
    ranked = [*FREQUENT, *(b for b in range(256) if b not in FREQUENT)]
    out = np.zeros(256, dtype=np.int32)
    for r, b in enumerate(ranked):
        out[b] = (r // 2 + 1) * (1 if r % 2 == 0 else -1)
    return out


TO_COEFFICIENT = _order()
TO_BYTE = np.zeros(512, dtype=np.uint8)
TO_BYTE[TO_COEFFICIENT + 256] = np.arange(256)


def _codes(lengths: dict[int, int]) -> tuple[list[int], list[int], np.ndarray, np.ndarray]:
    """Canonical Huffman codes: counts by length and symbols for the file; code and length by symbol."""
    symbols = sorted(lengths, key=lambda s: (lengths[s], s))
    code, last, by_code, by_length = 0, 0, np.zeros(256, np.uint64), np.zeros(256, np.int64)
    for s in symbols:
        code <<= lengths[s] - last
        last = lengths[s]
        by_code[s], by_length[s] = code, last
        code += 1
    return [sum(n == k for n in lengths.values()) for k in range(1, 17)], symbols, by_code, by_length


DC_COUNTS, DC_SYMBOLS, DC_CODE, DC_LENGTH = _codes(DC_LENGTHS)
AC_COUNTS, AC_SYMBOLS, AC_CODE, AC_LENGTH = _codes(AC_LENGTHS)
_SIZE = np.zeros(2048, dtype=np.int64)
for _k in range(1, 12):
    _SIZE[1 << (_k - 1) : 1 << _k] = _k


def _marker(code: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 255, code, len(body) + 2) + body


def _header(n_bytes: int, columns: int, rows: int) -> bytes:
    tables = bytes([0x00, *DC_COUNTS, *DC_SYMBOLS]), bytes([0x10, *AC_COUNTS, *AC_SYMBOLS])
    return b"".join((
        b"\xff\xd8", _marker(0xE0, b"JFIF\0\1\1\0\0\1\0\1\0\0"), _marker(0xFE, struct.pack(">Q", n_bytes)), _marker(0xDB, bytes([0, *[1] * 64])),
        _marker(0xC0, struct.pack(">BHHBBBB", 8, rows * 8, columns * 8, 1, 1, 0x11, 0)), _marker(0xC4, tables[0]), _marker(0xC4, tables[1]),
        _marker(0xDD, struct.pack(">H", columns)), _marker(0xDA, bytes([1, 1, 0, 0, 63, 0])),
    ))


def shape(payload: int) -> tuple[int, int]:
    """Columns and rows of blocks; three columns unless that were more rows than the format has."""
    units = payload // UNIT
    columns = 3 * max(1, -(-units // 2730))
    return columns, -(-9 * units // columns)


def _ac_words() -> tuple[np.ndarray, np.ndarray]:
    """For each byte as an AC coefficient: code and bits, and their number."""
    value = TO_COEFFICIENT.astype(np.int64)
    size = _SIZE[np.abs(value)]
    bits = np.where(value < 0, value + (np.int64(1) << size) - 1, value)
    return ((AC_CODE[size].astype(np.int64) << size) | bits).astype(np.uint32), (AC_LENGTH[size] + size).astype(np.uint8)


AC_WORD, AC_BITS = _ac_words()


def _scan(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entropy-coded bytes of intervals (lanes x columns x 64 bytes), with two bytes of room after each; and where those are."""
    lanes, columns, _ = data.shape
    word = np.zeros((lanes, columns * 64 + 1), dtype=np.uint32)
    n = np.zeros((lanes, columns * 64 + 1), dtype=np.uint8)
    word[:, :-1], n[:, :-1] = AC_WORD[data].reshape(lanes, -1), AC_BITS[data].reshape(lanes, -1)
    dc = TO_COEFFICIENT[data[:, :, 0]].astype(np.int64)
    dc[:, 1:] -= dc[:, :-1].copy()
    size = _SIZE[np.abs(dc)]
    bits = np.where(dc < 0, dc + (np.int64(1) << size) - 1, dc)
    word[:, :-1:64] = (DC_CODE[size].astype(np.int64) << size) | bits
    n[:, :-1:64] = DC_LENGTH[size] + size
    total = n.sum(axis=1, dtype=np.int64)
    pad = -total % 8  # with ones
    word[:, -1], n[:, -1] = (np.int64(1) << pad) - 1, pad
    lane_end = np.cumsum(total + pad) >> 3
    n, word = n.ravel(), word.ravel()
    end = np.cumsum(n, dtype=np.int64)
    at = end - n
    byte = at >> 3
    # Each word moves to its place in the 32 bits from its first byte on; words that begin in one byte don't overlap.
    window = word << ((32 - n - (at & 7)) & 31).astype(np.uint32)
    first = np.flatnonzero(np.concatenate([[True], byte[1:] != byte[:-1]]))
    window, byte = np.add.reduceat(window, first), byte[first]
    out = np.zeros(int(lane_end[-1]) + 4, dtype=np.uint8)
    for k in range(4):
        out[byte + k] += (window >> np.uint32(24 - 8 * k)).astype(np.uint8)
    out = out[: int(lane_end[-1])]
    # A zero goes after each 255, and two bytes of a marker after each lane.
    room = (out == 255).astype(np.int64) + 1
    room[lane_end - 1] += 2
    stop = np.cumsum(room)
    stuffed = np.zeros(int(stop[-1]), dtype=np.uint8)
    stuffed[stop - room] = out
    after = stop[lane_end - 1] - 2
    stuffed[after] = 255
    return stuffed, after


def encode_images(payloads: list[tuple[bytes, int]]) -> list[bytes]:
    """JPEG files of payloads (bytes, bytes before the padding), in slices of LANES intervals."""
    out: list[bytes | None] = [None] * len(payloads)
    by_columns: dict[int, list[int]] = {}
    for i, (p, _) in enumerate(payloads):
        by_columns.setdefault(shape(len(p))[0], []).append(i)
    for columns, group in by_columns.items():
        lane_bytes, rows = 64 * columns, [shape(len(payloads[i][0]))[1] for i in group]
        full = b"".join(payloads[i][0].ljust(r * lane_bytes, b"\xff") for i, r in zip(group, rows, strict=True))
        lanes = len(full) // lane_bytes
        data = np.frombuffer(full, dtype=np.uint8).reshape(lanes, columns, 64)
        number = np.concatenate([np.arange(r) for r in rows])
        last = np.zeros(lanes, dtype=bool)
        last[np.cumsum(rows) - 1] = True
        step, parts, ends, done = max(1, LANES * 3 // columns), [], [], 0
        for a in range(0, lanes, step):
            made, after = _scan(data[a : a + step])
            made[after + 1] = np.where(last[a : a + step], 0xD9, 0xD0 + number[a : a + step] % 8)
            parts.append(made)
            ends.append(after[last[a : a + step]] + 2 + done)
            done += len(made)
        scan, ends = np.concatenate(parts).tobytes(), np.concatenate(ends)
        for i, r, a, b in zip(group, rows, np.concatenate([[0], ends[:-1]]), ends, strict=True):
            out[i] = _header(payloads[i][1], columns, r) + scan[a:b]
    return out


@dataclass
class Parsed:
    """What the markers of a baseline file say."""

    width: int = 0
    height: int = 0
    components: list[tuple[int, int, int, int]] = field(default_factory=list)  # id, horizontal, vertical, quantizer
    quantizers: dict[int, tuple[int, ...]] = field(default_factory=dict)
    huffman: dict[int, bytes] = field(default_factory=dict)
    interval: int = 0
    scan: list[tuple[int, int, int]] = field(default_factory=list)  # component, DC table, AC table
    comment: bytes = b""
    start: int = 0

    @property
    def mcus(self) -> tuple[int, int]:
        if len(self.components) == 1:
            return -(-self.width // 8), -(-self.height // 8)
        h, v = max(c[1] for c in self.components), max(c[2] for c in self.components)
        return -(-self.width // (8 * h)), -(-self.height // (8 * v))

    @property
    def pattern(self) -> list[tuple[int, int, int]]:
        """(component, DC table, AC table) of each block of an MCU."""
        if len(self.components) == 1:
            return [(0, *self.scan[0][1:])]
        of = {c: (d, a) for c, d, a in self.scan}
        return [(i, *of[c[0]]) for i, c in enumerate(self.components) for _ in range(c[1] * c[2])]


def parse(data: bytes) -> Parsed:
    out, at = Parsed(), 2
    if data[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG file")
    while True:
        while data[at + 1] == 255:
            at += 1
        if data[at] != 255:
            raise ValueError("a marker is missing")
        code, n = data[at + 1], struct.unpack_from(">H", data, at + 2)[0]
        body = data[at + 4 : at + 2 + n]
        at += 2 + n
        if code == 0xC0 or code == 0xC1:
            bits, out.height, out.width, many = struct.unpack_from(">BHHB", body)
            if bits != 8:
                raise ValueError("samples are not of 8 bits")
            out.components = [(body[6 + 3 * k], body[7 + 3 * k] >> 4, body[7 + 3 * k] & 15, body[8 + 3 * k]) for k in range(many)]
        elif 0xC2 <= code <= 0xCF and code not in (0xC4, 0xC8, 0xCC):
            raise ValueError("not a baseline file")
        elif code == 0xC4:
            while body:
                many = sum(body[1:17])
                out.huffman[body[0]] = body[1 : 17 + many]
                body = body[17 + many :]
        elif code == 0xDB:
            while body:
                wide = body[0] >> 4
                size = 128 if wide else 64
                out.quantizers[body[0] & 15] = struct.unpack(">64H" if wide else "64B", body[1 : 1 + size])
                body = body[1 + size :]
        elif code == 0xDD:
            out.interval = struct.unpack(">H", body)[0]
        elif code == 0xFE:
            out.comment = body
        elif code == 0xDA:
            out.scan = [(body[1 + 2 * k], body[2 + 2 * k] >> 4, body[2 + 2 * k] & 15) for k in range(body[0])]
            if len(out.scan) != len(out.components):
                raise ValueError("scans of single components are not supported")
            out.start = at
            return out


_LOOKUPS: dict[bytes, np.ndarray] = {}


def _lookup(table: bytes, dc: bool) -> np.ndarray:
    """By the next 16 bits: symbol << 8 | code length (0: no code), and from bit 16 on, where the
    coefficient's bits are among the 16 and no zeros go before it: bits used, and coefficient + 2048."""
    key = table + bytes([dc])
    if key not in _LOOKUPS:
        out, code, k = np.zeros(1 << 16, dtype=np.int64), 0, 16
        for n in range(1, 17):
            for _ in range(table[n - 1]):
                symbol = table[k]
                lo, hi = code << (16 - n), (code + 1) << (16 - n)
                out[lo:hi] = symbol << 8 | n
                size = symbol & 15
                if n + size <= 16 and (dc or 0 < symbol < 16):
                    raw = (np.arange(hi - lo) >> (16 - n - size)) if size else np.zeros(hi - lo, np.int64)
                    value = np.where(raw >> max(size - 1, 0), raw, raw - (1 << size) + 1) if size else raw
                    out[lo:hi] |= (n + size) << 16 | (value + 2048) << 24
                code, k = code + 1, k + 1
            code <<= 1
        _LOOKUPS[key] = out
    return _LOOKUPS[key]


def _lanes(scan: np.ndarray, image_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes without stuffing and markers, where each interval begins in them, and the first lane of each image (and the end)."""
    keep = np.ones(len(scan), dtype=bool)
    ff = np.flatnonzero(scan[:-1] == 255)
    after = scan[ff + 1]
    keep[ff[after == 0] + 1] = False
    keep[ff[after == 255]] = False
    marks = ff[(after >= 0xD0) & (after <= 0xD9)]
    keep[marks] = keep[marks + 1] = False
    upto = np.concatenate([[0], np.cumsum(keep)])
    restart = marks[(scan[marks + 1] <= 0xD7)]
    begins = np.sort(np.concatenate([restart + 2, [0], image_ends[:-1]]))
    return scan[keep], upto[begins], np.searchsorted(begins, np.concatenate([[0], image_ends]))


def _decode_lanes(data: np.ndarray, begins: np.ndarray, blocks: np.ndarray, pattern, dc: np.ndarray, ac: np.ndarray) -> np.ndarray:
    """Coefficients, blocks x 64 in the scan's order, of intervals that begin at bytes of `data`."""
    lo, hi = int(begins[0]), len(data)
    own = np.concatenate([data[lo:hi], np.full(16, 255, np.uint8)])
    wide = own.astype(np.uint64)
    window = np.zeros(len(own) - 8, dtype=np.uint64)
    for k in range(8):
        window |= wide[k : len(own) - 8 + k] << np.uint64(56 - 8 * k)
    first = np.cumsum(blocks) - blocks
    out = np.zeros((int(blocks.sum()), 64), dtype=np.int16)
    flat = out.reshape(-1)
    many = max(c for c, _, _ in pattern) + 1
    kind = np.array([c for c, _, _ in pattern])
    lane = np.flatnonzero(blocks)
    bit = (begins[lane] - lo) * 8
    block, k, prediction = np.zeros(len(lane), np.int64), np.zeros(len(lane), np.int64), np.zeros((len(lane), many), np.int64)
    base, left = first[lane] * 64, blocks[lane]
    tables = np.concatenate([dc, ac])
    n_pattern = len(pattern)
    together = n_pattern == 1  # all lanes are at the same coefficient
    while len(lane):
        if together:
            # The usual case is one lookup a coefficient; whatever it doesn't cover takes the long way below.
            place, step = bit >> 3, int(k[0])
            if place.max() >= len(window):
                raise ValueError("a scan ends too early")
            entry = tables[int(step > 0)][(window[place] << (bit & 7).astype(np.uint64)) >> np.uint64(48)]
            used = (entry >> 16) & 255
            if used.all():
                value = (entry >> 24) - 2048
                if not step:
                    value += prediction[:, 0]
                    prediction[:, 0] = value
                flat[base + (block * 64 + step)] = value
                bit += used
                k += 1
                if step == 63:
                    block += 1
                    k[:] = 0
                    stay = block < left
                    if not stay.all():
                        lane, bit, block, k, prediction, base, left = (x[stay] for x in (lane, bit, block, k, prediction, base, left))
                continue
        place = bit >> 3
        if (place >= len(window)).any():
            raise ValueError("a scan ends too early")
        v = window[place] << (bit & 7).astype(np.uint64)
        which = block % n_pattern if n_pattern > 1 else 0
        is_dc = k == 0
        entry = tables[np.where(is_dc, which, which + n_pattern), (v >> np.uint64(48)).astype(np.int64)]
        n, symbol = entry & 255, entry >> 8 & 255
        if not n.all():
            raise ValueError("a code that is in no table")
        size = symbol & 15
        run = np.where(is_dc, 0, symbol >> 4)
        raw = (((v << n.astype(np.uint64)) >> np.uint64(1)) >> (63 - size).astype(np.uint64)).astype(np.int64)
        value = np.where(raw >> np.maximum(size - 1, 0), raw, raw - (np.int64(1) << size) + 1)
        bit += n + size
        if is_dc.any():
            component = kind[which] if n_pattern > 1 else np.zeros(len(lane), np.int64)
            rows = np.flatnonzero(is_dc)
            prediction[rows, component[rows]] += value[rows]
            value[rows] = prediction[rows, component[rows]]
        to = k + run
        put = (size > 0) | is_dc
        if (to[put] > 63).any():
            raise ValueError("a run leaves its block")
        if put.all():
            flat[base + block * 64 + to] = value
            k = to + 1
        else:
            flat[(base + block * 64 + to)[put]] = value[put]
            k = np.where(put, to + 1, np.where(symbol == 0xF0, k + 16, 64))
        over = k >= 64
        if over.any():
            block += over
            k[over] = 0
            stay = block < left
            if not stay.all():
                lane, bit, block, k, prediction, base, left = (x[stay] for x in (lane, bit, block, k, prediction, base, left))
        together = n_pattern == 1 and len(k) > 0 and bool((k == k[0]).all())
    return out


def decode_images(files: list[bytes]) -> list[tuple[Parsed, np.ndarray]]:
    """(markers, coefficients: blocks x 64 in the scan's order) of each file; like files are decoded together."""
    parsed = [parse(f) for f in files]
    groups: dict[tuple, list[int]] = {}
    for i, p in enumerate(parsed):
        key = (p.interval, p.mcus[0] if p.interval else i, tuple(p.pattern), tuple(sorted(p.huffman.items())))
        groups.setdefault(key, []).append(i)
    out: list = [None] * len(files)
    for (interval, _, pattern, huffman), group in groups.items():
        tables = dict(huffman)
        dc = np.stack([_lookup(tables[d], True) for _, d, _ in pattern])
        ac = np.stack([_lookup(tables[16 + a], False) for _, _, a in pattern])
        scans = [files[i][parsed[i].start :] for i in group]
        data, begins, first = _lanes(np.frombuffer(b"".join(scans), dtype=np.uint8), np.cumsum([len(s) for s in scans]))
        blocks = []
        for i, n in zip(group, np.diff(first), strict=True):
            total = parsed[i].mcus[0] * parsed[i].mcus[1]
            own = np.full(n, interval or total, dtype=np.int64)
            own[-1] = total - (interval or total) * (n - 1)
            if own[-1] <= 0 or own[-1] > (interval or total):
                raise ValueError("the restarts don't fit the image")
            blocks.append(own * len(pattern))
        blocks = np.concatenate(blocks)
        parts = []
        for a in range(0, len(begins), LANES):
            b = min(a + LANES, len(begins))
            parts.append(_decode_lanes(data[: begins[b] if b < len(begins) else len(data)], begins[a:b], blocks[a:b], pattern, dc, ac))
        every, upto = np.concatenate(parts), np.concatenate([[0], np.cumsum(blocks)])
        for i, a, b in zip(group, first[:-1], first[1:], strict=True):
            out[i] = parsed[i], every[upto[a] : upto[b]]
    return out


def thumbnail(p: Parsed, coefficients: np.ndarray) -> np.ndarray:
    """One pixel a luminance block, from its DC coefficient alone."""
    columns, rows = p.mcus
    each = len(p.pattern)
    h, v = (p.components[0][1], p.components[0][2]) if len(p.components) > 1 else (1, 1)
    dc = coefficients.reshape(rows, columns, each, 64)[:, :, : h * v, 0].astype(np.int64)
    grid = dc.reshape(rows, columns, v, h).transpose(0, 2, 1, 3).reshape(rows * v, columns * h)
    pixels = np.clip((grid * p.quantizers[p.components[0][3]][0] + 4 >> 3) + 128, 0, 255).astype(np.uint8)
    return pixels[: -(-p.height // 8), : -(-p.width // 8)]


def average_hash(pixels: np.ndarray) -> int:
    """64 bits: whether each cell of an 8 x 8 grid is brighter than the mean."""
    rows, columns = (np.arange(9) * n // 8 for n in pixels.shape)
    sums = np.zeros((pixels.shape[0] + 1, pixels.shape[1] + 1))
    sums[1:, 1:] = pixels.cumsum(axis=0, dtype=np.float64).cumsum(axis=1)
    r0, r1 = np.minimum(rows[:-1], pixels.shape[0] - 1), np.maximum(rows[1:], np.minimum(rows[:-1] + 1, pixels.shape[0]))
    c0, c1 = np.minimum(columns[:-1], pixels.shape[1] - 1), np.maximum(columns[1:], np.minimum(columns[:-1] + 1, pixels.shape[1]))
    cells = (sums[np.ix_(r1, c1)] - sums[np.ix_(r0, c1)] - sums[np.ix_(r1, c0)] + sums[np.ix_(r0, c0)]) / np.outer(r1 - r0, c1 - c0)
    return int.from_bytes(np.packbits(cells.ravel() > cells.mean()).tobytes(), "big")


def payload(p: Parsed, coefficients: np.ndarray) -> tuple[bytes, int]:
    """The bytes that `encode_images` stored, with their padding, and how many there were before it."""
    n = struct.unpack(">Q", p.comment)[0]
    size = max(1, -(-n // UNIT)) * UNIT
    return TO_BYTE[coefficients.reshape(-1)[:size] + 256].tobytes(), n


def padded(text: bytes) -> bytes:
    return text + bytes([FILL]) * ((-len(text) % UNIT) if text else UNIT)


def _slices(items: list, size_of, most: int = 1 << 22) -> Iterator[list]:
    held, n = [], 0
    for x in items:
        held.append(x)
        n += size_of(x)
        if n >= most:
            yield held
            held, n = [], 0
    if held:
        yield held


def store_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, media): each whole text (null: empty) as a JPEG file."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for some in _slices(texts_of(batch.column(1)), len):
                files = encode_images([(padded(t), len(t)) for t in some])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(some)), pa.array(files, pa.binary())], names=["doc_id", "media"])
                at += len(some)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).mapInArrow(write, "doc_id long, media binary")


FEATURES = "width int, height int, thumbnail_hash string, average_hash string, media_bytes long, media_sha256 string"


def media_features(media: DataFrame, with_payload: bool = False) -> DataFrame:
    """doc_id and, read from each file: width, height, hashes of its DC-only thumbnail, size and SHA-256.

    Null or unreadable media give nulls (media_bytes and media_sha256 of unreadable ones stay). With
    `with_payload` also n_bytes, payload_bytes, payload_sha256 and tail_crc32 of what
    `store_texts` stored; files that are damaged then raise.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for some in _slices(list(zip(ids, batch.column(1).to_pylist(), strict=True)), lambda x: len(x[1] or b"")):
                out = []
                for (doc, file), found in zip(some, _read([f for _, f in some], strict=with_payload), strict=True):
                    row: tuple = (None,) * 4
                    more: tuple = (None,) * 4
                    if found:
                        p, coefficients = found
                        small = thumbnail(p, coefficients)
                        row = (p.width, p.height, hashlib.sha256(small.tobytes()).hexdigest()[:32], f"{average_hash(small):016x}")
                        if with_payload:
                            body, n = payload(p, coefficients)
                            more = (n, len(body), hashlib.sha256(body).hexdigest(), zlib.crc32(body[-32:]))
                    out.append((doc, *row, None if file is None else len(file), None if file is None else hashlib.sha256(file).hexdigest(), *more[: 4 * with_payload]))
                kinds = [pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.int64(), pa.string(), *[pa.int64(), pa.int64(), pa.string(), pa.int64()][: 4 * with_payload]]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=[x.split(" ")[0] for x in schema.split(", ")])

    schema = "doc_id long, " + FEATURES + ", n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long" * with_payload
    return media.select("doc_id", "media").mapInArrow(read, schema)


def _read(files: list[bytes | None], strict: bool) -> list:
    there = [i for i, f in enumerate(files) if f is not None]
    out: list = [None] * len(files)
    try:
        found = decode_images([files[i] for i in there])
    except (ValueError, IndexError, KeyError, struct.error):
        if strict:
            raise
        found = []
        for i in there:
            try:
                found += decode_images([files[i]])
            except (ValueError, IndexError, KeyError, struct.error):
                found.append(None)
    for i, x in zip(there, found, strict=True):
        out[i] = x
    return out


def stored_text_features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Store each text as a media column (Parquet in the shared folder), read it back and describe it.

    Null counts as empty (one unit of padding); repeated rows are stored each; an empty table gives no rows.
    """
    media = materialize(store_texts(docs, id_col, text_col))
    return media_features(media, with_payload=True)
