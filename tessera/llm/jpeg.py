"""Progressive JPEG: coefficient arrays to scans and back, and scans to RGB.

``decode`` reads any Huffman-coded progressive file of one or three components:
each scan (a band of the spectrum, or one more bit of it) is accumulated into
coefficient arrays; ``rgb`` transforms them, widens the chroma planes and
returns the full-resolution tensor.  ``encode`` writes coefficients whose
magnitudes all need the same number of bits, which is how a column of bytes is
kept losslessly: one byte for each coefficient.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass, field

import numpy as np

# The zigzag order of a block's coefficients.
ZIGZAG = np.array([
    0, 1, 8, 16, 9, 2, 3, 10, 17, 24, 32, 25, 18, 11, 4, 5, 12, 19, 26, 33, 40, 48, 41, 34, 27, 20, 13, 6, 7, 14, 21, 28,
    35, 42, 49, 56, 57, 50, 43, 36, 29, 22, 15, 23, 30, 37, 44, 51, 58, 59, 52, 45, 38, 31, 39, 46, 53, 60, 61, 54, 47, 55, 62, 63,
])


def _inverse_transform() -> np.ndarray:
    """Matrix from a block's zigzag coefficients to its 64 samples."""
    n = np.arange(8)
    basis = np.cos((2 * n[:, None] + 1) * n[None, :] * np.pi / 16) / 2  # sample, frequency
    basis[:, 0] /= np.sqrt(2)
    full = np.einsum("yv,xu->yxvu", basis, basis).reshape(64, 64)  # row: sample, column: natural order
    return np.ascontiguousarray(full[:, ZIGZAG].T).astype(np.float32)


INVERSE = _inverse_transform()


@dataclass
class Component:
    ident: int
    h: int
    v: int
    table: int
    wide: int = 0  # blocks in a row and a column, padded to whole units
    high: int = 0
    own_wide: int = 0  # without the padding
    own_high: int = 0
    coef: np.ndarray = field(default_factory=lambda: np.zeros((0, 64), np.int32))


@dataclass
class Image:
    width: int
    height: int
    components: list[Component]
    quant: dict[int, np.ndarray]
    comment: bytes = b""


class Bits:
    """Entropy-coded bits of one restart interval."""

    def __init__(self, data: bytes):
        self.data, self.at = data + b"\xff" * 8, 0

    def peek16(self) -> int:
        i = self.at >> 3
        return (int.from_bytes(self.data[i : i + 3], "big") >> (8 - (self.at & 7))) & 0xFFFF

    def take(self, n: int) -> int:
        i, self.at = self.at >> 3, self.at + n
        return (int.from_bytes(self.data[i : i + 5], "big") >> (40 - n - ((self.at - n) & 7))) & ((1 << n) - 1)

    def array(self, n: int) -> np.ndarray:
        """The next n bits, one in each element."""
        i, shift = self.at >> 3, self.at & 7
        part = np.frombuffer(self.data, np.uint8, count=min((shift + n + 7) >> 3, len(self.data) - i), offset=i)
        self.at += n
        return np.unpackbits(part)[shift : shift + n]


class Code:
    """A Huffman table: 16 bits ahead -> length and symbol."""

    def __init__(self, lengths: bytes, symbols: bytes):
        self.single = (list(lengths).index(1) + 1, symbols[0]) if len(symbols) == 1 else None
        self.look: list[tuple[int, int]] = [(16, 0)] * 65536
        code = k = 0
        for size in range(1, 17):
            for _ in range(lengths[size - 1]):
                lo = code << (16 - size)
                self.look[lo : lo + (1 << (16 - size))] = [(size, symbols[k])] * (1 << (16 - size))
                code, k = code + 1, k + 1
            code <<= 1

    def read(self, bits: Bits) -> int:
        size, symbol = self.look[bits.peek16()]
        bits.at += size
        return symbol


_codes: dict[bytes, Code] = {}


def code_of(lengths: bytes, symbols: bytes) -> Code:
    if lengths + symbols not in _codes:
        if len(_codes) > 64:
            _codes.clear()
        _codes[lengths + symbols] = Code(lengths, symbols)
    return _codes[lengths + symbols]


def extended(value: int, size: int) -> int:
    return value if size == 0 or value >> (size - 1) else value - (1 << size) + 1


def decode(data: bytes) -> Image:
    """Accumulate every scan of a progressive file into coefficient arrays (zigzag order, not yet dequantised)."""
    if data[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG")
    at, quant, codes, image, restart, comment = 2, {}, {}, None, 0, b""
    while at + 4 <= len(data):
        marker = data[at + 1]
        if marker == 0xD9:
            break
        size = struct.unpack(">H", data[at + 2 : at + 4])[0]
        body, at = data[at + 4 : at + 2 + size], at + 2 + size
        if marker == 0xDB:
            while body:
                wide = 64 * (1 + (body[0] >> 4))
                quant[body[0] & 15] = np.frombuffer(body[1 : 1 + wide], ">u2" if body[0] >> 4 else "u1").astype(np.int32)
                body = body[1 + wide :]
        elif marker == 0xC4:
            while body:
                n = sum(body[1:17])
                codes[body[0]] = code_of(body[1:17], body[17 : 17 + n])
                body = body[17 + n :]
        elif marker == 0xDD:
            restart = struct.unpack(">H", body)[0]
        elif marker == 0xFE:
            comment = body
        elif marker == 0xC2:
            _, height, width, n = struct.unpack(">BHHB", body[:6])
            comps = [Component(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)]
            hm, vm = max(c.h for c in comps), max(c.v for c in comps)
            for c in comps:
                c.wide, c.high = -(-width // (8 * hm)) * c.h, -(-height // (8 * vm)) * c.v
                c.own_wide, c.own_high = -(-width * c.h // (8 * hm)), -(-height * c.v // (8 * vm))
                c.coef = np.zeros((c.wide * c.high, 64), np.int32)
            image = Image(width, height, comps, quant)
        elif marker in (0xC0, 0xC1, 0xC3, *range(0xC5, 0xC8), *range(0xC9, 0xCC), *range(0xCD, 0xD0)):
            raise ValueError("not a Huffman-coded progressive JPEG")
        elif marker == 0xDA:
            end = at
            while True:
                end = data.index(b"\xff", end)
                if data[end + 1] == 0 or 0xD0 <= data[end + 1] <= 0xD7:
                    end += 2
                else:
                    break
            if image is None:
                raise ValueError("a scan before the frame")
            _scan(image, body, data[at:end], codes, restart)
            at = end
    if image is None:
        raise ValueError("no frame")
    image.comment = comment
    return image


def _intervals(data: bytes) -> list[Bits]:
    parts, start, at = [], 0, 0
    while (at := data.find(b"\xff", at)) >= 0:
        if at + 1 < len(data) and 0xD0 <= data[at + 1] <= 0xD7:
            parts.append(data[start:at])
            start = at + 2
        at += 2
    return [Bits(p.replace(b"\xff\x00", b"\xff")) for p in [*parts, data[start:]]]


def unit_order(c: Component, single: bool) -> np.ndarray:
    """A component's blocks (rows of coef) in the order a scan visits them, grouped by unit."""
    grid = np.arange(c.wide * c.high).reshape(c.high, c.wide)
    if single:
        return grid[: c.own_high, : c.own_wide].reshape(-1, 1)
    return grid.reshape(c.high // c.v, c.v, c.wide // c.h, c.h).transpose(0, 2, 1, 3).reshape(-1, c.h * c.v)


def _scan(image: Image, head: bytes, data: bytes, codes: dict[int, Code], restart: int) -> None:
    n = head[0]
    chosen = [(next(c for c in image.components if c.ident == head[1 + 2 * i]), head[2 + 2 * i]) for i in range(n)]
    first, last, approx = head[1 + 2 * n : 4 + 2 * n]
    high, low = approx >> 4, approx & 15
    orders = [unit_order(c, n == 1) for c, _ in chosen]
    units = len(orders[0])
    step = restart or units
    for k, bits in enumerate(_intervals(data)):
        lo, hi = k * step, min(units, (k + 1) * step)
        if first == 0:
            _dc(bits, [(c, codes.get(t >> 4), o[lo:hi]) for (c, t), o in zip(chosen, orders)], high, low)
        else:
            c, t = chosen[0]
            blocks = orders[0][lo:hi, 0]
            if high:
                _ac_again(bits, c.coef, blocks, codes[0x10 | (t & 15)], first, last, low)
            else:
                _ac_first(bits, c.coef, blocks, codes[0x10 | (t & 15)], first, last, low)


def _dc(bits: Bits, parts: list[tuple[Component, Code | None, np.ndarray]], high: int, low: int) -> None:
    counts = [o.shape[1] for _, _, o in parts]
    total, units = sum(counts), len(parts[0][2])
    if high:
        values = bits.array(units * total).astype(np.int32).reshape(units, total) << low
        at = 0
        for (c, _, order), n in zip(parts, counts):
            c.coef[order, 0] |= values[:, at : at + n]
            at += n
        return
    looks = [t.look for (_, t, _), n in zip(parts, counts) for _ in range(n)]  # type: ignore[union-attr]
    data, at, diffs = bits.data, bits.at, []
    add, to_int = diffs.append, int.from_bytes
    for _ in range(units):
        for look in looks:
            i = at >> 3
            word = to_int(data[i : i + 5], "big")
            shift = at & 7
            size, symbol = look[(word >> (24 - shift)) & 0xFFFF]
            at += size + symbol
            if symbol:
                value = (word >> (40 - shift - size - symbol)) & ((1 << symbol) - 1)
                add(value if value >> (symbol - 1) else value - (1 << symbol) + 1)
            else:
                add(0)
    bits.at = at
    table = np.array(diffs, np.int32).reshape(units, total)
    at = 0
    for (c, _, order), n in zip(parts, counts):
        c.coef[order, 0] = np.cumsum(table[:, at : at + n].ravel()).reshape(units, n) << low
        at += n


def _ac_first(bits: Bits, coef: np.ndarray, blocks: np.ndarray, code: Code, first: int, last: int, low: int) -> None:
    band = last - first + 1
    if code.single and code.single[1] >> 4 == 0 and code.single[1]:
        # one symbol, no runs: every coefficient takes the same number of bits
        size, symbol = code.single
        wide, n = size + symbol, len(blocks) * band
        if wide == 8 and bits.at & 7 == 0:
            value = np.frombuffer(bits.data, np.uint8, count=n, offset=bits.at >> 3).astype(np.int32) & ((1 << symbol) - 1)
        else:
            value = bits.array(n * wide).reshape(n, wide)[:, size:] @ (1 << np.arange(symbol - 1, -1, -1))
        value = np.where(value >> (symbol - 1), value, value - (1 << symbol) + 1)
        coef[blocks, first : last + 1] = value.reshape(-1, band) << low
        return
    run = 0
    for b in blocks:
        if run:
            run -= 1
            continue
        k = first
        while k <= last:
            symbol = code.read(bits)
            zeros, size = symbol >> 4, symbol & 15
            if size:
                k += zeros
                coef[b, k] = extended(bits.take(size), size) << low
                k += 1
            elif zeros == 15:
                k += 16
            else:
                run = (1 << zeros) + bits.take(zeros) - 1
                break


def _ac_again(bits: Bits, coef: np.ndarray, blocks: np.ndarray, code: Code, first: int, last: int, low: int) -> None:
    one = 1 << low

    def correct(rows: np.ndarray, start: int) -> None:
        """One more bit for each coefficient of these rows that is not zero, from ``start`` in the first row."""
        part = coef[rows, first : last + 1]
        known = part != 0
        known[0, : start - first] = False
        more = bits.array(int(known.sum())).astype(np.int32) * one
        part[known] += more * np.sign(part[known])
        coef[rows, first : last + 1] = part

    i = 0
    while i < len(blocks):
        b, k = blocks[i], first
        while k <= last:
            symbol = code.read(bits)
            zeros, size = symbol >> 4, symbol & 15
            new = 0
            if size:
                new = one if bits.take(1) else -one
            elif zeros < 15:
                run = (1 << zeros) + bits.take(zeros)
                correct(blocks[i : i + run], k)
                i += run - 1
                break
            while k <= last:
                if coef[b, k]:
                    if bits.take(1):
                        coef[b, k] += one if coef[b, k] > 0 else -one
                elif zeros == 0:
                    if new:
                        coef[b, k] = new
                    k += 1
                    break
                else:
                    zeros -= 1
                k += 1
        i += 1


def plane(image: Image, c: Component) -> np.ndarray:
    """A component's samples, before they are widened (float, centred at 128)."""
    samples = (c.coef * image.quant[c.table]).astype(np.float32) @ INVERSE + 128
    return samples.reshape(c.high, c.wide, 8, 8).transpose(0, 2, 1, 3).reshape(c.high * 8, c.wide * 8)


def rgb(image: Image) -> np.ndarray:
    """The full-resolution tensor, (height, width, 3) of 8 bits; a single component gives equal channels."""
    hm, vm = max(c.h for c in image.components), max(c.v for c in image.components)
    full = []
    for c in image.components:
        p = np.clip(plane(image, c), 0, 255)
        if c.v < vm:
            p = np.repeat(p, vm // c.v, 0)
        if c.h < hm:
            p = np.repeat(p, hm // c.h, 1)
        full.append(p[: image.height, : image.width])
    if len(full) < 3:
        return np.repeat(np.rint(full[0]).astype(np.uint8)[:, :, None], 3, 2)
    y, cb, cr = full[0], full[1] - 128, full[2] - 128
    out = np.stack([y + 1.402 * cr, y - 0.344136 * cb - 0.714136 * cr, y + 1.772 * cb], 2)
    return np.rint(np.clip(out, 0, 255)).astype(np.uint8)


# --- bytes as coefficients ------------------------------------------------------------------

TALLEST = 4095  # units of 16 lines in a column of units


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _table(kind: int, lengths: dict[int, int], symbols: bytes) -> bytes:
    return _segment(0xC4, bytes([kind]) + bytes(lengths.get(i, 0) for i in range(1, 17)) + symbols)


def _packed(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Bits of ``values``, each in its own number of bits (16 at most)."""
    left = (values << (16 - sizes)).astype(">u2")
    rows = np.unpackbits(left.view(np.uint8).reshape(-1, 2), axis=1)
    return rows[np.arange(16)[None, :] < sizes[:, None]]


def _closed(bits: np.ndarray) -> bytes:
    """Filled with ones to whole bytes, with a zero after each 255."""
    pad = -len(bits) % 8
    return np.packbits(np.concatenate([bits, np.ones(pad, np.uint8)])).tobytes().replace(b"\xff", b"\xff\x00")


TABLES = (
    _segment(0xDB, b"\x00" + b"\x01" * 64)
    + _table(0x00, {4: 12}, bytes(range(12)))  # sizes of the first coefficients' differences
    + _table(0x10, {1: 1}, b"\x07")  # no zeros, seven bits: the only symbol of the first passes
    + _table(0x11, {4: 15}, bytes(n << 4 for n in range(15)))  # runs of blocks without a new coefficient
)


def encode(payload: bytes, comment: bytes = b"") -> bytes:
    """A 4:2:0 progressive file whose coefficients are the bytes of ``payload`` (a multiple of 64), in order.

    A byte is the first coefficient of a block less 128, or the eight magnitude
    bits of a later one.  The last unit is filled with 255.
    """
    blocks = len(payload) // 64
    units = max(1, -(-blocks // 6))
    across = -(-units // TALLEST)
    down = -(-units // across)
    units = across * down
    body = np.frombuffer(payload + b"\xff" * (64 * (6 * units - blocks)), np.uint8).reshape(-1, 64)
    comps = [Component(1, 2, 2, 0, 2 * across, 2 * down), Component(2, 1, 1, 0, across, down), Component(3, 1, 1, 0, across, down)]
    parts = [body[: 4 * units], body[4 * units : 5 * units], body[5 * units :]]
    out = [b"\xff\xd8", _segment(0xE0, b"JFIF\0\1\1\0\0\1\0\1\0\0"), _segment(0xFE, comment) if comment else b"", TABLES]
    out.append(_segment(0xC2, struct.pack(">BHHB", 8, 16 * down, 16 * across, 3) + b"".join(bytes([c.ident, c.h << 4 | c.v, 0]) for c in comps)))

    def scan(idents: list[int], codes: list[int], first: int, last: int, approx: int, data: bytes) -> None:
        out.append(_segment(0xDA, bytes([len(idents), *(x for p in zip(idents, codes) for x in p), first, last, approx])) + data)

    dc = [p[unit_order(c, False), 0].astype(np.int32) - 128 for c, p in zip(comps, parts)]
    diffs = np.concatenate([np.diff((d >> 1).ravel(), prepend=0).reshape(units, -1) for d in dc], 1).ravel()
    size = np.zeros(len(diffs), np.int32)
    for n in range(8):
        size += np.abs(diffs) >= 1 << n
    value = np.where(diffs < 0, diffs + (1 << size) - 1, diffs)
    scan([1, 2, 3], [0, 0, 0], 0, 0, 0x01, _closed(_packed(size << size | value, size + 4)))
    for first, last in ((1, 5), (6, 63)):
        for c, p in zip(comps, parts):
            scan([c.ident], [0], first, last, 0x01, (p[:, first : last + 1] >> 1).tobytes())
    scan([1, 2, 3], [0, 0, 0], 0, 0, 0x10, _closed(np.concatenate([d & 1 for d in dc], 1).astype(np.uint8).ravel()))
    for c, p in zip(comps, parts):
        later = p[:, 1:]
        low = (later & 1) ^ (later < 128)
        bits = []
        for at in range(0, len(p), 32767):
            rows = low[at : at + 32767]
            n = len(rows).bit_length() - 1
            bits += [_packed(np.array([n]), np.array([4])), _packed(np.array([len(rows) - (1 << n)]), np.array([n])), rows.ravel()]
        scan([c.ident], [1], 1, 63, 0x10, _closed(np.concatenate(bits)))
    out.append(b"\xff\xd9")
    return b"".join(out)


def payload_of(image: Image) -> bytes:
    """The bytes that ``encode`` was given, and the filling of its last unit."""
    coef = np.concatenate([c.coef for c in image.components])
    out = np.where(coef > 0, coef, coef + 255)
    out[:, 0] = coef[:, 0] + 128
    return out.astype(np.uint8).tobytes()
