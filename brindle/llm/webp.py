"""Lossless WebP: a reader for the whole VP8L format, a writer, and byte payloads as media columns.

Pixels are uint8 arrays of shape (height, width, 4), in the order red, green, blue, alpha.
"""

from __future__ import annotations

import hashlib
import heapq
import math
import struct
from collections.abc import Iterator
from functools import lru_cache
from zlib import crc32

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keep, text_bytes

# Fixed values of the format.
CODE_LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
NEAR = (
    (0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2), (2, 1), (-2, 1), (2, 2), (-2, 2), (0, 3), (3, 0), (1, 3), (-1, 3), (3, 1), (-3, 1), (2, 3), (-2, 3),
    (3, 2), (-3, 2), (0, 4), (4, 0), (1, 4), (-1, 4), (4, 1), (-4, 1), (3, 3), (-3, 3), (2, 4), (-2, 4), (4, 2), (-4, 2), (0, 5), (3, 4), (-3, 4), (4, 3), (-4, 3), (5, 0),
    (1, 5), (-1, 5), (5, 1), (-5, 1), (2, 5), (-2, 5), (5, 2), (-5, 2), (4, 4), (-4, 4), (3, 5), (-3, 5), (5, 3), (-5, 3), (0, 6), (6, 0), (1, 6), (-1, 6), (6, 1), (-6, 1),
    (2, 6), (-2, 6), (6, 2), (-6, 2), (4, 5), (-4, 5), (5, 4), (-5, 4), (3, 6), (-3, 6), (6, 3), (-6, 3), (0, 7), (7, 0), (1, 7), (-1, 7), (5, 5), (-5, 5), (7, 1), (-7, 1),
    (4, 6), (-4, 6), (6, 4), (-6, 4), (2, 7), (-2, 7), (7, 2), (-7, 2), (3, 7), (-3, 7), (7, 3), (-7, 3), (5, 6), (-5, 6), (6, 5), (-6, 5), (8, 0), (4, 7), (-4, 7), (7, 4),
    (-7, 4), (8, 1), (8, 2), (6, 6), (-6, 6), (8, 3), (5, 7), (-5, 7), (7, 5), (-7, 5), (8, 4), (6, 7), (-6, 7), (7, 6), (-7, 6), (8, 5), (7, 7), (-7, 7), (8, 6), (8, 7),
)
CACHE_FACTOR = 0x1E35A7BD
PREDICTOR, CROSS_COLOR, SUBTRACT_GREEN, COLOR_INDEXING = range(4)
LITERALS, LENGTHS, DISTANCES = 256, 24, 40
MOST = 1 << 14  # pixels a side


# --- reading ---


class _Bits:
    def __init__(self, data: bytes, at: int = 0):
        self.data, self.at, self.end = data, at, 8 * len(data)

    def read(self, n: int) -> int:
        at = self.at
        if at + n > self.end:
            raise ValueError("the image data end too early")
        self.at = at + n
        return (int.from_bytes(self.data[at >> 3 : (at + n + 7) >> 3], "little") >> (at & 7)) & ((1 << n) - 1)

    def peek(self, n: int) -> int:
        at = self.at
        return (int.from_bytes(self.data[at >> 3 : (at + n + 7) >> 3], "little") >> (at & 7)) & ((1 << n) - 1)


def canonical(lengths: tuple[int, ...]) -> list[int]:
    """The code of each symbol, its first bit lowest."""
    code, out, counts = 0, [0] * len(lengths), [0] * 17
    for n in lengths:
        counts[n] += 1
    counts[0], first = 0, [0] * 17
    for n in range(1, 17):
        code = (code + counts[n - 1]) << 1
        first[n] = code
    for s, n in enumerate(lengths):
        if n:
            out[s] = int(format(first[n], f"0{n}b")[::-1], 2)
            first[n] += 1
    return out


class _Prefix:
    """A prefix code: a table over its longest code's bits of symbol and length."""

    def __init__(self, lengths: tuple[int, ...]):
        self.lengths, used = lengths, [s for s, n in enumerate(lengths) if n]
        if len(used) <= 1:  # a single symbol takes no bits
            self.bits, self.symbol, self.length = 0, [used[0] if used else 0], [0]
            return
        if sum(2.0 ** -lengths[s] for s in used) != 1.0:
            raise ValueError("an incomplete or oversubscribed prefix code")
        self.bits = max(lengths)
        self.symbol, self.length = [0] * (1 << self.bits), [0] * (1 << self.bits)
        for s, code in enumerate(canonical(lengths)):
            if n := lengths[s]:
                for k in range(code, 1 << self.bits, 1 << n):
                    self.symbol[k], self.length[k] = s, n

    def read(self, bits: _Bits) -> int:
        k = bits.peek(self.bits)
        bits.at += self.length[k]
        return self.symbol[k]


@lru_cache(64)
def _prefix(lengths: tuple[int, ...]) -> _Prefix:
    return _Prefix(lengths)


def _read_prefix(bits: _Bits, size: int) -> _Prefix:
    lengths = [0] * size
    if bits.read(1):  # simple
        two, wide = bits.read(1), bits.read(1)
        symbols = [bits.read(8 if wide else 1)] + ([bits.read(8)] if two else [])
        for s in symbols:
            if s < size:
                lengths[s] = 1
        return _prefix(tuple(lengths))
    of_lengths = [0] * 19
    for k in CODE_LENGTH_ORDER[: 4 + bits.read(4)]:
        of_lengths[k] = bits.read(3)
    code = _prefix(tuple(of_lengths))
    left = 2 + bits.read(2 + 2 * bits.read(3)) if bits.read(1) else size
    s, last = 0, 8
    while s < size and left:
        left -= 1
        k = code.read(bits)
        if k < 16:
            lengths[s] = k
            s, last = s + 1, k or last
        else:
            value, n = (last, 3 + bits.read(2)) if k == 16 else (0, 3 + bits.read(3)) if k == 17 else (0, 11 + bits.read(7))
            if s + n > size:
                raise ValueError("code lengths beyond the alphabet")
            lengths[s : s + n] = [value] * n
            s += n
    return _prefix(tuple(lengths))


def _copied(bits: _Bits, k: int) -> int:
    if k < 4:
        return k + 1
    extra = (k - 2) >> 1
    return ((2 + (k & 1)) << extra) + bits.read(extra) + 1


def _read_image(bits: _Bits, width: int, height: int, main: bool) -> np.ndarray:
    """An entropy-coded image as uint32 ARGB, in scan order."""
    cache_bits = bits.read(4) if bits.read(1) else 0
    if cache_bits > 11:
        raise ValueError("too large a colour cache")
    groups, tile, of_tile, across = 1, 0, None, 0
    if main and bits.read(1):
        tile = bits.read(3) + 2
        across = -(-width // (1 << tile))
        of_tile = (_read_image(bits, across, -(-height // (1 << tile)), False) >> 8) & 0xFFFF
        groups = int(of_tile.max()) + 1
    size = LITERALS + LENGTHS + ((1 << cache_bits) if cache_bits else 0)
    codes = [[_read_prefix(bits, n) for n in (size, 256, 256, 256, DISTANCES)] for _ in range(groups)]
    if groups == 1 and not cache_bits and (code := codes[0])[0].bits and not any(code[0].lengths[256:]) and code[0].lengths[:256] == code[1].lengths == code[2].lengths == code[3].lengths:
        return _read_literals(bits, code[1].lengths, width * height)
    return _read_pixels(bits, width, height, codes, cache_bits, tile, across, of_tile)


@lru_cache(16)
def _tables(lengths: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray, int]:
    code = _prefix(lengths)
    return np.array(code.symbol, np.uint8), np.array(code.length, np.uint8), code.bits


def _read_literals(bits: _Bits, lengths: tuple[int, ...], pixels: int, part: int = 1 << 16) -> np.ndarray:
    """Pixels that are all literals with one code for all channels: looks up a code at every bit, then follows the chain of those that count."""
    symbol, length, most = _tables(lengths)
    data = np.frombuffer(bits.data + b"\0\0\0", np.uint8)
    total, done = 4 * pixels, 0
    out = np.empty(total, np.uint8)
    while done < total:
        first = bits.at >> 3
        b = data[first : first + part + 3].astype(np.uint32)
        if len(b) < 4:
            raise ValueError("the image data end too early")
        window = (((b[:-3] | b[1:-2] << 8 | b[2:-1] << 16)[:, None] >> np.arange(8, dtype=np.uint32)) & ((1 << most) - 1)).astype(np.uint16).ravel()
        steps, p, at = length[window].tobytes(), bits.at & 7, []
        add, stop, left = at.append, len(window), total - done
        while p < stop and left:
            add(p)
            p += steps[p]
            left -= 1
        out[done : done + len(at)] = symbol[window[at]]
        done += len(at)
        bits.at = 8 * first + p
    if bits.at > bits.end:
        raise ValueError("the image data end too early")
    g, r, b, a = (out[k::4].astype(np.uint32) for k in range(4))
    return a << 24 | r << 16 | g << 8 | b


def _read_pixels(bits: _Bits, width: int, height: int, codes: list, cache_bits: int, tile: int, across: int, of_tile) -> np.ndarray:
    out, total, cache = [], width * height, [0] * (1 << cache_bits if cache_bits else 0)
    shift, kept = 32 - cache_bits, 0
    while len(out) < total:
        n = len(out)
        code = codes[0 if of_tile is None else int(of_tile[(n // width >> tile) * across + (n % width >> tile)])]
        s = code[0].read(bits)
        if s < LITERALS:
            r, b, a = code[1].read(bits), code[2].read(bits), code[3].read(bits)
            out.append(a << 24 | r << 16 | s << 8 | b)
        elif s < LITERALS + LENGTHS:
            length = _copied(bits, s - LITERALS)
            d = _copied(bits, code[4].read(bits))
            if d > len(NEAR):
                d -= len(NEAR)
            else:
                x, y = NEAR[d - 1]
                d = max(1, x + y * width)
            if d > n or n + length > total:
                raise ValueError("a back-reference outside the image")
            for _ in range(length):
                out.append(out[-d])
        else:
            while kept < n:
                cache[(CACHE_FACTOR * out[kept] & 0xFFFFFFFF) >> shift] = out[kept]
                kept += 1
            out.append(cache[s - LITERALS - LENGTHS])
    return np.array(out, np.uint32)


def _average(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a + b) >> 1


def _predict(mode: int, l: np.ndarray, t: np.ndarray, tl: np.ndarray, tr: np.ndarray) -> np.ndarray:  # noqa: E741
    """The prediction from the left, top, top left and top right pixels (int arrays of four channels)."""
    if mode == 1:
        return l
    if mode == 2:
        return t
    if mode == 3:
        return tr
    if mode == 4:
        return tl
    if mode == 5:
        return _average(_average(l, tr), t)
    if mode == 6:
        return _average(l, tl)
    if mode == 7:
        return _average(l, t)
    if mode == 8:
        return _average(tl, t)
    if mode == 9:
        return _average(t, tr)
    if mode == 10:
        return _average(_average(l, tl), _average(t, tr))
    if mode == 11:
        return l if np.abs(t - tl).sum() < np.abs(l - tl).sum() else t
    if mode == 12:
        return np.clip(l + t - tl, 0, 255)
    if mode == 13:
        m = _average(l, t)
        d = m - tl
        return np.clip(m + np.sign(d) * (np.abs(d) >> 1), 0, 255)
    return np.array([0, 0, 0, 255])


def _neighbours(x: int, y: int, px: np.ndarray, mode: int) -> np.ndarray:
    """The prediction at (x, y) from the pixels before it; px: (height, width, 4) ints."""
    if x == 0 and y == 0:
        return np.array([0, 0, 0, 255])
    if y == 0:
        return px[0, x - 1]
    if x == 0:
        return px[y - 1, 0]
    right = px[y - 1, x + 1] if x + 1 < px.shape[1] else px[y, 0]
    return _predict(mode, px[y, x - 1], px[y - 1, x], px[y - 1, x - 1], right)


def _tile(values: np.ndarray, width: int, height: int, size: int) -> np.ndarray:
    """A value for each pixel from one for each tile."""
    across = -(-width // (1 << size))
    return np.repeat(np.repeat(values.reshape(-1, across), 1 << size, 0), 1 << size, 1)[:height, :width]


def _undo_predictor(px: np.ndarray, modes: np.ndarray) -> np.ndarray:
    out = px.astype(np.int64)
    height, width = modes.shape
    if (modes == 1).all():  # left only: sums along rows
        out[0, 0, 3] += 255
        out[:, 0] = np.cumsum(out[:, 0], 0)
        return (np.cumsum(out, 1) & 255).astype(np.uint8)
    for y in range(height):
        for x in range(width):
            out[y, x] = (out[y, x] + _neighbours(x, y, out, int(modes[y, x]))) & 255
    return out.astype(np.uint8)


def _delta(t: np.ndarray, c: np.ndarray) -> np.ndarray:
    return (t.astype(np.int8).astype(np.int32) * c.astype(np.int8).astype(np.int32)) >> 5


def _cross(px: np.ndarray, elements: np.ndarray, sign: int) -> np.ndarray:
    """Applies (sign -1) or inverts (1) the colour transform; elements: ARGB of each pixel's tile."""
    out = px.copy()
    g, red = px[..., 1], px[..., 0].astype(np.int32)
    to_red, to_blue, red_blue = (((elements >> s) & 255).astype(np.uint8) for s in (0, 8, 16))
    new_red = ((red + sign * _delta(to_red, g)) & 255).astype(np.uint8)
    of = new_red if sign == 1 else px[..., 0]
    out[..., 0] = new_red
    out[..., 2] = (px[..., 2].astype(np.int32) + sign * (_delta(to_blue, g) + _delta(red_blue, of))) & 255
    return out


def _planes(argb: np.ndarray, width: int) -> np.ndarray:
    return np.stack([(argb >> s & 255).astype(np.uint8) for s in (16, 8, 0, 24)], -1).reshape(-1, width, 4)


def _argb(px: np.ndarray) -> np.ndarray:
    r, g, b, a = (px[..., k].astype(np.uint32).ravel() for k in range(4))
    return a << 24 | r << 16 | g << 8 | b


def chunks(data: bytes) -> dict[bytes, bytes]:
    """The chunks of a RIFF WebP file."""
    if data[:4] != b"RIFF" or data[8:12] != b"WEBP":
        raise ValueError("no WebP file")
    out, at = {}, 12
    while at + 8 <= len(data):
        name, n = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
        out.setdefault(name, data[at + 8 : at + 8 + n])
        at += 8 + n + (n & 1)
    return out


def decode(data: bytes) -> np.ndarray:
    """The pixels of a lossless WebP file."""
    stream = chunks(data).get(b"VP8L")
    if not stream or stream[0] != 0x2F:
        raise ValueError("no lossless image")
    bits = _Bits(stream, 8)
    width, height = bits.read(14) + 1, bits.read(14) + 1
    bits.read(1)
    if bits.read(3):
        raise ValueError("an unknown version")
    coded, undo, seen = width, [], set()
    while bits.read(1):
        kind = bits.read(2)
        if kind in seen:
            raise ValueError("a repeated transform")
        seen.add(kind)
        if kind in (PREDICTOR, CROSS_COLOR):
            size = bits.read(3) + 2
            undo.append((kind, size, _read_image(bits, -(-coded // (1 << size)), -(-height // (1 << size)), False), coded))
        elif kind == COLOR_INDEXING:
            n = bits.read(8) + 1
            table = np.cumsum(_planes(_read_image(bits, n, 1, False), n)[0].astype(np.int64), 0) & 255
            pack = 3 if n <= 2 else 2 if n <= 4 else 1 if n <= 16 else 0
            undo.append((kind, pack, table.astype(np.uint8), coded))
            coded = -(-coded // (1 << pack))
        else:
            undo.append((kind, 0, None, coded))
    px = _planes(_read_image(bits, coded, height, True), coded)
    for kind, size, what, wide in reversed(undo):
        if kind == PREDICTOR:
            px = _undo_predictor(px, _tile((what >> 8) & 15, wide, height, size))
        elif kind == CROSS_COLOR:
            px = _cross(px, _tile(what, wide, height, size), 1)
        elif kind == SUBTRACT_GREEN:
            px = px.copy()
            px[..., 0] += px[..., 1]
            px[..., 2] += px[..., 1]
        else:
            index = px[..., 1]
            if size:
                each = 8 >> size
                index = ((index[..., None] >> (np.arange(1 << size) * each)) & ((1 << each) - 1)).reshape(height, -1)[:, :wide]
            table = np.zeros((256, 4), np.uint8)
            table[: len(what)] = what
            px = table[index]
    return px


# --- writing ---


class _Out:
    """Bits, lowest first; those that are written stay in one integer up to a bound."""

    def __init__(self):
        self.value, self.bits, self.done = 0, 0, bytearray()

    def write(self, value: int, n: int) -> None:
        self.value |= value << self.bits
        self.bits += n
        if self.bits > 1 << 14:
            whole = self.bits >> 3
            self.done += (self.value & (1 << 8 * whole) - 1).to_bytes(whole, "little")
            self.value >>= 8 * whole
            self.bits &= 7

    def bytes(self) -> bytes:
        return bytes(self.done) + self.value.to_bytes((self.bits + 7) >> 3, "little")


def code_lengths(weights: list[int], most: int) -> tuple[int, ...]:
    """Huffman's code lengths, none over most: small weights are raised until that holds."""
    used = [s for s, w in enumerate(weights) if w]
    if len(used) < 2:
        return tuple(int(w > 0) for w in weights)
    floor = 1
    while True:
        heap = [(max(weights[s], floor), s, (s,)) for s in used]
        heapq.heapify(heap)
        lengths = [0] * len(weights)
        while len(heap) > 1:
            (a, i, x), (b, _, y) = heapq.heappop(heap), heapq.heappop(heap)
            for s in x + y:
                lengths[s] += 1
            heapq.heappush(heap, (a + b, i, x + y))
        if max(lengths) <= most:
            return tuple(lengths)
        floor *= 2


def _write_prefix(out: _Out, lengths: tuple[int, ...]) -> list[tuple[int, int]]:
    """Writes a prefix code; returns (code, length) of each symbol."""
    used = [s for s, n in enumerate(lengths) if n]
    if len(used) <= 2 and all(s < 256 for s in used):
        used = used or [0]
        out.write(1, 1)
        out.write(len(used) - 1, 1)
        out.write(1, 1)
        for s in used:
            out.write(s, 8)
        codes = {s: (k, len(used) - 1) for k, s in enumerate(used)}
        return [codes.get(s, (0, 0)) for s in range(len(lengths))]
    steps, s, last = [], 0, 8
    while s < len(lengths):
        run = 1
        while s + run < len(lengths) and lengths[s + run] == lengths[s]:
            run += 1
        if lengths[s] == 0 and run >= 3:
            n = min(run, 138)
            steps.append((17, n - 3, 3) if n <= 10 else (18, n - 11, 7))
        elif lengths[s] and lengths[s] == last and run >= 3:
            n = min(run, 6)
            steps.append((16, n - 3, 2))
        else:
            n = 1
            steps.append((lengths[s], 0, 0))
        last = lengths[s] or last
        s += n
    counts = [0] * 19
    for k, _, _ in steps:
        counts[k] += 1
    of_lengths = code_lengths(counts, 7)
    out.write(0, 1)
    n = max(4, max(i for i, k in enumerate(CODE_LENGTH_ORDER) if of_lengths[k]) + 1)
    out.write(n - 4, 4)
    for k in CODE_LENGTH_ORDER[:n]:
        out.write(of_lengths[k], 3)
    out.write(0, 1)
    codes, free = canonical(of_lengths), sum(x > 0 for x in of_lengths) == 1
    for k, extra, bits in steps:
        out.write(codes[k], 0 if free else of_lengths[k])
        out.write(extra, bits)
    single = len(used) == 1
    return [(c, 0 if single else n) for c, n in zip(canonical(lengths), lengths, strict=True)]


def _split(value: int) -> tuple[int, int, int]:
    """A length's or distance's prefix symbol, extra value and extra bits."""
    if value <= 4:
        return value - 1, 0, 0
    v = value - 1
    high = v.bit_length() - 1
    extra = high - 1
    second = (v >> extra) & 1
    return 2 * high + second, v & ((1 << extra) - 1), extra


@lru_cache(64)
def _near_codes(width: int) -> dict[int, int]:
    """The short code of each distance that has one."""
    codes: dict[int, int] = {}
    for k, (x, y) in enumerate(NEAR, 1):
        codes.setdefault(max(1, x + y * width), k)
    return codes


def _write_image(out: _Out, argb: list[int], width: int, cache_bits: int = 0, copies: bool = False, groups: tuple[int, list[int]] | None = None) -> None:
    """An entropy-coded image; groups (main images only, None: none, () : not main): tile size and the group of each tile."""
    out.write(1 if cache_bits else 0, 1)
    if cache_bits:
        out.write(cache_bits, 4)
    tile, of_tile, across = 0, [0], 1
    if groups is not None:
        out.write(1 if groups else 0, 1)
        if groups:
            tile, of_tile = groups
            out.write(tile - 2, 3)
            across = -(-width // (1 << tile))
            _write_image(out, [g << 8 for g in of_tile], across)
    tokens, cache, seen, i, total = [], {}, {}, 0, len(argb)
    flat = np.array(argb, np.uint64)
    slots = ((flat * np.uint64(CACHE_FACTOR) & np.uint64(0xFFFFFFFF)) >> np.uint64(32 - cache_bits)).tolist() if cache_bits else []
    near = _near_codes(width)
    # starts of copies are looked up by a hash of three pixels; copies are compared pixel by pixel
    keys = ((flat[:-2] * np.uint64(0x9E3779B97F4A7C15) ^ flat[1:-1]) * np.uint64(0xD6E8FEB86659FD93) ^ flat[2:]).tolist() if copies and total > 2 else []
    while i < total:
        n = 0
        if i < len(keys):
            j = seen.get(keys[i])
            if j is not None:
                most = min(4096, total - i)
                while n < most and argb[j + n] == argb[i + n]:
                    n += 1
        group = of_tile[(i // width >> tile) * across + (i % width >> tile)] if tile else 0
        if n >= 3:
            d = i - j
            tokens.append((group, "copy", _split(n), _split(near.get(d, d + len(NEAR)))))
        elif cache_bits and cache.get(slots[i]) == argb[i]:
            n = 1
            tokens.append((group, "cache", slots[i], None))
        else:
            n = 1
            tokens.append((group, "pixel", argb[i], None))
        seen.update(zip(keys[i : i + n], range(i, i + n), strict=False))
        if cache_bits:
            cache.update(zip(slots[i : i + n], argb[i : i + n], strict=True))
        i += n
    sizes = (LITERALS + LENGTHS + ((1 << cache_bits) if cache_bits else 0), 256, 256, 256, DISTANCES)
    counts = [[[0] * n for n in sizes] for _ in range(max(of_tile) + 1)]
    symbols = []
    for group, kind, x, y in tokens:
        if kind == "pixel":
            parts = [(0, x >> 8 & 255, 0, 0), (1, x >> 16 & 255, 0, 0), (2, x & 255, 0, 0), (3, x >> 24, 0, 0)]
        elif kind == "cache":
            parts = [(0, LITERALS + LENGTHS + x, 0, 0)]
        else:
            parts = [(0, LITERALS + x[0], x[1], x[2]), (4, *y)]
        for k, s, _, _ in parts:
            counts[group][k][s] += 1
        symbols.append((group, parts))
    codes = [[_write_prefix(out, code_lengths(c, 15)) for c in g] for g in counts]
    for group, parts in symbols:
        for k, s, extra, bits in parts:
            out.write(*codes[group][k][s])
            out.write(extra, bits)


def riff(stream: bytes, extra: bytes = b"") -> bytes:
    body = b"WEBPVP8L" + struct.pack("<I", len(stream)) + stream + b"\0" * (len(stream) & 1) + extra
    return b"RIFF" + struct.pack("<I", len(body)) + body


def encode(px: np.ndarray, predictor: tuple[int, list[int]] | None = None, cross: tuple[int, list[int]] | None = None, subtract_green: bool = False, palette: bool = False, cache_bits: int = 0, copies: bool = False, groups: tuple[int, list[int]] | None = None, extra: bytes = b"") -> bytes:
    """A lossless WebP file of pixels: every transform and coding of the format on request.

    predictor: tile size (2 to 9) and mode of each tile; cross: tile size and element of each tile; groups:
    tile size and prefix code group of each tile of the coded image.
    """
    height, width = px.shape[:2]
    out = _Out()
    for value, n in ((0x2F, 8), (width - 1, 14), (height - 1, 14), (1, 1), (0, 3)):
        out.write(value, n)
    if palette:
        table = np.unique(_argb(px))
        index = np.searchsorted(table, _argb(px)).reshape(height, width)
        out.write(1, 1)
        out.write(COLOR_INDEXING, 2)
        out.write(len(table) - 1, 8)
        rows = _planes(table, len(table))[0]
        _write_image(out, _argb((rows - np.concatenate([np.zeros((1, 4), np.uint8), rows[:-1]]))[None]).tolist(), len(table))
        pack = 3 if len(table) <= 2 else 2 if len(table) <= 4 else 1 if len(table) <= 16 else 0
        padded = np.pad(index, ((0, 0), (0, -width % (1 << pack)))).reshape(height, -1, 1 << pack)
        green = (padded << (np.arange(1 << pack) * (8 >> pack))).sum(-1)
        width = green.shape[1]
        px = np.zeros((height, width, 4), np.uint8)
        px[..., 1], px[..., 3] = green, 255
    if subtract_green:
        out.write(1, 1)
        out.write(SUBTRACT_GREEN, 2)
        px = px.copy()
        px[..., 0] -= px[..., 1]
        px[..., 2] -= px[..., 1]
    if cross:
        out.write(1, 1)
        out.write(CROSS_COLOR, 2)
        out.write(cross[0] - 2, 3)
        _write_image(out, cross[1], -(-width // (1 << cross[0])))
        px = _cross(px, _tile(np.array(cross[1], np.uint32), width, height, cross[0]), -1)
    if predictor:
        size, modes = predictor
        out.write(1, 1)
        out.write(PREDICTOR, 2)
        out.write(size - 2, 3)
        _write_image(out, [0xFF000000 | m << 8 for m in modes], -(-width // (1 << size)))
        each, whole = _tile(np.array(modes), width, height, size), px.astype(np.int64)
        px = np.array([[(whole[y, x] - _neighbours(x, y, whole, int(each[y, x]))) & 255 for x in range(width)] for y in range(height)], np.uint8)
    out.write(0, 1)
    _write_image(out, _argb(px).tolist(), width, cache_bits, copies, groups or ())
    return riff(out.bytes(), extra)


# --- bytes as media ---


def _weight(byte: int) -> int:
    """How often a byte is expected in text, roughly."""
    if byte == 32:
        return 500
    if byte >= 128:
        return 150 if byte == 195 else 12 if 160 <= byte < 192 else 2
    if 97 <= byte <= 122:
        return 160 if chr(byte) in "aeinorst" else 40
    return 25 if byte in (10, 33, 44, 46) else 8 if byte in (0, 124) or 48 <= byte <= 90 else 2


@lru_cache(1)
def _text_code() -> tuple:
    """(header bits after the size, their number, code and length of each byte): one code for all four channels, the same for all payloads."""
    lengths = code_lengths([_weight(b) for b in range(256)], 11)
    out = _Out()
    for value, n in ((1, 1), (0, 3), (0, 1), (0, 1), (0, 1)):  # alpha; version; no transform, colour cache, groups
        out.write(value, n)
    codes = _write_prefix(out, lengths + (0,) * LENGTHS)
    for _ in range(3):
        _write_prefix(out, lengths)
    _write_prefix(out, (0,) * DISTANCES)
    return out.value, out.bits, np.array([c for c, _ in codes[:256]], np.uint64), np.array([n for _, n in codes[:256]], np.uint64)


def repetition(payload: bytes) -> str:
    """How a payload's pixels repeat: "few" different ones (a palette pays), often the same "pairs" (back-references and a colour cache pay), or "" for neither."""
    p = np.frombuffer(payload, np.uint32)
    if len(p) < 64:
        return ""
    if np.count_nonzero(np.diff(np.sort(p))) < min(256, len(p) // 4):
        return "few"
    pairs = p[:-1].astype(np.uint64) << np.uint64(32) | p[1:]
    return "pairs" if np.count_nonzero(np.diff(np.sort(pairs))) < len(p) // 2 else ""


def encode_bytes(payload: bytes) -> bytes:
    """A lossless WebP file whose pixels, row by row, are the payload's bytes; its length, a multiple of 64, stands in a chunk of its own.

    Rows have 16 pixels or, for a payload beyond a megabyte, as many more as the format's greatest height
    needs. Payloads beyond the format's 2^28 pixels are rejected. Repetitive payloads are written with a
    palette or without, back-references and a colour cache, and codes of their own; others as literals
    with one constant code.
    """
    pixels = len(payload) // 4
    width = 16 * max(1, math.ceil(pixels / (16 * (MOST - 1))))
    if width > MOST:
        raise ValueError(f"{len(payload)} bytes don't fit an image")
    height = -(-pixels // width)
    length = b"BYTE" + struct.pack("<IQ", 8, len(payload))
    if kind := repetition(payload):
        px = np.frombuffer(payload + b"\0" * (4 * width * height - len(payload)), np.uint8).reshape(height, width, 4)
        return encode(px, palette=kind == "few", cache_bits=4 if kind == "few" else 9, copies=True, extra=length)
    head, n, codes, lengths = _text_code()
    start = (0x2F | (width - 1) << 8 | (height - 1) << 22) | head << 36
    at = 36 + n
    raw = np.frombuffer(payload + b"\0" * (4 * width * height - len(payload)), np.uint8).reshape(-1, 4)
    value, used = codes[raw[:, 1]], lengths[raw[:, 1]]  # green comes first
    for k in (0, 2, 3):
        value |= codes[raw[:, k]] << used
        used = used + lengths[raw[:, k]]
    offset = at + np.concatenate([[0], np.cumsum(used.astype(np.int64))])
    word, shift = offset[:-1] >> 6, (offset[:-1] & 63).astype(np.uint64)
    out = np.zeros((int(offset[-1]) + 63) // 64 + 1, np.uint64)
    cuts = np.flatnonzero(np.diff(word, prepend=-1))
    out[word[cuts]] += np.add.reduceat(value << shift, cuts)
    over = np.where(shift > 0, value >> (np.uint64(64) - np.maximum(shift, 1)), 0).astype(np.uint64)
    out[word[cuts] + 1] += np.add.reduceat(over, cuts)
    stream = bytearray(out.tobytes()[: (int(offset[-1]) + 7) >> 3])
    first = int.from_bytes(stream[: (at + 7) >> 3], "little") | start
    stream[: (at + 7) >> 3] = first.to_bytes((at + 7) >> 3, "little")
    return riff(bytes(stream), length)


def decode_bytes(data: bytes) -> tuple[np.ndarray, bytes]:
    """The pixels of encode_bytes' file, and the payload."""
    px = decode(data)
    return px, px.tobytes()[: struct.unpack("<Q", chunks(data)[b"BYTE"])[0]]


def feature(px: np.ndarray) -> str:
    """Size, mean of each channel in hundredths, mean step between neighbours in a row in hundredths, and number of distinct samples."""
    flat = px.reshape(-1, 4)
    means = flat.sum(0, dtype=np.int64) * 100 // len(flat)
    steps = np.abs(np.diff(px.astype(np.int16), axis=1)).sum(dtype=np.int64) * 100 // max(1, px[:, 1:].size)
    return f"{px.shape[1]}x{px.shape[0]};" + ",".join(map(str, means)) + f";{steps};{len(np.flatnonzero(np.bincount(flat.ravel(), minlength=256)))}"


def store_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, media) for each row of docs, in the shared folder: the text's UTF-8 (null: empty), with bytes 0 up to a positive multiple of 64, as a lossless WebP file.

    Repeated rows are kept; an empty table gives no rows. Extra columns are ignored.
    """

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                texts = text_bytes(part.column(1))
                media = [encode_bytes(t + b"\0" * (-len(t) % 64 or (0 if t else 64))) for t in texts]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array(media, pa.binary())], names=["id", "n_bytes", "media"])

    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return keep(src.mapInArrow(run, f"id {src.schema['id'].dataType.simpleString()}, n_bytes long, media binary"))


def read_media(stored: DataFrame, pixels: bool = True) -> DataFrame:
    """Decodes store_texts' media: (id, n_bytes, width, height, pixels, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature).

    pixels are the samples row by row (null when pixels is False); the payload's columns are computed from them.
    """

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        schema = pa.schema([("width", pa.int32()), ("height", pa.int32()), ("pixels", pa.binary()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())])
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part, rows = batch.slice(at, 500), []
                for data in part.column(2).to_pylist():
                    px, payload = decode_bytes(data)
                    rows.append((px.shape[1], px.shape[0], px.tobytes() if pixels else None, len(payload), hashlib.sha256(payload).hexdigest(), crc32(payload[-64:]), len(data), hashlib.sha256(data).hexdigest(), feature(px)))
                columns = [pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *columns], names=["id", "n_bytes", *schema.names])

    return stored.mapInArrow(run, f"id {stored.schema['id'].dataType.simpleString()}, n_bytes long, width int, height int, pixels binary, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
