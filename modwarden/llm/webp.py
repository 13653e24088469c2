"""Lossless WebP: a complete decoder of the lossless bitstream, and the encoder that stores bytes as grey samples.

The decoder reads prefix codes, back-references, the colour cache and meta prefix images and inverts the
predictor, cross-colour, subtract-green and palette transforms. Codes are looked up in tables of their bits. Symbols of
images in which only green varies are read for many images at once: looked up at every bit, and walked from the first.

A payload becomes one image of 64 samples a row per MiB, a sample a grey pixel; a payload of several MiB becomes
several images in a row, so memory stays bounded. The encoder subtracts green, which leaves one channel, looks for
earlier occurrences of each sample's next four, and writes literals and back-references in prefix codes of the
frequencies of each image. A colour cache or several code groups cannot shorten images of one channel and are not
written. Equal payloads give equal bytes.

Defined results: a null or empty text is stored as 64 zero bytes; extra columns pass through.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import cached_property, lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

from modwarden.llm import arrays as ar

WIDTH, ROWS = 64, 16384
# Fixed values of the format.
LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
NEAR = (
    (0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2), (2, 1), (-2, 1), (2, 2), (-2, 2), (0, 3), (3, 0), (1, 3), (-1, 3),
    (3, 1), (-3, 1), (2, 3), (-2, 3), (3, 2), (-3, 2), (0, 4), (4, 0), (1, 4), (-1, 4), (4, 1), (-4, 1), (3, 3), (-3, 3), (2, 4), (-2, 4),
    (4, 2), (-4, 2), (0, 5), (3, 4), (-3, 4), (4, 3), (-4, 3), (5, 0), (1, 5), (-1, 5), (5, 1), (-5, 1), (2, 5), (-2, 5), (5, 2), (-5, 2),
    (4, 4), (-4, 4), (3, 5), (-3, 5), (5, 3), (-5, 3), (0, 6), (6, 0), (1, 6), (-1, 6), (6, 1), (-6, 1), (2, 6), (-2, 6), (6, 2), (-6, 2),
    (4, 5), (-4, 5), (5, 4), (-5, 4), (3, 6), (-3, 6), (6, 3), (-6, 3), (0, 7), (7, 0), (1, 7), (-1, 7), (5, 5), (-5, 5), (7, 1), (-7, 1),
    (4, 6), (-4, 6), (6, 4), (-6, 4), (2, 7), (-2, 7), (7, 2), (-7, 2), (3, 7), (-3, 7), (7, 3), (-7, 3), (5, 6), (-5, 6), (6, 5), (-6, 5),
    (8, 0), (4, 7), (-4, 7), (7, 4), (-7, 4), (8, 1), (8, 2), (6, 6), (-6, 6), (8, 3), (5, 7), (-5, 7), (7, 5), (-7, 5), (8, 4), (6, 7),
    (-6, 7), (7, 6), (-7, 6), (8, 5), (7, 7), (-7, 7), (8, 6), (8, 7),
)
CACHE_FACTOR = 0x1E35A7BD
LITERALS, LENGTHS, DISTANCES = 256, 24, 40
LONGEST_CODE = 15
# Bits of each symbol in the code in which the encoder writes code lengths: short for those of texts.
LENGTH_BITS = (3, 7, 7, 5, 4, 4, 3, 3, 3, 3, 4, 7, 7, 7, 7, 7, 7, 4, 5)
# Shortest and longest back-reference, and the farthest one beside the numbers of near places.
SHORTEST, LONGEST, FARTHEST = 6, 4096, (1 << 20) - 120
# Samples that are encoded or read together, if not those of one image, and bits and images that are looked up at once.
TOGETHER, BITS_AT_ONCE, IMAGES_AT_ONCE = 1 << 17, 1 << 17, 1024
# Extra bits and least value of each prefix symbol of a length or distance.
_EXTRA = np.array([max(0, (s - 2) >> 1) for s in range(DISTANCES)], np.uint64)
_LEAST = np.array([s + 1 if s < 4 else ((2 + (s & 1)) << ((s - 2) >> 1)) + 1 for s in range(DISTANCES)], np.int64)
_REVERSED = np.packbits(np.unpackbits(np.arange(1 << 16, dtype=np.uint16).view(np.uint8).reshape(-1, 2), axis=1, bitorder="little"), axis=1).astype(np.int64)
_REVERSED = (_REVERSED[: 1 << 15, 0] << 8 | _REVERSED[: 1 << 15, 1]) >> 1
PREDICTOR, CROSS_COLOUR, SUBTRACT_GREEN, PALETTE = range(4)


class Bits:
    """Bits of a byte string, lowest bit of each byte first."""

    def __init__(self, data: bytes):
        self.data, self.at, self.end = data, 0, 8 * len(data)

    def read(self, n: int) -> int:
        if not n:
            return 0
        if self.at + n > self.end:
            raise ValueError("the image ends early")
        first = self.at >> 3
        value = int.from_bytes(self.data[first : (self.at + n + 7) >> 3], "little") >> (self.at & 7)
        self.at += n
        return value & ((1 << n) - 1)

    def peek(self) -> int:
        """At least 17 of the next bits; those past the end are zero."""
        first = self.at >> 3
        return int.from_bytes(self.data[first : first + 3], "little") >> (self.at & 7)

    def skip(self, n: int) -> None:
        self.at += n
        if self.at > self.end:
            raise ValueError("the image ends early")


class Code:
    """A canonical prefix code; a single symbol takes no bits."""

    def __init__(self, lengths: dict[int, int]):
        # ``length << 16 | symbol``, in the order of the code.
        used = np.sort(np.array([n << 16 | s for s, n in lengths.items() if n] or [1 << 16], np.int64))
        n, symbols = used >> 16, used & 0xFFFF
        self.only = int(symbols[0]) if len(used) == 1 else None
        self.width = 0 if len(used) == 1 else int(n[-1])
        # ``symbol << 4 | length`` by the next ``width`` bits, lowest first.
        self.entries = symbols << 4
        if self.only is None:
            share = 1 << (self.width - n)
            if share.sum() != 1 << self.width:
                raise ValueError("a prefix code is not complete")
            self.entries = np.repeat(symbols << 4 | n, share)[_REVERSED[: 1 << self.width] >> (LONGEST_CODE - self.width)]
        self.mask = (1 << self.width) - 1

    @cached_property
    def table(self) -> list[int]:
        return self.entries.tolist()

    def read(self, bits: Bits) -> int:
        found = self.table[bits.peek() & self.mask]
        bits.skip(found & 15)
        return found >> 4


@lru_cache(maxsize=4096)
def _code_of(lengths: tuple[tuple[int, int], ...]) -> Code:
    """Codes of one or two symbols, and those of code lengths, come again and again."""
    return Code(dict(lengths))


@lru_cache(maxsize=4096)
def _code_of_lengths(raw: int, count: int) -> Code:
    """The code of code lengths whose own lengths are these numbers of 3 bits."""
    return Code({s: n for k, s in enumerate(LENGTH_ORDER[:count]) if (n := (raw >> 3 * k) & 7)})


def read_code(bits: Bits, size: int) -> Code:
    if bits.read(1):
        two = bits.read(1)
        symbols = [bits.read(8 if bits.read(1) else 1)]
        if two:
            symbols.append(bits.read(8))
        if max(symbols) >= size:
            raise ValueError("no such symbol")
        return _code_of(tuple((s, 1) for s in symbols))
    count = 4 + bits.read(4)
    lengths = _code_of_lengths(bits.read(3 * count), count)
    left = 2 + bits.read(2 + 2 * bits.read(3)) if bits.read(1) else size
    found: dict[int, int] = {}
    at, last, table, mask = 0, 8, lengths.table, lengths.mask
    # No code length takes more than 14 bits.
    first = bits.at >> 3
    held, begin = int.from_bytes(bits.data[first : first + 2 * size + 2], "little"), bits.at & 7
    now = begin
    while at < size and left:
        left -= 1
        s = table[(held >> now) & mask]
        now += s & 15
        s >>= 4
        if s < 16:
            if s:
                found[at] = last = s
            at += 1
            continue
        wide = 2 if s == 16 else 3 if s == 17 else 7
        n = (11 if s == 18 else 3) + ((held >> now) & ((1 << wide) - 1))
        now += wide
        if at + n > size:
            raise ValueError("a run of code lengths is too long")
        if s == 16:
            found.update(dict.fromkeys(range(at, at + n), last))
        at += n
    bits.skip(now - begin)
    return Code(found)


def _number(symbol: int, bits: Bits) -> int:
    """A length or distance from its prefix symbol and extra bits."""
    if symbol < 4:
        return symbol + 1
    extra = (symbol - 2) >> 1
    return ((2 + (symbol & 1)) << extra) + bits.read(extra) + 1


class Symbols(NamedTuple):
    """What is left to read of an image in which only green varies."""

    data: bytes
    at: int
    green: Code
    far: Code
    width: int
    total: int
    rest: int


def read_pixels(bits: Bits, width: int, height: int, main: bool) -> np.ndarray:
    """One entropy-coded image as 32-bit ARGB numbers."""
    found = _read_pixels(bits, width, height, main)
    return _argb(one_channel([found])[0], found.rest) if isinstance(found, Symbols) else found


def _argb(green: np.ndarray, rest: int) -> np.ndarray:
    return green.astype(np.uint32) << np.uint32(8) | np.uint32(rest)


def _read_pixels(bits: Bits, width: int, height: int, main: bool) -> np.ndarray | Symbols:
    """The numbers of an image, or its symbols where they are read together with those of others; nothing follows a main image."""
    cache_bits = bits.read(4) if bits.read(1) else 0
    if cache_bits > 11:
        raise ValueError("the colour cache is too large")
    groups_of, shift, groups = None, 0, 1
    if main and bits.read(1):
        shift = 2 + bits.read(3)
        w, h = ((n + (1 << shift) - 1) >> shift for n in (width, height))
        groups_of = (read_pixels(bits, w, h, False) >> 8) & 0xFFFF
        groups_of = groups_of.reshape(h, w).tolist()
        groups = max(max(row) for row in groups_of) + 1
    cache_size = 1 << cache_bits if cache_bits else 0
    codes = [[read_code(bits, n) for n in (280 + cache_size, 256, 256, 256, 40)] for _ in range(groups)]
    total = width * height
    green, red, blue, alpha, _ = codes[0]
    if main and groups == 1 and not cache_size and None not in (red.only, blue.only, alpha.only):
        return Symbols(bits.data, bits.at, green, codes[0][4], width, total, alpha.only << 24 | red.only << 16 | blue.only)
    out = [0] * total
    cache = [0] * cache_size
    at = 0

    def put(pixel):
        if cache_size:
            cache[(CACHE_FACTOR * pixel & 0xFFFFFFFF) >> (32 - cache_bits)] = pixel

    while at < total:
        green, red, blue, alpha, far = codes[groups_of[(at // width) >> shift][(at % width) >> shift] if groups_of else 0]
        s = green.read(bits)
        if s < 256:
            r, b, a = red.read(bits), blue.read(bits), alpha.read(bits)
            out[at] = a << 24 | r << 16 | s << 8 | b
            put(out[at])
            at += 1
        elif s < 280:
            n = _number(s - 256, bits)
            code = _number(far.read(bits), bits)
            back = code - 120 if code > 120 else _near(width)[code - 1]
            if back > at or at + n > total:
                raise ValueError("a back-reference leaves the image")
            for k in range(at, at + n):
                out[k] = out[k - back]
                put(out[k])
            at += n
        else:
            if s - 280 >= cache_size:
                raise ValueError("no such cache entry")
            out[at] = cache[s - 280]
            put(out[at])
            at += 1
    return np.array(out, np.uint32)


@lru_cache(maxsize=64)
def _near(width: int) -> tuple[int, ...]:
    """How far back the numbered near places lie."""
    return tuple(max(1, dx + dy * width) for dx, dy in NEAR)


def _ahead(raw: np.ndarray) -> np.ndarray:
    """From each byte on, the next eight as one number; the last seven bytes have none."""
    v = raw.astype(np.uint64)
    for k in (1, 2, 4):
        v = v[:-k] | v[k:] << np.uint64(8 * k)
    return v


def _numbers(symbol: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lengths or distances from their prefix symbols and the bits that follow those, and how many bits they take of them."""
    extra = _EXTRA[symbol]
    return _LEAST[symbol] + (bits & (np.uint64(1) << extra) - np.uint64(1)).astype(np.int64), extra.astype(np.int64)


def _tokens(runs: list[Symbols], stops: list[int]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, int]]:
    """Of each image the symbols that start before its bit ``stop``: their values, lengths (1 for literals), distances (0 for literals), the bit after them.

    What a symbol at a bit would be depends on that bit alone, so all bits are looked up at once, and those where symbols
    start are a walk from the first one, eight symbols a step.
    """
    # Each image has a byte after its end, where its walk stays, and the last one room to look ahead.
    spans = [(s.at >> 3, (stop + 7) >> 3) for s, stop in zip(runs, stops, strict=True)]
    room = np.array([b - a + 16 for a, b in spans], np.int64)
    raw = np.zeros(int(room.sum()), np.uint8)
    base = np.cumsum(room) - room
    for s, (a, b), at in zip(runs, spans, base.tolist(), strict=True):
        piece = s.data[a : b + 8]
        raw[at : at + len(piece)] = np.frombuffer(piece, np.uint8)
    ahead = _ahead(raw)
    image = np.repeat(np.arange(len(runs)), room)[: len(ahead)]
    greens, fars = ([getattr(s, name) for s in runs] for name in ("green", "far"))
    (table, first, mask), (far_table, far_first, far_mask) = (
        (np.concatenate([c.entries for c in codes]), np.cumsum([0, *(len(c.entries) for c in codes[:-1])]), np.array([c.mask for c in codes], np.int64))
        for codes in (greens, fars)
    )
    seen = (ahead & np.uint64((1 << 32) - 1)).astype(np.int64)
    found = table.take(((seen[:, None] >> np.arange(8)) & mask[image][:, None]) + first[image][:, None]).reshape(-1)
    then = np.arange(len(found)) + (found & 15)
    # References: the length's own bits, the code of the distance, the distance's own bits.
    ref = np.flatnonzero(found >= LITERALS << 4)
    ref = ref[ref < 8 * (len(ahead) - 8)]
    bits = lambda at: ahead[at >> 3] >> (at & 7).astype(np.uint64)
    n, extra = _numbers((found[ref] >> 4) - LITERALS, bits(then[ref]))
    at, of = then[ref] + extra, image[ref >> 3]
    far = far_table[(bits(at) & far_mask[of].astype(np.uint64)).astype(np.int64) + far_first[of]]
    at += far & 15
    back, extra = _numbers(far >> 4, bits(at))
    then[ref] = at + extra
    begin = 8 * base + np.array([s.at & 7 for s in runs])
    stay = 8 * base + np.array([stop - 8 * a for stop, (a, _) in zip(stops, spans, strict=True)])
    after = then.copy()
    np.minimum(then.reshape(-1, 8), stay[image][:, None], out=then.reshape(-1, 8))
    jump = then
    for _ in range(3):
        jump = jump.take(jump)
    steps, ends, step = [], [], memoryview(jump)
    for at, end in zip(begin.tolist(), stay.tolist(), strict=True):
        while at < end:
            steps.append(at)
            at = step[at]
        ends.append(len(steps))
    eight = np.empty((len(steps), 8), np.int64)
    eight[:, 0] = steps
    for k in range(1, 8):
        eight[:, k] = then.take(eight[:, k - 1])
    token = eight.reshape(-1)
    token = token[token < stay[image[token >> 3]]]
    value = found[token] >> 4
    length, distance = np.ones(len(token), np.int64), np.zeros(len(token), np.int64)
    copied = np.flatnonzero(value >= LITERALS)
    own = np.searchsorted(ref, token[copied])
    near = np.array([_near(s.width) for s in runs], np.int64)
    far = back[own]
    length[copied], distance[copied] = n[own], np.where(far > 120, far - 120, near[image[token[copied] >> 3], np.minimum(far, 120) - 1])
    cut = np.searchsorted(token, np.append(begin, 8 * len(raw))).tolist()
    for s, at, a, b in zip(runs, begin.tolist(), cut[:-1], cut[1:], strict=True):
        # The last symbol may end in another window, or after the data; then it cannot be read.
        to = s.at + (int(after[token[b - 1]]) - at if b > a else 0)
        b -= to > 8 * len(s.data)
        yield value[a:b], length[a:b], distance[a:b], to


def one_channel(runs: list[Symbols]) -> list[np.ndarray]:
    """Samples of images in which only green varies: small images together, large ones in windows of ``BITS_AT_ONCE``."""
    parts: list[list] = [[] for _ in runs]
    runs = list(runs)
    left = [s.total for s in runs]
    for s, found in zip(runs, parts, strict=True):
        if s.green.only is not None:
            if s.green.only >= LITERALS:
                raise ValueError("a back-reference leaves the image")
            found.append((np.full(s.total, s.green.only), np.ones(s.total, np.int64), np.zeros(s.total, np.int64)))
    todo = [k for k, s in enumerate(runs) if s.green.only is None]
    while todo:
        size = np.cumsum([8 * len(runs[k].data) - runs[k].at for k in todo[:IMAGES_AT_ONCE]])
        group = todo[: max(1, int(np.searchsorted(size, BITS_AT_ONCE, "right")))]
        stops = [min(8 * len(s.data), s.at + BITS_AT_ONCE) for s in (runs[k] for k in group)]
        for k, stop, (*found, at) in zip(group, stops, _tokens([runs[k] for k in group], stops), strict=True):
            left[k] -= int(found[1].sum())
            # Symbols after the last sample are none.
            used = len(found[1])
            while left[k] < 0 and left[k] + found[1][used - 1] <= 0:
                used -= 1
                left[k] += int(found[1][used])
            parts[k].append([x[:used] for x in found])
            runs[k] = runs[k]._replace(at=at)
            if left[k] > 0 and stop == 8 * len(runs[k].data):
                raise ValueError("the image ends early")
        todo = [k for k in group if left[k] > 0] + todo[len(group) :]
    value, length, distance = (np.concatenate([p[i] for found in parts for p in found]) for i in range(3))
    total = np.array([s.total for s in runs], np.int64)
    place = np.cumsum(length) - length
    plain = distance == 0
    copied = np.flatnonzero(~plain)
    start = np.repeat(np.cumsum(total) - total, [sum(len(p[0]) for p in found) for found in parts])[copied]
    if min(left, default=0) < 0 or (distance[copied] > place[copied] - start).any():
        raise ValueError("a back-reference leaves the image")
    out = np.zeros(int(total.sum()), np.uint8)
    out[place[plain]] = value[plain]
    out = bytearray(out)
    for to, n, back in zip(place[copied].tolist(), length[copied].tolist(), distance[copied].tolist(), strict=True):
        if back >= n:
            out[to : to + n] = out[to - back : to - back + n]
        else:
            out[to : to + n] = (out[to - back : to] * (n // back + 1))[:n]
    return np.split(np.frombuffer(out, np.uint8), np.cumsum(total)[:-1])


def _mean(a, b):
    return ((a ^ b) & 0xFEFEFEFE) // 2 + (a & b)


def _channels(p):
    return (p >> 24) & 255, (p >> 16) & 255, (p >> 8) & 255, p & 255


def _add(a, b):
    return ((a & 0xFF00FF00) + (b & 0xFF00FF00) & 0xFF00FF00) | ((a & 0x00FF00FF) + (b & 0x00FF00FF) & 0x00FF00FF)


def _pack(cs):
    a, r, g, b = (min(255, max(0, c)) for c in cs)
    return a << 24 | r << 16 | g << 8 | b


def _predict(mode, left, top, corner, right):
    """Predicted pixel from its neighbours: left, above, above left, above right."""
    if mode == 11:
        near = sum(abs(t - c) - abs(l - c) for l, t, c in zip(_channels(left), _channels(top), _channels(corner), strict=True))  # noqa: E741
        return left if near < 0 else top
    if mode == 12:
        return _pack(l + t - c for l, t, c in zip(_channels(left), _channels(top), _channels(corner), strict=True))  # noqa: E741
    if mode == 13:
        return _pack(m + int((m - c) / 2) for m, c in zip(_channels(_mean(left, top)), _channels(corner), strict=True))
    return {
        0: lambda: 0xFF000000, 1: lambda: left, 2: lambda: top, 3: lambda: right, 4: lambda: corner,
        5: lambda: _mean(_mean(left, right), top), 6: lambda: _mean(left, corner), 7: lambda: _mean(left, top),
        8: lambda: _mean(corner, top), 9: lambda: _mean(top, right),
        10: lambda: _mean(_mean(left, corner), _mean(top, right)),
    }.get(mode, lambda: 0xFF000000)()


def undo_predictor(pixels: np.ndarray, width: int, height: int, modes: np.ndarray, shift: int) -> np.ndarray:
    p = pixels.tolist()
    mode_rows = ((modes >> 8) & 15).reshape(-1, (width + (1 << shift) - 1) >> shift).tolist()
    for y in range(height):
        for x in range(width):
            i = y * width + x
            if y == 0:
                guess = 0xFF000000 if x == 0 else p[i - 1]
            elif x == 0:
                guess = p[i - width]
            else:
                # Right of the last column comes the first pixel of the row itself.
                guess = _predict(mode_rows[y >> shift][x >> shift], p[i - 1], p[i - width], p[i - width - 1], p[i - width + 1])
            p[i] = _add(p[i], guess)
    return np.array(p, np.uint32)


def undo_cross_colour(pixels: np.ndarray, width: int, height: int, factors: np.ndarray, shift: int) -> np.ndarray:
    blocks = factors.reshape(-1, (width + (1 << shift) - 1) >> shift)
    f = np.repeat(np.repeat(blocks, 1 << shift, 0)[:height], 1 << shift, 1)[:, :width].reshape(-1)
    signed = lambda v: (v & np.uint32(255)).astype(np.uint8).view(np.int8).astype(np.int32)
    green, red, blue = signed(pixels >> np.uint32(8)), (pixels >> np.uint32(16)).astype(np.int32) & 255, pixels.astype(np.int32) & 255
    red = (red + (signed(f) * green >> 5)) & 255
    blue = blue + (signed(f >> np.uint32(8)) * green >> 5)
    blue = (blue + (signed(f >> np.uint32(16)) * red.astype(np.uint8).view(np.int8).astype(np.int32) >> 5)) & 255
    return (pixels & np.uint32(0xFF00FF00)) | red.astype(np.uint32) << np.uint32(16) | blue.astype(np.uint32)


def undo_subtract_green(pixels: np.ndarray) -> np.ndarray:
    green = (pixels >> np.uint32(8)) & np.uint32(255)
    both = (pixels & np.uint32(0x00FF00FF)) + (green << np.uint32(16) | green)
    return (pixels & np.uint32(0xFF00FF00)) | (both & np.uint32(0x00FF00FF))


def undo_palette(pixels: np.ndarray, width: int, height: int, colours: np.ndarray) -> np.ndarray:
    """``width`` is the true width; several indices may share a stored pixel."""
    index = ((pixels >> np.uint32(8)) & np.uint32(255)).astype(np.int64)
    bits = _palette_shift(len(colours))
    if bits:
        per, depth = 1 << bits, 8 >> bits
        stored = (width + per - 1) >> bits
        index = (index.reshape(height, stored, 1) >> (depth * np.arange(per))) & ((1 << depth) - 1)
        index = index.reshape(height, stored * per)[:, :width].reshape(-1)
    table = np.zeros(256, np.uint32)
    table[: len(colours)] = colours
    return table[index]


def _palette_shift(n: int) -> int:
    return 3 if n <= 2 else 2 if n <= 4 else 1 if n <= 16 else 0


def _opened(image: bytes) -> tuple[np.ndarray | Symbols, list, int, int]:
    """Of one file its stored numbers or symbols, the transforms to invert, width and height."""
    if image[:4] != b"RIFF" or image[8:16] != b"WEBPVP8L":
        raise ValueError("not a lossless WebP file")
    (size,) = struct.unpack_from("<I", image, 16)
    if 20 + size > len(image):
        raise ValueError("the image ends early")
    bits = Bits(image[20 : 20 + size])
    if bits.read(8) != 0x2F:
        raise ValueError("the signature is wrong")
    width, height, _ = bits.read(14) + 1, bits.read(14) + 1, bits.read(1)
    if bits.read(3):
        raise ValueError("an unknown version")
    undo, stored, met = [], width, set()
    while bits.read(1):
        kind = bits.read(2)
        if kind in met:
            raise ValueError("a transform comes twice")
        met.add(kind)
        if kind in (PREDICTOR, CROSS_COLOUR):
            shift = bits.read(3) + 2
            side = lambda n, shift=shift: (n + (1 << shift) - 1) >> shift
            data = read_pixels(bits, side(stored), side(height), False)
            fn = undo_predictor if kind == PREDICTOR else undo_cross_colour
            undo.append(lambda p, fn=fn, w=stored, data=data, shift=shift: fn(p, w, height, data, shift))
        elif kind == SUBTRACT_GREEN:
            undo.append(undo_subtract_green)
        else:
            n = bits.read(8) + 1
            steps = read_pixels(bits, n, 1, False).view(np.uint8).reshape(n, 4)
            colours = np.cumsum(steps, axis=0, dtype=np.uint8).view(np.uint32).reshape(n)
            undo.append(lambda p, w=stored, colours=colours: undo_palette(p, w, height, colours))
            stored = (stored + (1 << _palette_shift(n)) - 1) >> _palette_shift(n)
    return _read_pixels(bits, stored, height, True), undo, width, height


def decode(image: bytes) -> np.ndarray:
    """ARGB numbers of one WebP file, a row of the array per image row."""
    _, _, width, height = opened = _opened(image)
    return _numbers_of([opened])[0].reshape(height, width)


def _numbers_of(opened: list[tuple[np.ndarray | Symbols, list, int, int]]) -> list[np.ndarray]:
    """ARGB numbers of files, whose symbols are read together; so are transforms that look at nothing but a pixel."""
    late = [k for k, (p, *_) in enumerate(opened) if isinstance(p, Symbols)]
    out = [p for p, *_ in opened]
    if late:
        green = one_channel([out[k] for k in late])
        rest = np.array([out[k].rest for k in late], np.uint32)
        sizes = [len(x) for x in green]
        whole = np.concatenate(green).astype(np.uint32) << np.uint32(8) | np.repeat(rest, sizes)
        alike = all(opened[k][1] == [undo_subtract_green] for k in late)
        if alike:
            whole = undo_subtract_green(whole)
        for k, x in zip(late, np.split(whole, np.cumsum(sizes)[:-1]), strict=True):
            out[k] = x
    done = set(late) if late and alike else ()
    for k, (_, undo, *_) in enumerate(opened):
        for fn in reversed(undo if k not in done else ()):
            out[k] = fn(out[k])
    return out


class Writer:
    """Collects bits, lowest first."""

    def __init__(self):
        self.value = self.n = 0

    def put(self, value: int, n: int) -> None:
        self.value |= value << self.n
        self.n += n

    def pieces(self) -> tuple[np.ndarray, np.ndarray]:
        """The bits as numbers of 16 bits, and how many bits of each count."""
        count = (self.n + 15) // 16
        width = np.full(count, 16, np.int64)
        width[-1] = self.n - 16 * (count - 1)
        return np.frombuffer(self.value.to_bytes(2 * count, "little"), "<u2").astype(np.int64), width


def code_lengths(counts: list[int], longest: int) -> list[int]:
    """Lengths of a prefix code of two symbols or more for these frequencies (Huffman); rare ones count more if codes get too long."""
    n, least = len(counts), 1
    order = sorted(range(n), key=counts.__getitem__)
    while True:
        weight = [max(counts[i], least) for i in order]
        parent, leaf, inner = [0] * (2 * n - 1), 0, n
        for node in range(n, 2 * n - 1):
            total = 0
            for _ in range(2):
                if leaf < n and (inner >= node or weight[leaf] <= weight[inner]):
                    parent[leaf] = node
                    total += weight[leaf]
                    leaf += 1
                else:
                    parent[inner] = node
                    total += weight[inner]
                    inner += 1
            weight.append(total)
        depth = [0] * (2 * n - 1)
        for node in range(2 * n - 3, -1, -1):
            depth[node] = depth[parent[node]] + 1
        if max(depth[:n]) <= longest:
            out = [0] * n
            for i, d in zip(order, depth[:n], strict=True):
                out[i] = d
            return out
        least *= 2


def canonical(lengths: np.ndarray) -> np.ndarray:
    """The code of each symbol, its first bit lowest; zero for symbols without a length."""
    used = np.flatnonzero(lengths)
    used = used[np.argsort(lengths[used], kind="stable")]
    share = np.int64(1) << (LONGEST_CODE - lengths[used])
    out = np.zeros(len(lengths), np.int64)
    out[used] = _REVERSED[np.cumsum(share) - share]
    return out


@lru_cache(maxsize=1)
def _length_codes() -> list[int]:
    return canonical(np.array(LENGTH_BITS, np.int64)).tolist()


def _run(value: int, run: int):
    """A run of one code length as ``(symbol, extra, bits of it)``: 16 repeats the last one, 17 and 18 are runs of zeros."""
    if value:
        yield value, 0, 0
        run -= 1
        while run >= 3:
            n = min(run, 6)
            yield 16, n - 3, 2
            run -= n
    while not value and run >= 3:
        n = min(run, 138)
        yield (18, n - 11, 7) if n >= 11 else (17, n - 3, 3)
        run -= n
    for _ in range(run):
        yield value, 0, 0


@lru_cache(maxsize=8192)
def _run_bits(value: int, run: int) -> tuple[int, int]:
    """The bits of a run of one code length, and how many they are."""
    codes, out, at = _length_codes(), 0, 0
    for s, extra, n in _run(value, run):
        out |= (codes[s] | extra << LENGTH_BITS[s]) << at
        at += LENGTH_BITS[s] + n
    return out, at


@lru_cache(maxsize=1)
def _code_head() -> tuple[int, int]:
    """What stands before the code lengths: the code in which they are written."""
    w = Writer()
    w.put(0, 1)
    w.put(len(LENGTH_ORDER) - 4, 4)
    for s in LENGTH_ORDER:
        w.put(LENGTH_BITS[s], 3)
    w.put(0, 1)
    return w.value, w.n


def write_code(w: Writer, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Writes the code of the symbols that occur; codes and lengths by symbol (a single symbol takes no bits)."""
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), np.int64)
    if len(used) <= 1 or (len(used) == 2 and used[-1] < 256):
        symbols = used.tolist() or [0]
        for value, n in ((1, 1), (len(symbols) - 1, 1), (1, 1), *((s, 8) for s in symbols)):
            w.put(value, n)
        lengths[used] = len(used) - 1
        return canonical(lengths), lengths
    lengths[used] = code_lengths(counts[used].tolist(), LONGEST_CODE)
    value, at = _code_head()
    each, start = lengths.tolist(), 0
    for end in (*(np.flatnonzero(lengths[1:] != lengths[:-1]) + 1).tolist(), len(each)):
        bits, n = _run_bits(each[start], end - start)
        value |= bits << at
        at += n
        start = end
    w.put(value, at)
    return canonical(lengths), lengths


def _head(height: int, green: np.ndarray, far: np.ndarray) -> tuple[Writer, list[np.ndarray]]:
    """Everything before the samples: sizes, the transform that subtracts green, five codes for these frequencies."""
    w = Writer()
    for value, n in ((0x2F, 8), (WIDTH - 1, 14), (height - 1, 14), (0, 1), (0, 3), (1, 1), (SUBTRACT_GREEN, 2), (0, 1), (0, 1), (0, 1)):
        w.put(value, n)
    codes = [*write_code(w, green)]
    for only in (0, 0, 255):
        # One symbol, of 8 bits.
        w.put(0b101 | only << 3, 11)
    return w, [*codes, *write_code(w, far)]


def _references(data: np.ndarray, image: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each sample how far back its next four occur last in its image, and for how long at least the samples agree there."""
    n = len(data)
    back = np.zeros(n, np.int64)
    if n >= 4:
        x = data.astype(np.uint64)
        four = x[:-3] | x[1:-2] << np.uint64(8) | x[2:-1] << np.uint64(16) | x[3:] << np.uint64(24)
        keys = np.sort(four << np.uint64(32) | np.arange(n - 3, dtype=np.uint64))
        at = (keys & np.uint64(0xFFFFFFFF)).astype(np.int64)
        same = np.flatnonzero(keys[1:] >> np.uint64(32) == keys[:-1] >> np.uint64(32))
        late, early = at[same + 1], at[same]
        ok = (image[late] == image[early]) & (late + 4 <= end[image[late]]) & (late - early <= FARTHEST)
        back[late[ok]] = (late - early)[ok]
    # Samples in a row that lie equally far from their last occurrences agree as a whole.
    ends = np.append(np.flatnonzero(back[1:] != back[:-1]), n - 1)
    length = np.repeat(ends, np.diff(ends, prepend=-1)) - np.arange(n) + 4
    return back, np.where(back > 0, np.minimum(length, LONGEST), 0)


def _prefixed(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Prefix symbol, extra bits and their number of each length or distance."""
    x = v - 1
    high = np.log2(np.maximum(x, 1)).astype(np.int64)
    more = np.maximum(high - 1, 0)
    small = v <= 4
    return np.where(small, x, 2 * high + ((x >> more) & 1)), np.where(small, 0, x & ((1 << more) - 1)), np.where(small, 0, more)


@lru_cache(maxsize=1)
def _near_numbers() -> np.ndarray:
    """The smallest number of a near place for each distance that has one."""
    places = _near(WIDTH)
    out = np.zeros(max(places) + 1, np.int64)
    for k in range(len(places), 0, -1):
        out[places[k - 1]] = k
    return out


def encode_images(images: list[np.ndarray]) -> list[bytes]:
    """A file per image of at most 64 x 16,384 samples, a multiple of 64."""
    data, sizes = np.concatenate(images), np.array([len(x) for x in images], np.int64)
    end, image = np.cumsum(sizes), np.repeat(np.arange(len(sizes)), sizes)
    back, length = _references(data, image, end)
    taken = length >= SHORTEST
    # The first agreement is taken as a whole, then the first one after it.
    start, free = [], 0
    for at, to in zip(*(x[taken].tolist() for x in (np.arange(len(data)), np.arange(len(data)) + length)), strict=True):
        if at >= free:
            start.append(at)
            free = to
    start = np.array(start, np.int64)
    covered = np.zeros(len(data) + 1, np.int8)
    covered[start + 1] += 1
    covered[start + length[start]] -= 1
    token = np.flatnonzero(np.cumsum(covered[:-1], dtype=np.int8) == 0)
    of, copied = image[token], np.zeros(len(data), bool)
    copied[start] = True
    copied = copied[token]
    symbol = data[token].astype(np.int64)
    c = np.flatnonzero(copied)
    s, more, more_bits = _prefixed(length[token[c]])
    symbol[c] = LITERALS + s
    far = back[token[c]]
    numbers = _near_numbers()
    near = numbers[np.minimum(far, len(numbers) - 1)] * (far < len(numbers))
    place, step, step_bits = _prefixed(np.where(near > 0, near, far + 120))
    wide = LITERALS + LENGTHS
    green = np.bincount(of * wide + symbol, minlength=len(sizes) * wide).reshape(-1, wide)
    distance = np.bincount(of[c] * DISTANCES + place, minlength=len(sizes) * DISTANCES).reshape(-1, DISTANCES)
    heads = [_head(n // WIDTH, g, d) for n, g, d in zip(sizes.tolist(), green, distance, strict=True)]
    codes, lengths, far_codes, far_lengths = (np.concatenate(x) for x in zip(*(h[1] for h in heads), strict=True))
    # A literal is one number; a reference is its length, more bits of that, its distance, more bits of that.
    first = np.cumsum(1 + 3 * copied) - (1 + 3 * copied)
    value, bits = (np.zeros(len(token) + 3 * len(c), np.int64) for _ in range(2))
    value[first], bits[first] = codes[of * wide + symbol], lengths[of * wide + symbol]
    own, at = of[c] * DISTANCES + place, first[c]
    for k, (v, n) in enumerate(((more, more_bits), (far_codes[own], far_lengths[own]), (step, step_bits)), 1):
        value[at + k], bits[at + k] = v, n
    first = np.append(first, len(value))[np.searchsorted(of, np.arange(len(sizes) + 1))]
    parts = [x for (w, _), a, b in zip(heads, first[:-1], first[1:], strict=True) for x in (w.pieces(), (value[a:b], bits[a:b]))]
    owner = np.repeat(np.arange(len(parts)) // 2, [len(v) for v, _ in parts])
    value, bits = (np.concatenate(x) for x in zip(*parts, strict=True))
    return [_file(x) for x in _packed(value.astype(np.uint64), bits, owner, len(images))]


def _packed(value: np.ndarray, bits: np.ndarray, owner: np.ndarray, n: int) -> list[bytes]:
    """The numbers of each owner one after the other, lowest bit first; each owner starts in a word of its own."""
    total = np.bincount(owner, bits, n).astype(np.int64)
    words = (total + 31) >> 5
    base = np.cumsum(words) - words
    at = np.cumsum(bits) - bits + (32 * base - (np.cumsum(total) - total))[owner]
    word, value = at >> 5, value << (at & 31).astype(np.uint64)
    new = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
    out = np.zeros(int(words.sum()) + 2, np.uint64)
    out[word[new]] += np.add.reduceat(value & np.uint64(0xFFFFFFFF), new)
    out[word[new] + 1] += np.add.reduceat(value >> np.uint64(32), new)
    data = out.astype("<u4").tobytes()
    return [data[4 * b : 4 * b + (t + 7) // 8] for b, t in zip(base.tolist(), total.tolist(), strict=True)]


def _file(data: bytes) -> bytes:
    chunk = struct.pack("<4sI", b"VP8L", len(data)) + data + b"\0" * (len(data) & 1)
    return struct.pack("<4sI4s", b"RIFF", 4 + len(chunk), b"WEBP") + chunk


def store_all(payloads: list[bytes]) -> list[bytes]:
    """For each payload, whose length is a positive multiple of 64, its files one after the other."""
    step = WIDTH * ROWS
    images = [(k, np.frombuffer(p, np.uint8)[i : i + step]) for k, p in enumerate(payloads) for i in range(0, len(p), step)]
    out: list[list[bytes]] = [[] for _ in payloads]
    at = 0
    while at < len(images):
        end, size = at + 1, len(images[at][1])
        while end < len(images) and size + len(images[end][1]) <= TOGETHER:
            size += len(images[end][1])
            end += 1
        for (k, _), file in zip(images[at:end], encode_images([x for _, x in images[at:end]]), strict=True):
            out[k].append(file)
        at = end
    return [b"".join(x) for x in out]


def store(payload: bytes) -> bytes:
    """The files of one payload."""
    return store_all([payload])[0]


def files(stored: bytes):
    at = 0
    while at < len(stored):
        (size,) = struct.unpack_from("<I", stored, at + 4)
        yield stored[at : at + 8 + size]
        at += 8 + size


def load(stored: bytes) -> np.ndarray:
    """Samples of all files, from their green channel."""
    return next(load_all([stored]))


def load_all(stored: list[bytes]) -> Iterator[np.ndarray]:
    """Samples of the files of each stored form; images are read together up to ``TOGETHER`` samples."""
    held, parts = [], [[] for _ in stored]

    def read():
        for (k, *_), pixels in zip(held, _numbers_of([x for _, *x in held]), strict=True):
            parts[k].append((pixels >> np.uint32(8)).astype(np.uint8))

    size = told = 0
    for k, media in enumerate(stored):
        for file in files(media):
            opened = _opened(file)
            n = opened[2] * opened[3]
            if held and size + n > TOGETHER:
                read()
                held, size = [], 0
                # All forms before this file's are whole.
                yield from map(_joined, parts[told:k])
                parts[told:k], told = [()] * (k - told), k
            held.append((k, *opened))
            size += n
    if held:
        read()
    yield from map(_joined, parts[told:])


def _joined(parts: list[np.ndarray]) -> np.ndarray:
    return parts[0] if len(parts) == 1 else np.concatenate(parts)


def feature(samples: np.ndarray) -> str:
    """Sample count, distinct values, sum, sum of squared steps, and shares of eight value ranges in hex."""
    counts = np.bincount(samples, minlength=256)
    x = samples.astype(np.int32)
    step = x[1:] - x[:-1]
    share = "".join(f"{v:02x}" for v in (counts.reshape(8, 32).sum(axis=1) * 255 // len(samples)).tolist())
    return f"{len(samples)}:{np.count_nonzero(counts)}:{counts @ np.arange(256)}:{(step * step).sum(dtype=np.int64)}:{share}"


ADDED = "n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string, media binary"


def to_media(docs: DataFrame, text_col: str = "text", with_media: bool = True) -> DataFrame:
    """The rows with the stored form of their text (``media``, if asked for) and what the decoder reads back from it.

    Columns of the input that bear one of the added names are replaced.
    """
    added = _parse_datatype_string(ADDED)
    kept = docs.drop(*added.names)
    out = StructType([*kept.schema.fields, *(f for f in added if with_media or f.name != "media")])
    schema = to_arrow_schema(out)

    def run(batches):
        for batch in ar.slices(batches, "_wp_text"):
            raw = [t.encode() for t in pc.fill_null(batch.column("_wp_text"), "").to_pylist()]
            stored = store_all([r + b"\0" * ((-len(r)) % WIDTH or (0 if r else WIDTH)) for r in raw])
            rows = [_row(len(r), media, samples, with_media) for r, media, samples in zip(raw, stored, load_all(stored), strict=True)]
            cols = {n: [r[k] for r in rows] for k, n in enumerate(added.names)}
            yield pa.RecordBatch.from_arrays([pa.array(cols[f.name], f.type) if f.name in cols else batch.column(f.name).cast(f.type) for f in schema], schema=schema)

    return kept.withColumn("_wp_text", F.coalesce(F.col(text_col).cast("string"), F.lit(""))).mapInArrow(run, out)


def _row(n_bytes: int, media: bytes, samples: np.ndarray, with_media: bool):
    back = samples.tobytes()
    return (
        n_bytes, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(media),
        hashlib.sha256(media).hexdigest(), feature(samples), media if with_media else None,
    )
