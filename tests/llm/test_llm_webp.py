"""The lossless WebP decoder against streams written bit by bit here, and exact round trips."""

import hashlib
import random
import struct
import zlib

import numpy as np
import pytest

from modwarden.llm import webp


class Out:
    def __init__(self):
        self.bits = []

    def put(self, value, n):
        self.bits += [(value >> i) & 1 for i in range(n)]

    def code(self, book, symbol):
        length, code = book[symbol]
        self.bits += [(code >> (length - 1 - i)) & 1 for i in range(length)]

    def file(self):
        data = np.packbits(np.array(self.bits, np.uint8), bitorder="little").tobytes()
        chunk = b"VP8L" + struct.pack("<I", len(data)) + data + b"\0" * (len(data) & 1)
        return b"RIFF" + struct.pack("<I", 4 + len(chunk)) + b"WEBP" + chunk


def book_of(symbols):
    """A complete prefix code of two lengths at most: (length, code) per symbol."""
    symbols = sorted(set(symbols))
    n = len(symbols)
    if n == 1:
        return {symbols[0]: (0, 0)}
    w = (n - 1).bit_length()
    short = (1 << w) - n
    lengths = [(w - 1 if i < short else w, s) for i, s in enumerate(symbols)]
    out, code, before = {}, 0, min(x for x, _ in lengths)
    for length, s in sorted(lengths):
        code <<= length - before
        out[s], before = (length, code), length
        code += 1
    return out


def write_book(out, book, size):
    if len(book) == 1 and next(iter(book)) < 256:
        out.put(1, 1), out.put(0, 1), out.put(1, 1), out.put(next(iter(book)), 8)
        return
    lengths = [book[s][0] if s in book else 0 for s in range(size)]
    if len(book) == 1:
        lengths[next(iter(book))] = 1
    out.put(0, 1)
    # Lengths are written with runs of zeros (17, 18) and repeats (16).
    items, i = [], 0
    while i < size:
        run = 1
        while i + run < size and lengths[i + run] == lengths[i]:
            run += 1
        if lengths[i] == 0 and run >= 3:
            take = min(run, 138)
            items.append((17, take - 3, 3) if take <= 10 else (18, take - 11, 7))
        elif lengths[i] and run >= 4:
            take = min(run - 1, 6)
            items.append((lengths[i], 0, 0))
            items.append((16, take - 3, 2))
            take += 1
        else:
            take = 1
            items.append((lengths[i], 0, 0))
        i += take
    small = book_of([s for s, _, _ in items])
    out.put(19 - 4, 4)
    for s in webp.LENGTH_ORDER:
        out.put(max(1, small[s][0]) if s in small else 0, 3)
    out.put(0, 1)
    for s, extra, n in items:
        out.code(small, s)
        out.put(extra, n)


def number_symbol(v):
    """Prefix symbol, extra value and extra bits of a length or distance code."""
    v -= 1
    if v < 4:
        return v, 0, 0
    top = v.bit_length() - 1
    second = (v >> (top - 1)) & 1
    extra = top - 1
    return 2 * top + second, v & ((1 << extra) - 1), extra


def write_pixels(out, pixels, width, main, cache_bits=0, refs=False, groups=None):
    """An entropy-coded image; ``groups`` gives (shift, group of each block) for the main image."""
    out.put(int(cache_bits > 0), 1)
    if cache_bits:
        out.put(cache_bits, 4)
    if main:
        out.put(int(groups is not None), 1)
        if groups is not None:
            shift, table = groups
            out.put(shift - 2, 3)
            across = (width + (1 << shift) - 1) >> shift
            write_pixels(out, [g << 8 for g in table], across, False)
    n_groups = 1 if groups is None else max(table) + 1
    ops, cache, i = [], {}, 0
    group = lambda i: table[((i // width) >> shift) * across + ((i % width) >> shift)] if groups is not None else 0
    slot = lambda p: (webp.CACHE_FACTOR * p & 0xFFFFFFFF) >> (32 - cache_bits)
    while i < len(pixels):
        best = (0, 0)
        if refs:
            for back in range(1, min(i, 70) + 1):
                n = 0
                while i + n < len(pixels) and n < 40 and pixels[i + n] == pixels[i + n - back]:
                    n += 1
                best = max(best, (n, back))
        if best[0] >= 3:
            n, back = best
            near = next((k for k, (dx, dy) in enumerate(webp.NEAR) if max(1, dx + dy * width) == back), None)
            ops.append((group(i), "ref", n, near + 1 if near is not None else back + 120))
            step = n
        elif cache_bits and cache.get(slot(pixels[i])) == pixels[i]:
            ops.append((group(i), "cache", slot(pixels[i]), 0))
            step = 1
        else:
            ops.append((group(i), "pixel", pixels[i], 0))
            step = 1
        if cache_bits:
            for p in pixels[i : i + step]:
                cache[slot(p)] = p
        i += step
    size = 280 + (1 << cache_bits if cache_bits else 0)
    books = []
    for g in range(n_groups):
        used = [set() for _ in range(5)]
        for og, kind, a, b in ops:
            if og != g:
                continue
            if kind == "pixel":
                for k, sh in enumerate((8, 16, 0, 24)):
                    used[k].add((a >> sh) & 255)
            elif kind == "cache":
                used[0].add(280 + a)
            else:
                used[0].add(256 + number_symbol(a)[0])
                used[4].add(number_symbol(b)[0])
        own = [book_of(u or {0}) for u in used]
        for book, s in zip(own, (size, 256, 256, 256, 40), strict=True):
            write_book(out, book, s)
        books.append(own)
    for g, kind, a, b in ops:
        own = books[g]
        if kind == "pixel":
            for k, sh in enumerate((8, 16, 0, 24)):
                out.code(own[k], (a >> sh) & 255)
        elif kind == "cache":
            out.code(own[0], 280 + a)
        else:
            s, extra, n = number_symbol(a)
            out.code(own[0], 256 + s)
            out.put(extra, n)
            s, extra, n = number_symbol(b)
            out.code(own[4], s)
            out.put(extra, n)


def start(width, height):
    out = Out()
    for v, n in ((0x2F, 8), (width - 1, 14), (height - 1, 14), (1, 1), (0, 3)):
        out.put(v, n)
    return out


def image(seed, width, height, kind="smooth"):
    r = random.Random(seed)
    if kind == "noise":
        return [r.getrandbits(32) for _ in range(width * height)]
    if kind == "few":
        colours = [r.getrandbits(32) for _ in range(r.choice([1, 2, 3, 4, 11, 16, 40]))]
        return [r.choice(colours) for _ in range(width * height)]
    return [(255 << 24) | ((x * 3 + r.randint(0, 4)) % 256) << 16 | ((y * 5 + r.randint(0, 4)) % 256) << 8 | ((x + y) % 256) for y in range(height) for x in range(width)]


@pytest.mark.parametrize("cache_bits", [0, 1, 4, 10])
@pytest.mark.parametrize("refs", [False, True])
@pytest.mark.parametrize("kind", ["smooth", "noise", "few"])
def test_codes_references_and_cache(cache_bits, refs, kind):
    w, h = 13, 9
    p = image(1, w, h, kind)
    out = start(w, h)
    out.put(0, 1)
    write_pixels(out, p, w, True, cache_bits, refs)
    assert webp.decode(out.file()).reshape(-1).tolist() == p


def test_meta_prefix_groups():
    w, h = 19, 11
    p = image(2, w, h, "few")
    out = start(w, h)
    out.put(0, 1)
    r = random.Random(5)
    write_pixels(out, p, w, True, 3, True, (2, [r.randint(0, 3) for _ in range(5 * 2)] + [0, 1, 2, 3, 3]))
    assert webp.decode(out.file()).reshape(-1).tolist() == p


def forward_predict(p, w, h, modes, shift):
    across = (w + (1 << shift) - 1) >> shift
    out = []
    for y in range(h):
        for x in range(w):
            i = y * w + x
            if y == 0:
                guess = 0xFF000000 if x == 0 else p[i - 1]
            elif x == 0:
                guess = p[i - w]
            else:
                guess = predictor(modes[(y >> shift) * across + (x >> shift)], p[i - 1], p[i - w], p[i - w - 1], p[i - w + 1])
            out.append(sum((((p[i] >> s) - (guess >> s)) & 255) << s for s in (0, 8, 16, 24)))
    return out


def predictor(mode, left, top, corner, right):
    """The fourteen predictors, channel by channel."""
    ch = lambda v: [(v >> s) & 255 for s in (0, 8, 16, 24)]
    L, T, C, R = map(ch, (left, top, corner, right))
    avg = lambda a, b: [(x + y) // 2 for x, y in zip(a, b, strict=True)]
    clamp = lambda v: max(0, min(255, v))
    if mode == 11:
        dl = sum(abs(t - c) for t, c in zip(T, C, strict=True))
        dt = sum(abs(x - c) for x, c in zip(L, C, strict=True))
        got = L if dl < dt else T
    elif mode == 12:
        got = [clamp(x + t - c) for x, t, c in zip(L, T, C, strict=True)]
    elif mode == 13:
        got = [clamp(m + int((m - c) / 2)) for m, c in zip(avg(L, T), C, strict=True)]
    else:
        got = [[0, 0, 0, 255], L, T, R, C, avg(avg(L, R), T), avg(L, C), avg(L, T), avg(C, T), avg(T, R), avg(avg(L, C), avg(T, R))][mode]
    return sum(v << s for v, s in zip(got, (0, 8, 16, 24), strict=True))


@pytest.mark.parametrize("mode", range(14))
@pytest.mark.parametrize("kind", ["smooth", "noise"])
def test_predictors(mode, kind):
    w, h, shift = 14, 9, 2
    p = image(mode, w, h, kind)
    modes = [mode if k % 3 else (mode + k) % 14 for k in range(4 * 3)]
    out = start(w, h)
    out.put(1, 1), out.put(webp.PREDICTOR, 2), out.put(shift - 2, 3)
    write_pixels(out, [m << 8 for m in modes], 4, False)
    out.put(0, 1)
    write_pixels(out, forward_predict(p, w, h, modes, shift), w, True)
    assert webp.decode(out.file()).reshape(-1).tolist() == p


def signed(v):
    v &= 255
    return v - 256 if v > 127 else v


def test_colour_transforms_together():
    w, h, shift = 11, 7, 2
    p = image(3, w, h, "noise")
    factors = image(4, 3, 2, "noise")
    green_less = []
    for v in p:
        g = (v >> 8) & 255
        green_less.append((v & 0xFF00FF00) | ((((v >> 16) - g) & 255) << 16) | ((v - g) & 255))
    crossed = []
    for i, v in enumerate(green_less):
        f = factors[((i // w) >> shift) * 3 + ((i % w) >> shift)]
        r, g, b = (v >> 16) & 255, (v >> 8) & 255, v & 255
        nb = (b - (signed(f >> 8) * signed(g) >> 5) - (signed(f >> 16) * signed(r) >> 5)) & 255
        nr = (r - (signed(f) * signed(g) >> 5)) & 255
        crossed.append((v & 0xFF00FF00) | nr << 16 | nb)
    out = start(w, h)
    out.put(1, 1), out.put(webp.SUBTRACT_GREEN, 2)
    out.put(1, 1), out.put(webp.CROSS_COLOUR, 2), out.put(shift - 2, 3)
    write_pixels(out, factors, 3, False)
    out.put(0, 1)
    write_pixels(out, crossed, w, True)
    assert webp.decode(out.file()).reshape(-1).tolist() == p


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 16, 17, 200, 256])
def test_palettes(n):
    r = random.Random(n)
    w, h = 13, 5
    colours = [r.getrandbits(32) for _ in range(n)]
    index = [r.randrange(n) for _ in range(w * h)]
    shift = 3 if n <= 2 else 2 if n <= 4 else 1 if n <= 16 else 0
    depth, per, stored = 8 >> shift, 1 << shift, (w + (1 << shift) - 1) >> shift
    packed = []
    for y in range(h):
        for x in range(stored):
            v = 0
            for k in range(per):
                if x * per + k < w:
                    v |= index[y * w + x * per + k] << (depth * k)
            packed.append(255 << 24 | v << 8)
    steps = [sum((((c >> s) - (b >> s)) & 255) << s for s in (0, 8, 16, 24)) for c, b in zip(colours, [0, *colours[:-1]], strict=True)]
    out = start(w, h)
    out.put(1, 1), out.put(webp.PALETTE, 2), out.put(n - 1, 8)
    write_pixels(out, steps, n, False)
    out.put(0, 1)
    write_pixels(out, packed, stored, True, refs=True)
    assert webp.decode(out.file()).reshape(-1).tolist() == [colours[i] for i in index]


@pytest.mark.parametrize("used", [1, 2, 3, 4, 7, 64, 65, 200, 256])
def test_stored_bytes_come_back(used):
    r = random.Random(used)
    values = r.sample(range(256), used)
    payload = bytes(r.choice(values) for _ in range(64 * 50))
    media = webp.store(payload)
    assert webp.load(media).tobytes() == payload == webp.load(webp.store(payload)).tobytes()
    assert media == webp.store(payload)


def test_text_is_stored_through_the_format_s_steps(monkeypatch):
    read = []
    real = webp.read_code
    monkeypatch.setattr(webp, "read_code", lambda bits, size: read.append(real(bits, size)) or read[-1])
    greens = []
    undo = webp.undo_subtract_green
    monkeypatch.setattr(webp, "undo_subtract_green", lambda p: greens.append(len(p)) or undo(p))
    rng = random.Random(5)
    words = ["".join(rng.choices("etaoinshrdlu", range(12, 0, -1), k=rng.randint(2, 9))) for _ in range(60)]
    payload = " ".join(rng.choices(words, k=900)).encode()
    payload += b"\0" * (-len(payload) % 64)
    media = webp.store(payload)
    assert webp.load(media).tobytes() == payload and greens == [len(payload)]
    green, far = read[0], read[4]
    # Codes of several lengths, of lengths and of distances; the repeated words leave less than half.
    assert len({e & 15 for e in green.table}) > 2 and max(e >> 4 for e in green.table) >= 256 and len(set(far.table)) > 1
    assert 2 * len(media) < len(payload)
    grey = webp.decode(media).reshape(-1)
    assert (grey == 0xFF000000 + np.frombuffer(payload, np.uint8).astype(np.uint32) * 0x010101).all()


@pytest.mark.parametrize("seed", range(6))
def test_images_together_are_those_alone(seed):
    rng = random.Random(seed)
    payloads = [bytes(rng.choices(range(2 + rng.randint(0, 254)), k=64 * rng.randint(1, 60))) for _ in range(9)]
    payloads += [payloads[3], b"\0" * 64, b"ab" * 3200, payloads[1] * 3, bytes(range(256)) * 40]
    # Frequencies like Fibonacci numbers would give codes of more than 15 bits.
    a, b, deep = 1, 1, b""
    for c in range(22):
        deep += bytes([c]) * a
        a, b = b, a + b
    deep = bytes(rng.sample(deep, len(deep)))
    payloads.append(deep + b"\0" * (-len(deep) % 64))
    files = webp.store_all(payloads)
    assert files == [webp.store(p) for p in payloads]
    assert [webp.load(f).tobytes() for f in files] == payloads


def test_long_payloads_become_several_images():
    payload = random.Random(1).randbytes(webp.WIDTH * webp.ROWS + 6400)
    media = webp.store(payload)
    assert len(list(webp.files(media))) == 2 and webp.load(media).tobytes() == payload


def test_broken_files_are_refused():
    good = webp.store(b"abcd" * 160)
    for bad in (b"", b"RIFF", good[:8] + b"WEBPVP8 " + good[16:], good[:20] + b"\x00" + good[21:]):
        with pytest.raises((ValueError, struct.error)):
            webp.decode(bad)
    short = good[:16] + struct.pack("<I", 40) + good[20:60]
    with pytest.raises(ValueError, match="ends early|not complete|too long"):
        webp.decode(short)


def test_rows(spark):
    rows = [(1, "héllo " * 40, 1), (2, None, 2), (3, "", 3), (4, "x" * 64, 4), (4, "x" * 64, 4), (None, "z" * 65, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, feature int")
    out = webp.to_media(df).collect()
    assert len(out) == len(rows)
    for r in out:
        raw = (r.text or "").encode()
        payload = raw + b"\0" * (-len(raw) % 64 or (0 if raw else 64))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert (r.media_bytes, r.media_sha256) == (len(r.media), hashlib.sha256(bytes(r.media)).hexdigest())
        assert webp.load(bytes(r.media)).tobytes() == payload
    assert webp.to_media(df.limit(0)).count() == 0


def test_code_lengths_are_read_in_one_piece(monkeypatch):
    """The 19 lengths in front of each code cost one read, so an image costs few reads whatever its codes."""
    payload = (bytes(range(32, 127)) * 3 + b"the quick brown fox " * 40)[:1024]
    stored, reads = webp.store(payload), []
    plain = webp.Bits.read
    monkeypatch.setattr(webp.Bits, "read", lambda self, n: (reads.append(n), plain(self, n))[1])
    assert webp.load(stored).tobytes() == payload
    assert len(reads) < 40


def test_symbols_of_small_images_are_read_together(monkeypatch):
    """A step of the reader serves many images, so a small one does not cost a loop over its symbols."""
    rng = random.Random(9)
    payloads = [bytes(rng.choices(range(32, 32 + rng.randint(1, 90)), k=64 * rng.randint(1, 9))) for _ in range(120)]
    stored, calls = webp.store_all(payloads), []
    real = webp._tokens
    monkeypatch.setattr(webp, "_tokens", lambda runs, stops: calls.append(len(runs)) or real(runs, stops))
    assert [x.tobytes() for x in webp.load_all(stored)] == payloads
    assert len(calls) < 8


@pytest.mark.parametrize("bits", [64, 70, 333, 5000])
def test_symbols_run_over_the_ends_of_windows(monkeypatch, bits):
    rng = random.Random(bits)
    payloads = [rng.randbytes(6400), b"\0" * 64, b"ab" * 32 * 90, rng.randbytes(64) * 200, bytes(rng.choices(b"etaoin", k=64 * 40)), b"a" * 640]
    payloads += [payloads[0] + rng.randbytes(64 * 300) + payloads[0]]
    stored = webp.store_all(payloads)
    monkeypatch.setattr(webp, "BITS_AT_ONCE", bits)
    assert [x.tobytes() for x in webp.load_all(stored)] == payloads
    monkeypatch.setattr(webp, "TOGETHER", 64)
    assert [x.tobytes() for x in webp.load_all([*stored[:3], stored[3] + stored[4], *stored[5:]])] == [*payloads[:3], payloads[3] + payloads[4], *payloads[5:]]


def test_images_that_end_early_or_refer_too_far_are_refused():
    good = webp.store(bytes(random.Random(3).choices(b"etaoin shrdlu", k=64 * 20)))
    (size,) = struct.unpack_from("<I", good, 16)
    for less in (1, 2, 9, 200):
        with pytest.raises(ValueError, match="ends early"):
            webp.decode(good[:16] + struct.pack("<I", size - less) + good[20:])
    for far, n, text in ((1, 3, "leaves"), (3, 2, None), (4, 2, "leaves"), (1, 62, "leaves"), (1, 61, None)):
        out = start(64, 1)
        out.put(0, 1), out.put(0, 1), out.put(0, 1)
        symbols = [1, 2, 3] if far > 1 or n > 3 else []
        s, extra, wide = number_symbol(n)
        ds, dextra, dwide = number_symbol(far + 120)
        green, distance = book_of([1, 2, 3, 256 + s]), book_of([ds])
        for book, of in ((green, 280), ({0: (0, 0)}, 256), ({0: (0, 0)}, 256), ({255: (0, 0)}, 256), (distance, 40)):
            write_book(out, book, of)
        for x in symbols:
            out.code(green, x)
        out.code(green, 256 + s), out.put(extra, wide), out.code(distance, ds), out.put(dextra, dwide)
        for _ in range(64 - len(symbols) - n):
            out.code(green, 1)
        if text:
            with pytest.raises(ValueError, match=text):
                webp.decode(out.file())
        else:
            got = ((webp.decode(out.file()).reshape(-1) >> 8) & 255).tolist()
            want = list(symbols)
            for _ in range(n):
                want.append(want[-far])
            assert got == want + [1] * (64 - len(want))
