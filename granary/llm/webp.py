"""Lossless WebP: a decoder, and an encoder over numpy arrays.

`decode` reads the container, the transforms (predictor, cross-colour,
subtract-green, palette), prefix codes, back-references and the colour cache,
undoes the transforms and gives the pixels. `encode` writes prefix codes, back-references
and, as asked for, a colour cache and the transforms.
"""

from __future__ import annotations

import struct
from functools import lru_cache

import numpy as np

#: Fixed values of the format.
SIGNATURE = 0x2F
CODE_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
DISTANCES = (
    (0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2), (2, 1), (-2, 1), (2, 2), (-2, 2),
    (0, 3), (3, 0), (1, 3), (-1, 3), (3, 1), (-3, 1), (2, 3), (-2, 3), (3, 2), (-3, 2), (0, 4), (4, 0),
    (1, 4), (-1, 4), (4, 1), (-4, 1), (3, 3), (-3, 3), (2, 4), (-2, 4), (4, 2), (-4, 2), (0, 5), (3, 4),
    (-3, 4), (4, 3), (-4, 3), (5, 0), (1, 5), (-1, 5), (5, 1), (-5, 1), (2, 5), (-2, 5), (5, 2), (-5, 2),
    (4, 4), (-4, 4), (3, 5), (-3, 5), (5, 3), (-5, 3), (0, 6), (6, 0), (1, 6), (-1, 6), (6, 1), (-6, 1),
    (2, 6), (-2, 6), (6, 2), (-6, 2), (4, 5), (-4, 5), (5, 4), (-5, 4), (3, 6), (-3, 6), (6, 3), (-6, 3),
    (0, 7), (7, 0), (1, 7), (-1, 7), (5, 5), (-5, 5), (7, 1), (-7, 1), (4, 6), (-4, 6), (6, 4), (-6, 4),
    (2, 7), (-2, 7), (7, 2), (-7, 2), (3, 7), (-3, 7), (7, 3), (-7, 3), (5, 6), (-5, 6), (6, 5), (-6, 5),
    (8, 0), (4, 7), (-4, 7), (7, 4), (-7, 4), (8, 1), (8, 2), (6, 6), (-6, 6), (8, 3), (5, 7), (-5, 7),
    (7, 5), (-7, 5), (8, 4), (6, 7), (-6, 7), (7, 6), (-7, 6), (8, 5), (7, 7), (-7, 7), (8, 6), (8, 7),
)
CACHE_FACTOR = 0x1E35A7BD
PREDICTOR, CROSS_COLOUR, SUBTRACT_GREEN, PALETTE = range(4)
#: Largest width and height of an image.
MOST = 16384

class Corrupt(ValueError):
    """The bytes aren't a lossless WebP image."""


class Reader:
    """Bits, least significant first."""

    def __init__(self, data: bytes, pos: int = 0):
        self.data, self.pos, self.end = data, pos, 8 * len(data)

    def peek(self, n: int) -> int:
        at = self.pos >> 3
        return (int.from_bytes(self.data[at : at + 8], "little") >> (self.pos & 7)) & ((1 << n) - 1)

    def bits(self, n: int) -> int:
        value = self.peek(n)
        self.pos += n
        if self.pos > self.end:
            raise Corrupt("the bit stream ends early")
        return value


class Code:
    """A canonical prefix code: symbols and their sizes by the next bits, or the only symbol."""

    def __init__(self, lengths):
        lengths = np.asarray(lengths)
        used = np.flatnonzero(lengths)
        if not len(used):
            raise Corrupt("a prefix code has no symbol")
        self.only = int(used[0]) if len(used) == 1 else None
        self.most = 0
        self.symbols, self.sizes = np.array(used[:1], np.int64), np.zeros(1, np.int64)
        if self.only is None:
            sizes = lengths[used]
            if int((1 << (15 - sizes)).sum()) != 1 << 15:
                raise Corrupt("a prefix code isn't complete")
            order = np.argsort(sizes, kind="stable")
            self.most = int(sizes.max())
            # In order of size and symbol the codes, with their first bit on top, share out all numbers of `most` bits.
            repeat = 1 << (self.most - sizes[order])
            turned = _turned(self.most)
            self.symbols = np.repeat(used[order], repeat)[turned]
            self.sizes = np.repeat(sizes[order], repeat)[turned]
    def read(self, r: Reader) -> int:
        if self.only is not None:
            return self.only
        at = r.peek(self.most)
        r.pos += int(self.sizes[at])
        if r.pos > r.end:
            raise Corrupt("the bit stream ends early")
        return int(self.symbols[at])


@lru_cache(maxsize=16)
def _turned(bits: int) -> np.ndarray:
    """Numbers of so many bits, each with its bits in the other order."""
    out, numbers = np.zeros(1 << bits, np.int64), np.arange(1 << bits)
    for i in range(bits):
        out |= ((numbers >> i) & 1) << (bits - 1 - i)
    return out


@lru_cache(maxsize=512)
def _of_few(*symbols: int) -> Code:
    """The code of one symbol, or of two."""
    lengths = np.zeros(max(symbols) + 1, np.int64)
    lengths[list(symbols)] = 1
    return Code(lengths)


def read_code(r: Reader, size: int) -> Code:
    if r.bits(1):
        count, symbols = r.bits(1) + 1, []
        for i in range(count):
            symbols.append(r.bits(8 if i or r.bits(1) else 1))
        if max(symbols) >= size:
            raise Corrupt("a symbol is outside its alphabet")
        return _of_few(*sorted(set(symbols)))
    of_lengths = [0] * 19
    for i in range(4 + r.bits(4)):
        of_lengths[CODE_ORDER[i]] = r.bits(3)
    code = Code(of_lengths)
    left = 2 + r.bits(2 + 2 * r.bits(3)) if r.bits(1) else size
    lengths, before = [], 8
    table, mask, data = list(zip(code.symbols.tolist(), code.sizes.tolist(), strict=True)), (1 << code.most) - 1, r.data
    ahead = at = 0  # the next bits, as a number, and how many are left in it
    while len(lengths) < size and left:
        left -= 1
        if at < 14:
            ahead, at = int.from_bytes(data[r.pos >> 3 : (r.pos >> 3) + 8], "little") >> (r.pos & 7), 57
        n, used = table[ahead & mask]
        if n < 16:
            lengths.append(n)
            before = n or before
        else:
            extra, least = ((2, 3), (3, 3), (7, 11))[n - 16]
            lengths += [before if n == 16 else 0] * (least + ((ahead >> used) & ((1 << extra) - 1)))
            used += extra
        ahead >>= used
        at -= used
        r.pos += used
    if len(lengths) > size:
        raise Corrupt("there are too many code lengths")
    if r.pos > r.end:
        raise Corrupt("the bit stream ends early")
    return Code(lengths + [0] * (size - len(lengths)))


def _blocks(size: int, bits: int) -> int:
    return (size + (1 << bits) - 1) >> bits


def _extended(r: Reader, prefix: int) -> int:
    """The length or distance of a prefix symbol."""
    if prefix < 4:
        return prefix + 1
    extra = (prefix - 2) >> 1
    return ((2 + (prefix & 1)) << extra) + r.bits(extra) + 1


def read_image(r: Reader, width: int, height: int, main: bool) -> np.ndarray:
    """Pixels as ARGB numbers, before transforms are undone."""
    cache_bits = 0
    if r.bits(1):
        cache_bits = r.bits(4)
        if not 1 <= cache_bits <= 11:
            raise Corrupt("the colour cache's size is wrong")
    meta, meta_bits, groups = None, 0, 1
    if main and r.bits(1):
        meta_bits = r.bits(3) + 2
        meta = (read_image(r, _blocks(width, meta_bits), _blocks(height, meta_bits), False) >> 8) & 0xFFFF
        groups = int(meta.max()) + 1
    sizes = (256 + 24 + ((1 << cache_bits) if cache_bits else 0), 256, 256, 256, 40)
    codes = [[read_code(r, n) for n in sizes] for _ in range(groups)]
    if meta is None and not cache_bits and all(c.only is not None for c in codes[0][1:4]):
        return _read_green(r, width, height, codes[0])
    return _read_symbols(r, width, height, codes, None if meta is None else meta.tolist(), meta_bits, cache_bits)


#: Bytes whose bits are looked up at once; and more bits than a symbol takes.
BLOCK, SYMBOL = 1 << 15, 64


def _read_green(r: Reader, width: int, height: int, codes) -> np.ndarray:
    """Pixels of an image whose red, blue and alpha are the same everywhere: a symbol is a green or a back-reference.

    The size of the symbol that would start at a bit is looked up for all bits of a block; a walk from symbol to
    symbol tells at which they do start, and their greens are then looked up together.
    """
    total, code = width * height, codes[0]
    rest = codes[1].only << 16 | codes[2].only | codes[3].only << 24
    if code.only is not None and code.only < 256:
        return np.full((height, width), rest | code.only << 8, np.uint32)
    # A size of 0 stands for a back-reference, which is read by itself.
    sizes = np.where(code.symbols < 256, code.sizes, 0).astype(np.uint8)
    greens = code.symbols.astype(np.uint8)
    mask, near = np.uint32((1 << code.most) - 1), [0, *(max(1, x + y * width) for x, y in DISTANCES)]
    out, n, eight, tables, m0, m4 = bytearray(), 0, np.arange(8, dtype=np.uint32), None, int(mask), (1 << codes[4].most) - 1
    while n < total:
        first = r.pos >> 3
        size = min(BLOCK, len(r.data) - first, SYMBOL // 8 * (total - n) + 1)
        data = np.frombuffer(r.data[first : first + size].ljust(1, b"\0") + r.data[first + size : first + size + 2].ljust(2, b"\0"), np.uint8).astype(np.uint32)
        words = data[:-2] | data[1:-1] << np.uint32(8) | data[2:] << np.uint32(16)
        index = ((words[:, None] >> eight) & mask).ravel()
        step = sizes[index].tobytes()
        most = 8 * size
        # From each bit four symbols on; a back-reference goes nowhere.
        one = np.arange(most + 16, dtype=np.int32)  # beyond the block, the walk ends
        one[:most] += np.frombuffer(step, np.uint8)
        two = one[one]
        three, four = one[two], two[two]
        at, walk, references = r.pos & 7, [], []
        add, following = walk.append, memoryview(four)
        while at < most:
            if not step[at]:
                tables = tables or [x.tolist() for c in (code, codes[4]) for x in (c.symbols, c.sizes)]
                pos = 8 * first + at
                ahead, fields = int.from_bytes(r.data[pos >> 3 : (pos >> 3) + 16], "little") >> (pos & 7), []
                for symbols, bits, m in ((tables[0], tables[1], m0), (tables[2], tables[3], m4)):
                    prefix, used = symbols[ahead & m] & 255, bits[ahead & m]  # 256 is the first length
                    ahead >>= used
                    extra = 0 if prefix < 4 else (prefix - 2) >> 1
                    fields.append((prefix if prefix < 4 else ((2 + (prefix & 1)) << extra) + (ahead & ((1 << extra) - 1))) + 1)
                    ahead >>= extra
                    at += used + extra
                references.append((pos - 8 * first, *fields, 8 * first + at))
                continue
            add(at)
            at = following[at]
        met, begun = np.array(walk, np.int32), np.zeros(most + 16, bool)
        for places in (met, one[met], two[met], three[met]):
            begun[places] = True
        starts = begun[:most].nonzero()[0]
        own = index[starts]
        literal = sizes[own] > 0
        starts, values = starts[literal], greens[own[literal]].tobytes()
        places = np.searchsorted(starts, [x[0] for x in references]).tolist()
        done, end = 0, r.pos if not references and not len(values) else -1
        for (_, length, place, after), to in zip(references, places, strict=True):
            if len(out) + to - done >= total:
                break
            out += values[done:to]
            done, n = to, len(out)
            back = place - 120 if place > 120 else near[place]
            if back > n or n + length > total:
                raise Corrupt("a back-reference leaves the image")
            piece = out[n - back : n - back + length]
            out += piece if len(piece) == length else (piece * (length // len(piece) + 1))[:length]
            end = after
        keep = min(len(values), done + total - len(out))
        out += values[done:keep]
        n = len(out)
        if keep > done:  # the next symbol comes after the last literal that counts
            last = int(starts[keep - 1])
            end = 8 * first + last + step[last]
        if end < 0 or end > r.end or (n < total and end >= r.end):
            raise Corrupt("the bit stream ends early")
        r.pos = end
    return (np.frombuffer(bytes(out), np.uint8).astype(np.uint32) << np.uint32(8) | np.uint32(rest)).reshape(height, width)


#: Bits that are taken out of the stream at once.
AHEAD = 192


def _read_symbols(r: Reader, width: int, height: int, codes, meta, meta_bits: int, cache_bits: int) -> np.ndarray:
    """Pixels by their symbols; meta has the group of codes of each block of pixels, if there are several.

    Tables by the next bits have symbols, moved to their channel's place, above their size in six bits: so
    the sum of four entries is a pixel and its size.
    """
    total = width * height
    out: list[int] = []
    add, number, data = out.append, int.from_bytes, r.data
    cache = [0] * (1 << cache_bits) if cache_bits else None
    shift = 32 - cache_bits
    tables = [[x for c, place in zip(group, (8, 16, 0, 24, 0), strict=True) for x in (((c.symbols << (place + 6)) + c.sizes).tolist(), (1 << c.most) - 1)] for group in codes]
    t0, m0, t1, m1, t2, m2, t3, m3, t4, m4 = tables[0]
    near = [0, *(max(1, x + y * width) for x, y in DISTANCES)]
    literal, cached = 256 << 14, 280 << 14
    pos, ahead, left, filled, n = r.pos, 0, 0, 0, 0
    while n < total:
        if left < SYMBOL:
            pos += filled - left
            if pos > r.end:
                raise Corrupt("the bit stream ends early")
            ahead = number(data[pos >> 3 : (pos >> 3) + AHEAD // 8], "little") >> (pos & 7)
            left = filled = AHEAD - 7
        if meta is not None:
            t0, m0, t1, m1, t2, m2, t3, m3, t4, m4 = tables[meta[(n // width) >> meta_bits][(n % width) >> meta_bits]]
        e = t0[ahead & m0]
        rest = ahead >> (e & 63)
        if e < literal:
            a = t1[rest & m1]
            rest >>= a & 63
            b = t2[rest & m2]
            rest >>= b & 63
            c = t3[rest & m3]
            ahead = rest >> (c & 63)
            e += a + b + c
            left -= e & 63
            v = e >> 6
            add(v)
            n += 1
            if cache:
                cache[(v * CACHE_FACTOR & 0xFFFFFFFF) >> shift] = v
        elif e >= cached:
            if not cache:
                raise Corrupt("there is no colour cache")
            add(cache[(e >> 14) - 280])
            ahead = rest
            left -= e & 63
            n += 1
        else:
            used, pair = e & 63, []
            for prefix in ((e >> 14) - 256, None):
                if prefix is None:
                    a = t4[rest & m4]
                    rest >>= a & 63
                    used += a & 63
                    prefix = a >> 6
                extra = 0 if prefix < 4 else (prefix - 2) >> 1
                pair.append((prefix if prefix < 4 else ((2 + (prefix & 1)) << extra) + (rest & ((1 << extra) - 1))) + 1)
                rest >>= extra
                used += extra
            ahead = rest
            left -= used
            length, back = pair[0], pair[1] - 120 if pair[1] > 120 else near[pair[1]]
            if back > n or n + length > total:
                raise Corrupt("a back-reference leaves the image")
            new = out[n - back : n - back + length]
            while len(new) < length:
                new += new[: length - len(new)]
            out += new
            n += length
            if cache:
                for v in new:
                    cache[(v * CACHE_FACTOR & 0xFFFFFFFF) >> shift] = v
    r.pos = pos + filled - left
    if r.pos > r.end:
        raise Corrupt("the bit stream ends early")
    return np.array(out, np.uint32).reshape(height, width)


def _channels(pixels: np.ndarray) -> np.ndarray:
    """Blue, green, red, alpha of each pixel."""
    return np.ascontiguousarray(pixels, "<u4").view(np.uint8).reshape(*pixels.shape, 4)


def _packed(channels: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(channels).view("<u4").reshape(channels.shape[:2])


def _spread(values: np.ndarray, bits: int, height: int, width: int) -> np.ndarray:
    return np.repeat(np.repeat(values, 1 << bits, 0)[:height], 1 << bits, 1)[:, :width]


def _signed(values: np.ndarray) -> np.ndarray:
    return values.astype(np.int8).astype(np.int32)


def cross_colour(pixels: np.ndarray, table: np.ndarray, bits: int, back: bool) -> np.ndarray:
    """Take out of red and blue what green and red tell of them, or put it back."""
    own = _channels(_spread(table, bits, *pixels.shape))
    c = _channels(pixels).copy()
    to_red, to_blue, red_to_blue = (_signed(own[..., i]) for i in (0, 1, 2))
    green = _signed(c[..., 1])
    sign = 1 if back else -1
    red = c[..., 2].astype(np.int32)
    new_red = (red + sign * ((to_red * green) >> 5)) & 255
    by = _signed((new_red if back else red).astype(np.uint8))
    blue = c[..., 0].astype(np.int32) + sign * (((to_blue * green) >> 5) + ((red_to_blue * by) >> 5))
    c[..., 2], c[..., 0] = new_red, blue & 255
    return _packed(c)


def subtract_green(pixels: np.ndarray, back: bool) -> np.ndarray:
    c = _channels(pixels).copy()
    for i in (0, 2):
        c[..., i] = c[..., i] + c[..., 1] if back else c[..., i] - c[..., 1]
    return _packed(c)


def _half(a: int, b: int) -> int:
    return sum((((a >> s & 255) + (b >> s & 255)) >> 1) << s for s in (0, 8, 16, 24))


def _clamp(v: int) -> int:
    return 0 if v < 0 else 255 if v > 255 else v


def predict(mode: int, left: int, top: int, corner: int, right: int) -> int:
    """What a predictor mode says of a pixel, from its neighbours."""
    if mode == 0:
        return 0xFF000000
    if mode < 5:
        return (left, top, right, corner)[mode - 1]
    if mode == 5:
        return _half(_half(left, right), top)
    if mode == 6:
        return _half(left, corner)
    if mode == 7:
        return _half(left, top)
    if mode == 8:
        return _half(corner, top)
    if mode == 9:
        return _half(top, right)
    if mode == 10:
        return _half(_half(left, corner), _half(top, right))
    parts = [[p >> s & 255 for s in (0, 8, 16, 24)] for p in (left, top, corner)]
    if mode == 11:
        from_left = sum(abs(t - c) for _, t, c in zip(*parts, strict=True))
        from_top = sum(abs(p - c) for p, _, c in zip(*parts, strict=True))
        return left if from_left < from_top else top
    if mode == 12:
        return sum(_clamp(p + t - c) << s for p, t, c, s in zip(*parts, (0, 8, 16, 24), strict=True))
    if mode == 13:
        half = _half(left, top)
        mean = [half >> s & 255 for s in (0, 8, 16, 24)]
        return sum(_clamp(m + int((m - c) / 2)) << s for m, c, s in zip(mean, parts[2], (0, 8, 16, 24), strict=True))
    return 0xFF000000


def _add(a: int, b: int) -> int:
    return sum(((a >> s) + (b >> s) & 255) << s for s in (0, 8, 16, 24))


def unpredict(pixels: np.ndarray, modes: np.ndarray, bits: int) -> np.ndarray:
    """Undo the predictor transform. Modes 1 and 2 on whole images run as running sums."""
    height, width = pixels.shape
    used = set(np.unique(modes[:, :]).tolist())
    if used in ({1}, {2}) or (height == 1 or width == 1):
        return _running(pixels, 2 if used == {2} else 1)
    flat = pixels.ravel().tolist()
    for y in range(height):
        for x in range(width):
            i = y * width + x
            if not y:
                p = flat[i - 1] if x else 0xFF000000
            elif not x:
                p = flat[i - width]
            else:
                p = predict(int(modes[y >> bits, x >> bits]), flat[i - 1], flat[i - width], flat[i - width - 1], flat[i - width + 1])
            flat[i] = _add(flat[i], p)
    return np.array(flat, np.uint32).reshape(height, width)


def _running(pixels: np.ndarray, mode: int) -> np.ndarray:
    c = _channels(pixels).copy()
    c[0, 0, 3] = (int(c[0, 0, 3]) + 255) & 255
    c[0] = np.cumsum(c[0], 0, np.uint8)
    if mode == 1:
        c[:, 0] = np.cumsum(c[:, 0], 0, np.uint8)
        c[1:] = np.cumsum(c[1:], 1, np.uint8)
    else:
        c = np.cumsum(c, 0, np.uint8)
    return _packed(c)


def unpalette(pixels: np.ndarray, palette: np.ndarray, width: int) -> np.ndarray:
    """Colours of palette indexes, several of which may share a pixel's green."""
    size = len(palette)
    bits = 3 if size <= 2 else 2 if size <= 4 else 1 if size <= 16 else 0
    index = _channels(pixels)[..., 1]
    if bits:
        each = 8 >> bits
        index = np.stack([(index >> (each * i)) & ((1 << each) - 1) for i in range(1 << bits)], -1).reshape(index.shape[0], -1)[:, :width]
    known = np.zeros(256, np.uint32)
    known[:size] = palette
    return known[index]


def read_stream(data: bytes, largest: int = MOST * MOST) -> np.ndarray:
    """Pixels (height, width, RGBA) of a lossless bit stream."""
    r = Reader(data)
    if r.bits(8) != SIGNATURE:
        raise Corrupt("the signature is missing")
    width, height = r.bits(14) + 1, r.bits(14) + 1
    if width * height > largest:
        raise Corrupt("the image is too large")
    r.bits(1)
    if r.bits(3):
        raise Corrupt("the version isn't known")
    undo, inner, seen = [], width, set()
    while r.bits(1):
        kind = r.bits(2)
        if kind in seen:
            raise Corrupt("a transform occurs twice")
        seen.add(kind)
        if kind in (PREDICTOR, CROSS_COLOUR):
            bits = r.bits(3) + 2
            table = read_image(r, _blocks(inner, bits), _blocks(height, bits), False)
            undo.append((kind, table, bits, inner))
        elif kind == PALETTE:
            size = r.bits(8) + 1
            colours = _packed(np.cumsum(_channels(read_image(r, size, 1, False)), 1, np.uint8))[0]
            undo.append((kind, colours, 0, inner))
            inner = _blocks(inner, 3 if size <= 2 else 2 if size <= 4 else 1 if size <= 16 else 0)
        else:
            undo.append((kind, None, 0, inner))
    pixels = read_image(r, inner, height, True)
    for kind, table, bits, before in reversed(undo):
        if kind == PREDICTOR:
            pixels = unpredict(pixels, (table >> 8) & 15, bits)
        elif kind == CROSS_COLOUR:
            pixels = cross_colour(pixels, table, bits, True)
        elif kind == SUBTRACT_GREEN:
            pixels = subtract_green(pixels, True)
        else:
            pixels = unpalette(pixels, table, before)
    return _channels(pixels)[..., [2, 1, 0, 3]]


def chunks(data: bytes) -> list[tuple[bytes, bytes]]:
    """The chunks of a RIFF file of kind WEBP."""
    if len(data) < 12 or data[:4] != b"RIFF" or data[8:12] != b"WEBP":
        raise Corrupt("this isn't a WebP file")
    out, at, end = [], 12, 8 + int.from_bytes(data[4:8], "little")
    if end > len(data):
        raise Corrupt("the file ends early")
    while at + 8 <= end:
        n = int.from_bytes(data[at + 4 : at + 8], "little")
        if at + 8 + n > end:
            raise Corrupt("a chunk ends early")
        out.append((data[at : at + 4], data[at + 8 : at + 8 + n]))
        at += 8 + n + (n & 1)
    return out


def decode(data: bytes, largest: int = MOST * MOST) -> np.ndarray:
    """Pixels (height, width, RGBA) of a lossless WebP file; Corrupt if it isn't one, or has more pixels than `largest`."""
    for name, body in chunks(data):
        if name == b"VP8L":
            return read_stream(body, largest)
    raise Corrupt("there is no lossless image in the file")


#: Numbers that are turned to bits at once.
STEP = 1 << 14


class Writer:
    """Bits, least significant first."""

    def __init__(self):
        self.values, self.sizes, self.few = [], [], []

    def bits(self, value: int, n: int) -> None:
        self.few.append((value, n))

    def many(self, values: np.ndarray, sizes: np.ndarray) -> None:
        """Numbers, each of so many bits."""
        self.flush()
        self.values.append(values)
        self.sizes.append(sizes)

    def flush(self) -> None:
        if self.few:
            both = np.array(self.few, np.int64)
            self.values.append(both[:, 0])
            self.sizes.append(both[:, 1])
            self.few = []

    def bytes(self) -> bytes:
        self.flush()
        values, sizes = np.concatenate(self.values), np.concatenate(self.sizes)
        out = []
        for i in range(0, len(values), STEP):  # each number becomes as many single bits
            v, n = values[i : i + STEP], sizes[i : i + STEP]
            place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            out.append(((np.repeat(v, n) >> place) & 1).astype(np.uint8))
        return np.packbits(np.concatenate(out), bitorder="little").tobytes()


def wrap(stream: bytes) -> bytes:
    pad = len(stream) & 1
    return b"RIFF" + struct.pack("<I", 4 + 8 + len(stream) + pad) + b"WEBPVP8L" + struct.pack("<I", len(stream)) + stream + b"\0" * pad


def _write_lengths(w: Writer, lengths: np.ndarray) -> None:
    """A prefix code by its code lengths; runs of zeros are told by their number."""
    used = np.flatnonzero(lengths)
    if len(used) <= 2 and (used < 256).all():
        w.bits(1, 1)
        w.bits(max(1, len(used)) - 1, 1)
        w.bits(1, 1)
        w.bits(int(used[0]) if len(used) else 0, 8)
        if len(used) == 2:
            w.bits(int(used[1]), 8)
        return
    # Symbols 17 and 18: from 3 zeros on, and from 11 on.
    symbols, extras = [], []
    edges = np.flatnonzero(np.diff(lengths != 0)) + 1
    plain = lengths.tolist()
    for begin, end in zip([0, *edges.tolist()], [*edges.tolist(), len(plain)], strict=True):
        if plain[begin]:
            symbols += plain[begin:end]
            extras += [(0, 0)] * (end - begin)
            continue
        while begin < end:
            n = min(end - begin, 138)
            if n < 3:
                symbols += [0] * n
                extras += [(0, 0)] * n
            else:
                symbols.append(18 if n > 10 else 17)
                extras.append((n - 11, 7) if n > 10 else (n - 3, 3))
            begin += n
    w.bits(0, 1)
    head, values, sizes = _code_of_lengths()
    w.many(*head)
    more = np.array(extras, np.int64)
    fields = np.empty((2, len(symbols), 2), np.int64)
    fields[0, :, 0], fields[1, :, 0] = values[symbols], sizes[symbols]
    fields[:, :, 1] = more.T
    w.many(fields[0].ravel(), fields[1].ravel())


#: Code lengths that are written, at most; and the code of code lengths, which is always the same: mean ones are short in it.
LONGEST_CODE = 10
OF_LENGTHS = (6, 7, 7, 4, 3, 3, 3, 3, 3, 3, 6, 7, 7, 0, 0, 0, 0, 4, 4)


@lru_cache(maxsize=1)
def _code_of_lengths() -> tuple[tuple[np.ndarray, np.ndarray], np.ndarray, np.ndarray]:
    """What is written of the code of code lengths, and its codes and their sizes."""
    own = np.array(OF_LENGTHS, np.int64)
    head = np.concatenate([[15], own[list(CODE_ORDER)], [0]]), np.array([4, *[3] * 19, 1])
    return head, *_codes(own)


def code_lengths(counts: np.ndarray, most: int = LONGEST_CODE) -> np.ndarray:
    """Lengths of a complete prefix code for symbols by their counts; one symbol alone has length 1."""
    used = counts.nonzero()[0]
    lengths = np.zeros(len(counts), np.int64)
    if len(used) < 2:
        lengths[used if len(used) else [0]] = 1
        return lengths
    own = counts[used]
    order = own.argsort(kind="stable")
    sorted_counts = own[order].tolist()
    n, least = len(used), 1
    while True:
        # Two queues: symbols by count, and pairs, which come about in order of their counts.
        weights = sorted_counts if least == 1 else [max(c, least) for c in sorted_counts]
        weights = [*weights, 1 << 62]
        pairs, above, leaf, pair = [], [0] * (2 * n - 1), 0, 0
        for new in range(n - 1):
            total = 0
            for _ in (0, 1):
                if pair >= new or weights[leaf] <= pairs[pair]:
                    total += weights[leaf]
                    above[leaf] = n + new
                    leaf += 1
                else:
                    total += pairs[pair]
                    above[n + pair] = n + new
                    pair += 1
            pairs.append(total)
        depth = [0] * (2 * n - 1)
        for i in range(2 * n - 3, -1, -1):
            depth[i] = depth[above[i]] + 1
        if max(depth[:n]) <= most:
            lengths[used[order]] = depth[:n]
            return lengths
        least *= 2


def _codes(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes and their sizes by symbol; a symbol alone takes no bits."""
    lengths = np.asarray(lengths)
    used = np.flatnonzero(lengths)
    values, sizes = np.zeros(len(lengths), np.int64), np.array(lengths, np.int64)
    if len(used) == 1:
        return values, np.zeros(len(lengths), np.int64)
    order = used[np.argsort(lengths[used], kind="stable")]
    share = 1 << (15 - lengths[order])
    first = np.cumsum(share) - share
    values[order] = _turned(15)[first] & ((1 << lengths[order]) - 1)
    return values, sizes


def _prefix(value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lengths or distances as prefix symbols, their further bits and the number of those."""
    v = value - 1
    top = np.frexp(np.maximum(v, 1).astype(float))[1] - 1
    extra = np.where(v < 4, 0, top - 1)
    second = (v >> np.maximum(top - 1, 0)) & 1
    return np.where(v < 4, v, 2 * top + second), np.where(v < 4, 0, v & ((1 << extra) - 1)), extra


#: Pixels of the longest back-reference.
LONGEST = 4096
MIX = np.uint64(0x9E3779B97F4A7C15)


@lru_cache(maxsize=1)
def _prefixes() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What _prefix gives for all lengths."""
    return _prefix(np.maximum(np.arange(LONGEST + 1), 1))


def _matches(flat: np.ndarray, shortest: int, alone: bool) -> list[tuple[int, int, int]]:
    """Back-references (place, length, distance) by which an image repeats itself: each goes to the last place with the same first pixels."""
    if len(flat) <= shortest:
        return []
    width = 1 if alone else 4  # of one channel, bytes do
    raw = (flat >> np.uint32(8)).astype(np.uint8).tobytes() if width == 1 else flat.tobytes()
    shortest = max(shortest, 8 // width)
    count = len(flat) - shortest + 1
    if count < 2:
        return []
    # Eight bytes from each pixel on, and the last eight of the shortest reference, mixed; the place in the lowest bits.
    key = np.ndarray((count,), "<u8", raw, 0, (width,)) * MIX
    if shortest * width > 8:
        key = (key ^ np.ndarray((count,), "<u8", raw, shortest * width - 8, (width,))) * MIX
    low = np.uint64(count.bit_length())
    key = (key >> low << low) | np.arange(count, dtype=np.uint64)
    key.sort()
    same = ((key[1:] ^ key[:-1]) >> low == 0).nonzero()[0]
    if not len(same):
        return []
    place = (key & ((np.uint64(1) << low) - np.uint64(1))).astype(np.int64)
    later, earlier = place[same + 1], place[same]
    order = later.argsort()
    out, at, number = [], 0, int.from_bytes
    for i, j in zip(later[order].tolist(), earlier[order].tolist(), strict=True):
        if i < at:
            continue
        # Equal bytes from both places on: the lowest bit in which numbers made of them differ tells how many.
        n, most, step = 0, width * min(LONGEST, len(flat) - i), 32 * width
        a, b = i * width, j * width
        while n < most:
            step = min(step, most - n)
            x = number(raw[a + n : a + n + step], "little") ^ number(raw[b + n : b + n + step], "little")
            if x:
                n += ((x & -x).bit_length() - 1) >> 3
                break
            n += step
            step *= 4
        n //= width
        if n >= shortest:
            out.append((i, n, i - j))
            at = i + n
    return out


def _cached(flat: np.ndarray, cache_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Each pixel's place in the colour cache, and whether the cache has that pixel there just before."""
    slot = ((flat * np.uint32(CACHE_FACTOR)) >> np.uint32(32 - cache_bits)).astype(np.int64)
    order = np.argsort(slot, kind="stable")
    hit = np.zeros(len(flat), bool)
    again = (slot[order[1:]] == slot[order[:-1]]) & (flat[order[1:]] == flat[order[:-1]])
    hit[order[1:][again]] = True
    return slot, hit


#: Codes and sizes of a code of one symbol.
_NONE = np.zeros(280, np.int64), np.zeros(280, np.int64)


@lru_cache(maxsize=64)
def _near(width: int) -> dict[int, int]:
    """Distances that have a code of their own, in images of that width."""
    return {max(1, x + y * width): k for k, (x, y) in reversed(list(enumerate(DISTANCES, 1)))}


def _write_image(w: Writer, pixels: np.ndarray, cache_bits: int, main: bool, shortest: int = 3) -> None:
    flat, width = np.ascontiguousarray(pixels, np.uint32).ravel(), pixels.shape[1]
    rest = flat & np.uint32(0xFFFF00FF)
    alone = bool((rest == rest[0]).all())  # all but green is the same everywhere
    found = np.array(_matches(flat, shortest, alone), np.int64).reshape(-1, 3)
    covered = np.zeros(len(flat), bool)
    for i, n in found[:, :2].tolist():
        covered[i : i + n] = True
    single = (~covered).nonzero()[0]
    px = flat[single].astype(np.int64)
    green, pure = (px >> 8) & 255, slice(None)
    if cache_bits:
        slot, hit = _cached(flat, cache_bits)
        own = hit[single]
        green[own] = 280 + slot[single][own]
        pure = ~own
    counts = np.bincount(green, minlength=280 + ((1 << cache_bits) if cache_bits else 0))
    if len(found):
        near = _near(width)
        size, symbol, after = (x[found[:, 1]] for x in _prefixes())
        dist, more, bits = _prefix(np.array([near.get(d, d + 120) for d in found[:, 2].tolist()], np.int64))
        counts[256:280] = np.bincount(size, minlength=24)
    w.bits(bool(cache_bits), 1)
    if cache_bits:
        w.bits(cache_bits, 4)
    if main:
        w.bits(0, 1)
    # The bits of a symbol come one after another: green, red, blue and alpha; or a length, its bits, a distance and its bits.
    table = _write_code(w, counts)
    values, sizes = table[0][green], table[1][green]
    for shift in (16, 0, 24):
        if alone:
            w.few += _few(int(rest[0]) >> shift & 255)
            continue
        c = (px[pure] >> shift) & 255
        own = _write_code(w, np.bincount(c, minlength=256))
        values[pure] |= own[0][c] << sizes[pure]
        sizes[pure] += own[1][c]
    if not len(found):
        w.few += _few(0)
        w.many(values, sizes)
        return
    own = _write_code(w, np.bincount(dist, minlength=40))
    far, used = table[0][256 + size], table[1][256 + size]
    for value, n in ((symbol, after), (own[0][dist], own[1][dist]), (more, bits)):
        far, used = far | value << used, used + n
    at = np.searchsorted(single, found[:, 0])
    w.many(np.insert(values, at, far), np.insert(sizes, at, used))


def _few(symbol: int) -> list[tuple[int, int]]:
    """What is written of a code of one symbol."""
    return [(1, 1), (0, 1), (1, 1), (symbol, 8)]


def _write_code(w: Writer, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Write a code for symbols by their counts, and give the codes and their sizes."""
    used = counts.nonzero()[0]
    if len(used) < 2 and (not len(used) or used[0] < 256):
        w.few += _few(int(used[0]) if len(used) else 0)
        return _NONE
    lengths = code_lengths(counts)
    if len(used) == 1:
        lengths[0] = 1  # a second symbol, for a code whose only one has no short form
    _write_lengths(w, lengths)
    return _codes(lengths)


def encode(pixels: np.ndarray, cache_bits: int = 6, predictor: int | None = None, cross: tuple[int, int, int] | None = None, green: bool = False, palette: bool = False, bits: int = 3, shortest: int = 3) -> bytes:
    """A lossless WebP file of pixels (height, width, RGBA) with the transforms asked for.

    bits: a transform's blocks have 2 ** bits rows and columns. shortest: pixels of a back-reference at least.
    """
    height, width = pixels.shape[:2]
    if not (0 < height <= MOST and 0 < width <= MOST):
        raise ValueError("an image has from 1 to 16384 rows and columns")
    w = Writer()
    for value, n in ((SIGNATURE, 8), (width - 1, 14), (height - 1, 14), (1, 1), (0, 3)):
        w.bits(value, n)
    image = _packed(pixels[..., [2, 1, 0, 3]].astype(np.uint8))

    def table(value: int) -> np.ndarray:
        return np.full((_blocks(height, bits), _blocks(image.shape[1], bits)), value, np.uint32)

    if palette:
        colours, index = np.unique(image, return_inverse=True)
        if len(colours) > 256:
            raise ValueError("a palette has 256 colours at most")
        w.bits(1, 1)
        w.bits(PALETTE, 2)
        w.bits(len(colours) - 1, 8)
        steps = _channels(colours[None]).copy()
        steps[:, 1:] -= _channels(colours[None])[:, :-1]
        _write_image(w, _packed(steps), 0, False)
        pack = 3 if len(colours) <= 2 else 2 if len(colours) <= 4 else 1 if len(colours) <= 16 else 0
        inner = _blocks(width, pack)
        index = np.pad(index.reshape(height, width), ((0, 0), (0, (inner << pack) - width))).reshape(height, inner, 1 << pack)
        image = (sum(index[..., i] << ((8 >> pack) * i) for i in range(1 << pack)) << 8 | 0xFF000000).astype(np.uint32)
    if green:
        w.bits(1, 1)
        w.bits(SUBTRACT_GREEN, 2)
        image = subtract_green(image, False)
    if predictor is not None:
        w.bits(1, 1)
        w.bits(PREDICTOR, 2)
        w.bits(bits - 2, 3)
        _write_image(w, table(predictor << 8), 0, False)
        image = residuals(image, predictor)
    if cross is not None:
        w.bits(1, 1)
        w.bits(CROSS_COLOUR, 2)
        w.bits(bits - 2, 3)
        own = table((cross[0] & 255) | (cross[1] & 255) << 8 | (cross[2] & 255) << 16)
        _write_image(w, own, 0, False)
        image = cross_colour(image, own, bits, False)
    w.bits(0, 1)
    _write_image(w, image, cache_bits, True, shortest)
    return wrap(w.bytes())


def residuals(image: np.ndarray, mode: int) -> np.ndarray:
    """What a predictor mode leaves of an image."""
    height, width = image.shape
    if mode in (1, 2):
        c = _channels(image)
        out = c.copy()
        out[:, 1:] -= c[:, :-1]
        out[1:, 0] -= c[:-1, 0]
        if mode == 2:
            out[1:] = c[1:] - c[:-1]
        out[0, 0, 3] = (int(out[0, 0, 3]) + 1) & 255
        return _packed(out)
    flat = image.ravel().tolist()
    out = []
    for y in range(height):
        for x in range(width):
            i = y * width + x
            if not y:
                p = flat[i - 1] if x else 0xFF000000
            elif not x:
                p = flat[i - width]
            else:
                p = predict(mode, flat[i - 1], flat[i - width], flat[i - width - 1], flat[i - width + 1])
            out.append(sum(((flat[i] >> s) - (p >> s) & 255) << s for s in (0, 8, 16, 24)))
    return np.array(out, np.uint32).reshape(height, width)
