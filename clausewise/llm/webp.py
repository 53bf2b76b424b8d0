"""Lossless WebP: a reader of the whole format and a writer, in Python and numpy.

``decode`` reads prefix codes (simple and normal), back-references with the plane-distance map, the colour cache and
entropy groups, and inverts predictor, cross-colour, subtract-green and palette transforms.  ``decode_all`` reads many
files at once, each with its own prefix codes: all their streams are read in step, a symbol of each at a time, literals
of four channels, back-references and colour cache alike; transforms are inverted behind.

``encode_argb`` writes any of these features on demand; ``encode_bytes`` writes 8-bit samples as one still grey image, with
a palette where they have few values, else with subtract-green and with what an estimate of the image's own bits finds
cheapest: a predictor mode for each tile or none, a colour cache of some size or none, and entropy groups of tiles; repeats are
back-references, near ones by the plane-distance map, and every group has prefix codes of its own counts.  Cross-colour
has nothing to do there: subtract-green leaves no red and no blue in a grey image.
Back-references and hits of the cache stay inside parts of ``PART`` samples, and images of several parts carry a chunk of
their own (``INDEX``, which other readers skip as the format asks) with the bit where each part begins, so that the parts
of a long image are read in step as well.
"""

from __future__ import annotations

import struct
from collections import Counter
from functools import lru_cache

import numpy as np

MAX_SIDE = 16384
#: Samples inside which back-references of a payload stay, and the chunk that says where each such part begins.
PART = 1 << 12
INDEX = b"CWPT"
#: Samples of one image at most; a longer payload, which no image of the format holds, is stored as several files end to end.
LARGEST = MAX_SIDE * MAX_SIDE
#: Shortest back-reference that is written, bytes that are compared to find one, and the share of places (a power of two) where one is looked for.
SHORTEST_COPY = 8
SEED = 12
SPARSE = 8
#: Payloads of so few values (and up to so many samples) get a palette, whose indices are packed two or more to a pixel.
FEW = 16
FEW_SAMPLES = 1 << 16
#: Rows (as a power of two) of a payload's tiles, which are as wide as the image, so that a part lies in one tile; sizes of the colour
#: cache that are tried; entropy groups of an image at most.
TILE = 6
CACHES = (1, 3)
GROUPS = 16
#: Samples that are written at once (or one image, if longer).
AT_ONCE = 1 << 18

# Fixed values of the format: order in which lengths of the code-length code are stored.
LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
#: Near offsets of back-references, by distance, then by |x|, right before left.
PLANE = sorted(((x, y) for y in range(8) for x in range(-7, 9) if y or x > 0), key=lambda p: (p[0] ** 2 + p[1] ** 2, abs(p[0]), p[0] < 0))
PREDICTOR, CROSS, GREEN, PALETTE = range(4)


# ---------------------------------------------------------------- prefix codes


def canonical(lengths: list[int]) -> dict[int, tuple[int, int]]:
    """symbol -> (bits as they lie in the stream, length); one symbol alone takes no bits."""
    used = [(n, s) for s, n in enumerate(lengths) if n]
    if len(used) == 1:
        return {used[0][1]: (0, 0)}
    out, code, last = {}, 0, 0
    for n, s in sorted(used):
        code <<= n - last
        out[s] = (int(f"{code:0{n}b}"[::-1], 2), n)
        code, last = code + 1, n
    return out


def huffman(counts: dict[int, int], size: int, limit: int = 15) -> list[int]:
    """Code lengths of at most ``limit`` bits; flatter counts are tried until they fit."""
    lengths = [0] * size
    if len(counts) <= 1:
        for s in counts or {0: 1}:
            lengths[s] = 1
        return lengths
    used, floor = sorted(counts, key=lambda s: (counts[s], s)), 1
    n = len(used)
    while True:
        # leaves and inner nodes both come in order of their weight
        leaf, node, above, i, j = [max(counts[s], floor) for s in used], [], [0] * (2 * n - 1), 0, 0
        for top in range(n, 2 * n - 1):
            weight = 0
            for _ in (0, 1):
                if i < n and (j == len(node) or leaf[i] <= node[j]):
                    weight += leaf[i]
                    above[i] = top
                    i += 1
                else:
                    weight += node[j]
                    above[n + j] = top
                    j += 1
            node.append(weight)
        depth = [0] * (2 * n - 1)
        for k in range(2 * n - 3, -1, -1):
            depth[k] = depth[above[k]] + 1
        if depth[0] <= limit:
            break
        floor = floor * 2 + 1
    for s, k in zip(used, depth):
        lengths[s] = k
    return lengths


class Bits:
    """Reads a stream of bits, lowest first."""

    WINDOW = 1 << 8

    def __init__(self, data: bytes, at: int = 0):
        self.value, self.at = int.from_bytes(data[: self.WINDOW], "little"), at
        self.data, self.base, self.have = data, 0, min(len(data), self.WINDOW) * 8

    def _window(self, n: int) -> None:
        if self.at + n > self.base + self.have:
            first = self.at // 8
            piece = self.data[first : first + self.WINDOW]
            self.value, self.base, self.have = int.from_bytes(piece, "little"), first * 8, max(len(piece) * 8, n + 8)

    def read(self, n: int) -> int:
        self._window(n)
        out = (self.value >> (self.at - self.base)) & ((1 << n) - 1)
        self.at += n
        return out

    def symbol(self, table: tuple[int, dict]) -> int:
        width, codes = table
        if not width:
            return codes[0][0]
        self._window(width)
        s, n = codes[(self.value >> (self.at - self.base)) & ((1 << width) - 1)]
        self.at += n
        return s


def table_of(lengths: list[int]) -> tuple[int, dict]:
    codes = canonical(lengths)
    if not codes:
        raise ValueError("a prefix code without symbols")
    if len(codes) == 1:
        return 0, {0: (next(iter(codes)), 0)}
    width = max(n for _, n in codes.values())
    if width and sum(2 ** (width - n) for _, n in codes.values()) != 1 << width:
        raise ValueError("a prefix code that is not complete")
    look = {}
    for s, (bits, n) in codes.items():
        for high in range(1 << (width - n)):
            look[bits | high << n] = (s, n)
    return width, look


def read_lengths(bits: Bits, size: int) -> list[int]:
    lengths = [0] * size
    if bits.read(1):
        two, wide = bits.read(1), bits.read(1)
        for s in [bits.read(8 if wide else 1), *([bits.read(8)] if two else [])]:
            lengths[s] = 1
        return lengths
    first = [0] * 19
    for k in range(4 + bits.read(4)):
        first[LENGTH_ORDER[k]] = bits.read(3)
    (width, look), most = table_of(first), size
    if bits.read(1):
        most = 2 + bits.read(2 + 2 * bits.read(3))
    # a symbol and its extra bits are 14 at most
    value = int.from_bytes(bits.data[bits.at // 8 : bits.at // 8 + 2 * size + 2], "little") >> bits.at % 8
    low, at, last, spent = (1 << width) - 1, 0, 8, 0
    while at < size and most:
        most -= 1
        s, n = look[value & low]
        value >>= n
        spent += n
        if s < 16:
            lengths[at] = s
            at, last = at + 1, s or last
        else:
            fill, base, more = (last, 3, 2) if s == 16 else (0, 3, 3) if s == 17 else (0, 11, 7)
            run = base + (value & ((1 << more) - 1))
            value >>= more
            spent += more
            if at + run > size:
                raise ValueError("code lengths run over their alphabet")
            if fill:
                lengths[at : at + run] = [fill] * run
            at += run
    bits.at += spent
    return lengths


def _extended(code: int, bits: Bits) -> int:
    if code < 4:
        return code + 1
    extra = (code - 2) >> 1
    return ((2 + (code & 1)) << extra) + bits.read(extra) + 1


# ---------------------------------------------------------------- reading


def _pixels(bits: Bits, w: int, h: int, main: bool) -> np.ndarray:
    """An entropy-coded image of packed ARGB values."""
    cache_bits = bits.read(4) if bits.read(1) else 0
    groups_of, block = None, 0
    if main and bits.read(1):
        block = bits.read(3) + 2
        gw = -(-w // (1 << block))
        groups_of = (_pixels(bits, gw, -(-h // (1 << block)), False) >> 8 & 0xFFFF).tolist()
    sizes = (280 + ((1 << cache_bits) if cache_bits else 0), 256, 256, 256, 40)
    lengths = [[read_lengths(bits, n) for n in sizes] for _ in range(max(groups_of) + 1 if groups_of else 1)]
    groups = [[table_of(x) for x in g] for g in lengths]
    out, n = [0] * (w * h), w * h
    cache = [0] * (1 << cache_bits)
    at, (green, red, blue, alpha, far) = 0, groups[0]
    while at < n:
        if groups_of:
            green, red, blue, alpha, far = groups[groups_of[(at // w >> block) * gw + (at % w >> block)]]
        s = bits.symbol(green)
        if s < 256:
            r, b, a = bits.symbol(red), bits.symbol(blue), bits.symbol(alpha)
            p = a << 24 | r << 16 | s << 8 | b
            fresh = (p,)
        elif s < 280:
            length = _extended(s - 256, bits)
            d = _extended(bits.symbol(far), bits)
            if d > 120:
                d -= 120
            else:
                x, y = PLANE[d - 1]
                d = max(1, x + y * w)
            if d > at:
                raise ValueError("a back-reference before the first pixel")
            fresh = [0] * min(length, n - at)
            for k in range(len(fresh)):
                fresh[k] = out[at + k - d] if k < d else fresh[k - d]
        else:
            fresh = (cache[s - 280],)
        for p in fresh:
            out[at] = p
            at += 1
            if cache_bits:
                cache[(0x1E35A7BD * p & 0xFFFFFFFF) >> (32 - cache_bits)] = p
    return np.array(out, dtype=np.uint32)


def _split(p: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(p, dtype="<u4").view(np.uint8).reshape(*p.shape, 4)  # blue, green, red, alpha


def _join(c: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(c, dtype=np.uint8).view("<u4").reshape(c.shape[:-1]).astype(np.uint32)


def _average(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a & b) + ((a ^ b) >> 1)


def _predict(mode: int, left: np.ndarray, top: np.ndarray, topleft: np.ndarray, topright: np.ndarray) -> np.ndarray:
    """The guess of a mode from the neighbours of many pixels: bytes, with channels (four, or green alone) along the last axis."""
    if mode == 0:
        return np.broadcast_to(np.array([0, 0, 0, 255] if left.shape[-1] == 4 else [0], np.uint8), left.shape)
    if mode < 5:
        return (left, top, topright, topleft)[mode - 1]
    if mode == 5:
        return _average(_average(left, topright), top)
    if mode == 6:
        return _average(left, topleft)
    if mode == 7:
        return _average(left, top)
    if mode == 8:
        return _average(topleft, top)
    if mode == 9:
        return _average(top, topright)
    if mode == 10:
        return _average(_average(left, topleft), _average(top, topright))
    corner = topleft.astype(np.int16)
    if mode == 11:
        to_left, to_top = abs(top - corner), abs(left - corner)
        if left.shape[-1] > 1:
            to_left, to_top = to_left.sum(axis=-1, keepdims=True), to_top.sum(axis=-1, keepdims=True)
        return np.where(to_left < to_top, left, top)
    if mode == 12:
        return np.clip(left + (top - corner), 0, 255).astype(np.uint8)
    mean = _average(left, top)
    d = mean - corner
    return np.clip(mean + ((d + (d < 0)) >> 1), 0, 255).astype(np.uint8)


def _predicted(image: np.ndarray, modes: np.ndarray, block: int, undo: bool) -> np.ndarray:
    """Add (undo) or take away each pixel's prediction from those before it."""
    h, w = image.shape
    c = _split(image).reshape(-1, 4).copy()
    kinds = (modes >> 8 & 15)[np.arange(h)[:, None] >> block, np.arange(w)[None, :] >> block].reshape(-1)
    present = np.unique(kinds).tolist()

    def guess(at: np.ndarray) -> np.ndarray:
        # the place right above the last of a row is, counted on, the first of its own row, as the format has it
        near = c[at - 1], c[at - w], c[at - w - 1], c[at - w + 1]
        if len(present) == 1:
            return _predict(present[0], *near)
        out, kind = np.zeros_like(near[0]), kinds[at]
        for mode in present:
            np.copyto(out, _predict(mode, *near), where=(kind == mode)[:, None])
        return out

    grid = c.reshape(h, w, 4)
    if not undo:
        inner = np.arange(h * w).reshape(h, w)[1:, 1:].reshape(-1)
        left = c[inner] - guess(inner) if inner.size else None
        row, column = np.diff(grid[0], axis=0), np.diff(grid[:, 0], axis=0)
        grid[0, :1, 3] -= np.uint8(255)
        grid[0, 1:], grid[1:, 0] = row, column
        if inner.size:
            c[inner] = left
        return _join(grid)
    grid[0, :1, 3] += np.uint8(255)
    grid[0] = np.cumsum(grid[0], axis=0, dtype=np.uint8)
    grid[:, 0] = np.cumsum(grid[:, 0], axis=0, dtype=np.uint8)
    # pixels of one x + 2 y need only those of smaller ones
    for t in range(3, w + 2 * h - 2):
        y = np.arange(max(1, (t - w + 2) // 2), min(h - 1, (t - 1) // 2) + 1)
        if y.size:
            at = y * (w - 2) + t
            c[at] += guess(at)
    return _join(grid)


def _crossed(image: np.ndarray, factors: np.ndarray, block: int, undo: bool) -> np.ndarray:
    """Move red and blue by what their tile's factors make of green (and of red, for blue)."""
    h, w = image.shape
    c = _split(image).astype(np.int32)
    f = _split(factors).view(np.int8).astype(np.int32)[np.arange(h)[:, None] >> block, np.arange(w)[None, :] >> block]
    signed = lambda v: (v & 255 ^ 128) - 128
    blue, green, red = c[..., 0], signed(c[..., 1]), c[..., 2]
    sign = 1 if undo else -1
    moved = red + sign * (f[..., 0] * green >> 5)
    from_red = moved if undo else red
    blue = blue + sign * ((f[..., 1] * green >> 5) + (f[..., 2] * signed(from_red) >> 5))
    c[..., 0], c[..., 2] = blue & 255, moved & 255
    return _join(c.astype(np.uint8))


def _green(image: np.ndarray, undo: bool) -> np.ndarray:
    c = _split(image).copy()
    for k in (0, 2):
        c[..., k] = c[..., k] + c[..., 1] if undo else c[..., k] - c[..., 1]
    return _join(c)


def _bundle(colours: int) -> int:
    return 3 if colours <= 2 else 2 if colours <= 4 else 1 if colours <= 16 else 0


def _body(data: bytes, at: int) -> tuple[int, int, int, tuple[int, int] | None]:
    """Where the lossless stream of the file at ``at`` begins and ends, where the next file begins, and the span of its index of parts."""
    if data[at : at + 4] != b"RIFF" or data[at + 8 : at + 12] != b"WEBP":
        raise ValueError("not a WebP file")
    end = at + 8 + struct.unpack_from("<I", data, at + 4)[0]
    place, body, index = at + 12, None, None
    while place + 8 <= end:
        kind, n = data[place : place + 4], struct.unpack_from("<I", data, place + 4)[0]
        if kind == b"VP8L":
            body = place + 8, place + 8 + n
        elif kind == INDEX:
            index = place + 8, place + 8 + n
        place += 8 + n + n % 2
    if body is None or data[body[0]] != 0x2F:
        raise ValueError("no lossless image in this file")
    return *body, end + end % 2, index


def _parts(index: bytes, pixels: int) -> tuple[list[int], list[int]]:
    """Bits behind the head where the parts of an image begin, and how many pixels each has."""
    size = struct.unpack_from("<I", index)[0]
    starts = np.frombuffer(index, "<u8", offset=4).tolist()
    if not size or len(starts) != -(-pixels // size) or starts[:1] != [0]:
        raise ValueError("an index that does not fit its image")
    return starts, [min(size, pixels - k * size) for k in range(len(starts))]


def _shape(bits: Bits) -> tuple[int, int]:
    w, h = bits.read(14) + 1, bits.read(14) + 1
    bits.read(1)
    if bits.read(3):
        raise ValueError("an unknown version")
    return w, h


def _transforms(bits: Bits, w: int, h: int) -> tuple[list[tuple], int]:
    """The transforms of an image and the width of what follows them."""
    todo, width = [], w
    while bits.read(1):
        kind = bits.read(2)
        if kind in (PREDICTOR, CROSS):
            block = bits.read(3) + 2
            tw, th = -(-width // (1 << block)), -(-h // (1 << block))
            todo.append((kind, block, _pixels(bits, tw, th, False).reshape(th, tw), width))
        elif kind == GREEN:
            todo.append((kind, 0, None, width))
        else:
            n = bits.read(8) + 1
            colours = np.cumsum(_split(_pixels(bits, n, 1, False)).astype(np.int64), axis=0).astype(np.uint8)
            todo.append((kind, n, _join(colours), width))
            width = -(-width // (1 << _bundle(n)))
    return todo, width


def _file(data: bytes, at: int) -> tuple[np.ndarray, int]:
    first, last, after, _ = _body(data, at)
    bits = Bits(data[first:last], 8)
    w, h = _shape(bits)
    todo, width = _transforms(bits, w, h)
    return _inverted(_pixels(bits, width, h, True).reshape(h, width), todo), after


def _inverted(image: np.ndarray, todo: list[tuple]) -> np.ndarray:
    """The image with its transforms undone, the last written first."""
    h = image.shape[0]
    for kind, number, extra, width in reversed(todo):
        if kind == PREDICTOR:
            image = _predicted(image, extra, number, True)
        elif kind == CROSS:
            image = _crossed(image, extra, number, True)
        elif kind == GREEN:
            image = _green(image, True)
        else:
            index, k = image >> 8 & 255, _bundle(number)
            if k:
                each = 8 >> k
                index = np.stack([index >> (each * i) & ((1 << each) - 1) for i in range(1 << k)], axis=-1).reshape(h, -1)[:, :width]
            image = np.r_[extra, np.zeros(256 - number, dtype=np.uint32)][index]
    return image


def decode(data: bytes) -> list[np.ndarray]:
    """The images of one or more files laid end to end: arrays of ARGB values, height by width."""
    out, at = [], 0
    while at < len(data):
        image, at = _file(data, at)
        out.append(image)
    return out


# ---------------------------------------------------------------- reading many streams in step


@lru_cache(16)
def _reversed(width: int) -> np.ndarray:
    """The numbers of ``width`` bits with their bits turned round."""
    out = np.zeros(1, np.int64)
    for _ in range(width):
        out = np.r_[out * 2, out * 2 + 1]
    return out


def _flat_code(bits: Bits, size: int) -> np.ndarray:
    """A prefix code as a flat table over its next bits: symbol << 4 | length."""
    before = bits.at
    if bits.read(1):
        two, wide = bits.read(1), bits.read(1)
        symbols = sorted({bits.read(8 if wide else 1), *([bits.read(8)] if two else [])})
        if symbols[-1] >= size:
            raise ValueError("a symbol outside its alphabet")
        return np.array([s << 4 | len(symbols) - 1 for s in symbols], np.uint16)
    bits.at = before
    lengths = np.array(read_lengths(bits, size))
    used = np.flatnonzero(lengths)
    if not used.size:
        raise ValueError("a prefix code without symbols")
    if used.size == 1:
        return (used << 4).astype(np.uint16)
    used = used[np.argsort(lengths[used], kind="stable")]
    width = int(lengths[used[-1]])
    wide = 1 << (width - lengths[used])
    if wide.sum() != 1 << width:
        raise ValueError("a prefix code that is not complete")
    return np.repeat((used << 4 | lengths[used]).astype(np.uint16), wide)[_reversed(width)]


class _Head:
    """What stands before the pixels of a stream: shape, transforms, cache bits, entropy groups and their prefix codes as flat tables."""

    def __init__(self, stream: bytes):
        bits = Bits(stream, 8)
        self.w, self.h = _shape(bits)
        self.todo, self.width = _transforms(bits, self.w, self.h)
        self.cache_bits = bits.read(4) if bits.read(1) else 0
        self.block, self.groups_of = 0, None
        if bits.read(1):
            self.block = bits.read(3) + 2
            gw, gh = (-(-n // (1 << self.block)) for n in (self.width, self.h))
            self.groups_of = (_pixels(bits, gw, gh, False) >> 8 & 0xFFFF).reshape(gh, gw)
        sizes = (280 + ((1 << self.cache_bits) if self.cache_bits else 0), 256, 256, 256, 40)
        many = 1 if self.groups_of is None else int(self.groups_of.max()) + 1
        self.codes = [[_flat_code(bits, n) for n in sizes] for _ in range(many)]
        self.bits = bits.at

    def group(self, start: int, n: int) -> int | None:
        """The group of the ``n`` pixels from ``start`` on; null where they have several."""
        if self.groups_of is None:
            return 0
        rows = self.groups_of[start // self.width >> self.block : ((start + n - 1) // self.width >> self.block) + 1]
        return int(rows[0, 0]) if (rows == rows[0, 0]).all() else None


def _in_step(raw: np.ndarray, store: np.ndarray, tables: np.ndarray, rest: np.ndarray, cache_bits: np.ndarray,
             at_bits: np.ndarray, widths: np.ndarray, counts: np.ndarray) -> list[np.ndarray]:
    """Pixels of many streams: ``raw`` are all 64-bit words, one for each byte, ``at_bits`` where the pixels of each stream begin.

    ``tables`` says for each stream where in ``store`` its five prefix codes begin, and their masks; ``rest`` has the
    other channels where they take no bits in any stream (else it is null).
    """
    lanes = len(at_bits)
    out = np.zeros((lanes, int(counts.max())), np.uint32)
    first, mask = tables[:, :5], tables[:, 5:].astype(np.uint64)
    cache = np.zeros((lanes, 1 << int(cache_bits.max())), np.uint32) if cache_bits.any() else None
    drop = (32 - cache_bits).astype(np.uint64)
    lane, pos, at = np.arange(lanes), at_bits.astype(np.int64), np.zeros(lanes, np.int64)
    counts = counts.astype(np.int64)

    def word(p: np.ndarray) -> np.ndarray:
        return raw[p >> 3] >> (p & 7).view(np.uint64)

    def entry_of(code: int, rows: np.ndarray, p: np.ndarray) -> np.ndarray:
        return store[first[rows, code] + (word(p) & mask[rows, code]).view(np.int64)]

    def slot(pixels: np.ndarray, rows: np.ndarray) -> np.ndarray:
        return ((np.uint32(0x1E35A7BD) * pixels).astype(np.uint64) >> drop[rows]).astype(np.int64)

    def number(prefix: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values of length and distance prefixes, and the places behind their extra bits."""
        extra = np.maximum((prefix - 2) >> 1, 0)
        bits = (word(p) & ((np.uint64(1) << extra.astype(np.uint64)) - np.uint64(1))).astype(np.int64)
        return np.where(prefix < 4, prefix + 1, ((2 + (prefix & 1)) << extra) + bits + 1), p + extra

    base, low = first[:, 0].copy(), mask[:, 0].copy()
    while lane.size:
        entry = store[base + (word(pos) & low).view(np.int64)]
        symbol = entry >> 4
        pos = pos + (entry & 15)
        if symbol.max() < 256:
            literal = None
            pixel = symbol.astype(np.uint32)
        else:
            literal = np.flatnonzero(symbol < 256)
            pixel = symbol[literal].astype(np.uint32)
        pixel = pixel << np.uint32(8)
        rows = lane if literal is None else lane[literal]
        if rest is not None:
            pixel |= rest[rows]
        else:
            p = pos if literal is None else pos[literal]
            for code, shift in ((1, 16), (2, 0), (3, 24)):
                entry = entry_of(code, rows, p)
                pixel |= (entry >> 4).astype(np.uint32) << np.uint32(shift)
                p = p + (entry & 15)
            if literal is None:
                pos = p
            else:
                pos[literal] = p
        if literal is None:
            out[lane, at] = pixel
            if cache is not None:
                cache[lane, slot(pixel, lane)] = pixel
            at = at + 1
        else:
            out[rows, at[literal]] = pixel
            if cache is not None:
                cache[rows, slot(pixel, rows)] = pixel
                held = np.flatnonzero(symbol >= 280)
                if held.size:
                    pixel = cache[lane[held], symbol[held] - 280]
                    out[lane[held], at[held]] = pixel
                    at[held] += 1
            at[literal] += 1
            copies = np.flatnonzero((symbol >= 256) & (symbol < 280))
            if copies.size:
                length, p = number(symbol[copies] - 256, pos[copies])
                entry = entry_of(4, lane[copies], p)
                code, pos[copies] = number(entry >> 4, p + (entry & 15))
                for k, size, d in zip(copies.tolist(), length.tolist(), code.tolist()):
                    row, here = out[lane[k]], int(at[k])
                    if d > 120:
                        d -= 120
                    else:
                        x, y = PLANE[d - 1]
                        d = max(1, x + y * int(widths[lane[k]]))
                    if d > here:
                        raise ValueError("a back-reference before the first pixel")
                    size = min(size, int(counts[lane[k]]) - here)
                    # a copy that overlaps itself repeats its first d pixels
                    row[here : here + size] = np.resize(row[here - d : here], size) if d < size else row[here - d : here - d + size]
                    if cache is not None:
                        fresh = row[here : here + size]
                        cache[lane[k], slot(fresh, lane[k])] = fresh
                    at[k] = here + size
        alive = at < counts[lane]
        if not alive.all():
            lane, pos, at, base, low = lane[alive], pos[alive], at[alive], base[alive], low[alive]
    return [out[k, : counts[k]] for k in range(lanes)]


def decode_all(files: list[bytes]) -> list[list[np.ndarray]]:
    """The images of each of ``files`` (one file or more, laid end to end), as ``decode`` gives them."""
    out: list[list] = [[] for _ in files]
    runs: dict[tuple[bool, bool], list] = {}
    heads: dict[tuple[int, int], _Head] = {}
    store, filled = [], 0
    whole, base = b"".join([*files, b"\0" * 16]), 0
    for k, data in enumerate(files):
        at = 0
        while at < len(data):
            first, last, after, index = _body(data, at)
            head = _Head(data[first:last])
            n = head.width * head.h
            starts, counts = _parts(data[slice(*index)], n) if index else ([0], [n])
            groups = [head.group(place, count) for place, count in zip(np.cumsum([0, *counts]).tolist(), counts)]
            if None in groups:
                # the codes change inside a part
                out[k].append(_file(data, at)[0])
            else:
                known = []
                for codes in head.codes:
                    places = np.cumsum([filled, *map(len, codes)]).tolist()
                    store += codes
                    filled = places.pop()
                    red, blue, alpha = (int(c[0]) >> 4 for c in codes[1:4])
                    known.append((*places, *(len(c) - 1 for c in codes), alpha << 24 | red << 16 | blue, head.cache_bits))
                plain = all(len(c) == 1 for codes in head.codes for c in codes[1:4])
                begin = (base + first) * 8 + head.bits
                runs.setdefault((plain, head.cache_bits > 0), []).extend(
                    (k, len(out[k]), *known[g], begin + bit, head.width, count) for g, bit, count in zip(groups, starts, counts))
                heads[k, len(out[k])] = head
                out[k].append([])
            at = after
        base += len(data)
    raw = np.ndarray((len(whole) - 7,), "<u8", whole, strides=(1,))
    tables = np.concatenate(store).astype(np.int32) if store else None
    for (plain, _), rows in runs.items():
        v = np.array(rows, np.int64)
        rest = v[:, 12].astype(np.uint32) if plain else None
        for (k, j), pixels in zip(v[:, :2].tolist(), _in_step(raw, tables, v[:, 2:12], rest, v[:, 13], v[:, 14], v[:, 15], v[:, 16])):
            out[k][j].append(pixels)
    for (k, j), head in heads.items():
        out[k][j] = _inverted(np.concatenate(out[k][j]).reshape(head.h, head.width), head.todo)
    return out


# ---------------------------------------------------------------- writing


class Writer:
    def __init__(self):
        self.value, self.size, self.done = 0, 0, bytearray()

    def put(self, value: int, n: int) -> None:
        self.value |= value << self.size
        self.size += n

    def bytes(self) -> bytes:
        return self.value.to_bytes(-(-self.size // 8), "little")


def _put_lengths(out: Writer, lengths: list[int]) -> None:
    used = [s for s, n in enumerate(lengths) if n]
    if len(used) <= 2 and all(s < 256 for s in used) and all(lengths[s] == 1 for s in used):
        out.put(1, 1)
        out.put(len(used) - 1, 1)
        out.put(1, 1)
        for s in used:
            out.put(s, 8)
        return
    # runs of zeros (17, 18) and of the last other length (16) are one symbol each, with a prefix code of their own
    symbols, last, before, again = [], 8, -1, 0
    for at in (*used, len(lengths) * 2):
        zeros, n = at - before - 1, lengths[at] if at < len(lengths) else -1
        if not zeros and n == last:
            again += 1
        else:
            while again >= 3:
                symbols.append((16, min(again, 6) - 3, 2))
                again -= min(again, 6)
            symbols += [(last, 0, 0)] * again
            if n < 0:
                break
            while zeros >= 3:
                s, low, high, bits = (18, 11, 138, 7) if zeros >= 11 else (17, 3, 10, 3)
                symbols.append((s, min(zeros, high) - low, bits))
                zeros -= min(zeros, high)
            symbols += [(0, 0, 0)] * zeros
            again = int(n == last)
            if n != last:
                symbols.append((n, 0, 0))
                last = n
        before = at
    if len(symbols) < 2:
        symbols.append((0, 0, 0))
    first = huffman(Counter(s for s, _, _ in symbols), 19, 7)
    codes = canonical(first)
    stored = max(4, max(k for k, s in enumerate(LENGTH_ORDER) if first[s]) + 1)
    out.put(0, 1)
    out.put(stored - 4, 4)
    for s in LENGTH_ORDER[:stored]:
        out.put(first[s], 3)
    half = max(0, ((len(symbols) - 2).bit_length() - 1) // 2)
    out.put(1, 1)
    out.put(half, 3)
    out.put(len(symbols) - 2, 2 + 2 * half)
    value, size = 0, 0
    for s, more, bits in symbols:
        code, n = codes[s]
        value |= (code | more << n) << size
        size += n + bits
    out.put(value, size)


def _prefix(value: int) -> tuple[int, int, int]:
    """(code, extra bits, their value) of a length or distance."""
    value -= 1
    if value < 4:
        return value, 0, 0
    high = value.bit_length() - 1
    second = value >> (high - 1) & 1
    return 2 * high + second, high - 1, value & ((1 << (high - 1)) - 1)


def _put_pixels(out: Writer, image: np.ndarray, main: bool, cache_bits: int = 0, runs: bool = False, group_block: int = 0) -> None:
    h, w = image.shape
    flat = image.reshape(-1).tolist()
    out.put(1 if cache_bits else 0, 1)
    if cache_bits:
        out.put(cache_bits, 4)
    groups_of, gw = None, 0
    if main:
        out.put(1 if group_block else 0, 1)
        if group_block:
            out.put(group_block - 2, 3)
            gw, gh = -(-w // (1 << group_block)), -(-h // (1 << group_block))
            groups_of = [(x + y) % 2 for y in range(gh) for x in range(gw)]
            _put_pixels(out, (np.array(groups_of, dtype=np.uint32) << np.uint32(8)).reshape(gh, gw), False)
    tokens, cache, at, seen = [], [None] * (1 << cache_bits), 0, {}
    slot = lambda p: (0x1E35A7BD * p & 0xFFFFFFFF) >> (32 - cache_bits)
    while at < len(flat):
        p = flat[at]
        group = groups_of[(at // w >> group_block) * gw + (at % w >> group_block)] if groups_of else 0
        best, start = 0, seen.get(tuple(flat[at : at + 3])) if runs else None
        if start is not None:
            while at + best < len(flat) and best < 4096 and flat[start + best] == flat[at + best]:
                best += 1
        if best >= 3:
            d = at - start
            code = next((k + 1 for k, (x, y) in enumerate(PLANE) if max(1, x + y * w) == d), d + 120)
            tokens.append((group, "copy", best, code))
        elif cache_bits and cache[slot(p)] == p:
            tokens.append((group, "cache", slot(p), 0))
            best = 1
        else:
            tokens.append((group, "literal", p, 0))
            best = 1
        for k in range(at, at + best):
            if cache_bits:
                cache[slot(flat[k])] = flat[k]
            if runs:
                seen[tuple(flat[k : k + 3])] = k
        at += best
    sizes = (280 + ((1 << cache_bits) if cache_bits else 0), 256, 256, 256, 40)
    counts = [[{} for _ in sizes] for _ in range(2 if groups_of else 1)]
    bump = lambda c, s: c.__setitem__(s, c.get(s, 0) + 1)
    for group, kind, value, code in tokens:
        c = counts[group]
        if kind == "literal":
            for k, shift in enumerate((8, 16, 0, 24)):
                bump(c[k], value >> shift & 255)
        elif kind == "cache":
            bump(c[0], 280 + value)
        else:
            bump(c[0], 256 + _prefix(value)[0])
            bump(c[4], _prefix(code)[0])
    codes = []
    for c in counts:
        codes.append([])
        for k, size in enumerate(sizes):
            lengths = huffman(c[k], size)
            _put_lengths(out, lengths)
            codes[-1].append(canonical(lengths))
    for group, kind, value, code in tokens:
        c = codes[group]
        if kind == "literal":
            for k, shift in enumerate((8, 16, 0, 24)):
                out.put(*c[k][value >> shift & 255])
        elif kind == "cache":
            out.put(*c[0][280 + value])
        else:
            for k, v, base in ((0, value, 256), (4, code, 0)):
                prefix, extra, rest = _prefix(v)
                out.put(*c[k][base + prefix])
                out.put(rest, extra)


def _chunk(kind: bytes, body: bytes) -> bytes:
    return kind + struct.pack("<I", len(body)) + body + b"\0" * (len(body) % 2)


def _wrap(body: bytes, shape: tuple[int, int] | None = None, index: bytes = b"") -> bytes:
    """A file of one lossless stream; with an index of its parts it is an extended file, which may hold further chunks."""
    chunks = _chunk(b"VP8L", body)
    if index:
        w, h = shape
        chunks = _chunk(b"VP8X", b"\0\0\0\0" + (w - 1).to_bytes(3, "little") + (h - 1).to_bytes(3, "little")) + chunks + _chunk(INDEX, index)
    return b"RIFF" + struct.pack("<I", 4 + len(chunks)) + b"WEBP" + chunks


def encode_argb(image: np.ndarray, predictor: int | None = None, cross: tuple[int, int, int] | None = None, green: bool = False, palette: bool = False,
                cache_bits: int = 0, runs: bool = False, group_block: int = 0, block: int = 2) -> bytes:
    """One file of an image of ARGB values (height by width, uint32), written with the named features."""
    h, w = image.shape
    if not (0 < w <= MAX_SIDE and 0 < h <= MAX_SIDE):
        raise ValueError("an image has 1 to 16384 pixels on a side")
    out = Writer()
    for value, n in ((0x2F, 8), (w - 1, 14), (h - 1, 14), (1, 1), (0, 3)):
        out.put(value, n)
    if palette:
        colours, index = np.unique(image, return_inverse=True)
        if colours.size > 256:
            raise ValueError("a palette has at most 256 colours")
        out.put(1, 1)
        out.put(PALETTE, 2)
        out.put(colours.size - 1, 8)
        c = _split(colours.astype(np.uint32))
        _put_pixels(out, _join(np.diff(c, axis=0, prepend=np.zeros((1, 4), np.uint8))).reshape(1, -1), False)
        k, index = _bundle(colours.size), index.reshape(h, w).astype(np.uint32)
        if k:
            index = np.pad(index, ((0, 0), (0, -w % (1 << k))))
            index = sum(index[:, i :: 1 << k] << np.uint32((8 >> k) * i) for i in range(1 << k))
        image = index << np.uint32(8) | np.uint32(0xFF000000)
    th, tw = (-(-n // (1 << block)) for n in image.shape)
    if green:
        out.put(1, 1)
        out.put(GREEN, 2)
        image = _green(image, False)
    if predictor is not None:
        out.put(1, 1)
        out.put(PREDICTOR, 2)
        out.put(block - 2, 3)
        modes = np.full((th, tw), predictor << 8, dtype=np.uint32)
        _put_pixels(out, modes, False)
        image = _predicted(image, modes, block, False)
    if cross is not None:
        out.put(1, 1)
        out.put(CROSS, 2)
        out.put(block - 2, 3)
        factors = np.full((th, tw), (cross[2] & 255) << 16 | (cross[1] & 255) << 8 | (cross[0] & 255) | 255 << 24, dtype=np.uint32)
        _put_pixels(out, factors, False)
        image = _crossed(image, factors, block, False)
    out.put(0, 1)
    _put_pixels(out, image, True, cache_bits, runs, group_block)
    return _wrap(out.bytes())


def shape_of(n: int) -> tuple[int, int]:
    """Width and height of an image that holds n samples: 64 wide, and wider only where the height would not do."""
    w = 64 * -(-n // (64 * MAX_SIDE))
    return w, -(-n // w)


def repeats(joined: bytes, bounds: list[int]) -> list[tuple[int, int, int]]:
    """(place, length, distance) of copies inside the parts of ``joined`` that ``bounds`` cut, none over another.

    Places are tried whose hash of the next bytes has low bits of zero, which are the same places wherever a passage
    stands; each looks at the last place in its part of the same hash, and a match is followed to both sides.
    """
    code = np.frombuffer(joined, np.uint8).astype(np.uint64)
    if code.size < SEED:
        return []
    a, a2, a4 = (np.uint64(pow(0x9E3779B97F4A7C15, k, 1 << 64)) for k in (1, 2, 4))
    two = code[:-1] * a + code[1:]
    four = two[:-2] * a2 + two[2:]
    eight = four[:-4] * a4 + four[4:]
    seed = eight[: code.size - SEED + 1] * a4 + four[8 : 8 + code.size - SEED + 1]
    seed ^= seed >> np.uint64(29)
    places = np.flatnonzero(seed & np.uint64(SPARSE - 1) == 0)
    part = np.searchsorted(np.array(bounds), places, "right")
    key = seed[places] * a + part.astype(np.uint64)
    order = np.argsort(key, kind="stable")
    same = np.flatnonzero(key[order][1:] == key[order][:-1])
    pairs = np.stack([places[order[same + 1]], places[order[same]], part[order[same + 1]]], axis=1)
    out, done = [], 0
    for at, before, p in pairs[np.argsort(pairs[:, 0])].tolist():
        low, high = max(done, bounds[p - 1]), bounds[p] if p < len(bounds) else len(joined)
        if at < done or at + SEED > high or joined[at : at + SEED] != joined[before : before + SEED]:
            continue
        size, step = SEED, 64
        while at + size < high and step:
            take = min(step, high - at - size)
            if joined[at + size : at + size + take] == joined[before + size : before + size + take]:
                size, step = size + take, step * 2
            else:
                step = take // 2
        back = 0
        while at - back > low and before - back > bounds[p - 1] and joined[at - back - 1] == joined[before - back - 1]:
            back += 1
        if size + back >= SHORTEST_COPY:
            out.append((at - back, size + back, at - before))
            done = at + size
    return out


def _price(counts: np.ndarray) -> np.ndarray:
    """Bits, about, of symbols with these counts (along the last axis), and some six for each symbol in the head."""
    n = counts.sum(axis=-1)
    return n * np.log2(np.maximum(n, 1)) - (counts * np.log2(np.maximum(counts, 1))).sum(axis=-1) + 6 * (counts > 0).sum(axis=-1)


def _residuals(rows: np.ndarray, first: np.ndarray):
    """What each predictor mode leaves of one channel's rows, mode by mode; ``first`` marks the first row of each image."""
    top = np.roll(rows, 1, axis=0)
    left, topleft = np.roll(rows, 1, axis=1), np.roll(top, 1, axis=1)
    topright = np.concatenate([top[:, 1:], rows[:, :1]], axis=1)
    near = [x[..., None] for x in (left, top, topleft, topright)]
    edge = rows[first] - left[first]
    edge[:, 0] = rows[first, 0]
    for mode in range(14):
        rest = rows - _predict(mode, *near)[..., 0]
        rest[:, 0] = rows[:, 0] - top[:, 0]
        rest[first] = edge
        yield rest


def _foretold(sample: np.ndarray, begin: np.ndarray, shapes: list[tuple[int, int]]) -> tuple[np.ndarray, dict[int, list[int]]]:
    """The samples of all images, those foretold where that is cheaper, and the modes of such images' tiles."""
    modes: dict[int, list[int]] = {}
    out = sample
    for w in sorted({w for w, _ in shapes}):
        picked = [k for k, shape in enumerate(shapes) if shape[0] == w]
        rows = np.concatenate([sample[begin[k] : begin[k + 1]] for k in picked]).reshape(-1, w)
        heights = np.array([shapes[k][1] for k in picked])
        row0 = np.cumsum(heights) - heights
        tiles = -(-heights // (1 << TILE))
        tile0 = np.cumsum(tiles) - tiles
        within = np.arange(len(rows)) - np.repeat(row0, heights)
        tile = ((np.repeat(tile0, heights) + (within >> TILE)) << 8)[:, None]
        first, n = within == 0, int(tiles.sum())

        def counted(values: np.ndarray) -> np.ndarray:
            return np.bincount((tile | values).ravel(), minlength=n << 8).reshape(n, 256)

        best, mode = np.full(n, np.inf), np.zeros(n, np.int64)
        for m, rest in enumerate(_residuals(rows, first)):
            price = _price(counted(rest))
            better = price < best
            best[better], mode[better] = price[better], m
        plain = np.add.reduceat(_price(counted(rows)), tile0)
        told = np.add.reduceat(best, tile0) + 70 + 4 * tiles
        for i in np.flatnonzero(told < plain).tolist():
            k, (a, b) = picked[i], (int(row0[i]), int(row0[i] + heights[i]))
            modes[k] = mode[tile0[i] : tile0[i] + tiles[i]].tolist()
            of_row = np.repeat(modes[k], 1 << TILE)[: b - a]
            if out is sample:
                out = sample.copy()
            image = out[begin[k] : begin[k + 1]].reshape(-1, w)
            for m, rest in enumerate(_residuals(rows[a:b], first[a:b])):
                image[of_row == m] = rest[of_row == m]
    return out, modes


def _prefixes(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``_prefix`` of many values."""
    v = values - 1
    high = np.frexp(np.maximum(v, 1).astype(np.float64))[1].astype(np.int64) - 1
    extra = np.maximum(high - 1, 0)
    small = v < 4
    return np.where(small, v, 2 * high + (v >> extra & 1)), np.where(small, 0, extra), np.where(small, 0, v & ((1 << extra) - 1))


@lru_cache(64)
def _near(w: int) -> np.ndarray:
    """The code of each distance in the plane-distance map of an image of this width; 0 for those outside of it."""
    out = np.zeros(7 * w + 9, np.int64)
    for k, (x, y) in reversed(list(enumerate(PLANE, 1))):
        out[max(1, x + y * w)] = k
    return out


def _hits(colour: np.ndarray, key: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Each sample's slot in a colour cache, and whether the last sample of its part in that slot has the same value (the same key)."""
    green = np.arange(256, dtype=np.uint64) << np.uint64(8)
    slots = (np.concatenate([green | np.uint64(0xFF000000), green]) * np.uint64(0x1E35A7BD) & np.uint64(0xFFFFFFFF)) >> np.uint64(32 - bits)
    slot = slots.astype(np.uint8)[colour]
    order = np.argsort(slot, kind="stable")
    sorted_key = key[order]
    same, hit = np.zeros(key.size, bool), np.empty(key.size, bool)
    np.equal(sorted_key[1:], sorted_key[:-1], out=same[1:])
    hit[order] = same
    return slot, hit


def _grouped(tiles: np.ndarray, split: int) -> list[int]:
    """The entropy group of each tile by the tiles' counts: of the group that it costs least to join, or of its own if that is cheaper."""

    def price(counts: np.ndarray) -> np.ndarray:
        return _price(counts[..., :split]) + _price(counts[..., split:]) + 50

    sums, of = tiles[:1].copy(), [0]
    costs = price(sums)
    for t in tiles[1:]:
        joined = price(sums + t)
        k, alone = int(np.argmin(joined - costs)), float(price(t))
        if joined[k] - costs[k] <= alone or len(sums) == GROUPS:
            sums[k] += t
            costs[k] = joined[k]
        else:
            k = len(sums)
            sums, costs = np.concatenate([sums, t[None]]), np.r_[costs, alone]
        of.append(k)
    apart = costs.sum() + 70 + len(tiles) * np.log2(len(sums))
    return of if len(sums) > 1 and apart < price(tiles.sum(axis=0)) else [0] * len(tiles)


def _grey_files(pieces: list[bytes], shapes: list[tuple[int, int]]) -> list[bytes]:
    """One file for each piece, whose bytes are the samples of a grey image of the given shape.

    All parts of a call are coded at once: two tokens make a word of up to 56 bits, and the words are or-ed into the
    64-bit cells that they touch.  No image's bytes depend on another's.
    """
    joined = b"".join(pieces)
    sizes = np.array([len(p) for p in pieces])
    begin = np.r_[0, np.cumsum(sizes)]
    many = -(-sizes // PART)
    of = np.r_[0, np.cumsum(many)]  # the first part of each image
    image_of = np.repeat(np.arange(len(pieces)), many)
    bounds = begin[image_of] + (np.arange(of[-1]) - of[image_of]) * PART
    lengths = np.diff(np.r_[bounds, len(joined)])
    sample, modes = _foretold(np.frombuffer(joined, np.uint8), begin, shapes)
    if modes:
        joined = sample.tobytes()

    # back-references, two tokens each: a length and a distance
    place, size, distance = np.array(repeats(joined, bounds.tolist()), np.int64).reshape(-1, 3).T
    covered = np.zeros(len(joined), bool)
    for a, n in zip(place.tolist(), size.tolist()):
        covered[a : a + n] = True
    copy_part = np.searchsorted(bounds, place, "right") - 1
    far = distance + 120
    copy_width = np.array([w for w, _ in shapes])[image_of[copy_part]]
    for w in np.unique(copy_width).tolist():
        near = _near(w)
        here = np.flatnonzero((copy_width == w) & (distance < near.size))
        code = near[distance[here]]
        far[here[code > 0]] = code[code > 0]
    long, far = _prefixes(size), _prefixes(far)

    # the colour cache that makes the literals and lengths of an image's parts cheapest
    literal = np.flatnonzero(~covered)
    part = np.repeat(np.arange(of[-1], dtype=np.int32), lengths)
    key = part << 8 | sample
    colour = sample + np.repeat(np.isin(np.arange(len(pieces)), list(modes)) * np.uint16(256), sizes) if modes else sample
    value, home = sample[literal].astype(np.int32), part[literal]
    copies = np.bincount(copy_part * 24 + long[0], minlength=of[-1] * 24).reshape(-1, 24)

    def price(symbol: np.ndarray, alphabet: int) -> np.ndarray:
        counts = np.bincount(home * alphabet + symbol, minlength=of[-1] * alphabet).reshape(-1, alphabet)
        counts[:, 256:280] = copies
        return np.add.reduceat(_price(counts), of[:-1])

    symbol, best, cache = value.copy(), price(value, 280), np.zeros(len(pieces), np.int64)
    for bits in CACHES:
        slot, hit = _hits(colour, key, bits)
        other = np.where(hit, slot + np.int32(280), sample)[literal]
        cost = price(other, 280 + (1 << bits)) + 4
        better = cost < best
        if better.any():
            best[better], cache[better] = cost[better], bits
            changed = better[image_of[home]]
            symbol[changed] = other[changed]

    # entropy groups of tiles, and prefix codes of each group's counts
    split = 280 + (1 << CACHES[-1])
    green = np.bincount(home * split + symbol, minlength=of[-1] * split).reshape(-1, split)
    green[:, 256:280] = copies
    counts = np.concatenate([green, np.bincount(copy_part * 40 + far[0], minlength=of[-1] * 40).reshape(-1, 40)], axis=1)
    group, heads, made = np.zeros(of[-1], np.int64), [], 0
    codes, widths = np.zeros(counts.shape, np.uint64), np.zeros(counts.shape, np.int64)
    for i, (w, h) in enumerate(shapes):
        a, b = int(of[i]), int(of[i + 1])
        tiles, groups, group[a:b] = counts[a:b], [0], made
        if b - a > 1:
            tile = np.arange(b - a) * PART // (w << TILE)
            tiles = np.add.reduceat(tiles, np.flatnonzero(np.r_[True, tile[1:] != tile[:-1]]))
            groups = _grouped(tiles, split)
            group[a:b] += np.array(groups)[tile]
        out, kinds = Writer(), max(groups) + 1
        out.put(0x2F | (w - 1) << 8 | (h - 1) << 22 | 1 << 40 | GREEN << 41, 43)
        if i in modes:
            for v, n in ((1, 1), (PREDICTOR, 2), (TILE - 2, 3)):
                out.put(v, n)
            _put_pixels(out, np.repeat(np.array(modes[i], np.uint32)[:, None] << np.uint32(8), w >> TILE, axis=1), False)
        out.put(0, 1)
        out.put(int(cache[i] > 0), 1)
        if cache[i]:
            out.put(int(cache[i]), 4)
        out.put(int(kinds > 1), 1)
        if kinds > 1:
            out.put(TILE - 2, 3)
            _put_pixels(out, np.repeat(np.array(groups, np.uint32)[:, None] << np.uint32(8), w >> TILE, axis=1), False)
        for g in range(kinds):
            row = tiles[np.array(groups) == g].sum(axis=0) if b - a > 1 else tiles[0]
            for low, high, alphabet in ((0, split, 280 + ((1 << int(cache[i])) if cache[i] else 0)), (split, split + 40, 40)):
                used = np.flatnonzero(row[low:high])
                listed = used.tolist()
                own = huffman(dict(zip(listed, row[low + used].tolist())), alphabet)
                _put_lengths(out, own)
                if not low:
                    # red, blue and alpha: codes of one symbol each
                    out.put(5 | 5 << 11 | 5 << 22 | (0 if i in modes else 255) << 25, 33)
                if used.size > 1:
                    n = np.array([own[s] for s in listed])
                    turn = np.argsort(n, kind="stable")
                    n = n[turn]
                    at = np.cumsum(1 << (15 - n)) - (1 << (15 - n))
                    codes[made, low + used[turn]], widths[made, low + used[turn]] = _reversed(15)[at], n
            made += 1
        heads.append(out)
    codes, widths = codes.reshape(-1), widths.reshape(-1)

    # tokens in the order of their places; a part has an even number of them
    row = group[home] * (split + 40) + symbol
    code, length = codes[row], widths[row]
    if place.size:
        pairs = np.searchsorted(literal, place) + 2 * np.arange(place.size)
        single = np.ones(literal.size + 2 * place.size, bool)
        single[pairs] = single[pairs + 1] = False
        all_code, all_length = np.empty(single.size, np.uint64), np.empty(single.size, np.int64)
        all_code[single], all_length[single] = code, length
        for at, base, (prefix, bits, rest) in ((pairs, 256, long), (pairs + 1, split, far)):
            row = group[copy_part] * (split + 40) + base + prefix
            all_code[at], all_length[at] = codes[row] | rest.astype(np.uint64) << widths[row].astype(np.uint64), widths[row] + bits
        code, length = all_code, all_length
    tokens = np.bincount(home, minlength=of[-1]) + 2 * np.bincount(copy_part, minlength=of[-1])
    odd = np.flatnonzero(tokens % 2)
    if odd.size:
        ends = np.cumsum(tokens)[odd]
        code, length = np.insert(code, ends, np.uint64(0)), np.insert(length, ends, 0)
        tokens[odd] += 1

    c, n = code[0::2] | code[1::2] << length[0::2].astype(np.uint64), length[0::2] + length[1::2]
    total = np.r_[0, np.cumsum(n)]
    part_ends = np.cumsum(tokens // 2)
    part_bits = total[np.r_[0, part_ends[:-1]]]
    ends = part_ends[of[1:] - 1]
    before = part_bits[of[:-1]]
    used = total[ends] - before
    cells = -(-(used + 63) // 64) + 1
    base = np.r_[0, np.cumsum(cells)[:-1]] * 64
    at = total[:-1] + np.repeat(base - before, np.diff(np.r_[0, ends]))
    cell, shift = at >> 6, (at & 63).astype(np.uint64)
    store = np.zeros(int(cells.sum()) + 1, np.uint64)
    edge = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
    store[cell[edge]] |= np.bitwise_or.reduceat(c << shift, edge)
    high = np.where(shift > 0, c >> (np.uint64(63) - shift) >> np.uint64(1), np.uint64(0))
    store[cell[edge] + 1] |= np.bitwise_or.reduceat(high, edge)
    raw, files = store.astype("<u8").tobytes(), []
    for i, out in enumerate(heads):
        start, bits = int(base[i]) // 8, int(used[i])
        body = int.from_bytes(raw[start : start + (bits + 7) // 8], "little")
        index = struct.pack("<I", PART) + (part_bits[of[i] : of[i + 1]] - before[i]).astype("<u8").tobytes() if many[i] > 1 else b""
        files.append(_wrap((out.value | body << out.size).to_bytes(-(-(out.size + bits) // 8), "little"), shapes[i], index))
    return files


def _palette_file(part: bytes) -> bytes:
    values = np.frombuffer(part, np.uint8).astype(np.uint32)
    w, h = shape_of(len(part))
    return encode_argb((values * np.uint32(0x010101) | np.uint32(0xFF000000)).reshape(h, w), palette=True, runs=True)


def encode_bytes(payloads: list[bytes]) -> list[bytes]:
    """Each payload (a multiple of 64 bytes) as the samples of one grey image file (of several only beyond ``LARGEST``)."""
    out: list[list[bytes]] = [[] for _ in payloads]
    pieces, places, shapes = [], [], []
    for k, p in enumerate(payloads):
        for at in range(0, len(p), LARGEST):
            piece = p[at : at + LARGEST]
            if len(piece) <= FEW_SAMPLES and len(set(piece[:256])) <= FEW and len(set(piece)) <= FEW:
                out[k].append(_palette_file(piece))
                continue
            w, h = shape_of(len(piece))
            pieces.append(piece + b"\0" * (w * h - len(piece)))
            places.append((k, len(out[k])))
            shapes.append((w, h))
            out[k].append(b"")
    at = 0
    while at < len(pieces):
        # so many at a time as the processor's cache holds
        end, held = at, 0
        while end < len(pieces) and held < AT_ONCE:
            held += len(pieces[end])
            end += 1
        for (k, j), data in zip(places[at:end], _grey_files(pieces[at:end], shapes[at:end])):
            out[k][j] = data
        at = end
    return [b"".join(x) for x in out]


def decode_bytes(files: list[bytes], sizes: list[int]) -> list[bytes]:
    """Of each of ``files`` the first samples of green, as many as ``sizes`` says."""
    out = []
    for images, n in zip(decode_all(files), sizes):
        samples = b"".join((image.reshape(-1) >> np.uint32(8)).astype(np.uint8).tobytes() for image in images)
        if len(samples) < n:
            raise ValueError("fewer samples than asked for")
        out.append(samples[:n])
    return out
