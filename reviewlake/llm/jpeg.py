"""Progressive JPEG: bytes kept as quantised coefficients, entropy-coded in scans, read back, and turned into RGB.

The unit of storage is the quantised DCT coefficient: payload byte b is the coefficient b - 128, 64 of them to a block in
zigzag order, six blocks (four luma, two chroma) to a unit of 16 x 16 pixels. All quantisers are 1, so entropy
decoding gives back every byte. Reading accumulates the scans (spectral selection and successive approximation) into
coefficient arrays; pixels come from an inverse transform in exact integer arithmetic, chroma doubled.

Both ways work on many pictures at once: the restart intervals of all of them are decoded side by side, one symbol of
each at a time, in numpy.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections import defaultdict
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import add_columns, new_path

UNIT = 576
BLOCKS = 6
INTERVAL = 8
#: (components, Ss, Se, Ah, Al) of each scan: first passes, then refinements of DC and of the low frequencies.
SCANS = [((0, 1, 2), 0, 0, 0, 1), *[((c,), 1, 5, 0, 1) for c in range(3)], *[((c,), 6, 63, 0, 0) for c in range(3)], ((0, 1, 2), 0, 0, 1, 0), *[((c,), 1, 5, 1, 0) for c in range(3)]]
ZIGZAG = np.array(sorted(range(64), key=lambda i: (i // 8 + i % 8, i // 8 if (i // 8 + i % 8) % 2 else i % 8)))
MARKER = re.compile(rb"\xff[^\x00\xd0-\xd7\xff]", re.S)
RESTART = re.compile(rb"\xff[\xd0-\xd7]")


# -- Huffman tables


def canonical(lengths: dict[int, int]) -> tuple[bytes, np.ndarray, np.ndarray]:
    """(DHT body, code of each symbol, length of each symbol) of the canonical code with these lengths."""
    order = sorted(lengths, key=lambda s: (lengths[s], s))
    codes, sizes, code, last = np.zeros(256, np.uint64), np.zeros(256, np.int64), 0, 0
    for s in order:
        code <<= lengths[s] - last
        last = lengths[s]
        codes[s], sizes[s] = code, last
        code += 1
    assert code < 1 << last  # the code of ones only stays unused
    return bytes(sum(v == n for v in lengths.values()) for n in range(1, 17)) + bytes(order), codes, sizes


DC_CODE = canonical({s: 4 for s in range(12)})
#: coefficients of no run are by far the commonest, in sizes that depend on the bytes; all else is eleven bits
AC_CODE = canonical({(r << 4) + s: {5: 2, 4: 3, 7: 3, 6: 4, 8: 4, 3: 5}.get(s, 7) if r == 0 and s else 5 if r == s == 0 else 11 for r in range(16) for s in range(11)})


@lru_cache(maxsize=64)
def lookup(body: bytes) -> np.ndarray:
    """symbol << 8 | length for each 16-bit beginning."""
    table, code, at = np.zeros(1 << 16, np.int64), 0, 16
    for n in range(1, 17):
        for s in body[at : at + body[n - 1]]:
            table[code << (16 - n) : (code + 1) << (16 - n)] = s << 8 | n
            code += 1
        at += body[n - 1]
        code <<= 1
    return table


# -- geometry


@lru_cache(maxsize=4096)
def grid(width: int, height: int, factors: tuple[tuple[int, int], ...]):
    """(units across, units down, rows of each component's blocks in its own order, rows of all blocks in unit order).

    Blocks are stored unit by unit, in each unit component by component.
    """
    hm, vm = max(h for h, _ in factors), max(v for _, v in factors)
    across, down = -(-width // (8 * hm)), -(-height // (8 * vm))
    per = sum(h * v for h, v in factors)
    own, start = [], 0
    for h, v in factors:
        r, c = np.mgrid[: -(-(-(-height * v // vm)) // 8), : -(-(-(-width * h // hm)) // 8)]
        own.append((((r // v) * across + c // h) * per + start + (r % v) * h + c % h).ravel())
        start += h * v
    return across, down, own, np.arange(across * down * per)


# -- writing


def magnitude(v: np.ndarray) -> np.ndarray:
    """Bits of |v|."""
    return np.frexp(np.abs(v).astype(np.float64))[1].astype(np.int64)


class Bits:
    """Tokens of one scan of all pictures: (segment, order in it, value, length), packed at the end."""

    def __init__(self):
        self.parts: list[tuple] = []

    def add(self, segment, order, value, length) -> None:
        self.parts.append((segment, order, value.astype(np.uint64), length))

    def pack(self, segments: int) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all segments, each filled up with ones, and where each begins."""
        segment, order, value, length = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        by = np.argsort(order, kind="stable")
        segment, value, length = segment[by], value[by], length[by]
        total = np.bincount(segment, length, segments).astype(np.int64)
        size = (total + 7) // 8
        start = np.concatenate([[0], np.cumsum(size)])
        ends = np.cumsum(length)
        before = np.concatenate([[0], np.cumsum(total)])[:-1]
        pos = ends - length - before[segment] + start[:-1][segment] * 8
        pad = size * 8 - total
        pos = np.concatenate([pos, start[:-1] * 8 + total])
        value = np.concatenate([value, (1 << pad).astype(np.uint64) - np.uint64(1)])
        length = np.concatenate([length, pad])
        words = np.zeros(start[-1] // 4 + 3, np.uint64)
        shifted = value << (64 - (pos & 31) - length).astype(np.uint64)
        shifted[length == 0] = 0
        np.add.at(words, pos >> 5, shifted >> np.uint64(32))
        np.add.at(words, (pos >> 5) + 1, shifted & np.uint64(0xFFFFFFFF))
        return words.astype(">u4").view(np.uint8)[: start[-1]], start


def encode_scan(coef: np.ndarray, rows: np.ndarray, block_of: np.ndarray, component: np.ndarray, segment: np.ndarray, n: int, scan) -> tuple[np.ndarray, np.ndarray]:
    """Pack one scan: rows of coef in scan order with each one's segment; n segments in all."""
    _, ss, se, ah, al = scan
    bits = Bits()
    if ss == 0 and not ah:
        dc = coef[rows, 0].astype(np.int64) >> al
        diff = dc.copy()
        for c in np.unique(component):
            at = np.nonzero(component == c)[0]
            same = segment[at[1:]] == segment[at[:-1]]
            diff[at[1:]] -= np.where(same, dc[at[:-1]], 0)
        size = magnitude(diff)
        value = np.where(diff < 0, diff - 1, diff) & ((1 << size) - 1)
        bits.add(segment, block_of, DC_CODE[1][size] << size.astype(np.uint64) | value.astype(np.uint64), DC_CODE[2][size] + size)
        return bits.pack(n)
    if ss == 0:
        bits.add(segment, block_of, (coef[rows, 0].astype(np.int64) >> al) & 1, np.ones(len(rows), np.int64))
        return bits.pack(n)
    band = coef[rows, ss : se + 1].astype(np.int64)
    size = np.abs(band) >> al
    width = se - ss + 1
    _, code, length = AC_CODE
    if not ah:
        b, k = np.nonzero(size)
        first = np.concatenate([[True], b[1:] != b[:-1]]) if len(b) else np.zeros(0, bool)
        run = k - np.where(first, -1, np.concatenate([[0], k[:-1]])) - 1 if len(b) else k
        v = size[b, k]
        s = magnitude(v)
        extra = np.where(band[b, k] < 0, ~v, v) & ((1 << s) - 1)
        symbol = (run % 16) << 4 | s
        bits.add(segment[b], b * 256 + 2 * k + 1, code[symbol] << s.astype(np.uint64) | extra.astype(np.uint64), length[symbol] + s)
        for z in range(1, (width - 1) // 16 + 1):
            far = run >= 16 * z
            bits.add(segment[b[far]], b[far] * 256 + 2 * k[far], np.full(far.sum(), code[0xF0]), np.full(far.sum(), length[0xF0]))
        last = np.full(len(rows), -1)
        last[b] = k  # the last of a block wins
        end = np.nonzero(last < width - 1)[0]
        bits.add(segment[end], end * 256 + 255, np.full(len(end), code[0]), np.full(len(end), length[0]))
        return bits.pack(n)
    assert width <= 16  # no run of sixteen zeros in a refinement
    run, held, count = (np.zeros(len(rows), np.int64) for _ in range(3))
    every = np.arange(len(rows))
    for k in range(width):
        a = size[:, k]
        old, new = a > 1, a == 1
        held, count = np.where(old, held << 1 | a & 1, held), count + old
        at = np.nonzero(new)[0]
        symbol = run[at] << 4 | 1
        value = (code[symbol].astype(np.int64) << 1 | (band[at, k] > 0)) << count[at] | held[at]
        bits.add(segment[at], at * 256 + k, value, length[symbol] + 1 + count[at])
        run = np.where(new, 0, run + (a == 0))
        held, count = np.where(new, 0, held), np.where(new, 0, count)
    end = every[(run > 0) | (count > 0)]
    bits.add(segment[end], end * 256 + 255, code[0].astype(np.int64) << count[end] | held[end], length[0] + count[end])
    return bits.pack(n)


def stuffed(data: np.ndarray, start: np.ndarray, last: np.ndarray, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """data with a zero after each 255 and a restart marker after each segment that isn't its picture's last; also where
    each segment then begins."""
    wide = 1 + (data == 255)
    n = np.zeros(len(start) - 1, np.int64)
    size = np.diff(start)
    sums = np.concatenate([[0], np.cumsum(wide)])
    n = sums[start[1:]] - sums[start[:-1]] + 2 * ~last
    new = np.concatenate([[0], np.cumsum(n)])
    out = np.zeros(new[-1], np.uint8)
    out[sums[:-1] - np.repeat(sums[start[:-1]] - new[:-1], size)] = data
    at = new[1:][~last]
    out[at - 2], out[at - 1] = 255, 0xD0 + index[~last] % 8
    return out, new


def piece(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 255, marker, len(body) + 2) + body


def encode(payloads: list[bytes]) -> list[bytes]:
    """A progressive JPEG for each payload, whose length is a positive multiple of 576."""
    factors = ((2, 2), (1, 1), (1, 1))
    shapes, rows = [], [0]
    for p in payloads:
        units = -(-len(p) // (64 * BLOCKS))
        across = min(4095, int(np.ceil(np.sqrt(units))))
        shapes.append((across, -(-units // across)))
        rows.append(rows[-1] + across * shapes[-1][1] * BLOCKS)
    coef = np.zeros((rows[-1], 64), np.int16)
    for p, at in zip(payloads, rows, strict=False):
        coef[at : at + len(p) // 64] = np.frombuffer(p, np.uint8).reshape(-1, 64).astype(np.int16) - 128
    out = []
    for p, (w, h) in zip(payloads, shapes, strict=True):
        head = b"\xff\xd8" + piece(0xFE, b"payload-bytes=%d" % len(p)) + piece(0xDB, b"\0" + b"\1" * 64)
        head += piece(0xC2, struct.pack(">BHHB", 8, 16 * h, 16 * w, 3) + b"".join(bytes((c, f[0] << 4 | f[1], 0)) for c, f in enumerate(factors)))
        head += piece(0xC4, b"\0" + DC_CODE[0]) + piece(0xC4, b"\x10" + AC_CODE[0]) + piece(0xDD, struct.pack(">H", INTERVAL))
        out.append([head])
    grids = [grid(16 * w, 16 * h, factors) for w, h in shapes]
    for scan in SCANS:
        parts = scan[0]
        per = BLOCKS if len(parts) == 3 else 1
        orders = [g[3] if per > 1 else g[2][parts[0]] for g in grids]
        segs = [-(-len(o) // (per * INTERVAL)) for o in orders]
        order = np.concatenate([o + at for o, at in zip(orders, rows, strict=False)])
        first = np.concatenate([[0], np.cumsum(segs)])
        segment = np.concatenate([np.arange(len(o)) // (per * INTERVAL) + f for o, f in zip(orders, first, strict=False)])
        component = np.array([0, 0, 0, 0, 1, 2])[order % BLOCKS] if per > 1 else np.zeros(len(order), int)
        data, start = encode_scan(coef, order, np.arange(len(order)), component, segment, int(first[-1]), scan)
        last = np.zeros(first[-1], bool)
        last[first[1:] - 1] = True
        index = np.arange(first[-1]) - np.repeat(first[:-1], segs)
        data, start = stuffed(data, start, last, index)
        sos = piece(0xDA, bytes((len(parts), *[x for c in parts for x in (c, 0)], scan[1], scan[2], scan[3] << 4 | scan[4])))
        raw = data.tobytes()
        for x, a, b in zip(out, start[first[:-1]], start[first[1:]], strict=True):
            x += [sos, raw[a:b]]
    return [b"".join([*x, b"\xff\xd9"]) for x in out]


# -- reading


class Picture:
    """Headers of one picture and the entropy-coded segments of its scans."""

    def __init__(self, data: bytes):
        self.comment = b""
        self.quant: dict[int, np.ndarray] = {}
        tables: dict[int, bytes] = {}
        self.scans: list[tuple] = []
        interval, at = 0, 2
        if data[:2] != b"\xff\xd8":
            raise ValueError("not a JPEG")
        while True:
            m = MARKER.search(data, at)
            if not m or data[m.start() + 1] == 0xD9:
                break
            kind, at = data[m.start() + 1], m.start() + 2
            size = struct.unpack_from(">H", data, at)[0]
            body, at = data[at + 2 : at + size], at + size
            if kind == 0xFE:
                self.comment = body
            elif kind == 0xDB:
                while body:
                    wide = body[0] >> 4
                    self.quant[body[0] & 15] = np.frombuffer(body, ">u2" if wide else "u1", 64, 1).astype(np.int64)
                    body = body[1 + 64 * (1 + wide) :]
            elif kind == 0xC2:
                _, self.height, self.width, n = struct.unpack_from(">BHHB", body)
                self.ids = [body[6 + 3 * c] for c in range(n)]
                self.factors = tuple((body[7 + 3 * c] >> 4, body[7 + 3 * c] & 15) for c in range(n))
                self.tables = [body[8 + 3 * c] for c in range(n)]
            elif kind == 0xC4:
                while body:
                    n = 17 + sum(body[1:17])
                    tables[body[0]] = body[1:n]
                    body = body[n:]
            elif kind == 0xDD:
                interval = struct.unpack(">H", body)[0]
            elif kind == 0xDA:
                n = body[0]
                parts = tuple(self.ids.index(body[1 + 2 * c]) for c in range(n))
                ss, se, a = body[1 + 2 * n : 4 + 2 * n]
                huffman = tuple(tables.get(body[2 + 2 * c] >> 4 if ss == 0 else 16 + (body[2 + 2 * c] & 15), b"") for c in range(n))
                end = m.start() if (m := MARKER.search(data, at)) else len(data)
                segments = [x.replace(b"\xff\0", b"\xff") for x in RESTART.split(data[at:end])]
                self.scans.append((parts, ss, se, a >> 4, a & 15, huffman, interval, segments))
                at = end
            elif 0xC0 <= kind <= 0xCF:
                raise ValueError("only progressive pictures are read here")


def decode(pictures: list[Picture]) -> tuple[np.ndarray, list[int]]:
    """Quantised coefficients (zigzag order) of all blocks of all pictures, and where each picture's begin."""
    grids = [grid(p.width, p.height, p.factors) for p in pictures]
    start = np.concatenate([[0], np.cumsum([len(g[3]) for g in grids])]).astype(np.int64)
    coef = np.zeros((start[-1] + 1, 64), np.int16)  # the last row takes what goes nowhere
    for turn in range(max((len(p.scans) for p in pictures), default=0)):
        alike = defaultdict(list)
        for k, p in enumerate(pictures):
            if turn < len(p.scans):
                s = p.scans[turn]
                per = tuple(p.factors[c] for c in s[0]) if len(s[0]) > 1 else ()
                alike[(*s[:6], per, len(p.factors))].append(k)
        for (parts, ss, se, ah, al, huffman, per, _), ks in alike.items():
            orders, component, lane_at, lane_n, segments, total = [], None, [], [], [], 0
            unit = sum(h * v for h, v in per) or 1
            for k in ks:
                p, g = pictures[k], grids[k]
                order = (g[3] if len(parts) == len(p.factors) > 1 else unit_order(p, g, parts) if per else g[2][parts[0]]) + start[k]
                n, here = p.scans[turn][6] * unit or len(order), p.scans[turn][7]
                orders.append(order)
                for i, x in enumerate(here):
                    if i * n < len(order):
                        lane_at.append(total + i * n)
                        lane_n.append(min(n, len(order) - i * n))
                        segments.append(x)
                total += len(order)
            order = np.concatenate([*orders, [start[-1]]])
            lanes = Lanes(segments, np.array(lane_at), np.array(lane_n))
            component = np.repeat(np.arange(len(parts)), [h * v for h, v in per]) if per else np.zeros(1, int)
            if ss == 0 and not ah:
                dc_first(coef, order, lanes, [lookup(h) for h in huffman], component, al)
            elif ss == 0:
                dc_refine(coef, order, lanes, al)
            elif not ah:
                ac_first(coef, order, lanes, lookup(huffman[0]), ss, se, al)
            else:
                ac_refine(coef, order, lanes, lookup(huffman[0]), ss, se, al)
    return coef[:-1], start.tolist()


def unit_order(p: Picture, g, parts) -> np.ndarray:
    """Rows in unit order of a scan that holds some components only."""
    sizes = [h * v for h, v in p.factors]
    keep = np.concatenate([np.full(n, c in parts) for c, n in enumerate(sizes)])
    return g[3].reshape(-1, sum(sizes))[:, keep].ravel()


class Lanes:
    """Segments read side by side: bit positions in one buffer, and each one's place and number of blocks."""

    def __init__(self, segments: list[bytes], at: np.ndarray, n: np.ndarray):
        raw = np.frombuffer(b"".join(x + b"\0" * 8 for x in segments) + b"\0" * 8, np.uint8).astype(np.uint64)
        m = len(raw) - 4
        self.words = raw[:m] << np.uint64(32)
        for k, shift in ((1, 24), (2, 16), (3, 8), (4, 0)):
            self.words |= raw[k : m + k] << np.uint64(shift)
        sizes = np.array([len(x) + 8 for x in segments], np.int64)
        self.pos = (np.cumsum(sizes) - sizes) * 8
        self.at, self.n = at.astype(np.int64), n.astype(np.int64)

    def peek(self, pos: np.ndarray) -> np.ndarray:
        """The next bits (33 at least), at the top of 64."""
        return self.words[pos >> 3] << (24 + (pos & 7)).astype(np.uint64)


def top(x: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The n topmost bits of x."""
    return (x >> np.uint64(1) >> (63 - n).astype(np.uint64)).astype(np.int64)


def extended(bits: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Signed value of n magnitude bits."""
    return np.where(bits < (1 << n) >> 1, bits - (1 << n) + 1, bits)


def dc_first(coef, order, lanes: Lanes, tables, component, al: int) -> None:
    pos, at, n = lanes.pos, lanes.at, lanes.n
    before = np.zeros((len(pos), len(tables)), np.int64)
    for k in range(int(n.max(initial=0))):
        if not (live := n > k).all():
            pos, at, n, before = pos[live], at[live], n[live], before[live]
        c = component[k % len(component)]
        x = lanes.peek(pos)
        e = tables[c][(x >> np.uint64(48)).astype(np.int64)]
        size, s = e & 255, e >> 8
        before[:, c] += extended(top(x << size.astype(np.uint64), s), s)
        coef[order[at + k], 0] = before[:, c] << al
        pos = pos + size + s


def dc_refine(coef, order, lanes: Lanes, al: int) -> None:
    for k in range(int(lanes.n.max(initial=0))):
        live = lanes.n > k
        bit = (lanes.peek(lanes.pos[live] + k) >> np.uint64(63)).astype(np.int16)
        coef[order[lanes.at[live] + k], 0] |= bit << al


def ac_first(coef, order, lanes: Lanes, table, ss: int, se: int, al: int) -> None:
    pos, at, left = lanes.pos, lanes.at, lanes.n
    k = np.full(len(pos), ss)
    flat = coef.reshape(-1)
    row = order[at] * 64
    while len(pos):
        x = lanes.peek(pos)
        e = table[(x >> np.uint64(48)).astype(np.int64)]
        size = e & 255
        r, s = e >> 12, (e >> 8) & 15
        zero = s == 0
        extra = np.where(zero, np.where(r < 15, r, 0), s)
        bits = top(x << size.astype(np.uint64), extra)
        pos = pos + size + extra
        k = k + r
        # what a lane without a coefficient would write goes to the spare row
        flat[np.where(zero | (k > se), len(flat) - 1, row + np.minimum(k, 63))] = extended(bits, s) << al
        k = k + 1
        ended = zero & (r < 15)
        if ended.any() or (k > se).any():
            done = ended | (k > se)
            step = np.where(ended, (1 << np.where(ended, r, 0)) + bits, 1)[done]
            at, left, k = at.copy(), left.copy(), np.where(done, ss, k)
            at[done] += step
            left[done] -= step
            if (over := left <= 0).any():
                live = ~over
                pos, at, left, k = pos[live], at[live], left[live], k[live]
            row = order[at] * 64
    flat[len(flat) - 64 :] = 0


def ac_refine(coef, order, lanes: Lanes, table, ss: int, se: int, al: int) -> None:
    pos, at, left = lanes.pos.copy(), lanes.at.copy(), lanes.n.copy()
    n = len(pos)
    k, run, new, ends = np.full(n, ss), np.full(n, -1), np.zeros(n, np.int64), np.zeros(n, np.int64)
    flat = coef.reshape(-1)
    while len(pos):
        # a symbol for lanes that have none and are in no run of ended blocks
        need = np.nonzero((run < 0) & (ends == 0))[0]
        if len(need):
            x = lanes.peek(pos[need])
            e = table[(x >> np.uint64(48)).astype(np.int64)]
            size, r, s = e & 255, e >> 12, (e >> 8) & 15
            over = (s == 0) & (r < 15)
            extra = np.where(over, r, (s > 0).astype(np.int64))
            bits = top(x << size.astype(np.uint64), extra)
            pos[need] += size + extra
            ends[need] = np.where(over, (1 << np.where(over, r, 0)) + bits, 0)
            run[need] = np.where(over, -1, r)
            new[need] = np.where(s > 0, np.where(bits > 0, 1, -1), 0) << al
        place = order[at] * 64 + k
        v = flat[place].astype(np.int64)
        old = v != 0
        bit = (lanes.peek(pos) >> np.uint64(63)).astype(np.int64)
        fix = old & (bit == 1) & ((np.abs(v) & (1 << al)) == 0)
        set_ = ~old & (run == 0)
        flat[place] = np.where(fix, v + np.sign(v) * (1 << al), np.where(set_, new, v))
        pos += old
        run = np.where(old, run, np.maximum(run - 1, -1))
        k = k + 1
        done = k > se
        if done.any():
            k[done] = ss
            at[done] += 1
            left[done] -= 1
            run[done] = -1
            ends[done] = np.maximum(ends[done] - 1, 0)
            live = left > 0
            if not live.all():
                pos, at, left, k, run, new, ends = (a[live] for a in (pos, at, left, k, run, new, ends))


# -- pixels

#: The transform's cosines in 13 bits, as whole numbers in doubles: every sum below 2^53 is exact in any order.
COS = np.round(np.array([[(np.sqrt(0.125) if u == 0 else 0.5) * np.cos((2 * x + 1) * u * np.pi / 16) for x in range(8)] for u in range(8)]) * 8192)


def pixels(p: Picture, coef: np.ndarray) -> np.ndarray:
    """RGB of one picture, full size, from its coefficients."""
    across, down, _, _ = grid(p.width, p.height, p.factors)
    hm, vm = max(h for h, _ in p.factors), max(v for _, v in p.factors)
    units = coef.reshape(across * down, -1, 64)
    planes, first = [], 0
    for (h, v), q in zip(p.factors, p.tables, strict=True):
        z = units[:, first : first + h * v].reshape(-1, 64) * p.quant[q]
        first += h * v
        natural = np.zeros(z.shape)
        natural[:, ZIGZAG] = z
        s = (natural.reshape(-1, 8) @ COS).reshape(-1, 8, 8).transpose(0, 2, 1).reshape(-1, 8) @ COS  # by x, then y
        s = np.clip(np.floor((s + (1 << 25)) / (1 << 26)) + 128, 0, 255).astype(np.int32)
        plane = s.reshape(down, across, v, h, 8, 8).transpose(0, 2, 5, 1, 3, 4).reshape(down * v * 8, across * h * 8)
        planes.append(plane.repeat(vm // v, axis=0).repeat(hm // h, axis=1)[: p.height, : p.width])
    if len(planes) < 3:
        return np.stack([planes[0]] * 3, axis=2).astype(np.uint8)
    y, cb, cr = planes[0] << 16, planes[1] - 128, planes[2] - 128
    half = 1 << 15
    rgb = np.stack([y + 91881 * cr, y - 22554 * cb - 46802 * cr, y + 116130 * cb], axis=2)
    return np.clip((rgb + half) >> 16, 0, 255).astype(np.uint8)


def payload_of(p: Picture, coef: np.ndarray) -> bytes:
    """The stored bytes, as many as the comment says."""
    n = int(p.comment.partition(b"=")[2])
    return (coef[: n // 64].astype(np.int64) + 128).astype(np.uint8).tobytes()


def feature(rgb: np.ndarray) -> str:
    """Size, channel sums and a histogram of eight green levels."""
    sums = rgb.reshape(-1, 3).sum(axis=0, dtype=np.int64)
    levels = np.bincount(rgb[:, :, 1].ravel() >> 5, minlength=8)
    return f"{rgb.shape[1]}x{rgb.shape[0]}:{':'.join(map(str, sums))}:{'.'.join(map(str, levels))}"


# -- columns


def batches(values: list, limit: int = 2 << 20):
    """Slices of values of about `limit` bytes; a longer value goes alone."""
    start = size = 0
    for k, v in enumerate(values):
        if k > start and size + len(v or b"") > limit:
            yield start, k
            start, size = k, 0
        size += len(v or b"")
    if start < len(values):
        yield start, len(values)


def padded(text: bytes | None) -> bytes:
    """text, then bytes 255 up to a positive multiple of 576."""
    text = text or b""
    return text + b"\xff" * (-len(text) % UNIT if text else UNIT)


def store(docs: DataFrame, text: str = "text", out: str = "media") -> DataFrame:
    """docs with the binary column `out`: each text in UTF-8 as a progressive JPEG. Null is read as empty."""

    def make():
        def work(texts):
            media: list[bytes] = []
            for a, b in batches(texts, 1 << 20):
                media += encode([padded(t) for t in texts[a:b]])
            return [media]

        return work

    return add_columns(docs, text, [(out, T.BinaryType())], make)


def load(rows: DataFrame, media: str = "media", payload: bool = False, tensor: bool = False) -> DataFrame:
    """rows with what is read from `media`: payload_bytes, payload_sha256, tail_crc32 (of the last 32 bytes),
    media_bytes, media_sha256 and feature; also payload, and tensor (height x width x 3 bytes of RGB) with its shape,
    where asked for. The pictures may be any progressive ones; payload columns are null without a payload comment. A
    null picture gives nulls."""
    fields = [("payload_bytes", T.LongType()), ("payload_sha256", T.StringType()), ("tail_crc32", T.LongType()), ("media_bytes", T.LongType()), ("media_sha256", T.StringType()), ("feature", T.StringType())]
    fields += [("payload", T.BinaryType())] * payload + [("tensor", T.BinaryType()), ("shape", T.ArrayType(T.IntegerType()))] * tensor

    def one(raw: bytes, p: Picture, coef: np.ndarray) -> list:
        body = payload_of(p, coef) if p.comment.startswith(b"payload-bytes=") else None
        rgb = pixels(p, coef)
        row = [len(body), hashlib.sha256(body).hexdigest(), zlib.crc32(body[-32:])] if body is not None else [None] * 3
        row += [len(raw), hashlib.sha256(raw).hexdigest(), feature(rgb)]
        return row + [body] * payload + ([rgb.tobytes(), list(rgb.shape)] if tensor else [])

    def make():
        def work(values):
            out = [[None] * len(values) for _ in fields]
            for a, b in batches(values):
                at = [k for k in range(a, b) if values[k] is not None]
                pictures = [Picture(values[k]) for k in at]
                coef, start = decode(pictures)
                for k, p, s, e in zip(at, pictures, start, start[1:], strict=False):
                    for column, v in zip(out, one(values[k], p, coef[s:e]), strict=True):
                        column[k] = v
            return out

        return work

    return add_columns(rows, media, fields, make)


def saved(docs: DataFrame, path: str, text: str = "text", out: str = "media", tensors: bool = False) -> DataFrame:
    """docs with their texts stored as pictures in Parquet files under path, read again; with `tensors` also the full-resolution RGB tensor of
    each and its shape, stored beside it."""
    rows = store(docs, text, out)
    if tensors:
        rows = load(rows, out, tensor=True)
    rows.write.option("compression", "zstd").parquet(path)
    return docs.sparkSession.read.schema(rows.schema).parquet(path)


def round_trip(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Every text stored in the shared folder and read back from there: id, n_bytes (unpadded) and the columns of load(). Null and empty
    texts are one unit of padding. Texts are stored whole; rows are independent, so repeated rows get equal values and an empty
    table gives an empty result. Other columns are ignored."""
    rows = docs.select(F.col(id_col), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"), F.col(text).cast("binary").alias("_text"))
    kept = store(rows, "_text", "_media").drop("_text")
    path = new_path(docs.sparkSession, "media")
    kept.write.option("compression", "zstd").parquet(path)
    return load(docs.sparkSession.read.schema(kept.schema).parquet(path), "_media").drop("_media")
