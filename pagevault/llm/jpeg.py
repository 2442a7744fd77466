"""A progressive JPEG codec in numpy that works on many images at once.

Decoding follows the standard (Huffman coding, 8 bits, spectral selection and successive approximation): every scan
adds to the coefficient arrays of its components, which are inverse-transformed only at the end. Restart intervals are
independent, so all intervals of a scan, over all images that share its parameters and tables, advance in step, one
symbol each; an image without restarts is one interval. The coder writes one interval for each coding unit.

Coefficients are kept in zigzag order, a row for each block, components one after the other, blocks in raster order.
"""

from __future__ import annotations

import bisect
import functools
import heapq
from collections import defaultdict
from dataclasses import dataclass, field

import numpy as np

#: Fixed value of the format: the order in which an 8 by 8 block's coefficients are coded.
ZIGZAG = np.array(sorted(range(64), key=lambda i: (i // 8 + i % 8, i // 8 if (i // 8 + i % 8) % 2 else i % 8)))
#: Point transform of the first scans, and the bands of the first AC scans.
SHIFT, BANDS = 1, ((1, 5), (6, 63))


# Huffman tables


@dataclass(frozen=True)
class Table:
    """lengths[i] codes have i + 1 bits; symbols in code order."""

    lengths: bytes
    symbols: bytes

    @functools.cached_property
    def codes(self) -> tuple[np.ndarray, np.ndarray]:
        """Code and its length by symbol."""
        code, at = np.zeros(256, dtype=np.uint64), 0
        size, n = np.zeros(256, dtype=np.int64), 0
        for bits, count in enumerate(self.lengths, 1):
            for _ in range(count):
                code[self.symbols[n]], size[self.symbols[n]] = at, bits
                at, n = at + 1, n + 1
            at <<= 1
        return code, size

    @functools.cached_property
    def peek(self) -> np.ndarray:
        """By the next 16 bits: the symbol, and its code's length shifted by 8; 0 where no code fits."""
        out = np.zeros(1 << 16, dtype=np.int64)
        code, size = self.codes
        for s in self.symbols:
            start = int(code[s]) << (16 - int(size[s]))
            out[start : start + (1 << (16 - int(size[s])))] = s | int(size[s]) << 8
        return out

    @functools.cached_property
    def first(self) -> np.ndarray:
        """Of first AC scans, by the next 16 bits: bits 0-7 bits to advance, 8-15 coefficients to skip, 16 whether one is
        written, 17 whether the symbol needs more than 16 bits, from 32 the value."""
        window = np.arange(1 << 16, dtype=np.int64)
        symbol, length = self.peek & 255, self.peek >> 8
        run, size = symbol >> 4, symbol & 15
        value = (window >> np.maximum(16 - length - size, 0)) & ((1 << size) - 1)
        value = np.where(value >> np.maximum(size - 1, 0) == 0, value - (1 << size) + 1, value)
        written = size > 0
        slow = (written & (length + size > 16)) | (~written & (run > 0) & (run < 15)) | (length == 0)
        skip = np.where(written, run, np.where(run == 15, 16, 64))
        out = (length + size) | (skip << 8) | (written.astype(np.int64) << 16) | (slow.astype(np.int64) << 17)
        return out | (np.where(written & ~slow, value, 0) << 32)


def table_for(weights: dict[int, float]) -> Table:
    """A Huffman table for the weights; no code is all ones."""
    heap = [(w, n, [s]) for n, (s, w) in enumerate(sorted(weights.items()))]
    heap.append((0.0, len(heap), [-1]))  # takes the all-ones code
    heapq.heapify(heap)
    depth: dict[int, int] = defaultdict(int)
    n = len(heap)
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        for s in a[2] + b[2]:
            depth[s] += 1
        n += 1
        heapq.heappush(heap, (a[0] + b[0], n, a[2] + b[2]))
    longest = max(depth.values())
    if longest > 16:
        raise ValueError("weights differ too much for 16-bit codes")
    order = sorted(weights, key=lambda s: (depth[s], s))
    return Table(bytes(sum(depth[s] == i for s in weights) for i in range(1, 17)), bytes(order))


@functools.cache
def own_tables() -> tuple[Table, Table]:
    """DC and AC tables of the coder, from a rough model of text bytes."""
    size = [0.1, 0.15, 0.25, 0.3, 0.1, 0.06, 0.15, 0.03, 0.01, 0.002, 0.001, 0.001]
    dc = table_for(dict(enumerate(size)))
    ac = {run << 4 | s: max(size[s] * 0.18**run, 2e-4) for run in range(16) for s in range(1, 11)}
    return dc, table_for(ac | {0: 0.15, 0xF0: 1e-3})


# Coding


def packed(values: np.ndarray, lengths: np.ndarray, lanes: np.ndarray, restart: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bit strings joined within each lane (lanes ascending, all present), filled with ones to whole bytes, stuffed.

    restart: the number of the restart marker before each lane, or -1. Returns the bytes and where each lane starts.
    """
    ends = np.cumsum(lengths, dtype=np.int64)
    last = np.append(np.flatnonzero(lanes[1:] != lanes[:-1]), len(lanes) - 1)
    total = np.diff(ends[last], prepend=0)
    size = (total + 7) // 8
    start = np.cumsum(size) - size
    at = ends - lengths + np.repeat(8 * start - (np.cumsum(total) - total), np.diff(last, prepend=-1))
    word, shifted = at >> 5, values.astype(np.uint64) << (64 - (at & 31) - lengths).view(np.uint64)
    words = int(size.sum()) // 4 + 3
    data = np.bincount(word, weights=(shifted >> np.uint64(32)).astype(np.float64), minlength=words)
    data += np.bincount(word + 1, weights=(shifted & np.uint64(0xFFFFFFFF)).astype(np.float64), minlength=words)
    data = data.astype(np.uint32).byteswap().view(np.uint8)[: int(size.sum())]
    data[start + size - 1] |= ((1 << (8 * size - total)) - 1).astype(np.uint8)
    full = data == 0xFF
    marked = 2 * np.cumsum(restart >= 0)
    before = np.cumsum(full) - full
    to = np.arange(len(data)) + before + np.repeat(marked, size)
    out = np.zeros(len(data) + int(full.sum()) + int(marked[-1]), dtype=np.uint8)
    out[to] = data
    first = to[start]
    has = restart >= 0
    out[first[has] - 2], out[first[has] - 1] = 0xFF, 0xD0 + restart[has]
    return out, first - 2 * has


def magnitude(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Size category and the extra bits of values."""
    size = _SIZES[np.abs(v)]
    return size, np.where(v < 0, v + (1 << size) - 1, v)


_SIZES = np.array([int(i).bit_length() for i in range(1 << 12)])


def dc_first(dc: np.ndarray, table: Table, per_lane: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """dc: differences in coding order."""
    code, length = table.codes
    size, bits = magnitude(dc)
    return (code[size] << size.astype(np.uint64)) | bits.astype(np.uint64), length[size] + size, np.arange(len(dc)) // per_lane


@functools.lru_cache(maxsize=8)
def joined(table: Table) -> tuple[np.ndarray, np.ndarray]:
    """For run << 10 | value + 512: the code with its extra bits, and their number."""
    code, length = table.codes
    v = np.arange(-512, 512)
    size, bits = magnitude(v)
    symbol = np.arange(16)[:, None] << 4 | size[None, :]
    value = (code[symbol] << size[None, :].astype(np.uint64)) | bits[None, :].astype(np.uint64)
    return value.astype(np.uint32).reshape(-1), (length[symbol] + size[None, :]).astype(np.int64).reshape(-1)


def gaps(at: np.ndarray, row: np.ndarray, start: np.ndarray) -> np.ndarray:
    """For ascending places and the rows that they are in: the place after the one before in the same row, or the row's start."""
    before = np.empty(len(at), dtype=np.int64)
    if len(at):
        before[0] = start[0]
        before[1:] = np.where(row[1:] == row[:-1], at[:-1] + 1, start[1:])
    return before


def ac_first(v: np.ndarray, table: Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """v: a band of point-transformed coefficients, a row for each lane. Each cell emits one symbol at most: a value, a
    run of 16 zeros at its last zero, or the end of the block after the last value."""
    n, width = v.shape
    code, length = table.codes
    both, sizes = joined(table)
    flat = np.ascontiguousarray(v).reshape(-1)
    at = np.flatnonzero(flat)
    row = at // width
    run = at - gaps(at, row, row * width)
    value, bits = np.zeros(n * width, dtype=np.uint32), np.zeros(n * width, dtype=np.int64)
    key = ((run & 15) << 10) + flat[at] + 512
    value[at], bits[at] = both[key], sizes[key]
    for i in np.flatnonzero(run > 15):  # few
        zeros = at[i] - run[i] + np.arange(15, run[i] - run[i] % 16, 16)
        value[zeros], bits[zeros] = code[0xF0], length[0xF0]
    ends = np.arange(n) * width
    ends[row] = at + 1  # the last of equal rows counts
    ends = ends[ends < (np.arange(n) + 1) * width]
    value[ends], bits[ends] = code[0], length[0]
    some = np.flatnonzero(bits)
    return value[some], bits[some], some // width


def ac_refine(v: np.ndarray, table: Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """v: a band of full coefficients whose last bit is sent now. A symbol is emitted in the first cell that it covers, before
    the correction bits of the values that are known already."""
    n, width = v.shape
    code, length = table.codes
    flat = np.ascontiguousarray(v).reshape(-1)
    size = np.abs(flat)
    known = size > 1
    at = np.flatnonzero(size == 1)
    zero = np.flatnonzero(size == 0)
    row = at // width
    begin = gaps(at, row, row * width)
    first = np.searchsorted(zero, begin)
    run = np.searchsorted(zero, at) - first
    value, bits = (known & (size & 1).astype(bool)).astype(np.uint32), known.astype(np.int64)
    ends = np.arange(n) * width
    ends[row] = at + 1
    ends = ends[ends < (np.arange(n) + 1) * width]

    def put(where: np.ndarray, symbol: np.ndarray, extra: np.ndarray, n_extra: int) -> None:
        word = (code[symbol].astype(np.uint32) << np.uint32(n_extra)) | extra.astype(np.uint32)
        value[where] |= word << known[where].astype(np.uint32)
        bits[where] += length[symbol] + n_extra

    for i in np.flatnonzero(run > 15):  # few: runs of 16 zeros, each ending at its last zero
        for k in range(int(run[i]) // 16):
            put(begin[i : i + 1], np.array([0xF0]), np.zeros(1), 0)
            begin[i] = zero[first[i] + 16 * k + 15] + 1
    put(begin, (run & 15) << 4 | 1, flat[at] > 0, 1)
    put(ends, np.zeros(len(ends), dtype=np.int64), np.zeros(len(ends)), 0)
    some = np.flatnonzero(bits)
    return value[some], bits[some], some // width


def segment(marker: int, body: bytes) -> bytes:
    return bytes([0xFF, marker]) + (len(body) + 2).to_bytes(2, "big") + body


@functools.cache
def in_units(wide: int, high: int) -> np.ndarray:
    """Of an image of that many 16 by 16 units: the rows of its 4:2:0 blocks, unit by unit."""
    j, i = np.meshgrid(np.arange(wide), np.arange(high))
    y = [(2 * i + a) * 2 * wide + 2 * j + b for a in (0, 1) for b in (0, 1)]
    n = wide * high
    return np.stack([*y, 4 * n + i * wide + j, 5 * n + i * wide + j], axis=2).reshape(-1)


def encode(coefficients: list[np.ndarray], shapes: list[tuple[int, int]], comments: list[bytes]) -> list[bytes]:
    """4:2:0 images of (wide, high) 16 by 16 units from rows of quantised coefficients (all steps 1)."""
    if not shapes:
        return []
    dc_table, ac_table = own_tables()
    units = np.array([w * h for w, h in shapes])
    base = np.cumsum(6 * units) - 6 * units
    every = np.concatenate(coefficients).astype(np.int16)
    unit_rows = np.concatenate([b + in_units(*s) for b, s in zip(base, shapes, strict=True)])
    dc = every[unit_rows, 0].astype(np.int64).reshape(-1, 6)
    high = dc >> SHIFT
    steps = np.concatenate([high[:, :1], high[:, 1:4] - high[:, :3], high[:, 4:]], axis=1)  # each unit starts anew
    shifted = np.sign(every) * (np.abs(every) >> SHIFT)
    scans = []  # head, bytes, where each lane starts, lanes of each image
    of = lambda part: np.concatenate([np.arange(b + part[0] * n, b + part[1] * n) for b, n in zip(base, units, strict=True)])
    components = [(1, of((0, 4)), 4), (2, of((4, 5)), 1), (3, of((5, 6)), 1)]

    def scan(head: bytes, coded: tuple[np.ndarray, np.ndarray, np.ndarray], lanes: np.ndarray) -> None:
        own = np.arange(lanes.sum()) - np.repeat(np.cumsum(lanes) - lanes, lanes)
        data, starts = packed(*coded, np.where(own > 0, (own - 1) % 8, -1))
        firsts = starts[np.cumsum(lanes) - lanes]
        scans.append((segment(0xDA, head), data.tobytes(), [*firsts.tolist(), len(data)]))

    all_three = bytes([3, 1, 0, 2, 0, 3, 0])
    scan(all_three + bytes([0, 0, SHIFT]), dc_first(steps.reshape(-1), dc_table, 6), units)
    for c, rows, share in components:
        for lo, hi in BANDS:
            scan(bytes([1, c, 0, lo, hi, SHIFT]), ac_first(shifted[rows, lo : hi + 1], ac_table), share * units)
    for c, rows, share in components:
        scan(bytes([1, c, 0, 1, 63, SHIFT << 4]), ac_refine(every[rows, 1:], ac_table), share * units)
    low = (dc & 1).reshape(-1)
    scan(all_three + bytes([0, 0, SHIFT << 4]), (low, np.ones(len(low), dtype=np.int64), np.arange(len(low)) // 6), units)
    tables = segment(0xDB, bytes([0]) + bytes([1] * 64)) + b"".join(segment(0xC4, bytes([k << 4]) + t.lengths + t.symbols) for k, t in enumerate((dc_table, ac_table)))
    tables += segment(0xDD, (1).to_bytes(2, "big"))
    out = []
    for i, (shape, comment) in enumerate(zip(shapes, comments, strict=True)):
        frame = bytes([8]) + (16 * shape[1]).to_bytes(2, "big") + (16 * shape[0]).to_bytes(2, "big") + bytes([3, 1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0])
        out.append(b"".join([b"\xff\xd8", segment(0xFE, comment), tables, segment(0xC2, frame), *(x for head, data, at in scans for x in (head, data[at[i] : at[i + 1]])), b"\xff\xd9"]))
    return out


# Decoding


@dataclass
class Component:
    name: int
    across: int  # sampling factors
    down: int
    steps: int  # number of its quantisation table
    wide: int = 0  # blocks, with those that fill up units
    high: int = 0
    own_wide: int = 0  # blocks that a scan of this component alone has
    own_high: int = 0
    base: int = 0  # its first row among all images' coefficients


@dataclass
class Scan:
    components: list[int]
    tables: list[tuple[Table | None, Table | None]]
    low: int
    high: int
    before: int  # bits known so far are those from this one up; 0: first
    shift: int
    restart: int
    start: int
    end: int


@dataclass
class Image:
    width: int = 0
    height: int = 0
    components: list[Component] = field(default_factory=list)
    scans: list[Scan] = field(default_factory=list)
    steps: dict[int, np.ndarray] = field(default_factory=dict)
    comment: bytes = b""


@functools.lru_cache(maxsize=256)
def table(lengths: bytes, symbols: bytes) -> Table:
    return Table(lengths, symbols)


def parse(data: bytes, marks: list[int], offset: int) -> Image:
    """An image's frame, tables and scans. marks: where markers other than restarts may be, over all images."""
    if data[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG image")
    image, tables, restart, at = Image(), {}, 0, 2
    while True:
        while data[at] == 0xFF and data[at + 1] == 0xFF:
            at += 1
        marker = data[at + 1]
        if marker == 0xD9:
            return image
        size = int.from_bytes(data[at + 2 : at + 4], "big")
        body, at = data[at + 4 : at + 2 + size], at + 2 + size
        if marker == 0xC2:
            image.height, image.width = int.from_bytes(body[1:3], "big"), int.from_bytes(body[3:5], "big")
            if body[0] != 8:
                raise ValueError("samples of 8 bits only")
            if not 0 < 3 * image.width * image.height < 1 << 31:
                raise ValueError("no pixels, or more than a value of a column can hold")
            image.components = [Component(body[i], body[i + 1] >> 4, body[i + 1] & 15, body[i + 2]) for i in range(6, 6 + 3 * body[5], 3)]
            across, down = (max(getattr(c, k) for c in image.components) for k in ("across", "down"))
            units = -(-image.width // (8 * across)), -(-image.height // (8 * down))
            for c in image.components:
                c.wide, c.high = units[0] * c.across, units[1] * c.down
                c.own_wide, c.own_high = -(-(-(-image.width * c.across // across)) // 8), -(-(-(-image.height * c.down // down)) // 8)
        elif marker in (0xC0, 0xC1, *range(0xC3, 0xC4), *range(0xC5, 0xC8), *range(0xC9, 0xCC), *range(0xCD, 0xD0)):
            raise ValueError("not a progressive image with Huffman codes")
        elif marker == 0xC4:
            i = 0
            while i < len(body):
                n = sum(body[i + 1 : i + 17])
                tables[body[i]] = table(body[i + 1 : i + 17], body[i + 17 : i + 17 + n])
                i += 17 + n
        elif marker == 0xDB:
            i = 0
            while i < len(body):
                wide = 1 + (body[i] >> 4)
                image.steps[body[i] & 15] = np.frombuffer(body[i + 1 : i + 1 + 64 * wide], dtype=">u2" if wide == 2 else np.uint8).astype(np.int64)
                i += 1 + 64 * wide
        elif marker == 0xDD:
            restart = int.from_bytes(body, "big")
        elif marker == 0xFE:
            image.comment = body
        elif marker == 0xDA:
            n = body[0]
            names = [c.name for c in image.components]
            end = marks[bisect.bisect_left(marks, offset + at)]
            image.scans.append(
                Scan([names.index(body[1 + 2 * i]) for i in range(n)], [(tables.get(body[2 + 2 * i] >> 4), tables.get(0x10 | body[2 + 2 * i] & 15)) for i in range(n)],
                     body[1 + 2 * n], body[2 + 2 * n], body[3 + 2 * n] >> 4, body[3 + 2 * n] & 15, restart, offset + at, end)
            )
            at = end - offset


@functools.lru_cache(maxsize=4096)
def scan_rows(shape: tuple[tuple[int, ...], ...]) -> tuple[np.ndarray, np.ndarray, int]:
    """For components (wide, high, own wide, own high, across, down, base): the component and the row of each block of a
    scan, in coding order, and the number of blocks in a unit."""
    if len(shape) == 1:
        wide, _, own_wide, own_high, *_ = shape[0]
        rows = (np.arange(own_high)[:, None] * wide + np.arange(own_wide)[None, :]).reshape(-1)
        return np.zeros(len(rows), dtype=np.int64), rows, 1
    units_wide, units_high = shape[0][0] // shape[0][4], shape[0][1] // shape[0][5]
    j, i = np.meshgrid(np.arange(units_wide), np.arange(units_high))
    which, rows = [], []
    for n, (wide, _, _, _, across, down, base) in enumerate(shape):
        for a in range(down):
            for b in range(across):
                which.append(np.full(i.shape, n))
                rows.append(base + (i * down + a) * wide + j * across + b)
    return np.stack(which, axis=2).reshape(-1), np.stack(rows, axis=2).reshape(-1), len(rows)


class Bits:
    """All images' bytes without stuffing, readable from any bit."""

    def __init__(self, data: np.ndarray) -> None:
        ff = np.flatnonzero(data[:-1] == 0xFF)
        after = data[ff + 1]
        self.restarts = ff[(after >= 0xD0) & (after <= 0xD7)]
        self.marks = ff[(after != 0) & (after != 0xFF) & ~((after >= 0xD0) & (after <= 0xD7))].tolist()
        keep = np.ones(len(data), dtype=bool)
        keep[ff[after == 0] + 1] = False
        self.place = np.cumsum(keep) - keep
        raw = np.concatenate([data[keep], np.zeros(16, dtype=np.uint8)]).astype(np.uint64)
        two = raw[:-1] << np.uint64(8) | raw[1:]
        four = two[:-2] << np.uint64(16) | two[2:]
        self.words = four[:-4] << np.uint64(32) | four[4:]

    def bit(self, at: np.ndarray) -> np.ndarray:
        """The bit position of bytes given by their place in the stuffed data."""
        return 8 * self.place[at]

    def window(self, p: np.ndarray) -> np.ndarray:
        """The next 57 bits at least, from the top."""
        return self.words[p >> 3] << (p & 7).astype(np.uint64)


def taken(x: np.ndarray, skip: np.ndarray, n: np.ndarray) -> np.ndarray:
    """n bits (0 to 16) of windows after skip bits."""
    y = (x << skip.astype(np.uint64)) >> np.uint64(40)  # 24 bits
    return (y >> (24 - n).astype(np.uint64)).astype(np.int64)


def extended(v: np.ndarray, size: np.ndarray) -> np.ndarray:
    return np.where((size > 0) & (v < (1 << np.maximum(size - 1, 0))), v - (1 << size) + 1, v)


@dataclass
class Lanes:
    """Restart intervals of one scan over many images: the bit where each starts, and its run of blocks."""

    p: np.ndarray
    first: np.ndarray
    count: np.ndarray
    rows: np.ndarray  # of all blocks in coding order
    which: np.ndarray  # their components, as numbered in the scan


def lanes_of(bits: Bits, images: list[Image], scans: list[Scan]) -> Lanes:
    rows, which, lengths = [], [], np.empty(len(images), dtype=np.int64)
    for n, (image, scan) in enumerate(zip(images, scans, strict=True)):
        own = [image.components[c] for c in scan.components]
        part, row, per_unit = scan_rows(tuple((c.wide, c.high, c.own_wide, c.own_high, c.across, c.down, c.base - own[0].base) for c in own))
        rows.append(row)
        which.append(part)
        lengths[n] = scan.restart * per_unit if scan.restart else len(row)
    sizes = np.array([len(r) for r in rows])
    base = np.array([i.components[s.components[0]].base for i, s in zip(images, scans, strict=True)])
    start, end = (np.array([getattr(s, k) for s in scans]) for k in ("start", "end"))
    lo, hi = np.searchsorted(bits.restarts, start), np.searchsorted(bits.restarts, end)
    n_lanes = hi - lo + 1
    if (n_lanes != -(-sizes // lengths)).any():
        raise ValueError("restart markers are missing")
    of = np.repeat(np.arange(len(images)), n_lanes)
    own = np.arange(len(of)) - np.repeat(np.cumsum(n_lanes) - n_lanes, n_lanes)
    p = np.where(own == 0, start[of], np.append(bits.restarts, 0)[np.where(own == 0, -1, lo[of] + own - 1)] + 2)
    first = (np.cumsum(sizes) - sizes)[of] + own * lengths[of]
    return Lanes(bits.bit(p), first, np.minimum(lengths[of], sizes[of] - own * lengths[of]), np.concatenate(rows) + np.repeat(base, sizes), np.concatenate(which))


def decode_dc(bits: Bits, lanes: Lanes, scan: Scan, out: np.ndarray) -> None:
    p, n = lanes.p.copy(), lanes.count
    order = np.argsort(-n, kind="stable")
    last = np.zeros((len(p), len(scan.components)), dtype=np.int64)
    peeks = None if scan.before else np.stack([t[0].peek for t in scan.tables])
    for t in range(int(n.max(initial=0))):
        live = order[: np.searchsorted(-n[order], -t, side="left")]
        at = lanes.first[live] + t
        row, part = lanes.rows[at], lanes.which[at]
        x = bits.window(p[live])
        if scan.before:
            out[row, 0] |= (x >> np.uint64(63)).astype(out.dtype) << scan.shift
            p[live] += 1
        else:
            found = peeks[part, (x >> np.uint64(48)).astype(np.int64)]
            size, length = found & 255, found >> 8
            last[live, part] += extended(taken(x, length, size), size)
            out[row, 0] = last[live, part] << scan.shift
            p[live] += length + size


def decode_ac_first(bits: Bits, lanes: Lanes, scan: Scan, out: np.ndarray) -> None:
    quick, peek = scan.tables[0][1].first, scan.tables[0][1].peek
    p, at, left = lanes.p.copy(), lanes.first.copy(), lanes.count.copy()
    row, k = lanes.rows[at], np.full(len(p), scan.low)
    flat = out.reshape(-1)
    while len(p):
        x = bits.window(p)
        top = (x >> np.uint64(48)).astype(np.int64)
        e = quick[top]
        advance, skip, ends = e & 255, (e >> 8) & 255, None
        value = e >> 32
        slow = np.flatnonzero(e & (1 << 17))
        if len(slow):
            found = peek[top[slow]]
            if not found.all():
                raise ValueError("a code that is in no table")
            length, run, size = found >> 8, (found >> 4) & 15, found & 15
            n = np.where(size > 0, size, run)
            more = taken(x[slow], length, n)
            advance[slow] = length + n
            value[slow] = np.where(size > 0, extended(more, size), 0)
            ends = (slow[size == 0], ((1 << run) + more - 1)[size == 0])
        p += advance
        k += skip
        written = np.flatnonzero(e & (1 << 16))
        flat[row[written] * 64 + k[written]] = value[written] << scan.shift
        k[written] += 1
        full = np.flatnonzero(k > scan.high)
        if len(full):
            blocks = np.ones(len(p), dtype=np.int64)
            if ends is not None:
                blocks[ends[0]] += ends[1]
            left[full] -= blocks[full]
            at[full] += blocks[full]
            k[full] = scan.low
            live = left > 0
            if not live.all():
                p, at, left, k, row = p[live], at[live], left[live], k[live], row[live]
                full = np.flatnonzero(k == scan.low)
            row[full] = lanes.rows[at[full]]


def decode_ac_refine(bits: Bits, lanes: Lanes, scan: Scan, out: np.ndarray) -> None:
    """Symbols are walked first: each tells how many known values, with one bit each, lie before its end. Where the symbols'
    own bits stand is noted by cell, so all correction bits are then found and applied at once."""
    peek = scan.tables[0][1].peek
    width = scan.high - scan.low + 1
    band = out[lanes.rows, scan.low : scan.high + 1]  # in coding order
    known = band != 0
    zero_block, zero_at = np.nonzero(~known)
    zeros = np.bincount(zero_block, minlength=len(band))
    zero_base = np.cumsum(zeros) - zeros
    zero_at = np.append(zero_at, width)
    own = np.zeros((len(band), width), dtype=np.int64)  # bits of symbols that start in a cell
    start = np.zeros(len(band), dtype=np.int64)
    p, at, left = lanes.p.copy(), lanes.first.copy(), lanes.count.copy()
    n = len(p)
    k, z, skip = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
    fresh = np.ones(n, dtype=bool)
    new_block, new_at, new_value = [], [], []
    one = 1 << scan.shift
    while len(p):
        start[at[fresh]] = p[fresh]
        x = bits.window(p)
        found = peek[(x >> np.uint64(48)).astype(np.int64)]
        waiting = skip > 0  # blocks that an earlier end-of-band run covers
        if not (found[~waiting]).all():
            raise ValueError("a code that is in no table")
        length, run, size = found >> 8, (found >> 4) & 15, found & 15
        ends = waiting | ((size == 0) & (run < 15))
        extra = np.where(size > 0, 1, np.where(run < 15, run, 0))
        symbol = np.where(waiting, 0, length + extra)
        more = taken(x, length, extra)
        goal = z + run  # the zero at which the symbol ends
        inside = ~ends & (goal < zeros[at])
        to = np.where(inside, zero_at[np.where(inside, zero_base[at] + goal, -1)], width)
        passed = np.where(inside, run, zeros[at] - z)  # zeros before that
        cell = np.flatnonzero(k < width)
        own[at[cell], k[cell]] += symbol[cell]
        p += symbol + (to - k) - passed
        new = np.flatnonzero(inside & (size > 0))
        new_block.append(at[new])
        new_at.append(to[new])
        new_value.append(np.where(more[new] > 0, one, -one))
        skip = np.where(waiting, skip - 1, np.where(ends, (1 << run) + more - 1, 0))
        z = np.where(inside, goal + 1, z)
        k = to + 1
        full = k >= width
        left -= full
        at = at + full
        k[full], z[full] = 0, 0
        fresh = full
        live = left > 0
        if not live.all():
            p, at, left, k, z, skip, fresh = (a[live] for a in (p, at, left, k, z, skip, fresh))
    b, c = np.nonzero(known)
    where = (start[:, None] + np.cumsum(own, axis=1) + np.cumsum(known, axis=1) - 1)[b, c]
    bit = (bits.window(where) >> np.uint64(63)).astype(out.dtype)
    cells = lanes.rows[b], c + scan.low
    out[cells] += np.sign(out[cells]) * bit * one
    if new_block:
        out[lanes.rows[np.concatenate(new_block)], np.concatenate(new_at) + scan.low] = np.concatenate(new_value)


def decode(files: list[bytes]) -> tuple[list[Image], np.ndarray]:
    """The images, and the coefficients of all of them (rows from each component's base)."""
    if not files:
        return [], np.zeros((0, 64), dtype=np.int32)
    bits = Bits(np.frombuffer(b"".join(files), dtype=np.uint8))
    images, offset, base = [], 0, 0
    for data in files:
        images.append(parse(data, bits.marks, offset))
        offset += len(data)
        for c in images[-1].components:
            c.base, base = base, base + c.wide * c.high
    out = np.zeros((base, 64), dtype=np.int32)
    for n in range(max(len(i.scans) for i in images)):
        alike = defaultdict(list)
        for image in images:
            if n < len(image.scans):
                s = image.scans[n]
                alike[len(s.components), tuple(map(tuple, ((id(a), id(b)) for a, b in s.tables))), s.low, s.high, s.before, s.shift].append((image, s))
        for group in alike.values():
            some, scans = zip(*group, strict=True)
            lanes, scan = lanes_of(bits, list(some), list(scans)), scans[0]
            (decode_dc if scan.low == 0 else decode_ac_refine if scan.before else decode_ac_first)(bits, lanes, scan, out)
    return images, out


@functools.cache
def basis() -> np.ndarray:
    """The inverse transform of a zigzag row, scaled by 2**12 and rounded, so sums of integers are exact."""
    u = np.arange(8)
    one = np.where(u == 0, np.sqrt(0.5), 1.0)[:, None] * np.cos((2 * u[None, :] + 1) * u[:, None] * np.pi / 16) / 2
    both = np.einsum("ux,vy->uvxy", one, one).reshape(64, 64)
    return np.rint(both[ZIGZAG] * 4096)


def samples(coefficients: np.ndarray) -> np.ndarray:
    """Blocks of 8-bit samples from dequantised rows."""
    exact = np.float32 if np.abs(coefficients).sum(axis=1).max(initial=0) * 1024 < 1 << 24 else np.float64
    x = coefficients.astype(exact) @ basis().astype(exact)
    return np.clip(np.floor((x + 2048) / 4096) + 128, 0, 255).astype(np.uint8).reshape(-1, 8, 8)


def rgb(image: Image, coefficients: np.ndarray, blocks: np.ndarray | None = None) -> np.ndarray:
    """height by width by 3; chroma is upsampled by repetition. blocks: the samples of all coefficients, if at hand."""
    planes = []
    across, down = (max(getattr(c, k) for c in image.components) for k in ("across", "down"))
    for c in image.components:
        rows = slice(c.base, c.base + c.wide * c.high)
        own = samples(coefficients[rows] * image.steps[c.steps]) if blocks is None else blocks[rows]
        planes.append(own.reshape(c.high, c.wide, 8, 8).swapaxes(1, 2).reshape(8 * c.high, 8 * c.wide))

    def full(plane: np.ndarray, c: Component) -> np.ndarray:
        if across % c.across == 0 and down % c.down == 0:
            plane = np.repeat(np.repeat(plane, down // c.down, axis=0), across // c.across, axis=1)
        else:
            y, x = (np.arange(image.height) * c.down // down), (np.arange(image.width) * c.across // across)
            plane = plane[y[:, None], x[None, :]]
        return plane[: image.height, : image.width]

    y = full(planes[0], image.components[0])
    if len(planes) < 3:
        return np.repeat(y[:, :, None], 3, axis=2)
    blue, red = image.components[1:3]
    if (blue.across, blue.down) != (red.across, red.down):  # else colours are worked out before upsampling
        planes[1:3], blue, red = [full(planes[1], blue), full(planes[2], red)], Component(0, across, down, 0), Component(0, across, down, 0)
    cb, cr = planes[1].astype(np.int32) - 128, planes[2].astype(np.int32) - 128
    out = np.empty((*y.shape, 3), dtype=np.uint8)
    for n, x in enumerate((91881 * cr, -22554 * cb - 46802 * cr, 116130 * cb)):
        out[:, :, n] = np.clip(full(((x + 32768) >> 16).astype(np.int16), blue) + y, 0, 255)
    return out
