"""The block coder: adaptive models of order 0 to 2 mixed into one distribution that drives a range coder.

A segment is a sequence of ids cut into blocks of nearly equal length. Every block is coded on its own: its models and
its coder start anew, and it has its own checksum. The blocks of a segment are coded side by side, one id of each at a
step, so that each step is a handful of array operations. When ids are coded, only the tables and the coder go step by step:
places, symbols and their distributions are found for all steps up to the next renewal at once.

Model of a block: order 2 and order 1 each predict one id (hash tables of the two previous ids and of the previous id,
with a confidence of 0 to 3); order 0 holds adaptive frequencies of id sizes. The coded symbol is 0 (order 2 was right),
1 (else order 1 was right) or 2 + the id's size class, whose lower bits follow as they are, in a stream of their own.
Two tables of counts are mixed: symbols by the confidences and agreement of the two predictions, over symbols by
whether the previous id was predicted. The mixed distributions, in units of 1 / 4096, are renewed at fixed steps.
"""

from __future__ import annotations

import zlib

import numpy as np

#: Fixed values of the format.
BLOCK = 4096
TABLE1, TABLE2 = 1 << 11, 1 << 12
ROWS, PREVIOUS, WIDE = 32, 2, 16
UNITS, PRIOR = 12, 512
CLASSES = 8
HASH1, SHIFT1, MASK1 = (np.array(x, np.uint32) for x in (40503, 5, TABLE1 - 1))
HASH2, SHIFT2, MASK2 = (np.array(x, np.uint32) for x in (2654435, 7, TABLE2 - 1))
FOUR, ONE, TWO, THREE, SIXTEEN = np.array(4, np.uint32), *(np.array(x, np.int32) for x in (1, 2, 3, 16))
TOP, LOW, WORD, MASK32, SCALE, LAST = (np.array(x, np.uint64) for x in (1 << 48, 1 << 32, 16, 0xFFFFFFFF, UNITS, (1 << UNITS) - 1))
#: Blocks whose distributions are mixed at once, and steps whose places are found at once: these arrays stay in a core's cache.
MIXED, NEAR = 64, 32


def renewed(step: int) -> bool:
    """Whether the mixed distributions are renewed before this step: at 16, 32, 64, 128, 256, and then after every 512 steps."""
    return step % 512 == 0 and step > 0 or step in (16, 32, 64, 128, 256)


class Model:
    """State of n blocks that are coded side by side."""

    def __init__(self, n: int, bits: int) -> None:
        """bits: of the largest id."""
        self.n, self.bare = n, max(bits - CLASSES, 0)
        self.symbols = 3 + bits - self.bare
        lanes = np.arange(n, dtype=np.int64)
        # One table of both orders: order 1 first.
        self.base, self.base_row = np.stack([lanes * TABLE1, n * TABLE1 + lanes * TABLE2]), lanes * (PREVIOUS * ROWS)
        self.table = np.zeros(n * (TABLE1 + TABLE2), np.int32)
        self.counts = np.zeros((n, PREVIOUS, ROWS, WIDE), np.int32)
        self.cum = np.full(self.counts.shape, 1 << UNITS, np.uint16)
        self.cum[..., 0] = 0
        self.flat = self.cum.reshape(-1)
        self.used: list[np.ndarray] = []
        self.renew()

    def renew(self) -> None:
        """Add the symbols coded since the last time to the counts, and mix them."""
        if self.used:
            self.counts += np.bincount(np.concatenate(self.used), minlength=self.counts.size).reshape(self.counts.shape)
            self.used = []
        k = self.symbols
        for a in range(0, self.n, MIXED):
            counts = self.counts[a : a + MIXED, ..., :k]
            by_row = counts.sum(axis=1, dtype=np.int32)
            by_previous = counts.sum(axis=2, dtype=np.int32) * 8 + 1
            prior = by_previous * PRIOR // by_previous.sum(axis=2, dtype=np.int32, keepdims=True)
            # Sums of rows and of priors are added, which takes fewer steps than summing all pairs; they are below 2**24, so that single precision holds them.
            upto = np.cumsum(by_row * 64, axis=2, dtype=np.float64)[:, None] + np.cumsum(prior + 1, axis=2, dtype=np.float64)[:, :, None]
            upto *= np.float32((1 << UNITS) - k) / upto[..., -1:].astype(np.float32)
            upto = upto.astype(np.uint16)
            upto += np.arange(1, k + 1, dtype=np.uint16)
            self.cum[a : a + MIXED, ..., 1:k] = upto[..., :-1]

    def places(self, last: np.ndarray, last2: np.ndarray) -> np.ndarray:
        """Places in the table of both orders, along the axis before the last; last and last2: the two previous ids, uint32, of all blocks along the last axis."""
        mixed = last * HASH1
        at = np.empty((*last.shape[:-1], 2, self.n), np.int64)
        at[..., 0, :] = mixed >> SHIFT1 & MASK1
        mixed += last2 * HASH2
        at[..., 1, :] = mixed >> SHIFT2 & MASK2
        at += self.base
        return at

    def update(self, at: np.ndarray, found: np.ndarray, four: np.ndarray) -> None:
        """found: at these places; four: 4 * ids, int32. A right prediction gets surer up to 3; a wrong one less sure, or it is replaced."""
        wrong = (found - four).view(np.uint32) >= FOUR
        less = found - ONE
        np.putmask(less, found & TWO == 0, four + ONE)  # along the last axis: four's values are repeated for each order
        new = found + ONE
        np.minimum(new, four + THREE, out=new)
        np.putmask(new, wrong, less)
        self.table[at] = new


def lengths(n: int) -> np.ndarray:
    """Ids in each block: nearly equal, the longer first."""
    blocks = -(-n // BLOCK)
    return np.full(blocks, n // blocks, np.int64) + (np.arange(blocks) < n % blocks) if blocks else np.zeros(0, np.int64)


def stepwise(values: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Values of all ids as (step, block); 0 where a block has ended."""
    steps = int(size[0])
    long = int((size == steps).sum())
    out = np.zeros((steps, len(size)), values.dtype)
    out[:, :long] = values[: long * steps].reshape(long, steps).T
    out[: steps - 1, long:] = values[long * steps :].reshape(len(size) - long, steps - 1).T
    return out


def blockwise(columns: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The inverse of stepwise."""
    steps = int(size[0])
    long = int((size == steps).sum())
    return np.concatenate([columns[:, :long].T.reshape(-1), columns[: steps - 1, long:].T.reshape(-1)])


def sizes(ids: np.ndarray, bare: int) -> tuple[np.ndarray, np.ndarray]:
    """(symbol of the size class, number of lower bits): ids below 2**bare are one class, then there is one for each bit length."""
    long = np.frexp(ids.astype(np.float32))[1] if not len(ids) or int(ids.max()) < 1 << 24 else np.frexp(ids.astype(np.float64))[1]
    return (np.maximum(long - bare, 0) + 2).astype(np.uint8), np.where(long <= bare, bare, long - 1).astype(np.uint8)


def encode(ids: np.ndarray, bits: int = 24) -> tuple[bytes, bytes]:
    """(header, payload) of ids of so many bits at most: for each block its 16-bit words, its 32-bit words of lower bits and its checksum as uint32; the words of all blocks in order, first those of 16 bits."""
    ids = np.ascontiguousarray(ids, "<u4")
    if len(ids) and int(ids.max()) >> bits:
        raise ValueError(f"ids must be below 2**{bits}")
    size = lengths(len(ids))
    blocks = len(size)
    if not blocks:
        return b"", b""
    start = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
    crc = np.array([zlib.crc32(ids[a:b]) for a, b in zip(start[:-1], start[1:], strict=True)], "<u4")
    steps = int(size[0])
    model = Model(blocks, bits)
    if bits <= 16:  # a table of all ids
        kind, lower = (x.take(ids) for x in sizes(np.arange(1 << bits), model.bare))
    else:
        kind, lower = sizes(ids, model.bare)
    ids = ids.astype(np.int32)
    columns, kinds, symbols = stepwise(ids, size), stepwise(kind, size), np.zeros((steps, blocks), np.uint8)
    room = steps + 8
    out, at = np.zeros(blocks * room, np.uint32), np.arange(blocks, dtype=np.int64) * room
    low, width = np.zeros(blocks, np.uint64), np.full(blocks, TOP, np.uint64)
    ends = [x for x in range(1, steps) if renewed(x) or x % NEAR == 0] + [steps]
    for a, z in zip([0, *ends], ends):
        if renewed(a):
            model.renew()
        now = columns[a:z]
        last = np.zeros((z - a + 1, blocks), np.uint32)  # from the id before the last one on
        last[: z - a + 1] = columns[a - 2 : z - 1] if a else 0
        if not a:
            last[2:] = columns[: z - 1]
        places, four = model.places(last[1:], last[:-1]), now << 2
        found = np.empty(places.shape, np.int32)
        for step in range(z - a):
            model.table.take(places[step], out=found[step], mode="clip")
            model.update(places[step], found[step], four[step])
        guess = found >> 2
        symbol = np.where(now == guess[:, 1], 0, np.where(now == guess[:, 0], 1, kinds[a:z])).astype(np.uint8)
        symbols[a:z] = symbol
        found &= 3
        where = found[:, 1] * 4 + found[:, 0] + (guess[:, 0] == guess[:, 1]) * np.int32(16) + model.base_row
        where[0] += (symbols[a - 1] > 1) * ROWS if a else 0
        where[1:] += (symbol[:-1] > 1) * ROWS
        where *= WIDE
        where += symbol
        below = model.flat.take(where)
        share = (model.flat.take(where + 1) - below).astype(np.uint64)
        below = below.astype(np.uint64)
        model.used.append(where.reshape(-1))
        for step in range(z - a):
            n = blocks if a + step < size[-1] else int(np.searchsorted(-size, -(a + step)))
            unit = width[:n] >> SCALE
            low[:n] += unit * below[step, :n]
            width[:n] = unit * share[step, :n]
            if (short := np.flatnonzero(width[:n] < LOW)).size:
                x, to = low[short], at[short]
                out[to] = x >> np.uint64(32)  # 17 bits: the highest is carried at the end
                low[short] = (x & MASK32) << WORD
                width[short] <<= WORD
                at[short] = to + 1
    for shift in (32, 16, 0):
        out[at] = low >> np.uint64(32)
        low = (low & MASK32) << WORD
        at += 1
    while (carry := np.flatnonzero(out >> np.uint32(16))).size:
        out[carry] &= np.uint32(0xFFFF)
        out[carry - 1] += np.uint32(1)
    used = at - np.arange(blocks) * room
    words = out.reshape(blocks, room)[np.arange(room) < used[:, None]].astype("<u2")

    given = blockwise(symbols, size)
    count = np.where(given > 1, lower, 0).astype(np.int64)
    ends = np.concatenate([[0], np.cumsum(count)])
    raw = -(-(ends[start[1:]] - ends[start[:-1]]) // 32)
    first = np.concatenate([[0], np.cumsum(raw)])
    place = ends[:-1] + np.repeat(first[:-1] * 32 - ends[start[:-1]], size)
    part = (ids & (1 << count) - 1).astype(np.uint64) << (place & 31).astype(np.uint64)
    total = int(first[-1]) + 1
    place >>= 5
    # The bits of a word are disjoint: the sums are exact.
    lows = np.bincount(place, weights=(part & MASK32).astype(np.float64), minlength=total + 1)
    lows[1:] += np.bincount(place, weights=(part >> np.uint64(32)).astype(np.float64), minlength=total + 1)[:-1]
    bare = lows[: total - 1].astype("<u4")
    return np.stack([used, raw, crc], axis=1).astype("<u4").tobytes(), words.tobytes() + bare.tobytes()


def decode(n_ids: int, header: bytes, payload: bytes, bits: int = 24) -> np.ndarray:
    """The ids; raises ValueError where a block's checksum differs."""
    size = lengths(n_ids)
    blocks = len(size)
    used, raw, crc = np.frombuffer(header, "<u4").reshape(-1, 3).T.astype(np.int64)
    if len(used) != blocks or int(used.sum()) * 2 + int(raw.sum()) * 4 != len(payload):
        raise ValueError("the header doesn't fit the number of ids or the payload")
    if not blocks:
        return np.zeros(0, "<u4")
    split = int(used.sum())
    data = np.concatenate([np.frombuffer(payload, "<u2", split), np.zeros(4, np.uint16)]).astype(np.uint64)
    bare = np.concatenate([np.frombuffer(payload, "<u4", offset=2 * split), np.zeros(2, np.uint32)]).astype(np.uint64)
    bare = bare[:-1] | bare[1:] << np.uint64(32)
    at, place = np.cumsum(used) - used, (np.cumsum(raw) - raw) * 32
    steps = int(size[0])
    width, value = np.full(blocks, TOP, np.uint64), np.zeros(blocks, np.uint64)
    for _ in range(3):
        value = value << WORD | data[at]
        at += 1
    columns = np.zeros((steps, blocks), np.uint32)
    model = Model(blocks, bits)
    lower = np.array([0, 0, model.bare, *(model.bare + np.arange(model.symbols - 3))], np.int64)
    lead = np.where(np.arange(model.symbols) > 2, 1 << lower, 0).astype(np.uint64)
    mask = ((1 << lower) - 1).astype(np.uint64)
    row_of = (np.arange(model.symbols) > 1) * ROWS
    lines, none, begin = model.flat.reshape(-1, WIDE), np.zeros(blocks, np.uint32), model.base_row
    for step in range(steps):
        if renewed(step):
            model.renew()
        places = model.places(columns[step - 1] if step else none, columns[step - 2] if step > 1 else none)
        found = model.table.take(places, mode="clip")
        guess, sure = found >> TWO, found & THREE
        row = (guess[0] == guess[1]) * SIXTEEN
        row += sure[1] << TWO
        row += sure[0]
        row = row + begin
        unit = width >> SCALE
        point = np.minimum(value // unit, LAST).astype(np.uint16)
        # The last symbol whose sum is at most the point: all sums are compared, and the bytes of those that are counted.
        upto = lines.take(row, axis=0, mode="clip") <= point[:, None]
        counted = np.bitwise_count(upto.view(np.uint64))
        symbol = counted[:, 0] + counted[:, 1]
        symbol -= 1
        row *= WIDE
        row += symbol
        below = model.flat.take(row, mode="clip")
        share = model.flat.take(row + 1, mode="clip") - below
        value -= unit * below
        width = unit * share
        if (short := np.flatnonzero(width < LOW)).size:
            to = at[short]
            value[short] = value[short] << WORD | data.take(to, mode="clip")
            width[short] <<= WORD
            at[short] = to + 1
        bit = bare.take(place >> 5, mode="clip")
        bit >>= (place & 31).view(np.uint64)
        bit &= mask.take(symbol)
        bit |= lead.take(symbol)
        place += lower.take(symbol)
        now = bit.astype(np.int32)
        np.putmask(now, symbol == 0, guess[1])
        np.putmask(now, symbol == 1, guess[0])
        model.update(places, found, now << TWO)
        model.used.append(row)
        columns[step] = now
        begin = model.base_row + row_of.take(symbol)
    out = blockwise(columns, size).astype("<u4")
    ends = np.cumsum(size)
    for j, (a, b) in enumerate(zip(ends - size, ends, strict=True)):
        if zlib.crc32(out[a:b]) != crc[j]:
            raise ValueError(f"block {j}: checksum differs")
    return out
