"""An adaptive context-mixing range coder for token ids, in numpy.

Ids are coded in blocks that know nothing of each other but one table of frequencies, which stands before them. Within a
block three predictions are mixed: order 2 and order 1 name the id that last followed the same two ids or the same
id, and both learn with every id; order 0 has the frequencies of the table. Order 0 gets 1 to 64 parts in 64 of the
range and the named ids the rest, first that of order 2, then that of order 1. How much each gets depends on how often
it was right so far in this block, given whether the two named ids exist and agree; it is refitted every ``INTERVAL``
ids up to the block's end, by coder and decoder alike.

Many blocks are coded in step with each other, one array element for each block. Ids may be any unsigned 32-bit
numbers. If very many different ones occur, their two halves are coded one after the other.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

BLOCK = 8192
INTERVAL = 256
#: Bits of the two context tables.
H1, H2 = 11, 11
#: Different symbols that a table may have; bits of the shares' denominator.
SYMBOLS, SHARE = 1 << 17, 6
#: Ids that are looked up at once.
PART = 1 << 18
#: Factors of the two ids in the hash of order 2.
MIX_A, MIX_B = np.uint32(2246822519), np.uint32(3266489917)
#: The coder's state has two digits of this many bits; it is refilled when it has less than one.
DIGIT = 24
LOW, MASK = 1 << DIGIT, (1 << DIGIT) - 1
#: What a state (0: two named ids, 1: one id named by both, 2: only order 1 names one, 3: none does) is taken to have
#: seen before a block begins: ids, right ones of order 2 and of order 1.
BEFORE = np.array([[8, 1, 1], [8, 2, 0], [8, 0, 1], [0, 0, 0]], np.int64)


class Table:
    """The symbols (distinct numbers, in order) and their parts of ``1 << bits``."""

    def __init__(self, symbols: np.ndarray, freq: np.ndarray):
        self.symbols, self.freq = symbols, freq.astype(np.int64)
        self.cum = np.cumsum(self.freq) - self.freq
        self.bits = self.bits_for(len(symbols))
        self.total = self.bits + SHARE
        if int(self.freq.sum()) != 1 << self.bits or len(symbols) > SYMBOLS:
            raise ValueError("the frequencies don't fill their range")

    @staticmethod
    def bits_for(n: int) -> int:
        return 16 if n <= 1 << 14 else 18

    @classmethod
    def of(cls, symbols: np.ndarray, counts: np.ndarray) -> Table:
        room = (1 << cls.bits_for(len(symbols))) - len(symbols)
        freq = 1 + counts * room // counts.sum()
        freq[np.argmax(counts)] += room - (freq - 1).sum()
        return cls(symbols, freq)

    @property
    def none(self) -> int:
        """A symbol's number that stands for none."""
        return len(self.symbols)


class _Shares:
    """For each lane and state: the range's parts before order 1, before order 0, and those of an order-0 unit."""

    def __init__(self, lanes: int, bits: int):
        self.lanes, self.bits = lanes, bits
        self.seen = np.tile(BEFORE, (lanes, 1, 1))
        self.fit()

    def fit(self) -> None:
        n, by2, by1 = self.seen[:, :, 0], self.seen[:, :, 1], self.seen[:, :, 2]
        named = np.clip((64 * (by2 + by1) + n // 2) // np.maximum(n, 1), 1, 63)
        named[:, 3] = 0
        n12 = named << self.bits
        n2 = n12 * (by2 + 1) // (by2 + by1 + 2)
        n2[:, 1], n2[:, 2] = n12[:, 1], 0
        self.n2, self.n12, self.unit = n2.ravel(), n12.ravel(), (64 - named).ravel()

    def learn(self, outcomes: np.ndarray) -> None:
        """outcomes: 3 * (4 * lane + state) + 0 (order 0), 1 (order 2) or 2 (order 1); what is older counts less."""
        new = np.bincount(outcomes, minlength=12 * self.lanes).reshape(self.lanes, 4, 3)
        new[:, :, 0] += new[:, :, 1] + new[:, :, 2]
        self.seen += new - (self.seen >> 3)
        self.fit()


class _Contexts:
    """What last followed each id and each two ids, in every lane."""

    def __init__(self, lanes: int, none: int):
        kind = _kind(none)
        self.t1, self.t2 = np.full(lanes << H1, none, kind), np.full(lanes << H2, none, kind)
        self.lane1, self.lane2 = np.arange(lanes) << H1, np.arange(lanes) << H2
        self.i1, self.i2, self.before = self.lane1, self.lane2, np.zeros(lanes, np.uint32)

    def look(self) -> tuple[np.ndarray, np.ndarray]:
        """The ids that order 1 and order 2 name."""
        return self.t1.take(self.i1), self.t2.take(self.i2)

    def learn(self, x: np.ndarray) -> None:
        own = x.astype(self.t1.dtype)
        self.t1[self.i1] = own
        self.t2[self.i2] = own
        own = x.astype(np.uint32)
        self.i1 = self.lane1 + (x & ((1 << H1) - 1))
        self.i2 = self.lane2 + ((self.before + own * MIX_B) >> np.uint32(32 - H2))
        self.before = own * MIX_A


def _named(x: np.ndarray, none: int) -> tuple[np.ndarray, np.ndarray]:
    """What ``_Contexts`` would name at each step, for ids that are all known (a row for each step, a column for each lane): order 1, order 2."""
    steps, k = x.shape
    kind = _kind(none)
    out = np.full((k, steps), none, kind), np.full((k, steps), none, kind)
    before = np.zeros(steps + 2, np.uint32)
    for j, lane in enumerate(np.ascontiguousarray(x.T)):
        before[2:] = lane
        a, b = before[:-2], before[1:-1]
        slots = b & np.uint32((1 << H1) - 1), (a * MIX_A + b * MIX_B) >> np.uint32(32 - H2)
        for slot, found in zip(slots, out):
            keys = slot.astype(np.uint16)
            order = keys.argsort(kind="stable")  # within a slot in the order of the steps
            keys, own = keys.take(order), lane.take(order)
            found[j][order[1:]] = np.where(keys[1:] == keys[:-1], own[:-1], kind(none))
    return out[0].T, out[1].T


def _outcomes(lane4: np.ndarray, x: np.ndarray, c1: np.ndarray, c2: np.ndarray, none: int) -> tuple[np.ndarray, ...]:
    """What ``_Shares.learn`` takes, 4 * lane + state, and whether order 1 and order 2 were right."""
    j = _states(lane4, c1, c2, none)
    is2 = x == c2
    is1 = (x == c1) & ~is2
    by = is2.view(np.uint8) + is1.view(np.uint8)
    by += is1.view(np.uint8)
    return 3 * j + by, j, is1, is2


def _states(lane4: np.ndarray, c1: np.ndarray, c2: np.ndarray, none: int) -> np.ndarray:
    """4 * lane + state."""
    state, missing = (c1 == c2).view(np.uint8), (c2 == none).view(np.uint8)
    return lane4 + (state + missing + missing)


def _halves(ids: np.ndarray) -> np.ndarray:
    return np.stack([ids >> np.uint32(16), ids & np.uint32(0xFFFF)], axis=1).ravel()


def encode(ids: np.ndarray) -> tuple[bytes, list[bytes]]:
    """The table and the blocks of ids (uint32)."""
    if not len(ids):
        return b"", []
    symbols, x, counts = _distinct(ids)
    halved = len(symbols) > SYMBOLS
    if halved:
        symbols, x, counts = _distinct(_halves(ids))
    table, size = Table.of(symbols, counts), BLOCK << halved
    head = struct.pack("<BI", halved, len(symbols)) + np.diff(symbols, prepend=symbols[:1]).astype("<u4").tobytes()
    return zlib.compress(head + symbols[:1].astype("<u4").tobytes() + table.freq.astype("<u4").tobytes()), _encode(table, x, size)


def _distinct(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct ids, the place of each id among them, and their counts."""
    most = int(ids.max())
    if most < 1 << 22:
        counts = np.zeros(most + 1, np.int64)
        for part in _parts(ids):
            counts += np.bincount(part, minlength=most + 1)
        symbols = np.flatnonzero(counts)
        place = np.zeros(most + 1, _kind(len(symbols)))
        place[symbols] = np.arange(len(symbols))
        return symbols.astype(np.uint32), _looked_up(place, ids), counts[symbols]
    symbols, x, counts = np.unique(ids, return_inverse=True, return_counts=True)
    return symbols, x.astype(_kind(len(symbols))), counts


def _kind(n: int) -> type:
    """The numbers below n, and n itself."""
    return np.uint16 if n < 1 << 16 else np.uint32


def _parts(x: np.ndarray) -> list[np.ndarray]:
    """Numpy makes 64-bit copies of what it takes as places, so it gets a part at a time."""
    return [x[i : i + PART] for i in range(0, len(x), PART)]


def _looked_up(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    out = np.empty(len(at), values.dtype)
    for to, part in zip(_parts(out), _parts(at)):
        to[:] = values[part]
    return out


def _encode(table: Table, x: np.ndarray, size: int) -> list[bytes]:
    k = -(-len(x) // size)
    longest, last = min(size, len(x)), len(x) - (k - 1) * size
    x.resize(k * longest, refcheck=False)
    x = x.reshape(k, longest).T  # a row for each step
    lane4, none, total = np.arange(k) * 4, table.none, table.total
    shares, c1_of, c2_of = _Shares(k, table.bits), *_named(x, none)
    low, span = np.zeros(k, np.int64), np.full(k, (1 << 2 * DIGIT) - 1, np.int64)
    width = longest + 4
    out, at = np.zeros(k * width, np.uint32), np.arange(k) * width
    first = at.copy()
    most = min(INTERVAL, longest)
    digits, moved = np.empty((most, k), np.int64), np.empty((most, k), bool)
    for lo in range(0, longest, INTERVAL):
        own, c1, c2 = (np.ascontiguousarray(a[lo : lo + INTERVAL]) for a in (x, c1_of, c2_of))
        outcomes, j, is1, is2 = _outcomes(lane4, own, c1, c2, none)
        unit = shares.unit.take(j)
        cum, freq = table.cum.take(own), table.freq.take(own)
        cum *= unit
        freq *= unit
        n12 = shares.n12.take(j)
        cum += n12
        at1, at2 = np.flatnonzero(is1), np.flatnonzero(is2)
        n2 = shares.n2.take(j.ravel()[at1])
        cum.ravel()[at1], freq.ravel()[at1] = n2, n12.ravel()[at1] - n2
        cum.ravel()[at2], freq.ravel()[at2] = 0, shares.n2.take(j.ravel()[at2])
        shares.learn(outcomes.ravel())
        if lo + len(own) > last:  # the last block has ended: steps that say nothing
            cum[max(last - lo, 0) :, -1], freq[max(last - lo, 0) :, -1] = 0, 1 << total
        # Every lane's digit is put down at each step, and those that were moved out are picked after the last.
        for cum_, freq_, digit, full in zip(cum, freq, digits, moved):
            span >>= total
            cum_ *= span
            low += cum_
            span *= freq_
            np.less(span, LOW, out=full)
            np.right_shift(low, DIGIT, out=digit)
            shift = full.astype(np.int64)
            low -= (digit * shift) << DIGIT
            shift *= DIGIT
            low <<= shift
            span <<= shift
        picked = moved[: len(own)].T
        n = picked.sum(axis=1)
        place = np.repeat(at - np.cumsum(n) + n, n)
        place += np.arange(len(place))
        out[place] = digits[: len(own)].T[picked]
        at += n
    for _ in range(2):
        out[at] = low >> DIGIT
        at += 1
        low = (low & MASK) << DIGIT
    coded = []
    for j in range(k):
        digits = out[first[j] : at[j]]
        while (over := digits >> np.uint32(DIGIT)).any():  # carries
            digits = digits & np.uint32(MASK)
            digits[:-1] += over[1:]
        coded.append(digits.astype(">u4").view(np.uint8).reshape(-1, 4)[:, 1:].tobytes())
    return coded


def decode(head: bytes, coded: list[bytes], sizes: list[int]) -> np.ndarray:
    """The ids of the blocks that ``encode`` made, one after the other; sizes: ids in each block, the last may be shorter."""
    if not coded:
        return np.zeros(0, np.uint32)
    if any(n != sizes[0] for n in sizes[:-1]) or not 0 < sizes[-1] <= sizes[0]:
        raise ValueError("all blocks but the last must be of one size")
    head = zlib.decompress(head)
    halved, n = struct.unpack_from("<BI", head)
    if len(head) != 9 + 8 * n:
        raise ValueError("the table of frequencies is cut off")
    steps, first, freq = (np.frombuffer(head, "<u4", k, at) for k, at in ((n, 5), (1, 5 + 4 * n), (n, 9 + 4 * n)))
    table = Table((first + np.cumsum(steps)).astype(np.uint32), freq)
    x = _decode(table, coded, sizes[0] << halved)
    ids = _looked_up(table.symbols, x[: sum(sizes) << halved])
    return ids[::2] << np.uint32(16) | ids[1::2] if halved else ids


def _decode(table: Table, coded: list[bytes], longest: int) -> np.ndarray:
    k, none, total = len(coded), table.none, table.total
    width = max(map(len, coded)) // 3 + 2
    raw = np.zeros((k, width, 4), np.uint8)
    for j, c in enumerate(coded):
        raw[j, : len(c) // 3, 1:] = np.frombuffer(c, np.uint8).reshape(-1, 3)
    digits = raw.view(">u4").ravel().astype(float)
    del raw
    # The lane of a shorter last block reads on past its row, by a digit an id at most.
    digits, at = np.append(digits, np.zeros(longest)), np.arange(k) * width + 2
    # All numbers are below 2 ** 48 and so exact as doubles, which spares conversions.
    code = digits[at - 2] * LOW + digits[at - 1]
    span = np.full(k, float((1 << 2 * DIGIT) - 1))
    slot = np.repeat(np.arange(len(table.freq), dtype=_kind(none)), table.freq)
    shares, contexts, lane4 = _Shares(k, table.bits), _Contexts(k, none), np.arange(k) * 4
    out = np.empty((longest, k), _kind(none))
    ranges = np.stack([table.cum, table.freq], axis=1).astype(float)
    most, scale = float((1 << total) - 1), 0.5**total
    for lo in range(0, longest, INTERVAL):
        hi = min(lo + INTERVAL, longest)
        parts = np.stack([shares.n2, shares.n12, shares.unit, shares.n12 - shares.n2], axis=1).astype(float)
        named1, named2 = np.empty((2, hi - lo, k), out.dtype)
        for t in range(lo, hi):
            c1, c2 = named1[t - lo], named2[t - lo] = contexts.look()
            part = parts.take(_states(lane4, c1, c2, none), axis=0)
            n12, unit = part[:, 1], part[:, 2]
            span *= scale
            np.floor(span, out=span)
            # The division is exact enough: quotients lie 2 ** -26 apart from whole numbers.
            v = code / span
            np.minimum(v, most, out=v)
            np.floor(v, out=v)
            ahead = v - n12
            x = slot.take((ahead / unit).astype(np.int64), mode="clip")
            own = ranges.take(x, axis=0)
            cum, freq = own[:, 0] * unit, own[:, 1] * unit
            cum += n12
            named = (ahead < 0).nonzero()[0]
            if len(named):
                part = part.take(named, axis=0)
                n2 = part[:, 0]
                is2 = v.take(named) < n2
                cum[named] = np.where(is2, 0.0, n2)
                freq[named] = np.where(is2, n2, part[:, 3])
                x[named] = np.where(is2, c2.take(named), c1.take(named))
            cum *= span
            code -= cum
            span *= freq
            more = (span < LOW).nonzero()[0]
            place = at.take(more)
            code[more] = code.take(more) * LOW + digits.take(place)
            at[more] = place + 1
            span[more] = span.take(more) * LOW
            contexts.learn(x)
            out[t] = x
        shares.learn(_outcomes(lane4, out[lo:hi], named1, named2, none)[0].ravel())
    return out.T.ravel()
