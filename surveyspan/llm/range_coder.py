"""An adaptive range coder for token ids that works on many independent blocks in step.

Every block starts from nothing and carries its own checksum. At each id three predictions are mixed:

* order 2: the id that last followed the same two ids (by a hashed context),
* order 1: the id that last followed the same id,
* order 0: the distribution of the block's ids so far, taken over at steps 64, 128, 256 and so on;

what none of them foresees is escaped and coded evenly, in 16 bits. The predictions share the unit interval by weights that follow
their recent success in the block; an id is coded in the highest order that predicts it. The coder has a 48-bit interval, 16-bit
output units and frequencies that sum to 2^16; a block's payload is its units in order and, from its end backwards, its escaped ids.

All blocks of a batch are one numpy vector, so a step of the coder is a handful of vector operations and the time per id falls
with the number of blocks. An interval of at least 2^32 leaves every frequency 2^16 at least, so an id makes one unit at most. The encoder leaves
carries in the units until the end; the decoder needs only how far the code lies above the interval's low end, and
as every number stays below 2^53 it reckons in doubles without rounding.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np

BLOCK = 4096
#: Longest block that positions and shares of the interval have room for.
LONGEST = 1 << 15
MAGIC = b"CMR2"
_SEGMENT = 64
# Blocks that are sorted together, for the processor's caches.
_SORTED = 32
_TOTAL = 1 << 16
_LEAST = 16
_SLOTS = 1 << 12
_U = np.uint64
_S16, _S32, _LOW32 = _U(16), _U(32), _U((1 << 32) - 1)
_WHOLE, _NARROW, _UNIT = 1 << 48, 1 << 32, 1 << 16


def _slot1(a: np.ndarray) -> np.ndarray:
    return (a * np.uint16(40503)) >> np.uint16(4)


def _slot2(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a * np.uint16(31153) + b * np.uint16(58967)) >> np.uint16(4)


def _foreseen(ids: np.ndarray, slots: np.ndarray) -> np.ndarray:
    """Step by block: whether an id is the one at the last earlier position with the same slot, or 0 if there is none."""
    blocks, steps = ids.shape
    key = slots.astype(_U) << _S32
    key |= np.arange(steps, dtype=_U) << _S16
    key |= ids
    key.sort(axis=1)
    value = key.astype(np.uint16)
    key >>= _S16
    at = (key & _U(0xFFFF)).view(np.int64)
    hit = value == 0
    slot = (key >> _S16).astype(np.uint16)
    same = slot[:, 1:] == slot[:, :-1]
    hit[:, 1:] &= ~same
    hit[:, 1:] |= same & (value[:, 1:] == value[:, :-1])
    at *= blocks
    at += np.arange(blocks)[:, None]
    out = np.empty(steps * blocks, bool)
    out[at] = hit
    return out.reshape(steps, blocks)


def _history_ranks(ids: np.ndarray) -> np.ndarray:
    """Step by block: how many ids of the history then in use are smaller than the id, and (<< 16) not larger."""
    blocks, steps = ids.shape
    out = np.zeros(steps * blocks, np.int32)
    key = ids.astype(np.uint32) << np.uint32(16)
    key |= np.arange(steps, dtype=np.uint32)
    key.sort(axis=1)
    cuts = _history_steps(steps)
    for a, b in zip(cuts[::-1], [steps, *cuts[:0:-1]], strict=False):
        place = key.astype(np.uint16)
        if key.shape[1] > b:
            key = key[place < b].reshape(blocks, b)
            place = key.astype(np.uint16)
        value = (key >> np.uint32(16)).astype(np.uint16)
        old = place < a
        # equal ids of the history come first, so the count at a later id covers all of them
        upto = np.cumsum(old, axis=1, dtype=np.int32)
        below = upto - old
        below[:, 1:] *= value[:, 1:] != value[:, :-1]
        np.maximum.accumulate(below, axis=1, out=below)
        upto <<= 16
        upto |= below
        later = np.flatnonzero(~old)
        at = place.take(later).astype(np.intp)
        at *= blocks
        at += np.repeat(np.arange(blocks), b - a)
        out[at] = upto.take(later)
    return out.reshape(steps, blocks)


class _Weights:
    """Shares of the four outcomes per block: order 2, order 1, order 0, escape."""

    def __init__(self, blocks: int) -> None:
        self.hits = np.zeros((4, blocks), np.int64)

    def frequencies(self, has_history: bool) -> np.ndarray:
        """Start of each outcome's part of the interval, five rows of int64, from 0 to the total."""
        own = self.hits + 1
        freq = _LEAST + (_TOTAL - 4 * _LEAST) * own // own.sum(0)
        if not has_history:
            freq[2] = 0
        freq[3] = _TOTAL - freq[:3].sum(0)
        return np.concatenate([np.zeros((1, freq.shape[1]), np.int64), np.cumsum(freq, axis=0)])

    def add(self, seen: list[np.ndarray]) -> None:
        """Takes over a segment, given as where each outcome occurred, step by block."""
        self.hits += np.stack([s.view(np.uint8).sum(0, dtype=np.uint8) for s in seen])
        self.hits -= self.hits >> 2


def _history_steps(n: int) -> list[int]:
    """Steps at which order 0 takes over what has been coded so far."""
    out, step = [], _SEGMENT
    while step < n:
        out.append(step)
        step *= 2
    return out


def _spans(lengths: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """First step, end and number of blocks of each stretch within a segment in which no block ends; the longest come first."""
    steps = int(lengths[0])
    a = 0
    for b in np.unique(np.append(lengths, np.arange(_SEGMENT, steps, _SEGMENT))).tolist():
        if b:
            yield a, b, int(np.count_nonzero(lengths > a))
            a = b


def _plan(ids: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Interval start and width of every id and whether it is escaped, step by block."""
    blocks, steps = ids.shape
    by2, by1, ranks = np.empty((steps, blocks), bool), np.empty((steps, blocks), bool), np.empty((steps, blocks), np.int32)
    for g in range(0, blocks, _SORTED):
        own = ids[g : g + _SORTED]
        one, two = np.zeros_like(own), np.zeros_like(own)
        one[:, 1:], two[:, 2:] = own[:, :-1], own[:, :-2]
        by2[:, g : g + _SORTED], by1[:, g : g + _SORTED] = _foreseen(own, _slot2(one, two)), _foreseen(own, _slot1(one))
        ranks[:, g : g + _SORTED] = _history_ranks(own)
    cuts = _history_steps(steps)
    start, freq = np.empty((steps, blocks), np.uint16), np.empty((steps, blocks), np.uint16)
    escaped = np.empty((steps, blocks), bool)
    weights, taken, four = _Weights(blocks), 0, 4 * np.arange(blocks)
    for a in range(0, steps, _SEGMENT):
        b = min(steps, a + _SEGMENT)
        if a in cuts:
            taken = a
        bound = weights.frequencies(taken > 0).astype(np.int32)
        part = np.diff(bound, axis=0)
        shift = max(0, taken.bit_length() - 1)  # the history's length is a power of two
        is2 = by2[a:b]
        is1 = by1[a:b] & ~is2
        low0 = (part[2] * (ranks[a:b] & 0xFFFF)) >> shift
        wide0 = ((part[2] * (ranks[a:b] >> 16)) >> shift) - low0
        is0 = (wide0 > 0) & ~(is2 | is1)
        esc = ~(is2 | is1 | is0)
        low0 += bound[2]
        kind = four + (is1.view(np.int8) + 2 * is0.view(np.int8) + 3 * esc.view(np.int8))
        start[a:b] = np.where(is0, low0, bound[:4].T.ravel().take(kind))
        freq[a:b] = np.where(is0, wide0, part.T.ravel().take(kind))
        seen = [is2, is1, is0, esc]
        if lengths[-1] < b:
            live = np.arange(a, b)[:, None] < lengths
            seen = [m & live for m in seen]
        escaped[a:b] = seen[3]
        weights.add(seen)
    return start, freq, escaped


def _encode(ids: np.ndarray, lengths: np.ndarray, group: int = 256) -> list[bytes]:
    """Payload of each row of ``ids`` (uint16, padded); rows come longest first."""
    blocks, steps = ids.shape
    start, freq = np.empty((steps, blocks), np.uint16), np.empty((steps, blocks), np.uint16)
    escaped = np.empty((steps, blocks), bool)
    for g in range(0, blocks, group):
        start[:, g : g + group], freq[:, g : g + group], escaped[:, g : g + group] = _plan(ids[g : g + group], lengths[g : g + group])
    low, width = np.zeros(blocks, _U), np.full(blocks, _WHOLE, _U)
    # a unit may hold a carry in its bit 16
    units = np.zeros(blocks * (steps + 3), np.uint32)
    first = np.arange(blocks) * (steps + 3)
    at = first.copy()
    for a, b, n in _spans(lengths):
        own_low, own_width = low[:n], width[:n]
        for t in range(a, b):
            step = own_width >> _S16
            own_low += step * start[t, :n]
            np.multiply(step, freq[t, :n], out=own_width)
            need = (own_width < _NARROW).nonzero()[0]
            old, place = own_low[need], at[need]
            units[place] = old >> _S32
            at[need] = place + 1
            own_low[need] = (old & _LOW32) << _S16
            own_width[need] = own_width[need] << _S16
    for shift in (32, 16, 0):
        units[at] = (low >> _U(shift)) & _U(0xFFFF if shift < 32 else 0x1FFFF)
        at += 1
    # the first unit of a block has no carry, so none reaches another block
    over = np.flatnonzero(units >> np.uint32(16))
    while len(over):
        units[over] &= np.uint32(0xFFFF)
        over -= 1
        units[over] += np.uint32(1)
        over = over[units[over] > 0xFFFF]
    raw = np.ascontiguousarray(escaped.T)
    coded = units.astype("<u2")
    cuts = zip(first.tolist(), at.tolist(), ids, raw, strict=True)
    return [coded[a:b].tobytes() + x[e][::-1].astype("<u2").tobytes() for a, b, x, e in cuts]


def _history(ids: np.ndarray) -> np.ndarray:
    """Of each place in the sorted ids of each block (step by block): the id, its first place << 16 and the place after its last << 32."""
    steps, blocks = ids.shape
    known = np.sort(ids.T.astype(np.uint32, order="C"), axis=1)
    change = np.ones((blocks, steps), bool)
    change[:, 1:] = known[:, 1:] != known[:, :-1]
    begin = np.flatnonzero(change)
    copies = np.diff(begin, append=blocks * steps)
    first = begin % steps
    return np.repeat(known.ravel()[begin] | first << 16 | (first + copies) << 32, copies)


def _decode(payloads: list[bytes], lengths: np.ndarray) -> np.ndarray:
    """Ids (step by block) of payloads whose lengths come longest first."""
    blocks, steps = len(payloads), int(lengths[0]) if len(lengths) else 0
    ids = np.zeros((steps, blocks), np.uint16)
    if not steps:
        return ids
    # a damaged block may ask for more on either side
    sizes = np.array([len(p) // 2 for p in payloads], np.int64)
    total, room = int(sizes.sum()), steps + 3
    units = np.zeros(total + 2 * room, np.uint16)
    units[room : room + total] = np.frombuffer(b"".join(payloads), "<u2")
    back = room + np.cumsum(sizes) - 1
    at = back + 1 - sizes
    rest, width = np.zeros(blocks), np.full(blocks, float(_WHOLE))
    for _ in range(3):
        rest = rest * _UNIT + units[at]
        at += 1
    lanes = np.arange(blocks)
    # the last follower in each block of each slot, for order 1 and then for order 2
    size = np.int64(blocks)
    followers = np.zeros(2 * blocks * _SLOTS, np.uint16)
    one = two = np.zeros(blocks, np.uint16)
    cuts, taken, history = set(_history_steps(steps)), 0, None
    weights, outcome = _Weights(blocks), np.full((_SEGMENT, blocks), 4, np.int8)
    for a, b, n in _spans(lengths):
        if a % _SEGMENT == 0:
            if a:
                weights.add([outcome == k for k in range(4)])
                outcome[:] = 4
            if a in cuts:
                taken, history = a, _history(ids[:a])
            bound = weights.frequencies(taken > 0).astype(np.float64)
            starts, freqs = bound[:4].T.ravel(), np.diff(bound, axis=0).T.ravel()
        rest, width, one, two, at, back = (x[:n] for x in (rest, width, one, two, at, back))
        lane1, four = lanes[:n], 4 * lanes[:n]
        lane2 = lane1 + _SLOTS * blocks
        bound1, bound2, bound3 = bound[1, :n], bound[2, :n], bound[3, :n]
        for t in range(a, b):
            step = np.floor(width * (1 / _UNIT))
            value = rest / step
            not2, not1, none = value >= bound1, value >= bound2, value >= bound3
            kind = not2.view(np.int8) + not1.view(np.int8) + none.view(np.int8)
            outcome[t % _SEGMENT, :n] = kind
            part = four + kind
            start, freq = starts.take(part), freqs.take(part)
            at1, at2 = _slot1(one) * size, _slot2(one, two) * size
            at1 += lane1
            at2 += lane2
            found = followers.take(np.where(not2, at1, at2))
            if taken:
                zero = (not1 != none).nonzero()[0]
                if len(zero):
                    own, begin = freq[zero], start[zero]
                    k = ((np.floor(value[zero]) - begin + 1) * taken - 1) / own
                    entry = history.take(zero * taken + k.astype(np.intp))
                    found[zero] = entry.astype(np.uint16)
                    own *= 1 / taken
                    low = np.floor(own * ((entry >> 16) & 0xFFFF))
                    freq[zero] = np.floor(own * (entry >> 32)) - low
                    start[zero] = begin + low
            raw = none.nonzero()[0]
            if len(raw):
                place = back[raw]
                found[raw] = units.take(place)
                back[raw] = place - 1
            rest -= start * step
            np.multiply(step, freq, out=width)
            need = (width < _NARROW).nonzero()[0]
            place = at[need]
            rest[need] = rest[need] * _UNIT + units.take(place)
            at[need] = place + 1
            width[need] *= _UNIT
            ids[t, :n] = found
            followers[at1] = found
            followers[at2] = found
            two, one = one, found
    return ids


def pack_blocks(ids: np.ndarray, block: int = BLOCK) -> bytes:
    """One frame: ids (all below 2^16) in independent blocks. Header: magic, block count, per block ids, units, checksum."""
    if block > LONGEST:
        raise ValueError(f"a block holds {LONGEST} ids at most")
    cuts = [ids[a : a + block].astype("<u2") for a in range(0, len(ids), block)]
    lengths = np.array([len(c) for c in cuts], np.int64)  # only the last one is shorter
    padded = np.zeros((len(cuts), int(lengths.max()) if len(cuts) else 0), np.uint16)
    for row, c in zip(padded, cuts, strict=True):
        row[: len(c)] = c
    payloads = _encode(padded, lengths) if cuts else []
    head = b"".join(struct.pack("<III", len(c), len(p) // 2, zlib.crc32(c.tobytes())) for c, p in zip(cuts, payloads, strict=True))
    return MAGIC + struct.pack("<I", len(cuts)) + head + b"".join(payloads)


def unpack_blocks(frames: list[bytes]) -> list[np.ndarray]:
    """Ids of each frame. All blocks of all frames are decoded in step; a block that fails its checksum raises."""
    heads, payloads, owners = [], [], []
    for f, frame in enumerate(frames):
        if frame[:4] != MAGIC:
            raise ValueError("not a frame of coded ids")
        (count,) = struct.unpack_from("<I", frame, 4)
        at = 8 + 12 * count
        for k in range(count):
            n, units, crc = struct.unpack_from("<III", frame, 8 + 12 * k)
            payloads.append(frame[at : at + 2 * units])
            heads.append((n, crc))
            owners.append(f)
            at += 2 * units
    lengths = np.array([n for n, _ in heads], np.int64)
    order = np.argsort(-lengths, kind="stable")
    ids = _decode([payloads[i] for i in order], lengths[order])
    columns = np.ascontiguousarray(ids.T)
    back = np.empty(len(order), np.int64)
    back[order] = np.arange(len(order))
    parts: list[list[np.ndarray]] = [[] for _ in frames]
    for i, ((n, crc), owner) in enumerate(zip(heads, owners, strict=True)):
        own = columns[back[i], :n].astype("<u2")
        if zlib.crc32(own.tobytes()) != crc:
            raise ValueError(f"block {i} fails its checksum")
        parts[owner].append(own)
    return [np.concatenate(p) if p else np.zeros(0, "<u2") for p in parts]
