"""An adaptive context-mixing range coder for token ids, many lanes of a block at a time.

A record is a run of blocks of at most ``BLOCK`` ids. Each block is coded from a reset
model and has its own checksum, so it can be read without any other. A block is cut into lanes that
go through numpy in step, one id of each lane at a time; all lanes share the block's model, which
learns their ids after each step, so it sees as much of the block as a single pass would.

For an id the model has three predictions: the id last seen after the same two ids
(order 2), the one last seen after the same id (order 1), each with a confidence, and a
distribution over all ids (order 0): the counts of the block's ids so far, with an escape to ids
not seen yet. Adaptive chances that a prediction holds, kept for each pair of confidences, mix the
three into one distribution of total ``TOTAL``, and a 64-bit range coder with carries spends its
code lengths.

A record in bytes, little-endian: ``b"FCM2"``; number of ids (u64); size of the vocabulary, ids per
block, number of blocks (u32 each); then the blocks. A block: number of ids, of lanes and of 16-bit
words, and the crc32 of its ids as u32 (u32 each); the number of words of each lane (u32); the words (u16).
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

MAGIC = b"FCM2"
#: Ids of a block, most lanes of a block, and least ids of a lane where there are several.
BLOCK, LANES, LANE_IDS = 1 << 21, 4096, 256
BITS = 32
TOTAL = 1 << BITS
#: Share of TOTAL that order 0 has at least, and bits of its scaled counts.
_FLOOR, _Q = 1 << 26, 17
#: What an id seen adds to its count; the escape's share, at least, of the scaled counts.
_SEEN, _ESCAPE = 4, 1 << 8
#: Slots of the order-2 table, most confidence, and steps between two scalings once the model is settled.
_SLOTS, _SURE, _EVERY = 1 << 18, 7, 16
_LOW_RANGE = np.uint64(1 << 48)
_FOUR, _U16, _U48, _UB = np.uint64(4), np.uint64(16), np.uint64(48), np.uint64(BITS)


class Model:
    """The adaptive model of one block whose ids are below ``size``."""

    def __init__(self, size: int) -> None:
        self.size = size
        # For each context the id last seen, times 8, plus its confidence.
        self._after1, self._after2 = np.zeros(size, np.int32), np.zeros(_SLOTS, np.int32)
        # How often, by event, predictions were made, order 2 held, and order 1 did where order 2 failed.
        self._made, self._held2, self._held1 = np.full(128, 4, np.int64), np.full(128, 2, np.int64), np.full(128, 1, np.int64)
        self._counts = np.zeros(size, np.int64)
        self._begin, self._end = np.zeros(size, np.int64), np.zeros(size, np.int64)
        self._steps, self._new, self._due = 0, [], 0
        self._mix()
        self._scale()

    def _mix(self) -> None:
        """The shares of TOTAL that orders 2 and 1 have in each event."""
        made, free = self._made + 2, TOTAL - _FLOOR
        self._share2 = free * self._held2 // made
        left = made - self._held2
        self._shares = self._share2 + (free - self._share2) * self._held1 // (left + 1)

    def _scale(self) -> None:
        """Scaled cumulative counts of the ids seen so far, and the id of each place of the scale."""
        if self._new:
            self._counts += _SEEN * np.bincount(np.concatenate(self._new), minlength=self.size)
            self._new = []
        seen = np.flatnonzero(self._counts)
        own, n = self._counts[seen], len(seen)
        # One place each, an escape by the number of novel ids there were, the rest by counts.
        self._escape = (1 << _Q) if not n else max(_ESCAPE, min((1 << _Q) // 4, (1 << _Q) * n // (int(own.sum()) // _SEEN + n)))
        width = own * ((1 << _Q) - self._escape - n) // max(int(own.sum()), 1) + 1
        ends = np.cumsum(width) + self._escape
        if n:
            width[-1] += (1 << _Q) - int(ends[-1])
            ends[-1] = 1 << _Q
        self._begin[seen], self._end[seen] = ends - width, ends
        self._of_place = np.concatenate([np.zeros(self._escape, np.uint32), np.repeat(seen.astype(np.uint32), width)])

    def predict(self, one: np.ndarray, two: np.ndarray) -> None:
        """Set the predictions for lanes whose last ids are ``one`` and, before that, ``two``."""
        self._at1, self._at2 = one, (one * 0x9E3779B1 ^ two * 0x85EBCA6B) >> 11 & (_SLOTS - 1)
        self._v1, self._v2 = self._after1[one], self._after2[self._at2]
        self.p1, self.p2 = self._v1 >> 3, self._v2 >> 3
        self._sure1, self._sure2 = self._v1 & 7, self._v2 & 7
        self._event = (self._sure2 << 4 | self._sure1 << 1 | (self.p1 == self.p2)).astype(np.int64)
        self.share2, self.shares = self._share2[self._event], self._shares[self._event]

    def spans(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Begin and length of the intervals of ``ids`` in TOTAL."""
        self._right2, self._right1 = ids == self.p2, ids == self.p1
        hit1 = self._right1 & ~self._right2
        start, length = self._predicted(hit1)
        miss = np.flatnonzero(~(self._right1 | self._right2))
        if len(miss):
            start[miss], length[miss] = self._rest_spans(ids[miss], self.shares[miss])
        self._hit1, self._missed = hit1, miss
        return start, length

    def _predicted(self, hit1: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The intervals of order 1 where it hits, else those of order 2."""
        start = self.share2 * hit1
        return start, self.share2 + (self.shares - 2 * self.share2) * hit1

    def _rest_spans(self, ids: np.ndarray, both: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        rest, end = TOTAL - both, self._end[ids]
        lo = rest * self._begin[ids] >> _Q
        length = (rest * end >> _Q) - lo
        novel = np.flatnonzero(end == 0)
        if len(novel):
            length[novel] = (rest[novel] * self._escape >> _Q) // self.size
            lo[novel] = ids[novel] * length[novel]
        return both + lo, length

    def find(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The ids whose intervals hold the points ``at``, and the intervals."""
        hit2, within = at < self.share2, at < self.shares
        hit1 = within & ~hit2
        start, length = self._predicted(hit1)
        ids = (self.p2 + (self.p1 - self.p2) * hit1).astype(np.int64)
        miss = np.flatnonzero(~within)
        if len(miss):
            both = self.shares[miss]
            rest, over = TOTAL - both, at[miss] - both
            # Both numbers are whole and below 2^53 and the quotient below 2^17, so that rounding reaches no whole number.
            place = ((((over + 1) << _Q) - 1) / rest).astype(np.int64)
            own = self._of_place[place].astype(np.int64)
            novel = np.flatnonzero(place < self._escape)
            if len(novel):
                each = (rest[novel] * self._escape >> _Q) // self.size
                own[novel] = np.minimum(over[novel] // each, self.size - 1)
            ids[miss] = own
            start[miss], length[miss] = self._rest_spans(own, both)
        self._right2, self._right1, self._hit1, self._missed = ids == self.p2, ids == self.p1, hit1, miss
        return ids, start, length

    @staticmethod
    def _learned(value: np.ndarray, sure: np.ndarray, right: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """A context's entry: surer where it was right, less sure or replaced where not."""
        out = value + (right & (sure < _SURE)) - (~right & (sure > 0))
        replaced = np.flatnonzero(~right & (sure == 0))
        out[replaced] = ids[replaced] << 3
        return out

    def update(self, ids: np.ndarray) -> None:
        """Learn that ``ids`` came."""
        self._after1[self._at1] = self._learned(self._v1, self._sure1, self._right1, ids)
        self._after2[self._at2] = self._learned(self._v2, self._sure2, self._right2, ids)
        # Where both orders have the id, order 2 takes it.
        events = np.bincount(self._event + (self._right2 * 128 + self._hit1 * 256), minlength=384).reshape(3, 128)
        self._made += events.sum(axis=0)
        self._held2 += events[1]
        self._held1 += events[2]
        if len(self._missed):
            self._new.append(ids[self._missed])
        self._steps = steps = self._steps + 1
        if steps < 8 or steps % 4 == 0:
            self._mix()
        if steps & (steps - 1) == 0 or steps % _EVERY == 0:
            self._scale()


def _lanes(n: int) -> tuple[int, int]:
    """``(lanes, steps)`` of a block of ``n`` ids."""
    lanes = max(1, min(LANES, n // LANE_IDS))
    return lanes, -(-n // lanes)


def _encode_block(ids: np.ndarray, size: int) -> bytes:
    n = len(ids)
    lanes, steps = _lanes(n)
    grid = np.zeros(lanes * steps, np.int64)
    grid[:n] = ids
    grid = np.ascontiguousarray(grid.reshape(lanes, steps).T)
    model = Model(size)
    low, span = np.zeros(lanes, np.uint64), np.full(lanes, 0xFFFFFFFFFFFFFFFF, np.uint64)
    out = np.zeros((lanes, 2 * steps + 8), np.uint16)
    flat, begins = out.reshape(-1), np.arange(lanes) * out.shape[1]
    at = begins.copy()
    one = two = np.zeros(lanes, np.int64)
    for now in grid:
        model.predict(one, two)
        start, length = model.spans(now)
        part = span >> _UB
        before = low
        low = low + part * start.view(np.uint64)
        span = part * length.view(np.uint64)
        carried = np.flatnonzero(low < before)
        if len(carried):
            last = at[carried] - 1
            while len(last):
                flat[last] += 1
                last = last[flat[last] == 0] - 1
        while (needed := span < _LOW_RANGE).any():
            # A word that is not needed is written over by the next.
            flat[at] = (low >> _U48).astype(np.uint16)
            at += needed
            shift = needed.astype(np.uint64) << _FOUR
            low <<= shift
            span <<= shift
        model.update(now)
        two, one = one, now
    for shift in (48, 32, 16, 0):
        flat[at] = (low >> np.uint64(shift)).astype(np.uint16)
        at += 1
    used = at - begins
    words = out[np.arange(out.shape[1])[None, :] < used[:, None]]
    head = struct.pack("<IIII", n, lanes, len(words), zlib.crc32(ids.astype("<u4").tobytes()))
    return head + used.astype("<u4").tobytes() + words.astype("<u2").tobytes()


def encode(ids: np.ndarray, size: int, block: int = BLOCK) -> bytes:
    """A record of ``ids``, each below ``size``."""
    parts = [_encode_block(ids[k : k + block], size) for k in range(0, len(ids), block)]
    return MAGIC + struct.pack("<QIII", len(ids), size, block, len(parts)) + b"".join(parts)


def _decode_block(words: np.ndarray, lengths: np.ndarray, n: int, size: int) -> np.ndarray:
    lanes = len(lengths)
    steps = -(-n // lanes)
    ends = np.cumsum(lengths.astype(np.int64))
    at = ends - lengths
    words = np.append(words, np.zeros(8, np.uint16)).astype(np.uint64)
    grid = np.zeros((steps, lanes), np.int64)
    model = Model(size)
    code = words[at] << _U48 | words[at + 1] << np.uint64(32) | words[at + 2] << _U16 | words[at + 3]
    at, last = at + 4, len(words) - 1
    span = np.full(lanes, 0xFFFFFFFFFFFFFFFF, np.uint64)
    top = np.uint64(TOTAL - 1)
    one = two = np.zeros(lanes, np.int64)
    for t in range(steps):
        model.predict(one, two)
        part = span >> _UB
        ids, start, length = model.find(np.minimum(code // part, top).view(np.int64))
        code = code - part * start.view(np.uint64)
        span = part * length.view(np.uint64)
        while (needed := span < _LOW_RANGE).any():
            one_if = needed.astype(np.uint64)
            shift = one_if << _FOUR
            code = code << shift | words[np.minimum(at, last)] * one_if
            span <<= shift
            at += needed
        grid[t] = ids
        model.update(ids)
        two, one = one, ids
    return grid.T.ravel()[:n].astype("<u4")


def decode(record: bytes) -> np.ndarray:
    """The ids of a record; ``ValueError`` if it is not whole."""
    if record[:4] != MAGIC or len(record) < 24:
        raise ValueError("not a record of token ids")
    n, size, _, blocks = struct.unpack_from("<QIII", record, 4)
    out, at = [np.zeros(0, "<u4")], 24
    for k in range(blocks):
        if at + 16 > len(record):
            raise ValueError("a record of token ids is cut off")
        own, lanes, count, crc = struct.unpack_from("<IIII", record, at)
        end = at + 16 + 4 * lanes + 2 * count
        if end > len(record) or not 0 < lanes <= own:
            raise ValueError("a record of token ids is cut off")
        lengths = np.frombuffer(record, "<u4", lanes, at + 16)
        if int(lengths.sum()) != count or int(lengths.min()) < 4:
            raise ValueError(f"block {k} of a record of token ids is damaged")
        ids = _decode_block(np.frombuffer(record, "<u2", count, at + 16 + 4 * lanes), lengths, own, size)
        if zlib.crc32(ids.tobytes()) != crc:
            raise ValueError(f"block {k} of a record of token ids has a wrong checksum")
        out.append(ids)
        at = end
    if at != len(record) or sum(map(len, out)) != n:
        raise ValueError("a record of token ids is cut off")
    return np.concatenate(out)
