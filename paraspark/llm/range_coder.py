"""Adaptive context-mixing range coder for token ids, many lanes at a time.

A block is a list of ids with nothing carried over from other blocks: its
sorted distinct ids, then one coded step per id over their ranks. Three models
predict the next rank and are mixed into one distribution:

* order 2: the rank last seen after the two ranks before, with a confidence;
* order 1: the rank last seen after the rank before, with a confidence;
* order 0: counts of the block so far.

The weights of the three are what the block has shown so far for the pair of
confidences (and whether both orders agree). Last-seen ranks adapt with every
step, weights and counts on a fixed schedule of steps.

A block is cut into lanes of consecutive ids (``_steps``), which share the
block's models: a step predicts and codes the next id of every lane as numpy
vectors, and all of them are learnt from before the next step. Blocks of one
batch go through the same steps with models of their own, so a block decodes
the same in whatever company; all arithmetic is on integers. The intervals are range-coded by asymmetric numeral systems (rANS): one
64-bit state a lane, last id first, so that reading starts with the first.

Layout of a block: magic, number of ids, of distinct ids and of code words,
crc32 of the ids, crc32 of what follows; the distinct ids as byte-wise gaps;
each lane's number of 32-bit code words (16 bits), each lane's 64-bit state,
the code words lane by lane. All numbers little-endian.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

MAGIC = b"ACM2"
HEADER = struct.Struct("<4sIIIII")
_MIX = 12                        # bits of the mixing weights
_MAX_ORDER0 = 20                 # bits of the order-0 distribution, at most
_MAX_SLOTS = 1 << 18             # order-2 contexts per block, at most
_NONE = 1 << 22                  # rank that no id has
_STATES = 512                    # states of a step: see _Model
_REST = 64                       # least weight of order 0
STEPS = 512                      # ids of a lane, at most
LANES = 2048                     # blocks coded side by side at most
CELLS = 1 << 20                  # blocks of a batch times the longest of them, at most (a block beyond it is coded alone)
_EVERY = 32
_A, _B, _SHIFT = np.uint32(0x9E3779B1), np.uint32(0x85EBCA6B), np.uint32(13)
_1, _2, _9, _C1, _C2 = np.uint8(1), np.uint8(2), np.uint32(9), np.uint32(7 << 3), np.uint32(7 << 6)
_U32, _LOWER = np.uint64(32), np.uint64(1 << 32)


def _steps(n: int) -> int:
    """Ids of each lane (the last may have fewer) of a block of ``n`` ids."""
    return min(STEPS, max(16, n // 64))


def _due(step: int) -> bool:
    """Whether counts and weights are refreshed after ``step`` steps."""
    return step % _EVERY == 0 or step < _EVERY and (step & (step - 1) == 0 or step % 3 == 0 and (step // 3) & (step // 3 - 1) == 0)


def _next(confidence: np.ndarray, hit: np.ndarray) -> np.ndarray:
    """Confidence after a step: one more for a hit, down for a miss (whose rank
    replaces the one that was expected)."""
    return np.where(hit, np.minimum(confidence + 1, 7), np.maximum(confidence >> 1, 1)).astype(np.uint32)


_state = np.arange(_STATES)
_NEXT2 = _next(_state >> 6, _state & 3 == 1) << np.uint32(6)
_NEXT1 = _next(_state >> 3 & 7, (_state & 3 == 2) | (_state & 7 == 5)) << np.uint32(3)


class _Lanes:
    """Lanes of a batch's blocks, longest first; within a block in order."""

    def __init__(self, lengths: list[int]):
        steps = [_steps(n) for n in lengths]
        self.count = np.array([-(-n // s) for n, s in zip(lengths, steps)])
        block = np.repeat(np.arange(len(lengths)), self.count)
        size = np.array(steps)[block]
        ends = np.cumsum(self.count) - 1
        size[ends] = np.array(lengths) - (self.count - 1) * np.array(steps)
        self.order = np.argsort(-size, kind="stable")
        self.block, self.size = block[self.order], size[self.order]
        self.longest = int(self.size[0])
        self.live = np.searchsorted(-self.size, -np.arange(self.longest), "left").tolist()  # lanes longer than t
        self.first = np.concatenate(([0], np.cumsum(self.count)))
        self.steps = steps

    def columns(self, block: int) -> np.ndarray:
        """Where the block's lanes stand."""
        if not hasattr(self, "_at"):
            self._at = np.empty(len(self.order), np.int64)
            self._at[self.order] = np.arange(len(self.order))
        return self._at[self.first[block]:self.first[block + 1]]


class _Model:
    """Predictions for all lanes. Ranks count through the batch: block ``b``
    has ``size[b]`` of them.

    An entry of the last-seen tables is a rank above 9 bits that hold its
    confidence where the state has it: a state is the confidences of order 2
    (bits 6 to 8) and order 1 (3 to 5), whether both agree (bit 2) and what
    then came: order 2's rank (1), order 1's alone (2) or another one (0)."""

    def __init__(self, lanes: _Lanes, size: np.ndarray, lengths: list[int], inverse: bool):
        if size.max() >= 1 << _MAX_ORDER0:
            raise ValueError("too many distinct ids in a block")
        bits = np.array([min(_MAX_ORDER0, max(10, int(v).bit_length() + 2)) for v in size])
        slots = np.array([min(_MAX_SLOTS, 1 << max(4, int(n - 1).bit_length())) for n in lengths])
        self.lanes, self.size, self.inverse, self.block_bits = lanes, size, inverse, bits
        self.first = np.cumsum(size) - size
        self.total, self.lift = 1 << bits, np.cumsum(1 << bits) - (1 << bits)
        of, n, u = lanes.block, int(size.sum()), np.uint32
        per_lane = (self.first, np.cumsum(slots) - slots, slots - 1, bits, n + np.arange(len(size)), self.lift, np.arange(len(size)) * _STATES)
        # lanes of a lone block share these numbers
        self.alone = len(size) == 1
        self.per_lane = [u(v[0]) if self.alone else v.astype(u)[of] for v in per_lane]
        self.one, self.two = np.full(n, _NONE << 9, u), np.full(int(slots.sum()), _NONE << 9, u)
        self.count, self.seen = np.zeros(n, np.int64), np.zeros(len(size) * _STATES, np.int64)
        self.events = np.zeros((_EVERY, len(of)), u)
        self.p1, self.p2 = self.first.astype(u)[of], np.zeros(len(of), u)
        self.step = self.fresh_from = 0
        self.refresh(None)

    def of(self, live: int):
        return self.per_lane if self.alone else [v[:live] for v in self.per_lane]

    def refresh(self, ranks):
        """Counts and weights from the steps since the last time."""
        if ranks is not None:
            live = self.lanes.live
            rows = range(self.fresh_from, self.step)
            self.count += np.bincount(np.concatenate([ranks[t, :live[t]] for t in rows]), minlength=len(self.count))
            self.seen += np.bincount(np.concatenate([self.events[t - self.fresh_from, :live[t]] for t in rows]), minlength=len(self.seen))
            self.fresh_from = self.step
        coded = np.add.reduceat(self.count, self.first)
        scale = np.where(coded > 0, ((self.total - self.size) << 16) // np.maximum(coded, 1), 0)
        f = ((self.count * np.repeat(scale, self.size)) >> 16) + np.repeat(np.where(coded > 0, 1, self.total // self.size), self.size)
        # what rounding leaves goes to the block's last rank
        f[self.first + self.size - 1] += self.total - np.add.reduceat(f, self.first)
        # after the ranks, a whole order-0 range per block: orders 1 and 2 take it
        self.width0 = np.concatenate((f, self.total)).astype(np.uint32)
        self.start0 = np.concatenate((np.cumsum(f) - f - np.repeat(self.lift, self.size), 0 * self.lift)).astype(np.uint32)
        if self.inverse:
            self.rank_at = np.repeat(np.arange(len(f), dtype=np.uint32), f)
        s = self.seen.reshape(-1, _STATES // 4, 4)
        most, state = (1 << _MIX) - _REST, np.arange(_STATES // 4) << 2
        n = s.sum(2) + 8
        m2 = np.where(state >> 6 > 0, np.maximum((s[:, :, 1] + 3) * most // n, 1), 0)
        m1 = np.where((state >> 3 & 7 > 0) & (state & 4 == 0), np.maximum((s[:, :, 2] + 2) * most // n, 1), 0)
        bits = self.block_bits[:, None]
        zero = 0 * m1
        self.low = (np.stack((m1 + m2, zero, m2, zero), 2) << bits[:, :, None]).astype(np.uint32).reshape(-1)
        self.unit = np.stack(((1 << _MIX) - m1 - m2, m2, m1, zero), 2).astype(np.uint32).reshape(-1)
        self.seen -= self.seen >> 4              # older steps fade

    def predict(self, live: int):
        self.now = first, at2, mask2, bits, whole, lift, states = self.of(live)
        p1 = self.p1[:live]
        own = p1 if self.alone else p1 - first
        h = own * _A
        h += self.p2[:live]
        h >>= _SHIFT
        h &= mask2
        h += at2
        self.p2 = own * _B
        self.s2, self.s1 = h.astype(np.intp), p1.astype(np.intp)
        e2, e1 = self.two.take(self.s2), self.one.take(self.s1)
        self.q2, self.q1 = e2 >> _9, e1 >> _9
        e2 &= _C2
        e1 &= _C1
        e2 |= e1
        agree = (self.q1 == self.q2).view(np.uint8) << _2
        e2 |= agree
        self.state = e2

    def find(self, v):
        """The rank whose interval holds ``v``, and which order gave it."""
        _, _, _, bits, _, lift, states = self.now
        at = (self.state if self.alone else self.state + states).astype(np.intp)
        m12, m0 = self.low.take(at), self.unit.take(at)
        at += 1
        hit2, known = v >> bits < self.unit.take(at), v < m12
        c = v - m12
        c //= m0
        c *= ~known
        if not self.alone:
            c += lift
        rank = self.rank_at.take(c)
        rank += (self.q1 - rank) * known
        rank += (self.q2 - rank) * hit2
        return rank, hit2, known > hit2

    def interval(self, rank, hit2, hit1):
        """Start and width of each lane's rank in the mixed distribution."""
        _, _, _, _, whole, _, states = self.now
        state = self.state
        state += hit2
        state += hit1.view(np.uint8) << _1
        at = (state if self.alone else state + states).astype(np.intp)
        low, unit = self.low.take(at), self.unit.take(at)
        known = rank - whole
        known *= ~(hit2 | hit1)
        known += whole
        known = known.astype(np.intp)
        start, width = self.start0.take(known), self.width0.take(known)
        start *= unit
        start += low
        width *= unit
        self.events[self.step - self.fresh_from, :len(rank)] = at
        return start, width

    def learn(self, rank, ranks):
        state = self.state.astype(np.intp)
        fresh = rank << _9
        self.two[self.s2] = fresh + _NEXT2.take(state)
        self.one[self.s1] = fresh + _NEXT1.take(state)
        self.p1 = rank
        self.step += 1
        if _due(self.step):
            self.refresh(ranks)


def _gaps(distinct: np.ndarray) -> bytes:
    """Ascending ids as gaps: one byte each, 255 meaning 255 and go on."""
    gap = np.diff(distinct.astype(np.int64), prepend=-1) - 1
    more = gap // 255
    out = np.full(int((more + 1).sum()), 255, np.uint8)
    out[np.cumsum(more + 1) - 1] = gap % 255
    return out.tobytes()


def _distinct(data: np.ndarray, n: int) -> tuple[np.ndarray, int]:
    """The first ``n`` ids written by ``_gaps`` and the bytes they take."""
    ends = np.flatnonzero(data != 255)[:n]
    total = np.cumsum(data[:ends[-1] + 1].astype(np.int64)) if n else np.empty(0, np.int64)
    return total[ends] + np.arange(n), (int(ends[-1]) + 1 if n else 0)


def _ranks(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct ids, and each id's rank among them."""
    top = int(ids.max())
    if top > 8 * len(ids):
        return np.unique(ids, return_inverse=True)
    seen = np.zeros(top + 1, bool)
    seen[ids] = True
    return np.flatnonzero(seen), (np.cumsum(seen, dtype=np.uint32) - np.uint32(1)).take(ids)


def _order(lengths: list[int]) -> np.ndarray:
    return np.argsort(-np.asarray(lengths), kind="stable")


def _batches(lengths: list[int]) -> list[list[int]]:
    """Numbers of the blocks coded side by side: of like length, so that a long
    block makes no wide matrix of short ones."""
    out: list[list[int]] = []
    longest = 0
    for i in _order(lengths).tolist():
        n = lengths[i]
        if out and 2 * n >= longest and len(out[-1]) < LANES and (len(out[-1]) + 1) * longest <= CELLS:
            out[-1].append(i)
        else:
            out.append([i])
            longest = n
    return out


def _in_batches(code, blocks: list, lengths: list[int]) -> list:
    done: list = [None] * len(blocks)
    for batch in _batches(lengths):
        for i, d in zip(batch, code([blocks[i] for i in batch])):
            done[i] = d
    return done


def encode_blocks(blocks: list[np.ndarray]) -> list[bytes]:
    """Each block of ids (none empty) as one self-contained byte string."""
    return _in_batches(_encode, blocks, [len(b) for b in blocks])


def _encode(blocks: list[np.ndarray]) -> list[bytes]:
    lengths = [len(b) for b in blocks]
    lanes = _Lanes(lengths)
    k = len(lanes.block)
    distinct = []
    ranks = np.zeros((lanes.longest, k), np.uint32)
    first = 0
    for i, b in enumerate(blocks):
        d, r = _ranks(b)
        steps, count = lanes.steps[i], int(lanes.count[i])
        padded = np.zeros(steps * count, np.uint32)
        padded[:len(r)] = r
        padded[:len(r)] += np.uint32(first)
        at = min(steps, lanes.longest)  # one short lane has fewer ids than its steps
        ranks[:at, lanes.columns(i)] = padded.reshape(count, steps).T[:at]
        distinct.append(d)
        first += len(d)
    m = _Model(lanes, np.array([len(d) for d in distinct]), lengths, False)
    starts, widths = np.zeros(ranks.shape, np.uint32), np.ones(ranks.shape, np.uint32)
    for t, live in enumerate(lanes.live):
        rank = ranks[t, :live]
        m.predict(live)
        hit2 = rank == m.q2
        hit1 = (rank == m.q1) > hit2
        starts[t, :live], widths[t, :live] = m.interval(rank, hit2, hit1)
        m.learn(rank, ranks)
    total = (m.block_bits + _MIX).astype(np.uint64)[lanes.block]
    room = np.uint64(64) - total
    state, pos = np.full(k, _LOWER), np.zeros(k, np.int64)
    words = np.zeros(ranks.shape, np.uint32)
    flat = words.reshape(-1)
    for t in range(lanes.longest - 1, -1, -1):
        live = lanes.live[t]
        x, w = state[:live], widths[t, :live].astype(np.uint64)
        at = np.flatnonzero((x >> room[:live]) >= w)
        if len(at):
            full = x[at]
            p = pos[at]
            flat[p * k + at] = full.astype(np.uint32)
            pos[at] = p + 1
            x[at] = full >> _U32
        q = x // w
        x -= q * w
        q <<= total[:live]
        x += q
        x += starts[t, :live]
    done: list = []
    for i, b in enumerate(blocks):
        at = lanes.columns(i)
        used = pos[at]
        most = int(used.max())
        body = b"".join((_gaps(distinct[i]), used.astype("<u2").tobytes(), state[at].astype("<u8").tobytes(),
                         words[:most, at].T[np.arange(most) < used[:, None]].astype("<u4").tobytes()))
        ids = zlib.crc32(b.astype("<u4").tobytes())
        done.append(HEADER.pack(MAGIC, len(b), len(distinct[i]), int(used.sum()), ids, zlib.crc32(body)) + body)
    return done


def decode_blocks(data: list[bytes]) -> list[np.ndarray]:
    """The ids of each block; raises ``ValueError`` where a checksum fails."""
    return _in_batches(_decode, data, [HEADER.unpack_from(d)[1] for d in data])


def _decode(data: list[bytes]) -> list[np.ndarray]:
    heads = []
    for d in data:
        magic, n, size, words, ids_crc, body_crc = HEADER.unpack_from(d)
        if magic != MAGIC or zlib.crc32(memoryview(d)[HEADER.size:]) != body_crc:
            raise ValueError("damaged block")
        heads.append((n, size, words, ids_crc))
    lengths = [h[0] for h in heads]
    lanes = _Lanes(lengths)
    k = len(lanes.block)
    state, pos = np.zeros(k, np.uint64), np.zeros(k, np.int64)
    distinct, words, held = [], [], 0
    for i, (d, h) in enumerate(zip(data, heads)):
        body = np.frombuffer(d, np.uint8, offset=HEADER.size)
        ids, used = _distinct(body, h[1])
        distinct.append(ids)
        at, count, used = lanes.columns(i), int(lanes.count[i]), used + HEADER.size
        pos[at] = held + np.cumsum(np.frombuffer(d, "<u2", count, used).astype(np.int64)) - 1
        state[at] = np.frombuffer(d, "<u8", count, used + 2 * count)
        words.append(np.frombuffer(d, "<u4", h[2], used + 10 * count))
        held += h[2]
    flat = np.concatenate(words)
    m = _Model(lanes, np.array([h[1] for h in heads]), lengths, True)
    ranks = np.zeros((lanes.longest, k), np.uint32)
    total = (m.block_bits + _MIX).astype(np.uint64)[lanes.block]
    mask = (np.uint64(1) << total) - np.uint64(1)
    for t, live in enumerate(lanes.live):
        x = state[:live]
        m.predict(live)
        v = (x & mask[:live]).astype(np.uint32)
        rank, hit2, hit1 = m.find(v)
        ranks[t, :live] = rank
        start, width = m.interval(rank, hit2, hit1)
        v -= start
        x >>= total[:live]
        x *= width
        x += v
        at = np.flatnonzero(x < _LOWER)
        if len(at):
            p = pos[at]
            x[at] = x[at] << _U32 | flat.take(p)
            pos[at] = p - 1
        m.learn(rank, ranks)
    out: list = []
    first = 0
    for i, h in enumerate(heads):
        r = ranks[:min(lanes.steps[i], lanes.longest), lanes.columns(i)].T.reshape(-1)[:h[0]]
        r = r - np.uint32(first)
        ids = distinct[i][r].astype("<u4")
        if zlib.crc32(ids.tobytes()) != h[3]:
            raise ValueError("damaged block")
        out.append(ids)
        first += h[1]
    return out
