"""Static range asymmetric numeral system over blocks of token ids, vectorised over lanes.

A run of ids has one frequency table, which its blocks share. A block is coded by itself: LANES states take its ids in
turn and write their 32-bit words into one stream, in the order in which a decoder reads them. At the start of every
segment of a block stands a checkpoint, the lanes' states and the place in the stream, so that all segments of all blocks
can be decoded at once. Checksums of the stream and of the ids tell damage.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np

#: Frequencies of a table add up to 2^BITS; states stay in [2^32, 2^64). Ids must be below 2^BITS.
BITS = 20
LOW = 1 << 32
LANES = 64
#: Ids of a segment and of a block; both are multiples of LANES.
SEGMENT, BLOCK = 1 << 15, 1 << 16


class Table:
    """Frequencies of a run's distinct ids, scaled to 2^BITS; every id that occurs has one at least."""

    def __init__(self, ids: np.ndarray, freqs: np.ndarray):
        self.ids, self.freqs = ids.astype(np.uint32), freqs.astype(np.uint64)
        self.starts = np.cumsum(self.freqs) - self.freqs

    @classmethod
    def of(cls, run: np.ndarray) -> Table:
        counts = np.bincount(run.astype(np.int64))
        if len(counts) > 1 << BITS:
            raise ValueError(f"ids must be below {1 << BITS}")
        ids = np.flatnonzero(counts)
        if not len(ids):
            return cls(ids, ids)
        counts = counts[ids]
        freqs = np.maximum(1, (counts << BITS) // int(counts.sum()))
        spare = (1 << BITS) - int(freqs.sum())
        if spare > 0:
            freqs[np.argmax(counts)] += spare
        order = np.argsort(-freqs, kind="stable")
        while spare < 0:  # rounding up has given out too much: the largest give it back
            give = np.minimum(freqs[order] - 1, -(-freqs[order] * -spare // (1 << BITS)))
            give -= np.clip(np.cumsum(give) + spare, 0, give)
            freqs[order] -= give
            spare += int(give.sum())
        return cls(ids, freqs)

    def to_bytes(self) -> bytes:
        gaps = np.diff(self.ids, prepend=np.uint32(0)).astype("<u4")
        return zlib.compress(gaps.tobytes() + self.freqs.astype("<u4").tobytes())

    @classmethod
    def from_bytes(cls, raw: bytes) -> Table:
        both = np.frombuffer(zlib.decompress(raw), "<u4")
        return cls(np.cumsum(both[: len(both) // 2], dtype=np.uint32), both[len(both) // 2 :])


@dataclass
class Block:
    """A block of n_ids: its words (little-endian, 32 bits), its checkpoints and two checksums."""

    n_ids: int
    words: bytes
    points: bytes
    stored_crc32: int
    ids_crc32: int


def _point(states: np.ndarray, at: np.ndarray) -> bytes:
    """Checkpoints of a block: for each segment the word at which it starts, and the state of each lane."""
    return at.astype("<u4").tobytes() + states.astype("<u8").tobytes()


def encode(ids: np.ndarray, table: Table, block: int = BLOCK, segment: int = SEGMENT) -> list[Block]:
    """Blocks of a run, coded side by side: a step takes one id of every lane of every block, the last ids first."""
    n = len(ids)
    if not n:
        return []
    count, width = -(-n // block), block // LANES
    place = np.zeros(int(table.ids[-1]) + 1, np.int32)
    place[table.ids] = np.arange(len(table.ids), dtype=np.int32)
    grid = np.full(count * block, int(np.argmax(table.freqs)), np.int32)  # lanes without an id code the likeliest one
    grid[:n] = place[ids]
    grid = grid.reshape(count, width, LANES)
    last = -(-(n - (count - 1) * block) // LANES)
    state = np.full((count, LANES), LOW, np.uint64)
    words, sizes, points = [], np.zeros((width, count), np.int64), {}
    for s in range((width if count > 1 else last) - 1, -1, -1):
        k = count if s < last else count - 1
        at = grid[:k, s]
        x, f = state[:k], table.freqs[at]
        over = (x >> np.uint64(64 - BITS)) >= f
        words.append((x[over] & np.uint64(LOW - 1)).astype("<u4"))
        sizes[s, :k] = over.sum(axis=1)
        x = np.where(over, x >> np.uint64(32), x)
        q = x // f
        state[:k] = (q << np.uint64(BITS)) + (x - q * f) + table.starts[at]
        if s % (segment // LANES) == 0:
            points[s] = state[:k].copy()
    flat = np.concatenate(words[::-1])
    owner = np.repeat(np.tile(np.arange(count, dtype=np.uint16), width), sizes.ravel())
    flat = flat[np.argsort(owner, kind="stable")]
    ends, before = np.cumsum(sizes.sum(axis=0)), np.cumsum(sizes, axis=0) - sizes
    out = []
    for b in range(count):
        steps = [s for s in sorted(points) if b < len(points[s])]
        stream = flat[ends[b] - sizes[:, b].sum() : ends[b]].tobytes()
        marks = _point(np.stack([points[s][b] for s in steps]), before[steps, b])
        own = ids[b * block : (b + 1) * block]
        out.append(Block(len(own), stream, marks, zlib.crc32(marks, zlib.crc32(stream)), zlib.crc32(own.astype("<u4").tobytes())))
    return out


def decode(blocks: list[Block], table: Table, segment: int = SEGMENT) -> list[np.ndarray]:
    """Ids of any blocks of a run, whose segments are decoded side by side. ValueError if a checksum doesn't fit."""
    if not blocks:
        return []
    spans, states, at, words, base = [], [], [], [], 0
    for i, b in enumerate(blocks):
        if zlib.crc32(b.points, zlib.crc32(b.words)) != b.stored_crc32:
            raise ValueError("a block's stored bytes don't fit their checksum")
        n = -(-b.n_ids // segment)
        at.append(np.frombuffer(b.points, "<u4", n).astype(np.int64) + base)
        states.append(np.frombuffer(b.points, "<u8", n * LANES, 4 * n).reshape(n, LANES))
        words.append(np.frombuffer(b.words, "<u4"))
        base += len(words[-1])
        spans += [(i, min(segment, b.n_ids - k * segment)) for k in range(n)]
    sizes = np.array([n for _, n in spans])
    order = np.argsort(-sizes, kind="stable")
    steps = -(-sizes[order] // LANES)
    state, pos = np.concatenate(states)[order].astype(np.uint64), np.concatenate(at)[order]
    words = np.append(np.concatenate(words), np.uint32(0)).astype(np.uint64)
    slots = np.repeat(np.arange(len(table.ids), dtype=np.int32), table.freqs.astype(np.int64))
    got = np.empty((len(order), int(steps[0]), LANES), np.int32)
    for s in range(int(steps[0])):
        k = int(np.searchsorted(-steps, -s, side="left"))
        x = state[:k]
        slot = x & np.uint64((1 << BITS) - 1)
        got[:k, s] = sym = slots[slot.astype(np.int64)]
        x = table.freqs[sym] * (x >> np.uint64(BITS)) + slot - table.starts[sym]
        low = x < np.uint64(LOW)
        read = np.cumsum(low, axis=1)
        nxt = words[np.minimum(pos[:k, None] + read - 1, len(words) - 1)]
        state[:k] = np.where(low, (x << np.uint64(32)) | nxt, x)
        pos[:k] += read[:, -1]
    parts: list[list[np.ndarray]] = [[] for _ in blocks]
    for row in np.argsort(order):
        i, n = spans[order[row]]
        parts[i].append(table.ids[got[row].ravel()[:n]])
    out = [np.concatenate(p) if p else np.empty(0, np.uint32) for p in parts]
    if any(zlib.crc32(x.astype("<u4").tobytes()) != b.ids_crc32 for x, b in zip(out, blocks, strict=True)):
        raise ValueError("a block's ids don't fit their checksum")
    return out


def join_crc32(first: int, second: int, n_bytes: int) -> int:
    """CRC-32 of two byte strings one after the other, from theirs and the second one's length: the first is shifted over
    zero bytes by squaring the shift over one bit."""
    if not n_bytes:
        return first
    times = lambda m, v: _xor(m[i] for i in range(32) if v >> i & 1)
    shift = [0xEDB88320, *(1 << i for i in range(31))]
    n = n_bytes * 8
    while n:
        if n & 1:
            first = times(shift, first)
        shift = [times(shift, row) for row in shift]
        n >>= 1
    return first ^ second


def _xor(values) -> int:
    out = 0
    for v in values:
        out ^= v
    return out
