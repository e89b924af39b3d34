"""Static range asymmetric numeral system over token ids, many interleaved lanes at a time.

A block is an independent byte string: header, states of every lane at each checkpoint, coded 32-bit words, and a
checksum of both the coded bytes and the ids. All blocks of a file share one frequency table. Lane ``j`` of a block
codes ids ``j``, ``j + lanes``, ...; a decoder may start at any checkpoint without what lies before.
"""

from __future__ import annotations

import struct
from zlib import crc32

import numpy as np

MAGIC = b"RAN1"
#: Probabilities are multiples of 2 ** -PRECISION.
PRECISION = 20
#: States stay in [2 ** 31, 2 ** 63) and spill 32 bits at a time.
LOW = np.uint64(1 << 31)
LANES = 1024
#: Ids per lane between two checkpoints.
STRIDE = 256
HEADER = struct.Struct("<4sIIIIIII")  # magic, ids, lanes, stride, checkpoints, words, crc of the body, crc of the ids


class Frequencies:
    """A shared table: every id that occurs has a share of at least 2 ** -PRECISION."""

    def __init__(self, shares: np.ndarray):
        if shares.sum() != 1 << PRECISION:
            raise ValueError("shares must sum to 2 ** PRECISION")
        self.share = shares.astype(np.uint64)
        self.below = np.concatenate([[0], np.cumsum(shares)[:-1]]).astype(np.uint64)
        self.symbol = np.repeat(np.arange(len(shares), dtype=np.uint32), shares)

    @classmethod
    def of_counts(cls, counts: np.ndarray) -> "Frequencies":
        """Shares in proportion to counts, at least one for an id that occurs; ids that do not occur get none."""
        counts = np.asarray(counts, np.float64)
        if not counts.any():
            counts = counts.copy()
            counts[0] = 1
        used = counts > 0
        room = (1 << PRECISION) - int(used.sum())
        if room < 0:
            raise ValueError("more ids than shares")
        exact = counts / counts.sum() * room
        share = np.floor(exact).astype(np.int64) + used
        rest = (1 << PRECISION) - int(share.sum())
        share[np.argsort(np.floor(exact) - exact, kind="stable")[:rest]] += 1
        return cls(share)

    def tobytes(self) -> bytes:
        return self.share.astype("<u4").tobytes()

    @classmethod
    def frombytes(cls, data: bytes) -> "Frequencies":
        return cls(np.frombuffer(data, "<u4").astype(np.int64))


def encode(ids: np.ndarray, table: Frequencies, lanes: int = LANES, stride: int = STRIDE) -> bytes:
    n = len(ids)
    steps = -(-n // lanes)
    filler = int(np.argmax(table.share))
    grid = np.full(steps * lanes, filler, np.int64)
    grid[:n] = ids
    grid = grid.reshape(steps, lanes)
    x = np.full(lanes, LOW, np.uint64)
    shift, out = np.uint64(PRECISION), []
    states, left = [], []
    words = 0
    for t in range(steps - 1, -1, -1):
        share, below = table.share[grid[t]], table.below[grid[t]]
        full = x >= share << np.uint64(63 - PRECISION)
        if full.any():
            spill = x[full]
            out.append((spill & np.uint64(0xFFFFFFFF)).astype("<u4"))
            words += len(spill)
            x[full] = spill >> np.uint64(32)
        whole = x // share
        x = (whole << shift) + (x - whole * share) + below
        if t % stride == 0:
            states.append(x.astype("<u8"))
            left.append(words)
    coded = np.concatenate(out[::-1]) if out else np.zeros(0, "<u4")
    at = np.array([words - w for w in left[::-1]], "<u4")
    body = at.tobytes() + b"".join(s.tobytes() for s in states[::-1]) + coded.astype("<u4").tobytes()
    return HEADER.pack(MAGIC, n, lanes, stride, len(at), words, crc32(body), crc32(ids.astype("<u4").tobytes())) + body


def decode(block: bytes, table: Frequencies, first: int = 0, last: int | None = None) -> np.ndarray:
    """Ids of a block, or of its checkpoints ``first`` to ``last`` (exclusive) alone; raises where a checksum differs."""
    magic, n, lanes, stride, marks, words, body_crc, ids_crc = HEADER.unpack_from(block)
    body = memoryview(block)[HEADER.size:]
    if magic != MAGIC or crc32(body) != body_crc:
        raise ValueError("damaged block")
    last = marks if last is None else last
    at = np.frombuffer(body, "<u4", marks)
    states = np.frombuffer(body, "<u8", marks * lanes, marks * 4).reshape(marks, lanes)
    coded = np.frombuffer(body, "<u4", words, marks * 4 + marks * lanes * 8).astype(np.uint64)
    steps = -(-n // lanes)
    begin, end = min(first * stride, steps), min(last * stride, steps)
    out = np.empty((end - begin, lanes), np.uint32)
    if end > begin:
        x, read = states[first].astype(np.uint64), int(at[first])
        shift, mask = np.uint64(PRECISION), np.uint64((1 << PRECISION) - 1)
        for t in range(end - begin):
            slot = x & mask
            got = table.symbol[slot]
            out[t] = got
            x = table.share[got] * (x >> shift) + slot - table.below[got]
            low = np.flatnonzero(x < LOW)
            if len(low):
                x[low] = (x[low] << np.uint64(32)) | coded[read:read + len(low)]
                read += len(low)
    ids = out.reshape(-1)[: max(0, min(n, end * lanes) - begin * lanes)]
    if first == 0 and last >= marks and crc32(ids.astype("<u4").tobytes()) != ids_crc:
        raise ValueError("ids differ from their checksum")
    return ids
