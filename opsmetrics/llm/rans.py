"""Interleaved static range asymmetric numeral coding of token-id blocks, in numpy.

One frequency table, scaled to 2**BITS, is shared by all blocks. A block writes its ids row by
row over ``lanes`` independent coder states (id k is on row k // lanes, lane k % lanes); the
lanes' 32-bit words stand in one stream in the order in which decoding asks for them. Every
``rows`` rows a checkpoint holds the lanes' states, the position in the stream and the CRC-32
of the ids up to the next one, so each segment of a block decodes on its own.

Block format, little-endian: magic "RAN1", n ids u32, lanes u32, rows a segment u32, segments
u32, words u32, CRC-32 of all that follows u32; then per segment: first word u32, CRC-32 of its
ids (as 32-bit integers) u32, states u64 x lanes; then the words u32.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

BITS = 20
MAGIC = b"RAN1"
_LOW = np.uint64(1 << 31)
_HEAD = struct.Struct("<4s6I")


def scaled(counts: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Frequencies with sum 2**bits, at least 1 where the count isn't 0 (which must be at most 2**bits places)."""
    total, room = int(counts.sum()), 1 << bits
    if not total:
        return np.zeros(len(counts), np.int64)
    if np.count_nonzero(counts) > room:
        raise ValueError("more symbols than table places")
    f = np.where(counts > 0, np.maximum(1, np.floor(counts * (room / total))), 0).astype(np.int64)
    order = np.argsort(-f, kind="stable")
    over = int(f.sum()) - room
    while over:
        # what rounding has added or taken is spread over the largest frequencies, in proportion
        share = np.minimum(f[order] - 1, -(-f[order] * abs(over) // room) + 1) if over > 0 else -(-f[order] * abs(over) // room)
        share = np.maximum(share, 0)
        taken = np.minimum(np.cumsum(share), abs(over))
        step = np.diff(taken, prepend=0)
        f[order] -= step if over > 0 else -step
        over = int(f.sum()) - room
    return f


class Tables:
    def __init__(self, freq: np.ndarray, bits: int = BITS):
        self.bits = np.uint64(bits)
        self.mask = np.uint64((1 << bits) - 1)
        self.freq = freq.astype(np.uint64)
        self.start = np.concatenate([[0], np.cumsum(freq)[:-1]]).astype(np.uint64)
        self.top = self.freq << np.uint64(63 - bits)    # a state from here on gives up a word first
        self._symbol = None

    @property
    def symbol(self) -> np.ndarray:
        if self._symbol is None:
            self._symbol = np.repeat(np.arange(len(self.freq), dtype=np.uint32), self.freq.astype(np.int64))
        return self._symbol


def encode(ids: np.ndarray, t: Tables, lanes: int = 2048, rows: int = 256) -> bytes:
    n = len(ids)
    lanes = max(1, min(lanes, -(-n // 64)))
    total = -(-n // lanes)
    x = np.full(lanes, _LOW, np.uint64)
    segments = -(-total // rows)
    states, counts = [None] * segments, np.zeros(total, np.int64)
    chunks: list = [None] * total
    shift = np.uint64(32)
    for row in range(total - 1, -1, -1):
        sym = ids[row * lanes:(row + 1) * lanes]
        y = x[:len(sym)]
        full = np.flatnonzero(y >= t.top[sym])
        chunks[row] = (y[full] & np.uint64(0xFFFFFFFF)).astype("<u4")
        counts[row] = len(full)
        y[full] >>= shift
        f = t.freq[sym]
        q = y // f
        y[:] = (q << t.bits) + (y - q * f) + t.start[sym]
        if row % rows == 0:
            states[row // rows] = x.astype("<u8").tobytes()
    words = np.concatenate(chunks) if total else np.zeros(0, "<u4")
    at = np.concatenate([[0], np.cumsum(counts)])
    wide = ids.astype("<u4")
    body = b"".join(
        struct.pack("<II", int(at[s * rows]), zlib.crc32(wide[s * rows * lanes:(s + 1) * rows * lanes].tobytes())) + states[s]
        for s in range(segments)) + words.tobytes()
    return _HEAD.pack(MAGIC, n, lanes, rows, segments, len(words), zlib.crc32(body)) + body


def segments(block: bytes) -> int:
    return _HEAD.unpack_from(block)[4]


def decode(block: bytes, t: Tables, segment: int | None = None) -> np.ndarray:
    """The ids of the block, or of one of its segments; a damaged block raises ValueError."""
    magic, n, lanes, rows, count, size, crc = _HEAD.unpack_from(block)
    if magic != MAGIC or zlib.crc32(block[_HEAD.size:]) != crc:
        raise ValueError("damaged block")
    each = 8 + 8 * lanes
    words = np.frombuffer(block, "<u4", size, _HEAD.size + each * count).astype(np.uint64)
    out = []
    for s in range(count) if segment is None else [segment]:
        at, ids_crc = struct.unpack_from("<II", block, _HEAD.size + each * s)
        x = np.frombuffer(block, "<u8", lanes, _HEAD.size + each * s + 8).astype(np.uint64)
        first, last = s * rows * lanes, min(n, (s + 1) * rows * lanes)
        ids = np.empty(last - first, np.uint32)
        for k in range(0, last - first, lanes):
            y = x[:min(lanes, last - first - k)]
            slot = y & t.mask
            sym = t.symbol[slot]
            ids[k:k + len(y)] = sym
            y[:] = t.freq[sym] * (y >> t.bits) + slot - t.start[sym]
            low = np.flatnonzero(y < _LOW)
            y[low] = (y[low] << np.uint64(32)) | words[at:at + len(low)]
            at += len(low)
        if zlib.crc32(ids.astype("<u4").tobytes()) != ids_crc:
            raise ValueError(f"ids of segment {s} differ from their checksum")
        out.append(ids)
    return np.concatenate(out) if out else np.zeros(0, np.uint32)
