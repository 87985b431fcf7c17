"""Patched frame-of-reference segments: blocks of integers less their minimum, packed at a percentile's width, with exceptions and an index."""

from __future__ import annotations

import struct

import numpy as np

MAGIC = b"PFR1"
BLOCK = 1024
PERCENTILE = 90
_HEAD = struct.Struct("<4sIIQ")  # magic, block size, blocks, ids


def _pack(values: np.ndarray, width: int) -> np.ndarray:
    """Rows of BLOCK values below 2^width as rows of bytes; value k of 64 starts at bit k * width of its group."""
    rows = values.shape[0]
    lanes = np.ascontiguousarray(values.reshape(rows, -1, 64).transpose(2, 0, 1)).astype(np.uint64)
    out = np.zeros((width, *lanes.shape[1:]), np.uint64)
    for k in range(64):
        word, shift = divmod(k * width, 64)
        out[word] |= lanes[k] << np.uint64(shift)
        if shift + width > 64:
            out[word + 1] |= lanes[k] >> np.uint64(64 - shift)
    return np.ascontiguousarray(out.transpose(1, 2, 0)).astype("<u8").view(np.uint8).reshape(rows, -1)


def _unpack(packed: np.ndarray, width: int) -> np.ndarray:
    rows = packed.shape[0]
    words = packed.view("<u8").reshape(rows, -1, width).transpose(2, 0, 1)
    mask = np.uint64((1 << width) - 1)
    out = np.empty((64, *words.shape[1:]), np.uint32)
    for k in range(64):
        word, shift = divmod(k * width, 64)
        v = words[word] >> np.uint64(shift)
        if shift + width > 64:
            v = v | (words[word + 1] << np.uint64(64 - shift))
        out[k] = (v & mask).astype(np.uint32)
    return out.transpose(1, 2, 0).reshape(rows, -1)


def encode(ids: np.ndarray) -> bytes:
    """A segment: header; for each block its start (u64), minimum (u32), width (u8) and number of exceptions (u16); then the blocks.

    A block: its packed values, then the places (u16) and the values less the minimum (u32) of its exceptions. The last block is filled up with the last id.
    """
    n = len(ids)
    blocks = -(-n // BLOCK)
    if not n:
        return _HEAD.pack(MAGIC, BLOCK, 0, 0) + struct.pack("<Q", 0)
    full = np.full(blocks * BLOCK, ids[-1], np.uint32)
    full[:n] = ids
    full = full.reshape(blocks, BLOCK)
    least = full.min(axis=1)
    rest = full - least[:, None]
    rank = -(-PERCENTILE * BLOCK // 100) - 1
    typical = np.partition(rest, rank, axis=1)[:, rank]
    width = np.ceil(np.log2(typical.astype(np.float64) + 1)).astype(np.uint8)
    limit = np.uint64(1) << width.astype(np.uint64)
    over = rest >= limit[:, None]
    exceptions = over.sum(axis=1)
    low = rest & (limit - np.uint64(1)).astype(np.uint32)[:, None]
    packed: list[bytes] = [b""] * blocks
    for w in np.unique(width):
        rows = np.flatnonzero(width == w)
        if w:
            for k, row in zip(rows.tolist(), _pack(low[rows], int(w)), strict=True):
                packed[k] = row.tobytes()
    row, place = np.nonzero(over)
    begin = np.concatenate(([0], np.cumsum(exceptions)))
    place, value = place.astype("<u2"), rest[row, place].astype("<u4")
    body = [packed[k] + place[a:b].tobytes() + value[a:b].tobytes() for k, (a, b) in enumerate(zip(begin.tolist(), begin[1:].tolist(), strict=False))]
    starts = np.concatenate(([0], np.cumsum([len(b) for b in body]))).astype("<u8")
    index = starts.tobytes() + least.astype("<u4").tobytes() + width.tobytes() + exceptions.astype("<u2").tobytes()
    return _HEAD.pack(MAGIC, BLOCK, blocks, n) + index + b"".join(body)


def decode(segment: bytes, start: int = 0, stop: int | None = None) -> np.ndarray:
    """ids[start:stop] of a segment; only the blocks that hold them are read."""
    magic, block, blocks, n = _HEAD.unpack_from(segment)
    if magic != MAGIC:
        raise ValueError("not a segment of packed ids")
    stop = n if stop is None else min(stop, n)
    if start >= stop:
        return np.zeros(0, np.uint32)
    at = _HEAD.size
    starts = np.frombuffer(segment, "<u8", blocks + 1, at)
    least = np.frombuffer(segment, "<u4", blocks, at := at + 8 * (blocks + 1))
    width = np.frombuffer(segment, "u1", blocks, at := at + 4 * blocks)
    exceptions = np.frombuffer(segment, "<u2", blocks, at := at + blocks)
    body = at + 2 * blocks
    first, last = start // block, -(-stop // block)
    out = np.zeros((last - first, block), np.uint32)
    chosen = width[first:last]
    for w in np.unique(chosen):
        if w:
            rows = np.flatnonzero(chosen == w)
            size = block * int(w) // 8
            packed = np.stack([np.frombuffer(segment, np.uint8, size, body + int(starts[first + k])) for k in rows])
            out[rows] = _unpack(packed, int(w))
    for k in np.flatnonzero(exceptions[first:last]):
        m, end = int(exceptions[first + k]), body + int(starts[first + k + 1])
        out[k, np.frombuffer(segment, "<u2", m, end - 6 * m)] = np.frombuffer(segment, "<u4", m, end - 4 * m)
    out += least[first:last, None]
    return out.reshape(-1)[start - first * block : stop - first * block]
