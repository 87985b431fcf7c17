"""Words of many texts at once, as places in their UTF-8 bytes: cut by a table of bytes, hashed and combined in numpy."""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa

#: A word's bytes beyond so many are worked on word by word.
LONG_WORD = 64


def byte_table(parts: Callable[[int], bool]) -> np.ndarray:
    """By byte: whether it belongs to words."""
    return np.array([parts(b) for b in range(256)])


#: Words between ASCII white space; and words of ASCII letters, digits and all other characters beyond ASCII.
NO_SPACE = byte_table(lambda b: b != 32 and not 9 <= b <= 13)
LETTERS = byte_table(lambda b: b >= 128 or chr(b).isalnum())
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(the bytes of all texts, one after the other; where each starts, and the end). Texts have no nulls."""
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = texts.buffers()
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    at = np.frombuffer(offsets, kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    held = np.zeros(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)[at[0] : at[-1]]
    return held, at - at[0]


class Words:
    """The words of texts: data (their bytes, A-Z in lower case), begin and size by word, and bounds: the words of text k are bounds[k] to bounds[k + 1]."""

    def __init__(self, texts: pa.Array, table: np.ndarray):
        raw, starts = text_bytes(texts)
        self.data = LOWER[raw]
        inside = table[self.data]
        joined = np.zeros(len(inside) + 1, bool)  # whether a byte is of the same word as the one before it
        joined[1:-1] = inside[1:] & inside[:-1]
        joined[starts] = False
        self.begin = np.flatnonzero(inside & ~joined[:-1])
        self.size = np.flatnonzero(inside & ~joined[1:]) + 1 - self.begin
        self.bounds = np.searchsorted(self.begin, starts)

    def folded(self, value: np.ndarray, step: Callable[[np.ndarray, np.ndarray], np.ndarray], whole: Callable[[bytes], int]) -> np.ndarray:
        """step(value, byte) over each word's bytes; long words are given to whole."""
        short = np.minimum(self.size, LONG_WORD + 1).astype(np.uint8)
        order = np.argsort(short, kind="stable")[::-1]
        begin, width = self.begin[order], short[order]
        left = np.searchsorted(-width.astype(np.int16), -np.arange(LONG_WORD + 2), side="right")  # by n: how many words have n bytes or more
        out = value[order]
        skip = int(left[LONG_WORD + 1])
        for k in range(LONG_WORD):
            stop = int(left[k + 1])
            if stop <= skip:
                break
            out[skip:stop] = step(out[skip:stop], self.data[begin[skip:stop] + k])
        for k in range(skip):
            at = order[k]
            out[k] = whole(self.data[self.begin[at] : self.begin[at] + self.size[at]].tobytes())
        back = np.empty_like(out)
        back[order] = out
        return back

    def crc32(self) -> np.ndarray:
        start = np.full(len(self.begin), 0xFFFFFFFF, np.uint32)
        stepped = self.folded(start, lambda c, b: _CRC[(c ^ b) & np.uint32(255)] ^ (c >> np.uint32(8)), lambda w: zlib.crc32(w) ^ 0xFFFFFFFF)
        return stepped ^ np.uint32(0xFFFFFFFF)


def _crc_table() -> np.ndarray:
    """CRC-32 by byte, as zlib has it: its polynomial's rule applied to each."""
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, (c >> np.uint32(1)) ^ np.uint32(0xEDB88320), c >> np.uint32(1))
    return c


_CRC = _crc_table()


def _applied(tables: np.ndarray, c: np.ndarray) -> np.ndarray:
    return tables[0][c & np.uint32(255)] ^ tables[1][(c >> np.uint32(8)) & np.uint32(255)] ^ tables[2][(c >> np.uint32(16)) & np.uint32(255)] ^ tables[3][c >> np.uint32(24)]


def _shift_tables() -> tuple[np.ndarray, list[np.ndarray]]:
    """What so many zero bytes after a text do to its CRC, for 0 to LONG_WORD bytes and for powers of two, as tables of the CRC's four bytes."""
    one = np.stack([np.arange(256, dtype=np.uint32) << np.uint32(8 * k) for k in range(4)])
    steps = [one]
    for _ in range(LONG_WORD):
        steps.append(_CRC[steps[-1] & np.uint32(255)] ^ (steps[-1] >> np.uint32(8)))
    powers = [steps[1]]
    for _ in range(40):
        powers.append(_applied(powers[-1], powers[-1]))
    return np.stack(steps, axis=1), powers


_STEPS, _POWERS = _shift_tables()


def crc32_after(crc: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """CRCs moved on by so many bytes: crc32(a + b) = crc32_after(crc32(a), len(b)) ^ crc32(b)."""
    n = np.minimum(sizes, LONG_WORD)
    out = _STEPS[0][n, crc & np.uint32(255)]
    for k in range(1, 4):
        out ^= _STEPS[k][n, (crc >> np.uint32(8 * k)) & np.uint32(255)]
    for at in np.flatnonzero(sizes > LONG_WORD):
        c = crc[at : at + 1]
        for k in range(int(sizes[at]).bit_length()):
            if int(sizes[at]) >> k & 1:
                c = _applied(_POWERS[k], c)
        out[at] = c[0]
    return out
