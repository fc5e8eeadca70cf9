"""Words and hashes of many texts at once, with numpy over the UTF-8 bytes of an Arrow column.

All word rules here are sets of bytes: every separator is ASCII, so bytes from 0x80 up, which only occur
inside longer code points, are always parts of words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Texts are worked on in slices of about so many bytes; a longer text has a slice of its own.
SLICE_BYTES = 1 << 21

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit (the splitmix64 finaliser)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_BYTE_CODES = mix(np.arange(1, 257, dtype=np.uint64) * _U(_BASE))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def byte_set(*ranges: tuple[int, int]) -> np.ndarray:
    """A lookup table that is true for the bytes in the inclusive ranges."""
    table = np.zeros(256, dtype=bool)
    for low, high in ranges:
        table[low : high + 1] = True
    return table


#: Everything but space, tab, line feed, vertical tab, form feed and carriage return.
NOT_SPACE = ~byte_set((0x20, 0x20), (0x09, 0x0D))
#: Digits, lower-case letters and all that isn't ASCII.
ALNUM = byte_set((0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF))


def text_slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows whose texts have about ``limit`` bytes together."""
    if not batch.num_rows:
        return
    _, offsets = utf8(batch.column(batch.schema.get_field_index(column)))
    row = 0
    while row < batch.num_rows:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, side="right")) - 1)
        yield batch.slice(row, end - row)
        row = end


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts and the offset of each text, with one more at the end; a null text is empty."""
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def word_spans(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every maximal run of ``inside`` bytes within one text; the index of each text's first word."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    word = inside[data]
    edges = offsets[(offsets > 0) & (offsets < len(data))]
    before = np.concatenate([[False], word[:-1]])
    before[edges] = False
    after = np.concatenate([word[1:], [False]])
    after[edges - 1] = False
    starts, ends = np.flatnonzero(word & ~before), np.flatnonzero(word & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


class _Powers:
    """Powers of the base and of its inverse modulo 2**64, made longer as needed."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, SLICE_BYTES + 1)
            inverse = pow(_BASE, -1, 1 << 64)
            self.up = np.cumprod(np.concatenate([[_U(1)], np.full(size - 1, _BASE, np.uint64)]))
            self.down = np.cumprod(np.concatenate([[_U(1)], np.full(size - 1, inverse, np.uint64)]))
        return self.up[:n], self.down[:n]


_powers = _Powers()


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    """Sums of byte codes times powers of the base, over every prefix; span_hashes() takes differences of them."""
    up, _ = _powers.get(len(data) + 1)
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE_CODES[data] * up[: len(data)], out=out[1:])
    return out


def span_hashes(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span that depends on its bytes only."""
    _, down = _powers.get(len(prefix))
    return mix((prefix[ends] - prefix[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span: eight bytes at a time are mixed in, each after all before.

    Unlike span_hashes(), whose sums of powers modulo 2**64 are equal for some unlike texts of 1,024 bytes and more
    (Thue-Morse words of two letters), no step is linear, so unlike spans are equal by chance only.
    """
    left = (ends - starts).astype(np.int64)
    out = mix(left.astype(np.uint64) * _U(_BASE) + _U(1))
    # every eight bytes from any place on, the last ones filled up with zeros
    eights = np.lib.stride_tricks.sliding_window_view(np.concatenate([data, np.zeros(8, np.uint8)]), 8)
    rows, at = np.arange(len(left)), starts.astype(np.int64)
    while len(rows):
        part = np.ascontiguousarray(eights[at]).view("<u8")[:, 0].astype(np.uint64)
        short = left < 8
        if short.any():
            part[short] &= (_U(1) << (left[short] * 8).astype(np.uint64)) - _U(1)
        out[rows] = mix(out[rows] ^ mix(part + _U(_BASE)))
        more = left > 8
        rows, at, left = rows[more], at[more] + 8, left[more] - 8
    return out


def combine(hashes: np.ndarray, size: int) -> np.ndarray:
    """A hash of every run of ``size`` consecutive hashes (fewer than size: none)."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.full(n, size, np.uint64)
    for k in range(size):
        total = total * _U(0x9E3779B97F4A7C15) + hashes[k : k + n]
        total ^= total >> _U(29)
    return mix(total)


def within(first: np.ndarray, size: int) -> np.ndarray:
    """Indexes of the words at which a run of ``size`` words of the same text starts. first: as from word_spans()."""
    total = int(first[-1]) if len(first) else 0
    keep = np.zeros(total + 1, np.int64)
    starts, ends = first[:-1], np.maximum(first[1:] - size + 1, first[:-1])
    np.add.at(keep, starts, 1)
    np.add.at(keep, ends, -1)
    return np.flatnonzero(np.cumsum(keep)[:total] > 0)
