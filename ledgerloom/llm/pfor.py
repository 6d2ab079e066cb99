"""Patched frame-of-reference coding of unsigned 32-bit integers, in numpy.

A block holds up to BLOCK integers as differences to their minimum. The width
is the number of bits that suffices for a given percentile of the differences;
the low bits of all are packed at that width, least significant bit first.
Larger ones are exceptions: their positions and whole differences follow.

    uint32 minimum | uint16 count | uint16 exceptions | uint8 width | 3 zero bytes
    packed bits, padded to bytes | uint16 positions | uint32 differences
"""

from __future__ import annotations

import numpy as np

BLOCK = 1024
PERCENTILE = 90
_HEAD = np.dtype([("minimum", "<u4"), ("count", "<u2"), ("exceptions", "<u2"), ("width", "u1"), ("pad", "V3")])
_POWERS = 2 ** np.arange(33, dtype=np.uint64)


def _bits(values: np.ndarray) -> np.ndarray:
    """The number of bits of each value."""
    return np.searchsorted(_POWERS, values, side="right").astype(np.uint8)


def _pack(rows: np.ndarray, width: int) -> np.ndarray:
    """The low bits of each row of integers, one row of bytes each."""
    kind = "<u2" if width <= 16 else "<u4"
    cells = np.ascontiguousarray(rows.astype(kind)).view(np.uint8).reshape(*rows.shape, -1)
    bits = np.unpackbits(cells, axis=-1, bitorder="little")[..., :width]
    return np.packbits(bits.reshape(len(rows), -1), axis=-1, bitorder="little")


def _unpack(packed: np.ndarray, count: int, width: int) -> np.ndarray:
    """The values of each row: the bytes that hold a value, shifted together."""
    bit = np.arange(count) * width
    byte, shift = bit >> 3, (bit & 7).astype(np.uint64)
    padded = np.pad(packed, ((0, 0), (0, 5)))
    n_bytes = (width + 7 + 7) // 8
    kind = np.uint32 if n_bytes <= 4 else np.uint64
    whole = padded[:, byte].astype(kind)
    for k in range(1, n_bytes):
        whole |= padded[:, byte + k].astype(kind) << kind(8 * k)
    return ((whole >> shift.astype(kind)) & kind((1 << width) - 1)).astype(np.uint32)


def _encode_rows(rows: np.ndarray, percentile: int) -> list[bytes]:
    """One block for each row."""
    count = rows.shape[1]
    minima = rows.min(axis=1)
    diffs = rows - minima[:, None]
    bits = _bits(diffs)
    at = min(count - 1, -(-count * percentile // 100) - 1)
    widths = np.partition(bits, at, axis=1)[:, at]
    outlier = bits > widths[:, None]
    blocks: list[bytes] = [b""] * len(rows)
    for width in np.unique(widths).tolist():
        chosen = np.flatnonzero(widths == width)
        packed = _pack(diffs[chosen], width) if width else np.zeros((len(chosen), 0), np.uint8)
        for i, body in zip(chosen.tolist(), packed, strict=True):
            positions = np.flatnonzero(outlier[i])
            head = np.array([(minima[i], count, len(positions), width, b"")], _HEAD)
            tail = positions.astype("<u2").tobytes() + diffs[i, positions].astype("<u4").tobytes()
            blocks[i] = head.tobytes() + body.tobytes() + tail
    return blocks


def encode(values: np.ndarray, percentile: int = PERCENTILE) -> list[bytes]:
    """The blocks of `values`: all but the last hold BLOCK integers. No values give no block."""
    values = np.asarray(values, np.uint32)
    whole = len(values) // BLOCK * BLOCK
    blocks = _encode_rows(values[:whole].reshape(-1, BLOCK), percentile) if whole else []
    if whole < len(values):
        blocks += _encode_rows(values[whole:].reshape(1, -1), percentile)
    return blocks


def decode(data: bytes, starts: np.ndarray) -> np.ndarray:
    """The values of the blocks that begin at `starts`, in that order."""
    raw = np.frombuffer(data, np.uint8)
    starts = np.asarray(starts, np.int64)
    if not len(starts):
        return np.zeros(0, np.uint32)
    heads = np.ascontiguousarray(raw[starts[:, None] + np.arange(_HEAD.itemsize)]).view(_HEAD).reshape(-1)
    counts, widths = heads["count"].astype(np.int64), heads["width"].astype(np.int64)
    begins = np.concatenate([[0], np.cumsum(counts)])
    out = np.empty(begins[-1], np.uint32)
    for count, width in np.unique(np.stack([counts, widths], 1), axis=0).tolist():
        chosen = np.flatnonzero((counts == count) & (widths == width))
        size = -(-count * width // 8)
        body = raw[(starts[chosen] + _HEAD.itemsize)[:, None] + np.arange(size)]
        diffs = _unpack(body, count, width) if width else np.zeros((len(chosen), count), np.uint32)
        values = diffs + heads["minimum"][chosen][:, None]
        for row, i in zip(values, chosen.tolist(), strict=True):
            out[begins[i] : begins[i] + count] = row
    for i in np.flatnonzero(heads["exceptions"]).tolist():
        n = int(heads["exceptions"][i])
        at = int(starts[i]) + _HEAD.itemsize + -(-int(counts[i]) * int(widths[i]) // 8)
        positions = np.frombuffer(data, "<u2", n, at)
        out[begins[i] + positions.astype(np.int64)] = np.frombuffer(data, "<u4", n, at + 2 * n) + heads["minimum"][i]
    return out
