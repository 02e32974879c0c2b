"""CRC-32C of many byte strings at once, in numpy.

A CRC is linear over GF(2), so each string is cut into equal blocks, the blocks run side by
side as lanes, and the block results are moved to their place by "append n zero bytes"
operators and XORed.  Leading zero bytes do not change a CRC whose register starts at 0,
which is how strings get padded to whole blocks.
"""

from __future__ import annotations

import functools

import numpy as np

POLYNOMIAL = 0x82F63B78  # Castagnoli, reflected
MASK_DELTA = 0xA282EAD8  # added after the rotation of a masked checksum
BLOCK = 128
LANE_BYTES = 4 << 20


@functools.lru_cache(maxsize=1)
def _byte_tables() -> np.ndarray:
    """Tables for eight bytes a step: row k is the effect of a byte followed by k zero bytes."""
    one = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        one = np.where(one & 1, (one >> 1) ^ np.uint32(POLYNOMIAL), one >> 1).astype(np.uint32)
    rows = [one]
    for _ in range(7):
        rows.append((rows[-1] >> 8) ^ one[rows[-1] & 255])
    return np.stack(rows)


@functools.lru_cache(maxsize=64)
def _append_tables(power: int) -> np.ndarray:
    """Four 256-entry tables of the operator that appends 2**power zero bytes."""
    if power == 0:
        state = np.uint32(1) << np.arange(32, dtype=np.uint32)
        basis = (state >> 8) ^ _byte_tables()[0][state & 255]
    else:
        half = _append_tables(power - 1)
        basis = _apply(half, _apply(half, np.uint32(1) << np.arange(32, dtype=np.uint32)))
    tables = np.zeros((4, 256), np.uint32)
    for byte in range(4):
        for bit in range(8):
            tables[byte] ^= np.where(np.arange(256) >> bit & 1, basis[8 * byte + bit], 0).astype(np.uint32)
    return tables


def _apply(tables: np.ndarray, state: np.ndarray) -> np.ndarray:
    return tables[0][state & 255] ^ tables[1][state >> 8 & 255] ^ tables[2][state >> 16 & 255] ^ tables[3][state >> 24]


def _append_zeros(state: np.ndarray, counts: np.ndarray) -> np.ndarray:
    state, counts = state.copy(), counts.astype(np.int64)
    for power in range(int(counts.max(initial=0)).bit_length()):
        pick = np.flatnonzero(counts >> power & 1)
        if len(pick):
            state[pick] = _apply(_append_tables(power), state[pick])
    return state


def crc32c(strings: list[bytes]) -> np.ndarray:
    """CRC-32C of each string, as uint32."""
    out, start, size = [], 0, 0
    for i, s in enumerate(strings):
        size += len(s)
        if size >= LANE_BYTES:
            out.append(_together(strings[start : i + 1]))
            start, size = i + 1, 0
    if start < len(strings):
        out.append(_together(strings[start:]))
    return np.concatenate(out) if out else np.zeros(0, np.uint32)


def _together(strings: list[bytes]) -> np.ndarray:
    length = np.array([len(s) for s in strings], np.int64)
    blocks = np.maximum(1, -(-length // BLOCK))
    padded = b"".join(part for s, n, k in zip(strings, length, blocks) for part in (bytes(k * BLOCK - n), s))
    lanes = np.ascontiguousarray(np.frombuffer(padded, np.uint8).reshape(-1, BLOCK).T)
    tables, state = _byte_tables(), np.zeros(lanes.shape[1], np.uint32)
    for at in range(0, BLOCK, 8):
        b = lanes[at : at + 8]
        state = (
            tables[7][b[0] ^ (state & 255)] ^ tables[6][b[1] ^ (state >> 8 & 255)]
            ^ tables[5][b[2] ^ (state >> 16 & 255)] ^ tables[4][b[3] ^ (state >> 24)]
            ^ tables[3][b[4]] ^ tables[2][b[5]] ^ tables[1][b[6]] ^ tables[0][b[7]]
        )
    first = np.cumsum(blocks) - blocks
    after = np.repeat(first + blocks, blocks) - np.arange(lanes.shape[1]) - 1
    body = np.bitwise_xor.reduceat(_append_zeros(state, after * BLOCK), first)
    ones = np.full(len(strings), 0xFFFFFFFF, np.uint32)
    return body ^ _append_zeros(ones, length) ^ np.uint32(0xFFFFFFFF)


def masked(crc: np.ndarray) -> np.ndarray:
    """Rotate right by 15 bits and add a constant, so that a CRC of data with CRCs stays sound."""
    crc = crc.astype(np.uint32)
    return ((crc >> np.uint32(15)) | (crc << np.uint32(17))) + np.uint32(MASK_DELTA)
