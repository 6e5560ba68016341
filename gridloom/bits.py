"""Bits and bytes: big-endian integers, sign-magnitude integers, n-bit sequences, rounding."""

from __future__ import annotations

import numpy as np


def uint(data: bytes, at: int, size: int) -> int:
    return int.from_bytes(data[at : at + size], "big")


def from_sign_magnitude(value: int, bits: int) -> int:
    """The top bit is the sign; minus zero is zero."""
    top = 1 << bits - 1
    return -(value - top) if value >= top else value


def to_sign_magnitude(value: int, bits: int) -> int:
    return value if value >= 0 else (1 << bits - 1) - value


def sint(data: bytes, at: int, size: int) -> int:
    return from_sign_magnitude(uint(data, at, size), 8 * size)


def octets(bits: int) -> int:
    return -(-bits // 8)


def bits_required(value):
    """Bits that hold a value: 0 for 0, 1 for 1, 3 for 4. Works on numbers and arrays."""
    if isinstance(value, np.ndarray):
        out = np.zeros(value.shape, np.int64)
        rest = value.astype(np.int64)
        while rest.any():
            out += rest > 0
            rest = rest >> 1
        return out
    return int(value).bit_length()


def unpack_at(data: np.ndarray, starts: np.ndarray, widths: np.ndarray) -> np.ndarray:
    """Unsigned integers of up to 32 bits that begin at bit ``starts``, most significant bit first."""
    if not len(starts):
        return np.zeros(0, np.int64)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    lead = starts >> 3
    word = np.zeros(len(starts), np.uint64)
    for k in range(5):  # 32 bits and an offset below 8 lie in five octets
        word = (word << np.uint64(8)) | padded[lead + k]
    shift = (40 - (starts & 7) - widths).astype(np.uint64)
    mask = (np.uint64(1) << widths.astype(np.uint64)) - np.uint64(1)
    return ((word >> shift) & mask).astype(np.int64)


def unpack(data: bytes | np.ndarray, width: int, count: int | None = None, offset: int = 0) -> np.ndarray:
    """``count`` integers of ``width`` bits after ``offset`` bits; as many as there are, if the data end first."""
    data = np.frombuffer(data, np.uint8) if not isinstance(data, np.ndarray) else data
    if width == 0:
        return np.zeros(count or 0, np.int64)
    have = max(0, (len(data) * 8 - offset) // width)
    count = have if count is None else min(count, have)
    if offset == 0 and width in (8, 16, 32):
        return np.frombuffer(data.tobytes(), f">u{width // 8}", count).astype(np.int64)
    starts = offset + np.arange(count, dtype=np.int64) * width
    return unpack_at(data, starts, np.full(count, width, np.int64))


def bit_rows(values: np.ndarray, width: int) -> np.ndarray:
    """The lowest ``width`` bits of each value, highest first."""
    return np.unpackbits(values.astype(">u4").view(np.uint8).reshape(len(values), 4), axis=1)[:, 32 - width :]


def pack(values: np.ndarray, width: int, offset: int = 0) -> bytes:
    """The reverse of ``unpack``, filled up with zero bits to whole octets."""
    if width == 0:
        return b"\0" * octets(offset)
    bits = bit_rows(np.asarray(values), width).ravel()
    return np.packbits(np.concatenate([np.zeros(offset, np.uint8), bits])).tobytes()


def round_half_away(x: np.ndarray) -> np.ndarray:
    """Halves go away from zero, as SQL's round does; numpy's own goes to even."""
    t = np.trunc(x)
    return t + np.sign(x) * (np.abs(x - t) >= 0.5)
