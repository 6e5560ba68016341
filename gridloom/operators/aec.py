"""Adaptive entropy coding (CCSDS 121.0-B, lossless): decoding, and an encoder for tests and writing.

Samples come in blocks; a block names its coding option: zero blocks, second extension, sample splitting with k low bits
set apart, or no compression. With preprocessing, what is coded are the mapped differences between neighbours, after a
plain reference sample at the start of each interval.
"""

from __future__ import annotations

import numpy as np

from ..bits import octets
from ..errors import DecodeError

#: Options mask.
SIGNED, THREE_BYTES, MSB, PREPROCESS, RESTRICTED, PAD = 1, 2, 4, 8, 16, 32
#: A run of zero blocks coded as this many goes to the end of the segment.
REST_OF_SEGMENT, SEGMENT = 5, 64


class Bits:
    """Reads bits off octets, most significant first."""

    def __init__(self, data: bytes):
        self.value, self.left = int.from_bytes(data, "big"), 8 * len(data)
        self.bits = np.unpackbits(np.frombuffer(data, np.uint8))
        self.ones = np.flatnonzero(self.bits)
        self.at, self.next_one = 0, 0

    def take(self, n: int) -> int:
        if self.at + n > len(self.bits):
            raise DecodeError("the coded data end too early")
        out = 0
        for b in self.bits[self.at : self.at + n].tolist():
            out = out << 1 | b
        self.at += n
        return out

    def many(self, n: int, width: int) -> np.ndarray:
        if self.at + n * width > len(self.bits):
            raise DecodeError("the coded data end too early")
        rows = self.bits[self.at : self.at + n * width].reshape(n, width).astype(np.int64)
        self.at += n * width
        return rows @ (1 << np.arange(width - 1, -1, -1, dtype=np.int64))

    def unary(self, n: int) -> np.ndarray:
        """n numbers, each as so many zeros before a one."""
        first = int(np.searchsorted(self.ones, self.at))
        ends = self.ones[first : first + n]
        if len(ends) < n:
            raise DecodeError("the coded data end too early")
        out = np.diff(np.r_[self.at - 1, ends]) - 1
        self.at = int(ends[-1]) + 1 if n else self.at
        return out


def id_bits(bits: int, mask: int) -> int:
    if bits > 16:
        return 5
    if bits > 8:
        return 4
    if mask & RESTRICTED and bits <= 4:
        return 1 if bits <= 2 else 2
    return 3


def limits(bits: int, mask: int) -> tuple[int, int]:
    return (-(1 << bits - 1), (1 << bits - 1) - 1) if mask & SIGNED else (0, (1 << bits) - 1)


def unmap(first: int, mapped: np.ndarray, low: int, high: int) -> list[int]:
    """Samples from the reference sample and the mapped differences that follow it."""
    out, x = [first], first
    for d in mapped.tolist():
        room = min(x - low, high - x)
        if d <= 2 * room:
            x += d >> 1 if d & 1 == 0 else -(d + 1 >> 1)
        else:
            x += d - room if room == x - low else room - d
        out.append(x)
    return out


def decode(data: bytes, count: int, bits: int, block: int, interval: int, mask: int) -> np.ndarray:
    """``count`` samples of ``bits`` bits."""
    r, width = Bits(data), id_bits(bits, mask)
    uncompressed = (1 << width) - 1
    preprocess = bool(mask & PREPROCESS)
    low, high = limits(bits, mask)
    out: list[int] = []
    while len(out) < count:
        # one reference interval
        coded: list[np.ndarray] = []
        blocks, reference = 0, None
        while blocks < interval and len(out) + blocks * block < count:
            head = preprocess and blocks == 0
            n = block - head
            option = r.take(width)
            if option == 0:
                second = r.take(1)
                if head:
                    reference = r.take(bits)
                if second:
                    pairs = r.unary(block // 2)
                    beta = ((np.sqrt(8 * pairs + 1) - 1) // 2).astype(np.int64)
                    d = pairs - beta * (beta + 1) // 2
                    values = np.stack([beta - d, d], axis=1).ravel()
                    coded.append(values[int(head) :])
                    blocks += 1
                else:
                    run = int(r.unary(1)[0]) + 1
                    if run == REST_OF_SEGMENT:
                        run = min(interval - blocks, SEGMENT - blocks % SEGMENT)
                    elif run > REST_OF_SEGMENT:
                        run -= 1
                    coded.append(np.zeros(run * block - head, np.int64))
                    blocks += run
            elif option == uncompressed:
                values = r.many(block, bits)
                if head:
                    reference, values = int(values[0]), values[1:]
                coded.append(values)
                blocks += 1
            else:
                if head:
                    reference = r.take(bits)
                k = option - 1
                values = r.unary(n)
                coded.append(values << k | r.many(n, k) if k else values)
                blocks += 1
        values = np.concatenate(coded)
        if preprocess:
            first = reference - (1 << bits) if mask & SIGNED and reference >> bits - 1 else reference
            out += unmap(first, values, low, high)
        else:
            out += values.tolist()
        if mask & PAD:
            r.at = -(-r.at // 8) * 8
    return np.array(out[:count], np.int64)


def encode(samples: np.ndarray, bits: int, block: int, interval: int, mask: int) -> bytes:
    """Zero blocks one at a time, else the shortest of second extension, splitting and no compression."""
    out: list[str] = []
    width = id_bits(bits, mask)
    low, high = limits(bits, mask)
    samples = [int(x) for x in samples]
    samples += [samples[-1]] * (-len(samples) % block)
    for at in range(0, len(samples), block * interval):
        part = samples[at : at + block * interval]
        values, x = list(part), part[0]
        if mask & PREPROCESS:
            for i, y in enumerate(part[1:], 1):
                d, room = y - x, min(x - low, high - x)
                values[i] = (2 * d if d >= 0 else -2 * d - 1) if abs(d) <= room else room + abs(d)
                x = y
        for b in range(0, len(values), block):
            head = bool(mask & PREPROCESS) and b == 0
            v = values[b + head : b + block]
            ref = format(part[0] % (1 << bits), f"0{bits}b") if head else ""
            if not any(v):
                out.append("0" * width + "0" + ref + "1")
                continue
            cost = {k: sum((y >> k) + 1 + k for y in v) for k in range(min(bits, (1 << width) - 2))}
            best = min(cost, key=cost.get, default=None)
            every = [0] * head + v
            pairs = [(x + y) * (x + y + 1) // 2 + y for x, y in zip(every[::2], every[1::2], strict=True)]
            doubled = sum(pairs) + len(pairs) + 1
            if doubled < min(cost.get(best, doubled + 1), len(v) * bits):
                out.append("0" * width + "1" + ref + "".join("0" * y + "1" for y in pairs))
            elif best is not None and cost[best] < len(v) * bits:
                out.append(format(best + 1, f"0{width}b") + ref + "".join("0" * (y >> best) + "1" for y in v) + "".join(format(y & (1 << best) - 1, f"0{best}b") for y in v if best))
            else:
                plain = ([part[0] % (1 << bits)] if head else []) + v
                out.append("1" * width + "".join(format(y % (1 << bits), f"0{bits}b") for y in plain))
        if mask & PAD:
            out.append("0" * (-sum(map(len, out)) % 8))
    text = "".join(out)
    text += "0" * (-len(text) % 8)
    return int(text, 2).to_bytes(octets(len(text)), "big")
