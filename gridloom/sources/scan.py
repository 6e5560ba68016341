"""Section scan (A): one pass over a file's octets that reads headers and skips what isn't asked for.

A file may hold other octets between messages; a message begins at the next ``GRIB``. Each section gives
(message, number, offset, size, template number, payload); what is wrong is raised as ``ParseError`` after the sections
before it.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import BinaryIO, NamedTuple

from ..errors import ParseError

MAGIC, END = b"GRIB", b"7777"
WINDOW = 1 << 16
#: Where the template number stands in a section with its header.
TEMPLATE_AT = {3: 12, 4: 7, 5: 9}
#: What to keep of the octets: nothing, all but Section 7 and the bits of Section 6, or all.
PAYLOADS = ("none", "meta", "all")


class Section(NamedTuple):
    msg: int
    num: int
    offset: int
    size: int
    template_num: int | None
    payload: bytes | None


def find_magic(file: BinaryIO, at: int, size: int) -> int:
    """Place of the next ``GRIB`` that has a whole Section 0, -1 without one."""
    if at + 16 <= size:  # mostly one message follows the other
        file.seek(at)
        if file.read(4) == MAGIC:
            return at
    while at + 16 <= size:
        file.seek(at)
        part = file.read(min(WINDOW, size - at))
        found = part.find(MAGIC)
        if found >= 0:
            return at + found if at + found + 16 <= size else -1
        at += max(1, len(part) - 3)
    return -1


def message_ranges(file: BinaryIO, size: int, octets: int) -> list[tuple[int, int, int]]:
    """(start, end, first message) of runs of whole messages of about ``octets`` octets; reads Sections 0 only."""
    starts, at = [], 0
    while (at := find_magic(file, at, size)) >= 0:
        starts.append(at)
        file.seek(at + 8)
        at += max(16, int.from_bytes(file.read(8), "big"))
    out: list[tuple[int, int, int]] = []
    for i, start in enumerate(starts):
        end = starts[i + 1] if i + 1 < len(starts) else size
        if out and end - out[-1][0] <= octets:
            out[-1] = (out[-1][0], end, out[-1][2])
        else:
            out.append((start, end, i))
    return out


def scan(file: BinaryIO, size: int, payload: str = "meta", at: int = 0, msg: int = 0) -> Iterator[Section]:
    """Sections from octet ``at`` to octet ``size``; ``msg`` is the number of the first message there."""
    while (at := find_magic(file, at, size)) >= 0:
        file.seek(at)
        head = file.read(16)
        if head[7] != 2:
            raise ParseError("GRIBVersionMismatch", head[7])
        left = int.from_bytes(head[8:16], "big") - 16
        yield Section(msg, 0, at, 16, None, head if payload != "none" else None)
        at += 16
        while left > 0:
            file.seek(at)
            if left == 4:
                tail = file.read(4)
                if tail != END:
                    raise ParseError("EndSectionMismatch" if len(tail) == 4 else "ReadError", at)
                yield Section(msg, 8, at, 4, None, tail if payload != "none" else None)
                at, left = at + 4, 0
                continue
            head = file.read(5)
            if len(head) < 5:
                raise ParseError("ReadError", at)
            length, num = int.from_bytes(head[:4], "big"), head[4]
            if not 1 <= num <= 7:
                raise ParseError("UnknownSectionNumber", num)
            if length < 5 or length > left or at + length > size:
                raise ParseError("ReadError", at)
            template = TEMPLATE_AT.get(num)
            keep = 0 if payload == "none" else length
            if payload == "meta" and num in (6, 7):
                keep = 6 if num == 6 else 0
            want = max(keep, template + 2 if template else 0, 5)
            if want > 5:
                head += file.read(min(want, length) - 5)
            number = int.from_bytes(head[template : template + 2], "big") if template else None
            yield Section(msg, num, at, length, number, head[:keep] if keep else None)
            at, left = at + length, left - length
        msg += 1
