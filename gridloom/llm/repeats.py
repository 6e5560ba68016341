"""Repeated byte strings: every byte covered by a string of ``length`` bytes that also starts in an earlier document.

Longest-previous-factor arrays: in the order of all suffixes, the previous and the next suffix with a smaller document bound
what a suffix shares with earlier text; where the greater of the two reaches ``length``, the string that begins there is a
later copy, and the first one stays. One suffix array of everything can't be built on a cluster, so it is built in slices
that lose no match:

1. Each string of ``length`` bytes has an anchor, its least k-gram by hash (the leftmost of equals). Equal strings have
   equal anchors at equal places, so strings with different anchors need not meet.
2. Documents are dealt into groups of about ``GROUP`` bytes. A group sends each different anchor hash once, to the slice of
   the hash, and is told which of them other documents have too. The rest of the text can't repeat and leaves the game.
3. For each such anchor the run of strings that it stands for goes to its slice, as one stretch of bytes: once for a group,
   with the earliest document there. A slice joins equal stretches, builds the suffix array of its strings with the lengths
   that neighbours share (eight bytes a round, up to ``length``), and from it the longest previous factor of each.
4. The group is told, for each of its stretches, the earliest document that has it and which of its strings are met earlier;
   it finds the stretches' places again and takes the spans out.

So a slice holds a row for each group that has an anchor, however many documents do; groups and slices are numbered from the
bytes there are. The strings of an anchor that more than ``HOT`` groups have are dealt one by one, by hashes of their own.

Texts are shuffled once, compressed, into a table that is bucketed by group, which later steps read without a shuffle. Equal
texts are compared by digest first, so that only the earliest of them takes part.

Defined results: documents are ordered by doc_id, one without doc_id before all others; rows of equal doc_id don't make
each other later; a null text is empty; texts shorter than ``length`` bytes lose nothing; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from functools import partial
from uuid import uuid4

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .common import arrow_map, cut, ranges, ship, text_buffer, trim

LENGTH, GRAM = 50, 16
#: Bytes of text in a group and, about, behind a slice and a bucket of the table; groups that make an anchor a hot one.
GROUP, SLICE, BUCKET, HOT = 16 << 20, 16 << 20, 64 << 20, 4096
EMPTY = hashlib.sha256(b"").hexdigest()
FIRST = -(1 << 63)  # stands for a null doc_id
MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """A hash of the ``gram`` bytes that begin at each place; ``gram`` is a multiple of eight."""
    n = len(data) - gram + 1
    word = data[: len(data) - 7].astype(np.uint64)
    for k in range(1, 8):
        word |= data[k : len(data) - 7 + k].astype(np.uint64) << np.uint64(8 * k)
    h = np.zeros(n, np.uint64)
    for at in range(0, gram, 8):
        h = (h ^ word[at : at + n]) * MIX[0]
        h ^= h >> np.uint64(29)
    h *= MIX[1]
    return h ^ h >> np.uint64(32)


def owners(data: np.ndarray, ends: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Strings of ``length`` bytes that lie within one document: their places, their anchors' places and all hashes.

    ends: for each byte the end of its document.
    """
    if len(data) < length:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(0, np.uint64)
    h = gram_hashes(data, gram)
    best, at = h, np.arange(len(h), dtype=np.int32)
    span, wide = 1, length - gram + 1
    while span < wide:
        step = min(span, wide - span)
        left, right = best[:-step], best[step:]
        later = right < left
        at = np.where(later, at[step:], at[:-step])
        best = np.where(later, right, left)
        span += step
    whole = np.flatnonzero(np.arange(len(best)) + length <= ends[: len(best)])
    return whole, at[whole].astype(np.int64), h


def short(h: np.ndarray) -> np.ndarray:
    """48 bits of a hash: enough to tell most anchors apart; what falls together costs work, not results."""
    return h >> np.uint64(16)


def inflated(batch: pa.RecordBatch, most: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Row ranges with about ``most`` bytes of text: (first, last, bytes, n+1 offsets)."""
    held: list[bytes] = []
    size, first = 0, 0
    for i, z in enumerate(batch.column("z").to_pylist()):
        held.append(zlib.decompress(z))
        size += len(held[-1])
        if size >= most or i - first >= 8191 or i == batch.num_rows - 1:
            yield first, i + 1, np.frombuffer(b"".join(held), np.uint8), np.r_[0, np.cumsum([*map(len, held)])]
            held, size, first = [], 0, i + 1


def deltas(values: np.ndarray) -> bytes:
    """Sorted values as differences, four bytes each if all fit."""
    d = np.diff(values, prepend=values[:1])
    head = values[:1].astype("<u8").tobytes()
    return b"\4" + head + d.astype("<u4").tobytes() if d.max(initial=0) < 1 << 32 else b"\10" + head + d.astype("<u8").tobytes()


def undelta(data: bytes) -> np.ndarray:
    d = np.frombuffer(data, f"<u{data[0]}", -1, 9).astype(np.uint64)
    return np.cumsum(d, dtype=np.uint64) + np.frombuffer(data, "<u8", 1, 1)


def per_slice(df: DataFrame, work, schema: str, slices: int) -> DataFrame:
    """Deal packed rows by slice and give the rows of each slice to ``work`` at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, now = [], None
        for b in batches:
            for row in b.to_pylist():
                if row["slice"] != now and held:
                    yield work(held)
                    held = []
                now = row["slice"]
                held.append(row)
        if held:
            yield work(held)

    return arrow_map(df.repartition(slices, "slice").sortWithinPartitions("slice"), run, schema)


#: What a group is told: its first rows of a text (u), its shared anchors (data: hashes, more: hot ones), verdicts on its stretches.
SIDE = "g int, kind int, u long, data binary, more binary"
FIRST_ROW, SHARED, VERDICT = range(3)


def per_group(texts: DataFrame, told: DataFrame, work, schema: str) -> DataFrame:
    """``work`` on each group: a table of its first rows (u, o, z) and what it is told, by kind."""

    def run(rows: pa.Table, side: pa.Table) -> pa.Table:
        kinds = {k: side.filter(pc.equal(side.column("kind"), k)) for k in (FIRST_ROW, SHARED, VERDICT)}
        own = rows.filter(pc.is_in(rows.column("u"), kinds[FIRST_ROW].column("u").combine_chunks())).sort_by("u").combine_chunks()
        out = work(rows.column("g")[0].as_py() if rows.num_rows else -1, own, kinds)
        trim()
        return out

    return texts.select("g", "u", "o", "z").groupBy("g").cogroup(told.groupBy("g")).applyInArrow(run, schema)


def table_of(columns: dict[str, list], kinds: dict[str, pa.DataType]) -> pa.Table:
    return pa.table({k: pa.array(columns[k], t) for k, t in kinds.items()})


def texts_of(own: pa.Table) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    for b in own.to_batches():
        yield from inflated(b)


def anchors(g: int, own: pa.Table, _, slices: int, length: int, gram: int) -> pa.Table:
    """(slice, g, hashes, many): the different anchors of a group by slice, and whether several of its documents have them."""
    hashes, docs = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for first, _, data, offsets in texts_of(own):
        _, at, h = owners(data, np.repeat(offsets[1:], np.diff(offsets)), length, gram)
        at = at[np.r_[True, at[1:] != at[:-1]]] if len(at) else at
        hashes.append(short(h[at]))
        docs.append(np.searchsorted(offsets, at, side="right") - 1 + first)
    h, d = np.concatenate(hashes), np.concatenate(docs)
    order = np.lexsort((d, h))
    h, d = h[order], d[order]
    begin = np.flatnonzero(np.r_[True, h[1:] != h[:-1]]) if len(h) else np.zeros(0, np.int64)
    end = np.r_[begin[1:], len(h)] - 1
    many = d[begin] != d[end] if len(begin) else np.zeros(0, bool)
    h = h[begin]
    key = h % np.uint64(slices)
    order = np.argsort(key, kind="stable")
    h, many, key = h[order], many[order], key[order]
    mine, begin = np.unique(key, return_index=True)
    parts = [slice(i, j) for i, j in zip(begin, [*begin[1:], len(key)], strict=True)] if len(key) else []
    return pa.table({"slice": pa.array(mine.astype(np.int32)), "g": pa.array([g] * len(mine), pa.int32()), "hashes": pa.array([deltas(h[p]) for p in parts], pa.binary()), "many": pa.array([np.packbits(many[p]).tobytes() for p in parts], pa.binary())})


def shared_anchors(rows: list[dict], hot: int) -> pa.RecordBatch:
    """For each group in a slice the anchors that several documents have, and which of those very many groups have."""
    each = [undelta(r["hashes"]) for r in rows]
    h = np.concatenate(each)
    many = np.concatenate([np.unpackbits(np.frombuffer(r["many"], np.uint8), count=len(x)) for r, x in zip(rows, each, strict=True)])
    order = np.argsort(h, kind="stable")
    starts = np.flatnonzero(np.r_[True, h[order][1:] != h[order][:-1]])
    number = np.diff(np.r_[starts, len(h)])
    common, often = np.zeros(len(h), bool), np.zeros(len(h), bool)
    common[order] = np.repeat((number > 1) | (np.maximum.reduceat(many[order], starts) > 0), number)
    often[order] = np.repeat(number > hot, number)
    g, data, more, at = [], [], [], 0
    for r, x in zip(rows, each, strict=True):
        own = slice(at, at + len(x))
        at += len(x)
        if common[own].any():
            g.append(r["g"])
            data.append(deltas(x[common[own]]))
            more.append(np.packbits(often[own][common[own]]).tobytes())
    n = len(g)
    return pa.RecordBatch.from_pydict({"g": pa.array(g, pa.int32()), "kind": pa.array([SHARED] * n, pa.int32()), "u": pa.nulls(n, pa.int64()), "data": pa.array(data, pa.binary()), "more": pa.array(more, pa.binary())})


def binaries(data: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """Binary values of these sizes that lie one after the other in ``data``."""
    return pa.Array.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(np.r_[0, np.cumsum(sizes)].astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))])


class Stretches:
    """The stretches of a group that may repeat: where they are, and which are equal, by slice."""

    def __init__(self, own: pa.Table, told: pa.Table, slices: int, length: int, gram: int):
        each = [undelta(x) for x in told.column("data").to_pylist()]
        shared = np.concatenate([np.zeros(0, np.uint64), *each])
        often = np.concatenate([np.zeros(0, np.uint8), *[np.unpackbits(np.frombuffer(m, np.uint8), count=len(x)) for m, x in zip(told.column("more").to_pylist(), each, strict=True)]])
        order = np.argsort(shared)
        shared, often = shared[order], often[order] > 0
        none = np.zeros(0, np.int64)
        key, doc, at, size, pieces = [none], [none], [none], [none], [np.zeros(0, np.uint8)]
        for first, _, data, offsets in texts_of(own) if len(shared) else ():
            starts, anchor, h = owners(data, np.repeat(offsets[1:], np.diff(offsets)), length, gram)
            if not len(starts):
                continue
            begin = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]])
            end = np.r_[begin[1:], len(anchor)]
            hashes = short(h[anchor[begin]])
            place = np.minimum(np.searchsorted(shared, hashes), len(shared) - 1)
            hit = shared[place] == hashes
            begin, end, hashes, single = begin[hit], end[hit], hashes[hit], often[place[hit]]
            if single.any():  # one string a stretch, dealt by a hash of its own
                count = np.where(single, end - begin, 1)
                begin = np.repeat(begin, count) + np.where(np.repeat(single, count), ranges(count), 0)
                end, single, hashes = np.where(np.repeat(single, count), begin + 1, np.repeat(end, count)), np.repeat(single, count), np.repeat(hashes, count)
                hashes[single] = [xxh64_intdigest(data[i : i + length].tobytes()) for i in starts[begin[single]]]
            low = starts[begin]
            long = starts[end - 1] + length - low
            d = np.searchsorted(offsets, low, side="right") - 1
            key.append((hashes % np.uint64(slices)).astype(np.int64))
            doc.append(d + first)
            at.append(low - offsets[d])
            size.append(long)
            pieces.append(data[np.repeat(low, long) + ranges(long)])
        self.key, self.doc, self.at, self.size = map(np.concatenate, (key, doc, at, size))
        named = binaries(np.concatenate(pieces), self.size).dictionary_encode()
        self.which, self.pieces = named.indices.to_numpy().astype(np.int64), named.dictionary
        self.o = own.column("o").to_numpy()
        self.number = pc.binary_length(self.pieces).to_numpy() - length + 1  # strings of each piece
        self.slice_of = np.zeros(len(self.pieces), np.int64)
        self.slice_of[self.which] = self.key  # equal pieces have equal anchors
        self.first = np.full(len(self.pieces), np.iinfo(np.int64).max)
        np.minimum.at(self.first, self.which, self.o[self.doc])
        # pieces by slice: in a slice a piece is known by its place among them
        self.order = np.argsort(self.slice_of, kind="stable")
        self.slices, self.begin = np.unique(self.slice_of[self.order], return_index=True)
        self.end = np.r_[self.begin[1:], len(self.order)][: len(self.slices)]


def sent_stretches(g: int, own: pa.Table, told: dict[int, pa.Table], slices: int, length: int, gram: int) -> pa.Table:
    """(slice, g, o, strings, bytes): the different stretches of a group, each with its earliest document there."""
    found = Stretches(own, told[SHARED], slices, length, gram)
    columns = {"slice": [], "g": [], "o": [], "strings": [], "bytes": []}
    for s, i, j in zip(found.slices, found.begin, found.end, strict=True):
        mine = found.order[i:j]
        columns["slice"].append(int(s))
        columns["g"].append(g)
        columns["o"].append(found.first[mine].tobytes())
        columns["strings"].append(found.number[mine].astype("<u2").tobytes())
        columns["bytes"].append(zlib.compress(b"".join(found.pieces.take(pa.array(mine)).to_pylist()), 1))
    return table_of(columns, {"slice": pa.int32(), "g": pa.int32(), "o": pa.binary(), "strings": pa.binary(), "bytes": pa.binary()})


def suffix_array(text: np.ndarray, places: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Places in the order of the ``length`` bytes that begin there, and how many of them each shares with the one before.

    A round sorts by the next eight bytes what agrees so far; a place alone in its class has found its rank.
    """
    order, shared = places.copy(), np.zeros(len(places), np.int64)
    live, group = np.arange(len(places)), np.zeros(len(places), np.int64)
    width, begins = min(8, length), np.ones(len(places), bool)
    padded = np.r_[text, np.zeros(8, np.uint8)]
    words = np.ndarray(len(text) + 1, ">u8", padded, 0, (1,))  # the eight bytes from each place on
    for at in range(0, length, 8):
        if not len(live):
            break
        at = min(at, length - width)
        word = words[order[live] + at].astype(np.uint64) >> np.uint64(64 - 8 * width)
        by = np.lexsort((word, group)) if at else np.argsort(word)
        order[live], word = order[live][by], word[by]
        begins = np.r_[True, group[1:] != group[:-1]]
        differ = np.flatnonzero(~begins & np.r_[False, word[1:] != word[:-1]])
        off = word[differ] ^ word[differ - 1]
        shared[live[differ]] = at + sum((off >> np.uint64(8 * k) == 0).astype(np.int64) for k in range(1, width))
        begins[differ] = True
        group = np.cumsum(begins) - 1
        many = ~(begins & np.r_[begins[1:], True])
        live, group, begins = live[many], group[many], begins[many]
    shared[live[~begins]] = length
    return order, shared


def nearest_smaller(value: np.ndarray, shared: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each place the nearest before it with a smaller value (-1: none), and what all in between share.

    shared: what each shares with the one before. All places hop at once, each to where its last hop's target has hopped.
    """
    at, least = np.arange(-1, len(value) - 1), shared.copy()
    live = np.arange(len(value))
    while True:
        live = live[at[live] >= 0]
        live = live[value[at[live]] >= value[live]]
        if not len(live):
            return at, least
        to = at[live]
        least[live], at[live] = np.minimum(least[live], least[to]), at[to]


def longest_previous(value: np.ndarray, shared: np.ndarray) -> np.ndarray:
    """Longest-previous-factor array, in suffix order: the longest beginning shared with a suffix of a smaller value."""
    if not len(value):
        return np.zeros(0, np.int64)
    before, left = nearest_smaller(value, shared)
    after, right = nearest_smaller(value[::-1], np.r_[0, shared[:0:-1]])
    return np.maximum(np.where(before >= 0, left, 0), np.where(after >= 0, right, 0)[::-1])


def verdicts(rows: list[dict], length: int) -> pa.RecordBatch:
    """For each group in a slice: its stretches (which) that repeat, their earliest documents and the strings met earlier."""
    o = [np.frombuffer(r["o"], np.int64) for r in rows]
    strings = np.concatenate([np.frombuffer(r["strings"], "<u2") for r in rows]).astype(np.int64)
    named = binaries(np.frombuffer(b"".join(zlib.decompress(r["bytes"]) for r in rows), np.uint8), strings + length - 1).dictionary_encode()
    which = named.indices.to_numpy().astype(np.int64)
    text = np.frombuffer(named.dictionary.buffers()[2], np.uint8)
    bounds = np.frombuffer(named.dictionary.buffers()[1], np.int64, len(named.dictionary) + 1)
    # of equal stretches the earliest document stands for all
    local = np.concatenate(o)
    first = np.full(len(bounds) - 1, np.iinfo(np.int64).max)
    np.minimum.at(first, which, local)
    number = np.diff(bounds) - length + 1
    place = np.repeat(bounds[:-1], number) + ranges(number)
    order, shared = suffix_array(text, place, length)
    owner = np.empty(len(text), np.int32)
    owner[place] = np.repeat(np.arange(len(number), dtype=np.int32), number)
    met = np.zeros(len(text), bool)
    met[order] = longest_previous(first[owner[order]], shared) >= length
    met = met[place]
    slot = np.cumsum(number) - number
    anything = np.add.reduceat(met, slot) > 0
    out = {"g": [], "data": [], "more": []}
    at = 0
    for r, mine in zip(rows, o, strict=True):
        w = which[at : at + len(mine)]
        at += len(mine)
        tell = np.flatnonzero((first[w] < mine) | anything[w])
        if len(tell):
            w = w[tell]
            bits = met[np.repeat(slot[w], number[w]) + ranges(number[w])]
            out["g"].append(r["g"])
            out["data"].append(np.r_[np.int64(r["slice"]), np.int64(len(tell)), tell, first[w]].astype("<i8").tobytes())
            out["more"].append(np.packbits(bits).tobytes())
    n = len(out["g"])
    return pa.RecordBatch.from_pydict({"g": pa.array(out["g"], pa.int32()), "kind": pa.array([VERDICT] * n, pa.int32()), "u": pa.nulls(n, pa.int64()), "data": pa.array(out["data"], pa.binary()), "more": pa.array(out["more"], pa.binary())})


def spans_found(own: pa.Table, told: dict[int, pa.Table], slices: int, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, start, end) of what is met earlier."""
    said = {}
    for data, more in zip(told[VERDICT].column("data").to_pylist(), told[VERDICT].column("more").to_pylist(), strict=True):
        x = np.frombuffer(data, "<i8")
        said[int(x[0])] = x[2 : 2 + x[1]], x[2 + x[1] :], np.unpackbits(np.frombuffer(more, np.uint8)).astype(bool)
    found = Stretches(own, told[SHARED], slices, length, gram)
    first, number = found.first.copy(), found.number
    slot = np.cumsum(number) - number
    met = np.zeros(int(number.sum()), bool)
    for s, i, j in zip(found.slices, found.begin, found.end, strict=True):
        if s in said:
            tell, earliest, bits = said[s]
            tell = found.order[i:j][tell]
            first[tell] = earliest
            met[np.repeat(slot[tell], number[tell]) + ranges(number[tell])] = bits[: int(number[tell].sum())]
    late = found.o[found.doc] > first[found.which]
    any_met = np.add.reduceat(met, slot) > 0 if len(slot) else np.zeros(0, bool)
    some = ~late & any_met[found.which]
    w, n = found.which[some], number[found.which[some]]
    hit = met[np.repeat(slot[w], n) + ranges(n)]
    begin = (np.repeat(found.at[some], n) + ranges(n))[hit]
    return np.r_[found.doc[late], np.repeat(found.doc[some], n)[hit]], np.r_[found.at[late], begin], np.r_[found.at[late] + found.size[late], begin + length]


def merged(start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Maximal runs (start, end) of what some spans cover."""
    order = np.argsort(start, kind="stable")
    start, top = start[order], np.maximum.accumulate(end[order])
    new = np.flatnonzero(np.r_[True, start[1:] > top[:-1]])
    return np.stack([start[new], np.r_[top[new[1:] - 1], top[-1]]], axis=1)


def taken_out(_, own: pa.Table, told: dict[int, pa.Table], slices: int, length: int, gram: int) -> pa.Table:
    """(u, spans, n_removed, n_spans, kept_sha256) of the documents that lose something; spans: starts and ends, in bytes."""
    doc, start, end = spans_found(own, told, slices, length, gram)
    order = np.argsort(doc, kind="stable")
    doc, start, end = doc[order], start[order], end[order]
    begin = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]]) if len(doc) else doc
    columns = {"u": [], "spans": [], "n_removed": [], "n_spans": [], "kept_sha256": []}
    for i, j in zip(begin, [*begin[1:], len(doc)], strict=True) if len(doc) else ():
        spans = merged(start[i:j], end[i:j])
        text = zlib.decompress(own.column("z")[doc[i]].as_py())
        edges = [0, *spans.ravel().tolist(), len(text)]
        columns["u"].append(own.column("u")[doc[i]].as_py())
        columns["spans"].append(spans.ravel().tolist())
        columns["n_removed"].append(int((spans[:, 1] - spans[:, 0]).sum()))
        columns["n_spans"].append(len(spans))
        columns["kept_sha256"].append(hashlib.sha256(b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))).hexdigest())
    return table_of(columns, {"u": pa.int64(), "spans": pa.list_(pa.int64()), "n_removed": pa.int64(), "n_spans": pa.int64(), "kept_sha256": pa.string()})


def stored(docs: DataFrame, buckets: int, groups: int) -> tuple[DataFrame, str]:
    """(g, u, o, sha, n, z) of every row of ``docs``, in a table bucketed by g; u numbers the rows, z is the text compressed."""
    spark = docs.sparkSession

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 1024):
                part = b.slice(i, 1024)
                data, offsets = text_buffer(part.column("text"))
                data = data.tobytes()
                texts = [data[i:j] for i, j in zip(offsets, offsets[1:], strict=False)]
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in ("g", "u", "o")], pa.array([hashlib.sha256(t).digest() for t in texts], pa.binary()), pa.array(np.diff(offsets)), pa.array([zlib.compress(t, 1) for t in texts], pa.binary())], names=["g", "u", "o", "sha", "n", "z"])

    rows = docs.select(F.monotonically_increasing_id().alias("u"), F.coalesce(F.col("doc_id").cast("long"), F.lit(FIRST)).alias("o"), F.col("text").cast("string").alias("text"))
    rows = rows.withColumn("g", F.pmod(F.xxhash64("u"), F.lit(groups)).cast("int"))
    name = f"gridloom_texts_{uuid4().hex}"
    arrow_map(rows, run, "g int, u long, o long, sha binary, n long, z binary").repartition(buckets, "g").write.bucketBy(buckets, "g").sortBy("g").saveAsTable(name)
    return spark.table(name), name


def spans_of(docs: DataFrame, finish, length: int = LENGTH, gram: int = GRAM, group: int = GROUP, hot: int = HOT) -> DataFrame:
    """What ``finish`` makes of (texts, firsts, found): the stored texts, the earliest row of each text and what those lose.

    firsts: (sha, first: struct(o, u, g, n)); found: as of ``taken_out``.
    """
    spark = docs.sparkSession
    ship(spark)
    total = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    groups, slices, buckets = max(least, -(-total // group)), max(2 * least, -(-total // SLICE)), min(100_000, max(least, -(-total // BUCKET)))
    tasks = max(least, slices // 4)  # a task works on one slice after the other
    texts, name = stored(docs, buckets, groups)
    try:
        # written, so that the later join with all rows is one that Spark can split where many rows have one text
        firsts = cut(texts.groupBy("sha").agg(F.min(F.struct("o", "u", "g", "n")).alias("first")), "firsts")
        nothing = F.lit(None).cast("binary")
        told = firsts.where(F.col("first.n") >= length).select("first.g", F.lit(FIRST_ROW).alias("kind"), "first.u", nothing.alias("data"), nothing.alias("more"))
        step = {"slices": slices, "length": length, "gram": gram}
        sent = per_group(texts, told, partial(anchors, **step), "slice int, g int, hashes binary, many binary")
        told = told.unionByName(cut(per_slice(sent, partial(shared_anchors, hot=hot), SIDE, tasks), "shared"))
        sent = per_group(texts, told, partial(sent_stretches, **step), "slice int, g int, o binary, strings binary, bytes binary")
        told = told.unionByName(per_slice(sent, partial(verdicts, length=length), SIDE, tasks))
        found = per_group(texts, told, partial(taken_out, **step), "u long, spans array<long>, n_removed long, n_spans long, kept_sha256 string")
        return cut(finish(texts, firsts, found), "repeats")
    finally:
        spark.sql(f"drop table if exists {name}")


def cleaned(docs: DataFrame, length: int = LENGTH, **sizes: int) -> DataFrame:
    """(doc_id, text, spans) of every row: the text without what is removed, and (start, end) of that in bytes.

    Of a character that is cut in two the remaining bytes go as well.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, spans = [], []
            for r in b.to_pylist():
                text = zlib.decompress(r["z"])
                ends = [0, len(text)] if r["copy"] else r["spans"] or []
                edges = [0, *ends, len(text)]
                texts.append(b"".join(text[i:j] for i, j in zip(edges[::2], edges[1::2], strict=True)).decode("utf-8", "ignore"))
                spans.append([{"start": i, "end": j} for i, j in zip(ends[::2], ends[1::2], strict=True)])
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(texts, pa.string()), pa.array(spans, kind)], names=["doc_id", "text", "spans"])

    def finish(texts: DataFrame, firsts: DataFrame, found: DataFrame) -> DataFrame:
        rows = texts.join(firsts, "sha").join(found.select(F.col("u").alias("_u"), "spans"), F.col("first.u") == F.col("_u"), "left")
        copy = (F.col("o") > F.col("first.o")) & (F.col("n") >= length)
        rows = rows.select(F.when(F.col("o") != FIRST, F.col("o")).alias("doc_id"), "z", copy.alias("copy"), F.when(F.col("o") == F.col("first.o"), F.col("spans")).alias("spans"))
        return arrow_map(rows, run, "doc_id long, text string, spans array<struct<start: long, end: long>>")

    return spans_of(docs, finish, length, **sizes)


def repeats(docs: DataFrame, length: int = LENGTH, **sizes: int) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every row of ``docs`` (doc_id, text)."""

    def finish(texts: DataFrame, firsts: DataFrame, found: DataFrame) -> DataFrame:
        lost = found.drop("spans").withColumnRenamed("u", "_u")
        rows = texts.select("o", "sha", "n").join(firsts, "sha").join(lost, F.col("first.u") == F.col("_u"), "left")
        copy = (F.col("o") > F.col("first.o")) & (F.col("n") >= length)
        same = F.col("o") == F.col("first.o")
        pick = lambda whole, part, none: F.when(copy, whole).when(same & F.col("_u").isNotNull(), part).otherwise(none)
        return rows.select(
            F.when(F.col("o") != FIRST, F.col("o")).alias("doc_id"),
            F.col("n").alias("n_bytes"),
            pick(F.col("n"), F.col("n_removed"), F.lit(0)).cast("long").alias("n_removed"),
            pick(F.lit(1), F.col("n_spans"), F.lit(0)).cast("long").alias("n_spans"),
            pick(F.lit(EMPTY), F.col("kept_sha256"), F.lower(F.hex("sha"))).alias("kept_sha256"),
        )

    return spans_of(docs, finish, length, **sizes)
