"""Byte-pair encoding of whole texts with the tokenizers library, and its reverse.

The rank file of a byte-level vocabulary is turned into a ``tokenizers`` model: each byte is a character of the usual
byte-to-character table, and every pair of tokens that make up a third is a merge, in the order of the third's rank. That is
the rank rule (always the adjacent pair of lowest rank): a list with one pair a token would differ from it where a token can
be reached by several. Texts are cut where a word ends and white space or punctuation begins, which is always a boundary of
the splitting pattern, so that a chunk is encoded alike alone and in its text; each distinct chunk of an Arrow batch is
encoded once by the library and its ids are spread to all places by numpy. The library's ids are the result; the tests hold
them against the rank rule.

Decoding takes each id's characters from the library's vocabulary, turns them into bytes by the reversed table and joins the
bytes, so that characters split over tokens come back whole; ids outside the vocabulary decode to nothing. Offsets are those
of the characters that a token has bytes of, so that tokens within one character share it.

Defined results: a null text is an empty one, with no ids; rows with equal doc_id are rows of their own; an empty
table gives an empty result; other columns are ignored, or kept by name (a column that is called like a new one gives way).
"""

from __future__ import annotations

import base64
import hashlib
import os
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, ranges, ship, slices, text_buffer

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: White space of one byte.
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
#: A word of ASCII letters ends before ASCII punctuation; only an apostrophe may belong to what is before it.
LETTER, PUNCTUATION, UPPER = np.zeros(256, bool), np.zeros(256, bool), np.zeros(256, bool)
UPPER[65:91] = True
LETTER[65:91] = LETTER[97:123] = True
PUNCTUATION[[c for c in range(33, 127) if not chr(c).isalnum() and c != 39]] = True
#: White space beyond those: a text with any is encoded whole. First bytes of their UTF-8 forms.
WIDE_SPACE = regex.compile(r"[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
WIDE_FIRST = np.zeros(256, bool)
WIDE_FIRST[[0x1C, 0x1D, 0x1E, 0x1F, 0xC2, 0xE1, 0xE2, 0xE3]] = True
#: Distinct chunks in one generation of a worker's memory; it keeps two, and what is used again moves to the younger.
MEMORY = 300_000
#: Chunks that the library encodes in one call; what it makes of them is large.
CALL = 4096


def byte_characters() -> list[str]:
    """Character of each byte: printable ones stand for themselves, the others follow from U+0100 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@lru_cache(maxsize=2)
def rank_tokenizer(path: str, pattern: str):
    """A tokenizers model of a rank file, and the bytes of each id."""
    from tokenizers import Regex, Tokenizer, models, pre_tokenizers

    ranks, chars = read_ranks(path), byte_characters()
    name = {token: "".join(chars[b] for b in token) for token in ranks}
    merges = []
    for token in sorted(ranks, key=ranks.__getitem__):
        for i in range(1, len(token)):
            if token[:i] in ranks and token[i:] in ranks:
                merges.append((name[token[:i]], name[token[i:]]))
    t = Tokenizer(models.BPE(vocab={name[k]: v for k, v in ranks.items()}, merges=merges))
    t.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(Regex(pattern), "isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    byte_of = {c: b for b, c in enumerate(chars)}
    vocabulary = t.get_vocab(with_added_tokens=False)
    names = [b""] * (max(vocabulary.values()) + 1)
    for characters, i in vocabulary.items():
        names[i] = bytes(map(byte_of.__getitem__, characters))
    return t, names


class Memory:
    """Ids of the chunks met so far, in one array."""

    def __init__(self):
        self.known: dict[str, int] = {}
        self.ids, self.starts = np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def add(self, chunks: list[str], ids: np.ndarray, sizes: np.ndarray) -> None:
        self.known.update(zip(chunks, range(len(self.known), len(self.known) + len(chunks)), strict=True))
        self.ids = np.concatenate([self.ids, ids])
        self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(sizes)])

    def get(self, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sizes = self.starts[code + 1] - self.starts[code]
        return self.ids[np.repeat(self.starts[code], sizes) + ranges(sizes)], sizes


def flattened(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.fromiter(map(len, lists), np.int64, len(lists))
    return np.fromiter(chain.from_iterable(lists), np.uint32, int(sizes.sum())), sizes


class ChunkEncoder:
    """Encodes Arrow string columns; the library sees a distinct chunk once while it is remembered."""

    def __init__(self, encode, wide_space_splits: bool, folds: bool = False, cuts: bool = True, specials: tuple[str, ...] = ()):
        """encode: list of texts -> ids of all, one after the other, and the number of each.

        wide_space_splits: chunks may be cut next to wide white space too. folds: the encoder lower-cases, so that A-Z may
        be folded first; not before a byte beyond ASCII, which may be a mark that composes with small letters only.
        cuts: texts may be cut into chunks at all. specials: a text with one of these strings is encoded whole, as it is.
        """
        self.encode, self.splits, self.folds, self.cuts = encode, wide_space_splits, folds, cuts
        self.specials = "|".join(map(regex.escape, specials))
        self.young, self.old = Memory(), Memory()

    def codes(self, chunks: list[str]) -> np.ndarray:
        """Places of distinct chunks in the younger memory, into which they come if need be."""
        if len(self.young.known) + len(chunks) > MEMORY and self.young.known:
            self.young, self.old = Memory(), self.young
        young, old = self.young, self.old
        missing = [c for c in chunks if c not in young.known]
        again = [c for c in missing if c in old.known]
        if again:
            young.add(again, *old.get(np.fromiter((old.known[c] for c in again), np.int64, len(again))))
        new = [c for c in missing if c not in young.known] if again else missing
        if new:
            young.add(new, *self.encode(new))
        return np.fromiter((young.known[c] for c in chunks), np.int64, len(chunks))

    def column(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows, one after the other, and the number of ids of each row."""
        data, offsets = text_buffer(texts)
        n = len(offsets) - 1
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(n, np.int64)
        cut, upper = np.zeros(len(data), bool), np.zeros(len(data), bool)
        if self.cuts:
            space = SPACE[data]
            cut[1:] = space[1:] & ~space[:-1]
            cut[1:] |= LETTER[data[:-1]] & PUNCTUATION[data[1:]]
        if self.folds:
            upper = UPPER[data]
            upper[:-1] &= data[1:] < 128
        if not self.splits:
            maybe = np.unique(np.searchsorted(offsets, np.flatnonzero(WIDE_FIRST[data]), side="right") - 1)
            for i in maybe:
                if WIDE_SPACE.search(texts[i].as_py()):
                    cut[offsets[i] : offsets[i + 1]] = False
        if self.specials:
            for i in np.flatnonzero(pc.match_substring_regex(texts, self.specials, ignore_case=True).fill_null(False).to_numpy(zero_copy_only=False)):
                cut[offsets[i] : offsets[i + 1]] = upper[offsets[i] : offsets[i + 1]] = False
        if self.folds:
            data = data + (upper * np.uint8(32))
        first = offsets[:-1][np.diff(offsets) > 0]
        cut[first] = True
        at = np.flatnonzero(cut)
        ends = np.r_[at[1:], len(data)]
        bounds = np.r_[at, len(data)].astype(np.int64)
        chunks = pa.Array.from_buffers(pa.large_string(), len(at), [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(data))])
        found = chunks.dictionary_encode()
        code = self.codes(found.dictionary.to_pylist())[found.indices.to_numpy()]
        flat, size = self.young.get(code)
        row = np.searchsorted(offsets, ends, side="left") - 1  # the row in which a chunk ends
        return flat, np.bincount(row, size, n).astype(np.int64)


@lru_cache(maxsize=1)
def byte_encoder(path: str, pattern: str) -> ChunkEncoder:
    t = rank_tokenizer(path, pattern)[0]

    def encode(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        return flattened([e.ids for i in range(0, len(texts), CALL) for e in t.encode_batch_fast(texts[i : i + CALL], add_special_tokens=False)])

    return ChunkEncoder(encode, wide_space_splits=False)


def fields_of(df: DataFrame, names: list[str]) -> str:
    return "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in df.schema if f.name in names)


def others(df: DataFrame, *new: str) -> list[str]:
    """Columns that keep their place beside the new ones."""
    return [c for c in df.columns if c.lower() not in new]


def encode_texts(docs: DataFrame, path: str, pattern: str, keep: bool = False) -> DataFrame:
    """(doc_id, ids array<int>, starts, ends) of every row; with ``keep``, all columns of ``docs`` and these.

    starts, ends: code points of the text that each token has bytes of, the end excluded.
    """
    ship(docs.sparkSession)
    source = docs if keep else docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text"))
    names = others(source, "ids", "starts", "ends") if keep else ["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, decoder = byte_encoder(path, pattern), Decoder(rank_tokenizer(path, pattern)[1])
        for whole in batches:
            for b in slices(whole, "text"):
                flat, sizes = encoder.column(b.column("text"))
                at = pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32))
                lists = [pa.ListArray.from_arrays(at, pa.array(x.astype(np.int32))) for x in (flat, *decoder.offsets(flat.astype(np.int64), sizes))]
                yield pa.RecordBatch.from_arrays([*[b.column(n) for n in names], *lists], names=[*names, "ids", "starts", "ends"])

    return arrow_map(source, run, f"{fields_of(source, names)}ids array<int>, starts array<int>, ends array<int>")


class Decoder:
    """Bytes of id sequences, by a table of all tokens' bytes."""

    def __init__(self, names: list[bytes]):
        self.data = np.frombuffer(b"".join(names), np.uint8)
        self.sizes = np.array([*map(len, names), 0], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes

    def __call__(self, ids: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all rows and the n+1 offsets; ids one row after the other."""
        ids = np.where((ids < 0) | (ids >= len(self.sizes) - 1), len(self.sizes) - 1, ids)
        size = self.sizes[ids]
        data = self.data[np.repeat(self.starts[ids], size) + ranges(size)]
        ends = np.r_[0, np.cumsum(size)]
        return data, ends[np.r_[0, np.cumsum(sizes)]]

    def within(self, ids: np.ndarray) -> np.ndarray:
        """Whether each token begins within a character."""
        return (self.data[self.starts[ids]] & 0xC0) == 0x80

    def offsets(self, ids: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last (excluded) code point, within its row, that each token has bytes of."""
        data, rows = self(ids, sizes)
        lead = np.r_[0, np.cumsum((data & 0xC0) != 0x80)]  # characters that begin before each byte
        ends = np.cumsum(self.sizes[ids])
        starts = ends - self.sizes[ids]
        before = np.repeat(lead[rows[:-1]], sizes)
        first = lead[np.minimum(starts + 1, len(data))] - 1  # the character that the first byte is of
        return first - before, lead[ends] - before


def decode_ids(encoded: DataFrame, path: str, pattern: str, keep: bool = False) -> DataFrame:
    """(doc_id, bytes binary) of every row of (doc_id, ids); with ``keep``, all columns and bytes."""
    ship(encoded.sparkSession)
    source = encoded if keep else encoded.select("doc_id", "ids")
    names = others(source, "bytes") if keep else ["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(rank_tokenizer(path, pattern)[1])
        for whole in batches:
            for i in range(0, whole.num_rows, 512):
                b = whole.slice(i, 512)
                lists = b.column("ids")
                data, ends = decoder(lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64), lists.value_lengths().fill_null(0).to_numpy().astype(np.int64))
                out = pa.Array.from_buffers(pa.large_binary(), b.num_rows, [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(data)]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([*[b.column(n) for n in names], out], names=[*names, "bytes"])

    return arrow_map(source, run, f"{fields_of(source, names)}bytes binary")


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """All columns of ``docs`` but text, and ids array<int> and text: what the ids decode to. One worker does both steps."""
    ship(docs.sparkSession)
    names = others(docs, "ids", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, decoder = byte_encoder(path, pattern), Decoder(rank_tokenizer(path, pattern)[1])
        for whole in batches:
            for b in slices(whole, "text", 1 << 20):
                flat, sizes = encoder.column(b.column("text"))
                data, ends = decoder(flat.astype(np.int64), sizes)
                ids = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32)), pa.array(flat.astype(np.int32)))
                text = pa.Array.from_buffers(pa.large_string(), b.num_rows, [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(data)])
                text.validate(full=True)
                yield pa.RecordBatch.from_arrays([*[b.column(n) for n in names], ids, text.cast(pa.string())], names=[*names, "ids", "text"])

    return arrow_map(docs, run, f"{fields_of(docs, names)}ids array<int>, text string")


def digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256, n_split): encoding and decoding in one pass, only digests leave the worker.

    n_split: tokens that begin within a character.
    """
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, decoder = byte_encoder(path, pattern), Decoder(rank_tokenizer(path, pattern)[1])
        for whole in batches:
            for b in slices(whole, "text"):
                flat, sizes = encoder.column(b.column("text"))
                data, ends = decoder(flat.astype(np.int64), sizes)
                at = np.r_[0, np.cumsum(sizes)]
                raw, data = flat.astype("<u4"), data.tobytes()
                ids = [hashlib.sha256(raw[i:j]).hexdigest() for i, j in zip(at, at[1:], strict=False)]
                back = [hashlib.sha256(data[i:j]).hexdigest() for i, j in zip(ends, ends[1:], strict=False)]
                split = np.bincount(np.repeat(np.arange(b.num_rows), sizes)[decoder.within(flat)], minlength=b.num_rows)
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(sizes), pa.array(ids), pa.array(back), pa.array(split.astype(np.int64))], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "n_split"])

    return arrow_map(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text")), run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, n_split long")
