"""Token-id files: ids packed in the fewest bits that hold the vocabulary.

A file holds the documents of one range of doc_id, in ascending order::

    magic "GLTK" | version u16 | bits u16
    blocks: BLOCK ids each (the last may have fewer), ``bits`` bits an id, lowest bit first, padded to whole bytes
    doc ids i64[d] | doc id present u8[d] | id starts u64[d + 1] | block offsets u64[b + 1]
    trailer: documents u64 | ids u64 | blocks u64 | BLOCK u32 | bits u32 | magic "GLTK"

All numbers are little-endian. The index is at the end, so that a writer streams with bounded memory, and any run of ids
is read by its blocks alone. Writers give a file its name only when it is whole, so a task that runs again, or twice,
leaves the same file. Files lie in the shared folder and are opened through its own file system.

Defined results: a null text has only the end id; a null doc_id sorts first and stays null; rows with equal doc_id follow
each other in order of their ids; an empty table makes no file and gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache
from uuid import uuid4

import numpy as np
import pyarrow as pa
import regex
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import CALL, ChunkEncoder, flattened
from .common import arrow_map, cut, new_path, range_bounds, range_bucket, ship, slices

MAGIC, VERSION, BLOCK = b"GLTK", 1, 4096
#: Between chunks that are encoded in one call, and how many those are.
MARK, JOINED = "\x00", 128
HEAD, TRAILER = struct.Struct("<4sHH"), struct.Struct("<QQQII4s")


def bits_for(vocabulary: int) -> int:
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """``bits`` bits of each id, lowest first, padded to whole bytes."""
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    each = np.unpackbits(ids.astype("<u4").view(np.uint8).reshape(len(ids), 4), axis=1, bitorder="little")
    return np.packbits(each[:, :bits], bitorder="little").tobytes()


def unpack(data: bytes | np.ndarray, bits: int, n: int, first: int = 0) -> np.ndarray:
    """``n`` ids from id ``first`` on; each is cut out of the eight bytes that begin where it begins."""
    data = np.frombuffer(data, np.uint8)
    if bits in (8, 16, 32):
        return np.frombuffer(data, f"<u{bits // 8}", n, first * bits // 8).astype(np.uint32)
    at = (np.arange(first, first + n, dtype=np.int64)) * bits
    lead = at >> 3
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    word = np.zeros(n, np.uint64)
    for k in range((bits + 14) // 8):
        word |= padded[lead + k].astype(np.uint64) << np.uint64(8 * k)
    return (word >> (at & 7).astype(np.uint64) & np.uint64((1 << bits) - 1)).astype(np.uint32)


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri)


class Writer:
    def __init__(self, uri: str, bits: int):
        self.fs, self.path = opened(uri)
        self.draft, self.bits = f"{self.path}.{uuid4().hex}.draft", bits
        self.fs.create_dir(self.path.rpartition("/")[0], recursive=True)
        self.out = self.fs.open_output_stream(self.draft)
        self.out.write(HEAD.pack(MAGIC, VERSION, bits))
        self.at, self.rest, self.n = HEAD.size, np.zeros(0, np.uint32), 0
        self.docs: list[int | None] = []
        self.starts, self.blocks = [0], [HEAD.size]

    def add(self, docs: list[int | None], sizes: np.ndarray, ids: np.ndarray) -> None:
        self.docs += docs
        self.starts += (self.n + np.cumsum(sizes)).tolist()
        self.n += len(ids)
        ids = np.concatenate([self.rest, ids])
        whole = len(ids) // BLOCK
        self.write(ids[: whole * BLOCK])
        self.rest = ids[whole * BLOCK :]

    def write(self, ids: np.ndarray) -> None:
        if len(ids):
            data = pack(ids, self.bits)  # BLOCK times any width is whole bytes: one call packs many blocks
            self.out.write(data)
            size = BLOCK * self.bits // 8
            self.blocks += [self.at + min(len(data), (i + 1) * size) for i in range(-(-len(ids) // BLOCK))]
            self.at += len(data)

    def close(self) -> None:
        self.write(self.rest)
        index = [np.array([d or 0 for d in self.docs], "<i8"), np.array([d is not None for d in self.docs], np.uint8), np.array(self.starts, "<u8"), np.array(self.blocks, "<u8")]
        for x in index:
            self.out.write(x.tobytes())
        self.out.write(TRAILER.pack(len(self.docs), self.n, len(self.blocks) - 1, BLOCK, self.bits, MAGIC))
        self.out.close()
        self.fs.move(self.draft, self.path)


class Reader:
    """Random access to one file: the index is read once, ids by their blocks."""

    def __init__(self, uri: str):
        system, path = opened(uri)
        self.file = system.open_input_file(path)
        size = self.file.size()
        self.docs_n, self.n, blocks, self.block, self.bits, magic = TRAILER.unpack(self.file.read_at(TRAILER.size, size - TRAILER.size))
        if magic != MAGIC or HEAD.unpack(self.file.read_at(HEAD.size, 0))[0] != MAGIC:
            raise ValueError(f"{uri} isn't a token file")
        length = 9 * self.docs_n + 8 * (self.docs_n + 1) + 8 * (blocks + 1)
        index = self.file.read_at(length, size - TRAILER.size - length)
        at = 8 * self.docs_n
        self.docs = np.frombuffer(index, "<i8", self.docs_n)
        self.present = np.frombuffer(index, np.uint8, self.docs_n, at).astype(bool)
        at += self.docs_n
        self.starts = np.frombuffer(index, "<u8", self.docs_n + 1, at).astype(np.int64)
        self.blocks = np.frombuffer(index, "<u8", blocks + 1, at + 8 * (self.docs_n + 1)).astype(np.int64)

    def ids(self, first: int, last: int) -> np.ndarray:
        """Ids ``first`` to ``last`` (excluded) of the file."""
        if last <= first:
            return np.zeros(0, np.uint32)
        a, b = first // self.block, -(-last // self.block)
        data = self.file.read_at(int(self.blocks[b] - self.blocks[a]), int(self.blocks[a]))
        return unpack(data, self.bits, last - first, first - a * self.block)

    def document(self, i: int) -> np.ndarray:
        return self.ids(int(self.starts[i]), int(self.starts[i + 1]))


#: Settings of a file that lower-cases, drops white space and splits at it and between letters and signs.
FOLDING = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
SPLITTING = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


@lru_cache(maxsize=1)
def word_encoder(path: str) -> tuple[ChunkEncoder, int]:
    """Encoder and vocabulary size of a tokenizers file, which is used as it is.

    Texts are cut into chunks only if the file's own settings say that a chunk is encoded alike alone; else, and where a
    text holds one of the file's added tokens, it is encoded whole.
    """
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    own = json.loads(t.to_str())
    steps = (own["pre_tokenizer"] or {}).get("pretokenizers") or [{}]
    cuts = own["normalizer"] == FOLDING and [x.get("type") for x in steps] == ["Split", "ByteLevel"] and steps[0] == {"type": "Split", "pattern": {"Regex": SPLITTING}, "behavior": "Removed", "invert": True}
    cuts = cuts and not steps[1]["add_prefix_space"] and not steps[1]["use_regex"] and own["post_processor"] is None and own["truncation"] is None
    specials = tuple(x["content"] for x in own["added_tokens"])
    special = regex.compile("|".join(map(regex.escape, specials)), regex.IGNORECASE) if specials else None
    mark = t.encode(MARK, add_special_tokens=False).ids if cuts else []

    def encode(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Many chunks in one call, with a mark between them: a character that is a word and one id of its own."""
        if len(mark) != 1 or any(MARK in x or special and special.search(x) for x in texts):
            return flattened([e.ids for i in range(0, len(texts), CALL) for e in t.encode_batch_fast(texts[i : i + CALL], add_special_tokens=False)])
        joined = [f" {MARK} ".join(texts[i : i + JOINED]) for i in range(0, len(texts), JOINED)]
        step = CALL // JOINED
        ids = np.concatenate([np.array([*e.ids, mark[0]], np.uint32) for i in range(0, len(joined), step) for e in t.encode_batch_fast(joined[i : i + step], add_special_tokens=False)])
        between = ids == mark[0]
        return ids[~between], np.diff(np.r_[-1, np.flatnonzero(between)]) - 1

    return ChunkEncoder(encode, wide_space_splits=True, folds=cuts, cuts=cuts, specials=specials), t.get_vocab_size()


def write_files(docs: DataFrame, path: str, end: int, folder: str, rows: int = 4096) -> DataFrame:
    """Encode and write all documents; one row for each file: (file, uri, documents, ids)."""
    ship(docs.sparkSession)
    bits = bits_for(max(word_encoder(path)[1], end + 1))
    bounds = range_bounds(docs.select(F.col("doc_id").cast("long").alias("doc_id")), "doc_id", rows)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, _ = word_encoder(path)
        for whole in batches:
            for b in slices(whole, "text"):
                flat, sizes = encoder.column(b.column("text"))
                ends = np.cumsum(sizes)
                raw, at = pack(np.insert(flat, ends, end), bits if bits in (8, 16, 32) else 32), np.r_[0, np.cumsum(sizes + 1)]
                width = len(raw) // max(1, at[-1])
                ids = pa.Array.from_buffers(pa.large_binary(), b.num_rows, [None, pa.py_buffer((at * width).astype(np.int64)), pa.py_buffer(raw)]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), ids], names=["doc_id", "ids"])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = f"<u{(bits if bits in (8, 16, 32) else 32) // 8}"
        now, writer = None, None

        def done() -> pa.RecordBatch:
            writer.close()
            return pa.RecordBatch.from_pydict({"file": pa.array([now], pa.int32()), "uri": [f"{folder}/part-{now:06d}.bin"], "documents": pa.array([len(writer.docs)], pa.int64()), "ids": pa.array([writer.n], pa.int64())})

        for whole in batches:
            for i in range(0, whole.num_rows, 2048):
                b = whole.slice(i, 2048)
                file = b.column("file").to_numpy()
                for a in np.flatnonzero(np.r_[True, file[1:] != file[:-1]]):
                    if file[a] != now:
                        if writer:
                            yield done()
                        now = int(file[a])
                        writer = Writer(f"{folder}/part-{now:06d}.bin", bits)
                    part = b.slice(a, int(np.searchsorted(file, now, side="right")) - a)
                    raw = part.column("ids").to_pylist()
                    sizes = np.fromiter(map(len, raw), np.int64, len(raw)) // np.dtype(width).itemsize
                    writer.add(part.column("doc_id").to_pylist(), sizes, np.frombuffer(b"".join(raw), width).astype(np.uint32))
        if writer:
            yield done()

    encoded = arrow_map(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text")), encode, "doc_id long, ids binary")
    dealt = encoded.withColumn("file", range_bucket(F.col("doc_id"), bounds).cast("int")).repartition("file").sortWithinPartitions("file", F.col("doc_id").asc_nulls_first(), "ids")
    return cut(arrow_map(dealt, write, "file int, uri string, documents long, ids long"), "token-files")


def read_files(files: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in the files of (file, uri, ids)."""
    ship(files.sparkSession)
    placed = files.withColumn("base", F.sum("ids").over(Window.orderBy("file")) - F.col("ids"))  # a row for each file

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                r = Reader(row["uri"])
                at = 0
                while at < r.docs_n:
                    to = max(at + 1, int(np.searchsorted(r.starts, r.starts[at] + (1 << 20), side="right")) - 1)
                    ids = r.ids(int(r.starts[at]), int(r.starts[to])).astype("<u4")
                    bounds = r.starts[at : to + 1] - r.starts[at]
                    crc = [zlib.crc32(ids[i:j]) for i, j in zip(bounds, bounds[1:], strict=False)]
                    yield pa.RecordBatch.from_arrays([pa.array(r.docs[at:to], pa.int64(), mask=~r.present[at:to]), pa.array(row["base"] + r.starts[at:to]), pa.array(np.diff(bounds)), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])
                    at = to

    return arrow_map(placed.select("file", "uri", "base").repartition("file"), read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(spark: SparkSession, docs: DataFrame, path: str, end: int = 2) -> DataFrame:
    """Write all documents as token files in the shared folder and describe them from there."""
    return read_files(write_files(docs, path, end, new_path(spark, "tokens")))
