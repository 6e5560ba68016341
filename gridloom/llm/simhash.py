"""SimHash near-duplicates: exact comparison of 64-bit fingerprints in tiles.

Texts become fingerprints next to the scan. Equal fingerprints become one node, so copies cost nothing further. Nodes
within the radius share at least one of ``radius + 1`` blocks of their bits, so each node goes to one bucket per block.
All comparing is done by tiles: the rows of a task, in order of bucket and population count, are cut into tiles of ``TILE``
rows; tile pairs with no bucket in common, or whose population counts there differ by more than the radius, are skipped,
and the others are compared with numpy exclusive-or and bit counts. A bucket too large for one task is dealt to several by
ranges of population count in the same way. What leaves a task is a spanning forest of its links, never all pairs.

Defined results: a null or blank text has fingerprint zero and is linked like any other; rows with equal doc_id are rows
of their own; a null doc_id never becomes a component's id unless no other is reachable (then the id is null); an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .common import arrow_map, components, cut, ship, slices

LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
SEED = 42
#: Rows of a tile that numpy compares with another at once.
TILE = 64


def shingle_hashes(text: str | None, width: int = 3) -> list[int]:
    """XXH64 of each word shingle of a text, repeats included."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()
    if not words:
        return []
    joined = b" ".join(words)
    if len(words) <= width:
        return [xxh64_intdigest(joined, SEED)]
    ends = list(accumulate(len(w) + 1 for w in words))
    starts = [0, *ends[: len(words) - width]]
    return [xxh64_intdigest(joined[a : b - 1], SEED) for a, b in zip(starts, ends[width - 1 :], strict=True)]


def fingerprint(hashes: list[int]) -> int:
    """Bit i is set if it is set in over half of the hashes."""
    n = len(hashes)
    if not n:
        return 0
    bits = np.unpackbits(np.array(hashes, dtype=">u8").view(np.uint8).reshape(n, 8), axis=1)
    whole = n // 255 * 255
    count = bits[whole:].sum(axis=0, dtype=np.int64)
    if whole:  # blocks of 255 rows can be summed in bytes
        count += bits[:whole].reshape(-1, 255, 64).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(count * 2 > n).tobytes(), "big")


def with_fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed long."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, "text", 8 << 20):
                fps = np.array([fingerprint(shingle_hashes(t, width)) for t in b.column("text").to_pylist()], dtype=np.uint64)
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    return arrow_map(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text")), run, "doc_id long, fp long")


def near_pairs(group: np.ndarray, ones: np.ndarray, fp: np.ndarray, radius: int, counts: list[int] | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Rows (r, c), r < c, of one group that differ in ``radius`` bits or fewer, and in how many, by tiles of TILE rows.

    Rows are sorted by group and population count; fp holds one or more 64-bit words a row. Two tiles meet if they have a
    group in common and its population counts there lie within the radius. counts: tile pairs compared and skipped.
    """
    n, words = fp.shape
    tiles = -(-n // TILE)
    x, g = np.zeros((tiles * TILE, words), np.uint64), np.full(tiles * TILE, -1, np.int64)
    x[:n], g[:n] = fp, group
    x, g = x.reshape(tiles, TILE, words), g.reshape(tiles, TILE)
    begin, end = np.arange(tiles) * TILE, np.minimum(np.arange(1, tiles + 1) * TILE, n) - 1
    later = np.triu(np.ones((TILE, TILE), bool), 1)
    for d in range(tiles):
        p = np.arange(tiles - d)
        if d:
            p = p[group[end[p]] == group[begin[p + d]]]
            if not len(p):
                break  # sorted: what isn't shared at this distance isn't at a greater one
            within = ones[begin[p + d]] - ones[end[p]] <= radius
            if counts is not None:
                counts[1] += int((~within).sum())
            p = p[within]
        if counts is not None:
            counts[0] += len(p)
        for i in range(0, len(p), 64):
            left, right = p[i : i + 64], p[i : i + 64] + d
            bits = np.zeros((len(left), TILE, TILE), np.uint16)
            for w in range(words):
                bits += np.bitwise_count(x[left, :, None, w] ^ x[right, None, :, w])
            hit = (bits <= radius) & (g[left][:, :, None] == g[right][:, None, :])
            if not d:
                hit &= later
            k, r, c = np.nonzero(hit)
            off = bits[k, r, c]
            r, c = left[k] * TILE + r, right[k] * TILE + c
            real = c < n
            yield r[real], c[real], off[real]


def spread(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels lowered along the pairs until each component has its least."""
    while True:
        before = label.copy()
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        label = label[label]
        if (label == before).all():
            return label


def forest(n: int, pairs: Iterator[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, np.ndarray]:
    """Links of each row to the first row of its component, whatever the number of pairs."""
    label, held, size = np.arange(n), [], 0
    for a, b, _ in pairs:
        held.append((a, b))
        size += len(a)
        if size > 1 << 20:
            label, held, size = spread(label, *map(np.concatenate, zip(*held, strict=True))), [], 0
    if held:
        label = spread(label, *map(np.concatenate, zip(*held, strict=True)))
    at = np.flatnonzero(label != np.arange(n))
    return at, label[at]


def dealt_in_tiles(rows: DataFrame, radius: int, tile: int) -> DataFrame:
    """``rows`` (id, fp, ones, key) with a pair of tiles (s, t), as often as there are pairs that they belong to.

    A bucket of up to ``tile`` rows is one tile. A larger one is cut by population count, and by a hash where one count has
    too many rows; pairs of tiles whose counts differ by more than the radius aren't made.
    """
    columns = ["id", "fp", "ones", "key"]
    counts = rows.groupBy("key", "ones").agg(F.count("*").alias("n"))
    large = counts.groupBy("key").agg(F.sum("n").alias("total"), F.map_from_entries(F.collect_list(F.struct("ones", F.ceil(F.col("n") / tile).cast("int").alias("tiles")))).alias("tiles")).where(F.col("total") > tile)
    rows = rows.join(large.select("key", "tiles"), "key", "left")
    number = lambda ones, own: ones.cast("long") * (1 << 32) + own
    mine = number(F.col("ones"), F.pmod(F.xxhash64("fp"), F.col("tiles")[F.col("ones")]))
    others = F.flatten(F.transform(F.sequence(F.col("ones") - radius, F.col("ones") + radius), lambda o: F.when(F.col("tiles")[o].isNull(), F.array().cast("array<long>")).otherwise(F.transform(F.sequence(F.lit(0), F.col("tiles")[o] - 1), lambda s: number(o, s)))))
    pair = F.transform(others, lambda t: F.struct(F.least(t, mine).alias("s"), F.greatest(t, mine).alias("t")))
    none = F.array(F.struct(F.lit(-1).cast("long").alias("s"), F.lit(-1).cast("long").alias("t")))
    rows = rows.select(*columns, F.explode(F.when(F.col("tiles").isNull(), none).otherwise(pair)).alias("p"))
    return rows.select(*columns, "p.s", "p.t").repartition("key", "s", "t").sortWithinPartitions("key", "s", "t", "ones")


def print_words(column: pa.Array) -> np.ndarray:
    """Fingerprints, of one word (long) or of several (binary), as rows of words."""
    if pa.types.is_integer(column.type):
        return column.to_numpy().view(np.uint64).reshape(-1, 1)
    raw = column.to_pylist()
    return np.frombuffer(b"".join(raw), "<u8").reshape(len(raw), -1)


def compared(rows: DataFrame, radius: int, tile: int) -> DataFrame:
    """Edges (a, b) of ids that connect what lies within ``radius`` bits, as forests; rows: (id, fp, ones, key), of which those with a key in common are compared."""
    ship(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(t: pa.Table) -> Iterator[pa.RecordBatch]:
            k = np.stack([t.column(c).to_numpy() for c in ("key", "s", "t")])
            group = np.cumsum(np.r_[False, (k[:, 1:] != k[:, :-1]).any(axis=0)])
            ids, fp = t.column("id").to_numpy(), print_words(t.column("fp").combine_chunks())
            a, b = forest(len(ids), near_pairs(group, t.column("ones").to_numpy(), fp, radius))
            for i in range(0, len(a), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(ids[a[i : i + 100_000]]), pa.array(ids[b[i : i + 100_000]])], names=["a", "b"])

        held: list[pa.Table] = []
        n = 0
        for b in batches:
            held.append(pa.Table.from_batches([b]))
            n += b.num_rows
            if n < 50_000:
                continue
            t = pa.concat_tables(held).combine_chunks()
            last = [t.column(c)[t.num_rows - 1].as_py() for c in ("key", "s", "t")]  # the last run may go on
            same = np.logical_and.reduce([t.column(c).to_numpy() == v for c, v in zip(("key", "s", "t"), last, strict=True)])
            whole = int(np.argmax(same))
            if whole:
                yield from out(t.slice(0, whole).combine_chunks())
            held = [t.slice(whole)]
            n = held[0].num_rows
        if n:
            yield from out(pa.concat_tables(held).combine_chunks())

    return arrow_map(dealt_in_tiles(rows, radius, tile), run, "a long, b long")


def links(nodes: DataFrame, radius: int = 3, tile: int = 1024) -> DataFrame:
    """Edges (a, b) of node ids that connect what lies within ``radius`` bits; nodes: (id, fp), one row for each fp."""
    blocks = radius + 1
    size = 64 // blocks
    at = [(j * size, size if j < blocks - 1 else 64 - j * size) for j in range(blocks)]
    keys = F.array(*[F.shiftrightunsigned("fp", lo).bitwiseAND((1 << bits) - 1) * blocks + j if bits < 64 else F.col("fp") for j, (lo, bits) in enumerate(at)])
    rows = nodes.select("id", "fp", F.bit_count("fp").cast("int").alias("ones"), F.explode(keys).alias("key"))
    return compared(rows, radius, tile)


def near_duplicates(docs: DataFrame, radius: int = 3, width: int = 3, tile: int = 1024) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row of ``docs`` (doc_id, text)."""
    prints = cut(with_fingerprints(docs, width), "simhash")
    nodes = prints.groupBy("fp").agg(F.min("doc_id").alias("id"))
    # the fingerprint itself names a node, as ids may repeat or be null
    edges = links(nodes.select(F.col("fp").alias("id"), "fp"), radius, tile)
    found = components(edges, "simhash-links")
    named = nodes.join(found.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "id", F.coalesce("root", "fp").alias("root"))
    ids = named.groupBy("root").agg(F.min("id").alias("component_id"))
    named = named.join(ids, "root").select("fp", "component_id")
    hexed = F.lpad(F.lower(F.hex("fp")), 16, "0")
    return prints.join(named, "fp").select("doc_id", hexed.alias("fingerprint"), "component_id")

