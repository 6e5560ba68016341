"""Near copies by word shingles: one row of each group of texts that share most of their five-word shingles.

Two texts are linked if the Jaccard similarity of their sets of five-word shingles is 0.8 or more; groups are the connected
components of the links. Texts of equal sets are one node (named by 64 bits of a hash of the set), so copies cost nothing
further. Each node has a SimHash of ``BITS`` bits; ``simhash.compared`` compares them tile by tile, with exclusive-or, bit
counts and population counts, within ``RADIUS`` bits: similarity 0.8 lies near 78, with a standard deviation of 8. Exact
search within such a radius would compare all documents with all, so tiles are made of nodes that share a band of minhash
values: 24 bands of 4 values miss a pair of similarity 0.8 with a probability of 3 in a million, as does the radius.

What the tiles connect is a cluster, and each node is of one cluster only, so that its text is sent once for checking. There
the members are compared again by tiles, and pairs within the radius that aren't connected yet, nearest first, are checked on
their whole shingle sets, so that no link is made below the bound. A cluster whose sets are too large for one task is cut into
blocks, and each pair of blocks is one. No list of pairs is made at any place: what leaves a task is a forest of links.

Defined results: a text of fewer than five words is one shingle; texts without a word are copies of each other; letters
A-Z are folded; a null is an empty text; an empty table gives an empty result; columns may have any names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import AtomicType
from xxhash import xxh64_intdigest

from .common import arrow_map, components, cut, discard, ship, slices, whole_rows
from .simhash import SEED, compared, near_pairs, shingle_hashes

WIDTH = 5
#: Least similarity, as a fraction.
OVER, UNDER = 4, 5
BANDS, EACH = 24, 4
BITS, RADIUS, TILE = 512, 114, 16384
#: Bytes of shingle sets in a block of a cluster.
HELD = 16 << 20
MIX = np.random.default_rng(SEED).integers(0, 1 << 32, (2, BANDS * EACH, 1), dtype=np.uint32) | np.array([[[0]], [[1]]], np.uint32)
WIDE = np.random.default_rng(SEED + 1).integers(1 << 62, 1 << 63, (1, BITS // 64), dtype=np.uint64) | np.uint64(1)


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted hashes of the different shingles."""
    return np.unique(np.array(shingle_hashes(text, WIDTH), np.uint64))


def band_hashes(shingles: np.ndarray) -> list[int]:
    """A hash of each band of minhash values; none of an empty set."""
    if not len(shingles):
        return []
    high = (shingles >> np.uint64(32)).astype(np.uint32)
    least = np.full(BANDS * EACH, (1 << 32) - 1, np.uint32)
    for at in range(0, len(high), 1024):
        np.minimum(least, ((high[at : at + 1024] ^ MIX[0]) * MIX[1]).min(axis=1), out=least)
    return [xxh64_intdigest(least[j : j + EACH].tobytes(), j) for j in range(0, len(least), EACH)]


def wide_print(shingles: np.ndarray) -> bytes:
    """SimHash of a set: a bit is 1 if it is in over half of the shingles' hashes; zero of an empty set."""
    count = np.zeros(BITS, np.int64)
    for at in range(0, len(shingles), 4096):
        h = shingles[at : at + 4096, None] * WIDE
        h ^= h >> np.uint64(32)
        h *= WIDE
        count += np.unpackbits(h.view(np.uint8), axis=1).sum(axis=0, dtype=np.uint16)
    return np.packbits(count * 2 > len(shingles)).tobytes()


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return UNDER * both >= OVER * (len(a) + len(b) - both)


def with_prints(docs: DataFrame) -> DataFrame:
    """(u, row, node, size, bands, fp, ones): a number, all columns of ``docs``, and of the shingle set a name, the size, the bands and the SimHash."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            whole = pa.RecordBatch.from_arrays([whole.column("u"), whole.column("row"), whole.column("row").field("text")], names=["u", "row", "text"])
            for b in slices(whole, "text", 4 << 20):
                nodes, sizes, bands, prints = [], [], [], []
                for t in b.column("text").to_pylist():
                    s = shingle_set(t)
                    nodes.append(xxh64_intdigest(s.tobytes(), SEED))
                    sizes.append(len(s))
                    bands.append(np.array(band_hashes(s), np.uint64).view(np.int64))
                    prints.append(wide_print(s))
                ends = np.cumsum([0, *map(len, bands)], dtype=np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(bands)))
                ones = np.bitwise_count(np.frombuffer(b"".join(prints), np.uint8).reshape(len(prints), -1)).sum(axis=1, dtype=np.int32)
                yield pa.RecordBatch.from_arrays([b.column("u"), b.column("row"), pa.array(np.array(nodes, np.uint64).view(np.int64)), pa.array(sizes, pa.int32()), lists, pa.array(prints, pa.binary()), pa.array(ones)], names=["u", "row", "node", "size", "bands", "fp", "ones"])

    rows = docs.select(F.monotonically_increasing_id().alias("u"), whole_rows(docs).alias("row"))
    return arrow_map(rows, run, f"u long, row {rows.schema['row'].dataType.simpleString()}, node long, size int, bands array<long>, fp binary, ones int")


def find(root: list[int], x: int) -> int:
    while root[x] != x:
        root[x] = root[root[x]]
        x = root[x]
    return x


def true_links(sets: list[np.ndarray], ones: np.ndarray, fp: np.ndarray, block: np.ndarray) -> list[tuple[int, int]]:
    """A forest of pairs whose sets are similar; of two blocks, only pairs across are looked at."""
    order = np.argsort(ones, kind="stable")
    size, across = np.array([*map(len, sets)]), bool((block != block[0]).any())
    root, out = list(range(len(sets))), []
    for r, c, off in near_pairs(np.zeros(len(sets), np.int64), ones[order], fp[order], RADIUS):
        r, c = order[r], order[c]
        fits = UNDER * np.minimum(size[r], size[c]) >= OVER * np.maximum(size[r], size[c])
        if across:
            fits &= block[r] != block[c]
        r, c, off = r[fits], c[fits], off[fits]
        for i in np.argsort(off, kind="stable"):
            x, y = find(root, r[i]), find(root, c[i])
            if x != y and similar(sets[r[i]], sets[c[i]]):
                root[max(x, y)] = min(x, y)
                out.append((int(r[i]), int(c[i])))
    return out


def checked(members: DataFrame) -> DataFrame:
    """Links (a, b) of similar texts; members: (cluster, s, t, own, node, ones, fp, text), compared where cluster, s and t agree."""
    dealt = members.repartition("cluster", "s", "t").sortWithinPartitions("cluster", "s", "t")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> pa.RecordBatch:
            node, own, ones, prints, sets = zip(*held, strict=True)
            fp = np.frombuffer(b"".join(prints), "<u8").reshape(len(prints), -1)
            found = true_links(list(sets), np.array(ones), fp, np.array(own))
            return pa.RecordBatch.from_arrays([pa.array([node[i] for i, _ in found], pa.int64()), pa.array([node[j] for _, j in found], pa.int64())], names=["a", "b"])

        now, held = None, []
        for batch in batches:
            cluster, s, t, own, node, ones, fp = (batch.column(c).to_pylist() for c in ("cluster", "s", "t", "own", "node", "ones", "fp"))
            for i, text in enumerate(batch.column("text")):
                if (cluster[i], s[i], t[i]) != now:
                    if len(held) > 1:
                        yield out()
                    now, held = (cluster[i], s[i], t[i]), []
                held.append((node[i], own[i], ones[i], fp[i], shingle_set(text.as_py())))
        if len(held) > 1:
            yield out()

    return arrow_map(dealt.select("cluster", "s", "t", "own", "node", "ones", "fp", "text"), run, "a long, b long")


def linked(rows: DataFrame) -> DataFrame:
    """(node, root) of the nodes that have a link; rows: as of ``with_prints``, written."""
    nodes = cut(rows.groupBy(F.col("node").alias("id")).agg(*[F.first(c).alias(c) for c in ("size", "bands", "fp", "ones")]), "copies-nodes")
    dealt = nodes.select("id", F.explode("bands").alias("key"))
    shared = dealt.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    near = dealt.join(shared, "key", "left_semi").join(nodes.drop("bands"), "id")
    clusters = components(compared(near, RADIUS, TILE), "copies-clusters")
    clusters = clusters.unionByName(clusters.select("root").distinct().select(F.col("root").alias("node"), "root"))
    sized = clusters.join(nodes.select(F.col("id").alias("node"), "size"), "node")
    blocks = sized.groupBy("root").agg(F.ceil(F.sum(F.col("size").cast("long")) * 8 / HELD).cast("int").alias("blocks"))
    members = sized.join(blocks, "root").withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    members = members.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("node", F.col("root").alias("cluster"), "own", F.least("own", "o").alias("s"), F.greatest("own", "o").alias("t"))
    members = cut(members, "copies-members")
    # merge: the same plan at every size
    texts = rows.select("node", "ones", "fp", "row.text").join(members.select("node").distinct().hint("merge"), "node", "left_semi").groupBy("node").agg(F.min("text").alias("text"), F.first("ones").alias("ones"), F.first("fp").alias("fp"))
    links = checked(members.join(texts, "node"))
    out = components(links, "copies")
    discard(nodes, members)
    return out


def keep_first(docs: DataFrame) -> DataFrame:
    """One row of each group, with all columns: that of the smallest doc_id, then text and the other columns in order.

    Nulls come last. Of the text the first 256 characters count and then a hash, of the others those of simple types. Rows
    are told apart by their texts' nodes, so rows that share a doc_id, or have none, are copies only if their texts are.
    """
    rows = cut(with_prints(docs), "copies")
    text = F.col("row.text")
    simple = [f.name for f in docs.schema if isinstance(f.dataType, AtomicType) and f.name not in ("doc_id", "text")]
    values = [F.col("row.doc_id"), F.substring(text, 1, 256), F.xxhash64(text), *[F.col("row")[c] for c in simple]]
    key = F.struct(*[x.alias(f"k{i}") for i, x in enumerate(x for v in values for x in (F.isnull(v), v))], "u")
    named = rows.select("node", key.alias("key")).join(linked(rows), "node", "left").withColumn("root", F.coalesce("root", "node"))
    first = cut(named.groupBy("root").agg(F.min("key").alias("key")).select("key.u"), "copies-first")
    return rows.join(first.hint("merge"), "u", "left_semi").select("row.*")
