"""Exact top-k by inner product: Fagin's threshold algorithm over sorted per-dimension lists.

Vectors are packed into blocks. In each block every dimension has a list of rows sorted by component; a query walks down
all lists at once (from the top where its component is positive, from the bottom where negative), scores rows as they
first turn up, and stops when even a row with the best components not yet reached can't beat the kth score. Depth grows
by doubling, so that each step is a few numpy calls. A block's lists are sorted once and serve all query blocks, which meet
each candidate block once (they carry the block's number, an equi-join of packed blocks); a kth score reached in one block is
a bound for the next, which may so be left before its first row. At most k + 1 rows of a query leave a block.

Defined results: a vector that is null or holds a null or non-finite component (also once scaled) takes no part, nor does a
row without vec_id; vectors of different length are padded with zeros; queries are rows of the vectors, each a query of its
own, whose candidates are all rows but itself, so also others with its vec_id; ties go to the smaller vec_id; scores are
exact integers, those beyond a long are given, and ranked, as the largest or smallest long; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_map, ship

LOW, HIGH = -(1 << 63), (1 << 63) - 1
#: Query blocks whose bounds a worker keeps.
BOUNDS = 256


def exact(a: np.ndarray, b: np.ndarray) -> type:
    """The cheapest type in which inner products of these rows are exact."""
    top = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(1, a.shape[1])
    return np.float64 if top < 2.0**53 else np.int64 if top < 2.0**62 else object


def typed(data: np.ndarray, kind: type) -> np.ndarray:
    """Whole numbers, given as doubles, in another type."""
    if kind is not object:
        return data.astype(kind)
    return np.array([[int(x) for x in row] for row in data], object).reshape(data.shape)


def as_long(scores) -> np.ndarray:
    scores = np.asarray(scores)
    return np.array([min(max(int(x), LOW), HIGH) for x in scores.ravel()], np.int64).reshape(scores.shape) if scores.dtype == object else scores.astype(np.int64)


def threshold_top(data: np.ndarray, order: np.ndarray, ids: np.ndarray, query: np.ndarray, k: int, bound: int | None = None) -> tuple[np.ndarray, np.ndarray, int]:
    """Rows and scores of the k best, ties to the smaller id, and the number of rows scored.

    order: argsort of each column. bound: a kth score already reached elsewhere; what is below it may be left out.
    """
    n = len(data)
    live = np.flatnonzero(query)
    down = query[live] > 0
    seen = np.zeros(n, bool)
    rows, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
    scored, depth, step = 0, 0, 2 * k

    def limit(at: int) -> int:
        """The most that a row can score whose components are all at or beyond this depth of the lists."""
        last = np.where(down, order[n - 1 - at, live], order[at, live])
        return int(as_long((data[last, live] * query[live]).sum())) if len(live) else 0

    while depth < n:
        if len(rows) == k and limit(depth) < scores[-1] or bound is not None and limit(depth) < bound:
            break
        end = min(n, depth + step)
        at = np.arange(depth, end)
        reached = np.zeros(n, bool)
        if len(live):
            reached[order[n - 1 - at][:, live[down]].ravel()] = True
            reached[order[at][:, live[~down]].ravel()] = True
        else:
            reached[at] = True
        new = np.flatnonzero(reached & ~seen)
        seen |= reached
        scored += len(new)
        rows, scores = np.r_[rows, new], np.r_[scores, as_long(data[new] @ query)]
        if len(rows) > k:
            best = np.lexsort((ids[rows], ~scores))[:k]
            rows, scores = rows[best], scores[best]
        depth, step = end, step * 2
    best = np.lexsort((ids[rows], ~scores))[:k]
    return rows[best], scores[best], scored


def matrix(data: bytes, n: int, have: int, dims: int) -> np.ndarray:
    out = np.zeros((n, dims))
    out[:, :have] = np.frombuffer(data, "<f8").reshape(n, have)
    return out


def packed(df: DataFrame, names: list[str], scale: float, block: int) -> DataFrame:
    """(block, n, dims, names..., data): the rows of each block, cut where there are more than ``block``; names are longs."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        now, rows = None, 0

        def out() -> pa.RecordBatch:
            t = pa.Table.from_batches(held).combine_chunks()
            lists = t.column("e").combine_chunks()
            sizes = lists.value_lengths().to_numpy()
            dims = int(sizes.max(initial=0))
            data = np.zeros((len(sizes), dims))
            data[np.arange(dims)[None, :] < sizes[:, None]] = lists.flatten().to_numpy()
            columns = {"block": pa.array([now], pa.int32()), "n": pa.array([len(sizes)], pa.int32()), "dims": pa.array([dims], pa.int32())}
            columns |= {c: [t.column(c).to_numpy().astype("<i8").tobytes()] for c in names}
            return pa.RecordBatch.from_pydict(columns | {"data": [np.floor(scale * data).astype("<f8").tobytes()]})

        for b in batches:
            key = b.column("block").to_numpy()
            at = 0
            while at < b.num_rows:
                if held and (key[at] != now or rows >= block):
                    yield out()
                    held, rows = [], 0
                now = int(key[at])
                end = min(int(np.searchsorted(key, now, side="right")), at + block - rows)
                held.append(b.slice(at, end - at))
                rows += end - at
                at = end
        if held:
            yield out()

    dealt = df.select("block", *names, "e").repartition("block").sortWithinPartitions("block")
    return arrow_map(dealt, pack, f"block int, n int, dims int, {', '.join(f'{c} binary' for c in names)}, data binary")


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, scale: float = 1024.0, block: int = 8192) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of ``queries`` the k best others of ``vectors``, both (vec_id, embedding).

    ``queries`` is a part of ``vectors``. Components are scaled and rounded down.
    """
    ship(vectors.sparkSession)

    def usable(df: DataFrame) -> DataFrame:
        e = F.col("embedding").cast("array<double>")
        bad = F.exists(e, lambda x: x.isNull() | F.isnan(x) | (F.abs(x * scale) == float("inf")))
        return df.select(F.col("vec_id").cast("long"), e.alias("e")).where(F.col("vec_id").isNotNull() & F.col("e").isNotNull() & ~bad)

    vectors, queries = usable(vectors), usable(queries)
    blocks = max(1, -(-vectors.count() // block))
    groups = max(1, -(-queries.count() // block))
    # rows are dealt whatever they hold, so that no vec_id or vector is too frequent for a block
    left = packed(vectors.withColumn("block", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(blocks)).cast("int")), ["vec_id"], scale, block)
    # equal queries have equal answers, which are looked for once
    queries = queries.groupBy("vec_id", "e").agg(F.count("*").alias("copies")).withColumn("key", F.xxhash64("vec_id", "e"))
    right = packed(queries.withColumn("block", F.pmod("key", F.lit(groups)).cast("int")), ["vec_id", "key", "copies"], scale, block)
    right = right.select(F.struct("block", F.xxhash64("key").alias("hash")).alias("q_name"), *[F.col(c).alias(f"q_{c}") for c in ("n", "dims", "vec_id", "key", "copies", "data")], F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bounds: dict[tuple, list] = {}
        held, order = None, np.zeros((0, 0), np.int64)
        for b in batches:
            for r in b.to_pylist():
                ids, who, key, copies = (np.frombuffer(r[c], "<i8") for c in ("vec_id", "q_vec_id", "q_key", "q_copies"))
                dims = max(r["dims"], r["q_dims"])
                data, query = matrix(r["data"], r["n"], r["dims"], dims), matrix(r["q_data"], r["q_n"], r["q_dims"], dims)
                if held != (dims, r["vec_id"], r["data"]):
                    held, order = (dims, r["vec_id"], r["data"]), np.argsort(data, axis=0, kind="stable")
                kind = exact(np.concatenate([data, query]), query)
                data, query = typed(data, kind), typed(query, kind)
                if len(bounds) >= BOUNDS:
                    bounds.clear()
                known = bounds.setdefault((r["q_name"]["block"], r["q_name"]["hash"]), [None] * len(query))
                found = []
                for i, q in enumerate(query):
                    rows, scores, _ = threshold_top(data, order, ids, q, k + 1, known[i])
                    if len(scores) == k + 1:
                        known[i] = int(scores[-1]) if known[i] is None else max(known[i], int(scores[-1]))
                    own = (ids[rows] == who[i]) & (scores == as_long(q @ q))
                    found.append((np.full(len(rows), who[i]), np.full(len(rows), key[i]), np.full(len(rows), copies[i]), ids[rows], scores, own))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*found, strict=True)], names=["query_id", "key", "copies", "vec_id", "score", "own"])

    pairs = arrow_map(left.hint("merge").join(right, "block"), search, "query_id long, key long, copies long, vec_id long, score long, own boolean")
    best = Window.partitionBy("query_id", "key").orderBy(F.desc("score"), "vec_id")
    pairs = pairs.withColumn("place", F.row_number().over(best)).where(F.col("place") <= k + 1)
    # the row itself, one of those with its vec_id and score, goes
    itself = F.col("own") & (F.lag("own", 1, False).over(best) == F.lit(False))
    pairs = pairs.withColumn("itself", itself).withColumn("rank", (F.col("place") - F.sum(F.col("itself").cast("int")).over(best)).cast("int"))
    pairs = pairs.where(~F.col("itself") & (F.col("rank") <= k))
    return pairs.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("query_id", "rank", "vec_id", "score")
