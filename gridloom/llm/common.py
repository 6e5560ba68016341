"""Helpers that the corpus operators share."""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid
import zipfile

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are maximal runs of anything but these bytes.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"
BATCH_ROWS, FEW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", "16"
#: Arrow batches are limited by bytes too; texts are of very different lengths.
BATCH_BYTES, BATCH_DEFAULT, MOST_BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b", 8 << 20


def ship(spark: SparkSession) -> None:
    """Give this package to the executors, once per Spark context."""
    sc = spark.sparkContext
    if getattr(sc, "_gridloom_shipped", False):
        return
    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    out = os.path.join(tempfile.mkdtemp(prefix="gridloom-"), "gridloom.zip")
    with zipfile.ZipFile(out, "w") as z:
        for folder, _, names in os.walk(top):
            for n in sorted(names):
                if n.endswith(".py"):
                    path = os.path.join(folder, n)
                    z.write(path, os.path.relpath(path, os.path.dirname(top)))
    sc.addPyFile(out)
    sc._gridloom_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """This application's folder in the one that driver and executors share, spark.checkpoint.dir; it goes with the application.

    Where that is unset, a local folder does in local mode (tests); on a cluster it's an error, as executors would each
    write to a disk of their own.
    """
    sc = spark.sparkContext
    if not getattr(sc, "_gridloom_dir", None):
        found = spark.conf.get("spark.checkpoint.dir", None)
        if not found:
            if not sc.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
            found = "file://" + tempfile.mkdtemp(prefix="gridloom-shared-")
        sc._gridloom_dir = f"{found.rstrip('/')}/gridloom-{sc.applicationId}"
        path = sc._jvm.org.apache.hadoop.fs.Path(sc._gridloom_dir)
        system = path.getFileSystem(sc._jsc.hadoopConfiguration())
        system.mkdirs(path)
        system.deleteOnExit(path)
    return sc._gridloom_dir


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def whole_rows(docs: DataFrame) -> Column:
    """All columns as one, under which no name can clash with another."""
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns])


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it again, which cuts the lineage."""
    spark = df.sparkSession
    path, schema = new_path(spark, name), df.schema
    df.write.parquet(path)
    out = spark.read.schema(schema).parquet(path)
    out._gridloom_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete what ``cut`` has written; nothing that is still to be computed may read it."""
    for t in tables:
        sc = t.sparkSession.sparkContext
        path = sc._jvm.org.apache.hadoop.fs.Path(t._gridloom_path)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def trim() -> None:
    """Give memory back to the system, so that idle and reused workers hold little."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library: it keeps what it keeps
        pass


def tidied(run):
    """``run`` with memory given back after each batch."""

    def whole(batches):
        def each():
            for b in batches:
                yield b
                del b
                trim()

        yield from run(each())
        trim()

    return whole


def set_batches(spark: SparkSession) -> None:
    """Arrow batches of many rows and bounded bytes; what the user has set stays."""
    conf = spark.conf
    if conf.get(BATCH_ROWS) == FEW_ROWS:  # set by the decoding of fields, whose rows are large
        conf.unset(BATCH_ROWS)
    if conf.get(BATCH_BYTES) == BATCH_DEFAULT:  # what the user has set stays
        conf.set(BATCH_BYTES, MOST_BATCH_BYTES)


def arrow_map(df: DataFrame, run, schema: str) -> DataFrame:
    """``df.mapInArrow`` in batches of bounded bytes, tidied up."""
    set_batches(df.sparkSession)
    return df.mapInArrow(tidied(run), schema)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all rows, one after the other, and the n+1 offsets; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks != 1 else column.chunk(0)
    if column.null_count:
        column = column.fill_null("")
    if column.type != pa.large_string():
        column = column.cast(pa.large_string())
    n = len(column)
    offsets = np.frombuffer(column.buffers()[1], np.int64, n + 1, column.offset * 8) if n else np.zeros(1, np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batch: pa.RecordBatch, column: str, most: int = 4 << 20):
    """Cut a batch into row ranges of about ``most`` text bytes (one row at least)."""
    n = batch.num_rows
    if not n:
        return
    _, offsets = text_buffer(batch.column(column))
    at = 0
    while at < n:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1)
        yield batch.slice(at, end - at)
        at = end


def ranges(lengths: np.ndarray) -> np.ndarray:
    """0..l-1 for each length l, one after the other."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total, dtype=np.int64) - np.repeat(ends - lengths, lengths)


def range_bounds(df: DataFrame, key: str, rows: int) -> list[int]:
    """Sorted bounds that part the values of a long column into ranges of about ``rows`` rows.

    One pass over one column; the sketch is bounded by the number of bounds. Only balance depends on its accuracy.
    """
    n = df.select(F.count(key)).first()[0]
    parts = min(65536, max(1, -(-n // rows)))
    if parts == 1:
        return []
    at = [i / parts for i in range(1, parts)]
    got = df.select(F.percentile_approx(key, at, max(10000, 4 * parts))).first()[0]
    return sorted(set(got))


def constants(values: list, kind: str) -> Column:
    """A literal array; one string in the plan, folded once."""
    return F.split(F.lit(",".join(map(repr, values))), ",").cast(f"array<{kind}>")


def range_bucket(key: Column, bounds: list[int]) -> Column:
    """Number of the range: how many bounds are <= key (binary search); null: 0."""
    if not bounds:
        return F.lit(0)
    steps = max(1, len(bounds).bit_length())
    size = 1 << steps
    top = (1 << 63) - 1
    padded = bounds + [top] * (size - len(bounds))
    n = len(bounds)
    table, powers = constants(padded, "bigint"), constants([1 << (steps - 1 - i) for i in range(steps)], "int")
    found = F.aggregate(
        powers,
        F.lit(0),
        lambda lo, half: F.when((F.get(table, lo + half - 1) <= key) & (lo + half <= n), lo + half).otherwise(lo),
    )
    return F.coalesce(found, F.lit(0))


def components(edges: DataFrame, name: str = "components", most: int = 60) -> DataFrame:
    """Connected components of an edge list (a, b): rows (node, root), root the smallest node reachable.

    Alternating large-star and small-star rounds; each round's edges are written to the shared folder, and only their
    count and checksum reach the driver. Nodes without edges aren't returned.
    """
    e = edges.where("a is not null and b is not null and a <> b")
    e = e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    e, before = cut(e, name), None
    for _ in range(most):
        # large star: every larger neighbour goes to the smallest neighbour
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # small star: smaller neighbours and the node itself go to the smallest
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct(F.col("a").alias("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("x")).select("x.*").where("a <> b").distinct()
        e, old = cut(small, name), e
        discard(old)
        now = tuple(e.agg(F.count("*"), F.sum(F.hash("a", "b").cast("long"))).first())
        if now == before:
            return e.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = now
    raise RuntimeError("components did not settle")
