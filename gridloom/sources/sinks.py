"""Writing (B, L): fields and messages as binary columns, and binary columns as files.

Everything that needs the points of a field in order carries ``pt`` and sorts by it within the field; nothing trusts the
order of rows. Files are written by executors to a place that all share, under a name of their own first, so that a task
that runs twice leaves one whole file.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import encode

FIELD = "struct<s5: binary, s6: binary, s7: binary>"
FIELD_ARROW = pa.struct([("s5", pa.binary()), ("s6", pa.binary()), ("s7", pa.binary())])


def points_of(x: pa.ListScalar) -> np.ndarray:
    """Elements of a list as an array; null ones are NaN."""
    return x.values.to_numpy(zero_copy_only=False)


def encode_field(values: Column, decimals: int, ahead: int | None = None) -> Column:
    """Sections 5, 6 and 7 of an array of doubles; null elements are NaN. Complex packing with ``ahead``."""

    def one(x: pa.ListScalar) -> dict | None:
        if not x.is_valid:
            return None
        parts = encode.encode_field(points_of(x).astype(float), decimals, ahead)
        return dict(zip(("s5", "s6", "s7"), parts, strict=True))

    @F.arrow_udf(FIELD)
    def run(column: pa.Array) -> pa.Array:
        return pa.array([one(x) for x in column], FIELD_ARROW)

    return run(values)


def gathered(points: DataFrame, keys: Sequence[str], order: str, value: str) -> DataFrame:
    """One row for each field: its values in the order of ``order``. A field is what one row can hold by definition."""
    each = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(value).cast("double").alias("v"))))
    return points.groupBy(*keys).agg(F.transform(each, lambda x: x["v"]).alias("values"))


def number(value: Column | int, size: int) -> Column:
    """Big-endian octets of a number."""
    c = value if isinstance(value, Column) else F.lit(value)
    return F.unhex(F.lpad(F.hex(c.cast("long")), 2 * size, "0"))


def section(num: int, payload: Column) -> Column:
    return F.concat(number(F.octet_length(payload) + 5, 4), number(num, 1), payload)


def message(discipline: Column | int, *sections: Column) -> Column:
    """A whole message from sections with their headers, null ones left out."""
    body = F.concat(*[F.coalesce(s, F.lit(b"")) for s in sections])
    return F.concat(F.lit(b"GRIB\xff\xff"), number(discipline, 1), number(2, 1), number(F.octet_length(body) + 20, 8), body, F.lit(b"7777"))


def joined(parts: DataFrame, keys: Sequence[str], order: str, octets: str) -> DataFrame:
    """(keys, octets): binary values put together in order, for messages of several submessages."""
    each = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(octets).alias("b"))))
    return parts.groupBy(*keys).agg(F.unhex(F.array_join(F.transform(each, lambda x: F.hex(x["b"])), "")).alias(octets))


def multi_message(parts: DataFrame, keys: Sequence[str], order: str, octets: str, head: Sequence[str], discipline: str) -> DataFrame:
    """(keys, message): submessages of one message, each the octets of its own sections, after the shared sections ``head``."""
    body = joined(parts, keys, order, octets)
    shared = parts.groupBy(*keys).agg(*[F.min_by(h, order).alias(h) for h in (*head, discipline)])
    return body.join(shared, list(keys)).select(*keys, message(F.col(discipline), *[F.col(h) for h in head], F.col(octets)).alias("message"))


def flat_binary(values: Column, endian: str = "big") -> Column:
    """An array of floats as flat octets (B2, B3), NaN as 7fc00000."""
    kind = ">f4" if endian == "big" else "<f4"

    @F.arrow_udf("binary")
    def run(column: pa.Array) -> pa.Array:
        each = (points_of(x).astype(np.float32) if x.is_valid else None for x in column)
        return pa.array([None if v is None else np.where(np.isnan(v), np.float32(np.nan), v).astype(kind).tobytes() for v in each], pa.binary())

    return run(values)


def write_binary(rows: DataFrame, name: str, octets: str, folder: str) -> DataFrame:
    """One file for each row, called by column ``name``; returns (file, size) of what was written when it is run."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        system, base = fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)
        system.create_dir(base, recursive=True)
        for b in batches:
            done = []
            for n, data in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                draft = f"{base}/.{n}.{uuid4().hex}"
                with system.open_output_stream(draft) as out:
                    out.write(data.as_py() or b"")
                system.move(draft, f"{base}/{n}")
                done.append((f"{base}/{n}", len(data.as_py() or b"")))
            yield pa.RecordBatch.from_pydict({"file": [d[0] for d in done], "size": pa.array([d[1] for d in done], pa.int64())})

    return rows.select(F.col(name).cast("string"), octets).mapInArrow(run, "file string, size long")


def product_section(category: Column | int, num: Column | int, unit: Column | int, value: Column | int, surface: Column | int = 255, surface_scale: Column | int = -127, surface_value: Column | int = -2147483647) -> Column:
    """Section 4 with template 4.0: a parameter, a forecast time and one fixed surface."""
    from ..functions.octets import to_sign_magnitude

    signed = lambda v, size: number(to_sign_magnitude(v if isinstance(v, Column) else F.lit(v), 8 * size), size)
    none = F.lit(b"\xff\xff\xff\xff\xff\xff")
    return section(4, F.concat(number(0, 4), number(category, 1), number(num, 1), F.lit(b"\x02\xff\xff\x00\x00\x00"), number(unit, 1), number(value, 4), number(surface, 1), signed(surface_scale, 1), signed(surface_value, 4), none))
