"""From sections to submessages, layers and points: all as DataFrames, keyed by (path, msg, sub).

Submessages are assembled with windows over one message's sections, so that a predicate on (path, msg) is pushed below
them; header fields are cut out of the binary columns by JVM expressions, so that listing and finding layers never starts
Python; only unpacking values and coordinates does, one field a row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import wire
from ..functions import octets as X
from . import decode, grids

KEYS = ("path", "msg", "sub")

# ---- Order of sections (A13, A14) ----

#: Which section may follow which; -1 begins a file. After the last of a submessage 2, 3 or 4 begin another.
NEXT = {-1: (0,), 0: (1,), 1: (2, 3), 2: (3,), 3: (4,), 4: (5,), 5: (6,), 6: (7,), 7: (8, 2, 3, 4), 8: (0,)}


def order_errors(sections: DataFrame) -> DataFrame:
    """(path, pos, kind): the first thing that is wrong in each file's order of sections, if there is any."""
    w = Window.partitionBy("path").orderBy("pos")
    rows = sections.where("num is not null").select("path", "pos", F.col("num").cast("int").alias("num"), F.coalesce(F.lag("num").over(w), F.lit(-1)).cast("int").alias("before"), F.lead("num").over(w).alias("after"))
    allowed = F.lit(False)
    for before, nums in NEXT.items():
        allowed = allowed | ((F.col("before") == before) & F.col("num").isin(*nums))
    wrong = F.when((F.col("before") == 1) & (F.col("num") == 4), "NoGridDefinition").when(~allowed, "InvalidSectionOrder").when(F.col("after").isNull() & (F.col("num") != 8), "UnexpectedEndOfData")
    return rows.withColumn("kind", wrong).where("kind is not null").groupBy("path").agg(F.min(F.struct("pos", "kind")).alias("e")).select("path", "e.pos", "e.kind")


def with_messages(sections: DataFrame) -> DataFrame:
    """``msg`` counted from the sections themselves, for a section list that lacks it."""
    return sections.withColumn("msg", (F.sum(F.when(F.col("num") == 0, 1).otherwise(0)).over(Window.partitionBy("path").orderBy("pos")) - 1).cast("int"))


def submessages(sections: DataFrame, payloads: bool = True) -> DataFrame:
    """One row for each Section 7 (A11, A12): places of its sections s0..s8 and, with ``payloads``, their octets p0..p6.

    Sections 0 to 3 carry forward within a message; a submessage that isn't the last has 0 as its Section 8 (A15).
    """
    w = Window.partitionBy("path", "msg").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ordered = Window.partitionBy("path", "msg").orderBy("pos")
    last = lambda k, c: F.last(F.when(F.col("num") == k, F.col(c)), ignorenulls=True).over(w)
    cols = {f"s{k}": last(k, "pos") for k in range(7)}
    if payloads:
        cols |= {f"p{k}": last(k, "payload") for k in range(7)}
    out = sections.where("num is not null").withColumns(cols | {"_next": F.lead("num").over(ordered), "_next_pos": F.lead("pos").over(ordered)})
    out = out.where("num = 7").withColumns({"s7": F.col("pos"), "s8": F.when(F.col("_next") == 8, F.col("_next_pos")).otherwise(0), "sub": (F.row_number().over(ordered) - 1).cast("int")})
    if payloads:
        out = out.withColumns({"p7": F.col("payload"), "s7_offset": F.col("offset"), "s7_size": F.col("size")})
    keep = [*KEYS, *[f"s{k}" for k in range(9)], *([*[f"p{k}" for k in range(8)], "s7_offset", "s7_size"] if payloads else [])]
    return out.select(*keep)


# ---- Fields of layers (C, D, N) ----

#: Product definition templates whose fields are known.
KNOWN_PRODUCTS = (*range(16), 20, *range(30, 36), *range(40, 50), 51, *range(53, 64), 67, 68, *range(70, 74), *range(76, 89), 91, 254, *range(1000, 1003), 1100, 1101)
#: Where fields begin in Section 4's payload after its first four octets, as (first template, last, place).
PROCESS_AT = ((0, 39, 2), (40, 43, 4), (44, 46, 15), (47, 47, 2), (48, 49, 26), (51, 51, 2), (55, 56, 8), (59, 59, 8), (60, 61, 2), (62, 63, 8), (70, 73, 7), (76, 79, 5), (80, 81, 27), (82, 82, 16), (83, 83, 2), (84, 84, 16), (85, 85, 15), (86, 91, 2), (254, 254, 2), (1000, 1101, 2))
TIME_AT = ((0, 15, 8), (32, 34, 8), (40, 43, 10), (44, 47, 21), (48, 49, 32), (51, 51, 8), (55, 56, 14), (59, 59, 14), (60, 61, 8), (62, 63, 14), (70, 73, 13), (76, 79, 11), (80, 81, 33), (82, 84, 22), (85, 85, 21), (86, 87, 8), (88, 88, 26), (91, 91, 8), (1000, 1101, 8))
SURFACES_AT = ((0, 15, 13), (40, 43, 15), (44, 44, 24), (45, 47, 26), (48, 49, 37), (51, 51, 13), (55, 56, 19), (59, 59, 19), (60, 61, 13), (62, 63, 19), (70, 73, 18), (76, 79, 16), (80, 81, 38), (82, 84, 27), (85, 85, 26), (86, 87, 13), (88, 88, 5), (91, 91, 13), (1100, 1101, 13))


def places(table: tuple) -> dict[int, int]:
    """Octet of Section 4 (with its header) at which a field begins, by template; only templates whose fields are known."""
    return {t: at + 9 for first, last, at in table for t in range(first, last + 1) if t in KNOWN_PRODUCTS}


def layers(subs: DataFrame) -> DataFrame:
    """The fields by which layers are listed and found, of ``submessages`` with octets; nothing here runs Python."""
    u, s = X.unsigned, X.signed
    p0, p1, p3, p4, p5, p6 = (F.col(f"p{k}") for k in (0, 1, 3, 4, 5, 6))
    # templates first, then where their fields begin, then the fields: each step refers to the columns of the one before
    out = subs.withColumns({"prod_tmpl": u(p4, 7, 2), "grid_tmpl": u(p3, 12, 2), "repr_tmpl": u(p5, 9, 2)})
    prod = F.col("prod_tmpl")
    out = out.withColumns({"_known": prod.isin(*KNOWN_PRODUCTS), "_process": X.lookup(prod, places(PROCESS_AT)), "_time": X.lookup(prod, places(TIME_AT)), "_surf": X.lookup(prod, places(SURFACES_AT))})
    known, time, surf = F.col("_known"), F.col("_time"), F.col("_surf")
    names = ("year", "month", "day", "hour", "minute", "second")
    out = out.withColumns(
        {
            "discipline": u(p0, 6, 1), "total_length": u(p0, 9, 7), "centre": u(p1, 5, 2), "subcentre": u(p1, 7, 2), "master_ver": u(p1, 9, 1), "local_ver": u(p1, 10, 1),
            "ref_significance": u(p1, 11, 1), "prod_status": u(p1, 19, 1), "data_type": u(p1, 20, 1), **{f"_{n}": u(p1, 12 + i + (i > 0), 2 if i == 0 else 1) for i, n in enumerate(names)},
            "grid_source": u(p3, 5, 1), "num_points": u(p3, 6, 4), "num_coordinates": u(p4, 5, 2),
            "category": F.when(known, u(p4, 9, 1)), "number": F.when(known, u(p4, 10, 1)), "process": u(p4, F.col("_process"), 1),
            "ft_unit": u(p4, time, 1), "ft_value": u(p4, time + 1, 4),
            "surf1_type": u(p4, surf, 1), "_f1": u(p4, surf + 1, 1), "_v1": u(p4, surf + 2, 4), "surf2_type": u(p4, surf + 6, 1), "_f2": u(p4, surf + 7, 1), "_v2": u(p4, surf + 8, 4),
            "num_encoded": u(p5, 5, 4), "bitmap_indicator": u(p6, 5, 1), "local_use": F.substring(F.col("p2"), 6, 1 << 30),
        }
    )
    date = [F.col(f"_{n}") for n in names]
    sign = X.from_sign_magnitude
    return out.withColumns(
        {
            "ref_text": X.date_text(date), "ref_time": X.timestamp_of(date), "ft_value_signed": sign(F.col("ft_value"), 32),
            "surf1_scale": sign(F.col("_f1"), 8), "surf1_value": sign(F.col("_v1"), 32), "surf2_scale": sign(F.col("_f2"), 8), "surf2_value": sign(F.col("_v2"), 32),
            "parameter": X.parameter_key(F.col("discipline"), F.col("category"), F.col("number")),
            "valid_time": X.target_time(X.timestamp_of(date), F.col("ft_unit"), F.col("ft_value")),
            "grid_name": F.coalesce(X.lookup(F.col("grid_tmpl"), grids.NAMES), F.concat(F.lit("unknown (template "), F.col("grid_tmpl").cast("string"), F.lit(")"))),
            "num_missing": F.col("num_points") - F.col("num_encoded"),
        }
    ).drop("_known", "_process", "_time", "_surf", *[f"_{n}" for n in names], "_f1", "_v1", "_f2", "_v2")


def parse_index(text: str) -> tuple[int, int]:
    """(message, submessage) of ``N.M``."""
    a, dot, b = text.partition(".")
    if not (dot and a.isdigit() and b.isdigit() and a.isascii() and b.isascii()):
        raise ValueError(f"not an index: {text}")
    return int(a), int(b)


def at_index(rows: DataFrame, index: str) -> DataFrame:
    msg, sub = parse_index(index)
    return rows.where((F.col("msg") == msg) & (F.col("sub") == sub))


def at_forecast(rows: DataFrame, unit: int, value: int) -> DataFrame:
    """Layers of a forecast time in this very unit; other units aren't converted."""
    return rows.where((F.col("ft_unit") == unit) & (F.col("ft_value") == value))


def with_parameter(rows: DataFrame, *keys: int) -> DataFrame:
    return rows.where(F.col("parameter").isin(*keys))


#: Parameters by the names that one centre gives them.
NCEP = {"PRES": 0x000300, "PRMSL": 0x000301, "HGT": 0x000305}


def templates(sections: DataFrame) -> DataFrame:
    """(num, template_num): which templates occur, in order (F1)."""
    return sections.where("template_num is not null").select("num", "template_num").distinct().orderBy("num", "template_num")


def typed(payload: Column, num: int) -> Column:
    """Section ``num`` read by its field table, as JSON text with the field names of ``wire``."""
    import json

    def plain(v):
        return {k: plain(x) for k, x in v.items()} if isinstance(v, dict) else v.hex() if isinstance(v, bytes) else v

    @F.pandas_udf("string")
    def read(octets):
        return octets.map(lambda o: None if o is None else json.dumps(plain(wire.parse(wire.section(num), bytes(o))[0])))

    return read(payload)


# ---- Values and coordinates (K, M, E) ----


#: Fields go to Python a few at a time: one may have millions of points however few octets it is packed in.
ROWS_CONF, ROWS_DEFAULT, FIELDS_A_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch", "10000", "16"


def small_batches(spark) -> None:
    """Lower Spark's number of rows in an Arrow batch; what the user has set stays."""
    if spark.conf.get(ROWS_CONF) == ROWS_DEFAULT:
        spark.conf.set(ROWS_CONF, FIELDS_A_BATCH)


def values_udf(mode: str = "FAILFAST", decoders: dict | None = None):
    """(num_points, section 5, section 6, section 7) -> array<float>; in PERMISSIVE mode null where decoding fails."""
    from ..errors import GribError

    def one(points, s5, s6, s7):
        if points is None or s5 is None or s6 is None or s7 is None:
            return None
        try:
            return decode.decode_field(int(points), bytes(s5), bytes(s6), bytes(s7), decoders)
        except GribError:
            if mode == "FAILFAST":
                raise
            return None

    @F.arrow_udf("array<float>")
    def run(points: pa.Array, s5: pa.Array, s6: pa.Array, s7: pa.Array) -> pa.Array:
        return pa.array([one(*x) for x in zip(points.to_pylist(), s5.to_pylist(), s6.to_pylist(), s7.to_pylist(), strict=True)], pa.list_(pa.float32()))

    return run


def coordinates_udf(normalize: bool, fallback: bool):
    """section 3 -> struct of arrays lat, lon; with ``fallback``, null where the grid isn't supported, else that raises."""
    from ..errors import NotSupported

    kind = pa.struct([("lat", pa.list_(pa.float32())), ("lon", pa.list_(pa.float32()))])

    def one(s3):
        if s3 is None:
            return None
        try:
            lat, lon = grids.lat_lons(bytes(s3), normalize)
        except NotSupported:
            if not fallback:
                raise
            return None
        return {"lat": lat, "lon": lon}

    @F.arrow_udf("struct<lat: array<float>, lon: array<float>>")
    def run(s3: pa.Array) -> pa.Array:
        return pa.array([one(x) for x in s3.to_pylist()], kind)

    return run


def fields(subs: DataFrame, mode: str = "FAILFAST", decoders: dict | None = None) -> DataFrame:
    """``subs`` (with all octets) and ``values``, one array of a float for each point."""
    small_batches(subs.sparkSession)
    points = X.unsigned(F.col("p3"), 6, 4)
    return subs.withColumn("values", values_udf(mode, decoders)(points, "p5", "p6", "p7"))


def points(subs: DataFrame, mode: str = "FAILFAST", normalize: bool = True, fallback: bool = True, decoders: dict | None = None, more_grids: dict | None = None) -> DataFrame:
    """(path, msg, sub, pt, lat, lon, value): every point of every field, NaN where there is no value.

    decoders, more_grids: functions by template number beyond the built-in ones; they go to the executors with the plan.

    Values and coordinates are made in one Python step for each field and taken apart with an outer explode, which keeps
    Catalyst from running the step twice; a filter on the keys goes below it.
    """
    from ..errors import GribError, NotSupported

    parts = ("lat", "lon", "value")
    kind = pa.struct([(c, pa.list_(pa.float32())) for c in parts])

    def one(s3, s5, s6, s7):
        if None in (s3, s5, s6, s7):
            return None
        try:
            n = int.from_bytes(s3[6:10], "big")
            value = decode.decode_field(n, bytes(s5), bytes(s6), bytes(s7), decoders)
        except GribError:
            if mode == "FAILFAST":
                raise
            return None
        try:
            lat, lon = grids.lat_lons(bytes(s3), normalize, more_grids)
        except NotSupported:
            if not fallback:
                raise
            lat = lon = np.full(n, np.nan, np.float32)
        return dict(zip(parts, (lat, lon, value), strict=True))

    @F.arrow_udf("struct<lat: array<float>, lon: array<float>, value: array<float>>")
    def run(s3: pa.Array, s5: pa.Array, s6: pa.Array, s7: pa.Array) -> pa.Array:
        return pa.array([one(*x) for x in zip(s3.to_pylist(), s5.to_pylist(), s6.to_pylist(), s7.to_pylist(), strict=True)], kind)

    small_batches(subs.sparkSession)
    made = subs.select(*KEYS, run("p3", "p5", "p6", "p7").alias("made"))
    # three arrays of four octets a point; coordinates are looked up by the value's place
    flat = made.select(*KEYS, "made", F.posexplode_outer("made.value").alias("pt", "value"))
    return flat.select(*KEYS, F.col("pt").cast("long").alias("pt"), F.get(F.col("made.lat"), F.col("pt")).alias("lat"), F.get(F.col("made.lon"), F.col("pt")).alias("lon"), "value")


def dumped(subs: DataFrame) -> DataFrame:
    """(path, msg, sub, line, text): the annotated text of each submessage."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                parts = {k: r[f"p{k}"] for k in range(1, 7)}
                head = r["p0"]
                parts[7] = int(r["s7_size"]).to_bytes(4, "big")
                lines = wire.dump_message(parts, int.from_bytes(head[8:16], "big"))
                n = len(lines)
                yield pa.RecordBatch.from_pydict({"path": pa.array([r["path"]] * n, pa.string()), "msg": pa.array([r["msg"]] * n, pa.int32()), "sub": pa.array([r["sub"]] * n, pa.int32()), "line": pa.array(range(n), pa.int32()), "text": lines})

    return subs.select(*KEYS, *[f"p{k}" for k in range(7)], "s7_size").mapInArrow(run, "path string, msg int, sub int, line int, text string")
