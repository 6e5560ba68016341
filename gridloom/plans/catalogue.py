"""Queries over the driver's tables, one for each operator, and the same in SQL.

The tables hold no messages, so that fields are made of them: a group of rows is a field, a numeric column its values and
a unique key the order of its points. Queries that are about octets build real messages, read them back and are compared
with what the rules of packing say the values must be.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import codes, frames
from ..bits import pack, sint, unpack
from ..errors import DecodeError, GribError, NotSupported
from ..functions import octets as X
from ..operators import decode, encode, grids
from ..operators import relations as R
from ..ship import ship
from ..sources import grib, sinks
from . import reports

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def big(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("bigint")


def real(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("double")


def applied(work, kind: str, arrow: pa.DataType, **columns: Column) -> Column:
    """``work`` of the library's functions, by row: keyword arguments of these names -> a value of this type."""

    @F.arrow_udf(kind)
    def run(rows: pa.Array) -> pa.Array:
        return pa.array([work(**r) for r in rows.to_pylist()], arrow)

    return run(F.struct(*[c.alias(n) for n, c in columns.items()]))


FIELD_KIND, FIELD_ARROW = "struct<n: int, s5: binary, s6: binary, s7: binary>", pa.struct([("n", pa.int32()), ("s5", pa.binary()), ("s6", pa.binary()), ("s7", pa.binary())])
FIRST_ARROW = pa.list_(pa.int64())


def decoded(fields: DataFrame, key: str) -> DataFrame:
    """(key, pt, value): fields (key, f) of sections, through the library's decoder; NaN is null."""
    back = fields.select(key, R.values_udf()("f.n", "f.s5", "f.s6", "f.s7").alias("values"))
    x = real("value")
    return back.select(key, F.posexplode_outer("values").alias("pt", "value")).select(key, big("pt"), F.when(~F.isnan("value"), x + 0.0).alias("value"))


def grouped_codes(codes: np.ndarray, each: int) -> tuple[dict, int, bytes]:
    """Fields of complex packing, bits of the references, and octets: groups of ``each`` codes (0: one group)."""
    n = len(codes)
    starts = np.arange(0, n, each or n)
    lengths = np.diff(np.r_[starts, n])
    refs = np.minimum.reduceat(codes, starts)
    widths = [int(x).bit_length() for x in np.maximum.reduceat(codes, starts) - refs]
    bits, narrow = max(1, int(refs.max()).bit_length()), min(widths)
    more = (max(widths) - narrow).bit_length()
    values = encode.pack_each(codes - np.repeat(refs, lengths), np.repeat(widths, lengths))
    shape = {"group_splitting_method": 1, "missing_value_management": 0, "primary_missing_value": 0xFFFFFFFF, "secondary_missing_value": 0xFFFFFFFF, "num_groups": len(starts), "group_width_ref": narrow, "num_group_width_bits": more}
    shape |= {"group_len_ref": int(lengths[0]), "group_len_inc": 1, "group_len_last": int(lengths[-1]), "num_group_len_bits": 0}
    return shape, bits, pack(refs, bits) + (pack(np.array(widths) - narrow, more) if more else b"") + values


def complex_field(values: list[float], each: int) -> dict:
    """A field of whole numbers in complex packing."""
    v = np.array(values, np.int64)
    shape, bits, data = grouped_codes(v - v.min(), each)
    simple = {"ref_val": float(v.min()), "exp": 0, "dec": 0, "num_bits": bits}
    return {"n": len(v), "s5": encode.section5(len(v), 2, {"simple": simple, "orig_field_type": 0, "complex": shape}), "s6": encode.section(6, b"\xff"), "s7": encode.section(7, data)}


def difference_field(values: list[float], order: int) -> dict:
    """A field of whole numbers in complex packing with spatial differencing."""
    v = np.array(values, np.int64)
    steps = np.diff(v, order) if len(v) > order else np.zeros(0, np.int64)
    least = int(steps.min()) if len(steps) else 0
    shape, bits, data = grouped_codes(np.r_[np.zeros(min(order, len(v)), np.int64), steps - least], 4)
    signed = lambda x: (abs(int(x)) | (0x80000000 if x < 0 else 0)).to_bytes(4, "big")
    first = b"".join(signed(x) for x in np.r_[v, np.zeros(order, np.int64)][:order]) + signed(least)
    template = {"simple": {"ref_val": 0.0, "exp": 0, "dec": 0, "num_bits": bits}, "orig_field_type": 0, "complex": shape, "spatial_diff_order": order, "num_extra_desc_octets": 4}
    return {"n": len(v), "s5": encode.section5(len(v), 3, template), "s6": encode.section(6, b"\xff"), "s7": encode.section(7, first + data)}


def run_length_field(levels: list[int], values: list[int]) -> dict:
    """A field of levels in run-length packing of an octet, where lengths have digits of base 5."""
    base, codes = 251, []
    x = np.array(levels)
    starts = np.flatnonzero(np.r_[True, x[1:] != x[:-1]])
    for a, b in zip(starts, [*starts[1:], len(x)], strict=True):
        codes.append(int(x[a]))
        more = int(b - a) - 1
        while more:
            codes.append(base + more % 5)
            more //= 5
    template = {"num_bits": 8, "max_val": 250, "max_level": len(values), "dec": 1, "level_vals": values}
    return {"n": len(x), "s5": encode.section5(len(x), 200, template), "s6": encode.section(6, b"\xff"), "s7": encode.section(7, bytes(codes))}


# ---- Packing (F2, F3, L2, K1, K2) ----


@query("""select l_returnflag, l_linestatus, min(l_extendedprice * 10) as low, max(l_extendedprice * 10) as high,
 cast(case when round(max(l_extendedprice * 10) - min(l_extendedprice * 10)) = 0 then 0 else length(bin(cast(round(max(l_extendedprice * 10) - min(l_extendedprice * 10)) as bigint))) end as bigint) as num_bits,
 count(*) as n from lineitem group by 1, 2""")
def pack_params_simple(spark, sf_dir):
    x = F.col("l_extendedprice") * 10
    g = read(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.min(x).alias("low"), F.max(x).alias("high"), F.count("*").alias("n"))
    return g.withColumn("num_bits", big(X.bits_required(F.round(F.col("high") - F.col("low")))))


@query("""select p_size, cast(case when p_size = 0 then 0 else length(bin(p_size)) end as bigint) as bits, count(*) as n from part group by 1, 2
union all select 0, 0, 0""")
def bits_required(spark, sf_dir):
    rows = read(spark, sf_dir, "part").groupBy("p_size").agg(F.count("*").alias("n"))
    return rows.unionByName(spark.range(1).select(F.lit(0).alias("p_size"), F.lit(0).cast("bigint").alias("n"))).select("p_size", big(X.bits_required(F.col("p_size"))).alias("bits"), "n")


@query("""select vec_id, cast(ceil(cast(64 * length(bin(greatest(label, 1))) as double) / 8) as bigint) as n_octets from embeddings""")
def packed_octets(spark, sf_dir):
    return read(spark, sf_dir, "embeddings").select("vec_id", big(X.octets(F.lit(64) * X.bits_required(F.greatest("label", F.lit(1))))).alias("n_octets"))


PRICES = """with p as (select cast(floor(o_orderkey / 64) as bigint) as grp, o_orderkey, o_totalprice as v from orders),
r as (select grp, cast(min(v) as float) as r from p group by 1)"""


@query(PRICES + """ select grp, row_number() over (partition by grp order by o_orderkey) - 1 as pt, cast(r + cast(greatest(round(v - cast(r as double)), 0) as float) as double) as value from p join r using (grp)""")
def pack_roundtrip_price(spark, sf_dir):
    rows = read(spark, sf_dir, "orders").withColumn("grp", F.floor(F.col("o_orderkey") / 64).cast("bigint"))
    f = sinks.gathered(rows, ["grp"], "o_orderkey", "o_totalprice").select("grp", F.size("values").alias("n"), sinks.encode_field(F.col("values"), 0).alias("f"))
    return decoded(f.select("grp", F.struct("n", "f.s5", "f.s6", "f.s7").alias("f")), "grp")


@query("""with r as (select c_nationkey, cast(cast(min(c_acctbal * 10) as float) as double) as r from customer group by 1)
select c_nationkey, row_number() over (partition by c_nationkey order by c_custkey) - 1 as pt, cast(greatest(round(c_acctbal * 10 - r), 0) as bigint) as code from customer join r using (c_nationkey)""")
def quantised_codes(spark, sf_dir):
    f = sinks.gathered(read(spark, sf_dir, "customer"), ["c_nationkey"], "c_custkey", "c_acctbal")
    codes = applied(lambda values: encode.quantise(np.array(values), 1).codes.tolist(), "array<long>", FIRST_ARROW, values=F.col("values"))
    return f.select("c_nationkey", F.posexplode(codes).alias("pt", "code")).select("c_nationkey", big("pt"), "code")


@query("""select c_nationkey, row_number() over (partition by c_nationkey order by c_custkey) - 1 as pt, round(c_acctbal) + 0.0 as value from customer""")
def complex_groups(spark, sf_dir):
    """Groups of seven, each with a reference and a width of its own."""
    f = sinks.gathered(read(spark, sf_dir, "customer").withColumn("v", F.round("c_acctbal")), ["c_nationkey"], "c_custkey", "v")
    return decoded(f.select("c_nationkey", applied(lambda values: complex_field(values, 7), FIELD_KIND, FIELD_ARROW, values=F.col("values")).alias("f")), "c_nationkey")


@query("""with l as (select c_nationkey, list(cast(10 + 6 * (c_custkey % 4) as bigint)) as lens from customer group by 1),
g as (select c_nationkey, list_min(lens) as least, list_max(lens) as most, cast(list_reduce(list_prepend(0::bigint, list_transform(lens, lambda x: x - list_min(lens))), lambda a, b: gcd(a, b)) as bigint) as step from l)
select c_nationkey, least, step, cast(case when step = 0 then 0 else length(bin((most - least) // step)) end as bigint) as bits from g""")
def group_length_code(spark, sf_dir):
    lens = F.collect_list(10 + 6 * (F.col("c_custkey") % 4))
    code = applied(lambda lens: encode.length_code(lens), "array<long>", FIRST_ARROW, lens=F.col("lens"))
    found = read(spark, sf_dir, "customer").groupBy("c_nationkey").agg(lens.alias("lens")).select("c_nationkey", code.alias("c"))
    return found.select("c_nationkey", *[F.col("c")[i].alias(n) for i, n in enumerate(("least", "step", "bits"))])


# ---- Sequences (G) ----


ROUNDED = """select user_id, row_number() over (partition by user_id order by event_id) - 1 as pt, round(value) + 0.0 as value from events"""


def differences(spark: SparkSession, sf_dir: str, order: int) -> DataFrame:
    f = sinks.gathered(read(spark, sf_dir, "events").withColumn("v", F.round("value")), ["user_id"], "event_id", "v")
    return decoded(f.select("user_id", applied(lambda values: difference_field(values, order), FIELD_KIND, FIELD_ARROW, values=F.col("values")).alias("f")), "user_id")


@query(ROUNDED)
def undiff_first_order(spark, sf_dir):
    return differences(spark, sf_dir, 1)


@query(ROUNDED)
def undiff_second_order(spark, sf_dir):
    return differences(spark, sf_dir, 2)


@query("""select user_id, row_number() over (partition by user_id order by event_id) - 1 as pt, round(value) + 0.0 as value from events""")
def png_fields(spark, sf_dir):
    """Images of one line of 16-bit samples."""

    def field(values):
        chunk = lambda name, body: len(body).to_bytes(4, "big") + name + body + zlib.crc32(name + body).to_bytes(4, "big")
        head = len(values).to_bytes(4, "big") + (1).to_bytes(4, "big") + bytes([16, 0, 0, 0, 0])
        image = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(b"\0" + pack(np.array(values, np.int64), 16))) + chunk(b"IEND", b"")
        template = {"simple": {"ref_val": 0.0, "exp": 0, "dec": 0, "num_bits": 16}, "orig_field_type": 0}
        return {"n": len(values), "s5": encode.section5(len(values), 41, template), "s6": encode.section(6, b"\xff"), "s7": encode.section(7, image)}

    f = sinks.gathered(read(spark, sf_dir, "events").withColumn("v", F.round("value")), ["user_id"], "event_id", "v")
    return decoded(f.select("user_id", applied(field, FIELD_KIND, FIELD_ARROW, values=F.col("values")).alias("f")), "user_id")


@query("""select user_id, row_number() over (partition by user_id order by event_id) - 1 as pt, round(value) + 0.0 as value from events""")
def ccsds_fields(spark, sf_dir):
    """Blocks of eight 16-bit samples without compression."""

    def field(values):
        x = np.r_[np.array(values, np.int64), np.zeros(-len(values) % 8, np.int64)].reshape(-1, 8)
        codes, widths = np.c_[np.full(len(x), 15), x].ravel(), np.tile([4, *[16] * 8], len(x))
        template = {"simple": {"ref_val": 0.0, "exp": 0, "dec": 0, "num_bits": 16}, "orig_field_type": 0, "mask": 4, "block_size": 8, "ref_sample_interval": 128}
        return {"n": len(values), "s5": encode.section5(len(values), 42, template), "s6": encode.section(6, b"\xff"), "s7": encode.section(7, encode.pack_each(codes, widths))}

    f = sinks.gathered(read(spark, sf_dir, "events").withColumn("v", F.round("value")), ["user_id"], "event_id", "v")
    return decoded(f.select("user_id", applied(field, FIELD_KIND, FIELD_ARROW, values=F.col("values")).alias("f")), "user_id")


@query("""select s_suppkey, case when s_suppkey % 5 = 0 or s_suppkey % 3 = 2 then 'NotSupported' when s_suppkey % 7 = 3 then 'DecodeError' when s_suppkey % 2 = 1 then 'NotSupported' end as kind from supplier""")
def decode_checks(spark, sf_dir):
    """Fields that can't be decoded: unknown templates and bitmap indicators, integer originals, too few values."""

    def kind(template, bitmap, original, missing):
        n, body = 4, {"simple": {"ref_val": 0.0, "exp": 0, "dec": 0, "num_bits": 8}, "orig_field_type": original}
        s5 = bytearray(encode.section5(n, 0, body))
        if template:
            s5[9:11] = (1234).to_bytes(2, "big")
        try:
            decode.decode_field(n + missing, bytes(s5), encode.section(6, bytes([254 if bitmap else 255])), encode.section(7, b"\1\2\3\4"))
        except GribError as e:
            return "DecodeError" if isinstance(e, DecodeError) else type(e).__name__
        return None

    k = F.col("s_suppkey")
    made = applied(kind, "string", pa.string(), template=k % 5 == 0, bitmap=k % 3 == 2, original=(k % 2).cast("int"), missing=(k % 7 == 3).cast("int"))
    return read(spark, sf_dir, "supplier").select("s_suppkey", made.alias("kind"))


#: Points of small grids in all scanning modes, from the suppliers' keys.
SHAPE = "(s_suppkey % 16) * 16 as mode, 3 + s_suppkey % 5 as ni, 2 + s_suppkey % 4 as nj"


@query(f"""with g as (select s_suppkey, {SHAPE} from supplier), p as (select *, unnest(range(ni * nj)) as pt from g),
q as (select *, case when mode & 32 = 0 then ni else nj end as fast from p),
m as (select *, pt // fast as slow, case when mode & 16 <> 0 and (pt // fast) % 2 = 1 then fast - 1 - pt % fast else pt % fast end as quick from q)
select s_suppkey, cast(pt as bigint) as pt, cast(case when mode & 32 = 0 then quick else slow end as bigint) as i, cast(case when mode & 32 = 0 then slow else quick end as bigint) as j from m""")
def grid_index_scan(spark, sf_dir):
    def index(mode, ni, nj):
        i, j = grids.grid_index(ni, nj, mode)
        return [{"i": int(a), "j": int(b)} for a, b in zip(i, j, strict=True)]

    k = F.col("s_suppkey")
    made = applied(index, "array<struct<i: long, j: long>>", pa.list_(pa.struct([("i", pa.int64()), ("j", pa.int64())])), mode=(k % 16) * 16, ni=3 + k % 5, nj=2 + k % 4)
    return read(spark, sf_dir, "supplier").select("s_suppkey", F.posexplode(made).alias("pt", "x")).select("s_suppkey", big("pt"), "x.i", "x.j")


@query("""select user_id, row_number() over (partition by user_id order by event_id) - 1 as pt, case event_type when 'view' then 1.5 when 'click' then 2.5 when 'purchase' then 4.0 when 'signup' then 6.5 end as value from events""")
def run_length_fields(spark, sf_dir):
    """Levels of events as fields; an error has none and is a missing point."""
    kind = F.array_position(F.array(*map(F.lit, ("view", "click", "purchase", "signup"))), F.col("event_type"))
    f = sinks.gathered(read(spark, sf_dir, "events").withColumn("v", F.coalesce(kind, F.lit(0))), ["user_id"], "event_id", "v")
    return decoded(f.select("user_id", applied(lambda values: run_length_field(values, [15, 25, 40, 65]), FIELD_KIND, FIELD_ARROW, values=F.col("values")).alias("f")), "user_id")



# ---- Bitmaps (E2, K10, K11, G8, F4) ----


def bitmaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(user_id, present, dense): which of a user's events aren't errors, in order, and these events' values."""
    e = F.array_sort(F.collect_list(F.struct("event_id", (F.col("event_type") != "error").alias("bit"), "value")))
    rows = read(spark, sf_dir, "events").groupBy("user_id").agg(e.alias("e"))
    return rows.select("user_id", F.transform("e", lambda x: x["bit"]).alias("present"), F.transform(F.filter("e", lambda x: x["bit"]), lambda x: x["value"]).alias("dense"))


@query("""select user_id, row_number() over (partition by user_id order by event_id) - 1 as pt, case when event_type <> 'error' then cast(cast(value as float) as double) end as value from events""")
def bitmap_scatter(spark, sf_dir):
    """Dense values go to the places of set bits, by the octets of a bitmap."""

    def scattered(present, dense):
        octets = encode.section6(np.array(present))
        bits = decode.bitmap_bits(len(present), len(dense), octets[6:] if octets[5] == 0 else None)
        return decode.scatter(bits, np.array(dense, np.float32)).tolist()

    made = applied(scattered, "array<float>", pa.list_(pa.float32()), present=F.col("present"), dense=F.col("dense"))
    out = bitmaps(spark, sf_dir).select("user_id", F.posexplode(made).alias("pt", "value"))
    return out.select("user_id", big("pt"), F.when(~F.isnan("value"), real("value")).alias("value"))


@query("""select user_id, user_id % 2 = 0 as consistent from events group by 1""")
def bitmap_consistency(spark, sf_dir):
    """A bitmap with as many set bits as encoded values is good, one with another number isn't."""

    def good(present, encoded):
        try:
            decode.bitmap_bits(len(present), encoded, np.packbits(present).tobytes())
        except DecodeError:
            return False
        return True

    claimed = F.size("dense") + F.col("user_id") % 2
    return bitmaps(spark, sf_dir).select("user_id", applied(good, "boolean", pa.bool_(), present=F.col("present"), encoded=claimed).alias("consistent"))


# ---- Octets and numbers (J, C, D) ----


@query("""with v as (select o_orderkey, cast(o_orderkey % 256 as bigint) as x from orders)
select o_orderkey, case when x >= 128 then -(x - 128) else x end as value, case when x >= 128 then -(x - 128) else x end <> 0 or x = 0 as round_trip from v""")
def sign_magnitude(spark, sf_dir):
    v = read(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderkey") % 256).alias("x")).withColumn("value", X.from_sign_magnitude(F.col("x"), 8))
    return v.select("o_orderkey", "value", (X.to_sign_magnitude(F.col("value"), 8) == F.col("x")).alias("round_trip"))


@query("""select c_nationkey, row_number() over (partition by c_nationkey order by c_custkey) - 1 as pt, cast(c_custkey % 1024 as bigint) as value from customer""")
def bits_roundtrip(spark, sf_dir):
    """Numbers of ten bits, written and read after some bits."""
    f = sinks.gathered(read(spark, sf_dir, "customer").withColumn("v", F.col("c_custkey") % 1024), ["c_nationkey"], "c_custkey", "v")
    back = applied(lambda values, offset: unpack(pack(np.array(values, np.int64), 10, offset), 10, len(values), offset).tolist(), "array<long>", FIRST_ARROW, values=F.col("values"), offset=F.col("c_nationkey") % 13)
    return f.select("c_nationkey", F.posexplode(back).alias("pt", "value")).select("c_nationkey", big("pt"), "value")


@query("""select o_orderkey, cast(1 + o_orderkey % 4 as bigint) as size, cast(case when o_orderkey % 3 = 0 then -(o_orderkey % 100) else o_orderkey % 100 end as bigint) as value from orders""")
def signed_octets(spark, sf_dir):
    """Signed numbers of one to four octets."""
    k = F.col("o_orderkey")
    size, value = 1 + k % 4, k % 100
    octets = lambda size, value, minus: (value | (1 << 8 * size - 1 if minus else 0)).to_bytes(size, "big")
    made = applied(lambda size, value, minus: sint(octets(size, value, minus), 0, size), "long", pa.int64(), size=size, value=value, minus=k % 3 == 0)
    return read(spark, sf_dir, "orders").select("o_orderkey", size.alias("size"), made.alias("value"))


@query("""select o_orderkey, o_orderkey as value from orders""")
def octets_roundtrip(spark, sf_dir):
    """Numbers written as six big-endian octets and read back inside the JVM."""
    return read(spark, sf_dir, "orders").select("o_orderkey", X.unsigned(sinks.number(F.col("o_orderkey"), 6), 0, 6).alias("value"))


@query("""with v as (select s_suppkey, case when s_suppkey % 5 = 0 then -2147483647 else s_suppkey * 37 - 900 end as v, s_suppkey % 4 - 1 as sf from supplier)
select s_suppkey, case when v = -2147483647 then null else round(v * pow(10, -sf), 6) end as value from v""")
def surface_value(spark, sf_dir):
    k = F.col("s_suppkey")
    v = read(spark, sf_dir, "supplier").select("s_suppkey", F.when(k % 5 == 0, F.lit(-2147483647)).otherwise(k * 37 - 900).alias("v"), (k % 4 - 1).alias("sf"))
    x = X.scaled_value(F.col("sf"), F.col("v"))
    return v.select("s_suppkey", F.when(~F.isnan(x), F.round(x, 6)).alias("value"))


@query("""select o_orderkey, cast((o_orderkey * 0.75 - 900 + 540) % 360 - 180 as double) as lon from orders""")
def lon_normalize(spark, sf_dir):
    return read(spark, sf_dir, "orders").select("o_orderkey", X.normalized_longitude(F.col("o_orderkey") * F.lit(0.75) - 900).alias("lon"))


@query("""select c_custkey, cast(case when c_custkey * 0.5 - 360 < 0 then c_custkey * 0.5 - 360 + 360 else c_custkey * 0.5 - 360 end as double) as lon,
 cast(trunc((c_custkey % 90 + 0.25) * 1e6) as bigint) as micro from customer""")
def eastern_microdegrees(spark, sf_dir):
    c = F.col("c_custkey")
    return read(spark, sf_dir, "customer").select("c_custkey", real(X.eastern_longitude(c * F.lit(0.5) - 360)).alias("lon"), big(X.microdegrees(c % 90 + F.lit(0.25))).alias("micro"))


@query("""select distinct cast((l_linenumber << 16) + (cast(l_quantity as bigint) << 8) + cast(round(l_discount * 100) as bigint) as bigint) as parameter from lineitem""")
def parameter_key24(spark, sf_dir):
    key = X.parameter_key(F.col("l_linenumber"), F.col("l_quantity").cast("bigint"), F.round(F.col("l_discount") * 100).cast("bigint"))
    return read(spark, sf_dir, "lineitem").select(big(key).alias("parameter")).distinct()


@query("""with m as (select s_suppkey, cast(s_suppkey % 256 as bigint) as m from supplier)
select s_suppkey, (m & 128) = 0 as plus_i, (m & 64) <> 0 as plus_j, (m & 32) = 0 as i_runs, (m & 16) <> 0 as alternating, (m & 15) <> 0 as unsupported from m""")
def scanning_flags(spark, sf_dir):
    """What the library makes of each scanning mode: directions, and the order of a 3 by 3 grid."""

    def flags(mode):
        try:
            grids.grid_index(3, 3, mode)
            unsupported = False
        except NotSupported:
            unsupported = True
        i, j = grids.grid_index(3, 3, mode & 0xF0)
        i_runs = bool(i[1] != i[0])
        return {"plus_i": grids.plus_i(mode), "plus_j": grids.plus_j(mode), "i_runs": i_runs, "alternating": bool((i if i_runs else j)[3]), "unsupported": unsupported}

    names = ("plus_i", "plus_j", "i_runs", "alternating", "unsupported")
    made = applied(flags, f"struct<{', '.join(f'{n}: boolean' for n in names)}>", pa.struct([(n, pa.bool_()) for n in names]), mode=F.col("s_suppkey") % 256)
    return read(spark, sf_dir, "supplier").select("s_suppkey", made.alias("x")).select("s_suppkey", "x.*")


@query("""with m as (select s_suppkey, cast(s_suppkey % 256 as bigint) as m from supplier)
select s_suppkey, case when (m & 63) = 0 then (m & 128) = 0 end as north, (m & 63) <> 0 as unsupported from m""")
def projection_flags(spark, sf_dir):
    """Which pole a projection centre flag names: a step of 1000 km from 60 degrees north is over 5 degrees only on a northern plane."""

    def flags(centre):
        g = {"earth_shape": encode.SPHERE, "ni": 1, "nj": 2, "first_point_lat": 60_000_000, "first_point_lon": 0, "lad": 60_000_000, "lov": 0, "dx": 1_000_000_000, "dy": 1_000_000_000, "projection_centre": centre, "scanning_mode": 0x40}
        try:
            lat, _ = grids.polar_stereographic(g)
        except NotSupported:
            return {"north": None, "unsupported": True}
        return {"north": bool(lat[1] - lat[0] > 5), "unsupported": False}

    made = applied(flags, "struct<north: boolean, unsupported: boolean>", pa.struct([("north", pa.bool_()), ("unsupported", pa.bool_())]), centre=F.col("s_suppkey") % 256)
    return read(spark, sf_dir, "supplier").select("s_suppkey", made.alias("x")).select("s_suppkey", "x.*")


@query("""with k as (select c_custkey, 260 + c_custkey % 55 as k from customer)
select c_custkey, cast(case when k > 308.15 then 180 when k > 303.15 then 255 when k > 298.15 then 255 when k > 293.15 then 250 when k > 288.15 then 255 when k > 283.15 then 255 when k > 278.15 then 185 else 0 end as bigint) as red,
 cast(case when k > 308.15 then 0 when k > 303.15 then 40 when k > 298.15 then 153 when k > 293.15 then 245 when k > 288.15 then 255 when k > 283.15 then 255 when k > 278.15 then 235 when k > 273.15 then 150 when k > 268.15 then 65 else 32 end as bigint) as green from k""")
def colour_ramp(spark, sf_dir):
    c = X.temperature_colour(real(260 + F.col("c_custkey") % 55))
    return read(spark, sf_dir, "customer").select("c_custkey", big(c[0]).alias("red"), big(c[1]).alias("green"))


# ---- Time (N) ----


@query("""select event_id, case when event_id % 8 = 7 then null else ts + to_seconds(cast((event_id % 5) * [1, 60, 3600, 10800, 21600, 43200, 86400][cast(event_id % 8 as integer) + 1] as bigint)) end as valid_time from events""")
def forecast_target(spark, sf_dir):
    units = F.create_map(*[F.lit(x) for kv in enumerate((13, 0, 1, 10, 11, 12, 2, 3)) for x in kv])
    e = read(spark, sf_dir, "events")
    return e.select("event_id", X.target_time(F.col("ts"), F.element_at(units, (F.col("event_id") % 8).cast("int")), F.col("event_id") % 5).cast(e.schema["ts"].dataType).alias("valid_time"))


@query("""with d as (select event_id, 2000 + event_id % 24 as y, 1 + event_id % 13 as m, 1 + event_id % 31 as d from events)
select event_id, case when m <= 12 and d <= day(last_day(make_date(cast(y as integer), cast(least(m, 12) as integer), 1))) then make_timestamp(y, m, d, event_id % 24, 30, 0.0) end as ref_time from d""")
def ref_time_checked(spark, sf_dir):
    k = F.col("event_id")
    t = X.timestamp_of([2000 + k % 24, 1 + k % 13, 1 + k % 31, k % 24, F.lit(30), F.lit(0)])
    return read(spark, sf_dir, "events").select("event_id", t.cast("timestamp_ntz").alias("ref_time"))


@query("""with u(u, short) as (values (0, 'm'), (1, 'h'), (2, 'D'), (3, 'M'), (4, 'Y'), (5, '10Y'), (6, '30Y'), (7, 'C'), (10, '3h'), (11, '6h'), (12, '12h'), (13, 's'))
select s_suppkey, concat(s_suppkey * 3, case when s_suppkey % 16 = 15 then '' else coalesce(' [' || short || ']', concat(' [unit: ', s_suppkey % 16, ']')) end) as forecast
from supplier left join u on u.u = s_suppkey % 16""")
def forecast_texts(spark, sf_dir):
    unit = F.when(F.col("s_suppkey") % 16 == 15, 255).otherwise(F.col("s_suppkey") % 16)
    return read(spark, sf_dir, "supplier").select("s_suppkey", X.forecast_text(unit, F.col("s_suppkey") * 3).alias("forecast"))


# ---- Grids (M) ----

CENTRE = {"resolution_and_component_flags": 0, "projection_centre": 0, "scanning_mode": 0x40}


def grid_points(rows: DataFrame, key: str, number: int, make, points: Column, **columns: Column) -> DataFrame:
    """(key, pt, lat, lon) of a grid for each row: ``make`` gives the fields of the template, Section 3 goes through the library."""
    made = applied(lambda points, **x: encode.section3(points, number, make(**x)), "binary", pa.binary(), points=points, **columns)
    c = rows.select(big(key).alias(key), R.coordinates_udf(False, False)(made).alias("c"))
    flat = c.select(key, F.posexplode_outer(F.arrays_zip(F.col("c.lat").alias("lat"), F.col("c.lon").alias("lon"))).alias("pt", "p"))
    return flat.select(key, big("pt"), real("p.lat").alias("lat"), (real("p.lon") + 0.0).alias("lon"))


@query("""with g as (select s_suppkey, 80 - s_suppkey % 40 as first, 4 * (1 + s_suppkey % 7) as span from supplier), p as (select *, unnest(range(5)) as j from g), q as (select *, unnest(range(2)) as i from p),
f as (select s_suppkey, j * 2 + i as pt, cast(first * 1000000 as float) as a, cast((first - span) * 1000000 as float) as z, j, i from q)
select s_suppkey, cast(pt as bigint) as pt, cast((a + cast(j as float) * ((z - a) / cast(4 as float))) * cast(1e-6 as float) as double) as lat, cast(cast((10 + 10 * i) * 1000000 as float) * cast(1e-6 as float) as double) as lon from f""")
def regular_grid(spark, sf_dir):
    def make(first, span):
        g = encode.lat_lon_grid((2, 5), (float(first), 10.0), (float(first - span), 20.0))
        return {"earth": encode.SPHERE, "lat_lon": g}

    k = F.col("s_suppkey")
    return grid_points(read(spark, sf_dir, "supplier"), "s_suppkey", 0, make, F.lit(10), first=80 - k % 40, span=4 * (1 + k % 7))


#: A grid of 3 by 2 points for each supplier: its first point and the distance of its points in metres.
PLANE = "select s_suppkey, radians(40 + s_suppkey % 30) as lat, radians({west} + s_suppkey % 40) as lon, (50 + s_suppkey % 50) * 1000.0 as d, {more} from supplier"
STEPS = "p as (select *, unnest(range(6)) as pt from f), q as (select *, x + (pt % 3) * d as u, y + (pt // 3) * d as v from p)"
FLOAT = "cast(cast(degrees({}) as float) as double)"


def plane(lad: int, lov: int, **more):
    return lambda lat, lon, km: {"earth_shape": encode.SPHERE, "ni": 3, "nj": 2, "first_point_lat": lat * 1_000_000, "first_point_lon": lon * 1_000_000, "lad": lad * 1_000_000, "lov": lov * 1_000_000, "dx": km * 1_000_000, "dy": km * 1_000_000} | CENTRE | more


@query(f"""with g as ({PLANE.format(west=230, more="6371229.0 * cos(radians(60)) / tan(pi() / 4 - radians(60) / 2) as k, radians(249) as c")}),
f as (select *, k * tan(pi() / 4 - lat / 2) * sin(lon - c) as x, -k * tan(pi() / 4 - lat / 2) * cos(lon - c) as y from g), {STEPS}
select s_suppkey, cast(pt as bigint) as pt, {FLOAT.format("pi() / 2 - 2 * atan(sqrt(u * u + v * v) / k)")} as lat, {FLOAT.format("(c + atan2(u, -v) + pi()) % (2 * pi()) - pi()")} as lon from q""")
def polar_stereographic_grid(spark, sf_dir):
    k = F.col("s_suppkey")
    return grid_points(read(spark, sf_dir, "supplier"), "s_suppkey", 20, plane(60, 249), F.lit(6), lat=40 + k % 30, lon=230 + k % 40, km=50 + k % 50)


@query(f"""with g as ({PLANE.format(west=250, more="sin(radians(25)) as n, radians(265) as c, pi() / 4 as q")}),
h as (select *, 6371229.0 * cos(radians(25)) / (n * pow(tan(q - radians(25) / 2), n)) as k from g), i as (select *, k * pow(tan(q - radians(25) / 2), n) as base, k * pow(tan(q - lat / 2), n) as r from h),
f as (select *, r * sin(n * (lon - c)) as x, base - r * cos(n * (lon - c)) as y from i), {STEPS.replace("q as", "z as")}
select s_suppkey, cast(pt as bigint) as pt, {FLOAT.format("pi() / 2 - 2 * atan(pow(sqrt(u * u + (base - v) * (base - v)) / k, 1 / n))")} as lat, {FLOAT.format("(c + atan2(u, base - v) / n + pi()) % (2 * pi()) - pi()")} as lon from z""")
def lambert_grid(spark, sf_dir):
    k = F.col("s_suppkey")
    cone = {"latin1": 25_000_000, "latin2": 25_000_000, "south_pole_lat": -90_000_000, "south_pole_lon": 0}
    return grid_points(read(spark, sf_dir, "supplier"), "s_suppkey", 30, plane(25, 265, **cone), F.lit(6), lat=40 + k % 30, lon=250 + k % 40, km=50 + k % 50)


@query("""with g as (select s_suppkey, unnest(range(6)) as pt from supplier), p as (select s_suppkey, pt, radians(20 - s_suppkey % 30 - 5.0 * (pt // 3)) as b, radians(s_suppkey % 40 + 10.0 * (pt % 3)) as a, radians(36) as p, radians(245) + pi() as q from g)
select s_suppkey, cast(pt as bigint) as pt, round(degrees(asin(sin(p) * sin(b) + cos(p) * cos(b) * cos(a))), 1) + 0.0 as lat, round(degrees(q - atan2(cos(b) * sin(a), cos(p) * sin(b) - sin(p) * cos(b) * cos(a))), 1) + 0.0 as lon from p""")
def rotated_grid(spark, sf_dir):
    """In single precision, so that tenths of a degree are compared."""

    def make(lat, lon):
        g = encode.lat_lon_grid((3, 2), (float(lat), float(lon)), (float(lat - 5), float(lon + 20)))
        return {"earth": encode.SPHERE, "lat_lon": g, "rotation": {"south_pole_lat": -36_000_000, "south_pole_lon": 245_000_000, "rot_angle": 0.0}}

    k = F.col("s_suppkey")
    p = grid_points(read(spark, sf_dir, "supplier"), "s_suppkey", 1, make, F.lit(6), lat=20 - k % 30, lon=k % 40)
    return p.select("s_suppkey", "pt", (F.round("lat", 1) + 0.0).alias("lat"), (F.round("lon", 1) + 0.0).alias("lon"))


@query("""with recursive g(n) as (select distinct [2, 5, 32, 160][cast(s_suppkey % 4 as integer) + 1] from supplier), r as (select n, unnest(range(n)) as i from g),
s as (select n, i, 0 as step, (1 - 1 / (8.0::double * n * n) + 1 / (8.0::double * n * n * n)) * cos((4 * i + 3) * pi() / (4 * n + 2)) as x, 1 as k, 1.0::double as p0, 0.0::double as p1 from r
 union all
 select n, i, case when k = n then step + 1 else step end,
  case when k = n then x - (case when k = 1 then x else p1 end) * (1 - x * x) / (n * (p0 - x * (case when k = 1 then x else p1 end))) else x end,
  case when k = n then 1 else k + 1 end,
  case when k = n then 1.0 when k = 1 then x else p1 end,
  case when k = n then 0.0 else ((2 * (k + 1) - 1) * x * (case when k = 1 then x else p1 end) - k * p0) / (k + 1) end
 from s where step < 6)
select cast(n as bigint) as n, cast(i as bigint) as i, cast(cast(degrees(asin(x)) as float) as double) as lat from s where step = 6""")
def gaussian_latitudes(spark, sf_dir):
    """Latitudes of Gaussian grids of two columns, from their Section 3."""

    def make(n):
        grid = encode.lat_lon_grid((2, n), (90.0, 0.0), (-90.0, 180.0))["grid"]
        return {"earth": encode.SPHERE, "gaussian": {"grid": grid, "i_direction_inc": 0, "n": n, "scanning_mode": 0}}

    n = F.element_at(F.array(*map(F.lit, (2, 5, 32, 160))), (F.col("s_suppkey") % 4 + 1).cast("int"))
    p = grid_points(read(spark, sf_dir, "supplier").select(n.alias("n")).distinct(), "n", 40, make, 2 * F.col("n"), n=F.col("n"))
    return p.where("pt % 2 = 0").select("n", (F.col("pt") / 2).cast("long").alias("i"), "lat")



@query("""with a as (select unnest(range(16)) as j), b as (select unnest(range(25)) as i)
select cast(j * 25 + i as bigint) as pt, cast(60.0 - j * 2.5 as double) as lat, cast(case when 350.0 + i * 1.25 < 360 then 350.0 + i * 1.25 else 350.0 + i * 1.25 - 360 end as double) as lon from a, b""")
def regular_latlon(spark, sf_dir):
    """Rows times columns of a grid that crosses the zero meridian, by the library's own coordinates."""
    g = encode.lat_lon_grid((25, 16), (60.0, 350.0), (22.5, 380.0 - 360.0))
    g["scanning_mode"] = 0
    s3 = encode.section3(25 * 16, 0, {"earth": encode.SPHERE, "lat_lon": g})
    ship(spark)
    made = spark.createDataFrame([(bytearray(s3),)], "s3 binary").select(R.coordinates_udf(False, False)("s3").alias("c"))
    flat = made.select(F.posexplode_outer(F.arrays_zip(F.col("c.lat").alias("lat"), F.col("c.lon").alias("lon"))).alias("pt", "p"))
    return flat.select(big("pt"), F.round(real("p.lat"), 4).alias("lat"), F.round(real("p.lon"), 4).alias("lon"))


@query("""with s as (select s_suppkey, s_suppkey % 10 as shape, (6371 + s_suppkey % 7) * pow(10, s_suppkey % 3) as v, (6350 + s_suppkey % 5) * pow(10, s_suppkey % 2) as w from supplier)
select s_suppkey, cast(case shape when 0 then 6367470.0 when 1 then v when 2 then 6378160.0 when 3 then v * 1000 when 4 then 6378137.0 when 5 then 6378137.0 when 6 then 6371229.0 when 7 then v when 8 then 6371200.0 end as double) as major,
 cast(case shape when 0 then 6367470.0 when 1 then v when 2 then 6356775.0 when 3 then w * 1000 when 4 then 6356752.314 when 5 then 6356752.3142 when 6 then 6371229.0 when 7 then w when 8 then 6371200.0 end as double) as minor from s""")
def earth_radii(spark, sf_dir):
    def axes(shape, major, major_factor, minor, minor_factor):
        scaled = lambda f, v: {"scale_factor": f, "scaled_value": v}
        return grids.radii({"shape": shape, "spherical_earth_radius": scaled(major_factor, major), "major_axis": scaled(major_factor, major), "minor_axis": scaled(minor_factor, minor)})

    k = F.col("s_suppkey")
    made = applied(axes, "array<double>", pa.list_(pa.float64()), shape=k % 10, major=6371 + k % 7, major_factor=k % 3, minor=6350 + k % 5, minor_factor=k % 2)
    return read(spark, sf_dir, "supplier").select("s_suppkey", made.alias("x")).select("s_suppkey", F.col("x")[0].alias("major"), F.col("x")[1].alias("minor"))


@query("""with g as (select s_suppkey, s_suppkey % 2 as up, s_suppkey % 3 as turn, s_suppkey % 5 as more from supplier)
select s_suppkey, case when more = 4 then 'InvalidValue' when turn = 2 and up = 1 then null when turn <> 2 and up = 0 then null else 'InvalidValue' end as kind from g""")
def grid_checks(spark, sf_dir):
    """Latitudes that contradict the scanning mode, and numbers of points that aren't the grid's."""

    def kind(up, turn, more):
        first, last = (10.0, 30.0) if up else (30.0, 10.0)
        g = encode.lat_lon_grid((3, 2), (first, 0.0), (last, 20.0)) | {"scanning_mode": 0x40 if turn == 2 else 0}
        try:
            grids.lat_lons(encode.section3(7 if more == 4 else 6, 0, {"earth": encode.SPHERE, "lat_lon": g}))
        except GribError as e:
            return type(e).__name__
        return None

    k = F.col("s_suppkey")
    return read(spark, sf_dir, "supplier").select("s_suppkey", applied(kind, "string", pa.string(), up=k % 2, turn=k % 3, more=k % 5).alias("kind"))


# ---- Sections and submessages (A, F1, F7, F9, G3) ----

#: Three messages: one field; three fields that share a grid, of which one brings its own; two after a local section.
SECTIONS = (0, 1, 3, 4, 5, 6, 7, 8, 0, 1, 3, 4, 5, 6, 7, 4, 5, 6, 7, 3, 4, 5, 6, 7, 8, 0, 1, 2, 3, 4, 5, 6, 7, 2, 3, 4, 5, 6, 7, 8)
ROWS = ", ".join(f"({i}, {n})" for i, n in enumerate(SECTIONS))


def section_rows(spark: SparkSession) -> DataFrame:
    rows = spark.sql(f"select 'f' as path, * from values {ROWS} as t(pos, num)")
    return R.with_messages(rows).withColumns({"template_num": F.lit(None).cast("int"), "payload": F.lit(None).cast("binary"), "offset": F.col("pos").cast("bigint"), "size": F.lit(1).cast("bigint")})


@query(f"""with s(pos, num) as (values {ROWS}), a as (select *, sum(case when num = 0 then 1 else 0 end) over (order by pos) - 1 as msg from s),
b as (select *, max(case when num = 0 then pos end) over w as s0, max(case when num = 2 then pos end) over w as s2, max(case when num = 3 then pos end) over w as s3, max(case when num = 4 then pos end) over w as s4,
 max(case when num = 8 then pos end) over (partition by msg) as s8x, lead(num) over (partition by msg order by pos) as nx from a window w as (partition by msg order by pos rows between unbounded preceding and current row))
select cast(msg as bigint) as msg, cast(row_number() over (partition by msg order by pos) - 1 as bigint) as sub, cast(s0 as bigint) as s0, cast(s2 as bigint) as s2, cast(s3 as bigint) as s3, cast(s4 as bigint) as s4, cast(pos as bigint) as s7, cast(case when nx = 8 then s8x else 0 end as bigint) as s8 from b where num = 7""")
def carry_forward_sections(spark, sf_dir):
    t = R.submessages(section_rows(spark), payloads=False)
    return t.select(*[big(c).alias(c) for c in ("msg", "sub", "s0", "s2", "s3", "s4", "s7", "s8")])


@query("""with recursive s as (select o_orderkey // 100 as file, o_orderkey as k, cast(case when o_orderkey % 100 = 0 then 0 when (o_orderkey % 100) % 8 = 0 and (o_orderkey // 100) % 3 = 0 then 0 else (o_orderkey % 100) % 9 end as integer) as num from orders),
p as (select *, coalesce(lag(num) over (partition by file order by k), -1) as before, lead(num) over (partition by file order by k) as after from s),
a(before, num) as (values (-1, 0), (0, 1), (1, 2), (1, 3), (2, 3), (3, 4), (4, 5), (5, 6), (6, 7), (7, 8), (7, 2), (7, 3), (7, 4), (8, 0)),
e as (select p.file, p.k, case when p.before = 1 and p.num = 4 then 'NoGridDefinition' when a.num is null then 'InvalidSectionOrder' when p.after is null and p.num <> 8 then 'UnexpectedEndOfData' end as kind
 from p left join a on p.before = a.before and p.num = a.num)
select file as path, k as pos, kind from (select *, row_number() over (partition by file order by k) as r from e where kind is not null) where r = 1""")
def section_order_check(spark, sf_dir):
    k = F.col("o_orderkey")
    file, place = F.floor(k / 100).cast("bigint"), k % 100
    num = F.when(place == 0, 0).when((place % 8 == 0) & (file % 3 == 0), 0).otherwise(place % 9)
    return R.order_errors(read(spark, sf_dir, "orders").select(file.alias("path"), k.alias("pos"), num.cast("int").alias("num")))


@query("""select distinct cast(3 + l_linenumber % 3 as bigint) as num, cast(l_quantity as bigint) % 5 as template_num from lineitem order by 1, 2""")
def template_distinct(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem").select(big(3 + F.col("l_linenumber") % 3).alias("num"), (big("l_quantity") % 5).alias("template_num"))
    return R.templates(rows)


@query("""with t(code, text) as (values (0, 'Analysis'), (1, 'Initialization'), (2, 'Forecast'), (3, 'Bias corrected forecast'), (4, 'Ensemble forecast'), (5, 'Probability forecast'), (6, 'Forecast error'), (7, 'Analysis error'), (8, 'Observation'))
select s_suppkey, coalesce(text, concat('code ''', s_suppkey % 12, ''' is not implemented')) as process from supplier left join t on t.code = s_suppkey % 12""")
def code_lookup(spark, sf_dir):
    rows = read(spark, sf_dir, "supplier").select("s_suppkey", (F.col("s_suppkey") % 12).alias("code"))
    return codes.described(rows, codes.code_table(spark), "4.3", "code", "process").select("s_suppkey", "process")


@query("""with t(d, c, code, text) as (values (0, 0, 0, 'Temperature'), (0, 0, 1, 'Virtual temperature'), (0, 0, 2, 'Potential temperature'), (0, 0, 4, 'Maximum temperature'), (0, 0, 5, 'Minimum temperature'), (0, 0, 6, 'Dewpoint temperature'),
 (0, 3, 0, 'Pressure'), (0, 3, 1, 'Pressure reduced to MSL'), (0, 3, 3, 'ICAO Standard Atmosphere Reference Height'), (0, 3, 4, 'Geopotential'), (0, 3, 5, 'Geopotential height'))
select c_custkey, coalesce(text, concat('code ''', c_custkey % 7, ''' is not implemented')) as parameter from customer left join t on t.d = c_custkey % 2 and t.c = 3 * (c_custkey // 2 % 2) and t.code = c_custkey % 7""")
def parameter_lookup(spark, sf_dir):
    k = F.col("c_custkey")
    rows = read(spark, sf_dir, "customer").select("c_custkey", (k % 2).alias("d"), (3 * (F.floor(k / 2) % 2)).alias("c"), (k % 7).alias("n"))
    return codes.described(rows, codes.code_table(spark), "4.2", "n", "parameter", "d", "c").select("c_custkey", "parameter")


@query("""select s_suppkey, cast(unnest(case when s_suppkey % 3 = 0 then [s_suppkey] when s_suppkey % 3 = 1 then range(s_suppkey, s_suppkey + 4) else [] end) as bigint) as code from supplier""")
def code_ranges(spark, sf_dir):
    k = F.col("s_suppkey")
    text = F.when(k % 3 == 0, k.cast("string")).when(k % 3 == 1, F.concat(k.cast("string"), F.lit("-"), (k + 3).cast("string"))).otherwise("x-1")
    return read(spark, sf_dir, "supplier").select("s_suppkey", F.explode(codes.code_range(text)).alias("code")).select("s_suppkey", big("code"))


@query("""with n(name, parameter) as (values ('HGT', 773), ('PRES', 768), ('PRMSL', 769))
select c_custkey, name from customer left join n on n.parameter = 760 + c_custkey % 16""")
def parameter_names(spark, sf_dir):
    names = X.lookup(760 + F.col("c_custkey") % 16, {v: k for k, v in R.NCEP.items()})
    return read(spark, sf_dir, "customer").select("c_custkey", names.alias("name"))


# ---- Real messages from the tables: written, read back, listed, decoded (A to N end to end) ----

SIDE = 8


def embedding_messages(spark: SparkSession, sf_dir: str, ahead: int | None = None) -> DataFrame:
    """(path, content): a message of an 8 by 8 grid for each embedding, three decimal places kept."""
    ship(spark)
    grid = encode.section3(SIDE * SIDE, 0, {"earth": encode.SPHERE, "lat_lon": encode.lat_lon_grid((SIDE, SIDE), (70.0, 0.0), (0.0, 70.0))})
    e = read(spark, sf_dir, "embeddings").select("vec_id", "label", sinks.encode_field(F.col("embedding").cast("array<double>"), 3, ahead).alias("f"))
    product = sinks.product_section(F.col("label") % 4, F.lit(1), F.lit(1), F.col("vec_id") % 24, F.lit(100), F.lit(0), F.lit(100) * (F.col("vec_id") % 10))
    return e.select(F.col("vec_id").cast("string").alias("path"), sinks.message(0, F.lit(encode.section1(2020, 2, 28, 18)), F.lit(grid), product, "f.s5", "f.s6", "f.s7").alias("content"))


def embedded(spark: SparkSession, sf_dir: str, ahead: int | None = None) -> frames.Grib:
    return frames.from_column(embedding_messages(spark, sf_dir, ahead), "path", "content")


QUANTISED = """with v as (select vec_id, unnest(range(len(embedding))) as pt, unnest(embedding) as e from embeddings),
s as (select vec_id, pt, cast(e as double) * 1000 as s from v), r as (select vec_id, cast(min(s) as float) as r from s group by 1)
select s.vec_id as vec_id, cast(pt as bigint) as pt, round(cast((r + cast(greatest(round(s - cast(r as double)), 0) as float)) * cast(0.001 as float) as double), 5) + 0.0 as value from s join r using (vec_id)"""


def values_of(g: frames.Grib) -> DataFrame:
    return g.values().select(big("path").alias("vec_id"), F.posexplode_outer("values").alias("pt", "value")).select("vec_id", big("pt"), (F.round(real("value"), 5) + 0.0).alias("value"))


@query(QUANTISED)
def grib_roundtrip_simple(spark, sf_dir):
    return values_of(embedded(spark, sf_dir))


@query(QUANTISED)
def grib_roundtrip_complex(spark, sf_dir):
    return values_of(embedded(spark, sf_dir, 8))


@query("""with e as (select user_id, event_id, case when event_type = 'error' then null else value end as v from events),
r as (select user_id, cast(min(v * 100) as float) as r from e group by 1),
p as (select user_id, event_id, row_number() over (partition by user_id order by event_id) - 1 as pt, v from e)
select p.user_id as user_id, pt, case when v is not null then round(cast((r + cast(greatest(round(v * 100 - cast(r as double)), 0) as float)) * cast(0.01 as float) as double), 2) + 0.0 end as value from p join r using (user_id)""")
def grib_nan_roundtrip(spark, sf_dir):
    """Fields with missing values: a bitmap on the way out, NaN and so null on the way in."""
    ship(spark)
    e = read(spark, sf_dir, "events").withColumn("v", F.when(F.col("event_type") != "error", F.col("value")))
    f = sinks.gathered(e, ["user_id"], "event_id", "v").select("user_id", F.size("values").alias("n"), sinks.encode_field(F.col("values"), 2).alias("f"))
    back = f.select("user_id", R.values_udf()("n", "f.s5", "f.s6", "f.s7").alias("values"))
    x = real("value")
    return back.select("user_id", F.posexplode_outer("values").alias("pt", "value")).select("user_id", big("pt"), F.when(~F.isnan("value"), F.round(x, 2) + 0.0).alias("value"))


@query("""with q as (""" + QUANTISED + """) select vec_id, pt, cast(70 - 10.0 * (pt // 8) as double) as lat, cast(10.0 * (pt % 8) as double) as lon, value from q""")
def grib_points(spark, sf_dir):
    p = embedded(spark, sf_dir).points()
    return p.select(big("path").alias("vec_id"), "pt", F.round(real("lat"), 3).alias("lat"), (F.round(real("lon"), 3) + 0.0).alias("lon"), (F.round(real("value"), 5) + 0.0).alias("value"))


#: Bits of a code of each embedding's field, and with them the octets of Section 7 and of the message.
LENGTHS = """s as (select vec_id, label, unnest(embedding) as e from embeddings), m as (select vec_id, any_value(label) as label, cast(min(cast(e as double) * 1000) as float) as r, max(cast(e as double) * 1000) as t, min(cast(e as double) * 1000) as b from s group by 1),
w as (select *, cast(case when t = b or round(t - cast(r as double)) = 0 then 0 else length(bin(cast(round(t - cast(r as double)) as bigint))) end as bigint) as bits from m),
l as (select *, 5 + 8 * bits as s7, 16 + 21 + 72 + 34 + 21 + 6 + 5 + 8 * bits + 4 as total from w)"""


@query(f"""with {LENGTHS}
select vec_id, 0 as msg, 0 as sub, 0 as discipline, cast(total as bigint) as total_length, 255 as centre, 0 as subcentre, 29 as master_ver, 0 as local_ver, 1 as ref_significance, 2 as prod_status, 1 as data_type,
 0 as grid_source, 64 as num_points, 0 as num_coordinates, 0 as grid_tmpl, 0 as prod_tmpl, 0 as repr_tmpl, label % 4 as category, 1 as number, 2 as process, 1 as ft_unit, cast(vec_id % 24 as bigint) as ft_value, cast(vec_id % 24 as bigint) as ft_value_signed,
 100 as surf1_type, 0 as surf1_scale, cast(100 * (vec_id % 10) as bigint) as surf1_value, 255 as surf2_type, -127 as surf2_scale, -2147483647 as surf2_value, 64 as num_encoded, 0 as num_missing, 255 as bitmap_indicator,
 cast(256 * (label % 4) + 1 as bigint) as parameter, '2020-02-28 18:00:00 UTC' as ref_text, timestamp '2020-02-28 18:00:00' as ref_time, timestamp '2020-02-28 18:00:00' + to_hours(cast(vec_id % 24 as bigint)) as valid_time, 'regular_ll' as grid_name, cast(139 as bigint) as s7_offset_before, cast(s7 as bigint) as s7_size from l""")
def layer_list(spark, sf_dir):
    """All fields of all layers."""
    rows = embedded(spark, sf_dir).layers()
    ints = "msg sub discipline centre subcentre master_ver local_ver ref_significance prod_status data_type grid_source num_points num_coordinates grid_tmpl prod_tmpl repr_tmpl category number process ft_unit surf1_type surf1_scale surf2_type surf2_scale surf2_value num_encoded num_missing bitmap_indicator".split()
    longs = "total_length ft_value ft_value_signed surf1_value parameter s7_size".split()
    times = [F.col(c).cast("timestamp_ntz").alias(c) for c in ("ref_time", "valid_time")]
    return rows.select(big("path").alias("vec_id"), *[F.col(c).cast("int").alias(c) for c in ints], *[big(c).alias(c) for c in longs], *times, "ref_text", "grid_name", (big("s7_offset") - 36 + 5).alias("s7_offset_before"))


@query("""select vec_id from embeddings where vec_id % 24 = 6""")
def layer_find_by_forecast(spark, sf_dir):
    return R.at_forecast(embedded(spark, sf_dir).layers(), 1, 6).select(big("path").alias("vec_id"))


@query("""select vec_id, label % 4 as category from embeddings where label % 4 = 3""")
def layer_find_by_parameter(spark, sf_dir):
    return R.with_parameter(embedded(spark, sf_dir).layers(), 0x000301).select(big("path").alias("vec_id"), F.col("category").cast("int"))


@query("""with p as (select user_id, event_id, row_number() over (partition by user_id order by event_id) - 1 as sub from events)
select user_id, event_id, sub from p where sub = 1""")
def index_find(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy("event_id")
    p = read(spark, sf_dir, "events").select("user_id", "event_id", F.lit(0).alias("msg"), (F.row_number().over(w) - 1).cast("bigint").alias("sub"))
    return R.at_index(p, "0.1").select("user_id", "event_id", "sub")


@query(QUANTISED)
def flat_binary(spark, sf_dir):
    """Values as octets, read back from there."""

    @F.arrow_udf("array<float>")
    def back(octets: pa.Array) -> pa.Array:
        return pa.array([np.frombuffer(o, "<f4") for o in octets.to_pylist()], pa.list_(pa.float32()))

    v = embedded(spark, sf_dir).values().select(big("path").alias("vec_id"), F.posexplode(back(sinks.flat_binary(F.col("values"), "little"))).alias("pt", "value"))
    return v.select("vec_id", big("pt"), (F.round(real("value"), 5) + 0.0).alias("value"))


@query("""with v as (select vec_id, unnest(range(len(embedding))) as pt, unnest(embedding) as e from embeddings), s as (select vec_id, pt, cast(e as double) * 1000 as s from v), r as (select vec_id, cast(min(s) as float) as r from s group by 1),
q as (select s.vec_id as vec_id, pt, (r + cast(greatest(round(s - cast(r as double)), 0) as float)) * cast(0.001 as float) as x from s join r using (vec_id)),
t as (select *, cast(x as varchar) as c from q), d as (select *, replace(regexp_extract(c, '^-?([0-9.]+)e', 1), '.', '') as digits, try_cast(regexp_extract(c, 'e(-?[0-9]+)$', 1) as integer) as e from t),
f as (select *, case when e < 0 then concat(case when c[1] = '-' then '-' else '' end, '0.', repeat('0', -e - 1), digits) else regexp_replace(c, '[.]0$', '') end as value from d)
select vec_id, cast(pt as bigint) as pt, concat(lpad(printf('%.6f', 70 - 10.0 * (pt // 8)), 10, ' '), ' ', lpad(printf('%.6f', 10.0 * (pt % 8)), 11, ' '), ' ', case when length(value) < 9 then lpad(value, 9, ' ') else value end) as text from f""")
def text_export(spark, sf_dir):
    """Whole lines: latitude, longitude and value; one half way between two shortest texts in full, as SQL's engine writes it."""
    lines = reports.point_lines(embedded(spark, sf_dir).points(), ties="exact")
    return lines.select(big("path").alias("vec_id"), "pt", "text")


@query("""select cast(label as bigint) as label, count(*) as submessages, cast(count(*) as bigint) as points_64 from embeddings group by 1""")
def multi_product_messages(spark, sf_dir):
    """Messages of many submessages that share a grid: written by joining octets in order, read back and counted."""
    ship(spark)
    grid = encode.section3(SIDE * SIDE, 0, {"earth": encode.SPHERE, "lat_lon": encode.lat_lon_grid((SIDE, SIDE), (70.0, 0.0), (0.0, 70.0))})
    e = read(spark, sf_dir, "embeddings").select("vec_id", "label", sinks.encode_field(F.col("embedding").cast("array<double>"), 3).alias("f"))
    parts = e.select("label", "vec_id", F.concat(sinks.product_section(0, 1, 1, F.col("vec_id")), "f.s5", "f.s6", "f.s7").alias("octets"), F.lit(encode.section1(2020, 1, 1)).alias("s1"), F.lit(grid).alias("s3"), F.lit(0).alias("d"))
    m = sinks.multi_message(parts, ["label"], "vec_id", "octets", ["s1", "s3"], "d")
    subs = frames.from_column(m.select(F.col("label").cast("string").alias("path"), "message"), "path", "message").layers()
    return subs.groupBy(big("path").alias("label")).agg(F.count("*").alias("submessages"), F.count(F.when(F.col("num_points") == 64, 1)).alias("points_64"))


SECTION_ROWS = f"""{LENGTHS}, n as (select unnest([0, 1, 3, 4, 5, 6, 7, 8]) as num, unnest(range(8)) as pos, unnest([0, 16, 37, 109, 143, 164, 170, 170]) as place, unnest([16, 21, 72, 34, 21, 6, 0, 4]) as size),
t as (select vec_id, label, pos, num, cast(place + case when num = 8 then s7 else 0 end as bigint) as "offset", cast(case when num = 7 then s7 else size end as bigint) as size from l, n)"""


@query(f"""with {SECTION_ROWS} select vec_id, cast(pos as bigint) as pos, 0 as msg, num, "offset", size, case when num in (3, 4, 5) then 0 end as template_num from t""")
def section_scan(spark, sf_dir):
    s = embedded(spark, sf_dir).sections()
    return s.select(big("path").alias("vec_id"), big("pos").alias("pos"), "msg", F.col("num").cast("int"), "offset", "size", "template_num")


@query()
def dump_lines(spark, sf_dir):
    return embedded(spark, sf_dir).dump()


@query(f"""with {SECTION_ROWS} select vec_id, cast(pos as bigint) as pos, concat(lpad(cast(pos as varchar), 5, ' '), ' │ ', lpad(lower(to_hex("offset")), 16, '0'), ' - ', lpad(lower(to_hex("offset" + size)), 16, '0'), ' │ Section ', num) as text from t""")
def inspect_sections(spark, sf_dir):
    return embedded(spark, sf_dir).inspect()[0].select(big("path").alias("vec_id"), big("pos").alias("pos"), "text")


@query("""select vec_id, '     0.0 │     -     2     3     4     5     6 │ 3.0     4.0     5.0    ' as text from embeddings""")
def inspect_submessages(spark, sf_dir):
    return embedded(spark, sf_dir).inspect()[1].select(big("path").alias("vec_id"), "text")


@query("""select 3 as num, 0 as template_num, '3.0      - Latitude/longitude' as text union all select 4, 0, '4.0      - Analysis or forecast at a horizontal level or in a horizontal layer at a point in time' union all select 5, 0, '5.0      - Grid point data - simple packing'""")
def inspect_templates(spark, sf_dir):
    return embedded(spark, sf_dir).inspect()[2].select(F.col("num").cast("int"), "template_num", "text")


@query("""select vec_id, concat('     0.0 │ ', rpad(['Virtual temperature', 'Relative humidity', 'Wind speed', 'Pressure reduced to MSL'][label % 4 + 1], 31, ' '), ' ', rpad('Forecast', 18, ' '), ' ', lpad(concat(vec_id % 24, ' [h]'), 14, ' '), ' ',
 lpad(concat(100 * (vec_id % 10), ' [Pa]'), 33, ' '), ' ', lpad('NaN', 33, ' '), ' │ ', lpad('0', 10, ' '), '/', lpad('64', 10, ' '), ' ', rpad('regular_ll', 21, ' ')) as text from embeddings""")
def list_lines(spark, sf_dir):
    return embedded(spark, sf_dir).list().select(big("path").alias("vec_id"), "text")


INFO = (
    ("Discipline:", "Meteorological products"), ("Total Length:", "{}"), ("Originating/generating centre:", "code ''255'' is not implemented"), ("Originating/generating sub-centre:", "0"),
    ("GRIB Master Tables Version Number:", "29 (code ''29'' is not implemented)"), ("GRIB Local Tables Version Number:", "0 (Local tables not used. Only table entries and templates from the current master table are valid)"),
    ("Significance of Reference Time:", "Start of forecast"), ("Reference time of data:", "2020-02-28 18:00:00 UTC"), ("Production status of processed data:", "Research products"), ("Type of processed data:", "Forecast products"),
)
BLOCK = "Message 0\n\n" + "".join(f"    {name:<40}{value}\n" for name, value in INFO) + "\n"


@query(f"""with {LENGTHS} select vec_id, replace('{BLOCK}', '{{}}', cast(total as varchar)) as text from l""")
def info_blocks(spark, sf_dir):
    return embedded(spark, sf_dir).info().select(big("path").alias("vec_id"), "text")


@query(f"""with {LENGTHS} select vec_id, cast(21 as bigint) as len1, cast(2020 as bigint) as year, cast(18 as bigint) as hour, cast(64 as bigint) as num_points, cast(8 as bigint) as ni, cast(70000000 as bigint) as last_lon, cast(label % 4 as bigint) as category,
 cast(vec_id % 24 as bigint) as forecast, cast(100 * (vec_id % 10) as bigint) as surface, cast(-127 as bigint) as none, cast(r as double) as ref_val, cast(3 as bigint) as "dec", bits as num_bits, cast(255 as bigint) as bitmap from l""")
def typed_sections(spark, sf_dir):
    """Fields of Sections 1, 3, 4, 5 and 6 by their names."""
    subs = embedded(spark, sf_dir).submessages()
    typed = subs.select(big("path").alias("vec_id"), *[R.typed(F.col(f"p{k}"), k).alias(f"section{k}") for k in (1, 3, 4, 5, 6)])
    wanted = (
        ("len1", 1, "header.len"), ("year", 1, "payload.ref_time.year"), ("hour", 1, "payload.ref_time.hour"), ("num_points", 3, "payload.num_points"), ("ni", 3, "payload.template.lat_lon.grid.ni"),
        ("last_lon", 3, "payload.template.lat_lon.grid.last_point_lon"), ("category", 4, "payload.template.param.category"), ("forecast", 4, "payload.template.forecast_time.time.len"),
        ("surface", 4, "payload.template.horizontal.first_surface.value.scaled_value"), ("none", 4, "payload.template.horizontal.second_surface.value.scale_factor"), ("ref_val", 5, "payload.template.simple.ref_val"),
        ("dec", 5, "payload.template.simple.dec"), ("num_bits", 5, "payload.template.simple.num_bits"), ("bitmap", 6, "payload.bitmap_indicator"),
    )
    return typed.select("vec_id", *[F.get_json_object(f"section{k}", f"$.{path}").cast("double" if name == "ref_val" else "bigint").alias(name) for name, k, path in wanted])


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Layers of one forecast time, with coordinates and values."""
    p = embedded(spark, sf_dir).points(where="ft_unit = 1 and ft_value = 6")
    return p.select("path", "msg", "sub", "pt", "lat", "lon", "value")
