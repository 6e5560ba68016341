"""Files to relations and back: scanning, order, layers, values, reports, sinks, streaming, command line."""

import gzip
import io
import lzma

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom import cli, codes, frames, wire
from gridloom.errors import ParseError
from gridloom.functions import octets as X
from gridloom.operators import encode as E
from gridloom.operators import relations as R
from gridloom.plans import reports
from gridloom.sources import grib, sinks
from gridloom.sources.scan import scan
from gridloom.streaming import ingest

V = np.arange(12) * 1.5
GAPS = np.where(np.arange(12) == 3, np.nan, V)
GRID = E.section3(12, 0, {"earth": E.SPHERE, "lat_lon": E.lat_lon_grid((4, 3), (10.0, -5.0), (20.0, 10.0))})
IDENT = E.section1(2016, 8, 22, 2)
ISOBARIC = {"surface_type": 100, "value": {"scale_factor": -2, "scaled_value": 850}}
ONE = E.single_message(0, IDENT, None, GRID, E.section4(0, 0, 0, 30), E.encode_field(V, 1))
TWO = E.multi_product_message(0, IDENT, b"\0\0\0\7\2ab", GRID, [(E.section4(0, 0, 0, 30), E.encode_field(V, 1)), (E.section4(3, 1, 1, 6, ISOBARIC), E.encode_field(GAPS, 1, 4))])
NOWCAST_POINTS = 256 * 336


def nowcast() -> bytes:
    """A message with the sections of a published run-length nowcast and a made-up Section 7."""
    none = {"scale_factor": 255, "scaled_value": 4294967295}
    earth = {"shape": 4, "spherical_earth_radius": none, "major_axis": {"scale_factor": 1, "scaled_value": 63781370}, "minor_axis": {"scale_factor": 1, "scaled_value": 63567523}}
    g = {"ni": 256, "nj": 336, "initial_production_domain_basic_angle": 0, "basic_angle_subdivisions": 4294967295, "first_point_lat": 47958333, "first_point_lon": 118062500, "resolution_and_component_flags": 0x30, "last_point_lat": 20041667, "last_point_lon": 149937500}
    s3 = E.section3(NOWCAST_POINTS, 0, {"earth": earth, "lat_lon": {"grid": g, "i_direction_inc": 125000, "j_direction_inc": 83333, "scanning_mode": 0}})
    ident = E.section1(2016, 8, 22, 2, centre_id=34, master_table_version=5, local_table_version=1, ref_time_significance=0, prod_status=0, data_type=2)
    ground = {"surface_type": 1, "value": {"scale_factor": -127, "scaled_value": -2147483647}}
    s4 = bytearray(E.section4(193, 0, 0, 0, ground, process_type=0))
    s4[12], s4[13] = 153, 255
    s5 = E.section5(NOWCAST_POINTS, 200, {"num_bits": 8, "max_val": 3, "max_level": 3, "dec": 0, "level_vals": [1, 2, 3]})
    rest, digits = NOWCAST_POINTS - 4, []
    while rest:
        digits.append(4 + rest % 252)
        rest //= 252
    return E.message(0, [ident, s3, bytes(s4), s5, E.section(6, b"\xff"), E.section(7, bytes([1, 2, 3, 0, *digits]))])


def sections_of(data, payload="meta"):
    return list(scan(io.BytesIO(data), len(data), payload))


def test_scan_skips_what_is_between_messages():
    got = sections_of(b"junkGRI" + ONE + b"xx" + ONE + b"trailing GRIB")
    assert [s.num for s in got] == [0, 1, 3, 4, 5, 6, 7, 8] * 2
    assert [s.offset for s in got if s.num == 0] == [7, 9 + len(ONE)]
    assert [s.msg for s in got][::8] == [0, 1]
    assert {s.num: s.template_num for s in got if s.template_num is not None} == {3: 0, 4: 0, 5: 0}
    assert sum(s.size for s in got) == 2 * len(ONE)


def test_scan_payloads():
    for kind, has7, has6 in (("none", False, 0), ("meta", False, 6), ("all", True, 6 + 2)):
        got = {s.num: s.payload for s in sections_of(E.single_message(0, IDENT, None, GRID, E.section4(0, 0, 0, 1), E.encode_field(GAPS, 1)), kind)}
        assert (got[7] is not None) == has7
        assert len(got[6] or b"") == has6


@pytest.mark.parametrize(("data", "kind"), [(ONE[:7] + b"\1" + ONE[8:], "GRIBVersionMismatch"), (ONE[:-4] + b"7776", "EndSectionMismatch"), (ONE[:20] + b"\x09" + ONE[21:], "UnknownSectionNumber"), (ONE[:60], "ReadError")])
def test_scan_errors(spark, data, kind):
    with pytest.raises(ParseError) as e:
        sections_of(data)
    assert e.value.kind == kind
    rows = frames.from_bytes(spark, ONE + data, mode="PERMISSIVE").sections().collect()
    assert [r.num for r in rows[:8]] == [0, 1, 3, 4, 5, 6, 7, 8]
    assert rows[-1].error.startswith(kind)


@pytest.mark.parametrize("data", [b"", b"foo", b"\0" * 5000, b"GRIB"])
def test_nothing_to_read(spark, data):
    assert frames.from_bytes(spark, data).count() == 0


ORDERS = [
    ([0, 1, 2, 3, 4, 5, 6, 7, 8], [(0, 0, 0, 1, 2, 3, 4, 5, 6, 7, 8)], None),
    ([0, 1, 3, 4, 5, 6, 7, 8] * 2, [(0, 0, 0, 1, None, 2, 3, 4, 5, 6, 7), (1, 0, 8, 9, None, 10, 11, 12, 13, 14, 15)], None),
    ([0, 1, 2, 3, 4, 5, 6, 7, 2, 3, 4, 5, 6, 7, 8], [(0, 0, 0, 1, 2, 3, 4, 5, 6, 7, 0), (0, 1, 0, 1, 8, 9, 10, 11, 12, 13, 14)], None),
    ([0, 1, 3, 4, 5, 6, 7, 2, 3, 4, 5, 6, 7, 8], [(0, 0, 0, 1, None, 2, 3, 4, 5, 6, 0), (0, 1, 0, 1, 7, 8, 9, 10, 11, 12, 13)], None),
    ([0, 1, 2, 3, 4, 5, 6, 7, 3, 4, 5, 6, 7, 8], [(0, 0, 0, 1, 2, 3, 4, 5, 6, 7, 0), (0, 1, 0, 1, 2, 8, 9, 10, 11, 12, 13)], None),
    ([0, 1, 2, 3, 4, 5, 6, 7, 4, 5, 6, 7, 8], [(0, 0, 0, 1, 2, 3, 4, 5, 6, 7, 0), (0, 1, 0, 1, 2, 3, 8, 9, 10, 11, 12)], None),
    ([0, 1, 4, 5, 6, 7, 8], None, (2, "NoGridDefinition")),
    ([0, 1, 2, 4, 5, 6, 7, 8], None, (3, "InvalidSectionOrder")),
    ([1, 2], None, (0, "InvalidSectionOrder")),
    ([0, 1, 3, 4, 5, 6, 7], None, (6, "UnexpectedEndOfData")),
    ([0, 1, 3, 4, 5, 6, 7, 5, 8], None, (7, "InvalidSectionOrder")),
    ([0, 1, 3, 4, 5, 6, 7, 8, 1], None, (8, "InvalidSectionOrder")),
    ([], [], None),
]


def test_orders_and_assembly(spark):
    rows = [(f"{i:02d}", p, n) for i, (nums, _, _) in enumerate(ORDERS) for p, n in enumerate(nums)]
    s = R.with_messages(spark.createDataFrame(rows, "path string, pos int, num int"))
    s = s.withColumns({"template_num": F.lit(None).cast("int"), "payload": F.lit(None).cast("binary"), "offset": F.lit(0), "size": F.lit(0)})
    wrong = {r.path: (r.pos, r.kind) for r in R.order_errors(s).collect()}
    assert wrong == {f"{i:02d}": e for i, (_, _, e) in enumerate(ORDERS) if e}
    got = {}
    for r in R.submessages(s, payloads=False).orderBy(*R.KEYS).collect():
        got.setdefault(r.path, []).append((r.msg, r["sub"], *[r[f"s{k}"] for k in range(9)]))
    for i, (_, subs, _) in enumerate(ORDERS):
        if subs is not None:
            assert got.get(f"{i:02d}", []) == subs


def test_layers(spark):
    rows = frames.from_bytes(spark, TWO).layers().orderBy("sub").collect()
    a, b = rows
    assert (a.category, a.number, a.ft_unit, a.ft_value, a.process, a.num_points, a.num_encoded, a.grid_name) == (0, 0, 0, 30, 2, 12, 12, "regular_ll")
    assert (b.surf1_type, b.surf1_scale, b.surf1_value, b.surf2_type, b.surf2_value, b.num_missing) == (100, -2, 850, 255, -2147483647, 1)
    assert b.parameter == R.NCEP["PRMSL"]
    assert str(a.valid_time) == "2016-08-22 02:30:00"
    assert str(b.valid_time) == "2016-08-22 08:00:00"
    assert bytes(a.local_use) == b"ab"
    g = frames.from_bytes(spark, TWO).layers()
    assert R.at_forecast(g, 1, 6).count() == 1
    assert R.with_parameter(g, *R.NCEP.values()).count() == 1
    assert R.at_index(g, "0.1").count() == 1
    with pytest.raises(ValueError, match="not an index"):
        R.parse_index("0.x")


def test_layers_run_without_python(spark):
    s = spark.createDataFrame([], grib.SCHEMA)
    plan = R.layers(R.submessages(s))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan
    assert "Arrow" not in plan


def test_negative_forecast_times_and_unknown_templates(spark):
    s4 = E.section4(0, 0, 1, -3)
    odd = s4[:7] + b"\x03\xe8" + s4[9:]
    unknown = s4[:7] + b"\x00\x63" + s4[9:]
    data = b"".join(E.single_message(0, IDENT, None, GRID, s, E.encode_field(V, 1)) for s in (s4, odd, unknown))
    a, b, c = frames.from_bytes(spark, data).layers().drop("valid_time").orderBy("msg").collect()
    assert (a.ft_value, a.ft_value_signed) == (2147483651, -3)
    assert (b.prod_tmpl, b.ft_unit, b.surf1_type) == (1000, 1, None)
    assert (c.category, c.ft_unit, c.process) == (None, None, None)


def test_values_and_points(spark):
    g = frames.from_bytes(spark, TWO + ONE)
    got = {(r.msg, r["sub"]): np.array(r["values"], float) for r in g.values().collect()}
    assert np.allclose(got[0, 0], V)
    assert np.array_equal(got[0, 1], GAPS, equal_nan=True)
    p = g.points("0.1").orderBy("pt").toPandas()
    assert np.allclose(p.lat, np.repeat([10, 15, 20], 4))
    assert np.allclose(p.lon, np.tile([-5, 0, 5, 10], 3), atol=1e-5)
    assert np.array_equal(p.value, GAPS, equal_nan=True)
    assert g.points(where="ft_value = 30").select("msg", "sub").distinct().count() == 2


def test_filter_on_keys_goes_below_decoding(spark):
    plan = frames.from_bytes(spark, TWO).points().where("sub = 1")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1  # the plan reads from the last step to the first
    assert "Generate" not in plan[plan.index("ArrowEvalPython") :]
    assert "Filter (" in plan[plan.index("ArrowEvalPython") :]
    assert "= 1)" in plan[plan.index("ArrowEvalPython") :]
    assert "Filter (" not in plan[: plan.index("ArrowEvalPython")]


def test_unsupported_grids_keep_values(spark):
    s3 = E.section3(12, 101, {"earth_shape": 6, "grid_num": 26, "ref_grid_num": 1, "uuid": bytes(16)})
    data = E.single_message(0, IDENT, None, s3, E.section4(1, 52, 0, 0), E.encode_field(np.zeros(12), 0))
    g = frames.from_bytes(spark, data)
    p = g.points().toPandas()
    assert p.lat.isna().all()
    assert (p.value == 0).all()
    assert g.layers().first().grid_name == "unknown (template 101)"


def test_own_decoders_and_grids(spark):
    s3 = E.section3(12, 101, {"earth_shape": 6, "grid_num": 26, "ref_grid_num": 1, "uuid": bytes(16)})
    s5 = E.section5(12, 4, {"precision": 1})
    data = E.message(0, [IDENT, s3, E.section4(0, 0, 0, 0), s5, E.section(6, b"\xff"), E.section(7, V.astype(">f4").tobytes())])
    files = spark.createDataFrame([("x", bytearray(data))], "path string, content binary")
    g = frames.Grib(files, decoders={4: lambda t, d, n: np.frombuffer(d, ">f4", n).astype("f4")}, grids={101: lambda s: (np.arange(12, dtype="f4"), np.arange(12, dtype="f4"))})
    p = g.points().orderBy("pt").toPandas()
    assert p.value.tolist() == V.tolist()
    assert p.lat.tolist() == list(range(12))
    with pytest.raises(Exception, match="5.0"):
        frames.Grib(files).values().collect()


def test_permissive_decoding(spark):
    bad = bytearray(ONE)
    at = ONE.index(E.encode_field(V, 1)[1])
    bad[at + 5] = 254
    g = frames.from_bytes(spark, bytes(bad), mode="PERMISSIVE")
    assert g.values().first()["values"] is None
    with pytest.raises(Exception, match="bit map indicator"):
        frames.from_bytes(spark, bytes(bad)).values().collect()


def test_golden_dump(spark):
    lines = [r.text for r in frames.from_bytes(spark, nowcast()).dump().orderBy("line").collect()]
    assert lines[1] == "##  SECTION 0: INDICATOR SECTION (length = 16)"
    assert "1-4       header.len = 72  // Length of section in octets (nn)." in lines
    assert "13-14     payload.ref_time.year = 2016  // Year (4 digits) - Reference time of data." in lines
    assert "31-34     payload.template.lat_lon.grid.ni = 256  // Ni - number of points along a parallel." in lines
    assert "55        payload.template.lat_lon.grid.resolution_and_component_flags = 0b00110000  // Resolution and component flags (see Flag table 3.3)." in lines
    assert "24        payload.template.horizontal.first_surface.value.scale_factor = -127  // Scale factor of first fixed surface." in lines
    assert "18-23     payload.template.level_vals = [1, 2, 3]  // List of MVL scaled representative values of each level from lv=1 to MVL." in lines
    assert lines[-1] == "##  SECTION 8: END SECTION (length = 4)"
    assert [line for line in lines if line.startswith("##  SECTION 5")] == ["##  SECTION 5: DATA REPRESENTATION SECTION (length = 23)"]


def test_golden_info_list_describe(spark):
    g = frames.from_bytes(spark, nowcast())
    info = g.info().first().text
    assert "    Originating/generating centre:          Tokyo (RSMC), Japan Meteorological Agency\n" in info
    assert "    GRIB Master Tables Version Number:      5 (4 November 2009)\n" in info
    assert "    GRIB Local Tables Version Number:       1 (Number of local tables version used)\n" in info
    assert "    Reference time of data:                 2016-08-22 02:00:00 UTC\n" in info
    text = g.describe().first().text
    assert text == (
        "0.0\n"
        "Grid:                                   Latitude/longitude\n"
        "  Number of points:                     86016\n"
        "Product:                                Analysis or forecast at a horizontal level or in a horizontal layer at a point in time\n"
        "  Parameter Category:                   code '193' is not implemented\n"
        "  Parameter:                            code '0' is not implemented\n"
        "  Generating Proceess:                  Analysis\n"
        "  Forecast Time:                        0\n"
        "  Forecast Time Unit:                   Minute\n"
        "  1st Fixed Surface Type:               Ground or water surface\n"
        "  1st Scale Factor:                     Missing\n"
        "  1st Scaled Value:                     Missing\n"
        "  2nd Fixed Surface Type:               code '255' is not implemented\n"
        "  2nd Scale Factor:                     Missing\n"
        "  2nd Scaled Value:                     Missing\n"
        "Data Representation:                    Run length packing with level values\n"
        "  Number of represented values:         86016\n"
    )
    v = np.array(g.values().first()["values"])
    assert v[:3].tolist() == [1, 2, 3]
    assert np.isnan(v[3:]).all()
    assert len(v) == NOWCAST_POINTS
    listed = frames.from_bytes(spark, TWO).list().orderBy("sub").collect()
    assert listed[1].text.rstrip() == "     0.1 │ Pressure reduced to MSL         Forecast                    6 [h]                        85000 [Pa]                               NaN │          1/        12 regular_ll"


def run_cli(spark, *args):
    out = io.StringIO()
    cli.run(list(args), spark, out)
    return out.getvalue()


def test_command_line(spark, tmp_path):
    path = tmp_path / "a.grib2"
    path.write_bytes(TWO + ONE)
    text = run_cli(spark, "inspect", str(path))
    assert text.startswith("Sections:\n    0 │ 0000000000000000 - 0000000000000010 │ Section 0\n")
    assert "SubMessages:\n      id │    S2    S3    S4    S5    S6    S7 │ Tmpl3   Tmpl4   Tmpl5\n     0.0 │     2     3     4     5     6     7 │ 3.0     4.0     5.0    \n" in text
    assert "     1.0 │     -    15    16    17    18    19 │ 3.0     4.0     5.0    \n" in text
    assert text.endswith("Templates:\n3.0      - Latitude/longitude\n4.0      - Analysis or forecast at a horizontal level or in a horizontal layer at a point in time\n5.0      - Grid point data - simple packing\n5.2      - Grid point data - complex packing\n")
    assert run_cli(spark, "inspect", "-t", str(path)).startswith("3.0 ")
    assert run_cli(spark, "info", str(path)).count("Message ") == 2
    assert run_cli(spark, "list", str(path)).splitlines()[0] == reports.LIST_HEADER
    assert run_cli(spark, "dump", "--no-color", str(path), "1.0").startswith("#  SUBMESSAGE (total_length = ")
    assert "\x1b[1m" in run_cli(spark, "dump", str(path), "1.0")
    decoded = run_cli(spark, "decode", str(path), "0.1").splitlines()
    assert decoded[0] == "  Latitude   Longitude     Value"
    assert decoded[1] == " 10.000000  355.000000         0"
    assert decoded[4] == " 10.000000   10.000000       NaN"
    for flag, kind in (("-b", ">f4"), ("-l", "<f4")):
        run_cli(spark, "decode", flag, str(tmp_path / "out"), str(path), "0.1")
        raw = (tmp_path / "out").read_bytes()
        assert np.array_equal(np.frombuffer(raw, kind), GAPS.astype("f4"), equal_nan=True)
        assert raw[12:16] == (b"\x7f\xc0\0\0" if flag == "-b" else b"\0\0\xc0\x7f")
    with pytest.raises(SystemExit, match="no such index: 0.7"):
        run_cli(spark, "decode", str(path), "0.7")
    (tmp_path / "empty").write_bytes(b"")
    with pytest.raises(SystemExit, match="empty GRIB2 data"):
        run_cli(spark, "info", str(tmp_path / "empty"))


def test_sources(spark, tmp_path):
    (tmp_path / "a.grib2").write_bytes(ONE)
    (tmp_path / "b.grib2.gz").write_bytes(gzip.compress(TWO))
    (tmp_path / "c.grib2.xz").write_bytes(lzma.compress(ONE))
    assert frames.read(spark, str(tmp_path)).count() == 4
    grib.register(spark)
    t = spark.read.format("grib2").option("payload", "none").load(str(tmp_path))
    assert t.groupBy("path").count().count() == 3
    assert t.where("payload is not null").count() == 0
    whole = spark.read.format("grib2").option("payload", "all").load(str(tmp_path / "a.grib2"))
    assert R.fields(R.submessages(whole)).first()["values"] == [float(x) for x in V]
    files = spark.read.format("binaryFile").load(str(tmp_path / "a.grib2"))
    again = grib.with_payload(grib.scan_binary(files, "none").where("num = 4"), files).first()
    assert bytes(again.payload) == E.section4(0, 0, 0, 30)
    assert grib.scan_binary(files.limit(0)).count() == 0


def test_files_in_runs_of_messages(spark, tmp_path):
    (tmp_path / "a.grib2").write_bytes(b"x" * 70000 + ONE + b"junk" + TWO + ONE + TWO)
    grib.register(spark)
    whole = spark.read.format("grib2").load(str(tmp_path / "a.grib2"))
    runs = spark.read.format("grib2").option("split", len(TWO) + 10).load(str(tmp_path / "a.grib2"))
    assert runs.rdd.getNumPartitions() == 4
    assert sorted(map(tuple, grib.numbered(runs).collect())) == sorted(map(tuple, whole.collect()))


def test_typed_sections(spark):
    import json

    subs = frames.from_bytes(spark, TWO).submessages()
    r = subs.select(*[R.typed(F.col(f"p{k}"), k).alias(f"t{k}") for k in (1, 3, 4, 5, 6)]).first()
    assert json.loads(r.t1)["payload"]["ref_time"]["year"] == 2016
    assert json.loads(r.t3)["payload"]["template"]["lat_lon"]["grid"]["ni"] == 4
    assert json.loads(r.t6)["payload"]["bitmap_indicator"] == 255


def test_messages_written_by_spark(spark, tmp_path):
    points = spark.createDataFrame([(f, p, float(v)) for f in (1, 2) for p, v in enumerate(V * f)], "f int, pt int, v double").orderBy(F.rand(1))
    fields = sinks.gathered(points, ["f"], "pt", "v").withColumn("s", sinks.encode_field(F.col("values"), 1, 4))
    section4 = sinks.product_section(3, 1, 1, F.col("f") * 6, 100, -2, 850)
    assert bytes(fields.where("f = 1").select(section4).first()[0]) == E.section4(3, 1, 1, 6, ISOBARIC)
    single = fields.select("f", sinks.message(0, F.lit(IDENT), F.lit(None).cast("binary"), F.lit(GRID), section4, "s.s5", "s.s6", "s.s7").alias("m"))
    assert bytes(single.where("f = 1").first().m) == E.single_message(0, IDENT, None, GRID, E.section4(3, 1, 1, 6, ISOBARIC), E.encode_field(V, 1, 4))
    parts = fields.select("f", F.lit("k").alias("k"), F.concat(section4, "s.s5", "s.s6", "s.s7").alias("o"), F.lit(IDENT).alias("a"), F.lit(GRID).alias("b"), F.lit(0).alias("d"))
    multi = sinks.multi_message(parts, ["k"], "f", "o", ["a", "b"], "d")
    want = E.multi_product_message(0, IDENT, None, GRID, [(E.section4(3, 1, 1, 6 * f, ISOBARIC), E.encode_field(V * f, 1, 4)) for f in (1, 2)])
    assert bytes(multi.first().message) == want
    done = sinks.write_binary(multi.withColumn("name", F.lit("m.grib2")), "name", "message", str(tmp_path / "out")).collect()
    assert [(r.file.rpartition("/")[2], r.size) for r in done] == [("m.grib2", len(want))]
    assert frames.read(spark, str(tmp_path / "out/m.grib2")).count() == 2


def test_multi_grid_message():
    data = E.multi_grid_message(0, IDENT, None, [(GRID, E.section4(0, 0, 0, 1), E.encode_field(V, 1))] * 2)
    assert [s.num for s in sections_of(data)] == [0, 1, 3, 4, 5, 6, 7, 3, 4, 5, 6, 7, 8]
    assert wire.parse(wire.INDICATOR, data)[0]["total_len"] == len(data)


def test_code_tables(spark, tmp_path):
    head = "Title_en,SubTitle_en,CodeFlag,Value,MeaningParameterDescription_en,Note_en,UnitComments_en,Status\n"
    sub = '"Product discipline 0 - Meteorological products, parameter category 0: temperature"'
    (tmp_path / "t.csv").write_text(head + f"Baz,{sub},0,,Temperature,,K,Operational\nBaz,{sub},1-9,,Reserved,,,Operational\nBaz,{sub},10,,Latent heat net flux,,W m-2,Operational\nBaz,{sub},255,,Missing,,,Operational\n")
    rows = codes.read_code_table(spark, str(tmp_path / "t.csv"), "4.2").orderBy("code").collect()
    assert [tuple(r) for r in rows] == [("4.2", 0, 0, 0, "Temperature"), ("4.2", 0, 0, 10, "Latent heat net flux")]
    assert codes.read_code_table(spark, str(tmp_path / "t.csv"), "4.2", strict=True).count() == 2
    (tmp_path / "s.csv").write_text(head + "Foo,,0,,A,,,Operational\nFoo,,5-6,,B,,,Operational\n")
    assert codes.read_code_table(spark, str(tmp_path / "s.csv"), "0.0").count() == 3
    assert codes.read_code_table(spark, str(tmp_path / "s.csv"), "0.0", strict=True).count() == 0
    (tmp_path / "c11.csv").write_text("CREX2,GRIB2_BUFR4,OriginatingGeneratingCentre_en,Status\n00000,0,A,Operational\n,,Comment,Operational\n00001,1,B,Operational\n00002,2,),Operational\n")
    assert [(r.code, r.description) for r in codes.read_common_table(spark, str(tmp_path / "c11.csv"), "C11").orderBy("code").collect()] == [(0, "A"), (1, "B")]
    (tmp_path / "c00.csv").write_text("GRIB version number,BUFR version number,CREX version number,Effective date,Status\n0,0,0,Experimental,Operational\n,1,,1 January 1998,Operational\n1,3,2,1 January 2000,Operational\n")
    assert [r.code for r in codes.read_common_table(spark, str(tmp_path / "c00.csv"), "C00").orderBy("code").collect()] == [0, 1]


def test_parameter_codes(spark, tmp_path):
    (tmp_path / "t").write_text("0:1:0:255:0:0:0:0:TMP:Temperature:K\n0:1:0:255:0:0:3:16:U-GWD:Stress:N/m^2\n0:0:0:255:0:0:6:25:260120:Extent:%\n0:0:0:255:7:1:3:194:U-GWD:Stress:N/m^2\n")
    rows = {(r.name, r.parameter): r.first_parameter for r in codes.load_parameter_codes(spark, str(tmp_path / "t")).collect()}
    assert rows == {("_TMP", 0): 0, ("_U_GWD", 0x310): 0x310, ("_260120", 0x619): 0x619, ("_U_GWD", 0x3C2): 0x310}


def test_time_expressions(spark):
    df = spark.createDataFrame([(2021, 2, 29, 0, 0, 0), (2020, 2, 29, 12, 5, 7), (2020, 1, 1, 24, 0, 0)], "a int, b int, c int, d int, e int, f int")
    cols = [F.col(c) for c in "abcdef"]
    got = df.select(X.timestamp_of(cols).cast("string").alias("t"), X.date_text(cols).alias("s")).collect()
    assert [r.t for r in got] == [None, "2020-02-29 12:05:07", None]
    assert got[1].s == "2020-02-29 12:05:07 UTC"
    t = spark.sql("select timestamp '2020-01-31 00:00:00' as t")
    assert t.select(X.target_time(F.col("t"), F.lit(2), F.lit(4294967295))).first()[0] is None
    units = {13: "2020-01-31 00:00:02", 0: "2020-01-31 00:02:00", 12: "2020-02-01 00:00:00", 2: "2020-02-02 00:00:00", 3: None, 255: None}
    for unit, want in units.items():
        assert t.select(X.target_time(F.col("t"), F.lit(unit), F.lit(2)).cast("string")).first()[0] == want


def test_streaming(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.grib2").write_bytes(TWO)
    (folder / "bad.grib2").write_bytes(ONE[:60])
    got = []
    for _ in range(2):
        q = ingest.ingest_layers(spark, str(folder), lambda rows, n: got.extend(rows.select("path", "sub").collect()), str(tmp_path / "check"))
        q.awaitTermination()
        (folder / "b.grib2").write_bytes(ONE)
    assert sorted((r.path.rpartition("/")[2], r["sub"]) for r in got) == [("a.grib2", 0), ("a.grib2", 1), ("b.grib2", 0)]


def two_files(folder):
    """Files with messages of several submessages, a local section, a bitmap and octets between messages."""
    grid = E.section3(6, 0, {"earth": E.SPHERE, "lat_lon": E.lat_lon_grid((3, 2), (10.0, 0.0), (5.0, 20.0))})
    field = lambda k: E.encode_field(np.array([1.0, np.nan, k, 4.5, 5.0, 6.0]), 1)
    product = lambda k: E.section4(0, k, 1, k)
    head, local = E.section1(2020, 1, 1), E.section(2, b"local")
    one = E.single_message(0, head, local, grid, product(1), field(2.0))
    many = E.multi_product_message(0, head, None, grid, [(product(k), field(float(k))) for k in range(3)])
    both = E.multi_grid_message(0, head, local, [(grid, product(k), field(float(k))) for k in range(2)])
    folder.mkdir()
    (folder / "a b.grib2").write_bytes(one + b"between" + many)
    (folder / "c.grib2").write_bytes(both + one)
    (folder / "d.grib2.gz").write_bytes(gzip.compress(many))


def test_seeking_reads_what_whole_files_give(spark, tmp_path):
    two_files(tmp_path / "in")
    seek, whole = frames.read(spark, str(tmp_path / "in" / "*")), frames.read_whole(spark, str(tmp_path / "in"))
    subs = whole.submessages("all").drop("s6_offset", "s6_size")
    windows = R.submessages(whole.sections("all"))
    assert sorted(map(tuple, subs.select(*windows.columns).collect())) == sorted(map(tuple, windows.collect()))
    assert seek.count() == whole.count() == 10
    for f in (lambda g: g.layers().drop("s6_offset"), lambda g: g.values("0.0"), lambda g: g.points(where="number = 1"), lambda g: g.list(), lambda g: g.dump()):
        assert sorted(map(str, f(seek).collect())) == sorted(map(str, f(whole).collect()))
    assert seek.points(where="number = 1").count() == 6 * 5


def test_reading_shuffles_nothing_and_leaves_data_behind(spark, tmp_path):
    two_files(tmp_path / "in")
    g = frames.read(spark, str(tmp_path / "in"))
    plan = g.points(where="ft_value = 1")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    assert "content" not in plan
    meta = g.submessages().select("p6", "p7").collect()
    assert all(len(r.p6) == 6 and r.p7 is None for r in meta)


def test_patterns_of_the_data_source(spark, tmp_path):
    two_files(tmp_path / "in")
    grib.register(spark)
    load = lambda p: spark.read.format("grib2").option("payload", "none").load(str(tmp_path / p)).where("num = 0").count()
    assert (load("in"), load("in/*.grib2"), load("*/c.gr?b2"), load("in/d.grib2.gz")) == (5, 4, 2, 1)
    with pytest.raises(Exception, match="no\\*"):
        load("in/no*")


def test_plain_numbers(spark):
    x = np.array([7.9878316e-7, np.inf, -np.inf, np.nan, -0.0, 1e20, 0.1, 3, 16777216, -1.5e-40, 0.001], np.float32)
    assert reports.shortest(x)[:9] == ["0.00000079878316", "inf", "-inf", "NaN", "-0", "100000000000000000000", "0.1", "3", "16777216"]
    assert reports.shortest(x)[10] == "0.001"
    assert np.array(reports.shortest(x)[9], np.float32) == x[9]
    rows = spark.createDataFrame([(v,) for v in (1e-7, 85000.0, 0.25, -1.25e-5, 1.5e10, 1e7, 123456789.5, float("nan"), 0.0)], "v double")
    assert [r[0] for r in rows.select(reports.number(F.col("v"))).collect()] == ["0.0000001", "85000", "0.25", "-0.0000125", "15000000000", "10000000", "123456789.5", "NaN", "0"]


def test_half_way_between_two_texts():
    x = np.array([1.19921875, -0.439453125, 2**-12, 285.015625, 2**-13, 0.5, 0.1, -0.0, np.nan, -np.inf, 1e20], np.float32)
    near = ["1.1992188", "-0.43945312", "0.00024414062", "285.01562", "0.00012207031", "0.5", "0.1", "-0", "NaN", "-inf", "100000000000000000000"]
    assert reports.shortest(x) == near
    assert reports.shortest(x, "exact") == ["1.19921875", "-0.439453125", "0.000244140625", "285.015625", *near[4:]]


def test_colours_of_a_dump():
    assert reports.colorized("##  SECTION 1") == "\x1b[33m\x1b[1m##  SECTION 1\x1b[0m"
    assert reports.colorized("error: no") == "\x1b[31merror: no\x1b[0m"
    assert reports.colorized("plain") == "plain"
    assert reports.colorized("1-4       len = 21  // Length.") == "\x1b[32m1-4\x1b[0m\x1b[1m       len \x1b[0m\x1b[36m=\x1b[0m\x1b[35m\x1b[1m 21\x1b[0m\x1b[2m  // Length.\x1b[0m"


def test_texts_of_matrix_packing():
    texts = [part for f in wire.REPRESENTATIONS[1] for part in f if isinstance(part, str) and "coordinate values in functional form" in part]
    assert [t.split(" dimension")[0] for t in texts] == ["Coefficients to define first", "Coefficients to define second"]
    assert all("(IEEE 32-bit floating-point value)" in t for t in texts)
