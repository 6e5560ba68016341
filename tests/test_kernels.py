"""Bits, decoders, encoders and grids against known vectors and round trips; no Spark."""

import struct
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from gridloom import bits, wire
from gridloom.errors import DecodeError, GribError, InvalidValue, LengthMismatch, NotSupported
from gridloom.operators import aec, decode, encode, grids

F4 = np.float32


def test_sign_magnitude_and_sentinels():
    assert [bits.from_sign_magnitude(x, 8) for x in (0, 1, 127, 128, 129, 255)] == [0, 1, 127, 0, -1, -127]
    assert [bits.to_sign_magnitude(x, 8) for x in (0, 1, -1, -127)] == [0, 1, 129, 255]
    assert bits.sint(b"\x80\x05\x01", 0, 3) == -1281
    assert wire.MISSING["i4"] == bits.sint(b"\xff\xff\xff\xff", 0, 4)


@pytest.mark.parametrize(("width", "offset", "expected"), [(2, 0, [0, 0, 0, 0, 3, 3]), (5, 0, [0, 3, 31, 31, 30, 0, 0, 0]), (9, 0, [1, 511, 504, 0]), (13, 0, [31, 8188, 0]), (2, 7, [1])])
def test_unpack(width, offset, expected):
    got = bits.unpack(bytes([0, 255, 255, 0, 0]), width, None, offset)
    assert got[: len(expected)].tolist() == expected
    assert len(got) == (40 - offset) // width


@pytest.mark.parametrize(("width", "offset", "expected"), [(4, 0, "0123456789a0"), (5, 0, "00443214c74254"), (16, 4, "0000000010002000300040005000600070008000900 0a0".replace(" ", ""))])
def test_pack(width, offset, expected):
    assert bits.pack(np.arange(11), width, offset).hex() == expected


@given(st.integers(1, 32), st.lists(st.integers(0, 2**32 - 1), max_size=40), st.integers(0, 9))
def test_pack_unpack(width, values, offset):
    v = np.array([x % (1 << width) for x in values], np.int64)
    assert bits.unpack(bits.pack(v, width, offset), width, len(v), offset).tolist() == v.tolist()


def test_rounding_and_bits_required():
    assert bits.round_half_away(np.array([0.5, -0.5, 1.5, 2.5, 0.49999999999999994])).tolist() == [1, -1, 2, 3, 0]
    assert [bits.bits_required(x) for x in (0, 1, 4)] == [0, 1, 3]


def test_simple_packing_vector():
    template = {"simple": {"ref_val": struct.unpack(">f", bytes.fromhex("353e6bf6"))[0], "exp": -26, "dec": 0, "num_bits": 16}, "orig_field_type": 0}
    assert decode.simple(template, bytes.fromhex("0006000d"), 2).tolist() == [F4(7.9878316e-7), F4(9.030913e-7)]
    with pytest.raises(NotSupported):
        decode.simple(template | {"orig_field_type": 1}, b"", 0)


def test_run_length_vectors():
    codes = bytes(n + 240 for n in (3, 9, 12, 6, 4, 15, 2, 1, 0, 13, 12, 2, 3))
    levels = [n + 240 for n in (3, 9, 9, 6, 4, 4, 4, 4, 4, 2, 1, 0, 0, 0, 0, 0, 0, 0, 0, 2, 3)]
    assert decode.runs(codes, 8, 250, 21).tolist() == levels
    assert (decode.runs(b"\x00\x14\x1c", 8, 3) == np.zeros(6065)).all()
    with pytest.raises(LengthMismatch):
        decode.runs(codes, 8, 250, 20)
    with pytest.raises(DecodeError):
        decode.runs(b"\xff", 8, 3)
    template = {"num_bits": 8, "max_val": 3, "max_level": 3, "dec": 1, "level_vals": [1, 2, 3]}
    got = decode.run_length(template, bytes([0, 3, 5]), 3)
    assert np.isnan(got[0])
    assert got[1:].tolist() == [F4(3) * F4(0.1)] * 2
    with pytest.raises(DecodeError, match="invalid level value"):
        decode.run_length(template | {"level_vals": [1]}, bytes([0, 3]), 2)


@pytest.mark.parametrize(("size", "first", "least"), [(1, [0, 1], 2), (2, [1, 0x203], 0x405), (3, [0x102, 0x30405], 0x60708), (4, [0x10203, 0x4050607], 0x8090A0B)])
def test_difference_descriptors(size, first, least):
    assert decode.descriptors(2, size, bytes(range(16))) == (first, least, 3 * size)


def test_difference_descriptors_refused():
    for order, size in ((255, 1), (3, 1), (1, 0), (1, 5)):
        with pytest.raises(NotSupported):
            decode.descriptors(order, size, bytes(16))


def test_undo_differences():
    d = np.array([n * (-1) ** n for n in range(10)])
    none = np.zeros(10, bool)
    assert decode.undo_differences(d, none, [100]).tolist() == [100, 99, 101, 98, 102, 97, 103, 96, 104, 95]
    gap = np.array([0, 0, 1, 0, 0, 0, 1, 0, 0, 0], bool)
    got = decode.undo_differences(np.array([0, -1, 9, 2, -3, 4, 9, -5, 6, -7]), gap, [100])
    assert got[~gap].tolist() == [100, 99, 101, 98, 102, 97, 103, 96]
    rng = np.random.default_rng(3)
    for n in (1, 2, 3, 50):
        v = rng.integers(-1000, 1000, n)
        second = np.r_[v[:2] * 0, np.diff(v, 2)][:n]
        assert decode.undo_differences(second, np.zeros(n, bool), v[:2].tolist()).tolist() == v.tolist()


def spatial(values, order, missing=None, management=0):
    """Sections of template 5.3 written by hand, one group a value where there are missing ones."""
    v = np.asarray(values, np.int64)
    gap = np.zeros(len(v), bool) if missing is None else missing
    kept = v[~gap]
    d = np.zeros(len(v), np.int64)
    d[~gap] = np.r_[kept[:order], np.diff(kept, order)][: len(kept)]
    least = int(d[~gap][order:].min()) if len(kept) > order else 0
    x = np.where(gap, 0, d - least)
    x[np.flatnonzero(~gap)[:order]] = 0
    width = int(x.max()).bit_length() + 1
    codes = np.where(gap, (1 << width) - 1, x)
    octs = lambda k: bits.to_sign_magnitude(int(k), 32).to_bytes(4, "big")
    head = b"".join(octs(k) for k in [*kept[:order], least])
    c = {"group_splitting_method": 1, "missing_value_management": management, "primary_missing_value": 0, "secondary_missing_value": 0, "num_groups": 1, "group_width_ref": width, "num_group_width_bits": 0, "group_len_ref": 0, "group_len_inc": 0, "group_len_last": len(v), "num_group_len_bits": 0}
    template = {"simple": {"ref_val": 0.0, "exp": 0, "dec": 0, "num_bits": 8}, "orig_field_type": 0, "complex": c, "spatial_diff_order": order, "num_extra_desc_octets": 4}
    s7 = encode.section(7, head + b"\0" + bits.pack(codes, width))
    return encode.section5(len(v), 3, template), encode.section(6, b"\xff"), s7


@pytest.mark.parametrize("order", [1, 2])
def test_spatial_differencing_field(order):
    v = np.array([5, 9, 4, 4, 100, 90, -7, 3])
    assert decode.decode_field(8, *spatial(v, order)).tolist() == v.tolist()
    gap = np.array([1, 0, 0, 1, 0, 0, 0, 1], bool)
    got = decode.decode_field(8, *spatial(v, order, gap, 1))
    assert np.isnan(got).tolist() == gap.tolist()
    assert got[~gap].tolist() == v[~gap].tolist()


def test_group_without_bits_is_missing_by_its_reference():
    c = {"group_splitting_method": 1, "missing_value_management": 2, "num_groups": 3, "group_width_ref": 0, "num_group_width_bits": 0, "group_len_ref": 2, "group_len_inc": 0, "group_len_last": 1, "num_group_len_bits": 0}
    codes, missing = decode.groups(c, 8, bytes([255, 254, 7]))
    assert missing.tolist() == [True, True, True, True, False]
    assert codes[-1] == 7
    _, missing = decode.groups(c | {"missing_value_management": 1}, 0, b"")
    assert missing.all()  # all-ones of no bits is 0, the reference


def test_bitmap():
    got = decode.scatter(decode.bitmap_bits(24, 10, bytes([0b01001100, 0b01110000, 0b11110000])), np.arange(10, dtype=F4))
    nan = np.nan
    assert np.array_equal(got, [nan, 0, nan, nan, 1, 2, nan, nan, nan, 3, 4, 5, nan, nan, nan, nan, 6, 7, 8, 9, nan, nan, nan, nan], equal_nan=True)
    with pytest.raises(LengthMismatch):
        decode.bitmap_bits(25, 10, bytes(3))
    with pytest.raises(DecodeError, match="inconsistent"):
        decode.bitmap_bits(24, 9, bytes([0b01001100, 0b01110000, 0b11110000]))
    assert decode.bitmap_bits(6, 6, None) is None


def test_unsupported():
    s5, s6, s7 = encode.encode_field(np.arange(4.0), 0)
    with pytest.raises(NotSupported, match="bit map indicator"):
        decode.decode_field(4, s5, s6[:5] + b"\xfe", s7)
    with pytest.raises(NotSupported, match="5.0"):
        decode.decode_field(4, s5[:9] + b"\x00\x04" + b"\x01", s6, s7)
    with pytest.raises(NotSupported, match="5.0"):
        decode.decode_field(4, s5[:9] + b"\x03\xe7" + s5[11:], s6, s7)
    template = {"simple": {"ref_val": 2.5, "exp": 0, "dec": 0, "num_bits": 0}, "orig_field_type": 0}
    assert decode.jpeg2000(template, b"", 3).tolist() == [2.5] * 3
    with pytest.raises(NotSupported):
        decode.jpeg2000({"simple": {"num_bits": 8}, "orig_field_type": 0}, b"", 3)


def png_of(pixels: np.ndarray, depth: int, colour: int, kinds) -> bytes:
    rows = pixels.reshape(pixels.shape[0], -1).astype(np.uint8)
    step = max(1, depth * {0: 1, 2: 3, 6: 4}[colour] // 8)
    raw, above = b"", np.zeros(rows.shape[1], np.int64)
    for y, row in enumerate(rows.astype(np.int64)):
        left = np.r_[np.zeros(step, np.int64), row[:-step]] if step < len(row) else np.zeros(len(row), np.int64)
        corner = np.r_[np.zeros(step, np.int64), above[:-step]] if step < len(row) else np.zeros(len(row), np.int64)
        p = left + above - corner
        paeth = np.where((abs(p - left) <= abs(p - above)) & (abs(p - left) <= abs(p - corner)), left, np.where(abs(p - above) <= abs(p - corner), above, corner))
        guess = [0 * row, left, above, (left + above) // 2, paeth][kinds[y % len(kinds)]]
        raw += bytes([kinds[y % len(kinds)]]) + ((row - guess) % 256).astype(np.uint8).tobytes()
        above = row
    chunk = lambda name, body: struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))
    width = rows.shape[1] * 8 // (depth * {0: 1, 2: 3, 6: 4}[colour])
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, len(rows), depth, colour, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


@pytest.mark.parametrize(("bits_", "depth", "colour", "octets"), [(8, 8, 0, 1), (16, 16, 0, 2), (24, 8, 2, 3), (32, 8, 6, 4)])
def test_png(bits_, depth, colour, octets):
    rng = np.random.default_rng(bits_)
    pixels = rng.integers(0, 256, (7, 5 * octets))
    data = png_of(pixels, depth, colour, (0, 1, 2, 3, 4))
    codes = bits.unpack(pixels.astype(np.uint8).tobytes(), bits_)
    template = {"simple": {"ref_val": 1.0, "exp": 0, "dec": 0, "num_bits": bits_}, "orig_field_type": 0}
    assert decode.png(template, data, 35).tolist() == decode.scale(codes, template["simple"]).tolist()
    with pytest.raises(DecodeError):
        decode.png_pixels(b"no image")


@pytest.mark.parametrize(("wide", "high", "depth"), [(5, 7, 8), (1, 1, 8), (16, 9, 16), (11, 3, 4), (3, 20, 1)])
def test_interlaced_png(wide, high, depth):
    """Seven passes of an image, written by the definition of their pixels."""
    x = np.random.default_rng(wide).integers(0, 1 << depth, (high, wide))
    passes = [[x[r, c] for c in range(wide)] for r in range(high)]
    raw = b""
    for first, top, right, down in ((0, 0, 8, 8), (4, 0, 8, 8), (0, 4, 4, 8), (2, 0, 4, 4), (0, 2, 2, 4), (1, 0, 2, 2), (0, 1, 1, 2)):
        for r in range(top, high, down):
            line = [passes[r][c] for c in range(first, wide, right)]
            raw += b"\0" + bits.pack(np.array(line), depth) if line else b""
    chunk = lambda name, body: len(body).to_bytes(4, "big") + name + body + zlib.crc32(name + body).to_bytes(4, "big")
    head = wide.to_bytes(4, "big") + high.to_bytes(4, "big") + bytes([depth, 0, 0, 0, 1])
    got = decode.png_pixels(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))
    assert got == b"".join(bits.pack(row, depth) for row in x)


@pytest.mark.parametrize("width", [1, 3, 4, 8, 12, 16, 20, 32])
@pytest.mark.parametrize("mask", [0, 8, 8 | 4, 8 | 32, 8 | 16, 8 | 1])
def test_aec(width, mask):
    if mask & 1 and width == 1:
        return
    rng = np.random.default_rng(width)
    low, high = aec.limits(width, mask)
    for kind in range(3):
        x = rng.integers(low, high + 1, 300) if kind == 0 else np.clip(np.cumsum(rng.integers(-2, 3, 300)) + (low + high) // 2, low, high)
        x[50:200] = x[50]
        if kind == 2:
            x[:] = x[0]
        for block in (8, 16):
            assert aec.decode(aec.encode(x, width, block, 8, mask), 300, width, block, 8, mask).tolist() == x.tolist()
    with pytest.raises(DecodeError):
        aec.decode(b"", 3, width, 8, 8, mask)


def test_ccsds_field():
    x = np.arange(64) % 37
    template = {"simple": {"ref_val": 0.0, "exp": 0, "dec": 1, "num_bits": 12}, "orig_field_type": 0, "mask": 8 | 4, "block_size": 16, "ref_sample_interval": 4}
    s7 = encode.section(7, aec.encode(x, 12, 16, 4, 12))
    got = decode.decode_field(64, encode.section5(64, 42, template), encode.section(6, b"\xff"), s7)
    assert got.tolist() == (x.astype(F4) * F4(0.1)).tolist()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.integers(-(10**6), 10**6)), min_size=1, max_size=120), st.sampled_from([None, 1, 4, 16]), st.integers(0, 2))
def test_encode_decode(values, ahead, decimals):
    v = np.array([np.nan if x is None else x / 100 for x in values])
    got = decode.decode_field(len(v), *encode.encode_field(v, decimals, ahead))
    assert np.isnan(got).tolist() == np.isnan(v).tolist()
    ok = ~np.isnan(v)
    assert np.allclose(got[ok], v[ok], atol=0.5 * 10.0**-decimals + 0.01)


def test_encoder_parameters():
    v = np.arange(2.0, 11.0)
    assert encode.quantise(v, 0).simple == {"ref_val": 2.0, "exp": 0, "dec": 0, "num_bits": 4}
    assert encode.quantise(v, 1).simple == {"ref_val": 20.0, "exp": 0, "dec": 1, "num_bits": 7}
    assert encode.quantise(np.full(256, 10.0), 0).simple["num_bits"] == 0
    assert encode.quantise(np.array([0.0, 1e15]), 0).simple["exp"] > 0
    empty = encode.quantise(np.array([np.nan]), 0).simple
    assert (empty["ref_val"], empty["num_bits"]) == (np.inf, 0)
    assert encode.encoded_params(encode.encode_field(v, 1)[0])["simple"]["ref_val"] == 20.0
    assert [len(s) for s in encode.encode_field(np.r_[v, np.nan], 0)] == [21, 8, 5 + 5]
    assert len(encode.encode_field(v, 0, 4)[0]) == 47


def test_grouping():
    v = list(range(24))
    v[10], v[21], v[22] = 64, 128, 256
    assert encode.split(v, 4) == [(0, 10), (10, 11), (11, 21), (21, 23), (23, 24)]
    assert encode.length_code([0] * 5) == (0, 0, 0)
    assert encode.length_code([5] * 5) == (5, 0, 0)
    assert encode.length_code([26, 24, 20, 14, 13]) == (13, 1, 4)
    assert encode.length_code([13, 19, 22, 16, 25]) == (13, 3, 3)
    assert encode.length_code([0, 300, 600])[1] == 1  # the increment has one octet only


def test_lat_lon_grid_builder():
    def of(*a):
        g = encode.lat_lon_grid(*a)
        return g["grid"]["first_point_lat"], g["grid"]["first_point_lon"], g["grid"]["last_point_lon"], g["i_direction_inc"], g["j_direction_inc"], g["scanning_mode"]

    assert of((201, 101), (40.0, 130.0), (30.0, 140.0)) == (40000000, 130000000, 140000000, 50000, 100000, 0)
    assert of((201, 101), (40.0, 140.0), (30.0, 130.0))[-1] == 0x80
    assert of((201, 101), (30.0, 130.0), (40.0, 140.0))[-1] == 0x40
    assert of((2, 2), (40.0, 0.0), (30.0, 355.0)) == (40000000, 0, 355000000, 355000000, 10000000, 0)
    assert of((2, 2), (40.0, 0.0), (30.0, -5.0)) == (40000000, 0, 355000000, 5000000, 10000000, 0x80)
    assert of((2, 2), (40.0, 0.0), (30.0, 5.0), False)[-1] == 0x20


@pytest.mark.parametrize(("mode", "order"), [(0x00, [(0, 0), (1, 0), (0, 1), (1, 1), (0, 2), (1, 2)]), (0x20, [(0, 0), (0, 1), (0, 2), (1, 0), (1, 1), (1, 2)]), (0x10, [(0, 0), (1, 0), (1, 1), (0, 1), (0, 2), (1, 2)]), (0x30, [(0, 0), (0, 1), (0, 2), (1, 2), (1, 1), (1, 0)])])
def test_scan_order(mode, order):
    i, j = grids.grid_index(2, 3, mode)
    assert list(zip(i.tolist(), j.tolist(), strict=True)) == order


def test_scan_order_refused():
    with pytest.raises(NotSupported):
        grids.grid_index(2, 3, 1)


def test_longitude_normalisation():
    assert grids.normalized(np.array([-180, 0, 179, 180, 360, 540], F4)).tolist() == [-180, 0, 179, -180, 0, -180]
    assert grids.normalized(np.array([-600], F4))[0] == -240


@pytest.mark.parametrize(("first", "last", "mode", "head", "tail"), [(0, 359760000, 0x40, [0, 0.24], [-0.48, -0.24]), (180000000, 179760000, 0x40, [-180, -179.76], [179.52, 179.76]), (359760000, 0, 0xC0, [-0.24, -0.48], [0.24, 0]), (179760000, 180000000, 0xC0, [179.76, 179.52], [-179.76, -180])])
def test_longitudes_across_the_meridian(first, last, mode, head, tail):
    lon = grids.normalized(grids.longitudes(first, last, 1500, 1e-6, mode))
    assert np.allclose(lon[:2], head, atol=1e-4)
    assert np.allclose(lon[-2:], tail, atol=1e-4)


def test_inconsistent_rows_and_lists_of_points():
    g = encode.lat_lon_grid((2, 2), (40.0, 0.0), (30.0, 5.0))
    g["scanning_mode"] = 0x40
    with pytest.raises(InvalidValue):
        grids.lat_lons(encode.section3(4, 0, {"earth": encode.SPHERE, "lat_lon": g}))
    g["scanning_mode"] = 0
    s3 = encode.section3(4, 0, {"earth": encode.SPHERE, "lat_lon": g})
    assert grids.shape_of(s3) == (2, 2, 0)
    with pytest.raises(NotSupported, match="list of number of points"):
        grids.lat_lons(s3 + b"\0")
    with pytest.raises(InvalidValue, match="points"):
        grids.lat_lons(encode.section3(5, 0, {"earth": encode.SPHERE, "lat_lon": g}))
    with pytest.raises(NotSupported):
        grids.grid_of(s3[:12] + b"\0\x65" + s3[14:])


@pytest.mark.parametrize(("pole", "point", "expected"), [((-90000000, 0), (-12.302501, 345.178780), (-12.302501, 345.178780)), ((-36088520, 245305142), (-12.302501, 345.178780), (39.626032, -133.62952 + 720))])
def test_rotation(pole, point, expected):
    lat, lon = grids.unrotate(np.array([point[0]], F4), np.array([point[1]], F4), {"south_pole_lat": pole[0], "south_pole_lon": pole[1], "rot_angle": 0.0}, 1e-6)
    assert abs(lat[0] - expected[0]) < 1e-5
    assert abs(lon[0] - expected[1]) < 1e-3


ROUND = {"shape": 6, **{k: {"scale_factor": 255, "scaled_value": 0} for k in ("spherical_earth_radius", "major_axis", "minor_axis")}}


def test_polar_stereographic():
    g = {"earth_shape": ROUND, "ni": 935, "nj": 824, "first_point_lat": 18145030, "first_point_lon": 217107456, "lad": 60000000, "lov": 249000000, "dx": 10000000, "dy": 10000000, "projection_centre": 0, "scanning_mode": 0x40}
    lat, lon = grids.polar_stereographic(g)
    at = [0, 1, -2, -1]
    assert np.allclose(lat[at], [18.14503, 18.17840149, 45.4865147, 45.40545211], atol=1e-4)
    assert np.allclose(lon[at], [-142.892544, -142.83604096, -10.15230394, -10.17442147], atol=1e-4)
    south, _ = grids.polar_stereographic(g | {"projection_centre": 0x80, "first_point_lat": -18145030, "lad": -60000000, "scanning_mode": 0})
    assert np.allclose(south, -lat, atol=1e-4)
    with pytest.raises(NotSupported):
        grids.polar_stereographic(g | {"projection_centre": 1})
    with pytest.raises(NotSupported):
        grids.polar_stereographic(g | {"earth_shape": ROUND | {"shape": 99}})


def test_lambert():
    earth = ROUND | {"shape": 1, "spherical_earth_radius": {"scale_factor": 0, "scaled_value": 6371200}}
    g = {"earth_shape": earth, "ni": 2145, "nj": 1377, "first_point_lat": 20190000, "first_point_lon": 238449996, "lad": 25000000, "lov": 265000000, "dx": 2539703, "dy": 2539703, "projection_centre": 0, "scanning_mode": 0x50, "latin1": 25000000, "latin2": 25000000}
    lat, lon = grids.lambert(g)
    at = [0, 1, -2, -1]
    assert np.allclose(lat[at], [20.19, 20.19442682, 50.10756403, 50.1024611], atol=1e-4)
    assert np.allclose(lon[at], [-121.550004, -121.52621665, -60.91298217, -60.88202274], atol=1e-4)
    for shape in (4, 5):  # on an ellipsoid going forth and back gives the first point
        lat, lon = grids.lambert(g | {"earth_shape": ROUND | {"shape": shape}, "latin2": 45000000})
        assert abs(lat[0] - 20.19) < 1e-5
        assert abs(lon[0] + 121.550004) < 1e-4


def test_gaussian():
    assert len(grids.gaussian_latitudes(0)) == 0
    assert grids.gaussian_latitudes(1).tolist() == [0.0]
    assert abs(grids.gaussian_latitudes(2)[0] - np.arcsin(1 / np.sqrt(3))) < 1e-15
    five = np.arcsin([np.sqrt(5 + 2 * np.sqrt(10 / 7)) / 3, np.sqrt(5 - 2 * np.sqrt(10 / 7)) / 3, 0])
    assert np.allclose(grids.gaussian_latitudes(5)[:3], five)
    lat = np.rad2deg(grids.gaussian_latitudes(160))
    assert abs(lat[0] - 89.1415) < 1e-4
    assert abs(lat[79] - 0.5607) < 1e-4
    assert np.allclose(np.rad2deg(grids.gaussian_latitudes(1536))[:2], [89.91032, 89.79416], atol=1e-4)


def test_radii():
    of = lambda shape, **k: grids.radii(ROUND | {"shape": shape} | k)
    assert of(0) == (6367470.0, 6367470.0)
    assert of(3, major_axis={"scale_factor": 0, "scaled_value": 6378}, minor_axis={"scale_factor": 0, "scaled_value": 6356}) == (6378000.0, 6356000.0)
    assert of(7, major_axis={"scale_factor": 1, "scaled_value": 637800}, minor_axis={"scale_factor": 1, "scaled_value": 635600}) == (6378000.0, 6356000.0)
    assert of(9) is None


def test_wire_round_trip_of_all_templates():
    rng = np.random.default_rng(1)

    def some(layout):
        out = {}
        for what, name, *rest in layout:
            if what == "field":
                kind = rest[0]
                size = wire.SIZES[kind[0] if isinstance(kind, tuple) else kind]
                one = lambda k, size=size: 1.5 if k == "f4" else bytes(size) if k[0] == "r" else int(rng.integers(0, 100))
                out[name] = [one(kind[0]) for _ in range(out[kind[1]])] if isinstance(kind, tuple) else one(kind)
            else:
                out[name] = some(rest[0])
        return out

    for templates in wire.TEMPLATES.values():
        for layout in templates.values():
            values = some(layout)
            data = wire.write(layout, values)
            assert wire.parse(layout, data) == (values, len(data))
            assert [at for at, _ in wire.dump(layout, values)][-1] == len(data) + 1
    with pytest.raises(GribError):
        wire.parse(wire.section(1), b"\0\0\0\7\1")


def test_shown_floats():
    assert [wire.shown("f4", x) for x in (0.0, 1.5, 7.9878316e-7, float("nan"), float("inf"))] == ["0.0", "1.5", "7.9878316e-7", "NaN", "inf"]
    assert wire.shown("flags", 0x30) == "0b00110000"
