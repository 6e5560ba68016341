"""The wire format as tables: one description of each section drives parsing, writing and dumping.

A layout is a list of fields and groups. ``field(name, kind, doc)`` has a kind of ``u1 u2 u3 u4 u8`` (unsigned, octets),
``i1 i2 i4`` (sign and magnitude), ``f4`` (IEEE), ``flags`` (one octet, shown in binary), ``raw16`` (octets), or a pair
(kind, name of the field that holds the length). ``group(name, layout)`` nests. ``choice(name, key, layouts)`` takes the
layout that a field before it names. ``optional(name, layout)`` is there if octets are left. Templates that users define
go into the same tables (``TEMPLATES``).
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np

from .bits import from_sign_magnitude, to_sign_magnitude
from .errors import GribError

SIZES = {"u1": 1, "u2": 2, "u3": 3, "u4": 4, "u8": 8, "i1": 1, "i2": 2, "i4": 4, "f4": 4, "flags": 1, "raw16": 16, "raw4": 4, "raw2": 2}
#: Values that mean "missing", by kind.
MISSING = {"u1": 255, "u2": 65535, "u4": 4294967295, "u8": (1 << 64) - 1, "i1": -127, "i2": -32767, "i4": -2147483647}


def field(name, kind, doc=""):
    return ("field", name, kind, doc)


def group(name, layout):
    return ("group", name, layout)


def choice(name, key, layouts):
    return ("choice", name, key, layouts)


def optional(name, layout):
    return ("optional", name, layout)


def scaled(name, factor, value, factor_doc, value_doc):
    return group(name, [field("scale_factor", factor, factor_doc), field("scaled_value", value, value_doc)])


# ---- Fixed values: names and descriptions of the fields, as the dump shows them. ----

EARTH = [
    field("shape", "u1", "Shape of the Earth (see Code table 3.2)."),
    scaled("spherical_earth_radius", "u1", "u4", "Scale factor of radius of spherical Earth.", "Scaled value of radius of spherical Earth."),
    scaled("major_axis", "u1", "u4", "Scale factor of major axis of oblate spheroid Earth.", "Scaled value of major axis of oblate spheroid Earth."),
    scaled("minor_axis", "u1", "u4", "Scale factor of minor axis of oblate spheroid Earth.", "Scaled value of minor axis of oblate spheroid Earth."),
]
RESOLUTION = field("resolution_and_component_flags", "flags", "Resolution and component flags (see Flag table 3.3).")
SCANNING = field("scanning_mode", "flags", "Scanning mode (flags - see Flag table 3.4).")
CENTRE = field("projection_centre", "flags", "Projection centre flag (see Flag table 3.5).")
GRID = [
    field("ni", "u4", "Ni - number of points along a parallel."),
    field("nj", "u4", "Nj - number of points along a meridian."),
    field("initial_production_domain_basic_angle", "u4", "Basic angle of the initial production domain (see Note 1)."),
    field("basic_angle_subdivisions", "u4", "Subdivisions of basic angle used to define extreme longitudes and latitudes, and direction increments (see Note 1)."),
    field("first_point_lat", "i4", "La1 - latitude of first grid point (see Note 1)."),
    field("first_point_lon", "u4", "Lo1 - longitude of first grid point (see Note 1)."),
    RESOLUTION,
    field("last_point_lat", "i4", "La2 - latitude of last grid point (see Note 1)."),
    field("last_point_lon", "u4", "Lo2 - longitude of last grid point (see Note 1)."),
]
LAT_LON = [
    group("grid", GRID),
    field("i_direction_inc", "u4", "Di - i direction increment (see Notes 1 and 5)."),
    field("j_direction_inc", "u4", "Dj - j direction increment (see Notes 1 and 5)."),
    SCANNING,
]
GAUSSIAN = [
    group("grid", GRID),
    field("i_direction_inc", "u4", "Di - i direction increment (see Notes 1 and 5)."),
    field("n", "u4", "N - number of parallels between a pole and the Equator (see Note 2)."),
    SCANNING,
]
ROTATION = [
    field("south_pole_lat", "i4", "Latitude of the southern pole of projection."),
    field("south_pole_lon", "u4", "Longitude of the southern pole of projection."),
    field("rot_angle", "f4", "Angle of rotation of projection."),
]
STRETCHING = [
    field("pole_lat", "i4", "Latitude of the pole of stretching."),
    field("pole_lon", "u4", "Longitude of the pole of stretching."),
    field("factor", "u4", "Stretching factor."),
]
FIRST_POINT = [
    field("first_point_lat", "i4", "La1 - latitude of first grid point."),
    field("first_point_lon", "u4", "Lo1 - longitude of first grid point."),
    RESOLUTION,
]
AXES = [field("ni", "u4", "Nx - number of points along the x-axis."), field("nj", "u4", "Ny - number of points along the y-axis.")]

GRIDS = {
    0: [group("earth", EARTH), group("lat_lon", LAT_LON)],
    1: [group("earth", EARTH), group("lat_lon", LAT_LON), group("rotation", ROTATION)],
    2: [group("earth", EARTH), group("lat_lon", LAT_LON), group("stretching", STRETCHING)],
    3: [group("earth", EARTH), group("lat_lon", LAT_LON), group("rotation", ROTATION), group("stretching", STRETCHING)],
    10: [
        group("earth_shape", EARTH),
        field("ni", "u4", "Ni - number of points along a parallel."),
        field("nj", "u4", "Nj - number of points along a meridian."),
        *FIRST_POINT,
        field("lad", "i4", "LaD - Latitude(s) at which the Mercator projection intersects the Earth (Latitude(s) where Di and Dj are specified)."),
        field("last_point_lat", "i4", "La2 - latitude of last grid point."),
        field("last_point_lon", "u4", "Lo2 - longitude of last grid point."),
        SCANNING,
        field("orientation", "u4", "Orientation of the grid, angle between i direction on the map and the equator (see Note 1)."),
        field("di", "u4", "Di - longitudinal direction grid length (see Note 2)."),
        field("dj", "u4", "Dj - latitudinal direction grid length (see Note 2)."),
    ],
    20: [
        group("earth_shape", EARTH),
        *AXES,
        *FIRST_POINT,
        field("lad", "i4", "LaD - latitude where Dx and Dy are specified."),
        field("lov", "i4", "LoV - orientation of the grid (see Note 2)."),
        field("dx", "u4", "Dx - x-direction grid length (see Note 3)."),
        field("dy", "u4", "Dy - y-direction grid length (see Note 3)."),
        CENTRE,
        SCANNING,
    ],
    30: [
        group("earth_shape", EARTH),
        *AXES,
        *FIRST_POINT,
        field("lad", "i4", "LaD - latitude where Dx and Dy are specified."),
        field("lov", "u4", "LoV - longitude of meridian parallel to y-axis along which latitude increases as the y-coordinate increases."),
        field("dx", "u4", "Dx - x-direction grid length (see Note 1)."),
        field("dy", "u4", "Dy - y-direction grid length (see Note 1)."),
        CENTRE,
        SCANNING,
        field("latin1", "i4", "Latin 1 - first latitude from the pole at which the secant cone cuts the sphere."),
        field("latin2", "i4", "Latin 2 - second latitude from the pole at which the secant cone cuts the sphere."),
        field("south_pole_lat", "i4", "Latitude of the southern pole of projection."),
        field("south_pole_lon", "u4", "Longitude of the southern pole of projection."),
    ],
    40: [group("earth", EARTH), group("gaussian", GAUSSIAN)],
    41: [group("earth", EARTH), group("gaussian", GAUSSIAN), group("rotation", ROTATION)],
    42: [group("earth", EARTH), group("gaussian", GAUSSIAN), group("stretching", STRETCHING)],
    43: [group("earth", EARTH), group("gaussian", GAUSSIAN), group("rotation", ROTATION), group("stretching", STRETCHING)],
    101: [
        field("earth_shape", "u1", "Shape of the Earth (see Code table 3.2)."),
        field("grid_num", "u3", "Number of grid used (defined by originating centre)."),
        field("ref_grid_num", "u1", "Number of grid in reference (to allow annotating for Arakawa C-grid on arbitrary grid) (see Note)."),
        field("uuid", "raw16", "Universally Unique Identifier of horizontal grid."),
    ],
}
#: Of these, the ones that a whole Section 3 is read with.
SECTION3_TEMPLATES = (0, 1, 20, 30, 40, 101)

PARAM = group("param", [field("category", "u1", "Parameter category (see Code Table 4.1)."), field("num", "u1", "Parameter number (see Code Table 4.2).")])


def process(doc):
    return group(
        "generating_process",
        [
            field("process_type", "u1", "Type of generating process (see Code Table 4.3)."),
            field("background_process", "u1", "Background generating process identifier (defined by originating centre)."),
            field("process_id", "u1", doc),
        ],
    )


ANY_PROCESS = process("Analysis or forecast generating processes identifier (defined by originating centre).")
FORECAST_PROCESS = process("Forecast generating process identifier (defined by originating centre).")


def forecast(hours, minutes):
    time = group("time", [field("unit", "u1", "Indicator of unit of time range (see Code Table 4.4)."), field("len", "i4", "Forecast time in units defined by octet 18.")])
    return group("forecast_time", [field("cutoff_hours", "u2", hours), field("cutoff_minutes", "u1", minutes), time])


OBSERVATIONAL = forecast("Hours of observational data cutoff after reference time (see Note 1)", "Minutes of observational data cutoff after reference time")
PLAIN_TIME = forecast("Hours after reference time of data cutoff (see Note 1).", "Minutes after reference time of data cutoff.")


HORIZONTAL = group(
    "horizontal",
    [
        group("first_surface", [field("surface_type", "u1", "Type of first fixed surface (see Code Table 4.5)."), scaled("value", "i1", "i4", "Scale factor of first fixed surface.", "Scaled value of first fixed surface.")]),
        group("second_surface", [field("surface_type", "u1", "Type of second fixed surface (see Code Table 4.5)."), scaled("value", "i1", "i4", "Scale factor of second fixed surface.", "Scaled value of second fixed surface.")]),
    ],
)
MEMBERS = field("num_forecasts", "u1", "Number of forecasts in ensemble.")

PRODUCTS = {
    0: [PARAM, ANY_PROCESS, OBSERVATIONAL, HORIZONTAL],
    1: [
        PARAM,
        FORECAST_PROCESS,
        PLAIN_TIME,
        HORIZONTAL,
        group("emsemble_forecast", [field("ensemble_forecast_type", "u1", "Type of ensemble forecast (see Code Table 4.6)."), field("perturbation_num", "u1", " Perturbation number."), MEMBERS]),
    ],
    2: [PARAM, FORECAST_PROCESS, PLAIN_TIME, HORIZONTAL, group("derived_forecast", [field("derived_forecast_type", "u1", "Derived forecast (see Code Table 4.7)."), MEMBERS])],
    5: [
        PARAM,
        FORECAST_PROCESS,
        PLAIN_TIME,
        HORIZONTAL,
        group(
            "probability_forecasts",
            [
                field("forecast_probability_num", "u1", "Forecast probability number."),
                field("total_num_forecast_probabilities", "u1", "Total number of forecast probabilities."),
                field("probability_type", "u1", "Probability type (see Code Table 4.9)."),
                scaled("lower_limit", "i1", "i4", "Scale factor of lower limit.", "Scaled value of lower limit."),
                scaled("upper_limit", "i1", "i4", "Scale factor of upper limit.", "Scaled value of upper limit."),
            ],
        ),
    ],
    6: [PARAM, ANY_PROCESS, PLAIN_TIME, HORIZONTAL, group("percentile_forecasts", [field("percentile_value", "u1", "Percentile value (from 100% to 0%).")])],
}

SIMPLE = group(
    "simple",
    [
        field("ref_val", "f4", "Reference value (R) (IEEE 32-bit floating-point value)."),
        field("exp", "i2", "Binary scale factor (E)."),
        field("dec", "i2", "Decimal scale factor (D)."),
        field("num_bits", "u1", "Number of bits used for each packed value for simple packing, or for each group reference value for complex packing or spatial differencing."),
    ],
)
ORIGINAL = field("orig_field_type", "u1", "Type of original field values (see Code table 5.1).")
COMPLEX = group(
    "complex",
    [
        field("group_splitting_method", "u1", "Group splitting method used (see Code table 5.4)."),
        field("missing_value_management", "u1", "Missing value management used (see Code table 5.5)."),
        field("primary_missing_value", "u4", "Primary missing value substitute."),
        field("secondary_missing_value", "u4", "Secondary missing value substitute."),
        field("num_groups", "u4", "NG - number of groups of data values into which field is split."),
        field("group_width_ref", "u1", "Reference for group widths (see Note 12)."),
        field("num_group_width_bits", "u1", "Number of bits used for the group widths (after the reference value in octet 36 has been removed)."),
        field("group_len_ref", "u4", "Reference for group lengths (see Note 13)."),
        field("group_len_inc", "u1", "Length increment for the group lengths (see Note 14)."),
        field("group_len_last", "u4", "True length of last group."),
        field("num_group_len_bits", "u1", "Number of bits used for the scaled group lengths (after subtraction of the reference value given in octets 38-41 and division by the length increment given in octet 42)."),
    ],
)
UNPACKED = [
    field("ts", "u4", "TS - total number of values in the unpacked subset (see Note 1)."),
    field("precision", "u1", "Precision of the unpacked subset (see Code table 5.7)."),
]
LAPLACE = field("p", "i4", "P - Laplacian scaling factor (expressed in 10-6 units).")

REPRESENTATIONS = {
    0: [SIMPLE, ORIGINAL],
    1: [
        SIMPLE,
        ORIGINAL,
        field("matrix_bitmap_present", "u1", "0, no matrix bit maps present; 1-matrix bit maps present."),
        field("num_encoded_vals", "u4", "Number of data values encoded in Section 7."),
        field("num_dim_1", "u2", "NR - first dimension (rows) of each matrix."),
        field("num_dim_2", "u2", "NC - second dimension (columns) of each matrix."),
        field("dim_1_coord_def", "u1", "First dimension coordinate value definition (Code table 5.2)."),
        field("num_dim_1_coeffs", "u1", "NC1 - number of coefficients or values used to specify first dimension coordinate function."),
        field("dim_2_coord_def", "u1", "Second dimension coordinate value definition (Code table 5.2)."),
        field("num_dim_2_coeffs", "u1", "NC2 - number of coefficients or values used to specify second dimension coordinate function."),
        field("dim_1_significance", "u1", "First dimension physical significance (Code table 5.3)."),
        field("dim_2_significance", "u1", "Second dimension physical significance (Code table 5.3)."),
        field("dim_1_coeffs", ("f4", "num_dim_1_coeffs"), "Coefficients to define first dimension coordinate values in functional form, or the explicit coordinate values (IEEE 32-bit floating-point value)."),
        field("dim_2_coeffs", ("f4", "num_dim_2_coeffs"), "Coefficients to define second dimension coordinate values in functional form, or the explicit coordinate values (IEEE 32-bit floating-point value)."),
    ],
    2: [SIMPLE, ORIGINAL, COMPLEX],
    3: [
        SIMPLE,
        ORIGINAL,
        COMPLEX,
        field("spatial_diff_order", "u1", "Order of spatial differencing (see Code table 5.6)."),
        field("num_extra_desc_octets", "u1", "Number of octets required in the data section to specify extra descriptors needed for spatial differencing (octets 6-ww in data template 7.3)."),
    ],
    4: [field("precision", "u1", "Precision (see Code table 5.7).")],
    40: [
        SIMPLE,
        ORIGINAL,
        field("compression_type", "u1", "Type of compression used (see Code table 5.40)."),
        field("compression_ratio", "u1", "Target compression ratio, M:1 (with respect to the bit-depth specified in octet 20), when octet 22 indicates lossy compression. Otherwise, set to missing (see Note 3)."),
    ],
    41: [SIMPLE, ORIGINAL],
    42: [
        SIMPLE,
        ORIGINAL,
        field("mask", "u1", "CCSDS compression options mask (see Note 3)."),
        field("block_size", "u1", "Block size."),
        field("ref_sample_interval", "u2", "Reference sample interval."),
    ],
    50: [SIMPLE, field("real_part_zero", "f4", "Real part of (0.0) coefficient (IEEE 32-bit floating-point value).")],
    51: [
        SIMPLE,
        LAPLACE,
        field("js", "u2", "JS - pentagonal resolution parameter of the unpacked subset (see Note 1)."),
        field("ks", "u2", "KS - pentagonal resolution parameter of the unpacked subset (see Note 1)."),
        field("ms", "u2", "MS - pentagonal resolution parameter of the unpacked subset (see Note 1)."),
        *UNPACKED,
    ],
    53: [
        SIMPLE,
        field("bi_fourier_subtrunc_type", "u1", "Bi-Fourier sub-truncation type (see Code table 5.25)."),
        field("bi_fourier_pack_mode", "u1", "Packing mode for axes (see Code table 5.26)."),
        LAPLACE,
        field("ns", "u2", "NS - bi-Fourier resolution parameter of the unpacked subset (see Note 1)."),
        field("ms", "u2", "MS - bi-Fourier resolution parameter of the unpacked subset (see Note 1)."),
        *UNPACKED,
    ],
    61: [SIMPLE, field("preprocess_param", "f4", "Pre-processing parameter (B) (IEEE 32-bit floating-point value).")],
    200: [
        field("num_bits", "u1", "Number of bits used for each packed value in the run length packing with level value."),
        field("max_val", "u2", "MV - maximum value within the levels that are used in the packing."),
        field("max_level", "u2", "MVL - maximum value of level (predefined)."),
        field("dec", "u1", "Decimal scale factor of representative value of each level."),
        field("level_vals", ("u2", "max_level"), "List of MVL scaled representative values of each level from lv=1 to MVL."),
    ],
}

CALENDAR = field("calendar_type", "u1", "Type of calendar (see Code table 1.6).")
OFFSET = field("paleontological_offset", "u2", "Number of tens of thousands of years of offset.")
HEADER = group("header", [field("len", "u4", "Length of section in octets (nn)."), field("sect_num", "u1", "Number of section.")])

TEMPLATES = {1: {0: [CALENDAR], 1: [OFFSET], 2: [CALENDAR, OFFSET]}, 3: GRIDS, 4: PRODUCTS, 5: REPRESENTATIONS}

INDICATOR = [
    field("identifier", "raw4", '"GRIB" (coded according to the International Alphabet No. 5).'),
    field("reserved", "raw2", "Reserved."),
    field("discipline", "u1", "Discipline - GRIB Master Table Number (see Code Table 0.0)."),
    field("edition_num", "u1", "GRIB Edition Number (currently 2)."),
    field("total_len", "u8", "Total length of GRIB message in octets (including Section 0)."),
]
PAYLOADS = {
    1: [
        field("centre_id", "u2", "Identification of originating/generating centre (see Common Code table C-11)."),
        field("subcentre_id", "u2", "Identification of originating/generating subcentre (allocated by originating/generating centre)."),
        field("master_table_version", "u1", "GRIB master table version number (see Common Code table C-0 and Note 1)."),
        field("local_table_version", "u1", "Version number of GRIB Local tables used to augment Master tables (see Code table 1.1 and Note 2)."),
        field("ref_time_significance", "u1", "Significance of reference time (see Code table 1.2)."),
        group(
            "ref_time",
            [
                field("year", "u2", "Year (4 digits) - Reference time of data."),
                field("month", "u1", "Month - Reference time of data."),
                field("day", "u1", "Day - Reference time of data."),
                field("hour", "u1", "Hour - Reference time of data."),
                field("minute", "u1", "Minute - Reference time of data."),
                field("second", "u1", "Second - Reference time of data."),
            ],
        ),
        field("prod_status", "u1", "Production status of processed data in this GRIB message (see Code table 1.3)."),
        field("data_type", "u1", "Type of processed data in this GRIB message (see Code table 1.4)."),
        optional("optional", [field("template_num", "u2", "Identification template number (optional, see Code table 1.5)."), choice("template", "template_num", TEMPLATES[1])]),
    ],
    3: [
        field("grid_def_source", "u1", "Source of grid definition (see Code table 3.0 and Note 1)."),
        field("num_points", "u4", "Number of data points."),
        field("num_point_list_octets", "u1", "Number of octets for optional list of numbers (see Note 2)."),
        field("point_list_interpretation", "u1", "Interpretation of list of numbers (see Code table 3.11)."),
        field("template_num", "u2", "Grid definition template number (= N) (see Code table 3.1)."),
        choice("template", "template_num", {n: GRIDS[n] for n in SECTION3_TEMPLATES}),
    ],
    4: [
        field("num_coord_values", "u2", "Number of coordinate values after template or number of information according to 3D vertical coordinate GRIB2 message (see Notes 1 and 5)."),
        field("template_num", "u2", "Product definition template number (see Code table 4.0)."),
        choice("template", "template_num", PRODUCTS),
    ],
    5: [
        field("num_encoded_points", "u4", "Number of data points where one or more values are specified in Section 7 when a bit map is present, total number of data points when a bit map is absent."),
        field("template_num", "u2", "Data representation template number (see Code table 5.0)."),
        choice("template", "template_num", REPRESENTATIONS),
    ],
    6: [field("bitmap_indicator", "u1", "Bit-map indicator (see Code table 6.0 and the Note).")],
}
HEADINGS = {
    0: "INDICATOR SECTION",
    1: "IDENTIFICATION SECTION",
    2: "LOCAL USE SECTION",
    3: "GRID DEFINITION SECTION",
    4: "PRODUCT DEFINITION SECTION",
    5: "DATA REPRESENTATION SECTION",
    6: "BIT-MAP SECTION",
    7: "DATA SECTION",
    8: "END SECTION",
}

# ---- End of the fixed values. ----


def section(num: int) -> list:
    return [HEADER, group("payload", PAYLOADS[num])]


def _read(kind: str, data: bytes, at: int):
    size = SIZES[kind]
    raw = bytes(data[at : at + size])
    if len(raw) < size:
        raise GribError(f"octets end at {len(data)} within a field at {at}")
    if kind[0] == "r":
        return raw
    if kind == "f4":
        return struct.unpack(">f", raw)[0]
    value = int.from_bytes(raw, "big")
    return from_sign_magnitude(value, 8 * size) if kind[0] == "i" else value


def _bytes(kind: str, value) -> bytes:
    if kind[0] == "r":
        return bytes(value)
    if kind == "f4":
        return struct.pack(">f", value)
    size = SIZES[kind]
    return (to_sign_magnitude(value, 8 * size) if kind[0] == "i" else int(value)).to_bytes(size, "big")


def parse(layout: list, data: bytes, at: int = 0) -> tuple[dict, int]:
    """Values by name, and where the octets go on."""
    out: dict = {}
    for what, name, *rest in layout:
        if what == "field":
            kind = rest[0]
            if isinstance(kind, tuple):
                out[name] = []
                for _ in range(out[kind[1]]):
                    out[name].append(_read(kind[0], data, at))
                    at += SIZES[kind[0]]
            else:
                out[name] = _read(kind, data, at)
                at += SIZES[kind]
        elif what == "group":
            out[name], at = parse(rest[0], data, at)
        elif what == "choice":
            number = out[rest[0]]
            if number not in rest[1]:
                raise GribError(f"template {number} is not known")
            out[name], at = parse(rest[1][number], data, at)
        elif at >= len(data):
            out[name] = None
        else:
            out[name], at = parse(rest[0], data, at)
    return out, at


def write(layout: list, values: dict) -> bytes:
    """The reverse of ``parse``."""
    out = []
    for what, name, *rest in layout:
        value = values.get(name)
        if what == "field":
            kind = rest[0]
            out += [_bytes(kind[0], v) for v in value] if isinstance(kind, tuple) else [_bytes(kind, value)]
        elif what == "group":
            out.append(write(rest[0], value))
        elif what == "choice":
            out.append(write(rest[1][values[rest[0]]], value))
        elif value is not None:
            out.append(write(rest[0], value))
    return b"".join(out)


def shown(kind, value) -> str:
    """A value as the dump prints it."""
    if isinstance(kind, tuple):
        return "[" + ", ".join(shown(kind[0], v) for v in value) + "]"
    if kind == "flags":
        return f"0b{value:08b}"
    if kind == "f4":
        x = np.float32(value)
        if not np.isfinite(x):
            return "NaN" if np.isnan(x) else "inf" if x > 0 else "-inf"
        if x == 0 or 1e-4 <= abs(x) < 1e16:
            return np.format_float_positional(x, unique=True, trim="0")
        digits, _, power = np.format_float_scientific(x, unique=True, trim="-").partition("e")
        return f"{digits}e{int(power)}"
    return "[" + ", ".join(map(str, value)) + "]" if kind[0] == "r" else str(value)


def dump(layout: list, values: dict, at: int = 1, parent: str = "") -> Iterator[tuple[int, str]]:
    """Lines of the dump, each with the octet that follows it; octets count from 1."""
    for what, name, *rest in layout:
        value, path = values.get(name), f"{parent}.{name}" if parent else name
        if what == "field":
            kind, doc = rest
            size = SIZES[kind[0]] * len(value) if isinstance(kind, tuple) else SIZES[kind]
            place = str(at) if size == 1 else f"{at}-{at + size - 1}"
            at += size
            yield at, f"{place:<10}{path} = {shown(kind, value)}" + (f"  // {doc}" if doc else "")
        elif value is not None:
            below = rest[0] if what != "choice" else rest[1][values[rest[0]]]
            for at, line in dump(below, value, at, path):  # noqa: B020, PLW2901
                yield at, line


def dump_message(parts: dict[int, bytes | None], total_length: int) -> list[str]:
    """The annotated text of one submessage; parts: octets of its sections 1 to 7 with headers, by number."""
    lines = [f"#  SUBMESSAGE (total_length = {total_length})", f"##  SECTION 0: {HEADINGS[0]} (length = 16)"]
    for num in range(1, 9):
        data = parts.get(num)
        if num == 2 and data is None:
            continue
        length = 4 if num == 8 else len(data) if num != 7 else int.from_bytes(data[:4], "big")
        lines.append(f"##  SECTION {num}: {HEADINGS[num]} (length = {length})")
        if num in PAYLOADS:
            try:
                values, _ = parse(section(num), data)
                lines += [line for _, line in dump(section(num), values)]
            except GribError as e:
                lines.append(f"error: {e}")
    return lines
