"""Octets and numbers as Spark expressions (J, N): all run inside the JVM.

``at`` counts octets from 0 within a binary column.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def unsigned(data: Column, at: int | Column, size: int) -> Column:
    """Big-endian unsigned integer of 1 to 7 octets; null where the octets end before it."""
    first = at + 1 if isinstance(at, Column) else F.lit(at + 1)
    part = F.substring(data, first, F.lit(size))
    return F.when(F.octet_length(part) == size, F.conv(F.hex(part), 16, 10).cast("long"))


def from_sign_magnitude(value: Column, bits: int) -> Column:
    top = 1 << bits - 1
    return F.when(value >= top, top - value).otherwise(value)


def to_sign_magnitude(value: Column, bits: int) -> Column:
    return F.when(value < 0, (1 << bits - 1) - value).otherwise(value)


def signed(data: Column, at: int | Column, size: int) -> Column:
    return from_sign_magnitude(unsigned(data, at, size), 8 * size)


def bits_required(value: Column) -> Column:
    return F.when(value == 0, 0).otherwise(F.length(F.bin(value.cast("long"))))


def octets(bits: Column) -> Column:
    return F.ceil(bits / 8).cast("long")


def normalized_longitude(lon: Column) -> Column:
    """The remainder keeps the sign of its left side, so that what is below -540 stays below -180."""
    return (lon + 540) % 360 - 180


def eastern_longitude(lon: Column) -> Column:
    return F.when(lon < 0, lon + 360).otherwise(lon)


def microdegrees(degrees: Column) -> Column:
    return (degrees * 1e6).cast("int")


def parameter_key(discipline: Column, category: Column, number: Column) -> Column:
    return F.shiftleft(discipline.cast("int"), 16) + F.shiftleft(category.cast("int"), 8) + number.cast("int")


def scaled_value(factor: Column, value: Column) -> Column:
    """value 10^-factor, NaN where the value is missing."""
    return F.when(value == -2147483647, float("nan")).otherwise(value * F.pow(F.lit(10.0), -factor))


def timestamp_of(parts: Sequence[Column]) -> Column:
    """Null for what isn't a date and time of the calendar."""
    return F.call_function("try_make_timestamp", *[p.cast("int") for p in parts[:5]], parts[5].cast("decimal(16,6)"))


def date_text(parts: Sequence[Column]) -> Column:
    return F.format_string("%04d-%02d-%02d %02d:%02d:%02d UTC", *[p.cast("int") for p in parts])


#: Seconds of the units of time that have a fixed length, by code.
UNIT_SECONDS = {0: 60, 1: 3600, 2: 86400, 10: 10800, 11: 21600, 12: 43200, 13: 1}
#: Names and short forms of the units of time.
UNIT_NAMES = {0: "Minute", 1: "Hour", 2: "Day", 3: "Month", 4: "Year", 5: "Decade", 6: "Normal", 7: "Century", 10: "ThreeHours", 11: "SixHours", 12: "TwelveHours", 13: "Second", 255: "Missing"}
UNIT_SHORT = {0: "m", 1: "h", 2: "D", 3: "M", 4: "Y", 5: "10Y", 6: "30Y", 7: "C", 10: "3h", 11: "6h", 12: "12h", 13: "s"}
#: Units of fixed surfaces, by type.
SURFACE_UNITS = {
    11: "m", 12: "m", 13: "%", 18: "Pa", 20: "K", 21: "kg m-3", 22: "kg m-3", 23: "Bq m-3", 24: "Bq m-3", 25: "dBZ", 26: "m", 27: "m", 30: "m", 100: "Pa",
    102: "m", 103: "m", 104: '"sigma" value', 106: "m", 107: "K", 108: "Pa", 109: "K m2 kg-1 s-1", 114: "Numeric", 117: "m", 151: "Numeric", 152: "Numeric",
    160: "m", 161: "m", 168: "Numeric", 169: "kg m-3", 170: "K", 171: "m2 s-1",
}


def lookup(code: Column, values: dict) -> Column:
    """The value of a code in a small fixed table, null if it has none."""
    return F.element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), code.cast("int"))


def target_time(reference: Column, unit: Column, value: Column) -> Column:
    """Reference time and a forecast time in a unit of fixed length; null for others, and beyond what a timestamp holds."""
    micros = F.try_multiply(value.cast("long"), lookup(unit, UNIT_SECONDS).cast("long") * 1_000_000)
    return F.timestamp_micros(F.try_add(F.unix_micros(reference.cast("timestamp")), micros))


def forecast_text(unit: Column, value: Column) -> Column:
    short = lookup(unit, UNIT_SHORT)
    other = F.when(unit == 255, "").otherwise(F.concat(F.lit(" [unit: "), unit.cast("string"), F.lit("]")))
    return F.concat(value.cast("string"), F.coalesce(F.concat(F.lit(" ["), short, F.lit("]")), other))


#: Colours of a temperature in kelvin, from the warmest down, as red, green, blue and opacity; the last is for the rest.
TEMPERATURE_COLOURS = (
    (35, (180, 0, 104, 255)),
    (30, (255, 40, 0, 255)),
    (25, (255, 153, 0, 255)),
    (20, (250, 245, 0, 255)),
    (15, (255, 255, 150, 255)),
    (10, (255, 255, 240, 255)),
    (5, (185, 235, 255, 255)),
    (0, (0, 150, 255, 255)),
    (-5, (0, 65, 255, 255)),
    (None, (0, 32, 128, 255)),
)


def temperature_colour(kelvin: Column) -> Column:
    """array<int> of four; NaN and null fall to the last colour."""
    out = None
    for celsius, rgba in TEMPERATURE_COLOURS:
        colour = F.array(*[F.lit(c) for c in rgba])
        if celsius is None:
            return out.otherwise(colour)
        warm = ~F.isnan(kelvin) & (kelvin > celsius + 273.15)
        out = F.when(warm, colour) if out is None else out.when(warm, colour)
    return out
