"""Text reports (B): what the command line prints, as DataFrames (path, msg, sub, text) and as lists of lines.

Texts are put together by Spark expressions from ``layers``; the formats are fixed values.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import codes
from ..functions import octets as X
from ..operators import relations as R

LIST_HEADER = "      id │ Parameter                       Generating process  Forecast time                 1st fixed surface                 2nd fixed surface │   #points (nan/total) grid type"
SUBMESSAGE_HEADER = "      id │    S2    S3    S4    S5    S6    S7 │ Tmpl3   Tmpl4   Tmpl5"


def right(c: Column, n: int) -> Column:
    """Padded on the left to n characters at least."""
    return F.when(F.length(c) >= n, c).otherwise(F.lpad(c, n, " "))


def left(c: Column, n: int) -> Column:
    return F.when(F.length(c) >= n, c).otherwise(F.rpad(c, n, " "))


def text(c: Column | str) -> Column:
    return F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit(""))


def plain(v: Column) -> Column:
    """A number that Spark writes with an exponent as plain digits, without a fraction of zero."""
    s = v.cast("string")
    digits = F.regexp_replace(F.regexp_replace(F.regexp_extract(s, r"^-?([0-9.]+)E", 1), r"\.", ""), "0+$", "")
    power = F.regexp_extract(s, r"E(-?[0-9]+)$", 1).try_cast("int")
    small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -power - 1), digits)
    large = F.when(F.length(digits) <= power + 1, F.rpad(digits, power + 1, "0")).otherwise(F.concat(F.substring(digits, F.lit(1), power + 1), F.lit("."), F.substring(digits, power + 2, F.length(digits))))
    sign = F.when(s.startswith("-"), "-").otherwise("")
    return F.when(power.isNotNull(), F.concat(sign, F.when(power < 0, small).otherwise(large))).otherwise(F.regexp_replace(s, r"\.0$", ""))


def number(v: Column) -> Column:
    """A value of a fixed surface: plain digits, NaN as it is."""
    return F.when(F.isnan(v), "NaN").otherwise(plain(v))


def shortest(x: np.ndarray, ties: str = "even") -> list[str]:
    """The fewest digits that tell a float from its neighbours, without an exponent.

    Half way between two such texts, the one with the even digit; with ``ties="exact"`` the float's own value, which has one
    digit more.
    """
    out = x.astype(str).tolist()
    out = [np.format_float_positional(x[i], unique=True) if "e" in t else t for i, t in enumerate(out)]
    out = ["NaN" if t == "nan" else t.removesuffix(".0").removesuffix(".") for t in out]
    if ties == "exact":
        wide = x.astype(np.float64)
        # an odd number of 2^-j has j decimals; with more than 14 it has over 10 digits, and a float's text has at most 9
        for i in np.flatnonzero(np.isfinite(wide) & (wide * 2.0**14 == np.floor(wide * 2.0**14))).tolist():
            decimals = len(out[i].partition(".")[2])
            if abs(wide[i]) * 2.0 ** (decimals + 1) % 2 == 1:
                out[i] = np.format_float_positional(wide[i], unique=True, trim="-")
    return out


def shortest_text(value: Column, ties: str = "even") -> Column:
    @F.arrow_udf("string")
    def run(values: pa.Array) -> pa.Array:
        return pa.array(shortest(values.to_numpy(zero_copy_only=False).astype(np.float32), ties), pa.string())

    return run(value)


def surface(n: int) -> Column:
    """``value [unit] (text)`` of a fixed surface, as far as it has them."""
    kind, value = F.col(f"surf{n}_type"), X.scaled_value(F.col(f"surf{n}_scale"), F.col(f"surf{n}_value"))
    unit = X.lookup(kind, X.SURFACE_UNITS)
    return F.when(kind.isNotNull(), F.concat(number(value), F.coalesce(F.concat(F.lit(" ["), unit, F.lit("]")), F.lit(""))))


def with_texts(layers: DataFrame, table: DataFrame) -> DataFrame:
    """``layers`` and the texts of their codes."""
    out = layers
    for tbl, code, name, keys in (
        ("3.1", "grid_tmpl", "grid_text", {}),
        ("4.0", "prod_tmpl", "prod_text", {}),
        ("5.0", "repr_tmpl", "repr_text", {}),
        ("4.1", "category", "category_text", {"discipline": "discipline"}),
        ("4.2", "number", "parameter_text", {"discipline": "discipline", "category": "category"}),
        ("4.3", "process", "process_text", {}),
        ("4.5", "surf1_type", "surf1_text", {}),
        ("4.5", "surf2_type", "surf2_text", {}),
    ):
        out = codes.described(out, table, tbl, code, name, **keys)
    return out


def layer_list(layers: DataFrame, table: DataFrame) -> DataFrame:
    """(path, msg, sub, text): one line for each layer."""
    t = with_texts(layers, table)
    index = F.concat(F.col("msg").cast("string"), F.lit("."), F.col("sub").cast("string"))
    line = F.concat(
        right(index, 8), F.lit(" │ "), left(text("parameter_text"), 31), F.lit(" "), left(text("process_text"), 18), F.lit(" "), right(text(X.forecast_text(F.col("ft_unit"), F.col("ft_value"))), 14), F.lit(" "),
        right(text(surface(1)), 33), F.lit(" "), right(text(surface(2)), 33), F.lit(" │ "), right(text("num_missing"), 10), F.lit("/"), right(text("num_points"), 10), F.lit(" "), left(F.col("grid_name"), 21),
    )
    return t.select(*R.KEYS, line.alias("text"))


def layer_descriptions(layers: DataFrame, table: DataFrame) -> DataFrame:
    """(path, msg, sub, text): a block of lines for each layer."""
    t = with_texts(layers, table)
    byte = lambda c, none: F.when(F.col(c) == none, "Missing").otherwise(F.col(c).cast("string"))
    unit = F.coalesce(X.lookup(F.col("ft_unit"), X.UNIT_NAMES), F.concat(F.lit("code "), F.col("ft_unit").cast("string")))
    rows = (
        ("Grid:", "grid_text"), ("  Number of points:", "num_points"), ("Product:", "prod_text"), ("  Parameter Category:", "category_text"), ("  Parameter:", "parameter_text"),
        ("  Generating Proceess:", "process_text"), ("  Forecast Time:", "ft_value"), ("  Forecast Time Unit:", unit),
        ("  1st Fixed Surface Type:", "surf1_text"), ("  1st Scale Factor:", byte("surf1_scale", -127)), ("  1st Scaled Value:", byte("surf1_value", -2147483647)),
        ("  2nd Fixed Surface Type:", "surf2_text"), ("  2nd Scale Factor:", byte("surf2_scale", -127)), ("  2nd Scaled Value:", byte("surf2_value", -2147483647)),
        ("Data Representation:", "repr_text"), ("  Number of represented values:", "num_encoded"),
    )
    block = F.concat(*[F.concat(F.lit(f"{name:<40}"), text(c), F.lit("\n")) for name, c in rows])
    index = F.concat(F.col("msg").cast("string"), F.lit("."), F.col("sub").cast("string"))
    return t.select(*R.KEYS, F.concat(index, F.lit("\n"), block).alias("text"))


def message_infos(layers: DataFrame, table: DataFrame) -> DataFrame:
    """(path, msg, sub, text): a block of lines for each message, from its first submessage."""
    t = layers.where("sub = 0")
    for tbl, code, name in (("0.0", "discipline", "a"), ("C11", "centre", "b"), ("C00", "master_ver", "c"), ("1.1", "local_ver", "d"), ("1.2", "ref_significance", "e"), ("1.3", "prod_status", "f"), ("1.4", "data_type", "g")):
        t = codes.described(t, table, tbl, code, name)
    version = lambda v, c: F.concat(F.col(v).cast("string"), F.lit(" ("), F.col(c), F.lit(")"))
    rows = (
        ("Discipline:", "a"), ("Total Length:", "total_length"), ("Originating/generating centre:", "b"), ("Originating/generating sub-centre:", "subcentre"),
        ("GRIB Master Tables Version Number:", version("master_ver", "c")), ("GRIB Local Tables Version Number:", version("local_ver", "d")), ("Significance of Reference Time:", "e"),
        ("Reference time of data:", "ref_text"), ("Production status of processed data:", "f"), ("Type of processed data:", "g"),
    )
    block = F.concat(*[F.concat(F.lit(f"    {name:<40}"), text(c), F.lit("\n")) for name, c in rows])
    return t.select(*R.KEYS, F.concat(F.lit("Message "), F.col("msg").cast("string"), F.lit("\n\n"), block, F.lit("\n")).alias("text"))


def section_map(sections: DataFrame) -> DataFrame:
    """(path, pos, text): where sections begin and end."""
    hexed = lambda c: F.lpad(F.lower(F.hex(c)), 16, "0")
    line = F.concat(right(F.col("pos").cast("string"), 5), F.lit(" │ "), hexed(F.col("offset")), F.lit(" - "), hexed(F.col("offset") + F.col("size")), F.lit(" │ Section "), F.col("num").cast("string"))
    return sections.where("num is not null").select("path", "pos", line.alias("text"))


def submessage_map(sections: DataFrame) -> DataFrame:
    """(path, msg, sub, text): the sections and templates of each submessage."""
    from pyspark.sql import Window

    w = Window.partitionBy("path", "msg").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    tmpl = lambda k: F.last(F.when(F.col("num") == k, F.col("template_num")), ignorenulls=True).over(w)
    numbers = sections.where("num is not null").withColumns({f"t{k}": tmpl(k) for k in (3, 4, 5)}).where("num = 7").select("path", "msg", F.col("pos").alias("s7"), "t3", "t4", "t5")
    t = R.submessages(sections, payloads=False).join(numbers, ["path", "msg", "s7"])
    place = lambda k: right(F.coalesce(F.col(f"s{k}").cast("string"), F.lit("-")), 5)
    template = lambda k: left(F.coalesce(F.concat(F.lit(f"{k}."), F.col(f"t{k}").cast("string")), F.lit("-")), 7)
    index = F.concat(F.col("msg").cast("string"), F.lit("."), F.col("sub").cast("string"))
    line = F.concat_ws(" ", F.concat(right(index, 8), F.lit(" │")), *[place(k) for k in range(2, 8)], F.lit("│"), *[template(k) for k in (3, 4, 5)])
    return t.select(*R.KEYS, line.alias("text"))


def template_list(sections: DataFrame, table: DataFrame) -> DataFrame:
    """(num, template_num, text): which templates occur, with their texts."""
    part = table.where(F.col("tbl").isin("3.1", "4.0", "5.0")).select(F.substring("tbl", 1, 1).cast("short").alias("num"), F.col("code").alias("template_num"), "description")
    t = R.templates(sections).join(part, ["num", "template_num"], "left")
    name = F.concat(F.col("num").cast("string"), F.lit("."), F.col("template_num").cast("string"))
    return t.select("num", "template_num", F.concat(left(name, 8), F.lit(" - "), F.coalesce("description", codes.missing_text(F.col("template_num")))).alias("text")).orderBy("num", "template_num")


def point_lines(points: DataFrame, ties: str = "even") -> DataFrame:
    """(path, msg, sub, pt, text): points as lines of latitude, longitude and value (B1); NaN where the grid isn't known.

    ``ties``: values half way between two shortest texts, see ``shortest``.
    """
    fixed = lambda c: F.when(F.isnan(c) | c.isNull(), "NaN").otherwise(F.format_string("%.6f", c.cast("double")))
    value = F.coalesce(shortest_text(F.col("value"), ties), F.lit("NaN"))
    line = F.concat(right(fixed(F.col("lat")), 10), F.lit(" "), right(fixed(F.col("lon")), 11), F.lit(" "), right(value, 9))
    return points.select(*R.KEYS, "pt", line.alias("text"))


POINT_HEADER = "  Latitude   Longitude     Value"


#: Colours of a dump's parts.
YELLOW_BOLD, RED, GREEN, BOLD, CYAN, MAGENTA_BOLD, DIM, RESET = "\x1b[33m\x1b[1m", "\x1b[31m", "\x1b[32m", "\x1b[1m", "\x1b[36m", "\x1b[35m\x1b[1m", "\x1b[2m", "\x1b[0m"
DUMPED = re.compile(r"([0-9]+(?:-[0-9]+)?)(\s+\S+\s+)(=)(\s+.+?)((?:\s+//.+)?)")


def colorized(line: str) -> str:
    """A line of a dump with colours for terminals (B13): octets, name, sign, value and description; headings; errors."""
    if line.startswith("#"):
        return f"{YELLOW_BOLD}{line}{RESET}"
    if line.startswith("error:"):
        return f"{RED}{line}{RESET}"
    found = DUMPED.fullmatch(line)
    return "".join(f"{style}{part}{RESET}" for style, part in zip((GREEN, BOLD, CYAN, MAGENTA_BOLD, DIM), found.groups(), strict=True)) if found else line
