"""Code tables (O): numbers to texts, as a small relation (tbl, discipline, category, code, description).

The texts that come with the package are the common ones; ``read_code_table`` and ``read_common_table`` load the
published CSV files in full, by the same rules for reserved and missing entries. A code without an entry reads
``code 'N' is not implemented``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "tbl string, discipline int, category int, code int, description string"

#: Texts by table; a key (discipline) or (discipline, category) picks the sub-table.
TEXTS: dict[tuple, dict[int, str]] = {
    ("0.0",): {0: "Meteorological products", 1: "Hydrological products", 2: "Land surface products", 3: "Satellite remote sensing products", 4: "Space weather products", 10: "Oceanographic products", 20: "Health and socioeconomic impacts"},
    ("1.1",): {0: "Local tables not used. Only table entries and templates from the current master table are valid"} | dict.fromkeys(range(1, 255), "Number of local tables version used"),
    ("1.2",): {0: "Analysis", 1: "Start of forecast", 2: "Verifying time of forecast", 3: "Observation time", 4: "Local time", 5: "Simulation start"},
    ("1.3",): {0: "Operational products", 1: "Operational test products", 2: "Research products", 3: "Re-analysis products", 4: "THORPEX Interactive Grand Global Ensemble (TIGGE)", 5: "THORPEX Interactive Grand Global Ensemble test (TIGGE)"},
    ("1.4",): {0: "Analysis products", 1: "Forecast products", 2: "Analysis and forecast products", 3: "Control forecast products", 4: "Perturbed forecast products", 5: "Control and perturbed forecast products", 6: "Processed satellite observations", 7: "Processed radar observations", 8: "Event probability"},
    ("3.1",): {
        0: "Latitude/longitude", 1: "Rotated latitude/longitude", 2: "Stretched latitude/longitude", 3: "Stretched and rotated latitude/longitude", 10: "Mercator", 20: "Polar stereographic projection",
        30: "Lambert conformal", 40: "Gaussian latitude/longitude", 41: "Rotated Gaussian latitude/longitude", 42: "Stretched Gaussian latitude/longitude", 43: "Stretched and rotated Gaussian latitude/longitude", 101: "General unstructured grid",
    },
    ("4.0",): {
        0: "Analysis or forecast at a horizontal level or in a horizontal layer at a point in time",
        1: "Individual ensemble forecast, control and perturbed, at a horizontal level or in a horizontal layer at a point in time",
        2: "Derived forecasts based on all ensemble members at a horizontal level or in a horizontal layer at a point in time",
        5: "Probability forecasts at a horizontal level or in a horizontal layer at a point in time",
        6: "Percentile forecasts at a horizontal level or in a horizontal layer at a point in time",
        8: "Average, accumulation, extreme values or other statistically processed values at a horizontal level or in a horizontal layer in a continuous or non-continuous time interval",
    },
    ("4.1", 0): {0: "Temperature", 1: "Moisture", 2: "Momentum", 3: "Mass", 4: "Short-wave radiation", 5: "Long-wave radiation", 6: "Cloud", 7: "Thermodynamic stability indices", 13: "Aerosols", 14: "Trace gases", 15: "Radar", 18: "Nuclear/radiology", 19: "Physical atmospheric properties"},
    ("4.1", 1): {0: "Hydrology basic products", 1: "Hydrology probabilities", 2: "Inland water and sediment properties"},
    ("4.1", 2): {0: "Vegetation/biomass", 3: "Soil products", 4: "Fire weather"},
    ("4.1", 10): {0: "Waves", 1: "Currents", 2: "Ice", 3: "Surface properties", 4: "Subsurface properties"},
    ("4.2", 0, 0): {0: "Temperature", 1: "Virtual temperature", 2: "Potential temperature", 4: "Maximum temperature", 5: "Minimum temperature", 6: "Dewpoint temperature"},
    ("4.2", 0, 1): {0: "Specific humidity", 1: "Relative humidity", 2: "Humidity mixing ratio", 3: "Precipitable water", 7: "Precipitation rate", 8: "Total precipitation", 52: "Total precipitation rate"},
    ("4.2", 0, 2): {0: "Wind direction (from which blowing)", 1: "Wind speed", 2: "u-component of wind", 3: "v-component of wind", 22: "Wind speed (gust)"},
    ("4.2", 0, 3): {0: "Pressure", 1: "Pressure reduced to MSL", 3: "ICAO Standard Atmosphere Reference Height", 4: "Geopotential", 5: "Geopotential height"},
    ("4.2", 0, 6): {0: "Cloud ice", 1: "Total cloud cover", 3: "Low cloud cover", 4: "Medium cloud cover", 5: "High cloud cover"},
    ("4.3",): {0: "Analysis", 1: "Initialization", 2: "Forecast", 3: "Bias corrected forecast", 4: "Ensemble forecast", 5: "Probability forecast", 6: "Forecast error", 7: "Analysis error", 8: "Observation"},
    ("4.4",): {0: "Minute", 1: "Hour", 2: "Day", 3: "Month", 4: "Year", 5: "Decade (10 years)", 6: "Normal (30 years)", 7: "Century (100 years)", 10: "3 hours", 11: "6 hours", 12: "12 hours", 13: "Second"},
    ("4.5",): {1: "Ground or water surface", 2: "Cloud base level", 3: "Level of cloud tops", 7: "Tropopause", 8: "Nominal top of the atmosphere", 100: "Isobaric surface", 101: "Mean sea level", 102: "Specific altitude above mean sea level", 103: "Specified height level above ground", 104: "Sigma level", 105: "Hybrid level", 106: "Depth below land surface"},
    ("5.0",): {
        0: "Grid point data - simple packing", 1: "Matrix value at grid point - simple packing", 2: "Grid point data - complex packing", 3: "Grid point data - complex packing and spatial differencing", 4: "Grid point data - IEEE floating point data",
        40: "Grid point data - JPEG 2000 code stream format", 41: "Grid point data - Portable Network Graphics (PNG)", 42: "Grid point data - CCSDS recommended lossless compression", 50: "Spectral data - simple packing",
        51: "Spherical harmonics data - complex packing", 61: "Grid point data - simple packing with logarithm pre-processing", 200: "Run length packing with level values",
    },
    ("C00",): {5: "4 November 2009"},
    ("C11",): {7: "US National Weather Service - NCEP", 34: "Tokyo (RSMC), Japan Meteorological Agency", 54: "Montreal (RSMC)", 78: "Offenbach (RSMC)", 98: "European Centre for Medium-Range Weather Forecasts (ECMWF) (RSMC)"},
}
#: Entries of the published tables that stand for no text.
EMPTY = ("Future versions", "Reserved", "Reserved for local use", "Reserved for other centres", "Missing", "Missing value", ")")


def code_table(spark: SparkSession) -> DataFrame:
    """The texts that come with the package."""
    rows = [(key[0], *(list(key[1:]) + [None, None])[:2], code, text) for key, texts in TEXTS.items() for code, text in texts.items()]
    return spark.createDataFrame(rows, SCHEMA)


def missing_text(code: Column) -> Column:
    return F.concat(F.lit("code '"), code.cast("string"), F.lit("' is not implemented"))


def described(rows: DataFrame, table: DataFrame, tbl: str, code: str, name: str, discipline: str | None = None, category: str | None = None) -> DataFrame:
    """``rows`` with the text of ``code`` as ``name``, null where the code is. Code tables have some thousand rows at most."""
    keys = {"code": code} | ({"discipline": discipline} if discipline else {}) | ({"category": category} if category else {})
    part = table.where(F.col("tbl") == tbl).select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("description").alias("_text"))
    on = reduce(lambda a, b: a & b, [F.col(v).cast("int") == F.col(f"_{k}") for k, v in keys.items()])
    found = rows.join(part, on, "left")
    return found.withColumn(name, F.when(F.col(code).isNotNull(), F.coalesce("_text", missing_text(F.col(code))))).drop("_text", *[f"_{k}" for k in keys])


def code_range(text: Column) -> Column:
    """Codes of ``7`` or ``4-191``; null where the text is neither."""
    ends = F.regexp_extract(text, "^([0-9]+)(?:-([0-9]+))?$", 1), F.regexp_extract(text, "^([0-9]+)(?:-([0-9]+))?$", 2)
    first, last = F.when(ends[0] != "", ends[0].cast("int")), F.when(ends[1] != "", ends[1].cast("int"))
    return F.when(F.coalesce(last, first) >= first, F.sequence(first, F.coalesce(last, first)))


def entries(rows: DataFrame, strict: bool = False) -> DataFrame:
    """(tbl, discipline, category, code, description) of (.., codes, description).

    strict: a table whose texts leave gaps that no entry covers counts as empty, as some readers have it.
    """
    keys = ["tbl", "discipline", "category"]
    each = rows.withColumn("code", F.explode(code_range(F.col("codes")))).withColumn("_text", ~F.col("description").isin(*EMPTY))
    if strict:
        whole = each.groupBy(*keys).agg(F.collect_set("code").alias("all"), F.max(F.when(F.col("_text"), F.col("code"))).alias("top"))
        whole = whole.where(F.size(F.filter("all", lambda c: c <= F.col("top"))) == F.col("top") + 1)
        each = each.alias("t").join(whole.alias("w"), reduce(lambda a, b: a & b, [F.col(f"t.{k}").eqNullSafe(F.col(f"w.{k}")) for k in keys]), "left_semi")
    return each.where("_text").select(*keys, "code", "description")


def read_code_table(spark: SparkSession, path: str, tbl: str, strict: bool = False) -> DataFrame:
    """A published code table: its sub-title names discipline and category."""
    rows = spark.read.option("header", True).option("quote", '"').option("escape", '"').csv(path)
    title = F.col("SubTitle_en")
    number = lambda form: F.when(F.regexp_extract(title, form, 1) != "", F.regexp_extract(title, form, 1).cast("int"))
    return entries(rows.select(F.lit(tbl).alias("tbl"), number("^Product discipline ([0-9]+)").alias("discipline"), number("parameter category ([0-9]+)").alias("category"), F.col("CodeFlag").alias("codes"), F.col("MeaningParameterDescription_en").alias("description")), strict)


def read_common_table(spark: SparkSession, path: str, tbl: str) -> DataFrame:
    """Common tables: C00 (versions, with the date they hold from) and C11 (centres)."""
    code, text = {"C00": ("GRIB version number", "Effective date"), "C11": ("GRIB2_BUFR4", "OriginatingGeneratingCentre_en")}[tbl]
    rows = spark.read.option("header", True).option("quote", '"').option("escape", '"').csv(path)
    none = F.lit(None).cast("int")
    return entries(rows.select(F.lit(tbl).alias("tbl"), none.alias("discipline"), none.alias("category"), F.col(code).alias("codes"), F.col(text).alias("description")).where("codes is not null"))


def load_parameter_codes(spark: SparkSession, path: str) -> DataFrame:
    """(name, parameter, first_parameter): third-party names of parameters, from a colon-separated table.

    Columns 1, 7 and 8 are discipline, category and number and column 9 the name, which becomes an identifier: ``_`` before
    it and ``_`` for ``-``. Codes that share a name are one parameter, that of the first line.
    """
    cols = F.split("value", ":")
    rows = spark.read.text(path).select(F.monotonically_increasing_id().alias("line"), cols.alias("c")).where(F.size("c") >= 9)
    d, cat, num = (F.col("c")[i].cast("int") for i in (0, 6, 7))
    named = rows.select("line", F.concat(F.lit("_"), F.regexp_replace(F.col("c")[8], "-", "_")).alias("name"), (F.shiftleft(d, 16) + F.shiftleft(cat, 8) + num).alias("parameter"))
    first = named.groupBy("name").agg(F.min_by("parameter", "line").alias("first_parameter"))
    return named.join(first, "name").select("name", "parameter", "first_parameter")
