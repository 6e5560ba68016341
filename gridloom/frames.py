"""The front door: a set of files as relations.

>>> g = read(spark, "/data/*.grib2")
>>> g.layers().where("ft_unit = 1 and ft_value = 6")
>>> g.points("0.3")
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import codes
from .operators import relations as R
from .plans import reports
from .ship import ship
from .sources import grib


class Grib:
    """Relations over a DataFrame (path, content), or (path) of files that tasks open. Nothing is read until an action.

    Files that are opened are read by seeking: what isn't asked for stays where it is, and the data of fields are read once
    the fields have been chosen.
    """

    def __init__(self, files: DataFrame, mode: str = "FAILFAST", code_table: DataFrame | None = None, decoders: dict | None = None, grids: dict | None = None):
        """decoders, grids: functions by template number, for representations and grids beyond the built-in ones."""
        ship(files.sparkSession)
        self.spark, self.files, self.mode, self._codes = files.sparkSession, files, mode, code_table
        self.decoders, self.grids = decoders, grids

    @cached_property
    def code_table(self) -> DataFrame:
        return self._codes if self._codes is not None else codes.code_table(self.spark)

    def sections(self, payload: str = "none") -> DataFrame:
        return grib.scan_files(self.files, payload, self.mode)

    def order_errors(self) -> DataFrame:
        return R.order_errors(self.sections())

    def submessages(self, payload: str = "meta") -> DataFrame:
        subs = grib.scan_submessages(self.files, payload, self.mode)
        return subs if payload != "none" else subs.select(*R.KEYS, *[f"s{k}" for k in range(9)])

    def layers(self) -> DataFrame:
        """One row for each layer with its fields; the octets of sections stay behind."""
        out = R.layers(self.submessages())
        return out.drop(*[f"p{k}" for k in range(8)])

    def templates(self) -> DataFrame:
        return R.templates(self.sections())

    def _with_data(self, index: str | None, where: str | None) -> DataFrame:
        opened = "content" not in self.files.columns
        subs = self.submessages("meta" if opened else "all")
        if index is not None:
            subs = R.at_index(subs, index)
        subs = R.layers(subs).where(where).select(*subs.columns) if where else subs
        return grib.with_data(subs) if opened else subs

    def values(self, index: str | None = None, where: str | None = None) -> DataFrame:
        """(path, msg, sub, values): one array for each field; ``where`` is a predicate on ``layers``."""
        return R.fields(self._with_data(index, where), self.mode, self.decoders).select(*R.KEYS, "values")

    def points(self, index: str | None = None, where: str | None = None, normalize: bool = True) -> DataFrame:
        return R.points(self._with_data(index, where), self.mode, normalize, decoders=self.decoders, more_grids=self.grids)

    def count(self) -> int:
        return self.submessages("none").count()

    def list(self) -> DataFrame:
        return reports.layer_list(R.layers(self.submessages()), self.code_table)

    def describe(self) -> DataFrame:
        return reports.layer_descriptions(R.layers(self.submessages()), self.code_table)

    def info(self) -> DataFrame:
        return reports.message_infos(R.layers(self.submessages()), self.code_table)

    def inspect(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        """Sections, submessages and templates, as lines of text."""
        s = self.sections()
        return reports.section_map(s), reports.submessage_map(s), reports.template_list(s, self.code_table)

    def dump(self, index: str | None = None) -> DataFrame:
        subs = self.submessages()
        return R.dumped(R.at_index(subs, index) if index else subs)


def read(spark: SparkSession, paths: str | list[str], mode: str = "FAILFAST", code_table: DataFrame | None = None) -> Grib:
    """Files by path, folder or glob. Spark lists them; tasks open them and seek."""
    return Grib(spark.read.format("binaryFile").load(paths).select("path"), mode, code_table)


def read_whole(spark: SparkSession, paths: str | list[str], mode: str = "FAILFAST", code_table: DataFrame | None = None) -> Grib:
    """The same of stores that only Spark can open: files are read whole, up to 2 GB each."""
    return Grib(spark.read.format("binaryFile").load(paths).select("path", "content"), mode, code_table)


def from_bytes(spark: SparkSession, data: bytes, name: str = "bytes", mode: str = "FAILFAST") -> Grib:
    return Grib(spark.createDataFrame([(name, bytearray(data))], "path string, content binary"), mode)


def from_column(rows: DataFrame, path: str, content: str, mode: str = "FAILFAST") -> Grib:
    """Relations over a binary column of any DataFrame."""
    return Grib(rows.select(F.col(path).alias("path"), F.col(content).alias("content")), mode)
