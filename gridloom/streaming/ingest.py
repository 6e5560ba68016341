"""Incremental reading: new files of a folder become sections, submessages or layers as they arrive.

The steps are those of the batch relations. Assembling submessages needs the sections of one file together, and a file
arrives whole in one micro-batch, so that it is done in ``foreachBatch`` and needs no state; sections alone stream as
they are. Windows over valid time are Spark's own (``withWatermark`` and ``window``) on what is written out.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators import relations as R
from ..ship import ship
from ..sources import grib


def new_files(spark: SparkSession, folder: str, per_batch: int | None = None) -> DataFrame:
    schema = "path string, modificationTime timestamp, length long, content binary"
    reader = spark.readStream.format("binaryFile").schema(schema)
    return (reader.option("maxFilesPerTrigger", per_batch) if per_batch else reader).load(folder)


def section_stream(spark: SparkSession, folder: str, payload: str = "meta", per_batch: int | None = None) -> DataFrame:
    """``sections`` as a stream; a file that can't be read gives a row with ``error``."""
    ship(spark)
    return grib.scan_binary(new_files(spark, folder, per_batch), payload, "PERMISSIVE")


def ingest_layers(spark: SparkSession, folder: str, sink: Callable[[DataFrame, int], None], checkpoint: str, per_batch: int | None = None, **trigger) -> StreamingQuery:
    """Hand the layers of each batch of new files to ``sink(layers, batch_id)``, which should be idempotent by batch_id."""

    def step(batch: DataFrame, number: int) -> None:
        sink(R.layers(R.submessages(batch.where("error is null"))).drop(*[f"p{k}" for k in range(8)]), number)

    stream = section_stream(spark, folder, "meta", per_batch).writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    return stream.trigger(**(trigger or {"availableNow": True})).start()
