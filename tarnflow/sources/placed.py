"""A sink of pieces of text at known places of one file: tasks write disjoint stretches, and the file takes its name when all are done."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, DataFrameWriter
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from ..session import ship_package


class _Writer(DataSourceArrowWriter):
    def __init__(self, options: dict) -> None:
        self.path, self.part = options["path"], options["part"]

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        with open(self.part, "r+b") as f:
            for b in iterator:
                for place, text in zip(b.column(0), b.column(1), strict=True):
                    f.seek(place.as_py())
                    f.write(text.as_py().encode())
            f.flush()
            os.fsync(f.fileno())
        return WriterCommitMessage()

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        os.replace(self.part, self.path)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        Path(self.part).unlink(missing_ok=True)


class Placed(DataSource):
    @classmethod
    def name(cls) -> str:
        return "placed"

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(dict(self.options))


def write_placed(pieces: DataFrame, path: str, head: bytes) -> None:
    """``head``, then the rows of ``pieces`` (place long, counted from the end of the head; text string)."""
    spark = pieces.sparkSession
    ship_package(spark)
    spark.dataSource.register(Placed)
    part = f"{path}.{uuid.uuid4().hex}.part"
    Path(part).write_bytes(head)
    save_or_clear(pieces.select((F.col("place") + len(head)).alias("place"), "text").write.format("placed").option("part", part), path, part)


def save_or_clear(writer: DataFrameWriter, path: str, part: str) -> None:
    """Save; where a stage before the sink's own fails, the sink is not told to abort, and its unfinished file goes here."""
    try:
        writer.mode("append").save(path)
    except BaseException:
        Path(part).unlink(missing_ok=True)
        raise
