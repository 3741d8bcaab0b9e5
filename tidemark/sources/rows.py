"""A row sink with open, process and close per partition."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame


class RowWriter(Protocol):
    def open(self, partition: int, attempt: int) -> bool: ...
    def process(self, row: dict) -> None: ...
    def close(self, error: Exception | None) -> None: ...


def write_rows(df: DataFrame, make: Callable[[], RowWriter]) -> DataFrame:
    """Send every row to a writer; returns (partition, rows) once the partition is closed.

    A task may run again after a loss, so writers must overwrite what an earlier attempt wrote.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        writer, rows, error = make(), 0, None
        wanted = writer.open(context.partitionId(), context.attemptNumber())
        try:
            for batch in batches:
                for row in batch.to_pylist() if wanted else ():
                    writer.process(row)
                    rows += 1
        except Exception as e:
            error = e
            raise
        finally:
            writer.close(error)
        yield pa.RecordBatch.from_pydict({
            "partition": pa.array([context.partitionId()], pa.int32()), "rows": pa.array([rows], pa.int64())})

    return df.mapInArrow(run, "partition int, rows bigint")


class TextFileWriter:
    """Writes ``key=value`` lines to one file per partition of a shared folder (any URI)."""

    def __init__(self, folder: str):
        self.folder = folder

    def open(self, partition: int, attempt: int) -> bool:
        system, path = fs.FileSystem.from_uri(self.folder)
        system.create_dir(path)
        self.out = system.open_output_stream(f"{path}/part-{partition:05d}.txt")
        return True

    def process(self, row: dict) -> None:
        self.out.write((",".join(f"{k}={v}" for k, v in row.items()) + "\n").encode())

    def close(self, error: Exception | None) -> None:
        self.out.close()
