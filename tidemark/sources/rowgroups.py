"""A custom source: parquet row groups as partitions, with column pruning and pushed filters."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.dataset as ds
import pyarrow.parquet as pq
from pyspark.sql.datasource import (
    DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition,
    LessThan, LessThanOrEqual,
)

_COMPARE = {
    EqualTo: pc.equal, GreaterThan: pc.greater, GreaterThanOrEqual: pc.greater_equal,
    LessThan: pc.less, LessThanOrEqual: pc.less_equal,
}


class RowGroup(InputPartition):
    def __init__(self, path: str, group: int):
        super().__init__((path, group))
        self.path, self.group = path, group


class RowGroupReader(DataSourceReader):
    def __init__(self, path: str, columns: list[str]):
        self.path, self.columns = path, columns
        self.filters: list[tuple[type, str, object]] = []

    def pushFilters(self, filters: list[Filter]):
        """Take comparisons with a constant; give the others back to Spark."""
        for f in filters:
            if type(f) in _COMPARE and len(f.attribute) == 1:
                self.filters.append((type(f), f.attribute[0], f.value))
            else:
                yield f

    def partitions(self):
        found = [
            RowGroup(piece.path, g)
            for piece in ds.dataset(self.path, format="parquet").get_fragments()
            for g in range(piece.metadata.num_row_groups)
        ]
        return found

    def read(self, partition: RowGroup) -> Iterator[pa.RecordBatch]:
        file = pq.ParquetFile(partition.path)
        wanted = list(dict.fromkeys([*self.columns, *[c for _, c, _ in self.filters]]))
        for batch in file.iter_batches(row_groups=[partition.group], columns=wanted):
            for kind, column, value in self.filters:
                batch = batch.filter(_COMPARE[kind](batch.column(column), value))
            yield batch.select(self.columns)


class RowGroupSource(DataSource):
    """Options: ``path``, and ``columns`` (comma list) to read only those."""

    @classmethod
    def name(cls) -> str:
        return "rowgroups"

    def _columns(self) -> list[str]:
        if "columns" in self.options:
            return self.options["columns"].split(",")
        return ds.dataset(self.options["path"], format="parquet").schema.names

    def schema(self):
        from pyspark.sql.pandas.types import from_arrow_schema

        stored = ds.dataset(self.options["path"], format="parquet").schema
        return from_arrow_schema(pa.schema([stored.field(c) for c in self._columns()]), prefer_timestamp_ntz=True)

    def reader(self, schema) -> RowGroupReader:
        return RowGroupReader(self.options["path"], [f.name for f in schema.fields])
