"""Matrix files (.npy) as tables, read by ranges of rows, and rows of other tables that stand beside them by number."""

from __future__ import annotations

import ast
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Bytes of a matrix that one task reads, about; rows sent on at once.
PART_BYTES, BATCH_ROWS = 64_000_000, 10_000
SCHEMA = "row bigint, values array<double>"


def _opened(path: str) -> pa.NativeFile:
    """A file of any store that has an address, or of the local one."""
    from pyarrow import fs

    store, inner = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
    return store.open_input_file(inner)


def header(path: str) -> tuple[np.dtype, int, int, int]:
    """Type, rows, columns and where the data begin.  A vector is one column; other shapes, column order and objects are errors."""
    with _opened(path) as f:
        start = f.read(12)
        if start[:6] != b"\x93NUMPY":
            raise ValueError(f"{path} is no matrix file")
        wide = start[6] > 1
        size, begin = (int.from_bytes(start[8:12], "little"), 12) if wide else (int.from_bytes(start[8:10], "little"), 10)
        f.seek(begin)
        told = ast.literal_eval(f.read(size).decode("latin1"))
    kind, shape = np.dtype(told["descr"]), told["shape"]
    if len(shape) not in (1, 2) or told["fortran_order"] and min(shape) > 1 or kind.kind not in "fiub":
        raise ValueError(f"{path}: a matrix of numbers in row order is needed, not {told}")
    return kind, shape[0], shape[1] if len(shape) == 2 else 1, begin + size


class MatrixSource(DataSource):
    """`spark.read.format("matrix").load(path)`: row (from 0) and values of each row; option `part_bytes` for the size of a part."""

    @classmethod
    def name(cls) -> str:
        return "matrix"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"], int(self.options.get("part_bytes", PART_BYTES)))


class _Rows(InputPartition):
    def __init__(self, first: int, stop: int):
        self.first, self.stop = first, stop


class _Reader(DataSourceReader):
    def __init__(self, path: str, part_bytes: int):
        self.path = path
        self.kind, self.rows, self.columns, self.begin = header(path)
        self.each = max(1, part_bytes // max(1, self.kind.itemsize * self.columns))

    def partitions(self) -> list[InputPartition]:
        return [_Rows(i, min(i + self.each, self.rows)) for i in range(0, self.rows, self.each)] or [_Rows(0, 0)]

    def read(self, partition: _Rows) -> Iterator[pa.RecordBatch]:
        width = self.kind.itemsize * self.columns
        with _opened(self.path) as f:
            f.seek(self.begin + partition.first * width)
            for first in range(partition.first, partition.stop, BATCH_ROWS):
                n = min(BATCH_ROWS, partition.stop - first)
                data = f.read(n * width)
                if len(data) < n * width:
                    raise ValueError(f"{self.path} ends early")
                x = np.frombuffer(data, self.kind).astype(np.float64)
                at = np.arange(n + 1, dtype=np.int32) * self.columns
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(first, first + n)), pa.ListArray.from_arrays(pa.array(at), pa.array(x))], names=["row", "values"])


def matrix(spark: SparkSession, path: str, part_bytes: int = PART_BYTES) -> DataFrame:
    """row and values of a matrix file that the driver and all executors can open."""
    spark.dataSource.register(MatrixSource)
    return spark.read.format("matrix").option("part_bytes", str(part_bytes)).load(path)


def numbered(lines: DataFrame, name: str = "row") -> DataFrame:
    """`lines` as a scan gives them, with their number from 0.

    Only for a table that comes straight from files: its rows then lie in the same partitions, in the same order, each
    time.  Counts of partitions are summed up, so that no row moves.
    """
    placed = lines.withColumn("_id", F.monotonically_increasing_id())
    part, inside = F.shiftright("_id", 33), F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    counts = placed.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    # One row a partition.
    before = counts.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    return placed.withColumn("_part", part).join(F.broadcast(before), "_part").withColumn(name, F.col("_before") + inside).drop("_part", "_before", "_id")


def aligned(lines: DataFrame, values: DataFrame) -> DataFrame:
    """`lines` (with row) and `values` (row, values) side by side; an error where one has rows that the other lacks."""
    left, right = lines.count(), values.count()
    if left != right:
        raise ValueError(f"{left} lines stand beside a matrix of {right} rows")
    return lines.join(values, "row")
