"""A tensor of features in one .npy file, dates x features x entities, as a Spark source: partitions by ranges of entities, only the features asked for are read.

    spark.dataSource.register(TensorSource)
    spark.read.format("tensor").option("path", ...).option("names", "a,b,c").option("features", "a,c").load()

The file must lie where every executor can open it. Columns: entity (its place), qidx (the date's place), the features in the order asked for; a NaN is null.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import DoubleType, IntegerType, LongType, StructField, StructType


class Entities(InputPartition):
    def __init__(self, first: int, end: int):
        self.first, self.end = first, end


class TensorSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tensor"

    def wanted(self) -> tuple[list[str], list[str]]:
        split = lambda text: [x.strip() for x in text.split(",") if x.strip()]
        names = split(self.options["names"])
        features = split(self.options.get("features") or self.options["names"])
        if missing := [f for f in features if f not in names]:
            raise KeyError(f"no such feature: {', '.join(missing)}")
        return names, features

    def schema(self) -> StructType:
        return StructType([StructField("entity", LongType()), StructField("qidx", IntegerType()), *[StructField(f, DoubleType()) for f in self.wanted()[1]]])

    def reader(self, schema: StructType) -> DataSourceReader:
        names, features = self.wanted()
        return TensorReader(self.options["path"], names, features, int(self.options.get("rows", 1 << 20)))


class TensorReader(DataSourceReader):
    def __init__(self, path: str, names: list[str], features: list[str], rows: int):
        self.path, self.names, self.features, self.rows = path, names, features, rows
        shape = np.load(path, mmap_mode="r").shape
        if len(shape) != 3 or shape[1] != len(names):
            raise ValueError(f"a tensor of dates x {len(names)} features x entities is wanted, not {shape}")
        self.dates, _, self.entities = shape

    def partitions(self) -> list[Entities]:
        """Ranges of entities of `rows` cells at most."""
        step = max(1, self.rows // max(1, self.dates))
        return [Entities(i, min(i + step, self.entities)) for i in range(0, self.entities, step)] or [Entities(0, 0)]

    def read(self, part: Entities):
        """One batch a date. The file is mapped, so of a feature that is not asked for nothing is read."""
        cube = np.load(self.path, mmap_mode="r")
        at = [self.names.index(f) for f in self.features]
        n = part.end - part.first
        for date in range(self.dates if n else 0):
            columns = [pa.array(np.arange(part.first, part.end)), pa.array(np.full(n, date, np.int32))]
            for k in at:
                v = np.asarray(cube[date, k, part.first : part.end], np.float64)
                columns.append(pa.array(v, mask=np.isnan(v)))
            yield pa.RecordBatch.from_arrays(columns, ["entity", "qidx", *self.features])