"""Table functions for SQL: steps of a data flow over all items of a group, in order.

    register(spark)
    SELECT * FROM batch_items(TABLE(t) PARTITION BY (g) ORDER BY (n), 3)
    SELECT * FROM harvest_items(TABLE(SELECT id, body FROM t), 'text')
"""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.functions import AnalyzeArgument, AnalyzeResult, SkipRestOfInputTableException, arrow_udtf, udtf
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

_ADDED = ("batch", "place", "carried")


def _constant(arg: AnalyzeArgument, name: str, kind: type):
    if arg.isTable or not isinstance(arg.value, kind):
        raise ValueError(f"{name} must be a constant")
    return arg.value


@udtf
class BatchItems:
    """A table's rows in batches by the sum of a size column: (columns of the table, batch, place, carried).

    Rows are taken in order; a batch is full when its sizes reach ``limit``,
    and what is above it is carried into the next one, which is full so much
    sooner. ``carried`` is what the row's batch began with. Without a size
    column every row counts as one. A null or negative size counts as zero.
    """

    def __init__(self):
        self.batch = self.place = self.sum = self.carried = 0

    @staticmethod
    def analyze(items: AnalyzeArgument, limit: AnalyzeArgument, size: AnalyzeArgument | None = None) -> AnalyzeResult:
        if not items.isTable:
            raise ValueError("the first argument must be a table")
        if _constant(limit, "limit", int) < 1:
            raise ValueError("limit must be positive")
        names = [f.name for f in items.dataType.fields]
        if size is not None and _constant(size, "size", str) not in names:
            raise ValueError(f"no such column: {size.value}")
        if clash := [n for n in names if n.lower() in _ADDED]:
            raise ValueError(f"the table has columns of the result's names: {clash}")
        return AnalyzeResult(StructType([*items.dataType.fields, *(StructField(n, LongType()) for n in _ADDED)]))

    def eval(self, row, limit, size=None):
        yield (*row, self.batch, self.place, self.carried)
        self.place += 1
        self.sum += 1 if size is None else max(0, int(row[size] or 0))
        if self.carried + self.sum >= limit:
            self.carried = (self.carried + self.sum) % limit
            self.batch, self.place, self.sum = self.batch + 1, 0, 0


@arrow_udtf(returnType="key long, n long, batch long, place long, carried long")
class BatchGroups:
    """As ``batch_items`` for a table of (key, n, size), many rows a call: (key, n, batch, place, carried).

    The count begins again where the key changes. The table is dealt by the
    key and sorted by key and n before, and has no PARTITION BY, which makes a call of each group.
    """

    def __init__(self):
        self.key, self.state = None, (0, 0, 0, 0)

    def eval(self, items: pa.RecordBatch, limit: pa.Array):
        least = limit[0].as_py() if len(limit) else 1
        if least is None or least < 1:
            raise ValueError("limit must be positive")
        last, (batch, place, total, carried) = self.key, self.state
        batches, places, carries = [], [], []
        for key, size in zip(items.column(0).to_pylist(), items.column(2).to_pylist(), strict=True):
            if key != last:
                last, batch, place, total, carried = key, 0, 0, 0, 0
            batches.append(batch)
            places.append(place)
            carries.append(carried)
            place += 1
            total += max(0, size or 0)
            if carried + total >= least:
                carried, batch, place, total = (carried + total) % least, batch + 1, 0, 0
        self.key, self.state = last, (batch, place, total, carried)
        added = [pa.array(x, pa.int64()) for x in (batches, places, carries)]
        yield pa.RecordBatch.from_arrays([items.column(0), items.column(1), *added], names=["key", "n", *_ADDED])


@udtf
class FirstItems:
    """The first ``n`` rows of each partition of a table; the rest of a partition is not read on."""

    def __init__(self):
        self.seen = 0

    @staticmethod
    def analyze(items: AnalyzeArgument, n: AnalyzeArgument) -> AnalyzeResult:
        if not items.isTable or _constant(n, "n", int) < 0:
            raise ValueError("a table and a number that is not negative are needed")
        return AnalyzeResult(items.dataType)

    def eval(self, row, n):
        if self.seen >= n:
            raise SkipRestOfInputTableException("enough")
        self.seen += 1
        yield tuple(row)


@udtf
class HarvestItems:
    """Every string under a key, at any depth of a JSON column: (columns of the table but the body, pos, path, value).

    The body is the table's last column. ``pos`` counts in document order
    from 0; ``path`` is how the value is reached, as in ``$.a[2].key``. Rows whose body is
    null or no JSON give none.
    """

    @staticmethod
    def analyze(items: AnalyzeArgument, key: AnalyzeArgument) -> AnalyzeResult:
        if not items.isTable or not isinstance(items.dataType.fields[-1].dataType, StringType):
            raise ValueError("a table whose last column is a text is needed")
        _constant(key, "key", str)
        return AnalyzeResult(StructType([*items.dataType.fields[:-1], StructField("pos", IntegerType()), StructField("path", StringType()), StructField("value", StringType())]))

    def eval(self, row, key):
        *own, body = row
        try:
            todo = [("$", None, json.loads(body))] if body is not None else []
        except ValueError:
            return
        pos = 0
        while todo:
            path, name, x = todo.pop()
            if isinstance(x, list):
                todo += [(f"{path}[{i}]", None, v) for i, v in reversed(list(enumerate(x)))]
            elif isinstance(x, dict):
                todo += [(f"{path}.{k}", k, v) for k, v in reversed(x.items())]
            elif isinstance(x, str) and name == key:
                yield (*own, pos, path, x)
                pos += 1


FUNCTIONS = {"batch_items": BatchItems, "batch_groups": BatchGroups, "first_items": FirstItems, "harvest_items": HarvestItems}


def register(spark: SparkSession) -> None:
    for name, f in FUNCTIONS.items():
        spark.udtf.register(name, f)
