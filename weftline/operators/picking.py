"""Files for segments, each file once: the segment's own one, else the next that is free."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Kinds of a group's rows, in their order.
_FILE, _INDEX, _SEGMENT = range(3)


def pick_exclusive(segments: DataFrame, files: DataFrame, by: list[str], *, index: str, order: list[str], file_index: str, file_id: str, file_order: list[str]) -> DataFrame:
    """The rows of ``segments`` with ``picked`` (an id of ``files``) and ``how``: direct, next or missing.

    Segments choose in ``order``. Where every segment of a group has a file of
    its index (the first in ``file_order`` of those with the index), a segment
    takes that one if it is free; otherwise, and in all other groups, the
    first free one in ``file_order``. Segments behind the last free file get
    null and ``missing``; :func:`require_picked` makes that an error.

    A group is a stream of rows in one task: its files, the indexes of its
    segments, and the segments, each of which goes out as it comes. Only the
    files of one group are kept. Null indexes match nothing.
    """
    clash = {"picked", "how"} & set(segments.columns)
    if clash:
        raise ValueError(f"segments have columns of the result's names: {sorted(clash)}")
    keys = [f"_by_{c}" for c in by]
    placed = [f"_f_{c}" for c in file_order]
    ordered = [f"_s_{c}" for c in order]
    f = files.select(*[F.col(c).alias(k) for c, k in zip(by, keys, strict=True)], F.lit(_FILE).alias("_kind"), F.col(file_index).alias("_index"), F.col(file_id).alias("_id"), *[F.col(c).alias(k) for c, k in zip(file_order, placed, strict=True)])
    s = segments.select(*[F.col(c).alias(k) for c, k in zip(by, keys, strict=True)], F.col(index).alias("_index"), *[F.col(c).alias(k) for c, k in zip(order, ordered, strict=True)], F.struct(*segments.columns).alias("_row"))
    both = f.unionByName(s.drop("_row", *ordered).withColumn("_kind", F.lit(_INDEX)), allowMissingColumns=True).unionByName(s.withColumn("_kind", F.lit(_SEGMENT)), allowMissingColumns=True)
    # the window deals groups to tasks and puts each in order, which is the order in which its rows are read
    at = F.row_number().over(Window.partitionBy(*keys).orderBy("_kind", *[F.col(c).asc_nulls_last() for c in (*placed, *ordered)]))
    schema = T.StructType([*segments.schema.fields, T.StructField("picked", files.schema[file_id].dataType), T.StructField("how", T.StringType())])
    return both.select("_kind", "_index", "_id", "_row", at.alias("_at")).mapInArrow(_walk, schema)


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Picks for groups one after the other; place 1 begins a group."""
    ids, own, used, direct, at, last = [], {}, [], True, 0, 0
    for batch in batches:
        picked, how = [], []
        columns = [batch.column(batch.schema.get_field_index(c)) for c in ("_kind", "_index", "_id", "_at")]
        for kind, i, file, place in zip(*(c.to_pylist() for c in columns), strict=True):
            if place == 1:
                ids, own, used, direct, at = [], {}, [], True, 0
            elif place != last + 1:
                raise AssertionError("rows of a group are not in order")
            last = place
            if kind == _FILE:
                if i is not None:
                    own.setdefault(i, len(ids))
                ids.append(file)
                used.append(False)
                continue
            if kind == _INDEX:
                direct = direct and i in own
                continue
            if direct and not used[own[i]]:
                used[own[i]] = True
                picked.append(ids[own[i]])
                how.append("direct")
                continue
            while at < len(ids) and used[at]:
                at += 1
            if at < len(ids):
                used[at] = True
                picked.append(ids[at])
                how.append("next")
            else:
                picked.append(None)
                how.append("missing")
        if picked:
            rows = batch.column(batch.schema.get_field_index("_row")).filter(pc.equal(columns[0], _SEGMENT))
            yield pa.RecordBatch.from_arrays([*rows.flatten(), pa.array(picked, columns[2].type), pa.array(how, pa.string())], names=[*(x.name for x in rows.type), "picked", "how"])


def require_picked(picked: DataFrame, index: str) -> DataFrame:
    """The rows, or an error that names a segment without a file."""
    message = F.concat(F.lit("missing file for segment "), F.coalesce(F.col(index).cast("string"), F.lit("null")))
    return picked.withColumn("picked", F.when(F.col("how") == "missing", F.raise_error(message).cast(dict(picked.dtypes)["picked"])).otherwise(F.col("picked")))
