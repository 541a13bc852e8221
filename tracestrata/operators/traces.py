"""Traces in range partitions: each event's successors, wherever its case is cut.

Rows are laid out in the order of case, time and sequence over partitions of equal
size, so one case may fill many partitions, and a cut may fall between two events of
one instant. All that a partition lacks are the first two rows after its end. Those
few rows, two of each partition, are exchanged; the rest is a shift within the
partition, done on whole Arrow batches.
"""

from __future__ import annotations

import sys
from collections.abc import Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType

from tracestrata.session import materialize

# Tasks carry the functions they run, so executors need no copy of this module.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

AHEAD = 2
_PART = "_part"


def laid_out(rows: DataFrame, keys: Sequence[str], partition_rows: int) -> DataFrame:
    """Stored rows in the order of `keys` over partitions of about `partition_rows`, numbered by `_part`."""
    rows = materialize(rows)  # else sampling the ranges would compute them twice
    parts = max(2, -(-rows.count() // max(1, partition_rows)))
    ranged = rows.repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
    return materialize(ranged.withColumn(_PART, F.spark_partition_id()))


def _first_rows(batches):
    """The first rows of a partition."""
    found: list[pa.RecordBatch] = []
    for batch in batches:
        missing = AHEAD - sum(b.num_rows for b in found)
        if missing and batch.num_rows:
            found.append(batch.slice(0, missing))
    yield from found


def _halos(first: list[dict]) -> dict[int, list[dict]]:
    """For each partition with rows, the first rows after its end."""
    by_part: dict[int, list[dict]] = {}
    for row in first:
        by_part.setdefault(row[_PART], []).append(row)
    out, after = {}, []
    for part in sorted(by_part, reverse=True):
        out[part] = after
        after = (by_part[part] + after)[:AHEAD]
    return out


def _same(a: pa.Array, b: pa.Array) -> pa.Array:
    """Whether values are equal; nulls equal each other."""
    equal = pc.fill_null(pc.equal(a, b), False)
    return pc.or_(equal, pc.and_(pc.is_null(a), pc.is_null(b)))


def _shifted(table: pa.Table, rows: int, step: int, case: Sequence[str], kind: pa.StructType) -> pa.Array:
    """The `step`-th next row of each of the first `rows`, as a struct; null beyond the case."""
    there = max(0, min(rows, table.num_rows - step))
    inside = pa.array([True] * there, pa.bool_())
    for name in case:
        column = table.column(name).combine_chunks()
        inside = pc.and_(inside, _same(column.slice(0, there), column.slice(step, there)))
    at = pc.if_else(inside, pa.array(range(step, step + there), pa.int64()), None)
    at = pa.concat_arrays([at.cast(pa.int64()), pa.nulls(rows - there, pa.int64())])
    values = [table.column(field.name).combine_chunks().take(at).cast(field.type) for field in kind]
    return pa.StructArray.from_arrays(values, fields=list(kind), mask=pc.is_null(at))


def neighbours(
    log: DataFrame, case: Sequence[str], order: Sequence[str], carried: Sequence[str], partition_rows: int
) -> DataFrame:
    """`log` with the structs ``next`` and ``next2`` of the `carried` columns, null past the end of a case."""
    keys = list(dict.fromkeys([*case, *order]))
    laid = laid_out(log, keys, partition_rows)
    given = laid.schema
    # Two rows of each partition.
    halos = _halos(laid.mapInArrow(_first_rows, given).toArrow().to_pylist())
    step = StructType([given[name] for name in carried])
    out = StructType([*(f for f in given.fields if f.name != _PART), StructField("next", step), StructField("next2", step)])
    result = to_arrow_schema(out)
    kind = result.field("next").type

    def told(table: pa.Table, rows: int):
        columns = [table.column(f.name).combine_chunks().slice(0, rows).cast(f.type) for f in list(result)[:-2]]
        columns += [_shifted(table, rows, step, case, kind) for step in (1, 2)]
        return pa.RecordBatch.from_arrays(columns, schema=result)

    def task(batches):
        held, part = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            now = pa.Table.from_batches([batch])
            part = now.column(_PART)[0].as_py()
            table = now if held is None else pa.concat_tables([held, now])
            rows = max(0, table.num_rows - AHEAD)
            if rows:
                yield told(table, rows)
            held = table.slice(rows)
        if held is not None:
            after = pa.Table.from_pylist(halos[part], schema=held.schema)
            yield told(pa.concat_tables([held, after]), held.num_rows)

    return laid.mapInArrow(task, out)
