"""Exact positions in a global order, without any group in one task.

Rows are range-partitioned on group and order keys, so a hot group spans many
partitions. Each partition numbers its own rows; only the first group of a
partition can continue from earlier ones, so the driver needs two rows a
partition (first and last group with their totals) to prefix-sum the offsets.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.scratch import cut, release

_PART, _KIND, _HEAD, _POS = "__q_part", "__q_kind", "__q_head", "__q_pos"


def _differs(now: pa.Array, before: pa.Array) -> np.ndarray:
    """Where two aligned arrays differ, null equal to null and NaN to NaN."""
    neq = pc.fill_null(pc.not_equal(now, before), False)
    neq = pc.or_(neq, pc.not_equal(pc.is_null(now), pc.is_null(before)))
    if pa.types.is_floating(now.type):
        both = pc.and_(pc.fill_null(pc.is_nan(now), False), pc.fill_null(pc.is_nan(before), False))
        neq = pc.and_not(neq, both)
    return neq.to_numpy(zero_copy_only=False).astype(bool)


def _numberer(n_groups: int, weight: int | None, keep: int | None):
    """mapInArrow function over sorted partitions; see :func:`with_positions`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        tail: list[pa.Array] | None = None  # group of the last row seen
        total = 0  # of that group so far
        head: list[pa.Array] | None = None
        head_total, in_head = 0, True
        schema: pa.Schema | None = None  # of the batches, whatever their time zone, and our columns
        own = [(_PART, pa.int32()), (_KIND, pa.int8()), (_HEAD, pa.bool_()), (_POS, pa.int64())]

        def trailer(group: list[pa.Array], kind: int, amount: int) -> pa.RecordBatch:
            cols = [group[i] if i < n_groups else pa.nulls(1, schema.field(i).type) for i in range(len(schema) - 4)]
            cols += [pa.array([part], pa.int32()), pa.array([kind], pa.int8()), pa.array([True]), pa.array([amount], pa.int64())]
            return pa.RecordBatch.from_arrays(cols, schema=schema)

        for batch in batches:
            n = batch.num_rows
            if n == 0:
                continue
            if schema is None:
                schema = pa.schema([*[pa.field(f.name, f.type) for f in batch.schema], *[pa.field(*f) for f in own]])
            start = np.zeros(n, dtype=bool)
            for i in range(n_groups):
                col = batch.column(i)
                if n > 1:
                    start[1:] |= _differs(col[1:], col[:-1])
                if tail is not None:
                    start[0] |= _differs(col[:1], tail[i])[0]
            if tail is None:
                start[0], head = True, [batch.column(i)[:1] for i in range(n_groups)]
            size = np.ones(n, np.int64) if weight is None else batch.column(weight).to_numpy(zero_copy_only=False).astype(np.int64)
            run_sum = np.cumsum(size)
            at = np.flatnonzero(start)
            base = np.zeros(n, np.int64)  # what lies before each row's group, in this batch
            if len(at):
                lengths = np.diff(np.append(at, n))
                base[at[0] :] = np.repeat(run_sum[at] - size[at], lengths)
                base[: at[0]] = -total
            else:
                base[:] = -total
            pos = run_sum - base
            # Still the partition's first group: rows before the second group start.
            later = at[1:] if (tail is None) else at
            first_end = (later[0] if len(later) else n) if in_head else 0
            is_head = np.arange(n) < first_end
            if in_head and first_end:
                head_total = int(pos[first_end - 1])
            in_head = in_head and first_end == n
            tail, total = [batch.column(i)[n - 1 :] for i in range(n_groups)], int(pos[-1])
            out = pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(np.full(n, part, np.int32)), pa.array(np.zeros(n, np.int8)), pa.array(is_head), pa.array(pos)], schema=schema
            )
            yield out if keep is None else out.filter(pa.array(pos <= keep))
        if tail is not None:
            yield trailer(head, 1, head_total)
            yield trailer(tail, 2, total)

    return run


def with_positions(
    df: DataFrame,
    groups: Sequence[str],
    orders: Sequence[Column],
    out: str = "position",
    weight: str | None = None,
    keep: int | None = None,
    partitions: int | None = None,
    store: bool = False,
) -> DataFrame:
    """Add each row's exact 1-based position within its group.

    ``orders`` sort the rows of a group and should form a total order; rows that
    tie on all of them are numbered in an order fixed by the written result. With
    ``weight`` (an integer column) the position is the inclusive running sum of
    it. ``keep`` drops rows beyond that position, first inside each partition.
    Null and NaN groups are groups of their own; an empty table stays empty; extra
    columns pass through under their names. ``partitions`` defaults to the session's
    shuffle partitions. The range sampling reads the input once more; ``store`` writes
    it first, where that is cheaper than making it twice.
    """
    spark = df.sparkSession
    if store:
        df = cut(df, "unplaced")
    names = df.columns
    if len(set(names)) != len(names):
        raise ValueError("columns must have different names")
    groups = list(groups)
    if not groups:
        df = df.withColumn("__q_all", F.lit(0))
        groups = ["__q_all"]
    cols = groups + [c for c in df.columns if c not in groups]
    key_cols = [F.col(f"`{g}`") for g in groups]
    count = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = [*[c.asc_nulls_first() for c in key_cols], *orders]
    ranged = df.repartitionByRange(count, *order).sortWithinPartitions(*order).select(*[F.col(f"`{c}`") for c in cols])
    extra = [T.StructField(_PART, T.IntegerType()), T.StructField(_KIND, T.ByteType()), T.StructField(_HEAD, T.BooleanType()), T.StructField(_POS, T.LongType())]
    fields = [T.StructField(f.name, f.dataType, True) for f in ranged.schema.fields] + extra
    where = cols.index(weight) if weight else None
    numbered = cut(ranged.mapInArrow(_numberer(len(groups), where, keep), T.StructType(fields)), "positions")

    ends = numbered.filter(f"{_KIND} > 0").select(_PART, _KIND, _POS, *key_cols).collect()  # two rows a partition
    by_part: dict[int, dict[int, tuple]] = {}
    for row in ends:
        by_part.setdefault(row[0], {})[row[1]] = (row[2], tuple(repr(v + 0.0 if isinstance(v, float) else v) for v in row[3:]))  # -0.0 is 0.0
    offsets, before, running = [], None, 0
    for part in sorted(by_part):
        (head_sum, head), (tail_sum, tail) = by_part[part][1], by_part[part][2]
        shift = running if head == before else 0
        if shift:
            offsets.append((part, shift))
        running = tail_sum + (shift if head == tail else 0)
        before = tail
    rows = numbered.filter(f"{_KIND} = 0")
    if offsets:
        table = spark.createDataFrame(offsets, f"{_PART} int, __q_shift long")  # at most one row a partition
        rows = rows.join(F.broadcast(table), _PART, "left")
        place = F.col(_POS) + F.when(F.col(_HEAD), F.coalesce(F.col("__q_shift"), F.lit(0))).otherwise(0)
    else:
        place = F.col(_POS)
    result = rows.select(*[F.col(f"`{c}`") for c in names], place.alias(out))
    if keep is not None:
        result = result.filter(F.col(f"`{out}`") <= keep)
    result._quern_path = numbered._quern_path
    return result


__all__ = ["with_positions", "release"]
