"""Rows that come to a task sorted by a key, as streams of the batches of each key."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import batched

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows of a batch that a hook's results are gathered into.
_ROWS = 4096


def arrow_schema(schema: str | T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(T.StructType.fromDDL(schema) if isinstance(schema, str) else schema)


def struct_of(schema: str | T.StructType) -> T.StructType:
    return T.StructType.fromDDL(schema) if isinstance(schema, str) else schema


def key_columns(df: DataFrame, on: list[str]) -> list[Column]:
    """Keys named k0, k1, ...; of floating-point keys zero has one sign, as equal keys must hash alike."""
    out = []
    for i, c in enumerate(on):
        kind, key = df.schema[c].dataType, F.col(f"`{c}`")
        if isinstance(kind, (T.MapType, T.StructType, T.ArrayType, T.VariantType)):
            raise TypeError(f"not a key: {c} is {kind.simpleString()}")
        out.append((key + F.lit(0).cast(kind) if isinstance(kind, (T.DoubleType, T.FloatType)) else key).alias(f"k{i}"))
    return out


def key_names(n: int) -> list[str]:
    return [f"k{i}" for i in range(n)]


def key_fields(df: DataFrame, on: list[str]) -> list[T.StructField]:
    return [T.StructField(f"k{i}", df.schema[c].dataType) for i, c in enumerate(on)]


def same(a: tuple, b: tuple) -> bool:
    """Nulls are equal, and so are values that aren't numbers."""
    return all(x == y or (x != x and y != y) for x, y in zip(a, b))


def _changes(column: pa.Array) -> np.ndarray:
    """Whether each value but the first differs from the one before it."""
    a, b = column.slice(0, len(column) - 1), column.slice(1)
    changed = pc.fill_null(pc.not_equal(a, b), False).to_numpy(zero_copy_only=False)
    if column.null_count:
        none = pc.is_null(column).to_numpy(zero_copy_only=False)
        changed = changed | (none[:-1] != none[1:])
    if pa.types.is_floating(column.type):
        nan = pc.fill_null(pc.is_nan(column), False).to_numpy(zero_copy_only=False)
        changed = changed & ~(nan[:-1] & nan[1:])
    return changed


def starts_of(b: pa.RecordBatch, n: int) -> np.ndarray:
    """Where each run of equal values in the first ``n`` columns of a batch with rows begins."""
    changed = np.ones(len(b), bool)
    changed[1:] = False
    for i in range(n):
        changed[1:] |= _changes(b.column(i))
    return np.flatnonzero(changed)


def runs(batches: Iterable[pa.RecordBatch], n: int) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """(key, rows) of each run of equal values in the first ``n`` columns of a batch."""
    for b in batches:
        if not len(b):
            continue
        starts = [*starts_of(b, n).tolist(), len(b)]
        for first, last in zip(starts, starts[1:]):
            yield tuple(b.column(i)[first].as_py() for i in range(n)), b.slice(first, last - first)


def groups(batches: Iterable[pa.RecordBatch], n: int, also: int = 0) -> Iterator[tuple[tuple, Iterator[tuple[tuple, pa.RecordBatch]]]]:
    """(key, its runs) of each key of ``n`` columns, over batches' ends; ``also``: further columns that end a run.

    A key's runs are read as they are asked for, so a key of any size takes no more than two batches. What isn't read is
    skipped.
    """
    every = runs(batches, n + also)
    ahead = next(every, None)

    def own(key):
        nonlocal ahead
        while ahead is not None and same(ahead[0][:n], key):
            now, ahead = ahead, next(every, None)
            yield now

    while ahead is not None:
        key = ahead[0][:n]
        mine = own(key)
        yield key, mine
        for _ in mine:
            pass


def tuples(part: pa.RecordBatch, skip: int = 0) -> Iterator[tuple]:
    """The rows of a batch without its first ``skip`` columns."""
    columns = [c.to_pylist() for c in part.columns[skip:]]
    return zip(*columns) if columns else iter([()] * len(part))


def gathered(rows: Iterable[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Batches of a hook's rows; a row of another width is an error."""
    for some in batched(rows, _ROWS):
        if {*map(len, some)} != {len(schema)}:
            r = next(r for r in some if len(r) != len(schema))
            raise ValueError(f"a row of {len(r)} values for {len(schema)} columns: {r!r}"[:500])
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*some), schema)], schema=schema)


def sorted_by_key(df: DataFrame, n: int, *order: str | Column) -> DataFrame:
    """All rows of a key in one task, keys in a row, each key's rows in order."""
    return df.repartition(*key_names(n)).sortWithinPartitions(*key_names(n), *order)
