"""Hooks for user code over groups: aggregates with partial states, reducers of ordered groups, combiners of two sides.

All three read a group as a stream, so no group has to fit into memory, and all have a way to spread a
group that holds many rows over tasks: aggregates by partial states, reducers by ordered pieces,
combiners by a grid of parts of both sides.
"""

from __future__ import annotations

import pickle
from collections import namedtuple
from collections.abc import Callable, Iterable, Iterator
from itertools import islice, repeat
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewell.operators.runs import arrow_schema, gathered, groups, key_columns, key_fields, key_names, same, sorted_by_key, starts_of, struct_of, tuples
from tidewell.session import ship

# aggregates


class Aggregate:
    """A user's aggregate. A state is any value that can be pickled; ``merge`` and ``add`` may change and return the first one.

    Rows and states come in no order. ``start`` must be neutral: merging with it changes nothing.
    """

    def start(self) -> Any:
        raise NotImplementedError

    def add(self, state: Any, *values: Any) -> Any:
        """A row's values."""
        raise NotImplementedError

    def add_batch(self, state: Any, *columns: pa.Array) -> Any:
        """Values of many rows of one group; of use where columns can be handled as a whole.

        With ``add`` in the same class, a group's few rows of a batch are added one by one, as small arrays take longer than their values.
        """
        for values in zip(*[c.to_pylist() for c in columns]):
            state = self.add(state, *values)
        return state

    def merge(self, a: Any, b: Any) -> Any:
        raise NotImplementedError

    def finish(self, state: Any) -> tuple:
        """The result's columns."""
        raise NotImplementedError

    def dump(self, state: Any) -> bytes:
        return pickle.dumps(state, protocol=5)

    def load(self, raw: bytes) -> Any:
        return pickle.loads(raw)


_NAN = float("nan")


#: Rows of a group in a batch that are added one by one, if a user's class has both ways.
_FEW = 16


def _keys(b: pa.RecordBatch, n: int, at: np.ndarray) -> Iterator[tuple]:
    """The values of the first n columns in some rows; what isn't a number is one object."""
    taken = [b.column(i).take(pa.array(at)) for i in range(n)]
    lists = [[_NAN if x != x else x for x in c.to_pylist()] if pa.types.is_floating(c.type) else c.to_pylist() for c in taken]
    return zip(*lists)


def _by_key(b: pa.RecordBatch, n: int) -> tuple[pa.RecordBatch, np.ndarray]:
    """A batch with the rows of each key side by side, and where they begin, with the batch's end."""
    code = np.zeros(len(b), np.int64)
    for i in range(n):
        d = b.column(i).dictionary_encode(null_encoding="encode")
        # numbered again, so that numbers stay small
        code = np.unique(code * max(len(d.dictionary), 1) + d.indices.to_numpy(zero_copy_only=False), return_inverse=True)[1]
    order = np.argsort(code, kind="stable")
    return b.take(pa.array(order)), np.append(np.flatnonzero(np.diff(code[order], prepend=-1)), len(b))


def _partial(agg: Aggregate, n: int, most: int, schema: pa.Schema):
    single, whole = (next(c for c in type(agg).__mro__ if name in vars(c)) for name in ("add", "add_batch"))
    # both ways are the same only where one class says both; None: always one by one
    few = None if whole is Aggregate else _FEW if single is whole else 0

    def run(batches):
        states: dict[tuple, Any] = {}

        def flush():
            rows = ((*k, agg.dump(s)) for k, s in states.items())
            yield from gathered(rows, schema)
            states.clear()

        for b in batches:
            if len(b):
                b, at = _by_key(b, n)
                columns = b.columns[n:]
                size = np.diff(at)
                # values of rows that are added one by one, as objects
                alone = np.ones(len(size), bool) if few is None else size <= few
                rows = np.repeat(alone, size)
                values = zip(*[c.filter(pa.array(rows)).to_pylist() for c in columns]) if columns else repeat(())
                for key, first, length, one in zip(_keys(b, n, at[:-1]), at.tolist(), size.tolist(), alone.tolist()):
                    state = states[key] if key in states else agg.start()
                    if one:
                        for row in islice(values, length):
                            state = agg.add(state, *row)
                    else:
                        state = agg.add_batch(state, *[c.slice(first, length) for c in columns])
                    states[key] = state
                if len(states) > most:
                    yield from flush()
        yield from flush()

    return run


def _merging(agg: Aggregate, n: int, drop: int, finish: bool, schema: pa.Schema):
    """One state of each key of n columns, whose last ``drop`` go, or its result. A state that is alone isn't opened for the former."""

    def ended(key, state):
        return (*key[: n - drop], *(agg.finish(state) if finish else (agg.dump(state),)))

    def merged(batches):
        """(key, its one state, still packed) or (key, merged states, None) of each key; no more than a batch is held."""
        last, held, state = None, None, None  # the key that may go on, its first state as it came, its merged states
        for b in batches:
            if not len(b):
                continue
            at = starts_of(b, n)
            states, ends = b.column(n).to_pylist(), [*at[1:].tolist(), len(b)]
            for key, first, stop in zip(_keys(b, n, at), at.tolist(), ends):
                if last is None or key != last and not same(key, last):
                    if last is not None:
                        yield last, held, state
                    last, held, state = key, states[first], None
                    first += 1
                for raw in states[first:stop]:
                    if held is not None:
                        state, held = agg.load(held), None
                    state = agg.merge(state, agg.load(raw))
        if last is not None:
            yield last, held, state

    def rows(batches):
        for key, held, state in merged(batches):
            if held is None:
                yield ended(key, state)
            elif finish:
                yield (*key[: n - drop], *agg.finish(agg.load(held)))
            else:
                yield (*key[: n - drop], held)

    return lambda batches: gathered(rows(batches), schema)


def aggregate(df: DataFrame, by: list[str], values: list[str | Column], agg: Aggregate, schema: str | T.StructType, *, salts: int = 16, most: int = 20_000) -> DataFrame:
    """``by`` and the columns of ``schema``, a row for each group; without ``by`` one row, of no rows too.

    Each task adds its rows to one state a group, from Arrow batches, and holds at most ``most`` groups' states
    before it gives them on. States go through shuffles as binary, sorted by group, and are merged one after the other:
    first those of one group and salt, so that a group that every task has is merged by ``salts`` tasks, then a group's.
    Null is a group of its own.
    """
    ship(df.sparkSession)
    schema = struct_of(schema)
    if clash := {f.name for f in schema} & set(by):
        raise ValueError(f"results named like groups: {sorted(clash)}")
    keys, fields = key_columns(df, by), key_fields(df, by)
    if not by:
        keys, fields = [F.lit(0).alias("k0")], [T.StructField("k0", T.IntegerType())]
    n = len(keys)
    columns = [(F.col(f"`{v}`") if isinstance(v, str) else v).alias(f"v{i}") for i, v in enumerate(values)]
    state = T.StructField("state", T.BinaryType())
    held = T.StructType([*fields, state])
    parts = df.select(*keys, *columns).mapInArrow(_partial(agg, n, most, arrow_schema(held)), held)
    if not by:
        parts = parts.union(df.sparkSession.createDataFrame([(0, agg.dump(agg.start()))], held))
    if salts > 1:
        # a task's number says which salt its states have, whenever it runs again
        salted = parts.withColumn(f"k{n}", F.spark_partition_id() % salts).select(*key_names(n + 1), "state")
        parts = sorted_by_key(salted, n + 1).mapInArrow(_merging(agg, n + 1, 1, False, arrow_schema(held)), held)
    out = T.StructType([*fields, *schema])
    done = sorted_by_key(parts, n).mapInArrow(_merging(agg, n, 0, True, arrow_schema(out)), out)
    return done.toDF(*by, *schema.names) if by else done.drop("k0")


# reducers


def reduce_ordered(
    df: DataFrame, on: list[str], order: list[str | Column], fn: Callable[[tuple, Iterator[tuple]], Iterable[tuple]], schema: str | T.StructType,
    *, merge: Callable[[tuple, Iterator[tuple]], Iterable[tuple]] | None = None, parts: str | T.StructType | None = None,
) -> DataFrame:
    """``fn(key, rows)`` once a key, with the key's rows in order as named tuples; gives rows of ``schema``.

    Rows are read as ``fn`` asks for them, so a key of any size takes no memory; rows that it doesn't read are skipped.
    A key is one task's work then. With ``merge``, rows are dealt in ranges of key and order instead, so that a large key is
    cut into pieces that follow each other; ``fn`` gives rows of ``parts`` for each piece, and ``merge(key, rows)``
    makes the key's rows of them, in the order of the pieces. Only rows that are equal in key and order stay together.
    ``order``: names, after a minus sign if they descend, or expressions.
    """
    ship(df.sparkSession)
    schema, n, columns = struct_of(schema), len(on), list(df.columns)
    # columns are numbered, so that no name clashes; expressions of the order go beside the rows
    extra = [o.alias(f"o{i}") for i, o in enumerate(order) if isinstance(o, Column)]
    source = df.select(*key_columns(df, on), *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(columns)], *extra)
    directions = [F.col(f"o{i}") if isinstance(o, Column) else F.col(f"c{columns.index(o.removeprefix('-'))}") for i, o in enumerate(order)]
    directions = [d.desc() if isinstance(o, str) and o.startswith("-") else d.asc() for d, o in zip(directions, order)]
    width = n + len(columns)

    def rows_of(found, skip, kind):
        for _, part in found:
            yield from map(kind._make, tuples(part.select(range(width)) if part.num_columns > width else part, skip))

    if merge is None:
        out = arrow_schema(schema)

        def run(batches):
            kind = namedtuple("Row", columns, rename=True)
            return gathered((r for key, found in groups(batches, n) for r in fn(key, rows_of(found, n, kind))), out)

        dealt = source.repartition(*key_names(n)).sortWithinPartitions(*key_names(n), *directions)
        return dealt.mapInArrow(run, schema)
    if parts is None:
        raise ValueError("merge needs the schema of the parts")
    parts = struct_of(parts)
    held = T.StructType([*key_fields(df, on), T.StructField("piece", T.LongType()), *[T.StructField(f"p{i}", f.dataType) for i, f in enumerate(parts)]])
    held_arrow, out = arrow_schema(held), arrow_schema(schema)

    def pieces(batches):
        kind, place = namedtuple("Row", columns, rename=True), TaskContext.get().partitionId() << 32

        def rows():
            at = place
            for key, found in groups(batches, n):
                for r in fn(key, rows_of(found, n, kind)):
                    yield (*key, at, *r)
                    at += 1

        return gathered(rows(), held_arrow)

    def whole(batches):
        kind = namedtuple("Part", parts.names, rename=True)
        return gathered((r for key, found in groups(batches, n) for r in merge(key, (kind._make(t) for _, p in found for t in tuples(p, n + 1)))), out)

    ranged = source.repartitionByRange(*key_names(n), *directions).sortWithinPartitions(*key_names(n), *directions)
    return sorted_by_key(ranged.mapInArrow(pieces, held), n, "piece").mapInArrow(whole, schema)


# combiners


def combine_streams(
    left: DataFrame, right: DataFrame, on: list[str], fn: Callable[..., Iterable[tuple]], schema: str | T.StructType,
    *, cell_rows: int | None = None, merge: Callable[[tuple, Iterator[tuple]], Iterable[tuple]] | None = None,
) -> DataFrame:
    """``fn(key, left, right)`` once a key that either side has, with both sides' rows as streams of named tuples.

    The right rows come first; ``fn`` reads them (and keeps what it needs) before the left ones. Null is a key of its own.
    With ``cell_rows`` a key with more rows than that on a side is cut into a grid: its left rows into parts, its right rows
    into parts, by a hash of all columns, and ``fn(key, left, right, cell)`` gets each part of one side with each of the other, in
    a task of its own, once; ``cell`` is the pair of the parts' numbers. So the right rows that a call gets are bounded, and
    all pairs of a key meet in one call. ``merge(key, rows)`` makes one result of the cells' rows; without it they are the result.
    """
    ship(left.sparkSession)
    schema, n = struct_of(schema), len(on)
    sides = []
    for side, df in ((1, left), (0, right)):
        row = F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(df.columns)])
        spread = F.xxhash64(*[F.col(f"`{c}`") for c in df.columns if not isinstance(df.schema[c].dataType, (T.MapType, T.VariantType))])
        sides.append(df.select(*key_columns(df, on), F.lit(side).alias("side"), row.alias("row"), spread.alias("h")))
    left_rows, right_rows = sides
    hot = None
    if cell_rows is not None:
        counted = [s.groupBy(*key_names(n)).agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") > cell_rows).select(*key_names(n), F.ceil(F.col("rows") / cell_rows).cast("int").alias(name)) for s, name in ((left_rows, "p"), (right_rows, "q"))]
        both = counted[0].select(*key_names(n), "p", F.lit(1).alias("q")).union(counted[1].select(*key_names(n), F.lit(1), "q"))
        hot = both.groupBy(*key_names(n)).agg(F.max("p").alias("p"), F.max("q").alias("q"))
        hot = None if hot.isEmpty() else hot
    tagged = []
    for side, df in ((1, left_rows), (0, right_rows)):
        if hot is None:
            cells = [F.lit(0).alias("i"), F.lit(0).alias("j")]
        else:
            names = hot.select(*[F.col(k).alias(f"hot_{k}") for k in key_names(n)], "p", "q")
            # few keys have many rows; a join with them is skewed on one side only
            df = df.join(names, [F.col(k).eqNullSafe(F.col(f"hot_{k}")) for k in key_names(n)], "left").withColumns({"p": F.coalesce("p", F.lit(1)), "q": F.coalesce("q", F.lit(1))})
            own, other = ("i", "j") if side else ("j", "i")
            parts, copies = ("p", "q") if side else ("q", "p")
            df = df.withColumn(own, F.pmod("h", F.col(parts)).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), F.col(copies) - 1)))
            cells = [F.col("i"), F.col("j")]
        empty = F.lit(None)
        other_type = right_rows.schema["row"].dataType if side else left_rows.schema["row"].dataType
        rows = [F.col("row"), empty.cast(other_type)] if side else [empty.cast(other_type), F.col("row")]
        tagged.append(df.select(*key_names(n), *cells, "side", rows[0].alias("l"), rows[1].alias("r")))
    every = tagged[0].union(tagged[1])
    every = every.toDF(*key_names(n + 2), "side", "l", "r")
    held = T.StructType([*key_fields(left, on), *[T.StructField(f"p{i}", f.dataType) for i, f in enumerate(schema)]]) if merge else schema
    held_arrow, out = arrow_schema(held), arrow_schema(schema)
    left_names, right_names, with_cell = list(left.columns), list(right.columns), cell_rows is not None

    def run(batches):
        kinds = namedtuple("Left", left_names, rename=True), namedtuple("Right", right_names, rename=True)

        def rows():
            for key, found in groups(batches, n + 2, 1):
                a, b = _sides(found, n + 2, *kinds)
                for r in fn(key[:n], a, b, key[n:]) if with_cell else fn(key[:n], a, b):
                    yield (*key[:n], *r) if merge else r

        return gathered(rows(), held_arrow)

    def whole(batches):
        kind = namedtuple("Part", schema.names, rename=True)
        return gathered((r for key, found in groups(batches, n) for r in merge(key, (kind._make(t) for _, p in found for t in tuples(p, n)))), out)

    cells = sorted_by_key(every, n + 2, "side").mapInArrow(run, held)
    return sorted_by_key(cells, n).mapInArrow(whole, schema) if merge else cells


def _sides(found: Iterator[tuple[tuple, pa.RecordBatch]], n: int, left_kind: type, right_kind: type) -> tuple[Iterator[tuple], Iterator[tuple]]:
    """The streams of a key's left and right rows, of which the right ones come first."""
    ahead = next(found, None)

    def side(number: int, column: int, kind: type):
        nonlocal ahead
        if number == 1 and ahead is not None and ahead[0][n] == 0:
            raise RuntimeError("the right rows of a key are read before its left rows")
        while ahead is not None and ahead[0][n] == number:
            rows = ahead[1].column(column)
            ahead = next(found, None)
            yield from map(kind._make, zip(*[pc.struct_field(rows, [i]).to_pylist() for i in range(rows.type.num_fields)]))

    return side(1, n + 1, left_kind), side(0, n + 2, right_kind)
