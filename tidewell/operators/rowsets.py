"""Row-set operators: hooks for user functions, sparse unions, and changes of columns by name."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from fnmatch import translate

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewell.session import ship


#: Rows of the smaller side of a combination without keys.
PAIRED_ROWS = 100_000


def process(df: DataFrame, fn: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], schema: str | T.StructType) -> DataFrame:
    """A stream of batches in, a stream of batches out."""
    ship(df.sparkSession)
    return df.mapInPandas(fn, schema)


def reduce(df: DataFrame, on: list[str], fn: Callable, schema: str | T.StructType, merge: Callable | None = None, salts: int = 64) -> DataFrame:
    """``fn`` once a key; with an iterator of batches as its argument, a key needn't fit in memory.

    With ``merge``, which makes one result of several, ``fn`` runs on up to ``salts`` parts of each key, so that
    few large keys are spread over as many tasks, and ``merge`` on the parts' results.
    """
    ship(df.sparkSession)
    if merge is None:
        return df.groupBy(*on).applyInPandas(fn, schema)
    salt = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]), F.lit(salts))
    return df.withColumn("_salt", salt).groupBy(*on, "_salt").applyInPandas(fn, schema).groupBy(*on).applyInPandas(merge, schema)


def combine(left: DataFrame, right: DataFrame, on: list[str] | None, fn: Callable | None = None, schema: str | None = None, left_name: str = "", right_name: str = "") -> DataFrame:
    """Rows of both sides together: a join on keys, all pairs without keys, or ``fn`` on both sides of a key.

    A column name of both sides gets its side's name before it. Without keys one side may have at most ``PAIRED_ROWS``
    rows, which are counted first and broadcast; of two larger sides all pairs are an error.
    """
    if fn is not None:
        ship(left.sparkSession)
        return left.groupBy(*on).cogroup(right.groupBy(*on)).applyInPandas(fn, schema)
    same = set(left.columns) & set(right.columns)
    a = left.select(*[F.col(f"`{c}`").alias(f"{left_name}{c}" if c in same else c) for c in left.columns])
    b = right.select(*[F.col(f"`{c}`").alias(f"{right_name}{c}" if c in same else c) for c in right.columns])
    if not on:
        if b.limit(PAIRED_ROWS + 1).count() <= PAIRED_ROWS:
            return a.crossJoin(F.broadcast(b))
        if a.limit(PAIRED_ROWS + 1).count() <= PAIRED_ROWS:
            return F.broadcast(a).crossJoin(b)
        raise ValueError(f"all pairs of two sides of more than {PAIRED_ROWS} rows each; give keys")
    return a.join(b, [a[f"{left_name}{c}" if c in same else c] == b[f"{right_name}{c}" if c in same else c] for c in on])


def implicit_join(left: DataFrame, right: DataFrame, where: list[tuple[str, str]]) -> DataFrame:
    """A comma join with its equalities; without one it is an error, not a product."""
    if not where:
        raise ValueError("an implicit join needs an equality between its sides")
    return left.join(right, [left[a] == right[b] for a, b in where])


def having(df: DataFrame, condition: Column | str) -> DataFrame:
    """A filter after the projection, which sees its names."""
    return df.where(condition)


def _default(kind: T.DataType) -> Column:
    if isinstance(kind, T.NumericType):
        return F.lit(0).cast(kind)
    if isinstance(kind, T.BooleanType):
        return F.lit(False)
    return F.lit(None).cast(kind)


def sparse_union(*frames: DataFrame) -> DataFrame:
    """All rows by column name, over all columns in the order they are first seen.

    A column that a frame lacks is 0, false or null by its type; nulls that a frame has stay.
    """
    kinds: dict[str, T.DataType] = {}
    for df in frames:
        for f in df.schema:
            kinds.setdefault(f.name, f.dataType)
    filled = [df.select(*[F.col(f"`{c}`") if c in df.columns else _default(k).alias(c) for c, k in kinds.items()]) for df in frames]
    out = filled[0]
    for df in filled[1:]:
        out = out.unionByName(df)
    return out


def _names(text: str) -> list[str]:
    return [x.strip() for x in re.split("[,;]", text) if x.strip()]


def _matching(df: DataFrame, patterns: str) -> list[str]:
    """Columns that match one of the patterns, with * and ?, cases told apart."""
    tests = [re.compile(translate(p.replace("[", "[[]"))) for p in _names(patterns)]
    return [c for c in df.columns if any(t.match(c) for t in tests)]


def delete(df: DataFrame, columns: str) -> DataFrame:
    gone = set(_matching(df, columns))
    return _some(df, [c for c in df.columns if c not in gone])


def keep(df: DataFrame, columns: str) -> DataFrame:
    return _some(df, _matching(df, columns))


def _some(df: DataFrame, names: list[str]) -> DataFrame:
    if not names:
        raise ValueError("no column is left")
    return df.select(*[F.col(f"`{c}`") for c in names])


def _pairs(text: str) -> list[tuple[str, str]]:
    out = []
    for part in _names(text):
        old, sep, new = part.partition(">")
        if not sep or not old.strip() or not new.strip():
            raise ValueError(f"not a pair: {part!r}")
        out.append((old.strip(), new.strip()))
    return out


def rename(df: DataFrame, columns: str) -> DataFrame:
    """ "old>new, ..." by exact names; names that aren't there are ignored."""
    return df.withColumnsRenamed(dict(_pairs(columns)))


def replace_in_names(df: DataFrame, columns: str, replace: str) -> DataFrame:
    """Replaces parts of the names of matching columns, pair after pair."""
    hit, pairs, names = set(_matching(df, columns)), _pairs(replace), []
    for c in df.columns:
        new = c
        for a, b in pairs if c in hit else []:
            new = new.replace(a, b)
        names.append(new)
    return df.toDF(*names)


def reverse_columns(df: DataFrame) -> DataFrame:
    return df.select(*[F.col(f"`{c}`") for c in reversed(df.columns)])


def typed_or_not(df: DataFrame, column: str, mode: str, parse: Callable[[Column], Column]) -> DataFrame:
    """A view whose schema depends on its argument: ``typed`` parses a column, ``untyped`` leaves it."""
    if mode not in ("typed", "untyped"):
        raise ValueError(f"typed or untyped, not {mode!r}")
    return df.withColumn(column, parse(F.col(column))) if mode == "typed" else df
