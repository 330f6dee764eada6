"""A user's function of column values, run on Arrow batches."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewell.session import ship

#: Functions that this worker has set up.
_ready: dict[str, Scalar] = {}


class Scalar:
    """A function of one value or more. ``setup`` runs once in each worker process, before the first value.

    ``call`` gets a row's values. A class that can handle columns as a whole has ``call_batch`` instead, which gets and gives Arrow
    arrays of one length.
    """

    def setup(self) -> None:
        pass

    def call(self, *values: Any) -> Any:
        raise NotImplementedError

    def call_batch(self, *arrays: pa.Array) -> pa.Array | list:
        return [self.call(*v) for v in zip(*[a.to_pylist() for a in arrays])]


def _given(fn: Scalar, name: str, arrays: tuple[pa.Array, ...], kind: pa.DataType) -> pa.Array:
    """The values of a batch. Of a batch that fails the first value that fails by itself is named."""
    try:
        out = fn.call_batch(*arrays)
        out = out.cast(kind) if isinstance(out, (pa.Array, pa.ChunkedArray)) else pa.array(out, kind)
        if len(out) != len(arrays[0]):
            raise ValueError(f"{len(out)} values for {len(arrays[0])} rows")
        return out
    except Exception as whole:
        low, high = 0, len(arrays[0])
        while high - low > 1:
            half = (low + high) // 2
            try:
                pa.array(fn.call_batch(*[a.slice(low, half - low) for a in arrays]), kind)
                low = half
            except Exception:  # noqa: BLE001  the user's own
                high = half
        values = ", ".join(repr(a[low].as_py())[:200] for a in arrays) if len(arrays[0]) else "no rows"
        raise ValueError(f"{name} failed on {values}: {whole}") from whole


def scalar(fn: Scalar, returns: str | T.DataType, *, nulls: str = "skip", rows: int = 10_000, name: str | None = None) -> Callable[..., Column]:
    """A function of columns.

    ``nulls``: ``skip`` gives null for rows with a null without calling the function, ``pass`` calls it with None. The function gets at
    most ``rows`` rows at a time, whatever Spark's batches hold, and is never called without rows. An error names the function and the
    values that it came from.
    """
    if nulls not in ("skip", "pass"):
        raise ValueError(f"skip or pass, not {nulls!r}")
    ship(SparkSession.active())
    from pyspark.sql.pandas.types import to_arrow_type

    kind = to_arrow_type(T._parse_datatype_string(returns) if isinstance(returns, str) else returns)
    token, name = uuid.uuid4().hex, name or type(fn).__name__

    def batches(found: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        if token not in _ready:
            fn.setup()
            _ready[token] = fn
        me = _ready[token]
        for arrays in found:
            keep = None
            if nulls == "skip" and any(a.null_count for a in arrays):
                keep = arrays[0].is_valid()
                for a in arrays[1:]:
                    keep = pc.and_(keep, a.is_valid())
            some = arrays if keep is None else tuple(a.filter(keep) for a in arrays)
            pieces = [_given(me, name, tuple(a.slice(i, rows) for a in some), kind) for i in range(0, len(some[0]), rows)]
            out = pa.concat_arrays(pieces) if pieces else pa.nulls(0, kind)
            yield out if keep is None else pc.replace_with_mask(pa.nulls(len(keep), kind), keep, out)

    def one(found: Iterator[pa.Array]) -> Iterator[pa.Array]:
        return batches((a,) for a in found)

    udfs: dict[bool, Callable] = {}

    def apply(*columns: Column | str) -> Column:
        many = len(columns) > 1
        if many not in udfs:
            # evaluated hints, which choose the iterator form
            work = batches if many else one
            work.__annotations__ = {"found": Iterator[tuple[pa.Array, ...]] if many else Iterator[pa.Array], "return": Iterator[pa.Array]}
            udfs[many] = F.arrow_udf(work, returns)
        return udfs[many](*columns)

    return apply
