"""Helpers for functions that run in mapInArrow tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of text that are handled at a time, so that memory is bounded whatever a batch holds.
BLOCK = 8_000_000
#: Bytes to lower-case a-z, 0-9 and bytes over 0x7F; all others are spaces.
WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words(text: bytes | None) -> list[bytes]:
    """The words of a UTF-8 text in lower case: runs of letters, digits and characters beyond ASCII."""
    return text.translate(WORD_BYTES).split() if text else []


def unused(columns: list[str], stem: str) -> str:
    """A column name that isn't there, whatever cases are told apart."""
    taken = {c.lower() for c in columns}
    while stem in taken:
        stem += "_"
    return stem


def ranges(sizes: list[int], most: int = BLOCK) -> Iterator[tuple[int, int]]:
    """Ranges of texts of these sizes, each of at most ``most`` bytes or of one text."""
    first, n = 0, 0
    for i, size in enumerate(sizes):
        if n and n + size > most:
            yield first, i
            first, n = i, 0
        n += size + 1
    if n:
        yield first, len(sizes)


def blocks(texts: list[bytes | None], most: int = BLOCK) -> Iterator[tuple[int, int]]:
    """Ranges of texts of at most ``most`` bytes, or of one text."""
    return ranges([len(t or b"") for t in texts], most)


def filter_texts(df: DataFrame, text: str, keep: Callable, *also: str) -> DataFrame:
    """The rows of ``df`` for which ``keep(texts, *lists of the columns also)`` is true, with all their columns.

    Texts are read from blocks of a batch, so no more than a block is held twice.
    """
    names = df.columns
    at, more = names.index(text), [names.index(c) for c in also]

    def run(batches):
        for b in batches:
            sizes = [n or 0 for n in pc.binary_length(b.column(at)).to_pylist()]
            for first, last in ranges(sizes):
                some = b.slice(first, last - first)
                texts = some.column(at).cast(pa.binary()).to_pylist()
                yield some.filter(pa.array(keep(texts, *[some.column(i).to_pylist() for i in more]), pa.bool_()))

    return df.mapInArrow(run, df.schema)


def map_texts(df: DataFrame, keys: list[str], text: str, fn: Callable, schema: str) -> DataFrame:
    """Rows that ``fn(keys, texts)`` makes from blocks of whole texts.

    ``fn`` gets a dict of Arrow arrays for ``keys`` and a list of UTF-8 bytes or None,
    and returns a dict of arrays or lists for ``schema``.
    """
    source = df.select(*[F.col(f"`{k}`").alias(f"k{i}") for i, k in enumerate(keys)], F.col(f"`{text}`").cast("string").cast("binary").alias("t"))
    n = len(keys)

    def run(batches):
        out = None
        for b in batches:
            sizes = [x or 0 for x in pc.binary_length(b.column(n)).to_pylist()]
            for first, last in ranges(sizes):
                got = fn([b.column(i).slice(first, last - first) for i in range(n)], b.column(n).slice(first, last - first).to_pylist())
                if out is None:
                    out = arrow_schema
                yield pa.RecordBatch.from_arrays([x if isinstance(x, (pa.Array, pa.ChunkedArray)) and x.type == f.type else pa.array(x, f.type) for x, f in zip(got, out)], schema=out)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow_schema = to_arrow_schema(StructType.fromDDL(schema))
    return source.mapInArrow(run, schema)
