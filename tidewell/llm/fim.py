"""Fill-in-middle: texts cut in three at token ends, put in another order, and put back.

The bytes of a whole block of texts are moved at once. A text's cuts say where its prefix,
middle and suffix begin; the shift of each of these parts from its place in the input to its
place in the output is put into a difference array at the part's first byte, a cumulative sum
gives every byte its shift, and one numpy scatter writes the output. ``restore`` finds the
sentinels in the output, computes the same shifts from them alone and gathers the bytes back.

Tokens are a word with the white space before it, or the white space that ends a text. The cuts
and the form come from SHA-256 of a seed and the row's id, so they don't depend on the order or
partitioning of rows. Form ``plain`` leaves a text as it is: an empty one, one that holds a
sentinel, and those that the rate leaves out. Null texts are empty. A null id counts as an empty
one in the hash, repeated ids give equal cuts, and each row stays a row. A text of any length is
moved in spans of a fixed number of bytes, beside the text and its output. An empty table gives no
rows. Extra columns don't matter.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.llm.arrow import map_texts
from tidewell.session import ship

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
SEED, RATE, SPM_RATE = 42, 50, 80
FORMS = ("plain", "psm", "spm")
_PLAIN, _PSM, _SPM = range(3)
#: Bytes that are moved at a time.
_SPAN = 1 << 20
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: The place of a part (prefix, middle, suffix) in the output of a form.
_ORDER = {_PSM: (0, 2, 1), _SPM: (1, 2, 0)}


def _joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(all bytes, where each text begins and the last one ends)."""
    at = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) for t in texts], out=at[1:])
    return np.frombuffer(b"".join(texts), np.uint8), at


def token_ends(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The places after each token, over all texts; a token never goes on into the next text."""
    if not len(data):
        return np.zeros(0, np.int64)
    space = _SPACE[data]
    last = np.zeros(len(data), bool)
    last[at[1:][at[1:] > at[:-1]] - 1] = True
    ends = ~space
    ends[:-1] &= space[1:] | last[:-1]
    return np.flatnonzero(ends | last) + 1


def sentinels(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The places of all sentinels that lie in one text."""
    if len(data) < 3:
        return np.zeros(0, np.int64)
    named = np.zeros(256, bool)
    named[[m[1] for m in (PREFIX, SUFFIX, MIDDLE)]] = True
    found = np.flatnonzero((data[:-2] == PREFIX[0]) & (data[2:] == PREFIX[2]) & named[data[1:-1]])
    return found[found + 3 <= at[np.searchsorted(at, found, side="right")]]


def _shifts(starts: np.ndarray, shift: np.ndarray, size: int):
    """(first byte, shifts of a span of bytes): the running sum of a difference array that is made span by span.

    Part i begins at ``starts[i]`` and moves by ``shift[i]``; of parts that begin at one place the last one counts.
    """
    diff = np.diff(shift, prepend=0)
    carry = 0
    for first in range(0, size, _SPAN):
        last = min(first + _SPAN, size)
        a, b = np.searchsorted(starts, [first, last])
        span = np.zeros(last - first, np.int64)
        np.add.at(span, starts[a:b] - first, diff[a:b])
        span[0] += carry
        np.cumsum(span, out=span)
        carry = int(span[-1])
        yield first, span


def _places(form: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(where the parts of each text stand in its output, the output's length); lengths: of prefix, middle, suffix."""
    at = np.zeros_like(lengths)
    for f, order in _ORDER.items():
        rows = form == f
        by_place = lengths[rows][:, np.argsort(order)] + 3
        before = np.cumsum(by_place, axis=1) - by_place + 3
        at[rows] = before[:, order]
    size = lengths.sum(axis=1) + 9 * (form != _PLAIN)
    plain = form == _PLAIN
    at[plain] = np.cumsum(lengths[plain], axis=1) - lengths[plain]
    return at, size


def transform_block(texts: list[bytes], hashes: np.ndarray, rate: int = RATE, spm_rate: int = SPM_RATE) -> dict[str, object]:
    """Outputs, forms, token counts and the parts' lengths in bytes and characters; ``hashes``: four numbers a text."""
    data, at = _joined(texts)
    ends = token_ends(data, at)
    first = np.searchsorted(ends, at[:-1], side="right")
    n = np.searchsorted(ends, at[1:], side="right") - first
    form = np.where(hashes[:, 2] % 100 >= rate, _PLAIN, np.where(hashes[:, 3] % 100 < spm_rate, _SPM, _PSM))
    form[np.searchsorted(at, sentinels(data, at), side="right") - 1] = _PLAIN
    form[at[1:] == at[:-1]] = _PLAIN
    cuts = np.sort(hashes[:, :2] % (n[:, None] + 1), axis=1)
    # a cut after no token is where the text begins
    places = np.where(cuts > 0, ends[np.minimum(first[:, None] + cuts - 1, len(ends) - 1)] if len(ends) else 0, at[:-1, None])
    starts = np.column_stack([at[:-1], places])
    lengths = np.diff(np.column_stack([starts, at[1:]]), axis=1)
    inside, size = _places(form, lengths)
    begin = np.cumsum(size) - size
    out = np.empty(int(size.sum()), np.uint8)
    target = begin[:, None] + inside
    for j, mark in enumerate((PREFIX, MIDDLE, SUFFIX)):
        for i, byte in enumerate(mark):
            out[target[form != _PLAIN, j] - 3 + i] = byte
    for at_byte, shift in _shifts(starts.ravel(), (target - starts).ravel(), len(data)):
        span = np.arange(at_byte, at_byte + len(shift))
        out[span + shift] = data[at_byte : at_byte + len(shift)]
    chars = np.zeros(lengths.shape, np.int64)
    some = lengths > 0
    if some.any():
        # the parts that have bytes follow each other without gaps, so each sum ends where the next part begins
        chars[some] = np.add.reduceat((data & 0xC0) != 0x80, starts[some], dtype=np.int64)
    return {"n": n, "form": form, "output": _cut(out, begin, size), "lengths": lengths, "chars": chars}


def _cut(data: np.ndarray, begin: np.ndarray, size: np.ndarray) -> pa.Array:
    """The texts of a block as an Arrow array over its bytes."""
    offsets = np.append(begin, begin[-1] + size[-1] if len(begin) else 0).astype(np.int64)
    return pa.Array.from_buffers(pa.large_utf8(), len(begin), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data)])


def restore_block(outputs: list[bytes], form: np.ndarray) -> pa.Array:
    """The texts that these outputs were made of, from the outputs and their forms only."""
    data, at = _joined(outputs)
    marks = sentinels(data, at)
    owner = np.searchsorted(at, marks, side="right") - 1
    marks = marks[form[owner] != _PLAIN]
    cut = form != _PLAIN
    if len(marks) != 3 * cut.sum():
        raise ValueError("an output doesn't hold its three sentinels once each")
    # where each part's bytes begin in the output, by place, then by part
    by_place = marks.reshape(-1, 3)
    if by_place.size and not ((by_place >= at[:-1][cut, None]) & (by_place < at[1:][cut, None])).all():
        raise ValueError("an output doesn't hold its three sentinels once each")
    starts_by_place = by_place + 3
    lengths_by_place = np.column_stack([by_place[:, 1:], at[1:][cut]]) - starts_by_place
    source = np.column_stack([at[:-1]] * 3)
    lengths = np.column_stack([np.diff(at), np.zeros((len(outputs), 2), np.int64)]) if len(outputs) else np.zeros((0, 3), np.int64)
    order = np.array([_ORDER.get(f, (0, 1, 2)) for f in form[cut].tolist()], np.int64).reshape(-1, 3)
    source[cut] = np.take_along_axis(starts_by_place, order, axis=1)
    lengths[cut] = np.take_along_axis(lengths_by_place, order, axis=1)
    names = data[source[cut] - 2] if cut.any() else np.zeros((0, 3), np.uint8)
    if not (names == np.array([PREFIX[1], MIDDLE[1], SUFFIX[1]], np.uint8)).all():
        raise ValueError("an output's sentinels don't stand in the order of its form")
    size = lengths.sum(axis=1)
    begin = np.cumsum(size) - size
    starts = begin[:, None] + np.cumsum(lengths, axis=1) - lengths
    out = np.empty(int(size.sum()), np.uint8)
    for at_byte, shift in _shifts(starts.ravel(), (source - starts).ravel(), len(out)):
        out[at_byte : at_byte + len(shift)] = data[np.arange(at_byte, at_byte + len(shift)) + shift]
    return _cut(out, begin, size)


def _hash(key: Column, seed: int) -> Column:
    return F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)


def transform(docs: DataFrame, *, key: str = "doc_id", text: str = "text", seed: int = SEED, rate: int = RATE, spm_rate: int = SPM_RATE) -> DataFrame:
    """key, n (tokens), form, output, and the parts' lengths in characters (null if plain) of each row.

    ``rate`` percent of the rows are cut, ``spm_rate`` percent of these have their suffix first.
    """
    ship(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()

    def run(keys, texts):
        hashes = np.array([np.frombuffer(bytes.fromhex(h[:32]), ">u4") for h in keys[1].to_pylist()]).astype(np.int64).reshape(-1, 4)
        got = transform_block([t or b"" for t in texts], hashes, rate, spm_rate)
        plain = got["form"] == _PLAIN
        parts = [pa.array(got["chars"][:, j], mask=plain) for j in range(3)]
        return [keys[0], got["n"], pa.array(FORMS).take(pa.array(got["form"])), got["output"].cast(pa.string()), *parts]

    source = docs.select(F.col(f"`{key}`").alias("k"), F.col(f"`{text}`").alias("t"), _hash(F.col(f"`{key}`"), seed).alias("h"))
    out = map_texts(source, ["k", "h"], "t", run, f"k {kind}, n long, form string, output string, prefix_chars long, middle_chars long, suffix_chars long")
    return out.withColumnRenamed("k", key)


def restore(df: DataFrame, *, output: str = "output", form: str = "form", name: str = "restored") -> DataFrame:
    """``df`` with the text that each output was made of, from its output and form.

    A form that isn't known, and an output without its sentinels in their order, are errors. A null output is empty.
    """
    ship(df.sparkSession)
    if name in df.columns:
        raise ValueError(f"a column {name!r} is there already")
    others = [c for c in df.columns if c != output]
    kinds = ", ".join(f"`c{i}` {df.schema[c].dataType.simpleString()}" for i, c in enumerate(others))
    where = others.index(form)

    def run(keys, texts):
        forms = np.array([FORMS.index(f) for f in keys[where].to_pylist()], np.int64)
        return [*keys, pa.array(texts, pa.binary()).cast(pa.string()), restore_block([t or b"" for t in texts], forms).cast(pa.string())]

    out = map_texts(df, others, output, run, f"{kinds}{', ' if kinds else ''}o string, r string")
    return out.toDF(*others, output, name).select(*[F.col(f"`{c}`") for c in (*df.columns, name)])


def contract(docs: DataFrame) -> DataFrame:
    out = restore(transform(docs))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))
