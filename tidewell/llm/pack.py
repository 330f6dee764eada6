"""Packing token streams into sequences: first-fit decreasing in randomised groups.

A document's ids are cut into pieces of a full sequence and a rest. A full piece is a
sequence by itself. Rests are dealt by a hash of their places into groups of about
``group_rows``, and each group is packed on its own: pieces in descending order go to the
first bin with room, found in a tournament tree of the bins' free room. Only (key, start,
length, checksum) of a rest is shuffled, never ids. Groups are dealt by places, not by
keys, so a key, null or a text that many rows share is spread over all groups.

A null or empty text is its end id alone. Documents with the same key are packed one by
one. An empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.arrow import map_texts
from tidewell.llm.bpe import encoder, with_end
from tidewell.session import cut, ship

GROUP_ROWS = 4096
#: Sequence ids of full pieces begin here; those of groups are less.
_FULL = 1 << 62


class Tournament:
    """Free room of bins in a binary tree whose inner nodes hold the most room below them."""

    def __init__(self, bins: int, room: int):
        self.leaves = 1 << max(0, bins - 1).bit_length()
        self.most = [room] * (2 * self.leaves)

    def first(self, need: int) -> int:
        """The first bin with at least that room; takes the room."""
        most, i = self.most, 1
        while i < self.leaves:
            i *= 2
            if most[i] < need:
                i += 1
        bin_ = i - self.leaves
        most[i] -= need
        while i > 1:
            i //= 2
            most[i] = max(most[2 * i], most[2 * i + 1])
        return bin_


def first_fit_decreasing(lengths: list[int], room: int) -> list[tuple[int, int]]:
    """(bin, offset) of each length. Equal lengths go in the given order."""
    tree, used = Tournament(max(1, len(lengths)), room), {}
    out: list[tuple[int, int]] = [(0, 0)] * len(lengths)
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        b = tree.first(lengths[i])
        out[i] = (b, used.get(b, 0))
        used[b] = used.get(b, 0) + lengths[i]
    return out


def _pieces(path: str, end: int, room: int):
    def run(keys, texts):
        ids, counts = with_end(*encoder(path).encode(texts), end)
        raw = memoryview(ids.astype("<u4")).cast("B")
        row, start, length, crc, first = [], [], [], [], 0
        for i, n in enumerate(counts.tolist()):
            for s in range(0, n, room):
                m = min(room, n - s)
                row.append(i)
                start.append(s)
                length.append(m)
                crc.append(zlib.crc32(raw[4 * (first + s) : 4 * (first + s + m)]))
            first += n
        row = np.array(row, np.int64)
        return [keys[0].take(pa.array(row)), start, length, crc, counts[row]]

    return run


def pack(docs: DataFrame, *, tokenizer: str, end_id: int, length: int = 2048, group_rows: int = GROUP_ROWS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per piece: key, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A sequence is the pieces of one sequence_id by offset; ``sequences`` makes its ids.
    """
    spark = docs.sparkSession
    ship(spark)
    kind = docs.schema[key].dataType.simpleString()
    # pieces are kept in the shared folder, so their places don't change if a task runs again
    pieces = cut(map_texts(docs, [key], text, _pieces(tokenizer, end_id, length), f"k {kind}, start long, length long, crc long, n long"))
    full = F.col("length") == length
    groups = max(1, pieces.where(~full).count() // group_rows)
    place = F.monotonically_increasing_id()
    dealt = pieces.withColumn("place", place).where(~full).withColumn("g", F.pmod(F.xxhash64("place", F.lit(17)), F.lit(groups)).cast("int"))

    def fill(group, rows):
        rows = rows.take(pa.array(np.argsort(rows["place"].to_numpy(), kind="stable")))
        at = first_fit_decreasing(rows["length"].to_pylist(), length)
        base = group[0].as_py() << 32
        return pa.table({"k": rows["k"], "start": rows["start"], "length": rows["length"], "crc": rows["crc"], "n": rows["n"], "sequence_id": pa.array([base + b for b, _ in at], pa.int64()), "offset": pa.array([o for _, o in at], pa.int64())})

    out = dealt.groupBy("g").applyInArrow(fill, f"k {kind}, start long, length long, crc long, n long, sequence_id long, offset long")
    alone = pieces.withColumn("sequence_id", place + F.lit(_FULL)).where(full).withColumn("offset", F.lit(0).cast("long"))
    out = out.unionByName(alone)
    return out.select(F.col("k").alias(key), "start", "length", F.col("crc").alias("ids_crc32"), F.col("n").alias("doc_tokens"), "sequence_id", "offset")


def sequences(docs: DataFrame, pieces: DataFrame, *, tokenizer: str, end_id: int, length: int = 2048, pad_id: int = 0, key: str = "doc_id", text: str = "text") -> DataFrame:
    """sequence_id, ids array<int> of each packed sequence.

    Padded with ``pad_id`` up to ``length``, except a sequence whose length is a power of two.
    Keys must be unique here, as pieces name documents by them.
    """
    ship(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()

    def cut(keys, texts):
        ids, counts = with_end(*encoder(tokenizer).encode(texts), end_id)
        row, start, out, first = [], [], [], 0
        for i, n in enumerate(counts.tolist()):
            for s in range(0, n, length):
                row.append(i)
                start.append(s)
                out.append(ids[first + s : first + min(n, s + length)].astype(np.int32))
            first += n
        return [keys[0].take(pa.array(row, pa.int64())), start, out]

    parts = map_texts(docs, [key], text, cut, f"k {kind}, start long, ids array<int>")
    named = pieces.select(F.col(key).alias("k"), "start", "sequence_id", "offset")
    whole = named.join(parts, ["k", "start"]).groupBy("sequence_id").agg(F.flatten(F.sort_array(F.collect_list(F.struct("offset", "ids"))).getField("ids")).alias("ids"))
    n = F.size("ids")
    power = F.log2(n.cast("double")) == F.floor(F.log2(n.cast("double")))
    return whole.select("sequence_id", F.when(power, F.col("ids")).otherwise(F.concat("ids", F.array_repeat(F.lit(pad_id), length - n))).alias("ids"))


def contract(docs: DataFrame, tokenizer: str) -> DataFrame:
    return pack(docs, tokenizer=tokenizer, end_id=1)
