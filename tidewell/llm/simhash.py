"""SimHash of whole texts, and classes of texts whose fingerprints differ in few bits.

1. A text's words, lower-cased, make shingles of three; a bit of its fingerprint is set if more
   than half of the shingles' XXH64 hashes have it, repeats included. Texts of fewer words are
   one shingle; texts without words have fingerprint zero and are linked like any other.
2. Each different fingerprint gets some 32 keys by the Golay code (``golay``), of which two
   fingerprints at most three bits apart share at least one.
3. Fingerprints of a key meet in a task that has them in the key's order. It keeps up to ``MOST``
   of a key and links them exactly: each fingerprint is compared with those that aren't reached
   yet, and only links to new ones are given, so a key gives fewer links than it has fingerprints
   and no pairs leave the task. A longer key's fingerprints are dealt anew by the key and one of four parts
   of the bits that the key leaves free, one of which is equal in any two that are near, until keys are
   short enough; as every turn fixes more bits, that ends.
4. Classes are the connected components of the links.

Null texts are empty. Rows without an id are in the class of their text; a class whose rows all
lack ids has no name. Repeated ids and rows stay rows of their own. Texts of any length are read in
spans. An empty table gives no rows. Extra columns don't matter.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm import golay
from tidewell.llm.arrow import map_texts
from tidewell.llm.neardup import components
from tidewell.session import cut, delete, scratch, ship

SHINGLE, SEED = 3, 42
#: Fingerprints of a key that a task holds and compares.
MOST = 1 << 14
_SPAN = 1 << 20
#: ASCII capitals to small letters; other bytes stay.
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_SPACES = b" \t\n\x0b\x0c\r"


def _spans(text: bytes):
    """Parts of a text of about ``_SPAN`` bytes that end at white space."""
    at = 0
    while at < len(text):
        end = at + _SPAN
        while end < len(text) and text[end] not in _SPACES:
            end += 1
        yield text[at:end]
        at = end


def hashes(text: bytes, size: int = SHINGLE, seed: int = SEED):
    """XXH64 hashes of a text's shingles, an array for each span."""
    before: list[bytes] = []
    one, any_yet = xxhash.xxh64_intdigest, False
    for span in _spans(text):
        words = before + span.translate(_LOWER).split()
        if len(words) >= size:
            any_yet = True
            ends = np.cumsum([len(w) + 1 for w in words]).tolist()
            joined = b" ".join(words)
            yield np.fromiter([one(joined[a : b - 1], seed) for a, b in zip([0, *ends], ends[size - 1 :])], np.uint64)
            words = words[len(words) - size + 1 :]
        before = words
    if before and not any_yet:
        yield np.array([one(b" ".join(before), seed)], np.uint64)


def _spread() -> np.ndarray:
    """The eight bits of each byte value, highest first, as eight bytes of a number."""
    return np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).view(np.uint64).ravel()


_SPREAD = _spread()


def _bit_counts(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """How many of each run of hashes have each bit; bits are summed as bytes of numbers, at most 255 at a time."""
    pieces = -(-sizes // 255)
    run = np.repeat(np.arange(len(sizes)), pieces)
    place = np.arange(len(run)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    starts = (np.cumsum(sizes) - sizes)[run] + 255 * place
    sums = np.add.reduceat(_SPREAD[hashes.astype(">u8").view(np.uint8).reshape(-1, 8)], starts, axis=0).view(np.uint8)
    return np.add.reduceat(sums, np.cumsum(pieces) - pieces, axis=0, dtype=np.int64)


def fingerprints_of(texts: list[bytes], size: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    """The unsigned fingerprint of each text."""
    counts, n = np.zeros((len(texts), 64), np.int64), np.zeros(len(texts), np.int64)
    held, owners, rows = [], [], 0

    def add_up():
        if held:
            sizes = np.array([len(h) for h in held])
            counts[owners] += _bit_counts(np.concatenate(held), sizes)
            n[owners] += sizes

    for i, text in enumerate(texts):
        for h in hashes(text, size, seed):
            if rows > 100_000 or owners and owners[-1] == i:
                add_up()
                held, owners, rows = [], [], 0
            held.append(h)
            owners.append(i)
            rows += len(h)
    add_up()
    return np.packbits(2 * counts > n[:, None], axis=1).view(">u8").ravel().astype(np.uint64)


def fingerprints(docs: DataFrame, *, key: str = "doc_id", text: str = "text", size: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """key, fingerprint (a long of its 64 bits) of each row."""
    ship(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()
    out = map_texts(docs, [key], text, lambda keys, texts: [keys[0], fingerprints_of([t or b"" for t in texts], size, seed).view(np.int64)], f"k {kind}, fingerprint long")
    return out.withColumnRenamed("k", key)


def _keyed(batches):
    for b in batches:
        prints = b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
        for first in range(0, len(prints), 4096):
            some = prints[first : first + 4096]
            keys, owner = golay.keys(some)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(some[owner].view(np.int64)), pa.array(np.zeros(len(keys), np.int64))], names=["key", "f", "fixed"])


def forest(prints: np.ndarray, distance: int = golay.DISTANCE) -> tuple[np.ndarray, np.ndarray]:
    """Links (a, b) between different fingerprints that join all that are near, fewer than there are fingerprints."""
    rest, a, b = prints, [], []
    while len(rest):
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            x = queue.pop()
            near = np.bitwise_count(rest ^ x) <= distance
            if near.any():
                found = rest[near]
                rest = rest[~near]
                a += [x] * len(found)
                b += found.tolist()
                queue += list(found)
    return np.array(a, np.uint64), np.array(b, np.uint64)


#: What a key's choice of blocks fixes: the bits of the blocks that are equal.
_FIXED = [sum(((1 << golay.BLOCKS[j]) - 1) << sum(golay.BLOCKS[:j]) for j in equal) for equal, _ in golay.PAIRS]


def _parts(fixed: int) -> list[int]:
    """Four masks that share out the bits that aren't fixed."""
    free = [i for i in range(64) if not fixed >> i & 1]
    return [sum(1 << i for i in free[j::4]) for j in range(4)]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(31)) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ x >> np.uint64(29)


def _dealt(key: int, fixed: int, prints: np.ndarray) -> pa.RecordBatch:
    """The fingerprints of a long key by its four parts, each with a key of its own."""
    key_now = np.uint64(key & 0xFFFFFFFFFFFFFFFF)
    keys = [(_mixed(_mixed(prints & np.uint64(m)) ^ key_now) & np.uint64(0xFFFFFFFFFFFFFFFC)) | np.uint64(j) for j, m in enumerate(_parts(fixed))]
    more = np.repeat(np.array([fixed | m for m in _parts(fixed)], np.uint64), len(prints))
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.tile(prints, 4).view(np.int64)), pa.nulls(4 * len(prints), pa.int64()), pa.array(more.view(np.int64))], names=["key", "a", "b", "fixed"])


def _linked(most: int, first_turn: bool):
    """Links of each key's fingerprints, which follow one another over batches; a longer key's fingerprints come back dealt anew, with b null."""

    def run(batches):
        key, fixed, held, size, long_key = None, 0, [], 0, False

        def done():
            if size > 1 and not long_key:
                a, b = forest(np.unique(np.concatenate(held)))
                if len(a):
                    n = len(a)
                    return pa.RecordBatch.from_arrays([pa.nulls(n, pa.int64()), pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), pa.nulls(n, pa.int64())], names=["key", "a", "b", "fixed"])

        for batch in batches:
            keys = batch.column(0).to_numpy(zero_copy_only=False)
            prints = batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)
            starts = np.append(np.flatnonzero(np.diff(keys, prepend=keys[:1] - 1 if len(keys) else 0)), len(keys))
            for first, last in zip(starts[:-1].tolist(), starts[1:].tolist()):
                if int(keys[first]) != key:
                    got = done()
                    if got is not None:
                        yield got
                    key, held, size, long_key = int(keys[first]), [], 0, False
                    fixed = _FIXED[key >> 34] if first_turn else int(batch.column(2)[first].as_py()) & 0xFFFFFFFFFFFFFFFF
                held.append(prints[first:last])
                size += last - first
                if long_key or size > most:
                    long_key = True
                    for some in held:
                        yield _dealt(key, fixed, some)
                    held = []
        got = done()
        if got is not None:
            yield got

    return run


def links(prints: DataFrame, most: int = MOST) -> DataFrame:
    """(a, b): links that connect all fingerprints of ``prints`` (one long column, no repeats) at most three bits apart."""
    spark = prints.sparkSession
    ship(spark)
    schema = "key long, f long, fixed long"
    keyed, found, turn = prints.mapInArrow(_keyed, schema), [], 0
    while True:
        out = cut(keyed.repartition("key").sortWithinPartitions("key").mapInArrow(_linked(most, turn == 0), "key long, a long, b long, fixed long"))
        found.append(out.where("b is not null").select("a", "b"))
        rest = out.where("b is null")
        if rest.isEmpty():
            break
        keyed, turn = rest.select("key", F.col("a").alias("f"), "fixed"), turn + 1
    every = found[0]
    for df in found[1:]:
        every = every.union(df)
    return every


def classes(docs: DataFrame, *, key: str = "doc_id", text: str = "text", most: int = MOST) -> DataFrame:
    """key, fingerprint, component_id of each row: the least id of the rows that links of at most three bits reach."""
    spark = docs.sparkSession
    path = scratch(spark, "simhash")
    fingerprints(docs, key=key, text=text).select(F.col(f"`{key}`").alias("k"), "fingerprint").write.parquet(path)
    try:
        rows = spark.read.parquet(path)
        # a fingerprint that many rows share is met by partial sums
        least = cut(rows.groupBy("fingerprint").agg(F.min("k").alias("k")))
        labels = components(links(least.select("fingerprint"), most))
        named = least.join(labels.withColumnRenamed("v", "fingerprint"), "fingerprint", "left").select("fingerprint", "k", F.coalesce("label", "fingerprint").alias("label"))
        ids = named.groupBy("label").agg(F.min("k").alias("component_id"))
        return cut(rows.join(named.drop("k").join(ids, "label"), "fingerprint", "left").select(F.col("k").alias(key), "fingerprint", "component_id"))
    finally:
        delete(spark, path)


def contract(docs: DataFrame) -> DataFrame:
    return classes(docs).select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")
