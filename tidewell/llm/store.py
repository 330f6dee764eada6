"""Token ids in a content-addressed store.

``write_store`` encodes whole texts and cuts each id stream where a rolling hash of
the last ids says so, so that equal passages give equal chunks wherever they stand.
A store is a folder of Parquet tables:

* ``chunks``   digest binary(16), width int, payload binary: each distinct chunk once; ``width`` is 2 bytes an id if all ids of the chunk fit, else 4, and is part of what the digest covers;
* ``recipes``  part, key, start_in_part, n_tokens, digests, sizes, root, crc32: one row per document in ascending key order; ``root`` is the Merkle root of its chunks, each leaf being a digest and its number of ids;
* ``manifest`` part, n_docs, n_tokens, root: one row per recipe file, ``root`` the Merkle root of its documents' roots.

Null and empty texts have only the end id. Rows with the same key keep their own
recipes, in order of their checksums. Null keys come first. Extra columns are ignored.
An empty table gives an empty store.
"""

from __future__ import annotations

import zlib
from hashlib import blake2b
from operator import sub

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewell.llm.arrow import map_texts
from tidewell.llm.bpe import encoder, with_end
from tidewell.session import delete, ship

#: A chunk ends where MASK_BITS bits of the rolling hash are zero, but within these sizes.
MASK_BITS, LEAST, MOST, WINDOW = 7, 64, 1024, 8
_MULT = np.uint64(0x9E3779B97F4A7C15)


def digest(data: bytes) -> bytes:
    return blake2b(data, digest_size=16).digest()


def name_of(payload: bytes, width: int) -> bytes:
    """The digest of a chunk. The width is in it, as the same bytes are other ids under another one."""
    return blake2b(payload, digest_size=16, salt=bytes([width])).digest()


def leaf(name: bytes, size: int) -> bytes:
    """A chunk of a recipe: its digest and how many ids it has."""
    return digest(b"\0" + name + size.to_bytes(4, "little"))


def merkle(leaves: list[bytes]) -> bytes:
    """Root of a binary tree; an odd node at the end of a level moves up as it is."""
    level = leaves or [digest(b"")]
    while len(level) > 1:
        level = [digest(b"\1" + level[i] + level[i + 1]) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0]


class Tree:
    """The same root from leaves one after the other, with one node a level."""

    def __init__(self):
        self.nodes: list[bytes | None] = []

    def add(self, leaf: bytes) -> None:
        for i, x in enumerate(self.nodes):
            if x is None:
                self.nodes[i] = leaf
                return
            leaf, self.nodes[i] = digest(b"\1" + x + leaf), None
        self.nodes.append(leaf)

    def root(self) -> bytes:
        right = None
        for x in self.nodes:
            if x is not None:
                right = x if right is None else digest(b"\1" + x + right)
        return digest(b"") if right is None else right


def cuts(ids: np.ndarray) -> np.ndarray:
    """Positions after which the rolling hash allows a cut."""
    h = (ids.astype(np.uint64) + np.uint64(1)) * _MULT
    h ^= h >> np.uint64(31)
    weight, n = 0xBF58476D1CE4E5B9, 1
    while n < WINDOW:  # sums over twice as many ids in each turn
        if n < len(h):
            h[n:] = h[n:] + h[:-n] * np.uint64(weight)
        weight, n = weight * weight & (1 << 64) - 1, 2 * n
    return np.flatnonzero(h < np.uint64(1 << 64 - MASK_BITS)) + 1


def bounds(length: int, allowed: np.ndarray) -> list[int]:
    """Ends of the chunks of one document; ``allowed`` are its cut positions from its start."""
    out, at = [], 0
    for c in allowed.tolist():
        while c - at > MOST:
            at += MOST
            out.append(at)
        if c - at >= LEAST and c < length:
            out.append(c)
            at = c
    while length - at > MOST:
        at += MOST
        out.append(at)
    out.append(length)
    return out


_STAGED = "key long, n_tokens long, crc32 long, root binary, digests array<binary>, sizes array<int>, fresh array<struct<digest:binary,width:int,payload:binary>>"


def _encode(path: str, end: int):
    def run(keys, texts):
        ids, counts = with_end(*encoder(path).encode(texts), end)
        stops = np.cumsum(counts)
        allowed = cuts(ids)
        split = np.searchsorted(allowed, stops)
        raw, seen = memoryview(ids.astype("<u4")).cast("B"), set()
        small = memoryview(ids.astype("<u2")).cast("B")
        large = np.flatnonzero(ids > 0xFFFF)
        crcs, roots, digests, sizes, fresh = [], [], [], [], []
        first, low = 0, 0
        for stop, high in zip(stops.tolist(), split.tolist()):
            ends = bounds(stop - first, allowed[low:high] - first)
            names, mine, at = [], [], first
            for e in ends:
                wide = len(large) and np.searchsorted(large, at) < np.searchsorted(large, first + e)
                payload, width = (raw[4 * at : 4 * (first + e)], 4) if wide else (small[2 * at : 2 * (first + e)], 2)
                name = name_of(payload, width)
                names.append(name)
                if name not in seen:
                    seen.add(name)
                    mine.append({"digest": name, "width": width, "payload": bytes(payload)})
                at = first + e
            crcs.append(zlib.crc32(raw[4 * first : 4 * stop]))
            counted = list(map(sub, ends, [0, *ends]))
            roots.append(merkle(list(map(leaf, names, counted))))
            digests.append(names)
            sizes.append(counted)
            fresh.append(mine)
            first, low = stop, high
        return [keys[0], counts, crcs, roots, digests, sizes, fresh]

    return run


def _recipes(batches):
    """Adds the part and the start in it to rows in order; no more than one row of state."""
    part, total = TaskContext.get().partitionId(), 0
    for b in batches:
        n = b.column("n_tokens").to_numpy(zero_copy_only=False)
        start = total + np.cumsum(n) - n
        total += int(n.sum())
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), part), pa.int32()), b.column("key"), pa.array(start, pa.int64()), *[b.column(c) for c in ("n_tokens", "crc32", "root", "digests", "sizes")]], names=["part", "key", "start_in_part", "n_tokens", "crc32", "root", "digests", "sizes"])


def _manifest(batches):
    tree, part, docs, tokens = Tree(), None, 0, 0
    for b in batches:
        for p, n, root in zip(*[b.column(c).to_pylist() for c in ("part", "n_tokens", "root")]):
            if part is not None and p != part:
                yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "n_docs": [docs], "n_tokens": [tokens], "root": pa.array([tree.root()], pa.binary())})
                tree, docs, tokens = Tree(), 0, 0
            part, docs, tokens = p, docs + 1, tokens + n
            tree.add(root)
    if part is not None:
        yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "n_docs": [docs], "n_tokens": [tokens], "root": pa.array([tree.root()], pa.binary())})


_MANIFEST = "part int, n_docs long, n_tokens long, root binary"


def _roots(recipes: DataFrame) -> DataFrame:
    return recipes.select("part", "start_in_part", "n_tokens", "root").repartition("part").sortWithinPartitions("part", "start_in_part").mapInArrow(_manifest, _MANIFEST)


def write_store(docs: DataFrame, path: str, *, tokenizer: str, end_id: int, key: str = "doc_id", text: str = "text") -> None:
    """Encode ``docs`` and write its store below ``path``, a folder that all executors share.

    Texts are encoded once, into a staging table whose columns feed both the recipes and
    the chunks; it goes when the store stands, or on a failure. A block of texts (8 MB) has each
    chunk once, and a task sends each once, as one row of a digest stays before the shuffle and after it.
    """
    spark = docs.sparkSession
    ship(spark)
    staged = f"{path}/_staged"
    try:
        map_texts(docs.withColumn(key, F.col(f"`{key}`").cast("long")), [key], text, _encode(tokenizer, end_id), _STAGED).write.option("compression", "zstd").parquet(staged)
        rows = spark.read.parquet(staged)
        fresh = rows.select(F.explode("fresh").alias("c")).select("c.*")
        fresh.dropDuplicates(["digest"]).write.option("compression", "zstd").parquet(f"{path}/chunks")
        recipe = rows.drop("fresh").repartitionByRange("key").sortWithinPartitions("key", "crc32", "root")
        recipe.mapInArrow(_recipes, "part int, key long, start_in_part long, n_tokens long, crc32 long, root binary, digests array<binary>, sizes array<int>").write.option("compression", "zstd").parquet(f"{path}/recipes")
    finally:
        delete(spark, staged)
    _roots(spark.read.parquet(f"{path}/recipes")).write.parquet(f"{path}/manifest")


def starts(spark: SparkSession, path: str) -> DataFrame:
    """Recipes with ``start``, the ids before them in the store. The manifest has a row per recipe file.

    A row of the manifest that the recipes don't bear out, or a part that it lacks, is an error.
    """
    found = _roots(spark.read.parquet(f"{path}/recipes")).select("part", F.struct("n_docs", "n_tokens", "root").alias("found"))
    m = spark.read.parquet(f"{path}/manifest").join(F.broadcast(found), "part", "full")
    borne = F.struct("n_docs", "n_tokens", "root").eqNullSafe(F.col("found"))
    m = m.withColumn("n_tokens", F.when(borne, F.col("n_tokens")).otherwise(F.raise_error(F.concat(F.lit("the manifest isn't that of the recipes, part "), F.col("part").cast("string")))))
    before = F.coalesce(F.sum("n_tokens").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    m = m.select("part", before.alias("before"))
    r = spark.read.parquet(f"{path}/recipes")
    return r.join(F.broadcast(m), "part").withColumn("start", F.col("before") + F.col("start_in_part")).drop("before")


def _check_chunks(batches):
    """Digest, size and CRC-32 of each chunk from its stored payload; a payload that isn't its digest's is an error."""
    for b in batches:
        n, crc = [], []
        for name, width, payload in zip(*[b.column(i).to_pylist() for i in range(3)]):
            if name_of(payload, width) != name:
                raise ValueError(f"chunk {name.hex()} is damaged")
            ids = np.frombuffer(payload, f"<u{width}")
            n.append(len(ids))
            crc.append(zlib.crc32(ids.astype("<u4").tobytes()))
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(crc, pa.int64())], names=["digest", "n", "crc"])


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Product of polynomials over GF(2) modulo that of CRC-32, highest bit first as x^0."""
    out = np.zeros(np.broadcast(a, b).shape, np.uint32)
    b = np.broadcast_to(b, out.shape).copy()
    for k in range(31, -1, -1):
        out ^= np.where((a >> np.uint32(k)) & np.uint32(1) == 1, b, np.uint32(0))
        b = (b >> np.uint32(1)) ^ np.where(b & np.uint32(1) == 1, np.uint32(0xEDB88320), np.uint32(0))
    return out


def shift_crc(crc: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Share of a part's CRC-32 in that of the whole, ``after`` bytes before its end; shares of all parts are xor-ed."""
    crc, power = crc.astype(np.uint32), np.uint32(0x00800000)  # x^8
    left = after.astype(np.int64)
    while left.any():
        crc = np.where(left & 1 == 1, _times(crc, power), crc)
        power = _times(np.array([power]), np.array([power]))[0]
        left = left >> 1
    return crc


#: A place of a chunk in its document: the ids after it, and in the lowest bits its own number of ids.
_SIZE_BITS = 11


def _shift(batches):
    """Each chunk's share of its document's CRC-32; a chunk that isn't as long as the recipe says is an error."""
    for b in batches:
        crc, place, n = (b.column(c).to_numpy(zero_copy_only=False) for c in ("crc", "place", "n"))
        wrong = np.flatnonzero(n != (place & (1 << _SIZE_BITS) - 1))
        if len(wrong):
            raise ValueError(f"the recipe of {b.column('key')[int(wrong[0])].as_py()} is damaged: a chunk has another size")
        share = shift_crc(crc, 4 * (place >> _SIZE_BITS)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([b.column("key"), b.column("start"), pa.array(share), b.column("n"), b.column("all_crc"), b.column("all_n")], names=["key", "start", "crc", "n", "all_crc", "all_n"])


_PLACED = "key long, start long, i int, digest binary, place long, all_crc long, all_n long"


def _placed(batches):
    """A row for each chunk of a recipe whose root is borne out; running sums are made once a recipe.

    The document's own checksum and length stand in the row of its first chunk, zeros in the others.
    """
    for b in batches:
        names, sizes, n = b.column("digests"), b.column("sizes"), []
        for key, d, z, root, total in zip(*[b.column(c).to_pylist() for c in ("key", "digests", "sizes", "root", "n_tokens")]):
            if len(d) != len(z) or merkle(list(map(leaf, d, z))) != root:
                raise ValueError(f"the recipe of {key} is damaged")
            if sum(z) != total:
                raise ValueError(f"the recipe of {key} is damaged: it has another length")
            n.append(len(d))
        n = np.array(n, np.int64)
        row = np.repeat(np.arange(len(b)), n)
        size = sizes.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        upto = np.cumsum(size)
        last = np.cumsum(n) - 1
        after = upto[last][row] - upto
        first = np.zeros(len(row), bool)
        first[last - n + 1] = True
        take = lambda c: b.column(c).take(pa.array(row))
        only = lambda c: pa.array(np.where(first, take(c).to_numpy(zero_copy_only=False), 0))
        i = np.arange(len(row)) - (last - n + 1)[row]
        yield pa.RecordBatch.from_arrays([take("key"), take("start"), pa.array(i, pa.int32()), names.flatten(), pa.array(after << _SIZE_BITS | size), only("crc32"), only("n_tokens")], names=["key", "start", "i", "digest", "place", "all_crc", "all_n"])


def _chunks_of(spark: SparkSession, path: str) -> DataFrame:
    return starts(spark, path).select("key", "start", "n_tokens", "crc32", "digests", "sizes", "root").mapInArrow(_placed, _PLACED)


def summarise(spark: SparkSession, path: str) -> DataFrame:
    """key, start, n_tokens, ids_crc32 of each document, from the files alone.

    Every chunk is read once and checked against its digest, every recipe against its Merkle root, every root of the manifest
    against those of its recipes, every chunk's length against the recipes that name it, and each document's length and checksum,
    put together from its chunks', against those that its recipe has from the encoder. Any difference is an error. Payloads
    aren't shuffled; only digests are. A digest that many recipes name is a skewed join key, whose
    partitions Spark splits, as the other side has each digest once.
    """
    ship(spark)
    chunks = spark.read.parquet(f"{path}/chunks").select("digest", "width", "payload").mapInArrow(_check_chunks, "digest binary, n long, crc long")
    whole = _chunks_of(spark, path).drop("i").join(chunks, "digest", "left").withColumn("crc", F.when(F.col("crc").isNull(), F.raise_error(F.lit("a chunk is missing"))).otherwise(F.col("crc")))
    found = whole.mapInArrow(_shift, "key long, start long, crc long, n long, all_crc long, all_n long").groupBy("key", "start").agg(F.sum("n").alias("n_tokens"), F.bit_xor("crc").alias("ids_crc32"), F.sum("all_crc").alias("all_crc"), F.sum("all_n").alias("all_n"))
    same = (F.col("ids_crc32") == F.col("all_crc")) & (F.col("n_tokens") == F.col("all_n"))
    wrong = F.raise_error(F.concat(F.lit("the chunks of "), F.coalesce(F.col("key").cast("string"), F.lit("null")), F.lit(" aren't those of its checksum")))
    return found.select("key", "start", "n_tokens", F.when(same, F.col("ids_crc32")).otherwise(wrong).alias("ids_crc32"))


def _decode(batches):
    for b in batches:
        ids = [np.frombuffer(p, f"<u{w}").astype(np.int32) for w, p in zip(b.column("width").to_pylist(), b.column("payload").to_pylist())]
        yield pa.RecordBatch.from_arrays([b.column("digest"), pa.array(ids, pa.list_(pa.int32()))], names=["digest", "ids"])


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """key, start, ids array<int> of each document, put together from its chunks in order."""
    ship(spark)
    chunks = spark.read.parquet(f"{path}/chunks").mapInArrow(_decode, "digest binary, ids array<int>")
    parts = _chunks_of(spark, path).select("key", "start", "i", "digest", "all_n")
    whole = parts.join(chunks, "digest", "left").groupBy("key", "start").agg(F.sort_array(F.collect_list(F.struct("i", "ids"))).alias("c"), F.sum("all_n").alias("n"))
    ids = F.flatten("c.ids")
    wrong = F.raise_error(F.concat(F.lit("chunks are missing of "), F.coalesce(F.col("key").cast("string"), F.lit("null"))))
    return whole.select("key", "start", F.when(F.size(ids) == F.col("n"), ids).otherwise(wrong).alias("ids"))


def verify_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Rows of the manifest that the recipes don't bear out; none if the store is whole."""
    ship(spark)
    return spark.read.parquet(f"{path}/manifest").exceptAll(_roots(spark.read.parquet(f"{path}/recipes")))
