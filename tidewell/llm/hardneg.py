"""Hard negatives: for an anchor and each of its positives, the rows of other labels that are about as near.

1. Vectors become whole numbers, floor(scale * x); rows without an id, a label or a vector of finite components
   take no part. The rest is written once.
2. Anchors are a stated set of rows, in blocks of at most ``ANCHORS`` rows and ``ANCHOR_BYTES``. A block goes to all
   tasks, each of which has some of the rows. Inner products come from tiles of anchors and candidates by Strassen's
   recursion: seven half-size products for eight, with sides padded by zeros and additions of whole numbers,
   so scores are exact. Sums inside may run over 64 bits and back; scores may not, which is checked by a bound.
3. The first turn keeps a heap of positives for each anchor: the greatest scores of its own label, ties by smaller
   id. Tasks' heaps are merged by anchor. The second turn keeps a heap for each anchor and positive of the
   greatest scores of other labels inside the positive's window, merged alike.

A task holds its heaps (a few hundred bytes an anchor of the block) and one tile, whatever the number of rows. The work
grows with rows times anchors, as every row is compared with every anchor.

Rows that are repeated in full count once. Of anchors with one id and unlike rows the least row stands for the id; as
candidates they stay rows of their own, and none is a candidate for the anchor of its id. Vectors of unlike lengths are
filled up with zeros. An empty table, or one without anchors, gives no rows. Extra columns don't matter.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.session import delete, exists, scratch, ship

SCALE = 256
POSITIVES, NEGATIVES = 5, 10
#: The window in hundredths of a positive's score.
LOW, HIGH = 30, 90
#: Rows and bytes of a block of anchors.
ANCHORS, ANCHOR_BYTES = 1 << 14, 1 << 26
#: Sides up to which numbers are multiplied as they are.
LEAF = 32
_TILE, _ANCHOR_TILE = 2048, 512
#: Multiplications of a task.
_WORK = 4_000_000_000
_LEAST, _MOST = np.iinfo(np.int64).min, np.iinfo(np.int64).max
SCHEMA = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def _strassen(a: np.ndarray, b: np.ndarray, depth: int) -> np.ndarray:
    if not depth:
        return np.einsum("ik,kj->ij", a, b)
    m, k, n = a.shape[0] // 2, a.shape[1] // 2, b.shape[1] // 2
    a11, a12, a21, a22 = a[:m, :k], a[:m, k:], a[m:, :k], a[m:, k:]
    b11, b12, b21, b22 = b[:k, :n], b[:k, n:], b[k:, :n], b[k:, n:]
    p1 = _strassen(a11 + a22, b11 + b22, depth - 1)
    p2 = _strassen(a21 + a22, b11, depth - 1)
    p3 = _strassen(a11, b12 - b22, depth - 1)
    p4 = _strassen(a22, b21 - b11, depth - 1)
    p5 = _strassen(a11 + a12, b22, depth - 1)
    p6 = _strassen(a21 - a11, b11 + b12, depth - 1)
    p7 = _strassen(a12 - a22, b21 + b22, depth - 1)
    out = np.empty((2 * m, 2 * n), np.int64)
    out[:m, :n] = p1 + p4 - p5 + p7
    out[:m, n:] = p3 + p5
    out[m:, :n] = p2 + p4
    out[m:, n:] = p1 - p2 + p3 + p6
    return out


def product(a: np.ndarray, b: np.ndarray, leaf: int = LEAF) -> np.ndarray:
    """The product of two matrices of 64-bit whole numbers, exact where it fits into 64 bits."""
    (m, k), n = a.shape, b.shape[1]
    if not m * k * n:
        return np.zeros((m, n), np.int64)
    if int(np.abs(a).max()) * int(np.abs(b).max()) * k >= 2**63:
        raise OverflowError("inner products may not fit into 64 bits")
    depth = 0
    while min(m, k, n) >> depth > leaf:
        depth += 1
    pad = lambda x: np.pad(x, [(0, -s % (1 << depth)) for s in x.shape])
    return _strassen(pad(a), pad(b), depth)[:m, :n]


class Heaps:
    """The greatest ``size`` scores of each of ``rows`` heaps, with their ids; ties by smaller id, repeats once."""

    def __init__(self, rows: int, size: int):
        self.score, self.id = np.full((rows, size), _LEAST), np.full((rows, size), _MOST)

    def offer(self, row: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        if not len(row):
            return
        size = self.score.shape[1]
        touched = np.unique(row)
        there = self.score[touched].ravel() != _LEAST
        row = np.concatenate([np.repeat(touched, size)[there], row])
        score = np.concatenate([self.score[touched].ravel()[there], score])
        ids = np.concatenate([self.id[touched].ravel()[there], ids])
        order = np.lexsort([ids, -score, row])
        row, score, ids = row[order], score[order], ids[order]
        new = np.ones(len(row), bool)
        new[1:] = (row[1:] != row[:-1]) | (score[1:] != score[:-1]) | (ids[1:] != ids[:-1])
        row, score, ids = row[new], score[new], ids[new]
        first = np.flatnonzero(np.diff(row, prepend=row[0] - 1))
        rank = np.arange(len(row)) - np.repeat(first, np.diff(np.append(first, len(row))))
        some = rank < size
        self.score[touched], self.id[touched] = _LEAST, _MOST
        self.score[row[some], rank[some]], self.id[row[some], rank[some]] = score[some], ids[some]

    def offer_tile(self, rows: np.ndarray, scores: np.ndarray, ids: np.ndarray, allowed: np.ndarray) -> None:
        """Offers the allowed scores of a tile, a line of it for each of ``rows``, if they can enter."""
        size = self.score.shape[1]
        last, last_id = self.score[rows, -1:], self.id[rows, -1:]
        enters = allowed & ((scores > last) | (scores == last) & (ids < last_id))
        if np.count_nonzero(enters) > 4 * size * len(rows):
            # few can stay: those as great as the last that would, if all were offered; repeats of an id may be one entry
            most = size * int(np.unique(ids, return_counts=True)[1].max())
            if scores.shape[1] > most:
                enters &= scores >= np.partition(np.where(enters, scores, _LEAST), -most, axis=1)[:, -most, None]
        r, c = np.nonzero(enters)
        self.offer(rows[r], scores[r, c], ids[c])

    def batch(self, names: list[str]) -> pa.RecordBatch:
        """A row for each entry."""
        r, c = np.nonzero(self.score != _LEAST)
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (r, self.score[r, c], self.id[r, c])], names=names)


def _quantised(scale: float):
    def run(batches):
        for b in batches:
            lists = b.column(2)
            flat = lists.flatten().to_numpy(zero_copy_only=False)
            sizes = np.array([-1 if n is None else n for n in lists.value_lengths().to_pylist()], np.int64)
            ends = np.cumsum(np.maximum(sizes, 0))
            with np.errstate(invalid="ignore", over="ignore"):
                whole = np.floor(flat * scale)
            good = np.isfinite(flat)
            if (np.abs(whole[good]) >= 2.0**63).any():
                raise OverflowError("a scaled component doesn't fit into 64 bits")
            bad = np.zeros(len(flat) + 1, np.int64)
            np.cumsum(~good, out=bad[1:])
            keep = (sizes >= 0) & (bad[ends] == bad[ends - np.maximum(sizes, 0)])
            numbers = np.where(good, whole, 0).astype("<i8")
            q = [numbers[e - n : e].tobytes() for e, n in zip(ends[keep].tolist(), sizes[keep].tolist())]
            mask = pa.array(keep)
            yield pa.RecordBatch.from_arrays([b.column(0).filter(mask), b.column(1).filter(mask), pa.array(q, pa.binary())], names=["id", "label", "q"])

    return run


def _matrix(q: list[bytes], width: int = 0) -> np.ndarray:
    """Vectors as lines, filled up with zeros."""
    sizes = np.array([len(x) // 8 for x in q], np.int64)
    out = np.zeros((len(q), max(width, int(sizes.max(initial=0)))), np.int64)
    out[np.arange(out.shape[1]) < sizes[:, None]] = np.frombuffer(b"".join(q), "<i8")
    return out


def _scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of lines of unlike lengths: what only one side has meets zeros."""
    k = min(a.shape[1], b.shape[1])
    return product(a[:, :k], np.ascontiguousarray(b[:, :k].T))


def _tiles(batches):
    for b in batches:
        for first in range(0, len(b), _TILE):
            some = b.slice(first, _TILE)
            ids, labels = (some.column(i).to_numpy(zero_copy_only=False) for i in range(2))
            yield ids, labels, _matrix(some.column(2).to_pylist())


def _positives(shared, size: int):
    """Each task's heaps of an anchor's own label."""

    def run(batches):
        ids, labels, anchors = shared.value
        heaps = Heaps(len(ids), size)
        for tile_ids, tile_labels, tile in _tiles(batches):
            for label in np.unique(tile_labels):
                first, last = np.searchsorted(labels, label, side="left"), np.searchsorted(labels, label, side="right")
                mine = tile_labels == label
                own_ids, own = tile_ids[mine], tile[mine]
                for at in range(first, last, _ANCHOR_TILE):
                    rows = np.arange(at, min(at + _ANCHOR_TILE, last))
                    heaps.offer_tile(rows, _scores(anchors[rows], own), own_ids, ids[rows][:, None] != own_ids)
        yield heaps.batch(["row", "score", "id"])

    return run


def _windows(shared, size: int):
    """Each task's heaps of other labels, one for each anchor and positive."""

    def run(batches):
        (ids, labels, anchors), low, high = shared.value
        per = low.shape[1]
        heaps = Heaps(len(ids) * per, size)
        for tile_ids, tile_labels, tile in _tiles(batches):
            for at in range(0, len(ids), _ANCHOR_TILE):
                rows = np.arange(at, min(at + _ANCHOR_TILE, len(ids)))
                scores = _scores(anchors[rows], tile)
                other = (labels[rows][:, None] != tile_labels) & (ids[rows][:, None] != tile_ids)
                for j in range(per):
                    heaps.offer_tile(rows * per + j, scores, tile_ids, other & (scores >= low[rows, j, None]) & (scores <= high[rows, j, None]))
        yield heaps.batch(["row", "score", "id"])

    return run


def _merged(size: int):
    """The heaps of rows that stand in one task, from all tasks' heaps."""

    def run(batches):
        parts, held = [], 0

        def cut():
            row, score, ids = (np.concatenate([p[i] for p in parts]) for i in range(3))
            known, place = np.unique(row, return_inverse=True)
            heaps = Heaps(len(known), size)
            heaps.offer(place, score, ids)
            r, c = np.nonzero(heaps.score != _LEAST)
            return [known[r], heaps.score[r, c], heaps.id[r, c], c]

        for b in batches:
            parts.append([b.column(i).to_numpy(zero_copy_only=False) for i in range(3)])
            held += len(b)
            if held > 1_000_000:
                parts = [cut()]
                held = len(parts[0][0]) // 2  # so that cuts stay few, however many heaps there are
        if parts:
            yield pa.RecordBatch.from_arrays([*[pa.array(x) for x in cut()]], names=["row", "score", "id", "rank"])

    return run


def _bounds(scores: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """The least and greatest score in the windows of positives; none where there is no positive."""
    each = [(-(-low * s // 100), high * s // 100) if s != _LEAST else (_MOST, _LEAST) for s in scores.ravel().tolist()]
    return tuple(np.array([min(max(e[i], _LEAST), _MOST) for e in each], np.int64).reshape(scores.shape) for i in range(2))


def mine(
    df: DataFrame, *, anchors: Column, key: str = "vec_id", label: str = "label", vector: str = "embedding", scale: float = SCALE, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, block: int = ANCHORS
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``anchors``: a condition on the column ``id``, the key as a long.
    """
    spark = df.sparkSession
    ship(spark)
    sc, path, out = spark.sparkContext, scratch(spark, "negatives"), scratch(spark, "negatives-found")
    column = lambda name: F.col(f"`{name}`")
    source = df.select(column(key).cast("long").alias("id"), column(label).cast("long").alias("label"), column(vector).cast("array<double>").alias("v")).where("id is not null and label is not null and v is not null")
    try:
        source.mapInArrow(_quantised(scale), "id long, label long, q binary").write.parquet(f"{path}/rows")
        rows = spark.read.parquet(f"{path}/rows")
        chosen = rows.where(anchors).groupBy("id").agg(F.min(F.struct("label", "q")).alias("m")).select("id", "m.label", "m.q")
        size = rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.length("q")).alias("width")).first()
        found = chosen.agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("q")).alias("bytes")).first()
        n_blocks = max(-(-found.n // block), -(-(found.bytes or 0) // ANCHOR_BYTES))
        chosen.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(max(n_blocks, 1)))).write.partitionBy("block").parquet(f"{path}/anchors")
        for b in range(n_blocks):
            if not exists(spark, f"{path}/anchors/block={b}"):
                continue
            some = spark.read.schema("id long, label long, q binary").parquet(f"{path}/anchors/block={b}").toArrow()
            order = np.lexsort([some["id"].to_numpy(), some["label"].to_numpy()])
            ids, labels, matrix = some["id"].to_numpy()[order], some["label"].to_numpy()[order], _matrix(some["q"].to_pylist())[order]
            work = size.n * len(ids) * max(size.width // 8, 1)
            dealt = rows.repartition(max(sc.defaultParallelism, -(-work // _WORK)), "id")
            shared = sc.broadcast((ids, labels, matrix))
            tops = dealt.mapInArrow(_positives(shared, positives), "row long, score long, id long").repartition("row").mapInArrow(_merged(positives), "row long, score long, id long, rank long").toArrow()
            score, pos = np.full((len(ids), positives), _LEAST), np.full((len(ids), positives), _MOST)
            at = tops["row"].to_numpy(), tops["rank"].to_numpy()
            score[at], pos[at] = tops["score"].to_numpy(), tops["id"].to_numpy()
            windows = sc.broadcast(((ids, labels, matrix), *_bounds(score, low, high)))
            names = sc.broadcast((ids, pos, score))
            best = dealt.mapInArrow(_windows(windows, negatives), "row long, score long, id long").repartition("row").mapInArrow(_merged(negatives), "row long, score long, id long, rank long")
            best.mapInArrow(_named(names, positives), SCHEMA).write.parquet(f"{out}/block={b}")
            for x in (shared, windows, names):
                x.destroy()
    finally:
        delete(spark, path)
    return spark.read.schema(SCHEMA).parquet(f"{out}/*") if found.n else spark.createDataFrame([], SCHEMA)


def _named(shared, per: int):
    def run(batches):
        ids, pos, score = shared.value
        for b in batches:
            row, found, neg, rank = (b.column(i).to_numpy(zero_copy_only=False) for i in range(4))
            a, j = row // per, row % per
            columns = [ids[a], pos[a, j], (rank + 1).astype(np.int32), neg, score[a, j], found]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"])

    return run


def contract(embeddings: DataFrame) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(embeddings.select("vec_id", moved.alias("label"), "embedding"), anchors=F.col("id") % 100 == 0)
