"""Near-duplicate texts: consistent weighted samples over TF-IDF shingles, banded, then
verified by weighted Jaccard similarity.

1. A count-min table of fixed size holds in how many documents each shingle of five words
   stands, over all documents; tables of tasks are added up by columns.
2. Each text gets BANDS * ROWS improved consistent weighted samples of its weighted
   shingles, and a code for each band. Equal texts are one class from here on.
3. Texts that share a code are compared with the code's leader, the text that shares codes
   with the most others; those at least ``similarity`` alike are linked, and links joined to
   components.
4. Texts of different components in codes that have several are compared too if they share a
   shingle of their prefixes (the rarest shingles of a text, without which the others weigh
   too little), as every pair that is alike enough does. So no link is lost because neither
   text is the leader, while texts of one component aren't compared again, nor are those of
   a large family that have only its common shingles in common.
5. Classes are the components after both.

Texts are told apart by 128 bits of their SHA-256, never by ids. A class is named by its least
id; one whose rows all lack ids has no name. Null and empty texts, and texts without words, are like
their exact copies only. Ids of any type that has an order, and repeated ones, are allowed: rows with
the same id and unlike texts are in classes of their own, which may then have the same name. An
empty table gives no rows. Extra columns don't matter.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.arrow import ranges, unused
from tidewell.llm.shingles import DEPTH, WIDTH, bands, cells, samples, shingles, weighted_jaccard, weights
from tidewell.session import cut, delete, scratch, ship

ROWS, BANDS, SIMILARITY = 4, 14, 0.8
#: Parts of the table of counts; bytes of text that are shingled at a time, each of which takes some 80 bytes meanwhile.
_SLICES, _BLOCK = 64, 500_000
#: Parts that the texts of a code are dealt into; as many as a long has bits.
_SALTS = 64


def _add_up(batches):
    """(slice, counts) of the texts of a task. The table has a fixed size."""
    table, docs = np.zeros((DEPTH, WIDTH), np.int32), 0
    for b in batches:
        texts = b.column(0)
        docs += len(texts)
        for first, last in ranges([n or 0 for n in pc.binary_length(texts).to_pylist()], _BLOCK):
            x, _, _ = shingles(texts.slice(first, last - first).to_pylist())
            for row, c in zip(table, cells(x)):
                row += np.bincount(c, minlength=WIDTH).astype(np.int32)
    if docs:
        parts = np.split(table.ravel(), _SLICES)
        yield pa.RecordBatch.from_pydict({"slice": pa.array([-1, *range(_SLICES)], pa.int32()), "counts": pa.array([np.array([docs], "<i8").tobytes(), *(p.astype("<i4").tobytes() for p in parts)], pa.binary())})


def _merge(batches):
    """The sum of each slice's counts; a task holds its slices' sums."""
    sums: dict[int, np.ndarray] = {}
    for b in batches:
        for s, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            part = np.frombuffer(raw, "<i8" if s == -1 or len(raw) == WIDTH * DEPTH // _SLICES * 8 else "<i4").astype(np.int64)
            sums[s] = sums[s] + part if s in sums else part
    if sums:
        yield pa.RecordBatch.from_pydict({"slice": pa.array(list(sums), pa.int32()), "counts": pa.array([v.astype("<i8").tobytes() for v in sums.values()], pa.binary())})


def document_counts(texts: DataFrame) -> tuple[np.ndarray, int]:
    """(count-min table, number of documents) of a DataFrame of one binary column; 4 MB."""
    schema = "slice int, counts binary"
    rows = texts.mapInArrow(_add_up, schema).repartition("slice").mapInArrow(_merge, schema).collect()
    by = {r.slice: np.frombuffer(bytes(r.counts), "<i8") for r in rows}
    if not by:
        return np.zeros((DEPTH, WIDTH), np.int64), 0
    # counts over 2**31 - 1 weigh the same as that one
    table = np.concatenate([by[s] for s in range(_SLICES)]).reshape(DEPTH, WIDTH)
    return np.minimum(table, 2**31 - 1).astype(np.int32), int(by[-1][0])


def _digest(text) -> F.Column:
    return F.substring(F.unhex(F.sha2(text, 256)), 1, 16)


def _sign(shared, rows: int, n_bands: int):
    def run(batches):
        counts, docs = shared.value
        for b in batches:
            texts = b.column(2)
            codes: list[list[int] | None] = []
            total: list[float] = []
            for first, last in ranges([n or 0 for n in pc.binary_length(texts).to_pylist()], _BLOCK):
                x, tf, n = shingles(texts.slice(first, last - first).to_pylist())
                w = weights(x, tf, counts, docs)
                got = bands(samples(x, w, n, rows * n_bands), rows).tolist() if n.any() else []
                total += np.bincount(np.repeat(np.arange(len(n)), n), w, len(n)).tolist()
                each = iter(got)
                codes += [next(each) if m else None for m in n.tolist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(codes, pa.list_(pa.int64())), pa.array(total, pa.float64())], names=["k", "digest", "codes", "w"])

    return run


def _compare(shared, similarity: float):
    def run(batches):
        counts, docs = shared.value
        known: dict[int, tuple] = {}
        held = 0

        def vector(k, t):
            """The shingles of a text; as many are remembered as fit in some 16 MB."""
            nonlocal held
            if k not in known:
                x, tf, _ = shingles([t])
                if held > 1_000_000:
                    known.clear()
                    held = 0
                held += len(x) + 50
                known[k] = x, weights(x, tf, counts, docs)
            return known[k]

        for b in batches:
            keep = []
            for ka, kb, ta, tb in zip(*[b.column(c).to_pylist() for c in ("a", "b", "ta", "tb")]):
                keep.append(weighted_jaccard(*vector(ka, ta), *vector(kb, tb)) >= similarity)
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _prefixes(shared, similarity: float):
    """A row for each shingle of a text's prefix: its rarest ones, without which the rest weighs too little.

    In one order of all shingles, the first that two texts of this similarity share lies in both prefixes.
    ``rest`` is the weight from a shingle on.
    """

    def run(batches):
        counts, docs = shared.value
        for b in batches:
            row, f, left = [], [], []
            for i, t in enumerate(b.column("t").to_pylist()):
                x, tf, _ = shingles([t])
                w = weights(x, tf, counts, docs)
                df = np.minimum.reduce([counts[j][c] for j, c in enumerate(cells(x))])
                order = np.lexsort([x, df])
                rest = w.sum() - np.cumsum(w[order])
                n = int(np.searchsorted(-rest, -(similarity - 1e-9) * w.sum(), side="right")) + 1
                f.append(x[order[:n]].astype(np.int64))
                row.append(np.full(len(f[-1]), i))
                left.append((rest + w[order])[:n])
            at = pa.array(np.concatenate(row)) if row else pa.array([], pa.int64())
            yield pa.RecordBatch.from_arrays([*[b.column(c).take(at) for c in ("k", "label", "w")], pa.array(np.concatenate(f) if f else np.zeros(0, np.int64)), pa.array(np.concatenate(left) if left else np.zeros(0))], names=["k", "label", "w", "f", "rest"])

    return run


def _by_salt(codes: DataFrame, *columns: str) -> DataFrame:
    """A row for each salt that a code's texts have, from one row a code, so that what joins it is spread over tasks."""
    has = F.filter(F.sequence(F.lit(0), F.lit(_SALTS - 1)), lambda s: F.call_function("shiftright", F.col("salts"), s).bitwiseAND(F.lit(1).cast("long")) == 1)
    return codes.select("code", F.explode(has).alias("salt"), *columns)


def components(links: DataFrame) -> DataFrame:
    """(v, label): the least vertex that each vertex of ``links`` (a, b) is connected with.

    Labels go to neighbours and then to labels' labels, so paths shorten by half in each
    turn; the sum of labels falls until it is stable.
    """
    both = cut(links.select("a", "b").union(links.select("b", "a")).distinct())
    labels = cut(both.groupBy(F.col("a").alias("v")).agg(F.min("b").alias("m")).select("v", F.least("v", "m").alias("label")))
    total = lambda df: df.agg(F.sum(F.col("label").cast("decimal(38,0)"))).first()[0]
    before = None
    now = total(labels)
    while now is not None and now != before:
        near = both.join(labels.withColumnRenamed("v", "b"), "b").groupBy(F.col("a").alias("v")).agg(F.min("label").alias("m"))
        nearer = labels.join(near, "v").select("v", F.least("label", "m").alias("label"))
        up = nearer.select(F.col("v").alias("label"), F.col("label").alias("up"))
        labels = cut(nearer.join(up, "label").select("v", F.col("up").alias("label")))
        before, now = now, total(labels)
    return labels


def _classes(docs: DataFrame, key: str, text: str, similarity: float = SIMILARITY, rows: int = ROWS, n_bands: int = BANDS) -> tuple[DataFrame, DataFrame]:
    """((k, digest) of each row, (digest, rep, label, n_edges) of each distinct text).

    ``rep`` is the text's least id and ``label`` numbers its class. Both stand in the shared folder.
    """
    spark = docs.sparkSession
    ship(spark)
    kept: list[str] = []

    def stage(df: DataFrame, name: str) -> DataFrame:
        kept.append(scratch(spark, f"neardup-{name}"))
        df.write.option("compression", "zstd").parquet(kept[-1])
        return spark.read.parquet(kept[-1])

    kind = docs.schema[key].dataType.simpleString()
    whole = F.coalesce(F.col(f"`{text}`").cast("string").cast("binary"), F.lit("").cast("binary"))
    source = docs.select(F.col(f"`{key}`").alias("k"), whole.alias("t"))
    try:
        shared = spark.sparkContext.broadcast(document_counts(source.select("t")))
        signed = source.select("k", _digest("t").alias("digest"), "t").mapInArrow(_sign(shared, rows, n_bands), f"k {kind}, digest binary, codes array<long>, w double")
        signed = stage(signed, "signed")

        # one text of each digest, with a number v; partial sums come before the shuffle, so copies don't weigh
        reps = signed.groupBy("digest").agg(F.min("k").alias("rep"), F.first("codes").alias("codes"), F.first("w").alias("w"))
        reps = stage(reps.withColumn("v", F.monotonically_increasing_id()), "reps")
        coded = reps.where("codes is not null").select(F.explode("codes").alias("code"), "v", "w", F.xxhash64("digest").alias("h")).withColumn("salt", F.pmod("h", F.lit(_SALTS)).cast("int"))
        # a code that a third of all texts have is met by its partial sums, and joined by (code, salt)
        salts = F.expr("bit_or(shiftleft(1L, salt))").alias("salts")
        sizes = coded.groupBy("code").agg(F.count(F.lit(1)).alias("n"), salts).where("n > 1")
        sized = cut(coded.join(_by_salt(sizes, "n"), ["code", "salt"]))
        # the leader of a code is the text that shares its codes with the most others, so a family's middle
        centre = sized.groupBy("v").agg(F.sum("n").alias("company"))
        sized = cut(sized.drop("n").join(centre, "v"))
        order = F.struct(F.col("company"), F.col("h"), F.col("v").alias("leader"), F.col("w").alias("leader_w"))
        leaders = _by_salt(sized.groupBy("code").agg(F.max(order).alias("m"), salts), "m.leader", "m.leader_w")
        members = cut(sized.drop("company", "h").join(leaders, ["code", "salt"]))
        # the lesser of two texts' summed weights over the greater bounds their similarity
        alike = lambda a, b: F.least(a, b) >= F.greatest(a, b) * (similarity - 1e-9)
        pairs = cut(members.where((F.col("v") != F.col("leader")) & alike("w", "leader_w")).select(F.col("leader").alias("a"), F.col("v").alias("b")).distinct())
        # the text of each number: from the rows with its least id, of which one stays
        wanted = reps.join(members.select("v").distinct(), "v", "left_semi").select("v", F.col("digest").alias("d"), "rep")
        texts = source.withColumn("d", _digest("t")).join(wanted, "d").where(F.col("k").eqNullSafe(F.col("rep")))
        texts = stage(texts.select("v", "t").dropDuplicates(["v"]), "texts")

        def verified(some: DataFrame) -> DataFrame:
            with_b = some.join(texts.select(F.col("v").alias("b"), F.col("t").alias("tb")), "b")
            with_both = with_b.join(texts.select(F.col("v").alias("a"), F.col("t").alias("ta")), "a")
            return with_both.select("a", "b", "ta", "tb").mapInArrow(_compare(shared, similarity), "a long, b long")

        links = cut(verified(pairs))
        labels = components(links)
        named = members.join(labels, "v", "left").select("code", "salt", "v", "w", F.coalesce("label", "v").alias("label"))
        mixed = _by_salt(named.groupBy("code").agg(F.min("label").alias("x"), F.max("label").alias("y"), salts).where("x != y"))
        named = named.join(mixed, ["code", "salt"]).select(F.col("v").alias("k"), "label", "w").distinct()
        held = cut(named.join(texts.withColumnRenamed("v", "k"), "k").select("k", "label", "w", "t").mapInArrow(_prefixes(shared, similarity), "k long, label long, w double, f long, rest double"))
        x, y = (held.select("f", *[F.col(c).alias(f"{c}{i}") for c in ("k", "label", "w", "rest")]) for i in (1, 2))
        # from the first shingle that both have, what is left of either bounds what they share
        enough = F.least("rest1", "rest2") >= (F.col("w1") + F.col("w2")) * (similarity / (1 + similarity) - 1e-9)
        across = x.join(y, "f").where((F.col("k1") < F.col("k2")) & (F.col("label1") != F.col("label2")) & alike("w1", "w2") & enough).select(F.col("k1").alias("a"), F.col("k2").alias("b")).distinct()
        done = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        more = cut(verified(across.join(done, ["a", "b"], "left_anti")))
        links = cut(links.union(more))
        labels = components(links)
        degree = links.select(F.col("a").alias("v")).union(links.select("b")).groupBy("v").agg(F.count(F.lit(1)).alias("n_edges"))
        found = reps.select("digest", "rep", "v").join(labels, "v", "left").join(degree, "v", "left")
        found = cut(found.select("digest", "rep", F.coalesce("label", "v").alias("label"), F.coalesce("n_edges", F.lit(0)).alias("n_edges")))
        return cut(signed.select("k", "digest")), found
    finally:
        for path in kept:
            delete(spark, path)


def classes(docs: DataFrame, *, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """key, class_id, n_edges of each row: its class, and the verified edges that its text takes part in.

    The edges are those that the class was built of, at least one a text in a class of several texts. They aren't all
    pairs that are alike enough: texts of one class are compared with its leaders only.
    """
    rows, found = _classes(docs, key, text, **options)
    names = found.groupBy("label").agg(F.min("rep").alias("class_id"))
    # a digest that many rows share is a skewed key on one side only, which Spark splits
    return rows.join(found.join(names, "label"), "digest", "left").select(F.col("k").alias(key), "class_id", "n_edges")


def dedup(docs: DataFrame, *, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """One row of ``docs`` of each class: that of the least id, without an id only if none has one.

    Of rows with the same id and text one stays, whichever; of unlike texts with one id each class keeps its own row.
    """
    _, found = _classes(docs, key, text, **options)
    d, r = unused(docs.columns, "digest"), unused(docs.columns, "rep")
    first = F.min(F.struct(F.col("rep").isNull().alias("none"), F.col("rep"), F.col("digest")))
    kept = found.groupBy("label").agg(first.alias("m")).select(F.col("m.digest").alias(d), F.col("m.rep").alias(r))
    whole = F.coalesce(F.col(f"`{text}`").cast("string").cast("binary"), F.lit("").cast("binary"))
    out = docs.withColumn(d, _digest(whole)).join(kept, d).where(F.col(f"`{key}`").eqNullSafe(F.col(r)))
    return out.dropDuplicates([d]).select(*[F.col(f"`{c}`") for c in docs.columns])


def contract(docs: DataFrame) -> DataFrame:
    out = classes(docs)
    return out.select("doc_id", "class_id", "n_edges", (F.col("doc_id") == F.col("class_id")).alias("kept"))
