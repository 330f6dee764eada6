"""Benchmark decontamination: one automaton over normalised test items, texts scanned once.

Words are runs of letters, digits and characters beyond ASCII, with A-Z in lower case.
A window is ``window`` consecutive words of an item; an item with fewer
words, but not none, is one window. A document's word is hit if it lies in any
occurrence of a window. Null and empty texts have no words and are clean. Equal item
texts both count; an item without an id hits words but isn't counted or named, as it has
no name; an empty benchmark leaves all documents clean; repeated documents, and those with
the same id or none, are judged row by row; extra columns stay.
"""

from __future__ import annotations

import re
from array import array
from bisect import bisect_right
from collections.abc import Iterable
from functools import reduce
from hashlib import sha256
from itertools import batched

import ahocorasick
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.arrow import filter_texts, map_texts, unused, words
from tidewell.session import scratch, ship

#: Bytes of item text in one automaton, which takes some 18 bytes of memory for each, so 220 MB. A benchmark beyond this is scanned for in blocks of items.
BLOCK_BYTES = 12_000_000
#: Blocks that are sent to the tasks and scanned for at a time.
HELD = 8
_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


class Items:
    """One Aho-Corasick automaton that finds all windows of all items.

    Its patterns are the items' blocks: every seventh run of seven words for windows of thirteen, as any thirteen words in a row hold a
    whole block. Where a block occurs, the words before and after it are compared with the item's, so each occurrence gives the
    longest run of words that document and item have in common there; from ``window`` words on it is the union of the item's windows.
    An item of fewer words is one pattern. So the automaton has about one state for each word of an item, not one for each word of each
    window. A run that several blocks lie in is walked once.
    """

    def __init__(self, rows: Iterable[tuple[object, bytes | None]], window: int):
        self.window, self.block = window, (window + 1) // 2
        self.numbers: dict[bytes, int] = {}
        #: the items' words by number, each item between marks that no word has
        self.flat, self.starts, self.ids = array("i", [-1]), [], []
        groups: dict[tuple[int, ...], int] = {}
        self.places: list[int | list[int]] = []
        for item, text in rows:
            numbered = [self.numbers.setdefault(w, len(self.numbers) + 1) for w in words(text)]
            if not numbered:
                continue
            first = len(self.flat)
            self.starts.append(first)
            self.ids.append(item)
            self.flat.extend(numbered)
            self.flat.append(-1)
            n = len(numbered) if len(numbered) < window else self.block
            for at in range(0, len(numbered) - n + 1, n):
                g = groups.setdefault(tuple(numbered[at : at + n]), len(self.places))
                if g == len(self.places):
                    self.places.append(first + at)
                elif isinstance(self.places[g], int):
                    self.places[g] = [self.places[g], first + at]
                else:
                    self.places[g].append(first + at)
        self.machine = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
        for key, g in groups.items():
            self.machine.add_word(key, g)
        if groups:
            self.machine.make_automaton()

    def find(self, found: list[bytes]) -> list[tuple[int, int, object]]:
        """(first word, number of words, item) of each run of a text that an item has, of ``window`` words at least or a whole short item."""
        get = self.numbers.get
        text = tuple([get(w, 0) for w in found]) if self.starts else ()
        if not any(text):
            return []
        flat, window, out = self.flat, self.window, []
        walked: dict[int, int] = {}  # the last word of the run at each alignment of text and items
        for end, g in self.machine.iter(text):
            places = self.places[g]
            for p in (places,) if isinstance(places, int) else places:
                k = bisect_right(self.starts, p) - 1
                size = (self.starts[k + 1] if k + 1 < len(self.starts) else len(flat)) - 1 - self.starts[k]
                if size < window:
                    out.append((end - size + 1, size, self.ids[k]))
                    continue
                a, b = end - self.block + 1, end + 1
                shift = p - a
                if walked.get(shift, -1) >= end:
                    continue
                while a and flat[a - 1 + shift] == text[a - 1]:
                    a -= 1
                while b < len(text) and flat[b + shift] == text[b]:
                    b += 1
                walked[shift] = b - 1
                if b - a >= window:
                    out.append((a, b - a, self.ids[k]))
        return out


def spans(text: bytes | None, found: list[tuple[int, int, object]], window: int) -> list[tuple[int, int, object]]:
    """(first byte, byte after the last, item) of each occurrence of a window in the original text."""
    at = [m.span() for m in _WORD.finditer(text or b"")]
    return sorted({(at[i][0], at[i + min(n, window) - 1][1], item) for first, n, item in found if item is not None for i in range(first, first + max(1, n - window + 1))})


def covered(found: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The union of (first, number) ranges, as disjoint (first, after) ranges."""
    out: list[tuple[int, int]] = []
    for first, n in sorted(found):
        if out and first <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], first + n))
        else:
            out.append((first, first + n))
    return out


_machines: dict[str, Items] = {}


def _machine(items, window: int) -> Items:
    """One automaton at a time in each Python process."""
    name, rows = f"{items.value[0]} {window}", items.value[1]
    if name not in _machines:
        _machines.clear()
        _machines[name] = Items(rows, window)
    return _machines[name]


def _scan(items, window: int):
    def run(keys, texts):
        m = _machine(items, window)
        n_words, first, after, ids, offsets = [], [], [], [], []
        for t in texts:
            w = words(t)
            found = m.find(w)
            ranges = covered([(i, n) for i, n, _ in found])
            n_words.append(len(w))
            first.append([a for a, _ in ranges])
            after.append([b for _, b in ranges])
            ids.append(sorted({str(x) for _, _, x in found if x is not None}))
            offsets.append([f"{a}-{b}:{x}" for a, b, x in spans(t, found, window)] if found else [])
        return [*keys, n_words, first, after, ids, offsets]

    return run


def _items(benchmark: DataFrame, item: str, item_text: str, block_bytes: int) -> tuple[DataFrame, int]:
    """(id and text of each item with a text, number of blocks that they are scanned for in)."""
    rows = benchmark.select(F.col(f"`{item}`").alias("i"), F.col(f"`{item_text}`").cast("string").cast("binary").alias("t")).where("t is not null")
    total = rows.agg(F.coalesce(F.sum(F.length("t")), F.lit(0))).first()[0]
    return rows, -(-(2 * total) // block_bytes) if total > block_bytes else 1


def _blocks(rows: DataFrame, blocks: int):
    """Each block of items as a broadcast (name, rows); no more than some ``block_bytes`` are collected at a time."""
    for b in range(blocks):
        some = rows if blocks == 1 else rows.where(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == b)
        held = [(r.i, bytes(r.t)) for r in some.collect()]
        yield rows.sparkSession.sparkContext.broadcast((sha256(repr(held).encode()).hexdigest(), held))


def _row_hits(rows: DataFrame, blocks: int, placed: DataFrame, place: str, text: str, window: int) -> DataFrame:
    """place, n_words, r, items, offsets of each row of ``placed`` that has hits in some block; a few blocks are held at a time."""
    path = scratch(placed.sparkSession, "decontam-hits")
    for b, held in enumerate(batched(_blocks(rows, blocks), HELD)):
        schema = "place long, n_words long, first array<int>, after array<int>, items array<string>, offsets array<string>"
        found = [map_texts(placed, [place], text, _scan(shared, window), schema).where(F.size("first") > 0) for shared in held]
        reduce(DataFrame.union, found).write.parquet(f"{path}/{b}")
        for shared in held:
            shared.destroy()
    hits = placed.sparkSession.read.parquet(f"{path}/*")
    ranges = F.array_sort(F.flatten(F.collect_list(F.arrays_zip("first", "after"))))
    return hits.groupBy("place").agg(F.max("n_words").alias("n_words"), ranges.alias("r"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("offsets")))).alias("offsets"))


def _n_hit(ranges) -> F.Column:
    """Words in the union of ascending ranges."""
    end, n = F.lit(0).cast("int").alias("end"), F.lit(0).cast("long").alias("n")
    add = lambda a, x: F.struct(F.greatest(a["end"], x["after"]).alias("end"), (a["n"] + F.greatest(F.lit(0), x["after"] - F.greatest(a["end"], x["first"]))).alias("n"))
    return F.aggregate(ranges, F.struct(end, n), add)["n"]


def _placed(docs: DataFrame, columns: list[str]) -> tuple[DataFrame, str]:
    """(rows with a number each, its column), written to the shared folder so that the numbers stay; they go with the application."""
    path, place = scratch(docs.sparkSession, "decontam"), unused(columns, "place")
    docs.select(*[F.col(f"`{c}`") for c in columns], F.monotonically_increasing_id().alias(place)).write.option("compression", "zstd").parquet(path)
    return docs.sparkSession.read.parquet(path), place


def scan(docs: DataFrame, benchmark: DataFrame, *, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", window: int = 13, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """key, n_words, n_hit, items array<string>, offsets array<string> of each document.

    ``offsets``: "first-after:item" bytes of the original text. The items' bytes are summed
    first: up to ``block_bytes`` they are one automaton; beyond, items are dealt into blocks
    by a hash, each block is scanned for on its own over numbered rows, and hits are merged
    by the rows' numbers.
    """
    ship(docs.sparkSession)
    rows, blocks = _items(benchmark, item, item_text, block_bytes)
    if blocks > 1:
        placed, place = _placed(docs, [key, text])
        hits = _row_hits(rows, blocks, placed, place, text, window)
        count = map_texts(placed, [place, key], text, lambda keys, texts: [*keys, [len(words(t)) for t in texts]], f"place long, k {docs.schema[key].dataType.simpleString()}, n long")
        none = F.array().cast("array<string>")
        out = count.join(hits, "place", "left")
        return out.select(F.col("k").alias(key), F.col("n").alias("n_words"), F.coalesce(_n_hit("r"), F.lit(0)).alias("n_hit"), F.coalesce("items", none).alias("items"), F.coalesce("offsets", none).alias("offsets"))
    kind = docs.schema[key].dataType.simpleString()
    out = map_texts(docs, [key], text, _scan(next(_blocks(rows, 1)), window), f"k {kind}, n_words long, first array<int>, after array<int>, items array<string>, offsets array<string>")
    n_hit = F.aggregate(F.arrays_zip("first", "after"), F.lit(0).cast("long"), lambda a, x: a + x["after"] - x["first"])
    return out.select(F.col("k").alias(key), "n_words", n_hit.alias("n_hit"), "items", "offsets")


def judged(scanned: DataFrame) -> DataFrame:
    """Adds ``contaminated``: hit words make up a twentieth of the document or more."""
    return scanned.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", item: str = "item_id", item_text: str = "text", window: int = 13, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of ``docs`` that aren't contaminated, with their columns.

    Texts go through the automaton beside their rows, so nothing is joined or shuffled. For a
    benchmark of many blocks, rows are numbered and written once, each block is scanned for, and
    the numbers of the contaminated rows are taken away.
    """
    ship(docs.sparkSession)
    rows, blocks = _items(benchmark, item, item_text, block_bytes)
    if blocks > 1:
        placed, place = _placed(docs, docs.columns)
        bad = judged(_row_hits(rows, blocks, placed, place, text, window).withColumn("n_hit", _n_hit("r"))).where("contaminated").select(F.col("place").alias(place))
        return placed.join(bad, place, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
    shared = next(_blocks(rows, 1))

    def clean(texts):
        m, keep = _machine(shared, window), []
        for t in texts:
            w = words(t)
            n = sum(e - s for s, e in covered([(i, k) for i, k, _ in m.find(w)]))
            keep.append(not (n and 20 * n >= len(w)))
        return keep

    return filter_texts(docs, text, clean)


def contract(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The digest columns of the query."""
    out = judged(scan(docs, benchmark))
    return out.select("doc_id", F.col("n_words").cast("long"), F.col("n_hit").cast("long"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")
