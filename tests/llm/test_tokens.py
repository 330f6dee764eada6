"""op1 and op9: tokens, the store, packing."""

import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidewell.llm import bpe, pack, store
from tidewell.llm.bpe import vocabulary_path
from tidewell.session import scratch

WORD, BYTE = bpe.vocabulary_path("word_bpe_49k.json"), bpe.vocabulary_path("byte_bpe_50k.json")
TEXT = st.text(st.one_of(st.sampled_from("abcdeABC .,;'!\n  <|>éßÉ²\t—"), st.characters(codec="utf-8")), max_size=40)
REAL = {p: Tokenizer.from_file(p) for p in (WORD, BYTE)}


def whole(path, text):
    return REAL[path].encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_cached_ids_are_the_library_s(path):
    e = bpe.Encoder(path)

    @settings(max_examples=300, deadline=None)
    @given(st.lists(st.one_of(TEXT, st.sampled_from(["<|endoftext|>", "a <|endoftext|> b", "don't we're", "a\n\nb", " a", "a ", "\n", "İ", "x\x1cy", "á b", "ΑΣ ΑΣ."])), max_size=6))
    def check(texts):
        ids, n = e.encode([t.encode() for t in texts])
        got = [p.tolist() for p in np.split(ids, np.cumsum(n)[:-1])] if texts else []
        assert got == [whole(path, t) for t in texts]

    check()


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_cache_restarts_and_long_texts(path, monkeypatch, docs):
    texts = [r.text for r in docs.collect()]
    expected = [whole(path, t) for t in texts]
    monkeypatch.setattr(bpe, "SLICE", 30_000)
    monkeypatch.setattr(bpe, "CACHE", 30_000)
    monkeypatch.setattr(bpe, "PIECES", 50)
    ids, n = bpe.Encoder(path).encode([t.encode() for t in texts])
    assert [p.tolist() for p in np.split(ids, np.cumsum(n)[:-1])] == expected


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_cache_is_bounded_by_bytes(path, monkeypatch):
    monkeypatch.setattr(bpe, "SLICE", 30_000)
    monkeypatch.setattr(bpe, "HELD", 100_000, raising=False)
    texts = [" ".join(f"{'abcdefghij' * 20}{i}x{j}" for j in range(100)) for i in range(30)]
    e = bpe.Encoder(path)
    ids, n = e.encode([t.encode() for t in texts])
    assert [p.tolist() for p in np.split(ids, np.cumsum(n)[:-1])] == [whole(path, t) for t in texts]
    assert 0 < e.stop <= 100_000


def test_cache_takes_few_bytes_a_word():
    e = bpe.Encoder(WORD)
    e.encode([" ".join(f"w{i}" for i in range(20_000)).encode()])
    assert e.words == 20_000
    assert sum(a.itemsize for a in (e.at, e.size, e.first, e.length, e.mark, *e.known[0])) <= 29


def in_order(df):
    rows = df.collect()
    return sorted(rows, key=lambda r: (r.doc_id is not None, r.doc_id or 0))


def check_store(spark, df):
    path = scratch(spark, "test-store")
    store.write_store(df, path, tokenizer=WORD, end_id=2)
    rows = sorted(store.summarise(spark, path).collect(), key=lambda r: r.start)
    texts = {}
    for r in df.collect():
        texts.setdefault(r.doc_id, []).append(np.array([*whole(WORD, r.text), 2], "<u4"))
    start, keys = 0, []
    for r in rows:
        same = [x for x in texts[r.key] if len(x) == r.n_tokens and zlib.crc32(x.tobytes()) == r.ids_crc32]
        assert same and r.start == start
        start += r.n_tokens
        keys.append(r.key)
    assert len(rows) == df.count() and [k for k in keys if k is not None] == sorted(k for k in keys if k is not None)
    back = store.read_documents(spark, path).collect()
    assert all(any(x.tolist() == r.ids for x in texts[r.key]) for r in back) and len(back) == len(rows)
    assert store.verify_manifest(spark, path).count() == 0
    digests = [bytes(r.digest) for r in spark.read.parquet(f"{path}/chunks").select("digest").collect()]
    assert len(digests) == len(set(digests))
    return path, len(digests)


def test_store_round_trip(spark, docs):
    check_store(spark, docs)


def test_store_of_odd_rows(spark, odd_docs, no_docs):
    _, n = check_store(spark, odd_docs)
    twice = odd_docs.unionAll(odd_docs)
    assert check_store(spark, twice)[1] == n
    assert check_store(spark, no_docs)[1] == 0


def test_damaged_chunk_is_found(spark, docs):
    from pyspark.sql import functions as F

    path, _ = check_store(spark, docs.limit(20))
    bad = f"{path}-bad"
    for t in ("recipes", "manifest"):
        spark.read.parquet(f"{path}/{t}").write.parquet(f"{bad}/{t}")
    spark.read.parquet(f"{path}/chunks").withColumn("payload", F.reverse(F.col("payload").cast("string")).cast("binary")).write.parquet(f"{bad}/chunks")
    with pytest.raises(Exception, match="damaged"):
        store.summarise(spark, bad).collect()
    spark.read.parquet(f"{path}/chunks").limit(3).write.parquet(f"{bad}2/chunks")
    for t in ("recipes", "manifest"):
        spark.read.parquet(f"{path}/{t}").write.parquet(f"{bad}2/{t}")
    with pytest.raises(Exception, match="missing"):
        store.summarise(spark, f"{bad}2").collect()


def test_crc_of_parts():
    rng = np.random.default_rng(0)
    data = rng.integers(0, 256, 5000).astype(np.uint8).tobytes()
    ends = [0, 7, 7, 1000, 4999, 5000]
    parts = [data[a:b] for a, b in zip(ends, ends[1:])]
    crcs = np.array([zlib.crc32(p) for p in parts], np.int64)
    after = np.array([len(data) - e for e in ends[1:]], np.int64)
    assert int(np.bitwise_xor.reduce(store.shift_crc(crcs, after))) == zlib.crc32(data)


def test_chunks_follow_content_and_trees_agree():
    rng = np.random.default_rng(1)
    shared = rng.integers(0, 40_000, 5000).astype(np.uint32)
    a, b = np.concatenate([rng.integers(0, 40_000, 777).astype(np.uint32), shared]), np.concatenate([rng.integers(0, 40_000, 91).astype(np.uint32), shared])

    def chunks(x):
        e = store.bounds(len(x), store.cuts(x))
        assert e[-1] == len(x) and all(q - p <= store.MOST for p, q in zip([0, *e], e))
        return {x[p:q].tobytes() for p, q in zip([0, *e], e)}

    assert len(chunks(a) & chunks(b)) > 0.7 * len(chunks(shared))
    for n in range(1, 20):
        leaves, t = [bytes([i]) for i in range(n)], store.Tree()
        for x in leaves:
            t.add(x)
        assert t.root() == store.merkle(leaves)


def brute_first_fit(lengths, room):
    free, out = [], [0] * len(lengths)
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        b = next((j for j, f in enumerate(free) if f >= lengths[i]), None)
        if b is None:
            free.append(room)
            b = len(free) - 1
        free[b] -= lengths[i]
        out[i] = b
    return out


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=60))
def test_first_fit_decreasing(lengths):
    assert [b for b, _ in pack.first_fit_decreasing(lengths, 50)] == brute_first_fit(lengths, 50)


def check_packing(df, group_rows):
    got = pack.pack(df, tokenizer=BYTE, end_id=1, group_rows=group_rows).collect()
    ids = {}
    for r in df.collect():
        ids.setdefault(r.doc_id, []).append(np.array([*whole(BYTE, r.text), 1], "<u4"))
    sequences, pieces = {}, {}
    for r in got:
        assert any(r.doc_tokens == len(x) and zlib.crc32(x[r.start : r.start + r.length].tobytes()) == r.ids_crc32 for x in ids[r.doc_id])
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
        pieces.setdefault(r.doc_id, []).append((r.start, r.length))
    for parts in sequences.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= 2048
    for k, xs in ids.items():
        assert sum(n for _, n in pieces[k]) == sum(map(len, xs))
    return sequences


def test_packing(docs, odd_docs, no_docs):
    s = check_packing(docs, 50)
    sums = [sum(n for _, n in p) for p in s.values()]
    assert sum(sums) > 0.95 * 2048 * len(sums)
    check_packing(odd_docs, 4096)
    assert pack.pack(no_docs, tokenizer=BYTE, end_id=1).count() == 0


def test_a_hot_key_is_spread_over_groups(spark):
    """Rows without an id and with the same text: half of all, in many groups, none of them large."""
    rows = [(None, "one text that many rows share")] * 1500 + [(i, f"row {i} " * (1 + i % 40)) for i in range(1500)] + [(9, "long " * 9000)] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = pack.pack(docs, tokenizer=BYTE, end_id=1, group_rows=100).where("length < 2048")
    groups = {r.g: r.n for r in got.selectExpr("sequence_id >> 32 as g").groupBy("g").count().withColumnRenamed("count", "n").collect()}
    assert len(groups) == 30 and max(groups.values()) < 200
    check_packing(docs, 100)


def test_packed_sequences_hold_the_ids(docs):
    some = docs.limit(30)
    pieces = pack.pack(some, tokenizer=BYTE, end_id=1)
    seq = pack.sequences(some, pieces, tokenizer=BYTE, end_id=1, pad_id=0).collect()
    by = {r.sequence_id: r.ids for r in seq}
    text = {r.doc_id: [*whole(BYTE, r.text), 1] for r in some.collect()}
    for p in pieces.collect():
        assert by[p.sequence_id][p.offset : p.offset + p.length] == text[p.doc_id][p.start : p.start + p.length]
    assert all(len(x) == 2048 or len(x) & (len(x) - 1) == 0 for x in by.values())


def thue_morse(n):
    return "".join("ab"[bin(i).count("1") & 1] for i in range(n))


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_words_of_one_hash_keep_their_own_ids(path, monkeypatch):
    a = thue_morse(1024)
    texts = [a, a.translate(str.maketrans("ab", "ba")), "x " + a, a + "a", "word " * 3, "other\nwords, in (all)  cases\n"]
    expected = [whole(path, t) for t in texts]

    def got(e):
        ids, n = e.encode([t.encode() for t in texts])
        return [p.tolist() for p in np.split(ids, np.cumsum(n)[:-1])]

    assert got(bpe.Encoder(path)) == expected
    monkeypatch.setattr(bpe, "_hashes", lambda a, starts, length, mark: np.full(len(starts), 7, np.uint64))
    e = bpe.Encoder(path)
    assert got(e) == expected and got(e) == expected


@pytest.mark.parametrize("path", [BYTE])
def test_runs_of_white_space(path):
    texts = [f"{a}{s}{b}" for a in ("", "one", "one.") for s in (" ", "  ", "\n", "\n\n", " \n ", "\n \n\n", "   \n") for b in ("", "two", "<|endoftext|>", "7")]
    ids, n = bpe.Encoder(path).encode([t.encode() for t in texts])
    assert [p.tolist() for p in np.split(ids, np.cumsum(n)[:-1])] == [whole(path, t) for t in texts]


def test_width_belongs_to_the_chunk():
    """Equal chunks have one digest, whatever ids stand beside them; equal bytes of other widths have two."""

    class Fixed:
        def encode(self, texts):
            return np.concatenate(texts), np.array([len(t) for t in texts])

    rng = np.random.default_rng(3)
    shared = rng.integers(0, 60_000, 3000).astype(np.uint32)
    store_encoder = store.encoder
    store.encoder = lambda path: Fixed()
    try:
        alone = store._encode("", 2)([None], [shared])
        beside = store._encode("", 2)([None], [shared, np.full(500, 70_000, np.uint32)])
    finally:
        store.encoder = store_encoder
    assert alone[4][0] == beside[4][0] and {c["width"] for c in beside[6][1]} == {4} and {c["width"] for c in beside[6][0]} == {2}
    assert store.name_of(b"\1\0\0\0", 2) != store.name_of(b"\1\0\0\0", 4)


def test_damaged_manifest_is_found(spark, docs):
    path, _ = check_store(spark, docs.limit(20))
    bad = f"{path}-manifest"
    for t in ("recipes", "chunks"):
        spark.read.parquet(f"{path}/{t}").write.parquet(f"{bad}/{t}")
    m = spark.read.parquet(f"{path}/manifest")
    m.selectExpr("part", "n_docs", "n_tokens", "cast('x' as binary) as root").write.parquet(f"{bad}/manifest")
    with pytest.raises(Exception, match="manifest"):
        store.summarise(spark, bad).collect()
    m.limit(0).write.mode("overwrite").parquet(f"{bad}/manifest")
    with pytest.raises(Exception, match="manifest"):
        store.summarise(spark, bad).collect()
    assert not any(r.path.find("_staged") >= 0 for r in spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"{path}").select("path").collect())


@pytest.mark.parametrize(
    "column,change",
    [
        ("sizes", "transform(sizes, (x, i) -> case when i = 0 and size(sizes) > 1 then x - 1 when i = 1 then x + 1 else x end)"), ("crc32", "cast(0 as bigint)"), ("digests", "reverse(digests)"), ("sizes", "slice(sizes, 1, size(sizes) - 1)"),
        ("digests", "transform(digests, x -> cast('0123456789abcdef' as binary))"), ("n_tokens", "n_tokens + 1"), ("root", "cast('x' as binary)"),
    ],
)
def test_damaged_recipes_are_found(spark, docs, tmp_path, column, change):
    """Whatever column of a recipe is changed, reading it is an error, even if the manifest is made anew."""
    good, bad = f"file://{tmp_path}/good", f"file://{tmp_path}/bad"
    store.write_store(docs, good, tokenizer=vocabulary_path("word_bpe_49k.json"), end_id=2)
    assert store.summarise(spark, good).count() == docs.count()
    r = spark.read.parquet(f"{good}/recipes")
    assert r.where("size(sizes) > 1").count() > 10
    r.withColumn(column, F.expr(change)).write.parquet(f"{bad}/recipes")
    spark.read.parquet(f"{good}/chunks").write.parquet(f"{bad}/chunks")
    store._roots(spark.read.parquet(f"{bad}/recipes")).write.parquet(f"{bad}/manifest")
    with pytest.raises(Exception, match="damaged|aren't those|is missing"):
        store.summarise(spark, bad).collect()


def test_one_long_text_is_read_in_proportion(spark, tmp_path):
    import time
    import zlib

    def took(n):
        words = " ".join(f"word{i * i % 9973}" for i in range(n))
        path = f"file://{tmp_path}/long{n}"
        store.write_store(spark.createDataFrame([(1, words)], "doc_id long, text string"), path, tokenizer=vocabulary_path("word_bpe_49k.json"), end_id=2)
        began = time.time()
        row = store.summarise(spark, path).first()
        ids = store.read_documents(spark, path).first().ids
        assert row.n_tokens == len(ids) and row.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        return time.time() - began

    took(2000)
    once = took(100_000)
    assert took(800_000) < 8 * once + 4


def test_words_stay_known_as_more_are_learned(monkeypatch):
    enc = bpe.Encoder(bpe.vocabulary_path("word_bpe_49k.json"))
    learned = []
    learn = enc._learn
    monkeypatch.setattr(enc, "_learn", lambda words, marks: learned.append(len(words)) or learn(words, marks))
    # more words than the cache held once, of letters only
    letters = "abcdefghij"
    word = lambda n: "".join(letters[int(d)] for d in str(n))
    texts = [" ".join(map(word, range(i, i + 60_000))).encode() for i in range(0, 660_000, 60_000)]
    first = enc.encode([texts[0]])
    for t in texts[1:]:
        enc.encode([t])
    assert sum(learned) == 660_000
    again = enc.encode([texts[0]])
    assert sum(learned) == 660_000 and all((x == y).all() for x, y in zip(first, again))
    some = texts[-1][-3000:].decode().split(" ", 1)[1]
    assert enc.encode([some.encode()])[0].tolist() == enc.library(some)
