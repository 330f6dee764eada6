"""op5 and the pipeline."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidewell.llm import decontam, neardup, pack, quality, rules
from tidewell.llm.bpe import vocabulary_path
from tidewell.llm.shingles import samples, shingles, weighted_jaccard, weights


def brute_shingles(text):
    from tidewell.llm.arrow import words

    w = words((text or "").encode())
    return Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)] if w else [])


def test_shingles_are_the_words(docs):
    texts = [r.text for r in docs.limit(60).collect()] + ["", "one", "one two three four", "a b c d e", "a b c d e a b c d e"]
    x, tf, n = shingles([t.encode() for t in texts])
    at = 0
    for t, m in zip(texts, n.tolist()):
        brute = brute_shingles(t)
        assert m == len(brute) and sorted(tf[at : at + m].tolist()) == sorted(brute.values())
        one = shingles([t.encode()])
        assert np.array_equal(one[0], x[at : at + m])
        at += m


def test_long_texts_hash_alike(monkeypatch):
    import tidewell.llm.shingles as s

    text = " ".join(f"w{i % 37}" for i in range(500)).encode()
    expected = shingles([text])
    monkeypatch.setattr(s, "_SPAN", 100)
    assert all(np.array_equal(a, b) for a, b in zip(shingles([text]), expected))


def test_samples_agree_as_often_as_texts_are_alike():
    rng = np.random.default_rng(5)
    x = np.sort(rng.choice(1 << 40, 300, replace=False).astype(np.uint64))
    wa, wb = rng.random(300) + 0.5, rng.random(300) + 0.5
    xa, xb, wa, wb = x[:220], x[60:], wa[:220], wb[60:]
    k = 3000
    s = samples(np.concatenate([xa, xb]), np.concatenate([wa, wb]), np.array([len(xa), len(xb)]), k)
    assert abs((s[0] == s[1]).mean() - weighted_jaccard(xa, wa, xb, wb)) < 0.04


def brute_classes(rows):
    """Classes by comparing all pairs of distinct texts, with exact document counts."""
    texts = [(k, (t or "").encode()) for k, t in rows]
    vec = []
    sets = [shingles([t]) for _, t in texts]
    df = Counter(h for x, _, _ in sets for h in x.tolist())
    for x, tf, _ in sets:
        share = np.array([df[h] for h in x.tolist()], float) / len(texts)
        idf = 1 + np.log(np.clip(share, 1 / 256, 1)) / np.log(1 / 256)
        vec.append((x, (1 + np.log(tf)) * idf))
    parent = list(range(len(texts)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    near = []
    for i in range(len(texts)):
        for j in range(i):
            same = texts[i][1] == texts[j][1]
            s = 1.0 if same else weighted_jaccard(*vec[i], *vec[j]) if len(vec[i][0]) and len(vec[j][0]) else 0.0
            if abs(s - 0.8) < 1e-3:
                near.append((i, j))
            if s >= 0.8:
                parent[root(i)] = root(j)
    least = {}
    for i, (k, _) in enumerate(texts):
        r = root(i)
        least[r] = min(least.get(r, k), k)
    return {k: least[root(i)] for i, (k, _) in enumerate(texts)}, near


def made(n=60):
    rng = random.Random(2)
    vocabulary = [f"w{i}" for i in range(3000)]
    rows = []
    for i in range(n):
        text = rng.choices(vocabulary, k=rng.randint(30, 200))
        rows.append(" ".join(text))
        for _ in range(rng.choice([0, 0, 1, 3])):
            near = list(text)
            near[rng.randrange(len(near))] = "edited"
            rows.append(" ".join(near) if rng.random() < 0.7 else rows[-1])
    rows += [" ".join(rng.choices(vocabulary, k=40) + rows[0].split()[:20]) for _ in range(10)]
    return list(enumerate(rows))


def test_classes_are_those_of_all_pairs(spark):
    rows = made()
    expected, near = brute_classes(rows)
    got = {r.doc_id: r.class_id for r in neardup.contract(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()}
    assert not near  # no pair is so near the similarity that a count a little too high decides
    assert got == expected and len(set(expected.values())) < len(rows)


def test_recall_of_all_alike_pairs(spark):
    """Of all pairs of unlike texts that are at least 0.8 alike by brute force, those found in one class."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("length(text) > 0")
    rng, rows = random.Random(9), [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    for i, (_, t) in enumerate(rows[:150]):
        w = t.split()
        for _ in range(max(1, len(w) // 60)):
            w[rng.randrange(len(w))] = f"edit{i}"
        rows.append((100_000 + i, " ".join(w)))
    pairs, vec = alike_pairs(rows)
    got = {r.doc_id: r.class_id for r in neardup.contract(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    found = [got[a] == got[b] for a, b in pairs]
    print(f"{sum(found)} of {len(found)} pairs found")
    assert len(found) > 60 and sum(found) >= 0.97 * len(found)


def alike_pairs(rows, least=0.8):
    sets = [shingles([t.encode()]) for _, t in rows]
    df = Counter(h for x, _, _ in sets for h in x.tolist())
    vec = []
    for x, tf, _ in sets:
        share = np.array([df[h] for h in x.tolist()], float) / len(rows)
        vec.append((x, (1 + np.log(tf)) * (1 + np.log(np.clip(share, 1 / 256, 1)) / np.log(1 / 256))))
    where = {}
    for i, (x, _) in enumerate(vec):
        for h in x.tolist():
            where.setdefault(h, []).append(i)
    together = Counter(p for at in where.values() if len(at) > 1 for i, a in enumerate(at) for p in [(a, b) for b in at[i + 1 :]])
    pairs = [(a, b) for (a, b), n in together.items() if 2.5 * n > min(len(vec[a][0]), len(vec[b][0])) and rows[a][1] != rows[b][1]]
    return [(rows[a][0], rows[b][0]) for a, b in pairs if weighted_jaccard(*vec[a], *vec[b]) >= least], vec


def test_repeated_ids_with_unlike_texts(spark):
    words = [" ".join(f"{c}{i}" for i in range(30)) for c in "ABCDE"]
    rows = [(5, words[0]), (5, words[1]), (6, words[0]), (7, words[1]), (8, words[2]), (None, words[2]), (None, words[3]), (None, words[3]), (9, words[4]), (9, words[4])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = sorted(((r.doc_id, r.text) for r in neardup.dedup(docs).collect()), key=str)
    assert kept == sorted([(5, words[0]), (5, words[1]), (8, words[2]), (None, words[3]), (9, words[4])], key=str)
    got = sorted((str(r.doc_id), str(r.class_id)) for r in neardup.contract(docs).collect())
    assert got == sorted([("5", "5"), ("5", "5"), ("6", "5"), ("7", "5"), ("8", "8"), ("None", "8"), ("None", "None"), ("None", "None"), ("9", "9"), ("9", "9")])


def test_ids_may_be_text(spark):
    rows = [("x", "a b c d e f"), ("w", "a b c d e f"), ("é", "other words stand here now today")]
    got = {r.doc_id: r.class_id for r in neardup.contract(spark.createDataFrame(rows, "doc_id string, text string")).collect()}
    assert got == {"x": "w", "w": "w", "é": "é"}


def test_long_words_have_their_own_hashes():
    a = "".join("ab"[bin(i).count("1") & 1] for i in range(1024))
    b = a.translate(str.maketrans("ab", "ba"))
    assert shingles([a.encode()])[0].tolist() != shingles([b.encode()])[0].tolist()

def test_group_of_copies_and_odd_rows(spark, odd_docs, no_docs):
    got = neardup.contract(odd_docs).collect()
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r.class_id)
    assert len(got) == odd_docs.count()
    assert by[3] == [3] and by[8] == [3] and by[4] == [4, 4] and by[1] == [1] and by[2] == [1] and by[None] == [None] and by[9] == [9]
    kept = neardup.dedup(odd_docs).select(odd_docs.columns)
    assert sorted([r.doc_id for r in kept.collect()], key=str) == [1, 3, 4, 5, 6, 7, 9, None]
    assert neardup.contract(no_docs).count() == 0 and neardup.dedup(no_docs).count() == 0


def test_large_family_stays_linear(spark):
    rng = random.Random(4)
    base = [f"w{rng.randrange(5000)}" for _ in range(150)]
    rows = []
    for i in range(400):
        text = list(base)
        text[i % 150] = f"x{i}"
        rows.append((i, " ".join(text)))
    got = neardup.contract(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.class_id for r in got} == {0} and max(r.n_edges for r in got) >= 390


def test_components(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (103, 101)], "a long, b long")
    got = {r.v: r.label for r in neardup.components(links).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 103: 100}
    assert neardup.components(links.where("false")).count() == 0


def test_pipeline_stage_by_stage(spark, sf, docs, labels):
    import corpus_pipeline as cp
    from tidewell.session import table

    assert [n for n, _ in cp.STAGES] == ["quality classifier", "quality rules", "near duplicates", "decontamination", "packing"]
    stage = dict(cp.STAGES)
    a = stage["quality classifier"](spark, docs, sf).cache()
    scores = {r.doc_id: r.score for r in quality.score(docs, quality.train(docs, labels, F.lit(True))).collect()}
    assert {r.doc_id for r in a.collect()} == {k for k, s in scores.items() if s >= 0.3} and a.columns == docs.columns
    b = stage["quality rules"](spark, a, sf).cache()
    cut = rules.calibrate(a, labels)
    assert {r.doc_id for r in b.collect()} == {r.doc_id for r in rules.verdicts(rules.measured(a), cut).where("kept").collect()} and b.columns == docs.columns
    c = stage["near duplicates"](spark, b, sf).cache()
    assert {r.doc_id for r in c.collect()} == {r.doc_id for r in neardup.contract(b).where("kept").collect()} and c.columns == docs.columns
    d = stage["decontamination"](spark, c, sf).cache()
    bad = {r.doc_id for r in decontam.contract(c, table(spark, sf, "benchmark")).where("contaminated").collect()}
    assert {r.doc_id for r in d.collect()} == {r.doc_id for r in c.collect()} - bad and d.columns == docs.columns
    e = stage["packing"](spark, d, sf).collect()
    assert {r.doc_id for r in e} == {r.doc_id for r in d.collect()}
    same = lambda rows: sorted(tuple(r)[:5] for r in rows)
    assert same(e) == same(pack.pack(d, tokenizer=vocabulary_path("byte_bpe_50k.json"), end_id=1).collect())
    whole = cp.run(spark, sf).collect()
    assert same(whole) == same(e)
    ends = {}
    for r in sorted(whole, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == ends.get(r.sequence_id, 0)
        ends[r.sequence_id] = r.offset + r.length
    assert max(ends.values()) <= 2048 and sum(ends.values()) > 0.95 * 2048 * len(ends)


def test_pipeline_of_odd_rows(spark, odd_docs, no_docs, sf):
    import corpus_pipeline as cp

    names = odd_docs.columns
    docs = odd_docs
    for name, f in cp.STAGES[:-1]:
        before, docs = [r for r in docs.collect()], f(spark, docs, sf).cache()
        after = docs.collect()
        assert docs.columns == names and all(r in before for r in after), name
        if name == "quality rules":  # the base rule: fewer than ten words
            assert all(len((r.text or "").split()) >= 10 for r in after)
        if name == "near duplicates":
            assert len({r.text for r in after}) == len(after)
    pieces = cp.STAGES[-1][1](spark, docs, sf).collect()
    assert {r.doc_id for r in pieces} == {r.doc_id for r in docs.collect()}
    # near duplicates alone: one of each text, whatever its id; a null text is an empty one
    kept = cp.STAGES[2][1](spark, odd_docs, sf).collect()
    assert sorted((r.text or "")[:20] for r in kept) == sorted({(r.text or "")[:20] for r in odd_docs.collect()})
    docs = no_docs
    for name, f in cp.STAGES:
        docs = f(spark, docs, sf)
        assert docs.count() == 0, name


@pytest.mark.parametrize("name", ["op1_token_store", "op3_minimax_shards", "op9_packing", "op10_main_text"])
def test_registered(name):
    import __spark_entry__ as e

    assert name in e.queries() and "pipeline" in e.queries()


def test_columns_of_any_name_stay(spark):
    """Columns that are named as helpers were or are stay as they are, in stages and operators."""
    base = " ".join(f"w{i}" for i in range(60))
    rows = [(k, base if k < 4 else f"{base} {k} unlike {k * 7}" * 2, *[f"{n}{k}" for n in ("a", "b", "c", "D", "R", "P")]) for k in range(8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _d string, _rep string, _place string, Digest string, REP string, place string")
    kept = sorted(map(tuple, neardup.dedup(docs).collect()))
    assert [r for r in rows if r[0] in {k[0] for k in kept}] == kept and 0 < len(kept) < 8 and kept[0][0] == 0
    bench = spark.createDataFrame([(k, " ".join(f"q{k}x{i}" for i in range(20))) for k in range(40)], "item_id long, text string")
    dirty = docs.union(spark.createDataFrame([(99, bench.first().text, *"abcdef")], docs.schema))
    for size in (200, 1 << 20):
        assert sorted(map(tuple, decontam.decontaminate(dirty, bench, block_bytes=size).collect())) == rows
        assert {r.doc_id: r.n_hit for r in decontam.scan(dirty, bench, block_bytes=size).collect()} == {**{k: 0 for k in range(8)}, 99: 20}


def test_stages_bound_the_bytes_of_batches(spark, sf, no_docs):
    import corpus_pipeline as cp

    name = "spark.sql.execution.arrow.maxBytesPerBatch"

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_pydict({"n": pa.array([b.nbytes], pa.int64())})

    texts = spark.range(0, 40, 1, 1).selectExpr("repeat('x', 1000000) t")
    try:
        for what, stage in cp.STAGES:
            spark.conf.unset(name)
            stage(spark, no_docs, sf)
            got = [r.n for r in texts.mapInArrow(sizes, "n long").collect()]
            assert sum(got) >= 40_000_000 and max(got) < 6_000_000, what
        spark.conf.set(name, "12000000")
        cp.packed(spark, no_docs, sf)
        assert spark.conf.get(name) == "12000000"
    finally:
        spark.conf.unset(name)
