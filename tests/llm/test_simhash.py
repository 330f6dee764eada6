"""op13 against brute force, and the Golay keys."""

import random
from itertools import combinations

import numpy as np
import pytest
import xxhash

from tidewell.llm import golay, simhash


def brute_print(text):
    w = (text or "").encode().translate(bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))).split()
    shingles = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([b" ".join(w)] if w else [])
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints):
    """The number of each fingerprint's component, by all pairs."""
    x = np.array(sorted(set(prints)), np.uint64)
    label = np.arange(len(x))
    while True:
        new = np.array([label[np.bitwise_count(x ^ y) <= 3].min() for y in x])
        if (new == label).all():
            return dict(zip(x.tolist(), label.tolist()))
        label = new


def brute_classes(rows):
    label = brute_components([f for _, f in rows])
    least = {}
    for k, f in rows:
        if k is not None:
            least[label[f]] = min(k, least.get(label[f], k))
    return sorted(((k, f"{f:016x}", least.get(label[f])) for k, f in rows), key=repr)


def test_the_code_is_perfect():
    assert np.bincount(golay._N).tolist() == [0, 277, 0, 0, 0, 0, 1771]
    words = np.arange(1 << 23, dtype=np.int64)[:: 1009]
    keys, n = golay.near_codewords(words)
    first = keys[np.cumsum(n) - n]
    assert np.array_equal(golay.near_codewords(first << 11 | 0)[1].shape, n.shape)
    code = words ^ golay._ERROR[golay._BY_BYTE[0][words & 255] ^ golay._BY_BYTE[1][words >> 8 & 255] ^ golay._BY_BYTE[2][words >> 16]]
    assert all(golay._remainder(int(c)) == 0 for c in code) and np.array_equal(code >> 11, first)
    assert np.bitwise_count(code ^ words).max() <= 3


def test_words_two_bits_apart_share_a_key():
    rng = np.random.default_rng(3)
    for x in rng.integers(0, 1 << 23, 60).tolist():
        near = np.array([x ^ sum(1 << b for b in bits) for w in (0, 1, 2) for bits in combinations(range(23), w)])
        own = set(golay.near_codewords(np.array([x]))[0].tolist())
        keys, n = golay.near_codewords(near)
        owner = np.repeat(np.arange(len(near)), n)
        assert len(set(owner[np.isin(keys, list(own))].tolist())) == len(near)


def test_fingerprints_three_bits_apart_share_a_key():
    rng = np.random.default_rng(4)
    for x in rng.integers(0, 2**64, 2, dtype=np.uint64):
        near = np.array([int(x) ^ sum(1 << b for b in bits) for w in (1, 2, 3) for bits in combinations(range(64), w)], np.uint64)
        keys, owner = golay.keys(near)
        assert len(set(owner[np.isin(keys, golay.keys(np.array([x]))[0])].tolist())) == len(near)


def test_fingerprints(docs, monkeypatch):
    texts = [r.text for r in docs.collect()] + [None, "", " \n", "One", "one TWO", "ONE two three", "a b c a b c", "été É x", "x" * 3000, "x y " * 2000]
    raw = [(t or "").encode() for t in texts]
    assert simhash.fingerprints_of(raw).tolist() == [brute_print(t) for t in texts]
    monkeypatch.setattr(simhash, "_SPAN", 64)
    assert simhash.fingerprints_of(raw).tolist() == [brute_print(t) for t in texts]


def test_forest_joins_what_is_near():
    rng = np.random.default_rng(5)
    seeds = rng.integers(0, 2**64, 20, dtype=np.uint64)
    x = np.unique(np.concatenate([seeds, *[seeds ^ sum(np.uint64(1) << np.uint64(b) for b in rng.choice(64, 2, False)) for _ in range(30)]]))
    a, b = simhash.forest(x)
    assert (np.bitwise_count(a ^ b) <= 3).all() and len(a) < len(x)
    label = brute_components(x.tolist())
    assert len(a) == len(x) - len(set(label.values())) and all(label[p] == label[q] for p, q in zip(a.tolist(), b.tolist()))


@pytest.mark.parametrize("most", [1 << 14, 3])
def test_components_of_families(spark, most):
    """Families that reach far beyond three bits by steps; with short keys all turns are taken."""
    r = random.Random(most)
    prints = [r.getrandbits(64) for _ in range(30)]
    for _ in range(170):
        f = r.choice(prints)
        for b in r.sample(range(64), r.choice([1, 2, 3, 3, 4, 5])):
            f ^= 1 << b
        prints.append(f)
    prints = sorted(set(prints))
    df = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in prints], "f long")
    got = [(a & (1 << 64) - 1, b & (1 << 64) - 1) for a, b in simhash.links(df, most).collect()]
    assert all((a ^ b).bit_count() <= 3 for a, b in got)
    label, root = brute_components(prints), {f: f for f in prints}

    def top(f):
        while root[f] != f:
            f = root[f]
        return f

    for a, b in got:
        root[top(a)] = top(b)
    assert len({top(f) for f in prints}) == len(set(label.values()))
    assert all(label[f] == label[top(f)] for f in prints)


def test_classes_are_those_of_all_pairs(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r.doc_id, brute_print(r.text)) for r in docs.collect()]
    got = sorted((tuple(r) for r in simhash.contract(docs).collect()), key=repr)
    assert got == brute_classes(rows)
    assert any(k != c for k, _, c in got)


def test_odd_rows(spark, odd_docs, no_docs):
    rows = [(r.doc_id, brute_print(r.text)) for r in odd_docs.collect()]
    assert sorted((tuple(r) for r in simhash.contract(odd_docs).collect()), key=repr) == brute_classes(rows)
    assert simhash.contract(no_docs).collect() == []
    only = spark.createDataFrame([(None, "no ids at all"), (None, None)], "doc_id long, text string")
    assert [r.component_id for r in simhash.contract(only).collect()] == [None, None]
