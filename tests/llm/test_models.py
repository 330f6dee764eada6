"""op4, op6 and op8: the classifier, the rules, the language model."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewell.llm import langid, quality, rules


def held(key, m, r):
    return key is not None and zlib.crc32(str(key).encode()) % m == r


@pytest.fixture(scope="module")
def larger(spark):
    return [spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels")]


def test_classifier_on_held_out_rows(larger):
    docs, labels = larger
    got = {r.doc_id: r for r in quality.contract(docs, labels).collect()}
    assert len(got) == docs.count() and all(r.held_out == held(k, 5, 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for k, r in got.items())
    out = [(r.quality, got[r.doc_id].predicted) for r in labels.collect() if got[r.doc_id].held_out]
    assert sum(a == b for a, b in out) >= 0.97 * len(out)
    assert sum(p for q, p in out if q == 1) >= 0.98 * sum(q for q, _ in out)


def test_classifier_never_sees_held_out_labels(larger):
    docs, labels = larger
    one = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    turned = labels.withColumn("quality", F.when(one, 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = (quality.train(docs, x, ~quality.held_out()) for x in (labels, turned))
    assert all(np.array_equal(x, y) for x, y in zip(a, b))


def test_risk_is_non_negative_and_beats_chance():
    rng = np.random.default_rng(0)
    good, bad = rng.normal(1, 1, (800, 3)), rng.normal(-1, 1, (800, 3))
    one = lambda x: np.hstack([x, np.ones((len(x), 1))])
    positive, unlabelled = one(good[:400]), one(np.vstack([good[400:], bad]))
    w, mean, scale = quality.fit(positive, unlabelled, 1 / 3)
    f = lambda x: (x - mean) / scale @ w
    assert (f(one(good)) > 0).mean() > 0.8 and (f(one(bad)) < 0).mean() > 0.8

    def brute(w):
        """The risk row by row, from its definition."""
        loss = lambda z: math.log1p(math.exp(-z))
        score = lambda rows: [sum(a * b for a, b in zip((r - mean) / scale, w)) for r in rows]
        fp, fu = score(positive), score(unlabelled)
        negative = sum(loss(-z) for z in fu) / len(fu) - sum(loss(-z) for z in fp) / len(fp) / 3
        return sum(loss(z) for z in fp) / len(fp) / 3 + max(0.0, negative)

    least = brute(w)
    assert abs(least - quality.risk(f(positive), f(unlabelled), 1 / 3)) < 1e-9 and least >= 0
    assert all(least <= brute(w + d) + 2e-3 for d in rng.normal(0, 0.3, (20, 4))) and least < brute(0 * w)
    assert quality.negative_risk(np.full(9, 5.0), np.full(9, -5.0), 0.9) < 0 and quality.risk(np.full(9, 5.0), np.full(9, -5.0), 0.9) >= 0


@pytest.mark.parametrize("share", [0.3, 0.6, 0.85])
def test_prior_from_positives_and_unlabelled_rows(share):
    rng = np.random.default_rng(1)
    draw = lambda n, at: np.hstack([rng.normal(at, 1, (n, 3)), np.ones((n, 1))])
    n = 6000
    got = quality.estimate_prior(draw(n, 1.3), np.vstack([draw(int(n * share), 1.3), draw(n - int(n * share), -1.3)])[rng.permutation(n)])
    assert share - 0.1 < got < share + 0.02


def test_features_of_a_text():
    text = b"Ab ab ab, 12\n\nxy xy.\nxy xy."
    x = quality.features(text)
    kinds = [quality._KINDS[b] for b in text]
    assert np.allclose(x[: quality.N_KINDS] ** 2, [kinds.count(k) / len(text) for k in range(quality.N_KINDS)])
    w = text.split()
    same, second = sum(a == b for a, b in zip(w, w[1:])), sum(a == b for a, b in zip(w, w[2:]))
    sizes = [len(a) for a in w]
    expected = [math.sqrt(same / 8), math.sqrt(second / 8), len(set(w)) / 8, len(set(w)) / 8**0.8, math.sqrt(1 - 2 / 3), np.mean(sizes) / 6, np.std(sizes) / 6, math.log1p(8) / 10, 0, 1, 1, 1]
    assert len(w) == 8 and np.allclose(x[quality.N_KINDS :], expected)
    assert quality.features(None).tolist() == quality.features(b"").tolist() == [0] * (quality.N - 1) + [1]


def test_classifier_of_repeated_and_named_ids(spark):
    rows = [(f"d{i % 50}" if i % 3 else "hot", f"text {i} of some words" if i % 2 else "## $$ ##") for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id string, text string")
    labels = spark.createDataFrame([(f"d{i}", i % 2, 0) for i in range(50)] + [("hot", 1, 0)], "doc_id string, quality int, toxic int")
    got = quality.contract(docs, labels).collect()
    assert len(got) == 900 and quality.train(docs, labels, F.lit(True), most_rows=30) is not None


def test_classifier_of_odd_rows(spark, odd_docs, no_docs, labels):
    some = spark.createDataFrame([(1, 1, 0), (3, 1, 0), (4, 0, 0), (None, 1, 0), (77, 0, 1)], labels.schema)
    got = quality.contract(odd_docs, some).collect()
    assert len(got) == odd_docs.count() and all(0 <= r.score <= 1 and r.held_out == held(r.doc_id, 5, 0) for r in got)
    assert quality.contract(no_docs, some).count() == 0
    assert {r.score for r in quality.contract(odd_docs, some.where("false")).collect()} == {1.0}
    kept = quality.keep_good(odd_docs, quality.train(odd_docs, some, F.lit(True)))
    assert kept.columns == odd_docs.columns and kept.count() <= odd_docs.count()


# rules


def brute_measures(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines, seen, dup = text.split("\n"), set(), 0
    for line in lines:
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    grams = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    hit = {j for i in range(len(w) - 4) if grams[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(hit), len(w) < 10 or 100 * len(hit) > 20 * len(w)


def test_rule_measures(docs, odd_docs):
    texts = [r.text for r in docs.collect()] + [r.text for r in odd_docs.collect()] + ["a b c d e a b c d e", "x " * 50, "a\x0bb\x1cc\xa0d", "q\n q\nq\n\n\n", "\x85\n\x85\n"]
    for t in texts:
        assert rules.measure(t.encode() if t is not None else None)[:6] == brute_measures(t)


def test_binomial_bounds():
    for k, n, d in ((0, 100, 0.05), (3, 50, 0.01), (10, 2000, 0.001)):
        p = rules.upper_bound(k, n, d)
        tail = sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))
        assert abs(tail - d) < 1e-6 * max(1, d / 1e-3)
    assert rules.upper_bound(5, 5, 0.05) == 1.0 and rules.upper_bound(0, 0, 0.05) == 1.0
    assert abs(rules.upper_bound(0, 100, 0.05) - (1 - 0.05 ** (1 / 100))) < 1e-9


def test_cutoffs_are_safe_and_ordered():
    safe = rules.choose({}, {"big": 10_000, "small": 20})
    assert safe["big"] == [rules.GRID[-1]] * len(rules.RULES) and safe["small"] == [None] * len(rules.RULES)
    some = rules.choose({("big", 0): {5: 500}}, {"big": 10_000})
    assert some["big"][0] == rules.GRID[4]


def test_small_strata_have_cutoffs():
    none = len(rules.RULES) * [None]
    cut = rules.choose({}, {"a": 2000, "b": 500, "c": 490, "d": 310, "tiny": 100})
    assert all(cut[s] == [rules.GRID[-1]] * len(rules.RULES) for s in "abcd") and cut["tiny"] == none
    # one joint set: rules that fail different good rows share alpha, and the next goes on without the one that stopped
    cut = rules.choose({("a", 0): {6: 30}, ("a", 1): {9: 150}, ("a", 3): {12: 150}}, {"a": 10_000})["a"]
    assert cut == [rules.GRID[-1], rules.GRID[8], rules.GRID[-1], rules.GRID[11], rules.GRID[-1], rules.GRID[-1]]
    cut = rules.choose({("a", r): {3: 50} for r in range(6)}, {"a": 10_000})["a"]
    assert cut == [rules.GRID[-1]] * 3 + [rules.GRID[2], None, None]  # 150 of 10,000 are safe, 200 aren't


def test_all_rules_together_stay_within_alpha():
    """By simulation: the share of tables on which a set that rejects over alpha of good texts is taken."""
    rng, wrong, n = np.random.default_rng(5), 0, 400
    for _ in range(300):
        fails = {r: rng.random(n) < 0.012 for r in range(3)}  # each rule is safe alone, no two together
        def failing(places):
            out = Counter()
            for i in range(n):
                at = [places["a"][r * (len(rules.GRID) + 1) + 10] for r in fails if fails[r][i]]
                out.update([min(x for x in at if x is not None)] if any(x is not None for x in at) else [])
            return {"a": out}
        cut = rules.walk({"a": n}, {"a": rules.sequence(list(range(6)), [23] * 6)}, failing, 0.02, 0.05)["a"]
        wrong += sum(cut[r] is not None and cut[r] <= rules.GRID[10] for r in fails) > 1
    assert wrong <= 0.05 * 300


def test_registered_rules_reject_bad_rows_of_small_strata(spark):
    """The query with its own alpha and delta: 280 good rows are enough."""
    words = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(words[j % 60] for j in range(i % 40, i % 40 + 20)), "fr", "s", 0) for i in range(280)]
    rows += [(1000 + i, " ".join(f"{w}#$%" for w in words[i : i + 20]), "fr", "s", 0) for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(r[0], int(r[0] < 1000), 0) for r in rows if r[0] < 1020], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in rules.contract(docs, labels).collect()}
    assert {k for k, r in got.items() if r.kept} == {k for k in got if k < 1000}
    assert all("symbols" in got[k].failed_rules for k in got if k >= 1000)


def test_rules(larger):
    docs, labels = larger
    got = {r.doc_id: r for r in rules.contract(docs, labels).collect()}
    assert len(got) == docs.count()
    for r in docs.collect():
        g = got[r.doc_id]
        assert (g.n_words, g.word_chars, g.n_symbols, g.n_dup_lines, g.n_repeat_words, g.base_failed) == brute_measures(r.text)
        assert not (g.kept and g.base_failed)
    good = [got[r.doc_id] for r in labels.where("quality = 1").collect()]
    fine = [g for g in good if not g.base_failed]
    assert sum(g.kept for g in fine) >= 0.97 * len(fine)
    cut = rules.calibrate(docs, labels, alpha=0.2)
    assert any(c is not None for c in cut["en"])
    kept = {r.doc_id for r in rules.keep_passing(docs, cut).collect()}
    assert kept == {r.doc_id for r in rules.verdicts(rules.measured(docs), cut).where("kept").collect()} and len(kept) < len(got)


def test_rules_of_odd_rows(odd_docs, no_docs, labels):
    got = rules.contract(odd_docs, labels).collect()
    assert len(got) == odd_docs.count() and all(r.base_failed and not r.kept for r in got if not r.n_words)
    assert rules.contract(no_docs, labels).count() == 0 and rules.contract(odd_docs, labels.where("false")).count() == len(got)
    assert rules.keep_passing(odd_docs, {}).columns == odd_docs.columns


def test_rules_of_many_strata(spark):
    """Over 2,000 strata: three can be tested, and cutoffs of as many as there are can be applied."""
    import time

    good, bad = " ".join(f"w{i}" for i in range(20)), " ".join(f"w{i}#" for i in range(20))
    docs = spark.range(60_000).selectExpr("id as doc_id", f"if(id % 7 = 0, '{bad}', '{good}') as text", "case when id % 10 < 6 then 'a' when id % 10 = 6 then 'b' when id % 10 = 7 then 'c' else concat('s', id % 2003) end as lang")
    labels = docs.selectExpr("doc_id", "cast(if(doc_id % 7 = 0, 0, 1) as int) as quality", "0 as toxic")
    assert docs.select("lang").distinct().count() > 2000
    began = time.time()
    m = rules.measured(docs).cache()
    cutoffs = rules.cutoffs_of(m, labels)
    assert set(cutoffs) == set("abc")
    lost = [r.doc_id for r in rules.verdicts(m, cutoffs).where("not kept").collect()]
    assert sorted(lost) == [i for i in range(0, 60_000, 7) if i % 10 < 8] and time.time() - began < 40
    many = {f"s{i}": [0.1] * len(rules.RULES) for i in range(2003)}
    began = time.time()
    lost = [r.doc_id for r in rules.verdicts(m, many).where("not kept").collect()]
    assert sorted(lost) == [i for i in range(0, 60_000, 7) if i % 10 >= 8] and time.time() - began < 30
    assert sorted(r.doc_id for r in docs.select("doc_id").join(rules.keep_passing(docs, many), "doc_id", "left_anti").collect()) == sorted(lost)


# languages


def brute_posteriors(e, move, start):
    n, k = e.shape
    a, b = [start * e[0]], [np.ones(k)]
    for t in range(1, n):
        a.append((a[-1] @ move) * e[t])
    for t in range(n - 1, 0, -1):
        b.append(move @ (e[t] * b[-1]))
    g = np.array(a) * np.array(b[::-1])
    return g / g.sum(1, keepdims=True)


def test_forward_backward():
    rng = np.random.default_rng(3)
    e, move, start = rng.random((83, 4)) + 0.02, rng.random((4, 4)), np.full(4, 0.25)
    first = np.zeros(83, bool)
    first[[0, 1, 30, 64]] = True
    got = langid.posteriors(e, first, move, start, run=8)
    cuts = [0, 1, 30, 64, 83]
    assert np.allclose(got, np.concatenate([brute_posteriors(e[a:b], move, start) for a, b in zip(cuts, cuts[1:])]))


def test_forward_backward_by_text():
    rng = np.random.default_rng(4)
    k = langid.SIDE_BY_SIDE + 3
    e, move, start = rng.random((83, k)) + 0.02, rng.random((k, k)), np.full(k, 1 / k)
    cuts = [0, 1, 30, 31, 64, 83]
    first = np.zeros(83, bool)
    first[cuts[:-1]] = True
    assert np.allclose(langid.posteriors(e, first, move, start), np.concatenate([brute_posteriors(e[a:b], move, start) for a, b in zip(cuts, cuts[1:])]))


def test_expectations_are_those_of_all_paths():
    """The parts of the gradient against sums over all label paths."""
    from itertools import product

    rng = np.random.default_rng(6)
    e, move, begin = rng.random((2, 4, 3)) + 0.05, rng.random((3, 3)) + 0.05, np.full(3, 1 / 3)
    gamma, pairs, total = np.zeros((2, 4, 3)), np.zeros((3, 3)), np.zeros(2)
    for c in range(2):
        weight = {}
        for path in product(range(3), repeat=4):
            w = begin[path[0]] * e[c, 0, path[0]]
            for i in range(1, 4):
                w *= move[path[i - 1], path[i]] * e[c, i, path[i]]
            weight[path] = w
        total[c] = sum(weight.values())
        for path, w in weight.items():
            for i, y in enumerate(path):
                gamma[c, i, y] += w / total[c]
            for a, b in zip(path, path[1:]):
                pairs[a, b] += w / total[c]
    got = langid.expectations(e, move, begin)
    assert np.allclose(got[0], gamma) and np.allclose(got[1], pairs)


def test_any_number_of_languages(spark):
    """150 languages, a third of the rows under one id, and a text of 120,000 words."""
    rows = []
    for x in range(150):
        own = [f"{chr(97 + x % 26)}{chr(97 + x // 26)}{i}q" for i in range(12)]
        rows += [(7 if i == 0 else 1000 * x + i, " ".join(own[(i + j) % 12] for j in range(12)), f"l{x}") for i in range(9)]
    rows += [(7, rows[0][1], "l0")] * 700 + [(9, " ".join([rows[0][1]] * 10_000), "l0")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(docs, F.lit(True), per_language=20, words_per_language=400)
    assert len(model.languages) == 150
    got = langid.predict(docs, model).collect()
    lang = {}
    for r in rows:
        lang.setdefault(r[0], set()).add(r[2])
    right = [r.lang_pred in lang[r.doc_id] for r in got]
    assert len(got) == len(rows) and sum(right) >= 0.97 * len(right) and len({r.lang_pred for r in got}) > 140


def test_languages_of_held_out_rows(larger):
    docs, _ = larger
    got = {r.doc_id: r for r in langid.contract(docs).collect()}
    rows = docs.collect()
    assert all(got[r.doc_id].held_out == held(r.doc_id, 4, 2) and 0 <= got[r.doc_id].score <= 1 for r in rows)
    out = [(r.lang, got[r.doc_id].lang_pred) for r in rows if got[r.doc_id].held_out]
    assert sum(a == b for a, b in out) >= 0.97 * len(out)


def test_words_of_a_switched_text(spark, larger):
    docs, _ = larger
    model = langid.train(docs, F.lit(True), per_language=60)
    parts = {r.lang: " ".join(r.text.split()[:40]) for r in docs.where("lang in ('en', 'de') and n_chars > 800").collect()}
    mixed = spark.createDataFrame([(1, parts["en"] + " " + parts["de"]), (2, "")], "doc_id long, text string")
    got = {r.doc_id: r.spans for r in langid.label_words(mixed, model).collect()}
    share = Counter()
    for s in got[1]:
        for i in range(s.first, s.first + s.n):
            share[s.lang, i < 40] += 1
    assert share["en", True] > 30 and share["de", False] > 30 and got[2] == []


def test_languages_of_odd_rows(odd_docs, no_docs):
    got = langid.contract(odd_docs).collect()
    assert len(got) == odd_docs.count()
    for r in got:
        assert (r.lang_pred == "und") == (r.doc_id in (1, 2, 9)) and r.lang_pred in ("und", "en", "fr", "xx")
    assert langid.contract(no_docs).count() == 0
    assert {r.lang_pred for r in langid.contract(odd_docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_few_words_are_enough_to_learn_from(spark):
    """``und`` is for texts without letters only, however few words there are to learn from."""
    rows = [(4, "the cat and the dog", "en"), (5, "le chat et le chien", "fr"), (8, "the house and the tree", "en"), (9, "le jardin et la maison", "fr"), (2, "the dog and the house", "en"), (6, "le chien et la maison", "fr"), (10, "123 -- 4", "en"), (14, None, None), (18, "Ö", None)]
    got = {r.doc_id: r.lang_pred for r in langid.contract(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert {k for k, x in got.items() if x == "und"} == {10, 14} and set(got.values()) == {"en", "fr", "und"}
    one = spark.createDataFrame([(k, t, x) for k, t, x in rows if k == 4 or k > 8], "doc_id long, text string, lang string")
    assert {r.doc_id: r.lang_pred for r in langid.contract(one).collect()}[4] != "und"
