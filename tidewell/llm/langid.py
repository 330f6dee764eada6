"""Language of words and texts by a linear-chain conditional random field.

A word's features are its hashed 2- to 4-grams of bytes with marks at both ends (so its
affixes too) and, if the learned lexicon has it, the word. Weights and transitions are
learned together: chains are made of runs of words from learnable documents of different
languages, each word labelled with its document's language, and the conditional
likelihood is maximised by AdaGrad with gradients from forward-backward.

Whole texts are labelled by exact forward-backward over all their words; all texts of a
block are one chain with a restart at each text, in which runs of RUN words are multiplied
out side by side. A text's language has the greatest sum of word marginals; ``score`` is
their mean. Null texts and texts without a letter are ``und`` with score 0, as is
everything if there is nothing to learn from. Equal texts get equal results.

Every language of the learnable documents can be predicted. At most ``per_language`` documents of
each are learned from, those with the least hashes of their ids, and of them at most ``words_per_language``
words in runs; of a document no more than its share of these or ``RUN_WORDS``, as runs from all over it.
So what the driver gets, and the model, have a size for each language, whatever the length of texts.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewell.llm.arrow import blocks, map_texts, words
from tidewell.session import ship

#: Documents and words of each language that are learned from, and the longest run of a document's words.
PER_LANGUAGE, WORDS_PER_LANGUAGE, RUN_WORDS = 300, 60_000, 50
GRAMS, LEXICON = 1 << 16, 1 << 14
RUN, CHAIN = 256, 60
#: Numbers that a worker's table of potentials may hold; words of as many languages as there are share them.
CACHE = 1_600_000
#: Languages up to which runs of a chain are multiplied out side by side; beyond, texts are side by side. Both are exact.
SIDE_BY_SIDE = 12
_ASCII_LETTER = re.compile(rb"[A-Za-z]")


def grams(some: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(features of all words one after the other, the number of each word's); words mustn't be empty."""
    raw = np.frombuffer(b"".join([b"\x01" + w + b"\x02" for w in some]), np.uint8).astype(np.uint64)
    size = np.fromiter(map(len, some), np.int64, len(some)) + 2
    end = np.repeat(np.cumsum(size), size)
    at = np.arange(len(raw))
    parts, owners = [], []
    owner = np.repeat(np.arange(len(some)), size)
    code = raw.copy()
    for n in (2, 3, 4):
        code = code[: len(raw) - n + 1] * np.uint64(257) + raw[n - 1 :]
        ok = at[: len(code)] + n <= end[: len(code)]
        h = (code[ok] + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)
        parts.append((h >> np.uint64(48)).astype(np.int64))
        owners.append(owner[: len(code)][ok])
    feature, who = np.concatenate(parts), np.concatenate(owners)
    order = np.argsort(who, kind="stable")
    return feature[order], np.bincount(who, minlength=len(some))


class Model:
    """languages, weights (features x languages), lexicon (word -> feature), transitions and starts as probabilities."""

    def __init__(self, languages: list[str], weights: np.ndarray, lexicon: dict[bytes, int], move: np.ndarray, start: np.ndarray):
        self.languages, self.weights, self.lexicon, self.move, self.start = languages, weights, lexicon, move, start

    def emissions(self, some: list[bytes]) -> np.ndarray:
        """Potentials of distinct words, the greatest of each word 1. Words of digits alone tell nothing."""
        feature, n = grams(some)
        e = np.add.reduceat(self.weights[feature], np.cumsum(n) - n, axis=0) / np.sqrt(n)[:, None]
        own = np.fromiter((self.lexicon.get(w, -1) for w in some), np.int64, len(some))
        e[own >= 0] += self.weights[GRAMS + own[own >= 0]]
        e[np.fromiter((w.isdigit() for w in some), bool, len(some))] = 0
        return np.exp(e - e.max(1, keepdims=True))


def posteriors(e: np.ndarray, first: np.ndarray, move: np.ndarray, start: np.ndarray, run: int = RUN) -> np.ndarray:
    """Marginals of each word; ``e``: potentials, ``first``: whether a text begins at a word."""
    n, k = e.shape
    if not n:
        return e
    if k > SIDE_BY_SIDE:
        return _by_text(e, first, move, start)
    blocks_, pad = -(-n // run), -n % run
    e = np.vstack([e, np.ones((pad, k))]).reshape(blocks_, run, k)
    first = np.concatenate([first, np.ones(pad, bool)]).reshape(blocks_, run)
    whole = np.tile(np.eye(k), (blocks_, 1, 1))
    for t in range(run):
        step = (whole.reshape(-1, k) @ move).reshape(blocks_, k, k)
        f = first[:, t]
        if f.any():
            step[f] = whole[f].sum(2, keepdims=True) * start
        whole = step * e[:, t, None, :]
        whole /= whole.sum((1, 2), keepdims=True)
    into, out = np.empty((blocks_, k)), np.empty((blocks_, k))
    a = start
    for b in range(blocks_):
        into[b] = a
        a = a @ whole[b]
        a = a / a.sum()
    z = np.ones(k)
    for b in range(blocks_ - 1, -1, -1):
        out[b] = z
        z = whole[b] @ z
        z = z / z.sum()
    alpha = np.empty_like(e)
    a = into
    for t in range(run):
        f = first[:, t, None]
        a = np.where(f, start, a @ move) * e[:, t]
        a /= a.sum(1, keepdims=True)
        alpha[:, t] = a
    z = out
    gamma = np.empty_like(e)
    for t in range(run - 1, -1, -1):
        g = alpha[:, t] * z
        gamma[:, t] = g / g.sum(1, keepdims=True)
        x = e[:, t] * z
        f = first[:, t, None]
        z = np.where(f, 1.0, x @ move.T)
        z = z / z.sum(1, keepdims=True)
    return gamma.reshape(-1, k)[:n]


def _by_text(e: np.ndarray, first: np.ndarray, move: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Marginals by a pass over places, in which all texts that are long enough take a step."""
    at = np.flatnonzero(np.append(True, first[1:]))
    size = np.diff(at, append=len(e))
    order = np.argsort(-size, kind="stable")
    at, size = at[order], size[order]
    alpha, gamma = np.empty_like(e), np.empty_like(e)
    going = np.searchsorted(-size, -np.arange(1, size[0] + 1), side="right")  # texts of more words than each place
    a = start * e[at]
    alpha[at] = a = a / a.sum(1, keepdims=True)
    for t in range(1, size[0]):
        here = at[: going[t]] + t
        a = (a[: going[t]] @ move) * e[here]
        alpha[here] = a = a / a.sum(1, keepdims=True)
    z = np.ones((0, e.shape[1]))
    for t in range(size[0] - 1, -1, -1):
        z = np.vstack([z, np.ones((going[t] - len(z), e.shape[1]))])
        here = at[: going[t]] + t
        g = alpha[here] * z
        gamma[here] = g / g.sum(1, keepdims=True)
        z = (e[here] * z) @ move.T
        z /= z.sum(1, keepdims=True)
    return gamma


def _runs(words: list[bytes], most: int, seed: int) -> list[list[bytes]]:
    """Runs of 6 to RUN_WORDS words that a text is cut into; of more than ``most`` words, some from all over it."""
    rng, runs, at = np.random.default_rng(seed), [], 0
    while at < len(words):
        n = int(rng.integers(6, RUN_WORDS))
        runs.append(words[at : at + n])
        at += n
    out, n = [], 0
    for i in rng.permutation(len(runs)).tolist():
        if n >= most:
            break
        out.append(runs[i])
        n += len(runs[i])
    return out


def _chains(runs: list[list[bytes]], labels: list[int], rng: np.random.Generator, most: int) -> tuple[list[bytes], np.ndarray]:
    """Words and labels of runs in random order, of each label at most ``most`` words; the last chain is filled up with the first words."""
    out, y, n = [], [], {}
    for i in rng.permutation(len(runs)).tolist():
        had = n.get(labels[i], 0)
        if had < most:
            n[labels[i]] = had + len(runs[i])
            out += runs[i]
            y += [labels[i]] * len(runs[i])
    n = -(-len(out) // CHAIN) * CHAIN
    while 0 < len(out) < n:
        out, y = out + out[: n - len(out)], y + y[: n - len(y)]
    return out, np.array(y)


def expectations(e: np.ndarray, move: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(marginals of each word of each chain, expected number of each transition in all) by forward-backward."""
    rows, n, k = e.shape
    alpha, beta = np.empty_like(e), np.empty_like(e)
    a = begin * e[:, 0]
    alpha[:, 0] = a = a / a.sum(1, keepdims=True)
    for i in range(1, n):
        a = (a @ move) * e[:, i]
        alpha[:, i] = a = a / a.sum(1, keepdims=True)
    beta[:, -1] = b = np.ones((rows, k))
    expected = np.zeros((k, k))
    for i in range(n - 1, 0, -1):
        x = e[:, i] * b
        both = ((alpha[:, i - 1] @ move) * x).sum(1, keepdims=True)
        expected += (alpha[:, i - 1] / both).T @ x
        b = x @ move.T
        beta[:, i - 1] = b = b / b.sum(1, keepdims=True)
    gamma = alpha * beta
    return gamma / gamma.sum(2, keepdims=True), expected * move


def fit(runs: list[list[bytes]], labels: list[int], languages: list[str], words: int = WORDS_PER_LANGUAGE, epochs: int = 6, batch: int = 150, rate: float = 0.3) -> Model | None:
    """The model of most conditional likelihood of runs of words, each of one language."""
    k, rng = len(languages), np.random.default_rng(7)
    seq, gold = _chains(runs, labels, rng, words)
    if not seq:
        return None
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in seq), np.int64, len(seq))
    distinct = list(number)
    often = np.bincount(ids)
    lexicon = {distinct[i]: j for j, i in enumerate(np.argsort(-often, kind="stable")[:LEXICON].tolist()) if often[i] > 2 and not distinct[i].isdigit()}
    feature, n = grams(distinct)
    first = np.cumsum(n) - n
    own = np.array([lexicon.get(w, -1) for w in distinct])
    weights, seen = np.zeros((GRAMS + LEXICON, k)), np.full((GRAMS + LEXICON, k), 1e-2)
    move, seen_move = np.zeros((k, k)), np.full((k, k), 1e-2)
    ids, gold = ids.reshape(-1, CHAIN), gold.reshape(-1, CHAIN)
    begin = np.full(k, 1 / k)
    for _ in range(epochs):
        for rows in np.array_split(rng.permutation(len(ids)), max(1, len(ids) // batch)):
            w, inverse = np.unique(ids[rows], return_inverse=True)
            m = n[w]
            stop = np.cumsum(m)
            f = feature[np.repeat(first[w] - stop + m, m) + np.arange(stop[-1])]
            scale = 1 / np.sqrt(m)
            e = np.add.reduceat(weights[f], stop - m, axis=0) * scale[:, None]
            has = own[w] >= 0
            e[has] += weights[GRAMS + own[w][has]]
            e = np.exp(e - e.max(1, keepdims=True))[inverse].reshape(len(rows), CHAIN, k)
            t = np.exp(move - move.max(1, keepdims=True))
            gamma, expected = expectations(e, t, begin)
            y = gold[rows]
            g = -gamma.reshape(-1, k)
            g[np.arange(len(g)), y.ravel()] += 1
            by_word = np.stack([np.bincount(inverse.ravel(), g[:, j], len(w)) for j in range(k)], 1) / len(rows)
            spread = np.repeat(by_word * scale[:, None], m, axis=0)
            grad = np.stack([np.bincount(f, spread[:, j], len(weights)) for j in range(k)], 1)
            grad[GRAMS + own[w][has]] += by_word[has]
            observed = np.bincount((y[:, :-1] * k + y[:, 1:]).ravel(), minlength=k * k).reshape(k, k)
            grad_move = (observed - expected) / len(rows) / CHAIN
            seen += grad**2
            seen_move += grad_move**2
            weights += rate * grad / np.sqrt(seen)
            move += rate * grad_move / np.sqrt(seen_move)
    t = np.exp(move - move.max(1, keepdims=True))
    return Model(languages, weights, lexicon, t / t.sum(), begin)


def train(docs: DataFrame, learnable: F.Column, *, key: str = "doc_id", text: str = "text", lang: str = "lang", per_language: int = PER_LANGUAGE, words_per_language: int = WORDS_PER_LANGUAGE) -> Model | None:
    """The model, fitted on rows for which ``learnable`` holds; None if there are none.

    Few texts pass a threshold of their ids' hash by language; of them each task sends at most ``per_language`` rows of
    each, however often an id repeats, and only their runs of words come to the driver.
    """
    spark = docs.sparkSession
    ship(spark)
    known = docs.where(learnable & F.col(f"`{lang}`").isNotNull() & F.col(f"`{text}`").isNotNull()).select(F.xxhash64(F.col(f"`{key}`"), F.lit(53)).alias("h"), F.col(f"`{lang}`").cast("string").alias("lang"), F.col(f"`{text}`").cast("string").cast("binary").alias("t"))
    counts = {r.lang: r.n for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return None
    below = [(x, min(2**63 - 1, int(min(1.0, 2 * per_language / n) * 2**64) - 2**63)) for x, n in counts.items()]
    some = known.join(F.broadcast(spark.createDataFrame(below, "lang string, below long")), "lang").where("h <= below")
    first = Window.partitionBy("lang").orderBy("h", F.xxhash64("t"))
    some = some.withColumn("place", F.row_number().over(first)).where(F.col("place") <= per_language)
    share = max(RUN_WORDS, 2 * words_per_language // per_language)

    def cut(keys, texts):
        return [keys[0], [h & 0x7FFFFFFF for h in keys[1].to_pylist()], [[b" ".join(x) for x in _runs(words(t), share, h & 0x7FFFFFFF)] for t, h in zip(texts, keys[1].to_pylist())]]

    rows = map_texts(some, ["lang", "h"], "t", cut, "lang string, h long, runs array<binary>").collect()
    languages, runs, labels = sorted(counts), [], []
    for r in sorted(rows, key=lambda r: (r.h, r.lang, r.runs)):
        runs += [bytes(x).split() for x in r.runs]
        labels += [languages.index(r.lang)] * len(r.runs)
    return fit(runs, labels, languages, words_per_language)


def has_letter(text: bytes | None) -> bool:
    return bool(text) and (bool(_ASCII_LETTER.search(text)) or any(map(str.isalpha, text.decode("utf-8", "replace"))))


class Labeller:
    """Potentials of the words that this process has seen, and marginals of texts."""

    def __init__(self, model: Model):
        self.model = model
        self.clear()

    def clear(self) -> None:
        self.number: dict[bytes, int] = {}
        self.table = np.empty((0, len(self.model.languages)))

    def marginals(self, texts: list[list[bytes]]) -> np.ndarray:
        if len(self.number) * len(self.model.languages) > CACHE:
            self.clear()
        number, known = self.number, len(self.number)
        new = [w for w in dict.fromkeys(w for t in texts for w in t) if w not in number]
        number.update(zip(new, range(known, known + len(new))))
        if new:
            self.table = np.concatenate([self.table, self.model.emissions(new)])
        size = np.fromiter(map(len, texts), np.int64, len(texts))
        ids = np.fromiter((x for t in texts for x in map(number.__getitem__, t)), np.int64, int(size.sum()))
        first = np.zeros(len(ids), bool)
        first[(np.cumsum(size) - size)[size > 0]] = True
        return posteriors(self.table[ids], first, self.model.move, self.model.start)


_labellers: dict[str, Labeller] = {}


def _labeller(shared) -> Labeller:
    name = str(shared.value[0])
    if name not in _labellers:
        _labellers.clear()
        _labellers[name] = Labeller(shared.value[1])
    return _labellers[name]


def _predict(shared):
    def run(keys, texts):
        lang, score = ["und"] * len(texts), [0.0] * len(texts)
        if shared.value[1] is not None:
            me = _labeller(shared)
            for a, b in blocks(texts, 2_000_000):
                some = [words(t) if has_letter(t) else [] for t in texts[a:b]]
                g, at = me.marginals(some), 0
                for i, w in enumerate(some):
                    if w:
                        mean = g[at : at + len(w)].mean(0)
                        at += len(w)
                        best = int(mean.argmax())
                        lang[a + i], score[a + i] = me.model.languages[best], float(min(1.0, mean[best]))
        return [keys[0], lang, score]

    return run


def _spread(spark, model):
    import uuid

    return spark.sparkContext.broadcast((uuid.uuid4().hex, model))


def predict(docs: DataFrame, model: Model | None, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, lang_pred, score of each row. The model has a size for each language."""
    ship(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()
    return map_texts(docs, [key], text, _predict(_spread(docs.sparkSession, model)), f"k {kind}, lang_pred string, score double").withColumnRenamed("k", key)


def label_words(docs: DataFrame, model: Model, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, spans array<struct<first, n, lang>>: runs of words by their likeliest language, for code-switched texts."""
    ship(docs.sparkSession)
    shared = _spread(docs.sparkSession, model)

    def run(keys, texts):
        me, out = _labeller(shared), []
        some = [words(t) for t in texts]
        best, at = me.marginals(some).argmax(1), 0
        for w in some:
            y = best[at : at + len(w)]
            at += len(w)
            cut = np.flatnonzero(np.diff(y, prepend=-1)).tolist()
            out.append([{"first": a, "n": b - a, "lang": me.model.languages[y[a]]} for a, b in zip(cut, [*cut[1:], len(w)])])
        return [keys[0], out]

    return map_texts(docs, [key], text, run, f"k {docs.schema[key].dataType.simpleString()}, spans array<struct<first:long,n:long,lang:string>>").withColumnRenamed("k", key)


def held_out(key: str = "doc_id") -> F.Column:
    return F.crc32(F.col(key).cast("string").cast("binary")) % 4 == 2


def contract(docs: DataFrame) -> DataFrame:
    out = predict(docs, train(docs, ~held_out()))
    return out.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "lang_pred", "score")
