"""Quality classifier by positive-unlabelled learning.

Rows labelled 1 are trusted positives. All rows that may be learned from, whatever their labels, positives too, are
what the unlabelled rows are drawn from: web text as it comes, which has positives in it. A linear model over the shape of a text minimises the non-negative unbiased risk
(Kiryo and others, 2017): with prior p, positives P, unlabelled U and logistic loss l,
    p * mean_P l(f) + max(0, mean_U l(-f) - p * mean_P l(-f)).
The prior is estimated from positives and unlabelled rows alone, by the best bin (Garg and
others, 2021): a classifier that tells P from U is fitted on half of both, and of the cutoffs on
its scores of the other half the one is taken above which the ratio of U's share to P's, with a
bound of its error, is least. Features are ratios of kinds of characters, lines and words in the
whole text; no feature knows the language, source, id or label of a row.

At most ``most_rows`` rows of each kind are learned from, those with the least hashes of
their ids, however often an id repeats; everything is scored. Ids may be of any type. Null and empty texts have the features of no words and
get a score as any other. Labels without a document are ignored; a document labelled twice
counts once. Without a positive row to learn from, all scores are 1.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewell.llm.arrow import filter_texts, map_texts
from tidewell.session import ship

#: Rows of each kind that the model is fitted on.
MOST_ROWS = 6000
#: ASCII characters that are counted one by one; letters, digits, white space and the rest are counted by kind.
SIGNS = b"#*$%&|<>!?.,;:'\"()[]{}/\\_-+=~^@`"
#: Powers of two up to which lengths are told apart.
_KINDS = np.zeros(256, np.int64)
for _b in range(256):
    _KINDS[_b] = 1 if 97 <= _b <= 122 else 2 if 65 <= _b <= 90 else 3 if 48 <= _b <= 57 else 4 if _b == 10 else 5 if _b in (9, 11, 12, 13, 32) else 6 if _b >= 192 else 7 if _b >= 128 else 8 + SIGNS.index(_b) if _b in SIGNS else 0
N_KINDS = 8 + len(SIGNS)
N = N_KINDS + 12


def features(text: bytes | None) -> np.ndarray:
    """The features of one whole text: shares of bytes by kind, and of words and lines by shape."""
    text = text or b""
    out = np.zeros(N, np.float32)
    if text:
        share = np.bincount(_KINDS[np.frombuffer(text, np.uint8)], minlength=N_KINDS) / len(text)
        out[:N_KINDS] = np.sqrt(share)
    w = text.split()
    n = len(w)
    at = N_KINDS
    if n:
        distinct = len(set(w))
        same = sum(map(bytes.__eq__, w, w[1:]))
        second = sum(map(bytes.__eq__, w, w[2:]))
        lines = [x for x in text.split(b"\n") if x.strip()]
        sizes = np.fromiter(map(len, w), np.int64, n)
        out[at : at + 11] = [
            np.sqrt(same / n), np.sqrt(second / n), distinct / n, distinct / n**0.8, np.sqrt(1 - len(set(lines)) / max(1, len(lines))), min(4, sizes.mean() / 6),
            min(4, sizes.std() / 6), np.log1p(n) / 10, np.sqrt((sizes > 25).mean()), min(1, len(lines) / n * 5), float(n < 10),
        ]
    out[at + 11] = 1
    return out


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _adam(gradient, n: int, steps: int, rate: float) -> np.ndarray:
    """Weights from zero, by steps down ``gradient``."""
    w, m, v = np.zeros(n), np.zeros(n), np.zeros(n)
    for t in range(1, steps + 1):
        g = gradient(w)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


def _scaled(positive: np.ndarray, unlabelled: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    both = np.vstack([positive, unlabelled]).astype(np.float64)
    mean, scale = both.mean(0), both.std(0) + 1e-3
    mean[-1], scale[-1] = 0, 1
    return (positive - mean) / scale, (unlabelled - mean) / scale, mean, scale


def negative_risk(fp: np.ndarray, fu: np.ndarray, prior: float) -> float:
    """Estimated risk of the negatives, by the scores of positives and unlabelled rows; by chance it may be below zero."""
    return float(np.logaddexp(0, fu).mean() - prior * np.logaddexp(0, fp).mean())


def risk(fp: np.ndarray, fu: np.ndarray, prior: float) -> float:
    """The non-negative risk."""
    return float(prior * np.logaddexp(0, -fp).mean()) + max(0.0, negative_risk(fp, fu, prior))


def best_bin(sp: np.ndarray, su: np.ndarray, delta: float = 0.1, gamma: float = 0.01) -> float:
    """The share of positives in U, less its error's bound, from scores of P and U that no classifier was fitted on.

    With a prior that is too high, bad texts pass, as the risk of negatives is held at zero; one too low by the
    error changes little. So the bound is taken off.
    """
    cutoffs = np.unique(np.concatenate([sp, su]))
    share = lambda s: 1 - np.searchsorted(np.sort(s), cutoffs) / len(s)
    p, u = share(sp), share(su)
    error = np.sqrt(np.log(4 / delta) / 2 / len(su)) + np.sqrt(np.log(4 / delta) / 2 / len(sp))
    ok = p > 0
    best = np.argmin((u[ok] + (1 + gamma) * error) / p[ok])
    return float(np.clip((u[ok][best] - error) / p[ok][best], 0.0, 1.0))


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray, steps: int = 400) -> float:
    """The share of positives among unlabelled rows; halves are dealt in turn, as rows come in the order of hashes."""
    p, u, _, _ = _scaled(positive, unlabelled)
    (p, hp), (u, hu) = (p[::2], p[1::2]), (u[::2], u[1::2])
    if not len(hp) or not len(hu):
        return 0.5
    w = _adam(lambda w: u.T @ _sigmoid(u @ w) / len(u) - p.T @ _sigmoid(-(p @ w)) / len(p) + 1e-3 * w, p.shape[1], steps, 0.05)
    return float(np.clip(best_bin(hp @ w, hu @ w), 0.02, 0.98))


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float, steps: int = 1500, rate: float = 0.05, decay: float = 1e-4) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(weights, mean, scale) that minimise the non-negative risk, by Adam over the whole sample.

    Where the estimated risk of negatives falls below zero, the step goes up that part alone.
    """
    p, u, mean, scale = _scaled(positive, unlabelled)

    def gradient(w):
        fp, fu = p @ w, u @ w
        g = u.T @ _sigmoid(fu) / len(u) - prior * (p.T @ _sigmoid(fp)) / len(p)
        return (-g if negative_risk(fp, fu, prior) < 0 else g - prior * (p.T @ _sigmoid(-fp)) / len(p)) + decay * w

    return _adam(gradient, p.shape[1], steps, rate), mean, scale


def _featurise(keys, texts):
    return [*keys, [features(t) for t in texts]]


def _sample(rows: DataFrame, n: int) -> DataFrame:
    """The rows with the n least hashes; a filter that passes about 2n of them comes first, so little is sorted."""
    total = rows.count()
    h = F.xxhash64("k", F.lit(41))
    if total > 2 * n:
        span = int((2 * n / total) * 2**64) - 2**63
        rows = rows.where(h < F.lit(span).cast("long"))
    return rows.orderBy(h, "k").limit(n)


def train(docs: DataFrame, labels: DataFrame, learnable: F.Column, *, key: str = "doc_id", text: str = "text", label: str = "quality", most_rows: int = MOST_ROWS):
    """The model, fitted on rows for which ``learnable`` holds; None without a positive row.

    Labels are joined to keys first, so only the texts of the sample are read by Python.
    """
    ship(docs.sparkSession)
    known = labels.where(F.col(label) == 1).select(F.col(key).alias("k")).where("k is not null").withColumn(key, F.col("k")).where(learnable).drop(key)
    texts = docs.where(learnable).select(F.col(f"`{key}`").alias("k"), F.col(f"`{text}`").alias("text"))
    positive_keys = _sample(known.distinct(), most_rows)
    unlabelled_keys = _sample(texts.select("k").where("k is not null"), most_rows)
    wanted = positive_keys.withColumn("positive", F.lit(1)).union(unlabelled_keys.distinct().withColumn("positive", F.lit(0)))
    rows = texts.join(F.broadcast(wanted), "k")  # at most 2 * most_rows keys
    # an id that many rows share counts no more often than the bound; each task sends no more than that
    first = Window.partitionBy("positive").orderBy(F.xxhash64("k", F.lit(41)), F.xxhash64("text"))
    rows = rows.withColumn("place", F.row_number().over(first)).where(F.col("place") <= most_rows)
    got = map_texts(rows, ["place", "positive"], "text", _featurise, "place int, positive int, x array<float>").orderBy("positive", "place").toPandas()
    x, positive = np.array(got["x"].tolist(), np.float64).reshape(-1, N), got["positive"].to_numpy() == 1
    if not positive.any() or positive.all():
        return None
    return fit(x[positive], x[~positive], estimate_prior(x[positive], x[~positive]))


def _score(model):
    def run(keys, texts):
        if model is None:
            return [*keys, [1.0] * len(texts)]
        w, mean, scale = model
        x = (np.array([features(t) for t in texts]) - mean) / scale
        return [*keys, 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))]

    return run


def score(docs: DataFrame, model, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, score of each row."""
    ship(docs.sparkSession)
    return map_texts(docs, [key], text, _score(model), f"k {docs.schema[key].dataType.simpleString()}, score double").withColumnRenamed("k", key)


def keep_good(docs: DataFrame, model, threshold: float = 0.3, *, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that score at least ``threshold``, with their columns."""
    ship(docs.sparkSession)
    run = _score(model)
    return filter_texts(docs, text, lambda texts: np.asarray(run([], texts)[0]) >= threshold if texts else [])


def held_out(key: str = "doc_id") -> F.Column:
    return F.crc32(F.col(key).cast("string").cast("binary")) % 5 == 0


def contract(docs: DataFrame, labels: DataFrame) -> DataFrame:
    model = train(docs, labels, ~held_out())
    out = score(docs, model)
    return out.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"))
