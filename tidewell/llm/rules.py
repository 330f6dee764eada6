"""Quality rules whose cutoffs limit false rejection.

Each rule is a number computed from the whole text; a text fails the rule if the number
is over the rule's cutoff. In each stratum one joint set is tested, the texts over the cutoff
of any rule: the exact (Clopper-Pearson) upper bound of the share of good texts in it, from
labelled rows, is at most ``alpha``. The set grows along a fixed sequence of cutoffs. Rules by which bad
rows stand out come first, each from its mildest cutoff to the last bad row that it is needed for; then
all go on. A rule that isn't shown to be safe stays as it is, and the others go on with a share of
what is left of ``delta``. All tests together hold with confidence 1 - ``delta``: strata that
can be tested at all share it, and a stratum's share is split over all sequences that could come up.

Counts are over all labelled rows, and of any number of strata. A stratum with too few good rows (at alpha 0.02 and delta 0.05
some 255 if four share delta) rejects nothing but by the base rule.
Null and empty texts have no words and fail the base rule. Missing or unknown strata reject
nothing but by the base rule. Repeated rows are judged alike; a text labelled twice counts twice.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.arrow import filter_texts, map_texts
from tidewell.session import cut, ship

ALPHA, DELTA = 0.02, 0.05
#: Cutoffs of a ratio, from the mildest on.
GRID = [1.0, 0.8, 0.6, 0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.12, 0.1, 0.08, 0.06, 0.05, 0.04, 0.03, 0.02, 0.015, 0.01, 0.0075, 0.005, 0.003, 0.002, 0.001]
RULES = ("symbols", "dup_lines", "repeats", "shouting", "signs", "same_word")
_SYMBOLS = bytes(b for b in range(256) if b not in b"#*$%&|<>")
_SIGNS = bytes(b for b in range(256) if b not in b"!?;:=+~^_@{}[]\\/")
_CONTINUED = bytes(range(0x80, 0xC0))


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


def repeated_words(w: list[bytes], size: int = 5) -> int:
    """Words that lie in windows of ``size`` words found twice or more, the first included."""
    n = len(w)
    if n <= size:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(x, len(number)) for x in w), np.int64, n)
    code = ids[: n - size + 1]
    for k in range(1, size):  # windows are told apart exactly: each step numbers distinct prefixes
        pair = code * len(number) + ids[k : n - size + 1 + k]
        _, code = np.unique(pair, return_inverse=True)
    often = np.bincount(code)[code] > 1
    edge = np.zeros(n + 1, np.int64)
    edge[:-size] += often
    edge[size:] -= often
    return int((np.cumsum(edge[:n]) > 0).sum())


def measure(text: bytes | None) -> tuple[int, int, int, int, int, bool, list[float]]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, ratios by RULES)."""
    text = text or b""
    w = text.split()
    n = len(w)
    chars = sum(map(len, w)) if text.isascii() else len(b"".join(w).translate(None, _CONTINUED))
    symbols = len(text.translate(None, _SYMBOLS))
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    dup = len(lines) - len(set(lines))
    repeat = repeated_words(w)
    caps = sum(map(bytes.isupper, w))
    same = sum(map(bytes.__eq__, w, w[1:]))
    c = max(1, chars)
    ratios = [symbols / c, dup / max(1, len(lines)), repeat / max(1, n), caps / max(1, n), len(text.translate(None, _SIGNS)) / c, same / max(1, n)]
    return n, chars, symbols, dup, repeat, n < 10 or 100 * repeat > 20 * n, ratios


def _measure(keys, texts):
    got = [measure(t) for t in texts]
    return [*keys, *[[g[i] for g in got] for i in range(7)]]


def measured(docs: DataFrame, *, key: str = "doc_id", text: str = "text", stratum: str = "lang") -> DataFrame:
    """key, stratum, the base numbers, base_failed, ratios of each row."""
    ship(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()
    df = docs.withColumn("_s", F.col(f"`{stratum}`").cast("string"))
    return map_texts(df, [key, "_s"], text, _measure, f"k {kind}, stratum string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, ratios array<double>")


def upper_bound(k: int, n: int, delta: float) -> float:
    """Exact upper bound of a binomial share at confidence 1 - delta, by bisection of its distribution."""
    if n == 0 or k >= n:
        return 1.0

    def below(p: float) -> float:
        logs = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p) for i in range(k + 1)]
        top = max(logs)
        return math.exp(top) * sum(math.exp(x - top) for x in logs)

    low, high = k / n, 1.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if 0 < mid < 1 and below(mid) > delta else (low, mid)
    return high


def shown(k: int, n: int, alpha: float, delta: float) -> bool:
    """Whether the exact upper bound of k of n at confidence 1 - delta is at most ``alpha``."""
    if n == 0 or k > alpha * n:
        return False
    logs = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(alpha) + (n - i) * math.log1p(-alpha) for i in range(k + 1)]
    top = max(logs)
    return top + math.log(sum(math.exp(x - top) for x in logs)) <= math.log(delta)


def tested(totals: dict[str, int], alpha: float, delta: float) -> list[str]:
    """The strata large enough to be tested when they share delta, by their numbers of good rows alone."""
    by_size = sorted(totals, key=lambda s: (-totals[s], s))
    return by_size[: max((i for i, s in enumerate(by_size, 1) if shown(0, totals[s], alpha, delta / i / 2)), default=0)]


def sequence(order: list[int], ends: list[int]) -> list[tuple[int, int]]:
    """(rule, step) in the order of tests: each rule to its end (-1: none), then what is left, from the mildest on."""
    return [(r, i) for r, end in zip(order, ends) for i in range(end + 1)] + [(r, i) for i in range(len(GRID)) for r, end in zip(order, ends) if i > end]


def walk(totals: dict[str, int], sequences: dict[str, list[tuple[int, int]]], failing: Callable[[dict[str, list[int | None]]], dict[str, dict[int, int]]], alpha: float, delta: float) -> dict[str, list[float | None]]:
    """stratum -> cutoff of each rule or None, by tests of all rules' joint set.

    ``failing``: from stratum -> place of each rule and first failing step (None: never, -1: already
    rejected), the number of good rows by the first place that rejects them. A sequence spends half
    of its delta and the last one all; the rest is dealt equally to the sequences that go on from each
    of its possible stops without the rule that stopped it. So the tests of all that could happen add up to delta.
    """
    steps = len(GRID)
    strata = tested(totals, alpha, delta)
    reached = {s: [-1] * len(RULES) for s in totals}
    going = {s: (sequences[s], delta / len(strata)) for s in strata}
    while going:
        places: dict[str, list[int | None]] = {}
        for s, (todo, _) in going.items():
            at = {x: i for i, x in enumerate(todo)}
            places[s] = [-1 if i <= reached[s][r] else at.get((r, i)) for r in range(len(RULES)) for i in range(steps + 1)]
        found, after = failing(places), {}
        for s, (todo, share) in going.items():
            by = found.get(s, {})
            failed, level = by.get(-1, 0), share / (2 if len({r for r, _ in todo}) > 1 else 1)
            safe, of = shown(failed, totals[s], alpha, level), failed
            for i, (r, step) in enumerate(todo):
                failed += by.get(i, 0)
                if failed != of:
                    safe, of = shown(failed, totals[s], alpha, level), failed
                if not safe:
                    left = [x for x in todo[i:] if x[0] != r]
                    if left:
                        after[s] = (left, (share - level) / len(todo))
                    break
                reached[s][r] = step
        going = after
    return {s: [GRID[i] if i >= 0 else None for i in x] for s, x in reached.items()}


def choose(counts: dict[tuple[str, int], dict[int, int]], totals: dict[str, int], alpha: float = ALPHA, delta: float = DELTA) -> dict[str, list[float | None]]:
    """Cutoffs from ``counts``: good rows that one rule alone fails, by (stratum, rule) and grid step that they fail from on."""

    def failing(places):
        out: dict[str, dict[int, int]] = {s: defaultdict(int) for s in places}
        for (s, r), by in counts.items():
            for step, n in by.items():
                if s in places and (at := places[s][r * (len(GRID) + 1) + step]) is not None:
                    out[s][at] += n
        return out

    plain = sequence(list(range(len(RULES))), [len(GRID) - 1] * len(RULES))
    return walk(totals, dict.fromkeys(totals, plain), failing, alpha, delta)


def calibrate(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", stratum: str = "lang", label: str = "quality", alpha: float = ALPHA, delta: float = DELTA) -> dict[str, list[float | None]]:
    """Cutoffs by stratum from all rows labelled good that the base rule passes."""
    return cutoffs_of(measured(docs, key=key, text=text, stratum=stratum), labels, key=key, label=label, alpha=alpha, delta=delta)


#: Rows about strata up to which they are broadcast; beyond, they are joined by a shuffle.
BROADCAST_STRATA = 50_000


def _side(spark, rows: list[tuple], schema: str) -> DataFrame:
    """A table about strata, to be joined to all rows."""
    df = spark.createDataFrame(rows, schema)
    return F.broadcast(df) if len(rows) <= BROADCAST_STRATA else df


def cutoffs_of(m: DataFrame, labels: DataFrame, *, key: str = "doc_id", label: str = "quality", alpha: float = ALPHA, delta: float = DELTA) -> dict[str, list[float | None]]:
    """Cutoffs by stratum from measured rows; numbers are joined to labels, not texts.

    The driver gets a count for each stratum and place of a sequence, not rows.
    """
    spark, steps = m.sparkSession, len(GRID)
    judged = labels.where(F.col(label).isin(0, 1)).select(F.col(key).alias("k"), (F.col(label) == 1).alias("good"))
    # the first grid step whose cutoff a ratio is over
    first = F.transform("ratios", lambda x: sum((x <= F.lit(g)).cast("int") for g in GRID))
    rows = cut(m.where("not base_failed and stratum is not null").select("k", "stratum", first.alias("steps")).join(judged, "k").select("stratum", "good", "steps"))
    # strata of fewer good rows can't be tested even if they alone spend delta; so what the driver gets has a bound by the number of labelled rows
    least = math.ceil(math.log(delta / 2) / math.log1p(-alpha)) - 1
    totals = {r.stratum: r.n for r in rows.where("good").groupBy("stratum").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).collect()}
    strata = tested(totals, alpha, delta)
    if not strata:
        return {s: [None] * len(RULES) for s in totals}

    # rules that catch bad rows by mild cutoffs come first, and go on to the last bad row that those before them miss;
    # bad rows say nothing about the good ones that the tests count
    bad = rows.where(~F.col("good"))
    mean = {r.stratum: r for r in bad.join(_side(spark, [(x,) for x in strata], "stratum string"), "stratum").groupBy("stratum").agg(*[F.sum(F.col("steps")[i]).alias(f"r{i}") for i in range(len(RULES))]).collect()}
    orders = {s: sorted(range(len(RULES)), key=lambda i: (mean[s][f"r{i}"] if s in mean else 0, i)) for s in strata}
    ends = {s: [-1] * len(RULES) if s in mean else [steps - 1] * len(RULES) for s in strata}
    by = bad.join(_side(spark, list(orders.items()), "stratum string, rules array<int>"), "stratum")
    by = by.withColumn("at", F.array_position(F.transform("rules", lambda r: F.element_at("steps", r + 1) < steps), True).cast("int")).where("at > 0")
    for r in by.groupBy("stratum", "at").agg(F.max(F.expr("steps[rules[at - 1]]")).alias("end")).collect():
        ends[r.stratum][r["at"] - 1] = r.end

    def failing(places):
        side = _side(spark, list(places.items()), "stratum string, places array<int>")
        at = F.array_min(F.array(*[F.col("places")[F.lit(i * (steps + 1)) + F.col("steps")[i]] for i in range(len(RULES))]))
        out: dict[str, dict[int, int]] = defaultdict(dict)
        for r in rows.where("good").join(side, "stratum").groupBy("stratum", at.alias("at")).agg(F.count(F.lit(1)).alias("n")).collect():
            if r["at"] is not None:
                out[r.stratum][r["at"]] = r.n
        return out

    return walk(totals, {s: sequence(orders[s], ends[s]) for s in strata}, failing, alpha, delta)


def passes(cutoffs: dict[str, list[float | None]], stratum: str | None, base_failed: bool, ratios: list[float]) -> bool:
    return not base_failed and all(c is None or x <= c for x, c in zip(ratios, cutoffs.get(stratum, [None] * len(RULES))))


def verdicts(m: DataFrame, cutoffs: dict[str, list[float | None]], key: str = "doc_id") -> DataFrame:
    """key, the base numbers, base_failed, failed_rules, kept of each measured row."""
    side = _side(m.sparkSession, [(s, values) for s, values in cutoffs.items() if any(c is not None for c in values)], "stratum string, cutoffs array<double>")
    over = F.array(*[F.when(F.col("ratios")[i] > F.col("cutoffs")[i], F.lit(name)) for i, name in enumerate(RULES)])
    out = m.join(side, "stratum", "left").withColumn("failed_rules", F.array_compact(over))
    return out.select(F.col("k").alias(key), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "failed_rules", (~F.col("base_failed") & (F.size("failed_rules") == 0)).alias("kept"))


def keep_passing(docs: DataFrame, cutoffs: dict[str, list[float | None]], *, text: str = "text", stratum: str = "lang") -> DataFrame:
    """The rows of ``docs`` that pass, with their columns. The cutoffs are a row a stratum that can be tested."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(cutoffs)

    def keep(texts, strata):
        return [passes(shared.value, s, m[5], m[6]) for m, s in zip(map(measure, texts), strata)]

    return filter_texts(docs, text, keep, stratum)


def contract(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The columns of the query. Texts are measured once; what is measured is kept in the shared folder."""
    m = cut(measured(docs))
    out = verdicts(m, cutoffs_of(m, labels))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.array_join("failed_rules", ",").alias("failed_rules"))
