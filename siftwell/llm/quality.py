"""Quality scores by a sparse rule ensemble.

Shallow trees over text statistics are grown on a bounded sample of labelled rows. Every path of a tree is a conjunctive rule; a logistic
regression with lasso penalty picks a few rules and weighs them, and the kept rules become one Spark column expression over the statistics.
"""

from __future__ import annotations

import zlib
from collections import Counter
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SAMPLE_ROWS = 6_000  # bound of the labelled sample
TREES, DEPTH, CUTS, LEAST_LEAF = 30, 3, 24, 15
LAMBDAS = (0.02, 0.01, 0.005, 0.002, 0.001, 0.0005)
PIECE = 1 << 20

STATISTICS = (
    "n_bytes", "n_words", "n_lines", "word_length", "upper", "digit", "space", "stop", "comma", "exclamation", "pipe", "symbol", "hash", "wide",
    "distinct_words", "top_word", "distinct_lines", "line_length", "packed", "marked_words", "capitals", "short_words",
)

# Byte classes: 0 other, 1 upper, 2 digit, 3 space, 4 newline, 5 stop, 6 comma, 7 exclamation or question mark, 8 pipe, 9 symbol, 10 hash or at, 11 multi-byte lead.
_CLASS = np.zeros(256, np.uint8)
for _k, _chars in {1: b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", 2: b"0123456789", 3: b" \t\x0b\x0c\r", 4: b"\n", 5: b".", 6: b",;:", 7: b"!?", 8: b"|", 9: b"$%&*+/<=>\\^_`{}~[]()\"'-", 10: b"#@"}.items():
    _CLASS[list(_chars)] = _k
_CLASS[0xC0:] = 11


def statistics(text: bytes | None) -> list[float]:
    """The values of STATISTICS of a whole text; null counts as empty and has zeros."""
    text = text or b""
    n = len(text)
    if not n:
        return [0.0] * len(STATISTICS)
    c = np.zeros(12, np.int64)
    packer, packed = zlib.compressobj(1), 0
    for at in range(0, n, PIECE):
        piece = text[at : at + PIECE]
        c += np.bincount(_CLASS[np.frombuffer(piece, np.uint8)], minlength=12)
        packed += len(packer.compress(piece))
    packed += len(packer.flush())
    words, lines = text.split(), text.split(b"\n")
    counts = Counter(words)
    m = max(1, len(words))
    marked = sum(k for w, k in counts.items() if w[-1:] in b"!$%&*#@~^" and len(w) > 1)
    capitals = sum(k for w, k in counts.items() if w.isupper() and len(w) > 1)
    short = sum(k for w, k in counts.items() if len(w) < 3)
    return [
        float(n), float(len(words)), float(len(lines)), sum(len(w) * k for w, k in counts.items()) / m, *(float(c[k]) / n for k in (1, 2, 3, 5, 6, 7, 8, 9, 10, 11)),
        len(counts) / m, max(counts.values(), default=0) / m, len(set(lines)) / len(lines), n / len(lines), packed / n, marked / m, capitals / m, short / m,
    ]


def statistics_column(text: Column) -> Column:
    """All statistics of a text as one struct of doubles."""
    kinds = ", ".join(f"{s}: double" for s in STATISTICS)

    @F.arrow_udf(f"struct<{kinds}>")
    def compute(texts: pa.Array) -> pa.Array:
        values = np.array([statistics(t.as_py()) for t in texts], np.float64).reshape(len(texts), len(STATISTICS))
        return pa.StructArray.from_arrays([pa.array(values[:, k]) for k in range(len(STATISTICS))], list(STATISTICS))

    return compute(text.cast("binary"))


Condition = tuple[int, bool, float]  # statistic, whether it must be above the cut, cut
Rule = tuple[Condition, ...]


def grow(x: np.ndarray, y: np.ndarray, rng: np.random.Generator, path: Rule = (), depth: int = DEPTH) -> list[Rule]:
    """Paths of one tree by Gini impurity over quantile cuts of a random half of the statistics."""
    out = [path] if path else []
    if depth == 0 or len(y) < 2 * LEAST_LEAF or y.min() == y.max():
        return out
    best = (1e-9, -1, 0.0)
    whole = y.mean() * (1 - y.mean())
    for k in rng.choice(x.shape[1], max(1, x.shape[1] // 2), replace=False):
        cuts = np.unique(np.quantile(x[:, k], np.linspace(0.03, 0.97, CUTS)))
        above = x[:, k][:, None] > cuts[None, :]
        n = above.sum(0)
        ones = (above & (y[:, None] > 0)).sum(0)
        rest, rest_ones = len(y) - n, y.sum() - ones
        fine = (n >= LEAST_LEAF) & (rest >= LEAST_LEAF)
        p, q = ones / np.maximum(n, 1), rest_ones / np.maximum(rest, 1)
        gain = np.where(fine, whole - (n * p * (1 - p) + rest * q * (1 - q)) / len(y), -1)
        at = int(gain.argmax())
        if gain[at] > best[0]:
            best = (float(gain[at]), int(k), float(cuts[at]))
    if best[1] < 0:
        return out
    _, k, cut = best
    above = x[:, k] > cut
    return out + grow(x[above], y[above], rng, (*path, (k, True, cut)), depth - 1) + grow(x[~above], y[~above], rng, (*path, (k, False, cut)), depth - 1)


def holds(rules: list[Rule], x: np.ndarray) -> np.ndarray:
    """(rows, rules) matrix of which rule holds where."""
    out = np.ones((len(x), len(rules)), np.float32)
    for j, rule in enumerate(rules):
        for k, above, cut in rule:
            out[:, j] *= (x[:, k] > cut) if above else (x[:, k] <= cut)
    return out


def lasso(r: np.ndarray, y: np.ndarray, penalty: float, rounds: int = 250) -> tuple[np.ndarray, float]:
    """Weights and intercept of an L1-penalised logistic regression by accelerated proximal gradient steps."""
    a = np.hstack([r, np.ones((len(r), 1))]).astype(np.float64)
    v = np.ones(a.shape[1])
    for _ in range(30):  # largest eigenvalue, by power iteration
        v = a.T @ (a @ v)
        largest = float(np.linalg.norm(v))
        v /= largest
    step = 4 * len(a) / (1.05 * largest)
    w = z = np.zeros(a.shape[1])
    t = 1.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ z, -30, 30)))
        new = z - step * (a.T @ (p - y)) / len(a)
        new[:-1] = np.sign(new[:-1]) * np.maximum(np.abs(new[:-1]) - step * penalty, 0)
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        z, w, t = new + (t - 1) / t_new * (new - w), new, t_new
    return w[:-1], float(w[-1])


class Ensemble(NamedTuple):
    rules: list[Rule]
    weights: list[float]
    intercept: float

    def score(self, stats: str) -> Column:
        """Probability of label 1 as a column expression over the struct column of statistics."""
        total = F.lit(self.intercept)
        for rule, weight in zip(self.rules, self.weights, strict=True):
            test = F.lit(True)
            for k, above, cut in rule:
                value = F.col(f"{stats}.{STATISTICS[k]}")
                test = test & (value > cut if above else value <= cut)
            total = total + F.when(test, F.lit(weight)).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-total))


def fit(x: np.ndarray, y: np.ndarray, seed: int = 11) -> Ensemble:
    """No rows: score 0.5 for all. One class only: its smoothed share for all."""
    if not len(y) or y.min() == y.max():
        share = (y.sum() + 1) / (len(y) + 2)
        return Ensemble([], [], float(np.log(share / (1 - share))))
    rng = np.random.default_rng(seed)
    rules: dict[Rule, None] = {}
    for _ in range(TREES):
        at = rng.integers(0, len(y), len(y))
        rules |= dict.fromkeys(grow(x[at], y[at], rng))
    kept = list(rules)
    r = holds(kept, x)
    check = rng.random(len(y)) < 0.25
    best = (np.inf, LAMBDAS[0])
    for penalty in LAMBDAS:
        w, b = lasso(r[~check], y[~check], penalty)
        p = np.clip(1 / (1 + np.exp(-np.clip(r[check] @ w + b, -30, 30))), 1e-6, 1 - 1e-6)
        loss = float(-(y[check] * np.log(p) + (1 - y[check]) * np.log(1 - p)).mean()) if check.any() else 0.0
        best = min(best, (loss, penalty))
    w, b = lasso(r, y, best[1])
    used = np.flatnonzero(np.abs(w) > 1e-6)
    return Ensemble([kept[j] for j in used], [float(w[j]) for j in used], b)


def held_out(key: str = "doc_id") -> Column:
    """Rows whose labels are never learned from: a fifth, by the CRC-32 of the id as text. A null id is held out."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % 5 == 0, F.lit(True))


def train(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "quality", sample_rows: int = SAMPLE_ROWS) -> Ensemble:
    """Fits an ensemble to at most sample_rows labelled rows (chosen by the hash of the id). Only their ids are broadcast, and at most sample_rows rows of statistics reach the driver."""
    known = labels.where(F.col(label).isin(0, 1) & ~held_out(key)).select(F.col(key).alias("known"), F.col(label).cast("double").alias("label"), F.xxhash64(F.col(key).cast("string"), F.lit("quality")).alias("h"))
    chosen = known.orderBy("h").limit(sample_rows)
    rows = docs.select(F.col(key).alias("id"), F.col(text).alias("body")).join(F.broadcast(chosen), F.col("id") == F.col("known")).select("h", "label", statistics_column(F.col("body")).alias("s"))
    # An id may stand at many rows: the bound holds for the rows that reach the driver, not for the ids alone.
    told = rows.orderBy("h", "s", "label").limit(sample_rows).select("label", "s.*").collect()
    data = np.array([list(r) for r in told], np.float64).reshape(len(told), len(STATISTICS) + 1)
    data = data[np.lexsort(data.T)]
    return fit(data[:, 1:], data[:, 0])


def assess(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "quality", threshold: float = 0.3) -> DataFrame:
    """One row for each row of docs: doc_id, held_out, score, predicted (1 if score >= threshold).

    Null and empty texts have statistics of zero and are scored like any other; rows with a null id are scored and held out. Repeated rows are returned each, and very long
    texts are read whole, a piece at a time. Without labels every score is the same. Other columns are not looked at, whatever their names; an empty table gives an empty result.
    """
    ensemble = train(docs, labels, text, key, label)
    scored = docs.select(F.col(key).alias("doc_id"), held_out(key).alias("held_out"), statistics_column(F.col(text)).alias("s")).withColumn("score", ensemble.score("s"))
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
