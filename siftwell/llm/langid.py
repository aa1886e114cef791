"""Hierarchical language identification.

A document is first given to a language family by one-versus-rest linear support vector machines, then one-versus-one machines tell the
languages of that family apart. Features are relative frequencies of hashed byte 1- to 4-grams of the letters of the whole text. Models are
trained on the driver from a bounded sample; the feature extraction for training and all predictions run on the executors.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from itertools import combinations
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name, sized_broadcast

SAMPLE_ROWS, LEAST_SHARE = 2_400, 8  # bound of the training sample, shared evenly by the languages; rows that a language has a right to if there are very many
LANGUAGES_BROADCAST = 100_000
DIMENSIONS = 1 << 13
PIECE = 1 << 20  # bytes of a text looked at at a time
UNDETERMINED = "und"
BOUND_QUANTILE, BOUND_SHARE = 0.01, 0.35  # texts that were not learned, short ones above all, have smaller margins than learned ones

# Families of languages by ISO 639-1 code. A code that is not listed is a family of its own.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "nb", "nn", "is", "af", "lb", "fy"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca", "gl", "oc"),
    "slavic": ("ru", "uk", "be", "pl", "cs", "sk", "sl", "hr", "sr", "bs", "bg", "mk"),
    "uralic": ("fi", "et", "hu"),
    "turkic": ("tr", "az", "kk", "uz"),
    "indic": ("hi", "mr", "ne", "bn", "gu", "pa"),
}
FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes}

# Bytes other than ASCII letters and multi-byte characters count as one separator.
_FOLD = bytes(c if 97 <= c <= 122 or c >= 128 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))
_RUNS = re.compile(rb"  +")


def grams(text: bytes | None) -> Iterable[np.ndarray]:
    """Feature numbers of a text's n-grams, piece by piece; runs of separators count once."""
    if not text:
        return
    folded = _RUNS.sub(b" ", b" " + text.decode("utf-8", "replace").lower().encode().translate(_FOLD) + b" ")  # no list of words: a very long text would make it many times its size
    for at in range(0, len(folded), PIECE):
        b = np.frombuffer(folded[at : at + PIECE + 3], np.uint8).astype(np.uint32)
        code = np.zeros(len(b), np.uint32)
        for n in range(1, 5):
            if len(b) < n:
                break
            code = code[: len(b) - n + 1] * np.uint32(257) + b[n - 1 :]
            mixed = (code + np.uint32(n)) * np.uint32(2654435761)
            yield mixed >> np.uint32(32 - DIMENSIONS.bit_length() + 1)


def features(text: bytes | None) -> np.ndarray:
    """Relative n-gram frequencies, square-rooted so that common grams don't drown the rest."""
    counts = np.zeros(DIMENSIONS, np.float64)
    for g in grams(text):
        counts += np.bincount(g, minlength=DIMENSIONS)
    total = counts.sum()
    return np.sqrt(counts / total).astype(np.float32) if total else counts.astype(np.float32)


def train_svm(x: np.ndarray, y: np.ndarray, rows: np.ndarray | None = None, cost: float = 10.0, rounds: int = 12, seed: int = 7) -> np.ndarray:
    """Weights of a linear support vector machine with squared hinge loss (last weight: bias), by dual coordinate descent over the given rows of x, whose labels y are 1 or -1."""
    rows = np.arange(len(x)) if rows is None else rows
    rng = np.random.default_rng(seed)
    weights, alpha = np.zeros(x.shape[1] + 1, np.float64), np.zeros(len(rows))
    share = np.where(y > 0, len(y) / (2 * max(1, (y > 0).sum())), len(y) / (2 * max(1, (y < 0).sum())))
    slack = 1 / (2 * cost * share)
    norm = np.array([x[k] @ x[k] for k in rows], np.float64) + 1 + slack
    for _ in range(rounds):
        for i in rng.permutation(len(rows)):
            row = x[rows[i]]
            gradient = y[i] * (row @ weights[:-1] + weights[-1]) - 1 + slack[i] * alpha[i]
            new = max(0.0, alpha[i] - gradient / norm[i])
            if new != alpha[i]:
                step = (new - alpha[i]) * y[i]
                weights[:-1] += step * row
                weights[-1] += step
                alpha[i] = new
    return weights


class Model(NamedTuple):
    families: list[str]
    members: dict[str, list[str]]  # languages of a family
    family_weights: np.ndarray  # (families, DIMENSIONS + 1)
    pairs: dict[str, list[tuple[int, int, np.ndarray]]]  # of a family: positions of two languages and the weights that prefer the first
    bound: float  # margin of the best family against all others under which a text is unlike every family

    def predict(self, text: bytes | None) -> tuple[str, float]:
        """Language and score in 0..1: the logistic of the least margin on the way. Under 0.5: unlike every family that was learned, where there are two or more."""
        if not self.families:
            return UNDETERMINED, 0.0
        x = features(text).astype(np.float64)
        margin = np.inf
        family = self.families[0]
        if len(self.families) > 1:
            told = self.family_weights[:, :-1] @ x + self.family_weights[:, -1]
            order = np.argsort(-told, kind="stable")
            family, margin = self.families[order[0]], min((told[order[0]] - told[order[1]]) / 2, told[order[0]] - self.bound)
        langs = self.members[family]
        votes, sums, worst = np.zeros(len(langs)), np.zeros(len(langs)), np.full(len(langs), np.inf)
        for i, j, w in self.pairs[family]:
            m = w[:-1] @ x + w[-1]
            votes[i if m >= 0 else j] += 1
            sums[i], sums[j] = sums[i] + m, sums[j] - m
            worst[i], worst[j] = min(worst[i], m), min(worst[j], -m)
        best = max(range(len(langs)), key=lambda k: (votes[k], sums[k], -k))
        margin = min(margin, worst[best])
        return langs[best], float(1 / (1 + np.exp(-2 * np.clip(margin, -30, 30))))


def fit(langs_of: list[str], x: np.ndarray) -> Model:
    """A model from the languages and features of rows; no rows give one that answers `und`."""
    langs = sorted(set(langs_of))
    members: dict[str, list[str]] = {}
    for lang in langs:
        members.setdefault(FAMILY_OF.get(lang, lang), []).append(lang)
    families = sorted(members)
    lang = np.array(langs_of)
    family = np.array([FAMILY_OF.get(r, r) for r in langs_of])
    top = np.stack([train_svm(x, np.where(family == f, 1, -1)) for f in families]) if len(families) > 1 else np.zeros((len(families), DIMENSIONS + 1))
    pairs: dict[str, list[tuple[int, int, np.ndarray]]] = {}
    for f, own in members.items():
        pairs[f] = []
        for i, j in combinations(range(len(own)), 2):
            two = np.flatnonzero((lang == own[i]) | (lang == own[j]))
            pairs[f].append((i, j, train_svm(x, np.where(lang[two] == own[i], 1, -1), two)))
    return Model(families, members, top, pairs, _bound(top, x, np.array([families.index(f) for f in family], np.int64)))


def _bound(weights: np.ndarray, x: np.ndarray, family: np.ndarray) -> float:
    """BOUND_SHARE of the BOUND_QUANTILE of the margins with which learned rows are rightly given to their family."""
    if len(weights) < 2:
        return 0.0
    told = np.concatenate([x[at : at + 256] @ weights[:, :-1].T + weights[:, -1] for at in range(0, len(x), 256)])  # a product widens its rows
    right = told.max(axis=1)[told.argmax(axis=1) == family]
    return BOUND_SHARE * max(0.0, float(np.quantile(right, BOUND_QUANTILE))) if len(right) else 0.0


def has_letter(text: str | Column) -> Column:
    return F.coalesce((F.col(text) if isinstance(text, str) else text).rlike(r"\p{L}"), F.lit(False))


def train(rows: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", sample_rows: int = SAMPLE_ROWS) -> Model:
    """Fits a model to a sample of rows with a language and a letter, an even share for each language, chosen by the hash of the key. The sample has at most sample_rows rows, or
    LEAST_SHARE for each language if that is more: no language goes unlearned. An id that stands at many rows is learned from once."""
    labelled = rows.where(F.col(lang).isNotNull() & has_letter(text)).select(F.col(lang).alias("lang"), F.col(text).alias("body"), F.xxhash64(F.col(key).cast("string"), F.lit("langid")).alias("h"))
    counts = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return fit([], np.zeros((0, DIMENSIONS), np.float32))
    share = max(LEAST_SHARE, sample_rows // len(counts))
    limits = rows.sparkSession.createDataFrame([(code, min(1.0, 1.3 * share / n)) for code, n in sorted(counts.items())], "known string, part double")
    unit = F.pmod("h", F.lit(1_000_003)) / 1_000_003

    @F.arrow_udf("binary")
    def vectors(texts: pa.Array) -> pa.Array:
        return pa.array([features(t.as_py()).astype(np.float16).tobytes() for t in texts], pa.binary())

    chosen = labelled.join(sized_broadcast(limits, len(counts), LANGUAGES_BROADCAST), F.col("lang") == F.col("known")).where(unit < F.col("part"))
    # The smallest hashes are found by themselves; then only the chosen texts move, one for each id, and become vectors.
    cutoff = chosen.select("h").distinct().orderBy("h").limit(max(sample_rows, share * len(counts))).agg(F.max("h")).first()[0]
    sample = chosen.where(F.col("h") <= cutoff).dropDuplicates(["h"]).select("lang", vectors(F.col("body").cast("binary")).alias("v")).collect()
    sample.sort(key=lambda r: (r["lang"], r["v"]))  # rows arrive in any order; the fit is to be the same
    x = np.empty((len(sample), DIMENSIONS), np.float32)
    for k, r in enumerate(sample):
        x[k] = np.frombuffer(r["v"], np.float16)
    langs = [r["lang"] for r in sample]
    sample.clear()  # the driver needn't hold the rows beside the matrix
    return fit(langs, x)


def predictions(model: Model, text: Column) -> Column:
    """struct<lang_pred string, score double> of a text by a trained model; null texts and texts without a letter are `und` with score 0."""

    @F.arrow_udf("struct<lang_pred: string, score: double>")
    def told(texts: pa.Array) -> pa.Array:
        pairs = [model.predict(t.as_py()) for t in texts]
        return pa.StructArray.from_arrays([pa.array([p[0] for p in pairs], pa.string()), pa.array([p[1] for p in pairs], pa.float64())], ["lang_pred", "score"])

    nothing = F.struct(F.lit(UNDETERMINED).alias("lang_pred"), F.lit(0.0).alias("score"))
    return F.when(has_letter(text), told(text.cast("binary"))).otherwise(nothing)


def held_out(key: str = "doc_id") -> Column:
    """Rows that are never learned from: a quarter, by the CRC-32 of the id as text. A null id is held out."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % 4 == 2, F.lit(True))


def identify(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id") -> DataFrame:
    """One row for each row of docs: doc_id, held_out, lang_pred, score. Learns from the rows that are not held out.

    Without any labelled row every prediction is `und` with score 0. Null texts and texts without a letter are `und` too; very long texts are read whole, a piece at a time.
    Repeated rows are returned each; other columns are not looked at, whatever their names; an empty table gives an empty result.
    """
    model = train(docs.where(~held_out(key)), text, lang, key)
    out = docs.select(F.col(key).alias("doc_id"), held_out(key).alias("held_out"), predictions(model, F.col(text)).alias("told"))
    return out.select("doc_id", "held_out", "told.lang_pred", "told.score")


def keep_identified(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", least: float = 0.5) -> DataFrame:
    """docs without those whose language can't be told: null texts, texts without a letter, scores under least. All columns as they were."""
    model = train(docs.where(~held_out(key)), text, lang, key)
    told = free_name(docs, "told")
    judged = docs.withColumn(told, predictions(model, F.col(text)))
    return judged.where((F.col(f"{told}.lang_pred") != UNDETERMINED) & (F.col(f"{told}.score") >= least)).drop(told)
