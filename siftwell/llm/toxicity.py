"""Toxicity scores from a lexicon with misspellings and context.

Words and stems that mark toxic documents are learned from labelled rows. They form a trie; a word is looked up by walking the trie and a Levenshtein automaton of the word's allowed
errors together, so misspelled terms are found as well. Each find weighs more or less by the window around it: in quotation marks, after a word of reporting, or aimed at
someone. A logistic regression turns a text's weighed finds into a score.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from typing import NamedTuple
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

TOXIC_ROWS, CLEAN_ROWS, SAMPLE_TEXT = 1_500, 3_000, 100_000  # bounds of the labelled sample: rows of either label, code points of a text that is learned from
TERMS, LEAST_ROWS, LEAST_Z, LEAST_ODDS, COMMON = 2_000, 5, 5.0, 1.0, 0.02  # terms kept; rows a term stands in; how far from chance it is; its log odds; share of rows that have a common word
STEM, LONGEST_STEM = 3, 10
ONE_ERROR, TWO_ERRORS = 5, 9  # lengths from which a term is found with one and two errors
WINDOW = 4
KNOWN_WORDS, STATES = 200_000, 100_000  # words that a task remembers to hold no term, states of the automaton that it holds
PIECE = 1 << 20

# Words of reporting or mention, and of address.
REPORTING = frozenset("said says wrote writes called calls quote quotes quoted quoting word term insult slur sagte schrieb nannte zitat wort dit écrit appelle citation mot dijo escribió llamó cita palabra".split())
ADDRESS = frozenset("you your you're youre u ur du dich dir dein ihr euch tu toi te ton vous tú ti usted eres".split())
QUOTED, REPORTED, AIMED = 0.3, 0.5, 1.25

_EDGE = ".,;:!?()[]{}<>\"'“”„«»‘’‚‹›…-–—_/\\|#$%&*~^`"
_MARKS = "\"“”„«»"
FEATURES = ("finds", "density", "misspelled", "terms", "strongest")


class Lexicon(NamedTuple):
    words: dict[str, float]  # a term that is a whole word, and its weight
    stems: dict[str, float]  # one that a word begins with
    known: frozenset[str]  # words near a term that clean texts have


def allowed(term: str) -> int:
    return (len(term) >= ONE_ERROR) + (len(term) >= TWO_ERRORS)


class Trie:
    """The product of the lexicon's trie with the Levenshtein automata of its terms, made deterministic as words need it.

    A state is a set of (node, errors so far, pending): pending is the letter that must follow if two letters were swapped. A word is dropped at the first letter that leaves the set empty.
    """

    def __init__(self, lexicon: Lexicon) -> None:
        self.children: list[dict[str, int]] = [{}]
        self.ends: dict[int, tuple[str, float]] = {}
        self.stems: dict[int, tuple[str, float]] = {}
        self.room = [0]  # most errors that a term below a node may have
        for terms, ends in ((lexicon.words, self.ends), (lexicon.stems, self.stems)):
            for term, weight in terms.items():
                node, errors = 0, allowed(term) if ends is self.ends else 0
                self.room[0] = max(self.room[0], errors)
                for letter in term:
                    if letter not in self.children[node]:
                        self.children[node][letter] = len(self.children)
                        self.children.append({})
                        self.room.append(0)
                    node = self.children[node][letter]
                    self.room[node] = max(self.room[node], errors)
                ends[node] = (term, weight)
        self.known = lexicon.known
        self._empty()

    def _empty(self) -> None:
        self.number: dict[frozenset, int] = {}
        self.states: list[frozenset] = []
        self.moves: list[dict[str, int]] = []
        self.stem_of: list[tuple[str, float] | None] = []
        self.dead, self.start = self._numbered(set()), self._numbered({(0, 0, "")})

    def _numbered(self, states: set[tuple[int, int, str]]) -> int:
        """The number of a state, with what is reached from it by leaving out letters of a term."""
        todo = list(states)
        while todo:
            node, errors, pending = todo.pop()
            if not pending:
                for child in self.children[node].values():
                    if errors < self.room[child] and (new := (child, errors + 1, "")) not in states:
                        states.add(new)
                        todo.append(new)
        state = frozenset(states)
        if state not in self.number:
            self.number[state] = len(self.states)
            self.states.append(state)
            self.moves.append({})
            self.stem_of.append(max((self.stems[node] for node, errors, pending in state if not errors and not pending and node in self.stems), key=lambda t: t[1], default=None))
        return self.number[state]

    def _move(self, at: int, letter: str) -> int:
        out: set[tuple[int, int, str]] = set()
        for node, errors, pending in self.states[at]:
            if pending:
                if letter == pending:
                    out.add((node, errors, ""))
                continue
            if letter in self.children[node]:
                out.add((self.children[node][letter], errors, ""))
            if errors < self.room[node]:
                out.add((node, errors + 1, ""))  # a letter too many
            for other, child in self.children[node].items():
                if other != letter and errors < self.room[child]:
                    out.add((child, errors + 1, ""))  # another letter
                    if letter in self.children[child]:
                        out.add((self.children[child][letter], errors + 1, other))  # two letters swapped
        self.moves[at][letter] = to = self._numbered(out)
        return to

    def find(self, word: str) -> tuple[str, float, int] | None:
        """The term in a word, its weight and the number of errors: the fewest errors, then the largest weight. None for misspellings that clean texts are known to have."""
        if len(self.states) > STATES:
            self._empty()
        at, stem = self.start, None
        for letter in word:
            if (to := self.moves[at].get(letter)) is None:
                to = self._move(at, letter)
            if to == self.dead:
                at = to
                break
            at = to
            if (here := self.stem_of[at]) and (stem is None or here[1] > stem[1]):
                stem = here
        best = (*stem, 0) if stem else None
        for node, errors, pending in self.states[at]:
            if not pending and node in self.ends and errors <= allowed(self.ends[node][0]):
                term, weight = self.ends[node]
                if best is None or (errors, -weight, term) < (best[2], -best[1], best[0]):
                    best = (term, weight, errors)
        return None if best and best[2] and word in self.known else best


def words_in(text: str) -> set[str]:
    """Distinct lower-case words of a text, without the marks at their ends. Marks and digits inside stay: they may stand for letters."""
    return {w for t in set(text.lower().split()) if (w := t.strip(_EDGE))}


def _lines(text: str) -> Iterator[str]:
    """Lines of a text; one that is longer than PIECE in parts that end between words."""
    for line in text.split("\n"):
        at = 0
        while len(line) - at > PIECE:
            end = line.rfind(" ", at, at + PIECE) + 1 or at + PIECE
            yield line[at:end]
            at = end
        yield line[at:]


def _quoted(tokens: list[str]) -> list[bool]:
    """Which tokens of a line stand between quotation marks. A mark that isn't closed in its line quotes nothing; a line that begins with > is a quotation."""
    if tokens[0].startswith(">"):
        return [True] * len(tokens)
    out, begun = [False] * len(tokens), None
    for k, token in enumerate(tokens):
        bare = token.strip(_EDGE)
        at = token.find(bare) if bare else len(token)
        for edge, mark in enumerate(token):
            if mark in _MARKS and not at <= edge < at + len(bare):
                if begun is None:
                    begun = k if edge < at else k + 1
                else:
                    end = k if edge < at else k + 1
                    out[begun:end] = [True] * (end - begun)
                    begun = None
    return out


class Finder:
    """Looks up whole texts; words that hold no term are remembered between texts."""

    def __init__(self, lexicon: Lexicon) -> None:
        self.trie, self.without = Trie(lexicon), set()

    def terms(self, words: Iterable[str]) -> dict[str, tuple[str, float, int]]:
        """The words among these that hold a term."""
        out = {}
        for word in words:
            if found := self.trie.find(word):
                out[word] = found
            else:
                self.without.add(word)
        if len(self.without) > KNOWN_WORDS:
            self.without.clear()
        return out

    def finds(self, text: str) -> tuple[int, list[tuple[str, float, int, float]]]:
        """Number of words, and each find of a text: term, weight, errors, factor of its context."""
        n, raw, out = 0, set(), []
        text = text.lower()
        for piece in (text,) if len(text) <= PIECE else _lines(text):  # no list of a very long text's words
            tokens = piece.split()
            n += len(tokens)
            raw.update(tokens)
        new = raw - self.without
        known = self.terms({w for t in new if (w := t.strip(_EDGE))} - self.without)
        if not known:
            if len(self.without) + len(new) <= KNOWN_WORDS:
                self.without |= new  # tokens with marks at their ends too
            return n, out
        for line in _lines(text):
            here = line.split()
            bare = [t.strip(_EDGE) for t in here]
            hits = [k for k, w in enumerate(bare) if w in known]
            if not hits:
                continue
            quoted = _quoted(here)
            for k in hits:
                near = bare[max(0, k - WINDOW) : k + WINDOW + 1]
                factor = (QUOTED if quoted[k] else 1.0) * (REPORTED if not REPORTING.isdisjoint(bare[max(0, k - WINDOW) : k]) else 1.0) * (AIMED if not quoted[k] and not ADDRESS.isdisjoint(near) else 1.0)
                out.append((*known[bare[k]], factor))
        return n, out

    def features(self, text: str | None) -> list[float]:
        """The values of FEATURES of a whole text; null and empty texts have zeros."""
        n, finds = self.finds(text or "")
        exact = sum(w * f for _, w, e, f in finds if not e)
        near = sum(w * f for _, w, e, f in finds if e)
        strongest: dict[str, float] = {}
        for term, weight, _, factor in finds:
            strongest[term] = max(strongest.get(term, 0.0), weight * factor)
        return [math.log1p(exact), math.log1p(100 * (exact + near) / max(n, 1)), math.log1p(near), math.log1p(sum(strongest.values())), max(strongest.values(), default=0.0)]


def features_column(text: Column, lexicon: Lexicon) -> Column:
    """FEATURES of a text as an array of doubles."""
    kept: list[Finder] = []

    @F.arrow_udf("array<double>")
    def compute(texts: pa.Array) -> pa.Array:
        if not kept:
            kept.append(Finder(lexicon))
        return pa.array([kept[0].features(t.as_py()) for t in texts], pa.list_(pa.float64()))

    return compute(text)


def _terms(words: Iterable[str]) -> set[tuple[str, bool]]:
    """Words (True) and the stems that they begin with (False)."""
    return {(w, True) for w in words} | {(w[:k], False) for w in words for k in range(STEM, min(LONGEST_STEM, len(w) - 1) + 1)}


def _originals(rows: list[tuple[int, list[str]]]) -> list[tuple[int, list[str]]]:
    """One of each group of rows that look like copies: of those with the same label, rows whose rare words have the same smallest hash. Copies are no further evidence of a term."""
    common = Counter(w for _, words in rows for w in words)
    out = {}
    for k, (label, words) in enumerate(rows):
        out.setdefault((label, min((crc32(w.encode()) for w in words if common[w] <= COMMON * len(rows)), default=-k)), (label, words))
    return list(out.values())


def learn_lexicon(rows: Iterable[tuple[int, list[str]]], clean_weight: float = 1.0) -> Lexicon:
    """The lexicon of labelled rows (label, distinct words); a clean row counts clean_weight times. Of terms that begin with one another the one furthest from chance stays, the longer
    one of equals."""
    rows = _originals(list(rows))
    n = [clean_weight * sum(label != 1 for label, _ in rows), sum(label == 1 for label, _ in rows)]
    if not all(n):
        return Lexicon({}, {}, frozenset())
    toxic: Counter = Counter()
    for label, words in rows:
        if label == 1:
            toxic.update(_terms(words))
    kept = {t for t, k in toxic.items() if k >= LEAST_ROWS}
    clean: Counter = Counter()
    for label, words in rows:
        if label != 1:
            clean.update(_terms(words) & kept)
    share = n[1] / sum(n)

    def z(term: tuple[str, bool]) -> float:
        k = toxic[term] + clean_weight * clean[term]
        return (toxic[term] - k * share) / math.sqrt(k * share * (1 - share) + 1)

    far = sorted((t for t in kept if z(t) >= LEAST_Z), key=lambda t: (-round(z(t), 9), -len(t[0]), not t[1], t[0]))
    chosen: dict[tuple[str, bool], float] = {}
    for term, whole in far:
        if len(chosen) == TERMS:
            break
        odds = math.log((toxic[term, whole] + 0.5) / (n[1] + 1)) - math.log((clean_weight * clean[term, whole] + 0.5) / (n[0] + 1))
        if odds >= LEAST_ODDS and not any(term.startswith(t) or (not whole and t.startswith(term)) for t, _ in chosen):
            chosen[term, whole] = min(8.0, odds)
    lexicon = Lexicon({t: w for (t, whole), w in chosen.items() if whole}, {t: w for (t, whole), w in chosen.items() if not whole}, frozenset())
    trie = Trie(lexicon)
    # A word that is near a term but stands in clean texts about as often as in toxic ones is no misspelling.
    seen = [Counter(), Counter()]
    for label, words in rows:
        seen[label == 1].update(w for w in words if (found := trie.find(w)) and found[2])
    return lexicon._replace(known=frozenset(w for w, k in seen[0].items() if clean_weight * k / n[0] > 0.1 * seen[1][w] / n[1]))


class Model(NamedTuple):
    lexicon: Lexicon
    weights: list[float]
    intercept: float

    def score(self, text: Column) -> Column:
        """Probability of label 1."""
        x = features_column(text, self.lexicon)
        return 1 / (1 + F.exp(-F.aggregate(F.zip_with(x, F.array(*map(F.lit, self.weights)), lambda a, b: a * b), F.lit(self.intercept), lambda a, b: a + b)))


def fit_weights(x: np.ndarray, y: np.ndarray, row_weights: np.ndarray, ridge: float = 1e-3, rounds: int = 50) -> tuple[list[float], float]:
    """Logistic regression by Newton steps; finds never speak against toxicity, so weights that would be negative are left out."""
    use = list(range(x.shape[1]))
    total = row_weights.sum()
    while True:
        a = np.hstack([x[:, use], np.ones((len(x), 1))])
        w = np.zeros(a.shape[1])
        hold = np.diag([ridge * total] * len(use) + [1e-6 * total])
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
            step = np.linalg.solve((a * (row_weights * p * (1 - p))[:, None]).T @ a + hold, a.T @ (row_weights * (p - y)) + hold @ w)
            w -= np.clip(step, -5, 5)
            if np.abs(step).max() < 1e-8:
                break
        if not use or w[:-1].min() >= 0:
            break
        use = [k for k, v in zip(use, w[:-1], strict=True) if v > 0]
    out = [0.0] * x.shape[1]
    for k, v in zip(use, w[:-1], strict=True):
        out[k] = float(v)
    return out, float(w[-1])


def held_out(key: str = "doc_id") -> Column:
    """Rows whose labels are never learned from: a third, by the CRC-32 of the id as text. A null id is held out."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % 3 == 1, F.lit(True))


def _words_column(text: str) -> Column:
    @F.arrow_udf("array<string>")
    def compute(texts: pa.Array) -> pa.Array:
        return pa.array([sorted(words_in(t.as_py() or "")) for t in texts], pa.list_(pa.string()))

    return compute(text)


def train(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "toxic", toxic_rows: int = TOXIC_ROWS, clean_rows: int = CLEAN_ROWS) -> Model:
    """Fits a model to at most toxic_rows and clean_rows labelled rows, chosen by the hash of the id; the weights make up for unlike shares of the labels in the sample. Only the ids
    are broadcast; the distinct words and the features of the sample reach the driver."""
    known = labels.where(F.col(label).isin(0, 1) & ~held_out(key)).select(F.col(key).alias("known"), F.col(label).cast("int").alias("label"), F.xxhash64(F.col(key).cast("string"), F.lit("toxic")).alias("h"))
    bounds = {1: toxic_rows, 0: clean_rows}
    chosen = known.where("label = 1").orderBy("h", "known").limit(toxic_rows).unionByName(known.where("label = 0").orderBy("h", "known").limit(clean_rows))
    rows = docs.where(F.length(text) <= SAMPLE_TEXT).select(F.col(key).alias("id"), F.col(text).alias("body")).join(F.broadcast(chosen), F.col("id") == F.col("known")).select("label", "h", "body")
    # An id may stand at many rows: the bounds hold for the rows that are learned from, not for the ids alone.
    each = [rows.where(F.col("label") == k).orderBy("h", F.xxhash64("body")).limit(n) for k, n in bounds.items()]
    sample = cut(each[0].unionByName(each[1]))
    told = sample.select("label", _words_column("body").alias("w")).toArrow()
    all_rows = {r.label: r.n for r in known.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    y = told["label"].to_numpy()
    share, ones = all_rows.get(1, 0) / max(1, sum(all_rows.values())), float(y.sum())
    heavier = (1 - share) / share * ones / (len(y) - ones) if 0 < ones < len(y) and share else 1.0  # a clean row of the sample against a toxic one
    lexicon = learn_lexicon(zip(y.tolist(), (w.as_py() for w in told["w"]), strict=True), heavier)
    found = sample.select("label", features_column(F.col("body"), lexicon).alias("x")).collect()
    data = np.array(sorted([r.label, *r.x] for r in found), np.float64).reshape(len(found), 1 + len(FEATURES))
    y, x = data[:, 0], data[:, 1:]
    if not len(y) or y.min() == y.max():
        share = (y.sum() + 1) / (len(y) + 2)
        return Model(lexicon, [0.0] * len(FEATURES), float(np.log(share / (1 - share))))
    weights, intercept = fit_weights(x, y, np.where(y == 1, share / y.mean(), (1 - share) / (1 - y.mean())))
    return Model(lexicon, weights, intercept)


def assess(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "toxic", threshold: float = 0.7) -> DataFrame:
    """One row for each row of docs: doc_id, held_out, score, predicted (1 if score >= threshold).

    Null and empty texts hold no term and have the score of texts without any; rows with a null id are scored and held out. Repeated rows are returned each, very long texts
    are read whole (only texts of at most SAMPLE_TEXT code points are learned from). Without labels every score is the same. Other columns are not looked at, whatever their
    names; an empty table gives an empty result.
    """
    scored = docs.select(F.col(key).alias("doc_id"), held_out(key).alias("held_out"), train(docs, labels, text, key, label).score(F.col(text)).alias("score"))
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
