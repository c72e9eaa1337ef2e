"""Toxicity by a weighted lexicon, matched with an Aho-Corasick automaton.

Texts are folded first: lower case, homoglyphs as the Latin letters that they look
like, and digits in words as the letters that they stand for. The lexicon has
words and beginnings of words, each weighing its log odds between labelled toxic and
clean documents, and exception phrases in which a term doesn't count. The score is a
logistic function of the matched weight, as a sum and in proportion to the length.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postlake.llm.common import SAMPLE_ROWS, held_out, ids, labelled_sample, texts

# Cyrillic and Greek letters and the Latin ones that they look like.
LOOKALIKES = dict(zip("аеорсухкіјѕԁһӏνοαετυικρω", "aeopcyxkijsdhlvoaetuikpw", strict=True))
# Digits and signs that stand for letters within words.
STANDS_FOR = dict(zip("0123456789@$", "oizeasgtbgas", strict=True))

_FOLD = str.maketrans(LOOKALIKES | {chr(0xFF41 + k): chr(97 + k) for k in range(26)})
_DIGITS = str.maketrans(STANDS_FOR)
_TOKEN = re.compile(r"[@$]*[^\W_]+(?:[@$]+[^\W_]+)*[@$]*")
_FOREIGN = re.compile("[Ͱ-ԯＡ-ｚ]")
#: Beginnings of words of these lengths may be terms.
STEMS = range(3, 9)


def fold(text: str) -> str:
    """The words of a text, folded, each between two spaces."""
    text = text.lower()
    if _FOREIGN.search(text):
        text = text.translate(_FOLD)
    return " " + " ".join([w if w.isalpha() or w.isdigit() else _spelled(w) for w in _TOKEN.findall(text)]) + " "


def _spelled(word: str) -> str:
    """A word with the letters that digits and signs stand for; amounts and the like keep their digits."""
    return word.translate(_DIGITS) if any(c.isalpha() for c in word) else word.strip("@$")


@dataclass
class Lexicon:
    """``weights``: " word " or " beginning" to weight; ``exceptions``: " phrase " in which terms don't count."""

    weights: dict[str, float]
    exceptions: list[str] = field(default_factory=list)

    def automaton(self):
        import ahocorasick

        machine = ahocorasick.Automaton()
        for term, weight in self.weights.items():
            machine.add_word(term, (len(term), weight))
        for phrase in self.exceptions:
            machine.add_word(phrase, (len(phrase), 0.0))
        if len(machine):
            machine.make_automaton()
        return machine


def hits(machine, folded: str) -> list[float]:
    """Weights of the terms matched: at each word the longest one; none where an exception phrase lies."""
    if not len(machine):
        return []
    found: dict[int, float] = {}
    spared: list[tuple[int, int]] = []
    for end, (n, weight) in machine.iter(folded):
        if weight:
            found[end - n + 1] = weight
        else:
            spared.append((end - n + 1, end))
    spared.sort()
    hidden, k, reach = set(), 0, 0
    for at in sorted(found):  # the furthest end of the phrases that begin before a term tells whether one holds it
        while k < len(spared) and spared[k][0] <= at:
            reach = max(reach, spared[k][1])
            k += 1
        if at < reach:
            hidden.add(at)
    return [w for at, w in found.items() if at not in hidden]


def features(machine, folded: str) -> tuple[float, float, float]:
    matched = hits(machine, folded)
    total, words = sum(matched), max(1, folded.count(" ") - 1)
    return math.log1p(total), math.log1p(100 * total / words), math.log1p(len(matched))


def _terms(folded: str) -> set[str]:
    words = set(folded.split())
    return {f" {w} " for w in words if len(w) > 2} | {f" {w[:k]}" for w in words for k in STEMS if len(w) > k}


def _pairs(folded: str, terms: set[str]) -> set[str]:
    words = folded.split()
    flag = [f" {w} " in terms or any(f" {w[:k]}" in terms for k in STEMS if len(w) > k) for w in words]
    return {f" {a} {b} " for a, b, x, y in zip(words, words[1:], flag, flag[1:], strict=False) if x or y}


def _counts(rows: DataFrame, candidates) -> DataFrame:
    """term, and in how many rows of either label it is, for the terms that ``candidates(folded, label)`` gives."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            n: dict[int, Counter] = {0: Counter(), 1: Counter()}
            for text, label in zip(batch["text"], batch["label"], strict=True):
                n[int(label == 1)].update(candidates(fold(text), label))
            yield pd.DataFrame([(t, n[1][t], n[0][t]) for t in n[1].keys() | n[0].keys()], columns=["term", "toxic", "clean"])

    return rows.mapInPandas(run, "term string, toxic long, clean long").groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def _evidence(a: int, b: int, n1: int, n0: int) -> tuple[float, float]:
    """Log odds, and G squared, of a term in a of n1 toxic and b of n0 clean documents."""
    weight = math.log((a + 0.5) / (n1 + 1)) - math.log((b + 0.5) / (n0 + 1))
    e1, e0 = (a + b) * n1 / (n1 + n0), (a + b) * n0 / (n1 + n0)
    return weight, 2 * (a * math.log(a / e1) + (b * math.log(b / e0) if b else 0))


def learn_lexicon(sample: DataFrame, least_odds: float = 8.0, least_g: float = 20.0) -> Lexicon:
    """Terms far more frequent in toxic documents than in clean ones, and their exceptions.

    Counting is done by Spark in two passes: candidates come from toxic documents, then
    those are counted in clean ones. Of a word and its beginnings, the longest that are found in
    nearly as many documents are taken; a longer one of about the same weight is needless then. A pair of words with a term in it that is found in clean
    documents at least five times as often as in toxic ones, a document each, is an exception.
    What these thresholds let through comes to the driver, all of it: its size is bounded by the sample's words.
    """
    sizes = {int(r["label"] == 1): r["n"] for r in sample.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    n1, n0 = sizes.get(1, 0), sizes.get(0, 0)
    if not n1 or not n0:
        return Lexicon({})
    least = max(3, n1 // 200)
    first = _counts(sample.where("label = 1"), lambda folded, _: _terms(folded)).where(F.col("toxic") >= least)
    toxic = {r["term"]: r["toxic"] for r in first.collect()}
    known = frozenset(toxic)
    clean = {r["term"]: r["clean"] for r in _counts(sample.where("label != 1"), lambda folded, _: _terms(folded) & known).collect()}
    # a term that a longer one nearly always continues says less precisely what that one says
    vague = {t[:k] for t, n in toxic.items() for k in range(1 + STEMS[0], len(t)) if n >= 0.9 * toxic.get(t[:k], n)}
    weights: dict[str, float] = {}
    for term in sorted(toxic.keys() - vague, key=lambda t: (len(t), t)):
        weight, g = _evidence(toxic[term], clean.get(term, 0), n1, n0)
        shorter = [weights[term[:k]] for k in range(1 + STEMS[0], len(term)) if term[:k] in weights]
        if g >= least_g and weight >= math.log(least_odds) and all(weight > w + 0.7 for w in shorter):
            weights[term] = weight
    if not weights:
        return Lexicon({})
    terms = frozenset(weights)
    pairs = _counts(sample, lambda folded, _: _pairs(folded, terms)).where("clean >= 3 and clean * {0} >= 5 * toxic * {1}".format(n1, n0))
    return Lexicon(weights, sorted(r["term"] for r in pairs.collect()))


@dataclass
class Model:
    lexicon: Lexicon
    coefficients: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(x @ self.coefficients[1:] + self.coefficients[0])))


def _logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1.0, steps: int = 30) -> np.ndarray:
    x = np.column_stack([np.ones(len(x)), x])
    ridge = penalty * np.eye(x.shape[1])
    ridge[0, 0] = 1e-6
    beta = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (y - p) - ridge @ beta)
        beta += np.clip(step, -4, 4)
    return beta


def train(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> Model:
    """Learn lexicon and scale from ``labels.toxic`` of at most ``rows`` documents outside the held-out fold."""
    sample = labelled_sample(docs, labels, "toxic", rows)
    lexicon = learn_lexicon(sample)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        machine = lexicon.automaton()
        for batch in batches:
            out = pd.DataFrame([features(machine, fold(t)) for t in batch["text"]], columns=["a", "b", "c"])
            out["y"] = (batch["label"].to_numpy() == 1).astype(float)
            yield out

    # at most ``rows`` rows of four numbers
    table = np.array(sample.mapInPandas(run, "a double, b double, c double, y double").collect(), float).reshape(-1, 4)
    table = table[np.lexsort(table.T)]
    if not len(table):
        return Model(lexicon, np.array([-2.0, 0, 0, 0]))
    return Model(lexicon, _logistic(table[:, :3], table[:, 3]))


def score(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score and predicted of every row, from its whole text.

    Null and blank texts match nothing and get the score of that. Repeated rows get the same score each; an
    empty table gives no row. Columns besides doc_id and text are not read.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        machine = model.lexicon.automaton()
        for batch in batches:
            x = np.array([features(machine, fold(t)) for t in batch["text"]], float).reshape(-1, 3)
            out = pd.DataFrame({"doc_id": ids(batch).array, "held_out": batch["held_out"], "score": model.score(x)})
            out["predicted"] = (out["score"] >= threshold).astype("int32")
            yield out

    rows = texts(docs, held_out(F.col("doc_id")).alias("held_out"))
    return rows.mapInPandas(run, "doc_id long, held_out boolean, score double, predicted int")


def without_toxic(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs``, with all their columns, that score below the threshold; repeated rows share their fate.

    Null and blank texts score as in `score`, without a match, and stay unless that alone reaches the threshold. An empty table stays empty.
    """

    @F.pandas_udf("boolean")
    def clean(found: pd.Series) -> pd.Series:
        machine = _machine(model)
        x = np.array([features(machine, fold(t or "")) for t in found], float).reshape(-1, 3)
        return pd.Series(model.score(x) < threshold)

    return docs.where(clean("text"))


_MACHINES: list = []


def _machine(model: Model):
    """The model's automaton, made once in each worker."""
    if not _MACHINES or _MACHINES[0] != model.lexicon:
        _MACHINES[:] = [model.lexicon, model.lexicon.automaton()]
    return _MACHINES[1]
