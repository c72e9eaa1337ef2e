"""Quality classifier: a generalised additive model with pairwise interactions.

Each feature, and each of a few pairs of features, has a lookup table over bins. The
tables are learned by boosting shallow trees on one feature or pair after the other,
in cycles; a score is the logistic function of the sum of a row's bins.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postlake.llm.common import SAMPLE_ROWS, held_out, ids, labelled_sample, texts

FEATURES = (
    "log_words", "word_length", "distinct_words", "repeats_previous", "top_word", "distinct_pairs",
    "symbols", "exclamations", "bars", "capitals", "digits", "stops", "duplicate_lines", "line_words",
)
_SYMBOLS, _CAPITALS, _DIGITS, _STOPS = ([ord(c) for c in s] for s in ("#*$%&<>", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", ".,;:?"))


def features(text: str) -> list[float]:
    """The values of FEATURES for a whole text; zeros for one without words."""
    raw = text.encode()
    words = raw.split()
    n = len(words)
    if not n:
        return [0.0] * len(FEATURES)
    seen: dict[bytes, int] = {}
    ids = np.array([seen.setdefault(w, len(seen)) for w in words])
    of_byte = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    pairs = np.unique(ids[1:] * len(seen) + ids[:-1])
    chars = max(1, len(raw) - int(of_byte[[9, 10, 11, 12, 13, 32]].sum()))
    return [
        float(np.log(n)), chars / n, len(seen) / n, float((ids[1:] == ids[:-1]).sum()) / n, float(np.bincount(ids).max()) / n,
        len(pairs) / max(1, n - 1), float(of_byte[_SYMBOLS].sum()) / n, float(of_byte[33]) / n, float(of_byte[124]) / n,
        float(of_byte[_CAPITALS].sum()) / chars, float(of_byte[_DIGITS].sum()) / chars, float(of_byte[_STOPS].sum()) / n,
        1 - len(set(lines)) / max(1, len(lines)), n / max(1, len(lines)),
    ]


@dataclass
class Model:
    """``cuts``: bin edges of each feature; ``coarse``: which of 8 coarse bins each bin is in, for pairs."""

    cuts: list[np.ndarray]
    coarse: list[np.ndarray]
    base: float
    single: list[np.ndarray]
    pairs: dict[tuple[int, int], np.ndarray]

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.searchsorted(c, x[:, k], side="right") for k, c in enumerate(self.cuts)])

    def score(self, x: np.ndarray) -> np.ndarray:
        """Vectorised bin additions."""
        b = self.bins(x)
        total = np.full(len(x), self.base)
        for k, table in enumerate(self.single):
            total += table[b[:, k]]
        for (i, j), table in self.pairs.items():
            total += table[self.coarse[i][b[:, i]], self.coarse[j][b[:, j]]]
        return 1 / (1 + np.exp(-total))


def _leaf(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return g / (h + 1.0)


def _gain(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return g * g / (h + 1.0)


def _tree(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Leaf values by bin of a tree of two splits on one feature, from sums of gradients and weights by bin."""

    def split(lo: int, hi: int) -> tuple[float, int]:
        a, b = np.cumsum(g[lo:hi])[:-1], np.cumsum(h[lo:hi])[:-1]
        if not len(a):
            return 0.0, lo
        gains = _gain(a, b) + _gain(g[lo:hi].sum() - a, h[lo:hi].sum() - b) - _gain(g[lo:hi].sum(), h[lo:hi].sum())
        k = int(gains.argmax())
        return float(gains[k]), lo + k + 1

    edges = [0, len(g)]
    for _ in range(2):
        gain, at = max((split(lo, hi) for lo, hi in zip(edges, edges[1:], strict=False)), key=lambda x: x[0])
        if gain <= 1e-9:
            break
        edges = sorted([*edges, at])
    out = np.zeros(len(g))
    for lo, hi in zip(edges, edges[1:], strict=False):
        out[lo:hi] = _leaf(g[lo:hi].sum(), h[lo:hi].sum())
    return out


def _pair_tree(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """Gain and leaf values by bin of the best cut of both features into four quadrants."""
    cg, ch = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    tg, th = cg[-1, -1], ch[-1, -1]
    parts = []
    for c, t in ((cg, tg), (ch, th)):
        a = c[:-1, :-1]
        b, d = c[:-1, -1:] - a, c[-1:, :-1] - a
        parts.append((a, b, d, t - a - b - d))
    gains = sum(_gain(x, y) for x, y in zip(*parts, strict=True)) - _gain(tg, th)
    i, j = np.unravel_index(int(gains.argmax()), gains.shape)
    out = np.zeros_like(g)
    for rows in (slice(0, i + 1), slice(i + 1, None)):
        for cols in (slice(0, j + 1), slice(j + 1, None)):
            out[rows, cols] = _leaf(g[rows, cols].sum(), h[rows, cols].sum())
    return float(gains[i, j]), out


def fit(x: np.ndarray, y: np.ndarray, bins: int = 32, rounds: int = 200, rate: float = 0.1, n_pairs: int = 6, pair_rounds: int = 60) -> Model:
    """Fit on rows ``x`` with labels ``y`` (0 or 1); the bins hold equal shares of the rows."""
    cuts = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, bins + 1)[1:-1])) for k in range(x.shape[1])]
    coarse = [np.arange(len(c) + 1) * 8 // (len(c) + 1) for c in cuts]
    rate0 = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    model = Model(cuts, coarse, float(np.log(rate0 / (1 - rate0))), [np.zeros(len(c) + 1) for c in cuts], {})
    b = model.bins(x)
    total = np.full(len(x), model.base)

    def gradients() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-total))
        return y - p, p * (1 - p)

    for _ in range(rounds):
        for k, table in enumerate(model.single):
            g, h = gradients()
            step = rate * _tree(np.bincount(b[:, k], g, len(table)), np.bincount(b[:, k], h, len(table)))
            table += step
            total += step[b[:, k]]
    cells = {(i, j): coarse[i][b[:, i]] * 8 + coarse[j][b[:, j]] for i, j in combinations(range(x.shape[1]), 2)}

    def grid(pair: tuple[int, int]) -> tuple[float, np.ndarray]:
        g, h = gradients()
        return _pair_tree(np.bincount(cells[pair], g, 64).reshape(8, 8), np.bincount(cells[pair], h, 64).reshape(8, 8))

    best = sorted(cells, key=lambda p: (-grid(p)[0], p))[:n_pairs]
    model.pairs = {p: np.zeros((8, 8)) for p in best}
    for _ in range(pair_rounds):
        for pair, table in model.pairs.items():
            step = rate * grid(pair)[1]
            table += step
            total += step.ravel()[cells[pair]]
    return model


def train(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> Model:
    """Fit on ``labels.quality`` of at most ``rows`` documents outside the held-out fold, on the driver."""
    sample = labelled_sample(docs, labels, "quality", rows)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"x": [features(t) for t in batch["text"]], "y": (batch["label"] == 1).astype(float)})

    found = sample.mapInPandas(run, "x array<double>, y double").collect()
    x = np.array([r["x"] for r in found], float).reshape(-1, len(FEATURES))
    y = np.array([r["y"] for r in found], float)
    if not len(y):
        x, y = np.zeros((1, len(FEATURES))), np.array([0.5])
    order = np.lexsort(np.column_stack([x, y]).T)  # the same sums, however rows arrive
    return fit(x[order], y[order])


def score(docs: DataFrame, model: Model, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score and predicted of every row, from its whole text.

    Null and blank texts have features of zero and a score like others. Repeated rows get the same score
    each; an empty table gives no row. Columns besides doc_id and text are not read.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x = np.array([features(t) for t in batch["text"]], float).reshape(-1, len(FEATURES))
            out = pd.DataFrame({"doc_id": ids(batch).array, "held_out": batch["held_out"], "score": model.score(x)})
            out["predicted"] = (out["score"] >= threshold).astype("int32")
            yield out

    rows = texts(docs, held_out(F.col("doc_id")).alias("held_out"))
    return rows.mapInPandas(run, "doc_id long, held_out boolean, score double, predicted int")
