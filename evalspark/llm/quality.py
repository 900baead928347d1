"""Quality classifier: a generalised additive model with pairwise interactions.

Each feature of a text is cut into bins, and each bin has a value in a lookup table. The tables are learned by boosting
in turns: one shallow tree on one feature, then one on the next, round after round, each adding a small step to that
feature's table. Then the pairs of features whose joint bins still explain most get tables of their own, learned the
same way. A score is the logistic of the sum of the values looked up.
"""

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evalspark.llm.common import held_out, keyed_texts, labelled_sample

FEATURES = ["log_words", "word_bytes", "upper", "letters", "digits", "signs", "stops", "wide", "distinct", "repeated_next", "top_word", "repeated_lines", "line_words", "ended_lines", "capitalised", "signed_words"]
SIGNS = np.frombuffer(b"#*$%&|<>@^~_=+{}[]\\/`", np.uint8)
STOPS = np.frombuffer(b".,;:!?", np.uint8)
NOT_ENDS = frozenset("#*$%&|<>!=")


def features(text: str) -> list[float]:
    """Measures of one whole text, each safe for an empty one."""
    count = np.bincount(np.frombuffer(text.encode(), np.uint8), minlength=256)
    words = text.split()
    n, total = len(words), int(count.sum())
    seen = Counter(words)
    lines = [line for line in text.split("\n") if line and not line.isspace()]
    upper, lower = int(count[65:91].sum()), int(count[97:123].sum())
    wide = int(count[128:].sum())
    solid = max(1, total - int(count[[9, 10, 11, 12, 13, 32]].sum()))
    return [
        float(np.log1p(n)),
        solid / max(1, n),
        upper / max(1, upper + lower),
        (upper + lower + wide) / solid,
        int(count[48:58].sum()) / solid,
        int(count[SIGNS].sum()) / solid,
        int(count[STOPS].sum()) / solid,
        wide / solid,
        len(seen) / max(1, n),
        sum(map(eq, words, words[1:])) / max(1, n - 1),
        max(seen.values(), default=0) / max(1, n),
        1 - len(set(lines)) / max(1, len(lines)),
        n / max(1, len(lines)),
        sum(line[-1] in ".?" for line in lines) / max(1, len(lines)),
        sum(word[0].isupper() for word in words) / max(1, n),
        sum(word[-1] in NOT_ENDS for word in words) / max(1, n),
    ]


@dataclass
class Additive:
    """Bin edges and tables of the features, and the tables of pairs of them over coarser edges."""

    edges: list[np.ndarray]
    tables: list[np.ndarray]
    pairs: list[tuple[int, int]] = field(default_factory=list)
    pair_edges: list[np.ndarray] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)
    intercept: float = 0.0

    def scores(self, values: np.ndarray) -> np.ndarray:
        margin = np.full(len(values), self.intercept)
        for i, (edges, table) in enumerate(zip(self.edges, self.tables)):
            margin += table[np.searchsorted(edges, values[:, i], side="right")]
        if self.pairs:
            coarse = [np.searchsorted(edges, values[:, i], side="right") for i, edges in enumerate(self.pair_edges)]
            for (i, j), table in zip(self.pairs, self.pair_tables):
                margin += table[coarse[i], coarse[j]]
        return 1 / (1 + np.exp(-margin))


def _edges(values: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(values, np.linspace(0, 1, bins + 1)[1:-1]))


def _gain(g: np.ndarray, h: np.ndarray, ridge: float) -> np.ndarray:
    return g * g / (h + ridge)


def _tree_1d(g: np.ndarray, h: np.ndarray, leaves: int, ridge: float, least: float) -> np.ndarray:
    """Values per bin of a tree with a few leaves, grown by the best cut of any leaf."""
    spans = [(0, len(g))]
    cg, ch = np.concatenate(([0.0], g.cumsum())), np.concatenate(([0.0], h.cumsum()))
    while len(spans) < leaves:
        best = (1e-9, None, None)
        for k, (a, b) in enumerate(spans):
            if b - a < 2:
                continue
            left_g, left_h = cg[a + 1 : b] - cg[a], ch[a + 1 : b] - ch[a]
            right_g, right_h = cg[b] - cg[a + 1 : b], ch[b] - ch[a + 1 : b]
            gain = _gain(left_g, left_h, ridge) + _gain(right_g, right_h, ridge) - _gain(cg[b] - cg[a], ch[b] - ch[a], ridge)
            gain[(left_h < least) | (right_h < least)] = -1
            at = int(gain.argmax())
            if gain[at] > best[0]:
                best = (gain[at], k, a + 1 + at)
        if best[1] is None:
            break
        a, b = spans.pop(best[1])
        spans += [(a, best[2]), (best[2], b)]
    step = np.zeros(len(g))
    for a, b in spans:
        step[a:b] = (cg[b] - cg[a]) / (ch[b] - ch[a] + ridge)
    return step


def _tree_2d(g: np.ndarray, h: np.ndarray, ridge: float) -> tuple[np.ndarray, float]:
    """Values per cell of the best four quadrants, and how much they explain."""
    cg, ch = np.zeros(np.add(g.shape, 1)), np.zeros(np.add(g.shape, 1))
    cg[1:, 1:], ch[1:, 1:] = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    if min(g.shape) < 2:
        return np.zeros(g.shape), 0.0
    inner, all_rows, all_columns = (slice(1, -1), slice(1, -1)), (slice(1, -1), slice(-1, None)), (slice(-1, None), slice(1, -1))
    parts = []
    for c in (cg, ch):
        upper_left = c[inner]
        parts.append((upper_left, c[all_rows] - upper_left, c[all_columns] - upper_left, c[-1, -1] - c[all_rows] - c[all_columns] + upper_left))
    gain = sum(_gain(a, b, ridge) for a, b in zip(*parts))
    i, j = np.unravel_index(int(gain.argmax()), gain.shape)
    step = np.zeros(g.shape)
    quadrants = [(slice(0, i + 1), slice(0, j + 1)), (slice(0, i + 1), slice(j + 1, None)), (slice(i + 1, None), slice(0, j + 1)), (slice(i + 1, None), slice(j + 1, None))]
    for place, a, b in zip(quadrants, parts[0], parts[1]):
        step[place] = a[i, j] / (b[i, j] + ridge)
    return step, float(gain[i, j] - cg[-1, -1] ** 2 / (ch[-1, -1] + ridge))


def fit_additive(values: np.ndarray, labels: np.ndarray, rounds: int = 120, pair_rounds: int = 40, pairs: int = 6, bins: int = 32, pair_bins: int = 8, leaves: int = 3, rate: float = 0.15, ridge: float = 1.0, least: float = 1.0) -> Additive:
    """Learn from a matrix of features and 0/1 labels. Without rows, or with one label only, the score is constant."""
    width = values.shape[1]
    share = (labels.sum() + 0.5) / (len(labels) + 1)
    model = Additive([np.zeros(0)] * width, [np.zeros(1) for _ in range(width)], intercept=float(np.log(share / (1 - share))))
    if len(labels) == 0 or labels.min() == labels.max():
        return model
    model.edges = [_edges(values[:, i], bins) for i in range(width)]
    model.tables = [np.zeros(len(edges) + 1) for edges in model.edges]
    at = [np.searchsorted(edges, values[:, i], side="right") for i, edges in enumerate(model.edges)]
    margin = np.full(len(labels), model.intercept)

    def gradient() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-margin))
        return labels - p, p * (1 - p)

    for _ in range(rounds):
        for i, table in enumerate(model.tables):
            g, h = gradient()
            step = rate * _tree_1d(np.bincount(at[i], g, len(table)), np.bincount(at[i], h, len(table)), leaves, ridge, least)
            table += step
            margin += step[at[i]]
    model.pair_edges = [_edges(values[:, i], pair_bins) for i in range(width)]
    coarse = [np.searchsorted(edges, values[:, i], side="right") for i, edges in enumerate(model.pair_edges)]

    def tree(i: int, j: int) -> tuple[np.ndarray, float]:
        shape = (len(model.pair_edges[i]) + 1, len(model.pair_edges[j]) + 1)
        cell, (g, h) = coarse[i] * shape[1] + coarse[j], gradient()
        return _tree_2d(np.bincount(cell, g, shape[0] * shape[1]).reshape(shape), np.bincount(cell, h, shape[0] * shape[1]).reshape(shape), ridge)

    ranked = sorted(combinations(range(width), 2), key=lambda pair: (-tree(*pair)[1], pair))
    model.pairs = ranked[:pairs]
    model.pair_tables = [np.zeros((len(model.pair_edges[i]) + 1, len(model.pair_edges[j]) + 1)) for i, j in model.pairs]
    for _ in range(pair_rounds):
        for (i, j), table in zip(model.pairs, model.pair_tables):
            step = rate * tree(i, j)[0]
            table += step
            margin += step[coarse[i], coarse[j]]
    return model


def fit_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = 20_000, parts: int = 3, part: int = 1, key: str = "doc_id", text: str = "text") -> Additive:
    """Learn from at most about `rows` labelled documents whose key is not held out (crc32 of the key modulo parts).

    The sample is bounded, so its keys are broadcast and its features, not its texts, come to the driver.
    """
    sample = F.broadcast(labelled_sample(labels, key, label, rows, parts, part))
    chosen = keyed_texts(docs, key, text).join(sample, F.col("key") == F.col("label_key")).select("label", "text")

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"label": batch.label.astype("float64"), "v": [features(value) for value in batch.text]})

    found = chosen.mapInPandas(measure, "label double, v array<double>").toPandas().sort_values("v", key=lambda v: v.map(tuple))
    values = np.array(found.v.tolist(), float).reshape(-1, len(FEATURES))
    return fit_additive(values, (found.label.to_numpy() > 0).astype(float))


def quality_score(text: Column, model: Additive) -> Column:
    """Score between 0 and 1 of each whole text; a null text is an empty one."""

    @F.pandas_udf(T.DoubleType())
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(model.scores(np.array([features(value) for value in texts], float).reshape(-1, len(FEATURES))))

    return score(F.coalesce(text, F.lit("")))


def classify_quality(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", parts: int = 3, part: int = 1, threshold: float = 0.5, **options) -> DataFrame:
    """key, held_out, score and predicted (1 from `threshold` on) of every row.

    Null and empty texts get the score of an empty text; a null key is not held out and never learned from. Repeated
    rows are scored alike. Labels with a null key or value are ignored; other columns are not read. An empty table
    gives an empty result, and without labels every score is one half.
    """
    model = fit_quality(docs, labels, parts=parts, part=part, key=key, text=text, **options)
    scored = keyed_texts(docs, key, text).select("key", held_out(F.col("key"), parts, part).alias("held_out"), quality_score(F.col("text"), model).alias("score"))
    return scored.select(F.col("key").alias(key), "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
