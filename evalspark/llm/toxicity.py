"""Toxicity by logistic regression over hashed word n-grams, learned with FTRL-proximal.

A text's features are its words, its pairs of neighbours and its pairs with one word between them, each hashed to a
coordinate. Every coordinate has a learning rate of its own, and an L1 penalty keeps those at exactly zero that are
seen too rarely to matter, so the weights that are broadcast are few.
"""

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evalspark.llm.common import arrow_schema, batches_of, held_out, kept, keyed_texts, labelled_sample, texts_of

CACHED = 400_000
LONGEST_CACHED = 48
MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xFF51AFD7ED558CCD], np.uint64)


@dataclass(frozen=True)
class Ftrl:
    """Rates, penalties and passes of the learner; 2**bits coordinates."""

    bits: int = 22
    alpha: float = 2.0
    beta: float = 1.0
    l1: float = 3.0
    l2: float = 0.1
    passes: int = 4


class Hasher:
    """Distinct coordinates of a text's words, pairs and skip pairs."""

    def __init__(self, bits: int):
        self.shift, self.words = np.uint64(64 - bits), {}

    def _learn(self, chunk: str) -> int:
        if len(self.words) > CACHED:
            self.words.clear()
        word = "".join(filter(str.isalnum, chunk.lower()))
        found = xxhash.xxh64_intdigest(word.encode()) >> 1 if word else -1
        if len(chunk) <= LONGEST_CACHED:
            self.words[chunk] = found
        return found

    def __call__(self, text: str) -> np.ndarray:
        chunks = text.split()
        ids = list(map(self.words.get, chunks))
        if None in ids:
            learn = self._learn
            ids = [learn(chunk) if i is None else i for i, chunk in zip(ids, chunks)]
        words = np.array(ids, np.int64)
        words = words[words >= 0].astype(np.uint64)
        first, second, last = MULTIPLIERS
        mixed = np.concatenate([words, words[:-1] * first + words[1:] * second, words[:-2] * second + words[2:] * last])
        mixed ^= mixed >> np.uint64(31)
        return np.unique((mixed * last) >> self.shift).astype(np.int64)


class Learner:
    """Sums of gradients and of their squares per coordinate; the last coordinate is the constant."""

    def __init__(self, rule: Ftrl):
        self.rule = rule
        self.z, self.n = np.zeros((1 << rule.bits) + 1), np.zeros((1 << rule.bits) + 1)

    def weights(self, at: np.ndarray) -> np.ndarray:
        rule, z = self.rule, self.z[at]
        l1 = np.where(at == len(self.z) - 1, 0.0, rule.l1)
        shrunk = -(z - np.sign(z) * l1) / ((rule.beta + np.sqrt(self.n[at])) / rule.alpha + rule.l2)
        return np.where(np.abs(z) <= l1, 0.0, shrunk)

    def learn(self, features: np.ndarray, label: float) -> None:
        at = np.append(features, len(self.z) - 1)
        weights = self.weights(at)
        gradient = 1 / (1 + np.exp(-np.clip(weights.sum(), -35, 35))) - label
        n = self.n[at]
        self.z[at] += gradient - (np.sqrt(n + gradient * gradient) - np.sqrt(n)) / self.rule.alpha * weights
        self.n[at] += gradient * gradient


def learn_weights(examples: list[tuple[float, np.ndarray]], rule: Ftrl) -> tuple[np.ndarray, np.ndarray]:
    """Coordinates with a weight, and the weights, after a few passes over (label, features)."""
    learner = Learner(rule)
    for _ in range(rule.passes):
        for label, features in examples:
            learner.learn(features, label)
    weights = learner.weights(np.arange(len(learner.z)))
    at = np.flatnonzero(weights)
    return at, weights[at]


def fit_toxicity(docs: DataFrame, labels: DataFrame, label: str = "toxic", rows: int = 16_000, rule: Ftrl = Ftrl(), parts: int = 4, part: int = 2, key: str = "doc_id", text: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """Weights learned in one task from about `rows` labelled documents whose key is not held out.

    FTRL goes through examples one by one, so the sample, which `rows` bounds at every size of the input, is what one
    task takes; it sorts the examples by a hash of their keys. At most 2**bits weights come back to the driver.
    """
    sample = F.broadcast(labelled_sample(labels, key, label, rows, parts, part))
    chosen = keyed_texts(docs, key, text).join(sample, F.col("key") == F.col("label_key")).select(F.xxhash64("key").alias("turn"), "label", "text")
    schema = "at long, weight double"
    arrow = arrow_schema(T.StructType.fromDDL(schema))

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, examples = Hasher(rule.bits), []
        for batch in batches:
            examples += [(float(y > 0), hasher(value).astype(np.int32)) for y, value in zip(batch.column(1).to_pylist(), texts_of(batch))]
        if examples:
            at, weights = learn_weights(examples, rule)
            yield from batches_of({"at": at, "weight": weights}, arrow)

    found = chosen.repartition(1).sortWithinPartitions("turn", "label", "text").mapInArrow(learn, schema).toPandas()
    return found["at"].to_numpy(np.int64), found["weight"].to_numpy(float)


def toxicity_score(spark, text: Column, weights: tuple[np.ndarray, np.ndarray], rule: Ftrl = Ftrl()) -> Column:
    """Score between 0 and 1 of each whole text; a null text is an empty one."""
    shared, tag = spark.sparkContext.broadcast(weights), uuid.uuid4().hex

    def load():
        at, values = shared.value
        table = np.zeros((1 << rule.bits) + 1)
        table[at] = values
        return Hasher(rule.bits), table

    @F.pandas_udf(T.DoubleType())
    def score(texts: pd.Series) -> pd.Series:
        hasher, table = kept("toxicity", tag, load)
        margins = np.array([table[hasher(value)].sum() + table[-1] for value in texts], float)
        return pd.Series(1 / (1 + np.exp(-np.clip(margins, -35, 35))))

    return score(F.coalesce(text, F.lit("")))


def classify_toxicity(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", parts: int = 4, part: int = 2, threshold: float = 0.3, rule: Ftrl = Ftrl(), **options) -> DataFrame:
    """key, held_out, score and predicted (1 from `threshold` on) of every row.

    Null and empty texts get the score of a text without words; a null key is not held out and never learned from.
    Repeated rows are scored alike. Labels with a null key or value are ignored; other columns are not read. An empty
    table gives an empty result, and without labels every score is one half.
    """
    weights = fit_toxicity(docs, labels, parts=parts, part=part, key=key, text=text, rule=rule, **options)
    scored = keyed_texts(docs, key, text).select("key", held_out(F.col("key"), parts, part).alias("held_out"), toxicity_score(docs.sparkSession, F.col("text"), weights, rule).alias("score"))
    return scored.select(F.col("key").alias(key), "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
