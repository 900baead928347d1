"""Language identification by rank-order profiles.

A profile is the list of the most frequent character n-grams (one to three letters, words set off by blanks), most
frequent first. A text's profile is compared with each language's: every n-gram of the text adds the difference of its
two ranks, or the greatest possible one if the language's profile does not have it. The least sum wins.
"""

import pickle
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evalspark.llm.common import arrow_schema, batches_of, held_out, kept, keyed_texts, texts_of

UNKNOWN = "und"
SIGN_BITS = 21
BLANK = 32


def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def grams(text: str, letters: np.ndarray) -> np.ndarray:
    """Codes of all n-grams of one to three signs; words are runs of letters in lower case between single blanks."""
    signs = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    signs = np.concatenate(([BLANK], np.where(letters[signs], signs, BLANK), [BLANK])).astype(np.uint64)
    blank = signs == BLANK
    signs = signs[~(blank & np.concatenate(([False], blank[:-1])))]
    one, two, shift = signs, signs[:-1] << np.uint64(SIGN_BITS) | signs[1:], np.uint64(SIGN_BITS)
    three = two[:-1] << shift | signs[2:]
    return np.concatenate([one[one != BLANK], two, three[signs[1:-1] != BLANK]]) if len(signs) > 1 else signs[:0]


def profile(codes: np.ndarray, size: int) -> np.ndarray:
    """The most frequent codes, most frequent first, the lower code first among equals."""
    found, counts = np.unique(codes, return_counts=True)
    if len(found) > size:
        least = np.partition(counts, len(counts) - size)[len(counts) - size]
        some = counts >= least
        found, counts = found[some], counts[some]
    return found[np.argsort(-counts, kind="stable")[:size]]


class Profiles:
    """Profiles of languages, as a table of ranks over all their n-grams."""

    def __init__(self, by_language: dict[str, list[int]], size: int):
        self.names, self.size = sorted(by_language), size
        self.codes = np.unique(np.array([code for codes in by_language.values() for code in codes], np.uint64))
        self.ranks = np.full((len(self.names), len(self.codes) + 1), -1, np.int64)
        for i, name in enumerate(self.names):
            codes = np.array(by_language[name], np.uint64)
            self.ranks[i, np.searchsorted(self.codes, codes)] = np.arange(len(codes))

    def nearest(self, codes: np.ndarray) -> tuple[str, float]:
        """The language with the least out-of-place distance (the first by name of equals), and 1 less its share of the greatest."""
        if not len(codes) or not self.names:
            return UNKNOWN, 0.0
        own = profile(codes, self.size)
        at = np.searchsorted(self.codes, own)
        at[at == len(self.codes)] = 0
        at = np.where(self.codes[at] == own, at, len(self.codes))
        ranks = self.ranks[:, at]
        distance = np.where(ranks < 0, self.size, np.abs(ranks - np.arange(len(own)))).sum(axis=1)
        best = int(distance.argmin())
        return self.names[best], 1 - float(distance[best]) / (self.size * len(own))


def fit_profiles(docs: DataFrame, size: int = 400, rows: int = 1500, parts: int = 4, part: int = 2, key: str = "doc_id", text: str = "text", lang: str = "lang", languages: int = 1_000) -> Profiles:
    """Profiles from about `rows` documents of each language that are not held out.

    The sample is bounded per language, and so is the number of languages: the `languages` most frequent values are learned.

    N-grams are counted within tasks, then summed by Spark; only the `size` most frequent of each language come back.
    """
    usable = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), F.col(lang).alias("lang"))
    usable = usable.filter(F.col("key").isNotNull() & F.col("text").isNotNull() & F.col("lang").isNotNull() & ~held_out(F.col("key"), parts, part))
    sizes = usable.groupBy(F.col("lang").alias("of_lang")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "of_lang").limit(languages)
    luck = F.shiftrightunsigned(F.xxhash64(F.col("key").cast("string"), F.lit("sample")), 11) / F.lit(float(1 << 53))
    rates = sizes.select("of_lang", (F.lit(float(rows)) / F.col("n")).alias("rate"))
    chosen = usable.join(F.broadcast(rates), F.col("lang") == F.col("of_lang")).filter(luck < F.col("rate")).select("lang", "text")
    schema = "lang string, code long, n long"
    arrow = arrow_schema(T.StructType.fromDDL(schema))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters = kept("letters", "all", _letters)
        for batch in batches:
            by_lang: dict[str, list[np.ndarray]] = {}
            for name, value in zip(batch.column(0).to_pylist(), texts_of(batch)):
                by_lang.setdefault(name, []).append(grams(value, letters))
            for name, codes in by_lang.items():
                found, counts = np.unique(np.concatenate(codes), return_counts=True)
                yield from batches_of({"lang": [name] * len(found), "code": found.astype(np.int64), "n": counts}, arrow)

    counts = chosen.mapInArrow(count, schema).groupBy("lang", "code").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "code")
    top = counts.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= size).orderBy("lang", "rank")
    by_language: dict[str, list[int]] = {}
    for row in top.collect():
        by_language.setdefault(row.lang, []).append(row.code)
    return Profiles(by_language, size)


def identify_language(docs: DataFrame, size: int = 400, rows: int = 1500, parts: int = 4, part: int = 2, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """key, held_out, lang_pred and score of every row.

    A null text or one without a letter gets `und` and 0, and so does every row if nothing can be learned. A null key
    is not held out; rows with a null key or language teach nothing. Repeated rows get the same result. Other columns are not
    read. An empty table gives an empty result.
    """
    model = fit_profiles(docs, size, rows, parts, part, key, text, lang)
    # By value, for workers that cannot import this package.
    shared, tag = docs.sparkSession.sparkContext.broadcast(cloudpickle.dumps(model)), uuid.uuid4().hex

    @F.pandas_udf("lang_pred string, score double")
    def predict(texts: pd.Series) -> pd.DataFrame:
        profiles, letters = kept("profiles", tag, lambda: pickle.loads(shared.value)), kept("letters", "all", _letters)
        return pd.DataFrame([profiles.nearest(grams(value, letters)) for value in texts], columns=["lang_pred", "score"])

    found = keyed_texts(docs, key, text).select("key", held_out(F.col("key"), parts, part).alias("held_out"), predict("text").alias("p"))
    return found.select(F.col("key").alias(key), "held_out", "p.lang_pred", "p.score")
