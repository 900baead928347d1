"""Expressions against what Python and pandas say, on random texts."""

import math
import os
import random

import pandas as pd
from pyspark.sql import functions as F

from evalspark.functions import cleaning, files, text


def _texts(alphabet, count=3000, longest=12, seed=7):
    rng = random.Random(seed)
    return sorted({"".join(rng.choices(alphabet, k=rng.randint(0, longest))) for _ in range(count)})


def test_file_extension(column):
    names = _texts("ab./.")
    assert column(names, files.file_extension(F.col("a"))) == [os.path.splitext(name)[1] for name in names]


def test_base_name(column):
    names = [name + tail for name in _texts("ab./", 1500) for tail in ("", ".pdf", ".pdf.pdf")]
    assert column(names, files.base_name(F.col("a"))) == [
        os.path.basename(name).removesuffix(".pdf") for name in names
    ]


def test_coerce_int(column):
    numbers = [n for n in _texts("0123456789" + "+-..eE \t\n\xa0", 6000, 6) if "inf" not in n.lower()]

    def expected(value):
        number = pd.to_numeric(pd.Series([value]), errors="coerce").fillna(0).iloc[0]
        return int(number) if math.isfinite(number) and abs(number) < 2**31 else 0

    got = column(numbers, cleaning.coerce_int(F.col("a")))
    wrong = {n: (g, expected(n)) for n, g in zip(numbers, got) if g != expected(n)}
    assert not wrong


def test_strip_and_words(column):
    alphabet = "ab." + text.WHITESPACE + "\u200b\u180e"
    texts = _texts(alphabet, 3000, 10)
    assert column(texts, text.strip(F.col("a"))) == [t.strip() for t in texts]
    words = F.filter(F.split(text.strip(F.col("a")), text.WHITESPACE_RUN), lambda w: w != "")
    assert column(texts, words) == [t.split() for t in texts]
