"""Registered queries against plain versions of their methods: loops over rows, without tables, indexes or vectors."""

import math
import random
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from test_decontamination import _data
from tokenizers import Tokenizer

from evalspark.llm import queries
from evalspark.llm.decontamination import LEAKS, find_leaks, question_and_answer, words_of
from evalspark.llm.language import grams, profile, _letters
from evalspark.llm.quality import features, fit_additive

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def documents(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("*", F.xxhash64("doc_id").alias("turn")).collect()
    return {row.doc_id: row for row in rows}


def _remainder(key, parts):
    return zlib.crc32(str(key).encode()) % parts


# Decontamination by the registered rule

def plain_leaks(texts, items, rules=LEAKS):
    bags = {i: Counter(words_of(q or "") + words_of(a or "")) for i, (_, q, a) in enumerate(items)}
    used = [i for i, bag in bags.items() if bag]
    df = Counter(word for i in used for word in bags[i])
    mean = sum(sum(bags[i].values()) for i in used) / len(used)
    stride = max(sum(bags[i].values()) for i in used)

    def impact(word, i):
        n, length = bags[i][word], sum(bags[i].values())
        idf = math.log(1 + (len(used) - df[word] + 0.5) / (df[word] + 0.5))
        return idf * n * (rules.k1 + 1) / (n + rules.k1 * (1 - rules.b + rules.b * length / mean))

    def shingles(words, n):
        return {tuple(words[i:i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()

    def is_leak(i, passage):
        parts = [words_of(items[i][1] or ""), words_of(items[i][2] or "")]
        shares = []
        for part in parts:
            wanted = shingles(part, rules.shingle_words)
            held = set().union(*[shingles(passage, n) for n in {len(s) for s in wanted}]) if wanted else set()
            shares.append(len(wanted & held) / len(wanted) if wanted else 1.0)
        if shares[0] >= rules.question and shares[1] >= rules.answer:
            return True
        if any(len(set(part) & set(passage)) < rules.part_words * len(set(part)) for part in parts):
            return False
        whole = parts[0] + parts[1]
        # The longest shingle, up to five words, of which a changed word leaves the share of the whole item.
        n = max([n for n in range(2, rules.shingle_words + 1) if (len(whole) - n + 1 - n) >= rules.whole * (len(whole) - n + 1) - 1e-9], default=2)
        wanted = shingles(whole, n)
        return len(wanted & shingles(passage, n)) >= rules.whole * len(wanted) - 1e-9

    found = set()
    for key, text in texts:
        words = words_of(text or "")
        for start in range(0, max(1, len(words) - stride), stride):
            passage = words[start:start + 2 * stride]
            held = set(passage)
            for i in used:
                score = sum(impact(word, i) for word in bags[i] if word in held)
                if score >= rules.share * sum(impact(word, i) for word in bags[i]) - 1e-9 and is_leak(i, passage):
                    found.add((key, items[i][0]))
    return found


@pytest.mark.parametrize("seed", [1, 2])
def test_registered_rule_on_items_with_changed_words(spark, seed):
    texts, items = _data(seed)
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    frame = spark.createDataFrame(items, "item_id long, question string, answer string")
    found = find_leaks(docs, frame, F.col("question"), F.col("answer"), rules=LEAKS).collect()
    assert sorted({tuple(row[:2]) for row in found}, key=repr) == sorted(plain_leaks(texts, items), key=repr)


def test_op1(spark, documents):
    q, a = question_and_answer(F.col("text"))
    items = [tuple(row) for row in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", q, a).collect()]
    texts = [(key, row.text) for key, row in documents.items()]
    found = {(row.doc_id, row.item_id) for row in queries.op1_decontaminate(spark, SF).collect()}
    assert found and found == plain_leaks(texts, items)


# Packing

def test_op2(spark, documents):
    """Every id lies in one piece, pieces fill their sequences without a gap, and only whole powers of two are shorter than 4096."""
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids = {key: [*tokenizer.encode(row.text or "", add_special_tokens=False).ids, 2] for key, row in documents.items()}
    rows = queries.op2_pack(spark, SF).collect()
    covered, filled = {}, {}
    for row in rows:
        piece = ids[row.doc_id][row.start:row.start + row.length]
        assert len(piece) == row.length > 0 and row.doc_tokens == len(ids[row.doc_id])
        assert row.ids_crc32 == zlib.crc32(np.array(piece, "<u4").tobytes())
        covered.setdefault(row.doc_id, []).append((row.start, row.length))
        filled.setdefault(row.sequence_id, []).append((row.offset, row.length))
    for spans, size in [*((covered[key], len(ids[key])) for key in ids), *((spans, None) for spans in filled.values())]:
        at = 0
        for start, length in sorted(spans):
            assert start == at
            at += length
        assert at == size if size is not None else at == 4096 or at & (at - 1) == 0 and at < 4096
    total = sum(map(len, ids.values()))
    # As few sequences of 4096 as the tokens allow, but for what each task leaves over.
    assert sum(sum(n for _, n in spans) == 4096 for spans in filled.values()) >= total // 4096 - 8


# Language

def plain_grams(text):
    words = "".join(c if c.isalpha() else " " for c in text.lower()).split()
    if not words:
        return Counter()
    line = f" {' '.join(words)} "
    found = Counter(c for c in line if c != " ")
    found.update(line[i:i + 2] for i in range(len(line) - 1))
    found.update(line[i:i + 3] for i in range(len(line) - 2) if line[i + 1] != " ")
    return found


def _code(gram):
    code = 0
    for sign in gram:
        code = code << 21 | ord(sign)
    return code


def _top(counts, size=400):
    return sorted(counts, key=lambda gram: (-counts[gram], _code(gram)))[:size]


def test_grams_are_those_of_a_plain_reading():
    letters = _letters()
    for text in ("Don't stop, ÉTÉ 3x  yes", "a", " a  b ", "日本 and x", "", "12 !"):
        assert [int(code) for code in profile(grams(text, letters), 400)] == [_code(gram) for gram in _top(plain_grams(text))]


def test_op6(spark, documents):
    learned = {}
    for key, row in documents.items():
        if _remainder(key, 4) != 2 and row.lang is not None and row.text is not None:
            learned.setdefault(row.lang, Counter()).update(plain_grams(row.text))
    ranks = {lang: {gram: i for i, gram in enumerate(_top(counts))} for lang, counts in sorted(learned.items())}
    found = {row.doc_id: row for row in queries.op6_language(spark, SF).collect()}
    assert found.keys() == documents.keys()
    for key, row in documents.items():
        own = _top(plain_grams(row.text or ""))
        if not own:
            assert (found[key].lang_pred, found[key].score) == ("und", 0)
            continue
        distance = {lang: sum(abs(places[gram] - i) if gram in places else 400 for i, gram in enumerate(own)) for lang, places in ranks.items()}
        best = min(distance, key=lambda lang: (distance[lang], lang))
        assert found[key].lang_pred == best and found[key].held_out == (_remainder(key, 4) == 2)
        assert found[key].score == pytest.approx(1 - distance[best] / (400 * len(own)))


# Quality

def plain_additive(values, labels, rounds, pair_rounds, pairs, bins=32, pair_bins=8, leaves=3, rate=0.15, ridge=1.0, least=1.0):
    """Cyclic boosting row by row; returns the scores of the rows it learned from."""
    n, width = len(values), len(values[0])
    share = (sum(labels) + 0.5) / (n + 1)
    margin = [math.log(share / (1 - share))] * n

    def binned(count):
        edges = [sorted(set(np.quantile([row[i] for row in values], np.linspace(0, 1, count + 1)[1:-1]).tolist())) for i in range(width)]
        return [[sum(edge <= row[i] for edge in edges[i]) for row in values] for i in range(width)], [len(e) + 1 for e in edges]

    def gradients():
        p = [1 / (1 + math.exp(-m)) for m in margin]
        return [y - q for y, q in zip(labels, p)], [q * (1 - q) for q in p]

    def gain(g, h):
        return g * g / (h + ridge)

    at, sizes = binned(bins)
    for _ in range(rounds):
        for i in range(width):
            g, h = [0.0] * sizes[i], [0.0] * sizes[i]
            for k, (a, b) in enumerate(zip(*gradients())):
                g[at[i][k]] += a
                h[at[i][k]] += b
            spans = [(0, sizes[i])]
            while len(spans) < leaves:
                best = (1e-9, None)
                for a, b in spans:
                    for cut in range(a + 1, b):
                        left, right = (sum(g[a:cut]), sum(h[a:cut])), (sum(g[cut:b]), sum(h[cut:b]))
                        if min(left[1], right[1]) >= least:
                            won = gain(*left) + gain(*right) - gain(sum(g[a:b]), sum(h[a:b]))
                            if won > best[0] + 1e-12:
                                best = (won, (a, cut, b))
                if best[1] is None:
                    break
                a, cut, b = best[1]
                spans = [s for s in spans if s != (a, b)] + [(a, cut), (cut, b)]
            for a, b in spans:
                step = rate * sum(g[a:b]) / (sum(h[a:b]) + ridge)
                for k in range(n):
                    if a <= at[i][k] < b:
                        margin[k] += step
    at, sizes = binned(pair_bins)

    def quadrants(i, j):
        """The best four quadrants of a pair: their gain over none, and the step of every row."""
        g, h = gradients()
        best, steps = (-math.inf, None), None
        for x in range(1, sizes[i]):
            for y in range(1, sizes[j]):
                sums = {}
                for k in range(n):
                    cell = (at[i][k] < x, at[j][k] < y)
                    a, b = sums.get(cell, (0.0, 0.0))
                    sums[cell] = (a + g[k], b + h[k])
                won = sum(gain(*s) for s in sums.values())
                if won > best[0] + 1e-12:
                    best, steps = (won, (x, y)), sums
        if steps is None:
            return 0.0, [0.0] * n
        x, y = best[1]
        cells = [steps[at[i][k] < x, at[j][k] < y] for k in range(n)]
        return best[0] - gain(sum(g), sum(h)), [rate * a / (b + ridge) for a, b in cells]

    ranked = sorted(combinations(range(width), 2), key=lambda pair: (-quadrants(*pair)[0], pair))[:pairs]
    for _ in range(pair_rounds):
        for pair in ranked:
            margin = [m + s for m, s in zip(margin, quadrants(*pair)[1])]
    return [1 / (1 + math.exp(-m)) for m in margin]


@pytest.mark.parametrize("seed", [1, 2])
def test_additive_model(seed):
    draw = np.random.default_rng(seed)
    values = draw.random((90, 4)).round(2)
    labels = ((values[:, 0] > 0.5) ^ (values[:, 1] > 0.4) | (draw.random(90) < 0.1)).astype(float)
    options = {"rounds": 6, "pair_rounds": 3, "pairs": 2, "bins": 8, "pair_bins": 4}
    model = fit_additive(values, labels, **options)
    assert model.scores(values) == pytest.approx(plain_additive(values.tolist(), labels.tolist(), **options), abs=1e-9)


def test_op7(spark, documents):
    """Scores are those of a model fitted on all labelled rows that are not held out, on the features of whole texts."""
    labels = {row.doc_id: row.quality for row in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    rows = sorted((features(documents[key].text or ""), mark) for key, mark in labels.items() if key in documents and mark is not None and _remainder(key, 3) != 1)
    model = fit_additive(np.array([v for v, _ in rows], float), np.array([float(mark > 0) for _, mark in rows]))
    found = queries.op7_quality(spark, SF).collect()
    assert sorted(row.doc_id for row in found) == sorted(documents)
    for row in found:
        values = np.array([features(documents[row.doc_id].text or "")], float)
        assert row.score == pytest.approx(model.scores(values)[0], abs=1e-6) and row.predicted == int(row.score >= 0.5)
        assert row.held_out == (_remainder(row.doc_id, 3) == 1)


# Toxicity

MASK = (1 << 64) - 1
FIRST, SECOND, LAST = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xFF51AFD7ED558CCD  # fixed values of the hash


def plain_coordinates(text, bits=22):
    words = ["".join(c for c in chunk.lower() if c.isalnum()) for chunk in text.split()]
    words = [xxhash.xxh64_intdigest(word.encode()) >> 1 for word in words if word]
    mixed = words + [(a * FIRST + b * SECOND) & MASK for a, b in zip(words, words[1:])] + [(a * SECOND + b * LAST) & MASK for a, b in zip(words, words[2:])]
    return sorted({((m ^ (m >> 31)) * LAST & MASK) >> (64 - bits) for m in mixed})


def plain_ftrl(examples, alpha=2.0, beta=1.0, l1=3.0, l2=0.1, passes=4):
    z, n = {}, {}

    def weight(i):
        penalty = 0.0 if i == "constant" else l1
        value = z.get(i, 0.0)
        if abs(value) <= penalty:
            return 0.0
        return -(value - math.copysign(penalty, value)) / ((beta + math.sqrt(n.get(i, 0.0))) / alpha + l2)

    for _ in range(passes):
        for found, label in examples:
            at = [*found, "constant"]
            weights = [weight(i) for i in at]
            g = 1 / (1 + math.exp(-sum(weights))) - label
            for i, w in zip(at, weights):
                old = n.get(i, 0.0)
                z[i] = z.get(i, 0.0) + g - (math.sqrt(old + g * g) - math.sqrt(old)) / alpha * w
                n[i] = old + g * g
    return weight


def test_op9(spark, documents):
    labels = {row.doc_id: row.toxic for row in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    chosen = [(documents[key].turn, mark, documents[key].text or "") for key, mark in labels.items() if key in documents and mark is not None and _remainder(key, 4) != 2]
    weight = plain_ftrl([(plain_coordinates(text), float(mark > 0)) for _, mark, text in sorted(chosen)])
    found = queries.op9_toxicity(spark, SF).collect()
    assert sorted(row.doc_id for row in found) == sorted(documents)
    for row in found:
        margin = sum(weight(i) for i in [*plain_coordinates(documents[row.doc_id].text or ""), "constant"])
        assert row.score == pytest.approx(1 / (1 + math.exp(-margin)), abs=1e-9)
        assert row.predicted == int(row.score >= 0.3) and row.held_out == (_remainder(row.doc_id, 4) == 2)


def test_held_out_accuracy_on_many_long_and_odd_texts(spark):
    """Very long texts in the learners and the language model, beside ordinary ones."""
    draw = random.Random(2)
    words = {"en": ["the", "house", "and", "river", "of", "light"], "fr": ["le", "château", "et", "rivière", "du", "été"]}
    rows = [(i, " ".join(draw.choices(words[lang], k=30 if i % 50 else 60_000)), lang) for i in range(300) for lang in [draw.choice(["en", "fr"])]]
    docs = spark.createDataFrame([(*row, "s", 0) for row in rows], "doc_id long, text string, lang string, source string, n_chars long")
    from evalspark.llm.language import identify_language
    found = {row.doc_id: row.lang_pred for row in identify_language(docs).collect()}
    assert all(found[i] == lang for i, _, lang in rows)
