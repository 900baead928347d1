"""Held-out accuracy on made labels, and the rows that carry no information."""

import random
import zlib

import numpy as np
import pytest

from evalspark.llm.language import Profiles, grams, identify_language, profile, _letters
from evalspark.llm.quality import FEATURES, classify_quality, features, fit_additive
from evalspark.llm.toxicity import Ftrl, Hasher, Learner, classify_toxicity, learn_weights

SYLLABLES = {"en": ["the", "ing", "tion", "er", "and", "sh"], "de": ["sch", "ung", "ein", "ver", "ich", "tz"], "es": ["ción", "que", "os", "ar", "ñ", "ía"]}


def _prose(rng, lang, words):
    return " ".join("".join(rng.choices(SYLLABLES[lang], k=rng.randint(1, 3))) for _ in range(words))


def _remainder(key, parts):
    return zlib.crc32(str(key).encode()) % parts


def test_additive_model_learns_pairs():
    rng = np.random.default_rng(1)
    values = rng.random((3000, 4))
    labels = ((values[:, 0] > 0.5) ^ (values[:, 1] > 0.5)).astype(float)
    model = fit_additive(values[:2000], labels[:2000], pairs=2)
    assert (0, 1) in model.pairs
    assert ((model.scores(values[2000:]) >= 0.5) == labels[2000:]).mean() > 0.9
    assert fit_additive(values[:0], labels[:0]).scores(values[:3]).tolist() == [0.5] * 3


def test_features_of_odd_texts():
    for text in ("", " \n\t", "one", "é" * 10, "a " * 50_000, "\x00", "\n\n\n"):
        assert len(features(text)) == len(FEATURES) and np.isfinite(features(text)).all()


def _labelled(rng, spoil):
    texts, marks = [], []
    for i in range(900):
        lang, bad = rng.choice(list(SYLLABLES)), rng.random() < 0.3
        text = _prose(rng, lang, rng.randint(20, 120))
        texts.append(spoil(rng, text) if bad else text)
        marks.append(int(bad))
    return texts, marks


def _odd_rows(texts):
    return [(5000, None), (5001, ""), (5002, "%%%"), (None, texts[0]), (0, texts[0])]


def test_quality(spark):
    rng = random.Random(1)
    texts, bad = _labelled(rng, lambda rng, text: text.replace(" ", "### ") if rng.random() < 0.5 else text.upper())
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(k, t, "x") for k, t in _odd_rows(texts)], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, 1 - b) for i, b in enumerate(bad)] + [(None, 1), (3, None), (99999, 0)], "doc_id long, quality int")
    found = classify_quality(docs, labels).collect()
    assert len(found) == len(texts) + 5 and all(0 <= row.score <= 1 and row.predicted == int(row.score >= 0.5) for row in found)
    assert all(row.held_out == (row.doc_id is not None and _remainder(row.doc_id, 3) == 1) for row in found)
    held = [row for row in found if row.held_out and row.doc_id < len(texts)]
    assert sum(row.predicted != bad[row.doc_id] for row in held) / len(held) > 0.95


def test_held_out_labels_are_not_learned(spark):
    rng = random.Random(2)
    texts, bad = _labelled(rng, lambda rng, text: text.upper())
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    true = spark.createDataFrame([(i, 1 - b) for i, b in enumerate(bad)], "doc_id long, quality int")
    false = spark.createDataFrame([(i, b if _remainder(i, 3) == 1 else 1 - b) for i, b in enumerate(bad)], "doc_id long, quality int")
    assert sorted(map(tuple, classify_quality(docs, true).collect())) == sorted(map(tuple, classify_quality(docs, false).collect()))


@pytest.mark.parametrize("classify", [classify_quality, classify_toxicity])
def test_without_labels_or_documents(spark, classify):
    docs = spark.createDataFrame([(1, "some text"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [row.score for row in classify(docs, none).collect()] == [0.5, 0.5]
    assert classify(docs.limit(0), none).collect() == []


def test_toxicity(spark):
    rng = random.Random(3)
    texts, bad = _labelled(rng, lambda rng, text: text + " " + rng.choice(["you Idiot!", "what a moron", "utter scum, really"]) + " " + _prose(rng, "en", 30))
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(k, t, "x") for k, t in _odd_rows(texts)], "doc_id long, text string, at string")
    labels = spark.createDataFrame([(i, b) for i, b in enumerate(bad)] + [(None, 1), (3, None), (99999, 0)], "doc_id long, toxic int")
    found = classify_toxicity(docs, labels, rule=Ftrl(bits=18)).collect()
    assert len(found) == len(texts) + 5 and all(0 <= row.score <= 1 and row.predicted == int(row.score >= 0.3) for row in found)
    held = [row for row in found if row.held_out and row.doc_id < len(texts)]
    assert sum(row.predicted == bad[row.doc_id] for row in held) / len(held) > 0.97


def test_ftrl_follows_its_update_rule():
    rule, rng = Ftrl(bits=4, alpha=0.5, beta=1.0, l1=0.1, l2=0.3), random.Random(4)
    learner, z, n = Learner(rule), [0.0] * 17, [0.0] * 17

    def weight(i):
        l1 = 0 if i == 16 else rule.l1
        return 0.0 if abs(z[i]) <= l1 else -(z[i] - (1 if z[i] > 0 else -1) * l1) / ((rule.beta + n[i] ** 0.5) / rule.alpha + rule.l2)

    for _ in range(200):
        at, label = sorted(rng.sample(range(16), 4)), float(rng.random() < 0.4)
        active = [*at, 16]
        weights = [weight(i) for i in active]
        g = 1 / (1 + np.exp(-sum(weights))) - label
        for i, w in zip(active, weights):
            z[i] += g - ((n[i] + g * g) ** 0.5 - n[i] ** 0.5) / rule.alpha * w
            n[i] += g * g
        learner.learn(np.array(at), label)
    assert np.allclose(learner.z, z) and np.allclose(learner.n, n)


def test_rare_features_get_no_weight():
    hasher = Hasher(16)
    examples = [(float(i % 2), hasher(f"only{i} {'bad' if i % 2 else 'good'}")) for i in range(100)]
    at, _ = learn_weights(examples, Ftrl(bits=16))
    assert set(hasher("bad")) <= set(at) and not set(hasher("only3")) & set(at)


def test_language(spark):
    rng = random.Random(5)
    rows = [(i, _prose(rng, lang, rng.randint(5, 80)), lang, "x") for i, lang in enumerate(rng.choices(list(SYLLABLES), k=400))]
    rows += [(900, None, "en", "x"), (901, "", "en", "x"), (902, "12 34 ...", "de", "x"), (903, rows[0][1], None, "x"), (None, rows[1][1], "xx", "x"), (0, rows[0][1], "en", "x")]
    found = identify_language(spark.createDataFrame(rows, "doc_id long, text string, lang string, score string"), size=100).collect()
    assert len(found) == len(rows) and all(0 <= row.score <= 1 for row in found)
    assert {row.lang_pred for row in found if row.doc_id in (900, 901, 902)} == {"und"}
    truth = {key: lang for key, _, lang, _ in rows[:400]}
    held = [row for row in found if row.held_out and row.doc_id in truth]
    assert all(row.held_out == (_remainder(row.doc_id, 4) == 2) for row in found if row.doc_id is not None)
    assert sum(row.lang_pred == truth[row.doc_id] for row in held) / len(held) > 0.95
    assert identify_language(spark.createDataFrame([], "doc_id long, text string, lang string")).collect() == []


def test_out_of_place_distance_by_hand():
    letters = _letters()
    texts = {"a": "aab aab abc", "b": "bba bba bca"}
    size = 12
    listed = {name: profile(grams(text, letters), size).tolist() for name, text in texts.items()}
    model = Profiles(listed, size)
    own = profile(grams("aab bca", letters), size).tolist()
    distance = {name: sum(abs(ranks.index(code) - i) if code in ranks else size for i, code in enumerate(own)) for name, ranks in listed.items()}
    best = min(sorted(distance), key=distance.get)
    assert model.nearest(grams("aab bca", letters)) == (best, 1 - distance[best] / (size * len(own)))


def test_grams_by_hand():
    codes = grams("Ab1 c", _letters()).tolist()
    signs = [" ", "a", "b", " ", "c", " "]
    expected = ["a", "b", "c", *["".join(p) for p in zip(signs, signs[1:])], *["".join(p) for p in zip(signs, signs[1:], signs[2:]) if p[1] != " "]]

    def code(gram):
        value = 0
        for sign in gram:
            value = value << 21 | ord(sign)
        return value

    assert sorted(codes) == sorted(map(code, expected))
