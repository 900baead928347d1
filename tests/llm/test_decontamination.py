"""Against a brute-force BM25 over all passages and items."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from corpus_pipeline import without_test_items
from evalspark.llm import decontamination
from evalspark.llm.decontamination import LEAKS, ItemIndex, Rules, Searcher, decontaminate, find_leaks, question_and_answer, words_of
from evalspark.llm.queries import op1_decontaminate

RULES = Rules()


def _brute(texts, items, rules=RULES):
    bags = [Counter(words_of(q) + words_of(a)) for _, q, a in items]
    used = [i for i, bag in enumerate(bags) if bag]
    df = Counter(w for i in used for w in bags[i])
    mean = sum(sum(bags[i].values()) for i in used) / len(used)
    stride = max(sum(bags[i].values()) for i in used)

    def impact(word, i):
        n, length = bags[i][word], sum(bags[i].values())
        idf = math.log(1 + (len(used) - df[word] + 0.5) / (df[word] + 0.5))
        return idf * n * (rules.k1 + 1) / (n + rules.k1 * (1 - rules.b + rules.b * length / mean)) if n else 0.0

    def shingles(words, n):
        return {tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()

    found = set()
    for key, text in texts:
        words = words_of(text)
        for start in range(0, max(1, len(words) - stride), stride):
            passage = words[start : start + 2 * stride]
            for i in used:
                own = sum(impact(w, i) for w in bags[i])
                if sum(impact(w, i) for w in set(passage)) < rules.share * own - 1e-9:
                    continue
                parts = [shingles(words_of(part), rules.shingle_words) for part in items[i][1:]]
                shares = [len([s for s in part if s in shingles(passage, len(s))]) / len(part) if part else 1.0 for part in parts]
                if shares[0] >= rules.question and shares[1] >= rules.answer:
                    found.add((key, items[i][0]))
    return found


def _data(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(120)]

    def say(low, high):
        return " ".join(rng.choices(vocabulary, [1 / (i + 1) for i in range(120)], k=rng.randint(low, high)))

    items = [(i, say(4, 30), say(0, 6)) for i in range(60)] + [(60, None, None), (61, "!!", ""), (62, "one", ""), (None, "null key item with words", "and answer")]
    texts = []
    for i in range(120):
        text = say(0, 200)
        if i % 3 == 0:
            _, q, a = rng.choice(items[:60])
            inserted = f"{q} {a}".split()
            if i % 2:
                inserted[rng.randrange(len(inserted))] = "CHANGED"
            text = f"{text} {' '.join(inserted).upper()}, {say(0, 60)}"
        texts.append((i, text))
    texts += [(500, None), (501, ""), (502, "-- ..."), (None, f"{items[3][1]} {items[3][2]}"), (0, texts[0][1]), (503, " ".join(t for _, t in texts))]
    return texts, items


@pytest.mark.parametrize("seed", [1, 2])
def test_search_equals_brute_force(seed):
    texts, items = _data(seed)
    index = ItemIndex([(k, q or "", a or "") for k, q, a in items], RULES)
    search = Searcher(index)
    found = {(key, index.keys[i]) for key, text in texts for i in search(text or "")}
    expected = _brute(texts, items)
    assert found == expected and len(found) > 30


def test_parts_of_the_index_give_the_same(spark):
    texts, items = _data(3)
    docs = spark.createDataFrame([(k, t, "clash") for k, t in texts], "doc_id long, text string, item_id string")
    frame = spark.createDataFrame(items, "item_id long, question string, answer string")
    whole = [tuple(r) for r in find_leaks(docs, frame, F.col("question"), F.col("answer")).collect()]
    parts = [tuple(r) for r in find_leaks(docs, frame, F.col("question"), F.col("answer"), index_bytes=1500).collect()]
    assert sorted({r[:2] for r in whole}, key=repr) == sorted(_brute(texts, items), key=repr)
    assert sorted({r[:2] for r in parts}, key=repr) == sorted({r[:2] for r in whole}, key=repr)
    clean = decontaminate(docs, frame, F.col("question"), F.col("answer"))
    assert clean.columns == docs.columns
    leaking = {r[0] for r in whole}
    assert sorted((r.doc_id for r in clean.collect()), key=repr) == sorted((k for k, _ in texts if k not in leaking), key=repr)


def _rounded(df):
    return sorted((*row[:3], *[round(value, 9) for value in row[3:]]) for row in df.collect())


def test_a_long_item_in_another_part_changes_nothing(spark):
    """A leak whose question and answer lie 30 words apart, beside an item of 120 words."""
    def say(start, n):
        return " ".join(f"word{start + i}" for i in range(n))

    items = [(1, say(0, 9), say(20, 6)), (2, say(100, 100), say(300, 20)), *[(10 + i, say(1000 * i + 500, 8), say(1000 * i + 600, 5)) for i in range(20)]]
    texts = [(1, f"{say(90000, 40)} {items[0][1]} {say(91000, 30)} {items[0][2]} {say(92000, 50)}"), (2, f"{items[1][1]} {items[1][2]}"), (3, say(95000, 300))]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    frame = spark.createDataFrame(items, "item_id long, question string, answer string")
    for rules in (Rules(), LEAKS):
        expected = _rounded(find_leaks(docs, frame, F.col("question"), F.col("answer"), rules=rules))
        assert [row[:2] for row in expected] == [(1, 1), (2, 2)]
        for index_bytes in (2000, 700):
            found = find_leaks(docs, frame, F.col("question"), F.col("answer"), rules=rules, index_bytes=index_bytes)
            assert _rounded(found) == expected


def test_rows_are_judged_by_their_own_text(spark):
    """Null and repeated keys, and columns named like those the operator uses."""
    leak, clean = "what is the tallest mountain of the island then it is mount ararat of the north", "a text with words of its own and nothing else in it"
    schema = "doc_id long, text string, leaking string, mark long, row int"
    docs = spark.createDataFrame([(None, leak, "a", 1, 1), (None, clean, "b", 2, 2), (1, leak, "c", 3, 3), (1, clean, "d", 4, 4), (2, None, "e", 5, 5)], schema)
    items = spark.createDataFrame([(1, leak)], "item_id long, text string")
    kept = decontaminate(docs, items, *question_and_answer(F.col("text")), rules=LEAKS)
    assert kept.columns == docs.columns and sorted(row.leaking for row in kept.collect()) == ["b", "d", "e"]


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "some text")], "doc_id long, text string")
    items = spark.createDataFrame([], "item_id long, text string")
    assert find_leaks(docs, items, *question_and_answer(F.col("text"))).collect() == []
    assert find_leaks(docs.limit(0), items, *question_and_answer(F.col("text"))).collect() == []
    assert decontaminate(docs, items, *question_and_answer(F.col("text"))).count() == 1


def test_question_and_answer(spark):
    rows = spark.createDataFrame([("a b c d e f g h",), (" one ",), (None,), ("",)], "text string")
    q, a = question_and_answer(F.col("text"))
    assert [tuple(r) for r in rows.select(q, a).collect()] == [("a b c d e f", "g h"), ("", "one"), (None, None), ("", "")]


@pytest.mark.parametrize(("name", "value"), [("MOST_MAXIMA", 200), ("MOST_BLOCKS", 2), ("BLOCK_ITEMS", 1), ("POSITIONS_AT_ONCE", 1)])
def test_any_block_size_finds_the_same(monkeypatch, name, value):
    texts, items = _data(4)
    monkeypatch.setattr(decontamination, name, value)
    index = ItemIndex([(k, q or "", a or "") for k, q, a in items], RULES)
    search = Searcher(index)
    assert {(key, index.keys[i]) for key, text in texts for i in search(text or "")} == _brute(texts, items)


def _items_of_one_text(seed):
    rng = random.Random(seed)
    return [" ".join(f"w{rng.randrange(1500)}" for _ in range(n)) for n in range(11, 60)]


def _changed_everywhere(texts):
    """(item, text with one other word) for every word of every item."""
    for item, text in enumerate(texts):
        words = text.split()
        for place in range(len(words)):
            yield item, " ".join([*words[:place], "CHANGED", *words[place + 1 :]])


def test_one_changed_word_at_any_place_is_found(spark, tmp_path):
    texts = _items_of_one_text(5)
    changed = [(i, item, f"before {text} after") for i, (item, text) in enumerate(_changed_everywhere(texts))]
    docs = spark.createDataFrame([(i, text) for i, _, text in changed] + [(-1, "nothing of the kind")], "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(enumerate(texts)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    found = {(r.doc_id, r.item_id) for r in op1_decontaminate(spark, str(tmp_path)).collect()}
    assert found == {(i, item) for i, item, _ in changed}
    assert [r.doc_id for r in without_test_items(spark, docs, str(tmp_path)).collect()] == [-1]


def test_whole_item_rule_adds_to_the_rule_of_the_parts():
    texts, items = _data(6)
    listed = [(k, q or "", a or "") for k, q, a in items]
    parts, whole = ({(key, index.keys[i]) for key, text in texts for i in Searcher(index)(text or "")} for index in (ItemIndex(listed, RULES), ItemIndex(listed, LEAKS)))
    assert parts < whole


def test_half_an_item_or_its_words_in_another_order_are_no_leak():
    texts = _items_of_one_text(7)
    items = [(i, " ".join(words[: len(words) * 3 // 4]), " ".join(words[len(words) * 3 // 4 :])) for i, words in enumerate(text.split() for text in texts)]
    search = Searcher(ItemIndex(items, LEAKS))
    rng = random.Random(8)
    for text, (_, question, answer) in zip(texts, items):
        words = text.split()
        rng.shuffle(words)
        assert not search(question) and not search(answer) and not search(" ".join(words))
    # An answer too short to be missed among the shingles of the whole item.
    question = " ".join(f"q{i}" for i in range(40))
    search = Searcher(ItemIndex([(0, question, "yes indeed")], LEAKS))
    assert search(f"{question} yes indeed") and search(f"{question} yes changed") and not search(f"{question} no never")
