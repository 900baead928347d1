import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa

from evalspark.llm import spelling
from evalspark.llm.queries import op12_spelling
from evalspark.llm.spelling import CellTree, count_words, leaves_within, letter_counts, near_words, spelling_variants, upper_tree

SF = "/root/testdata/sf0.001"
RUN = re.compile("[A-Za-zÀ-ÿ]+")


def plain_words(rows, one_in=97):
    words = Counter()
    for key, text in rows:
        for run in RUN.findall(text or ""):
            word = "".join(c.lower() if c.isascii() else c for c in run)
            mark = zlib.crc32(f"{key}:{word}".encode())
            if mark % one_in == 0:
                at = mark % len(word)
                word = word[:at] + word[at + 1:]
            words[word] += 1
    return words


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def plain_variants(words, shortest=5, least=3):
    kept = {word: n for word, n in words.items() if len(word) >= shortest and n >= least}
    near = {word: [other for other in kept if one_edit(word, other)] for word in kept}
    form = {}
    for word, others in near.items():
        best = min(others, key=lambda w: (-kept[w], w), default=None)
        if best and kept[best] >= 2 * kept[word]:
            form[word] = best

    def root(word):
        while word in form:
            word = form[word]
        return word

    return {word: (form.get(word), root(word), n, len(near[word]), kept.get(form.get(word))) for word, n in kept.items()}


def as_rows(df):
    return {row.word: (row.form, row.root, row.n, row.n_near, row.form_n) for row in df.collect()}


def made_up_rows(seed, count, letters="abé"):
    draw = random.Random(seed)
    return [(i, " ".join("".join(draw.choice(letters) for _ in range(draw.randrange(4, 8))) for _ in range(120))) for i in range(count)]


def test_words_are_those_of_a_plain_reading(spark):
    rows = made_up_rows(1, 40, "aBcÀÿ×ß") + [
        (None, "Null Key"), (7, None), (8, ""), (9, "x" * 300 + " ünïcödé" + "a" * 70 + "é"), (9, "ends"), (10, "withé"), (11, "éstarts 漢字 don't ÀÁ😀bc"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for one_in in (1, 3, 97):
        expected = plain_words([("" if key is None else key, text) for key, text in rows], one_in)
        got = {row.word: row.n for row in count_words(docs, one_in=one_in, shortest=1).collect()}
        assert got == {word: n for word, n in expected.items() if word}


def test_a_task_splits_few_texts_at_once():
    """A worker holds arrays of several times the text that it splits, so a slice has 4 MB at most, or one text."""
    texts = ["a" * (1 << 20)] * 10 + ["b" * (5 << 20), "", "c"]
    batch = pa.RecordBatch.from_arrays([pa.array([str(i) for i in range(13)]), pa.array(texts)], names=["key", "text"])
    parts = [part.column(1).to_pylist() for part in spelling._slices(batch)]
    assert [text for part in parts for text in part] == texts
    assert all(sum(map(len, part)) <= 4 << 20 for part in parts if len(part) > 1)


def test_small_cells_find_what_all_pairs_find(spark):
    docs = spark.createDataFrame(made_up_rows(2, 60), "doc_id long, text string")
    expected = plain_variants(plain_words(docs.collect()))
    assert len(expected) > 300
    for cell_words in (1, 20, 8192):
        assert as_rows(spelling_variants(docs, cell_words=cell_words)) == expected


def test_cells_of_equal_letters_are_split_and_lose_no_link(spark):
    """All words are orders of the same letters, so that no letter count parts them, and their variants."""
    draw = random.Random(5)
    words = {"".join(draw.sample("abcdefg", 7)) for _ in range(300)}
    words |= {word[:3] + "z" + word[4:] for word in list(words)[:100]} | {word[1:] for word in list(words)[:100]}
    vocabulary = spark.createDataFrame([(word, i + 3) for i, word in enumerate(sorted(words))], "word string, n long")
    expected = {word: sum(one_edit(word, other) for other in words) for word in words}
    got = {row.word: row.n_near for row in near_words(vocabulary, cell_words=10).collect()}
    assert got == {word: n for word, n in expected.items() if n}


def test_the_tree_prunes():
    draw = random.Random(8)
    words = pa.array(sorted({"".join(draw.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(8)) for _ in range(4000)}))
    tree = CellTree(words, np.ones(len(words), np.int64), 8)
    queries = letter_counts(words, 8)
    hits = sum(len(rows) for rows, _ in tree.close(queries, 1))
    # Words of random letters are the hardest to part: under a third of all (word, node) pairs is looked at.
    assert hits and tree.visited < len(tree.nodes) * len(words) / 3


def test_leaves_within_reaches_every_leaf_that_a_change_leads_to():
    draw = np.random.default_rng(4)
    vectors = draw.integers(0, 3, (400, len(spelling.LETTERS))).astype(np.int8)
    tree = upper_tree(vectors, 12)
    own = {}
    for leaf, rows in leaves_within(tree, vectors, 0, 0):
        own |= {int(row): leaf for row in rows}
    assert len(own) == len(vectors)
    reached = {(int(row), leaf) for leaf, rows in leaves_within(tree, vectors, 1, 1) for row in rows}
    for row in range(0, 400, 7):
        for lost in draw.choice(90, 20):
            for won in draw.choice(90, 20):
                changed = vectors[row:row + 1].copy()
                changed[0, lost] -= 1
                changed[0, won] += 1
                (leaf, _), = leaves_within(tree, changed, 0, 0)
                assert lost == won or (row, leaf) in reached


def test_ties_go_to_the_least_word_and_chains_end_at_their_root(spark):
    counts = {"aaaaa": 100, "aaaab": 40, "aaabb": 16, "aabbb": 6, "ccccc": 3, "ccccd": 9, "cccce": 9, "fffff": 4, "ffffg": 7, "abcéÿ": 3}
    text = " ".join(word for word, n in counts.items() for _ in range(n))
    docs = spark.createDataFrame([(1, text, 5)], "doc_id long, text string, word long")
    got = as_rows(spelling_variants(docs, one_in=None))
    assert got == plain_variants(counts)
    assert got["aabbb"][:2] == ("aaabb", "aaaaa") and got["ccccc"][0] == "ccccd" and got["fffff"][0] is None


def test_empty_tables_and_texts(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert spelling_variants(docs).count() == 0
    assert spelling_variants(spark.createDataFrame([(1, None), (2, ""), (3, "abc abc abc")], "doc_id long, text string")).count() == 0
    assert as_rows(spelling_variants(spark.createDataFrame([(1, "alone " * 5)], "doc_id long, text string"))) == {"alone": (None, "alone", 5, 0, None)}


def test_query_against_all_pairs(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    expected = plain_words([(row.doc_id, row.text) for row in docs.collect()])
    got = as_rows(op12_spelling(spark, SF))
    kept = {word: n for word, n in expected.items() if len(word) >= 5 and n >= 3}
    assert {word: row[2] for word, row in got.items()} == kept
    some = sorted(kept)[::25]
    for word in some:
        near = [other for other in kept if one_edit(word, other)]
        assert got[word][3] == len(near)
        best = min(near, key=lambda w: (-kept[w], w), default=None)
        assert got[word][0] == (best if best and kept[best] >= 2 * kept[word] else None)
