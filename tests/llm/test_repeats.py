"""Against a brute-force scan that remembers every string."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from evalspark.llm import repeats
from evalspark.llm.repeats import find_repeats, remove_repeats


def _brute(rows, length):
    """Expected (removed flags) per row; rows of one key and text do not repeat each other."""
    keyed = sorted(((repeats.NO_KEY if k is None else k), i, (t or "").encode()) for i, (k, t) in enumerate(rows))
    first, marks = {}, {}
    for k, i, text in keyed:
        for s in range(len(text) - length + 1):
            first.setdefault(text[s : s + length], (k, s))
            first[text[s : s + length]] = min(first[text[s : s + length]], (k, s))
    for k, i, text in keyed:
        flags = np.zeros(len(text), bool)
        for s in range(len(text) - length + 1):
            if first[text[s : s + length]] < (k, s):
                flags[s : s + length] = True
        marks[i] = flags
    return marks


def _expected(rows, length):
    out = []
    for i, flags in _brute(rows, length).items():
        text = (rows[i][1] or "").encode()
        spans = int(np.diff(np.concatenate(([0], flags.astype(int)))).clip(0).sum())
        kept = bytes(b for b, gone in zip(text, flags) if not gone)
        out.append((rows[i][0], len(text), int(flags.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def _texts(seed, n):
    rng = random.Random(seed)
    words = ["the", "straße", "of", "running", "élan", "a", "corpus", "日本", "window", "sort"]

    def say(k):
        return " ".join(rng.choices(words, k=k)) + rng.choice([".", "!", "\n"]) + str(rng.getrandbits(60))

    shared = [say(rng.randint(8, 60)) for _ in range(6)]
    texts = []
    for _ in range(n):
        parts = [say(rng.randint(0, 40)) for _ in range(rng.randint(1, 3))]
        if rng.random() < 0.6:
            parts.insert(rng.randrange(len(parts) + 1), rng.choice(shared))
        texts.append("".join(parts))
    texts += [texts[0], texts[1] + "x", "y" + texts[2], texts[3] * 3, "z" * 700, "z" * 99, "ab" * 300, None, "", "é" * 90]
    rng.shuffle(texts)
    return [(i * 3 % (len(texts) + 1), text) for i, text in enumerate(texts)]


@pytest.mark.parametrize(("seed", "length"), [(1, 100), (2, 100), (3, 24)])
def test_equals_brute_force(spark, monkeypatch, seed, length):
    rows = _texts(seed, 120)
    rows += [(None, rows[5][1]), (None, rows[6][1]), rows[7], (rows[8][0], "other text under the key " * 8)]
    frame = spark.createDataFrame([(*row, "clash") for row in rows], "doc_id long, text string, n_bytes string").repartition(3)
    assert sorted(map(tuple, find_repeats(frame, length).collect()), key=repr) == _expected(rows, length)


@pytest.mark.parametrize("limits", [{}, {"CROWD_IN_TASK": 3, "CROWD": 5}, {"CROWD_IN_TASK": 1, "CROWD": 1, "LONGEST_PHRASE": 9}, {"CROWD": 4}])
def test_small_segments_chunks_and_crowds(spark, monkeypatch, conf, limits):
    """The same with texts cut into many segments, tasks that settle in many chunks, small batches and crowds."""
    for name, value in ({"SEGMENT": 700, "CHUNK": 60} | limits).items():
        monkeypatch.setattr(repeats, name, value)
    conf({"spark.sql.execution.arrow.maxRecordsPerBatch": "7"})
    rows = _texts(4, 150)
    common = "a licence line that nearly everyone repeats, word by word, and which is longer than the limit of strings "
    rows += [(1000 + i, f"{i * 7919} {common}{i * 104729 % 1000} end") for i in range(200)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert sorted(map(tuple, find_repeats(frame, 100).collect()), key=repr) == _expected(rows, 100)


@pytest.mark.parametrize("key", [None, 7])
def test_texts_of_one_key_with_equal_checksum_bits_keep_their_bytes(spark, key):
    """A text that repeats, and others of its key whose crc32 ends in the same 16 bits and that repeat nothing."""
    rng = random.Random(9)
    first = "".join(rng.choices("abcdefgh ", k=250))
    bits, same = zlib.crc32(("prefix " + first).encode()) & 0xFFFF, []
    while len(same) < 3:
        text = "".join(rng.choices("qrstuvwxyz ", k=264))
        if zlib.crc32(text.encode()) & 0xFFFF == bits:
            same.append((key, text))
    rows = [(1, first), (key, "prefix " + first), *same]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, find_repeats(frame, 100).collect()), key=repr) == _expected(rows, 100)
    assert sorted(row.text for row in remove_repeats(frame, 100).collect()) == sorted([first, "prefix ", *[text for _, text in same]])


def test_removed_texts(spark):
    rows = _texts(5, 40)
    frame = spark.createDataFrame([(t, i, k) for i, (k, t) in enumerate(rows)], "text string, doc long, doc_id long")
    result = remove_repeats(frame, 100)
    assert result.columns == frame.columns
    marks = _brute(rows, 100)
    for row in result.collect():
        text = rows[row.doc][1]
        kept = None if text is None else bytes(b for b, gone in zip(text.encode(), marks[row.doc]) if not gone).decode(errors="ignore")
        assert row.text == kept


def test_empty_and_short_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert find_repeats(empty).collect() == [] and remove_repeats(empty).collect() == []
    short = spark.createDataFrame([(1, "short"), (2, "short"), (3, None)], "doc_id long, text string")
    assert [r.n_removed for r in find_repeats(short).collect()] == [0, 0, 0]
    with pytest.raises(ValueError):
        find_repeats(short, 3)
