"""Round trips and limits."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer as Model

from evalspark.llm import packing
from evalspark.llm.packing import Example, Limits, Packer, Tokenizer, pack_documents, pack_examples

PATH = public_tokenizers.path("word_bpe_49k.json")


def _ids(text):
    return Model.from_file(PATH).encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("text", [
    "", " \n ", "It's 'S don't  stop", "<|endoftext|>x <|startoftext|>", "tab\tand\x1cmore\x85\xa0end", "ć ́x Ĺ", "İstanbul ΣΑΣ ß ŉ ǅ ſ",
    "12 ３ ªº²", "«a» ¿qué? naïve.", "soft\xadhyphen", "日本語 テキスト", "x" * 5000, "<|a|> < | >", "é ́e",
])
def test_tokenizer_gives_the_ids_of_the_whole_text(text):
    assert np.frombuffer(Tokenizer(PATH)(text), "<u4").tolist() == _ids(text)


def test_tokenizer_on_random_texts(monkeypatch):
    monkeypatch.setattr(packing, "CACHED", 5)
    rng, tokenize = random.Random(1), Tokenizer(PATH)
    for _ in range(300):
        text = "".join(rng.choices("aZéÜ'stİß.,!? \n\t12ŉǅ<|>́", k=30))
        assert np.frombuffer(tokenize(text), "<u4").tolist() == _ids(text)


def test_other_tokenizers_encode_whole_texts():
    path = public_tokenizers.path("byte_bpe_50k.json")
    text = "Some text,  with blanks\nand lines"
    assert np.frombuffer(Tokenizer(path)(text), "<u4").tolist() == Model.from_file(path).encode(text, add_special_tokens=False).ids


def _sequences(examples, limits, cut=True, pool=40):
    packer, made = Packer(limits, cut, pool), []
    for example in examples:
        made += packer.add(example)
    return made + list(packer.finish())


@pytest.mark.parametrize("limits", [Limits(64, 8, 64), Limits(64, 3, 40), Limits(4096, 64, 4096), Limits(1, 1, 1)])
def test_every_token_is_packed_once_within_the_limits(limits):
    rng = random.Random(2)
    examples = []
    for i in range(400):
        n = rng.randint(1, 3 * limits.tokens)
        marks = np.array([0, *rng.choices([0, 1], k=n)]).cumsum() if i % 2 else None
        examples.append(Example(i, bytes(4 * n), marks))
    covered = {}
    for pieces in _sequences(examples, limits):
        assert sum(end - start for _, start, end in pieces) <= limits.tokens and len(pieces) <= limits.segments
        assert sum(example.loss_in(start, end) for example, start, end in pieces) <= limits.loss
        for example, start, end in pieces:
            covered.setdefault(example.key, []).append((start, end))
    for example in examples:
        spans = sorted(covered[example.key])
        assert spans[0][0] == 0 and spans[-1][1] == example.size
        assert all(a[1] == b[0] for a, b in zip(spans, spans[1:]))


def test_little_padding():
    rng = random.Random(3)
    examples = [Example(i, bytes(4 * rng.randint(1, 3000))) for i in range(500)]
    sizes = [sum(end - start for _, start, end in pieces) for pieces in _sequences(examples, Limits())]
    assert all(size & (size - 1) == 0 for size in sizes)


def test_documents(spark):
    texts = ["one two three", None, "", "word " * 9000, "one two three", " \n", "it's ok"] + [f"text number {i} " * (i % 50) for i in range(200)]
    rows = [(i, text, i) for i, text in enumerate(texts)] + [(None, "no key", 1), (4, "again", 1)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, offset long").repartition(3)
    pieces = pack_documents(frame, PATH).collect()
    by_key, by_sequence = {}, {}
    for piece in pieces:
        by_key.setdefault((piece.doc_id, piece.doc_tokens), []).append(piece)
        by_sequence.setdefault(piece.sequence_id, []).append(piece)
    for key, text, _ in rows:
        ids = [*_ids(text or ""), 2]
        own = sorted((p.start, p.length, p.ids_crc32) for p in by_key[key, len(ids)])
        assert sum(n for _, n, _ in own) == len(ids)
        for start, n, crc in own:
            assert crc == zlib.crc32(np.array(ids[start : start + n], "<u4").tobytes())
    for own in by_sequence.values():
        at = 0
        for piece in sorted(own, key=lambda p: p.offset):
            assert piece.offset == at
            at += piece.length
        assert at <= 4096 and at & (at - 1) == 0


def test_examples_with_marks(spark):
    rows = [(1, [5] * 10, [False] * 6 + [True] * 4), (2, [6] * 4, [True] * 4), (3, [7] * 12, None), (4, None, None), (5, [], []), (6, [8] * 40, [True]), (None, [9], [None])]
    frame = spark.createDataFrame(rows, "id long, ids array<int>, loss array<boolean>").coalesce(1)
    pieces = pack_examples(frame, "id", "ids", "loss", Limits(16, 3, 6)).collect()
    assert {(p.id, p.start, p.length) for p in pieces if p.id in (1, 2, 3, None)} == {(1, 0, 10), (2, 0, 4), (3, 0, 12), (None, 0, 1)}
    assert sum(p.length for p in pieces if p.id == 6) == 40
    by_sequence = {}
    for p in pieces:
        by_sequence.setdefault(p.sequence_id, []).append(p)
    assert all(sum(p.length for p in own) <= 16 and sum(p.loss_tokens for p in own) <= 6 and len(own) <= 3 for own in by_sequence.values())


def test_empty_table(spark):
    assert pack_documents(spark.createDataFrame([], "doc_id long, text string"), PATH).collect() == []
    with pytest.raises(ValueError):
        Packer(Limits(0, 1, 1))
