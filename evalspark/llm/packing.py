"""Vector bin packing of token sequences.

Every sequence has three limits: tokens, segments (pieces of examples) and loss-bearing tokens. Each task packs the
examples of its own partition. It keeps a bounded pool of waiting examples and fills one sequence after the other:
the next piece is the one whose vector (tokens, segments, loss, each as a share of its limit) has the largest dot
product with what is left of the open sequence. When no whole example fits, one is cut at what is left. What remains
in the end is cut into sequences whose lengths are powers of two, so they need no padding.

Nothing is shuffled, and a task that is run again makes the same sequences of the same partition.
"""

import json
import os
import re
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evalspark.llm.common import BATCH_ROWS, arrow_schema, batches_of, kept, keyed_texts, texts_of

POOL = 768
POOL_TOKENS = 8_000_000
CACHED = 400_000
LONGEST_CACHED = 48
#: Printable Latin signs that normalisation leaves alone but for their case.
PLAIN = re.compile("[!-~\u00a1-\u024f]*")


@dataclass(frozen=True)
class Limits:
    """Most tokens, pieces and loss-bearing tokens of one sequence."""

    tokens: int = 4096
    segments: int = 64
    loss: int = 4096


@dataclass
class Example:
    """Ids as little-endian bytes; `loss` counts the loss-bearing tokens before each position (None: all bear loss)."""

    key: object
    ids: bytes
    loss: np.ndarray | None = None
    start: int = 0

    @property
    def size(self) -> int:
        return len(self.ids) // 4

    def loss_in(self, start: int, end: int) -> int:
        return end - start if self.loss is None else int(self.loss[end] - self.loss[start])

    def fitting_end(self, tokens: int, loss: int) -> int:
        """The last end of a piece from `start` that keeps within both limits."""
        end = min(self.size, self.start + tokens)
        if self.loss is None:
            return min(end, self.start + loss)
        return min(end, int(np.searchsorted(self.loss, self.loss[self.start] + loss, side="right")) - 1)


Piece = tuple[Example, int, int]


class Packer:
    """Packs examples as they come; `add` and `finish` yield finished sequences as lists of pieces."""

    def __init__(self, limits: Limits, cut: bool = True, pool: int = POOL):
        if min(limits.tokens, limits.segments, limits.loss) < 1:
            raise ValueError("every limit must be at least 1")
        self.limits, self.cut, self.pool = limits, cut, pool
        self.waiting: list[Example] = []
        self.tokens = np.zeros(0, np.int64)
        self.loss = np.zeros(0, np.int64)
        self.held = 0

    def add(self, example: Example) -> Iterator[list[Piece]]:
        yield from self._whole_sequences(example)
        if example.start == example.size:
            return
        self._wait(example)
        while len(self.waiting) >= self.pool or self.held > POOL_TOKENS:
            yield from self._fill()

    def finish(self) -> Iterator[list[Piece]]:
        while self.waiting:
            yield from self._fill()

    def _whole_sequences(self, example: Example) -> Iterator[list[Piece]]:
        """Cut off pieces that fill a sequence alone; uncuttable examples only where no sequence holds them."""
        limits = self.limits
        while True:
            end = example.fitting_end(limits.tokens, limits.loss)
            if end == example.size and (end - example.start < limits.tokens):
                return
            if end == example.start:
                raise ValueError("no token fits")
            yield from self._closed([(example, example.start, end)])
            example.start = end
            if end == example.size:
                return

    def _wait(self, example: Example) -> None:
        i = len(self.waiting)
        if i >= len(self.tokens):
            self.tokens, self.loss = np.resize(self.tokens, 2 * i + 64), np.resize(self.loss, 2 * i + 64)
        self.waiting.append(example)
        self._measure(i)
        self.held += self.tokens[i]

    def _measure(self, i: int) -> None:
        example = self.waiting[i]
        self.tokens[i] = example.size - example.start
        self.loss[i] = example.loss_in(example.start, example.size)

    def _leave(self, i: int) -> None:
        last = len(self.waiting) - 1
        self.waiting[i], self.tokens[i], self.loss[i] = self.waiting[last], self.tokens[last], self.loss[last]
        self.waiting.pop()

    def _fill(self) -> Iterator[list[Piece]]:
        """One sequence out of the pool."""
        limits, pieces = self.limits, []
        tokens, segments, loss = limits.tokens, limits.segments, limits.loss
        while self.waiting and tokens and segments:
            n = len(self.waiting)
            sizes, bearing = self.tokens[:n], self.loss[:n]
            # The segment term is the same for every example, so it cannot change which one is best.
            score = sizes * (tokens / limits.tokens**2) + bearing * (loss / limits.loss**2)
            score[(sizes > tokens) | (bearing > loss)] = -1.0
            i = int(score.argmax())
            example = self.waiting[i]
            if score[i] >= 0:
                end = example.size
            elif not self.cut:
                break
            else:
                i = int(sizes.argmax())
                example = self.waiting[i]
                end = example.fitting_end(tokens, loss)
                if end == example.start:
                    break
            pieces.append((example, example.start, end))
            tokens, segments, loss = tokens - (end - example.start), segments - 1, loss - example.loss_in(example.start, end)
            self.held -= end - example.start
            example.start = end
            if end == example.size:
                self._leave(i)
            else:
                self._measure(i)
        yield from self._closed(pieces)

    def _closed(self, pieces: list[Piece]) -> Iterator[list[Piece]]:
        """The sequence itself, or its parts of power-of-two lengths if it would need padding."""
        left = sum(end - start for _, start, end in pieces)
        if not self.cut or left == self.limits.tokens:
            yield pieces
            return
        part, room = [], 1 << (left.bit_length() - 1)
        for example, start, end in pieces:
            while start < end:
                stop = min(end, start + room)
                part.append((example, start, stop))
                room, left, start = room - (stop - start), left - (stop - start), stop
                if not room:
                    yield part
                    part, room = [], 1 << (left.bit_length() - 1) if left else 0


class Tokenizer:
    """Ids of whole texts, as little-endian bytes, for tokenizers that drop white space and split words before merging.

    No such token spans a blank or a line end, so the ids of a text are those of its chunks, and those of a chunk of
    plain Latin letters and signs are those of its words. Chunks and words seen before come from bounded tables; any
    other chunk goes through the tokenizer itself.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer as Model

        self.model = Model.from_file(path)
        self.word_pattern = self._word_pattern(path)
        self.chunks: dict[str, bytes] = {"": b""}
        self.words: dict[str, bytes] = {}
        self.signs = str.maketrans(dict(enumerate(_byte_signs())))

    @staticmethod
    def _word_pattern(path: str):
        """How the tokenizer splits normal text into words; None if it does not work by words."""
        import regex

        with open(path, encoding="utf-8") as file:
            parts = json.load(file)
        steps = (parts.get("normalizer") or {}).get("normalizers", [])
        splits = (parts.get("pre_tokenizer") or {}).get("pretokenizers", [])
        if [step["type"] for step in steps] == ["NFC", "Replace", "Lowercase"] and [step["type"] for step in splits] == ["Split", "ByteLevel"]:
            return regex.compile(splits[0]["pattern"]["Regex"])
        return None

    def __call__(self, text: str) -> bytes:
        if self.word_pattern is None:
            return self._encoded(text)
        chunks = text.replace("\n", " ").split(" ")
        ids = list(map(self.chunks.get, chunks))
        if None in ids:
            learn, known = self._learn, self.chunks.get
            ids = [known(chunk) or learn(chunk) if found is None else found for chunk, found in zip(chunks, ids)]
        return b"".join(ids)

    def _learn(self, chunk: str) -> bytes:
        if len(self.chunks) > CACHED:
            self.chunks.clear()
            self.chunks[""] = b""
        plain = chunk.lower()
        if plain.isalpha() and plain.isascii():
            ids = self._word(plain)
        elif PLAIN.fullmatch(plain) and "<|" not in plain:
            ids = b"".join([self.words.get(word) or self._word(word) for word in self.word_pattern.findall(plain)])
        else:
            ids = self._encoded(chunk)
        if len(chunk) <= LONGEST_CACHED:
            self.chunks[chunk] = ids
        return ids

    def _word(self, word: str) -> bytes:
        ids = self.words.get(word)
        if ids is None:
            if len(self.words) > CACHED:
                self.words.clear()
            signs = word if word.isascii() else word.encode().decode("latin-1").translate(self.signs)
            tokens = self.model.model.tokenize(signs)
            ids = b"".join([token.id.to_bytes(4, "little") for token in tokens])
            if len(word) <= LONGEST_CACHED:
                self.words[word] = ids
        return ids

    def _encoded(self, text: str) -> bytes:
        return np.array(self.model.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def _byte_signs() -> list[str]:
    """The printable sign that stands for each byte: itself where it is one, else the next ones from U+0100."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return [chr(byte) if byte in printable else chr(next(others)) for byte in range(256)]


def _pieces_schema(key: T.DataType) -> T.StructType:
    longs = ["start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "loss_tokens"]
    return T.StructType([T.StructField("key", key), *[T.StructField(name, T.LongType()) for name in longs]])


def _packed(frame: DataFrame, examples: Callable[[], Callable[[pa.RecordBatch], Iterator[Example]]], limits: Limits, cut: bool) -> DataFrame:
    schema = _pieces_schema(frame.schema["key"].dataType)
    arrow = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read, packer = examples(), Packer(limits, cut)
        sequence = TaskContext.get().partitionId() << 36
        rows: dict[str, list] = {name: [] for name in arrow.names}

        def put(pieces: list[Piece]) -> None:
            nonlocal sequence
            offset = 0
            for example, start, end in pieces:
                values = (example.key, start, end - start, zlib.crc32(example.ids[4 * start : 4 * end]), example.size,
                          sequence, offset, example.loss_in(start, end))
                for name, value in zip(arrow.names, values):
                    rows[name].append(value)
                offset += end - start
            sequence += 1

        def made() -> Iterator[pa.RecordBatch]:
            yield from batches_of(rows, arrow)
            for values in rows.values():
                values.clear()

        for batch in batches:
            for example in read(batch):
                for pieces in packer.add(example):
                    put(pieces)
            if len(rows["key"]) >= BATCH_ROWS:
                yield from made()
        for pieces in packer.finish():
            put(pieces)
        yield from made()

    return frame.mapInArrow(run, schema)


def pack_documents(docs: DataFrame, tokenizer_path: str, end_id: int = 2, limits: Limits = Limits(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """Tokenise whole texts, end each with `end_id` and pack them. Every token bears loss.

    Returns one row per piece: key, start, length, ids_crc32, doc_tokens, sequence_id, offset, loss_tokens. A null
    text is an empty one and gives one piece with `end_id` alone. Rows with the same key are packed each for itself; a
    null key stays null. Columns other than key and text are not read. `tokenizer_path` names a file on the executors.
    """
    ending = np.array([end_id], "<u4").tobytes()

    def examples():
        tokenize = kept("tokenizer", tokenizer_path, lambda: Tokenizer(tokenizer_path))

        def read(batch):
            for key_value, value in zip(batch.column(0).to_pylist(), texts_of(batch)):
                yield Example(key_value, tokenize(value) + ending)

        return read

    return _packed(keyed_texts(docs, key, text), examples, limits, True).withColumnRenamed("key", key)


def pack_examples(df: DataFrame, key: str, ids: str, loss: str, limits: Limits = Limits(), cut: bool = False) -> DataFrame:
    """Pack tokenised instruction examples: `ids` array<int>, `loss` array<boolean> (true: the token bears loss).

    Returns what `pack_documents` returns. Examples stay whole unless `cut`; one that no sequence could hold is cut in
    any case. Missing marks (null array, null element or too few) bear no loss. Null or empty ids give no piece.
    """
    frame = df.select(F.col(key).alias("key"), F.col(ids).cast("array<int>").alias("ids"), F.col(loss).alias("loss"))

    def examples():
        def read(batch):
            for key_value, tokens, marks in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if tokens:
                    bearing = np.zeros(len(tokens) + 1, np.int64)
                    flags = [bool(mark) for mark in marks or []][: len(tokens)]
                    bearing[1 : len(flags) + 1] = flags
                    yield Example(key_value, np.array(tokens, "<u4").tobytes(), bearing.cumsum())

        return read

    return _packed(frame, examples, limits, cut).withColumnRenamed("key", key)
