"""Spelling variants: words one edit apart, found with k-d trees over letter counts.

A word is a vector of counts, one for each letter. One edit changes the vector by at most two: a replaced letter takes
one from a count and adds one to another, a deleted letter takes one from a count. So the words near a given one lie in
a small box of the vectors of its own length, or of one letter less; a k-d tree over these vectors prunes all branches
whose box lies further away, and only the words whose letters differ by such a change have their order verified.

The upper part of the trees deals the words to cells of bounded size, one tree for each length. It is fitted on a
bounded sample of the words; every word is indexed in one cell and sent to all cells that its boxes touch. A cell
builds its own tree over the vectors it got and answers one batch of words after the other.
"""

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evalspark.llm.common import arrow_schema
from evalspark.staging import stage

# Letters: a to z, then U+00C0 to U+00FF, each of which is 0xC3 and one more byte in UTF-8.
LETTERS = [chr(c) for c in range(ord("a"), ord("z") + 1)] + [chr(c) for c in range(0xC0, 0x100)]
LEAD = 0xC3

SLICE_BYTES = 4 << 20  # text that is split into words at once
TABLE_BYTES = 64  # longest word whose checksum is composed of tables
LEAF = 32  # letter vectors in a leaf of a cell's tree
QUERIES = 4_096  # words searched at once
SAMPLE = 65_536  # words that the upper trees are fitted on

WORDS = T.StructType([T.StructField("word", T.StringType()), T.StructField("n", T.LongType())])
ROUTED = T.StructType([
    T.StructField("cell", T.LongType()), T.StructField("salt", T.IntegerType()), T.StructField("role", T.IntegerType()),
    *WORDS.fields,
])
FOUND = T.StructType([
    T.StructField("word", T.StringType()), T.StructField("links", T.LongType()), T.StructField("best_n", T.LongType()),
    T.StructField("best", T.StringType()),
])

# Roles of the rows of a cell: words that it holds, and words that look for others there.
HELD, OWN, SAME_LENGTH, LONGER = range(4)


# Words of texts

def _crc_table() -> np.ndarray:
    """What a checksum becomes by eight zero bits, for each value of its low byte."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1)
    return table


def words_of_texts(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The maximal runs of letters of all texts, A to Z lower-cased, and how many each text has."""
    offsets = np.frombuffer(texts.buffers()[1], np.int64 if pa.types.is_large_string(texts.type) else np.int32)
    offsets = offsets[texts.offset:texts.offset + len(texts) + 1].astype(np.int64)
    buffer = texts.buffers()[2]
    data = np.frombuffer(buffer, np.uint8)[offsets[0]:offsets[-1]] if buffer is not None else np.empty(0, np.uint8)
    offsets = offsets - offsets[0]
    if not len(data):
        return pa.array([], pa.string()), np.zeros(len(texts), np.int64)
    low = np.where((data >= 65) & (data <= 90), data | 32, data)
    lead = data == LEAD
    letter = ((low >= 97) & (low <= 122)) | lead
    letter[1:] |= lead[:-1]
    first = letter.copy()
    first[1:] &= ~letter[:-1]
    begins = offsets[:-1][offsets[:-1] < len(data)]
    first[begins] = letter[begins]
    starts = np.flatnonzero(first)
    run_offsets = np.append(np.flatnonzero(first[letter]), np.count_nonzero(letter)).astype(np.int32)
    runs = pa.StringArray.from_buffers(len(starts), pa.py_buffer(run_offsets), pa.py_buffer(low[letter]))
    return runs, np.diff(np.searchsorted(starts, offsets))


def _byte_lengths(words: pa.Array) -> np.ndarray:
    return np.diff(np.frombuffer(words.buffers()[1], np.int32)[words.offset:words.offset + len(words) + 1])


def damaged_counts(texts: pa.Array, keys: list[str], one_in: int | None) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """Words of some texts with their counts, in two parts: as they are, and with a letter deleted.

    crc32 of "key:word" is composed: the checksum of "key:" moved on by the length of the word, and that of the word.
    """
    runs, per_text = words_of_texts(texts)
    if not len(runs):
        return
    encoded = runs.dictionary_encode()
    codes, words = encoded.indices.to_numpy(), encoded.dictionary
    if one_in is None:
        yield words, np.bincount(codes, minlength=len(words))
        return
    own = np.fromiter((zlib.crc32(word) for word in words.cast(pa.binary()).to_pylist()), np.uint32, len(words))
    sizes = _byte_lengths(words)
    table, moved = _crc_table(), [np.fromiter((zlib.crc32(f"{key}:".encode()) for key in keys), np.uint32, len(keys))]
    for _ in range(min(int(sizes.max()), TABLE_BYTES)):
        moved.append((moved[-1] >> np.uint32(8)) ^ table[moved[-1] & np.uint32(255)])
    moved = np.stack(moved)
    text_of = np.repeat(np.arange(len(keys)), per_text)
    marks = moved[np.minimum(sizes, TABLE_BYTES)[codes], text_of] ^ own[codes]
    for at in np.flatnonzero(sizes[codes] > TABLE_BYTES):
        marks[at] = zlib.crc32(words[int(codes[at])].as_py().encode(), int(moved[0, text_of[at]]))
    hit = marks % np.uint32(one_in) == 0
    whole = np.bincount(codes[~hit], minlength=len(words))
    there = np.flatnonzero(whole)
    yield words.take(pa.array(there)), whole[there]
    losing, again = np.unique(codes[hit], return_inverse=True)
    if not len(losing):
        return
    texts_of = words.take(pa.array(losing)).to_pylist()
    lengths = np.fromiter(map(len, texts_of), np.int64, len(texts_of))
    places = marks[hit].astype(np.int64) % lengths[again]
    pairs, times = np.unique(np.stack([again, places]), axis=1, return_counts=True)
    yield pa.array([texts_of[word][:at] + texts_of[word][at + 1:] for word, at in pairs.T.tolist()], pa.string()), times


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Runs of rows with a bounded amount of text, at least one row each."""
    sizes = pc.binary_length(batch.column(1)).to_numpy(zero_copy_only=False)
    start, held = 0, 0
    for at, size in enumerate(sizes):
        if held and held + size > SLICE_BYTES:
            yield batch.slice(start, at - start)
            start, held = at, 0
        held += int(size)
    if start < batch.num_rows:
        yield batch.slice(start)


def count_words(docs: DataFrame, key: str = "doc_id", text: str = "text", one_in: int | None = 97, shortest: int = 5) -> DataFrame:
    """(word, n): the runs of letters of all texts with at least `shortest` letters, and how often they occur.

    Only A to Z are lower-cased. Where `one_in` divides crc32 of "key:word", the letter at that checksum modulo the
    length is deleted from each of the word's places in the row. A null text has no words, a null key is the empty text.
    """
    schema = arrow_schema(WORDS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _slices(batch):
                for words, counts in damaged_counts(part.column(1), part.column(0).to_pylist(), one_in):
                    long_enough = pc.greater_equal(pc.utf8_length(words), shortest)
                    rows = pa.RecordBatch.from_arrays([words, pa.array(counts, pa.int64())], schema=schema)
                    yield from pa.Table.from_batches([rows.filter(long_enough)], schema).to_batches(50_000)

    key_text = F.coalesce(F.col(key).cast("string"), F.lit(""))
    rows = docs.select(key_text.alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return rows.mapInArrow(run, WORDS).groupBy("word").agg(F.sum("n").alias("n"))


# Letter counts and trees

def letter_counts(words: pa.Array, length: int) -> np.ndarray:
    """One row of counts for each word; all words have `length` letters."""
    kind = np.int8 if length < 1 << 6 else np.int32
    if not len(words):
        return np.zeros((0, len(LETTERS)), kind)
    lengths = _byte_lengths(words)
    begin = np.frombuffer(words.buffers()[1], np.int32)[words.offset]
    data = np.frombuffer(words.buffers()[2], np.uint8)[begin:begin + lengths.sum()]
    row = np.repeat(np.arange(len(words)), lengths)
    used = data != LEAD
    letter = np.where(data < 128, data.astype(np.int64) - 97, data.astype(np.int64) - 0x80 + 26)
    flat = np.bincount(row[used] * len(LETTERS) + letter[used], minlength=len(words) * len(LETTERS))
    return flat.reshape(len(words), len(LETTERS)).astype(kind)


def best_split(vectors: np.ndarray) -> tuple[int, int] | None:
    """The letter and count that part the vectors most evenly (left: at most that count); None if all are equal."""
    best, split = 0, None
    for letter in np.flatnonzero(vectors.max(axis=0) != vectors.min(axis=0)):
        below = np.cumsum(np.bincount(vectors[:, letter]))[:-1]
        even = np.minimum(below, len(vectors) - below)
        at = int(even.argmax())
        if even[at] > best:
            best, split = int(even[at]), (int(letter), at)
    return split


def upper_tree(vectors: np.ndarray, most: float) -> list[tuple[int, int, int, int]]:
    """Nodes (letter, count, left, right) of a tree whose leaves hold at most `most` of the vectors, where they can be parted.

    A leaf has the letter -1 and its number in `count`; the root is node 0.
    """
    nodes: list[tuple[int, int, int, int]] = []
    leaves = 0

    def grow(rows: np.ndarray) -> int:
        nonlocal leaves
        split = best_split(vectors[rows]) if len(rows) > max(most, 1) else None
        at = len(nodes)
        nodes.append((-1, leaves, 0, 0))
        if split is None:
            leaves += 1
            return at
        below = vectors[rows, split[0]] <= split[1]
        left = grow(rows[below])
        nodes[at] = (*split, left, grow(rows[~below]))
        return at

    grow(np.arange(len(vectors)))
    return nodes


def leaves_within(nodes: list[tuple[int, int, int, int]], vectors: np.ndarray, ups: int, downs: int) -> Iterator[tuple[int, np.ndarray]]:
    """Leaf numbers with the vectors that reach them, raising counts by `ups` and lowering them by `downs` (0 or 1) at most."""
    none = np.full(len(vectors), -1)
    stack = [(0, np.arange(len(vectors)), none, none)]
    while stack:
        node, rows, up, down = stack.pop()
        letter, count, left, right = nodes[node]
        if not len(rows):
            continue
        if letter < 0:
            yield count, rows
            continue
        value = vectors[rows, letter] + (up == letter) - (down == letter)
        fits = value <= count
        lowered = ~fits & (value == count + 1) & (down < 0) & (up != letter) if downs else np.zeros(len(rows), bool)
        go = fits | lowered
        stack.append((left, rows[go], up[go], np.where(lowered, letter, down)[go]))
        raised = fits & (value == count) & (up < 0) & (down != letter) if ups else np.zeros(len(rows), bool)
        go = ~fits | raised
        stack.append((right, rows[go], np.where(raised, letter, up)[go], down[go]))


class CellTree:
    """k-d tree over the distinct letter vectors of a cell's words."""

    def __init__(self, words: pa.Array, counts: np.ndarray, length: int):
        self.length, self.known = length, dict(zip(words.to_pylist(), counts.tolist()))
        vectors = letter_counts(words, length)
        rows = np.unique(vectors.view(np.dtype((np.void, vectors.dtype.itemsize * vectors.shape[1]))).ravel()) if len(vectors) else vectors
        vectors = rows.view(vectors.dtype).reshape(-1, len(LETTERS))
        self.nodes, order = [], []
        self._grow(vectors, np.arange(len(vectors)), order)
        self.vectors = vectors[np.concatenate(order)] if order else vectors
        self.visited = 0

    def _grow(self, vectors: np.ndarray, rows: np.ndarray, order: list[np.ndarray]) -> int:
        """Nodes (low, high, left, right, first, last): the box of the vectors below, and for a leaf their places."""
        at, own = len(self.nodes), vectors[rows]
        if not len(rows):
            return at
        split = best_split(own) if len(rows) > LEAF else None
        first = sum(map(len, order))
        self.nodes.append((own.min(axis=0), own.max(axis=0), 0, 0, first, first + len(rows)))
        if split is None:
            order.append(rows)
            return at
        below = own[:, split[0]] <= split[1]
        left = self._grow(vectors, rows[below], order)
        right = self._grow(vectors, rows[~below], order)
        self.nodes[at] = (*self.nodes[at][:2], left, right, first, first + len(rows))
        return at

    def close(self, queries: np.ndarray, ups: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(query rows, vector rows) of all vectors that one letter less, and `ups` (0 or 1) letters more, turn queries into."""
        stack = [(0, np.arange(len(queries)))] if self.nodes else []
        while stack:
            node, rows = stack.pop()
            low, high, left, right, first, last = self.nodes[node]
            own = queries[rows]
            self.visited += len(rows)
            inside = (np.maximum(own - high, 0).sum(axis=1) <= 1) & (np.maximum(low - own, 0).sum(axis=1) <= ups)
            rows = rows[inside]
            if not len(rows):
                continue
            if left:
                stack += [(left, rows), (right, rows)]
                continue
            own = own[inside]
            for start in range(0, len(rows), 512):
                more = np.maximum(self.vectors[None, first:last] - own[start:start + 512, None], 0).sum(axis=2)
                query, vector = np.nonzero(more == ups)
                yield rows[start + query], first + vector

    def near(self, words: list[str], queries: np.ndarray, ups: int) -> Iterator[tuple[int, str]]:
        """(row of the query, word of the cell) one edit apart: the letters that the counts name, tried at each place."""
        for rows, vectors in self.close(queries, ups):
            change = self.vectors[vectors] - queries[rows]
            lost, won = change.argmin(axis=1).tolist(), change.argmax(axis=1).tolist()
            for row, old, new in zip(rows.tolist(), lost, won):
                word, old, new = words[row], LETTERS[old], LETTERS[new] if ups else ""
                at, seen = word.find(old), None
                while at >= 0:
                    other = word[:at] + new + word[at + 1:]
                    if other in self.known and other != seen:
                        yield row, other
                        seen = other
                    at = word.find(old, at + 1)


def _better(n: int, word: str, best: tuple[int, str] | None) -> bool:
    return best is None or n > best[0] or n == best[0] and word < best[1]


class _Links:
    """Links of a cell's words: how many, and the neighbour with the largest count."""

    def __init__(self):
        self.found: dict[str, list] = {}

    def add(self, word: str, n: int, other: str) -> None:
        held = self.found.get(word)
        if held is None:
            self.found[word] = [1, n, other]
            return
        held[0] += 1
        if _better(n, other, (held[1], held[2])):
            held[1:] = n, other

    def rows(self) -> pa.RecordBatch:
        columns = [list(self.found), *map(list, zip(*self.found.values()))]
        self.found = {}
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow_schema(FOUND))], schema=arrow_schema(FOUND))


def _answer(tree: CellTree, role: int, words: pa.Array, counts: np.ndarray, links: _Links) -> None:
    texts, length = words.to_pylist(), tree.length + (role == LONGER)
    queries = letter_counts(words, length)
    if queries.dtype != tree.vectors.dtype:
        queries = queries.astype(np.int32)
    for row, other in tree.near(texts, queries, int(role != LONGER)):
        word = texts[row]
        if role == OWN and word > other:
            continue
        links.add(word, tree.known[other], other)
        links.add(other, int(counts[row]), word)


# Search over all cells

def _cell(length: int, leaf: int) -> int:
    return length << 32 | leaf


def _by_length(words: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    lengths = pc.utf8_length(words).to_numpy(zero_copy_only=False)
    for length in np.unique(lengths).tolist():
        yield length, np.flatnonzero(lengths == length)


ONE_LEAF = [(-1, 0, 0, 0)]


def fit_upper(words: list[str], all_words: int, cell_words: int) -> dict[int, list[tuple[int, int, int, int]]]:
    """A tree for each length of the sampled words; its leaves stand for about `cell_words` of all words."""
    sample, trees = pa.array(words, pa.string()), {}
    most = max(1.0, cell_words * len(words) / max(all_words, 1))
    for length, rows in _by_length(sample):
        trees[length] = upper_tree(letter_counts(sample.take(pa.array(rows)), length), most)
    return trees


def _own_leaf(tree: list[tuple[int, int, int, int]], vectors: np.ndarray) -> np.ndarray:
    leaf = np.zeros(len(vectors), np.int64)
    for number, rows in leaves_within(tree, vectors, 0, 0):
        leaf[rows] = number
    return leaf


def _homes(trees: Callable[[], dict]) -> Callable:
    """Words of a batch with the cell that holds them."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = np.zeros(batch.num_rows, np.int64)
            for length, rows in _by_length(batch.column(0)):
                words = batch.column(0).take(pa.array(rows))
                cells[rows] = _cell(length, 0) + _own_leaf(trees().get(length, ONE_LEAF), letter_counts(words, length))
            yield pa.RecordBatch.from_arrays([pa.array(cells)], names=["cell"])

    return run


def _routes(trees: Callable[[], dict], salts: dict[int, int], shortest: int) -> Callable:
    """Each word for the cell that holds it, and for every cell that may hold a word near to it."""
    schema = arrow_schema(ROUTED)

    def sent(words: pa.Array, counts: pa.Array, length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, int]]:
        """(rows, cells, salts, role)"""
        vectors = letter_counts(words, length)
        tree = trees().get(length, ONE_LEAF)
        home = _own_leaf(tree, vectors)
        split = [salts.get(_cell(length, leaf), 1) for leaf in home.tolist()]
        salt = np.fromiter((zlib.crc32(word.encode()) % n if n > 1 else 0 for word, n in zip(words.to_pylist(), split)), np.int32, len(words))
        yield np.arange(len(words)), _cell(length, 0) + home, salt, HELD
        searches = [(tree, length, 1)]
        if length > shortest:
            searches.append((trees().get(length - 1, ONE_LEAF), length - 1, 0))
        for other, size, ups in searches:
            for leaf, rows in leaves_within(other, vectors, ups, 1):
                for role in (OWN, SAME_LENGTH) if ups else (LONGER,):
                    # A pair of one length is found once: by the word whose cell comes first.
                    chosen = rows if role == LONGER else rows[home[rows] == leaf] if role == OWN else rows[home[rows] < leaf]
                    for one in range(salts.get(_cell(size, leaf), 1)):
                        yield chosen, np.full(len(chosen), _cell(size, leaf)), np.full(len(chosen), one, np.int32), role

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for length, at in _by_length(batch.column(0)):
                words, counts = batch.column(0).take(pa.array(at)), batch.column(1).take(pa.array(at))
                for rows, cells, salt, role in sent(words, counts, length):
                    if len(rows):
                        chosen = pa.array(rows)
                        roles = pa.array(np.full(len(rows), role, np.int32))
                        yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(salt), roles, words.take(chosen), counts.take(chosen)], schema=schema)

    return run


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by cell, salt and role: builds a tree of the words held, then answers the others batch by batch."""
    at, held, tree, links = None, [], None, _Links()
    for batch in batches:
        cells, salts, roles = (batch.column(i).to_numpy() for i in range(3))
        changes = np.flatnonzero((np.diff(cells) != 0) | (np.diff(salts) != 0) | (np.diff(roles) != 0)) + 1
        for start, end in zip([0, *changes.tolist()], [*changes.tolist(), batch.num_rows]):
            if start == end:
                continue
            if at != (cells[start], salts[start]):
                if links.found:
                    yield links.rows()
                at, held, tree = (cells[start], salts[start]), [], None
            part = batch.slice(start, end - start)
            if roles[start] == HELD:
                held.append(part)
                continue
            if not held:
                continue  # no word lies in this cell
            if tree is None:
                whole = pa.Table.from_batches(held).combine_chunks()
                tree = CellTree(pa.concat_arrays(whole.column(3).chunks), whole.column(4).to_numpy(), int(cells[start]) >> 32)
            for first in range(0, part.num_rows, QUERIES):
                some = part.slice(first, QUERIES)
                _answer(tree, int(roles[start]), pa.concat_arrays([some.column(3)]), some.column(4).to_numpy(), links)
            if len(links.found) > 100_000:
                yield links.rows()
    if links.found:
        yield links.rows()


def near_words(vocabulary: DataFrame, shortest: int = 5, cell_words: int = 8_192) -> DataFrame:
    """(word, n_near, best, best_n) of all words of (word, n) that have a word one edit away; words are distinct.

    n_near counts these words, best is the one of them with the largest n (of equals the least by code points).
    `vocabulary` is read several times: pass written rows. The driver gets a sample of bounded size, and one row for each
    cell that holds over four times what it should, because its words have equal letters; such cells are split by a
    hash of the word and searched part by part.
    """
    spark = vocabulary.sparkSession
    total = vocabulary.count()
    luck = F.shiftrightunsigned(F.xxhash64("word"), 11) / F.lit(float(1 << 53))
    sample = [row.word for row in vocabulary.filter(luck < min(1.0, SAMPLE / max(total, 1))).select("word").collect()]
    fitted = fit_upper(sample, total, cell_words)
    shared = spark.sparkContext.broadcast(fitted)
    homes = vocabulary.mapInArrow(_homes(lambda: shared.value), "cell long")
    full = homes.groupBy("cell").count().filter(F.col("count") > 4 * cell_words).collect()
    salts = {row["cell"]: -(-row["count"] // cell_words) for row in full}
    cells = sum(node[0] < 0 for tree in fitted.values() for node in tree) + sum(salts.values())
    routed = vocabulary.mapInArrow(_routes(lambda: shared.value, salts, shortest), ROUTED)
    dealt = routed.repartition(max(1, min(2 * cells, 20_000)), "cell", "salt").sortWithinPartitions("cell", "salt", "role")
    found = dealt.mapInArrow(_search, FOUND)
    best = F.min(F.struct((-F.col("best_n")).alias("less"), F.col("best").alias("best")))
    return found.groupBy("word").agg(F.sum("links").alias("n_near"), best.alias("b")).select(
        "word", "n_near", F.col("b.best").alias("best"), (-F.col("b.less")).alias("best_n")
    )


def last_forms(forms: DataFrame) -> DataFrame:
    """(word, root) of (word, form): where the forms of forms end. A form has over its word's count, so there are no circles.

    Every round each word goes on to the form of its form, so the way that is left halves.
    """
    current = stage(forms.select("word", F.col("form").alias("root")), name="forms")
    while True:
        onward = current.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = current.join(onward, "root", "left").select(
            "word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")
        )
        moved = stage(moved, name="forms")
        current = moved.select("word", "root")
        if moved.filter("moved").isEmpty():
            return current


def spelling_variants(
    docs: DataFrame, key: str = "doc_id", text: str = "text", one_in: int | None = 97, shortest: int = 5, least: int = 3,
    ratio: int = 2, cell_words: int = 8_192,
) -> DataFrame:
    """word, form, root, n, n_near and form_n of every word with `shortest` letters and `least` occurrences over all texts.

    A word is near another if one letter inserted, deleted or replaced turns it into that. Its form is the near word of
    largest n (of equals the least by code points) if that n is at least `ratio` (above 1) times its own; else form and
    form_n are null. root is the end of the chain of forms, the word itself if it has none. Null and empty texts have no
    words, null keys are the empty text in the checksum (see `count_words`), repeated rows count as often as they occur,
    other columns are not read, an empty table gives no words.
    """
    if ratio < 2:
        raise ValueError("ratio must be 2 or more, or forms could go round in circles")
    words = stage(count_words(docs, key, text, one_in, shortest).filter(F.col("n") >= least), name="words")
    near = near_words(words, shortest, cell_words)
    fits = F.col("best_n") >= ratio * F.col("n")
    joined = stage(words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(fits, F.col("best")).alias("form"), F.when(fits, F.col("best_n")).alias("form_n"),
    ), name="near")
    roots = last_forms(joined.filter(F.col("form").isNotNull()))
    return joined.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
