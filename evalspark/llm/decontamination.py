"""Benchmark decontamination by BM25 search with block-max WAND.

The test items are the indexed side and every passage of every training text is a query. The index holds, per term,
the items with the term and its BM25 impact on each, as a share of the item's own threshold, so that an item is
retrieved when its shares add up to 1. Items lie in blocks, and each term has a greatest share per block. Passages are
windows over a whole text that overlap by half and are long enough for the longest item to lie inside one of them.

A passage first meets the block maxima: only blocks whose maxima add up to 1 are opened, and inside them WAND moves
from pivot to pivot. Every item retrieved is verified: enough word shingles of its question and of its answer must
occur in the passage, or, where the rules name a share for it, enough of the whole item's.
"""

import pickle
import uuid
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evalspark.llm.common import arrow_schema, batches_of, kept, texts_of
from evalspark.staging import stage

BLOCK_ITEMS = 8
MOST_BLOCKS = 64
MOST_MAXIMA = 1 << 22
INDEX_BYTES = 4 << 20
CACHED = 400_000
LONGEST_CACHED = 48
POSITIONS_AT_ONCE = 1 << 20
ROUNDING = 1e-6
OTHER, NONE = -1, -2


def normal(chunk: str) -> str:
    """A word is what is left of a stretch without white space in lower case, letters and digits only; it may be empty."""
    return "".join(filter(str.isalnum, chunk.lower()))


def words_of(text: str | None) -> list[str]:
    return [word for word in map(normal, (text or "").split()) if word]


def _shingles(ids: list[int], n: int) -> set[tuple[int, ...]]:
    return {tuple(ids[i : i + n]) for i in range(max(1, len(ids) - n + 1))} if ids else set()


@dataclass(frozen=True)
class Rules:
    """Share of an item's own BM25 score that retrieves it, shingle length and shares of shingles that verify it.

    With `whole`, an item is also verified by that share of the shingles of its whole text, if each part has `part_words`
    of its distinct words in the passage. A part is short, so one changed word can take most of its shingles.
    """

    share: float = 0.7
    shingle_words: int = 5
    question: float = 0.8
    answer: float = 0.8
    whole: float | None = None
    part_words: float = 0.5
    k1: float = 1.2
    b: float = 0.75

    def whole_shingle_words(self, words: int) -> int:
        """The longest shingle, of two words at least, of which one changed word leaves the share `whole` of an item."""
        return max(2, min(self.shingle_words, int((1 - self.whole) * (words + 1) / (2 - self.whole) + 1e-9)))


#: What the registered query and the pipeline take for a leak.
LEAKS = Rules(whole=0.8)


class ItemIndex:
    """Inverted index of items (key, question, answer). The other arguments describe all items, if these are a part."""

    def __init__(self, items: list[tuple], rules: Rules, frequency: dict[str, int] | None = None, total: int | None = None, mean_words: float | None = None, longest: int | None = None):
        texts = [(key, words_of(question), words_of(answer)) for key, question, answer in items]
        texts = [(key, question, answer) for key, question, answer in texts if question or answer]
        self.rules, self.keys = rules, [key for key, _, _ in texts]
        bags = [Counter(question + answer) for _, question, answer in texts]
        if frequency is None:
            frequency, total = Counter(word for bag in bags for word in bag), len(bags)
            mean_words = sum(sum(bag.values()) for bag in bags) / max(1, len(bags))
        self.terms = {word: i for i, word in enumerate(sorted(set().union(*bags)))}
        self.longest = max((sum(bag.values()) for bag in bags), default=0) if longest is None else longest
        self.shingles = [tuple(_shingles([self.terms[w] for w in part], rules.shingle_words) for part in parts) for _, *parts in texts]
        self.wholes = [[self.terms[w] for w in question + answer] for _, question, answer in texts] if rules.whole is not None else []
        self.question_words = [len(question) for _, question, _ in texts]
        posts: list[list[tuple[int, float]]] = [[] for _ in self.terms]
        for item, bag in enumerate(bags):
            norm = rules.k1 * (1 - rules.b + rules.b * sum(bag.values()) / mean_words)
            impacts = {word: np.log1p((total - frequency[word] + 0.5) / (frequency[word] + 0.5)) * n * (rules.k1 + 1) / (n + norm) for word, n in bag.items()}
            own = rules.share * sum(impacts.values())
            for word, impact in impacts.items():
                posts[self.terms[word]].append((item, impact / own))
        self.posts = [([item for item, _ in post], [weight for _, weight in post]) for post in posts]
        blocks = max(1, min(MOST_BLOCKS, MOST_MAXIMA // max(1, len(posts))))
        self.block_items = max(BLOCK_ITEMS, -(-len(bags) // blocks))
        self.block_max = np.zeros((-(-len(bags) // self.block_items), len(posts)), np.float32)
        for term, post in enumerate(posts):
            for item, weight in post:
                block = item // self.block_items
                self.block_max[block, term] = max(self.block_max[block, term], weight + ROUNDING)

    def open_blocks(self, terms: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(passage, block) pairs whose greatest shares reach the threshold; passages are spans of the term positions.

        Sums run over all positions of a few blocks at once, so a term that occurs twice counts twice, which only opens more.
        """
        passages, blocks = [], []
        step = max(1, POSITIONS_AT_ONCE // max(1, len(terms)))
        for at in range(0, len(self.block_max), step):
            sums = np.zeros((min(step, len(self.block_max) - at), len(terms) + 1))
            np.cumsum(self.block_max[at : at + step, terms], axis=1, out=sums[:, 1:])
            block, passage = np.nonzero(sums[:, right] - sums[:, left] >= 1 - 1e-6)
            passages.append(passage), blocks.append(block + at)
        return np.concatenate(passages), np.concatenate(blocks)

    def wand(self, terms: list[int], block: int) -> list[tuple[int, float]]:
        """Items of one block whose shares over distinct terms reach the threshold, with their sums."""
        first, end = block * self.block_items, (block + 1) * self.block_items
        cursors = []
        for term in terms:
            bound = float(self.block_max[block, term])
            if bound > 0:
                items, weights = self.posts[term]
                at = int(np.searchsorted(items, first))
                cursors.append([items[at], at, items, weights, bound])
        found = []
        while cursors:
            cursors.sort(key=lambda cursor: cursor[0])
            bound, pivot = 0.0, None
            for cursor in cursors:
                bound += cursor[4]
                if bound >= 1 - 1e-9:
                    pivot = cursor[0]
                    break
            if pivot is None:
                break
            if cursors[0][0] == pivot:
                score = sum(cursor[3][cursor[1]] for cursor in cursors if cursor[0] == pivot)
                if score >= 1 - 1e-9:
                    found.append((pivot, score))
                pivot += 1
            for cursor in cursors:
                while cursor[0] < pivot:
                    cursor[1] += 1
                    cursor[0] = cursor[2][cursor[1]] if cursor[1] < len(cursor[2]) else end
            cursors = [cursor for cursor in cursors if cursor[0] < end]
        return found

    def verified(self, item: int, passage: list[int]) -> tuple[float, float] | None:
        """Shares of the question's and the answer's shingles in the passage, if both are high enough or the whole item's are.

        An item without an answer is verified by its question alone, and the other way round.
        """
        shares = []
        for part in self.shingles[item]:
            lengths = {len(shingle) for shingle in part}
            there = set().union(*[_shingles(passage, n) for n in lengths])
            shares.append(len(part & there) / len(part) if part else 1.0)
        if shares[0] < self.rules.question or shares[1] < self.rules.answer:
            if self.rules.whole is None or not self._whole_verified(item, passage):
                return None
        return shares[0], shares[1]

    def _whole_verified(self, item: int, passage: list[int]) -> bool:
        whole, cut, there = self.wholes[item], self.question_words[item], set(passage)
        for part in (set(whole[:cut]), set(whole[cut:])):
            if len(part & there) < self.rules.part_words * len(part):
                return False
        n = self.rules.whole_shingle_words(len(whole))
        shingles = _shingles(whole, n)
        return len(shingles & _shingles(passage, n)) >= self.rules.whole * len(shingles) - 1e-9


class _Ids(dict):
    """Numbers of words, learned when first asked for."""

    def __init__(self, learn: Callable[[str], int]):
        super().__init__()
        self.learn = learn

    def __missing__(self, chunk: str) -> int:
        return self.learn(chunk)


class Searcher:
    """Finds the items of one index in whole texts."""

    def __init__(self, index: ItemIndex):
        self.index, self.ids = index, _Ids(self._learn)
        self.stride = max(1, index.longest)

    def _learn(self, chunk: str) -> int:
        if len(self.ids) > CACHED:
            self.ids.clear()
        word = normal(chunk)
        found = self.index.terms.get(word, OTHER) if word else NONE
        if len(chunk) <= LONGEST_CACHED:
            self.ids[chunk] = found
        return found

    def __call__(self, text: str) -> dict[int, tuple[int, float, float, float]]:
        """By item: word position of the best passage, score as a share of the item's own, both overlaps."""
        index, best = self.index, {}
        if not index.keys:
            return best
        chunks = text.split()
        words = np.fromiter(map(self.ids.__getitem__, chunks), np.int32, len(chunks))
        words = words[words != NONE]
        if not len(words):
            return best
        places = np.flatnonzero(words >= 0)
        starts = np.arange(0, max(1, len(words) - self.stride), self.stride)
        left, right = np.searchsorted(places, starts), np.searchsorted(places, starts + 2 * self.stride)
        known = words[places]
        passages, blocks = index.open_blocks(known, left, right)
        if not len(passages):
            return best
        order = np.argsort(passages, kind="stable")
        passages, blocks = passages[order], blocks[order]
        edges = [0, *(np.flatnonzero(passages[1:] != passages[:-1]) + 1).tolist(), len(passages)]
        for a, b in zip(edges, edges[1:]):
            k = int(passages[a])
            terms, opened = np.sort(known[left[k] : right[k]]), blocks[a:b]
            new = terms[1:] != terms[:-1]
            terms = np.concatenate((terms[:1], terms[1:][new]))
            opened = opened[index.block_max[opened[:, None], terms].sum(axis=1) >= 1 - 1e-6]
            for block in opened.tolist():
                for item, score in index.wand(terms.tolist(), block):
                    overlaps = index.verified(item, words[starts[k] : starts[k] + 2 * self.stride].tolist())
                    if overlaps and (item not in best or score * index.rules.share > best[item][1]):
                        best[item] = (int(starts[k]), score * index.rules.share, *overlaps)
        return best


def _index_parts(items: DataFrame, rules: Rules, parts: int) -> Iterator[ItemIndex]:
    """One index for each part of the items, with the statistics and the longest item of all, so that parts change no result."""
    if parts == 1:
        yield ItemIndex([tuple(row) for row in items.collect()], rules)
        return

    @F.udf("array<string>")
    def words(question, answer):
        return words_of(question) + words_of(answer)

    bags = items.select("key", words("question", "answer").alias("words")).filter(F.size("words") > 0)
    total, mean_words, longest = bags.agg(F.count(F.lit(1)), F.avg(F.size("words")), F.max(F.size("words"))).first()
    terms = bags.select("key", F.explode(F.array_distinct("words")).alias("word"))
    frequency = terms.groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    part_of = F.pmod(F.xxhash64("key", "question", "answer"), F.lit(parts))
    for part in range(parts):
        own = items.filter(part_of == part)
        listed = own.select(F.explode(words("question", "answer")).alias("word")).distinct().join(frequency, "word")
        yield ItemIndex([tuple(row) for row in own.collect()], rules, {row.word: row.n for row in listed.collect()}, total, mean_words, longest)


def find_leaks(docs: DataFrame, items: DataFrame, question: Column, answer: Column, item_key: str = "item_id", rules: Rules = Rules(), index_bytes: int = INDEX_BYTES, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document and test item it contains: key, item key, passage_word, score, question_overlap, answer_overlap.

    `question` and `answer` are expressions over `items`. The score is the BM25 score of the best passage as a share of
    the item's score on itself. An index larger than `index_bytes` of item text is searched in parts, one after the other:
    a scan of the documents each, whose leaks are written before the next part is built. Documents without words and items without words match nothing; null texts have no words, null keys
    stay null, and repeated documents or items give a row each. Other columns are not read.
    """
    spark = docs.sparkSession
    listed = items.select(F.col(item_key).alias("key"), F.coalesce(question, F.lit("")).alias("question"), F.coalesce(answer, F.lit("")).alias("answer"))
    frame = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).filter(F.col("text").isNotNull())
    schema = T.StructType([T.StructField(key, docs.schema[key].dataType), T.StructField(item_key, items.schema[item_key].dataType), T.StructField("passage_word", T.LongType()), *[T.StructField(name, T.DoubleType()) for name in ("score", "question_overlap", "answer_overlap")]])
    arrow = arrow_schema(schema)

    def searched(shared):
        tag = uuid.uuid4().hex

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            search = kept("search", tag, lambda: Searcher(pickle.loads(shared.value)))
            for batch in batches:
                rows = []
                for key_value, value in zip(batch.column(0).to_pylist(), texts_of(batch)):
                    rows += [(key_value, search.index.keys[item], *found) for item, found in search(value).items()]
                if rows:
                    yield from batches_of(dict(zip(arrow.names, map(list, zip(*rows)))), arrow)

        return frame.mapInArrow(run, schema)

    size = listed.agg(F.sum(F.octet_length("question").cast("long") + F.octet_length("answer"))).first()[0] or 0
    parts, found = max(1, -(-size // index_bytes)), []
    for index in _index_parts(listed, rules, parts):
        # By value, for workers that cannot import this package.
        shared = spark.sparkContext.broadcast(cloudpickle.dumps(index))
        found.append(searched(shared) if parts == 1 else stage(searched(shared), name="leaks"))
        if parts > 1:
            shared.unpersist()
    return reduce(DataFrame.unionByName, found)


def question_and_answer(text: Column, answer_share: float = 0.25) -> tuple[Column, Column]:
    """Parts of items that come as one text: the last quarter of the words is the answer, at least one word."""
    words = F.split(F.trim(F.regexp_replace(text, r"\s+", " ")), " ")
    cut = F.size(words) - F.greatest(F.lit(1), F.floor(F.size(words) * answer_share)).cast("int")
    return F.array_join(F.slice(words, F.lit(1), cut), " "), F.array_join(F.slice(words, cut + 1, F.size(words)), " ")


def decontaminate(docs: DataFrame, items: DataFrame, question: Column, answer: Column, item_key: str = "item_id", rules: Rules = Rules(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents that contain no test item, with all their columns. Every row is judged by its own text, whatever its key.

    Hashes of the leaking texts are written first: Spark then knows how few they are before it decides whether to shuffle
    texts. The documents travel in a column of their own, so that none of their names can clash.
    """
    mark = F.concat_ws(":", F.xxhash64(text), F.hash(text), F.octet_length(text))
    marked = docs.select(F.struct(*[F.col(f"`{name}`") for name in docs.columns]).alias("row"), mark.alias("mark"))
    texts = docs.select(mark.alias("mark"), F.col(text).alias("text"))
    leaks = find_leaks(texts, items, question, answer, item_key, rules, key="mark", text="text")
    leaks = stage(leaks.select(F.col("mark").alias("leaking")).distinct(), name="leaks")
    return marked.join(leaks, F.col("mark") == F.col("leaking"), "left_anti").select("row.*")
