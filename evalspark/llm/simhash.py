"""SimHash near-duplicates with a hierarchical index in Gray order.

Fingerprints within `distance` bits of each other agree on at least two of `distance + 2` blocks. So every distinct
fingerprint goes to one group for each pair of blocks, under the bits it has there: these masked patterns are the
uppermost nodes of the index. Below them, the fingerprints of a group lie in Gray order, in which neighbours differ in
few bits. Small groups that follow each other share an index, whatever links it finds among them. Runs of neighbours become nodes that hold the bits all of them share; bits that a node above holds already
are masked out. A search adds up the differing bits from the top down and drops a whole node once they exceed the
distance. Groups that are too large for one index are dealt again by pairs of blocks of their free bits.
"""

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalspark.llm.common import arrow_schema, batches_of
from evalspark.llm.components import components
from evalspark.staging import stage

SEED = 42
BLOCK = 1 << 16
FANOUT = 8
LEAST_INDEXED = 4096
LARGEST_GROUP = 8192
QUERIES_AT_ONCE = 512
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def fingerprint(text: bytes, shingle_words: int) -> int:
    """Majority of the bits of all shingles' hashes, as an unsigned number."""
    words = text.translate(LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(word) + 1 for word in words])
    starts = np.concatenate(([0], ends[:-1]))
    last = max(1, len(words) - shingle_words + 1)
    starts, ends = starts[:last].tolist(), (ends[-last:] - 1).tolist()
    ones = np.zeros(64, np.int64)
    for at in range(0, last, BLOCK):
        shingles = [joined[a:b] for a, b in zip(starts[at : at + BLOCK], ends[at : at + BLOCK])]
        hashes = np.frombuffer(b"".join(map(xxhash.xxh64_digest, shingles, repeat(SEED))), np.uint8)
        ones += np.unpackbits(hashes.reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > last).tobytes(), "big")


def row_marks(key: str, text: str) -> list[Column]:
    """Two hashes that tell rows apart by key and text."""
    return [F.xxhash64(key, text).alias("mark"), F.hash(text, key).alias("mark_2")]


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle_words: int = 3) -> DataFrame:
    """(key, mark, mark_2, fingerprint) of every row, the fingerprint as a signed long with the same bits. A null text is empty."""
    frame = docs.select(F.col(key).alias("key"), *row_marks(key, text), F.coalesce(F.col(text), F.lit("")).alias("text"))
    schema = frame.select("key", "mark", "mark_2", F.lit(0).cast("long").alias("fingerprint")).schema
    arrow = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(3).cast(pa.binary()).to_pylist()
            found = np.array([fingerprint(value, shingle_words) for value in texts], np.uint64)
            kept = [batch.column(i).cast(arrow.field(i).type) for i in range(3)]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(found.view(np.int64))], schema=arrow)

    return frame.mapInArrow(run, schema)


def block_masks(distance: int, bits: int = (1 << 64) - 1) -> list[int]:
    """Masks of all pairs out of distance + 2 blocks of the given bits."""
    places = [1 << i for i in range(64) if bits >> i & 1]
    edges = [len(places) * i // (distance + 2) for i in range(distance + 3)]
    blocks = [sum(places[a:b]) for a, b in zip(edges, edges[1:])]
    return [a | b for a, b in combinations(blocks, 2)]


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def _patterns(fingerprint_column: Column, masks: list[int]) -> Column:
    """An array of (mask, pattern) for each mask."""
    return F.array(*[F.struct(F.lit(_signed(mask)).alias("mask"), fingerprint_column.bitwiseAND(F.lit(_signed(mask))).alias("pattern")) for mask in masks])


def gray_rank(fingerprints: np.ndarray) -> np.ndarray:
    """Place of each number in the sequence of Gray codes."""
    rank = fingerprints.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


class GrayIndex:
    """Nodes over fingerprints in Gray order. Level 0 holds the fingerprints, the last level one or few nodes."""

    def __init__(self, fingerprints: np.ndarray):
        self.visited = 0
        self.order = np.argsort(gray_rank(fingerprints), kind="stable")
        pattern = fingerprints[self.order]
        same = np.full(len(pattern), np.uint64((1 << 64) - 1))
        self.levels = [(pattern, same)]
        while len(pattern) > FANOUT:
            firsts = np.arange(0, len(pattern), FANOUT)
            all_ones = np.bitwise_and.reduceat(pattern & same, firsts)
            all_zeros = np.bitwise_and.reduceat(~pattern & same, firsts)
            same = all_ones | all_zeros
            pattern = all_ones
            self.levels.append((pattern, same))
        # A level keeps only the bits that the level above does not hold.
        for i in range(len(self.levels) - 1):
            pattern, same = self.levels[i]
            above = self.levels[i + 1][1]
            self.levels[i] = (pattern, same & ~above[np.arange(len(pattern)) // FANOUT])

    def search(self, queries: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (position in queries, position in the fingerprints given) within the distance."""
        top = len(self.levels[-1][0])
        query = np.repeat(np.arange(len(queries)), top)
        node = np.tile(np.arange(top), len(queries))
        differing = np.zeros(len(query), np.int64)
        for depth in range(len(self.levels) - 1, -1, -1):
            pattern, held = self.levels[depth]
            self.visited += len(node)
            differing = differing + np.bitwise_count((queries[query] ^ pattern[node]) & held[node])
            near = differing <= distance
            query, node, differing = query[near], node[near], differing[near]
            if depth:
                below = len(self.levels[depth - 1][0])
                node = (node[:, None] * FANOUT + np.arange(FANOUT)).ravel()
                query, differing = np.repeat(query, FANOUT), np.repeat(differing, FANOUT)
                there = node < below
                query, node, differing = query[there], node[there], differing[there]
        return query, self.order[node]


def _spanning(group: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect whatever the links within the distance connect: each fingerprint to the first of its part."""
    index, root = GrayIndex(group), np.arange(len(group))
    for at in range(0, len(group), QUERIES_AT_ONCE):
        query, other = index.search(group[at : at + QUERIES_AT_ONCE], distance)
        query = query + at
        while True:
            low = np.minimum(root[query], root[other])
            before = root.copy()
            np.minimum.at(root, root[query], low)
            np.minimum.at(root, root[other], low)
            root = np.minimum(root, root[root])
            if (root == before).all():
                break
    moved = np.flatnonzero(root != np.arange(len(group)))
    return group[moved], group[root[moved]]


def _linked(frame: DataFrame, distance: int, largest: int | None) -> DataFrame:
    """Rows (a, b, mask, pattern) of links; those of groups above `largest` come back as (fingerprint, null, mask, pattern)."""
    schema = frame.select(F.col("fingerprint").alias("a"), F.col("fingerprint").alias("b"), "mask", "pattern").schema
    arrow = arrow_schema(schema)

    def links(mask: np.ndarray, pattern: np.ndarray, found: np.ndarray) -> dict[str, np.ndarray]:
        """Of whole groups, in order; those of a run of small groups together."""
        new = np.flatnonzero(np.concatenate(([True], (mask[1:] != mask[:-1]) | (pattern[1:] != pattern[:-1]))))
        a, b, at = [], [], [np.zeros(0, np.int64)]
        first = 0
        for end in [*new[1:].tolist(), len(found)]:
            if end - first >= LEAST_INDEXED or end == len(found):
                left, right = _spanning(np.unique(found[first:end]), distance)
                a.append(left), b.append(right), at.append(np.full(len(left), first))
                first = end
        at = np.concatenate(at)
        return {"a": np.concatenate([np.zeros(0, np.uint64), *a]).view(np.int64), "b": np.concatenate([np.zeros(0, np.uint64), *b]).view(np.int64), "mask": mask[at], "pattern": pattern[at]}

    def too_large(mask: np.ndarray, pattern: np.ndarray, found: np.ndarray) -> Iterator[pa.RecordBatch]:
        yield from batches_of({"a": found.view(np.int64), "b": [None] * len(found), "mask": mask, "pattern": pattern}, arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, passed_on = None, None
        for batch in batches:
            rows = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)]
            rows[2] = rows[2].view(np.uint64)
            if waiting is not None:
                rows = [np.concatenate(pair) for pair in zip(waiting, rows)]
            if passed_on is not None:
                same = (rows[0] == passed_on[0]) & (rows[1] == passed_on[1])
                yield from too_large(*[row[same] for row in rows])
                rows = [row[~same] for row in rows]
            waiting = rows
            if not len(rows[0]):
                continue
            last = (rows[0][-1], rows[1][-1])
            whole = len(rows[0]) - int(((rows[0] == last[0]) & (rows[1] == last[1])).sum())
            if whole:
                yield from batches_of(links(*[row[:whole] for row in rows]), arrow)
            waiting, passed_on = [row[whole:] for row in rows], None
            if largest and len(waiting[0]) > largest:
                yield from too_large(*waiting)
                waiting, passed_on = None, last
        if waiting is not None and len(waiting[0]):
            yield from batches_of(links(*waiting), arrow)

    dealt = frame.repartition("mask", "pattern").sortWithinPartitions("mask", "pattern")
    return dealt.select("mask", "pattern", "fingerprint").mapInArrow(run, schema)


def near_links(distinct: DataFrame, distance: int = 2, largest_group: int = LARGEST_GROUP) -> DataFrame:
    """Links (a, b) that connect all fingerprints within the distance, from a table of distinct fingerprints."""
    masks = block_masks(distance)
    dealt = distinct.select("fingerprint", F.explode(_patterns(F.col("fingerprint"), masks)).alias("p")).select("fingerprint", "p.*")
    first = stage(_linked(dealt, distance, largest_group), name="near")
    again = F.coalesce(*[F.when(F.col("mask") == _signed(mask), _patterns(F.col("a"), [mask | sub for sub in block_masks(distance, ~mask & ((1 << 64) - 1))])) for mask in masks])
    large = first.filter("b is null").select(F.col("a").alias("fingerprint"), F.explode(again).alias("p")).select("fingerprint", "p.*")
    return first.filter("b is not null").select("a", "b").unionByName(_linked(large, distance, None).select("a", "b"))


def _classes(docs: DataFrame, shingle_words: int, distance: int, key: str, text: str) -> DataFrame:
    """(key, mark, mark_2, fingerprint, component_id, root) of every row; the root is the component's own fingerprint."""
    marked = stage(fingerprints(docs, key, text, shingle_words), name="fingerprints")
    distinct = stage(marked.groupBy("fingerprint").agg(F.min("key").alias("least")), name="distinct")
    roots = components(near_links(distinct, distance))
    joined = distinct.join(roots, distinct.fingerprint == roots.node, "left")
    owned = stage(joined.select("fingerprint", "least", F.coalesce("root", "fingerprint").alias("root")), name="owned")
    least = owned.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = owned.join(least, "root").select(F.col("fingerprint").alias("found"), "component_id", "root")
    return marked.join(classes, F.col("fingerprint") == F.col("found")).drop("found")


def simhash_near_dedup(docs: DataFrame, shingle_words: int = 3, distance: int = 2, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Every row with its fingerprint (16 hex digits) and component_id, the least key it is linked to, over any steps.

    Texts without words have fingerprint 0 and are linked like any other; a null text has no words. Rows with the same
    key count each for itself. A null key belongs to the component of its fingerprint and is never a component's id,
    unless all keys of the component are null. Other columns are not read. An empty table gives an empty result.
    """
    hexed = F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint")
    return _classes(docs, shingle_words, distance, key, text).select(F.col("key").alias(key), hexed, "component_id")


def near_duplicates_removed(docs: DataFrame, shingle_words: int = 3, distance: int = 2, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One document of each component, with all its columns: the one with the least key.

    If several texts of a component share that key, the one with the least hash stays. Rows that are alike in key and
    text stay once. In a component without any key a text of the least hash stays.
    """
    own = _classes(docs, shingle_words, distance, key, text).filter(F.col("key").eqNullSafe(F.col("component_id")))
    kept = own.groupBy("root").agg(F.min(F.struct("mark", "mark_2")).alias("first"))
    kept = kept.select(F.col("first.mark").alias("kept_mark"), F.col("first.mark_2").alias("kept_mark_2")).distinct()
    # The documents travel in a column of their own, so that none of their names can clash.
    marked = docs.select(F.struct(*[F.col(f"`{name}`") for name in docs.columns]).alias("row"), *row_marks(key, text))
    joined = marked.join(kept, (F.col("mark") == F.col("kept_mark")) & (F.col("mark_2") == F.col("kept_mark_2")))
    return joined.dropDuplicates(["mark", "mark_2"]).select("row.*")
