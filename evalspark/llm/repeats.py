"""Removal of repeated strings by prefix-free parsing.

A rolling hash over short windows sets triggers: the window with the least hash among those inside a string of the
length to be judged. Triggers depend on nothing but the text near them, so equal strings get equal triggers wherever
they lie. They cut a text into phrases: a phrase is a run of string starts with one trigger, together with the bytes
their strings reach into. The parse of the corpus is the list of phrase occurrences, its dictionary the distinct ones.

Suffixes are put in corpus order in two steps, each sorted within partitions:

1. Occurrences by (trigger, phrase, place). All but the first of a phrase are repeats as a whole. A first occurrence
   can share strings with others only if its trigger occurs in another phrase as well; only then it goes on.
2. The suffixes of the dictionary's phrases that went on, trigger by trigger, by (content, place). All but the first of
   equal ones are repeats.

Places are (document, byte). Contents are compared by two 64-bit hashes, so the order of the suffixes is that of their
hashes instead of the alphabet: equal ones meet, earliest first, which is all that the removal needs. Each task first
settles what repeats inside itself, so a string with very many copies reaches a reducer once per task. A trigger with
very many phrases is not brought together: its phrases are dealt out one by one, and then their suffixes.
"""

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evalspark.llm.common import arrow_schema, batches_of, kept
from evalspark.staging import stage

TRIGGER = 32
WIDEST = 96
SEGMENT = 1 << 18
CHUNK = 1_200_000
LONGEST_PHRASE = 128
CROWD_IN_TASK = 48
CROWD = 2048
NO_KEY = (1 << 63) - 1
PLACE_BITS = 9
ONCE, SHARED, REPEAT, CROWDED = 0, 1, 2, 3
BASE = 0x9E3779B97F4A7C15 | 5
INVERSE = pow(BASE, -1, 1 << 64)
SCHEMA = "k long, h long, doc long, at long, tie long"
PLACES = "doc long, at long, tie long"
WITH_TEXT = SCHEMA + ", text binary"
U64 = np.uint64


def _pack(start: np.ndarray, n: np.ndarray, kind: np.ndarray | int) -> np.ndarray:
    """Start byte, number of string starts (up to 128) and kind in one sortable number."""
    return (start << PLACE_BITS) | ((n - 1) << 2) | kind


def _unpack(at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return at >> PLACE_BITS, ((at >> 2) & 127) + 1, at & 3


def _powers(base: int, size: int) -> np.ndarray:
    def make():
        found = np.full(size, base, U64)
        found[0] = 1
        return np.multiply.accumulate(found)

    return kept(f"powers {base}", str(size), make)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U64(33))) * U64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> U64(29))) * U64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> U64(32))


class Segment:
    """Texts laid end to end, with hashes of any stretch, and the least trigger of every string start."""

    def __init__(self, texts: list[bytes], length: int):
        joined = np.frombuffer(b"".join(texts), np.uint8)
        n, trigger = len(joined), min(max(TRIGGER, length - WIDEST), length)
        self.length, self.inverse = length, _powers(INVERSE, SEGMENT + length + 1)
        self.sums = np.zeros(n + 1, U64)
        np.cumsum((joined.astype(U64) + U64(1)) * _powers(BASE, SEGMENT + length + 1)[:n], out=self.sums[1:])
        self.triggers = least = _mixed(self.hashes(np.arange(n - trigger + 1), trigger))
        width, reach = length - trigger + 1, 1
        while 2 * reach <= width:
            least = np.minimum(least[:-reach], least[reach:])
            reach *= 2
        self.least = np.minimum(least[: len(least) - (width - reach)], least[width - reach :])

    def hashes(self, starts: np.ndarray, length: np.ndarray | int) -> np.ndarray:
        return (self.sums[starts + length] - self.sums[starts]) * self.inverse[starts]


def _segments(rows: Iterator[tuple], length: int) -> Iterator[tuple]:
    """Bounded stretches of the texts (doc, tie, bytes, ...): the segment, and of each part of a text in it the first
    byte in the segment, size, doc, tie, first byte in the document, and what else the row holds.

    A text longer than a segment is cut; its parts overlap so that every string start lies in exactly one of them.
    """
    parts, size = [], 0

    def segment():
        doc, tie, at, texts, others = zip(*parts)
        sizes = np.array(list(map(len, texts)))
        first = np.concatenate(([0], sizes.cumsum()[:-1]))
        return Segment(list(texts), length), first, sizes, np.array(doc, np.int64), np.array(tie, np.int64), np.array(at, np.int64), others

    for doc, tie, text, *others in rows:
        for at in range(0, max(0, len(text) - length + 1), SEGMENT - length):
            part = text[at : at + SEGMENT - 1]
            if size + len(part) > SEGMENT:
                yield segment()
                parts, size = [], 0
            parts.append((doc, tie, at, part, others))
            size += len(part)
    if parts:
        yield segment()


def _phrases(rows: Iterator[tuple], length: int) -> Iterator[list[np.ndarray]]:
    """The parse: trigger, phrase hash, doc, packed place and tie, for the texts of a segment."""
    for segment, first, sizes, doc, tie, at, _ in _segments(rows, length):
        starts = sizes - length + 1
        owner = np.repeat(np.arange(len(first)), starts)
        place = np.arange(len(owner)) - np.repeat(starts.cumsum() - starts, starts)
        position = place + first[owner]
        least = segment.least[position]
        # A phrase also ends where its trigger leaves the string, or it could hold a string twice.
        left = segment.triggers[position] == least
        new = np.flatnonzero(np.concatenate(([True], (least[1:] != least[:-1]) | (owner[1:] != owner[:-1]) | left[:-1])))
        run = np.diff(np.concatenate((new, [len(owner)])))
        cuts = -(-run // LONGEST_PHRASE)
        piece = np.arange(cuts.sum()) - np.repeat(cuts.cumsum() - cuts, cuts)
        new = np.repeat(new, cuts) + piece * LONGEST_PHRASE
        n = np.diff(np.concatenate((new, [len(owner)])))
        h = _mixed(segment.hashes(position[new], n - 1 + length) + n.astype(U64))
        whose = owner[new]
        yield [least[new], h, doc[whose], _pack(place[new] + at[whose], n, ONCE), tie[whose]]


def _kind(at: np.ndarray, kind: np.ndarray | int) -> np.ndarray:
    return (at & ~np.int64(3)) | kind


def _listed_phrases(rows: Iterator[tuple], length: int, kinds: tuple[int, ...]) -> Iterator[tuple]:
    """(doc, tie, bytes, place, bytes) of the listed phrases of some kinds, each as a short text of its own."""
    for doc, tie, text, places in rows:
        listed = np.array(places, np.int64)
        listed = listed[np.isin(listed & 3, kinds)]
        start, n, _ = _unpack(listed)
        for at, a, b in zip(listed.tolist(), start.tolist(), (start + n - 1 + length).tolist()):
            yield doc, tie, text[a:b], at, text[a:b]


def _suffixes(phrases: Iterator[tuple], length: int) -> Iterator[list[np.ndarray]]:
    """All suffixes of phrases, up to the judged length: content hash twice, doc, packed place, tie."""
    for segment, first, sizes, doc, tie, _, others in _segments(phrases, length):
        n = sizes - length + 1
        whose = np.repeat(np.arange(len(first)), n)
        place = np.arange(len(whose)) - np.repeat(n.cumsum() - n, n)
        position = place + first[whose]
        start = _unpack(np.array([at for at, *_ in others], np.int64))[0]
        yield [_mixed(segment.hashes(position, length)), segment.least[position], doc[whose], _pack(place + start[whose], np.ones(len(place), np.int64), ONCE), tie[whose]]


def _ranges(doc: np.ndarray, at: np.ndarray, tie: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of single starts, joined where they follow each other in one text."""
    order = np.lexsort((at, tie, doc))
    doc, at, tie = doc[order], at[order], tie[order]
    start = _unpack(at)[0]
    new = np.concatenate(([True], (doc[1:] != doc[:-1]) | (start[1:] != start[:-1] + 1) | (tie[1:] != tie[:-1]))) if len(at) else np.zeros(0, bool)
    run = np.diff(np.concatenate((np.flatnonzero(new), [len(at)])))
    cuts = -(-run // LONGEST_PHRASE)
    firsts = np.repeat(np.flatnonzero(new), cuts) + (np.arange(cuts.sum()) - np.repeat(cuts.cumsum() - cuts, cuts)) * LONGEST_PHRASE
    n = np.diff(np.concatenate((firsts, [len(at)])))
    return doc[firsts], _pack(start[firsts], n, REPEAT), tie[firsts]


def _ranked(rows: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Rows in order of (k, h, doc, at), where a new k begins and where a new (k, h) begins."""
    order = np.lexsort((rows[3], rows[2], rows[1], rows[0]))
    rows = [row[order] for row in rows]
    new_k = np.concatenate(([True], rows[0][1:] != rows[0][:-1]))
    return rows, new_k, new_k | np.concatenate(([True], rows[1][1:] != rows[1][:-1]))


def _later(rows: list[np.ndarray], new: np.ndarray) -> np.ndarray:
    """Rows at a later place than the first of their (k, h). Rows at the very same place are no repeats of each other."""
    first = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
    return (rows[2] != rows[2][first]) | (rows[3] >> PLACE_BITS != rows[3][first] >> PLACE_BITS)


def _dealt_anyhow(doc: np.ndarray, at: np.ndarray, tie: np.ndarray) -> list[np.ndarray]:
    """Settled places, to be dealt out evenly."""
    return [_mixed(doc.view(U64) * U64(31) + at.view(U64)), np.zeros(len(doc), U64), doc, at, tie]


def _joined(chunks: Iterator[list[np.ndarray]]) -> Iterator[list[np.ndarray]]:
    """Chunks put together up to a bounded size."""
    waiting, size = [], 0
    for rows in chunks:
        waiting.append(rows)
        size += len(rows[0])
        if size >= CHUNK:
            yield [np.concatenate(row) for row in zip(*waiting)]
            waiting, size = [], 0
    if size:
        yield [np.concatenate(row) for row in zip(*waiting)]


def _settled_phrases(chunks: Iterator[list[np.ndarray]]) -> Iterator[list[np.ndarray]]:
    """Occurrences, with those marked and dealt out evenly that repeat inside their chunk.

    Triggers with very many phrases in a chunk are dealt out by phrase, but for two that tell the trigger's reducer.
    """
    for rows in _joined(chunks):
        rows, new_k, new = _ranked(rows)
        later = _later(rows, new)
        group = new_k.cumsum() - 1
        nth = new.cumsum()
        nth = nth - nth[np.flatnonzero(new_k)][group]
        crowded = (np.bincount(group, new)[group] > CROWD_IN_TASK) & ~later
        rows[3] = np.where(crowded, _kind(rows[3], CROWDED), rows[3])
        rows[0] = np.where(crowded & (nth >= 2), _mixed(rows[0] ^ rows[1]), rows[0])
        yield [row[~later] for row in rows]
        yield _dealt_anyhow(rows[2][later], _kind(rows[3][later], REPEAT), rows[4][later])


def _settled_suffixes(chunks: Iterator[list[np.ndarray]]) -> Iterator[list[np.ndarray]]:
    """Suffixes without those that repeat inside their chunk, whose places follow as ranges."""
    for rows in _joined(chunks):
        rows, _, new = _ranked(rows)
        later = _later(rows, new)
        yield [row[~later] for row in rows]
        yield _dealt_anyhow(*_ranges(rows[2][later], rows[3][later], rows[4][later]))


def _batch(rows: list, arrow: pa.Schema) -> Iterator[pa.RecordBatch]:
    if len(rows[0]):
        yield from batches_of(dict(zip(arrow.names, [rows[0].view(np.int64), rows[1].view(np.int64), *rows[2:]])), arrow)


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """doc, tie, bytes and whatever columns follow, row by row."""
    for batch in batches:
        text = batch.schema.get_field_index("text")
        columns = [batch.column(i).cast(pa.binary()) if i == text else batch.column(i) for i in range(batch.num_columns)]
        yield from zip(*[column.to_pylist() for column in columns])


def _merged(dealt: DataFrame, judge) -> DataFrame:
    """Deal rows by k, sort them within partitions, and let `judge` turn the batches into places."""
    arrow = arrow_schema(T.StructType.fromDDL(PLACES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for doc, at, tie in judge(batches):
            if len(doc):
                yield from batches_of({"doc": doc, "at": at, "tie": tie}, arrow)

    return dealt.repartition("k").sortWithinPartitions("k", "h", "doc", "at").mapInArrow(run, PLACES)


def _columns(batch: pa.RecordBatch) -> list[np.ndarray]:
    return [batch.column(i).to_numpy(zero_copy_only=False) for i in range(5)]


def _judged(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of whole triggers: the repeats, and the first occurrences whose trigger has other phrases."""
    rows, new_k, new = _ranked(rows)
    repeats = _later(rows, new) | (rows[3] & 3 == REPEAT)
    group = new_k.cumsum() - 1
    phrases = np.bincount(group, new)
    crowded = ((np.bincount(group, rows[3] & 3 == CROWDED) > 0) | (phrases > CROWD))[group]
    kind = np.where(repeats, REPEAT, np.where(crowded, CROWDED, SHARED))
    out = repeats | crowded | (phrases > 1)[group]
    return rows[2][out], _kind(rows[3], kind)[out], rows[4][out]


def _judge_phrases(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Whole triggers at a time. One with too many rows is passed on as crowded, row by row, with its last phrase's first row in mind."""
    waiting, first = None, None
    for batch in batches:
        rows = _columns(batch)
        if not len(rows[0]):
            continue
        if first is not None:
            same = rows[0] == first[0]
            crowd = [np.concatenate(([value], row[same])) for value, row in zip(first, rows)]
            new = np.concatenate(([True], crowd[1][1:] != crowd[1][:-1]))
            repeats = _later(crowd, new)
            yield crowd[2][1:], _kind(crowd[3], np.where(repeats, REPEAT, CROWDED))[1:], crowd[4][1:]
            rows = [row[~same] for row in rows]
            first = [row[np.flatnonzero(new)[-1]] for row in crowd] if not len(rows[0]) else None
            if not len(rows[0]):
                continue
        if waiting is not None:
            rows = [np.concatenate(pair) for pair in zip(waiting, rows)]
        whole = len(rows[0]) - int((rows[0] == rows[0][-1]).sum())
        if whole:
            yield _judged([row[:whole] for row in rows])
        waiting = [row[whole:] for row in rows]
        if len(waiting[0]) > CROWD:
            new = np.concatenate(([True], waiting[1][1:] != waiting[1][:-1]))
            repeats = _later(waiting, new) | (waiting[3] & 3 == REPEAT)
            yield waiting[2], _kind(waiting[3], np.where(repeats, REPEAT, CROWDED)), waiting[4]
            waiting, first = None, [row[np.flatnonzero(new)[-1]] for row in waiting]
    if waiting is not None:
        yield _judged(waiting)


def _judge_suffixes(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Places of all but the first of equal suffixes: of the phrases of whole triggers, and of suffixes that came alone."""
    phrases, first = [], None

    def of_phrases(listed: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        found = list(_suffixes(((doc, tie, text, at) for _, doc, at, tie, text in listed), length))
        rows, _, new = _ranked([np.concatenate(row) for row in zip(*found)])
        later = _later(rows, new)
        return _ranges(rows[2][later], rows[3][later], rows[4][later])

    for batch in batches:
        rows, texts = _columns(batch), batch.column(5)
        alone = texts.is_null().to_numpy(zero_copy_only=False)
        if not alone.all():
            at = np.flatnonzero(~alone)
            phrases += zip(*[rows[i][at].tolist() for i in (0, 2, 3, 4)], texts.take(pa.array(at)).to_pylist())
            last = phrases[-1][0]
            whole = next((i for i in range(len(phrases) - 1, -1, -1) if phrases[i][0] != last), -1) + 1
            if whole:
                yield of_phrases(phrases[:whole])
                del phrases[:whole]
        rows = [row[alone] for row in rows]
        settled = rows[3] & 3 == REPEAT
        yield rows[2][settled], rows[3][settled], rows[4][settled]
        rows = [row[~settled] for row in rows]
        if len(rows[0]):
            if first is not None:
                rows = [np.concatenate(([value], row)) for value, row in zip(first, rows)]
            new = np.concatenate(([True], (rows[0][1:] != rows[0][:-1]) | (rows[1][1:] != rows[1][:-1])))
            later = _later(rows, new)
            yield _ranges(rows[2][later], rows[3][later], rows[4][later])
            first = [row[np.flatnonzero(new)[-1]] for row in rows]
    if phrases:
        yield of_phrases(phrases)


def _listed(places: DataFrame) -> DataFrame:
    """The packed places of each document in a list, which is bounded by the length of its text."""
    return places.groupBy(F.col("doc").alias("of_doc"), F.col("tie").alias("of_tie")).agg(F.collect_list("at").alias("places"))


def _repeats(frame: DataFrame, length: int) -> DataFrame:
    """`frame` (doc, tie, text and others) with the list `places` of repeated string starts; null where there are none."""
    arrow, with_text = (arrow_schema(T.StructType.fromDDL(schema)) for schema in (SCHEMA, WITH_TEXT))

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _settled_phrases(_phrases(_texts(batches), length)):
            yield from _batch(rows, arrow)

    def dictionary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Shared phrases with their texts, under their triggers; crowded ones as suffixes."""
        for batch in batches:
            rows = list(_texts(iter([batch])))
            for segment, first, _, doc, tie, _, others in _segments(_listed_phrases(iter(rows), length, (SHARED,)), length):
                at, texts = zip(*others)
                yield from batches_of({"k": segment.least[first].view(np.int64), "h": np.zeros(len(doc), np.int64), "doc": doc, "at": list(at), "tie": tie, "text": list(texts)}, with_text)
            for found in _settled_suffixes(_suffixes(_listed_phrases(iter(rows), length, (CROWDED,)), length)):
                yield from _batch([*found, [None] * len(found[0])], with_text)

    places = stage(_merged(frame.select("doc", "tie", "text").mapInArrow(parse, SCHEMA), _judge_phrases), name="places")
    settled = F.col("at").bitwiseAND(3) == REPEAT
    open_phrases = frame.join(_listed(places.filter(~settled)), [F.col("doc") == F.col("of_doc"), F.col("tie") == F.col("of_tie")])
    suffixes = _merged(open_phrases.select("doc", "tie", "text", "places").mapInArrow(dictionary, WITH_TEXT), lambda batches: _judge_suffixes(batches, length))
    found = _listed(places.filter(settled).unionByName(suffixes))
    return frame.join(found, [F.col("doc") == F.col("of_doc"), F.col("tie") == F.col("of_tie")], "left").drop("of_doc", "of_tie")


def removed_spans(places: list[int] | None, length: int) -> list[tuple[int, int]]:
    """Maximal runs of bytes that the repeated strings cover."""
    if not places:
        return []
    start, n, _ = _unpack(np.sort(np.array(places, np.int64)))
    end = np.maximum.accumulate(start + n - 1 + length)
    new = np.flatnonzero(np.concatenate(([True], start[1:] > end[:-1])))
    return list(zip(start[new].tolist(), end[np.concatenate((new[1:] - 1, [len(end) - 1]))].tolist()))


def _kept_text(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    edges = [0, *[edge for span in spans for edge in span], len(text)]
    return b"".join([text[a:b] for a, b in zip(edges[::2], edges[1::2])])


def _marks(key: str, text: str) -> list[Column]:
    """Non-null doc, tie and text; the tie is a 64-bit hash that tells texts under one key apart."""
    whole = F.coalesce(F.col(text), F.lit(""))
    return [F.coalesce(F.col(key).cast("long"), F.lit(NO_KEY)).alias("doc"), F.xxhash64(whole).alias("tie"), whole.alias("text")]


def find_repeats(docs: DataFrame, length: int = 100, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_bytes, n_removed, n_spans and kept_sha256 of every row.

    A byte is removed if a string of `length` bytes covers it that also starts earlier: under a smaller key, or under
    the same key at an earlier byte. Null texts are empty, null keys are one key after all others. Rows with the same key
    and text are no repeats of each other and share their result; texts under one key are told apart by 64 bits of hash. Keys are whole numbers below 2**63 - 1. Other columns
    are not read. An empty table gives an empty result.
    """
    if length < 8:
        raise ValueError("strings of at least 8 bytes")
    schema = T.StructType([T.StructField(key, docs.schema[key].dataType), *[T.StructField(name, T.LongType()) for name in ("n_bytes", "n_removed", "n_spans")], T.StructField("kept_sha256", T.StringType())])
    arrow = arrow_schema(schema)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, _, whole, places in _texts(iter([batch])):
                spans = removed_spans(places, length)
                rows.append((None if doc == NO_KEY else doc, len(whole), sum(b - a for a, b in spans), len(spans), hashlib.sha256(_kept_text(whole, spans)).hexdigest()))
            if rows:
                yield from batches_of(dict(zip(arrow.names, map(list, zip(*rows)))), arrow)

    return _repeats(docs.select(*_marks(key, text)), length).select("doc", "tie", "text", "places").mapInArrow(digest, schema)


def remove_repeats(docs: DataFrame, length: int = 100, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents without their repeated bytes, in the same columns. A sign cut in the middle goes as a whole.

    Texts without a repeat stay as they are, null ones too. Everything else as in `find_repeats`.
    """
    others = F.struct(*[F.col(f"`{name}`") for name in docs.columns if name != text], F.col(text).isNull().alias("without text"))
    found = _repeats(docs.select(*_marks(key, text), others.alias("row")), length)

    @F.udf("string", useArrow=True)
    def cut(value, places):
        return value if places is None else _kept_text(value.encode(), removed_spans(places, length)).decode(errors="ignore")

    new_text = F.when(~F.col("row.`without text`"), cut("text", "places"))
    return found.select(*[(new_text if name == text else F.col(f"row.`{name}`")).alias(name) for name in docs.columns])
