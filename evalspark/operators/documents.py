"""Text extraction by a function supplied by the caller."""

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, types as T

# Takes the bytes of a document, returns the texts of its pages.
Extractor = Callable[[bytes], Sequence[str]]

# Pages gathered before they are handed back to the JVM.
PAGES_PER_BATCH = 2_000

# Bytes of documents turned into Python objects at once, one document at least.
SLICE_BYTES = 4 << 20


def _schema(files: DataFrame, keys: Sequence[str], *fields: T.StructField) -> T.StructType:
    return T.StructType([files.schema[key] for key in keys] + list(fields))


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Runs of rows with a bounded size of content, which is the last column."""
    start, held = 0, 0
    for at, size in enumerate(pc.binary_length(batch.column(batch.num_columns - 1)).to_pylist()):
        if at > start and held + (size or 0) > SLICE_BYTES:
            yield batch.slice(start, at - start)
            start, held = at, 0
        held += size or 0
    if start < batch.num_rows:
        yield batch.slice(start)


def extract_documents(
    files: DataFrame, extractor: Extractor, keys: Sequence[str] = ("dataset_split", "file_name")
) -> DataFrame:
    """Pages as (keys, page, text, error). A failing document gives one row with its error."""
    names = [*keys, "page", "text", "error"]
    schema = _schema(
        files, keys, T.StructField("page", T.IntegerType()), T.StructField("text", T.StringType()),
        T.StructField("error", T.StringType()),
    )

    def pages(content: bytes) -> list[tuple]:
        try:
            return [(page, text, None) for page, text in enumerate(list(extractor(content)) or [""])]
        except Exception as failure:
            return [(None, None, f"{type(failure).__name__}: {failure}")]

    def found(part: pa.RecordBatch, of: list[int], done: list[tuple]) -> pa.RecordBatch:
        own = part.take(pa.array(of, pa.int64())).columns[:-1]
        page, text, error = zip(*done)
        return pa.RecordBatch.from_arrays(
            [*own, pa.array(page, pa.int32()), pa.array(text, pa.string()), pa.array(error, pa.string())], names=names
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _slices(batch):
                of, done = [], []
                for row, content in enumerate(part.columns[-1]):
                    new = pages(content.as_py())
                    of += [row] * len(new)
                    done += new
                    if len(done) >= PAGES_PER_BATCH:
                        yield found(part, of, done)
                        of, done = [], []
                if done:
                    yield found(part, of, done)

    return files.select(*keys, "content").mapInArrow(run, schema)


def extract_texts(
    files: DataFrame, extractor: Extractor, keys: Sequence[str] = ("dataset_split", "file_name")
) -> DataFrame:
    """Whole documents as (keys, text, error).

    The pages of a document come out of one call, so they are joined there and nothing is shuffled. A task holds the
    texts of ``SLICE_BYTES`` of documents at a time, or of one, beside the batch that Spark sends it.
    """
    schema = _schema(files, keys, T.StructField("text", T.StringType()), T.StructField("error", T.StringType()))

    def text(content: bytes) -> tuple[str | None, str | None]:
        try:
            return "".join(extractor(content)), None
        except Exception as failure:
            return None, f"{type(failure).__name__}: {failure}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _slices(batch):
                texts, errors = zip(*(text(content.as_py()) for content in part.columns[-1]))
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:-1], pa.array(texts, pa.string()), pa.array(errors, pa.string())],
                    names=[*keys, "text", "error"],
                )

    return files.select(*keys, "content").mapInArrow(run, schema)
