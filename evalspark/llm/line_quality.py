"""Quality rules of a text and of its lines among the documents of its host.

A line that many documents of one host share is boilerplate. Lines are normalised and hashed, the distinct documents of
each line are counted per host, lines above the limits are removed, and a document that loses most of its words to them
is rejected. Everything is built of DataFrame functions. Texts are read once: what the later steps need is written as
one narrow row per document, with the hashes and word counts of its lines.
"""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalspark.staging import stage

BLANK = r"[\x20\x09-\x0D]+"
BLANKS = " \t\n\x0b\x0c\r"
SYMBOLS = "[#*$%&|<>]+"
LEAST_WORDS = 50
MOST_REPEATED_PERCENT = 50


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    trimmed = F.btrim(text, F.lit(BLANKS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, BLANK))


def lines_of(text: Column) -> Column:
    """Lines that have a word."""
    return F.filter(F.split(text, "\n"), lambda line: F.btrim(line, F.lit(BLANKS)) != "")


def _covered(windows: Column) -> Column:
    """Words in any of the windows (hash per place) that occur twice or more.

    Hashes are sorted with their places, so equal ones are neighbours; then each place adds the words that the one
    before it has not covered.
    """
    def repeated(pairs: Column) -> Column:
        def has_equal(pair: Column, i: Column) -> Column:
            before = (i > 0) & (F.get(pairs, i - 1)["h"] == pair["h"])
            after = (i + 1 < F.size(pairs)) & (F.get(pairs, i + 1)["h"] == pair["h"])
            return before | after

        return F.sort_array(F.transform(F.filter(pairs, has_equal), lambda pair: pair["at"]))

    start = F.struct(F.lit(-3).alias("last"), F.lit(0).alias("n"))
    add = lambda seen, at: F.struct(at.alias("last"), (seen["n"] + F.least(F.lit(3), at - seen["last"])).alias("n"))
    pairs = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("at"))))
    return F.aggregate(let(pairs, repeated), start, add, lambda seen: seen["n"])


def repeated_words(words: Column) -> Column:
    """Words in windows of three words that are found twice or more in the text."""
    hashed = F.transform(words, lambda word: F.xxhash64(word))
    windows = let(hashed, lambda h: F.transform(F.sequence(F.lit(0), F.size(h) - 3), lambda i: F.xxhash64(F.get(h, i), F.get(h, i + 1), F.get(h, i + 2))))
    counted = let(windows, lambda w: F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0)).otherwise(_covered(w)))
    return F.when(F.size(words) < 4, F.lit(0)).otherwise(counted)


def line_key(line: Column) -> Column:
    """Hash of a line in lower case, trimmed, with single blanks."""
    return F.xxhash64(F.lower(F.regexp_replace(F.btrim(line, F.lit(BLANKS)), BLANK, " ")))


def measured(docs: DataFrame, key: str, text: str, host: str) -> DataFrame:
    """One row per document: row, key, host, the base measures, and hash and words of each line. No text."""
    with_words = docs.select(
        F.monotonically_increasing_id().alias("row"),
        F.col(key).alias("key"),
        F.coalesce(F.col(host).cast("string"), F.lit("")).alias("host"),
        F.coalesce(F.col(text), F.lit("")).alias("text"),
    )

    def measures(words: Column) -> Column:
        return F.struct(
            F.size(words).cast("long").alias("n_words"),
            F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
            repeated_words(words).cast("long").alias("n_repeat_words"),
        )

    def of_lines(lines: Column) -> Column:
        return F.struct(
            (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
            F.transform(lines, lambda line: F.struct(line_key(line).alias("h"), F.size(words_of(line)).alias("words"))).alias("lines"),
        )

    symbols = F.length("text") - F.length(F.regexp_replace("text", SYMBOLS, ""))
    found = with_words.select("row", "key", "host", symbols.cast("long").alias("n_symbols"), let(words_of(F.col("text")), measures).alias("m"), let(lines_of(F.col("text")), of_lines).alias("l"))
    return found.select("row", "key", "host", "n_symbols", "m.*", "l.*")


def frequent_lines(lines: DataFrame, documents: DataFrame, least_documents: int, share: float) -> DataFrame:
    """(host, h) of lines (host, h, row) in more than `least_documents` and more than a share of the host's documents."""
    sizes = documents.groupBy(F.col("host").alias("of_host")).agg(F.count(F.lit(1)).alias("documents"))
    counts = lines.groupBy("host", "h").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > least_documents)
    above = counts.join(sizes, F.col("host") == F.col("of_host")).filter(F.col("n") > F.col("documents") * F.lit(share))
    return above.select(F.col("host").alias("frequent_host"), F.col("h").alias("frequent_h"))


def judge_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", host: str = "source", least_documents: int = 20, share: float = 0.01, kept_share: float = 0.5) -> DataFrame:
    """key, the base measures, base_failed, kept, removed_words and removed_lines (hashes, null if none) of every row.

    A line is removed if more than `least_documents` and more than `share` of the host's documents have it. A document
    is kept if its base rules hold and at least `kept_share` of its words remain. Each row counts as a document, also
    if it repeats another. Null texts are empty and fail the base rules; documents with a null host form one host.
    Other columns are not read. An empty table gives an empty result.
    """
    rows = stage(measured(docs, key, text, host), name="lines")
    listed = rows.select("row", "host", F.explode("lines").alias("line")).select("row", "host", "line.h", "line.words")
    lines = listed.groupBy("host", "h", "row").agg(F.sum("words").alias("words"))
    frequent = frequent_lines(lines, rows, least_documents, share)
    lost = lines.join(frequent, (F.col("host") == F.col("frequent_host")) & (F.col("h") == F.col("frequent_h")))
    lost = lost.groupBy(F.col("row").alias("of_row")).agg(F.sum("words").alias("removed"), F.collect_list("h").alias("removed_lines"))
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED_PERCENT * F.col("n_words"))
    removed = F.coalesce("removed", F.lit(0)).cast("long")
    full = F.col("n_words") - removed >= F.col("n_words") * F.lit(kept_share)
    joined = rows.drop("lines").join(lost, F.col("row") == F.col("of_row"), "left")
    measures = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return joined.select(F.col("key").alias(key), *measures, failed.alias("base_failed"), (~failed & full).alias("kept"), removed.alias("removed_words"), "removed_lines")


def without_lines(text: Column, removed: Column) -> Column:
    """The text without the lines whose hashes are listed; a null list removes none."""
    lines = F.filter(F.split(text, "\n"), lambda line: ~F.array_contains(removed, line_key(line)))
    return F.when(removed.isNull(), text).otherwise(F.array_join(lines, "\n"))
