"""Text helpers with Python's notion of whitespace."""

from collections.abc import Callable

from pyspark.sql import Column, functions as F

# The characters Python treats as whitespace.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# The same set as a pattern. Listing its characters in a class makes splitting five times slower.
WHITESPACE_RUN = r"(?U)[\s\x1c-\x1f]+"

# Longest answer kept.
MAX_SENTENCES = 10
MAX_WORDS = 200


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(WHITESPACE))


def is_blank(text: Column) -> Column:
    """True for null and for the empty text."""
    return F.coalesce(text, F.lit("")) == ""


def utf16_length(text: Column) -> Column:
    """Length in UTF-16 code units, the unit of bounded text columns in the source database."""
    return (F.octet_length(F.encode(text, "UTF-16BE")) / 2).cast("int")


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed a single time, however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def truncate_answer(answer: Column, max_sentences: int = MAX_SENTENCES, max_words: int = MAX_WORDS) -> Column:
    """Shorten an answer to a number of '.'-separated pieces, or of words when that also overflows.

    A split stops one piece past the limit, and a text too short to hold more words than allowed
    is not split into words at all.
    """
    def by_word(words: Column) -> Column:
        return F.when(
            F.size(words) > max_words, F.concat(F.array_join(F.slice(words, 1, max_words), " "), F.lit("..."))
        )

    def by_sentence(pieces: Column) -> Column:
        return F.when(
            F.size(pieces) > max_sentences,
            F.concat(F.array_join(F.slice(pieces, 1, max_sentences), ". "), F.lit(".")),
        )

    def shorten(text: Column) -> Column:
        words = _once(F.split(text, WHITESPACE_RUN, max_words + 1), by_word)
        pieces = _once(F.split(text, r"\.", max_sentences + 1), by_sentence)
        return F.coalesce(F.when(F.length(text) > 2 * max_words, words), pieces, text)

    return strip(_once(strip(answer), shorten))


def preview(text: Column, width: int = 50) -> Column:
    """Label of a question in a list: its first characters and always three dots."""
    return F.concat(F.substring(text, 1, width), F.lit("..."))
