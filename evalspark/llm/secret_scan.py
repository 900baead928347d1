"""Secrets in texts, by lexing what source code and configuration assign to which name.

A text is read for pairs of a name and an expression: `name = "x"`, `"name": "x"`, `name: x`, `env["name"] = x`,
`name => 'x'`, `set_name("x")`, `--name x`, `<name>x</name>`, `key="name" value="x"` and `scheme://user:x@host`. An expression
is made of literals and of names of other pairs. What a name is worth as a secret (by its words) flows back along
those names to the pairs that define them, so a constant with a harmless name is found where a sensitive one takes it.
A literal is a secret if the worth of the names it reaches, times how much it looks like a drawn value, is enough.
Beside these, three fixed patterns are searched as they are.
"""

import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evalspark.llm.common import arrow_schema, batches_of, texts_of

# In the order in which spans with the same start are listed. The first three are the fixed patterns.
KINDS = ["assign", "access", "hex", "literal", "constant"]
BASE = KINDS[:3]

# The case of letters is that of ASCII: no other signs count as an s or a k.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")

SPAN = T.StructType([
    T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()),
    T.StructField("name", T.StringType()), T.StructField("score", T.DoubleType()),
])


class Span(NamedTuple):
    kind: str
    start: int
    end: int
    name: str | None
    score: float


def base_spans(text: str) -> list[Span]:
    """Matches of the fixed patterns, leftmost and not overlapping within a kind; matches that are too short are dropped."""
    found = [Span("assign", *m.span(), m[1], 1.0) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    found += [Span("access", *m.span(), None, 1.0) for m in ACCESS.finditer(text) if len(m[0]) >= 16]
    return found + [Span("hex", *m.span(), None, 1.0) for m in HEX.finditer(text)]


# Worth of names and literals

SENSITIVE = {
    "password": 1.0, "passwd": 1.0, "pwd": 1.0, "passphrase": 1.0, "passcode": 1.0, "secret": 1.0, "secrets": 1.0,
    "token": 1.0, "apikey": 1.0, "credential": 0.9, "credentials": 0.9, "bearer": 0.9, "authorization": 0.9,
    "pass": 0.8, "auth": 0.7, "otp": 0.6, "pin": 0.6, "salt": 0.6, "signature": 0.6, "key": 0.55,
}
KEY_OF = {"api", "access", "private", "signing", "encryption", "master", "account", "shared", "auth", "storage"}
ABOUT = {
    "length", "len", "count", "size", "file", "path", "dir", "url", "uri", "endpoint", "name", "id", "field", "type", "hint",
    "label", "regex", "pattern", "policy", "expiry", "expires", "ttl", "timeout", "prefix", "header", "limit", "min", "max",
    "index", "column", "param", "form", "page", "reset", "error", "message", "required", "enabled", "placeholder",
}
WORDS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")


@lru_cache(maxsize=65_536)
def name_worth(name: str) -> float:
    """0 to 1: the most sensitive word of a name; much less if a later word says that it is only about a secret."""
    words = [word.lower() for word in WORDS.findall(name)]
    best = 0.0
    for at, word in enumerate(words):
        worth = SENSITIVE.get(word, 0.0)
        if word == "key" and at and words[at - 1] in KEY_OF:
            worth = 1.0
        if worth and not ABOUT.isdisjoint(words[at + 1:]):
            worth *= 0.2
        best = max(best, worth)
    return best


DUMMY = re.compile(
    r"(.)\1*|<.*>|\[.*\]|\{.*\}|\$.*|%.*%|.*(?:example|change.?me|placeholder|dummy|sample|redacted|your[_-]).*"
    r"|none|null|nil|true|false|undefined|required|optional|[A-Za-z_]\w*(?:\.[A-Za-z_]\w*)+(?:\(.*)?|[A-Z]+(?:_[A-Z]+)+|(?:\.{0,2}/)?[\w.-]+(?:/[\w.-]+)+\.\w{1,5}|https?://[^@]*",
    re.I | re.S,
)


def literal_worth(value: str, quoted: bool) -> float:
    """0 to 1: how much a literal looks like a drawn value, by the bits its signs carry. Words of letters count less."""
    if not 6 <= len(value) <= 4096 or any(c.isspace() for c in value) or DUMMY.fullmatch(value):
        return 0.0
    bits = sum(-n * math.log2(n / len(value)) for n in Counter(value).values())
    plain = value.isalpha() and (value.islower() or value.istitle() or value.isupper())
    return min(1.0, bits / 40) * ((0.7 if quoted else 0.4) if plain else 1.0)


# Pairs of names and expressions

MARK = re.compile(r"[=:(]")
# What stands before an operator, read from right to left.
LEFT = re.compile(
    r"""[ \t]*(?:\][ ]*["'`](?P<of>[^"'`\n]{1,128})["'`][ ]*\[|["'`](?P<quoted>[^"'`\n]{1,128})["'`]"""
    r"""|(?P<type>[\w.?*&\]\[]{1,64})[ ]*:[ ]*(?P<typed>[\w$]{1,128})(?![\w"'])|(?P<go>gnirts)[ ]+(?P<bare_go>[\w$]{1,128})[ ]+(?:rav|tsnoc)\b|(?P<bare>[\w$.-]{1,128}))"""
)
# No pattern looks back over what it has passed, and none that may fail looks further than the next of its end signs.
STRING = re.compile(
    r'''[A-Za-z@$]{0,2}(?:"""(?P<a>.*?)"""|\'\'\'(?P<b>.*?)\'\'\'|"(?P<c>(?:[^"\\\n]++|\\.)*+)"|'(?P<d>(?:[^'\\\n]++|\\.)*+)'|`(?P<e>[^`]*+)`)''', re.S
)
REFERENCE = re.compile(
    r"\$\{\{?[ ]{0,8}([\w.-]{1,128})[^}\n]{0,256}\}|\$\(?([\w.]{1,128})\)?|\{\{[ ]{0,8}([\w.-]{1,128})[ ]{0,8}\}\}|%\(([\w.]{1,128})\)s|%([\w.]{1,128})%"
)
BARE = re.compile(r"""[^\s"'`,;(){}\[\]<>=]{1,4096}={0,2}""")
JOIN = re.compile(r"""\s*(?:\+|\.\.|\.(?=\s*["'])|\|\||\?\?|\bor\b)\s*|[ \t]+(?=["'])""")
NEXT, SPACE, ARGUMENT = re.compile(r"[, ]*"), re.compile(r"\s*"), re.compile(r"([\w.]+)(?=[),])[, ]*")
SCHEME = re.compile(r"(?:bearer|basic|token|apikey)[ \t]+", re.I)
USERINFO = re.compile(r"//[^\s/@:\"']*:([^\s/@\"']+)@")
ELEMENT = re.compile(r"<([\w.:-]{1,128})(?:\s[^<>\n]{0,256})?>([^<>\n]+)</")
ATTRIBUTES = re.compile(r"""\b(?:key|name)\s*=\s*["']([^"'\n]{1,128})["']\s+value\s*=\s*["']([^"'\n]*)["']""")
FLAG = re.compile(r"""--([A-Za-z][\w-]{0,127})[ \t]+(["']?)([^\s"'-][^\s"']*)\2""")


class Pair(NamedTuple):
    """A name, what is assigned to it as (start, end, quoted), and the names in the expression."""

    at: int
    name: str
    literals: list[tuple[int, int, bool]]
    names: list[str]


def _expression(text: str, at: int, bare: bool) -> tuple[list[tuple[int, int, bool]], list[str]]:
    """Literals and names of the expression at a place. Bare words are taken as names too; as literals if `bare` says so."""
    literals, names = [], []
    while True:
        if string := STRING.match(text, at):
            start, end = string.span(string.lastgroup)
            if inner := REFERENCE.fullmatch(text, start, end):
                names.append(next(filter(None, inner.groups())))
            elif end > start:
                literals.append((start, end, True))
            at = string.end()
        elif inner := REFERENCE.match(text, at):
            names.append(next(filter(None, inner.groups())))
            at = inner.end()
        elif word := BARE.match(text, at):
            at = word.end()
            if text[at:at + 1] == "(":
                # The strings that a call takes, up to its end or the end of the line.
                at += 1
                while argument := STRING.match(text, at):
                    literals.append((*argument.span(argument.lastgroup), True))
                    at = NEXT.match(text, argument.end()).end()
                while inner := ARGUMENT.match(text, at):
                    names.append(inner[1])
                    at = inner.end()
                at += text[at:at + 1] == ")"
            else:
                value = word[0].rstrip(".:!?")
                names.append(value.lstrip("*&$"))
                if bare:
                    literals.append((word.start(), word.start() + len(value), False))
        else:
            break
        if not (joined := JOIN.match(text, at)):
            break
        at = joined.end()
    return literals, names


def _left_name(text: str, at: int) -> str | None:
    """The name that an operator at a place assigns to."""
    before = LEFT.match(text[max(0, at - 200):at][::-1])
    if not before:
        return None
    of = before["of"] or before["quoted"] or before["typed"] or before["bare_go"] or before["bare"]
    return of[::-1].lstrip("-").strip(".$") or None


def pairs_of(text: str) -> list[Pair]:
    """All pairs of a text, in the order of their places."""
    found = [Pair(m.start(), m[1], [(*m.span(2), True)], []) for m in (*ELEMENT.finditer(text), *ATTRIBUTES.finditer(text))]
    found += [Pair(m.start(), m[1], [(*m.span(3), bool(m[2]))], []) for m in FLAG.finditer(text)]
    for mark in MARK.finditer(text):
        at, sign = mark.span()[0], mark[0]
        ahead, behind = text[at + 1:at + 2], text[at - 1:at] if at else ""
        left, right = at, at + 1
        if sign == ":" and ahead == "/" and (inside := USERINFO.match(text, right)):
            found.append(Pair(at, "password", [(*inside.span(1), False)], []))
            continue
        if sign == "(":
            name = _left_name(text, at) if behind and (behind.isalnum() or behind == "_") else None
            start = SPACE.match(text, right).end()
            if name and name_worth(name):
                literals, names = _expression(text, start, False)
                found += [Pair(at, name, literals, names)] if literals or names else []
            continue
        if ahead in ("=", ":", "/") or behind and behind in "=!<>:" and not (sign == "=" and behind == ":"):
            continue
        if sign == ":" and ahead not in (" ", "\t", '"', "'"):
            continue
        if sign == "=":
            right += ahead == ">"
            left -= len(behind) if behind and behind in ":?+|&" else 0
        name = _left_name(text, left)
        if name is None:
            continue
        while text[right:right + 1] in (" ", "\t"):
            right += 1
        if scheme := SCHEME.match(text, right):
            right = scheme.end()
        # A bare word is a value in configuration; in prose after a colon it is only looked at for a sensitive name.
        literals, names = _expression(text, right, bool(name_worth(name)) or sign == "=")
        if literals or names:
            found.append(Pair(at, name, literals, names))
    return sorted(found, key=lambda pair: pair.at)


def flows(pairs: list[Pair]) -> list[tuple[float, str]]:
    """For each pair the worth of the most sensitive name that its literals reach, and this name.

    A name in an expression is the pair before that defines it last, or else the first one after. Pairs are visited
    from the most sensitive ones back to what they take, each once.
    """
    defined: dict[str, list[int]] = {}
    for at, pair in enumerate(pairs):
        defined.setdefault(pair.name.rpartition(".")[2], []).append(at)
    seen: dict[str, int] = {}
    takes: list[list[int]] = []
    for at, pair in enumerate(pairs):
        takes.append([])
        for name in {name.rpartition(".")[2] for name in pair.names}:
            if name in defined:
                takes[at].append(seen.get(name, defined[name][0]))
        seen[pair.name.rpartition(".")[2]] = at
    own = [name_worth(pair.name) for pair in pairs]
    reached: list[tuple[float, str]] = [(0.0, "")] * len(pairs)
    for at in sorted(range(len(pairs)), key=lambda i: (-own[i], i)):
        stack, worth = [at], (own[at], pairs[at].name)
        while stack and worth[0]:
            here = stack.pop()
            if not reached[here][0]:
                reached[here] = worth
                stack += takes[here]
    return reached


def secret_spans(text: str, least: float = 0.5) -> list[Span]:
    """Spans of all fixed patterns, and of the literals whose score is `least` or more and that no base span covers."""
    base = base_spans(text)
    pairs = pairs_of(text)
    names = {pair.name.rpartition(".")[2] for pair in pairs}
    best: dict[tuple[int, int], Span] = {}
    for pair, (worth, name) in zip(pairs, flows(pairs)):
        for start, end, quoted in pair.literals if worth else ():
            value = text[start:end]
            if not quoted and value.rpartition(".")[2] in names:
                continue  # the name of a constant
            score = worth * literal_worth(value, quoted)
            if score >= least and score > best.get((start, end), Span("", 0, 0, "", 0.0)).score:
                best[start, end] = Span("literal" if name_worth(pair.name) >= worth else "constant", start, end, name, score)
    added, covered = [], sorted((s.start, s.end) for s in base)
    at, reach = 0, -1
    for key in sorted(best):
        while at < len(covered) and covered[at][0] <= key[0]:
            reach = max(reach, covered[at][1])
            at += 1
        if key[1] > reach:
            added.append(best[key])
    return sorted(base + added, key=lambda s: (s.start, KINDS.index(s.kind), s.end))


# Tables

def find_secrets(docs: DataFrame, key: str = "doc_id", text: str = "text", least: float = 0.5) -> DataFrame:
    """(key, spans): of every row the spans as (kind, start, end, name, score), by start and then by kind.

    Places count code points, ends are exclusive. Kinds are assign, access and hex for the fixed patterns, literal for
    what a sensitive name is given, constant for what reaches one through other names. name is the sensitive one. Null
    and empty texts have no spans. Rows are read one by one, so null and repeated keys and equal texts are rows like
    any other; other columns are not read; an empty table gives no rows.
    """
    frame = docs.select(F.col(key).alias(key), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    schema = T.StructType([frame.schema[key], T.StructField("spans", T.ArrayType(SPAN))])
    arrow = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = [[span._asdict() for span in secret_spans(value, least)] for value in texts_of(batch, "_text")]
            yield from batches_of({arrow.field(0).name: batch.column(0), "spans": spans}, arrow)

    return frame.mapInArrow(run, schema)


def joined_spans(spans: Column, kinds: list[str] = KINDS) -> Column:
    """kind:start:end of the spans of some kinds, comma-joined."""
    chosen = F.filter(spans, lambda s: s["kind"].isin(kinds))
    return F.array_join(F.transform(chosen, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def masked_texts(docs: DataFrame, key: str = "doc_id", text: str = "text", least: float = 0.5, sign: str = "*") -> DataFrame:
    """(key, text): the texts with every code point of a secret replaced; null texts stay null."""
    frame = docs.select(F.col(key).alias(key), F.col(text).alias("text"))
    arrow = arrow_schema(frame.schema)

    def mask(value: str | None) -> str | None:
        if value is None:
            return None
        signs, at = [], 0
        for span in secret_spans(value, least):
            if span.end > at:
                signs += [value[at:max(at, span.start)], sign * (span.end - max(at, span.start))]
                at = span.end
        return "".join([*signs, value[at:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from batches_of({arrow.field(0).name: batch.column(0), "text": [mask(value) for value in texts_of(batch)]}, arrow)

    return frame.mapInArrow(run, frame.schema)


def scan_secrets(docs: DataFrame, key: str = "doc_id", text: str = "text", least: float = 0.5) -> DataFrame:
    """key, n_assign, n_access, n_hex, base_sha256 and spans of every row, derived from `find_secrets`, which see."""
    def number(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.sha2(joined_spans(F.col("spans"), BASE), 256).alias("base_sha256")
    return find_secrets(docs, key, text, least).select(key, *map(number, BASE), base, joined_spans(F.col("spans")).alias("spans"))
