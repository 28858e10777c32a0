"""Licence scans: Aho-Corasick automata find notices and tags, a shunting-yard parser reads expressions.

Texts are lower-cased (A-Z only) and cut into words; an automaton runs over the words joined by single
spaces, so a phrase is found wherever its words stand consecutively. Another finds the identifier tags in
the text itself; the expression behind a tag (``and``, ``or``, ``with``, brackets) is evaluated to the licences
that it names and to those that bind whichever alternative is taken (``required``, which notices always are).
An expression ends with its line, at anything that is neither identifier, bracket nor blank (the end of a comment, a
comma, a colon), at a full stop, and where a word behind an operator is no identifier: one of a known family, with a
digit or hyphen, or in ONE_WORD. One Arrow map, no shuffle.

Null and empty texts have no words and no labels. Repeated rows get a result each; labels are sorted, so
ties have no say; texts are read whole, in time linear in their length; an empty table gives no rows. No
column of the input but id and text is read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timelode.llm.common import picked

BASE_PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: Notices that the method knows besides: phrase, label.
NOTICES = {
    "gnu general public license": "gpl",
    "gnu general public license version 2": "gpl-2",
    "gnu general public license version 3": "gpl-3",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license version 2 0": "mpl-2",
    "redistribution and use in source and binary forms": "bsd",
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "permission to use copy modify and or distribute this software for any purpose": "isc",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "all rights reserved": "proprietary",
}
#: Tags in front of an expression; they are looked for in the text itself.
TAGS = ("spdx-license-identifier:", "spdx-licence-identifier:")
#: Families of identifiers: the label for an identifier that starts so.
FAMILIES = {"mit": "mit", "apache-2": "apache-2", "cc-by-nc": "cc-by-nc", "gpl-2": "gpl-2", "gpl-3": "gpl-3", "lgpl": "lgpl", "agpl": "agpl", "mpl-2": "mpl-2", "bsd": "bsd", "isc": "isc", "unlicense": "unlicense"}
PRECEDENCE = {"or": 1, "and": 2, "with": 3}
#: Identifiers of one word without a digit that are no family; fixed values of the public list of licence identifiers.
ONE_WORD = frozenset("aladdin beerware curl eupl gfdl ijg imlib info-zip intel json libpng libtiff ncsa nokia openssl php postgresql python qpl ruby sissl sleepycat tcl vim wtfpl xnet zed zend zlib none noassertion".split())
TOKEN = re.compile(rb"[ \t]*([()]|[a-z0-9][a-z0-9.+-]*+(?!:))")

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_WORDS = bytes(c if 48 <= (c := _LOWER[b]) <= 57 or 97 <= c <= 122 or c >= 128 else 32 for b in range(256))


@lru_cache(1)
def automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for phrase, label in BASE_PHRASES.items():
        found.add_word(f" {phrase} ", (len(phrase), label, True))
    for phrase, label in NOTICES.items():
        found.add_word(f" {phrase} ", (len(phrase), label, False))
    found.make_automaton()
    return found


@lru_cache(1)
def tag_automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for tag in TAGS:
        found.add_word(tag, tag)
    found.make_automaton()
    return found


def family(identifier: str) -> str:
    return next((v for k, v in FAMILIES.items() if identifier.startswith(k)), identifier)


def tokens(line: bytes, start: int = 0, end: int | None = None, in_text: bool = False) -> Iterator[str]:
    """The tokens that follow one another from `start`, found as they are asked for; a full stop ends them, as does what is no token.

    in_text: running text may follow, so a word behind an operator that is no identifier ends them too.
    """
    end, before = len(line) if end is None else end, ""
    while m := TOKEN.match(line, start, end):
        word = m[1].decode()
        token = word.rstrip(".")
        if in_text and before in PRECEDENCE and before != "with" and token not in PRECEDENCE and word not in "()" and not identifier(token):
            return
        yield token
        if token != word:
            return
        before, start = token, m.end()


def identifier(token: str) -> bool:
    """Whether a word behind an operator is one."""
    return token in ONE_WORD or any(c.isdigit() or c == "-" for c in token) or family(token) != token or token in FAMILIES


def postfix(expression: str | Iterator[str]) -> list[str]:
    """Shunting-yard: the expression's identifiers and operators in postfix order, up to the first token that does not fit."""
    out: list[str] = []
    stack: list[str] = []
    operand = True  # what is expected next
    for token in tokens(expression.encode()) if isinstance(expression, str) else expression:
        if token == "(":
            if not operand:
                break
            stack.append(token)
        elif token == ")":
            if operand or "(" not in stack:
                break
            while (top := stack.pop()) != "(":
                out.append(top)
        elif token in PRECEDENCE:
            if operand:
                break
            while stack and stack[-1] != "(" and PRECEDENCE[stack[-1]] >= PRECEDENCE[token]:
                out.append(stack.pop())
            stack.append(token)
            operand = True
        elif operand:
            out.append(token)
            operand = False
        else:
            break
    return out + [t for t in reversed(stack) if t != "("]


def evaluate(expression: str | Iterator[str]) -> tuple[set[str], set[str]]:
    """The licences that an expression names, and those that bind whichever alternative is taken.

    ``and`` binds both sides, ``or`` only what both sides bind; exceptions behind ``with`` are no licences.
    Operands are joined in place, the smaller into the larger, as long expressions name many.
    """
    stack: list[tuple[set[str], set[str]]] = []
    for token in postfix(expression):
        if token not in PRECEDENCE:
            label = family(token.rstrip(".+"))
            stack.append(({label}, {label}))
        elif len(stack) >= 2:
            right, left = stack.pop(), stack.pop()
            if token != "with":
                binding = _joined(left[1], right[1]) if token == "and" else left[1] & right[1]
                left = (_joined(left[0], right[0]), binding)
            stack.append(left)
    # an expression that breaks off in an operator leaves several operands
    return (set().union(*(s[0] for s in stack)), set().union(*(s[1] for s in stack)))


def _joined(one: set[str], other: set[str]) -> set[str]:
    more, less = (one, other) if len(one) >= len(other) else (other, one)
    more |= less
    return more


def expressions(raw: bytes) -> tuple[set[str], set[str]]:
    """What the tagged expressions of a text name and bind; each ends with its line or where a token does not fit."""
    named: set[str] = set()
    bound: set[str] = set()
    line_end = -1
    for at, _ in tag_automaton().iter(raw.decode("latin-1")):
        if line_end <= at:
            line_end = end if (end := raw.find(b"\n", at)) >= 0 else len(raw)
        names, binding = evaluate(tokens(raw, at + 1, line_end, in_text=True))
        named |= names
        bound |= binding
    return named, bound


def scan(text: bytes | None) -> dict:
    """Words, places of the base phrases, labels and the score of one text."""
    raw = text or b""
    words = raw.translate(_WORDS).split()
    joined = f" {b' '.join(words).decode('utf-8', 'replace')} "
    starts, base, more = [], set(), set()
    for end, (length, label, is_base) in automaton().iter(joined):
        if is_base:
            starts.append(end - length)
            base.add(label)
        else:
            more.add(label)
    for general in ("gpl", "lgpl", "agpl"):
        if any(x.startswith(f"{general}-") for x in more):
            more.discard(general)
    named, bound = expressions(raw.translate(_LOWER)) if b":" in raw else (set(), set())
    labels = base | more | named
    places = sorted(joined.count(" ", 1, s) for s in (min(starts), max(starts))) if starts else [None, None]
    return {
        "n_words": len(words), "n_base": len(starts), "first_word": places[0], "last_word": places[1],
        "base_labels": sorted(base), "labels": sorted(labels), "required": sorted(base | more | bound),
        "score": 1.0 if named else 0.9 if base else 0.7 if labels else 0.0,
    }


_SCHEMA = pa.schema([("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.list_(pa.string())), ("labels", pa.list_(pa.string())), ("required", pa.list_(pa.string())), ("score", pa.float64())])
_DDL = "n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels array<string>, labels array<string>, required array<string>, score double"


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = pa.RecordBatch.from_pylist([scan(t.as_py()) for t in batch.column("text")], schema=_SCHEMA)
        yield pa.RecordBatch.from_arrays([batch.column("id"), *rows.columns], ["id", *_SCHEMA.names])


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row with word count, places of base phrases, labels and score; null text counts as empty."""
    kind = docs.schema[id_col].dataType.simpleString()
    return picked(docs, id=id_col, text=F.col(f"`{text_col}`").cast("binary")).mapInArrow(_scan, f"id {kind}, {_DDL}").withColumnRenamed("id", id_col)


def op9_licenses(spark, sf_dir: str) -> DataFrame:
    found = scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.withColumns({c: F.array_join(c, ",") for c in ("base_labels", "labels", "required")})
