"""Licence scans: Aho-Corasick over a text's words, and a shunting-yard parser for licence expressions."""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Phrases that every scan counts, and their labels (fixed values).
BASE_PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}
#: Further notice phrases, in words: names of licences and how their texts and notices begin.
NOTICE_PHRASES = {
    "released under the mit license": "mit",
    "licensed under the mit license": "mit",
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "permission to use copy modify and or distribute this software for any purpose with or without fee": "isc",
    "licensed under the apache license": "apache-2",
    "apache license version 2 0": "apache-2",
    "apache software license version 1 1": "apache-1.1",
    "gnu general public license version 3": "gpl-3",
    "gnu general public license as published by the free software foundation either version 3": "gpl-3",
    "gnu general public license version 2": "gpl-2",
    "gnu general public license as published by the free software foundation either version 2": "gpl-2",
    "gnu general public license": "gpl",
    "gnu lesser general public license": "lgpl",
    "gnu library general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "gnu free documentation license": "gfdl",
    "server side public license": "sspl",
    "redistribution and use in source and binary forms with or without modification are permitted": "bsd",
    "bsd 2 clause license": "bsd-2-clause",
    "bsd 3 clause license": "bsd-3-clause",
    "mozilla public license version 2": "mpl-2",
    "subject to the terms of the mozilla public license v 2 0": "mpl-2",
    "mozilla public license version 1 1": "mpl-1.1",
    "eclipse public license": "epl",
    "common development and distribution license": "cddl",
    "boost software license version 1 0": "bsl-1.0",
    "python software foundation license": "python",
    "this software is provided as is without any express or implied warranty": "zlib",
    "do what the fuck you want to public license": "wtfpl",
    "cc by sa": "cc-by-sa",
    "cc by nd": "cc-by-nd",
    "cc by 4 0": "cc-by",
    "creative commons attribution 4 0": "cc-by",
    "creative commons attribution sharealike": "cc-by-sa",
    "creative commons attribution noncommercial": "cc-by-nc",
    "creative commons attribution noderivatives": "cc-by-nd",
    "cc0 1 0 universal": "cc0",
    "no copyright reserved public domain dedication": "cc0",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "all rights reserved": "all-rights-reserved",
    "proprietary and confidential": "proprietary",
}
TAG_PHRASE = "spdx license identifier"
TAG = re.compile(r"spdx-license-identifier:[ \t]*([^\r\n]*)", re.IGNORECASE | re.ASCII)

#: How much an identifier's family asks of a user: 0 nothing, 1 notice, 2 file-level copyleft, 3 copyleft, 4 network copyleft or limits on use.
DUTIES = {"0bsd": 0, "cc0": 0, "unlicense": 0, "wtfpl": 0, "mit-0": 0, "pddl": 0, "afl": 1, "artistic": 1, "beerware": 1, "blueoak": 1, "bzip2": 1, "curl": 1, "ms-pl": 1, "mulanpsl": 1, "ncsa": 1, "ofl": 1, "openssl": 1, "php": 1, "postgresql": 1, "psf": 1, "ruby": 1, "unicode": 1, "upl": 1, "vim": 1, "w3c": 1, "x11": 1, "mit": 1, "isc": 1, "bsd": 1, "apache": 1, "zlib": 1, "bsl": 1, "cc-by": 1, "python": 1, "mpl": 2, "epl": 2, "lgpl": 2, "cddl": 2, "cpl": 2, "ms-rl": 2, "cecill": 3, "eupl": 3, "gfdl": 3, "gpl": 3, "cc-by-sa": 3, "agpl": 4, "osl": 4, "sspl": 4, "cc-by-nc": 4, "cc-by-nd": 4}
TERMS = ("terms-public-domain", "terms-notice", "terms-weak-copyleft", "terms-copyleft", "terms-restricted")

#: bytes of words as they are, A-Z lower-cased, other ASCII as a space
_WORDS = bytes(c if c >= 0x80 or chr(c).isalnum() else 0x20 for c in range(256)).lower()
_BINDING = {"or": 1, "and": 2, "with": 3}
_TOKEN = re.compile(r"[()]|[A-Za-z0-9][A-Za-z0-9.+:\-]*")
#: Exceptions that lift copyleft from what is linked or made with the work; others leave the duties as they are.
LIFTING = ("classpath-exception", "gcc-exception", "llvm-exception", "autoconf-exception", "bison-exception", "font-exception", "libtool-exception", "linking-exception", "openssl-exception", "gpl-cc", "linux-syscall-note", "ocaml-lgpl-linking-exception", "qt-gpl-exception", "universal-foss-exception", "wxwindows-exception")


class ExpressionError(ValueError):
    """The expression cannot be parsed."""


def to_postfix(tokens: list[str]) -> list[str]:
    """Shunting-yard: ids and operators of an expression in postfix order. ``with`` binds tightest, then ``and``, then ``or``."""
    out: list[str] = []
    stack: list[str] = []
    operand = False
    for t in tokens:
        if t == "(":
            if operand:
                raise ExpressionError("an operator is missing")
            stack.append(t)
        elif t == ")":
            if not operand:
                raise ExpressionError("an operand is missing")
            while stack and stack[-1] != "(":
                out.append(stack.pop())
            if not stack:
                raise ExpressionError("an opening bracket is missing")
            stack.pop()
        elif t in _BINDING:
            if not operand:
                raise ExpressionError("an operand is missing")
            while stack and stack[-1] != "(" and _BINDING[stack[-1]] >= _BINDING[t]:
                out.append(stack.pop())
            stack.append(t)
            operand = False
        else:
            if operand:
                raise ExpressionError("an operator is missing")
            out.append(t)
            operand = True
    if not operand:
        raise ExpressionError("an operand is missing")
    while stack:
        if stack[-1] == "(":
            raise ExpressionError("a closing bracket is missing")
        out.append(stack.pop())
    return out


def duty(identifier: str) -> int | None:
    """Rank of an identifier's family, by its longest known beginning."""
    found = [k for k in DUTIES if identifier == k or identifier.startswith(f"{k}-")]
    return DUTIES[max(found, key=len)] if found else None


def evaluate(tokens: list[str]) -> tuple[list[str], int | None]:
    """Identifiers of an expression, and its duties: of ``or`` the lighter side, of ``and`` the heavier; ``with`` a lifting exception takes one step off copyleft.

    Unknown identifiers leave duties unknown, except beside a known side of ``or``.
    """
    stack: list[tuple[list[str], int | None]] = []
    for t in to_postfix(tokens):
        if t not in _BINDING:
            stack.append(([t], duty(t)))
            continue
        (right, r), (left, x) = stack.pop(), stack.pop()
        if t == "with":
            stack.append((left, x - 1 if x in (2, 3) and right[0].startswith(LIFTING) else x))
        elif t == "or":
            known = [d for d in (x, r) if d is not None]
            stack.append((left + right, min(known) if known else None))
        else:
            stack.append((left + right, None if x is None or r is None else max(x, r)))
    return stack[0]


def _named(tokens: list[str]) -> bool:
    """Every id is a known licence's or exception's name, so that prose behind an expression is not taken for a part of it."""
    ids = [(t, k and tokens[k - 1] == "with") for k, t in enumerate(tokens) if t not in _BINDING and t not in "()"]
    return all(duty(t) is not None or t.startswith(("licenseref-", "documentref-")) or after_with and "exception" in t or t.startswith(LIFTING) for t, after_with in ids)


def longest_expression(line: str) -> tuple[str, list[str], int | None] | None:
    """The expression that a tag's line begins with, its identifiers and duties.

    It is the whole line if that can be parsed, else its longest beginning that can and names known
    licences alone. Full stops, commas and other signs end it.
    """
    found, at = [], 0
    for m in _TOKEN.finditer(line):
        if line[at : m.start()].strip():
            break
        token = m.group().rstrip(".:")
        found.append((token, m.start() + len(token)))
        at = m.end()
        if token != m.group():
            break
    whole = found and not line[found[-1][1] :].strip().strip("*/-> \t")
    for k in range(len(found), 0, -1):
        tokens = [t.lower() for t, _ in found[:k]]
        try:
            ids, rank = evaluate(tokens)
        except ExpressionError:
            continue
        if whole and k == len(found) or _named(tokens):
            return line[: found[k - 1][1]], ids, rank
    return None


def word_text(text: str) -> bytes:
    """The text's words, A-Z lower-cased, with a space before, between and after."""
    words = text.encode("utf-8", "surrogatepass").translate(_WORDS).split(b" ")
    return b" " + b" ".join(filter(None, words)) + b" "


def build_automaton() -> ahocorasick.Automaton:
    """Phrases as latin-1 strings with a space on either side, so that whole words match."""
    found: dict[str, tuple[str, str | None]] = {p: ("notice", x) for p, x in NOTICE_PHRASES.items()}
    found |= {p: ("base", x) for p, x in BASE_PHRASES.items()} | {TAG_PHRASE: ("tag", None)}
    machine = ahocorasick.Automaton()
    for phrase, (kind, label) in found.items():
        machine.add_word(f" {phrase} ", (kind, label, len(phrase) + 2))
    machine.make_automaton()
    return machine


def scan(text: str | None, machine: ahocorasick.Automaton) -> tuple:
    """n_words, n_base, first_word, last_word, base_labels, labels, expressions, terms and score of a whole text."""
    text = text or ""
    raw = word_text(text)
    words = len(raw.split())
    n_base, places, base, more, tags = 0, [], set(), set(), False
    for end, (kind, label, size) in machine.iter(raw.decode("latin-1")):
        if kind == "base":
            n_base += 1
            places.append(end - size + 1)
            base.add(label)
        elif kind == "notice":
            more.add(label)
        else:
            tags = True
    first = raw.count(b" ", 0, min(places)) if places else None
    last = raw.count(b" ", 0, max(places)) if places else None
    expressions, terms = [], set()
    if tags:
        for m in TAG.finditer(text):
            if (got := longest_expression(m.group(1).lstrip())) is None:
                continue
            whole, ids, rank = got
            expressions.append(whole)
            more.update(ids)
            terms.add("terms-unknown" if rank is None else TERMS[rank])
    score = 1.0 if expressions else 0.9 if base else 0.7 if more else 0.0
    return words, n_base, first, last, ",".join(sorted(base)), ",".join(sorted(base | more)), "\n".join(expressions), ",".join(sorted(terms)), score


def scan_licences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Licence phrases, identifier tags and expressions of every whole text.

    Returns a row for each document: doc_id, n_words, n_base (places of base phrases), first_word and
    last_word (their smallest and largest start, words from 0), base_labels, labels, expressions
    (one a line), terms and score (1 with a valid expression, 0.9 with a base phrase, 0.7 with
    another notice, else 0). Labels are distinct, sorted and joined by commas.

    Words are runs of a-z, A-Z, 0-9 and everything beyond ASCII. Null text: empty, so no words, empty
    labels, null places and score 0. Null ids and repeated rows are kept as they come. An empty table
    gives an empty result. Other columns are not read.
    """
    names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "expressions", "terms", "score"]
    types = [pa.int64()] * 5 + [pa.string()] * 4 + [pa.float64()]

    @common.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = build_automaton()
        for batch in batches:
            rows = [scan(t, machine) for t in batch.column("text").to_pylist()]
            columns = list(zip(*rows)) if rows else [()] * 9
            yield pa.record_batch([batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(columns, types[1:]))], names)

    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return docs.mapInArrow(run, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, expressions string, terms string, score double")


def op8(spark, sf_dir: str) -> DataFrame:
    return scan_licences(common.documents(spark, sf_dir))
