"""License scans: Aho-Corasick finds notice phrases and identifier tags, a shunting-yard parser evaluates tag expressions.

A text is its sequence of words (see ``byte_words``). One automaton holds every phrase as its words between blanks, so that one
pass over the blank-joined words finds the places of all phrases, however many there are. The words of an identifier tag are a
phrase too; the rest of the tag's line is a license expression. The parser turns it into postfix order (``with`` binds before
``and``, ``and`` before ``or``), and an evaluation over the postfix tells whether a set of accepted licenses satisfies it.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from footlamp.llm.byte_words import LOWER, SLICE, slices_of_words
from footlamp.llm.registry import query, table


@dataclass(frozen=True)
class Phrase:
    """Consecutive words, the label they stand for, and how sure they make of it (0 to 1)."""

    words: str
    label: str
    weight: float
    base: bool = False


#: The phrases that are always reported.
BASE = (
    Phrase("mit license", "mit", 0.6, True),
    Phrase("apache license", "apache", 0.6, True),
    Phrase("general public license", "gpl", 0.6, True),
)
#: Further notice phrases. Of those that begin at one word, the longest counts.
NOTICES = (
    Phrase("permission is hereby granted free of charge to any person obtaining a copy", "mit", 0.9),
    Phrase("licensed under the mit license", "mit", 0.8),
    Phrase("released under the mit license", "mit", 0.8),
    Phrase("licensed under the apache license", "apache", 0.8),
    Phrase("redistribution and use in source and binary forms", "bsd", 0.9),
    Phrase("bsd license", "bsd", 0.6),
    Phrase("gnu general public license", "gpl", 0.8),
    Phrase("lesser general public license", "lgpl", 0.8),
    Phrase("affero general public license", "agpl", 0.8),
    Phrase("mozilla public license", "mpl", 0.8),
    Phrase("eclipse public license", "epl", 0.8),
    Phrase("isc license", "isc", 0.6),
    Phrase("boost software license", "bsl", 0.8),
    Phrase("released into the public domain", "public-domain", 0.7),
    Phrase("creative commons zero", "cc0", 0.7),
    Phrase("creative commons attribution", "cc-by", 0.7),
    Phrase("creative commons attribution sharealike", "cc-by-sa", 0.7),
    Phrase("creative commons attribution noncommercial", "cc-by-nc", 0.7),
    Phrase("licensed under cc by", "cc-by", 0.8),
    Phrase("licensed under cc by sa", "cc-by-sa", 0.8),
    Phrase("licensed under cc by nc", "cc-by-nc", 0.8),
    Phrase("licensed under cc by nd", "cc-by-nd", 0.8),
    Phrase("licensed under cc by nc sa", "cc-by-nc-sa", 0.8),
    Phrase("licensed under cc by nc nd", "cc-by-nc-nd", 0.8),
    Phrase("all rights reserved", "proprietary", 0.5),
)
#: The words of an identifier tag, and how sure a well-formed one makes.
TAG = "spdx license identifier"
TAG_WEIGHT = 0.95
TAG_LINE = re.compile(rb"spdx-license-identifier:([^\n\r]*)")
#: Labels whose licenses a training set may use, for ``permitted``.
ACCEPTED = frozenset({"mit", "apache", "bsd", "isc", "bsl", "cc0", "cc-by", "public-domain"})

#: Precedence of the operators of an expression.
OPERATORS = {"or": 1, "and": 2, "with": 3}
TOKEN = re.compile(r"\s*(?:([()])|([a-z0-9][a-z0-9.:+_-]*))")
VERSION_WORDS = {"only", "or", "later", "clause"}


def family(identifier: str) -> str:
    """The label of a license identifier: its parts before the first version part."""
    parts = identifier.rstrip("+").split("-")
    kept = parts[:1]
    for part in parts[1:]:
        if part[:1].isdigit() or part in VERSION_WORDS:
            break
        kept.append(part)
    return "-".join(kept)


def postfix(expression: str) -> list[str] | None:
    """The tokens of an expression in postfix order; None unless it is well-formed as a whole."""
    out: list[str] = []
    held: list[str] = []
    at, operand, end = 0, True, len(expression.rstrip())  # operand: whether one is due
    while at < end:
        found = TOKEN.match(expression, at)
        if not found:
            return None
        at = found.end()
        token = found[1] or found[2]
        if token == "(":
            if not operand:
                return None
            held.append(token)
        elif token == ")":
            if operand:
                return None
            while held and held[-1] != "(":
                out.append(held.pop())
            if not held:
                return None
            held.pop()
        elif token in OPERATORS:
            if operand:
                return None
            while held and held[-1] != "(" and OPERATORS[held[-1]] >= OPERATORS[token]:
                out.append(held.pop())
            held.append(token)
            operand = True
        else:
            if not operand:
                return None
            out.append(token)
            operand = False
    if operand or "(" in held:
        return None
    return out + held[::-1]


def evaluate(tokens: list[str], accepted: Iterable[str]) -> tuple[bool, set[str]] | None:
    """Whether licenses of the ``accepted`` labels satisfy an expression in postfix order, and all its labels.

    ``or`` leaves a choice, ``and`` asks for both. ``with`` adds an exception to one license and grants no less than the license
    alone; its right side is no license. None where ``with`` joins anything but two identifiers.
    """
    allowed = set(accepted)
    stack: list[tuple[bool, set[str], str | None]] = []
    for token in tokens:
        if token not in OPERATORS:
            label = family(token)
            stack.append((label in allowed, {label}, token))
            continue
        right, left = stack.pop(), stack.pop()
        if token == "with":
            if left[2] is None or right[2] is None:
                return None
            stack.append((left[0], left[1], None))
        else:
            value = left[0] and right[0] if token == "and" else left[0] or right[0]
            stack.append((value, left[1] | right[1], None))
    return stack[0][:2]


def tag_expression(line: bytes) -> str:
    """The expression of a tag's line: in lower case, up to what ends a comment."""
    text = line.decode("utf-8", "replace").lower()
    for end in ("*/", "-->", "#", "//", '"', "'", "<"):
        text = text.split(end, 1)[0]
    return text.strip().rstrip(".,;")


@dataclass
class Found:
    """What a scan of one text finds; a span is (first word, number of words, phrase, label)."""

    n_words: int
    spans: list[tuple[int, int, str, str]]
    base: list[tuple[int, str]]
    expressions: list[tuple[str, bool, bool]]
    labels: set[str]
    score: float


class Scanner:
    """An automaton over the blank-joined words of a text."""

    def __init__(self, phrases: Iterable[Phrase] = (*BASE, *NOTICES), accepted: Iterable[str] = ACCEPTED, size: int = SLICE):
        self.accepted, self.size = frozenset(accepted), size
        self.machine = ahocorasick.Automaton()
        by_words: dict[str, list[Phrase]] = {}
        for p in phrases:
            by_words.setdefault(p.words, []).append(p)
        by_words[TAG] = []
        self.widest = max(w.count(" ") + 1 for w in by_words)
        for words, same in by_words.items():
            key = f" {words} ".encode().decode("latin-1")
            self.machine.add_word(key, (len(key), words.count(" ") + 1, words, same))
        self.machine.make_automaton()

    def places(self, text: bytes) -> tuple[int, list[tuple[int, int, str, list[Phrase]]]]:
        """Number of words, and every place of a phrase by its first word; slices share their border words."""
        found, n, tail = [], 0, []
        for words in slices_of_words(text, self.size):
            if not words:
                continue
            joined = b" ".join([b"", *tail, *words, b""]).decode("latin-1")
            known = sum(map(len, tail)) + len(tail)  # a place that ends before was found in the last slice
            base, counted, upto = n - len(tail), 0, 0
            for end, (size, width, name, same) in self.machine.iter(joined):
                if end <= known:
                    continue
                start = end - size + 1
                if start < upto:
                    first = joined.count(" ", 0, start)
                else:
                    first = counted = counted + joined.count(" ", upto, start)
                    upto = start
                found.append((base + first, width, name, same))
            n += len(words)
            tail = (tail + words)[-(self.widest - 1) :] if self.widest > 1 else []
        return n, sorted(found, key=lambda f: f[:3])

    def scan(self, text: bytes) -> Found:
        n, places = self.places(text)
        longest: dict[int, int] = {}
        for first, width, _, same in places:
            if any(not p.base for p in same):
                longest[first] = max(width, longest.get(first, 0))
        spans, base, sure = [], [], {}
        for first, width, name, same in places:
            for p in same:
                if not p.base and width < longest[first]:
                    continue
                spans.append((first, width, name, p.label))
                if p.base:
                    base.append((first, p.label))
                sure[p.label] = max(sure.get(p.label, 0.0), p.weight)
        expressions = []
        if any(name == TAG for _, _, name, _ in places):
            for line in TAG_LINE.findall(text.translate(LOWER)):
                expression = tag_expression(line)
                tokens = postfix(expression)
                value = evaluate(tokens, self.accepted) if tokens else None
                expressions.append((expression, value is not None, bool(value and value[0])))
                for label in value[1] if value else ():
                    sure[label] = max(sure.get(label, 0.0), TAG_WEIGHT)
        doubt = 1.0
        for label in sorted(sure):
            doubt *= 1.0 - sure[label]
        return Found(n, spans, base, expressions, set(sure), 1.0 - doubt)


SCHEMA = (
    "doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double, "
    "spans array<struct<first:bigint,words:int,phrase:string,label:string>>, expressions array<struct<expression:string,valid:boolean,permitted:boolean>>"
)


def scan(docs: DataFrame, phrases: tuple[Phrase, ...] = (*BASE, *NOTICES), accepted: Iterable[str] = ACCEPTED, key: str = "doc_id", text: str = "text") -> DataFrame:
    """License labels and evidence of every row of ``docs``: a row each, in any order, without a shuffle.

    ``spans`` are all places that count, ``expressions`` the identifier tags' lines with whether they are well-formed and whether
    the ``accepted`` labels satisfy them. ``score`` is one minus the product of the labels' doubts, 0 without a label. A malformed
    expression adds no label. Null, empty and wordless texts have no word, empty label lists and score 0. Null ids stay, repeated
    rows have equal results, an empty table gives no rows, and only ``key`` and ``text`` are read. Very long texts are looked at in
    slices.
    """
    accepted = tuple(accepted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(phrases, accepted)
        for batch in batches:
            rows = []
            for id_, value in zip(batch.column(0).to_pylist(), batch.column(1)):
                f = scanner.scan(value.as_py() or b"")
                starts = [first for first, _ in f.base]
                rows.append({
                    "doc_id": id_, "n_words": f.n_words, "n_base": len(f.base), "first_word": min(starts, default=None), "last_word": max(starts, default=None),
                    "base_labels": ",".join(sorted({label for _, label in f.base})), "labels": ",".join(sorted(f.labels)), "score": f.score,
                    "spans": [dict(zip(("first", "words", "phrase", "label"), s)) for s in f.spans],
                    "expressions": [dict(zip(("expression", "valid", "permitted"), e)) for e in f.expressions],
                })
            yield pa.RecordBatch.from_pylist(rows, schema=ARROW)

    return docs.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).cast("string").cast("binary").alias("text")).mapInArrow(run, SCHEMA)


ARROW = pa.schema([
    ("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()),
    ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()),
    ("spans", pa.list_(pa.struct([("first", pa.int64()), ("words", pa.int32()), ("phrase", pa.string()), ("label", pa.string())]))),
    ("expressions", pa.list_(pa.struct([("expression", pa.string()), ("valid", pa.bool_()), ("permitted", pa.bool_())]))),
])


@query("op11_license_scan")
def op11_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases, labels and expressions of every document."""
    return scan(table(spark, sf_dir, "documents"))
