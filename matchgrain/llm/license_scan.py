"""Fuzzy search for short licence notices: exact seeds by the pigeonhole principle, bounded-error verification.

A notice with at most ``k`` edits, cut into ``k + 1`` pieces, keeps one piece unharmed. One automaton finds all pieces of all
notices in the text's words (joined by single spaces); around each find the ``regex`` library's bounded-error matching
decides, from word start to word end, and gives the best span with its edits. A notice with a word that must stand exactly
(a short name, which an edit would turn into another word) is sought by that word.

Words are the maximal runs of ASCII letters, digits and characters beyond ASCII, with A-Z lower-cased.

Defined results: a null or empty text has no words, no labels and the score 0; every row gives one row, repeated ids included;
overlapping finds of one notice are reported once, the one with the fewest edits (then the first); texts of any length are
searched whole; further columns do not matter. No shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import NamedTuple

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import short, text_slices


class Notice(NamedTuple):
    label: str
    name: str  #: words that must stand exactly before the others; may be empty
    words: str

    @property
    def edits(self) -> int:
        """Edits allowed in ``words``: one for each twelve characters; in what follows a name, one."""
        return min(len(self.words) // 12, 4) if not self.name else int(len(self.words) > 5)

    @property
    def whole(self) -> str:
        return f"{self.name} {self.words}".strip()


#: The base phrases and their labels.
BASE = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))
#: Notices, as words.
NOTICES = tuple(
    Notice(*x)
    for x in (
        ("agpl", "", "gnu affero general public license"),
        ("apache", "", "apache license version 2 0"),
        ("apache", "apache", "license"),
        ("artistic", "artistic", "license"),
        ("boost", "", "boost software license"),
        ("bsd", "", "redistribution and use in source and binary forms with or without modification"),
        ("bsd", "bsd 2", "clause"),
        ("bsd", "bsd 3", "clause"),
        ("bsd", "bsd", "license"),
        ("cc-by", "", "creative commons attribution"),
        ("cc-by-nc", "cc by nc", ""),
        ("cc-by-nc", "", "creative commons attribution noncommercial"),
        ("cc-by-nd", "cc by nd", ""),
        ("cc-by-nd", "", "creative commons attribution noderivatives"),
        ("cc-by-sa", "cc by sa", ""),
        ("cc-by-sa", "", "creative commons attribution sharealike"),
        ("cc0", "cc0", ""),
        ("epl", "", "eclipse public license"),
        ("gpl", "", "gnu general public license"),
        ("gpl", "", "this program is free software you can redistribute it and or modify it under the terms of"),
        ("isc", "isc", "license"),
        ("lgpl", "", "gnu lesser general public license"),
        ("mit", "mit", "license"),
        ("mit", "", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
        ("mpl", "", "mozilla public license"),
        ("proprietary", "", "all rights reserved"),
        ("public-domain", "", "released into the public domain"),
        ("public-domain", "", "dedicated to the public domain"),
    )
)
#: Verified windows remembered by a scanner; when full it starts anew, which changes no result.
REMEMBERED = 50_000
_TERMS = bytes(c if 48 <= c < 58 or 97 <= c < 123 or c >= 128 else c + 32 if 65 <= c < 91 else 32 for c in range(256))

SCHEMA = (
    "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, "
    "spans array<struct<label:string,notice:string,first_word:long,end_word:long,edits:int>>"
)


def pieces(notice: Notice) -> list[tuple[str, int]]:
    """Seeds of a notice with their places in it: its name as whole words, or one piece more than edits are allowed."""
    if notice.name:
        return [(f" {notice.name} ", -1)]
    n, k = len(notice.words), notice.edits + 1
    cuts = [i * n // k for i in range(k + 1)]
    return [(notice.words[a:b], a) for a, b in zip(cuts, cuts[1:], strict=False)]


class Scanner:
    """The automaton of all seeds and the bounded-error pattern of each notice."""

    def __init__(self, notices: Sequence[Notice] = NOTICES):
        self.notices = notices
        self.automaton = ahocorasick.Automaton()
        seeds: dict[str, list[tuple[int, int]]] = {}
        for i, n in enumerate(notices):
            for seed, at in pieces(n):
                seeds.setdefault(seed, []).append((i, at))
        for seed, uses in seeds.items():
            self.automaton.add_word(seed, (len(seed), uses))
        self.automaton.make_automaton()
        self.patterns = [self._pattern(n) for n in notices]
        self.known: dict[tuple[int, str], tuple[int, int, int] | None] = {}

    @staticmethod
    def _pattern(n: Notice):
        loose = f"(?:{regex.escape(n.words, literal_spaces=True)}){{e<={n.edits}}}" if n.words else ""
        body = " ".join(x for x in (regex.escape(n.name, literal_spaces=True), loose) if x)
        # The space before is part of the match: where a match begins, the library tries no insertion.
        return regex.compile(rf" {body}(?![^ ])", regex.BESTMATCH)

    def _verified(self, i: int, window: str) -> tuple[int, int, int] | None:
        if (i, window) not in self.known:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            m = self.patterns[i].search(window)
            self.known[i, window] = m and (m.start() + 1, m.end(), sum(m.fuzzy_counts))
        return self.known[i, window]

    def spans(self, padded: str) -> list[tuple[int, int, int, int]]:
        """(notice, start, end, edits) in ``padded``: the text's words with one space before, between and after them."""
        found: dict[int, set[tuple[int, int, int]]] = {}
        for last, (size, uses) in self.automaton.iter(padded):
            for i, at in uses:
                n, k = len(self.notices[i].whole), self.notices[i].edits
                start = last + 1 - size - at
                # From the space before the word that the match can first begin in to the end of the word it can last end in.
                a = padded.rfind(" ", 0, max(start - k, 0) + 1)
                b = padded.find(" ", min(start + n + k, len(padded) - 1))
                if hit := self._verified(i, padded[a:b]):
                    found.setdefault(i, set()).add((hit[2], a + hit[0], a + hit[1]))
        out = []
        for i, hits in found.items():
            taken: list[tuple[int, int]] = []
            for edits, a, b in sorted(hits):
                if all(b <= x or y <= a for x, y in taken):
                    taken.append((a, b))
                    out.append((i, a, b, edits))
        return sorted(out, key=lambda s: (s[1], s[2], s[0]))


def word_number(padded: str, places: list[int]) -> list[int]:
    """The number of the word that starts at each of the ascending ``places``."""
    out, at, n = [], 0, -1
    for p in places:
        n += padded.count(" ", at, p)
        at = p
        out.append(n)
    return out


def base_places(padded: str) -> list[tuple[int, str]]:
    """(start, label) of every place where a base phrase's words stand."""
    out = []
    for phrase, label in BASE:
        at = padded.find(f" {phrase} ")
        while at >= 0:
            out.append((at + 1, label))
            at = padded.find(f" {phrase} ", at + 1)
    return sorted(out)


def scan(text: bytes, scanner: Scanner) -> tuple:
    """The columns of ``SCHEMA`` after ``doc_id``."""
    found = text.translate(_TERMS).split()
    if not found:
        return 0, 0, None, None, "", "", 0.0, []
    padded = f" {b' '.join(found).decode()} "
    base = base_places(padded)
    where = word_number(padded, [p for p, _ in base])
    spans = scanner.spans(padded)
    first = word_number(padded, [a for _, a, _, _ in spans])
    named = [scanner.notices[i] for i, *_ in spans]
    rows = [(n.label, n.whole, w, w + padded.count(" ", a, b) + 1, e) for n, w, (_, a, b, e) in zip(named, first, spans, strict=True)]
    base_labels = {x for _, x in base}
    score = 1.0 if base else max((1 - e / len(n.whole) for n, (*_, e) in zip(named, spans, strict=True)), default=0.0)
    labels = base_labels | {n.label for n in named}
    return len(found), len(base), where[0] if base else None, where[-1] if base else None, ",".join(sorted(base_labels)), ",".join(sorted(labels)), score, rows


def license_notices(docs: DataFrame, notices: Sequence[Notice] = NOTICES) -> DataFrame:
    """One row per row of ``docs`` (``doc_id``, ``text``) with its base places, labels, score and verified spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(notices)
        for ids, texts in text_slices(short(batches), ["doc_id", "text"]):
            rows = [scan(t, scanner) for t in texts]
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64())
            span = pa.struct([("label", pa.string()), ("notice", pa.string()), ("first_word", pa.int64()), ("end_word", pa.int64()), ("edits", pa.int32())])
            spans = pa.array([[dict(zip(("label", "notice", "first_word", "end_word", "edits"), s, strict=True)) for s in r[7]] for r in rows], pa.list_(span))
            yield pa.RecordBatch.from_arrays(
                [ids.cast(pa.int64()), *(pa.array([r[j] for r in rows], t) for j, t in enumerate(kinds)), spans], names=[*(c.split()[0] for c in SCHEMA.split(", ")[:8]), "spans"]
            )

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)


def op12_license_scan(spark, sf_dir: str) -> DataFrame:
    return license_notices(spark.read.parquet(f"{sf_dir}/documents.parquet"))
