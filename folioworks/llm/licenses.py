"""Licence scans with a generalised suffix automaton of licence tokens.

Words are lower-cased (A-Z) runs of ASCII letters, digits and anything beyond ASCII. The words of all templates form
one generalised suffix automaton, whose states know every template and place where their strings end. Each text is
streamed through it, which gives for each word the longest template factor that ends there (the matching statistics;
words between no two template words that ever stand together can't lengthen a match and are passed over in bulk).
Matches of at least ``MIN_MATCH`` words are chained per template: in the order of both texts, with gaps of at most
``MAX_GAP`` words, so that the chain covers as many words of the template as it can (dynamic programming over the matches;
of equal chains the one that starts first). A chain that covers ``MIN_COVER`` of its template gives the template's label
and a span of words; the next chains of that template are made of the other matches.

Beside that the base phrases are looked up exactly; their labels always stay. The score is the greatest share of a
template that a chain covers, long enough for a label or not; a base phrase counts its words over ``MIN_MATCH``, 1 at most.

Defined results: null and empty texts have no words, no labels and score 0; repeated rows get equal results; more columns
are ignored, whatever their names; an empty table gives no rows. Time grows in proportion to the text, however often a
phrase or a piece of a template stands in it.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .automaton import SuffixAutomaton
from .shingles import LOWER, PLAIN_WORDS

MIN_MATCH = 4
MAX_GAP = 6
MIN_COVER = 0.75

# The base phrases and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

# Short notices by which works declare public licences, and their labels.
TEMPLATES = (
    ("mit", "released under the mit license"),
    ("mit", "licensed under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"),
    ("apache-2.0", "licensed under the apache license version 2 0"),
    ("apache-2.0", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0"),
    ("apache-2.0", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("lgpl", "under the terms of the gnu lesser general public license as published by the free software foundation"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by", "licensed under cc by 4 0"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
)

_SPACED = bytes(LOWER[c] if PLAIN_WORDS[c] else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_SPACED).split()


class Scanner:
    """The automaton of the templates, and the places of its states."""

    def __init__(self, templates=TEMPLATES, base=BASE):
        self.labels = [label for label, _ in templates]
        self.base = [(b" " + phrase.encode() + b" ", label) for phrase, label in base.items()]
        texts = [words_of(t) for _, t in templates]
        self.sizes = [len(t) for t in texts]
        self.ids = {w: i for i, w in enumerate(dict.fromkeys(w for t in texts for w in t))}
        coded = [[self.ids[w] for w in t] for t in texts]
        self.automaton = SuffixAutomaton()
        for sequence in coded:
            self.automaton.add(sequence)
        n = len(self.ids)
        self.follows = np.zeros((n + 1) * (n + 1), dtype=bool)
        for sequence in coded:
            self.follows[[a * (n + 1) + b for a, b in zip(sequence[:-1], sequence[1:], strict=True)]] = True
        places: dict[int, set[tuple[int, int]]] = defaultdict(set)
        for k, sequence in enumerate(coded):
            state = 0
            for end, symbol in enumerate(sequence):
                state = self.automaton.next[state][symbol]
                at = state
                while at > 0:
                    places[at].add((k, end))
                    at = self.automaton.link[at]
        self.places = {s: sorted(p) for s, p in places.items()}

    def matches(self, words: list[bytes]) -> dict[int, list[tuple[int, int, int]]]:
        """By template the maximal long matches (start in text, start in template, length)."""
        n = len(self.ids)
        found: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
        if len(words) < MIN_MATCH:
            return found
        ids = np.fromiter((self.ids.get(w, n) for w in words), dtype=np.int64, count=len(words))
        pairs = np.concatenate(([False], self.follows[ids[:-1] * (n + 1) + ids[1:]], [False]))
        edges = np.flatnonzero(pairs[1:] != pairs[:-1])
        step, link, length = self.automaton.next, self.automaton.link, self.automaton.length
        for first, last in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
            if last - first + 1 < MIN_MATCH:
                continue
            state = size = 0
            run = [*ids[first : last + 1].tolist(), n]  # the last symbol follows nothing
            for at, symbol in enumerate(run, first):
                if symbol not in step[state] and size >= MIN_MATCH:
                    for k, end in self.places[state]:
                        found[k].append((at - size, end - size + 1, size))
                while state and symbol not in step[state]:
                    state = link[state]
                    size = length[state]
                if symbol in step[state]:
                    state, size = step[state][symbol], size + 1
                else:
                    size = 0
        return found

    def _chains(self, matches: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
        """(words covered, first, last) of the chains of one template's matches, each of matches that no better one has."""
        matches = sorted(matches)
        best, before, near = [0] * len(matches), [-1] * len(matches), 0
        longest = max(size for _, _, size in matches)
        for j, (at, place, size) in enumerate(matches):
            best[j] = size
            while matches[near][0] + longest + MAX_GAP < at:
                near += 1
            for i in range(near, j):
                a, p, n = matches[i]
                ahead = max(a + n - at, p + n - place, 0)  # words of this match that the one before has passed
                fits = a < at and p < place and size > ahead and at + ahead - (a + n) <= MAX_GAP and place + ahead - (p + n) <= MAX_GAP
                if fits and best[i] + size - ahead > best[j]:
                    best[j], before[j] = best[i] + size - ahead, i
        used, out = [False] * len(matches), []
        for j in sorted(range(len(matches)), key=lambda j: (-best[j], j)):
            last, first, covered, at = j, j, best[j], j
            while at >= 0 and not used[at]:
                used[at], first, at = True, at, before[at]
            if at == j:
                continue
            if at >= 0:  # the rest belongs to a better chain
                covered -= best[at]
            out.append((covered, matches[first][0], matches[last][0] + matches[last][2] - 1))
        return out

    def spans(self, words: list[bytes]) -> list[tuple[int, int, int, float]]:
        """(template, first word, last word, coverage) of all chains."""
        out = [(k, first, last, min(1.0, covered / self.sizes[k])) for k, matches in self.matches(words).items() for covered, first, last in self._chains(matches)]
        return sorted(out, key=lambda x: (x[1], x[0], x[2]))

    def scan(self, text: str | None) -> dict:
        words = words_of(text)
        joined = b" " + b" ".join(words) + b" "
        starts, base, strength = [], set(), 0.0
        for phrase, label in self.base:
            at, seen, passed = joined.find(phrase), 0, 0
            while at >= 0:
                seen, passed = seen + joined.count(b" ", passed, at), at
                starts.append(seen)
                base.add(label)
                strength = max(strength, min(1.0, (phrase.count(b" ") - 1) / MIN_MATCH))
                at = joined.find(phrase, at + 1)
        chains = self.spans(words)
        spans = [s for s in chains if s[3] >= MIN_COVER]
        labels = base | {self.labels[k] for k, *_ in spans}
        return {
            "n_words": len(words), "n_base": len(starts), "first_word": min(starts, default=None), "last_word": max(starts, default=None),
            "base_labels": ",".join(sorted(base)), "labels": ",".join(sorted(labels)),
            "score": max([strength, *(s[3] for s in chains)]),
            "spans": [{"label": self.labels[k], "first": a, "last": b, "cover": c} for k, a, b, c in spans],
        }


_SPAN = pa.struct([("label", pa.string()), ("first", pa.int64()), ("last", pa.int64()), ("cover", pa.float64())])
_FIELDS = [("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("spans", pa.list_(_SPAN))]


def scan_licenses(docs: DataFrame, templates=TEMPLATES, base=BASE) -> DataFrame:
    """Per row of ``docs(doc_id, text)``: word and phrase counts, labels, score, and the covered template spans."""
    scanner = Scanner(templates, base)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [scanner.scan(t.as_py()) for t in batch.column("text")]
            columns = [batch.column("doc_id"), *(pa.array([r[name] for r in rows], kind) for name, kind in _FIELDS)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", *(name for name, _ in _FIELDS)])

    schema = f"doc_id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label string, first long, last long, cover double>>"
    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(scan, schema)
