"""License scans: wording templates with optional and replaceable regions, compiled into word automata."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from facetwise.llm.common import LOWER, NO_ID, Docs, Words, ids_array, plain, slices, split_words, word_hashes

#: Words are runs of digits, letters and bytes beyond ASCII.
BREAKS = np.ones(256, bool)
BREAKS[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False

# Phrases that name a license by themselves.
PHRASES = {
    "mit license": "mit",
    "apache license": "apache",
    "general public license": "gpl",
}

# Templates. [ ] is optional wording, {name:n} up to n words of any kind, (a|b) one of several.
TEMPLATES = {
    "agpl": ["gnu affero general public license", "licensed under [the] agpl"],
    "all-rights-reserved": ["all rights reserved"],
    "apache": [
        "licensed under the apache license [version 2 0]",
        "spdx license identifier apache 2 0",
        "you may obtain a copy of the license at [http|https] www apache org licenses license 2 0",
    ],
    "bsd": [
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
        "spdx license identifier bsd {clauses:1} clause",
        "licensed under [the] bsd [{clauses:2} clause] license",
    ],
    "cc-by": ["licensed under [a] (cc|creative commons) (by|attribution) (1|2|3|4) (0|5)"],
    "cc-by-nc": ["licensed under [a] (cc|creative commons) (by nc|attribution noncommercial) [{version:1} {minor:1}]"],
    "cc-by-sa": ["licensed under [a] (cc|creative commons) (by sa|attribution sharealike) [{version:1} {minor:1}]"],
    "gpl": [
        "licensed under the [terms of the] gnu general public license [version {version:1}]",
        "spdx license identifier gpl {version:2} (only|or later)",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license",
    ],
    "lgpl": ["gnu (lesser|library) general public license"],
    "mit": [
        "(released|licensed|available) under [the] [terms of the] mit license",
        "spdx license identifier mit",
        "permission is hereby granted free of charge to any person obtaining a copy of {work:12} to deal in {item:6} without restriction",
    ],
    "mpl": ["mozilla public license [[v|version] 2 0]", "spdx license identifier mpl 2 0"],
}


# ---------------------------------------------------------------- templates to automata


class Automaton(NamedTuple):
    """States are numbers. step: by state the words that lead on; any: by state the state after any
    word; free: by state the states reached without a word; ``end`` accepts."""

    label: str
    step: dict[int, dict[bytes, set[int]]]
    any: dict[int, set[int]]
    free: dict[int, set[int]]
    end: int

    def closed(self, states: set[int]) -> set[int]:
        todo, seen = list(states), set(states)
        while todo:
            for t in self.free.get(todo.pop(), ()):
                if t not in seen:
                    seen.add(t)
                    todo.append(t)
        return seen

    def first_words(self) -> set[bytes]:
        """Words that a match can begin with."""
        start = self.closed({0})
        if start & self.any.keys() or self.end in start:
            raise ValueError(f"{self.label}: a template begins with mandatory wording")
        return {w for s in start for w in self.step.get(s, ())}

    def accepts(self, words: Iterable[bytes]) -> int:
        """The words of the longest match at the beginning; 0 if there is none."""
        now, longest = self.closed({0}), 0
        for n, w in enumerate(words, 1):
            following: set[int] = set()
            for s in now:
                following |= self.step.get(s, {}).get(w, set()) | self.any.get(s, set())
            if not following:
                break
            now = self.closed(following)
            if self.end in now:
                longest = n
        return longest


def compile_template(label: str, template: str) -> Automaton:
    """``word``, ``[optional]``, ``{name:n}`` for up to n words, ``(this|that)``; regions nest."""
    tokens = re.findall(r"\{\w+:\d+\}|[\[\]()|]|[^\s\[\](){}|]+", template)
    step: dict[int, dict[bytes, set[int]]] = {}
    any_word: dict[int, set[int]] = {}
    free: dict[int, set[int]] = {}
    states, at = [0], [0]

    def new() -> int:
        states.append(len(states))
        return states[-1]

    def choice(begin: int, closing: str) -> int:
        end = new()
        while True:
            free.setdefault(sequence(begin), set()).add(end)
            token = tokens[at[0]] if at[0] < len(tokens) else ""
            at[0] += 1
            if token == closing:
                return end
            if token != "|":
                raise ValueError(f"{label}: {template!r} isn't balanced")

    def sequence(here: int) -> int:
        while at[0] < len(tokens) and tokens[at[0]] not in "])|":
            token = tokens[at[0]]
            at[0] += 1
            if token in "[(":
                end = choice(here, "]" if token == "[" else ")")
                if token == "[":
                    free.setdefault(here, set()).add(end)
                here = end
            elif token[0] == "{":
                begin, most = here, int(token[1:-1].split(":")[1])
                end = new()
                for _ in range(most):
                    following = new()
                    any_word.setdefault(begin, set()).add(following)
                    free.setdefault(following, set()).add(end)
                    begin = following
                here = end
            else:
                following = new()
                step.setdefault(here, {}).setdefault(token.encode(), set()).add(following)
                here = following
        return here

    end = choice(0, "")
    return Automaton(label, step, any_word, free, end)


def longest_match(a: Automaton) -> int:
    """Words of the longest text an automaton can accept: its states are reached in order, no loops."""
    return sum(len(x) for x in a.any.values()) + sum(len(x) for x in a.step.values())


# ---------------------------------------------------------------- scan


def _hash_of(word: bytes) -> np.uint64:
    data = np.frombuffer(word, np.uint8)
    return word_hashes(data, Words(np.array([0]), np.array([len(word)]), np.array([0, 1])))[0]


def _followed(h: np.ndarray, doc: np.ndarray, phrase: list[np.uint64]) -> np.ndarray:
    """Where the words of a phrase stand one after the other in one document."""
    n = len(h) - len(phrase) + 1
    if n <= 0:
        return np.empty(0, np.int64)
    hit = doc[:n] == doc[len(phrase) - 1 :]
    for k, w in enumerate(phrase):
        hit &= h[k : k + n] == w
    return np.flatnonzero(hit)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases: dict[str, str] | None = None,
         templates: dict[str, list[str]] | None = None) -> DataFrame:
    """One row per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score,
    and matches (label, word, words) of the templates.

    Base: places where a phrase's words stand consecutively. A template matches where its automaton
    accepts words from some place on: mandatory wording exactly, optional wording or not, replaceable
    regions with any words up to their bound. score is 1 with a template's match, one half with phrases
    only, else 0. Null and empty texts have no words; null ids and repeated rows come back as they are;
    other columns are ignored; no rows give no rows.
    """
    phrases = PHRASES if phrases is None else phrases
    templates = TEMPLATES if templates is None else templates
    built = [compile_template(label, t) for label, some in sorted(templates.items()) for t in some]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = [([_hash_of(w) for w in p.encode().split()], label) for p, label in phrases.items()]
        begins: dict[int, list[Automaton]] = {}
        for a in built:
            for w in a.first_words():
                begins.setdefault(int(_hash_of(w)), []).append(a)
        firsts = np.array(sorted(begins), np.uint64)
        for part in slices(batches):
            yield _scanned(part, base, begins, firsts)

    return plain(docs, id_col, text_col).mapInArrow(
        run,
        "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, "
        "score double, matches array<struct<label: string, word: long, words: long>>",
    )


def _scanned(part: Docs, base, begins, firsts: np.ndarray) -> pa.RecordBatch:
    part = part._replace(data=LOWER[part.data])
    words = split_words(part, BREAKS)
    h, doc, n = word_hashes(part.data, words), words.docs(), len(part.ids)
    n_base, low, high = np.zeros(n, np.int64), np.full(n, NO_ID), np.full(n, NO_ID)
    base_labels: list[set[str]] = [set() for _ in range(n)]
    for phrase, label in base:
        at = _followed(h, doc, phrase)
        np.add.at(n_base, doc[at], 1)
        for i in at.tolist():
            d = int(doc[i])
            w = i - int(words.first[d])
            low[d] = w if low[d] == NO_ID else min(low[d], w)
            high[d] = max(high[d], w)
            base_labels[d].add(label)
    matches: list[list[dict]] = [[] for _ in range(n)]
    raw = part.data.tobytes()
    for i in np.flatnonzero(np.isin(h, firsts)).tolist():
        d = int(doc[i])
        for a in begins[int(h[i])]:
            stop = min(int(words.first[d + 1]), i + longest_match(a))
            length = _accepted(a, raw, words, i, stop)
            if length:
                matches[d].append({"label": a.label, "word": i - int(words.first[d]), "words": length})
    labels = [b | {m["label"] for m in found} for b, found in zip(base_labels, matches)]
    return pa.RecordBatch.from_arrays(
        [
            ids_array(part.ids),
            pa.array(np.diff(words.first)),
            pa.array(n_base),
            ids_array(low),
            ids_array(high),
            pa.array([",".join(sorted(x)) for x in base_labels]),
            pa.array([",".join(sorted(x)) for x in labels]),
            pa.array([1.0 if m else 0.5 if b else 0.0 for m, b in zip(matches, base_labels)]),
            pa.array(matches, pa.list_(pa.struct([("label", pa.string()), ("word", pa.int64()), ("words", pa.int64())]))),
        ],
        ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "matches"],
    )


def _accepted(a: Automaton, raw: bytes, words: Words, begin: int, stop: int) -> int:
    """Like ``accepts``, on the words from ``begin`` to ``stop``, read as far as the automaton goes."""
    span = zip(words.start[begin:stop].tolist(), words.length[begin:stop].tolist())
    return a.accepts(raw[s : s + n] for s, n in span)
