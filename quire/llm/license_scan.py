"""License scans by template-markup matching.

A template is a notice in license-list markup: words that must stand, and
regions that may be missing (beginOptional ... endOptional) or hold other
words (var, with the most words it may hold).  It is compiled into a token
automaton, which accepts a run of words if the mandatory wording matches
exactly.  Automata run from every place whose word can start one.
"""

from __future__ import annotations

import re
from collections import defaultdict
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import arrow_map

#: Phrases whose places are counted. Fixed values.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: Notices by label.
TEMPLATES = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and "
            "associated documentation <<beginOptional>>files the software<<endOptional>>"
            "<<beginOptional>>files<<endOptional>> to deal in the <<var;most=3>> without restriction"),
    ("mit", "released under the <<beginOptional>>expat<<endOptional>> <<beginOptional>>mit<<endOptional>> license"),
    ("apache-2", "licensed under the apache license version 2 <<beginOptional>>0<<endOptional>> "
                 "<<beginOptional>>the license you may not use this file except in compliance with the license"
                 "<<endOptional>>"),
    ("cc-by-nc", "licensed under <<beginOptional>>a<<endOptional>> <<beginOptional>>creative commons<<endOptional>> "
                 "cc by nc <<var;most=2>>"),
    ("cc-by-nc", "creative commons attribution <<beginOptional>>non<<endOptional>> noncommercial "
                 "<<var;most=2>> license"),
    ("gpl", "licensed under the <<beginOptional>>terms of the<<endOptional>> gnu general public license "
            "<<beginOptional>>version <<var;most=2>><<endOptional>>"),
    ("gpl", "free software you can redistribute it and or modify it under the terms of the gnu general public "
            "license as published by <<var;most=6>> either version <<var;most=3>> of the license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted "
            "provided that the following conditions are met"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("all-rights-reserved", "copyright <<var;most=8>> all rights reserved"),
]
MARK = re.compile(r"<<(beginOptional|endOptional|var)(?:;most=(\d+))?>>")
#: Bytes that separate words; A-Z becomes a-z.
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32
               for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    """Words of lower-cased text: runs of a-z, 0-9 and anything beyond ASCII."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_TABLE).split()


@dataclass
class Automaton:
    label: str
    mandatory: int = 0
    words: list[dict[bytes, int]] = field(default_factory=list)     # per state: word -> state
    other: list[int | None] = field(default_factory=list)           # per state: any word -> state
    skip: list[set[int]] = field(default_factory=list)              # per state: without a word

    def state(self) -> int:
        self.words.append({})
        self.other.append(None)
        self.skip.append(set())
        return len(self.words) - 1

    def close(self, states: set[int]) -> set[int]:
        todo = list(states)
        while todo:
            for s in self.skip[todo.pop()]:
                if s not in states:
                    states.add(s)
                    todo.append(s)
        return states

    def match(self, words: list[bytes], at: int) -> int:
        """End of the longest accepted run of words from ``at`` on, or -1."""
        last = len(self.words) - 1
        states, end = self.close({0}), -1
        while True:
            if last in states:
                end = at
            if at == len(words) or not states:
                return end
            w = words[at]
            states = {t for s in states for t in (self.words[s].get(w), self.other[s]) if t is not None}
            self.close(states)
            at += 1


def compile_template(label: str, markup: str) -> Automaton:
    a = Automaton(label)
    now, open_ = a.state(), []
    at = 0
    for m in [*MARK.finditer(markup), None]:
        for w in words_of(markup[at:m.start() if m else len(markup)]):
            new = a.state()
            a.words[now][w] = new
            now = new
            a.mandatory += not open_
        if m is None:
            break
        at = m.end()
        if m[1] == "beginOptional":
            open_.append(now)
        elif m[1] == "endOptional":
            new = a.state()
            a.skip[now].add(new)
            a.skip[open_.pop()].add(new)
            now = new
        else:
            ends = [now]
            for _ in range(int(m[2])):
                new = a.state()
                a.other[now] = new
                now = new
                ends.append(now)
            new = a.state()
            for e in ends:
                a.skip[e].add(new)
            now = new
    return a


def scanner(base: dict[str, str] = BASE, templates=TEMPLATES):
    """(first word -> phrases, first word -> automata)."""
    phrases, automata = defaultdict(list), defaultdict(list)
    for phrase, label in base.items():
        w = words_of(phrase)
        phrases[w[0]].append((w, label))
    for label, markup in templates:
        a = compile_template(label, markup)
        for w in {w for s in a.close({0}) for w in a.words[s]}:
            automata[w].append(a)
    return phrases, automata


def scan_words(words: list[bytes], phrases, automata) -> tuple[list[int], set[str], set[str], int]:
    """(starts of base phrases, base labels, template labels, most mandatory words found)."""
    starts, base, more, most = [], set(), set(), 0
    for at in [i for i, w in enumerate(words) if w in phrases or w in automata]:
        for phrase, label in phrases.get(words[at], ()):
            if words[at:at + len(phrase)] == phrase:
                starts.append(at)
                base.add(label)
                most = max(most, len(phrase))
        for a in automata.get(words[at], ()):
            if (a.label not in more or a.mandatory > most) and a.match(words, at) >= 0:
                more.add(a.label)
                most = max(most, a.mandatory)
    return starts, base, more, most


def scan(docs: DataFrame, base: dict[str, str] = BASE, templates=TEMPLATES) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels,
    score per row of docs: base counts every place of a phrase; the score is
    k / (k + 2) for the k mandatory words of the longest phrase or template
    found, 0 without any.  Null and empty texts have no words; repeated rows
    are scanned alike; extra columns are ignored."""
    templates = list(templates)

    def fn(batch, s):
        out = [[] for _ in range(7)]
        for text in batch.column("text").to_pylist():
            words = words_of(text)
            starts, own, more, k = scan_words(words, *s)
            for c, v in zip(out, (len(words), len(starts), min(starts, default=None), max(starts, default=None),
                                  ",".join(sorted(own)), ",".join(sorted(own | more)), k / (k + 2) if k else 0.0)):
                c.append(v)
        return [batch.column("doc_id"), *out]

    return arrow_map(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), fn,
                     "doc_id long, n_words long, n_base long, first_word long, last_word long, "
                     "base_labels string, labels string, score double",
                     slice_rows=512, start=lambda: scanner(base, templates))
