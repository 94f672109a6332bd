"""Fuzzy search for short licence notices.

A text becomes its lower-case words joined by single spaces. A notice that may differ by k edits is cut into k + 1 pieces;
at least one piece survives any k edits, so an exact search for all pieces (one automaton) finds every place a notice
can be. A place goes on only if it holds as many of the notice's three-letter runs as k edits must leave (each edit
spoils three at most, so none is lost); then the regex library's bounded-error match verifies it and gives span and edits.
Of overlapping places the best counts; those before and after it count too. Exact places and stretches are walked in
loops, so a text may repeat a notice as often as it likes.

Base phrases are places where a phrase's words stand one after another. Null and empty texts have no words, no place and
score 0. Nothing else than the text is looked at; repeated rows are searched each.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from functools import lru_cache
from itertools import accumulate

import ahocorasick
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factorloom.llm.common import text_of, widen

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
# Fixed phrases and their labels.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
# Short notices and their labels.
NOTICES = {
    "released under the mit license": "mit",
    "permission is hereby granted free of charge to any person obtaining a copy of this software": "mit",
    "licensed under the apache license version 2 0": "apache-2",
    "you may not use this file except in compliance with the license": "apache-2",
    "licensed under cc by nc 4 0": "cc-by-nc",
    "creative commons attribution noncommercial": "cc-by-nc",
    "licensed under the gnu general public license version 3": "gpl-3",
    "this program is free software you can redistribute it and or modify": "gpl",
    "licensed under the gnu lesser general public license": "lgpl",
    "redistribution and use in source and binary forms with or without modification are permitted": "bsd",
    "this source code form is subject to the terms of the mozilla public license": "mpl-2",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "licensed under a creative commons attribution sharealike": "cc-by-sa",
}
ERROR_RATE = 0.1
RUN = 3  # letters; see the module's text


class Finder:
    """Finds ``notices`` with up to ``error_rate`` edits per character."""

    def __init__(self, notices: tuple[tuple[str, str], ...], error_rate: float):
        self.notices, self.seeds = [], ahocorasick.Automaton()
        held: dict[str, list[tuple[int, int]]] = {}
        for number, (notice, label) in enumerate(notices):
            edits = int(len(notice) * error_rate)
            form = rf"(?:{regex.escape(notice, literal_spaces=True)}){{e<={edits}}}"
            self.notices.append((label, len(notice), edits, (regex.compile(form), regex.compile(f"(?b){form}")), notice))
            bounds = [len(notice) * k // (edits + 1) for k in range(edits + 2)]
            for lo, hi in zip(bounds, bounds[1:]):
                held.setdefault(notice[lo:hi], []).append((number, lo))
        for seed, uses in held.items():
            self.seeds.add_word(seed, (len(seed), uses))
        self.seeds.make_automaton()

    def find(self, text: str) -> list[tuple[str, int, int, int]]:
        """(label, start, end, edits) in ``text``, a place per notice and stretch of overlapping candidates."""
        windows: dict[int, list[list[int]]] = {}
        for last, (size, uses) in self.seeds.iter(text):
            for number, at in uses:
                _, length, edits, _, _ = self.notices[number]
                start = last + 1 - size - at - edits
                stop = start + length + 2 * edits
                widen(windows.setdefault(number, []), start, stop)
        found = []
        for number, spans in windows.items():
            for start, stop in spans:
                found += self.verify(number, text, max(start, 0), min(stop, len(text)))
        return found

    def verify(self, number: int, text: str, start: int, stop: int) -> list[tuple[str, int, int, int]]:
        label, length, _, _, notice = self.notices[number]
        found, exact = [], text.find(notice, start, stop)
        while exact >= 0:
            found += self.inexact(number, text, start, exact)
            found.append((label, exact, exact + length, 0))
            start = exact + length
            exact = text.find(notice, start, stop)
        return found + self.inexact(number, text, start, stop)

    def inexact(self, number: int, text: str, start: int, stop: int) -> list[tuple[str, int, int, int]]:
        """The places in a stretch without an exact one, by start."""
        label, length, edits, (first, best), notice = self.notices[number]
        if stop - start < length - edits:
            return []
        held = {text[i:i + RUN] for i in range(start, stop - RUN + 1)}
        if sum(notice[i:i + RUN] in held for i in range(length - RUN + 1)) < length - RUN + 1 - RUN * edits:
            return []
        found = []
        while m := first.search(text, start, stop):
            # the best of the places that overlap the first one, then those before it
            begun, end = m.start(), min(stop, m.start() + 2 * (length + edits))
            start, before = None, []
            while m := best.search(text, begun, end):
                before.append((label, m.start(), m.end(), sum(m.fuzzy_counts)))
                start, end = start or m.end(), m.start()
            found += before[::-1]
        return found


@lru_cache(maxsize=4)
def finder(notices: tuple[tuple[str, str], ...], error_rate: float) -> Finder:
    return Finder(notices, error_rate)


def scan_text(text: str, phrases: tuple[tuple[str, str], ...], notices: tuple[tuple[str, str], ...], error_rate: float) -> tuple:
    words = WORDS.findall(text.encode().lower().decode())
    joined = " ".join(words)
    padded, places, labels = f" {joined} ", [], set()
    starts = list(accumulate((len(w) + 1 for w in words), initial=0))  # of the words in joined, and one beyond the last
    word_at = lambda at: bisect_right(starts, at) - 1
    for phrase, label in phrases:
        at = padded.find(f" {phrase} ")
        while at >= 0:
            places.append(word_at(at))
            labels.add(label)
            at = padded.find(f" {phrase} ", at + 1)
    spans, score = [], 1.0 if places else 0.0
    for label, start, end, edits in finder(notices, error_rate).find(joined):
        likeness = 1.0 - edits / max(end - start, edits, 1)
        score = max(score, likeness)
        spans.append({"label": label, "first_word": word_at(start), "last_word": word_at(end), "edits": edits})
    return (len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels)),
            ",".join(sorted(labels | {s["label"] for s in spans})), score, spans)


FOUND = ("n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, "
         "notices array<struct<label:string,first_word:long,last_word:long,edits:int>>")


def scan(docs: DataFrame, phrases: dict[str, str] = BASE, notices: dict[str, str] = NOTICES, error_rate: float = ERROR_RATE,
         text: str = "text") -> DataFrame:
    """``docs`` with a struct ``found``: base places, labels, the best score, and the notices' word spans and edits."""
    phrases, notices = tuple(phrases.items()), tuple(notices.items())
    names = [x.split()[0] for x in FOUND.split(", ")]

    @F.pandas_udf(FOUND)
    def found(texts: pd.Series) -> pd.DataFrame:
        made = pd.DataFrame([scan_text(x, phrases, notices, error_rate) for x in texts], columns=names)
        for c in ("first_word", "last_word"):
            made[c] = made[c].astype("Int64")
        return made

    return docs.withColumn("found", found(text_of(text)))
