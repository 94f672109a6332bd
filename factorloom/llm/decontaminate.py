"""Benchmark decontamination by pigeonhole edit matching.

Texts and test items become lower-case words joined by single spaces. An item of m letters may differ by e = m * ``rate``
edits; cut into e + 1 pieces, at least one piece stays whole in any text within e edits, so one automaton over all pieces
finds every place, and Myers' bit-parallel distance verifies it. A place is skipped before that only if it lacks as many
two-letter runs as e edits must leave. Items below ``least`` letters must stand exactly, as whole words.

Items are the stated query set: they are dealt by hash into blocks of about ``block_chars`` letters, and every block is
searched in all texts. Null and empty texts hold nothing; an item without words is never found. Repeated rows and items
are searched each. Per row and item the nearest place (then the first) is kept, with offsets (code points) into the text.
"""

from __future__ import annotations

import math
import re
import uuid

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factorloom.llm.common import packed, text_of, unpacked, widen
from factorloom.session import materialise

# Words are runs of letters, digits and anything beyond ASCII that is no white space.
WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F\s]+")
BLANKED = bytes(c if c > 127 or chr(c).isalnum() else 32 for c in range(256))
LEAKS = "array<struct<item_id:long,start:int,end:int,edits:int,item_chars:int>>"
RATE, LEAST, BLOCK_CHARS = 0.07, 24, 4_000_000


def plain(text: str) -> str:
    return " ".join(text.lower().encode().translate(BLANKED).decode().split())


def nearest(pattern: str, text: str, most: int) -> tuple[int, int] | None:
    """The least edit distance of ``pattern`` to a stretch of ``text``, and where the first such stretch ends."""
    m = len(pattern)
    masks: dict[str, int] = {}
    for i, c in enumerate(pattern):
        masks[c] = masks.get(c, 0) | 1 << i
    ones, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score, best = ones, 0, m, None
    for j, c in enumerate(text):
        eq = masks.get(c, 0)
        vertical = eq | minus
        diagonal = (((eq & plus) + plus) ^ plus) | eq
        up = minus | (ones & ~(diagonal | plus))
        down = plus & diagonal
        if up & top:
            score += 1
        elif down & top:
            score -= 1
        up, down = (up << 1) & ones, (down << 1) & ones
        plus = down | (ones & ~(vertical | up))
        minus = up & vertical
        if score <= most and (best is None or score < best[0]):
            best = (score, j + 1)
            if score == 0:
                break
    return best


class Items:
    """A block of items with the automaton over their pieces."""

    def __init__(self, items: list[tuple[int, str]], rate: float, least: int):
        self.items, held = [], {}
        for item_id, text in items:
            item = plain(text)
            if not item:
                continue
            edits = int(len(item) * rate) if len(item) >= least else 0
            number = len(self.items)
            self.items.append((item_id, item, edits, len(item) < least))
            bounds = [len(item) * k // (edits + 1) for k in range(edits + 2)]
            for lo, hi in zip(bounds, bounds[1:]):
                held.setdefault(item[lo:hi], []).append((number, lo))
        self.pieces = ahocorasick.Automaton() if held else None
        for piece, uses in held.items():
            self.pieces.add_word(piece, (len(piece), uses))
        if held:
            self.pieces.make_automaton()

    def find(self, raw: str) -> list[tuple]:
        text = plain(raw)
        if not self.pieces or not text:
            return []
        windows: dict[int, list[list[int]]] = {}
        for last, (size, uses) in self.pieces.iter(text):
            for number, at in uses:
                _, item, edits, _ = self.items[number]
                start = last + 1 - size - at - edits
                stop = start + len(item) + 2 * edits
                widen(windows.setdefault(number, []), start, stop)
        found = []
        for number, spans in windows.items():
            best = None
            for start, stop in spans:
                got = self.verify(number, text, max(0, start), min(len(text), stop))
                if got and (best is None or got[0] < best[0]):
                    best = got
            if best:
                found.append((number, *best))
        if not found:
            return []
        # lower-casing may change a word's length, never the number of words
        words, out = [m.span() for m in WORD.finditer(raw)], []
        for number, edits, start, end in found:
            first = text.count(" ", 0, start + (text[start:start + 1] == " "))
            last = text.count(" ", 0, max(start, end - 1))
            start, end = words[first][0], words[min(last, len(words) - 1)][1]
            out.append((self.items[number][0], start, end, edits, len(self.items[number][1])))
        return out

    def verify(self, number: int, text: str, start: int, stop: int) -> tuple[int, int, int] | None:
        """(edits, start, end) in ``text``."""
        _, item, edits, whole = self.items[number]
        if whole:
            m = re.search(rf"(?<![^ ]){re.escape(item)}(?![^ ])", text[max(0, start - 1):stop + 1])
            return (0, max(0, start - 1) + m.start(), max(0, start - 1) + m.end()) if m else None
        at = text.find(item, start, stop)
        if at >= 0:
            return 0, at, at + len(item)
        held = {text[i:i + 2] for i in range(start, stop - 1)}
        if sum(item[i:i + 2] in held for i in range(len(item) - 1)) < len(item) - 1 - 2 * edits:
            return None
        got = nearest(item, text[start:stop], edits)
        if not got:
            return None
        end = start + got[1]
        back = nearest(item[::-1], text[max(start, end - len(item) - edits):end][::-1], got[0])
        return got[0], end - (back[1] if back else len(item)), end


BUILT: dict[str, Items] = {}  # the automaton a worker is using


def block_items(block: str, items: list[tuple[int, str]], rate: float, least: int) -> Items:
    if block not in BUILT:
        BUILT.clear()
        BUILT[block] = Items(items, rate, least)
    return BUILT[block]


def searcher(held, rate: float, least: int):
    """A column function over texts for one broadcast block of items."""
    block = uuid.uuid4().hex

    @F.pandas_udf(LEAKS)
    def leaks(texts: pd.Series) -> pd.Series:
        search = block_items(block, held.value, rate, least).find
        return texts.map(lambda x: [dict(zip(("item_id", "start", "end", "edits", "item_chars"), r)) for r in search(x)])

    return leaks


def with_leaks(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, least: int = LEAST, block_chars: int = BLOCK_CHARS,
               text: str = "text") -> DataFrame:
    """``docs`` with ``leaks`` (in place of a column of that name): item_id, start, end, edits, item_chars of each item found.

    One block of items is broadcast at a time. With more than one, a pass over the texts per block writes what it finds
    under the text's SHA-256, its broadcast is given up, and the found rows meet their texts in the end.
    """
    spark = docs.sparkSession
    items = benchmark.select("item_id", text_of("text").alias("item_text"))
    blocks = math.ceil((items.agg(F.sum(F.length("item_text"))).first()[0] or 0) / block_chars)
    none = F.array().cast(LEAKS)

    def block_of(number: int):
        part = items.where(F.pmod(F.xxhash64("item_id", "item_text"), F.lit(blocks)) == number)
        return spark.sparkContext.broadcast([(r.item_id, r.item_text) for r in part.collect()])

    if blocks == 0:
        return docs.withColumn("leaks", none)
    if blocks == 1:
        return docs.withColumn("leaks", searcher(block_of(0), rate, least)(text_of(text)))
    found = None
    for number in range(blocks):
        held = block_of(number)
        hits = (docs.select(text_of(text).alias("body")).withColumn("leaks", searcher(held, rate, least)("body"))
                .where(F.size("leaks") > 0).select(F.sha2("body", 256).alias("key"), "leaks"))
        hits = materialise(hits.groupBy("key").agg(F.first("leaks").alias("leaks")))
        held.destroy()
        found = hits if found is None else found.unionByName(hits)
    found = found.groupBy("key").agg(F.array_sort(F.flatten(F.collect_list("leaks"))).alias("found_leaks"))
    met = packed(docs).withColumn("key_", F.sha2(text_of(f"row_.{text}"), 256)).join(found, F.col("key_") == F.col("key"), "left")
    return unpacked(met.withColumn("leaks", F.coalesce("found_leaks", none)), docs, "leaks")
