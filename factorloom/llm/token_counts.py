"""Token counts by heap-and-linked-list byte-pair merging.

A text's symbols start as characters in a doubly linked list; a heap holds every adjacent pair that forms a piece, and
the pair of lowest rank (then the leftmost) is merged until none is left. The count is the initial symbols minus the
merges; a character outside the vocabulary stands for its UTF-8 bytes from the start. No identifiers are made.

No piece joins a word to the space mark after it, so a text falls apart at spaces; nor does a merge ever cross two
characters that stand together in no piece, so runs of characters of one connected class are counted on their own. A
task remembers the counts of stretches it has met, up to a bound.

Null text counts as empty: no bytes, no tokens. Repeated rows are counted each; other columns are not looked at.
"""

from __future__ import annotations

import heapq
import re
from collections import Counter
from collections.abc import Iterable
from functools import lru_cache

import pandas as pd
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factorloom.llm.common import text_of

SPACE = "▁"
REMEMBERED = 400_000  # stretches a task remembers; beyond it the memory starts anew
LONGEST_REMEMBERED = 64


def neighbours(pieces: Iterable[str]) -> list[set[str]]:
    """Classes of characters, the space mark aside, connected by standing next to each other in a piece; largest first."""
    of: dict[str, set[str]] = {}
    for piece in pieces:
        own = set(piece) - {SPACE}
        joined = own.union(*(of[c] for c in own if c in of)) if own else own
        for c in joined:
            of[c] = joined
    return sorted({id(x): x for x in of.values()}.values(), key=len, reverse=True)


class MergeCounter:
    """Counts tokens with the ranks of a byte-pair model."""

    def __init__(self, model_file: str):
        model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        special = [model.is_control, model.is_unknown, model.is_byte, model.is_unused]
        plain = [i for i in range(model.get_piece_size()) if not any(f(i) for f in special)]
        self.rank = {model.id_to_piece(i): -model.get_score(i) for i in plain}
        if any(SPACE in p[1:] and p.strip(SPACE) for p in self.rank):
            raise ValueError("the vocabulary joins words, so a text can't be cut at its spaces")
        runs = "|".join(f"[{''.join(map(re.escape, sorted(c)))}]+" for c in neighbours(self.rank) if len(c) > 1)
        self.stretch = re.compile(f"{SPACE}*(?:{runs}|[^{SPACE}])|{SPACE}+")
        self.memory: dict[str, int] = {}

    def merge(self, word: str) -> int:
        """Tokens of one stretch."""
        n, rank = len(word), self.rank
        count = n + sum(len(c.encode()) - 1 for c in word if c not in rank)
        if n == 1:
            return count
        piece = list(word)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(r, i, 2) for i in range(n - 1) if (r := rank.get(word[i:i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, size = heapq.heappop(heap)
            j = after[i] if piece[i] else n
            if j >= n or len(piece[i]) + len(piece[j]) != size:  # one of the two has been merged since
                continue
            piece[i] += piece[j]
            piece[j] = ""
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            count -= 1
            for left, right in ((before[i], i), (i, after[i])):
                if left >= 0 and right < n and (r := rank.get(piece[left] + piece[right])) is not None:
                    heapq.heappush(heap, (r, left, len(piece[left]) + len(piece[right])))
        return count

    def count(self, text: str) -> int:
        if not text:
            return 0
        total = 0
        for word, times in Counter(self.stretch.findall(SPACE + text.replace(" ", SPACE))).items():
            tokens = self.memory.get(word)
            if tokens is None:
                tokens = self.merge(word)
                if len(word) <= LONGEST_REMEMBERED:
                    if len(self.memory) >= REMEMBERED:
                        self.memory.clear()
                    self.memory[word] = tokens
            total += times * tokens
        return total


@lru_cache(maxsize=2)
def counter(model_file: str) -> MergeCounter:
    return MergeCounter(model_file)


def count_tokens(docs: DataFrame, model_file: str, limit: int, text: str = "text") -> DataFrame:
    """``docs`` with n_bytes, n_tokens and over_limit (n_tokens > limit) in place of columns of these names."""

    @F.pandas_udf("long")
    def tokens(texts: pd.Series) -> pd.Series:
        return texts.map(counter(model_file).count).astype("int64")

    body = text_of(text)
    return (docs.withColumn("n_tokens", tokens(body)).withColumn("n_bytes", F.octet_length(body).cast("long"))
            .withColumn("over_limit", F.col("n_tokens") > F.lit(limit)))
