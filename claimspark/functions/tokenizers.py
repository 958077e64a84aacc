"""Tokenizers as columns: a tokenizer cuts a text into pieces that make up the text again, and says which are tokens.

Offsets are sums of lengths, so that any tokenizer gives spans, counts and slices. `REGISTRY` has those by
name; callers add their own.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from functools import cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

BLANK = r"[ \t\n\f\r]"


@dataclass(frozen=True)
class Tokenizer:
    """pieces: text -> array<string> that joins to the text (null: none); a piece of white space is no token."""

    pieces: Callable[[Column], Column]

    def tokens(self, text: Column) -> Column:
        return F.filter(self.pieces(text), lambda p: ~p.rlike(f"^{BLANK}*$"))

    def count(self, text: Column) -> Column:
        return F.size(self.tokens(text)).cast("long")


def by_pattern(pattern: str) -> Tokenizer:
    """Matches of a pattern that covers every text, in the JVM."""
    return Tokenizer(lambda text: F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"({pattern})"), F.lit(1)))


def longest_match(vocabulary: Iterable[str]) -> Tokenizer:
    """At each place the longest entry of the vocabulary, else one character; white space stands alone.

    The vocabulary goes out with the function, so it is of bounded size; the trie is built once a worker process.
    """
    words = tuple(sorted({w for w in vocabulary if w}))

    @F.pandas_udf("array<string>")
    def cut(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        root = _trie(words)
        for batch in texts:
            yield pd.Series([matches(root, t or "") for t in batch], dtype=object)

    return Tokenizer(lambda text: cut(text))


@cache
def _trie(words: tuple[str, ...]) -> dict:
    root: dict = {}
    for w in words:
        node = root
        for c in w:
            node = node.setdefault(c, {})
        node[""] = True
    return root


def matches(root: dict, text: str) -> list[str]:
    """The pieces of a text; linear but for entries that begin and don't end."""
    out, at = [], 0
    while at < len(text):
        node, end, best = root, at, at + 1
        while end < len(text) and (node := node.get(text[end])) is not None:
            end += 1
            if "" in node:
                best = end
        out.append(text[at:best])
        at = best
    return out


#: Runs without white space; runs of letters and digits, and marks on their own.
REGISTRY: dict[str, Tokenizer] = {
    "runs": by_pattern(rf"[^ \t\n\f\r]+|{BLANK}+"),
    "marks": by_pattern(rf"[\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_ \t\n\f\r]|{BLANK}+"),
}
