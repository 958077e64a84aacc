"""Benchmark decontamination by a generalised suffix automaton of the test items.

The items' normalised words become integers; one suffix automaton over all items answers, for every
position of a streamed text, the longest item substring that ends there. A match of `window` words
(or a whole item that is shorter) marks its words as hit. An automaton holds at most MAX_TOKENS item
words (or as many bytes times WORD_BYTES; a longer item is cut into pieces that share window - 1 words)
and is broadcast as sorted arrays, about 100 bytes a word. A larger benchmark is cut into several
automata; the texts pass TOGETHER of them at a time, so what a worker holds has a fixed bound.

Streaming is skipped where no match can be: words outside the items' vocabulary, and word pairs that
no item has, break every match, and only runs long enough for the shortest window are walked.

Null texts have no words. Items without words have no windows; items with a null id mark words but are
not named. Repeated rows and ids are judged row by row. Empty documents or an empty benchmark give
rows without hits, an empty table an empty result; texts of any length are scanned whole. Input columns
that are carried along stay, but for those whose names the results take; `decontaminate` and the stage
keep every input column, whatever its name.
"""

from __future__ import annotations

import hashlib
import json
from array import array
from bisect import bisect_left
from itertools import batched

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, short_batches, table

WINDOW = 13
MAX_TOKENS = 500_000
WORD_BYTES = 16
TOGETHER = 4
#: Bytes to words: A-Z lower-cased, everything but 0-9, a-z and bytes from 0x80 on becomes a space.
TABLE = bytes(b + 32 if 65 <= b <= 90 else b if b >= 0x80 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(TABLE).split()


class SuffixAutomaton:
    """Generalised suffix automaton of word sequences.

    next: a dict of transitions a state; link, length: suffix link and longest string; whole: for
    items shorter than the window, (length, item) at the state of the whole item.
    """

    def __init__(self, window: int = WINDOW):
        self.window = window
        self.vocabulary: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.ends: list[set[int]] = [set()]
        self.items: list[list[int]] = []
        self.whole: dict[int, list[tuple[int, int]]] = {}

    def add(self, words: list[bytes]) -> int:
        """Add an item; its number."""
        item = len(self.items)
        codes = [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words]
        self.items.append(codes)
        last = 0
        for c in codes:
            last = self._extend(last, c)
            self.ends[last].add(item)
        return item

    def _state(self, length: int, link: int, moves: dict[int, int]) -> int:
        self.length.append(length)
        self.link.append(link)
        self.next.append(moves)
        self.ends.append(set())
        return len(self.length) - 1

    def _split(self, p: int, q: int, c: int) -> int:
        clone = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = clone
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, c: int) -> int:
        q = self.next[last].get(c)
        if q is not None:
            return q if self.length[q] == self.length[last] + 1 else self._split(last, q, c)
        cur = self._state(self.length[last] + 1, 0, {})
        p = last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = cur
            p = self.link[p]
        if p >= 0:
            q = self.next[p][c]
            self.link[cur] = q if self.length[q] == self.length[p] + 1 else self._split(p, q, c)
        return cur

    def finish(self) -> None:
        """Spread items up the suffix links as far as windows need them; index short items and pairs."""
        order = np.argsort(np.array(self.length), kind="stable")[::-1]
        for s in order:
            up = self.link[s]
            if up >= 0 and self.length[up] >= self.window:
                self.ends[up] |= self.ends[s]
        # where the longest string is too short for a window, the set is never asked for
        for s in order:
            if self.length[s] < self.window:
                self.ends[s] = set()
        for item, codes in enumerate(self.items):
            if 0 < len(codes) < self.window:
                s = 0
                for c in codes:
                    s = self.next[s][c]
                self.whole.setdefault(s, []).append((len(codes), item))
        self.short: list[tuple[tuple[int, int], ...]] = [()] * len(self.link)
        for s in order[::-1]:
            self.short[s] = tuple(self.whole.get(int(s), ())) + (self.short[self.link[s]] if self.link[s] >= 0 else ())
        self.least = min([self.window, *(len(x) for x in self.items if x)])
        v = len(self.vocabulary) + 1
        self.pairs = np.unique(np.array([a * v + b for x in self.items for a, b in zip(x, x[1:], strict=False)], np.int64))

    def arrays(self, ids: list[str | None]) -> dict:
        """What scanning needs, as arrays: moves (state * words + word, sorted) and where they lead, links,
        lengths, pairs, and for each state the items of its windows and the whole short items."""
        v = len(self.vocabulary) + 1
        moves = sorted((s * v + c, to) for s, out in enumerate(self.next) for c, to in out.items())
        named = lambda sets: (np.cumsum([0, *map(len, sets)]).astype(np.int64), np.array([x for s in sets for x in sorted(s)], np.int64))
        short = [[x for pair in s for x in pair] for s in self.short]
        return {
            "words": b" ".join(self.vocabulary),
            "keys": np.array([k for k, _ in moves], np.int64),
            "to": np.array([t for _, t in moves], np.int32),
            "link": np.array(self.link, np.int32),
            "length": np.array(self.length, np.int32),
            "ends": named(self.ends),
            "short": (np.cumsum([0, *map(len, short)]).astype(np.int64), np.array([x for s in short for x in s], np.int64)),
            "pairs": self.pairs,
            "least": self.least,
            "window": self.window,
            "ids": ids,
        }

    def scan(self, words: list[bytes]) -> tuple[np.ndarray, set[int]]:
        """Scan one text; for many, keep a Scanner."""
        return Scanner(self.arrays([None] * len(self.items))).scan(words)


class Scanner:
    """A suffix automaton in arrays: streams texts, state by state."""

    def __init__(self, found: dict):
        self.vocabulary = {w: i for i, w in enumerate(found["words"].split())}
        self.v = len(self.vocabulary) + 1
        as_array = lambda kind, x: array(kind, x.tobytes())
        self.keys, self.to = as_array("q", found["keys"]), as_array("i", found["to"])
        self.link, self.length = as_array("i", found["link"]), as_array("i", found["length"])
        self.ends, self.short = found["ends"], tuple(as_array("q", x) for x in found["short"])
        self.pairs, self.least, self.window, self.ids = found["pairs"], found["least"], found["window"], found["ids"]

    def move(self, state: int, c: int) -> int:
        """The state after word c, -1 if there is none."""
        key = state * self.v + c
        at = bisect_left(self.keys, key)
        return self.to[at] if at < len(self.keys) and self.keys[at] == key else -1

    def runs(self, codes: np.ndarray):
        """(start, end) of the stretches that can hold a match of the shortest window."""
        if self.least == 1:
            ok = codes >= 0
        else:
            key = codes[:-1] * self.v + codes[1:]
            at = np.searchsorted(self.pairs, key)
            ok = (codes[:-1] >= 0) & (codes[1:] >= 0) & (self.pairs[np.minimum(at, len(self.pairs) - 1)] == key) if len(self.pairs) else np.zeros(len(key), bool)
        edge = np.flatnonzero(np.diff(np.concatenate([[0], ok.astype(np.int8), [0]])))
        need = max(1, self.least - 1)
        for s, e in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
            if e - s >= need:
                yield s, e + (self.least > 1)

    def scan(self, words: list[bytes]) -> tuple[np.ndarray, set[int]]:
        """(hit flag of each word, items with a window in the text)."""
        n, found = len(words), set()
        hit = np.zeros(n + 1, np.int32)
        if n < self.least or not self.vocabulary:
            return hit[:n] > 0, found
        codes = np.fromiter(map(self.vocabulary.get, words, [-1] * n), np.int64, n)
        seen: set[int] = set()
        link, lengths, (first, short) = self.link, self.length, self.short
        for start, end in self.runs(codes):
            state = length = 0
            for j, c in enumerate(codes[start:end].tolist(), start):
                to = self.move(state, c)
                while to < 0 and state:
                    state = link[state]
                    length = lengths[state]
                    to = self.move(state, c)
                if to >= 0:
                    state = to
                    length += 1
                if length >= self.window:
                    hit[j - self.window + 1] += 1
                    hit[j + 1] -= 1
                    at = state
                    while lengths[link[at]] >= self.window:
                        at = link[at]
                    seen.add(at)
                for k in range(first[state], first[state + 1], 2):
                    if short[k] <= length:
                        hit[j - short[k] + 1] += 1
                        hit[j + 1] -= 1
                        found.add(short[k + 1])
        of, ends = self.ends
        for s in seen:
            found.update(ends[of[s] : of[s + 1]].tolist())
        return np.cumsum(hit[:n]) > 0, found


def automata(items: DataFrame, item_id: str, text: str, window: int):
    """Yield the arrays of automata that hold at most MAX_TOKENS words each; an empty one if there are no words.

    Rows are fetched one partition at a time, so the driver holds a group and not the benchmark.
    """

    def built(held):
        out = SuffixAutomaton(window)
        for _, words in held:
            out.add(words)
        out.finish()
        return out.arrays([i for i, _ in held])

    held, size, any_ = [], 0, False
    for r in items.select(F.col(item_id).cast("string").alias("i"), F.col(text).cast("string").alias("t")).toLocalIterator():
        words = words_of(r.t)
        for at in range(0, max(1, len(words) - window + 1) if words else 0, MAX_TOKENS):
            piece = words[at : at + MAX_TOKENS + window - 1]
            weight = max(len(piece), sum(map(len, piece)) // WORD_BYTES)
            if held and size + weight > MAX_TOKENS:
                yield built(held)
                held, size, any_ = [], 0, True
            held.append((r.i, piece))
            size += weight
    if held or not any_:
        yield built(held)


_compiled: dict = {}


def compiled(shared) -> list[Scanner]:
    """The scanners of a broadcast, built once a Python worker."""
    key = shared.value[0]
    if key not in _compiled:
        _compiled.clear()
        _compiled[key] = [Scanner(x) for x in shared.value[1]]
    return _compiled[key]


def raw_hits(docs: DataFrame, items: DataFrame, text: str, item_id: str, item_text: str, window: int, carry: tuple[str, ...]) -> DataFrame:
    """c0, c1, ... (the carried columns), n_words, hits and ids (JSON)."""
    spark = docs.sparkSession
    short_batches(spark)
    out = docs.select(*[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(carry)], F.col(f"`{text}`").cast("string").alias("t"))
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in out.schema)
    out = out.withColumns({"n_words": F.lit(0).cast("long"), "hits": F.lit("[]"), "ids": F.lit("[]")})
    passes = batched(automata(items, item_id, item_text, window), TOGETHER)
    groups = next(passes)
    while groups:
        key = hashlib.sha256(b"".join(x["keys"].tobytes() + x["words"] + repr(x["ids"]).encode() for x in groups)).hexdigest()
        shared = spark.sparkContext.broadcast((key, groups))

        def scan(it, shared=shared):
            scanners = compiled(shared)
            for b in it:
                n = b.num_columns
                rows = []
                for t, hits, found in zip(*(b.column(i).to_pylist() for i in (n - 4, n - 2, n - 1)), strict=True):
                    words, names = words_of(t), set(json.loads(found))
                    hit = np.zeros(len(words), bool)
                    for s, e in json.loads(hits):
                        hit[s:e] = True
                    for scanner in scanners:
                        more, items = scanner.scan(words)
                        hit |= more
                        names.update(scanner.ids[i] for i in items if scanner.ids[i] is not None)
                    edge = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]])))
                    rows.append((len(words), json.dumps(edge.reshape(-1, 2).tolist()), json.dumps(sorted(names))))
                added = list(zip(*rows, strict=True)) if rows else [(), (), ()]
                yield pa.RecordBatch.from_arrays([*b.columns[: n - 3], pa.array(added[0], pa.int64()), pa.array(added[1], pa.string()), pa.array(added[2], pa.string())], names=b.schema.names)

        out = out.mapInArrow(scan, f"{kinds}, n_words long, hits string, ids string")
        groups = next(passes, None)
        if groups:
            out = materialise(out, "hits")
    return out.drop("t").withColumns({"hits": F.from_json("hits", "array<array<long>>"), "ids": F.from_json("ids", "array<string>")})


RESULTS = ("n_words", "hits", "item_ids", "n_hit", "n_items", "items_sha256", "contaminated")


def find_hits(docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The carried columns (but for RESULTS) with n_words, hits (runs [start, end) of hit words) and item_ids."""
    carry = tuple(c for c in carry if c not in RESULTS)
    out = raw_hits(docs, items, text, item_id, item_text, window, carry)
    return out.select(*[F.col(f"c{k}").alias(c) for k, c in enumerate(carry)], "n_words", "hits", F.col("ids").alias("item_ids"))


def contamination(docs: DataFrame, items: DataFrame, **more) -> DataFrame:
    """find_hits plus n_hit, n_items, items_sha256 and contaminated (a twentieth of the words or more hit)."""
    found = find_hits(docs, items, **more)
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda a, x: a + x[1] - x[0])
    return found.withColumns({"n_hit": n_hit, "n_items": F.size("item_ids").cast("long"), "items_sha256": F.sha2(F.array_join(F.array_sort("item_ids"), ","), 256)}).withColumn(
        "contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))
    )


def cut_words(text: str, runs: list[tuple[int, int]]) -> str:
    """The text without the stretches from the first to the last word of each run."""
    raw = text.encode("utf-8", "surrogatepass")
    clean, at, k, spans = raw.translate(TABLE), 0, 0, []
    n = len(clean)
    for w in clean.split():
        at = clean.index(w, at)
        spans.append((at, at + len(w)))
        at += len(w)
    out = []
    for s, e in runs:
        out.append(raw[k : spans[s][0]])
        k = spans[e - 1][1]
    return b"".join([*out, raw[k:n]]).decode("utf-8", "surrogatepass")


def decontaminate(docs: DataFrame, items: DataFrame, text: str = "text", coverage: float = 0.05, min_words: int = 1, **more) -> DataFrame:
    """docs without the hit spans of texts whose hit words reach the coverage limit.

    Spans are runs of whole windows, so each has at least a window's words (the length limit). Texts
    below the coverage limit stay as they are; a text with fewer than min_words words left goes.
    """
    columns = docs.columns
    named = {"item_id": "item_id", "item_text": "text", "window": WINDOW} | more
    found = raw_hits(docs, items, text, named["item_id"], named["item_text"], named["window"], tuple(columns))
    kinds = ", ".join(f"`c{k}` {f.dataType.simpleString()}" for k, f in enumerate(docs.schema))
    at = columns.index(text)

    def cut(it):
        for b in it:
            texts, n_words, runs = b.column(at).to_pylist(), *(b.column(len(columns) + k).to_pylist() for k in (0, 1))
            n_hit = [sum(e - s for s, e in r) for r in runs]
            over = [h > 0 and h >= coverage * n for h, n in zip(n_hit, n_words, strict=True)]
            new = [cut_words(t, r) if o else t for t, r, o in zip(texts, runs, over, strict=True)]
            keep = pa.array([not o or len(words_of(t)) >= min_words for t, o in zip(new, over, strict=True)], pa.bool_())
            cols = list(b.columns[: len(columns)])
            cols[at] = pa.array(new, cols[at].type)
            yield pa.RecordBatch.from_arrays(cols, names=[f"c{k}" for k in range(len(columns))]).filter(keep)

    out = found.drop("ids").mapInArrow(cut, kinds)
    return out.select(*[F.col(f"c{k}").alias(c) for k, c in enumerate(columns)])


def op2_benchmark_decontamination(spark, sf_dir) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: contaminated documents lose their benchmark passages; clean ones stay as they are."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))
