"""Toxicity: a weighted lexicon, matched by Aho-Corasick over folded text.

Folding lower-cases, maps homoglyphs (Cyrillic, Greek, full-width) to Latin letters, drops invisible
characters and undoes digit and symbol substitutions inside words. The lexicon is learned from labelled
rows: words and word beginnings that mark toxic texts, each weighted by its log odds. Matches inside an
exception phrase don't count: a fixed list, and the pairs of neighbouring words around an entry's match
that clean training rows have at least twice and toxic ones never. The logarithm of one plus the sum of weights, divided by a power of the text's length, goes through
a logistic function; the power, slope and offset are fitted with the lexicon.

Learning uses at most ROWS labelled training rows of each label, of at most CHARS characters each (the
bounds are parameters), one an id, chosen by a hash of the id, in one task; its result, at most ENTRIES entries, is broadcast. Scoring reads every
whole text and nothing but the text.

Null texts are empty texts. Without labelled rows of both kinds every score is 0. Repeated rows and ids
are scored row by row; a null id counts as the empty string when rows are held out. Rows with a null
label aren't learned from. An empty table gives an empty result. Extra columns are not read.
"""

from __future__ import annotations

import json
import math
import re
import zlib
from collections import Counter, defaultdict

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import short_batches, table

ROWS = 6000
#: Characters of a text that is learned from, at most.
CHARS = 20_000
ENTRIES = 2000
PREFIXES = (4, 5, 6)
#: Toxic training rows that an entry needs, however many there are; chance is left to the log odds.
LEAST = 4
#: Phrases in which a lexicon word is no insult.
EXCEPTIONS = ("trash can", "trash bin", "trash bag", "clown fish", "clown college", "pathetic fallacy", "idiot proof", "scum line", "stupid simple")

#: Letters that look Latin, and what they look like.
HOMOGLYPHS = str.maketrans("аеіјорсухкмтвнѕԁһӏαειοκνρτυχβ", "aeijopcyxkmtbhsdhlaeiokvptuxb")
INVISIBLE = re.compile("[­​-‏⁠﻿]")
FOREIGN = re.compile("[­Ͱ-֏​-‏⁠﻿！-～]")
FULL_WIDTH = {0xFF01 + k: 0x21 + k for k in range(94)}
#: Digits and symbols that stand for letters inside words.
SUBSTITUTES = str.maketrans("0134578@$!|", "oieastbasil")
MIXED = re.compile(r"(?:[^\W\d_]|[@$])*(?:[^\W\d_](?=[0-9@$!|])|[0-9@$](?=[^\W\d_]))[0-9@$!|]?[^\W_@$!|]*(?:[@$!|][^\W_]+)*[$]?")
#: Only tokens with such a character can hold a substitution; a text without any is left alone.
SUSPECT = re.compile(r"[0-9@$!|]")
TOKEN = re.compile(r"\S*[0-9@$!|]\S*")
WORD = re.compile(r"[^\W_]+")


def fold(text: str | None) -> str:
    """The folded words, each between single spaces."""
    t = (text or "").lower()
    if FOREIGN.search(t):
        t = INVISIBLE.sub("", t.translate(FULL_WIDTH)).lower().translate(HOMOGLYPHS)
    if SUSPECT.search(t):
        t = TOKEN.sub(lambda x: MIXED.sub(lambda m: m.group().translate(SUBSTITUTES), x.group()), t)
    return f" {' '.join(WORD.findall(t))} "


class Lexicon:
    """entries: " word " or " beginning" -> weight; exceptions: phrases; a, b, power: the logistic's fit."""

    def __init__(self, entries: dict[str, float], exceptions=EXCEPTIONS, a: float = -50.0, b: float = 0.0, power: float = 0.0):
        self.entries, self.exceptions, self.a, self.b, self.power = entries, tuple(exceptions), a, b, power
        self.automaton = ahocorasick.Automaton()
        for e, w in entries.items():
            self.automaton.add_word(e, (len(e), w))
        for e in self.exceptions:
            phrase = fold(e)
            self.automaton.add_word(phrase, (len(phrase), None))
        if len(self.automaton):
            self.automaton.make_automaton()

    def weight(self, folded: str) -> float:
        """The weights of the matches that no exception phrase covers; of several at one word, the largest."""
        if not len(self.automaton):
            return 0.0
        best: dict[int, float] = {}
        excepted = []
        for end, (size, w) in self.automaton.iter(folded):
            start = end - size + 1
            if w is None:
                excepted.append((start, end))
            elif w > best.get(start, 0.0):
                best[start] = w
        if excepted and best:
            best = {s: w for s, w in best.items() if not any(x <= s < y for x, y in excepted)}
        return math.fsum(best.values())

    def feature(self, folded: str) -> float:
        return math.log1p(self.weight(folded)) / max(1, folded.count(" ") - 1) ** self.power

    def score(self, text: str | None) -> float:
        if not self.b:
            return 0.0
        x = self.a + self.b * self.feature(fold(text))
        return 1 / (1 + math.exp(-x)) if x > -700 else 0.0

    def dump(self) -> str:
        return json.dumps([self.entries, self.exceptions, self.a, self.b, self.power])


def terms(folded: str) -> set[str]:
    """What an entry can be: the words and their beginnings."""
    words = set(folded.split())
    out = {f" {w} " for w in words}
    for k in PREFIXES:
        out.update(f" {w[:k]}" for w in words if len(w) > k)
    return out


def unlike(folded: list[tuple[str, int]]) -> list[tuple[str, int]]:
    """One row of each group of near copies, or their common words would pass for toxic ones.

    Rows are near copies if they share one of four pairs of word-hash minima.
    """
    seen: dict[tuple, int] = {}
    out = []
    for f, y in folded:
        words = {w.encode() for w in f.split()}
        bands = [(k, y, *(min((zlib.crc32(w, 2 * k + j) for w in words), default=0) for j in (0, 1))) for k in range(4)]
        if not any(b in seen for b in bands):
            out.append((f, y))
        seen.update(dict.fromkeys(bands, 1))
    return out


def learn(rows: list[tuple[str, int]], entries: int = ENTRIES) -> Lexicon:
    """Entries by set cover: again and again the term that marks most toxic texts not yet marked by a
    better one, weighted by its log odds; then every other word that is as telling on its own."""
    folded = [(fold(t), y) for t, y in rows]
    clean = [x for x in folded if not x[1]]  # with its copies: what is common in clean texts is no sign
    folded = unlike([x for x in folded if x[1]]) + clean
    n_pos = sum(y for _, y in folded)
    n_neg = len(folded) - n_pos
    if not n_pos or not n_neg:
        return Lexicon({})
    negatives: Counter = Counter()
    where: dict[str, list[int]] = defaultdict(list)
    for i, (f, y) in enumerate(folded):
        if y:
            for t in terms(f):
                where[t].append(i)
    where = {t: d for t, d in where.items() if len(d) >= 3}
    for f, y in folded:
        if not y:
            negatives.update(terms(f) & where.keys())
    odds = {t: math.log((len(d) + 0.5) / (n_pos + 1)) - math.log((negatives[t] + 0.5) / (n_neg + 1)) for t, d in where.items()}
    telling = {t for t, o in odds.items() if o >= 3.5 and len(where[t]) >= LEAST and len(where[t]) >= 20 * negatives[t]}
    chosen: dict[str, float] = {}
    left = {i for i, (_, y) in enumerate(folded) if y}
    gain = {t: len(where[t]) for t in telling}
    while gain and len(chosen) < entries:
        # of equal gains, the clearer and then the longer term; the text itself settles ties
        t = max(gain, key=lambda t: (gain[t], round(odds[t], 6), len(t), t))
        if gain[t] < 3:
            break
        chosen[t] = odds[t]
        done = left.intersection(where[t])
        left -= done
        gain = {u: g for u, g in ((u, len(left.intersection(where[u])) if not done.isdisjoint(where[u]) else g) for u, g in gain.items()) if g and u not in chosen}
    beginnings = tuple(t for t in chosen if t[-1] != " ")
    for t in sorted(telling, key=lambda t: (-odds[t], t)):
        if len(chosen) >= entries:
            break
        if t not in chosen and t[-1] == " " and not t.startswith(beginnings):
            chosen[t] = odds[t]
    return fit(Lexicon(chosen, (*EXCEPTIONS, *exceptions(chosen, folded))), folded)


def exceptions(chosen: dict[str, float], folded: list[tuple[str, int]], most: int = ENTRIES) -> list[str]:
    """Two-word phrases around a match that clean rows have, at least twice, and toxic rows never."""
    plain, seen = Lexicon(chosen, ()), (Counter(), Counter())
    if not chosen:
        return []
    for f, y in folded:
        for start in {end - size + 1 for end, (size, _) in plain.automaton.iter(f)}:
            before, stop = f.rfind(" ", 0, start), f.find(" ", start + 1)
            after = f.find(" ", stop + 1)
            if before >= 0:
                seen[y][f[before + 1 : stop]] += 1
            if after >= 0:
                seen[y][f[start + 1 : after]] += 1
    found = [p for p, n in seen[0].items() if n >= 2 and p not in seen[1]]
    return sorted(found, key=lambda p: (-seen[0][p], p))[:most]


def fit(lexicon: Lexicon, folded: list[tuple[str, int]]) -> Lexicon:
    """The power of the length, slope and offset with the least log loss, classes weighted alike."""
    y = np.array([v for _, v in folded], float)
    weight = np.where(y > 0, 0.5 / max(y.sum(), 1), 0.5 / max((1 - y).sum(), 1))
    total = np.log1p(np.array([lexicon.weight(f) for f, _ in folded]))
    words = np.array([max(1, f.count(" ") - 1) for f, _ in folded], float)
    best = None
    for power in (0.05, 0.1, 0.25, 0.5, 1.0):
        x = total / words**power
        scale = x[y > 0].mean() or 1.0
        a, b = -1.0, 1.0
        for _ in range(60):
            p = 1 / (1 + np.exp(-np.clip(a + b * x / scale, -30, 30)))
            g = weight * (p - y)
            h = weight * p * (1 - p) + 1e-9
            ga, gb = g.sum() + 1e-3 * a, (g * x / scale).sum() + 1e-3 * b
            haa, hab, hbb = h.sum() + 1e-3, (h * x / scale).sum(), (h * (x / scale) ** 2).sum() + 1e-3
            det = haa * hbb - hab * hab
            a, b = a - (hbb * ga - hab * gb) / det, b - (haa * gb - hab * ga) / det
        p = np.clip(1 / (1 + np.exp(-np.clip(a + b * x / scale, -30, 30))), 1e-9, 1 - 1e-9)
        loss = -(weight * (y * np.log(p) + (1 - y) * np.log(1 - p))).sum()
        if best is None or loss < best[0] - 1e-9:
            best = (loss, float(a), float(b / scale), power)
    return Lexicon(lexicon.entries, lexicon.exceptions, *best[1:])


def remainder(doc_id: Column, folds: int) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % folds


def training_rows(docs: DataFrame, labels: DataFrame, label: str, folds: int, held: int, rows: int, chars: int = CHARS) -> DataFrame:
    """(text, y): at most `rows` labelled rows of each label outside the held-out fold, by a hash of the id.

    Ids are chosen from the labels alone; at most 2 * rows of them meet the documents, so their side of
    the join has a fixed size. Of several documents with one id the least text counts; texts of more than
    `chars` characters are not learned from, so that what reaches the learner has a bound in bytes too.
    """
    usable = labels.select(F.col("doc_id").alias("__id"), F.col(label).cast("int").alias("y")).filter("y IN (0, 1) AND __id IS NOT NULL").filter(remainder(F.col("__id"), folds) != held)
    chosen = None
    for y in (0, 1):
        part = usable.filter(F.col("y") == y).distinct().orderBy(F.xxhash64("__id"), "__id").limit(rows)
        chosen = part if chosen is None else chosen.unionAll(part)
    texts = docs.select(F.col("doc_id").alias("__doc"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).filter(F.length("text") <= chars)
    met = texts.join(F.broadcast(chosen), F.col("__doc") == F.col("__id"))
    return met.groupBy("__id", "y").agg(F.min("text").alias("text")).select("text", "y")


def train(rows: DataFrame, learner) -> str:
    """Run a learner over bounded rows in one task; its result as JSON."""

    def once(it):
        held = []
        for b in it:
            held += zip((t or "" for t in b.column(0).to_pylist()), b.column(1).to_pylist(), strict=True)
        yield pa.RecordBatch.from_arrays([pa.array([learner(sorted(held))], pa.string())], names=["model"])

    got = rows.repartition(1).mapInArrow(once, "model string").collect()
    return got[0].model if got else learner([])


def score(docs: DataFrame, model: str, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, score) of every row."""
    short_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def batches(it):
        lexicon = Lexicon(*json.loads(shared.value))
        for b in it:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([lexicon.score(t) for t in b.column(1).to_pylist()], pa.float64())], names=["doc_id", "score"])

    kind = docs.select(F.col(doc_id)).schema[0].dataType.simpleString()
    return docs.select(F.col(doc_id), F.col(text).cast("string")).mapInArrow(batches, f"doc_id {kind}, score double")


def op6_toxicity(spark, sf_dir) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = train(training_rows(docs, labels, "toxic", 5, 0, ROWS), lambda rows: learn(rows).dump())
    return score(docs, model).select("doc_id", (remainder(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
