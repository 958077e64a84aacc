"""Periodic runs of words: maximal repetitions by Lyndon arrays, without suffix structures or hashes.

A run is a stretch of words with smallest period q that no neighbouring word extends. The method is that
of Ellert and Fischer for general ordered alphabets: in one pass from left to right the next and previous
smaller suffixes of every position are found, and each comparison of two suffixes keeps the length of their
common prefix. A comparison inside the furthest stretch that is already known to repeat takes its length
from the earlier copy; otherwise it goes on where that stretch ends. So letters are matched at most once
each, and mismatch once a comparison: linear time. Every run has a root [i, nss[i]) under the order of words
or its reverse, so that two passes give all runs. A root's extension to the right is the kept length; to the
left, less than one period is looked at, once a run.

Only runs of at least `exponent` periods and `least` words are asked for. With an exponent e of 2 or more each word of
such a run stands floor(e) times in it, and so does a neighbour that would extend it; rarer words therefore cut a
text into stretches that are searched one by one, and most ordinary prose is never searched at all.

Each text is a row's own work: nothing is shuffled, nothing is broadcast, a lost executor costs its own tasks.

Defined results. Null and empty texts, and texts without words, have no runs and an empty collapsed text.
Very long texts are taken whole; memory grows with their words. Ties: runs are listed by start, then period.
Repeated rows and null ids are worked on row by row. An empty table gives an empty result. Other columns,
also those whose names clash with result columns, are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ASCII_SPACE, short_batches, table

#: Runs that count: so many words, and so many periods, at least.
LEAST, EXPONENT = 24, 3
RUNS = "array<struct<start: long, length: long, period: long>>"


def smaller_suffixes(w: list[int]) -> tuple[list[int], list[int]]:
    """nss and lce for w[:-1], whose last letter is smaller than all others.

    nss[i] is the next position after i whose suffix is smaller, lce[i] the common prefix of both suffixes.
    """
    n = len(w) - 1
    nss, lce, pss, back = [n] * n, [0] * n, [-1] * n, [0] * n
    left = right = end = 0  # w[left : left + end - right] equals w[right : end], the furthest stretch known to repeat
    for i in range(1, n):
        j, e, copied = i - 1, 0, i < end
        while True:
            if copied:
                # the suffixes at the same places of the earlier copy were compared, and this is what they shared
                k = j - right + left
                m = i - right + left
                e = lce[k] if nss[k] == m else back[m]
                copied = i + e < end
                if not copied:
                    e = end - i
            if not copied:
                while w[j + e] == w[i + e]:
                    e += 1
            while True:
                if i + e >= end:
                    left, right, end = j, i, i + e
                if w[j + e] < w[i + e]:
                    pss[i], back[i] = j, e
                    j = -1
                    break
                nss[j], lce[j] = i, e
                f, j = back[j], pss[j]
                if j < 0 or f == e:
                    break
                if f < e:
                    e = f
            if j < 0:
                break
            copied = j >= right and i + e < end
    return nss, lce


def runs_in(a: list[int], least: int, exponent: int) -> set[tuple[int, int, int]]:
    """(start, length, period) of the runs of a, whose letters are numbers of 0 and more."""
    found: set[tuple[int, int, int]] = set()
    top = max(a) + 1
    for w in ([*a, -1], [*(top - x for x in a), -1]):
        nss, lce = map(np.array, smaller_suffixes(w))
        period = nss - np.arange(len(nss))
        # the leftmost root of a run of e periods has less than one period before it
        roots = np.flatnonzero((lce > (exponent - 2) * period) & (lce + 2 * period > least))
        seen = set()
        for i, p, e in zip(roots.tolist(), period[roots].tolist(), lce[roots].tolist(), strict=True):
            stop = i + p + e
            if (stop, p) in seen:
                continue
            seen.add((stop, p))
            start = i
            while start and w[start - 1] == w[start - 1 + p]:
                start -= 1
            if stop - start >= max(least, exponent * p):
                found.add((start, stop - start, p))
    return found


def find_runs(words: list, least: int = LEAST, exponent: int = EXPONENT) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of at least `least` words and `exponent` (2 or more) periods, by start, then period."""
    if exponent < 2:
        raise ValueError("runs have two periods at least")
    if len(words) < max(least, exponent):
        return []
    number: dict = {}
    letters = np.fromiter(map(number.setdefault, words, range(len(words))), np.int64, len(words))
    often = np.bincount(letters)[letters] >= exponent
    edges = np.flatnonzero(np.diff(np.concatenate([[0], often.view(np.int8), [0]])))
    found = []
    for s, e in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
        if e - s >= max(least, exponent):
            found += [(s + start, length, p) for start, length, p in runs_in(letters[s:e].tolist(), least, exponent)]
    return sorted(found, key=lambda r: (r[0], r[2]))


def collapse(words: list, runs: list[tuple[int, int, int]]) -> list:
    """The words that no run holds after its first period."""
    if not runs:
        return words
    depth = np.zeros(len(words) + 1, np.int64)
    for start, length, p in runs:
        depth[start + p] += 1
        depth[start + length] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(depth[:-1]) == 0).tolist()]


def scan(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", least: int = LEAST, exponent: int = EXPONENT) -> DataFrame:
    """(doc_id, n_words, runs, collapsed) of every row; collapsed is the text without repeated periods, words joined by one space."""
    short_batches(docs.sparkSession)
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").cast("string").cast("binary").alias("text"))
    kind = dict(rows.dtypes)["doc_id"]

    def search(batches):
        for b in batches:
            n_words, runs, kept = [], [], []
            for t in b.column(1):
                words = (t.as_py() or b"").split()  # at the ASCII white space of the contract
                own = find_runs(words, least, exponent)
                n_words.append(len(words))
                runs.append([{"start": s, "length": n, "period": p} for s, n, p in own])
                kept.append(b" ".join(collapse(words, own)))
            cells = pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n_words, pa.int64()), pa.array(runs, cells), pa.array(kept, pa.binary()).cast(pa.string())], names=["doc_id", "n_words", "runs", "collapsed"])

    return rows.mapInArrow(search, f"doc_id {kind}, n_words long, runs {RUNS}, collapsed string")


def strongest(runs: Column) -> Column:
    """The run of the greatest length / period, compared exactly; of equals the first listed. Null without runs."""
    return F.reduce(runs, F.get(runs, F.lit(0)), lambda best, r: F.when(r["length"] * best["period"] > best["length"] * r["period"], r).otherwise(best))


def repeated_tails(docs: DataFrame) -> DataFrame:
    """The contract's texts: where crc32(doc_id) divides by ten, the words from a on repeat with period p."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.filter(F.split("text", ASCII_SPACE + "+"), lambda w: w != "")

    def repeat(ws: Column) -> Column:
        n, g = F.size(ws), F.floor(h / 10)
        a = F.pmod(g, n).cast("int")
        p = (1 + F.floor((n - a) / (3 + F.pmod(g, F.lit(8))))).cast("int")
        place = lambda xs: F.transform(ws, lambda w, i: F.when(i >= xs["a"], F.get(ws, xs["a"] + F.pmod(i - xs["a"], xs["p"]))).otherwise(w))
        return F.array_join(F.get(F.transform(F.array(F.struct(a.alias("a"), p.alias("p"))), place), F.lit(0)), " ")

    held = F.get(F.transform(F.array(words), lambda ws: F.when(F.size(ws) > 0, repeat(ws)).otherwise(F.lit(""))), F.lit(0))
    return docs.withColumn("text", F.when(F.pmod(h, F.lit(10)) == 0, held).otherwise(F.col("text")))


def op11_periodic_runs(spark, sf_dir) -> DataFrame:
    """Runs of every whole document (a null id leaves its text as it is)."""
    found = scan(repeated_tails(table(spark, sf_dir, "documents").select("doc_id", "text")))
    listed = F.array_join(F.transform("runs", lambda r: F.format_string("%d,%d,%d\n", r["start"], r["length"], r["period"])), "")
    best = found.withColumn("best", strongest(F.col("runs")))
    return best.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        *[F.col(f"best.{c}").alias(c) for c in ("start", "length", "period")],
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(listed.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
        "n_words",
    )
