"""Removal of repeated substrings by prefix-free parsing.

A byte is removed if a `length`-byte string that covers it also starts anywhere else in the corpus, the
same text included. Strings never cross texts and are judged on the input.

Parsing. A rolling hash over `gram` bytes triggers phrases: the trigger of a window of `length` bytes is
the least hash among the grams that begin in its first `reach` bytes (the leftmost of equals). It depends
on the window's bytes alone, so equal windows have their trigger at the same offset, wherever they
stand. Consecutive windows with one trigger form a phrase: the bytes from the first window's start to
the last one's end. All windows with a trigger share the bytes that follow it, its key.

Dictionary. Blocks of texts send their distinct (key, phrase) fingerprints with counts to the
partition of the key. In corpus order (suffixes sorted as far as `length` bytes) equal windows are
neighbours, and that order is needed only between suffixes of phrases that share a key:
- a key with one phrase, seen once: no window of it stands anywhere else;
- a phrase seen twice or more: all its windows are repeated;
- a key with several phrases: the suffixes of its phrases are sorted. A phrase seen twice or more
  sends them once for all its copies.
Sorting. These suffixes, cut to `length` bytes, go to the partition of their own fingerprint and are
sorted there; a run of two or more is a repeated window. Only equality matters, so the sort key is the
128-bit fingerprint of a suffix (of its key and itself for a phrase) instead of its bytes. This is where
the method departs from suffix arrays over bytes: a passage in a third of all texts makes as many
phrases with one key as it has surroundings, and only a hash deals these to many tasks.

A block sends each distinct entry once, with its count, so that a passage in a third of all texts
makes an entry a block at most; messages are packed (`mail`), so that work grows with the entries and not
with blocks times partitions. The text table and the answers are bucketed by block and meet without a
shuffle. Blocks work through their bytes CHUNK at a time, however long a text is; phrases
cut at a chunk's end are compared through their suffixes.

Null texts are empty: nothing to remove. Repeated rows are copies of each other. Null and repeated ids
keep their rows. An empty table gives an empty result. Extra columns, also those with
clashing names, are not read.
"""

from __future__ import annotations

import json
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bucketed, parts_for, short_batches, table
from .katz import ANSWERS, gathered, mixed
from .mail import LETTERS, Sheet, by_part, letters, pack_columns, read, sizes_of, unpack_columns

CHUNK = 1 << 20
BLOCK_BYTES = 8 << 20
PART_ENTRIES = 500_000
BASE, OTHER = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
#: What became of a phrase: alone; copied; copied with other phrases at its key; the same, sent by this block; on its own among others.
ALONE, COPIED, COPIED_OTHERS, SENT, OPEN = range(5)


@dataclass(frozen=True)
class Parsing:
    length: int = 200
    reach: int = 130
    gram: int = 24

    @property
    def key(self) -> int:
        """Bytes from the trigger on that all its windows hold."""
        return self.length - self.reach + 1


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class Hasher:
    """Fingerprints of any stretch of a chunk by prefix sums of b[i] * base^i modulo 2^64, mixed."""

    def __init__(self, base: np.uint64, seed: int, n: int):
        inverse = np.uint64(pow(int(base), -1, 1 << 64))
        self.up, self.down = powers(base, n), powers(inverse, n)
        self.values = np.random.default_rng(seed).integers(0, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)

    def load(self, data: np.ndarray) -> Hasher:
        self.sums = np.empty(len(data) + 1, np.uint64)
        self.sums[0] = 0
        np.cumsum(self.values[data] * self.up[: len(data)], out=self.sums[1:])
        return self

    def every(self, size: int, n: int) -> np.ndarray:
        """Of the stretches [i, i + size) for i < n."""
        return mixed((self.sums[size : size + n] - self.sums[:n]) * self.down[:n])

    def at(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.sums[end] - self.sums[start]) * self.down[start])


@cache
def hashers(margin: int, chunk: int) -> tuple[Hasher, Hasher]:
    n = chunk + margin + 1
    return Hasher(BASE, 1, n), Hasher(OTHER, 2, n)


def phrases(data: np.ndarray, ends: np.ndarray, how: Parsing):
    """For each chunk of a block's bytes: (offset, first starts, last starts, key, phrase fingerprint, hashers).

    data: the texts' bytes, joined; ends: where each text ends.
    """
    for at in range(0, len(data), CHUNK):
        n = min(CHUNK, len(data) - at)
        piece = data[at : at + n + how.length - 1]
        if len(piece) < how.length:
            continue
        n = min(n, len(piece) - how.length + 1)
        # windows that end inside their text
        inside = np.ones(n, bool)
        near = ends[np.searchsorted(ends, at + 1) : np.searchsorted(ends, at + n + how.length)] - at
        for e in near.tolist():
            inside[max(0, e - how.length + 1) : max(0, min(n, e))] = False
        if not inside.any():
            continue
        first, second = hashers(how.length, CHUNK)
        first.load(piece), second.load(piece)
        grams = first.every(how.gram, n + how.reach - 1)
        least = (grams & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(grams), dtype=np.uint64)
        width = 1
        while 2 * width <= how.reach:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        if width < how.reach:
            least = np.minimum(least[: len(least) - (how.reach - width)], least[how.reach - width :])
        trigger = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
        trigger[~inside] = -1
        change = np.flatnonzero(np.concatenate([[True], trigger[1:] != trigger[:-1]]))
        stop = np.append(change[1:], n)
        kept = trigger[change] >= 0
        s, e = change[kept], stop[kept] - 1
        t = trigger[s]
        key = first.at(t, t + how.key)
        shape = ((e - s) << 32 | (t - s)).astype(np.uint64)
        whole = mixed(second.at(s, e + how.length) ^ mixed(shape + np.uint64(1)))
        yield at, s, e, key, whole, first, second


class Texts:
    """A block: ids, byte lengths and the joined bytes."""

    def __init__(self, ids: list, lengths: np.ndarray, data: bytes):
        self.ids, self.lengths, self.data = ids, lengths, np.frombuffer(data, np.uint8)
        self.ends = np.cumsum(lengths)

    def dump(self) -> bytes:
        head = json.dumps([self.ids, self.lengths.tolist()]).encode()
        return len(head).to_bytes(8, "little") + zstandard.compress(head + self.data.tobytes(), 3)

    @staticmethod
    def load(body: bytes) -> Texts:
        n, raw = int.from_bytes(body[:8], "little"), zstandard.decompress(body[8:])
        ids, lengths = json.loads(raw[:n])
        return Texts(ids, np.array(lengths, np.int64), raw[n:])

    def entries(self, how: Parsing):
        """(key, phrase, first start, last start) of all phrases, starts counted in the block."""
        found = [(k, w, s + at, e + at) for at, s, e, k, w, _, _ in phrases(self.data, self.ends, how)]
        if not found:
            return np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))

    def phrase_request(self, parts: int, how: Parsing):
        """Distinct (key, phrase) sorted by part, key, phrase: part, key, phrase, count, entry of each phrase, its first phrase."""
        key, whole, s, e = self.entries(how)
        order = np.lexsort((whole, key))
        order = order[by_part((key[order] % np.uint64(parts)).astype(np.int64))]
        k, w = key[order], whole[order]
        new = changes(k, w)
        group = np.cumsum(new) - 1
        entry = np.empty(len(order), np.int64)
        entry[order] = group
        counts = np.bincount(group, minlength=int(new.sum()))
        return (k[new] % np.uint64(parts)).astype(np.int64), k[new], w[new], counts, entry, order[new], s, e

    def suffixes(self, codes: np.ndarray, entry: np.ndarray, leader: np.ndarray, how: Parsing):
        """Windows of OPEN phrases and of the leaders of SENT ones: (start, fingerprint, second fingerprint, count)."""
        mine = codes[entry]
        lead = np.zeros(len(entry), bool)
        lead[leader] = True
        wanted = (mine == OPEN) | ((mine == SENT) & lead)
        done, out = 0, []
        for at, s, e, _, _, first, second in phrases(self.data, self.ends, how):
            here = np.flatnonzero(wanted[done : done + len(s)])
            if len(here):
                size = e[here] - s[here] + 1
                start = np.repeat(s[here] - np.cumsum(size) + size, size) + np.arange(size.sum())
                count = np.repeat(np.where(mine[done + here] == SENT, 2, 1), size)
                out.append((start + at, first.at(start, start + how.length), second.at(start, start + how.length), count))
            done += len(s)
        if not out:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))

    def suffix_request(self, codes, entry, leader, parts: int, how: Parsing):
        """Distinct suffixes sorted by part and fingerprint: part, fingerprints, count, suffix of each start, starts."""
        start, a, b, count = self.suffixes(codes, entry, leader, how)
        order = sorted_pairs(a, b)
        order = order[by_part((a[order] % np.uint64(parts)).astype(np.int64))]
        x, y = a[order], b[order]
        new = changes(x, y)
        group = np.cumsum(new) - 1
        which = np.empty(len(order), np.int64)
        which[order] = group
        total = np.bincount(group, weights=count[order], minlength=int(new.sum())).astype(np.int64)
        return (x[new] % np.uint64(parts)).astype(np.int64), x[new], y[new], np.minimum(total, 2), which, start

    def spans(self, codes, entry, s, e, repeated_starts: np.ndarray, how: Parsing) -> list[list[tuple[int, int]]]:
        """Maximal removed runs of every text, as byte offsets in it."""
        depth = np.zeros(len(self.data) + 1, np.int32)
        whole = np.isin(codes[entry], (COPIED, COPIED_OTHERS, SENT)) if len(entry) else np.zeros(0, bool)
        np.add.at(depth, s[whole], 1)
        np.add.at(depth, e[whole] + how.length, -1)
        np.add.at(depth, repeated_starts, 1)
        np.add.at(depth, repeated_starts + how.length, -1)
        gone = np.cumsum(depth[:-1], dtype=np.int32) > 0
        edge = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(np.int8), [0]])))
        starts, stops = edge[::2], edge[1::2]
        # windows stay inside texts, but runs of two texts can touch: cut them there
        out = []
        begin = 0
        for end in self.ends.tolist():
            lo, hi = np.searchsorted(stops, begin, "right"), np.searchsorted(starts, end, "left")
            runs = zip(starts[lo:hi].tolist(), stops[lo:hi].tolist(), strict=False)
            out.append([(max(a, begin) - begin, min(b, end) - begin) for a, b in runs if max(a, begin) < min(b, end)])
            begin = end
        return out


def changes(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Where a new pair begins in sorted pairs."""
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    return new


def sorted_pairs(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The order by a, then b; one sort where no two pairs differ in b alone."""
    order = np.argsort(a, kind="stable")
    x, y = a[order], b[order]
    return np.lexsort((b, a)) if ((x[1:] == x[:-1]) & (y[1:] != y[:-1])).any() else order


def phrase_codes(key: np.ndarray, whole: np.ndarray, count: np.ndarray, block: np.ndarray) -> np.ndarray:
    """The code of every asked (key, phrase); of the blocks that ask for one, the first sends its suffixes."""
    order = np.lexsort((block, whole, key))
    k, w = key[order], whole[order]
    new = changes(k, w)
    group = np.cumsum(new) - 1
    total = np.bincount(group, weights=count[order], minlength=int(new.sum()))
    new_key = np.ones(int(new.sum()), bool)
    new_key[1:] = k[new][1:] != k[new][:-1]
    key_of = np.cumsum(new_key) - 1
    several = (np.bincount(key_of, minlength=int(new_key.sum())) > 1)[key_of]
    code = np.where(total > 1, np.where(several, COPIED_OTHERS, COPIED), np.where(several, OPEN, ALONE))
    each = code[group]
    each[new & (each == COPIED_OTHERS)] = SENT
    out = np.empty(len(order), np.int64)
    out[order] = each
    return out


def suffix_twice(a: np.ndarray, b: np.ndarray, count: np.ndarray) -> np.ndarray:
    """1 for every asked suffix that stands in two places or more."""
    order = sorted_pairs(a, b)
    new = changes(a[order], b[order])
    group = np.cumsum(new) - 1
    twice = np.bincount(group, weights=count[order], minlength=int(new.sum())) > 1
    out = np.empty(len(order), np.int64)
    out[order] = twice[group]
    return out


RESULT = "doc_id string, n_bytes long, spans array<struct<start:long,end:long>>, kept binary"
KINDS = pa.schema([("doc_id", pa.string()), ("n_bytes", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("kept", pa.binary())])


def remove_repeats(docs: DataFrame, length: int = 200, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, n_bytes, spans removed, kept bytes) of every row."""
    short_batches(docs.sparkSession)
    how = Parsing(length, reach=max(1, length * 13 // 20), gram=max(1, length * 3 // 25))
    source = docs.select(F.col(doc_id).cast("string").alias("i"), F.col(text).cast("string").alias("t"))

    def to_blocks(it):
        task, n, ids, held, size = TaskContext.get().partitionId(), 0, [], [], 0
        row = lambda: pa.RecordBatch.from_pylist([{"block": task << 24 | n, "bytes": size, "body": Texts(ids, np.array([len(x) for x in held], np.int64), b"".join(held)).dump()}], BLOCKS)
        for b in it:
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids.append(i)
                held.append((t or "").encode("utf-8", "surrogatepass"))
                size += len(held[-1])
                if size >= BLOCK_BYTES:
                    yield row()
                    n, ids, held, size = n + 1, [], [], 0
        if ids:
            yield row()

    buckets = min(max(12, 2 * source.rdd.getNumPartitions()), 100_000)
    blocks = bucketed(source.mapInArrow(to_blocks, "block long, bytes long, body binary"), "block", buckets)
    total = blocks.agg(F.sum("bytes")).first()[0] or 0
    parts = parts_for(2 * total / how.reach, PART_ENTRIES, 12)
    tasks = min(parts_for(parts, 4, 12), 100_000)
    blocks = blocks.select("block", "body")

    def ask_phrases(it):
        for b in it:
            for n, body in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                part, key, whole, counts, *_ = Texts.load(body).phrase_request(parts, how)
                names = np.unique(part)
                yield letters(n, names, Sheet([key, whole, np.minimum(counts, 2)], sizes_of(part, names)), ASKED)

    def answers(asks, by) -> DataFrame:
        """One row a block: the answers by part."""

        def judge(t: pa.Table) -> pa.Table:
            to, part, asked, _ = read(t, ASKED)
            a, b, count = asked.columns
            return pa.Table.from_batches([letters(to, int(part[0]), Sheet([by(a.view(np.uint64), b.view(np.uint64), count, np.repeat(to, asked.sizes))], asked.sizes), (False,))])

        told = asks.repartition(tasks, "part").groupBy("part").applyInArrow(judge, LETTERS).repartition(buckets, "block")
        packed = gathered((False,), finish=lambda columns, _: pack_columns(columns, (False,)))
        return bucketed(told.groupBy("block").applyInArrow(packed, ANSWERS), "block", buckets).select("block", F.col("body").alias("told")).hint("merge")

    def told(body: bytes | None) -> np.ndarray:
        return unpack_columns(body, (False,))[0] if body else np.zeros(0, np.int64)

    def ask_suffixes(it):
        for batch in it:
            for n, body, known in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                texts = Texts.load(body)
                request = texts.phrase_request(parts, how)
                part, a, b, count, _, _ = texts.suffix_request(told(known), request[4], request[5], parts, how)
                names = np.unique(part)
                yield letters(n, names, Sheet([a, b, count], sizes_of(part, names)), ASKED)

    codes = answers(blocks.mapInArrow(ask_phrases, LETTERS), phrase_codes)
    coded = blocks.join(codes, "block", "left")
    twice = answers(coded.mapInArrow(ask_suffixes, LETTERS), lambda a, b, count, _: suffix_twice(a, b, count))

    def cut(t: pa.Table) -> pa.Table:
        body, known, bits = (t.column(k)[0].as_py() for k in (1, 2, 3))
        texts, codes = Texts.load(body), told(known)
        entry, leader, s, e = texts.phrase_request(parts, how)[4:]
        *_, which, start = texts.suffix_request(codes, entry, leader, parts, how)
        spans = texts.spans(codes, entry, s, e, start[told(bits)[which] > 0] if len(start) else start, how)
        begin, raw = 0, texts.data.tobytes()
        rows = {"doc_id": texts.ids, "n_bytes": texts.lengths.tolist(), "spans": [[{"start": x, "end": y} for x, y in r] for r in spans], "kept": []}
        for size, runs in zip(rows["n_bytes"], spans, strict=True):
            kept, at = [], begin
            for x, y in runs:
                kept.append(raw[at : begin + x])
                at = begin + y
            begin += size
            rows["kept"].append(b"".join([*kept, raw[at:begin]]))
        return pa.table(rows, schema=KINDS)

    whole = coded.join(twice.withColumnRenamed("told", "bits").hint("merge"), "block", "left")
    done = whole.groupBy("block").applyInArrow(cut, RESULT)
    return done.withColumn("doc_id", F.col("doc_id").cast(docs.select(F.col(doc_id)).schema[0].dataType))


#: Columns of a question: two fingerprints, the first rising, and how many places (two stand for more).
ASKED = (True, False, False)
BLOCKS = pa.schema([("block", pa.int64()), ("bytes", pa.int64()), ("body", pa.binary())])


def op1_substring_dedup(spark, sf_dir) -> DataFrame:
    done = remove_repeats(table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"])
    return done.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
