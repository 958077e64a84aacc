"""LM scoring: a Katz model of any order (the query's is ORDER) with Good-Turing discounts, counted and evaluated in partitioned tables.

Texts are cut into blocks of about BLOCK_TOKENS tokens; a block keeps its texts as local word numbers.
Blocks and the partitions of the model only exchange distinct entries, packed (`mail`) and aggregated
beforehand:

1. words: every block sends its distinct words with their training counts to the partition of the
   word's hash; it gets back a global number and the corpus count, and is written anew with these.
2. word pairs: every block sends its distinct pairs with their training counts to the partition of the
   history; it gets back what other blocks add to the pairs' counts and, for every history, how many
   followers that the block did not name it has with 1, 2, ... K occurrences and what these followers' own
   lower counts are, from which, with its own, the block takes the backoff weights: a follower seen after a history is seen after the shorter one too, so that its lower
   estimate is a discounted count, and the followers' mass is a sum of integers, exact in any order.
   A frequent history is split over several partitions by the follower; its parts add up again in the
   block, so no word or pair, however frequent, gathers in one task. Of a history whose followers are all
   the block's own, nothing is left to tell; a pair's lower count is its word's, sent once a message.
3. Longer entries follow level by level, two words of history, then three. A history that no other block
   has, in training or held-out text, is counted in its block and not sent; the level below tells which.
4. The block evaluates each token by the longest history its text has (the start counts as one word): the
   discounted estimate where the entry is known, else the history's backoff weight times the estimate
   without the history's first word, down to the unigram; unknown words share the mass that the unigram
   discounts free. For every history the probabilities of all known words and the unknown class add up
   to one.

Blocks and answers are tables bucketed by block, one row a block, and meet without a shuffle; texts are
never shuffled. Work and messages grow with the entries, not with blocks times partitions. Tables that
a later one replaces are deleted. Words are told apart by 64-bit hashes: two that share one count as one.
Discounts apply to counts up to K (Good-Turing, see `discounts`). A history whose followers are all above K gets one extra count, which is what it backs off with.

Null texts are empty: one token, the end. Repeated rows and ids are scored row by row, a null id counts
as the empty string when rows are held out. Without training rows every score is 0. An empty table
gives an empty result. Extra columns, also those with clashing names, are not read.
"""

from __future__ import annotations

import itertools
import json

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bucketed, discard, give_back, parts_for, short_batches, table
from .mail import JOINT, LETTERS, Sheet, by_part, distinct, group, in_order, letters, pack_columns, read, sizes_of, stable_order, unpack_columns
from .toxicity import remainder

K = 5
ORDER = 3
BLOCK_TOKENS = 1_000_000
PART_TOKENS = 2_000_000
END = b"\n"
#: The name of the text's start as a history; names of words and longer histories are below it.
START_NAME = 1 << 62
#: A history's name: its partition, then its place there, so that names in a message are close together.
PLACE_BITS = 40
#: Groups that sums over the corpus are gathered in.
SUMS = 64


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays, byte planes apart and compressed."""
    head = json.dumps([[a.dtype.str, len(a)] for a in arrays]).encode()
    planes = [np.ascontiguousarray(a.view(np.uint8).reshape(len(a), -1).T).tobytes() if len(a) else b"" for a in arrays]
    return len(head).to_bytes(4, "little") + head + zstandard.compress(b"".join(planes), 3)


def unpack(body: bytes) -> list[np.ndarray]:
    n = int.from_bytes(body[:4], "little")
    raw, at, out = np.frombuffer(zstandard.decompress(body[4 + n :]), np.uint8), 0, []
    for kind, size in json.loads(body[4 : 4 + n]):
        width = np.dtype(kind).itemsize
        out.append(np.ascontiguousarray(raw[at : at + size * width].reshape(width, size).T).view(kind).reshape(size))
        at += size * width
    return out


def narrow(a: np.ndarray) -> np.ndarray:
    """The same values in 32 bits where they fit."""
    return a.astype(np.int32) if not len(a) or (a.max() < 1 << 31 and a.min() >= -(1 << 31)) else a


def word_hash(word: bytes) -> int:
    return xxhash.xxh3_64_intdigest(word)


def mixed(x: np.ndarray) -> np.ndarray:
    z = x.astype(np.uint64)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


class Block:
    """Texts as local word numbers; after the words' answer local order is that of the global numbers."""

    def __init__(self, ids, held, lengths, tokens, hashes=None, number=None, count=None):
        self.ids, self.held, self.lengths, self.tokens = ids, held, lengths, tokens
        self.hashes, self.number, self.count = hashes, number, count
        self.starts = np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int64)
        self.train = np.repeat(~held, lengths)

    @staticmethod
    def of(rows: list[tuple]) -> Block:
        """rows: (id, held, words)."""
        lengths = np.array([len(r[2]) + 1 for r in rows], np.int64)
        coded = pa.array([w for r in rows for w in r[2]], pa.binary()).dictionary_encode()
        tokens = np.zeros(lengths.sum(), np.int64)
        word = np.ones(len(tokens), bool)
        word[np.cumsum(lengths) - 1] = False
        tokens[word] = coded.indices.to_numpy() + 1
        order = np.argsort(-np.bincount(tokens, minlength=len(coded.dictionary) + 1), kind="stable")
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        words = coded.dictionary
        ends, data = np.frombuffer(words.buffers()[1], np.int32)[: len(words) + 1].tolist(), memoryview(words.buffers()[2] or b"")
        hashes = np.fromiter(itertools.chain([word_hash(END)], map(word_hash, (data[a:b] for a, b in itertools.pairwise(ends)))), np.uint64, len(order))[order]
        return Block([r[0] for r in rows], np.array([r[1] for r in rows], bool), lengths, rank[tokens], hashes)

    def dump(self) -> bytes:
        ids = np.frombuffer(json.dumps(self.ids).encode(), np.uint8)
        words = pack_columns([self.hashes], (False,)) if self.number is None else pack_columns([self.number, self.count], (True, False))
        return pack(ids, self.held.view(np.uint8), narrow(self.lengths), narrow(self.tokens), np.frombuffer(words, np.uint8))

    @staticmethod
    def load(body: bytes, numbered: bool = True) -> Block:
        ids, held, lengths, tokens, words = unpack(body)
        found = unpack_columns(words.tobytes(), (True, False) if numbered else (False,))
        mine = {"number": found[0], "count": found[1]} if numbered else {"hashes": found[0].view(np.uint64)}
        return Block(json.loads(ids.tobytes()), held.view(bool), lengths.astype(np.int64), tokens.astype(np.int64), **mine)

    def word_order(self, parts: int) -> tuple[np.ndarray, np.ndarray]:
        """The local words by part and hash, and the part of each."""
        part = (self.hashes % np.uint64(parts)).astype(np.int64)
        order = np.argsort(self.hashes, kind="stable")
        order = order[by_part(part[order])]
        return order, part[order]

    def ask_words(self, n: int, parts: int) -> pa.RecordBatch:
        order, part = self.word_order(parts)
        names = distinct(part)
        seen = np.bincount(self.tokens[self.train], minlength=len(self.hashes))
        return letters(n, names, Sheet([self.hashes[order], seen[order]], sizes_of(part, names)), (True, False))

    def with_words(self, parts: int, answers: list[np.ndarray]) -> Block:
        """The block with its words' global numbers and corpus counts, local words in the numbers' order."""
        order, _ = self.word_order(parts)
        number, count = np.empty(len(order), np.int64), np.empty(len(order), np.int64)
        number[order], count[order] = answers
        by = np.argsort(number)
        rank = np.empty(len(by), np.int64)
        rank[by] = np.arange(len(by))
        return Block(self.ids, self.held, self.lengths, rank[self.tokens], None, number[by], count[by])

    def ground(self, model: Model) -> Level:
        """Level 0: the words, and after them the text's start, which is only ever a history."""
        n = len(self.number)
        top = lambda a, x: np.concatenate([a, [x]])
        home = self.number % model.parts  # the part that gave the number, by the word's hash
        out = Level(self.tokens, None, None, None, None)
        out.count, out.p = top(self.count, model.texts), top(model.unigram(self.count), 1.0)
        out.name, out.part = top(home << PLACE_BITS | self.number // model.parts, START_NAME), top(home, int(mixed(np.array([START_NAME]))[0] % np.uint64(model.parts)))
        out.sole, out.whole = np.zeros(n + 1, bool), None
        return out

    def level(self, below: Level, k: int) -> Level:
        """The distinct entries with k words of history, one word longer than those of `below`."""
        n, tokens = len(self.number), self.tokens
        h = np.concatenate([[0], below.gram[:-1]]).astype(np.int64)
        h[self.starts] = n if k == 1 else -1
        there = None if k == 1 else np.flatnonzero(h >= 0)
        if there is not None:
            h, tokens = h[there], tokens[there]
        key, first, inverse = group(h * n + tokens, len(below.count) * n)
        del h
        train = self.train if there is None else self.train[there]
        seen = np.bincount(inverse[train], minlength=len(key))
        if there is None:
            gram, short = inverse, tokens[first]
        else:
            gram = np.full(len(self.tokens), -1, np.int32)
            gram[there] = inverse
            short = below.gram[there[first]]
        h = key // n
        return Level(gram.astype(np.int32), h, key - h * n, seen, short)

    def request(self, level: Level, below: Level, model: Model) -> Request:
        asked = np.flatnonzero(~below.sole[level.h])
        h, number = level.h[asked], self.number[level.w[asked]]
        spread = np.minimum(1 + below.count * 4 * model.parts // max(model.tokens, 1), model.parts)
        part = (below.part[h] + number % spread[h]) % model.parts
        # by part, name and follower, as the answers are sorted: names of spread histories aren't in local order
        width = len(below.count)
        rank = np.empty(width, np.int64)
        rank[np.argsort(below.name, kind="stable")] = np.arange(width)
        order = stable_order(part * width + rank[h], model.parts * width)
        asked, h, part = asked[order], h[order], part[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (part[1:] != part[:-1])
        at = np.flatnonzero(new)
        h_part, h_own, follow = part[at], h[at], np.diff(np.append(at, len(h)))
        # every part of a spread history is asked, also where this block has none of its entries
        wide = np.unique(h_own[spread[h_own] > 1])
        every = np.repeat(wide, spread[wide])
        offset = np.arange(len(every)) - np.repeat(np.cumsum(spread[wide]) - spread[wide], spread[wide])
        other = (below.part[every] + offset) % model.parts
        split = spread[h_own] > 1
        lacking = ~np.isin(other * width + every, h_part[split] * width + h_own[split])
        h_part, h_own = np.concatenate([h_part, other[lacking]]), np.concatenate([h_own, every[lacking]])
        follow = np.concatenate([follow, np.zeros(lacking.sum(), np.int64)])
        order = by_part(h_part)
        return Request(asked, part, h_own[order], h_part[order], follow[order])

    def ask(self, n: int, level: Level, below: Level, k: int, model: Model) -> list[pa.RecordBatch]:
        """The questions about a level, and the counts of counts of what stays in the block."""
        r = self.request(level, below, model)
        mine = level.seen[below.sole[level.h]]
        kept = np.array([(mine == c).sum() for c in range(1, K + 2)], np.int64)
        out = [letters(n, np.array([-1 - n % SUMS]), Sheet([kept], np.array([K + 1])), (False,), Sheet([kept[:0]] * 2, np.zeros(1, np.int64)), HISTORIES)]
        if len(r.h_part):
            names = distinct(r.h_part)
            sizes, w, lower = sizes_of(r.part, names), level.w[r.asked], below_count(level, below, r.asked)
            if k == 1:
                first, at, _ = listed(w, sizes, len(self.number))
                lower, once = np.zeros(len(w), np.int64), lower[first]
                lower[at] = once
            entries = Sheet([steps(self.number[w], r.follow), lower, level.seen[r.asked]], sizes)
            out.append(letters(n, names, entries, ENTRIES, Sheet([below.name[r.h], r.follow], sizes_of(r.h_part, names)), HISTORIES))
        return out

    def told(self, level: Level, below: Level, k: int, answer: bytes | None, model: Model) -> Level:
        """The level with its corpus counts, probabilities and names."""
        r, width = self.request(level, below, model), len(below.count)
        count, sole, name, part = level.seen.copy(), below.sole[level.h].copy(), np.full(len(level.h), -1, np.int64), np.zeros(len(level.h), np.int64)
        if answer is not None:
            (more, place), rest = unpack_answer(answer)
            count[r.asked], sole[r.asked] = count[r.asked] + more, place == 0
            place = from_steps(place, np.diff(np.flatnonzero(np.diff(r.part, prepend=-1, append=-1))))  # counted anew in each part
            part[r.asked], name[r.asked] = r.part, r.part << PLACE_BITS | place
        # the block's own followers are counted here, those of the others are added
        known = np.flatnonzero(count > 0)
        h, own = level.h[known], below_count(level, below, known)
        low = by_count(h, count[known], width).astype(np.float64)
        mass = np.concatenate([by_count(h, own, width), np.bincount(h, weights=np.where(own > K, own, 0), minlength=width)[None]])
        del known, h, own
        for row, x in zip((*low, *mass), rest if answer is not None else ()):  # noqa: B905
            at = np.flatnonzero(x)
            row += np.bincount(r.h[at], weights=x[at], minlength=width)
        times = below.count
        c = np.arange(1, K + 1)
        few = c @ low
        whole = times + (few == 0)
        d, d_low = model.discount(k), model.discount(k - 1)
        kept = (d[1 : K + 1] * c) @ low + (times - few)
        seen_mass = (d_low[1 : K + 1] * c) @ mass[:K] + mass[K]
        # the whole that the lower estimates are shares of: the corpus, or the history without its first word
        seen_mass = seen_mass / (model.whole if k == 1 else below.whole[below.short])
        with np.errstate(divide="ignore", invalid="ignore"):
            weight = np.where(times > 0, (1.0 - kept / np.maximum(whole, 1)) / (1.0 - seen_mass), 1.0)
        h = level.h
        p = np.where(count > 0, discounted(d, count) * count / np.maximum(whole[h], 1), weight[h] * below.p[level.short])
        level.count, level.p, level.sole, level.name, level.part, level.whole = count, p, sole, name, part, np.maximum(whole, 1)
        return level

    def levels(self, upto: int, answers: list[bytes | None], model: Model) -> list[Level]:
        """Levels 0 to `upto`."""
        out = [self.ground(model)]
        for k in range(1, upto + 1):
            out.append(self.told(self.level(out[-1], k), out[-1], k, answers[k - 1], model))
        return out


#: Columns that rise: of entries (number, lower count, training count) and histories (name, entries); of the answers.
ENTRIES, HISTORIES = (False, False, False), (True, False)
COUNTED, SUMMED = (JOINT, JOINT), (JOINT,) * (2 * K) + (False,)


class Request:
    """What a block asks of the others, by part: entries, and histories with how many entries follow each."""

    def __init__(self, asked, part, h, h_part, follow):
        self.asked, self.part, self.h, self.h_part, self.follow = asked, part, h, h_part, follow


class Level:
    """The distinct entries of one length in a block, k words of history and a follower (level k).

    gram: entry of each token, -1 where the text has no such history yet. Of the entries: history (an
    entry of the level below), follower, training count in the block, the entry without its first word.
    After `told`: corpus count, probability, whether no other block has them, name and partition as
    histories; and of the histories the whole that their followers' estimates are shares of.
    """

    def __init__(self, gram, h, w, seen, short):
        self.gram, self.h, self.w, self.seen, self.short = gram, h, w, seen, short
        self.count = self.p = self.sole = self.name = self.part = self.whole = None


def steps(numbers: np.ndarray, follow: np.ndarray) -> np.ndarray:
    """Followers' numbers, after each history's first as differences; `follow` of them a history."""
    starts = (np.cumsum(follow) - follow)[follow > 0]
    out = np.diff(numbers, prepend=0)
    out[starts] = numbers[starts]
    return out


def from_steps(out: np.ndarray, follow: np.ndarray) -> np.ndarray:
    """The numbers that `steps` was given."""
    some, total = follow > 0, np.cumsum(out)
    starts = (np.cumsum(follow) - follow)[some]
    return total - np.repeat(total[starts] - out[starts], follow[some])


def listed(w: np.ndarray, sizes: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(an entry of each distinct word of each message, its place, the distinct word of each entry): a message's
    distinct words in order take its first places, so that what goes with a word is sent once.
    """
    message = np.repeat(np.arange(len(sizes)), sizes)
    _, first, which = group(message * top + w, max(len(sizes), 1) * top)
    mine = message[first]
    return first, (np.cumsum(sizes) - sizes - np.searchsorted(mine, np.arange(len(sizes))))[mine] + np.arange(len(first)), which


def by_count(h: np.ndarray, count: np.ndarray, width: int) -> np.ndarray:
    """How many entries of each history have the counts 1, 2, ... K, a row each."""
    few = np.flatnonzero((count > 0) & (count <= K))
    return np.bincount((count[few] - 1) * width + h[few], minlength=K * width).reshape(K, width)


def below_count(level: Level, below: Level, entries: np.ndarray) -> np.ndarray:
    """The corpus counts of entries without their first word."""
    return below.count[level.short[entries]]


def pack_answer(entries, sums) -> bytes:
    head = pack_columns(entries, COUNTED)
    return len(head).to_bytes(8, "little") + head + pack_columns(sums, SUMMED)


def unpack_answer(body: bytes) -> tuple[list[np.ndarray], list[np.ndarray]]:
    n = int.from_bytes(body[:8], "little")
    return unpack_columns(body[8 : 8 + n], COUNTED), unpack_columns(body[8 + n :], SUMMED)


class Model:
    """What is known of the whole corpus: tokens N, words V, training texts, parts and the discounts."""

    def __init__(self, parts: int, tokens: int = 0, words: int = 0, texts: int = 0, unigrams=(), pairs=(), longer=()):
        self.parts, self.tokens, self.words, self.texts = parts, tokens, words, texts
        self.unigram_counts, self.pair_counts = list(unigrams) or [0] * (K + 1), list(pairs) or [0] * (K + 1)
        self.unigram_discount, self.pair_discount = discounts(self.unigram_counts), discounts(self.pair_counts)
        self.longer_counts = [list(x) for x in longer]
        self.longer_discounts = [discounts(x) for x in self.longer_counts]
        low = sum(r * n for r, n in enumerate(self.unigram_counts[:K], 1))
        kept = sum(self.unigram_discount[r] * r * n for r, n in enumerate(self.unigram_counts[:K], 1)) + (tokens - low)
        self.whole = tokens + (low == 0)
        self.unknown = 1.0 - kept / self.whole if tokens else 1.0

    def with_level(self, k: int, counts: list[int]) -> Model:
        """The model with the counts of counts of the entries with k words of history."""
        more = {"pairs": counts} if k == 1 else {"pairs": self.pair_counts, "longer": [*self.longer_counts, counts]}
        return Model(self.parts, self.tokens, self.words, self.texts, self.unigram_counts, **more)

    def discount(self, k: int) -> np.ndarray:
        """The discounts of the entries with k words of history."""
        return (self.unigram_discount, self.pair_discount, *self.longer_discounts)[k]

    def unigram(self, count: np.ndarray) -> np.ndarray:
        """P(word) by its corpus count; words without one are the unknown class."""
        c = count.astype(np.float64)
        return np.where(count > 0, discounted(self.unigram_discount, count) * c / self.whole, self.unknown)


def discounts(counts_of_counts: list[int], k: int = K) -> np.ndarray:
    """d[r] for r = 0..k+1 (the last stands for all above k): Katz's Good-Turing ratios.

    Where the counts of counts don't give ratios between 0 and 1, a line through their logarithms
    takes their place; where that doesn't either, absolute discounting.
    """
    n = [0.0, *map(float, counts_of_counts)]
    d = np.ones(k + 2)
    r = np.array([x for x in range(1, k + 2) if n[x] > 0], float)
    if len(r) >= 3:
        slope, offset = np.polyfit(np.log(r), np.log([n[int(x)] for x in r]), 1)
        tries = [n, [0.0, *np.exp(offset + slope * np.log(np.arange(1, k + 2)))]]
        for m in tries if len(r) == k + 1 else tries[1:]:
            a = (k + 1) * m[k + 1] / m[1]
            if a < 1:
                good = [((x + 1) * m[x + 1] / (m[x] * x) - a) / (1 - a) for x in range(1, k + 1)]
                if all(0 < x < 1 for x in good):
                    d[1 : k + 1] = good
                    return d
    off = min(max(n[1] / (n[1] + 2 * n[2]), 0.1), 0.75) if n[1] else 0.5
    d[1 : k + 1] = [(x - off) / x for x in range(1, k + 1)]
    return d


def discounted(d: np.ndarray, count: np.ndarray) -> np.ndarray:
    return d[np.minimum(count, len(d) - 1)]


def answer_words(t: pa.Table, parts: int) -> list[pa.RecordBatch]:
    """Numbers by falling corpus count, then hash, and corpus counts; [V, N, n_1 .. n_K+1] for a sums group."""
    blocks, part, asked, _ = read(t, (True, False))
    p = int(part[0])
    hashes, inverse = np.unique(asked.columns[0].view(np.uint64), return_inverse=True)
    total = np.bincount(inverse, weights=asked.columns[1], minlength=len(hashes)).astype(np.int64)
    order = np.lexsort((hashes, -total))
    number = np.empty(len(order), np.int64)
    number[order] = np.arange(len(order)) * parts + p
    sums = np.array([(total > 0).sum(), total.sum(), *((total == r).sum() for r in range(1, K + 2))], np.int64)
    return [letters(blocks, p, Sheet([number[inverse], total[inverse]], asked.sizes), (False, False)), summed(p, sums)]


def summed(p: int, sums: np.ndarray) -> pa.RecordBatch:
    """Sums over the corpus, to one of SUMS groups that stand below all blocks."""
    return letters(-1 - p % SUMS, p, Sheet([sums], np.array([len(sums)])), (False,))


def places(alone: np.ndarray, place: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Places counted from 1, rising in each message, as differences; an entry of one block alone has none."""
    message = np.repeat(np.arange(len(sizes)), sizes) << (PLACE_BITS + 1)
    return steps(np.maximum.accumulate(message + np.where(alone, 0, place + 1)) - message if len(message) else message, sizes)


def answer_entries(t: pa.Table, k: int, last: bool) -> list[pa.RecordBatch]:
    """What others add to the counts, and places (`places`: they also tell which entries only one block has); for each history
    the sums of the followers that the block did not name; [n_1 .. n_K+1] of the partition's entries for a sums group.
    """
    p = t.column("part")[0].as_py()
    if p < 0:  # what blocks count on their own
        _, _, kept, _ = read(t, (False,))
        return [summed(p, kept.columns[0].reshape(-1, K + 1).sum(0))]
    blocks, _, entries, histories = read(t, ENTRIES, HISTORIES)
    names, own = np.unique(histories.columns[0], return_inverse=True)
    follow, (w, lower, seen) = histories.columns[1], entries.columns
    row, w = np.repeat(np.arange(len(own)), follow), from_steps(w, follow)
    h = own[row]
    top = int(w.max()) + 1 if len(w) else 1
    if k == 1:
        _, at, which = listed(w, entries.sizes, top)
        lower = lower[at][which]
        del at, which
    order = np.argsort(h * top + w, kind="stable") if (len(names) * top).bit_length() < 63 else np.lexsort((w, h))
    h, w = h[order], w[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (w[1:] != w[:-1])
    of, at = np.cumsum(new) - 1, np.flatnonzero(new)
    total = np.bincount(of, weights=seen[order], minlength=len(at)).astype(np.int64)
    alone = np.bincount(of, minlength=len(at)) == 1
    place = np.cumsum(~alone) - 1
    back = np.empty(len(order), np.int64)
    back[order] = of
    named = total[back]
    del w, new, of

    def sums(h, count, lower, width):
        known = np.flatnonzero(count > 0)
        h, lower = h[known], lower[known]
        mass = np.bincount(h, weights=np.where(lower > K, lower, 0), minlength=width).astype(np.int64)
        return [*by_count(h, count[known], width), *by_count(h, lower, width), mass]

    rest = sums(row, named, lower, len(own))
    for mine, x in zip(rest, sums(h[at], total, lower[order[at]], len(names)), strict=True):
        np.subtract(x[own], mine, out=mine)
    answer = [named - seen, np.zeros(len(back), np.int64) if last else places(alone[back], place[back], entries.sizes)]
    found = np.array([(total == r).sum() for r in range(1, K + 2)], np.int64)
    return [letters(blocks, p, Sheet(answer, entries.sizes), COUNTED, Sheet(rest, histories.sizes), SUMMED), summed(p, found)]


def gathered(rising, more=(), finish=None):
    """A block's answers as one row (its columns by part; `finish` packs them), or the sums of a group."""

    def gather(t: pa.Table) -> pa.Table:
        n = t.column("block")[0].as_py()
        if n < 0:
            _, _, sums, _ = read(t, (False,))
            return pa.table({"block": [n], "body": [None], "n": [sums.columns[0].reshape(t.num_rows, -1).sum(0).tolist()]}, schema=ANSWER)
        _, parts, a, b = read(t, rising, more)
        body = finish(in_order(a, parts), in_order(b, parts) if b else None)
        return pa.table({"block": [n], "body": [body], "n": [None]}, schema=ANSWER)

    return gather


def evaluate(block: Block, model: Model, answers: list[bytes | None], order: int) -> dict[str, list]:
    levels = block.levels(order - 1, answers, model)
    p = levels[0].p[block.tokens]
    for level in levels[1:]:  # the longest history that the text has; what it lacks, its weights hold already
        there = level.gram >= 0
        p[there] = level.p[level.gram[there]]
    base = np.log10((block.count + 1) / (model.tokens + model.words + 1))[block.tokens]
    return {
        "doc_id": block.ids,
        "held_out": block.held.tolist(),
        "n_tokens": block.lengths.tolist(),
        "n_known": np.add.reduceat((block.count > 0)[block.tokens].astype(np.int64), block.starts).tolist(),
        "train_tokens": [model.tokens] * len(block.ids),
        "base_score": np.add.reduceat(base, block.starts).tolist(),
        "score": np.add.reduceat(np.log10(p), block.starts).tolist(),
    }


def to_blocks(most: int):
    """Rows (id, held out, text) of a task to block rows of about `most` tokens."""

    def blocks(it):
        task, n, rows, size = TaskContext.get().partitionId(), 0, [], 0

        def row():
            block = Block.of(rows)
            return pa.RecordBatch.from_pylist([{"block": task << 24 | n, "tokens": len(block.tokens), "texts": int((~block.held).sum()), "body": block.dump()}], BLOCKS)

        for b in it:
            for i, h, t in zip(*(c.to_pylist() for c in b.columns), strict=True):
                words = (t or "").encode("utf-8", "surrogatepass").lower().split()
                rows.append((i, h, words))
                size += len(words) + 1
                if size >= most:
                    yield row()
                    n, rows, size = n + 1, [], 0
        if rows:
            yield row()

    return blocks


def totals(answers: DataFrame, n: int) -> list[int]:
    """Sums over the groups of sums: at most SUMS * 2 rows."""
    return [x or 0 for x in answers.filter("block < 0").select(*[F.sum(F.col("n")[i]) for i in range(n)]).first()]


def score(docs: DataFrame, folds: int = 7, held: int = 2, text: str = "text", doc_id: str = "doc_id", order: int = 2) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row; order: words an entry of the model has at most."""
    short_batches(docs.sparkSession)
    source = docs.select(F.col(doc_id).cast("string").alias("i"), (remainder(F.col(doc_id), folds) == held).alias("h"), F.col(text).cast("string").alias("t"))
    buckets = min(max(12, 2 * source.rdd.getNumPartitions()), 100_000)
    raw = bucketed(source.mapInArrow(to_blocks(BLOCK_TOKENS), "block long, tokens long, texts long, body binary"), "block", buckets)
    sums = raw.agg(F.sum("tokens"), F.sum("texts")).first()
    parts = parts_for(sums[0] or 0, PART_TOKENS, 12)
    tasks = parts_for(sums[0] or 0, 6 * PART_TOKENS, 12)

    def answered(asked: DataFrame, by) -> DataFrame:
        def answer(t: pa.Table) -> pa.Table:
            out = pa.Table.from_batches(by(t))
            give_back()
            return out

        return asked.repartition(min(tasks, 100_000), "part").groupBy("part").applyInArrow(answer, LETTERS).repartition(buckets, "block")

    def ask_words(it):
        for b in it:
            for n, body in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                yield Block.load(body, False).ask_words(n, parts)

    def number_words(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return gathered((False, False))(right)
        _, p, a, _ = read(right, (False, False))
        answers, n = in_order(a, p), left.column("block")[0].as_py()
        body = Block.load(left.column("body")[0].as_py(), False).with_words(parts, answers).dump()
        return pa.table({"block": [n], "body": [body], "n": [None]}, schema=ANSWER)

    bare = raw.select("block", "body")
    replies = answered(bare.mapInArrow(ask_words, LETTERS), lambda t: answer_words(t, parts))
    words = bucketed(bare.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(number_words, ANSWERS), "block", buckets)
    discard(raw)
    n = totals(words, K + 3)
    model = Model(parts, n[1], n[0], sums[1] or 0, n[2:])
    blocks = words.filter("block >= 0").select("block", "body")

    def asks(k: int, model: Model):
        def ask(it):
            for b in it:
                for n, body, *answers in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    block = Block.load(body)
                    levels = block.levels(k - 1, answers, model)
                    asked = block.ask(n, block.level(levels[-1], k), levels[-1], k, model)
                    del block, levels
                    give_back()
                    yield from asked

        return ask

    for k in range(1, order):
        replies = answered(blocks.mapInArrow(asks(k, model), LETTERS), lambda t, k=k: answer_entries(t, k, k == order - 1))
        found = bucketed(replies.groupBy("block").applyInArrow(gathered(COUNTED, SUMMED, pack_answer), ANSWERS), "block", buckets)
        model = model.with_level(k, totals(found, K + 1))
        level = found.filter("block >= 0").select("block", F.col("body").alias(f"level_{k}"))
        blocks = blocks.join(level.hint("merge"), "block", "left")
    full = model

    def evaluate_block(t: pa.Table) -> pa.Table:
        body, *answers = (t.column(k)[0].as_py() for k in range(1, t.num_columns))
        out = pa.table(evaluate(Block.load(body), full, answers, order), schema=RESULT)
        give_back()
        return out

    scored = blocks.groupBy("block").applyInArrow(evaluate_block, "doc_id string, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    kind = docs.select(F.col(doc_id)).schema[0].dataType
    return scored.withColumn("doc_id", F.col("doc_id").cast(kind))


BLOCKS = pa.schema([("block", pa.int64()), ("tokens", pa.int64()), ("texts", pa.int64()), ("body", pa.binary())])
ANSWER = pa.schema([("block", pa.int64()), ("body", pa.binary()), ("n", pa.list_(pa.int64()))])
ANSWERS = "block long, body binary, n array<long>"
RESULT = pa.schema([("doc_id", pa.string()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])


def op4_katz(spark, sf_dir) -> DataFrame:
    return score(table(spark, sf_dir, "documents"), order=ORDER)
