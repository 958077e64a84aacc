"""Attribution methods that need iteration or fitting, run a group at a time."""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import tokens

Entail = Callable[[str, str], float]


def token_overlap(premise: str, hypothesis: str) -> float:
    """The offline stand-in for entailment: share of the hypothesis' distinct tokens that the premise has."""
    want = set(hypothesis.split())
    return len(want & set(premise.split())) / len(want) if want else 0.0


STEP = "array<struct<source_idx:bigint,score:double,step:int,cited:boolean>>"


def greedy_sets(rows: DataFrame, keys: list[str], entail: Entail = token_overlap, least: int = 5, gain: float = 0.1) -> DataFrame:
    """(keys, source_idx, score, step, cited): sources added one at a time, each the one that lifts the entailment of the joined, index-ordered set most.

    Of rows: keys, hypothesis, xs (the instance's sources in order); a row is one fact or statement and is
    worked on alone, so nothing is gathered. The gain is the score. Sources count as cited while the gain
    reaches `gain`; scoring goes on to min(max(5, least), n) sources; the rest have no rows. Of equal gains
    the smaller index goes first.
    """

    def one(claim: str, texts: list[str]) -> list[dict]:
        chosen: list[int] = []
        out, last, open_ = [], 0.0, True
        for k in range(1, min(max(5, least), len(texts)) + 1):
            value, i = max((entail(" ".join(texts[j] for j in sorted([*chosen, i])), claim), -i) for i in range(len(texts)) if i not in chosen)
            open_ = open_ and round(value - last, 9) >= gain
            out.append({"source_idx": -i, "score": value - last, "step": k, "cited": open_})
            chosen.append(-i)
            last = value
        return out

    @F.pandas_udf(STEP)
    def grown(claims: pd.Series, texts: pd.Series) -> pd.Series:
        return pd.Series([one(c, list(t)) for c, t in zip(claims, texts, strict=True)], dtype=object)

    return rows.select(*keys, F.explode(grown("hypothesis", "xs")).alias("r")).select(*keys, "r.*")


def cover(claim: str, texts: list[str], most: int, gain: float = 0.1) -> list[dict]:
    """What `greedy_sets` finds with `token_overlap`, lazily: the claim's tokens are bits, and a source is counted
    again only when its last count, which later ones never exceed, comes up as the largest."""
    bit = {t: 1 << b for b, t in enumerate(dict.fromkeys(claim.split()))}
    held = [sum(bit.get(t, 0) for t in set(x.split())) for x in texts]
    missing, open_, out = (1 << len(bit)) - 1, True, []
    bounds = [(-h.bit_count(), i) for i, h in enumerate(held)]
    heapq.heapify(bounds)
    while bounds and len(out) < most:
        _, i = heapq.heappop(bounds)
        now = (-(held[i] & missing).bit_count(), i)
        if bounds and now > bounds[0]:
            heapq.heappush(bounds, now)
            continue
        lifted = -now[0] / len(bit) if bit else 0.0
        open_ = open_ and round(lifted, 9) >= gain
        missing &= ~held[i]
        out.append({"source_idx": i, "score": lifted, "step": len(out) + 1, "cited": open_})
    return out


def covering_sets(rows: DataFrame, keys: list[str], budget: Column, gain: float = 0.1) -> DataFrame:
    """`greedy_sets` by token overlap, for rows of the same shape: `budget` sources a row (null or less than 5: 5), all where there are fewer."""

    @F.pandas_udf(STEP)
    def grown(claims: pd.Series, texts: pd.Series, most: pd.Series) -> pd.Series:
        return pd.Series([cover(c, list(t), int(m), gain) for c, t, m in zip(claims, texts, most, strict=True)], dtype=object)

    found = grown("hypothesis", "xs", F.greatest(F.coalesce(budget, F.lit(5)), F.lit(5)))
    return rows.select(*keys, F.explode(found).alias("r")).select(*keys, "r.*")


def greedy_selection(pairs: DataFrame, keys: list[str], entail: Entail = token_overlap, least: int = 5, gain: float = 0.1) -> DataFrame:
    """greedy_sets for rows (keys, hypothesis, source_idx, source), one a source; sources that weren't added score -1."""
    packed = pairs.groupBy(*keys).agg(F.first("hypothesis").alias("hypothesis"), F.array_sort(F.collect_list(F.struct("source_idx", "source"))).alias("ys"))  # one instance's sources
    packed = packed.withColumns({"ids": F.transform("ys", lambda y: y["source_idx"]), "xs": F.transform("ys", lambda y: y["source"])})
    found = greedy_sets(packed.select(*keys, "hypothesis", "xs"), keys, entail, least, gain).withColumnRenamed("source_idx", "place")
    every = packed.select(*keys, F.posexplode("ids").alias("place", "source_idx"))
    rows = every.join(found, [*keys, "place"], "left")
    return rows.select(*keys, "source_idx", F.coalesce("score", F.lit(-1.0)).alias("score"), F.coalesce("step", F.lit(0)).alias("step"), F.coalesce("cited", F.lit(False)).alias("cited"))


#: Texts that a worker embeds before it goes on (a larger instance is taken whole), and pairs that it hands out at once.
TEXTS, PAIRS = 4096, 1 << 18


def by_texts(batches: Iterable[pa.RecordBatch], columns: list[str], most: int = TEXTS) -> Iterator[pa.RecordBatch]:
    """Batches whose rows but the first hold `most` texts in their lists at most."""
    for b in batches:
        texts = sum(pc.fill_null(pc.list_value_length(b.column(c)), 0).to_numpy(zero_copy_only=False).astype(np.int64) for c in columns)
        ends = np.append(np.flatnonzero(np.diff(np.cumsum(texts) // most)) + 1, b.num_rows)
        for i, j in zip([0, *ends[:-1]], ends, strict=True):
            yield b.slice(i, j - i)


def embedded_pairs(instances: DataFrame, make: Callable[[], Callable], batch: int = 512) -> DataFrame:
    """(conv_id, sent_idx, source_idx, score): cosines of an instance's statements with its sources; texts without length give none.

    instances (conv_id, statements, sources array<string>), a row an instance. Each text is embedded once, where its row is, by
    the scorer that `make` builds; an instance is a matrix product.
    """

    def product(batches):
        scorer = make()
        for b in by_texts(batches, ["statements", "sources"]):
            sides = [b.column(c).fill_null([]) for c in ("statements", "sources")]
            texts = [t for side in sides for t in side.flatten().to_pylist()]
            if not texts:
                continue
            x = np.concatenate([np.array(scorer([(t,) for t in texts[k : k + batch]]), float) for k in range(0, len(texts), batch)])
            size = np.sqrt((x * x).sum(1, keepdims=True))
            x /= np.where(size > 0, size, 1)
            there, split = size[:, 0] > 0, len(sides[0].flatten())
            left, right = (s.offsets.to_numpy() - s.offsets[0].as_py() for s in sides)
            for i, conv in enumerate(b.column("conv_id").to_pylist()):
                p, q = slice(left[i], left[i + 1]), slice(split + right[i], split + right[i + 1])
                every, to = np.flatnonzero(there[p]), np.flatnonzero(there[q])
                step = max(1, PAIRS // max(1, len(to)))
                for k in range(0, len(every), step):
                    at = every[k : k + step]
                    score = x[p][at] @ x[q][to].T
                    columns = [np.full(score.size, conv), np.repeat(at, len(to)), np.tile(to, len(at)), score.ravel()]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["conv_id", "sent_idx", "source_idx", "score"])

    return instances.select("conv_id", "statements", "sources").mapInArrow(product, "conv_id long, sent_idx long, source_idx long, score double")


#: Statements and sources of an instance that are compared as one matrix: a worker holds a batch of such products at once.
LEFT, RIGHT = 32, 64


def shares(left: pa.ListArray, right: pa.ListArray) -> pa.ListArray:
    """For each row's texts (left and right array<array<string>> of tokens) the share of each left text's distinct tokens that each right text has, row by row of a matrix."""
    sides, codes = (left, right), pa.chunked_array([x.flatten().flatten() for x in (left, right)]).combine_chunks().dictionary_encode().indices.to_numpy()
    cut = len(left.flatten().flatten())
    parts = (codes[:cut], codes[cut:])
    texts = [x.offsets.to_numpy() - x.offsets[0].as_py() for x in sides]
    ends = [(y := x.flatten()).offsets.to_numpy() - y.offsets[0].as_py() for x in sides]
    out = []
    for i in range(len(left)):
        held = []
        for at, end, code in zip(texts, ends, parts, strict=True):
            end = end[at[i] : at[i + 1] + 1]
            held.append((np.repeat(np.arange(len(end) - 1), np.diff(end)), code[end[0] : end[-1]], len(end) - 1))
        words, place = np.unique(np.concatenate([c for _, c, _ in held]), return_inverse=True)
        a, b = (np.zeros((n, len(words)), np.float32) for *_, n in held)
        a[held[0][0], place[: len(held[0][0])]] = 1
        b[held[1][0], place[len(held[0][0]) :]] = 1
        size = a.sum(1, dtype=float)[:, None]
        out.append(((a @ b.T).astype(float) / np.where(size > 0, size, 1)).ravel())
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in out], dtype=np.int64)]).astype(np.int32)
    return pa.ListArray.from_arrays(offsets, np.concatenate([np.zeros(0), *out]))


def overlap_grid(statements: DataFrame, sources: DataFrame, instance: str, left: str, right: str, text: str) -> DataFrame:
    """(instance, left, right, score): `functions.text.overlap` of each statement with each source of its instance; both are numbered from 0 without gaps.

    An instance's texts meet LEFT by RIGHT at a time, so that a row is bounded however large the instance; the partitioning by instance is kept.
    """

    @F.arrow_udf("array<double>")
    def run(a: pa.Array, b: pa.Array) -> pa.Array:
        return shares(a, b)

    def packed(rows, index, size, block, name):
        own = F.array_sort(F.collect_list(F.struct(index, F.array_distinct(tokens(F.col(text))).alias("t"))))  # a block of an instance
        return rows.groupBy(instance, F.floor(F.col(index) / size).alias(block)).agg(F.transform(own, lambda x: x["t"]).alias(name))

    both = packed(statements, left, LEFT, "__i", "__a").join(packed(sources, right, RIGHT, "__j", "__b"), instance)
    each = both.select(instance, "__i", "__j", F.size("__b").alias("__n"), F.posexplode(run("__a", "__b")).alias("__k", "score"))
    at, n = F.col("__k").cast("long"), F.col("__n")
    return each.select(instance, (F.col("__i") * LEFT + F.floor(at / n)).alias(left), (F.col("__j") * RIGHT + at % n).alias(right), "score")


def pooled_shares(left: pa.ListArray, right: pa.ListArray, spread: int = 1) -> pa.ListArray:
    """`shares` of statements' facts (left array<array<array<string>>>), of these the mean over the `spread` right texts from each on, and of these the largest of a
    statement's facts, 0 without facts; row by row of a matrix, whose last `spread` - 1 columns are left out."""
    statements = left.flatten()
    rows, ends = (x.offsets.to_numpy() - x.offsets[0].as_py() for x in (left, statements))
    scores = shares(pa.ListArray.from_arrays(ends[rows].astype(np.int32), statements.flatten()), right)
    at, flat, width = scores.offsets.to_numpy(), scores.values.to_numpy(), np.diff(right.offsets.to_numpy())
    out = []
    for i, n in enumerate(width):
        own = flat[at[i] : at[i + 1]].reshape(-1, n) if n else np.zeros((0, 0))
        wide = max(0, n - spread + 1)
        total = np.zeros((len(own), wide))
        for k in range(spread):
            total += own[:, k : k + wide]
        first = ends[rows[i] : rows[i + 1] + 1] - ends[rows[i]]
        best, some = np.zeros((len(first) - 1, wide)), np.diff(first) > 0
        if wide and some.any():
            best[some] = np.maximum.reduceat(total / spread, first[:-1][some], axis=0)
        out.append(best.ravel())
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in out], dtype=np.int64)]).astype(np.int32)
    return pa.ListArray.from_arrays(offsets, np.concatenate([np.zeros(0), *out]))


def fact_grid(statements: DataFrame, sources: DataFrame, instance: str, left: str, right: str, facts: str, tokens_of: str, spread: int = 1) -> DataFrame:
    """(instance, left, right, score): the largest share of a statement's facts that each source has, or the mean over `spread` of them from each on; zeros without facts.

    statements (instance, left, facts array<array<string>>), sources (instance, right, tokens_of array<string>), both numbered from 0 without gaps; with `spread` the last
    spread - 1 sources begin nothing and have no rows. Blocks as in `overlap_grid`; a block of sources also has the next one's first spread - 1.
    """

    @F.arrow_udf("array<double>")
    def run(a: pa.Array, b: pa.Array) -> pa.Array:
        return pooled_shares(a, b, spread)

    own = lambda index, x: F.transform(F.array_sort(F.collect_list(F.struct(index, F.col(x).alias("t")))), lambda y: y["t"])  # noqa: E731  a block of an instance
    a = statements.groupBy(instance, F.floor(F.col(left) / LEFT).alias("__i")).agg(own(left, facts).alias("__a"))
    block = F.floor(F.col(right) / RIGHT)
    blocks = F.when((block > 0) & (F.col(right) % RIGHT < spread - 1), F.array(block, block - 1)).otherwise(F.array(block))
    b = sources.select(instance, right, tokens_of, F.explode(blocks).alias("__j")).groupBy(instance, "__j").agg(own(right, tokens_of).alias("__b"))
    both = a.join(b, instance)
    each = both.select(instance, "__i", "__j", (F.size("__b") - (spread - 1)).alias("__n"), F.posexplode(run("__a", "__b")).alias("__k", "score"))
    at, n = F.col("__k").cast("long"), F.col("__n")
    return each.select(instance, (F.col("__i") * LEFT + F.floor(at / n)).alias(left), (F.col("__j") * RIGHT + at % n).alias(right), "score")


def max_over_facts(scores: DataFrame, keys: list[str], index: str) -> DataFrame:
    """(keys, index, score): the largest score that any fact of a statement gives a source."""
    return scores.groupBy(*keys, index).agg(F.max("score").alias("score"))


def outer_keep(grid: DataFrame, scores: DataFrame, keys: list[str]) -> DataFrame:
    """Every row of the grid with its score, 0 where there is none."""
    return grid.join(scores, keys, "left").withColumn("score", F.coalesce("score", F.lit(0.0)))


#: Ablations a surrogate may see, the weight of its penalty, and its sweeps.
BUDGETS, ALPHA, SWEEPS = (32, 64, 128, 256), 0.01, 30
#: Statements that are worked on as one matrix, and the numbers that such a matrix may hold.
ROWS, CELLS = 1024, 4_000_000


def by_size(lists: pa.ListArray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, matrix): the places of lists of one length and their numbers, a bounded number of rows at a time; empty and null lists are left out."""
    lists = lists.fill_null([])
    at, flat = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False)
    sizes = np.diff(at)
    for n in np.unique(sizes[sizes > 0]):
        rows = np.flatnonzero(sizes == n)
        for k in range(0, len(rows), ROWS):
            part = rows[k : k + ROWS]
            yield part, flat[at[part][:, None] + np.arange(n)]


def sparse_fit(masks: np.ndarray, values: np.ndarray, budget: int, alpha: float = ALPHA, rounds: int = SWEEPS) -> np.ndarray:
    """(rows, n) coefficients that lower |y - xb - c|^2 / 2 budget + alpha |b|_1, by `rounds` sweeps of coordinate descent over all rows at once.

    masks (1 or rows, ablations, n), values (rows, ablations); the first `budget` ablations count. A column without variance gets 0.
    """
    x, y = masks[:, :budget].astype(float), values[:, :budget]
    n = x.sum(1)
    gram = x.transpose(0, 2, 1) @ x - n[:, :, None] * n[:, None, :] / budget
    sums = y @ x[0] if len(x) == 1 else np.einsum("rm,rmn->rn", y, x)
    moment = sums - n * y.mean(1, keepdims=True)
    b = np.zeros_like(moment)
    for _ in range(rounds):
        for j in range(b.shape[1]):
            own = gram[:, j, j]
            rest = moment[:, j] - (gram[:, j] * b).sum(1) + own * b[:, j]
            b[:, j] = np.where(own > 1e-9, np.sign(rest) * np.maximum(np.abs(rest) - alpha * budget, 0) / np.where(own > 1e-9, own, 1), 0)
    return b


def exploded(batch: pa.RecordBatch, others: list[str], rows: np.ndarray, **columns: np.ndarray) -> pa.RecordBatch:
    """The batch's other columns beside matrices with a row for each of `rows`, a row a number."""
    width = next(iter(columns.values())).shape[1]
    held = batch.select(others).take(pa.array(np.repeat(rows, width)))
    return pa.RecordBatch.from_arrays([*held.columns, *(pa.array(x.ravel()) for x in columns.values())], names=[*others, *columns])


def surrogates(rows: DataFrame, masks: str, values: str, budgets: tuple[int, ...] | None = BUDGETS, alpha: float = ALPHA, rounds: int = SWEEPS) -> DataFrame:
    """Rows of a statement and its ablations become (other columns, budget, source_idx, score).

    masks array<array<boolean>> says what each ablation keeps, values what came of it; each budget sees the first so many, None all.
    Statements of one size are fitted together. The scores are those of `sparse_fit`.
    """
    others = [c for c in rows.columns if c not in (masks, values)]
    flat = rows.select(*others, F.flatten(masks).alias("__x"), F.col(values).alias("__y"))
    schema = T.StructType([*flat.select(*others).schema, T.StructField("budget", T.IntegerType()), T.StructField("source_idx", T.IntegerType()), T.StructField("score", T.DoubleType())])

    def fit(batches):
        for batch in batches:
            for at, y in by_size(batch.column("__y")):
                for got, x in by_size(batch.column("__x").take(pa.array(at))):
                    step = max(1, CELLS // x.shape[1])
                    for k in range(0, len(got), step):
                        own, m = got[k : k + step], y.shape[1]
                        kept = x[k : k + step].reshape(len(own), m, -1)
                        for budget in budgets or (m,):
                            b = sparse_fit(kept, y[own], budget, alpha, rounds)
                            index = np.broadcast_to(np.arange(b.shape[1], dtype=np.int32), b.shape)
                            yield exploded(batch, others, at[own], budget=np.full(b.shape, budget, np.int32), source_idx=index, score=b)

    return flat.mapInArrow(fit, schema)


def sparse_surrogate(outcomes: DataFrame, keys: list[str], alpha: float = ALPHA, rounds: int = SWEEPS) -> DataFrame:
    """(keys, source_idx, score): `surrogates` for rows (keys, mask array<boolean>, value), one an ablation; all of a group count.

    A group is one statement's ablations.
    """
    packed = outcomes.groupBy(*keys).agg(F.collect_list("mask").alias("masks"), F.collect_list("value").alias("values"))
    return surrogates(packed, "masks", "values", None, alpha, rounds).drop("budget")


def window_means(window_scores: DataFrame, keys: list[str], index: str, score: str, length: int, n: str) -> DataFrame:
    """A sentence's score is the mean over the `length` windows that begin at its index; only the first n rows are sentences."""
    from pyspark.sql import Window

    ahead = Window.partitionBy(*keys).orderBy(index).rowsBetween(0, length - 1)
    return window_scores.withColumn("score", F.avg(score).over(ahead)).filter(F.col(index) < F.col(n))
