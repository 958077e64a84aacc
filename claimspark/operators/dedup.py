"""Keep-first, near-duplicate clusters inside a funnel, and resumption."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def keep_first(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    return rows.withColumn("__rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("__rn = 1").drop("__rn")


def first_n(rows: DataFrame, keys: list[str], order: list[str], n: int) -> DataFrame:
    return rows.withColumn("__rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("__rn") <= n).drop("__rn")


def _near(vectors: pa.ChunkedArray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j) with i < j of vectors of one length whose cosine reaches `least`; vectors without length, or with nulls, are near to none."""
    vectors = vectors.combine_chunks()
    flat, at = vectors.values.cast("double"), vectors.offsets.to_numpy()
    sizes = np.where(vectors.is_null(), -1, np.diff(at))
    first, second = [], []
    for n in np.unique(sizes[sizes > 0]):
        rows = np.flatnonzero(sizes == n)
        part = flat.take(pa.array((at[rows][:, None] + np.arange(n)).ravel()))
        rows = rows[~np.asarray(part.is_null()).reshape(-1, n).any(1)]
        x = flat.to_numpy(zero_copy_only=False)[at[rows][:, None] + np.arange(n)]
        size = np.sqrt((x * x).sum(1))
        x, rows, size = x[size != 0], rows[size != 0], size[size != 0]
        score = np.triu(x @ x.T, 1) / (size[:, None] * size)
        near = score >= least
        for i, j in zip(*np.nonzero(np.triu(np.abs(score - least) < 1e-9, 1)), strict=True):  # at the limit sums in their order decide
            dot = lambda a, b: np.cumsum(a * b)[-1]
            near[i, j] = dot(x[i], x[j]) / (np.sqrt(dot(x[i], x[i])) * np.sqrt(dot(x[j], x[j]))) >= least
        i, j = np.nonzero(np.triu(near, 1))
        first.append(rows[i])
        second.append(rows[j])
    none = [np.zeros(0, np.int64)]
    return np.concatenate(first or none), np.concatenate(second or none)


def similar_pairs(rows: DataFrame, group: list[str], item: str, vector: str, least: float) -> DataFrame:
    """(group, a, b) with a < b and cosine at or above `least`; groups are funnels of bounded size, each one matrix product."""
    schema = T.StructType([*rows.select(*group).schema, *(T.StructField(c, rows.schema[item].dataType) for c in "ab")])

    def one(own: pa.Table) -> pa.Table:
        own = own.sort_by(item)
        a, b = _near(own.column(vector), least)
        ids = own.column(item)
        return pa.table({**{g: own.column(g).take(a) for g in group}, "a": ids.take(a), "b": ids.take(b)}).filter(pc.not_equal(ids.take(a), ids.take(b)))

    return rows.select(*group, item, vector).groupBy(*group).applyInArrow(one, schema)


def _roots(links) -> dict:
    """Each item of links (a, b) with the smallest one that it is linked to."""
    root: dict = {}

    def find(x):
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in links:
        low, high = sorted((find(a), find(b)))
        root[high] = low
    return {x: find(x) for x in list(root)}


def similar_components(rows: DataFrame, group: list[str], item: str, vector: str, least: float) -> DataFrame:
    """(group, item, component): `group_components` over `similar_pairs`, in one pass over each group; items are distinct within it."""
    schema = T.StructType([*rows.select(*group, item).schema, T.StructField("component", rows.schema[item].dataType)])

    def one(own: pa.Table) -> pa.Table:
        a, b = _near(own.column(vector), least)
        ids = own.column(item).to_pylist()
        root = _roots((ids[i], ids[j]) for i, j in zip(a, b, strict=True))
        return own.select([*group, item]).append_column("component", pa.array([root.get(x, x) for x in ids], own.column(item).type))

    return rows.select(*group, item, vector).groupBy(*group).applyInArrow(one, schema)


def group_components(rows: DataFrame, pairs: DataFrame, group: list[str], item: str) -> DataFrame:
    """(group, item, component = smallest item reachable). A group is a funnel of bounded size, so its pairs fit one task."""

    def one(links: pd.DataFrame) -> pd.DataFrame:
        root = _roots(zip(links["a"], links["b"], strict=True))
        return pd.DataFrame({**{g: links[g].iloc[0] for g in group}, item: list(root), "component": list(root.values())})

    kind = rows.schema[item].dataType
    schema = rows.select(*group, item).schema.add("component", kind)
    label = pairs.groupBy(*group).applyInPandas(one, schema)
    return rows.select(*group, item).distinct().join(label, [*group, item], "left").withColumn("component", F.coalesce("component", item))


def longest_of_component(rows: DataFrame, group: list[str], component: str, length: str, tie: str) -> DataFrame:
    """One row a component: the longest; of equal lengths the later."""
    order = Window.partitionBy(*group, component).orderBy(F.desc(length), F.desc(tie))
    return rows.withColumn("__rn", F.row_number().over(order)).filter("__rn = 1").drop("__rn")


def search_with_fallback(results: DataFrame, claim: str, restricted: str, attempt: str, enough: int) -> DataFrame:
    """Restricted results of the tries 0, 1, ... before the first empty one; claims that have fewer than `enough`
    of them, none included, also get the unrestricted results. Counts are per (claim, try), aggregated before
    the shuffle; a claim without restricted results has an empty try 0."""
    named = results.withColumn("__try", F.when(F.col(restricted), F.col(attempt)))
    tries = named.groupBy(claim).agg(F.collect_set("__try").alias("__seen"))  # as many values as tries
    stop = F.aggregate(F.array_sort("__seen"), F.lit(0), lambda at, t: F.when(t == at, at + 1).otherwise(at))
    kept = results.join(tries.select(claim, stop.alias("__stop")), claim).filter(F.col(restricted) & (F.col(attempt) < F.col("__stop"))).select(*results.columns)
    enough_hits = kept.groupBy(claim).agg(F.count("*").alias("__n")).filter(F.col("__n") >= enough).select(claim)
    return kept.unionByName(results.filter(~F.col(restricted)).join(enough_hits, claim, "left_anti").select(*results.columns))


def position_range(items: DataFrame, position: str, start: int = 0, stop: int | None = None) -> DataFrame:
    """Items at positions start .. stop - 1."""
    kept = items.filter(F.col(position) >= start)
    return kept if stop is None else kept.filter(F.col(position) < stop)


def success_failure(pages: DataFrame, claim: str, error: str, position: str, most: int) -> tuple[DataFrame, DataFrame]:
    """(pages without an error, the first `most` of a claim by position; pages with one)."""
    return first_n(pages.filter(F.col(error).isNull()), [claim], [position], most), pages.filter(F.col(error).isNotNull())


def with_provenance(chunks: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """Chunks with the struct `info` of what their page was found by; null where nothing is known."""
    return chunks.join(found.select(key, "info"), key, "left")


def merge_by_position(left: DataFrame, right: DataFrame, position: str, same: list[str], take: str) -> DataFrame:
    """Rows at one position of both lists: same_<column> for each checked column, and right's `take` where all agree."""
    renamed = right.select(F.col(position), *[F.col(c).alias(f"__{c}") for c in same], take)
    both = left.join(renamed, position)
    checks = {f"same_{c}": F.col(c).eqNullSafe(F.col(f"__{c}")) for c in same}
    out = both.withColumns(checks)
    agree = F.lit(True)
    for c in checks:
        agree = agree & F.col(c)
    return out.withColumn(take, F.when(agree, F.col(take))).drop(*[f"__{c}" for c in same])


def unfinished(items: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Items whose key the checkpoint lacks."""
    return items.join(done.select(*keys).distinct(), keys, "left_anti")


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Old rows that new ones don't replace, and the new ones."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def checked_merge(left: DataFrame, right: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(inner join, one row of counts): the merge is sound if left, right and joined agree."""
    joined = left.join(right, keys)
    counts = left.agg(F.count("*").alias("n_left")).crossJoin(right.agg(F.count("*").alias("n_right"))).crossJoin(joined.agg(F.count("*").alias("n_joined")))
    return joined, counts.withColumn("sound", (F.col("n_left") == F.col("n_right")) & (F.col("n_left") == F.col("n_joined")))
