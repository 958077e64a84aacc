"""SimHash near-duplicates: 64-bit fingerprints, linked through a vantage-point tree.

1. Each text becomes a fingerprint (Arrow batches; one number a document leaves the worker).
2. Distinct fingerprints are dealt to the leaves of a vantage-point tree. The tree is fitted on a
   sample that grows with the leaves (LEAST fingerprints each, MOST at most, so that the tree's broadcast
   is bounded by a few MB) and only decides where a fingerprint goes; every fingerprint has one home leaf. By the
   triangle inequality two fingerprints within `radius` bits can lie on different sides of a split only
   if the inner one is within `radius` bits of the boundary: such fingerprints also visit the outer
   side as guests, so each linked pair meets in exactly the leaves that can hold it.
3. A leaf goes on splitting by the same rule until blocks are small, compares these exactly, and
   returns a spanning forest of its links, never all pairs of a group.
4. Components come from hooking to the smallest neighbour, pointer jumping and contraction over
   DataFrames; every round is a written table. Nothing but the sample and counts reaches the driver.

Null texts are empty texts: fingerprint zero, linked like any other. Repeated rows and repeated or
null ids keep their rows; a component's id is its smallest non-null doc_id (null if it has none). An
empty table gives an empty result. Other input columns, also those with clashing names, are not read;
`one_of_each` and the stage keep them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise, parts_for, short_batches, table

RADIUS = 3
SHINGLE = 3
SAMPLE = 16_384
#: Fingerprints sampled at most (2 MB on the driver); they make 65,536 leaves; beyond half a billion distinct fingerprints leaves grow.
MOST = 262_144
LEAST = 4
LEAF = 8_000
BLOCK = 512
#: Ways that a component's rows are split where they meet its id.
SALTS = 16
#: A fingerprint of more than one row in HOT is broadcast where rows meet their component.
HOT = 1000


def fingerprint(text: str | None, width: int = SHINGLE) -> int:
    """Bit b is set if it is set in over half of the shingles' XXH64 values (seed 42)."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    n = max(1, len(words) - width + 1)
    counts = np.zeros(64, np.int64)
    for at in range(0, n, 8192):
        part = words[at : at + 8192 + width - 1]
        shingles = map(b" ".join, zip(*(part[k:] for k in range(width)), strict=False)) if len(words) >= width else [b" ".join(words)]
        h = np.fromiter((xxhash.xxh64_intdigest(s, 42) for s in shingles), np.uint64)
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", width: int = SHINGLE) -> DataFrame:
    """(doc_id, fp long) of every row."""

    def batches(it):
        for b in it:
            fp = np.array([fingerprint(t, width) for t in b.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp)], names=["doc_id", "fp"])

    short_batches(docs.sparkSession)
    kind = docs.select(F.col(doc_id)).schema[0].dataType.simpleString()
    return docs.select(F.col(doc_id), F.col(text).cast("string")).mapInArrow(batches, f"doc_id {kind}, fp long")


def distance(a: np.ndarray, v) -> np.ndarray:
    return np.bitwise_count(a ^ np.uint64(v)).astype(np.int16)


def choose_split(points: np.ndarray, rng, radius: int) -> tuple[int, int] | None:
    """(vantage, r): inner is distance <= r. Of a few vantage points, the one with least mass in the
    band (r - radius, r] that becomes guests, given that neither side is under a quarter."""
    best = None
    for v in rng.choice(points, min(6, len(points)), replace=False):
        share = np.cumsum(np.bincount(distance(points[:4096], v), minlength=65)) / min(len(points), 4096)
        for r in range(64):
            if 0.25 <= share[r] <= 0.75:
                band = share[r] - (share[r - radius] if r >= radius else 0)
                if best is None or band < best[0]:
                    best = (band, int(v), r)
    return best and best[1:]


def fit_tree(sample: np.ndarray, leaves: int, radius: int) -> list[tuple[int, int, int, int]]:
    """Nodes (vantage, r, inner, outer); a child below zero is the leaf ~child."""
    nodes: list = []
    n_leaves = 0
    rng = np.random.default_rng(7)

    def grow(points: np.ndarray, share: float) -> int:
        nonlocal n_leaves
        split = choose_split(points, rng, radius) if share * leaves > 1.5 and len(points) >= 2 * LEAST else None
        if split is None:
            n_leaves += 1
            return -n_leaves
        inner = distance(points, split[0]) <= split[1]
        at = len(nodes)
        nodes.append(None)
        nodes[at] = (*split, grow(points[inner], share * inner.mean()), grow(points[~inner], share * (1 - inner.mean())))
        return at

    root = grow(sample, 1.0)
    return nodes if root >= 0 else []


def route(nodes, fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(leaf, index into fps, guest) for the home of each fingerprint and every leaf that it visits."""
    out = []
    stack = [(0 if nodes else -1, np.arange(len(fps)), np.zeros(len(fps), bool))]
    while stack:
        at, idx, guest = stack.pop()
        if not len(idx):
            continue
        if at < 0:
            out.append((np.full(len(idx), ~at), idx, guest))
            continue
        v, r, inner, outer = nodes[at]
        d = distance(fps[idx], v)
        inside = np.where(guest, d - radius <= r, d <= r)
        outside = np.where(guest, d + radius > r, d > r)
        visit = ~guest & inside & (d + radius > r)
        stack.append((inner, idx[inside], guest[inside]))
        stack.append((outer, np.concatenate([idx[outside], idx[visit]]), np.concatenate([guest[outside], np.ones(visit.sum(), bool)])))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def close_pairs(home: np.ndarray, guest: np.ndarray, radius: int, rng):
    """Yield index arrays (i, j) of linked pairs; indices run over home, then guest. Guests don't pair."""
    fps = np.concatenate([home, guest])
    stack = [(np.arange(len(home)), np.arange(len(home), len(fps)))]
    while stack:
        h, g = stack.pop()
        if not len(h) or len(h) + len(g) < 2:
            continue
        split = choose_split(fps[h], rng, radius) if len(h) > BLOCK else None
        if split is None:
            both = np.concatenate([h, g])
            rows = max(1, 2_000_000 // len(both))
            for at in range(0, len(h), rows):
                near = np.bitwise_count(fps[h[at : at + rows], None] ^ fps[None, both[at:]]) <= radius
                i, j = np.nonzero(near)
                keep = j > i
                yield h[at + i[keep]], both[at + j[keep]]
            continue
        v, r = split
        dh, dg = distance(fps[h], v), distance(fps[g], v)
        stack.append((h[dh <= r], g[dg - radius <= r]))
        stack.append((h[dh > r], np.concatenate([g[dg + radius > r], h[(dh <= r) & (dh + radius > r)]])))


def forest(n: int, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Stars (smallest index, member) of the components of the links (i, j) over n points."""
    label = np.arange(n)
    while len(i):
        a, b = label[i], label[j]
        differ = a != b
        if not differ.any():
            break
        low, high = np.minimum(a, b)[differ], np.maximum(a, b)[differ]
        np.minimum.at(label, high, low)
        while (label != label[label]).any():
            label = label[label]
    member = np.nonzero(label != np.arange(n))[0]
    return label[member], member


def leaf_links(home: np.ndarray, guest: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprint pairs that span the same components as all links in a leaf."""
    fps = np.concatenate([home, guest])
    i, j, held = np.zeros(0, np.int64), np.zeros(0, np.int64), []
    for pair in close_pairs(home, guest, radius, np.random.default_rng(11)):
        held.append(pair)
        if sum(len(x) for x, _ in held) > 1_000_000:
            i, j = forest(len(fps), np.concatenate([i, *(x for x, _ in held)]), np.concatenate([j, *(y for _, y in held)]))
            held = []
    i, j = forest(len(fps), np.concatenate([i, *(x for x, _ in held)]), np.concatenate([j, *(y for _, y in held)]))
    return fps[i], fps[j]


def links(distinct: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(a, b): links between different fingerprints of distinct(fp), enough to span every component."""
    spark = distinct.sparkSession
    leaves = min(parts_for(distinct.count(), LEAF, 1), MOST // LEAST)
    sample = [r.fp for r in distinct.select("fp").orderBy(F.xxhash64("fp"), "fp").limit(max(SAMPLE, LEAST * leaves)).collect()]
    nodes = fit_tree(np.array(sample, np.int64).view(np.uint64), leaves, radius)
    tree = spark.sparkContext.broadcast(nodes)

    def deal(it):
        for b in it:
            fps = np.asarray(b.column(0)).view(np.uint64)
            leaf, idx, guest = route(tree.value, fps, radius)
            yield pa.RecordBatch.from_arrays([pa.array(leaf), pa.array(fps[idx].view(np.int64)), pa.array(guest)], names=["leaf", "fp", "guest"])

    def search(leaf: pa.Table) -> pa.Table:
        fps, guest = leaf.column("fp").to_numpy().view(np.uint64), leaf.column("guest").to_numpy()
        a, b = leaf_links(fps[~guest], fps[guest], radius)
        return pa.table({"a": a.view(np.int64), "b": b.view(np.int64)})

    dealt = distinct.select("fp").mapInArrow(deal, "leaf long, fp long, guest boolean")
    return dealt.groupBy("leaf").applyInArrow(search, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges(a, b); nodes of a component share the root.

    Each round hooks every node to its smallest neighbour, jumps pointers to the end of each path and
    contracts the links to the roots. Links and nodes only shrink; aggregation is partial before each
    shuffle and a hub's rows are never gathered. Each table of a round goes when the next one is written.
    """
    live = materialise(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b").distinct(), "links")
    label = None
    while not live.isEmpty():
        both = live.union(live.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("root"), F.lit(True).alias("moved"))
        hook, moving = materialise(least, "hooks"), True
        while moving:
            up = hook.select(F.col("node").alias("root"), F.col("root").alias("above"))
            jumped = materialise(hook.join(up, "root").select("node", F.col("above").alias("root"), (F.col("above") != F.col("root")).alias("moved")), "jumps")
            discard(hook)
            hook, moving = jumped, not jumped.filter("moved").isEmpty()
        if label is None:
            label = materialise(hook.select("node", "root"), "labels")
        else:
            step = hook.select(F.col("node").alias("root"), F.col("root").alias("above"))
            after = materialise(label.join(step, "root", "left").select("node", F.coalesce("above", "root").alias("root")), "labels")
            discard(label)
            label = after
        a = hook.select(F.col("node").alias("a"), F.col("root").alias("ra"))
        b = hook.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        moved = live.join(a, "a").join(b, "b").filter("ra <> rb")
        left = materialise(moved.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(), "links")
        discard(live, hook)
        live = left
    return label if label is not None else live.select(F.col("a").alias("node"), F.col("b").alias("root"))


def rooted(distinct: DataFrame, radius: int) -> DataFrame:
    """distinct(fp, first) with root, the component of fingerprints that have a link, else null."""
    return distinct.join(components(links(distinct, radius)).withColumnRenamed("node", "fp"), "fp", "left")


def least_of_root(rows: DataFrame, first: str) -> DataFrame:
    """rows(root, first, fp) with `least`: the smallest `first` of the root's rows, or the row's own without a root.

    A component's rows are split SALTS ways where they meet their smallest value.
    """
    least = rows.filter("root IS NOT NULL").groupBy("root").agg(F.min(first).alias("least"))
    spread = least.select("root", "least", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    met = rows.withColumn("salt", F.pmod(F.xxhash64("fp"), F.lit(SALTS)).cast("int")).join(spread, ["root", "salt"], "left")
    return met.withColumn("least", F.when(F.col("root").isNull(), F.col(first)).otherwise(F.col("least"))).drop("salt")


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", radius: int = RADIUS, width: int = SHINGLE) -> DataFrame:
    """(doc_id, fp long, component_id) for every row of docs."""
    fps = materialise(fingerprints(docs, text, doc_id, width), "fingerprints")
    distinct = materialise(fps.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")), "distinct")
    component = materialise(least_of_root(rooted(distinct, radius), "first").select("fp", F.col("least").alias("component_id"), "n"), "components")
    discard(distinct)
    # fingerprints of more than one row in HOT, fewer than HOT, are broadcast: their rows stay where they are
    bound = fps.count() // HOT
    met = fps.join(F.broadcast(component.filter(F.col("n") > bound)), "fp", "left")
    cold = met.filter("n IS NULL").select("doc_id", "fp").join(component.filter(F.col("n") <= bound), "fp")
    return met.filter("n IS NOT NULL").unionByName(cold).select("doc_id", "fp", "component_id")


def one_of_each(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", radius: int = RADIUS, width: int = SHINGLE) -> DataFrame:
    """One row of each component, all columns kept: that with the smallest doc_id, rows without one last.

    Of rows with that id the one with the smallest hash of its text stays, of equal rows (id and text) any
    one. Rows are told apart by id and two hashes of the text, so repeated and null ids don't matter.
    """
    columns = docs.columns
    named = docs.select(*[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(columns)])
    i, t = F.col(f"c{columns.index(doc_id)}"), F.coalesce(F.col(f"c{columns.index(text)}").cast("string"), F.lit(""))
    who = F.struct(i.isNull().alias("no_id"), i.alias("id"), F.xxhash64(t).alias("a"), F.hash(t, F.length(t)).alias("b"))
    keyed = named.withColumns({"who": who, "t": t})
    fps = materialise(fingerprints(keyed, "t", "who", width).withColumnRenamed("doc_id", "who"), "fingerprints")
    distinct = materialise(fps.groupBy("fp").agg(F.min("who").alias("first")), "distinct")
    winners = least_of_root(rooted(distinct, radius), "first").select(F.col("least").alias("w")).distinct()
    # a null id is a key like any other
    key = lambda x: [x["no_id"], F.coalesce(x["id"].cast("string"), F.lit("")), x["a"], x["b"]]
    k = [f"k{n}" for n in range(4)]
    kept = named.withColumns(dict(zip(k, key(who), strict=True))).join(winners.select(*[c.alias(n) for c, n in zip(key(F.col("w")), k, strict=True)]), k, "left_semi").dropDuplicates(k)
    return kept.select(*[F.col(f"c{n}").alias(c) for n, c in enumerate(columns)])


def op9_simhash_near_dedup(spark, sf_dir) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each component one row stays (`one_of_each`): the smallest doc_id's."""
    return one_of_each(docs)
