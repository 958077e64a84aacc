"""Quality classifier: similarity-weighted votes of the nearest labelled texts in a latent space.

A text becomes counts of words, word shapes (capitals, small letters, digits and signs, runs collapsed)
and text marks (a word repeated at once, a repeated line, its length). Log counts times inverse document
frequency, each block of unit length, go through a truncated SVD of the labelled texts: latent-semantic
vectors of DIMENSIONS numbers. The labelled vectors are broadcast; every document's cosines with all of
them are computed exactly, a block of documents at a time, and its K nearest vote by similarity.

The labelled texts are at most ROWS training rows of each label of at most CHARS characters each (the
bounds are parameters, see `toxicity.training_rows`), one an id, chosen by a hash of the id; terms, projection and vectors thus have a fixed size. Scoring reads every whole text and
nothing but the text.

Null texts are empty texts; a text without any known term gets the vote of all labelled rows, as do all
texts if the labels have one kind only; without labelled rows every score is 0. Repeated rows and ids
are scored row by row. Ties between neighbours go to the earlier labelled row, in text order. An empty
table gives an empty result. Extra columns are not read.
"""

from __future__ import annotations

import base64
import io
import json
import operator
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import short_batches, table
from .toxicity import remainder, train, training_rows

ROWS = 1500
WORDS = 3000
SHAPES = 600
DIMENSIONS = 48
K = 15
BLOCK = 256
#: Characters of a shape that stand for their kind.
KINDS = str.maketrans({**{c: "X" for c in map(chr, range(65, 91))}, **{c: "x" for c in map(chr, range(97, 123))}, **{c: "0" for c in "0123456789"}})


class Shapes(dict):
    """Word -> its shape; bounded, emptied when full."""

    def __missing__(self, word: str) -> str:
        if len(self) > 200_000:
            self.clear()
        out, last = [], ""
        for c in word[:200].translate(KINDS):
            c = ("X" if c.isupper() else "x") if c.isalpha() else c
            if c != last:
                out.append(c)
            last = c
        shape = self[word] = "".join(out)[:8]
        return shape


_shapes = Shapes()


def terms(text: str | None) -> tuple[Counter, Counter, Counter]:
    """Counts of words, shapes and marks of a whole text."""
    text = text or ""
    words = text.split()
    lines = [x for x in text.split("\n") if x and not x.isspace()]
    marks = Counter()
    marks["repeat"] = sum(map(operator.eq, words, words[1:]))
    marks["line"] = len(lines) - len(set(lines))
    marks["other"] = len(set(words))
    marks[f"size{min(12, len(words).bit_length())}"] = max(1, len(words) // 4)
    return Counter(map(str.lower, words)), Counter(map(_shapes.__getitem__, words)), marks


class Latent:
    """Term indices with idf, the projection, labelled vectors and labels."""

    def __init__(self, index: list[dict[str, int]], idf: np.ndarray, projection: np.ndarray, vectors: np.ndarray, labels: np.ndarray):
        self.index, self.idf, self.projection, self.vectors, self.labels = index, idf, projection, vectors, labels

    def raw(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """(indices, values) of the text's terms, each of the three blocks of unit length."""
        at, values = [], []
        for index, counts in zip(self.index, terms(text), strict=True):
            known = [(i, n) for t, n in counts.items() if n and (i := index.get(t)) is not None]
            if known:
                i, n = np.array(known).T
                v = np.log1p(n) * self.idf[i]
                at.append(i)
                values.append(v / (np.linalg.norm(v) or 1.0))
        return (np.concatenate(at), np.concatenate(values)) if at else (np.zeros(0, np.int64), np.zeros(0))

    def project(self, texts: list) -> np.ndarray:
        out = np.zeros((len(texts), self.projection.shape[1]), np.float64)
        for k, t in enumerate(texts):
            at, v = self.raw(t)
            if len(at):
                out[k] = v @ self.projection[at]
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(norm > 1e-12, norm, 1.0)

    def scores(self, texts: list, k: int = K) -> np.ndarray:
        if not len(self.labels):
            return np.zeros(len(texts))
        prior = self.labels.mean()
        out = np.full(len(texts), prior)
        for at in range(0, len(texts), BLOCK):
            q = self.project(texts[at : at + BLOCK])
            cosine = np.round(q @ self.vectors.T, 9)
            near = np.argsort(-cosine, axis=1, kind="stable")[:, :k] if cosine.shape[1] <= k else self._nearest(cosine, k)
            w = np.maximum(np.take_along_axis(cosine, near, 1), 0.0) ** 2
            total = w.sum(1)
            voted = (w * self.labels[near]).sum(1) / np.where(total > 0, total, 1.0)
            known = (np.abs(q).sum(1) > 0) & (total > 0)
            out[at : at + BLOCK] = np.where(known, voted, prior)
        return np.clip(out, 0.0, 1.0)

    @staticmethod
    def _nearest(cosine: np.ndarray, k: int) -> np.ndarray:
        """The k largest of each row, equal values by position."""
        near = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
        near.sort(axis=1)
        least = np.take_along_axis(cosine, near, 1).min(1, keepdims=True)
        tied = (cosine >= least).sum(1) > k  # the cut goes through equal values
        order = np.argsort(-np.take_along_axis(cosine, near, 1), axis=1, kind="stable")
        near = np.take_along_axis(near, order, 1)
        if tied.any():
            near[tied] = np.argsort(-cosine[tied], axis=1, kind="stable")[:, :k]
        return near

    def dump(self) -> str:
        buffer = io.BytesIO()
        np.savez(buffer, idf=self.idf, projection=self.projection.astype(np.float32), vectors=self.vectors.astype(np.float32), labels=self.labels)
        return json.dumps([self.index, base64.b64encode(buffer.getvalue()).decode()])

    @staticmethod
    def load(model: str) -> Latent:
        index, packed = json.loads(model)
        x = np.load(io.BytesIO(base64.b64decode(packed)))
        return Latent(index, x["idf"], x["projection"].astype(np.float64), x["vectors"].astype(np.float64), x["labels"])


def learn(rows: list[tuple[str, int]], dimensions: int = DIMENSIONS) -> Latent:
    labels = np.array([y for _, y in rows], float)
    found = [terms(t) for t, _ in rows]
    index, idf, base = [], [], 0
    for block, most in enumerate((WORDS, SHAPES, None)):
        df = Counter(t for f in found for t, n in f[block].items() if n)
        kept = [t for t, n in sorted(df.items(), key=lambda x: (-x[1], x[0]))[:most] if n >= 3 or block == 2]
        index.append({t: base + i for i, t in enumerate(kept)})
        idf += [np.log((1 + len(rows)) / (1 + df[t])) + 0.2 for t in kept]
        base += len(kept)
    model = Latent(index, np.array(idf), np.zeros((base, 1)), np.zeros((0, 1)), labels)
    x = np.zeros((len(rows), base), np.float32)
    for k, (t, _) in enumerate(rows):
        at, v = model.raw(t)
        x[k, at] = v
    d = max(1, min(dimensions, *x.shape)) if x.size else 1
    rng = np.random.default_rng(5)
    # randomised range finder with power steps, then an exact SVD of the small matrix
    q = np.linalg.qr(x @ rng.standard_normal((base, d + 12)).astype(np.float32))[0] if x.size else np.zeros((len(rows), 1))
    for _ in range(4):
        q = np.linalg.qr(x @ np.linalg.qr(x.T @ q)[0])[0]
    vt = np.linalg.svd(q.T @ x, full_matrices=False)[2][:d] if x.size else np.zeros((1, base))
    model.projection = vt.T.astype(np.float64)
    model.vectors = model.project([t for t, _ in rows]) if rows else np.zeros((0, 1))
    return model


def score(docs: DataFrame, model: str, text: str = "text", doc_id: str = "doc_id", k: int = K) -> DataFrame:
    """(doc_id, score) of every row."""
    short_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def batches(it):
        latent = Latent.load(shared.value)
        for b in it:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(latent.scores(b.column(1).to_pylist(), k), pa.float64())], names=["doc_id", "score"])

    kind = docs.select(F.col(doc_id)).schema[0].dataType.simpleString()
    return docs.select(F.col(doc_id), F.col(text).cast("string")).mapInArrow(batches, f"doc_id {kind}, score double")


def op7_quality_knn(spark, sf_dir) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = train(training_rows(docs, labels, "quality", 3, 1, ROWS), lambda rows: learn(rows).dump())
    return score(docs, model).select("doc_id", (remainder(F.col("doc_id"), 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
