"""Tokenizers, spans of tokens and slices of spans against plain Python."""

import random
import re

import pytest
from pyspark.sql import functions as F

from claimspark.functions import tokenizers
from claimspark.operators import alignment

TEXTS = ["", None, "  ", "a", "Dr. Ünal won 3.5 %\n\nof it!", "中文 字。x", "ab" * 3000, "foobarbaz foo-bar\tfoobar"]


def plain_longest(words, text):
    out, at = [], 0
    while at < len(text):
        best = max((w for w in words if w and text.startswith(w, at)), key=len, default=text[at])
        out.append(best)
        at += len(best)
    return out


@pytest.mark.parametrize("name", ["runs", "marks", "longest"])
def test_spans(spark, name):
    words = ["foo", "foobar", "bar", "barbaz", "ab", "aba", "won 3", "中文", ""]
    kind = tokenizers.longest_match(words) if name == "longest" else tokenizers.REGISTRY[name]
    cut = {"runs": lambda t: re.findall(r"\S+|\s+", t), "marks": lambda t: re.findall(r"\w+|[^\w\s]|\s+", t), "longest": lambda t: plain_longest(words, t)}[name]
    df = spark.createDataFrame(list(enumerate(TEXTS)), "id int, text string")
    got = sorted(tuple(r) for r in alignment.token_spans(df, ["id"], "text", kind).collect())
    want = []
    for i, t in enumerate(TEXTS):
        at, n = 0, 0
        for p in cut(t or ""):
            if p.strip():
                want.append((i, n, p, at, at + len(p)))
                n += 1
            at += len(p)
    assert got == want
    counts = {r.id: r.n for r in df.select("id", kind.count(F.col("text")).alias("n")).collect()}
    assert counts == {i: sum(w[0] == i for w in want) for i in range(len(TEXTS))}


def test_slices(spark):
    rnd = random.Random(5)
    tokens, spans, want = [], [], {}
    for key in range(12):
        at, places = 0, []
        for n in range(rnd.randrange(30)):
            at += rnd.randrange(3)
            size = rnd.randrange(1, 4)
            tokens.append((key, n, at, at + size, n / 2))
            places.append((at, n))
            at += size
        start = 0
        for s in range(rnd.randrange(6)):
            start += rnd.randrange(4)
            end = start + rnd.randrange(12)
            mine = [n for p, n in places if start <= p < end]
            spans.append((key, s, start, end))
            want[key, s] = (min(mine, default=None), max(mine) + 1 if mine else None, len(mine), sum(n / 2 for n in mine))
            start = max(end, start + 1)
    t = spark.createDataFrame(tokens, "k int, token_idx long, start long, end long, lp double")
    s = spark.createDataFrame(spans, "k int, s int, start long, end long")
    got = {(r.k, r.s): (r.first, r.last, r.n, pytest.approx(r.lp)) for r in alignment.span_slices(t, s, ["k"], "s", "lp").collect()}
    assert got.keys() == want.keys() and all(got[k] == want[k] for k in want)
    assert alignment.span_slices(t.limit(0), s.limit(0), ["k"], "s").count() == 0
