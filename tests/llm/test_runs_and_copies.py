"""Periodic runs, exact duplicates and the filter audit: brute force, nulls, empty and very long texts, ties, repeated rows, empty tables, clashing names."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction
from itertools import permutations

import pytest

from claimspark.llm import catalog, exact_dedup, filter_audit, periodic_runs
from tests.compare import DATA, connect

SPACE = re.compile(r"[\x20\x09-\x0D]+")
LONG = " ".join(f"Word{i % 977}" for i in range(30_000))
ROWS = [
    (1, "a b  c", "en", 5),
    (2, None, None, None),
    (3, "", "", 1),
    (4, LONG, "de", 2),
    (5, "a\tb\nc", "en", 6),
    (5, "a b c", "en", 7),
    (5, "a b c", "fr", 7),
    (None, "a b c", "en", 8),
    (None, "only here #1", None, 9),
    (None, "only here #1", None, 9),
    (6, "x y " * 40, "en", 1),
    (7, "x y " * 40, "en", 1),
    (8, "x y  z " * 100, "en", 1),
    (0, LONG, "de", 3),
]
SCHEMA = "doc_id long, text string, lang string, digest long"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def words(t):
    return [w for w in SPACE.split(t or "") if w]


def sha(t):
    return hashlib.sha256(t.encode()).hexdigest()


def brute_runs(ws, least, exponent):
    """For every period: maximal stretches of words that equal the word one period on."""
    n, out = len(ws), []
    for q in range(1, n // exponent + 1):
        i = 0
        while i < n - q:
            s = i
            while i < n - q and ws[i] == ws[i + q]:
                i += 1
            length = i - s + q
            if i > s and length >= max(least, exponent * q) and not any(all(ws[x] == ws[x + d] for x in range(s, s + length - d)) for d in range(1, q)):
                out.append((s, length, q))
            i += i == s
    return sorted(out, key=lambda r: (r[0], r[2]))


def repetitive(rng):
    kind, k = rng.random(), rng.choice([1, 2, 2, 3, 4])
    if kind < 0.4:
        return [rng.randrange(k) for _ in range(rng.randint(0, 70))]
    if kind < 0.8:
        ws = []
        while len(ws) < 70:
            ws += [rng.randrange(k + 1) for _ in range(rng.randint(1, 8))] * rng.randint(1, 6)
            ws += ws[-rng.randint(1, len(ws)) :] * rng.randint(0, 4)
        return ws[:130]
    a, b = [0], [0, 1]
    for _ in range(6):
        a, b = b, b + a
    return (b * rng.randint(1, 5))[rng.randint(0, 4) :]


def test_runs_against_brute_force():
    rng = random.Random(11)
    for _ in range(1500):
        ws = repetitive(rng)
        for least, exponent in ((24, 3), (1, 2), (1, 3), (5, 2), (1, 4)):
            assert periodic_runs.find_runs(ws, least, exponent) == brute_runs(ws, least, exponent), ws


def test_lyndon_array_against_its_definition():
    rng = random.Random(12)
    for _ in range(300):
        a = [*repetitive(rng), -1]
        nss, lce = periodic_runs.smaller_suffixes(a)
        for i in range(len(a) - 1):
            want = next(j for j in range(i + 1, len(a)) if a[j:] < a[i:])
            same = next(k for k in range(len(a)) if a[i + k] != a[want + k]) if want < len(a) - 1 else 0
            assert (nss[i], lce[i]) == (want, same)


@pytest.mark.parametrize("kind", ["one", "pairs", "fibonacci", "blocks", "zimin"])
def test_letters_are_matched_in_linear_time(kind):
    """Comparisons of letters, counted: at most one match and two mismatches for each position."""
    n = 20_000
    fib, nxt = [0], [0, 1]
    while len(nxt) < n:
        fib, nxt = nxt, nxt + fib
    zimin, k = [0], 1
    while len(zimin) < n:
        zimin, k = [*zimin, k, *zimin], k + 1
    a = {"one": [0] * n, "pairs": [0, 1] * (n // 2), "fibonacci": nxt[:n], "blocks": ([0] * 200 + [1]) * (n // 201), "zimin": zimin}[kind]
    matched = 0

    class Letter(int):
        def __eq__(self, other):
            nonlocal matched
            matched += 1
            return int(self) == int(other)

        __hash__ = int.__hash__

    periodic_runs.smaller_suffixes([Letter(x) for x in [*a, -1]])
    assert matched <= 3 * len(a)


def tail(ws, doc_id):
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(ws)
    if doc_id is None or h % 10 or not n:
        return ws
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [ws[a + (i - a) % p] if i >= a else ws[i] for i in range(n)]


def run_row(doc_id, text):
    ws = tail(words(text), doc_id)
    runs = periodic_runs.find_runs(ws) if len(ws) > 3000 else brute_runs(ws, 24, 3)
    best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2])) if runs else None
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    listed = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    kept = " ".join(w for i, w in enumerate(ws) if i not in gone)
    return (doc_id, len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2], sha(listed), sha(kept), len(ws))


def test_op11(spark, tmp_path):
    """Every tenth id has its words' tail repeated; ids here go up to 400 so that many do."""
    rng = random.Random(13)
    rows = [(i, None if i % 41 == 0 else "" if i % 43 == 0 else " ".join(f"w{rng.randrange(300)}" for _ in range(rng.choice([5, 30, 120, 400])))) for i in range(400)]
    rows += [(None, "z " * 50), (None, None), (7, " \t\n"), (7, "q r " * 30), (7, "q r " * 30), (401, "w " * 5000 + "v " * 30)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    got = catalog.QUERIES["op11_periodic_runs"](spark, str(tmp_path))
    assert sorted([tuple(r) for r in got.collect()], key=str) == sorted([run_row(*r) for r in rows], key=str)


def test_op11_on_the_tables(spark):
    got = catalog.QUERIES["op11_periodic_runs"](spark, DATA).collect()
    want = connect().sql("SELECT doc_id, text FROM documents").fetchall()
    assert sorted(map(tuple, got), key=str) == sorted([run_row(*r) for r in want], key=str) and sum(r.n_runs for r in got) > 20


def test_runs_keep_text_and_spans(docs, none, spark):
    got = {(r.doc_id, r.n_words): r for r in periodic_runs.scan(docs).collect()}
    assert got[6, 80].runs == [(0, 80, 2)] and got[6, 80].collapsed == "x y"
    assert got[2, 0].runs == [] and got[2, 0].collapsed == ""
    assert got[4, 30_000].runs[0].period == 977 and len(got[4, 30_000].collapsed.split()) == 977
    assert periodic_runs.scan(none).collect() == []
    clash = spark.createDataFrame([("u", "b " * 30, [1], "x")], "id string, body string, runs array<int>, collapsed string")
    assert [tuple(r) for r in periodic_runs.scan(clash, "body", "id").collect()] == [("u", 30, [(0, 30, 1)], "b")]


def brute_groups(rows):
    groups = defaultdict(list)
    for k, (i, t, *_) in enumerate(rows):
        groups[SPACE.sub(" ", t or "")].append((i is None, i or 0, k, i))
    out = []
    for t, g in groups.items():
        first = min(g)
        out += [(i, first[3], len(g), sha(t)) for _, _, _, i in g]
    return Counter(out), len(groups)


@pytest.mark.parametrize("broadcast_blocks", [exact_dedup.BROADCAST_BLOCKS, 0])
def test_exact_duplicates(docs, broadcast_blocks):
    got = exact_dedup.duplicates(docs, broadcast_blocks=broadcast_blocks).collect()
    want, n_groups = brute_groups(ROWS)
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.digest.hex()) for r in got) == want
    kept = [r for r in got if r.kept]
    assert len(kept) == n_groups and all(r.doc_id == r.keep_id for r in kept) and len({bytes(r.digest) for r in kept}) == n_groups


@pytest.mark.parametrize("broadcast_blocks", [exact_dedup.BROADCAST_BLOCKS, 0])
def test_unique_rows_keep_columns(docs, none, spark, broadcast_blocks):
    got = exact_dedup.unique_rows(docs, broadcast_blocks=broadcast_blocks)
    assert got.columns == docs.columns
    rows = [tuple(r) for r in got.collect()]
    assert set(rows) <= set(ROWS) and len({SPACE.sub(" ", r[1] or "") for r in rows}) == len(rows) == brute_groups(ROWS)[1]
    assert {r[0] for r in rows} == {0, 1, 2, None, 6, 8}
    assert exact_dedup.unique_rows(none).collect() == [] and exact_dedup.duplicates(none).collect() == []
    clash = spark.createDataFrame([("b", "t  u", 1, "x"), ("a", "t u", 2, "y")], "id string, body string, maybe int, block string")
    assert [tuple(r) for r in exact_dedup.unique_rows(clash, "body", "id").collect()] == [("a", "t u", 2, "y")]


def test_a_hot_group_and_no_missed_repeat(spark):
    """A third of all rows are one text, thousands are pairs: no group is lost by the filter, few single rows are taken along."""
    rng = random.Random(14)
    rows = [(i, "same text" if i % 3 == 0 else f"text {i // 2 if i % 2 else i} {rng.random() if i % 5 == 0 else ''}") for i in range(12_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    got = exact_dedup.duplicates(df)
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.digest.hex()) for r in got.collect()) == brute_groups(rows)[0]
    keys = df.select(exact_dedup.digest(df.text).alias("digest"))
    blocks = exact_dedup.blocks_for(len(rows))
    marked = exact_dedup.tested(keys, exact_dedup.shared_cells(keys, blocks), blocks)
    single = keys.groupBy("digest").count().filter("count = 1").join(marked, "digest")
    assert single.filter("maybe").count() < 0.05 * single.count()


def brute_audit(rows, labels):
    texts = [(i, t or "", p or "") for i, t, p in rows]
    smallest = {}
    for i, t, _ in texts:
        if i is not None:
            smallest[t] = min(smallest.get(t, i), i)
    docs = []
    for i, t, p in texts:
        ws = words(t)
        fails = {
            "A": len(ws) < 200,
            "B": 100 * len(set(ws)) < 50 * len(ws),
            "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t),
            "D": re.search(r"[#$%&*|]", t) is not None,
            "E": t in smallest and (i is None or smallest[t] < i),
        }
        docs.append((p, {f for f, x in fails.items() if x}, any(q == 1 for d, q, _ in labels if d == i), any(x == 1 for d, _, x in labels if d == i)))
    out, shapley = [], Counter()
    for part in {p for p, *_ in docs}:
        own = [d[1:] for d in docs if d[0] == part]
        for order in permutations("ABCDE"):
            left, gone = own, []
            for step, f in enumerate(order, 1):
                here = [d for d in left if f in d[0]]
                redundant = sum(f in d[0] for d in gone)
                left, gone = [d for d in left if f not in d[0]], gone + here
                shapley[part, f] += len(here)
                out.append((part, "".join(order), step, len(left), len(here), redundant, sum(d[0] == {f} for d in own), sum(d[1] for d in here), sum(d[2] for d in here), f))
    return sorted((*r[:-1], shapley[r[0], r[-1]]) for r in out)


@pytest.mark.parametrize("block_bytes", [1, 1000, filter_audit.BLOCK_BYTES])
def test_filter_audit(docs, none, spark, block_bytes):
    labels = [(1, 1, 0), (1, 0, 1), (4, 1, 1), (99, 1, 1), (None, 1, 1), (6, None, None), (7, 1, None)]
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    marked = filter_audit.masks(docs, block_bytes=block_bytes, part_bytes=2000)
    found = filter_audit.vectors(marked, known).flatMap(lambda kv: filter_audit.report(*kv)).collect()
    assert sorted(map(tuple, found)) == brute_audit([r[:3] for r in ROWS], [x for x in labels if x[0] is not None])
    assert marked.groupBy().sum("n").first()[0] == len(ROWS)
    assert filter_audit.audit(none, known).collect() == []
    clash = spark.createDataFrame([("k", "t", 3, 4)], "doc_id string, text string, lang int, mask int")
    assert filter_audit.audit(clash, spark.createDataFrame([], "doc_id string, quality int, toxic int")).count() == 600


def test_one_fingerprint_for_different_texts():
    """Chains tell texts with one fingerprint apart by their bytes."""
    chains = filter_audit.Chains()
    assert chains.meet(1, b"a", 3, 5, {"x": 1}) is None and chains.meet(1, b"b", 4, 6, {"x": 1}) is None
    assert chains.meet(1, b"a", 3, 4, {"y": 2}) == (5, {"x": 1}, 3 | filter_audit.COPY)
    assert sorted(chains.entries()) == [(1, b"a", 3, 4, {"y": 2}), (1, b"b", 4, 6, {"x": 1})]
