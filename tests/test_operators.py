"""Hand-computed cases, folds against plain Python, and edge cases."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from claimspark.functions import dates, judge, sequences, text
from claimspark.operators import attribution, chunking, citations, dedup, markup, metrics, ranking
from claimspark.plans import faithfulness
from claimspark.sources import pages, results, scorers
from claimspark.streaming import resume


def one(spark, column, **values):
    kinds = {str: "string", int: "int", float: "double"}

    def kind(v):
        return f"array<{kind(v[0]) if v else 'string'}>" if isinstance(v, list) else kinds.get(type(v), "string")

    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {kind(v)}" for k, v in values.items()))
    return df.select(column.alias("x")).first().x


def selected(spark, scores, **params):
    df = spark.createDataFrame([(0, i, float(s)) for i, s in enumerate(scores)], "id int, source_idx long, score double")
    got = citations.select_citations(df, ["id"], citations.CitationParams(**params)).orderBy("span_rank").collect()
    return [list(range(r.lo, r.hi + 1)) for r in got], [r.span_score for r in got], [r.prob for r in got]


def test_citation_selection(spark):
    scores = [0, 0.96, 0.97, 0.99, 0.98, 0, 0.95, 0, 0.999]
    assert selected(spark, scores, t=0.95, p=0.4, k=4, n=3)[:2] == ([[8], [1, 2, 3]], [0.999, 0.99])
    found, _, probs = selected(spark, scores, t=0.95, p=0.7, k=4)
    assert found == [[8], [1, 2, 3, 4], [6]] and [round(p, 6) for p in probs] == [0.33977, 0.336723, 0.323507]
    assert selected(spark, [2, 0.1, 1.6, 3, 1.7], t=1.5, p=0.7, k=4)[:2] == ([[2, 3, 4], [0]], [3, 2])
    assert selected(spark, [0.1, 0.2], t=1.0) == ([], [], [])


def test_index_runs_keep_list_order(spark):
    for ids, want in (([8, 1, 2, 3], [(8, 8), (1, 3)]), ([3, 2], [(3, 3), (2, 2)]), ([], [])):
        got = spark.range(1).select(sequences.index_runs(F.array(*map(F.lit, ids)).cast("array<int>")).alias("x")).first().x
        assert [(r.lo, r.hi) for r in got] == want


def test_neighbourhood(spark):
    b = citations.neighbourhood(F.lit(2), F.lit(3), F.lit(6))
    row = spark.range(1).select(*[c.alias(k) for k, c in b.items()]).first()
    assert (row.pre_lo, row.pre_hi, row.post_lo, row.post_hi) == (0, 1, 4, 4)


def test_windows(spark):
    got = one(spark, F.transform(sequences.windows(F.col("a"), 3), lambda w: F.array_join(w, " ")), a=["s0", "s1", "s2", "s3"])
    assert got == ["s0", "s0 s1", "s0 s1 s2", "s1 s2 s3", "s2 s3", "s3"]
    assert one(spark, F.size(sequences.windows(F.filter(F.col("a"), lambda x: x == "z"), 3)), a=["q"]) == 0


def test_dates(spark):
    for raw, want in (("21-6-2020", "06/21/2020"), ("1-6-20", "06/01/2020"), ("3-4-27", "04/03/1927"), ("5-5-5", "05/05/2005"), ("soon", "01/01/2022")):
        assert one(spark, dates.claim_date(F.col("t")), t=raw) == want
    assert spark.range(1).select(dates.claim_date(F.lit(None).cast("string")).alias("x")).first().x == "01/01/2022"


def test_judge_outputs(spark):
    assert one(spark, judge.need_citation(F.col("t")), t="Need Citation: [[No]] .. Need Citation: [[Yes]]") == 1
    assert one(spark, judge.support(F.col("t")), t="[[Partially supported]]") == 0.5
    assert one(spark, judge.relevance(F.col("t")), t="[[Irrelevant]]") == 0
    assert one(spark, judge.support(F.col("t")), t="none") is None
    assert one(spark, judge.f1(F.col("r"), F.col("p")), r=0.5, p=1.0) == pytest.approx(2 / 3)
    assert one(spark, judge.f1(F.col("r"), F.col("p")), r=0.0, p=0.0) == 0
    dist = spark.range(1).select(judge.verdict_distribution(F.create_map(F.lit("a"), F.lit(-0.1), F.lit("b"), F.lit(-3.0), F.lit("c"), F.lit(-2.5)), ("a", "b", "c")).alias("x")).first().x
    assert [round(x, 6) for x in dist] == [0.872797, 0.048024, 0.079178]
    assert spark.range(1).select(judge.verdict_distribution(F.create_map(F.lit("a"), F.lit(1.0)), ("q",)).alias("x")).first().x is None
    assert one(spark, judge.rps(F.lit(0), F.col("d")), d=[0.5, 0.3, 0.2]) == pytest.approx(0.145)


def test_urls(spark):
    assert one(spark, text.url_domain(F.col("u")), u="https://www.A.org:80/x") == "A.org:80"
    assert one(spark, text.url_domain(F.col("u")), u="example.com/y") == "example.com"
    assert one(spark, text.is_pdf(F.col("u")), u="http://x.org/A.PDF?q=1") is True


def test_even_split(spark):
    assert one(spark, sequences.split_evenly(F.col("n"), F.col("k")), n=10, k=3) == [4, 3, 3]


def test_ranges(spark):
    got = one(spark, markup.cited_ranges(F.col("t"), F.lit(11)), t="[0-1][2-3][5-5][7-6][9-12]")
    assert [(r.lo, r.hi) for r in got] == [(0, 3), (5, 5), (9, 10)]
    assert one(spark, F.size(markup.statements(F.col("t"), F.lit(3))), t="") == 0


def test_fusion_and_bm25(spark):
    rows = spark.createDataFrame([(1, 1, 3.0, 1.0), (1, 2, 2.0, 3.0), (1, 3, 1.0, 2.0)], "q int, i int, a double, b double")
    got = {r.i: round(r.rrf, 6) for r in ranking.reciprocal_rank_fusion(rows, ["q"], "a", "b", "i").collect()}
    assert got == {1: 0.032266, 2: 0.032522, 3: 0.032002}
    docs = spark.createDataFrame([(0, "the cat sat".split()), (1, "the dog sat on the mat".split()), (2, "birds fly".split())], "d int, terms array<string>")
    asked = spark.createDataFrame([(0, "cat sat cat".split())], "q int, terms array<string>")
    assert {r.d: round(r.score, 6) for r in ranking.bm25(asked, docs, "q", "d").collect()} == {0: 1.182233, 1: 0.049639}


def pack_plain(sizes, limit):
    out, open_, size = [], [], 0
    for i, n in enumerate(sizes):
        if open_ and size + n > limit:
            out.append(open_)
            open_, size = [], 0
        open_.append(i)
        size += n
    return out + ([open_] if open_ else [])


def test_packing(spark):
    rnd = random.Random(3)
    for sizes in ([100, 300, 250, 10, 595], [], [700], [rnd.randint(1, 300) for _ in range(40)]):
        df = spark.createDataFrame([([str(i) for i in range(len(sizes))], sizes)], "p array<string>, n array<long>")
        got = df.select(chunking.pack(F.col("p"), F.col("n"), 600).alias("x")).first().x
        assert [[int(i) for i in g] for g in got] == pack_plain(sizes, 600)


def test_chunks_cover_paragraphs_in_order(spark):
    rnd = random.Random(5)
    paragraphs = [" ".join(f"w{rnd.randint(0, 9)}." for _ in range(rnd.choice([3, 40, 90, 170]))) for _ in range(30)]
    df = spark.createDataFrame([(1, "\n".join(paragraphs)), (2, ""), (3, None)], "d int, text string")
    got = chunking.chunk_documents(df, "d", "text", 60, 80).orderBy("chunk_pos").collect()
    assert " ".join(r.chunk for r in got).split() == " ".join(paragraphs).split()
    assert all(r.n_tokens <= 80 for r in got) and {r.d for r in got} == {1}


def test_metrics(spark):
    df = spark.createDataFrame([(0, 0), (1, 2), (2, 2), (2, 1)], "t int, p int")
    assert metrics.quadratic_kappa(df, "t", "p").first().kappa == pytest.approx(0.636364, abs=1e-6)
    values = spark.createDataFrame([(1, 0.1), (1, 0.4), (1, 0.7)], "k int, v double")
    row = metrics.mean_sem(values, ["k"], "v").first()
    assert (row.mean, round(row.sem, 6)) == (pytest.approx(0.4), 0.141421)
    flat = spark.createDataFrame([(1, 1.0, 1.0), (1, 1.0, 2.0)], "k int, x double, y double")
    assert metrics.spearman(flat, ["k"], "x", "y").first().rho is None
    tied = spark.createDataFrame([(1, 1.0, 2.0), (1, 1.0, 3.0), (1, 4.0, 9.0), (1, 5.0, 9.0)], "k int, x double, y double")
    rx, ry = np.array([1.5, 1.5, 3, 4]), np.array([1, 2, 3.5, 3.5])
    assert metrics.spearman(tied, ["k"], "x", "y").first().rho == pytest.approx(np.corrcoef(rx, ry)[0, 1])


def test_window_means(spark):
    df = spark.createDataFrame([(1, i, float(i * i), 4) for i in range(6)], "k int, w long, score double, n int")
    got = [r.score for r in attribution.window_means(df, ["k"], "w", "score", 3, "n").orderBy("w").collect()]
    assert got == [pytest.approx(sum((i + j) ** 2 for j in range(3)) / 3) for i in range(4)]


def test_components_ignore_order(spark):
    rows = spark.createDataFrame([(1, i) for i in range(6)], "g int, i int")
    pairs = [(1, 4, 5), (1, 2, 4), (1, 0, 1)]
    for order in (pairs, pairs[::-1]):
        got = {r.i: r.component for r in dedup.group_components(rows, spark.createDataFrame(order, "g int, a int, b int"), ["g"], "i").collect()}
        assert got == {0: 0, 1: 0, 2: 2, 3: 3, 4: 2, 5: 2}


def test_similar_pairs_and_components_are_made_group_by_group(spark):
    """Vectors of a group meet as one matrix, without a join; null, ragged and empty ones, those without length and those at the limit as pair by pair."""
    rng = random.Random(8)
    odd = [None, [], [0.0, 0.0], [1.0], [None, 1.0], [3.0, 4.0], [4.0, 3.0], [30.0, 40.0]]
    rows = [(g, g * 100 + i, v) for g in range(3) for i, v in enumerate([*odd, *([rng.gauss(0, 1) for _ in range(3)] for _ in range(12))])]
    df = spark.createDataFrame(rows, "g int, i long, v array<double>").repartition(5)

    def near(v, w):
        if not v or not w or len(v) != len(w) or None in v or None in w:
            return False
        size = math.sqrt(sum(x * x for x in v)) * math.sqrt(sum(x * x for x in w))
        return size > 0 and sum(x * y for x, y in zip(v, w, strict=True)) / size >= 0.96

    want = {(g, i, j) for g, i, v in rows for h, j, w in rows if g == h and i < j and near(v, w)}
    pairs = dedup.similar_pairs(df, ["g"], "i", "v", 0.96)
    found = dedup.similar_components(df, ["g"], "i", "v", 0.96)
    assert all("Join" not in t._jdf.queryExecution().executedPlan().toString() for t in (pairs, found))
    assert {tuple(r) for r in pairs.collect()} == want and all((g, g * 100 + 5, g * 100 + 6) in want for g in range(3))
    links = spark.createDataFrame(sorted(want), "g int, a long, b long")
    assert {tuple(r) for r in found.collect()} == {tuple(r) for r in dedup.group_components(df, links, ["g"], "i").collect()}


@pytest.mark.parametrize("spread", [1, 3, 5])
def test_facts_are_pooled_block_by_block(spark, spread):
    """Means over windows that cross a block's edge, statements without facts and sources without words; no pair is shuffled."""
    rng = random.Random(spread)
    words = lambda n: rng.sample("abcdefgh", n)
    sizes = {1: (3, 2), 2: (attribution.LEFT + 3, attribution.RIGHT + 1), 3: (1, 2 * attribution.RIGHT), 4: (2, 1)}
    facts = {(k, i): [words(rng.randrange(4)) for _ in range(rng.randrange(3))] for k, (n, _) in sizes.items() for i in range(n)}
    held = {(k, j): words(rng.randrange(5)) for k, (_, n) in sizes.items() for j in range(n + spread - 1)}
    left = spark.createDataFrame([(*k, v) for k, v in facts.items()], "g int, i long, fs array<array<string>>")
    right = spark.createDataFrame([(*k, v) for k, v in held.items()], "g int, j long, t array<string>").repartition(3)
    share = lambda f, t: len(set(f) & set(t)) / len(set(f)) if f else 0.0
    want = {(k, i, j): max([sum(share(f, held[k, j + x]) for x in range(spread)) / spread for f in facts[k, i]], default=0.0) for k, (n, m) in sizes.items() for i in range(n) for j in range(m)}
    found = attribution.fact_grid(left, right, "g", "i", "j", "fs", "t", spread)
    rows = found.collect()
    assert len(rows) == len(want) and {(r.g, r.i, r.j): pytest.approx(r.score) for r in rows} == want
    assert "hashpartitioning(g" in (plan := found._jdf.queryExecution().executedPlan().toString()) and "hashpartitioning(g#0, i" not in plan


def test_embedding_takes_a_bounded_number_of_texts():
    """Rows of an Arrow batch are embedded a few at a time; null lists count as none."""
    sizes = [(3, 3), (0, 0), (40, 9), (1, None), (2, 2), (None, None), (5, 4)]
    texts = lambda n: None if n is None else ["x"] * n
    batch = pa.RecordBatch.from_pydict({"k": list(range(len(sizes))), "a": [texts(a) for a, _ in sizes], "b": [texts(b) for _, b in sizes]}, pa.schema([("k", pa.int64()), ("a", pa.list_(pa.string())), ("b", pa.list_(pa.string()))]))
    got = [b.column("k").to_pylist() for b in attribution.by_texts([batch], ["a", "b"], 10)]
    assert sum(got, []) == list(range(len(sizes))) and len(got) > 2
    assert all(sum((a or 0) + (b or 0) for a, b in (sizes[k] for k in ks[1:])) <= 10 for ks in got)


def test_greedy_and_surrogate(spark):
    df = spark.createDataFrame([(1, 0, "a b", "a b c d"), (1, 1, "c", "a b c d"), (1, 2, "z", "a b c d")], "k int, source_idx int, source string, hypothesis string")
    got = {r.source_idx: (r.score, r.step, r.cited) for r in attribution.greedy_selection(df, ["k"]).collect()}
    assert got == {0: (0.5, 1, True), 1: (0.25, 2, True), 2: (0.0, 3, False)}
    rnd = np.random.default_rng(1)
    x = rnd.integers(0, 2, (64, 4)).astype(bool)
    rows = [(1, [bool(b) for b in m], float(m @ np.array([1.0, 0, -2, 0]))) for m in x]
    fitted = {r.source_idx: r.score for r in attribution.sparse_surrogate(spark.createDataFrame(rows, "k int, mask array<boolean>, value double"), ["k"], 0.001).collect()}
    assert fitted[0] == pytest.approx(1, abs=0.05) and fitted[2] == pytest.approx(-2, abs=0.05) and fitted[1] == pytest.approx(0, abs=0.02)


def test_surrogates_of_many_statements_are_fitted_as_one_matrix():
    """Statements of one size share a matrix; each gets what it gets alone, and empty ones nothing."""
    lists = pa.array([[0.5, 0.25], [], [1.0], None, [0.75, 0.0]])
    assert [(list(r), x.tolist()) for r, x in attribution.by_size(lists)] == [([2], [[1.0]]), ([0, 4], [[0.5, 0.25], [0.75, 0.0]])]
    kept, scores = faithfulness.keeps(32, 2), np.array([[0.5, 0.25], [0.75, 0.0]])
    lp = faithfulness.measured(scores, kept)[1]
    both = attribution.sparse_fit(kept[None, 1:], lp[:, 1:], 32)
    for k in range(2):
        own = attribution.sparse_fit(np.stack([kept[1:]]), lp[k : k + 1, 1:], 32)
        assert np.allclose(both[k], own[0])
    assert np.allclose(attribution.sparse_fit(np.stack([kept[1:]] * 2), lp[:, 1:], 32), both) and both[0, 0] > 0


def test_embedded_pairs_embed_each_text_once(spark, tmp_path):
    """Every text goes through the scorer once, however many texts it is paired with; empty ones give no pairs."""
    log = tmp_path / "calls"

    def make():
        embed = scorers.hash_embedding(8)

        def call(rows):
            with open(log, "a") as f:
                f.write("x\n" * len(rows))
            return embed(rows)

        return call

    df = spark.createDataFrame([(7, ["a b", "", "c"], ["b a", "c"]), (8, ["a"], [])], "conv_id long, statements array<string>, sources array<string>").coalesce(1)
    got = {(r.conv_id, r.sent_idx, r.source_idx): round(r.score, 9) for r in attribution.embedded_pairs(df, make).collect()}
    assert set(got) == {(7, 0, 0), (7, 0, 1), (7, 2, 0), (7, 2, 1)} and got[7, 0, 0] == got[7, 2, 1] == 1.0
    assert log.read_text().count("x") == 6


def test_bm25_shuffles_no_pairs_and_counts_words_without_weight(spark):
    """Scores come out where documents are read; a word in half of all texts weighs nothing and is a common word all the same."""
    docs = spark.createDataFrame([(1, ["a", "b"]), (2, ["a"]), (3, ["c"]), (4, ["d", "d"]), (5, []), (6, ["b"])], "d long, terms array<string>")
    asked = spark.createDataFrame([(10, ["a"]), (11, ["d", "zz"]), (12, [])], "q long, terms array<string>")
    halves = docs.filter("d in (1, 2, 3, 4)")
    rows = ranking.bm25(asked, halves, "q", "d")
    assert "Exchange" not in rows._jdf.queryExecution().executedPlan().toString().replace("BroadcastExchange", "")
    got = {(r.q, r.d): r.score for r in rows.collect()}
    assert set(got) == {(10, 1), (10, 2), (11, 4)} and got[10, 1] == 0.0 and got[11, 4] > 0
    best = ranking.bm25(spark.createDataFrame([(10, ["a", "b"])], "q long, terms array<string>"), docs.coalesce(1), "q", "d", best=1).collect()  # of each batch
    assert [r.d for r in best] == [1]


def test_fused_ranks_are_those_of_all_pairs(spark):
    """Ranks, ties and fusion over several batches a query; null scores and chunks without text go last; the own chunk is left out."""
    rng = random.Random(3)
    rows = [(i * 3, [float(rng.randrange(-2, 3)) for _ in range(3)], [rng.choice("abcd") for _ in range(rng.randrange(4))] if i % 4 else None) for i in range(40)]
    chunks = spark.createDataFrame(rows, "c long, v array<double>, terms array<string>").repartition(5)
    asked = chunks.filter("c % 30 = 0").withColumnRenamed("c", "q")
    texts = chunks.filter("terms IS NOT NULL")
    weights = ranking.query_weights(texts.filter("c % 30 = 0").withColumnRenamed("c", "q"), texts, "q")
    got = ranking.fused_ranks(asked.select("q", "v"), chunks, weights, "q", "c", "v", "terms")
    sparse = {(r.q, r.c): r.score for r in ranking.bm25(texts.filter("c % 30 = 0").withColumnRenamed("c", "q"), texts, "q", "c").collect()}

    def dense(a, b):
        size = math.sqrt(sum(x * x for x in a)) * math.sqrt(sum(x * x for x in b))
        return round(sum(x * y for x, y in zip(a, b, strict=True)) / size, 6) if size else -9.0

    want = {}
    for q, v, _ in rows:
        if q % 30 == 0:
            others = [(c, dense(v, w), round(sparse.get((q, c), 0.0), 6)) for c, w, _ in rows if c != q]
            for k in (1, 2):
                for place, x in enumerate(sorted(others, key=lambda o: (o[k], o[0]), reverse=True), 1):
                    want.setdefault((q, x[0]), []).append(place)
    assert {(r.q, r.c): [r.rank_1, r.rank_2] for r in got.collect()} == want
    best = ranking.fused_ranks(asked.select("q", "v"), chunks, weights, "q", "c", "v", "terms", 5).collect()
    assert len(best) == 5 * 4 and sorted({r.rk for r in best}) == [1, 2, 3, 4, 5]


def test_the_best_of_fused_ranks_are_counted_without_shuffling_pairs(spark):
    """Leaders of a few chunks a task and a count for their ranks give the places that ranks of all pairs give, with ties in both scores."""
    rng = random.Random(4)
    rows = [(i * 10, [float(rng.randrange(-3, 4)) for _ in range(3)], [rng.choice("abcdefgh") for _ in range(rng.randrange(5))] if i % 5 else None) for i in range(400)]
    chunks = spark.createDataFrame(rows, "c long, v array<double>, terms array<string>").repartition(3)
    asked, texts = chunks.filter("c % 400 = 0").withColumnRenamed("c", "q"), chunks.filter("terms IS NOT NULL")
    weights = ranking.query_weights(texts.filter("c % 400 = 0").withColumnRenamed("c", "q"), texts, "q")
    whole = ranking.fused_ranks(asked.select("q", "v"), chunks, weights, "q", "c", "v", "terms").collect()
    for best in (1, 4, 30):
        found = ranking.fused_ranks(asked.select("q", "v"), chunks, weights, "q", "c", "v", "terms", best)
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "first" in plan and "held" not in plan
        want = set()
        for q in {r.q for r in whole}:
            own = sorted((r for r in whole if r.q == q), key=lambda r: (round(r.rrf, 9), r.c), reverse=True)[:best]
            want |= {(q, r.c, r.rank_1, r.rank_2, place) for place, r in enumerate(own, 1)}
        assert {(r.q, r.c, r.rank_1, r.rank_2, r.rk) for r in found.collect()} == want


def test_numbers_come_back_from_their_planes():
    for kind in (np.int32, np.int64):
        for x in (np.array([], kind), np.array([0, -1, 5, np.iinfo(kind).min, np.iinfo(kind).max], kind), np.arange(3000, dtype=kind)[::3]):
            assert ranking.unplaned(ranking.planes(x), kind).tolist() == x.tolist()
    x = np.arange(4096, dtype=np.int64)
    assert len(pa.compress(ranking.planes(x), "zstd", asbytes=True)) * 20 < x.nbytes


def test_leaders_are_the_best_whatever_the_order():
    rng = np.random.default_rng(2)
    board, ids = ranking.Leaders(3, 7, 1), rng.permutation(500)
    board.size = 1 << 20  # cut at the first rows already
    score = rng.integers(0, 40, (2, 3, 500))
    for k in range(0, 500, 50):
        part = slice(k, k + 50)
        board.add(ids[part], (score[0][:, part], score[1][:, part]), ids[part] != np.array([[4], [5], [6]]))
    q, found, *_ = board.cut()
    for i in range(3):
        want = sorted((s, j) for s, j in zip(score[1][i], ids, strict=True) if j != i + 4)[-7:]
        assert sorted(found[q == i]) == sorted(j for _, j in want)


def test_whole_texts_go_to_python_in_small_batches(spark):
    from claimspark.plans.bindings import BATCH, table
    from tests.compare import DATA

    held = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(held)
    try:
        for given, kept in (("10000", str(BATCH)), ("0", str(BATCH)), ("7", "7")):
            spark.conf.set(held, given)
            table(spark, DATA, "pages")
            assert spark.conf.get(held) == kept
        spark.conf.set(held, "10000")
        sizes = table(spark, DATA, "documents").crossJoin(spark.range(10)).coalesce(1).select("doc_id").mapInArrow(lambda bs: (b.slice(0, 1).set_column(0, "doc_id", pa.array([b.num_rows])) for b in bs), "doc_id long")
        assert max(r.doc_id for r in sizes.collect()) <= BATCH
    finally:
        spark.conf.set(held, before)


def test_conversations_go_to_python_in_bounded_batches(spark):
    """Blocks of an instance's texts are no rows of a few bytes."""
    from claimspark.plans.bindings import BLOCKS, table
    from tests.compare import DATA

    held = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(held)
    try:
        for given, kept in (("10000", str(BLOCKS)), ("0", str(BLOCKS)), ("500", "500")):
            spark.conf.set(held, given)
            table(spark, DATA, "conversations")
            assert spark.conf.get(held) == kept
    finally:
        spark.conf.set(held, before)


def test_rank_correlation_of_rows():
    x = np.array([[1.0, 2.0, 2.0, 3.0], [1.0, 1.0, 1.0, 1.0]])
    assert metrics.place_of(x).tolist() == [[1.0, 2.5, 2.5, 4.0], [2.5] * 4]
    rho = metrics.rank_correlation(x, -x)
    assert rho[0] == pytest.approx(-1) and np.isnan(rho[1])


def test_sentence_index_extraction(spark):
    assert one(spark, judge.sentence_indices(F.col("t"), 2, F.lit(5)), t="[3] [3] [1] [2]<eos>") == [3, 1]
    assert one(spark, judge.sentence_indices(F.col("t"), 2, F.lit(5)), t="[3] [9]<eos>") is None
    assert one(spark, judge.sentence_indices(F.col("t"), 2, F.lit(5)), t="[3] [1]") is None


def test_page_text():
    assert pages.main_text("<nav>x</nav><p>a <b>b</b></p><script>1</script><p>c &amp; d") == "a b\nc & d"
    assert pages.main_text(None) == ""


def test_page_text_references_end_with_a_semicolon():
    assert pages.main_text("<p>a&amp;&amp;&amp</p><p>x &lt y &notit; &eacute;&#33; &</p>") == "a&&&amp\nx &lt y &notit; \u00e9! &"


def test_results_and_checkpoints(spark, tmp_path):
    path = tmp_path / "r.json"
    path.write_text('{"metadata": {"dataset": "d", "model": "m"}, "results": [{"instance_idx": 3, "methods": {"a": {"attr_scores": [[0.5, 1.0], []]}, "b": {"attr_scores": [{"1": [1.0]}, null]}}}]}')
    doc = results.read_document(spark, str(path))
    assert [(r.method, r.sent_idx, r.source_idx, r.score) for r in results.score_vectors(doc).orderBy("source_idx").collect()] == [("a", 0, 0, 0.5), ("a", 0, 1, 1.0)]
    assert [(r.method, r.k, r.score) for r in results.score_vectors_by_k(doc).collect()] == [("b", "1", 1.0)]
    log = f"file://{tmp_path}/log"
    assert results.read_checkpoint(spark, log, "idx int, x string").count() == 0
    results.append_checkpoint(spark.createDataFrame([(1, "a")], "idx int, x string"), log)
    done = results.read_checkpoint(spark, log, "idx int, x string")
    items = spark.createDataFrame([(1,), (2,)], "idx int")
    assert [r.idx for r in dedup.unfinished(items, done, ["idx"]).collect()] == [2]


def test_resume_stream(spark, tmp_path):
    source, out, check = (f"file://{tmp_path}/{x}" for x in ("in", "out", "check"))
    spark.createDataFrame([(1, "a"), (1, "a")], "id int, x string").write.parquet(source)
    run = lambda: resume.process_new(spark, source, "id int, x string", out, check, lambda df: df.withColumn("n", F.length("x")), "id")
    run()
    spark.createDataFrame([(2, "bb")], "id int, x string").write.mode("append").parquet(source)
    run()
    run()
    assert sorted((r.id, r.n) for r in spark.read.parquet(out).collect()) == [(1, 1), (2, 2)]


def test_scorers(spark):
    calls = []

    def flaky(rows):
        calls.append(1)
        if len(calls) < 3:
            raise OSError
        return [len(r[0]) for r in rows]

    assert scorers.with_retries(flaky, wait=0.0)([("ab",)]) == [2]
    v = scorers.hash_embedding(8)([("a b",), ("",)])
    assert math.isclose(sum(x * x for x in v[0]), 1) and not any(v[1])
    df = spark.createDataFrame([("a b", "a"), ("", "a"), (None, "")], "p string, h string")
    assert [r.x for r in df.select(scorers.score_column(lambda: scorers.lexical_entailment, "double", F.col("p"), F.col("h")).alias("x")).collect()] == [1.0, 0.0, 0.0]
