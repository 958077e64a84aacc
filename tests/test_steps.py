"""Retrieval in blocks, scorers, fact-level attribution, presentation and reports: brute force, hand-computed cases, edges."""

import itertools
import random
import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from claimspark.functions import judge
from claimspark.operators import attribution, chunking, citations, dedup, metrics, presentation, ranking
from claimspark.sources import results, scorers


def test_dense_scores_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(ranking, "QUERY_BLOCK", 3)
    monkeypatch.setattr(ranking, "CHUNK_BLOCK", 7)
    rng = np.random.default_rng(3)
    q, c = {i: rng.normal(size=8) for i in range(10)}, {i: rng.normal(size=8) for i in range(40)}
    c[40] = np.zeros(8)
    left = spark.createDataFrame([(i, v.tolist()) for i, v in q.items()], "q long, v array<double>")
    right = spark.createDataFrame([(i, f"l{i % 3}", v.tolist()) for i, v in c.items()], "c long, label string, w array<double>")
    got = {(r.q, r.c): (r.label, r.score) for r in ranking.dense_scores(left, right, "q", "c", "v", "w", ("label",)).collect()}
    assert len(got) == 10 * 41
    for (i, a), (j, b) in itertools.product(q.items(), c.items()):
        label, score = got[i, j]
        assert label == f"l{j % 3}"
        assert score is None if j == 40 else score == pytest.approx(a @ b / np.linalg.norm(a) / np.linalg.norm(b))
    assert ranking.dense_scores(left.limit(0), right, "q", "c", "v", "w").count() == 0


def test_bm25_by_hand(spark):
    docs = spark.createDataFrame([(0, "the cat sat".split()), (1, "the dog sat on the mat".split()), (2, "birds fly".split())], "d long, terms array<string>")
    asked = spark.createDataFrame([(9, "cat sat cat".split())], "q long, terms array<string>")
    got = {r.d: round(r.score, 6) for r in ranking.bm25(asked, docs, "q", "d").collect()}
    assert got == {0: 1.182233, 1: 0.049639}


def test_search_with_fallback(spark):
    rows = [(1, True, 0, "a"), (1, True, 1, "b"), (1, False, 0, "c"), (2, True, 0, "d"), (2, True, 2, "e"), (2, False, 0, "f"), (3, False, 1, "g"), (4, True, 1, "h")]
    df = spark.createDataFrame(rows, "claim int, restricted boolean, try int, x string")
    keep = lambda n: {r.x for r in dedup.search_with_fallback(df, "claim", "restricted", "try", n).collect()}
    assert keep(2) == {"a", "b", "d", "f", "g"}  # claim 2 ends at its empty try 1, claim 4 at its empty try 0
    assert keep(3) == {"a", "b", "c", "d", "f", "g"}


def test_scorers(spark):
    df = spark.createDataFrame([(1, "a b a"), (2, ""), (3, None)], "i int, t string")
    one = {r.i: r.v for r in df.select("i", scorers.score_column(scorers.hash_embedding, "array<double>", F.col("t")).alias("v")).collect()}
    want = scorers.hash_embedding()([("a b a",)])[0]
    assert one[1] == pytest.approx(want) and sum(x * x for x in one[1]) == pytest.approx(1) and not any(one[2]) and not any(one[3])
    calls = []

    def flaky(rows):
        calls.append(1)
        if len(calls) < 3:
            raise OSError("again")
        return [1.0 for _ in rows]

    assert scorers.with_retries(flaky, wait=0)([(1,)]) == [1.0] and len(calls) == 3
    with pytest.raises(OSError):
        calls.clear()
        scorers.with_retries(flaky, tries=2, wait=0)([(1,)])
    with pytest.raises(KeyError, match="lexical"):
        scorers.registered("entail", "none")
    used = df.filter("i = 1").select(scorers.score_column(scorers.registered("judge", "lexical_usage"), "struct<text:string,prompt_tokens:bigint,completion_tokens:bigint>", F.col("t"), F.col("t")).alias("u")).first().u
    assert (used.text, used.prompt_tokens, used.completion_tokens) == ("Rating: [[Fully supported]]", 6, 3)
    assert df.filter("i = 2").select(scorers.score_column(scorers.registered("logprobs", "verdict"), "map<string,double>", F.col("t")).alias("m")).first().m is None


def test_paged_search(spark):
    def provider():
        def search(query, page):
            return [{"pos": page * 2 + k, "link": f"{query}/{page}/{k}", "title": None, "date": None} for k in range(2)] if page < len(query) else []

        return search

    df = spark.createDataFrame([("a",), ("bbbbb",), ("",)], "query string")
    got = sorted(r.link for r in scorers.paged_search(df, provider, pages=3).collect())
    assert got == ["a/0/0", "a/0/1", *[f"bbbbb/{p}/{k}" for p in range(3) for k in range(2)]]


def test_greedy_sets_against_search(spark):
    rnd = random.Random(4)
    words = "a b c d e f g".split()
    rows = [(i, " ".join(rnd.sample(words, 4)), [" ".join(rnd.sample(words, 2)) for _ in range(rnd.randrange(1, 8))]) for i in range(20)]
    df = spark.createDataFrame(rows, "k int, hypothesis string, xs array<string>")
    got = {}
    for r in attribution.greedy_sets(df, ["k"]).collect():
        got.setdefault(r.k, {})[r.step] = (r.source_idx, r.score, r.cited)
    for k, h, xs in rows:
        want, chosen, last, open_ = set(h.split()), [], 0.0, True
        for step in range(1, min(5, len(xs)) + 1):
            share = lambda i: len(want & set(" ".join(xs[j] for j in [*chosen, i]).split())) / len(want)  # noqa: B023, E731
            best = max((i for i in range(len(xs)) if i not in chosen), key=lambda i: (share(i), -i))  # noqa: B023
            open_ = open_ and round(share(best) - last, 9) >= 0.1
            assert got[k][step][0] == best and got[k][step][1] == pytest.approx(share(best) - last) and got[k][step][2] == open_
            last = share(best)
            chosen.append(best)
        assert len(got[k]) == min(5, len(xs))


def test_lazy_greedy_equals_plain(spark):
    """Same steps, scores and marks with ties, repeated and empty sources, and budgets below and above five."""
    rnd = random.Random(9)
    rows = []
    for i in range(60):
        words = [f"w{j}" for j in range(rnd.choice((3, 12, 80)))]
        xs = [" ".join(rnd.choices([*words, "other"], k=rnd.randrange(5))) for _ in range(rnd.randrange(14))]
        rows.append((i, " ".join(rnd.sample(words, rnd.randrange(len(words) + 1))), xs, rnd.choice((None, 2, 7, 50))))
    df = spark.createDataFrame(rows, "k int, hypothesis string, xs array<string>, b int")
    got = {(r.k, r.step): (r.source_idx, pytest.approx(r.score), r.cited) for r in attribution.covering_sets(df, ["k"], F.col("b")).collect()}
    want = {}
    for b in (None, 2, 7, 50):
        part = df.filter(F.col("b").eqNullSafe(F.lit(b).cast("int")))
        want |= {(r.k, r.step): (r.source_idx, r.score, r.cited) for r in attribution.greedy_sets(part, ["k"], least=b or 5).collect()}
    assert want and got.keys() == want.keys() and all(got[key] == want[key] for key in want)


def test_evidence_context(spark):
    xs = [(f"s{i}", "\n\n" if i == 2 else " ") for i in range(6)]
    df = spark.createDataFrame([(xs,)], "xs array<struct<s:string,sep:string>>")
    shown = lambda ids, extra: df.select(citations.evidence_context(F.array(*map(F.lit, ids)), F.col("xs"), F.lit(extra)).alias("x")).first().x
    assert shown([3, 1, 2], False) == "s3\n\ns1 s2"  # neighbours in list order only
    assert shown([4], True) == "s3 s4 "  # s2 belongs to the paragraph before, and the last source never follows
    assert shown([1], True) == "s0 s1 s2"
    assert shown([1, 2], True) == "s0 s1 s2 s3 s4"
    assert shown([5], True) == "s3 s4 s5 "


def test_verification_report(spark):
    rows = [("m", 0, 0, False, [0.5, 0.3, 0.2]), ("m", 1, 3, True, [0.1, 0.2, 0.7]), ("m", 3, 2, False, [0.1, 0.2, 0.7]), ("m", 2, None, None, None)]
    df = spark.createDataFrame(rows, "k string, t int, p int, ab boolean, x array<double>")
    r = metrics.verification_report(df, ["k"]).first()
    assert (r.n, r.invalid, r.abstained, r.unanswerable, r.either) == (3, 1, 1, 1, 2)
    assert r.accuracy == pytest.approx(1 / 3) and r.macro_f1 == pytest.approx(0.25) and r.mse == 0 and r.mean_rps == pytest.approx(0.145)
    assert (r.macro_precision, r.macro_recall, r.weighted_precision, r.weighted_recall, r.weighted_f1) == tuple(map(pytest.approx, (0.25, 0.25, 1 / 3, 1 / 3, 1 / 3)))
    assert r.kappa is None  # one class alone
    assert metrics.verification_report(df.limit(0), ["k"]).count() == 0
    report = {x.cls: tuple(x)[2:] for x in metrics.class_report(df, ["k"]).collect()}
    assert report == {0: (1.0, 1.0, 1.0, 1), 1: (0.0, 0.0, 0.0, 1), 2: (0.0, 0.0, 0.0, 0), 3: (0.0, 0.0, 0.0, 1)}


def test_kappa_of_groups(spark):
    """As the table-wide operator has it, where classes are missing too."""
    rnd = random.Random(2)
    groups = {"all": (0, 1, 2), "gap": (0, 2), "low": (0, 1)}
    rows = [(g, rnd.choice(cs), rnd.choice(cs), False, [1.0, 0.0, 0.0]) for g, cs in groups.items() for _ in range(25)]
    df = spark.createDataFrame(rows, "k string, t int, p int, ab boolean, x array<double>")
    got = {r.k: r.kappa for r in metrics.verification_report(df, ["k"]).collect()}
    assert got == {g: pytest.approx(metrics.quadratic_kappa(df.filter(F.col("k") == g), "t", "p").first().kappa) for g in groups}


def test_macro_scores_make_no_product_of_partitions(spark):
    """Datasets meet the names in them where they are; citations are read once."""
    from claimspark.plans import quality

    from .compare import DATA

    plan = quality.macro(spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_citation_quality_reads_citations_once(spark):
    said = spark.createDataFrame([(1, 0, 0.5, 1.0), (1, 1, 1.0, 1.0), (1, 2, 0.0, 0.0), (2, 0, 1.0, 1.0)], "u long, s long, support double, need double")
    cited = spark.createDataFrame([(1, 0, 1.0), (1, 0, 0.0), (1, 1, 1.0), (1, 9, None), (3, 0, 1.0), (None, 0, 1.0)], "u long, s long, relevance double")
    found = metrics.citation_quality(said, cited, "u", "s")
    got = {r.u: (r.recall, r.precision, r.f1) for r in found.collect()}
    assert got == {1: (pytest.approx(2.5 / 3), pytest.approx(2 / 3), pytest.approx(20 / 27)), 2: (0.0, 0.0, 0.0)}
    leaves = found._jdf.queryExecution().optimizedPlan().collectLeaves()
    assert leaves.size() == 2


def test_overlap_grid_in_blocks(spark, monkeypatch):
    """As pair by pair, across the edges of blocks; no pair of token arrays is made in the JVM."""
    from claimspark.functions import text

    monkeypatch.setattr(attribution, "LEFT", 2)
    monkeypatch.setattr(attribution, "RIGHT", 3)
    rnd = random.Random(4)
    say = lambda: " ".join(rnd.choices("a b c d e f".split(), k=rnd.randrange(5)))
    left = spark.createDataFrame([(c, i, say()) for c in range(4) for i in range(c * 2 + 1)], "c long, i long, s string")
    right = spark.createDataFrame([(c, j, say()) for c in range(1, 5) for j in range(c * 3)], "c long, j long, s string")
    found = attribution.overlap_grid(left, right, "c", "i", "j", "s")
    want = left.join(right.withColumnRenamed("s", "t"), "c").select("c", "i", "j", text.overlap(text.tokens(F.col("s")), text.tokens(F.col("t"))).alias("score"))
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, want.collect()))
    assert "array_intersect" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_scores_of_many_k_share_their_row(spark):
    seen = spark.sparkContext.accumulator(0)

    def make():
        def call(rows):
            for before, after in itertools.pairwise(rows):
                seen.add(int(before[0] is after[0]))
            return [len(xs) * k for xs, k in rows]

        return call

    df = spark.createDataFrame([(["a", "b"], [1, 2, 3]), (None, None), (["c"], []), (["d"], [5])], "xs array<string>, ks array<int>").coalesce(1)
    got = [r.x for r in df.select(scorers.score_each(make, "int", F.col("ks"), F.col("xs")).alias("x")).collect()]
    assert got == [[2, 4, 6], [], [], [5]] and seen.value == 2


def test_page_words(spark):
    lines = [(0, 0, "Short title here"), (0, 12, "first line of"), (0, 24, "a paragraph"), (0, 60, "7"), (0, 72, "second one goes"), (1, 0, "on after the page."), (2, 0, "A new one begins")]
    rows = [("d", page, n * 100 + k, w, float(top)) for n, (page, top, line) in enumerate(lines) for k, w in enumerate(line.split())]
    df = spark.createDataFrame(rows, "doc string, page int, seq int, w string, top double")
    got = chunking.page_words_to_text(df, "doc", "page", "seq", "w", "top").first().content
    # spacings 12, 12, 36, 12: the line "7" is noise and takes its wide gap with it, so that no paragraph begins there
    assert got == "Short title here first line of a paragraph second one goes on after the page.\n\nA new one begins"
    assert chunking.page_words_to_text(df.limit(0), "doc", "page", "seq", "w", "top").count() == 0


def test_pages_to_text_without_a_shuffle(spark):
    """As from rows of words, with lines that recur over pages, noise, pages whose lines all go and pages without words."""
    rnd = random.Random(5)
    docs = []
    for d in range(30):
        pages = []
        for _ in range(rnd.randrange(7)):
            top, ws = 0.0, []
            for _ in range(rnd.randrange(6)):
                top += rnd.choice((10.0, 10.0, 12.0, 40.0))
                ws += [(w, top + rnd.choice((0.0, 1.0))) for w in rnd.choice(("a footer that recurs", "17", "--", "ends here.", "goes on and", "", "x", "one more")).split()]
            pages.append(ws)
        docs.append((d, pages))
    df = spark.createDataFrame(docs, "doc long, pages array<array<struct<word:string,top:double>>>")
    found = chunking.pages_to_text(df, "doc", F.col("pages"))
    rows = [(d, p, i, w, t) for d, pages in docs for p, ws in enumerate(pages) for i, (w, t) in enumerate(ws)]
    from_words = chunking.page_words_to_text(spark.createDataFrame(rows, "doc long, page int, seq int, w string, top double"), "doc", "page", "seq", "w", "top")

    def plain(pages):
        lined = []
        for ws in filter(None, pages):
            page = []
            for k, (w, t) in enumerate(ws):
                if k == 0 or abs(t - ws[k - 1][1]) >= 3:
                    page.append([w, t])
                else:
                    page[-1][0] += f" {w}"
            lined.append(page)
        every = [x for page in lined for x, _ in page]
        out = []
        for page in lined:
            gaps = [b[1] - a[1] for a, b in itertools.pairwise(page)]
            limit = 1.5 * sorted(gaps)[len(gaps) // 2] if gaps else 20
            paras = [[]]
            for k, (x, t) in enumerate(page):
                if x.isdigit() or (len(x) <= 5 and not any(map(str.isalpha, x))) or (len(x) >= 10 and every.count(x) >= 5):
                    continue
                if k and t - page[k - 1][1] > limit:
                    paras.append([])
                paras[-1].append(x)
            for k, para in enumerate(map(" ".join, paras)):
                if k == 0 and out and (not out[-1].strip(" ") or out[-1].strip(" ")[-1] not in ".!?:"):
                    out[-1] += f" {para}"
                else:
                    out.append(para)
        return "\n\n".join(re.sub(" +", " ", p) for p in out if len(p) > 5)

    want = {d: plain(pages) for d, pages in docs if plain(pages)}
    assert {r.doc: r.content for r in found.collect()} == want == {r.doc: r.content for r in from_words.collect()}
    assert any("recurs" in t for t in want.values()) and "Exchange" not in found._jdf.queryExecution().executedPlan().toString()


def test_presentation(spark):
    assert spark.range(1).select(presentation.method_of(F.lit("x/surrogate_32_scores"))["label"].alias("x")).first().x == "surrogate, 32 ablations"
    assert spark.range(1).select(presentation.method_of(F.lit("x/none"))["method"].alias("x")).first().x is None
    means = spark.createDataFrame([("direct", 1.0), ("surrogate_256", 2.0), ("surrogate_32", 3.0)], "name string, mean double")
    assert [(r.name, r.display) for r in presentation.in_display_order(means, "name", ("surrogate_32",)).orderBy("display").collect()] == [("direct", 1), ("surrogate_256", 2)]
    st = spark.createDataFrame([([("a<b", 1.0, [("c&d", [2, 3], None, 1)]), ("plain", 0.0, [])],)], "st array<struct<statement:string,support_score:double,citation:array<struct<cite:string,span:array<int>,score:double,relevant_score:int>>>>")
    html = st.select(presentation.answer_html(F.col("st")).alias("a"), presentation.evidence_html(F.col("st")).alias("e")).first()
    assert "a&lt;b</span> <span style='color: #1b8d36;'>[2-3]</span>" in html.a and html.a.endswith("plain</span> \n\n")
    assert "Score: -" in html.e and "c&amp;d" in html.e and "Statement 2" not in html.e


def test_merge_by_position(spark):
    left = spark.createDataFrame([(0, 5, "a"), (1, 6, "a"), (2, 7, None)], "pos int, idx int, dataset string")
    right = spark.createDataFrame([(0, 5, "a", "x"), (1, 9, "a", "y"), (2, 7, None, "z"), (3, 8, "a", "w")], "pos int, idx int, dataset string, label string")
    got = {r.pos: (r.same_idx, r.same_dataset, r.label) for r in dedup.merge_by_position(left, right, "pos", ["idx", "dataset"], "label").collect()}
    assert got == {0: (True, True, "x"), 1: (False, True, None), 2: (True, True, "z")}


def test_ranges_and_partitions(spark):
    items = spark.range(10).withColumnRenamed("id", "pos")
    assert [r.pos for r in dedup.position_range(items, "pos", 3, 5).collect()] == [3, 4] and dedup.position_range(items, "pos", 8).count() == 2
    pages = spark.createDataFrame([(1, i, "e" if i == 0 else None) for i in range(5)], "claim int, pos int, error string")
    good, bad = dedup.success_failure(pages, "claim", "error", "pos", 2)
    assert [r.pos for r in good.orderBy("pos").collect()] == [1, 2] and [r.pos for r in bad.collect()] == [0]


def test_labels_outside_the_list(spark):
    assert spark.range(1).select(judge.one_hot(F.lit("other"), ("a", "b")).alias("x")).first().x is None
    assert pd.Series(scorers.label_writer(("a", "b"))()([("one two",), ("one",)])).tolist() == ["a", "b"]


def test_datasets(spark, tmp_path):
    from .compare import DATA

    rows = lambda **more: [(r.instance_idx, r.context) for r in results.load_dataset(spark, DATA, "summaries", **more).orderBy("instance_idx").collect()]
    whole = rows()
    assert [i for i, _ in whole] == list(range(200)) and rows(n_samples=5, start=3) == whole[3:8] and rows(seed=1) != whole
    assert 0 < results.load_dataset(spark, DATA, "stances").count() < 200
    with pytest.raises(KeyError, match="chats"):
        results.load_dataset(spark, DATA, "none")
    results.write_ordered(spark.range(50).orderBy(F.desc("id")), f"{tmp_path}/o", "id")
    import json

    files = sorted((tmp_path / "o").glob("part-*"))  # readers may take files in another order; their names have this one
    assert [json.loads(x)["id"] for f in files for x in f.read_text().splitlines()] == list(range(50))


def test_nested_scores(spark):
    """Both shapes, nulls, strangers and broken documents."""
    texts = [
        '{"results": [{"instance_idx": 4, "methods": {"a": {"attr_scores": [[0.5, null], [], null, {"1": [1], "3": [0, 2.25]}, "x", 7]}, "b": {"other": 1}, "c": null}}]}',
        '{"results": []}', '{"results": null}', "[]", "{broken", None, "",
    ]
    df = spark.createDataFrame([(t,) for t in texts], "value string")
    got = sorted((tuple(r) for r in results.nested_scores(df, "value").collect()), key=repr)
    want = [(4, "a", 0, None, 0, 0.5), (4, "a", 0, None, 1, None), (4, "a", 3, "1", 0, 1.0), (4, "a", 3, "3", 0, 0.0), (4, "a", 3, "3", 1, 2.25)]
    assert got == sorted(want, key=repr)
    assert results.nested_scores(df.limit(0), "value").count() == 0


def test_all_datasets(spark):
    for name in results.DATASETS:
        rows = results.load_dataset(spark, "/root/testdata/sf0.001", name, most=20)
        assert sorted(r.instance_idx for r in rows.collect()) == list(range(rows.count())) and rows.count() > 0, name


def test_chunks_by_tokenizer(spark):
    from claimspark.functions import tokenizers

    df = spark.createDataFrame([(1, "a-b c\nd-e\nf")], "id int, text string")
    marks = tokenizers.REGISTRY["marks"].count
    got = lambda **how: [(r.chunk, r.n_tokens) for r in chunking.chunk_documents(df, "id", "text", pack_limit=4, **how).orderBy("chunk_pos").collect()]
    assert got() == [("a-b c\nd-e\nf", 4)] and got(count=marks) == [("a-b c", 4), ("d-e\nf", 4)]
