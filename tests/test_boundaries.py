"""Sentences: the plain rule by hand, and boundaries learned from a corpus in which abbreviations can be told."""

import random

import pytest
from pyspark.sql import functions as F

from claimspark.functions import sequences, text
from claimspark.operators import boundaries

PLAIN = [
    ("It costs 3.5 euros. Really? Yes!", ["It costs 3.5 euros.", "Really?", "Yes!"]),
    ("J. R. Smith met A. Jones. They spoke.", ["J. R. Smith met A. Jones.", "They spoke."]),
    ("He said \"go.\" Then (he left.) Now.", ["He said \"go.\"", "Then (he left.)", "Now."]),
    ("Wait... what? See www.x.org/a.b for 2. more.", ["Wait... what?", "See www.x.org/a.b for 2. more."]),
    ("一句。二句！三句；四句？五", ["一句。", "二句！", "三句；", "四句？", "五"]),
    ("one line\n\nanother line", ["one line", "another line"]),
    ("  \n", []),
    (None, []),
    ("No end", ["No end"]),
    ("...", ["..."]),
]


@pytest.mark.parametrize("raw, want", PLAIN)
def test_plain_rule(spark, raw, want):
    df = spark.createDataFrame([(raw,)], "t string").select(text.sentences(F.col("t")).alias("ss"))
    assert df.first().ss == want


def corpus():
    """Invented prose in which `dr`, `prof` and `e.g` always have a period and other words seldom do."""
    rng = random.Random(5)
    words = [f"{a}{b}" for a in ("lor", "ips", "dol", "sit", "amet", "cons", "adip", "elit") for b in ("um", "is", "or", "an", "en", "os")]
    out = []
    for k in range(400):
        parts = []
        for _ in range(6):
            s = [rng.choice(words) for _ in range(rng.randint(6, 12))]
            s[rng.randrange(1, 4)] = rng.choice(["Dr. Meyer", "Prof. Lang", "e.g. this", "etc. and", s[0]])
            head = rng.choice(["The", "The", "It", "However,", "Some"])
            parts.append(f"{head} {' '.join(s)}.")
        out.append((k, " ".join(parts)))
    return [*out, (900, None), (901, ""), (902, "?? !! ..")]


@pytest.fixture(scope="module")
def learned(spark):
    return boundaries.learn(spark.createDataFrame(corpus(), "id long, text string").repartition(3))


def test_learned_tables(learned):
    short = {r.word for r in learned["abbreviations"].collect()}
    assert {"dr", "prof", "e.g", "etc"} <= short and not {"lorum", "the", "meyer"} & short
    assert {"the", "it", "however", "some"} <= {r.word for r in learned["starters"].collect()}
    assert ("dr", "meyer") in {(r.word, r.follower) for r in learned["pairs"].collect()}
    assert all(t.count() <= boundaries.MOST for t in learned.values())


TRAINED = [
    ("We saw Dr. Meyer. The end came.", ["We saw Dr. Meyer.", "The end came."]),
    ("Use tools, e.g. a saw, at 3.5 m. Ask J. Lang.", ["Use tools, e.g. a saw, at 3.5 m. Ask J. Lang."]),
    ("Bring nails etc. The work is done. Go", ["Bring nails etc.", "The work is done.", "Go"]),
    ("Lorum ipsis (Prof. Lang, retired). It rains! 二句。三", ["Lorum ipsis (Prof. Lang, retired).", "It rains!", "二句。", "三"]),
    ("PROF. LANG came. Some left", ["PROF. LANG came.", "Some left"]),
    ("", []),
]


@pytest.mark.parametrize("raw, want", TRAINED)
def test_learned_boundaries(spark, learned, raw, want):
    rows = spark.createDataFrame([(raw, 1)], "t string, pairs int")
    got = boundaries.split(rows, "t", boundaries.patterns(*learned.values()), "ss")
    spans = got.select("*", sequences.chained_find(F.col("t"), F.col("ss")).alias("at")).first()
    assert spans.ss == want and spans.pairs == 1
    assert [raw[a.start : a.end] for a in spans.at] == want


def test_nothing_learned_from_nothing(spark):
    none = spark.createDataFrame([], "text string")
    found = boundaries.learn(none)
    assert all(t.count() == 0 for t in found.values())
    rows = spark.createDataFrame([("Dr. Meyer. He left.",)], "t string")
    got = boundaries.split(rows, "t", boundaries.patterns(*found.values()), "ss").first()
    assert got.ss == ["Dr.", "Meyer.", "He left."]


def test_sentences_are_cut_once_and_as_two_passes_cut_them(spark, tmp_path):
    """A filter on the count doesn't cut again; one pass holds the periods that two passes of consuming patterns hold."""
    from claimspark.plans import QUERIES

    from .compare import DATA

    plan = QUERIES["sentence_count_filter"](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("[。！？；]") == 1
    rng = random.Random(5)
    rows = [("".join(rng.choice(["a", "B", "1", "²", ".", ".", " ", "é", "-", "\n", "..."]) for _ in range(rng.randrange(30))),) for _ in range(3000)]
    old = F.col("t")
    for pattern in (r"(^|[^\p{L}\p{N}])(\p{L})\.(\s)", r"(^|[^\p{L}\p{N}.])(\p{N}+)\.(\s+\p{Ll})", r"(\.)(\.)\.(\s+\p{Ll})"):
        old = text._held(old, F.lit(pattern))
    new = F.col("t")
    for pattern in text.NO_END:
        new = F.regexp_replace(new, pattern, f"$1{text.HELD}")
    assert spark.createDataFrame(rows, "t string").filter(~old.eqNullSafe(new)).limit(3).collect() == []


def test_texts_are_read_once(spark):
    """All tables start from one aggregate: filters that joins infer stay above it."""
    from claimspark.plans import QUERIES

    from .compare import DATA

    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = QUERIES["boundary_model"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    assert plan.count("FileScan") == 1 and "ReusedExchange" in plan


def many(n=600):
    """(counts, sums): n words of three letters that always have a period."""
    letters = "abcdefghijkl"
    return [f"{a}{b}{c}" for a in letters for b in letters for c in letters][:n]


@pytest.fixture(scope="module")
def short(spark):
    counts = spark.createDataFrame([(w, 50, 50) for w in many()], "word string, n long, with_period long")
    return boundaries.abbreviations(counts, spark.createDataFrame([(100_000, 31_000)], "total long, periods long"))


def test_no_entry_is_cut(short):
    """All words that reach the least score are learned, however many."""
    assert {r.word for r in short.collect()} == set(many())


def test_every_entry_is_applied(spark, short, learned):
    """A text is cut by all entries; what it looks up is found whatever its case."""
    model = boundaries.patterns(short, learned["starters"], learned["pairs"])
    words = many()
    text = "Go to " + " x ".join(f"{w.upper() if k % 2 else w}." for k, w in enumerate(words)) + " x (" + ". ".join(words[:5]) + ". y). End"
    got = boundaries.split(spark.createDataFrame([(text,)], "t string"), "t", model, "ss").first().ss
    assert got == [text[: -len(" End")], "End"]


def test_places_are_those_of_a_search(spark, learned):
    """Places are summed up, without looking for sentences in the text, and known where the text holds a sign of the method's own."""
    model = boundaries.patterns(*learned.values())
    rows = [(k, raw) for k, (raw, _) in enumerate([*TRAINED, *PLAIN])] + [(98, " \n A. B\x1e The end.  Dr. Meyer. "), (99, "etc. " * 9 + "The etc. dr. meyer. x")]
    got = boundaries.placed(spark.createDataFrame(rows, "k int, t string"), "t", model, "xs")
    assert "locate" not in got._jdf.queryExecution().optimizedPlan().toString()
    split = boundaries.split(got, "t", model, "ss").select("*", sequences.chained_find(F.col("t"), F.col("ss")).alias("at"))
    for r in split.collect():
        assert [x.s for x in r.xs] == r.ss
        if r.k != 98:
            assert [(x.start, x.end) for x in r.xs] == [(a.start, a.end) for a in r.at]
        assert all((r.t or "")[x.start : x.end].replace("\x1e", ".") == x.s for x in r.xs)
