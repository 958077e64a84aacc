"""The registry of methods, and citations by each method's own parameters."""

import pytest

from claimspark.operators import citations, methods

#: Threshold, mass, most spans, longest span of each family.
WANT = {
    "surrogate": (1.5, 0.7, 4, None),
    "semantic_similarity": (0.7, 0.7, 4, None),
    "entailment": (0.95, 0.7, 4, None),
    "entailment_window_3": (0.95, 0.4, 4, 3),
    "entailment_window_5": (0.95, 0.3, 4, 3),
}


@pytest.mark.parametrize("name", sorted(WANT))
def test_parameters(name):
    x = citations.PARAMS[name]
    assert (x.t, x.p, x.k, x.n) == WANT[name] and set(citations.PARAMS) == set(WANT)


def test_registry(spark):
    import claimspark.plans  # noqa: F401  registers the builders

    names = [m.name for m in methods.METHODS]
    assert len(set(names)) == len(names) == 12 and len({m.label for m in methods.METHODS}) == 12
    assert next(m for m in methods.METHODS if m.name == "surrogate_64").params == citations.PARAMS["surrogate"]
    assert next(m for m in methods.METHODS if m.name == "direct").params is None
    assert "surrogate_256" in methods.selecting() and "posthoc" not in methods.selecting()
    with pytest.raises(KeyError, match="nothing"):
        methods.scores(["nothing"], spark, "x")
    with pytest.raises(KeyError, match="nothing"):
        methods.runs("nothing")


def test_each_method_has_its_own_windows(spark):
    """The same scores under two methods: one cuts runs at two sources and takes one span, the other takes all."""
    rows = [(m, 1, 0, i, s) for m in ("a", "b", "none") for i, s in enumerate([0.9, 0.8, 0.7, 0.0, 0.9])]
    df = spark.createDataFrame(rows, "method string, conv_id int, sent_idx int, source_idx int, score double")
    params = {"a": citations.CitationParams(0.5, p=0.1, k=4, n=2), "b": citations.CitationParams(0.7, p=1.0, k=4)}
    got = citations.select_by_method(df, ["conv_id", "sent_idx"], params).collect()
    assert sorted((r.method, r.span_rank, r.lo, r.hi) for r in got) == [("a", 1, 4, 4), ("b", 1, 4, 4), ("b", 2, 0, 2)]
    for name, x in params.items():
        alone = citations.select_citations(df.filter(df.method == name), ["conv_id", "sent_idx"], x).collect()
        assert sorted((r.span_rank, r.lo, r.hi) for r in alone) == sorted((r.span_rank, r.lo, r.hi) for r in got if r.method == name)
