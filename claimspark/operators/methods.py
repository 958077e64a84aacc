"""The registry of attribution methods: what each is called, how it is shown, what selects its citations, what runs it."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .attribution import BUDGETS
from .citations import PARAMS, CitationParams


@dataclass(frozen=True)
class Method:
    """A family of methods, or the variant of it that a number tells apart."""

    family: str
    variant: int | None = None
    unit: str = ""

    @property
    def name(self) -> str:
        return self.family if self.variant is None else f"{self.family}_{self.variant}"

    @property
    def label(self) -> str:
        shown = self.family.replace("_", " ")
        return shown if self.variant is None else f"{shown}, {self.variant} {self.unit}"

    @property
    def params(self) -> CitationParams | None:
        """Of the variant, else of the family; None for methods that cite by themselves."""
        return PARAMS.get(self.name, PARAMS.get(self.family))


#: Variants of each family, and what their number counts.
FAMILIES = {
    "direct": ((None,), ""),
    "entailment": ((None,), ""),
    "entailment_greedy": ((None,), ""),
    "entailment_window": ((3, 5), "sources"),
    "leave_one_out": ((None,), ""),
    "posthoc": ((None,), ""),
    "semantic_similarity": ((None,), ""),
    "surrogate": (BUDGETS, "ablations"),
}
#: All methods by family and number: the order in which results show them.
METHODS = tuple(Method(family, v, unit) for family, (variants, unit) in sorted(FAMILIES.items()) for v in variants)

_runs: dict[str, Callable[..., DataFrame]] = {}


def runs(family: str):
    """Register what gives a family's scores (conv_id, sent_idx, source_idx, score); with a column variant where it has variants."""
    if family not in FAMILIES:
        raise KeyError(f"no method {family!r}; there are {sorted(FAMILIES)}")

    def add(build: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        _runs[family] = build
        return build

    return add


def scores(names: list[str], *where) -> DataFrame:
    """(method, conv_id, sent_idx, source_idx, score) of the named methods. A family runs once for all its variants."""
    wanted = [m for m in METHODS if m.name in names]
    missing = set(names) - {m.name for m in wanted if m.family in _runs}
    if missing or not names:
        raise KeyError(f"no method {sorted(missing)}; there are {sorted(m.name for m in METHODS if m.family in _runs)}")
    parts = []
    for family in sorted({m.family for m in wanted}):
        name = F.lit(family) if FAMILIES[family][0] == (None,) else F.concat(F.lit(f"{family}_"), F.col("variant").cast("string"))
        rows = _runs[family](*where).withColumn("method", name).filter(F.col("method").isin(*[m.name for m in wanted if m.family == family]))
        parts.append(rows.select("method", "conv_id", "sent_idx", F.col("source_idx").cast("long").alias("source_idx"), "score"))
    return reduce(DataFrame.unionByName, parts)


def selecting() -> dict[str, CitationParams]:
    """Parameters by name of the methods whose citations are selected from scores."""
    return {m.name: m.params for m in METHODS if m.params}
