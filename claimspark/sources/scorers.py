"""Pluggable scorers: models, judges and search, each with a deterministic local stand-in.

A scorer maps a batch of inputs to a batch of outputs; `score_column` runs it as an iterator pandas UDF,
built once a worker task (so a model is loaded where it runs, when it is first needed). Calls that can
fail are retried inside the batch. REGISTRY names the scorers; `registered` looks one up, and callers add
their own models, judges and providers to it.
"""

from __future__ import annotations

import hashlib
import json
import math
import re
import time
from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache
from itertools import islice
from typing import Protocol

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type


NUMBERS = ("double", "float", "int", "long", "bigint")
#: Words whose hashes a worker keeps.
WORDS = 1 << 16


class Scorer(Protocol):
    def __call__(self, rows: Sequence[tuple]) -> Sequence: ...


def hash_embedding(size: int = 64) -> Callable[[Sequence[tuple]], list[list[float]]]:
    """Unit vectors of signed word hashes; a worker keeps those of WORDS words."""

    @lru_cache(WORDS)
    def place(w):
        h = hashlib.md5(w.encode(), usedforsecurity=False).hexdigest()
        return int(h[:8], 16) % size, 1.0 if int(h[8], 16) > 7 else -1.0

    def embed(rows):
        out = []
        for (text,) in rows:
            v = [0.0] * size
            for w in (text or "").split():
                at, sign = place(w) if len(w) < 100 else place.__wrapped__(w)
                v[at] += sign
            norm = math.sqrt(sum(x * x for x in v))
            out.append([x / norm for x in v] if norm else v)
        return out

    return embed


def lexical_entailment(rows: Sequence[tuple]) -> list[float]:
    out = []
    for premise, hypothesis in rows:
        want = set((hypothesis or "").split())
        out.append(len(want & set((premise or "").split())) / len(want) if want else 0.0)
    return out


def lexical_judge(rows: Sequence[tuple]) -> list[str]:
    """A verdict text from the overlap of snippet and statement."""
    grade = lambda x: "Fully supported" if x > 0.6 else "Partially supported" if x > 0.2 else "No support"
    return [f"Rating: [[{grade(x)}]]" for x in lexical_entailment(rows)]


def judge_with_usage(rows: Sequence[tuple]) -> list[dict]:
    """The judge's text and the tokens that the call took: prompt (both texts) and completion."""
    said = lexical_judge(rows)
    size = lambda x: len((x or "").split())
    return [{"text": t, "prompt_tokens": size(a) + size(b), "completion_tokens": size(t)} for (a, b), t in zip(rows, said, strict=True)]


def token_logprobs(labels: Sequence[str], refused: int = 0) -> Callable[[], Scorer]:
    """A provider of one-token answers: each label's log-probability. An empty prompt gives null, and so does a refused
    call: one whose prompt's token count `refused`, if any, divides; the label at a prompt's token count modulo 11 (less five) is missing from the answer."""

    def call(rows):
        out: list = []
        for (prompt,) in rows:
            n = len((prompt or "").split())
            out.append({x: -((n * (i + 2)) % 17) / 4.0 for i, x in enumerate(labels) if n % 11 != i + 5} if n and not (refused and n % refused == 0) else None)
        return out

    return lambda: call


def last_token_logits(size: int) -> Callable[[], Scorer]:
    """A local model's logits after a prompt, one a vocabulary entry."""

    def call(rows):
        return [[((len((prompt or "").split()) * (i + 3)) % 13) / 2.0 for i in range(size)] for (prompt,) in rows]

    return lambda: call


def query_writer(rows: Sequence[tuple]) -> list[str]:
    """Search queries for a claim as a fenced JSON list: its words by threes, seven at most."""
    out = []
    for (claim,) in rows:
        words = (claim or "").split()
        out.append("```json\n" + json.dumps([" ".join(words[k : k + 3]) for k in range(0, min(len(words), 21), 3)], ensure_ascii=False) + "\n```<eos>")
    return out


def fact_writer(rows: Sequence[tuple]) -> list[list[str]]:
    """A statement's atomic facts: its parts between commas, semicolons and colons, of two words or more."""
    return [[p for p in (" ".join(x.split()) for x in re.split("[,;:]", s or "")) if " " in p] for (s,) in rows]


def index_writer(tries: int = 5) -> Callable[[], Scorer]:
    """Post-hoc citation by a model: `[i]` marks of the k sources that share most words with the facts.

    The first, greedy try forgets to stop on every third statement; later ones give the answer. Rows are
    (facts, sources, k or null); an answer is (text, indices or null), the last text where none was valid.
    """

    def ranked(facts, sources):
        want = set(" ".join(facts).split())
        return len(want), sorted(range(len(sources)), key=lambda i: (-len(want & set(sources[i].split())), i))

    def answer(size, order, k, attempt):
        text = "".join(f"[{i + 1}]" for i in order[: k or 3])
        return text if attempt == 0 and size % 3 == 0 else text + "<eos>"

    def valid(text, n, k):
        if not text.endswith("<eos>"):
            return None
        ids = list(dict.fromkeys(int(x) for x in re.findall(r"\[\s*(\d+)\s*\]", text)))
        if k and len(ids) < k:
            return None
        ids = ids[:k] if k else ids
        return None if any(i <= 0 or i > n for i in ids) else ids

    def call(rows):
        out: list = []
        last = None
        for facts, sources, k in rows:
            if last is None or last[0] is not facts or last[1] is not sources:  # rows that differ in k alone hold the same objects
                last = facts, sources
                n, (size, order) = 0 if sources is None else len(sources), ranked(facts if facts is not None else (), sources if sources is not None else ())
            k = None if k is None or k != k else int(k)
            for attempt in range(tries):
                text = answer(size, order, k, attempt)
                ids = valid(text, n, k)
                if ids is not None:
                    break
            out.append({"text": text, "ids": ids, "tries": attempt + 1})
        return out

    return lambda: call


def label_writer(labels: Sequence[str]) -> Callable[[], Scorer]:
    """A verdict label from a justification: that at its token count modulo the labels; never another value."""

    def call(rows):
        return [labels[len((t or "").split()) % len(labels)] for (t,) in rows]

    return lambda: call


def with_retries(scorer: Scorer, tries: int = 5, wait: float = 1.0, factor: float = 2.0) -> Scorer:
    """Try again with growing pauses; the last failure goes on."""

    def call(rows):
        for k in range(tries):
            try:
                return scorer(rows)
            except Exception:
                if k + 1 == tries:
                    raise
                time.sleep(wait * factor**k)
        raise AssertionError("tries must be positive")

    return call


def score_column(make: Callable[[], Scorer], kind: str, *columns: Column, batch: int = 512) -> Column:
    """A column of scores; `make` builds the scorer on the worker."""

    fields = [f.name for f in T._parse_datatype_string(kind).fields] if kind.startswith("struct<") else None

    @F.pandas_udf(kind)
    def run(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        scorer = make()
        for series in batches:
            # one column comes as itself, several as a tuple
            rows = list(zip(*((series,) if isinstance(series, pd.Series) else series), strict=True))
            out: list = []
            for at in range(0, len(rows), batch):
                out += list(scorer(rows[at : at + batch]))
            yield pd.DataFrame(out, columns=fields) if fields else pd.Series(out, dtype=None if kind in NUMBERS else object)

    return run(*columns)


def score_each(make: Callable[[], Scorer], kind: str, each: Column, *columns: Column, batch: int = 512) -> Column:
    """An array of scores of (columns, x), one for each x of an array column: what a row's scores share goes to Python once."""

    found_type = to_arrow_type(T.ArrayType(T._parse_datatype_string(kind)))

    @F.arrow_udf(f"array<{kind}>")
    def run(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        scorer = make()
        for *shared, xs in batches:
            lists = [x or () for x in xs.to_pylist()]
            rows = [(*own, x) for *own, held in zip(*(c.to_pylist() for c in shared), lists, strict=True) for x in held]
            out: list = []
            for at in range(0, len(rows), batch):
                out += list(scorer(rows[at : at + batch]))
            found = iter(out)
            yield pa.array([list(islice(found, len(x))) for x in lists], found_type)

    return run(*columns, each)


class SearchProvider(Protocol):
    """A paged search: results of (query, page) with pos, link, title, date; an empty page ends a query."""

    def __call__(self, query: str, page: int) -> Sequence[dict]: ...


def paged_search(strings: DataFrame, provider: Callable[[], SearchProvider], pages: int = 3, query: str = "query") -> DataFrame:
    """strings with one row a result: each query's pages until one is empty, `pages` at most; retried as calls are."""

    def make():
        search = provider()
        page_of = with_retries(lambda rows: [search(q, page) for q, page in rows])

        def call(rows):
            out = []
            for (q,) in rows:
                found: list = []
                for page in range(pages):
                    got = list(page_of([(q, page)])[0])
                    if not got:
                        break
                    found += got
                out.append(found)
            return out

        return call

    kind = "array<struct<pos:int,link:string,title:string,date:string>>"
    return strings.withColumn("__found", score_column(make, kind, F.col(query))).select(*strings.columns, F.explode("__found").alias("r")).select(*strings.columns, "r.*")


def table_search(strings: DataFrame, results: DataFrame, per_page: int = 10, pages: int = 3) -> DataFrame:
    """An offline search provider: results(query, pos, link, title, date) stand in for a web API; at most `pages` pages a query."""
    return strings.join(results.filter(F.col("pos") < per_page * pages), "query")


#: A provider with a content filter refuses prompts whose number of tokens this divides.
REFUSED = 7
#: Scorers by kind and name: builders that run on the worker.
REGISTRY: dict[str, dict[str, Callable]] = {
    "entail": {"lexical": lambda: lexical_entailment},
    "embed": {"hash": hash_embedding},
    "judge": {"lexical": lambda: lexical_judge, "lexical_usage": lambda: judge_with_usage},
    "facts": {"clauses": lambda: fact_writer},
    "queries": {"triples": lambda: query_writer},
    "cite": {"overlap": index_writer()},
    "logprobs": {"verdict": token_logprobs(("SUP", "CON", "REF", "NEE")), "abstain": token_logprobs(("yes", "no")), "verdict_3": token_logprobs(("SUP", "CON", "REF"))},
    "logprobs_filtered": {"verdict": token_logprobs(("SUP", "CON", "REF", "NEE"), REFUSED), "verdict_3": token_logprobs(("SUP", "CON", "REF"), REFUSED)},
    "logits": {"verdict": last_token_logits(4)},
}


def registered(kind: str, name: str) -> Callable[[], Scorer]:
    """The builder of a scorer; an unknown name names those that exist."""
    found = REGISTRY.get(kind, {})
    if name not in found:
        raise KeyError(f"no {kind} scorer {name!r}; there are {sorted(found)}")
    return found[name]
