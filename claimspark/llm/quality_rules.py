"""Quality rules as a short-circuit cascade, in DataFrame functions only.

A bounded sample of documents gives each rule's cost (the mean number of elementary steps that its
statistic takes, by the rule's own formula) and its selectivity (the share of documents that it rejects).
Rules then run in the order of rejection per cost: a text's words are split once, and a CASE expression
computes one rule's statistic after the other and stops at the first rejection. The order changes the
cost and the reported `rejected_by`, never the verdict; equal tables give equal orders.

Nulls: a null text has no words and is rejected by the word-count rule. Empty texts likewise. Repeated
rows and null ids are judged row by row, texts of any length whole. An empty table gives an empty result.
Input columns other than the text stay untouched; the statistics come under the names in STATS and replace
input columns of these names. The stage adds no columns, so that it keeps all of them.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ASCII_SPACE, WORD, table

SYMBOLS = "#*$%&|<>"
WINDOW = 5
STATS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")


def words_of(text: Column) -> Column:
    """Maximal runs of characters other than ASCII space, in order."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), ASCII_SPACE + "+"), lambda w: w != "")


def repeat_words(words: Column) -> Column:
    """Words covered by WINDOW-word windows that occur twice or more in the text.

    Windows are compared by 64-bit hashes within one text. Texts whose windows are all distinct, by
    far the most, stop at the first branch; the others sort (hash, position) pairs, keep the
    positions of equal neighbours and add up what each window covers before the next one begins.
    """
    n = F.size(words)
    hashes = F.transform(F.slice(words, 1, F.greatest(n - (WINDOW - 1), F.lit(0))), lambda w, i: F.xxhash64(*[F.get(words, i + k) for k in range(WINDOW)]))

    def covered(h: Column) -> Column:
        pairs = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("p"))))
        at = lambda s, i: F.get(s, i)["h"]

        def positions(s: Column) -> Column:
            same = F.transform(s, lambda x, i: F.when((F.coalesce(at(s, i + 1) == x["h"], F.lit(False))) | ((i > 0) & F.coalesce(at(s, F.greatest(i - 1, F.lit(0))) == x["h"], F.lit(False))), x["p"]))
            return F.array_sort(F.filter(same, lambda p: p.isNotNull()))

        def total(p: Column) -> Column:
            return F.aggregate(
                F.transform(p, lambda x, i: F.least(F.coalesce(F.get(p, i + 1) - x, F.lit(WINDOW)), F.lit(WINDOW))),
                F.lit(0).cast("long"),
                lambda a, x: a + x,
            )

        return bind(bind(pairs, positions), total)

    return bind(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(covered(h)))


def bind(value: Column, body) -> Column:
    """`let x = value in body(x)`: the value is computed once, also where body names it many times."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def lines_of(raw: Column) -> Column:
    """The lines that have a word."""
    return F.filter(F.split(raw, "\n"), lambda x: x.rlike(WORD))


def n_symbols(raw: Column) -> Column:
    return (F.length(raw) - F.length(F.translate(raw, SYMBOLS, ""))).cast("long")


def n_dup_lines(lines: Column) -> Column:
    return (F.size(lines) - F.size(F.array_distinct(lines))).cast("long")


def statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add the columns of STATS (all long)."""
    raw = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    lines = bind(lines_of(raw), lambda x: F.struct(F.size(x).cast("long").alias("n"), n_dup_lines(x).alias("dup")))
    words = bind(words_of(raw), lambda w: F.struct(F.size(w).cast("long").alias("n"), repeat_words(w).alias("repeat")))
    added = {
        "n_words": words["n"],
        "word_chars": F.length(F.regexp_replace(raw, ASCII_SPACE + "+", "")).cast("long"),
        "n_symbols": n_symbols(raw),
        "n_lines": lines["n"],
        "n_dup_lines": lines["dup"],
        "n_repeat_words": words["repeat"],
    }
    return docs.withColumns(added)


#: One statistic of a text from the text and its words, for rules that run one after the other.
STATISTIC = {
    "n_words": lambda raw, words: F.size(words).cast("long"),
    "word_chars": lambda raw, words: F.length(F.regexp_replace(raw, ASCII_SPACE + "+", "")).cast("long"),
    "n_symbols": lambda raw, words: n_symbols(raw),
    "n_dup_lines": lambda raw, words: bind(lines_of(raw), n_dup_lines),
    "n_lines": lambda raw, words: F.size(lines_of(raw)).cast("long"),
    "n_repeat_words": lambda raw, words: repeat_words(words),
}


@dataclass(frozen=True)
class Rule:
    """A document is rejected where `rejects` holds over the statistics that the rule reads; these take
    `cost` elementary steps (an SQL expression over n_chars and n_words)."""

    name: str
    reads: tuple[str, ...]
    rejects: Callable[..., Column]
    cost: str

    def fails(self, row: Callable[[str], Column]) -> Column:
        return self.rejects(*map(row, self.reads))


#: The contract's base rules and the method's own: mean word length, symbol and duplicate-line shares.
#: Steps: one for each character that is looked at, and four for each hash or comparison of a word.
RULES = (
    Rule("few_words", ("n_words",), lambda n: n < 10, "1"),
    Rule("repeated_windows", ("n_repeat_words", "n_words"), lambda repeated, n: 100 * repeated > 20 * n, "24 * n_words"),
    Rule("symbols", ("n_symbols", "n_words"), lambda symbols, n: 4 * symbols > n, "n_chars"),
    Rule("word_length", ("word_chars", "n_words"), lambda chars, n: (chars < 2 * n) | (chars > 20 * n), "2 * n_chars"),
    Rule("duplicate_lines", ("n_dup_lines", "n_lines"), lambda dup, lines: (dup >= 3) & (2 * dup > lines), "3 * n_chars"),
)
BASE = ("few_words", "repeated_windows")
#: Documents that set the order, at most, and how long each may be; the bounds change the order alone.
SAMPLE_ROWS, SAMPLE_CHARS = 1000, 50_000


def plan_cascade(docs: DataFrame, rules=RULES, text: str = "text", sample_rows: int = SAMPLE_ROWS, sample_chars: int = SAMPLE_CHARS) -> list[tuple[Rule, float, float]]:
    """(rule, cost in steps, rejected share), best rejection per cost first.

    At most sample_rows rows of at most sample_chars characters are taken from the first partitions that
    have them (collect with a limit reads no more). Statistics are worked out where the rows are; numbers, no texts,
    come to the driver. Equal ratios fall back to the cost and the rule's name, so that the order is defined.
    """
    raw = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    stats = statistics(docs.select(raw.alias("text")).filter(F.length("text") <= sample_chars)).withColumn("n_chars", F.length("text"))
    found = stats.select(*[r.fails(F.col).cast("double").alias(f"share_{r.name}") for r in rules], *[F.expr(r.cost).cast("double").alias(f"cost_{r.name}") for r in rules]).limit(sample_rows).collect()
    mean = lambda name: sum(row[name] or 0.0 for row in found) / len(found)
    if not found:
        return [(r, 0.0, 0.0) for r in rules]
    each = [(r, max(mean(f"cost_{r.name}"), 1.0), mean(f"share_{r.name}")) for r in rules]
    return sorted(each, key=lambda x: (-x[2] / x[1], x[1], x[0].name))


def cascade(text: Column, order: list[Rule]) -> Column:
    """The first rule of the order that rejects the text, else null; later statistics are not computed."""
    raw = F.coalesce(text.cast("string"), F.lit(""))

    def judged(words: Column) -> Column:
        verdict = F.lit(None).cast("string")
        for rule in reversed(order):
            row = F.struct(*[STATISTIC[name](raw, words).alias(name) for name in rule.reads])
            verdict = F.when(bind(row, failing(rule)), F.lit(rule.name)).otherwise(verdict)
        return verdict

    def failing(rule: Rule):
        return lambda row: rule.fails(row.getField)

    return bind(words_of(raw), judged)


def apply_rules(docs: DataFrame, rules=RULES, text: str = "text", order: list[Rule] | None = None) -> DataFrame:
    """Add STATS, `rejected_by` (the first rule of the cascade that rejects, else null), base_failed and kept.

    All statistics are asked for here, so each is computed once and the cascade goes over their values;
    `passing` computes only what the cascade reaches.
    """
    order = order if order is not None else [r for r, _, _ in plan_cascade(docs, rules, text)]
    out = statistics(docs, text)
    verdict = F.lit(None).cast("string")
    for rule in reversed(order):
        verdict = F.when(rule.fails(F.col), F.lit(rule.name)).otherwise(verdict)
    by_name = {r.name: r for r in rules}
    base = F.lit(False)
    for name in BASE:
        if name in by_name:
            base = base | by_name[name].fails(F.col)
    return out.withColumns({"rejected_by": verdict, "base_failed": base}).withColumn("kept", F.col("rejected_by").isNull())


def passing(docs: DataFrame, rules=RULES, text: str = "text", order: list[Rule] | None = None) -> DataFrame:
    """The rows that no rule rejects, all columns as they were."""
    order = order if order is not None else [r for r, _, _ in plan_cascade(docs, rules, text)]
    return docs.filter(cascade(F.col(f"`{text}`"), order).isNull())


def op10_quality_rules(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return apply_rules(docs).select("doc_id", *[c for c in STATS if c != "n_lines"], "base_failed", "kept", "n_lines")


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that the cascade rejects go."""
    return passing(docs)


ORACLE_OP10 = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
p AS (SELECT doc_id, unnest(ws) AS x, unnest(range(1, len(ws) + 1)) AS i FROM w),
g AS (SELECT doc_id, i, x, lead(x, 1) OVER o AS x1, lead(x, 2) OVER o AS x2, lead(x, 3) OVER o AS x3, lead(x, 4) OVER o AS x4
      FROM p WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
r AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, x, x1, x2, x3, x4) AS n FROM g WHERE x4 IS NOT NULL),
c AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat FROM r, (SELECT unnest(range(0, 5)) AS k) WHERE n > 1 GROUP BY doc_id),
s AS (SELECT w.doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
             (length(t) - length(translate(t, '#*$%&|<>', '')))::BIGINT AS n_symbols,
             len(ls)::BIGINT AS n_lines, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
             coalesce(n_repeat, 0)::BIGINT AS n_repeat_words
      FROM w LEFT JOIN c ON c.doc_id = w.doc_id)
SELECT *, (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed,
       NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words OR 4 * n_symbols > n_words
            OR word_chars < 2 * n_words OR word_chars > 20 * n_words
            OR (n_dup_lines >= 3 AND 2 * n_dup_lines > n_lines)) AS kept
FROM s
"""
