"""Sentence boundaries learned from the corpus, without labels (Kiss and Strunk 2006).

Log-likelihood ratios over counts say which words are abbreviations, which pairs around a period belong together and
which words begin sentences. All counts are aggregates by word or pair, added up in each task before they shuffle. What
is learned are three tables, whole; as one row of hash tables they are broadcast. A text looks up
its own words by the periods, and only the patterns of what is found are applied by `functions.text.sentences`, inside the scan of the texts.

A word is a run without white space, freed of other signs around it, in small letters; only words of letters and inner
periods count. Null and empty texts have none.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import CUT, HELD, cut, once, sentences

#: Fixed values of the method: least scores of abbreviations, pairs and sentence starters.
ABBREVIATION, PAIR, STARTER = 0.3, 7.88, 30.0
#: Lists that the entries of a table are dealt to, so that few are compared with a word.
MOST = 500
WORD = r"^\p{L}[\p{L}.]*$"
#: Matches nothing: control characters that texts don't hold twice.
NEVER = "\x1f\x1f"


def _bare(token: Column) -> Column:
    return F.regexp_replace(token, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}.!?]+$", "")


def _word(bare: Column) -> Column:
    return F.lower(F.regexp_replace(bare, r"[.!?]$", ""))


def events(texts: DataFrame, text: str) -> DataFrame:
    """(word, period, ends, follower, times): how often a word stands with or without a period or another ending
    mark at its end, and before which word where it has one.

    Runs are counted as they stand, so that patterns are applied to different runs only, and what they make of them is
    counted again, by follower for words that end with a mark. All tables start from the second aggregate, whose shuffle is made once
    and reused: every column depends on its count, so that no filter on it, nor one that joins infer, goes below it.
    """
    runs = F.filter(F.split(F.coalesce(F.col(text), F.lit("")), r"\s+"), lambda t: t != "")
    rows = texts.select(runs.alias("ts")).select("ts", F.slice("ts", 2, F.greatest(F.size("ts"), F.lit(1))).alias("fs"))
    pairs = rows.select(F.explode(F.arrays_zip("ts", "fs")).alias("x")).select("x.*")  # an exploded row holds two words, not its text
    counted = pairs.groupBy("ts", F.when(F.col("ts").rlike("[.!?]"), F.col("fs")).alias("fs")).agg(F.count(F.lit(1)).alias("times"))
    bare = counted.select(_bare(F.col("ts")).alias("t"), _bare(F.col("fs")).alias("f"), "times")
    t, ends = F.col("t"), F.coalesce(F.col("t").rlike("[.!?]$"), F.lit(False))
    found = bare.select(_word(t).alias("word"), t.endswith(".").alias("period"), ends.alias("ends"), F.when(ends, _word(F.col("f"))).alias("follower"), "times")
    keys = ("word", "period", "ends", "follower")
    again = found.filter(F.when(F.col("times") > 0, F.col("word").rlike(WORD))).groupBy(*keys).agg(F.sum("times").alias("times"))
    return again.select(*[F.when(F.col("times") > 0, F.col(k)).alias(k) for k in keys], "times")


def word_counts(rows: DataFrame) -> DataFrame:
    """(word, n, with_period): counts of each word."""
    return rows.groupBy("word").agg(F.sum("times").alias("n"), F.sum(F.when(F.col("period"), F.col("times")).otherwise(0)).alias("with_period"))


def totals(counts: DataFrame) -> DataFrame:
    """One row (total, periods): the sums of `word_counts`, broadcast where they are used."""
    return counts.agg(F.sum("n").alias("total"), F.sum("with_period").alias("periods"))


def abbreviations(counts: DataFrame, sums: DataFrame) -> DataFrame:
    """(word, score): words whose period is likelier their own than a sentence's."""
    n, k, share = F.col("n"), F.col("with_period"), F.col("periods") / F.col("total")
    null = k * F.ln(share) + (n - k) * F.ln(1 - share)
    own = k * F.ln(F.lit(0.99)) + (n - k) * F.ln(F.lit(0.01))
    inner = F.length("word") - F.length(F.replace("word", F.lit("."), F.lit("")))
    letters = F.length("word") - inner
    score = -2 * (null - own) * F.exp(-letters) * (inner + 1) * F.pow(letters, -(n - k))
    found = counts.crossJoin(F.broadcast(sums)).filter((F.col("with_period") > 0) & (F.col("periods") < F.col("total"))).select("word", F.round(score, 6).alias("score"))
    return found.filter(F.col("score") >= ABBREVIATION)


def association(a: Column, b: Column, both: Column, total: Column) -> Column:
    """The log-likelihood ratio of a and b standing together more often than by chance."""
    # what is multiplied by zero has no logarithm
    times = lambda k, p: F.when(k == 0, 0.0).otherwise(k * F.ln(p))
    p, p1, p2 = b / total, both / a, (b - both) / (total - a)
    chance = times(both, p) + times(a - both, 1 - p) + times(b - both, p) + times(total - a - b + both, 1 - p)
    bound = times(both, p1) + times(a - both, 1 - p1) + times(b - both, p2) + times(total - a - b + both, 1 - p2)
    return -2 * (chance - bound)


def _marked(rows: DataFrame, known: DataFrame) -> DataFrame:
    """rows that end with a mark, with `short`: whether the period is that of an abbreviation or initial."""
    short = F.broadcast(known.select("word", F.lit(True).alias("known")))
    return rows.filter("ends").join(short, "word", "left").withColumn("short", F.col("period") & (F.col("known").isNotNull() | (F.length("word") == 1)))


def starters(rows: DataFrame, counts: DataFrame, sums: DataFrame, known: DataFrame) -> DataFrame:
    """(word, score): words that follow the end of a sentence more often than they should."""
    ends = _marked(rows, known).filter("NOT short")
    first = ends.filter(F.col("follower").rlike(WORD)).groupBy(F.col("follower").alias("word")).agg(F.sum("times").alias("first"))
    both = first.join(counts, "word").crossJoin(F.broadcast(sums)).crossJoin(F.broadcast(ends.agg(F.sum("times").alias("ends"))))  # one row each
    score = association(F.col("ends"), F.col("n"), F.col("first"), F.col("total"))
    found = both.filter(F.col("total") * F.col("first") > F.col("n") * F.col("ends")).select("word", F.round(score, 6).alias("score"))
    return found.filter(F.col("score") >= STARTER)


def pairs(rows: DataFrame, counts: DataFrame, sums: DataFrame, known: DataFrame) -> DataFrame:
    """(word, follower, score): an abbreviation or initial and the word after its period, where they belong together."""
    both = _marked(rows, known).filter(F.col("short") & F.col("follower").rlike(WORD)).groupBy("word", "follower").agg(F.sum("times").alias("both")).filter("both > 1")
    each = both.join(counts.select("word", F.col("n").alias("a")), "word").join(counts.select(F.col("word").alias("follower"), F.col("n").alias("b")), "follower").crossJoin(F.broadcast(sums))
    score = association(F.col("a"), F.col("b"), F.col("both"), F.col("total"))
    found = each.filter(F.col("total") * F.col("both") > F.col("a") * F.col("b")).select("word", "follower", F.round(score, 6).alias("score"))
    return found.filter(F.col("score") >= PAIR)


def _entry(word: str) -> Column:
    return F.replace(F.col(word), F.lit("."), F.lit("\\."))


def _folded(word: Column) -> Column:
    """One form for all words that differ in case alone, and for few others: it finds entries, their patterns decide."""
    return F.lower(F.upper(F.lower(word)))


def _place(key: Column) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(MOST)).cast("int")


def _table(rows: DataFrame, name: str) -> DataFrame:
    """One row with a hash table of rows (k, e): MOST lists of struct<k,e>, a row in the list that its key's hash says; null without rows."""
    dealt = rows.groupBy(_place(F.col("k")).alias("at")).agg(F.collect_list(F.struct("k", "e")).alias("xs"))  # a list of the table
    lists = dealt.agg(F.collect_list(F.struct("at", "xs")).alias("ys"))
    spread = F.transform(F.sequence(F.lit(0), F.lit(MOST - 1)), lambda i: F.get(F.filter("ys", lambda y: y["at"] == i), F.lit(0))["xs"])
    return lists.select(F.when(F.size("ys") > 0, spread).alias(name))


def _entries(keys: Column, table: Column) -> Column:
    """Sorted array<string>: the entries of a `_table` that have one of the keys."""
    held = lambda k: F.filter(F.get(table, _place(k)), lambda x: x["k"] == k)
    found = F.transform(keys, lambda k: F.coalesce(F.transform(held(k), lambda x: x["e"]), F.array().cast("array<string>")))
    return F.when(table.isNull(), F.array().cast("array<string>")).otherwise(F.array_sort(F.array_distinct(F.flatten(found))))


def patterns(known: DataFrame, first: DataFrame, together: DataFrame) -> DataFrame:
    """One row (abbreviation, starter, pairs) of hash tables: what `split` and `placed` take. Pairs matter only before a starter; elsewhere an abbreviation ends nothing."""
    a = _table(known.select(_folded(F.col("word")).alias("k"), _entry("word").alias("e")), "abbreviation")
    capital = lambda word: F.concat(F.upper(F.substring("word", 1, 1)), F.substring(word, 2, 1 << 20))
    s = _table(first.select(capital("word").alias("k"), capital(_entry("word")).alias("e")), "starter")
    met = together.join(F.broadcast(first.select(F.col("word").alias("follower"))), "follower", "left_semi")
    pair = F.concat(F.lit(r"(^|[^\p{L}\p{N}.])((?iu:"), _entry("word"), F.lit(r"))\.(\s+(?iu:"), _entry("follower"), F.lit(r")(?:[^\p{L}]|$))"))
    p = _table(met.select(F.concat(_folded(F.col("word")), F.lit(" "), _folded(F.col("follower"))).alias("k"), pair.alias("e")), "pairs")
    return a.crossJoin(s).crossJoin(p)  # one row each


#: A word with a period before white space, and the word that may follow.
MET = r"(?<![\p{L}\p{N}.])(\p{L}[\p{L}.]*)\.(?=\s+(\p{L}[\p{L}.]*)?)"
RUN = rf"{HELD}\s+(\p{{L}}[\p{{L}}.]*)"


def _beginnings(run: Column) -> Column:
    """What a run of letters and periods begins with, up to each period and whole."""
    return F.transform(F.sequence(F.lit(1), F.length(run) - F.length(F.replace(run, F.lit("."), F.lit(""))) + 1), lambda k: F.call_function("substring_index", run, F.lit("."), k))


def _own_patterns(texts: DataFrame, text: str, model: DataFrame) -> DataFrame:
    """texts with __p, the struct (abbreviation, starter, pairs) of what `sentences` takes: of the model's entries those that a text
    can hold. The others match nowhere in it, so that the sentences are those of the whole model."""
    both = F.array_distinct(F.arrays_zip(*[F.regexp_extract_all(text, F.lit(MET), i).alias(c) for i, c in ((1, "w"), (2, "f"))]))
    rows = once(once(texts, "__met", both), "__run", F.array_distinct(F.concat(F.transform("__met", lambda x: x["f"]), F.regexp_extract_all(text, F.lit(RUN), 1))))
    tables = {c: F.col(f"__{c}") for c in ("abbreviation", "starter", "pairs")}
    rows = rows.crossJoin(F.broadcast(model.select(*[F.col(c).alias(f"__{c}") for c in tables])))
    short = _entries(F.array_distinct(F.transform("__met", lambda x: _folded(x["w"]))), tables["abbreviation"])
    first = _entries(F.flatten(F.transform("__run", _beginnings)), tables["starter"])
    follow = F.filter("__met", lambda x: x["f"] != "")
    keys = F.flatten(F.transform(follow, lambda x: F.transform(_beginnings(x["f"]), lambda f: F.concat(_folded(x["w"]), F.lit(" "), _folded(f)))))
    rows = once(rows, "__e", F.struct(short.alias("a"), first.alias("s"), _entries(keys, tables["pairs"]).alias("pairs"))).drop("__met", "__run", *[f"__{c}" for c in tables])
    listed = lambda xs, before, after: F.when(F.size(xs) > 0, F.concat(F.lit(before), F.array_join(xs, "|"), F.lit(after))).otherwise(NEVER)
    a = listed(F.col("__e.a"), r"(^|[^\p{L}\p{N}.])((?iu:", r"))\.(\s)")
    s = listed(F.col("__e.s"), f"{HELD}(\\s+)(", r")([^\p{L}]|$)")
    return rows.withColumn("__p", F.struct(a.alias("abbreviation"), s.alias("starter"), F.col("__e.pairs").alias("pairs"))).drop("__e")


def split(texts: DataFrame, text: str, model: DataFrame, out: str = "sentences") -> DataFrame:
    """texts with an array of their sentences by a learned model (one row of `patterns`, broadcast)."""
    own = [F.col(f"__p.{c}") for c in ("abbreviation", "starter", "pairs")]
    return once(_own_patterns(texts, text, model), out, sentences(F.col(text), *own)).drop("__p")


def _running(sizes: pa.Array) -> pa.Array:
    """The running sums of each list."""
    at = sizes.offsets.to_numpy() - sizes.offsets[0].as_py()
    sums = np.concatenate([[0], np.cumsum(sizes.flatten().to_numpy(), dtype=np.int64)])
    return pa.ListArray.from_arrays(at, pa.array(sums[1:] - np.repeat(sums[at[:-1]], np.diff(at)), pa.int32()))


def placed(texts: DataFrame, text: str, model: DataFrame, out: str = "sentences") -> DataFrame:
    """texts with `split`'s sentences as array<struct<s,start,end>>. Places are running sums over what a text is cut into, so that it isn't searched."""
    own = [F.col(f"__p.{c}") for c in ("abbreviation", "starter", "pairs")]
    rows = once(_own_patterns(texts, text, model), "__cut", F.split(cut(F.col(text), *own), CUT)).drop("__p")
    rows = rows.withColumn("__end", F.arrow_udf(_running, "array<int>")(F.transform("__cut", F.length)))

    def one(piece, end):
        start = end - F.length(F.regexp_replace(piece, r"^\s+", ""))
        s = F.regexp_replace(piece, r"^\s+|\s+$", "")
        return F.struct(s.alias("s"), start.alias("start"), (start + F.length(s)).alias("end"))

    return once(rows, out, F.filter(F.zip_with("__cut", "__end", one), lambda x: x["s"] != "")).drop("__cut", "__end")


def learn(texts: DataFrame, text: str = "text") -> dict[str, DataFrame]:
    """The tables abbreviations, starters and pairs."""
    rows = events(texts, text)
    counts = word_counts(rows)
    sums = totals(counts)
    known = abbreviations(counts, sums)
    return {"abbreviations": known, "starters": starters(rows, counts, sums, known), "pairs": pairs(rows, counts, sums, known)}
