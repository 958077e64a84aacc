"""Classification, ordinal, faithfulness and quality metrics as aggregations."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def classification_report(rows: DataFrame, truth: str, predicted: str, classes: list[int], zero: float | None = None) -> DataFrame:
    """One row a class (all classes, seen or not): precision, recall, f1, support. `zero` stands where a ratio is undefined."""
    spark = rows.sparkSession
    cells = rows.groupBy(F.col(truth).alias("t"), F.col(predicted).alias("p")).agg(F.count("*").alias("n"))
    kinds = spark.createDataFrame([(c,) for c in classes], "cls int")
    hit = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0))
    counts = kinds.join(cells, (F.col("t") == F.col("cls")) | (F.col("p") == F.col("cls")), "left").groupBy("cls")
    counts = counts.agg(
        hit((F.col("t") == F.col("cls")) & (F.col("p") == F.col("cls"))).alias("tp"),
        hit((F.col("t") != F.col("cls")) & (F.col("p") == F.col("cls"))).alias("fp"),
        hit((F.col("t") == F.col("cls")) & (F.col("p") != F.col("cls"))).alias("fn"),
    )
    ratio = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(zero).cast("double"))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return counts.select("cls", ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"), ratio(2 * tp, 2 * tp + fp + fn).alias("f1"), (tp + fn).alias("support"), tp.alias("tp"))


def report_averages(report: DataFrame) -> DataFrame:
    """accuracy, macro and support-weighted means; undefined values stay out of the means."""
    w = F.col("support").cast("double")
    mean = lambda c: F.try_divide(F.sum(F.col(c) * w), F.sum(F.when(F.col(c).isNotNull(), w)))
    return report.agg(
        F.try_divide(F.sum("tp").cast("double"), F.sum("support").cast("double")).alias("accuracy"),
        *[F.avg(c).alias(f"macro_{c}") for c in ("precision", "recall", "f1")],
        *[mean(c).alias(f"weighted_{c}") for c in ("precision", "recall", "f1")],
    )


def confusion(rows: DataFrame, truth: str, predicted: str) -> DataFrame:
    """(truth, predicted, n, ratio of the truth's row, annotation)."""
    cells = rows.groupBy(F.col(truth).alias("truth"), F.col(predicted).alias("predicted")).agg(F.count("*").alias("n"))
    share = F.col("n") / F.sum("n").over(Window.partitionBy("truth"))
    return cells.withColumn("ratio", share).withColumn("annotation", F.concat(F.col("n").cast("string"), F.lit(" ("), F.round(share * 100, 1).cast("string"), F.lit("%)")))


def quadratic_kappa(rows: DataFrame, truth: str, predicted: str) -> DataFrame:
    """Quadratic-weighted agreement; classes count by their place among those that occur."""
    cells = rows.groupBy(F.col(truth).alias("t"), F.col(predicted).alias("p")).agg(F.count("*").cast("double").alias("o"))
    seen = cells.select(F.col("t").alias("c")).union(cells.select("p")).distinct()
    place = seen.select("c", F.row_number().over(Window.orderBy("c")).alias("i"))  # as many rows as classes
    rows_sum = cells.groupBy("t").agg(F.sum("o").alias("r"))
    cols_sum = cells.groupBy("p").agg(F.sum("o").alias("k"))
    total = cells.agg(F.sum("o").alias("n"))
    grid = rows_sum.crossJoin(cols_sum).crossJoin(total).join(cells, ["t", "p"], "left")
    grid = grid.join(place.select(F.col("c").alias("t"), F.col("i").alias("ti")), "t").join(place.select(F.col("c").alias("p"), F.col("i").alias("pi")), "p")
    w = F.pow(F.col("ti") - F.col("pi"), F.lit(2.0))
    return grid.agg((1 - F.try_divide(F.sum(w * F.coalesce("o", F.lit(0.0))), F.sum(w * F.col("r") * F.col("k") / F.col("n")))).alias("kappa"))


def mean_sem(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Mean and standard error (population deviation over the root of the count)."""
    return rows.groupBy(*keys).agg(F.avg(value).alias("mean"), (F.stddev_pop(value) / F.sqrt(F.count(value))).alias("sem"), F.count(value).alias("n"))


def complete_cases(rows: DataFrame, unit: list[str], value: str, expected: int) -> DataFrame:
    """Rows of the units that have a value for each of `expected` combinations."""
    whole = rows.groupBy(*unit).agg(F.count(value).alias("__n")).filter(F.col("__n") == expected).select(*unit)
    return rows.join(whole, unit, "left_semi")


def spearman(rows: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """Rank correlation with average ranks; null where either side is constant."""

    def average_rank(c: str):
        less = F.rank().over(Window.partitionBy(*keys).orderBy(c))
        ties = F.count("*").over(Window.partitionBy(*keys, c))
        return less + (ties - 1) / 2.0

    ranked = rows.withColumns({"rx": average_rank(x), "ry": average_rank(y)})
    return ranked.groupBy(*keys).agg(F.try_divide(F.covar_pop("rx", "ry"), F.stddev_pop("rx") * F.stddev_pop("ry")).alias("rho"))


def place_of(values: np.ndarray) -> np.ndarray:
    """The place of each value in its row, equal values sharing the mean of theirs."""
    order = np.argsort(values, axis=1, kind="stable")
    up, at = np.take_along_axis(values, order, 1), np.arange(values.shape[1])
    new = np.ones(up.shape, bool)
    new[:, 1:] = up[:, 1:] != up[:, :-1]
    first = np.maximum.accumulate(np.where(new, at, 0), axis=1)
    end = np.ones(up.shape, bool)
    end[:, :-1] = new[:, 1:]
    last = np.minimum.accumulate(np.where(end, at, len(at))[:, ::-1], axis=1)[:, ::-1]
    out = np.empty(up.shape)
    np.put_along_axis(out, order, (first + last) / 2 + 1, 1)
    return out


def rank_correlation(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Spearman's coefficient of each row of x with that of y; NaN where either is constant."""
    a, b = (r - r.mean(1, keepdims=True) for r in (place_of(x), place_of(y)))
    with np.errstate(divide="ignore", invalid="ignore"):
        return (a * b).sum(1) / (np.sqrt((a * a).sum(1)) * np.sqrt((b * b).sum(1)))


def log_prob(logit):
    """log p of a probability given as a logit."""
    return -F.log1p(F.exp(-logit))


def slice_log_prob(logits):
    """Log-probability of a slice of tokens from an array of their logits."""
    return F.aggregate(logits, F.lit(0.0), lambda a, x: a + log_prob(x))


def citation_quality(statements: DataFrame, citations: DataFrame, unit: str, statement: str) -> DataFrame:
    """(unit, recall, precision, f1): a statement counts its support if cited, else one minus its need for a citation; units without statements or citations score 0.

    statements has a row a statement. Citations are read once: their counts and sums by statement give both means.
    """
    cited = citations.filter(F.col(unit).isNotNull()).groupBy(unit, statement).agg(F.count("*").alias("n_cit"), F.sum("relevance").alias("relevant"), F.count("relevance").alias("judged"))
    rows = statements.withColumn("there", F.lit(True)).join(cited, [unit, statement], "full")
    value = F.when(F.coalesce("n_cit", F.lit(0)) > 0, F.col("support")).otherwise(1 - F.col("need"))
    means = rows.groupBy(unit).agg(
        F.count("there").alias("there"),
        F.coalesce(F.avg(F.when(F.col("there"), value)), F.lit(0.0)).alias("recall"),
        F.coalesce(F.try_divide(F.sum("relevant"), F.sum("judged")), F.lit(0.0)).alias("precision"),
    )
    r, p = F.col("recall"), F.col("precision")
    return means.filter("there > 0").select(unit, "recall", "precision", F.when(r + p == 0, 0.0).otherwise(2 * r * p / (r + p)).alias("f1"))


def class_scores(cells: list[list[Column]]) -> list[dict[str, Column]]:
    """precision, recall, f1 (0 where undefined) and support of each class, from the counts cells[truth][prediction]."""
    total = lambda xs: sum(xs[1:], xs[0])
    ratio = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))
    out = []
    for c, row in enumerate(cells):
        support, said = total(row), total([r[c] for r in cells])
        out.append({"precision": ratio(row[c], said), "recall": ratio(row[c], support), "f1": ratio(2 * row[c], support + said), "support": support})
    return out


def kappa_of(cells: list[list[Column]]) -> Column:
    """Quadratic-weighted agreement from the counts cells[truth][prediction]; classes count by their place among those that occur; null without disagreement to expect."""
    total = lambda xs: sum(xs[1:], xs[0])
    truth, said = [total(r).cast("double") for r in cells], [total([r[c] for r in cells]).cast("double") for c in range(len(cells))]
    place = [total([F.lit(0), *[(truth[b] + said[b] > 0).cast("int") for b in range(c)]]) for c in range(len(cells))]
    weight = lambda a, b: F.pow(place[a] - place[b], F.lit(2.0))
    grid = [(a, b) for a in range(len(cells)) for b in range(len(cells)) if a != b]
    seen, expected = total([weight(a, b) * cells[a][b] for a, b in grid]), total([weight(a, b) * truth[a] * said[b] for a, b in grid])
    return 1 - F.try_divide(seen * total(truth), expected)


def _cells(kept: Column, classes: int) -> list[list[Column]]:
    return [[F.count_if(kept & (F.col("t") == a) & (F.col("p") == b)) for b in range(classes)] for a in range(classes)]


def class_report(rows: DataFrame, keys: list[str], classes: int = 4) -> DataFrame:
    """(keys, cls, precision, recall, f1, support): a row for each of the keys and classes, of valid rows as `verification_report` takes them. One aggregation."""
    scores = class_scores(_cells(F.col("x").isNotNull(), classes))
    packed = rows.groupBy(*keys).agg(F.array(*[F.struct(F.lit(c).alias("cls"), *[v.alias(n) for n, v in s.items()]) for c, s in enumerate(scores)]).alias("cs"))
    return packed.select(*keys, F.explode("cs").alias("c")).select(*keys, "c.*")


def verification_report(rows: DataFrame, keys: list[str], nothing: int = 3) -> DataFrame:
    """One row for each of the keys. Rows: t (truth), p (prediction), ab (abstains), x (distribution of the ordinal classes).

    Rows without a distribution are dropped and counted as invalid. Accuracy, macro and support-weighted
    means are over all classes (an undefined ratio is 0), squared error, quadratic kappa and ranked probability score over rows where neither truth
    nor prediction is `nothing`. One aggregation, no join.
    """
    valid = F.col("x").isNotNull()
    ordinal = valid & ~F.col("ab") & (F.col("t") != nothing)
    t, p = F.col("t"), F.col("p")
    cdf = [F.get("x", F.lit(0)), F.get("x", F.lit(0)) + F.get("x", F.lit(1))]
    rps = sum((F.pow(F.when(t < c + 1, 1.0).otherwise(0.0) - cdf[c], F.lit(2.0)) for c in range(2)), F.lit(0.0)) / 2
    scores = class_scores(_cells(valid, nothing + 1))
    macro = lambda c: sum((s[c] for s in scores[1:]), scores[0][c]) / len(scores)
    weighted = lambda c: F.try_divide(sum((s[c] * s["support"] for s in scores[1:]), scores[0][c] * scores[0]["support"]), sum((s["support"] for s in scores[1:]), scores[0]["support"]))
    return rows.groupBy(*keys).agg(
        F.count_if(valid).alias("n"),
        F.count_if(~valid).alias("invalid"),
        F.count_if(valid & F.col("ab")).alias("abstained"),
        F.count_if(valid & (t == nothing)).alias("unanswerable"),
        F.count_if(valid & (F.col("ab") | (t == nothing))).alias("either"),
        F.avg(F.when(valid, (t == p).cast("double"))).alias("accuracy"),
        *[macro(c).alias(f"macro_{c}") for c in ("precision", "recall", "f1")],
        *[weighted(c).alias(f"weighted_{c}") for c in ("precision", "recall", "f1")],
        kappa_of(_cells(ordinal, nothing)).alias("kappa"),
        F.avg(F.when(ordinal, F.pow(t - p, F.lit(2.0)))).alias("mse"),
        F.avg(F.when(ordinal, rps)).alias("mean_rps"),
    )
