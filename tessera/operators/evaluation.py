"""Scoring against labelled data: set precision and recall, calibration, coverage, greedy matching."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed value: a run passes from this F1.
PASS_F1 = 0.8


def rates(hit: Column, predicted: Column, expected: Column, empty: str = "sets") -> tuple[Column, Column, Column]:
    """Precision, recall and F1 from counts.

    ``sets``: nothing on either side is 1, 1, 1; nothing predicted is 1, 0; nothing expected is 0, 1.
    ``counts``: an empty denominator is 1.  ``tables``: one empty side is 0, 0.
    """
    none = (predicted == 0) & (expected == 0)
    miss = {"sets": (1.0, 0.0), "counts": (1.0, 0.0), "tables": (0.0, 0.0)}[empty]
    spare = {"sets": (0.0, 1.0), "counts": (0.0, 1.0), "tables": (0.0, 0.0)}[empty]
    p = F.when(none, 1.0).when(predicted == 0, miss[0]).when(expected == 0, spare[0]).otherwise(hit / predicted)
    r = F.when(none, 1.0).when(predicted == 0, miss[1]).when(expected == 0, spare[1]).otherwise(hit / expected)
    return p, r, F.when(none, 1.0).when(p + r == 0, 0.0).otherwise(2 * p * r / (p + r))


def set_scores(rows: DataFrame, group: list[str], predicted: Column, expected: Column) -> DataFrame:
    """Scores by group over rows with two flags."""
    counts = rows.groupBy(*group).agg(F.count_if(predicted & expected).alias("hit"), F.count_if(predicted).alias("predicted"), F.count_if(expected).alias("expected"))
    p, r, f = rates(F.col("hit"), F.col("predicted"), F.col("expected"))
    return counts.select(*group, "hit", "predicted", "expected", F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(f, 6).alias("f1"))


def brier(rows: DataFrame, group: list[str], confidence: Column, correct: Column) -> DataFrame:
    """Mean squared error of confidences from 0 to 1."""
    fit = (confidence >= 0) & (confidence <= 1)
    return rows.where(fit).groupBy(*group).agg(F.round(F.avg(F.pow(confidence - correct.cast("double"), F.lit(2.0))), 6).alias("brier"), F.count("*").alias("n"))


def calibration_grid(rows: DataFrame, confidence: str, correct: str, alphas: list[float], betas: list[float], gammas: list[float], prior: str, sources: str) -> DataFrame:
    """The coefficients of the least Brier score, the first in order of the grid.

    The grid is a literal array, so rows are exploded by its fixed size and summed at once.
    """
    grid = [(i, a, b, g) for i, (a, b, g) in enumerate((a, b, g) for a in alphas for b in betas for g in gammas)]
    cells = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(a).alias("alpha"), F.lit(b).alias("beta"), F.lit(g).alias("gamma")) for i, a, b, g in grid))
    x = F.col("g.alpha") * (F.col(confidence) - 0.5) + F.col("g.beta") * F.col(prior) + F.col("g.gamma") * F.log(1 + F.greatest(F.lit(0), F.col(sources) - 1))
    error = F.pow(1 / (1 + F.exp(-x)) - F.col(correct), F.lit(2.0))
    scored = rows.withColumn("g", F.explode(cells)).groupBy("g").agg(F.round(F.avg(error), 9).alias("brier"))
    return scored.orderBy("brier", "g.i").limit(1).select("g.alpha", "g.beta", "g.gamma", "brier")


def coverage(expected: DataFrame, actual: DataFrame, key: str, value: str) -> DataFrame:
    """By key: distinct expected, actual and shared values, compared trimmed and lowered."""
    flat = F.lower(F.trim(F.col(value)))
    a, b = expected.select(key, flat.alias("v")).distinct(), actual.select(key, flat.alias("v")).distinct()
    both = a.withColumn("e", F.lit(1)).join(b.withColumn("a", F.lit(1)), [key, "v"], "full")
    return both.groupBy(key).agg(F.count("e").alias("n_expected"), F.count("a").alias("n_actual"), F.count_if(F.col("e").isNotNull() & F.col("a").isNotNull()).alias("n_shared"))


def greedy_pairs(scored: DataFrame, group: str, left: str, right: str, score: str, least: float) -> DataFrame:
    """One-to-one pairs by descending score within each group; ties by ids."""
    kinds = dict(scored.dtypes)

    def take(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows[rows[score] >= least].sort_values([score, left, right], ascending=[False, True, True])
        used_left, used_right, out = set(), set(), []
        for row in rows.to_dict("records"):
            if row[left] not in used_left and row[right] not in used_right:
                used_left.add(row[left])
                used_right.add(row[right])
                out.append(row)
        return pd.DataFrame(out, columns=list(rows.columns))

    return scored.select(group, left, right, score).groupBy(group).applyInPandas(take, ", ".join(f"{c} {kinds[c]}" for c in (group, left, right, score)))


def free_pairs(rows: DataFrame, group: str, left: str, right: str, more: Sequence[str] = (), allowed: tuple[str, str] | None = None) -> DataFrame:
    """Of each row's pairs, in their order, those whose ``left`` and ``right`` no earlier chosen pair of the row has.

    A row's pairs stand in arrays of equal length (``left``, ``right`` and ``more``).  With ``allowed``, the names of two
    further such arrays, pairs that aren't among theirs are passed over.  Null arrays are as good as empty; nothing is shuffled.
    """
    names, other, kinds = [left, right, *more], list(allowed or ()), dict(rows.dtypes)

    def take(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for own in batches:
            out = []
            for key, *columns in zip(own[group], *(own[n] for n in names + other)):
                columns = [[] if c is None else c.tolist() for c in columns]
                used_left, used_right, known = set(), set(), set(zip(*columns[len(names):])) if other else None
                for pair in zip(*columns[:len(names)]):
                    if pair[0] not in used_left and pair[1] not in used_right and (known is None or pair[:2] in known):
                        used_left.add(pair[0])
                        used_right.add(pair[1])
                        out.append((key, *pair))
            yield pd.DataFrame(out, columns=[group, *names])

    of_one = ", ".join(f"{n} {kinds[n].removeprefix('array<')[:-1]}" for n in names)
    return rows.select(group, *names, *other).mapInPandas(take, f"{group} {kinds[group]}, {of_one}")


def delta(before: DataFrame, after: DataFrame, key: str, metric: str) -> DataFrame:
    """Both metrics and their difference by key; null where either is missing."""
    a, b = before.select(key, F.col(metric).alias("before")), after.select(key, F.col(metric).alias("after"))
    return a.join(b, key, "full").select(key, "before", "after", F.round(F.col("after") - F.col("before"), 6).alias("delta"))


def priors(rows: DataFrame, keys: list[str], actual: str, least: int = 3) -> DataFrame:
    """By keys: the mean of ``actual`` less the mean over all rows; groups under ``least`` rows have no prior."""
    sums = rows.groupBy(*keys).agg(F.sum(actual).alias("s"), F.count("*").alias("n"))
    whole = sums.agg((F.sum("s") / F.sum("n")).alias("mean"))  # one row
    return sums.where(F.col("n") >= least).crossJoin(whole).select(*keys, F.round(F.col("s") / F.col("n") - F.col("mean"), 6).alias("prior"))


def progress(annotations: DataFrame, group: str) -> DataFrame:
    """By group: open, answered and finalized annotations, and open questions."""
    status, question = F.col("status"), F.col("is_question")
    counts = (("open", (status == "open") & ~question), ("answered", status == "answered"), ("finalized", status == "finalized"), ("open_questions", (status == "open") & question))
    return annotations.groupBy(group).agg(*(F.count_if(test).alias(name) for name, test in counts))
