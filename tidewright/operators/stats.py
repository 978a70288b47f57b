"""Statistics of scores and experiments: AUC, rank correlation, bootstrap, paired effects, control arms."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewright.functions import kernels as K

#: AUC at which a signal detects, inverts, or is blind.
DETECTS, INVERTS, BLIND = 0.7, 0.3, (0.4, 0.6)


def rank_auc(df: DataFrame, group: list[str], positive: str, value: str) -> DataFrame:
    """(group, n_pos, n_neg, auc): probability that a positive row has the larger value, ties one half; NULL without both.

    Counts of each value come first; the ranking then runs over distinct values.
    """
    good = df.where(K.finite(F.col(value)))
    counts = good.groupBy(*group, value).agg(F.sum(F.col(positive).cast("int")).alias("p"), F.sum((~F.col(positive)).cast("int")).alias("n"))
    below = F.coalesce(F.sum("n").over(Window.partitionBy(*group).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    wins = counts.withColumn("u", F.col("p") * (below + F.col("n") / 2))
    return wins.groupBy(*group).agg(F.sum("p").alias("n_pos"), F.sum("n").alias("n_neg"), F.try_divide(F.sum("u"), F.sum("p") * F.sum("n")).alias("auc"))


def detection_class(auc: float | None) -> str:
    if auc is None or auc != auc:
        return "skip"
    return "detects" if auc >= DETECTS else "inverts" if auc <= INVERTS else "blind" if BLIND[0] <= auc <= BLIND[1] else "weak"


def spearman(df: DataFrame, group: list[str], a: str, b: str, order: str) -> DataFrame:
    """(group, n, rho): correlation of ordinal ranks (equal values in the order of ``order``); NULL for fewer than three finite pairs."""
    good = df.where(K.finite(F.col(a)) & K.finite(F.col(b)))
    rank = lambda c: F.row_number().over(Window.partitionBy(*group).orderBy(c, order))
    ranked = good.withColumns({"ra": rank(a), "rb": rank(b)})
    return ranked.groupBy(*group).agg(F.count("*").alias("n"), F.when(F.count("*") >= 3, F.corr("ra", "rb")).alias("rho"))


@dataclass(frozen=True)
class Effect:
    mean: float
    low: float
    high: float
    n: int

    @property
    def separated(self) -> bool:
        return self.low > 0 or self.high < 0


def bootstrap(values: list[float], resamples: int = 2000, confidence: float = 0.95, seed: int = 0) -> Effect:
    """Mean with a percentile interval; a single value is its own interval."""
    x = np.asarray(values, float)
    if len(x) == 0:
        return Effect(float("nan"), float("nan"), float("nan"), 0)
    if len(x) == 1:
        return Effect(float(x[0]), float(x[0]), float(x[0]), 1)
    draws = x[np.random.default_rng(seed).integers(0, len(x), (resamples, len(x)))].mean(1)
    tail = 50 * (1 - confidence)
    low, high = np.percentile(draws, [tail, 100 - tail])
    return Effect(float(x.mean()), float(low), float(high), len(x))


def paired_effect(treatment: list[float], baseline: list[float], **more) -> Effect:
    if len(treatment) != len(baseline):
        raise ValueError("paired arms have as many values each")
    return bootstrap([a - b for a, b in zip(treatment, baseline)], **more)


def paired_delta(runs: DataFrame, treatment: str, baseline: str) -> DataFrame:
    """One row: mean difference by seed, and twice its standard error, of runs (arm, seed, value)."""
    a = runs.where(F.col("arm") == treatment).select("seed", F.col("value").alias("a"))
    b = runs.where(F.col("arm") == baseline).select("seed", F.col("value").alias("b"))
    d = a.join(b, "seed").select((F.col("a") - F.col("b")).alias("d"))
    half = 2 * F.sqrt(F.var_samp("d") / F.count("*"))
    return d.agg(F.count("*").alias("n"), F.avg("d").alias("delta"), half.alias("half_width")).withColumn("separated", F.coalesce(F.col("delta") - F.col("half_width") > 0, F.lit(False)))


def split(n: int, fraction: float, seed: int) -> tuple[list[int], list[int]]:
    """(train, held out) positions: a seeded permutation, both sorted."""
    order = np.random.default_rng(seed).permutation(n)
    held = max(1, round(n * fraction))
    return sorted(map(int, order[held:])), sorted(map(int, order[:held]))


def length_matched(episodes: DataFrame, order: str, target: int) -> DataFrame:
    """Episodes in the order of a column until their steps reach the target; the one that crosses it is the last."""
    return K.in_order(episodes, F.col(order).asc(), total="n_steps").where(F.col("before") < target).drop("rank", "before")


def leaderboard(entries: DataFrame) -> DataFrame:
    """Entries (name, submitted_mean, ...) by mean, then name, with their place."""
    return K.in_order(entries, F.col("submitted_mean").asc(), F.col("name").asc()).withColumnRenamed("rank", "place")
