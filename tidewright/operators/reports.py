"""Reports: each is a query over episodes, frames, scores or decisions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewright.functions import kernels as K


def distribution(df: DataFrame, column: str, group: list[str] | None = None) -> DataFrame:
    """(group, n, low, median, high) of a column's values that are not NULL."""
    return df.groupBy(*(group or [])).agg(F.count(column).alias("n"), F.min(column).alias("low"), F.median(column).alias("median"), F.max(column).alias("high"))


def feature_profile(long: DataFrame) -> DataFrame:
    """Distribution of the finite values of each dimension of long frames."""
    return distribution(long.where(K.finite(F.col("x"))), "x", ["dof"])


def feature_coverage(frames: DataFrame, columns: list[str], episodes: int) -> DataFrame:
    """(feature, present, coverage, finite_fraction, low, high, mean) of scalar columns."""
    pairs = F.explode(F.create_map(*(x for c in columns for x in (F.lit(c), F.col(c).cast("double"))))).alias("feature", "x")
    long = frames.select("episode_index", pairs)
    good = F.when(K.finite(F.col("x")), F.col("x"))
    known = F.col("x").isNotNull()
    per = long.groupBy("feature", "episode_index").agg(F.count("x").alias("n"), F.count(good).alias("ok"), F.min(good).alias("low"), F.max(good).alias("high"), F.sum(good).alias("total"), F.max(known.cast("int")).alias("has"))
    return per.groupBy("feature").agg(F.sum("has").alias("present"), (F.sum("has") / F.lit(max(1, episodes))).alias("coverage"), F.try_divide(F.sum("ok"), F.sum("n")).alias("finite_fraction"), F.min("low").alias("low"), F.max("high").alias("high"), F.try_divide(F.sum("total"), F.sum("ok")).alias("mean"))


def length_histogram(lengths: DataFrame, column: str, buckets: int = 5) -> DataFrame:
    """(bucket, low, high, n): at most ``buckets`` equal-width buckets of whole numbers from the least to the greatest, each value in one."""
    span = lengths.agg(F.min(column).alias("a"), F.max(column).alias("b"))
    k = F.least(F.lit(buckets), F.col("b") - F.col("a") + 1)
    width = F.col("b") - F.col("a") + 1
    rows = lengths.crossJoin(F.broadcast(span)).withColumn("k", k).withColumn("bucket", F.floor((F.col(column) - F.col("a")) * F.col("k") / width).cast("int"))
    edge = lambda i: F.col("a") + F.ceil(i * width / F.col("k"))
    return rows.groupBy("bucket", edge(F.col("bucket")).cast("long").alias("low"), (edge(F.col("bucket") + 1) - 1).cast("long").alias("high")).agg(F.count("*").alias("n"))


def success_rate(episodes: DataFrame, label: str, group: list[str] | None = None) -> DataFrame:
    """Labels are true, false or unknown; the rate is over known ones."""
    yes, no = F.count(F.when(F.col(label), 1)), F.count(F.when(~F.col(label), 1))
    return episodes.groupBy(*(group or [])).agg(yes.alias("n_success"), no.alias("n_failure"), F.count(F.when(F.col(label).isNull(), 1)).alias("n_unknown"), F.try_divide(yes, yes + no).alias("rate"))


def task_counts(episodes: DataFrame, tasks: str) -> DataFrame:
    """An episode counts once for each of its tasks."""
    return episodes.select("episode_index", F.explode(F.array_distinct(tasks)).alias("task")).groupBy("task").agg(F.count("*").alias("n"))


def structural_tally(validity: DataFrame) -> DataFrame:
    """One row: valid, truncated, stalled and non-finite episodes."""
    return validity.agg(*(F.count(F.when(c, 1)).alias(n) for n, c in (("n_valid", F.col("is_valid")), ("n_truncated", F.col("truncated") > 0), ("n_stalled", F.col("stalled") > 0), ("n_nonfinite", F.col("nonfinite") > 0))))


def signal_report(scores: DataFrame) -> DataFrame:
    return scores.groupBy("signal", "higher_is_better").agg(F.count("value").alias("scored"), F.count(F.when(F.col("value").isNull(), 1)).alias("skipped"), F.min("value").alias("low"), F.median("value").alias("median"), F.max("value").alias("high"))


def all_skipped(scores: DataFrame) -> DataFrame:
    return scores.groupBy("signal").agg(F.every(F.col("value").isNull()).alias("all_skipped")).where("all_skipped").select("signal")


def quality_summary(decisions: DataFrame) -> DataFrame:
    kept, n = F.count(F.when(F.col("kept"), 1)), F.count("*")
    return decisions.agg(n.alias("n"), kept.alias("n_kept"), (n - kept).alias("n_removed"), F.try_divide(100.0 * (n - kept), n).alias("pct_removed"))


def worst_steps(steps: DataFrame, k: int = 3) -> DataFrame:
    """(episode_index, place, step, norm): the k steps of the greatest absolute value, earlier ones first on ties."""
    place = F.row_number().over(Window.partitionBy("episode_index").orderBy(F.abs("norm").desc(), "step"))
    return steps.where(K.finite(F.col("norm"))).withColumn("place", place).where(F.col("place") <= k).select("episode_index", "place", "step", "norm")


def compare(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row for two runs' decisions (episode_index, kept): kept in both, in either, flips, Jaccard (1 if both are empty)."""
    both = a.where("kept").select("episode_index", F.lit(1).alias("a")).join(b.where("kept").select("episode_index", F.lit(1).alias("b")), "episode_index", "full")
    shared, union = F.count(F.when(F.col("a").isNotNull() & F.col("b").isNotNull(), 1)), F.count("*")
    return both.agg(shared.alias("n_both"), union.alias("n_either"), F.count(F.when(F.col("b").isNull(), 1)).alias("only_a"), F.count(F.when(F.col("a").isNull(), 1)).alias("only_b"), F.coalesce(F.try_divide(shared, union), F.lit(1.0)).alias("jaccard"))


def diff(source: DataFrame, curated: DataFrame, key: str = "fingerprint") -> DataFrame:
    """Source episodes that the curated set does not have."""
    return source.join(curated.select(key).distinct(), key, "left_anti")


def diff_or_index(source: DataFrame, curated: DataFrame) -> DataFrame:
    """As ``diff`` by fingerprint; by episode_index if no curated episode has a fingerprint."""
    known = "fingerprint" in curated.columns and curated.where("fingerprint is not null and fingerprint <> ''").limit(1).count()
    return diff(source, curated, "fingerprint" if known else "episode_index")


def compare_signals(a: DataFrame, b: DataFrame) -> DataFrame:
    """(signal, scored_a, scored_b, median_a, median_b, delta) of two runs' scores; a signal of one run has nulls for the other."""
    one, two = (signal_report(x).select("signal", F.col("scored").alias(f"scored_{n}"), F.col("median").alias(f"median_{n}")) for x, n in ((a, "a"), (b, "b")))
    return one.join(two, "signal", "full").withColumn("delta", F.col("median_b") - F.col("median_a"))


def length_confound(decisions: DataFrame, lengths: DataFrame) -> DataFrame:
    """(kept, n, mean_steps): whether a selection only picks short or long episodes."""
    return decisions.select("episode_index", "kept").join(lengths.select("episode_index", "n_steps"), "episode_index").groupBy("kept").agg(F.count("*").alias("n"), F.avg("n_steps").alias("mean_steps"))


def box(scores: DataFrame, groups: DataFrame, group: str) -> DataFrame:
    """(signal, group, n, low, q1, median, q3, high): what a box plot of each signal by group shows."""
    rows = scores.where(K.finite(F.col("value"))).join(groups.select("episode_index", group), "episode_index")
    quartiles = rows.groupBy("signal", group).agg(F.count("*").alias("n"), F.min("value").alias("low"), F.percentile("value", [0.25, 0.5, 0.75]).alias("q"), F.max("value").alias("high"))
    return quartiles.select("signal", group, "n", "low", *(F.get("q", i).alias(n) for i, n in enumerate(("q1", "median", "q3"))), "high")


def verify(expected: DataFrame, found: DataFrame) -> DataFrame:
    """Rows (episode_index, problem) in which two runs' decisions (episode_index, kept, reason) do not agree."""
    e, f = expected.select("episode_index", F.col("kept").alias("ek"), F.col("reason").alias("er")), found.select("episode_index", F.col("kept").alias("fk"), F.col("reason").alias("fr"))
    problem = F.when(F.col("ek").isNull(), "not expected").when(F.col("fk").isNull(), "missing").when(F.col("ek") != F.col("fk"), "kept differs").when(~F.col("er").eqNullSafe(F.col("fr")), "reason differs")
    return e.join(f, "episode_index", "full").select("episode_index", problem.alias("problem")).where("problem is not null")


def step_summary(steps: DataFrame) -> DataFrame:
    """(episode_index, low, median, high) of the finite step values."""
    return distribution(steps.where(K.finite(F.col("norm"))), "norm", ["episode_index"]).drop("n")


def action_roughness(frames: DataFrame, source: str = "action") -> DataFrame:
    """One row: the mean over episodes of the mean absolute second difference, negated; higher is smoother."""
    twice = K.difference(K.difference(K.to_long(frames, source)))
    return twice.groupBy("episode_index").agg(F.avg(F.abs("x")).alias("m")).agg((-F.avg("m")).alias("quality"))


def health(frames: DataFrame, validity: DataFrame, columns: list[str], unreadable: dict[str, str] | None = None) -> dict:
    """What a dataset check found: coverage of features, structural defects, unreadable files."""
    n = validity.count()
    return {
        "episodes": n,
        "coverage": [r.asDict() for r in feature_coverage(frames, columns, n).orderBy("feature").collect()],
        "structure": structural_tally(validity).first().asDict(),
        "defects": [r.episode_index for r in validity.where("not is_valid").select("episode_index").orderBy("episode_index").toLocalIterator()],
        "unreadable": unreadable or {},
    }


def health_markdown(found: dict) -> str:
    s = found["structure"]
    lines = ["# Dataset health", "", f"{found['episodes']} episodes: {s['n_valid']} valid, {s['n_truncated']} truncated, {s['n_stalled']} stalled, {s['n_nonfinite']} not finite.", "", "| feature | episodes | coverage | finite | min | max | mean |", "| --- | --- | --- | --- | --- | --- | --- |"]
    shown = lambda v: "–" if v is None else f"{v:.4g}"
    lines += [f"| {r['feature']} | {r['present']} | {shown(r['coverage'])} | {shown(r['finite_fraction'])} | {shown(r['low'])} | {shown(r['high'])} | {shown(r['mean'])} |" for r in found["coverage"]]
    lines += [f"- {file}: {why}" for file, why in sorted(found["unreadable"].items())]
    return "\n".join([*lines, ""])


def removed_by_group(decisions: DataFrame, groups: DataFrame, group: str) -> DataFrame:
    """(group, n, removed, share, enrichment): each group's share of the removed against its share of all."""
    rows = decisions.join(groups.select("episode_index", group), "episode_index")
    per = rows.groupBy(group).agg(F.count("*").alias("n"), F.count(F.when(~F.col("kept"), 1)).alias("removed"))
    total = rows.agg(F.count("*").alias("all_n"), F.count(F.when(~F.col("kept"), 1)).alias("all_removed"))
    share = F.try_divide("removed", "all_removed")
    return per.crossJoin(F.broadcast(total)).select(group, "n", "removed", share.alias("share"), F.try_divide(share, F.col("n") / F.col("all_n")).alias("enrichment"))
