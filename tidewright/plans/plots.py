"""Optional pictures of a run; bins are counted in Spark, matplotlib only draws them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def histogram(scores: DataFrame, bins: int = 20) -> DataFrame:
    """(signal, bin, low, high, n) of equal-width bins of each signal's values."""
    known = scores.where("value is not null and not isnan(value)")
    span = known.groupBy("signal").agg(F.min("value").alias("a"), F.max("value").alias("b"))
    rows = known.join(F.broadcast(span), "signal")
    place = F.when(F.col("b") > F.col("a"), F.least(F.lit(bins - 1), F.floor((F.col("value") - F.col("a")) / (F.col("b") - F.col("a")) * bins))).otherwise(0).cast("int")
    width = (F.col("b") - F.col("a")) / bins
    return rows.groupBy("signal", place.alias("bin"), "a", width.alias("w")).agg(F.count("*").alias("n")).select("signal", "bin", (F.col("a") + F.col("bin") * F.col("w")).alias("low"), (F.col("a") + (F.col("bin") + 1) * F.col("w")).alias("high"), "n")


def save_histograms(scores: DataFrame, path: str, bins: int = 20) -> None:
    try:
        import matplotlib

        matplotlib.use("Agg")
        from matplotlib import pyplot
    except ImportError as missing:
        raise ImportError("pictures need the package matplotlib") from missing
    rows = histogram(scores, bins).orderBy("signal", "bin").collect()
    names = sorted({r.signal for r in rows})
    figure, axes = pyplot.subplots(len(names), 1, squeeze=False, figsize=(6, 2.5 * len(names)))
    for axis, name in zip(axes[:, 0], names):
        own = [r for r in rows if r.signal == name]
        axis.bar([r.low for r in own], [r.n for r in own], width=[max(r.high - r.low, 1e-9) for r in own], align="edge")
        axis.set_title(name)
    figure.tight_layout()
    figure.savefig(path)
