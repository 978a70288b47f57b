"""Window kernels over long frames: one row per (episode_index, step, dof) with time t and value x.

Every window has episode_index as its first partition key, so a chain of them needs one shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec



def series() -> WindowSpec:
    return Window.partitionBy("episode_index", "dof")


def ordered() -> WindowSpec:
    return series().orderBy("step")


def finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))


def cut(df: DataFrame) -> DataFrame:
    """Compute once, in the shared folder that the session names, as it has to on a cluster; later stages survive lost executors."""
    spark = df.sparkSession
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", "/tmp/checkpoints/tidewright" if spark.sparkContext.master.startswith("local") else None)
        if not folder:
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


def in_order(df: DataFrame, *order: Column, total: str | None = None) -> DataFrame:
    """Adds ``rank`` (from 1) in a total order, and with ``total`` the sum of that column over the rows before, as ``before``.

    Rows are dealt out in ranges of the order; only one row per range passes through a single task.
    """
    value = F.col(total) if total else F.lit(0)
    # computed once: both uses below must see the same ranges
    parts = cut(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    sums = parts.groupBy("_part").agg(F.count("*").alias("_n"), F.sum(value).alias("_v"))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    start = sums.select("_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_rank"), F.coalesce(F.sum("_v").over(earlier), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("_part").orderBy(*order)
    placed = parts.withColumns({"_i": F.row_number().over(inside), "_b": F.coalesce(F.sum(value).over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))}).join(F.broadcast(start), "_part")
    out = placed.withColumn("rank", F.col("_i") + F.col("_rank"))
    return (out.withColumn("before", F.col("_b") + F.col("_before")) if total else out).drop("_part", "_i", "_b", "_rank", "_before")


def to_long(frames: DataFrame, column: str, dims: tuple[int, int | None] = (0, None)) -> DataFrame:
    """Explode an array column of frames (episode_index, step, t, ...) into one row per dimension in ``dims``."""
    start, stop = dims
    values = F.col(column) if stop is None and not start else F.slice(column, start + 1, (stop - start) if stop is not None else F.greatest(F.size(column) - start, F.lit(0)))
    return frames.select("episode_index", "step", "t", F.posexplode(values).alias("dof", "x")).withColumn("x", F.col("x").cast("double"))


def znorm(long: DataFrame) -> DataFrame:
    """x standardised within its series; a series that is constant or not finite becomes zero."""
    ok = F.min(finite(F.col("x")).cast("int")).over(series()) == 1
    mean, std = F.avg("x").over(series()), F.stddev_pop("x").over(series())
    return long.withColumns({"ok": ok, "mean": mean, "std": std}).withColumn("x", F.when(F.col("ok") & (F.col("std") > 0), (F.col("x") - F.col("mean")) / F.col("std")).otherwise(0.0)).drop("ok", "mean", "std")


def gradient(long: DataFrame) -> DataFrame:
    """dx/dt: second-order central differences for any spacing inside, one-sided at the ends."""
    around = long.withColumns({n: f(c).over(ordered()) for n, f, c in (("x0", F.lag, "x"), ("x2", F.lead, "x"), ("t0", F.lag, "t"), ("t2", F.lead, "t"))})
    x, t = F.col("x"), F.col("t")
    a, b = t - F.col("t0"), F.col("t2") - t
    inner = F.try_divide(a * a * F.col("x2") + (b * b - a * a) * x - b * b * F.col("x0"), a * b * (a + b))
    d = F.when(F.col("x0").isNull(), F.try_divide(F.col("x2") - x, b)).when(F.col("x2").isNull(), F.try_divide(x - F.col("x0"), a)).otherwise(inner)
    return around.withColumn("x", d).drop("x0", "x2", "t0", "t2")


def median_filter(long: DataFrame, window: int = 3) -> DataFrame:
    """Adds ``smooth``: the centred running median of x, ends padded with the end values."""
    half = window // 2
    near = [F.coalesce(F.lag("x", k).over(ordered()), F.first("x").over(ordered())) for k in range(half, 0, -1)] + [F.col("x")] + [F.coalesce(F.lead("x", k).over(ordered()), F.last("x").over(ordered().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))) for k in range(1, half + 1)]
    return long.withColumn("smooth", F.get(F.array_sort(F.array(*near)), half))


def difference(long: DataFrame) -> DataFrame:
    """x minus the x before it; the first step of a series goes."""
    return long.withColumn("x", F.col("x") - F.lag("x").over(ordered())).where("x is not null")


def step_norms(long: DataFrame) -> DataFrame:
    """(episode_index, step, t, norm): the Euclidean norm over the dimensions of each step."""
    return long.groupBy("episode_index", "step").agg(F.min("t").alias("t"), F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))


#: Rank error of the quantiles that bracket a median is one in so many; the brackets are five times as wide.
MEDIAN_ACCURACY = 10_000


def medians(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row: the exact median of each column's values that are not NULL.

    Approximate quantiles bracket it, and only values in the bracket, about one in a thousand, are counted
    by value and put in order, so no task holds the distinct values of a column.
    """
    long = df.select(F.posexplode(F.array(*(F.col(c).cast("double") for c in columns))).alias("i", "x")).where("x is not null")
    near = long.groupBy("i").agg(F.percentile_approx("x", [0.4995, 0.5005], MEDIAN_ACCURACY).alias("q"), F.count("*").alias("n"))
    near = near.select("i", "n", F.get("q", 0).alias("lo"), F.get("q", 1).alias("hi"))
    x = F.col("x")
    place = F.when(x < F.col("lo"), F.lit(float("-inf"))).when(x > F.col("hi"), F.lit(float("inf"))).otherwise(x)
    counted = long.join(F.broadcast(near), "i").groupBy("i", "n", place.alias("x")).agg(F.count("*").alias("c"))
    upto = F.sum("c").over(Window.partitionBy("i").orderBy("x"))
    # the two middle places, which are one for odd counts
    first, second = F.floor((F.col("n") + 1) / 2), F.floor(F.col("n") / 2) + 1
    held = counted.withColumn("upto", upto).withColumn("before", F.col("upto") - F.col("c"))
    here = lambda rank: F.max(F.when((F.col("before") < rank) & (rank <= F.col("upto")), F.col("x")))
    found = held.groupBy("i").agg(((here(first) + here(second)) / 2).alias("m"))
    return found.agg(*(F.max(F.when(F.col("i") == k, F.col("m"))).alias(c) for k, c in enumerate(columns)))


def median_mad(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row: median, MAD, mean and population deviation of each column's finite values, as c_median, c_mad, c_mean, c_std."""
    good = df.select(*(F.when(finite(F.col(c)), F.col(c)).alias(c) for c in columns))
    good = cut(good)  # read four times
    middle = medians(good, columns).select(*(F.col(c).alias(f"{c}_median") for c in columns))
    first = cut(middle.crossJoin(F.broadcast(good.agg(*(f(c).alias(f"{c}_{n}") for c in columns for n, f in (("mean", F.avg), ("std", F.stddev_pop)))))))
    spread = medians(good.crossJoin(F.broadcast(first)).select(*(F.abs(F.col(c) - F.col(f"{c}_median")).alias(c) for c in columns)), columns)
    return first.crossJoin(F.broadcast(spread.select(*(F.col(c).alias(f"{c}_mad") for c in columns))))


def robust_z(value: Column, median: Column, mad: Column, mean: Column, std: Column) -> Column:
    """0.6745 (v - median) / MAD; by mean and deviation if MAD is 0; 0 if that is, too."""
    return F.when(mad > 0, 0.6745 * (value - median) / mad).when(std > 0, (value - mean) / std).otherwise(0.0)


def minmax_keep(scores: DataFrame) -> DataFrame:
    """Adds ``norm``: the value scaled to 0..1 within its signal so that 1 is best; constant signals and missing values get one half.

    The ends of each signal are aggregated first and joined to its rows, so a signal is dealt over all tasks.
    """
    known = F.when(finite(F.col("value")), F.col("value"))
    ends = scores.groupBy(F.col("signal").alias("_of")).agg(F.min(known).alias("_low"), F.max(known).alias("_high"))
    low, high = F.col("_low"), F.col("_high")
    scaled = (known - low) / (high - low)
    norm = F.when(known.isNull() | (high <= low), 0.5).when(F.col("higher_is_better"), scaled).otherwise(1 - scaled)
    return scores.join(ends, scores["signal"].eqNullSafe(ends["_of"])).withColumn("norm", norm).drop("_of", "_low", "_high")
