"""Quality signals: frames in, one score row per episode out.

frames: episode_index BIGINT, step INT, t DOUBLE, and array or scalar feature columns. Scores:
episode_index, signal, value (NULL if skipped), higher_is_better, skip_reason.
An episode that a signal cannot judge stays, as a skipped row with the reason.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewright.functions import kernels as K

#: Penalty of non-finite features, the share of a normal deviate in a MAD, the z of an outlier.
NONFINITE_PENALTY = 1e6
OUTLIER_Z = 3.5


@dataclass(frozen=True)
class Spec:
    name: str
    higher_is_better: bool
    per_transition: bool = False
    requires: tuple[str, ...] = ()
    deterministic: bool = True
    #: What an episode costs: "cheap" reads numbers, "video" reads pixels, "learned" trains a model.
    cost: str = "cheap"


def _scores(spec: Spec, rows: DataFrame, value: Column, skip: Column, *more: Column) -> DataFrame:
    return rows.select("episode_index", F.lit(spec.name).alias("signal"), F.when(skip.isNull(), value).cast("double").alias("value"), F.lit(spec.higher_is_better).alias("higher_is_better"), skip.cast("string").alias("skip_reason"), *more)


def _jerk_steps(frames: DataFrame, source: str, order: int) -> DataFrame:
    """(episode_index, step, norm, gap, timed, known): one row per step, also of episodes without the source."""
    gap = F.col("t") - F.lag("t").over(Window.partitionBy("episode_index").orderBy("step"))
    # the gap first: in one select Spark would explode before it looks back
    long = frames.withColumn("gap", gap).select("episode_index", "step", "t", "gap", F.posexplode_outer(source).alias("dof", "x")).withColumn("x", F.col("x").cast("double"))
    long = K.znorm(long)
    for _ in range(order):
        long = K.gradient(long)
    return long.groupBy("episode_index", "step").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"), F.min("gap").alias("gap"), F.count("t").alias("timed"), F.count("dof").alias("known"))


def jerk_steps(frames: DataFrame, source: str = "action", order: int = 2) -> DataFrame:
    """(episode_index, step, norm) of the ``order``-th time derivative of the standardised source."""
    return _jerk_steps(frames, source, order).select("episode_index", "step", "norm")


def jerk(frames: DataFrame, source: str = "action", order: int = 2) -> DataFrame:
    """Clock, derivatives and means come from one pass behind one shuffle."""
    spec = Spec("jerk", False, per_transition=True)
    rows = _jerk_steps(frames, source, order).groupBy("episode_index").agg(F.count("*").alias("n_steps"), F.coalesce(F.min("gap") > 0, F.lit(True)).alias("rising"), (F.min("timed") > 0).alias("timed"), (F.min("known") > 0).alias("known"), F.avg("norm").alias("v"), F.max("norm").alias("max_jerk"))
    skip = F.when(~F.col("known"), "no source").when(~F.col("timed"), "no time").when(F.col("n_steps") < order + 1, "too short").when(~F.col("rising"), "time does not increase")
    return _scores(spec, rows, F.col("v"), skip, F.when(skip.isNull(), F.col("max_jerk")).alias("max_jerk"))


def jitter(frames: DataFrame, source: str = "action", window: int = 3) -> DataFrame:
    """(episode_index, jitter): mean norm of the standardised source less its running median."""
    long = K.median_filter(K.znorm(K.to_long(frames, source)), window)
    return K.step_norms(long.withColumn("x", F.col("x") - F.col("smooth"))).groupBy("episode_index").agg(F.avg("norm").alias("jitter"))


SUMMARY = ["mean_abs", "mean_std", "jitter", "n_steps"]


def noise_summary(frames: DataFrame, source: str = "action", window: int = 3) -> DataFrame:
    """(episode_index, mean_abs, mean_std, jitter, n_steps) of the raw source."""
    per_dof = K.to_long(frames, source).groupBy("episode_index", "dof").agg(F.sum(F.abs("x")).alias("a"), F.count("*").alias("n"), F.stddev_pop("x").alias("s"))
    raw = per_dof.groupBy("episode_index").agg((F.sum("a") / F.sum("n")).alias("mean_abs"), F.avg("s").alias("mean_std"), F.max("n").cast("double").alias("n_steps"))
    return raw.join(jitter(frames, source, window), "episode_index")


def action_noise(frames: DataFrame, source: str = "action", window: int = 3) -> DataFrame:
    """The larger of the jitter's robust z and the largest absolute z of the summary; statistics are of the whole dataset."""
    spec = Spec("action_noise", False, per_transition=True)
    summary = noise_summary(frames, source, window)
    stats = K.median_mad(summary.where("n_steps >= 3"), SUMMARY)
    z = {c: K.robust_z(F.col(c), *(F.col(f"{c}_{s}") for s in ("median", "mad", "mean", "std"))) for c in SUMMARY}
    joined = summary.crossJoin(F.broadcast(stats)).withColumns({f"z_{c}": e for c, e in z.items()})
    outlier = F.greatest(*(F.abs(f"z_{c}") for c in SUMMARY))
    skip = F.when(F.col("n_steps") < 3, "too short")
    return _scores(spec, joined, F.greatest(F.col("z_jitter"), outlier), skip, F.col("jitter"), outlier.alias("outlier_z"), (outlier > OUTLIER_Z).alias("is_outlier"))


def _increments(frames: DataFrame, source: str, dims: tuple[int, int], motion: str) -> DataFrame:
    long = K.to_long(frames, source, dims)
    return K.difference(long) if motion == "positions" else long


def path_efficiency(frames: DataFrame, source: str = "action", dims: tuple[int, int] = (0, 3), motion: str = "increments") -> DataFrame:
    """Length of the net displacement over the length of the path; one pass behind one shuffle."""
    spec = Spec("path_efficiency", True)
    names = [f"_x{i}" for i in range(*dims)]
    moves = frames.select("episode_index", "step", *(F.get(source, i).cast("double").alias(f"_x{i}") for i in range(*dims)))
    if motion == "positions":
        earlier = Window.partitionBy("episode_index").orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
        moves = moves.withColumns({c: F.col(c) - F.last(c, ignorenulls=True).over(earlier) for c in names})
    square = lambda terms: sum((F.coalesce(x * x, F.lit(0.0)) for x in terms), F.lit(0.0))
    norm = F.when(F.coalesce(*names).isNotNull(), F.sqrt(square(map(F.col, names)))) if len(names) > 1 else F.abs(names[0])
    rows = moves.groupBy("episode_index").agg(F.count("*").alias("n_steps"), F.sum(norm).alias("path"), F.sqrt(square([F.sum(c) for c in names])).alias("net"))
    skip = F.when(F.col("n_steps") < 2, "too short").when(F.col("path").isNull(), "no source").when(F.col("path") < 1e-9, "no motion")
    return _scores(spec, rows, F.try_divide("net", "path"), skip)


def sparc(speed: np.ndarray, fs: float, cutoff: float = 10.0, threshold: float = 0.05, pad: int = 4) -> float | None:
    """Spectral arc length of a speed profile: minus the length of its normalised spectrum's curve; None if under two bins are left."""
    nfft = 2 ** (int(np.ceil(np.log2(len(speed)))) + pad)
    magnitude = np.abs(np.fft.rfft(speed, nfft))
    if not magnitude.max() > 0:
        return None
    f = np.arange(len(magnitude)) * (fs / nfft)
    low = f <= cutoff
    f, m = f[low], magnitude[low] / magnitude.max()
    strong = np.flatnonzero(m >= threshold)
    if not len(strong):
        return None
    f, m = f[strong[0] : strong[-1] + 1], m[strong[0] : strong[-1] + 1]
    if len(f) < 2:
        return None
    return float(-np.hypot(np.diff(f) / (f[-1] - f[0]), np.diff(m)).sum())


def spectral_smoothness(frames: DataFrame, source: str = "action", dims: tuple[int, int] = (0, 3), motion: str = "increments", cutoff: float = 10.0, threshold: float = 0.05) -> DataFrame:
    """Spectral arc length per episode; the FFT runs in Arrow-fed pandas, a group is one episode."""
    spec = Spec("spectral_smoothness", True)
    speed = K.step_norms(_increments(frames, source, dims, motion))

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("step")
        t, v = pdf["t"].to_numpy(), pdf["norm"].to_numpy()
        value, skip = None, None
        dt = np.diff(t)
        if len(v) < 4:
            skip = "too short"
        elif not np.isfinite(dt).all() or not (dt > 0).all():
            skip = "time does not increase"
        elif not np.isfinite(v).all() or not v.any():
            skip = "no motion"
        else:
            value = sparc(v, 1 / float(np.median(dt)), cutoff, threshold)
            skip = None if value is not None else "too few bins"
        return pd.DataFrame({"episode_index": [pdf["episode_index"].iloc[0]], "v": [value], "s": [skip]}).astype({"v": "float64", "s": "object"})

    rows = speed.groupBy("episode_index").applyInPandas(one, "episode_index long, v double, s string")
    return _scores(spec, rows, F.col("v"), F.col("s"))


EMBEDDING = ["n_steps", "action_mean", "action_std", "action_change", "state_mean", "state_std", "state_change"]


def statistical_embedding(frames: DataFrame, action: str = "action", state: str | None = None) -> DataFrame:
    """(episode_index, seven numbers): steps; mean and deviation of the norm and mean norm of its change, for action and for state (zeros if absent)."""
    out = frames.groupBy("episode_index").agg(F.count("*").cast("double").alias("n_steps"))
    for name, column in (("action", action), ("state", state)):
        if column is None:
            out = out.withColumns({f"{name}_{k}": F.lit(0.0) for k in ("mean", "std", "change")})
            continue
        # one shuffle: norms and norms of changes come from the same windows
        long = K.to_long(frames, column)
        long = long.withColumn("d", F.col("x") - F.lag("x").over(K.ordered()))
        steps = long.groupBy("episode_index", "step").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"), F.sqrt(F.sum(F.col("d") * F.col("d"))).alias("change"))
        stats = steps.groupBy("episode_index").agg(F.avg("norm").alias(f"{name}_mean"), F.stddev_pop("norm").alias(f"{name}_std"), F.coalesce(F.avg("change"), F.lit(0.0)).alias(f"{name}_change"))
        out = out.join(stats, "episode_index", "left").fillna(0.0, [f"{name}_{k}" for k in ("mean", "std", "change")])
    return out


def standardised_arrays(vectors: DataFrame) -> DataFrame:
    """As ``standardised``, of (episode_index, v array); arrays of other lengths than the longest are left out."""
    width = vectors.agg(F.max(F.size("v")).alias("n")).first().n or 0
    names = [f"d{i}" for i in range(width)]
    return standardised(vectors.select("episode_index", *(F.get("v", i).cast("double").alias(n) for i, n in enumerate(names))), names) if width else vectors.select("episode_index", "v").limit(0)


def standardised(vectors: DataFrame, columns: list[str]) -> DataFrame:
    """(episode_index, v): columns standardised over the dataset, constant ones by 1; episodes that are not finite are left out."""
    good = vectors.where(" and ".join(f"{c} is not null and not isnan({c}) and abs({c}) < double('infinity')" for c in columns))
    stats = good.agg(*(f(c).alias(f"{c}_{n}") for c in columns for n, f in (("m", F.avg), ("s", F.stddev_pop))))
    z = [(F.col(c) - F.col(f"{c}_m")) / F.when(F.col(f"{c}_s") > 0, F.col(f"{c}_s")).otherwise(1.0) for c in columns]
    return good.crossJoin(F.broadcast(stats)).select("episode_index", F.array(*z).alias("v"))


#: Vectors in a block of the nearest-neighbour search.
NEIGHBOUR_BLOCK = 2048


def nearest(vectors: DataFrame, k: int = 1, block: int = NEIGHBOUR_BLOCK) -> DataFrame:
    """(episode_index, distance): mean distance to the k nearest other vectors of (episode_index, v array<double>).

    Exact, so every vector meets every other; they meet in pairs of blocks, and a row goes out for a
    vector and block pair with its k least distances, never one for a pair of vectors.
    """
    n = vectors.count()
    blocks = max(1, -(-n // block))
    own = F.pmod(F.xxhash64("episode_index"), F.lit(blocks)).cast("int")
    dealt = vectors.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    dealt = dealt.withColumns({"lo": F.least("own", "other"), "hi": F.greatest("own", "other")})

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.array(pdf["v"].tolist(), float)
        ids, side = pdf["episode_index"].to_numpy(), pdf["own"].to_numpy()
        out = np.full((len(x), k), np.inf)
        same = pdf["lo"].iloc[0] == pdf["hi"].iloc[0]
        for at in range(0, len(x), 256):
            d = np.sqrt(((x[at : at + 256, None, :] - x[None, :, :]) ** 2).sum(2)) if x.shape[1] <= 16 else np.stack([np.sqrt(((x - row) ** 2).sum(1)) for row in x[at : at + 256]])
            d[np.arange(len(d)), at + np.arange(len(d))] = np.inf  # itself, once
            if not same:
                d[side[at : at + 256, None] == side[None, :]] = np.inf
            m = min(k, d.shape[1])
            out[at : at + len(d), :m] = np.sort(np.partition(d, m - 1, axis=1)[:, :m], axis=1)
        return pd.DataFrame({"episode_index": ids, "near": out.tolist()})

    met = dealt.groupBy("lo", "hi").applyInPandas(meet, "episode_index long, near array<double>")
    near = met.select("episode_index", F.explode("near").alias("d")).where(F.col("d") < float("inf"))
    # at most k rows for a vector and block
    best = near.groupBy("episode_index").agg(F.slice(F.array_sort(F.collect_list("d")), 1, k).alias("d"))
    return best.select("episode_index", (F.aggregate("d", F.lit(0.0), lambda a, x: a + x) / F.size("d")).alias("distance"))


def redundancy(vectors: DataFrame, k: int = 1) -> DataFrame:
    """Mean distance to the k nearest other episodes, over standardised vectors (episode_index, v)."""
    spec = Spec("redundancy", True)
    found = nearest(vectors, k)
    rows = vectors.select("episode_index").join(found, "episode_index", "left")
    return _scores(spec, rows, F.col("distance"), F.when(F.col("distance").isNull(), "no others"))


def structural_validity(frames: DataFrame, action: str = "action", state: str | None = None, fraction: float = 0.5, tolerance: float = 0.1, eps: float = 1e-8) -> DataFrame:
    """Truncation against the median length, plus stalling of the state, plus a penalty for values that are not finite."""
    spec = Spec("structural_validity", False)
    per_step = K.step_norms(K.difference(K.to_long(frames, state or action)))
    stall = per_step.groupBy("episode_index").agg(F.avg((F.col("norm") < eps).cast("double")).alias("still"))
    bad = lambda c: F.exists(F.col(c), lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    broken = [F.max(F.coalesce(bad(c), F.lit(True)).cast("int")) for c in {action, state or action}]
    lengths = frames.groupBy("episode_index").agg(F.count("*").alias("n_steps"), F.greatest(*broken, F.lit(0)).alias("nonfinite"))
    med = lengths.agg(F.median("n_steps").alias("med"))
    rows = lengths.join(stall, "episode_index", "left").crossJoin(F.broadcast(med))
    truncated = F.when(F.col("n_steps") < fraction * F.col("med"), (fraction * F.col("med") - F.col("n_steps")) / F.col("med")).otherwise(0.0)
    stalled = F.greatest(F.lit(0.0), F.coalesce("still", F.lit(0.0)) - tolerance)
    value = truncated + stalled + NONFINITE_PENALTY * F.col("nonfinite")
    return _scores(spec, rows, value, F.lit(None), truncated.alias("truncated"), stalled.alias("stalled"), F.col("nonfinite").alias("nonfinite"), (value == 0).alias("is_valid"))


def sim_validity(frames: DataFrame, penetration: str | None, positions: list[str], threshold: float = 0.005, max_step: float = 1.0) -> DataFrame:
    """Penetration over its threshold, plus the largest jump of a position over its limit, plus a penalty for values that are not finite."""
    spec = Spec("sim_physics_validity", False, per_transition=True)
    columns = [c for c in [penetration, *positions] if c]
    order = Window.partitionBy("episode_index").orderBy("step")
    flat = frames.withColumns({c: F.col(c).cast("double") if dict(frames.dtypes)[c] != "array<double>" else F.col(c) for c in columns})
    arrays = {c for c, kind in flat.dtypes if c in columns and kind.startswith("array")}
    whole = lambda c: F.forall(F.col(c), K.finite) if c in arrays else K.finite(F.col(c))
    jump = [F.sqrt(F.aggregate(F.zip_with(F.col(c), F.lag(c).over(order), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)) if c in arrays else F.abs(F.col(c) - F.lag(c).over(order)) for c in positions]
    step = flat.select("episode_index", (F.when(K.finite(F.col(penetration)), F.col(penetration)) if penetration else F.lit(0.0)).alias("pen"), (F.greatest(*jump, F.lit(0.0))).alias("jump"), F.greatest(*(F.when(whole(c), 0).otherwise(1) for c in columns), F.lit(0)).alias("bad"))
    rows = step.withColumn("jump", F.when(K.finite(F.col("jump")), F.col("jump"))).groupBy("episode_index").agg(F.max("pen").alias("pen"), F.max("jump").alias("jump"), F.max("bad").alias("bad"))
    over = lambda c, limit: F.greatest(F.lit(0.0), F.coalesce(F.col(c), F.lit(0.0)) - limit)
    return _scores(spec, rows, over("pen", threshold) + over("jump", max_step) + NONFINITE_PENALTY * F.col("bad"), F.lit(None), F.col("pen").alias("max_penetration"), F.col("jump").alias("max_jump"))


#: Luma weights of red, green and blue.
LUMA = np.array([0.299, 0.587, 0.114])


def _gray(frame: np.ndarray) -> np.ndarray:
    return frame[..., :3].astype(float) @ LUMA if frame.ndim == 3 else frame.astype(float)


def sharpness(frame: np.ndarray) -> float:
    """Variance of the 3 by 3 Laplacian of the luma, edges replicated."""
    g = np.pad(_gray(frame), 1, mode="edge")
    return float((g[:-2, 1:-1] + g[2:, 1:-1] + g[1:-1, :-2] + g[1:-1, 2:] - 4 * g[1:-1, 1:-1]).var())


def descriptor(frame: np.ndarray, thumb: int = 8, bins: int = 8) -> np.ndarray:
    """Block-mean luma thumbnail and normalised histograms of the colours."""
    g = _gray(frame) / 255
    rows = [np.array_split(r, thumb, axis=1) for r in np.array_split(g, thumb, axis=0)]
    small = np.array([[b.mean() if b.size else 0.0 for b in r] for r in rows])
    colours = frame.reshape(-1, frame.shape[-1])[:, :3] if frame.ndim == 3 else np.repeat(frame.reshape(-1, 1), 3, 1)
    hist = [np.histogram(colours[:, c], bins, (0, 256))[0] / max(1, len(colours)) for c in range(3)]
    return np.concatenate([small.ravel(), *hist])


def even_subset(n: int, most: int) -> np.ndarray:
    return np.arange(n) if n <= most else np.round(np.linspace(0, n - 1, most)).astype(int)


def _per_video(images: DataFrame, shape: tuple[int, int, int], most: int, fn: Callable[[list[np.ndarray]], object], result: str) -> DataFrame:
    """fn of the evenly chosen frames of each episode of (episode_index, step, frame BINARY)."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("step")
        chosen = [np.frombuffer(pdf["frame"].iloc[i], np.uint8).reshape(shape) for i in even_subset(len(pdf), most)]
        return pd.DataFrame({"episode_index": [pdf["episode_index"].iloc[0]], "v": [fn(chosen)]})

    return images.groupBy("episode_index").applyInPandas(one, f"episode_index long, v {result}")


def image_blur(images: DataFrame, shape: tuple[int, int, int], most: int = 16) -> DataFrame:
    spec = Spec("image_blur", False)
    rows = _per_video(images, shape, most, lambda fs: -float(np.mean([sharpness(f) for f in fs])), "double")
    return _scores(spec, rows, F.col("v"), F.lit(None))


def visual_stall(images: DataFrame, shape: tuple[int, int, int], most: int = 64, tolerance: float = 0.1, eps: float = 1.0) -> DataFrame:
    spec = Spec("visual_stall", False)

    def stalled(fs: list[np.ndarray]) -> float | None:
        if len(fs) < 2:
            return None
        change = [np.abs(b.astype(float) - a.astype(float)).mean() for a, b in zip(fs, fs[1:])]
        return max(0.0, float(np.mean(np.array(change) < eps)) - tolerance)

    rows = _per_video(images, shape, most, stalled, "double")
    return _scores(spec, rows, F.col("v"), F.when(F.col("v").isNull(), "too few frames"))


def visual_diversity(images: DataFrame, shape: tuple[int, int, int], most: int = 8, k: int = 1) -> DataFrame:
    spec = Spec("visual_diversity", True)
    rows = _per_video(images, shape, most, lambda fs: np.mean([descriptor(f) for f in fs], axis=0).tolist(), "array<double>").withColumnRenamed("v", "d")
    size = len(descriptor(np.zeros(shape, np.uint8)))
    wide = rows.select("episode_index", *(F.get("d", i).alias(f"d{i}") for i in range(size)))
    near = redundancy(standardised(wide, [f"d{i}" for i in range(size)]), k)
    return near.withColumn("signal", F.lit(spec.name))


@dataclass
class Registry:
    """Named signals: functions of frames and keyword parameters that return score rows."""

    found: dict[str, Callable[..., DataFrame]] = field(default_factory=dict)
    broken: dict[str, str] = field(default_factory=dict)

    def register(self, name: str, signal: Callable[..., DataFrame]) -> None:
        if name in self.found:
            raise ValueError(f"signal {name!r} is registered already")
        self.found[name] = signal

    def unregister(self, name: str) -> None:
        self.found.pop(name, None)

    def available(self) -> list[str]:
        return sorted(self.found)

    def unavailable(self) -> dict[str, str]:
        return dict(self.broken)

    def clear(self) -> None:
        self.found.clear()
        self.broken.clear()

    def load(self, group: str = "tidewright.signals") -> None:
        """Register installed plug-ins; one that fails to load is noted, not raised."""
        from importlib.metadata import entry_points

        for point in entry_points(group=group):
            try:
                self.register(point.name, point.load())
            except Exception as problem:  # noqa: BLE001
                self.broken[point.name] = f"{type(problem).__name__}: {problem}"

    def get(self, name: str, **parameters) -> Callable[[DataFrame], DataFrame]:
        if name not in self.found:
            raise KeyError(f"no signal {name!r}; there are {', '.join(self.available())}")
        return lambda frames: self.found[name](frames, **parameters)


def _embedded_redundancy(frames: DataFrame, k: int = 1, state: str | None = None) -> DataFrame:
    return redundancy(standardised(statistical_embedding(frames, state=state), EMBEDDING), k)


def _skipped(spec: Spec, frames: DataFrame, why: str) -> DataFrame:
    return _scores(spec, frames.select("episode_index").distinct(), F.lit(None).cast("double"), F.lit(why))


def _found_sim_validity(frames: DataFrame, penetration: str | None = None, threshold: float = 0.005, max_step: float = 1.0, positions: list[str] | None = None, prefix: str = "sim.") -> DataFrame:
    """Columns of a simulator begin with ``prefix``; positions are those with ``pos`` in their names, penetration the one with that word."""
    found = [c for c in frames.columns if c.startswith(prefix)]
    penetration = penetration or next((c for c in found if "penetration" in c), None)
    positions = sorted(c for c in found if "pos" in c) if positions is None else positions
    if not penetration and not positions:
        return _skipped(SPECS["sim_physics_validity"], frames, "no simulator columns")
    plain = {c: f"_sim{i}" for i, c in enumerate([c for c in [penetration, *positions] if c])}
    return sim_validity(frames.select("episode_index", "step", *(F.col(f"`{c}`").alias(n) for c, n in plain.items())), plain.get(penetration), [plain[c] for c in positions], threshold, max_step)


def _of_images(name: str, signal: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    def judged(frames: DataFrame, camera: str | None = None, shape: tuple[int, int, int] | None = None, **parameters) -> DataFrame:
        """``camera`` is a binary column of raw pixels, the first by name if none is given; ``shape`` is that of a frame."""
        cameras = sorted(c for c, kind in frames.dtypes if kind == "binary")
        if not (camera or cameras) or shape is None:
            return _skipped(SPECS[name], frames, "no images")
        images = frames.select("episode_index", "step", F.col(f"`{camera or cameras[0]}`").alias("frame"))
        return signal(images, tuple(shape), **parameters)

    return judged


def _learned_demo_score(frames: DataFrame, label: str = "success", state: str | None = None, **parameters) -> DataFrame:
    from tidewright.operators import learned

    if label not in frames.columns:
        return _skipped(SPECS["demo_score"], frames, "no labels")
    labels = frames.groupBy("episode_index").agg(F.max_by(F.col(label).cast("boolean"), "step").alias("success"))
    return learned.demo_score(standardised(statistical_embedding(frames, state=state), EMBEDDING), labels, **parameters)


def _learned_influence(frames: DataFrame, state: str = "state", action: str = "action", **parameters) -> DataFrame:
    from tidewright.operators import learned

    if state not in frames.columns or action not in frames.columns:
        return _skipped(SPECS["cupid"], frames, "no state or action")
    return learned.influence(frames, state, action, **parameters)


#: What each signal needs beside a CPU, what it costs and whether it gives equal results twice.
SPECS = {
    s.name: s
    for s in (
        Spec("jerk", False, per_transition=True), Spec("action_noise", False, per_transition=True), Spec("path_efficiency", True), Spec("spectral_smoothness", True), Spec("redundancy", True),
        Spec("structural_validity", False), Spec("sim_physics_validity", False, per_transition=True), Spec("image_blur", False, cost="video"), Spec("visual_stall", False, cost="video"),
        Spec("visual_diversity", True, cost="video"), Spec("demo_score", True, cost="learned"), Spec("cupid", True, cost="learned"),
    )
}

REGISTRY = Registry(
    {
        "jerk": jerk, "action_noise": action_noise, "path_efficiency": path_efficiency, "spectral_smoothness": spectral_smoothness, "redundancy": _embedded_redundancy, "structural_validity": structural_validity,
        "sim_physics_validity": _found_sim_validity, "image_blur": _of_images("image_blur", image_blur), "visual_stall": _of_images("visual_stall", visual_stall),
        "visual_diversity": _of_images("visual_diversity", visual_diversity), "demo_score": _learned_demo_score, "cupid": _learned_influence,
    }
)


def check_contract(signal: Callable[[DataFrame], DataFrame], frames: DataFrame) -> list[str]:
    """What a signal breaks: one row per episode, finite or skipped, one orientation, equal results twice."""
    problems = []
    try:
        once, again = signal(frames), signal(frames)
        missing = {"episode_index", "signal", "value", "higher_is_better", "skip_reason"} - set(once.columns)
        if missing:
            return [f"columns are missing: {', '.join(sorted(missing))}"]
        want, keys = frames.select("episode_index").distinct(), once.select("episode_index")
        if want.exceptAll(keys).union(keys.exceptAll(want)).limit(1).count():
            problems.append("not exactly one row per episode")
        if once.where(~K.finite(F.col("value")) & F.col("skip_reason").isNull()).limit(1).count():
            problems.append("a value is neither finite nor skipped")
        if once.select("higher_is_better", "signal").distinct().count() > 1:
            problems.append("more than one orientation or name")
        a, b = (d.select("episode_index", "value") for d in (once, again))
        if a.exceptAll(b).limit(1).count():
            problems.append("two runs differ")
    except Exception as problem:  # noqa: BLE001
        problems.append(f"raises {type(problem).__name__}: {problem}")
    return problems
