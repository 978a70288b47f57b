"""Corruptions with a known answer, on frames (episode_index, step, t, action ARRAY<DOUBLE>).

Kinds that need no randomness are DataFrame expressions; the seeded ones run in pandas per episode.
Time is rebuilt as even steps of the episode's median interval.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from tidewright.operators import signals, stats

DETERMINISTIC = ("truncate", "stall", "action_quantize", "frame_skip")
SEEDED = ("jitter", "detour", "wrong_target_offset", "dropped_dof")
KINDS = DETERMINISTIC + SEEDED


def _episode() -> WindowSpec:
    return Window.partitionBy("episode_index")


def _order() -> WindowSpec:
    return _episode().orderBy("step")


def _retimed(frames: DataFrame, original: DataFrame) -> DataFrame:
    """Steps renumbered from 0, and even times."""
    gap = F.col("t") - F.lag("t").over(_order())
    pace = original.select("episode_index", gap.alias("gap")).groupBy("episode_index").agg(F.median("gap").alias("pace"))
    place = F.row_number().over(_episode().orderBy("step", "copy") if "copy" in frames.columns else _order()) - 1
    out = frames.withColumn("place", place).join(pace, "episode_index").withColumns({"step": F.col("place"), "t": F.col("place") * F.coalesce("pace", F.lit(0.0))})
    return out.select(*original.columns)


def truncate(frames: DataFrame, severity: float = 1.0) -> DataFrame:
    keep = F.greatest(F.lit(2), F.bround(F.count("*").over(_episode()) * (1 - min(max(severity, 0.0), 0.9)), 0).cast("int"))
    return _retimed(frames.withColumn("keep", keep).where("step < keep"), frames)


def frame_skip(frames: DataFrame, severity: float = 1.0) -> DataFrame:
    stride = 1 + max(1, round(3 * min(max(severity, 0.0), 1.0)))
    n = F.count("*").over(_episode())
    # two steps stay at least: with one left, the last joins it
    keep = (F.col("n") <= 2) | (F.col("step") % stride == 0) | ((F.col("n") <= stride) & (F.col("step") == F.col("n") - 1))
    return _retimed(frames.withColumn("n", n).where(keep), frames)


def action_quantize(frames: DataFrame, severity: float = 1.0) -> DataFrame:
    """Values rounded, halves to even, to a grid of severity times half the deviation of their dimension."""
    long = frames.select("episode_index", "step", F.posexplode("action").alias("dof", "x"))
    grid = long.groupBy("episode_index", "dof").agg((severity * 0.5 * F.stddev_pop("x")).alias("g"))
    grids = grid.groupBy("episode_index").agg(F.transform(F.array_sort(F.collect_list(F.struct("dof", "g"))), lambda s: s["g"]).alias("grid"))
    rounded = F.zip_with("action", "grid", lambda x, g: F.when(g > 0, F.rint(x / g) * g).otherwise(x))
    return _retimed(frames.join(grids, "episode_index").withColumn("action", rounded).drop("grid"), frames)


def stall(frames: DataFrame, severity: float = 1.0) -> DataFrame:
    """The middle step is held for severity times a third of the episode."""
    n = F.count("*").over(_episode())
    held = frames.withColumn("n", n).withColumn("copies", F.when(F.col("step") == F.floor(F.col("n") / 2), 1 + F.greatest(F.lit(1), F.bround(F.col("n") * severity / 3, 0).cast("int"))).otherwise(1))
    return _retimed(held.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))), frames)


def seeded(frames: DataFrame, kind: str, severity: float = 1.0, seed: int = 0) -> DataFrame:
    columns = frames.columns

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("step").reset_index(drop=True)
        x = np.array(pdf["action"].tolist(), float)
        draw = np.random.default_rng([seed, int(pdf["episode_index"].iloc[0]) & 0xFFFFFFFF])
        spread = x.std(0)
        if kind == "jitter":
            x = x + severity * 0.5 * np.where(spread > 0, spread, 1.0) * draw.normal(size=x.shape)
        elif kind == "detour":
            way = draw.normal(size=x.shape[1])
            bow = np.sin(np.pi * np.linspace(0, 1, len(x)))
            x = x + severity * 0.5 * np.linalg.norm(np.ptp(x, axis=0)) * bow[:, None] * way / max(np.linalg.norm(way), 1e-12)
        elif kind == "wrong_target_offset":
            x = x + severity * np.where(spread > 0, spread, 1.0) * draw.normal(size=x.shape[1])
        else:
            x[:, draw.integers(x.shape[1])] = 0
        pdf["action"] = list(x)
        return pdf[columns]

    return _retimed(frames.groupBy("episode_index").applyInPandas(one, frames.schema), frames)


def corrupt(frames: DataFrame, kind: str, severity: float = 1.0, seed: int = 0) -> DataFrame:
    if kind in SEEDED:
        return seeded(frames, kind, severity, seed)
    return {"truncate": truncate, "stall": stall, "action_quantize": action_quantize, "frame_skip": frame_skip}[kind](frames, severity)


def detection_matrix(frames: DataFrame, kinds: list[str], chosen: dict, severity: float = 1.0, seed: int = 0) -> DataFrame:
    """(kind, signal, n_pos, n_neg, auc): how well each signal, fitted on clean and corrupted episodes together, tells the corrupted ones."""
    shift = frames.agg(F.max("episode_index") + 1).first()[0] or 0
    found = None
    for i, kind in enumerate(kinds):
        bad = corrupt(frames, kind, severity, seed + i).withColumn("episode_index", F.col("episode_index") + shift)
        both = frames.union(bad)
        for signal in chosen.values():
            rows = signal(both).select(F.lit(kind).alias("kind"), "signal", (F.col("episode_index") >= shift).alias("is_corrupt"), F.when(F.col("higher_is_better"), -F.col("value")).otherwise(F.col("value")).alias("badness"))
            found = rows if found is None else found.union(rows)
    return stats.rank_auc(found, ["kind", "signal"], "is_corrupt", "badness")
