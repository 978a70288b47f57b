"""Datasets made here: demonstrations with known bad episodes, an identity task, and in-memory episodes."""

from __future__ import annotations

import json
from collections.abc import Iterable
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame, SparkSession

FRAMES = "episode_index long, step int, t double, action array<double>, state array<double>"


def in_memory(spark: SparkSession, episodes: Iterable[tuple[np.ndarray, np.ndarray]], hz: float = 10.0) -> DataFrame:
    """Frames of (actions, states) arrays, one pair per episode."""
    rows = [(e, i, i / hz, np.atleast_1d(a[i]).astype(float).tolist(), np.atleast_1d(s[i]).astype(float).tolist()) for e, (a, s) in enumerate(episodes) for i in range(len(a))]
    return spark.createDataFrame(rows, FRAMES)


def demonstrations(episodes: int = 8, steps: int = 24, seed: int = 0) -> list[tuple[np.ndarray, np.ndarray]]:
    """Reaches along an arc: speed rises and falls as a half sine while the heading turns. Odd episodes tremble."""
    beat = np.sin(np.pi * (np.arange(steps) + 0.5) / steps)
    out = []
    for number in range(episodes):
        draw = np.random.default_rng([seed, number])
        heading = draw.uniform(-np.pi, np.pi) + draw.uniform(-0.8, 0.8) * np.linspace(-1, 1, steps)
        velocity = beat[:, None] * np.column_stack([np.cos(heading), np.sin(heading)])
        if number % 2:
            velocity += draw.normal(scale=0.35, size=velocity.shape)
        out.append((velocity, velocity.cumsum(axis=0) / steps))
    return out


#: An identity task's helpful and harmful episodes, steps, and noise of the actions.
IDENTITY = {"helpful": 12, "harmful": 4, "steps": 24, "noise": 0.02}


def identity(helpful: int = IDENTITY["helpful"], harmful: int = IDENTITY["harmful"], steps: int = IDENTITY["steps"], noise: float = IDENTITY["noise"], seed: int = 0) -> list[tuple[np.ndarray, np.ndarray]]:
    """The action is the state, or its opposite in the harmful episodes, which come last."""
    draw = np.random.default_rng(seed)
    state = draw.uniform(-1, 1, (helpful + harmful, steps, 2))
    sign = np.where(np.arange(helpful + harmful) < helpful, 1, -1)[:, None, None]
    return list(zip(sign * state + draw.normal(scale=noise, size=state.shape), state))


def write_demo(root: str, episodes: list[tuple[np.ndarray, np.ndarray]], hz: float = 10.0, task: str = "reach the goal") -> None:
    """A dataset in the v2.1 layout from in-memory episodes."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    base = Path(root)
    (base / "meta").mkdir(parents=True)
    (base / "data/chunk-000").mkdir(parents=True)
    dims = [np.atleast_2d(x).shape[-1] for x in episodes[0]] if episodes else [0, 0]
    features = {"timestamp": {"dtype": "float32", "shape": []}, "action": {"dtype": "float32", "shape": [dims[0]]}, "observation.state": {"dtype": "float32", "shape": [dims[1]]}}
    lines, at = [], 0
    for e, (a, s) in enumerate(episodes):
        n = len(a)
        columns = {"timestamp": pa.array(np.arange(n) / hz, pa.float32()), "action": pa.array(a.tolist(), pa.list_(pa.float32())), "observation.state": pa.array(s.tolist(), pa.list_(pa.float32()))}
        columns |= {"episode_index": pa.array([e] * n, pa.int64()), "frame_index": pa.array(range(n), pa.int64()), "index": pa.array(range(at, at + n), pa.int64()), "task_index": pa.array([0] * n, pa.int64())}
        pq.write_table(pa.table(columns), base / f"data/chunk-000/episode_{e:06d}.parquet")
        lines.append(json.dumps({"episode_index": e, "length": n, "tasks": [task]}))
        at += n
    (base / "meta/info.json").write_text(json.dumps({"codebase_version": "v2.1", "robot_type": "demo", "fps": hz, "features": features, "total_episodes": len(episodes), "total_frames": at}, indent=2))
    (base / "meta/episodes.jsonl").write_text("".join(x + "\n" for x in lines))
    (base / "meta/tasks.jsonl").write_text(json.dumps({"task_index": 0, "task": task}) + "\n")
