"""Learned signals and the behaviour-cloning policy, in NumPy: small networks, trained full-batch with Adam.

Training runs on the driver on embeddings or on as many steps as fit there; with more steps each epoch's
gradient is summed on the executors, as per-episode gradients are, with the weights in the closure.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.operators.signals import Spec, _scores

#: Rows that training takes on the driver at most.
TRAIN_ROWS = 500_000


@dataclass
class MLP:
    """One hidden layer. kind: "regress" (tanh, squared error) or "classify" (ReLU, cross entropy)."""

    inputs: int
    outputs: int
    hidden: int = 64
    kind: str = "regress"
    seed: int = 0
    weights: list[np.ndarray] = field(default_factory=list)

    def __post_init__(self):
        if not self.weights:
            draw = np.random.default_rng(self.seed)
            a, b = 1 / np.sqrt(max(1, self.inputs)), 1 / np.sqrt(self.hidden)
            self.weights = [draw.uniform(-a, a, (self.inputs, self.hidden)), np.zeros(self.hidden), draw.uniform(-b, b, (self.hidden, self.outputs)), np.zeros(self.outputs)]

    def _forward(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        pre = x @ self.weights[0] + self.weights[1]
        h = np.tanh(pre) if self.kind == "regress" else np.maximum(pre, 0)
        out = h @ self.weights[2] + self.weights[3]
        return h, out if self.kind == "regress" else 1 / (1 + np.exp(-np.clip(out, -50, 50)))

    def predict(self, x: np.ndarray) -> np.ndarray:
        return self._forward(x)[1]

    def gradient(self, x: np.ndarray, y: np.ndarray, scale: float) -> list[np.ndarray]:
        """Gradient of the loss summed over rows and times ``scale``."""
        h, out = self._forward(x)
        d = (out - y) * scale * (2 / self.outputs if self.kind == "regress" else 1)
        back = d @ self.weights[2].T * (1 - h * h if self.kind == "regress" else (h > 0))
        return [x.T @ back, back.sum(0), h.T @ d, d.sum(0)]

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int, rate: float = 0.01, keep: tuple[float, ...] = ()) -> list["MLP"]:
        """Trains in place; copies at the given shares of the epochs are returned."""
        return self.descend(lambda: self.gradient(x, y, 1 / max(1, len(x))), epochs, rate, keep)

    def descend(self, gradient: Callable[[], list[np.ndarray]], epochs: int, rate: float = 0.01, keep: tuple[float, ...] = ()) -> list["MLP"]:
        """Trains in place by full-batch gradients; copies at the given shares of the epochs are returned."""
        m = [np.zeros_like(w) for w in self.weights]
        v = [np.zeros_like(w) for w in self.weights]
        marks, kept = {max(1, round(k * epochs)) for k in keep}, []
        for e in range(1, epochs + 1):
            for i, g in enumerate(gradient()):
                m[i] = 0.9 * m[i] + 0.1 * g
                v[i] = 0.999 * v[i] + 0.001 * g * g
                self.weights[i] = self.weights[i] - rate * (m[i] / (1 - 0.9**e)) / (np.sqrt(v[i] / (1 - 0.999**e)) + 1e-8)
            if e in marks:
                kept.append(MLP(self.inputs, self.outputs, self.hidden, self.kind, self.seed, [w.copy() for w in self.weights]))
        return kept


def demo_score(vectors: DataFrame, labels: DataFrame, hidden: int = 16, epochs: int = 150, folds: int = 5, seed: int = 0) -> DataFrame:
    """Out-of-fold probability that an episode is good; vectors (episode_index, v), labels (episode_index, success).

    suspected_mislabel: labelled good, but less than even by the model that has not seen it.
    """
    spec = Spec("demo_score", True)
    rows = vectors.join(labels.select("episode_index", "success"), "episode_index", "left").orderBy("episode_index").collect()
    if len(rows) > TRAIN_ROWS:
        raise ValueError(f"the classifier trains on {TRAIN_ROWS} episodes at most")
    spark = vectors.sparkSession
    known = [i for i, r in enumerate(rows) if r.success is not None]
    schema = "episode_index long, v double, s string, suspected_mislabel boolean"
    if len(known) < folds or len({rows[i].success for i in known}) < 2:
        found = [(r.episode_index, None, "too few labels", None) for r in rows]
    else:
        x = np.array([r.v for r in rows], float)
        y = np.array([[1.0 if rows[i].success else 0.0] for i in known])
        p = np.full(len(rows), np.nan)
        model = MLP(x.shape[1], 1, hidden, "classify", seed)
        model.fit(x[known], y, epochs)
        p[:] = model.predict(x)[:, 0]
        order = np.random.default_rng(seed).permutation(len(known))
        for part in np.array_split(order, folds):
            rest = np.setdiff1d(np.arange(len(known)), part)
            fold = MLP(x.shape[1], 1, hidden, "classify", seed)
            fold.fit(x[[known[i] for i in rest]], y[rest], epochs)
            p[[known[i] for i in part]] = fold.predict(x[[known[i] for i in part]])[:, 0]
        found = [(r.episode_index, float(q), None, r.success is True and bool(q < 0.5)) for r, q in zip(rows, p)]
    df = spark.createDataFrame(found, schema)
    return _scores(spec, df, F.col("v"), F.col("s"), F.col("suspected_mislabel"))


def steps(frames: DataFrame, state: str = "state", action: str = "action", most: int = TRAIN_ROWS) -> tuple[np.ndarray, np.ndarray] | DataFrame:
    """States and actions in episode and step order on the driver; of more than ``most`` rows a table (x, y) of all of them."""
    if frames.count() > most:
        return frames.select(F.col(state).alias("x"), F.col(action).alias("y"))
    rows = frames.orderBy("episode_index", "step").select(state, action).collect()
    return np.array([r[0] for r in rows], float), np.array([r[1] for r in rows], float)


def _summed(table: DataFrame, part: Callable[[np.ndarray, np.ndarray], list[np.ndarray]]) -> list[np.ndarray]:
    """Sum over all rows of what ``part`` makes of some rows' states and actions, computed on the executors."""

    def run(batches):
        total = None
        for pdf in batches:
            if len(pdf):
                found = part(np.array(pdf["x"].tolist(), float), np.array(pdf["y"].tolist(), float))
                total = found if total is None else [a + b for a, b in zip(total, found)]
        if total is not None:
            yield pd.DataFrame({"g": [[np.ravel(a).tolist() for a in total]], "shapes": [[list(np.shape(a)) for a in total]]})

    rows = table.mapInPandas(run, "g array<array<double>>, shapes array<array<int>>").collect()  # one row per task
    return [np.sum([np.array(r.g[i]) for r in rows], axis=0).reshape(rows[0].shapes[i]) for i in range(len(rows[0].g))]


class BCPolicy:
    """Behaviour cloning: standardised state to action."""

    def __init__(self, hidden: int = 64, epochs: int = 300, rate: float = 0.01, seed: int = 0):
        self.hidden, self.epochs, self.rate, self.seed = hidden, epochs, rate, seed

    def fit(self, data: tuple[np.ndarray, np.ndarray] | DataFrame, keep: tuple[float, ...] = ()) -> "BCPolicy":
        """Trains on what ``steps`` gives, on every row of it."""
        if not isinstance(data, DataFrame):
            return self.train(*data, keep)
        table = data.persist()
        n, total, outputs = _summed(table, lambda x, y: [np.array([len(x)]), x.sum(0), np.array([len(x) * y.shape[1]])])
        n = int(n[0])
        mean = total / n
        spread = np.sqrt(_summed(table, lambda x, y: [((x - mean) ** 2).sum(0)])[0] / n)
        spread = np.where(spread > 0, spread, 1.0)
        self.mean, self.spread = mean, spread
        self.model = model = MLP(len(mean), int(outputs[0]) // n, self.hidden, "regress", self.seed)
        self.checkpoints = model.descend(lambda: _summed(table, lambda x, y: model.gradient((x - mean) / spread, y, 1 / n)), self.epochs, self.rate, keep)
        table.unpersist()
        return self

    def train(self, x: np.ndarray, y: np.ndarray, keep: tuple[float, ...] = ()) -> "BCPolicy":
        self.mean, spread = x.mean(0), x.std(0)
        self.spread = np.where(spread > 0, spread, 1.0)
        self.model = MLP(x.shape[1], y.shape[1], self.hidden, "regress", self.seed)
        self.checkpoints = self.model.fit((x - self.mean) / self.spread, y, self.epochs, self.rate, keep)
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        return self.model.predict((x - self.mean) / self.spread)


def held_out_loss(policy: BCPolicy, frames: DataFrame, state: str = "state", action: str = "action") -> float:
    """Mean squared error over all steps and dimensions, summed on the executors."""

    def part(batches):
        for pdf in batches:
            if len(pdf):
                x, y = np.array(pdf[state].tolist(), float), np.array(pdf[action].tolist(), float)
                d = policy.predict(x) - y
                yield pd.DataFrame({"s": [float((d * d).sum())], "n": [d.size]})

    r = frames.select(state, action).mapInPandas(part, "s double, n long").agg(F.sum("s").alias("s"), F.sum("n").alias("n")).first()
    return r.s / r.n if r.n else float("nan")


def influence(frames: DataFrame, state: str = "state", action: str = "action", mode: str = "tracin", hidden: int = 32, epochs: int = 200, seed: int = 0) -> DataFrame:
    """Training influence of each episode on a cloning policy, over checkpoints: with the others' gradient, or with its own."""
    if mode not in ("tracin", "self_influence"):
        raise ValueError("mode is tracin or self_influence")
    spec = Spec("cupid", mode == "tracin")
    policy = BCPolicy(hidden, epochs, seed=seed).fit(steps(frames, state, action), keep=(0.1, 0.25, 0.5, 0.75))
    mean, spread, models = policy.mean, policy.spread, policy.checkpoints

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = (np.array(pdf[state].tolist(), float) - mean) / spread, np.array(pdf[action].tolist(), float)
        g = [np.concatenate([p.ravel() for p in m.gradient(a, b, 1 / len(a))]).tolist() for m in models]
        return pd.DataFrame({"episode_index": [pdf["episode_index"].iloc[0]], "g": [g]})

    grads = frames.select("episode_index", "step", state, action).groupBy("episode_index").applyInPandas(one, "episode_index long, g array<array<double>>")
    if mode == "self_influence":
        own = F.aggregate(F.flatten("g"), F.lit(0.0), lambda s, v: s + v * v)
        return _scores(spec, grads.withColumn("v", own), F.col("v"), F.lit(None))

    def add(batches):
        total = None
        for pdf in batches:
            for g in pdf["g"]:
                part = np.array([list(r) for r in g])
                total = part if total is None else total + part
        if total is not None:
            yield pd.DataFrame({"g": [total.tolist()]})

    sums = [np.array(r.g) for r in grads.select("g").mapInPandas(add, "g array<array<double>>").collect()]  # one row per task
    total = np.sum(sums, axis=0)

    def against(batches):
        for pdf in batches:
            v = [float((np.array([list(r) for r in g]) * (total - np.array([list(r) for r in g]))).sum()) for g in pdf["g"]]
            yield pd.DataFrame({"episode_index": pdf["episode_index"], "v": v})

    return _scores(spec, grads.mapInPandas(against, "episode_index long, v double"), F.col("v"), F.lit(None))
