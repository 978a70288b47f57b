"""Experiments and the data-selection benchmark: arms, splits, submissions, leaderboard."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.operators import curation, learned, stats
from tidewright.plans import curator

CAVEAT = "A lower held-out loss of a small cloning policy is a proxy; it says nothing about success on a robot."


def select(frames: DataFrame, indices: list[int]) -> DataFrame:
    chosen = frames.sparkSession.createDataFrame([(int(i),) for i in indices], "episode_index long")
    return frames.join(F.broadcast(chosen), "episode_index", "left_semi") if len(indices) < 100_000 else frames.join(chosen, "episode_index", "left_semi")


def random_arm(pool: list[int], k: int, seed: int, stream: int) -> list[int]:
    state = np.random.SeedSequence([seed, stream]).generate_state(1)[0]
    return sorted(int(i) for i in np.random.default_rng(int(state)).choice(np.array(pool), min(k, len(pool)), replace=False))


def arms(frames: DataFrame, spec: curator.CurationSpec) -> dict[str, list[int]]:
    """full, curated, equal_n_random, random_filter, and one ablation for each signal of several."""
    everything = sorted(r.episode_index for r in frames.select("episode_index").distinct().collect())
    kept = lambda s: sorted(r.episode_index for r in curator.run(frames, s).decisions.where("kept").collect())
    curated = kept(spec)
    out = {"full": everything, "curated": curated, "equal_n_random": curation.equal_n_baseline(everything, len(curated), spec.seed), "random_filter": random_arm(everything, len(curated), spec.seed, curation.RANDOM_FILTER_STREAM)}
    if len(spec.signals) > 1:
        for name in spec.signals:
            rest = {s: p for s, p in spec.signals.items() if s != name}
            gate = spec.gate if spec.gate and spec.gate.signal in rest else None
            out[f"without_{name}"] = kept(curator.CurationSpec.from_dict(spec.to_dict() | {"signals": rest, "weights": {s: w for s, w in spec.weights.items() if s in rest}, "gate": gate and gate.__dict__}))
    return out


def losses(frames: DataFrame, chosen: dict[str, list[int]], held: list[int], seeds: list[int], **policy) -> dict[str, list[float]]:
    """Held-out cloning loss of each arm and seed."""
    test, out = select(frames, held).persist(), {}
    for name, indices in chosen.items():
        data = learned.steps(select(frames, indices))
        out[name] = [learned.held_out_loss(learned.BCPolicy(seed=s, **policy).fit(data), test) for s in seeds]
    test.unpersist()
    return out


def compare_held_out(frames: DataFrame, curated: list[int], fraction: float = 0.2, seeds: tuple[int, ...] = (0, 1, 2), **policy) -> dict:
    """curated against full, random and length-matched random, with paired effects; negative is better."""
    everything = sorted(r.episode_index for r in frames.select("episode_index").distinct().collect())
    train, held = stats.split(len(everything), fraction, 0)
    pool, test = [everything[i] for i in train], [everything[i] for i in held]
    kept = [i for i in curated if i in set(pool)]
    lengths = {r.episode_index: r.n for r in frames.groupBy("episode_index").agg(F.count("*").alias("n")).collect()}
    order = np.random.default_rng((0 + 1) * 100003).permutation(len(pool))
    target, total, matched = sum(lengths[i] for i in kept), 0, []
    for i in order:
        if total >= target:
            break
        matched.append(pool[i])
        total += lengths[pool[i]]
    found = losses(frames, {"full": pool, "random": random_arm(pool, len(kept), 0, curation.BENCHMARK_STREAM), "random_steps": sorted(matched), "curated": kept}, test, list(seeds), **policy)
    return {"losses": found, "effects": {a: asdict(stats.paired_effect(found["curated"], found[a])) for a in ("full", "random", "random_steps")}}


@dataclass
class FakeEnvironment:
    """A deterministic stand-in for a simulator: success when a policy's quality beats a seeded difficulty."""

    seed: int = 0

    def rollouts(self, quality: float, n: int) -> float:
        """Share of n episodes that succeed."""
        hard = np.random.default_rng(self.seed).normal(size=n)
        return float((1 / (1 + np.exp(-(quality - hard))) > 0.5).mean())


def latched_success(steps: DataFrame) -> DataFrame:
    """(episode_index, success): whether any step of (episode_index, success) succeeded."""
    return steps.groupBy("episode_index").agg(F.max("success").alias("success"))


def report(found: dict[str, list[float]], treatment: str = "curated", baseline: str = "equal_n_random") -> dict:
    """Each arm's mean with its interval, and the paired effect of the treatment."""
    out = {"arms": {a: asdict(stats.bootstrap(v)) for a, v in found.items()}}
    if treatment in found and baseline in found:
        e = stats.paired_effect(found[treatment], found[baseline])
        out["headline"] = asdict(e) | {"separated": e.separated}
    return out


def report_markdown(r: dict) -> str:
    lines = ["| arm | mean | 95 % interval | n |", "| --- | --- | --- | --- |"] + [f"| {a} | {e['mean']:.4f} | [{e['low']:.4f}, {e['high']:.4f}] | {e['n']} |" for a, e in r["arms"].items()]
    if h := r.get("headline"):
        lines += ["", f"Effect {h['mean']:.4f} [{h['low']:.4f}, {h['high']:.4f}]: {'separated from zero' if h['separated'] else 'not separated from zero'}."]
    return "\n".join(lines)


@dataclass
class ExperimentConfig:
    """A run from JSON: the curation, the held-out share, seeds and the policy."""

    curation: dict = field(default_factory=dict)
    fraction: float = 0.2
    seeds: list[int] = field(default_factory=lambda: [0, 1, 2])
    policy: dict = field(default_factory=dict)

    @classmethod
    def load(cls, path: str) -> "ExperimentConfig":
        return cls(**json.loads(Path(path).read_text()))


def run_config(frames: DataFrame, config: ExperimentConfig) -> dict:
    """Arms on the training episodes, cloned and judged on the held-out ones."""
    everything = sorted(r.episode_index for r in frames.select("episode_index").distinct().collect())
    train, held = stats.split(len(everything), config.fraction, config.seeds[0])
    pool = select(frames, [everything[i] for i in train])
    spec = curator.CurationSpec.from_dict(curator.CurationSpec().to_dict() | config.curation)
    return report(losses(frames, arms(pool, spec), [everything[i] for i in held], config.seeds, **config.policy))


@dataclass
class BenchmarkSpec:
    pool_hash: str
    train: list[int]
    held: list[int]
    policy: dict = field(default_factory=lambda: {"hidden": 64, "epochs": 300, "rate": 0.01})
    seeds: list[int] = field(default_factory=lambda: [0, 1, 2])

    @classmethod
    def build(cls, frames: DataFrame, pool_hash: str, fraction: float = 0.2, seed: int = 0) -> "BenchmarkSpec":
        everything = sorted(r.episode_index for r in frames.select("episode_index").distinct().collect())
        train, held = stats.split(len(everything), fraction, seed)
        return cls(pool_hash, [everything[i] for i in train], [everything[i] for i in held])

    def save(self, path: str) -> None:
        Path(path).write_text(json.dumps(asdict(self), indent=2, sort_keys=True))

    @classmethod
    def load(cls, path: str) -> "BenchmarkSpec":
        return cls(**json.loads(Path(path).read_text()))


def resolve(submission: dict, frames: DataFrame, spec: BenchmarkSpec) -> list[int]:
    """The kept episodes of an index set, or of a recipe run over the training pool."""
    if "kept_episode_indices" in submission:
        kept = sorted(set(map(int, submission["kept_episode_indices"])))
        if strange := set(kept) - set(spec.train):
            raise ValueError(f"not in the training pool: {sorted(strange)[:5]}")
        return kept
    if "config" in submission:
        run = curator.run(select(frames, spec.train), curator.CurationSpec.from_dict(submission["config"]))
        return sorted(r.episode_index for r in run.decisions.where("kept").collect())
    raise ValueError("a submission has kept_episode_indices, or is a recipe")


def run_submission(name: str, submission: dict, frames: DataFrame, spec: BenchmarkSpec, pool_hash: str) -> dict:
    if pool_hash != spec.pool_hash:
        raise ValueError("the pool is not the one that the benchmark was built on")
    kept = resolve(submission, frames, spec)
    chosen = {"submitted": kept, "equal_n_random": random_arm(spec.train, len(kept), 0, curation.BENCHMARK_STREAM), "full": spec.train}
    found = losses(frames, chosen, spec.held, spec.seeds, **spec.policy)
    effect = stats.paired_effect(found["equal_n_random"], found["submitted"])
    return {"name": name, "n_kept": len(kept), "losses": found, "submitted_mean": float(np.mean(found["submitted"])), "effect": asdict(effect) | {"separated": effect.separated}, "caveat": CAVEAT}


def append_entry(path: str, entry: dict) -> None:
    rows = json.loads(Path(path).read_text()) if Path(path).exists() else []
    Path(path).write_text(json.dumps([*rows, entry], indent=2, sort_keys=True))


def leaderboard_table(path: str) -> str:
    rows = sorted(json.loads(Path(path).read_text()), key=lambda r: (r["submitted_mean"], r["name"]))
    lines = ["| place | name | kept | held-out loss | gain over equal-N random |", "| --- | --- | --- | --- | --- |"]
    lines += [f"| {i} | {r['name']} | {r['n_kept']} | {r['submitted_mean']:.4f} | {r['effect']['mean']:.4f} [{r['effect']['low']:.4f}, {r['effect']['high']:.4f}] |" for i, r in enumerate(rows, 1)]
    return "\n".join([*lines, "", CAVEAT])
