"""A curation run: score every episode, combine, gate, select under a budget, decide, and write.

The run stays lazy up to the budget, which needs one count. Scores are checkpointed once, as every
later step reads them.
"""

from __future__ import annotations

import json
import warnings
from collections.abc import Callable
from dataclasses import dataclass, field
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.functions import kernels as K
from tidewright.operators import curation as C
from tidewright.operators import signals as S
from tidewright.sources import datasets

VERSION = "0.1.0"
SELECTIONS = ("top_k", "greedy_dedup", "coverage")


@dataclass
class CurationSpec:
    signals: dict[str, dict] = field(default_factory=lambda: {"jerk": {}})
    weights: dict[str, float] = field(default_factory=dict)
    budget: C.Budget = field(default_factory=C.Budget)
    gate: C.Gate | None = None
    selection: str = "top_k"
    dedup_epsilon: float = 0.5
    coverage_quality_weight: float = 0.0
    drop: list[int] = field(default_factory=list)
    keep: list[int] = field(default_factory=list)
    baseline: bool = True
    seed: int = 0
    state: str | None = None

    def __post_init__(self):
        if self.drop and self.keep:
            raise ValueError("a drop list and a keep list exclude each other")
        if self.selection not in SELECTIONS:
            raise ValueError(f"selection is one of {', '.join(SELECTIONS)}")
        if self.gate and self.gate.signal not in self.signals:
            raise ValueError(f"the gate's signal {self.gate.signal!r} is not in the run")

    def to_dict(self) -> dict:
        gate = None if self.gate is None else self.gate.__dict__
        return {"signals": self.signals, "weights": {s: self.weights.get(s, 1.0) for s in self.signals}, "budget": self.budget.__dict__, "gate": gate, "selection": self.selection, "dedup_epsilon": self.dedup_epsilon, "coverage_quality_weight": self.coverage_quality_weight, "drop": self.drop, "keep": self.keep, "baseline": self.baseline, "seed": self.seed, "state": self.state}

    @classmethod
    def from_dict(cls, d: dict) -> "CurationSpec":
        gate = C.Gate(**d["gate"]) if d.get("gate") else None
        return cls(**{k: v for k, v in d.items() if k not in ("gate", "budget")}, gate=gate, budget=C.Budget(**d["budget"]))


def save_recipe(spec: CurationSpec, path: str) -> None:
    Path(path).write_text(json.dumps({"recipe_version": 1, "code_version": VERSION, "config": spec.to_dict()}, indent=2, sort_keys=True))


def load_recipe(path: str) -> CurationSpec:
    return CurationSpec.from_dict(json.loads(Path(path).read_text())["config"])


@dataclass(frozen=True)
class Resources:
    """What a run may use; signals that need more are left out with a warning."""

    gpus: int = 0
    cpus: int = 1


#: What signals need; a plug-in adds its own.
SPECS = S.SPECS


def usable(names: list[str], resources: Resources) -> list[str]:
    out = []
    for name in names:
        spec = SPECS.get(name)
        if spec and not spec.deterministic:
            raise ValueError(f"signal {name} is not deterministic")
        if spec and "gpu" in spec.requires and not resources.gpus:
            warnings.warn(f"signal {name} needs a GPU and is left out", stacklevel=2)
            continue
        out.append(name)
    return out


@dataclass
class Result:
    spec: CurationSpec
    scores: DataFrame
    decisions: DataFrame
    baseline: list[int] | None
    k: int

    def manifest(self, source: str | None = None, created: str | None = None) -> dict:
        rows = self.decisions.orderBy("episode_index").collect()
        return {"schema_version": 1, "code_version": VERSION, "source": source, "config": self.spec.to_dict(), "seed": self.spec.seed, "created_utc": created, "decisions": [{"episode_index": r.episode_index, "kept": r.kept, "reason": r.reason, "keep_score": r.keep_score} for r in rows], "baseline": self.baseline}

    def save(self, data: datasets.Dataset, dest: str, videos: bool = True, created: str | None = None) -> dict:
        return datasets.write(data, self.decisions.where("kept"), dest, self.manifest(data.root, created), videos)


def run_dataset(spark, root: str, spec: CurationSpec, on_error: str = "abort") -> tuple[Result, dict[str, str]]:
    """A run over a v2.1 or v3.0 dataset. on_error="quarantine" leaves out episode files that do not read, and says why."""
    if on_error not in ("abort", "quarantine"):
        raise ValueError("on_error is abort or quarantine")
    problems: dict[str, str] = {}
    data = None
    if on_error == "quarantine":
        good, problems = datasets.readable(spark, root)
        if problems:
            data = (datasets.read_v21 if datasets.detect_version(root) == "v2.1" else datasets.read_v3)(spark, root, good)
            warnings.warn(f"{len(problems)} episode files do not read", stacklevel=2)
    data = data or datasets.read(spark, root)
    frames = data.frames.withColumn("action", F.transform("action", lambda x: x.cast("double")))
    quarantined = datasets.unreadable(spark, root, problems) if problems else None
    return run(frames, spec, datasets.fingerprints(data.frames, data.features), quarantined=quarantined), problems


def run(
    frames: DataFrame,
    spec: CurationSpec,
    episodes: DataFrame | None = None,
    resources: Resources = Resources(),
    quarantined: DataFrame | None = None,
    embedding: Callable[[DataFrame], DataFrame] | None = None,
    combiner: Callable[[DataFrame, dict[str, float]], DataFrame] = C.weighted_sum,
) -> Result:
    """episodes may hold (episode_index, fingerprint); without it an episode's index, zero-padded, orders ties.

    quarantined (episode_index, problem) episodes are in no pool and get a decision. embedding makes
    (episode_index, v array) of frames, which are standardised; combiner makes (episode_index, keep_score)
    of scores and weights.
    """
    if episodes is None:
        episodes = frames.select("episode_index").distinct().withColumn("fingerprint", F.lpad(F.col("episode_index").cast("string"), 20, "0"))
    scores = None
    for name in usable(list(spec.signals), resources):
        parameters = spec.signals[name]
        found = S.REGISTRY.get(name, **parameters)(frames).select("episode_index", "signal", "value", "higher_is_better", "skip_reason")
        scores = found if scores is None else scores.union(found)
    scores = K.cut(scores)
    for r in scores.groupBy("signal").agg(F.every(F.col("value").isNull()).alias("none")).where("none").collect():
        warnings.warn(f"signal {r.signal} skipped every episode", stacklevel=2)
    keep = K.cut(episodes.select("episode_index", "fingerprint").join(combiner(scores, spec.weights), "episode_index"))
    gated = dropped = unlisted = similar = None
    valid = keep
    if spec.gate:
        gated = scores.where((F.col("signal") == spec.gate.signal) & spec.gate.rejects(F.col("value"))).select("episode_index", F.col("signal").alias("gate_signal"), "value")
        valid = valid.join(gated, "episode_index", "left_anti")
    spark = frames.sparkSession
    unknown = set(spec.drop or spec.keep)
    if unknown:
        unknown -= {r.episode_index for r in keep.where(F.col("episode_index").isin(sorted(unknown))).select("episode_index").collect()}
        if unknown:
            warnings.warn(f"the list names episodes that are not there: {', '.join(map(str, sorted(unknown)))}", stacklevel=2)
    if spec.drop:
        dropped = spark.createDataFrame([(i,) for i in spec.drop], "episode_index long")
        valid = valid.join(dropped, "episode_index", "left_anti")
    if spec.keep:
        listed = spark.createDataFrame([(i,) for i in spec.keep], "episode_index long")
        unlisted = keep.select("episode_index").join(listed, "episode_index", "left_anti")
        valid = valid.join(listed, "episode_index", "left_semi")
    k = spec.budget.resolve(valid.count())
    if spec.selection == "top_k":
        kept = C.top_k(valid, k)
    else:
        pool = frames.join(valid.select("episode_index"), "episode_index", "left_semi")
        vectors = K.cut(S.standardised_arrays(embedding(pool)) if embedding else S.standardised(S.statistical_embedding(pool, state=spec.state), S.EMBEDDING))
        ranked = K.in_order(valid, F.col("keep_score").desc(), F.col("fingerprint").asc()).select("episode_index", "rank")
        if spec.selection == "greedy_dedup":
            walk = K.cut(C.greedy_dedup(valid, vectors, spec.dedup_epsilon))
            kept = K.cut(walk.where("kept").orderBy("rank").limit(k))
            similar = C.representatives(walk.where("not kept"), kept, vectors)
        else:
            rows = [(r.episode_index, r.fingerprint, r.keep_score) for r in valid.collect()]
            chosen = C.coverage(rows, {r.episode_index: np.array(r.v) for r in vectors.collect()}, k, spec.coverage_quality_weight, spark)
            kept = K.cut(spark.createDataFrame([(i,) for i in chosen], "episode_index long").join(ranked, "episode_index"))
            removed = valid.join(kept, "episode_index", "left_anti").select("episode_index")
            # the best kept episode stands for those without a vector
            similar = removed.join(C.representatives(removed, kept, vectors), "episode_index", "left")
            best = kept.agg(F.min_by("episode_index", "rank").alias("best"))
            similar = similar.crossJoin(F.broadcast(best)).select("episode_index", F.coalesce("representative", "best").alias("representative"))
    baseline = None
    if spec.baseline:
        baseline = C.equal_n_baseline([r.episode_index for r in valid.select("episode_index").orderBy("episode_index").toLocalIterator()], k, spec.seed)
    decided = C.decisions(episodes, keep, kept, gated, dropped, unlisted, similar, "represented by" if spec.selection == "coverage" else "near-duplicate of")
    if quarantined is not None:
        why = F.concat(F.lit("quarantined: unreadable episode ("), "problem", F.lit(")"))
        decided = decided.unionByName(quarantined.select("episode_index", F.lit(False).alias("kept"), why.alias("reason")), allowMissingColumns=True)
    return Result(spec, scores, decided, baseline, k)
