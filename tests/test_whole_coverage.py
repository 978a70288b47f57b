"""Coverage selection takes any number of episodes, in rounds that never change the result."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewright.operators import curation
from tidewright.plans import curator


def plain(x, order, k, w):
    """Greedy facility location over all similarities; the better ranked of gains that are alike to 1e-9."""
    far = np.linalg.norm(x[:, None] - x[None], axis=2)
    covered, chosen = None, []
    while len(chosen) < k:
        gain = np.array([np.inf if covered is None else np.maximum(0, covered - far[r[0]]).sum() + w * r[2] for r in order])
        gain[[i for i, r in enumerate(order) if r[0] in chosen]] = -np.inf
        best = order[0][0] if covered is None else order[int(np.flatnonzero(gain >= gain.max() - 1e-9)[0])][0]
        chosen.append(best)
        covered = far[best] if covered is None else np.minimum(covered, far[best])
    return chosen


@pytest.mark.parametrize("spread", [False, True])
@pytest.mark.parametrize("w", [0.0, 3.0])
def test_rounds_of_a_few_candidates_equal_plain_greedy(spark, monkeypatch, spread, w):
    draw = np.random.default_rng(11)
    x = np.concatenate([draw.normal(size=(90, 3)), np.repeat(draw.normal(size=(6, 3)), 12, axis=0)])  # copies too
    keep = [(i, f"{i:04d}", float(draw.random())) for i in range(len(x))]
    for name, value in {"ENTRIES": 400, "LAST": 500, "DISTANCES": 2000, "TASK": 3000}.items():
        monkeypatch.setattr(curation, f"COVERAGE_{name}", value)
    got = curation.coverage(keep, dict(enumerate(x)), 110, w, spark if spread else None)
    assert got == plain(x, sorted(keep, key=lambda r: (-r[2], r[1])), 110, w)


def test_more_than_twenty_thousand_episodes(spark):
    steps = spark.range(20_400).withColumnRenamed("id", "episode_index").withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(2))))
    level = 10.0 * (F.col("episode_index") % 4) + F.col("episode_index") * 1e-7
    frames = steps.select("episode_index", "step", (F.col("step") / 10).alias("t"), F.array(level + F.col("step") * 1e-3).alias("action"))
    kept = curator.run(frames, curator.CurationSpec(budget=curation.Budget("count", 4), selection="coverage", baseline=False)).decisions
    rows = kept.groupBy().agg(F.count("*").alias("n"), F.collect_set(F.when(F.col("kept"), F.col("episode_index") % 4)).alias("groups"), F.count_if("kept").alias("k")).first()
    assert (rows.n, rows.k) == (20_400, 4) and len(rows.groups) == 4
