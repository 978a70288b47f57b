"""Reports list every episode, however many."""

from types import SimpleNamespace

from pyspark.sql import functions as F

from tidewright.operators import reports
from tidewright.plans import scorecard
from tidewright.plans.curator import CurationSpec


def test_health_lists_every_defect(spark):
    frames = spark.range(1500).select(F.col("id").alias("episode_index"), F.lit(1.0).alias("x"))
    validity = spark.range(1500).select(F.col("id").alias("episode_index"), F.lit(False).alias("is_valid"), *(F.lit(1).alias(c) for c in ("truncated", "stalled", "nonfinite")))
    assert reports.health(frames, validity, ["x"])["defects"] == list(range(1500))


def test_scorecard_lists_every_removed_episode(spark):
    decisions = spark.range(1500).select(F.col("id").alias("episode_index"), F.lit(False).alias("kept"), F.lit("budget").alias("reason"))
    scores = spark.createDataFrame([(0, "jerk", False, 1.0)], "episode_index long, signal string, higher_is_better boolean, value double")
    card = scorecard.scorecard(SimpleNamespace(decisions=decisions, scores=scores, baseline=None, spec=CurationSpec(signals={"jerk": {}})))
    assert [r["episode_index"] for r in card["removed"]] == list(range(1500))
