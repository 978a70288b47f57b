import numpy as np
import pytest

from tidewright.operators import signals as S
from tidewright.sources import fixtures
from tidewright.streaming.scoring import score_stream


def test_a_stream_scores_as_a_table_does(spark, tmp_path):
    frames = fixtures.in_memory(spark, fixtures.demonstrations())
    for e in range(8):
        frames.where(f"episode_index = {e}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(frames.schema).option("maxFilesPerTrigger", 3).parquet(str(tmp_path / "in"))
    score_stream(stream, str(tmp_path / "out"), str(tmp_path / "state"), ("jerk", "path_efficiency")).awaitTermination(120)
    got = {(r.episode_index, r.signal): r.value for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = {(r.episode_index, r.signal): r.value for d in (S.jerk(frames), S.path_efficiency(frames)) for r in d.collect()}
    assert got.keys() == want.keys() and all(np.isclose(got[k], want[k]) for k in want)
    with pytest.raises(ValueError):
        score_stream(stream, "x", "y", ("redundancy",))
