"""A policy trains on every frame, on the executors as on the driver."""

import numpy as np

from tidewright.operators import learned


def test_every_frame_trains_beyond_the_driver(spark):
    draw = np.random.default_rng(0)
    x = draw.normal(size=(60, 2))
    frames = spark.createDataFrame([(i // 6, i % 6, v.tolist(), [float(v[0] - 2 * v[1])]) for i, v in enumerate(x)], "episode_index long, step long, state array<double>, action array<double>").repartition(3)
    few, many = (learned.BCPolicy(8, 8).fit(learned.steps(frames, most=m), keep=(0.5,)) for m in (60, 10))
    assert np.allclose(few.predict(x), many.predict(x), atol=1e-9) and len(many.checkpoints) == 1
