"""Scores of episodes as they arrive: signals that need no other episode, batch by batch.

An episode has to arrive whole within one micro-batch, as episode files do. Signals that compare with
the dataset (action noise, redundancy, structural validity) need a full pass and are refused.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from tidewright.operators import signals as S

#: Signals whose value depends on their own episode alone.
LOCAL_SIGNALS = ("jerk", "path_efficiency", "spectral_smoothness")


def score_stream(frames: DataFrame, out: str, checkpoint: str, names: Iterable[str] = ("jerk",), **trigger) -> StreamingQuery:
    """Append the scores of each micro-batch to a Parquet table; a batch that is run again replaces its own rows."""
    chosen = list(names)
    if strange := [n for n in chosen if n not in LOCAL_SIGNALS]:
        raise ValueError(f"these signals need the whole dataset: {', '.join(strange)}")

    def score(batch: DataFrame, epoch: int) -> None:
        found = None
        for name in chosen:
            rows = S.REGISTRY.get(name)(batch).select("episode_index", "signal", "value", "higher_is_better", "skip_reason")
            found = rows if found is None else found.union(rows)
        found.write.mode("overwrite").parquet(f"{out}/epoch={epoch}")

    return frames.writeStream.foreachBatch(score).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
