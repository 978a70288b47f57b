"""Runs of experiments outside: filter keys for a trainer, and its results by arm."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame


def filter_keys(names: DataFrame, kept: DataFrame, train: list[str], seed: int = 0) -> dict[str, list[str]]:
    """Names of the curated episodes that are in the training split, and as many drawn from the split at random.

    names (episode_index, group) and kept (episode_index) are those of a run over the whole file.
    """
    split = names.sparkSession.createDataFrame([(n,) for n in sorted(set(train))], "group string")
    curated = names.join(kept.select("episode_index"), "episode_index", "left_semi").join(split, "group", "left_semi")
    chosen = sorted(r.group for r in curated.select("group").toLocalIterator())
    pool = sorted(set(train), key=lambda n: int(re.search(r"\d+$", n)[0]))
    drawn = np.random.default_rng(seed).choice(pool, size=len(chosen), replace=False) if chosen else []
    return {"curated": chosen, "random_equalN": sorted(str(n) for n in drawn)}


@dataclass(frozen=True)
class RunGroups:
    """Success rates by label, failed runs, and runs left out as nothing was measured or their arm is unknown."""

    rates: dict[str, list[float]]
    failed: int
    skipped: int

    def labels(self) -> list[str]:
        """full and random first, then the curated ones, the best mean first."""
        fixed = [n for n in ("full", "random") if n in self.rates]
        return fixed + sorted(set(self.rates) - set(fixed), key=lambda n: (-float(np.mean(self.rates[n])), n))


def load_groups(path: str) -> RunGroups:
    """The list of runs {"ok", "arm", "signal", "success"} of a JSON file, by arm; a curated run is labelled with its signal."""
    runs = json.loads(Path(path).read_text())
    if not isinstance(runs, list):
        raise ValueError("a file of runs holds a list")
    good = [r for r in runs if r.get("ok")]
    label = {"full": lambda r: "full", "random": lambda r: "random", "curated": lambda r: f"curated:{r.get('signal')}"}
    usable = [r for r in good if (r.get("success") if r.get("success") is not None else -1) >= 0 and r.get("arm") in label]
    rates: dict[str, list[float]] = {}
    for r in usable:
        rates.setdefault(label[r["arm"]](r), []).append(float(r["success"]))
    return RunGroups(rates, len(runs) - len(good), len(good) - len(usable))
