"""Readers of grouped files on executors, roles and subsets of datasets, reports and run groups."""

import json
import os
from contextlib import contextmanager

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewright.operators import reports
from tidewright.plans import runs
from tidewright.sources import datasets, fixtures


def opener(folder):
    """A folder of .npz files stands for a file of groups; parts named obs/<key> are its observations."""

    @contextmanager
    def opened():
        import numpy

        class Folder:
            def __getitem__(self, name):
                flat = dict(numpy.load(f"{folder}/{name}.npz"))
                return {k: v for k, v in flat.items() if "/" not in k} | {"obs": {k[4:]: v for k, v in flat.items() if k.startswith("obs/")}}

        yield Folder()

    return opened


def save(folder, name, n, **more):
    rng = np.random.default_rng(n)
    parts = {"actions": rng.normal(size=(n, 2)), "rewards": np.arange(n, dtype=float), "obs/pose": rng.normal(size=(n + 1, 3)), "obs/grip": rng.normal(size=n + 1)} | more
    np.savez(f"{folder}/{name}.npz", **parts)
    return parts


def test_groups_are_read_where_they_are_opened(spark, tmp_path):
    made = {name: save(tmp_path, name, n) for name, n in (("demo_10", 4), ("demo_2", 6), ("demo_1", 1))}
    names = [f[:-4] for f in os.listdir(tmp_path)] + ["mask"]
    layout = datasets.GroupLayout(pattern=r"demo_\d+", keys=("pose", "grip"), expose=("grip", "absent"), hz=20.0)
    rows = datasets.read_opened(spark, names, opener(str(tmp_path)), layout).orderBy("episode_index", "step").collect()
    assert [r.group for r in rows] == ["demo_1"] + ["demo_2"] * 6 + ["demo_10"] * 4
    for r in rows:
        part = made[r.group]
        assert r.action == part["actions"][r.step].tolist() and r.reward == r.step and r.t == pytest.approx(r.step / 20)
        assert r.state == [*part["obs/pose"][r.step], part["obs/grip"][r.step]]
        assert r["observation.grip"] == [part["obs/grip"][r.step]] and r["observation.absent"] is None
    assert datasets.read_opened(spark, [], opener(str(tmp_path)), layout).count() == 0


def test_groups_in_memory_agree_and_images_are_refused(spark, tmp_path):
    part = save(tmp_path, "demo_3", 5)
    group = {"actions": part["actions"], "rewards": part["rewards"], "obs": {"pose": part["obs/pose"], "grip": part["obs/grip"]}}
    a = datasets.read_groups(spark, {"demo_3": group}).orderBy("step").collect()
    b = datasets.read_opened(spark, ["demo_3"], opener(str(tmp_path))).orderBy("step").collect()
    assert a == b and len(a) == 5
    with pytest.raises(NotImplementedError, match="wrist_image"):
        datasets.read_groups(spark, {"demo_3": group | {"obs": {"wrist_image": np.zeros((5, 2))}}})
    with pytest.raises(KeyError, match="wheel"):
        datasets.read_groups(spark, {"demo_3": group}, layout=datasets.GroupLayout(keys=("wheel",)))


def test_roles_views_and_subsets(spark, tmp_path):
    root = str(tmp_path / "made")
    fixtures.write_demo(root, fixtures.demonstrations(5, 6))
    data = datasets.read(spark, root)
    assert data.has("action") and not data.has("reward") and data.view("REWARD") is None
    with pytest.raises(KeyError, match="reward"):
        data.feature("reward")
    assert data.select_roles("PROPRIO", "ACTION", "REWARD").columns == ["episode_index", "step", "t", "action", "observation.state"]
    assert data.view("ACTION").count() == 30
    order = spark.createDataFrame([(4, 0), (1, 1), (3, 2)], "episode_index long, ord int")
    part = data.subset(order)
    assert [r.episode_index for r in part.episodes.orderBy("ord").collect()] == [4, 1, 3] and part.frames.count() == 18
    out = str(tmp_path / "out")
    datasets.write(part, part.episodes, out)
    again = datasets.read(spark, out)
    first = lambda d, e: d.episode(e).first().action
    assert [first(again, i) for i in range(3)] == [first(data, e) for e in (4, 1, 3)]
    same, other = datasets.subset_hash("x", order), datasets.subset_hash("x", order.withColumn("ord", -F.col("ord")))
    assert same == datasets.subset_hash("x", order) and same != other and len(same) == 64


def test_reports_of_runs(spark):
    a = spark.createDataFrame([(0, "jerk", 1.0, False), (1, "jerk", 3.0, False), (0, "old", 1.0, True)], "episode_index long, signal string, value double, higher_is_better boolean")
    b = spark.createDataFrame([(0, "jerk", 5.0, False), (1, "jerk", None, False)], a.schema)
    found = {r.signal: r for r in reports.compare_signals(a, b).collect()}
    assert (found["jerk"].median_a, found["jerk"].median_b, found["jerk"].delta, found["jerk"].scored_b) == (2.0, 5.0, 3.0, 1)
    assert found["old"].median_b is None and found["old"].delta is None
    source = spark.createDataFrame([(0, "f0"), (1, "f1"), (2, "f2")], "episode_index long, fingerprint string")
    left = lambda curated: sorted(r.episode_index for r in reports.diff_or_index(source, curated).collect())
    assert left(spark.createDataFrame([(9, "f1")], source.schema)) == [0, 2]
    assert left(spark.createDataFrame([(0, None)], source.schema)) == [1, 2]
    groups = spark.createDataFrame([(0, "u"), (1, "u")], "episode_index long, who string")
    (row,) = reports.box(a.where("signal = 'jerk'"), groups, "who").collect()
    assert (row.n, row.low, row.q1, row.median, row.q3, row.high) == (2, 1.0, 1.5, 2.0, 2.5, 3.0)


def test_filter_keys_and_run_groups(spark, tmp_path):
    names = spark.createDataFrame([(i, f"demo_{i}") for i in range(12)], "episode_index long, group string")
    train = [f"demo_{i}" for i in range(2, 12)]
    kept = names.where("episode_index in (0, 3, 5, 11)")
    keys = runs.filter_keys(names, kept, train, seed=4)
    assert keys["curated"] == ["demo_11", "demo_3", "demo_5"]
    want = np.random.default_rng(4).choice(train, size=3, replace=False)
    assert keys["random_equalN"] == sorted(want.tolist()) and keys == runs.filter_keys(names, kept, train[::-1], seed=4)
    assert runs.filter_keys(names, kept.limit(0), train) == {"curated": [], "random_equalN": []}
    file = tmp_path / "runs.json"
    done = [{"ok": True, "arm": "curated", "signal": s, "success": v} for s, v in (("jerk", 0.2), ("noise", 0.9), ("jerk", 0.4))]
    done += [{"ok": True, "arm": a, "success": v} for a, v in (("random", 0.5), ("full", 0.7), ("other", 0.1), ("full", None), ("random", -1))] + [{"ok": False, "arm": "full"}]
    file.write_text(json.dumps(done))
    found = runs.load_groups(str(file))
    assert (found.failed, found.skipped) == (1, 3) and found.rates["curated:jerk"] == [0.2, 0.4]
    assert found.labels() == ["full", "random", "curated:noise", "curated:jerk"]
    file.write_text("{}")
    with pytest.raises(ValueError):
        runs.load_groups(str(file))
