"""Known answers for signals, selection, corruptions, statistics, sources and the command line."""

import json
import shutil

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewright import cli
from tidewright.functions import kernels as K
from tidewright.operators import corruptions, curation, learned, reports, stats
from tidewright.operators import signals as S
from tidewright.plans import curator, experiment, scorecard
from tidewright.sources import datasets

SCHEMA = "episode_index long, step int, t double, action array<double>, state array<double>"


def make(spark, episodes, hz=10.0):
    rows = [(e, i, i / hz, [float(v) for v in x], [float(v) for v in np.cumsum(a, 0)[i]]) for e, a in enumerate(episodes) for i, x in enumerate(a)]
    return spark.createDataFrame(rows, SCHEMA)


def ramp(n=24, d=2, k=1.0):
    return np.linspace(0, k, n)[:, None] * np.ones(d)


def values(scores):
    return {r.episode_index: r.value for r in scores.collect()}


def numpy_jerk(a, hz=10.0, order=2):
    t, x = np.arange(len(a)) / hz, np.array(a, float)
    s = x.std(0)
    x = np.where(s > 0, (x - x.mean(0)) / np.where(s > 0, s, 1), 0)
    for _ in range(order):
        x = np.gradient(x, t, axis=0)
    return np.linalg.norm(x, axis=1)


def test_jerk_equals_numpy_and_skips(spark):
    draw = np.random.default_rng(0)
    eps = [ramp(16), np.where(np.arange(16)[:, None] % 2, 1, -1) * np.ones(2), draw.normal(size=(20, 3))[:, :2], ramp(2)]
    got = {r.episode_index: r for r in S.jerk(make(spark, eps)).collect()}
    for e in range(3):
        assert got[e].value == pytest.approx(numpy_jerk(eps[e]).mean(), abs=1e-9)
    assert got[1].value > got[0].value and got[3].value is None and got[3].skip_reason == "too short"


def test_jerk_uneven_time_and_bad_values(spark):
    t = np.array([0, 0.1, 0.3, 0.35, 0.6])
    rows = [(0, i, float(t[i]), [float(i * i)], [0.0]) for i in range(5)] + [(1, i, float(i), [float("nan") if i == 2 else 1.0 * i], [0.0]) for i in range(5)] + [(2, i, 1.0, [1.0 * i], [0.0]) for i in range(5)]
    got = {r.episode_index: r for r in S.jerk(spark.createDataFrame(rows, SCHEMA)).collect()}
    x = np.arange(5.0) ** 2
    x = (x - x.mean()) / x.std()
    assert got[0].value == pytest.approx(np.abs(np.gradient(np.gradient(x, t), t)).mean(), abs=1e-9)
    assert got[1].value == 0 and got[2].skip_reason == "time does not increase"


def test_action_noise_finds_noise_and_length_outliers(spark):
    draw = np.random.default_rng(1)
    eps = [ramp(24, 2, 1 + 0.1 * i) + 0.01 * draw.normal(size=(24, 2)) for i in range(5)] + [ramp(24) + 0.5 * draw.normal(size=(24, 2))]
    v = values(S.action_noise(make(spark, eps)))
    assert max(v, key=v.get) == 5
    eps = [ramp(20) + 0.01 * draw.normal(size=(20, 2)) for _ in range(6)] + [ramp(120) + 0.01 * draw.normal(size=(120, 2))]
    rows = {r.episode_index: r for r in S.action_noise(make(spark, eps)).collect()}
    assert rows[6].is_outlier and rows[6].outlier_z > 3.5


def test_median_filter_pads_with_ends(spark):
    long = K.to_long(make(spark, [np.array([[5.0], [1.0], [2.0], [9.0], [3.0]])]), "action")
    for w in (3, 5):
        got = [r.smooth for r in K.median_filter(long, w).orderBy("step").collect()]
        x, h = np.pad([5.0, 1, 2, 9, 3], w // 2, mode="edge"), w
        assert got == [float(np.median(x[i : i + h])) for i in range(5)]


def test_path_efficiency_and_sparc(spark):
    straight = np.tile([0.1, 0, 0], (12, 1))
    meander = np.array([[0.1 * (-1) ** i, 0, 0] for i in range(12)])
    v = values(S.path_efficiency(make(spark, [straight, meander, np.zeros((12, 3))])))
    assert v[0] > 0.99 and v[1] < 0.2 and v[2] is None
    n = np.arange(64)
    smooth = np.stack([np.sin(np.pi * n / 63)] * 3, 1)
    rough = smooth + 0.5 * np.sin(2.2 * n)[:, None]
    v = values(S.spectral_smoothness(make(spark, [smooth, rough, smooth[:3]], 20.0)))
    assert v[1] < v[0] <= 0 and v[2] is None


def test_redundancy_and_embedding(spark):
    draw = np.random.default_rng(2)
    eps = [ramp(24), ramp(48, 2, 8), ramp(24, 2, 0.1)] + [ramp(24, 2, 4) + 1e-4 * draw.normal(size=(24, 2)) for _ in range(3)]
    e = S.statistical_embedding(make(spark, eps), state="state")
    assert len(e.columns) == 8
    row = e.where("episode_index = 1").first()
    norms = np.linalg.norm(eps[1], axis=1)
    assert row.action_mean == pytest.approx(norms.mean()) and row.action_std == pytest.approx(norms.std()) and row.n_steps == 48
    v = values(S.redundancy(S.standardised(e, S.EMBEDDING)))
    assert max(v[i] for i in (3, 4, 5)) < min(v[i] for i in (0, 1, 2))


def test_nearest_is_exact_across_blocks(spark):
    x = np.random.default_rng(3).normal(size=(60, 20))
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "episode_index long, v array<double>")
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    np.fill_diagonal(d, np.inf)
    for k in (1, 3):
        got = {r.episode_index: r.distance for r in S.nearest(df, k, block=17).collect()}
        for i in range(60):
            assert got[i] == pytest.approx(np.sort(d[i])[:k].mean(), abs=1e-12)


def test_structural_and_sim_validity(spark):
    eps = [ramp(64)] * 4 + [ramp(20), np.concatenate([ramp(32), np.tile(ramp(32)[-1], (32, 1))]), np.full((64, 2), np.inf)]
    rows = {r.episode_index: r for r in S.structural_validity(make(spark, eps)).collect()}
    assert rows[0].value == 0 and rows[0].is_valid
    assert rows[4].truncated > 0 and rows[5].stalled > 0 and rows[6].value >= 1e6
    sim = [(e, i, i / 10, 0.05 if e == 1 and i == 3 else 0.0, [5.0 if e == 2 and i > 5 else 0.0, 0.0, float("inf") if e == 3 and i == 4 else 0.0]) for e in range(4) for i in range(12)]
    df = spark.createDataFrame(sim, "episode_index long, step int, t double, pen double, pos array<double>")
    v = values(S.sim_validity(df, "pen", ["pos"]))
    assert v[0] == 0 and v[1] == pytest.approx(0.045) and v[2] == pytest.approx(4.0) and v[3] >= 1e6


def test_image_signals(spark):
    draw = np.random.default_rng(4)
    sharp = draw.integers(0, 255, (12, 16, 20, 3)).astype(np.uint8)
    videos = {0: np.full((12, 16, 20, 3), 90, np.uint8), 1: np.repeat(sharp[:1], 12, 0), 2: sharp, 3: np.repeat(sharp[:1], 12, 0)}
    df = spark.createDataFrame([(e, i, bytearray(f.tobytes())) for e, fs in videos.items() for i, f in enumerate(fs)], "episode_index long, step int, frame binary")
    blur, still, unique = (values(f(df, (16, 20, 3))) for f in (S.image_blur, S.visual_stall, S.visual_diversity))
    assert blur[0] > blur[2] and still[1] == pytest.approx(0.9) and still[2] == 0
    assert unique[1] == pytest.approx(0) and unique[2] > 0


def test_contract_checker_and_registry(spark):
    frames = make(spark, [ramp(24), ramp(20)])
    assert S.check_contract(S.REGISTRY.get("jerk"), frames) == []
    assert any("row per episode" in p for p in S.check_contract(lambda f: S.jerk(f).limit(1), frames))
    assert any("raises" in p for p in S.check_contract(lambda f: 1 / 0, frames))
    assert "jerk" in S.REGISTRY.available()
    with pytest.raises(KeyError):
        S.REGISTRY.get("nothing")
    with pytest.raises(ValueError):
        S.REGISTRY.register("jerk", S.jerk)


def test_budget_and_baseline():
    assert [curation.Budget("fraction", f).resolve(5) for f in (0.1, 0.3, 0.5, 2.0)] == [0, 2, 2, 5]
    assert curation.Budget("count", 3).resolve(2) == 2 and curation.Budget().resolve(7) == 7
    assert curation.equal_n_baseline(list(range(8)), 6, 0) == [1, 2, 3, 4, 6, 7]


def test_combination_gate_and_reasons(spark):
    rows = [(0, "a", 1.0, True), (1, "a", 3.0, True), (2, "a", None, True), (0, "b", 5.0, False), (1, "b", 5.0, False), (2, "b", 5.0, False)]
    scores = spark.createDataFrame(rows, "episode_index long, signal string, value double, higher_is_better boolean")
    got = {r.episode_index: r.keep_score for r in curation.weighted_sum(scores, {"a": 3.0}).collect()}
    assert got == {0: pytest.approx(0.125), 1: pytest.approx(0.875), 2: pytest.approx(0.5)}
    assert {r.keep_score for r in curation.weighted_sum(scores, {"a": 0.0, "b": 0.0}).collect()} == {0.0}
    gate = curation.Gate("a", reject_above=2.0)
    assert [r.episode_index for r in scores.where((F.col("signal") == "a") & gate.rejects(F.col("value"))).collect()] == [1]
    with pytest.raises(ValueError):
        curator.CurationSpec(gate=curation.Gate("nothing", 1.0))
    with pytest.raises(ValueError):
        curator.CurationSpec(drop=[1], keep=[2])


def greedy(points, order, eps):
    kept = []
    for i in order:
        if all(np.linalg.norm(points[i] - points[j]) > eps for j in kept):
            kept.append(i)
    return set(kept)


def test_greedy_dedup_equals_the_walk(spark):
    draw = np.random.default_rng(5)
    points = draw.random((120, 4))
    points[100:] = points[7]
    score = draw.random(120).round(1)
    keep = spark.createDataFrame([(i, f"{i:04d}", float(s)) for i, s in enumerate(score)], "episode_index long, fingerprint string, keep_score double")
    vectors = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(points)], "episode_index long, v array<double>")
    order = sorted(range(120), key=lambda i: (-score[i], f"{i:04d}"))
    got = {r.episode_index for r in curation.greedy_dedup(keep, vectors, 0.35).where("kept").collect()}
    assert got == greedy(points, order, 0.35)
    some = {r.episode_index for r in curation.greedy_dedup(keep, vectors, 0.35, k=5).where("kept").collect()}
    assert some == set([i for i in order if i in got][:5])


def test_coverage_equals_plain_greedy():
    draw = np.random.default_rng(6)
    x = np.concatenate([draw.normal(c, 0.1, (8, 2)) for c in (0, 5, 10)])
    keep = [(i, f"{i:03d}", float(draw.random())) for i in range(24)]
    order = sorted(keep, key=lambda r: (-r[2], r[1]))
    sim = -np.linalg.norm(x[:, None] - x[None], axis=2)
    for w in (0.0, 2.0):
        covered, chosen = None, []
        while len(chosen) < 6:
            best = None
            for r in order:
                if r[0] not in chosen:
                    gain = np.inf if covered is None else np.maximum(0, sim[r[0]] - covered).sum() + w * r[2]
                    if best is None or gain > best[0] + 1e-12:
                        best = (gain, r[0])
            chosen.append(best[1])
            covered = sim[best[1]] if covered is None else np.maximum(covered, sim[best[1]])
        assert curation.coverage(keep, {i: x[i] for i in range(24)}, 6, w) == chosen
    assert len({i // 8 for i in curation.coverage(keep, {i: x[i] for i in range(24)}, 3)}) == 3
    assert curation.coverage(keep, {}, 3) == [r[0] for r in order[:3]]


def test_corruptions(spark):
    eps = [np.random.default_rng(7).normal(size=(24, 2)), ramp(2)]
    frames = make(spark, eps)
    count = lambda df: {r.episode_index: r["count"] for r in df.groupBy("episode_index").count().collect()}
    assert count(corruptions.truncate(frames, 0.5)) == {0: 12, 1: 2}
    assert count(corruptions.frame_skip(frames)) == {0: 6, 1: 2}
    assert count(corruptions.stall(frames))[0] == 32
    q = np.array([r.action for r in corruptions.action_quantize(frames).where("episode_index = 0").orderBy("step").collect()])
    g = 0.5 * eps[0].std(0)
    assert np.allclose(q, np.round(eps[0] / g) * g)
    d = np.array([r.action for r in corruptions.corrupt(frames, "dropped_dof").where("episode_index = 0").orderBy("step").collect()])
    assert (d == 0).all(0).sum() == 1
    o = np.array([r.action for r in corruptions.corrupt(frames, "wrong_target_offset").where("episode_index = 0").orderBy("step").collect()])
    assert np.allclose(np.diff(o, axis=0), np.diff(eps[0], axis=0))
    for kind in corruptions.SEEDED:
        a, b = (corruptions.corrupt(frames, kind, seed=9).orderBy("episode_index", "step").collect() for _ in range(2))
        assert a == b
    smooth = make(spark, [ramp(24, 2, 1 + 0.05 * i) + 0.01 * np.sin(np.arange(24))[:, None] for i in range(8)])
    found = {(r.kind, r.signal): r.auc for r in corruptions.detection_matrix(smooth, ["jitter", "truncate"], {"j": S.jerk, "s": S.structural_validity}).collect()}
    assert stats.detection_class(found["jitter", "jerk"]) == "detects"


def test_auc_spearman_bootstrap_split(spark):
    df = spark.createDataFrame([("x", True, 3.0), ("x", True, 1.0), ("x", False, 1.0), ("x", False, 0.0), ("y", True, 1.0)], "g string, p boolean, v double")
    got = {r.g: r.auc for r in stats.rank_auc(df, ["g"], "p", "v").collect()}
    assert got == {"x": pytest.approx(0.875), "y": None}
    e = stats.bootstrap([1.0, 2.0, 3.0, 4.0])
    assert e.low <= e.mean <= e.high and stats.bootstrap([2.0]).low == 2.0 and stats.bootstrap([]).n == 0
    assert stats.paired_effect([1, 1.1, 0.9], [3, 3.2, 2.9]).separated
    train, held = stats.split(10, 0.2, 0)
    assert len(held) == 2 and sorted(train + held) == list(range(10))


def test_reports(spark):
    a = spark.createDataFrame([(0, True, "k"), (1, True, "k"), (2, False, "b")], "episode_index long, kept boolean, reason string")
    b = spark.createDataFrame([(0, True, "k"), (1, False, "b"), (3, False, "b")], "episode_index long, kept boolean, reason string")
    r = reports.compare(a, b).first()
    assert (r.n_both, r.n_either, r.only_a, r.only_b, r.jaccard) == (1, 2, 1, 0, 0.5)
    assert reports.compare(a.limit(0), b.limit(0)).first().jaccard == 1
    assert {x.episode_index: x.problem for x in reports.verify(a, b).collect()} == {1: "kept differs", 2: "missing", 3: "not expected"}
    h = reports.length_histogram(spark.createDataFrame([(n,) for n in (1, 2, 2, 3)], "n long"), "n").orderBy("bucket").collect()
    assert [(x.low, x.high, x.n) for x in h] == [(1, 1, 1), (2, 2, 2), (3, 3, 1)]


def test_curator_removes_the_worst_and_repeats_itself(spark):
    eps = [ramp(16, 2, 1 + 0.1 * i) for i in range(5)] + [np.where(np.arange(16)[:, None] % 2, 1, -1) * np.ones(2)]
    frames = make(spark, eps)
    spec = curator.CurationSpec(budget=curation.Budget("count", 5))
    one, two = curator.run(frames, spec), curator.run(frames, spec)
    rows = {r.episode_index: r for r in one.decisions.collect()}
    assert not rows[5].kept and rows[5].reason.startswith("below budget") and sum(r.kept for r in rows.values()) == 5
    assert one.manifest() == two.manifest() and len(one.baseline) == 5
    dropped = {r.episode_index: r.reason for r in curator.run(frames, curator.CurationSpec(drop=[2])).decisions.collect()}
    assert dropped[2] == "on the drop list"
    only = {r.episode_index: r.kept for r in curator.run(frames, curator.CurationSpec(keep=[1, 3])).decisions.collect()}
    assert [i for i, k in only.items() if k] == [1, 3]
    gated = {r.episode_index: r.reason for r in curator.run(frames, curator.CurationSpec(gate=curation.Gate("jerk", reject_above=10.0))).decisions.collect()}
    assert gated[5].startswith("gated")
    for selection in ("greedy_dedup", "coverage"):
        assert curator.run(frames, curator.CurationSpec(budget=curation.Budget("count", 3), selection=selection)).decisions.where("kept").count() <= 3
    card = scorecard.scorecard(one)
    assert "Kept 5 of 6" in scorecard.markdown(card) and "<table>" in scorecard.html_page(card)


def write_v21_source(root, episodes):
    import pyarrow as pa
    import pyarrow.parquet as pq

    (root / "meta").mkdir(parents=True)
    (root / "data/chunk-000").mkdir(parents=True)
    features = {"timestamp": {"dtype": "float32", "shape": []}, "action": {"dtype": "float32", "shape": [2]}, "observation.state": {"dtype": "float32", "shape": [2]}}
    (root / "meta/info.json").write_text(json.dumps({"codebase_version": "v2.1", "fps": 10, "features": features, "total_episodes": len(episodes)}))
    lines, at = [], 0
    for e, a in enumerate(episodes):
        n = len(a)
        pq.write_table(pa.table({"timestamp": pa.array(np.arange(n) / 10, pa.float32()), "action": pa.array(a.tolist(), pa.list_(pa.float32())), "observation.state": pa.array(np.cumsum(a, 0).tolist(), pa.list_(pa.float32())), "episode_index": pa.array([e] * n), "frame_index": pa.array(range(n)), "index": pa.array(range(at, at + n)), "task_index": pa.array([0] * n)}), root / f"data/chunk-000/episode_{e:06d}.parquet")
        lines.append({"episode_index": e, "length": n, "tasks": ["reach"]} | ({"success": e % 2 == 0} if e < 4 else {}))
        at += n
    (root / "meta/episodes.jsonl").write_text("".join(json.dumps(x) + "\n" for x in lines))


@pytest.fixture
def source(tmp_path):
    write_v21_source(tmp_path / "src", [ramp(12 + i, 2, 1 + i) for i in range(5)] + [np.where(np.arange(14)[:, None] % 2, 1.0, -1.0) * np.ones(2)])
    return str(tmp_path / "src")


def test_datasets_round_trip(spark, source, tmp_path):
    data = datasets.read(spark, source)
    before = datasets.checksums(source)
    assert data.version == "v2.1" and datasets.validate(spark, source) == []
    assert {r.episode_index: r.success for r in data.episodes.collect()} == {0: True, 1: False, 2: True, 3: False, 4: None, 5: None}
    kept = spark.createDataFrame([(0,), (2,), (5,)], "episode_index long")
    prints = {r.episode_index: r.fingerprint for r in datasets.fingerprints(data.frames, data.features).collect()}
    for name, writer in (("v21", datasets.write_v21), ("v3", datasets.write_v3)):
        dest = str(tmp_path / name)
        sums = writer(data, kept, dest)
        again = datasets.read(spark, dest)
        assert again.version == {"v21": "v2.1", "v3": "v3.0"}[name] and sums
        got = {r.episode_index: r.fingerprint for r in datasets.fingerprints(again.frames, data.features).collect()}
        assert got == {0: prints[0], 1: prints[2], 2: prints[5]}
        assert [r["index"] for r in again.frames.orderBy("index").select("index").collect()] == list(range(12 + 14 + 14))
        with pytest.raises(FileExistsError):
            writer(data, kept, dest)
    with pytest.raises(ValueError):
        datasets.write_v21(data, kept, source + "/inside")
    assert datasets.checksums(source) == before
    assert datasets.dataset_hash(datasets.fingerprints(data.frames, data.features)) == datasets.dataset_hash(datasets.fingerprints(datasets.read(spark, source).frames, data.features))


def test_unreadable_files_are_told(spark, source):
    from pathlib import Path

    bad = Path(source, "data/chunk-000/episode_000003.parquet")
    bad.write_bytes(b"not parquet")
    good, broken = datasets.readable(spark, source)
    assert len(good) == 5 and list(broken) == [str(bad)]


def test_nested_and_grouped_sources(spark):
    rows = [(0, [((([1.0, 2.0],)), [0.5], 1.0), ((([3.0, 4.0],)), [0.6], 0.0)])]
    df = spark.createDataFrame(rows, "episode_index long, steps array<struct<observation struct<pose array<double>>, action array<double>, reward double>>")
    got = datasets.read_nested(df).orderBy("step").collect()
    assert got[1]["observation.pose"] == [3.0, 4.0] and got[1].t == pytest.approx(0.1)
    groups = {f"demo_{i}": {"actions": np.full((4, 2), i), "obs": {"b": np.ones((5, 1)), "a": np.zeros((5, 2))}} for i in (10, 2, 1)} | {"mask": {"actions": np.zeros((1, 1))}}
    g = datasets.read_groups(spark, groups, r"demo_\d+")
    assert [r.group for r in g.select("episode_index", "group").distinct().orderBy("episode_index").collect()] == ["demo_1", "demo_2", "demo_10"]
    assert g.first().state == [0.0, 0.0, 1.0] and g.count() == 12


def test_learned_signals_and_benchmark(spark):
    draw = np.random.default_rng(8)
    rows = []
    for e in range(16):
        s = draw.normal(size=(24, 2))
        a = (1 if e < 12 else -1) * s + 0.02 * draw.normal(size=(24, 2))
        rows += [(e, i, i / 10, a[i].tolist(), s[i].tolist()) for i in range(24)]
    frames = spark.createDataFrame(rows, SCHEMA).persist()
    v = values(learned.influence(frames, epochs=80))
    assert np.mean([v[i] for i in range(12)]) > np.mean([v[i] for i in range(12, 16)])
    vectors = spark.createDataFrame([(i, [float(i < 10), float(draw.normal())]) for i in range(20)], "episode_index long, v array<double>")
    labels = spark.createDataFrame([(i, (i < 10) != (i == 3)) for i in range(20)], "episode_index long, success boolean")
    p = values(learned.demo_score(vectors, labels))
    assert np.mean([p[i] for i in range(10)]) > 0.6 > 0.4 > np.mean([p[i] for i in range(10, 20)])
    assert learned.demo_score(vectors, labels.limit(2)).where("value is null").count() == 20
    spec = experiment.BenchmarkSpec.build(frames, "pool")
    spec.policy, spec.seeds = {"hidden": 16, "epochs": 60}, [0, 1]
    good = [i for i in spec.train if i < 12]
    entry = experiment.run_submission("good", {"kept_episode_indices": good}, frames, spec, "pool")
    assert entry["submitted_mean"] < np.mean(entry["losses"]["full"])
    with pytest.raises(ValueError):
        experiment.resolve({"kept_episode_indices": [999]}, frames, spec)
    with pytest.raises(ValueError):
        experiment.run_submission("x", {}, frames, spec, "another")


def test_gradients_are_right():
    m = learned.MLP(3, 2, 4)
    draw = np.random.default_rng(9)
    x, y = draw.normal(size=(5, 3)), draw.normal(size=(5, 2))
    loss = lambda: ((m.predict(x) - y) ** 2).mean(1).sum()
    g = m.gradient(x, y, 1.0)
    for i, w in enumerate(m.weights):
        at = tuple(0 for _ in w.shape)
        w[at] += 1e-6
        up = loss()
        w[at] -= 2e-6
        down = loss()
        w[at] += 1e-6
        assert g[i][at] == pytest.approx((up - down) / 2e-6, rel=1e-4, abs=1e-7)


def test_command_line(spark, source, tmp_path, capsys):
    out = str(tmp_path / "curated")
    assert cli.main(["curate", source, "--out", out, "--signals", "jerk", "--budget", "0.8", "--save-recipe", str(tmp_path / "r.json"), "--report-html", str(tmp_path / "r.html")]) == 0
    manifest = json.loads((tmp_path / "curated/manifest.json").read_text())
    assert sum(d["kept"] for d in manifest["decisions"]) == 5 and not manifest["decisions"][5]["kept"]
    assert cli.main(["verify", source, out + "/manifest.json"]) == 0
    assert cli.main(["validate", out]) == 0
    assert cli.main(["diff", source, out]) == 0
    assert cli.main(["rank", source, "--worst", "1", "--out-flags", str(tmp_path / "f.json")]) == 0
    assert json.loads((tmp_path / "f.json").read_text()) == {"episode_indices": [5]}
    for args in (["profile", source], ["explain", source, "5"], ["inspect", source, "5"], ["baseline", source, "--n", "3"], ["list-signals"], ["report", out + "/manifest.json"], ["compare", out + "/manifest.json", out + "/manifest.json"], ["score", source]):
        assert cli.main(args) == 0
    assert cli.main(["verify", source, str(tmp_path / "r.json")]) == 1
    (tmp_path / "curated/data/chunk-000/episode_000001.parquet").unlink()
    assert cli.main(["validate", out]) == 1
    shutil.rmtree(out)
    capsys.readouterr()


def test_made_datasets_and_quarantine(spark, tmp_path):
    from pathlib import Path

    from tidewright.sources import fixtures

    root = str(tmp_path / "demo")
    fixtures.write_demo(root, fixtures.demonstrations())
    spec = curator.CurationSpec(budget=curation.Budget("count", 4))
    result, problems = curator.run_dataset(spark, root, spec, "quarantine")
    assert problems == {} and {r.episode_index for r in result.decisions.where("not kept").collect()} == {1, 3, 5, 7}
    Path(root, "data/chunk-000/episode_000002.parquet").write_bytes(b"broken")
    with pytest.warns(UserWarning, match="do not read"):
        result, problems = curator.run_dataset(spark, root, spec, "quarantine")
    assert len(problems) == 1 and result.decisions.count() == 8
    (lost,) = result.decisions.where("episode_index = 2").collect()
    assert not lost.kept and lost.reason.startswith("quarantined: unreadable episode (") and lost.keep_score is None
    with pytest.raises(FileNotFoundError):
        datasets.resolve("nowhere at all")
    assert datasets.resolve(root) == root


def test_labels_of_groups(spark):
    groups = {f"demo_{i}": {"actions": np.zeros((3, 1)), "rewards": [0, 0, i % 2], "success": [False, True, i > 1]} for i in range(3)}
    rows = datasets.group_labels(spark, groups, datasets.ROBOMIMIC, {"worse": ["demo_2"]}).orderBy("episode_index").collect()
    assert [r.success for r in rows] == [False, True, False] and [r.operator_tier for r in rows] == [None, None, "worse"]
    flags = datasets.group_labels(spark, groups, datasets.GroupLayout("", r"demo_\d+", success="last_flag")).orderBy("episode_index").collect()
    assert [r.success for r in flags] == [False, False, True]


def test_health_plots_and_gates(spark, tmp_path):
    from tidewright.plans import plots

    frames = make(spark, [ramp(64)] * 3 + [ramp(20)])
    flat = frames.withColumn("x", F.get("action", 0))
    found = reports.health(flat, S.structural_validity(frames), ["x"], {"a": "b"})
    assert found["defects"] == [3] and found["coverage"][0]["coverage"] == 1 and "1 truncated" in reports.health_markdown(found)
    assert reports.action_roughness(frames).first().quality == pytest.approx(0, abs=1e-12)
    assert {r.n for r in plots.histogram(S.jerk(frames), 4).collect()} and reports.step_summary(S.jerk_steps(frames)).count() == 4
    curator.SPECS["needs_gpu"] = S.Spec("needs_gpu", True, requires=("gpu",))
    with pytest.warns(UserWarning, match="GPU"):
        assert curator.usable(["jerk", "needs_gpu"], curator.Resources()) == ["jerk"]
    assert curator.usable(["needs_gpu"], curator.Resources(gpus=1)) == ["needs_gpu"]
    curator.SPECS.clear()


def test_experiments(spark):
    from tidewright.sources import fixtures

    frames = fixtures.in_memory(spark, fixtures.identity(10, 4)).persist()
    config = experiment.ExperimentConfig({"signals": {"path_efficiency": {}}, "budget": {"kind": "fraction", "value": 0.7}}, seeds=[0, 1], policy={"hidden": 8, "epochs": 30})
    r = experiment.run_config(frames, config)
    assert set(r["arms"]) == {"full", "curated", "equal_n_random", "random_filter"} and "headline" in r
    assert "| curated |" in experiment.report_markdown(r)
    c = experiment.compare_held_out(frames, list(range(8)), seeds=(0,), hidden=8, epochs=30)
    assert set(c["losses"]) == {"full", "random", "random_steps", "curated"}
    env = experiment.FakeEnvironment(1)
    assert env.rollouts(2.0, 200) > env.rollouts(-2.0, 200) and env.rollouts(0.3, 50) == experiment.FakeEnvironment(1).rollouts(0.3, 50)
    steps = spark.createDataFrame([(0, False), (0, True), (1, False)], "episode_index long, success boolean")
    assert {x.episode_index: x.success for x in experiment.latched_success(steps).collect()} == {0: True, 1: False}


def test_in_order_ranks_and_sums(spark):
    draw = np.random.default_rng(10)
    rows = [(int(i), int(draw.integers(0, 5)), int(draw.integers(1, 9))) for i in draw.permutation(200)]
    df = spark.createDataFrame(rows, "id long, k long, n long").repartition(5)
    got = {r.id: (r["rank"], r.before) for r in K.in_order(df, F.col("k").desc(), F.col("id").asc(), total="n").collect()}
    total = 0
    for place, (i, _, n) in enumerate(sorted(rows, key=lambda r: (-r[1], r[0])), 1):
        assert got[i] == (place, total)
        total += n
    assert K.in_order(df.limit(0), F.col("id").asc(), total="n").count() == 0


def test_close_pairs_meet_in_neighbouring_cells(spark):
    x = np.random.default_rng(11).random((80, 3))
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "episode_index long, v array<double>")
    got = {(r.a, r.b) for r in curation.close_pairs(df, 0.2).collect()}
    assert got == {(i, j) for i in range(80) for j in range(i + 1, 80) if np.linalg.norm(x[i] - x[j]) <= 0.2}
