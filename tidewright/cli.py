"""Command line: score, curate, baseline, report, diff, list-signals, validate, explain, rank, profile, compare, verify, benchmark."""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tidewright.operators import curation, reports
from tidewright.operators import signals as S
from tidewright.plans import curator, experiment, scorecard
from tidewright.sources import datasets


def _spark() -> SparkSession:
    return SparkSession.builder.appName("tidewright").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def _frames(data: datasets.Dataset):
    frames = data.frames
    for c, kind in frames.dtypes:
        if kind == "array<float>":
            frames = frames.withColumn(c, F.transform(f"`{c}`", lambda x: x.cast("double")))
    return frames.withColumnRenamed("observation.state", "state")


def _spec(a) -> curator.CurationSpec:
    if a.recipe:
        return curator.load_recipe(a.recipe)
    names = a.signals.split(",") if a.signals else ["jerk"]
    budget = curation.Budget() if a.budget is None else curation.Budget("fraction" if a.budget <= 1 else "count", a.budget)
    read = lambda p: [] if not p else (lambda x: x if isinstance(x, list) else x["episode_indices"])(json.loads(Path(p).read_text()))
    return curator.CurationSpec({n.strip(): {} for n in names}, budget=budget, selection=a.selection, drop=read(a.drop_list), keep=read(a.keep_list), baseline=not a.no_baseline, seed=a.seed, coverage_quality_weight=a.coverage_quality_weight)


def _print(rows) -> None:
    print(json.dumps([r.asDict(recursive=True) for r in rows], indent=2, default=str))


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="tidewright")
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("score", "curate", "rank", "explain", "inspect"):
        c = sub.add_parser(name)
        c.add_argument("dataset")
        c.add_argument("--signals")
        c.add_argument("--recipe")
        c.add_argument("--budget", type=float)
        c.add_argument("--selection", default="top_k", choices=curator.SELECTIONS)
        c.add_argument("--coverage-quality-weight", type=float, default=0.0)
        c.add_argument("--drop-list")
        c.add_argument("--keep-list")
        c.add_argument("--no-baseline", action="store_true")
        c.add_argument("--no-videos", action="store_true")
        c.add_argument("--seed", type=int, default=0)
        if name == "curate":
            c.add_argument("--on-error", default="abort", choices=("abort", "quarantine"))
            c.add_argument("--no-card", action="store_true")
            c.add_argument("--json", action="store_true")
            c.add_argument("--out", required=True)
            c.add_argument("--save-recipe")
            c.add_argument("--report-html")
        if name == "rank":
            c.add_argument("--worst", type=int, default=10)
            c.add_argument("--out-flags")
        if name in ("explain", "inspect"):
            c.add_argument("episode", type=int)
    c = sub.add_parser("baseline")
    c.add_argument("dataset")
    c.add_argument("--n", type=int, required=True)
    c.add_argument("--seed", type=int, default=0)
    sub.add_parser("list-signals")
    for name in ("validate", "profile"):
        sub.add_parser(name).add_argument("dataset")
    for name in ("diff", "compare"):
        c = sub.add_parser(name)
        c.add_argument("a")
        c.add_argument("b")
    c = sub.add_parser("verify")
    c.add_argument("dataset")
    c.add_argument("manifest")
    sub.add_parser("report").add_argument("manifest")
    bench = sub.add_parser("benchmark").add_subparsers(dest="action", required=True)
    c = bench.add_parser("init")
    c.add_argument("dataset")
    c.add_argument("--out", required=True)
    c = bench.add_parser("run")
    c.add_argument("dataset")
    c.add_argument("--spec", required=True)
    c.add_argument("--submission", required=True)
    c.add_argument("--name", required=True)
    c.add_argument("--leaderboard")
    bench.add_parser("leaderboard").add_argument("file")
    a = p.parse_args(argv)

    if a.command == "list-signals":
        for name in S.REGISTRY.available():
            spec = curator.SPECS.get(name)
            print(name if spec is None else f"{name}: {'higher' if spec.higher_is_better else 'lower'} is better, {spec.cost}{', needs ' + ', '.join(spec.requires) if spec.requires else ''}")
        for name, why in S.REGISTRY.unavailable().items():
            print(f"{name}: not available ({why})")
        return 0
    if a.command == "report":
        m = json.loads(Path(a.manifest).read_text())
        kept = sum(d["kept"] for d in m["decisions"])
        print(f"kept {kept} of {len(m['decisions'])}\n" + "\n".join(f"episode {d['episode_index']}: {d['reason']}" for d in m["decisions"] if not d["kept"]))
        return 0
    if a.command == "benchmark" and a.action == "leaderboard":
        print(experiment.leaderboard_table(a.file))
        return 0
    if a.command == "compare":
        spark = _spark()
        runs = [spark.createDataFrame([(d["episode_index"], d["kept"]) for d in json.loads(Path(x).read_text())["decisions"]], "episode_index long, kept boolean") for x in (a.a, a.b)]
        _print(reports.compare(*runs).collect())
        return 0
    spark = _spark()
    if a.command == "diff":
        one, two = (datasets.read(spark, x) for x in (a.a, a.b))
        _print(reports.diff(datasets.fingerprints(one.frames, one.features), datasets.fingerprints(two.frames, one.features)).orderBy("episode_index").collect())
        return 0
    quarantined = None
    if a.command == "curate" and a.on_error == "quarantine":
        good, problems = datasets.readable(spark, a.dataset)
        if problems:
            print(f"{len(problems)} episode files do not read", file=sys.stderr)
            data = (datasets.read_v21 if datasets.detect_version(a.dataset) == "v2.1" else datasets.read_v3)(spark, a.dataset, good)
            quarantined = datasets.unreadable(spark, a.dataset, problems)
        else:
            data = datasets.read(spark, a.dataset)
    else:
        data = datasets.read(spark, a.dataset) if a.command != "validate" else None
    if a.command == "validate":
        problems = datasets.validate(spark, a.dataset)
        print("\n".join(problems) or "no problem was found")
        return int(bool(problems))
    if a.command == "baseline":
        ids = [r.episode_index for r in data.episodes.select("episode_index").orderBy("episode_index").toLocalIterator()]
        print(json.dumps(curation.equal_n_baseline(ids, a.n, a.seed)))
        return 0
    if a.command == "profile":
        e = data.episodes
        print(json.dumps({"lengths": reports.distribution(e, "n_steps").first().asDict(), "histogram": [r.asDict() for r in reports.length_histogram(e.select("n_steps"), "n_steps").orderBy("bucket").collect()], "success": reports.success_rate(e, "success").first().asDict(), "tasks": [r.asDict() for r in reports.task_counts(e, "tasks").orderBy("task").collect()]}, indent=2))
        return 0
    frames = _frames(data)
    if a.command == "benchmark":
        pool = datasets.dataset_hash(datasets.fingerprints(data.frames, data.features))
        if a.action == "init":
            experiment.BenchmarkSpec.build(frames, pool).save(a.out)
        else:
            entry = experiment.run_submission(a.name, json.loads(Path(a.submission).read_text()), frames, experiment.BenchmarkSpec.load(a.spec), pool)
            print(json.dumps(entry, indent=2))
            if a.leaderboard:
                experiment.append_entry(a.leaderboard, entry)
        return 0
    prints = datasets.fingerprints(data.frames, data.features)
    if a.command == "verify":
        m = json.loads(Path(a.manifest).read_text())
        if "decisions" not in m:
            print("a recipe has no decisions to verify")
            return 1
        again = curator.run(frames, curator.CurationSpec.from_dict(m["config"]), prints)
        expected = spark.createDataFrame([(d["episode_index"], d["kept"], d["reason"]) for d in m["decisions"]], "episode_index long, kept boolean, reason string")
        wrong = reports.verify(expected, again.decisions).collect()
        _print(wrong)
        return int(bool(wrong))
    if a.command == "inspect":  # scores of statistics need all episodes, the rest one
        spec = _spec(a)
        if set(spec.signals) <= {"jerk", "path_efficiency", "spectral_smoothness"}:
            frames, prints = frames.where(F.col("episode_index") == a.episode), prints.where(F.col("episode_index") == a.episode)
    result = curator.run(frames, _spec(a), prints, quarantined=quarantined)
    if a.command == "score":
        _print(result.scores.orderBy("signal", "episode_index").collect())
    elif a.command == "rank":
        keep = prints.join(curation.weighted_sum(result.scores), "episode_index")
        rows = curation.worst(keep, a.worst).collect()
        _print(rows)
        if none := [r.episode_index for r in curation.unscored(result.scores).orderBy("episode_index").toLocalIterator()]:
            print(f"unscored: {', '.join(map(str, none))}")
        if a.out_flags:
            Path(a.out_flags).write_text(json.dumps({"episode_indices": [r.episode_index for r in rows]}))
    elif a.command == "explain":
        _print(result.decisions.where(F.col("episode_index") == a.episode).collect())
        _print(curation.responsible(result.scores).where(F.col("episode_index") == a.episode).orderBy("place").collect())
    elif a.command == "inspect":
        _print(result.scores.where(F.col("episode_index") == a.episode).collect())
        _print(reports.worst_steps(S.jerk_steps(frames.where(F.col("episode_index") == a.episode))).collect())
    else:
        result.save(data, a.out, videos=not a.no_videos)
        card = scorecard.scorecard(result)
        if not a.no_card:
            Path(a.out, "README.md").write_text(scorecard.markdown(card))
        if a.report_html:
            Path(a.report_html).write_text(scorecard.html_page(card))
        if a.save_recipe:
            curator.save_recipe(result.spec, a.save_recipe)
        print(json.dumps(card if a.json else card["summary"], default=str))
    return 0


if __name__ == "__main__":
    sys.exit(main())
