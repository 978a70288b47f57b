"""Episode datasets on disk: the v2.1 layout (a file per episode) and the v3.0 layout (shared shards).

Readers return a ``Dataset``: lazy ``episodes`` and ``frames`` DataFrames and the feature table. The
files are read in one scan; a single episode is a pushed-down filter. Writers never touch the source,
validate what they wrote by reading it again, and set a failed output aside as ``<dest>.invalid``.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import shutil
from collections.abc import Callable, Iterable
from contextlib import AbstractContextManager, contextmanager
from dataclasses import dataclass, replace
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewright.functions import kernels as K

#: Columns that say where a row stands, not what it holds; layout templates.
POSITIONS = ("episode_index", "frame_index", "index", "task_index")
V21_DATA = "data/chunk-{chunk:03d}/episode_{episode:06d}.parquet"
V3_DATA = "data/chunk-000/file-000.parquet"
IMAGE_TYPES = ("image", "video")


@dataclass
class Dataset:
    root: str | None
    version: str
    info: dict
    episodes: DataFrame
    frames: DataFrame

    @property
    def features(self) -> list[str]:
        return [k for k, f in self.info["features"].items() if f.get("dtype") not in IMAGE_TYPES]

    def episode(self, index: int) -> DataFrame:
        return self.frames.where(F.col("episode_index") == index).orderBy("step")

    def has(self, key: str) -> bool:
        return key in self.frames.columns

    def feature(self, key: str) -> DataFrame:
        """(episode_index, step, t, the feature under its own name)."""
        if not self.has(key):
            raise KeyError(f"there is no feature {key!r}; there are {', '.join(sorted(self.features))}")
        return self.frames.select("episode_index", "step", "t", F.col(f"`{key}`"))

    def select_roles(self, *roles: str) -> DataFrame:
        """Features of the roles in the order in which they are declared; roles without a feature add none."""
        keys = [k for k in self.features if role_of(k) in roles and self.has(k)]
        return self.frames.select("episode_index", "step", "t", *(F.col(f"`{k}`") for k in keys))

    def view(self, role: str) -> DataFrame | None:
        """The first feature of a role (ACTION, TIME, REWARD, SUCCESS, ...), None if there is none."""
        key = next((k for k in self.features if role_of(k) == role and self.has(k)), None)
        return None if key is None else self.feature(key)

    def subset(self, indices: DataFrame) -> "Dataset":
        """Episodes of (episode_index, ord) rows under their own numbers; they are written in the order of ``ord``."""
        order = [c for c in ("ord",) if c in indices.columns]
        episodes = self.episodes.drop("ord").join(indices.select("episode_index", *order), "episode_index")
        return Dataset(None, self.version, self.info, episodes, self.frames.join(indices.select("episode_index"), "episode_index", "left_semi"))


def subset_hash(source: str, indices: DataFrame) -> str:
    """sha256 of the source's hash and the episode numbers of a subset, in the order of ``ord``."""
    h = hashlib.sha256(source.encode())
    for r in indices.orderBy("ord").toLocalIterator():
        h.update(str(r.episode_index).encode())
    return h.hexdigest()


def role_of(key: str) -> str:
    """What a feature is for, by its name."""
    if key.startswith("observation.image"):
        return "IMAGE"
    if key in ("action", "timestamp"):
        return {"action": "ACTION", "timestamp": "TIME"}[key]
    if key == "observation.state":
        return "PROPRIO"
    if key in ("reward", "next.reward"):
        return "REWARD"
    if key in ("success", "next.success", "next.done"):
        return "SUCCESS"
    return "STATE" if key.startswith("observation.") else "EXTRA"


def detect_version(root: str) -> str:
    info = json.loads((Path(root) / "meta/info.json").read_text())
    return "v3.0" if str(info.get("codebase_version", "")).startswith("v3") else "v2.1"


def read(spark: SparkSession, root: str) -> Dataset:
    return read_v3(spark, root) if detect_version(root) == "v3.0" else read_v21(spark, root)


def _frames(spark: SparkSession, path: str | list[str], features: dict) -> DataFrame:
    raw = spark.read.parquet(*([path] if isinstance(path, str) else path))
    t = F.col("timestamp").cast("double") if "timestamp" in raw.columns else F.lit(None).cast("double")
    step = F.col("frame_index").cast("int") if "frame_index" in raw.columns else (F.row_number().over(Window.partitionBy("episode_index").orderBy("index")) - 1)
    return raw.withColumns({"step": step, "t": t})


def read_v21(spark: SparkSession, root: str, files: list[str] | None = None) -> Dataset:
    """``files`` are the episode files to read, if not all."""
    info = json.loads((Path(root) / "meta/info.json").read_text())
    for key, f in info["features"].items():
        if f.get("dtype") == "image":
            raise NotImplementedError(f"images in tables are not read: {key}")
    frames = _frames(spark, files or f"{root}/data/*/episode_*.parquet", info["features"])
    raw = spark.read.json(f"{root}/meta/episodes.jsonl")
    labelled = next((k for k in info["features"] if role_of(k) == "SUCCESS" and k in frames.columns), None)
    given = F.col("success") if "success" in raw.columns else F.lit(None).cast("boolean")
    episodes = raw.select(F.col("episode_index").cast("long"), F.col("length").cast("int").alias("n_steps"), F.col("tasks") if "tasks" in raw.columns else F.array().cast("array<string>").alias("tasks"), given.alias("given"))
    if labelled:
        kind = dict(frames.dtypes)[labelled]
        last = F.array_max(labelled).cast("double") if kind.startswith("array") else F.col(labelled).cast("double")
        ends = frames.groupBy("episode_index").agg((F.max_by(last, "step") > 0.5).alias("ended"))
        episodes = episodes.join(ends, "episode_index", "left").withColumn("success", F.coalesce("given", "ended")).drop("ended")
    else:
        episodes = episodes.withColumn("success", F.col("given"))
    return Dataset(root, "v2.1", info, episodes.drop("given"), frames)


def read_v3(spark: SparkSession, root: str, files: list[str] | None = None) -> Dataset:
    """``files`` are the data files to read, if not all."""
    info = json.loads((Path(root) / "meta/info.json").read_text())
    raw = spark.read.parquet(f"{root}/meta/episodes/*/*.parquet")
    cameras = [k for k, f in info["features"].items() if f.get("dtype") == "video" and f"videos/{k}/chunk_index" in raw.columns]
    refs = [F.struct(F.lit(k).alias("video_key"), F.format_string(f"videos/{k}/chunk-%03d/file-%03d.mp4", F.col(f"`videos/{k}/chunk_index`"), F.col(f"`videos/{k}/file_index`")).alias("shard_path"), F.col(f"`videos/{k}/from_timestamp`").cast("double").alias("from_ts"), F.col(f"`videos/{k}/to_timestamp`").cast("double").alias("to_ts")) for k in cameras]
    success = F.col("success") if "success" in raw.columns else F.lit(None).cast("boolean")
    video = F.array(*refs) if refs else F.array().cast("array<struct<video_key:string,shard_path:string,from_ts:double,to_ts:double>>")
    episodes = raw.select(F.col("episode_index").cast("long"), F.col("length").cast("int").alias("n_steps"), "tasks" if "tasks" in raw.columns else F.array().cast("array<string>").alias("tasks"), success.alias("success"), video.alias("video_refs"))
    return Dataset(root, "v3.0", info, episodes, _frames(spark, files or f"{root}/data/*/*.parquet", info["features"]))


def read_nested(episodes: DataFrame, fps: float = 10.0) -> DataFrame:
    """Frames of rows (episode_index, steps ARRAY<STRUCT<observation STRUCT, action, reward, ...>>); observations become ``observation.<k>``."""
    flat = episodes.select("episode_index", F.posexplode("steps").alias("step", "s"))
    fields = flat.schema["s"].dataType.fields
    columns = []
    for f in fields:
        if f.name == "observation":
            columns += [F.col(f"s.observation.{g.name}").alias(f"observation.{g.name}") for g in f.dataType.fields]
        else:
            columns.append(F.col(f"s.{f.name}").alias(f.name))
    return flat.select("episode_index", F.col("step").cast("int").alias("step"), (F.col("step") / fps).cast("float").alias("timestamp"), (F.col("step") / fps).alias("t"), *columns)


def natural_key(name: str) -> tuple:
    """Sorts names by the number at their end, those without one last."""
    m = re.search(r"(\d+)$", name)
    return (0, int(m[1]), name) if m else (1, 0, name)


#: Parts of names that tell images from numbers.
IMAGE_HINTS = ("image", "rgb", "depth")


@dataclass(frozen=True)
class GroupLayout:
    """How a file of groups holds episodes: where they are, what they are called, and what tells success.

    ``keys`` are the observations that make up the state, in order; all of them by name if none are given.
    ``expose`` are observations that get a column ``observation.<key>`` of their own beside it.
    """

    top: str = ""
    pattern: str = r".*"
    observations: tuple[str, ...] = ("obs", "observations")
    success: str = "none"  # last_reward: the last reward is positive; last_flag: the last success flag is set
    keys: tuple[str, ...] | None = None
    expose: tuple[str, ...] = ()
    hz: float = 1.0


def _group_frames(number: int, name: str, group: dict, layout: GroupLayout) -> pd.DataFrame:
    """Rows of one group; observations are clipped to the actions, as some files hold one more than actions."""
    actions = np.asarray(group["actions"], float)
    n = len(actions)
    flat = lambda x: np.asarray(x, float)[:n].reshape(n, -1)
    seen = next((group[k] for k in layout.observations if k in group), None)
    named = seen if isinstance(seen, dict) else {}
    if named:
        keys = sorted(named) if layout.keys is None else layout.keys
        if pictures := [k for k in keys if any(hint in k.lower() for hint in IMAGE_HINTS)]:
            raise NotImplementedError(f"observations that hold images are not read: {', '.join(pictures)}; name others in the layout")
        if missing := [k for k in keys if k not in named]:
            raise KeyError(f"group {name} has no observation {', '.join(missing)}")
        state = np.concatenate([flat(named[k]) for k in keys], axis=1) if keys else np.empty((n, 0))
    else:
        state = flat(seen) if seen is not None else np.empty((n, 0))
    rewards = np.asarray(group.get("rewards", np.zeros(n)), float).ravel()[:n]
    columns = {"episode_index": number, "group": name, "step": np.arange(n, dtype=np.int32), "t": np.arange(n) / layout.hz, "action": list(actions.reshape(n, -1)), "state": list(state), "reward": rewards}
    columns |= {f"observation.{k}": list(flat(named[k])) if k in named else [None] * n for k in layout.expose}
    return pd.DataFrame(columns)


def _group_schema(layout: GroupLayout) -> str:
    return ", ".join(["episode_index long, group string, step int, t double, action array<double>, state array<double>, reward double", *(f"`observation.{k}` array<double>" for k in layout.expose)])


def _named(names: Iterable[str], pattern: str) -> list[tuple[int, str]]:
    return list(enumerate(sorted((n for n in names if re.fullmatch(pattern, n)), key=natural_key)))


def read_groups(spark: SparkSession, groups: dict[str, dict], pattern: str = r".*", layout: GroupLayout = GroupLayout()) -> DataFrame:
    """Frames of in-memory groups {name: {"actions": (T, D), "obs": array or {key: array}, "rewards", ...}} as HDF5 and Zarr files hold them.

    Groups that match the pattern are taken in natural order; observations are concatenated by key
    and clipped to the actions.
    """
    parts = [_group_frames(i, name, groups[name], layout) for i, name in _named(groups, pattern)]
    rows = [tuple(x.tolist() if isinstance(x, np.ndarray) else x for x in row) for part in parts for row in part.itertuples(index=False, name=None)]
    return spark.createDataFrame(rows, _group_schema(layout))


def read_opened(spark: SparkSession, names: Iterable[str], opened: Callable[[], AbstractContextManager], layout: GroupLayout = GroupLayout()) -> DataFrame:
    """Frames of the named groups of a file that executors open for themselves; a worker holds one group at a time.

    ``opened`` gives a context with a mapping of names to groups, whose parts are arrays or mappings of arrays.
    """
    named = _named(names, layout.pattern)

    def plain(x):
        return {k: plain(x[k]) for k in x.keys()} if hasattr(x, "keys") else np.asarray(x[()] if hasattr(x, "shape") else x)

    def rows(batches):
        with opened() as top:
            for pdf in batches:
                for number, name in zip(pdf["episode_index"], pdf["group"]):
                    yield _group_frames(int(number), name, plain(top[name]), layout)

    index = spark.createDataFrame(named, "episode_index long, group string").repartition(max(1, min(len(named), 4 * spark.sparkContext.defaultParallelism)))
    return index.mapInPandas(rows, _group_schema(layout))


#: Layouts of known collections.
ROBOMIMIC = GroupLayout("data", r"demo_\d+", ("obs",), "last_reward")
MANISKILL = GroupLayout("", r"traj_\d+", ("obs",), "last_flag")
OPERATOR_TIERS = ("better", "okay", "worse")


def group_labels(spark: SparkSession, groups: dict[str, dict], layout: GroupLayout, masks: dict[str, list[str]] | None = None) -> DataFrame:
    """(episode_index, group, success, operator_tier) of groups, in natural order; masks name the groups of each tier."""
    tiers = {name: tier for tier in OPERATOR_TIERS for name in (masks or {}).get(tier, [])}
    rows = []
    for i, name in enumerate(sorted((n for n in groups if re.fullmatch(layout.pattern, n)), key=natural_key)):
        g, success = groups[name], None
        if layout.success == "last_reward" and len(g.get("rewards", ())):
            success = bool(np.asarray(g["rewards"])[-1] > 0)
        elif layout.success == "last_flag" and len(g.get("success", ())):
            success = bool(np.asarray(g["success"])[-1])
        rows.append((i, name, success, tiers.get(name)))
    return spark.createDataFrame(rows, "episode_index long, group string, success boolean, operator_tier string")


def resolve(name: str) -> str:
    """A local directory as it is; a hub id (namespace/name) by the optional hub client, without videos."""
    if Path(name).is_dir():
        return name
    if not re.fullmatch(r"[\w.-]+/[\w.-]+", name):
        raise FileNotFoundError(name)
    try:
        from huggingface_hub import snapshot_download
    except ImportError as missing:
        raise ImportError(f"{name} is no directory; fetching it from a hub needs the package huggingface_hub") from missing
    return snapshot_download(name, repo_type="dataset", allow_patterns=["meta/*", "meta/**", "data/**"])


def decode_video(path: str, begin: float, end: float, most: int | None = None) -> list[np.ndarray] | None:
    """RGB frames of a shard between two times, evenly chosen; None if the shard is missing."""
    if not Path(path).exists():
        return None
    try:
        import av
    except ImportError as missing:
        raise ImportError("decoding video needs the package av") from missing
    with av.open(path) as box:
        frames = [f.to_ndarray(format="rgb24") for f in box.decode(video=0) if f.time is not None and begin <= f.time <= end]
    if most is None or len(frames) <= most:
        return frames
    return [frames[i] for i in np.round(np.linspace(0, len(frames) - 1, most)).astype(int)]


def _top(file, layout: GroupLayout):
    return file[layout.top] if layout.top else file["data"] if "data" in file else file


def read_zarr(spark: SparkSession, path: str, pattern: str = r".*", layout: GroupLayout = GroupLayout()) -> DataFrame:
    """The driver reads the names of the groups, executors their arrays; ``path`` is one that all of them can open."""
    try:
        import zarr
    except ImportError as missing:
        raise ImportError("reading Zarr needs the package zarr") from missing
    layout = replace(layout, pattern=pattern) if pattern != r".*" else layout

    @contextmanager
    def opened():
        import zarr

        yield _top(zarr.open(path, mode="r"), layout)

    return read_opened(spark, list(_top(zarr.open(path, mode="r"), layout).keys()), opened, layout)


def read_hdf5(spark: SparkSession, path: str, pattern: str = r".*", layout: GroupLayout = GroupLayout()) -> DataFrame:
    """The driver reads the names of the groups, executors their arrays; ``path`` is one that all of them can open."""
    try:
        import h5py
    except ImportError as missing:
        raise ImportError("reading HDF5 needs the package h5py") from missing
    layout = replace(layout, pattern=pattern) if pattern != r".*" else layout

    @contextmanager
    def opened():
        import h5py

        with h5py.File(path) as f:
            yield _top(f, layout)

    with h5py.File(path) as f:
        names = list(_top(f, layout).keys())
    return read_opened(spark, names, opened, layout)


def fingerprints(frames: DataFrame, features: list[str]) -> DataFrame:
    """(episode_index, fingerprint): sha256 over, by sorted key, the key and the bytes of its values in step order. Positions do not count."""
    keys = sorted(k for k in features if k not in POSITIONS)
    kinds = {k: ("float32" if "float" in t else "float64" if "double" in t else "int64" if "bigint" in t else "int32" if "int" in t else "bool") for k, t in frames.dtypes}

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("step")
        h = hashlib.sha256()
        for i, k in enumerate(keys):
            h.update(k.encode())
            h.update(np.ascontiguousarray(np.array(pdf[f"k{i}"].tolist(), dtype=kinds[k])).tobytes())
        return pd.DataFrame({"episode_index": [pdf["episode_index"].iloc[0]], "fingerprint": [h.hexdigest()]})

    return frames.select("episode_index", "step", *(F.col(f"`{k}`").alias(f"k{i}") for i, k in enumerate(keys))).groupBy("episode_index").applyInPandas(one, "episode_index long, fingerprint string")


def dataset_hash(prints: DataFrame) -> str:
    """sha256 of the episodes' sorted fingerprints."""
    h = hashlib.sha256()
    for r in prints.select("fingerprint").orderBy("fingerprint").toLocalIterator():
        h.update(r.fingerprint.encode())
    return h.hexdigest()


def guard(dest: str, source: str | None) -> None:
    d = Path(dest).resolve()
    if d.exists():
        raise FileExistsError(f"the destination exists: {dest}")
    if source:
        s = Path(source).resolve()
        if d == s or s in d.parents or d in s.parents:
            raise ValueError("destination and source overlap")


def _reindexed(data: Dataset, kept: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Kept episodes renumbered from 0 in their order (``ord`` first if they have one), with the offset of their first frame; and their frames."""
    chosen = data.episodes.join(kept.select("episode_index"), "episode_index", "left_semi")
    order = [F.col(c).asc() for c in ("ord", "episode_index") if c in chosen.columns]
    episodes = K.in_order(chosen, *order, total="n_steps").withColumn("out", F.col("rank") - 1).withColumnRenamed("before", "begin").drop("rank")
    numbers = [(i, task) for i, task in enumerate(_tasks(episodes))]
    named = episodes.sparkSession.createDataFrame(numbers, "task_number long, task string")
    episodes = K.cut(episodes.withColumn("task", F.coalesce(F.get("tasks", 0), F.lit(""))).join(named, "task", "left").drop("task"))
    frames = data.frames.join(episodes.select("episode_index", "out", "begin", "task_number"), "episode_index")
    frames = frames.withColumns({"episode_index": F.col("out").cast("long"), "frame_index": F.col("step").cast("long"), "index": (F.col("begin") + F.col("step")).cast("long"), "task_index": F.coalesce("task_number", F.lit(0)).cast("long")})
    return episodes, frames.select(*(F.col(f"`{k}`") for k in dict.fromkeys([*data.features, *POSITIONS]) if k in frames.columns), "step")


def _tasks(episodes: DataFrame) -> list[str]:
    """The tasks of episodes in the order in which they first come; an episode without one has the empty task."""
    each = episodes.select("out", F.posexplode(F.when(F.size("tasks") > 0, F.col("tasks")).otherwise(F.array(F.lit("")))).alias("place", "task"))
    first = each.groupBy("task").agg(F.min(F.struct("out", "place")).alias("first"))
    return [r.task or "" for r in first.orderBy("first").collect()]


def write_v21(data: Dataset, kept: DataFrame, dest: str, manifest: dict | None = None) -> dict:
    """Write kept episodes in the v2.1 layout; returns the checksums. One file per episode, each from one task."""
    guard(dest, data.root)
    try:
        episodes, frames = _reindexed(data, kept)
        staged = f"{dest}/data/.staged"
        frames.repartition("episode_index").sortWithinPartitions("episode_index", "step").drop("step").withColumn("e", F.col("episode_index")).write.partitionBy("e").parquet(staged)
        rows = episodes.orderBy("out").select("out", "n_steps", "tasks", "success").collect()
        for r in rows:
            files = list(Path(staged, f"e={r.out}").glob("*.parquet"))
            target = Path(dest, V21_DATA.format(chunk=r.out // 1000, episode=r.out))
            target.parent.mkdir(parents=True, exist_ok=True)
            if len(files) != 1:
                raise ValueError(f"episode {r.out} has {len(files)} files")
            os.rename(files[0], target)
        shutil.rmtree(staged)
        _meta(dest, data, rows, "v2.1")
        lines = [json.dumps({"episode_index": r.out, "length": r.n_steps, "tasks": list(r.tasks or [])} | ({"success": r.success} if r.success is not None else {})) for r in rows]
        Path(dest, "meta/episodes.jsonl").write_text("".join(x + "\n" for x in lines))
        Path(dest, "meta/tasks.jsonl").write_text("".join(json.dumps({"task_index": i, "task": t}) + "\n" for i, t in enumerate(_tasks(episodes))))
        return _finish(data, frames, dest, manifest)
    except Exception:
        _set_aside(dest)
        raise


def write_v3(data: Dataset, kept: DataFrame, dest: str, manifest: dict | None = None, videos: bool = True) -> dict:
    """Write kept episodes in the v3.0 layout: one data shard, one episode table, each referenced video shard copied once."""
    guard(dest, data.root)
    try:
        episodes, frames = _reindexed(data, kept)
        _single(frames.orderBy("episode_index", "step").drop("step"), f"{dest}/{V3_DATA}")
        rows = episodes.orderBy("out").select("out", "n_steps", "tasks", "success", "begin").collect()
        _meta(dest, data, rows, "v3.0", videos)
        tasks = _tasks(episodes)
        _single(data.frames.sparkSession.createDataFrame(list(enumerate(tasks)), "task_index long, task string"), f"{dest}/meta/tasks.parquet")
        out = episodes.select(F.col("out").cast("long").alias("episode_index"), F.lit(0).cast("long").alias("data/chunk_index"), F.lit(0).cast("long").alias("data/file_index"), F.col("begin").cast("long").alias("dataset_from_index"), (F.col("begin") + F.col("n_steps")).cast("long").alias("dataset_to_index"), F.col("n_steps").cast("long").alias("length"), "tasks", "success")
        _single(out.orderBy("episode_index"), f"{dest}/meta/episodes/chunk-000/file-000.parquet")
        if videos and "video_refs" in data.episodes.columns:
            shards = episodes.select(F.explode("video_refs.shard_path").alias("p")).distinct().collect()
            for r in shards:
                a, b = Path(data.root, r.p), Path(dest, r.p)
                b.parent.mkdir(parents=True, exist_ok=True)
                shutil.copyfile(a, b)
                if _sha(a) != _sha(b):
                    raise OSError(f"a copied shard differs: {r.p}")
        return _finish(data, frames, dest, manifest)
    except Exception:
        _set_aside(dest)
        raise


def write(data: Dataset, kept: DataFrame, dest: str, manifest: dict | None = None, videos: bool = True) -> dict:
    return write_v3(data, kept, dest, manifest, videos) if data.version == "v3.0" else write_v21(data, kept, dest, manifest)


def _single(df: DataFrame, path: str) -> None:
    staged = Path(path).parent / ".staged"
    df.coalesce(1).write.parquet(str(staged))
    os.rename(next(staged.glob("*.parquet")), path)
    shutil.rmtree(staged)


def _meta(dest: str, data: Dataset, rows: list, version: str, videos: bool = True) -> None:
    Path(dest, "meta").mkdir(parents=True, exist_ok=True)
    info = data.info | {"codebase_version": version, "total_episodes": len(rows), "total_frames": sum(r.n_steps for r in rows)}
    if not videos:  # what is not there is not declared
        info |= {"features": {k: f for k, f in info["features"].items() if f.get("dtype") != "video"}}
        info.pop("video_path", None)
    if version == "v3.0":
        info |= {"data_path": "data/chunk-{chunk_index:03d}/file-{file_index:03d}.parquet"}
    Path(dest, "meta/info.json").write_text(json.dumps(info, indent=2, sort_keys=True))


def _sha(path: Path) -> str:
    h = hashlib.sha256()
    with open(path, "rb") as f:
        while block := f.read(1 << 20):
            h.update(block)
    return h.hexdigest()


def checksums(root: str) -> dict[str, str]:
    """Relative path to sha256 of every file."""
    files = sorted(p for p in Path(root).rglob("*") if p.is_file() and not p.name.endswith(".crc"))
    return {str(p.relative_to(root)): _sha(p) for p in files}


def validate(spark: SparkSession, root: str) -> list[str]:
    """What is wrong with a dataset on disk: keys, episode count, feature columns, row counts."""
    path = Path(root, "meta/info.json")
    if not path.exists():
        return ["meta/info.json is missing"]
    info = json.loads(path.read_text())
    problems = [f"info has no {k}" for k in ("codebase_version", "fps", "features") if k not in info]
    if problems:
        return problems
    data = read(spark, root)
    problems += [f"column {k} is missing" for k in [*data.features, *POSITIONS] if k not in data.frames.columns]
    if problems:
        return problems
    found = data.frames.groupBy("episode_index").agg(F.count("*").alias("rows"))
    both = data.episodes.join(found, "episode_index", "full").where(~F.col("n_steps").eqNullSafe(F.col("rows")))
    problems += [f"episode {r.episode_index} declares {r.n_steps} steps and has {r.rows}" for r in both.orderBy("episode_index").toLocalIterator()]
    n = data.episodes.count()
    if info.get("total_episodes", n) != n:
        problems.append(f"info declares {info['total_episodes']} episodes and there are {n}")
    return problems


def _finish(data: Dataset, frames: DataFrame, dest: str, manifest: dict | None) -> dict:
    spark = frames.sparkSession
    if problems := validate(spark, dest):
        raise ValueError("; ".join(problems))
    again = read(spark, dest)
    a, b = fingerprints(frames, data.features), fingerprints(again.frames, data.features)
    if a.exceptAll(b).limit(1).count() or b.exceptAll(a).limit(1).count():
        raise ValueError("what was written reads back differently")
    sums = checksums(dest)
    if manifest is not None:
        Path(dest, "manifest.json").write_text(json.dumps(manifest | {"file_checksums": sums}, indent=2, sort_keys=True))
    return sums


def _set_aside(dest: str) -> None:
    if Path(dest).exists():
        aside = Path(f"{dest}.invalid")
        if aside.exists():
            shutil.rmtree(aside)
        os.rename(dest, aside)


def unreadable(spark: SparkSession, root: str, problems: dict[str, str]) -> DataFrame:
    """(episode_index, problem) of the episodes whose data file does not read."""
    if detect_version(root) == "v2.1":
        found = [(int(re.search(r"episode_(\d+)", Path(f).name)[1]), why) for f, why in problems.items()]
        return spark.createDataFrame(found, "episode_index long, problem string")
    places = [(*(int(x) for x in re.search(r"chunk-(\d+)/file-(\d+)\.parquet$", f).groups()), why) for f, why in problems.items()]
    files = spark.createDataFrame(places, "chunk long, file long, problem string")
    episodes = spark.read.parquet(f"{root}/meta/episodes/*/*.parquet").select(F.col("episode_index").cast("long"), F.col("`data/chunk_index`").cast("long").alias("chunk"), F.col("`data/file_index`").cast("long").alias("file"))
    return episodes.join(files, ["chunk", "file"]).select("episode_index", "problem")


def readable(spark: SparkSession, root: str) -> tuple[list[str], dict[str, str]]:
    """(data files that read, why others do not) of a dataset; executors open each file's footer and rows."""
    files = sorted(str(p) for p in Path(root).glob("data/*/*.parquet"))

    def probe(batches):
        import pyarrow.parquet as pq

        for pdf in batches:
            out = []
            for f in pdf["file"]:
                try:
                    pq.read_table(f)
                    out.append(None)
                except Exception as problem:  # noqa: BLE001
                    out.append(f"{type(problem).__name__}: {problem}"[:300])
            yield pd.DataFrame({"file": pdf["file"], "problem": pd.Series(out, dtype="object")})

    if not files:
        return [], {}
    found = spark.createDataFrame([(f,) for f in files], "file string").mapInPandas(probe, "file string, problem string").collect()
    return sorted(r.file for r in found if r.problem is None), {r.file: r.problem for r in found if r.problem}
