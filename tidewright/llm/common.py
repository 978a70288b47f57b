"""What the corpus operators share: word rules, checkpoints, Arrow buffers, ranks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of characters other than these.
SPACE_CHARS = "\x20\x09\x0a\x0b\x0c\x0d"
WORD = r"[^\x20\x09-\x0D]+"
SPACES = r"[\x20\x09-\x0D]+"

#: Where checkpoints go if a local session names no folder, as in tests.
LOCAL_CHECKPOINTS = "/tmp/checkpoints/tidewright"

#: Rows in one Arrow batch: bounds a Python worker's memory however long texts are.
BATCH_ROWS = 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Keep Arrow batches small; a session setting, as Spark has no per-query one."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def checkpoint_dir(spark: SparkSession) -> str:
    """This session's folder in the shared checkpoint folder; on a cluster the session has to name one."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", LOCAL_CHECKPOINTS if context.master.startswith("local") else None)
        if not folder:
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        context.setCheckpointDir(folder)
    return context._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Compute once, in the shared checkpoint folder; later stages survive lost executors."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


class Staged:
    """A DataFrame computed once into Parquet in the shared checkpoint folder, smaller than a checkpoint's rows; ``drop`` deletes it."""

    def __init__(self, df: DataFrame):
        import uuid

        self.spark = df.sparkSession
        self.path = f"{checkpoint_dir(self.spark)}/staged-{uuid.uuid4()}"
        df.write.parquet(self.path)
        self.rows = self.spark.read.schema(df.schema).parquet(self.path)

    def drop(self) -> None:
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def sliced(batches: Iterator[pa.RecordBatch], rows: int = BATCH_ROWS) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of ``rows`` at most, whatever the session's setting was when the plan ran."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def chosen(column: str, share: float) -> Column:
    """Whether the hash of a value falls into this share of all hashes."""
    return F.pmod(F.xxhash64(column), F.lit(2**30)) < int(share * 2**30)


def words_of(text: Column) -> Column:
    """Array of words of a text; an empty array for null, empty and blank texts."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE_CHARS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACES))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; nulls are empty."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def longs(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(values, offsets) of an array column of whole numbers; nulls are empty."""
    offsets = np.asarray(column.offsets, np.int64) if len(column) else np.zeros(1, np.int64)
    values = np.asarray(column.values)
    if column.null_count:
        sizes = np.where(np.asarray(column.is_null()), 0, np.diff(offsets))
        kept = np.concatenate([values[o : o + n] for o, n in zip(offsets, sizes)]) if len(sizes) else values[:0]
        return kept, np.concatenate([[0], np.cumsum(sizes)])
    return values[offsets[0] : offsets[-1]], offsets - offsets[0]


_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_GOLD = 0x9E3779B97F4A7C15


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, on an array of unsigned 64-bit numbers."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= _M1
    x ^= x >> np.uint64(27)
    x *= _M2
    x ^= x >> np.uint64(31)
    return x


def _joined(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Hash of a pair of hashes; mixing after each pair leaves no sum that two orders of the same parts could share."""
    return mix(left * np.uint64(0xD1342543DE82EF95) + right)


def window_hashes(values: np.ndarray, width: int, seed: int = 1) -> np.ndarray:
    """Hash of each run of ``width`` consecutive values, for the whole array at once, from those of runs of powers of two."""
    n = len(values) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    power = mix(values.view(np.uint64) + np.uint64(seed * _GOLD % 2**64))
    out, done, size = None, 0, 1
    while size <= width:
        if width & size:
            part = power[done : done + n]
            out = part if out is None else _joined(out, part)
            done += size
        if 2 * size <= width:
            power = _joined(power[:-size], power[size:])
        size *= 2
    return mix(out ^ np.uint64(width * _GOLD % 2**64))


def grouped(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Tables of whole runs of equal keys from key-sorted batches; the last run waits for its end."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        k = np.asarray(batch.column(key))
        change = np.flatnonzero(k[1:] != k[:-1])
        first = held[0].column(key)[0].as_py()
        if len(change) or first != k[0]:
            last = int(change[-1]) + 1 if len(change) else 0
            done = held[:-1] + ([batch.slice(0, last)] if last else [])
            yield pa.Table.from_batches(done).combine_chunks()
            held = [batch.slice(last)]
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[ord(c) for c in SPACE_CHARS]] = True
_MASK = np.array([2 ** (8 * k) - 1 for k in range(9)], np.uint64)

#: Words of more bytes are hashed one at a time.
LONG_WORD = 256


class Bytes:
    """Bytes that can be read eight at a time from anywhere."""

    def __init__(self, raw: np.ndarray):
        self.raw = raw
        padded = np.zeros(len(raw) + 8, np.uint8)
        padded[: len(raw)] = raw
        self.eights = np.ndarray((len(raw) + 1,), "<u8", padded, strides=(1,))

    def read(self, at: np.ndarray, size: np.ndarray) -> np.ndarray:
        """``size`` bytes, at most eight, from each place."""
        return self.eights[at] & _MASK[np.minimum(size, 8)]


def hash_words(data: Bytes, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hash of each word: its bytes, eight at a time, are mixed in one after another, so no two patterns of bytes cancel out."""
    sizes = ends - starts
    salt = mix(np.uint64(seed) + sizes.astype(np.uint64) * np.uint64(_GOLD))
    h = mix(data.read(starts, sizes) ^ salt)
    more, done = np.flatnonzero((sizes > 8) & (sizes <= LONG_WORD)), 8
    while len(more):
        h[more] = _joined(h[more], mix(data.read(starts[more] + done, sizes[more] - done) + salt[more]))
        done += 8
        more = more[sizes[more] > done]
    for i in np.flatnonzero(sizes > LONG_WORD).tolist():
        h[i] = xxhash.xxh3_64_intdigest(data.raw[starts[i] : ends[i]].tobytes(), seed)
    return h


def equal_words(a: Bytes, at: np.ndarray, b: Bytes, bt: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Whether the ``sizes`` bytes at each place of one are those at the place of the other."""
    same = a.read(at, sizes) == b.read(bt, sizes)
    more, done = np.flatnonzero(same & (sizes > 8)), 8
    while len(more):
        ok = a.read(at[more] + done, sizes[more] - done) == b.read(bt[more] + done, sizes[more] - done)
        same[more[~ok]] = False
        done += 8
        more = more[ok]
        more = more[sizes[more] > done]
        if done > LONG_WORD:
            for i in more.tolist():
                same[i] = np.array_equal(a.raw[at[i] : at[i] + sizes[i]], b.raw[bt[i] : bt[i] + sizes[i]])
            break
    return same


def word_bounds(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first byte, end) of each word of UTF-8 texts that lie one after another."""
    n = len(raw)
    if not n:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    inside = ~_IS_SPACE[raw]
    first = np.zeros(n + 1, bool)
    first[offsets] = True
    start = inside & first[:n]
    start[1:] |= inside[1:] & ~inside[:-1]
    end = inside & first[1:]
    end[-1] = inside[-1]
    end[:-1] |= inside[:-1] & ~inside[1:]
    return np.flatnonzero(start), np.flatnonzero(end) + 1


def word_hashes(raw: np.ndarray, offsets: np.ndarray, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, first word of each text); equal words have equal hashes in every batch."""
    starts, ends = word_bounds(raw, offsets)
    return hash_words(Bytes(raw), starts, ends, seed), np.searchsorted(starts, offsets)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished jobs, which it does when their handles are collected."""
    import gc

    for _ in range(2):  # handles of Python's objects first, then what they held
        gc.collect()
        spark.sparkContext._jvm.System.gc()


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, label) of the connected components of (a, b) edges; the label is the least node.

    Labels spread along edges and jump to their label's label, a logarithmic number of rounds; each
    round is checkpointed.
    """
    both = cut(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct())
    labels = cut(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("least")).select("node", F.least("node", "least").alias("label")))
    for _ in range(most_rounds):
        near = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("label").alias("near"))
        spread = labels.join(near, labels.node == near.a, "left").select("node", F.col("label").alias("old"), F.least("label", F.coalesce("near", "label")).alias("label"))
        parent = labels.select(F.col("node").alias("up"), F.col("label").alias("higher"))
        new = cut(spread.join(parent, F.col("label") == F.col("up"), "left").select("node", "old", F.least("label", F.coalesce("higher", "label")).alias("label")))
        changed = new.where("old <> label").limit(1).count()
        labels = new.select("node", "label")
        if not changed:
            break
    else:
        raise RuntimeError("components did not settle")
    return labels
