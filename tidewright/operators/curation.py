"""Normalise, combine, gate and select: from score rows to decisions.

scores: (episode_index, signal, value, higher_is_better). keep scores: (episode_index, fingerprint,
keep_score). Order among equal keep scores is by fingerprint, so every selection is total.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from heapq import heapify, heappop, heapreplace
from itertools import count

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewright.functions import kernels as K

#: Names of random streams. Equal seeds give equal draws in each.
BASELINE_STREAM, RANDOM_FILTER_STREAM, BENCHMARK_STREAM = 0xBA5E, 0xF117E2, 0xBE5E


@dataclass(frozen=True)
class Budget:
    """A share of the valid episodes, or a count of them, or all."""

    kind: str | None = None
    value: float = 1.0

    def resolve(self, n: int) -> int:
        if self.kind is None:
            return n
        k = round(self.value * n) if self.kind == "fraction" else int(self.value)  # half to even
        return max(0, min(n, k))


@dataclass(frozen=True)
class Gate:
    """Rejects episodes whose signal is strictly outside of bounds; a skipped signal rejects nothing."""

    signal: str
    reject_above: float | None = None
    reject_below: float | None = None

    def rejects(self, value: Column) -> Column:
        out = F.lit(False)
        if self.reject_above is not None:
            out = out | (value > self.reject_above)
        if self.reject_below is not None:
            out = out | (value < self.reject_below)
        return F.coalesce(K.finite(value) & out, F.lit(False))


def normalised(scores: DataFrame) -> DataFrame:
    """Scores with ``norm``; they are read twice, so hand in computed ones."""
    return K.minmax_keep(scores)


def weighted_sum(scores: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """(episode_index, keep_score): weighted mean of normalised signals; an unnamed signal weighs 1, one of weight 0 is left out."""
    weight = F.lit(1.0)
    for name, w in (weights or {}).items():
        weight = F.when(F.col("signal") == name, float(w)).otherwise(weight)
    used = normalised(scores).withColumn("w", weight)
    total = F.sum("w")
    return used.groupBy("episode_index").agg(F.when(F.count(F.when(F.col("w") != 0, 1)) == 0, 0.0).when(total <= 0, 0.5).otherwise(F.try_divide(F.sum(F.col("w") * F.col("norm")), total)).alias("keep_score"))


def _ranked(keep: DataFrame) -> DataFrame:
    """Adds the rank in keep order, from 1."""
    return K.in_order(keep, F.col("keep_score").desc(), F.col("fingerprint").asc())


def top_k(keep: DataFrame, k: int) -> DataFrame:
    """The k best: TakeOrdered keeps k rows of each partition, so nothing is sorted as a whole."""
    return keep.orderBy(F.col("keep_score").desc(), F.col("fingerprint").asc()).limit(k)


def unscored(scores: DataFrame) -> DataFrame:
    """(episode_index) of the episodes that every signal skipped."""
    return scores.groupBy("episode_index").agg(F.count(F.when(K.finite(F.col("value")), 1)).alias("n")).where("n = 0").select("episode_index")


def worst(keep: DataFrame, n: int) -> DataFrame:
    return keep.orderBy(F.col("keep_score").asc(), F.col("fingerprint").asc()).limit(n)


def responsible(scores: DataFrame) -> DataFrame:
    """(episode_index, place, signal, norm, value): the worst normalised signal, and a second one below one half."""
    place = F.row_number().over(Window.partitionBy("episode_index").orderBy("norm", "signal"))
    return normalised(scores).withColumn("place", place).where("place = 1 or (place = 2 and norm < 0.5)").select("episode_index", "place", "signal", "norm", "value")


#: Vectors in a block of the search for close pairs.
PAIR_BLOCK = 1024


def _meeting(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Distances of the rows of x to those of y, to the last bit alike whichever way round."""
    return np.sqrt(((x[:, None, :] - y[None, :, :]) ** 2).sum(2))


def close_pairs(vectors: DataFrame, epsilon: float, block: int = PAIR_BLOCK) -> DataFrame:
    """(a, b, distance), a < b: vectors (episode_index, v) within ``epsilon``.

    Vectors are put in order along the dimension in which they spread most and cut into blocks; two blocks
    meet only if their ranges come within ``epsilon``. A row goes out for a close pair and for no other.
    """
    spread = vectors.select(F.posexplode("v").alias("i", "x")).groupBy("i").agg(F.stddev_pop("x").alias("s")).where(K.finite(F.col("s")))
    widest = spread.orderBy(F.col("s").desc(), "i").first()
    along = widest.i if widest else 0
    placed = K.in_order(vectors.select("episode_index", "v", F.coalesce(F.get("v", along), F.lit(0.0)).alias("p")), F.col("p"), F.col("episode_index"))
    placed = K.cut(placed.select("episode_index", "v", "p", F.floor((F.col("rank") - 1) / block).alias("block")))
    # one row for a block
    ends = sorted((r.block, r.lo, r.hi) for r in placed.groupBy("block").agg(F.min("p").alias("lo"), F.max("p").alias("hi")).collect())
    last = np.searchsorted([lo for _, lo, _ in ends], [hi + epsilon for _, _, hi in ends], "right") - 1
    reach = vectors.sparkSession.createDataFrame([(int(e[0]), int(k)) for e, k in zip(ends, last)], "x long, last long")
    pairs = reach.select("x", F.explode(F.sequence("x", "last")).alias("y"))
    row = lambda side: placed.select(F.col("block").alias("x" if side == 1 else "y"), "episode_index", "v", F.lit(side).alias("side"))
    dealt = row(1).join(pairs, "x").select("x", "y", "side", "episode_index", "v").union(row(2).join(pairs.where("x < y"), "y").select("x", "y", "side", "episode_index", "v"))

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        ids, side, x = pdf["episode_index"].to_numpy(), pdf["side"].to_numpy(), np.array(pdf["v"].tolist(), float)
        one = side == 1
        other = ~one if (~one).any() else one
        a, b, d = [], [], []
        step = max(1, 4_000_000 // max(1, other.sum() * x.shape[1]))
        left = np.flatnonzero(one)
        for at in range(0, len(left), step):
            part = left[at : at + step]
            far = _meeting(x[part], x[other])
            i, j = np.nonzero(far <= epsilon)
            a.append(ids[part][i]), b.append(ids[other][j]), d.append(far[i, j])
        a, b, d = np.concatenate(a), np.concatenate(b), np.concatenate(d)
        keep = a < b if other is one else a != b
        return pd.DataFrame({"a": np.minimum(a, b)[keep], "b": np.maximum(a, b)[keep], "distance": d[keep]})

    return dealt.groupBy("x", "y").applyInPandas(meet, "a long, b long, distance double")


def representatives(removed: DataFrame, kept: DataFrame, vectors: DataFrame, block: int = PAIR_BLOCK) -> DataFrame:
    """(episode_index, representative, distance): the nearest kept episode of each removed one, the better ranked of equally near ones.

    removed (episode_index); kept (episode_index, rank). Episodes without a vector are left out. Blocks of removed
    and of kept ones meet; a row goes out for a removed episode and a block of kept ones.
    """
    theirs = vectors.join(kept.select("episode_index", "rank"), "episode_index")
    ours = vectors.join(removed.select("episode_index"), "episode_index")
    counts = [max(1, -(-n // block)) for n in (ours.count(), theirs.count())]
    own = lambda n: F.pmod(F.xxhash64("episode_index"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    dealt = ours.select(own(counts[0]).alias("x"), every(counts[1]).alias("y"), "episode_index", "v", F.lit(None).cast("long").alias("rank"))
    dealt = dealt.union(theirs.select(every(counts[0]).alias("x"), own(counts[1]).alias("y"), "episode_index", "v", F.col("rank").cast("long")))

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        known = pdf["rank"].notna().to_numpy()
        best = pdf[known].sort_values("rank")
        rows = pdf[~known]
        if best.empty or rows.empty:
            return pd.DataFrame({"episode_index": [], "representative": [], "distance": [], "rank": []}).astype({"episode_index": "int64", "representative": "int64", "rank": "int64"})
        x, y = np.array(rows["v"].tolist(), float), np.array(best["v"].tolist(), float)
        step = max(1, 4_000_000 // (len(y) * y.shape[1]))
        far = [(_meeting(x[at : at + step], y)) for at in range(0, len(x), step)]
        at = np.concatenate([f.argmin(1) for f in far])
        return pd.DataFrame({"episode_index": rows["episode_index"].to_numpy(), "representative": best["episode_index"].to_numpy()[at], "distance": np.concatenate([f.min(1) for f in far]), "rank": best["rank"].to_numpy()[at].astype("int64")})

    met = dealt.groupBy("x", "y").applyInPandas(meet, "episode_index long, representative long, distance double, rank long")
    return met.groupBy("episode_index").agg(F.min_by(F.struct("representative", "distance"), F.struct("distance", "rank")).alias("r")).select("episode_index", "r.representative", "r.distance")


def greedy_dedup(keep: DataFrame, vectors: DataFrame, epsilon: float, k: int | None = None, most_rounds: int = 1000) -> DataFrame:
    """(episode_index, rank, kept): a walk in keep order that skips what lies within ``epsilon`` of one kept before.

    That walk keeps the lexicographically first maximal independent set of the closeness graph; it is
    found in parallel rounds (an undecided episode with no undecided or kept better neighbour is
    kept, its neighbours fall), until no edge is open; after each ``most_rounds`` the lineage of the
    fallen is cut. Episodes without a vector are kept. At most k of the kept stay.
    """
    ranked = K.cut(_ranked(keep).select("episode_index", "rank"))
    # of equal vectors all but the best fall, kept or not, so a crowd of copies makes no pairs
    placed = vectors.join(ranked, "episode_index")
    firsts = K.cut(placed.groupBy("v").agg(F.min_by("episode_index", "rank").alias("episode_index")))
    copies = placed.select("episode_index").join(firsts.select("episode_index"), "episode_index", "left_anti")
    pairs = close_pairs(firsts, epsilon)
    r = ranked.select(F.col("episode_index").alias("id"), F.col("rank").alias("r"))
    edges = pairs.join(r, pairs.a == r.id).withColumnRenamed("r", "ra").drop("id").join(r, F.col("b") == r.id).withColumnRenamed("r", "rb")
    edges = K.cut(edges.select(F.when(F.col("ra") < F.col("rb"), F.col("a")).otherwise(F.col("b")).alias("better"), F.when(F.col("ra") < F.col("rb"), F.col("b")).otherwise(F.col("a")).alias("worse")))
    fallen = copies
    open_edges = edges
    for done in count(1):
        # who is better in an open edge and worse in none is kept, and all that are worse than those fall
        beaten = open_edges.select(F.col("worse").alias("beaten")).distinct()
        down = K.cut(open_edges.join(beaten, open_edges.better == beaten.beaten, "left_anti").select(F.col("worse").alias("episode_index")).distinct())
        fallen = fallen.union(down) if done % most_rounds else K.cut(fallen.union(down))
        # an edge of a kept episode goes with the one that falls
        open_edges = K.cut(open_edges.join(down, open_edges.better == down.episode_index, "left_anti").join(down, F.col("worse") == down.episode_index, "left_anti"))
        if not open_edges.limit(1).count():
            break
    marked = ranked.join(fallen.distinct().withColumn("fell", F.lit(True)), "episode_index", "left").withColumn("alive", F.col("fell").isNull())
    if k is None:
        return marked.select("episode_index", "rank", F.col("alive").alias("kept"))
    chosen = marked.where("alive").orderBy("rank").limit(k).select("episode_index").withColumn("in", F.lit(True))
    return marked.join(chosen, "episode_index", "left").select("episode_index", "rank", F.col("in").isNotNull().alias("kept"))


#: Coverage selection: entries of lists that the driver holds in a round of some candidates, and in the last one of all;
#: distances that a round computes for its lists, and that one task is worth. They set the pace and never the result.
COVERAGE_ENTRIES, COVERAGE_LAST, COVERAGE_DISTANCES, COVERAGE_TASK = 4_000_000, 8_000_000, 128_000_000, 4_000_000


def _steps(x: np.ndarray, y: np.ndarray, scale: float) -> np.ndarray:
    """Distances of the rows of x to those of y in whole steps of 1 / ``scale``, alike whichever way round."""
    out = np.zeros((len(x), len(y)))
    for i in range(x.shape[1]):
        d = x[:, i, None] - y[None, :, i]
        d *= d
        out += d
    np.sqrt(out, out)
    out *= scale
    return np.rint(out, out)


def _tiles(rows: np.ndarray, columns: np.ndarray, x: np.ndarray, scale: float, size: tuple[int, int] = (32, 512)):
    """(first row, first column, distances) of pieces that stay in a processor's cache."""
    for r in range(0, len(rows), size[0]):
        near = x[rows[r : r + size[0]]]
        for c in range(0, len(columns), size[1]):
            yield r, c, _steps(near, x[columns[c : c + size[1]]], scale)


def _lost(rows: np.ndarray, x: np.ndarray, scale: float, points: np.ndarray, old: np.ndarray, new: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What gains and lists of candidates lose when the distances that cover ``points`` fall from old to new."""
    gain, entries = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
    fall = old - new
    for r, c, d in _tiles(rows, points, x, scale):
        o, part = old[c : c + d.shape[1]], slice(r, r + len(d))
        entries[part] += np.count_nonzero((d < o) & (d >= new[c : c + d.shape[1]]), axis=1)
        np.subtract(o, d, out=d)
        np.maximum(d, 0, out=d)
        np.minimum(d, fall[c : c + d.shape[1]], out=d)
        gain[part] += d.astype(np.int64).sum(1)
    return gain, entries


def _lists(rows: np.ndarray, x: np.ndarray, scale: float, covered: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(length of each candidate's list, points, distances): the points that a candidate is nearer to than what covers them."""
    found = []
    for r, c, d in _tiles(rows, np.arange(len(x)), x, scale):
        i, j = np.nonzero(d < covered[c : c + d.shape[1]])
        found.append((i + r, (j + c).astype(np.int32), d[i, j].astype(np.int64)))
    who, points, far = (np.concatenate(f) for f in zip(*found))
    by = np.argsort(who, kind="stable")
    return np.bincount(who, minlength=len(rows)), points[by], far[by]


class Local:
    """Runs a function of some rows and all vectors here, a block of rows at a time."""

    def __init__(self, x: np.ndarray):
        self.x = x

    def __call__(self, f: Callable, rows: np.ndarray, width: int, *args) -> list:
        return [f(rows, self.x, *args)]

    def close(self) -> None:
        pass


class Spread(Local):
    """Runs it on the executors; what is less than a task is worth is done here."""

    def __init__(self, x: np.ndarray, spark: SparkSession):
        super().__init__(x)
        self.context = spark.sparkContext
        self.held = self.context.broadcast(x)

    def __call__(self, f: Callable, rows: np.ndarray, width: int, *args) -> list:
        n = min(len(rows), 2 * self.context.defaultParallelism, len(rows) * width // COVERAGE_TASK)
        if n < 2:
            return super().__call__(f, rows, width, *args)
        held = self.held
        return self.context.parallelize(np.array_split(rows, n), n).map(lambda part: f(part, held.value, *args)).collect()

    def close(self) -> None:
        self.held.destroy()


def coverage(keep: list[tuple[int, str, float]], vectors: dict[int, np.ndarray], k: int, quality_weight: float = 0.0, spark: SparkSession | None = None) -> list[int]:
    """Greedy facility location on all episodes; leftovers are filled by keep order.

    Distances count in whole steps, as fine as 64-bit sums allow, so a gain is the same number in whatever order it is
    summed, and equal gains go by keep order. Gains only shrink (the objective is submodular). A round takes the
    candidates of the largest gains with their lists, and picks the best of them while it is ahead of what all others
    had when the round began; then all gains are brought up to date for the points that changed, on the executors if
    ``spark`` is given. The last round has the lists of all. The driver holds the vectors and a bounded number of entries.
    """
    order = sorted(keep, key=lambda r: (-r[2], r[1]))
    known = [r for r in order if r[0] in vectors]
    picked = _greedy_cover(np.array([vectors[r[0]] for r in known], float), quality_weight * np.array([r[2] for r in known], float), k, spark) if known and k > 0 else []
    chosen = [known[i][0] for i in picked]
    taken = set(chosen)
    rest = [r[0] for r in order if r[0] not in taken]
    return [*chosen, *rest[: max(0, k - len(chosen))]]


def _greedy_cover(x: np.ndarray, score: np.ndarray, k: int, spark: SparkSession | None) -> list[int]:
    """Rows of x in the order in which greedy facility location picks them, k at most; the first goes first."""
    n = len(x)
    span = float(np.sqrt((np.ptp(x, axis=0) ** 2).sum())) or 1.0
    scale = 2.0 ** np.floor(np.log2(min(2.0**61 / (n * span), 2.0**52 / span, 2.0**61 / max(np.abs(score).max(), 1e-300))))
    extra = np.rint(score * scale).astype(np.int64)
    run = Spread(x, spark) if spark else Local(x)
    everyone = np.arange(n)
    # nothing is covered yet, every gain is infinite: the first in keep order
    picked, left = [0], np.ones(n, bool)
    left[0] = False
    covered = _steps(x[:1], x, scale)[0]
    parts = run(_lost, everyone, n, scale, everyone, covered, np.zeros(n))
    gain, entries = np.concatenate([g for g, _ in parts]) + extra, np.concatenate([e for _, e in parts])
    while len(picked) < k and left.any():
        ranked = np.flatnonzero(left)
        ranked = ranked[np.argsort(-gain[ranked], kind="stable")]
        sizes = np.cumsum(entries[ranked])
        if sizes[-1] <= COVERAGE_LAST:
            m = len(ranked)
        else:
            m = max(1, min(int(np.searchsorted(sizes, COVERAGE_ENTRIES, "right")), COVERAGE_DISTANCES // n))
        ahead = ranked[:m]
        limit = (-int(gain[ranked[m]]), int(ranked[m])) if m < len(ranked) else (np.inf, n)
        parts = run(_lists, ahead, n, scale, covered)
        ends = np.cumsum(np.concatenate([p[0] for p in parts])).tolist()
        points, far = (np.concatenate([p[i] for p in parts]) for i in (1, 2))
        place = {i: slice(a, b) for i, a, b in zip(ahead.tolist(), [0, *ends], ends)}
        now = covered.astype(np.int64)
        best = [(-g, i) for g, i in zip(gain[ahead].tolist(), ahead.tolist())]
        heapify(best)
        while best and len(picked) < k and best[0] < limit:
            bound, i = best[0]
            near, d = points[place[i]], far[place[i]]
            fresh = (-int(np.maximum(now[near] - d, 0).sum() + extra[i]), i)
            if fresh[0] > bound:
                heapreplace(best, fresh)
                continue
            heappop(best)
            picked.append(i)
            left[i] = False
            now[near] = np.minimum(now[near], d)
        if len(picked) < k and left.any():
            changed = np.flatnonzero(now < covered)
            after = now.astype(float)
            if len(changed):
                parts = run(_lost, everyone, len(changed), scale, changed, covered[changed], after[changed])
                gain -= np.concatenate([g for g, _ in parts])
                entries -= np.concatenate([e for _, e in parts])
            covered = after
    run.close()
    return picked


def equal_n_baseline(valid: list[int], k: int, seed: int) -> list[int]:
    """A seeded random draw of k of the valid positions, sorted; NumPy's streams, on the driver."""
    state = np.random.SeedSequence([seed, BASELINE_STREAM]).generate_state(1)[0]
    return sorted(int(i) for i in np.random.default_rng(int(state)).choice(np.array(valid, np.int64), min(k, len(valid)), replace=False)) if valid else []


def decisions(episodes: DataFrame, keep: DataFrame, kept: DataFrame, gated: DataFrame | None = None, dropped: DataFrame | None = None, unlisted: DataFrame | None = None, similar: DataFrame | None = None, how: str = "near-duplicate of") -> DataFrame:
    """(episode_index, keep_score, kept, reason, representative) of every episode.

    gated has gate_signal and value; similar (episode_index, representative) are removed episodes that a kept
    one stands for. A gate comes before lists, lists before the kept, those before similar ones, then the budget.
    """
    out = episodes.select("episode_index").join(keep.select("episode_index", "keep_score"), "episode_index", "left").join(kept.select("episode_index").withColumn("k", F.lit(True)), "episode_index", "left")
    reason = F.format_string("below budget: keep score %.4f", "keep_score")
    represented = F.lit(None).cast("long")
    if similar is not None:
        out = out.join(similar.select("episode_index", "representative"), "episode_index", "left")
        represented = F.when(F.col("k").isNull(), F.col("representative"))
        reason = F.when(represented.isNotNull(), F.format_string(f"{how} kept episode %d", "representative")).otherwise(reason)
    reason = F.when(F.col("k"), F.format_string("kept: keep score %.4f", "keep_score")).otherwise(reason)
    for name, df, text in (("listed", dropped, F.lit("on the drop list")), ("unlisted", unlisted, F.lit("not on the keep list"))):
        if df is not None:
            out = out.join(df.select("episode_index").distinct().withColumn(name, F.lit(True)), "episode_index", "left")
            reason = F.when(F.col(name), text).otherwise(reason)
    if gated is not None:
        out = out.join(gated.select("episode_index", "gate_signal", F.col("value").alias("gate_value")), "episode_index", "left")
        reason = F.when(F.col("gate_signal").isNotNull(), F.format_string("gated: %s = %.4f", "gate_signal", "gate_value")).otherwise(reason)
    return out.select("episode_index", "keep_score", F.coalesce("k", F.lit(False)).alias("kept"), reason.alias("reason"), represented.alias("representative"))
