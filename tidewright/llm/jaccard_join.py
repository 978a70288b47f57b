"""N-gram Jaccard join with Bayesian candidate pruning.

Documents are sets of word shingles; two are linked if the Jaccard similarity of their sets reaches
the threshold. Equal sets are one class of copies from the start, kept as one representative with a
multiplicity, and are never expanded into pairs.

1. MinHash values are computed once per document; bands of them put representatives into buckets.
2. Pairs in a bucket are compared by their MinHash values, ``CHUNK`` at a time. After each chunk a
   pair is dropped if the posterior probability, under a uniform prior, that its similarity reaches
   the threshold is below ``TOLERANCE``. What is left is passed on as a spanning forest.
3. Within each component of that forest all pairs are verified exactly on their shingle sets.

A bucket or component larger than a block is split into blocks, and pairs of blocks are dealt out,
so a task holds two blocks whatever the group's size; pairs are compared inside, counted and never
emitted: a row for a representative and block pair goes out. With 40 bands of 5 values a pair at
exactly 0.8 meets in no band with probability 1.3e-7, one at 0.9 with 1e-15.

Defined results: a text of 1 to 4 words is one shingle of all its words; a text without words (or
null) is linked to nothing; a pair at exactly the threshold is linked; repeated rows (equal doc_id
and text) are one document and get equal results, rows of one doc_id with different texts are
documents of their own; a null doc_id is one more id, before all others, so the class of a document
without id has no id; other columns are ignored by ``join`` and kept by ``representatives``. Shingles
are compared by 64-bit hashes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.llm.common import bounded_batches, components, cut, grouped, mix, release, sliced, utf8, window_hashes, word_hashes

SHINGLE = 5
THRESHOLD = 0.8
BANDS, ROWS = 40, 5
HASHES = BANDS * ROWS
#: MinHash values compared at a time, and the posterior probability under which a pair is dropped.
CHUNK, TOLERANCE = 20, 1e-6
#: Documents in a block of comparison and of verification, and bytes of text in the latter, about.
BLOCK, VERIFY_BLOCK, BLOCK_BYTES = 1024, 128, 8_000_000

_NULL_ID = -(2**63)
_draw = np.random.default_rng(11)
_A = (_draw.integers(0, 2**31, HASHES) * 2 + 1).astype(np.uint32)
_B = _draw.integers(0, 2**32, HASHES).astype(np.uint32)


def shingles(texts: pa.Array, width: int = SHINGLE) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    words, first = word_hashes(*utf8(texts))
    h = window_hashes(words, width)
    out = []
    for lo, hi in zip(first[:-1].tolist(), first[1:].tolist()):
        n = hi - lo
        out.append(np.unique(h[lo : hi - width + 1]) if n >= width else window_hashes(words[lo:hi], n, seed=2) if n else np.empty(0, np.uint64))
    return out


def minhash(s: np.ndarray) -> np.ndarray:
    """``HASHES`` MinHash values of a set of 64-bit hashes."""
    x = (s >> np.uint64(32)).astype(np.uint32)
    least = np.full(HASHES, 2**32 - 1, np.uint32)
    for at in range(0, len(x), 2048):
        np.minimum(least, (x[at : at + 2048, None] * _A + _B).min(0), out=least)
    return least


def least_matches(threshold: float = THRESHOLD, tolerance: float = TOLERANCE, hashes: int = HASHES, chunk: int = CHUNK) -> list[int]:
    """After each chunk, the fewest equal values with which a pair stays.

    Values are compared by one byte, so they agree with probability J + (1 - J) / 256. Under a uniform
    prior P(J >= t | m of n agree) is the probability of at most m successes in n + 1 draws at t.
    """
    t = threshold + (1 - threshold) / 256
    out = []
    for n in range(chunk, hashes + 1, chunk):
        total, m = 0.0, -1
        while total < tolerance:
            m += 1
            total += math.comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
        out.append(m)
    return out


def _surviving(signatures: np.ndarray, a: np.ndarray, b: np.ndarray, limits: list[int]) -> np.ndarray:
    """Which pairs (rows of ``signatures``) outlast the incremental comparison."""
    alive, agreed = np.arange(len(a)), np.zeros(len(a), np.int32)
    for k, limit in enumerate(limits):
        part = signatures[:, k * CHUNK : (k + 1) * CHUNK]
        agreed += (part[a[alive]] == part[b[alive]]).sum(1, dtype=np.int32)
        stay = agreed >= limit
        alive, agreed = alive[stay], agreed[stay]
        if not len(alive):
            break
    return alive


def _forest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The least member of the component of each of ``n`` nodes under edges (a, b)."""
    root = np.arange(n)
    while len(a):
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        while not np.array_equal(new, new[new]):
            new = new[new]
        root = new[root]
        differ = root[a] != root[b]
        a, b = a[differ], b[differ]
    return root


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, t, d1, d2, n, sig, bands): digest of the set, one byte per MinHash value, and the bands' hashes."""
    salt = (np.arange(BANDS, dtype=np.uint64) + np.uint64(1)) * np.uint64(0x9FB21C651E98DF25)
    for batch in sliced(batches):
        at, d1, d2, sizes, sigs, bands = [], [], [], [], [], []
        for i, s in enumerate(shingles(batch.column("text"))):
            if not len(s):
                continue
            m = minhash(s)
            at.append(i), sizes.append(len(s)), sigs.append((mix(m) & np.uint64(255)).astype(np.uint8).tobytes())
            d1.append(int(mix(s).sum().view(np.int64))), d2.append(int(mix(s ^ np.uint64(0xC2B2AE3D27D4EB4F)).sum().view(np.int64)))
            rows = m.reshape(BANDS, ROWS).astype(np.uint64)
            h = salt.copy()
            for r in range(ROWS):
                h = mix(h ^ rows[:, r]) + salt
            bands.append(h.view(np.int64))
        flat = pa.array(np.concatenate(bands) if bands else np.empty(0, np.int64))
        lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(at) * BANDS + 1, BANDS, dtype=np.int32)), flat)
        some = pa.array(at, pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column("id").take(some), batch.column("t").take(some), pa.array(d1, pa.int64()), pa.array(d2, pa.int64()), pa.array(sizes, pa.int64()), pa.array(sigs, pa.binary()), lists], names=["id", "t", "d1", "d2", "n", "sig", "bands"])


_SIGNED = "id long, t long, d1 long, d2 long, n long, sig binary, bands array<long>"


def _pairs_of(sizes: np.ndarray, side: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of the groups, which lie one after another, some at a time.

    side: 0 for a group that is one block; 1 and 2 for the two blocks of a pair, which are compared across.
    """
    starts = np.concatenate([[0], np.cumsum(sizes)])[:-1]
    small = (sizes <= 64) & (side[starts] == 0) if len(starts) else np.empty(0, bool)
    for m in np.unique(sizes[small]):
        i, j = np.triu_indices(int(m), 1)
        at = starts[small & (sizes == m)]
        if len(i):
            for k in range(0, len(at), max(1, 500_000 // len(i))):
                part = at[k : k + max(1, 500_000 // len(i)), None]
                yield (part + i).ravel(), (part + j).ravel()
    for k in np.flatnonzero(~small):
        lo, n = int(starts[k]), int(sizes[k])
        if side[lo]:
            s = side[lo : lo + n]
            left, right = lo + np.flatnonzero(s == 1), lo + np.flatnonzero(s == 2)
            for x in range(0, len(left), 256):
                part = left[x : x + 256]
                yield np.repeat(part, len(right)), np.tile(right, len(part))
        else:
            rows = np.arange(lo, lo + n)
            for x in range(0, n, 256):
                part = rows[x : x + 256]
                a, b = np.repeat(part, n - x), np.tile(rows[x:], len(part))
                keep = a < b
                yield a[keep], b[keep]


def _group_sizes(keys: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]]))


def _pruned(limits: list[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in grouped(batches, "g"):
            keys, ids, side = (table.column(c).to_numpy() for c in ("g", "id", "side"))
            sigs = np.frombuffer(b"".join(table.column("sig").to_pylist()), np.uint8).reshape(-1, HASHES)
            nodes, code = np.unique(ids, return_inverse=True)
            ea, eb = [], []
            for a, b in _pairs_of(_group_sizes(keys), side):
                on = code[a] != code[b]
                a, b = a[on], b[on]
                alive = _surviving(sigs, a, b, limits)
                ea.append(code[a[alive]]), eb.append(code[b[alive]])
            a, b = (np.concatenate(e) if e else np.empty(0, np.int64) for e in (ea, eb))
            root = _forest(a, b, len(nodes))
            rest = np.flatnonzero(root != np.arange(len(nodes)))
            yield pa.RecordBatch.from_arrays([pa.array(nodes[rest]), pa.array(nodes[root[rest]])], names=["a", "b"])

    return run


def _linked(sets: list[np.ndarray], threshold: float) -> np.ndarray:
    """Which pairs of sets reach the threshold, exactly."""
    m = len(sets)
    sizes = np.array([len(s) for s in sets], np.int64)
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(m), sizes)
    _, code = np.unique(flat, return_inverse=True)
    order = np.argsort(code, kind="stable")
    code, owner = code[order], owner[order]
    common = np.zeros((m, m), np.float64)
    width = max(64, 2_000_000 // m)
    for lo in range(0, int(code[-1]) + 1, width):
        at = slice(*np.searchsorted(code, [lo, lo + width]))
        x = np.zeros((m, width), np.float32)
        x[owner[at], code[at] - lo] = 1
        common += x @ x.T
    union = sizes[:, None] + sizes[None, :] - common
    # integers below 2**53: no rounding in this comparison for thresholds in hundredths
    return np.rint(100 * common) >= np.rint(100 * threshold) * union


def _verified(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in grouped(batches, "g"):
            keys, ids, side, times = (table.column(c).to_numpy() for c in ("g", "id", "side", "times"))
            sets = shingles(table.column("text").chunk(0))
            roots, links = np.empty(len(ids), np.int64), np.zeros(len(ids), np.int64)
            lo = 0
            for n in _group_sizes(keys).tolist():
                part = slice(lo, lo + n)
                linked = _linked(sets[part], threshold)
                np.fill_diagonal(linked, False)
                s = side[part]
                linked &= (s[:, None] != s[None, :]) | (s[0] == 0)
                links[part] = linked @ times[part]
                i, j = np.nonzero(np.triu(linked))
                order = np.argsort(ids[part], kind="stable")
                place = np.empty(n, np.int64)
                place[order] = np.arange(n)
                root = _forest(place[i], place[j], n)
                roots[part] = ids[part][order[root[place]]]
                lo += n
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(roots), pa.array(links)], names=["id", "root", "links"])

    return run


def _blocks(rows: DataFrame, key: str, blocks: str) -> DataFrame:
    """Rows dealt to pairs of blocks of their group: columns g, side are added. A row of a group of n blocks goes to n pairs."""
    n, own = F.col(blocks), F.pmod(F.xxhash64("id", key), F.col(blocks))
    other = F.explode(F.sequence(F.lit(0).cast("long"), n - 1))
    dealt = rows.withColumn("own", own).withColumn("other", other)
    low, high = F.least("own", "other"), F.greatest("own", "other")
    return dealt.withColumn("g", F.when(n == 1, F.col(key)).otherwise(F.xxhash64(key, low, high))).withColumn("side", F.when(low == high, 0).when(F.col("own") == low, 1).otherwise(2)).drop("own", "other")


def _by_group(rows: DataFrame) -> DataFrame:
    return rows.repartition("g").sortWithinPartitions("g")


def _keys(docs: DataFrame) -> list:
    """Columns id and t, which tell a document: its doc_id and a hash of its text."""
    return [F.coalesce(F.col("doc_id").cast("long"), F.lit(_NULL_ID)).alias("id"), F.xxhash64("text").alias("t")]


def _classes(docs: DataFrame, threshold: float, tolerance: float, block: int) -> DataFrame:
    """(id, t, node, label, first, links): per document with words its set's node, the class's node, the class's least id and its links.

    A node is a distinct set of shingles; its number is that of its row in a checkpoint.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    texts = docs.select(*_keys(docs), "text")
    signed = cut(texts.mapInArrow(_signed, _SIGNED))
    pair = F.struct("id", "t")
    sets = signed.groupBy("d1", "d2", "n").agg(F.min(pair).alias("rep"), F.count_distinct("id").alias("times"))
    sets = cut(sets.select(F.monotonically_increasing_id().alias("node"), "d1", "d2", "n", F.col("rep.id").alias("first"), F.col("rep.t").alias("first_t"), "times"))
    # equal sets have equal signatures, so any of a repeated row's will do
    once = signed.select(F.col("id").alias("first"), F.col("t").alias("first_t"), "sig", "bands")
    chosen = cut(sets.select("node", "first", "first_t").join(once, ["first", "first_t"]).dropDuplicates(["node"]).select(F.col("node").alias("id"), "sig", "bands"))
    release(spark)

    member = chosen.select("id", F.explode("bands").alias("bucket"))
    crowded = cut(member.groupBy("bucket").count().where("count > 1"))
    blocks = F.ceil(F.col("count") / block).cast("long")
    placed = member.join(crowded, "bucket").withColumn("blocks", blocks).select("id", "bucket", "blocks")
    with_sig = placed.join(chosen.select("id", "sig"), "id")
    edges = cut(_by_group(_blocks(with_sig, "bucket", "blocks").select("g", "id", "side", "sig")).mapInArrow(_pruned(least_matches(threshold, tolerance)), "a long, b long").distinct())
    release(spark)

    close = components(edges)
    wanted = cut(close.join(sets, "node").select(F.col("node").alias("id"), "label", "times", "first", "first_t"))
    found = texts.select(F.col("id").alias("first"), F.col("t").alias("first_t"), "text")
    sized = cut(wanted.join(found, ["first", "first_t"]).dropDuplicates(["id"]).select("id", "label", "times", "text"))
    groups = sized.groupBy("label").agg(F.greatest(F.ceil(F.count("*") / min(block, VERIFY_BLOCK)), F.ceil(F.sum(F.octet_length("text")) / BLOCK_BYTES)).cast("long").alias("blocks"))
    bounded_batches(spark, 256)
    dealt = _by_group(_blocks(sized.join(groups, "label"), "label", "blocks").select("g", "id", "side", "times", "text"))
    checked = cut(dealt.mapInArrow(_verified(threshold), "id long, root long, links long"))
    release(spark)
    links = checked.groupBy(F.col("id").alias("node")).agg(F.sum("links").alias("links"))
    labels = components(checked.where("id <> root").select(F.col("id").alias("a"), F.col("root").alias("b")))

    least = labels.join(sets.select("node", "first"), "node").groupBy("label").agg(F.min("first").alias("least"))
    linked = labels.join(least, "label").join(links, "node")
    classes = sets.join(linked, "node", "left").select("node", "d1", "d2", "n", F.coalesce("label", "node").alias("label"), F.coalesce("least", "first").alias("first"), (F.coalesce("links", F.lit(0)) + F.col("times") - 1).alias("links"))
    return signed.select("id", "t", "d1", "d2", "n").distinct().join(classes, ["d1", "d2", "n"]).select("id", "t", "node", "label", "first", "links")


def join(docs: DataFrame, threshold: float = THRESHOLD, tolerance: float = TOLERANCE, block: int = BLOCK) -> DataFrame:
    """Per row of ``docs``: doc_id, class_id (the least doc_id that links lead to), n_links (documents linked to it)."""
    known = _classes(docs, threshold, tolerance, block).select("id", "t", F.col("first").alias("class"), F.col("links").alias("n_links"))
    given = lambda c: F.when(c != _NULL_ID, c)
    return docs.select(*_keys(docs)).join(known, ["id", "t"], "left").select(given(F.col("id")).alias("doc_id"), given(F.coalesce("class", "id")).alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def representatives(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One document of each class, the one of least doc_id (then of least hash of its text), with its own columns.

    Of rows equal in doc_id and text one stays, that of the least hash of all columns. Documents without words all stay.
    """
    known = cut(_classes(docs, threshold, TOLERANCE, BLOCK))
    best = known.groupBy("label").agg(F.min(F.struct("id", "t")).alias("best")).select("best.*")
    gone = known.join(best, ["id", "t"], "left_anti").select(F.col("id").alias("_kept_id"), F.col("t").alias("_kept_t"))
    id_, t = _keys(docs)
    rows = docs.join(gone, (id_ == gone["_kept_id"]) & (t == gone["_kept_t"]), "left_anti")
    keyed = docs.select(id_, t)
    if not keyed.groupBy("id", "t").count().where("count > 1").limit(1).count():
        return rows
    packed = rows.select(id_, t, F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"))
    return packed.groupBy("id", "t").agg(F.min_by("_row", F.xxhash64("_row")).alias("_row")).select("_row.*")
