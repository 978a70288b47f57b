"""Substring dedup by recompression: words covered by a repeated window of words are removed.

A document is a sequence of word symbols. Round 0 names its runs; each later round splits the symbols
into left and right ones by a hash and names every left-right pair that stands for few enough words.
A name is a hash of what it stands for, so it is global without a dictionary: equal runs and pairs get
equal names in all documents, and equal substrings get equal symbols except near their ends.

Spark counts the names of some rounds over the corpus, one job a round:

1. After round ``ANCHOR_ROUND`` symbols are short. For each window the *certain* symbols are those that
   its own words alone decide; equal windows have equal certain symbols at equal places, the longest
   is the window's anchor. A window whose anchor is nowhere else has no copy and is looked at no more.
2. After round ``LONG_ROUND`` symbols stand for whole passages. A symbol of at least a window's words
   that an earlier document has reveals a long repeat: all windows inside of it are repeated.
3. What is left are windows that cross the ends of long symbols. They are compared as a whole.

Repeats of 2 and 3 are verified by two names that are made of different hashes of the words, of 64 and
32 bits; anchors of 1 only choose what to look at. Then each document drops the words of its windows
that start earlier elsewhere.

All steps aggregate before they shuffle, and join back by joins that Spark can split if a key is hot.
Later exact copies of a text (by MD5) take no part: all their windows start in the first copy.

Defined results: a null text has no words; texts of fewer words than the window lose none; a null
doc_id comes before all others, and none of them before another; rows with equal doc_id and text are
one document and get equal results, rows of one doc_id with other texts do not repeat each other;
other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewright.llm.common import Bytes, Staged, bounded_batches, cut, hash_words, mix, release, sliced, utf8, window_hashes, word_bounds
from tidewright.llm.common import longs as longs_of

WINDOW = 20
#: The round whose symbols anchor windows (the two before it stand in for windows without a certain symbol),
#: and the round whose symbols reveal long repeats.
ANCHOR_ROUND, LONG_ROUND = 4, 13
FALLBACKS = 2
#: The most words that a pair may stand for up to the round of anchors, and after it.
LONGEST_SHORT, LONGEST = 12, 400

#: Documents without id have numbers under this one, by hash of their text; they all come before the others and at once.
_NULL_ID = -(2**63)
_FIRST_ID = _NULL_ID + 2**40
_BATCH = 256


def _runs(words: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first word, words) of each run of one symbol; words of two documents make no run."""
    head = np.ones(len(words), bool)
    head[1:] = (words[1:] != words[:-1]) | (docs[1:] != docs[:-1])
    start = np.flatnonzero(head)
    return start, np.diff(np.append(start, len(words)))


def _named_runs(words: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    return np.where(size == 1, words[start], mix(words[start] + size.astype(np.uint64) * np.uint64(0xA24BAED4963EE407)))


def _sides(name: np.ndarray, k: int) -> np.ndarray:
    """Whether a symbol is a right one in round ``k``."""
    return (mix(name ^ np.uint64(k * 0x9FB21C651E98DF25 % 2**64)) & np.uint64(1)).astype(bool)


def _longest(k: int) -> int:
    return LONGEST_SHORT if k <= ANCHOR_ROUND else LONGEST


def _pairs(right: np.ndarray, size: np.ndarray, doc: np.ndarray, k: int) -> np.ndarray:
    """Whether each symbol is the left one of a pair."""
    left = np.zeros(len(size), bool)
    left[:-1] = ~right[:-1] & right[1:] & (doc[:-1] == doc[1:]) & (size[:-1] + size[1:] <= _longest(k))
    return left


def _kept(left: np.ndarray) -> np.ndarray:
    """Which symbols are left once the right ones of pairs are taken in."""
    keep = np.ones(len(left), bool)
    keep[1:] = ~left[:-1]
    return keep


def _named_pairs(name: np.ndarray, left: np.ndarray, keep: np.ndarray) -> np.ndarray:
    return np.where(left, mix(name * np.uint64(0xD6E8FEB86659FD93) + np.append(name[1:], np.uint64(0))), name)[keep]


def _sized_pairs(size: np.ndarray, left: np.ndarray, keep: np.ndarray) -> np.ndarray:
    return np.where(left, size + np.append(size[1:], 0), size)[keep]


def symbols(words: np.ndarray, others: np.ndarray, docs: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(name, other name, first word, words) of each symbol after ``rounds`` rounds.

    ``words`` and ``others`` are two kinds of word symbols of documents one after another; the first decides the pairs.
    """
    start, size = _runs(words, docs)
    name, other, doc = _named_runs(words, start, size), _named_runs(others, start, size), docs[start]
    for k in range(1, rounds + 1):
        left = _pairs(_sides(name, k), size, doc, k)
        keep = _kept(left)
        name, other, size = _named_pairs(name, left, keep), _named_pairs(other, left, keep), _sized_pairs(size, left, keep)
        start, doc = start[keep], doc[keep]
    return name, other, start, size


def anchors(words: np.ndarray, docs: np.ndarray, window: int = WINDOW, rounds: int = ANCHOR_ROUND) -> tuple[np.ndarray, np.ndarray]:
    """(name of its anchor, whether it has one) of the window that starts at each word.

    ``words`` are the word symbols of documents one after another, ``docs`` the document of each.
    Windows that leave their document have no meaning here.
    """
    n = len(words)
    if n < window:
        return np.zeros(n, np.uint64), np.zeros(n, bool)
    start, size = _runs(words, docs)
    name, doc = _named_runs(words, start, size), docs[start]
    run = np.repeat(np.arange(len(start)), size)
    # certain symbols of window i are those from lo[i] up to hi[i]; the runs at its ends may go on outside
    lo = run[: n - window + 1] + 1
    hi = run[window - 1 :].copy()
    levels = []
    for k in range(1, rounds + 1):
        right = _sides(name, k)
        left = _pairs(right, size, doc, k)
        # a right symbol at the start may belong to a left one outside, a left one at the end likewise
        edge = np.append(right, False)
        lo = lo + edge[np.minimum(lo, len(name))]
        hi = hi - ~edge[hi - 1]
        keep = _kept(left)
        name, size, doc = _named_pairs(name, left, keep), _sized_pairs(size, left, keep), doc[keep]
        before = np.concatenate([[0], np.cumsum(keep)])
        hi = np.maximum(hi, 0)
        lo, hi = before[np.minimum(lo, len(keep))], before[hi]
        levels.append((name, size, lo, hi))
    out, has = np.zeros(n, np.uint64), np.zeros(n, bool)
    for name, size, lo, hi in levels[: -FALLBACKS - 2 : -1]:
        rank = (np.minimum(size, 127).astype(np.uint64) << np.uint64(57)) | (mix(name) >> np.uint64(7))
        some = np.flatnonzero((lo < hi) & ~has[: len(lo)])
        best, score = np.zeros(len(some), np.int64), np.zeros(len(some), np.uint64)
        active, step = np.arange(len(some)), 0
        while len(active):
            at = lo[some[active]] + step
            better = (rank[at] > score[active]) | (step == 0)
            w = active[better]
            best[w], score[w] = at[better], rank[at[better]]
            step += 1
            active = active[lo[some[active]] + step < hi[some[active]]]
        out[some], has[some] = name[best], True
    return out, has


class _Batch:
    """Words of a batch of texts, and which words start a whole window."""

    def __init__(self, texts: pa.Array, window: int):
        self.raw, self.offsets = utf8(texts)
        starts, ends = word_bounds(self.raw, self.offsets)
        data = Bytes(self.raw)
        # two kinds of word symbols, of different hashes
        self.words, self.others = hash_words(data, starts, ends), hash_words(data, starts, ends, seed=0x5BD1E995)
        self.first = np.searchsorted(starts, self.offsets)
        self.counts = np.diff(self.first)
        self.docs = np.repeat(np.arange(len(self.counts)), self.counts)
        left = self.first[1:][self.docs] - np.arange(len(self.words))
        self.whole = left >= window
        self.window = window

    def hashes(self, words: np.ndarray, seed: int = 1) -> np.ndarray:
        h = np.zeros(len(words), np.uint64)
        found = window_hashes(words, self.window, seed)
        h[: len(found)] = found
        return h

    def names(self) -> tuple[np.ndarray, np.ndarray]:
        """Both names of the window that starts at each word."""
        return self.hashes(self.words), _short(self.hashes(self.others, seed=2))

    def long_symbols(self, docs: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(name, other name, first word, words) of the symbols that hold a window, of all documents or of some."""
        at = np.arange(len(self.words)) if docs is None else np.flatnonzero(docs[self.docs])
        name, other, start, size = symbols(self.words[at], self.others[at], self.docs[at], LONG_ROUND)
        long = size >= self.window
        return name[long], _short(other[long]), at[start[long]], size[long]

    def inside(self, longs: pa.Array, others: pa.Array) -> np.ndarray:
        """Whether the window that starts at each word lies in a long symbol whose names its document is given."""
        depth = np.zeros(len(self.words) + 1, np.int64)
        (names, offsets), (twins, _) = longs_of(longs), longs_of(others)
        if len(names):
            name, other, start, size = self.long_symbols(np.diff(offsets) > 0)
            doc = self.docs[start]
            known = _within(doc, name, names, offsets) & _within(doc, other, twins, offsets)
            np.add.at(depth, start[known], 1)
            np.add.at(depth, start[known] + size[known] - self.window + 1, -1)
        return np.cumsum(depth[:-1]) > 0


def _short(name: np.ndarray) -> np.ndarray:
    """The upper half of a name."""
    return name >> np.uint64(32)


def _ints(name: np.ndarray) -> pa.Array:
    return pa.array(name.astype(np.uint32).view(np.int32))


def _first_of(doc: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Whether each (doc, value) is the first of its kind; documents lie one after another."""
    order = np.lexsort((value, doc))
    d, v = doc[order], value[order]
    new = np.ones(len(order), bool)
    new[1:] = (d[1:] != d[:-1]) | (v[1:] != v[:-1])
    out = np.zeros(len(order), bool)
    out[order[new]] = True  # lexsort is stable, so the first of equals comes first
    return out


def _within(doc: np.ndarray, value: np.ndarray, sets: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Whether each value is in the set of its document."""
    if not len(sets):
        return np.zeros(len(doc), bool)
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets)).astype(np.uint64)
    salt = np.uint64(0xC2B2AE3D27D4EB4F)
    if sets.dtype == np.int32:
        sets = sets.view(np.uint32).astype(np.int64)
    return np.isin(mix(value ^ mix(doc.astype(np.uint64) * salt)), mix(sets.view(np.uint64) ^ mix(owner * salt)))


def remove_repeats(documents: DataFrame, window: int = WINDOW) -> DataFrame:
    """Per document: doc_id, n_words, n_removed, kept_sha256, kept_text is left to ``kept_texts``."""
    return _final(documents, window, with_text=False)


def kept_texts(documents: DataFrame, window: int = WINDOW) -> DataFrame:
    """As ``remove_repeats``, with the kept words joined by one space as ``kept_text``."""
    return _final(documents, window, with_text=True)


def _final(documents: DataFrame, window: int, with_text: bool) -> DataFrame:
    spark = documents.sparkSession
    bounded_batches(spark, _BATCH)
    without = F.lit(_NULL_ID) + F.pmod(F.xxhash64("text"), F.lit(_FIRST_ID - _NULL_ID))
    docs = documents.select(F.coalesce(F.col("doc_id").cast("long"), without).alias("id"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    texts = docs.select("id", "text")
    keys, anchored = _shared_anchors(texts, window)
    longs, named = _shared_symbols(texts, window)
    info = cut(keys.join(longs, "id", "full").join(_copies(texts).withColumn("copy", F.lit(True)), "id", "full"))
    anchored.drop()
    named.drop()
    release(spark)
    staged = Staged(texts.join(info, "id", "left").mapInArrow(_candidates(window), "id long, h long, g int"))
    release(spark)
    windows = staged.rows
    shared = Staged(windows.groupBy("h", "g").agg(F.min(_order()).alias("first"), F.count("*").alias("n")).where("n > 1").select("h", "g", "first"))
    firsts = shared.rows
    release(spark)
    later = windows.join(firsts, ["h", "g"]).where(_order() > F.col("first")).groupBy("id").agg(F.collect_list(F.struct("h", "g")).alias("r"))
    later = cut(later.select("id", F.col("r.h").alias("repeated"), F.col("r.g").alias("repeated_g")))
    staged.drop()
    shared.drop()
    release(spark)
    joined = docs.join(info.select("id", "copy", "longs", "longs_g"), "id", "left").join(later, "id", "left")
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * with_text
    return joined.mapInArrow(_cleaned(window, with_text), schema)


def _order() -> Column:
    """What tells which of two documents comes first."""
    return F.when(F.col("id") < _FIRST_ID, _NULL_ID).otherwise(F.col("id"))


def _copies(texts: DataFrame) -> DataFrame:
    """(id) of the later exact copies of a text."""
    digests = texts.where("text is not null").select("id", F.md5("text").alias("digest"))
    order = _order()
    copied = cut(digests.groupBy("digest").agg(F.min(order).alias("first"), F.max(order).alias("last")).where("last > first").select("digest", "first"))
    return digests.join(copied, "digest").where(_order() > F.col("first")).select("id").distinct()


def _shared_anchors(texts: DataFrame, window: int) -> tuple[DataFrame, Staged]:
    """(id, keys), the repeated anchors of a document, and the table that it is read from."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, _BATCH):
            b = _Batch(batch.column("text"), window)
            name, has = anchors(b.words, b.docs, window)
            at = np.flatnonzero(has & b.whole)
            # neighbouring windows share anchors, so most repeats go here
            new = np.ones(len(at), bool)
            new[1:] = (name[at[1:]] != name[at[:-1]]) | (b.docs[at[1:]] != b.docs[at[:-1]])
            at = at[new]
            first = _first_of(b.docs[at], name[at])
            # an anchor that comes again within its document counts as repeated
            order = np.lexsort((name[at], b.docs[at]))
            starts = np.flatnonzero(first[order])
            times = np.diff(np.append(starts, len(order)))
            chosen = at[order[starts]]
            ids = np.asarray(batch.column("id"), np.int64)[b.docs[chosen]]
            yield pa.RecordBatch.from_arrays([pa.array(name[chosen].view(np.int64)), pa.array(ids), pa.array(times.astype(np.int64))], names=["key", "id", "n"])

    staged = Staged(texts.mapInArrow(emit, "key long, id long, n long"))
    found = staged.rows
    keys = cut(found.groupBy("key").agg(F.sum("n").alias("n")).where("n > 1").select("key"))
    release(texts.sparkSession)
    return found.select("key", "id").join(keys, "key").groupBy("id").agg(F.collect_list("key").alias("keys")), staged


def _shared_symbols(texts: DataFrame, window: int) -> tuple[DataFrame, Staged]:
    """(id, longs, longs_g), both names of the long symbols of a document that an earlier one has, and the table that they are read from."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, _BATCH):
            b = _Batch(batch.column("text"), window)
            name, other, start, _ = b.long_symbols()
            one = _first_of(b.docs[start], name)
            ids = np.asarray(batch.column("id"), np.int64)[b.docs[start[one]]]
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(name[one].view(np.int64)), _ints(other[one])], names=["id", "a", "b"])

    staged = Staged(texts.mapInArrow(emit, "id long, a long, b int"))
    found = staged.rows
    firsts = cut(found.groupBy("a", "b").agg(F.min(_order()).alias("first"), F.count("*").alias("n")).where("n > 1").select("a", "b", "first"))
    release(texts.sparkSession)
    later = found.join(firsts, ["a", "b"]).where(_order() > F.col("first")).groupBy("id").agg(F.collect_list(F.struct("a", "b")).alias("r"))
    return later.select("id", F.col("r.a").alias("longs"), F.col("r.b").alias("longs_g")), staged


def _candidates(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, _BATCH):
            b = _Batch(batch.column("text"), window)
            name, has = anchors(b.words, b.docs, window)
            copy = np.asarray(batch.column("copy").fill_null(False), dtype=bool)
            mask = b.whole & (~has | _within(b.docs, name, *longs_of(batch.column("keys")))) & ~copy[b.docs]
            mask &= ~b.inside(batch.column("longs"), batch.column("longs_g"))
            at = np.flatnonzero(mask)
            h, g = (x[at] for x in b.names())
            one = _first_of(b.docs[at], h)
            ids = np.asarray(batch.column("id"), np.int64)[b.docs[at[one]]]
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(h[one].view(np.int64)), _ints(g[one])], names=["id", "h", "g"])

    return run


def _cleaned(window: int, with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, _BATCH):
            b = _Batch(batch.column("text"), window)
            copy = np.asarray(batch.column("copy").fill_null(False), dtype=bool)
            at = np.flatnonzero(b.whole)
            doc = b.docs[at]
            h, g = (x[at] for x in b.names())
            (names, offsets), (twins, _) = longs_of(batch.column("repeated")), longs_of(batch.column("repeated_g"))
            gone = ~_first_of(doc, h) | copy[doc] | b.inside(batch.column("longs"), batch.column("longs_g"))[at]
            gone |= _within(doc, h, names, offsets) & _within(doc, g, twins, offsets)
            cover = np.zeros(len(b.words) + 1, np.int64)
            np.add.at(cover, at[gone], 1)
            np.add.at(cover, at[gone] + window, -1)
            removed = np.cumsum(cover[:-1]) > 0
            digests, texts, lost = [], [], []
            for i in range(batch.num_rows):
                lo, hi = b.first[i], b.first[i + 1]
                # bytes.split() splits at the characters that words do not have
                words = b.raw[b.offsets[i] : b.offsets[i + 1]].tobytes().split()
                out = removed[lo:hi]
                lost.append(int(out.sum()))
                kept = b" ".join(compress(words, ~out) if lost[-1] else words)
                digests.append(hashlib.sha256(kept).hexdigest())
                if with_text:
                    texts.append(kept.decode())
            columns = [batch.column("doc_id"), pa.array(b.counts.astype(np.int64)), pa.array(lost, pa.int64()), pa.array(digests, pa.string())] + [pa.array(texts, pa.string())] * with_text
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "n_removed", "kept_sha256"] + ["kept_text"] * with_text)

    return run
