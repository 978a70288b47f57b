"""Best-fit packing planned on a histogram of lengths.

Documents are tokenised and cut into pieces of at most ``CAPACITY`` tokens. A best-fit-decreasing
plan is made over the counts of each length, not over pieces: bins of one filling level are one
group, so the plan's size depends on the number of lengths alone. Each plan row gives the pieces of
one length and a range of ranks their place; a piece finds it by its rank within its length.

Ranks come from small cells (a length and a hash of the piece), counted first and offset by the sums
of the cells before; a length has as many cells as its pieces need, so one that a third of all pieces
have is dealt over many tasks.

Defined results: a null or empty text is one piece with token 1 alone; ties are ranked by doc_id,
then copy; repeated rows are packed each, as copies of their own; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewright.llm.common import Bytes, bounded_batches, cut, equal_words, hash_words, sliced, utf8, word_bounds

CAPACITY = 4096
END_ID = 1
#: Entries of the cache of encoded words in one Python worker.
CACHE_ENTRIES = 1_500_000
#: Pieces in one cell of ranks, about.
CELL_PIECES = 5_000

#: Latin letters whose lower case is one letter and that normalisation leaves alone, then signs: two units to the tokenizer.
_SIMPLE = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,!?;:#$%&*|()\"-]*)")
_encoders: dict[str, "WordEncoder"] = {}


class WordEncoder:
    """Token ids of texts, from a cache of the ids of words.

    The tokenizer's pattern never matches white space and its normaliser only turns runs of it into
    one, so the ids of a text are those of its white-space-separated words, one after another. Words
    are looked up by 64-bit hash, a batch at a time, and compared byte for byte with the word that is
    found; those not seen yet are encoded many at a time, as the last token of a unit is marked in the
    vocabulary. Texts with special tokens in them, which the tokenizer looks for first, are encoded
    whole, and so are texts with a word that shares its hash with another word of the batch.
    """

    def __init__(self, path: str, entries: int = CACHE_ENTRIES):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.entries = entries
        self.hashes, self.start, self.size = np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int32)
        self.pool, self.used = np.empty(0, np.uint32), 0
        # the known words themselves, one after another, and where each begins and how long it is
        self.letters, self.spelled = np.empty(0, np.uint8), 0
        self.begin, self.long = np.empty(0, np.int64), np.empty(0, np.int64)

    @classmethod
    def of(cls, path: str) -> "WordEncoder":
        if path not in _encoders:
            _encoders[path] = cls(path)
        return _encoders[path]

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _units(self, units: list[str]) -> dict[str, bytes]:
        out = {"": b""}
        for at in range(0, len(units), 1000):
            part = units[at : at + 1000]
            ids = np.array(self.tokenizer.encode(" ".join(part), add_special_tokens=False).ids, "<u4")
            ends = (np.flatnonzero(self.ends[ids]) + 1).tolist()
            if len(ends) == len(part) and (not ends or ends[-1] == len(ids)):
                raw = ids.tobytes()
                out.update(zip(part, (raw[4 * i : 4 * j] for i, j in zip([0, *ends], ends))))
            else:
                out.update((u, self._whole(u)) for u in part)
        return out

    def _words(self, words: list[str]) -> list[bytes]:
        simple = [_SIMPLE.fullmatch(w) for w in words]
        cores, signs = [m[1].lower() if m else "" for m in simple], [m[2] if m else "" for m in simple]
        units = self._units(sorted({*cores, *signs} - {""}))
        return [units[c] + units[s] if m else self._whole(w) for m, c, s, w in zip(simple, cores, signs, words)]

    def _places(self, hashes: np.ndarray, data: Bytes, begins: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(start, size) in the pool of the ids of distinct words, given where they stand in ``data``."""
        at = np.minimum(np.searchsorted(self.hashes, hashes), max(len(self.hashes) - 1, 0))
        taken = self.hashes[at] == hashes if len(self.hashes) else np.zeros(len(hashes), bool)
        known = taken.copy()
        if taken.any():
            hit = np.flatnonzero(taken)
            k = at[hit]
            same = self.long[k] == sizes[hit]
            alike = np.flatnonzero(same)
            same[alike] = equal_words(data, begins[hit[alike]], Bytes(self.letters[: self.spelled]), self.begin[k[alike]], sizes[hit[alike]])
            known[hit] = same
        start, size = np.empty(len(hashes), np.int64), np.empty(len(hashes), np.int32)
        start[known], size[known] = self.start[at[known]], self.size[at[known]]
        missing = np.flatnonzero(~known)
        if len(missing):
            raw = [data.raw[i : i + n].tobytes() for i, n in zip(begins[missing].tolist(), sizes[missing].tolist())]
            found = self._words([w.decode() for w in raw])
            new = np.frombuffer(b"".join(found), "<u4")
            many = np.fromiter(map(len, found), np.int64, len(found)) // 4
            if self.used + len(new) > len(self.pool):
                self.pool = np.concatenate([self.pool[: self.used], np.empty(max(len(new), self.used // 4), np.uint32)])
            self.pool[self.used : self.used + len(new)] = new
            start[missing], size[missing] = self.used + np.cumsum(many) - many, many
            # a word that shares its hash with a known one is encoded each time
            fresh = ~taken[missing]
            if len(self.hashes) + int(fresh.sum()) <= self.entries:  # else frequent words have come first and stay
                self._learn(hashes[missing][fresh], start[missing][fresh], size[missing][fresh], [w for w, ok in zip(raw, fresh.tolist()) if ok])
                self.used += len(new)
        return start, size

    def _learn(self, hashes: np.ndarray, start: np.ndarray, size: np.ndarray, words: list[bytes]) -> None:
        letters = np.frombuffer(b"".join(words), np.uint8)
        if self.spelled + len(letters) > len(self.letters):
            self.letters = np.concatenate([self.letters[: self.spelled], np.empty(max(len(letters), self.spelled // 4), np.uint8)])
        self.letters[self.spelled : self.spelled + len(letters)] = letters
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        begin = self.spelled + np.cumsum(sizes) - sizes
        self.spelled += len(letters)
        order = np.argsort(both := np.concatenate([self.hashes, hashes]), kind="stable")
        self.hashes = both[order]
        for name, new in (("start", start), ("size", size), ("begin", begin), ("long", sizes)):
            setattr(self, name, np.concatenate([getattr(self, name), new])[order])

    def encode_all(self, texts: pa.Array) -> list[bytes]:
        raw, offsets = utf8(texts)
        begins, ends = word_bounds(raw, offsets)
        data, sizes = Bytes(raw), ends - begins
        one, example, which = np.unique(hash_words(data, begins, ends), return_index=True, return_inverse=True)
        start, size = self._places(one, data, begins[example], sizes[example])
        like = example[which]
        strange = np.flatnonzero(sizes != sizes[like])
        alike = np.flatnonzero(sizes == sizes[like])
        strange = np.concatenate([strange, alike[~equal_words(data, begins[alike], data, begins[like[alike]], sizes[alike])]])
        many = size[which].astype(np.int64)
        done = np.cumsum(many)
        ids = self.pool[np.repeat(start[which] - (done - many), many) + np.arange(int(done[-1]) if len(done) else 0)].astype("<u4")
        bounds = np.concatenate([[0], done])[np.searchsorted(begins, offsets)]
        out = [ids[i:j].tobytes() for i, j in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
        again = set((np.searchsorted(offsets, begins[strange], "right") - 1).tolist())
        letters = raw.tobytes()
        if any(s.encode() in letters for s in self.special):
            again |= {i for i, t in enumerate(texts.to_pylist()) if t and any(s in t for s in self.special)}
        for i in again:
            out[i] = self._whole(texts[i].as_py())
        return out


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def pieces(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32."""
    bounded_batches(docs.sparkSession, 512)
    path, end = tokenizer or default_tokenizer(), np.array([END_ID], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encoder = WordEncoder.of(path)
        for batch in sliced(batches, 512):
            ids, piece, start, length, crc = [], [], [], [], []
            for doc, tokens in zip(batch.column("doc_id").to_pylist(), encoder.encode_all(batch.column("text"))):
                tokens += end
                for k, at in enumerate(range(0, len(tokens), 4 * capacity)):
                    part = tokens[at : at + 4 * capacity]
                    ids.append(doc), piece.append(k), start.append(at // 4), length.append(len(part) // 4), crc.append(zlib.crc32(part))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


@dataclass
class Plan:
    """Rows sorted by length and first rank: pieces of ``length`` with ranks from ``first`` on go to sequences from ``sequence`` on, at ``offset``."""

    length: np.ndarray
    first: np.ndarray
    sequence: np.ndarray
    offset: np.ndarray
    sequences: int

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        bounds = np.searchsorted(self.length, length, "left"), np.searchsorted(self.length, length, "right")
        row = np.empty(len(length), np.int64)
        for L in np.unique(length):
            at = np.flatnonzero(length == L)
            lo, hi = bounds[0][at[0]], bounds[1][at[0]]
            row[at] = lo + np.searchsorted(self.first[lo:hi], rank[at], "right") - 1
        return self.sequence[row] + rank - self.first[row], self.offset[row]


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> Plan:
    """Best-fit decreasing over a histogram; a group is (first sequence, how many) of one filling level."""
    free: dict[int, list[tuple[int, int]]] = {}  # by the room that is left
    rooms = np.zeros(capacity + 1, bool)
    rows, used = [], 0
    for length in sorted((n for n, c in counts.items() if c), reverse=True):
        left, rank = counts[length], 0
        while left:
            fits = np.flatnonzero(rooms[length:])
            if len(fits):
                room = length + int(fits[0])
                first, many = free[room].pop()
                if not free[room]:
                    rooms[room] = False
            else:
                room, each = capacity, capacity // length
                first, many = used, -(-left // each)
                used += many
            take = min(room // length, left)  # pieces of this length that one of these sequences gets
            whole = min(many, left // take)
            if whole < many:
                free.setdefault(room, []).append((first + whole, many - whole))
                rooms[room] = True
            for k in range(take):
                rows.append((length, rank, first, capacity - room + k * length))
                rank += whole
            left -= take * whole
            rest = room - take * length
            if rest:
                free.setdefault(rest, []).append((first, whole))
                rooms[rest] = True
    rows.sort()
    table = np.array(rows, np.int64).reshape(-1, 4)
    return Plan(*table.T, used)


def pack(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    done = cut(pieces(docs, tokenizer, capacity))
    cells = np.ones(capacity + 1, np.int64)
    for r in done.groupBy("length").count().collect():
        cells[r.length] = -(-r["count"] // CELL_PIECES)
    first_cell = np.cumsum(cells) - cells
    # pieces without id are told apart by where they stand in the checkpoint
    spread = F.xxhash64(F.coalesce("doc_id", F.monotonically_increasing_id()), "piece", "start")
    ranked = done.withColumn("cell", F.pmod(spread, F.get(F.lit(cells), F.col("length").cast("int"))))
    order = Window.partitionBy("length", "cell").orderBy("doc_id", "piece", "ids_crc32")
    sizes = np.zeros(int(cells.sum()), np.int64)
    for r in ranked.groupBy("length", "cell").count().toLocalIterator():
        sizes[first_cell[r.length] + r.cell] = r["count"]
    upto = np.cumsum(sizes) - sizes
    before = upto - np.repeat(upto[first_cell], cells)
    counts = {length: int(many) for length, many in enumerate(np.add.reduceat(sizes, first_cell)) if many}
    made = plan(counts, capacity)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = np.asarray(batch.column("length"))
            rank = before[first_cell[length] + np.asarray(batch.column("cell"))] + np.asarray(batch.column("r")) - 1
            sequence, offset = made.place(length, rank)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")), pa.array(sequence), pa.array(offset)], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    bounded_batches(docs.sparkSession, 5000)
    placed = ranked.withColumn("r", F.row_number().over(order).cast("long"))
    return placed.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
