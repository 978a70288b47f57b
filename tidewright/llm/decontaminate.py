"""Benchmark decontamination by templates: passages of benchmark items are found though re-parameterised.

Texts are canonicalised token by token: numbers (in digits or words), units after numbers and names
(capitalised inside a sentence) become typed placeholders, other words are lower-cased without outer
punctuation. Windows
of ``WIDTH`` template tokens are joined by hash with the windows of the benchmark items. A matched
window counts if its slots are consistent: over all matched windows of one alignment of a document
with an item, equal slot values of the item stand for equal values of the document, and different for
different ones, within a type. A changed value that is at odds with another costs the windows that
hold it and no others, so windows that are literally equal always count.

Each window is also read word for word, which finds verbatim copies that templates can not tell: windows
with fewer than half literal tokens, and whole items too short for a template. A window is read a
third time if its first word is capitalised: as a name if it begins a sentence, else as a word.
All windows make a leak; ``n_windows`` are those equal by template, as in the SQL, and for an item that
has none of them all its windows.

The index of benchmark windows goes to every task if it has at most ``INDEX_WINDOWS`` windows, which
is counted first; a larger benchmark is joined by Spark on window hashes instead, with equal results.

Defined results: null and empty texts have no tokens; an item shorter than a window is one window of
its own length; an item of fewer than ``LEAST_TOKENS`` tokens, and a window with fewer than half literal
tokens, match only word for word; repeated rows give equal results; a null id of an item or of a
document counts as an id; ``leaks`` ignores other columns and counts the rows of one doc_id as one
document; ``without_leaks`` keeps all columns and judges each row by its own text.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.llm.common import bounded_batches, cut, mix, sliced

WIDTH = 10
LEAST_TOKENS = 5
#: Matched windows that make a leak.
LEAST_WINDOWS = 1
#: Benchmark windows that may be sent to every task.
INDEX_WINDOWS = 200_000
#: Entries of the cache of tokens in one Python worker.
CACHE_ENTRIES = 500_000

#: Units of measurement.
UNITS = set("mm cm m km in inch inches ft foot feet yd yard yards mi mile miles mg g kg t lb lbs oz ml cl l s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years ms % percent usd eur gbp dollar dollars euro euros cent cents pound pounds degree degrees °c °f k w kw kwh v a hz khz mhz ghz b kb mb gb tb mph kph km/h m/s litre litres liter liters gram grams kilogram kilograms metre metres meter meters kilometre kilometres kilometer kilometers".split())

#: Numbers in words; those from 21 to 99 come from the rule below.
_TENS, _ONES = "twenty thirty forty fifty sixty seventy eighty ninety".split(), "one two three four five six seven eight nine".split()
NUMBER_WORDS = {*_TENS, *_ONES, *"zero ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen hundred thousand million billion".split()} | {f"{t}-{o}" for t in _TENS for o in _ONES}

_NUMBER = re.compile(r"[+-]?[$€£]?\d[\d.,:/]*(?:st|nd|rd|th)?")
_NUMBER_UNIT = re.compile(r"([+-]?\d[\d.,]*)([^\W\d_]+|%|°[cf])", re.I)
_OUTER = " \t.,;:!?\"'()[]{}<>|*#&$%“”‘’«»…-–—"
WORD_KIND, NUMBER_KIND, UNIT_KIND, NAME_KIND = range(4)
_PLACEHOLDERS = mix(np.arange(101, 105, dtype=np.uint64))


_FACTOR = np.uint64(0xD1342543DE82EF95)


def _hash(s: str) -> int:
    return xxhash.xxh64_intdigest(s.encode())


_ROW = np.dtype([("v", np.uint64), ("f", np.int64), ("g", np.uint64)])


class _Lexicon(dict):
    """What a white-space-separated token is: its row in ``table``, of its value's hash, flags, and the hash of a unit glued on."""

    def __init__(self):
        super().__init__()
        self.known, self.fresh = np.empty(0, _ROW), []

    def table(self) -> np.ndarray:
        if self.fresh:
            self.known = np.concatenate([self.known, np.array(self.fresh, _ROW)])
            self.fresh = []
        return self.known

    def __missing__(self, token: str) -> int:
        core = token.strip(_OUTER)
        low = core.lower()
        glued = 0
        if not core:
            flags = 1  # no token
        elif low in UNITS:
            flags = 4
        elif low in NUMBER_WORDS:
            flags = 2
        elif core.isalpha():
            flags = 8 if core[0].isupper() and core[1:].islower() else 0
        elif _NUMBER.fullmatch(core):
            flags = 2
        elif (m := _NUMBER_UNIT.fullmatch(core)) and m[2].lower() in UNITS:
            flags, low, glued = 2 | 16, m[1], _hash(m[2].lower())
        else:
            flags = 8 if core[0].isupper() and core[1:].islower() else 0
        if token[-1] in ".!?:":
            flags |= 32  # ends a sentence
        row = len(self)
        self.fresh.append((_hash(low), flags, glued))
        self[token] = row
        return row


_lexicon = _Lexicon()


@dataclass
class Template:
    """Tokens of texts one after another."""

    symbol: np.ndarray
    value: np.ndarray
    kind: np.ndarray
    turned: np.ndarray  # the kind of a capitalised word at the other place in a sentence; of other tokens their own
    first: np.ndarray  # first token of each text


def _symbols(value: np.ndarray, kind: np.ndarray) -> np.ndarray:
    return np.where(kind == WORD_KIND, value, _PLACEHOLDERS[kind])


def template(texts: list[str | None]) -> Template:
    global _lexicon
    if len(_lexicon) > CACHE_ENTRIES:
        _lexicon = _Lexicon()
    split = [t.split() if t else [] for t in texts]
    sizes = np.array([len(s) for s in split], np.int64)
    rows = np.fromiter(map(_lexicon.__getitem__, chain.from_iterable(split)), np.int64, int(sizes.sum()))
    table = _lexicon.table()
    value, flags = table["v"][rows], table["f"][rows]
    doc = np.repeat(np.arange(len(texts)), sizes)
    glue = np.flatnonzero(flags & 16)
    if len(glue):  # "5km" is a number and a unit
        value, flags, doc = np.insert(value, glue + 1, table["g"][rows[glue]]), np.insert(flags & ~16, glue + 1, 64 | (flags[glue] & 32)), np.insert(doc, glue + 1, doc[glue])
    real = (flags & 1) == 0
    begins = np.ones(len(flags), bool)
    begins[1:] = ((flags[:-1] & 32) != 0) | (doc[1:] != doc[:-1])
    value, flags, doc, begins = value[real], flags[real], doc[real], begins[real]
    number = (flags & 2) != 0
    after = np.zeros(len(flags), bool)
    after[1:] = number[:-1] & (doc[1:] == doc[:-1])
    kind = np.zeros(len(flags), np.int64)
    kind[((flags & 8) != 0) & ~begins] = NAME_KIND
    kind[(((flags & 4) != 0) & after) | ((flags & 64) != 0)] = UNIT_KIND
    kind[number] = NUMBER_KIND
    turned = np.where((flags & 8) != 0, np.where(kind == NAME_KIND, WORD_KIND, NAME_KIND), kind)
    first = np.searchsorted(doc, np.arange(len(texts) + 1))
    return Template(_symbols(value, kind), value, kind, turned, first)


def _rolling(symbol: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of ``width`` symbols, before ``mix``."""
    n = len(symbol) - width + 1
    v, h = mix(symbol + np.uint64(width)), np.zeros(n, np.uint64)
    for k in range(width):
        h *= _FACTOR
        h += v[k : k + n]
    return h


def _windows(t: Template, width: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, bool, np.ndarray]]:
    """(start, hash, by template, word for word, kinds of all tokens) of the windows of whole texts, by reading.

    Word for word all windows are read; by template those with a slot and enough literal tokens, as
    without a slot both are one; those that begin with a capitalised word once more, with that word turned.
    """
    n = len(t.value) - width + 1
    if n <= 0:
        return
    doc = np.repeat(np.arange(len(t.first) - 1), np.diff(t.first))
    whole = doc[:n] == doc[width - 1 :]
    exact = _rolling(t.value, width)
    literal = np.concatenate([[0], np.cumsum(t.kind == WORD_KIND)])
    words = literal[width:] - literal[:n]
    at = np.flatnonzero(whole)
    yield at, mix(exact[at]), (words[at] == width) & (width >= LEAST_TOKENS), True, t.kind
    if width < LEAST_TOKENS:
        return
    typed = exact if (t.kind == WORD_KIND).all() else _rolling(t.symbol, width)
    at = np.flatnonzero(whole & (words < width) & (2 * words >= width))
    yield at, mix(typed[at]), np.ones(len(at), bool), False, t.kind
    words = words - (t.kind[:n] == WORD_KIND) + (t.turned[:n] == WORD_KIND)
    at = np.flatnonzero(whole & (t.turned[:n] != t.kind[:n]) & (words < width) & (2 * words >= width))
    step = mix(_symbols(t.value[at], t.turned[at]) + np.uint64(width)) - mix(t.symbol[at] + np.uint64(width))
    yield at, mix(typed[at] + step * np.uint64(pow(int(_FACTOR), width - 1, 2**64))), np.zeros(len(at), bool), False, t.turned


@dataclass
class Index:
    """Benchmark windows: where each hash occurs, and the slots of each item."""

    places: dict[int, list[tuple[int, int, bool, bool]]] = field(default_factory=lambda: defaultdict(list))  # hash -> (item's row, start, by template, first word turned)
    items: list[tuple[int | None, np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)  # id, values, kinds, turned kinds
    widths: set[int] = field(default_factory=set)
    hashes: np.ndarray = field(default_factory=lambda: np.empty(0, np.uint64))

    @classmethod
    def of(cls, items: list[tuple[int | None, str | None]], width: int) -> "Index":
        out = cls()
        for item, text in items:
            t = template([text])
            if not len(t.value):
                continue
            w = min(width, len(t.value))
            out.widths.add(w)
            out.items.append((item, t.value, t.kind, t.turned))
            for at, h, typed, _, kinds in _windows(t, w):
                for start, key, plain in zip(at.tolist(), h.tolist(), typed.tolist()):
                    out.places[key].append((len(out.items) - 1, start, plain, kinds is t.turned))
        out.places = dict(out.places)
        out.hashes = np.sort(np.array(list(out.places), np.uint64))
        return out

    def sieve(self) -> np.ndarray:
        """Which last bits the hashes have, to let most others pass by."""
        out = np.zeros(2 ** min(22, max(16, (64 * len(self.hashes)).bit_length())), bool)
        out[self.hashes & np.uint64(len(out) - 1)] = True
        return out

    def known(self, h: np.ndarray, sieve: np.ndarray) -> np.ndarray:
        """Where hashes of the index are."""
        if not len(self.hashes):
            return np.empty(0, np.int64)
        near = np.flatnonzero(sieve[h & np.uint64(len(sieve) - 1)])
        place = np.minimum(np.searchsorted(self.hashes, h[near]), len(self.hashes) - 1)
        return near[self.hashes[place] == h[near]]


def _sound(windows: list[set[tuple[int, int, int]]]) -> list[bool]:
    """Whether each window of one alignment, given its (kind, value of the item, value of the document), holds no changed value at odds with another."""
    pairs = set().union(*windows)
    theirs, ours = Counter((k, a) for k, a, _ in pairs), Counter((k, b) for k, _, b in pairs)
    odd = {(k, a, b) for k, a, b in pairs if a != b and (theirs[k, a] > 1 or ours[k, b] > 1)}
    return [odd.isdisjoint(w) for w in windows]


def _matches(texts: list[str | None], index: Index, least: int, sieve: np.ndarray) -> Iterator[tuple[int, int | None, int]]:
    """(place of the text, item_id, matched windows) of the leaks in a batch."""
    t = template(texts)
    # by alignment, its windows: equal by template, only with the item's first word turned
    found: dict[tuple[int, int, int], dict[tuple[int, int, int], tuple[bool, bool]]] = defaultdict(dict)
    for width in sorted(index.widths):
        for at, h, typed, _, _ in _windows(t, width):
            hit = index.known(h, sieve)
            docs = np.searchsorted(t.first, at[hit], "right") - 1
            for start, doc, key, plain in zip(at[hit].tolist(), docs.tolist(), h[hit].tolist(), typed[hit].tolist()):
                for row, begin, also, turned in index.places[key]:
                    windows = found[doc, row, start - begin]
                    before = windows.get((start, begin, width), (False, True))
                    windows[start, begin, width] = before[0] or (plain and also), before[1] and turned
    counts: dict[tuple[int, int], list[int]] = defaultdict(lambda: [0, 0])
    for (doc, row, _), windows in found.items():
        _, values, kinds, others = index.items[row]
        slots = []
        for (s, b, w), (_, turned) in windows.items():
            own = [int(others[b]) if turned else int(kinds[b]), *kinds[b + 1 : b + w].tolist()]
            slots.append({(k, int(values[b + i]), int(t.value[s + i])) for i, k in enumerate(own) if k != WORD_KIND})
        sound = _sound(slots)
        counts[doc, row][0] += sum(sound)
        counts[doc, row][1] += sum(ok and plain for ok, (plain, _) in zip(sound, windows.values()))
    for (doc, row), (n, typed) in sorted(counts.items()):
        if n and n >= least:
            yield doc, index.items[row][0], typed or n


def _by_index(docs: DataFrame, index: Index, least: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sieve = index.sieve()
        for batch in sliced(batches):
            rows = list(_matches(batch.column("text").to_pylist(), index, least, sieve))
            yield pa.RecordBatch.from_arrays([batch.column("row").take(pa.array([r[0] for r in rows], pa.int64())), *(pa.array([r[i] for r in rows], pa.int64()) for i in (1, 2))], names=["row", "item_id", "n_windows"])

    return docs.mapInArrow(run, "row long, item_id long, n_windows long")


def _clean_by_index(docs: DataFrame, index: Index, least: int) -> DataFrame:
    text = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sieve = index.sieve()
        for batch in sliced(batches):
            keep = np.ones(batch.num_rows, bool)
            keep[[r[0] for r in _matches(batch.column(text).to_pylist(), index, least, sieve)]] = False
            yield batch.filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)


def _emit_windows(widths: list[int] | None, width: int):
    """Rows (row, key, start, width, hash, typed, exact, turned, slots) for the join by Spark, of documents if there are widths, else of items.

    Slots are (place, kind, value) flattened; a document's window read word for word needs none, as it has the item's.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            t = template(batch.column("text").to_pylist())
            ids, sizes = list(zip(batch.column("row").to_pylist(), batch.column("key").to_pylist())), np.diff(t.first)
            values = t.value.view(np.int64)
            out: list[tuple] = []
            for w in widths or range(1, width + 1):
                for at, h, typed, exact, kind in _windows(t, w):
                    doc = np.searchsorted(t.first, at, "right") - 1
                    # an item's own windows have one width: the whole item, if it is shorter
                    keep = np.ones(len(at), bool) if widths else (np.minimum(sizes[doc], width) == w)
                    for start, d, key, plain in zip(at[keep].tolist(), doc[keep].tolist(), h[keep].view(np.int64).tolist(), typed[keep].tolist()):
                        kinds = [int(kind[start]), *t.kind[start + 1 : start + w].tolist()]
                        slots = [] if exact and widths else [x for k, c in enumerate(kinds) if c for x in (k, c, int(values[start + k]))]
                        out.append((*ids[d], start - int(t.first[d]), w, key, plain, exact, kind is t.turned, slots))
            columns = list(zip(*out)) or [()] * 9
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.bool_(), pa.list_(pa.int64())))], names=["row", "key", "start", "width", "hash", "typed", "exact", "turned", "slots"])

    return run


_EMITTED = "row long, key long, start long, width long, hash long, typed boolean, exact boolean, turned boolean, slots array<long>"


def _judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (row, key, item_id, item_key, n, typed) of alignments with their windows' slots."""
    for batch in batches:
        n, typed = [], []
        for windows in batch.column("windows").to_pylist():
            sound = _sound([{(t[i + 1], t[i + 2], o[i + 2]) for t, o in [(w["theirs"], w["slots"])] for i in range(0, len(t), 3)} for w in windows])
            n.append(sum(sound))
            typed.append(sum(ok and w["typed"] for ok, w in zip(sound, windows)))
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("row", "key", "item_id", "item_key")), pa.array(n, pa.int64()), pa.array(typed, pa.int64())], names=["row", "key", "item_id", "item_key", "n", "typed"])


def _by_join(docs: DataFrame, items: DataFrame, width: int, least: int) -> DataFrame:
    """(row, key, item_id, n_windows); rows of one id are told apart by ``key``, a hash of their text."""
    docs, items = (df.select("row", "text", F.xxhash64("text").alias("key")) for df in (docs, items))
    theirs = cut(items.mapInArrow(_emit_windows(None, width), _EMITTED))
    widths = sorted(r.width for r in theirs.select("width").distinct().collect())  # at most ``width`` values
    ours = docs.mapInArrow(_emit_windows(widths, width), _EMITTED) if widths else docs.sparkSession.createDataFrame([], _EMITTED)
    b = theirs.select(F.col("row").alias("item_id"), F.col("key").alias("item_key"), F.col("start").alias("begin"), "hash", F.col("typed").alias("also"), F.col("turned").alias("theirs_turned"), F.col("slots").alias("theirs"))
    joined = ours.join(b, "hash").withColumn("shift", F.col("start") - F.col("begin")).withColumn("slots", F.when(F.col("exact"), F.col("theirs")).otherwise(F.col("slots")))
    keys = ["row", "key", "item_id", "item_key"]
    # a window that is read in two ways counts once, with the item's first word as it stands if it can
    joined = joined.groupBy(*keys, "shift", "start").agg(F.min_by(F.struct("theirs", "slots"), "theirs_turned").alias("read"), F.max(F.col("typed") & F.col("also")).alias("typed"))
    # the windows of one alignment are as many as the item's tokens at most
    aligned = joined.groupBy(*keys, "shift").agg(F.collect_list(F.struct("read.theirs", "read.slots", "typed")).alias("windows"))
    good = aligned.mapInArrow(_judge, "row long, key long, item_id long, item_key long, n long, typed long")
    counted = good.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("typed").alias("typed")).where((F.col("n") > 0) & (F.col("n") >= least))
    return counted.select("row", "key", "item_id", F.when(F.col("typed") > 0, F.col("typed")).otherwise(F.col("n")).alias("n_windows"))


def _items(benchmark: DataFrame) -> DataFrame:
    return benchmark.select(F.col("item_id").cast("long").alias("row"), "text")


def _index(benchmark: DataFrame, width: int, index_windows: int) -> Index | None:
    """The index of the items' windows if there are at most ``index_windows``."""
    items = _items(benchmark)
    # an item has no more windows than its text has white space and one
    bound = items.agg(F.sum(F.length(F.coalesce("text", F.lit("")))), F.count("*")).first()
    if (bound[0] or 0) / 2 + bound[1] > index_windows:
        return None
    return Index.of([(r.row, r.text) for r in items.collect()], width)


def leaks(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, least: int = LEAST_WINDOWS, index_windows: int = INDEX_WINDOWS) -> DataFrame:
    """One row per contaminated document: doc_id, n_windows, items (ids, ascending, comma-joined)."""
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("row"), "text")
    index = _index(benchmark, width, index_windows)
    found = _by_join(rows, _items(benchmark), width, least) if index is None else _by_index(rows, index, least)
    # a repeated document has its items and windows once
    once = found.groupBy("row", "item_id").agg(F.max("n_windows").alias("n"))
    listed = F.array_join(F.transform(F.array_sort(F.collect_list("item_id")), lambda x: x.cast("string")), ",")
    return once.groupBy(F.col("row").alias("doc_id")).agg(F.sum("n").alias("n_windows"), listed.alias("items"))


def without_leaks(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, least: int = LEAST_WINDOWS, index_windows: int = INDEX_WINDOWS) -> DataFrame:
    """The rows in whose text no benchmark item is found, with their own columns."""
    bounded_batches(docs.sparkSession)
    index = _index(benchmark, width, index_windows)
    if index is not None:
        return _clean_by_index(docs, index, least)
    id_, key = F.col("doc_id").cast("long"), F.xxhash64("text")
    found = cut(_by_join(docs.select(id_.alias("row"), "text"), _items(benchmark), width, least).select("row", F.col("key").alias("leaking")).distinct())
    return docs.join(found, id_.eqNullSafe(found["row"]) & (key == found["leaking"]), "left_anti")
