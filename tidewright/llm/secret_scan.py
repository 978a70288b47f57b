"""Secret scans: three fixed patterns, and character Markov models for strings without a pattern.

Two second-order character models are trained, one on labelled random strings (keys drawn from
the alphabets that credentials use) and one on labelled ordinary identifiers (words of the corpus,
alone and joined as identifiers are). A run of credential characters is reported as ``markov`` if
its log-likelihood ratio, random against ordinary, is high enough in total and per character.

Defined results: a null text counts as empty and has no span; repeated rows give repeated rows;
an empty table gives an empty result; other columns are ignored by ``scan`` and kept by ``redact``.
Positions are code points, ends exclusive. Whole texts are scanned, however long.
"""

from __future__ import annotations

import builtins
import hashlib
import keyword
import random
import re
import string
import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.llm.common import bounded_batches, chosen, sliced, utf8, words_of

#: The base patterns, in the order that breaks ties, and their shortest accepted lengths.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
ASSIGN_LEAST, ACCESS_LEAST = 6, 20
KINDS = ("assign", "access", "hex", "markov")
CANDIDATE_CHARS = string.ascii_letters + string.digits + "+/_=-"
#: The shortest of the random strings that the model is trained on.
CANDIDATE_LEAST = 16
CANDIDATE = re.compile(rf"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{{{CANDIDATE_LEAST},}}")

#: The identifiers are at most so many words of about so many documents; the random strings are so many.
SAMPLE_DOCUMENTS = 2000
SAMPLE_WORDS = 20_000
SAMPLE_STRINGS = 4000
#: Least log-likelihood ratio in nats: of the whole run, and per character.
LEAST_TOTAL = 12.0
LEAST_PER_CHARACTER = 0.4

_ALPHABETS = ("0123456789abcdef", "0123456789ABCDEF", string.ascii_lowercase + string.digits, string.ascii_letters + string.digits, string.ascii_letters + string.digits + "+/", string.ascii_letters + string.digits + "_-")
_CODE = np.full(128, 0, np.int64)
for _i, _c in enumerate(CANDIDATE_CHARS):
    _CODE[ord(_c)] = _i + 1
_SIZE = len(CANDIDATE_CHARS) + 1
_IN_CLASS = np.zeros(256, bool)
_IN_CLASS[[ord(c) for c in CANDIDATE_CHARS]] = True


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the base patterns, in order."""
    found = []
    if "=" in text or ":" in text:
        found += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
    found += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


def _codes(s: str) -> np.ndarray:
    return _CODE[np.frombuffer(s.encode("ascii"), np.uint8)]


@dataclass
class MarkovRatio:
    """log P(c | two before, random) - log P(c | two before, ordinary), for every trigram."""

    ratio: np.ndarray

    @classmethod
    def train(cls, random_strings: list[str], ordinary: list[str], smoothing: float = 0.1) -> "MarkovRatio":
        return cls((_log_model(random_strings, smoothing) - _log_model(ordinary, smoothing)).astype(np.float32))

    def score(self, s: str) -> float:
        c = np.concatenate([[0, 0], _codes(s)])
        return float(self.ratio[c[:-2], c[1:-1], c[2:]].sum())

    def accepts(self, s: str) -> bool:
        total = self.score(s)
        return total >= LEAST_TOTAL and total >= LEAST_PER_CHARACTER * len(s)


def _log_model(strings: list[str], smoothing: float) -> np.ndarray:
    """Trigram counts backed off to bigrams and characters, as log probabilities."""
    counts = np.zeros((_SIZE, _SIZE, _SIZE))
    for s in strings:
        c = np.concatenate([[0, 0], _codes(s)])
        np.add.at(counts, (c[:-2], c[1:-1], c[2:]), 1)
    one = counts.sum((0, 1)) + smoothing
    one /= one.sum()
    two = counts.sum(0) + 4 * one
    two /= two.sum(1, keepdims=True)
    three = counts + 4 * two[None]
    return np.log(three / three.sum(2, keepdims=True))


def random_strings(n: int = SAMPLE_STRINGS, seed: int = 20) -> list[str]:
    """Labelled sample of random strings."""
    draw = random.Random(seed)
    return ["".join(draw.choices(_ALPHABETS[i % len(_ALPHABETS)], k=draw.randint(CANDIDATE_LEAST, 64))) for i in range(n)]


def identifiers(words: list[str], seed: int = 21) -> list[str]:
    """Labelled sample of ordinary identifiers: words and the names of Python's own library, alone and joined in the usual styles, and plain numbers."""
    draw = random.Random(seed)
    names = {n.strip("_") for n in [*dir(builtins), *dir(str), *dir(random), *sys.stdlib_module_names, *keyword.kwlist]}
    words = [*words, *sorted(n for n in names if n.isascii() and len(n) > 1)]
    out = list(words)
    for i in range(min(20_000, 4 * len(words))):
        parts = draw.choices(words, k=draw.randint(2, 4))
        style = i % 6
        out.append("_".join(p.lower() for p in parts) if style == 0 else "-".join(p.lower() for p in parts) if style == 1 else "".join(p.title() for p in parts) if style == 2 else "/".join(parts) if style == 3 else "_".join(p.upper() for p in parts) if style == 4 else f"{parts[0]}_{draw.randint(0, 2100)}")
    out += [str(draw.randint(0, 10**16)) for _ in range(3000)]
    return out


def train(docs: DataFrame, documents: int = SAMPLE_DOCUMENTS, words: int = SAMPLE_WORDS) -> MarkovRatio:
    """Fit both models; the identifiers are at most ``words`` distinct words of about ``documents`` documents, chosen by hashes."""
    n = docs.count()
    share = min(1.0, documents / n) if n else 1.0
    some = docs.where(F.col("text").isNotNull() & chosen("text", share))
    word = F.explode(words_of(F.col("text")))
    rows = some.select(word.alias("word")).select(F.rtrim("word", F.lit(".,;:!?")).alias("word")).where(F.col("word").rlike("^[A-Za-z]{2,}$")).distinct().orderBy(F.xxhash64("word"), "word").limit(words).collect()
    return MarkovRatio.train(random_strings(), identifiers([r.word for r in rows]))


def _outside(start: int, end: int, base: list) -> Iterator[tuple[int, int]]:
    """What base spans, in order, leave of a run, if it is long enough."""
    for s, e, _ in [*base, (end, end, "")]:
        if start < end and e > start and s <= end:
            if s - start >= CANDIDATE_LEAST:
                yield start, s
            start = max(start, e)


def spans_of(text: str, model: MarkovRatio) -> tuple[list, list]:
    """(base spans, all spans); of a candidate that meets base spans what is left on either side is judged alone."""
    base = base_spans(text)
    more = [(s, e, "markov") for m in CANDIDATE.finditer(text) for s, e in _outside(m.start(), m.end(), base) if model.accepts(text[s:e])]
    return base, sorted(base + more, key=lambda s: (s[0], KINDS.index(s[2])))


def _suspects(column: pa.Array) -> np.ndarray:
    """Which texts can hold a span at all: they have a long run of candidate characters, or an assignment's sign."""
    raw, offsets = utf8(column)
    out = np.zeros(len(column), bool)
    if not len(raw):
        return out
    inside = np.concatenate([[False], _IN_CLASS[raw], [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts = edges[::2][np.diff(edges)[::2] >= CANDIDATE_LEAST]
    signs = np.flatnonzero((raw == ord("=")) | (raw == ord(":")))
    # a run may cross from one text into the next; such a text is only looked at in vain, but both must be
    out[np.searchsorted(offsets, starts, "right") - 1] = True
    nexts = np.searchsorted(offsets, starts + CANDIDATE_LEAST, "right") - 1
    out[np.minimum(nexts, len(out) - 1)] = True
    bounds = offsets[1:-1]
    crossing = bounds[(bounds > 0) & (bounds < len(raw))]
    crossing = crossing[_IN_CLASS[raw[crossing - 1]] & _IN_CLASS[raw[crossing]]]
    for at in crossing:
        k = int(np.searchsorted(offsets, at, "right")) - 1
        out[max(k - 1, 0) : k + 1] = True
    out[np.searchsorted(offsets, signs, "right") - 1] = True
    return out


def _joined(spans: list) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


def scan(docs: DataFrame, model: MarkovRatio | None = None) -> DataFrame:
    """Per document: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_markov."""
    spark = docs.sparkSession
    bounded_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    model = model or train(docs)
    nothing = hashlib.sha256(b"").hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            n, texts = batch.num_rows, batch.column("text")
            counts = {k: np.zeros(n, np.int64) for k in KINDS}
            digests, spans = [nothing] * n, [""] * n
            for i in np.flatnonzero(_suspects(texts)):
                base, every = spans_of(texts[int(i)].as_py() or "", model)
                for _, _, kind in every:
                    counts[kind][i] += 1
                digests[i], spans[i] = hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(every)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(counts[k]) for k in KINDS[:3]), pa.array(digests, pa.string()), pa.array(spans, pa.string()), pa.array(counts["markov"])],
                names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_markov"],
            )

    return docs.mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_markov long")


def redact(docs: DataFrame, model: MarkovRatio | None = None, mark: str = "[SECRET]") -> DataFrame:
    """The same rows and columns; each span of a text is replaced by ``mark``, overlapping spans by one."""
    bounded_batches(docs.sparkSession)
    model = model or train(docs.select("text"))
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            texts = batch.column(at)
            suspects = _suspects(texts)
            if suspects.any():
                new = texts.to_pylist()
                for i in np.flatnonzero(suspects):
                    if new[i]:
                        new[i] = _masked(new[i], spans_of(new[i], model)[1], mark)
                batch = batch.set_column(at, batch.schema.field(at), pa.array(new, texts.type))
            yield batch

    return docs.mapInArrow(run, docs.schema)


def _masked(text: str, spans: list, mark: str) -> str:
    out, done = [], 0
    for start, end, _ in spans:
        if start >= done:
            out += [text[done:start], mark]
        done = max(done, end)
    return "".join(out) + text[done:]
