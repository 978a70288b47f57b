"""HTML extraction by the maximum-scoring subsequence of words and tags.

A page is read as one sequence of tokens: words and tags. Each token has a weight, learned from
labelled pages as the log-odds of lying inside the main region rather than outside it: a word's by
the element that it stands in, a tag's by its name; a tag's is negative always, ``TAG_MOST`` at most.
One linear scan (Kadane) finds the contiguous region of the greatest total weight; its blocks, without
any boilerplate nested in it, are the text.
Boilerplate are some elements by name, and those whose class, id or role has a word for it if their
own words, by weights learned under such marks, are worth nothing; never html, body and what encloses
the whole region.

Labelled pages are those that mark their main region themselves with ``<article>`` or ``<main>``;
about ``SAMPLE_PAGES`` different ones, chosen by a hash, train the weights. That markup is never a token
itself, so pages without it are judged alike. With no labelled page the prior weights stand.

Defined results: a null or empty html gives an empty text; a page without words too; repeated rows
give repeated rows; other columns are ignored; whole pages are read, however long or deeply nested, in
linear time. Of broken markup the least is lost: an element that is never closed holds what follows,
but a script or another opaque element that is never closed ends at the next tag; a tag whose quote is
never closed ends at its first ``>``, a comment that is never closed likewise; an unknown name after
``<`` without any ``>`` is text. Of regions that weigh the same the first one found counts.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.llm.common import bounded_batches, chosen, sliced

#: About so many labelled pages train the weights.
SAMPLE_PAGES = 1000
#: Weight of a word, of a tag and of a tag inside running text before any labelled page is seen, and how many tokens that is worth.
WORD_PRIOR, TAG_PRIOR, TEXT_TAG_PRIOR, PRIOR_TOKENS = 1.0, -3.25, -1.0, 8.0
WEIGHT_LIMIT = 6.0
#: The most that a tag may weigh.
TAG_MOST = -0.1

#: Element names.
OPAQUE = "script style noscript template iframe svg object textarea select option title".split()
BLOCKS = set("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup p pre section summary table tbody td tfoot th thead title tr ul".split())
BOILERPLATE = set("nav aside footer header form menu button dialog".split())
INLINE_CONTEXT = {"a", "label", "button"}
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
LABELS = ("article", "main")
WHOLE = ("html", "body")
BOILERPLATE_WORDS = set("ad ads advert advertisement banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer header menu nav navbar navigation newsletter notice pager pagination popup promo related respond share sidebar social sponsor sponsored subscribe widget".split())

TEXT_TAGS = set("b blockquote br code em h1 h2 h3 h4 h5 h6 i p pre span strong".split())
INLINE = set("a abbr b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())

_NAME = r"(/?)([A-Za-z][A-Za-z0-9:-]*)"
#: A value in quotes ends before a space, a slash or the tag's end; another quote is a character like any other.
_ATTRIBUTES = r"""((?:[^<>"'=]++|=\s*+(?:"[^"]*"(?=[\s/>])|'[^']*'(?=[\s/>])|)|["'])*+)"""
TOKEN = re.compile(rf"<!--|<{_NAME}{_ATTRIBUTES}>|<{_NAME}([^<>]*+)(?:>|\Z)|<[!?/][^<>]*+(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
NEXT = re.compile(r"<[A-Za-z/!?]")
CLOSERS = {name: re.compile(rf"</{name}(?![A-Za-z0-9:-])[^>]*>", re.I) for name in [*OPAQUE, "--"]} | {"--": re.compile("-->")}
_PARTS = re.compile(r"[^a-z]+")


class _Open:
    """The open elements that matter; each step costs as much as it opens or closes."""

    def __init__(self):
        self.stack: list[tuple[str, str, bool, int, str]] = []  # name, context, is boilerplate, mark and special context before it
        self.counts: dict[str, int] = {}  # open elements by name, of the innermost labelled region
        self.scopes: list[tuple[int, dict[str, int]]] = []  # where labelled regions begin in the stack, and the counts around them
        self.base = self.poor = self.mark = 0
        self.special = ""  # the innermost context that is boilerplate or marked
        self.parents: dict[int, int] = {}  # the marked element around a marked one

    def context(self) -> str:
        return self.stack[-1][1] if len(self.stack) > self.base else self.special

    def push(self, name: str, mark: int) -> None:
        poor, context = name in BOILERPLATE, name + ".x" if mark else name
        self.stack.append((name, context, poor, self.mark, self.special))
        self.counts[name] = self.counts.get(name, 0) + 1
        self.poor += poor
        if mark:
            self.parents[mark], self.mark = self.mark, mark
        if mark or poor:
            self.special = context

    def pop(self) -> str:
        name, _, poor, self.mark, self.special = self.stack.pop()
        self.counts[name] -= 1
        self.poor -= poor
        return name

    def close(self, name: str) -> None:
        if self.counts.get(name):
            while self.pop() != name:
                pass

    def enter(self) -> None:
        self.scopes.append((self.base, self.counts))
        self.base, self.counts = len(self.stack), {}

    def leave(self) -> None:
        if self.scopes:
            while len(self.stack) > self.base:
                self.pop()
            self.base, self.counts = self.scopes.pop()


Token = tuple[str, str, str, bool, bool, int]


def tokens(page: str) -> tuple[list[Token], dict[int, int]]:
    """(kind, value, context, in a labelled region, in boilerplate, innermost marked element) of each token, and the marked element around each marked one.

    Kinds: text, tag, break.
    """
    out: list[Token] = []
    open_, missing, done, size = _Open(), set(), 0, len(page)

    def emit(kind: str, value: str) -> None:
        out.append((kind, value, open_.context(), bool(open_.scopes), open_.poor > 0, open_.mark))

    def closed(name: str, after: int) -> int | None:
        """Where the closer of an opaque element or comment ends; one that is missing is missing from there on."""
        if name not in missing and (m := CLOSERS[name].search(page, after)):
            return m.end()
        missing.add(name)
        return None

    def found(m: re.Match) -> None:
        nonlocal done
        begin = m.start()
        close, name, attributes = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        name = (name or "").lower()
        if m.end() == size and page[-1] != ">" and name and not (name in BLOCKS or name in INLINE or name in VOID or name in OPAQUE):
            return  # a sign in the text
        if begin > done:
            emit("text", page[done:begin])
        done = m.end()
        if not name:
            if m[0] == "<!--":
                end = closed("--", done)
                done = end if end is not None else page.find(">", done) + 1 or done
            return
        if not close and name in CLOSERS:
            end = closed(name, done)
            if end is None:
                after = NEXT.search(page, done)
                end = after.start() if after else size
            done = end
            return
        if name in LABELS:
            emit("break", "")
            if close:
                open_.leave()
            else:
                open_.enter()
            return
        noted = name in BLOCKS or name in INLINE_CONTEXT
        if close:
            emit("tag", name)
            if noted:
                open_.close(name)
        else:
            if noted and name not in VOID:
                marks = attributes and name not in WHOLE and any(not BOILERPLATE_WORDS.isdisjoint(_PARTS.split((a[1] or a[2] or a[3] or "").lower())) for a in ATTRIBUTE.finditer(attributes))
                if name == "p" and len(open_.stack) > open_.base and open_.stack[-1][1] == "p":
                    open_.pop()
                open_.push(name, begin + 1 if marks else 0)
            emit("tag", name)
        if name in BLOCKS:
            emit("break", "")
        elif name == "br":
            emit("text", " ")

    at = 0
    while m := TOKEN.search(page, at):
        found(m)
        at = max(done, m.end())
    if done < size:
        emit("text", page[done:])
    return out, open_.parents


def features(page: str) -> Counter:
    """Counts of (feature, inside) for training; words count by context, those in marked elements once more, tags by name."""
    out: Counter = Counter()
    for kind, value, context, inside, _, mark in tokens(page)[0]:
        if kind == "text":
            if n := len(value.split()):
                out["w:" + context, inside] += n
                if mark:
                    out["m:" + context, inside] += n
        elif kind == "tag":
            out["t:" + value, inside] += 1
    return out


def _prior(feature: str) -> float:
    kind, _, name = feature.partition(":")
    poor = name.endswith(".x") or name in BOILERPLATE or name in INLINE_CONTEXT
    if kind == "t":
        return TEXT_TAG_PRIOR if name in TEXT_TAGS else TAG_PRIOR
    return -WORD_PRIOR if poor else WORD_PRIOR if kind == "w" else WORD_PRIOR / 2


def best_region(gains: list[float]) -> tuple[int, int]:
    """The contiguous range of the greatest sum, in one scan; an empty one if no sum is positive."""
    best = total = 0.0
    begin = first = last = 0
    for i, gain in enumerate(gains):
        if total <= 0:
            total, begin = 0.0, i
        total += gain
        if total > best:
            best, first, last = total, begin, i + 1
    return first, last


def _around(mark: int, parents: dict[int, int]) -> set[int]:
    out = set()
    while mark:
        out.add(mark)
        mark = parents[mark]
    return out


def _worthless(region: list[Token], parents: dict[int, int], learned: dict[str, float]) -> set[int]:
    """The marked elements whose own words are worth nothing, with all in them, but for those around the whole region."""
    worth: dict[int, float] = {}
    for kind, value, context, _, _, mark in region:
        if mark and kind == "text" and (n := len(value.split())):
            worth[mark] = worth.get(mark, 0.0) + n * learned.get("m:" + context, _prior("m:" + context))
    for mark in sorted(parents, reverse=True):  # an element's number is greater than those of the elements around it
        if mark in worth and parents[mark]:
            worth[parents[mark]] = worth.get(parents[mark], 0.0) + worth[mark]
    around = _around(region[0][5], parents) & _around(region[-1][5], parents)
    out: set[int] = set()
    for mark in sorted(parents):
        if parents[mark] in out or (mark not in around and worth.get(mark, 1.0) <= 0):
            out.add(mark)
    return out


def extract(page: str | None, learned: dict[str, float]) -> str:
    """The text of the best region: its blocks, joined by line feeds."""
    if not page:
        return ""
    seq, parents = tokens(page)
    gains = []
    for kind, value, context, _, _, _ in seq:
        if kind == "text":
            n = len(value.split())
            gains.append(n * learned.get("w:" + context, _prior("w:" + context)) if n else 0.0)
        else:
            gains.append(learned.get("t:" + value, _prior("t:" + value)) if kind == "tag" else 0.0)
    first, last = best_region(gains)
    region = seq[first:last]
    worthless = _worthless(region, parents, learned) if parents and region else ()
    blocks, block = [], []
    for kind, value, _, _, poor, mark in region:
        if kind == "text":
            if not poor and mark not in worthless:
                block.append(value)
        elif kind == "break":
            blocks.append("".join(block))
            block = []
    blocks.append("".join(block))
    clean = (" ".join(html.unescape(b).split()) for b in blocks)
    return "\n".join(b for b in clean if b)


def train(pages: DataFrame, sample: int = SAMPLE_PAGES) -> dict[str, float]:
    """Weights from a bounded sample of different labelled pages, counted on the executors."""
    labelled = pages.where(F.col("html").rlike(r"(?i)<(article|main)[\s>]")).select("html")
    n = labelled.select(F.xxhash64("html").alias("h")).distinct().count()
    some = labelled.where(chosen("html", min(1.0, sample / max(n, 1)))).dropDuplicates(["html"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            found: Counter = Counter()
            for page in batch.column(0).to_pylist():
                found.update(features(page))
            yield pa.RecordBatch.from_arrays([pa.array([f for f, _ in found], pa.string()), pa.array([i for _, i in found], pa.bool_()), pa.array(list(found.values()), pa.int64())], names=["feature", "inside", "n"])

    rows = some.mapInArrow(count, "feature string, inside boolean, n long").groupBy("feature", "inside").agg(F.sum("n").alias("n")).collect()
    return weights_of({(r.feature, r.inside): r.n for r in rows})


def weights_of(counts: dict[tuple[str, bool], int]) -> dict[str, float]:
    """Log-odds of each feature, shrunk to its prior."""
    totals = {(kind, inside): sum(n for (f, i), n in counts.items() if f[0] == kind and i == inside) for kind in "wt" for inside in (True, False)}
    out = {}
    for f in sorted({f for f, _ in counts}):
        a, b = counts.get((f, True), 0), counts.get((f, False), 0)
        of = "t" if f[0] == "t" else "w"  # marked words are words too
        rate = math.log((a + 0.5) / (totals[of, True] + 1)) - math.log((b + 0.5) / (totals[of, False] + 1))
        share = (a + b) / (a + b + PRIOR_TOKENS)
        out[f] = max(-WEIGHT_LIMIT, min(TAG_MOST if of == "t" else WEIGHT_LIMIT, share * rate + (1 - share) * _prior(f)))
    return out


def extract_pages(pages: DataFrame, learned: dict[str, float] | None = None) -> DataFrame:
    """Per page: page_id, url, text, n_chars."""
    bounded_batches(pages.sparkSession)
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    learned = train(pages) if learned is None else learned

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract(p, learned) for p in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.mapInArrow(run, "page_id long, url string, text string, n_chars long")
