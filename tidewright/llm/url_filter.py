"""URL filters: host and path rules, then a ratio of two character language models.

The rules decide the urls that they fit. Urls that a rule accepts and urls that a rule rejects train
one smoothed variable-order Markov model each (interpolated Witten-Bell, contexts of up to ``ORDER``
characters); every other url gets the verdict of the length-normalised log-likelihood difference,
against a threshold calibrated on the labelled urls that the models have not seen, every fifth of a class.

All different labelled urls count. Executors count the strings of ``ORDER`` + 1 characters, score the urls held out and
put the scores in order; the driver gets one row per different string, and tasks get the models made of them, so
these grow with the strings that labelled urls hold, not with the rows.

Defined results: a null url, or one without ``://``, has an empty host and path and fits no rule; a
null or empty url is blocked. If either class has no labelled url, every url without a rule is
allowed. Repeated rows give repeated rows; other columns are ignored; whole urls are read.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewright.functions.kernels import in_order
from tidewright.llm.common import bounded_batches, cut, sliced

#: Fixed values: (verdict, host, path prefix) of the rules.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
#: Longest context in characters; one labelled url in so many calibrates; different strings that a task counts at a time.
ORDER = 4
HELD_OUT = 5
TALLY = 200_000

LOWER = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), *LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def judge_by_rules(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits; nulls where none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r)):  # the longest is asked first
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def grams(url: str, order: int = ORDER) -> list[str]:
    """Each character of a url and its end, with the ``order`` characters before."""
    s = "\x02" * order + url + "\x03"
    return [s[i : i + order + 1] for i in range(len(s) - order)]


class CharacterModel:
    """Witten-Bell interpolation of contexts of 0 to ``order`` characters, of urls or of a tally of their ``grams``."""

    def __init__(self, urls: list[str], order: int = ORDER, tally: Iterable[tuple[str, int]] | None = None):
        self.order = order
        counts: dict[str, dict[str, int]] = defaultdict(lambda: defaultdict(int))
        totals: dict[str, int] = defaultdict(int)
        for gram, n in Counter(g for url in urls for g in grams(url, order)).items() if tally is None else tally:
            for k in range(order + 1):
                counts[gram[order - k : order]][gram[order]] += n
                totals[gram[order - k : order]] += n
        self.counts = {c: dict(n) for c, n in counts.items()}
        self.totals = dict(totals)
        self.known: dict[tuple[str, str], float] = {}

    def log(self, context: str, c: str) -> float:
        key = context, c
        if (found := self.known.get(key)) is None:
            p = 1 / 1024
            for k in range(self.order + 1):
                if (n := self.totals.get(context[len(context) - k :])) is None:
                    break
                seen = self.counts[context[len(context) - k :]]
                p = (seen.get(c, 0) + len(seen) * p) / (n + len(seen))
            found = math.log(p)
            if len(self.known) < 200_000:
                self.known[key] = found
        return found

    def mean(self, url: str) -> float:
        s, k = "\x02" * self.order + url + "\x03", self.order
        return sum(self.log(s[i - k : i], s[i]) for i in range(k, len(s))) / (len(s) - k)


class LikelihoodRatio:
    """Accepted against rejected; positive differences above the threshold allow."""

    def __init__(self, accepted: list[str], rejected: list[str], order: int = ORDER):
        self.ready = bool(accepted and rejected)
        self.threshold = 0.0
        if not self.ready:
            return
        held = [u[::HELD_OUT] for u in (accepted, rejected)]
        fit = [[u for i, u in enumerate(urls) if i % HELD_OUT] or urls for urls in (accepted, rejected)]
        self.good, self.bad = (CharacterModel(urls, order) for urls in fit)
        marked = sorted([(self.difference(u), 1 / len(held[0])) for u in held[0]] + [(self.difference(u), -1 / len(held[1])) for u in held[1]])
        wrong = best = 1.0  # of balanced errors, with everything allowed
        self.threshold = marked[0][0] - 1e-9
        for k, (score, weight) in enumerate(marked):  # block what scores up to here
            wrong += weight
            after = marked[k + 1][0] if k + 1 < len(marked) else score + 1e-9
            if after > score and wrong < best - 1e-12:
                best, self.threshold = wrong, (score + after) / 2

    @classmethod
    def of(cls, good: CharacterModel, bad: CharacterModel, threshold: float = 0.0) -> LikelihoodRatio:
        out = cls([], [])
        out.ready, out.good, out.bad, out.threshold = True, good, bad, threshold
        return out

    def difference(self, url: str) -> float:
        return self.good.mean(url) - self.bad.mean(url)


def tallied(urls: DataFrame) -> DataFrame:
    """(rule_verdict, gram, n) of (rule_verdict, url): how often each of the ``grams`` stands in urls of a class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([what for what, _ in seen], pa.string()), pa.array([gram for _, gram in seen], pa.string()), pa.array(list(seen.values()), pa.int64())], names=["rule_verdict", "gram", "n"])

        seen: Counter[tuple[str, str]] = Counter()
        for batch in sliced(batches):
            for what, url in zip(batch.column("rule_verdict").to_pylist(), batch.column("url").to_pylist()):
                seen.update((what, gram) for gram in grams(url))
                if len(seen) > TALLY:
                    yield rows()
                    seen.clear()
        if seen:
            yield rows()

    return urls.select("rule_verdict", "url").mapInArrow(run, "rule_verdict string, gram string, n long").groupBy("rule_verdict", "gram").agg(F.sum("n").alias("n"))


def calibrated(held: DataFrame, model: LikelihoodRatio) -> float:
    """The threshold of least balanced error on (rule_verdict, url): half way from the least best score to the next one, or under all."""
    shared = held.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            scores = [shared.value.difference(url) for url in batch.column("url").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("rule_verdict"), pa.array(scores, pa.float64())], names=["rule_verdict", "score"])

    good, bad = F.count_if(F.col("rule_verdict") == "allow"), F.count_if(F.col("rule_verdict") == "block")
    scores = cut(held.select("rule_verdict", "url").mapInArrow(run, "rule_verdict string, score double").groupBy("score").agg(good.alias("good"), bad.alias("bad")))
    n = scores.agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"), F.min("score").alias("least")).first()
    # errors that blocking adds, in parts of one over the product of both counts: whole numbers
    change = F.col("good") * F.lit(n.bad) - F.col("bad") * F.lit(n.good)
    placed = cut(in_order(scores.select("score", change.alias("change")), F.col("score").asc(), total="change").select("score", "rank", (F.col("before") + F.col("change")).alias("wrong")))
    best = placed.orderBy("wrong", "score").first()
    if best.wrong >= 0:
        return n.least - 1e-9
    after = placed.where(F.col("rank") == best["rank"] + 1).first()
    return (best.score + (after.score if after else best.score + 1e-9)) / 2


def train(judged: DataFrame) -> LikelihoodRatio:
    """Fit and calibrated on all different rule-labelled urls; in the order of a class every fifth one, from the first, is held out."""
    labelled = judged.where(F.col("rule_verdict").isNotNull() & (F.col("url") != "")).select("url", "rule_verdict").distinct()
    ranked = cut(in_order(labelled, F.col("rule_verdict").asc(), F.col("url").asc()))
    sizes = {r.rule_verdict: r["count"] for r in ranked.groupBy("rule_verdict").count().collect()}
    if len(sizes) < 2:
        return LikelihoodRatio([], [])
    allowed = F.col("rule_verdict") == "allow"
    at = F.col("rank") - 1 - F.when(allowed, 0).otherwise(sizes["allow"])
    held = at % HELD_OUT == 0
    alone = F.when(allowed, sizes["allow"]).otherwise(sizes["block"]) == 1
    found = tallied(ranked.where(~held | alone)).toArrow()
    good, bad = (CharacterModel([], tally=zip(part.column("gram").to_pylist(), part.column("n").to_pylist())) for part in (found.filter(pc.equal(found.column("rule_verdict"), what)) for what in ("allow", "block")))
    return LikelihoodRatio.of(good, bad, calibrated(ranked.where(held), LikelihoodRatio.of(good, bad)))


def judge(pages: DataFrame, model: LikelihoodRatio | None = None) -> DataFrame:
    """Per page: page_id, host, path, rule, verdict, llr (null where a rule decided)."""
    bounded_batches(pages.sparkSession, 2000)
    parts = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rule, verdict = judge_by_rules(F.col("host"), F.col("path"))
    judged = parts.withColumns({"rule": rule, "rule_verdict": verdict})
    # read once by each worker, not once by each task
    shared = pages.sparkSession.sparkContext.broadcast(model or train(judged))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in sliced(batches, 2000):
            verdicts, scores = [], []
            for url, fixed in zip(batch.column("url").to_pylist(), batch.column("rule_verdict").to_pylist()):
                score = model.difference(url) if fixed is None and url and model.ready else None
                verdicts.append(fixed or ("block" if not url else "allow" if score is None or score > model.threshold else "block"))
                scores.append(score)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("page_id", "host", "path", "rule")), pa.array(verdicts, pa.string()), pa.array(scores, pa.float64())], names=["page_id", "host", "path", "rule", "verdict", "llr"])

    return judged.mapInArrow(run, "page_id long, host string, path string, rule string, verdict string, llr double")
