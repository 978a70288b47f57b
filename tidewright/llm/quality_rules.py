"""Quality rules by weak supervision: rules vote or abstain, and EM tells how far to trust each.

Every rule reads features of the whole text and votes good, bad or not at all. Votes are counted by
pattern in one aggregate (at most 3 to the power of the rules, whatever the corpus), on which
expectation-maximisation estimates the share of good documents and each rule's accuracy on good and
on bad ones. A document's verdict is the posterior probability of being good, a sum of the rules'
log-odds. Everything runs as DataFrame functions; only the pattern counts reach the driver.

Defined results: a null or empty text has no words, all features 0 and fails the base; ties of the
posterior with the threshold are kept; repeated rows give repeated rows; other columns are ignored;
an empty table gives an empty result. Windows are compared by 64-bit hashes within their document.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewright.llm.common import SPACES, WORD, cut, words_of

WINDOW = 8
#: The base fails under so many words, or if over so many per cent of them stand in repeated windows.
LEAST_WORDS, MOST_REPEATED = 20, 30
#: A document is kept if it is good with this probability at least.
THRESHOLD = 0.5
#: EM: beginning share of good documents, beginning accuracy of a rule on good and on bad documents (most rules
#: see one kind of bad document only), pseudo-votes that stand for this beginning beside the corpus, rounds at most.
PRIOR_GOOD, BEGIN_ACCURACY, PSEUDO_VOTES, ROUNDS = 0.9, (0.95, 0.3), 20.0, 500
#: EM ends when no estimate moves more; shares stay so far from 0 and 1.
SETTLED, EDGE = 1e-9, 1e-4

SYMBOLS = "[#*$%&|<>]+"


def _bind(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), 0)


def repeated_words(words: Column, window: int = WINDOW) -> Column:
    """Number of words in windows that the text has twice or more."""

    def covered(hashes: Column) -> Column:
        def spread(s: Column) -> Column:
            same = lambda e, j: F.coalesce(F.get(s, j)["h"] == e["h"], F.lit(False))
            twice = F.filter(s, lambda e, j: same(e, j - 1) | same(e, j + 1))
            return _bind(
                F.sort_array(F.transform(twice, lambda e: e["i"])),
                lambda p: F.aggregate(F.transform(p, lambda at, k: F.least(F.lit(window), F.coalesce(F.get(p, k + 1) - at, F.lit(window)))), F.lit(0).cast("long"), lambda a, x: a + x),
            )

        sorted_ = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("long")).otherwise(_bind(sorted_, spread))

    hashed = F.transform(words, lambda w: F.xxhash64(w))
    windows = _bind(hashed, lambda h: F.transform(F.sequence(F.lit(1), F.size(h) - (window - 1)), lambda i: F.xxhash64(F.slice(h, i, window))))
    return F.when(F.size(words) < window + 1, F.lit(0).cast("long")).otherwise(_bind(windows, covered))


def features(docs: DataFrame) -> DataFrame:
    """doc_id, the base features and those of the other rules."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", text.alias("text"), words_of(F.col("text")).alias("words"))
    without = lambda pattern: (F.length("text") - F.length(F.regexp_replace("text", pattern, ""))).cast("long")
    lines = F.filter(F.split("text", "\n"), lambda line: line.rlike(WORD))
    return rows.select(
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        without(SYMBOLS).alias("n_symbols"),
        _bind(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        _bind(lines, F.size).cast("long").alias("n_lines"),
        repeated_words(F.col("words")).alias("n_repeat_words"),
        without(r"\p{Lu}+").alias("n_upper"),
        F.size(F.array_distinct("words")).cast("long").alias("n_distinct"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))


def rules() -> dict[str, tuple[Column, Column]]:
    """(votes good, votes bad) by name; a rule for which neither holds abstains."""
    n = F.greatest(F.col("n_words"), F.lit(1))
    letters = F.col("word_chars") / n
    symbols, upper = F.col("n_symbols") / n, F.col("n_upper") / F.greatest(F.col("word_chars"), F.lit(1))
    repeats, dups = F.col("n_repeat_words") / n, F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1))
    variety, share = F.col("n_distinct") / n, F.col("n_symbols") / F.greatest(F.col("word_chars"), F.lit(1))
    return {
        "length": (F.col("n_words") >= 50, F.col("n_words") < LEAST_WORDS),
        "repetition": (repeats <= 0.02, repeats > 0.3),
        "symbols": (symbols <= 0.05, symbols > 0.25),
        "symbol_share": (share <= 0.01, share > 0.06),
        "duplicate_lines": (dups == 0, dups > 0.5),
        "word_length": (letters.between(3, 12), (letters < 2) | (letters > 20)),
        "upper_case": (upper <= 0.12, upper > 0.3),
        "variety": (variety >= 0.3, variety < 0.1),
    }


@dataclass
class Trust:
    """What EM found: the share of good documents, and (accuracy on good, accuracy on bad) of each rule."""

    good: float
    accuracy: dict[str, tuple[float, float]]

    def weights(self, rule: str) -> tuple[float, float]:
        """Log-odds of a good and of a bad vote."""
        a, b = self.accuracy[rule]
        return math.log(a / (1 - b)), math.log((1 - a) / b)

    def log_odds(self, votes: dict[str, int]) -> float:
        total = math.log(self.good / (1 - self.good))
        for rule, vote in votes.items():
            if vote:
                total += self.weights(rule)[0 if vote > 0 else 1]
        return total


def _share(x: float) -> float:
    return min(1 - EDGE, max(EDGE, x))


def fit(patterns: list[tuple[dict[str, int], int]], names: list[str]) -> Trust:
    """EM on (votes, how many documents) pairs, until it settles.

    Both accuracies of a rule are free but for their order, which keeps the labels from swapping: a good
    vote is no likelier for a bad document than for a good one. A rule that would break it tells nothing
    and votes alike on both.
    """
    trust = Trust(PRIOR_GOOD, {r: BEGIN_ACCURACY for r in names})
    total = sum(n for _, n in patterns)
    for _ in range(ROUNDS if total else 0):
        posterior = [1 / (1 + math.exp(-max(-500.0, min(500.0, trust.log_odds(v))))) for v, _ in patterns]
        accuracy = {}
        for r in names:
            cast = [(p * n, (1 - p) * n, v[r]) for p, (v, n) in zip(posterior, patterns) if v[r]]
            good, bad = sum(g for g, _, _ in cast), sum(b for _, b, _ in cast)
            good_up, bad_up = sum(g for g, _, v in cast if v > 0), sum(b for _, b, v in cast if v > 0)
            on_good = (good_up + BEGIN_ACCURACY[0] * PSEUDO_VOTES) / (good + PSEUDO_VOTES)
            on_bad = (bad - bad_up + BEGIN_ACCURACY[1] * PSEUDO_VOTES) / (bad + PSEUDO_VOTES)
            if on_good + on_bad < 1:
                on_good = (good_up + bad_up + BEGIN_ACCURACY[0] * PSEUDO_VOTES) / (good + bad + PSEUDO_VOTES)
                on_bad = 1 - _share(on_good)
            accuracy[r] = _share(on_good), _share(on_bad)
        good = sum(p * n for p, (_, n) in zip(posterior, patterns))
        new = Trust(_share((good + PRIOR_GOOD * PSEUDO_VOTES) / (total + PSEUDO_VOTES)), accuracy)
        moved = max([abs(new.good - trust.good)] + [abs(x - y) for r in names for x, y in zip(accuracy[r], trust.accuracy[r])])
        trust = new
        if moved < SETTLED:
            break
    return trust


def judge(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Per document: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, quality, kept."""
    found = rules()
    names = list(found)
    vote = lambda good, bad: F.when(bad, F.lit(-1)).when(good, F.lit(1)).otherwise(F.lit(0))
    rows = cut(features(docs))
    voted = rows.withColumns({f"v_{r}": vote(*found[r]) for r in names})
    counted = voted.groupBy(*(f"v_{r}" for r in names)).count().collect()
    trust = fit([({r: row[f"v_{r}"] for r in names}, row["count"]) for row in counted], names)
    total = F.lit(math.log(trust.good / (1 - trust.good)))
    for r in names:
        up, down = trust.weights(r)
        total = total + F.when(F.col(f"v_{r}") > 0, F.lit(up)).when(F.col(f"v_{r}") < 0, F.lit(down)).otherwise(F.lit(0.0))
    quality = 1 / (1 + F.exp(-total))
    return voted.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base_failed().alias("base_failed"), quality.alias("quality"), (~base_failed() & (quality >= threshold)).alias("kept"))
