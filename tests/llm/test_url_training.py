"""All labelled urls train and calibrate the url models."""

import numpy as np
from pyspark.sql import functions as F

from tidewright.llm import url_filter


def urls(n, host, words, seed):
    draw = np.random.default_rng(seed)
    return sorted({f"http://{host(i)}{draw.choice(words)}-{draw.choice(words)}/{i}" for i in range(n)})


def test_every_labelled_url_counts(spark):
    good = urls(5200, lambda i: f"s{i % 90}.com/", ["news", "game", "science", "cheap"], 1)
    bad = urls(4700, lambda i: f"x{i % 70}.net/es/", ["win", "cash", "game", "cheap"], 2)
    rows = [*good, *bad, *good[:50], *bad[:700], "http://open.org/a", None, ""]
    judged = spark.createDataFrame([(u,) for u in rows], "url string").withColumns({"host": url_filter.host_of(F.col("url")), "path": url_filter.path_of(F.col("url"))})
    model = url_filter.train(judged.withColumn("rule_verdict", url_filter.judge_by_rules(F.col("host"), F.col("path"))[1]))
    want = url_filter.LikelihoodRatio(good, bad)
    for got, plain, used in ((model.good, want.good, good), (model.bad, want.bad, bad)):
        assert got.counts == plain.counts and got.totals == plain.totals
        assert got.totals[""] == sum(len(u) + 1 for i, u in enumerate(used) if i % 5)
    assert abs(model.threshold - want.threshold) < 1e-12


def test_threshold_is_that_of_all_held_out_urls(spark, monkeypatch):
    monkeypatch.setattr(url_filter, "TALLY", 50)
    for n_good, n_bad in ((1, 1), (1, 7), (23, 2), (60, 90)):
        good = urls(n_good, lambda i: "a.com/", ["news", "cheap", "x"], n_good)
        bad = urls(n_bad, lambda i: "b.net/fr/", ["news", "cheap", "y"], n_bad)
        judged = spark.createDataFrame([(u, v) for us, v in ((good, "allow"), (bad, "block")) for u in us], "url string, rule_verdict string")
        model, want = url_filter.train(judged), url_filter.LikelihoodRatio(good, bad)
        assert model.good.counts == want.good.counts and model.bad.counts == want.bad.counts
        assert abs(model.threshold - want.threshold) < 1e-12
