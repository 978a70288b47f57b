"""The greedy walk ends only when every episode is decided."""

from tidewright.operators import curation


def test_a_long_chain_is_walked_to_its_end(spark):
    n = 9
    keep = spark.createDataFrame([(i, f"{i:02d}", float(n - i)) for i in range(n)], "episode_index long, fingerprint string, keep_score double")
    vectors = spark.createDataFrame([(i, [float(i), 0.0, 0.0]) for i in range(n)], "episode_index long, v array<double>")
    kept = curation.greedy_dedup(keep, vectors, 1.5, most_rounds=2).where("kept").collect()
    assert sorted(r.episode_index for r in kept) == [0, 2, 4, 6, 8]
