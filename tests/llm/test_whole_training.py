"""The trees of problem 5 learn from all rows; alike ones are counted, not chosen."""

import numpy as np
from gavel.llm import boost, fillers, speakers
from pyspark.sql import functions as F


def test_times_are_repeated_rows():
    rng = np.random.default_rng(5)
    x = rng.integers(0, 4, (300, 3))
    y = (x[:, 0] + rng.integers(0, 3, 300) > 3).astype(float)
    times = rng.integers(1, 6, 300)
    many = boost.Boosted().fit(np.repeat(x, times, axis=0), np.repeat(y, times))
    assert np.allclose(boost.Boosted().fit(x, y, times).predict(x), many.predict(x))


def test_all_pairs_train(spark):
    n, f = 30_000, speakers.FEATURES
    bit = lambda k: F.pmod(F.xxhash64(F.col("id"), F.lit(k)), F.lit(2)).cast("int")
    pairs = spark.range(n).select(*(bit(k % 3).alias(c) for k, c in enumerate(f)), F.when(F.col("id") % 7 > 0, bit(F.col("id") % 3)).alias("new"))
    rows = pairs.where("new is not null").toArrow()
    x = np.stack([rows[c].to_numpy() for c in f], axis=1).astype(np.int64)
    rule = np.zeros((speakers.RULE_PAIRS, len(f)), np.int64)
    rule[::2, 0] = 1
    want = boost.Boosted().fit(np.concatenate([rule, x]), np.concatenate([1 - rule[:, 0], rows["new"].to_numpy()]))
    assert len(x) > 25_000 and np.allclose(speakers.fitted(pairs).predict(x), want.predict(x))
    assert len(speakers.fitted(pairs.where("new is null")).trees) > 0


def test_all_words_train(spark):
    letters = F.array(*(F.substring(F.lit("abcdefghijklmnopqrstuvwxyz"), F.pmod(F.floor(F.col("id") / 26**k), F.lit(26)).cast("int") + 1, F.lit(1)) for k in range(4)))
    words = spark.range(30_000).select(F.array_join(letters, "").alias("word"), *((F.col("id") % (k + 2)).alias(c) for k, c in enumerate(fillers.COUNTS)))
    x, y, side, times = fillers.examples(words)
    assert times.sum() == 30_000 and len(x) == len(y) == len(side) == len(times) < 30_000
    rows = words.toArrow()
    names = rows["word"].to_pylist()
    own = np.minimum(fillers.features(names, np.stack([rows[c].to_numpy() for c in fillers.COUNTS], axis=1)), boost.BINS - 1)
    known = [bool(fillers._seed.fullmatch(w)) for w in names]
    kinds, counts = np.unique(np.column_stack([known, fillers._sides(names), own]), axis=0, return_counts=True)
    assert (np.column_stack([y, side, x]) == kinds).all() and (times == counts).all()
    values = np.array([0.3, 0.1, 0.2])
    assert fillers._quantile(values, np.array([5, 90, 5]), 0.95) == np.quantile(np.repeat(values, [5, 90, 5]), 0.95, method="lower")
