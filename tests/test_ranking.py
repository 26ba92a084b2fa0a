"""Exact ranks, samples and quantiles against brute force, with a hot key and NULL keys."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridspark.functions.ranking import exact_quantiles, hash_rank, hash_smallest, ordered_rank, smallest_k
from gridspark.operators import sampling as sa


@pytest.fixture(scope="module")
def skewed(spark):
    """60 % of rows under one key, a NULL key, many ties and a heavy tail."""
    rng = np.random.default_rng(5)
    n = 20_000
    key = np.where(rng.random(n) < 0.6, "hot", rng.choice(["a", "b", None], n))
    value = np.where(rng.random(n) < 0.3, 7.0, np.round(np.exp(rng.normal(0, 4, n)), 3))
    rows = [(int(i), None if k is None else str(k), float(v)) for i, (k, v) in enumerate(zip(key, value))]
    return spark.createDataFrame(rows, "id long, k string, v double").repartition(16).cache(), rows


def groups(rows):
    out = {}
    for i, k, v in rows:
        out.setdefault(k, []).append((i, v))
    return out


def test_exact_quantiles(skewed):
    df, rows = skewed
    probs = [0.0, 0.01, 0.25, 0.5, 0.98, 1.0]
    got = {r.k: list(r)[1:] for r in exact_quantiles(df, ["k"], "v", probs, [f"q{i}" for i in range(6)]).collect()}
    for k, g in groups(rows).items():
        assert np.allclose(got[k], np.quantile([v for _, v in g], probs), rtol=1e-12)
    whole = exact_quantiles(df, [], "v", probs, [f"q{i}" for i in range(6)]).first()
    assert np.allclose(list(whole), np.quantile([r[2] for r in rows], probs), rtol=1e-12)


def test_exact_quantiles_of_one_value(spark):
    df = spark.createDataFrame([(3.0,)] * 5 + [(None,)], "v double")
    assert list(exact_quantiles(df, [], "v", [0.1, 0.9], ["a", "b"]).first()) == [3.0, 3.0]


def test_ordered_rank(skewed):
    df, rows = skewed
    got = {r.id: (r.rn, r.rn_of) for r in ordered_rank(df, ["k"], "v", ["id"]).collect()}
    for g in groups(rows).values():
        for rank, (i, _) in enumerate(sorted(g, key=lambda x: (x[1], x[0])), 1):
            assert got[i] == (rank, len(g))


def test_hash_rank_is_a_permutation(skewed):
    df, rows = skewed
    d = hash_rank(df, ["k"], ["id"], seed=4).collect()
    assert len(d) == len(rows)
    for k, g in groups(rows).items():
        assert sorted(r.rn for r in d if r.k == k) == list(range(1, len(g) + 1))


def test_hash_smallest(skewed):
    df, rows = skewed
    rank = {r.id: r.rn for r in hash_rank(df, ["k"], ["id"], seed=9).collect()}
    for k in (1, 50, 5_000):
        got = {r.id for r in hash_smallest(df, ["k"], ["id"], lambda n: F.lit(k), seed=9).collect()}
        assert got == {i for i, r in rank.items() if r <= k}


def test_smallest_k(skewed):
    df, rows = skewed
    got = {(r.k, r.rn): r.id for r in smallest_k(df, ["k"], ["v", "id"], 20).collect()}
    for k, g in groups(rows).items():
        best = sorted(g, key=lambda x: (x[1], x[0]))[:20]
        assert [got[(k, i + 1)] for i in range(len(best))] == [i for i, _ in best]


def test_fraction_and_region_samples(skewed):
    df, rows = skewed
    s = sa.sample_fraction(df, ["id"], 0.1, seed=1)
    assert s.count() == 2000 and s.select("id").distinct().count() == 2000
    assert sa.sample_fraction(df.limit(3), ["id"], 0.01).count() == 1
    small = df.filter("k IN ('a', 'hot')")
    d = sa.sample_per_region(small, "k", ["id"], 6000, seed=2)
    n = {r.k: (r.n, r.u) for r in d.groupBy("k").agg(F.count("*").alias("n"), F.countDistinct("id").alias("u")).collect()}
    assert n["hot"] == (6000, 6000)
    assert n["a"][0] == 6000 and n["a"][1] < 6000


@pytest.mark.parametrize("n,k", [(100, 7), (5, 7), (70, 7)])
def test_assignment(spark, n, k):
    df = spark.range(n).withColumn("x", F.col("id") * 3)
    rr = {r.id: r.shard for r in sa.round_robin(df, "x", k).collect()}
    assert rr == {i: i % k for i in range(n)}
    per = -(-n // k)
    assert {r.id: r.shard for r in sa.contiguous_blocks(df, "x", k).collect()} == {i: i // per for i in range(n)}
    bal = [r.shard for r in sa.contiguous_blocks(df, "x", k, balanced=True).orderBy("id").collect()]
    sizes = [bal.count(s) for s in range(k)]
    assert bal == sorted(bal) and sizes == [n // k + (1 if s < n % k else 0) for s in range(k)]
