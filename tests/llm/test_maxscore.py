import math
import random

import numpy as np
import pytest
from flowsieve.llm.maxscore import top_k


def brute_force(rows, k, every):
    usable = []
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            row = (i, tuple(math.floor(64 * x) for x in v))
            if row not in usable:
                usable.append(row)
    out = []
    for i, q in usable:
        if i % every == 0:
            scored = sorted((-sum(a * b for a, b in zip(q, v)), j) for j, v in usable if j != i)  # noqa: B905  padded with zeros
            out += [(i, r, j, -s) for r, (s, j) in enumerate(scored[:k], 1)]
    return sorted(out)


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").selectExpr("*", "1 AS score", "2 AS _id")


@pytest.mark.parametrize(("shard_rows", "sample"), [(7, 64), (7, 4), (50, 2), (4096, 64)])
def test_agrees_with_brute_force(spark, shard_rows, sample):
    rng = random.Random(shard_rows)
    dims = 12
    rows = [(i, [rng.choice([rng.gauss(0, 0.2), 0.0, 0.25]) for _ in range(dims)]) for i in range(160)]
    rows += [(200 + i, rows[5][1]) for i in range(30)] + [rows[3], rows[20]]  # ties, rows alike
    rows += [(300, None), (320, []), (340, [0.5] * 5), (360, [float("nan")] * dims), (380, [None, *[0.1] * (dims - 1)]), (400, [float("inf"), *[0.1] * (dims - 1)]), (None, [0.3] * dims)]
    got = top_k(vectors(spark, rows), k=20, query_every=20, shard_rows=shard_rows, group_rows=5, sample=sample, least_shard_rows=shard_rows).collect()
    assert sorted(map(tuple, got)) == brute_force(rows, 20, 20)


def test_large_components_are_exact(spark):
    rows = [(i, [(i - 3) * 1e7 + 0.3, 2.0**20, -i * 1.0]) for i in range(8)]
    assert sorted(map(tuple, top_k(vectors(spark, rows), k=3, query_every=2).collect())) == brute_force(rows, 3, 2)


def test_few_rows_and_none(spark):
    assert [tuple(r) for r in top_k(vectors(spark, [(0, [1.0]), (1, [2.0])])).collect()] == [(0, 1, 1, 64 * 128)]
    assert top_k(vectors(spark, [(0, [1.0])])).collect() == []
    assert top_k(vectors(spark, [(0, [1.0])]).where("false")).collect() == []


def test_pruning_skips_most_of_a_peaked_shard():
    import numpy as np
    from flowsieve.llm.maxscore import Shard

    rng = np.random.default_rng(0)
    weights = rng.integers(-3, 4, (5000, 16)).astype(np.float32)
    weights[:40] += 30
    shard = Shard(np.arange(5000), weights)
    ids, scores = shard.best([-1], np.ones((1, 16), np.float32), 20)[0]
    exact = weights.sum(1)
    order = np.lexsort((np.arange(5000), -exact))[:20]
    assert ids.tolist() == order.tolist() and scores.tolist() == exact[order].tolist()


def test_floors_bound_what_shards_hand_on():
    """A floor from a sample: a shard hands on what reaches it, ties with it included, and no more."""
    from flowsieve.llm.maxscore import Shard

    rng = np.random.default_rng(1)
    weights = rng.integers(-9, 10, (4000, 8)).astype(np.float64)
    query = rng.integers(-9, 10, 8).astype(np.float64)
    scores = weights @ query
    floor = int(np.sort(scores)[-7])
    ids, found = Shard(np.arange(4000), weights).best([-1], query[None], 20, [floor])[0]
    order = np.lexsort((np.arange(4000), -scores))
    want = [i for i in order if scores[i] >= floor][:20]
    assert ids.tolist() == want and found.tolist() == scores[want].tolist()
    assert Shard(np.arange(4000), weights).best([-1], query[None], 20, [int(scores.max()) + 1])[0][0].tolist() == []
