import random
from functools import partial

import numpy as np
import pytest
import xxhash
from flowsieve.llm import simhash
from flowsieve.llm.components import components

from .conftest import AWKWARD

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def slow_fingerprint(text):
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", (text or "").translate(LOWER)) if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(values, radius):
    root = list(range(len(values)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(values)):
        for j in range(i):
            if (values[i] ^ values[j]).bit_count() <= radius:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(values))]


def test_agrees_with_brute_force(documents):
    rng = random.Random(5)
    words = [f"Word{k}" for k in range(300)]
    rows = []
    for i in range(120):
        text = " ".join(rng.choices(words, k=rng.choice([1, 3, 4, 5, 200])))
        rows += [(10 * i + 100, text)] + [(10 * i + 100 + c, text.replace(" ", "\t ", c).upper() if c == 1 else text + f" Word{c}") for c in range(1, rng.randrange(1, 5))]
    rows += AWKWARD
    got = simhash.near_duplicates(documents(rows)).collect()
    prints = [slow_fingerprint(t) for _, t in rows]
    roots = slow_components(prints, 4)
    smallest = {}
    for (i, _), r in zip(rows, roots, strict=True):
        if i is not None:
            smallest[r] = min(i, smallest.get(r, i))
    expected = [(i, f"{p:016x}", smallest.get(r)) for (i, _), p, r in zip(rows, prints, roots, strict=True)]
    assert sorted(map(tuple, got), key=str) == sorted(expected, key=str)


@pytest.mark.parametrize("group", [3, 2048])
def test_links_in_dense_groups_are_whole(spark, group):
    rng = random.Random(group)
    values = set()
    for _ in range(4):
        center = rng.getrandbits(64)
        for _ in range(60):
            v = center
            for b in rng.sample(range(64), rng.randrange(5)):
                v ^= 1 << b
            values.add(v)
    values |= {rng.getrandbits(64) for _ in range(200)}
    values = sorted(values)
    members = spark.createDataFrame([(bytearray(v.to_bytes(8, "big")),) for v in values], "fp binary")
    found = components(simhash.links(members, 4, 64, group=group)).collect()
    root = {int.from_bytes(r["node"], "big"): int.from_bytes(r["root"], "big") for r in found}
    assert [root.get(v, v) for v in values] == [values[r] for r in slow_components(values, 4)]


@pytest.mark.parametrize("members", [2, 10**5, 10**9])
def test_exact_keys_lose_no_pair(members):
    rng = np.random.default_rng(members)
    tables = simhash.exact_keys(members, 64, 4)
    for _ in range(300):
        flipped = set(rng.choice(64, 4, replace=False).tolist())
        assert any(not flipped & set(t.tolist()) for t in tables)


def test_sampled_keys_meet_as_often_as_promised():
    tables = simhash.sampled_keys(10**5, 256, 42, 0.97)
    rng = np.random.default_rng(3)
    met = sum(any(not flipped & set(t.tolist()) for t in tables) for flipped in (set(rng.choice(256, 42, replace=False).tolist()) for _ in range(400)))
    assert met >= 0.93 * 400


def test_one_document_of_each_group_stays(documents):
    rng = random.Random(8)
    base = [rng.choice("abcdefgh") + str(k) for k in range(400)]
    near = [*base[:200], "other", *base[201:]]
    rows = [(50, " ".join(base)), (40, " ".join(near)), (60, " ".join(base)), (60, " ".join(base)), (70, " ".join(base[::-1]))] + AWKWARD
    kept = simhash.keep_one(documents(rows), 42, keys=partial(simhash.sampled_keys, sure=0.97)).collect()
    ids = [r["doc_id"] for r in kept]
    assert {40, 70} <= set(ids) and not {50, 60} & set(ids)
    assert sorted(i for i in ids if i is not None and i < 4) == [1, 3]  # of the texts without words, and of the rows alike
    assert ids.count(4) == 2 and None in ids


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, k) for k in range(101, 140)] + [(7, 7), (200, 150), (150, 200)]
    found = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert found == {i: 0 for i in range(1, 61)} | {k: 100 for k in range(101, 140)} | {200: 150}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).collect() == []


def test_empty_table(documents):
    assert simhash.near_duplicates(documents([(1, "a")]).where("false")).collect() == []


@pytest.mark.parametrize("copies", [200, 800])
def test_a_dense_group_gives_as_many_edges_as_members(spark, copies):
    """All pairs of such a group are links; what leaves the tasks is a forest."""
    rng = random.Random(copies)
    center, values = rng.getrandbits(64), set()
    while len(values) < copies:
        v = center
        for b in rng.sample(range(64), 2):
            v ^= 1 << b
        values.add(v)
    members = spark.createDataFrame([(bytearray(v.to_bytes(8, "big")),) for v in values], "fp binary")
    tables = len(simhash.exact_keys(copies, 64, 4))
    edges = simhash.links(members, 4, 64)
    assert copies - 1 <= edges.count() <= tables * copies
    assert len({r["root"] for r in components(edges).collect()}) == 1


def test_the_pipeline_keeps_one_of_each_component(spark, documents):
    import corpus_pipeline

    rng = random.Random(12)
    rows = []
    for k in range(120):
        words = [f"w{rng.getrandbits(40)}" for _ in range(rng.randint(30, 400))]
        rows.append((10 * k, " ".join(words)))
        for side in range(1, rng.randint(1, 4)):  # copies with few or many changed words, and exact ones
            for _ in range(rng.choice([0, 1, 2, 20])):
                words[rng.randrange(len(words))] = f"x{rng.getrandbits(40)}"
            rows.append((10 * k + side, " ".join(words)))
    marks = [int.from_bytes(simhash.fingerprint(t.encode(), 4), "big") for _, t in rows]
    root = slow_components(marks, 4)
    kept = corpus_pipeline.drop_near_duplicates(spark, documents(rows), "").collect()
    assert sorted(r["doc_id"] for r in kept) == sorted({min(rows[j][0] for j in range(len(rows)) if root[j] == r) for r in root})
    assert 120 <= len(kept) < len(rows)
    empty = corpus_pipeline.drop_near_duplicates(spark, documents([(1, "a")]).where("false"), "")
    assert empty.collect() == []
