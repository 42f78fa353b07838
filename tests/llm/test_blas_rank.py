import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from flowsieve.llm import blas_rank
from pyspark.sql import functions as F

from .conftest import AWKWARD

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(c.lower() if c.isascii() else c for c in text or ""))


def brute_force(docs, items, k):
    bags = [(i, Counter(terms(t))) for i, t in docs]
    held = [(i, b) for i, b in bags if b]
    n, length = len(held), sum(sum(b.values()) for _, b in held)
    df = Counter(t for _, b in held for t in b)
    out = []
    for item, text in items:
        scored = []
        for i, bag in held:
            m = 100 - 75 + (75 * sum(bag.values()) * n) // length
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * bag[t]) // (1000 * bag[t] + 8 * m)) for t in terms(text) if bag[t])
            if score:
                scored.append((-score, i is not None, i or 0, i))
        out += [(item, r, i, -s) for r, (s, _, _, i) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=repr)


def items_of(spark, rows):
    return spark.createDataFrame(rows, "item_id bigint, text string").withColumns({"rank": F.lit(1), "doc_id": F.lit("x"), "_item": F.lit(2)})


def corpus(seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)] + ["Straße", "ÀB", "a1", "x_y", "don't"]
    text = lambda n: "".join(rng.choice(words).upper() if rng.random() < 0.2 else rng.choice(words) + rng.choice([" ", ", ", "\n"]) for _ in range(n))
    docs = [(i, text(rng.randint(0, 60))) for i in range(120)]
    docs += [(500 + i, docs[3][1]) for i in range(40)] + [docs[5]] * 2 + [(None, docs[3][1])] + AWKWARD
    items = [(i, text(rng.randint(1, 25))) for i in range(12)] + [(3, "w1 w1 w2 text"), (50, None), (51, ""), (52, "nowhere"), (53, docs[3][1]), (53, docs[3][1])]
    return docs, items


@pytest.mark.parametrize(("documents_", "tile", "exact", "group"), [(7, 3, 1 << 53, 1 << 20), (1024, 2048, 1 << 53, 300), (50, 16, 1 << 24, 1 << 20), (64, 64, 2, 1 << 20)])
def test_agrees_with_brute_force(spark, documents, documents_, tile, exact, group):
    docs, items = corpus(documents_)
    got = blas_rank.rank(documents(docs), items_of(spark, items), k=10, documents=documents_, tile=tile, exact=exact, group_bytes=group)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect()), key=repr) == brute_force(docs, items, 10)


def test_empty_tables(spark, documents):
    docs, items = documents([(1, "a b"), (2, None)]), items_of(spark, [(1, "a"), (2, "c")])
    assert [tuple(r)[:3] for r in blas_rank.rank(docs, items).collect()] == [(1, 1, 1)]
    assert blas_rank.rank(docs.where("false"), items).collect() == []
    assert blas_rank.rank(docs, items.where("false")).collect() == []
    assert blas_rank.rank(docs.where("doc_id = 2"), items).collect() == []


def test_slices_never_cut_a_term(monkeypatch):
    rng = random.Random(0)
    body = "".join(rng.choice(["ab", "é", " ", ",", "Z" * 9_000, "1"]) for _ in range(300))
    whole = [t.encode() for t in terms(body)]
    for size in (1, 7, 100, 5_000):
        monkeypatch.setattr(blas_rank, "_SLICE", size)
        assert [t for some in blas_rank.terms(body.encode()) for t in some] == whole


def test_sums_beyond_a_double_stay_exact():
    rng = np.random.default_rng(0)
    weights, impacts = rng.integers(0, 1 << 33, (5, 40)), rng.integers(0, 1 << 24, (40, 6))
    assert (blas_rank.multiplied(weights.astype(float), impacts.astype(float)) == weights @ impacts).all()
    weights[0, 3], impacts[3, 2] = (1 << 40) + 1, (1 << 20) + 1
    assert (blas_rank.multiplied(weights.astype(float), impacts.astype(float)) == weights @ impacts).all()


def test_ties_at_the_edge_go_by_id():
    best = blas_rank.Best(1, 3)
    for ids in ([9, 8, 7, 6, 5], [4, 30, 2], [50]):
        best.enter(np.full((1, len(ids)), 5), np.array(ids), np.ones(len(ids), bool))
    assert best.rows[0][1].tolist() == [2, 4, 5]
