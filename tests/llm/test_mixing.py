import math
import re
from collections import defaultdict

import pytest
from flowsieve.llm import mixing

from .conftest import AWKWARD


def words(text):
    return len(re.findall(mixing.WORD, text or ""))


def test_exponent_meets_the_targets():
    tokens = {"a": 8000, "b": 1000, "c": 900, "d": 100, "empty": 0}
    for share in (0.75, 0.9, 0.97):
        alpha = mixing.find_exponent(tokens, target_entropy=share * 2)
        assert math.isclose(mixing.entropy(mixing.tempered(tokens, alpha)), share * 2, abs_tol=1e-9)
    alpha = mixing.find_exponent(tokens, max_repeats=3.0)
    assert math.isclose(mixing.repeats(tokens, mixing.tempered(tokens, alpha), None), 3.0, rel_tol=1e-9)
    assert mixing.find_exponent(tokens, max_repeats=100.0) == 0.0  # equal shares are allowed
    assert mixing.find_exponent(tokens, target_entropy=0.1) == 1.0  # not even the natural mix is that uneven
    assert mixing.find_exponent({"a": 0}) == 0.0 and mixing.find_exponent({}) == 0.0


def rows():
    out = []
    for s, n in (("hot", 300), ("mid", 90), ("small", 20)):
        out += [(1000 * n + i, " ".join(["w"] * (1 + (7 * i) % 23)), "en", s) for i in range(n)]
    return out + [(i, t, "en", None) for i, t in AWKWARD]


def draws(df):
    return sorted(((r["doc_id"], r["source"], r["_epoch"], r["_block"], r["_place"], words(r["text"])) for r in df.collect()), key=str)


@pytest.mark.parametrize("budget", [None, 1500, 20_000])
def test_passes_and_budgets(documents, budget, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK_DOCS", 10)
    df = documents(rows())
    got = draws(mixing.mix(df, target_entropy_share=0.9, max_repeats=None, budget=budget))
    totals = defaultdict(lambda: [0, 0])
    for _, t, _, s in rows():
        totals[s or ""][0] += 1
        totals[s or ""][1] += words(t)
    plans = {p.source: p for p in mixing.plan({s: tuple(x) for s, x in totals.items()}, 0.9, None, budget)}
    for source, p in plans.items():
        own = [g for g in got if (g[1] or "") == source]
        whole = [g for g in own if g[2] < p.passes]
        assert len(whole) == p.passes * p.docs
        assert sum(g[5] for g in whole) == p.passes * p.tokens
        # The last pass is a prefix of its order, as long as the budget allows.
        last = sorted((g for g in own if g[2] == p.passes), key=lambda g: g[3:5])
        spent = sum(g[5] for g in last)
        assert spent <= p.rest < p.tokens or not p.tokens
        everything = sorted((mixing_key(i, t, s, p) for i, t, _, s in rows() if (s or "") == source), key=lambda x: x[:2])
        taken = 0
        expected = []
        for block, place, size in everything:
            taken += size
            if taken > p.rest or not p.rest:
                break
            expected.append((block, place))
        assert [g[3:5] for g in last] == expected or source == ""
        if budget is None:
            assert p.passes >= 1


_KEYS = {}


def mixing_key(i, t, s, p):
    return (*_KEYS[i, t, p.passes, p.blocks], words(t))


@pytest.fixture(autouse=True, scope="module")
def keys(spark):
    """Block and place of each document in any pass, by the same hashes."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(i, t) for i, t, *_ in rows()], "doc_id bigint, text string")
    df = df.select("*", F.xxhash64("doc_id", F.xxhash64("text")).alias("_doc"))
    df = df.crossJoin(spark.range(60).select(F.col("id").alias("_epoch"))).crossJoin(spark.createDataFrame([(1,), (2,), (9,), (30,)], "_blocks bigint"))
    _, block, place = mixing._order(0)
    for r in df.select("doc_id", "text", "_epoch", "_blocks", block.alias("b"), place.alias("p")).collect():
        _KEYS[r["doc_id"], r["text"], r["_epoch"], r["_blocks"]] = (r["b"], r["p"])
    yield


def test_same_seed_same_mix_and_columns(documents):
    df = documents(rows())
    one, two = (draws(mixing.mix(df.repartition(n), seed=4)) for n in (1, 7))
    assert one == two
    out = mixing.mix(df)
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "n_lines", "Score", "_body", "_epoch", "_block", "_place", "_weight"]
    assert {r["doc_id"] for r in out.select("doc_id").collect()} == {r[0] for r in rows()}  # every document at least once
    assert out.where("_epoch > 1").count() == 0  # and at most twice


def test_empty_table_and_no_tokens(documents):
    assert mixing.mix(documents([(1, "a")]).where("false")).collect() == []
    assert len(mixing.mix(documents([(1, None), (2, "")])).collect()) == 2
