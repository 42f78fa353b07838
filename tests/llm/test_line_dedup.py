import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest
from flowsieve.llm.line_dedup import LineIndex, MinimalPerfectHash, drop_frequent_lines

from .conftest import AWKWARD

BLANKS = " \t\n\x0b\x0c\r"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_force(rows, min_chars=20, min_docs=3):
    key = lambda line: line.strip(BLANKS).translate(LOWER)
    lowest = lambda i: float("-inf") if i is None else i
    held, keeper = defaultdict(int), {}
    for i, text in rows:
        for k in {key(x) for x in (text or "").split("\n")}:
            held[k] += 1
            keeper[k] = max(keeper.get(k, lowest(i)), lowest(i))
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        left = [x for x in lines if len(key(x)) < min_chars or held[key(x)] < min_docs or keeper[key(x)] == lowest(i)]
        out.append((i, len(lines), len(lines) - len(left), hashlib.sha256("\n".join(left).encode()).hexdigest()))
    return sorted(out, key=str)


def collected(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_lines", "n_dropped", "kept_sha256").collect()), key=str)


@pytest.mark.parametrize("block_bytes", [200, 1 << 20])
def test_agrees_with_brute_force(documents, block_bytes):
    rng = random.Random(1)
    lines = [f"a line that several documents share, number {k}" for k in range(12)]
    lines += ["short", "", "é" * 19, "ß" * 20, "Ünïcödé lïne öf twenty chars"]
    rows = [(i, "\n".join(rng.choice([x, x.upper(), f" {x}\t"]) for x in rng.choices(lines, k=rng.randrange(1, 7)))) for i in range(40)]
    rows += AWKWARD + [(None, lines[0]), (99, None), (41, f"{lines[1]}\n{lines[1]}"), (41, lines[1])]
    got = drop_frequent_lines(documents(rows), keep=("doc_id",), outputs=("n_lines", "n_dropped", "kept_sha256"), block_bytes=block_bytes, shard_bytes=block_bytes)
    assert collected(got) == brute_force(rows)


def test_hot_line_costs_an_entry_a_block(documents):
    rows = [(i, f"the one line that every document holds\nown line of document number {i}") for i in range(200)]
    got = drop_frequent_lines(documents(rows), keep=("doc_id",), outputs=("n_dropped",), block_bytes=500)
    assert {r["doc_id"] for r in got.collect() if r["n_dropped"] == 0} == {199}


def test_outputs_replace_columns_and_empty_table(documents):
    df = documents([(1, "a")])
    assert drop_frequent_lines(df).columns == ["doc_id", "lang", "source", "n_chars", "Score", "_block", "_body", "n_lines", "n_dropped", "kept"]
    assert drop_frequent_lines(df.where("false")).collect() == []


def test_perfect_hash_is_minimal_and_perfect():
    rng = np.random.default_rng(0)
    for n in (0, 1, 2, 1000, 50_000):
        hi, lo = rng.integers(0, 1 << 64, (2, n), np.uint64, endpoint=False)
        slots = MinimalPerfectHash(hi, lo).slots(hi, lo)
        assert sorted(slots.tolist()) == list(range(n))
        index = LineIndex(hi, lo, np.arange(n), np.arange(n))
        hit, slot = index.probe(hi, lo)
        assert hit.all() and (index.docs[slot] == np.arange(n)).all()
        assert not index.probe(hi ^ np.uint64(1), lo)[0].any()


def test_perfect_hash_with_equal_halves():
    hi, lo = np.arange(100, dtype=np.uint64), np.full(100, 5, np.uint64)
    assert sorted(MinimalPerfectHash(hi, lo).slots(hi, lo).tolist()) == list(range(100))
    assert sorted(MinimalPerfectHash(lo, hi).slots(lo, hi).tolist()) == list(range(100))
