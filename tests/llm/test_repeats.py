import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from flowsieve.llm.induced_sort import Shard
from flowsieve.llm.repeats import remove_repeats, window_pieces

from .conftest import AWKWARD


def brute_force(rows, depth):
    bodies = [(t or "").encode() for _, t in rows]
    count = Counter(b[i : i + depth] for b in bodies for i in range(len(b) - depth + 1))
    out = []
    for (i, _), b in zip(rows, bodies, strict=True):
        gone = np.zeros(len(b), bool)
        for s in range(len(b) - depth + 1):
            if count[b[s : s + depth]] > 1:
                gone[s : s + depth] = True
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out.append((i, len(b), int(gone.sum()), int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def cases():
    rng = random.Random(11)
    text = lambda n: "".join(rng.choices("abcdefghij éü\n", k=n))
    shared = [text(n) for n in (45, 60, 200, 400)]
    rows = [(100 + i, text(rng.randrange(200)) + rng.choice(shared) + text(rng.randrange(200)) + rng.choice(["", *shared])) for i in range(40)]
    rows += [(200, shared[3] * 2), (201, "ab" * 100), (202, "z" * 47), (203, "z" * 49), (204, text(39)), (205, shared[2]), (206, shared[2])]
    return rows + AWKWARD[:7] + AWKWARD[8:] + [(5, "y" * 3000)]


@pytest.mark.parametrize("shard_bytes", [300, 2 << 20])
def test_agrees_with_brute_force(documents, shard_bytes):
    rows = cases()
    got = remove_repeats(documents(rows), depth=48, keep=("doc_id",), outputs=("n_bytes", "n_removed", "n_spans", "kept_sha256"), shard_bytes=shard_bytes, memory=100)
    assert sorted(map(tuple, got.collect()), key=str) == brute_force(rows, 48)


def test_outputs_replace_columns_and_empty_table(documents):
    df = documents([(1, "a" * 300)])
    out = remove_repeats(df, outputs=("kept", "n_lines")[:1])
    assert out.columns == ["doc_id", "lang", "source", "n_chars", "n_lines", "Score", "_block", "_body", "kept"]
    assert bytes(out.first()["kept"]) == b""  # each 200 bytes start again one byte later
    assert remove_repeats(df.where("false")).collect() == []


def test_equal_windows_have_equal_anchors():
    rng = random.Random(1)
    shared = bytes(rng.choices(range(256), k=300))
    found = []
    for _ in range(2):
        body = bytes(rng.choices(range(256), k=rng.randrange(500))) + shared
        start = len(body) - 300
        pieces = list(window_pieces(body, 200))
        assert [p[0] for p in pieces] == np.cumsum([0] + [p[1] for p in pieces])[:-1].tolist()
        anchors = {}
        for first, windows, offset, anchor in pieces:
            for w in range(first, first + windows):
                anchors[w - start] = (first + offset - w, anchor)
        found.append([anchors[w] for w in range(101)])
    assert found[0] == found[1]


@pytest.mark.parametrize("alphabet", [b"a", b"ab", b"\x00\x01\xff", bytes(range(256))])
def test_induced_sorting_finds_all_repeats(alphabet):
    rng = random.Random(len(alphabet))
    spilled = 0
    for _ in range(120):
        texts = []
        for _ in range(rng.randrange(1, 12)):
            if texts and rng.random() < 0.5:
                t = rng.choice(texts)
                a = rng.randrange(len(t) + 1)
                texts.append(t[a : rng.randrange(a, len(t) + 1)] + bytes(rng.choices(alphabet, k=rng.randrange(6))))
            else:
                texts.append(bytes(rng.choices(alphabet, k=rng.randrange(60))))
        depth = rng.choice([2, 3, 5, 8, 16])
        count = Counter(t[i : i + depth] for t in texts for i in range(len(t) - depth + 1))
        expected = [i + depth <= len(t) and count[t[i : i + depth]] > 1 for t in texts for i in range(len(t) + 1)] + [False]
        shard = Shard(texts, depth, limit=rng.choice([1, 10, 1 << 20]))
        assert shard.repeated().tolist() == expected
        spilled += getattr(shard, "written", 0)
    assert spilled  # the queues went to disk in some of the cases


def test_rows_alike_cost_their_spans_once(spark, documents):
    """Spans of identical rows are one set, not one a row for each row."""
    text = "".join(random.Random(3).choices("abcdefgh ", k=2_000))
    for copies in (50, 500):
        df = documents([(1, text)] * copies)
        out = remove_repeats(df, keep=("doc_id",), outputs=("n_removed", "n_spans"))
        assert {tuple(r) for r in out.collect()} == {(1, 2_000, 1)} and out.count() == copies


def test_a_hot_anchor_with_more_text_than_places(documents):
    """A phrase in very many contexts: its windows are counted, not sorted, and give what sorting gives."""
    rng = random.Random(5)
    text = lambda n: "".join(rng.choices("abcdefghij", k=n))
    phrase, tails = text(36), [text(60) for _ in range(3)]
    rows = [(i, text(rng.randrange(30, 60)) + phrase + (rng.choice(tails) if i % 7 == 0 else text(60))) for i in range(150)]
    outputs = ("n_bytes", "n_removed", "n_spans", "kept_sha256")
    got = remove_repeats(documents(rows), depth=48, keep=("doc_id",), outputs=outputs, shard_bytes=64, memory=100).collect()
    want = brute_force(rows, 48)
    assert sorted(map(tuple, got), key=str) == want and sum(r[2] > 0 for r in want) > 10


def test_texts_beyond_a_chunk(documents, monkeypatch):
    from flowsieve.llm import repeats

    rng = random.Random(6)
    shared = "".join(rng.choices("abcdefghij", k=500))
    long = "".join(rng.choices("klmnopqrst", k=(1 << 20) - 150)) + shared + "".join(rng.choices("uvwxyz", k=300))
    got = remove_repeats(documents([(1, long), (2, "0" * 10 + shared)]), keep=("doc_id",), outputs=("n_bytes", "n_removed", "n_spans")).collect()
    assert sorted(map(tuple, got)) == [(1, len(long), 500, 1), (2, 510, 500, 1)]
    pieces = list(repeats.window_pieces(long.encode(), 200))
    assert [p[0] for p in pieces] == np.cumsum([0] + [p[1] for p in pieces])[:-1].tolist()
    assert sum(p[1] for p in pieces) == len(long) - 199


def test_only_text_that_may_repeat_is_sorted(monkeypatch):
    """Pieces of one anchor whose surroundings differ are left out of a shard, and no repeat is lost by that."""
    from flowsieve.llm import repeats

    sorted_bytes, kept_shard = [], repeats.Shard
    monkeypatch.setattr(repeats, "Shard", lambda texts, *a: (sorted_bytes.append(sum(map(len, texts))), kept_shard(texts, *a))[1])
    rng = random.Random(8)
    text = lambda n: bytes(rng.choices(b"abcdefghij", k=n))
    for depth in (40, 200, 286):
        phrases, long = [text(36) for _ in range(20)], [text(depth + 40) for _ in range(6)]
        bodies = [text(rng.randrange(200)) + rng.choice(phrases) + text(depth) for _ in range(200)]
        bodies += [text(rng.randrange(100)) + rng.choice(long)[rng.randrange(30) :] + text(rng.randrange(100)) for _ in range(20)]
        found = [(i, *p) for i, b in enumerate(bodies) for p in window_pieces(b, depth)]
        copies = Counter(bodies[i][at : at + w + depth - 1] for i, at, w, _, _ in found)
        columns = {"k1": [f[0] for f in found], "k2": [0] * len(found), "first": [f[1] for f in found], "place": [f[3] for f in found]}
        columns["text"] = [bodies[i][at : at + w + depth - 1] for i, at, w, _, _ in found]
        columns["n"] = [copies[t] for t in columns["text"]]
        got = repeats._sorted_shard(depth, 1000)(pa.table(columns)).to_pylist()
        count = Counter(b[s : s + depth] for b in bodies for s in range(len(b) - depth + 1))
        want = {(i, s) for i, at, w, _, _ in found if copies[bodies[i][at : at + w + depth - 1]] == 1 for s in range(at, at + w) if count[bodies[i][s : s + depth]] > 1}
        assert {(r["k1"], s) for r in got for s in range(r["lo"], r["hi"] - depth + 1)} == want and want
        assert sorted_bytes[-1] < sum(map(len, columns["text"])) / 4
