import hashlib
import random

import pytest
from flowsieve.llm import edit_embedding as e

from .conftest import AWKWARD


def expected(rows):
    def tie(t):
        return t or ""

    ordered = sorted(rows, key=lambda r: (-1 if r[0] is None else r[0]), reverse=True)
    out = []
    for k, (i, text) in enumerate(ordered):
        text, following = tie(text), tie(ordered[(k + 1) % len(ordered)][1])
        half = len(text) // 2
        out.append((i, len(text), hashlib.sha256((text[: len(text) - half] + following[:half]).encode()).hexdigest()))
    return out


@pytest.mark.parametrize("piece_bytes", [1000, 4 << 20])
def test_edited_texts_of_neighbours(documents, piece_bytes):
    rng = random.Random(4)
    rows = [(i, "".join(rng.choices("abcdefgh üé", k=rng.randrange(400)))) for i in rng.sample(range(10, 10**6), 60)]
    rows += [AWKWARD[k] for k in (0, 1, 2, 7, 8, 9)]
    got = e.compared_with_next(documents(rows), piece_bytes=piece_bytes).collect()
    assert sorted([(r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in got], key=str) == sorted(expected(rows), key=str)
    for r in got:
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1


def test_rows_alike_one_row_and_empty_table(documents):
    assert len(e.compared_with_next(documents(AWKWARD)).collect()) == len(AWKWARD)
    (one,) = e.compared_with_next(documents([(1, "abcdef")])).collect()
    assert one["edited_sha256"] == hashlib.sha256(b"abcabc").hexdigest() and one["near_next"] == 1.0
    assert e.compared_with_next(documents([(1, "a")]).where("false")).collect() == []


def test_likeness_follows_edit_distance():
    rng = random.Random(9)
    means = []
    for edits in (0, 2, 20, 200):
        values = []
        for _ in range(30):
            text = "".join(rng.choices("abcdefghijklmnopqrst ", k=1500))
            other = list(text)
            for _ in range(edits):
                at = rng.randrange(len(other))
                rng.choice([lambda at: other.insert(at, "x"), lambda at: other.pop(at), lambda at: other.__setitem__(at, "y")])(at)
            values.append(e.likeness(*e.fingerprints([text, "".join(other)])))
        means.append(sum(values) / len(values))
    assert means[0] == 1.0 and means[0] > means[1] > means[2] > means[3]
    assert means[1] > 0.85 and means[3] < 0.6


def test_fingerprints_do_not_depend_on_company():
    rng = random.Random(3)
    texts = ["", "a", "ab", "é" * 5, "x" * 5000] + ["".join(rng.choices("abc ", k=rng.randrange(3000))) for _ in range(20)]
    together = e.fingerprints(texts)
    assert together == [e.fingerprints([t])[0] for t in texts]
    assert e.likeness(together[0], together[0]) == 1.0 and e.likeness(together[0], together[4]) == 0.0
    # Lengths on either side of a class border still compare.
    long = "".join(rng.choices("abcdefghij", k=1030))
    assert e.likeness(*e.fingerprints([long, long[:1020]])) > 0.8


def test_walk_is_the_one_by_one_walk():
    text = "some text é to walk " * 5
    letters = e.classes(text)
    steps = e._walk([letters])[0]
    at = 0
    for i, c in enumerate(letters.tolist()):
        assert steps[i] == at
        at += int(e._WAITS[c * e.PERIOD + at % e.PERIOD])


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def altered(rng, text, edits):
    out = list(text)
    for _ in range(edits):
        at = rng.randrange(len(out))
        rng.choice([lambda at: out.insert(at, "x"), lambda at: out.pop(at), lambda at: out.__setitem__(at, "y")])(at)
    return "".join(out)


def families(rng, count, chars):
    """Texts with copies a few edits away: (family, text)."""
    rows = []
    for k in range(count):
        base = "".join(rng.choices("abcdefghijklmnopqrst ", k=rng.randint(*chars)))
        rows += [(k, base)] + [(k, altered(rng, base, rng.randint(1, 1 + len(base) // 150))) for _ in range(rng.randrange(3))]
    return rows


@pytest.mark.parametrize("group", [2, 1024])
def test_links_equal_all_pairs_that_are_alike(documents, group):
    """With every pair compared, the classes are the same but for the pairs that no band brings together; groups are cut without a loss."""
    rng = random.Random(21)
    texts = [t for _, t in families(rng, 60, (200, 600))] + ["", "", "a", "ab"]
    prints = [e.fingerprints(texts, walk) for walk in range(e.WALKS)]
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if any(e.likeness(p[i], p[j]) >= 0.7 for p in prints):
                a, b = sorted((root[i], root[j]))
                root = [a if r == b else r for r in root]
    got = {r["doc_id"]: r["class_id"] for r in e.near_links(documents(list(enumerate(texts))), group=group).collect()}
    wrong = sum(got[i] != root[i] for i in range(len(texts)))
    assert len(set(root)) < len(texts) and wrong <= 0.03 * len(texts)
    assert all(root[got[i]] == root[i] for i in got)  # nothing is linked that is not alike


def test_near_pairs_by_edit_distance_are_found(documents):
    """Recall of pairs within one edit in a hundred characters, on both sides of class borders; unlike texts stay apart."""
    rng = random.Random(22)
    rows = families(rng, 40, (300, 560))
    ids = {i: k for i, (k, _) in enumerate(rows)}
    got = {r["doc_id"]: r["class_id"] for r in e.near_links(documents([(i, t) for i, (_, t) in enumerate(rows)])).collect()}
    near = [(i, j) for i in ids for j in range(i) if ids[i] == ids[j] and edit_distance(rows[i][1], rows[j][1]) <= len(rows[i][1]) // 100]
    assert len(near) > 25 and sum(got[i] == got[j] for i, j in near) >= 0.9 * len(near)
    assert all(ids[i] == ids[c] for i, c in got.items())


def test_near_links_of_awkward_rows(documents):
    got = e.near_links(documents(AWKWARD)).collect()
    assert sorted((r["doc_id"] or 0, r["class_id"]) for r in got if r["doc_id"] in (1, 2, 3)) == [(1, 1), (2, 1), (3, 3), (3, 3)]
    assert len(got) == len(AWKWARD) and e.near_links(documents([(1, "a")]).where("false")).collect() == []


def test_ranges_cut_an_id_that_many_rows_share(documents):
    rng = random.Random(8)
    borders = e.Borders([5, 9, 9, 9, 9, 12])
    at = e.np.array([1, 5, 9, 9, 9, 9, 13])
    tie = e.np.array([0, 0, -(1 << 63), -(1 << 62) - 1, 1, (1 << 63) - 1, 0])
    assert len(borders) == 6 and borders.below(at, tie).tolist() == [0, 1, 2, 2, 4, 5, 6]
    rows = [(7 if i % 3 else i + 100, "".join(rng.choices("abcdef ", k=60))) for i in range(120)] + [(None, f"text {i}") for i in range(60)]
    got = e.compared_with_next(documents(rows), piece_bytes=300).collect()
    single = e.compared_with_next(documents(rows), piece_bytes=1 << 20).collect()
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, single), key=str)
