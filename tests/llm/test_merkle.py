import hashlib
import random
import zlib

import pytest
from flowsieve.llm.merkle import ALONE, LEFT, Tree, climb, versions
from pyspark.sql import functions as F

from .conftest import AWKWARD

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return h(*("-" if row[c] is None else f"{len(str(row[c]).encode())}:{row[c]}" for c in FIELDS))


def all_levels(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([h(*levels[-1][i : i + 2]) for i in range(0, len(levels[-1]), 2)])
    return levels


def brute_force(rows):
    keyed = sorted(rows, key=lambda r: (r["lang"] is not None, (r["lang"] or "").encode(), r["doc_id"] is not None, r["doc_id"] or 0, leaf(r)))
    langs = list(dict.fromkeys(r["lang"] for r in keyed))
    trees = [all_levels([leaf(r) for r in keyed if r["lang"] == g]) for g in langs]
    upper = all_levels([t[-1][0] for t in trees])
    out = []
    for g, tree in enumerate(trees):
        for at, row in enumerate(r for r in keyed if r["lang"] == langs[g]):
            tampered = row["doc_id"] is not None and zlib.crc32(str(row["doc_id"]).encode()) % 7 == 0
            bumped = {**row, "n_chars": row["n_chars"] + 1} if tampered and row["n_chars"] is not None else row
            proof, folded = [], leaf(bumped)
            for levels, start in ((tree, at), (upper, g)):
                for k, level in enumerate(levels[:-1]):
                    i = start >> k
                    pair = level[i & ~1 : (i | 1) + 1]
                    pair[i & 1] = folded
                    proof += [x for j, x in enumerate(pair) if j != i & 1]
                    folded = h(*pair)
            out.append((row["doc_id"], tree[0][at], tree[-1][0], upper[-1][0], h(*proof), folded, folded == upper[-1][0]))
    return sorted(out, key=repr)


def manifest(df, bits):
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    made = versions(df, FIELDS, "lang", "doc_id", tampered, {"n_chars": F.col("n_chars").cast("decimal(38,0)") + 1}, bits=bits)
    return made.collect()


def shown(rows):
    return sorted(
        ((r["doc_id"], r["leaf"].hex(), r["subroot"].hex(), r["root"].hex(), h(r["siblings"].hex()), r["version_root"].hex(), r["version_root"] == r["root"]) for r in rows), key=repr
    )


@pytest.mark.parametrize("bits", [1, 2, 5, 10])
def test_agrees_with_a_plain_tree(spark, documents, bits):
    rng = random.Random(bits)
    rows = [(rng.randrange(150) if rng.random() < 0.9 else None, f"text {i % 40}", rng.choice(["en"] * 6 + ["de", "fr", None, "é", "zz"]), rng.choice(["s", None])) for i in range(230)]
    rows += [(i, t, None, "src") for i, t in AWKWARD] + [(7_000, "alone", "only", "src")]
    df = documents(rows)
    assert shown(manifest(df, bits)) == brute_force([r.asDict() for r in df.collect()])


@pytest.mark.parametrize("n", [0, 1, 2, 3, 4, 5, 8, 9, 16, 17])
def test_one_group_of_any_size(spark, documents, n):
    df = documents([(i, f"t{i}") for i in range(n)] or [(1, "x")]).where(F.lit(n > 0))
    got = manifest(df, 2)
    assert shown(got) == brute_force([r.asDict() for r in df.collect()])


def test_versions_share_all_but_the_way_to_the_root(spark, documents):
    got = manifest(documents([(i, f"t{i}") for i in range(100)]), 3)
    changed = [r for r in got if zlib.crc32(str(r["doc_id"]).encode()) % 7 == 0]
    assert changed and all(r["copied"] == 8 and r["version_root"] != r["root"] for r in changed)
    assert len({r["version_root"] for r in changed}) == len(changed)
    assert all(r["copied"] == 0 and r["version_root"] == r["root"] for r in got if r not in changed)
    for r in got:
        text = r["siblings"].hex().encode()
        assert climb(r["leaf"].hex().encode(), [text[i : i + 64] for i in range(0, len(text), 64)], bytes(r["sides"])) == r["root"].hex().encode()


def test_a_version_leaves_the_tree_as_it_was():
    leaves = [h(str(i)).encode() for i in range(5)]
    tree = Tree(list(leaves), 3)
    before = [list(x) for x in tree.levels]
    copies = tree.version(3, h("new").encode())
    assert tree.levels == before and len(copies) == 4 and copies[-1] != tree.top
    assert Tree([*leaves[:3], h("new").encode(), leaves[4]], 3).top == copies[-1]
    siblings, sides = tree.way(4)
    assert list(sides) == [ALONE, ALONE, LEFT] and climb(leaves[4], siblings, sides) == tree.top
