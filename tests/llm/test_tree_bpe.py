import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from flowsieve.llm import tree_bpe
from pyspark.sql import functions as F

from .conftest import AWKWARD

FILE = public_tokenizers.path("byte_bpe_50k.json")
KINDS = ["ab", "aA1", "  \n\t x", " '", "'sll rve", "日本語テキスト", "é🙂👩‍👩‍👧 a", "!?.'-", "0123 456", "<|endoftext|>", "   ​", "the quick international ", "\r\n \n"]


def any_text(rng, most=12):
    text = ""
    for _ in range(rng.randint(1, most)):
        kind, r = rng.choice(KINDS), rng.random()
        if r < 0.35:
            text += "".join(rng.choice(kind) for _ in range(rng.randint(1, 400)))
        elif r < 0.55:
            text += rng.choice(kind) * rng.randint(1, 300)
        else:
            text += kind * (rng.randint(1, 40) if r < 0.7 else 1)
    return text


@pytest.mark.parametrize("seed", range(8))
def test_any_cut_gives_the_librarys_tokens(seed):
    rng = random.Random(seed)
    for _ in range(60):
        text, part = any_text(rng), rng.choice([3, 17, 50, 200])
        whole = tree_bpe.concatenated_all([tree_bpe.encode_part(x, FILE) for x in tree_bpe.halves(text, part)], FILE, window=rng.choice([1, 4, 64]))
        alone = tree_bpe.encode_part(text, FILE)
        assert whole.text == text and np.array_equal(whole.ids, alone.ids) and np.array_equal(whole.at, alone.at) and np.array_equal(whole.starts, alone.starts)
        decoded = tree_bpe._tokenizer(FILE).decode(alone.ids.tolist(), skip_special_tokens=False)
        assert "".join(tree_bpe.decode_ids(whole.ids.tolist(), FILE)) == decoded


def test_one_long_word_needs_small_windows(monkeypatch):
    rng = random.Random(5)
    text = "".join(rng.choice("etaoinshrdlu") for _ in range(40_000))
    parts = [tree_bpe.encode_part(x, FILE) for x in tree_bpe.halves(text, 5_000)]
    seen, encode = [], tree_bpe.encode_part
    monkeypatch.setattr(tree_bpe, "encode_part", lambda t, f: seen.append(len(t)) or encode(t, f))
    whole = tree_bpe.concatenated_all(parts, FILE)
    assert whole.ids.tolist() == tree_bpe._tokenizer(FILE).encode(text, add_special_tokens=False).ids
    assert len(seen) >= 7 and max(seen) < 4_000


def test_settled_characters_are_of_one_kind_for_both():
    """Every character that texts are split by here: the library splits alike beside a letter, a number, a mark and a blank."""
    import re

    words, pre = tree_bpe.Words(FILE), tree_bpe._tokenizer(FILE).pre_tokenizer.pre_tokenize_str
    settled = re.compile(f"[{tree_bpe._SETTLED}]")
    seen = 0
    for point in range(0x110000):
        c = chr(point)
        if settled.match(c):
            text = f"a{c}1{c}!{c} {c}{c}\n{c}'s{c}"
            spans, at = [], 0
            for w in words.split(text):
                spans.append((at, at + len(w)))
                at += len(w)
            assert [o for _, o in pre(text)] == spans, hex(point)
            seen += 1
    assert seen > 30_000 and words.split("\u0558") is None and words.split("x<|endoftext|>") is None


@pytest.mark.parametrize("most", [1 << 19, 50])
def test_remembered_words_give_the_librarys_tokens(monkeypatch, most):
    monkeypatch.setattr(tree_bpe, "_REMEMBERED", most)
    rng = random.Random(most)
    words = tree_bpe.Words(FILE)
    monkeypatch.setattr(tree_bpe, "_words", lambda file: words)
    for _ in range(6):
        texts = ["", *(any_text(rng) for _ in range(40)), "ß ĳ ŉ ǆ Ω ж \x85 \xa0\xa0x \x1c\x1f.", "\u0558 new"]
        made = tree_bpe.encode_texts(texts, FILE)
        assert [m.tolist() for m in made] == [e.ids for e in tree_bpe._tokenizer(FILE).encode_batch(texts, add_special_tokens=False)]
    assert words.usable and len(words._known) > 0


def test_decoding_any_ids_is_the_librarys(monkeypatch):
    rng = random.Random(3)
    ids = [rng.randrange(50_257) for _ in range(20_000)] + list(range(300))
    expected = tree_bpe._tokenizer(FILE).decode(ids, skip_special_tokens=False)
    assert "".join(tree_bpe.decode_ids(ids, FILE)) == expected
    monkeypatch.setattr(tree_bpe, "_DECODED_AT_ONCE", 7)
    assert "".join(tree_bpe.decode_ids(ids, FILE)) == expected


def expected(rows):
    tokenizer = tree_bpe._tokenizer(FILE)
    out = []
    for i, text in rows:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids
        back = tokenizer.decode(ids, skip_special_tokens=False)
        out.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()))
    return sorted(out, key=repr)


def test_rows_long_and_short(spark, documents):
    rng = random.Random(1)
    rows = AWKWARD + [(100 + i, any_text(rng, 30)) for i in range(30)] + [(200, "a<|endoftext|>b " * 3_000)] * 3 + [(201, " " * 50_000 + "x"), (202, "日本" * 20_000)]
    outputs = ("n_tokens", "ids_sha256", "decoded_sha256")
    got = tree_bpe.tokenize(documents(rows), FILE, outputs=outputs, keep=("doc_id",), long=2_000, part=700).collect()
    assert sorted(map(tuple, got), key=repr) == expected(rows)


def test_other_columns_stay_and_ids_come_back(spark, documents):
    df = documents([*AWKWARD, (9, "one two " * 9_000)]).withColumns({"_row": F.lit("r"), "IDS": F.lit(1), "_place": F.lit(2), "_kept0": F.lit(3)})
    got = tree_bpe.tokenize(df, FILE, outputs=("n_tokens", "ids", "decoded"))
    assert [c for c in got.columns if c not in ("n_tokens", "ids", "decoded")] == [c for c in df.columns if c != "IDS"]
    for r in got.collect():
        assert r["decoded"] == (r["text"] or "") and len(r["ids"]) == r["n_tokens"] and (r["_row"], r["_place"], r["_kept0"]) == ("r", 2, 3)
    assert tree_bpe.tokenize(df.where("false"), FILE).collect() == []
