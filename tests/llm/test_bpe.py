import hashlib
import random

import public_tokenizers
from flowsieve.llm import bpe

from .conftest import AWKWARD

RANKS, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def test_digests_and_round_trip(documents):
    rows = AWKWARD + [(20, "<|endoftext|> it's 12 o'clock"), (21, " " * 500 + "a")]
    outputs = ("n_tokens", "ids", "ids_sha256", "decoded", "decoded_sha256")
    got = bpe.tokenize(documents(rows), RANKS, PATTERN, outputs, keep=("doc_id", "n_chars", "Score")).collect()
    assert len(got) == len(rows)
    plain = bpe._encoding(RANKS, PATTERN)[0]
    texts = sorted((t or "") for _, t in rows)
    assert sorted(bytes(r["decoded"]).decode() for r in got) == texts
    for r in got:
        text = bytes(r["decoded"]).decode()
        assert r["ids"] == plain.encode_ordinary(text) and r["n_tokens"] == len(r["ids"])
        assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, r["ids"])).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()


def test_long_texts_are_cut_where_no_match_reaches():
    rng = random.Random(2)
    plain = bpe._encoding(RANKS, PATTERN)[0]
    parts = ["word", " ", "  ", "\n", "\n\n", "12", "'s", "'", "é", " ", "\x1c", "!?", "\t", "l'été", " x", "\r\n"]
    for _ in range(200):
        text = "".join(rng.choices(parts, k=300))
        assert "".join(bpe.stretches(text, 20)) == text
        assert bpe.encode_text(text, RANKS, PATTERN, long=20) == plain.encode_ordinary(text)


def test_stretches_without_a_safe_place():
    for text in ("a" * 90_000, " " * 2_000_000 + "a", "\n" * 100_000, "é!" * 50_000):
        ids = bpe.encode_text(text, RANKS, PATTERN)
        assert bpe.decode_ids(ids, RANKS, PATTERN).decode() == text
    assert bpe.encode_text(" " * 70_000 + "a", RANKS, PATTERN) == bpe._encoding(RANKS, PATTERN)[0].encode_ordinary(" " * 70_000 + "a")


def test_empty_table(documents):
    assert bpe.tokenize(documents([(1, "a")]).where("false"), RANKS, PATTERN).collect() == []
