import random

import numpy as np
import pytest
from flowsieve.llm import licenses as l

from .conftest import AWKWARD


def brute_force(body, containment=l.CONTAINMENT):
    """Licenses of which some stretch as wide as the windows contains enough shingles, for every start."""
    words, out = l.tokens(body), set()
    for kind in l.Scanner().classes:
        for start in range(max(1, len(words) - l.SHINGLE + 1)):
            own = l._shingles(words[start : start + kind.width])
            out |= {n for n, s in zip(kind.names, kind.shingles, strict=True) if np.isin(s, own).mean() >= containment}
    return out


def test_every_template_is_found_anywhere(documents):
    rng = random.Random(1)
    filler = lambda n: " ".join(rng.choices(["the", "license", "of", "lorem", "version", "use", "é"], k=n))
    rows, wanted = [], {}
    for name, texts in l.TEMPLATES.items():
        for text in texts:
            for n in (0, 7, 1000):
                i = len(rows) + 100
                rows.append((i, f"{filler(n)} // {text.upper().replace(' ', '  ')}.\n{filler(rng.randrange(40))}"))
                wanted[i] = name
    got = {r["doc_id"]: r["licenses"] for r in l.scan(documents(rows + AWKWARD)).collect() if r["doc_id"] in wanted or r["licenses"]}
    assert set(got) == set(wanted)
    for i, name in wanted.items():
        assert name in {m["license"] for m in got[i]}


@pytest.mark.parametrize("seed", range(3))
def test_agrees_with_brute_force(seed):
    rng = random.Random(seed)
    scanner = l.Scanner()
    texts = [t for ts in l.TEMPLATES.values() for t in ts]
    for _ in range(40):
        words = rng.choices(["of", "the", "and", "x"], k=rng.randrange(30))
        piece = rng.choice(texts).split()
        for _ in range(rng.randrange(3)):
            piece[rng.randrange(len(piece))] = "changed"
        body = " ".join(words + piece + words[::-1]).encode()
        found = {m[0] for m in scanner.scan(body)}
        must = set()
        for name, own in l.TEMPLATES.items():
            for t in own:
                shingles = np.unique(l._shingles(l.tokens(t.encode())))
                if np.isin(shingles, l._shingles(l.tokens(" ".join(piece).encode()))).mean() >= l.CONTAINMENT:
                    must.add(name)
        assert must <= found <= brute_force(body)


def test_no_license_no_match(documents):
    rows = AWKWARD + [(50, "licensed under the moon, this work is a song"), (51, "MIT license")]
    assert all(r["licenses"] == [] for r in l.scan(documents(rows)).collect())
    assert l.scan(documents([(1, "a")]).where("false")).collect() == []


def test_sibling_licenses_are_told_apart():
    from flowsieve.llm.licenses import TEMPLATES, Scanner

    scanner = Scanner()
    for name, texts in TEMPLATES.items():
        for text in texts:
            for body in (text, f"# Some words before. {text}. And some words behind it, of the file."):
                assert {m[0] for m in scanner.licenses(body.encode())} == {name}, (name, text)
    unlisted = "This work is licensed under the GNU General Public License, version 1"
    assert not scanner.licenses(unlisted.encode())
    assert not scanner.licenses(b"This work is licensed under a Creative Commons Attribution 3.0 International License")
    both = "Licensed under CC BY-SA 4.0. Released under the MIT License. Licensed under the Apache License, Version 2.0"
    assert {m[0] for m in scanner.licenses(both.encode())} == {"CC-BY-SA-4.0", "MIT", "Apache-2.0"}
    three = TEMPLATES["BSD-2-Clause"][0].replace("This software is", "Neither the name of the copyright holder nor the names of its contributors may be used. This software is")
    assert {m[0] for m in scanner.licenses(three.encode())} == {"BSD-3-Clause"}


@pytest.mark.parametrize("seed", range(3))
def test_licenses_equal_those_without_retrieval(seed, monkeypatch):
    """What the query uses, against every template compared with every window."""
    rng = random.Random(100 + seed)
    texts = [t for ts in l.TEMPLATES.values() for t in ts]
    bodies = []
    for _ in range(25):
        words = rng.choices(["of", "the", "and", "software", "x"], k=rng.randrange(80))
        for _ in range(rng.randint(1, 3)):
            piece = rng.choice(texts).split()
            for _ in range(rng.choice([0, 0, len(piece) // 60, len(piece) // 25])):
                piece[rng.randrange(len(piece))] = "changed"
            words += piece + rng.choices(["of", "the", "notice"], k=rng.randrange(30))
        bodies.append(" ".join(words).encode())
    scanner = l.Scanner()
    got = [scanner.licenses(b) for b in bodies]
    monkeypatch.setattr(l.TemplateClass, "retrieve", lambda self, shingles: set(range(len(self.names))))
    assert got == [scanner.licenses(b) for b in bodies] and sum(map(len, got)) > 25


def test_whole_texts_as_they_stand_in_files():
    scanner = l.Scanner()
    for name, texts in l.WHOLE_TEXTS.items():
        for text in texts:
            lines = [" * " + " ".join(text.split()[i : i + 11]) for i in range(0, len(text.split()), 11)]
            body = "/*\n * Copyright (c) 2020 Some Holder. All rights reserved.\n" + "\n".join(lines) + "\n */\nint main(void) { return 0; }\n"
            found = scanner.licenses(body.encode())
            assert {m[0] for m in found} == {name} and max(m[3] for m in found) == 1.0
