"""One scope of any size in parallel: how many scans of its pieces it takes, and that they change nothing."""

import random

import pytest
from conftest import verdicts
from flowsieve.operators import windowed as w
from flowsieve.operators.window_state import FifoWindow, FullFifoWindow


def arrivals_of(rng, rows, new, reach):
    """One scope's fingerprints: a share of first arrivals, repeats from among the last `reach` of those (None: from all, recent ones likelier)."""
    out, top = [], 0
    for _ in range(rows):
        if not top or rng.random() < new:
            out.append(top)
            top += 1
        elif reach is None:
            out.append(top - 1 - int(top ** rng.random() - 1))
        else:
            out.append(top - 1 - int(rng.random() * min(reach, top)))
    return [("hot", f"f{k:05d}") for k in out]


def fifo(pairs, window):
    return [x == 1 for x in FifoWindow(window).steps([f for _, f in pairs])]


@pytest.fixture
def rounds(monkeypatch):
    """How often pieces were scanned; the first scan counts."""
    count, read = [], w._read_summaries
    monkeypatch.setattr(w, "_read_summaries", lambda table: count.append(1) or read(table))
    return count


@pytest.mark.parametrize("reach", [6, 20, 22, 80, None])
def test_rounds_do_not_grow_with_pieces(arrivals, rounds, reach):
    """A third of the rows are first arrivals; repeats reach less far than the window, just as far, or farther."""
    window, taken = 20, {}
    pairs = arrivals_of(random.Random(reach), 16 * 24 * window, 1 / 3, reach)
    df = arrivals(pairs)
    want = fifo(pairs, window)
    for pieces in (4, 8, 16):
        rounds.clear()
        assert verdicts(w.dedupe_scoped_fifo(df, window, pieces=pieces)) == want
        taken[pieces] = len(rounds)
    assert max(taken.values()) <= 3, taken


def test_a_scan_again_ends_where_it_meets_the_first(arrivals, monkeypatch):
    """Of a long piece only the beginning is scanned a second time, whichever guess the first scan went on with."""
    from flowsieve.operators import window_state

    monkeypatch.setattr(window_state, "_Checks", type("Close", (window_state._Checks,), {"__init__": close_checks(window_state._Checks)}))
    for reach in (12, 200):
        written = []
        read = w._read_summaries
        monkeypatch.setattr(w, "_read_summaries", lambda table, read=read: written.append(table.where("kind = 1").count()) or read(table))
        pairs = arrivals_of(random.Random(reach), 24_000, 1 / 3, reach)
        assert verdicts(w.dedupe_scoped_fifo(arrivals(pairs), 20, pieces=4)) == fifo(pairs, 20)
        monkeypatch.setattr(w, "_read_summaries", read)
        assert written[0] == 24_000 and 0 < sum(written[1:]) < 6_000


def close_checks(base):
    def make(self, window, full):
        base.__init__(self, window, full)
        self.spacing = 100

    return make


@pytest.mark.parametrize("spacing", [1, 3, 50])
@pytest.mark.parametrize("seed", range(3))
def test_shared_numbers_and_any_checks_change_nothing(spark, monkeypatch, seed, spacing):
    """Rows that share an arrival number stay on one side of a check."""
    from flowsieve.operators import window_state

    def make(self, window, full):
        Base.__init__(self, window, full)
        self.spacing = spacing

    Base = window_state._Checks
    monkeypatch.setattr(window_state, "_Checks", type("Close", (Base,), {"__init__": make}))
    rng = random.Random(seed)
    pairs = arrivals_of(rng, 1_500, rng.choice([0.1, 0.4]), rng.choice([5, 14, 60]))
    seq, data = 0, []
    for _, f in pairs:
        seq += rng.choice([1, 1, 1, 2])
        data += [(seq, "hot", "", bytearray(f.encode()))] * rng.choice([1, 1, 1, 2])
    df = spark.createDataFrame(data, "seq bigint, tenant string, log_type string, fp binary")
    want = fifo([("hot", bytes(r[3]).hex()) for r in data], 10)
    kept = {r[0] for r, dup in zip(data, want) if not dup}
    got = w.dedupe_scoped_fifo(df, 10, pieces=6)
    assert {r["seq"] for r in got.where("not is_dup").collect()} == kept


@pytest.mark.parametrize("seed", range(4))
def test_any_mixture_equals_the_model(arrivals, seed):
    rng = random.Random(seed)
    pairs = []
    for _ in range(6):
        part = arrivals_of(rng, rng.randint(1, 400), rng.choice([0, 0.1, 0.5, 1]), rng.choice([3, 12, 40, None]))
        pairs += [(rng.choice(["hot", "hot", "b"]), f) for _, f in part for _ in range(rng.choice([1, 1, 1, 4]))]
    window = rng.choice([1, 2, 7, 12])
    want, windows = [], {}
    for scope, f in pairs:
        want += windows.setdefault(scope, FifoWindow(window)).steps([f])
    got = verdicts(w.dedupe_scoped_fifo(arrivals(pairs), window, pieces=rng.choice([2, 5, 9])))
    assert got == [x == 1 for x in want]


def test_a_full_window_equals_an_empty_one_where_the_scope_begins():
    pairs = arrivals_of(random.Random(3), 600, 0.3, 30)
    seen = set()
    firsts = [not (f in seen or seen.add(f)) for _, f in pairs]
    fps = [f for _, f in pairs]
    full, empty = FullFifoWindow(10), FifoWindow(10)
    assert full.first_steps(fps, firsts) == empty.steps(fps) and full.order == empty.order
