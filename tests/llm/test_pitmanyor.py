import numpy as np
import pytest

from quern.llm import pitmanyor


def tree(seed: int, n: int = 3000) -> pitmanyor.Tree:
    r = np.random.default_rng(seed)
    words = pitmanyor._mix(np.arange(40, dtype=np.uint64))
    u, w = words[r.integers(0, 6, n)], words[np.minimum(r.geometric(0.2, n), 39)]
    return pitmanyor.Tree(u, r.integers(0, 4, n).astype(np.uint32), r.integers(0, 3, n).astype(np.uint16), w, r.random(n) < 0.9)


@pytest.mark.parametrize("seed", [1, 2])
def test_shares_kept_between_sweeps_give_the_predictive_probabilities(seed):
    t = tree(seed)
    root = np.full(len(t.words), 1 / (len(t.words) + 1))
    for _ in range(4):
        t.sweep(root)
        p = root
        for k in range(3):
            p = pitmanyor.predict(t.c[k], t.t[k], t.all_c[k][t.rest[k]], t.all_t[k][t.rest[k]], p[t.up[k]], pitmanyor.LEVELS[k])
        assert np.allclose(t.chances(root), p, rtol=1e-12, atol=0)
    seats = t.seats()
    again = tree(seed)
    again.chances(root)  # of other seats than those taken
    again.take(*seats, 4)
    assert (again.chances(root) == t.chances(root)).all()
    assert t.shares is not None  # kept, not reckoned anew for every dish


def test_sweeps_in_a_row_are_as_one_by_one():
    one, row = tree(3), tree(3)
    root = np.full(len(one.words), 0.02)
    for _ in range(4):
        one.sweep(root)
    row.sweep(root, times=4)
    assert one.seats() == row.seats() and (one.chances(root) == row.chances(root)).all()


def test_stretches_draw_the_first_customers_at_once(monkeypatch):
    """The same draws as one by one; their hashes are made together, not in 63 calls."""
    key, c = pitmanyor._mix(np.arange(2500, dtype=np.uint64)), np.random.default_rng(5).integers(1, 300, 2500)
    c[7] = 5000
    rest, base, d, s, no = np.full(len(c), 50.0), np.full(len(c), 0.01), 0.75, 1.0, 3
    want = np.ones(len(c))
    for k in range(1, 64):
        fresh = (s + d * (rest + want)) * base
        want += (pitmanyor._chance(key, no * 8192 + k) < fresh / (fresh + np.maximum(k - d * want, 1e-9))) & (c > k)
    few = c <= 64
    assert (pitmanyor._stretches(key, no, c, rest, base, d, s)[few] == want[few]).all()
    calls, mix = [], pitmanyor._mix
    monkeypatch.setattr(pitmanyor, "_mix", lambda x: calls.append(len(x)) or mix(x))
    pitmanyor._stretches(key[7:8], no, c[7:8], rest[:1], base[:1], d, s)
    assert len(calls) < 12


def test_means_are_summed_where_seats_change(monkeypatch):
    """As the mean of chances() after each sweep; the dishes that no sweep changes are reckoned once, not after each."""
    one, mean = tree(4), tree(4)
    root, want = np.full(len(one.words), 0.02), 0.0
    for t in (one, mean):
        t.sweep(root, times=2)
    for _ in range(5):
        one.sweep(root)
        want = want + one.chances(root) / 5
    calls, share = [], pitmanyor.Tree._share
    monkeypatch.setattr(pitmanyor.Tree, "_share", lambda self, k, at: calls.append(k) or share(self, k, at))
    assert np.allclose(mean.mean(root, 5), want, rtol=1e-12, atol=0)
    assert sorted(calls) == [0, 1, 2]
    assert mean.seats() == one.seats() and all((a == b).all() for a, b in zip(mean.all_c + mean.all_t, one.all_c + one.all_t))


def test_dishes_stand_by_restaurant_and_restaurants_by_parent():
    t = tree(5)
    for k in range(3):
        assert (np.diff(t.rest[k]) >= 0).all() and len(t.rooms[k]) == t.rest[k][-1] + 1
        assert k == 0 or (np.diff(t.rest[k - 1][t.up[k]]) >= 0).all()
    assert (t._said(2)[t.leaf] == t.spoken()).all() and (t.up[0][t.up[1][t.up[2]]] == t._said(2)).all()


@pytest.mark.parametrize("wide", [10, 31])  # with room for places below the pairs, and without
def test_pairs_of_numbers_in_order(wide):
    r = np.random.default_rng(6)
    high, low = r.integers(0, 1 << 30, 5000)[r.integers(0, 900, 5000)], r.integers(0, 1 << wide, 7)[r.integers(0, 7, 5000)]
    both, order = pitmanyor._pairs(high, low, wide)
    assert (order == np.lexsort((low, high))).all() and (both == (high[order].astype(np.uint64) << np.uint64(wide) | low[order].astype(np.uint64))).all()
    some, place = pitmanyor._news(both)
    assert (some == np.unique(both)).all() and (some[place] == both).all()


def test_first_round_counts_tokens_and_contexts():
    from collections import Counter

    import pyarrow as pa
    from pyspark import TaskContext

    class Task:
        partitionId = staticmethod(lambda: 0)  # noqa: N815

    texts = ["a b a b c", "b a a", "c d", "a b"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(4)), pa.array(texts), pa.array([False, False, True, False]), pa.array([0] * 4)], names=["id", "text", "held", "sign"])
    get, TaskContext.get = TaskContext.get, staticmethod(lambda: Task)
    try:
        rows = [b.to_pandas() for b in pitmanyor._deal(np.arange(1), pitmanyor.Hot(np.zeros(0, np.uint64), np.zeros(0, np.int64), 1 << 18), False)([batch])]
    finally:
        TaskContext.get = get
    asked = pitmanyor._ask(3)((0,), rows[0])
    got = {}
    for r in asked.itertuples():
        got |= dict(zip(pitmanyor._uncut(r.words, pitmanyor.WORD).tolist(), zip(pitmanyor._unpack(r.c, np.int64, r.n).tolist(), pitmanyor._unpack(r.m, np.int64, r.n).tolist())))
    words = dict(zip("abcd", pitmanyor._hashes(pa.array(list("abcd"))).tolist())) | {"": pitmanyor.END}
    tokens, pairs = Counter(), set()
    for text, held in zip(texts, [0, 0, 1, 0]):
        row = ["", *text.split(), ""]
        tokens.update({} if held else row[1:])
        pairs |= set() if held else set(zip(row, row[1:]))
    assert got == {h: (tokens[w], sum(b == w for _, b in pairs)) for w, h in words.items()}


def test_marks_tell_tokens_apart():
    import pyarrow as pa

    words = [*("a" * n for n in range(1, 40)), *("a" * k + "b" + "a" * (n - k) for n in (14, 15, 16, 24) for k in range(n + 1)), "é", "e", "ab", "ba"]
    marks = pitmanyor._marks(pa.array(words))
    assert len(set(words)) == len(words) == len(np.unique(marks))
    assert (pitmanyor._marks(pa.array(words), 7) == marks).all() and (pitmanyor._marks(pa.array(["x", *words], pa.large_string()).slice(1)) == marks).all()
    assert len(pitmanyor._marks(pa.array([], pa.string()))) == 0
