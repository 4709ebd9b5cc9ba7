"""Common subsequences of many pairs at once, against the textbook recurrence."""

import numpy as np

from effnum.operators import sequences


def _table(a, b):
    line = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(line[j] + 1 if x == y else max(line[j + 1], new[-1]))
        line = new
    return line[-1]


def _laid_out(seqs):
    sizes = np.array([len(s) for s in seqs], np.int64)
    return np.concatenate([np.asarray(s, np.int64) for s in seqs]), np.cumsum(sizes) - sizes, sizes


def test_lanes_equal_the_recurrence():
    rng = np.random.default_rng(3)
    for symbols in (1, 4, 31, 700):
        seqs = [rng.integers(0, symbols, n) for n in rng.integers(1, 140, 30)]
        codes, starts, sizes = _laid_out(seqs)
        left, right = np.triu_indices(len(seqs), 1)
        got = sequences._score_lanes(codes, starts, sizes, left, right)
        assert got.tolist() == [_table(seqs[a], seqs[b]) for a, b in zip(left, right)]


def test_many_pairs_of_like_sizes_share_words(monkeypatch):
    rng = np.random.default_rng(4)
    seqs = [rng.integers(0, 3, n) for n in [*rng.integers(60, 70, 120), 0, 1, 400]]
    codes, starts, sizes = _laid_out(seqs)
    left, right = np.triu_indices(len(seqs), 1)
    shared = []
    lanes = sequences._score_lanes
    monkeypatch.setattr(sequences, "_score_lanes", lambda *a: shared.append(len(a[3])) or lanes(*a))
    monkeypatch.setattr(sequences, "CELLS", 2048)
    got = sequences._common_lengths(codes, starts, sizes, left, right)
    assert sum(shared) > 0.9 * len(left)
    some = rng.choice(len(left), 300)
    assert got[some].tolist() == [_table(seqs[a], seqs[b]) for a, b in zip(left[some], right[some])]
