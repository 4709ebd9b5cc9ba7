"""The page labeller on a very long page among short ones."""

import tracemalloc

import numpy as np

from effnum.llm import html_blocks as hb


def test_a_long_page_runs_alone_and_in_bounded_memory():
    rng = np.random.default_rng(1)
    width = hb.PATH_DIM + hb.WORD_DIM + hb.COUNTS
    pages = [rng.normal(size=(n, width)).astype(np.float32) for n in [30] * 40 + [0] + [25] * 23 + [40000]]
    parts = hb.batches(pages, 64)
    assert sorted(i for p in parts for i in p) == list(range(len(pages)))
    assert [64] in parts and all(len(p) * len(pages[p[-1]]) <= hb.CELLS for p in parts)
    model = hb.Labeller()
    tracemalloc.start()
    kept = model.keep(pages)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [len(k) for k in kept] == [len(p) for p in pages]
    assert peak < 400 << 20
    for i in (0, 50, 64):
        alone = model.keep([pages[i]])[0]
        assert (alone == kept[i]).all()


def test_pages_without_blocks():
    width = hb.PATH_DIM + hb.WORD_DIM + hb.COUNTS
    assert hb.batches([], 64) == [] and hb.Labeller().keep([]) == []
    assert [len(k) for k in hb.Labeller().keep([np.zeros((0, width), np.float32)] * 2)] == [0, 0]
