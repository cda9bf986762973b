from __future__ import annotations

import random

from hypothesis import given
from hypothesis import strategies as st

from tessera.llm.packing import BestFit, pack


@given(st.lists(st.integers(0, 64), max_size=200), st.integers(1, 8))
def test_best_fit_keeps_the_bound(sizes, open_bins):
    fit, used, spaces = BestFit(64, open_bins), {}, {}
    for size in sizes:
        before = {s: len(b) for s, b in fit.bins.items()}
        b = fit.place(size)
        used[b] = used.get(b, 0) + size
        assert used[b] <= 64 and fit.open <= open_bins
        fits = [s for s in before if s >= size]
        if fits:  # the tightest open bin took it
            assert 64 - used[b] == min(fits) - size
        assert {s for s in range(65) if fit.free >> s & 1} == set(fit.bins)
    del spaces


def test_whole_texts_and_fill(spark):
    r = random.Random(1)
    sizes = [(i, min(20_000, int(r.lognormvariate(5, 1)))) for i in range(4000)] + [(9001, None), (9002, 0), (9003, 512), (9003, 512), (None, 7)]
    df = spark.createDataFrame([(*s, "x") for s in sizes], "doc_id bigint, tokens bigint, part string")
    for per_task in (1_000, 50_000):
        rows = pack(df, [("a", 512), ("b", 2048), ("none", None), ("zero", 0)], items_per_task=per_task).collect()
        for name, cap in (("a", 512), ("b", 2048)):
            mine = [x for x in rows if x["container"] == name]
            fill: dict = {}
            for x in mine:
                fill[x["bin_id"]] = fill.get(x["bin_id"], 0) + x["tokens"]
                assert x["n_pieces"] == 1 or x["tokens"] == cap or x["piece"] == x["n_pieces"] - 1
            assert max(fill.values()) <= cap
            assert sum(x["tokens"] for x in mine) == sum(s or 0 for _, s in sizes)
            assert len({x["doc_id"] for x in mine}) == len({i for i, _ in sizes})
            assert all(x["n_pieces"] == 1 for x in mine if dict(sizes).get(x["doc_id"]) is not None and dict(sizes)[x["doc_id"]] <= cap)
            assert sum(fill.values()) / (cap * len(fill)) > 0.97
        assert {x["container"] for x in rows} == {"a", "b"}


def test_same_bins_again_and_empty(spark):
    df = spark.createDataFrame([(i, i % 300) for i in range(3000)], "doc_id bigint, tokens bigint")
    a, b = (sorted(map(tuple, pack(df.repartition(n), [("a", 512)], items_per_task=700).collect())) for n in (1, 7))
    assert a == b
    assert pack(df.limit(0), [("a", 512)]).count() == 0 and pack(df, []).count() == 0


def test_repeats_of_one_row_spread(spark):
    """A row that stands in the table many times fills the bins of several tasks, each of them whole."""
    df = spark.createDataFrame([(7, 3)] * 4000, "doc_id long, tokens long")
    rows = pack(df, [("a", 9)], items_per_task=500).collect()
    assert len(rows) == 4000 and {r["tokens"] for r in rows} == {3}
    assert len({r["bin_id"] >> 36 for r in rows}) >= 6 and len({r["bin_id"] for r in rows}) <= 4000 / 3 + 8
