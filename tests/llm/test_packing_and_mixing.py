from __future__ import annotations

import math
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from skeinflow.llm.mixing import capped_rate, mixture, plan_rates, poisson_steps, solve_rate
from skeinflow.llm.packing import best_fit_decreasing, bin_bound, pack
from skeinflow.llm.tokens import TOKENIZER, encoder, token_counts


def fewest(sizes, capacity):
    """The fewest bins, by trying everything."""
    best = [len(sizes)]

    def go(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(sizes):
            best[0] = len(bins)
            return
        for j in range(len(bins)):
            if bins[j] + sizes[i] <= capacity:
                go(i + 1, bins[:j] + [bins[j] + sizes[i]] + bins[j + 1 :])
        go(i + 1, [*bins, sizes[i]])

    go(0, [])
    return best[0] if sizes else 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=8), st.integers(20, 30))
def test_bound_and_packing(sizes, capacity):
    s = np.array(sizes, np.int64)
    where = best_fit_decreasing(s, capacity)
    fill = defaultdict(int)
    for w, n in zip(where.tolist(), sizes):
        fill[w] += n
    assert all(f <= capacity for f in fill.values())
    true = fewest(sizes, capacity)
    assert bin_bound(s, capacity) <= true <= len(fill) <= max(true, math.ceil(true * 11 / 9 + 1))


def packed(df):
    out = defaultdict(list)
    for r in df.collect():
        out[(r.container_kind, r.container_id)].append(r)
    return out


def test_documents_in_containers(spark):
    rng = np.random.default_rng(3)
    sizes = {i: int(n) for i, n in enumerate(rng.integers(0, 900, 800))} | {1000: 5000, 1001: 512, 1002: 1024}
    rows = [(i, n, "clash") for i, n in sizes.items()] + [(None, 5, ""), (2000, None, ""), (1000, 5000, "")]
    got = packed(pack(spark.createDataFrame(rows, "doc_id long, tokens long, kind string"), [("a", 512), ("b", 2048)], cell_items=100))
    for kind, capacity in (("a", 512), ("b", 2048)):
        spans = defaultdict(list)
        for (k, _), held in got.items():
            if k == kind:
                assert sum(r.tokens for r in held) <= capacity
                for r in held:
                    spans[r.doc_id].append((r.part_no, r.token_start, r.tokens))
        assert set(spans) == {i for i, n in sizes.items() if n > 0}
        for doc, parts in spans.items():
            parts.sort()
            assert len(parts) == math.ceil(sizes[doc] / capacity) and [p[0] for p in parts] == list(range(len(parts)))
            assert [p[1] for p in parts] == [i * capacity for i in range(len(parts))] and sum(p[2] for p in parts) == sizes[doc]
        used = sum(k == kind for k, _ in got)
        rest = [n % capacity for n in sizes.values() if n % capacity]
        least = bin_bound(np.array(rest), capacity) + sum(n // capacity for n in sizes.values())
        assert used <= least * 1.05 + 1


def test_packing_edges(spark):
    schema = "doc_id long, tokens long"
    assert pack(spark.createDataFrame([], schema), [("a", 5)]).count() == 0
    assert pack(spark.createDataFrame([(1, 0)], schema), [("a", 5)]).count() == 0
    with pytest.raises(ValueError):
        pack(spark.createDataFrame([(1, 1)], schema), [("a", 0)])


def test_tokens(spark):
    texts = ["Hello, world! it's", None, "", "é " * 3000]
    got = token_counts(spark.createDataFrame(list(enumerate(texts)), "i int, text string"), "text").orderBy("i").collect()
    enc = encoder(TOKENIZER)
    assert [r.tokens for r in got] == [len(enc.encode_ordinary(t)) if t else 0 for t in texts]
    assert enc.decode(enc.encode_ordinary(texts[3])) == texts[3]


@pytest.mark.parametrize(("rate", "cap"), [(0.1, 1), (0.9, 1), (1.5, 2), (2.9, 4)])
def test_capped_poisson(rate, cap):
    lam = solve_rate(rate, cap)
    assert capped_rate(lam, cap) == pytest.approx(rate, abs=1e-6)
    assert all(a <= b for a, b in zip(poisson_steps(lam, cap), poisson_steps(lam, cap)[1:]))


def test_plan():
    total, rates = plan_rates({"a": 100, "b": 1000, "x": 5}, {"a": (0.5, 2), "b": (0.25, 1), "gone": (0.25, 1)})
    assert total == pytest.approx(300) and rates == pytest.approx({"a": 2.0, "b": 0.1})
    assert plan_rates({}, {"a": (1.0, 1)}) == (0.0, {})


def test_mixture_reaches_its_shares(spark):
    rng = np.random.default_rng(5)
    rows = [(i, "abc"[min(2, i % 10)], int(n), "clash") for i, n in enumerate(rng.lognormal(5, 1, 6000))] + [(9001, None, 5, ""), (9002, "z", 5, ""), (9003, "a", 0, ""), (None, "a", 4, ""), (9004, "b", None, "")]
    targets = {"a": (0.3, 4), "b": (0.3, 2), "c": (0.2, 1), "none": (0.2, 3)}
    df = spark.createDataFrame(rows, "doc_id long, source string, tokens long, shuffle_key string")
    got = mixture(df, targets).collect()
    size, uses = defaultdict(int), defaultdict(int)
    for r in got:
        size[r.source] += r.tokens
        uses[r.doc_id] += 1
        assert r.copy_no <= targets[r.source][1]
    whole = sum(size.values())
    assert {s: n / whole for s, n in size.items()} == pytest.approx({"a": 0.375, "b": 0.375, "c": 0.25}, abs=0.01)
    assert [r.shuffle_key for r in got] == sorted(r.shuffle_key for r in got)
    assert values_of(mixture(df, targets)) == values_of(spark.createDataFrame(got))
    assert mixture(df.where("false"), targets).count() == 0 and mixture(df, {}).count() == 0


def values_of(df):
    return sorted(map(tuple, df.collect()))
