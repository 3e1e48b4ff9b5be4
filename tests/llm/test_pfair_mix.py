"""Pfair mixing: no source is ever a block away from its weight, in blocks or in characters, and no row is lost."""

import math
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from foliospark.llm import pfair_mix as P


@settings(max_examples=60, deadline=None)
@given(st.lists(st.floats(1e-6, 10), min_size=1, max_size=12), st.integers(64, 2000))
def test_every_prefix_deviates_by_less_than_a_block(weights, n_slots):
    exact = P.whole_weights(weights)
    total = sum(exact)
    assert [Fraction(a, total) for a in exact] == [Fraction(w) / sum(map(Fraction, weights)) for w in weights]
    had = [0] * len(weights)
    for t, (i, j) in enumerate(P.schedule(exact, n_slots)):
        assert j == had[i] and j * total // exact[i] <= t < math.ceil(Fraction((j + 1) * total, exact[i]))
        had[i] += 1
        assert all(abs(Fraction(exact[s] * (t + 1), total) - had[s]) < 1 for s in range(len(weights)))


def test_a_million_slots_keep_to_the_true_weights():
    rng = np.random.default_rng(3)
    for weights in ([1e-6, 0.33333, 0.123456, 0.543213], rng.random(9).tolist(), (rng.random(40) ** 6).tolist()):
        n = 1_000_000
        who = np.fromiter((i for i, _ in P.schedule(P.whole_weights(weights), n)), np.int64, n)
        for s, w in enumerate(weights):
            had = np.cumsum(who == s)
            assert np.abs(had - w / math.fsum(weights) * np.arange(1, n + 1)).max() < 1 + 1e-6


def docs(spark, sizes, length=1000):
    rows = [(1000 * i + j, "x" * length, s) for i, (s, n) in enumerate(sizes.items()) for j in range(n)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, source string")


def off(got, weights, block):
    """The largest deviation in characters of a source from its weight's share of the slots so far, at any slot but the last, which is partly filled."""
    total = sum(weights.values())
    n = max(r.mix_slot for r in got) + 1
    had = {s: np.zeros(n) for s in weights}
    for r in got:
        had[r.source][r.mix_slot] += len(r.text or "")
    return {s: np.abs(np.cumsum(had[s])[:-1] - w / total * block * np.arange(1, n)).max(initial=0) for s, w in weights.items()}


def test_blocks_follow_the_schedule_and_no_row_is_lost(spark):
    own = docs(spark, {"a": 300, "b": 60, "c": 20})
    got = P.mix(own, block_chars=5000).collect()
    assert {r.doc_id for r in got} == {r.doc_id for r in own.collect()}
    weights = P.target_weights({"a": 300_000, "b": 60_000, "c": 20_000}, None, P.POWER)
    slots = {(("a", "b", "c")[i], j): t for t, (i, j) in enumerate(P.schedule(P.whole_weights(list(weights.values())), 10_000))}
    last = max(r.mix_slot for r in got)
    assert all(min(slots[r.source, r.mix_block], last) == r.mix_slot for r in got)
    assert [r.mix_slot for r in got] == sorted(r.mix_slot for r in got)
    assert set(Counter(r.doc_id for r in got if r.source == "a").values()) == {1}
    chars = Counter(r.source for r in got)
    for s, w in weights.items():
        assert abs(chars[s] / len(got) - w / sum(weights.values())) < 0.01
    assert max(off(got, weights, 5000).values()) < 5000 + 1000


@pytest.mark.parametrize("seed", range(4))
def test_texts_of_up_to_three_blocks_keep_to_random_weights(spark, seed):
    rng = np.random.default_rng(seed)
    weights = {s: float(rng.random() ** 3) + 1e-3 for s in "abcdef"}
    rows = [(i, "x" * int(rng.uniform(0.1, 3) * 200), "abcdef"[int(rng.integers(6))]) for i in range(900)]
    own = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    got = P.mix(own, weights, block_chars=200).collect()
    assert {r.doc_id for r in got if r.mix_epoch == 0} == set(range(900))
    assert max(off(got, weights, 200).values()) < 200 + 600


def test_given_weights(spark):
    own = docs(spark, {"a": 50, "b": 50, "c": 50})
    got = P.mix(own, {"a": 3, "b": 1, "c": 0, "absent": 5}, block_chars=1000).collect()
    count = Counter(r.source for r in got)
    assert set(count) == {"a", "b"} and count["a"] == 150 and count["b"] == 50
    with pytest.raises(ValueError):
        P.mix(own, {"a": -1})
    assert P.mix(own, {}).collect() == []


def test_a_single_source_and_a_single_block_come_once(spark):
    own = docs(spark, {"a": 7})
    for block in (100, 1500, 1 << 20):
        got = P.mix(own, block_chars=block).collect()
        assert sorted(r.doc_id for r in got) == list(range(7)) and {r.mix_epoch for r in got} == {0}


def test_rough_rows(rough, none):
    got = P.mix(rough, block_chars=1 << 20).collect()
    first = [r for r in got if r["mix_epoch"] == 0]
    assert sorted(((r[0], r[1]) for r in first), key=str) == sorted(((r[0], r[1]) for r in rough.collect()), key=str)
    assert P.stage(rough).columns == [c for c in rough.columns if c != "mix_slot"]
    assert P.mix(none).collect() == [] and P.stage(none).collect() == []


def test_shares_hold_in_characters_of_tiny_sources(spark):
    sizes = {"a": 2000, "b": 11, "c": 1}  # c is less than a block, b just more than one
    weights = {"a": 0.9, "b": 0.07, "c": 0.03}
    got = P.mix(docs(spark, sizes, length=100), weights, block_chars=1000).collect()
    chars = Counter()
    for r in got:
        chars[r.source] += len(r.text)
    assert {r.doc_id for r in got if r.mix_epoch == 0} == {1000 * i + j for i, n in enumerate(sizes.values()) for j in range(n)}
    for s, w in weights.items():
        assert abs(chars[s] - chars.total() * w) <= 200
    assert max(off(got, weights, 1000).values()) < 1000 + 100


def test_a_source_of_a_tiny_weight_comes_once(spark):
    got = P.mix(docs(spark, {"a": 1000, "b": 1}, length=100), {"a": 1, "b": 1e-4}, block_chars=1000).collect()
    assert Counter(r.source for r in got) == {"a": 10_000, "b": 1}  # the rarer source decides how long the mix is
    weights = {"a": 1, "b": 1e-3}
    got = P.mix(docs(spark, {"a": 1000, "b": 1}, length=100), weights, block_chars=1000).collect()
    assert Counter(r.source for r in got) == {"a": 1000, "b": 1} and max(off(got, weights, 1000).values()) < 1100


def test_shares_hold_in_characters_of_long_documents(spark):
    long = [(j, "x" * 1000, "long") for j in range(100)] + [(1000, "x" * 5500, "long")]
    rows = long + [(10_000 + j, "y" * 100, "short") for j in range(1000)] + [(20_000, "", "short"), (20_001, None, "short"), (20_002, "", "empty")]
    got = P.mix(spark.createDataFrame(rows, "doc_id bigint, text string, source string").fillna(""), {"long": 1, "short": 1, "empty": 1}, block_chars=1024).collect()
    worst = off(got, {"long": 1, "short": 1, "empty": 0}, 1024)
    assert worst["long"] < 1024 + 5500 and worst["short"] < 1024 + 100
    assert {r.doc_id for r in got if r.mix_epoch == 0} == {r[0] for r in rows}
    assert [(r.mix_slot, r.mix_epoch) for r in got if r.source == "empty"] == [(0, 0)]


def test_running_totals_go_over_buckets(spark, monkeypatch):
    monkeypatch.setattr(P, "BUCKET_CHARS", 700)
    monkeypatch.setattr(P, "BUCKET_ROWS", 50)
    rows = [(i, "x" * (i % 37), "ab"[i % 2]) for i in range(600)] + [(1000 + i, "", "e") for i in range(200)]
    own = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    made, _, _ = P.plan(own, None, 500, 1.0)
    ordered, buckets = P.starts(own, made, "text", "source")
    got = ordered.join(buckets.select("mix_number", "mix_bucket", "mix_before"), ["mix_number", "mix_bucket"]).collect()
    for s, n in (("a", 300), ("b", 300), ("e", 200)):
        mine = sorted((r.mix_before + r.mix_inside, r.mix_before + r.mix_inside + r.mix_length) for r in got if r.source == s)
        assert len(mine) == n and mine[0][0] == 0 and all(a[1] == b[0] for a, b in zip(mine, mine[1:]))
    assert len({r.mix_bucket for r in got if r.source == "e"}) > 2
    mixed = P.mix(own, block_chars=500).collect()
    assert {r.doc_id for r in mixed if r.mix_epoch == 0} == {r[0] for r in rows}
    weights = P.target_weights({s: sum(len(t) for _, t, x in rows if x == s) for s in "ab"}, None, P.POWER)
    assert max(off([r for r in mixed if r.source != "e"], weights, 500).values()) < 540
