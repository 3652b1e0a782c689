import random
from collections import Counter

import numpy as np
import pytest
from helpers import clashing, docs, plain

from millrace.llm import mixing


def wanted_targets(sizes, weights=(5, 2, 1), share=1.5, limit=2.0):
    """Fill by hand: cap, share the excess again by weight until none is above."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    rest, left, out = share * sum(sizes.values()), set(names), {}
    while left:
        level = rest / sum(weight[s] for s in left)
        full = {s for s in left if weight[s] * level > limit * sizes[s]}
        for s in full:
            out[s] = limit * sizes[s]
            rest -= out[s]
        left -= full
        if not full:
            out |= {s: weight[s] * level for s in left}
            break
    return out


def corpus(rng, n=900):
    sources = ["b", "a", "Z", "é", None, "hot", "tiny"]
    rows = []
    for i in range(n):
        s = "hot" if rng.random() < 0.4 else rng.choice(sources[:-1])
        rows.append((i, " ".join(["w"] * rng.randint(0, 40)), s))
    return [*rows, (n, "w w", "tiny"), (n + 1, None, "a"), (n + 2, "w " * 5000, "b")]


def test_targets_and_taken(spark):
    rows = corpus(random.Random(3))
    df = docs(spark, rows)
    out = mixing.mix_report(df).join(df.select("doc_id", "source"), "doc_id").collect()
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len((t or "").split())
    targets = wanted_targets(sizes)
    taken, largest = Counter(), Counter()
    for r in out:
        assert r.size == len((rows[r.doc_id][1] or "").split())
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(targets[r.source])
        assert r.taken in (0, r.size, 2 * r.size)
        taken[r.source] += r.taken
        largest[r.source] = max(largest[r.source], r.size)
    assert len(out) == len(rows)
    for s in sizes:
        assert abs(taken[s] - targets[s]) <= largest[s] + 1e-6


def test_tree_of_several_levels_and_reruns(spark, monkeypatch):
    rows = corpus(random.Random(5))
    monkeypatch.setattr(mixing, "LEAF_ROWS", 8)
    monkeypatch.setattr(mixing, "FAN_IN", 3)
    df = docs(spark, rows)
    first = plain(mixing.mix_report(df).select("doc_id", "taken"))
    again = plain(mixing.mix_report(df.orderBy("text").repartition(7)).select("doc_id", "taken"))
    assert first == again and len(first) == len(rows)
    total = sum(t for _, t in first)
    words = sum(len((t or "").split()) for _, t, _ in rows)
    assert abs(total - 1.5 * words) <= 7 * 5000


def test_rounding_keeps_mass_and_expectations():
    size, part = np.array([5.0, 3.0, 8.0, 1.0, 4.0]), np.array([0.2, 0.7, 0.5, 0.9, 0.4])
    rng, full = np.random.default_rng(0), np.zeros(5)
    for _ in range(4000):
        mass = part * size
        state, held = mixing._round(mass, size, rng.random(5))
        assert mass.sum() == pytest.approx((part * size).sum())
        assert (state < 0).sum() <= 1 and (held < 0 or state[held] == -1)
        full += np.where(state >= 0, state, mass / size)
    assert np.allclose(full / 4000, part, atol=0.03)


def test_mix_repeats_rows_and_keeps_columns(spark):
    df = clashing(docs(spark, [(1, "a b", "s"), (1, "a b", "s"), (None, "c", None), (3, None, "s"), (4, "d", "z")]))
    out = mixing.mix(df)
    assert out.columns == df.columns
    report = mixing.mix_report(df)
    assert report.count() == 5
    n = sum(t // s for s, t in plain(report.select("size", "taken")) if s)
    assert out.filter("length(text) > 0").count() == n
    assert mixing.mix(docs(spark, [])).count() == 0 and mixing.mix_report(docs(spark, [])).count() == 0


def test_every_size_keeps_its_expectation_over_seeds(spark, monkeypatch):
    monkeypatch.setattr(mixing, "LEAF_ROWS", 16)
    monkeypatch.setattr(mixing, "FAN_IN", 3)
    rows = [(i, s, z) for i in range(400) for s, z in (("a", 50 if i % 2 else 400), ("b", 7))]
    df = spark.createDataFrame(rows, "id long, source string, size long")
    for share in (0.3, 0.7):
        taken, seen = Counter(), Counter()
        for seed in range(100, 112):
            out = mixing.copies(df, weights=(1, 1e-6), share=share, limit=5.0, seed=seed).filter("source = 'a'")
            for r in out.groupBy("size").sum("copies").collect():
                taken[r.size] += r[1]
                seen[r.size] += 200
        expected = share * sum(z for *_, z in rows) / sum(z for _, s, z in rows if s == "a")
        for z in (50, 400):  # 2400 draws, negatively dependent: four standard errors at most
            assert abs(taken[z] / seen[z] - expected) < 0.04


def test_leaves_draw_apart_from_their_order():
    rng = np.random.default_rng(3)
    sizes, part, n = np.tile([50, 400], 200), 0.3, 400
    full = Counter()
    for _ in range(300):
        pdf = mixing.pd.DataFrame({
            "bucket": 0, "id": np.arange(n), "source": "a", "size": sizes, "n": 1, "whole": 0, "part": part,
            "turn": rng.permutation(n), "draw": rng.random(n),
        })
        out = mixing._leaf(pdf)
        assert abs(out.mass.sum() - part * sizes.sum()) < 1e-6
        for z in (50, 400):
            full[z] += int((out.state[out["size"] == z] == 1).sum())
    assert all(abs(full[z] / (300 * 200) - part) < 0.006 for z in (50, 400))
