import numpy as np
from helpers import plain

from millrace.llm import near_vectors
from millrace.llm.components import components


def brute(rows, min_cosine=0.93):
    usable = {}
    for n, (i, v, label) in enumerate(rows):
        if i is None or label is None or not v or any(x is None or not np.isfinite(x) for x in v) or not any(v):
            continue
        x = np.array(v, np.float32).astype(float)
        usable[n] = (i, x / np.linalg.norm(x), label)
    links = {n: 0 for n in range(len(rows))}
    root = {i: i for i, _, _ in rows if i is not None}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, (i, x, lx) in usable.items():
        for b, (j, y, ly) in usable.items():
            if a != b and lx == ly and len(x) == len(y) and x @ y >= min_cosine:
                links[a] += 1
                p, q = find(i), find(j)
                root[max(p, q)] = min(p, q)
    return sorted(((rows[n][0], links[n], None if rows[n][0] is None else find(rows[n][0])) for n in links), key=repr)


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")


def sample(rng, n=400, dim=16, near=0.6):
    rows, kept = [], []
    for i in range(n):
        if kept and rng.random() < near:
            x = kept[rng.integers(len(kept))] + rng.standard_normal(dim) * rng.choice([0.02, 0.05, 0.09])
        else:
            x = rng.standard_normal(dim)
            kept.append(x)
        rows.append((i * 3, [float(v) for v in x.astype(np.float32)], int(rng.integers(0, 3))))
    return rows


def test_links_components_and_recall(spark):
    rows = sample(np.random.default_rng(5))
    rows += [(2000, rows[0][1], rows[0][2]), (2001, rows[0][1], rows[0][2]), (2002, rows[1][1], None)]
    wanted = brute(rows)
    got = plain(near_vectors.near_vectors(frame(spark, rows)).select("vec_id", "n_links", "component_id"))
    found, there = sum(n for _, n, _ in got), sum(n for _, n, _ in wanted)
    assert all(a[1] <= b[1] for a, b in zip(got, wanted))
    assert found >= 0.99 * there > 300
    if found == there:
        assert got == wanted


def test_large_cells_are_verified_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(near_vectors, "BLOCK_ROWS", 16)
    rng = np.random.default_rng(2)
    centre = rng.standard_normal(8)
    rows = [(i, [float(v) for v in centre + rng.standard_normal(8) * 0.25], 1) for i in range(150)]
    rows += [(500 + i, [float(v) for v in rng.standard_normal(8)], 1) for i in range(20)]
    got = plain(near_vectors.near_vectors(frame(spark, rows), target_recall=1.0).select("vec_id", "n_links", "component_id"))
    wanted = brute(rows)
    assert sum(n for _, n, _ in got) >= 0.99 * sum(n for _, n, _ in wanted)
    assert len({c for i, _, c in got if i < 150}) <= len({c for i, _, c in wanted if i < 150}) + 2


def test_bad_vectors_and_ids(spark):
    nan, inf = float("nan"), float("inf")
    x = [1.0, 0.0, 2.0, 1.0]
    rows = [(1, x, 1), (2, x, 1), (3, x, 2), (4, None, 1), (5, [], 1), (6, [0.0] * 4, 1), (7, [1.0, None, 2.0, 1.0], 1),
            (8, [nan] * 4, 1), (9, [inf, 0.0, 0.0, 0.0], 1), (10, x, None), (None, x, 1), (11, x[:3], 1), (12, [v * 1e-20 for v in x], 1),
            (2, x, 1), (13, [3.0], 1), (14, [9.0], 1)]
    out = near_vectors.near_vectors(frame(spark, rows).withColumnRenamed("label", "label"))
    got = plain(out.select("vec_id", "n_links", "component_id"))
    assert got == brute(rows)
    assert {(r.vec_id, r.kept) for r in out.collect()} >= {(1, True), (2, False), (None, False), (13, True), (14, False)}
    assert near_vectors.near_vectors(frame(spark, [])).count() == 0


def test_multi_sequence_visits_in_order():
    rng = np.random.default_rng(1)
    a, b = np.sort(rng.random(9)), np.sort(rng.random(7))
    visited = list(near_vectors.multi_sequence(a, b, 0.8))
    costs = [a[p] + b[q] for p, q in visited]
    assert costs == sorted(costs) and len(set(visited)) == len(visited)
    assert len(visited) == (a[:, None] + b[None] <= a[0] + b[0] + 0.8).sum()


def test_components_of_chains_and_hubs(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 200 + i) for i in range(80)] + [(5, 5), (None, 3), (300, 299)]
    got = dict(plain(components(spark.createDataFrame(edges, "a long, b long"))))
    assert got == {i: 0 for i in range(1, 61)} | {200 + i: 100 for i in range(80)} | {300: 299}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
