import random

import numpy as np
from helpers import clashing, docs

from millrace.llm import quality as q


def texts(n=300):
    rng = random.Random(2)
    parts = ("ta", "ri", "mo", "le", "an", "ne", "so", "lit", "er", "")
    words = [f"{a}{b}{c}" for a in parts[:5] for b in parts for c in parts] + ["a", "to", "of"] * 40
    out = []
    for i in range(n):
        body = [" ".join(rng.choices(words, k=rng.randint(4, 14))).capitalize() + "." for _ in range(rng.randint(3, 30))]
        kind = i % 10
        if kind == 0:
            body = [w + "###$$$" for w in " ".join(body).split()]
        elif kind == 1:
            body = [rng.choice(words)] * 200
        out.append((i, " ".join(body), kind > 1))
    return out


def test_em_finds_good_and_bad_labellers():
    rng = np.random.default_rng(0)
    truth = rng.random(6000) < 0.8
    n = len(q.LABELLERS)
    right = np.linspace(0.95, 0.6, n)
    votes = np.where(rng.random((6000, n)) < right, truth[:, None], ~truth[:, None]).astype(int)
    votes[rng.random((6000, n)) < 0.3] = q.NONE
    codes = votes @ 3 ** np.arange(n - 1, -1, -1)
    assert (q.votes_of(codes) == votes).all()
    patterns, back, weights = np.unique(codes, return_inverse=True, return_counts=True)
    model = q.LabelModel(patterns, weights.astype(float))
    found = np.array([model.posteriors[int(p)] for p in patterns])[back] >= 0.5
    assert (found == truth).mean() > 0.95
    accuracy = list(model.accuracies().values())
    assert np.allclose(accuracy, right, atol=0.06)


def test_scores(spark):
    rows = texts()
    extra = [(900, None), (901, ""), (902, "Short but fine words here."), (903, rows[5][1] + " " + rows[7][1] * 400)]
    df = clashing(docs(spark, [(i, t) for i, t, _ in rows] + extra))
    out = {r.doc_id: r for r in q.score_docs(df).collect()}
    assert len(out) == len(rows) + 4 and all(0 <= r.score <= 1 for r in out.values())
    good = [out[i].keep for i, _, y in rows if y]
    bad = [out[i].keep for i, _, y in rows if not y]
    assert np.mean(good) > 0.98 and np.mean(bad) < 0.1
    assert not out[900].keep and out[900].score == out[901].score
    assert out[902].keep and out[903].keep


def test_layout_does_not_matter_and_empty_tables(spark):
    df = docs(spark, [(i, t) for i, t, _ in texts(60)])
    one, other = (sorted((r.doc_id, r.score) for r in q.score_docs(x).collect()) for x in (df, df.repartition(5)))
    assert one == other
    assert q.score_docs(docs(spark, [])).count() == 0
