import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from helpers import clashing, docs
from pyspark.sql import functions as F

from millrace.llm import toxicity


def flat(vectors):
    owner = np.repeat(np.arange(len(vectors)), [len(t) for t, _ in vectors])
    return owner, *(np.concatenate([v[i] for v in vectors]) for i in (0, 1))


def some(rng, n, most, terms=60):
    out = []
    for _ in range(n):
        t = np.unique((terms * rng.random(rng.integers(0, most)) ** 3).astype(int))
        w = rng.integers(1, 4, len(t)).astype(float)
        out.append((t, w / np.linalg.norm(w) if len(t) else w))
    return out


def test_block_max_search_is_exact():
    rng = np.random.default_rng(4)
    vectors = some(rng, 500, 9)
    index = toxicity.BlockMaxIndex(500, *flat(vectors), 60, width=16)
    assert 0 < index.matrix.shape[1] < 60 and len(index.places)  # both kinds of terms
    queries = [*some(rng, 300, 9, 70), (np.zeros(0, int), np.zeros(0))]
    dense = np.zeros((500, 80))
    for i, (t, w) in enumerate(vectors):
        dense[i, t] = w
    for (t, w), (found, scores) in zip(queries, index.search(len(queries), *flat(queries), 10), strict=True):
        exact = dense[:, t] @ w
        best = np.lexsort((np.arange(500), -np.round(exact, 5)))[:10]
        best = best[exact[best] > 0]
        assert np.allclose(scores, exact[best], atol=1e-5) and found.tolist() == best.tolist()
    assert index.opened < index.seen
    faint = toxicity.BlockMaxIndex(20, np.arange(20), np.zeros(20, int), np.full(20, 1e-8), 1, width=16)
    found, _ = next(faint.search(1, np.zeros(1, int), np.zeros(1, int), np.ones(1), 4))
    assert set(found.tolist()) <= set(range(20)) and len(found) == 4  # never the filling of the last block


def test_words_of_a_slice_are_those_of_its_texts():
    texts = ["é à Ça", None, "日本 x_Y\x7fz", "", "ÀB c"] * 40
    owner, code, words = toxicity._words(pa.array(texts)[63:])
    got = [(int(o), words[int(c)].as_py()) for o, c in zip(owner, code)]
    low = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    assert got == [(i, w) for i, t in enumerate(texts[63:]) for w in re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(t))]


def brute(voter, examples, text):
    """Score of one text by all cosines over whole vectors, in plain Python."""
    def words(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").lower())

    known = {t: float(w) for t, w in zip(voter.vocabulary.terms.to_pylist(), voter.weight)}

    def vector(t):
        tf = Counter(words(t))
        for w in words(t):
            tf.update(p for p in ("^" + w[:n] for n in toxicity.PREFIXES if len(w) > n) if p in known)
        v = {w: (1 + math.log(c)) * known.get(w, voter.base) for w, c in tf.items()}
        norm = math.sqrt(sum(x * x for x in v.values()))
        return {w: x / norm for w, x in v.items()}

    own = vector(text)
    if not own:
        return voter.blank
    cosines = [(sum(own.get(w, 0) * x for w, x in vector(t).items()), i) for i, t in enumerate(examples)]
    near = sorted((-round(c, 5), i, c) for c, i in cosines if c > 0)[: voter.k]
    votes = [(math.sqrt(voter.worth[i]) / (1.03 - min(c, 1)), voter.toxic[i]) for _, i, c in near]
    return (sum(v * y for v, y in votes) + voter.prior) / (sum(v for v, _ in votes) + 1)


def test_scores_agree_with_brute_force_over_whole_vectors(spark):
    rows, labels = corpus(spark, 300)
    df = docs(spark, rows)
    voter = toxicity.fit(df, toxicity.labelled_rows(spark.createDataFrame(labels[:200], "doc_id long, toxic int")))
    texts = dict(rows)
    frequency = Counter(w for t in texts.values() for w in set(re.findall(r"[a-z0-9]+", t.lower())))
    assert voter.base == 0.01 * (math.log(301) + 1)  # documents of all rows, not of the examples
    plain = voter.vocabulary.terms.to_pylist().index("word1")
    assert abs(voter.weight[plain] / (math.log(301 / (1 + frequency["word1"])) + 1) - 0.01) < 0.1
    examples = [texts[int(i)] for i in voter.ids]
    extra = [(9001, None), (9002, ""), (9003, "unheard of"), (9004, rows[5][1])]
    for r in toxicity.score(docs(spark, rows[150:] + extra), voter).collect():
        assert abs(r.score - brute(voter, examples, r.text)) < 1e-3
    top = toxicity.score(docs(spark, [rows[3]]), voter).first().evidence[0]
    assert top.cosine > 0.9999 and texts[int(top.example)] == rows[3][1]


def test_few_blocks_are_opened_for_telling_texts(spark):
    rng = random.Random(3)
    slurs = ["".join(rng.choices("abcdefghijklmnopqrstuvxyz", k=9)) for _ in range(40)]
    rows = [(i, " ".join(rng.choices([f"w{k}" for k in range(500)], k=30) + ([rng.choice(slurs)] * 2 if i % 2 else []))) for i in range(3000)]
    labels = [(i, i % 2) for i, _ in rows]
    voter = toxicity.fit(docs(spark, rows), toxicity.labelled_rows(spark.createDataFrame(labels, "doc_id long, toxic int")))
    found = list(voter.scores(pa.array([t for i, t in rows if i % 2][:300])))
    assert min(s for s, *_ in found) > 0.5 and voter.index.opened < 0.2 * voter.index.seen


def corpus(spark, n=600):
    rng = random.Random(7)
    words = [f"word{k}" for k in range(300)]
    bad = ["idiot", "trash", "lowerung", "lowerheit", "lowerig"]
    rows, labels = [], []
    for i in range(n):
        text = rng.choices(words, k=rng.randint(5, 80))
        y = int(rng.random() < 0.2)
        if y:
            for _ in range(rng.randint(1, 4)):
                text.insert(rng.randrange(len(text)), rng.choice(bad) + rng.choice(["", ".", "!"]))
        rows.append((i, " ".join(text)))
        labels.append((i, y))
    return rows, labels


def test_learns_and_generalises(spark):
    rows, labels = corpus(spark)
    df = docs(spark, rows)
    table = spark.createDataFrame([*labels, (1, None), (None, 1), (10**9, 1)], "doc_id long, toxic int")
    held = F.col("id") % 3 == 0
    voter = toxicity.fit(df, toxicity.labelled_rows(table, held_out=held))
    extra = [(9001, None), (9002, ""), (9003, "unheard of lowerfern things"), (9004, "word1 " * 50000)]
    out = {r.doc_id: r for r in toxicity.score(clashing(docs(spark, rows + extra)), voter).collect()}
    wrong = sum((out[i].score >= 0.3) != bool(y) for i, y in labels if i % 3 == 0)
    assert wrong <= 2 and len(out) == len(rows) + 4
    assert all(0 <= r.score <= 1 for r in out.values())
    assert out[9001].score == out[9002].score < 0.25  # no word: the overall rate, as no example is blank
    assert out[9004].score < 0.3
    assert out[9003].score > 0.5 and out[9003].evidence and "^lower" in out[9003].terms
    clean = toxicity.reject_toxic(clashing(df), voter)
    assert clean.columns == clashing(df).columns
    assert {r.doc_id for r in clean.collect()} == {i for i, _ in rows if out[i].score < 0.3}


def test_labels_of_held_out_rows_change_nothing(spark):
    rows, labels = corpus(spark, 200)
    df, held = docs(spark, rows), F.col("id") % 3 == 0
    scores = []
    for flip in (0, 1):
        table = spark.createDataFrame(
            [(i, 1 - y if flip and i % 3 == 0 else y) for i, y in labels], "doc_id long, toxic int"
        )
        voter = toxicity.fit(df, toxicity.labelled_rows(table, held_out=held))
        scores.append(sorted((r.doc_id, r.score) for r in toxicity.score(df, voter).collect()))
    assert scores[0] == scores[1]


def test_no_labels_and_no_documents(spark):
    empty = spark.createDataFrame([], "doc_id long, toxic int")
    voter = toxicity.fit(docs(spark, [(1, "a")]), toxicity.labelled_rows(empty))
    assert [r.score for r in toxicity.score(docs(spark, [(1, "a"), (2, None)]), voter).collect()] == [0.0, 0.0]
    assert toxicity.score(docs(spark, []), voter).count() == 0


def test_one_toxic_passage_in_many_documents(spark):
    rng = random.Random(11)
    words = [f"word{k}" for k in range(300)]
    rows, labels = [], []
    for i in range(400):
        text, y = rng.choices(words, k=rng.randint(10, 40)), int(i % 5 == 0)
        if y:
            text += "vermin should all be driven out".split()
        rows.append((i, " ".join(text)))
        labels.append((i, y))
    # equal texts keep the votes of all
    rows += [(1000 + i, "some toxic line nobody else has") for i in range(60)]
    labels += [(1000 + i, 1) for i in range(60)]
    df = docs(spark, rows)
    voter = toxicity.fit(df, toxicity.labelled_rows(spark.createDataFrame(labels, "doc_id long, toxic int")))
    new = [(1, "a new text with vermin should all be driven out at its end"), (2, "some toxic line nobody else has"),
           (3, " ".join(words[:20]))]
    out = {r.doc_id: r for r in toxicity.score(docs(spark, new), voter).collect()}
    assert out[1].score > 0.5 and "vermin" in out[1].terms
    assert out[2].score > 0.5 and out[3].score < 0.1
    assert abs(voter.worth.sum() - len(labels)) < 1e-6
    kept = toxicity.reject_toxic(df, voter).collect()
    assert {r.doc_id for r in kept} == {i for i, y in labels if not y}


def test_terms_below_three_times_as_frequent_count(spark):
    rng = random.Random(13)
    rows, labels = [], []
    for i in range(600):
        y = i % 2
        text = rng.choices([f"word{k}" for k in range(50)], k=20)
        if rng.random() < (0.5 if y else 0.25):
            text.append("blockhead")
        rows.append((i, " ".join(text)))
        labels.append((i, y))
    labelled = toxicity.labelled_rows(spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert "blockhead" in toxicity.fit(docs(spark, rows), labelled).term_of
