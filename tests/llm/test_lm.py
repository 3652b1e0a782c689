import math
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from helpers import clashing, docs
from pyspark.sql import functions as F

from millrace.llm import lm

PATH = public_tokenizers.path("byte_bpe_50k.json")


def small_model(seed=0, n=12):
    tree = lm.SubwordTree({i: 1 + i * i for i in range(n)}, 20)
    rng = np.random.default_rng(seed)
    p = {k: (v + rng.standard_normal(v.shape) * 0.3).astype(np.float32) for k, v in lm.initial(tree).items()}
    return tree, p


def test_branch_probabilities_sum_to_one():
    tree, p = small_model()
    model = lm.Model(tree, p)
    state = np.random.default_rng(1).standard_normal((1, lm.WIDTH)).astype(np.float32)
    codes = np.arange(tree.n_codes)
    logs = model.log_probabilities(np.repeat(state, len(codes), 0), codes)
    total = np.exp(logs)
    total[-1] *= tree.unseen  # the last leaf is shared evenly by all ids not seen
    assert total.sum() == pytest.approx(1, abs=1e-5)


def reference(model, codes):
    """One position at a time, attending to what its window holds."""
    p, out = model.p, 0.0
    before = [model.start, *codes[:-1].tolist()]
    for i, code in enumerate(codes.tolist()):
        first = max(0, i // lm.STEP * lm.STEP - lm.STEP)
        seen = before[first : i + 1]
        q = model.query[before[i]]
        weight = np.array([math.exp(q @ model.key[c] + p["near"][lm.KEYS - 1 - (i - first - j)]) for j, c in enumerate(seen)])
        o = sum(w * (model.emb[c] @ p["v"]) for w, c in zip(weight, seen)) / weight.sum()
        h = model.emb[before[i]] + o @ p["o"]
        g = h + np.maximum(h @ p["w1"] + p["b1"], 0) @ p["w2"]
        out += float(model.log_probabilities(g[None].astype(np.float32), np.array([code]))[0])
    return out / math.log(10)


def test_windows_score_every_position_once(monkeypatch):
    monkeypatch.setattr(lm, "BATCH_WINDOWS", 3)
    tree, p = small_model(2)
    model, rng = lm.Model(tree, p), np.random.default_rng(5)
    texts = [rng.integers(0, tree.n_codes, n) for n in (1, 15, 16, 17, 33, 100, 2)]
    got = model.score(texts)
    assert np.allclose(got, [reference(model, t) for t in texts], rtol=1e-3, atol=1e-3)
    assert np.allclose(got, [model.score([t])[0] for t in texts], rtol=1e-4)


def test_gradients():
    tree, p = small_model(3)
    trainer = lm.Trainer(tree, p)
    codes = np.random.default_rng(8).integers(0, tree.n_codes, 40)
    keys, targets = trainer.block(codes, True)
    grads = {}

    def keep(name, grad, rate, rows=None):
        if rows is not None:
            full = np.zeros_like(trainer.p[name])
            np.add.at(full, rows, grad)
            grad = full
        grads[name] = grad

    trainer._move = keep
    trainer.step(keys, targets, 0.1)
    rng = np.random.default_rng(0)
    for name in p:
        for _ in range(3):
            at = tuple(rng.integers(0, s) for s in p[name].shape)
            values = []
            for eps in (1e-4, -1e-4):
                other = lm.Trainer(tree, {k: v.astype(np.float64) for k, v in p.items()})
                other.p[name][at] += eps
                other._move = lambda *a, **k: None
                values.append(other.step(keys, targets, 0.1) * (targets >= 0).sum() / lm.STEP)
            numeric = (values[0] - values[1]) / 2e-4
            assert grads[name][at] == pytest.approx(numeric, rel=0.05, abs=2e-3), name


def test_rows_met_are_counted():
    tree, p = small_model(5)
    trainer = lm.Trainer(tree, p)
    keys, targets = trainer.block(np.random.default_rng(2).integers(0, tree.n_codes, 40), True)
    trainer.step(keys, targets, 0.1)
    met, nodes = Counter(keys[keys >= 0].tolist()), tree.paths(targets[targets >= 0])[1]
    assert trainer.seen.tolist() == [met[i] for i in range(len(trainer.seen))]
    assert trainer.used.tolist() == [Counter(nodes.tolist())[i] for i in range(len(trainer.used))]


def test_training_lowers_the_loss():
    rng = random.Random(1)
    tree = lm.SubwordTree({i: 100 for i in range(10)}, 10)
    trainer = lm.Trainer(tree, lm.initial(tree))
    losses = []
    for _ in range(300):
        at, codes = rng.randrange(10), []
        for _ in range(64):
            at = (at + rng.choice([1, 1, 1, 2])) % 10
            codes.append(at)
        losses.append(trainer.step(*trainer.block(np.array(codes), True), 0.2))
    assert np.mean(losses[-30:]) < 0.45 * np.mean(losses[:3])


def corpus(n=240):
    rng = random.Random(3)
    order = ["the", "cat", "sat", "on", "a", "mat", "and", "ran", "far", "away"]
    rows = []
    for i in range(n):
        at, words = rng.randrange(10), []
        for _ in range(rng.randint(20, 120)):
            at = (at + rng.choice([1, 1, 1, 1, 3])) % 10
            words.append(order[at].title() if rng.random() < 0.2 else order[at])
        rows.append((i, " ".join(words)))
    return rows


def test_base_scores_and_held_out_gain(spark):
    rows = [*corpus(), (900, None), (910, ""), (920, "unseen words only, the cat"), (930, "the " * 40000)]
    df = clashing(docs(spark, rows))
    held = F.col("doc_id") % 10 == 0
    out = lm.score(df, ~held, PATH, hot_words=4, one_in=2, shards=2, rounds=2, rate=0.2)
    got = {r.doc_id: r for r in out.collect()}
    train = Counter(w for i, t in rows if i % 10 for w in (t or "").lower().split())
    ends = sum(1 for i, _ in rows if i % 10)
    n, v = sum(train.values()) + ends, len(train) + 1
    for i, t in rows:
        words = (t or "").lower().split()
        counts = [*(train[w] for w in words), ends]
        base = sum(math.log10((c + 0.1) / (n + 0.1 * (v + 1))) for c in counts)
        r = got[i]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(counts), sum(c > 0 for c in counts), n)
        assert r.base_score == pytest.approx(base) and r.score < 0
    own = [got[i] for i, _ in rows[:240] if i % 10 == 0]
    assert sum(r.score for r in own) > 0.75 * sum(r.base_score for r in own)
    assert len(got) == len(rows) and "a.b `c`" in out.columns


def test_nothing_to_learn_from(spark):
    out = lm.score(docs(spark, [(1, "a b"), (2, None)]), F.lit(False), PATH).collect()
    assert {(r.n_tokens, r.n_known, r.train_tokens) for r in out} == {(3, 0, 0), (1, 0, 0)}
    assert all(r.score < 0 for r in out)
    assert lm.score(docs(spark, []), F.lit(True), PATH).count() == 0


def test_production_parameters_train_on_every_block(spark, monkeypatch):
    rows = corpus(400) + [(1000 + i, "one repeated text of a few words") for i in range(40)]
    df, seen, train = docs(spark, rows), Counter(), lm._trained

    def watched(blocks, tree, *rest):
        got = blocks.select("codes", F.pmod(F.hash("key"), F.lit(8)).alias("shard")).collect()
        seen["codes"] += sum(len(r.codes) // np.dtype(tree.value.stored).itemsize for r in got)
        same = Counter(bytes(r.codes) for r in got).most_common(1)[0][0]
        seen["shards"] = max(seen["shards"], len({r.shard for r in got if bytes(r.codes) == same}))
        return train(blocks, tree, *rest)

    monkeypatch.setattr(lm, "_trained", watched)
    monkeypatch.setattr(lm, "SUMS", 3)
    held = F.col("doc_id") % 10 == 0
    out = lm.score(df, ~held, PATH).collect()
    enc = lm.encoder(PATH)
    ids = sum(len(enc.chunks([" " + w])[0]) // enc.dtype.itemsize for i, t in rows if i % 10 for w in t.lower().split())
    assert seen["codes"] == ids + sum(i % 10 > 0 for i, _ in rows)
    assert seen["shards"] > 1  # copies do not meet in one shard
    own = [r for r in out if r.doc_id % 10 == 0 and r.doc_id < 1000]
    assert sum(r.score for r in own) > 0.75 * sum(r.base_score for r in own)


def test_scores_come_from_the_trained_model():
    tree, p = small_model(4)
    p["q"], p["k"] = p["q"] * 4, p["k"] * 4  # long rows, some products above the bound
    codes = np.random.default_rng(6).integers(0, tree.n_codes - 1, 100)
    model, trainer = lm.Model(tree, p), lm.Trainer(tree, p)
    assert (model.query @ model.key.T).max() > 30
    loss = trainer.step(*trainer.block(codes, True), 0.1)
    assert model.score([codes])[0] * math.log(10) == pytest.approx(-loss * len(codes), rel=1e-3)


def test_shards_follow_the_size_and_are_averaged(spark, monkeypatch):
    monkeypatch.setattr(lm, "SHARD_BLOCKS", 20)
    monkeypatch.setattr(lm, "SUMS", 2)
    tree = lm.SubwordTree({i: 5 for i in range(20)}, 20)
    rows = [(i, True, np.arange(i % 5, 15, dtype=np.int64).astype(tree.stored).tobytes()) for i in range(90)]
    blocks = spark.createDataFrame(rows, "key long, start boolean, codes binary")
    params = lm.initial(tree)
    after = lm._trained(blocks, spark.sparkContext.broadcast(tree), params, 1, 4, (0.3, 0.1))
    assert all(np.isfinite(v).all() and v.shape == params[k].shape for k, v in after.items())
    codes = [np.arange(15)]
    assert lm.Model(tree, after).score(codes)[0] > lm.Model(tree, params).score(codes)[0]


def test_held_out_rows_score_above_their_unigram_base(spark):
    """At the parameters of the query, over the real table."""
    from millrace.llm.queries import language_scores

    held = language_scores(spark, "/root/testdata/sf0.01").filter("held_out")
    r = held.agg(F.sum("score").alias("score"), F.sum("base_score").alias("base")).first()
    assert r.score > r.base


def test_every_step_has_a_full_batch():
    tree, p = small_model(6)
    trainer, rng = lm.Trainer(tree, p), np.random.default_rng(3)
    blocks = [trainer.block(rng.integers(0, tree.n_codes, n), True) for n in (100, 40, 16, 300, 2, 250)]
    got = list(lm.full_batches(iter(blocks), 8))
    assert {len(k) for k, _ in got[:-1]} == {8} and 0 < len(got[-1][0]) <= 8
    for i in (0, 1):
        assert np.array_equal(np.concatenate([x[i] for x in got]), np.concatenate([x[i] for x in blocks]))
    assert list(lm.full_batches(iter([]), 8)) == []


@pytest.mark.parametrize("top_nodes", [1, 3, 100])
def test_a_step_does_not_depend_on_shared_halves_and_nodes(monkeypatch, top_nodes):
    """Windows in an order in which none follows the one before, one branch at a time."""
    monkeypatch.setattr(lm, "TOP_NODES", top_nodes)
    tree, p = small_model(7)
    p["node"] = p["node"] * 8  # some branches are beyond the bound
    trainer = lm.Trainer(tree, p)
    monkeypatch.setattr(lm, "TOP_NODES", 0)
    plain = lm.Trainer(small_model(7)[0], p, losses=False)
    rng = np.random.default_rng(4)
    blocks = [trainer.block(rng.integers(0, tree.n_codes, n), n > 50) for n in (100, 40, 16, 90)]
    keys, targets = (np.concatenate(x) for x in zip(*blocks))
    mixed = np.argsort(np.arange(len(keys)) * 5 % len(keys), kind="stable")
    trainer.step(keys, targets, 0.3)
    plain.step(keys[mixed], targets[mixed], 0.3)
    for name in p:
        assert np.allclose(trainer.p[name], plain.p[name], atol=1e-5), name
        assert np.abs(trainer.p[name] - p[name]).max() > 1e-4, name
    assert np.array_equal(trainer.seen, plain.seen) and np.array_equal(trainer.used, plain.used)


def test_words_of_several_texts_reach_the_tokenizer_together(monkeypatch):
    enc = lm.encoder.__globals__["Encoder"](PATH)
    tree = lm.SubwordTree({i: 1 for i in range(50_000)}, 50_257)
    texts = ["The cat, the cat", None, "", "a\0b \x0b<|endoftext|> x caf\u00e9", " ".join(f"w{i}" for i in range(300)), "cat"]
    asked, ask = [], enc.chunks
    monkeypatch.setattr(enc, "chunks", lambda words, *rest: (asked.append(words), ask(words, *rest))[1])
    (_, words, sizes, codes, begin), = lm._coded(enc, tree, pa.array(texts))
    assert len(asked) == 1 and len(asked[0]) == len(set(asked[0])) == len(set(words))
    assert sizes.tolist() == [len((t or "").encode().split()) for t in texts]
    for i, w in enumerate(words):
        ids = np.frombuffer(enc.whole(" " + w.decode()), enc.dtype)
        assert codes[begin[i] : begin[i + 1]].tolist() == tree.code[ids].tolist()


def led_words():
    """Words of all kinds with a leading space: pieces of the vocabulary, contractions,
    signs, other scripts and a special token."""
    enc, rng = lm.encoder.__globals__["Encoder"](PATH), random.Random(9)
    pieces = [enc.tokenizer.decode([i]) for i in rng.sample(range(enc.tokenizer.get_vocab_size()), 6000)]
    pieces = [p for p in ("".join(p.split()) for p in pieces) if p and "\ufffd" not in p]
    pieces += ["'s", "'ll", "don't", "...", "12", "\u00e9", "\u00f1", "\u00d7", "\u4e2d", "\u00b2", "\x00", "\x85", "<|endoftext|>", "<"]
    words = ["".join(rng.choices(pieces, k=rng.randint(1, 3))) for _ in range(9000)]
    return list(dict.fromkeys(" " + w.encode().lower().decode() for w in [*pieces, *words]))


def test_quick_words_have_the_tokenizers_ids(monkeypatch):
    words = led_words()
    plain, quick = (lm.encoder.__globals__["Encoder"](PATH) for _ in range(2))
    quick.quicken()
    asked, ask = [], quick.chunks
    monkeypatch.setattr(quick, "chunks", lambda chunks, *rest: (asked.extend(chunks), ask(chunks, *rest))[1])
    order = np.random.default_rng(0).integers(0, len(words), 20_000)
    parts = pa.DictionaryArray.from_arrays(pa.array(order), pa.array(words, pa.large_string()))
    got, want = quick.joined_ids(parts), plain.joined_ids(parts)
    assert np.array_equal(got[0], want[0]) and np.array_equal(got[1], want[1])
    assert 0 < len(asked) < len(words) / 4  # the tokenizer gets only what could be cut otherwise
    assert {" <", " \u4e2d", " <|endoftext|>"} <= set(asked) and not any(w[1:].isascii() and w[1:].isalnum() for w in asked)


def test_words_cut_otherwise_go_to_the_tokenizer():
    enc, plain = (lm.encoder.__globals__["Encoder"](PATH) for _ in range(2))
    words = pa.array([" the", " cat", " sat", " \u00e9t\u00e9"], pa.large_string())
    enc.quick = lambda text: plain.tokenizer.encode(text.replace(" ", "")).ids
    got, want = enc.joined_ids(words), plain.joined_ids(words)
    assert np.array_equal(got[0], want[0]) and np.array_equal(got[1], want[1])


@pytest.mark.parametrize("case", ["order", "normalizer", "special", "library"])
def test_other_vocabularies_are_not_quickened(tmp_path, monkeypatch, case):
    import json
    import sys

    spec = json.loads(open(PATH, encoding="utf-8").read())
    vocab = spec["model"]["vocab"]
    if case == "order":  # ids of two merges change places
        a, b = ("".join(m if isinstance(m, list) else m.split(" ")) for m in spec["model"]["merges"][10:12])
        vocab[a], vocab[b] = vocab[b], vocab[a]
    if case == "normalizer":
        spec["normalizer"] = {"type": "Lowercase"}
    if case == "special":
        spec["added_tokens"][0]["content"] = "the"
    if case == "library":
        monkeypatch.setitem(sys.modules, "tiktoken", None)
    (tmp_path / "v.json").write_text(json.dumps(spec), encoding="utf-8")
    enc = lm.encoder.__globals__["Encoder"](str(tmp_path / "v.json"))
    enc.quicken()
    assert not enc.quick
    words = pa.array([" the", " there", " caf\u00e9"], pa.large_string())
    ids, ends = enc.joined_ids(words)
    assert ids.tobytes() == b"".join(enc.whole(w) for w in words.to_pylist()) and len(ends) == 3
