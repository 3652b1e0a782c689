import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from helpers import clashing, plain
from pyspark.sql import functions as F

from millrace.llm import phrases
from millrace.llm.phrases import collocations, parse, phrase_counts


def pieces(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [re.findall(r"[^ \t]+", p) for p in re.split(r"[.,;:!?\n\x0b\x0c\r]", low)]


def brute_counts(rows, max_words, min_count):
    f, n = Counter(), Counter()
    for _, lang, text in rows:
        for words in pieces(text):
            n[lang or "und"] += len(words)
            for m in range(1, max_words + 1):
                f.update((lang or "und", tuple(words[i : i + m])) for i in range(len(words) - m + 1))
    return {k: v for k, v in f.items() if v >= min_count}, n


def brute(rows, max_words=5, min_count=100, share=100, limit=2000):
    f, n = brute_counts(rows, max_words, min_count)
    out = []
    for (lang, words), a in f.items():
        if len(words) < 2:
            continue
        inner = [
            v for (g, longer), v in f.items()
            if g == lang and len(longer) > len(words) and any(longer[i : i + len(words)] == words for i in range(len(longer)))
        ]
        if any(100 * v >= share * a for v in inner):
            continue
        score, _, l, r = min(
            (1000 * a * n[lang] // (f[lang, words[:k]] * f[lang, words[k:]]), k, f[lang, words[:k]], f[lang, words[k:]])
            for k in range(1, len(words))
        )
        out.append((lang, " ".join(words), a, l, r, n[lang], score))
    ranked = []
    for lang in {o[0] for o in out}:
        own = sorted((o for o in out if o[0] == lang), key=lambda o: (-o[6], -o[2], o[1].encode()))
        ranked += [(o[0], i + 1, *o[1:]) for i, o in enumerate(own[:limit])]
    return sorted(ranked)


def texts(rng, n):
    words = ["the", "of", "New", "york", "city", "é", "日本", "a", "b", "San", "x" * 9]
    rows = []
    for i in range(n):
        out = []
        for _ in range(rng.randint(0, 40)):
            out.append(rng.choice(words) if rng.random() < 0.6 else rng.choice(["new york city", "san b a the", "of the"]))
            out.append(rng.choice([" ", " ", " ", "  ", "\t", ", ", ".", "\n", "\x0b", "?! "]))
        rows.append((i, rng.choice(["en", "fr", None]), "".join(out)))
    return rows + [rows[0]] * 30 + [(900, "en", None), (901, None, ""), (902, "fr", " \t.")]


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, lang string, text string")


def test_chunks_cover_texts_and_share_their_ends():
    rng = random.Random(1)
    rows = [t for *_, t in texts(rng, 60)] + ["w " * 500, "", None, " . "]
    owner, chunks, last = parse(pa.array(rows), overlap=4, one_in=3)
    for i, text in enumerate(rows):
        own = [c.split(" ") for c, o in zip(chunks.to_pylist(), owner) if o == i]
        joined = [w for k, c in enumerate(own) for w in (c[:-4] if k < len(own) - 1 else c)]
        assert [w for w in joined if w != "."] == [w for p in pieces(text) for w in p]
        assert all(a[-4:] == b[:4] for a, b in zip(own, own[1:]))
        assert list(last[owner == i]) == [False] * (len(own) - 1) + [True] * bool(own)
    assert len(chunks) > 100


def test_slices_of_texts_are_read_like_whole_arrays():
    rows = [t for *_, t in texts(random.Random(8), 90)]
    _, chunks, last = parse(pa.array(rows)[40:], overlap=4, one_in=3)
    _, wanted, its_last = parse(pa.array(rows[40:]), overlap=4, one_in=3)
    assert chunks.to_pylist() == wanted.to_pylist() and last.tolist() == its_last.tolist()
    table = pa.record_batch([pa.array(["en"] * len(chunks)), chunks, pa.array(last), pa.array(np.ones(len(chunks), np.int64))], ["l", "c", "e", "u"])
    part, whole = phrases._Phrases(table.slice(50), 4), phrases._Phrases(table, 4)
    assert part.tokens.to_pylist() == whole.tokens.to_pylist()[-len(part.tokens) :]


def test_equal_passages_give_equal_chunks():
    rng = random.Random(2)
    passage = " ".join(str(rng.randint(0, 999)) for _ in range(2000))
    _, chunks, _ = parse(pa.array([f"a b {passage} c", f"{passage}", f"x, {passage}. y"]), overlap=4)
    uses = Counter(Counter(chunks.to_pylist()).values())
    assert uses[3] > 20 and uses[1] < 9


def test_counts_agree_with_brute_force(spark):
    rows = texts(random.Random(3), 120)
    for max_words, min_count in ((5, 20), (3, 10), (2, 1), (7, 8)):
        f, n = brute_counts(rows, max_words, min_count)
        got = phrase_counts(frame(spark, rows), max_words=max_words, min_count=min_count)
        found = {(r.lang, r.phrase and tuple(r.phrase.split(" "))): r.uses for r in got.collect()}
        assert found == {**f, **{(lang, None): v for lang, v in n.items()}}


def test_full_filters_only_cost_time(spark, monkeypatch):
    monkeypatch.setattr(phrases, "_LEAST_BITS", 15)
    monkeypatch.setattr(phrases, "_MOST_BITS", 15)
    monkeypatch.setattr(phrases, "_frequent", lambda *a, f=phrases._frequent: f(*a) | np.uint8(0xFF))
    rows = texts(random.Random(5), 80)
    f, n = brute_counts(rows, 5, 15)
    got = {(r.lang, tuple(r.phrase.split(" "))): r.uses for r in phrase_counts(frame(spark, rows), min_count=15).filter("words > 0").collect()}
    assert got == f


def test_collocations_agree_with_brute_force(spark):
    rows = texts(random.Random(4), 150)
    for share, limit in ((100, 2000), (60, 7)):
        out = collocations(clashing(frame(spark, rows)), min_count=12, share=share, limit=limit)
        assert out.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
        wanted = brute(rows, min_count=12, share=share, limit=limit)
        assert plain(out) == sorted(wanted, key=repr) and len(wanted) > 15


def test_products_beyond_64_bits(spark):
    counts = [("en", 0, None, 10**15), ("en", 1, "p", 3 * 10**12), ("en", 1, "q", 10**12 + 7), ("en", 2, "p q", 10**12)]
    made = spark.createDataFrame(counts, "lang string, words int, phrase string, uses long")
    real, phrases.phrase_counts = phrases.phrase_counts, lambda *a: made
    try:
        row = collocations(frame(spark, [])).first()
    finally:
        phrases.phrase_counts = real
    assert row.score == 1000 * 10**12 * 10**15 // (3 * 10**12 * (10**12 + 7))


def test_empty_and_null_tables(spark):
    assert collocations(frame(spark, [])).count() == 0
    assert collocations(frame(spark, [(None, None, None)] * 3)).count() == 0
    rows = [(1, None, "a b " * 20_000), (2, None, "c")]
    out = collocations(frame(spark, rows))
    assert plain(out) == sorted(brute(rows), key=repr) and out.agg(F.max("n")).first()[0] == 40_001
