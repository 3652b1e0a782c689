import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from helpers import clashing, docs, plain
from hypothesis import given, settings
from hypothesis import strategies as st

from millrace.llm.queries import planted_runs, run_report
from millrace.llm.runs import _report, bands, find_runs, periodic_runs


def brute(words, min_length=6, min_exponent=4):
    """All runs, lag by lag: maximal agreement at a lag that no smaller lag explains."""
    found = []
    for q in range(1, len(words) // min_exponent + 1):
        i = 0
        while i < len(words) - q:
            j = i
            while j < len(words) - q and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            if j > i and length >= max(min_length, min_exponent * q):
                # the smallest period of the stretch has to be q itself
                part = words[i : i + length]
                if not any(all(part[x] == part[x + p] for x in range(length - p)) for p in range(1, q)):
                    found.append((i, length, q))
            i = j + 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def collapsed(words, runs):
    gone = {x for s, n, q in runs for x in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def some_texts(rng, n):
    """Random words with planted repeats, also of repeats."""
    out = []
    for _ in range(n):
        words = []
        for _ in range(rng.randint(0, 6)):
            block = [rng.choice("abcd") for _ in range(rng.randint(1, 12))]
            words += (block * rng.randint(1, 7))[: rng.randint(1, 60)]
        out.append(words * rng.choice([1, 1, 1, 4, 5]))
    return out


def numbered(texts):
    codes = {w: i for i, w in enumerate({w for t in texts for w in t})}
    flat = np.array([codes[w] for t in texts for w in t], np.int64)
    return flat, np.cumsum([len(t) for t in texts], dtype=np.int64)


def test_bands_cover_every_lag_once():
    for length, exponent in ((6, 4), (2, 3), (30, 3), (10, 7)):
        low = 1
        for first, k in bands(10_000, length, exponent):
            assert first == low and k >= low
            assert all(max(length - q, (exponent - 1) * q) >= k for q in range(first, k + 1))
            low = k + 1
        assert max(length, exponent * low) > 10_000


@pytest.mark.parametrize(("length", "exponent"), [(6, 4), (2, 3), (12, 3)])
def test_runs_agree_with_brute_force(length, exponent):
    texts = some_texts(random.Random(length), 150)
    got = find_runs(*numbered(texts), length, exponent)
    assert got == [(i, *r) for i, t in enumerate(texts) for r in brute(t, length, exponent)]
    assert len(got) > 100


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text("ab", max_size=40), max_size=6))
def test_small_alphabets(texts):
    assert find_runs(*numbered(texts)) == [(i, *r) for i, t in enumerate(texts) for r in brute(list(t))]


def test_clashing_fingerprints_are_told_apart(monkeypatch):
    import millrace.llm.runs as runs

    monkeypatch.setattr(runs, "_repeats", lambda prints, at: _full(prints, at))
    texts = some_texts(random.Random(9), 40)
    slow = find_runs(*numbered(texts))
    monkeypatch.undo()
    assert slow == find_runs(*numbered(texts))
    high = np.array([1 << 63, 5, 1 << 63 | 5, 5], np.uint64)  # equal once the top bits are cut
    first, again = runs._repeats(high, np.arange(4))
    assert list(zip(first.tolist(), again.tolist())) == [(1, 3)]


def _full(prints, at):
    index = np.lexsort((at, prints))
    same = prints[index[1:]] == prints[index[:-1]]
    return at[index[:-1][same]], at[index[1:][same]]


def test_operator(spark):
    rows = [(i, " ".join(t)) for i, t in enumerate(some_texts(random.Random(4), 60))]
    rows += [(None, None), (61, ""), (62, " \t\n"), (63, "\x0b x\x0cy\r\n x y x y x y x y "), (63, "a b É"), (64, "w " * 50_000)]
    rows += [(65, "".join(f"w{i % 7000} " for i in range(40_000)))] * 2
    out = periodic_runs(clashing(docs(spark, rows)))
    assert out.columns[-3:] == ["n_words", "runs", "collapsed"] and set(clashing(docs(spark, rows)).columns) < set(out.columns)
    got = sorted(((r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in out.collect()), key=repr)
    wanted = []
    for i, text in rows:
        words = [w.decode() for w in (text or "").encode().split()]
        own = [(0, 50_000, 1)] if i == 64 else [(0, 40_000, 7000)] if i == 65 else brute(words)
        wanted.append((i, len(words), own, collapsed(words, own)))
    assert got == sorted(wanted, key=repr)
    with pytest.raises(ValueError):
        periodic_runs(docs(spark, rows), min_exponent=2)


def test_slices_of_texts_are_read_like_whole_arrays():
    texts = [" ".join(["é", "à", "日本"] * (i % 9)) + " ça" * (i % 3) for i in range(200)] + [None]
    whole, part = _report(pa.array(texts), 6, 4), _report(pa.array(texts)[77:], 6, 4)
    assert part.to_pylist() == whole.to_pylist()[77:]
    assert [tuple(r.values()) for r in part[3].as_py()["runs"]] == brute((texts[80]).split())


def test_empty_table(spark):
    assert periodic_runs(docs(spark, [])).count() == 0


def planted(doc_id, text):
    words = [w.decode() for w in (text or "").encode().split()]
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if doc_id is None or h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_query_agrees_with_brute_force(spark):
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choices("abcdefgh é", k=rng.randint(0, 120)))) for i in range(300)]
    rows += [(400 + i, " ".join(t)) for i, t in enumerate(some_texts(rng, 60))] + [(None, "a " * 9), (501, None), (502, "")]
    wanted = []
    for i, text in rows:
        words = planted(i, text)
        runs = brute(words)
        best = max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=None)
        wanted.append((
            i, len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2],
            digest("".join(f"{s},{n},{q}\n" for s, n, q in runs)), digest(collapsed(words, runs)),
        ))
    assert plain(run_report(docs(spark, rows))) == sorted(wanted, key=repr)
    texts = {r.doc_id: r.text for r in planted_runs(docs(spark, rows)).collect()}
    assert all((texts[i] or "").split() == planted(i, t) for i, t in rows)
