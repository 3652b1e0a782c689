import random

import numpy as np
import xxhash
from helpers import clashing, docs, plain

from millrace.llm import simhash


def plain_fingerprint(text, shingle=3):
    words = (text or "").encode().lower().split()
    size = min(shingle, len(words))
    counts, n = [0] * 64, 0
    for at in range(len(words) - size + 1 if words else 0):
        h = xxhash.xxh64_intdigest(b" ".join(words[at : at + size]), 42)
        n += 1
        for b in range(64):
            counts[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * counts[b] > n)


def groups(codes, ids, max_bits=2):
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for x, a in zip(ids, codes):
        for y, b in zip(ids, codes):
            if (a ^ b).bit_count() <= max_bits:
                p, q = find(x), find(y)
                root[max(p, q)] = min(p, q)
    return {i: find(i) for i in ids}


def test_fingerprint(spark):
    texts = ["", "one", "Two\x0bwords", "a b c", "A  B\tc\nd ÉE é", "x y " * 70000, None]
    out = docs(spark, list(enumerate(texts))).select("doc_id", simhash.fingerprints("text").alias("f")).collect()
    for i, f in out:
        assert f & (2**64 - 1) == plain_fingerprint(texts[i])


def test_trie_pairs_are_all_pairs():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 3, dtype=np.uint64)
    flips = [np.uint64(sum(1 << int(b) for b in rng.integers(0, 64, rng.integers(0, 4)))) for _ in range(900)]
    codes = np.unique(np.concatenate([base[rng.integers(0, 3, 900)] ^ np.array(flips), rng.integers(0, 1 << 63, 300, dtype=np.uint64)]))
    near = np.bitwise_count(codes[:, None] ^ codes[None]) <= 2
    got = {(int(i), int(j)) for a, b in simhash.trie_pairs(codes, None, 2) for i, j in zip(a, b)}
    assert got == {(int(i), int(j)) for i, j in np.argwhere(np.triu(near, 1))}
    left, right = codes[::2], codes[1::2]
    got = [(int(i), int(j)) for a, b in simhash.trie_pairs(left, right, 2) for i, j in zip(a, b)]
    assert sorted(got) == [(int(i), int(j)) for i, j in np.argwhere(near[::2, 1::2])]


def test_links_with_a_crowded_group_split_in_spark(spark, monkeypatch):
    monkeypatch.setattr(simhash, "UNIT_ROWS", 8)
    rng = random.Random(6)
    centre = rng.getrandbits(64)
    codes = {centre}
    while len(codes) < 260:
        code = centre
        for b in rng.sample(range(64), rng.randint(0, 4)):
            code ^= 1 << b
        codes.add(code if len(codes) < 200 else rng.getrandbits(64))
    codes = sorted(codes)
    ids = list(range(10, 10 + len(codes)))
    signed = [c - (1 << 64) if c >> 63 else c for c in codes]
    links = simhash.near_links(spark.createDataFrame(list(zip(signed, ids)), "code long, rep long"))
    found = {i: i for i in ids}
    from millrace.llm.components import components

    found |= dict(plain(components(links)))
    assert found == groups(codes, ids)


def test_operator(spark):
    rng = random.Random(9)
    words = [f"w{k}" for k in range(400)]
    base = [rng.choices(words, k=300) for _ in range(4)]
    rows = []
    for i in range(60):
        text = list(rng.choice(base))
        for _ in range(rng.randint(0, 3)):
            text[rng.randrange(len(text))] = "changed"
        rows.append((i, " ".join(text)))
    rows += [(70, None), (71, " \n"), (72, rows[0][1].upper()), (73, "alone here now")]
    codes = [plain_fingerprint(t) for _, t in rows]
    wanted = groups(codes, [i for i, _ in rows])
    out = simhash.near_duplicates(clashing(docs(spark, rows))).select("doc_id", "fingerprint", "component_id")
    assert plain(out) == sorted(((i, f"{c:016x}", wanted[i]) for (i, _), c in zip(rows, codes)), key=repr)
    kept = simhash.keep_one(clashing(docs(spark, rows)))
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(wanted.values()))
    assert kept.columns == clashing(docs(spark, rows)).columns


def test_ids_that_repeat_or_miss(spark):
    rows = [(5, "p q r s"), (5, "completely different words here"), (9, "p q r s"), (None, "p q r s"), (None, "p q r s")]
    got = plain(simhash.near_duplicates(docs(spark, rows)).select("doc_id", "component_id"))
    assert got == sorted([(5, 5), (5, 5), (9, 5), (None, None), (None, None)], key=repr)
    kept = simhash.keep_one(docs(spark, rows))
    assert sorted(map(repr, (r.doc_id for r in kept.collect()))) == ["5", "None", "None"]
    assert simhash.near_duplicates(docs(spark, [])).count() == 0 and simhash.keep_one(docs(spark, [])).count() == 0
