import random

from helpers import clashing, docs, plain
from pyspark.sql import functions as F

from millrace.llm.contamination import ItemAutomaton, decontaminate, find_items, hit_words, normal_words

WORDS = ["a", "b", "c", "dé", "e1"]


def brute(text, items, window):
    words, hit, names = normal_words(text), set(), set()
    for name, item in items:
        own = normal_words(item)
        n = min(window, len(own))
        for at in range(len(own) - n + 1 if own else 0):
            for p in range(len(words) - n + 1):
                if words[p : p + n] == own[at : at + n]:
                    hit |= set(range(p, p + n))
                    names.add(str(name))
    return len(words), len(hit), sorted(names)


def bench(spark, items):
    return spark.createDataFrame(items, "item_id long, text string")


def test_words():
    words = ["ab", "c", "d", "é", "ü9", "ß"]
    assert [w.decode() for w in normal_words("Ab,c_D é\x7fü9 ß")] == words
    assert normal_words(None) == normal_words("") == normal_words(" .,!") == []


def test_automaton_agrees_with_brute_force():
    rng = random.Random(1)
    for _ in range(150):
        window = rng.randint(2, 5)
        items = [(k, " ".join(rng.choices(WORDS[: rng.randint(1, 5)], k=rng.randint(0, 12)))) for k in range(5)]
        text = " ".join(rng.choices([*WORDS, "zz"], k=rng.randint(0, 40)))
        spans, names = ItemAutomaton([(str(k), normal_words(t)) for k, t in items], window).scan(normal_words(text))
        n, hit, wanted = brute(text, items, window)
        assert sum(b - a + 1 for a, b in spans) == hit and sorted(names) == wanted
        assert all(x[1] + 1 < y[0] for x, y in zip(spans, spans[1:]))


def test_operator_in_one_block_and_in_many(spark):
    rng = random.Random(2)
    items = [(k, " ".join(rng.choices(WORDS, k=rng.randint(0, 14)))) for k in range(9)] + [(9, None), (9, "zz zz")]
    rows = [(i, " ".join(rng.choices([*WORDS, "zz"], k=rng.randint(0, 60)))) for i in range(40)]
    rows += [(90, None), (91, ""), (92, "a " * 30000)]
    wanted = sorted(((i, *brute(t, items, 4)) for i, t in rows[:-1]), key=repr)
    for block_words in (10**6, 20):
        found = find_items(docs(spark, rows), bench(spark, items), window=4, block_words=block_words)
        got = found.filter("doc_id <> 92").select("doc_id", "n_words", hit_words().alias("h"), "items")
        assert plain(got) == wanted


def test_passages_are_cut_and_clean_texts_stay(spark):
    item = "One two, three four five six seven eight nine ten eleven."
    rows = [(1, f"Before it. {item} After it: and more words that stay for a while, here and there."), (2, "clean"),
            (3, item), (4, None)]
    out = decontaminate(clashing(docs(spark, rows)), bench(spark, [(1, item)]))
    got = dict(plain(out.select("doc_id", "text")))
    assert got[1] == "Before it. . After it: and more words that stay for a while, here and there."
    assert 3 not in got and got[2] == "clean" and got[4] is None
    assert out.columns == clashing(docs(spark, rows)).columns
    short = decontaminate(docs(spark, rows), bench(spark, [(1, item)]), min_span=50, max_coverage=1.0)
    assert dict(plain(short.select("doc_id", "text"))) == {i: t for i, t in ((r[0], r[1]) for r in rows)}


def test_a_task_runs_one_python_step(spark):
    """Each further one holds a worker process beside the first, in every task slot."""
    out = decontaminate(docs(spark, [(1, "a b c"), (2, None)]), bench(spark, [(1, "b c")]))
    assert out._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython [") == 1


def test_empty_tables(spark):
    assert find_items(docs(spark, []), bench(spark, [(1, "a")])).count() == 0
    none = find_items(docs(spark, [(1, "a b")]), bench(spark, []))
    assert none.select(F.size("spans"), F.size("items")).first()[:] == (0, 0)
