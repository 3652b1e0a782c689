import random

from helpers import clashing, docs, plain

from millrace.llm.lines import drop_shared_lines, line_key

LONG = "shared line that is certainly longer than forty characters"


def brute(rows, min_chars=40, min_docs=5):
    holders = {}
    for i, text in rows:
        for line in (text or "").split("\n"):
            key = line_key(line)
            if len(key) >= min_chars:
                holders.setdefault(key, set()).add(i)
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        kept = []
        for line in lines:
            ids = holders.get(line_key(line), set())
            if len(ids) < min_docs or i == max(ids):
                kept.append(line)
        out.append((i, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out, key=repr)


def test_agrees_with_brute_force(spark):
    rng = random.Random(4)
    pool = [f"{LONG} {k}" for k in range(6)] + ["short", "", "ÄÖ" * 25, "  " + LONG.upper() + " 0\t"]
    rows = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randint(1, 9)))) for i in range(60)]
    rows += [(100, None), (101, ""), (102, "\n" * 3000 + (LONG + " 0\n") * 2000)]
    df = docs(spark, rows)
    got = drop_shared_lines(df).select("doc_id", "text", "n_lines", "n_dropped")
    assert plain(got) == brute(rows)


def test_threshold_counts_documents_not_lines(spark):
    rows = [(i, "\n".join([LONG] * 3)) for i in range(4)]
    assert plain(drop_shared_lines(docs(spark, rows)).select("n_dropped")) == [(0,)] * 4
    rows.append((9, LONG + " "))
    got = dict(plain(drop_shared_lines(docs(spark, rows)).select("doc_id", "n_dropped")))
    assert got == {0: 3, 1: 3, 2: 3, 3: 3, 9: 0}


def test_repeated_and_missing_ids_are_one_document(spark):
    rows = [(1, LONG)] * 9 + [(None, LONG)] * 3 + [(2, LONG), (3, LONG)]
    got = plain(drop_shared_lines(docs(spark, rows)).select("doc_id", "n_dropped"))
    assert {n for _, n in got} == {0}  # four documents
    rows.append((4, LONG))
    got = plain(drop_shared_lines(docs(spark, rows)).select("doc_id", "n_dropped"))
    assert all(n == (i != 4) for i, n in got) and len(got) == 15


def test_empty_table_and_clashing_columns(spark):
    assert drop_shared_lines(docs(spark, [])).count() == 0
    out = drop_shared_lines(clashing(docs(spark, [(1, "a\nb"), (2, None)])))
    assert out.columns.count("n_lines") == 1 and "a.b `c`" in out.columns and "row" in out.columns
    assert plain(out.select("doc_id", "text", "n_lines")) == [(1, "a\nb", 2), (2, "", 1)]
