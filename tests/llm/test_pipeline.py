import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

import corpus_pipeline  # noqa: E402
from millrace.llm import queries  # noqa: E402
from millrace.llm.contamination import normal_words  # noqa: E402
from millrace.llm.simhash import fingerprint  # noqa: E402


@pytest.fixture(scope="module")
def stages(spark, sf):
    """Ids and texts before and after each stage."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = [("documents", docs.columns, docs.toPandas())]
    for name, stage in corpus_pipeline.STAGES:
        from millrace.llm.frames import saved

        docs = saved(stage(spark, docs, sf), "stage")
        out.append((name, docs.columns, docs.toPandas()))
    return out


def test_columns_and_rows(stages):
    for _, columns, frame in stages[:-1]:
        assert columns == stages[0][1]
        assert len(frame)
    assert set(stages[-1][1]) >= {"doc_id", "start", "n_tokens", "ids_crc32"}
    for (_, _, before), (name, _, after) in zip(stages[:-1], stages[1:]):
        assert set(after.doc_id) <= set(before.doc_id), name


def test_toxic_documents_go_by_their_score(spark, sf, stages):
    scores = queries.toxic_scores(spark, sf).toPandas()
    assert set(stages[1][2].doc_id) == set(scores[scores.predicted == 0].doc_id)


def test_one_of_each_near_copy_stays(stages):
    before, after = stages[1][2], stages[2][2]
    codes = {i: fingerprint((t or "").encode()) for i, t in zip(before.doc_id, before.text)}
    kept = sorted(after.doc_id)
    assert all((codes[a] ^ codes[b]).bit_count() > 2 for k, a in enumerate(kept) for b in kept[k + 1 :])
    root = {i: i for i in codes}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(codes)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if (codes[a] ^ codes[b]).bit_count() <= 2:
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    assert set(kept) == {find(i) for i in ids}


def test_no_benchmark_window_is_left_and_clean_texts_are_untouched(spark, sf, stages):
    items = spark.read.parquet(f"{sf}/benchmark.parquet").toPandas()
    windows = set()
    for t in items.text:
        w = normal_words(t)
        n = min(10, len(w))
        windows |= {tuple(w[k : k + n]) for k in range(len(w) - n + 1) if n}
    sizes = {len(w) for w in windows}

    def hit(text):
        w = normal_words(text)
        return any(tuple(w[k : k + n]) in windows for n in sizes for k in range(len(w) - n + 1))

    before = dict(zip(stages[2][2].doc_id, stages[2][2].text))
    after = dict(zip(stages[3][2].doc_id, stages[3][2].text))
    for i, t in before.items():
        if not hit(t):
            assert after[i] == t
    assert not any(hit(t) for t in after.values())


def test_mix_and_token_files_follow_their_input(stages):
    before, mixed, files = stages[3][2], stages[4][2], stages[5][2]
    counts = mixed.groupby("doc_id").size()
    assert counts.max() <= 2
    text = dict(zip(before.doc_id, before.text))
    assert all(text[i] == t for i, t in zip(mixed.doc_id, mixed.text))
    words = lambda f: sum(len((t or "").encode().split()) for t in f.text)
    assert words(mixed) == pytest.approx(1.5 * words(before), rel=0.1)
    assert files.groupby("doc_id").size().to_dict() == counts.to_dict()
    ordered = files.sort_values("start")
    assert ordered.doc_id.is_monotonic_increasing
    assert (ordered.start.values[1:] == (ordered.start + ordered.n_tokens).values[:-1]).all()


def test_run_gives_the_last_stage(spark, sf, stages):
    out = corpus_pipeline.run(spark, sf).toPandas()
    key = ["doc_id", "start", "n_tokens", "ids_crc32"]
    assert out[key].sort_values("start").values.tolist() == stages[-1][2][key].sort_values("start").values.tolist()
