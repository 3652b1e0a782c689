import random
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
from helpers import clashing, docs
from tokenizers import Tokenizer

from millrace.llm import tokens

PATH = public_tokenizers.path("byte_bpe_50k.json")


def ids_of(text):
    return [*Tokenizer.from_file(PATH).encode(text or "", add_special_tokens=False).ids, 2]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_chunked_ids_equal_those_of_whole_texts():
    rng = random.Random(8)
    enc, whole = tokens.Encoder(PATH), Tokenizer.from_file(PATH)
    bits = [" ", "  ", "   ", "\n", "\n\n", " \n", "\t", "a", "don't", "Éa", "12", "!?", " ", "x\0y",
            "<|endoftext|>", "日本", "é", ". ", "...", " ", "\r\n", "the", " The", "_", "\x1c"]
    for _ in range(4000):
        text = "".join(rng.choices(bits, k=rng.randint(0, 9)))
        wanted = whole.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(enc.encode(text), enc.dtype).tolist() == wanted, repr(text)


def test_memo_turns_over(monkeypatch):
    monkeypatch.setattr(tokens, "MEMO", 20)
    enc, whole = tokens.Encoder(PATH), Tokenizer.from_file(PATH)
    rng = random.Random(1)
    for _ in range(60):
        text = " ".join(f"w{rng.randint(0, 60)}x" for _ in range(rng.randint(1, 40)))
        assert np.frombuffer(enc.encode(text), enc.dtype).tolist() == whole.encode(text).ids


def test_worker_keeps_only_chunks_that_occur_again():
    enc = tokens.Encoder(PATH)
    for k in range(4):
        texts = [" ".join([*(f"w{i}x" for i in range(k * 9000 + j, k * 9000 + j + 300)), "again"]) for j in range(0, 9000, 300)]
        got = [np.frombuffer(x, enc.dtype).tolist() for x in tokens._encoded(enc, pa.array(texts))]
        assert got == [enc.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert " again" in enc.young and len(enc.young) + len(enc.old) < 100


def test_words_cut_from_their_punctuation_keep_their_ids():
    rng = random.Random(3)
    enc, whole = tokens.Encoder(PATH), Tokenizer.from_file(PATH)
    bits = [" ", "\n", "a", "Éa", "it's", "'re", "'", ",", "!!", "$", "_", "(x)", "×", "²", "ɐ", "12", "日", "\u0301", "\x85", "Ġ"]
    texts = ["".join(rng.choices(bits, k=rng.randint(0, 12))) for _ in range(3000)]
    got = [np.frombuffer(x, enc.dtype).tolist() for x in tokens._encoded(enc, pa.array(texts))]
    assert got == [whole.encode(t, add_special_tokens=False).ids for t in texts]


def test_round_trip_over_many_shards(spark, tmp_path):
    rng = random.Random(2)
    rows = [(i * 3 % 101, " ".join(rng.choices(["ab", "Cd,", "é", "x\ny"], k=rng.randint(0, 60)))) for i in range(101)]
    rows += [(200, None), (201, ""), (202, "word " * 20000), (None, "no id"), (7, "again"), (7, "again")]
    df = clashing(docs(spark, rows)).repartition(5)
    folder = f"file://{tmp_path}/t"
    manifest = tokens.write_tokens(df, folder, PATH, sequence_length=16, shard_tokens=300)
    got = sorted(map(tuple, tokens.read_documents(manifest, folder).collect()), key=lambda r: r[1])
    assert [g[0] for g in got] == sorted((r[0] for r in rows), key=lambda i: (i is not None, i or 0))
    start = 0
    wanted = {}
    for i, t in rows:
        wanted.setdefault(i, []).append(crc(ids_of(t)))
    for doc_id, at, n, c in got:
        assert at == start and c in wanted[doc_id]
        start += n
    shards = manifest.orderBy("base").collect()
    assert len(shards) > 3 and sum(s.n_tokens for s in shards) == start

    shard = tokens.Shard(folder, shards[0].shard)
    schema = shard.file.schema
    assert schema.field("ids").type == pa.list_(pa.field("item", pa.uint16(), False), 16)
    stream = [i for ids, mask in shard.batches() for i in ids[mask].tolist()]
    before = pa.total_allocated_bytes()
    ids, mask = shard.sequence(1)
    assert ids.to_pylist() == stream[16:32] and all(mask.to_pylist())
    assert pa.total_allocated_bytes() - before < 4096  # views, not copies
    last, mask = shard.sequence(shards[0].n_sequences - 1)
    assert sum(mask.to_pylist()) == shards[0].n_tokens - 16 * (shards[0].n_sequences - 1)


def test_empty_table(spark):
    assert tokens.token_report(docs(spark, []), PATH).count() == 0
