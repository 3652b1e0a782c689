"""Token ids of a corpus in Arrow files of equal-length sequences."""

from __future__ import annotations

import json
import os
import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.llm.frames import column, own_copy, portions, saved
from millrace.session import scratch_dir

#: Chunks a worker remembers (two generations of about this many), sequences of a batch.
MEMO, BATCH_SEQUENCES = 100_000, 256
#: Bytes of the texts that are encoded together, new chunks that the tokenizer gets at once.
TOGETHER, LEARN = 4_000_000, 4_000
SHARDS = "shard string, part int, seq int, n_docs long, n_tokens long, n_sequences long"

# White space where cutting before a space or around a line break could differ
# from the tokenizer's own cuts: runs of three, runs of two at the end, other
# white space, and texts with the cut mark or a special token.
_CAREFUL = (
    r"[ \n][ \n](?:[ \n]|\z)|[\x09\x0B-\x0D\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]|\x00|<\|"
)
# Where a Latin letter or digit meets ASCII punctuation the tokenizer always cuts,
# except before the apostrophe of a contraction.
_TAIL = r"([0-9A-Za-z\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{24F}])([!-&(-/:-@\[-`{-~])"


_PUNCTUATION = [c for c in map(chr, range(33, 127)) if not c.isalnum() and c != "'"]

# Words with a leading space whose cuts into letters, digits and others are beyond
# doubt in all versions of Unicode; no special token is among them. How a byte-level
# tokenizer cuts them.
_SURE = r"\A [!-;=-~\x{C0}-\x{24F}]+\z"
_LETTERS = r"A-Za-z\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{24F}"
_CUTS = rf"'(?:[sdmt]|ll|ve|re)| ?[{_LETTERS}]+| ?[0-9]+| ?[^ 0-9{_LETTERS}]+"
#: Pieces of the vocabulary that show whether tiktoken finds the tokenizer's ids.
PROBES = 2_000


class Encoder:
    """Ids of texts from a byte-level BPE of the ``tokenizers`` library.

    The tokenizer never merges over the start of a word with its leading space,
    so a text's ids are those of its space-led chunks in turn. Texts that are
    encoded together ask once for each distinct chunk, and the worker keeps the ids
    of those that occur again; texts with unusual white space or special tokens are
    encoded whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        size = self.tokenizer.get_vocab_size()
        self.dtype = np.dtype("<u4" if size > 1 << 16 else "<u2")
        # ids that begin with a space, as byte-level vocabularies write it
        self.leads = np.array([(self.tokenizer.id_to_token(i) or "").startswith("\u0120") for i in range(size)])
        self.mark = self.whole("\n")
        self.fixed = {"": b"", "\n": self.mark, " ": self.whole(" ")}
        self.young: dict[str, bytes] = dict(self.fixed)
        self.old: dict[str, bytes] = {}
        # chunks can be encoded in one go when a line break stands for itself
        a, b = self.whole("a"), self.whole(" b")
        self.joins = len(self.mark) == self.dtype.itemsize and (
            self.whole("a\n b\na b") == a + self.mark + b + self.mark + a + b
        )
        # and words cut from their punctuation when no id has parts of both
        self.tails = all(self.whole(f"a{c}a") == a + self.whole(c) + a for c in _PUNCTUATION)
        self.path, self.quick = path, None

    def quicken(self) -> None:
        """From now on tiktoken encodes the words it is sure to encode alike, several times
        as fast. It merges by the ids of the results, so these have to be in the order of
        the merges; an absent library or another kind of vocabulary changes nothing."""
        if self.quick is not None:
            return
        self.quick = False
        try:
            import tiktoken
        except ImportError:
            return
        with open(self.path, encoding="utf-8") as f:
            spec = json.load(f)
        model, cuts = spec["model"], spec.get("pre_tokenizer") or {}
        merged = ["".join(m if isinstance(m, list) else m.split(" ")) for m in model.get("merges", ())]
        order = [model["vocab"].get(m, -1) for m in merged]
        plain = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
        if (
            any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix"))
            or any(model.get(k) for k in ("byte_fallback", "ignore_merges")) or spec.get("normalizer")
            or any(cuts.get(k) != x for k, x in plain.items()) or any(a >= b for a, b in zip(order, order[1:], strict=False))
            or not all("<" in t["content"] for t in spec.get("added_tokens") or ())
        ):
            return
        # bytes as byte-level vocabularies write them
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(sorted({*range(256)} - {*shown}))}
        single, known = {c for c in model["vocab"] if len(c) == 1}, {*merged}
        ranks = {bytes(byte[c] for c in t): i for t, i in model["vocab"].items() if t in single or t in known}
        if len(single) != 256 or max(map(model["vocab"].get, single)) > min(order, default=1 << 32):
            return
        quick = tiktoken.Encoding("quick", pat_str=_CUTS, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        led = [t.decode(errors="ignore") for t in ranks if t[:1] == b" "]
        probes = pa.array(led).filter(pc.match_substring_regex(led, _SURE)).to_pylist()
        probes = "".join(w + x[1:] for w, x in zip(probes[-PROBES:], probes[::-1], strict=False))
        if np.array(quick(probes), self.dtype).tobytes() == self.whole(probes):
            self.quick = quick

    def whole(self, text: str) -> bytes:
        ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return np.array(ids, self.dtype).tobytes()

    def _joined(self, chunks: list[str], led: bool) -> Iterator[bytes]:
        """Ids of chunks that the tokenizer gets as one text: words with their leading
        space follow each other, others are parted by line breaks."""
        for at in range(0, len(chunks), LEARN):
            part = chunks[at : at + LEARN]
            text = "".join(part) if led else "\n".join(part)
            ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.dtype)
            if led:
                begin = np.flatnonzero(self.leads[ids])
                end = np.append(begin[1:], len(ids))
            else:
                end = np.append(np.flatnonzero(ids == np.frombuffer(self.mark, self.dtype)[0]), len(ids))
                begin = np.append(0, end[:-1] + 1)
            if len(begin) != len(part):  # a vocabulary that cuts otherwise
                yield from map(self.whole, part)
                continue
            raw, width = ids.tobytes(), self.dtype.itemsize
            yield from (raw[b:e] for b, e in zip((begin * width).tolist(), (end * width).tolist(), strict=True))

    def _learnt(self, chunks: list[str]) -> dict[str, bytes]:
        led = [c for c in chunks if c[0] == " "]
        other = [c for c in chunks if c[0] != " "]
        found = dict(zip(led, self._joined(led, True), strict=True))
        found.update(zip(other, self._joined(other, False), strict=True))
        return found

    def chunks(self, chunks: list[str], again: list[str] | None = None) -> list[bytes]:
        """Ids of chunks, each a word with or without its leading space. Those in
        ``again`` (all, unless it is given) are remembered."""
        out = list(map(self.young.get, chunks))
        if None in out:
            missing = dict.fromkeys(c for c, x in zip(chunks, out, strict=True) if x is None)
            found = {c: self.old[c] for c in missing if c in self.old}
            found.update(self._learnt([c for c in missing if c not in found]))
            out = [found[c] if x is None else x for c, x in zip(chunks, out, strict=True)]
            kept = found if again is None else {c: found[c] for c in again if c in found}
            if len(self.young) + len(kept) > MEMO:
                self.old, self.young = self.young, dict(self.fixed)
            self.young.update(kept)
        return out

    def joined_ids(self, parts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of chunks one after another, and where each chunk's ids end."""
        coded = parts.dictionary_encode()
        names, code = coded.dictionary, coded.indices.to_numpy()
        sure = np.zeros(len(names), bool)
        if self.quick:
            sure = pc.match_substring_regex(names, _SURE).to_numpy(zero_copy_only=False)
        size = np.zeros(len(names), np.int64)
        ids = self._quick_ids(names, sure, size)
        rest = np.flatnonzero(~sure)
        chunks = names.take(pa.array(rest)).to_numpy(zero_copy_only=False)
        again = chunks[np.bincount(code, minlength=len(names))[rest] > 1].tolist()
        known = self.chunks(chunks.tolist(), again)
        size[rest] = np.fromiter(map(len, known), np.int64, len(known)) // self.dtype.itemsize
        ids.append(np.frombuffer(b"".join(known), self.dtype))
        start, order = np.empty(len(names), np.int64), np.concatenate((np.flatnonzero(sure), rest))
        start[order] = np.cumsum(size[order]) - size[order]
        n = size[code]
        ends = np.cumsum(n)
        total = int(ends[-1]) if len(ends) else 0
        kind = np.int32 if total + int(size.sum()) < 1 << 31 else np.int64
        at = np.repeat((start[code] - (ends - n)).astype(kind), n)
        at += np.arange(total, dtype=kind)
        return np.concatenate(ids).take(at), ends

    def _quick_ids(self, names: pa.Array, sure: np.ndarray, size: np.ndarray) -> list[np.ndarray]:
        """Ids of the words that are ``sure``, whose numbers go to ``size``. Words that turn
        out to be cut otherwise are no longer sure."""
        out, rows = [], np.flatnonzero(sure)
        for first in range(0, len(rows), LEARN):
            own = rows[first : first + LEARN]
            words = pa.ListArray.from_arrays([0, len(own)], names.take(pa.array(own)).cast(pa.string()))
            ids = np.array(self.quick(pc.binary_join(words, "")[0].as_py()), self.dtype)
            begin = np.flatnonzero(self.leads[ids])
            if len(begin) == len(own):
                size[own] = np.diff(begin, append=len(ids))
                out.append(ids)
            else:
                sure[own] = False
        return out

    def encode_all(self, texts: pa.Array) -> list[bytes]:
        """Ids of several texts, none of them null."""
        texts = texts.cast(pa.large_string())
        careful = np.ones(len(texts), bool)
        if self.joins:
            careful = pc.match_substring_regex(texts, _CAREFUL).to_numpy(zero_copy_only=False)
        out: list[bytes] = [b""] * len(texts)
        for i in np.flatnonzero(careful).tolist():
            out[i] = self.whole(texts[i].as_py())
        plain = np.flatnonzero(~careful)
        if len(plain):
            marked = pc.replace_substring(pc.replace_substring(texts.take(pa.array(plain)), "\n", "\0\n\0"), " ", "\0 ")
            if self.tails:
                marked = pc.replace_substring_regex(marked, _TAIL, "\\1\0\\2")
            parts = pc.split_pattern(marked, "\0")
            ids, ends = self.joined_ids(pc.list_flatten(parts))
            last = np.append(0, ends)[np.cumsum(pc.list_value_length(parts).to_numpy())].tolist()
            for i, begin, end in zip(plain.tolist(), [0, *last[:-1]], last, strict=True):
                out[i] = ids[begin:end].tobytes()
        return out

    def encode(self, text: str) -> bytes:
        return self.encode_all(pa.array([text]))[0]


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder per worker process and vocabulary file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def _file_system(uri: str):
    return pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def _sequence_schema(dtype: np.dtype, length: int, end_id: int) -> pa.Schema:
    id_type = pa.uint32() if dtype.itemsize == 4 else pa.uint16()
    return pa.schema(
        [
            pa.field("ids", pa.list_(pa.field("item", id_type, False), length), False),
            pa.field("mask", pa.list_(pa.field("item", pa.bool_(), False), length), False),
        ],
        {"sequence_length": str(length), "end_id": str(end_id)},
    )


class _ShardWriter:
    """One shard: ``<name>.arrow`` holds the sequences, ``<name>.docs.arrow`` the
    documents with their place among the shard's ids."""

    def __init__(self, fs, folder: str, schema: pa.Schema, dtype: np.dtype, length: int, id_type: pa.DataType):
        # a name of its own for every attempt: a retried task leaves no half file
        self.name = uuid.uuid4().hex
        self.length, self.schema, self.dtype = length, schema, dtype
        self.sink = fs.open_output_stream(f"{folder}/{self.name}.arrow")
        self.writer = pa.ipc.new_file(self.sink, schema)
        docs = pa.schema([("doc_id", id_type), ("start", pa.int64()), ("n_tokens", pa.int64())])
        self.docs_sink = fs.open_output_stream(f"{folder}/{self.name}.docs.arrow")
        self.docs_writer = pa.ipc.new_file(self.docs_sink, docs)
        self.docs_schema = docs
        self.docs: list[tuple] = []
        self.held, self.held_ids = [], 0
        self.n_docs = self.n_tokens = self.n_sequences = 0

    def add(self, doc_id, ids: bytes) -> None:
        n = len(ids) // self.dtype.itemsize
        self.docs.append((doc_id, self.n_tokens, n))
        self.n_docs, self.n_tokens = self.n_docs + 1, self.n_tokens + n
        self.held.append(ids)
        self.held_ids += n
        if self.held_ids >= self.length * BATCH_SEQUENCES:
            self._flush(False)
        if len(self.docs) >= 10_000:
            self._flush_docs()

    def _flush(self, final: bool) -> None:
        ids = np.frombuffer(b"".join(self.held), self.dtype)
        full = len(ids) // self.length * self.length
        take = len(ids) if final else full
        for at in range(0, take, self.length * BATCH_SEQUENCES):
            part = ids[at : min(take, at + self.length * BATCH_SEQUENCES)]
            pad = -len(part) % self.length
            real = np.concatenate((np.ones(len(part), bool), np.zeros(pad, bool)))
            part = np.concatenate((part, np.zeros(pad, self.dtype)))
            columns = [
                pa.FixedSizeListArray.from_arrays(pa.array(v), type=self.schema.field(i).type)
                for i, v in enumerate((part, real))
            ]
            self.writer.write_batch(pa.record_batch(columns, schema=self.schema))
            self.n_sequences += len(part) // self.length
        self.held = [] if final else [ids[full:].tobytes()]
        self.held_ids = len(ids) - take

    def _flush_docs(self) -> None:
        if self.docs:
            columns = [pa.array(c, f.type) for c, f in zip(zip(*self.docs, strict=True), self.docs_schema, strict=True)]
            self.docs_writer.write_batch(pa.record_batch(columns, schema=self.docs_schema))
        self.docs = []

    def close(self) -> tuple:
        self._flush(True)
        self._flush_docs()
        for x in (self.writer, self.sink, self.docs_writer, self.docs_sink):
            x.close()
        return self.name, self.n_docs, self.n_tokens, self.n_sequences


def _encoded(enc: Encoder, texts: pa.Array) -> Iterator[bytes]:
    """Ids of a column of texts, a bounded number of bytes at a time."""
    for rows in portions(texts, TOGETHER):
        yield from enc.encode_all(own_copy(texts[rows]))


def write_tokens(
    docs: DataFrame,
    folder: str,
    vocabulary: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    end_id: int = 2,
    sequence_length: int = 2048,
    shard_tokens: int = 1 << 25,
) -> DataFrame:
    """Encode every whole text and write the ids; returns the manifest.

    ``vocabulary`` names a ``tokenizers`` file that all executors can read, and
    ``folder`` a place that all executors see. Documents are laid out in
    ascending id order, each followed by ``end_id``, as one stream cut into
    shards of whole documents. A shard is an Arrow file whose batches hold
    fixed-size lists: sequences of ``sequence_length`` ids and their mask, false
    on the padding of the shard's last sequence. So the n-th sequence lies at a
    fixed place of a memory-mapped file.

    The manifest has one row per shard in stream order: shard, n_docs, n_tokens,
    n_sequences and base (ids in earlier shards). Only shards of successful task
    attempts are in it.

    * A null text is an empty one: its ids are just ``end_id``. A missing id
      sorts first. Rows with equal ids follow each other by text hash and text.
    * Texts have no length limit: a text that exceeds a shard makes a longer one.
    * An empty table gives an empty manifest.
    """
    source = docs.select(
        column(id_col).alias("doc_id"), F.coalesce(column(text_col), F.lit("")).alias("text")
    )
    tie = F.xxhash64("text")
    ordered = source.repartitionByRange("doc_id", tie).sortWithinPartitions("doc_id", tie, "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary)
        end = np.array([end_id], enc.dtype).tobytes()
        schema = _sequence_schema(enc.dtype, sequence_length, end_id)
        fs, path = _file_system(folder)
        part, shard, done = TaskContext.get().partitionId(), None, []
        for batch in batches:
            ids = batch.column(0)
            for doc_id, encoded in zip(ids.to_pylist(), _encoded(enc, batch.column(1)), strict=True):
                if shard is None:
                    fs.create_dir(path, recursive=True)
                    shard = _ShardWriter(fs, path, schema, enc.dtype, sequence_length, ids.type)
                shard.add(doc_id, encoded + end)
                if shard.n_tokens >= shard_tokens:
                    done.append(shard.close())
                    shard = None
        if shard is not None:
            done.append(shard.close())
        rows = [
            {"shard": s, "part": part, "seq": i, "n_docs": d, "n_tokens": t, "n_sequences": q}
            for i, (s, d, t, q) in enumerate(done)
        ]
        if rows:
            yield pa.RecordBatch.from_pylist(
                rows,
                pa.schema(
                    [
                        ("shard", pa.string()), ("part", pa.int32()), ("seq", pa.int32()),
                        ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("n_sequences", pa.int64()),
                    ]
                ),
            )

    shards = saved(ordered.mapInArrow(write, SHARDS), "shards")
    earlier = W.orderBy("part", "seq").rowsBetween(W.unboundedPreceding, -1)  # one row per shard
    return shards.withColumn("base", F.coalesce(F.sum("n_tokens").over(earlier), F.lit(0).cast("long")))


class Shard:
    """Random access to a written shard; on a local path the file is mapped and
    sequences and masks are views into it."""

    def __init__(self, folder: str, name: str):
        fs, path = _file_system(folder)
        local = isinstance(fs, pafs.LocalFileSystem)
        at = lambda p: pa.memory_map(p) if local else fs.open_input_file(p)
        self.file = pa.ipc.open_file(at(f"{path}/{name}.arrow"))
        self.docs = pa.ipc.open_file(at(f"{path}/{name}.docs.arrow"))

    def sequence(self, n: int) -> tuple[pa.Array, pa.Array]:
        """Ids and mask of sequence ``n``, without a copy."""
        batch = self.file.get_batch(n // BATCH_SEQUENCES)
        row = n % BATCH_SEQUENCES
        return batch.column(0)[row].values, batch.column(1)[row].values

    def batches(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """All ids and masks, batch by batch, as flat arrays."""
        for i in range(self.file.num_record_batches):
            batch = self.file.get_batch(i)
            ids, mask = (batch.column(k).flatten() for k in (0, 1))
            yield ids.to_numpy(), mask.to_numpy(zero_copy_only=False)


def read_documents(manifest: DataFrame, folder: str, id_type: str = "bigint") -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) read back from the files.

    start counts the ids of all documents before; ids_crc32 is the CRC-32 of the
    document's ids as little-endian unsigned 32-bit integers. One shard is read
    at a time, batch by batch."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                shard = Shard(folder, row["shard"])
                stream = (ids[mask].astype("<u4") for ids, mask in shard.batches())
                held = np.empty(0, "<u4")
                for i in range(shard.docs.num_record_batches):
                    docs = shard.docs.get_batch(i)
                    sums = []
                    for n in docs.column(2).to_pylist():
                        crc = 0
                        while n > len(held):
                            crc, n = zlib.crc32(held.tobytes(), crc), n - len(held)
                            held = next(stream)
                        crc, held = zlib.crc32(held[:n].tobytes(), crc), held[n:]
                        sums.append(crc)
                    start = np.asarray(docs.column(1)) + row["base"]
                    yield pa.record_batch(
                        [docs.column(0), pa.array(start), docs.column(2), pa.array(sums, pa.int64())],
                        ["doc_id", "start", "n_tokens", "ids_crc32"],
                    )

    rows = saved(manifest.select("shard", "base"), "manifest")
    # shards are dealt out one by one; the manifest itself is one small file
    dealt = rows.repartition(max(1, rows.count()))
    return dealt.mapInArrow(read, f"doc_id {id_type}, start long, n_tokens long, ids_crc32 long")


def token_report(
    docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", **options
) -> DataFrame:
    """Write the ids below the shared scratch folder and read them back."""
    spark: SparkSession = docs.sparkSession
    folder = scratch_dir(spark, "tokens")
    manifest = write_tokens(docs, folder, vocabulary, id_col, text_col, **options)
    kind = docs.select(column(id_col).alias("i")).schema["i"].dataType.simpleString()
    back = read_documents(manifest, folder, kind)
    return back if id_col == "doc_id" else back.withColumnRenamed("doc_id", id_col)
