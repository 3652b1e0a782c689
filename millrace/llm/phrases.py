"""Collocations: phrases counted in a dictionary of content-defined chunks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.frames import column, own_copy, portions, saved

#: What ends a piece; also the token that stands for it (no word can be one).
_BREAKS, _BREAK = r"[.,;:!?\x0A-\x0D]+", "."
#: One window in so many is a trigger, so chunks have about as many tokens.
_ONE_IN = 32
#: A filter of frequent phrases has 64 bits a phrase, within these powers of two.
_LEAST_BITS, _MOST_BITS = 16, 27


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _extended(prints: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Fingerprints of phrases and the word after each."""
    n = min(len(prints), len(words))
    return _mixed(prints[:n] * np.uint64(3) + words[:n] * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1))


def _split(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """Tokens of texts one after the other, their numbers, their fingerprints, and how
    many each text has."""
    lists = pc.ascii_split_whitespace(texts)
    owner, tokens = pc.list_parent_indices(lists), pc.list_flatten(lists)
    real = pc.not_equal(tokens, "")  # white space at the ends gives empty ones
    owner, tokens = owner.filter(real).to_numpy(), tokens.filter(real)
    coded = tokens.dictionary_encode()
    known = [xxhash.xxh3_64_intdigest(w) for w in coded.dictionary.cast(pa.large_binary()).to_pylist()]
    codes = coded.indices.to_numpy().astype(np.int64)
    prints = np.array(known, np.uint64)[codes]
    return tokens, codes, prints, np.bincount(owner, minlength=len(texts)).astype(np.int64)


def parse(texts: pa.Array, overlap: int, one_in: int = _ONE_IN) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Prefix-free parse of texts: (text number, chunk, whether it is its text's last).

    A window of ``overlap`` tokens is a trigger by its content alone. Chunks run from
    one trigger to the next, both included, so neighbours share ``overlap`` tokens and
    equal passages give equal chunks wherever they stand.
    """
    plain = pc.ascii_lower(pc.fill_null(own_copy(texts), "").cast(pa.large_string()))
    tokens, _, prints, lengths = _split(pc.replace_substring_regex(plain, _BREAKS, f" {_BREAK} "))
    ends = np.cumsum(lengths)
    begins, n = ends - lengths, len(tokens)
    windows = prints
    for i in range(1, overlap):
        windows = _extended(windows, prints[i:])
    owner = np.repeat(np.arange(len(texts)), lengths)
    starts = np.zeros(n, bool)
    inside = np.arange(len(windows)) + overlap <= ends[owner[: len(windows)]]
    starts[: len(windows)] = inside & (windows % np.uint64(one_in) == 0)
    starts[begins[lengths > 0]] = True
    first = np.flatnonzero(starts)
    text = owner[first]
    last = np.ones(len(first), bool)
    last[:-1] = text[1:] != text[:-1]
    stop = np.where(last, ends[text], np.append(first[1:], 0) + overlap)
    sizes = stop - first
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    index = np.arange(offsets[-1]) - np.repeat(offsets[:-1] - first, sizes)
    lists = pa.LargeListArray.from_arrays(pa.array(offsets), tokens.take(pa.array(index)))
    return text, pc.binary_join(lists, pa.scalar(" ", pa.large_string())).cast(pa.string()), last


def chunk_dictionary(docs: DataFrame, lang: Column, text: Column, overlap: int) -> DataFrame:
    """Distinct chunks (lang, chunk, last) and ``uses``: how often the parse has them."""

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in portions(batch.column(1)):
                owner, parts, last = parse(batch.column(1)[rows], overlap)
                langs = batch.column(0)[rows].take(pa.array(owner))
                yield pa.record_batch([langs, parts, pa.array(last)], ["lang", "chunk", "last"])

    texts = docs.select(F.coalesce(lang.cast("string"), F.lit("und")).alias("lang"), text.alias("text"))
    parsed = texts.mapInArrow(chunks, "lang string, chunk string, last boolean")
    return saved(parsed.groupBy("lang", "chunk", "last").agg(F.count(F.lit(1)).alias("uses")), "chunks")


class _Phrases:
    """Phrases that a portion of the dictionary owns: those that start before the
    tokens it shares with the next chunk."""

    def __init__(self, batch: pa.RecordBatch, overlap: int):
        langs = batch.column(0).dictionary_encode()
        self.langs = langs.dictionary
        self.tokens, self.codes, self.words, lengths = _split(own_copy(batch.column(1)).cast(pa.large_string()))
        last = batch.column(2).to_numpy(zero_copy_only=False)
        chunk, n = np.repeat(np.arange(len(batch)), lengths), len(self.tokens)
        self.lang = langs.indices.to_numpy().astype(np.int64)[chunk]
        self.uses = batch.column(3).to_numpy()[chunk]
        ends = np.cumsum(lengths)[chunk]
        here = np.arange(n)
        breaks = pc.equal(self.tokens, _BREAK).to_numpy(zero_copy_only=False)
        next_break = np.minimum.accumulate(np.where(breaks, here, n)[::-1])[::-1]
        owned = here < np.where(last[chunk], ends, ends - overlap)
        #: words from each token to the end of its piece in the chunk; 0: not owned
        self.room = np.minimum(next_break, ends) - here
        self.owned = owned & ~breaks
        seeds = [xxhash.xxh3_64_intdigest(x.encode()) for x in self.langs.to_pylist()]
        self.prints = [np.zeros(0, np.uint64), _mixed(self.words ^ np.array(seeds, np.uint64)[self.lang])]

    def of(self, size: int) -> np.ndarray:
        """Fingerprints of the phrases of so many words, by their first token."""
        while len(self.prints) <= size:
            self.prints.append(_extended(self.prints[-1], self.words[len(self.prints) - 1 :]))
        return self.prints[size]

    def hopeful(self, size: int, known: int, kept: np.ndarray | None) -> np.ndarray:
        """Which tokens start a phrase that can be frequent: its largest parts of
        ``known`` words (or it itself) are in the filter."""
        part = min(size, known)
        good = self.room >= size
        if part:
            bits = np.zeros(len(self.tokens), bool)
            at = self.of(part) & np.uint64(len(kept) * 8 - 1)
            bits[: len(at)] = kept[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8) & 1
            for i in range(size - part + 1):
                good[: len(good) - i] &= bits[i:]
        return good & self.owned


def _frequent(dictionary: DataFrame, overlap: int, sizes: tuple[int, ...], known: int, kept, min_count: int) -> np.ndarray:
    """Bits of all phrases of these sizes whose fingerprint is found often enough. A
    clash of fingerprints or bits lets a rare phrase pass, which the exact count drops."""

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in portions(batch.column(1)):
                own = _Phrases(batch.slice(rows.start, rows.stop - rows.start), overlap)
                at = [np.flatnonzero(own.hopeful(m, known, kept and kept.value)) for m in sizes]
                prints = np.concatenate([own.of(m)[i] for m, i in zip(sizes, at, strict=True)])
                gram, index = np.unique(prints, return_inverse=True)
                uses = np.zeros(len(gram), np.int64)
                np.add.at(uses, index, np.concatenate([own.uses[i] for i in at]))
                yield pa.record_batch([pa.array(gram.view(np.int64)), pa.array(uses)], ["gram", "uses"])

    counted = dictionary.mapInArrow(grams, "gram bigint, uses bigint").groupBy("gram").agg(F.sum("uses").alias("uses"))
    often = saved(counted.filter(F.col("uses") >= min_count).select("gram"), "frequent")
    power = min(_MOST_BITS, max(_LEAST_BITS, (64 * often.count()).bit_length()))
    place = F.col("gram").bitwiseAND(F.lit((1 << power) - 1)) + 1  # Spark counts bits from 1
    blocks = often.groupBy((F.bitmap_bucket_number(place) - 1).alias("block")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits")
    )
    bits = np.zeros((1 << power) // 8, np.uint8)
    for row in blocks.toLocalIterator():
        bits[row.block * len(row.bits) :][: len(row.bits)] = np.frombuffer(bytes(row.bits), np.uint8)
    return bits


def phrase_counts(
    docs: DataFrame, lang_col: str = "lang", text_col: str = "text", max_words: int = 5, min_count: int = 100
) -> DataFrame:
    """Exact counts of all phrases of up to ``max_words`` words found at least
    ``min_count`` times in their language: (lang, words, phrase, uses). Rows of 0 words
    hold the number of all words of a language.

    The texts are parsed into a dictionary of distinct chunks with their numbers of
    uses; all counting reads that. Neighbouring chunks overlap by ``max_words - 1``
    tokens, and a phrase belongs to the chunk that has it start before the overlap, so
    that each occurrence is counted once. Sizes grow by two a pass, over phrases whose
    parts were frequent, in fingerprints; the last pass counts what is left as text.
    Between passes goes a bit table of at most 16 MB.
    """
    overlap = max(1, max_words - 1)
    dictionary = chunk_dictionary(docs, column(lang_col), column(text_col), overlap)
    spark, known, kept = docs.sparkSession, 0, None
    filters: list = []  # per pass: (sizes, broadcast bits)
    while known < max(2, max_words - 1):
        sizes = (known + 1, known + 2)
        kept = spark.sparkContext.broadcast(_frequent(dictionary, overlap, sizes, known, kept, min_count))
        filters.append((sizes, kept))
        known += 2

    def phrases(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in portions(batch.column(1)):
                own = _Phrases(batch.slice(rows.start, rows.stop - rows.start), overlap)
                totals = np.zeros(len(own.langs), np.int64)
                np.add.at(totals, own.lang[own.owned], own.uses[own.owned])
                yield _rows(own.langs, 0, pa.nulls(len(totals), pa.string()), totals)
                base, ids = own.codes.max(initial=0) + 1, own.lang
                good = np.ones(len(own.tokens), bool)
                for m in range(1, max_words + 1):
                    size, bits = next(((s[-1], b) for s, b in filters if m <= s[-1]), (known, kept))
                    good &= own.hopeful(m, min(m, size), bits.value)
                    at = np.flatnonzero(good)
                    if not len(at):
                        break
                    # exact numbers of the phrases seen here, from those one word shorter
                    _, first, index = np.unique(ids[at] * base + own.codes[at + m - 1], return_index=True, return_inverse=True)
                    ids = np.zeros(len(good), np.int64)
                    ids[at] = index
                    uses = np.zeros(len(first), np.int64)
                    np.add.at(uses, index, own.uses[at])
                    at = at[first]
                    words = [own.tokens.take(pa.array(at + i)) for i in range(m)]
                    text = pc.binary_join_element_wise(*words, pa.scalar(" ", pa.large_string())).cast(pa.string())
                    yield _rows(own.langs.take(pa.array(own.lang[at])), m, text, uses)

    found = dictionary.mapInArrow(phrases, "lang string, words int, phrase string, uses bigint")
    counts = found.groupBy("lang", "words", "phrase").agg(F.sum("uses").alias("uses"))
    counts = saved(counts.filter((F.col("words") == 0) | (F.col("uses") >= min_count)), "phrases")
    for _, bits in filters:
        bits.destroy()
    return counts


def _rows(langs: pa.Array, size: int, phrases: pa.Array, uses: np.ndarray) -> pa.RecordBatch:
    words = pa.array(np.full(len(uses), size, np.int32))
    return pa.record_batch([langs, words, phrases, pa.array(uses)], ["lang", "words", "phrase", "uses"])


def _ranked(scored: DataFrame, limit: int) -> DataFrame:
    """First ``limit`` rows of each language. Rows are range partitioned by language
    and order, and numbered from the counts of the partitions before theirs, so that
    no task holds a language's phrases together."""
    order = ["lang", F.desc("score"), F.desc("a"), "phrase"]
    n = int(scored.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = scored.repartitionByRange(n, *order).sortWithinPartitions(*order)
    placed = saved(placed.withColumn("at", F.monotonically_increasing_id()), "ranked")
    task = F.shiftright("at", 33)
    tasks = placed.groupBy("lang", task.alias("task")).agg(F.count(F.lit(1)).alias("size"), F.min("at").alias("first"))
    before = F.sum("size").over(Window.partitionBy("lang").orderBy("task")) - F.col("size")
    tasks = tasks.select("lang", "task", (before - F.col("first")).alias("shift"))
    rank = F.col("at") + F.col("shift") + 1
    joined = placed.withColumn("task", task).join(tasks, ["lang", "task"])
    return joined.withColumn("rank", rank).filter(F.col("rank") <= limit)


def collocations(
    docs: DataFrame,
    lang_col: str = "lang",
    text_col: str = "text",
    max_words: int = 5,
    min_count: int = 100,
    share: int = 100,
    limit: int = 2000,
) -> DataFrame:
    """The phrases of each language whose words attract each other most.

    Texts are lower-cased (A-Z), cut into pieces at ``.,;:!?`` and ``\\x0A-\\x0D`` and
    into words at space and tab. A candidate is a phrase of 2 to ``max_words`` words
    with ``a >= min_count`` occurrences inside pieces. A cut after k words scores
    ``floor(1000 * a * n / (l * r))``, with the counts l and r of its parts and all n
    words of the language; the lowest cut counts, the first of equal ones. Candidates
    inside a longer one with at least ``share`` percent of their count are dropped.
    Returns (lang, rank, phrase, a, l, r, n, score) of the first ``limit`` of each
    language by score, count (both descending) and phrase (by bytes).

    * A null language is ``und``; a null, empty or blank text has no words. Languages
      without candidates have no rows; an empty table gives an empty result.
    * Repeated rows and ids count as often as they stand; ids are not looked at, and
      neither are other columns. Texts have no length limit.
    * Products are decimals of 38 digits: exact up to 10^17 words.
    """
    counts = phrase_counts(docs, lang_col, text_col, max_words, min_count)
    phrases = counts.filter(F.col("words") > 0)
    candidates = phrases.filter(F.col("words") > 1).withColumnRenamed("uses", "a")
    # Of longer phrases the next ones are enough: a phrase inside any longer one is
    # inside one of a single word more that has at least that one's count.
    whole = F.split("phrase", " ")
    cuts = F.transform(
        F.sequence(F.lit(1), F.col("words") - 1),
        lambda k: F.struct(
            k.alias("k"),
            F.array_join(F.slice(whole, F.lit(1), k), " ").alias("left"),
            F.array_join(F.slice(whole, k + 1, F.col("words") - k), " ").alias("right"),
        ),
    )
    cut = candidates.select("lang", "phrase", "words", "a", F.explode(cuts).alias("cut"))
    sides = cut.select(
        "lang", "phrase", "words", "a", F.col("cut.k").alias("k"),
        F.explode(F.array(
            F.struct(F.lit("l").alias("side"), F.col("cut.left").alias("part")),
            F.struct(F.lit("r").alias("side"), F.col("cut.right").alias("part")),
        )).alias("at"),
    ).select("lang", "phrase", "words", "a", "k", "at.side", "at.part")
    known = phrases.select("lang", F.col("phrase").alias("part"), "uses")
    facts = sides.join(known, ["lang", "part"]).select("lang", "phrase", "a", "k", "side", "uses", F.lit(None).cast("long").alias("longer"))
    near = (F.col("k") == 1) & (F.col("side") == "r") | (F.col("k") == F.col("words") - 1) & (F.col("side") == "l")
    longer = sides.filter(near & (F.col("words") > 2)).select(
        "lang", F.col("part").alias("phrase"), F.lit(None).cast("long").alias("a"), F.lit(0).alias("k"),
        F.lit("").alias("side"), F.lit(None).cast("long").alias("uses"), F.col("a").alias("longer"),
    )
    of = lambda k, side: F.max(F.when((F.col("k") == k) & (F.col("side") == side), F.col("uses")))
    pairs = [of(k, s).alias(f"{s}{k}") for k in range(1, max_words) for s in ("l", "r")]
    gathered = facts.unionByName(longer).groupBy("lang", "phrase").agg(F.max("a").alias("a"), F.max("longer").alias("longer"), *pairs)
    left = gathered.filter(F.col("a").isNotNull() & ~F.coalesce(F.col("longer") * 100 >= F.col("a") * share, F.lit(False)))
    totals = saved(counts.filter(F.col("words") == 0).select("lang", F.col("uses").alias("n")), "totals")
    exact = lambda name: F.col(name).cast("decimal(20,0)")

    def scored(k: int) -> Column:
        value = F.call_function("div", F.lit(1000).cast("decimal(4,0)") * exact("a") * exact("n"), exact(f"l{k}") * exact(f"r{k}"))
        cell = F.struct(value.alias("score"), F.lit(k).alias("k"), F.col(f"l{k}").alias("l"), F.col(f"r{k}").alias("r"))
        return F.when(F.col(f"l{k}").isNotNull(), cell)

    lowest = F.array_min(F.array_compact(F.array(*[scored(k) for k in range(1, max_words)])))
    best = left.join(totals, "lang").select("lang", "phrase", "a", "n", lowest.alias("low"))
    best = saved(best.select("lang", "phrase", "a", F.col("low.l").alias("l"), F.col("low.r").alias("r"), "n", F.col("low.score").alias("score")), "scored")
    return _ranked(best, limit).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
