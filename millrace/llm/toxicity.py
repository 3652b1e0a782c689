"""Toxicity from the nearest labelled examples by TF-IDF cosine."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.frames import column, own_copy, packed, portions, saved, unpacked

#: Lengths of word beginnings that can be terms beside whole words.
PREFIXES = (4, 5, 6, 7)
#: A term's weight is its TF-IDF times BASE, and more the further its likelihood ratio
#: between the classes is above NOISE.
BASE, NOISE, SCALE = 0.01, 8.0, 10.0
#: Terms in so large a part of the examples are held as columns, others as postings.
_COMMON = 0.1
RESULT = "struct<score: double, evidence: array<struct<example: string, toxic: double, cosine: double>>, terms: array<string>>"
_NO_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Of all words of texts (A-Z lower-cased, parted by ASCII other than letters and
    digits): the text, the number of the word, and the distinct words by number."""
    plain = pc.ascii_lower(pc.fill_null(own_copy(texts).cast(pa.large_string()), ""))
    lists = pc.ascii_split_whitespace(pc.replace_substring_regex(plain, _NO_WORD, " "))
    owner, flat = pc.list_parent_indices(lists), pc.list_flatten(lists)
    real = pc.not_equal(flat, "")
    coded = flat.filter(real).dictionary_encode()
    return owner.filter(real).to_numpy().astype(np.int64), coded.indices.to_numpy().astype(np.int64), coded.dictionary


def _sums(owner: np.ndarray, term: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts summed by text and term, in this order."""
    width = int(term.max(initial=0)) + 1
    key, index = np.unique(owner * width + term, return_inverse=True)
    return key // width, key % width, np.bincount(index, count, len(key)).astype(np.int64)


class Vocabulary:
    """Terms by number: all words of the examples, and word beginnings (marked ^)."""

    def __init__(self, terms: list[str]):
        self.terms = pa.array(terms, pa.large_string())
        own = {n: [(i, t) for i, t in enumerate(terms) if t[0] == "^" and len(t) == n + 1] for n in PREFIXES}
        self.starts = {n: pa.array([t[1:] for _, t in x], pa.large_string()) for n, x in own.items()}
        self.number = {n: np.array([i for i, _ in x], np.int64) for n, x in own.items()}

    def counts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, term, count) of texts; words that are no terms are numbered from the
        last term on, anew in each call."""
        owner, code, words = _words(texts)
        owner, code, count = _sums(owner, code, np.ones(len(code)))
        known = pc.index_in(words, self.terms)
        new = pa.array(np.arange(len(words)) + len(self.terms), pa.int64())
        term = pc.coalesce(known.cast(pa.int64()), new).to_numpy()[code]
        found = [(owner, term, count)]
        sizes = pc.utf8_length(words)
        for n, starts in self.starts.items():
            if not len(starts):
                continue
            at = pc.index_in(pc.if_else(pc.greater(sizes, n), pc.utf8_slice_codeunits(words, 0, n), None), starts)
            number = np.where(at.is_valid(), self.number[n][pc.fill_null(at, 0).to_numpy()], -1)[code]
            found.append((owner[number >= 0], number[number >= 0], count[number >= 0]))
        return _sums(*(np.concatenate(x) for x in zip(*found, strict=True)))


class BlockMaxIndex:
    """Exact top-k by dot product over sparse non-negative vectors.

    Vectors are laid in blocks of ``width`` with the same heaviest terms. Terms that
    many vectors hold are columns of a matrix, with their largest value in each block;
    the others are postings. For a batch of queries, the largest values give a bound
    for each block in one product, to which the postings' exact sums are added. Blocks
    are taken from the highest bound on, each query's own best first, and opened for
    those queries whose k-th best score is below their bound, so nothing that could
    matter stays closed. Products are
    single precision; scores count to five digits, and equal ones go by number.
    """

    def __init__(self, n: int, owner: np.ndarray, term: np.ndarray, weight: np.ndarray, n_terms: int, width: int = 64):
        lead = np.full(n, -1, np.int64)
        by_weight = np.lexsort((-term, weight, owner))
        last = np.append(owner[by_weight][1:] != owner[by_weight][:-1], True) if len(owner) else np.zeros(0, bool)
        lead[owner[by_weight][last]] = term[by_weight][last]
        self.order = np.lexsort((np.arange(n), lead))
        place = np.empty(n, np.int64)
        place[self.order] = np.arange(n)
        self.width, self.n_blocks = width, max(1, -(-n // width))
        common = np.flatnonzero(np.bincount(term, minlength=n_terms) >= max(2, _COMMON * n))
        self.column = np.full(n_terms + 1, -1, np.int64)
        self.column[common] = np.arange(len(common))
        dense = self.column[term] >= 0
        self.matrix = np.zeros((self.n_blocks * width, len(common)), np.float32)
        self.matrix[place[owner[dense]], self.column[term[dense]]] = weight[dense]
        self.peaks = np.ascontiguousarray(self.matrix.reshape(self.n_blocks, width, -1).max(axis=1).T)
        rare = np.flatnonzero(~dense)
        rare = rare[np.argsort(term[rare], kind="stable")]
        self.begin = np.searchsorted(term[rare], np.arange(n_terms + 2))
        self.places, self.values = place[owner[rare]].astype(np.int32), weight[rare].astype(np.float32)
        self.opened = self.seen = 0

    def search(self, n: int, owner: np.ndarray, term: np.ndarray, weight: np.ndarray, k: int):
        """For each of ``n`` queries the vectors with a positive score and the scores,
        best first, ties by number. Terms beyond the index are met by nothing."""
        size = self.n_blocks * self.width
        inside = term < len(self.column) - 1
        owner, term, weight = owner[inside], term[inside], weight[inside]
        at = self.column[term]
        query = np.zeros((n, self.matrix.shape[1]), np.float32)
        query[owner[at >= 0], at[at >= 0]] = weight[at >= 0]
        owner, term, weight = owner[at < 0], term[at < 0], weight[at < 0]
        first, count = self.begin[term], self.begin[term + 1] - self.begin[term]
        index = np.arange(count.sum()) + np.repeat(first - np.cumsum(count) + count, count)
        cells = np.repeat(owner, count) * size + self.places[index]
        part = np.bincount(cells, np.repeat(weight, count) * self.values[index], n * size).astype(np.float32)
        part = part.reshape(n, self.n_blocks, self.width)
        bounds = query @ self.peaks + part.max(axis=2)
        self.seen += n * self.n_blocks
        # per query the best so far; score and number in one whole number to sort by
        total = len(self.order) + 1
        best = np.zeros((n, k), np.int64)
        exact = np.zeros((n, k), np.float32)
        closed = bounds > 0

        def open_block(b: int, wanted: np.ndarray) -> None:
            closed[wanted, b] = False
            self.opened += len(wanted)
            own = self.order[b * self.width : (b + 1) * self.width]
            dots = query[wanted] @ self.matrix[b * self.width : b * self.width + len(own)].T + part[wanted, b, : len(own)]
            rank = np.round(dots * 1e5).astype(np.int64) * total + (total - 1 - own)
            rank[dots <= 0] = 0
            rank = np.concatenate((best[wanted], rank), axis=1)
            dots = np.concatenate((exact[wanted], dots), axis=1)
            top = np.argsort(-rank, axis=1, kind="stable")[:, :k]
            best[wanted] = np.take_along_axis(rank, top, axis=1)
            exact[wanted] = np.where(best[wanted] > 0, np.take_along_axis(dots, top, axis=1), 0)

        for turn in np.argsort(-bounds, axis=1, kind="stable")[:, :2].T:  # each query's own best blocks
            for b in np.unique(turn).tolist():
                if len(wanted := np.flatnonzero((turn == b) & closed[:, b])):
                    open_block(b, wanted)
        for b in np.argsort(-bounds.max(axis=0), kind="stable").tolist():
            if len(wanted := np.flatnonzero(closed[:, b] & (bounds[:, b] + 2e-5 >= exact[:, -1]))):
                open_block(b, wanted)
        for q in range(n):
            real = best[q] > 0
            yield total - 1 - best[q][real] % total, exact[q][real]


class Voter:
    """Vocabulary, index and votes: everything a task needs to score a text.

    ``examples`` are (id, toxic, n) of the labelled texts, ``vectors`` their (text,
    term, count) arrays, ``documents`` the number of documents behind ``frequency``.
    """

    def __init__(self, terms, gain, frequency, documents: int, examples: list[tuple], vectors, k: int, counts: dict[int, int]):
        self.vocabulary, self.k = Vocabulary(terms), k
        self.base = BASE * (math.log(1 + documents) + 1)
        relevance = BASE + np.maximum(0.0, np.asarray(gain, float) - NOISE) / SCALE
        self.weight = (np.log((1 + documents) / (1 + np.asarray(frequency, float))) + 1) * relevance
        self.telling = np.asarray(gain, float) > NOISE
        owner, term, count = vectors
        toxic = np.array([y for _, y, _ in examples], float)
        n = np.array([n for _, _, n in examples], float)
        # what an example stands for, as classes are sampled at their own rates
        drawn = {y: n[toxic == y].sum() for y in (0, 1)}
        rate = {y: counts.get(y, 0) / drawn[y] for y in drawn if drawn[y]}
        mean = sum(rate[y] * drawn[y] for y in rate) / max(1.0, n.sum())
        worth = n * np.array([rate[y] / mean for y in toxic]) if len(n) else n
        self.prior = float((worth * toxic).sum() / worth.sum()) if len(n) else 0.0
        blank = np.bincount(owner, minlength=len(n)) == 0
        self.blank = float(((worth * toxic)[blank].sum() + self.prior) / (worth[blank].sum() + 1.0))
        self.ids, self.worth, self.toxic = [i for i, _, _ in examples], worth, toxic
        self.index = BlockMaxIndex(len(n), owner, term, self.weights(len(n), owner, term, count), len(terms))

    @property
    def term_of(self) -> dict[str, int]:
        """Numbers of the terms that tell the classes apart."""
        return {t: i for i, t in enumerate(self.vocabulary.terms.to_pylist()) if self.telling[i]}

    def weights(self, n: int, owner: np.ndarray, term: np.ndarray, count: np.ndarray) -> np.ndarray:
        """Weights of (text, term, count), each text's of norm one. A word that no
        example holds weighs like one of no document."""
        known = np.append(self.weight, self.base)
        w = (1 + np.log(count)) * known[np.minimum(term, len(self.weight))]
        return w / np.sqrt(np.bincount(owner, w * w, n))[owner]

    def scores(self, texts: pa.Array) -> Iterator[tuple[float, list[tuple[str, float, float]], list[str]]]:
        """Score, nearest examples and telling terms of each text."""
        for rows in portions(texts, 1_000_000):
            part = texts[rows]
            owner, term, count = self.vocabulary.counts(part)
            weight = self.weights(len(part), owner, term, count)
            ends = np.searchsorted(owner, np.arange(len(part) + 1))
            for at in range(0, len(part), 64):
                n = min(64, len(part) - at)
                s = slice(ends[at], ends[at + n])
                found = self.index.search(n, owner[s] - at, term[s], weight[s], self.k)
                for i, (near, cosine) in enumerate(found, at):
                    own = term[ends[i] : ends[i + 1]]
                    yield self._vote(near, cosine, own) if len(own) else (self.blank, [], [])

    def _vote(self, near: np.ndarray, cosine: np.ndarray, own: np.ndarray):
        cosine = np.minimum(cosine.astype(float), 1.0)
        vote = np.sqrt(self.worth[near]) / (1.03 - cosine)
        score = (float((vote * self.toxic[near]).sum()) + self.prior) / (float(vote.sum()) + 1.0)
        evidence = [(self.ids[i], float(self.toxic[i]), float(c)) for i, c in zip(near[:3].tolist(), cosine[:3], strict=False)]
        own = own[own < len(self.weight)]
        names = self.vocabulary.terms.take(pa.array(own[self.telling[own]])).to_pylist()
        return min(1.0, max(0.0, score)), evidence, names


def _term_rows(examples: DataFrame) -> DataFrame:
    """(term, d1, d0): labelled documents of each class with the term, of all words and
    word beginnings of the examples; an example counts as often as its text is there."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in portions(batch.column(2), 500_000):
                owner, code, words = _words(batch.column(2)[part])
                owner, code, _ = _sums(owner, code, np.ones(len(code)))
                text = words.to_pylist()
                terms: dict[str, list[int]] = {}
                for i, word in enumerate(text):
                    for t in [word, *("^" + word[:n] for n in PREFIXES if len(word) > n)]:
                        terms.setdefault(t, []).append(i)
                toxic, n = (batch.column(i)[part].to_numpy() for i in (0, 1))
                out = []
                holders = np.split(owner[np.argsort(code, kind="stable")], np.cumsum(np.bincount(code, minlength=len(text)))[:-1]) if len(text) else []
                for t, at in terms.items():
                    docs = np.unique(np.concatenate([holders[i] for i in at])) if len(at) > 1 else holders[at[0]]
                    out.append((t, int((n[docs] * toxic[docs]).sum()), int((n[docs] * (1 - toxic[docs])).sum())))
                columns = list(zip(*out, strict=True)) or [(), (), ()]
                yield pa.record_batch([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int64())], ["term", "d1", "d0"])

    found = examples.select("toxic", "n", "text").mapInArrow(rows, "term string, d1 long, d0 long")
    return found.groupBy("term").agg(F.sum("d1").alias("d1"), F.sum("d0").alias("d0"))


def _frequencies(docs: DataFrame, text: F.Column, vocabulary: Broadcast) -> tuple[np.ndarray, int]:
    """In how many of all documents each term is, and the number of documents."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary.value
        for batch in batches:
            total = np.zeros(len(known.terms), np.int64)
            for part in portions(batch.column(0)):
                _, term, _ = known.counts(batch.column(0)[part])
                total += np.bincount(term[term < len(total)], minlength=len(total))
            at = np.flatnonzero(total)
            yield pa.record_batch([pa.array(np.append(at, -1)), pa.array(np.append(total[at], len(batch)))], ["term", "n"])

    found = docs.select(text.alias("text")).mapInArrow(rows, "term long, n long")
    counted = found.groupBy("term").agg(F.sum("n").alias("n")).toArrow()  # one row a term of the examples
    term, n = counted.column(0).to_numpy(), counted.column(1).to_numpy()
    out = np.zeros(len(vocabulary.value.terms), np.int64)
    out[term[term >= 0]] = n[term >= 0]
    return out, int(n[term < 0].sum())


def labelled_rows(
    labels: DataFrame, id_col: str = "doc_id", label_col: str = "toxic", held_out: F.Column | None = None
) -> DataFrame:
    """(id, toxic) to learn from: the largest label of each id, nulls left out."""
    rows = labels.select(column(id_col).alias("id"), column(label_col).cast("int").alias("toxic"))
    rows = rows.filter("id is not null and toxic in (0, 1)")
    if held_out is not None:
        rows = rows.filter(~held_out)
    return rows.groupBy("id").agg(F.max("toxic").alias("toxic"))


def fit(
    docs: DataFrame,
    labelled: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    max_examples: int = 4_000,
    max_words: int = 4_000_000,
    neighbours: int = 16,
    seed: int = 5,
) -> Voter:
    """Learn from ``labelled(id, toxic)``.

    Up to half of ``max_examples`` of each class, in hash order of their ids, and of
    these as many as have ``max_words`` words together, are the examples; this is the
    documented bound of the sample. Equal texts of a class are one example with the
    votes of all. Every word of the examples is a term, and document frequencies are
    counted over all documents. Words that tell the classes apart weigh more, by their
    likelihood ratio in labelled documents, and such beginnings of words are terms too.
    """
    labelled = saved(labelled, "labels")
    counts = {r.toxic: r.n for r in labelled.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    order = F.xxhash64(F.lit(seed), "id")
    picked = None
    for y in (0, 1):
        part = labelled.filter(F.col("toxic") == y).orderBy(order, "id").limit(max_examples // 2)
        picked = part if picked is None else picked.unionByName(part)
    picked = saved(picked, "picked")
    texts = docs.select(column(id_col).alias("id"), column(text_col).alias("text"))
    # at most max_examples ids, so the broadcast has a fixed size
    drawn = (
        texts.join(F.broadcast(picked), "id")
        .groupBy("id")
        .agg(F.max("toxic").alias("toxic"), F.max("text").alias("text"), F.min(order).alias("place"))
        .groupBy("toxic", "text")
        .agg(F.min_by(F.struct("id", "place"), F.struct("place", "id")).alias("x"), F.count(F.lit(1)).alias("n"))
        .select("x.*", "toxic", "text", "n", F.length("text").alias("size"))
    )
    drawn = saved(drawn, "drawn")
    # of at most max_examples rows; a word has a letter and a space at least
    before = F.sum(F.coalesce(F.col("size"), F.lit(0)) / 2).over(Window.orderBy("place", "id"))
    examples = saved(drawn.withColumn("words", before).filter(F.col("words") <= max_words).drop("words", "size"), "examples")
    sizes = {r.toxic: r.n for r in examples.groupBy("toxic").agg(F.sum("n").alias("n")).collect()}
    empty = (np.zeros(0, np.int64),) * 3
    if not sizes:
        return Voter([], [], [], 0, [], empty, neighbours, {})
    n1, n0 = sizes.get(1, 0), sizes.get(0, 0)
    # few rows, but each with thousands of terms: dealt out, so that no task has them all
    seen = _term_rows(examples.repartition(docs.sparkSession.sparkContext.defaultParallelism))

    def part(observed, of, other):  # one term of the likelihood ratio
        expected = of * (observed + other) / F.lit(float(max(1, n1 + n0)))
        return F.when(observed > 0, observed * F.log(observed / expected)).otherwise(0.0)

    one, nil = F.col("d1").cast("double"), F.col("d0").cast("double")
    gain = 2 * (part(one, n1, nil) + part(nil, n0, one) + part(n1 - one, n1, n0 - nil) + part(n0 - nil, n0, n1 - one))
    word = ~F.col("term").startswith("^")  # no word has that character
    terms = seen.withColumn("gain", gain).filter(word | (F.col("gain") > NOISE)).select("term", "gain").orderBy("term").toArrow()
    names = terms.column(0).to_pylist()
    context = docs.sparkSession.sparkContext
    vocabulary = context.broadcast(Vocabulary(names))
    frequency, documents = _frequencies(docs, column(text_col), vocabulary)

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owner, term, count = vocabulary.value.counts(batch.column(1))
            ids = batch.column(0).take(pa.array(owner))
            yield pa.record_batch([ids, pa.array(term.astype(np.int32)), pa.array(count.astype(np.int32))], ["place", "term", "count"])

    numbered = examples.select("id", "toxic", "n", "text", F.row_number().over(Window.orderBy("place", "id")).alias("number"))
    numbered = saved(numbered.withColumn("number", F.col("number") - 1), "numbered")
    rows = numbered.select("number", "text").mapInArrow(vectors, "place int, term int, count int").toArrow()
    owner, term, count = (rows.column(i).to_numpy().astype(np.int64) for i in range(3))
    at = np.lexsort((term, owner))
    found = numbered.select(F.col("id").cast("string").alias("id"), "toxic", "n").orderBy("number").collect()
    vocabulary.unpersist()
    return Voter(
        names, terms.column(1).to_numpy(), frequency, documents,
        [tuple(r) for r in found], (owner[at], term[at], count[at]), neighbours, counts,
    )


def _scores(voter: Broadcast):
    evidence = pa.struct([("example", pa.string()), ("toxic", pa.float64()), ("cosine", pa.float64())])
    kind = pa.struct([("score", pa.float64()), ("evidence", pa.list_(evidence)), ("terms", pa.list_(pa.string()))])

    @F.arrow_udf(RESULT)
    def score(texts: pa.Array) -> pa.Array:
        out = []
        for value, near, terms in voter.value.scores(texts):
            near = [{"example": e, "toxic": y, "cosine": c} for e, y, c in near]
            out.append({"score": value, "evidence": near, "terms": terms})
        return pa.array(out, kind)

    return score


def score(docs: DataFrame, voter: Voter, text_col: str = "text") -> DataFrame:
    """Add ``score`` (0 to 1), ``evidence`` (the nearest examples: id, label, cosine)
    and ``terms`` (those of the text that tell the classes apart).

    The ``neighbours`` nearest examples vote, weighted by distance and by the labelled
    rows they stand for; one vote for the overall rate draws thin evidence towards it.
    A text without words, empty and null texts included, gets the rate among examples
    without words. Only the text decides; whole texts are read. Without labels every
    score is 0. Repeated rows score alike; an empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(voter)
    rows = packed(docs).withColumn("r", _scores(shared)(F.col("row").getField(text_col)))
    return unpacked(rows, score=F.col("r.score"), evidence=F.col("r.evidence"), terms=F.col("r.terms"))


def reject_toxic(
    docs: DataFrame, voter: Voter, text_col: str = "text", threshold: float = 0.3
) -> DataFrame:
    """Documents that score below ``threshold``, with their own columns.

    Null and empty texts score as texts without words do; repeated rows go or stay
    together; an empty table gives an empty result."""
    shared = docs.sparkSession.sparkContext.broadcast(voter)
    rows = packed(docs).withColumn("r", _scores(shared)(F.col("row").getField(text_col)))
    kept = unpacked(rows.filter(F.col("r.score") < threshold))
    return kept.select(*[column(c) for c in docs.columns])
