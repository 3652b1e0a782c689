"""Document quality from overlapping heuristics, without hand labels.

Heuristic labellers vote good, bad or nothing. Expectation-maximisation finds how
far each can be trusted from where they agree; its posteriors are the labels that
train a hashed linear scorer, which also judges what the labellers leave open.
"""

from __future__ import annotations

import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.frames import column, packed, saved, unpacked

GOOD, BAD, NONE = 1, 0, 2
#: Size of the scorer's hash space.
DIMENSIONS = 1 << 15
_SYMBOLS = b"#$%&*+/<=>@[\\]^_`{|}~"
_PUNCTUATION = bytes(b for b in range(33, 127) if not chr(b).isalnum())
_SHAPE = bytes(
    97 if 65 <= b <= 90 or 97 <= b <= 122 or b >= 128 else 57 if 48 <= b <= 57 else b for b in range(256)
)


@dataclass
class Signals:
    words: int
    symbols: float  # share of the characters
    digits: float
    top: float  # share of the most frequent longer word
    repeats: float  # words equal to the word before
    lines: float  # lines that occurred before
    length: float  # mean length of a word in bytes
    ends: float  # words that end a sentence
    short: float  # words of up to three bytes
    bare: float  # words without a letter or digit
    same: float  # words that occurred before


def signals(text: bytes | None) -> tuple[Signals, list[bytes], Counter]:
    """Numbers about a whole text, its words and their counts."""
    raw = (text or b"").lower()
    words = raw.split()
    n = len(words)
    counts = Counter(words)
    size = max(1, sum(map(len, words)))
    lines = [x for x in (y.strip() for y in raw.split(b"\n")) if x]
    top = max((c for w, c in counts.items() if len(w) > 3), default=0)
    return (
        Signals(
            n,
            (len(raw) - len(raw.translate(None, _SYMBOLS))) / size,
            (len(raw) - len(raw.translate(None, b"0123456789"))) / size,
            top / max(1, n),
            sum(a == b for a, b in zip(words, words[1:], strict=False)) / max(1, n),
            1 - len(set(lines)) / len(lines) if lines else 0.0,
            size / max(1, n),
            sum(w[-1] in b".!?" for w in words) / max(1, n),
            sum(c for w, c in counts.items() if len(w) <= 3) / max(1, n),
            sum(c for w, c in counts.items() if not w.translate(None, _PUNCTUATION)) / max(1, n),
            1 - len(counts) / max(1, n),
        ),
        words,
        counts,
    )


def _band(value: float, good: float, bad: float) -> int:
    """Good up to one bound, bad from the other on, no vote between."""
    return GOOD if value <= good else BAD if value >= bad else NONE


#: Each looks at something else; together they overlap on most documents.
LABELLERS = {
    "length": lambda s: BAD if s.words < 4 else GOOD if s.words >= 20 else NONE,
    "symbols": lambda s: _band(s.symbols, 0.02, 0.08),
    "digits": lambda s: _band(s.digits, 0.05, 0.2),
    "top_word": lambda s: NONE if s.words < 20 else _band(s.top, 0.06, 0.2),
    "repeats": lambda s: NONE if s.words < 5 else _band(s.repeats, 0.03, 0.2),
    "lines": lambda s: _band(s.lines, 0.05, 0.4) if s.words >= 20 else NONE,
    "word_length": lambda s: NONE if s.words < 5 else GOOD if 3 <= s.length <= 10 else BAD if s.length < 2 or s.length > 20 else NONE,
    "sentences": lambda s: NONE if s.words < 20 else GOOD if 0.02 <= s.ends <= 0.35 else BAD if s.ends < 0.003 or s.ends > 0.6 else NONE,
    "bare_signs": lambda s: _band(s.bare, 0.03, 0.15),
    "same_words": lambda s: NONE if s.words < 20 else _band(s.same, 0.8, 0.93),
    "short_words": lambda s: NONE if s.words < 20 else GOOD if 0.08 <= s.short <= 0.7 else BAD if s.short < 0.02 else NONE,
}


def pattern(s: Signals) -> int:
    """All votes as one number, three values each."""
    out = 0
    for vote in LABELLERS.values():
        out = out * 3 + vote(s)
    return out


def votes_of(patterns: np.ndarray) -> np.ndarray:
    n = len(LABELLERS)
    return np.stack([patterns // 3 ** (n - 1 - j) % 3 for j in range(n)], axis=1)


class LabelModel:
    """Class prior and, for each class and labeller, how often it votes what."""

    def __init__(self, patterns: np.ndarray, weights: np.ndarray, rounds: int = 60):
        votes, n = votes_of(patterns), len(LABELLERS)
        cells = np.eye(3)[votes][:, :, :2]  # pattern, labeller, vote; none says nothing
        good, bad = (votes == GOOD).sum(1), (votes == BAD).sum(1)
        # any bad vote weighs more than a good one: most texts pass most tests
        posterior = (good + 1) / (good + 4 * bad + 2)
        for _ in range(rounds):
            share = np.stack([weights * (1 - posterior), weights * posterior])
            self.prior = (share.sum(1) + [1, 4]) / (share.sum() + 5)
            # pseudo-counts lean to labellers that are right more often than not
            lean = np.ones((2, n, 2))
            lean[0, :, BAD], lean[1, :, GOOD] = 3.0, 6.0
            table = np.einsum("cp,pjv->cjv", share, cells) + lean
            self.table = table / table.sum(2, keepdims=True)
            posterior = self._posterior(cells)
        self.posteriors = dict(zip(patterns.tolist(), posterior.tolist(), strict=True))

    def _posterior(self, cells: np.ndarray) -> np.ndarray:
        logs = np.log(self.prior)[:, None] + np.einsum("pjv,cjv->cp", cells, np.log(self.table))
        return 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -50, 50)))

    def accuracies(self) -> dict[str, float]:
        """How often each labeller is right where it votes."""
        out = {}
        for j, name in enumerate(LABELLERS):
            right = self.prior[0] * self.table[0, j, BAD] + self.prior[1] * self.table[1, j, GOOD]
            some = (self.prior[:, None] * self.table[:, j]).sum()
            out[name] = float(right / max(some, 1e-12))
        return out


def features(s: Signals, counts: Counter) -> tuple[np.ndarray, np.ndarray]:
    """Hashed indices and weights: binned signals, word shapes and words, each
    group of unit length."""
    bins = [b"b%d:%d" % (i, int(min(15, max(0, v * 20)))) for i, v in enumerate((s.symbols, s.digits, s.top, s.repeats, s.lines, s.ends, s.short, s.bare, s.same))]
    bins += [b"bn:%d" % s.words.bit_length(), b"bl:%d" % int(min(25, s.length))]
    shapes = {b"s" + (t := w.translate(_SHAPE))[:3] + t[-3:] for w in counts}
    index, weight = [], []
    for keys, share in ((bins, 1.0), (shapes, 1.0), (counts, 0.5)):
        index += [zlib.crc32(k) % DIMENSIONS for k in keys]
        weight += [share / max(1, len(keys)) ** 0.5] * len(keys)
    return np.array(index, np.int32), np.array(weight, np.float32)


def train(rows: list[tuple[np.ndarray, np.ndarray, float]], epochs: int = 4, rate: float = 0.5) -> np.ndarray:
    """Logistic weights (the last is the offset) for soft labels, by Adagrad."""
    w, g2 = np.zeros(DIMENSIONS + 1), np.full(DIMENSIONS + 1, 1e-2)
    for epoch in range(epochs):
        order = np.random.default_rng(epoch).permutation(len(rows))
        for at in range(0, len(order), 32):
            part = [rows[i] for i in order[at : at + 32]]
            index = np.concatenate([np.append(i, DIMENSIONS) for i, _, _ in part])
            value = np.concatenate([np.append(v, 1.0) for _, v, _ in part])
            doc = np.repeat(np.arange(len(part)), [len(i) + 1 for i, _, _ in part])
            z = np.bincount(doc, w[index] * value, len(part))
            error = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - np.array([y for _, _, y in part])
            own, back = np.unique(index, return_inverse=True)
            grad = np.bincount(back, error[doc] * value, len(own)) / len(part)
            g2[own] += grad**2
            w[own] -= rate * grad / np.sqrt(g2[own])
    return w


def score_docs(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    max_training: int = 20_000,
    threshold: float = 0.5,
    seed: int = 23,
) -> DataFrame:
    """Input columns with ``score`` (0 to 1, higher is better), ``posterior`` (of
    the label model) and ``keep`` (score of at least ``threshold``).

    The label model sees the votes on every document: their patterns are counted
    in Spark, and there are no more of them than three to the number of
    labellers. The scorer learns from about ``max_training`` documents, picked
    evenly by text hash; that is its documented bound.

    * Null and empty texts have no words: the length labeller calls them bad.
    * Whole texts are read, of any length. Repeated rows count as often as they
      occur and score alike. An empty table gives an empty result; input columns
      of the added names are replaced.
    """
    spark = docs.sparkSession
    texts = docs.select(column(text_col).alias("text"))

    @F.arrow_udf("bigint")
    def patterns(batch: pa.Array) -> pa.Array:
        return pa.array([pattern(signals(t)[0]) for t in batch.cast(pa.binary()).to_pylist()], pa.int64())

    counted = texts.groupBy(patterns(F.col("text")).alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()
    total = sum(r.n for r in counted)
    if not total:
        empty = packed(docs)
        return unpacked(empty, score=F.lit(0.0), posterior=F.lit(0.0), keep=F.lit(False))
    counted.sort(key=lambda r: r.p)
    model = LabelModel(np.array([r.p for r in counted]), np.array([float(r.n) for r in counted]))
    share = min(1.0, max_training / total)

    @F.arrow_udf("struct<p: bigint, i: array<int>, v: array<float>>")
    def sampled(batch: pa.Array) -> pa.Array:
        out = []
        for text in batch.cast(pa.binary()).to_pylist():
            s, _, counts = signals(text)
            index, value = features(s, counts)
            out.append({"p": pattern(s), "i": index, "v": value})
        return pa.array(out, pa.struct([("p", pa.int64()), ("i", pa.list_(pa.int32())), ("v", pa.list_(pa.float32()))]))

    place = F.pmod(F.xxhash64(F.lit(seed), "text"), F.lit(1 << 30))
    # equal texts share a hash, so copies come together: take each text once
    picked = texts.filter(place < int(share * (1 << 30))).groupBy(place.alias("k")).agg(F.min("text").alias("text"))
    rows = saved(picked.select("k", sampled(F.col("text")).alias("x")), "quality").orderBy("k").limit(2 * max_training)
    learned = [
        (np.array(r.x.i, np.int32), np.array(r.x.v, np.float32), model.posteriors[r.x.p]) for r in rows.toLocalIterator()
    ]
    shared = spark.sparkContext.broadcast((train(learned), model.posteriors))

    @F.arrow_udf("struct<score: double, posterior: double>")
    def scored(batch: pa.Array) -> pa.Array:
        w, posteriors = shared.value
        out = []
        for text in batch.cast(pa.binary()).to_pylist():
            s, _, counts = signals(text)
            index, value = features(s, counts)
            z = float(w[index] @ value) + float(w[DIMENSIONS])
            out.append({"score": 1 / (1 + np.exp(-np.clip(z, -30, 30))), "posterior": posteriors[pattern(s)]})
        return pa.array(out, pa.struct([("score", pa.float64()), ("posterior", pa.float64())]))

    rows = packed(docs).withColumn("r", scored(F.col("row").getField(text_col)))
    return unpacked(
        rows, score=F.col("r.score"), posterior=F.col("r.posterior"), keep=F.col("r.score") >= threshold
    )
