"""Find and remove passages of benchmark items in documents."""

from __future__ import annotations

import math
import re
from collections.abc import Iterable

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.frames import column, packed, saved, unpacked

# Bytes that end a word become a space, A-Z become a-z; bytes from 0x80 stay, so
# characters outside ASCII are parts of words.
_NORMAL = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32
    for b in range(256)
)
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
FOUND = "struct<n_words: bigint, spans: array<struct<first: bigint, last: bigint>>, items: array<string>>"
_FOUND = pa.struct(
    [
        ("n_words", pa.int64()),
        ("spans", pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))),
        ("items", pa.list_(pa.string())),
    ]
)


def normal_words(text: bytes | str | None) -> list[bytes]:
    """Lower-cased words: runs of letters, digits and non-ASCII characters."""
    if not text:
        return []
    raw = text.encode() if isinstance(text, str) else text
    return raw.translate(_NORMAL).split()


class ItemAutomaton:
    """Generalised suffix automaton over the words of several items.

    Reading a word moves to the longest suffix of the text so far that occurs in
    some item. Windows (``window`` consecutive item words, or a whole shorter
    item) are attached to the state that stands for them.
    """

    def __init__(self, items: Iterable[tuple[str | None, list[bytes]]], window: int):
        self.window = window
        self.vocabulary: dict[bytes, int] = {}
        self.length, self.link = [0], [-1]
        self.step: list[dict[int, int]] = [{}]
        kept = [(name, words) for name, words in items if words]
        coded = []
        for name, words in kept:
            codes = [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words]
            coded.append((name, codes))
            last = 0
            for c in codes:
                last = self._extend(last, c)
        # (window length, item names) by state
        self.windows: list[dict[int, set]] = [{} for _ in self.length]
        for name, codes in coded:
            need = min(window, len(codes))
            state = matched = 0
            for c in codes:
                state, matched = self.step[state][c], matched + 1
                while self.length[self.link[state]] >= need:
                    state = self.link[state]
                    matched = self.length[state]
                if matched >= need:
                    names = self.windows[state].setdefault(need, set())
                    if name is not None:
                        names.add(name)
        # the nearest state on the way to the root that has a window, or -1
        self.report = [-1] * len(self.length)
        for s in sorted(range(len(self.length)), key=self.length.__getitem__):
            parent = self.link[s]
            self.report[s] = s if self.windows[s] else self.report[parent] if parent >= 0 else -1

    def _new(self, length: int, step: dict[int, int], link: int) -> int:
        self.length.append(length)
        self.step.append(step)
        self.link.append(link)
        return len(self.length) - 1

    def _extend(self, last: int, c: int) -> int:
        known = self.step[last].get(c)
        if known is not None:
            if self.length[known] == self.length[last] + 1:
                return known
            return self._split(last, c, known)
        state = self._new(self.length[last] + 1, {}, 0)
        p = last
        while p >= 0 and c not in self.step[p]:
            self.step[p][c] = state
            p = self.link[p]
        if p >= 0:
            q = self.step[p][c]
            self.link[state] = q if self.length[q] == self.length[p] + 1 else self._split(p, c, q)
        return state

    def _split(self, p: int, c: int, q: int) -> int:
        copy = self._new(self.length[p] + 1, dict(self.step[q]), self.link[q])
        self.link[q] = copy
        while p >= 0 and self.step[p].get(c) == q:
            self.step[p][c] = copy
            p = self.link[p]
        return copy

    def scan(self, words: list[bytes]) -> tuple[list[list[int]], set[str]]:
        """Hit word ranges (first, last), merged and in order, and item names."""
        spans: list[list[int]] = []
        names: set[str] = set()
        known, step, link, length, report = (
            self.vocabulary.get, self.step, self.link, self.length, self.report,
        )
        state = matched = 0
        for i, c in enumerate(map(known, words)):
            if c is None:
                state = matched = 0
                continue
            target = step[state].get(c)
            if target is None:
                while target is None and state:
                    state = link[state]
                    target = step[state].get(c)
                if target is None:
                    matched = 0
                    continue
                matched = length[state]
            state, matched = target, matched + 1
            r = report[state]
            while r >= 0:
                for size, owners in self.windows[r].items():
                    if size <= matched:
                        names |= owners
                        first = i - size + 1
                        while spans and spans[-1][1] >= first - 1:
                            first = min(first, spans.pop()[0])
                        spans.append([first, i])
                r = report[link[r]] if r else -1
        return spans, names


def _blocks(benchmark: DataFrame, id_col: str, text_col: str, max_words: int):
    """Items in blocks of about ``max_words`` words, one block at the driver at a
    time: the automaton that is broadcast has a fixed size however many items
    there are."""
    items = benchmark.select(
        column(id_col).cast("string").alias("name"), column(text_col).alias("text")
    ).filter("text is not null")
    size = F.coalesce(F.sum(F.regexp_count("text", F.lit(_WORD.pattern))), F.lit(0))
    total = items.agg(size.alias("n")).first().n
    n = max(1, math.ceil(total / max_words))
    block = F.pmod(F.xxhash64("text"), F.lit(n))
    for k in range(n):
        part = items if n == 1 else items.filter(block == k)
        yield k + 1 == n, [(r.name, normal_words(r.text)) for r in part.toLocalIterator()]


def _scanner(shared: Broadcast):
    """A column function that adds the hits of one block to those found before."""

    @F.arrow_udf(FOUND)
    def scan(texts: pa.Array, before: pa.Array) -> pa.Array:
        automaton, out = shared.value, []
        for text, old in zip(texts.cast(pa.binary()).to_pylist(), before.to_pylist(), strict=True):
            words = normal_words(text)
            spans, names = automaton.scan(words)
            if old:
                spans = merged(spans + [[s["first"], s["last"]] for s in old["spans"]])
                names = names.union(old["items"])
            ranges = [{"first": a, "last": b} for a, b in spans]
            out.append({"n_words": len(words), "spans": ranges, "items": sorted(names)})
        return pa.array(out, _FOUND)

    return scan


def find_items(
    docs: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    window: int = 10,
    block_words: int = 200_000,
) -> DataFrame:
    """Words of each document that lie in a benchmark window.

    Adds ``n_words``, ``spans`` (hit word ranges, merged, 0-based, both ends
    included) and ``items`` (ids as strings, sorted) to the input columns.

    * Null and empty texts have no words; items without words have no window.
    * Items with one id count once, items with one text each count; an item
      without an id hits but is not listed.
    * Texts have no length limit. Empty tables give no hits or no rows.

    One pass over the documents per ``block_words`` benchmark words, without a
    shuffle; with several blocks the passes are materialised one after another.
    """
    spark = docs.sparkSession
    state = packed(docs, found=F.lit(None).cast(FOUND))
    for last, items in _blocks(benchmark, item_id_col, item_text_col, block_words):
        shared = spark.sparkContext.broadcast(ItemAutomaton(items, window))
        scan = _scanner(shared)
        state = state.withColumn("found", scan(F.col("row").getField(text_col), "found"))
        if not last:
            state = saved(state, "items")
            shared.unpersist()
    return unpacked(
        state,
        n_words=F.col("found.n_words"),
        spans=F.col("found.spans"),
        items=F.col("found.items"),
    )


def merged(spans: list[list[int]]) -> list[list[int]]:
    """Ranges joined where they touch or overlap, in order."""
    out: list[list[int]] = []
    for first, last in sorted(spans):
        if out and first <= out[-1][1] + 1:
            out[-1][1] = max(out[-1][1], last)
        else:
            out.append([first, last])
    return out


def hit_words() -> F.Column:
    """Number of words in ``spans``."""
    return F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["last"] - s["first"] + 1)


@F.arrow_udf(T.StringType())
def _without(texts: pa.Array, spans: pa.Array) -> pa.Array:
    out = []
    for text, ranges in zip(texts.to_pylist(), spans.to_pylist(), strict=True):
        if ranges:
            at = [m.span() for m in _WORD.finditer(text)]
            pieces, begin = [], 0
            for r in ranges:
                pieces.append(text[begin : at[r["first"]][0]])
                begin = at[r["last"]][1]
            text = "".join([*pieces, text[begin:]])
        out.append(text)
    return pa.array(out, pa.string())


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    window: int = 10,
    min_span: int = 1,
    max_coverage: float = 0.5,
    block_words: int = 200_000,
) -> DataFrame:
    """Documents without benchmark passages, with their own columns.

    Hit ranges of at least ``min_span`` words are cut out of the text, from the
    first character of their first word to the last of their last. A document
    with more than ``max_coverage`` of its words hit goes as a whole. All others
    stay, untouched where nothing is hit; null texts stay null.
    """
    clash = {c.lower() for c in docs.columns} & {"n_words", "spans", "items"}
    source = docs if not clash else docs.select(F.struct(*map(column, docs.columns)).alias("kept"), column(text_col).alias("cut"))
    name = "cut" if clash else text_col
    # a filter on the hits would scan a second time, and each Python step of a task has
    # a worker of its own that stays: the hits are written before they are used
    found = saved(find_items(source, benchmark, name, item_id_col, item_text_col, window, block_words), "hits")
    found = found.filter(hit_words() <= max_coverage * F.col("n_words"))
    long_enough = F.filter("spans", lambda s: s["last"] - s["first"] + 1 >= min_span)
    text = F.when(F.size(long_enough) > 0, _without(column(name), long_enough)).otherwise(column(name))
    if not clash:
        return found.select(*[(text if c == name else column(c)).alias(c) for c in docs.columns])
    return found.select(
        *[(text if c == text_col else F.col("kept").getField(c)).alias(c) for c in docs.columns]
    )
