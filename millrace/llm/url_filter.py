"""URL rules by a cascade of Bloom filters."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.frames import ascii_lower, column, packed, saved, unpacked

#: Sets of up to this many keys get so tight a filter that hardly a level follows.
_SMALL, _TIGHT = 4096, 1e-3
#: Shapes of keys looked up in one pass, which bounds the size of its expression.
_SHAPES = 8
#: A listed key of a URL, in the order of precedence; code 2 blocks, 1 allows.
_BEST = "struct<size:int,host_size:int,code:int,key:string>"


@dataclass(frozen=True)
class Level:
    """One blocked Bloom filter: a key's bits all lie in one 64-bit word. ``words``
    is a frame of one row, the words as an array."""

    words: DataFrame
    size: int
    hashes: int
    keys: int

    def holds(self, key: Column, number: int) -> Column:
        """Whether all bits of a key are set. The words come in as a scalar
        subquery: read once a job, and of bounded size."""
        word, mask = _place(key, number, self.size, self.hashes)
        return F.get(self.words.scalar(), word.cast("int")).bitwiseAND(mask) == mask


def _place(key: Column, number: int, size: int, hashes: int) -> tuple[Column, Column]:
    """A key's word and its bits in it. The number of the level goes into the
    hash, so that levels err on different keys."""
    bits = F.xxhash64(F.lit(number), key, F.lit("bits"))
    one = lambda i: F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftright(bits, 6 * i).bitwiseAND(F.lit(63)).cast("int"))
    mask = reduce(Column.bitwiseOR, [one(i) for i in range(hashes)])
    return F.pmod(F.xxhash64(F.lit(number), key), F.lit(size)), mask


def _size(keys: int, rate: float) -> tuple[int, int]:
    """(words, bits a key) of a filter for so many keys. One word holds up to eight
    bits a key, so rates below 1/256 are not reached: deeper levels mend the rest."""
    hashes = min(8, max(1, round(-math.log2(rate))))
    return math.ceil(keys * hashes / math.log(2) / 64), hashes


def _encode(keys: DataFrame, number: int, size: int, hashes: int) -> DataFrame:
    """The filter's words in one row. Bits are merged before the shuffle; the last
    aggregate sees one row a word of the filter, whatever the number of keys."""
    word, mask = _place(F.col("key"), number, size, hashes)
    some = keys.select(word.alias("word"), mask.alias("bits"))
    every = keys.sparkSession.range(size).select(F.col("id").alias("word"), F.lit(0).cast("long").alias("bits"))
    words = some.unionByName(every).groupBy("word").agg(F.bit_or("bits").alias("bits"))
    in_order = F.array_sort(F.collect_list(F.struct("word", "bits")))
    return saved(words.agg(F.transform(in_order, lambda w: w["bits"]).alias("words")), "url-level")


@dataclass(frozen=True)
class Cascade:
    """Exact membership of every key of the universe it was built over."""

    levels: tuple[Level, ...]

    def lists(self, key: Column) -> Column:
        """Whether a key is listed: odd levels hold listed keys, even levels the
        others that the level before takes for listed, and so on; the first level
        without the key decides."""
        answer = F.lit(len(self.levels) % 2 == 1)
        for number in range(len(self.levels), 0, -1):
            level = self.levels[number - 1]
            answer = F.when(level.holds(key, number), answer).otherwise(F.lit(number % 2 == 0))
        return answer


def first_size(listed: int, universe: int) -> tuple[int, int]:
    """Size of the first level. The larger the universe beside the list, the rarer
    must a false positive be; deeper levels err on every second key."""
    return _size(listed, min(0.5, listed / max(1, universe) / math.sqrt(2)))


def build_cascade(listed: DataFrame, universe: DataFrame) -> Cascade:
    """Cascade over frames with one column ``key``.

    ``listed`` holds distinct keys, ``universe`` all keys that will ever be asked
    for, which may repeat. The universe is read twice (its size is estimated, then
    every key is probed); from the second level on only false positives are left.
    """
    listed = saved(listed, "url-listed")
    inside, outside, levels = listed, universe, []
    n = listed.count()
    size = first_size(n, universe.agg(F.approx_count_distinct("key")).first()[0]) if n else None
    while n:
        number = len(levels) + 1
        levels.append(Level(_encode(inside, number, *size), *size, n))
        wrong = outside.filter(levels[-1].holds(F.col("key"), number))
        if number == 1:  # of the universe; the list is taken out here only
            wrong = wrong.distinct().join(listed, "key", "left_anti")
        inside, outside = saved(wrong, "url-wrong"), inside
        n = inside.count()
        size = _size(n, _TIGHT if n <= _SMALL else 0.5)
    return Cascade(tuple(levels))


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path. Null, or no ``://``: both empty."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    part = lambda k: F.coalesce(F.regexp_extract(url, pattern, k), F.lit(""))
    return ascii_lower(part(1)), part(2)


def _rule_keys(rules: DataFrame) -> DataFrame:
    """Distinct (key, verdict, labels, length) of rules: a key is host and path,
    which part at the first slash."""
    host = ascii_lower(F.substring_index("rule", "/", 1))
    path = F.substr("rule", F.length(F.substring_index("rule", "/", 1)) + 1)
    labels = F.length(host) - F.length(F.replace(host, F.lit("."), F.lit(""))) + 1
    kept = rules.filter(F.col("rule").isNotNull() & (host != "") & F.col("verdict").isin("allow", "block"))
    return kept.select(
        F.concat(host, path).alias("key"), "verdict", labels.alias("labels"), F.length(path).alias("length")
    ).distinct()


def judge_urls(
    pages: DataFrame,
    rules: DataFrame | Sequence[tuple[str, str]],
    url_col: str = "url",
    default: str = "allow",
    max_words: int = 1 << 21,
) -> DataFrame:
    """The verdict of the longest rule that fits each URL.

    ``rules`` are (verdict, rule) pairs or a frame with these two columns; a rule is
    a host and a path in one (``example.com/en/``). It fits its host and all
    subdomains, where the URL's path starts with the rule's. Of fitting rules of one
    length the one with the longer host wins; a rule that both allows and blocks
    blocks. Returns the input columns and ``host``, ``path``, ``rule`` (null where
    none fits) and ``verdict`` (``default`` where none fits: such a URL is on no
    list); input columns of these names are replaced.

    The keys of a URL are its host's last labels with its path's first characters,
    in the shapes (number of labels, length of path) that the rules have; all keys
    of all pages are the universe of two cascades, one for blocking and one for
    allowing rules. Looking a key up joins nothing and shuffles nothing: filters
    are scalar subqueries of at most ``max_words`` longs. A longer list is cut by the
    keys' hash into slices, many shapes into groups, that are passed over one after
    the other.

    * A null URL, or one without ``://``, has an empty host and path: no rule fits.
    * Rows are judged one by one, so repeated rows are as good as others; an empty
      table gives an empty result, no rules give ``default`` everywhere.
    * Rules that are null, have no host or another verdict are left out; repeated
      rules count once. URLs have no length limit.
    """
    spark = pages.sparkSession
    if not isinstance(rules, DataFrame):
        rules = spark.createDataFrame(list(rules), "verdict string, rule string")
    keys = saved(_rule_keys(rules), "url-rules")
    shapes = [tuple(r) for r in keys.select("labels", "length").distinct().orderBy("labels", "length").collect()]
    host, path = url_parts(column(url_col))
    rows = packed(pages, host=host, path=path)
    if not shapes:
        return unpacked(rows, "host", "path", rule=F.lit(None).cast("string"), verdict=F.lit(default))

    n_labels = F.length("host") - F.length(F.replace(F.col("host"), F.lit("."), F.lit(""))) + 1

    def key_of(labels: int, length: int) -> Column:
        """The URL's key of a shape, null where it has fewer labels or characters."""
        end = F.substring_index("host", ".", -labels)
        key = F.struct(
            (F.length(end) + length).alias("size"),
            F.length(end).alias("host_size"),
            F.concat(end, F.substring("path", 1, length)).alias("key"),
        )
        return F.when((n_labels >= labels) & (F.length("path") >= length), key)

    found = rows.withColumn("best", F.lit(None).cast(_BEST))
    urls = pages.select(host.alias("host"), path.alias("path"))
    asked = F.explode(F.array_compact(F.array(*[key_of(*s)["key"] for s in shapes])))
    universe = urls.select(asked.alias("key"))
    n_keys = keys.count()
    # the longest filter a list of this length can need
    slices = -(-first_size(n_keys, 1 << 40)[0] // max_words)
    mine = lambda key, turn: F.pmod(F.xxhash64(key, F.lit("slice")), F.lit(slices)) == turn
    groups = [shapes[i : i + _SHAPES] for i in range(0, len(shapes), _SHAPES)]
    for turn in range(slices):
        of_turn = lambda df: df.filter(mine(F.col("key"), turn)) if slices > 1 else df  # noqa: E731, B023
        blocks, allows = (
            build_cascade(of_turn(keys.filter(F.col("verdict") == v).select("key")), of_turn(universe))
            for v in ("block", "allow")
        )

        def code_of(key: Column) -> Column:
            code = F.when(blocks.lists(key), 2).when(allows.lists(key), 1)  # noqa: B023
            return F.when(mine(key, turn), code) if slices > 1 else code  # noqa: B023

        for number, group in enumerate(groups):
            if turn or number:
                found = saved(found, "url-found")
            keyed = found.withColumns({f"key{i}": key_of(*s) for i, s in enumerate(group)})
            coded = keyed.withColumns({f"code{i}": code_of(F.col(f"key{i}.key")) for i in range(len(group))})
            hits = [
                F.when(F.col(f"code{i}").isNotNull(), F.struct(f"key{i}.size", f"key{i}.host_size", f"code{i}", f"key{i}.key"))
                for i in range(len(group))
            ]
            best = F.greatest("best", *[h.cast(_BEST) for h in hits])
            found = coded.select("row", "host", "path", best.alias("best"))
    verdict = F.when(F.col("best.code") == 2, "block").when(F.col("best.code") == 1, "allow")
    return unpacked(
        found, "host", "path", rule=F.col("best.key"), verdict=F.coalesce(verdict, F.lit(default))
    )
