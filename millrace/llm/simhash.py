"""SimHash near-duplicates by a binary trie self-join."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.components import components
from millrace.llm.frames import column, packed, saved, unpacked

BITS = 64
#: Rows of a unit that one task joins; larger units are split along the trie.
UNIT_ROWS = 256
#: Trie levels that a split descends at once, and shingles hashed at once.
STEP, CHUNK = 6, 1 << 16


def fingerprint(text: bytes, shingle: int = 3, seed: int = 42) -> int:
    """Unsigned 64-bit SimHash of a whole UTF-8 text; 0 when it has no words."""
    words = text.lower().split()
    if not words:
        return 0
    joined, size = b" ".join(words), min(shingle, len(words))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    first, last = starts[: len(words) - size + 1].tolist(), ends[size - 1 :].tolist()
    set_bits, digest = np.zeros(BITS, np.int64), xxhash.xxh64_intdigest
    for at in range(0, len(first), CHUNK):
        spans = zip(first[at : at + CHUNK], last[at : at + CHUNK], strict=True)
        h = np.array([digest(joined[a:b], seed) for a, b in spans], "<u8")
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        set_bits += bits.sum(axis=0, dtype=np.int64)
    return int(sum(1 << i for i in np.flatnonzero(2 * set_bits > len(first)).tolist()))


def fingerprints(text: F.Column, shingle: int = 3) -> F.Column:
    """The fingerprint as a signed long with the same 64 bits."""

    @F.arrow_udf("bigint")
    def simhash(texts: pa.Array) -> pa.Array:
        values = [
            fingerprint(t, shingle) if t else 0 for t in texts.cast(pa.binary()).to_pylist()
        ]
        return pa.array(np.array(values, np.uint64).view(np.int64))

    return simhash(text)


def trie_pairs(a: np.ndarray, b: np.ndarray | None, max_bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs at ``max_bits`` or fewer differing bits, of one sorted array
    (``b`` None, each pair once) or across two.

    Node pairs of the binary trie are walked together from the root: children on
    the same side keep the errors, children on different sides add one, and a
    pair over budget is left. Small pairs are compared directly.
    """
    same = b is None
    other = a if same else b
    stack = [(0, len(a), 0, len(other), BITS - 1, 0)]
    while stack:
        a0, a1, b0, b1, bit, errors = stack.pop()
        if a0 == a1 or b0 == b1:
            continue
        twin = same and a0 == b0 and a1 == b1
        if bit < 0 or (a1 - a0) * (b1 - b0) <= 4096:
            near = np.bitwise_count(a[a0:a1, None] ^ other[None, b0:b1]) <= max_bits
            i, j = np.nonzero(np.triu(near, 1) if twin else near)
            if len(i):
                yield i + a0, j + b0
            continue
        # the bits above are equal within each range, so a threshold splits it
        cut = np.uint64(1 << bit)
        am = a0 + int(np.searchsorted((a[a0:a1] & cut) != 0, True))
        bm = b0 + int(np.searchsorted((other[b0:b1] & cut) != 0, True))
        stack.append((a0, am, b0, bm, bit - 1, errors))
        stack.append((am, a1, bm, b1, bit - 1, errors))
        if errors < max_bits:
            stack.append((a0, am, bm, b1, bit - 1, errors + 1))
            if not twin:
                stack.append((am, a1, b0, bm, bit - 1, errors + 1))


def _unit_links(code: np.ndarray, rep: np.ndarray, side: np.ndarray, max_bits: int):
    """Spanning links of one unit: each linked class with the smallest it reaches."""
    order = np.argsort(code, kind="stable")
    code, rep, side = code[order], rep[order], side[order]
    if side.any():
        left, right = np.flatnonzero(side == 1), np.flatnonzero(side == 2)
        pairs = ((left[i], right[j]) for i, j in trie_pairs(code[left], code[right], max_bits))
    else:
        pairs = trie_pairs(code, None, max_bits)
    root = np.arange(len(code))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for i, j in pairs:
        for x, y in zip(i.tolist(), j.tolist(), strict=True):
            x, y = find(x), find(y)
            if x != y:
                x, y = (x, y) if rep[x] < rep[y] else (y, x)
                root[y] = x
    top = np.array([find(x) for x in range(len(code))])
    linked = np.flatnonzero(top != np.arange(len(code)))
    return rep[linked], rep[top[linked]]


def _join_units(max_bits: int):
    """Partitions sorted by unit to links, one unit in memory at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        unit = None

        def solved(parts):
            code, rep, side = (np.concatenate(x) for x in zip(*parts, strict=True))
            return _unit_links(code, rep, side, max_bits) if len(code) > 1 else ([], [])

        for batch in batches:
            if not batch.num_rows:
                continue
            units, code, rep, side = (
                batch.column(i).to_numpy(zero_copy_only=False) for i in range(4)
            )
            code = code.astype(np.int64).view(np.uint64)
            cuts = np.concatenate(([0], np.flatnonzero(units[1:] != units[:-1]) + 1, [len(units)]))
            a, b = [], []
            for s, e in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                if held and units[s] != unit:
                    x, y = solved(held)
                    a.extend(x)
                    b.extend(y)
                    held = []
                unit = units[s]
                held.append((code[s:e], rep[s:e], side[s:e]))
            yield pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])
        if held:
            x, y = solved(held)
            yield pa.record_batch([pa.array(x, pa.int64()), pa.array(y, pa.int64())], ["a", "b"])

    return run


def _masks(width: int, budget: int) -> list[tuple[int, int]]:
    return [(m, m.bit_count()) for m in range(1 << width) if m.bit_count() <= budget]


def _split(rows: DataFrame, max_bits: int) -> DataFrame:
    """Rows of large units dealt to the child node pairs they belong to.

    A row meets every child whose next ``STEP`` bits differ from its own by no
    more than what the unit's errors leave of the budget."""
    width = F.least(F.lit(STEP), F.lit(BITS) - F.col("depth"))
    masks = F.array(*[F.struct(F.lit(m).alias("mask"), F.lit(e).alias("e")) for m, e in _masks(STEP, max_bits)])
    met = (
        rows.withColumn("own", F.shiftrightunsigned(F.expr("shiftleft(code, depth)"), BITS - STEP))
        .withColumn("m", F.explode(F.filter(masks, lambda x: x["e"] + F.col("errors") <= max_bits)))
        .withColumn("other", F.col("own").bitwiseXOR(F.col("m.mask").cast("long")))
    )
    twin = F.col("side") == 0
    a = F.when(twin, F.least("own", "other")).when(F.col("side") == 1, F.col("own")).otherwise(F.col("other"))
    b = F.when(twin, F.greatest("own", "other")).when(F.col("side") == 1, F.col("other")).otherwise(F.col("own"))
    side = (
        F.when(~twin, F.col("side"))
        .when(F.col("m.mask") == 0, 0)
        .when(F.col("own") < F.col("other"), 1)
        .otherwise(2)
    )
    return met.select(
        F.xxhash64("unit", a, b, F.lit("child")).alias("unit"),
        "code", "rep",
        side.cast("int").alias("side"),
        (F.col("depth") + width).cast("int").alias("depth"),
        (F.col("errors") + F.col("m.e")).cast("int").alias("errors"),
    )


def near_links(classes: DataFrame, max_bits: int = 2) -> DataFrame:
    """Links (a, b) that connect all ``classes(code, rep)`` at ``max_bits`` or
    fewer differing bits; codes are distinct, ``rep`` names them.

    With ``max_bits + 1`` bit ranges one range is equal in any pair within the
    budget. Each range is moved to the top of a trie of its own; below a shared
    top the trie is joined with itself. A unit is a node pair with the rows under
    it. Units over ``UNIT_ROWS`` descend ``STEP`` levels in Spark: rows go to the
    child pairs that the budget still allows, pairs with one side empty vanish.
    Codes are distinct, so a unit is small at the deepest level at the latest.
    """
    n = max_bits + 1
    edges = [BITS * k // n for k in range(n + 1)]
    tries = []
    for lo, hi in zip(edges[:-1], edges[1:], strict=True):
        moved = (
            F.shiftleft("code", lo).bitwiseOR(F.shiftrightunsigned("code", BITS - lo)) if lo else F.col("code")
        )
        tries.append(
            classes.select(moved.alias("code"), "rep", F.lit(hi - lo).alias("depth"), F.lit(lo).alias("trie"))
        )
    rows = tries[0]
    for more in tries[1:]:
        rows = rows.unionByName(more)
    top = F.expr(f"shiftrightunsigned(code, cast({BITS} - depth as int))")
    rows = rows.select(
        F.xxhash64("trie", top).alias("unit"), "code", "rep", F.lit(0).alias("side"), "depth", F.lit(0).alias("errors")
    )
    rows = saved(rows, "units")
    ready = []
    while True:
        counts = saved(
            rows.groupBy("unit")
            .agg(
                F.count(F.lit(1)).alias("n"),
                F.max("side").alias("sides"),
                F.count_if(F.col("side") == 1).alias("left"),
            )
            # alone, or one side of a node pair has no rows
            .filter("n > 1 and (sides = 0 or (left > 0 and left < n))")
            .select("unit", "n"),
            "counts",
        )
        large = counts.filter(F.col("n") > UNIT_ROWS)
        ready.append(
            rows.join(counts.filter(F.col("n") <= UNIT_ROWS).select("unit"), "unit").select("unit", "code", "rep", "side")
        )
        if large.isEmpty():
            break
        rows = saved(_split(rows.join(large.select("unit"), "unit"), max_bits), "units")
    units = ready[0]
    for more in ready[1:]:
        units = units.unionByName(more)
    return (
        units.repartition("unit")
        .sortWithinPartitions("unit")
        .mapInArrow(_join_units(max_bits), "a long, b long")
        .distinct()
    )


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = 3,
    max_bits: int = 2,
) -> DataFrame:
    """(id, fingerprint, component_id) per document.

    Fingerprints of whole texts link at ``max_bits`` or fewer differing bits, and
    component_id is the smallest id reachable. Equal fingerprints are one class,
    so copies are never compared with each other.

    * Null and empty texts have fingerprint zero and link like any other.
    * Rows with one id are linked through it. A row without an id gets its
      fingerprint and a null component, and links with nothing.
    * Texts have no length limit; an empty table gives an empty result.
    """
    marked = saved(
        docs.select(column(id_col).cast("long").alias("id"), fingerprints(column(text_col), shingle).alias("code")),
        "fingerprints",
    )
    known = marked.filter("id is not null")
    classes = saved(known.groupBy("code").agg(F.min("id").alias("rep")), "classes")
    same_class = known.join(classes, "code").select(F.col("id").alias("a"), F.col("rep").alias("b"))
    links = near_links(classes, max_bits).unionByName(same_class)
    found = saved(components(links), "components")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component", "id"))
    digits = F.lower(F.lpad(F.hex("code"), 16, "0"))
    return marked.join(found, "id", "left").select(
        F.col("id").alias(id_col), digits.alias("fingerprint"), component.alias("component_id")
    )


def keep_one(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = 3,
    max_bits: int = 2,
) -> DataFrame:
    """One document of each group of near-duplicates: the smallest id of it.

    Of rows that repeat the kept id one with the smallest row hash stays.
    Documents without an id all stay.
    """
    groups = near_duplicates(docs, id_col, text_col, shingle, max_bits)
    gone = groups.filter(column(id_col) != F.col("component_id")).select(column(id_col).alias("gone")).distinct()
    rows = packed(docs, id=column(id_col).cast("long"))
    kept = rows.join(gone, rows.id == gone.gone, "left_anti")
    repeated = saved(
        rows.filter("id is not null").groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("id"),
        "repeated",
    )
    single = kept.join(repeated, "id", "left_anti").select("row")
    first = (
        kept.join(repeated, "id", "left_semi")
        .groupBy("id")
        .agg(F.min_by("row", F.xxhash64("row")).alias("row"))
        .select("row")
    )
    return unpacked(single.unionByName(first)).select(*[column(c) for c in docs.columns])
