"""Near-duplicate vectors through an inverted multi-index."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.components import components
from millrace.llm.frames import column, packed, saved, unpacked

#: Rows of a verification block on either side, vectors a cell should hold.
BLOCK_ROWS, CELL_ROWS = 512, 512


def _centres(points: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """Codewords of one half: Lloyd's iterations from random points."""
    k = min(k, len(points))
    centres = points[rng.choice(len(points), k, replace=False)].copy()
    for _ in range(12):
        near = _distances(points, centres).argmin(1)
        for c in range(k):
            own = points[near == c]
            centres[c] = own.mean(0) if len(own) else points[rng.integers(len(points))]
    return centres


def _distances(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    d = (points**2).sum(1)[:, None] - 2 * points @ centres.T + (centres**2).sum(1)[None, :]
    return np.maximum(d, 0)


class MultiIndex:
    """Two independent codebooks, one per vector half; their product is the grid.

    ``slack`` is how far beyond the nearest cell a traversal goes. It is measured
    on the sample: neighbours exactly at the threshold, in random directions,
    have their cell within ``slack`` with the target recall. Nearer neighbours
    are found more surely.
    """

    def __init__(self, sample: np.ndarray, k: int, min_cosine: float, recall: float, seed: int):
        rng = np.random.default_rng(seed)
        self.cut = sample.shape[1] // 2
        self.books = [
            _centres(half, k, rng) for half in (sample[:, : self.cut], sample[:, self.cut :])
        ]
        x = np.repeat(sample[: 1 << 11], 16, axis=0)
        g = rng.standard_normal(x.shape)
        g -= (g * x).sum(1)[:, None] * x
        norm = np.linalg.norm(g, axis=1, keepdims=True)
        y = min_cosine * x + np.sqrt(max(0.0, 1 - min_cosine**2)) * g / np.where(norm > 0, norm, 1)
        beyond = np.zeros(len(x))
        for d, e in zip(self.distances(x), self.distances(y), strict=True):
            beyond += d[np.arange(len(d)), e.argmin(1)] - d.min(1)
        self.slack = float(np.quantile(beyond, recall)) + 1e-9

    def distances(self, x: np.ndarray) -> list[np.ndarray]:
        return [_distances(h, c) for h, c in zip((x[:, : self.cut], x[:, self.cut :]), self.books, strict=True)]

    def cells(self, x: np.ndarray) -> Iterator[tuple[int, list[int]]]:
        """Each vector's own cell, and the cells it visits, its own first."""
        first, second = self.distances(x)
        width = second.shape[1]
        orders = np.argsort(first, 1), np.argsort(second, 1)
        for a, b, i, j in zip(first, second, *orders, strict=True):
            visited = [int(i[p]) * width + int(j[q]) for p, q in multi_sequence(a[i], b[j], self.slack)]
            yield visited[0], visited


def multi_sequence(a: np.ndarray, b: np.ndarray, slack: float) -> Iterator[tuple[int, int]]:
    """Places (p, q) of two ascending lists in order of a[p] + b[q], as long as
    the sum exceeds the smallest by ``slack`` at most."""
    limit = a[0] + b[0] + slack
    heap, seen = [(a[0] + b[0], 0, 0)], {(0, 0)}
    while heap:
        cost, p, q = heapq.heappop(heap)
        if cost > limit:
            return
        yield p, q
        for r, s in ((p + 1, q), (p, q + 1)):
            if r < len(a) and s < len(b) and (r, s) not in seen:
                seen.add((r, s))
                heapq.heappush(heap, (a[r] + b[s], r, s))


def _matrix(lists: pa.Array, dim: int) -> np.ndarray:
    """Unit vectors in double precision."""
    x = np.asarray(lists.flatten(), dtype=np.float64).reshape(-1, dim)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _assigned(indexes: Broadcast):
    """Add a vector's own cell and the later cells it visits. A pair in two cells
    is looked for from the earlier one, so it is verified once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = np.asarray(batch.column("dim"))
            home, visits = np.zeros(len(dims), np.int64), [[] for _ in dims]
            for dim in np.unique(dims).tolist():
                index, at = indexes.value.get(dim), np.flatnonzero(dims == dim)
                if index is None:  # a length the sample has not seen: one cell
                    continue
                x = _matrix(batch.column("vec").take(pa.array(at)), dim)
                for i, (own, visited) in zip(at.tolist(), index.cells(x), strict=True):
                    home[i], visits[i] = own, [c for c in visited if c > own]
            yield pa.record_batch(
                [*batch.columns, pa.array(home), pa.array(visits, pa.list_(pa.int64()))],
                [*batch.schema.names, "home", "visits"],
            )

    return run


def _verified(unit: dict[str, np.ndarray], vectors: pa.Array, min_cosine: float):
    """Links of one block: weight linked to each vector, and the smallest class it
    reaches inside the block."""
    x = _matrix(vectors, int(unit["dim"][0]))
    homes, probes = np.flatnonzero(unit["role"] == 0), np.flatnonzero(unit["role"] > 0)
    if not len(homes) or not len(probes):
        return None
    rep, n = unit["rep"], unit["n"]
    linked = x[probes] @ x[homes].T >= min_cosine
    # vectors of the cell itself meet each other once, from the larger id
    own = unit["role"][probes] == 1
    linked &= ~own[:, None] | (rep[probes][:, None] > rep[homes][None, :])
    rows, cols = np.flatnonzero(linked.any(1)), np.flatnonzero(linked.any(0))
    if not len(rows):
        return None
    linked = linked[np.ix_(rows, cols)]
    p, h = probes[rows], homes[cols]
    weight_p, weight_h = linked @ n[h], linked.T @ n[p]
    names, back = np.unique(np.concatenate((rep[p], rep[h])), return_inverse=True)
    top = names.copy()
    at_p, at_h = back[: len(p)], back[len(p) :]
    far = np.iinfo(np.int64).max
    while True:  # smallest name over links, until nothing changes
        before = top.copy()
        np.minimum.at(top, at_p, np.where(linked, top[at_h][None, :], far).min(1))
        np.minimum.at(top, at_h, np.where(linked, top[at_p][:, None], far).min(0))
        if (before == top).all():
            break
    weight = np.zeros(len(names), np.int64)
    np.add.at(weight, at_p, weight_p)
    np.add.at(weight, at_h, weight_h)
    return names, weight, top


_UNIT = ("rep", "n", "dim", "role")


def _verify_units(min_cosine: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        name = None

        def solved() -> pa.RecordBatch | None:
            whole = pa.Table.from_batches(held).combine_chunks()
            unit = {c: whole.column(c).to_numpy() for c in _UNIT}
            found = _verified(unit, whole.column("vec").combine_chunks(), min_cosine)
            return found and pa.record_batch([pa.array(c) for c in found], ["rep", "links", "top"])

        for batch in batches:
            units = np.asarray(batch.column("unit"))
            cuts = [0, *(np.flatnonzero(units[1:] != units[:-1]) + 1).tolist(), len(units)]
            for s, e in zip(cuts[:-1], cuts[1:], strict=True):
                if s == e:
                    continue
                if held and units[s] != name:
                    if out := solved():
                        yield out
                    held = []
                name = units[s]
                held.append(batch.slice(s, e - s))
        if held and (out := solved()):
            yield out

    return run


def near_vectors(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str | None = "label",
    min_cosine: float = 0.93,
    target_recall: float = 0.9995,
    sample_size: int = 4096,
    seed: int = 11,
) -> DataFrame:
    """Input columns with ``n_links``, ``component_id`` and ``kept``.

    Vectors of one length and equal labels (not null; all rows if ``label_col``
    is None) link at a cosine of ``min_cosine`` or more, in double precision.
    Links that are reported are exact. Links can only be missed where the
    traversal stops before a neighbour's cell; ``target_recall`` is met for
    neighbours just at the threshold, and the tests measure it by brute force.

    * Null or empty vectors, zero vectors, and those with null or non-finite
      components link with nothing, nor do rows without a label or an id; they
      are components of their own (null without an id).
    * Equal vectors are one class, verified once; rows with one id are linked.
    * An empty table gives an empty result.

    Only the codebooks rest on a sample (``sample_size`` vectors); every vector
    is indexed. A cell with more than ``BLOCK_ROWS`` vectors is verified in
    blocks by separate tasks, which send back counts and spanning links, not
    pairs. Codewords per half grow with the square root of the table.
    """
    spark = vectors.sparkSession
    vec = column(vector_col)
    label = column(label_col) if label_col else F.lit(0)
    usable = (
        column(id_col).isNotNull() & label.isNotNull() & vec.isNotNull()
        & F.forall(vec, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
        & F.exists(vec, lambda v: v != 0)
    )
    usable = F.coalesce(usable, F.lit(False))
    valid = vectors.filter(usable).select(
        column(id_col).cast("long").alias("id"), label.alias("label"), vec.alias("vec")
    )
    classes = saved(
        valid.groupBy("label", "vec")
        .agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("n"))
        .withColumn("dim", F.size("vec")),
        "vectors",
    )
    total = classes.count()
    k = max(2, round((total / CELL_ROWS) ** 0.5))
    drawn = classes.orderBy(F.xxhash64(F.lit(seed), "rep"), "rep").select("dim", "vec").limit(sample_size).toPandas()
    indexes = {
        int(dim): MultiIndex(_matrix(pa.array(list(g.vec)), int(dim)), k, min_cosine, target_recall, seed)
        for dim, g in drawn.groupby("dim")
        if dim >= 2
    }
    schema = f"{classes._jdf.schema().toDDL()}, home long, visits array<long>"
    coded = saved(
        classes.mapInArrow(_assigned(spark.sparkContext.broadcast(indexes)), schema), "cells"
    )
    place = ("label", "dim", "cell")
    homes = coded.select("label", "dim", F.col("home").alias("cell"), "rep", "n", "vec", F.lit(1).alias("role"))
    probes = coded.select("label", "dim", F.explode("visits").alias("cell"), "rep", "n", "vec", F.lit(2).alias("role"))
    members = homes.unionByName(probes)
    # numbers of blocks of either side, for cells that can have a link
    cells = saved(
        members.select(*place, "role").groupBy(*place)
        .agg(F.count_if(F.col("role") == 1).alias("h"), F.count(F.lit(1)).alias("p"))
        .filter("h > 0 and p > 1")
        .select(*place, F.ceil(F.col("h") / BLOCK_ROWS).alias("h"), F.ceil(F.col("p") / BLOCK_ROWS).alias("p")),
        "cells",
    )
    met = members.join(cells, list(place))
    parts = [
        ("h", "p", met.filter("role = 1").withColumn("role", F.lit(0))),
        ("p", "h", met),
    ]
    units = None
    for own, other, rows in parts:
        mine = F.pmod(F.xxhash64(F.lit(own), "rep"), F.col(own))
        rows = rows.withColumn("mine", mine).withColumn(
            "theirs", F.explode(F.sequence(F.lit(0).cast("long"), F.col(other) - 1))
        )
        h, p = ("mine", "theirs") if own == "h" else ("theirs", "mine")
        rows = rows.select(
            F.xxhash64(*place, h, p).alias("unit"), "rep", "n", "dim", F.col("role").cast("long").alias("role"), "vec"
        )
        units = rows if units is None else units.unionByName(rows)
    found = saved(
        units.repartition("unit").sortWithinPartitions("unit")
        .mapInArrow(_verify_units(min_cosine), "rep long, links long, top long"),
        "links",
    )
    known = valid.join(
        classes.select(F.col("label").alias("l"), F.col("vec").alias("v"), "rep", "n"),
        (F.col("label") == F.col("l")) & (F.col("vec") == F.col("v")),
    ).select("id", "rep", "n")
    known = saved(known, "members")
    links = found.select(F.col("rep").alias("a"), F.col("top").alias("b")).unionByName(
        known.select(F.col("id").alias("a"), F.col("rep").alias("b"))
    )
    group = saved(components(links), "components")
    per_class = found.groupBy("rep").agg(F.sum("links").alias("links"))
    per_id = (
        known.join(per_class, "rep", "left")
        .select("id", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"))
        .groupBy("id")
        .agg(F.max("n_links").alias("n_links"))
        .join(group, "id", "left")
        .select(F.col("id").alias("i"), "n_links", "component")
    )
    rows = packed(vectors, id=column(id_col).cast("long"), usable=usable)
    out = rows.join(per_id, (rows.id == F.col("i")) & rows.usable, "left")
    component = F.coalesce("component", "id")
    return unpacked(
        out,
        n_links=F.coalesce("n_links", F.lit(0)).cast("long"),
        component_id=component,
        kept=F.coalesce(F.col("id") == component, F.lit(False)),
    )
