"""Mix sources to target weights by pivotal (dependent) rounding of copies."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.llm.frames import column, packed, saved, unpacked, word_count

#: Documents of a leaf of the reduction tree, and children of an inner node.
LEAF_ROWS, FAN_IN = 1024, 64


def source_targets(
    sizes: DataFrame,
    weights: Sequence[float] = (5, 2, 1),
    share: float = 1.5,
    limit: float = 2.0,
) -> DataFrame:
    """One row per source of ``sizes(source, size)``: source_size and target.

    Sources in code point order, null last, take ``weights`` in turn and share
    ``share`` times all sizes in proportion. A target stops at ``limit`` times
    its source's size, and the excess is shared again among the others. With
    sources sorted by limit over weight the full ones come first, and the level
    of the others is the largest of the levels that the prefixes give.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    # one row per source, numbers only
    turn = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), turn % len(weights) + 1)
    ranked = totals.withColumn("weight", weight).withColumn(
        "most", F.col("source_size") * F.lit(float(limit))
    )
    fill = W.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    before, after = fill.rowsBetween(W.unboundedPreceding, -1), fill.rowsBetween(0, W.unboundedFollowing)
    everything = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing).orderBy(F.lit(1))
    wanted = F.lit(float(share)) * F.sum("source_size").over(everything)
    level = (wanted - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    return (
        ranked.withColumn("level", level)
        .withColumn("level", F.max("level").over(everything))
        .select(
            "source",
            F.col("source_size").cast("long").alias("source_size"),
            F.least("most", F.col("weight") * F.col("level")).alias("target"),
        )
    )


def _round(mass: np.ndarray, size: np.ndarray, draw: np.ndarray) -> tuple[np.ndarray, int]:
    """Pivotal rounding of one chain of units, each holding ``mass`` of ``size``.

    Two fractional units exchange mass until one is empty or full, in a random
    direction that keeps every expectation; the other goes on to the next. The
    sum of masses never changes. Returns each unit's final state (1 full, 0
    empty, -1 open) and the place of the open one, or -1; ``mass`` is updated.
    """
    state = np.where(mass <= 0, 0, np.where(mass >= size, 1, -1))
    held = -1
    for j in np.flatnonzero(state < 0):
        if held < 0:
            held = j
            continue
        up = min(size[held] - mass[held], mass[j])  # what can go from j to held
        down = min(mass[held], size[j] - mass[j])
        if draw[j] * (up + down) < down:
            fills = size[held] - mass[held] <= mass[j]
            mass[held], mass[j] = mass[held] + up, mass[j] - up
            done, full = (held, 1) if fills else (j, 0)
        else:
            empties = mass[held] <= size[j] - mass[j]
            mass[held], mass[j] = mass[held] - down, mass[j] + down
            done, full = (held, 0) if empties else (j, 1)
        state[done] = full
        held = j if done == held else held
        if not 0 < mass[held] < size[held]:  # both became integral at once
            state[held] = 1 if mass[held] > 0 else 0
            held = -1
    return state, held


def _groups(pdf: pd.DataFrame):
    """Positions of each source's rows; a null source is a group of its own."""
    return pdf.groupby("source", dropna=False, sort=True).indices.values()


def _leaf(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values(["turn", "id", "size", "n"], kind="stable", ignore_index=True)
    size = pdf["size"].to_numpy("f8") * pdf["n"].to_numpy("f8")
    mass, draw = size * pdf["part"].to_numpy("f8"), pdf["draw"].to_numpy("f8")
    state = np.zeros(len(pdf), "i4")
    for at in _groups(pdf):
        m = mass[at]
        state[at], _ = _round(m, size[at], draw[at])
        mass[at] = m
    return pdf.assign(state=state, mass=mass)[
        ["bucket", "id", "source", "size", "n", "whole", "state", "mass"]
    ]


def _node(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("bucket", kind="stable", ignore_index=True)
    mass, size, draw = (pdf[c].to_numpy("f8").copy() for c in ("mass", "size", "draw"))
    state = np.zeros(len(pdf), "i4")
    for at in _groups(pdf):
        m = mass[at]
        state[at], _ = _round(m, size[at], draw[at])
        mass[at] = m
    return pdf.assign(state=state, mass=mass)[["bucket", "source", "size", "state", "mass"]]


def _uniform(hashed: Column) -> Column:
    """A hash as a number from 0 to below 1."""
    return F.pmod(hashed, F.lit(1 << 53)) / float(1 << 53)


def copies(
    sized: DataFrame,
    weights: Sequence[float] = (5, 2, 1),
    share: float = 1.5,
    limit: float = 2.0,
    seed: int = 17,
) -> DataFrame:
    """Whole numbers of copies for ``sized(id, source, size)``.

    Returns distinct (id, source, size), the number ``n`` of such rows, their
    source_size and target, and ``copies`` of each row. The expected number of
    copies is target over source_size; rounding exchanges mass in words, so the
    words taken of a source differ from its target by one document at most.

    Leaves of the tree are hash buckets over all sources, so a hot source is
    spread over all of them, and each sends one open document per source upwards
    at most; above the leaves each source has nodes of its own. Order and draws
    come from hashes of their own, draws from one for each level: reruns agree on
    any layout, and what a document has survived says nothing about its next draw. Rows equal in id, source and size are one unit. Documents without
    words take the floor of the expectation.
    """
    rows = saved(
        sized.groupBy("id", "source", "size").agg(F.count(F.lit(1)).alias("n")), "sizes"
    )
    targets = saved(
        source_targets(rows.select("source", (F.col("size") * F.col("n")).alias("size")), weights, share, limit),
        "targets",
    )
    n_buckets = max(1, -(-rows.count() // LEAF_ROWS))
    hashed = F.xxhash64(F.lit(seed), "id", "source", "size")
    expected = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    unit = (
        rows.join(targets, rows.source.eqNullSafe(targets.source))
        .select(rows.id, rows.source, rows["size"], "n", expected.alias("expected"))
        .select(
            "id", "source", "size", "n",
            F.pmod(hashed, F.lit(n_buckets)).alias("bucket"),
            F.floor("expected").cast("long").alias("whole"),
            F.when(F.col("size") > 0, F.col("expected") - F.floor("expected")).otherwise(0.0).alias("part"),
            F.xxhash64(F.lit(seed + 2), "id", "source", "size").alias("turn"),
            _uniform(F.xxhash64(F.lit(seed + 1), "id", "source", "size")).alias("draw"),
        )
    )
    kinds = {f.name: f.dataType.simpleString() for f in unit.schema}
    leaf_schema = (
        f"bucket long, id {kinds['id']}, source {kinds['source']}, size long, n long, "
        "whole long, state int, mass double"
    )
    leaves = saved(unit.groupBy("bucket").applyInPandas(_leaf, leaf_schema), "leaves")

    node_schema = f"bucket long, source {kinds['source']}, size double, state int, mass double"
    open_rows = leaves.filter("state = -1").select(
        "bucket", "source", (F.col("size") * F.col("n")).cast("double").alias("size"), "mass"
    )
    # a source has one open document in a leaf at most, so this tells them apart
    draw = lambda level: _uniform(F.xxhash64(F.lit(seed + 2 + level), "bucket", "source"))
    decided, n_nodes, level = [], n_buckets, 0
    while n_nodes > 1:
        level += 1
        n_nodes = -(-n_nodes // FAN_IN)
        step = F.pow(F.lit(float(FAN_IN)), F.lit(float(level))).cast("long")
        solved = saved(
            open_rows.withColumns({"up": F.floor(F.col("bucket") / step).cast("long"), "draw": draw(level)})
            .groupBy("up", "source")
            .applyInPandas(_node, node_schema),
            "nodes",
        )
        decided.append(solved.filter("state >= 0").select("bucket", "source", "state"))
        open_rows = solved.filter("state = -1").select("bucket", "source", "size", "mass")
    # one open document per source at the root: full with the probability it holds
    decided.append(
        open_rows.select("bucket", "source", (draw(level + 1) * F.col("size") < F.col("mass")).cast("int").alias("state"))
    )
    final = decided[0]
    for more in decided[1:]:
        final = final.unionByName(more)
    final = final.select(F.col("bucket").alias("b"), F.col("source").alias("s"), F.col("state").alias("up"))
    joined = leaves.join(
        final, (leaves.bucket == F.col("b")) & leaves.source.eqNullSafe(F.col("s")) & (leaves.state == -1), "left"
    )
    taken = joined.select(
        "id", "source", "size", "n",
        (F.col("whole") + F.when(F.col("state") >= 0, F.col("state")).otherwise(F.col("up"))).alias("copies"),
    )
    t = targets.select(F.col("source").alias("s"), "source_size", "target")
    return taken.join(t, taken.source.eqNullSafe(F.col("s"))).drop("s")


def sizes(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """(id, source, size): words of every whole text; a null text has none."""
    return docs.select(
        column(id_col).alias("id"), column(source_col).alias("source"), word_count(column(text_col)).alias("size")
    )


def mix_report(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options
) -> DataFrame:
    """One row per document: id, size, source_size, target and the words taken."""
    rows = copies(sizes(docs, id_col, text_col, source_col), **options)
    return rows.select(
        F.col("id").alias(id_col), "size", "source_size", "target",
        (F.col("size") * F.col("copies")).alias("taken"),
        F.explode(F.sequence(F.lit(1).cast("long"), "n")).alias("__row"),
    ).drop("__row")


def mix(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options
) -> DataFrame:
    """The mix: every document as often as it is taken, with its own columns.

    Documents not taken are left out, others come one to ``limit`` times. Nulls
    are values like others in ids and sources; a null text has size 0. An empty
    table gives an empty mix.
    """
    rows = packed(
        docs, i=column(id_col), s=column(source_col), z=word_count(column(text_col))
    )
    taken = copies(sizes(docs, id_col, text_col, source_col), **options).filter("copies > 0")
    taken = taken.select("id", "source", "size", "copies")
    joined = rows.join(
        taken,
        rows.i.eqNullSafe(taken.id) & rows.s.eqNullSafe(taken.source) & (rows.z == taken["size"]),
    )
    repeated = joined.select("row", F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("k"))
    return unpacked(repeated).select(*[column(c) for c in docs.columns])
