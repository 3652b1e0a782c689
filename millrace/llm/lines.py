"""Drop lines that many documents share."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.frames import SPACE, column, packed, saved, unpacked


def line_key(line: str) -> str:
    """A line without white space at its ends, A-Z lower-cased."""
    return line.strip(SPACE).encode().lower().decode()


def _digest(line: str, min_chars: int) -> bytes | None:
    if len(line) < min_chars:
        return None
    key = line.strip(SPACE)
    if len(key) < min_chars:
        return None
    return xxhash.xxh3_128_digest(key.encode().lower())


def drop_shared_lines(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_chars: int = 40,
    min_docs: int = 5,
) -> DataFrame:
    """Remove lines whose key at least ``min_docs`` documents hold.

    The largest id that holds a key keeps its lines, other documents lose all of
    them. Keys shorter than ``min_chars`` code points are left alone. Returns the
    input columns, with the kept lines as text, plus ``n_lines`` (before) and
    ``n_dropped``; input columns of these two names are replaced.

    * A null or empty text is one empty line and comes back as an empty text.
    * Rows that share an id count as one document; each row is rebuilt on its own.
      Rows without an id count together as one document below all others.
    * Texts have no length limit; an empty table gives an empty result.

    Only digests of long lines are shuffled for counting, with the document count
    combined before the shuffle, so a line found everywhere stays a short list of
    partial counts. The digests to drop come back per document.
    """
    lines = docs.select(column(id_col).alias("doc"), column(text_col).alias("text"))

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, found = [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                if text is None or len(text) < min_chars:
                    continue
                own = {_digest(line, min_chars) for line in text.split("\n")}
                own.discard(None)
                rows += [i] * len(own)
                found += own
            ids = batch.column(0).take(pa.array(rows, pa.int64()))
            yield pa.record_batch([ids, pa.array(found, pa.binary())], ["doc", "line"])

    id_type = lines.schema["doc"].dataType.simpleString()
    held = saved(
        lines.mapInArrow(digests, f"doc {id_type}, line binary").distinct(), "lines"
    )
    # written, so that its join with a line held everywhere can be split
    shared = saved(
        held.groupBy("line")
        .agg(F.count(F.lit(1)).alias("n"), F.max("doc").alias("keeper"))
        .filter(F.col("n") >= min_docs)
        .select("line", "keeper"),
        "shared-lines",
    )
    lost = (
        held.join(shared, "line")
        .filter(F.col("doc").isNull() | (F.col("doc") < F.col("keeper")))
        .groupBy("doc")
        .agg(F.collect_list("line").alias("lost"))
    )

    @F.arrow_udf("struct<text: string, n_lines: bigint, n_dropped: bigint>")
    def rebuilt(texts: pa.Array, lists: pa.Array) -> pa.Array:
        out, n_lines, n_dropped = [], [], []
        for text, drop in zip(texts.to_pylist(), lists.to_pylist(), strict=True):
            all_lines = (text or "").split("\n")
            kept = all_lines
            if drop:
                gone = set(drop)
                kept = [x for x in all_lines if _digest(x, min_chars) not in gone]
            out.append("\n".join(kept))
            n_lines.append(len(all_lines))
            n_dropped.append(len(all_lines) - len(kept))
        return pa.StructArray.from_arrays(
            [
                pa.array(out, pa.string()),
                pa.array(n_lines, pa.int64()),
                pa.array(n_dropped, pa.int64()),
            ],
            ["text", "n_lines", "n_dropped"],
        )

    rows = packed(docs, id=column(id_col))
    joined = rows.join(lost, rows.id.eqNullSafe(lost.doc), "left").select(
        "row", rebuilt(F.col("row").getField(text_col), F.col("lost")).alias("r")
    )
    return unpacked(
        joined,
        **{text_col: F.col("r.text")},
        n_lines=F.col("r.n_lines"),
        n_dropped=F.col("r.n_dropped"),
    )
